"""Navigation and media overlays: trees as adjacency rows, and what reading systems ask of them.

nav: pub_id, list (toc, page-list, landmarks), node_id, parent_id, depth, ord, pre_order, title, href, role. Node ids number
a list's entries in pre-order, so a parent comes before its children and a tree can be put together again at the edge.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import paths
from ..functions.deep import unwind
from ..functions.media import clock_seconds, media_fragment
from ..functions.types import Udf, lit, string
from . import css, htmlcore, xmlcore

NODE = "struct<list string, node_id int, parent_id int, depth int, ord int, title string, href string, role string>"
LISTS = ("toc", "page-list", "landmarks")


def _resolve(base: str, href: str) -> str:
    if not base or not href or href.startswith("#") or css.is_external(href):
        return href
    path, mark, fragment = href.partition("#")
    return css.fold(base, path) + mark + fragment


def _list(ol: htmlcore.Node, base: str, out: list[dict], kind: str, parent: int | None, depth: int) -> Iterator:
    ord_ = 0
    for li in ol.children:
        link = li.first("a") if li.name == "li" else None
        if link is None:
            continue
        me = len(out)
        out.append({
            "list": kind, "node_id": me, "parent_id": parent, "depth": depth, "ord": ord_, "title": link.text().strip(),
            "href": _resolve(base, css.decode_percent(link.attrs.get("href", ""))), "role": link.attrs.get("epub:type", "").strip() or None,
        })
        ord_ += 1
        below = li.first("ol")
        if below is not None:
            yield _list(below, base, out, kind, me, depth + 1)


def nav_nodes(html: str, base: str) -> list[dict]:
    """The lists of a navigation document. A later nav of a kind replaces an earlier one; without a toc by type, nav#toc or else the first nav is it."""
    document = htmlcore.parse(html)
    navs = [n for n in document.walk() if n.name == "nav"]
    found: dict[str, list[dict]] = {}
    for nav in navs:
        ol = nav.first("ol")
        for kind in [t.removeprefix("epub:") for t in nav.attrs.get("epub:type", "").split()] if ol is not None else []:
            rows: list[dict] = []
            unwind(_list(ol, base, rows, kind, None, 0))
            if rows and kind in LISTS:
                found[kind] = rows
    if "toc" not in found:
        nav = next((n for n in navs if n.attrs.get("id") == "toc"), navs[0] if navs else None)
        ol = nav.first("ol") if nav is not None else None
        if ol is not None:
            rows = []
            unwind(_list(ol, base, rows, "toc", None, 0))
            found["toc"] = rows
    return [r for kind in LISTS for r in found.get(kind, [])]


def ncx_nodes(xml: bytes | str) -> list[dict]:
    """The same lists of an NCX; hrefs aren't resolved, page targets need a label and a place."""
    rows = xmlcore.rows(xml)
    out: list[dict] = []
    below: dict[int, list[dict]] = {}
    counts: dict[str, int] = {}
    for r in rows:
        below.setdefault(r["parent"] if r["parent"] is not None else -1, []).append(r)

    def entry(r: dict, kind: str, parent: int | None, depth: int, ord_: int) -> int | None:
        title = href = ""
        for c in below.get(r["ord"], []):
            if c["name"] == "navLabel":
                title = next((t["text"].strip() for t in below.get(c["ord"], []) if t["name"] == "text"), title)
            elif c["name"] == "content":
                href = css.decode_percent(c["attrs"].get("src", ""))
        if kind == "page-list" and not (title and href):
            return None
        me = counts[kind] = counts.get(kind, -1) + 1
        out.append({"list": kind, "node_id": me, "parent_id": parent, "depth": depth, "ord": ord_, "title": title, "href": href, "role": None})
        return me

    def points(r: dict, parent: int | None, depth: int) -> Iterator:
        for i, c in enumerate(x for x in below.get(r["ord"], []) if x["name"] == "navPoint"):
            yield points(c, entry(c, "toc", parent, depth, i), depth + 1)

    for r in rows:
        if r["name"] == "navMap":
            unwind(points(r, None, 0))
        elif r["name"] == "pageList":
            for i, c in enumerate(x for x in below.get(r["ord"], []) if x["name"] == "pageTarget"):
                entry(c, "page-list", None, 0, i)
    return out


def _ncx(xml: bytes | None) -> list[dict]:
    try:
        return ncx_nodes(bytes(xml)) if xml is not None else []
    except ValueError:
        return []


html_nav_nodes = Udf(lambda html, base: nav_nodes(html, base or "") if html is not None else [], f"array<{NODE}>")
xml_ncx_nodes = Udf(_ncx, f"array<{NODE}>")


def navigation(entries: DataFrame, items: DataFrame, packed: DataFrame) -> DataFrame:
    """The lists of each publication: of its first manifest item with the property nav, or else of the NCX that the spine names."""
    navs = items.where(F.array_contains("properties", "nav")).groupBy("pub_id").agg(F.min_by(F.struct("href", "opf_dir"), "doc_order").alias("n"))
    full = F.when(F.col("opf_dir") == "", F.col("href")).otherwise(F.concat_ws("/", "opf_dir", "href"))
    nav = navs.select("pub_id", "n.*").withColumn("path", full).join(entries.select("pub_id", "path", "content"), ["pub_id", "path"])
    nav = nav.select("pub_id", F.explode(html_nav_nodes(F.col("content").cast("string"), paths.dir_of("path"))).alias("n"))
    toc = packed.join(navs.select("pub_id"), "pub_id", "left_anti").select("pub_id", F.col("toc_id").alias("id"))
    ncx = toc.join(items.select("pub_id", "id", "href", "opf_dir"), ["pub_id", "id"]).withColumn("path", full).join(entries.select("pub_id", "path", "content"), ["pub_id", "path"])
    ncx = ncx.select("pub_id", F.explode(xml_ncx_nodes("content")).alias("n"))
    return nav.unionByName(ncx).select("pub_id", "n.*", F.col("n.node_id").alias("pre_order"))


def title_map(nodes: DataFrame) -> DataFrame:
    """pub_id, href_key (href without fragment), title: the first entry of the toc, in pre-order, for each file."""
    toc = nodes.where(F.col("list") == "toc").withColumn("href_key", paths.before(F.col("href"), "#"))
    return toc.groupBy("pub_id", "href_key").agg(F.min_by("title", "pre_order").alias("title"))


def chapter_titles(chapters: DataFrame, nodes: DataFrame, mode: str = "normalized") -> DataFrame:
    """chapters (pub_id, href, opf_dir) with the toc's title of their file: hrefs compared in their comparable forms, or, strict, as they are written."""
    titles = title_map(nodes)
    if mode == "strict":
        return chapters.join(titles.withColumnRenamed("href_key", "href"), ["pub_id", "href"], "left")
    dirs = chapters.select("pub_id", "opf_dir").distinct()
    known = nodes.where(F.col("list") == "toc").join(dirs, "pub_id").withColumn("k_", comparable("href", "opf_dir")[1])
    best = known.groupBy("pub_id", "k_").agg(F.min_by("title", "pre_order").alias("title"))
    return chapters.withColumn("k_", comparable("href", "opf_dir")[1]).join(best, ["pub_id", "k_"], "left").drop("k_")


def comparable(href: Column | str, opf_dir: Column | str) -> tuple[Column, Column]:
    """An href's two comparable forms: as a package path, and without the package document's folder."""
    full = F.regexp_replace(paths.percent_decode(paths.before(paths.before(string(href), "?"), "#")), "^/+", "")
    prefix = F.concat(F.btrim(string(opf_dir), lit("/")), lit("/"))
    return full, F.when((prefix != "/") & F.startswith(full, prefix), F.substr(full, F.length(prefix) + 1)).otherwise(full)


def fits(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """0 if any two forms are equal, 1 if one ends in the other after a slash or the file names agree; null otherwise."""
    equal = (a[0] == b[0]) | (a[1] == b[1]) | (a[0] == b[1]) | (a[1] == b[0])
    file_a, file_b = paths.name_of(a[1]), paths.name_of(b[1])
    near = F.endswith(a[0], F.concat(lit("/"), b[1])) | F.endswith(b[0], F.concat(lit("/"), a[1])) | ((file_a != "") & (file_a == file_b))
    return F.when(equal, 0).when(near, 1)


def toc_titles(asked: DataFrame, nodes: DataFrame, dirs: DataFrame, href: str = "href") -> DataFrame:
    """asked (pub_id, href) with title: the toc entry that is the same text, or else the same path, or else ends alike; the first in pre-order of the best. Paths that match always share their file name, so that is the join's key."""
    toc = nodes.where(F.col("list") == "toc").join(dirs.select("pub_id", "opf_dir"), "pub_id")
    toc = toc.select(F.col("pub_id").alias("p_"), F.trim("href").alias("t_"), "title", "pre_order", "opf_dir")
    toc = toc.withColumn("f_", comparable("t_", "opf_dir")[0]).withColumn("k_", paths.name_of("f_"))
    want = asked.select("pub_id", F.col(href).alias("h_")).distinct().join(dirs.select("pub_id", "opf_dir").withColumnRenamed("opf_dir", "d_"), "pub_id")
    want = want.withColumn("w_", comparable("h_", "d_")[0]).withColumn("k2_", paths.name_of("w_"))
    pairs = want.join(toc, (F.col("pub_id") == F.col("p_")) & ((F.col("k2_") == F.col("k_"))))
    tier = F.when(F.trim("h_") == F.col("t_"), -1).otherwise(fits(comparable("t_", "opf_dir"), comparable("h_", "d_")))
    best = pairs.withColumn("tier", tier).where("tier is not null").groupBy("pub_id", "h_").agg(F.min_by("title", F.struct("tier", "pre_order")).alias("title"))
    return asked.join(best.withColumnRenamed("pub_id", "p_"), (F.col("pub_id") == F.col("p_")) & (F.col(href) == F.col("h_")), "left").drop("p_", "h_")


def spine_items(spine: DataFrame, items: DataFrame) -> DataFrame:
    """The spine with href, media_type, properties, media_overlay and opf_dir of its manifest items; missing ones are null."""
    own = items.select("pub_id", F.col("id").alias("idref"), "href", "media_type", "properties", "media_overlay", "opf_dir")
    return spine.join(own, ["pub_id", "idref"], "left")


def spine_of_href(asked: DataFrame, chapters: DataFrame, href: str = "href") -> DataFrame:
    """asked (pub_id, href) with spine_of: the first spine item whose href is the same, ends in it, is its end, or has the same file name (fragments don't count). The ends are compared as plain text: either side is joined by equality with all ends of the other."""
    clean = lambda c: paths.before(c, "#")
    ends = lambda c: F.explode(F.transform(F.sequence(lit(1), F.length(c) + 1), lambda i: F.substr(c, i)))
    own = chapters.where(F.col("href").isNotNull()).select(F.col("pub_id").alias("p_"), F.col("spine_index").alias("i_"), clean(F.col("href")).alias("m_"))
    want = asked.select("pub_id", F.col(href).alias("h_")).distinct().withColumn("c_", clean(F.col("h_")))
    whole, name = lambda c: c, paths.name_of
    tiers = []
    for left, right in ((whole, ends), (ends, whole), (name, name)):
        first = own.select("p_", right(F.col("m_")).alias("k_"), "i_").groupBy("p_", "k_").agg(F.min("i_").alias("i_"))
        tiers.append(want.select("pub_id", "h_", left(F.col("c_")).alias("w_")).join(first, (F.col("pub_id") == F.col("p_")) & (F.col("w_") == F.col("k_"))).select("pub_id", "h_", "i_"))
    best = tiers[0].unionByName(tiers[1]).unionByName(tiers[2]).groupBy("pub_id", "h_").agg(F.min("i_").alias("spine_of"))
    return asked.join(best.withColumnRenamed("pub_id", "p_"), (F.col("pub_id") == F.col("p_")) & (F.col(href) == F.col("h_")), "left").drop("p_", "h_")


def looks_like_cover(idref: Column, href: Column, properties: Column, cover_id: Column) -> Column:
    i, h = F.lower(idref), F.lower(F.coalesce(href, lit("")))
    return F.coalesce(cover_id == idref, lit(False)) | i.contains("cover") | i.contains("titlepage") | (i == "title") | h.contains("cover") | h.contains("titlepage") | F.coalesce(F.array_contains(properties, "cover-image"), lit(False))


def reading_start(chapters: DataFrame, nodes: DataFrame, guide: DataFrame, covers: DataFrame) -> DataFrame:
    """pub_id, spine_index, source, href: where reading begins. Landmarks by role, then guide entries, then the first linear item that isn't like a cover, then the first. chapters: spine_items(); covers: pub_id, cover_id."""
    role = F.explode(F.array(*[F.struct(lit(i).alias("k"), lit(r).alias("r")) for i, r in enumerate(("bodymatter", "text", "chapter", "body"))]))
    token = F.exists(F.split(F.coalesce("role", lit("")), r"\s+"), lambda t: (F.regexp_replace(t, "^(epub:)+", "") == F.col("w.r")) | F.endswith(t, F.concat(lit(":"), F.col("w.r"))))
    marks = nodes.where(F.col("list") == "landmarks").withColumn("w", role).where(token)
    marks = marks.groupBy("pub_id", "w").agg(F.min_by("href", "pre_order").alias("href")).select("pub_id", F.col("w.k").alias("k"), F.concat(lit("landmark:"), "w.r").alias("source"), "href")
    wanted = F.when(F.lower("ref_type") == "text", 10).when(F.lower("ref_type") == "start", 11)
    guides = guide.withColumn("k", wanted).where("k is not null").groupBy("pub_id", "k").agg(F.min_by("href", "ord").alias("href"))
    guides = guides.select("pub_id", "k", F.when(F.col("k") == 10, "guide:text").otherwise("guide:start").alias("source"), "href")
    linked = spine_of_href(marks.unionByName(guides), chapters).where("spine_of is not null").select("pub_id", "k", F.col("spine_of").alias("spine_index"), "source", "href")
    cover = looks_like_cover(F.col("idref"), F.col("href"), F.col("properties"), F.col("cover_id"))
    own = chapters.join(covers.select("pub_id", "cover_id"), "pub_id", "left")
    first = own.where(F.col("linear") & ~cover).groupBy("pub_id").agg(F.min("spine_index").alias("spine_index"), F.min_by("href", "spine_index").alias("href"))
    first = first.select("pub_id", lit(20).alias("k"), "spine_index", F.when(F.col("spine_index") == 0, "spine_zero").otherwise("cover_skip").alias("source"), "href")
    zero = own.groupBy("pub_id").agg(F.min_by("href", "spine_index").alias("href")).select("pub_id", lit(30).alias("k"), lit(0).alias("spine_index"), lit("spine_zero").alias("source"), "href")
    every = linked.unionByName(first).unionByName(zero)
    return every.groupBy("pub_id").agg(F.min_by(F.struct("spine_index", "source", "href"), "k").alias("b")).select("pub_id", "b.*")


def cover_image(items: DataFrame, covers: DataFrame) -> DataFrame:
    """pub_id, id, href, media_type of the cover: by the package's cover id, the property, an image whose id or href says so, any image; the first in the manifest of the best."""
    own = items.join(covers.select("pub_id", "cover_id"), "pub_id", "left")
    image = F.col("media_type").startswith("image/")
    tier = F.when(F.col("id") == F.col("cover_id"), 0).when(F.array_contains("properties", "cover-image"), 1).when(image & (F.lower("id").contains("cover") | F.lower("href").contains("cover")), 2).when(image, 3)
    best = own.withColumn("tier", tier).where("tier is not null").groupBy("pub_id").agg(F.min_by(F.struct("id", "href", "media_type"), F.struct("tier", "doc_order")).alias("c"))
    return best.select("pub_id", "c.*")


# --- trees as JSON

def to_tree(rows: list[dict]) -> list[dict]:
    """Adjacency rows (parents before children) as nested entries: title, href, role if there is one, children."""
    made: dict[int, dict] = {}
    top: list[dict] = []
    for r in sorted(rows, key=lambda r: r["node_id"]):
        entry = {"title": r["title"], "href": r["href"]} | ({"role": r["role"]} if r.get("role") else {}) | {"children": []}
        made[r["node_id"]] = entry
        (top if r["parent_id"] is None else made[r["parent_id"]]["children"]).append(entry)
    return top


def from_tree(entries: list[dict]) -> list[dict]:
    """Nested entries as adjacency rows in pre-order."""
    out: list[dict] = []

    def visit(kids: list[dict], parent: int | None, depth: int) -> Iterator:
        for i, e in enumerate(kids):
            me = len(out)
            out.append({"list": "toc", "node_id": me, "parent_id": parent, "depth": depth, "ord": i, "title": e.get("title", ""), "href": e.get("href", ""), "role": e.get("role")})
            yield visit(e.get("children") or [], me, depth + 1)

    unwind(visit(entries, None, 0))
    return out


def tree_text(entries: list[dict]) -> str:
    """Nested entries as JSON, however deep they are."""
    out: list[str] = []

    def write(kids: list[dict]) -> Iterator:
        out.append("[")
        for i, e in enumerate(kids):
            own = json.dumps({k: v for k, v in e.items() if k != "children"}, ensure_ascii=False)
            out.append((", " if i else "") + own[:-1] + (", " if len(own) > 2 else "") + '"children": ')
            yield write(e["children"])
            out.append("}")
        out.append("]")

    unwind(write(entries))
    return "".join(out)


def _rows_of(text: str | None) -> list[dict]:
    try:
        return from_tree(json.loads(text)) if text else []
    except (ValueError, RecursionError):  # no JSON, or deeper than the JSON reader goes
        return []


_tree_json = Udf(lambda rows: tree_text(to_tree([dict(r) if isinstance(r, dict) else r.asDict() for r in rows])), "string")
_json_rows = Udf(_rows_of, f"array<{NODE}>")


def trees_to_json(nodes: DataFrame) -> DataFrame:
    """pub_id, list, tree (JSON): one row for each list of each publication."""
    role = F.col("role") if "role" in nodes.columns else lit(None).cast("string")
    row = F.struct("node_id", "parent_id", "title", "href", role.alias("role"))
    return nodes.groupBy("pub_id", "list").agg(_tree_json(F.collect_list(row)).alias("tree"))


def trees_from_json(trees: DataFrame) -> DataFrame:
    """Adjacency rows of trees (pub_id, tree); none of text that isn't JSON or nests deeper than Python reads JSON (some thousand levels)."""
    return trees.select("pub_id", F.explode(_json_rows("tree")).alias("n")).select("pub_id", "n.*", F.col("n.node_id").alias("pre_order"))


# --- media overlays

_SMIL = "struct<node_id int, parent_id int, kind string, text_ref string, audio_src string, clip_begin string, clip_end string, role array<string>>"


def smil_rows(xml: bytes | str, base: str) -> list[dict]:
    """seq and par elements of the body in pre-order; a par without text and audio is left out, as is an empty seq tag."""
    rows = xmlcore.rows(xml)
    kids: dict[int, list[dict]] = {}
    for r in rows:
        kids.setdefault(r["parent"] if r["parent"] is not None else -1, []).append(r)
    out: list[dict] = []
    at = lambda r, name: r["attrs"].get(name, r["attrs"].get("epub:" + name))
    place = lambda src: None if src is None else _resolve(base, src)

    def visit(r: dict, parent: int | None) -> Iterator:
        for c in kids.get(r["ord"], []):
            roles = (at(c, "type") or "").split()
            if c["name"] == "seq":
                if not kids.get(c["ord"]) and not at(c, "textref"):
                    continue
                me = len(out)
                out.append({"node_id": me, "parent_id": parent, "kind": "seq", "text_ref": place(at(c, "textref")) or "", "audio_src": None, "clip_begin": None, "clip_end": None, "role": roles})
                yield visit(c, me)
            elif c["name"] == "par":
                parts = {x["name"]: x["attrs"] for x in kids.get(c["ord"], [])}
                words, sound = parts.get("text", {}).get("src"), parts.get("audio", {})
                if words or sound.get("src"):
                    out.append({"node_id": len(out), "parent_id": parent, "kind": "par", "text_ref": place(words) or "", "audio_src": place(sound.get("src")), "clip_begin": sound.get("clipBegin"), "clip_end": sound.get("clipEnd"), "role": roles})
            else:
                yield visit(c, parent)

    for r in rows:
        if r["name"] == "body":
            unwind(visit(r, None))
    return out


def _smil(xml: bytes | None, base: str | None) -> list[dict]:
    try:
        return smil_rows(bytes(xml), base or "") if xml is not None else []
    except ValueError:
        return []


xml_smil_rows = Udf(_smil, f"array<{_SMIL}>")


def overlay_chain(chapters: DataFrame, items: DataFrame) -> DataFrame:
    """pub_id, spine_index, href, smil_path, prev_smil, next_smil along the linear items with an overlay. chapters: spine_items()."""
    smil = items.select("pub_id", F.col("id").alias("media_overlay"), F.when(F.col("opf_dir") == "", F.col("href")).otherwise(F.concat_ws("/", "opf_dir", "href")).alias("smil_path"))
    own = chapters.where(F.col("linear") & F.col("media_overlay").isNotNull()).join(smil, ["pub_id", "media_overlay"])
    order = W.partitionBy("pub_id").orderBy("spine_index")
    return own.select("pub_id", "spine_index", "href", "smil_path", F.lag("smil_path").over(order).alias("prev_smil"), F.lead("smil_path").over(order).alias("next_smil"))


def overlays(entries: DataFrame, chain: DataFrame) -> DataFrame:
    """pub_id, smil_path, node_id, parent_id, kind, text_ref, audio_ref (with its clip as a fragment), role."""
    files = chain.select("pub_id", F.col("smil_path").alias("path")).distinct().join(entries.select("pub_id", "path", "content"), ["pub_id", "path"])
    rows = files.select("pub_id", F.col("path").alias("smil_path"), F.explode(xml_smil_rows("content", paths.dir_of("path"))).alias("s"))
    audio = F.when(F.col("s.audio_src").isNotNull(), media_fragment("s.audio_src", clock_seconds("s.clip_begin"), clock_seconds("s.clip_end")))
    return rows.select("pub_id", "smil_path", "s.node_id", "s.parent_id", "s.kind", "s.text_ref", audio.alias("audio_ref"), "s.role")
