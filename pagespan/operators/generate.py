"""Packages out: validation, package document, navigation documents and the archive, from tables of parts.

Inputs, all with pub_id: books(version '2.0' or '3.0', title, identifier, language, creators array<struct<name, role,
file_as>>, publisher, description, date, rights, subjects, layout, cover_id, theme_css); resources(ord, id, href, media_type,
properties array<string>, content); spine(spine_index, idref, linear, layout_override, page_spread); toc (adjacency rows
node_id, parent_id, title, href in pre-order); landmarks(ord, epub_type, href, title); pages(ord, name, href). Columns that
aren't there count as null.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.deep import unwind
from ..functions.types import lit
from ..sources.packages import pack
from .html import inferred_properties, inject_head

ROOT = "OEBPS/"
# Fixed values of the formats.
OPF_NS, DC_NS, OPS_NS = "http://www.idpf.org/2007/opf", "http://purl.org/dc/elements/1.1/", "http://www.idpf.org/2007/ops"
NCX_NS, XHTML_NS, CONTAINER_NS = "http://www.daisy.org/z3986/2005/ncx/", "http://www.w3.org/1999/xhtml", "urn:oasis:names:tc:opendocument:xmlns:container"
NO_IDENTIFIER = "urn:uuid:00000000-0000-0000-0000-000000000000"
THEME_ID, THEME_HREF = "pagespan-theme", "styles/pagespan.css"
THEME = "body { margin: 5% 7%; line-height: 1.45; font-family: serif; }\nh1, h2, h3 { font-family: sans-serif; line-height: 1.2; }\nimg { max-width: 100%; }\n"
_SPREADS = {"left": "page-spread-left", "right": "page-spread-right", "center": "rendition:page-spread-center"}


# --- parts as rows

def chapter_rows(chapters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Resources and spine of chapters(pub_id, spine_index, id, href, html and, if there, linear, layout_override, page_spread). What the markup shows becomes properties, except of items outside the reading order."""
    has = set(chapters.columns)
    opt = lambda n, default: F.coalesce(F.col(n), default) if n in has else default
    linear = opt("linear", lit(True))
    none = F.array().cast("array<string>")
    resources = chapters.select("pub_id", F.col("spine_index").alias("ord"), "id", "href", lit("application/xhtml+xml").alias("media_type"), F.when(linear, inferred_properties("html")).otherwise(none).alias("properties"), F.encode("html", "UTF-8").alias("content"))
    order = chapters.select("pub_id", "spine_index", F.col("id").alias("idref"), linear.alias("linear"), opt("layout_override", lit(None).cast("string")).alias("layout_override"), opt("page_spread", lit(None).cast("string")).alias("page_spread"))
    return resources, order


def cover_row(covers: DataFrame) -> DataFrame:
    """Resources of covers(pub_id, href, media_type, content)."""
    return covers.select("pub_id", lit(-1).alias("ord"), lit("cover-image").alias("id"), "href", "media_type", F.array(lit("cover-image")).alias("properties"), "content")


def imported_name(reference: Column, folder: str) -> tuple[Column, Column]:
    """The id and href that an asset of an imported page gets: folder and file name; marks of paths become underscores in the id."""
    return F.regexp_replace(reference, r"[/.\\]", "_"), F.concat(lit(folder + "/"), paths.name_of(reference))


def import_pages(pages: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pages(pub_id, id, path, html) with their images and style sheets taken from files(path, content): pages with links to ../images and ../styles, and the assets found. Missing files are left out, their links change all the same."""
    from .html import html_rewrite_links

    tags = F.regexp_extract_all("html", lit(r"(?is)<(?:img|link)\b[^>]*>"), lit(0))
    one = lambda t: F.struct(F.lower(F.regexp_extract(t, r"(?i)^<(img|link)", 1)).alias("tag"), F.regexp_extract(t, r"""(?is)\s(?:src|href)\s*=\s*["']([^"']*)["']""", 1).alias("ref"))
    found = pages.select("pub_id", "id", "path", F.explode(F.array_distinct(F.transform(tags, one))).alias("t")).select("pub_id", "id", "path", "t.*")
    found = found.where((F.col("ref") != "") & ~F.startswith("ref", lit("http")) & ~F.startswith("ref", lit("data:")))
    image = F.col("tag") == "img"
    asset, to = F.when(image, imported_name(F.col("ref"), "images")[0]).otherwise(imported_name(F.col("ref"), "styles")[0]), F.when(image, imported_name(F.col("ref"), "images")[1]).otherwise(imported_name(F.col("ref"), "styles")[1])
    found = found.withColumns({"asset": asset, "to": to, "file": paths.join_path(paths.dir_of("path"), "ref")})
    urls = found.groupBy("pub_id", "id").agg(F.map_from_entries(F.collect_set(F.struct("ref", F.concat(lit("../"), "to")))).alias("urls"))
    changed = pages.join(urls, ["pub_id", "id"], "left").withColumn("html", html_rewrite_links("html", F.col("urls"))).drop("urls")
    assets = found.join(files.select(paths.join_path(lit(""), "path").alias("file"), "content"), "file").dropDuplicates(["pub_id", "asset"])
    return changed, assets.select("pub_id", F.col("asset").alias("id"), F.col("to").alias("href"), F.when(image, "image/jpeg").otherwise("text/css").alias("media_type"), "content")


# --- validation

def validate(books: DataFrame, resources: DataFrame, spine: DataFrame, toc: DataFrame | None = None) -> DataFrame:
    """errors(pub_id, ord, message), in order: blank metadata, an empty spine, spine items and toc entries without a resource, a missing cover."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), lit(""))) == ""
    named = [(0, "title"), (1, "identifier"), (2, "language")]
    checks = [books.where(blank(c)).select("pub_id", F.struct(lit(k).alias("k"), lit(0).alias("i")).alias("ord"), lit(f"{c} is blank").alias("message")) for k, c in named]
    at = lambda k, i: F.struct(lit(k).alias("k"), i.cast("int").alias("i")).alias("ord")
    checks.append(books.join(spine, "pub_id", "left_anti").select("pub_id", at(3, lit(0)), lit("reading order has no items").alias("message")))
    ids, hrefs = resources.select("pub_id", F.col("id").alias("idref")).distinct(), resources.select("pub_id", F.col("href").alias("file")).distinct()
    checks.append(spine.join(ids, ["pub_id", "idref"], "left_anti").select("pub_id", at(4, F.col("spine_index")), F.format_string("reading order: no resource with id %s", "idref").alias("message")))
    if toc is not None:
        entries = toc.withColumn("file", paths.before(F.col("href"), "#"))
        checks.append(entries.join(hrefs, ["pub_id", "file"], "left_anti").select("pub_id", at(5, F.col("node_id")), F.format_string("table of contents: no file %s for entry %s", "file", "title").alias("message")))
    if "cover_id" in books.columns:
        covers = books.where(F.col("cover_id").isNotNull()).select("pub_id", F.col("cover_id").alias("idref"))
        checks.append(covers.join(ids, ["pub_id", "idref"], "left_anti").select("pub_id", at(6, lit(0)), F.format_string("cover: no resource with id %s", "idref").alias("message")))
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out.select("pub_id", (F.col("ord.k") * 1_000_000 + F.col("ord.i")).alias("ord"), "message")


# --- documents as text

class Xml:
    """Indented XML with attributes in the given order."""

    def __init__(self, head: str):
        self.lines, self.depth = [head], 0

    @staticmethod
    def tag(name: str, attrs: dict) -> str:
        return name + "".join(f' {k}="{escape(str(v), {chr(34): "&quot;"})}"' for k, v in attrs.items() if v is not None)

    def line(self, text: str) -> None:
        self.lines.append("  " * self.depth + text)

    def open(self, name: str, /, **attrs) -> None:
        self.line(f"<{self.tag(name, _names(attrs))}>")
        self.depth += 1

    def close(self, name: str) -> None:
        self.depth -= 1
        self.line(f"</{name}>")

    def empty(self, name: str, /, **attrs) -> None:
        self.line(f"<{self.tag(name, _names(attrs))}/>")

    def text(self, name: str, value: str, /, **attrs) -> None:
        self.line(f"<{self.tag(name, _names(attrs))}>{escape(value)}</{name.split()[0]}>")

    def __str__(self) -> str:
        return "\n".join(self.lines)


def _names(attrs: dict) -> dict:
    return {k.rstrip("_").replace("__", ":").replace("_", "-"): v for k, v in attrs.items()}


def opf_text(book: dict, resources: list[dict], spine: list[dict], landmarks: list[dict], has_toc: bool, modified: str | None) -> str:
    three = book.get("version") != "2.0"
    x = Xml('<?xml version="1.0" encoding="UTF-8"?>')
    x.open("package", version="3.0" if three else "2.0", unique_identifier="pub-id", xmlns=OPF_NS)
    x.open("metadata", xmlns__dc=DC_NS)
    if book.get("title") is not None:
        x.text("dc:title", book["title"])
    for i, c in enumerate(book.get("creators") or []):
        x.text("dc:creator", c["name"], id=f"creator_{i}")
        if c["role"] is not None:
            x.text("meta", c["role"], refines=f"#creator_{i}", property="role", scheme="marc:relators")
        if c["file_as"] is not None:
            x.text("meta", c["file_as"], refines=f"#creator_{i}", property="file-as")
    x.text("dc:language", book.get("language") or "en")
    x.text("dc:identifier", book.get("identifier") or NO_IDENTIFIER, id="pub-id")
    for name in ("publisher", "description", "date", "rights"):
        if book.get(name) is not None:
            x.text(f"dc:{name}", book[name])
    for s in book.get("subjects") or []:
        x.text("dc:subject", s)
    if three:
        if modified:
            x.text("meta", modified, property="dcterms:modified")
        if book.get("layout") == "pre-paginated":
            x.text("meta", "pre-paginated", property="rendition:layout")
    if book.get("cover_id") is not None:
        x.empty("meta", name="cover", content=book["cover_id"])
    x.close("metadata")
    x.open("manifest")
    for r in resources:
        x.empty("item", id=r["id"], href=r["href"], media_type=r["media_type"], properties=" ".join(r["properties"]) or None)
    x.close("manifest")
    x.open("spine", toc="ncx" if has_toc else None)
    for s in spine:
        layout = {"reflowable": ["rendition:layout-reflowable"], "pre-paginated": ["rendition:layout-pre-paginated"]}.get(s.get("layout_override"), [])
        spread = [_SPREADS[s["page_spread"]]] if s.get("page_spread") in _SPREADS else []
        x.empty("itemref", idref=s["idref"], linear=None if s["linear"] else "no", properties=" ".join(layout + spread) or None if three else None)
    x.close("spine")
    if landmarks:
        x.open("guide")
        for m in landmarks:
            x.empty("reference", type=m["epub_type"], title=m["title"], href=m["href"])
        x.close("guide")
    x.close("package")
    return str(x)


def _children(toc: list[dict]) -> dict:
    out: dict = {}
    for n in sorted(toc, key=lambda n: n["node_id"]):
        out.setdefault(n["parent_id"], []).append(n)
    return out


def nav_text(toc: list[dict], landmarks: list[dict], pages: list[dict]) -> str:
    x = Xml('<?xml version="1.0" encoding="utf-8"?>\n<!DOCTYPE html>')
    x.open("html", xmlns=XHTML_NS, xmlns__epub=OPS_NS)
    x.open("head")
    x.text("title", "Navigation")
    x.close("head")
    x.open("body")
    below = _children(toc)

    def entries(parent: int | None) -> Iterator:
        if below.get(parent):
            x.open("ol")
            for n in below[parent]:
                x.open("li")
                x.text("a", n["title"], href=n["href"])
                yield entries(n["node_id"])
                x.close("li")
            x.close("ol")

    x.open("nav", epub__type="toc", id="toc")
    x.text("h1", "Table of Contents")
    unwind(entries(None))
    x.close("nav")
    for kind, head, rows in (("landmarks", "Landmarks", [(m["title"], {"epub__type": m["epub_type"], "href": m["href"]}) for m in landmarks]), ("page-list", "Page List", [(p["name"], {"href": p["href"]}) for p in pages])):
        if rows:
            x.open("nav", epub__type=kind, id=kind)
            x.text("h2", head)
            x.open("ol")
            for title, attrs in rows:
                x.open("li")
                x.text("a", title, **attrs)
                x.close("li")
            x.close("ol")
            x.close("nav")
    x.close("body")
    x.close("html")
    return str(x)


def ncx_text(book: dict, toc: list[dict], pages: list[dict]) -> str:
    x = Xml('<?xml version="1.0" encoding="UTF-8"?>')
    x.open("ncx", xmlns=NCX_NS, version="2005-1")
    x.open("head")
    for name, value in (("uid", book.get("identifier") or NO_IDENTIFIER), ("depth", 1), ("totalPageCount", len(pages)), ("maxPageNumber", len(pages))):
        x.empty("meta", name=f"dtb:{name}", content=value)
    x.close("head")

    def label(name: str, value: str) -> None:
        x.open(name)
        x.text("text", value)
        x.close(name)

    label("docTitle", book.get("title") or "Untitled")
    below, order = _children(toc), 0

    def points(parent: int | None) -> Iterator:
        nonlocal order
        for n in below.get(parent, []):
            order += 1
            x.open("navPoint", id=f"navPoint-{order}", playOrder=order)
            label("navLabel", n["title"])
            x.empty("content", src=n["href"])
            yield points(n["node_id"])
            x.close("navPoint")

    x.open("navMap")
    unwind(points(None))
    x.close("navMap")
    if pages:
        x.open("pageList")
        label("navLabel", "Pages")
        for i, p in enumerate(pages, 1):
            order += 1
            x.open("pageTarget", id=f"page-{i}", type="normal", value=p["name"], playOrder=order)
            label("navLabel", p["name"])
            x.empty("content", src=p["href"])
            x.close("pageTarget")
        x.close("pageList")
    x.close("ncx")
    return str(x)


CONTAINER = f'<?xml version="1.0" encoding="UTF-8"?>\n<container version="1.0" xmlns="{CONTAINER_NS}">\n  <rootfiles>\n    <rootfile full-path="{ROOT}content.opf" media-type="application/oebps-package+xml"/>\n  </rootfiles>\n</container>\n'


def _relative(source: str, target: str) -> str:
    import posixpath

    return posixpath.relpath(target, posixpath.dirname(source) or ".")


def build_one(book: dict, resources: list[dict], spine: list[dict], toc: list[dict], landmarks: list[dict], pages: list[dict], modified: str | None) -> bytes:
    """One archive: theme, navigation documents, theme links, package document, files."""
    resources = [dict(r, properties=list(r["properties"] if r["properties"] is not None else []), content=bytes(r["content"] or b"")) for r in resources]
    css = book.get("theme_css")
    if css:
        resources.append({"id": THEME_ID, "href": THEME_HREF, "media_type": "text/css", "properties": [], "content": css.encode()})
    if toc:
        if book.get("version") != "2.0":
            resources.append({"id": "nav", "href": "nav.xhtml", "media_type": "application/xhtml+xml", "properties": ["nav"], "content": nav_text(toc, landmarks, pages).encode()})
        resources.append({"id": "ncx", "href": "toc.ncx", "media_type": "application/x-dtbncx+xml", "properties": [], "content": ncx_text(book, toc, pages).encode()})
    if css:
        for r in resources:
            if r["media_type"] == "application/xhtml+xml" and "nav" not in r["properties"]:
                link = f'<link rel="stylesheet" type="text/css" href="{_relative(r["href"], THEME_HREF)}"/>'
                r["content"] = inject_head(r["content"].decode("utf-8", "replace"), link).encode()
    opf = opf_text(book, resources, spine, landmarks, bool(toc), modified)
    return pack([("META-INF/container.xml", CONTAINER.encode()), *((ROOT + r["href"], r["content"]) for r in resources), (ROOT + "content.opf", opf.encode())])


def build(books: DataFrame, resources: DataFrame, spine: DataFrame, toc: DataFrame | None = None, landmarks: DataFrame | None = None, pages: DataFrame | None = None, modified: Column | str | None = None) -> DataFrame:
    """Archives: pub_id, content. The parts of a publication come together once; modified is the time to write (default: now)."""
    gather = lambda df, order, *cols: df.groupBy("pub_id").agg(F.sort_array(F.collect_list(F.struct(order, *[c for c in cols if c in df.columns]))).alias("x"))
    lists = {
        "resources": gather(resources.withColumn("properties", F.coalesce("properties", F.array().cast("array<string>"))), "ord", "id", "href", "media_type", "properties", "content"),
        "spine": gather(spine, "spine_index", "idref", "linear", "layout_override", "page_spread"),
    }
    for name, df, cols in (("toc", toc, ("node_id", "parent_id", "title", "href")), ("landmarks", landmarks, ("ord", "epub_type", "href", "title")), ("pages", pages, ("ord", "name", "href"))):
        if df is not None:
            lists[name] = gather(df, *cols)
    when = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'") if modified is None else (F.col(modified) if isinstance(modified, str) else modified)
    rows = books.select("pub_id", F.struct(*[c for c in books.columns if c != "pub_id"]).alias("book"), when.alias("modified"))
    for name, df in lists.items():
        rows = rows.join(df.withColumnRenamed("x", name), "pub_id", "left")
    names = list(lists)

    def one(book, modified_, *parts):
        given = {n: [r.asDict() if hasattr(r, "asDict") else dict(r) for r in (p or [])] for n, p in zip(names, parts, strict=True)}
        b = book.asDict(recursive=True) if hasattr(book, "asDict") else dict(book)
        return build_one(b, given["resources"], given["spine"], given.get("toc", []), given.get("landmarks", []), given.get("pages", []), modified_)

    return rows.select("pub_id", F.udf(one, "binary", useArrow=True)("book", "modified", *names).alias("content"))
