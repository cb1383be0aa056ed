"""References of chapters resolved to archive entries, read, prepared and counted.

refs: pub_id, chapter_href (may be null), ref. Exact candidates are joined by equality and order; only what they miss is
compared with the manifest, on the file name as key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import crypto, paths
from ..functions.types import lit
from ..storage import forget, store
from .css import css_references, css_rewrite
from .html import html_annotate, html_promote_styles, html_rewrite, local_references
from .nav import comparable, fits

MAX_INLINE = 4 << 20


def candidates(chapter_href: Column, ref: Column, opf_dir: Column) -> Column:
    """Package paths that a reference may mean, in order: against its chapter, the package document's folder, the root."""
    decoded = paths.percent_decode(paths.before(paths.before(ref, "?"), "#"))
    folder = F.btrim(opf_dir, lit("/"))
    chapter = F.regexp_replace(paths.before(paths.before(chapter_href, "?"), "#"), "^/+", "")
    inside = F.when((folder != "") & ~F.startswith(chapter, F.concat(folder, lit("/"))), paths.join_path(folder, chapter)).otherwise(chapter)
    clean = lambda p: F.regexp_replace(p, "^/+", "")
    own = F.array(F.when(chapter_href.isNotNull(), clean(paths.normalize(paths.dir_of(inside), decoded))), clean(paths.normalize(folder, decoded)), clean(decoded))
    every = F.when(decoded.startswith("/"), F.array(clean(F.substr(decoded, lit(2))))).otherwise(own)
    return F.array_distinct(F.filter(every, lambda p: p.isNotNull() & (p != "")))


def media_types(zip_paths: DataFrame, items: DataFrame) -> DataFrame:
    """zip_paths (pub_id, zip_path) with media_type: of the manifest item of that path, or else one that ends alike, or else by extension."""
    own = items.select(F.col("pub_id").alias("p_"), F.col("href").alias("h_"), F.col("media_type").alias("m_"), "doc_order", "opf_dir")
    keyed = own.withColumn("k_", paths.name_of(comparable("h_", "opf_dir")[0]))
    want = zip_paths.select("pub_id", "zip_path").distinct().withColumn("w_", paths.name_of("zip_path"))
    pairs = want.join(keyed, (F.col("pub_id") == F.col("p_")) & (F.col("w_") == F.col("k_")))
    tier = fits(comparable("h_", "opf_dir"), comparable("zip_path", "opf_dir"))
    best = pairs.withColumn("tier", tier).where("tier is not null").groupBy("pub_id", "zip_path").agg(F.min_by("m_", F.struct("tier", "doc_order")).alias("found_"))
    return zip_paths.join(best, ["pub_id", "zip_path"], "left").withColumn("media_type", F.coalesce("found_", paths.mime_for_path("zip_path"))).drop("found_")


def resolve(refs: DataFrame, entries: DataFrame, items: DataFrame, dirs: DataFrame) -> DataFrame:
    """refs with zip_path and media_type; null for external and empty references and those that nothing matches."""
    local = refs.where((F.coalesce("ref", lit("")) != "") & ~paths.is_external("ref")).select("pub_id", "chapter_href", "ref").distinct().join(dirs.select("pub_id", "opf_dir"), "pub_id")
    each = local.select("pub_id", "chapter_href", "ref", "opf_dir", F.posexplode(candidates(F.col("chapter_href"), F.col("ref"), F.col("opf_dir"))).alias("rank", "path"))
    hit = each.join(entries.select("pub_id", "path"), ["pub_id", "path"]).groupBy("pub_id", "chapter_href", "ref").agg(F.min_by("path", "rank").alias("zip_path"))
    missed = local.alias("a").join(hit.alias("b"), (F.col("a.pub_id") == F.col("b.pub_id")) & F.col("a.chapter_href").eqNullSafe(F.col("b.chapter_href")) & (F.col("a.ref") == F.col("b.ref")), "left_anti")
    own = items.select(F.col("pub_id").alias("p_"), F.col("href").alias("h_"), F.col("media_type").alias("m_"), "doc_order")
    decoded = paths.percent_decode(paths.before(paths.before(F.col("ref"), "?"), "#"))
    loose = missed.withColumn("d_", decoded).join(own, (F.col("pub_id") == F.col("p_")) & (paths.name_of("d_") == paths.name_of(paths.percent_decode("h_"))))
    loose = loose.where(fits(comparable("h_", "opf_dir"), comparable("d_", "opf_dir")).isNotNull()).groupBy("pub_id", "chapter_href", "ref", "opf_dir").agg(F.min_by(F.struct("h_", "m_"), "doc_order").alias("i"))
    fuzzy = loose.select("pub_id", "chapter_href", "ref", paths.normalize(F.btrim("opf_dir", lit("/")), F.col("i.h_")).alias("zip_path"), F.col("i.m_").alias("media_type"))
    found = media_types(hit, items).select("pub_id", "chapter_href", "ref", "zip_path", "media_type").unionByName(fuzzy)
    found = found.select(F.col("pub_id").alias("p_"), F.col("chapter_href").alias("c_"), F.col("ref").alias("r_"), "zip_path", "media_type")
    return refs.join(found, (F.col("pub_id") == F.col("p_")) & F.col("chapter_href").eqNullSafe(F.col("c_")) & (F.col("ref") == F.col("r_")), "left").drop("p_", "c_", "r_")


def read(resolved: DataFrame, entries: DataFrame, encryption: DataFrame | None = None, identifiers: DataFrame | None = None, hook=None) -> DataFrame:
    """resolved (pub_id, zip_path) with content: fonts unmasked with the publication's identifier, other encrypted entries through the hook."""
    out = resolved.join(entries.select("pub_id", F.col("path").alias("zip_path"), "content"), ["pub_id", "zip_path"], "left")
    if encryption is None:
        return out
    out = out.join(encryption.select("pub_id", "zip_path", "algorithm"), ["pub_id", "zip_path"], "left").join(identifiers.select("pub_id", "identifier"), "pub_id", "left")
    return out.withColumn("content", crypto.read_encrypted("content", F.coalesce("identifier", lit("")), "algorithm", hook)).drop("algorithm", "identifier")


def reference_closure(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """roots (pub_id, chapter, path) with all that they reach over edges (pub_id, path, target), as pub_id, chapter, path; each once, cycles end. A round adds what is new, until nothing is; its front is stored, so that no round runs again in the next."""
    front = seen = store(roots.select("pub_id", "chapter", "path").distinct(), "front")
    while front.limit(1).count():
        front = store(front.join(edges, ["pub_id", "path"]).select("pub_id", "chapter", F.col("target").alias("path")).distinct().join(seen, ["pub_id", "chapter", "path"], "left_anti"), "front")
        seen = seen.unionByName(front)
    return seen


def prepare(chapters: DataFrame, resources: DataFrame, max_bytes: int = MAX_INLINE, base: str | None = None) -> DataFrame:
    """Self-contained chapters. chapters: pub_id, chapter, path, html and, with base, that column; resources: pub_id, path, content, media_type (may be null).

    Adds prepared (html with its resources as data URIs, style sheets as style elements) and stats: considered, inlined, skipped_oversize, missing, skipped_type. Sheets are written leaves first, so that nested imports are inlined; what is in a cycle stays as it is.
    """
    typed = resources.select("pub_id", "path", "content", paths.resolve_media_type("path", "media_type").alias("type"), F.octet_length("content").alias("size"))
    start = chapters.select("pub_id", "chapter", F.explode(F.array_distinct(local_references("html", "path"))).alias("path"))
    sheets = typed.where((F.col("type") == "text/css") & (F.col("size") <= max_bytes)).select("pub_id", "path", F.col("content").cast("string").alias("css"))
    sheets = store(sheets, "sheets")
    edges = store(sheets.select("pub_id", "path", F.explode(F.array_distinct(css_references("css", "path"))).alias("target")), "edges")
    reach = reference_closure(start, edges)
    state = F.when(F.col("size").isNull(), "missing").when(F.col("size") > max_bytes, "skipped_oversize").when(paths.inlineable("type"), "inlined").otherwise("skipped_type")
    known = reach.join(typed.select("pub_id", "path", "type", "size"), ["pub_id", "path"], "left").withColumn("state", state)
    count = lambda s: F.count_if(F.col("state") == s).alias(s)
    stats = known.groupBy("pub_id", "chapter").agg(F.struct(F.count("*").alias("considered"), count("inlined"), count("skipped_oversize"), count("missing"), count("skipped_type")).alias("stats"))
    plain = typed.where(paths.inlineable("type") & (F.col("size") <= max_bytes) & (F.col("type") != "text/css")).select("pub_id", "path", paths.data_uri("type", "content").alias("uri"))
    done, left = plain, sheets
    while True:
        open_ = edges.join(left.select("pub_id", F.col("path").alias("target")), ["pub_id", "target"], "left_semi").select("pub_id", "path").distinct()
        ready = left.join(open_, ["pub_id", "path"], "left_anti")
        if not ready.limit(1).count():
            break
        done = done.unionByName(store(_sheet_uris(ready, edges, done), "uris"))
        left, before = store(left.join(open_, ["pub_id", "path"], "left_semi"), "sheets"), left
        forget(before)
    done = done.unionByName(_sheet_uris(left, edges, done))
    urls = reach.join(done, ["pub_id", "path"]).groupBy("pub_id", "chapter").agg(F.map_from_entries(F.collect_list(F.struct("path", "uri"))).alias("urls"))
    html = F.col("html") if base is None else html_annotate("html", F.col(base))
    out = chapters.join(urls, ["pub_id", "chapter"], "left").join(stats, ["pub_id", "chapter"], "left")
    none = F.struct(*[lit(0).cast("long").alias(n) for n in ("considered", "inlined", "skipped_oversize", "missing", "skipped_type")])
    return out.withColumns({"prepared": html_promote_styles(html_rewrite(html, F.col("path"), F.col("urls"))), "stats": F.coalesce("stats", none)}).drop("urls")


def _sheet_uris(sheets: DataFrame, edges: DataFrame, done: DataFrame) -> DataFrame:
    maps = edges.join(done.select("pub_id", F.col("path").alias("target"), "uri"), ["pub_id", "target"]).groupBy("pub_id", "path").agg(F.map_from_entries(F.collect_list(F.struct("target", "uri"))).alias("urls"))
    new = css_rewrite("css", F.col("path"), F.col("urls"))
    return sheets.join(maps, ["pub_id", "path"], "left").select("pub_id", "path", paths.data_uri(lit("text/css"), F.encode(new, "UTF-8")).alias("uri"))
