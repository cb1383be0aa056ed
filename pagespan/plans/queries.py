"""The registered queries of the publication operators, over the driver's tables seen as publications (corpus.py)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import a11y, coords, crypto, media, paths
from ..functions.types import lit
from ..operators import css, generate, html, nav, opf, positions, resolve, search
from ..sources import packages
from ..storage import store
from .corpus import conv_books, doc_books, page_books, table, toc_tree

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _text(c: str) -> Column:
    return F.col(c).cast("string")


# --- reading positions

@query
def positions_by_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions.positions(conv_books(spark, sf_dir)).drop("title")


@query
def positions_small_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions.positions(conv_books(spark, sf_dir), 256).drop("title")


@query
def positions_fixed_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions.positions(doc_books(spark, sf_dir)).drop("title")


@query
def positions_encrypted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third chapter has a length before encryption."""
    c = conv_books(spark, sf_dir)
    original = F.when(F.col("spine_index") % 3 == 0, F.col("length") * 2 + 500)
    return positions.positions(c.withColumn("length", positions.effective_length(original, F.col("length")))).drop("title")


@query
def position_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions.position_index(positions_by_book(spark, sf_dir))


@query
def location_from_cfi(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = positions_by_book(spark, sf_dir)
    return positions.locate(found.select("pub_id", "cfi"), positions.position_index(found)).select("pub_id", "cfi", "location")


@query
def cfi_from_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 100).alias("pub_id"), (F.col("event_id") % 12).alias("location"))
    return positions.position_at(asked, positions_by_book(spark, sf_dir)).select("event_id", "pub_id", "location", "cfi")


@query
def location_from_progression(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = positions_by_book(spark, sf_dir).groupBy("pub_id").agg(F.count("*").alias("n"))
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 100).alias("pub_id"), (F.pmod(F.floor("value"), lit(100)) / 100.0).alias("progression"))
    return e.join(counts, "pub_id", "left").select("event_id", "pub_id", "progression", positions.location_of_progression("progression", "n").alias("location"))


def _first_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of contents: each chapter under its first three words, and once more with a fragment."""
    c = conv_books(spark, sf_dir)
    title = F.substring_index(F.col("body"), " ", 3)
    rows = c.select("pub_id", F.explode(F.array(F.struct((F.col("spine_index") * 2 + 1).alias("k"), F.concat("href", lit("#a")).alias("h"), F.concat(title, lit("!")).alias("t")), F.struct((F.col("spine_index") * 2).alias("k"), F.col("href").alias("h"), title.alias("t")))).alias("x"))
    return rows.select("pub_id", lit("toc").alias("list"), F.col("x.k").alias("node_id"), F.col("x.k").alias("pre_order"), F.col("x.h").alias("href"), F.col("x.t").alias("title"))


@query
def title_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nav.title_map(_first_words(spark, sf_dir))


@query
def positions_titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = title_map(spark, sf_dir).withColumnRenamed("href_key", "href")
    return positions.positions(conv_books(spark, sf_dir).join(titles, ["pub_id", "href"], "left")).select("pub_id", "global_position", "cfi", "title")


@query
def position_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks every 200 characters of each turn as a page of one paragraph."""
    c = conv_books(spark, sf_dir)
    page = F.concat(lit("<html><head></head><body><p>"), F.replace(F.replace("body", lit("&"), lit("&amp;")), lit("<"), lit("&lt;")), lit("</p></body></html>"))
    m = html.html_markers(page, coords.spine_base("spine_index", "idref"), lit(200), lit(0))
    return c.select("pub_id", "spine_index", m.alias("m")).select("pub_id", "spine_index", F.size("m.markers").alias("n_markers"), "m.carried", F.try_element_at("m.markers", lit(-1)).alias("last_marker"))


# --- coordinates

@query
def cfi_spine_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv_books(spark, sf_dir).select("pub_id", "spine_index", coords.spine_base("spine_index", "idref").alias("base"))


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions_by_book(spark, sf_dir).select("pub_id", "spine_index", "global_position", "cfi", coords.cfi_parse("cfi").alias("c"))


@query
def cfi_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("pub_id").orderBy(coords.cfi_key("c").desc()))
    return _parsed(spark, sf_dir).select("pub_id", "cfi", rank.cast("long").alias("from_end"))


@query
def cfi_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parsed(spark, sf_dir)
    a, b = p.select("pub_id", F.col("cfi").alias("a"), F.col("c").alias("x")), p.select("pub_id", (F.col("global_position") - 2).alias("g"), F.col("cfi").alias("b"), F.col("c").alias("y"))
    a = a.join(p.select("pub_id", F.col("cfi").alias("a"), F.col("global_position").alias("g")), ["pub_id", "a"])
    return a.join(b, ["pub_id", "g"]).select("pub_id", "a", "b", coords.cfi_compare("x", "y").alias("order_ab"), coords.cfi_compare("y", "x").alias("order_ba"), coords.cfi_equal("x", "x").alias("equal_aa"))


@query
def cfi_resolve_xpath(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _parsed(spark, sf_dir).select("pub_id", "cfi", coords.cfi_resolve("c").alias("r")).select("pub_id", "cfi", "r.start")
    return r.select("pub_id", "cfi", "start.spine_index", "start.xpath", "start.xpath_ns_agnostic", "start.is_text_node", F.size("start.steps").alias("n_steps"))


@query
def cfi_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each position of a chapter after the first to the chapter's last."""
    p = _parsed(spark, sf_dir).withColumn("last", F.max("global_position").over(W.partitionBy("pub_id", "spine_index")))
    ends = p.where("global_position = last").select("pub_id", "spine_index", F.col("cfi").alias("to_cfi"), F.col("c").alias("y"))
    return p.where("global_position < last").join(ends, ["pub_id", "spine_index"]).select("pub_id", "cfi", "to_cfi", coords.cfi_range_of("c", "y").alias("range"))


@query
def cfi_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).select("pub_id", "cfi", coords.cfi_text("c").alias("again"))


# --- paths and media types

def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of the pages, made relative, with the page's own path as base."""
    p = page_books(spark, sf_dir)
    link = F.explode(F.regexp_extract_all("html", lit('href="([^"]*)"'), lit(1)))
    base = F.concat(lit("OEBPS/p"), _text("pub_id"))
    return p.select("page_id", base.alias("base"), F.concat(base, lit("/"), "idref", lit(".xhtml")).alias("file"), link.alias("link")).withColumn("rel", F.concat(lit(".."), "link", lit("%20x.png?v=1#top"))).distinct()


@query
def url_external(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    each = p.select("page_id", F.explode(F.array(F.col("url"), F.regexp_replace("url", "^https?:", ""), F.regexp_replace("url", "^https?://", ""), F.upper("url"), F.concat(lit("mailto:"), "url"))).alias("ref")).distinct()
    return each.select("page_id", "ref", paths.is_external("ref").alias("is_external"))


@query
def path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).select("page_id", "link", paths.join_path("base", "rel").alias("joined"))


@query
def path_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).select("page_id", "link", paths.normalize("base", "rel").alias("path"))


@query
def path_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = paths.normalize("base", "rel")
    return _links(spark, sf_dir).select("page_id", "link", paths.relative_path("file", target).alias("relative"))


@query
def href_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).select("page_id", "link", paths.resolve_href("base", "rel").alias("href"), paths.chapter_href("file", "link").alias("chapter_href"))


@query
def path_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _links(spark, sf_dir).select("page_id", "link", F.explode(F.array(F.col("link"), F.col("rel"), F.concat(lit("a/.."), "link"), F.concat(lit("a"), "link"))).alias("path")).distinct()
    return each.select("page_id", "path", paths.escapes_root("path").alias("escapes"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest from parts: a publication for each brand."""
    kinds = ["xhtml", "css", "png", "jpg", "svg", "woff2", "mp3", "js", "jpe", "bin"]
    p = table(spark, sf_dir, "part")
    kind = F.element_at(F.array(*map(lit, kinds)), (F.col("p_partkey") % len(kinds) + 1).cast("int"))
    return p.select(F.col("p_brand").alias("pub_id"), F.col("p_partkey").cast("int").alias("doc_order"), F.concat(lit("id"), _text("p_partkey")).alias("id"), F.concat(F.replace("p_name", lit(" "), lit("/")), _text("p_partkey"), lit("."), kind).alias("href"), kind.alias("kind"), F.col("p_size").alias("size"))


@query
def mime_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _items(spark, sf_dir)
    declared = F.when(F.col("size") % 3 == 0, "application/octet-stream").when(F.col("size") % 3 == 1, " ").otherwise("x/declared")
    return i.select("pub_id", "id", paths.mime_for_path("href").alias("media_type"), paths.guess_media_type("href").alias("guessed"), paths.resolve_media_type("href", declared).alias("resolved"), paths.inlineable(paths.guess_media_type("href")).alias("inlineable"))


@query
def media_type_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.media_type_histogram(_items(spark, sf_dir).withColumn("media_type", paths.mime_for_path("href")))


@query
def data_uri(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = conv_books(spark, sf_dir)
    return c.select("pub_id", "spine_index", paths.data_uri(paths.mime_for_path("href"), F.encode("body", "UTF-8")).alias("uri"))


# --- package documents

@query
def rendition_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renditions from orders: a customer's orders in turn; wanted is a reflowable layout in French."""
    o = table(spark, sf_dir, "orders")
    idx = (F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).cast("int")
    r = o.select(F.col("o_custkey").alias("pub_id"), idx.alias("idx"), F.concat(lit("opf"), _text("o_orderkey")).alias("opf_path"), F.when(F.col("o_orderkey") % 3 == 0, "pre-paginated").when(F.col("o_orderkey") % 3 == 1, "reflowable").alias("layout"), F.when(F.col("o_orderkey") % 5 == 0, "fr").when(F.col("o_orderkey") % 5 == 1, "en").alias("language"))
    return opf.best_rendition(r, "reflowable", "fr").select("pub_id", "idx", "opf_path")


@query
def reading_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    lang = F.when(F.col("doc_id") % 7 == 0, F.concat(lit("AR-"), "lang")).otherwise(F.col("lang"))
    return d.select("doc_id", opf.reading_direction(F.when(F.col("doc_id") % 11 == 0, "rtl").otherwise("default"), lang).alias("direction"))


@query
def series_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three parts a book, their collections in the order of their keys."""
    p = table(spark, sf_dir, "part")
    entry = F.struct(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 2 == 0, "series").otherwise("set").alias("collection_type"), F.col("p_size").cast("double").alias("position"))
    books = p.groupBy(F.floor(F.col("p_partkey") / 3).cast("long").alias("pub_id")).agg(F.sort_array(F.collect_list(entry)).alias("belongs_to"))
    s = opf.series("belongs_to")
    return books.select("pub_id", s["name"].alias("series_name"), s["position"].alias("series_position"))


def _made(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives generated from the conversations: one for each, with a toc in document order."""
    c = conv_books(spark, sf_dir)
    page = F.concat(lit("<html><head></head><body><p>"), F.replace(F.replace("body", lit("&"), lit("&amp;")), lit("<"), lit("&lt;")), lit("</p></body></html>"))
    chapters = c.select("pub_id", "spine_index", F.col("idref").alias("id"), "href", page.alias("html"), "linear")
    books = c.groupBy("pub_id").agg(F.min_by("body", "spine_index").alias("b")).select("pub_id", lit("3.0").alias("version"), F.substring_index("b", " ", 4).alias("title"), F.concat(lit("urn:conv:"), _text("pub_id")).alias("identifier"), lit("en").alias("language"))
    resources, order = generate.chapter_rows(chapters)
    toc = c.select("pub_id", F.col("spine_index").alias("node_id"), lit(None).cast("int").alias("parent_id"), F.concat(lit("Turn "), _text("spine_index"), lit(" & on")).alias("title"), "href")
    return generate.build(books, resources, order, toc, modified=lit("2024-01-01T00:00:00Z"))


def _entries(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return packages.entries(_made(spark, sf_dir), **options).withColumn("pub_id", F.col("pub_id").cast("long"))


@query
def epub_roundtrip_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = store(_entries(spark, sf_dir, names=["META-INF/container.xml", "OEBPS/content.opf"]), "entries")
    m = opf.metadata(opf.packages(e, opf.renditions(e)))
    return m.select("pub_id", "title", "identifier", "language", "modified", "layout")


@query
def epub_roundtrip_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = store(_entries(spark, sf_dir, names=["META-INF/container.xml", "OEBPS/content.opf"]), "entries")
    p = opf.packages(e, opf.renditions(e))
    return nav.spine_items(opf.spine(p), opf.manifest(p)).select("pub_id", "spine_index", "idref", "linear", "href", "media_type")


@query
def epub_roundtrip_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _entries(spark, sf_dir).where("path like 'OEBPS/text/%'")
    return e.select("pub_id", "path", "length", F.md5("content").alias("md5"))


@query
def epub_roundtrip_nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = store(_entries(spark, sf_dir, names=["META-INF/container.xml", "OEBPS/content.opf", "OEBPS/nav.xhtml", "OEBPS/toc.ncx"]), "entries")
    p = opf.packages(e, opf.renditions(e))
    return nav.navigation(e, opf.manifest(p), opf.metadata(p)).select("pub_id", "list", "node_id", "depth", "title", "href")


@query
def epub_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is in each generated archive, without inflating it."""
    return _entries(spark, sf_dir, content=False).groupBy("pub_id").agg(F.count("*").alias("n_entries"), F.min_by("path", "ord").alias("first_entry"), F.max_by("path", "ord").alias("last_entry"))


@query
def entry_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that are spelt otherwise than the archive has them."""
    i = _items(spark, sf_dir)
    known = i.select("pub_id", F.col("href").alias("path"), F.col("doc_order").alias("ord"))
    swapped = F.when(F.col("kind") == "png", F.regexp_replace("href", "png$", "GIF")).when(F.col("size") % 2 == 0, F.upper("href")).when(F.col("size") % 5 == 0, F.concat(lit("no/"), "href")).otherwise(F.col("href"))
    return packages.find_entries(i.select("pub_id", "id", swapped.alias("path")), known).select("pub_id", "id", "path", "entry_path")


@query
def container_renditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers written from nations, one for each region."""
    n = table(spark, sf_dir, "nation")
    root = F.concat(lit('<rootfile full-path="'), F.when(F.col("n_nationkey") % 4 == 0, "").otherwise(F.concat(lit("N"), _text("n_nationkey"), lit("/c.opf"))), lit('" rendition:language="'), F.lower("n_name"), lit('"/>'))
    xml = n.groupBy(F.col("n_regionkey").alias("pub_id")).agg(F.sort_array(F.collect_list(F.struct("n_nationkey", root.alias("r")))).alias("x"))
    e = xml.select("pub_id", lit("META-INF/container.xml").alias("path"), F.concat(lit('<?xml version="1.0"?><container><rootfiles>'), F.array_join("x.r", ""), lit("</rootfiles></container>")).cast("binary").alias("content"))
    return opf.renditions(e).select("pub_id", "idx", "opf_path", "language")


@query
def encryption_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """encryption.xml written from suppliers, one for each nation."""
    s = table(spark, sf_dir, "supplier")
    uri = F.element_at(F.array(lit(crypto.IDPF_URI), lit(crypto.ADOBE_URI), lit("http://www.w3.org/2001/04/xmlenc#aes256-cbc"), lit("urn:other")), (F.col("s_suppkey") % 4 + 1).cast("int"))
    method = F.when(F.col("s_suppkey") % 5 == 0, "").otherwise(F.concat(lit('<e:EncryptionMethod Algorithm="'), uri, lit('"/>')))
    size = F.when(F.col("s_suppkey") % 3 == 0, F.concat(lit('<Compression OriginalLength="'), _text("s_suppkey"), lit('"/>'))).otherwise("")
    one = F.concat(lit("<e:EncryptedData>"), method, lit('<e:CipherData><e:CipherReference URI="OEBPS/f%20'), _text("s_suppkey"), lit('.otf"/></e:CipherData>'), size, lit("</e:EncryptedData>"))
    xml = s.groupBy(F.col("s_nationkey").alias("pub_id")).agg(F.array_join(F.collect_list(one), "").alias("x"))
    e = xml.select("pub_id", lit("META-INF/encryption.xml").alias("path"), F.concat(lit('<encryption xmlns:e="e">'), "x", lit("</encryption>")).cast("binary").alias("content"))
    return opf.encryption(e).select("pub_id", "zip_path", "algorithm", "original_length")


@query
def a11y_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "lineitem").select("l_linenumber", (F.col("l_orderkey") % 6).alias("k")).distinct()
    level = F.repeat(lit("A"), (F.col("l_linenumber") % 4).cast("int"))
    url = F.concat(F.when(F.col("l_linenumber") % 2 == 0, "https://").otherwise("http://www."), lit(a11y.PROFILE_10), F.lower(level))
    text = F.concat(lit("EPUB  Accessibility 1.1 - WCAG 2."), (F.col("k") - 2).cast("string"), lit(" Level "), level)
    p = o.withColumn("raw", F.when(F.col("k") < 2, url).otherwise(text))
    return p.select("k", "l_linenumber", "raw", a11y.normal_profile("raw").alias("profile"), a11y.profile_rank(F.coalesce(a11y.normal_profile("raw"), lit(""))).alias("rank"))


# --- text

@query
def extract_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", html.html_text("html").alias("text"))


@query
def text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = page_books(spark, sf_dir).select("pub_id", html.html_text("html").alias("text"))
    return t.groupBy("pub_id").agg(F.count("*").alias("pages"), F.sum(F.length("text")).alias("chars"), F.max(F.octet_length("text")).cast("long").alias("longest"))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = page_books(spark, sf_dir)
    each = p.select("page_id", F.posexplode(html.html_blocks("html", coords.spine_base("spine_index", "idref"))).alias("ord", "b"))
    return each.select("page_id", "ord", "b.*")


@query
def semantic_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir).select("page_id", "ord", "tag_name", "language", "cfi_range", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


@query
def blocks_by_tag_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir).groupBy("tag_name", "language").agg(F.count("*").alias("blocks"), F.sum(F.length("text")).alias("chars"))


@query
def chapter_search_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.search_chapters(page_books(spark, sf_dir), r"margin|[0-9]+")
    return hits.groupBy("pub_id", "spine_index").agg(F.count("*").alias("hits"))


@query
def book_search_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of a literal in the texts; a page's own words can't span the tags that follow them."""
    hits = search.search_books(page_books(spark, sf_dir), " EXAMPLE. ", per_chapter=1, total=4)
    return hits.groupBy("pub_id").agg(F.count("*").alias("hits"), F.min("spine_index").alias("first_chapter"), F.max("spine_index").alias("last_chapter"))


@query
def search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_books(page_books(spark, sf_dir), "the", per_chapter=3, total=10)


@query
def search_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits' coordinates alone, which SQL can derive from the pages' skeleton."""
    return search_hits(spark, sf_dir).select("pub_id", "spine_index", "hit_ord", "cfi")


@query
def property_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    page = F.when(F.col("page_id") % 3 == 0, F.concat("html", lit("<SVG></SVG>"))).when(F.col("page_id") % 3 == 1, F.replace("html", lit("<script"), lit("<math"))).otherwise(F.col("html"))
    return p.select("page_id", F.array_join(html.inferred_properties(page), " ").alias("properties"))


# --- references and rewriting

@query
def local_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = page_books(spark, sf_dir)
    return p.select("page_id", F.posexplode(html.local_references("html", lit("OEBPS/text/c.xhtml"))).alias("ord", "path"))


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph of imports in each region: nations by key, with cycles."""
    n = table(spark, sf_dir, "nation")
    a, b = n.select(F.col("n_regionkey").alias("pub_id"), F.col("n_nationkey").alias("x")), n.select(F.col("n_regionkey").alias("pub_id"), F.col("n_nationkey").alias("y"))
    near = ((F.col("y") - F.col("x")) % 7).isin(3, 4) | ((F.col("x") - F.col("y")) == 11)
    return a.join(b, "pub_id").where(near).select("pub_id", F.concat(lit("s"), _text("x"), lit(".css")).alias("path"), F.concat(lit("s"), _text("y"), lit(".css")).alias("target"))


@query
def ref_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    roots = n.groupBy(F.col("n_regionkey").alias("pub_id")).agg(F.min("n_nationkey").alias("k")).select("pub_id", lit("c1").alias("chapter"), F.concat(lit("s"), _text("k"), lit(".css")).alias("path"))
    return resolve.reference_closure(roots, _graph(spark, sf_dir))


@query
def prepare_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that refer to images and a style sheet made up from their number; some are missing, too large or of another type."""
    p = page_books(spark, sf_dir)
    k = F.col("page_id") % 4
    page = F.concat(lit("<html><head><link rel='stylesheet' href='../s.css'></head><body><img src='../a"), k.cast("string"), lit(".png'><a href='../b.xhtml'>x</a></body></html>"))
    chapters = p.select("pub_id", F.col("idref").alias("chapter"), F.concat(lit("t/"), "idref", lit(".xhtml")).alias("path"), page.alias("html"))
    files = {"s.css": "@import 'n.css'; p{b:url(a0.png)}", "n.css": "q{}", "a0.png": "png", "a1.png": "x" * 3000, "b.xhtml": "<p>", "a3.png": "ok"}
    each = F.explode(F.array(*[F.struct(lit(k).alias("path"), lit(v).cast("binary").alias("content")) for k, v in files.items()]))
    resources = p.select("pub_id").distinct().select("pub_id", each.alias("f")).select("pub_id", "f.*", lit(None).cast("string").alias("media_type"))
    out = resolve.prepare(chapters, resources, max_bytes=1000)
    return out.select("pub_id", "chapter", "stats.*", F.regexp_count("prepared", lit("data:")).cast("long").alias("data_uris"))


@query
def inject_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.md5(F.encode(html.html_inject_head("html", html.script_and_style(lit("go()"), lit("p{}"))), "UTF-8")).alias("md5"))


@query
def rewrite_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every link of a page that ends in a vowel goes to a new place."""
    p = page_books(spark, sf_dir)
    links = F.array_distinct(F.filter(html.local_references("html", lit("OEBPS/c.xhtml")), lambda x: x.rlike("[aeiou]$")))
    urls = F.map_from_arrays(links, F.transform(links, lambda x: F.concat(lit("new/"), F.length(x).cast("string"))))
    return p.select("page_id", F.md5(F.encode(html.html_rewrite("html", lit("OEBPS/c.xhtml"), urls), "UTF-8")).alias("md5"))


@query
def css_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = _text("p_partkey")
    sheet = F.concat(lit("@import 'n"), k, lit(".css'; /* url(i/x.png) */ p{background: url( ../i/"), k, lit(".png ) url(https://h/x)} q{b:url('f "), k, lit("')}"))
    urls = F.create_map(F.concat(lit("i/"), k, lit(".png")), F.concat(lit("U"), k), F.concat(lit("s/n"), k, lit(".css")), F.concat(lit("V"), k))
    return p.select("p_partkey", css.css_rewrite(sheet, lit("s/a.css"), urls).alias("css"))


@query
def cfi_annotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = page_books(spark, sf_dir)
    out = html.html_annotate("html", coords.spine_base("spine_index", "idref"))
    marks = F.regexp_extract_all(out, lit('data-cfi="([^"]*)"'), lit(1))
    return p.select("page_id", F.size(marks).alias("n"), F.try_element_at(marks, lit(1)).alias("first_cfi"), F.try_element_at(F.filter(marks, lambda m: m.contains("!/4")), lit(1)).alias("body_cfi"))


# --- reading systems

def _packages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Publications from brands: manifest, spine and folder."""
    i = _items(spark, sf_dir)
    none = F.array().cast("array<string>")
    cover = F.when((F.col("kind") == "svg") & (F.col("size") % 10 == 0), F.array(lit("cover-image"))).otherwise(none)
    items = i.select("pub_id", "doc_order", "id", "href", paths.mime_for_path("href").alias("media_type"), cover.alias("properties"), lit(None).cast("string").alias("media_overlay"), lit("OEBPS").alias("opf_dir"), "size")
    at = (F.row_number().over(W.partitionBy("pub_id").orderBy("doc_order")) - 1).cast("int")
    spine = i.where("kind = 'xhtml'").select("pub_id", at.alias("spine_index"), F.when(F.col("size") % 4 == 0, F.concat(lit("cover"), "id")).otherwise(F.col("id")).alias("idref"), (F.col("size") % 6 != 1).alias("linear"), "href", "size")
    return items, spine, items.select("pub_id", "opf_dir").distinct()


@query
def resolve_resource(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, _, dirs = _packages(spark, sf_dir)
    entries = items.where("size % 5 <> 0").select("pub_id", F.concat(lit("OEBPS/"), "href").alias("path"))
    ref = F.when(F.col("size") % 3 == 0, F.concat(lit("../"), "href")).when(F.col("size") % 3 == 1, F.concat(lit("/OEBPS/"), "href", lit("#x"))).otherwise(F.concat(lit("lost/"), paths.name_of("href")))
    refs = items.select("pub_id", lit("text/c.xhtml").alias("chapter_href"), ref.alias("ref"))
    return resolve.resolve(refs, entries, items, dirs).select("pub_id", "ref", "zip_path", "media_type")


@query
def spine_of_href(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, spine, _ = _packages(spark, sf_dir)
    asked = spine.select("pub_id", F.concat(lit("OEBPS/"), "href", lit("#part")).alias("href")).unionByName(spine.select("pub_id", F.concat(lit("other/"), paths.name_of("href")).alias("href")))
    return nav.spine_of_href(asked, spine).select("pub_id", "href", "spine_of")


@query
def reading_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, spine, _ = _packages(spark, sf_dir)
    chapters = spine.withColumn("properties", F.array().cast("array<string>"))
    firsts = spine.groupBy("pub_id").agg(F.max("href").alias("href"), F.max("spine_index").alias("n"))
    number = F.regexp_extract("pub_id", "([0-9]+)", 1).cast("int")
    marks = firsts.where(number % 3 == 0).select("pub_id", lit("landmarks").alias("list"), lit(0).alias("pre_order"), F.concat(lit("OEBPS/"), "href", lit("#x")).alias("href"), lit("epub:bodymatter").alias("role"))
    guide = firsts.where(number % 3 == 1).select("pub_id", lit(0).alias("ord"), lit("Start").alias("ref_type"), "href")
    covers = items.groupBy("pub_id").agg(F.min_by("id", "doc_order").alias("cover_id"))
    return nav.reading_start(chapters, marks, guide, covers)


@query
def cover_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, _, _ = _packages(spark, sf_dir)
    covers = items.groupBy("pub_id").agg(F.min_by("id", "doc_order").alias("c")).withColumn("cover_id", F.when(F.length("pub_id") == 8, F.col("c")))
    return nav.cover_image(items, covers)


@query
def toc_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    toc = _first_words(spark, sf_dir).withColumn("href", F.concat(lit("OEBPS/"), "href"))
    dirs = toc.select("pub_id").distinct().withColumn("opf_dir", lit("OEBPS"))
    asked = conv_books(spark, sf_dir).select("pub_id", F.when(F.col("spine_index") % 3 == 0, F.concat(lit("OEBPS/"), "href", lit("#a"))).when(F.col("spine_index") % 3 == 1, F.concat("href", lit("?q"))).otherwise(F.concat(lit("gone/"), paths.name_of("href"))).alias("href"))
    return nav.toc_titles(asked, toc, dirs).select("pub_id", "href", "title")


@query
def toc_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toc_tree(spark, sf_dir).select("node_id", "parent_id", "depth", "title", "href")


@query
def toc_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toc_tree(spark, sf_dir).groupBy("pub_id", "depth").agg(F.count("*").alias("entries"), F.countDistinct("parent_id").alias("parents"))


@query
def toc_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree as nested JSON and back."""
    back = nav.trees_from_json(nav.trees_to_json(toc_tree(spark, sf_dir)))
    return back.select("node_id", "parent_id", "depth", "title", "href")


@query
def positions_nav_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles from a toc whose hrefs are package paths, for chapters whose hrefs are relative to the package document."""
    toc = _first_words(spark, sf_dir).withColumn("href", F.concat(lit("OEBPS/"), "href"))
    chapters = conv_books(spark, sf_dir).withColumn("opf_dir", lit("OEBPS"))
    loose, exact = nav.chapter_titles(chapters, toc), nav.chapter_titles(chapters, toc, "strict")
    return loose.select("pub_id", "spine_index", "title").join(exact.select("pub_id", "spine_index", F.col("title").alias("strict_title")), ["pub_id", "spine_index"])


@query
def spine_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands whose reading order names items that the manifest lacks."""
    items, spine, _ = _packages(spark, sf_dir)
    bad = positions.missing_items(spine, items).groupBy("pub_id").agg(F.count("*").alias("missing"))
    kept = positions.strict(spine, items).groupBy("pub_id").agg(F.count("*").alias("kept"))
    return spine.groupBy("pub_id").agg(F.count("*").alias("items")).join(bad, "pub_id", "left").join(kept, "pub_id", "left").select("pub_id", "items", F.coalesce("missing", lit(0)).alias("missing"), F.coalesce("kept", lit(0)).alias("kept"))


@query
def smil_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = conv_books(spark, sf_dir)
    own = c.withColumns({"media_overlay": F.when(F.col("spine_index") % 2 == 0, F.concat(lit("ov"), _text("spine_index"))), "opf_dir": lit("OEBPS")})
    items = own.where("media_overlay is not null").select("pub_id", F.col("media_overlay").alias("id"), F.concat(lit("smil/"), "media_overlay", lit(".smil")).alias("href"), "opf_dir")
    return nav.overlay_chain(own, items)


@query
def validate_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books of customers with the orders as resources; what isn't there is reported."""
    c = table(spark, sf_dir, "customer")
    o = table(spark, sf_dir, "orders")
    books = c.select(F.col("c_custkey").alias("pub_id"), F.when(F.col("c_nationkey") % 5 != 0, F.col("c_name")).alias("title"), F.when(F.col("c_nationkey") % 3 == 0, " ").otherwise(F.col("c_mktsegment")).alias("identifier"), lit("en").alias("language"), F.when(F.col("c_nationkey") % 4 == 0, F.concat(lit("o"), _text("c_custkey"))).alias("cover_id"))
    keys = books.select("pub_id")
    at = (F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).cast("int")
    own = o.select(F.col("o_custkey").alias("pub_id"), "o_orderkey", at.alias("at"), "o_orderstatus").join(keys, "pub_id")
    name = F.concat(lit("o"), _text("o_orderkey"))
    resources = own.where("o_orderstatus <> 'F'").select("pub_id", name.alias("id"), F.concat(name, lit(".x")).alias("href"))
    spine = own.where("o_orderkey % 4 <> 0").select("pub_id", F.col("at").alias("spine_index"), name.alias("idref"))
    toc = own.where("o_orderkey % 3 = 0").select("pub_id", F.col("at").alias("node_id"), name.alias("title"), F.concat(name, lit(".x#f")).alias("href"))
    return generate.validate(books, resources, spine, toc)


@query
def corpus_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = page_books(spark, sf_dir)
    outcome = F.when(F.col("html").contains("</body></html>"), "ok").when(F.col("page_id") % 2 == 0, "retry").otherwise("fail")
    return search.corpus_audit(p.select("pub_id", outcome.alias("outcome")))


# --- keys, masks, times

@query
def idpf_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", F.lower(F.hex(crypto.idpf_key(F.concat(lit("urn: "), "c_name", lit("\t\n"), "c_mktsegment")))).alias("key"))


@query
def adobe_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.md5(F.col("c_name").cast("binary"))
    uuid = F.concat(lit("urn:uuid:"), F.substring(m, 1, 8), lit("-"), F.substring(m, 9, 24))
    broken = F.when(F.col("c_custkey") % 4 == 0, F.substring(uuid, 1, 30)).otherwise(uuid)
    return table(spark, sf_dir, "customer").select("c_custkey", F.lower(F.hex(crypto.adobe_key(broken))).alias("key"))


@query
def deobfuscate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked and unmasked again: the bytes are as before, and in between only the head differs."""
    c = conv_books(spark, sf_dir)
    algorithm = F.element_at(F.array(lit("idpf"), lit("adobe"), lit("aes_cbc")), (F.col("spine_index") % 3 + 1).cast("int"))
    rows = c.select("pub_id", "spine_index", F.encode("body", "UTF-8").alias("raw"), algorithm.alias("algorithm"), F.concat(lit("id "), _text("pub_id")).alias("identifier"))
    masked = rows.withColumn("masked", crypto.deobfuscate("raw", "identifier", "algorithm"))
    back = crypto.deobfuscate("masked", "identifier", "algorithm")
    head = F.when(F.col("algorithm") == "idpf", crypto.MASKED["idpf"]).otherwise(crypto.MASKED["adobe"])
    tail = lambda x: F.substr(F.col(x), head + 1, lit(2_000_000))
    return masked.select("pub_id", "spine_index", F.md5(back).alias("md5"), F.octet_length("masked").cast("long").alias("length"), (tail("raw") == tail("masked")).alias("tail_same"))


@query
def clock_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q"))
    q = F.col("q")
    text = F.element_at(
        F.array(F.format_string("%d:%02d:%02d.5", q, q, q), F.format_string("%02d:%02d", q, q), F.format_string("%dms", q), F.format_string("%d.25min", q), F.format_string("%dh", q), F.format_string(" %ds ", q), F.format_string("%dx", q)), F.col("l_linenumber")
    )
    seconds = media.clock_seconds(text)
    return l.select("l_orderkey", "l_linenumber", seconds.alias("seconds"), media.media_fragment(lit("a.mp3"), lit(None).cast("double"), seconds).alias("fragment"))


# --- as a stream

@query
def stream_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position counts of chapters that arrive as a stream; all that is there is read once."""
    from ..streaming.ingest import chapter_counts, run_available

    conversations = table(spark, sf_dir, "conversations")
    return run_available(spark, conversations.schema, f"{sf_dir}/conversations.parquet", lambda s: chapter_counts(s.select(F.col("conv_id").alias("pub_id"), F.col("turn").cast("int").alias("spine_index"), (F.col("role") != "system").alias("linear"), F.octet_length("text").cast("long").alias("length"))))
