"""Queries over documents that are written from the driver's tables as text (package documents, NCX, SMIL, pages) and read
by the operators, with the same in DuckDB SQL. They cover what publications made by our own writer never hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coords, crypto
from ..functions.types import lit
from ..operators import generate, html, nav, opf, resolve, search
from ..sources import packages
from .corpus import conv_books, page_books, table
from .oracle import _CONV, _MASKED, _PAGES
from .queries import Query

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return register


def _s(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _cat(*parts: str | Column) -> Column:
    """Texts and columns in a row; a text is itself, a column's name is not taken."""
    return F.concat(*[lit(p) if isinstance(p, str) else p for p in parts])


# --- package documents: a book for each customer

def _opf(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k, n, name, segment = _s("c_custkey"), F.col("c_nationkey"), F.col("c_name"), F.col("c_mktsegment")
    some = lambda test, *parts: F.when(test, _cat(*parts)).otherwise(lit(""))
    meta = [
        some(n % 4 != 3, '<dc:title id="t2">on ', segment, '</dc:title><meta refines="#t2" property="title-type">subtitle</meta>'),
        _cat('<dc:title id="t1" xml:lang="en"> ', name, ' &amp; Co </dc:title><meta refines="#t1" property="title-type">main</meta>'),
        some(n % 3 == 0, '<meta refines="#t1" property="file-as">', k, " Co</meta>"),
        _cat('<dc:creator id="a">A', k, '</dc:creator><dc:contributor id="b">B', k, "</dc:contributor>"),
        some(n % 2 == 0, '<meta refines="#a" property="role" scheme="marc:relators">aut</meta><meta refines="#b" property="file-as">', segment, "</meta>"),
        _cat('<dc:identifier id="isbn" scheme="ISBN">978', k, '</dc:identifier><dc:identifier id="uid">urn:c:', k, "</dc:identifier>"),
        some(n % 5 == 0, '<dc:identifier id="x">x', k, '</dc:identifier><meta refines="#x" property="identifier-type" scheme="onix:codelist5">15</meta>'),
        _cat("<dc:language>fr</dc:language><dc:publisher>first</dc:publisher><dc:publisher>P ", segment, "</dc:publisher><dc:description>d", k, "</dc:description>"),
        some(n % 2 == 1, "<dc:rights>r", k, "</dc:rights><dc:date>1999</dc:date>"),
        some(n % 3 == 1, '<dc:date opf:event="modification">2001</dc:date><meta property="dcterms:modified">2002</meta>'),
        some(n % 4 == 1, '<meta property="rendition:layout">pre-paginated</meta>'),
        some(n % 4 == 2, '<meta name="cover" content="img', k, '"/>'),
        some(n % 6 == 0, '<meta property="media:duration">0:01:0', _s(n % 10), '</meta><meta property="media:narrator">N', k, "</meta>"),
        some(n % 5 == 1, '<meta property="dcterms:conformsTo" id="w">EPUB  Accessibility 1.1 - WCAG 2.', _s(n % 3), ' Level AA</meta><meta property="a11y:certifiedBy" refines="#w">C', k, "</meta>"),
        some(n % 5 == 2, '<meta property="schema:accessMode">textual</meta><meta property="schema:accessModeSufficient">textual, visual</meta><meta property="schema:accessibilitySummary">s', k, "</meta>"),
    ]
    items = _cat('<item id="i', k, '" href="a%20b/c', k, '.xhtml" media-type="application/xhtml+xml"', some(n % 7 == 0, ' media-overlay="ov"'), '/><item id="last" href="d.xhtml" media-type="application/xhtml+xml" properties="svg  scripted"></item><item id="none"/>')
    spine = _cat("<spine", some(n % 3 == 2, ' page-progression-direction="rtl"'), some(n % 2 == 0, ' toc="ncx', k, '"'), '><itemref idref="i', k, '" properties="', some(n % 2 == 0, "rendition:layout-pre-paginated "), 'page-spread-left"/><itemref idref="last" linear="no" properties="rendition:page-spread-center"/></spine>')
    marks = _cat('<guide><reference type="', F.when(n % 2 == 0, "text").otherwise("cover"), '" href="a%20b/c', k, '.xhtml#s" title="', segment, '"/><reference type="" href="x"/></guide>')
    text = F.concat(lit('<?xml version="1.0"?><package version="3.0" unique-identifier="uid"><metadata xmlns:dc="d">'), *meta, lit("</metadata><manifest>"), items, lit("</manifest>"), spine, marks, lit("</package>"))
    return c.select(F.col("c_custkey").alias("pub_id"), lit("OEBPS/content.opf").alias("path"), F.encode(text, "UTF-8").alias("content"))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _opf(spark, sf_dir)
    return opf.packages(e, e.select("pub_id", F.col("path").alias("opf_path")))


def _metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return opf.metadata(_packed(spark, sf_dir))


_CUSTOMER = "c AS (SELECT c_custkey AS k, c_nationkey AS n, c_name AS name, c_mktsegment AS seg FROM customer)"


@query(f"WITH {_CUSTOMER} SELECT k AS pub_id, name || ' & Co' AS title, CASE WHEN n % 4 <> 3 THEN 'on ' || seg END AS subtitle, CASE WHEN n % 3 = 0 THEN k || ' Co' END AS sort_as, 'fr' AS language FROM c")
def opf_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metadata(spark, sf_dir).select("pub_id", "title", "subtitle", "sort_as", "language")


@query(f"WITH {_CUSTOMER} SELECT k AS pub_id, 0 AS ord, 'A' || k AS name, CASE WHEN n % 2 = 0 THEN 'aut' END AS role, NULL::VARCHAR AS file_as FROM c UNION ALL SELECT k, 1, 'B' || k, NULL, CASE WHEN n % 2 = 0 THEN seg END FROM c")
def opf_creators(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _metadata(spark, sf_dir).select("pub_id", F.posexplode("creators").alias("ord", "p"))
    return each.select("pub_id", "ord", "p.name", "p.role", "p.file_as")


@query(f"WITH {_CUSTOMER} SELECT k AS pub_id, 'urn:c:' || k AS identifier, '978' || k AS value, 'ISBN' AS scheme FROM c UNION ALL SELECT k, 'urn:c:' || k, 'x' || k, 'onix:codelist5' FROM c WHERE n % 5 = 0")
def opf_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _metadata(spark, sf_dir).select("pub_id", "identifier", F.explode("alt_identifiers").alias("a"))
    return each.select("pub_id", "identifier", "a.value", "a.scheme")


@query(
    f"WITH {_CUSTOMER} SELECT k AS pub_id, 'P ' || seg AS publisher, 'd' || k AS description, CASE WHEN n % 2 = 1 THEN 'r' || k END AS rights, CASE WHEN n % 2 = 1 THEN '1999' END AS date, CASE WHEN n % 3 = 1 THEN '2002' END AS modified, CASE WHEN n % 4 = 1 THEN 'pre-paginated' ELSE 'reflowable' END AS layout, CASE WHEN n % 4 = 2 THEN 'img' || k END AS cover_id, CASE WHEN n % 2 = 0 THEN 'ncx' || k END AS toc_id, CASE WHEN n % 3 = 2 THEN 'rtl' ELSE 'default' END AS reading_progression FROM c"
)
def opf_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metadata(spark, sf_dir).select("pub_id", "publisher", "description", "rights", "date", "modified", "layout", "cover_id", "toc_id", "reading_progression")


@query(
    f"WITH {_CUSTOMER} SELECT k AS pub_id, CASE WHEN n % 5 = 1 THEN 'EPUB Accessibility 1.1 - WCAG 2.' || (n % 3) || ' Level AA' ELSE '' END AS conforms_to, CASE WHEN n % 5 = 1 THEN 'C' || k END AS certified_by, CASE WHEN n % 5 = 2 THEN 's' || k END AS summary, CASE WHEN n % 5 = 2 THEN 2 ELSE 0 END AS sufficient FROM c WHERE n % 5 IN (1, 2)"
)
def opf_accessibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _metadata(spark, sf_dir).where("accessibility is not null").select("pub_id", "accessibility.*")
    return a.select("pub_id", F.array_join("conforms_to", " | ").alias("conforms_to"), F.col("certification.certified_by").alias("certified_by"), "summary", F.size(F.flatten(F.coalesce("access_modes_sufficient", F.array(F.array().cast("array<string>"))))).alias("sufficient"))


@query(f"WITH {_CUSTOMER} SELECT k AS pub_id, (60 + n % 10)::DOUBLE AS total_duration, 'N' || k AS narrators, n % 7 = 0 AS has_media_overlays FROM c WHERE n % 6 = 0")
def opf_overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _metadata(spark, sf_dir).where("media_overlays is not null").select("pub_id", "media_overlays.total_duration", F.array_join("media_overlays.narrators", ", ").alias("narrators"))
    return m.join(opf.has_overlays(opf.manifest(_packed(spark, sf_dir))), "pub_id")


@query(f"WITH {_CUSTOMER} SELECT k AS pub_id, 0 AS ord, CASE WHEN n % 2 = 0 THEN 'text' ELSE 'cover' END AS ref_type, 'OEBPS/a b/c' || k || '.xhtml#s' AS href, seg AS title FROM c")
def opf_guide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return opf.guide(_packed(spark, sf_dir))


@query(f"WITH {_CUSTOMER} SELECT k AS pub_id, 0 AS spine_index, 'i' || k AS idref, true AS linear, CASE WHEN n % 2 = 0 THEN 'pre-paginated' END AS layout_override, 'left' AS page_spread, 'a b/c' || k || '.xhtml' AS href FROM c UNION ALL SELECT k, 1, 'last', false, NULL, 'center', 'd.xhtml' FROM c")
def opf_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _packed(spark, sf_dir)
    return nav.spine_items(opf.spine(p), opf.manifest(p)).select("pub_id", "spine_index", "idref", "linear", "layout_override", "page_spread", "href")


# --- containers

def _containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A container for each customer: with two rootfiles, one, none that counts, or not well-formed."""
    c = table(spark, sf_dir, "customer")
    n = F.col("c_nationkey") % 4
    root = lambda x: _cat('<rootfile full-path="', x, _s("c_custkey"), '.opf"/>')
    body = F.when(n == 0, F.concat(root("a"), root("b"))).when(n == 1, root("a")).when(n == 2, '<rootfile full-path=""/>').otherwise("<rootfile")
    return c.select(F.col("c_custkey").alias("pub_id"), lit(opf.CONTAINER).alias("path"), F.encode(_cat("<container><rootfiles>", body, "</rootfiles></container>"), "UTF-8").alias("content"))


@query("SELECT c_custkey AS pub_id, CASE c_nationkey % 4 WHEN 2 THEN 'invalid_format' ELSE 'xml' END AS kind FROM customer WHERE c_nationkey % 4 IN (2, 3) UNION ALL SELECT -1, 'missing_container'")
def container_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _containers(spark, sf_dir)
    pubs = e.select("pub_id").unionByName(spark.range(1).select(lit(-1).cast("long").alias("pub_id")))
    return opf.container_errors(pubs, e).select("pub_id", "kind")


@query(
    "SELECT c_custkey AS pub_id, CASE WHEN c_nationkey % 4 < 2 THEN 'a' || c_custkey || '.opf' END AS first_opf, CASE WHEN c_nationkey % 4 = 0 THEN 'b' || c_custkey || '.opf' END AS second_opf, CASE WHEN c_nationkey % 4 <> 0 THEN 'no rendition 1' END AS error FROM customer"
)
def rendition_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _containers(spark, sf_dir)
    found = opf.renditions(e)
    first, second = opf.rendition_at(e, found), opf.rendition_at(e, found, 1)
    return first.select("pub_id", F.col("opf_path").alias("first_opf")).join(second.select("pub_id", F.col("opf_path").alias("second_opf"), "error"), "pub_id")


# --- NCX and overlays: a book for each conversation

@query(
    f"WITH {_CONV} SELECT pub_id, 'toc' AS list, spine_index AS node_id, CASE WHEN spine_index % 2 = 1 THEN spine_index - 1 END AS parent_id, spine_index % 2 AS depth, 'T ' || spine_index || ' <' || CASE WHEN linear THEN 'a' ELSE 'b' END || '>' AS title, 'text/c ' || spine_index || '.xhtml#x' AS href FROM conv"
)
def ncx_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even turns are entries, odd ones below them; the spine names the NCX and no item has the property nav."""
    c = conv_books(spark, sf_dir)
    i, odd = _s("spine_index"), F.col("spine_index") % 2 == 1
    inner = _cat('<navPoint id="p', i, '"><navLabel><text> T ', i, " &lt;", F.when(F.col("linear"), "a").otherwise("b"), '&gt; </text></navLabel><content src="text/c%20', i, '.xhtml#x"/>')
    point = F.concat(inner, F.when(odd, "</navPoint></navPoint>").otherwise(F.when(F.col("spine_index") == F.col("last"), "</navPoint>").otherwise("")))
    last = c.groupBy("pub_id").agg(F.max("spine_index").alias("last"))
    xml = c.join(last, "pub_id").groupBy("pub_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("spine_index", point.alias("x"))))["x"], "").alias("x"))
    entries = xml.select("pub_id", lit("OEBPS/toc.ncx").alias("path"), F.encode(_cat("<ncx><navMap>", F.col("x"), "</navMap></ncx>"), "UTF-8").alias("content"))
    items = xml.select("pub_id", lit(0).alias("doc_order"), lit("ncx").alias("id"), lit("toc.ncx").alias("href"), F.array().cast("array<string>").alias("properties"), lit("OEBPS").alias("opf_dir"))
    return nav.navigation(entries, items, xml.select("pub_id", lit("ncx").alias("toc_id"))).select("pub_id", "list", "node_id", "parent_id", "depth", "title", "href")


@query(
    f"WITH {_CONV} SELECT pub_id, 0 AS node_id, NULL::INT AS parent_id, 'seq' AS kind, 'OEBPS/text/c.xhtml' AS text_ref, NULL AS audio_ref, 'chapter' AS role FROM conv GROUP BY pub_id UNION ALL SELECT pub_id, spine_index + 1, 0, 'par', 'OEBPS/text/ch' || spine_index || '.xhtml#p', 'OEBPS/a/' || spine_index || '.mp3#t=' || printf('%.3f', spine_index * 1.5) || ',' || printf('%.3f', spine_index * 1.5 + 60), '' FROM conv"
)
def smil_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One overlay for each conversation: a seq with a par for each turn."""
    c = conv_books(spark, sf_dir)
    i = _s("spine_index")
    begin = F.format_string("%.1fs", F.col("spine_index") * 1.5)
    end = F.format_string("%d:%04.1f", F.floor((F.col("spine_index") * 1.5 + 60) / 60).cast("int"), (F.col("spine_index") * 1.5 + 60) % 60)
    par = _cat('<par><text src="../text/ch', i, '.xhtml#p"/><audio src="../a/', i, '.mp3" clipBegin="', begin, '" clipEnd="', end, '"/></par><par/>')
    xml = c.groupBy("pub_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("spine_index", par.alias("x"))))["x"], "").alias("x"))
    entries = xml.select("pub_id", lit("OEBPS/ov/c.smil").alias("path"), F.encode(_cat('<smil><body><seq epub:textref="../text/c.xhtml" epub:type="chapter">', F.col("x"), "</seq></body></smil>"), "UTF-8").alias("content"))
    found = nav.overlays(entries, entries.select("pub_id", F.col("path").alias("smil_path")))
    return found.select("pub_id", "node_id", "parent_id", "kind", "text_ref", "audio_ref", F.array_join("role", " ").alias("role"))


# --- resources: masked, rewritten, imported

@query(
    f"WITH {_CONV} SELECT pub_id, 'OEBPS/f' || spine_index || '.otf' AS zip_path, CASE spine_index % 4 WHEN 2 THEN md5(reverse(body)) ELSE md5(body) END AS md5 FROM conv"
)
def read_encrypted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resources read with their encryption: masked fonts come back plain, others go through the hook, which reverses them; without an entry they are plain."""
    c = conv_books(spark, sf_dir)
    k = F.col("spine_index") % 4
    path = _cat("OEBPS/f", _s("spine_index"), ".otf")
    uri = F.when(k == 0, crypto.IDPF_URI).when(k == 1, crypto.ADOBE_URI).when(k == 2, "http://www.w3.org/2001/04/xmlenc#aes256-cbc")
    own = c.select("pub_id", path.alias("path"), uri.alias("uri"), F.encode("body", "UTF-8").alias("raw"), _cat("urn:uuid:", F.md5(_s("pub_id").cast("binary"))).alias("identifier"))
    algorithm = crypto.algorithm_of(F.coalesce("uri", lit("")))
    entries = own.select("pub_id", "path", F.when(F.col("uri").isNull(), F.col("raw")).otherwise(crypto.deobfuscate("raw", "identifier", algorithm)).alias("content"))
    one = _cat('<EncryptedData><EncryptionMethod Algorithm="', F.col("uri"), '"/><CipherData><CipherReference URI="', F.col("path"), '"/></CipherData></EncryptedData>')
    xml = own.where("uri is not null").groupBy("pub_id").agg(F.array_join(F.collect_list(one), "").alias("x"))
    known = opf.encryption(xml.select("pub_id", lit(opf.ENCRYPTION).alias("path"), F.encode(_cat("<encryption>", F.col("x"), "</encryption>"), "UTF-8").alias("content")))
    hook = lambda content: F.encode(F.reverse(F.decode(content, "UTF-8")), "UTF-8")
    read = resolve.read(entries.select("pub_id", F.col("path").alias("zip_path")), entries, known, own.select("pub_id", "identifier").distinct(), hook)
    return read.select("pub_id", "zip_path", F.md5("content").alias("md5"))


@query(
    "WITH p AS (SELECT p_partkey AS k, p_size AS z FROM part) SELECT k, '<img srcset=\"N' || k || ' 1x, ../j/' || z || '.png 2x\" src=\"N' || k || '\"><style>p{background:url(\"N' || k || '\")} /* url(../i/' || k || '.png) */</style><p style=\"x:url(&quot;N' || k || '&quot;)\">url(../i/' || k || '.png)</p>' AS rewritten, "
    "'<img src=\"L' || k || '\"><a href=x>y</a><link href=\"L' || k || '\">' AS linked, CASE WHEN z % 2 = 0 THEN '<style type=\"text/css\">' || chr(10) || 'p{x:' || k || '}' || chr(10) || '</style>' ELSE '' END || '<link rel=\"icon\" href=\"data:image/png,x\">' AS promoted FROM p"
)
def rewrite_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source sets, style blocks and style attributes; plain links; sheets in data URIs."""
    p = table(spark, sf_dir, "part")
    k, z = _s("p_partkey"), _s("p_size")
    page = _cat('<img srcset="../i/', k, ".png 1x, ../j/", z, '.png 2x" src=\'../i/', k, ".png'><style>p{background:url( ../i/", k, ".png )} /* url(../i/", k, '.png) */</style><p style="x:url(../i/', k, '.png)">url(../i/', k, ".png)</p>")
    urls = F.create_map(_cat("OEBPS/i/", k, ".png"), _cat("N", k))
    plain = _cat("<img src=", k, "><a href=x>y</a><link href='", k, "'>")
    sheet = F.when(F.col("p_size") % 2 == 0, _cat("data:text/css,p%7Bx:", k, "%7D")).otherwise("data:text/css,")
    linked = _cat('<link rel="stylesheet" href="', sheet, '"><link rel="icon" href="data:image/png,x">')
    return p.select(F.col("p_partkey").alias("k"), html.html_rewrite(page, lit("OEBPS/t/c.xhtml"), urls).alias("rewritten"), html.html_rewrite_links(plain, F.create_map(k, _cat("L", k))).alias("linked"), html.html_promote_styles(linked).alias("promoted"))


@query(
    f"WITH {_PAGES} SELECT pub_id, idref AS id, '<img src=\"../images/a' || (page_id % 3) || '.png\"><link href=\"../styles/s.css\"><img src=''http://h/x.png''>' AS html FROM pb"
)
def import_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, files = _imported(spark, sf_dir)
    return generate.import_pages(pages, files)[0].select("pub_id", "id", "html")


@query(
    f"WITH {_PAGES}, f AS (SELECT DISTINCT pub_id, page_id % 3 AS m FROM pb) SELECT pub_id, 'pics_a' || m || '_png' AS id, 'images/a' || m || '.png' AS href, 'image/jpeg' AS media_type, 'P' || m AS content FROM f WHERE m < 2 UNION ALL SELECT DISTINCT pub_id, 's_css', 'styles/s.css', 'text/css', 'S' FROM f"
)
def import_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assets that the pages name and the folder has."""
    pages, files = _imported(spark, sf_dir)
    return generate.import_pages(pages, files)[1].select("pub_id", "id", "href", "media_type", _s("content").alias("content"))


def _imported(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = page_books(spark, sf_dir)
    page = _cat("<img src='pics/a", _s(F.col("page_id") % 3), ".png'><link href=\"s.css\"><img src='http://h/x.png'>")
    files = spark.createDataFrame([("in/pics/a0.png", b"P0"), ("in/pics/a1.png", b"P1"), ("in/s.css", b"S")], "path string, content binary")
    return p.select("pub_id", F.col("idref").alias("id"), lit("in/page.html").alias("path"), page.alias("html")), files


# --- search and coordinates

@query(rf"WITH {_PAGES}, t AS (SELECT pub_id, spine_index, len(string_split(regexp_replace(html, '(?s)<!--.*?-->|<[^>]*>', chr(1), 'g'), 'margin')) - 1 AS hits FROM pb) SELECT pub_id, spine_index, hits FROM t WHERE hits > 0")
def search_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.search_literal(page_books(spark, sf_dir), "margin")
    return hits.groupBy("pub_id", "spine_index").agg(F.count("*").alias("hits"))


_CFI_PARTS = "l AS (SELECT l_orderkey AS k, l_linenumber AS n, l_quantity::INT AS q FROM lineitem)"


def _terminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates with escaped assertions and every kind of end: offsets, sides, times, places, ranges. Assertions come back unescaped."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("int").alias("q"))
    k, q = _s(F.col("k") % 50 * 2), _s("q")
    ends = {1: _cat("/3:", q), 2: _cat("/1:", q, ":before"), 3: _cat("~", q, ".5"), 4: _cat("@", q, ":7"), 5: _cat("~", q, "@50:", q), 6: _cat(",/1:", q, ",/3:9")}
    end = F.element_at(F.create_map(*[x for i, e in ends.items() for x in (lit(i), e)]), F.col("n"))
    return l.select("k", "n", "q", _cat("epubcfi(/6/", k, "[c^^", q, "^,x]!/4[b]/10", F.coalesce(end, lit("")), ")").alias("cfi"))


@query(
    f"WITH {_CFI_PARTS} SELECT k, n, q, CASE WHEN n = 6 THEN 'range' ELSE 'point' END AS kind, 'c^' || q || ',x' AS assertion, CASE WHEN n IN (1, 2) THEN q::BIGINT END AS char_offset, CASE WHEN n = 6 THEN q::BIGINT END AS range_start FROM l"
)
def cfi_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _terminated(spark, sf_dir).withColumn("c", coords.cfi_parse("cfi"))
    return p.select("k", "n", "q", "c.kind", F.col("c.parent.steps")[1]["assertion"].alias("assertion"), F.col("c.parent.char_offset").cast("long").alias("char_offset"), F.col("c.start.char_offset").cast("long").alias("range_start"))


@query(
    f"""WITH {_CFI_PARTS} SELECT k, n, q, 'epubcfi(/6/' || (k % 50 * 2) || '[c^' || q || ',x]!/4[b]/10' || CASE n WHEN 1 THEN '/3:' || q WHEN 2 THEN '/1:' || q || ':before' WHEN 3 THEN '~' || q || '.5' WHEN 4 THEN '@' || q || ':7' WHEN 5 THEN '~' || q || '@50:' || q WHEN 6 THEN ',/1:' || q || ',/3:9' ELSE '' END || ')' AS again FROM l"""
)
def cfi_roundtrip_termini(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _terminated(spark, sf_dir).select("k", "n", "q", coords.cfi_text(coords.cfi_parse("cfi")).alias("again"))


# --- packages with a theme, a cover, a fixed layout and an NCX

@query(
    f"""WITH {_CONV}, n AS (SELECT pub_id, count(*) AS n FROM conv GROUP BY 1),
f AS (SELECT pub_id, 'OEBPS/text/ch' || spine_index || '.xhtml' AS path, '<html><head><link rel="stylesheet" type="text/css" href="../{generate.THEME_HREF}"/></head><body><p>' || {_MASKED} || '</p></body></html>' AS t FROM conv
UNION ALL SELECT pub_id, 'OEBPS/{generate.THEME_HREF}', 'p{{x:' || pub_id || '}}' FROM n UNION ALL SELECT pub_id, 'OEBPS/img/cover.png', 'PNG' || pub_id FROM n)
SELECT pub_id, path, md5(t) AS md5, strlen(t)::BIGINT AS length FROM f"""
)
def epub_roundtrip_theme(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = packages.entries(_themed(spark, sf_dir))
    kept = e.where("path like 'OEBPS/text/%' or path like 'OEBPS/styles/%' or path like 'OEBPS/img/%'")
    return kept.select(F.col("pub_id").cast("long").alias("pub_id"), "path", F.md5("content").alias("md5"), "length")


@query(f"WITH {_CONV} SELECT pub_id, spine_index AS node_id, 'Turn ' || spine_index AS title, href FROM conv")
def epub_roundtrip_ncx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The NCX of each archive, read by itself."""
    e = packages.entries(_themed(spark, sf_dir), names=["OEBPS/toc.ncx"])
    each = e.select(F.col("pub_id").cast("long").alias("pub_id"), F.explode(nav.xml_ncx_nodes("content")).alias("n"))
    return each.select("pub_id", "n.node_id", "n.title", "n.href")


@query(
    f"WITH {_CONV} SELECT pub_id, spine_index, CASE WHEN spine_index % 2 = 0 THEN 'pre-paginated' END AS layout_override, CASE WHEN spine_index % 2 = 0 THEN 'left' END AS page_spread, 'cover-image' AS cover, 'pre-paginated' AS layout FROM conv"
)
def epub_roundtrip_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = packages.entries(_themed(spark, sf_dir), names=["OEBPS/content.opf"]).withColumn("pub_id", F.col("pub_id").cast("long"))
    p = opf.packages(e, e.select("pub_id", F.col("path").alias("opf_path")))
    covers = nav.cover_image(opf.manifest(p), opf.metadata(p).select("pub_id", "cover_id"))
    m = opf.metadata(p).select("pub_id", "layout").join(covers.select("pub_id", F.col("id").alias("cover")), "pub_id")
    return opf.spine(p).select("pub_id", "spine_index", "layout_override", "page_spread").join(m, "pub_id")


def _themed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = conv_books(spark, sf_dir)
    page = _cat("<html><head></head><body><p>", F.replace(F.replace("body", lit("&"), lit("&amp;")), lit("<"), lit("&lt;")), "</p></body></html>")
    even = F.col("spine_index") % 2 == 0
    chapters = c.select("pub_id", "spine_index", F.col("idref").alias("id"), "href", page.alias("html"), "linear", F.when(even, "pre-paginated").alias("layout_override"), F.when(even, "left").alias("page_spread"))
    books = c.select("pub_id").distinct().select("pub_id", lit("3.0").alias("version"), lit("t").alias("title"), _cat("urn:conv:", _s("pub_id")).alias("identifier"), lit("en").alias("language"), lit("pre-paginated").alias("layout"), lit("cover-image").alias("cover_id"), _cat("p{x:", _s("pub_id"), "}").alias("theme_css"))
    resources, order = generate.chapter_rows(chapters)
    cover = generate.cover_row(books.select("pub_id", lit("img/cover.png").alias("href"), lit("image/png").alias("media_type"), F.encode(_cat("PNG", _s("pub_id")), "UTF-8").alias("content")))
    toc = c.select("pub_id", F.col("spine_index").alias("node_id"), lit(None).cast("int").alias("parent_id"), _cat("Turn ", _s("spine_index")).alias("title"), "href")
    return generate.build(books, resources.unionByName(cover), order, toc, modified=lit("2024-01-01T00:00:00Z"))
