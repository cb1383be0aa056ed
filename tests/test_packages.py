import base64
import io
import re
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from pagespan.operators import generate, nav, opf, positions, resolve, search
from pagespan.sources import packages

OPF = """<?xml version="1.0"?>
<package version="3.0" unique-identifier="uid" xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">
<dc:title id="t2">The Sub</dc:title><meta refines="#t2" property="title-type">subtitle</meta><meta refines="#t2" property="display-seq">2</meta>
<dc:title id="t1" xml:lang="en">Main &amp; Co</dc:title><meta refines="#t1" property="title-type">main</meta><meta refines="#t1" property="file-as">Co, Main</meta>
<dc:creator id="c1">Ann</dc:creator><dc:contributor>Bob</dc:contributor><meta refines="#c1" property="role" scheme="marc:relators">aut</meta>
<dc:language>ar-EG</dc:language><dc:language>en</dc:language>
<dc:identifier id="isbn" opf:scheme="ISBN">123</dc:identifier><dc:identifier id="uid">urn:uuid:1</dc:identifier><dc:identifier id="x">9</dc:identifier><meta refines="#x" property="identifier-type" scheme="onix:codelist5">15</meta>
<dc:publisher>P1</dc:publisher><dc:publisher>P2</dc:publisher><dc:subject>s1</dc:subject><dc:subject>s2</dc:subject><dc:date>2001</dc:date><dc:date opf:event="modification">2002</dc:date>
<meta property="rendition:layout">pre-paginated</meta><meta property="belongs-to-collection" id="col">Saga</meta><meta refines="#col" property="group-position">2.5</meta>
<meta property="media:duration">0:01:00</meta><meta property="media:duration" refines="#ov">30s</meta><meta property="media:narrator">Nan</meta>
<meta property="dcterms:conformsTo" id="conf">EPUB Accessibility 1.1 - WCAG 2.1 Level AA</meta><meta property="a11y:certifiedBy" refines="#conf" id="cert">Cert Inc</meta><meta property="a11y:certifierReport" refines="#cert">http://r</meta>
<meta property="schema:accessMode">textual</meta><meta property="schema:accessModeSufficient">textual, visual</meta><meta property="schema:accessibilityFeature">index</meta>
<meta name="cover" content="img"/></metadata>
<manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="c1" href="text/ch%201.xhtml" media-type="application/xhtml+xml" media-overlay="ov"></item><item id="c2" href="text/ch2.xhtml" media-type="application/xhtml+xml" properties="svg  scripted"/>
<item id="img" href="img/cover.png" media-type="image/png"/><item id="css" href="css/a.css" media-type="text/css"/><item id="css2" href="css/b.css" media-type="text/css"/><item id="ov" href="ov/c1.smil" media-type="application/smil+xml"/><item id="" href="x"/></manifest>
<spine toc="ncx" page-progression-direction="rtl"><itemref idref="cv" linear="no"/><itemref idref="c1" properties="rendition:layout-reflowable page-spread-left"/><itemref idref="c2" linear="yes" properties="page-spread-center"/></spine>
<guide><reference type="text" href="text/ch2.xhtml#s" title="Start"/></guide></package>"""
NAV = """<html xmlns:epub="x"><body><nav epub:type="toc"><h1>T</h1><ol><li><a href="text/ch%201.xhtml">One</a><ol><li><a href="text/ch%201.xhtml#s">One.1</a></li></ol></li><li><span>none</span></li><li><a href="text/ch2.xhtml">Two</a></li></ol></nav>
<nav epub:type="landmarks"><ol><li><a epub:type="bodymatter" href="text/ch2.xhtml">Begin</a></li></ol></nav><nav epub:type="page-list"><ol><li><a href="text/ch2.xhtml#p1">1</a></li></ol></nav></body></html>"""
SMIL = """<smil xmlns:epub="e"><body><seq epub:textref="../text/ch%201.xhtml" epub:type="chapter part"><par><text src="../text/ch%201.xhtml#p1"/><audio src="../a/1.mp3" clipBegin="0s" clipEnd="3.45s"/></par><par/><par><text src=""/></par></seq></body></smil>"""
ENC = """<encryption xmlns="u"><enc:EncryptedData xmlns:enc="e"><enc:EncryptionMethod Algorithm="http://www.idpf.org/2008/embedding"/><enc:CipherData><enc:CipherReference URI="OEBPS/font%201.otf"/></enc:CipherData></enc:EncryptedData>
<enc:EncryptedData xmlns:enc="e"><enc:EncryptionMethod Algorithm="http://www.w3.org/2001/04/xmlenc#aes128-cbc"/><enc:CipherData><enc:CipherReference URI="OEBPS/c.x"/></enc:CipherData><enc:EncryptionProperties><Compression OriginalLength="42"/></enc:EncryptionProperties></enc:EncryptedData>
<enc:EncryptedData xmlns:enc="e"><enc:CipherData><enc:CipherReference URI="OEBPS/none"/></enc:CipherData></enc:EncryptedData></encryption>"""
CONTAINER = """<?xml version="1.0"?><container xmlns="c"><rootfiles><rootfile full-path="OEBPS/content.opf" rendition:layout="pre-paginated"/><rootfile full-path=""/><rootfile full-path="B/b.opf" rendition:language="fr"/><rootfile full-path="C/c.opf" language="fr"/></rootfiles></container>"""
PAGE = "<html><head><link rel='stylesheet' href='../css/a.css'></head><body><p>Whale <img src='../img/cover.png'> <img src='../img/none.png'> whale</p></body></html>"
FILES = {
    "mimetype": "application/epub+zip", "META-INF/container.xml": CONTAINER, "META-INF/encryption.xml": ENC, "OEBPS/content.opf": OPF, "OEBPS/nav.xhtml": NAV, "OEBPS/text/ch 1.xhtml": PAGE, "OEBPS/text/ch2.xhtml": PAGE * 30,
    "OEBPS/img/cover.png": "PNG", "OEBPS/css/a.css": "@import 'b.css'; p{background:url(../img/cover.png)}", "OEBPS/css/b.css": "q{}", "OEBPS/ov/c1.smil": SMIL,
}


def archive(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


@pytest.fixture(scope="module")
def entries(spark):
    df = spark.createDataFrame([("b", archive(FILES)), ("bad", b"no zip"), ("empty", archive({"x": "y"}))], "pub_id string, content binary")
    return packages.entries(df).cache()


@pytest.fixture(scope="module")
def packed(entries):
    return opf.packages(entries, opf.renditions(entries).where("idx = 0")).cache()


def test_entries(spark, entries):
    assert {r["path"]: r["length"] for r in entries.where("pub_id = 'b'").collect()} == {k: len(v.encode()) for k, v in FILES.items()}
    archives = spark.createDataFrame([("bad", b"no zip"), ("ok", archive(FILES))], "pub_id string, content binary")
    assert [r["pub_id"] for r in packages.unreadable(archives).collect()] == ["bad"]
    asked = spark.createDataFrame([("b", p) for p in ("OEBPS/nav.xhtml", "oebps/TEXT/ch2.xhtml", "OEBPS/img/COVER.jpg", "none")], "pub_id string, path string")
    assert {r["path"]: r["entry_path"] for r in packages.find_entries(asked, entries).collect()} == {"OEBPS/nav.xhtml": "OEBPS/nav.xhtml", "oebps/TEXT/ch2.xhtml": "OEBPS/text/ch2.xhtml", "OEBPS/img/COVER.jpg": "OEBPS/img/cover.png", "none": None}


def test_renditions(spark, entries):
    found = opf.renditions(entries)
    assert [(r["idx"], r["opf_path"], r["layout"], r["language"]) for r in found.orderBy("idx").collect()] == [(0, "OEBPS/content.opf", "pre-paginated", None), (1, "B/b.opf", None, "fr"), (2, "C/c.opf", None, "fr")]
    best = lambda **k: opf.best_rendition(found, **k).first()["opf_path"]
    assert (best(language="fr"), best(layout="pre-paginated"), best(layout="reflowable"), best(language="xx"), best(layout="reflowable", language="fr")) == ("C/c.opf", "OEBPS/content.opf", "C/c.opf", "OEBPS/content.opf", "C/c.opf")
    assert {r["pub_id"]: r["kind"] for r in opf.container_errors(entries.select("pub_id").distinct(), entries).collect()} == {"empty": "missing_container"}


def test_metadata(packed):
    m = opf.metadata(packed).first().asDict(recursive=True)
    assert (m["title"], m["subtitle"], m["sort_as"], m["language"], m["languages"]) == ("Main & Co", "The Sub", "Co, Main", "ar-EG", ["ar-EG", "en"])
    assert m["creators"] == [{"name": "Ann", "role": "aut", "file_as": None}, {"name": "Bob", "role": None, "file_as": None}]
    assert m["identifier"] == "urn:uuid:1" and m["alt_identifiers"] == [{"value": "123", "scheme": "ISBN"}, {"value": "9", "scheme": "onix:codelist5"}]
    assert (m["publisher"], m["subjects"], m["date"], m["modified"], m["layout"], m["cover_id"], m["toc_id"], m["reading_progression"]) == ("P2", ["s1", "s2"], "2001", "2002", "pre-paginated", "img", "ncx", "rtl")
    assert m["belongs_to"] == [{"name": "Saga", "collection_type": "series", "position": 2.5}]
    assert m["media_overlays"] == {"total_duration": 60.0, "durations": {"ov": 30.0}, "narrators": ["Nan"], "active_class": None, "playback_active_class": None}
    a = m["accessibility"]
    assert a["conforms_to"] == ["EPUB Accessibility 1.1 - WCAG 2.1 Level AA"] and a["certification"] == {"certified_by": "Cert Inc", "credential": None, "report": "http://r"} and a["access_modes_sufficient"] == [["textual", "visual"]] and a["summary"] is None
    assert m["titles"][1]["lang"] == "en" and m["titles"][0]["display_seq"] == 2


def test_manifest_spine_guide(packed):
    items = {r["id"]: r for r in opf.manifest(packed).collect()}
    assert set(items) == {"nav", "c1", "c2", "img", "css", "css2", "ov"} and items["c1"]["href"] == "text/ch 1.xhtml" and items["c2"]["properties"] == ["svg", "scripted"] and items["c1"]["media_overlay"] == "ov"
    assert [tuple(r)[1:] for r in opf.spine(packed).orderBy("spine_index").collect()] == [(0, "cv", False, None, None), (1, "c1", True, "reflowable", "left"), (2, "c2", True, None, None)]
    assert [tuple(r)[1:] for r in opf.guide(packed).collect()] == [(0, "text", "OEBPS/text/ch2.xhtml#s", "Start")]
    assert opf.has_overlays(opf.manifest(packed)).first()["has_media_overlays"]


def test_encryption(entries):
    got = {r["zip_path"]: (r["algorithm"], r["original_length"]) for r in opf.encryption(entries).collect()}
    assert got == {"OEBPS/font 1.otf": ("idpf", None), "OEBPS/c.x": ("aes_cbc", 42)}


def test_encryption_of_many_files(spark):
    """Time in proportion to the file: 4,000 resources in one encryption.xml. Nested data counts for the outer one too, what comes before an error counts."""
    one = '<EncryptedData><m:EncryptionMethod x:Algorithm="{0}"/><CipherData><CipherReference URI="f%20{0}"/></CipherData></EncryptedData>'
    nested = '<a><EncryptedData><EncryptedData><CipherReference URI="y"/><EncryptionMethod Algorithm="q"/></EncryptedData><CipherReference URI="x"/><Compression OriginalLength="7"/></EncryptedData><EncryptedData><CipherReference URI="z"/><Compression OriginalLength="3"/><b></a>'
    files = [(1, "<e>" + "".join(map(one.format, range(4000))) + "</e>"), (2, nested), (3, "no xml"), (4, None)]
    rows = [(k, opf.ENCRYPTION, None if x is None else bytearray(x.encode())) for k, x in files]
    began = time.time()
    got = sorted((r["pub_id"], r["zip_path"], r["algorithm_uri"], r["original_length"]) for r in opf.encryption(spark.createDataFrame(rows, "pub_id int, path string, content binary")).collect())
    assert time.time() - began < 60
    assert got == sorted([(1, f"f {i}", str(i), None) for i in range(4000)]) + [(2, "x", "q", 7), (2, "y", "q", None), (2, "z", None, 3)]


def parts(entries, packed):
    items = opf.manifest(packed)
    meta = opf.metadata(packed)
    return items, meta, nav.spine_items(opf.spine(packed), items), nav.navigation(entries, items, meta)


def test_navigation(spark, entries, packed):
    items, meta, chapters, nodes = parts(entries, packed)
    got = [(r["list"], r["node_id"], r["parent_id"], r["depth"], r["title"], r["href"], r["role"]) for r in nodes.orderBy("list", "node_id").collect()]
    assert got == [
        ("landmarks", 0, None, 0, "Begin", "OEBPS/text/ch2.xhtml", "bodymatter"), ("page-list", 0, None, 0, "1", "OEBPS/text/ch2.xhtml#p1", None), ("toc", 0, None, 0, "One", "OEBPS/text/ch 1.xhtml", None),
        ("toc", 1, 0, 1, "One.1", "OEBPS/text/ch 1.xhtml#s", None), ("toc", 2, None, 0, "Two", "OEBPS/text/ch2.xhtml", None),
    ]
    assert {r["href_key"]: r["title"] for r in nav.title_map(nodes).collect()} == {"OEBPS/text/ch 1.xhtml": "One", "OEBPS/text/ch2.xhtml": "Two"}
    asked = spark.createDataFrame([("b", h) for h in ("OEBPS/text/ch 1.xhtml#s", "text/ch%201.xhtml", "other/ch2.xhtml", "none.xhtml")], "pub_id string, href string")
    assert [r["title"] for r in nav.toc_titles(asked, nodes, packed).orderBy("href").collect()] == ["One.1", None, "Two", "One"]
    assert {r["href"]: r["spine_of"] for r in nav.spine_of_href(asked, chapters).collect()} == {"OEBPS/text/ch 1.xhtml#s": 1, "text/ch%201.xhtml": None, "other/ch2.xhtml": 2, "none.xhtml": None}
    start = nav.reading_start(chapters, nodes, opf.guide(packed), meta).first()
    assert tuple(start) == ("b", 2, "landmark:bodymatter", "OEBPS/text/ch2.xhtml")
    start = nav.reading_start(chapters, nodes.where("list = 'toc'"), opf.guide(packed), meta).first()
    assert tuple(start)[1:3] == (2, "guide:text")
    start = nav.reading_start(chapters, nodes.limit(0), opf.guide(packed).limit(0), meta).first()
    assert tuple(start) == ("b", 1, "cover_skip", "text/ch 1.xhtml")
    assert nav.cover_image(items, meta).first()["id"] == "img"
    ncx = '<ncx xmlns="n"><navMap><navPoint><navLabel><text>A</text></navLabel><content src="a%20b.x"/><navPoint><navLabel><text>B</text></navLabel><content src="b.x"/></navPoint></navPoint></navMap><pageList><pageTarget><navLabel><text>1</text></navLabel><content src="a.x#1"/></pageTarget><pageTarget><navLabel><text>2</text></navLabel></pageTarget></pageList></ncx>'
    assert [(n["list"], n["node_id"], n["parent_id"], n["title"], n["href"]) for n in nav.ncx_nodes(ncx)] == [("toc", 0, None, "A", "a b.x"), ("toc", 1, 0, "B", "b.x"), ("page-list", 0, None, "1", "a.x#1")]


def test_overlays(entries, packed):
    items, _, chapters, _ = parts(entries, packed)
    chain = nav.overlay_chain(chapters, items)
    assert [tuple(r) for r in chain.collect()] == [("b", 1, "text/ch 1.xhtml", "OEBPS/ov/c1.smil", None, None)]
    rows = [tuple(r)[2:] for r in nav.overlays(entries, chain).orderBy("node_id").collect()]
    assert rows == [(0, None, "seq", "OEBPS/text/ch%201.xhtml", None, ["chapter", "part"]), (1, 0, "par", "OEBPS/text/ch%201.xhtml#p1", "OEBPS/a/1.mp3#t=0.000,3.450", [])]


def test_resolve_and_prepare(spark, entries, packed):
    items, meta, chapters, _ = parts(entries, packed)
    refs = spark.createDataFrame([("b", c, r) for c, r in [("text/ch 1.xhtml", "../img/cover.png?x"), (None, "css/a.css"), ("text/ch 1.xhtml", "/OEBPS/css/b.css"), (None, "Images/cover.png"), ("text/ch 1.xhtml", "none.png"), (None, "http://x"), (None, "")]], "pub_id string, chapter_href string, ref string")
    got = {r["ref"]: (r["zip_path"], r["media_type"]) for r in resolve.resolve(refs, entries, items, packed).collect()}
    assert got == {"../img/cover.png?x": ("OEBPS/img/cover.png", "image/png"), "css/a.css": ("OEBPS/css/a.css", "text/css"), "/OEBPS/css/b.css": ("OEBPS/css/b.css", "text/css"), "Images/cover.png": ("OEBPS/img/cover.png", "image/png"), "none.png": (None, None), "http://x": (None, None), "": (None, None)}
    one = entries.where("path = 'OEBPS/text/ch 1.xhtml'").select("pub_id", F.lit("c1").alias("chapter"), "path", F.col("content").cast("string").alias("html"))
    res = entries.select("pub_id", "path", "content", F.lit(None).cast("string").alias("media_type"))
    r = resolve.prepare(one, res).first()
    assert r["stats"].asDict() == {"considered": 4, "inlined": 3, "skipped_oversize": 0, "missing": 1, "skipped_type": 0}
    assert "src=\"data:image/png;base64,UE5H\"" in r["prepared"] and "<style" in r["prepared"] and "data:text/css;base64,cXt9" in r["prepared"] and "../img/none.png" in r["prepared"]
    small = resolve.prepare(one, res, max_bytes=10).first()["stats"]
    assert (small["inlined"], small["skipped_oversize"]) == (1, 1)
    read = resolve.read(spark.createDataFrame([("b", "OEBPS/css/b.css")], "pub_id string, zip_path string"), entries, opf.encryption(entries), meta).first()
    assert bytes(read["content"]) == b"q{}"


def test_positions(spark):
    rows = [(1, i, f"c{i}", f"t{i}", i != 1, n, lay) for i, n, lay in [(0, 0, None), (1, 9000, None), (2, 1025, None), (3, 99_999, "pre-paginated")]]
    df = spark.createDataFrame(rows, "pub_id int, spine_index int, idref string, href string, linear boolean, length long, layout_override string")
    got = positions.positions(df).orderBy("global_position").collect()
    assert [(r["cfi"], r["global_position"], round(r["chapter_progression"], 3), round(r["total_progression"], 3)) for r in got] == [("epubcfi(/6/2[c0]!/4)", 1, 0.0, 0.0), ("epubcfi(/6/6[c2]!/4)", 2, 0.0, 0.25), ("epubcfi(/6/6[c2]!/4/2)", 3, 0.5, 0.5), ("epubcfi(/6/8[c3]!/4)", 4, 0.0, 0.75)]
    counts = spark.createDataFrame([(0,), (1024,), (1025,), (10240,), (10241,)], "n long").select(positions.position_count("n").alias("c"))
    assert [r["c"] for r in counts.collect()] == [1, 1, 2, 10, 11] and spark.createDataFrame([(100,)], "n long").select(positions.position_count("n", 0)).first()[0] == 100
    index = positions.position_index(positions.positions(df))
    asked = spark.createDataFrame([(1, c) for c in ("epubcfi(/6/6[c2]!/4/2)", "epubcfi(/6/6!/4/100)", "epubcfi(/6/4!/4)", "epubcfi(/0!/4)", "x", "epubcfi(/6/6!/4/2,/1:0,/1:3)", "epubcfi(/6/8!/4)")], "pub_id int, cfi string")
    assert {r["cfi"]: r["location"] for r in positions.locate(asked, index).collect()} == {"epubcfi(/6/6[c2]!/4/2)": 2, "epubcfi(/6/6!/4/100)": 2, "epubcfi(/6/4!/4)": None, "epubcfi(/0!/4)": None, "x": None, "epubcfi(/6/6!/4/2,/1:0,/1:3)": 2, "epubcfi(/6/8!/4)": 3}
    back = positions.position_at(spark.createDataFrame([(1, 2), (1, 9)], "pub_id int, location long"), positions.positions(df)).orderBy("location").collect()
    assert back[0]["cfi"] == "epubcfi(/6/6[c2]!/4/2)" and back[1]["cfi"] is None
    p = spark.createDataFrame([(0.0, 10), (0.5, 10), (1.0, 10), (-1.0, 10), (0.99999, 10), (0.5, 0)], "p double, n long").select(positions.location_of_progression("p", "n").alias("x"))
    assert [r["x"] for r in p.collect()] == [0, 5, 9, 0, 9, None]


def test_search_books(spark):
    page = "<body>" + "<p>Whale whale</p>" * 10
    df = spark.createDataFrame([(1, i, f"c{i}", i != 1, page if i != 2 else None) for i in range(5)], "pub_id int, spine_index int, idref string, linear boolean, html string")
    got = search.search_books(df, " WHALE ", per_chapter=3, total=7).orderBy("spine_index", "hit_ord").collect()
    assert [(r["spine_index"], r["hit_ord"]) for r in got] == [(0, 0), (0, 1), (0, 2), (3, 0), (3, 1), (3, 2), (4, 0)] and got[0]["cfi"] == "epubcfi(/6/2[c0]!/4/2,/1:0,/1:5)"
    assert search.search_books(df, "whale", 0, 0, case_insensitive=False, include_non_linear=True).count() == 40
    assert search.search_books(df, "  ").count() == 0


def books(spark):
    b = spark.createDataFrame([("b", "3.0", "Golden <Book>", "urn:uuid:golden-12345", "en-US", [("Golden Author", "aut", None)], "p{}", "img")], "pub_id string, version string, title string, identifier string, language string, creators array<struct<name string, role string, file_as string>>, theme_css string, cover_id string")
    chapters = spark.createDataFrame([("b", 0, "c1", "text/c1.xhtml", "<html><head></head><body><svg/>A</body></html>", True), ("b", 1, "c2", "text/c2.xhtml", "<html><head></head><body>B</body></html>", False)], "pub_id string, spine_index int, id string, href string, html string, linear boolean")
    toc = spark.createDataFrame([("b", 0, None, "One & two", "text/c1.xhtml"), ("b", 1, 0, "Inner", "text/c1.xhtml#a"), ("b", 2, None, "Lost", "text/none.xhtml#z")], "pub_id string, node_id int, parent_id int, title string, href string")
    return b, chapters, toc


def test_generate_round_trip(spark):
    b, chapters, toc = books(spark)
    resources, order = generate.chapter_rows(chapters)
    resources = resources.unionByName(generate.cover_row(spark.createDataFrame([("b", "img/c.png", "image/png", b"PNG")], "pub_id string, href string, media_type string, content binary")))
    marks = spark.createDataFrame([("b", 0, "bodymatter", "text/c1.xhtml", "Start")], "pub_id string, ord int, epub_type string, href string, title string")
    pages = spark.createDataFrame([("b", 0, "1", "text/c1.xhtml#p1")], "pub_id string, ord int, name string, href string")
    made = generate.build(b, resources, order, toc, marks, pages).cache()
    raw = bytes(made.first()["content"])
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        first = z.infolist()[0]
        assert first.filename == "mimetype" and first.compress_type == zipfile.ZIP_STORED and z.namelist()[-1] == "OEBPS/content.opf"
        assert '<link rel="stylesheet" type="text/css" href="../styles/pagespan.css"/></head>' in z.read("OEBPS/text/c1.xhtml").decode()
        assert 'playOrder="4"' in z.read("OEBPS/toc.ncx").decode()
    e = packages.entries(made)
    packed = opf.packages(e, opf.renditions(e))
    meta = opf.metadata(packed).first()
    assert (meta["title"], meta["identifier"], meta["language"], meta["creators"][0]["role"], meta["cover_id"]) == ("Golden <Book>", "urn:uuid:golden-12345", "en-US", "aut", "img")
    assert [(r["idref"], r["linear"]) for r in opf.spine(packed).orderBy("spine_index").collect()] == [("c1", True), ("c2", False)]
    items = {r["id"]: r["properties"] for r in opf.manifest(packed).collect()}
    assert items["c1"] == ["svg"] and items["c2"] == [] and items["nav"] == ["nav"] and items["cover-image"] == ["cover-image"]
    nodes = nav.navigation(e, opf.manifest(packed), opf.metadata(packed)).orderBy("list", "node_id").collect()
    assert [(n["list"], n["parent_id"], n["title"], n["href"]) for n in nodes] == [("landmarks", None, "Start", "OEBPS/text/c1.xhtml"), ("page-list", None, "1", "OEBPS/text/c1.xhtml#p1"), ("toc", None, "One & two", "OEBPS/text/c1.xhtml"), ("toc", 0, "Inner", "OEBPS/text/c1.xhtml#a"), ("toc", None, "Lost", "OEBPS/text/none.xhtml#z")]


def test_golden_document():
    book = {"version": "3.0", "title": "Golden Book", "identifier": "urn:uuid:golden-12345", "language": "en-US", "creators": [{"name": "Golden Author", "role": "aut", "file_as": None}]}
    res = [{"id": "chapter1", "href": "text/ch1.xhtml", "media_type": "application/xhtml+xml", "properties": []}, {"id": "style", "href": "css/style.css", "media_type": "text/css", "properties": ["nav"]}]
    want = """<?xml version="1.0" encoding="UTF-8"?>
<package version="3.0" unique-identifier="pub-id" xmlns="http://www.idpf.org/2007/opf">
  <metadata xmlns:dc="http://purl.org/dc/elements/1.1/">
    <dc:title>Golden Book</dc:title>
    <dc:creator id="creator_0">Golden Author</dc:creator>
    <meta refines="#creator_0" property="role" scheme="marc:relators">aut</meta>
    <dc:language>en-US</dc:language>
    <dc:identifier id="pub-id">urn:uuid:golden-12345</dc:identifier>
  </metadata>
  <manifest>
    <item id="chapter1" href="text/ch1.xhtml" media-type="application/xhtml+xml"/>
    <item id="style" href="css/style.css" media-type="text/css" properties="nav"/>
  </manifest>
  <spine>
    <itemref idref="chapter1"/>
  </spine>
</package>"""
    assert generate.opf_text(book, res, [{"idref": "chapter1", "linear": True}], [], False, None) == want


def test_validate(spark):
    b, chapters, toc = books(spark)
    resources, order = generate.chapter_rows(chapters)
    order = order.unionByName(spark.createDataFrame([("b", 7, "ghost", True, None, None)], order.schema))
    bad = b.withColumn("title", F.lit("  ")).unionByName(b.withColumn("pub_id", F.lit("n")))
    got = [(r["pub_id"], r["message"]) for r in generate.validate(bad, resources, order, toc).orderBy("pub_id", "ord").collect()]
    assert got == [
        ("b", "title is blank"), ("b", "reading order: no resource with id ghost"), ("b", "table of contents: no file text/none.xhtml for entry Lost"), ("b", "cover: no resource with id img"),
        ("n", "reading order has no items"), ("n", "cover: no resource with id img"),
    ]


def test_import_pages(spark):
    pages = spark.createDataFrame([("b", "c1", "in/page.html", "<img src='pics/a.png'><link href=\"s.css\"><img src='http://x/y.png'><img src=\"gone.gif\">")], "pub_id string, id string, path string, html string")
    files = spark.createDataFrame([("in/pics/a.png", b"A"), ("in/s.css", b"S")], "path string, content binary")
    changed, assets = generate.import_pages(pages, files)
    assert changed.first()["html"] == "<img src=\"../images/a.png\"><link href=\"../styles/s.css\"><img src='http://x/y.png'><img src=\"../images/gone.gif\">"
    assert {(r["id"], r["href"], r["media_type"]) for r in assets.collect()} == {("pics_a_png", "images/a.png", "image/jpeg"), ("s_css", "styles/s.css", "text/css")}


def test_source_and_sink(spark, tmp_path):
    spark.dataSource.register(packages.PackageSource)
    df = spark.createDataFrame([("one", archive(FILES)), ("two", archive({"a": "b"}))], "pub_id string, content binary")
    df.write.format("epub").mode("append").option("path", str(tmp_path)).save()
    got = spark.read.format("epub").load(str(tmp_path))
    assert {(r["pub_id"], r["path"]) for r in got.select("pub_id", "path").collect()} == {("one", k) for k in FILES} | {("two", "a")}
    assert packages.read_archives(spark, str(tmp_path)).count() == 2
    alike = spark.createDataFrame([("a/b", archive({"x": "1"})), ("a_b", archive({"x": "22"})), ("bad", b"no zip"), ("none", None), (None, b"")], "pub_id string, content binary")
    alike.write.format("epub").mode("overwrite").option("path", str(tmp_path)).save()
    assert {(r["pub_id"], r["path"], r["length"]) for r in spark.read.format("epub").load(str(tmp_path)).collect()} == {("a/b", "x", 1), ("a_b", "x", 2)}
    assert sorted(x.name for x in tmp_path.iterdir()) == ["a%2Fb.epub", "a_b.epub", "bad.epub"]
    with pytest.raises(Exception, match="mounted"):
        spark.read.format("epub").load("s3a://books").count()
    folder = tmp_path / "root" / "bk"
    (folder / "OEBPS").mkdir(parents=True)
    (folder / "OEBPS" / "x.txt").write_text("hi")
    assert [tuple(r)[:4] for r in packages.read_folder(spark, str(tmp_path / "root")).collect()] == [("bk", "OEBPS/x.txt", None, 2)]


def test_rendition_at(spark, entries):
    found = opf.renditions(entries)
    pubs = spark.createDataFrame([("b",), ("none",)], "pub_id string")
    got = {(r["pub_id"], i): (r["opf_path"], r["error"]) for i in (0, 2, 9) for r in opf.rendition_at(pubs, found, i).collect()}
    assert got == {("b", 0): ("OEBPS/content.opf", None), ("b", 2): ("C/c.opf", None), ("b", 9): (None, "no rendition 9"), ("none", 0): (None, "no rendition 0"), ("none", 2): (None, "no rendition 2"), ("none", 9): (None, "no rendition 9")}


def test_search_literal(spark):
    c = spark.createDataFrame([("b", 0, "c", "<p>a.b A.B a.b</p>")], "pub_id string, spine_index int, idref string, html string")
    assert search.search_literal(c, "a.b").count() == 2 and search.search_literal(c, "").count() == 0


def test_closure_has_no_limit(spark):
    """A chain of 20 sheets, and one that ends in a cycle."""
    edges = spark.createDataFrame([("b", f"s{i}", f"s{i + 1}") for i in range(20)] + [("c", "x", "y"), ("c", "y", "x")], "pub_id string, path string, target string")
    roots = spark.createDataFrame([("b", "1", "s0"), ("c", "1", "x")], "pub_id string, chapter string, path string")
    got = {(r["pub_id"], r["path"]) for r in resolve.reference_closure(roots, edges).collect()}
    assert got == {("b", f"s{i}") for i in range(21)} | {("c", "x"), ("c", "y")}


def test_positions_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(positions, "BLOCK", 4)
    c = spark.createDataFrame([("b", i, f"i{i}", f"h{i}", i % 3 != 1, 700 * i) for i in range(30)], "pub_id string, spine_index int, idref string, href string, linear boolean, length long")
    rows = positions.positions(c).orderBy("global_position").collect()
    n = [max(1, -(-700 * i // 1024)) if i % 3 != 1 else 0 for i in range(30)]
    assert [r["global_position"] for r in rows] == list(range(1, sum(n) + 1)) and [r["spine_index"] for r in rows] == [i for i in range(30) for _ in range(n[i])]


def test_trees_as_json(spark, entries, packed):
    _, _, _, nodes = parts(entries, packed)
    tree = nav.to_tree([r.asDict() for r in nodes.where("list = 'toc'").collect()])
    assert tree == [{"title": "One", "href": "OEBPS/text/ch 1.xhtml", "children": [{"title": "One.1", "href": "OEBPS/text/ch 1.xhtml#s", "children": []}]}, {"title": "Two", "href": "OEBPS/text/ch2.xhtml", "children": []}]
    back = nav.trees_from_json(nav.trees_to_json(nodes.where("list = 'toc'"))).select(*nodes.columns)
    assert sorted(map(str, back.collect())) == sorted(map(str, nodes.where("list = 'toc'").collect()))


def test_chapter_titles_and_strict_spine(spark, entries, packed):
    items, _, chapters, nodes = parts(entries, packed)
    known = chapters.where("href is not null")
    assert {r["href"]: r["title"] for r in nav.chapter_titles(known, nodes).collect()} == {"text/ch 1.xhtml": "One", "text/ch2.xhtml": "Two"}
    assert {r["title"] for r in nav.chapter_titles(known, nodes, "strict").collect()} == {None}
    assert positions.missing_items(opf.spine(packed), items).count() == 0  # the item without a manifest entry isn't linear
    assert positions.missing_items(opf.spine(packed).withColumn("linear", F.lit(True)), items).first()["message"].endswith("cv")
    assert positions.strict(opf.spine(packed).withColumn("linear", F.lit(True)), items).count() == 0


def test_imports_deeper_than_sixteen(spark):
    n = 20
    chain = [(f"s{i}.css", f"@import 's{i + 1}.css';".encode()) for i in range(n)] + [(f"s{n}.css", b"p{b:url(x.png)}"), ("x.png", b"png"), ("c1.css", b"@import 'c2.css';"), ("c2.css", b"@import 'c1.css';")]
    edges = spark.createDataFrame([("b", f"s{i}.css", f"s{i + 1}.css") for i in range(n)] + [("b", f"s{n}.css", "s3.css")], "pub_id string, path string, target string")
    roots = spark.createDataFrame([("b", "c", "s0.css")], "pub_id string, chapter string, path string")
    assert sorted(r["path"] for r in resolve.reference_closure(roots, edges).collect()) == sorted(f"s{i}.css" for i in range(n + 1))
    files = spark.createDataFrame([("b", p, c, None) for p, c in chain], "pub_id string, path string, content binary, media_type string")
    page = "<html><head><link rel='stylesheet' href='s0.css'><link rel='stylesheet' href='c1.css'></head></html>"
    chapters = spark.createDataFrame([("b", "c", "t.xhtml", page)], "pub_id string, chapter string, path string, html string")
    got = resolve.prepare(chapters, files).first()
    assert got["stats"].asDict() == {"considered": n + 4, "inlined": n + 4, "skipped_oversize": 0, "missing": 0, "skipped_type": 0}
    text = got["prepared"]
    for _ in range(n):  # each sheet holds the next one
        text = base64.b64decode(re.search(r"data:text/css;base64,([A-Za-z0-9+/=]+)", text)[1]).decode()
    assert "data:image/png" in text
