import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagespan.functions import a11y, coords, crypto, media, paths
from pagespan.operators import css


def evaluate(spark, rows, names, f):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_ int, " + ", ".join(f"{n} string" for n in names))
    return [r[0] for r in df.orderBy("row_").select(f.alias("x")).collect()]


def test_join(spark):
    cases = [("book/part", "../art/k.gif", "book/art/k.gif"), ("", "top.xml", "top.xml"), ("u/v/w/z", "../../k", "u/v/k"), ("u", "./m/././n", "u/m/n"), ("one", "../../../two", "two"), ("", "../../q/r", "q/r"), ("book", "x%2Fy%20z", "book/x%2Fy%20z"), ("p//q", "r//s", "p/q/r/s")]
    assert evaluate(spark, [c[:2] for c in cases], ["b", "r"], paths.join_path("b", "r")) == [c[2] for c in cases]
    assert [css.fold(b, r) for b, r, _ in cases] == [c[2] for c in cases]


def test_normalize(spark):
    cases = [
        ("book", "s/main.css?x#y?z", "book/s/main.css"), ("book/part", "../art/two%20words.gif", "book/art/two words.gif"), ("book", "art/%C3%A9t%C3%A9.svg", "book/art/été.svg"), ("u/v", "w/%2E%2E/k.gif", "u/v/k.gif"),
        ("book/part", "#there", "book/part"), ("book", "", "book"), ("", "1+1.gif", "1+1.gif"), ("", "half%", "half%"), ("", "%q1%7A%5", "%q1z%5"),
    ]
    assert evaluate(spark, [c[:2] for c in cases], ["b", "r"], paths.normalize("b", "r")) == [c[2] for c in cases]
    assert [css.normalize(b, r) for b, r, _ in cases] == [c[2] for c in cases]


def test_resolve_and_relative(spark):
    cases = [("book/toc", "../part/two.xml#k7", "book/part/two.xml#k7"), ("book", "ftp://h.example/z", "ftp://h.example/z"), ("", "../part/one.xml", "../part/one.xml"), ("book", "#here", "#here"), ("book/part", "", ""), ("book", "a%20b.xml#c%20d", "book/a%20b.xml#c%20d")]
    assert evaluate(spark, [c[:2] for c in cases], ["b", "r"], paths.resolve_href("b", "r")) == [c[2] for c in cases]
    cases = [("p/one.xml", "p/two.xml", "two.xml"), ("p/q/r/one.xml", "p/s/two.xml", "../../s/two.xml"), ("one.xml", "p/q/k.css", "p/q/k.css"), ("p/q/r/one.xml", "k.css", "../../../k.css"), ("one.xml", "two.xml", "two.xml"), ("p/q/one.xml", "p/q/one.xml", "one.xml")]
    assert evaluate(spark, [c[:2] for c in cases], ["b", "r"], paths.relative_path("b", "r")) == [c[2] for c in cases]
    cases = [("t/c1.x", "#a", "#a"), ("t/c1.x?q", "", "t/c1.x"), ("t/c1.x", "/img/a.png", "img/a.png"), ("t/c1.x", "../i/a%20b.png?x#y", "i/a b.png"), ("c1.x", "http://h", "http://h")]
    assert evaluate(spark, [c[:2] for c in cases], ["b", "r"], paths.chapter_href("b", "r")) == [c[2] for c in cases]


def test_external(spark):
    yes = ["http://h.example", "HtTpS://h.example/p?q", "data:,x", "Data:font/woff2;base64,AA", "//h.example", "JAVASCRIPT:f()", "file:/etc/k", "about:k", "chrome://k", "mailto:k@h.example", "blob:k", "FTP://h.example/k", "\thttps://h.example"]
    no = ["k", "./k.css", "../../k.ttf", "k.svg#g", "p/q/k.xml?http://h", "isbn:9", "k:l:m", "/", " "]
    assert evaluate(spark, [(u,) for u in yes + no], ["u"], paths.is_external("u")) == [True] * len(yes) + [False] * len(no)
    assert [css.is_external(u) for u in yes + no] == [True] * len(yes) + [False] * len(no)


def test_mime(spark):
    cases = [("Images/Cover.JPG", "image/jpeg"), ("img/a.png?v=2#x", "image/png"), ("README", "application/octet-stream"), ("a.xhtml", "application/xhtml+xml"), ("x.opus", "audio/opus"), ("dir.d/name", "application/octet-stream"), ("a." + "x" * 17, "application/octet-stream")]
    assert evaluate(spark, [c[:1] for c in cases], ["p"], paths.mime_for_path("p")) == [c[1] for c in cases]
    assert evaluate(spark, [("x.jpe",), ("x.js",), ("png",)], ["p"], paths.guess_media_type("p")) == ["image/jpeg", "application/octet-stream", "image/png"]
    assert evaluate(spark, [("a.png", " "), ("a.png", "x/y"), ("a.png", "application/octet-stream")], ["p", "d"], paths.resolve_media_type("p", "d")) == ["image/png", "x/y", "image/png"]
    assert evaluate(spark, [("../x",), ("a/../../x",), ("/x",), ("a/../b",), ("a/b",)], ["p"], paths.escapes_root("p")) == [True, True, True, False, False]


@settings(max_examples=100, deadline=None)
@given(st.text("ab./%2e#?", max_size=12), st.text("ab./%2e#?", max_size=12))
def test_normalized_paths_stay_inside(base, ref):
    out = css.normalize(base, ref)
    assert css.fold(out) == out and not out.startswith("/") and ".." not in out.split("/")


def test_clock(spark):
    cases = [("3:04:05.25", 11045.25), ("61:01.5", 3661.5), ("0.75s", 0.75), ("90ms", 0.09), ("0.5min", 30.0), ("2h", 7200.0), ("41.125", 41.125), ("\t8 min ", 480.0), (" ", None), ("1:k", None), ("9:8:7:6", None), ("ms", None)]
    got = evaluate(spark, [c[:1] for c in cases], ["v"], media.clock_seconds("v"))
    assert [None if x is None else round(x, 6) for x in got] == [c[1] for c in cases]
    df = spark.sql("select 'snd/k.ogg' s, 1.5D b, 20D e, cast(null as double) z")
    assert tuple(df.select(media.media_fragment("s", "b", "e"), media.media_fragment("s", "z", "e"), media.media_fragment("s", "b", "z"), media.media_fragment("s", "z", "z")).first()) == ("snd/k.ogg#t=1.500,20.000", "snd/k.ogg#t=0.000,20.000", "snd/k.ogg#t=1.500", "snd/k.ogg")


def test_keys_and_masks(spark):
    ids = [("urn:uuid:01234567-89AB-cdef-0123-456789abcdef",), ("urn: uuid :1\t2\n",), ("nothing",)]
    assert [bytes(x) for x in evaluate(spark, ids, ["i"], crypto.idpf_key("i"))] == [hashlib.sha1("".join(i[0].split()).encode()).digest() for i in ids]
    assert bytes(evaluate(spark, ids, ["i"], crypto.adobe_key("i"))[0]).hex() == "0123456789abcdef" * 2
    assert bytes(evaluate(spark, ids, ["i"], crypto.adobe_key("i"))[2]) == bytes(16)
    data = bytes(range(256)) * 6
    df = spark.createDataFrame([(data, "urn:uuid:01234567-89ab-cdef-0123-456789abcdef", a) for a in ("idpf", "adobe", "aes_cbc", "unknown")], "c binary, i string, a string")
    once = df.withColumn("m", crypto.deobfuscate("c", "i", "a")).withColumn("b", crypto.deobfuscate("m", "i", "a")).collect()
    for r in once:
        n = {"idpf": 1040, "adobe": 1024}.get(r["a"], 0)
        assert bytes(r["b"]) == data and bytes(r["m"])[n:] == data[n:] and (bytes(r["m"])[:n] != data[:n]) == (n > 0)
    uris = [("http://www.idpf.org/2008/embedding",), ("http://ns.adobe.com/pdf/enc#RC",), ("http://www.w3.org/2001/04/xmlenc#aes256-cbc",), ("x",)]
    assert evaluate(spark, uris, ["u"], crypto.algorithm_of("u")) == ["idpf", "adobe", "aes_cbc", "unknown"]


def test_a11y(spark):
    top = "http://www.idpf.org/epub/a11y/accessibility-20170105.html#wcag-"
    cases = [("https://idpf.org/epub/a11y/accessibility-20170105.html#wcag-aa", top + "aa", 2), (top + "aaa", top + "aaa", 3), (" EPUB  Accessibility 1.1 -\nWCAG 2.1 Level AA", "EPUB Accessibility 1.1 - WCAG 2.1 Level AA", 8), ("EPUB Accessibility 1.1 - WCAG 2.0 Level A", "EPUB Accessibility 1.1 - WCAG 2.0 Level A", 4), ("EPUB Accessibility 1.1 - WCAG 3.0 Level X", "EPUB Accessibility 1.1 - WCAG 3.0 Level X", 16), ("other", None, 255)]
    assert evaluate(spark, [c[:1] for c in cases], ["p"], a11y.normal_profile("p")) == [c[1] for c in cases]
    assert evaluate(spark, [(c[1] or "other",) for c in cases], ["p"], a11y.profile_rank("p")) == [c[2] for c in cases]


# --- coordinates

VALID = ["epubcfi(/6/4[chap01ref]!/4[body01]/10[para05]/3:10)", "epubcfi(/6/4!/4/2,/1:5,/3:10)", "epubcfi(/6/4[a]!/4/2~23.5@50:75)", "epubcfi(/6/2!/4@10:20.5)", "epubcfi(/6/4!/4/2/1:3:before)", "epubcfi(/6/4)", "epubcfi(/6/4!)", "epubcfi(/6/4!/4/2~7)"]


def parsed(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("c", coords.cfi_parse("t"))


def test_cfi_round_trip(spark):
    assert [r[0] for r in parsed(spark, VALID).orderBy("i").select(coords.cfi_text("c")).collect()] == VALID


def test_cfi_grammar(spark):
    bad = ["", "/6/4", "epubcfi(/6/4", "epubcfi(/a)", "epubcfi(/6,/4)", "epubcfi(/6!/4!/2)", "epubcfi(/4:x)", "epubcfi(/4[a!b]!/2!/4)", "epubcfi(/99999999999)", "epubcfi(/4~x)", "epubcfi(/4@1)"]
    assert parsed(spark, bad).where("c is not null").count() == 0
    c = coords.parse("epubcfi(/2/4[section^/1^:2^]])")
    assert c["parent"]["steps"] == [{"index": 2, "assertion": None}, {"index": 4, "assertion": "section/1:2]"}]
    c = coords.parse(" epubcfi(/6/4[chap,v2]!/4/2,/1:5,/3:10) ")
    assert c["kind"] == "range" and c["parent"]["steps"][1]["assertion"] == "chap,v2" and c["end"]["char_offset"] == 10
    assert coords.parse("epubcfi(/4[a:b@c~d])")["parent"]["char_offset"] is None
    assert coords.point([(6, None), (4, "x")], [(4, None)], 3) == coords.parse("epubcfi(/6/4[x]!/4:3)")


def test_cfi_order(spark):
    ordered = ["epubcfi(/6/4)", "epubcfi(/6/4!/4/2)", "epubcfi(/6/4!/4/2@5:1)", "epubcfi(/6/4!/4/2@1:9)", "epubcfi(/6/4!/4/2~1)", "epubcfi(/6/4!/4/2:3)", "epubcfi(/6/4!/4/2/1)", "epubcfi(/6/4!/4/10)", "epubcfi(/6/10!/4)", "epubcfi(/6/4!/4,/2,/3)"]
    df = parsed(spark, ordered[::-1])
    assert [r["t"] for r in df.orderBy(coords.cfi_key("c")).collect()] == ordered
    pair = spark.createDataFrame([("epubcfi(/6/4[a]!/4:1)", "epubcfi(/6/4[b]!/4:1)"), ("epubcfi(/6/4!/4:1:before)", "epubcfi(/6/4!/4:1)"), ("epubcfi(/6/4!/4)", "epubcfi(/6/6!/4)")], "a string, b string").select(coords.cfi_parse("a").alias("a"), coords.cfi_parse("b").alias("b"))
    got = {tuple(r) for r in pair.select(coords.cfi_compare("a", "b"), coords.cfi_equal("a", "b")).collect()}
    assert got == {(0, True), (0, False), (-1, False)}


def test_cfi_resolve(spark):
    r = parsed(spark, ["epubcfi(/6/4[chap01ref]!/4[body01]/10[para05]/3:10)"]).select(coords.cfi_resolve("c").alias("r")).first()["r"]
    s = r["start"]
    assert r["end"] is None and (s["spine_index"], s["char_offset"], s["is_text_node"], s["id_shortcut"]) == (1, 10, True, "para05")
    assert s["xpath"] == "./*/*[position()=2 and @id='body01']/*[position()=5 and @id='para05']/text()[2]"
    assert s["xpath_ns_agnostic"] == "./*[local-name()]/*[local-name()][position()=2 and @id='body01']/*[local-name()][position()=5 and @id='para05']/text()[2]"
    assert [(x["node_type"], x["index"]) for x in s["steps"]] == [("element", 1), ("element", 4), ("text", 1)]
    r = parsed(spark, ["epubcfi(/6/4[chap01]!/4/2,/1:5,/3:10)"]).select(coords.cfi_resolve("c").alias("r"), coords.cfi_resolve("c", True).alias("f")).first()
    assert [(len(e["steps"]), e["char_offset"], e["is_text_node"]) for e in (r["r"]["start"], r["r"]["end"])] == [(2, 5, False), (2, 10, False)]
    assert [(len(e["steps"]), e["is_text_node"]) for e in (r["f"]["start"], r["f"]["end"])] == [(3, True), (3, True)]
    assert parsed(spark, ["epubcfi(/6/4)", "epubcfi(/6/4!)"]).where(coords.cfi_resolve("c").isNotNull()).count() == 0


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        ("epubcfi(/6/4[x]!/4/2/1:5)", "epubcfi(/6/4[x]!/4/2/3:10)", "epubcfi(/6/4[x]!/4/2,/1:5,/3:10)"),
        ("epubcfi(/6/4!/4/2/1:5)", "epubcfi(/6/4!/4/2/1:9)", "epubcfi(/6/4!/4/2/1,:5,:9)"),
        ("epubcfi(/6/4!/4/2:1)", "epubcfi(/6/6!/4/2:3)", "epubcfi(/6,/4!/4/2:1,/6!/4/2:3)"),
        ("epubcfi(/6/4!/4/2)", "epubcfi(/6/4!/4/2/4)", "epubcfi(/6/4!/4/2,,/4)"),
        ("epubcfi(/6/4!/4,/1,/2)", "epubcfi(/6/4!/4)", None),
    ],
)
def test_cfi_range(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string").select(coords.cfi_parse("a").alias("a"), coords.cfi_parse("b").alias("b"))
    assert df.select(coords.cfi_range_of("a", "b")).first()[0] == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=5), st.lists(st.integers(0, 50), max_size=5), st.integers(0, 99))
def test_cfi_parse_of_built(base, local, offset):
    steps = lambda x: "".join(f"/{i}" for i in x)
    assert coords.parse(f"epubcfi({steps(base)}!{steps(local)}:{offset})") == coords.point([(i, None) for i in base], [(i, None) for i in local], offset)


def test_spine_base(spark):
    assert spark.range(1).select(coords.spine_base(F.lit(1), F.lit("ch1"))).first()[0] == "/6/4[ch1]!"
