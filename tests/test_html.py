import json
import re

import pytest
from pyspark.sql import functions as F

from pagespan.operators import css, generate, html, htmlcore, nav

TREES = [
    ("<p>a<b>b<p>c<b>d", "<p>a<b>b</b></p><p><b>c<b>d</b></b></p>"),
    ("<b>1<p>2</b>3</p>", "<b>1</b><p><b>2</b>3</p>"),
    ("<table>foo<tr><td>a", "foo<table><tbody><tr><td>a</td></tr></tbody></table>"),
    ("a&amp;b &copy x", "a&amp;b © x"),
    ("<ul><li>1<li>2</ul>", "<ul><li>1</li><li>2</li></ul>"),
    ("<a href='x?a=1&copy=2&lt;'>k", '<a href="x?a=1&amp;copy=2<">k</a>'),
    ("<a>1<div>2<a>3", "<a>1</a><div><a>2</a><a>3</a></div>"),
    ("<p><i><b>x</p><p>y", "<p><i><b>x</b></i></p><p><i><b>y</b></i></p>"),
    ("<div><br/><img src=a></div>", '<div><br><img src="a"></div>'),
    ("<h1>a<h2>b", "<h1>a</h1><h2>b</h2>"),
    ("<pre>\nx</pre>", "<pre>x</pre>"),
    ("<dl><dt>a<dd>b<dt>c</dl>", "<dl><dt>a</dt><dd>b</dd><dt>c</dt></dl>"),
    ("x</p>y", "x<p></p>y"),
    ("<select><option>a<option>b</select>", "<select><option>a</option><option>b</option></select>"),
    ("<b>x<b>x<b>x<b>x<p>y", "<b>x<b>x<b>x<b>x<p>y</p></b></b></b></b>"),
    ("<script>a<b></script>t", "t"),
]


@pytest.mark.parametrize(("source", "body"), TREES)
def test_tree(source, body):
    root = htmlcore.parse(source)
    got = htmlcore.serialize(root.first("body"))
    assert got == body


def test_active_formatting_has_three_alike():
    root = htmlcore.parse("<p>" + "<b>x" * 5 + "</p><p>y")
    last = [n for n in root.walk() if n.name == "p"][1]
    depth = 0
    while last.children and last.children[0].element:
        last, depth = last.children[0], depth + 1
    assert depth == 3


def test_blocks():
    page = '<html lang="en"><body><h1>T</h1><p lang="fr">Bon <i>jour</i></p><blockquote><p>in</p></blockquote><p> </p><div><ul><li>a<p>b</p></li></ul></div></body></html>'
    got = html.blocks(page, "/6/4[c]!")
    assert [(b["tag_name"], b["text"], b["language"], b["cfi_range"]) for b in got] == [
        ("h1", "T", "en", "epubcfi(/6/4[c]!/4/2)"), ("p", "Bon jour", "fr", "epubcfi(/6/4[c]!/4/4)"), ("blockquote", "in", "en", "epubcfi(/6/4[c]!/4/6)"), ("li", "ab", "en", "epubcfi(/6/4[c]!/4/10/2/2)"),
    ]


def test_search():
    page = "<html><head><title>brave</title></head><body><p id='content'>This is a brave new <b>world</b></p><p>Another brave one, é brave</p></body></html>"
    got = html.search(page, "/6/4!", "brave")
    assert [g["cfi"] for g in got] == ["epubcfi(/6/4!/2/2,/1:0,/1:5)", "epubcfi(/6/4!/4/2[content],/1:10,/1:15)", "epubcfi(/6/4!/4/4,/1:8,/1:13)", "epubcfi(/6/4!/4/4,/1:22,/1:27)"]
    assert got[3]["excerpt"] == "other brave one, é brave"
    assert html.search("<p>a.c abc", "b", re.escape("a.c")) == [{"excerpt": "a.c abc", "cfi": "epubcfi(b/4/2,/1:0,/1:3)"}]
    assert [g["cfi"] for g in html.search("<p>x<!-- c -->x<b>x</b>x", "", "x")] == ["epubcfi(/4/2,/1:0,/1:1)", "epubcfi(/4/2,/1:0,/1:1)", "epubcfi(/4/2/2,/1:0,/1:1)", "epubcfi(/4/2,/3:0,/3:1)"]


def test_offsets_of_many_matches():
    text = "é日x " * 4000
    got = html.search(f"<p>{text}</p>", "", "x")
    assert [g["cfi"] for g in got] == [f"epubcfi(/4/2,/1:{7 * i + 5},/1:{7 * i + 6})" for i in range(4000)]


def test_deep_nesting():
    """No limit of the interpreter's stack in trees, lists or writers."""
    n = 3000
    page = "<div>" * n + "x" + "</div>" * n
    out = html.annotate(page, "/6/2!")
    assert out.count("data-cfi") == n + 2 and html.search(page, "", "x")[0]["cfi"] == "epubcfi(/4" + "/2" * n + ",/1:0,/1:1)"
    assert len(html.markers(page, "", 1)["markers"]) == 1 and html.blocks(page, "") == []
    toc = "<nav epub:type='toc'>" + "<ol><li><a href='c'>t</a>" * n + "</li></ol>" * n + "</nav>"
    rows = nav.nav_nodes(toc, "")
    assert len(rows) == n and rows[-1]["depth"] == n - 1
    ncx = "<ncx><navMap>" + "<navPoint><navLabel><text>t</text></navLabel><content src='c'/>" * n + "</navPoint>" * n + "</navMap></ncx>"
    assert [r["depth"] for r in nav.ncx_nodes(ncx)] == list(range(n))
    smil = "<smil><body>" + "<seq textref='c'>" * n + "<par><text src='a#b'/></par>" + "</seq>" * n + "</body></smil>"
    assert len(nav.smil_rows(smil, "")) == n + 1
    chain = [{"node_id": i, "parent_id": i - 1 if i else None, "title": "t", "href": "h"} for i in range(n)]
    assert generate.nav_text(chain, [], []).count("<li>") == n and generate.ncx_text({}, chain, []).count("<navPoint") == n
    text = nav.tree_text(nav.to_tree(chain))
    assert text.count('"title"') == n
    few = nav.to_tree(chain[:50])
    assert json.loads(nav.tree_text(few)) == few and [r["depth"] for r in nav.from_tree(few)] == list(range(50)) and len(nav.from_tree(nav.to_tree(chain))) == n


def test_annotate():
    out = html.annotate("<title>t</title><h2>one</h2><ul id='menu'><li>x</li><li><em id=deep>y</em></li></ul>", "/6/8[c4]!")
    assert re.findall(r'data-cfi="([^"]*)"', out) == [f"epubcfi(/6/8[c4]!{x})" for x in ("/2", "/2/2", "/4", "/4/2", "/4/4[menu]", "/4/4[menu]/2", "/4/4[menu]/4", "/4/4[menu]/4/2[deep]")]


def test_markers():
    got = html.markers("<html><head></head><body><p>12345</p><p>67890</p><p>abcde</p></body></html>", "/6/4!", 4)
    assert got == {"markers": ["epubcfi(/6/4!/4/2/1:4)", "epubcfi(/6/4!/4/4/1:3)", "epubcfi(/6/4!/4/6/1:2)"], "carried": 3}


def test_extract_text():
    assert html.extract_text("<html><head><title>no</title></head><body><p>a &amp; b</p><script>x</script><style>y</style> c</body></html>") == "a &amp; b c"
    assert html.extract_text("<p>fragment</p>") == ""


def test_rewrite_resources():
    page = """<img src="../i/a.png?x" srcset="../i/a.png 1x, ../i/b.png 2x" alt='k'><a href="c2.xhtml#s">t</a><a href="#s">u</a><use xlink:href='../i/s.svg#g'/><p style="background:url(../i/a.png)">x</p><style>p{background:url('../i/b.png')}/* url(../i/a.png) */</style><img src=http://h/x><object data=../i/a.png></object>"""
    urls = {"OEBPS/i/a.png": "A", "OEBPS/i/b.png": "B", "OEBPS/t/c2.xhtml": "C", "OEBPS/i/s.svg": "S"}
    out = html.rewrite_resources(page, "OEBPS/t/c1.xhtml", urls.get)
    assert out == """<img src="A" srcset="A 1x, B 2x" alt='k'><a href="C#s">t</a><a href="#s">u</a><use xlink:href="S#g"/><p style="background:url(&quot;A&quot;)">x</p><style>p{background:url("B")}/* url(../i/a.png) */</style><img src=http://h/x><object data="A"></object>"""
    assert html.rewrite_links('<a href="x">1</a><img src=y><link href=z>', {"x": "1", "z": 'q"'}.get) == '<a href="1">1</a><img src=y><link href="q&quot;">'


def test_css():
    sheet = '@import "a.css"; @import url(b.css); p{background: url( "../i/x y.png" ) url(data:x) URL(no) url("open}' + " /* url(c) */ url(d.png"
    assert css.references(sheet, "s") == ["s/a.css", "s/b.css", "i/x y.png", "s/d.png"]
    assert css.rewrite("@import 'a.css';p{b:url(x.png)}", "s", {"s/a.css": "N", "s/x.png": "M"}.get) == '@import "N";p{b:url("M")}'


def test_inject_and_promote():
    assert html.inject_head("<html><head><title>a</title></head><body></head></body>", "<x/>") == "<html><head><title>a</title><x/></head><body></head></body>"
    assert html.inject_head("<p>x", "<x/>") == "<p>x"
    page = '<link rel="stylesheet" href="data:text/css;base64,cHt9PC9zdHlsZT4="><link rel="stylesheet" href="data:text/css,"><link rel="icon" href="data:image/png,x"><link rel="stylesheet" href="a.css">'
    assert html.promote_styles(page) == '<style type="text/css">\np{}<\\/style>\n</style><link rel="icon" href="data:image/png,x"><link rel="stylesheet" href="a.css">'


def test_columns(spark):
    page = "<html><body><p>a <b>b</b></p><svg/><img src='i/a.png'><a href='#x'>k</a><a href=\"http://h\">k</a><img srcset=\"b.png 1x, c.png\"><div style='x:url(d.png)'></div><SCRIPT></SCRIPT></body></html>"
    df = spark.createDataFrame([(1, page), (2, None)], "i int, h string")
    r = df.select("i", html.html_text("h").alias("t"), html.html_blocks("h", F.lit("/6/2!")).alias("b"), html.inferred_properties("h").alias("p"), html.local_references("h", F.lit("t/c.xhtml")).alias("l"), html.html_markers("h", F.lit("/6/2!"), F.lit(1), F.lit(0)).alias("m")).orderBy("i").collect()
    assert r[0]["p"] == ["scripted", "svg"] and r[0]["l"] == ["t/i/a.png", "t/b.png", "t/c.png", "t/d.png"] and r[0]["b"][0]["text"] == "a b" and r[0]["m"]["carried"] == 0
    assert r[1]["t"] is None and r[1]["b"] is None and r[1]["m"] is None
