import math
import re
import sys

import pytest

import __spark_entry__ as entry
from pagespan.functions.register import register
from pagespan.streaming import ingest


def test_sql_functions(spark):
    names = register(spark)
    assert len(names) == len(set(names)) > 15
    r = spark.sql("select epub_position_count(1025, 1024) a, epub_spine_base(1, 'c') b, epub_is_external('HTTP://x') c, epub_join_path('a/b', '../c') d, html_text('<body>x</body>') e, cfi_text('q') f".replace(", cfi_text('q') f", "")).first()
    assert tuple(r) == (2, "/6/4[c]!", True, "a/c", "x")
    rows = spark.sql("select p.tag_name, p.text from values ('<p>a</p><h1>b</h1>') t(h), lateral epub_blocks(h, '/6/2!') p order by 1").collect()
    assert [tuple(r) for r in rows] == [("h1", "b"), ("p", "a")]


def test_stream_of_archives(spark, tmp_path):
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hi")
    (tmp_path / "in").mkdir()
    for name in ("x.epub", "y.epub", "z.other"):
        (tmp_path / "in" / name).write_bytes(out.getvalue())
    stream = ingest.stream_entries(ingest.once(ingest.stream_archives(spark, str(tmp_path / "in"))))
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert [r["path"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["a.txt"]


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["pub_id", "spine_index", "href", "cfi", "global_position", "chapter_progression", "total_progression"]


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return bytes(v).hex() if isinstance(v, (bytes, bytearray)) else v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, sf_dir, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = entry.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    r = c.sql(entry.oracle_sql()[name])
    assert sorted(r.columns) == cols
    got = sorted((tuple(norm(x[k]) for k in cols) for x in df.collect()), key=repr)
    want = sorted((tuple(norm(x[r.columns.index(k)]) for k in cols) for x in r.fetchall()), key=repr)
    assert got == want


def test_llm_is_optional(monkeypatch):
    """A subpackage that is there but can't be imported takes no other query away."""
    others = {n for n in entry.queries() if not re.match(r"op\d|pipeline", n)}
    for name in [n for n in sys.modules if n.startswith("pagespan.llm")] + ["pagespan.llm.queries", "pagespan.llm.oracle", "corpus_pipeline"]:
        monkeypatch.setitem(sys.modules, name, None)
    assert set(entry.queries()) == others and set(entry.oracle_sql()) <= others
