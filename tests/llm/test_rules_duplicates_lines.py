from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagespan.llm import common, linetemplates, nearduplicates, rules
from pagespan.llm.components import components

from . import plain
from .plain import WORD

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None) for i, t, s in rows], SCHEMA)


def words(rng, n):
    return " ".join("".join(rng.choice(list("abcdefghij"), 4)) for _ in range(n))


def test_rules_base_counts(spark, sf_dir):
    odd = [(10_001, None, "s"), (10_002, "", None), (10_003, "a b c a b c a b c", "s"), (10_004, "x\n\nx\n x\n", "s"), (10_005, "é ü #|<\x0b\x0cz", "s"), (10_006, "a a a a", "s")]
    real = [(r[0], r[1], r[2]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()]
    for r in rules.judge(docs(spark, odd + real).withColumn("kept", F.lit("clash"))).join(docs(spark, odd + real).select("doc_id", "text"), "doc_id").collect():
        e = plain.base(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == e, r["doc_id"]
        assert r["base_failed"] == (e[0] < 50 or 100 * e[4] > 50 * e[0])


def shared_lines(rng):
    common = [words(rng, 20) for _ in range(5)]
    rows = [(i, "\n".join([words(rng, 60), "  " + common[0].upper() + " "]), "h") for i in range(30)]  # loses a line, stays
    rows += [(100 + i, "\n".join([*common, words(rng, 30)]), "h") for i in range(30)]  # depleted
    rows += [(200 + i, "\n".join([*common, words(rng, 30)]), f"h{i}") for i in range(30)]  # one document of each host
    rows += [(300 + i, words(rng, 80) if i < 2 else rows[0][1], None) for i in range(5)]
    copy = "\n".join(words(rng, 30) for _ in range(4))
    rows += [(400 + i, copy, "h") for i in range(40)]  # copies under their own keys are documents of their own
    rows += [(500 + i, "\n".join([words(rng, 60), " Read\tMORE", " ", "home", "home"]), "m") for i in range(22)]
    rows += [(600 + i, "\n".join([words(rng, 24), *(["home"] * 30)]), "m") for i in range(2)]  # menus
    return rows + [rows[-1], rows[3], rows[3]]  # repeated rows


@pytest.mark.parametrize("copies", [True, False])
def test_rules_frequent_lines(spark, copies):
    rows = shared_lines(np.random.default_rng(4))
    expected = plain.rules(rows, copies=copies)
    judged = rules.judge(docs(spark, rows), copies=copies)
    assert sorted((r["doc_id"], r["words_removed"], r["kept"]) for r in judged.collect()) == sorted((i, lost, kept) for (i, _, _), (lost, kept, _) in zip(rows, expected, strict=True))
    cleaned = sorted((r["doc_id"], r["text"]) for r in rules.clean(docs(spark, rows), copies=copies).collect())
    assert cleaned == sorted((i, t) for (i, _, _), (_, kept, t) in zip(rows, expected, strict=True) if kept)
    kept = {i for i, _ in cleaned}
    assert kept >= {*range(30), *range(200, 230)} and not kept & set(range(100, 130)) and (400 in kept) is not copies
    assert rules.judge(docs(spark, rows).limit(0)).count() == rules.clean(docs(spark, rows).limit(0)).count() == 0


def test_rules_of_real_documents(spark, sf_dir):
    rows = [(r[0], r[1], r[2]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()]
    expected = plain.rules(rows, 2)
    got = {r["doc_id"]: (r["words_removed"], r["kept"]) for r in rules.judge(docs(spark, rows), max_docs=2).collect()}
    assert got == {i: x[:2] for (i, _, _), x in zip(rows, expected, strict=True)} and any(x[0] for x in expected)


def test_joins_beyond_the_broadcast_bound(spark, monkeypatch):
    """Everything shuffles, hot keys are salted; the results are the same."""
    for module in (rules, linetemplates):
        monkeypatch.setattr(module, "small", lambda df, *a, **k: df)
    monkeypatch.setattr(common, "is_small", lambda df, *a, **k: False)
    rows = shared_lines(np.random.default_rng(4))
    got = sorted((r["doc_id"], r["words_removed"], r["kept"]) for r in rules.judge(docs(spark, rows)).collect())
    assert got == sorted((i, lost, kept) for (i, _, _), (lost, kept, _) in zip(rows, plain.rules(rows), strict=True))
    lines = sorted((r["doc_id"], r["text"]) for r in linetemplates.drop_templates(docs(spark, rows)).collect())
    assert lines == sorted((i, plain.without(t, gone)) for (i, t, _), gone in zip(rows, plain.template_lines(rows), strict=True))


def test_components(spark):
    rng = np.random.default_rng(6)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(root)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_stars(spark, monkeypatch):
    """Stars are known as such, so no step is spent on what is settled; of_stars() reads them."""
    stars = [(5, 1), (1, 7), (9, 1), (4, 3), (3, 4)]
    want = {1: 1, 5: 1, 7: 1, 9: 1, 3: 3, 4: 3}
    with monkeypatch.context() as m:
        m.setattr("pagespan.llm.components._star", None)
        assert {r["node"]: r["component"] for r in components(spark.createDataFrame(stars, "a long, b long")).collect()} == want
    chain = [(1, 2), (2, 3), (7, 3), (8, 9)]
    assert sorted(map(tuple, components(spark.createDataFrame(chain, "a long, b long")).collect())) == [(1, 1), (2, 1), (3, 1), (7, 1), (8, 8), (9, 8)]


@pytest.mark.parametrize(("few", "files"), [(100_000, 1), (0, 16)])
def test_components_of_few_edges(spark, monkeypatch, few, files):
    """A table that one task can take is read by one and written as one file, however many partitions a shuffle has; a larger one is dealt out, with the same components."""
    written, plain_store = [], common.storage.store

    def store(df, name):
        out = plain_store(df, name)
        written.append(len(list(Path(out._pagespan_path).glob("part-*"))))
        return out

    monkeypatch.setattr(common.storage, "store", store)
    monkeypatch.setattr(common, "FEW_ROWS", few)
    held = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        chain = spark.createDataFrame([(i, i + 1) for i in range(300) if i % 60 < 59], "a long, b long")
        assert {tuple(r) for r in components(chain).collect()} == {(i, i - i % 60) for i in range(300)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(written) > 2 and set(written) == {files}


def planted(rng):
    rows, i = [], 0
    for group in range(12):
        text = words(rng, int(rng.integers(20, 150))).split()
        for _ in range(int(rng.integers(1, 14))):
            copy = list(text)
            for _ in range(int(rng.integers(0, max(2, len(text) // 25)))):
                copy[int(rng.integers(len(copy)))] = "new" + str(int(rng.integers(1000)))
            rows.append((i * 3 % 997, " ".join(copy) if i % 5 else " ".join(copy).upper(), None))
            i += 1
    passage = words(rng, 60)
    rows += [(2000 + j, passage + " " + words(rng, 40), None) for j in range(40)]
    chain = words(rng, 100).split()
    for j in range(10):  # each near the one before it
        chain = chain[3:] + words(rng, 3).split()
        rows.append((3000 + j, " ".join(chain), None))
    return rows + [(4000, None, None), (4001, "", None), (4002, "  \n", None), (4003, "two words", None), (4004, "Two  WORDS", None), (4005, "É b", None), (4006, "é b", None)]


@pytest.mark.parametrize(("leaf", "block", "depth"), [(1000, 2_000_000, 12), (4, 300, 12), (4, 600, 2)])
def test_near_duplicates(spark, monkeypatch, leaf, block, depth):
    monkeypatch.setattr(nearduplicates, "LEAF", leaf)
    monkeypatch.setattr(nearduplicates, "BLOCK_SHINGLES", block)
    monkeypatch.setattr(nearduplicates, "DEPTH", depth)
    rows = planted(np.random.default_rng(leaf))
    expected = plain.near_duplicates(rows)
    df = docs(spark, rows).withColumn("kept", F.lit("clash"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in nearduplicates.near_duplicates(df).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in expected.items()}


def test_near_duplicates_of_many_rows(spark, monkeypatch):
    """Levels and links that no single task may read."""
    monkeypatch.setattr(common, "FEW_ROWS", 0)
    monkeypatch.setattr(nearduplicates, "LEAF", 4)
    monkeypatch.setattr(nearduplicates, "BLOCK_SHINGLES", 300)
    rows = planted(np.random.default_rng(5))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nearduplicates.near_duplicates(docs(spark, rows)).collect()}
    assert got == plain.near_duplicates(rows)


def test_near_duplicates_edges(spark):
    df = docs(spark, [(None, "a b c d e f", None), (1, "a b c d e f", None), (2, None, None)])
    assert {(r["doc_id"], r["component_id"]) for r in nearduplicates.near_duplicates(df).collect()} == {(None, 1), (1, 1), (2, 2)}
    assert nearduplicates.near_duplicates(df.limit(0)).count() == 0
    rows = planted(np.random.default_rng(9))
    kept = {r["doc_id"] for r in nearduplicates.dedup(docs(spark, rows)).collect()}
    assert kept == {i for i, (_, c) in plain.near_duplicates(rows).items() if i == c}


def recurring(rng):
    head, long = "Served by the", words(rng, 55)
    rows = [(i, "\n".join([words(rng, 30), f"Request 99{i} took 1{i} ms  on host-{i}", f"{head} same {words(rng, 1)} machine in the long row of them all", words(rng, 3)]), "s") for i in range(12)]
    rows += [(100, words(rng, 20) + "\n" + long, "s"), (101, long + "\n" + words(rng, 20), "s"), (102, words(rng, 20) + "\nonly two documents have this", "s"), (103, "only two documents have this\n" + words(rng, 9), "s")]
    rows += [(200, None, "s"), (201, "", "s"), (202, rows[0][1], "s"), (203, words(rng, 8) + "\n\n" + long + "\n", None), (204, words(rng, 4), None), (204, words(rng, 4), None)]
    rows += [(300 + i, "\n".join([words(rng, 30), "All rights reserved.", f" page  {i}", "home", " ", words(rng, 2)]), None) for i in range(5)]
    return rows + [rows[2], rows[2]]


@pytest.mark.parametrize("copies", [True, False])
def test_line_templates(spark, copies):
    rows = recurring(np.random.default_rng(8))
    df = docs(spark, rows).withColumn("n_lines", F.lit("clash"))
    got = sorted((r["doc_id"], r["text"] or "", r["dropped_lines"], r["dropped_tokens"]) for r in linetemplates.drop_templates(df, copies=copies).collect())
    gone = plain.template_lines(rows, copies)
    tokens = [sum(len(WORD.findall((t or "").split("\n")[p])) for p in places) for (_, t, _), places in zip(rows, gone, strict=True)]
    assert got == sorted((i, plain.without(t, g) or "", len(g), n) for (i, t, _), g, n in zip(rows, gone, tokens, strict=True))
    by_id = {r[0]: r for r in got}
    assert by_id[0][2] == 0 and by_id[5][2] == 2 and by_id[304][2] == 3 and by_id[101][2] == 1 and by_id[103][2] == 0 and (by_id[202][2] == 0) is not copies
    assert linetemplates.clean(df.limit(0)).count() == 0
    same = words(np.random.default_rng(1), 9)
    assert linetemplates.clean(docs(spark, [(1, same, None), (2, same + "\n", None), (3, same, None), (4, "", None), (5, None, None)])).count() == 3


def test_line_templates_of_real_documents(spark, sf_dir):
    rows = [(r[0], r[1], None) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    out = {r["doc_id"]: r["text"] for r in linetemplates.drop_templates(docs(spark, rows)).collect()}
    gone = plain.template_lines(rows)
    assert any(gone) and out == {i: plain.without(t, g) for (i, t, _), g in zip(rows, gone, strict=True)}


def test_line_templates_digest_each_document_once(spark, monkeypatch):
    """Not once for each of its lines."""
    seen = spark.sparkContext.accumulator(0)

    def digest(text):
        seen.add(1)
        return text.encode()

    monkeypatch.setattr(linetemplates, "identity", lambda text, key, copies=True: F.udf(digest, "binary")(F.col(text)))
    texts = ["\n".join(f"one more line {a} {b}" for b in "abcdefghij") for a in "uvwx"]
    got = linetemplates.lines_of(docs(spark, [(i, t, None) for i, t in enumerate([*texts, None])]), "text", "doc_id", True).collect()
    assert sorted((r["d"], r["pos"], r["line"], r["n"]) for r in got) == [(i, p, line, 5) for i, t in enumerate(texts) for p, line in enumerate(t.split("\n"))]
    assert seen.value == len(texts) and {(r["d"], bytes(r["id_"]).decode()) for r in got} == set(enumerate(texts))


@pytest.mark.parametrize("few", [True, False])
def test_line_templates_of_few_texts(spark, monkeypatch, few):
    """What is made of few texts goes into few files, however many partitions a shuffle has; that of more texts is dealt out, with the same result."""
    written, plain_store = {}, common.storage.store

    def store(df, name):
        out = plain_store(df, name)
        written.setdefault(name, []).append(len(list(Path(out._pagespan_path).glob("part-*"))))
        return out

    monkeypatch.setattr(common.storage, "store", store)
    monkeypatch.setattr(common, "FEW_TEXT", common.FEW_TEXT if few else 0)
    conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    rows = recurring(np.random.default_rng(12))
    rows += [(9000 + i, f"{words(np.random.default_rng(i), 20)}\nRead all about {words(np.random.default_rng(i + k), 9)}", None) for k in (0, 400) for i in range(k, k + 300)]
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = sorted((r["doc_id"], r["text"] or "") for r in linetemplates.drop_templates(docs(spark, rows)).collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == sorted((i, plain.without(t, g) or "") for (i, t, _), g in zip(rows, plain.template_lines(rows), strict=True))
    assert set(written) == {"leaves", "lines", "classes", "tried", "placed", "recurring", "gone"}
    assert len(written["tried"]) > 1 and max(max(x) for x in written.values()) in (range(1, 9) if few else range(16, 40))


def test_masked_lines(spark):
    odd = ["", " ", "\t", "a b", " a b", "a b ", "a  b", "a\tb", "a\r", "a \u2028", "a\u00a0 b", "7", "x 1a b2 c", "a2  b", "\x0b\x0ca", "é 3ü", "a1b"]
    want = [" ".join("<*>" if any(c in "0123456789" for c in x) else x for x in WORD.findall(line)) for line in odd]
    got = spark.createDataFrame(list(enumerate(odd)), "i int, line string").withColumn("m", linetemplates.masked(F.col("line"))).orderBy("i").collect()
    assert [r["m"] for r in got] == want


def test_line_templates_beyond_eight_leaders(spark, monkeypatch):
    """One leaf with twelve frequent lines and, behind them, a template whose field has no digit; then leaders in the order of one at a time."""
    rng = np.random.default_rng(11)
    busy = [f"Click here to read {words(rng, 7)}" for _ in range(12)]
    rows = [(100 * (k + 1) + j, f"{words(rng, 9)}\n{b}", None) for k, b in enumerate(busy) for j in range(2)]
    rows += [(5000 + j, f"{words(rng, 9)}\nClick here to read more about {words(rng, 1)} today and every day", None) for j in range(6)]
    texts = {i: t.split("\n") for i, t, _ in rows}
    out = {r["doc_id"]: r["text"].split("\n") for r in linetemplates.drop_templates(docs(spark, rows)).collect()}
    assert all(out[i] == texts[i][: 1 if 5000 < i else 2] for i in texts)
    monkeypatch.setattr(linetemplates, "BATCH", 4)
    near = []
    for _ in range(60):
        w = busy[int(rng.integers(3))].split()
        near.append(" ".join(w[:4] + [x if rng.random() < 0.6 else str(rng.choice(["x", "y"])) for x in w[4:]]))
    rows = [(i, f"{words(rng, 9)}\n{x}", None) for i, x in enumerate(near)]
    gone = plain.template_lines(rows)
    assert {r["doc_id"] for r in linetemplates.drop_templates(docs(spark, rows)).where("dropped_lines > 0").collect()} == {i for i, g in enumerate(gone) if g}


def test_pipeline_stages(spark, sf_dir):
    """Each stage against its plain version, on what the stage before it kept; the last against its contract."""
    rng = np.random.default_rng(3)
    real = [(r[0], r[1], r[2]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()]
    made = [(10_000 + i, t, s) for i, t, s in shared_lines(rng)[:-3]] + [(20_000 + i, t, None) for i, t, _ in planted(rng)]
    made += [(30_000 + i, f"{words(rng, 70)}\nWritten by {words(rng, 1)} for all who read it\n{words(rng, 9)}", "t") for i in range(9)]
    rows = real + made
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "line_dedup", "near_dedup", "source_mix", "pack_sequences"]

    def through(name, rows):
        out = stages[name](spark, docs(spark, rows), "")
        return out, [] if name == "pack_sequences" else sorted(((r["doc_id"], r["text"], r["source"]) for r in out.collect()), key=lambda r: r[0])

    def same(got, expected):
        assert got == sorted(expected, key=lambda r: r[0])

    _, ruled = through("quality_rules", rows)
    same(ruled, [(i, t, s) for (i, _, s), (_, kept, t) in zip(rows, plain.rules(rows), strict=True) if kept])
    _, lined = through("line_dedup", ruled)
    left = [(i, plain.without(t, g), s, g) for (i, t, s), g in zip(ruled, plain.template_lines(ruled), strict=True)]
    same(lined, [(i, t, s) for i, t, s, g in left if not g or WORD.search(t)])
    _, single = through("near_dedup", lined)
    of = plain.near_duplicates(lined)
    same(single, [r for r in lined if of[r[0]][1] == r[0]])
    _, mixed = through("source_mix", single)
    same(mixed, [r for r, n in zip(single, plain.times(single), strict=True) for _ in range(n)])
    assert len(rows) > len(ruled) > len(single) > 100
    packed = through("pack_sequences", mixed)[0].collect()
    total = {}
    for r in packed:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    assert set(total) == {i for i, _, _ in mixed}
