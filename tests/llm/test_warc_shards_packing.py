import hashlib
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
import zstandard as zstd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagespan.llm import common, mixing, packing, sharding, warc

from . import plain


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_warc_round_trip(spark):
    long, short = "<p>" + "y" * 200, "tiny"
    rows = [(5, "http://a/5", long), (3, "http://a/3", long), (9, None, long), (1, "u\r\nX: y", short), (2, "u", short), (7, "u", None), (8, "u", ""), (4, "u", "é" * 90_000)]
    df = pages(spark, rows).withColumn("payload_digest", F.lit("clash")).drop("payload_digest")
    out = {r["key"]: r for r in warc.records(warc.write(df)).collect()}
    assert len(out) == len(rows)
    for i, _, h in rows:
        raw, r = (h or "").encode(), out[str(i)]
        assert (r["payload_bytes"], r["payload_digest"], r["error"]) == (len(raw), hashlib.sha256(raw).hexdigest(), None)
        assert (r["record_type"], r["refers_to"]) == (("revisit", "3") if i in (5, 9) else ("response", None))
        assert r["payload"] is None if i in (5, 9) else bytes(r["payload"]) == raw
    assert warc.records(warc.write(df.limit(0))).count() == 0


def test_warc_dictionary_and_damage(spark):
    texts = [f"<html><body>{'abc' * 20} page {i} {'tail ' * 30}</body></html>" for i in range(300)]
    archive = warc.write(pages(spark, list(enumerate([""] * 0)) or [(i, f"u{i}", t) for i, t in enumerate(texts)]).coalesce(1)).collect()[0]["content"]
    assert int.from_bytes(archive[:4], "little") == warc.DICT_FRAME
    assert [r["key"] for r in warc.read(bytes(archive))] != [] and all("error" not in r for r in warc.read(bytes(archive)))
    n = int.from_bytes(archive[4:8], "little") + 8
    damaged = bytearray(archive)
    damaged[n + 12] ^= 0xFF
    got = list(warc.read(bytes(damaged)))
    assert sum("error" in r for r in got) >= 1 and sum("error" not in r for r in got) >= 200
    assert any("error" in r for r in warc.read(bytes(archive[:-3])))


def test_warc_with_a_damaged_dictionary_and_foreign_frames(spark):
    texts = [f"<html><body>{'abc' * 20} page {i} {'tail ' * 30}</body></html>" for i in range(300)]
    archive = bytes(warc.write(pages(spark, [(i, f"u{i}", t) for i, t in enumerate(texts)]).coalesce(1)).collect()[0]["content"])
    n = int.from_bytes(archive[4:8], "little")
    cut = list(warc.read(archive[: n // 2]))
    assert len(cut) == 1 and "cut off" in cut[0]["error"]
    for bad in (zstd.FRAME_HEADER + archive[12:], archive[:8] + zstd.FRAME_HEADER + b"\xff" * (n - 4) + archive[8 + n :]):
        got = list(warc.read(bad))
        assert got and all("error" in r for r in got)
    raw = lambda i: zstd.compress(warc.record(str(i), "u", b"p%d" % i, hashlib.sha256(b"p%d" % i).hexdigest(), 2, None))
    skip = (0x184D2A53).to_bytes(4, "little") + (5).to_bytes(4, "little") + b"hello"
    assert [r["key"] for r in warc.read(raw(1) + skip + raw(2) + skip)] == ["1", "2"]
    packed = zstd.compress(archive[8 : 8 + n])
    assert [r["key"] for r in warc.read(warc.lead(packed) + archive[8 + n :])] == [r["key"] for r in warc.read(archive)]
    small = raw(1) + skip + raw(2)
    for i in range(len(small)):
        for damaged in (small[:i] + bytes([small[i] ^ 0x5A]) + small[i + 1 :], small[:i]):
            assert all("error" in r or r["payload_bytes"] == len(r["payload"]) for r in warc.read(damaged))
    df = spark.createDataFrame([("a", None), ("b", bytearray(raw(7))), ("c", bytearray(b""))], "archive string, content binary")
    assert sorted((r["archive"], r["key"], r["error"]) for r in warc.records(df).collect()) == [("a", None, "no content"), ("b", "7", None)]


def test_warc_many_repeated_digests_and_the_bounded_dictionary(spark, monkeypatch):
    rows = [(i, "u", f"{i % 7} " * 100) for i in range(60)] + [(100 + i, "u", "z" * (1 << 20)) for i in range(3)]
    df = pages(spark, rows)
    expected = {str(i): str(min(k for k, _, x in rows if x == t)) for i, _, t in rows}
    for few in (True, False):
        if not few:
            monkeypatch.setattr(warc, "is_small", lambda df: False)
        got = {r["key"]: r["refers_to"] or r["key"] for r in warc.records(warc.write(df)).collect()}
        assert got == expected
    distinct = pages(spark, [(i, "u", f"<p>{i} " + "abc " * (i % 50 + 20)) for i in range(300)])
    known = warc.train_dictionary(distinct, "page_id", "html")
    assert known and known == warc.train_dictionary(distinct.repartition(9), "page_id", "html")
    monkeypatch.setattr(warc, "SAMPLE_BYTES", 500)
    assert warc.train_dictionary(distinct, "page_id", "html") == b""


@pytest.mark.parametrize("change", [lambda r: r.replace(b"WARC/1.1", b"WORC/1.1"), lambda r: r[:-1], lambda r: r.replace(b"payload", b"PAYLOAD", 1), lambda r: r.replace(b"Content-Length: ", b"Content-Length: 9", 1), lambda r: r.replace(b"WARC-Type: response", b"WARC-Type response")])
def test_warc_validates(change):
    body = b"some payload"
    raw = warc.record("1", "u", body, hashlib.sha256(body).hexdigest(), len(body), None)
    assert warc.parse(raw)["payload"] == body
    changed = change(raw) if b"some payload" in raw else raw
    assert list(warc.read(zstd.compress(raw)))[0]["key"] == "1"
    with pytest.raises(ValueError):
        warc.parse(changed if changed != raw else b"")


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 1 << 40))
def test_feistel_is_a_permutation(n, seed):
    p = sharding.permute(np.arange(n), n, seed)
    assert sorted(p.tolist()) == list(range(n))
    assert (sharding.unpermute(p, n, seed) == np.arange(n)).all()
    assert sharding.row_at(*sharding.locate(n // 2, n, 8, seed), n, 8, seed) == n // 2


def test_shards(spark):
    df = spark.createDataFrame([(i % 500 if i % 7 else None, "x", 1) for i in range(1001)], "doc_id long, text string, shard int").repartition(5)
    rows = sharding.shard(df, ["doc_id", "text"], 8, 5).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert len(rows) == 1001 and sorted(r["row_number"] for r in rows) == list(range(1001))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    ids = [r["doc_id"] for r in sorted(rows, key=lambda r: r["row_number"])]
    assert ids == sorted(ids, key=lambda x: -1 if x is None else x)
    again = {(r["row_number"], r["shard"], r["slot"]) for r in sharding.shard(df.repartition(2), ["doc_id", "text"], 8, 5).collect()}
    assert again == {(r["row_number"], r["shard"], r["slot"]) for r in rows}
    assert sharding.shard(df.limit(0), ["doc_id"], 8, 5).count() == 0


def deficits(totals, capacity):
    """Deficit round-robin one window after another: quantum in, whole tokens out, the fraction carried on."""
    n, step = sum(totals), max(1, capacity - sum(x > 0 for x in totals))
    carried, out, left = [Fraction(0)] * len(totals), [], n
    while left:
        size = min(step, left)
        row = []
        for i, x in enumerate(totals):
            carried[i] += Fraction(size * x, n)
            row.append(int(carried[i]))
            carried[i] -= row[-1]
        out.append(row)
        left -= size
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=6), st.integers(20, 400))
def test_plan_is_deficit_round_robin(totals, capacity):
    phases = packing.plan(totals, None, capacity)
    if not sum(totals):
        assert phases == []
        return
    (phase,) = phases
    got = [[b - a for a, b in zip(phase.served(t), phase.served(t + 1), strict=True)] for t in range(phase.windows)]
    assert got == deficits(totals, capacity)
    assert all(sum(w) <= capacity for w in got)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3000), st.integers(0, 9)), min_size=1, max_size=6))
def test_plan_with_weights_serves_all(queues):
    totals, weights = [q[0] for q in queues], [q[1] for q in queues]
    phases = packing.plan(totals, weights, 256)
    assert [sum(p.take[i] for p in phases) for i in range(len(totals))] == totals
    for p in phases:
        assert p.served(p.windows) == [a + b for a, b in zip(p.base, p.take, strict=True)]


def test_packing(spark):
    texts = [None, "", "one two three", "word " * 5000, "é ß 漢字 " * 50] + [f"text number {i} " * (i % 40) for i in range(200)]
    rows = [(i, t, [None, "a", "b", "hot"][min(3, i % 9)], 1) for i, t in enumerate(texts)] + [(2, "one two three", "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, length int").repartition(3)
    pieces = [r.asDict() for r in packing.pack(df, length=256, window=4).collect()]
    encode = packing.encoder("byte_bpe_50k.json")
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_seq[p["sequence_id"]].append(p)
    for i, t, _, _ in rows:
        ids = np.append(encode(t or ""), 1).astype("<u4")
        own = sorted(by_doc[i], key=lambda p: p["start"])
        if i != 2:
            assert [p["start"] for p in own] == [sum(q["length"] for q in own[:k]) for k in range(len(own))]
            assert sum(p["length"] for p in own) == len(ids)
        for p in own:
            assert p["doc_tokens"] == len(ids) and zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"]
    for own in by_seq.values():
        own.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in own] == [sum(q["length"] for q in own[:k]) for k in range(len(own))] and sum(p["length"] for p in own) <= 256
    total = Counter()
    for p in pieces:
        total[p["source"]] += p["length"]
    n = sum(total.values())
    windows = defaultdict(Counter)
    for p in pieces:
        windows[p["window_id"]][p["source"]] += p["length"]
    for w in windows.values():
        assert all(abs(w[s] - sum(w.values()) * total[s] / n) < 2 for s in total)
    joined = packing.sequences(packing.pack(df, length=256, window=4)).agg(F.sum("n_tokens"), F.sum(F.octet_length("ids"))).first()
    assert tuple(joined) == (n, 4 * n)
    assert packing.pack(df.limit(0)).count() == 0


def test_packing_more_sources_than_queues(spark):
    """The largest sources hold their share in each window, the others together; nothing is lost."""
    rows = [(i, f"text number {i} " * (1 + i % 9), "big" if i % 2 else f"s{i:04d}") for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    pieces = packing.pack(df, length=256, window=4, queues=3).collect()
    encode = packing.encoder("byte_bpe_50k.json")
    got, places = Counter(), Counter()
    for p in pieces:
        got[p["doc_id"], p["source"]] += p["length"]
        places[p["sequence_id"]] += p["length"]
    assert got == {(i, s): len(encode(t)) + 1 for i, t, s in rows}
    assert max(places.values()) <= 256 and sum(places.values()) > 0.98 * 256 * len(places)
    total = sum(got.values())
    share = sum(n for (_, s), n in got.items() if s == "big") / total
    windows = defaultdict(Counter)
    for p in pieces:
        windows[p["window_id"]][p["source"] == "big"] += p["length"]
    assert all(abs(w[True] - share * sum(w.values())) < 2 for w in windows.values())
    with pytest.raises(ValueError):
        packing.pack(df, weights={"a": 1, "b": 1, "c": 1}, queues=3)


def test_both_libraries_give_the_same_ids(spark, sf_dir):
    a, b = packing.encoder("byte_bpe_50k.json"), packing.encoder("byte_bpe_50k.tiktoken")
    texts = [r[0] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    for t in [*texts, "", " ", "\n\n  x", "a b", "don't  stop\t\n", "1234567", "🙂🙂", "'s 'S", "x" * 3000]:
        assert a(t).tolist() == b(t).tolist()


def test_both_libraries_give_the_same_ids_for_added_tokens():
    a, b = packing.encoder("byte_bpe_50k.json"), packing.encoder("byte_bpe_50k.tiktoken")
    end = "<|endoftext|>"
    assert b(f"see {end} here").tolist() == [3826, 220, 50256, 994]
    for t in [end, end * 3, f"a{end}b", f"  {end}\n\n {end}  x", f"<|{end}|>", end[:-1], end.upper(), f"it{end}'s", f"é🙂 {end} 漢"]:
        assert a(t).tolist() == b(t).tolist(), t


def test_water_fill(spark):
    rng = np.random.default_rng(2)
    for k in range(12):
        sizes, weights = [int(x) for x in rng.integers(0, 1000, rng.integers(1, 9)) * rng.integers(0, 2 + k)], []
        weights = [int(rng.choice([5, 2, 1])) for _ in sizes]
        df = spark.createDataFrame([(i, n, float(w)) for i, (n, w) in enumerate(zip(sizes, weights, strict=True))], "i int, n long, w double")
        target = [r["target"] for r in mixing.water_fill(df, sum(sizes)).orderBy("i").collect()]
        assert target == pytest.approx(plain.fill(sizes, weights, sum(sizes)), abs=1e-6) and sum(target) == pytest.approx(sum(sizes))


def test_mix(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "w " * int(rng.integers(1, 300)), ["b", "a", None, "c"][i % 4 if i % 5 else 1], "keep") for i in range(2000)]
    rows += [(5000, None, "b", "keep"), (5001, "", "nowords", "keep"), (None, "x y", "a", "keep")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target string")
    out = mixing.mix(df).collect()
    assert len(out) == len(rows)
    got, sizes, targets = Counter(), Counter(), {}
    for r in out:
        assert r["size"] == len((r["text"] or "").split()) and 0 <= r["times"] <= 3
        got[r["source"]] += r["size"] * r["times"]
        sizes[r["source"]] += r["size"]
        targets[r["source"]] = r["target"]
    names = ["a", "b", "c", "nowords", None]
    assert [targets[n] for n in names] == pytest.approx(plain.fill([sizes[n] for n in names], [5, 2, 1, 5, 2], sum(sizes.values())))
    assert all(abs(got[n] - targets[n]) <= 0.02 * targets[n] + 300 for n in names)
    key = lambda rs: sorted((str(r["doc_id"]), r["times"]) for r in rs)
    assert key(mixing.mix(df.repartition(7)).collect()) == key(out)
    assert mixing.sample(df).count() == sum(r["times"] for r in out) and mixing.sample(df).columns == df.columns
    assert mixing.mix(df.limit(0)).count() == 0
    times = plain.times([(r["doc_id"], r["text"], r["source"]) for r in out])
    assert [r["times"] for r in out] == times


def test_mix_of_many_sources(spark, monkeypatch):
    """Beyond the broadcast bound, and with a source for almost every row."""
    monkeypatch.setattr(common, "is_small", lambda df, *a, **k: False)
    rows = [(i, "w " * (1 + i * 7 % 50), f"s{i % 700}" if i % 3 else "hot") for i in range(2000)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r["doc_id"]: r["times"] for r in out} == dict(enumerate(plain.times(rows)))
    given = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights={"hot": 2, "s1": 1}, share=0.01)
    assert {r["source"] for r in given.where("times > 0").collect()} <= {"hot", "s1"}
