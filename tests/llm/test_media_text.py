import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagespan.llm import langid, ogg, quality
from pagespan.llm.common import held_out

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def docs(spark, rows):
    return spark.createDataFrame([(i, t, l, s, len(t or "")) for i, t, l, s in rows], DOCS)


def bitwise_crc(data):
    c = 0
    for x in data:
        c ^= x << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
    return c


def test_page_crc_matches_bitwise_form():
    for data in (b"", b"a", b"OggS" * 100, bytes(range(256))):
        assert ogg.page_crc(data) == bitwise_crc(data)


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=1000), st.integers(1, 300))
def test_ogg_round_trip(data, times):
    payload = ogg.pad(data * times)
    d = ogg.decode(ogg.encode(payload))
    assert d["payload"] == payload and (d["bad"], d["lost"], d["gaps"]) == (0, 0, 0)
    assert d["seconds"] == len(payload) / ogg.RATE


def test_ogg_reports_damage():
    payload = ogg.pad(bytes(range(256)) * 1200)
    media = bytearray(ogg.encode(payload))
    media[len(media) // 2] ^= 1
    d = ogg.decode(bytes(media))
    assert d["bad"] >= 1 and d["gaps"] >= 1 and len(d["payload"]) < len(payload)
    assert ogg.decode(b"")["packets"] == 0 and ogg.decode(b"junk")["bad"] == 1


def test_ogg_survives_damage_anywhere():
    """Any byte changed, any cut: no crash, and what comes back are whole samples from their places."""
    payload = ogg.pad(bytes(range(256)) * 40)
    media = ogg.encode(payload)
    for i in range(0, len(media), 7 if len(media) > 3000 else 1):
        for damaged in (media[:i] + bytes([media[i] ^ 0x55]) + media[i + 1 :], media[:i], media[i:]):
            d = ogg.decode(damaged)
            assert len(d["payload"]) <= len(payload) and (d["payload"] == payload or d["bad"] + d["lost"] + d["gaps"] or d["packets"] < 3)


def test_ogg_without_a_header_page_and_with_a_foreign_stream():
    payload = ogg.pad(bytes(range(256)) * 100)
    media = bytearray(ogg.encode(payload))
    media[30] ^= 1  # the first stream's header
    d = ogg.decode(bytes(media))
    assert d["bad"] == 1 and d["lost"] >= 1 and d["packets"] >= 1 and d["gaps"] >= 1
    other = ogg._Stream(77)
    other.page(ogg._lacing(5), b"other", 0, 2, -1)
    other.page(ogg._lacing(3), b"abc", 3, 4, 3)
    mixed = other.pages[0][2] + ogg.encode(payload) + other.pages[1][2]
    d = ogg.decode(mixed)
    assert d["payload"] == payload and (d["bad"], d["lost"], d["streams"]) == (0, 0, 3)


def test_ogg_null_media(spark):
    df = spark.createDataFrame([(1, None), (2, b""), (3, b"OggSjunk")], "doc_id long, media binary")
    rows = {r["doc_id"]: r for r in ogg.decode_column(df).collect()}
    assert rows[1]["payload_bytes"] is None and rows[2]["payload_bytes"] == 0 and rows[3]["bad_pages"] == 1


def test_ogg_column(spark):
    texts = ["", None, "é" * 5000, "same", "same", "x" * 200_000]
    df = docs(spark, [(i, t, None, None) for i, t in enumerate(texts)]).withColumn("media", F.lit("clash"))
    rows = {r["doc_id"]: r for r in ogg.decode_column(ogg.encode_column(df)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r["bad_pages"] == 0 and r["lost_packets"] == 0
    assert rows[3]["media_sha256"] == rows[4]["media_sha256"]
    assert ogg.decode_column(ogg.encode_column(df.limit(0))).count() == 0


def test_ngram_counts_do_not_depend_on_case_or_marks():
    a, n = langid.ngram_counts("Hello, WORLD")
    b, _ = langid.ngram_counts("hello --- world 77")
    assert n == 10 and (a == b).all()
    assert langid.ngram_counts("12 !")[1] == 0


def plain_ngrams(text):
    """Bucket counts of the n-grams of each word framed by blanks, one after another."""
    counts, letters = {}, 0
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        letters += len(word)
        framed = [32, *map(ord, word), 32]
        for n in langid.ORDERS:
            for i in range(len(framed) - n + 1):
                gram = framed[i : i + n]
                if n == 1 and gram == [32]:
                    continue
                h = 0
                for x in gram:
                    h = (h * 0x01000193 + x) % 2**32
                b = ((h + n) * 0x9E3779B1 % 2**32) >> 18
                counts[b] = counts.get(b, 0) + 1
    return counts, letters


def test_langid_against_a_plain_version(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.fit(df, ~held_out())
    got = {r["doc_id"]: r for r in langid.predict(df, model, keep_text=True).collect()}
    for r in [*got.values()]:
        counts, letters = plain_ngrams(r["text"] or "")
        assert letters == r["n_letters"]
        if not letters:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        total = sum(counts.values())
        z = [(sum(n * float(model.table[b, k]) for b, n in counts.items()) / total + float(model.bias[k])) / model.temperature for k in range(len(model.langs))]
        e = np.exp(np.array(z) - max(z))
        p = e / e.sum()
        assert r["score"] == pytest.approx(p.max(), abs=1e-3) and p[model.langs.index(r["lang_pred"])] == pytest.approx(p.max(), abs=1e-3)
        assert r["rejected"] == (r["score"] < model.threshold)
    held = [r for r in got.values() if r["lang"] and r["n_letters"] and r["doc_id"] and held_out_id(r["doc_id"])]
    assert len(held) > 20 and np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.8  # learned from 200 rows


def held_out_id(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_langid_bounds_its_sample(spark):
    """A label for almost every row: the most frequent are learned, from a bounded number of rows."""
    rows = [(i, f"some words of text number {i}", f"l{i % 900:03d}" if i % 3 else "main", None) for i in range(3000)]
    model = langid.fit(docs(spark, rows), F.lit(True), langs=20, rows=200)
    assert len(model.langs) <= 20 and "main" in model.langs
    out = langid.predict(docs(spark, rows), model)
    assert out.count() == 3000 and out.where("lang_pred not like 'l%' and lang_pred <> 'main'").count() == 0


def test_langid_learns_and_rejects(spark):
    rng = np.random.default_rng(1)
    parts = {"aa": ["ka", "lo", "mi"], "bb": ["str", "ung", "icht"]}
    rows = [(i, " ".join("".join(rng.choice(parts[l], 3)) for _ in range(30)), l, "s") for i in range(300) for l in [["aa", "bb"][i % 2]]]
    rows += [(1000, None, "aa", None), (1001, "1234 !!", "bb", None), (None, "kalomi kalo", None, None), (1002, "", None, None)]
    df = docs(spark, rows)
    out = langid.predict(df.withColumn("score", F.lit(9)), langid.fit(df, ~held_out())).collect()
    known = {r["doc_id"]: r for r in out}
    assert len(out) == len(rows)
    right = [known[i]["lang_pred"] == l for i, _, l, _ in rows[:300]]
    assert np.mean(right) > 0.98
    assert {known[i]["lang_pred"] for i in (1000, 1001, 1002)} == {"und"} and known[None]["lang_pred"] == "aa"
    assert all(0 <= r["score"] <= 1 for r in out)
    nobody = langid.fit(df.where("doc_id < 0"), F.lit(True))
    assert nobody is None and langid.predict(df, nobody).where("lang_pred <> 'und'").count() == 0


def test_machine_sums_pairs_in_linear_time():
    rng = np.random.default_rng(3)
    m = quality.Model(0.3, rng.normal(size=20), rng.normal(size=(20, 4)), 1.0, 0.0)
    ids, x = np.array([1, 5, 7, 19]), rng.normal(size=4)
    pairs = sum(float(m.factors[ids[i]] @ m.factors[ids[j]]) * x[i] * x[j] for i in range(4) for j in range(i))
    assert m.margin(ids, x) == pytest.approx(0.3 + float(m.linear[ids] @ x) + pairs)


def test_quality_learns(spark):
    rng = np.random.default_rng(2)
    good = lambda: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(60)) + "."
    bad = lambda: " ".join("".join(rng.choice(list("abcdefgh"), 5)) + "###" for _ in range(60))
    rows = [(i, good() if i % 3 else bad(), None, None) for i in range(400)] + [(500, None, None, None), (501, "", None, None)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(400)] + [(500, None, None)], "doc_id long, quality int, toxic int")
    df = docs(spark, rows)
    out = {r["doc_id"]: r for r in quality.score(df, quality.fit(df, labels, ~held_out(), meta=("n_chars",)), meta=("n_chars",)).collect()}
    assert np.mean([out[i]["predicted"] == int(i % 3 > 0) for i in range(400)]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out.values()) and len(out) == 402
    assert quality.fit(df, labels.limit(0), F.lit(True)) is None
