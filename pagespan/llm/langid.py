"""Language identification: averaged embeddings of hashed letter n-grams inside words, a linear softmax on top, trained
by stochastic gradient descent in numpy on a bounded sample for each language, with a temperature and a rejection
threshold set on rows kept out of the training.

Null texts, empty ones and texts without a letter are `und` with score 0. Only text and lang of training rows are learned
from; a table without any gives `und` everywhere, an empty one stays empty. Whole texts count, very long ones in pieces.
Rows with equal texts get equal answers; of languages with equal probabilities the first by name is taken. Further
columns pass through, those named as an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, ensure_importable

BUCKETS, DIMS, ORDERS, PIECE = 1 << 14, 16, (1, 2, 3), 1 << 20
#: Bounds of the training sample, whose rows are drawn by a hash: about so many rows for each language, and so many languages, the most frequent (of equals the first by name);
#: in all about so many rows, and bytes of features, if every n-gram of a text falls into its own bucket. Beyond, each language gives less in proportion.
ROWS_PER_LANG, LANGS, ROWS, BYTES = 800, 500, 40_000, 256 << 20
SEED, EPOCHS, BATCH, RATE = 17, 15, 32, 40.0
#: Share of right answers that the rejection may turn down, on the calibration rows.
REJECT = 0.01
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def ngram_counts(text: str) -> tuple[np.ndarray, int]:
    """How often each bucket's n-grams occur (words framed by a blank, lower case), and the number of letters."""
    counts, letters = np.zeros(BUCKETS, np.int64), 0
    for a in range(0, len(text), PIECE):
        points = np.frombuffer(text[a : a + PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = _is_letter()[points]
        letters += int(np.count_nonzero(is_letter))
        x = np.full(len(points) + 2, 32, np.uint32)
        x[1:-1] = np.where(is_letter, points, 32)
        blank = x == 32
        keep = np.ones(len(x), bool)
        keep[1:] = ~(blank[1:] & blank[:-1])
        x, blank = x[keep], blank[keep]
        h = np.zeros(len(x), np.uint32)
        for n in range(1, max(ORDERS) + 1):
            if len(x) < n:
                break
            h = h[: len(x) - n + 1] * np.uint32(0x01000193) + x[n - 1 :]
            if n not in ORDERS:
                continue
            ok = ~blank if n == 1 else np.ones(len(h), bool)
            for j in range(1, n - 1):
                ok &= ~blank[j : len(h) + j]
            if n == 2:
                ok &= ~(blank[:-1] & blank[1:])
            ids = ((h[ok] + np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(18)
            counts += np.bincount(ids, minlength=BUCKETS)
    return counts, letters


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # buckets x languages: embeddings times the softmax layer
    bias: np.ndarray
    temperature: float
    threshold: float

    def score(self, counts: np.ndarray) -> np.ndarray:
        z = (counts.astype(np.float32) @ self.table / max(1, counts.sum()) + self.bias) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


def _probabilities(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(rows: list[tuple[bytes, bytes]], labels: list[str], seed: int = SEED) -> Model | None:
    """rows: bucket numbers (uint16) and shares (float32) of each text. A fifth of them calibrates."""
    langs = sorted(set(labels))
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    y = np.array([langs.index(x) for x in labels])
    order = rng.permutation(len(y))
    held, own = (order[: len(y) // 5], order[len(y) // 5 :]) if len(y) >= 50 else (order, order)
    e = rng.uniform(-1 / DIMS, 1 / DIMS, (BUCKETS, DIMS)).astype(np.float32)
    w, bias = np.zeros((DIMS, len(langs)), np.float32), np.zeros(len(langs), np.float32)

    def dense(ids: np.ndarray) -> np.ndarray:
        x = np.zeros((len(ids), BUCKETS), np.float32)
        for i, k in enumerate(ids):
            x[i, np.frombuffer(rows[k][0], np.uint16)] = np.frombuffer(rows[k][1], np.float32)
        return x

    steps, done = EPOCHS * max(1, len(own) // BATCH), 0
    for _ in range(EPOCHS):
        rng.shuffle(own)
        for a in range(0, len(own), BATCH):
            ids = own[a : a + BATCH]
            x = dense(ids)
            h = x @ e
            g = _probabilities(h @ w + bias)
            g[np.arange(len(ids)), y[ids]] -= 1
            g /= len(ids)
            rate = RATE * max(0.02, 1 - done / steps)
            down = g @ w.T
            w -= rate / 40 * DIMS * (h.T @ g)
            bias -= 0.02 * g.sum(axis=0)
            used = np.flatnonzero(x.any(axis=0))
            e[used] -= rate * (x[:, used].T @ down)
            done += 1
    z = np.concatenate([dense(held[a : a + 256]) @ e @ w + bias for a in range(0, len(held), 256)])
    loss = lambda t: -np.log(_probabilities(z / t)[np.arange(len(held)), y[held]] + 1e-12).mean()
    temperature = float(min(np.geomspace(0.05, 20, 60), key=loss))
    p = _probabilities(z / temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == y[held]]
    return Model(langs, e @ w, bias, temperature, float(np.quantile(right, REJECT)) if len(right) else 0.0)


def fit(df: DataFrame, may_learn: Column, text: str = "text", lang: str = "lang", key: str = "doc_id", per_lang: int = ROWS_PER_LANG, langs: int = LANGS, rows: int = ROWS, held: int = BYTES) -> Model | None:
    """Learn from about per_lang rows of each language among those for which may_learn holds, within the bounds above."""
    ensure_importable(df.sparkSession)
    known = df.where(may_learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("t"), F.col(lang).alias("l"), F.col(key).alias("k"))
    size = F.least(F.lit(6 * len(ORDERS)) * F.octet_length("t"), F.lit(6 * BUCKETS)).cast("long")
    found = known.groupBy("l").agg(F.count("*").alias("n"), F.sum(size).alias("b")).orderBy(F.desc("n"), "l").limit(langs).collect()
    p = {r["l"]: min(1.0, per_lang / r["n"]) for r in found}
    less = min(1.0, rows / max(1.0, sum(p[r["l"]] * r["n"] for r in found)), held / max(1.0, sum(p[r["l"]] * r["b"] for r in found)))
    share = df.sparkSession.createDataFrame([(x, p[x] * less) for x in p], f"l {known.schema['l'].dataType.simpleString()}, p double")
    draw = F.pmod(F.xxhash64(F.col("k").cast("string"), F.lit(SEED)), F.lit(1_000_000)) / 1e6
    sample = known.join(F.broadcast(share), "l").where(draw < F.col("p")).select("l", "t")  # a row for each of at most `langs` languages

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for l, t in zip(part.l, part.t, strict=True):
                counts, letters = ngram_counts(t)
                ids = np.flatnonzero(counts)
                if letters:
                    out.append((l, ids.astype(np.uint16).tobytes(), (counts[ids] / counts.sum()).astype(np.float32).tobytes()))
            yield pd.DataFrame(out, columns=["l", "ids", "shares"])

    got = sorted(tuple(r) for r in sample.mapInPandas(run, "l string, ids binary, shares binary").collect())
    return train([(bytes(a), bytes(b)) for _, a, b in got], [x for x, _, _ in got])


def predict(df: DataFrame, model: Model | None, text: str = "text", keep_text: bool = False) -> DataFrame:
    """df with lang_pred, score, rejected (the score is below the calibrated threshold) and n_letters."""
    more = {"lang_pred": T.StringType(), "score": T.DoubleType(), "rejected": T.BooleanType(), "n_letters": T.LongType()}

    def one(t: str | None) -> tuple:
        counts, letters = ngram_counts(t) if t else (None, 0)
        if not letters or model is None:
            return "und", 0.0, True, letters
        p = model.score(counts)
        best = int(p.argmax())
        return model.langs[best], float(p[best]), bool(p[best] < model.threshold), letters

    return add_columns(df, [text], more, lambda: one, keep_text)
