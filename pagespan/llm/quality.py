"""Quality classifier: a second-order factorisation machine over hashed words, bands of structure statistics and bands of
numeric metadata. Pairwise interactions have low rank and are summed in linear time: half of (square of the sum minus
sum of the squares) for each factor. Trained in numpy with Adagrad on a bounded, balanced sample; the score is
recalibrated to the classes' shares on rows kept out of the training.

Null texts count as empty; they get a score too. Without labels every score is 0.5; null labels and keys are not learned
from. Whole texts count, however long. Missing metadata is a band of its own. Repeated rows get repeated scores, equal
texts with equal metadata equal ones; a score of just the threshold counts as label 1. An empty table stays empty.
Further columns pass through, those named as an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, apart, ensure_importable, small
from .textnum import mix, word_hashes

WORDS, FACTORS, SEED, EPOCHS, BATCH = 1 << 14, 8, 29, 12, 64
#: Bound of the training sample: about so many labelled rows of each class, drawn by a hash of the row.
ROWS_PER_CLASS = 2500
EDGES = np.array([1e-9, 0.003, 0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.97])
STATS = ("length", "word_length", "symbols", "capitals", "digits", "marks", "repeated_lines", "repeated_triples", "distinct_words", "blanks", "longest_word", "lines", "wide", "stops", "bars")
META_BANDS = 40
_BANDS = len(EDGES) + 1
_CLASS = np.zeros(256, np.uint8)
for _i, _chars in enumerate((b"#*$%&|<>", bytes(range(65, 91)), bytes(range(48, 58)), b"!?", b" \t\n\r\x0b\x0c", bytes(range(97, 123)), bytes(range(128, 256)), b".,;:"), 1):
    _CLASS[list(_chars)] = _i


def structure(data: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Each statistic as a number from 0 to 1."""
    n, w = max(1, len(data)), max(1, len(words))
    symbols, capitals, digits, marks, blanks, lower, wide, stops = np.bincount(_CLASS[data], minlength=9)[1:9] / n
    raw = data.tobytes()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    triples = mix(words[:-2] * np.uint64(31) + mix(words[1:-1] * np.uint64(17) + mix(words[2:]))) if len(words) > 2 else words[:0]
    gaps = np.diff(np.flatnonzero(_CLASS[data] == 5), prepend=-1, append=len(data))
    return np.array([
        min(1.0, np.log1p(w) / 12), min(1.0, n / w / 20), min(1.0, symbols * 3), capitals / max(1e-9, capitals + lower + wide), digits, min(1.0, marks * 4),
        1 - len(set(lines)) / max(1, len(lines)), 1 - len(np.unique(triples)) / max(1, len(triples)), len(np.unique(words)) / w, blanks,
        min(1.0, np.log1p(gaps.max(initial=0)) / 12), min(1.0, len(lines) / w), wide, min(1.0, stops * 4), min(1.0, 8 * raw.count(b"|") / n),
    ])


def row_features(text: str | None, meta: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and values of the features that are not 0: words (length 1 together), statistics and metadata (length 1 together)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    words = word_hashes(raw.lower())
    ids, counts = np.unique((words >> np.uint64(50)).astype(np.int64), return_counts=True)
    values = np.sqrt(counts)
    values /= max(1e-9, np.linalg.norm(values))
    bands = np.searchsorted(EDGES, structure(data, words), "right")
    at = WORDS
    stat_ids = at + np.arange(len(STATS)) * _BANDS + bands
    at += len(STATS) * _BANDS
    meta_ids = [at + i * META_BANDS + (META_BANDS - 1 if m is None or m != m else int(min(META_BANDS - 2, np.log2(1 + max(0.0, float(m)))))) for i, m in enumerate(meta)]
    ids = np.concatenate([ids, stat_ids, np.array(meta_ids, np.int64)])
    values = np.concatenate([values, np.full(len(STATS) + len(meta), 1 / np.sqrt(len(STATS) + len(meta)))])
    return ids.astype(np.int32), values.astype(np.float32)


@dataclass
class Model:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    slope: float
    shift: float

    def margin(self, ids: np.ndarray, x: np.ndarray) -> float:
        v = self.factors[ids] * x[:, None]
        return self.bias + float(self.linear[ids] @ x) + 0.5 * float((v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum())

    def score(self, ids: np.ndarray, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(ids, x) + self.shift, -40, 40))))


def train(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n_features: int, share: float, seed: int = SEED) -> Model | None:
    """share: that of label 1 among all labelled rows; a fifth of the rows calibrates."""
    if len(set(y.tolist())) < 2:
        return None if not len(y) else Model(0.0, np.zeros(n_features, np.float32), np.zeros((n_features, FACTORS), np.float32), 1.0, 4.0 if y[0] else -4.0)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, own = (order[: len(y) // 5], order[len(y) // 5 :]) if len(y) >= 100 else (order, order)
    w, v, b = np.zeros(n_features, np.float32), rng.normal(0, 0.02, (n_features, FACTORS)).astype(np.float32), 0.0
    gw, gv = np.full(n_features, 1e-3, np.float32), np.full((n_features, FACTORS), 1e-3, np.float32)
    decay = np.where(np.arange(n_features) < WORDS, 3e-3, 1e-5).astype(np.float32)
    for _ in range(EPOCHS):
        rng.shuffle(own)
        for a in range(0, len(own), BATCH):
            batch = own[a : a + BATCH]
            ids = np.concatenate([rows[i][0] for i in batch])
            x = np.concatenate([rows[i][1] for i in batch])
            of = np.repeat(np.arange(len(batch)), [len(rows[i][0]) for i in batch])
            starts = np.flatnonzero(np.diff(of, prepend=-1))
            vx = v[ids] * x[:, None]
            sums = np.add.reduceat(vx, starts)
            z = b + np.add.reduceat(w[ids] * x, starts) + 0.5 * (sums**2 - np.add.reduceat(vx**2, starts)).sum(axis=1)
            g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[batch]) / len(batch)
            used, at = np.unique(ids, return_inverse=True)
            down = (g[of] * x)[:, None]
            dw = np.bincount(at, down[:, 0], len(used)) + decay[used] * w[used]
            each = down * (sums[of] - vx)
            dv = np.stack([np.bincount(at, each[:, f], len(used)) for f in range(FACTORS)], axis=1) + decay[used, None] * v[used]
            gw[used] += dw**2
            gv[used] += dv**2
            w[used] -= (0.15 * dw / np.sqrt(gw[used])).astype(np.float32)
            v[used] -= (0.05 * dv / np.sqrt(gv[used])).astype(np.float32)
            b -= 0.05 * float(g.sum())
    model = Model(b, w, v, 1.0, 0.0)
    z, t = np.array([model.margin(*rows[i]) for i in held]), y[held].astype(float)
    weight = np.where(t > 0, share / max(1e-9, t.mean()), (1 - share) / max(1e-9, 1 - t.mean()))
    slope, shift = 1.0, 0.0
    for _ in range(400):  # logistic regression of one variable, weighted to the classes' shares
        g = weight * (1 / (1 + np.exp(-np.clip(slope * z + shift, -40, 40))) - t)
        slope, shift = slope - 0.05 * (float((g * z).mean()) + 0.01 * (slope - 1)), shift - 0.2 * float(g.mean())
    model.slope, model.shift = max(0.05, slope), shift
    return model


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, key: str = "doc_id", label: str = "quality", text: str = "text", meta: tuple[str, ...] = (), per_class: int = ROWS_PER_CLASS) -> Model | None:
    """Learn from about per_class labelled rows of each class among those for which may_learn (of the key) holds; of repeated keys the largest label counts."""
    ensure_importable(docs.sparkSession)
    known = labels.where(may_learn & F.col(label).isin(0, 1)).groupBy(key).agg(F.max(label).cast("int").alias("y_"))
    counts = {r["y_"]: r["n"] for r in known.groupBy("y_").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    draw = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(SEED)), F.lit(1_000_000)) / 1e6
    share = F.when(F.col("y_") == 1, F.lit(per_class / counts.get(1, 1))).otherwise(F.lit(per_class / counts.get(0, 1)))
    chosen = small(known.where(draw < share))
    names = [f"m{i}" for i in range(len(meta))]
    sample = docs.select(F.col(key), F.col(text).alias("t"), *[F.col(c).cast("double").alias(n) for c, n in zip(meta, names, strict=True)]).join(chosen, key).drop(key)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for r in part[["y_", "t", *names]].itertuples(index=False):
                ids, x = row_features(r[1], list(r[2:]))
                out.append((int(r[0]), ids.tobytes(), x.tobytes()))
            yield pd.DataFrame(out, columns=["y", "ids", "x"])

    got = sorted((r["y"], bytes(r["ids"]), bytes(r["x"])) for r in sample.mapInPandas(run, "y int, ids binary, x binary").collect())
    rows = [(np.frombuffer(a, np.int32), np.frombuffer(b, np.float32)) for _, a, b in got]
    return train(rows, np.array([r[0] for r in got]), WORDS + len(STATS) * _BANDS + len(meta) * META_BANDS, counts.get(1, 0) / sum(counts.values()))


def score(df: DataFrame, model: Model | None, text: str = "text", meta: tuple[str, ...] = (), threshold: float = 0.7, keep_text: bool = False) -> DataFrame:
    """df with score (higher: label 1 likelier) and predicted (1 from the threshold on). The metadata columns stay."""
    rows, back = apart(df, text, *meta)
    own = [f"__m{i}" for i in range(len(meta))]
    rows = rows.withColumns({n: F.col(c).cast("double") for c, n in zip(meta, own, strict=True)})

    def one(t: str | None, *values: float | None) -> tuple:
        s = model.score(*row_features(t, list(values))) if model else 0.5
        return s, int(s >= threshold)

    out = add_columns(rows, [text, *own], {"score": T.DoubleType(), "predicted": T.IntegerType()}, lambda: one, keep_text)
    return back(out, ["score", "predicted"], [] if keep_text else [text])
