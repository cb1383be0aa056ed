"""Mixture-controlled packing: deficit round-robin over source queues, in closed form.

Each source is a queue of tokens. A window of WINDOW sequences takes from each queue its quantum, the target share of the
window, plus the deficit carried over from the windows before, less the fraction of a token that can't be served yet. The
tokens served up to any window are then the floor of share times tokens, so every task computes the cuts of its own
documents, and deficits run on across windows and partitions without a task that sees all. If a queue with explicit
weights runs dry, the rest share on by weight (a new phase). The order in a queue is that of the stored token table.

There are QUEUES queues at most, as each takes its part of every window: the largest sources by bytes, and those with an
explicit weight, have one each (of equal ones the first by name), and the sources beyond them share the last queue, in
which their documents stay in the table's order. So plan, windows and memory do not grow with the number of sources.

Null texts are empty documents of one end token; a null source is a source of its own. Repeated rows are packed as often
as they come; an empty table gives no pieces. A very long text is one row of ids, cut over as many sequences as it needs.
Of further columns none is read, so their names may clash.
"""

from __future__ import annotations

import base64
import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window as W

from .common import add_columns, small, store

LENGTH, WINDOW, END, QUEUES = 2048, 16, 1, 256
#: Numbers that a task keeps of the windows it has met.
KNOWN = 1_000_000
_encoders: dict[str, object] = {}


def encoder(name: str):
    """bytes-to-ids function by file name. The .tiktoken file holds the same vocabulary as the .json file of that name; both libraries give the same ids, this one four times as fast. The .json file's added tokens, which the ranks lack, are read from it."""
    if name not in _encoders:
        import public_tokenizers

        path = public_tokenizers.path(name)
        if name.endswith(".tiktoken"):
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            added = {}
            if os.path.exists(whole := path.removesuffix(".tiktoken") + ".json"):
                with open(whole, "rb") as f:
                    added = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
            e = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
            _encoders[name] = lambda text: e.encode_to_numpy(text, allowed_special="all").astype(np.uint32)
        else:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            _encoders[name] = lambda text: np.array(t.encode(text, add_special_tokens=False).ids, np.uint32)
    return _encoders[name]


def _queues(df: DataFrame, source: str, text: str, named: list[str | None], most: int) -> DataFrame:
    """name_ of the sources that have a queue of their own: those named and the largest others, most - 1 in all; all of them, if they are no more than most."""
    sizes = df.groupBy(_name(source).alias("name_")).agg(F.sum(F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 1).alias("n"))
    first = [F.col("name_").isin(["null" if x is None else f"={x}" for x in named]).desc()] if named else []
    top = store(sizes.orderBy(*first, F.desc("n"), "name_").limit(most + 1).select("name_", F.monotonically_increasing_id().alias("i_")), "queues")
    return top.orderBy("i_").limit(most - 1) if top.count() > most else top


def _name(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null"))


def tokenize(df: DataFrame, key: str, source: str, text: str, vocabulary: str, end: int = END, named: list[str | None] | None = None, most: int = QUEUES) -> DataFrame:
    """The stored token table: k, name, queue (the name, or null in the queue that the small sources share), part, start (tokens of that queue before it in its part), n_tokens, ids (little-endian uint16, or uint32 where an id needs it)."""
    rows = df.select(F.col(key).alias("k"), _name(source).alias("name"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    own = _queues(df, source, text, named or [], most).select(F.col("name_").alias("name"), F.col("name_").alias("queue"))  # at most `most` rows
    rows = rows.join(F.broadcast(own), "name", "left").select("k", "name", "queue", F.coalesce("queue", F.lit("")).alias("q"), "t")
    more = {"part": T.IntegerType(), "start": T.LongType(), "n_tokens": T.LongType(), "ids": T.BinaryType()}

    def make():
        encode, seen, part = encoder(vocabulary), {}, TaskContext.get().partitionId()

        def one(q: str, t: str) -> tuple:
            ids = np.append(encode(t), np.uint32(end))
            start = seen.get(q, 0)
            seen[q] = start + len(ids)
            return part, start, len(ids), (ids.astype(np.uint16) if ids.max() < 65536 else ids).tobytes()

        return one

    return store(add_columns(rows, ["q", "t"], more, make), "tokens")


@dataclass
class Phase:
    window: int  # its first window
    base: list[int]  # tokens of each queue served before it
    take: list[int]  # and in it
    step: int  # tokens that a full window advances by

    @property
    def total(self) -> int:
        return sum(self.take)

    @property
    def windows(self) -> int:
        return -(-self.total // self.step)

    def served(self, t: int) -> list[int]:
        """Of each queue, up to the phase's window t."""
        n = self.total
        v = min(t * self.step, n)
        return [b + x * v // n for b, x in zip(self.base, self.take, strict=True)]


def plan(totals: list[int], weights: list[int | Fraction] | None, capacity: int) -> list[Phase]:
    """Phases until all queues are empty. Without weights the queues' own totals are the targets: one phase, in which all run dry together."""
    left, base, phases, window = list(totals), [0] * len(totals), [], 0
    given = [Fraction(w) for w in weights] if weights else [Fraction(n) for n in totals]
    while any(left):
        active = [i for i, n in enumerate(left) if n]
        live = [i for i in active if given[i] > 0]
        share = {i: given[i] for i in live} if live else {i: Fraction(left[i]) for i in active}
        first = min(Fraction(left[i]) / w for i, w in share.items())
        take = [0] * len(left)
        for i, w in share.items():
            take[i] = min(left[i], int(first * w))
        phase = Phase(window, list(base), take, max(1, capacity - len(share)))
        phases.append(phase)
        window += phase.windows
        base = [b + x for b, x in zip(base, take, strict=True)]
        left = [n - x for n, x in zip(left, take, strict=True)]
    return phases


class Cutter:
    """Cuts a run of a queue's tokens into pieces with their places; knows the windows it has met."""

    def __init__(self, phases: list[Phase], length: int, window: int):
        self.phases, self.length, self.window, self.known = phases, length, window, {}

    def at(self, p: int, t: int) -> tuple[list[int], list[int], list[int]]:
        """Of the phase's window t: what is served before and after it, and where each queue's run begins in it."""
        got = self.known.get((p, t))
        if got is None:
            a, b = self.phases[p].served(t), self.phases[p].served(t + 1)
            place, at = [], 0
            for x, y in zip(a, b, strict=True):
                place.append(at)
                at += y - x
            if 3 * len(place) * len(self.known) > KNOWN:
                self.known.clear()
            got = self.known[p, t] = (a, b, place)
        return got

    def cut(self, q: int, start: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """(tokens before it in the run, length, sequence, offset) of each piece of the tokens start .. start + n of queue q."""
        at, end = start, start + n
        p = next(i for i, f in enumerate(self.phases) if f.base[q] + f.take[q] > at)
        while at < end:
            while self.phases[p].base[q] + self.phases[p].take[q] <= at:
                p += 1
            f = self.phases[p]
            t = (at - f.base[q]) * f.total // (f.take[q] * f.step)
            a, b, place = self.at(p, t)
            while b[q] <= at:
                t += 1
                a, b, place = self.at(p, t)
            while a[q] > at:
                t -= 1
                a, b, place = self.at(p, t)
            stop, inside = min(end, b[q]), place[q] + at - a[q]
            while at < stop:
                size = min(stop - at, self.length - inside % self.length)
                yield at - start, size, (f.window + t) * self.window + inside // self.length, inside % self.length
                at, inside = at + size, inside + size


def pack(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: dict[str | None, int] | None = None, vocabulary: str = "byte_bpe_50k.tiktoken", length: int = LENGTH, window: int = WINDOW, with_ids: bool = True, queues: int = QUEUES) -> DataFrame:
    """Pieces: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, window_id, source and, if asked for, the ids as little-endian uint32. weights: target of each source (missing: 0, served last), for fewer sources than queues; None: each source's own share."""
    if weights and len(weights) >= queues:
        raise ValueError(f"{len(weights)} sources have a weight, {queues} queues are too few")
    tokens = tokenize(df, key, source, text, vocabulary, named=[*(weights or {})], most=queues)
    sums = store(tokens.groupBy("queue", "part").agg(F.sum("n_tokens").alias("n")), "sums")
    totals = sums.groupBy("queue").agg(F.sum("n").alias("n")).orderBy("queue").collect()  # a row for each queue
    names = [r["queue"] for r in totals]
    own = None if weights is None else [0 if x is None else weights.get(None if x == "null" else x[1:], 0) for x in names]
    phases = plan([r["n"] for r in totals], own, length * window)
    of = {x: i for i, x in enumerate(names)}
    before = sums.select(F.coalesce("queue", F.lit("")).alias("q"), "part", (F.sum("n").over(W.partitionBy("queue").orderBy("part")) - F.col("n")).alias("before"))
    placed = tokens.withColumn("q", F.coalesce("queue", F.lit(""))).join(small(before), ["q", "part"]).select("k", "name", "queue", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids")
    kinds = {"start": T.LongType(), "length": T.LongType(), "ids_crc32": T.LongType(), "doc_tokens": T.LongType(), "sequence_id": T.LongType(), "offset": T.LongType(), "window_id": T.LongType(), "source": T.StringType()} | ({"ids": T.BinaryType()} if with_ids else {})
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *(T.StructField(k, v) for k, v in kinds.items())])
    arrow = [to_arrow_type(t) for t in kinds.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(phases, length, window)
        for b in batches:
            at, out = [], []
            for i, (source_, queue, start, n, raw) in enumerate(zip(*(b.column(c).to_pylist() for c in ("name", "queue", "start", "n_tokens", "ids")), strict=True)):
                ids = np.frombuffer(raw, np.uint16 if len(raw) == 2 * n else np.uint32).astype("<u4")
                name = None if source_ == "null" else source_[1:]
                for first, size, sequence, offset in cutter.cut(of[queue], start, n):
                    piece = ids[first : first + size].tobytes()
                    at.append(i)
                    out.append((first, size, zlib.crc32(piece), n, sequence, offset, sequence // window, name, *([piece] if with_ids else [])))
            if out:
                made = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), arrow, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("k").take(pa.array(at)), *made], names=schema.names)

    return placed.mapInArrow(run, schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, n_tokens, ids (little-endian uint32), for pieces with ids. A sequence has few pieces."""
    one = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), one.alias("p")).select("sequence_id", "n_tokens", F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
