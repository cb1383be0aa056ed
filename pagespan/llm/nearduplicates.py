"""Near duplicates by a chosen-path set similarity join on word shingles.

A document's set holds its distinct 5-word shingles (A-Z lower-cased; fewer words: the whole sequence). Equal texts become
one vertex. Each vertex gets COORDINATES minwise values. A tree starts with all vertices in one node; a node sends each
vertex down a path by a coordinate that the node chooses and the vertex's value there, so that pairs of similarity s keep
together on a path with probability s. Roots and every other node have a second path: one and a half on average, so a
group whose members agree on a value with probability p grows by 1.5 p a level, while the paths that a pair of
similarity 0.75 stays on grow by 1.125. Nodes of up to LEAF vertices are compared exhaustively on the minwise values;
larger ones branch on. TREES trees miss fewer than one in 20,000 pairs of similarity 0.75 to 0.80 where they end within
three levels, one in 2,000 after six, one in 250 after twelve, as measured. A large node that mostly holds copies of its pivot can't be
split: it, and what is left at DEPTH, becomes one candidate cluster whole. Candidates are linked where the estimate is
five deviations or less below the threshold.

Links are confirmed on full sets: a candidate cluster's texts come together in blocks of bounded size, and a document is
compared with all others of its block until the block's components stop changing. Clusters of several blocks are compared
with shared pivots first, then what isn't in the largest component yet against every block. So no link between different
texts is lost for a size limit, and no pairs of a group are ever listed.

Null texts and texts without a word have empty sets, link with nothing and keep their own id. Texts of a repeated key are
one document; rows without a key take the component of an equal text, if there is one, and are kept. An empty table stays empty. Only the named columns are read, so others do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .common import BROADCAST_ROWS, Scratch, add_columns, forget, small, store, together
from .components import components, of_stars
from .textnum import mix, shingle_hashes, word_hashes

WORDS, THRESHOLD, SEED = 5, 0.75, 7
COORDINATES, TREES, LEAF, DEPTH = 64, 8, 500, 40
#: Estimates from COORDINATES values: candidates from this many equal values on (mean 48, deviation 3.5 at 0.75).
AT_LEAST = 31
#: Shingles that a block of a candidate cluster may hold in one task.
BLOCK_SHINGLES, PIVOTS = 200_000, 4
_U = np.uint64
_rng = np.random.default_rng(SEED)
_MULTIPLY = _rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) | _U(1)
_ADD = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


def shingles(text: bytes, k: int = WORDS) -> np.ndarray:
    """Sorted hashes of the distinct shingles; bytes.lower() changes A-Z only."""
    return shingle_hashes(word_hashes(text.lower()), k)


def signature(sets: np.ndarray) -> np.ndarray:
    """Minwise values (uint32) of a non-empty set, in bounded pieces."""
    low = np.full(COORDINATES, np.iinfo(np.uint64).max, _U)
    for a in range(0, len(sets), 1024):
        np.minimum(low, (sets[a : a + 1024, None] * _MULTIPLY + _ADD).min(axis=0), out=low)
    return (mix(low) >> _U(32)).astype(np.uint32)


def describe(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Stored: k, text_ (digest of the text), n_shingles, sig (minwise values; null for an empty set), low (their lowest bytes, which estimates need)."""
    rows = df.select(F.col(key).alias("k"), F.col(text).cast("binary").alias("t"), F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))).alias("text_"))

    def one(t: bytes | None) -> tuple:
        s = shingles(t) if t else ()
        if not len(s):
            return 0, None, None
        sig = signature(s)
        return len(s), sig.tobytes(), sig.astype(np.uint8).tobytes()

    return store(add_columns(rows, ["t"], {"n_shingles": T.LongType(), "sig": T.BinaryType(), "low": T.BinaryType()}, lambda: one), "sets")


def _paths(node: np.ndarray, sig: np.ndarray, both: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The two paths out of each row's node, as (whether the node has the path, key of the child). The node's number picks the coordinates and, unless both, whether there is a second path: every other node has one."""
    first = (mix(node * _U(3) + _U(1)) % _U(COORDINATES)).astype(np.int64)
    step = (mix(node * _U(5) + _U(2)) % _U(COORDINATES // 2)).astype(np.int64) * 2 + 1  # odd, so the coordinates differ
    second = np.ones(len(node), bool) if both else mix(node * _U(7) + _U(3)) % _U(2) == 0
    for j, there in enumerate((np.ones(len(node), bool), second)):
        i = (first + j * step) % COORDINATES
        child = mix(node * _U(0x9E3779B97F4A7C15) + mix(i.astype(_U) * _U(0xD6E8FEB86659FD93) + sig[np.arange(len(sig)), i]))
        yield there, child.view(np.int64)


def _roots(vertices: DataFrame) -> DataFrame:
    """(node, v) of the first level: of each tree both paths out of its root."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            sig = np.frombuffer(b"".join(part["sig"]), np.uint32).reshape(-1, COORDINATES)
            for tree in range(1, TREES + 1):
                for _, child in _paths(np.full(len(sig), tree, _U), sig, True):
                    yield pd.DataFrame({"node": child, "v": part["v"]})

    return vertices.select("v", "sig").mapInPandas(run, f"node long, v {vertices.schema['v'].dataType.simpleString()}")


def _forest(sig: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the estimates link among the rows of one node."""
    n = len(sig)
    root = np.arange(n)
    out = []
    for i in range(n - 1):
        close = i + 1 + np.flatnonzero((sig[i + 1 :] == sig[i]).sum(axis=1) >= AT_LEAST)
        for j in close[root[close] != root[i]]:
            if root[j] != root[i]:
                out.append((i, int(j)))
                root[root == root[j]] = root[i]
    return out


def _leaf_edges(rows: DataFrame) -> DataFrame:
    """rows: node, v, low of nodes of bounded size."""
    kind = rows.schema["v"].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {"node": None, "v": [], "low": []}
        out: list = []

        def close() -> None:
            if len(held["v"]) > 1:
                v = held["v"]
                out.extend((v[i], v[j]) for i, j in _forest(np.frombuffer(b"".join(held["low"]), np.uint8).reshape(-1, COORDINATES)))

        for part in parts:
            for node, v, low in zip(part["node"].to_numpy(), part["v"].to_numpy(), part["low"], strict=True):
                if node != held["node"]:
                    close()
                    held = {"node": node, "v": [], "low": []}
                held["v"].append(v)
                held["low"].append(low)
            yield pd.DataFrame(out, columns=["a", "b"])
            out = []
        close()
        yield pd.DataFrame(out, columns=["a", "b"])

    return rows.repartition("node").sortWithinPartitions("node", "v").mapInPandas(run, f"a {kind}, b {kind}")


def _looked_at(rows: DataFrame) -> DataFrame:
    """rows (node, v, pivot, sig, low, plow) of large nodes with near (1 where the estimate to the pivot allows a link) in place of plow, and the keys of the next nodes on the paths (next)."""
    kind = rows.schema["v"].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            low, plow = (np.frombuffer(b"".join(part[c]), np.uint8).reshape(-1, COORDINATES) for c in ("low", "plow"))
            sig = np.frombuffer(b"".join(part["sig"]), np.uint32).reshape(-1, COORDINATES)
            paths = list(_paths(part["node"].to_numpy(np.int64).view(_U), sig, False))
            to = [[int(child[i]) for there, child in paths if there[i]] for i in range(len(part))]
            yield part[["node", "v", "pivot", "sig", "low"]].assign(near=((low == plow).sum(axis=1) >= AT_LEAST).astype(np.int64), next=to)

    return rows.select("node", "v", "pivot", "sig", "low", "plow").mapInPandas(run, f"node long, v {kind}, pivot {kind}, sig binary, low binary, near long, next array<long>")


def candidates(vertices: DataFrame) -> DataFrame:
    """Stored edges (a, b) whose components hold every pair that shares a leaf and is estimated close, and every unsplit node. vertices: v, sig, low.

    Only (node, v) passes through the levels; a level's tables go as soon as its edges and the next level are stored, and from the second level on only the vertices that are still in a large node are read. Joins that bring the values to the nodes shuffle, but for levels of few rows, which one task reads; their leaves are dealt out all the same.
    """
    found: list[DataFrame] = []
    pool, keys = vertices, store(_roots(vertices), "keys")
    stored = [keys]
    for depth in range(1, DEPTH + 1):
        sizes = store(keys.groupBy("node").agg(F.count("*").alias("n"), F.min("v").alias("pivot")).where("n > 1"), "nodes")
        # a node known by its size: leaves are gathered, larger ones stay spread
        leaves = keys.join(small(sizes.where(F.col("n") <= LEAF).select("node")), "node", "left_semi").join(pool.select("v", "low").hint("merge"), "v")
        found.append(store(_leaf_edges(leaves.select("node", "v", "low")), "edges"))
        large = sizes.where(F.col("n") > LEAF).select("node", "pivot")
        done = not large.limit(1).count()
        if not done:
            # each large node's rows with its pivot's values; there are at most rows / LEAF such nodes
            pivots = store(pool.select(F.col("v").alias("pivot"), F.col("low").alias("plow")).join(small(large), "pivot"), "pivots")
            few = small(pivots, BROADCAST_ROWS // 10)
            inside = keys.join(few.select("node"), "node", "left_semi").join(pool.select("v", "sig", "low").hint("merge"), "v").join(few, "node")
            looked = store(_looked_at(inside), "large")
            rows = together(looked)
            share = store(rows.groupBy("node").agg((F.avg("near") > 0.5).alias("whole")), "share")
            known = rows.join(small(share), "node")
            whole = F.lit(True) if depth == DEPTH else F.col("whole")
            # the whole node, or those close to the pivot, become one candidate cluster
            found.append(store(known.where(whole | (F.col("near") == 1)).where("v <> pivot").select(F.col("pivot").alias("a"), F.col("v").alias("b")).distinct(), "edges"))
            on = known.where(~whole)
            below = store(on.select(F.explode("next").alias("node"), "v"), "keys")
            left = store(on.groupBy("v").agg(F.first("sig").alias("sig"), F.first("low").alias("low")), "pool")
            done = not below.limit(1).count()
            for x in (pivots, looked, share):
                forget(x)
        for x in (sizes, *stored):
            forget(x)
        if done:
            break
        stored = [below, left]
        keys, pool = together(below), together(left)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


class _Union:
    def __init__(self, n: int):
        self.root = np.arange(n)
        self.parts = n

    def join(self, i: int, others: np.ndarray) -> None:
        roots = np.unique(np.append(self.root[others], self.root[i]))
        if len(roots) > 1:
            self.root[np.isin(self.root, roots)] = roots[0]
            self.parts -= len(roots) - 1

    def largest(self) -> int:
        ids, n = np.unique(self.root, return_counts=True)
        return int(ids[n.argmax()])


def linked(sets: list[np.ndarray], threshold: float = THRESHOLD, compare: np.ndarray | None = None) -> np.ndarray:
    """Component number of each set, exact: a set is compared with all others in one pass over an inverted list, rarest components first, until all outside the largest component have been (then every link to it is known as well). compare: these are, and no others."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    u = _Union(n)
    if n < 2:
        return u.root
    values, number = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(number, kind="stable")
    ends = np.cumsum(np.bincount(number, minlength=len(values)))
    owners = owner[order]
    starts = np.concatenate([[0], ends[:-1]])
    first = np.concatenate([[0], np.cumsum(sizes)])
    num, den = 100, 100 * threshold

    def neighbours(i: int) -> np.ndarray:
        mine = number[first[i] : first[i + 1]]
        lengths = ends[mine] - starts[mine]
        at = np.repeat(starts[mine] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        shared = np.bincount(owners[at], minlength=n)
        return np.flatnonzero(num * shared >= den * (sizes + sizes[i] - shared))

    todo = np.ones(n, bool) if compare is None else compare.copy()
    # the set that shares most with the rest comes first: if it is a hub, little else needs comparing
    weight = np.array([(ends[number[a:b]] - starts[number[a:b]]).mean() if b > a else 0 for a, b in zip(first, first[1:], strict=False)])
    if todo.any():
        i = int(np.where(todo, weight, -1).argmax())
        todo[i] = False
        u.join(i, neighbours(i))
    while u.parts > 1:
        rest = np.flatnonzero(todo if compare is not None else todo & (u.root != u.largest()))
        if not len(rest):
            break
        for i in rest[:64]:
            todo[i] = False
            u.join(i, neighbours(i))
    return u.root


def _confirm(rows: DataFrame, by: list[str], query: bool) -> DataFrame:
    """Edges from a to the smallest b of its component, for the exact components in each block. rows: the columns by, v, t (text) and, with query, q: only those with q are compared with all."""
    kind = rows.schema["v"].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {"key": None, "v": [], "s": [], "q": []}
        out: list = []

        def close() -> None:
            v = held["v"]
            if len(v) > 1:
                root = linked(held["s"], compare=np.array(held["q"], bool) if query else None)
                out.extend((v[i], v[r]) for i, r in enumerate(root) if r != i)

        for part in parts:
            q = part["q"].to_numpy() if query else np.ones(len(part), bool)
            for key, v, t, is_q in zip(zip(*[part[c].to_numpy() for c in by], strict=True), part["v"].to_numpy(), part["t"], q, strict=True):
                if key != held["key"]:
                    close()
                    held = {"key": key, "v": [], "s": [], "q": []}
                held["v"].append(v)
                held["s"].append(shingles(t))
                held["q"].append(is_q)
            yield pd.DataFrame(out, columns=["a", "b"])
            out = []
        close()
        yield pd.DataFrame(out, columns=["a", "b"])

    return rows.repartition(*by).sortWithinPartitions(*by, "v").mapInPandas(run, f"a {kind}, b {kind}")


def confirmed(clusters: DataFrame, docs: DataFrame, vertices: DataFrame, key: str, text: str) -> DataFrame:
    """(node, component) of the exact links inside candidate clusters. clusters: node, component; vertices: v, n_shingles."""
    members = store(clusters.join(vertices.select(F.col("v").alias("node"), "n_shingles"), "node").select(F.col("node").alias("v"), F.col("component").alias("c"), "n_shingles"), "members")
    weights = members.groupBy("c").agg(F.sum("n_shingles").alias("w")).where(F.col("w") > BLOCK_SHINGLES)
    many = weights.select("c", F.ceil(F.col("w") * 2 / BLOCK_SHINGLES).cast("int").alias("blocks"))
    placed = members.join(small(many), "c", "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("v"), F.col("blocks")), F.lit(0)).cast("int"))
    texts = docs.select(F.col(key).alias("v"), F.col(text).cast("binary").alias("t")).join(small(placed), "v")
    if not many.limit(1).count():
        return of_stars(store(_confirm(texts, ["c", "block"], False), "links"))
    texts = store(texts, "texts")
    single, several = texts.where("blocks is null"), texts.where("blocks is not null")
    # several blocks: a few pivots of the cluster join every block, and each block is solved by itself
    drawn = several.where(F.pmod(F.xxhash64("v", F.lit(1)), F.col("blocks") * 64) == 0).select("c", "v")
    first = W.partitionBy("c").orderBy(F.xxhash64("v", F.lit(1)), "v")
    pivots = drawn.withColumn("r", F.row_number().over(first)).where(F.col("r") <= PIVOTS).select("v")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    spread = several.join(small(pivots), "v", "left_semi").withColumn("to", every).where("to <> block").withColumn("block", F.col("to"))
    links = store(_confirm(several.unionByName(spread.drop("to")), ["c", "block"], False), "links")
    so_far = store(components(links), "so_far")
    # what isn't in the largest component of its cluster yet meets every block, in parts of bounded size
    state = several.select("v", "c", "n_shingles").join(so_far.withColumnRenamed("node", "v"), "v", "left").withColumn("component", F.coalesce("component", "v"))
    top = state.groupBy("c", "component").agg(F.count("*").alias("n")).groupBy("c").agg(F.max_by("component", F.struct("n", "component")).alias("top"))
    others = store(state.join(small(top), "c").where("component <> top").select("v", "c", "n_shingles"), "others")
    parts = others.groupBy("c").agg(F.ceil(F.sum("n_shingles") * 2 / BLOCK_SHINGLES).cast("int").alias("parts"))
    asked = several.join(small(others.select("v")), "v", "left_semi").join(small(parts), "c").withColumn("part", F.pmod(F.xxhash64("v", F.lit(2)), F.col("parts")).cast("int"))
    asked = asked.withColumn("to", every).select("v", "c", F.col("to").alias("block"), "part", "t", F.lit(True).alias("q"))
    base = several.join(small(parts), "c").select("v", "c", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "t", F.lit(False).alias("q"))
    rest = _confirm(base.unionByName(asked), ["c", "block", "part"], True)
    found = store(_confirm(single, ["c", "block"], False).withColumn("whole", F.lit(True)).unionByName(rest.withColumn("whole", F.lit(False))), "links")
    # a cluster of one block is done; in the others the new links meet the components so far
    merged = components(so_far.toDF("a", "b").unionByName(found.where("not whole").select("a", "b")))
    return of_stars(found.where("whole").select("a", "b")).unionByName(merged)


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of df: key, n_shingles, component_id (the smallest key that links lead to), kept (the key is it)."""
    docs = df.where(F.col(key).isNotNull())
    sets = describe(df, key, text)
    with Scratch() as scratch:
        vertices = store(sets.where("n_shingles > 0 and k is not null").groupBy("text_").agg(F.min("k").alias("v"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.first("low").alias("low")), "vertices")
        edges = candidates(vertices.select("v", "sig", "low"))
        exact = confirmed(components(edges), docs, vertices, key, text)
        of_text = vertices.select("text_", "v").join(exact.select(F.col("node").alias("v"), "component"), "v", "left").select("text_", F.coalesce("component", "v").alias("c_"))
        of_text = scratch.keep(store(of_text, "components"))
    out = sets.select("k", "text_", "n_shingles").join(of_text, "text_", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("c_")).otherwise(F.col("k"))
    return out.select(F.col("k").alias(key), "n_shingles", component.alias("component_id"), F.coalesce(F.col("k") == component, F.lit(True)).alias("kept"))


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df without those that aren't the first of their component."""
    with Scratch() as scratch:
        gone = scratch.keep(store(near_duplicates(df, key, text).where("not kept").select(key), "gone"))
    return df.join(small(gone), key, "left_anti").select(*df.columns)
