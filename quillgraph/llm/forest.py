"""Approximate nearest neighbours by a hash-prefix forest."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, cut, mapped, mix, prepare, ragged, stored, tasks

#: Trees, symbols of a hash string, and axes that a tree's rotation has at most.
TREES, SYMBOLS, AXES = 48, 7, 127
#: Entries of a part of the sorted arrays, and distinct vectors of a block.
PART, BLOCK = 65_536, 4_096
#: Cells of the sketch that counts a query's distinct candidates, and candidates that are sampled into it for a full quota.
CELLS, SAMPLED = 1024, 512
#: Candidates that a numpy pass holds.
PASS = 1 << 21


def enough(n_rows: int) -> int:
    """Distinct vectors that end the ascent, each counted once over all trees."""
    return max(1, math.ceil(8 * n_rows**0.63))


def rotations(dim: int, trees: int, seed: int = 7) -> np.ndarray:
    """A random rotation for each tree, the same on every worker; more dimensions than ``AXES`` are projected, at random too."""
    rng = np.random.default_rng(seed)
    return np.stack([np.linalg.qr(rng.normal(size=(dim, min(dim, AXES))))[0] for _ in range(trees)])


def strings(x: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Each vector's hash string in one tree, as a number: the rotated axes nearest to it, the nearest first.

    A symbol is an axis and a side of it; so a common prefix of two strings
    means a common cap on the sphere, the smaller the longer it is. Ties go to
    the lower axis.
    """
    y = x @ turn
    n = min(SYMBOLS, y.shape[1])
    top = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :n]
    symbol = (2 * top + (np.take_along_axis(y, top, axis=1) > 0)).astype(np.int64)
    out = np.zeros(len(x), np.int64)
    for k in range(n):
        out |= symbol[:, k] << (8 * (SYMBOLS - 1 - k))
    return out


def keys(x: np.ndarray, turns: np.ndarray, mean: np.ndarray | float = 0.0) -> np.ndarray:
    """A row for each tree of the vectors' keys: the tree, then the hash string, so that one order serves all trees."""
    unit = _unit(x, mean)
    return np.stack([np.int64(t) << 56 | strings(unit, turn) for t, turn in enumerate(turns)])


def prefix_range(key: np.ndarray, depth: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest key of the same tree that agrees in the first ``depth`` symbols."""
    drop = 8 * (SYMBOLS - np.asarray(depth, np.int64))
    low = key >> drop << drop
    return low, low | ((np.int64(1) << drop) - 1)


def _unit(x: np.ndarray, mean: np.ndarray | float) -> np.ndarray:
    """Directions from the mean, which distances don't depend on; a vector at the mean itself has none and stays zero."""
    x = x - mean
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1.0)


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy().reshape(len(col), -1) if len(col) else np.zeros((0, 1))


def _blob(x: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes()], pa.binary())


def _binaries(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Runs of ``data`` as binary values."""
    ends = np.concatenate([[0], np.cumsum(sizes)]) * data.itemsize
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def _passes(sizes: np.ndarray):
    """Slices of rows that have at most ``PASS`` candidates together, or one row."""
    total, at = np.cumsum(sizes), 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PASS, side="right")))
        yield slice(at, end)
        at = end


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(vec_id, x)`` in doubles: vectors that aren't null, zero, or holding null or non-finite components; of rows with one id, the least vector."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    plain = vectors.select(F.col(key).cast("long").alias("vec_id"), x.alias("x")).where("vec_id is not null and x is not null")
    fine = plain.where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0))
    return fine.groupBy("vec_id").agg(F.min("x").alias("x"))


def _mean(distinct: DataFrame, dim: int) -> np.ndarray:
    """The mean of the vectors, from a sum of each task's; zero where doubles don't hold it."""

    def run(batches):
        total, n = np.zeros(dim), 0
        for batch in batches:
            x = _matrix(column(batch, "x"))
            if len(x):
                total, n = total + x.sum(axis=0), n + len(x)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64())), pa.array([n], pa.int64())], names=["total", "n"])

    sums = distinct.select("x").mapInArrow(run, "total array<double>, n long").collect()
    mean = np.sum([r.total for r in sums], axis=0) / max(1, sum(r.n for r in sums))
    return mean if np.isfinite(mean).all() else np.zeros(dim)


def _block(table: pa.Table) -> pa.Table:
    table = table.sort_by("vec_id")
    ids, x = table.column("vec_id").to_numpy(), _matrix(table.column("x").combine_chunks())
    return pa.table({"block": table.column("block").slice(0, 1), "ids": _blob(ids), "xs": _blob(x)})


class Index:
    """The forest over distinct vectors, in the shared folder.

    ``blocks(block, ids, xs)`` holds the vectors, ``parts(part, keys, at, low,
    high)`` the sorted arrays of all trees, one after another, cut into parts of
    about ``PART`` entries: an entry is a key and where its vector stands (block
    and place). Parts are cut by ranges of keys and then places, so a key that
    many vectors share is cut as well. The driver holds each part's first and
    last key.
    """

    def __init__(self, distinct: DataFrame, n: int, dim: int, trees: int, seed: int):
        self.spark, self.dim, self.trees, self.seed = distinct.sparkSession, dim, trees, seed
        self.mean = mean = _mean(distinct, dim)
        self.n_blocks = max(1, -(-n // BLOCK))
        dealt = distinct.select(F.pmod(F.xxhash64("vec_id"), F.lit(self.n_blocks)).cast("int").alias("block"), "vec_id", "x")
        self.blocks = stored(dealt.groupBy("block").applyInArrow(_block, "block int, ids binary, xs binary"), "vectors")

        def entries(batches):
            turns = rotations(dim, trees, seed)
            for batch in batches:
                for block, xs in zip(column(batch, "block").to_pylist(), column(batch, "xs").to_pylist(), strict=True):
                    x = np.frombuffer(xs).reshape(-1, dim)
                    at = pa.array((np.int64(block) << 16) + np.arange(len(x)))
                    for key in keys(x, turns, mean):
                        yield pa.RecordBatch.from_arrays([pa.array(key), at], names=["key", "at"])

        def part(batches):
            from pyspark import TaskContext

            held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
            if held:
                key, at = (np.concatenate(z) for z in zip(*held, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), _blob(key), _blob(at), pa.array([key[0]], pa.int64()), pa.array([key[-1]], pa.int64())], names=["part", "keys", "at", "low", "high"])

        n_parts = max(tasks(self.spark), -(-n * trees // PART))
        ordered = self.blocks.mapInArrow(entries, "key long, at long").repartitionByRange(n_parts, "key", "at").sortWithinPartitions("key", "at")
        self.parts = stored(mapped(ordered, part, "part int, keys binary, at binary, low long, high long"), "trees")
        ends = sorted((r.low, r.high, r.part) for r in self.parts.select("part", "low", "high").collect())
        self.ends = self.spark.sparkContext.broadcast(tuple(np.array(z, np.int64) for z in zip(*ends, strict=True)) if ends else (np.zeros(0, np.int64),) * 3)

    def routed(self, asked: DataFrame) -> DataFrame:
        """``asked(query_id, x, depth)`` → ``(part, query_id, key, depth)``: for each tree, the parts that hold keys under the query's prefix."""
        dim, trees, seed, mean, ends = self.dim, self.trees, self.seed, self.mean, self.ends

        def run(batches):
            turns, (low, high, part) = rotations(dim, trees, seed), ends.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                q, depth = column(batch, "query_id").to_numpy(), column(batch, "depth").to_numpy()
                for key in keys(_matrix(column(batch, "x")), turns, mean):
                    a, b = prefix_range(key, depth)
                    first = np.searchsorted(high, a)
                    n = np.maximum(np.searchsorted(low, b, side="right") - first, 0)
                    of = np.repeat(np.arange(len(q)), n)
                    yield pa.RecordBatch.from_arrays([pa.array(part[ragged(first, n)].astype(np.int32)), pa.array(q[of]), pa.array(key[of]), pa.array(depth[of])], names=["part", "query_id", "key", "depth"])

        return mapped(asked.select("query_id", "x", F.col("depth").cast("int").alias("depth")), run, "part int, query_id long, key long, depth int")

    def met(self, asked: DataFrame, run, schema: str) -> DataFrame:
        """``run(head, rows)`` for each part and the queries that are routed to it, a batch of these at a time."""
        none = lambda kind: F.lit(None).cast(kind)
        heads = self.parts.select("part", none("long").alias("query_id"), none("long").alias("key"), none("int").alias("depth"), "keys", "at")
        rows = self.routed(asked).select("part", "query_id", "key", "depth", none("binary").alias("keys"), none("binary").alias("at"))
        return _streamed(heads.union(rows), "part", lambda b, i: [np.frombuffer(column(b, c)[i].as_py(), np.int64) for c in ("keys", "at")], run, schema)


def _streamed(both: DataFrame, group: str, load, run, schema: str) -> DataFrame:
    """Each group's head (its row without a ``query_id``) and then its queries: only the head and one batch are held."""

    def stream(batches):
        head = None
        for batch in batches:
            starts = np.flatnonzero(column(batch, "query_id").is_null().to_numpy(zero_copy_only=False))
            if len(starts) == 0 or starts[0] > 0:
                yield from run(head, batch.slice(0, starts[0] if len(starts) else batch.num_rows)) if batch.num_rows else ()
            for a, b in zip(starts, np.append(starts, batch.num_rows)[1:], strict=True):  # none, if a group goes on through a whole batch
                head = load(batch, int(a))
                if b > a + 1:
                    yield from run(head, batch.slice(a + 1, b - a - 1))

    dealt = both.repartition(tasks(both.sparkSession), group).sortWithinPartitions(group, F.col("query_id").asc_nulls_first())
    return mapped(dealt, stream, schema)


def _marks(head, rows, share: float):
    """For each query, the sampled vectors under its one-symbol prefix in this part: their cells, and how many symbols they share."""
    key, at = head
    h = mix(at.astype(np.uint64))
    some = np.flatnonzero(h.astype(np.float64) < share * 2.0**64)
    key, cell = key[some], (h[some] & np.uint64(CELLS - 1)).astype(np.int64)
    asked = column(rows, "key").to_numpy()
    low, high = (np.stack(z) for z in zip(*((np.searchsorted(key, a), np.searchsorted(key, b, side="right")) for a, b in (prefix_range(asked, d) for d in range(1, SYMBOLS + 1))), strict=True))
    n = high[0] - low[0]
    for s in _passes(n):
        i, of = ragged(low[0, s], n[s]), np.repeat(np.arange(s.start, s.stop), n[s])
        depth = ((low[:, of] <= i) & (i < high[:, of])).sum(axis=0)
        yield pa.RecordBatch.from_arrays([column(rows, "query_id").slice(s.start, s.stop - s.start), _binaries((depth * CELLS + cell[i]).astype("<u2"), n[s])], names=["query_id", "marks"])


def _depths(batches, cells: float):
    """The longest prefix, of the same length in all trees, under which enough distinct vectors lie; 0 if there is none."""
    for batch in batches:
        out = []
        for parts in column(batch, "marks").to_pylist():
            mark, deepest = np.frombuffer(b"".join(parts), "<u2"), np.zeros(CELLS, np.int64)
            np.maximum.at(deepest, mark % CELLS, mark // CELLS)
            upto = np.cumsum(np.bincount(deepest, minlength=SYMBOLS + 1)[::-1])[::-1]  # cells with so many symbols at least
            out.append(max((d for d in range(1, SYMBOLS + 1) if upto[d] >= cells), default=0))
        yield pa.RecordBatch.from_arrays([column(batch, "query_id"), pa.array(out, pa.int32())], names=["query_id", "depth"])


def _candidates(head, rows):
    """For each query and block, the places of the vectors under the query's prefix in this part."""
    key, at = head
    low, high = prefix_range(column(rows, "key").to_numpy(), column(rows, "depth").to_numpy())
    low, high = np.searchsorted(key, low), np.searchsorted(key, high, side="right")
    n, q = high - low, column(rows, "query_id").to_numpy()
    for s in _passes(n):
        found, of = at[ragged(low[s], n[s])], np.repeat(np.arange(s.start, s.stop), n[s])
        order = np.lexsort((found, of))
        block, of, place = found[order] >> 16, of[order], (found[order] & 0xFFFF).astype("<u2")
        if not len(of):
            continue
        new = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (of[1:] != of[:-1])]))
        yield pa.RecordBatch.from_arrays([pa.array(q[of[new]]), pa.array(block[new].astype(np.int32)), _binaries(place, np.diff(np.append(new, len(of))))], names=["query_id", "block", "places"])


def _nearest(head, rows, k: int):
    """For each query, the nearest of its candidates in this block, which are all of the block's where none are named."""
    ids, x = head
    found = []
    for own, q, places in zip(column(rows, "query_id").to_pylist(), _matrix(column(rows, "x")), column(rows, "places").to_pylist(), strict=True):
        c = np.arange(len(ids)) if places is None else np.unique(np.frombuffer(b"".join(places), "<u2"))
        score = np.sqrt(((x[c] - q) ** 2).sum(axis=1))
        best = np.lexsort((ids[c], score))[:k]
        found.append((np.full(len(best), own), ids[c[best]], score[best]))
    a, b, score = (np.concatenate(z) for z in zip(*found, strict=True))
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(score, pa.float64())], names=["query_id", "vec_id", "score"])


def search(vectors: DataFrame, every: int = 100, k: int = 10, trees: int = TREES, candidates: int | None = None, seed: int = 7) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found of each vector whose id is divisible by ``every``.

    The index holds all rows: in each of ``trees`` trees, a sorted array of long
    hash strings, built once and cut by ranges. A query descends every tree to its
    longest matching prefixes and ascends them all together, one symbol at a
    time, until the prefixes hold ``candidates`` distinct vectors (``enough``)
    over all trees; the distances of all vectors there are computed in doubles.
    If even single symbols hold fewer, the ascent ends at the roots, which hold
    all vectors: that is so for all queries of small tables, and then the result
    is exact. Directions are taken from the mean of the distinct vectors, as one
    that all share would put most rows under the same prefixes. No sample is
    fitted: rotations are random.

    Equal vectors are one in the index, and searched for once: their rows are told
    apart at the end, of which ``k`` and the query's own are enough. So a group
    of equal vectors, however large, is a row a task at most. Two passes: parts
    of the sorted arrays meet the queries that are routed to them, and say in
    sketches, which merge, how many distinct vectors lie under each length of
    prefix; then they hand the places under the chosen one to the vectors'
    blocks, of which each returns its ``k`` nearest. Costs grow with candidates,
    never with pairs of blocks.

    Vectors of each dimension are searched among themselves; those that
    ``usable`` leaves out take no part. Ties go to the smaller vec_id.
    """
    spark = prepare(vectors.sparkSession)
    rows = cut(usable(vectors).withColumn("dim", F.size("x")))
    dims = [r.dim for r in rows.select("dim").distinct().orderBy("dim").collect()]
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.union, [_search(rows.where(F.col("dim") == d).select("vec_id", "x"), d, every, k, trees, candidates, seed) for d in dims])


def depths(index: Index, asked: DataFrame, need: int) -> DataFrame:
    """``asked(query_id, x)`` with the ``depth`` at which each query's ascent ends."""
    share = min(1.0, SAMPLED / need)
    cells = CELLS * (1 - math.exp(-need * share / CELLS))
    marks = index.met(asked.withColumn("depth", F.lit(1)), lambda head, rows: _marks(head, rows, share), "query_id long, marks binary")
    per = marks.groupBy("query_id").agg(F.collect_list("marks").alias("marks"))
    depth = mapped(per, lambda b: _depths(b, cells), "query_id long, depth int")
    return asked.join(depth, "query_id", "left").select("query_id", "x", F.coalesce("depth", F.lit(0)).alias("depth"))


def _search(rows: DataFrame, dim: int, every: int, k: int, trees: int, candidates: int | None, seed: int) -> DataFrame:
    """``search`` among vectors of one dimension."""
    first = F.row_number().over(Window.partitionBy("x").orderBy("vec_id"))
    some = rows.withColumn("r", first).where(F.col("r") <= k + 1)
    distinct = cut(some.groupBy("x").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("vec_id", F.get("ids", F.lit(0))))
    n = distinct.count()
    index = Index(distinct, n, dim, trees, seed)
    own = cut(rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("own_id"), "x").join(distinct.select("x", F.col("vec_id").alias("query_id")), "x").select("own_id", "query_id"))
    asked = distinct.select(F.col("vec_id").alias("query_id"), "x").join(own.select("query_id").distinct(), "query_id", "left_semi")
    deep = cut(depths(index, asked, enough(n) if candidates is None else candidates))

    # candidates meet their query's vector first, then the blocks
    found = index.met(deep.where("depth > 0"), _candidates, "query_id long, block int, places binary").repartition("query_id").groupBy("query_id", "block").agg(F.collect_list("places").alias("places"))
    found = found.join(deep.select("query_id", "x"), "query_id").select("block", "query_id", "x", "places")
    roots = deep.where("depth = 0").select(F.explode(F.sequence(F.lit(0), F.lit(index.n_blocks - 1))).alias("block"), "query_id", "x", F.lit(None).cast("array<binary>").alias("places"))
    none = lambda kind: F.lit(None).cast(kind)
    heads = index.blocks.select("block", none("long").alias("query_id"), none("array<double>").alias("x"), none("array<binary>").alias("places"), "ids", "xs")
    both = heads.union(found.union(roots).select("*", none("binary").alias("ids"), none("binary").alias("xs")))
    load = lambda b, i: (np.frombuffer(column(b, "ids")[i].as_py(), np.int64), np.frombuffer(column(b, "xs")[i].as_py()).reshape(-1, dim))
    near = _streamed(both, "block", load, lambda head, rows: _nearest(head, rows, k + 1), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    best = near.withColumn("r", rank).where(F.col("r") <= k + 1)

    # distinct vectors → rows: each stands for its rows with the smallest ids
    each = best.join(distinct.select("vec_id", "ids"), "vec_id").select("query_id", F.explode(F.transform("ids", lambda i: F.struct(F.col("score"), i.alias("vec_id")))).alias("hit"))
    lists = each.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list("hit")), 1, k + 1).alias("hits"))
    whole = own.join(lists, "query_id").select(F.col("own_id").alias("query_id"), F.slice(F.filter("hits", lambda h: h["vec_id"] != F.col("own_id")), 1, k).alias("hits"))
    return whole.select("query_id", F.posexplode("hits").alias("rank", "hit")).select("query_id", (F.col("rank") + 1).alias("rank"), "hit.vec_id", "hit.score")
