"""Exact inner-product search, in blocks of queries against blocks of vectors."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK, QUERIES = 16_384, 2_048
#: Queries and vectors of a block whose products are held at once: 8 MB.
SLICE, ROWS = 128, 8_192


def normalise(vector: Column) -> Column:
    """A vector of length one; a zero vector stays."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    size = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(wide, lambda x: F.when(size == 0, x).otherwise(x / size).cast("float"))


def hashed_embedding(tokens: Column, dim: int = 64) -> Column:
    """An offline stand-in for a model: signed counts of hashed tokens, of length one."""
    at = lambda t: F.pmod(F.xxhash64(t), F.lit(dim))
    sign = lambda t: F.when(F.pmod(F.hash(t), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    zero = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda _: F.lit(0.0))
    total = F.aggregate(tokens, zero, lambda acc, t: F.transform(acc, lambda v, i: F.when(i == at(t), v + sign(t)).otherwise(v)))
    return normalise(total)


def _matrix(table: pa.Table) -> np.ndarray:
    col = table.column("x").combine_chunks()
    return col.flatten().to_numpy().reshape(len(col), -1)


def _best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best of each query, ties to the smaller id."""
    order = np.lexsort((ids, -np.round(score, 9), query))
    query = query[order]
    keep = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[keep], ids[order][keep], score[order][keep]


def _block_top(queries: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """Products are taken of ``SLICE`` queries with ``ROWS`` vectors at a time, and only those as good as the ``k``-th are sorted."""
    found = []
    if queries.num_rows and rows.num_rows:
        names, asked = queries.column("query_id").to_numpy(), _matrix(queries)
        ids, near = rows.column("chunk_ord").to_numpy(), _matrix(rows)
        for a in range(0, len(asked), SLICE):
            best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            for b in range(0, len(near), ROWS):
                score = asked[a : a + SLICE] @ near[b : b + ROWS].T
                least = np.full(len(score), -np.inf)
                if score.shape[1] > k:
                    least = np.partition(score, -k, axis=1)[:, -k] - 1e-9
                # written so that values that aren't numbers stay in
                q, r = np.nonzero(~(score < least[:, None]))
                best = _best(*(np.concatenate(c) for c in zip(best, (q, ids[b + r], score[q, r]), strict=True)), k)
            found.append((names[a + best[0]], *best[1:]))
    parts = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pa.table({"query_id": pa.array(parts[0], pa.int64()), "chunk_ord": pa.array(parts[1], pa.int64()), "score": pa.array(parts[2], pa.float64())})


def search(queries: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """``queries(query_id, embedding)`` × ``vectors(chunk_ord, embedding)`` → ``(query_id, chunk_ord, score, rank)``.

    Products are in doubles. Each task multiplies one block of queries with one
    block of vectors and returns ``k`` a query; the blocks' results are then
    ranked. Ties go to the earlier chunk. Null vectors take no part.
    """
    wide = F.transform("embedding", lambda v: v.cast("double"))
    rows = vectors.where("embedding is not null").select("chunk_ord", wide.alias("x"))
    asked = queries.where("embedding is not null").select("query_id", wide.alias("x"))
    n_d, n_q = (max(1, math.ceil(df.count() / size)) for df, size in ((rows, BLOCK), (asked, QUERIES)))
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    data = rows.withColumn("d", deal("chunk_ord", n_d)).withColumn("q", copies(n_q))
    ask = asked.withColumn("q", deal("query_id", n_q)).withColumn("d", copies(n_d))
    near = ask.groupBy("q", "d").cogroup(data.groupBy("q", "d")).applyInArrow(lambda a, b: _block_top(a, b, k), "query_id long, chunk_ord long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "chunk_ord")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
