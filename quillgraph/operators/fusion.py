"""Evidence of several channels, normalised, weighted and ranked together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.functions.fixed import WEIGHTS

CHANNELS = ("vector", "keyword", "graph")


def channel(hits: DataFrame, name: str) -> DataFrame:
    return hits.select("query_id", F.lit(name).alias("channel"), "chunk_ord", "score")


def minmax(hits: DataFrame) -> DataFrame:
    """``hits(query_id, channel, chunk_ord, score)`` with ``norm``: scores of a question's channel from 0 to 1; a single value is 1 if positive, else 0."""
    own = Window.partitionBy("query_id", "channel")
    ranged = hits.withColumn("lo", F.min("score").over(own)).withColumn("hi", F.max("score").over(own))
    flat = F.when(F.col("hi") > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    norm = F.when(F.col("hi") == F.col("lo"), flat).otherwise((F.col("score") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)))
    return ranged.withColumn("norm", norm).drop("lo", "hi")


def total(weights: dict[str, float]) -> Column:
    return reduce(lambda a, b: a + b, (F.lit(float(w)) * F.col(c) for c, w in weights.items()))


def fuse(hits: DataFrame, chunks: DataFrame | None = None, k: int = 8, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """``(query_id, chunk_ord, vector, keyword, graph, total, rank)``: the ``k`` best of all channels' candidates.

    Channels are stacked and turned into columns by one grouping instead of full
    outer joins; a channel without a candidate gives it 0. With ``chunks``, only
    candidates that exist there count. Ties go to the earlier chunk.
    """
    one = lambda c: F.coalesce(F.max(F.when(F.col("channel") == c, F.col("norm"))), F.lit(0.0)).alias(c)
    wide = minmax(hits).groupBy("query_id", "chunk_ord").agg(*(one(c) for c in CHANNELS))
    if chunks is not None:
        wide = wide.join(chunks.select("chunk_ord"), "chunk_ord", "left_semi")
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("total", 9)), "chunk_ord")
    ranked = wide.withColumn("total", total(weights)).withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= k).select("query_id", "chunk_ord", *CHANNELS, "total", "rank")


def contexts(fused: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(query_id, n_chunks, context)``: each question's chunks in rank order as one text."""
    rows = fused.join(chunks.select("chunk_ord", "text"), "chunk_ord")
    block = F.format_string("[Context %d | %s | score=%.3f]\n%s", F.col("rank"), T.chunk_id(F.col("chunk_ord")), F.col("total"), F.col("text"))
    found = rows.groupBy("query_id").agg(F.collect_list(F.struct(F.col("rank").alias("ord"), block.alias("value"))).alias("v"))
    return found.select("query_id", F.size("v").cast("long").alias("n_chunks"), F.array_join(T.ordered_values(F.col("v")), "\n\n").alias("context"))
