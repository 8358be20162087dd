"""Graph retrieval: questions' names matched to nodes, traversed, and credited to chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators import graph as G


def match_nodes(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """``names(query_id, pos, name)`` × ``nodes(id, node_ord)`` → ``(query_id, id, pos)``: distinct matches in order.

    A name matches the node of its own lower-cased text, or else the first node
    in order that contains it or lies in it. Exact matches are a hash join; only
    distinct names without one are compared with nodes, in one broadcast of
    those few names, which come from the questions and not from the corpus.
    """
    asked = names.withColumn("q", F.lower(F.trim("name")))
    exact = asked.join(nodes.select(F.col("id").alias("q"), "node_ord"), "q").select("query_id", "pos", F.col("q").alias("id"))
    left = asked.join(nodes.select(F.col("id").alias("q")), "q", "left_anti").select("q").distinct()
    inside = F.col("id").contains(F.col("q")) | F.col("q").contains(F.col("id"))
    near = nodes.select("id", "node_ord").join(left, inside).groupBy("q").agg(F.min_by("id", "node_ord").alias("id"))
    loose = asked.join(near, "q").select("query_id", "pos", "id")
    return exact.union(loose).groupBy("query_id", "id").agg(F.min("pos").alias("pos"))


def graph_hits(matches: DataFrame, graph: G.Graph, ranks: DataFrame, degrees: DataFrame, hops: int = 2) -> DataFrame:
    """``(query_id, chunk_id, score)``: for each matched node and each node in its reach that mentions a chunk, one plus rank plus degree centrality."""
    reach = G.traverse(matches.select(F.col("id").alias("seed")).distinct(), graph.edges, hops)
    worth = graph.nodes.select("id", "chunk_ids").join(ranks, "id", "left").join(degrees.select("id", "degree_centrality"), "id", "left")
    worth = worth.select("id", "chunk_ids", (1 + F.coalesce("pr", F.lit(0.0)) + F.coalesce("degree_centrality", F.lit(0.0))).alias("w"))
    # credited to seeds' chunks once, then to the questions that have the seed
    seed = reach.join(worth, "id").select("seed", F.explode("chunk_ids").alias("chunk_id"), "w").groupBy("seed", "chunk_id").agg(F.sum("w").alias("w"))
    return matches.select("query_id", F.col("id").alias("seed")).join(seed, "seed").groupBy("query_id", "chunk_id").agg(F.sum("w").alias("score"))
