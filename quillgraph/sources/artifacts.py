"""What a build leaves behind: one Parquet dataset for each table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators.graph import Graph
from quillgraph.operators.lexical import LexicalIndex

LEXICAL = ("postings", "terms", "lengths", "stats")
#: Tables without which no question can be answered; the keyword index and triplets may be missing.
NEEDED = ("chunks", "nodes", "edges", "vectors")


def write(df: DataFrame, folder: str, name: str) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/{name}")


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}")


def exists(spark: SparkSession, folder: str, name: str) -> bool:
    try:
        read(spark, folder, name)
    except AnalysisException:
        return False
    return True


def missing(spark: SparkSession, folder: str) -> list[str]:
    return [n for n in NEEDED if not exists(spark, folder, n)]


def write_chunks(chunks: DataFrame, triplets: DataFrame | None, folder: str) -> None:
    write(chunks, folder, "chunks")
    if triplets is not None:
        write(triplets, folder, "triplets")


def write_graph(graph: Graph, folder: str) -> None:
    """Nodes and edges; what edges hold as sets is sorted."""
    write(graph.nodes, folder, "nodes")
    write(graph.edges.withColumns({c: F.array_sort(c) for c in ("predicates", "relation_types", "chunk_ids")}), folder, "edges")


def read_graph(spark: SparkSession, folder: str) -> Graph:
    return Graph(read(spark, folder, "nodes"), read(spark, folder, "edges"))


def write_lexical(index: LexicalIndex, folder: str) -> None:
    for name in LEXICAL:
        write(getattr(index, name), folder, name)


def read_lexical(spark: SparkSession, folder: str) -> LexicalIndex | None:
    if not all(exists(spark, folder, n) for n in LEXICAL):
        return None
    return LexicalIndex(*(read(spark, folder, n) for n in LEXICAL))
