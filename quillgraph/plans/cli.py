"""``python -m quillgraph.plans.cli ingest|graph|vectors|ask|export``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillgraph.operators import graph as G
from quillgraph.plans import engine
from quillgraph.plans.config import Config
from quillgraph.sources import artifacts, export


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillgraph")
    p.add_argument("--folder", default="artifacts", help="where the tables are")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("ingest")
    a.add_argument("--input", default="knowledge_base/")
    a.add_argument("--chunk_size", type=int, default=512)
    a.add_argument("--chunk_overlap", type=int, default=64)
    a = sub.add_parser("graph")
    a.add_argument("--show", action="store_true", help="print the hubs")
    a.add_argument("--bfs_demo", metavar="NODE")
    a = sub.add_parser("vectors")
    a.add_argument("--query")
    a.add_argument("--top_k", type=int, default=5)
    a = sub.add_parser("ask")
    a.add_argument("question", nargs="?", help="without one, questions are read until a blank line")
    a.add_argument("--provider")
    a.add_argument("--model")
    a = sub.add_parser("export")
    a.add_argument("--to", help="a folder; without one, the database of the environment")
    a.add_argument("--clear", action="store_true", help="delete all that is in the database first")
    return p


def _ask() -> str:
    try:
        return input("? ").strip()
    except EOFError:
        return ""


def _tell(got: dict) -> None:
    """An answer, what led to it, and the chunks that it rests on."""
    print(got["answer"])
    for what, shown in (("entities", 10), ("nodes", 8)):
        more = len(got[what]) - shown
        print(f"{what}: " + (", ".join(got[what][:shown]) or "none") + (f" and {more} more" if more > 0 else ""))
    print("hits: " + ", ".join(f"{channel} {n}" for channel, n in got["hits"].items()))
    for t in got["trace"]:
        print("  {rank}. chunk {chunk_ord}: vector {vector:.3f}, keyword {keyword:.3f}, graph {graph:.3f}, total {total:.3f}".format(**t))


def main(args: list[str] | None = None) -> int:
    o = parser().parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    try:
        if o.command == "ingest":
            chunks, triplets = engine.ingest(spark, o.input, o.folder, o.chunk_size, o.chunk_overlap)
            chunks.orderBy("chunk_ord").limit(3).show(truncate=100)
            if triplets is not None:
                triplets.orderBy("triplet_ord").limit(8).show(truncate=60)
        elif o.command == "graph":
            graph = engine.build_graph(spark, o.folder)
            if o.show:
                G.hubs(graph.nodes).select("id", "label", "entity_type", "betweenness_centrality", "degree_centrality").show(truncate=40)
            if o.bfs_demo:
                start = graph.nodes.where(F.col("id") == o.bfs_demo.lower()).select(F.col("id").alias("seed"))
                G.traverse(start, graph.edges, 2).orderBy("hop", "id").show(50)
        elif o.command == "vectors":
            engine.build_vectors(spark, o.folder)
            if o.query:
                from quillgraph.operators import lexical

                asked = spark.createDataFrame([(0, o.query)], "query_id long, text string")
                lexical.search(asked, artifacts.read_lexical(spark, o.folder), o.top_k).orderBy("rank").show()
        elif o.command == "ask":
            with engine.Retriever(spark, o.folder, Config.from_env(provider=o.provider, model=o.model)) as r:
                print(", ".join(f"{n} {what}" for what, n in r.counts().items()))
                for question in [o.question] if o.question else iter(_ask, ""):
                    _tell(r.query(question))
        else:
            graph = artifacts.read_graph(spark, o.folder)
            if o.to:
                export.write_files(graph.nodes, graph.edges, o.to)
            else:
                to = export.Database.from_env()
                export.write_database(graph.nodes, graph.edges, export.Database(to.uri, to.password, to.user, to.name, o.clear))
    except (FileNotFoundError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
