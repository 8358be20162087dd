"""Build all tables from files, and answer questions from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.functions.fixed import EXACT_NODES
from quillgraph.operators import chunking, entities, fusion, lexical, ranking, retrieve, vectors
from quillgraph.operators import graph as G
from quillgraph.operators import resolve as R
from quillgraph.plans import answer
from quillgraph.plans.config import Config
from quillgraph.sources import artifacts, files


def embed(chunks: DataFrame) -> DataFrame:
    """``(chunk_ord, embedding)`` by the offline stand-in; a model's vectors have the same shape."""
    return chunks.select("chunk_ord", vectors.hashed_embedding(T.tokens(F.col("text"))).alias("embedding"))


def ingest(spark: SparkSession, path: str, folder: str, chunk_size: int = 512, chunk_overlap: int = 64, tokens: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Sections, windows and, from parsed ``tokens`` if there are any, triplets; written and read back."""
    sections = files.read_sources(spark, path)
    keys = ["src_ord", "sec_ord"]
    windows = chunking.number(chunking.windows(sections.select(*keys, "text"), keys, chunk_size, chunk_overlap), keys)
    chunks = windows.join(sections.select(*keys, "source_ref"), keys).select("chunk_ord", "chunk_id", "text", "source_ref")
    found = None
    if tokens is not None:
        ord_ = ((F.col("chunk_ord") * 1_000 + F.col("sent_id")) * 1_000 + F.col("s_i")) * 1_000 + F.col("o_i")
        found = entities.dedup_triplets(entities.triplets(tokens).select(ord_.cast("long").alias("triplet_ord"), "subject", "predicate", "object", T.chunk_id(F.col("chunk_ord")).alias("chunk_id")))
    artifacts.write_chunks(chunks, found, folder)
    return artifacts.read(spark, folder, "chunks"), artifacts.read(spark, folder, "triplets") if found is not None else None


def build_graph(spark: SparkSession, folder: str, fuzzy: bool = True) -> G.Graph:
    """Mentions, resolution, nodes with centralities, edges; written and read back."""
    chunks = artifacts.read(spark, folder, "chunks")
    triplets = artifacts.read(spark, folder, "triplets") if artifacts.exists(spark, folder, "triplets") else None
    mentions, key = entities.mentions(chunks), None
    if fuzzy:
        ord_ = (F.col("chunk_ord") * 100_000 + F.col("ent_pos")).cast("long")
        resolution = R.resolve(mentions.select(ord_.alias("ord"), "text")).select("signature", "canonical")
        mentions = mentions.withColumn("signature", T.signature(F.col("text"))).join(resolution, "signature", "left")
        key = F.coalesce("canonical", T.node_key(F.col("text")))
    graph = G.build_graph(mentions, triplets, key)
    nodes = G.number_nodes(graph.nodes)
    nodes = nodes.join(G.degrees(graph), "id").join(ranking.betweenness(nodes, graph.edges, EXACT_NODES), "id")
    artifacts.write_graph(G.Graph(nodes, graph.edges), folder)
    return artifacts.read_graph(spark, folder)


def build_vectors(spark: SparkSession, folder: str) -> None:
    """Vectors and the keyword index of the chunks."""
    chunks = artifacts.read(spark, folder, "chunks")
    artifacts.write(embed(chunks), folder, "vectors")
    artifacts.write_lexical(lexical.build_index(chunks), folder)


class Retriever:
    """Answers questions, many at a time, from what a build has written."""

    def __init__(self, spark: SparkSession, folder: str, config: Config | None = None):
        lost = artifacts.missing(spark, folder)
        if lost:
            raise FileNotFoundError(f"{folder} lacks {', '.join(lost)}; run the builds first")
        self.spark, self.config = spark, (config or Config.from_env()).checked()
        self.chunks = artifacts.read(spark, folder, "chunks")
        self.vectors = artifacts.read(spark, folder, "vectors")
        self.graph = artifacts.read_graph(spark, folder)
        self.index = artifacts.read_lexical(spark, folder)
        self.ranks = ranking.pagerank(self.graph.nodes, self.graph.edges).cache()

    def __enter__(self) -> Retriever:
        return self

    def __exit__(self, *_) -> None:
        self.ranks.unpersist()

    def hits(self, questions: DataFrame) -> DataFrame:
        """``(query_id, channel, chunk_ord, score)`` of all channels."""
        c = self.config
        asked = questions.select("query_id", vectors.hashed_embedding(T.tokens(F.col("text"))).alias("embedding"))
        found = fusion.channel(vectors.search(asked, self.vectors, c.top_k_vector), "vector")
        if self.index is not None:
            found = found.union(fusion.channel(lexical.search(questions, self.index, c.top_k_keyword), "keyword"))
        matches = retrieve.match_nodes(entities.query_names(questions), self.graph.nodes)
        graph = retrieve.graph_hits(matches, self.graph, self.ranks, self.graph.nodes, c.max_hops)
        ids = self.chunks.select("chunk_id", "chunk_ord")
        return found.union(fusion.channel(graph.join(ids, "chunk_id"), "graph"))

    def retrieve(self, questions: DataFrame) -> DataFrame:
        """``questions(query_id, text)`` → ``(query_id, question, context, prompt, trace)``; the trace lists chunks with each channel's share."""
        fused = fusion.fuse(self.hits(questions), self.chunks, self.config.max_chunks, self.config.weights)
        trace = fused.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_ord", *fusion.CHANNELS, "total"))).alias("trace"))
        both = questions.select("query_id", F.col("text").alias("question")).join(fusion.contexts(fused, self.chunks), "query_id", "left").join(trace, "query_id", "left")
        context = F.coalesce("context", F.lit(""))
        return both.select("query_id", "question", context.alias("context"), answer.prompt(context, F.col("question")).alias("prompt"), "trace")

    def query(self, question: str) -> dict:
        """One question's answer and trace: its entities, the nodes that they led to, and each channel's hits."""
        asked = self.spark.createDataFrame([(0, question)], "query_id long, text string")
        row = self.retrieve(asked).first()
        found = self.traces(asked).first()
        hits = {r["channel"]: r["count"] for r in self.hits(asked).groupBy("channel").count().collect()}
        return {
            "answer": answer.call(row["prompt"], self.config), "context": row["context"], "trace": [t.asDict() for t in row["trace"] or []],
            "entities": found["entities"], "nodes": found["nodes"], "hits": {c: hits.get(c, 0) for c in fusion.CHANNELS},
        }

    def traces(self, questions: DataFrame, entities_shown: int | None = None, nodes_shown: int | None = None) -> DataFrame:
        """``(query_id, entities, nodes)`` of each question, in order, cut to so many if a number is given."""
        names = entities.query_names(questions)
        matches = retrieve.match_nodes(names, self.graph.nodes)
        listed = lambda df, ord_, value, n: df.groupBy("query_id").agg(T.head(T.ordered_values(F.collect_list(F.struct(F.col(ord_).alias("ord"), F.col(value).alias("value")))), n).alias("v"))
        none = F.array().cast("array<string>")
        both = questions.select("query_id").join(listed(names, "pos", "name", entities_shown).withColumnRenamed("v", "entities"), "query_id", "left").join(listed(matches, "pos", "id", nodes_shown).withColumnRenamed("v", "nodes"), "query_id", "left")
        return both.select("query_id", F.coalesce("entities", none).alias("entities"), F.coalesce("nodes", none).alias("nodes"))

    def counts(self) -> dict[str, int]:
        return {"nodes": self.graph.nodes.count(), "edges": self.graph.edges.count(), "chunks": self.chunks.count()}
