"""The driver's tables as files, chunks, questions, vectors, mentions and triplets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators import chunking, entities

#: Mentions of the star schema come in chunks numbered from these on.
CUSTOMERS, SUPPLIERS = 1_000, 10_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a text file."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("src_ord"), F.concat(F.lit("corpus/doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.coalesce("text", F.lit("")).alias("text"))


def whole_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as one chunk."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_ord"), "text")


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence windows of all documents, numbered."""
    sections = chunking.sections(document_files(spark, sf_dir))
    keys = ["src_ord", "sec_ord"]
    return chunking.number(chunking.windows(sections.select(*keys, "text"), keys), keys)


def document_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.mentions(document_chunks(spark, sf_dir))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_ord"), "embedding")


def question_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector for each question, by a synthetic link: the one whose number is the question's."""
    return questions(spark, sf_dir).select("query_id").join(vectors(spark, sf_dir).withColumnRenamed("chunk_ord", "query_id"), "query_id")


def star_mentions(spark: SparkSession, sf_dir: str, customers: bool = True) -> DataFrame:
    """Names of the star schema with labels, two to a chunk: nations and regions, customers (or none) and nations, suppliers and nations."""
    t = lambda n: table(spark, sf_dir, n)
    region, nation = t("region"), t("nation")

    def pairs(df: DataFrame, ord_, a: str, a_label: str, b: str, b_label: str) -> DataFrame:
        both = F.array(F.struct(F.lit(0).alias("ent_pos"), F.col(a).alias("text"), F.lit(a_label).alias("label")), F.struct(F.lit(1).alias("ent_pos"), F.col(b).alias("text"), F.lit(b_label).alias("label")))
        return df.select(ord_.cast("long").alias("chunk_ord"), F.explode(both).alias("e")).select("chunk_ord", "e.*")

    n = pairs(nation.join(region, nation.n_regionkey == region.r_regionkey), F.col("n_nationkey"), "n_name", "GPE", "r_name", "LOC")
    c = t("customer").join(nation, F.col("c_nationkey") == nation.n_nationkey)
    s = t("supplier").join(nation, F.col("s_nationkey") == nation.n_nationkey)
    both = n.union(pairs(c, F.col("c_custkey") + CUSTOMERS, "c_name", "PERSON", "n_name", "DATE")) if customers else n
    return both.union(pairs(s, F.col("s_suppkey") + SUPPLIERS, "s_name", "ORG", "n_name", "GPE"))


def star_triplets(spark: SparkSession, sf_dir: str, customers: bool = True) -> DataFrame:
    """Facts of the star schema, with or without customers; each supplier's comes again in capitals."""
    t = lambda n: table(spark, sf_dir, n)
    region, nation = t("region"), t("nation")

    def fact(df: DataFrame, ord_, subject, predicate: str, object_: str, chunk: str) -> DataFrame:
        return df.select(ord_.cast("long").alias("triplet_ord"), subject.alias("subject"), F.lit(predicate).alias("predicate"), F.col(object_).alias("object"), F.concat(F.lit(chunk), ord_.cast("string")).alias("chunk_id"))

    s = t("supplier").join(nation, F.col("s_nationkey") == nation.n_nationkey)
    c = t("customer").join(nation, F.col("c_nationkey") == nation.n_nationkey)
    n = nation.join(region, nation.n_regionkey == region.r_regionkey)
    parts = [
        fact(n, F.col("n_nationkey"), F.col("n_name"), "part of", "r_name", "n"),
        fact(s, F.col("s_suppkey") + CUSTOMERS, F.col("s_name"), "operates in", "n_name", "s"),
        fact(s, F.col("s_suppkey") + SUPPLIERS, F.upper(F.concat(F.lit(" "), F.col("s_name"))), "OPERATES IN", "n_name", "t"),
        fact(c, F.col("c_custkey") + 2 * SUPPLIERS, F.col("c_name"), "lives in", "n_name", "c"),
    ]
    return reduce(DataFrame.union, parts if customers else parts[:3])


def customer_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parsed sentence for each customer, as a parser would give it: "Loyal <name> family orders <key> parts from new <nation>".

    Every third has no verb at its root, and every third is passive.
    """
    both = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    kind, key = F.col("c_custkey") % 3, F.col("c_custkey").cast("string")
    rows = [
        ("Loyal", "loyal", "ADJ", "amod", 2), (F.col("c_name"), F.col("c_name"), "PROPN", "compound", 2), ("family", "family", "NOUN", F.when(kind == 1, "nsubjpass").otherwise("nsubj"), 3),
        ("orders", "order", F.when(kind == 0, "NOUN").otherwise("VERB"), "ROOT", 3), (key, key, "NUM", "nummod", 5), ("parts", "part", "NOUN", "dobj", 3),
        ("from", "from", "ADP", "prep", 3), ("new", "new", "ADJ", "amod", 8), (F.col("n_name"), F.col("n_name"), "PROPN", "pobj", 6),
    ]
    names = ("text", "lemma", "pos", "dep", "head_i")
    one = [F.struct(F.lit(i).alias("i"), *((v if isinstance(v, Column) else F.lit(v)).alias(n) for n, v in zip(names, r, strict=True))) for i, r in enumerate(rows)]
    return both.select(F.col("c_custkey").alias("chunk_ord"), F.lit(0).alias("sent_id"), F.explode(F.array(*one)).alias("t")).select("chunk_ord", "sent_id", "t.*")
