"""Entity mentions, and subject-predicate-object triplets from parsed tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.functions.fixed import MODIFIERS, OBJECTS, ROOT_POS, SUBJECTS


def mentions(chunks: DataFrame, label: str = "") -> DataFrame:
    """``(chunk_ord, ent_pos, text, label)``: capitalised names of each chunk, the first of each folded form.

    Stands in for a model's recogniser where there is none; ``dedup_mentions``
    serves either.
    """
    each = chunks.select("chunk_ord", F.posexplode_outer(T.mentioned(F.col("text"))).alias("ent_pos", "text")).where("ent_pos is not null").withColumn("label", F.lit(label))
    return dedup_mentions(each)


def dedup_mentions(mentions: DataFrame) -> DataFrame:
    """The first mention of each folded text and label in a chunk, trimmed."""
    first = F.min_by(F.struct("ent_pos", F.trim("text").alias("text")), "ent_pos").alias("m")
    found = mentions.where(F.trim("text") != "").groupBy("chunk_ord", T.fold(F.col("text")).alias("norm"), "label").agg(first)
    return found.select("chunk_ord", "m.ent_pos", "m.text", "label")


def query_names(questions: DataFrame, *more: str) -> DataFrame:
    """``(query_id, pos, name)``: ordered distinct names of each question; array columns ``more`` (a model's entities, noun chunks of three words at most) come first."""
    arrays = [F.coalesce(F.col(c), F.array().cast("array<string>")) for c in more]
    every = F.array_distinct(F.concat(*arrays, T.names(F.col("text"))))
    return questions.select("query_id", F.posexplode(every).alias("pos", "name"))


def short_noun_chunks(noun_chunks):
    """Noun chunks of at most three words."""
    return F.filter(noun_chunks, lambda c: F.size(F.split(F.trim(c), r"\s+")) <= 3)


def spans(tokens: DataFrame, depth: int = 12) -> DataFrame:
    """``(chunk_ord, sent_id, i, span)``: each token with the modifiers below it, in order of the sentence.

    The pairs of token and descendant are closed by doubling: after ``n`` joins
    they reach ``2**n`` levels, and ``depth`` levels are enough for any parse.
    """
    key = ["chunk_ord", "sent_id"]
    up = tokens.where("head_i <> i").select(*key, F.col("head_i").alias("top"), F.col("i").alias("low"))
    reach, levels = up, 1
    while levels < depth:
        more = reach.select(*key, "top", F.col("low").alias("mid")).join(reach.select(*key, F.col("top").alias("mid"), "low"), [*key, "mid"]).select(*key, "top", "low")
        reach, levels = reach.union(more).distinct(), 2 * levels
    below = reach.join(tokens.where(F.col("dep").isin(*MODIFIERS)).select(*key, F.col("i").alias("low"), "text"), [*key, "low"]).select(*key, F.col("top").alias("i"), "low", "text")
    own = tokens.select(*key, "i", F.col("i").alias("low"), "text")
    found = own.union(below).groupBy(*key, "i").agg(F.collect_list(F.struct(F.col("low").alias("ord"), F.col("text").alias("value"))).alias("v"))
    return found.select(*key, "i", F.array_join(T.ordered_values(F.col("v")), " ").alias("span"))


def triplets(tokens: DataFrame) -> DataFrame:
    """``tokens(chunk_ord, sent_id, i, text, lemma, pos, dep, head_i)`` → ``(chunk_ord, sent_id, s_i, o_i, subject, predicate, object)``.

    A sentence's first root that is a verb, its subjects, and objects attached to
    it or one level below; all joins are within a sentence.
    """
    key = ["chunk_ord", "sent_id"]
    root = tokens.where((F.col("dep") == "ROOT") & F.col("pos").isin(*ROOT_POS)).groupBy(*key).agg(F.min_by(F.struct("i", "lemma"), "i").alias("r")).select(*key, F.col("r.i").alias("root"), F.col("r.lemma").alias("predicate"))
    heads = tokens.select(*key, F.col("i").alias("head_i"), F.col("head_i").alias("head_head"))
    subject = tokens.where(F.col("dep").isin(*SUBJECTS)).select(*key, F.col("i").alias("s_i"), F.col("head_i").alias("root"))
    object_ = tokens.where(F.col("dep").isin(*OBJECTS)).join(heads, [*key, "head_i"]).select(*key, F.col("i").alias("o_i"), "head_i", "head_head")
    pairs = root.join(subject, [*key, "root"]).join(object_, key).where((F.col("head_i") == F.col("root")) | (F.col("head_head") == F.col("root")))
    full = spans(tokens)
    named = pairs.join(full.select(*key, F.col("i").alias("s_i"), F.trim("span").alias("subject")), [*key, "s_i"]).join(full.select(*key, F.col("i").alias("o_i"), F.trim("span").alias("object")), [*key, "o_i"])
    sane = (F.col("subject") != "") & (F.col("object") != "") & (F.lower("subject") != F.lower("object"))
    return named.where(sane).select(*key, "s_i", "o_i", "subject", F.trim("predicate").alias("predicate"), "object")


def dedup_triplets(triplets: DataFrame) -> DataFrame:
    """``triplets(triplet_ord, subject, predicate, object, chunk_id)``: the first of each folded triple in the whole corpus."""
    folded = [T.fold(F.col(c)).alias(f"k{n}") for n, c in enumerate(("subject", "predicate", "object"))]
    cols = ("triplet_ord", "subject", "predicate", "object", "chunk_id")
    return triplets.groupBy(*folded).agg(F.min_by(F.struct(*cols), "triplet_ord").alias("t")).select("t.*")
