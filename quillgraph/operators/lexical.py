"""Keyword search: an inverted index as tables, scored by BM25."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.functions.fixed import B, K1

#: Scores of chunks and questions that are held at once.
SCORES = 200_000


@dataclass
class LexicalIndex:
    """``postings(token, chunk_ord, tf)``, ``terms(token, df, idf)``, ``lengths(chunk_ord, dl)``, ``stats(doc_count, avgdl)``."""

    postings: DataFrame
    terms: DataFrame
    lengths: DataFrame
    stats: DataFrame


def build_index(chunks: DataFrame) -> LexicalIndex:
    """Index ``chunks(chunk_ord, text)``. Chunks without tokens count for the number of documents and have length one."""
    tokens = chunks.select("chunk_ord", T.tokens(F.col("text")).alias("tokens"))
    # an inner explosion would make Spark infer a filter, which would evaluate the tokens twice
    each = tokens.select("chunk_ord", F.explode_outer("tokens").alias("token")).where("token is not null")
    postings = each.groupBy("token", "chunk_ord").agg(F.count("*").cast("int").alias("tf"))
    lengths = tokens.select("chunk_ord", F.greatest(F.size("tokens"), F.lit(1)).alias("dl"))
    stats = lengths.agg(F.count("*").alias("doc_count"), F.avg("dl").alias("avgdl"))
    df = postings.groupBy("token").agg(F.count("*").alias("df"))
    idf = F.log((F.col("doc_count") + 1) / (F.col("df") + 1)) + 1
    terms = df.join(F.broadcast(stats), F.lit(True)).select("token", "df", idf.alias("idf"))  # one row
    return LexicalIndex(postings, terms, lengths, stats)


def _weights(asked: DataFrame) -> tuple[list[int], dict[str, int], list[tuple[int, int, int, int]]]:
    """The questions' distinct tokens and which question asks which, how often and where first. Questions are a batch, not the corpus."""
    wanted = asked.groupBy("query_id", "token").agg(F.count("*").alias("times"), F.min("pos").alias("pos")).collect()
    names = sorted({r.query_id for r in wanted})
    at, place = {q: k for k, q in enumerate(names)}, {}
    for token in sorted({r.token for r in wanted}):
        place[token] = len(place)
    return names, place, sorted((place[r.token], at[r.query_id], r.times, r.pos) for r in wanted)


def _best_of_batches(batches, names: list[int], tokens: list[str], wanted, idf: np.ndarray, avgdl: float, k: int):
    """The ``k`` best chunks of each question over a task's chunks, whose ``found`` tokens are scored as they come."""
    token, query, times, pos = (np.array(c) for c in zip(*wanted, strict=True))
    start = np.searchsorted(token, np.arange(len(tokens) + 1))
    table = pa.array(tokens, pa.string())
    best = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.float64, np.int64))
    for batch in batches:
        chunk, dl, lists = batch.column("chunk_ord").to_numpy(), batch.column("dl").to_numpy(), batch.column("found")
        row = np.repeat(np.arange(len(chunk)), np.diff(lists.offsets.to_numpy()))
        what = pc.index_in(lists.flatten(), table).to_numpy(zero_copy_only=False)
        pairs, tf = np.unique(row * len(tokens) + what, return_counts=True)
        row, what = pairs // len(tokens), pairs % len(tokens)
        length = np.maximum(dl[row], 1)
        worth = idf[what] * tf * (K1 + 1) / np.maximum(tf + K1 * (1 - B + B * length / avgdl), 1e-9)
        # so many chunks at a time that their products with all questions stay few
        width = max(1, SCORES // len(names))
        for a in range(0, len(chunk), width):
            lo, hi = np.searchsorted(row, (a, a + width))
            n = start[what[lo:hi] + 1] - start[what[lo:hi]]
            each = np.repeat(np.arange(lo, hi), n)
            entry = np.repeat(start[what[lo:hi]] - np.cumsum(n) + n, n) + np.arange(len(each))
            cell = query[entry] * width + row[each] - a
            score = np.bincount(cell, times[entry] * worth[each], len(names) * width)
            first = np.full(len(score), np.iinfo(np.int64).max)
            np.minimum.at(first, cell, pos[entry])
            score[first == np.iinfo(np.int64).max] = -np.inf
            grid = score.reshape(len(names), width)
            least = np.partition(grid, -k, axis=1)[:, -k] - 1e-9 if width > k else np.full(len(names), -np.inf)
            q, r = np.nonzero((grid >= least[:, None]) & (grid > -np.inf))
            new = (q, chunk[a + r], grid[q, r], first.reshape(grid.shape)[q, r])
            q, c, s, p = (np.concatenate(x) for x in zip(best, new, strict=True))
            order = np.lexsort((c, p, -np.round(s, 9), q))
            q = q[order]
            keep = np.arange(len(q)) - np.searchsorted(q, q) < k
            best = q[keep], c[order][keep], s[order][keep], p[order][keep]
    yield pa.RecordBatch.from_arrays([pa.array(np.array(names, np.int64)[best[0]]), *map(pa.array, best[1:])], names=["query_id", "chunk_ord", "score", "pos"])


def _ranked(chunks: DataFrame, names, place, wanted, df: dict[str, int], doc_count: int, avgdl: float, k: int) -> DataFrame:
    idf = np.array([math.log((doc_count + 1) / (df.get(t, 0) + 1)) + 1 for t in place])
    near = chunks.mapInArrow(lambda b: _best_of_batches(b, names, list(place), wanted, idf, avgdl, k), "query_id long, chunk_ord long, score double, pos long")
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "pos", "chunk_ord")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("pos")


def _nothing(questions: DataFrame) -> DataFrame:
    return questions.where("false").select(F.col("query_id").cast("long"), F.lit(0).cast("long").alias("chunk_ord"), F.lit(0.0).alias("score"), F.lit(0).alias("rank"))


def _asked(questions: DataFrame) -> DataFrame:
    return questions.select("query_id", F.posexplode(T.tokens(F.col("text"))).alias("pos", "token"))


def search(questions: DataFrame, index: LexicalIndex, k: int = 5) -> DataFrame:
    """``questions(query_id, text)`` → ``(query_id, chunk_ord, score, rank)``: the ``k`` best chunks of each.

    A repeated term counts as often as it is asked. Ties go to the term that is
    asked first, then to the earlier chunk. Only postings of asked terms are
    grouped by chunk; each task scores its chunks and hands on ``k`` a question.
    """
    names, place, wanted = _weights(_asked(questions))
    stats = index.stats.first()
    if not wanted or not stats["doc_count"]:
        return _nothing(questions)
    ours = F.col("token").isin(*place)
    df = {r.token: r.df for r in index.terms.where(ours).select("token", "df").collect()}
    found = index.postings.where(ours).groupBy("chunk_ord").agg(F.flatten(F.collect_list(F.array_repeat("token", F.col("tf")))).alias("found"))
    rows = found.join(index.lengths, "chunk_ord", "left").select("chunk_ord", F.coalesce("dl", F.lit(1)).cast("long").alias("dl"), "found")
    return _ranked(rows, names, place, wanted, df, stats["doc_count"], stats["avgdl"], k)


def search_chunks(questions: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """``search`` over ``chunks(chunk_ord, text)`` without an index: texts are read twice, for what is asked only, and not shuffled."""
    names, place, wanted = _weights(_asked(questions))
    if not wanted:
        return _nothing(questions)
    tokens = chunks.select("chunk_ord", T.tokens(F.col("text")).alias("tokens"))
    rows = tokens.select("chunk_ord", F.greatest(F.size("tokens"), F.lit(1)).cast("long").alias("dl"), F.filter("tokens", lambda t: t.isin(*place)).alias("found"))
    counts = {r.token: r.n for r in rows.mapInArrow(_count_batches, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()}
    n, total = counts.pop("# chunks", 0), counts.pop("# tokens", 0)
    if not n:
        return _nothing(questions)
    return _ranked(rows, names, place, wanted, counts, n, total / n, k)


def _count_batches(batches):
    """How many chunks have each token, and under two names that no token has, all chunks and their lengths."""
    counts = Counter()
    for batch in batches:
        lists = batch.column("found")
        row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        words = pc.dictionary_encode(lists.flatten())
        names = words.dictionary.to_pylist()
        once = np.unique(row * max(1, len(names)) + words.indices.to_numpy(zero_copy_only=False))
        for name, n in zip(names, np.bincount(once % max(1, len(names)), minlength=len(names)).tolist(), strict=True):
            counts[name] += n
        counts["# chunks"] += batch.num_rows
        counts["# tokens"] += int(batch.column("dl").to_numpy().sum())
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["token", "n"])
