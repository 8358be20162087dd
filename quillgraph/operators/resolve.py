"""Fuzzy entity resolution: first come, first canonical."""

from __future__ import annotations

from bisect import bisect_left
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.functions.fixed import SAME_ENTITY
from quillgraph.operators.ranking import cut

#: Names of a line that are looked at together once its head has joined another block.
AHEAD = 32

#: Characters of signatures; each has a column of counts.
_PLACE = {c: k for k, c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789- ")}


class Resolver:
    """Canonical signatures in order of arrival. A name joins the most alike one that it is compared with, from the threshold on.

    Names are compared in full only if their characters' counts allow the
    threshold, which is one pass of numpy over all rivals: shared characters
    bound the matching blocks of two names, and so their likeness.
    """

    def __init__(self, threshold: float = SAME_ENTITY):
        self.threshold, self.known, self.blocks = threshold, {}, {}
        self.names: list[str] = []
        self.counts, self.sizes = np.zeros((64, len(_PLACE) + 1), np.int16), np.zeros(64)

    def _likeness(self, old: str, new: str) -> float:
        short, long = sorted((len(old), len(new)))
        return short / long if new in old or old in new else SequenceMatcher(None, new, old).ratio()

    def _remember(self, sig: str, counts: np.ndarray) -> int:
        at = len(self.names)
        if at == len(self.sizes):
            self.counts, self.sizes = np.concatenate([self.counts, np.zeros_like(self.counts)]), np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        self.names.append(sig)
        self.counts[at], self.sizes[at] = counts, len(sig)
        return at

    def add(self, sig: str) -> str:
        if sig in self.known:
            return self.known[sig]
        own = np.bincount([_PLACE.get(c, len(_PLACE)) for c in sig], minlength=len(_PLACE) + 1)
        block = self.blocks.setdefault(sig.split(" ", 1)[0][:3], [])
        # the block's canonical names, or all names of the first character, aliases too
        rivals = np.array(block) if block else np.flatnonzero([s[0] == sig[0] for s in self.names])
        best, score = None, 0.0
        if len(rivals):
            bound = 2 * np.minimum(self.counts[rivals], own).sum(axis=1) / (self.sizes[rivals] + len(sig))
            for k in rivals[bound >= self.threshold - 1e-9].tolist():
                s = self._likeness(self.names[k], sig)
                if s > score:
                    best, score = self.known[self.names[k]], s
        at = self._remember(sig, own)
        if best is not None and score >= self.threshold:
            self.known[sig] = best
        else:
            self.known[sig] = sig
            block.append(at)
        return self.known[sig]


def _signs(sigs: list[str]) -> np.ndarray:
    """Counts of each name's characters."""
    return np.stack([np.bincount([_PLACE.get(c, len(_PLACE)) for c in s], minlength=len(_PLACE) + 1) for s in sigs])


def _alike_before(batches, openers: list[tuple[int, str]], threshold: float):
    """For each opener, the names before it with its first character that are alike enough."""
    likeness = Resolver(threshold)._likeness
    by_char: dict[str, list[tuple[int, str]]] = {}
    for o in openers:
        by_char.setdefault(o[1][0], []).append(o)
    counts = {c: _signs([s for _, s in v]) for c, v in by_char.items()}
    for batch in batches:
        rows = {}
        for sig, seen in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if sig[0] in by_char:
                rows.setdefault(sig[0], []).append((seen, sig))
        found = []
        for c, own in rows.items():
            own.sort()
            sizes, signs = np.array([len(s) for _, s in own]), _signs([s for _, s in own])
            for opener, sign in zip(by_char[c], counts[c], strict=True):
                n = bisect_left(own, opener)  # only names that came first
                bound = 2 * np.minimum(signs[:n], sign).sum(axis=1) / (sizes[:n] + len(opener[1]))
                for k in np.flatnonzero(bound >= threshold - 1e-9).tolist():
                    score = likeness(own[k][1], opener[1])
                    if score >= threshold:
                        found.append((opener[1], own[k][1], own[k][0], score))
        kinds = (pa.string(), pa.string(), pa.int64(), pa.float64())
        cols = list(zip(*found, strict=True)) if found else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, kinds, strict=True)], names=["opener", "target", "seen", "score"])


def _openers(first: DataFrame, threshold: float) -> dict[str, str]:
    """Names that came while their block had no canonical name and joined another block's: each with the name it is most like.

    Blocks are three characters of an alphabet of 37, so at most some 52,000 have
    a name at the head of their line, and only lines whose heads all joined other
    blocks are followed further, ``AHEAD`` names at a time.
    """
    line = F.row_number().over(Window.partitionBy("block").orderBy("first_seen", "signature"))
    joined: dict[str, str] = {}
    start, size, ranked = 0, 1, first.withColumn("n", line)
    pending: DataFrame | None = None
    while True:
        heads = ranked.where((F.col("n") > start) & (F.col("n") <= start + size))
        if pending is not None:
            heads = heads.join(pending, "block", "left_semi")
        rows = heads.select("block", "n", "first_seen", "signature").orderBy("block", "n").collect()
        openers = [(r.first_seen, r.signature) for r in rows]
        near = first.select("signature", "first_seen").mapInArrow(lambda b, o=openers: _alike_before(b, o, threshold), "opener string, target string, seen long, score double")
        best = near.groupBy("opener").agg(F.min_by("target", F.struct(-F.col("score"), "seen", "target")).alias("target"))
        found, waiting, opened = dict(best.collect()) if openers else {}, set(), set()
        for r in rows:
            if r.block not in opened:
                if r.signature in found:
                    joined[r.signature] = found[r.signature]
                    waiting.add(r.block)
                else:
                    opened.add(r.block)
        waiting -= opened
        if not waiting:
            return joined
        pending = first.sparkSession.createDataFrame([(b,) for b in sorted(waiting)], "block string")
        start, size = start + size, AHEAD


def resolve(names: DataFrame, threshold: float = SAME_ENTITY) -> DataFrame:
    """``names(ord, text)`` → ``(signature, canonical, first_seen)`` for each distinct signature that isn't empty.

    Order decides, so names are taken in order of first sight. A name is compared
    with its block's canonical names; while there are none, with all names before it
    that share its first character. The latter are found first, all blocks at
    once over all names (``_openers``); after that blocks don't depend on each
    other, and each is a task over its distinct signatures, not mentions.
    """
    sigs = names.select("ord", T.signature(F.col("text")).alias("signature")).where("signature <> ''")
    first = cut(sigs.groupBy("signature").agg(F.min("ord").cast("long").alias("first_seen")).withColumn("block", T.block(F.col("signature"))))
    joined = _openers(first, threshold)
    # a target may have joined another block's name itself, which came before it
    ends = {}
    for s, t in joined.items():
        while t in joined:
            t = joined[t]
        ends[s] = t
    moved = first.sparkSession.createDataFrame(list(ends.items()), "signature string, target string")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["first_seen", "signature"])
        one = Resolver(threshold)
        return group.assign(canonical=[one.add(s) for s in group.signature])[["signature", "canonical", "first_seen"]]

    own = first.join(moved, "signature", "left_anti").groupBy("block").applyInPandas(run, "signature string, canonical string, first_seen long")
    if not ends:
        return own
    own = cut(own)
    others = first.join(moved, "signature").join(own.select(F.col("signature").alias("target"), "canonical"), "target")
    return own.union(others.select("signature", "canonical", "first_seen"))
