"""Quality classifier: a generalised additive model with pairwise interactions, of cyclically boosted shallow trees."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, cut, mapped, prepare, slices, utf8
from .textstats import FEATURES, counts, features

#: Labelled documents that one model is fitted on: those with the least hashes of their ids, if there are more.
SAMPLE = 50_000


@dataclass
class Gam:
    """Additive scores: a constant, a table for each feature's bins, and a table for each chosen pair's coarser bins.

    Each round visits the features in turn and fits a tree of two splits at most
    (three neighbouring groups of bins) to the gradient; its values are added to
    the feature's table. Pairs are then picked by what a split of both into
    quadrants explains of the residual, and boosted alike, so a model is only
    tables: scoring adds up a few looked-up numbers.
    """

    n_bins: int = 64
    n_pair_bins: int = 8
    n_pairs: int = 6
    rounds: int = 120
    pair_rounds: int = 40
    rate: float = 0.15
    ridge: float = 8.0
    smallest: float = 4.0
    start: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: np.ndarray | None = None
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    @staticmethod
    def _cuts(x: np.ndarray, n: int) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        at = np.unique(np.quantile(x, np.linspace(0, 1, n + 1)[1:-1], method="lower"))
        return at[at < x.max()]

    def _tree(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The best two splits of a row of bins; values by Newton steps with a ridge."""
        gs, hs = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])

        def gain(a, b):
            return (gs[b] - gs[a]) ** 2 / (hs[b] - hs[a] + self.ridge)

        n = len(g)
        marks = [0, n]
        for _ in range(2):
            best, where = 1e-9, None
            for a, b in zip(marks[:-1], marks[1:], strict=True):
                c = np.arange(a + 1, b)
                if not len(c):
                    continue
                more = np.where((hs[c] - hs[a] > self.smallest / 4) & (hs[b] - hs[c] > self.smallest / 4), gain(a, c) + gain(c, b) - gain(a, b), 0)
                k = int(more.argmax())
                if more[k] > best:
                    best, where = more[k], int(c[k])
            if where is None:
                break
            marks = sorted([*marks, where])
        out = np.zeros(n)
        for a, b in zip(marks[:-1], marks[1:], strict=True):
            out[a:b] = (gs[b] - gs[a]) / (hs[b] - hs[a] + self.ridge)
        return out

    @staticmethod
    def _proba(s: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(s, -40, 40)))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Gam:
        """Fit on rows ``x`` and labels ``y`` of 0 and 1. Without both labels the model is a constant."""
        share = (y.sum() + 1) / (len(y) + 2)
        self.start = float(np.log(share / (1 - share)))
        k = x.shape[1]
        self.edges = [self._cuts(x[:, j], self.n_bins) for j in range(k)]
        self.tables = np.zeros((k, self.n_bins))
        if len(np.unique(y)) < 2:
            return self
        bins = self._bins(x)
        s = np.full(len(y), self.start)
        for _ in range(self.rounds):
            for j in range(k):
                p = self._proba(s)
                g, h = (np.bincount(bins[:, j], weights=w, minlength=self.n_bins) for w in (y - p, p * (1 - p)))
                step = self.rate * self._tree(g, h)
                self.tables[j] += step
                s += step[bins[:, j]]
        self.pair_edges = [self._cuts(x[:, j], self.n_pair_bins) for j in range(k)]
        coarse = self._coarse(x)
        p = self._proba(s)
        self.pairs = sorted(combinations(range(k), 2), key=lambda ij: -self._quadrants(coarse, ij, y - p, p * (1 - p)))[: self.n_pairs]
        self.pair_tables = [np.zeros((self.n_pair_bins, self.n_pair_bins)) for _ in self.pairs]
        for _ in range(self.pair_rounds):
            for t, (i, j) in enumerate(self.pairs):
                p = self._proba(s)
                g, h = (self._grid(coarse, (i, j), w) for w in (y - p, p * (1 - p)))
                a, b = self._best_quadrants(g, h)
                step = np.zeros_like(g)
                for rows in (slice(0, a), slice(a, None)):
                    for cols in (slice(0, b), slice(b, None)):
                        step[rows, cols] = self.rate * g[rows, cols].sum() / (h[rows, cols].sum() + self.ridge)
                self.pair_tables[t] += step
                s += step[coarse[:, i], coarse[:, j]]
        return self

    def _grid(self, coarse: np.ndarray, ij: tuple[int, int], w: np.ndarray) -> np.ndarray:
        m = self.n_pair_bins
        return np.bincount(coarse[:, ij[0]] * m + coarse[:, ij[1]], weights=w, minlength=m * m).reshape(m, m)

    def _gains(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        gs, hs = (np.pad(z.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for z in (g, h))
        total = np.zeros_like(gs)
        for z in ((gs, hs), (gs[:, -1:] - gs, hs[:, -1:] - hs), (gs[-1:] - gs, hs[-1:] - hs), (gs[-1, -1] - gs[-1:] - gs[:, -1:] + gs, hs[-1, -1] - hs[-1:] - hs[:, -1:] + hs)):
            total += z[0] ** 2 / (np.maximum(z[1], 0) + self.ridge)
        return total

    def _best_quadrants(self, g: np.ndarray, h: np.ndarray) -> tuple[int, int]:
        return tuple(int(v) for v in np.unravel_index(self._gains(g, h).argmax(), (g.shape[0] + 1, g.shape[1] + 1)))

    def _quadrants(self, coarse, ij, g, h) -> float:
        return float(self._gains(self._grid(coarse, ij, g), self._grid(coarse, ij, h)).max())

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)

    def _coarse(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.pair_edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 of each row: bins are looked up and added."""
        s = np.full(len(x), self.start)
        if len(x):
            bins = self._bins(x)
            for j in range(x.shape[1]):
                s += self.tables[j][bins[:, j]]
            if self.pairs:
                coarse = self._coarse(x)
                for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
                    s += t[coarse[:, i], coarse[:, j]]
        return self._proba(s)


def measured(docs: DataFrame) -> DataFrame:
    """``(doc_id, x)``: each text's ``FEATURES``."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                x = features(counts(*utf8(column(part, "text"))))
                flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), flat], names=["doc_id", "x"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return mapped(plain, run, "doc_id long, x array<double>")


def held_out() -> F.Column:
    """Whether a document is in the fold that nothing is learnt from."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def fit(x: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, **options) -> Gam:
    """A model of ``label`` from ``x(doc_id, x)`` of the labelled documents outside the held-out fold.

    At most ``sample`` of them reach the driver, those whose ids hash lowest. A
    document with several labels counts with each of them; null labels don't.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).where("y is not null")
    rows = x.join(known.where(~held_out()), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample).select("x", "y").toArrow()
    y = rows.column("y").to_numpy()
    flat = rows.column("x").combine_chunks().flatten().to_numpy().reshape(len(y), len(FEATURES))
    return Gam(**options).fit(flat, y)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every document.

    Inputs are counts of the whole text only. Null and empty texts are scored
    like any other; a null doc_id is scored but never learnt from, and is not
    held out; without labels of both kinds all scores are the labels' smoothed
    share; repeated rows stay; no documents give no rows.
    """
    spark = prepare(docs.sparkSession)
    x = cut(measured(docs))
    model = spark.sparkContext.broadcast(fit(x, labels, sample=sample))

    def run(batches):
        for batch in batches:
            rows = column(batch, "x").flatten().to_numpy().reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "held_out"), pa.array(model.value.score(rows))], names=["doc_id", "held_out", "score"])

    scored = x.withColumn("held_out", held_out()).mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
