"""Exact removal of repeated 50-word passages behind a count-min prefilter."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, cut, joined, mapped, prepare, ragged, slices, span_hashes, stored, tasks, utf8, window_hashes, words

#: Words of the sampled grams whose least hash stands for a window in the sketch.
GRAM = 16
#: Cells of each of the two sketch rows: eight for every expected sample, between these powers of two.
#: Two rows of 2**28 cells, two bits each, are 128 MB: the most that is ever sent to a task.
LEAST_BITS, MOST_BITS = 18, 28
#: Windows whose samples are this frequent are gathered into segments, pre-aggregated and joined; the
#: others, of which a key can have no more rows than that, are compared in one sorted pass.
HOT = 2048
#: Segments of hot windows end after one window in 2**SEGMENT_BITS, by its hash, and after so many at most.
SEGMENT_BITS, SEGMENT_MOST = 4, 256
_ROWS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_BLOCK_BITS = 16


def _block_bits(bits: int) -> int:
    return min(_BLOCK_BITS, bits)


def window_samples(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` words the least hash of its inner grams: equal windows have equal samples."""
    gram = min(GRAM, width)
    low = window_hashes(h, gram, 0xA0761D6478BD642F)
    span, have = width - gram + 1, 1
    while have < span:
        step = min(have, span - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    return low


def _windows(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows that lie in one text, as word indices, and the texts' indices."""
    n = np.maximum(first[1:] - first[:-1] - width + 1, 0)
    return ragged(first[:-1], n), np.repeat(np.arange(len(n)), n)


def _cells(sample: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(sample * np.uint64(k)) >> np.uint64(64 - bits) for k in _ROWS]


def _sketch(batches, width: int, bits: int):
    """A task's part of the sketch: for each block, the cells that it adds to and how much."""
    held, n, low = [], 0, _block_bits(bits)

    def flush():
        if not held:
            return
        every = np.concatenate(held)
        for row, cell in enumerate(_cells(every, bits)):
            cell, count = np.unique(cell, return_counts=True)
            count = np.minimum(count, 65535).astype("<u2")
            block = (cell >> np.uint64(low)).astype(np.int64)
            edge = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else np.zeros(0, np.int64)
            inner = (cell & np.uint64((1 << low) - 1)).astype("<u2")
            parts = [inner[a:b].tobytes() + count[a:b].tobytes() for a, b in zip(edge, np.append(edge[1:], len(block)), strict=True)]
            for at in range(0, len(parts), 1024):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(parts[at : at + 1024]), row, np.int32)), pa.array(block[edge[at : at + 1024]].astype(np.int32)), pa.array(parts[at : at + 1024], pa.binary())], names=["row", "block", "cells"])

    for batch in batches:
        for part in slices(batch):
            raw, offsets = utf8(column(part, "text"))
            starts, ends, first = words(raw, offsets)
            at, text = _windows(first, width)
            if not len(at):
                continue
            sample = window_samples(span_hashes(raw, starts, ends, 1), width)[at]
            # neighbours mostly share a sample: one for each run in a text, but all of a run that is longer
            # than a gram's reach, where few windows take turns
            new = np.flatnonzero(np.concatenate([[True], (sample[1:] != sample[:-1]) | (text[1:] != text[:-1])]))
            run = np.diff(np.append(new, len(sample)))
            held.append(np.repeat(sample[new], np.where(run > width - min(GRAM, width) + 1, run, 1)))
            n += len(held[-1])
            if n > 4_000_000:
                yield from flush()
                held, n = [], 0
    yield from flush()


def _merge(batches, bits: int, hot: int):
    """Sorted parts of blocks → for each block the bits of cells that got two or more, and of hot ones, one block at a time."""
    size, now, total = 1 << _block_bits(bits), None, None

    def out():
        return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), *(pa.array([np.packbits(total >= n, bitorder="little").tobytes()], pa.binary()) for n in (2, hot))], names=["row", "block", "bits", "hot"])

    for batch in batches:
        for row, block, cells in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (row, block) != now:
                if now is not None:
                    yield out()
                now, total = (row, block), np.zeros(size, np.int64)
            cell, count = np.frombuffer(cells, "<u2").reshape(2, -1)
            total[cell] += count
    if now is not None:
        yield out()


def _frequent(docs: DataFrame, width: int, hot: int, bits: int | None) -> tuple[int, list[bytes]]:
    """The merged sketch: its bits a row, and for each row the cells whose count is at least two, then the hot ones."""
    if bits is None:
        total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        # about one sample for 100 bytes of text
        bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(8 * total / 100 + 1))))
    parts = mapped(docs.select("text"), lambda b: _sketch(b, width, bits), "row int, block int, cells binary")
    merged = parts.repartition(tasks(docs.sparkSession), "row", "block").sortWithinPartitions("row", "block").mapInArrow(lambda b: _merge(b, bits, hot), "row int, block int, bits binary, hot binary")
    rows = [np.zeros((1 << bits) // 8, np.uint8) for _ in range(2 * len(_ROWS))]
    for r in merged.collect():  # bounded: at most 4 x 2**MOST_BITS bits
        at = r["block"] << (_block_bits(bits) - 3)
        for k, found in enumerate((r["bits"], r["hot"])):
            rows[r["row"] + k * len(_ROWS)][at : at + len(found)] = np.frombuffer(found, np.uint8)
    return bits, [r.tobytes() for r in rows]


def digests(own: bytes, to: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128 bits of the SHA-256 of each span of words, joined by single spaces: two 64-bit numbers a span."""
    found = [hashlib.sha256(own[x:y]).digest()[:16] for x, y in zip(to[begin].tolist(), (to[end] - 1).tolist(), strict=True)]
    return np.frombuffer(b"".join(found), "<u8").reshape(-1, 2)


def _runs(batch: pa.RecordBatch, width: int, bits: int, rows: list[np.ndarray], hot_ones: bool):
    """A slice's windows that the sketch holds to be repeated, the hot ones or the others, a row for a run of equal ones, which a word said over and over makes.

    The digest of a window's words, where the run starts, how many windows it has, its text's index, and a
    function that gives the digests of all words in the windows of adjoining runs.
    """
    raw, offsets = utf8(column(batch, "text"))
    starts, ends, first = words(raw, offsets)
    at, text = _windows(first, width)
    if not len(at):
        return None
    h = span_hashes(raw, starts, ends, 1)
    sample, keep, hot = window_samples(h, width)[at], np.ones(len(at), bool), np.ones(len(at), bool)
    for row, warm, cell in zip(rows[: len(_ROWS)], rows[len(_ROWS) :], _cells(sample, bits), strict=True):
        byte, bit = (cell >> np.uint64(3)).astype(np.int64), (cell & np.uint64(7)).astype(np.uint8)
        keep &= (row[byte] >> bit) & 1 == 1
        hot &= (warm[byte] >> bit) & 1 == 1
    keep &= hot == hot_ones
    if not keep.any():
        return None
    at, text = at[keep], text[keep]
    own, to = joined(raw, starts, ends)
    key = digests(own, to, at, at + width)
    new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1) | (at[1:] != at[:-1] + 1) | (text[1:] != text[:-1])]))
    n = np.diff(np.append(new, len(at)))
    begin = at[new]

    def whole(start: np.ndarray) -> np.ndarray:
        last = np.append(start[1:], len(begin)) - 1
        return digests(own, to, begin[start], begin[last] + n[last] - 1 + width)

    return key[new], begin - first[text[new]], n, text[new], whole


def _halves(key: np.ndarray) -> list[pa.Array]:
    return [pa.array(np.ascontiguousarray(key[:, k]).view(np.int64)) for k in (0, 1)]


def _candidates(batches, width: int, bits: int, sketch):
    """Windows that are repeated but not hot: the digest of their words, and where they start."""
    rows = [np.frombuffer(r, np.uint8) for r in sketch.value]
    for batch in batches:
        for part in slices(batch):
            found = _runs(part, width, bits, rows, False)
            if found is None:
                continue
            key, at, n, text, _ = found
            doc, print_ = column(part, "doc_id").to_numpy(zero_copy_only=False)[text], column(part, "text_id").to_numpy()[text]
            for i in range(0, len(at), 1 << 18):
                j = slice(i, i + (1 << 18))
                cols = [*_halves(key[j]), pa.array(doc[j].astype(np.int64)), pa.array(print_[j]), pa.array(at[j].astype(np.int32)), pa.array(n[j].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, names=["h", "g", "doc_id", "text_id", "at", "n"])


def segment_starts(a: np.ndarray, at: np.ndarray, n: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Where segments of adjoining runs begin: after a run whose hash says so, so that a shared passage is cut alike in every text."""
    new = np.concatenate([[True], (text[1:] != text[:-1]) | (at[1:] != at[:-1] + n[:-1]) | (a[:-1] >> np.uint64(64 - SEGMENT_BITS) == 0)])
    i = np.arange(len(at))
    return np.flatnonzero(new | ((i - np.maximum.accumulate(np.where(new, i, 0))) % SEGMENT_MOST == 0))


def _segments(batches, width: int, bits: int, sketch):
    """Segments of hot windows: the digest of all their words, where they start, and the runs in them."""
    rows = [np.frombuffer(r, np.uint8) for r in sketch.value]
    for batch in batches:
        for part in slices(batch):
            found = _runs(part, width, bits, rows, True)
            if found is None:
                continue
            key, at, n, text, whole = found
            start = segment_starts(key[:, 0], at, n, text)
            runs = pa.StructArray.from_arrays([*_halves(key), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))], names=["h", "g", "at", "n"])
            runs = pa.ListArray.from_arrays(pa.array(np.append(start, len(at)).astype(np.int32)), runs)
            doc, print_ = column(part, "doc_id").to_numpy(zero_copy_only=False)[text[start]], column(part, "text_id").to_numpy()[text[start]]
            cols = [*_halves(whole(start)), pa.array(doc.astype(np.int64)), pa.array(print_), pa.array(at[start].astype(np.int32)), pa.array(np.add.reduceat(n, start).astype(np.int32)), runs]
            whole_batch = pa.RecordBatch.from_arrays(cols, names=["h", "g", "doc_id", "text_id", "at", "n", "runs"])
            for i in range(0, len(start), 1 << 14):
                yield whole_batch.slice(i, 1 << 14)


def covered(n: int, at: np.ndarray, run: np.ndarray, width: int) -> np.ndarray:
    """Which of ``n`` words lie in the windows of runs that start at ``at``."""
    edge = np.bincount(at, minlength=n + 1) - np.bincount(at + run - 1 + width, minlength=n + 1)
    return np.cumsum(edge[:-1]) > 0


def _apply(batches, width: int, texts: bool):
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * texts
    for batch in batches:
        for part in slices(batch):
            raw, offsets = utf8(column(part, "text"))
            starts, ends, first = words(raw, offsets)
            removed = np.zeros(len(starts), bool)
            found = column(part, "at")
            for i in np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False)):
                removed[first[i] : first[i + 1]] = covered(int(first[i + 1] - first[i]), *(found[int(i)].values.field(k).to_numpy().astype(np.int64) for k in (0, 1)), width)
            gone = np.concatenate([[0], np.cumsum(removed)])
            own, to = joined(raw, starts[~removed], ends[~removed])
            left = first - gone[first]
            kept = [own[to[a] : to[b] - 1] if b > a else b"" for a, b in zip(left[:-1].tolist(), left[1:].tolist(), strict=True)]
            out = [column(part, "doc_id"), pa.array(first[1:] - first[:-1]), pa.array(gone[first[1:]] - gone[first[:-1]]), pa.array([hashlib.sha256(x).hexdigest() for x in kept])]
            yield pa.RecordBatch.from_arrays(out + [pa.array([x.decode() for x in kept], pa.string())] * texts, names=names)


def _text_id() -> F.Column:
    """Tells texts of one doc_id apart."""
    return F.xxhash64("text")


def _late_hot(segments: DataFrame) -> DataFrame:
    """``(doc_id, text_id, at, n)``: runs of hot windows that start in a document with a smaller doc_id.

    A segment that also stands in a smaller document is late as a whole, one row
    instead of one for each window. Only the smallest document of each distinct
    segment shows its windows one by one: any other document of a window has the
    same segment earlier, so their minimum is the window's minimum.
    """
    keys = ["h", "g"]
    least = segments.groupBy(*keys).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select(*keys, "low")
    met = segments.join(stored(least, "least"), keys, "left")
    none = F.array(F.struct(F.lit(None).cast("long").alias("h"), F.lit(None).cast("long").alias("g"), "at", "n"))
    shown = met.select("doc_id", "text_id", F.explode(F.when(F.col("doc_id") > F.col("low"), none).otherwise(F.col("runs"))).alias("r"))
    shown = cut(shown.select("doc_id", "text_id", "r.*"))
    alone = shown.where("h is not null")
    first = alone.groupBy(*keys).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select(*keys, "low")
    rest = alone.join(stored(first, "first"), keys).where("doc_id > low")
    return shown.where("h is null").select("doc_id", "text_id", "at", "n").union(rest.select("doc_id", "text_id", "at", "n"))


def repeated_windows(docs: DataFrame, width: int = 50, hot: int = HOT, bits: int | None = None) -> DataFrame:
    """``(doc_id, text_id, at, n)``: runs of windows whose words also start somewhere in a document with a smaller doc_id.

    Pass one: each task adds a sample of its windows to a count-min sketch, and
    the tasks' sketches are merged by addition. A window is counted under the
    least hash of its 16-word grams, which equal windows share, so its count is
    never underestimated; and as neighbours mostly share that gram, the sketch
    gets a seventeenth of the windows. Pass two: windows that the sketch holds to
    occur twice or more, which are all that do, are grouped exactly, by 128 bits
    of the SHA-256 of their words. A fuller sketch lets more through
    and loses none. Hot windows are grouped by whole segments first
    (``_late_hot``), pre-aggregated to the smallest document and then joined,
    where skewed partitions are split; the others' groups are bounded, and one
    sort serves them.
    """
    spark = prepare(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    bits, rows = _frequent(plain, width, hot, bits)
    sketch = spark.sparkContext.broadcast(rows)
    named = plain.withColumn("text_id", _text_id())
    row = "h long, g long, doc_id long, text_id long, at int, n int"
    cold = mapped(named, lambda b: _candidates(b, width, bits, sketch), row)
    # the hot segments are read twice, the other windows once: these aren't stored
    warm = stored(mapped(named, lambda b: _segments(b, width, bits, sketch), row + ", runs array<struct<h:long,g:long,at:int,n:int>>"), "segments")
    early = cold.withColumn("low", F.min("doc_id").over(Window.partitionBy("h", "g"))).where("doc_id > low")
    return _late_hot(warm).union(early.select("doc_id", "text_id", "at", "n"))


def remove_repeats(docs: DataFrame, width: int = 50, texts: bool = False, hot: int = HOT, bits: int | None = None) -> DataFrame:
    r"""``(doc_id, n_words, n_removed, kept_sha256)``, and with ``texts`` the kept words themselves (``kept``).

    Words are runs of non-blank characters (``[^\x20\x09-\x0D]+``). A word goes if
    it lies in a window of ``width`` words whose sequence also starts in a
    document with a smaller doc_id, as the input has it. A null text has no
    words; a null doc_id takes no part and loses nothing. Rows that share a
    doc_id don't count as earlier for each other, and each is cut by its own
    text. No documents give no rows; other columns are left out.
    """
    at = repeated_windows(docs, width, hot, bits).groupBy("doc_id", "text_id").agg(F.collect_list(F.struct("at", "n")).alias("at"))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("text_id", _text_id())
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts
    whole = plain.join(at, ["doc_id", "text_id"], "left").select("doc_id", "text", "at")
    return mapped(whole, lambda b: _apply(b, width, texts), schema)


ORACLE_SQL = r"""
with d as (
  select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []::varchar[]) w from documents
), s as (
  select doc_id, w, unnest(range(1, len(w) - 48)) i from d
), x as (
  select doc_id, i, sha256(array_to_string(w[i : i + 49], ' ')) k from s
), f as (
  select k, min(doc_id) low from x group by k
), r as (
  select x.doc_id, list(i) hits from x join f using (k) where x.doc_id > f.low group by x.doc_id
), c as (
  select doc_id, list_distinct(flatten(list_transform(hits, lambda i: range(i, i + 50)))) gone from r
), o as (
  select d.doc_id, w, coalesce(len(gone), 0) n, case when gone is null then w else list_transform(list_sort(list_filter(range(1, len(w) + 1), lambda i: not list_contains(gone, i))), lambda i: w[i]) end kept from d left join c using (doc_id)
)
select doc_id, len(w)::bigint n_words, n::bigint n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) kept_sha256 from o
"""
