"""Hierarchical residual packing of token pieces into sequences of bounded length."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, cut, mapped, prepare, slices
from .wordbpe import SLICE_BYTES, load, with_end

#: A sequence with at most one in so many places free is emitted; an emptier one is packed again with others.
NEARLY = 64
#: Partitions, and then groups, that merge at each level of the tree.
FAN_IN = 8
#: Pieces that a task packs at a time.
HELD = 1_000_000


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit, longest first: each item's bin and place there, and each bin's fill.

    Open bins stand in stacks by free room, and a bit of one integer for each
    room that some bin has: the tightest bin that an item fits is found at once.
    """
    bins, at, free = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_ = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        if fits := open_ >> n:
            room = n + (fits & -fits).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                open_ ^= 1 << room
        else:
            b, room = len(free), capacity
            free.append(capacity)
        bins[i], at[i], free[b] = b, capacity - room, room - n
        if room > n:
            stacks[room - n].append(b)
            open_ |= 1 << (room - n)
    return bins, at, capacity - np.array(free, np.int64)


def _pack(doc_id, piece, start, size, crc, capacity, base):
    bins, at, fill = best_fit(size, capacity)
    cols = [pa.array(doc_id, pa.int64()), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(size), pa.array(crc), pa.array(base + bins), pa.array(at), pa.array(fill[bins])]
    table = pa.table(cols, names=["doc_id", "piece", "start", "length", "ids_crc32", "bin", "at", "fill"])
    yield from table.to_batches(max_chunksize=1 << 16)


def _pieces(batches, tokenizer: str, end: int, capacity: int):
    """Tokenize and cut a partition's texts, and pack the pieces with each other."""
    bpe, held, n, base = load(tokenizer), [], 0, TaskContext.get().partitionId() << 40

    def flush():
        nonlocal base
        doc_id = [x for h in held for x in h[0]]
        cols = [np.concatenate([h[k] for h in held]) for k in range(1, 5)]
        yield from _pack(doc_id, *cols, capacity, base)
        base += len(doc_id)

    for batch in batches:
        for part in slices(batch, "text", SLICE_BYTES):
            ids, first = with_end(*bpe.ids(column(part, "text")), end)
            count = -(-(first[1:] - first[:-1]) // capacity)
            of = np.repeat(np.arange(len(count)), count)
            piece = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * capacity
            size = np.minimum(first[of + 1] - first[of] - start, capacity)
            raw, at = ids.astype("<u4").tobytes(), first[of] + start
            crc = np.fromiter((zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + size).tolist(), strict=True)), np.int64, len(of))
            key = column(part, "doc_id").to_pylist()
            held.append(([key[i] for i in of.tolist()], piece, start, size, crc))
            n += len(of)
            if n >= HELD:
                yield from flush()
                held, n = [], 0
    if n:
        yield from flush()


def _merge(table: pa.Table, capacity: int, spare: int) -> pa.Table:
    """Pack a group's sequences as items; each base sequence gets its new one and its place there.

    Two sequences can only be joined if one of them is at most half full, and best
    fit leaves a group one such at most. So a group above, which merges ``FAN_IN``
    of these, fills up at most so many others; of sequences over half full and
    equally full, which are interchangeable, ``spare`` (``FAN_IN`` for each level
    above) are all that can still be called for, and the others are done.
    """
    base, now, at, fill = (table.column(k).to_numpy() for k in ("base", "now", "at", "fill"))
    ids, of = np.unique(now, return_inverse=True)
    # dealt by a fixed order of fills and ids: a task that runs again packs alike
    bins, place, full = best_fit(np.bincount(of, weights=fill).astype(np.int64), capacity)
    name = np.full(len(full), np.iinfo(np.int64).max)
    np.minimum.at(name, bins, ids)
    done = capacity - full <= capacity // NEARLY
    order = np.argsort(full, kind="stable")
    again = np.arange(len(full)) - np.searchsorted(full[order], full[order])  # how many came before with the same fill
    done[order[(again >= spare) & (2 * full[order] > capacity)]] = True
    cols = [pa.array(base), pa.array(name[bins[of]]), pa.array(at + place[of]), pa.array(fill), pa.array(table.column("part").to_numpy()), pa.array(done[bins[of]])]
    return pa.table(cols, names=["base", "now", "at", "fill", "part", "done"])


def levels_above(groups: int) -> int:
    """Levels of the tree over one with so many groups."""
    n = 0
    while groups > 1:
        groups, n = -(-groups // FAN_IN), n + 1
    return n


def pack(docs: DataFrame, tokenizer: str, end: int = 0, capacity: int = 2048) -> DataFrame:
    """Pack all texts: ``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``, a row for each piece.

    A document is its text's ids (null and empty: none) and the id ``end``; only
    one longer than ``capacity`` is cut, into whole sequences and a rest. Each
    partition packs its pieces best-fit, emits sequences that are nearly full,
    and hands the underfull ones up a tree, where groups of ``FAN_IN`` pack
    them as items, round after round. A group hands up a bounded number of each
    fill, all that groups above can use (``_merge``), so nothing is lost by it; and
    what travels is a few numbers a sequence, never tokens. A sequence but one of
    each flush is over half full, so a partition's bytes bound how many it has.
    Repeated rows, null ids
    and ties are packed like any others; other columns are left out; no documents
    give no rows.
    """
    prepare(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, at long, fill long"
    pieces = cut(mapped(plain, lambda b: _pieces(b, tokenizer, end, capacity), schema, keeps=True))
    loose = pieces.where((F.col("at") == 0) & (F.lit(capacity) - F.col("fill") > capacity // NEARLY))
    level = loose.select(F.col("bin").alias("base"), F.col("bin").alias("now"), F.lit(0).cast("long").alias("at"), "fill", F.shiftright("bin", 40).alias("part"))
    width, moved = loose.agg(F.max(F.shiftright("bin", 40))).first()[0], []
    groups = 1 if width is None else width + 1
    while width is not None:
        groups = -(-groups // FAN_IN)
        spare = FAN_IN * levels_above(groups)
        level = level.withColumn("part", F.floor(F.col("part") / FAN_IN))
        merged = cut(level.groupBy("part").applyInArrow(lambda t: _merge(t, capacity, spare), "base long, now long, at long, fill long, part long, done boolean"))
        if groups == 1:
            moved.append(merged)
            break
        moved.append(merged.where("done"))
        level = merged.where("not done").drop("done")
    out = pieces.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))
    if not moved:
        return out
    map_ = moved[0]
    for m in moved[1:]:
        map_ = map_.union(m)
    map_ = map_.select(F.col("base").alias("sequence_id"), "now", F.col("at").alias("more"))
    joined = out.join(map_, "sequence_id", "left")
    return joined.select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("now", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("more", F.lit(0))).alias("offset"))
