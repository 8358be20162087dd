"""SimHash near-duplicates through a byte-position inverted index with count filtering."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, cut, mapped, mix, slices, span_hashes, stored, tasks, utf8, window_hashes, words
from .components import connected_components

#: Bytes of a fingerprint, bits that linked fingerprints may differ in, and so the bytes that must agree.
N_BYTES, MAX_BITS = 8, 4
#: Positions that an index entry names: pairs that agree in four of eight bytes agree in three of the first seven.
ENTRY = 3
#: Rows of one posting list that are compared with each other; longer lists go by shared witnesses.
LONGEST = 4096
#: 64-bit words of the fingerprints that tell texts alike by 0.8 and more.
WIDE = 4

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def fingerprint(shingles: list[bytes]) -> int:
    """The 64-bit SimHash of XXH64 hashes with seed 42: a bit is set if it is in over half of them."""
    tally, step = np.zeros(64, np.int64), 1 << 15
    for at in range(0, len(shingles), step):
        h = np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles[at : at + step]], "<u8")
        tally += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * tally > len(shingles), bitorder="little").view("<u8")[0]) if shingles else 0


def _fingerprints(raw: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    """The fingerprint of each text."""
    starts, ends, first = words(raw, offsets)
    if not len(starts):
        return np.zeros(len(offsets) - 1, "<u8")
    size = ends - starts
    lower, inside = _LOWER[raw], np.zeros(len(raw) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    # the words joined by single spaces: a shingle is then one span of bytes
    to = np.cumsum(size + 1) - size - 1
    joined = np.full(int(size.sum()) + len(size), 32, np.uint8)
    joined[np.repeat(to - starts, size) + np.flatnonzero(np.cumsum(inside[:-1]))] = lower[np.cumsum(inside[:-1]) > 0]
    text = joined.tobytes()
    out = np.zeros(len(offsets) - 1, "<u8")
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if b > a:
            tally, n, step = np.zeros(64, np.int64), max(1, b - a - width + 1), 1 << 15
            for at in range(a, a + n, step):
                stop = min(at + step, a + n)
                lo, hi = to[at:stop].tolist(), (to + size)[np.minimum(np.arange(at, stop) + width, b) - 1].tolist()
                h = np.array([xxhash.xxh64_intdigest(text[x:y], 42) for x, y in zip(lo, hi, strict=True)], "<u8")
                tally += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out[i] = np.packbits(2 * tally > n, bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, width: int = 4, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(doc_id, fp)``: each text's SimHash over ``width``-word shingles of its ASCII-lower-cased words.

    Fewer words than ``width`` are one shingle; a null, empty or blank text has
    fingerprint 0. Bits are kept as a signed long.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                fp = _fingerprints(*utf8(column(part, "text")), width)
                yield pa.RecordBatch.from_arrays([column(part, "key"), pa.array(fp.view(np.int64))], names=["key", "fp"])

    plain = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return mapped(plain, run, "key long, fp long").withColumnRenamed("key", key)


def _entries(batches):
    """Index entries: the bytes at three positions, one entry for each choice of them."""
    chosen = list(combinations(range(N_BYTES - 1), ENTRY))
    for batch in batches:
        fp = batch.column(0).to_numpy().view(np.uint64)
        parts = fp.view(np.uint8).reshape(-1, 8).astype(np.int64)
        key = np.concatenate([(parts[:, a] << 16 | parts[:, b] << 8 | parts[:, c]) | k << 24 for k, (a, b, c) in enumerate(chosen)]) if len(fp) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.tile(fp.view(np.int64), len(chosen)))], names=["key", "fp"])


def matching_pairs(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices i < j of fingerprints that agree in at least four bytes (the tally) and differ in at most four bits (the check)."""
    left, right = [], []
    step = max(1, (1 << 20) // max(1, len(fp)))
    for at in range(0, len(fp), step):
        other = fp[at : at + step, None] ^ fp[None, :]
        agree = (other.view(np.uint8).reshape(*other.shape, 8) == 0).sum(axis=2) >= N_BYTES - MAX_BITS
        i, j = np.nonzero(agree)
        keep = (at + i < j) & (np.bitwise_count(other[i, j]) <= MAX_BITS)
        left.append(at + i[keep])
        right.append(j[keep])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2


def _spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    from .components import forest

    return forest(a, b) if len(a) else (a, b)


def _compare(batches, longest: int):
    """Rows sorted by key → links of each posting list as stars; a list over ``longest`` gives its members as (fp, null).

    Only one list, or one batch, is held at a time, whatever a key's share of the rows.
    """
    rest_k, rest_f, over = np.zeros(0, np.int64), np.zeros(0, np.int64), None

    def out(a, b):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), b], names=["a", "b"])

    def lists(key, fp):
        nonlocal over
        cut_at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(cut_at, len(key)))
        big = size > longest
        for at, n in zip(cut_at[big], size[big], strict=True):
            yield out(fp[at : at + n], pa.nulls(n, pa.int64()))
        pair = size == 2  # by far the most lists: all at once
        x, y = fp[cut_at[pair]], fp[cut_at[pair] + 1]
        other = (x ^ y).view(np.uint64)
        ok = ((other.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1) >= N_BYTES - MAX_BITS) & (np.bitwise_count(other) <= MAX_BITS)
        found = [(np.maximum(x[ok], y[ok]), np.minimum(x[ok], y[ok]))]
        for at, n in zip(cut_at[(size > 2) & ~big], size[(size > 2) & ~big], strict=True):
            own = fp[at : at + n]
            i, j = matching_pairs(own.view(np.uint64))
            if len(i):
                found.append(_spanning(own[i], own[j]))
        a, b = (np.concatenate(z) for z in zip(*found, strict=True))
        if len(a):
            yield out(a, pa.array(b, pa.int64()))

    for batch in batches:
        key, fp = (batch.column(k).to_numpy() for k in (0, 1))
        if over is not None:  # the rest of a list that has already proved too long
            n = int(np.searchsorted(key, over, side="right"))
            if n:
                yield out(fp[:n], pa.nulls(n, pa.int64()))
            key, fp = key[n:], fp[n:]
            if not len(key):
                continue
            over = None
        key, fp = np.concatenate([rest_k, key]), np.concatenate([rest_f, fp])
        if not len(key):
            continue
        last = int(np.searchsorted(key, key[-1], side="left"))
        yield from lists(key[:last], fp[:last])
        rest_k, rest_f = key[last:], fp[last:]
        if len(rest_k) > longest:
            yield out(rest_f, pa.nulls(len(rest_f), pa.int64()))
            over, rest_k, rest_f = rest_k[0], rest_k[:0], rest_f[:0]
    if len(rest_k):
        yield from lists(rest_k, rest_f)


def _witnesses(batches):
    """Every value within two bits of a fingerprint: two of these share one exactly if at most four bits part them."""
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    i, j = np.triu_indices(64, 1)
    masks = np.concatenate([np.zeros(1, np.uint64), one, one[i] | one[j]])
    for batch in batches:
        fp = batch.column(0).to_numpy().view(np.uint64)
        for at in range(0, len(fp), 256):
            near = (fp[at : at + 256, None] ^ masks[None, :]).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(near.view(np.int64)), pa.array(np.repeat(fp[at : at + 256], len(masks)).view(np.int64))], names=["z", "fp"])


def links(distinct: DataFrame, longest: int = LONGEST) -> DataFrame:
    """``distinct(fp)`` → ``(a, b)``: edges that connect just the fingerprints that at most four differing bits connect.

    Bytes at fixed positions are the tokens of an inverted index. Four differing
    bits touch at most four of the eight bytes, so a linked pair has at least
    four tokens in common, and therefore three among its first seven: an entry
    holds three of these seven (35 entries each), which finds every such pair
    and few others. In a posting list, shared bytes are tallied, pairs with fewer
    than four are dropped, the others are verified bit by bit, and a spanning
    star is kept of each cluster instead of all its pairs.

    A list of more than ``longest`` rows (near copies of one text) isn't compared
    pair by pair. Its members meet at witnesses instead: two values differ in at
    most four bits exactly if some value lies within two bits of both. That is
    2,081 rows a member, pre-aggregated to a minimum for each witness, and no
    pair is lost.
    """
    entries = mapped(distinct.select("fp"), _entries, "key long, fp long")
    sorted_ = entries.repartition(tasks(distinct.sparkSession), "key").sortWithinPartitions("key")
    found = cut(mapped(sorted_, lambda batches: _compare(batches, longest), "a long, b long"))
    near = mapped(found.where("b is null").select(F.col("a").alias("fp")).distinct(), _witnesses, "z long, fp long")
    # each witness's members hang on the smallest of them; a lone member hangs on itself
    least = near.groupBy("z").agg(F.min("fp").alias("m"), F.max("fp").alias("x")).where("m < x")
    met = near.join(least.select("z", "m"), "z").where("fp > m").select(F.col("fp").alias("a"), F.col("m").alias("b")).distinct()
    plain = found.where("b is not null")
    return plain if found.where("b is null").isEmpty() else plain.union(met)


def near_duplicates(docs: DataFrame, width: int = 4, longest: int = LONGEST) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every document.

    Documents are linked if their fingerprints differ in at most four bits;
    ``component_id`` is the smallest doc_id that links reach. Documents with one
    fingerprint form a class, which is indexed once: copies are never paired.
    Null, empty and blank texts have fingerprint zero and are linked like any
    other. Rows with a null doc_id keep a null component unless another row of
    theirs has an id. Repeated rows stay. No documents give no rows.
    """
    fps = cut(fingerprints(docs, width))
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    parts = connected_components(links(classes.select("fp"), longest))
    owner = stored(parts.join(classes, parts.v == classes.fp).groupBy("component").agg(F.min("least").alias("component_id")), "owners")
    named = parts.join(owner, "component").select(F.col("v").alias("fp"), "component_id")
    whole = cut(classes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")))
    return fps.join(whole, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def bits_for(similarity: float, n_words: int) -> int:
    """Bits of ``64 * n_words`` that differ, on average, in fingerprints of texts with so similar sets of shingles (Jaccard).

    Sets of one size with that share in common are at the angle whose cosine is
    ``2 s / (1 + s)``, and a bit differs with the angle's share of a half turn.
    """
    return math.floor(math.acos(2 * similarity / (1 + similarity)) / math.pi * 64 * n_words)


def candidate_bits(similarity: float, n_words: int) -> int:
    """``bits_for`` and two standard deviations: 98 % of pairs of that similarity differ in no more."""
    size, bits = 64 * n_words, bits_for(similarity, n_words)
    return math.floor(bits + 2 * math.sqrt(bits * (1 - bits / size)))


def _wide_prints(raw: np.ndarray, offsets: np.ndarray, width: int, n_words: int) -> np.ndarray:
    """Each text's fingerprint of ``n_words`` 64-bit words over its distinct ``width``-word shingles."""
    starts, ends, first = words(raw, offsets)
    h = span_hashes(_LOWER[raw], starts, ends, 11)
    shingles, out = window_hashes(h, width), np.zeros((len(first) - 1, n_words), np.uint64)
    salts = [np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)) for k in range(n_words)]
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if b > a:
            own = np.unique(shingles[a : b - width + 1] if b - a >= width else window_hashes(h[a:b], b - a))
            tally = np.zeros(64 * n_words, np.int64)
            for at in range(0, len(own), 4096):
                many = np.stack([mix(own[at : at + 4096] + salt) for salt in salts], axis=1)
                tally += np.unpackbits(many.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
            out[i] = np.packbits(2 * tally > len(own), bitorder="little").view("<u8")
    return out


def _columns(fp: np.ndarray) -> list[pa.Array]:
    return [pa.array(np.ascontiguousarray(fp[:, k]).view(np.int64)) for k in range(fp.shape[1])]


def _rows(batch: pa.RecordBatch, start: int) -> np.ndarray:
    return np.stack([batch.column(k).to_numpy().view(np.uint64) for k in range(start, batch.num_columns)], axis=1)


def _wide_entries(batches, start: int = 0):
    """Index entries: three of the eight bytes of each word, one entry for each choice of them. Words begin at column ``start``."""
    chosen = list(combinations(range(N_BYTES), ENTRY))
    for batch in batches:
        fp = _rows(batch, start)
        for k in range(fp.shape[1]):
            part = np.ascontiguousarray(fp[:, k]).view(np.uint8).reshape(-1, 8).astype(np.int64)
            for c, (x, y, z) in enumerate(chosen):
                key = np.int64(k * len(chosen) + c) << 24 | part[:, x] << 16 | part[:, y] << 8 | part[:, z]
                yield pa.RecordBatch.from_arrays([pa.array(key), *(batch.column(j) for j in range(batch.num_columns))], names=["key", *batch.schema.names])


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=-1)


def _closest(fp: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of the pairs (x, y) the closest one of each x."""
    apart = np.concatenate([_apart(fp[x[k : k + (1 << 19)]], fp[y[k : k + (1 << 19)]]) for k in range(0, len(x), 1 << 19)])
    order = np.lexsort((y, apart, x))
    x, y = x[order], y[order]
    first = np.concatenate([[True], x[1:] != x[:-1]])
    return np.stack((x[first], y[first]))


def _wide_lists(batches, bits: int, longest: int):
    """Rows sorted by key → candidates (a, b) of each posting list: of its pairs that are close bit by bit, a spanning
    forest, and each row with the closest before it and the closest after it.

    The rows of a list over ``longest`` are compared with its leaders, rows that
    were close to none before them, as they come; only leaders are kept. These rows
    are paired with themselves as well, which marks them for ``_across``.
    """
    names: list[str] = []

    def out(x, y):
        return pa.RecordBatch.from_arrays([*_columns(x), *_columns(y)], names=names)

    def pairs(fp):
        step, left, right = max(1, (1 << 19) // len(fp)), [], []
        for at in range(0, len(fp), step):
            i, j = np.nonzero(_apart(fp[at : at + step, None], fp[None]) <= bits)
            left.append(at + i[at + i < j])
            right.append(j[at + i < j])
        i, j = np.concatenate(left), np.concatenate(right)
        if not len(i):
            return i, j
        nearest = [np.unique(_spanning(i, j), axis=1), *(_closest(fp, x, y) for x, y in ((i, j), (j, i)))]
        return tuple(np.concatenate([np.stack((n.max(axis=0), n.min(axis=0))) for n in nearest], axis=1))

    def lists(key, fp):
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        size, found = np.diff(np.append(start, len(key))), []
        x, y = fp[start[size == 2]], fp[start[size == 2] + 1]  # by far the most lists: all at once
        near = _apart(x, y) <= bits
        found.append((x[near], y[near]))
        for at, n in zip(start[size > 2], size[size > 2], strict=True):
            own = fp[at : at + n]
            i, j = pairs(own) if n <= longest else led(own, [])
            found.append((own[i], own[j]))
            if n > longest:
                found.append((own, own))
        x, y = (np.concatenate(z) for z in zip(*found, strict=True))
        if len(x):
            yield out(x, y)

    def led(fp, leaders):
        """Links of rows to leaders, as indices; a new leader is added to ``leaders``."""
        everyone, ties = np.concatenate([*leaders, fp]) if leaders else fp, []
        n = len(everyone) - len(fp)
        free = np.ones(len(fp), bool)
        for k in range(n):
            at = np.flatnonzero(_apart(everyone[k], fp) <= bits)
            free[at] = False
            ties.append((at + n, np.full(len(at), k)))
        for i in range(len(fp)):
            if free[i]:
                leaders.append(fp[i : i + 1])
                at = i + 1 + np.flatnonzero(_apart(fp[i], fp[i + 1 :]) <= bits)
                free[at] = False
                ties.append((at + n, np.full(len(at), n + i)))
        return tuple(np.concatenate(z) for z in zip(*ties, strict=True)) if ties else (np.zeros(0, np.int64),) * 2

    rest_k, rest_f, over, leaders = np.zeros(0, np.int64), None, None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        key, fp = batch.column(0).to_numpy(), _rows(batch, 1)
        names = names or [f"{side}{k}" for side in "ab" for k in range(fp.shape[1])]
        if over is not None:  # more of a list that has already proved too long
            n = int(np.searchsorted(key, over, side="right"))
            known = np.concatenate(leaders)
            i, j = led(fp[:n], leaders)
            if len(i):
                everyone = np.concatenate([known, fp[:n]])
                yield out(everyone[i], everyone[j])
            if n:
                yield out(fp[:n], fp[:n])
            key, fp = key[n:], fp[n:]
            if not len(key):
                continue
            over, leaders = None, []
        key, fp = np.concatenate([rest_k, key]), fp if rest_f is None else np.concatenate([rest_f, fp])
        last = int(np.searchsorted(key, key[-1], side="left"))
        yield from lists(key[:last], fp[:last])
        rest_k, rest_f = key[last:], fp[last:]
        if len(rest_k) > longest:
            i, j = led(rest_f, leaders)
            if len(i):
                yield out(rest_f[i], rest_f[j])
            yield out(rest_f, rest_f)
            over, rest_k, rest_f = rest_k[0], rest_k[:0], rest_f[:0]
    if len(rest_k):
        yield from lists(rest_k, rest_f)


def _across(batches, bits: int):
    """Rows (key, component, v, fingerprint) sorted by key and component → all pairs (a, b) of different components that a
    posting list has and that are close bit by bit. One list is held at a time.
    """

    def lists(rows):
        start = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]])) if len(rows) else np.zeros(0, np.int64)
        for own in np.split(rows, start[1:]):
            v, fp = own[:, 2], own[:, 3:].view(np.uint64)
            begin = np.flatnonzero(np.concatenate([[True], own[1:, 1] != own[:-1, 1]]))
            for a, b in zip(begin[:-1], begin[1:], strict=True):  # a component and the rows of those after it
                step = max(1, (1 << 19) // (len(own) - b))
                for at in range(a, b, step):
                    i, j = np.nonzero(_apart(fp[at : min(at + step, b), None], fp[None, b:]) <= bits)
                    if len(i):
                        x, y = v[at + i], v[b + j]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = _rows(batch, 0).view(np.int64)
        rows = rows if rest is None else np.concatenate([rest, rows])
        last = int(np.searchsorted(rows[:, 0], rows[-1, 0], side="left"))
        yield from lists(rows[:last]) if last else ()
        rest = rows[last:]
    if rest is not None:
        yield from lists(rest)


def _shingle_sets(batches, width: int):
    """Each text's distinct shingles, as sorted 64-bit hashes."""
    for batch in batches:
        for part in slices(batch, "text"):
            raw, offsets = utf8(column(part, "text"))
            starts, ends, first = words(raw, offsets)
            h = span_hashes(_LOWER[raw], starts, ends, 11)
            shingles, sets = window_hashes(h, width), []
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                sets.append(np.unique(shingles[a : b - width + 1] if b - a >= width else window_hashes(h[a:b], max(1, b - a))).view(np.int64))
            at = np.cumsum([0, *(len(x) for x in sets)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(sets)))
            yield pa.RecordBatch.from_arrays([column(part, "doc_id"), lists], names=["v", "shingles"])


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose ``sets(v, shingles)`` have a Jaccard similarity of at least ``similarity``."""
    side = lambda v: sets.select(F.col("v").alias(v), F.col("shingles").alias(f"s{v}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(F.try_divide(shared, F.size("sa") + F.size("sb") - shared) >= similarity).select("a", "b")


def _apart_in(pairs: DataFrame, group: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends are in different groups, ``ca`` and ``cb``, of ``group(v, component)``."""
    of = lambda side: group.select(F.col("v").alias(side), F.col("component").alias(f"c{side}"))
    both = pairs.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")).where("ca <> cb")


def similar(docs: DataFrame, width: int = 5, similarity: float = 0.8, n_words: int = WIDE, longest: int = LONGEST) -> DataFrame:
    """``(doc_id, component_id)``: groups that texts form whose five-word shingles are alike by 0.8 and more (Jaccard).

    Such texts differ in too many bits of 64 for a guarantee by bytes, so the
    fingerprints are wider. The index is the same: an entry is three of the eight
    bytes of a word, lists tally pairs by it, and pairs that differ in at most
    ``candidate_bits`` are candidates. These are verified on the shingles
    themselves: first each text with its closest candidate, then the candidates
    that this leaves in different groups, so that a large group of near copies
    isn't compared text by text. Lists name only some of their close pairs; so the
    members of groups that are still apart though candidates join them, and of
    lists over ``longest``, go through the index again, which names all close pairs
    of different groups. The groups are then those of all close pairs, whatever
    the lists' lengths. A pair is no candidate if no word has three bytes in
    common, which the README gives figures for.

    Texts with one fingerprint form a class, which is indexed once; texts without
    words are one class. A null text has no words, a null doc_id takes no part, and
    rows that share a doc_id are one document. No documents give no rows.
    """
    fields = [f"f{k}" for k in range(n_words)]
    shape = ", ".join(f"{f} long" for f in fields)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), column(part, "text_id"), *_columns(_wide_prints(*utf8(column(part, "text")), width, n_words))], names=["doc_id", "text_id", *fields])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("doc_id is not null")
    plain = plain.withColumn("text_id", F.xxhash64("text"))
    prints = cut(mapped(plain, run, f"doc_id long, text_id long, {shape}"))
    # rows that share a doc_id can be of several classes: a class is named by its smallest id and text
    classes = prints.groupBy(*fields).agg(F.min(F.struct("doc_id", "text_id")).alias("least"))
    classes = stored(classes.select(*fields, "least.*", F.xxhash64("least").alias("v")), "classes")
    entries = mapped(classes.select(*fields), _wide_entries, f"key long, {shape}")
    bits = candidate_bits(similarity, n_words)
    ordered = entries.repartition(tasks(docs.sparkSession), "key").sortWithinPartitions("key", *fields)
    close = mapped(ordered, lambda b: _wide_lists(b, bits, longest), ", ".join(f"{side}{k} long" for side in "ab" for k in range(n_words))).distinct()
    apart = sum((F.bit_count(F.col(f"a{k}").bitwiseXOR(F.col(f"b{k}"))) for k in range(n_words)), F.lit(0))
    name = lambda side: classes.select(*(F.col(f).alias(f"{side}{k}") for k, f in enumerate(fields)), F.col("v").alias(side))
    pairs = close.withColumn("apart", apart).join(name("a"), [f"a{k}" for k in range(n_words)]).join(name("b"), [f"b{k}" for k in range(n_words)])
    pairs = stored(pairs.select("a", "b", "apart", F.row_number().over(Window.partitionBy("a").orderBy(F.col("a") == F.col("b"), "apart", "b")).alias("place")), "pairs")

    needed = stored(classes.join(pairs.select(F.explode(F.array("a", "b")).alias("v")).distinct(), "v").select("doc_id", "text_id", "v"), "needed")
    texts = plain.join(needed, ["doc_id", "text_id"]).select(F.col("v").alias("doc_id"), "text")
    sets = stored(mapped(texts, lambda b: _shingle_sets(b, width), "v long, shingles array<long>").dropDuplicates(["v"]), "shingles")
    long, pairs = pairs.where("a = b").select(F.col("a").alias("v")), pairs.where("a <> b")
    good = stored(verified(pairs.where("place = 1"), sets, similarity), "good")
    rest = _apart_in(pairs.where("place > 1"), connected_components(good))
    good = good.union(stored(verified(rest, sets, similarity), "more"))
    parts = connected_components(good)

    # a pair that no list named lies between groups that named pairs join, of which an end has more than one
    ends = lambda df, *cs: df.select(F.explode(F.array(*cs)).alias("v"))
    known = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    of = lambda side: known.groupBy(F.col(side).alias("v")).agg(F.count("*").alias("n"))
    several = stored(of("a").union(of("b")).groupBy("v").agg(F.sum("n").alias("n")).where("n > 1").select("v"), "several")
    failed = stored(_apart_in(pairs, parts), "apart")
    failed = failed.join(several.withColumnRenamed("v", "a"), "a", "left_semi").union(failed.join(several.withColumnRenamed("v", "b"), "b", "left_semi").select(failed.columns))
    group = classes.join(parts, "v", "left").select(F.coalesce("component", "v").alias("c"), "v", *fields)
    again = group.join(ends(failed, "ca", "cb").select(F.col("v").alias("c")).distinct(), "c", "left_semi").union(group.join(long, "v", "left_semi").select(group.columns))
    again = stored(again.distinct(), "again")
    if not again.isEmpty():
        entries = mapped(again, lambda b: _wide_entries(b, 2), f"key long, c long, v long, {shape}")
        mixed = entries.groupBy("key").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x < y").select("key")
        ordered = entries.join(mixed, "key", "left_semi").repartition(tasks(docs.sparkSession), "key").sortWithinPartitions("key", "c")
        across = mapped(ordered, lambda b: _across(b, bits), "a long, b long").distinct().join(known, ["a", "b"], "left_anti")
        across = stored(verified(across, sets, similarity), "across")
        parts = parts if across.isEmpty() else connected_components(good.union(across))

    named = classes.join(parts, "v", "left").withColumn("component", F.coalesce("component", "v"))
    least = stored(named.groupBy("component").agg(F.min("doc_id").alias("component_id")), "least")
    whole = stored(named.join(least, "component").select(*fields, "component_id"), "groups")
    return prints.join(whole, fields).groupBy("doc_id").agg(F.min("component_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """Keep the document with the smallest id of each group of ``similar``, with all its columns. A null id is kept."""
    gone = similar(docs, **options).where("doc_id <> component_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
