"""Plumbing the operators share: shared storage, Arrow slices, word positions and hashes."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: Text that one numpy pass holds at a time; a longer text is a pass of its own.
SLICE_BYTES = 1 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Make this package importable in Python workers, wherever the driver was started."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), ROOT]))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only a local-mode session that names none gets a temporary one.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="quillgraph-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage, in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table to the shared folder and read back.

    An aggregate that is stored before it is joined leaves a plain shuffle on both
    sides of the join, whose large partitions Spark then splits; a small one is
    broadcast by its true size.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks(spark: SparkSession) -> int:
    """Partitions for shuffles whose number must be named."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _release() -> None:
    """Give freed memory back to the system: workers outlive their tasks, beside the next stage's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


#: What a worker keeps from task to task, as loading takes long: tokenizers, by their file.
KEPT: dict[str, object] = {}


def _forget() -> None:
    """Drop what an earlier stage has kept in this worker."""
    if KEPT:
        KEPT.clear()
        gc.collect()
        _release()


def mapped(df: DataFrame, run, schema, keeps: bool = False) -> DataFrame:
    """``df.mapInArrow`` that leaves no memory behind in the worker; tasks that don't use what is ``KEPT`` drop it."""

    def lean(batches):
        if not keeps:
            _forget()
        yield from run(batches)
        _release()

    return df.mapInArrow(lean, schema)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds at most ``limit`` bytes of ``column``, or one row."""
    size = pc.binary_length(batch.column(batch.schema.get_field_index(column))).fill_null(0).to_numpy(zero_copy_only=False)
    total, at = np.cumsum(size.astype(np.int64)), 0
    while at < len(size):
        before = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, before + limit, side="right")))
        yield batch.slice(at, end - at)
        at = end


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, null as empty, and each text's offset there (one more than texts)."""
    col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    _, offsets, data = col.buffers()
    if not len(col) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


_IN_WORD = np.ones(256, bool)
_IN_WORD[[0x20, *range(0x09, 0x0E)]] = False


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r"""Words ``[^\x20\x09-\x0D]+``: their starts, their ends, and each text's first word (one more than texts)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = _IN_WORD[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[edge] = inside[edge]
    edge = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[edge] = inside[edge]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


_TAIL = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, one to one."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each span of bytes, eight bytes at a time."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    size = ends - starts
    giant = np.flatnonzero(size > 4096)  # one by one, instead of a numpy pass for every eight bytes of the longest
    if len(giant):
        rest = np.flatnonzero(size <= 4096)
        h = np.empty(len(size), np.uint64)
        h[rest] = span_hashes(raw, starts[rest], ends[rest], seed)
        h[giant] = [xxhash.xxh3_64_intdigest(raw[a:b], seed) for a, b in zip(starts[giant], ends[giant], strict=True)]
        return h
    h = mix(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    live, k = None, 0
    while True:
        if live is None:
            left, at = size, starts
        else:
            left, at = size[live] - 8 * k, starts[live] + 8 * k
        lane = lanes[at] & _TAIL[np.minimum(left, 8)]
        if live is None:
            h = mix((h ^ lane) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed | 1))
            live = np.flatnonzero(size > 8)
        else:
            h[live] = mix((h[live] ^ lane) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed | 1))
            live = live[left > 8]
        k += 1
        if not len(live):
            return h


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        n = max(n, 1 << 16)
        up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = np.cumprod(up), np.cumprod(down)
        if n <= 1 << 23:  # kept for the next call; a giant text's tables are not
            _POWERS[base] = have
    return have


def window_hashes(h: np.ndarray, width: int, base: int = 0x9DDFEA08EB382D69) -> np.ndarray:
    """A 64-bit hash of each ``width`` consecutive hashes: a polynomial in an odd base, modulo 2**64."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _powers(base, len(h))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)])])
    return mix((total[width:] - total[:-width]) * down[:n])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each run, one run after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - before, lengths)


def joined(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Spans joined by single spaces, and where each begins there (one more than spans)."""
    size = ends - starts
    to = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(int(to[-1]), 32, np.uint8)
    out[ragged(to[:-1], size)] = raw[ragged(starts, size)]
    return out.tobytes(), to


def per_text(counts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``counts`` (one per word) over each text's words."""
    total = np.concatenate([[0], np.cumsum(counts)])
    return total[first[1:]] - total[first[:-1]]
