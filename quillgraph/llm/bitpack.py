"""Token ids in binary files: each id in as few bits as the vocabulary needs, with block offsets."""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, mapped, new_folder, prepare, slices, tasks
from .wordbpe import SLICE_BYTES, load, with_end

MAGIC = b"QGIDS01\n"
#: Ids of a block; a multiple of eight, so that every block begins at a whole byte.
BLOCK = 65_536
_TAIL = struct.Struct("<QQQQII8s")


def bits_for(n_ids: int) -> int:
    """The fewest bits that hold every id of a vocabulary of ``n_ids``."""
    return max(1, int(n_ids - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids side by side, ``bits`` each, lowest bit first; the last byte is filled with zeros."""
    ids = np.ascontiguousarray(ids, "<u4")
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    return np.packbits(np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits], bitorder="little").tobytes()


def unpack_bits(raw: bytes, n: int, bits: int) -> np.ndarray:
    """The first ``n`` ids of ``pack_bits``."""
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :bits] = flat
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


class Writer:
    """Streams documents to one file: packed blocks, then an index of documents and blocks, then its size.

    Layout: magic; blocks of ``BLOCK`` ids, the last one shorter; document keys
    (int64), whether each is there (uint8), where each begins (uint64, one more
    than documents); block offsets in bytes (uint64, one more than blocks); a
    fixed tail of counts, bits and block size.
    """

    def __init__(self, out, n_ids: int):
        self.out, self.bits = out, bits_for(n_ids)
        self.keys, self.there, self.sizes, self.blocks = [], [], [], [len(MAGIC)]
        self.rest, self.n = np.zeros(0, np.uint32), 0
        out.write(MAGIC)

    def add(self, keys: list, ids: np.ndarray, first: np.ndarray) -> None:
        self.keys.append(np.array([k or 0 for k in keys], "<i8"))
        self.there.append(np.array([k is not None for k in keys], np.uint8))
        self.sizes.append(np.diff(first))
        ids = np.concatenate([self.rest, ids])
        whole = len(ids) // BLOCK * BLOCK
        for at in range(0, whole, BLOCK):
            self._block(ids[at : at + BLOCK])
        self.rest = ids[whole:]

    def _block(self, ids: np.ndarray) -> None:
        raw = pack_bits(ids, self.bits)
        self.out.write(raw)
        self.blocks.append(self.blocks[-1] + len(raw))
        self.n += len(ids)

    def close(self) -> tuple[int, int]:
        if len(self.rest):
            self._block(self.rest)
        sizes = np.concatenate(self.sizes) if self.sizes else np.zeros(0, np.int64)
        for part in (np.concatenate(self.keys or [np.zeros(0, "<i8")]), np.concatenate(self.there or [np.zeros(0, np.uint8)]), np.concatenate([[0], np.cumsum(sizes)]).astype("<u8"), np.array(self.blocks, "<u8")):
            self.out.write(part.tobytes())
        self.out.write(_TAIL.pack(len(sizes), self.n, len(self.blocks) - 1, self.blocks[-1], self.bits, BLOCK, MAGIC))
        self.out.close()
        return len(sizes), self.n


class Reader:
    """Random access to a file of ``Writer``; only the index is kept."""

    def __init__(self, file):
        self.file = file
        n_docs, self.n, n_blocks, index, self.bits, self.block, magic = _TAIL.unpack(file.read_at(_TAIL.size, file.size() - _TAIL.size))
        if magic != MAGIC:
            raise ValueError("not a file of token ids")
        raw = file.read_at(17 * n_docs + 8 + 8 * (n_blocks + 1), index)
        self.keys = np.frombuffer(raw, "<i8", n_docs)
        self.there = np.frombuffer(raw, np.uint8, n_docs, 8 * n_docs)
        self.first = np.frombuffer(raw, "<u8", n_docs + 1, 9 * n_docs).astype(np.int64)
        self.offsets = np.frombuffer(raw, "<u8", n_blocks + 1, 17 * n_docs + 8).astype(np.int64)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids from ``start`` to ``stop``, by reading just their blocks."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        a, b = start // self.block, -(-stop // self.block)
        raw = self.file.read_at(int(self.offsets[b] - self.offsets[a]), int(self.offsets[a]))
        got = unpack_bits(raw, min(b * self.block, self.n) - a * self.block, self.bits)
        return got[start - a * self.block : stop - a * self.block]


def _open(path: str):
    files, inner = fs.FileSystem.from_uri(path)
    return files, inner


def _write(batches, tokenizer: str, end: int, folder: str):
    """One file for a sorted partition. Each attempt has a file of its own, named in the row that it returns."""
    bpe, task, out, path = load(tokenizer), TaskContext.get(), None, ""
    for batch in batches:
        for part in slices(batch, "text", SLICE_BYTES):
            if not part.num_rows:
                continue
            if out is None:
                path = f"{folder}/part-{task.partitionId():05d}-{uuid.uuid4().hex}.ids"
                files, inner = _open(path)
                files.create_dir(inner.rpartition("/")[0], recursive=True)
                out = Writer(files.open_output_stream(inner), bpe.n_ids)
            keys = column(part, "doc_id").to_pylist()
            out.add(keys, *with_end(*bpe.ids(column(part, "text")), end))
    if out is not None:
        n_docs, n_ids = out.close()
        yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int32()), pa.array([path]), pa.array([n_docs], pa.int64()), pa.array([n_ids], pa.int64())], names=["part", "path", "n_docs", "n_ids"])


def write_ids(docs: DataFrame, tokenizer: str, end: int = 1, folder: str | None = None) -> list[tuple[str, int, int]]:
    """Write all texts' ids in ascending doc_id order; the files in that order as ``(path, n_docs, ids before it)``.

    Documents are dealt by ranges of doc_id and sorted, a file for each
    partition: the only thing that reaches the driver is a row for each file.
    Null texts are empty; null ids come first; rows with one id follow each other
    in any order. No documents give no files.
    """
    spark = prepare(docs.sparkSession)
    folder = folder or new_folder(spark, "ids")
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(tasks(spark), "doc_id").sortWithinPartitions("doc_id")
    rows = sorted(mapped(dealt, lambda b: _write(b, tokenizer, end, folder), "part int, path string, n_docs long, n_ids long", keeps=True).collect())
    before, out = 0, []
    for _, path, n_docs, n_ids in rows:
        out.append((path, n_docs, before))
        before += n_ids
    return out


def _read(batches):
    for batch in batches:
        for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            files, inner = _open(path)
            with files.open_input_file(inner) as f:
                r = Reader(f)
                at = 0
                while at < len(r.keys):
                    end = max(at + 1, int(np.searchsorted(r.first, r.first[at] + (1 << 22), side="right")) - 1)
                    first = r.first[at : end + 1]
                    raw, cut_at = r.ids(int(first[0]), int(first[-1])).astype("<u4").tobytes(), (first - first[0]).tolist()
                    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(cut_at[:-1], cut_at[1:], strict=True)]
                    keys = pa.array(r.keys[at:end], mask=r.there[at:end] == 0)
                    yield pa.RecordBatch.from_arrays([keys, pa.array(before + first[:-1]), pa.array(np.diff(first)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                    at = end


def read_ids(spark: SparkSession, files: list[tuple[str, int, int]]) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of each document, from the files of ``write_ids``."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    rows = [(path, before) for path, _, before in files]
    listed = prepare(spark).createDataFrame(rows, "path string, before long")
    return (listed.repartition(min(len(rows), tasks(spark))) if len(rows) > 1 else listed).mapInArrow(_read, schema)
