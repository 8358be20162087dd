"""Byte-level BPE as a monoid: encodings of halves are joined by encoding growing windows at the seam anew."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, mapped, prepare, slices

#: Characters, and bytes of one piece, that the library encodes in one go; longer ones are halved.
LEAF_CHARS, LEAF_BYTES = 256, 256
#: Tokens on each side of a seam within a piece that are encoded anew at first; then twice as many, and so on.
WINDOW = 2


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class TreeBpe:
    """Encodes and decodes by tree reduction; equal to the library's ``encode_ordinary`` on any text.

    Two levels of tree. A text is halved down to ``LEAF_CHARS``. At a seam, the
    pieces that a split may have disturbed lie between the last cut before it and
    the first cut after it, where a cut is a place between a non-blank and a
    space or newline: no match of the pattern runs over it, and none depends on
    what is beyond. The window grows until it finds these cuts; tokens outside
    it are kept. A single match longer than ``LEAF_BYTES`` is halved as bytes. At
    its seam a window of tokens grows until both of its edges are stable: the
    tokens left and right of an edge, encoded together, give these two again.
    Encodings are decided by their adjacent pairs, so nothing outside can change.
    """

    def __init__(self, path: str, pattern: str, leaf_chars: int = LEAF_CHARS, leaf_bytes: int = LEAF_BYTES):
        import tiktoken

        ranks = read_ranks(path)
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pieces = regex.compile(pattern)
        size = max(ranks.values()) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.size = [len(b) for b in self.bytes]
        self.text = [str(i) for i in range(size)]
        self.leaf_chars, self.leaf_bytes = leaf_chars, leaf_bytes
        self.long_run = regex.compile(rf"\S{{{max(2, leaf_bytes // 4)},}}")
        self.stable_pairs: dict[tuple[int, int], bool] = {}

    def _stable(self, a: int, b: int) -> bool:
        have = self.stable_pairs.get((a, b))
        if have is None:
            if len(self.stable_pairs) > 1_000_000:
                self.stable_pairs.clear()
            have = self.stable_pairs[a, b] = self.library._encode_single_piece(self.bytes[a] + self.bytes[b]) == [a, b]
        return have

    def piece(self, raw: bytes) -> list[int]:
        """One match's tokens."""
        if len(raw) <= self.leaf_bytes:
            return self.library._encode_single_piece(raw)
        half = len(raw) // 2
        return self.join_piece(self.piece(raw[:half]), self.piece(raw[half:]))

    def join_piece(self, left: list[int], right: list[int]) -> list[int]:
        """The tokens of two parts' bytes together, from the tokens of each."""
        if not left or not right or self._stable(left[-1], right[0]):
            return left + right
        n = WINDOW
        while True:
            a, b = max(0, len(left) - n), min(len(right), n)
            raw = b"".join(self.bytes[t] for t in left[a:]) + b"".join(self.bytes[t] for t in right[:b])
            mid = self.library._encode_single_piece(raw)
            if (a == 0 or self._stable(left[a - 1], mid[0])) and (b == len(right) or self._stable(mid[-1], right[b])):
                return left[:a] + mid + right[b:]
            n *= 2

    def window(self, text: str) -> list[int]:
        """A stretch of text as if it stood alone."""
        if len(text) <= 2 * self.leaf_chars and not self.long_run.search(text) and len(text.encode()) - len(text) <= 2 * self.leaf_chars:
            return self.library.encode_ordinary(text)
        return [t for m in self.pieces.finditer(text) for t in self.piece(m.group().encode())]

    @staticmethod
    def _cuts(text: str, low: int, seam: int, high: int) -> tuple[int, int]:
        """The last cut in (low, seam), or low; and the first in [seam, high), or high."""

        def cut(i: int) -> bool:
            return text[i] in " \n" and not text[i - 1].isspace()

        a = seam - 1
        while a > low and not cut(a):
            a -= 1
        b = seam
        while b < high and not cut(b):
            b += 1
        return max(a, low), b

    def encode_part(self, text: str, low: int, high: int) -> list[int]:
        if high - low <= self.leaf_chars:
            return self.window(text[low:high])
        seam = (low + high) // 2
        return self.join(text, low, seam, high, self.encode_part(text, low, seam), self.encode_part(text, seam, high))

    def join(self, text: str, low: int, seam: int, high: int, left: list[int], right: list[int]) -> list[int]:
        """The tokens of text[low:high] from those of its two parts."""
        a, b = self._cuts(text, low, seam, high)
        drop, keep = len(text[a:seam].encode()), len(left)
        while drop > 0:
            keep -= 1
            drop -= self.size[left[keep]]
        skip, first = len(text[seam:b].encode()), 0
        while skip > 0:
            skip -= self.size[right[first]]
            first += 1
        return left[:keep] + self.window(text[a:b]) + right[first:]

    def encode(self, text: str) -> list[int]:
        return self.encode_part(text, 0, len(text))

    def decode(self, ids: list[int]) -> bytes:
        """Bytes, concatenated up the tree."""
        if len(ids) <= 4 * self.leaf_chars:
            return self.library.decode_bytes(ids)
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


_LOADED: dict[tuple[str, str], TreeBpe] = {}


def load(path: str, pattern: str) -> TreeBpe:
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = TreeBpe(path, pattern)
    return _LOADED[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, ids: bool = False) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of each text, and with ``ids`` the ids themselves.

    Texts are encoded, and the ids decoded, by ``TreeBpe``. Null and empty texts
    have no ids. Texts of any length are taken whole; repeated rows stay; other
    columns are left out; no documents give no rows.
    """
    prepare(docs.sparkSession)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * ids

    def run(batches):
        bpe = load(path, pattern)
        for batch in batches:
            for part in slices(batch):
                n, code, back, all_ = [], [], [], []
                for text in column(part, "text").fill_null("").to_pylist():
                    got = bpe.encode(text)
                    n.append(len(got))
                    code.append(hashlib.sha256(" ".join(map(bpe.text.__getitem__, got)).encode()).hexdigest())
                    back.append(hashlib.sha256(bpe.decode(got)).hexdigest())
                    if ids:
                        all_.append(np.array(got, np.int32))
                cols = [column(part, "doc_id"), pa.array(n, pa.int64()), pa.array(code, pa.string()), pa.array(back, pa.string())]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(all_, pa.list_(pa.int32()))] * ids, names=names)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return mapped(plain, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids)
