"""Ids of many texts by a word-level BPE file, each distinct piece of a slice encoded once."""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import KEPT, per_text, ragged, utf8, words

#: Words and pieces whose ids a worker remembers, and as many of a generation before, of which those still in use move on.
REMEMBERED = 250_000
#: Text whose words are told apart at a time.
SLICE_BYTES = 4 << 20

_LATIN = "a-zß-öø-ÿ"
#: Words of printable ASCII and Latin letters, whose normal form and pieces are plain to see. All others go through the whole tokenizer.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LATIN}]+|[0-9]|[^{_LATIN}0-9]+")
_KNOWN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_MARK, _PLAIN_END = np.zeros(256, bool), np.zeros(256, bool)
_MARK[list(b".,;:!?#$%&*")] = True
_PLAIN_END[[*range(48, 58), *range(97, 123)]] = True
#: Marks at a word's end that are set apart.
_MOST_MARKS = 4


def set_apart(raw: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The same texts, plain letters in lower case, with a space before a few marks that end a word after a letter or digit.

    Neither changes any id: there a piece ends anyway, and letters are lower-cased
    anyway. Letters before a combining mark stay, as these are composed first.
    """
    low = _LOWER[raw]
    before_mark = np.flatnonzero((raw[1:] == 0xCC) | (raw[1:] == 0xCD))
    low[before_mark] = raw[before_mark]
    starts, ends, _ = words(raw, offsets)
    run, more = np.zeros(len(starts), np.int64), np.ones(len(starts), bool)
    for k in range(_MOST_MARKS + 1):
        more &= (ends - starts > k + 1) & _MARK[low[np.maximum(ends - 1 - k, 0)]] if len(low) else more
        run[more] = k + 1
    at = (ends - run)[(run > 0) & (run <= _MOST_MARKS)]
    last = low[at - 1]
    latin = (last >= 0x80) & (last != 0x97) & (last != 0xB7) & (low[np.maximum(at - 2, 0)] == 0xC3)
    at = at[_PLAIN_END[last] | latin]
    moved = offsets + np.searchsorted(at, offsets)
    kind, width = (pa.StringArray, np.int32) if moved[-1] < 2**31 else (pa.LargeStringArray, np.int64)
    return kind.from_buffers(len(offsets) - 1, pa.py_buffer(moved.astype(width)), pa.py_buffer(np.insert(low, at, 32)))


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's printable letter for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class WordBpe:
    """A tokenizer file whose pieces never span blanks: a text's ids are its words' ids in turn.

    ``ids(texts)`` equals the library's ``encode(text, add_special_tokens=False)``
    for each text, without the library's cost of repeating equal words. Of a
    file with another normaliser or pre-tokenizer, every text is encoded whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.by_word = all(spec.get(k) == v for k, v in _KNOWN.items()) and spec["model"].get("type") == "BPE"
        self.n_ids = self.tokenizer.get_vocab_size()
        self.special = re.compile("|".join(re.escape(x["content"]) for x in spec.get("added_tokens", [])) or r"(?!)")
        letters = _byte_letters()
        self.letters = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}
        self.known: dict[str, list[int]] = {}
        self.before: dict[str, list[int]] = {}

    def _keep(self, key: str, ids: list[int]) -> list[int]:
        if len(self.known) >= REMEMBERED:
            self.before, self.known = self.known, {}
        self.known[key] = ids
        return ids

    def _piece(self, piece: str) -> list[int]:
        have = self.known.get(piece)
        if have is None:
            have = self.before.get(piece)
            if have is None:
                have = [t.id for t in self.model.tokenize(piece if piece.isascii() else piece.translate(self.letters))]
            self._keep(piece, have)
        return have

    def _word(self, word: str) -> list[int]:
        have = self.before.get(word)
        if have is not None:
            return self._keep(word, have)
        if not _PLAIN.fullmatch(word) or self.special.search(word):
            return self.tokenizer.encode(word, add_special_tokens=False).ids
        pieces = _PIECES.findall(word.lower())
        if len(pieces) == 1:
            return self._keep(word, self._piece(pieces[0]))
        return self._keep(word, [i for piece in pieces for i in self._piece(piece)])

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts (null: none), and where each text's begin (one more than texts)."""
        texts = texts.fill_null("")
        if self.by_word:
            raw, offsets = utf8(texts)
            if not self.special.search(raw.tobytes().lower().decode("utf-8", "replace")):
                texts = set_apart(raw, offsets)
            lists = pc.ascii_split_whitespace(texts)
            coded = pc.dictionary_encode(lists.flatten())
            of, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            units = list(map(self.known.get, names))
            for k in [k for k, u in enumerate(units) if u is None]:
                units[k] = self._word(names[k])
            first = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy().astype(np.int64))])
        else:
            units = [self.tokenizer.encode(t, add_special_tokens=False).ids for t in texts.to_pylist()]
            of, first = np.arange(len(units)), np.arange(len(units) + 1)
        n = np.fromiter(map(len, units), np.int64, len(units))
        flat = np.fromiter(chain.from_iterable(units), np.uint32, int(n.sum()))
        start, size = np.cumsum(n) - n, n[of]
        ids = flat[ragged(start[of], size)]
        return ids, np.concatenate([[0], np.cumsum(per_text(size, first))])


def load(path: str) -> WordBpe:
    """The worker's tokenizer of that file, read once and kept until a stage without tokenizers."""
    if path not in KEPT:
        KEPT[path] = WordBpe(path)
    return KEPT[path]


def with_end(ids: np.ndarray, first: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with one more id after each text's."""
    n = len(first) - 1
    return np.insert(ids, first[1:], end).astype(np.uint32), first + np.arange(n + 1)
