"""Counts of whole texts, a slice of them at a time in numpy."""

from __future__ import annotations

import numpy as np

from .common import mix, per_text, span_hashes, window_hashes, words


def _class(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


SYMBOLS = _class(b"#*$%&|<>")
_UPPER, _DIGIT = _class(bytes(range(65, 91))), _class(bytes(range(48, 58)))
_MARKS, _BANG, _PUNCT = _class(b"#*$%&|<>"), _class(b"!?"), _class(b".,;:")
_HIGH = _class(bytes(range(0x80, 0x100)))


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _distinct(key: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """How many different keys each text has."""
    _, at = np.unique(mix(key ^ mix(text.astype(np.uint64) + np.uint64(1))), return_index=True)
    return np.bincount(text[at], minlength=n)


def counts(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """For each text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and what the classifier adds to them.

    Lines and three-word windows are told apart by 64-bit hashes within a text.
    """
    n = len(offsets) - 1
    starts, ends, first = words(raw, offsets)
    point = (raw & 0xC0) != 0x80
    inside = np.zeros(len(raw) + 1, np.int8)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    inside = np.cumsum(inside[:-1]) > 0
    out = {"n_words": first[1:] - first[:-1], "n_chars": _sums(point, offsets), "word_chars": _sums(point & inside, offsets), "n_symbols": _sums(SYMBOLS[raw], offsets)}

    # lines: cut at \n and at the ends of texts
    newline = np.flatnonzero(raw == 10)
    begin = np.unique(np.concatenate([offsets[:-1][offsets[:-1] < offsets[1:]], newline + 1]))
    begin = begin[begin < len(raw)]
    text = np.searchsorted(offsets, begin, side="right") - 1
    stop = np.minimum(np.append(begin[1:], len(raw)), offsets[text + 1])
    stop = np.where((stop > begin) & (raw[stop - 1] == 10), stop - 1, stop) if len(begin) else stop
    has = np.searchsorted(starts, stop) > np.searchsorted(starts, begin)
    begin, stop, text = begin[has], stop[has], text[has]
    lines = np.bincount(text, minlength=n)
    out |= {"n_lines": lines, "n_dup_lines": lines - _distinct(span_hashes(raw, begin, stop, 3), text, n)}

    h = span_hashes(raw, starts, ends, 1)
    of_word = np.repeat(np.arange(n), first[1:] - first[:-1])
    out["n_distinct"] = _distinct(h, of_word, n)
    covered = np.zeros(len(h) + 1, np.int64)
    if len(h) > 2:
        same = of_word[2:] == of_word[:-2]
        at = np.flatnonzero(same)
        key = mix(window_hashes(h, 3)[at] ^ mix(of_word[at].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(key)
        key = key[order]
        twin = np.zeros(len(key), bool)
        twin[1:] = key[1:] == key[:-1]
        twin[:-1] |= twin[1:].copy()
        again = at[order[twin]]
        covered += np.bincount(again, minlength=len(covered))
        covered -= np.bincount(np.minimum(again + 3, len(h)), minlength=len(covered))
    out["n_repeat_words"] = per_text(np.cumsum(covered[:-1]) > 0, first)
    out["base_failed"] = (out["n_words"] < 50) | (100 * out["n_repeat_words"] > 50 * out["n_words"])

    tail = raw[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    out |= {"n_upper": _sums(_UPPER[raw], offsets), "n_digit": _sums(_DIGIT[raw], offsets), "n_bang": _sums(_BANG[raw], offsets), "n_punct": _sums(_PUNCT[raw], offsets), "n_high": _sums(_HIGH[raw] & point, offsets), "n_odd_ends": per_text(_MARKS[tail] | _BANG[tail], first)}
    return out


#: Inputs of the quality classifier, all of the text alone.
FEATURES = ("log_words", "word_len", "symbols", "dup_lines", "repeats", "distinct", "upper", "digits", "bangs", "punct", "high", "odd_ends", "line_words")


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    """A row for each text, a column for each of ``FEATURES``."""
    n, w, lines = np.maximum(c["n_chars"], 1), np.maximum(c["n_words"], 1), np.maximum(c["n_lines"], 1)
    of = {
        "log_words": np.log1p(c["n_words"]), "word_len": c["word_chars"] / w, "symbols": c["n_symbols"] / n, "dup_lines": c["n_dup_lines"] / lines, "repeats": c["n_repeat_words"] / w,
        "distinct": c["n_distinct"] / w, "upper": c["n_upper"] / n, "digits": c["n_digit"] / n, "bangs": c["n_bang"] / n, "punct": c["n_punct"] / n, "high": c["n_high"] / n,
        "odd_ends": c["n_odd_ends"] / w, "line_words": c["n_words"] / lines,
    }
    return np.stack([of[k] for k in FEATURES], axis=1)
