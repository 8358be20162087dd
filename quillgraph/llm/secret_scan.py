"""Secrets in texts: fixed forms, and credential values that would take many guesses."""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, mapped, prepare, slices, utf8

#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "guess")
#: Decimal logarithm of the guesses from which a credential's value counts as a secret.
ENOUGH = 8.0

_ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{16,}")  # runs are maximal, so just those of 16 and more
_HINT = re.compile(rb"passw|secret|token|api_?key", re.I)
#: Where a value is a credential: more names than the fixed form knows, and values of any characters, unquoted ones up to a space, Unicode's too.
_CONTEXT = re.compile(rb"""(?:password|passwd|passphrase|passcode|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?)["']?\x20*(?::=|=>|[:=])\x20*(?:"([^"\r\n]{4,256})"|'([^'\r\n]{4,256})'|((?:[!-~]|(?!\xc2[\x80-\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8b\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80)[\xc2-\xf4][\x80-\xbf]+){4,}))""", re.I)
_CONTEXT_HINT = re.compile(rb"passw|passp|passc|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential", re.I)

#: Frequent words of passwords and of English, the more frequent first.
_WORDS = """password the and pass admin welcome login letmein monkey dragon master hello shadow secret love sunshine princess football baseball iloveyou
superman batman trustno qwerty user test guest root temp demo default change changeme example sample dummy your here this that with from have will none null true false
redacted hidden removed value string token api key access private public server client database data mail email web site name first last summer winter spring autumn
monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december
computer internet service system account manager company office school house family friend money music flower orange purple yellow green black white silver golden
michael jennifer thomas jessica robert michelle daniel ashley william andrew joshua matthew charlie jordan hunter ranger harley buster soccer hockey tigger ginger
cheese coffee cookie banana chicken pepper jackson maggie martin george david james john mary peter paul anna maria laura nicole sophie oliver
correct horse battery staple purple elephant dance river stone mountain ocean forest light night star moon sun fire water earth wind
to of in is it for on as was are be by at or an we he she you not but all can her his one our out day get has him how man new now old see two way who boy did its let put say too use
was were been has had der die und das ist nicht ein eine mit auf den dem von les des une est que pour dans qui sur pas los las por con una para del""".split()
_RANK = {w: r for r, w in reversed([*enumerate(dict.fromkeys(_WORDS), 1)])}
_LONGEST_WORD = max(map(len, _RANK))
_LEET = str.maketrans("@4301!$57+", "aaeoilsstt"[:10])
_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./", "~!@#$%^&*()_+")
_PLACE = {c: (r if r < 4 else 0, i) for r, row in enumerate(_ROWS) for i, c in enumerate(row)}
_DATES = [re.compile(p) for p in (r"(?:19|20)\d\d", r"\d{1,2}[-/.]\d{1,2}[-/.](?:\d{4}|\d{2})", r"(?:19|20)\d\d[-/.]\d{1,2}[-/.]\d{1,2}", r"(?:19|20)\d\d(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])", r"(?:0[1-9]|[12]\d|3[01])(?:0[1-9]|1[0-2])(?:19|20)\d\d")]
_DATE_COST = math.log10(365 * 120 * 4)


def _near(a: str, b: str) -> bool:
    p, q = _PLACE.get(a.lower()), _PLACE.get(b.lower())
    return p is not None and q is not None and p != q and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1


def _alphabet(text: str) -> int:
    return max(10, 10 * any(c.isdigit() for c in text) + 26 * any(c.islower() for c in text) + 26 * any(c.isupper() for c in text) + 33 * any(not c.isalnum() for c in text))


def guess_cost(value: str, most: float = math.inf) -> float:
    """Decimal logarithm of the guesses that ``value`` takes at its cheapest segmentation.

    Dynamic programming over its prefixes: each ends in a dictionary word (also
    capitalised or with digits for letters), a date, a repeat, a run of keys or
    of the alphabet, or one more brute-force character; every segment after the
    first doubles the guesses. Linear in the length: words and dates are short,
    and repeats and runs are followed as they grow. Stops at ``most``, as no
    later prefix costs less than a shorter one by more than a word's length.
    """
    n, brute = len(value), math.log10(_alphabet(value))
    low, plain = value.lower(), value.lower().translate(_LEET)
    best = [0.0] + [math.inf] * n
    keys = letters = same = 0  # where the run of neighbouring keys, of the alphabet, and of one character, began
    step = 0

    def reach(end: int, start: int, cost: float) -> None:
        best[end] = min(best[end], best[start] + cost + (0.301 if start else 0.0))

    for i in range(n):
        best[i + 1] = min(best[i + 1], best[i] + brute)
        if i:
            if value[i] != value[i - 1]:
                same = i
            delta = ord(low[i]) - ord(low[i - 1])
            if abs(delta) != 1 or not low[i].isalnum():
                letters, step = i, 0
            elif delta != step:
                letters, step = i - 1, delta
            if not _near(value[i], value[i - 1]):
                keys = i
        if i - same >= 2:
            reach(i + 1, same, brute + math.log10(i + 1 - same))
        for start in (keys, letters):
            if i - start >= 2:
                reach(i + 1, start, math.log10(47 * 4 * (i + 1 - start)))
        for start in range(max(0, i + 1 - _LONGEST_WORD), i):
            for text, extra in ((low, 0.0), (plain, 0.5)):
                rank = _RANK.get(text[start : i + 1])
                if rank:
                    caps = sum(c.isupper() for c in value[start : i + 1])
                    reach(i + 1, start, math.log10(rank + 1) + extra + (0.301 if caps in (1, i + 1 - start) else 0.301 * caps))
        for start in (i - 3, i - 7, *range(i - 9, i - 4)):
            if start >= 0 and (value[start].isdigit() and value[i].isdigit()) and any(d.fullmatch(value, start, i + 1) for d in _DATES):
                reach(i + 1, start, _DATE_COST if i - start > 3 else math.log10(200))
        # repeats of a block of up to eight characters
        for size in range(2, 9):
            a, b = i + 1 - 2 * size, i + 1 - size
            if a >= 0 and value[a:b] == value[b : i + 1]:
                reach(i + 1, b, math.log10(2))
        if i >= _LONGEST_WORD and min(best[i + 1 - _LONGEST_WORD : i + 2]) > most:
            return most
    return best[n]


def spans(text: bytes) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` in bytes of a text's UTF-8, sorted; ``kind`` counts in ``KINDS``."""
    found: list[tuple[int, int, int]] = []
    if _HINT.search(text):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if b"AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if _CONTEXT_HINT.search(text):
        base = sorted((s, e) for s, _, e in found)
        for m in _CONTEXT.finditer(text):
            group = next(k for k in (1, 2, 3) if m.group(k) is not None)
            s, e = m.span(group)
            if group == 3:
                while e > s and text[e - 1 : e] in (b".", b",", b";", b")", b"]", b"}", b'"', b"'"):
                    e -= 1
            if e - s < 4 or any(a <= s and e <= b for a, b in base):
                continue
            # a value that reaches beyond a base span is a secret as a whole, as a part of it is one
            if any(a < e and s < b for a, b in base) or guess_cost(text[s:e].decode("utf-8", "replace"), ENOUGH) >= ENOUGH:
                found.append((s, 3, e))
    return sorted(found)


def _points(text: bytes, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Byte offsets as code points."""
    if text.isascii() or not found:
        return found
    before = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [(int(before[s]), k, int(before[e])) for s, k, e in found]


def _listed(found) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def _each(batch: pa.RecordBatch):
    raw, offsets = utf8(column(batch, "text"))
    whole, at = raw.tobytes(), offsets.tolist()
    for a, b in zip(at[:-1], at[1:], strict=True):
        yield whole[a:b]


def scan(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_guess)`` of each document.

    Base spans are the leftmost non-overlapping matches of each kind, in code
    points: assignments of 12 and more characters to a credential's name, access
    ids of 18 and more, lower-case hexadecimal runs of 16 and more. The method
    adds ``guess``: the value of a credential, not within a base span, that takes
    10**8 guesses or more at its cheapest segmentation (``guess_cost``), or that
    reaches beyond a base span in it. Null
    texts are empty: no spans, and the hash of nothing. Texts are scanned whole.
    """
    prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                n, base, listed = [], [], []
                for text in _each(part):
                    found = _points(text, spans(text))
                    n.append([sum(k == kind for _, k, _ in found) for kind in range(4)])
                    base.append(hashlib.sha256(_listed(x for x in found if x[1] < 3).encode()).hexdigest())
                    listed.append(_listed(found))
                n = np.array(n, np.int64).reshape(-1, 4)
                cols = [column(part, "doc_id"), *(pa.array(n[:, k]) for k in range(3)), pa.array(base, pa.string()), pa.array(listed, pa.string()), pa.array(n[:, 3])]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return mapped(plain, run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """All documents with their columns, each span of ``scan`` replaced by ``mark`` in the text.

    Overlapping spans are one. A null text stays null. ``n_chars``, if there, is
    counted anew where the text changed.
    """
    prepare(docs.sparkSession)
    schema, sign = docs.schema, mark.encode()
    at = schema.fieldNames().index("text")

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                new: list[bytes | None] = []
                there = part.column(at).is_valid().to_pylist()
                for text, real in zip(_each(part), there, strict=True):
                    out, done = [], 0
                    for s, _, e in spans(text):
                        if s >= done:
                            out += [text[done:s], sign]
                        done = max(done, e)
                    new.append((b"".join(out) + text[done:] if out else text) if real else None)
                texts = pa.array(new, pa.binary()).cast(part.column(at).type)
                yield part.set_column(at, part.schema.field(at), texts)

    out = docs.withColumn("_before", F.hash("text")) if "n_chars" in schema.fieldNames() else docs
    if out is docs:
        return mapped(docs, run, schema)
    again = mapped(out, run, out.schema)
    return again.withColumn("n_chars", F.when(F.hash("text") == F.col("_before"), F.col("n_chars")).otherwise(F.length("text").cast(schema["n_chars"].dataType))).drop("_before")
