"""Tokenizers, packing and token files against the libraries and exact round trips."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillgraph.llm import bitpack, bytebpe, packing, wordbpe

WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.tiktoken")
ODD = ["", "a", "Don't you'll THE 3com x2y ab12cd", "İstanbul ΑΣΣ ſecret K ẞ ﬁ", "é́ é  x y​ \x00\x1f", "日本語テキスト " * 30, "'s''t\"'re !!'ll", "<|endoftext|> <|startoftext|>x", "😀👍🏽 ok", "\n\n  \t a  \r\n b", "x" * 3000, "ab" * 4000, "汉" * 3000, " " * 3000 + "z", "\n" * 900, "1234567890" * 300, "a b" * 2000, "don't" * 900, "é" * 999 + "'s"]


@pytest.fixture(scope="module")
def word_library():
    return Tokenizer.from_file(WORD)


@pytest.fixture(scope="module")
def byte_library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bytebpe.read_ranks(BYTE), special_tokens={})


def test_word_bpe(word_library, real):
    texts = [*ODD, *(r.text for r in real.collect())]
    ids, first = wordbpe.load(WORD).ids(pa.array([*texts, None]))
    for k, t in enumerate(texts):
        assert ids[first[k] : first[k + 1]].tolist() == word_library.encode(t, add_special_tokens=False).ids, t[:50]
    assert first[-1] == first[-2]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text("aAzZJéÉß×÷ \n.,;:!?#$%&*'\"|<>-_0\u0331\u030cKstTlLdD", max_size=40), st.sampled_from(["<|endoftext|>.", "<|ENDOFTEXT|>,"])), max_size=4))
def test_word_bpe_any_text(texts):
    tokenizer = wordbpe.load(WORD)
    ids, first = tokenizer.ids(pa.array(texts, pa.string()))
    for k, text in enumerate(texts):
        assert ids[first[k] : first[k + 1]].tolist() == tokenizer.tokenizer.encode(text, add_special_tokens=False).ids


def test_forgets(monkeypatch, word_library):
    monkeypatch.setattr(wordbpe, "REMEMBERED", 2)
    text = "one two three four five six one two"
    assert wordbpe.WordBpe(WORD).ids(pa.array([text]))[0].tolist() == word_library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("chars, size", [(bytebpe.LEAF_CHARS, bytebpe.LEAF_BYTES), (2048, 256), (7, 8), (64, 32), (1, 2)])
def test_byte_bpe(byte_library, chars, size):
    tree = bytebpe.TreeBpe(BYTE, P.PATTERN, chars, size)
    for text in ODD:
        ids = tree.encode(text)
        assert ids == byte_library.encode_ordinary(text), text[:50]
        assert tree.decode(ids) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab 's\n\té日1!", max_size=60))
def test_byte_bpe_small_leaves(text):
    tree = bytebpe.load(BYTE, P.PATTERN)
    small = bytebpe.TreeBpe.__new__(bytebpe.TreeBpe)
    small.__dict__ |= tree.__dict__ | {"leaf_chars": 2, "leaf_bytes": 2}
    assert small.encode(text) == tree.library.encode_ordinary(text)


def test_encode(odd, rows, byte_library):
    got = bytebpe.encode(odd, BYTE, P.PATTERN, ids=True).collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] for r in rows if r[0] is not None}
    for r in got:
        if r.doc_id is not None:
            text = texts[r.doc_id] or ""
            ids = byte_library.encode_ordinary(text)
            assert r.ids == ids and r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def ids_of(library, text, end):
    return [*library.encode(text or "", add_special_tokens=False).ids, end]


def check_packed(got, docs, library, capacity):
    """Pieces are right, gapless and fit."""
    by, pieces = {}, {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append(r)
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    for d, text in docs:
        ids = ids_of(library, text, 0)
        own = sorted(pieces[d], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in own] == [(k, k * capacity, min(capacity, len(ids) - k * capacity)) for k in range(-(-len(ids) // capacity))]
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    return len(by)


@pytest.mark.parametrize("capacity", [2048, 300])
def test_pack(spark, word_library, real, capacity):
    docs = [(r.doc_id, r.text) for r in real.collect()]
    got = packing.pack(real.repartition(19), WORD, capacity=capacity).collect()
    n = check_packed(got, docs, word_library, capacity)
    least = -(-sum(r.length for r in got) // capacity)
    assert n <= 1.05 * least + 2


@pytest.mark.parametrize("fan_in", [2, 3, 8])
def test_what_groups_keep_back_is_never_missed(monkeypatch, fan_in):
    """Sequences in the end with the groups' bound and without it."""
    monkeypatch.setattr(packing, "FAN_IN", fan_in)
    rng = np.random.default_rng(fan_in)

    def merged(parts, bound):
        tables = []
        for k, fills in enumerate(parts):
            base = (k << 40) + np.arange(len(fills))
            tables.append(pa.table({"base": base, "now": base, "at": np.zeros(len(fills), np.int64), "fill": fills, "part": np.full(len(fills), k)}))
        ended = 0
        while True:
            groups = [tables[k : k + fan_in] for k in range(0, len(tables), fan_in)]
            spare = fan_in * packing.levels_above(len(groups)) if bound else 1 << 60
            out = [packing._merge(pa.concat_tables(g), 100, spare) for g in groups]
            if len(out) == 1:
                return ended + len(set(out[0].column("now").to_pylist()))
            ended += sum(len(set(t.filter(t.column("done")).column("now").to_pylist())) for t in out)
            tables = [t.filter(pa.compute.invert(t.column("done"))).drop_columns(["done"]) for t in out]

    for _ in range(20):
        parts = [np.append(rng.choice([51, 55, 60, 67, 80, 90], rng.integers(0, 200)), rng.integers(1, 51, 1)) for _ in range(int(rng.integers(1, 40)))]
        assert merged(parts, True) == merged(parts, False)


def test_pack_odd(odd, rows, word_library):
    got = packing.pack(odd, WORD, capacity=64).collect()
    total = sum(len(ids_of(word_library, r[1], 0)) for r in rows)
    assert sum(r.length for r in got) == total
    once = [(r[0], r[1]) for r in rows if r[0] is not None and [x[0] for x in rows].count(r[0]) == 1]
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in v) <= 64 and sorted(o for o, _ in v)[0] == 0 for v in by.values())
    for d, text in once:
        assert sum(r.length for r in got if r.doc_id == d) == len(ids_of(word_library, text, 0))


def test_best_fit():
    rng = np.random.default_rng(4)
    size = rng.integers(1, 101, 500)
    bins, at, fill = packing.best_fit(size, 100)
    for b in range(len(fill)):
        own = np.flatnonzero(bins == b)
        own = own[np.argsort(at[own])]
        assert (at[own] == np.concatenate([[0], np.cumsum(size[own])[:-1]])).all() and size[own].sum() == fill[b] <= 100
    assert len(fill) <= 1.1 * size.sum() / 100 + 1


@pytest.mark.parametrize("bits", [1, 3, 8, 11, 16, 17, 31, 32])
def test_bits(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001).astype(np.uint32)
    raw = bitpack.pack_bits(ids, bits)
    assert len(raw) == -(-1001 * bits // 8)
    assert (bitpack.unpack_bits(raw, 1001, bits) == ids).all()
    with pytest.raises(ValueError):
        bitpack.pack_bits(np.array([1 << bits], np.uint64).astype(np.uint32) if bits < 32 else np.array([2**32 - 1], np.uint32), min(bits, 31))


def test_bits_for():
    assert [bitpack.bits_for(n) for n in (1, 2, 3, 256, 257, 49_408, 65_536, 65_537)] == [1, 1, 2, 8, 9, 16, 16, 17]


@pytest.mark.parametrize("n_ids", [300, 49_408])
def test_file_random_access(tmp_path, monkeypatch, n_ids):
    from pyarrow import fs

    monkeypatch.setattr(bitpack, "BLOCK", 64)
    files, path, rng = fs.LocalFileSystem(), str(tmp_path / "x.ids"), np.random.default_rng(1)
    w, every = bitpack.Writer(files.open_output_stream(path), n_ids), []
    for _ in range(5):
        ids, first = rng.integers(0, n_ids, 333).astype(np.uint32), np.array([0, 0, 10, 200, 333])
        w.add([None, 3, 4, 9], ids, first)
        every.append(ids)
    assert w.close() == (20, 5 * 333)
    every = np.concatenate(every)
    r = bitpack.Reader(files.open_input_file(path))
    for a, b in ((0, 0), (0, 1), (63, 65), (100, 700), (1600, 1665), (0, 1665)):
        assert (r.ids(a, b) == every[a:b]).all()
    assert r.there.tolist() == [0, 1, 1, 1] * 5 and r.first[-1] == 1665


@pytest.mark.parametrize("which", ["odd", "real"])
def test_files(request, spark, word_library, which):
    docs = request.getfixturevalue(which)
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    got = sorted(bitpack.read_ids(spark, bitpack.write_ids(docs, WORD)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [r[0] for r in rows]
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    counts = [d for d, _ in rows]
    for (d, text), r in zip(rows, got, strict=True):
        if d is not None and counts.count(d) == 1:
            ids = ids_of(word_library, text, 1)
            assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_empty(empty, spark):
    assert packing.pack(empty, WORD).count() == 0
    assert bytebpe.encode(empty, BYTE, P.PATTERN).count() == 0
    assert bitpack.read_ids(spark, bitpack.write_ids(empty, WORD)).count() == 0
