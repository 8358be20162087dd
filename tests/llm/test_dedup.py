"""SimHash, line and substring deduplication against brute force."""

import hashlib
import re

import duckdb
import numpy as np
import pytest
import xxhash

from quillgraph.llm import linededup, registry, simhash, substring
from quillgraph.llm.components import connected_components, forest


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def fingerprint(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    s = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    tally = [0] * 64
    for x in s:
        h = xxhash.xxh64_intdigest(x.encode(), 42)
        for b in range(64):
            tally[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * tally[b] > len(s)) if s else 0


def components(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("longest", [simhash.LONGEST, 2])
@pytest.mark.parametrize("which", ["odd", "real"])
def test_near_duplicates(request, which, longest):
    docs = request.getfixturevalue(which)
    rows = [r for r in docs.select("doc_id", "text").collect() if r.doc_id is not None]
    fp = {r.doc_id: fingerprint(r.text) for r in rows}
    ids = sorted(fp)
    f = np.array([fp[i] for i in ids], np.uint64)
    links = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.bitwise_count(f[:, None] ^ f[None]) <= 4))]
    want = components(ids, links)
    got = [r for r in simhash.near_duplicates(docs, longest=longest).collect() if r.doc_id is not None]
    assert len(got) == len(rows)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{fp[i]:016x}", want[i]) for i in ids}


def shingles(text, width=5):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def test_drop_near_duplicates(spark, odd):
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    groups = {r.doc_id: r.component_id for r in simhash.similar(odd).collect()}
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == {i for i, c in groups.items() if i == c}
    rows = {r.doc_id: r.text for r in odd.collect() if r.doc_id is not None}
    assert set(groups) == set(rows)
    # copies share a group; members of a group are alike through others
    assert len({groups[i] for i, t in rows.items() if t == rows[5]}) == 1
    for i, c in groups.items():
        if i != c:
            assert any(j != i and groups[j] == c and (rows[i] == rows[j] or len(shingles(rows[i]) & shingles(rows[j])) >= 0.8 * len(shingles(rows[i]) | shingles(rows[j]))) for j in rows)


@pytest.mark.parametrize("longest", [simhash.LONGEST, 3])
def test_near_copies_are_found(spark, longest):
    """Texts with a few words changed, by their real likeness, and texts that merely share a third."""
    import random

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    texts, near, far = [], [], []
    for k in range(150):
        base = [word() for _ in range(rng.randint(150, 400))]
        copy = list(base)
        for i in rng.sample(range(len(base)), 1 + k % 4):
            copy[i] = word()
        a, b = len(texts), len(texts) + 1
        texts += [" ".join(base), " ".join(copy), " ".join(base[: len(base) // 3] + [word() for _ in base])]
        x, y = shingles(texts[a]), shingles(texts[b])
        if len(x & y) >= 0.88 * len(x | y):
            near.append((a, b))
        far.append((a, a + 2))
    got = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), longest=longest).collect()}
    assert len(near) > 80 and np.mean([got[a] == got[b] for a, b in near]) >= 0.95
    assert not any(got[a] == got[b] for a, b in far)


def test_groups_are_verified(spark, monkeypatch):
    """Every candidate is compared on its shingles: loose bits change no group, and one passage said over and over makes no copies."""
    import random

    rng = random.Random(3)
    prose = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    spam = prose(5) * 200
    texts = [" ".join(spam + prose(100)) for _ in range(4)]
    for share in (0.7, 0.78, 0.82, 0.9):
        base = prose(300)
        other = base[: round(300 * 2 * share / (1 + share))]
        texts += [" ".join(base), " ".join(other + prose(300 - len(other)))]
    chain = prose(200)
    for _ in range(30):  # near copies of near copies
        chain = chain[8:] + prose(8)
        texts.append(" ".join(chain))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [shingles(t) for t in texts]
    pairs = [(j, i) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = components(range(len(texts)), pairs)
    for bits in (simhash.candidate_bits(0.8, 4), 100):
        monkeypatch.setattr(simhash, "candidate_bits", lambda *_, bits=bits: bits)
        for longest in (simhash.LONGEST, 2):
            got = {r.doc_id: r.component_id for r in simhash.similar(df, longest=longest).collect()}
            assert all(want[i] == want[c] for i, c in got.items())
            assert all(got[i] == i for i in range(8))
        assert len(set(got.values())) <= len(set(want.values())) + 3


@pytest.mark.parametrize("longest", [simhash.LONGEST, 7, 2])
def test_groups_do_not_depend_on_lists(spark, longest):
    """The groups are those of all candidates whose shingles are alike, however many rows a posting list may have."""
    import random

    import pyarrow as pa

    from quillgraph.llm.common import utf8

    rng = random.Random(2)
    prose = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    base, spans, texts = prose(240), [prose(6) for _ in range(120)], []
    for _ in range(150):  # copies with some passages changed, some of them alike
        own = [spans[3 * k + rng.randrange(3)] if rng.random() < 0.06 else base[6 * k : 6 * k + 6] for k in range(40)]
        texts.append(" ".join(sum(own, [])))
    fp, sets = simhash._wide_prints(*utf8(pa.array(texts)), 5, 4), [shingles(t) for t in texts]
    other = fp[:, None] ^ fp[None]
    met = ((other.view(np.uint8).reshape(*other.shape, 8) == 0).sum(axis=3) >= 3).any(axis=2)
    close = np.triu(met & (np.bitwise_count(other).sum(axis=2) <= simhash.candidate_bits(0.8, 4)), 1)
    want = components(range(150), [(i, j) for i, j in zip(*np.nonzero(close)) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    assert {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), longest=longest).collect()} == want


def test_wide_lists_cut_at_any_batch():
    import pyarrow as pa

    rng = np.random.default_rng(12)
    base = rng.integers(0, 1 << 63, (3, 3)).astype(np.uint64)
    key = np.repeat(np.arange(6), [1, 2, 9, 40, 3, 25])
    fp = base[rng.integers(0, 3, len(key))] ^ (np.uint64(1) << rng.integers(0, 64, (len(key), 3)).astype(np.uint64))

    def groups(n, longest):
        batches = [pa.RecordBatch.from_arrays([pa.array(key[i : i + n]), *simhash._columns(fp[i : i + n])], names=["key", "f0", "f1", "f2"]) for i in range(0, len(key), n)]
        links = [(tuple(r[:3]), tuple(r[3:])) for b in simhash._wide_lists(iter(batches), 29, longest) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        return components(sorted(set(map(tuple, fp.view(np.int64).tolist()))), links)

    for longest in (4, 30, 100):
        assert all(groups(n, longest) == groups(1000, 100) for n in (1, 4, 11, 200))


def test_matching_pairs_are_all_close_pairs():
    rng = np.random.default_rng(1)
    f = rng.integers(0, 1 << 63, 200).astype(np.uint64)
    near = f.copy()
    for k in range(200):
        for b in rng.choice(64, k % 7, replace=False):
            near[k] ^= np.uint64(1) << np.uint64(b)
    every = np.concatenate([f, near])
    i, j = simhash.matching_pairs(every)
    a, b = np.nonzero(np.triu(np.bitwise_count(every[:, None] ^ every[None]) <= 4, 1))
    assert set(zip(i.tolist(), j.tolist())) == set(zip(a.tolist(), b.tolist()))


def test_lists_cut_at_any_batch():
    import pyarrow as pa

    key = np.repeat(np.arange(9), [1, 2, 3, 9, 1, 1, 4, 20, 2])
    fp = np.arange(len(key)) * 0 + 7 + (np.arange(len(key)) % 5)

    def batches(n):
        for at in range(0, len(key), n):
            yield pa.record_batch([pa.array(key[at : at + n]), pa.array(fp[at : at + n])], names=["key", "fp"])

    def result(n, longest):
        pairs, hot = set(), set()
        for b in simhash._compare(batches(n), longest):
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                (hot.add(x) if y is None else pairs.add((x, y)))
        return pairs, hot

    for longest in (3, 8, 100):
        assert len({str(result(n, longest)) for n in (1, 2, 5, 11, 100)}) == 1


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + k, 1001 + k) for k in range(40)] + [(5, 5)] + [(2000, 2001 + k) for k in range(50)]
    want = components(sorted({x for e in edges if e[0] != e[1] for x in e}), edges)
    got = connected_components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()
    assert {r.v: r.component for r in got} == want and len(got) == len(want)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    v, r = forest(np.array([3, 9, 4]), np.array([1, 4, 2]))
    assert dict(zip(v.tolist(), r.tolist())) == {3: 1, 4: 2, 9: 2}


def cut_lines(text):
    """Lines, and chunks as (first, end, bytes, neighbours before from near to far, neighbours after)."""
    lines = text.split("\n")
    n = len(lines)
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    r = [((h[i - 1] if i else 0) * linededup._PRIME + h[i]) % linededup._MODULUS for i in range(n)]
    ends = [i for i in range(1, n + 1) if i == n or 2 <= i <= n - 2 and r[i - 1] < r[i - 2] and r[i - 1] < r[i]]
    out = []
    for k, e in enumerate(ends):
        b, low, high = ends[k - 1] if k else 0, max(0, (ends[k - 2] if k > 1 else 0) - 3), min(n, (ends[k + 1] if k + 1 < len(ends) else n) + 3)
        out.append((b, e, "\n".join(lines[b:e]), lines[low:b][::-1], lines[e:high]))
    return lines, [c for c in out if c[1] - c[0] >= 2 and re.search(r"\S", c[2])]


def in_common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


@pytest.mark.parametrize("which", ["odd", "real"])
def test_lines(request, which):
    docs = request.getfixturevalue(which)
    rows = sorted(((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if r.doc_id is not None), key=lambda r: r[0])
    earliest = {}
    for i, t in rows:
        for a, _, c, up, down in cut_lines(t or "")[1]:
            if c not in earliest or (i, a) < earliest[c][:2]:
                earliest[c] = i, a, up, down
    want = []
    for i, t in rows:
        lines, found = cut_lines(t or "")
        gone = set()
        for a, b, c, up, down in found:
            if earliest[c][:2] != (i, a):
                gone |= set(range(a - in_common(up, earliest[c][2]), b + in_common(down, earliest[c][3])))
        want.append((i, 0 if t is None else len(lines), len(gone), t if not gone else "\n".join(x for k, x in enumerate(lines) if k not in gone)))
    got = sorted((tuple(r) for r in linededup.report(docs).collect() if r.doc_id is not None), key=lambda r: r[0])
    assert got == want
    assert sum(r[2] for r in want) > 0
    assert linededup.dedup_lines(docs).columns == docs.columns
    # nothing is lost: every line that goes stands in an earlier document, or earlier in the same
    left = {x for r in got for x in (r[3] or "").split("\n")}
    assert {x for _, t in rows for x in (t or "").split("\n")} - {""} <= left


def test_whole_passages_go(spark):
    """Passages of six lines and more go whole, whatever stands around them, and so does one line said over and over."""
    import random

    rng = random.Random(4)
    line = lambda: " ".join(rng.choice("abcdefgh") * rng.randint(1, 9) + str(rng.randrange(10**6)) for _ in range(6))
    shared = {k: [line() for _ in range(n)] for k, n in enumerate([12, 20, 40, 8, 30])}
    rows, whole = [(0, "\n".join(x for v in shared.values() for x in [line() for _ in range(5)] + v))], 0
    for d in range(1, 60):
        body = shared[d % 5]
        rows.append((d, "\n".join([line() for _ in range(d % 7)] + body + [line() for _ in range(d % 4)])))
    got = {r.doc_id: r for r in linededup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d in range(1, 60):
        own = d % 7 + d % 4
        assert got[d].n_lines - got[d].n_removed in (own, got[d].n_lines)  # all of the passage, or none of it
        whole += got[d].n_lines - got[d].n_removed == own
    assert whole >= 57 and got[0].n_removed == 0
    said = spark.createDataFrame([(0, "x\n" * 30), (1, "x\n" * 30)], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in linededup.report(said).collect()} == {0: 0, 1: 31}


def substrings(rows, width):
    """rows of (doc_id, text), whole."""
    earliest = {}
    for i, t in rows:
        if i is not None:
            w = words(t)
            for k in range(len(w) - width + 1):
                key = tuple(w[k : k + width])
                earliest[key] = min(earliest.get(key, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = {j for k in range(len(w) - width + 1) if i is not None and earliest[tuple(w[k : k + width])] < i for j in range(k, k + width)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("width, hot", [(50, substring.HOT), (50, 2), (7, 3)])
@pytest.mark.parametrize("which", ["odd", "real"])
def test_substrings(request, which, width, hot):
    docs = request.getfixturevalue(which)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in substring.remove_repeats(docs, width, hot=hot).collect()), key=str)
    want = substrings(rows, width)
    assert got == want
    assert sum(r[2] for r in want) > 0


def test_full_sketch_loses_nothing(odd):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in substring.remove_repeats(odd, bits=4).collect()), key=str) == substrings(rows, 50)


def test_window_samples_are_the_windows_own():
    h = np.random.default_rng(3).integers(0, 1 << 63, 500).astype(np.uint64)
    whole = substring.window_samples(h, 50)
    assert all(substring.window_samples(h[k : k + 50], 50)[0] == whole[k] for k in range(0, 450, 17))


def test_empty_tables(empty):
    for f in (simhash.near_duplicates, linededup.report, substring.remove_repeats, simhash.drop_near_duplicates, linededup.dedup_lines):
        assert f(empty).count() == 0


@pytest.mark.parametrize("name", ["op4_lines", "op5_substrings", "op8_quality_rules"])
def test_sql(spark, sf, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.sql(registry.oracle_sql()[name]).fetchall()
    got = registry.queries()[name](spark, sf)
    assert got.columns == con.sql(registry.oracle_sql()[name]).columns
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
