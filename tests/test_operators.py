"""Goldens and properties of the operators."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators import chunking, entities, fusion, lexical, ranking, vectors
from quillgraph.operators import graph as G
from quillgraph.operators import resolve as R
from quillgraph.operators import retrieve


def windows_by_hand(lengths, target, overlap):
    reach = max(target, 128)
    back = min(max(overlap, 0), reach // 2)
    out, s, n = [], 0, len(lengths)
    while s < n:
        e, size = s + 1, lengths[s]
        while e < n and size + 1 + lengths[e] <= reach:
            size += 1 + lengths[e]
            e += 1
        out.append((s, e))
        if e == n:
            break
        r, size = 0, 0
        while r < e - s and size + (1 if r else 0) + lengths[e - 1 - r] <= back:
            size += (1 if r else 0) + lengths[e - 1 - r]
            r += 1
        s = max(s + 1, e - max(r, 1))
    return out


@pytest.mark.parametrize("target, overlap", [(250, 0), (512, 64), (10, 500)])
def test_windows(spark, target, overlap):
    rng = random.Random(target)
    texts = {k: [rng.choice([1, 20, 100, 400]) for _ in range(rng.randint(1, 12))] for k in range(25)} | {99: [100] * 6}
    rows = [(k, " ".join("x" * (n - 1) + "." if n > 1 else "." for n in v)) for k, v in texts.items()]
    got = {}
    for r in chunking.windows(spark.createDataFrame(rows, "k long, text string"), ["k"], target, overlap).collect():
        got.setdefault(r.k, []).append((r.win_ord, r.first, r.last))
    for k, v in texts.items():
        assert [x[1:] for x in sorted(got[k])] == windows_by_hand(v, target, overlap)
    if (target, overlap) == (250, 0):
        assert [x[1:] for x in sorted(got[99])] == [(0, 2), (1, 3), (2, 4), (3, 5), (4, 6)]


def test_numbers_are_global(spark):
    rows = [(s, c, f"{s}.{c}. " * 30) for s in (0, 3, 70_000, 140_000) for c in (1, 2)]
    df = spark.createDataFrame(rows, "src_ord long, sec_ord int, text string")
    keys = ["src_ord", "sec_ord"]
    got = chunking.number(chunking.windows(df, keys), keys).orderBy(*keys, "win_ord").collect()
    assert [r.chunk_ord for r in got] == list(range(len(got))) and got[1].chunk_id == "chunk_0001"
    assert spark.range(1).select(T.chunk_id(F.lit(12345))).first()[0] == "chunk_12345"


def test_text(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(T.tokens(F.lit("The OSPF-v2 is in a 3com router_1, é"))) == ["ospf-v2", "is", "in", "com", "router_1"]
    assert [one(T.signature(F.lit(x))) for x in ("Apple Inc.", "Co-op", "Inc.", "Société  Générale Ltd")] == ["apple", "-op", "", "soci t g n rale"]
    assert one(T.canonical(F.lit("Inc."))) == "inc." and one(T.clean(F.lit(None).cast("string"))) == ""
    assert one(T.names(F.lit("See OSPF- and éX Big-Corp x"))) == ["See", "OSPF", "Big-Corp"]
    assert one(T.sentences(F.lit("Hi! How? No."))) == ["Hi!", "How?", "No."]


#: Sentences whose first or last characters are digits of their own number, and names beside hyphens.
ODD_SENTENCES = "0a B. 10.1.1.1 C! 2 Deux2 2? Model X3. End of it 4"


def test_sentences_keep_their_digits(spark):
    got = spark.range(1).select(T.sentences(F.lit(ODD_SENTENCES))).first()[0]
    assert got == ["0a B.", "10.1.1.1 C!", "2 Deux2 2?", "Model X3.", "End of it 4"]


def test_mentions_are_whole_words(spark):
    rows = [(0, "foo-Bar Qux-é Ab-cd-. -Abc- Abc-Def 9Qux Baz_ Xÿ"), (1, "A. B1. Model Two2"), (2, None)]
    got = entities.mentions(spark.createDataFrame(rows, "chunk_ord long, text string")).orderBy("chunk_ord", "ent_pos").collect()
    assert [(r.chunk_ord, r.text) for r in got] == [(0, "Ab-cd"), (0, "Abc"), (0, "Abc-Def"), (0, "Baz_"), (1, "B1"), (1, "Model"), (1, "Two2")]


def test_windows_keep_sentences_digits(spark):
    got = chunking.windows(spark.createDataFrame([(0, ODD_SENTENCES)], "k long, text string"), ["k"]).collect()
    assert [(r.first, r.last, r.text) for r in got] == [(0, 5, ODD_SENTENCES)]


def test_bm25(spark):
    chunks = spark.createDataFrame([(0, "ospf routing protocol ospf"), (1, "bgp routing protocol"), (2, "vector search")], "chunk_ord long, text string")
    asked = spark.createDataFrame([(0, "ospf routing"), (1, "routing routing"), (2, "vector"), (3, "the of")], "query_id long, text string")
    got = {}
    for r in lexical.search(asked, lexical.build_index(chunks)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.chunk_ord, round(r.score, 6)))
    assert got == {0: [(0, 3.30443), (1, 1.287682)], 1: [(1, 2.575364), (0, 2.239447)], 2: [(2, 1.991938)]}
    empty = chunks.where("false")
    assert lexical.search(asked, lexical.build_index(empty)).count() == 0


def test_bm25_hands_on_few_rows(spark, monkeypatch):
    """Each task hands on ``k`` chunks a question, not all that have a word of it; with and without an index, in grids of any width."""
    rng = random.Random(2)
    words = [f"w{k}" for k in range(12)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 9))) for _ in range(700)] + [None]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_ord long, text string").repartition(2)
    asked = spark.createDataFrame([(q, " ".join(rng.choices([*words, "unknown"], k=4))) for q in range(9)], "query_id long, text string")
    index = lexical.build_index(chunks)
    terms, stats = {r.token: r.idf for r in index.terms.collect()}, index.stats.first()
    want = {}
    for q in asked.collect():
        scored, order = [], q.text.split()
        for c, text in enumerate(texts):
            own = (text or "").split()
            score = sum(terms[t] * own.count(t) * 2.5 / (own.count(t) + 1.5 * (0.25 + 0.75 * max(len(own), 1) / stats.avgdl)) for t in order if t in own)
            if score:
                scored.append((-round(score, 9), min(k for k, t in enumerate(order) if t in own), c))
        want[q.query_id] = [c for *_, c in sorted(scored)[:5]]
    for scores in (lexical.SCORES, 60, 1):
        monkeypatch.setattr(lexical, "SCORES", scores)
        for found in (lexical.search_chunks(asked, chunks), lexical.search(asked, index)):
            got = {}
            for r in found.orderBy("query_id", "rank").collect():
                got.setdefault(r.query_id, []).append(r.chunk_ord)
            assert got == want
    rows = lexical._best_of_batches([pa.RecordBatch.from_pydict({"chunk_ord": list(range(90)), "dl": [1] * 90, "found": [["a"]] * 90})], [3], ["a"], [(0, 0, 1, 0)], np.ones(1), 1.0, 5)
    assert next(rows).column("chunk_ord").to_pylist() == [0, 1, 2, 3, 4]
    assert lexical.search_chunks(asked, chunks.where("false")).count() == 0 == lexical.search_chunks(asked.where("false"), chunks).count()


def test_resolver():
    for first, second, same in [("apple", "apples", 0), ("abcdefghijk", "abcdefghijkl", 0), ("abcdefghijkl", "abcdefghijklm", 1), ("microsoft azure", "microsoft azur", 1), ("john smith", "jon smith", 1), ("color theory", "colour theory", 1), ("open shortest path first", "open shortest paths first", 1)]:
        r = R.Resolver()
        assert r.add(first) == first
        assert (r.add(second) == first) == bool(same), second


def test_resolution_by_first_character_is_the_sequential_one(spark):
    rng = random.Random(3)
    names = []
    for _ in range(300):
        base = rng.choice(["alpha routing", "beta systems", "bela systems", "gamma", "alpine routes"])
        k = rng.randrange(len(base))
        names.append(base[:k] + rng.choice(["", "x", base[k]]) + base[k + 1 :])
    one = R.Resolver()
    want = {}
    for n in names:
        sig = " ".join(n.split())
        if sig:
            want[sig] = one.add(sig)
    got = R.resolve(spark.createDataFrame(list(enumerate(names)), "ord long, text string")).collect()
    assert {r.signature: r.canonical for r in got} == want


def test_blocks_without_a_canonical_name(spark, monkeypatch):
    """Names whose first characters are misspelt join other blocks, one after another, and chains of them end at one name."""
    monkeypatch.setattr(R, "AHEAD", 2)
    rng = random.Random(5)
    stems = ["abc international trading harbour north", "abd international trading harbour north", "axc international trading harbour north"]
    names = [stems[0]]
    for k in range(60):
        stem = rng.choice(stems)
        i = rng.randrange(8, len(stem))
        names.append(stem[:i] + rng.choice(["", "q", "z"]) + stem[i + (k % 2) :])
    names += ["zeta works", "abq", "ab"]
    one, want = R.Resolver(), {}
    for n in names:
        want[" ".join(n.split())] = one.add(" ".join(n.split()))
    got = {r.signature: r.canonical for r in R.resolve(spark.createDataFrame(list(enumerate(names)), "ord long, text string").repartition(3)).collect()}
    assert got == want and len({s[:3] for s, c in got.items() if c[:3] != s[:3]}) >= 1
    assert R.resolve(spark.createDataFrame([], "ord long, text string")).count() == 0


def graph_of(spark, mentions, triplets=()):
    m = spark.createDataFrame(mentions, "chunk_ord long, ent_pos int, text string, label string")
    t = spark.createDataFrame(list(triplets), "triplet_ord long, subject string, predicate string, object string, chunk_id string")
    return G.build_graph(m, t)


def test_types_conflict(spark):
    nodes = graph_of(spark, [(0, 0, "Apple", "DATE"), (0, 1, "Apple", "ORG")]).nodes.collect()
    assert [(n.id, n.entity_type) for n in nodes] == [("apple", "DEFAULT")]
    nodes = graph_of(spark, [(0, 0, "Apple", "DATE"), (0, 1, "Apple", "ORG")], [(0, "Apple", "sells", "Phones", "chunk_0000")]).nodes.collect()
    assert {n.id: (n.entity_type, n.color) for n in nodes} == {"apple": ("ORG", "#1ABC9C"), "phones": ("DEFAULT", "#95A5A6")}


def test_edges(spark):
    edges = graph_of(spark, [(1, 0, "A1", ""), (1, 1, "B1", ""), (2, 0, "A1", ""), (2, 1, "B1", "")], [(0, "A1", " uses ", "B1", "chunk_0001"), (1, "A1", "is", "a1", "chunk_0001")]).edges.collect()
    got = {(e.src, e.dst): (e.weight, e.predicate, e.predicates, e.relation_types, e.chunk_ids) for e in edges}
    assert got[("a1", "b1")] == (3, "co_occurs_with", ["co_occurs_with", "uses"], ["cooccurrence", "extracted_triplet"], ["chunk_0001", "chunk_0002"])
    assert got[("b1", "a1")][0] == 2 and len(got) == 2


def plain(spark, pairs, extra=()):
    ids = sorted({x for p in pairs for x in p} | set(extra))
    nodes = spark.createDataFrame([(i, k) for k, i in enumerate(ids)], "id string, node_ord long")
    return nodes, spark.createDataFrame([(a, b, 1) for a, b in pairs], "src string, dst string, weight long")


def test_closed_forms(spark):
    nodes, edges = plain(spark, [("a", "b"), ("b", "c")])
    assert {r.id: r.degree_centrality for r in G.degrees(G.Graph(nodes, edges)).collect()} == {"a": 0.5, "b": 1.0, "c": 0.5}
    assert {r.id: r.betweenness_centrality for r in ranking.betweenness(nodes, edges).collect()} == {"a": 0.0, "b": 1.0, "c": 0.0}
    star = plain(spark, [("hub", f"leaf{k}") for k in range(6)])
    assert dict(ranking.betweenness(*star).collect())["hub"] == 1.0
    full = plain(spark, [(a, b) for a in "abcd" for b in "abcd" if a < b])
    assert {v for _, v in ranking.betweenness(*full).collect()} == {0.0}
    assert dict(ranking.betweenness(*star, exact_up_to=3, pivots=7).collect())["hub"] == 1.0


def betweenness_by_hand(nodes, edges):
    """From shortest path counts between all pairs."""
    near = {v: set() for v in nodes}
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    depth, paths = {}, {}
    for s in nodes:
        d, n, front = {s: 0}, {s: 1}, [s]
        while front:
            then = []
            for v in front:
                for w in near[v]:
                    if w not in d:
                        d[w] = d[v] + 1
                        n[w] = 0
                        then.append(w)
                    if d[w] == d[v] + 1:
                        n[w] += n[v]
            front = then
        depth[s], paths[s] = d, n
    n = len(nodes)
    through = lambda v, s, t: paths[s][v] * paths[v][t] / paths[s][t] if v in depth[s] and t in depth[v] and depth[s][v] + depth[v][t] == depth[s][t] else 0
    return {v: sum(through(v, s, t) for s in nodes for t in depth[s] if len({v, s, t}) == 3) / (n - 1) / (n - 2) for v in nodes}


def test_betweenness_by_levels(spark):
    rng = random.Random(8)
    pairs = {(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(45)}
    nodes, edges = plain(spark, pairs, extra=["alone"])
    want = betweenness_by_hand([r.id for r in nodes.collect()], pairs)
    assert dict(ranking.betweenness(nodes, edges).collect()) == pytest.approx(want, abs=1e-4)
    assert dict(ranking.betweenness(nodes, edges, exact_up_to=5, pivots=99).collect()) == pytest.approx(want, abs=1e-4)


def test_betweenness_is_exact_above_500_nodes(spark):
    sides = [("a", f"x{k}") for k in range(300)] + [("b", f"y{k}") for k in range(210)]
    got = dict(ranking.betweenness(*plain(spark, [("a", "b"), *sides])).collect())
    assert got["a"] == round((511**2 - 300 - 211**2) / 511 / 510, 4) and got["b"] == round((511**2 - 210 - 301**2) / 511 / 510, 4)
    assert {v for k, v in got.items() if k not in "ab"} == {0.0}


def few_mentions(spark):
    rng = random.Random(6)
    rows = [(c, k, rng.choice(["Ada", "Bob Inc", "bob", "Cy", "Dee", "Inc."]), rng.choice(["ORG", "", "LOC"])) for c in range(40) for k in range(4)]
    return spark.createDataFrame(rows, "chunk_ord long, ent_pos int, text string, label string")


def test_graph_of_mentions_lists_only_what_is_asked(spark):
    mentions = few_mentions(spark)
    keys = G.chunk_keys(G.keyed_mentions(mentions))
    graph, rows = G.build_graph(mentions, None), lambda df: sorted(map(str, df.collect()))
    assert rows(graph.nodes) == rows(G.merge_nodes(G.mention_events(keys)).select(*graph.nodes.columns))
    assert rows(graph.edges) == rows(G.merge_edges(G.cooccurrence_events(keys)).select(*graph.edges.columns))
    plan = graph.edges.select("src", "dst", "weight", "edge_ord")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


def test_keys_are_found_once(spark):
    plan = G.chunk_keys(G.keyed_mentions(few_mentions(spark)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("incorporated") == 1


def test_plain_graph_has_the_shape_of_the_whole(spark):
    mentions = few_mentions(spark)
    triplets = spark.createDataFrame([(0, "Ada", "knows", "Bob", "t0"), (1, "Eve", "is", "eve", "t1"), (2, "Eve", "sees", "Ada", "t2")], "triplet_ord long, subject string, predicate string, object string, chunk_id string")
    whole, (seen, plain_) = G.build_graph(mentions, triplets), G.plain_graph(mentions, triplets)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(plain_.edges) == rows(whole.edges.select("src", "dst", "weight")) and rows(plain_.nodes) == rows(whole.nodes.select("id"))
    assert rows(seen.distinct()) == rows(whole.nodes.select("id", F.explode("chunk_ids")))
    assert "collect_list" not in plain_.edges._jdf.queryExecution().optimizedPlan().toString()


def test_hubs_are_exact_above_500_nodes(spark):
    sides = [(f"h{k}", f"leaf{k}_{j}") for k in range(6) for j in range(80 + k)]
    nodes, edges = plain(spark, [*((f"h{k}", "root") for k in range(6)), *sides])
    got = G.hubs(nodes.join(ranking.betweenness(nodes, edges), "id"), 7).collect()
    n = nodes.count()
    behind = {f"h{k}": [1] * (80 + k) + [n - 1 - (80 + k)] for k in range(6)} | {"root": [81 + k for k in range(6)]}
    want = {v: round((sum(b) ** 2 - sum(x * x for x in b)) / (n - 1) / (n - 2), 4) for v, b in behind.items()}
    assert [(r.id, r.betweenness_centrality) for r in got] == sorted(want.items(), key=lambda x: -x[1])


def test_betweenness_in_batches(spark, monkeypatch):
    monkeypatch.setattr(ranking, "WALKED", 40)
    circles = [(f"{c}{k}", f"{c}{(k + 1) % 5}") for c in "pq" for k in range(5)]
    pairs = [*circles, ("p0", "p2"), ("p1", "t"), ("t", "u"), ("t", "v"), ("q3", "w"), ("lone", "pair")]
    nodes, edges = plain(spark, pairs, extra=["alone"])
    want = betweenness_by_hand([r.id for r in nodes.collect()], pairs)
    assert dict(ranking.betweenness(nodes, edges).collect()) == pytest.approx(want, abs=1e-4)


def test_traverse(spark):
    _, edges = plain(spark, [("a", "b"), ("b", "c"), ("c", "d")])
    seeds = spark.createDataFrame([("a",), ("d",), ("nowhere",)], "seed string")
    got = {}
    for r in G.traverse(seeds, edges, 2).collect():
        got.setdefault(r.seed, {})[r.id] = r.hop
    assert got == {"a": {"a": 0, "b": 1, "c": 2}, "d": {"d": 0, "c": 1, "b": 2}, "nowhere": {"nowhere": 0}}


def test_pagerank(spark):
    nodes, edges = plain(spark, [("a", "b"), ("b", "a"), ("c", "a")], extra=["sink"])
    pr = dict(ranking.pagerank(nodes, edges, tolerance=1e-6).collect())
    assert abs(sum(pr.values()) - 1) < 1e-6 and pr["a"] > pr["b"] > pr["c"] == pytest.approx(pr["sink"])
    assert ranking.pagerank(nodes.where("false"), edges.where("false")).count() == 0


def test_fusion(spark):
    rows = [(0, "vector", 1, 0.9), (0, "vector", 2, 0.5), (0, "keyword", 2, 3.0), (0, "graph", 3, 2.0), (0, "graph", 2, 1.0), (1, "vector", 1, -0.5), (2, "graph", 1, 0.0)]
    got = fusion.fuse(spark.createDataFrame(rows, "query_id long, channel string, chunk_ord long, score double")).orderBy("query_id", "rank").collect()
    assert [(r.chunk_ord, r.total) for r in got if r.query_id == 0] == [(1, 0.5), (2, 0.25), (3, 0.25)]
    assert [r.total for r in got if r.query_id > 0] == [0.0, 0.0]
    assert all(0 <= r.total <= 1 for r in got)


def test_node_matches(spark):
    nodes, _ = plain(spark, [("alpha", "alpha beta"), ("gamma", "x")])
    names = spark.createDataFrame([(0, 0, "Alpha"), (0, 1, "Beta"), (0, 2, "Nope"), (0, 3, "ALPHA")], "query_id long, pos int, name string")
    assert sorted((r.id, r.pos) for r in retrieve.match_nodes(names, nodes).collect()) == [("alpha", 0), ("alpha beta", 1)]


def test_triplets_drop_loops_and_duplicates(spark):
    rows = [(1, "A", "is", "B", "c1"), (0, " a", "IS ", "b", "c0"), (2, "A", "has", "B", "c2")]
    got = entities.dedup_triplets(spark.createDataFrame(rows, "triplet_ord long, subject string, predicate string, object string, chunk_id string")).orderBy("triplet_ord").collect()
    assert [(r.triplet_ord, r.chunk_id) for r in got] == [(0, "c0"), (2, "c2")]


def test_vectors(spark):
    unit = spark.range(1).select(vectors.normalise(F.array(F.lit(3.0), F.lit(4.0))).alias("v"), vectors.normalise(F.array(F.lit(0.0))).alias("z")).first()
    assert unit.v == pytest.approx([0.6, 0.8]) and unit.z == [0.0]
    rows = spark.createDataFrame([(2, [1.0, 0.0]), (1, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None)], "chunk_ord long, embedding array<double>")
    asked = spark.createDataFrame([(7, [1.0, 0.5])], "query_id long, embedding array<double>")
    assert [(r.chunk_ord, r.rank) for r in vectors.search(asked, rows, 2).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert vectors.search(asked, rows.where("false")).count() == 0


def test_vector_blocks_hold_few_products(monkeypatch):
    rng = np.random.default_rng(4)
    near, asked = rng.integers(-3, 4, (9_000, 8)).astype(float), rng.integers(-3, 4, (600, 8)).astype(float)
    table = lambda name, x: pa.table({name: pa.array(rng.permutation(len(x))), "x": pa.array(x.tolist())})
    queries, rows = table("query_id", asked), table("chunk_ord", near)
    vectors._block_top(queries.slice(0, 2), rows, 5)
    tracemalloc.start()
    got = vectors._block_top(queries, rows, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 600 * 9_000 * 8  # all products at once
    ids, score = rows.column("chunk_ord").to_numpy(), asked @ near.T
    names = queries.column("query_id").to_numpy()
    want = {(int(names[q]), int(ids[r])) for q in range(600) for r in np.lexsort((ids, -score[q]))[:5]}
    assert set(zip(got.column("query_id").to_pylist(), got.column("chunk_ord").to_pylist(), strict=True)) == want and got.num_rows == 3_000
