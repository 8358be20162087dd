"""Files to answers, end to end."""

import pytest

from quillgraph.plans import answer, cli, engine
from quillgraph.plans.config import Config
from quillgraph.sources import artifacts, export, files
from quillgraph.streaming import ingest as stream

MD = "# Routing\nOSPF is a Routing protocol. Acme Inc. sells OSPF routers! Does Acme like BGP?\n## Search\nVector search by Acme. BM25 is a keyword method."


@pytest.fixture(scope="module")
def kb(tmp_path_factory):
    d = tmp_path_factory.mktemp("kb")
    (d / "a.md").write_text(MD)
    (d / "B.TXT").write_bytes(b"Plain text on BGP.\n\nIt is \xff old. OSPF is newer.")
    (d / "skip.html").write_text("<p>no</p>")
    (d / "sub").mkdir()
    return d


@pytest.fixture(scope="module")
def built(spark, kb, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("out"))
    engine.ingest(spark, str(kb), folder, 128, 16)
    engine.build_graph(spark, folder)
    engine.build_vectors(spark, folder)
    return folder


def test_sources(spark, kb, tmp_path):
    got = files.read_sources(spark, str(kb)).orderBy("src_ord", "sec_ord").collect()
    assert [r.source_ref for r in got] == ["B.TXT:section:1", "a.md:section:1", "a.md:section:2"]
    assert got[0].text == "Plain text on BGP. It is old. OSPF is newer."
    assert [r.source_ref for r in files.read_sources(spark, str(kb / "a.md")).collect()] == ["a.md:section:1", "a.md:section:2"]
    with pytest.raises(ValueError):
        files.read_sources(spark, str(kb / "skip.html"))
    (tmp_path / "x.html").write_text("x")
    with pytest.raises(FileNotFoundError):
        (tmp_path / "y.html").write_text("y")
        files.read_sources(spark, str(tmp_path))


def test_answers(spark, built):
    config = Config(provider="echo", model="none", max_chunks=3)
    with engine.Retriever(spark, built, config) as r:
        got = r.query("Who sells OSPF routers, Acme?")
        assert "[Context 1 | chunk_" in got["answer"] and "OSPF" in got["context"]
        assert [t["rank"] for t in got["trace"]] == [1, 2, 3] and got["trace"][0]["total"] >= got["trace"][1]["total"]
        assert any(t["graph"] > 0 for t in got["trace"]) and any(t["keyword"] > 0 for t in got["trace"])
        assert got["entities"] == ["Who", "OSPF", "Acme"] and "acme" in got["nodes"] and got["hits"]["vector"] > 0
        few = r.traces(spark.createDataFrame([(0, "Who sells OSPF routers, Acme?")], "query_id long, text string"), 2, 1).first()
        assert few["entities"] == ["Who", "OSPF"] and len(few["nodes"]) == 1
        assert r.counts()["chunks"] == r.chunks.count()
        many = r.retrieve(spark.createDataFrame([(0, "BGP"), (1, "zzz")], "query_id long, text string"))
        assert many.count() == 2


def test_missing_tables(spark, tmp_path, built):
    with pytest.raises(FileNotFoundError):
        engine.Retriever(spark, str(tmp_path), Config(provider="echo"))
    assert artifacts.missing(spark, built) == []
    assert artifacts.read_lexical(spark, str(tmp_path)) is None


def test_config(tmp_path, monkeypatch):
    c = Config.from_env({"TOP_K_VECTOR": "7", "SCORE_WEIGHT_GRAPH": "0.4", "LLM_PROVIDER": "openai"})
    assert c.top_k_vector == 7 and c.weights["graph"] == 0.4 and c.top_k_keyword == 5 and Config.from_env({"RETRIEVAL_TOP_K": "9"}).top_k_vector == 9
    for bad in (c, Config(provider="none"), Config(model=" ")):
        with pytest.raises(ValueError):
            bad.checked()
    assert answer.call("x", Config(provider="ollama", env={"OLLAMA_HOST": "http://127.0.0.1:9"})).startswith("[Error calling LLM: ")
    monkeypatch.chdir(tmp_path)
    (tmp_path / ".env").write_text("# c\nMAX_HOPS='3'\n")
    assert Config.from_env().max_hops == 3


def test_export(spark, built, tmp_path):
    graph = artifacts.read_graph(spark, built)
    export.write_files(graph.nodes, graph.edges, str(tmp_path), "csv")
    assert spark.read.option("header", "true").csv(f"{tmp_path}/export_nodes").columns == ["id", "label", "etype", "btw", "deg"]
    assert export.export_edges(graph.edges, graph.nodes.where("id <> 'acme'")).where("src = 'acme' or dst = 'acme'").count() == 0
    with pytest.raises(ValueError):
        export.Database.from_env({})
    assert export.Database.from_env({"NEO4J_URI": "bolt://x", "NEO4J_PASSWORD": "p"}).clear is False


def test_cli(spark, kb, tmp_path, capsys):
    out = ["--folder", str(tmp_path / "o")]
    assert cli.main([*out, "ingest", "--input", str(kb / "a.md")]) == 0
    assert cli.main([*out, "graph", "--show", "--bfs_demo", "Acme"]) == 0
    assert cli.main([*out, "vectors", "--query", "OSPF"]) == 0
    assert cli.main([*out, "ask", "Acme?", "--provider", "echo"]) == 0
    assert cli.main([*out, "export", "--to", str(tmp_path / "e")]) == 0
    assert cli.main([*out, "ask", "x", "--provider", "nobody"]) == 1
    assert cli.main(["--folder", str(tmp_path / "none"), "ask", "x", "--provider", "echo"]) == 1


def test_loop(spark, built, monkeypatch, capsys):
    lines = iter(["Acme and OSPF?", ""])
    monkeypatch.setattr("builtins.input", lambda _: next(lines))
    assert cli.main(["--folder", built, "ask", "--provider", "echo"]) == 0
    said = capsys.readouterr().out
    assert "chunks" in said.splitlines()[0] and "entities: Acme, OSPF" in said and "hits: " in said
    cli._tell({"answer": "a", "entities": [f"e{k}" for k in range(12)], "nodes": [], "hits": {}, "trace": []})
    assert "e9 and 2 more" in capsys.readouterr().out


def test_stream(spark, tmp_path):
    src, out, state = (tmp_path / x for x in ("in", "out", "state"))
    src.mkdir()
    (src / "a.md").write_text(MD)
    stream.watch(spark, str(src), str(out), str(state), once=True).awaitTermination(120)
    (src / "b.txt").write_text("More text. And more.")
    stream.watch(spark, str(src), str(out), str(state), once=True).awaitTermination(120)
    got = spark.read.parquet(str(out))
    assert {r.source_ref for r in got.collect()} == {"a.md:section:1", "a.md:section:2", "b.txt:section:1"}
