"""The property graph: nodes and edges from mentions and triplets, degrees, bounded traversal."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.functions.fixed import CO_OCCURS, CO_TYPE, FACT_TYPE


@dataclass
class Graph:
    """``nodes(id, label, entity_type, color, chunk_ids, node_ord)`` and ``edges(src, dst, predicate, predicates, relation_types, chunk_ids, weight, edge_ord)``."""

    nodes: DataFrame
    edges: DataFrame


def keyed_mentions(mentions: DataFrame, key: Column | None = None) -> DataFrame:
    """Mentions with their node ``key`` (exact signatures unless a resolution gives another), without empty keys."""
    # dealt out by chunk first, as a small file has few tasks and what follows goes by chunks
    named = mentions.repartition("chunk_ord")
    if key is None:
        # an explosion of one, so that Spark doesn't push the filter below the signature and find it twice
        named = named.withColumn("sig", F.explode(F.array(T.signature(F.col("text")))))
        key = F.when(F.col("sig") == "", T.node_key(F.col("text"))).otherwise(F.col("sig"))
    named = named.withColumn("key", key)
    return named.where("key <> ''").withColumn("kind", T.entity_type(F.col("label"))).drop("sig")


def type_lookup(keyed: DataFrame) -> DataFrame:
    """``(key, entity_type)``: the type of the last mention of each key in the corpus."""
    return keyed.groupBy("key").agg(F.max_by("kind", F.struct("chunk_ord", "ent_pos")).alias("entity_type"))


def chunk_keys(keyed: DataFrame) -> DataFrame:
    """The first mention of each key in each chunk."""
    first = F.min_by(F.struct("ent_pos", "text", "kind"), "ent_pos").alias("m")
    return keyed.groupBy("chunk_ord", "key").agg(first).select("chunk_ord", "key", "m.ent_pos", "m.text", "m.kind")


def _in_order(field: str) -> Column:
    """Distinct values of a field of the sorted array ``seen``, in order of first sight."""
    return F.array_distinct(F.transform("seen", lambda x: x[field]))


def merge_nodes(events: DataFrame) -> DataFrame:
    """``events(at, key, text, kind, chunk_id)`` → nodes: first label, first type that isn't the default, distinct chunks in order, and the order of first sight.

    Events are read once: first by node and chunk, which pre-aggregates, then by node.
    """
    typed = F.when(F.col("kind") != T.DEFAULT_TYPE, F.col("at"))
    each = events.groupBy("key", "chunk_id").agg(F.min("at").alias("at"), F.min_by("text", "at").alias("text"), F.min_by("kind", typed).alias("kind"), F.min(typed).alias("kind_at"))
    kind = F.coalesce(F.min_by("kind", "kind_at"), F.lit(T.DEFAULT_TYPE))
    seen = F.array_sort(F.collect_list(F.struct("at", "chunk_id")))
    one = each.groupBy("key").agg(F.min_by("text", "at").alias("label"), kind.alias("entity_type"), seen.alias("seen"), F.min("at").alias("node_ord"))
    return one.select(F.col("key").alias("id"), "label", "entity_type", T.colour(F.col("entity_type")).alias("color"), _in_order("chunk_id").alias("chunk_ids"), "node_ord")


def merge_edges(events: DataFrame) -> DataFrame:
    """``events(at, src, dst, predicate, relation_type, chunk_id)`` → one edge for each ordered pair; its weight is its number of events. No loops.

    Events are read once: first by edge and chunk, which pre-aggregates, then by edge.
    """
    by = ["src", "dst"]
    each = events.where("src <> dst").groupBy(*by, "predicate", "relation_type", "chunk_id").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    seen = F.array_sort(F.collect_list(F.struct("at", "predicate", "relation_type", "chunk_id")))
    one = each.groupBy(*by).agg(F.sum("n").alias("weight"), seen.alias("seen"))
    lists = [_in_order(value).alias(name) for value, name in (("predicate", "predicates"), ("relation_type", "relation_types"), ("chunk_id", "chunk_ids"))]
    first = F.get("seen", F.lit(0))
    return one.select(*by, first["predicate"].alias("predicate"), *lists, "weight", first["at"].alias("edge_ord"))


def _at(phase: int, *parts: str) -> Column:
    return F.struct(F.lit(phase).alias("phase"), *(F.col(p).cast("long").alias(f"o{k}") for k, p in enumerate(parts)), *(F.lit(0).cast("long").alias(f"o{k}") for k in range(len(parts), 3)))


def mention_events(keys: DataFrame) -> DataFrame:
    return keys.select(_at(0, "chunk_ord", "ent_pos").alias("at"), "key", "text", "kind", T.chunk_id(F.col("chunk_ord")).alias("chunk_id"))


def _pairs(keys: DataFrame) -> DataFrame:
    """Each pair of keys in a chunk once: ``(chunk_ord, x, y, lo, hi, flip)``, ``x`` before ``y`` in the alphabet, by their places ``lo`` and ``hi``.

    Chunks are short, so a chunk's pairs are few, whatever the corpus's size.
    """
    x = keys.select("chunk_ord", F.col("key").alias("x"), F.col("ent_pos").alias("a"))
    y = keys.select("chunk_ord", F.col("key").alias("y"), F.col("ent_pos").alias("b"))
    found = x.join(y, "chunk_ord").where("x < y")
    return found.select("chunk_ord", "x", "y", F.least("a", "b").cast("long").alias("lo"), F.greatest("a", "b").cast("long").alias("hi"), (F.col("a") > F.col("b")).cast("long").alias("flip"))


def _both_ways(pairs: DataFrame, *more: str) -> DataFrame:
    """``pairs(x, y, chunk_ord, lo, hi, flip)`` as edges in both directions with the order ``at`` of their events."""
    ways = F.explode(F.array(*(F.struct(F.col(s).alias("src"), F.col(d).alias("dst"), f.alias("flip")) for s, d, f in (("x", "y", F.col("flip")), ("y", "x", 1 - F.col("flip")))))).alias("way")
    each = pairs.select("chunk_ord", "lo", "hi", *more, ways).select("chunk_ord", "lo", (F.col("hi") * 2 + F.col("way.flip")).alias("hi"), *more, "way.src", "way.dst")
    return each.select(_at(0, "chunk_ord", "lo", "hi").alias("at"), "chunk_ord", "src", "dst", *more)


def cooccurrence_events(keys: DataFrame) -> DataFrame:
    """Both directions of each pair of keys in a chunk."""
    return _both_ways(_pairs(keys)).select("at", "src", "dst", F.lit(CO_OCCURS).alias("predicate"), F.lit(CO_TYPE).alias("relation_type"), T.chunk_id(F.col("chunk_ord")).alias("chunk_id"))


def mention_nodes(keys: DataFrame) -> DataFrame:
    """``merge_nodes`` for mentions alone, where a key has one event in a chunk: chunks are listed and sorted as numbers."""
    at = F.struct("chunk_ord", "ent_pos")
    kind = F.coalesce(F.min_by("kind", F.when(F.col("kind") != T.DEFAULT_TYPE, at)), F.lit(T.DEFAULT_TYPE))
    one = keys.groupBy("key").agg(F.min_by("text", at).alias("label"), kind.alias("entity_type"), F.sort_array(F.collect_list("chunk_ord")).alias("seen"), F.min(at).alias("first"))
    one = one.select("*", F.col("first.chunk_ord").alias("o"), F.col("first.ent_pos").alias("p"))
    return one.select(F.col("key").alias("id"), "label", "entity_type", T.colour(F.col("entity_type")).alias("color"), F.transform("seen", T.chunk_id).alias("chunk_ids"), _at(0, "o", "p").alias("node_ord"))


def mention_edges(keys: DataFrame) -> DataFrame:
    """``merge_edges`` for mentions alone: pairs are counted once for both directions, and only the lists that are asked for are made."""
    one = _pairs(keys).groupBy("x", "y").agg(F.count("*").alias("weight"), F.min(F.struct("chunk_ord", "lo", "hi", "flip")).alias("first"), F.sort_array(F.collect_list("chunk_ord")).alias("seen"))
    edges = _both_ways(one.select("x", "y", "first.*", "weight", "seen"), "weight", "seen")
    predicate = F.lit(CO_OCCURS)
    lists = [F.array(predicate).alias("predicates"), F.array(F.lit(CO_TYPE)).alias("relation_types"), F.transform("seen", T.chunk_id).alias("chunk_ids")]
    return edges.select("src", "dst", predicate.alias("predicate"), *lists, "weight", F.col("at").alias("edge_ord"))


def triplet_events(triplets: DataFrame, lookup: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Node and edge events of ``triplets(triplet_ord, subject, predicate, object, chunk_id)``; types from the lookup, else the default."""
    keyed = triplets.withColumn("src", T.canonical(F.col("subject"))).withColumn("dst", T.canonical(F.col("object")))
    ends = keyed.select("triplet_ord", "chunk_id", F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("src").alias("key"), F.col("subject").alias("text")), F.struct(F.lit(1).alias("end"), F.col("dst").alias("key"), F.col("object").alias("text")))).alias("e"))
    ends = ends.select("triplet_ord", "chunk_id", "e.end", "e.key", "e.text")
    if lookup is None:
        ends = ends.withColumn("kind", F.lit(T.DEFAULT_TYPE))
    else:
        ends = ends.join(lookup.withColumnRenamed("entity_type", "kind"), "key", "left").withColumn("kind", F.coalesce("kind", F.lit(T.DEFAULT_TYPE)))
    nodes = ends.select(_at(1, "triplet_ord", "end").alias("at"), "key", "text", "kind", "chunk_id")
    edges = keyed.select(_at(1, "triplet_ord").alias("at"), "src", "dst", F.trim("predicate").alias("predicate"), F.lit(FACT_TYPE).alias("relation_type"), "chunk_id")
    return nodes, edges


def build_graph(mentions: DataFrame | None, triplets: DataFrame | None, key: Column | None = None) -> Graph:
    """Mentions first, in order of chunks, then triplets: one pass of events for nodes and one for edges."""
    nodes, edges, lookup = [], [], None
    if mentions is not None:
        keyed = keyed_mentions(mentions, key)
        lookup, keys = type_lookup(keyed), chunk_keys(keyed)
        nodes.append(mention_events(keys))
        edges.append(cooccurrence_events(keys))
        if triplets is None:
            return Graph(mention_nodes(keys), mention_edges(keys))
    if triplets is not None:
        n, e = triplet_events(triplets, lookup)
        nodes.append(n)
        edges.append(e)
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return Graph(merge_nodes(union(nodes)), merge_edges(union(edges)))


def plain_graph(mentions: DataFrame, triplets: DataFrame) -> tuple[DataFrame, Graph]:
    """``(seen(id, chunk_id), Graph(nodes(id), edges(src, dst, weight)))`` of ``build_graph``, without labels, types and lists, for what needs the shape alone."""
    keys = chunk_keys(keyed_mentions(mentions))
    n, e = triplet_events(triplets)
    seen = keys.select(F.col("key").alias("id"), T.chunk_id(F.col("chunk_ord")).alias("chunk_id")).union(n.select("key", "chunk_id"))
    events = _both_ways(_pairs(keys)).select("src", "dst").union(e.select("src", "dst")).where("src <> dst")
    return seen, Graph(seen.select("id").distinct(), events.groupBy("src", "dst").agg(F.count("*").alias("weight")))


def undirected(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def degrees(graph: Graph) -> DataFrame:
    """``(id, degree_centrality, in_degree, out_degree)`` of every node; centrality counts neighbours once, over n - 1."""
    pairs = undirected(graph.edges)
    near = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("near"))
    in_ = graph.edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))
    out = graph.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))
    n = graph.nodes.agg(F.count("*").alias("n"))
    all_ = graph.nodes.select("id").join(near, "id", "left").join(in_, "id", "left").join(out, "id", "left").join(F.broadcast(n), F.lit(True))
    none = F.lit(0).cast("long")
    share = F.when(F.col("n") <= 1, F.lit(1.0)).otherwise(F.coalesce("near", none) / F.nullif(F.col("n") - 1, F.lit(0)))
    return all_.select("id", F.round(share, 4).alias("degree_centrality"), F.coalesce("in_degree", none).alias("in_degree"), F.coalesce("out_degree", none).alias("out_degree"))


def traverse(starts: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """``starts(seed)`` → ``(seed, id, hop)``: nodes within ``hops`` edges of each seed, whatever their direction.

    One join a hop of the frontier with the edges both ways; a node is kept at the
    hop that reaches it first.
    """
    both = edges.select(F.col("src").alias("at"), F.col("dst").alias("id")).union(edges.select(F.col("dst"), F.col("src"))).distinct()
    seen = starts.select("seed", F.col("seed").alias("id"), F.lit(0).alias("hop")).distinct()
    front = seen
    for hop in range(1, hops + 1):
        step = front.select("seed", F.col("id").alias("at")).join(both, "at").select("seed", "id").distinct()
        front = step.join(seen.select("seed", "id"), ["seed", "id"], "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.union(front)
    return seen


def chunks_of(traversed: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(seed, chunk_id)``: distinct chunks of the nodes that a traversal reached."""
    return traversed.join(nodes.select("id", "chunk_ids"), "id").select("seed", F.explode("chunk_ids").alias("chunk_id")).distinct()


def hubs(nodes: DataFrame, n: int = 10) -> DataFrame:
    """The nodes with the greatest betweenness, then those seen first."""
    return nodes.orderBy(F.desc("betweenness_centrality"), "node_ord").limit(n)


def number_nodes(nodes: DataFrame) -> DataFrame:
    """Order of first sight as whole numbers from 1, in two levels so that no task sorts all nodes."""
    phases = nodes.groupBy("node_ord.phase", "node_ord.o0").agg(F.count("*").alias("n"))
    blocks = phases.withColumn("blk", F.struct(F.col("phase"), F.floor(F.col("o0") / 65_536).alias("b")))
    per = blocks.groupBy("blk").agg(F.sum("n").alias("m"))
    per = per.withColumn("base", F.sum("m").over(Window.orderBy("blk").rowsBetween(Window.unboundedPreceding, 0)) - F.col("m"))
    own = nodes.withColumn("blk", F.struct(F.col("node_ord.phase").alias("phase"), F.floor(F.col("node_ord.o0") / 65_536).alias("b"))).join(per.select("blk", "base"), "blk")
    rank = F.row_number().over(Window.partitionBy("blk").orderBy("node_ord", "id"))
    return own.withColumn("node_ord", (F.col("base") + rank).cast("long")).drop("blk", "base")
