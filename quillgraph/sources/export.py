"""Nodes and edges for a property-graph database."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONNECTOR = "org.neo4j.spark.DataSource"


def _or(df: DataFrame, name: str, default) -> Column:
    default = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.col(name), default) if name in df.columns else default


def export_nodes(nodes: DataFrame) -> DataFrame:
    """``(id, label, etype, btw, deg)``."""
    btw, deg = (F.round(_or(nodes, c, 0.0).cast("double"), 4) for c in ("betweenness_centrality", "degree_centrality"))
    return nodes.select("id", _or(nodes, "label", F.col("id")).alias("label"), _or(nodes, "entity_type", "DEFAULT").alias("etype"), btw.alias("btw"), deg.alias("deg"))


def export_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(src, dst, pred, w)`` of edges whose ends are both nodes; the first predicate only."""
    ids = nodes.select("id")
    plain = edges.select("src", "dst", _or(edges, "predicate", "relates_to").alias("pred"), _or(edges, "weight", 1).cast("long").alias("w"))
    inside = plain.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return inside.select("src", "dst", "pred", "w")


def write_files(nodes: DataFrame, edges: DataFrame, folder: str, form: str = "parquet") -> None:
    """Both tables as files, overwritten."""
    export_nodes(nodes).write.mode("overwrite").format(form).option("header", "true").save(f"{folder}/export_nodes")
    export_edges(edges, nodes).write.mode("overwrite").format(form).option("header", "true").save(f"{folder}/export_edges")


@dataclass(frozen=True)
class Database:
    """Where the graph database is. ``clear`` deletes all that is in it first and is never on by itself."""

    uri: str
    password: str
    user: str = "neo4j"
    name: str = "neo4j"
    clear: bool = False

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Database:
        env = dict(os.environ) if env is None else env
        uri, password = env.get("NEO4J_URI", "").strip(), env.get("NEO4J_PASSWORD", "").strip()
        if not uri or not password:
            raise ValueError("NEO4J_URI and NEO4J_PASSWORD must be set")
        return cls(uri, password, env.get("NEO4J_USERNAME", "neo4j"), env.get("NEO4J_DATABASE", "neo4j"))

    def options(self) -> dict[str, str]:
        return {"url": self.uri, "authentication.basic.username": self.user, "authentication.basic.password": self.password, "database": self.name}


def write_database(nodes: DataFrame, edges: DataFrame, to: Database) -> None:
    """Both tables by the database's Spark connector, which must be on the class path."""
    node_rows, edge_rows = export_nodes(nodes), export_edges(edges, nodes)
    writer = node_rows.write.format(CONNECTOR).options(**to.options()).option("labels", ":Entity").option("node.keys", "id")
    if to.clear:
        writer = writer.option("script", "MATCH (n) DETACH DELETE n")
    writer.mode("Overwrite").save()
    ends = {"relationship": "RELATES_TO", "relationship.save.strategy": "keys", "relationship.source.labels": ":Entity", "relationship.source.node.keys": "src:id", "relationship.target.labels": ":Entity", "relationship.target.node.keys": "dst:id", "relationship.properties": "pred,w"}
    edge_rows.write.format(CONNECTOR).options(**to.options(), **ends).mode("Append").save()
