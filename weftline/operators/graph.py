"""Tool and entity graphs as edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import materialize


def neighbours(edges: DataFrame, a: str = "source", b: str = "target") -> DataFrame:
    """node, neighbour of the undirected graph."""
    one = edges.select(F.col(a).alias("node"), F.col(b).alias("neighbour"))
    return one.unionByName(edges.select(F.col(b).alias("node"), F.col(a).alias("neighbour"))).distinct()


def simple_paths(edges: DataFrame, least: int = 2, most: int = 5) -> DataFrame:
    """All simple paths of least to most nodes from a node without incoming edges (or any, if there
    is none) to one without outgoing edges (or any). Tool graphs are small; each step is a join."""
    links = materialize(edges.select("source", "target").distinct(), "links")
    sources, targets = links.select(F.col("source").alias("node")).distinct(), links.select(F.col("target").alias("node")).distinct()
    nodes = sources.unionByName(targets).distinct()
    starts, ends = nodes.join(targets, "node", "left_anti"), nodes.join(sources, "node", "left_anti")
    starts = nodes if starts.isEmpty() else starts
    ends = nodes if ends.isEmpty() else ends
    at = starts.select(F.array("node").alias("path"), F.col("node").alias("last"))
    found = None
    for size in range(2, most + 1):
        at = at.join(links, at["last"] == links["source"]).filter(~F.array_contains("path", F.col("target"))).select(F.concat("path", F.array("target")).alias("path"), F.col("target").alias("last"))
        if size >= least:
            done = at.join(ends, at["last"] == ends["node"], "left_semi").select("path")
            found = done if found is None else found.unionByName(done)
    return found


def transition_graph(calls: DataFrame, key: str, tool: str, order: list[str]) -> DataFrame:
    """source, target, n: all transitions between different tools, with how often they occur."""
    from pyspark.sql import Window

    step = calls.select(F.lag(tool).over(Window.partitionBy(key).orderBy(*order)).alias("source"), F.col(tool).alias("target"))
    return step.filter("source is not null and source <> target").groupBy("source", "target").agg(F.count("*").alias("n"))


def tool_graph(nodes: DataFrame, links: DataFrame, functions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) held to the server's functions: unknown nodes and their links go, functions without
    a node get one."""
    names = functions.select(F.col("name").alias("node")).distinct()
    kept = links
    for end in ("source", "target"):
        kept = kept.join(names.select(F.col("node").alias(end)), end, "left_semi")
    return nodes.select("node").join(names, "node", "left_semi").unionByName(names.join(nodes.select("node"), "node", "left_anti")), kept


def entity_edges(blueprints: DataFrame, hub: str = "Person") -> DataFrame:
    """source, target: the hub with every other entity of a blueprint that has it."""
    everyone = F.array_distinct(F.concat(F.array("core_entity"), F.coalesce("peripheral_entities", F.array().cast("array<string>"))))
    rows = blueprints.select(everyone.alias("entities")).filter(F.array_contains("entities", hub))
    return rows.select(F.lit(hub).alias("source"), F.explode("entities").alias("target")).filter(F.col("target") != hub).distinct()


def entities_of(edges: DataFrame, hub: str = "Person") -> DataFrame:
    return neighbours(edges).filter(F.col("node") == hub).select(F.col("neighbour").alias("entity"))
