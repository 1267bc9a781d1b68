"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import Scratch


def _roots(parent: DataFrame, tables: Scratch) -> DataFrame:
    """(x, root) with every root its own parent, by jumping to the parent's parent; a chain halves with each round."""
    before = None
    while True:
        total = parent.agg(F.sum(F.col("root").cast("decimal(38,0)"))).first()[0]
        if total == before:
            return parent
        before = total
        above = parent.select(F.col("x").alias("at"), F.col("root").alias("higher"))
        parent = tables.written(parent.join(above, parent["root"] == above["at"], "left").select("x", F.coalesce("higher", "root").alias("root")))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(vertex, component) for every vertex of `links`; component is the least vertex reachable.

    In a round every vertex hooks onto its least neighbour (an aggregate, combined
    before its shuffle), hooks are followed to their roots, and links are renamed
    to roots: those inside a tree fall away, equal ones become one. A group of
    copies is one vertex after a round, so its links are read once. No links give
    an empty table; repeated links and links to oneself change nothing.
    """
    tables = Scratch()
    edges = tables.written(links.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).filter("x < y").distinct())
    labels = None
    while True:
        both = edges.unionAll(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        parent = tables.written(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("root")))
        if labels is None:
            labels = parent.select(F.col("x").alias("vertex"), F.col("x").alias("component"))
        if not parent.head(1):
            return tables.result(labels)
        parent = _roots(parent, tables)
        labels = tables.written(labels.join(parent, labels["component"] == parent["x"], "left").select("vertex", F.coalesce("root", "component").alias("component")))
        left, right = parent.toDF("x", "a"), parent.toDF("y", "b")
        renamed = edges.join(left, "x").join(right, "y").filter("a <> b")
        edges = tables.written(renamed.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct())
