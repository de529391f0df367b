"""Connected components of links between hashed nodes, by contraction.

Every round hooks each node to its smallest neighbour, jumps a few parents ahead, and replaces the
links by links between what is left. Node ids are hashes, so trees stay shallow and the rounds are
few. All tables stay distributed; each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.store import written

JUMPS = 3


def _renamed(df: DataFrame, parents: DataFrame, column: str) -> DataFrame:
    up = parents.select(F.col("node").alias("_node"), F.col("parent").alias("_parent"))
    return df.join(up, df[column] == up["_node"], "left").withColumn(column, F.coalesce("_parent", column)).drop("_node", "_parent")


def _ordered(links: DataFrame) -> DataFrame:
    return links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node``, ``root`` (smallest node reachable) of every node with a link. ``links`` has longs a and b."""
    links = written(_ordered(links), "links")
    labels = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().withColumn("root", F.col("node"))
    while not links.isEmpty():
        parents = links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent"))
        for _ in range(JUMPS):
            parents = _renamed(parents, parents, "parent")
        parents = written(parents, "parents")
        labels = written(_renamed(labels, parents, "root"), "labels")
        links = written(_ordered(_renamed(_renamed(links, parents, "a"), parents, "b")), "links")
    return labels
