"""Connected components of a link table, by repeated contraction. Nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.store import Workspace


def components(work: Workspace, links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b), both longs; root is the smallest node reachable.

    In each round every node goes to its smallest neighbour's choice, links are carried over to the new nodes,
    and those within one node vanish. A hub with very many links is a combining minimum and one side of a join
    whose other side has one row a node, which Spark can split. No links, or only loops and nulls: no rows.
    """
    links = work.keep(links.where("a <> b").select("a", "b").distinct(), "links")
    total = None
    while not links.isEmpty():
        sides = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = work.keep(sides.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("up")), "parent")
        upper = parent.select(F.col("node").alias("up"), F.col("up").alias("root"))
        step = work.keep(parent.join(upper, "up").select("node", "root"), "step")
        if total is None:
            total = step
        else:
            later = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
            total = work.keep(total.join(later, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "total")
        links = work.keep(
            links.join(step.select(F.col("node").alias("a"), F.col("root").alias("x")), "a")
            .join(step.select(F.col("node").alias("b"), F.col("root").alias("y")), "b")
            .where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    empty = work.spark.createDataFrame([], "node long, root long")
    return empty if total is None else total
