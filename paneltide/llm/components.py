"""Connected components of an undirected graph by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): each node that has a link, with the smallest node that it reaches.

    In a round every node hangs itself on its smallest neighbour, the trees are flattened by pointer jumping, and links
    are renamed to their ends' roots; links within a tree fall away. Dense groups so lose nearly all links in the first
    round, and at least half of the remaining trees merge in each, so links are joined a few times and not once for each
    step of a path. All tables are written to the shared checkpoint folder, so a lost executor costs a step at most; as
    Parquet, whose size is known: a checkpoint keeps the size that its plan estimates, and joins multiply estimates, so
    that over some tens of steps the digits of that number alone fill the driver. Both sides of each join are plain
    shuffles, which Spark can split where a node has very many neighbours. Nothing but counts comes to the driver.

    Links with a null end are left out, and links that repeat count once; without links the result is empty.
    """
    edges = written(links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b"))
    labels = None
    while True:
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        tree = written(both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("root")))
        while True:
            up = tree.select(F.col("node").alias("root"), F.col("root").alias("above"))
            step = written(tree.join(up, "root").select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")))
            tree = step.select("node", "root")
            if not step.where("moved").limit(1).count():
                break
        if labels is None:
            labels = tree.select("node", F.col("root").alias("label"))
        else:
            by = tree.select(F.col("node").alias("label"), "root")
            labels = written(labels.join(by, "label", "left").select("node", F.coalesce("root", "label").alias("label")))
        ends = edges.join(tree.select(F.col("node").alias("a"), F.col("root").alias("x")), "a").join(tree.select(F.col("node").alias("b"), F.col("root").alias("y")), "b")
        edges = written(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        if not edges.limit(1).count():
            return labels
