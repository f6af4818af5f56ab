"""Connected components of an edge table, and numbers of rows in a total order."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut, in the folder the cluster names."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; a temporary one where none is named and all runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return base or tempfile.mkdtemp(prefix="stowage-")


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``place``, their number from 1 in a total order, without one task holding them all.

    Rows are dealt into ranges of the order and numbered within them; a range begins behind the rows of all before it.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = checkpointed(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_within", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # over one row for each range
    first = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    return ranged.join(F.broadcast(first), "_part").withColumn("place", F.col("_first") + F.col("_within") + 1).drop("_part", "_within", "_first")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of edges (a, b), root being the smallest node that can be reached.

    In each round nodes take the smallest label next to them and then that
    label's own label, so long chains shorten by halves.
    """
    one = edges.select(F.col("a").alias("x"), F.col("b").alias("y"))
    around = one.union(one.select("y", "x")).union(one.select("x", "x")).union(one.select("y", "y")).distinct()
    around = checkpointed(around)
    labels = checkpointed(around.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("root")))
    for _ in range(most_rounds):
        near = around.join(labels, around.y == labels.node).groupBy(F.col("x").alias("node")).agg(F.min("root").alias("near"))
        above = labels.select(F.col("node").alias("near"), F.col("root").alias("above"))
        new = checkpointed(near.join(above, "near").select("node", F.least("near", "above").alias("root")))
        if new.join(labels, ["node", "root"], "left_anti").isEmpty():
            return new
        labels = new
    raise RuntimeError("no end after so many rounds")
