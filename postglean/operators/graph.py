"""Tables cut loose from their lineage, and connected components of links, as joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to ``spark.checkpoint.dir`` and read again: outlives lost executors, and rows don't change between readings."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="postglean-core-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/core-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def connected(links: DataFrame) -> DataFrame:
    """(node, root) of each node of ``links`` (a, b): the least node it reaches. Rounds of minima over neighbours and roots, each stored."""
    both = stored(links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    now = stored(both.groupBy("a").agg(F.least("a", F.min("b")).alias("root")).withColumnRenamed("a", "node"))
    while True:
        around = both.join(now.select(F.col("node").alias("b"), F.col("root").alias("r")), "b").groupBy("a").agg(F.min("r").alias("r"))
        near = now.join(around.withColumnRenamed("a", "node"), "node").select("node", F.col("root").alias("was"), F.least("root", "r").alias("root"))
        up = now.select(F.col("node").alias("root"), F.col("root").alias("above"))
        then = stored(near.join(up, "root").select("node", "was", F.least("root", "above").alias("root")))
        if not then.where("was <> root").limit(1).count():
            return then.select("node", "root")
        now = then.select("node", "root")
