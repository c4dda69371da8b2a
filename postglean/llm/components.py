"""Connected components of links between rows, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clear_scratch, made_since, scratch_tables, written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of ``links`` (a, b): the smallest node it reaches.

    Each round a node takes the least root among its neighbours' and its own,
    then its root's root, so long chains halve. Rounds end when nothing
    changes; each is written to the shared folder, and what it came from is
    deleted. Minima are partial before they move, so a node with very many links
    is no burden to one task.
    """
    both = written(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    roots = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root"))
    changed, start = 1, scratch_tables()
    while changed:
        before = written(roots, "roots")
        seen = both.join(before.select(F.col("node").alias("b"), F.col("root").alias("r")), "b").groupBy("a").agg(F.min("r").alias("r"))
        near = before.join(seen.select(F.col("a").alias("node"), "r"), "node").select("node", F.col("root").alias("was"), F.least("root", "r").alias("root"))
        near = written(near, "near")
        jump = near.select(F.col("node").alias("root"), F.col("root").alias("far"))
        roots = written(near.join(jump, "root", "left").select("node", "was", F.least("root", F.coalesce("far", "root")).alias("root")), "jumped")
        changed = roots.where("root <> was").limit(1).count()
        roots = roots.select("node", "root")
        clear_scratch(links.sparkSession, made_since(start)[:-1])
    return roots
