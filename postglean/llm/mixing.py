"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is due ``target / source_size`` copies: a whole
number and a fraction. Documents meet in pairs; words move between the two at
random, so that each keeps its expected share, until the fraction of one is 0
or 1. The other goes on to the next pair. Groups of some documents are folded
this way and leave one residual each; residuals are grouped and folded again,
up a tree, until each source has one, which is rounded.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
FAN_IN = 64
SEED = 20


def word_count(text: str = "text") -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Per source of ``sizes`` (source, size): n, source_size, target.

    Sources by code point, null last, have the weights in turn and share
    ``share`` of all words. Where that would exceed ``most`` times a source, it
    stops there and the excess is reshared by weight, until none is above: a
    target is the lesser of the bound and weight times a level, and the level
    rises with each round that bounds more sources. Sources are sorted in
    ranges and numbered by counts of the ranges before, so no task has them all.
    """
    spark = sizes.sparkSession
    by = sizes.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    order = [F.col("source").isNull(), F.col("source")]
    ranged = by.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    ranged = written(ranged.withColumn("seq", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("seq", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = ranged.groupBy(part.alias("part")).agg(F.count("*").alias("k")).select("part", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("start"))
    place = F.col("start") + F.col("seq") - F.shiftleft("part", 33)
    by = ranged.withColumn("part", part).join(starts, "part").withColumn("place", place)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    by = by.select("source", "n", "source_size", weight.cast("double").alias("weight"), (F.col("source_size") * most).cast("double").alias("bound"))
    total = (by.agg(F.sum("source_size")).first()[0] or 0) * share
    bounded, level = -1, 0.0
    while True:
        over = F.col("bound") <= F.col("weight") * level
        now, taken, open_ = by.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, F.col("bound"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0))).first()
        if now == bounded or not open_:
            break
        bounded, level = now, (total - taken) / open_
    target = F.when(F.col("bound") <= F.col("weight") * level, F.col("bound")).otherwise(F.col("weight") * level)
    return by.select("source", "n", "source_size", target.alias("target"))


def _told_apart(sizes: DataFrame) -> DataFrame:
    """``sizes`` with rows of one key numbered and the number made part of the key, so that any number of equal rows part in the tree.

    A row's number is its place in its task plus what earlier tasks have of the key.
    """
    sizes = written(sizes.withColumn("part", F.spark_partition_id()), "rows")
    own = F.row_number().over(Window.partitionBy("key", "part").orderBy("carry"))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a task
    starts = sizes.groupBy("key", "part").agg(F.count("*").alias("k")).withColumn("start", F.coalesce(F.sum("k").over(before), F.lit(0)))
    told = sizes.withColumn("own", own).join(starts.select("key", "part", "start"), ["key", "part"])
    return told.withColumn("key", F.xxhash64("key", F.col("start") + F.col("own"))).drop("part", "own", "start")


def _meet(state: Column, b: Column, seed: int) -> Column:
    """The fold's step: the open document of ``state`` meets ``b``."""
    a = state["open"]
    size_a, size_b = a["size"].cast("double"), b["size"].cast("double")
    up, down = F.least((1 - a["p"]) * size_a, b["p"] * size_b), F.least(a["p"] * size_a, (1 - b["p"]) * size_b)
    chance = F.pmod(F.xxhash64(F.lit(seed), a["key"], b["key"]), F.lit(1 << 52)) / float(1 << 52)
    to_a = chance * (up + down) < down
    whole_a = F.when(to_a, (1 - a["p"]) * size_a <= b["p"] * size_b).otherwise(a["p"] * size_a <= (1 - b["p"]) * size_b)
    moved = F.when(to_a, up).otherwise(-down)
    # what is settled has the fraction 1 if the words went to it, else 0
    settled = F.when(whole_a, a.withField("p", F.when(to_a, 1.0).otherwise(0.0))).otherwise(b.withField("p", F.when(to_a, 0.0).otherwise(1.0)))
    left = F.when(whole_a, b.withField("p", F.greatest(F.lit(0.0), F.least(F.lit(1.0), b["p"] - moved / size_b)))).otherwise(a.withField("p", F.greatest(F.lit(0.0), F.least(F.lit(1.0), a["p"] + moved / size_a))))
    return F.when(a.isNull(), F.struct(b.alias("open"), state["done"].alias("done"))).otherwise(F.struct(left.alias("open"), F.array_append(state["done"], settled).alias("done")))


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED, carry: str = "doc_id") -> DataFrame:
    """How many copies of each row of ``docs`` (doc_id, text, source, ``carry``) the mix takes.

    Returns ``carry``, size, source, source_size, target, copies, taken, one row
    for each of ``docs``. Null texts and texts without words have size 0 and no
    copies; a null source is a source, the last. Each source's taken words
    differ from its target by half its last open document at most. Choices
    depend on (doc_id, text) and ``seed`` alone, so reruns agree; rows equal in
    both are interchangeable. Very long texts count whole. Other columns are
    left out, whatever their names. An empty table gives no rows.
    """
    sizes = docs.select(F.col(carry).alias("carry"), "source", word_count().alias("size"), F.xxhash64("doc_id", "text").alias("key"))
    sizes = written(_told_apart(sizes), "sizes")
    targets = written(source_targets(sizes, weights, share, most), "targets")
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = sizes.withColumnRenamed("source", "s").join(targets, F.col("s").eqNullSafe(F.col("source"))).drop("s")
    rows = rows.withColumn("copies", F.when(F.col("size") > 0, F.floor(due)).otherwise(0)).withColumn("p", F.when(F.col("size") > 0, due - F.floor(due)).otherwise(0.0))
    key = ["source", "source_size", "target"]
    doc = F.struct("size", "key", "carry", "copies", "p")
    settled = [rows.where("p = 0").select(*key, doc.alias("doc"))]
    open_ = rows.where("p > 0").select(*key, F.ceil(F.col("n") / FAN_IN).alias("groups"), doc.alias("doc"))
    most_groups = targets.agg(F.ceil(F.max("n") / FAN_IN)).first()[0] or 0
    level = 0
    while most_groups:
        group = F.pmod(F.xxhash64(F.lit(seed + level), "doc.key"), F.col("groups")).alias("group")
        kind = open_.schema["doc"].dataType.simpleString()
        start = F.struct(F.lit(None).cast(kind).alias("open"), F.array().cast(f"array<{kind}>").alias("done"))
        folded = F.aggregate(F.sort_array(F.collect_list("doc")), start, lambda s, b: _meet(s, b, seed))
        open_ = open_.groupBy(*key, "groups", group).agg(folded.alias("f"))
        open_ = written(open_.select(*key, "groups", "f.open", "f.done"), f"level{level}")
        settled.append(open_.select(*key, F.explode("done").alias("doc")))
        open_ = open_.where("open is not null").select(*key, F.ceil(F.col("groups") / FAN_IN).alias("groups"), F.col("open").alias("doc"))
        most_groups = -(-most_groups // FAN_IN) if most_groups > 1 else 0
        level += 1
    settled.append(open_.select(*key, "doc"))
    out = reduce(DataFrame.unionAll, settled)
    copies = (F.col("doc.copies") + F.when(F.col("doc.p") >= 0.5, 1).otherwise(0)).cast("int")
    out = out.select(F.col("doc.carry").alias(carry), F.col("doc.size").alias("size"), *key, copies.alias("copies"))
    return out.withColumn("taken", F.col("size") * F.col("copies"))
