"""Points on the map."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import stored


def on_map(jobs: DataFrame, points: DataFrame) -> DataFrame:
    """Jobs with their points; points that aren't finite or lie outside the globe count for nothing."""
    sound = F.col("lat").between(-90, 90) & F.col("lng").between(-180, 180) & ~F.isnan("lat") & ~F.isnan("lng")
    return jobs.join(points.where(sound), "id")


def place_summary(rows: DataFrame) -> DataFrame:
    """Per cluster of ``rows`` (cluster, at, row_id, score, location, lat, lng): best score, roles, whether it is one stack, and its place's name.

    Roles are the groups of listings that its members belong to. A stack has one
    coordinate to four decimals. The place is the location's first part that most
    members have, the first to appear if several have as many, and is only near
    it if less than 60 % do.
    """
    name = F.coalesce(F.nullif(F.btrim(F.element_at(F.split("location", ","), 1)), F.lit("")), F.lit("this location"))
    at = rows.withColumn("name", name).withColumn("spot", F.format_string("%.4f,%.4f", "lng", "lat"))
    whole = at.groupBy("cluster").agg(F.max("score").alias("best"), F.count_distinct("row_id").alias("roles"), (F.count_distinct("spot") == 1).alias("is_stack"), F.count("*").alias("members"))
    names = at.groupBy("cluster", "name").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    most = names.groupBy("cluster").agg(F.max_by(F.struct("name", "n"), F.struct("n", (-F.col("first")).alias("first"))).alias("m"))
    place = F.when(F.col("m.n") / F.col("members") < 0.6, F.concat(F.lit("Near "), F.col("m.name"))).otherwise(F.col("m.name"))
    return whole.join(most, "cluster").select("cluster", "best", "roles", "is_stack", "members", place.alias("place"))


def thinned(points: DataFrame, selected: str | None = None, most: int = 5000) -> DataFrame:
    """At most ``most`` of ``points`` (id, at): every point if there are no more, else the selected one and every so many by place.

    Places are counted over sorted ranges, so no task sees all points; the
    number of points and the ranges' counts are all that is collected.
    """
    spark = points.sparkSession
    ranged = stored(points.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "at", "id").sortWithinPartitions("at", "id").withColumn("seq", F.monotonically_increasing_id()))
    part = F.shiftright("seq", 33)
    counts = {r.part: r.n for r in ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    n = sum(counts.values())
    if n <= most:
        return ranged.drop("seq")
    starts, before = {}, 0
    for k in sorted(counts):
        starts[k], before = before, before + counts[k]
    start = F.element_at(F.create_map(*[F.lit(v) for kv in starts.items() for v in kv]), part)
    place = start + F.col("seq") - F.shiftleft(part, 33)
    chosen = F.col("id").eqNullSafe(F.lit(selected)) if selected is not None else F.lit(False)
    stride = -(-n // (most - 1))
    rows = ranged.withColumn("place", place).where(chosen | (F.col("place") % stride == 0)).orderBy(chosen.desc(), "place").limit(most)
    return rows.drop("seq", "place")


def score_band(score: str) -> Column:
    """The map's bands."""
    s = F.col(score)
    return F.when(s.isNull(), "Unscored").when(s >= 80, "80–100").when(s >= 60, "60–79").otherwise("Below 60")


def in_viewport(points: DataFrame, width: float, height: float) -> DataFrame:
    """Points (id, alive, x, y: on screen, lng, lat, back_lng, back_lat: unprojected) that are on screen and on the near side of the globe."""
    if not (width > 0 and height > 0):
        return points.where(F.lit(False)).select("id")
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    on_screen = finite("x") & finite("y") & F.col("x").between(0, width) & F.col("y").between(0, height)
    near = F.abs((F.col("back_lng") - F.col("lng") + 540) % 360 - 180) <= 0.01
    same = finite("back_lng") & finite("back_lat") & near & (F.abs(F.col("back_lat") - F.col("lat")) <= 0.01)
    return points.where(~F.col("alive").eqNullSafe(F.lit(False)) & on_screen & same).select("id")


def _screen_clusters(table: pa.Table) -> pa.Table:
    """Points of one view in order: each joins the first cluster of the nine cells around it whose anchor is within the radius."""
    table = table.sort_by("at")
    radius, cells, out = table["radius"][0].as_py() if len(table) else 1.0, {}, []
    for id_, x, y in zip(*(table[c].to_pylist() for c in ("id", "x", "y"))):
        at = math.floor(x / radius), math.floor(y / radius)
        around = (spot for dx in (-1, 0, 1) for dy in (-1, 0, 1) for spot in cells.get((at[0] + dx, at[1] + dy), ()))
        home = next((anchor for ax, ay, anchor in around if math.hypot(ax - x, ay - y) < radius), None)
        if home is None:
            cells.setdefault(at, []).append((x, y, id_))
        out.append(id_ if home is None else home)
    return pa.table({"view": table["view"], "id": table["id"], "cluster": pa.array(out, table["id"].type)})


def screen_clusters(points: DataFrame, radius: float = 32.0) -> DataFrame:
    """(view, id, cluster) of ``points`` (view, id, at, x, y): greedy clusters on each viewer's screen, named by their first point.

    A view holds at most what ``thinned`` leaves, so a task's group is bounded.
    """
    finite = F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y") & (F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))
    rows = points.where(finite).select("view", "id", "at", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.lit(radius).alias("radius"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.groupBy("view").applyInArrow(_screen_clusters, f"view {rows.schema['view'].dataType.simpleString()}, id {kind}, cluster {kind}")


def longitude_delta(a: Column, b: Column) -> Column:
    """Shortest way round from a to b, -180 to 180."""
    return F.pmod(b - a + 540, F.lit(360)) - 180


def bounding_box(points: DataFrame, widest: float = 150) -> DataFrame:
    """Bounds; none if there are no points or they span ``widest`` degrees of longitude or more."""
    box = points.agg(F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lng").alias("west"), F.max("lng").alias("east"))
    return box.where(F.col("east") - F.col("west") < widest)


def mapped_counts(jobs: DataFrame, points: DataFrame) -> DataFrame:
    rows = jobs.join(points.select("id", F.lit(True).alias("there")), "id", "left")
    return rows.agg(F.count("*").alias("total"), F.count("there").alias("mapped"), F.count_if(F.col("there").isNull()).alias("unmapped"))


def snapshot_counts(jobs: DataFrame, points: DataFrame) -> DataFrame:
    """total_count, resolved_count, unresolved_count of a snapshot; ``sound`` is false if an id comes twice. A job's first point counts, further ones don't."""
    there = points.select("id").distinct().withColumn("there", F.lit(True))
    by = jobs.groupBy("id").agg(F.count("*").alias("n")).join(there, "id", "left")
    resolved = F.count("there")
    return by.agg(F.sum("n").alias("total_count"), resolved.alias("resolved_count"), (F.sum("n") - resolved).alias("unresolved_count"), (F.max("n") == 1).alias("sound"))


def visible_groups(members: DataFrame, visible: DataFrame) -> DataFrame:
    """(group_id, on_screen): whether some member (group_id, id, alive) that isn't closed is on screen."""
    shown = members.join(visible.select("id", F.lit(True).alias("shown")).distinct(), "id", "left")
    return shown.groupBy("group_id").agg((F.count_if(F.col("shown").isNotNull() & ~F.col("alive").eqNullSafe(F.lit(False))) > 0).alias("on_screen"))
