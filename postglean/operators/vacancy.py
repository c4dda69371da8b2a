"""Duplicate vacancies: greedy complete linkage within a company."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.evidence import identity_text
from .graph import connected, stored


def _places_agree(a: dict, b: dict) -> bool:
    """Unknown agrees with everything, so this isn't transitive."""
    if a["place"] == b["place"]:
        return True
    if a["countries"] and b["countries"] and not set(a["countries"]) & set(b["countries"]):
        return False
    return all(not a[k] or not b[k] or a[k] == b[k] for k in ("region", "city"))


def _one_role(a: dict, b: dict) -> bool:
    mine, theirs = set(a["requisitions"] or ()), set(b["requisitions"] or ())
    if mine and theirs:
        return mine == theirs
    if max(len(mine), len(theirs)) > 1:
        return False
    if not mine and not theirs and a["fingerprint"] and a["fingerprint"] == b["fingerprint"]:
        return True
    shared = set(a["role_keys"] or ()) & set(b["role_keys"] or ())
    return _places_agree(a, b) and bool(shared or (a["title_key"] and a["title_key"] == b["title_key"]))


def _grouped(table: pa.Table) -> pa.Table:
    """Linked profiles of a company, strong evidence first; each joins the first group in which it is one role with every member."""
    rows = table.to_pylist()
    rows.sort(key=lambda r: (-(2 if r["requisitions"] else 1 if r["fingerprint"] else 0), r["first_id"]))
    groups: list[list[dict]] = []
    out = []
    for r in rows:
        home = next((g for g in groups if all(_one_role(m, r) for m in g)), None)
        if home is None:
            groups.append(home := [])
        home.append(r)
        out.append((r["profile"], home[0]["first_id"]))
    return pa.table({"profile": pa.array([o[0] for o in out], pa.int64()), "group_id": pa.array([o[1] for o in out], pa.string())})


EVIDENCE = ["title_key", "place", "countries", "region", "city", "requisitions", "fingerprint", "role_keys"]


def vacancy_groups(rows: DataFrame) -> DataFrame:
    """``rows`` (id, company, title, place, countries, region, city, requisitions, fingerprint, role_keys, posted, first_seen) with group_id, is_representative, group_size.

    Rows of one company with equal evidence are one profile. Two profiles can
    only be one role if they share their requisitions, a text, a board's key or a
    title, so profiles that such evidence links, directly or not, are grouped
    together, each such component by itself; what shares nothing is a group
    without a look at others. A blank company groups nothing. The newest row
    represents its group.
    """
    keyed = rows.withColumn("company_key", identity_text("company")).withColumn("title_key", identity_text("title"))
    lone = F.when(F.col("company_key") == "", F.col("id"))
    # a profile is one role with itself by its requisitions, its text, its keys or its title; without any of them each row is its own
    alone = (F.size(F.coalesce("requisitions", F.array().cast("array<string>"))) == 0) & F.col("fingerprint").isNull() & (F.size(F.coalesce("role_keys", F.array().cast("array<string>"))) == 0) & (F.col("title_key") == "")
    several = F.size(F.coalesce("requisitions", F.array().cast("array<string>"))) > 1
    keyed = keyed.withColumn("profile", F.xxhash64("company_key", F.coalesce(lone, F.when(alone, F.col("id"))), *EVIDENCE))
    keyed = stored(keyed)
    profiles = keyed.groupBy("company_key", "profile", *EVIDENCE).agg(F.min("id").alias("first_id"))
    tagged = lambda tag, x: F.when(x.isNotNull() & (x != ""), F.xxhash64("company_key", F.lit(tag), x))
    named = F.when(F.size("requisitions") > 0, F.array_join("requisitions", "|"))
    tokens = F.array_compact(F.concat(
        F.array(tagged("r", named), tagged("f", F.when(F.coalesce(F.size("requisitions"), F.lit(0)) <= 0, F.col("fingerprint"))), F.when(~several, tagged("t", F.col("title_key")))),
        F.coalesce(F.when(~several, F.transform("role_keys", lambda k: F.xxhash64("company_key", F.lit("k"), k))), F.array().cast("array<bigint>")),
    ))
    posted = profiles.where("company_key <> ''").select("profile", F.explode(tokens).alias("token"))
    hubs = posted.groupBy("token").agg(F.min("profile").alias("hub"))
    links = posted.join(hubs, "token").where("profile <> hub").select(F.col("profile").alias("a"), F.col("hub").alias("b"))
    parts = connected(links).withColumnsRenamed({"node": "profile", "root": "component"})
    together = profiles.join(parts, "profile").groupBy("component").applyInArrow(_grouped, "profile long, group_id string")
    apart = profiles.join(parts.select("profile"), "profile", "left_anti").select("profile", F.col("first_id").alias("group_id"))
    out = keyed.join(together.unionAll(apart), "profile").drop("profile", "company_key", "title_key")
    when = F.coalesce("posted", "first_seen")
    best = out.groupBy("group_id").agg(F.min(F.struct((-when).isNull().alias("unknown"), (-when).alias("age"), F.col("id"))).alias("b"), F.count("*").alias("group_size"))
    return out.join(best, "group_id").withColumn("is_representative", F.col("id") == F.col("b.id")).drop("b")


def publication_dates(grouped: DataFrame) -> DataFrame:
    """First posting and last publication of each group."""
    return grouped.groupBy("group_id").agg(F.min("posted").alias("posted_at"), F.greatest(F.max("posted"), F.max("last_published")).alias("last_published_at"))


def new_groups(grouped: DataFrame, visible: DataFrame) -> DataFrame:
    """Groups none of whose rows was visible."""
    shown = grouped.join(visible.select("id"), "id", "left_semi").select("group_id").distinct()
    return grouped.select("group_id").distinct().join(shown, "group_id", "left_anti")


def numbered_groups(rows: DataFrame) -> DataFrame:
    """Members of each group in the order in which they are shown: newest first."""
    newest = Window.partitionBy("group_id").orderBy(F.coalesce("posted", "first_seen").desc_nulls_last(), "id")
    return rows.withColumn("place_in_group", F.row_number().over(newest))
