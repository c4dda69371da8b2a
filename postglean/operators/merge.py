"""Snapshot merges: (stored, incoming) to the next snapshot. One full join on the key carries all column policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statuses that protect a posting from the relevance gate.
PURSUED = ("worth_checking", "applied", "screen", "interview_technical", "interview_final", "offer", "contract", "rejected")


def _sides(stored: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    old = stored.select(key, F.struct(*[c for c in stored.columns if c != key]).alias("old"))
    new = incoming.select(key, F.struct(*[c for c in incoming.columns if c != key]).alias("new"))
    return old.join(new, key, "full_outer")


def _liveness_merged(old: Column, new: Column) -> Column:
    """Evidence (map) after newer evidence: its keys over the old ones', if it was checked no earlier or the old check has no time."""
    at = lambda m: F.element_at(m, "liveness_checked_at").try_cast("timestamp")
    counts = (F.size(new) > 0) & F.when(at(old).isNotNull(), F.coalesce(at(new) >= at(old), F.lit(False))).otherwise(True)
    return F.when(counts, F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)).otherwise(old)


def upsert_postings(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """The stored postings after an upsert of ``incoming`` (one row an id each).

    Texts are overwritten; locations, once known, stay known; a structured work
    mode only yields to a structured one; first publication is the least, last
    ones the greatest, unknown dates aside; a stack that names something wins.
    The check's time only moves forward. ``disposition`` says what happened.

    Further columns are merged if ``stored`` has them: company (overwritten);
    remote (with the work mode that brings it); seniority, salary, raw_jd (known
    ones are replaced by known ones); apply_url (the first stays, unless the
    incoming row's ``apply_url_wins``); liveness (a map whose
    ``liveness_checked_at`` only moves forward: newer keys over older); source,
    external_id, first_seen_at (of the first row).
    """
    old, new = F.col("old"), F.col("new")
    keeps = (old["work_mode_source"] == "structured") & ~new["work_mode_source"].eqNullSafe(F.lit("structured"))
    mode = lambda c: F.when(F.coalesce(keeps, F.lit(False)), old[c]).otherwise(F.coalesce(new[c], old[c]))
    merged = {
        "url": new["url"], "title": new["title"], "location": F.coalesce(new["location"], old["location"]),
        "work_mode": mode("work_mode"), "work_mode_source": mode("work_mode_source"),
        "posted_at": F.least(new["posted_at"], old["posted_at"]), "last_published_at": F.greatest(new["last_published_at"], old["last_published_at"]),
        "last_seen_at": F.greatest(new["last_seen_at"], old["last_seen_at"]), "stack": F.when(new["stack"] != "", new["stack"]).otherwise(old["stack"]),
        "checked_at": F.when(new["checked_at"] >= old["checked_at"], new["checked_at"]).otherwise(old["checked_at"]),
    }
    have = set(stored.columns)
    newer = lambda c: F.coalesce(new[c], old[c])
    further = {
        "company": lambda: new["company"], "seniority": lambda: newer("seniority"), "salary": lambda: newer("salary"), "raw_jd": lambda: newer("raw_jd"), "source": lambda: old["source"],
        "external_id": lambda: old["external_id"], "first_seen_at": lambda: old["first_seen_at"],
        "remote": lambda: F.when(F.coalesce(keeps, F.lit(False)), old["remote"]).when(new["work_mode"].isNotNull(), new["remote"]).when(old["work_mode"].isNotNull(), old["remote"]).otherwise(newer("remote")),
        "apply_url": lambda: F.when(F.coalesce(new["apply_url_wins"], F.lit(False)), new["apply_url"]).otherwise(F.coalesce(old["apply_url"], new["apply_url"])) if "apply_url_wins" in incoming.columns else F.coalesce(old["apply_url"], new["apply_url"]),
        "liveness": lambda: _liveness_merged(old["liveness"], new["liveness"]),
    }
    merged |= {c: make() for c, make in further.items() if c in have}
    pick = lambda c, x: F.when(new.isNull(), old[c]).when(old.isNull(), new[c]).otherwise(x).alias(c)
    disposition = F.when(new.isNull(), "kept").when(old.isNull(), "inserted").otherwise("updated")
    return _sides(stored, incoming).select("id", *[pick(c, x) for c, x in merged.items()], disposition.alias("disposition"))


def dispositions(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    return upsert_postings(stored, incoming).groupBy("disposition").agg(F.count("*").alias("n"))


def status_history(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row for each real change of status between two snapshots (id, status, title)."""
    old, new = F.col("old"), F.col("new")
    changed = new.isNotNull() & ~old["status"].eqNullSafe(new["status"])
    return _sides(stored, incoming).where(changed).select("id", new["title"].alias("role"), old["status"].alias("status_from"), new["status"].alias("status_to"))


def gate_after_edit(stored: DataFrame, incoming: DataFrame, kept: tuple[str, ...] = ("override", "score_requested")) -> DataFrame:
    """Gates (map column ``gate``) after an edit: a changed title clears what was computed, not what the owner set."""
    old, new = F.col("old"), F.col("new")
    cleared = F.map_filter(old["gate"], lambda k, _: k.isin(*kept))
    rows = _sides(stored, incoming).where(old.isNotNull() & new.isNotNull())
    return rows.select("id", F.when(old["title"].eqNullSafe(new["title"]), old["gate"]).otherwise(cleared).alias("gate"))


def pursued_gate(status: Column, rule: Column, parked: Column, scored: Column) -> Column:
    """(rule, pursued_rule) after a status change: pursuit parks the rule; leaving restores it unless a score was earned, residency always."""
    pursued = status.isin(*PURSUED)
    restored = F.when((parked == "already-us-resident") | ~scored, parked)
    return (
        F.when(pursued & rule.isNotNull(), F.struct(F.lit(None).cast("string").alias("rule"), rule.alias("pursued_rule")))
        .when(~pursued & parked.isNotNull(), F.struct(restored.alias("rule"), F.lit(None).cast("string").alias("pursued_rule")))
        .otherwise(F.struct(rule.alias("rule"), parked.alias("pursued_rule")))
    )


def seen_after(op: Column, old_status: Column, old_seen: Column, new_status: Column, new_seen: Column) -> Column:
    """(status, seen, error) by the four branches: insert, status change, seen change, no change."""
    by_status = F.struct(new_status.alias("status"), (new_status != "new").alias("seen"), F.lit(False).alias("error"))
    flagged = (
        F.when(new_seen & (old_status == "new"), F.struct(F.lit("seen").alias("status"), F.lit(True).alias("seen"), F.lit(False).alias("error")))
        .when(~new_seen & (old_status == "seen"), F.struct(F.lit("new").alias("status"), F.lit(False).alias("seen"), F.lit(False).alias("error")))
        .when(~new_seen, F.struct(old_status.alias("status"), old_seen.alias("seen"), F.lit(True).alias("error")))
        .otherwise(F.struct(new_status.alias("status"), new_seen.alias("seen"), F.lit(False).alias("error")))
    )
    return F.when((op == "insert") | ~new_status.eqNullSafe(old_status), by_status).when(~new_seen.eqNullSafe(old_seen), flagged).otherwise(by_status)


def changed_only(stored: DataFrame, derived: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``derived`` whose ``keys`` (id, version, hash) aren't stored: what a backfill writes."""
    return derived.join(stored.select(*keys), keys, "left_anti")


def rolled_back(table: DataFrame, receipt: DataFrame, columns: list[str]) -> DataFrame:
    """``table`` without the rows that an apply inserted and that are still as it left them."""
    digest = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    same = receipt.select("id", F.lit(True).alias("applied"), digest.alias("digest"))
    return table.withColumn("digest", digest).join(same, ["id", "digest"], "left_anti").drop("digest")


def geo_invalidated(points: DataFrame, before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """Points of postings whose place-giving columns haven't changed."""
    old, new = F.col("old"), F.col("new")
    same = [old[c].eqNullSafe(new[c]) for c in columns]
    moved = _sides(before, after).where(old.isNotNull() & new.isNotNull() & ~(F.array_min(F.array(*same)))).select("id")
    return points.join(moved, "id", "left_anti")
