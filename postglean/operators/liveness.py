"""Availability: what is known of a posting now, and strikes over observations."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values, in minutes: how long a confirmation is fresh; least time between two strikes.
FRESH_FOR = 180
STRIKE_SPACING = 45


def projected_state(alive: Column, checked: Column, verdict: Column, deadline: Column, now: int) -> Column:
    """closed, deadline_passed, confirmed or stale, in this order. Times in minutes."""
    fresh = alive & (checked <= now) & (now - checked <= FRESH_FOR) & (verdict.isNull() | (verdict == "alive"))
    return F.when(F.coalesce(~alive, F.lit(False)), "closed").when(F.coalesce(deadline < now, F.lit(False)), "deadline_passed").when(F.coalesce(fresh, F.lit(False)), "confirmed").otherwise("stale")


def strikes(observations: DataFrame) -> DataFrame:
    """Per observation (key, at: minutes, seen: present, absent or unknown) its strikes and verdict.

    Presence and uncertainty end a streak of absences. The first absence of a
    streak is one strike; those at least STRIKE_SPACING after it are two, and
    call for a look at the posting itself. A second observation at one time
    counts for nothing. An uncertainty alerts unless one came just before.
    """
    order = Window.partitionBy("key").orderBy("at", "seen")
    rows = observations.withColumn("repeat", F.coalesce(F.lag("at").over(order) == F.col("at"), F.lit(False)))
    told = rows.where("not repeat")
    absent = F.col("seen") == "absent"
    told = told.withColumn("streak", F.count_if(~absent).over(order))
    first = F.min(F.when(absent, F.col("at"))).over(Window.partitionBy("key", "streak"))
    told = told.withColumn("strikes", F.when(~absent, 0).when(F.col("at") - first < STRIKE_SPACING, 1).otherwise(2))
    verdict = F.when(F.col("seen") == "present", "alive").when(F.col("strikes") == 1, "pending").when(F.col("strikes") == 2, "confirm").otherwise("unknown")
    alert = (F.col("seen") == "unknown") & ~F.coalesce(F.lag("seen").over(order) == "unknown", F.lit(False))
    return told.select("key", "at", "seen", "strikes", verdict.alias("verdict"), alert.alias("alert"))


def board_membership(snapshots: DataFrame, expected: DataFrame) -> DataFrame:
    """Each expected posting (board, id) against its board's snapshot (board, id, total): present or absent, unknown where the snapshot isn't whole."""
    whole = snapshots.groupBy("board").agg(((F.count("*") == F.max("total")) & (F.count_distinct("id") == F.count("*")) & (F.min("total") == F.max("total"))).alias("whole"))
    there = snapshots.select("board", "id", F.lit(True).alias("there")).distinct()
    out = expected.join(whole, "board", "left").join(there, ["board", "id"], "left")
    return out.select("board", "id", F.when(~F.coalesce("whole", F.lit(False)), "unknown").when(F.col("there"), "present").otherwise("absent").alias("seen"))


#: How many looks at a posting's own page may be inconclusive in a row, and how long, in minutes, it is left alone after.
UNKNOWN_LIMIT = 3
PAGE_BACKOFF = 24 * 60
#: What is known of a posting between two observations.
EMPTY = {"last_at": None, "alive": None, "misses": 0, "first_miss": None, "unknowns": 0, "next_look": None, "reason": None, "alerts": 0}


def observed(state: dict, at: int, seen: str, reason: str | None, page_status: int | None, page_reason: str | None) -> tuple[dict, str]:
    """The state after one observation of a board (and of the posting's own page, if it comes to that), and the verdict.

    A second observation at one time is a repeat. Presence clears everything.
    Absence strikes, twice only if STRIKE_SPACING after the first; then the
    page decides: gone only by its status or by a redirect that proves it.
    Uncertainty ends a streak, and alerts when its reason is another one, or the
    board's list failed. A page that stays uncertain is left alone for a while.
    """
    if at == state["last_at"]:
        return state, "duplicate-snapshot"
    s = state | {"last_at": at}
    if seen == "present":
        return s | {"alive": True, "misses": 0, "first_miss": None, "unknowns": 0, "next_look": None, "reason": None}, "alive"
    if seen != "absent":
        again = state["reason"] == reason and not (reason or "").startswith("board-unknown:")
        return s | {"misses": 0, "first_miss": None, "reason": reason, "alerts": state["alerts"] + (not again)}, "unknown"
    first = at if not state["misses"] or state["first_miss"] is None or state["first_miss"] > at else state["first_miss"]
    misses = 1 if state["misses"] < 2 and (not state["misses"] or at - first < STRIKE_SPACING) else 2
    s |= {"first_miss": first, "misses": misses}
    if misses < 2:
        return s | {"reason": None}, "pending"
    if state["alive"] is False:
        return s, "gone"
    if state["next_look"] is not None and at < state["next_look"]:
        return s, "unknown"
    if page_status in (404, 410) or page_reason in ("ats-generic-careers-redirect", "ashby-detail-missing"):
        return s | {"alive": False, "unknowns": 0, "next_look": None, "reason": None}, "gone"
    unknowns = min(UNKNOWN_LIMIT, state["unknowns"] + 1)
    key = f"{page_reason}:{page_status}"
    return s | {"unknowns": unknowns, "next_look": at + PAGE_BACKOFF if unknowns >= UNKNOWN_LIMIT else None, "reason": key, "alerts": state["alerts"] + (state["reason"] != key)}, "unknown"


OBSERVED = "key long, at long, verdict string, alive boolean, misses int, alerts int"


def _told(key, rows, state: dict) -> tuple[list[tuple], dict]:
    out = []
    for at, seen, reason, status, page in rows:
        state, verdict = observed(state, at, seen, reason, status, page)
        out.append((key, at, verdict, state["alive"], state["misses"], state["alerts"]))
    return out, state


def reliability(observations: DataFrame) -> DataFrame:
    """The fold over each posting's observations (key, at: minutes, seen, reason, page_status, page_reason), in order of time.

    A posting's observations are folded in one task: there is one for each run, so a key is bounded by its age.
    """
    def fold(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("at", "ascending"), ("seen", "ascending")])
        rows, _ = _told(key[0].as_py(), zip(*(table[c].to_pylist() for c in ("at", "seen", "reason", "page_status", "page_reason"))), dict(EMPTY))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int32(), pa.int32())
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["key", "at", "verdict", "alive", "misses", "alerts"])

    return observations.groupBy("key").applyInArrow(fold, OBSERVED)


def run_receipt(outcomes: DataFrame) -> DataFrame:
    """What a run did: (checked, closed, alive, unknown, unsupported, alerts) of outcomes (alive, written, supported, alerts). A row that wasn't written is unknown, whatever was seen."""
    alive = F.col("alive")
    return outcomes.agg(
        F.count("*").alias("checked"), F.count_if(F.col("written") & alive.eqNullSafe(F.lit(False))).alias("closed"), F.count_if(F.col("written") & alive.eqNullSafe(F.lit(True))).alias("alive"),
        F.count_if(~F.col("written") | alive.isNull()).alias("unknown"), F.count_if(~F.col("supported")).alias("unsupported"), F.coalesce(F.sum("alerts"), F.lit(0)).alias("alerts"),
    )


#: Hosts of hosted boards, and what answers redirect.
HOSTED = ("boards.greenhouse.io", "boards.eu.greenhouse.io", "job-boards.greenhouse.io", "job-boards.eu.greenhouse.io")
REDIRECTS = (301, 302, 303, 307, 308)


def direct_verdicts(postings: DataFrame, responses: DataFrame) -> DataFrame:
    """(id, alive, reason, status, final_url, control_id) of postings (id, source, tenant, url, canonical_url) by landed ``responses`` (url, status, location, generic).

    404 and 410 say that a posting is gone, and so does a redirect to a
    ``generic`` page; anything else is unknown. On a hosted board an absence
    counts only on the canonical page, where 410 is no proof, and only beside a
    control: a sibling of the same tenant whose canonical page answers 200, the
    one of the least id. Where the posting's own page is inconclusive, the
    canonical one is asked, beside a control too.

    Siblings are two ids a tenant, the least ones that answer, joined back; no
    posting meets another.
    """
    host = F.lower(F.regexp_extract("url", r"^https://([^/?#:]+)", 1))
    rows = postings.withColumn("hosted", (F.col("source") == "greenhouse") & host.isin(*HOSTED)).withColumn("other", F.col("canonical_url").isNotNull() & (F.col("canonical_url") != F.col("url")))
    answer = responses.select(F.col("url").alias("of"), F.struct("status", "location", "generic").alias("r"))
    rows = rows.join(answer.withColumnsRenamed({"of": "url", "r": "own"}), "url", "left").join(answer.withColumnsRenamed({"of": "canonical_url", "r": "canon"}), "canonical_url", "left")

    def gone(r: Column, canonical: Column) -> Column:
        by_status = (r["status"] == 404) | ((r["status"] == 410) & ~canonical)
        return F.coalesce(by_status | (r["status"].isin(*REDIRECTS) & r["generic"]), F.lit(False))

    def told(r: Column, gone_: Column, url: str) -> Column:
        reason = F.when(~gone_, "posting-url-unknown").when(r["status"].isin(404, 410), F.concat(F.lit("http-"), r["status"].cast("string"))).otherwise("ats-generic-careers-redirect")
        final = F.coalesce(F.when(r["status"].isin(*REDIRECTS), r["location"]), F.col(url))
        return F.struct(F.when(gone_, False).alias("alive"), reason.alias("reason"), r["status"].alias("status"), final.alias("final_url"))

    answering = rows.where((F.col("canon.status") == 200) & F.col("tenant").isNotNull()).select("source", "tenant", "id").distinct()
    two = answering.groupBy("source", "tenant").agg(F.min("id").alias("first"))
    second = answering.join(two, ["source", "tenant"]).where("id <> first").groupBy("source", "tenant").agg(F.min("id").alias("second"))
    rows = rows.join(two.join(second, ["source", "tenant"], "left"), ["source", "tenant"], "left")
    control = F.when(F.col("first") != F.col("id"), F.col("first")).otherwise(F.col("second"))
    own_gone = gone(F.col("own"), F.col("hosted"))
    elsewhere = F.col("hosted") & (F.col("other") | F.col("canonical_url").isNull()) & own_gone  # an absence that no control can vouch for
    unknown = ~own_gone | elsewhere
    needs = (F.col("hosted") & own_gone & ~elsewhere) | (unknown & F.coalesce("other", F.lit(False)))
    own, canon = told(F.col("own"), own_gone, "url"), told(F.col("canon"), gone(F.col("canon"), F.lit(True)), "canonical_url")
    bare = F.struct(F.lit(None).cast("boolean").alias("alive"), F.when(needs, "greenhouse-control-unknown").otherwise(own["reason"]).alias("reason"), own["status"].alias("status"), own["final_url"].alias("final_url"))
    verdict = F.when(needs & control.isNull(), bare).when(unknown & F.coalesce("other", F.lit(False)), canon).when(elsewhere, bare).otherwise(own)
    return rows.select("id", verdict.alias("v"), F.when(needs, control).alias("control_id")).select("id", "v.*", "control_id")
