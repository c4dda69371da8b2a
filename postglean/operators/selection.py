"""What to work on next: candidates, rotation, leases, missing embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.postings import is_inactive
from .merge import PURSUED


#: The gate's version, and the least characters of a description worth reading.
GATE_VERSION = "2026-10-22-v9-years-jdq"
LEAST_JD = 80


def _trimmed(jd: str = "raw_jd"):
    return F.regexp_replace(F.col(jd), F.lit(r"^\s+|\s+$"), F.lit(""))


def guarded(postings: DataFrame, statuses: DataFrame, scores: DataFrame, version: str = GATE_VERSION) -> DataFrame:
    """Postings that the gate lets through: not filtered, and judged by this version, overridden by the owner, scored or pursued."""
    pursued = statuses.where(F.col("status").isin(*PURSUED)).select(F.col("posting_id").alias("id"), F.lit(True).alias("pursued"))
    scored = scores.select(F.col("posting_id").alias("id"), F.lit(True).alias("scored"))
    rows = postings.where(~F.col("relevance_filtered")).join(pursued, "id", "left").join(scored, "id", "left")
    passed = F.coalesce(F.col("gate_version") == version, F.lit(False)) | F.coalesce("gate_override", F.lit(False)) | F.col("scored").isNotNull() | F.col("pursued").isNotNull()
    return rows.where(passed).drop("pursued", "scored")


def unleased(rows: DataFrame, leases: DataFrame, now: int) -> DataFrame:
    """Rows without a live lease and whose next attempt isn't still to come."""
    held = leases.where((F.col("until") > now) | (F.col("next_attempt_at") > now)).select("id")
    return rows.join(held, "id", "left_anti")


def scoring_candidates(
    postings: DataFrame, statuses: DataFrame, scores: DataFrame, leases: DataFrame, now: int, most: int, profile: str, ids: DataFrame | None = None, version: str = GATE_VERSION,
) -> DataFrame:
    """Live postings of LEAST_JD trimmed characters or more that have a status and pass the gate, to be scored: at most ``most`` of 1 to 1000.

    Those without a score, open ones (new, seen) scored for another profile,
    and requested ones. Unscored ones come first, then the newest. ``ids``
    restricts the choice. Times in minutes.
    """
    if not 1 <= most <= 1000:
        raise ValueError("most is 1 to 1000")
    rows = postings.where(~is_inactive("liveness") & (F.length(_trimmed()) >= LEAST_JD))
    if ids is not None:
        rows = rows.join(ids.select("id"), "id", "left_semi")
    rows = unleased(guarded(rows, statuses, scores, version), leases, now)
    rows = rows.join(statuses.select(F.col("posting_id").alias("id"), "status"), "id")
    rows = rows.join(scores.select(F.col("posting_id").alias("id"), F.lit(True).alias("scored"), "profile_sha256"), "id", "left")
    unscored = F.col("scored").isNull()
    again = F.col("status").isin("new", "seen") & ~F.col("profile_sha256").eqNullSafe(F.lit(profile))
    rows = rows.where(unscored | again | F.coalesce("score_requested", F.lit(False)))
    return rows.orderBy(unscored.desc(), F.coalesce("posted", "first_seen").desc(), "id").limit(most).select("id", "title", "first_seen")


def extract_candidates(postings: DataFrame, statuses: DataFrame, scores: DataFrame, done: DataFrame, leases: DataFrame, now: int, most_bytes: int, most: int) -> DataFrame:
    """Live postings that pass the gate, whose text is neither short nor too long and that have no extraction, oldest first."""
    rows = postings.where(~is_inactive("liveness") & (F.length(_trimmed()) >= LEAST_JD) & (F.octet_length("raw_jd") <= most_bytes))
    rows = unleased(guarded(rows, statuses, scores), leases, now).join(done.select("id"), "id", "left_anti")
    return rows.orderBy("first_seen", "id").limit(most).select("id", "first_seen")


def short_descriptions(postings: DataFrame, least: int, most: int) -> DataFrame:
    """Postings without a description of ``least`` trimmed characters, those tried longest ago first."""
    rows = postings.where(F.col("raw_jd").isNull() | (F.length(F.btrim("raw_jd")) < least))
    return rows.orderBy(F.coalesce("attempted_at", F.lit("")), "first_seen", "id").limit(most).select("id", "url")


def rotating_recheck(rows: DataFrame, limited: str, most: int) -> DataFrame:
    """All rows of other sources, and of source ``limited`` the ``most`` whose last attempt is oldest: one top-k, no window over all."""
    chosen = rows.where(F.col("source") == limited).orderBy(F.coalesce("last_attempt", F.lit("")), "first_seen", "id").limit(most)
    return rows.where(F.col("source") != limited).unionByName(chosen)


def backoff_seconds(attempts: str):
    """60 s, doubled for each attempt after the first, 3600 at most."""
    return F.least(F.lit(3600), (60 * F.pow(F.lit(2), F.least(F.col(attempts) - 1, F.lit(6)))).cast("int"))


def leases_ready(leases: DataFrame, now: int) -> DataFrame:
    """Leases that have run out and whose back-off is over."""
    return leases.where((F.col("until") <= now) & (F.col("until") + backoff_seconds("attempts") <= now))


def embedding_missing(eligible: DataFrame, stored: DataFrame, window: int, most: int) -> DataFrame:
    """Of the newest ``window`` rows those not stored, then ``most`` of them: in this order."""
    newest = eligible.orderBy(F.col("first_seen").desc(), "id").limit(window)
    return newest.join(stored.select("id"), "id", "left_anti").orderBy(F.col("first_seen").desc(), "id").limit(most)


def ambiguous_employers(rows: DataFrame) -> DataFrame:
    """Rows whose company has two listings or more and whose address has no requisition. Counts are partial before they move."""
    repeated = rows.groupBy("company").agg(F.count("*").alias("n")).where("n >= 2").select("company")
    return rows.where(~F.col("has_requisition")).join(repeated, "company", "left_semi")


def cautious_vote(votes: DataFrame, cautious: str) -> DataFrame:
    """Per key: an answer equal to the cautious one wins; then confidence; then the lesser answer."""
    rank = F.struct((F.col("answer") == cautious).alias("a"), F.col("confidence").alias("b"))
    best = Window.partitionBy("key").orderBy(rank.desc(), "answer")
    return votes.withColumn("n", F.row_number().over(best)).where("n = 1").drop("n")


def top_values(rows: DataFrame, column: str, most: int = 20) -> DataFrame:
    """Most frequent values; ties by value."""
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), column).limit(most)


def point_with_fallback(postings: DataFrame, points: DataFrame, headquarters: DataFrame) -> DataFrame:
    """A posting's own point, else its company's if its location allows; others are left out."""
    from ..functions.postings import hq_eligible

    own = postings.join(points.withColumn("own", F.lit(True)), "posting_id", "left")
    allowed = F.col("own").isNull() & hq_eligible("location", "remote")
    out = own.join(headquarters.withColumnsRenamed({"lat": "hq_lat", "company": "hq"}), (F.col("company") == F.col("hq")) & allowed, "left")
    return out.where(F.col("own").isNotNull() | F.col("hq").isNotNull()).select("posting_id", F.coalesce("lat", "hq_lat").alias("lat"), F.when(F.col("own").isNotNull(), "own").otherwise("hq").alias("precision"))
