"""The board: facets before sort and limit, search, counts, vocabularies.

``Board`` holds postings, statuses and scores by posting id. Joins are left and
on keys, so every posting stays; a posting without a status row counts as new.
All facets come before any limit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.postings import is_active, is_boolean_alive, is_inactive, level_rank, location_group, score_band

STATUSES = ("new", "seen", "worth_checking", "applied", "screen", "interview_technical", "interview_final", "offer", "contract", "rejected", "archived", "not_relevant")
#: Minutes of each window.
WINDOWS = {"24h": 24 * 60, "3d": 72 * 60, "7d": 168 * 60, "30d": 720 * 60}
RANKS = {"Intern": 0, "Junior": 1, "Mid-level": 2, "Senior": 3, "Lead / Manager": 4, "Staff / Principal": 5, "Unknown": 6}
DOMAINS = {
    "availability": ("all", "active", "inactive"), "found_within": ("", *WINDOWS), "work_mode": ("", "remote", "hybrid", "on-site"), "location": ("", "israel", "united-states", "other"),
    "seniority": ("", "non-senior", *RANKS), "fit": ("", "recommended", "skip", "good", "scored", "unscored"), "sort": ("fit", "posted", "found", "seniority"),
    "tab": ("all", "new-for-me", "not-scored", *STATUSES),
}


@dataclass
class Board:
    """postings: id, title, company, stack (comma-separated), …; first_seen and posted in minutes. statuses, scores: by posting_id."""

    postings: DataFrame
    statuses: DataFrame
    scores: DataFrame

    def rows(self) -> DataFrame:
        status = self.statuses.select(F.col("posting_id").alias("id"), "status", "seen")
        score = self.scores.select(F.col("posting_id").alias("id"), "score", "recommendation", "eligibility")
        joined = self.postings.join(status, "id", "left").join(score, "id", "left")
        return joined.withColumn("status", F.coalesce("status", F.lit("new"))).withColumn("sort_posted", F.coalesce("posted", "first_seen"))


def checked(**params: str) -> None:
    """Raises ValueError for a value outside its domain, before any plan is made."""
    for name, value in params.items():
        if value not in DOMAINS[name]:
            raise ValueError(f"{name}: {value!r} isn't one of {DOMAINS[name]}")


def work_mode() -> Column:
    return F.coalesce("work_mode", F.when(F.col("remote"), "remote").when(~F.col("remote"), "on-site"))


def fit_matches(fit: str) -> Column:
    scored = F.col("score").isNotNull()
    return {
        "recommended": scored & F.col("recommendation").isin("apply", "referral", "review") & (F.coalesce("eligibility", F.lit("unknown")) != "blocked"),
        "skip": scored & (F.col("recommendation") == "skip"), "good": F.col("score") >= 60, "scored": scored, "unscored": ~scored,
    }[fit]


def orderings() -> dict[str, list[Column]]:
    return {
        "fit": [F.col("score").desc_nulls_last(), F.col("sort_posted").desc(), F.col("id")],
        "posted": [F.col("sort_posted").desc(), F.col("first_seen").desc(), F.col("id")],
        "found": [F.col("first_seen").desc(), F.col("id")],
        "seniority": [level_rank("seniority", "title"), F.collate("title", "UNICODE"), F.col("first_seen").desc(), F.col("id")],
    }


def on_tab(rows: DataFrame, tab: str = "all", availability: str = "all") -> DataFrame:
    rows = rows.where(F.col("relevance_filtered") == (tab == "not-scored"))
    if tab not in ("all", "not-scored"):
        rows = rows.where(F.col("status") == ("new" if tab == "new-for-me" else tab))
    if availability != "all":
        rows = rows.where(is_active("liveness") if availability == "active" else is_inactive("liveness"))
    return rows


def board_postings(
    board: Board, tab: str = "all", availability: str = "active", fit: str = "", statuses: tuple[str, ...] = (), sort: str = "fit", most: int = 1000,
    found_within: str = "", source: str = "", mode: str = "", location: str = "", seniority: str = "", remote: bool | None = None, now: int = 0,
) -> DataFrame:
    """At most ``most`` (1 to 1000) postings that match every facet given, in order of ``sort``. ``now``: minutes."""
    checked(tab=tab, availability=availability, fit=fit, sort=sort, found_within=found_within, work_mode=mode, location=location, seniority=seniority)
    if not 1 <= most <= 1000 or len(source) > 200:
        raise ValueError("most is 1 to 1000, a source has 200 characters at most")
    rows = on_tab(board.rows(), tab, availability)
    if source:
        rows = rows.where(F.col("source") == source)
    if mode:
        rows = rows.where(work_mode() == mode)
    elif remote is not None:
        rows = rows.where(F.col("remote") == remote)
    if location:
        rows = rows.where(location_group("location") == location)
    if seniority == "non-senior":
        rows = rows.where(~level_rank("seniority", "title").isin(3, 4, 5))
    elif seniority:
        rows = rows.where(level_rank("seniority", "title") == RANKS[seniority])
    if found_within:
        rows = rows.where(F.col("first_seen") >= now - WINDOWS[found_within])
    if statuses:
        rows = rows.where(F.col("status").isin(*statuses))
    if fit:
        rows = rows.where(fit_matches(fit))
    return rows.orderBy(*orderings()[sort]).limit(most)


def narrowed(rows: DataFrame, needle: str | None = None, least: int | None = None, seen: bool | None = None, scored_only: bool = False, without: DataFrame | None = None) -> DataFrame:
    """Search conditions; ``without``: ids to leave out."""
    if least is not None and not 0 <= least <= 100:
        raise ValueError("a least score is 0 to 100")
    if seen is not None:
        rows = rows.where(F.coalesce("seen", F.lit(False)) == seen)
    if least is not None:
        rows = rows.where(F.col("score") >= least)
    if needle is not None:
        fold = F.lower(F.lit(needle))
        rows = rows.where(F.contains(F.lower("title"), fold) | F.contains(F.lower("company"), fold) | F.exists(F.split("stack", ","), lambda x: F.contains(F.lower(x), fold)))
    if scored_only:
        rows = rows.where(F.col("score").isNotNull())
    return rows if without is None else rows.join(without.select("id"), "id", "left_anti")


def search_jobs(board: Board, most: int = 20, **conditions) -> DataFrame:
    if not 1 <= most <= 1000:
        raise ValueError("most is 1 to 1000")
    rows = narrowed(board.rows(), **conditions)
    return rows.orderBy(F.col("score").desc_nulls_last(), F.col("sort_posted").desc(), "id").limit(most)


def count_jobs(board: Board, **conditions) -> DataFrame:
    """Numbers of each score band in one pass."""
    rows = narrowed(board.rows(), **conditions)
    band = score_band("score")
    return rows.agg(*[F.count_if(band == b).alias(b) for b in ("strong", "more", "below")], F.count_if(F.col("score").isNull()).alias("unscored"))


def sources(board: Board, tab: str = "all", availability: str = "active") -> DataFrame:
    """Sources of a tab in order, whatever the narrowing facets."""
    checked(tab=tab, availability=availability)
    return on_tab(board.rows(), tab, availability).agg(F.array_sort(F.collect_set("source")).alias("sources"))


def markers(board: Board) -> DataFrame:
    """Map rows: fit is hidden where the gate filtered the posting, an empty stack falls back to what the description mentions (``list_stack``, if there); no description."""
    shown = ~F.col("relevance_filtered")
    rows = board.rows()
    stack = F.coalesce(F.nullif("stack", F.lit("")), *(["list_stack"] if "list_stack" in rows.columns else []), F.lit("")).alias("stack")
    return rows.select(
        "id", "title", "company", "source", "location", "remote", "work_mode", "seniority", stack, "posted", "first_seen", "status", F.when(shown, F.col("score")).alias("score"),
        F.when(shown, F.col("recommendation")).alias("recommendation"), "relevance_filtered", is_boolean_alive("liveness").alias("alive"),
    )


def since_last_visit(rows: DataFrame, visits: DataFrame) -> DataFrame:
    """Rows first seen after the last visit; all if there was none. One value, joined to each row."""
    cutoff = visits.agg(F.max("last_visit").alias("cutoff"))
    return rows.join(F.broadcast(cutoff), F.col("cutoff").isNull() | (F.col("first_seen") > F.col("cutoff"))).drop("cutoff")
