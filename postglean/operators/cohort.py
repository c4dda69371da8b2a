"""What a reader already has on screen, and what comes to it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unique_by_id(rows: DataFrame, ordinal: str = "at") -> DataFrame:
    """The last payload of each id, at the place of its first."""
    payload = F.struct(*[c for c in rows.columns if c not in ("id", ordinal)])
    best = rows.groupBy("id").agg(F.min(ordinal).alias(ordinal), F.max_by(payload, ordinal).alias("p"))
    return best.select("id", ordinal, "p.*")


def retained(current: DataFrame, incoming: DataFrame, gone: DataFrame) -> DataFrame:
    """``current`` (id, at, state), refreshed where ``incoming`` (id, state) has it, then new rows by id; without ``gone``."""
    both = current.join(incoming.withColumnRenamed("state", "fresh"), "id", "full_outer").join(gone.select("id"), "id", "left_anti")
    return both.select("id", F.col("at").isNull().alias("is_new"), F.coalesce("fresh", "state").alias("state"))


def refreshed(current: DataFrame, incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """``incoming`` (id, state) and, for rows on screen (id) that it left out, what is ``stored`` of them."""
    missing = current.select("id").join(incoming.select("id"), "id", "left_anti").distinct()
    return incoming.select("id", "state").unionByName(stored.select("id", "state").join(missing, "id", "left_semi"))


def overlaid(rows: DataFrame, mutations: DataFrame) -> DataFrame:
    """Statuses of ``rows`` (id, status) with pending mutations (id, status; null takes the row away) laid over."""
    change = mutations.select("id", F.struct("status").alias("m"))
    out = rows.join(change, "id", "left").where(F.col("m").isNull() | F.col("m.status").isNotNull())
    return out.select("id", F.coalesce("m.status", "status").alias("status"))


def counts_by_source(rows: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Number of rows of each source of a fixed list, zero where there are none, in its order."""
    spark = rows.sparkSession
    known = spark.createDataFrame(list(enumerate(order)), "place int, source string")
    return F.broadcast(known).join(rows.groupBy("source").agg(F.count("*").alias("n")), "source", "left").select("place", "source", F.coalesce("n", F.lit(0)).alias("n"))


def liveness_counts(rows: DataFrame) -> DataFrame:
    alive = F.col("alive")
    return rows.agg(F.count_if(alive.eqNullSafe(F.lit(True))).alias("alive"), F.count_if(alive.eqNullSafe(F.lit(False))).alias("dead"), F.count_if(alive.isNull()).alias("unknown"))


def degraded(attempted: str, failed: str):
    """More than half failed."""
    return F.col(failed) * 2 > F.col(attempted)


def plausible_publication(posted: str, observed: str):
    """A date from 2000 to a day after it was observed, else none. Days since 1970."""
    return F.when(F.col(posted).between(10957, F.col(observed) + 1), F.col(posted))


def age_bucket(minutes: str):
    """Compact age: now, hours, days. What is yet to come is now."""
    hours = F.greatest(F.floor(F.col(minutes) / 60), F.lit(0))
    return F.when(F.col(minutes).isNull(), None).when(hours < 1, "now").when(hours < 24, F.concat(hours.cast("string"), F.lit("h"))).otherwise(F.concat(F.floor(hours / 24).cast("string"), F.lit("d")))


def spoken_age(minutes: str):
    """The same in words."""
    hours = F.greatest(F.floor(F.col(minutes) / 60), F.lit(0))
    said = lambda n, unit: F.concat(n.cast("string"), F.lit(" " + unit), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))
    return F.when(F.col(minutes).isNull(), None).when(hours < 1, "just now").when(hours < 24, said(hours, "hour")).otherwise(said(F.floor(hours / 24), "day"))


def posting_dates(posted: str, first_seen: str, last_published: str):
    """Dates to show, in order, each with its kind: posted; republished if published again later, or published if never posted; found."""
    again = F.col(last_published) > F.col(posted)
    each = [
        (F.col(posted).isNotNull(), "posted", posted), (again, "republished", last_published),
        (F.col(posted).isNull() & F.col(last_published).isNotNull(), "published", last_published), (F.col(first_seen).isNotNull(), "found", first_seen),
    ]
    return F.array_compact(F.array(*[F.when(when, F.struct(F.lit(kind).alias("kind"), F.col(at).alias("at"))) for when, kind, at in each]))


def repost_note(source: str, url: str, signal_url: str, signal_label: str, posted: str, last_published: str, day):
    """What shows that a listing is a repost: the network's own label for this address, else a later publication on ``day``."""
    label = F.when(F.col(signal_url) == F.col(url), F.col(signal_label))
    return F.when(F.col(source) == "linkedin", label).when(F.col(last_published) > F.col(posted), F.concat(F.lit("Reposted: republished "), day))


def transitions(before: DataFrame, after: DataFrame) -> DataFrame:
    """How many ids went from each state to each: a dry run's report."""
    a, b = before.select("id", F.col("state").alias("was")), after.select("id", F.col("state").alias("now"))
    return a.join(b, "id").groupBy("was", "now").agg(F.count("*").alias("n"))


def new_since(rows: DataFrame, since: int, most: int = 100) -> DataFrame:
    """Rows found after ``since``, oldest first, and one more than ``most`` if there are: the sign that some were cut."""
    return rows.where(F.col("first_seen") > since).orderBy("first_seen", "id").limit(most + 1)


def claimed(leases: DataFrame, candidates: DataFrame, now: int, length: int = 15) -> DataFrame:
    """The leases after candidates (id) were claimed where no live lease was: one more attempt, ``length`` minutes."""
    both = leases.join(candidates.select("id", F.lit(True).alias("asks")), "id", "full_outer")
    takes = F.coalesce("asks", F.lit(False)) & (F.coalesce("until", F.lit(-1)) <= now)
    return both.select("id", F.when(takes, now + length).otherwise(F.col("until")).alias("until"), F.when(takes, F.coalesce("attempts", F.lit(0)) + 1).otherwise(F.col("attempts")).alias("attempts"))


def new_roles(rows: DataFrame, since: int, tab: str = "all", availability: str = "all", pinned: DataFrame | None = None, most: int = 100) -> DataFrame:
    """Rows (id, first_seen, status, alive, relevance_filtered) found after ``since``, newest first, one more than ``most`` if there are.

    ``tab``: all, not-scored (what the gate filtered, which no other tab shows),
    new-for-me, or a status. ``availability``: all, active (what isn't known to be
    gone) or inactive. ``pinned`` (id): the cohort that a probe has seen; rows that
    came since then don't enter before the limit.
    """
    found = rows.where((F.col("first_seen") > since) & (F.col("relevance_filtered") == (tab == "not-scored")))
    if tab not in ("all", "not-scored"):
        found = found.where(F.col("status") == ("new" if tab == "new-for-me" else tab))
    if availability != "all":
        found = found.where(F.col("alive").eqNullSafe(F.lit(False)) == (availability == "inactive"))
    if pinned is not None:
        found = found.join(pinned.select("id").distinct(), "id", "left_semi")
    return found.orderBy(F.col("first_seen").desc(), "id").limit(most + 1)


def applications_listed(history: DataFrame, company: str | None = None) -> DataFrame:
    """The history of applications, of a company whatever the case of its name, or of all: latest date first, none last, then latest recorded. A blank filter is refused."""
    if company is not None and not company.strip():
        raise ValueError("company filter must be null or nonblank")
    rows = history if company is None else history.where(F.lower(F.btrim("company")) == company.strip().lower())
    return rows.orderBy(F.col("applied").desc_nulls_last(), F.col("recorded").desc(), "id")


def history_listed(events: DataFrame, company: str, most: int = 20) -> DataFrame:
    """Applications to a company, whatever the case of its name: latest date first, none last, then latest recorded."""
    rows = events.where(F.lower(F.btrim("company")) == company.strip().lower())
    return rows.orderBy(F.col("applied").desc_nulls_last(), F.col("recorded").desc(), "id").limit(most)
