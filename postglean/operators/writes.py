"""Write-side operators beside the merge: statuses, profile, extractions, scores, back-fills. Each gives the next snapshot, or what would be written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.texts import posting_mode
from .board import STATUSES

#: Statuses that take a reason.
REASONED = ("rejected", "not_relevant")
STATUSES_SET = (*STATUSES, "skipped")


def _blank(x: Column) -> Column:
    return ~F.coalesce(x.rlike(r"\S"), F.lit(False))


def status_error(status: str, reason: str) -> Column:
    """Why a change of status is refused; null if it isn't."""
    s, r = F.col(status), F.col(reason)
    return (
        F.when(s.isNull() | ~s.isin(*STATUSES_SET), "unsupported status").when((s == "rejected") & (r.isNull() | _blank(r)), "rejected needs a reason")
        .when((s == "not_relevant") & r.isNotNull() & _blank(r), "a reason is null or says something").when(~s.isin(*REASONED) & r.isNotNull(), "no reason for this status")
    )


def _sided(stored: DataFrame, changes: DataFrame, key: str, how: str = "full_outer") -> DataFrame:
    old = stored.select(key, F.struct(*[c for c in stored.columns if c != key]).alias("old"))
    new = changes.select(key, F.struct(*[c for c in changes.columns if c != key]).alias("new"))
    return old.join(new, key, how)


def statuses_set(stored: DataFrame, changes: DataFrame, postings: DataFrame, now: int) -> DataFrame:
    """Statuses (posting_id, status, reason, seen, updated_at) after ``changes`` (posting_id, status, reason; one a posting).

    Refused changes and those to postings that don't exist change nothing. An
    equal status and reason keep their time; every other change has ``now``, and
    makes the posting seen unless it is new.
    """
    valid = changes.where(status_error("status", "reason").isNull()).join(postings.select(F.col("id").alias("posting_id")), "posting_id", "left_semi")
    old, new = F.col("old"), F.col("new")
    same = F.struct(new["status"], new["reason"]).eqNullSafe(F.struct(old["status"], old["reason"]))
    pick = lambda c, x: F.when(new.isNull() | (old.isNotNull() & same), old[c]).otherwise(x).alias(c)
    return _sided(stored, valid, "posting_id").select(
        "posting_id", pick("status", new["status"]), pick("reason", new["reason"]), pick("seen", new["status"] != "new"), pick("updated_at", F.lit(now))
    )


def status_changes(stored: DataFrame, after: DataFrame, postings: DataFrame) -> DataFrame:
    """One history row for each change of status or reason between two snapshots, with the posting's company and title as they are now."""
    old, new = F.col("old"), F.col("new")
    same = F.struct(new["status"], new["reason"]).eqNullSafe(F.struct(old["status"], old["reason"]))
    moved = _sided(stored, after, "posting_id", "right_outer").where(~(old.isNotNull() & same))
    known = postings.select(F.col("id").alias("posting_id"), "company", F.col("title").alias("role"))
    return moved.join(known, "posting_id").select("posting_id", "company", "role", new["updated_at"].alias("recorded_at"), old["status"].alias("status_from"), new["status"].alias("status_to"), new["reason"].alias("reason"))


def marked_seen(stored: DataFrame, opened: DataFrame, automatic: bool = False) -> DataFrame:
    """Statuses (posting_id, status, seen) after postings (posting_id) were opened.

    One without a status is seen from now on. By hand, any other is flagged, and
    a new one becomes seen; automatically, only a new one changes.
    """
    both = stored.join(opened.select("posting_id", F.lit(True).alias("opened")).distinct(), "posting_id", "full_outer")
    fresh = F.col("opened") & F.coalesce(F.col("status") == "new", F.col("status").isNull())
    flagged = fresh if automatic else F.col("opened")
    return both.select("posting_id", F.when(F.coalesce(fresh, F.lit(False)), "seen").otherwise(F.col("status")).alias("status"), F.when(F.coalesce(flagged, F.lit(False)), True).otherwise(F.col("seen")).alias("seen"))


def scored_anyway(gates: DataFrame, asked: DataFrame) -> DataFrame:
    """Gates (id, gate: map) after owners asked (id) for a score: the first time, override and a request; again, nothing."""
    both = gates.join(asked.select("id", F.lit(True).alias("asked")).distinct(), "id", "left")
    first = F.col("asked") & (F.coalesce(F.element_at("gate", F.lit("override")), F.lit("false")) != "true")
    more = F.create_map(F.lit("override"), F.lit("true"), F.lit("score_requested"), F.lit("true"))
    kept = F.map_filter("gate", lambda k, _: ~k.isin("override", "score_requested"))
    return both.select("id", F.when(F.coalesce(first, F.lit(False)), F.map_concat(kept, more)).otherwise(F.col("gate")).alias("gate"))


def request_acknowledged(gates: DataFrame, scored: DataFrame) -> DataFrame:
    """Gates without the request of postings (id) that have been scored."""
    both = gates.join(scored.select("id", F.lit(True).alias("scored")).distinct(), "id", "left")
    done = F.col("scored").isNotNull() & (F.element_at("gate", F.lit("score_requested")) == "true")
    return both.select("id", F.when(F.coalesce(done, F.lit(False)), F.map_filter("gate", lambda k, _: k != "score_requested")).otherwise(F.col("gate")).alias("gate"))


def gates_refreshed(postings: DataFrame, statuses: DataFrame, scores: DataFrame, rule: Column, version: str, at_write: bool = False) -> DataFrame:
    """(id, version, rule) of gates that change: judged by another version (or at any write), not overridden, not pursued.

    ``rule``: a column over postings (with ``scored``), as ``decided_rule``.
    """
    from .merge import PURSUED

    pursued = statuses.where(F.col("status").isin(*PURSUED)).select(F.col("posting_id").alias("id"))
    rows = postings.where(~F.coalesce("gate_override", F.lit(False))).join(pursued, "id", "left_anti")
    if not at_write:
        rows = rows.where(~F.col("gate_version").eqNullSafe(F.lit(version)))
    rows = rows.join(scores.select(F.col("posting_id").alias("id"), F.lit(True).alias("s")), "id", "left").withColumn("scored", F.col("s").isNotNull())
    rows = rows.withColumn("rule", rule)
    changed = ~(F.col("gate_version").eqNullSafe(F.lit(version)) & F.col("rule").eqNullSafe(F.col("gate_rule")))
    return rows.where(changed).select("id", F.lit(version).alias("version"), "rule")


def profile_updated(stored: DataFrame, changes: DataFrame, fields: tuple[str, ...], now: int) -> DataFrame:
    """The profile (field, value, updated_at) after changes (field, value): unknown fields and blank values are refused, an equal value keeps its time."""
    valid = changes.where(F.col("field").isin(*fields) & ~_blank(F.col("value")))
    both = stored.join(valid.withColumnRenamed("value", "fresh"), "field", "full_outer")
    kept = F.col("fresh").isNull() | F.col("fresh").eqNullSafe(F.col("value"))
    return both.select("field", F.coalesce("fresh", "value").alias("value"), F.when(kept, F.col("updated_at")).otherwise(now).alias("updated_at"))


def applications_recorded(stored: DataFrame, events: DataFrame) -> DataFrame:
    """The history with events (company, role, applied, outcome, recorded) whose texts say something; a date that isn't known stays unknown."""
    told = lambda c: F.col(c).isNull() | ~_blank(F.col(c))
    return stored.unionByName(events.where(~_blank(F.col("company")) & told("role") & told("outcome")).select(stored.columns))


def extractions_persisted(postings: DataFrame, stored: DataFrame, results: DataFrame) -> DataFrame:
    """(posting_id, outcome) of results (posting_id, jd, identity, facts): stale if the description has changed since, unchanged if all is stored, else stored."""
    rows = results.join(postings.select(F.col("id").alias("posting_id"), "raw_jd"), "posting_id", "left")
    rows = rows.join(stored.select("posting_id", F.struct("identity", "facts").alias("was")), "posting_id", "left")
    return rows.select("posting_id", F.when(~F.col("raw_jd").eqNullSafe(F.col("jd")), "stale").when(F.struct("identity", "facts").eqNullSafe(F.col("was")), "unchanged").otherwise("stored").alias("outcome"))


IDENTITY = ("brain", "model", "extractor_version", "schema_sha256", "jd_sha256", "fingerprint", "resolver_version", "publisher")


def current_extractions(extractions: DataFrame, wanted: DataFrame) -> DataFrame:
    """Extractions whose posting and whole identity are those wanted."""
    return extractions.join(wanted.select("posting_id", *IDENTITY), ["posting_id", *IDENTITY], "left_semi")


FINGERPRINTS = ("posting_sha256", "profile_sha256", "history_sha256")


def scores_persisted(stored: DataFrame, results: DataFrame, current: DataFrame, now: int) -> DataFrame:
    """(posting_id, outcome, score, scored_at) after results: stale if an input's fingerprint isn't the current one, unchanged if equal to what is stored, else stored now."""
    fresh = current.select("posting_id", F.struct(*FINGERPRINTS).alias("inputs"))
    rows = results.withColumn("of", F.struct(*FINGERPRINTS)).join(fresh, "posting_id", "left")
    rows = rows.join(stored.select("posting_id", F.struct("score", "payload", *FINGERPRINTS).alias("was"), F.col("scored_at").alias("was_at")), "posting_id", "left")
    outcome = F.when(~F.col("of").eqNullSafe(F.col("inputs")), "stale").when(F.struct("score", "payload", *FINGERPRINTS).eqNullSafe(F.col("was")), "unchanged").otherwise("stored")
    rows = rows.withColumn("outcome", outcome)
    is_new = F.col("outcome") == "stored"
    return rows.select("posting_id", "outcome", F.when(is_new, F.col("score")).otherwise(F.col("was.score")).alias("score"), F.when(is_new, now).otherwise(F.col("was_at")).alias("scored_at"))


def owner_cleared(before: DataFrame, after: DataFrame) -> DataFrame:
    """Points after an update: any that was written again, to whatever value, belongs to no apply any more."""
    return before.join(after.select("id", F.lit(True).alias("written")).distinct(), "id", "left").withColumn("apply_id", F.when(F.col("written").isNull(), F.col("apply_id"))).drop("written")


def eligibility_backfilled(scores: DataFrame, judged: DataFrame, profile: str, recompute: bool = False) -> DataFrame:
    """(posting_id, eligibility, reason) to write: of scores (posting_id, profile_sha256, eligibility, reason) for this profile those without one, or with ``recompute`` unknown ones that differ now."""
    fresh = judged.select("posting_id", F.struct("eligibility", "reason").alias("now"))
    rows = scores.where(F.col("profile_sha256") == profile).join(fresh, "posting_id")
    wanted = (F.col("eligibility") == "unknown") & ~F.struct("eligibility", "reason").eqNullSafe(F.col("now")) if recompute else F.col("eligibility").isNull()
    return rows.where(wanted).select("posting_id", "now.*")


def eligibility_tallies(judged: DataFrame) -> DataFrame:
    return judged.groupBy("eligibility").agg(F.count("*").alias("n"))


def samples(rows: DataFrame, most: int = 20) -> DataFrame:
    """The first rows by id, to be read."""
    return rows.orderBy("posting_id").limit(most)


def planned(stored: DataFrame, derived: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """A back-fill's plan: ids whose derived ``columns`` differ from what is stored, with both."""
    was, now = F.struct(*[F.col(f"s.{c}") for c in columns]), F.struct(*[F.col(f"d.{c}") for c in columns])
    both = stored.alias("s").join(derived.alias("d"), F.col("s.id") == F.col("d.id"))
    return both.where(~was.eqNullSafe(now)).select(F.col("s.id").alias("id"), *[F.col(f"s.{c}").alias(f"was_{c}") for c in columns], *[F.col(f"d.{c}").alias(c) for c in columns])


def plan_applied(stored: DataFrame, plan: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``stored`` after a plan: a row changes only if it is still as the plan found it."""
    p = plan.select("id", F.struct(*[f"was_{c}" for c in columns]).alias("was"), F.struct(*columns).alias("p"))
    rows = stored.join(p, "id", "left").withColumn("apply", F.col("p").isNotNull() & F.struct(*columns).eqNullSafe(F.struct(*[F.col(f"was.was_{c}") for c in columns])))
    out = rows
    for c in columns:
        out = out.withColumn(c, F.when(F.col("apply"), F.col(f"p.{c}")).otherwise(F.col(c)))
    return out.drop("was", "p", "apply")


def descriptions_filled(postings: DataFrame, fetched: DataFrame, least: int) -> DataFrame:
    """Postings (id, url, raw_jd) after fetches (id, url, description): stored if the address is still the same and the description still missing or short."""
    f = fetched.select("id", F.col("url").alias("of"), "description")
    short = F.col("raw_jd").isNull() | (F.length(F.btrim("raw_jd")) < least)
    takes = F.col("description").isNotNull() & (F.col("of") == F.col("url")) & short
    return postings.join(f, "id", "left").withColumn("raw_jd", F.when(F.coalesce(takes, F.lit(False)), F.col("description")).otherwise(F.col("raw_jd"))).drop("of", "description")


def liveness_updated(postings: DataFrame, read: DataFrame) -> DataFrame:
    """Postings (id, liveness: map) after checks (id, seen, fresh: maps): a row is written only if it is still what the check had read; the rest of it stays."""
    r = read.select("id", "seen", "fresh")
    entries = lambda c: F.array_sort(F.map_entries(c))
    same = F.col("fresh").isNotNull() & entries("liveness").eqNullSafe(entries("seen"))
    kept = F.map_filter("liveness", lambda k, _: ~F.map_contains_key("fresh", k))
    return postings.join(r, "id", "left").withColumn("liveness", F.when(F.coalesce(same, F.lit(False)), F.map_concat(kept, "fresh")).otherwise(F.col("liveness"))).drop("seen", "fresh")


def leases_settled(leases: DataFrame, outcomes: DataFrame, now: int) -> DataFrame:
    """Leases after work: gone where it was done, put off by the back-off where it failed; others stay."""
    from .selection import backoff_seconds

    both = leases.join(outcomes.select("id", "done"), "id", "left").where(~F.coalesce("done", F.lit(False)))
    return both.withColumn("next_attempt_at", F.when(F.col("done").isNull(), F.col("next_attempt_at")).otherwise(now + backoff_seconds("attempts"))).withColumn("until", F.when(F.col("done").isNull(), F.col("until")).otherwise(now)).drop("done")


#: Words that stand for an unknown value.
UNKNOWN_WORDS = ("unknown", "unspecified", "not specified", "n/a", "na", "none", "null")


def stored_values(rows: DataFrame, observed: int) -> DataFrame:
    """Feed rows as they are stored; rows without id, address, title or company are refused.

    A word for unknown in seniority is null, one in the stack empties it. The
    mode is the structured one, the flag's or the location's; without one, a
    location that says remote is. An address to apply at is the page's own if
    none is given. Publication dates (days) must be plausible at ``observed``.
    """
    text = lambda c: F.nullif(F.btrim(F.col(c)), F.lit(""))
    unknown = lambda x: F.lower(x).isin(*UNKNOWN_WORDS)
    stack = F.transform(F.coalesce("stack", F.array().cast("array<string>")), lambda x: F.nullif(F.btrim(x), F.lit("")))
    vague = F.exists(stack, lambda x: x.isNull() | unknown(x))
    mode = posting_mode("work_mode", "remote", "location")
    flag = F.when(mode["mode"] == "remote", True).when(mode["mode"] == "on-site", False).when(mode["mode"].isNull() & F.coalesce(text("location").rlike(r"(?i)\bremote\b"), F.lit(False)), True)
    date = lambda c: F.when(F.col(c).between(10957, observed + 1), F.col(c))
    needed = ("id", "url", "title", "company")
    sound = ~_blank(F.col(needed[0])) & ~_blank(F.col(needed[1])) & ~_blank(F.col(needed[2])) & ~_blank(F.col(needed[3]))
    return rows.where(sound).select(
        *[F.btrim(c).alias(c) for c in needed], text("location").alias("location"), flag.alias("remote"), F.when(~unknown(text("seniority")), text("seniority")).alias("seniority"),
        F.when(vague, F.array().cast("array<string>")).otherwise(F.array_distinct(stack)).alias("stack"), text("salary").alias("salary"), F.coalesce(text("apply_url"), F.btrim("url")).alias("apply_url"),
        date("posted_at").alias("posted_at"), F.coalesce(date("last_published_at"), date("posted_at")).alias("last_published_at"), text("jd_text").alias("raw_jd"), mode["mode"].alias("work_mode"), mode["source"].alias("work_mode_source"),
    )


#: Sources whose boards tell availability, and the one whose pages only advise.
BOARD_SOURCES = ("comeet", "greenhouse", "lever", "workable", "ashby", "smartrecruiters", "workday")


def admitted_evidence(source: str, alive: str, status: str, reason: str, final_url: str, checked: str) -> Column:
    """What a harvest may say of availability: nothing for boards' or advisory sources; else all five parts, or nothing."""
    whole = F.col(alive).isNotNull() & F.col(status).between(100, 599) & ~_blank(F.col(reason)) & ~F.lower(F.btrim(reason)).isin(*UNKNOWN_WORDS) & ~_blank(F.col(final_url)) & F.col(checked).isNotNull()
    ok = ~F.coalesce(F.nullif(F.btrim(source), F.lit("")), F.lit("linkedin")).isin("linkedin", *BOARD_SOURCES) & F.coalesce(whole, F.lit(False))
    return F.when(ok, F.struct(F.col(alive).alias("alive"), F.col(status).alias("status"), F.btrim(reason).alias("reason"), F.btrim(final_url).alias("final_url"), F.col(checked).alias("checked")))


def complete_score(payload: str, labels: str, score: str) -> Column:
    """Whether a stored score is whole: nine keys of the payload (a JSON text), eligibility and its reason both or neither, known words, and the score as it says."""
    keys, label_keys = F.json_object_keys(payload), F.json_object_keys(labels)
    needed = ("employer_type", "seniority_real", "fit_score", "fit_tier", "recommendation", "reasons", "fit_line", "fit_line_evidence_ids", "luna_status")
    further = ("eligibility", "eligibility_reason")
    get = lambda p, k: F.get_json_object(p, f"$.{k}")
    has = lambda k: F.array_contains(keys, k)
    within = lambda ks, known: F.size(F.array_except(ks, F.array(*map(F.lit, known)))) == 0
    every = lambda ks, known: F.size(F.array_except(F.array(*map(F.lit, known)), ks)) == 0
    eligible = (~has(further[0]) & ~has(further[1])) | (has(further[0]) & has(further[1]) & get(payload, further[0]).isin("eligible", "blocked", "unknown") & ~_blank(get(payload, further[1])))
    names = ("role_type", "seniority_match", "remote_ok", "red_flag_count")
    how = ("positive", "mixed", "negative", "unknown")
    role = get(labels, "role_type")
    whole = (
        every(keys, needed) & within(keys, (*needed, *further)) & eligible & (get(payload, "fit_score").try_cast("int") == F.col(score)) & get(payload, "fit_tier").isin("strong", "good", "stretch", "weak")
        & get(payload, "recommendation").isin("apply", "referral", "review", "skip") & get(payload, "employer_type").isin("direct", "agency", "unknown") & (get(payload, "luna_status") == "ok")
        & every(label_keys, names) & within(label_keys, names) & (role.isNull() | role.isin("frontend", "fullstack", "ai", "voice")) & get(labels, "seniority_match").isin(*how)
        & get(labels, "remote_ok").isin(*how) & get(labels, "red_flag_count").rlike("^[0-5]$")
    )
    return F.coalesce(whole, F.lit(False))


def capped_fit(score: str, years: str, backend_years: str, focus: str, unfamiliar: str, conditional: int = 5, hard: int = 7, backend_from: int = 3, backend_most: int = 55) -> Column:
    """(score, tier, recommendation, rules) of a fit under the calibration's caps: by years that are required, by unfamiliar requirements, by a back-end focus."""
    y, b, n = F.col(years), F.col(backend_years), F.col(unfamiliar)
    first = F.when(y >= hard, F.struct(F.lit(39).alias("most"), F.lit("years_hard_block").alias("rule"))).when(
        y >= conditional, F.struct(F.when(n > 0, 39).otherwise(59).alias("most"), F.when(n > 0, "years_conditional_unfamiliar").otherwise("years_conditional").alias("rule"))
    ).when(n >= 2, F.struct(F.lit(59).alias("most"), F.lit("required_unfamiliar").alias("rule")))
    heavy = F.coalesce(b >= backend_from, F.lit(False))
    second = F.when(F.col(focus) == "backend", F.struct(F.when(heavy, 39).otherwise(backend_most).alias("most"), F.when(heavy, "backend_years").otherwise("backend_heavy").alias("rule")))
    s = F.least(F.col(score), first["most"], second["most"])
    tier = F.when(s >= 80, "strong").when(s >= 60, "good").when(s >= 40, "stretch").otherwise("weak")
    recommendation = F.when(s >= 60, "apply").when(s >= 40, "review").otherwise("skip")
    return F.struct(s.alias("score"), tier.alias("tier"), recommendation.alias("recommendation"), F.array_compact(F.array(first["rule"], second["rule"])).alias("rules"))


def verdicts_overlaid(rows: DataFrame, verdicts: DataFrame, tiers: tuple[str, ...]) -> DataFrame:
    """``rows`` (company) with a person's verdict and reason for the company, whatever its case; entries of unknown tiers or without reason don't count."""
    sound = verdicts.where(F.col("verdict").isin(*tiers) & ~_blank(F.col("reason")) & ~_blank(F.col("company")))
    by = sound.groupBy(F.lower(F.btrim("company")).alias("k")).agg(F.max(F.struct("verdict", F.btrim("reason").alias("reason"))).alias("v"))
    return rows.join(by, F.lower(F.btrim(rows["company"])) == by["k"], "left").select(*[rows[c] for c in rows.columns], F.col("v.verdict").alias("verdict"), F.col("v.reason").alias("reason"))


def sound_probabilities(values: str, names: tuple[str, ...]) -> Column:
    """Whether a map has exactly these keys, each value in 0 to 1, and sums to 1 within 1e-6."""
    v, known = F.map_values(values), F.array_sort(F.array(*map(F.lit, names)))
    fine = F.forall(v, lambda x: x.isNotNull() & (x >= 0) & (x <= 1)) & (F.abs(F.aggregate(v, F.lit(0.0), lambda s, x: s + x) - 1) <= 1e-6)
    return F.coalesce((F.array_sort(F.map_keys(values)) == known) & fine, F.lit(False))


def red_flags(reasons: Column) -> Column:
    """How many of a score's reasons are negative."""
    return F.size(F.filter(reasons, lambda r: r["assessment"] == "negative"))


def imported_candidates(candidates: DataFrame, most: int) -> DataFrame:
    """Tenants (source, key, company, provenance) to look at: one of each with all that led to it, those with most evidence first."""
    by = candidates.groupBy("source", "key").agg(F.min("company").alias("company"), F.array_sort(F.collect_set("provenance")).alias("provenance"))
    return by.orderBy(F.size("provenance").desc(), "source", "key").limit(most)


def cooled_down(names: DataFrame, misses: DataFrame, today: int, days: int = 30) -> DataFrame:
    """Names that weren't looked for in vain in the last ``days``; a check in the future doesn't count."""
    recent = misses.where((F.col("result") == "miss") & F.col("checked").between(today - days + 1, today)).select("name")
    return names.join(recent, "name", "left_anti")


def geocode_plan(postings: DataFrame, points: DataFrame, headquarters: DataFrame) -> DataFrame:
    """(state, n) of postings (id, company, eligible): with a point, with their company's, or to be resolved."""
    rows = postings.join(points.select("id", F.lit(True).alias("own")).distinct(), "id", "left").join(headquarters.select("company", F.lit(True).alias("hq")).distinct(), "company", "left")
    state = F.when(F.col("own").isNotNull(), "own").when(F.col("eligible") & F.col("hq").isNotNull(), "hq").otherwise("unresolved")
    return rows.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def plan_still_true(plan: DataFrame, postings: DataFrame, columns: tuple[str, ...] = ("company", "location", "remote")) -> DataFrame:
    """Rows of a geocode plan whose posting is still what they were made for."""
    now = postings.select("id", F.struct(*columns).alias("now"))
    return plan.join(now, "id").where(F.struct(*columns).eqNullSafe(F.col("now"))).drop("now")


def rescore_report(before: DataFrame, after: DataFrame, most: int = 20) -> DataFrame:
    """Ranks (id, rank_before, rank_after) of the ``most`` best of either scoring (id, score); null where one hasn't it."""
    top = lambda df: df.orderBy(F.col("score").desc(), "id").limit(most)
    ranked = lambda df, name: top(df).select("id", F.row_number().over(Window.orderBy(F.col("score").desc(), "id")).alias(name))
    return ranked(before, "rank_before").join(ranked(after, "rank_after"), "id", "full_outer")


def budgeted(rows: DataFrame, source: str, least: int, most: int) -> DataFrame:
    """Which rows (id, source, jd, at) are fetched: the first ``most`` of ``source`` whose description is short."""
    short = (F.col("source") == source) & (F.length(F.btrim(F.coalesce("jd", F.lit("")))) < least)
    return rows.where(short).orderBy("at", "id").limit(most).select("id")


def annotated_in_time(rows: DataFrame, annotations: DataFrame, deadline: int) -> DataFrame:
    """Rows with a positive score and their annotation's state: ok, invalid, or unavailable where none came by the deadline."""
    a = annotations.select("id", F.col("state").alias("given"), "at")
    late = F.col("given").isNull() | (F.col("at") > deadline)
    return rows.where(F.col("score") > 0).join(a, "id", "left").select("id", "score", F.when(late, "unavailable").otherwise(F.col("given")).alias("state"))


def pair_agreement(cases: DataFrame, pairs: DataFrame) -> DataFrame:
    """(outcome, n) of pairs (better, worse) that people ordered, against scores of cases (id, score): agreement, tie, disagreement, or unavailable."""
    a, b = (cases.select(F.col("id").alias(c), F.col("score").alias(f"s_{c}")) for c in ("better", "worse"))
    x = F.col("s_better") - F.col("s_worse")
    outcome = F.when(x.isNull(), "unavailable").when(x > 0, "agreement").when(x == 0, "tie").otherwise("disagreement")
    return pairs.join(a, "better", "left").join(b, "worse", "left").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def quote_holds(quote: str, value: str, description: str) -> Column:
    """Whether a quote is in the description as it stands, and the value in the quote as words, whatever its case."""
    q, v = F.col(quote), F.col(value)
    spelled = F.concat(F.lit(r"(?iU)(?<!\w)\Q"), F.replace(v, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?!\w)"))
    return F.coalesce((q != "") & F.contains(F.col(description), q) & (F.regexp_count(q, spelled) > 0), F.lit(False))
