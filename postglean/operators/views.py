"""What a reader is shown: cards, details, summaries, groups on screen, searches within them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.postings import fit_tier, job_link_url, level_rank, location_group, score_band, title_level
from .board import Board, fit_matches, work_mode


def with_extraction(rows: DataFrame, extractions: DataFrame) -> DataFrame:
    """``rows`` with ``extracted``: whether an extraction exists."""
    known = extractions.select("id", F.lit(True).alias("extracted")).distinct()
    return rows.join(known, "id", "left").withColumn("extracted", F.col("extracted").isNotNull())


CARD = ["id", "title", "company", "location", "source", "url", "remote", "work_mode", "seniority", "stack", "posted", "first_seen", "status", "score", "score_band", "recommendation", "fit_tier", "extracted", "jd_length"]


def cards(board: Board, extractions: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Derived rows of postings; of all, or of ``ids`` alone. The description itself isn't part of a card."""
    rows = with_extraction(board.rows(), extractions)
    if ids is not None:
        rows = rows.join(ids.select("id").distinct(), "id", "left_semi")
    shown = rows.withColumn("score_band", score_band("score")).withColumn("fit_tier", fit_tier("score")).withColumn("jd_length", F.length("raw_jd"))
    return shown.withColumn("url", job_link_url("apply_url", "url")).select(CARD)


def whole_cards(postings: DataFrame, statuses: DataFrame, scores: DataFrame, extractions: DataFrame) -> DataFrame:
    """All fields of a card, by keyed joins: postings by id with status, score and whether an extraction exists. Payloads are maps; a liveness that isn't true or false is unknown."""
    rows = postings.join(statuses.withColumnRenamed("posting_id", "id").withColumnsRenamed({"reason": "status_reason"}), "id", "left").join(scores.withColumnRenamed("posting_id", "id"), "id", "left")
    rows = with_extraction(rows, extractions.withColumnRenamed("posting_id", "id"))
    alive = F.element_at("liveness", "alive")
    link = job_link_url("apply_url", "url")
    return rows.select(
        "id", "title", "company", "location", "score", "reasons", link.alias("apply_url"), "stack", "remote", "seniority", "source", F.col("last_seen_at").alias("updated_at"), F.lit(None).cast("string").alias("logo"),
        F.coalesce(F.btrim("raw_jd") != "", F.lit(False)).alias("has_description"), F.when(F.col("seniority").isNotNull(), "extracted").otherwise("unknown").alias("seniority_source"),
        F.when(F.col("extracted"), "extracted").otherwise("not-extracted").alias("extraction"), "salary", job_link_url("url", "url").alias("listing_url"), "posted_at", "first_seen_at", F.coalesce("status", F.lit("new")).alias("status"),
        "status_reason", F.element_at("payload", "fit_line").alias("fit_line"), F.element_at("payload", "recommendation").alias("recommendation"), F.when(alive.isin("true", "false"), alive.cast("boolean")).alias("alive"),
        link.alias("link_url"), score_band("score").alias("score_band"), F.element_at("payload", "fit_tier").alias("fit_tier"), F.coalesce("seen", F.lit(False)).alias("seen"), "seen_at",
        F.when(~F.col("status").isin("new", "seen"), F.col("status")).alias("pipeline_status"), "last_published_at", "work_mode",
    )


def details(board: Board, extractions: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Cards with the description, by name: a card's new column shifts none."""
    return cards(board, extractions, ids).join(board.postings.select("id", "raw_jd"), "id").select(*CARD, "raw_jd")


def summaries(board: Board, state: Column) -> DataFrame:
    """List rows: seniority from the title where it isn't given, fit hidden where the gate filtered, and the state of availability."""
    shown = ~F.col("relevance_filtered")
    rows = board.rows()
    return rows.select(
        "id", "title", "company", F.coalesce("seniority", title_level("title")).alias("seniority"), "status", F.when(shown, F.col("score")).alias("score"),
        F.when(shown, F.col("recommendation")).alias("recommendation"), "eligibility", state.alias("state"),
    )


#: Endings of company names that don't tell them apart.
COMPANY_ENDINGS = r"(?:(?:^| )(?:private limited|pvt ltd|inc|ltd|llc|corp|corporation|company|co|group|holdings|lab|labs|gmbh|ag|sa|bv|ai|technologies|systems))+$"


def company_core(name) -> Column:
    """A company's name without abbreviations in brackets, marks and endings."""
    c = F.col(name) if isinstance(name, str) else name
    words = F.btrim(F.regexp_replace(F.lower(F.regexp_replace(c, F.lit(r"\([A-Z][A-Z0-9&.]{1,}\)"), F.lit(" "))), F.lit(r"(?U)[\W_]+"), F.lit(" ")))
    return F.regexp_replace(words, F.lit(COMPANY_ENDINGS), F.lit(""))


def is_alias(publisher, employer) -> Column:
    """Whether two names are one company's: their cores are equal, or one begins the other."""
    a, b = company_core(publisher), company_core(employer)
    return F.coalesce((a != "") & (b != "") & ((a == b) | F.startswith(a, F.concat(b, F.lit(" "))) | F.startswith(b, F.concat(a, F.lit(" ")))), F.lit(False))


def employer_label(company: str, publisher: str, employer: str, relationship: str, agency_evidence: str, agencies: tuple[str, ...] = ()) -> Column:
    """Who employs, and through whom; an agency that doesn't name its client says so. What is known of another publisher counts for nothing."""
    c, e = F.col(company), F.col(employer)
    known = F.coalesce(F.col(publisher) == c, F.lit(False))
    agency = F.lower(c).isin(*[a.lower() for a in agencies]) | (known & F.coalesce(F.btrim(agency_evidence) != "", F.lit(False)))
    undisclosed = F.when(agency, F.concat(c, F.lit(" (agency — client undisclosed)"))).otherwise(c)
    same = F.coalesce(F.col(relationship) == "alias", F.lit(False)) | is_alias(c, e) | (F.lower(e) == F.lower(c))
    return F.when(~known | e.isNull(), undisclosed).when(same, c).otherwise(F.concat(e, F.lit(" via "), c))


def matches_needle(needle: str, label: Column) -> Column:
    """Whether the text of title, employer, place, source and stack holds the needle, whatever the case."""
    text = F.concat_ws(" ", "title", label, F.coalesce("location", F.lit("")), "source", F.replace("stack", F.lit(","), F.lit(" ")))
    return F.contains(F.lower(text), F.lower(F.lit(needle.strip())))


def matches_fit(fit: str) -> Column:
    """The reader's own filter: as the board's, and all where none is asked."""
    return F.coalesce(fit_matches(fit), F.lit(False)) if fit else F.lit(True)


def matches_view(found_since: int | None = None, source: str = "", mode: str = "", location: str = "", seniority: str = "", statuses: tuple[str, ...] = (), fit: str = "") -> Column:
    """The reader's filter over rows that are there already."""
    out = matches_fit(fit)
    rank = level_rank("seniority", "title")
    ranks = {"Intern": 0, "Junior": 1, "Mid-level": 2, "Senior": 3, "Lead / Manager": 4, "Staff / Principal": 5, "Unknown": 6}
    if found_since is not None:
        out = out & (F.col("first_seen") >= found_since)
    if source:
        out = out & (F.col("source") == source)
    if mode:
        out = out & F.coalesce(work_mode() == mode, F.lit(False))
    if location:
        out = out & (location_group("location") == location)
    if seniority:
        out = out & (~rank.isin(3, 4, 5) if seniority == "non-senior" else rank == ranks[seniority])
    if statuses:
        out = out & F.col("status").isin(*statuses)
    return out


def representatives_sorted(groups: DataFrame, sort: str, most: int) -> DataFrame:
    """Groups by their representatives: without a score after all scores, as if it were -1."""
    when = F.coalesce("posted", "first_seen")
    orders = {
        "fit": [F.coalesce("score", F.lit(-1)).desc(), when.desc(), F.col("id")], "posted": [when.desc(), F.col("id")], "found": [F.col("first_seen").desc(), F.col("id")],
        "seniority": [F.when(level_rank("seniority", "title") == 6, 9).otherwise(level_rank("seniority", "title")), F.collate("title", "UNICODE"), F.col("id")],
    }
    return groups.orderBy(*orders[sort]).limit(most)


def cards_in_order(rows: DataFrame, key: str) -> DataFrame:
    """Per ``key`` its cards (id, first_seen) as one array, newest first, ids breaking ties. One key's cards are one value."""
    newest = F.sort_array(F.collect_list(F.struct((-F.col("first_seen")).alias("at"), F.col("id").alias("id"))))
    return rows.groupBy(key).agg(F.transform(newest, lambda x: x["id"]).alias("ids"))


def companies_probed(rows: DataFrame, company: Column) -> DataFrame:
    """The different companies of a probe, in order."""
    return rows.agg(F.array_sort(F.collect_set(company)).alias("companies"))


def newest_cursor(rows: DataFrame, at: str = "first_seen", raw: str = "raw") -> DataFrame:
    """The newest row's own spelling of its time: by the time, then by the spelling. The beginning of time if there are no rows."""
    return rows.agg(F.coalesce(F.max(F.struct(at, raw))[raw], F.lit("1970-01-01T00:00:00.000Z")).alias("since"))


def history_newest(history: DataFrame, posting_id: str, most: int = 20) -> DataFrame:
    """A posting's latest changes."""
    return history.where(F.col("posting_id") == posting_id).orderBy(F.col("recorded_at").desc(), "id").limit(most)


def cohort_of_globe(previous: DataFrame, incoming: DataFrame, latest: DataFrame) -> DataFrame:
    """Points (id, lat, source) after a refresh: incoming ones of rows that weren't updated, the latest of those that were, and earlier ones of what neither has."""
    updated = latest.join(previous.select("id"), "id", "left_semi")
    fresh = incoming.join(updated.select("id"), "id", "left_anti")
    known = fresh.select("id").unionAll(updated.select("id"))
    return fresh.unionByName(updated).unionByName(previous.join(known, "id", "left_anti"))


def related(groups: DataFrame, selected: str) -> DataFrame:
    """All other listings of the selected one's group, newest first."""
    own = groups.where(F.col("id") == selected).select("group_id")
    rows = groups.join(own, "group_id", "left_semi").where(F.col("id") != selected)
    return rows.orderBy(F.coalesce("posted", "first_seen").desc_nulls_last(), "id").select("id")


def source_options(rows: DataFrame, selected: str = "") -> DataFrame:
    """Sources to choose from: those there are, and the selected one even if it is gone, in order."""
    found = F.array_sort(F.array_distinct(F.concat(F.collect_set("source"), F.array(*([F.lit(selected)] if selected else [])).cast("array<string>"))))
    return rows.agg(found.alias("sources"))


def ranked_value(score: str, fit: str, status: str) -> Column:
    """A validated fit score, else the keyword score."""
    return F.when((F.col(status) == "ok") & F.col(fit).isNotNull(), F.col(fit)).otherwise(F.coalesce(score, F.lit(0)))


def top_of_recent(feed: DataFrame, today: str, days: int = 7, most: int = 20) -> DataFrame:
    """The best rows of the last ``days`` dated feeds that have an address, by rank, then title: their partitions alone are read."""
    first = F.date_sub(F.lit(today).cast("date"), days - 1)
    rows = feed.where((F.col("feed_date") >= first) & (F.col("feed_date") <= F.lit(today).cast("date")) & (F.coalesce("url", F.lit("")) != ""))
    return rows.orderBy(ranked_value("score", "fit_score", "luna_status").desc(), F.lower("title"), "id").limit(most)


def recommendation_of_verdict(verdict: str) -> Column:
    """A person's verdict as a recommendation, which wins over the model's."""
    v = F.lower(F.btrim(verdict))
    return F.when(v.isin("apply", "applied"), "apply").when(v.isin("referral", "interesting"), "referral").when(v.isin("skip", "not_relevant"), "skip")


#: What the gate's rules are called.
RULE_LABELS = {
    "jd-quality-missing-body": "JD quality: description is missing", "jd-quality-unfilled-template": "JD quality: unfilled role and experience placeholders",
    "jd-quality-mixed-role": "JD quality: description mixes separate roles", "jd-quality-listing-only": "JD quality: job links without a role description",
    "jd-quality-external-summary": "JD quality: full description is linked but not stored", "leadership-title-strict": "Leadership or staff-level role",
    "incompatible-stack-title": "Role requires a different primary stack", "years-minimum-7-strict": "Requires at least 7 years of experience",
    "mandatory-degree": "Requires a degree without an equivalent-experience option", "specialist-required": "Requires specialist experience", "pure-qa-title": "QA role",
    "support-title": "Support role", "technical-cofounder-title": "Technical co-founder or CTO role", "equity-only": "Equity-only compensation",
    "already-us-resident": "Must already live in the US",
}


def rule_label(rule: str) -> Column:
    """What a rule is called; an unknown one by its own name, none as out of preferences."""
    named = F.create_map(*[F.lit(v) for kv in RULE_LABELS.items() for v in kv])
    return F.when(F.coalesce(F.col(rule), F.lit("")) == "", "Outside current preferences").otherwise(F.coalesce(F.element_at(named, F.col(rule)), F.col(rule)))


def status_patch(status: str, reason: str, to: str, to_reason: str, tab: str) -> Column:
    """(noop, removes): whether a change of status changes nothing, and whether the card leaves the tab of new ones."""
    same = (F.col(to) == F.col(status)) & (F.col(to_reason).isNull() | F.col(to_reason).eqNullSafe(F.col(reason)))
    return F.struct(same.alias("noop"), (F.lit(tab == "new-for-me") & (F.col(to) != "new")).alias("removes"))


def facts_vs_aliases(facts: DataFrame, aliases: DataFrame) -> DataFrame:
    """Each fact (id, text) with the value of the longest alias (alias, value) that it contains as words; ties by alias.

    Each different text is cut into runs of as many words as aliases have, so this is a join on equal runs.
    """
    words = lambda c: F.split(F.lower(c), " ")
    most = aliases.agg(F.max(F.size(words("alias")))).first()[0] or 1
    w = words("t")
    cut_runs = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))
    runs = F.array_distinct(F.flatten(F.array(*[cut_runs(n) for n in range(1, most + 1)])))
    cut = facts.select(F.col("text").alias("t")).distinct().select("t", F.explode(runs).alias("run"))
    hit = cut.join(aliases.select(F.lower("alias").alias("run"), "value"), "run")
    best = hit.groupBy("t").agg(F.max_by("value", F.struct(F.length("run"), "run")).alias("value"))
    return facts.join(best, facts["text"] == best["t"], "left").select("id", "text", "value")


def numbered_history(events: DataFrame, key: str, at: str, most: int) -> DataFrame:
    """The newest ``most`` events of each key with their number."""
    order = Window.partitionBy(key).orderBy(F.col(at).desc(), "id")
    return events.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
