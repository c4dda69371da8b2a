"""Checks of what a model says against what it says it from: facts with quotes, and annotations with evidence. Each names the rule that is broken."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .descriptions import COMPANY_PLACE, attendance, clauses_with
from .places import let
from .texts import title_seniority


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _says(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(f"(?iU){pattern}"), F.lit(False))


#: How a text speaks of remote work, and of whose.
REMOTE, AVAILABLE = r"\bremote(?:ly)?\b", r"(?:available|allowed|offered|permitted|possible|supported|an\s+option)"
GRANT, CLAUSE_TEXT = r"(?:offer|allow|permit|support|provide|accommodate|approve)", r"(?:(?!\b(?:and|but|while|whereas|however)\b)[^,.!?;\n])"
ON_SITE = r"\b(?:on[ _-]?site|office[ -]based)\b"
NOT_THE_ROLE = (
    rf"\b(?:company|organization|business|team|workforce|staff|employees?)\b[^,.!?;\n]{{0,48}}\b(?:is|are|works?|operates?|collaborates?)\b[^,.!?;\n]{{0,32}}{REMOTE}|"
    rf"{REMOTE}[^,.!?;\n]{{0,24}}\b(?:company|organization|business|team|workforce)\b|\b(?:benefits?|perks?)\b[^,.!?;\n]{{0,48}}{REMOTE}"
)
DENIED_BEFORE = (
    rf"\bnon[ -]?remote\b|\bno\s+(?:longer\s+)?(?:fully\s+)?{REMOTE}|\bno\s+(?:option|possibility|opportunity)\b{CLAUSE_TEXT}{{0,32}}{REMOTE}|\b(?:never|without)\s+(?:an?\s+|any\s+)?{REMOTE}|"
    rf"\b(?:cannot|can't|can not)\b{CLAUSE_TEXT}{{0,32}}{REMOTE}|\bnot(?!\s+only\b)\s+(?:currently\s+)?(?:an?\s+)?{REMOTE}|\b(?:do|does|did|will|would)\s+not\s+{GRANT}\b{CLAUSE_TEXT}{{0,32}}{REMOTE}|"
    rf"\b(?:don't|doesn't|didn't|won't|wouldn't)\s+{GRANT}\b{CLAUSE_TEXT}{{0,32}}{REMOTE}"
)
DENIED_AFTER = (
    rf"{REMOTE}{CLAUSE_TEXT}{{0,64}}\b(?:(?:is|are|was|were|will|would|can|could)?\s*(?:not(?!\s+only\b)|never|cannot|can't|won't|wouldn't|couldn't|isn't|aren't|wasn't|weren't)(?:\s+(?:currently|generally|yet))?\s+"
    rf"(?:be\s+)?{AVAILABLE}|(?:is|are|was|were)?\s*(?:unavailable|prohibited|forbidden|disallowed)|no\s+longer\s+{AVAILABLE})\b"
)


def said_remote(text) -> Column:
    """Whether words say that the role is remote, or deny it; null where they speak of others or of neither."""
    t = _col(text)
    return F.when(_says(t, NOT_THE_ROLE), None).when(_says(t, DENIED_BEFORE) | _says(t, DENIED_AFTER), False).when(_says(t, REMOTE), True).when(_says(t, ON_SITE), False)


def agreed_remote(quote, description) -> Column:
    """What all clauses that hold a quote say, if they agree with the quote itself; an attendance that the description states outweighs them."""
    q, d = _col(quote), F.coalesce(_col(description), F.lit(""))
    mode, said = attendance(d)["mode"], said_remote(q)
    agree = let(F.array_distinct(F.transform(clauses_with(q, d, closed=True), said_remote)), lambda values: F.when(F.size(values) == 1, F.get(values, F.lit(0))))
    told = F.when(mode == "on-site", False).when(mode.isNull(), agree)
    return F.when(told == said, said)


def remote_fact(quote, description) -> Column:
    """(value, quote) of a remote fact by its quote: an invalid quote stays without a value, an ambiguous one goes with it."""
    q, d = _col(quote), F.coalesce(_col(description), F.lit(""))
    sound = q.isNotNull() & (F.btrim(q) != "") & F.contains(d, q)
    value = F.when(sound, agreed_remote(q, d))
    return let(value, lambda v: F.struct(v.alias("value"), F.when(~sound | v.isNotNull(), q).alias("quote")))


def _quote_error(value: Column, quote: Column, text: Column, field: str) -> Column:
    """An error if a value isn't in its quote as words, the quote not in the text, or there is a quote of nothing."""
    named = F.concat(F.lit(r"(?iU)(?<!\w)\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?!\w)"))
    held = F.coalesce((F.btrim(quote) != "") & F.contains(text, quote), F.lit(False))
    spoken = F.coalesce((F.btrim(value) != "") & (F.regexp_count(quote, named) > 0), F.lit(False))
    bad = F.when(value.isNull(), quote.isNotNull()).otherwise(~held | ~spoken)
    return F.when(bad, F.struct(F.lit("evidence_quote").alias("category"), F.lit(field).alias("field")))


FACTS = (
    "struct<location:struct<value:string,quote:string>,remote:struct<value:boolean,quote:string>,seniority:struct<value:string,quote:string>,stack:array<struct<value:string,quote:string>>>"
)


def facts_error(facts, description, title) -> Column:
    """(category, field) of the first thing that is wrong with extracted facts (FACTS), or null.

    In order: quotes of location, remote and seniority (this one's in the title
    where the title tells it), a place that is the company's, a remote value
    that its clauses don't agree on, and each technology's quote or repeat.
    """
    f, d, t = _col(facts), F.coalesce(_col(description), F.lit("")), F.coalesce(_col(title), F.lit(""))
    error = lambda when, category, field: F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(category).alias("category"), F.lit(field).alias("field")))
    place, remote, grade = f["location"], f["remote"], f["seniority"]
    remote_held = F.coalesce((F.btrim(remote["quote"]) != "") & F.contains(d, remote["quote"]), F.lit(False))
    told_by_title = F.coalesce(title_seniority(t)["level"].isNotNull(), F.lit(False))
    elsewhere = F.exists(clauses_with(place["quote"], d), lambda c: _says(c, COMPANY_PLACE))
    names = F.transform(f["stack"], lambda s: F.lower(F.btrim(s["value"])))
    each = F.transform(f["stack"], lambda s, i: F.coalesce(_quote_error(s["value"], s["quote"], d, "stack"), error(s["value"].isNull(), "evidence_quote", "stack"), error(F.array_position(names, F.get(names, i)) <= i, "stack_uniqueness", "stack")))
    return F.coalesce(
        _quote_error(place["value"], place["quote"], d, "location"),
        error(F.when(remote["value"].isNull(), remote["quote"].isNotNull()).otherwise(~remote_held), "evidence_quote", "remote"),
        _quote_error(grade["value"], grade["quote"], F.when(told_by_title, t).otherwise(d), "seniority"),
        error(place["value"].isNotNull() & elsewhere, "location_context", "location"),
        error(remote["value"].isNotNull() & ~F.coalesce(agreed_remote(remote["quote"], d) == remote["value"], F.lit(False)), "remote_consistency", "remote"),
        F.get(F.array_compact(each), F.lit(0)),
    )


#: Fields and vocabulary of an annotation, and evidence that is set apart.
FIELDS = ("employer_type", "seniority_real", "fit_score", "fit_tier", "recommendation", "reasons", "fit_line", "fit_line_evidence_ids")
REASON_FIELDS = ("factor", "basis", "assessment", "evidence_ids", "detail")
BASES = {"product_role_match": "comparison", "stack_domain_evidence": "comparison", "seniority_gap": "comparison", "employer_type": "posting", "preferences": "comparison"}
TIERS = {"strong": (80, 100), "good": (60, 79), "stretch": (40, 59), "weak": (0, 39)}
RECOMMENDATIONS, EMPLOYERS, ASSESSMENTS = ("apply", "referral", "review", "skip"), ("direct", "agency", "unknown"), ("positive", "mixed", "negative", "unknown")
MCP_EVIDENCE, WITHHELD = ("brainlayer", "voicelayer", "cmuxlayer"), ("profile:open-to", "profile:preferences")
ABSTAINED = "Preferences and open-to information are withheld; no candidate fact or fit effect is assessed."
OF_CANDIDATE = r"\b(?:candidate|profile|resume)\b|^\s*(?:built|shipped|uses|demonstrated|has|brings)\b|\b(?:their|his|her)\s+(?:experience|skills?|background)\b"
ANNOTATION = (
    "struct<employer_type:string,seniority_real:boolean,fit_score:int,fit_tier:string,recommendation:string,reasons:array<struct<factor:string,basis:string,assessment:string,evidence_ids:array<string>,detail:string>>,"
    "fit_line:string,fit_line_evidence_ids:array<string>>"
)


def annotation_error(annotation, allowed, posting_id, expected=None, never=None, prohibited=None) -> Column:
    """The first rule that an annotation (JSON) breaks, or null.

    ``allowed``: ids of evidence; ``posting_id``: that of the posting, which each
    reason and the line must cite; ``expected``: the recommendation that a
    person's verdict asks for, if any; ``never``: phrases that nothing may claim;
    ``prohibited``: map of evidence to phrases that may not be claimed from it.
    """
    text, ids, own = _col(annotation), _col(allowed), _col(posting_id)
    wanted = F.lit(None).cast("string") if expected is None else _col(expected)
    claims = F.array().cast("array<string>") if never is None else _col(never)
    scoped = F.create_map().cast("map<string,array<string>>") if prohibited is None else _col(prohibited)
    lit = lambda xs: F.array(*map(F.lit, xs))
    kinds = let(F.try_parse_json(text), lambda v: F.struct(*[F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")).alias(k) for k in ("fit_score", "seniority_real", "fit_line")]))

    def holds(said: Column, phrases: Column) -> Column:
        return F.exists(F.coalesce(phrases, F.array().cast("array<string>")), lambda p: F.coalesce((F.btrim(p) != "") & F.contains(F.lower(said), F.lower(F.btrim(p))), F.lit(False)))

    def forbidden(said: Column, cited: Column) -> Column:
        return holds(said, claims) | F.exists(cited, lambda i: holds(said, F.try_element_at(scoped, i)))

    def unproven(said: Column, cited: Column) -> Column:
        return _says(said, r"\bMCP\b") & ~F.arrays_overlap(cited, lit(MCP_EVIDENCE))

    def first(*rules) -> Column:
        return reduce(lambda rest, r: F.when(F.coalesce(r[0], F.lit(True)), r[1]).otherwise(rest), reversed(rules), F.lit(None).cast("string"))

    def reason_error(r: Column) -> Column:
        cited = F.array_remove(F.array_distinct(r["evidence_ids"]), own)
        withheld = F.arrays_overlap(cited, lit(WITHHELD))
        abstains = (r["factor"] == "preferences") & (r["assessment"] == "unknown") & (F.size(F.array_except(cited, lit(WITHHELD))) == 0) & (r["detail"] == ABSTAINED)
        bases = F.create_map(*[F.lit(x) for kv in BASES.items() for x in kv])
        return first(
            (F.element_at(bases, r["factor"]).isNull(), "reason_factor"), (F.element_at(bases, r["factor"]) != r["basis"], "reason_basis"), (~r["assessment"].isin(*ASSESSMENTS), "reason_assessment"),
            ((F.size(r["evidence_ids"]) == 0) | F.exists(r["evidence_ids"], lambda i: F.coalesce(i == "", F.lit(True))) | (F.size(F.array_except(r["evidence_ids"], ids)) > 0) | ~F.array_contains(r["evidence_ids"], own), "reason_evidence"),
            ((r["basis"] == "posting") & (F.size(r["evidence_ids"]) != 1), "posting_evidence_only"), ((r["basis"] == "comparison") & (F.size(cited) == 0), "comparison_evidence"), (F.btrim(r["detail"]) == "", "reason_detail"),
            (withheld & ~abstains, "withheld_evidence"), ((r["basis"] == "posting") & _says(r["detail"], OF_CANDIDATE), "posting_speaks_of_candidate"), (forbidden(r["detail"], cited), "forbidden_claim"), (unproven(r["detail"], cited), "unproven_mcp"),
        )

    def told(x: Column) -> Column:
        a, reasons = x["a"], x["a"]["reasons"]
        line_ids = a["fit_line_evidence_ids"]
        cited = F.array_remove(line_ids, own)
        in_tier = reduce(lambda rest, kv: F.when(a["fit_tier"] == kv[0], a["fit_score"].between(*kv[1])).otherwise(rest), TIERS.items(), F.lit(False))
        keys = F.json_object_keys(text)
        same = lambda have, want: (F.size(have) == len(want)) & (F.size(F.array_except(lit(want), have)) == 0)
        raw = F.from_json(F.get_json_object(text, "$.reasons"), "array<map<string,string>>")
        return first(
            (~same(keys, FIELDS), "fields"), (~a["employer_type"].isin(*EMPLOYERS), "employer_type"), (~x["kinds"]["seniority_real"].isin("BOOLEAN", "VOID"), "seniority_real"),
            (~F.startswith(x["kinds"]["fit_score"], F.lit("BIGINT")) | ~a["fit_score"].between(0, 100), "fit_score"), (~in_tier, "fit_tier"), (~a["recommendation"].isin(*RECOMMENDATIONS), "recommendation"),
            (wanted.isNotNull() & (a["recommendation"] != wanted), "expected_recommendation"), (F.size(reasons) != len(BASES), "reasons"), (F.exists(raw, lambda m: ~same(F.map_keys(m), REASON_FIELDS)), "reason_fields"),
            (F.size(F.array_distinct(F.transform(reasons, lambda r: r["factor"]))) != len(BASES), "reason_factor"),
            (F.exists(reasons, lambda r: reason_error(r).isNotNull()), F.get(F.array_compact(F.transform(reasons, reason_error)), F.lit(0))),
            ((F.size(line_ids) < 2) | F.exists(line_ids, lambda i: F.coalesce(i == "", F.lit(True))) | (F.size(F.array_distinct(line_ids)) != F.size(line_ids)) | (F.size(F.array_except(line_ids, ids)) > 0) | ~F.array_contains(line_ids, own), "line_evidence"),
            (F.arrays_overlap(cited, lit(WITHHELD)), "withheld_evidence"), (F.btrim(a["fit_line"]) == "", "fit_line"), (forbidden(a["fit_line"], cited), "forbidden_claim"), (unproven(a["fit_line"], cited), "unproven_mcp"),
            ((a["fit_tier"] == "weak") & ~F.startswith(a["fit_line"], F.lit("Weak fit —")), "weak_line"),
        )

    return let(F.struct(F.from_json(text, ANNOTATION).alias("a"), kinds.alias("kinds")), told)
