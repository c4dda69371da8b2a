"""Queries of scalar functions: each row of documents takes one of a list of cases, and the oracle holds what the rule says of it, written by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import evidence, gate, keyword, places, texts
from ..operators import cohort, views, writes
from .queries import ORACLES, QUERIES
from .views import table

KNOWN = places.Gazetteer(
    cities={"israel": ("tel aviv", "haifa"), "united states": ("austin", "new york"), "germany": ("berlin",)}, own={"israel": ("israel", "il"), "united states": ("united states", "usa", "us"), "germany": ("germany", "de")},
    countries=("israel", "il", "united states", "usa", "us", "germany", "de", "ca", "canada"), aliases={"israel": ("Eretz",)},
)


def _duck(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(_duck, value)) + "]"
    return "'" + value.replace("'", "''") + "'"


def _kind(values: list) -> str:
    known = [v for v in values if v is not None]
    if not known or isinstance(known[0], str):
        return "string"
    if isinstance(known[0], (list, tuple)):
        return f"array<{_kind([x for v in known for x in v])}>"
    return "boolean" if isinstance(known[0], bool) else "double" if isinstance(known[0], float) else "int"


#: Line ends between a case and the text behind it: more than any rule looks ahead.
APART = 250


def cases(name: str, given: list[tuple], within: tuple[int, str] | None = None, once=None, **wanted: tuple):
    """Registers a query: ``given`` are rows of inputs, ``wanted`` columns of (what computes it from inputs c0, c1, …, its values).

    ``within`` (k, column) puts input k before each whole text of documents, or
    each page's markup: what the rule says of the case must hold there too.
    ``once`` makes a column ``made`` that several of ``wanted`` read.
    """
    n, inputs = len(given), list(zip(*given))
    source, key = ("pages", "page_id") if within and within[1] == "html" else ("documents", "doc_id")

    def run(spark, d):
        rows = table(spark, d, source).select(F.col(key).alias("doc_id"), *([F.expr(within[1]).alias("whole")] if within else []))
        at = F.pmod("doc_id", F.lit(n)).cast("int")
        for k, values in enumerate(inputs):
            one = lambda v: F.array(*map(F.lit, v)) if isinstance(v, (list, tuple)) else F.lit(v)
            rows = rows.withColumn(f"c{k}", F.get(F.array(*[one(v) for v in values]).cast(f"array<{_kind(list(values))}>"), at))
        if within:
            rows = rows.withColumn(f"c{within[0]}", F.concat(f"c{within[0]}", F.lit("\n" * APART), "whole"))
        rows = rows.withColumn("made", once()) if once else rows
        return rows.select("doc_id", *[make().alias(c) for c, (make, _) in wanted.items()])

    for c, (_, values) in wanted.items():
        assert len(values) == n, (name, c, len(values), n)
    typed = {"string": "VARCHAR", "int": "INTEGER", "boolean": "BOOLEAN", "double": "DOUBLE", "array<string>": "VARCHAR[]"}
    picked = ", ".join(f"CAST({_duck(list(values))} AS {typed[_kind(list(values))]}[])[{key} % {n} + 1] AS {c}" for c, (_, values) in wanted.items())
    QUERIES[name], ORACLES[name] = run, f"SELECT {key} AS doc_id, {picked} FROM {source}"


#: Texts in French hold a word that counts as a label.
_NO_AI = "regexp_replace(text, '(?i)ai', 'o')"
cases("hard_exclusions", [(t,) for t in ("Embedded Engineer", "Data Scientist", "data-sciences intern", "Staff Engineer", "Head of Growth", "Team Leads", "Leadership coach", "Principal", "Full Stack Developer", None)],
    out=(lambda: texts.hard_excluded("c0"), [True, True, True, True, True, True, False, True, False, False]))
cases("employer_classes", within=(2, "text"), given=[
    ("linkedin", "Acme", "Executive search for a bank"), ("greenhouse", "Acme", "We build."), ("lever", "Got Friends Ltd", "We build."), ("linkedin", "Acme", "For our client, a bank"),
    ("linkedin", "Acme", "We build."), ("ashby", "Talent-HR", ""), ("comeet", "Talentless HR", None), ("linkedin", "Acme", "זו החברה המגייסת"),
], out=(lambda: texts.employer_class("c0", "c1", "c2"), ["headhunter", "direct", "staffing", "staffing", "unknown", "staffing", "direct", "staffing"]))
cases("role_types", [(t,) for t in (
    "Senior Full Stack Developer", "Front-End Engineer", "AI Engineer", "Voice AI Engineer", "Speech Scientist", "Full-Stack Hardware Engineer", "Frontend & Full Stack Developer", "Software Engineer II - Front-End",
    "Frontend Evangelist", "AI Sales Manager", "Machine Learning Researcher", "AI Builder Engineer", "LLM Platform Engineer, Payments", "Accountant", "AI voice frontend developer", "AI Security – Software Engineer", None)],
    out=(lambda: texts.role_type("c0"), ["fullstack", "frontend", "ai", "voice", "voice", None, None, "frontend", None, None, "ai", None, "ai", None, None, "ai", None]))
cases("title_seniorities", [(t,) for t in (
    "Senior Engineer", "Sr. Developer", "Senior Staff Engineer", "Junior QA", "Engineering Manager", "Product Manager", "Head of Data", "Headmaster", "Manager, Software Engineering", "Engineering Program Manager",
    "VP Sales", "בכיר מפתח", "Developer", "Principal", "Senior Sr Engineer", None, "הבכיר מפתח", "seniorè dev", "Engineering\xa0Manager", "Product\u2009Manager")],
    level=(lambda: texts.title_seniority("c0")["level"], ["senior", "senior", None, "junior", "lead_manager", None, "lead_manager", None, "lead_manager", None, "lead_manager", "senior", None, "staff_principal", "senior", None, None, None, "lead_manager", None]),
    remark=(lambda: texts.title_seniority("c0")["remark"], [None, None, "Senior Staff Engineer", None, None, "Product Manager", None, None, None, "Engineering Program Manager", None, None, None, None, None, None, None, None, None, "Product\u2009Manager"]))
cases("skill_lists", within=(1, "text"), given=[
    (["reactjs", "React", " k8s "], "We use TypeScript, Python and SQL Server."), (["Custom"], "React Native apps in react.js"), ([], "golang; experience with Go"), (["c#"], "C# and C++, .NET"), (None, None),
    (["Node js"], "let us go home"), ([], "Java and Spring with sql"), ([], "using express on node.js"),
], skills=(lambda: texts.skills_mentioned("c0", "c1"), [
    ["React", "Kubernetes", "TypeScript", "Python", "SQL Server"], ["Custom", "React Native", "React"], ["Go"], ["C#", "C++", ".NET"], [], ["Node.js"], ["Java", "SQL", "Spring"], ["Node.js", "Express"]]),
   mentions=(lambda: texts.technology_mentions("c1"), [["TypeScript", "Python", "SQL Server"], ["React Native", "React"], ["Go"], ["C#", "C++", ".NET"], [], [], ["Java", "SQL", "Spring"], ["Node.js", "Express"]]))
cases("technology_chips", [(["React", "react ", "Node.js", "  Go  lang", "GO LANG", ""],), ([],), (["a", "b", "c", "d", "e"],)],
    names=(lambda: texts.unique_technologies("c0"), [["React", "Node.js", "Go lang"], [], ["a", "b", "c", "d", "e"]]),
    visible=(lambda: texts.chip_window("c0", 2)["visible"], [["React", "Node.js"], [], ["a", "b"]]), hidden=(lambda: texts.chip_window("c0", 2)["hidden"], [1, 0, 3]))
cases("posting_modes", [
    ("Hybrid", None, "x"), ("fully remote", None, None), ("other", True, "Haifa"), (None, False, "Remote"), (None, None, "Berlin (Hybrid)"), (None, None, "Berlin - Remote"), (None, None, "Remote - Berlin"),
    (None, None, "Remote or Hybrid"), (None, None, "Berlin (EU) Remote"), (None, None, "On-site"), (None, None, "Remote (Spain)"), (None, None, "Haifa"), (None, None, None), ("On site", None, None),
], mode=(lambda: texts.posting_mode("c0", "c1", "c2")["mode"], ["hybrid", "remote", "remote", "on-site", "hybrid", "remote", "remote", None, None, "on-site", "remote", None, None, "on-site"]),
   source=(lambda: texts.posting_mode("c0", "c1", "c2")["source"], ["structured", "structured", "structured", "structured", "location", "location", "location", None, None, "location", "location", None, None, "structured"]),
   facts=(lambda: texts.facts_mode("c0", "c1", "c2"), ["hybrid", "remote", "remote", "onsite", "hybrid", "remote", "remote", "remote", "remote", "onsite", "remote", "onsite", "onsite", "onsite"]))
cases("location_facts", once=lambda: places.location_facts("c0"), given=[(t,) for t in (
    "Tel Aviv, Israel", "Austin, TX", "Israel, TX", "Springfield, IL", "Greater Chicago Area; Haifa", "Remote | Berlin", "USA", "Herzliya / New York", "Paris · ", "Israel, CO", "Columbia, South Carolina Metropolitan Area", None, "Ra’anana\nRa'anana")],
    countries=(lambda: F.col("made")["countries"], [["IL"], ["US"], ["US"], ["US"], ["US", "IL"], [], ["US"], ["IL", "US"], [], ["US"], ["US"], [], ["IL"]]),
    regions=(lambda: F.col("made")["regions"], [["IL-TA"], ["US-TX"], ["US-TX"], ["US-IL"], ["US-IL", "IL-HA"], [], [], ["IL-TA", "US-NY"], [], ["US-CO"], ["US-SC"], [], ["IL-TA"]]),
    cities=(lambda: F.col("made")["cities"], [["Tel Aviv"], ["Austin"], ["Israel"], ["Springfield"], ["Chicago", "Haifa"], [], [], ["Herzliya", "New York"], [], ["Israel"], ["Columbia"], [], ["Ra'anana"]]),
    unresolved=(lambda: F.col("made")["unresolved"], [[], [], [], [], [], ["Berlin"], [], [], ["Paris"], [], [], [], []]))
cases("israeli_locations", [(t,) for t in ("Tel Aviv-Yafo", "3 Locations, Israel", "TLV and across Israel", "Gush Dan Area", "Center District, Israel", "Petach-Tikva", "north district", "תל אביב", "Tel Aviv District", "Berlin")],
    out=(lambda: places.normalized_israeli_location("c0"), ["Tel Aviv", "Israel", "Tel Aviv and Israel", "Gush Dan", "Central Israel, Israel", "Petah Tikva", "northern Israel", "Tel Aviv", "Tel Aviv", "Berlin"]))
_SITES = [("Tel Aviv, Israel", None), ("Haifa", None), ("Haifa, Germany", None), ("Austin, TX", None), ("Austin, Canada", None), ("Berlin, TX", None), ("Remote", None), ("Paris", True), ("Greater Israel area", None), ("ERETZ", None), (None, None)]
cases("location_matches", _SITES,
    israel=(lambda: places.location_matches("c0", "c1", "israel", KNOWN), [True, True, False, False, False, False, False, False, True, True, False]),
    us=(lambda: places.location_matches("c0", "c1", "united states", KNOWN), [False, False, False, True, False, False, False, False, False, False, False]),
    germany=(lambda: places.location_matches("c0", "c1", "germany", KNOWN), [False, False, True, False, False, False, False, False, False, False, False]),
    remote=(lambda: places.location_matches("c0", "c1", "Remote", KNOWN), [False, False, False, False, False, False, True, True, False, False, False]))
cases("gate_rules", within=(1, "text"), given=[
    ("Developer", "You must already live in the US."), ("Developer", "You must already live in the US or relocate."), ("QA Engineer", "x"), ("QA AI Engineer", "x"), ("Support Engineer", "x"), ("CTO", "x"), ("Team Lead", "x"),
    ("Senior to Staff Engineer", "x"), ("Java Developer", "x"), ("Developer (C++", "x"), ("Developer", "Equity-only role"), ("Developer", "This is not equity-only"), ("Developer", "At least eight years of experience"),
    ("Developer", "Our company has 10 years of experience"), ("Developer", "Bachelor degree required"), ("Developer", "Bachelor degree or equivalent required"), ("Developer", "Degree is not required"),
    ("Developer", "Bachelor degree required is a plus"), ("Developer", "Strong marketing background"), ("Developer", "Marketing background or sales, strong"), ("Developer", "דרישות:\nלפחות 8 שנות ניסיון בפיתוח"), ("Developer", "דרישות:\nלפחות 8 שנות ניסיון יתרון"),
    ("Developer", None), ("Developer", "Fine.\n7-10 years building things"), ("Developer", "6+ years of experience"),
    ("Developer", "At least 8\xa0years of experience"), ("Developer", "8 or  more years of experience"), ("QA\u2009Engineer", "x"), ("Developer", "You must already\xa0live in the\u2009US."), ("CTOé", "x"), ("Developer", "8\u2003or more\xa0years of experience"),
], rule=(lambda: gate.gate_rule("c0", "c1"), [
    "already-us-resident", None, "pure-qa-title", None, "support-title", "technical-cofounder-title", "leadership-title-strict", None, "incompatible-stack-title", "incompatible-stack-title", "equity-only", None, "years-minimum-7-strict",
    None, "mandatory-degree", None, None, None, "specialist-required", None, "years-minimum-7-strict", None, None, "years-minimum-7-strict", None,
    "years-minimum-7-strict", None, "pure-qa-title", "already-us-resident", None, "years-minimum-7-strict"]),
   resident=(lambda: gate.already_resident("c1"), [True] + [False] * 27 + [True, False, False]))
_BODY = "As a backend engineer, you will build.\n\n"
cases("quality_rules", [(t,) for t in (
    None, "  \n ", "We are hiring a [job title] to join us. [number] years of work.", "What role are you interested in?\n\nAs an engineer, you will build.\n\nAs a designer, you'll draw.", _BODY + "Nothing else.",
    "Open positions\n- [Senior Engineer](https://a.b/1)\n- [Designer](https://a.b/2)", "Open positions\n- [Senior Engineer](https://a.b/1)\nMore text\n- [Designer](https://a.b/2)",
    "Acme is hiring a senior engineer to join our team. \nFull job description: https://a.b/c", "Acme is hiring a senior engineer to join our team. You will need Go.\nFull job description: https://a.b/c", "Fine text.")],
    rule=(lambda: gate.quality_rule("c0"), ["jd-quality-missing-body", "jd-quality-missing-body", "jd-quality-unfilled-template", "jd-quality-mixed-role", None, "jd-quality-listing-only", None, "jd-quality-external-summary", None, None]),
    decided=(lambda: gate.decided_rule(F.lit("QA Engineer"), "c0", F.lit(False)), ["jd-quality-missing-body", "jd-quality-missing-body", "jd-quality-unfilled-template", "jd-quality-mixed-role", "pure-qa-title", "jd-quality-listing-only", "pure-qa-title", "jd-quality-external-summary", "pure-qa-title", "pure-qa-title"]))
cases("number_words", [(t,) for t in ("seven years", "Twelve-year plan", "two to three years", "one of us", "TWENTY years", "seventeen years, six – ten", "eleven")],
    out=(lambda: gate.digits_for_words("c0"), ["7 years", "12-year plan", "2 to 3 years", "one of us", "20 years", "17 years, 6 – ten", "eleven"]))
cases("ats_boards", [(t,) for t in (
    "https://www.comeet.com/jobs/acme/A1.2/x", "https://boards.greenhouse.io/acme/jobs/1", "https://job-boards.eu.greenhouse.io/acme", "https://boards-api.greenhouse.io/v1/boards/acme/jobs", "https://jobs.lever.co/acme/1",
    "https://api.lever.co/v0/postings/acme", "https://careers.smartrecruiters.com/Acme", "https://jobs.ashbyhq.com/acme/1?x=2", "https://apply.workable.com/acme/j/X", "https://apply.workable.com/j/X", "http://jobs.lever.co/acme",
    "https://user@jobs.lever.co/acme", "https://jobs.lever.co:444/acme", "https://jobs.lever.co:443/acme", "https://jobs.lever.co/", "https://acme.com/jobs", "https://jobs.lever.co/a%20b", None)],
    source=(lambda: texts.ats_detected("c0")["source"], ["comeet", "greenhouse", "greenhouse", "greenhouse", "lever", "lever", "smartrecruiters", "ashby", "workable", None, None, None, None, "lever", None, None, None, None]),
    tenant=(lambda: texts.ats_detected("c0")["tenant"], ["acme/A1.2", "acme", "eu:acme", "acme", "acme", "acme", "Acme", "acme", "acme", None, None, None, None, "acme", None, None, None, None]))
_IDS = lambda: F.map_filter(F.create_map(F.lit("account"), F.col("c1"), F.lit("cluster"), F.col("c2"), F.lit("site"), F.col("c3"), F.lit("board"), F.col("c1"), F.lit("region"), F.col("c2"), F.lit("slug"), F.col("c1"), F.lit("company_uid"), F.col("c2")), lambda _, v: v.isNotNull())
cases("tenant_labels", [("workday", "a", "wd1", "s"), ("comeet", "a", "u", None), ("greenhouse", "b", "eu", None), ("greenhouse", "b", None, None), ("lever", "a", None, None)],
    label=(lambda: texts.tenant_label("c0", _IDS()), ["a:wd1:s", "a/u", "eu:b", "b", "a"]))
cases("summary_cells", [("a|b\nc", "3h ago", ""), ("x", "", "May 2"), ("", "Updated May 2", "May 2"), (None, "3h ago", "May 2"), ("|", None, None)],
    cell=(lambda: texts.markdown_cell("c0"), ["a\\|b c", "x", "", "", "\\|"]), time=(lambda: texts.posting_time("c1", "c2"), ["3h ago", "Updated May 2", "Updated May 2", "3h ago · Updated May 2", ""]))
cases("employer_labels", [
    ("Acme Ltd", "Acme Ltd", "Acme", None, None), ("Jobs R Us", "Jobs R Us", "Bank", "client", "x"), ("Jobs R Us", "Jobs R Us", None, None, "our client"), ("Jobs R Us", "Other", "Bank", None, None), ("Agent", None, None, None, None),
    ("Alpha (ABC) Labs", "Alpha (ABC) Labs", "alpha technologies inc", None, None), ("Beta", "Beta", "Gamma", "alias", None), ("Ai Inc", "Ai Inc", "Co", None, None),
], label=(lambda: views.employer_label("c0", "c1", "c2", "c3", "c4", ("agent",)), [
    "Acme Ltd", "Bank via Jobs R Us", "Jobs R Us (agency — client undisclosed)", "Jobs R Us", "Agent (agency — client undisclosed)", "Alpha (ABC) Labs", "Beta", "Co via Ai Inc"]),
   alias=(lambda: views.is_alias("c0", "c2"), [True, False, False, False, False, True, False, False]))
cases("ages", [(m,) for m in (-5, 0, 59, 60, 119, 1439, 1440, 2879, 100000, None)],
    compact=(lambda: cohort.age_bucket("c0"), ["now", "now", "now", "1h", "1h", "23h", "1d", "1d", "69d", None]),
    spoken=(lambda: cohort.spoken_age("c0"), ["just now", "just now", "just now", "1 hour ago", "1 hour ago", "23 hours ago", "1 day ago", "1 day ago", "69 days ago", None]))
cases("posting_date_kinds", [(1, 9, None), (1, 9, 5), (None, 9, 5), (None, 9, None), (5, 9, 1), (None, None, None), (5, None, 5)],
    kinds=(lambda: F.transform(cohort.posting_dates("c0", "c1", "c2"), lambda x: x["kind"]), [["posted", "found"], ["posted", "republished", "found"], ["published", "found"], ["found"], ["posted", "found"], [], ["posted"]]))
cases("repost_notes", [("linkedin", "u", "u", "Reposted 2 days ago", 1, 9), ("linkedin", "u", "v", "Reposted", 1, 9), ("lever", "u", None, None, 1, 9), ("lever", "u", None, None, 9, 9), ("lever", "u", None, None, None, 9), ("linkedin", "u", None, None, 1, 9)],
    note=(lambda: cohort.repost_note("c0", "c1", "c2", "c3", "c4", "c5", F.concat(F.lit("day "), F.col("c5").cast("string"))), ["Reposted 2 days ago", None, "Reposted: republished day 9", None, None, None]))
cases("public_addresses", [(t,) for t in ("https://jobs.lever.co/a", "https://lever.co", "http://lever.co", "https://u@lever.co", "https://lever.co:8443/", "https://lever.co:443/", "https://notlever.co", "https://a b.lever.co", None)],
    public=(lambda: texts.public_https("c0", ("lever.co", "ashbyhq.com")), [True, True, False, False, False, True, False, False, False]))
cases("search_urls", [("c++ & go", "Tel Aviv", "r43200", 0), ("ai", " Remote ", "r604800", 25), ("a~b*c", "x", "r1", 50)],
    url=(lambda: texts.search_url("c0", "c1", "c2", "c3"), [f"https://www.linkedin.com/jobs-guest/jobs/api/seeMoreJobPostings/search?{q}" for q in ("keywords=c%2B%2B+%26+go&location=Tel+Aviv&f_TPR=r43200&start=0", "keywords=ai&location=+Remote+&f_TPR=r604800&start=25&f_WT=2", "keywords=a~b%2Ac&location=x&f_TPR=r1&start=50")]),
    recency=(lambda: texts.recency_override("c2", "r10800"), ["r10800"] * 3))
cases("phrases", [("new york city", "york city"), ("new yorkcity", "york city"), ("a  b", "a b"), ("a", ""), ("", "a"), ("ab", "a")], inside=(lambda: texts.holds_phrase("c0", "c1"), [True, False, True, False, False, False]))
cases("labels_and_verdicts", [("mandatory-degree", " Applied "), ("new-rule", "interesting"), (None, "not_relevant"), ("", "who knows"), ("equity-only", None)],
    label=(lambda: views.rule_label("c0"), ["Requires a degree without an equivalent-experience option", "new-rule", "Outside current preferences", "Outside current preferences", "Equity-only compensation"]),
    verdict=(lambda: views.recommendation_of_verdict("c1"), ["apply", "referral", "skip", None, None]))
cases("status_patches", [("new", None, "new", None), ("rejected", "a", "rejected", "b"), ("rejected", "a", "rejected", None), ("new", None, "seen", None), ("seen", None, "new", None)],
    noop=(lambda: views.status_patch("c0", "c1", "c2", "c3", "new-for-me")["noop"], [True, False, True, False, False]), removes=(lambda: views.status_patch("c0", "c1", "c2", "c3", "new-for-me")["removes"], [False, True, True, True, False]))
cases("probabilities", [("a", 0.25, 0.75), ("a", 0.5, 0.6), ("a", -0.5, 1.5), ("z", 0.5, 0.5), ("a", None, 1.0)],
    sound=(lambda: writes.sound_probabilities(F.create_map("c0", "c1", F.lit("b"), "c2"), ("b", "a")), [True, False, False, False, False]))
_PAYLOAD = '{"employer_type":"direct","seniority_real":null,"fit_score":70,"fit_tier":"good","recommendation":"apply","reasons":[],"fit_line":"x","fit_line_evidence_ids":[],"luna_status":"ok"}'
_LABELS = '{"role_type":null,"seniority_match":"mixed","remote_ok":"unknown","red_flag_count":2}'
cases("score_checks", [
    (_PAYLOAD, _LABELS, 70), (_PAYLOAD, _LABELS, 71), (_PAYLOAD[:-1] + ',"more":1}', _LABELS, 70), (_PAYLOAD[:-1] + ',"eligibility":"blocked"}', _LABELS, 70), (_PAYLOAD[:-1] + ',"eligibility":"blocked","eligibility_reason":"x"}', _LABELS, 70),
    (_PAYLOAD.replace("good", "fine"), _LABELS, 70), (_PAYLOAD, _LABELS.replace("2", "7"), 70), (_PAYLOAD, None, 70), ("junk", _LABELS, 70),
], whole=(lambda: writes.complete_score("c0", "c1", "c2"), [True, False, False, False, True, False, False, False, False]))
cases("fit_caps", [(90, 8, None, "fullstack", 0), (90, 5, None, "fullstack", 0), (90, 6, None, "fullstack", 1), (90, None, None, "fullstack", 2), (90, 2, 4, "backend", 0), (90, 2, 1, "backend", 1), (50, None, None, "other", 0), (90, 5, 1, "backend", 0), (30, 9, None, "other", 0)],
    score=(lambda: writes.capped_fit("c0", "c1", "c2", "c3", "c4")["score"], [39, 59, 39, 59, 39, 55, 50, 55, 30]),
    tier=(lambda: writes.capped_fit("c0", "c1", "c2", "c3", "c4")["tier"], ["weak", "stretch", "weak", "stretch", "weak", "stretch", "stretch", "stretch", "weak"]),
    advice=(lambda: writes.capped_fit("c0", "c1", "c2", "c3", "c4")["recommendation"], ["skip", "review", "skip", "review", "skip", "review", "review", "review", "skip"]),
    rules=(lambda: writes.capped_fit("c0", "c1", "c2", "c3", "c4")["rules"], [["years_hard_block"], ["years_conditional"], ["years_conditional_unfamiliar"], ["required_unfamiliar"], ["backend_years"], ["backend_heavy"], [], ["years_conditional", "backend_heavy"], ["years_hard_block"]]))
cases("liveness_evidence", [("own", True, 200, "open", "u", 1), ("lever", True, 200, "open", "u", 1), (None, True, 200, "open", "u", 1), ("own", None, 200, "open", "u", 1), ("own", False, 99, "open", "u", 1), ("own", False, 404, "unknown", "u", 1), ("own", False, 404, "gone", " ", 1)],
    admitted=(lambda: writes.admitted_evidence("c0", "c1", "c2", "c3", "c4", "c5").isNotNull(), [True, False, False, False, False, False, False]))
cases("quotes", [("5 years of Go", "Go", "Needs 5 years of Go."), ("5 years of Go", "go", "Needs 5 years of Go."), ("5 years of Gold", "Go", "5 years of Gold"), ("missing", "missing", "text"), ("uses C++ daily", "C++", "uses C++ daily"), ("", "", ""), (None, "a", "a")],
    holds=(lambda: writes.quote_holds("c0", "c1", "c2"), [True, True, False, False, True, False, False]))
cases("embedding_texts", [(" Dev", "Body\n"), ("Dev", None), (" ", "Body")], text=(lambda: texts.embedding_text("c0", "c1"), ["Dev\nDev\nBody", None, None]))
cases("patch_modes", [("On-Site",), ("FULLY REMOTE",), ("h y b r i d",), ("office",), (None,)], mode=(lambda: texts.canonical_mode("c0"), ["on-site", "remote", "hybrid", None, None]))

_JOBS = [
    ("Full Stack Developer", "TypeScript, React and Node. AI agents."), ("AI Engineer", "LLM agents, mcp"), ("Angular Developer", "Angular required."), ("Developer", "Frameworks such as React, Angular, and Vue are welcome."),
    ("Developer", "Angular is an advantage. We use React."), ("Staff Engineer", "React"), ("ML Engineer Intern", "python"), ("Developer", "8 years of experience. C++ needed."), ("Developer", "Experience with Docker and Kubernetes is required."),
    ("Developer", "Experience with Docker or AWS required."), ("Developer", "Strong in Python."), ("Developer", "Strong Python or Java."), ("Developer", "Docker is a plus, required elsewhere"), ("Java Developer", "Java engineer"), (None, None),
    ("Developer", "C# or similar languages"), ("Developer", "including React and then Angular experience is mandatory"), ("React Native Developer", "react-native apps"),
]
cases("keyword_scores", within=(1, _NO_AI), given=_JOBS, once=lambda: keyword.keyword_score("c0", "c1"),
    score=(lambda: F.col("made")["score"], [13, 0, -6, 3, 3, -5, -12, -18, -16, 0, -16, 0, 0, -8, 0, 0, -3, -1]),
    matched=(lambda: F.col("made")["matched"], [["typescript", "react", "node", "ai", "agents"], ["agents", "llm", "mcp"], [], ["react"], ["react"], ["react"], [], [], [], [], [], [], [], [], [], [], ["react"], ["react"]]),
    negative=(lambda: F.col("made")["negative"], [[], [], ["angular"], ["angular(example-list, waived)", "vue(example-list, waived)"], [], ["staff"], ["ml-engineer", "intern"], ["c++", "8-9+ years"], ["infra:docker", "infra:kubernetes"], [],
        ["python-primary"], [], [], ["java-only"], [], [], ["angular"], ["react-native"]]),
    core=(lambda: F.col("made")["core_stack"], [True, False, False, True, True, True, False, False, False, False, False, False, False, False, False, False, True, True]),
    gated=(lambda: F.col("made")["gated"], [False, True] + [False] * 16))
cases("posting_scores", within=(2, _NO_AI), given=[("Senior AI Developer", "card", "React", True), ("Developer", "", "React", True), ("Developer", "React card", "Vue", False), ("Lead", "x", "", True)],
    whole=(lambda: keyword.score_posting("c0", "c1", "c2", "c3", ("ai-engineer", "react", "card"))["whole"]["score"], [4, 3, 0, 0]), title=(lambda: keyword.score_posting("c0", "c1", "c2", "c3")["score_title"], [0, 0, 0, 0]),
    senior=(lambda: keyword.score_posting("c0", "c1", "c2", "c3")["senior_titled"], [True, False, False, True]))
cases("rescored_rows", [(10, ["react", "ai"], ["vue"], "Developer"), (10, ["ai", "llm", "ai-engineer"], [], "QA Engineer Intern"), (10, ["agents"], ["intern"], "ML Engineer"), (0, [], [], "Staff")],
    score=(lambda: keyword.rescored("c0", "c1", "c2", "c3")["score"], [10, -8, 7, 0]), negative=(lambda: keyword.rescored("c0", "c1", "c2", "c3")["negative"], [["vue"], ["qa-only", "intern"], ["intern", "ml-engineer"], []]),
    gated=(lambda: keyword.rescored("c0", "c1", "c2", "c3")["gated"], [False, True, True, False]))
cases("years_admission", within=(0, "text"), given=[(t,) for t in (
    "You must have 8 years of experience", "Requirements:\n- 7+ years of experience", "7 years of experience", "Requirements:\n- 7+ years of experience is a plus", "Minimum 10 years building software", "At least seven years of experience",
    "8 years of experience or a degree", "Preferred:\n- 8+ years of experience", "8 years experience is required for this role", "with 9 years of experience required", "Our company has 20 years of experience", "6+ years of experience. You must have it",
    "Requirements:\n- 8+ years of Python", "Qualifications: 12 years of experience", "10 years of experience are not required", None, "Requirements:\n- 8-10 years of experience\nBenefits:\n- 9+ years of experience", "You must have 8\xa0years\u2009of experience")],
    out=(lambda: keyword.blocks_by_years("c0"), [True, True, False, False, True, True, False, False, True, True, False, False, True, True, False, False, True, True]),
    highest=(lambda: keyword.highest_minimum("c0"), [8, 7, 7, 7, 10, None, 8, 8, 8, 9, 20, 6, 8, 12, 10, None, 9, 8]))
cases("deadlines", within=(0, "text"), once=lambda: keyword.deadline("c0"), given=[(t,) for t in (
    "Apply now.\nApplication deadline: 2024-05-01", "**Applications close on May 3rd, 2024.**", "Application deadline: 5/6/2024", "Application deadline: 15/6/2024", "Application deadline: 2024-05-01\nApplication deadline extended to 2024-06-01",
    "Application deadline: 2024-05-01\nApplication deadline: 2024-05-02", "The project deadline: 2024-05-01", "מועד אחרון להגשת מועמדות: 3 במאי 2024", "Application deadline: 2024-05-01T10:00:00+02:00", "Application deadline: soon", None, "Application deadline: 2024-02-31")],
    deadline=(lambda: F.col("made")["deadline"], ["2024-05-02T12:00:00Z", "2024-05-04T12:00:00Z", None, "2024-06-16T12:00:00Z", "2024-06-02T12:00:00Z", None, None, "2024-05-04T12:00:00Z", "2024-05-01T08:00:00Z", None, None, None]),
    unclear=(lambda: F.col("made")["unclear"], [False, False, True, False, False, True, False, False, False, True, False, True]))
cases("role_keys", [(t,) for t in (
    "https://boards.greenhouse.io/acme/jobs/12", "https://job-boards.eu.greenhouse.io/acme/jobs/12/", "https://apply.workable.com/acme/j/AB/", "https://apply.workable.com/acme/jobs/view/AB.md", "https://jobs.lever.co/acme/0123456789ab-0123456789ab-0123456789/apply",
    "https://www.comeet.com/jobs/acme/1.2/dev/3.4", "https://il.linkedin.com/jobs/view/dev-at-acme-123", "https://acme.com/careers", "not an address", None)],
    key=(lambda: evidence.role_key("c0"), ["greenhouse:us:acme:12", "greenhouse:eu:acme:12", "workable:acme:AB", "workable:acme:AB", "lever:acme:0123456789ab-0123456789ab-0123456789", "comeet:acme:1.2:dev", "linkedin:123", None, None, None]))
cases("requisitions", [
    ("https://boards.greenhouse.io/acme/jobs/12345", "Req ID: 12345 and requisition number R-77."), ("https://x.myworkdayjobs.com/site/job/Dev_JR00012-1", "JR99999 too, see https://a.b/JR88888"), ("https://a.b", "job requisition ab-12_3"), ("https://a.b", "no requirement 5 here"), (None, None),
    ("https://www.linkedin.com/jobs/view/777/", "Req: JR777, req #778"),
], found=(lambda: evidence.requisitions(F.array_compact(F.array("c0")), "c1"), [["R-77"], ["JR00012", "JR99999"], ["AB-12_3"], [], [], ["778"]]))
_LONG_BODY = "Build things with us every day of the week. " * 12
cases("body_fingerprints", [(_LONG_BODY, "<p>" + _LONG_BODY.replace("things", "**things**") + "</p>\n\nWe are an equal opportunity employer and more."), (_LONG_BODY, _LONG_BODY + "x"), ("short", "short"), (None, None), (_LONG_BODY, _LONG_BODY.upper())],
    same=(lambda: F.coalesce(evidence.fingerprint("c0") == evidence.fingerprint("c1"), F.lit(False)), [True, False, False, False, True]))
cases("place_hints", once=lambda: evidence.place_hints("c0"), given=[(t,) for t in ("Tel Aviv-Yafo, Israel", "Haifa District", "Austin, TX", "Wayne", "Texas", "Berlin, Germany", "Remote, Germany", "London (HQ)", "Washington, DC", "", None, "New York, New York, United States", "Center District, Israel", "Seattle or Austin, TX, USA")],
    countries=(lambda: F.col("made")["countries"], [["israel"], ["israel"], ["us"], ["us"], ["us"], ["germany"], ["germany"], [], ["us"], [], [], ["us"], ["israel"], ["us"]]),
    region=(lambda: F.col("made")["region"], ["tel aviv", "haifa", "tx", "pa", "tx", None, None, None, None, None, None, "ny", "center", "tx"]),
    city=(lambda: F.col("made")["city"], ["tel aviv", None, "austin", "wayne", None, "berlin", None, None, None, None, None, None, None, "seattle or austin"]))
cases("company_identities", [(" Ａcme\t Co ",), ("ﬁrm",), ("ACME  co",), (None,)], key=(lambda: evidence.identity_text("c0"), ["acme co", "firm", "acme co", ""]))
