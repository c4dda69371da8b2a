"""Queries over texts of documents in which SQL plants what a rule looks for; the oracle says in SQL, by another way, what the rule must find."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import eligibility, experience, gazetteer, guest, places, salary, stack, validators
from ..operators import attribution, liveness, requirements
from .queries import ORACLES, QUERIES
from .views import table


def _pick(values: tuple[str, ...], by: int, of: str = "doc_id") -> str:
    """SQL, the same in both engines: one of ``values`` by the id's remainder after it was divided by ``by``."""
    whens = " ".join("WHEN {} THEN '{}'".format(k, v.replace("'", "''")) for k, v in enumerate(values))
    return f"CASE CAST(floor({of} / {by}) AS BIGINT) % {len(values)} {whens} END"


def planted(name: str, rows: dict[str, str], made, oracle: str):
    """Registers a query: ``rows`` are SQL columns over documents for both engines, ``made`` what the rules make of them, ``oracle`` a SELECT over the same rows as ``given``."""

    def run(spark, d):
        given = table(spark, d, "documents").selectExpr("doc_id", *[f"{sql} AS {c}" for c, sql in rows.items()])
        return given.select("doc_id", *[x.alias(c) for c, x in made().items()])

    columns = ", ".join(f"{sql} AS {c}" for c, sql in rows.items())
    QUERIES[name], ORACLES[name] = run, f"WITH given AS (SELECT doc_id, {columns} FROM documents) {oracle}"


_SAYS = (
    "Teams in New York City and Upper Galilee", "a lab near Tel Aviv-Yafo, Israel", "it is in South Korea", "we serve IT people in US offices", "בישראל", "Paris or São Paulo", "Kibbutz Sasa and Sasa", "no place at all", "worldwide",
    "join us to do it",
)
_NAMES = r"New York City|New York|Upper Galilee|Galilee|Tel Aviv-Yafo|Tel Aviv|Israel|South Korea|\bIT\b|ישראל|Paris|São Paulo|Kibbutz Sasa|Sasa|worldwide"
_ASKED = ("new york city", "new york", "upper galilee", "galilee", "tel aviv yafo", "tel aviv", "israel", "south korea", "it", "ישראל", "paris", "são paulo", "kibbutz sasa", "sasa", "worldwide")
_KINDS = {"noncentral": ("upper galilee", "kibbutz sasa", "sasa"), "israel": ("tel aviv yafo", "israel", "ישראל"), "worldwide": ("worldwide",)}
planted(
    "places_named",
    {"said": f"concat(text, '\n', {_pick(_SAYS, 1)})"},
    lambda: {"places": F.transform(F.filter(gazetteer.places_in("said"), lambda p: p["name"].isin(*_ASKED)), lambda p: F.concat_ws("=", p["name"], p["kind"]))},
    f"""SELECT doc_id, list_transform(list_transform(regexp_extract_all(said, '{_NAMES}'), lambda x: lower(replace(x, '-', ' '))),
          lambda x: concat(x, '=', CASE {" ".join(f"WHEN x IN {tuple(v) if len(v) > 1 else repr(v).replace(',', '')} THEN '{k}'" for k, v in _KINDS.items())} ELSE 'foreign' END)) AS places FROM given""",
)
planted(
    "places_meant",
    {"said": f"concat({_pick(_SAYS, 3)}, '. ', text)"},
    lambda: {"meant": gazetteer.speaks_of_places("said")},
    "SELECT doc_id, regexp_matches(said, 'New York|Galilee|Tel Aviv|Korea|in US|ישראל|Sasa|Israel') AS meant FROM given",
)

_FIELDS = ("Remote", "Tel Aviv, Israel", "Germany", "", "Israel", "Remote (Spain)")
_WHERE = ("Japan", "Israel", "Norway", "EMEA")
_CLAUSES = ("Remote in {} only.", "Candidates must reside in {}.", "On-site in {}.", "Remote worldwide except {}.", "Remote within {} or nearby.", "We like tea{}.", "No need to relocate to {}.")
_PLANTED = "CASE CAST(floor(doc_id / 24) AS BIGINT) % 7 " + " ".join(f"WHEN {k} THEN concat('{a}', place, '{b}')" for k, (a, b) in enumerate(c.split("{}") for c in _CLAUSES)) + " END"
planted(
    "location_verdicts",
    {
        "location": _pick(_FIELDS, 1),
        "place": _pick(_WHERE, 6),
        "kind": _pick(("abroad", "home", "abroad", "unclear"), 6),
        "clause": "CAST(floor(doc_id / 24) AS BIGINT) % 7",
        "description": f"concat(substr(text, 1, CAST(length(text) / 2 AS INT)), '\n', {_PLANTED.replace('place', '(' + _pick(_WHERE, 6) + ')')}, '\n', substr(text, CAST(length(text) / 2 AS INT) + 1))",
    },
    lambda: {"verdict": eligibility.location_eligibility("location", "description")["verdict"]},
    """, says AS (
        SELECT *, location IN ('Tel Aviv, Israel', 'Israel') AS at_home,
          location IN ('Tel Aviv, Israel', 'Israel', '') AS contested,
          CASE WHEN clause IN (0, 1, 2) THEN CASE kind WHEN 'home' THEN 'permits' WHEN 'abroad' THEN 'blocks' ELSE 'doubt' END
               WHEN clause = 3 THEN CASE kind WHEN 'home' THEN 'excludes' WHEN 'abroad' THEN 'permits' ELSE 'doubt' END
               WHEN clause = 4 AND NOT (kind = 'home' AND location IN ('Tel Aviv, Israel', 'Israel')) THEN 'doubt' END AS vote
        FROM given)
      SELECT doc_id, CASE
          WHEN location = 'Remote (Spain)' OR vote = 'excludes' OR (vote = 'blocks' AND NOT contested) THEN 'blocked'
          WHEN vote IN ('blocks', 'doubt') THEN 'unknown'
          WHEN at_home OR vote = 'permits' THEN 'eligible' ELSE 'unknown' END AS verdict
      FROM says""",
)

_N = "(1 + doc_id % 15)"
_ASKS = (
    "Requirements:\n{n}+ years of experience in software development", "Nice to have:\n{n} years of experience with Go", "Our company has {n} years of experience.", "You have {n}-{m} years of professional experience.",
    "Must have {n} years of experience or a relevant degree", "Tea is served at noon.", "Requirements:\n{n} years of experience\n{m} years of experience", "Minimum of {n} years'{s}experience", "דרישות:\nלפחות {n} שנות ניסיון",
)


def _said(templates: tuple[str, ...], by: int, **values: str) -> str:
    """SQL, the same in both engines: one of ``templates`` by the id's remainder, with what ``values`` give put in."""

    def spoken(template: str) -> str:
        parts = re.split(r"\{(\w+)\}", template.replace("'", "''"))
        return "concat(" + ", ".join(f"CAST({values[p]} AS STRING)" if k % 2 else f"'{p}'" for k, p in enumerate(parts)) + ")"

    return f"CASE CAST(floor(doc_id / {by}) AS BIGINT) % {len(templates)} {' '.join(f'WHEN {k} THEN {spoken(t)}' for k, t in enumerate(templates))} END"


planted(
    "experience_phrases",
    {"plant": _said(_ASKS, 1, n=_N, m=f"({_N} + 2)", s="' '"), "said": "concat(text, '\n\n', " + _said(_ASKS, 1, n=_N, m=f"({_N} + 2)", s="' '") + ")"},
    lambda: {"phrase": experience.experience_phrase("said")},
    """SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN regexp_extract(plant, '\\d+\\+ years of experience') WHEN 3 THEN regexp_extract(plant, '\\d+-\\d+ years of professional experience')
         WHEN 7 THEN regexp_extract(plant, '\\d+ years'' experience') WHEN 8 THEN regexp_extract(plant, 'לפחות \\d+ שנות ניסיון') END AS phrase FROM given""",
)

_PAYS = (
    "Salary: ${n}0,000 - ${m}0,000 per year", "We raised ${n}M in our seed round", "Pay: {n}0k to {m}0k plus bonus", "We have {n}00 employees", "Series B ${n}M, salary ${m}0,000", "{n} days a week", "שכר עד {n}0 אלף",
    "Our revenue of ${n}M and {m} customers",
)
planted(
    "salary_spans",
    {"plant": _said(_PAYS, 1, n=_N, m=f"({_N} + 2)"), "said": "concat(" + _said(_PAYS, 1, n=_N, m=f"({_N} + 2)") + ", '\n', regexp_replace(text, '[0-9%]+', '')" + ")"},
    lambda: {"span": salary.salary_span("said"), "fact": salary.normalized_salary("plant", "plant", F.lit(None).cast("string"), "said")["remark"]},
    """SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN plant WHEN 2 THEN regexp_extract(plant, 'Pay: .*k') WHEN 4 THEN regexp_extract(plant, 'salary .*') WHEN 6 THEN plant END AS span,
         CASE WHEN doc_id % 8 IN (0, 6) THEN NULL ELSE plant END AS fact FROM given""",
)

_SKILLS = ("Java", "Kotlin", "Python", "TypeScript", "Rust", "Scala", "React")
_ROLES = ("Requirements\n- Experience with {a} or {b}\n- Knowledge of {c}, {d} and {a}\n", "Nice to have\n- Experience with {a}\n", "{a} is required.\n", "Responsibilities\n- Build services using {b}\n- like {c}\n")
_SKILL = {k: _pick(_SKILLS, by) for k, by in (("a", 1), ("b", 7), ("c", 3), ("d", 5))}
_SHOWN = "({}) % 3 = 0"


def stack_gaps(spark, d):
    docs = table(spark, d, "documents").selectExpr("doc_id AS id", "doc_id % 25 AS profile", f"concat({_said(_ROLES, 1, **_SKILL)}, '\n', text) AS description")
    skills = ", ".join(f"struct('{s}' AS tag, {k} AS k)" for k, s in enumerate(_SKILLS))
    shown = table(spark, d, "nation").selectExpr("n_nationkey AS profile", f"inline(array({skills}))").where(_SHOWN.format("profile + k")).select("profile", stack.technology("tag").alias("name"))
    return requirements.stack_gaps(docs, shown, "profile").select(F.col("id").alias("doc_id"), F.array_join("gaps", "; ").alias("gaps"))


def _index(sql: str) -> str:
    return "CASE " + sql + " " + " ".join(f"WHEN '{s}' THEN {k}" for k, s in enumerate(_SKILLS)) + " END"


QUERIES["stack_gaps"] = stack_gaps
ORACLES["stack_gaps"] = f"""
    WITH said AS (SELECT doc_id, doc_id % 25 AS profile, {", ".join(f"{sql} AS {k}" for k, sql in _SKILL.items())} FROM documents JOIN nation ON n_nationkey = doc_id % 25),
    clauses AS (
      SELECT doc_id, profile, least(a, b) AS x, greatest(a, b) AS y FROM said WHERE doc_id % 4 = 0 UNION ALL SELECT doc_id, profile, c, c FROM said WHERE doc_id % 4 = 0 UNION ALL
      SELECT doc_id, profile, d, d FROM said WHERE doc_id % 4 = 0 UNION ALL SELECT doc_id, profile, a, a FROM said WHERE doc_id % 4 IN (0, 2) UNION ALL SELECT doc_id, profile, b, b FROM said WHERE doc_id % 4 = 3),
    gaps AS (SELECT DISTINCT doc_id, CASE WHEN x = y THEN x ELSE concat(x, ' or ', y) END AS gap FROM clauses
      WHERE NOT ({_SHOWN.format(f"profile + {_index('x')}")}) AND NOT ({_SHOWN.format(f"profile + {_index('y')}")}))
    SELECT doc_id, coalesce(string_agg(gap, '; ' ORDER BY gap), '') AS gaps FROM documents LEFT JOIN gaps USING (doc_id) GROUP BY doc_id"""


def experience_compared(spark, d):
    says = "Requirements:\n- {n}+ years of React\n- must have {m} years experience in backend development\n- minimum {n} years of software engineering\nPerks\n- 9 years of Angular\n"
    docs = table(spark, d, "documents").selectExpr("doc_id AS id", "doc_id % 25 AS profile", f"concat({_said((says,), 1, n=_N, m=f'({_N} + 2)')}, '\n', text) AS description")
    nations = table(spark, d, "nation")
    claims = nations.selectExpr("n_nationkey AS profile", "'verified' AS status", "concat(n_nationkey % 9, CASE WHEN n_nationkey % 2 = 0 THEN '+' ELSE '' END, ' years of React') AS claim", "concat('e', n_nationkey) AS evidence_id")
    more = nations.selectExpr("n_nationkey AS profile", "CASE WHEN n_nationkey % 3 = 0 THEN 'stated' ELSE 'verified' END AS status", "concat(n_nationkey % 11, ' years of backend development.') AS claim", "concat('b', n_nationkey) AS evidence_id")
    out = requirements.compared_experience(docs, claims.unionByName(more), nations.selectExpr("n_nationkey AS profile", "n_nationkey % 14 AS tenure_years"), "profile")
    return out.select(F.col("id").alias("doc_id"), F.col("at").cast("long").alias("nth"), "requirement_quote", "candidate_years", "assessment")


QUERIES["experience_compared"] = experience_compared
ORACLES["experience_compared"] = f"""
    WITH asked AS (SELECT doc_id, doc_id % 25 AS p, {_N} AS n FROM documents),
    rows_ AS (
      SELECT doc_id, 0 AS nth, concat(n, '+ years of React') AS q, n AS need, p % 9 AS own, p % 2 = 0 AS at_least FROM asked UNION ALL
      SELECT doc_id, 1, concat(n + 2, ' years experience in backend development'), n + 2, CASE WHEN p % 3 <> 0 THEN p % 11 END, false FROM asked UNION ALL
      SELECT doc_id, 2, concat(n, ' years of software engineering'), n, p % 14, false FROM asked)
    SELECT doc_id, CAST(nth AS BIGINT) AS nth, q AS requirement_quote, CAST(own AS DOUBLE) AS candidate_years,
      CASE WHEN own IS NULL THEN 'unknown' WHEN own >= need THEN 'met' WHEN at_least THEN 'unknown' ELSE 'below' END AS assessment FROM rows_"""

_HIRING = (
    "{c} is hiring engineers.", "Recruiting on behalf of Acme Robotics, for engineers.", "About the company\nAcme Robotics is a maker of arms.", "Acme Robotics is hiring.\nBeta Labs is hiring.", "Our client is hiring an engineer.",
    "{c} is a leading staffing agency.\nAcme Robotics is hiring.", "The Data Team is hiring.", "Build things with us.", "Publisher One is hiring.", "\"Acme Robotics is hiring\", a customer said.",
)


def employers_attributed(spark, d):
    docs = table(spark, d, "documents").withColumn("k", F.col("doc_id") % 10).join(table(spark, d, "supplier").selectExpr("s_suppkey AS k", "replace(replace(s_name, '#', ' '), '_', ' ') AS company"), "k")
    rows = docs.selectExpr("doc_id AS id", "company", "CASE WHEN doc_id % 2 = 0 THEN 'lever' ELSE 'linkedin' END AS source", f"concat({_said(_HIRING, 10, c='company')}, '\n\n', text) AS description")
    listed = table(spark, d, "nation").where("n_nationkey = 1").selectExpr("'Publisher One' AS name")
    out = attribution.employer_attribution(rows, listed, listed.limit(0), ("lever",))
    return out.select(F.col("id").alias("doc_id"), "hiring_employer", "relationship", F.col("agency_evidence").isNotNull().alias("agency"))


QUERIES["employers_attributed"] = employers_attributed
ORACLES["employers_attributed"] = """
    WITH said AS (SELECT doc_id, replace(replace(s_name, '#', ' '), '_', ' ') AS company, CAST(floor(doc_id / 10) AS BIGINT) % 10 AS k, doc_id % 2 = 0 AS own_board FROM documents JOIN supplier ON s_suppkey = doc_id % 10),
    won AS (SELECT *, CASE WHEN k = 0 THEN company WHEN k IN (1, 2, 5) THEN 'Acme Robotics' WHEN k IN (7, 9) AND own_board THEN company END AS hiring_employer FROM said)
    SELECT doc_id, hiring_employer, CASE WHEN hiring_employer IS NULL THEN 'unknown' WHEN hiring_employer = company THEN 'unchanged' ELSE 'resolved-different' END AS relationship, k = 5 AS agency FROM won"""


_PLACE = _pick(("Haifa", "Oslo", "Lima"), 1)
_WORK = ("A remote role in {p}. We use Go.", "Our team in {p} works mostly remote. We use Go.", "No remote work in {p}. We use Go.", "Offices in {p}. A remote role. We use Go.", "In {p}. We use Rust.", "A remote role in {p}. Not remote on Fridays. We use Go.")
planted(
    "facts_checked",
    {"place": _PLACE, "plant": _said(_WORK, 3, p=_PLACE), "said": "concat(" + _said(_WORK, 3, p=_PLACE) + ", '\n', text)"},
    lambda: {
        "remote": validators.remote_fact(F.when(F.contains("plant", F.lit("emote")), F.regexp_substr("plant", F.lit("(No )?remote( work)?"))), "said")["value"],
        "error": places.let(validators.facts_error(F.struct(
            F.struct(F.col("place").alias("value"), F.col("place").alias("quote")).alias("location"), F.struct(F.lit(True).alias("value"), F.lit("remote").alias("quote")).alias("remote"),
            F.struct(F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("quote")).alias("seniority"), F.array(F.struct(F.lit("Go").alias("value"), F.lit("use Go").alias("quote"))).alias("stack"),
        ).cast(validators.FACTS), "said", F.lit("Developer")), lambda e: F.concat_ws(":", e["category"], e["field"])),
    },
    """, k AS (SELECT doc_id, CAST(floor(doc_id / 3) AS BIGINT) % 6 AS w FROM given)
      SELECT doc_id, CASE w WHEN 0 THEN true WHEN 2 THEN false WHEN 3 THEN true END AS remote,
        CASE w WHEN 0 THEN '' WHEN 3 THEN 'location_context:location' WHEN 4 THEN 'evidence_quote:remote' ELSE 'remote_consistency:remote' END AS error FROM k""",
)

_ADVICE = '{"employer_type":"direct","seniority_real":null,"fit_score":{n},"fit_tier":"{t}","recommendation":"apply","reasons":[{r}],"fit_line":"{l}","fit_line_evidence_ids":["p","{e}"]}'


def annotations_checked(spark, d):
    """Annotations whose score, tier and evidence come from rows; lines hold the whole text of a document."""
    reasons = ",".join(f'{{"factor":"{f}","basis":"{b}","assessment":"mixed","evidence_ids":["p"{", " + chr(34) + "e" + chr(34) if b == "comparison" else ""}],"detail":"About it"}}' for f, b in validators.BASES.items())
    score, tier = "doc_id % 101", _pick(tuple(validators.TIERS), 101)
    made = _ADVICE.replace("{n}", f"', {score}, '").replace("{t}", f"', {tier}, '").replace("{r}", reasons).replace("{l}", "', line, '").replace("{e}", "', CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE 'e' END, '")
    line = f"concat(CASE WHEN {tier} = 'weak' AND doc_id % 2 = 0 THEN 'Weak fit — ' ELSE '' END, regexp_replace(text, '[^A-Za-z0-9 .]', ' '))"
    rows = table(spark, d, "documents").selectExpr("doc_id", f"{line} AS line").selectExpr("doc_id", f"concat('{made}') AS annotation")
    return rows.select("doc_id", validators.annotation_error("annotation", F.array(F.lit("p"), F.lit("e")), F.lit("p")).alias("error"))


QUERIES["annotations_checked"] = annotations_checked
ORACLES["annotations_checked"] = """
    WITH a AS (SELECT doc_id, doc_id % 101 AS n, CAST(floor(doc_id / 101) AS BIGINT) % 4 AS t, regexp_matches(text, '(^|[^A-Za-z0-9])MCP([^A-Za-z0-9]|$)') AS mcp, trim(regexp_replace(text, '[^A-Za-z0-9 .]', ' ', 'g')) = '' AS blank FROM documents)
    SELECT doc_id, CASE WHEN NOT (CASE t WHEN 0 THEN n BETWEEN 80 AND 100 WHEN 1 THEN n BETWEEN 60 AND 79 WHEN 2 THEN n BETWEEN 40 AND 59 ELSE n BETWEEN 0 AND 39 END) THEN 'fit_tier'
      WHEN doc_id % 7 = 0 THEN 'line_evidence' WHEN blank AND NOT (t = 3 AND doc_id % 2 = 0) THEN 'fit_line' WHEN mcp THEN 'unproven_mcp' WHEN t = 3 AND doc_id % 2 <> 0 THEN 'weak_line' END AS error FROM a"""

_FRAGMENT = '<section class="top-card-layout"><h2 class="top-card-layout__title">Job</h2>{}</section><div class="decorated-job-posting__details">'
_STATES = ("", '<figure class="closed-job"><figcaption class="closed-job__flavor--closed">{}</figcaption></figure>', '<a href="https://www.linkedin.com/jobs/view/other-1">x</a>', "<div hidden>", '<span class="posted-time-ago__text">Reposted 3 days ago</span>')


def guest_observations(spark, d):
    """Fragments with a posting's description from pages: the words of their markup, as the details."""
    states = _pick(tuple(s.replace("{}", "No longer accepting applications") for s in _STATES), 1, "page_id")
    words = "regexp_replace(html, '[<>&]', ' ')"
    head, tail = _FRAGMENT.split("{}")
    rows = table(spark, d, "pages").selectExpr("page_id", f"concat('{head}', {states}, '{tail}', {words}, '</div>') AS page", "CAST(2 + page_id AS STRING) AS job")
    seen = guest.guest_observation("page", "job")
    return rows.select("page_id", seen.alias("o")).select("page_id", "o.*")


QUERIES["guest_observations"] = guest_observations
ORACLES["guest_observations"] = """
    SELECT page_id, CASE WHEN page_id % 5 = 1 THEN 'no longer accepting applications' END AS closure, page_id % 5 IN (0, 4) AS opened, CASE WHEN page_id % 5 = 4 THEN 'Reposted 3 days ago' END AS reposted FROM pages"""

_POSTED = """SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'lever' ELSE 'greenhouse' END AS source, CAST(doc_id % 211 AS STRING) AS tenant,
  CASE WHEN doc_id % 3 = 0 THEN concat('https://jobs.lever.co/a/', doc_id) WHEN doc_id % 3 = 1 THEN concat('https://boards.greenhouse.io/a/jobs/', doc_id) ELSE concat('https://a.com/jobs/', doc_id) END AS url,
  CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN concat('https://boards.greenhouse.io/a/jobs/', doc_id) ELSE concat('https://job-boards.greenhouse.io/a/jobs/', doc_id) END AS canonical_url,
  n_chars FROM documents"""
_ANSWERED = """SELECT url, CASE WHEN n_chars % 7 < 2 THEN 404 WHEN n_chars % 7 = 2 THEN 410 WHEN n_chars % 7 = 3 THEN 302 WHEN n_chars % 7 = 4 THEN 500 ELSE 200 END AS status, 'https://a.com/careers' AS location, n_chars % 2 = 0 AS generic FROM posted
  UNION SELECT canonical_url, CASE WHEN n_chars % 11 < 4 THEN 404 WHEN n_chars % 11 = 4 THEN 410 WHEN n_chars % 11 = 5 THEN 302 ELSE 200 END, 'https://a.com/careers', n_chars % 2 = 1 FROM posted WHERE canonical_url IS NOT NULL AND canonical_url <> url"""


def direct_checks(spark, d):
    """Postings and their landed answers by documents; sizes of texts tell what answered."""
    posted = table(spark, d, "documents").selectExpr("doc_id", "n_chars")
    posted.createOrReplaceTempView("posted_documents")
    rows = spark.sql(_POSTED.replace("FROM documents", "FROM posted_documents"))
    rows.createOrReplaceTempView("posted")
    return liveness.direct_verdicts(rows.drop("n_chars"), spark.sql(_ANSWERED))


QUERIES["direct_checks"] = direct_checks
ORACLES["direct_checks"] = f"""
    WITH posted AS ({_POSTED}), answered AS ({_ANSWERED}),
    r AS (SELECT p.*, p.source = 'greenhouse' AND p.url LIKE 'https://boards.greenhouse.io/%' AS hosted, coalesce(p.canonical_url <> p.url, false) AS other, o.status AS os, o.location AS ol, o.generic AS og, c.status AS cs, c.location AS cl, c.generic AS cg
      FROM posted p LEFT JOIN answered o ON o.url = p.url LEFT JOIN answered c ON c.url = p.canonical_url),
    g AS (SELECT *, coalesce(os = 404 OR (os = 410 AND NOT hosted) OR (os = 302 AND og), false) AS own_gone, coalesce(cs = 404 OR (cs = 302 AND cg), false) AS canon_gone,
      (SELECT min(s.id) FROM r s WHERE s.source = r.source AND s.tenant = r.tenant AND s.id <> r.id AND s.cs = 200) AS control FROM r),
    n AS (SELECT *, hosted AND own_gone AND other AS elsewhere, NOT own_gone OR (hosted AND other) AS unknown FROM g),
    k AS (SELECT *, (hosted AND own_gone AND NOT elsewhere) OR (unknown AND other) AS needs FROM n),
    v AS (SELECT *, CASE WHEN needs AND control IS NULL THEN 'none' WHEN unknown AND other THEN 'canon' ELSE 'own' END AS pick FROM k)
    SELECT id, CASE WHEN pick = 'canon' AND canon_gone OR pick = 'own' AND own_gone THEN false END AS alive,
      CASE pick WHEN 'none' THEN 'greenhouse-control-unknown' WHEN 'canon' THEN CASE WHEN NOT canon_gone THEN 'posting-url-unknown' WHEN cs = 404 THEN 'http-404' ELSE 'ats-generic-careers-redirect' END
        ELSE CASE WHEN NOT own_gone THEN 'posting-url-unknown' WHEN os IN (404, 410) THEN concat('http-', os) ELSE 'ats-generic-careers-redirect' END END AS reason,
      CASE pick WHEN 'canon' THEN cs ELSE os END AS status, CASE WHEN pick = 'canon' THEN CASE WHEN cs = 302 THEN cl ELSE canonical_url END ELSE CASE WHEN os = 302 THEN ol ELSE url END END AS final_url,
      CASE WHEN needs THEN control END AS control_id FROM v"""
