"""Registered queries over the derived views, each with its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import postings as fn
from ..functions.evidence import vacancy_evidence
from ..operators import board as B
from ..operators import cohort, globe, ingest, liveness, merge, selection, vacancy
from .views import table, view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, views: tuple[str, ...] = ()):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return register


def _board(spark: SparkSession, d: str) -> B.Board:
    return B.Board(view(spark, d, "v_postings"), view(spark, d, "v_status"), view(spark, d, "v_scores"))


BOARD = ("v_postings", "v_status", "v_scores")
SPLIT = ("v_old", "v_new")
_INACTIVE = "coalesce(json_type(liveness, '$.alive') = 'BOOLEAN' AND json_extract_string(liveness, '$.alive') = 'false', false)"


#: What the rules say of the levels and places of the view, by hand: the view's title begins with its level, and its locations are few.
_TITLE_LEVEL = "CASE WHEN doc_id % 7 = 4 THEN 'Intern' WHEN doc_id % 7 = 1 THEN 'Junior' WHEN doc_id % 7 = 2 THEN 'Staff' WHEN doc_id % 7 = 3 OR doc_id % 5 = 3 THEN 'Lead' WHEN doc_id % 7 = 0 THEN 'Senior' WHEN doc_id % 7 = 5 THEN 'Mid' END"
_RANK = f"""CASE coalesce(seniority, {_TITLE_LEVEL}) WHEN 'Intern' THEN 0 WHEN 'Junior' THEN 1 WHEN 'Entry' THEN 1 WHEN 'Mid' THEN 2 WHEN 'intermediate' THEN 2
  WHEN 'Senior' THEN 3 WHEN 'Lead' THEN 4 WHEN 'Manager' THEN 4 WHEN 'Staff' THEN 5 WHEN 'Principal' THEN 5 ELSE 6 END"""
_GROUP = """CASE coalesce(location, '') WHEN '' THEN 'unknown' WHEN 'Remote' THEN 'unknown' WHEN 'Hybrid / Remote' THEN 'unknown' WHEN 'On-site' THEN 'unknown' WHEN 'Tel Aviv, Israel' THEN 'israel'
  WHEN 'Haifa' THEN 'israel' WHEN 'San Francisco, CA' THEN 'united-states' WHEN 'New York, NY' THEN 'united-states' WHEN 'United States' THEN 'united-states'
  WHEN 'Austin, Texas Metropolitan Area' THEN 'united-states' ELSE 'other' END"""
_ROWS = f""", board AS (SELECT p.*, coalesce(s.status, 'new') AS status, s.seen, c.score, c.recommendation, c.eligibility, coalesce(posted, first_seen) AS sort_posted,
  {_INACTIVE} AS inactive, {_RANK} AS level, {_GROUP} AS place_group, coalesce(work_mode, CASE WHEN remote THEN 'remote' WHEN NOT remote THEN 'on-site' END) AS mode
  FROM v_postings p LEFT JOIN v_status s ON s.posting_id = p.id LEFT JOIN v_scores c ON c.posting_id = p.id)
"""
_CARD = ["id", "title", "company", "score", "status", "sort_posted"]


@query(_ROWS + f"SELECT {', '.join(_CARD)} FROM board WHERE NOT relevance_filtered AND NOT inactive AND score IS NOT NULL AND recommendation IN ('apply', 'referral', 'review') AND eligibility <> 'blocked' ORDER BY score DESC, sort_posted DESC, id LIMIT 50", BOARD)
def board_fit_topk(spark, d):
    return B.board_postings(_board(spark, d), fit="recommended", most=50).select(_CARD)


@query(_ROWS + f"SELECT {', '.join(_CARD)} FROM board WHERE NOT relevance_filtered AND inactive ORDER BY sort_posted DESC, first_seen DESC, id LIMIT 100", BOARD)
def board_posted_sort(spark, d):
    return B.board_postings(_board(spark, d), availability="inactive", sort="posted", most=100).select(_CARD)


@query(_ROWS + f"SELECT {', '.join(_CARD)} FROM board WHERE NOT relevance_filtered AND first_seen >= 48000 - 30 * 24 * 60 ORDER BY first_seen DESC, id LIMIT 200", BOARD)
def board_found_window(spark, d):
    return B.board_postings(_board(spark, d), availability="all", sort="found", found_within="30d", now=48000, most=200).select(_CARD)


@query(_ROWS + f"SELECT {', '.join(_CARD)}, level FROM board WHERE NOT relevance_filtered AND NOT inactive AND status IN ('new', 'applied') ORDER BY level, title, first_seen DESC, id LIMIT 150", BOARD)
def board_seniority_sort(spark, d):
    rows = B.board_postings(_board(spark, d), statuses=("new", "applied"), sort="seniority", most=150)
    return rows.select(*_CARD, fn.level_rank("seniority", "title").alias("level"))


@query(_ROWS + f"SELECT {', '.join(_CARD)} FROM board WHERE NOT relevance_filtered AND NOT inactive AND place_group = 'israel' AND mode = 'remote' AND level NOT IN (3, 4, 5) ORDER BY score DESC, sort_posted DESC, id LIMIT 1000", BOARD)
def board_facets(spark, d):
    return B.board_postings(_board(spark, d), location="israel", mode="remote", seniority="non-senior").select(_CARD)


@query(_ROWS + f"SELECT {', '.join(_CARD)} FROM board WHERE relevance_filtered AND NOT inactive AND remote ORDER BY score DESC NULLS LAST, sort_posted DESC, id LIMIT 1000", BOARD)
def board_not_scored_tab(spark, d):
    return B.board_postings(_board(spark, d), tab="not-scored", remote=True).select(_CARD)


@query(_ROWS + "SELECT place_group, mode, level, count(*) AS n, count(*) FILTER (score IS NULL) AS unscored FROM board GROUP BY ALL", BOARD)
def board_facets_product(spark, d):
    rows = _board(spark, d).rows()
    return rows.groupBy(fn.location_group("location").alias("place_group"), B.work_mode().alias("mode"), fn.level_rank("seniority", "title").alias("level")).agg(F.count("*").alias("n"), F.count_if(F.col("score").isNull()).alias("unscored"))


@query(_ROWS + "SELECT count(*) FILTER (score >= 70) AS strong, count(*) FILTER (score BETWEEN 40 AND 69) AS more, count(*) FILTER (score < 40) AS below, count(*) FILTER (score IS NULL) AS unscored FROM board WHERE contains(lower(title), 'engineer') OR contains(lower(company), 'engineer')", BOARD)
def count_jobs_bands(spark, d):
    return B.count_jobs(_board(spark, d), needle="ENGINEER")


@query(_ROWS + f"SELECT {', '.join(_CARD)} FROM board WHERE (contains(lower(title), 'react') OR contains(lower(company), 'react') OR contains(lower(stack), 'react')) AND score >= 20 AND coalesce(seen, false) ORDER BY score DESC, sort_posted DESC, id LIMIT 40", BOARD)
def search_substring(spark, d):
    return B.search_jobs(_board(spark, d), needle="React", least=20, seen=True, most=40).select(_CARD)


@query(_ROWS + f"SELECT {', '.join(_CARD)} FROM board WHERE score IS NOT NULL AND id NOT IN (SELECT id FROM board WHERE doc_id % 3 = 0) ORDER BY score DESC, sort_posted DESC, id LIMIT 1000", BOARD)
def search_excluding(spark, d):
    without = view(spark, d, "v_postings").where("doc_id % 3 = 0")
    return B.search_jobs(_board(spark, d), scored_only=True, without=without, most=1000).select(_CARD)


@query(_ROWS + "SELECT list(DISTINCT source ORDER BY source) AS sources FROM board WHERE NOT relevance_filtered AND NOT inactive AND status = 'new'", BOARD)
def sources_vocabulary(spark, d):
    return B.sources(_board(spark, d), tab="new-for-me")


@query(_ROWS + "SELECT id, title, company, source, location, remote, work_mode, seniority, CASE WHEN stack <> '' THEN stack ELSE 'SQL' END AS stack, posted, first_seen, status, CASE WHEN NOT relevance_filtered THEN score END AS score, CASE WHEN NOT relevance_filtered THEN recommendation END AS recommendation, relevance_filtered, CASE doc_id % 5 WHEN 0 THEN true WHEN 1 THEN false END AS alive FROM board", BOARD)
def markers(spark, d):
    b = _board(spark, d)
    return B.markers(B.Board(b.postings.withColumn("list_stack", F.lit("SQL")), b.statuses, b.scores))


@query(_ROWS + "SELECT id FROM board WHERE first_seen > 5000", BOARD)
def since_last_visit(spark, d):
    visits = spark.createDataFrame([(4000,), (5000,)], "last_visit long")
    return B.since_last_visit(_board(spark, d).rows(), visits).select("id")


@query(" SELECT id, status AS state FROM v_new UNION ALL SELECT id, 'stored' FROM v_old WHERE id NOT IN (SELECT id FROM v_new)", SPLIT)
def cohort_refreshed(spark, d):
    old, new = view(spark, d, "v_old"), view(spark, d, "v_new")
    return cohort.refreshed(old, new.select("id", F.col("status").alias("state")), old.select("id", F.lit("stored").alias("state")))


@query(f" SELECT liveness, count(*) AS n, count(*) FILTER (NOT {_INACTIVE}) AS active FROM v_postings GROUP BY 1", ("v_postings",))
def availability_json(spark, d):
    rows = view(spark, d, "v_postings")
    return rows.groupBy("liveness").agg(F.count("*").alias("n"), F.count_if(fn.is_active("liveness")).alias("active"))


@query(f" SELECT seniority, title, {_RANK} AS level, count(*) AS n FROM v_postings GROUP BY ALL", ("v_postings",))
def level_rank(spark, d):
    rows = view(spark, d, "v_postings")
    return rows.groupBy("seniority", "title", fn.level_rank("seniority", "title").alias("level")).agg(F.count("*").alias("n"))


@query(f" SELECT location, {_GROUP} AS place_group, count(*) AS n FROM v_postings GROUP BY ALL", ("v_postings",))
def location_group(spark, d):
    return view(spark, d, "v_postings").groupBy("location", fn.location_group("location").alias("place_group")).agg(F.count("*").alias("n"))


_FACT = "CASE WHEN doc_id % 7 = 4 THEN 'intern' WHEN doc_id % 7 = 1 THEN 'junior' WHEN doc_id % 7 = 2 THEN 'staff_principal' WHEN doc_id % 7 = 3 OR doc_id % 5 = 3 THEN 'lead_manager' WHEN doc_id % 7 = 0 THEN 'senior' WHEN doc_id % 7 = 5 THEN 'mid' END"


@query(f" SELECT title, {_FACT} AS level, count(*) AS n FROM v_postings GROUP BY ALL", ("v_postings",))
def facts_level(spark, d):
    return view(spark, d, "v_postings").groupBy("title", fn.fact_level("title").alias("level")).agg(F.count("*").alias("n"))


@query(" SELECT score, CASE WHEN score >= 70 THEN 'strong' WHEN score >= 40 THEN 'more' WHEN score IS NOT NULL THEN 'below' END AS band, CASE WHEN score >= 80 THEN 'strong' WHEN score >= 60 THEN 'good' WHEN score >= 40 THEN 'stretch' WHEN score IS NOT NULL THEN 'weak' END AS tier, count(*) AS n FROM v_scores GROUP BY ALL", ("v_scores",))
def score_band_tier(spark, d):
    return view(spark, d, "v_scores").groupBy("score", fn.score_band("score").alias("band"), fn.fit_tier("score").alias("tier")).agg(F.count("*").alias("n"))


_MERGED = """, merged AS (
  SELECT coalesce(n.id, o.id) AS id, coalesce(n.url, o.url) AS url, coalesce(n.title, o.title) AS title, coalesce(n.location, o.location) AS location,
    CASE WHEN n.id IS NULL OR (o.work_mode_source = 'structured' AND n.work_mode_source IS DISTINCT FROM 'structured') THEN o.work_mode ELSE coalesce(n.work_mode, o.work_mode) END AS work_mode,
    CASE WHEN n.id IS NULL OR (o.work_mode_source = 'structured' AND n.work_mode_source IS DISTINCT FROM 'structured') THEN o.work_mode_source ELSE coalesce(n.work_mode_source, o.work_mode_source) END AS work_mode_source,
    least(n.posted_at, o.posted_at) AS posted_at, greatest(n.last_published_at, o.last_published_at) AS last_published_at, greatest(n.last_seen_at, o.last_seen_at) AS last_seen_at,
    CASE WHEN n.stack <> '' OR o.id IS NULL THEN n.stack ELSE o.stack END AS stack, CASE WHEN n.checked_at >= o.checked_at OR o.id IS NULL THEN n.checked_at ELSE o.checked_at END AS checked_at,
    CASE WHEN n.id IS NULL THEN 'kept' WHEN o.id IS NULL THEN 'inserted' ELSE 'updated' END AS disposition
  FROM v_old o FULL JOIN v_new n ON n.id = o.id)
"""


@query(_MERGED + "SELECT * FROM merged", SPLIT)
def upsert_merge(spark, d):
    return merge.upsert_postings(view(spark, d, "v_old"), view(spark, d, "v_new"))


@query(_MERGED + "SELECT disposition, count(*) AS n FROM merged GROUP BY 1", SPLIT)
def disposition(spark, d):
    return merge.dispositions(view(spark, d, "v_old"), view(spark, d, "v_new"))


@query(_MERGED + "SELECT title, min(posted_at) AS posted_at, greatest(max(posted_at), max(last_published_at)) AS last_published_at FROM merged GROUP BY 1", SPLIT)
def publication_dates(spark, d):
    rows = merge.upsert_postings(view(spark, d, "v_old"), view(spark, d, "v_new"))
    return vacancy.publication_dates(rows.select(F.col("title").alias("group_id"), F.col("posted_at").alias("posted"), F.col("last_published_at").alias("last_published"))).withColumnRenamed("group_id", "title")


@query(" SELECT n.id, n.title AS role, o.status AS status_from, n.status AS status_to FROM v_new n LEFT JOIN v_old o ON o.id = n.id WHERE o.status IS DISTINCT FROM n.status", SPLIT)
def status_history_diff(spark, d):
    return merge.status_history(view(spark, d, "v_old"), view(spark, d, "v_new"))


@query(" SELECT n.id, n.title = o.title AS same, CASE WHEN n.title = o.title THEN o.status END AS rule, o.stack AS override FROM v_new n JOIN v_old o ON o.id = n.id", SPLIT)
def gate_reset(spark, d):
    gate = F.create_map(F.lit("rule"), F.col("status"), F.lit("override"), F.col("stack"))
    old = view(spark, d, "v_old").withColumn("gate", gate).select("id", "title", "gate")
    out = merge.gate_after_edit(old, view(spark, d, "v_new").select("id", "title"))
    same = F.map_contains_key("gate", "rule")
    return out.select("id", same.alias("same"), F.when(same, F.element_at("gate", F.lit("rule"))).alias("rule"), F.element_at("gate", F.lit("override")).alias("override"))


_PURSUED = "'worth_checking', 'applied', 'screen', 'interview_technical', 'interview_final', 'offer', 'contract', 'rejected'"


@query(f""" SELECT id, CASE WHEN status IN ({_PURSUED}) THEN CASE WHEN rule IS NOT NULL THEN NULL ELSE rule END WHEN parked IS NOT NULL THEN CASE WHEN parked = 'already-us-resident' OR score IS NULL THEN parked END ELSE rule END AS rule,
  CASE WHEN status IN ({_PURSUED}) THEN coalesce(rule, parked) WHEN parked IS NOT NULL THEN NULL ELSE parked END AS pursued_rule
  FROM (SELECT p.id, coalesce(s.status, 'new') AS status, c.score, CASE WHEN doc_id % 4 = 0 THEN 'qa-title' END AS rule, CASE doc_id % 4 WHEN 1 THEN 'equity-only' WHEN 2 THEN 'already-us-resident' END AS parked
    FROM v_postings p LEFT JOIN v_status s ON s.posting_id = p.id LEFT JOIN v_scores c ON c.posting_id = p.id)""", BOARD)
def pursuit_gate(spark, d):
    rows = _board(spark, d).rows().select("id", "status", "score", F.expr("CASE WHEN doc_id % 4 = 0 THEN 'qa-title' END").alias("rule"), F.expr("CASE doc_id % 4 WHEN 1 THEN 'equity-only' WHEN 2 THEN 'already-us-resident' END").alias("parked"))
    gate = merge.pursued_gate(F.col("status"), F.col("rule"), F.col("parked"), F.col("score").isNotNull())
    return rows.select("id", gate.alias("g")).select("id", "g.*")


@query(" SELECT id, count(*) AS n FROM v_new n WHERE NOT EXISTS (SELECT 1 FROM v_old o WHERE o.id = n.id AND o.title = n.title) GROUP BY 1", SPLIT)
def facts_changed_only(spark, d):
    return merge.changed_only(view(spark, d, "v_old"), view(spark, d, "v_new"), ["id", "title"]).groupBy("id").agg(F.count("*").alias("n"))


@query(" SELECT id, status FROM v_old o WHERE NOT EXISTS (SELECT 1 FROM v_new n WHERE n.id = o.id AND n.title = o.title AND n.status = o.status)", SPLIT)
def apply_rollback(spark, d):
    columns = ["title", "status"]
    return merge.rolled_back(view(spark, d, "v_old").select("id", *columns), view(spark, d, "v_new").select("id", *columns), columns).select("id", "status")


@query(" SELECT o.id FROM v_old o LEFT JOIN v_new n ON n.id = o.id WHERE n.id IS NULL OR (n.location IS NOT DISTINCT FROM o.location AND n.work_mode IS NOT DISTINCT FROM o.work_mode)", SPLIT)
def geo_invalidation(spark, d):
    old, new = view(spark, d, "v_old"), view(spark, d, "v_new")
    return merge.geo_invalidated(old.select("id"), old, new, ["location", "work_mode"])


@query(" SELECT o.id AS id, CASE WHEN n.status <> o.status THEN n.status WHEN n.seen AND o.status = 'F' AND NOT o.seen THEN n.status ELSE n.status END AS status, n.status <> 'new' AS flag FROM (SELECT id, status, checked_at % 2 = 0 AS seen FROM v_old) o JOIN (SELECT id, status, checked_at % 3 = 0 AS seen FROM v_new) n ON n.id = o.id WHERE n.status <> o.status", SPLIT)
def seen_on_status_change(spark, d):
    old = view(spark, d, "v_old").select("id", F.col("status").alias("os"), (F.col("checked_at") % 2 == 0).alias("oseen"))
    new = view(spark, d, "v_new").select("id", "status", (F.col("checked_at") % 3 == 0).alias("seen"))
    rows = old.join(new, "id").withColumn("r", merge.seen_after(F.lit("update"), F.col("os"), F.col("oseen"), F.col("status"), F.col("seen")))
    return rows.where("os <> status").select("id", "r.status", F.col("r.seen").alias("flag"))


#: The rule by the letter: arrivals one by one, with what has been kept and who owns each key.
_FOLD = """, fold AS (
  SELECT 0 AS n, CAST([] AS VARCHAR[]) AS kept, CAST([] AS VARCHAR[]) AS keys, CAST([] AS VARCHAR[]) AS owners, CAST([] AS BIGINT[]) AS taken
  UNION ALL
  SELECT f.n + 1, CASE WHEN x.ok THEN list_append(f.kept, x.ident) ELSE f.kept END, CASE WHEN x.ok AND x.place IS NULL THEN list_append(f.keys, x.key) ELSE f.keys END,
    CASE WHEN x.ok AND x.place IS NULL THEN list_append(f.owners, x.source) ELSE f.owners END, CASE WHEN x.ok THEN list_append(f.taken, x.arrival) ELSE f.taken END
  FROM fold f JOIN numbered r ON r.n = f.n + 1,
  LATERAL (SELECT r.arrival, r.source, r.key, r.source || ':' || r.id AS ident, list_position(f.keys, r.key) AS place,
    NOT list_contains(f.kept, r.source || ':' || r.id) AND (list_position(f.keys, r.key) IS NULL OR f.owners[list_position(f.keys, r.key)] = r.source) AS ok) x)
SELECT arrival, id, source FROM v_arrivals WHERE arrival IN (SELECT unnest(taken) FROM (SELECT taken FROM fold ORDER BY n DESC LIMIT 1))"""


@query(_FOLD, ("v_arrivals", "numbered"))
def dedupe_cross_source(spark, d):
    return ingest.dedupe_postings(view(spark, d, "v_arrivals")).select("arrival", "id", "source")


@query(" SELECT id, title FROM v_postings WHERE ((contains(title, 'Frontend') AND contains(title, 'Senior')) OR contains(title, 'Full Stack Developer') OR contains(title, 'Machine Learning')) AND NOT contains(title, 'Staff') AND NOT contains(title, 'Lead')", ("v_postings",))
def title_scope_subset(spark, d):
    searches = spark.createDataFrame([("senior front end engineer",), ("Fullstack Engineer",), ("AI engineer",)], "keywords string")
    return ingest.in_scope(view(spark, d, "v_postings").select("id", "title"), searches)


@query("""  SELECT source, registered, eligible, stale, disabled, invalid, expiring_within_7d, parsed, matched, parsed - matched AS filtered, inserted_new, updated_existing,
    list_filter([CASE WHEN registered > 0 AND eligible = 0 THEN source || ': registered=' || registered || ' but eligible=0 (stale=' || stale || ', disabled=' || disabled || ', invalid=' || invalid || ')' END,
      CASE WHEN parsed > 0 AND matched = 0 THEN source || ': parsed=' || parsed || ' but matched=0; filtered=' || (parsed - matched) END, CASE WHEN expiring_within_7d > 0 THEN source || ': expiring_within_7d=' || expiring_within_7d END], lambda x: x IS NOT NULL) AS warnings
  FROM (SELECT coalesce(r.source, p.source) AS source, coalesce(registered, 0) AS registered, coalesce(eligible, 0) AS eligible, coalesce(stale, 0) AS stale, coalesce(disabled, 0) AS disabled, coalesce(invalid, 0) AS invalid,
      coalesce(expiring_within_7d, 0) AS expiring_within_7d, coalesce(parsed, 0) AS parsed, coalesce(matched, 0) AS matched, coalesce(inserted_new, 0) AS inserted_new, coalesce(updated_existing, 0) AS updated_existing
    FROM (SELECT 'src' || n_nationkey AS source, n_nationkey AS registered, CAST(n_nationkey > 10 AS BIGINT) AS eligible, n_nationkey % 4 AS stale, 1 AS disabled, 2 AS invalid, CAST(n_nationkey % 3 = 0 AS BIGINT) AS expiring_within_7d FROM nation) r
    FULL JOIN (SELECT source, count(*) AS parsed, count(*) FILTER (source <> 'src3') AS matched, count(*) FILTER (source <> 'src3' AND doc_id % 2 = 0) AS inserted_new, count(*) FILTER (source <> 'src3' AND doc_id % 2 = 1) AS updated_existing FROM v_postings GROUP BY 1) p ON p.source = r.source)""", ("v_postings",))
def source_funnel(spark, d):
    rows = view(spark, d, "v_postings").select("source", F.expr("CASE WHEN doc_id % 2 = 0 THEN 'inserted' ELSE 'updated' END").alias("disposition"))
    registered = table(spark, d, "nation").selectExpr("concat('src', n_nationkey) AS source", "n_nationkey AS registered", "int(n_nationkey > 10) AS valid", "n_nationkey % 4 AS stale", "1 AS disabled", "2 AS invalid", "int(n_nationkey % 3 = 0) AS expiring_within_7d")
    matched = rows.where("source <> 'src3'")
    return ingest.run_funnel(registered, rows, matched, matched)


@query(" SELECT n.id, n.title FROM v_new n WHERE n.id NOT IN (SELECT id FROM v_old)", SPLIT)
def history_anti(spark, d):
    return view(spark, d, "v_new").join(view(spark, d, "v_old").select("id"), "id", "left_anti").select("id", "title")


@query("SELECT p_name, r_name, '7d' AS recency FROM (SELECT DISTINCT p_name FROM part) CROSS JOIN region")
def search_expansion(spark, d):
    terms = table(spark, d, "part").select("p_name").distinct()
    return ingest.expanded_searches(terms, table(spark, d, "region").select("r_name"), "7d")


_REGISTRY = """SELECT *, CASE WHEN key = '' OR company = '' OR verified > 100 OR row_number() OVER (PARTITION BY source, key ORDER BY company) > 1 THEN 'invalid' WHEN NOT enabled THEN 'disabled' WHEN 100 - verified > 45 THEN 'stale' ELSE 'valid' END AS state
  FROM (SELECT c_mktsegment AS source, CAST(c_custkey // 2 AS VARCHAR) AS key, c_name AS company, c_custkey % 7 <> 0 AS enabled, c_custkey % 103 AS verified FROM customer)"""


def _tenants(spark, d):
    return table(spark, d, "customer").select(F.col("c_mktsegment").alias("source"), F.expr("CAST(c_custkey div 2 AS STRING)").alias("key"), F.col("c_name").alias("company"), (F.col("c_custkey") % 7 != 0).alias("enabled"), (F.col("c_custkey") % 103).alias("verified"))


@query(_REGISTRY)
def registry_scan(spark, d):
    return ingest.registry_states(_tenants(spark, d), 100)


@query(f"SELECT source, count(*) AS registered, count(*) FILTER (state = 'valid') AS valid, count(*) FILTER (state = 'stale') AS stale, count(*) FILTER (state = 'disabled') AS disabled, count(*) FILTER (state = 'invalid') AS invalid, count(*) FILTER (state = 'valid' AND 100 - verified > 38) AS expiring_within_7d FROM ({_REGISTRY}) GROUP BY 1")
def registry_funnel(spark, d):
    return ingest.registry_funnel(ingest.registry_states(_tenants(spark, d), 100), 100)


_GATED = """, gated AS (SELECT *, CASE WHEN doc_id % 6 < 3 THEN '2026-10-22-v9-years-jdq' WHEN doc_id % 6 < 5 THEN 'old' END AS gate_version, doc_id % 10 = 0 AS gate_override, doc_id % 8 = 1 AS score_requested FROM v_postings),
  held AS (SELECT id, CASE WHEN doc_id % 17 = 0 THEN 200 ELSE 50 END AS until, CASE WHEN doc_id % 19 = 0 THEN 150 END AS next_attempt_at FROM v_postings WHERE doc_id % 3 <> 1),
  profiled AS (SELECT posting_id, CASE WHEN CAST(posting_id AS INT) % 3 = 0 THEN 'now' ELSE 'then' END AS profile_sha256 FROM v_scores WHERE CAST(posting_id AS INT) % 4 <> 2)"""
_ALIVE = f"NOT {_INACTIVE} AND length(regexp_replace(raw_jd, '^\\s+|\\s+$', '', 'g')) >= 80"
_LET_THROUGH = f"NOT relevance_filtered AND (coalesce(gate_version = '2026-10-22-v9-years-jdq', false) OR gate_override OR EXISTS (SELECT 1 FROM profiled q WHERE q.posting_id = g.id) OR EXISTS (SELECT 1 FROM v_status u WHERE u.posting_id = g.id AND u.status IN ({_PURSUED}))) AND NOT EXISTS (SELECT 1 FROM held l WHERE l.id = g.id AND (l.until > 100 OR l.next_attempt_at > 100))"


def _gated(spark, d):
    rows = view(spark, d, "v_postings").selectExpr("*", "CASE WHEN doc_id % 6 < 3 THEN '2026-10-22-v9-years-jdq' WHEN doc_id % 6 < 5 THEN 'old' END AS gate_version", "doc_id % 10 = 0 AS gate_override", "doc_id % 8 = 1 AS score_requested")
    held = rows.where("doc_id % 3 <> 1").selectExpr("id", "CASE WHEN doc_id % 17 = 0 THEN 200 ELSE 50 END AS until", "CASE WHEN doc_id % 19 = 0 THEN 150 END AS next_attempt_at")
    scores = view(spark, d, "v_scores").where("CAST(posting_id AS INT) % 4 <> 2").selectExpr("posting_id", "CASE WHEN CAST(posting_id AS INT) % 3 = 0 THEN 'now' ELSE 'then' END AS profile_sha256")
    return rows, view(spark, d, "v_status"), scores, held


@query(_GATED + f" SELECT g.id, title, first_seen FROM gated g JOIN v_status s ON s.posting_id = g.id LEFT JOIN profiled c ON c.posting_id = g.id WHERE {_ALIVE} AND {_LET_THROUGH} AND (c.posting_id IS NULL OR (s.status IN ('new', 'seen') AND c.profile_sha256 IS DISTINCT FROM 'now') OR score_requested) ORDER BY c.posting_id IS NULL DESC, coalesce(posted, first_seen) DESC, g.id LIMIT 60", BOARD)
def scoring_candidates(spark, d):
    rows, statuses, scores, held = _gated(spark, d)
    return selection.scoring_candidates(rows, statuses, scores, held, 100, 60, "now")


@query(_GATED + f" SELECT id, first_seen FROM gated g WHERE {_ALIVE} AND strlen(raw_jd) <= 24000 AND {_LET_THROUGH} AND doc_id % 7 <> 0 ORDER BY first_seen, id LIMIT 60", BOARD)
def extract_candidates(spark, d):
    rows, statuses, scores, held = _gated(spark, d)
    return selection.extract_candidates(rows, statuses, scores, rows.where("doc_id % 7 = 0"), held, 100, 24_000, 60)


@query(" SELECT id, 'https://a.b/' || external_id AS url FROM v_postings WHERE length(trim(raw_jd)) < 400 ORDER BY CASE WHEN doc_id % 4 <> 0 THEN CAST(doc_id % 90 AS VARCHAR) ELSE '' END, first_seen, id LIMIT 40", ("v_postings",))
def short_descriptions(spark, d):
    rows = view(spark, d, "v_postings").withColumn("url", F.concat(F.lit("https://a.b/"), "external_id")).withColumn("attempted_at", F.expr("CASE WHEN doc_id % 4 <> 0 THEN CAST(doc_id % 90 AS STRING) END"))
    return selection.short_descriptions(rows, 400, 40)


@query(" SELECT id, source FROM (SELECT *, row_number() OVER (PARTITION BY source = 'src0' ORDER BY coalesce(last_attempt, ''), first_seen, id) AS position FROM (SELECT id, source, first_seen, CASE WHEN doc_id % 4 <> 0 THEN CAST(doc_id % 90 AS VARCHAR) END AS last_attempt FROM v_postings)) WHERE source <> 'src0' OR position <= 20", ("v_postings",))
def rotating_recheck(spark, d):
    rows = view(spark, d, "v_postings").withColumn("last_attempt", F.expr("CASE WHEN doc_id % 4 <> 0 THEN CAST(doc_id % 90 AS STRING) END"))
    return selection.rotating_recheck(rows, "src0", 20).select("id", "source")


@query("SELECT o_orderkey AS id, least(3600, 60 * (1 << CAST(least(o_custkey % 9, 6) AS INT))) AS wait FROM orders WHERE o_orderkey % 5000 + least(3600, 60 * (1 << CAST(least(o_custkey % 9, 6) AS INT))) <= 4000")
def lease_ready(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 5000).alias("until"), (F.col("o_custkey") % 9 + 1).alias("attempts"))
    return selection.leases_ready(rows, 4000).select("id", selection.backoff_seconds("attempts").alias("wait"))


@query(" SELECT g.posting_id, coalesce(g.lat, h.lat) AS lat, CASE WHEN g.lat IS NOT NULL THEN 'own' ELSE 'hq' END AS precision FROM v_geo g LEFT JOIN v_hq h ON h.company = g.company AND g.lat IS NULL AND (g.remote OR lower(trim(coalesce(g.location, ''))) IN ('', 'remote', 'hybrid', 'on-site', 'onsite', 'worldwide', 'anywhere')) WHERE g.lat IS NOT NULL OR h.company IS NOT NULL", ("v_geo", "v_hq"))
def geo_fallback(spark, d):
    rows = view(spark, d, "v_geo")
    return selection.point_with_fallback(rows.drop("lat"), rows.where("lat is not null").select("posting_id", "lat"), view(spark, d, "v_hq"))


@query("SELECT vec_id AS id, vec_id % 400 AS first_seen FROM (SELECT * FROM embeddings ORDER BY vec_id % 400 DESC, vec_id LIMIT 200) WHERE vec_id % 3 <> 0 ORDER BY first_seen DESC, id LIMIT 50")
def embedding_missing(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 400).alias("first_seen"))
    return selection.embedding_missing(rows, rows.where("id % 3 = 0"), 200, 50)


@query("SELECT key, answer, confidence FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY (answer = 'error') DESC, confidence DESC, answer) AS n FROM (SELECT user_id AS key, event_type AS answer, max(event_id) AS confidence FROM events GROUP BY ALL)) WHERE n = 1")
def cautious_vote(spark, d):
    votes = table(spark, d, "events").groupBy(F.col("user_id").alias("key"), F.col("event_type").alias("answer")).agg(F.max("event_id").alias("confidence"))
    return selection.cautious_vote(votes, "error")


@query("SELECT p_type, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_type LIMIT 20")
def unresolved_top20(spark, d):
    return selection.top_values(table(spark, d, "part"), "p_type")


@query(" SELECT id, company FROM (SELECT *, count(*) OVER (PARTITION BY company) AS n FROM v_postings) WHERE n >= 2 AND doc_id % 4 <> 0", ("v_postings",))
def ambiguous_employers(spark, d):
    rows = view(spark, d, "v_postings").select("id", "company", (F.col("doc_id") % 4 == 0).alias("has_requisition"))
    return selection.ambiguous_employers(rows).select("id", "company")


@query(""" SELECT id, CASE WHEN alive = false THEN 'closed' WHEN deadline < 5000 THEN 'deadline_passed' WHEN alive AND checked <= 5000 AND 5000 - checked <= 180 AND (verdict IS NULL OR verdict = 'alive') THEN 'confirmed' ELSE 'stale' END AS state
  FROM (SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS alive, event_id % 5300 AS checked, CASE event_id % 4 WHEN 0 THEN 'alive' WHEN 1 THEN 'gone' END AS verdict, CASE WHEN event_id % 7 = 0 THEN event_id % 9000 END AS deadline FROM events)""")
def liveness_projection(spark, d):
    rows = table(spark, d, "events").selectExpr("event_id AS id", "CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS alive", "event_id % 5300 AS checked", "CASE event_id % 4 WHEN 0 THEN 'alive' WHEN 1 THEN 'gone' END AS verdict", "CASE WHEN event_id % 7 = 0 THEN event_id % 9000 END AS deadline")
    return rows.select("id", liveness.projected_state(F.col("alive"), F.col("checked"), F.col("verdict"), F.col("deadline"), 5000).alias("state"))


@query(""", told AS (SELECT *, count(*) FILTER (seen <> 'absent') OVER (PARTITION BY key ORDER BY at ROWS UNBOUNDED PRECEDING) AS streak, lag(seen) OVER (PARTITION BY key ORDER BY at) AS last FROM v_observations),
  struck AS (SELECT *, CASE WHEN seen <> 'absent' THEN 0 WHEN at - min(CASE WHEN seen = 'absent' THEN at END) OVER (PARTITION BY key, streak) < 45 THEN 1 ELSE 2 END AS strikes FROM told)
  SELECT key, at, seen, strikes, CASE WHEN seen = 'present' THEN 'alive' WHEN strikes = 1 THEN 'pending' WHEN strikes = 2 THEN 'confirm' ELSE 'unknown' END AS verdict, seen = 'unknown' AND coalesce(last <> 'unknown', true) AS alert FROM struck""".replace(" at ", " \"at\" ").replace(" at,", " \"at\",").replace("at)", "\"at\")").replace("THEN at END", 'THEN "at" END').replace("WHEN at -", 'WHEN "at" -'), ("v_observations",))
def liveness_strikes(spark, d):
    return liveness.strikes(view(spark, d, "v_observations"))


@query(""" , whole AS (SELECT board, count(*) = max(total) AND count(DISTINCT id) = count(*) AS whole FROM (SELECT l_orderkey AS board, l_linenumber AS id, CASE WHEN l_orderkey % 3 = 0 THEN 99 ELSE count(*) OVER (PARTITION BY l_orderkey) END AS total FROM lineitem) GROUP BY 1)
  SELECT w.board, k.id, CASE WHEN NOT whole THEN 'unknown' WHEN EXISTS (SELECT 1 FROM lineitem x WHERE x.l_orderkey = w.board AND x.l_linenumber = k.id) THEN 'present' ELSE 'absent' END AS seen FROM whole w CROSS JOIN (SELECT unnest([1, 3, 6]) AS id) k""", ("v_hq",))
def board_membership(spark, d):
    from pyspark.sql import Window

    n = F.count("*").over(Window.partitionBy("l_orderkey"))
    snapshots = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("board"), F.col("l_linenumber").alias("id"), F.when(F.col("l_orderkey") % 3 == 0, 99).otherwise(n).alias("total"))
    expected = snapshots.select("board").distinct().withColumn("id", F.explode(F.array(F.lit(1), F.lit(3), F.lit(6))))
    return liveness.board_membership(snapshots, expected)


def _vacancies(spark, d):
    """Listings of 97 companies, some with requisitions in their texts, some with the text of another, with few titles and many places."""
    rows = view(spark, d, "v_postings")
    n = F.col("doc_id")
    jd = F.when(n % 9 == 0, F.concat(F.lit("Requisition ID: R"), (n % 45).cast("string"), F.lit(" "), "raw_jd")).otherwise(F.col("raw_jd"))
    url = F.concat(F.lit("https://jobs.lever.co/acme/"), F.lpad((n % 400).cast("string"), 36, "0"))
    return vacancy_evidence(rows.select("id", "company", "title", "location", url.alias("url"), F.lit(None).cast("string").alias("apply_url"), jd.alias("raw_jd"), "posted", "first_seen", "doc_id")).drop("raw_jd")


@query()
def vacancy_groups(spark, d):
    return vacancy.vacancy_groups(_vacancies(spark, d)).select("id", "group_id", "is_representative", "group_size")


@query()
def new_role_count(spark, d):
    rows = _vacancies(spark, d)
    grouped = vacancy.vacancy_groups(rows)
    return vacancy.new_groups(grouped, rows.where("doc_id % 2 = 0")).agg(F.count("*").alias("n_new"))


@query(r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '<(script)\b[^>]*>(.*?)</script\s*>|<(style)\b[^>]*>(.*?)</style\s*>', ' ', 'gis'), '<[^>]*>', ' ', 'gs'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM pages""")
def visible_text(spark, d):
    return table(spark, d, "pages").select("page_id", fn.visible_text("html").alias("text"))


@query("SELECT page_id, url, CASE WHEN url IS NULL OR url = '' THEN 'no_link' WHEN regexp_matches(url, '^(?i:https?)://[^/?#@\\s]+([/?#]\\S*)?$') THEN 'available' ELSE 'invalid_url' END AS status FROM pages".replace("\\\\", "\\"))
def link_status(spark, d):
    return table(spark, d, "pages").select("page_id", "url", fn.link_status("url").alias("status"))


@query("SELECT p_size, CASE WHEN p_size >= 10 THEN '10+ years' WHEN p_size >= 8 THEN '8-9+ years' WHEN p_size >= 6 THEN '6+ years (stretch)' WHEN p_size >= 5 THEN '5+ years' END AS label, CASE WHEN p_size >= 10 THEN -12 WHEN p_size >= 8 THEN -10 WHEN p_size >= 6 THEN -7 WHEN p_size >= 5 THEN -4 END AS weight, count(*) AS n FROM part GROUP BY ALL")
def max_years_band(spark, d):
    band = fn.years_band("p_size")
    return table(spark, d, "part").groupBy("p_size", band["label"].alias("label"), band["weight"].alias("weight")).agg(F.count("*").alias("n"))


@query(" SELECT source, min(doc_id) AS at, max_by(id, doc_id) AS last_id FROM v_postings GROUP BY 1", ("v_postings",))
def unique_by_id(spark, d):
    rows = view(spark, d, "v_postings").select(F.col("source").alias("id"), F.col("doc_id").alias("at"), F.col("id").alias("last_id"))
    return cohort.unique_by_id(rows).withColumnRenamed("id", "source")


@query(" SELECT coalesce(o.id, n.id) AS id, o.id IS NULL AS is_new, coalesce(n.status, o.status) AS state FROM v_old o FULL JOIN v_new n ON n.id = o.id WHERE coalesce(o.id, n.id) NOT IN (SELECT id FROM v_new WHERE checked_at = 5)", SPLIT)
def retained_cohort(spark, d):
    old, new = view(spark, d, "v_old"), view(spark, d, "v_new")
    return cohort.retained(old.select("id", F.col("checked_at").alias("at"), F.col("status").alias("state")), new.select("id", F.col("status").alias("state")), new.where("checked_at = 5"))


@query(" SELECT o.id, coalesce(n.status, o.status) AS status FROM v_old o LEFT JOIN v_new n ON n.id = o.id WHERE n.id IS NULL OR n.status <> 'P'", SPLIT)
def status_overlay(spark, d):
    return cohort.overlaid(view(spark, d, "v_old").select("id", "status"), view(spark, d, "v_new").select("id", F.expr("nullif(status, 'P')").alias("status")))


@query("SELECT place, s.source, count(d.doc_id) AS n FROM (VALUES (0, 'src3'), (1, 'src1'), (2, 'none')) s(place, source) LEFT JOIN documents d ON d.source = s.source GROUP BY ALL")
def counts_by_source(spark, d):
    return cohort.counts_by_source(table(spark, d, "documents"), ("src3", "src1", "none"))


@query(" SELECT count(*) FILTER (remote) AS alive, count(*) FILTER (NOT remote) AS dead, count(*) FILTER (remote IS NULL) AS unknown FROM v_postings", ("v_postings",))
def liveness_counts(spark, d):
    return cohort.liveness_counts(view(spark, d, "v_postings").select(F.col("remote").alias("alive")))


@query("SELECT user_id, count(*) AS attempted, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'error') * 2 > count(*) AS degraded FROM events GROUP BY 1")
def degraded_runs(spark, d):
    by = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("attempted"), F.count_if(F.col("event_type") == "error").alias("failed"))
    return by.withColumn("degraded", cohort.degraded("attempted", "failed"))


@query("SELECT id, CASE WHEN posted BETWEEN 10957 AND observed + 1 THEN posted END AS posted_at FROM (SELECT event_id AS id, event_id % 40000 AS posted, 19000 + event_id % 3 AS observed FROM events)")
def publication_plausible(spark, d):
    rows = table(spark, d, "events").selectExpr("event_id AS id", "event_id % 40000 AS posted", "19000 + event_id % 3 AS observed")
    return rows.select("id", cohort.plausible_publication("posted", "observed").alias("posted_at"))


@query("SELECT m, CASE WHEN m < 60 THEN 'now' WHEN m < 1440 THEN (m // 60) || 'h' ELSE (m // 1440) || 'd' END AS age FROM (SELECT DISTINCT event_id * 17 % 99991 AS m FROM events)")
def age_buckets(spark, d):
    return table(spark, d, "events").selectExpr("event_id * 17 % 99991 AS m").distinct().withColumn("age", cohort.age_bucket("m"))


@query(" SELECT o.status AS was, n.status AS now, count(*) AS n FROM v_old o JOIN v_new n ON n.id = o.id GROUP BY ALL", SPLIT)
def transition_report(spark, d):
    state = lambda name: view(spark, d, name).select("id", F.col("status").alias("state"))
    return cohort.transitions(state("v_old"), state("v_new"))


@query(" SELECT id, first_seen FROM v_postings WHERE first_seen > 3000 ORDER BY first_seen, id LIMIT 101", ("v_postings",))
def new_roles_poll(spark, d):
    return cohort.new_since(view(spark, d, "v_postings").select("id", "first_seen"), 3000)


@query(" SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NOT NULL AND coalesce(o.checked_at, -1) <= 400 THEN 415 ELSE o.checked_at END AS until, CASE WHEN n.id IS NOT NULL AND coalesce(o.checked_at, -1) <= 400 THEN coalesce(o.last_seen_at, 0) + 1 ELSE o.last_seen_at END AS attempts FROM v_old o FULL JOIN v_new n ON n.id = o.id", SPLIT)
def lease_claim(spark, d):
    leases = view(spark, d, "v_old").select("id", F.col("checked_at").alias("until"), F.col("last_seen_at").alias("attempts"))
    return cohort.claimed(leases, view(spark, d, "v_new"), 400)


@query(" SELECT id, posted_at AS applied, last_seen_at AS recorded FROM v_old WHERE title = 'Title 3' ORDER BY applied DESC NULLS LAST, recorded DESC, id LIMIT 20", SPLIT)
def application_history(spark, d):
    events = view(spark, d, "v_old").select("id", F.col("title").alias("company"), F.col("posted_at").alias("applied"), F.col("last_seen_at").alias("recorded"))
    return cohort.history_listed(events, " TITLE 3 ").select("id", "applied", "recorded")


_POINTS = "SELECT c_custkey AS id, c_nationkey AS group_id, c_mktsegment AS title, c_custkey % 101 AS score, CAST((c_nationkey * 7 + CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END) % 200 - 95 AS DOUBLE) AS lat, CAST((c_nationkey * 13) % 361 - 180 AS DOUBLE) AS lng FROM customer"


def _points(spark, d):
    return spark.sql(_POINTS.replace("FROM customer", "FROM {customer}"), customer=table(spark, d, "customer"))


_MEMBERS = "SELECT c_custkey AS at, c_nationkey AS cluster, c_custkey // 3 AS row_id, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 101 END AS score, CASE c_custkey % 6 WHEN 0 THEN ' Haifa , Israel' WHEN 1 THEN 'Berlin' WHEN 2 THEN '' WHEN 3 THEN CASE WHEN c_nationkey % 2 = 0 THEN 'Haifa' END ELSE 'Haifa, North' END AS location, CAST(c_nationkey + CASE WHEN c_nationkey % 3 = 0 AND c_custkey % 5 = 0 THEN 0.001 ELSE 0 END AS DOUBLE) AS lat, CAST(c_nationkey * 2 AS DOUBLE) AS lng FROM customer"


@query(f"""WITH m AS ({_MEMBERS}), named AS (SELECT *, coalesce(nullif(trim(split_part(location, ',', 1)), ''), 'this location') AS name FROM m),
  counted AS (SELECT cluster, name, count(*) AS n, min("at") AS first FROM named GROUP BY ALL), best AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, first) AS r FROM counted)
  SELECT m.cluster, max(score) AS best, count(DISTINCT row_id) AS roles, count(DISTINCT printf('%.4f,%.4f', lng, lat)) = 1 AS is_stack, count(*) AS members, max(CASE WHEN b.n < 0.6 * (SELECT count(*) FROM m x WHERE x.cluster = m.cluster) THEN 'Near ' || b.name ELSE b.name END) AS place
  FROM m JOIN best b ON b.cluster = m.cluster AND b.r = 1 GROUP BY m.cluster""")
def map_clusters(spark, d):
    rows = spark.sql(_MEMBERS.replace("FROM customer", "FROM {customer}").replace("//", "div"), customer=table(spark, d, "customer"))
    return globe.place_summary(rows)


@query(f"SELECT min(lat) AS south, max(lat) AS north, min(lng) AS west, max(lng) AS east FROM ({_POINTS}) HAVING max(lng) - min(lng) < 360")
def map_bounds(spark, d):
    return globe.bounding_box(_points(spark, d), 360)


@query(f"SELECT count(*) AS total, count(*) FILTER (lat > 0) AS mapped, count(*) FILTER (lat <= 0) AS unmapped FROM ({_POINTS})")
def map_counts(spark, d):
    rows = _points(spark, d)
    return globe.mapped_counts(rows.select("id"), rows.where("lat > 0"))


@query("SELECT a, b, (b - a + 540) % 360 - 180 AS delta FROM (SELECT DISTINCT s_suppkey % 181 AS a, s_nationkey * 7 % 180 AS b FROM supplier)")
def longitude_delta(spark, d):
    rows = table(spark, d, "supplier").selectExpr("s_suppkey % 181 AS a", "s_nationkey * 7 % 180 AS b").distinct()
    return rows.withColumn("delta", globe.longitude_delta(F.col("a"), F.col("b")))
