"""Queries of whole rows: the upsert of all columns, cards of all fields, the pinned poll, the list of applications."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cohort, merge, views
from .queries import ORACLES, QUERIES
from .views import table


def _side(old: bool) -> str:
    a, b, c = (7, 3, 5) if old else (4, 5, 9)
    known = lambda n, value: f"CASE WHEN o_orderkey % {n} = 0 THEN NULL ELSE {value} END"
    tag = "old" if old else "new"
    wins = "" if old else ", o_orderkey % 11 = 0 AS apply_url_wins"
    return f"""SELECT CAST(o_orderkey AS STRING) AS id, concat('{tag}-', CAST(o_orderkey AS STRING)) AS url, concat('Title {tag} ', o_orderstatus) AS title, concat('Co ', CAST(o_custkey % {a} AS STRING)) AS company,
      {known(b, "o_orderpriority")} AS location, CASE o_orderkey % {a} WHEN 0 THEN 'remote' WHEN 1 THEN 'hybrid' END AS work_mode, CASE o_orderkey % {a} WHEN 0 THEN 'structured' WHEN 1 THEN 'text' END AS work_mode_source,
      CASE o_orderkey % {c} WHEN 0 THEN true WHEN 1 THEN false END AS remote, {known(c, "o_orderpriority")} AS seniority, {known(a, f"concat('{tag} ', o_orderstatus)")} AS salary, {known(b + 1, f"concat('{tag} apply ', o_orderstatus)")} AS apply_url,
      {known(a + 1, f"concat('{tag} text ', o_orderstatus)")} AS raw_jd, CASE WHEN o_orderkey % {b} = 1 THEN '{tag}' ELSE '' END AS stack, {known(a, "o_orderkey % 1000")} AS posted_at, o_orderkey % (900 + {a}) AS last_published_at,
      o_orderkey % (700 + {b}) AS last_seen_at, o_orderkey % (800 + {c}) AS checked_at, '{tag}' AS source, concat('{tag}', CAST(o_orderkey AS STRING)) AS external_id, o_orderkey % {c} AS first_seen_at,
      {known(c + 1, f"concat('2024-01-', lpad(CAST(1 + o_orderkey % {20 + a} AS STRING), 2, '0'), 'T00:00:00Z')")} AS checked{wins} FROM orders WHERE o_orderkey % 10 {'< 7' if old else '>= 3'}"""


def upsert_whole(spark, d):
    """Liveness holds a time, the side that it is from, and on the old side one key more."""
    sides = []
    for old in (True, False):
        rows = table(spark, d, "orders")
        rows.createOrReplaceTempView("orders_of_upsert")
        side = spark.sql(_side(old).replace("FROM orders", "FROM orders_of_upsert"))
        more = [F.lit("kept"), F.lit("yes")] if old else []
        held = F.create_map(F.lit("liveness_checked_at"), F.col("checked"), F.lit("by"), F.lit("old" if old else "new"), *more)
        sides.append(side.withColumn("liveness", F.when(F.col("checked").isNull(), F.create_map(*more).cast("map<string,string>") if more else F.create_map().cast("map<string,string>")).otherwise(held)).drop("checked"))
    out = merge.upsert_postings(*sides)
    live = F.col("liveness")
    return out.select(*[c for c in out.columns if c != "liveness"], *[F.element_at(live, k).alias(f"live_{k}") for k in ("liveness_checked_at", "by", "kept")])


QUERIES["upsert_whole"] = upsert_whole
_KEEPS = "(o.work_mode_source = 'structured' AND n.work_mode_source IS DISTINCT FROM 'structured')"
_NEWER = "(n.checked IS NOT NULL AND (o.checked IS NULL OR CAST(n.checked AS TIMESTAMP) >= CAST(o.checked AS TIMESTAMP)))"


def _merged(column: str, both: str) -> str:
    return f"CASE WHEN n.id IS NULL THEN o.{column} WHEN o.id IS NULL THEN n.{column} ELSE {both} END AS {column}"


_POLICIES = (
    [(c, f"n.{c}") for c in ("url", "title", "company")] + [(c, f"coalesce(n.{c}, o.{c})") for c in ("location", "seniority", "salary", "raw_jd")] + [(c, f"o.{c}") for c in ("source", "external_id", "first_seen_at")]
    + [(c, f"CASE WHEN {_KEEPS} THEN o.{c} ELSE coalesce(n.{c}, o.{c}) END") for c in ("work_mode", "work_mode_source")]
    + [("remote", f"CASE WHEN {_KEEPS} THEN o.remote WHEN n.work_mode IS NOT NULL THEN n.remote WHEN o.work_mode IS NOT NULL THEN o.remote ELSE coalesce(n.remote, o.remote) END"),
       ("apply_url", "CASE WHEN n.apply_url_wins THEN n.apply_url ELSE coalesce(o.apply_url, n.apply_url) END"), ("stack", "CASE WHEN n.stack <> '' THEN n.stack ELSE o.stack END"),
       ("posted_at", "least(n.posted_at, o.posted_at)"), ("last_published_at", "greatest(n.last_published_at, o.last_published_at)"), ("last_seen_at", "greatest(n.last_seen_at, o.last_seen_at)"),
       ("checked_at", "CASE WHEN n.checked_at >= o.checked_at THEN n.checked_at ELSE o.checked_at END")]
)
ORACLES["upsert_whole"] = f"""
    WITH v_old AS ({_side(True)}), v_new AS ({_side(False)})
    SELECT coalesce(n.id, o.id) AS id, {", ".join(_merged(*p) for p in _POLICIES)}, CASE WHEN n.id IS NULL THEN 'kept' WHEN o.id IS NULL THEN 'inserted' ELSE 'updated' END AS disposition,
      CASE WHEN n.id IS NULL OR (o.id IS NOT NULL AND NOT {_NEWER}) THEN o.checked ELSE n.checked END AS live_liveness_checked_at,
      CASE WHEN n.id IS NULL OR (o.id IS NOT NULL AND NOT {_NEWER}) THEN CASE WHEN o.checked IS NOT NULL THEN 'old' END WHEN n.checked IS NOT NULL THEN 'new' END AS live_by, CASE WHEN o.id IS NOT NULL THEN 'yes' END AS live_kept
    FROM v_old o FULL JOIN v_new n ON n.id = o.id"""

_POSTING = """SELECT CAST(doc_id AS STRING) AS id, concat('Dev ', source) AS title, concat('Co ', lang) AS company, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE source END AS location,
  CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'https://a.com/apply' WHEN 2 THEN '' ELSE 'ftp://x' END AS apply_url, CASE WHEN doc_id % 7 = 0 THEN 'nope' ELSE concat('https://a.com/', CAST(doc_id AS STRING)) END AS url, lang AS stack,
  doc_id % 3 = 0 AS remote, CASE WHEN doc_id % 3 = 1 THEN 'senior' END AS seniority, source, n_chars AS last_seen_at, CASE WHEN doc_id % 6 = 0 THEN NULL WHEN doc_id % 6 = 1 THEN '  ' ELSE text END AS raw_jd, CASE WHEN doc_id % 8 = 0 THEN '10k' END AS salary,
  n_chars % 100 AS posted_at, n_chars % 50 AS first_seen_at, n_chars % 70 AS last_published_at, CASE WHEN doc_id % 2 = 0 THEN 'hybrid' END AS work_mode, CASE doc_id % 5 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN 'maybe' END AS alive_said FROM documents"""
_STATUS = "SELECT CAST(doc_id AS STRING) AS posting_id, CASE doc_id % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'seen' WHEN 2 THEN 'applied' ELSE 'rejected' END AS status, CASE WHEN toxic = 1 THEN 'why' END AS reason, quality = 1 AS seen, doc_id % 9 AS seen_at FROM labels"
_SCORE = "SELECT CAST(doc_id AS STRING) AS posting_id, (doc_id * 37) % 101 AS score, CASE WHEN quality = 1 THEN 'fits' END AS reasons, CASE WHEN doc_id % 3 = 0 THEN 'a line' END AS fit_line, CASE WHEN toxic = 1 THEN 'skip' ELSE 'review' END AS recommendation FROM labels WHERE doc_id % 2 = 0"


def cards_whole(spark, d):
    for n in ("documents", "labels"):
        table(spark, d, n).createOrReplaceTempView(f"{n}_of_cards")
    of = lambda sql: spark.sql(sql.replace("FROM documents", "FROM documents_of_cards").replace("FROM labels", "FROM labels_of_cards"))
    postings = of(_POSTING).withColumn("liveness", F.create_map(F.lit("alive"), F.col("alive_said"))).drop("alive_said")
    scores = of(_SCORE).withColumn("payload", F.create_map(F.lit("fit_line"), F.col("fit_line"), F.lit("recommendation"), F.col("recommendation"), F.lit("fit_tier"), F.lit("good"))).drop("fit_line", "recommendation")
    return views.whole_cards(postings, of(_STATUS), scores, of("SELECT CAST(doc_id AS STRING) AS posting_id FROM labels WHERE doc_id % 3 = 0"))


QUERIES["cards_whole"] = cards_whole
ORACLES["cards_whole"] = f"""
    WITH p AS ({_POSTING}), s AS ({_STATUS}), c AS ({_SCORE}), e AS (SELECT CAST(doc_id AS STRING) AS posting_id FROM labels WHERE doc_id % 3 = 0)
    SELECT p.id, title, company, location, score, reasons, coalesce(nullif(apply_url, ''), url) AS apply_url, stack, remote, seniority, source, last_seen_at AS updated_at, CAST(NULL AS VARCHAR) AS logo, raw_jd IS NOT NULL AND trim(raw_jd) <> '' AS has_description,
      CASE WHEN seniority IS NOT NULL THEN 'extracted' ELSE 'unknown' END AS seniority_source, CASE WHEN p.id IN (SELECT posting_id FROM e) THEN 'extracted' ELSE 'not-extracted' END AS extraction, salary, url AS listing_url, posted_at, first_seen_at,
      coalesce(status, 'new') AS status, reason AS status_reason, fit_line, recommendation, CASE alive_said WHEN 'true' THEN true WHEN 'false' THEN false END AS alive, coalesce(nullif(apply_url, ''), url) AS link_url, CASE WHEN score >= 70 THEN 'strong' WHEN score >= 40 THEN 'more' WHEN score IS NOT NULL THEN 'below' END AS score_band,
      CASE WHEN c.posting_id IS NOT NULL THEN 'good' END AS fit_tier, coalesce(seen, false) AS seen, seen_at, CASE WHEN status NOT IN ('new', 'seen') THEN status END AS pipeline_status, last_published_at, work_mode
    FROM p LEFT JOIN s ON s.posting_id = p.id LEFT JOIN c ON c.posting_id = p.id"""


def _roles(spark, d):
    return table(spark, d, "documents").selectExpr("doc_id AS id", "n_chars AS first_seen", "CASE doc_id % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'seen' ELSE 'applied' END AS status", "CASE doc_id % 4 WHEN 0 THEN true WHEN 1 THEN false END AS alive", "doc_id % 5 = 0 AS relevance_filtered")


def pinned_roles(spark, d):
    """Three polls: all that came, the same cohort pinned before newer rows, and what the gate filtered."""
    rows = _roles(spark, d)
    probe = cohort.new_roles(rows.where("first_seen < 3000"), 500, "new-for-me", "active").limit(100)
    polls = (cohort.new_roles(rows, 500, "new-for-me", "active"), cohort.new_roles(rows, 500, "new-for-me", "active", pinned=probe), cohort.new_roles(rows, 900, "not-scored", "inactive"))
    out = [p.select(F.lit(k).alias("poll"), "id", "first_seen") for k, p in enumerate(polls)]
    return out[0].unionAll(out[1]).unionAll(out[2])


QUERIES["pinned_roles"] = pinned_roles
_ROLES = "SELECT doc_id AS id, n_chars AS first_seen, doc_id % 3 AS s, doc_id % 4 = 1 AS gone, doc_id % 5 = 0 AS filtered FROM documents"
_TAB = "WHERE first_seen > 500 AND NOT filtered AND s = 0 AND NOT gone"
ORACLES["pinned_roles"] = f"""
    WITH r AS ({_ROLES}), probe AS (SELECT id FROM r {_TAB} AND first_seen < 3000 ORDER BY first_seen DESC, id LIMIT 100)
    SELECT 0 AS poll, * FROM (SELECT id, first_seen FROM r {_TAB} ORDER BY first_seen DESC, id LIMIT 101)
    UNION ALL SELECT 1, * FROM (SELECT id, first_seen FROM r {_TAB} AND id IN (SELECT id FROM probe) ORDER BY first_seen DESC, id LIMIT 101)
    UNION ALL SELECT 2, * FROM (SELECT id, first_seen FROM r WHERE first_seen > 900 AND filtered AND gone ORDER BY first_seen DESC, id LIMIT 101)"""


def applications_of(spark, d):
    rows = table(spark, d, "orders").selectExpr("o_orderkey AS id", "concat(CASE o_orderkey % 3 WHEN 0 THEN ' ACME ' WHEN 1 THEN 'Acme' ELSE 'Beta' END, '') AS company", "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS applied", "o_custkey AS recorded")
    return cohort.applications_listed(rows, "acme ").select("id", "company", "applied", "recorded")


QUERIES["applications_of"] = applications_of
ORACLES["applications_of"] = "SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN ' ACME ' ELSE 'Acme' END AS company, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderdate AS DATE) END AS applied, o_custkey AS recorded FROM orders WHERE o_orderkey % 3 < 2"
