"""Postings, scores, statuses and their like, derived from the driver's tables.

Each view is one SELECT that Spark SQL and DuckDB read alike, so the engine and
the oracle start from the same rows. Arithmetic is on integers only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LOCATIONS = (
    "Tel Aviv, Israel", "Remote", "San Francisco, CA", "Berlin, Germany", "Hybrid / Remote", "", "New York, NY", "Haifa",
    "United States", "Austin, Texas Metropolitan Area", "On-site", "London, UK",
)
LEVELS = ("Senior", "Junior", "Staff", "Team Lead", "Intern", "Mid-level", "")


def _pick(values: tuple[str, ...], at: str) -> str:
    whens = " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values))
    return f"CASE {at} {whens} END"


VIEWS = {
    "v_postings": f"""
        SELECT lpad(CAST(doc_id AS STRING), 8, '0') AS id, source, CAST(doc_id AS STRING) AS external_id,
          concat('Company ', CAST(doc_id % 97 AS STRING)) AS company,
          concat({_pick(LEVELS, "doc_id % 7")}, ' ', {_pick(("Frontend Engineer", "Full Stack Developer", "Backend Engineer", "QA Lead", "Machine Learning Engineer"), "doc_id % 5")}) AS title,
          CASE WHEN doc_id % 13 = 0 THEN NULL ELSE {_pick(LOCATIONS, "doc_id % 12")} END AS location,
          CASE doc_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS remote,
          CASE WHEN doc_id % 5 = 0 THEN 'hybrid' END AS work_mode,
          CASE WHEN doc_id % 4 = 0 THEN {_pick(("Senior", "Entry", "Manager", "Principal", "intermediate"), "doc_id % 5")} END AS seniority,
          CASE doc_id % 4 WHEN 0 THEN 'React' WHEN 1 THEN 'Python,Docker' WHEN 2 THEN 'Go' ELSE '' END AS stack,
          (doc_id * 61) % 525600 AS first_seen, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE (doc_id * 61) % 525600 - (doc_id % 50) * 60 END AS posted,
          doc_id % 11 = 0 AS relevance_filtered,
          {_pick(('{"alive": true}', '{"alive": false}', '{"alive": null}', '{"alive": "false"}', '{}'), "doc_id % 5")} AS liveness,
          text AS raw_jd, doc_id
        FROM documents""",
    "v_scores": """
        SELECT lpad(CAST(d.doc_id AS STRING), 8, '0') AS posting_id, CASE WHEN d.doc_id % 6 = 0 THEN NULL ELSE (d.doc_id * 37) % 101 END AS score,
          CASE d.doc_id % 4 WHEN 0 THEN 'apply' WHEN 1 THEN 'referral' WHEN 2 THEN 'review' ELSE 'skip' END AS recommendation,
          CASE WHEN l.toxic = 1 THEN 'blocked' ELSE 'eligible' END AS eligibility
        FROM documents d JOIN labels l ON l.doc_id = d.doc_id""",
    "v_status": """
        SELECT lpad(CAST(doc_id AS STRING), 8, '0') AS posting_id,
          CASE doc_id % 5 WHEN 0 THEN 'seen' WHEN 1 THEN 'applied' WHEN 2 THEN 'rejected' WHEN 3 THEN 'worth_checking' ELSE 'new' END AS status,
          doc_id % 5 <> 4 AS seen
        FROM labels""",
    "v_old": """
        SELECT CAST(o_orderkey AS STRING) AS id, concat('url-', CAST(o_orderkey AS STRING)) AS url, concat('Title ', CAST(o_orderkey % 10 AS STRING)) AS title,
          CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS location, CASE o_orderkey % 3 WHEN 0 THEN 'remote' WHEN 1 THEN 'hybrid' END AS work_mode,
          CASE o_orderkey % 3 WHEN 0 THEN 'structured' WHEN 1 THEN 'text' END AS work_mode_source, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 1000 END AS posted_at,
          o_orderkey % 900 AS last_published_at, o_orderkey % 700 AS last_seen_at, o_orderkey % 800 AS checked_at, o_orderstatus AS status,
          CASE WHEN o_orderkey % 2 = 0 THEN 'React' ELSE '' END AS stack
        FROM orders WHERE o_orderkey % 10 < 7""",
    "v_new": """
        SELECT CAST(o_orderkey AS STRING) AS id, concat('url2-', CAST(o_orderkey AS STRING)) AS url, concat('Title ', CAST(o_orderkey % 7 AS STRING)) AS title,
          CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS location, CASE o_orderkey % 4 WHEN 0 THEN 'on-site' WHEN 1 THEN 'remote' END AS work_mode,
          CASE o_orderkey % 4 WHEN 0 THEN 'structured' WHEN 1 THEN 'text' END AS work_mode_source, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderkey % 777 END AS posted_at,
          o_orderkey % 950 AS last_published_at, o_orderkey % 650 AS last_seen_at, o_orderkey % 811 AS checked_at, CASE WHEN o_orderkey % 9 = 0 THEN 'P' ELSE o_orderstatus END AS status,
          CASE WHEN o_orderkey % 3 = 0 THEN 'Vue' ELSE '' END AS stack
        FROM orders WHERE o_orderkey % 10 >= 3""",
    "v_geo": "SELECT s_suppkey AS posting_id, s_nationkey AS company, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE (s_suppkey * 7) % 180 - 90 END AS lat, s_suppkey % 2 = 0 AS remote, CASE s_suppkey % 4 WHEN 0 THEN ' Remote ' WHEN 1 THEN 'Haifa' WHEN 2 THEN NULL ELSE 'anywhere' END AS location FROM supplier",
    "v_hq": "SELECT n_nationkey AS company, n_nationkey * 3 AS lat FROM nation WHERE n_nationkey % 5 <> 0",
    "v_observations": """
        SELECT user_id AS key, event_id AS at, CASE event_type WHEN 'signup' THEN 'present' WHEN 'view' THEN 'present' WHEN 'click' THEN 'absent' WHEN 'purchase' THEN 'absent' ELSE 'unknown' END AS seen
        FROM events""",
}

VIEWS["v_arrivals"] = """
        SELECT doc_id AS arrival, CASE doc_id % 3 WHEN 0 THEN 'lever' WHEN 1 THEN 'ashby' ELSE 'linkedin' END AS source, CAST((doc_id * 7) % 180 AS STRING) AS id, concat('Co ', CAST((doc_id * 5) % 37 AS STRING)) AS company,
          concat('Dev ', CAST(doc_id % 4 AS STRING)) AS title
        FROM documents"""
#: For the oracle alone: arrivals by number, with their keys.
VIEWS["numbered"] = "SELECT *, row_number() OVER (ORDER BY arrival) AS n, lower(company) || '|' || lower(title) AS key FROM v_arrivals"
#: Tables that each view reads.
TABLES = {
    "v_postings": ["documents"], "v_scores": ["documents", "labels"], "v_status": ["labels"], "v_old": ["orders"], "v_new": ["orders"],
    "v_geo": ["supplier"], "v_hq": ["nation"], "v_observations": ["events"], "v_arrivals": ["documents"],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view as a lazy frame; columns that aren't used aren't read."""
    sql = VIEWS[name]
    for t in TABLES[name]:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(sql.replace('{"alive', '{{"alive').replace("}'", "}}'").replace("'{}}'", "'{{}}'"), **{t: table(spark, sf_dir, t) for t in TABLES[name]})


def with_views(sql: str, *names: str) -> str:
    """``sql`` after the definitions of the views it reads."""
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names) + sql
