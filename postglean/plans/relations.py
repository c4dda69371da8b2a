"""Queries of relational operators beside the board: feeds, writes, cards, map, checks. Each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import gate, texts
from ..functions import postings as fn
from ..operators import board as B
from ..operators import globe, ingest, liveness, registry, views, writes
from ..sources import boards, feeds
from .queries import _CARD, _INACTIVE, _PURSUED, _ROWS, BOARD, SPLIT, _board, query
from .views import table, view

P = ("v_postings",)


def _of(spark, d, sql: str, *names: str):
    """A SELECT over the driver's tables, as the oracle reads it."""
    for t in names:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(sql.replace("//", "div"), **{t: table(spark, d, t) for t in names})


# ---- what a reader is shown


def _facet(name: str, where: str, **params):
    @query(_ROWS + f"SELECT {', '.join(_CARD)} FROM board WHERE NOT relevance_filtered AND NOT inactive AND {where} ORDER BY score DESC NULLS LAST, sort_posted DESC, id LIMIT 300", BOARD)
    def run(spark, d):
        return B.board_postings(_board(spark, d), most=300, **params).select(_CARD)

    return run


def _register_facets():
    from .queries import ORACLES, QUERIES

    every = {
        "facet_skip": ("score IS NOT NULL AND recommendation = 'skip'", {"fit": "skip"}), "facet_good": ("score >= 60", {"fit": "good"}), "facet_scored": ("score IS NOT NULL", {"fit": "scored"}),
        "facet_unscored": ("score IS NULL", {"fit": "unscored"}), "facet_hybrid": ("mode = 'hybrid'", {"mode": "hybrid"}), "facet_on_site": ("mode = 'on-site'", {"mode": "on-site"}),
        "facet_united_states": ("place_group = 'united-states'", {"location": "united-states"}), "facet_other_places": ("place_group = 'other'", {"location": "other"}), "facet_senior": ("level = 3", {"seniority": "Senior"}),
        "facet_unknown_level": ("level = 6", {"seniority": "Unknown"}), "facet_found_7d": ("first_seen >= 15000 - 168 * 60", {"found_within": "7d", "now": 15000}), "facet_source": ("source = 'src2'", {"source": "src2"}),
    }
    for name, (where, params) in every.items():
        run = _facet(name, where, **params)
        QUERIES[name], ORACLES[name] = run, ORACLES.pop("run")
        QUERIES.pop("run")


_register_facets()

_URL = "'https://apply.workable.com/acme/jobs/view/' || external_id || '.md'"
_CARDS = _ROWS + f""", cards AS (SELECT id, title, company, location, source, 'https://apply.workable.com/acme/j/' || external_id || '/' AS url, remote, work_mode, seniority, stack, posted, first_seen, status, score,
  CASE WHEN score >= 70 THEN 'strong' WHEN score >= 40 THEN 'more' WHEN score IS NOT NULL THEN 'below' END AS score_band, recommendation,
  CASE WHEN score >= 80 THEN 'strong' WHEN score >= 60 THEN 'good' WHEN score >= 40 THEN 'stretch' WHEN score IS NOT NULL THEN 'weak' END AS fit_tier, doc_id % 3 = 0 AS extracted, length(raw_jd) AS jd_length, raw_jd FROM board)
"""


def _linked(spark, d):
    b = _board(spark, d)
    return B.Board(b.postings.withColumn("url", F.concat(F.lit("https://apply.workable.com/acme/jobs/view/"), "external_id", F.lit(".md"))).withColumn("apply_url", F.lit(None).cast("string")), b.statuses, b.scores)


def _extracted(spark, d):
    return view(spark, d, "v_postings").where("doc_id % 3 = 0").select("id")


@query(_CARDS + f"SELECT {', '.join(views.CARD)} FROM cards", BOARD)
def job_cards(spark, d):
    return views.cards(_linked(spark, d), _extracted(spark, d))


@query(_CARDS + f"SELECT {', '.join(views.CARD)}, raw_jd FROM cards WHERE id IN (SELECT id FROM v_postings WHERE doc_id % 5 = 1)", BOARD)
def job_details(spark, d):
    return views.details(_linked(spark, d), _extracted(spark, d), view(spark, d, "v_postings").where("doc_id % 5 = 1"))


@query(_ROWS + f"""SELECT id, title, company, coalesce(seniority, {{level}}) AS seniority, status, CASE WHEN NOT relevance_filtered THEN score END AS score, CASE WHEN NOT relevance_filtered THEN recommendation END AS recommendation, eligibility,
  CASE WHEN inactive THEN 'closed' WHEN doc_id % 5 = 0 AND 3000 - doc_id % 3000 <= 180 THEN 'confirmed' ELSE 'stale' END AS state FROM board""".replace("{level}", __import__("postglean.plans.queries", fromlist=["_TITLE_LEVEL"])._TITLE_LEVEL), BOARD)
def job_summaries(spark, d):
    alive = F.when(fn.is_inactive("liveness"), False).when(F.col("doc_id") % 5 == 0, True)
    return views.summaries(_board(spark, d), liveness.projected_state(alive, F.col("doc_id") % 3000, F.lit(None), F.lit(None), 3000))


@query(_ROWS + "SELECT id FROM board WHERE contains(lower(title || ' ' || company || ' ' || coalesce(location, '') || ' ' || source || ' ' || replace(stack, ',', ' ')), 'haifa')", BOARD)
def search_needle(spark, d):
    return _board(spark, d).rows().where(views.matches_needle(" HAIFA ", F.col("company"))).select("id")


@query(_ROWS + "SELECT id FROM board WHERE score IS NOT NULL AND score >= 60 AND first_seen >= 3000 AND place_group = 'united-states' AND level NOT IN (3, 4, 5) AND status IN ('new', 'applied')", BOARD)
def client_view(spark, d):
    rows = _board(spark, d).rows()
    return rows.where(views.matches_view(found_since=3000, location="united-states", seniority="non-senior", statuses=("new", "applied"), fit="good")).select("id")


@query(_ROWS + "SELECT id, score FROM board ORDER BY coalesce(score, -1) DESC, sort_posted DESC, id LIMIT 250", BOARD)
def representatives_by_fit(spark, d):
    return views.representatives_sorted(_board(spark, d).rows(), "fit", 250).select("id", "score")


@query(" SELECT company, list(id ORDER BY first_seen DESC, id) AS ids FROM v_postings GROUP BY 1", P)
def company_cards(spark, d):
    return views.cards_in_order(view(spark, d, "v_postings"), "company")


@query(" SELECT list(DISTINCT lower(company) ORDER BY lower(company)) AS companies FROM v_postings WHERE first_seen > 2000", P)
def probe_companies(spark, d):
    return views.companies_probed(view(spark, d, "v_postings").where("first_seen > 2000"), F.lower("company"))


@query("SELECT CAST(event_id % 977 AS VARCHAR) || 'z' AS since FROM events ORDER BY event_id % 977 DESC, CAST(event_id % 977 AS VARCHAR) || 'z' DESC LIMIT 1")
def newest_cursor(spark, d):
    return views.newest_cursor(table(spark, d, "events").selectExpr("event_id % 977 AS first_seen", "concat(CAST(event_id % 977 AS STRING), 'z') AS raw"))


@query("SELECT o_orderkey AS id, o_custkey AS posting_id, o_orderkey % 1000 AS recorded_at FROM orders WHERE o_custkey = (SELECT max(o_custkey) FROM orders) ORDER BY recorded_at DESC, id LIMIT 20")
def history_newest(spark, d):
    rows = table(spark, d, "orders").selectExpr("o_orderkey AS id", "o_custkey AS posting_id", "o_orderkey % 1000 AS recorded_at")
    return views.history_newest(rows, rows.agg(F.max("posting_id")).first()[0])


@query("SELECT list(DISTINCT source ORDER BY source) AS sources FROM (SELECT source FROM documents UNION ALL SELECT 'gone')")
def source_options(spark, d):
    return views.source_options(table(spark, d, "documents"), "gone")


@query(" SELECT id FROM v_postings WHERE doc_id % 40 = 7 AND id <> '00000007' ORDER BY coalesce(posted, first_seen) DESC, id", P)
def related_listings(spark, d):
    return views.related(view(spark, d, "v_postings").withColumn("group_id", F.col("doc_id") % 40), "00000007")


@query("SELECT event_id AS id, 'Title ' || CAST(event_id % 7 AS VARCHAR) AS title, CASE WHEN event_id % 3 = 0 THEN event_id % 100 ELSE coalesce(CASE WHEN event_id % 5 > 0 THEN event_id % 50 END, 0) END AS value FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-14' AND DATE '2024-01-20' AND event_id % 11 > 0 ORDER BY value DESC, title, id LIMIT 20")
def top_of_recent(spark, d):
    feed = table(spark, d, "events").selectExpr("event_id AS id", "concat('Title ', CAST(event_id % 7 AS STRING)) AS title", "CAST(ts AS DATE) AS feed_date", "CASE WHEN event_id % 11 > 0 THEN 'u' ELSE '' END AS url",
        "CASE WHEN event_id % 3 = 0 THEN 'ok' END AS luna_status", "event_id % 100 AS fit_score", "CASE WHEN event_id % 5 > 0 THEN event_id % 50 END AS score")
    return views.top_of_recent(feed, "2024-01-20").select("id", "title", views.ranked_value("score", "fit_score", "luna_status").alias("value"))


@query("""SELECT id, text, CASE WHEN text LIKE '%new york city%' THEN 'nyc' WHEN text LIKE '%new york%' THEN 'ny' WHEN text LIKE '% haifa' THEN 'haifa' END AS value
  FROM (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'in new york city now' WHEN 1 THEN 'new york' WHEN 2 THEN 'to haifa' WHEN 3 THEN 'haifans' ELSE 'new  york' END AS text FROM part)""")
def facts_by_alias(spark, d):
    facts = table(spark, d, "part").selectExpr("p_partkey AS id", "CASE p_partkey % 5 WHEN 0 THEN 'in new york city now' WHEN 1 THEN 'new york' WHEN 2 THEN 'to haifa' WHEN 3 THEN 'haifans' ELSE 'new  york' END AS text")
    return views.facts_vs_aliases(facts, spark.createDataFrame([("New York", "ny"), ("New York City", "nyc"), ("Haifa", "haifa")], "alias string, value string"))


@query(" SELECT id, lat, source FROM (SELECT id, lat, 'incoming' AS source FROM (SELECT id, checked_at AS lat FROM v_new WHERE checked_at % 3 > 0) WHERE id NOT IN (SELECT n.id FROM v_new n JOIN v_old o ON o.id = n.id WHERE n.checked_at % 4 = 0) UNION ALL SELECT n.id, n.checked_at, 'latest' FROM v_new n JOIN v_old o ON o.id = n.id WHERE n.checked_at % 4 = 0 UNION ALL SELECT id, checked_at, 'previous' FROM v_old WHERE id NOT IN (SELECT id FROM v_new WHERE checked_at % 3 > 0) AND id NOT IN (SELECT n.id FROM v_new n JOIN v_old o ON o.id = n.id WHERE n.checked_at % 4 = 0))", SPLIT)
def globe_cohort(spark, d):
    points = lambda name, where, source: view(spark, d, name).where(where).select("id", F.col("checked_at").alias("lat"), F.lit(source).alias("source"))
    return views.cohort_of_globe(points("v_old", "true", "previous"), points("v_new", "checked_at % 3 > 0", "incoming"), points("v_new", "checked_at % 4 = 0", "latest"))


# ---- the map


@query("SELECT count(*) AS total_count, count(*) FILTER (c_custkey % 3 = 0) AS resolved_count, count(*) FILTER (c_custkey % 3 <> 0) AS unresolved_count, true AS sound FROM customer")
def snapshot_counts(spark, d):
    jobs = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    points = jobs.where("id % 3 = 0")
    return globe.snapshot_counts(jobs, points.unionAll(points))


@query("SELECT c_nationkey AS group_id, count(*) FILTER (c_custkey % 50 = 0 AND c_custkey % 4 <> 0) > 0 AS on_screen FROM customer GROUP BY 1")
def visible_roles(spark, d):
    rows = table(spark, d, "customer").selectExpr("c_nationkey AS group_id", "c_custkey AS id", "CASE c_custkey % 4 WHEN 0 THEN false WHEN 1 THEN true END AS alive")
    return globe.visible_groups(rows, rows.where("id % 50 = 0"))


@query("WITH p AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey % 997, o_orderkey) - 1 AS i, (SELECT count(*) FROM orders) AS n FROM orders), t AS (SELECT *, CAST(ceil(n / 499.0) AS BIGINT) AS stride FROM p) SELECT id FROM t WHERE id = 5 OR i % stride = 0 ORDER BY id <> 5, i LIMIT 500")
def thinned_points(spark, d):
    rows = table(spark, d, "orders").selectExpr("o_orderkey AS id", "o_orderkey % 997 AS at")
    return globe.thinned(rows, 5, 500).select("id")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'Unscored' WHEN c_custkey % 101 >= 80 THEN '80–100' WHEN c_custkey % 101 >= 60 THEN '60–79' ELSE 'Below 60' END AS band FROM customer")
def score_bands(spark, d):
    rows = table(spark, d, "customer").selectExpr("c_custkey AS id", "CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 101 END AS score")
    return rows.select("id", globe.score_band("score").alias("band"))


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 1300 BETWEEN 0 AND 800 AND c_custkey % 700 <= 600 AND c_custkey % 6 <> 0")
def viewport_points(spark, d):
    rows = table(spark, d, "customer").selectExpr("c_custkey AS id", "CASE WHEN c_custkey % 5 = 0 THEN false END AS alive", "double(c_custkey % 1300) AS x", "double(c_custkey % 700) AS y", "180.0d - c_custkey % 3 AS lng", "10.0d AS lat",
        "CASE WHEN c_custkey % 6 = 0 THEN -170.0d WHEN c_custkey % 3 = 0 THEN -180.0d ELSE 180.0d - c_custkey % 3 END AS back_lng", "10.005d AS back_lat")
    return globe.in_viewport(rows, 800, 600)


@query()
def screen_clusters(spark, d):
    rows = table(spark, d, "customer").selectExpr("c_nationkey AS view", "c_custkey AS id", "c_custkey AS at", "double(c_custkey * 37 % 800) AS x", "double(c_custkey * 91 % 600) AS y")
    return globe.screen_clusters(rows)


# ---- feeds and registry


@query("SELECT DISTINCT CASE event_id % 4 WHEN 0 THEN 'lever' WHEN 1 THEN 'ashby' ELSE 'linkedin' END AS source, CASE WHEN event_id % 4 = 1 THEN 'ashby:' ELSE '' END || CAST(event_id % 500 AS VARCHAR) AS id FROM events WHERE CAST(ts AS DATE) < DATE '2024-01-15'")
def prior_identities(spark, d):
    feed = table(spark, d, "events").selectExpr("CASE event_id % 4 WHEN 0 THEN 'Lever' WHEN 2 THEN 'LinkedIn' END AS source", "concat(CASE WHEN event_id % 4 = 1 THEN 'ashby:' ELSE '' END, CAST(event_id % 500 AS STRING)) AS id", "CAST(ts AS DATE) AS feed_date")
    return ingest.prior_identities(feed, "2024-01-15")


@query(" SELECT id, title, company, coalesce(location, '') AS location, 'u' || id AS url, source, 'linkedin-guest' AS source_tenant, '' AS posted_at, '' AS jd_text, '0' AS score FROM v_postings", P)
def feed_rows(spark, d):
    return feeds.feed_rows(view(spark, d, "v_postings").select("id", "title", "company", "location", F.concat(F.lit("u"), "id").alias("url"), "source"))


@query("SELECT o_orderkey AS id, 'T' || CAST(o_orderkey % 9 AS VARCHAR) AS title, o_orderkey % 50 AS score, CASE WHEN o_orderkey % 4 = 0 THEN 'ok' END AS luna_status, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 100 END AS fit_score FROM orders")
def annotated_feed(spark, d):
    feed = table(spark, d, "orders").selectExpr("o_orderkey AS id", "concat('T', CAST(o_orderkey % 9 AS STRING)) AS title", "o_orderkey % 50 AS score")
    return feeds.annotated(feed, feed.where("id % 4 = 0").selectExpr("id", "'ok' AS luna_status", "id % 100 AS fit_score"))


@query("SELECT o_orderkey AS id, '| ' || CAST(o_orderkey % 50 AS VARCHAR) || ' | T\\|' || CAST(o_orderkey % 9 AS VARCHAR) || ' | Co | x y |' AS line FROM orders WHERE o_orderkey % 3 <> 0 ORDER BY o_orderkey % 50 DESC, o_orderkey % 9, o_orderkey LIMIT 10")
def feed_summary(spark, d):
    rows = table(spark, d, "orders").selectExpr("o_orderkey AS id", "concat('T|', CAST(o_orderkey % 9 AS STRING)) AS title", "'Co' AS company", "'x\\ny' AS location", "o_orderkey % 50 AS score", "CAST(null AS BIGINT) AS fit_score", "CAST(null AS STRING) AS luna_status", "CASE o_orderkey % 3 WHEN 0 THEN false WHEN 1 THEN true END AS alive")
    return feeds.summary_lines(rows)


@query("SELECT DISTINCT page_id AS reference, unnest(CASE WHEN page_id % 3 = 0 THEN ['https://a.b/' || CAST(page_id AS VARCHAR), 'https://c.d/x'] WHEN page_id % 3 = 1 THEN ['http://e.f/g,'] ELSE CAST([] AS VARCHAR[]) END) AS url FROM pages")
def corpus_links(spark, d):
    line = "CASE page_id % 3 WHEN 0 THEN concat('- [A](https://a.b/', CAST(page_id AS STRING), ') and [B](https://c.d/x) again [A](https://c.d/x) http://raw') WHEN 1 THEN 'see http://e.f/g, now' ELSE 'no link' END AS line"
    return ingest.corpus_links(table(spark, d, "pages").selectExpr("page_id AS reference", line))


@query("SELECT 'src' AS source, s_suppkey AS key, 'old ' || CAST(s_suppkey AS VARCHAR) AS company FROM supplier UNION ALL SELECT 'src', c_custkey // 2, min('new ' || CAST(c_custkey AS VARCHAR)) FROM customer WHERE c_custkey // 2 NOT IN (SELECT s_suppkey FROM supplier) GROUP BY c_custkey // 2")
def registry_merge(spark, d):
    old = table(spark, d, "supplier").selectExpr("'src' AS source", "s_suppkey AS key", "concat('old ', CAST(s_suppkey AS STRING)) AS company")
    new = table(spark, d, "customer").selectExpr("'src' AS source", "c_custkey div 2 AS key", "concat('new ', CAST(c_custkey AS STRING)) AS company")
    return ingest.merged_registry(old, new)


@query("SELECT vec_id AS posting_id, label, CASE WHEN vec_id % 4 = 0 THEN 'stored' ELSE 'fresh' END AS origin FROM embeddings")
def embedding_store(spark, d):
    rows = table(spark, d, "embeddings").selectExpr("vec_id AS posting_id", "CAST(vec_id AS STRING) AS sha256", "'m' AS model", "'r' AS revision", "embedding", "label")
    stored = rows.where("posting_id % 4 = 0").withColumn("origin", F.lit("stored"))
    return feeds.store_embeddings(stored, rows.withColumn("origin", F.lit("fresh"))).select("posting_id", "label", "origin")


@query("""SELECT '[' || string_agg('{"id":' || CAST(r_regionkey AS VARCHAR) || ',"name":"' || r_name || '"}', ',' ORDER BY r_regionkey) || ']' AS document FROM region""")
def result_document(spark, d):
    return feeds.as_document(table(spark, d, "region").selectExpr("r_regionkey AS id", "r_name AS name"), "document")


_LANDED = """SELECT s_suppkey AS n, CASE s_suppkey % 4 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' WHEN 2 THEN 'ashby' ELSE 'comeet' END AS source, concat('t', CAST(s_suppkey AS STRING)) AS tenant FROM supplier"""


@query("""SELECT source, tenant, source || ':' || tenant || ':' || k AS id, 'Job ' || k AS title, CASE WHEN source = 'ashby' THEN 'Haifa; Berlin' ELSE 'Haifa' END AS location,
    CASE source WHEN 'ashby' THEN 'https://jobs.ashbyhq.com/' || tenant || '/' || k ELSE 'https://x/' || k END AS url
  FROM (SELECT CASE s_suppkey % 4 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' WHEN 2 THEN 'ashby' ELSE 'comeet' END AS source, 't' || CAST(s_suppkey AS VARCHAR) AS tenant, unnest(['1', '2']) AS k FROM supplier WHERE s_suppkey % 5 <> 0)""")
def boards_landed(spark, d):
    rows = _of(spark, d, _LANDED, "supplier")
    job = {
        "greenhouse": lambda k: f'{{"id":{k},"title":"Job {k}","content":"x","absolute_url":"https://x/{k}","location":{{"name":"Haifa"}}}}',
        "lever": lambda k: f'{{"id":"{k}","text":"Job {k}","hostedUrl":"https://x/{k}","categories":{{"location":"Haifa"}}}}',
        "ashby": lambda k: f'{{"id":"{k}","title":"Job {k}","isListed":true,"location":"Haifa","secondaryLocations":[{{"location":"Berlin"}},{{"location":"Haifa"}}],"jobUrl":"https://jobs.ashbyhq.com/@/{k}"}}',
        "comeet": lambda k: f'{{"uid":"{k}","name":"Job {k}","url_comeet_hosted_page":"https://x/{k}","location":{{"name":"Haifa"}}}}',
    }
    whole = {"greenhouse": '{"jobs":[%s,{"title":"no id"}]}', "lever": "[%s]", "ashby": '{"jobs":[%s]}', "comeet": "<script>COMPANY_POSITIONS_DATA = [%s];</script>"}
    body = F.lit(None).cast("string")
    for source, text in whole.items():
        body = F.when(F.col("source") == source, F.replace(F.lit(text % ",".join(job[source](k) for k in "12")), F.lit("@"), F.col("tenant"))).otherwise(body)
    return boards.all_boards(rows.withColumn("body", F.when(F.col("n") % 5 == 0, "not a board").otherwise(body)))


@query("SELECT 't' || CAST(n_nationkey AS VARCHAR) AS tenant, id, n_nationkey % 4 NOT IN (1, 2) AS whole FROM nation, (SELECT unnest(['a', 'b', 'c']) AS id)")
def smartrecruiters_lists(spark, d):
    rows = table(spark, d, "nation").select(F.concat(F.lit("t"), F.col("n_nationkey").cast("string")).alias("tenant"), (F.col("n_nationkey") % 4).alias("m"))
    pages = rows.withColumn("p", F.explode(F.array(F.lit(0), F.lit(2)))).withColumn("offset", F.col("p"))
    total = F.when(F.col("m") == 1, F.when(F.col("p") == 0, 3).otherwise(4)).when(F.col("m") == 2, 9).otherwise(3)
    ids = F.when(F.col("p") == 0, '{"id":"a"},{"id":"b"}').otherwise('{"id":"c"}')
    return boards.smartrecruiters_list(pages.select("tenant", "offset", F.concat(F.lit('{"totalFound":'), total.cast("string"), F.lit(',"content":['), ids, F.lit("]}")).alias("body")))


@query("SELECT 't' || CAST(n_nationkey AS VARCHAR) AS tenant, id, n_nationkey % 3 <> 1 AS whole, false AS too_large FROM nation, (SELECT unnest(['/a', '/b', '/c']) AS id)")
def workday_lists(spark, d):
    rows = table(spark, d, "nation").select(F.concat(F.lit("t"), F.col("n_nationkey").cast("string")).alias("tenant"), (F.col("n_nationkey") % 3).alias("m"))
    pages = rows.withColumn("offset", F.explode(F.array(F.lit(0), F.lit(20))))
    first = F.col("offset") == 0
    total = F.when(first, F.when(F.col("m") == 1, 4).otherwise(3)).otherwise(F.when(F.col("m") == 2, 0).otherwise(3))
    ids = F.when(first, '{"externalPath":"/a"},{"externalPath":"/b"}').otherwise('{"externalPath":"/c"}')
    return boards.workday_list(pages.select("tenant", "offset", F.concat(F.lit('{"total":'), total.cast("string"), F.lit(',"jobPostings":['), ids, F.lit("]}")).alias("body")))


@query("SELECT 't' || CAST(n_nationkey AS VARCHAR) AS tenant, CASE n_nationkey % 3 WHEN 0 THEN 'locationCountry' ELSE 'locationHierarchy1' END AS parameter, ['i' || CAST(n_nationkey AS VARCHAR)] AS ids FROM nation WHERE n_nationkey % 3 < 2")
def workday_facets(spark, d):
    top = '{"facets":[{"facetParameter":"other","values":[{"descriptor":"Israel","id":"no"}]},{"facetParameter":"locationCountry","values":[{"descriptor":"Spain","id":"s"},{"descriptor":"Israel","id":"i@"}]}]}'
    deep = '{"facets":[{"facetParameter":"group","values":[{"facetParameter":"locationHierarchy1","values":[{"descriptor":"Israel","id":"i@"}]}]}]}'
    n = F.col("n_nationkey")
    body = F.replace(F.when(n % 3 == 0, top).when(n % 3 == 1, deep).otherwise('{"facets":[]}'), F.lit("@"), n.cast("string"))
    return boards.country_facets(table(spark, d, "nation").select(F.concat(F.lit("t"), n.cast("string")).alias("tenant"), body.alias("body")), "Israel")


# ---- writes

_CHANGES = """SELECT o_orderkey AS posting_id, CASE o_orderkey % 6 WHEN 0 THEN 'rejected' WHEN 1 THEN 'applied' WHEN 2 THEN 'new' WHEN 3 THEN 'nonsense' WHEN 4 THEN 'not_relevant' ELSE 'rejected' END AS status,
  CASE o_orderkey % 6 WHEN 0 THEN 'why' WHEN 4 THEN CASE WHEN o_orderkey % 4 = 0 THEN ' ' END WHEN 1 THEN CASE WHEN o_orderkey % 5 = 0 THEN 'no' END END AS reason FROM orders"""
_STORED = "SELECT o_orderkey AS posting_id, CASE o_orderkey % 3 WHEN 0 THEN 'rejected' WHEN 1 THEN 'applied' ELSE 'new' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN 'why' END AS reason, o_orderkey % 3 < 2 AS seen, 5 AS updated_at FROM orders WHERE o_orderkey % 2 = 0"
_AFTER = f"""WITH stored AS ({_STORED}), changes AS ({_CHANGES}), valid AS (SELECT * FROM changes WHERE posting_id % 7 <> 0 AND status <> 'nonsense' AND NOT (status = 'rejected' AND reason IS NULL) AND NOT (status = 'not_relevant' AND coalesce(reason, '') = ' ') AND NOT (status = 'applied' AND reason IS NOT NULL)),
  after AS (SELECT coalesce(s.posting_id, v.posting_id) AS posting_id, coalesce(v.status, s.status) AS status, CASE WHEN v.posting_id IS NULL THEN s.reason ELSE v.reason END AS reason,
    CASE WHEN v.posting_id IS NULL OR (s.posting_id IS NOT NULL AND s.status = v.status AND s.reason IS NOT DISTINCT FROM v.reason) THEN s.seen ELSE v.status <> 'new' END AS seen,
    CASE WHEN v.posting_id IS NULL OR (s.posting_id IS NOT NULL AND s.status = v.status AND s.reason IS NOT DISTINCT FROM v.reason) THEN s.updated_at ELSE 9 END AS updated_at FROM stored s FULL JOIN valid v ON v.posting_id = s.posting_id)
"""


def _statuses(spark, d):
    stored, changes = _of(spark, d, _STORED, "orders"), _of(spark, d, _CHANGES, "orders")
    known = table(spark, d, "orders").where("o_orderkey % 7 <> 0").selectExpr("o_orderkey AS id", "o_orderpriority AS company", "o_orderstatus AS title")
    return stored, writes.statuses_set(stored, changes, known, 9), known


@query(_AFTER + "SELECT * FROM after")
def statuses_set(spark, d):
    return _statuses(spark, d)[1]


@query(_AFTER + "SELECT a.posting_id, o_orderpriority AS company, o_orderstatus AS role, a.updated_at AS recorded_at, s.status AS status_from, a.status AS status_to, a.reason FROM after a LEFT JOIN stored s ON s.posting_id = a.posting_id JOIN orders ON o_orderkey = a.posting_id WHERE o_orderkey % 7 <> 0 AND (s.posting_id IS NULL OR s.status <> a.status OR s.reason IS DISTINCT FROM a.reason)")
def status_changes(spark, d):
    return writes.status_changes(*_statuses(spark, d))


@query(f"WITH s AS ({_STORED}), o AS (SELECT DISTINCT o_orderkey AS posting_id FROM orders WHERE o_orderkey % 5 < 2) SELECT coalesce(s.posting_id, o.posting_id) AS posting_id, CASE WHEN o.posting_id IS NOT NULL AND coalesce(s.status, 'new') = 'new' THEN 'seen' ELSE s.status END AS status, CASE WHEN o.posting_id IS NOT NULL THEN true ELSE s.seen END AS seen FROM s FULL JOIN o ON o.posting_id = s.posting_id")
def marked_seen(spark, d):
    return writes.marked_seen(_of(spark, d, _STORED, "orders").select("posting_id", "status", "seen"), table(spark, d, "orders").where("o_orderkey % 5 < 2").selectExpr("o_orderkey AS posting_id"))


@query(f"WITH s AS ({_STORED}), o AS (SELECT DISTINCT o_orderkey AS posting_id FROM orders WHERE o_orderkey % 5 < 2) SELECT coalesce(s.posting_id, o.posting_id) AS posting_id, CASE WHEN o.posting_id IS NOT NULL AND coalesce(s.status, 'new') = 'new' THEN 'seen' ELSE s.status END AS status, CASE WHEN o.posting_id IS NOT NULL AND coalesce(s.status, 'new') = 'new' THEN true ELSE s.seen END AS seen FROM s FULL JOIN o ON o.posting_id = s.posting_id")
def seen_automatically(spark, d):
    return writes.marked_seen(_of(spark, d, _STORED, "orders").select("posting_id", "status", "seen"), table(spark, d, "orders").where("o_orderkey % 5 < 2").selectExpr("o_orderkey AS posting_id"), automatic=True)


def _gates(spark, d):
    n = F.col("o_orderkey")
    every = F.create_map(F.lit("override"), F.when(n % 3 == 0, "true").when(n % 3 == 1, "false"), F.lit("rule"), F.when(n % 2 == 0, "equity-only"), F.lit("score_requested"), F.when(n % 5 == 0, "true"))
    return table(spark, d, "orders").select(n.alias("id"), F.map_filter(every, lambda _, v: v.isNotNull()).alias("gate"))


_GATE_COLUMNS = [F.element_at("gate", F.lit(k)).alias(k) for k in ("override", "rule", "score_requested")] if False else ("override", "rule", "score_requested")


def _flat(rows):
    return rows.select("id", *[F.element_at("gate", F.lit(k)).alias(k) for k in _GATE_COLUMNS])


_GATE_SQL = "SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' END AS override, CASE WHEN o_orderkey % 2 = 0 THEN 'equity-only' END AS rule, CASE WHEN o_orderkey % 5 = 0 THEN 'true' END AS score_requested FROM orders"


@query(f"SELECT id, CASE WHEN id % 4 = 0 AND coalesce(override, 'false') <> 'true' THEN 'true' ELSE override END AS override, rule, CASE WHEN id % 4 = 0 AND coalesce(override, 'false') <> 'true' THEN 'true' ELSE score_requested END AS score_requested FROM ({_GATE_SQL})")
def scored_anyway(spark, d):
    gates = _gates(spark, d)
    return _flat(writes.scored_anyway(gates, gates.where("id % 4 = 0")))


@query(f"SELECT id, override, rule, CASE WHEN id % 4 = 0 THEN NULL ELSE score_requested END AS score_requested FROM ({_GATE_SQL})")
def request_acknowledged(spark, d):
    gates = _gates(spark, d)
    return _flat(writes.request_acknowledged(gates, gates.where("id % 4 = 0")))


_GATE_CASES = [("Java Developer", "Fine text that says enough."), ("Developer", "Equity-only."), ("Developer", "Fine."), ("Developer", None), ("QA Lead", "You must already live in the US.")]
_GATE_RULES = "CASE WHEN m = 3 THEN 'jd-quality-missing-body' WHEN m = 4 THEN 'already-us-resident' WHEN scored THEN NULL WHEN m = 0 THEN 'incompatible-stack-title' WHEN m = 1 THEN 'equity-only' END"


@query(f""", rows AS (SELECT p.id, doc_id % 5 AS m, CASE WHEN doc_id % 3 = 0 THEN 'v9' WHEN doc_id % 3 = 1 THEN 'v8' END AS gate_version, doc_id % 13 = 0 AS over, EXISTS (SELECT 1 FROM v_scores c WHERE c.posting_id = p.id) AS scored,
    EXISTS (SELECT 1 FROM v_status s WHERE s.posting_id = p.id AND s.status IN ({_PURSUED})) AS pursued FROM v_postings p)
  SELECT id, 'v9' AS version, {_GATE_RULES} AS rule FROM rows WHERE NOT over AND NOT pursued AND gate_version IS DISTINCT FROM 'v9'""", BOARD)
def gates_refreshed(spark, d):
    at = F.pmod("doc_id", F.lit(5)).cast("int")
    pick = lambda k: F.get(F.array(*[F.lit(c[k]) for c in _GATE_CASES]), at)
    rows = view(spark, d, "v_postings").select("id", pick(0).alias("title"), pick(1).alias("raw_jd"), F.expr("CASE doc_id % 3 WHEN 0 THEN 'v9' WHEN 1 THEN 'v8' END").alias("gate_version"), (F.col("doc_id") % 13 == 0).alias("gate_override"), F.lit(None).cast("string").alias("gate_rule"))
    return writes.gates_refreshed(rows, view(spark, d, "v_status"), view(spark, d, "v_scores"), gate.decided_rule("title", "raw_jd", "scored"), "v9")


@query("SELECT coalesce(o.field, n.field) AS field, CASE WHEN n.field IS NOT NULL THEN n.value ELSE o.value END AS value, CASE WHEN n.field IS NULL OR n.value = o.value THEN o.updated_at ELSE 9 END AS updated_at FROM (SELECT r_name AS field, 'v' || CAST(r_regionkey AS VARCHAR) AS value, 1 AS updated_at FROM region WHERE r_regionkey < 4) o FULL JOIN (SELECT r_name AS field, 'v' || CAST(r_regionkey // 2 * 2 AS VARCHAR) AS value FROM region WHERE r_regionkey <> 1) n ON n.field = o.field")
def profile_updated(spark, d):
    rows = table(spark, d, "region")
    fields = tuple(r[0] for r in rows.select("r_name").collect())
    changes = rows.where("r_regionkey <> 1").selectExpr("r_name AS field", "concat('v', CAST(r_regionkey div 2 * 2 AS STRING)) AS value")
    changes = changes.unionAll(rows.where("r_regionkey = 1").selectExpr("r_name AS field", "' ' AS value")).unionAll(rows.limit(1).selectExpr("'nonsense' AS field", "'x' AS value"))
    return writes.profile_updated(rows.where("r_regionkey < 4").selectExpr("r_name AS field", "concat('v', CAST(r_regionkey AS STRING)) AS value", "1 AS updated_at"), changes, fields, 9)


@query("SELECT o_orderpriority AS company, CASE WHEN o_orderkey % 5 > 0 THEN 'Dev' END AS role, o_orderkey AS recorded FROM orders WHERE o_orderkey % 3 > 0 OR o_orderkey % 2 = 0")
def applications_recorded(spark, d):
    rows = table(spark, d, "orders").selectExpr("o_orderkey AS recorded", "o_orderpriority AS company", "CASE WHEN o_orderkey % 5 > 0 THEN 'Dev' END AS role", "CAST(null AS STRING) AS outcome")
    fresh = rows.where("recorded % 2 = 1").withColumn("company", F.when(F.col("recorded") % 3 == 0, " ").otherwise(F.col("company")))
    return writes.applications_recorded(rows.where("recorded % 2 = 0"), fresh).select("company", "role", "recorded")


@query("SELECT o_orderkey AS posting_id, CASE WHEN o_orderkey % 4 = 1 THEN 'stale' WHEN o_orderkey % 3 = 0 THEN 'unchanged' ELSE 'stored' END AS outcome FROM orders")
def extractions_persisted(spark, d):
    n = table(spark, d, "orders").select(F.col("o_orderkey").alias("posting_id"))
    postings = n.selectExpr("posting_id AS id", "concat('jd', CAST(posting_id AS STRING)) AS raw_jd")
    results = n.selectExpr("posting_id", "concat(CASE WHEN posting_id % 4 = 1 THEN 'old' ELSE 'jd' END, CAST(posting_id AS STRING)) AS jd", "'i' AS identity", "'f' AS facts")
    return writes.extractions_persisted(postings, results.where("posting_id % 3 = 0 or posting_id % 7 = 0").withColumn("facts", F.when(F.col("posting_id") % 3 == 0, "f").otherwise("g")), results)


@query("SELECT o_orderkey AS posting_id FROM orders WHERE o_orderkey % 6 <> 0 AND o_orderkey % 5 <> 0")
def current_extractions(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("posting_id"), *[F.lit(c).alias(c) for c in writes.IDENTITY])
    wanted = rows.where("posting_id % 5 <> 0").withColumn("model", F.when(F.col("posting_id") % 6 == 0, "other").otherwise(F.col("model")))
    return writes.current_extractions(rows, wanted).select("posting_id")


@query("SELECT o_orderkey AS posting_id, CASE WHEN o_orderkey % 5 = 0 THEN 'stale' WHEN o_orderkey % 3 = 0 THEN 'unchanged' ELSE 'stored' END AS outcome, CASE WHEN o_orderkey % 5 = 0 THEN CASE WHEN o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN 70 ELSE 60 END END ELSE 70 END AS score, CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 THEN 1 END ELSE 9 END AS scored_at FROM orders")
def scores_persisted(spark, d):
    prints = [F.lit("x").alias(c) for c in writes.FINGERPRINTS]
    n = table(spark, d, "orders").select(F.col("o_orderkey").alias("posting_id"))
    results = n.select("posting_id", F.lit(70).alias("score"), F.lit("p").alias("payload"), *prints)
    stored = results.where("posting_id % 2 = 0 or posting_id % 3 = 0").withColumn("score", F.when(F.col("posting_id") % 3 == 0, 70).otherwise(60)).withColumn("scored_at", F.lit(1))
    current = n.select("posting_id", *prints).withColumn("history_sha256", F.when(F.col("posting_id") % 5 == 0, "y").otherwise("x"))
    return writes.scores_persisted(stored, results, current, 9)


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 > 0 THEN 'a' || CAST(s_suppkey % 2 AS VARCHAR) END AS apply_id FROM supplier")
def geo_owner_cleared(spark, d):
    rows = table(spark, d, "supplier").selectExpr("s_suppkey AS id", "concat('a', CAST(s_suppkey % 2 AS STRING)) AS apply_id")
    return writes.owner_cleared(rows, rows.where("id % 3 = 0"))


_ELIGIBLE = "SELECT o_orderkey AS posting_id, CASE WHEN o_orderkey % 5 = 0 THEN 'other' ELSE 'now' END AS profile_sha256, CASE o_orderkey % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'eligible' END AS eligibility, CASE WHEN o_orderkey % 4 < 2 THEN 'r' END AS reason FROM orders"
_JUDGED = "SELECT o_orderkey AS posting_id, CASE o_orderkey % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN 'blocked' ELSE 'eligible' END AS eligibility, CASE WHEN o_orderkey % 9 = 0 THEN 'q' ELSE 'r' END AS reason FROM orders"


@query(f"SELECT j.* FROM ({_ELIGIBLE}) e JOIN ({_JUDGED}) j ON j.posting_id = e.posting_id WHERE profile_sha256 = 'now' AND e.eligibility IS NULL")
def eligibility_backfill(spark, d):
    return writes.eligibility_backfilled(_of(spark, d, _ELIGIBLE, "orders"), _of(spark, d, _JUDGED, "orders"), "now")


@query(f"SELECT j.* FROM ({_ELIGIBLE}) e JOIN ({_JUDGED}) j ON j.posting_id = e.posting_id WHERE profile_sha256 = 'now' AND e.eligibility = 'unknown' AND (j.eligibility <> 'unknown' OR j.reason <> e.reason)")
def eligibility_recomputed(spark, d):
    return writes.eligibility_backfilled(_of(spark, d, _ELIGIBLE, "orders"), _of(spark, d, _JUDGED, "orders"), "now", recompute=True)


@query(f"SELECT eligibility, count(*) AS n FROM ({_JUDGED}) GROUP BY 1")
def eligibility_tallies(spark, d):
    return writes.eligibility_tallies(_of(spark, d, _JUDGED, "orders"))


@query(f"SELECT * FROM ({_JUDGED}) WHERE eligibility = 'blocked' ORDER BY posting_id LIMIT 20")
def eligibility_samples(spark, d):
    return writes.samples(_of(spark, d, _JUDGED, "orders").where("eligibility = 'blocked'"))


@query(" SELECT o.id, CASE WHEN o.checked_at % 3 <> 0 AND n.id IS NOT NULL THEN n.work_mode ELSE o.work_mode END AS work_mode, CASE WHEN o.checked_at % 3 <> 0 AND n.id IS NOT NULL THEN n.work_mode_source ELSE o.work_mode_source END AS work_mode_source FROM (SELECT id, checked_at, work_mode, CASE WHEN checked_at % 3 = 0 THEN 'moved' ELSE work_mode_source END AS work_mode_source FROM v_old) o LEFT JOIN v_new n ON n.id = o.id", SPLIT)
def backfill_applied(spark, d):
    columns = ("work_mode", "work_mode_source")
    old, new = view(spark, d, "v_old"), view(spark, d, "v_new")
    plan = writes.planned(old.select("id", *columns), new.select("id", *columns), columns)
    now = old.select("id", "work_mode", F.when(F.col("checked_at") % 3 == 0, "moved").otherwise(F.col("work_mode_source")).alias("work_mode_source"))
    return writes.plan_applied(now, plan, columns)


@query("SELECT o_orderkey AS id, 'u' AS url, CASE WHEN o_orderkey % 5 = 0 THEN repeat('x', 40) WHEN o_orderkey % 3 = 0 OR o_orderkey % 4 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'short' END ELSE 'fetched' END AS raw_jd FROM orders")
def descriptions_filled(spark, d):
    rows = table(spark, d, "orders").selectExpr("o_orderkey AS id", "'u' AS url", "CASE WHEN o_orderkey % 5 = 0 THEN repeat('x', 40) WHEN o_orderkey % 2 = 0 THEN 'short' END AS raw_jd")
    return writes.descriptions_filled(rows, rows.where("id % 4 <> 0").selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'v' ELSE 'u' END AS url", "'fetched' AS description"), 20)


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'b' ELSE 'a' END AS alive, 'k' AS kept, CASE WHEN o_orderkey % 3 = 0 THEN 'c' END AS checked FROM orders")
def liveness_written(spark, d):
    n = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    m = lambda **kv: F.create_map(*[F.lit(x) for p in kv.items() for x in p])
    seen = F.when(F.col("id") % 3 == 0, m(kept="k", alive="a")).otherwise(m(alive="older", kept="k"))
    out = writes.liveness_updated(n.select("id", m(alive="a", kept="k").alias("liveness")), n.select("id", seen.alias("seen"), m(alive="b", checked="c").alias("fresh")))
    return out.select("id", *[F.element_at("liveness", F.lit(k)).alias(k) for k in ("alive", "kept", "checked")])


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 1 THEN 100 ELSE 500 END AS until, o_orderkey % 9 + 1 AS attempts, CASE WHEN o_orderkey % 3 = 1 THEN 100 + least(3600, 60 * (1 << CAST(least(o_orderkey % 9, 6) AS INT))) END AS next_attempt_at FROM orders WHERE o_orderkey % 3 > 0")
def leases_settled(spark, d):
    rows = table(spark, d, "orders").selectExpr("o_orderkey AS id", "500 AS until", "o_orderkey % 9 + 1 AS attempts", "CAST(null AS BIGINT) AS next_attempt_at")
    return writes.leases_settled(rows, rows.where("id % 3 < 2").selectExpr("id", "id % 3 = 0 AS done"), 100)


@query("""SELECT 'p' || CAST(o_orderkey AS VARCHAR) AS id, 'u' AS url, 'T' AS title, 'Co' AS company, CASE o_orderkey % 4 WHEN 0 THEN 'Berlin (Hybrid)' WHEN 1 THEN 'Remote and more' WHEN 2 THEN NULL ELSE 'Haifa' END AS location,
  CASE o_orderkey % 4 WHEN 1 THEN true WHEN 3 THEN CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END WHEN 2 THEN CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END ELSE CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END END AS remote,
  CASE WHEN o_orderkey % 5 > 0 THEN 'Senior' END AS seniority, CASE WHEN o_orderkey % 2 = 0 THEN ['Go', 'SQL'] ELSE CAST([] AS VARCHAR[]) END AS stack FROM orders WHERE o_orderkey % 11 > 0""".replace("WHEN 1 THEN true WHEN 3", "WHEN 1 THEN CASE o_orderkey % 3 WHEN 1 THEN false ELSE true END WHEN 3"))
def stored_values(spark, d):
    n = F.col("o_orderkey")
    text = lambda v: F.lit(v).cast("string")
    rows = table(spark, d, "orders").select(
        F.concat(F.lit(" p"), n.cast("string")).alias("id"), text("u ").alias("url"), F.when(n % 11 == 0, " ").otherwise("T").alias("title"), text("Co").alias("company"),
        F.when(n % 4 == 0, "Berlin (Hybrid)").when(n % 4 == 1, "Remote and more").when(n % 4 == 2, " ").otherwise(" Haifa").alias("location"), F.when(n % 3 == 0, True).when(n % 3 == 1, False).alias("remote"), text(None).alias("work_mode"),
        F.when(n % 5 == 0, "N/A").otherwise("Senior").alias("seniority"), F.when(n % 2 == 0, F.array(*map(F.lit, (" Go", "SQL", "Go")))).otherwise(F.array(F.lit("Go"), F.lit("unknown"))).alias("stack"), text(None).alias("salary"), text(None).alias("apply_url"),
        F.lit(None).cast("long").alias("posted_at"), F.lit(None).cast("long").alias("last_published_at"), text(None).alias("jd_text"),
    )
    return writes.stored_values(rows, 19000).select("id", "url", "title", "company", "location", "remote", "seniority", "stack")


# ---- reports and plans


@query("SELECT p_brand AS company, p_partkey AS id, CASE WHEN p_brand LIKE '%1' THEN 'avoid' END AS verdict, CASE WHEN p_brand LIKE '%1' THEN 'because' END AS reason FROM part")
def verdict_overlay(spark, d):
    rows = table(spark, d, "part").selectExpr("p_brand AS company", "p_partkey AS id")
    given = rows.select("company").distinct().selectExpr("concat(' ', upper(company)) AS company", "CASE WHEN company LIKE '%1' THEN 'avoid' WHEN company LIKE '%2' THEN 'nonsense' ELSE 'avoid' END AS verdict", "CASE WHEN company LIKE '%3' OR company NOT LIKE '%1' THEN ' ' ELSE ' because' END AS reason")
    return writes.verdicts_overlaid(rows, given, ("avoid", "prefer"))


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 = 0 ORDER BY c_custkey % 37, c_custkey LIMIT 40")
def fetch_budget(spark, d):
    rows = table(spark, d, "customer").selectExpr("c_custkey AS id", "CASE WHEN c_custkey % 3 = 0 THEN 'linkedin' ELSE 'lever' END AS source", "CASE WHEN c_custkey % 2 = 0 THEN 'short' ELSE repeat('x', 300) END AS jd", "c_custkey % 37 AS at")
    return writes.budgeted(rows, "linkedin", 200, 40)


@query("SELECT c_custkey AS id, c_custkey % 7 - 2 AS score, CASE WHEN c_custkey % 4 = 0 OR c_custkey % 50 > 30 THEN 'unavailable' WHEN c_custkey % 4 = 1 THEN 'invalid' ELSE 'ok' END AS state FROM customer WHERE c_custkey % 7 > 2")
def annotations_in_time(spark, d):
    rows = table(spark, d, "customer").selectExpr("c_custkey AS id", "c_custkey % 7 - 2 AS score")
    return writes.annotated_in_time(rows, rows.where("id % 4 > 0").selectExpr("id", "CASE WHEN id % 4 = 1 THEN 'invalid' ELSE 'ok' END AS state", "id % 50 AS at"), 30)


@query("WITH b AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY c_custkey % 101 DESC, c_custkey) AS rank_before FROM customer QUALIFY rank_before <= 20), a AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY c_custkey * 7 % 101 DESC, c_custkey) AS rank_after FROM customer QUALIFY rank_after <= 20) SELECT coalesce(a.id, b.id) AS id, rank_before, rank_after FROM a FULL JOIN b ON a.id = b.id")
def rescore_report(spark, d):
    rows = table(spark, d, "customer")
    return writes.rescore_report(rows.selectExpr("c_custkey AS id", "c_custkey % 101 AS score"), rows.selectExpr("c_custkey AS id", "c_custkey * 7 % 101 AS score"))


@query("SELECT l_returnflag AS source, CAST(l_partkey % 40 AS VARCHAR) AS key, min('Co ' || CAST(l_suppkey % 9 AS VARCHAR)) AS company, list(DISTINCT l_linestatus || CAST(l_linenumber AS VARCHAR) ORDER BY l_linestatus || CAST(l_linenumber AS VARCHAR)) AS provenance FROM lineitem GROUP BY 1, 2 ORDER BY len(provenance) DESC, 1, 2 LIMIT 50")
def imported_candidates(spark, d):
    rows = table(spark, d, "lineitem").selectExpr("l_returnflag AS source", "CAST(l_partkey % 40 AS STRING) AS key", "concat('Co ', CAST(l_suppkey % 9 AS STRING)) AS company", "concat(l_linestatus, CAST(l_linenumber AS STRING)) AS provenance")
    return writes.imported_candidates(rows, 50)


@query("SELECT c_custkey AS name FROM customer WHERE NOT (c_custkey % 3 = 0 AND c_custkey % 50 BETWEEN 11 AND 40)")
def misses_cooled(spark, d):
    rows = table(spark, d, "customer").selectExpr("c_custkey AS name", "CASE WHEN c_custkey % 3 = 0 THEN 'miss' ELSE 'hit' END AS result", "c_custkey % 50 AS checked")
    return writes.cooled_down(rows.select("name"), rows, 40)


@query(" SELECT CASE WHEN g.lat IS NOT NULL THEN 'own' WHEN h.company IS NOT NULL AND posting_id % 2 = 0 THEN 'hq' ELSE 'unresolved' END AS state, count(*) AS n FROM v_geo g LEFT JOIN v_hq h ON h.company = g.company GROUP BY 1", ("v_geo", "v_hq"))
def geocode_plan(spark, d):
    rows = view(spark, d, "v_geo").withColumnRenamed("posting_id", "id")
    return writes.geocode_plan(rows.select("id", "company", (F.col("id") % 2 == 0).alias("eligible")), rows.where("lat is not null"), view(spark, d, "v_hq"))


@query(" SELECT posting_id AS id FROM v_geo WHERE posting_id % 5 <> 0", ("v_geo",))
def plan_still_true(spark, d):
    rows = view(spark, d, "v_geo").selectExpr("posting_id AS id", "company", "location", "remote")
    return writes.plan_still_true(rows, rows.withColumn("remote", F.when(F.col("id") % 5 == 0, ~F.col("remote")).otherwise(F.col("remote")))).select("id")


@query("SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN a IS NULL OR b IS NULL THEN 'unavailable' WHEN a > b THEN 'agreement' WHEN a = b THEN 'tie' ELSE 'disagreement' END AS outcome FROM (SELECT CASE WHEN o_custkey % 7 > 0 THEN o_custkey % 10 END AS a, CASE WHEN (o_custkey + 1) % 7 > 0 THEN (o_custkey * 3 + 1) % 10 END AS b FROM orders)) GROUP BY 1")
def pair_agreement(spark, d):
    o = table(spark, d, "orders")
    cases = o.selectExpr("concat('a', CAST(o_orderkey AS STRING)) AS id", "CASE WHEN o_custkey % 7 > 0 THEN o_custkey % 10 END AS score").unionAll(o.selectExpr("concat('b', CAST(o_orderkey AS STRING))", "CASE WHEN (o_custkey + 1) % 7 > 0 THEN (o_custkey * 3 + 1) % 10 END"))
    return writes.pair_agreement(cases, o.selectExpr("concat('a', CAST(o_orderkey AS STRING)) AS better", "concat('b', CAST(o_orderkey AS STRING)) AS worse"))


@query("""SELECT doc_id, sha256('{"a":"x' || CAST(doc_id AS VARCHAR) || '","b":' || CASE WHEN doc_id % 3 = 0 THEN 'null' ELSE '"é\\"' || chr(92) || chr(92) || '"' END || ',"c":"t"}') AS digest FROM documents""".replace('\\"', chr(92) + '"'))
def canonical_digests(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.concat(F.lit("x"), F.col("doc_id").cast("string")).alias("x"), F.when(F.col("doc_id") % 3 != 0, 'é"\\').alias("y"))
    return rows.select("doc_id", texts.canonical_json_sha256(b="y", a="x", c=F.lit("t")).alias("digest"))


@query("SELECT vec_id, CAST(round(list_sum(list_transform(v, lambda x: x * x)) * 1000) AS BIGINT) AS length FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE))))) AS v FROM embeddings)")
def normalised_vectors(spark, d):
    v = texts.l2_normalised("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x) * 1000).cast("long").alias("length"))


@query("SELECT count(*) AS checked, count(*) FILTER (event_id % 5 > 0 AND event_type = 'error') AS closed, count(*) FILTER (event_id % 5 > 0 AND event_type = 'view') AS alive, count(*) FILTER (event_id % 5 = 0 OR event_type NOT IN ('error', 'view')) AS unknown, count(*) FILTER (event_id % 7 = 0) AS unsupported, sum(event_id % 2) AS alerts FROM events")
def run_receipt(spark, d):
    rows = table(spark, d, "events").selectExpr("CASE event_type WHEN 'error' THEN false WHEN 'view' THEN true END AS alive", "event_id % 5 > 0 AS written", "event_id % 7 > 0 AS supported", "event_id % 2 AS alerts")
    return liveness.run_receipt(rows)


@query()
def availability_fold(spark, d):
    rows = view(spark, d, "v_observations").selectExpr("key", "at", "seen", "CASE WHEN seen = 'unknown' THEN concat('r', CAST(at % 3 AS STRING)) END AS reason", "CASE WHEN at % 11 = 0 THEN 404 ELSE 200 END AS page_status", "'odd' AS page_reason")
    return liveness.reliability(rows)


@query("""SELECT c_custkey AS "at", 'lever' AS source, CASE WHEN c_custkey % 9 = 0 OR c_custkey % 2 = 1 AND (c_custkey - 1) % 9 <> 0 THEN 'invalid' WHEN c_custkey % 7 = 0 THEN 'disabled' WHEN c_custkey % 100 >= 46 THEN 'stale' ELSE 'valid' END AS state,
  CASE WHEN c_custkey % 9 = 0 THEN 'company must be a non-empty string' WHEN c_custkey % 2 = 1 AND (c_custkey - 1) % 9 <> 0 THEN 'duplicate tenant identifiers' WHEN c_custkey % 7 = 0 THEN 'disabled by registry' WHEN c_custkey % 100 >= 46 THEN 'last verified ' || (c_custkey % 100) || ' days ago' END AS reason
  FROM customer WHERE c_custkey > 1""")
def registry_report(spark, d):
    n = F.col("c_custkey")
    name = F.concat(F.lit("t"), (n / 2).cast("long").cast("string"))
    day = F.date_format(F.date_sub(F.lit("2024-06-01").cast("date"), (n % 100).cast("int")), "yyyy-MM-dd")
    entry = F.to_json(F.struct(
        F.lit("lever").alias("source"), F.create_map(F.lit("account"), name).alias("identifiers"), F.when(n % 9 == 0, " ").otherwise("Acme").alias("company"), F.concat(F.lit("https://jobs.lever.co/"), name).alias("careers_url"),
        F.array(F.struct(F.lit("k").alias("kind"), F.lit("r").alias("reference"))).alias("provenance"), day.alias("last_verified_at"), (n % 7 != 0).alias("enabled"),
    ))
    return registry.registry_report(table(spark, d, "customer").where("c_custkey > 1").select(n.alias("at"), entry.alias("entry")), "2024-06-01")


@query("SELECT c_custkey AS \"at\", CASE c_custkey % 4 WHEN 0 THEN 'Acme' WHEN 1 THEN 'unknown' ELSE 'Plain' END AS company, CASE WHEN c_custkey % 4 < 2 THEN 'https://a.b/' || c_custkey ELSE '' END AS url FROM customer WHERE c_custkey % 4 < 3")
def formula_links(spark, d):
    n = F.col("c_custkey")
    link = lambda name: F.concat(F.lit('=HYPERLINK("https://a.b/'), n.cast("string"), F.lit(f'","{name}")'))
    return registry.formula_links(table(spark, d, "customer").select(n.alias("at"), F.when(n % 4 == 0, link(" Acme ")).when(n % 4 == 1, link("")).when(n % 4 == 2, " Plain").otherwise(" ").alias("cell")))
