"""Rules that the small tables don't show."""

import random
import re
import shutil

import pandas as pd
import pytest

from postglean.functions import postings as fn
from postglean.operators import board, globe, ingest, liveness, merge, vacancy
from postglean.sources import boards, feeds
from postglean.streaming import availability
from pyspark.sql import functions as F


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_parameters_are_checked():
    with pytest.raises(ValueError):
        board.checked(sort="best")
    with pytest.raises(ValueError):
        board.checked(tab="all", fit="great")
    with pytest.raises(ValueError):
        ingest.expanded_searches(None, None, "1y")


def test_unicode_titles_tie_under_the_limit(spark):
    """Canonically equal titles are one in the order, so the newer posting comes first."""
    postings = spark.createDataFrame([("a", "Café", 1), ("b", "Café", 2)], "id string, title string, first_seen long")
    postings = postings.selectExpr("*", "'c' company", "'' stack", "'s' source", "null location", "true remote", "null work_mode", "null seniority", "first_seen posted", "false relevance_filtered", "'{}' liveness")
    empty = spark.createDataFrame([], "posting_id string, status string, seen boolean, score long, recommendation string, eligibility string")
    assert [r.id for r in board.board_postings(board.Board(postings, empty, empty), sort="seniority", most=1).collect()] == ["b"]


def test_alive_is_a_boolean_only(spark):
    df = spark.createDataFrame([('{"alive": false}',), ('{"alive": "false"}',), ('{"alive": null}',), ("{}",), (None,), ("junk",)], "liveness string")
    assert [r[0] for r in df.select(fn.is_active("liveness")).collect()] == [False, True, True, True, True, True]


def test_job_links(spark):
    df = spark.createDataFrame([(None, "https://apply.workable.com/acme/jobs/view/AB12.md?x=1"), ("", "https://a.b/c"), ("https://z.y", "https://a.b/c")], "apply string, url string")
    assert [r[0] for r in df.select(fn.job_link_url("apply", "url")).collect()] == ["https://apply.workable.com/acme/j/AB12/?x=1", "https://a.b/c", "https://z.y"]
    df = spark.createDataFrame([("http://u@h/",), ("ftp://h",), ("https://h:80/a b",), ("https://h:80/a",), ("https://h:x",), (None,)], "url string")
    assert [r[0] for r in df.select(fn.link_status("url")).collect()] == ["invalid_url", "invalid_url", "invalid_url", "available", "invalid_url", "no_link"]


def test_dedupe_by_the_letter(spark):
    """Against a fold over arrivals: a row that is dropped doesn't claim its identity, so its other title is kept."""
    given = [("1", "a", "Co", "Dev", 1), ("2", "a", "co!", "dev", 2), ("3", "b", "Co", "Dev", 3), ("3", "b", "Other", "Dev", 4), ("", "a", "X", "Y", 5), ("4", "b", "", "Dev", 6), ("5", "c", "", "Dev", 7), ("1", "a", "Co", "Dev", 8), ("4", "b", "", "Dev", 9)]
    random.seed(3)
    given += [(str(random.randrange(60)), random.choice("abc"), f"c{random.randrange(12)}", random.choice(["Dev", "Ops", ""]), k) for k in range(10, 400)]
    prior, keys = [("2", "a"), ("7", None)], [("c3|dev", "b"), ("c3|dev", "c"), ("c4|ops", "a")]
    for before, owned in (([], []), (prior, keys)):
        kept, owner, want = {(s or "linkedin", i) for i, s in before}, {}, []
        for k, s in owned:
            owner.setdefault(k, set()).add(s)
        for i, s, c, t, at in given:
            words = [re.sub("[^a-z0-9]+", " ", x.lower()).strip() for x in (c, t)]
            key = "|".join(words) if all(words) else None
            if i and (s, i) not in kept and (key is None or key not in owner or s in owner[key]):
                kept.add((s, i))
                want.append(at)
                if key:
                    owner.setdefault(key, set()).add(s)
        df = spark.createDataFrame(given, "id string, source string, company string, title string, arrival long")
        more = (spark.createDataFrame(before, "id string, source string"), spark.createDataFrame(owned, "key string, source string")) if before else ()
        assert sorted(r.arrival for r in ingest.dedupe_postings(df, *more).collect()) == want


def test_boards(spark):
    landed = spark.createDataFrame([("acme", '{"jobs": [{"id": 7, "title": "Dev", "content": "&lt;p&gt;Hi &amp;amp; bye &amp;copy; &amp;amp;eacute;&lt;/p&gt;", "location": {"name": "Haifa"}}, {"title": "no id"}]}')], "tenant string, body string")
    assert [(r.id, r.location, r.text) for r in boards.greenhouse_jobs(landed).collect()] == [("greenhouse:acme:7", "Haifa", "Hi & bye © é")]
    landed = spark.createDataFrame([("acme", '[{"id": "x", "text": "Dev", "descriptionPlain": "One.", "createdAt": 0, "lists": [{"text": "Need", "content": "<b>two</b>"}], "openingPlain": "", "additionalPlain": "More &amp; more.", "categories": {"location": "NY"}}]')], "tenant string, body string")
    assert [(r.id, r.location, r.text) for r in boards.lever_jobs(landed).collect()] == [("lever:acme:x", "NY", "One. Need two More & more.")]
    body = '{"jobs": [{"id": "1", "title": "A", "isListed": true, "location": "X", "secondaryLocations": [{"location": "Y"}, {"location": "X"}], "jobUrl": "https://jobs.ashbyhq.com/acme/1"}, {"id": "2", "isListed": true, "jobUrl": "https://evil/2"}]}'
    landed = spark.createDataFrame([("acme", body)], "tenant string, body string")
    assert [(r.id, r.location) for r in boards.ashby_jobs(landed).collect()] == [("ashby:acme:1", "X; Y")]
    landed = spark.createDataFrame([("acme", "| Title | D | L | a | b | P | T |\n|---|---|---|---|---|---|---|\n| Dev | R | Haifa | x | y | 2024-01-02 | [v](https://a/jobs/view/ABC1.md) |\n| short | row |")], "tenant string, body string")
    assert [(r.title, r.location, r.posted_at, r.token) for r in boards.markdown_jobs(landed).collect()] == [("Dev", "Haifa", "2024-01-02", "ABC1")]


def test_tolerant_lines(spark):
    lines = spark.createDataFrame([('{"a": 1}',), ("",), ("  ",), ("[1]",), ("{bad",), ('{"a": null}',)], "value string")
    good, bad = boards.tolerant_json_lines(lines, "a int")
    assert [r.a for r in good.collect()] == [1, None] and [r.value for r in bad.collect()] == ["[1]", "{bad"]


def test_seen_branches(spark):
    given = [("insert", None, None, "new", True), ("update", "new", False, "new", True), ("update", "seen", True, "seen", False), ("update", "applied", True, "applied", False), ("update", "new", False, "applied", False)]
    df = spark.createDataFrame(given, "op string, os string, oseen boolean, ns string, nseen boolean")
    got = df.select(merge.seen_after(*[F.col(c) for c in df.columns]).alias("r")).select("r.*").collect()
    assert [tuple(r) for r in got] == [("new", False, False), ("seen", True, False), ("new", False, False), ("applied", True, True), ("applied", True, False)]


def test_linkage_is_complete(spark):
    """An unknown place joins the stronger group that it agrees with in every member, and bridges nothing."""
    schema = "id string, company string, title string, place string, countries array<string>, region string, city string, requisitions array<string>, fingerprint string, role_keys array<string>, posted long, first_seen long"
    base = lambda i, place, city, **k: (i, k.get("company", "Ａcme  Co"), k.get("title", "Dev"), place, None, None, city, k.get("req"), k.get("fp"), None, None, 1)
    df = spark.createDataFrame([
        base("1", "haifa", "haifa"), base("2", "", None), base("3", "berlin", "berlin", company="acme co"), base("4", "berlin", "berlin", req=["R1"]), base("5", "haifa", "haifa", req=["R1"]),
        base("6", "x", "x", title="Other", fp="f"), base("7", "y", "y", title="Third", fp="f"), base("8", "haifa", "haifa", company=""), base("9", "haifa", "haifa", company=" "),
    ], schema)
    groups = {}
    for r in vacancy.vacancy_groups(df).collect():
        groups.setdefault(r.group_id, set()).add(r.id)
    assert sorted(map(sorted, groups.values())) == [["1"], ["2", "4", "5"], ["3"], ["6", "7"], ["8"], ["9"]]


def test_strikes_stream_equals_batch(spark, tmp_path):
    """Also where rows come late; far rows of another key push the watermark on, and what is out of time is dropped."""
    parts = [
        [(1, 1000, "present"), (1, 1030, "absent"), (2, 1005, "absent")], [(1, 1010, "absent"), (1, 1060, "absent"), (1, 1060, "absent"), (2, 1050, "absent")], [(1, 1070, "unknown"), (1, 1071, "unknown"), (1, 1080, "absent")],
        [(9, 9000, "present")], [(1, 1001, "unknown"), (9, 9001, "present")], [(9, 20000, "present")], [(9, 20001, "present")],
    ]
    schema = "key long, at long, seen string"
    folder = tmp_path / "in"
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"p{k}"))
    folder.mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    query = availability.strikes_stream(stream).writeStream.format("memory").queryName("struck").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    for k in range(len(parts)):
        file = next((tmp_path / f"p{k}").glob("*.parquet"))
        shutil.copy(file, folder / f"{k}.parquet")
        query.processAllAvailable()
    query.stop()
    want = liveness.strikes(spark.createDataFrame([r for part in parts for r in part if r != (1, 1001, "unknown")], schema)).where("key < 9")
    assert rows(spark.table("struck").where("key < 9")) == rows(want)


def test_reliability(spark):
    """Strikes, the page's word, back-off and alerts, by a table of what is expected."""
    given = [
        (0, "present", None, None, None), (60, "absent", None, None, None), (60, "absent", None, None, None), (90, "absent", None, None, None), (110, "absent", None, 200, "odd"), (120, "absent", None, 200, "odd"), (130, "absent", None, 200, "odd"),
        (140, "absent", None, 404, "x"), (1600, "absent", None, 404, "x"), (1700, "absent", None, None, None), (1800, "unknown", "slow", None, None), (1810, "unknown", "slow", None, None), (1820, "unknown", "board-unknown:x", None, None),
        (1830, "unknown", "board-unknown:x", None, None), (1900, "present", None, None, None),
    ]
    df = spark.createDataFrame([(7, *g) for g in given], "key long, at long, seen string, reason string, page_status int, page_reason string")
    got = [(r["at"], r.verdict, r.alive, r.misses, r.alerts) for r in liveness.reliability(df).orderBy("at").collect()]
    want = [
        (0, "alive", True, 0, 0), (60, "pending", True, 1, 0), (60, "duplicate-snapshot", True, 1, 0), (90, "pending", True, 1, 0), (110, "unknown", True, 2, 1), (120, "unknown", True, 2, 1), (130, "unknown", True, 2, 1), (140, "unknown", True, 2, 1),
        (1600, "gone", False, 2, 1), (1700, "gone", False, 2, 1), (1800, "unknown", False, 0, 2), (1810, "unknown", False, 0, 2), (1820, "unknown", False, 0, 3), (1830, "unknown", False, 0, 4), (1900, "alive", True, 0, 4),
    ]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_feed_files(spark, tmp_path):
    """A day's rows are appended, annotated and rewritten without touching other days."""
    rows_of = lambda *ids: spark.createDataFrame([(i, f"T{i}", "Co", f"u{i}", 5) for i in ids], "id string, title string, company string, url string, score int")
    path, out = str(tmp_path / "feed"), str(tmp_path / "out")
    feeds.append_feed(rows_of("1"), path, "2024-01-01")
    feeds.append_feed(rows_of("2", "3"), path, "2024-01-02")
    feeds.append_feed(rows_of("4"), path, "2024-01-02")
    feed = spark.read.json(path)
    assert {(r.id, str(r.feed_date), r.source, r.source_tenant, r.jd_text) for r in feed.collect()} == {(i, d, "linkedin", "linkedin-guest", "") for i, d in (("1", "2024-01-01"), ("2", "2024-01-02"), ("3", "2024-01-02"), ("4", "2024-01-02"))}
    assert {r.id for r in ingest.prior_identities(feed, "2024-01-02").collect()} == {"1"}
    notes = spark.createDataFrame([("3", "ok", 90)], "id string, luna_status string, fit_score int")
    feeds.rewrite_annotated(path, "2024-01-01", notes, out)
    feeds.rewrite_annotated(path, "2024-01-02", notes, out)
    feeds.rewrite_annotated(path, "2024-01-02", notes, out)
    assert sorted((r.id, r.fit_score) for r in spark.read.json(out).collect()) == [("1", None), ("2", None), ("3", 90), ("4", None)]


def test_screen_clusters_in_order(spark):
    """Each point joins the first cluster near it; anchors stay where they are."""
    pts = [(1, k, k, float(x), float(y)) for k, (x, y) in enumerate([(0, 0), (20, 0), (45, 0), (30, 30), (200, 0), (-5, -5)])]
    got = {r.id: r.cluster for r in globe.screen_clusters(spark.createDataFrame(pts, "view long, id long, at long, x double, y double")).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2 if ((45 - 30) ** 2 + 30**2) ** 0.5 < 32 else 3, 4: 4, 5: 0}


def test_linkage_against_the_letter(spark):
    """Components by shared evidence give what a pass over each whole company gives, on hundreds of rows."""
    random.seed(12)
    places = [("haifa", ["israel"], "haifa", "haifa"), ("berlin", ["germany"], None, "berlin"), ("", [], None, None), ("israel", ["israel"], None, None), ("austin, tx", ["us"], "tx", "austin")]
    rows = []
    for k in range(500):
        place, countries, region, city = random.choice(places)
        req = random.choice([None, [], [], ["R1"], ["R2"], ["R1", "R3"]])
        rows.append((f"{k:04d}", random.choice(["Co", "co ", "Other", "Third", ""]), random.choice(["Dev", "Ops", "QA", ""]), place, countries, region, city, req, random.choice([None, None, None, "f1", "f2"]), random.choice([None, [], ["k1"], ["k2", "k3"]]), k % 50, k))
    schema = "id string, company string, title string, place string, countries array<string>, region string, city string, requisitions array<string>, fingerprint string, role_keys array<string>, posted long, first_seen long"
    got = {r.id: r.group_id for r in vacancy.vacancy_groups(spark.createDataFrame(rows, schema)).collect()}
    names, want = schema.replace(" array<string>", "").split(", "), {}
    for company in {" ".join(r[1].split()).lower() for r in rows}:
        groups = []
        own = [dict(zip([n.split()[0] for n in names], r)) | {"title_key": r[2].lower()} for r in rows if " ".join(r[1].split()).lower() == company]
        own.sort(key=lambda r: (-(2 if r["requisitions"] else 1 if r["fingerprint"] else 0), r["id"]))
        for r in own:
            home = next((g for g in groups if all(vacancy._one_role(m, r) for m in g)), None) if company else None
            if home is None:
                groups.append(home := [])
            home.append(r)
        want |= {r["id"]: g[0]["id"] for g in groups for r in g}
    assert got == want
