"""Facts and annotations: each rule broken once."""

import copy
import json
import random

import pytest
from pyspark.sql import functions as F

from postglean.functions import descriptions
from postglean.functions import validators as v

REMOTE = [
    ("Work remotely from home", True), ("This is a remote role", True), ("no longer remote", False), ("Remote work is not available", False), ("We don't offer remote work", False), ("not only remote", True), ("on-site in Haifa", False),
    ("Our team works mostly remote", None), ("A remote company", None), ("Tea", None), ("", None), (None, None), ("non-remote", False), ("cannot be done remotely", False), ("Remote is prohibited", False),
]


def test_remote(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(REMOTE)], "id int, t string")
    assert {r.id: r.v for r in df.select("id", v.said_remote("t").alias("v")).collect()} == {k: want for k, (_, want) in enumerate(REMOTE)}


FACTS = [  # quote, description, (value, quote)
    ("remote role", "This is a remote role. Join.", (True, "remote role")), ("remote", "A remote role. Not remote at all.", (None, None)), ("missing", "A remote role.", (None, "missing")), (None, "A remote role.", (None, None)),
    ("remote", "Our team is remote.", (None, None)), ("remote role.", "No remote role. Remote role.", (None, None)), ("A remote role.", "A remote role. Not remote.", (True, "A remote role.")), (" ", "a b", (None, " ")),
    ("remote", "Five days a week in our office. remote", (None, None)), ("on-site", "on-site. Five days a week in our office.", (False, "on-site")), ("remote", None, (None, "remote")),
]


def test_remote_facts(spark):
    df = spark.createDataFrame([(k, q, d) for k, (q, d, _) in enumerate(FACTS)], "id int, q string, d string")
    assert {r.id: tuple(r.v) for r in df.select("id", v.remote_fact("q", "d").alias("v")).collect()} == {k: want for k, (*_, want) in enumerate(FACTS)}


TEXT = "A remote role in Haifa. We use Go and React. Senior people. Our offices are in Berlin."
GOOD = {"location": ("Haifa", "in Haifa"), "remote": (True, "remote role"), "seniority": ("Senior", "Senior people"), "stack": [("Go", "use Go"), ("React", "React")]}
BROKEN = [
    ({}, None), ({"location": ("Jaffa", "in Haifa")}, ("evidence_quote", "location")), ({"location": (None, "in Haifa")}, ("evidence_quote", "location")), ({"location": ("Haifa", "Haifa, IL")}, ("evidence_quote", "location")),
    ({"remote": (True, "gone")}, ("evidence_quote", "remote")), ({"remote": (None, "remote")}, ("evidence_quote", "remote")), ({"seniority": ("Junior", "Senior people")}, ("evidence_quote", "seniority")),
    ({"location": ("Berlin", "Berlin")}, ("location_context", "location")), ({"remote": (False, "remote role")}, ("remote_consistency", "remote")), ({"stack": [("Go", "use Go"), (" go", "use go")]}, ("evidence_quote", "stack")),
    ({"stack": [("Go", "use Go"), ("GO", "use Go")]}, ("stack_uniqueness", "stack")), ({"stack": [("Rust", "use Go")]}, ("evidence_quote", "stack")), ({"location": (None, None), "remote": (None, None), "seniority": (None, None), "stack": []}, None),
]


@pytest.mark.parametrize("title", ["Developer", None])
def test_facts(spark, title):
    df = spark.createDataFrame([(k, GOOD | change, TEXT, title) for k, (change, _) in enumerate(BROKEN)], f"id int, f {v.FACTS}, d string, t string")
    got = {r.id: tuple(r.e) if r.e else None for r in df.select("id", v.facts_error("f", "d", "t").alias("e")).collect()}
    assert got == {k: want for k, (_, want) in enumerate(BROKEN)}


def test_grades_of_the_title_are_quoted_there(spark):
    df = spark.createDataFrame([(GOOD, TEXT, "Junior Developer"), (GOOD | {"seniority": ("Junior", "Junior Developer")}, TEXT, "Junior Developer")], f"f {v.FACTS}, d string, t string")
    assert [r.e and tuple(r.e) for r in df.select(v.facts_error("f", "d", "t").alias("e")).collect()] == [("evidence_quote", "seniority"), None]


def _annotation():
    reasons = [{"factor": f, "basis": b, "assessment": "positive", "evidence_ids": ["p1"] + ["e1"] * (b == "comparison"), "detail": f"About {f}"} for f, b in v.BASES.items()]
    return {"employer_type": "direct", "seniority_real": None, "fit_score": 85, "fit_tier": "strong", "recommendation": "apply", "reasons": reasons, "fit_line": "Strong", "fit_line_evidence_ids": ["p1", "e1"]}


def _reason(k, **change):
    return lambda a: a["reasons"][k].update(change)


def _set(**change):
    return lambda a: a.update(change)


RULES = [
    (lambda a: None, None), (_set(more=1), "fields"), (lambda a: a.pop("fit_line"), "fields"), (_set(employer_type="bank"), "employer_type"), (_set(seniority_real="yes"), "seniority_real"), (_set(seniority_real=True), None),
    (_set(fit_score=85.5), "fit_score"), (_set(fit_score="85"), "fit_score"), (_set(fit_score=101), "fit_score"), (_set(fit_tier="good"), "fit_tier"), (_set(recommendation="maybe"), "recommendation"), (_set(recommendation="skip"), "expected_recommendation"),
    (lambda a: a["reasons"].pop(), "reasons"), (_reason(0, extra=1), "reason_fields"), (_reason(1, factor="product_role_match"), "reason_factor"), (_reason(0, basis="posting"), "reason_basis"), (_reason(0, assessment="fine"), "reason_assessment"),
    (_reason(0, evidence_ids=["p1", "zz"]), "reason_evidence"), (_reason(0, evidence_ids=["e1"]), "reason_evidence"), (_reason(0, evidence_ids=[]), "reason_evidence"), (_reason(3, evidence_ids=["p1", "e1"]), "posting_evidence_only"),
    (_reason(0, evidence_ids=["p1"]), "comparison_evidence"), (_reason(0, detail=" "), "reason_detail"), (_reason(0, evidence_ids=["p1", "profile:open-to"]), "withheld_evidence"),
    (_reason(4, evidence_ids=["p1", "profile:open-to"], assessment="unknown", detail=v.ABSTAINED), None), (_reason(3, detail="The candidate is fine"), "posting_speaks_of_candidate"), (_reason(0, detail="a World Champion"), "forbidden_claim"),
    (_reason(0, detail="ran the bank"), "forbidden_claim"), (_reason(0, detail="Uses MCP"), "unproven_mcp"), (_reason(0, detail="Uses MCP", evidence_ids=["p1", "brainlayer"]), None), (_set(fit_line_evidence_ids=["p1"]), "line_evidence"),
    (_set(fit_line_evidence_ids=["p1", "p1"]), "line_evidence"), (_set(fit_line_evidence_ids=["e1", "brainlayer"]), "line_evidence"), (_set(fit_line_evidence_ids=["p1", "profile:open-to"]), "withheld_evidence"), (_set(fit_line=" "), "fit_line"),
    (_set(fit_line="world champion"), "forbidden_claim"), (_set(fit_line="MCP"), "unproven_mcp"), (_set(fit_score=10, fit_tier="weak"), "weak_line"), (_set(fit_score=10, fit_tier="weak", fit_line="Weak fit — no"), None),
]


def test_annotations(spark):
    rows = []
    for k, (change, _) in enumerate(RULES):
        a = copy.deepcopy(_annotation())
        change(a)
        rows.append((k, json.dumps(a), ["p1", "e1", "brainlayer", "profile:open-to"], "p1", "apply", ["World champion"], {"e1": ["ran the bank"]}))
    rows += [(900, "not json", ["p1"], "p1", None, [], {}), (901, None, ["p1"], "p1", None, [], {})]
    df = spark.createDataFrame(rows, "id int, a string, allowed array<string>, p string, x string, n array<string>, m map<string,array<string>>")
    got = {r.id: r.e for r in df.select("id", v.annotation_error("a", "allowed", "p", "x", "n", "m").alias("e")).collect()}
    assert got == {k: want for k, (_, want) in enumerate(RULES)} | {900: "fields", 901: "fields"}
    assert df.select(v.annotation_error("a", "allowed", "p").alias("e")).where(F.col("id") == 0).first().e is None


def test_attendance_is_looked_for_where_its_words_are(monkeypatch):
    """The same statements where every pattern reads every text."""
    random.seed(3)
    parts = (
        "3 days|five days|two day|a week|per week|weekly|in the office|at our office|office|from office|5/5 days|full-time|full time|fully in-person|in person|role|position|is|:|this|hybrid|Hybrid working|work model: hybrid|hybrıd role|HYBRİD|"
        "on-ſite|remote|fully remote|on-site|onsite|on site|/|, or|or|work|location: TLV|3 ימים|יומיים|בשבוע|במשרד|היברידית|עבודה|משרה|not|optional|initially|but|.|;|\n|tea"
    ).split("|")
    texts = [" ".join(random.choices(parts, k=random.randrange(2, 10))) for _ in range(20000)]
    told = [list(descriptions._statements(t)) for t in texts]
    assert sum(map(bool, told)) > 500 and descriptions._may_state("A remote role in Haifa. We meet in the office.") == (False, False, False)
    monkeypatch.setattr(descriptions, "_may_state", lambda text: (True, True, True))
    assert told == [list(descriptions._statements(t)) for t in texts]
