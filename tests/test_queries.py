"""Each registered query against its oracle on the small tables; plans where they matter."""

import duckdb
import pytest

from postglean.plans.registry import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_oracle(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    want = duck.sql(ORACLES[name])
    assert columns == sorted(want.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    rows = duck.sql(f"SELECT {quoted} FROM ({ORACLES[name]})").fetchall()
    assert sorted(str(tuple(r)) for r in df.select(columns).collect()) == sorted(str(tuple(r)) for r in rows)


def test_plans(spark):
    plan = QUERIES["board_fit_topk"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "raw_jd" not in plan and "Python" not in plan and "ReadSchema: struct<doc_id:bigint" in plan
    assert "CartesianProduct" not in QUERIES["dedupe_cross_source"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["rotating_recheck", "facts_by_alias", "search_expansion", "ambiguous_employers", "title_scope_subset", "scoring_candidates", "registry_merge"])
def test_no_products_and_no_windows_over_all(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert name == "registry_merge" or "Window" not in plan


def _optimized(spark, name: str) -> str:
    return QUERIES[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()


def test_texts_without_a_match_stay_in_the_jvm(spark):
    """What Python is given is null unless the text holds something that the rule looks at; deadlines never leave the JVM."""
    assert "CASE WHEN RLIKE" in _optimized(spark, "years_admission")
    plan = _optimized(spark, "deadlines")
    assert "applications? close" in plan.lower() and "Python" not in plan and "ArrowEval" not in plan
