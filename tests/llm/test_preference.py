"""Preference pairs against the SQL, on real rows and on edge rows."""

import duckdb
import pandas as pd
import pytest

from postglean.llm import preference as P

SCHEMA = "conv_id long, turn long, role string, text string, prompt string"
EDGES = [
    (1, 0, "user", "hi", "x"), (1, 1, "assistant", "one", None), (0, 0, "user", "hi", ""), (0, 1, "assistant", "two é🙂", ""), (0, 2, "user", None, ""),
    (2, 0, None, "alone", ""), (2, 1, "assistant", None, ""), (None, 0, "user", "lost", ""), (None, 1, "assistant", "lost too", ""), (5, 0, "assistant", "same", ""), (4, 0, "assistant", "same", ""),
    (7, 3, "assistant", "t", ""), (7, 3, "assistant", "t", ""), (6, 1, "user", "q" * 40000, ""), (8, None, "system", "", ""), (8, 1, "assistant", "end", ""),
]


@pytest.mark.parametrize("which", ["edges", "rows", "none"])
def test_against_sql(spark, which):
    if which == "rows":
        conversations = pd.read_parquet("/root/testdata/sf0.01/conversations.parquet")
        df = spark.createDataFrame(conversations)
    else:
        rows = EDGES if which == "edges" else []
        conversations = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text", "prompt"]).astype({"conv_id": "Int64", "turn": "Int64", "role": "string", "text": "string"})
        df = spark.createDataFrame(rows, SCHEMA)
    names = ["conv_id", "n_prompt_turns", "prompt", "chosen", "chosen_mask", "rejected", "rejected_mask"]
    want = sorted(map(str, duckdb.sql(f"SELECT {', '.join(names)} FROM ({P.SQL})").fetchall()))
    got = P.format_conversations(df).select(names).collect()
    assert sorted(str(tuple(r)) for r in got) == want
    for r in got:
        for text, mask in ((r.chosen, r.chosen_mask), (r.rejected, r.rejected_mask)):
            assert all(text[int(a) : int(b)].endswith(P.CLOSE) for a, b in (m.split(":") for m in mask.split(",") if m))
