"""The pipeline stage by stage: columns, and what each decides."""

import re

import corpus_pipeline as C

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    at, kept = docs, {}
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, at, None)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        kept[name] = [tuple(r) for r in out.collect()]
        at = spark.createDataFrame(kept[name], docs.schema)
    ids = {name: [r[0] for r in rows] for name, rows in kept.items()}
    assert set(ids["quality"]) >= set(ids["near_duplicates"]) >= set(ids["repeats"]) >= set(ids["mix"])

    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}

    texts = {r[0]: shingles(r[1]) for r in kept["quality"]}
    near = lambda a, b: 100 * len(texts[a] & texts[b]) >= 80 * len(texts[a] | texts[b])
    stay = set(ids["near_duplicates"])
    assert not any(near(a, b) for a in stay for b in stay if a < b)
    todo = [*stay]
    reached = set(stay)
    while todo:
        a = todo.pop()
        more = [b for b in texts if b not in reached and near(a, b)]
        reached.update(more)
        todo += more
    assert reached == set(texts)
    seen = {}
    for doc_id, text, *_ in kept["near_duplicates"]:
        data = text.encode()
        for k in range(len(data) - 199):
            seen[data[k : k + 200]] = seen.get(data[k : k + 200], 0) + 1
    for doc_id, text, *_ in kept["repeats"]:
        data = text.encode()
        assert not any(seen.get(data[k : k + 200], 0) > 1 for k in range(len(data) - 199))
    assert all(ids["mix"].count(x) <= 2 for x in set(ids["mix"]))
    last = C.STAGES[-1][1](spark, at, None)
    assert {r.doc_id for r in last.collect()} == set(ids["mix"])


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in C.STAGES:
        assert stage(spark, docs, None).count() == 0
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0)], SCHEMA)
    for name, stage in C.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, None).collect(), SCHEMA)


def test_any_columns_pass(spark):
    """Columns named as those that stages make, odd names, very long texts, ties and repeated rows."""
    names = ["copies", "copy", "row", "whole", "mix_row", "near_row", "n_removed", "n_bytes", "n_spans", "kept_sha256", "kept_text", "text_null", "quality_keep", "quality_bytes", "bytes", "h", "a.b", "odd name", "the text is null"]
    schema = SCHEMA + "".join(f", `{c}` string" for c in names)
    said = "The river turns north here. People of the valley, {} of them, have kept boats since the first bridge fell, and {} still row across."
    rows = [(k, said.format(k * k, k + 7), "en", "s", 1, *(f"{c} {k}" for c in names)) for k in range(12)]
    rows += [rows[0], rows[1], (50, " ".join(f"word{k * k % 9973} of a long text, which goes on." for k in range(30000)), "en", None, 2, *names)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, None)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert all(r["copies"] == (f"copies {r.doc_id}" if r.doc_id < 50 else "copies") and r["a.b"].startswith("a.b") for r in got), name
        docs = spark.createDataFrame(got, schema)
    assert docs.count() and C.STAGES[-1][1](spark, docs, None).count()
