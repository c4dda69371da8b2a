"""Held-out accuracy on gold labels, which the classifier never sees; edge rows."""

import numpy as np

from postglean.llm import quality as Q


def test_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = Q.classify(docs).select("doc_id", "quality_keep", "quality_weak").collect()
    assert len(got) == docs.count()
    good = [r.quality_keep for r in got if labels.get(r.doc_id) == 1]
    bad = [r.quality_keep for r in got if labels.get(r.doc_id) == 0]
    assert sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.15


def test_em_finds_accuracies():
    rng = np.random.default_rng(2)
    k = len(Q.LABELLERS)
    truth = rng.random(20000) < 0.7
    right = np.linspace(0.7, 0.95, k)
    votes = np.where(rng.random((20000, k)) < 0.2, Q.NONE, np.where((rng.random((20000, k)) < right) == truth[:, None], Q.GOOD, Q.BAD))
    patterns, back, counts = np.unique(votes @ 3 ** np.arange(k - 1, -1, -1), return_inverse=True, return_counts=True)
    model = Q.LabelModel.fit(patterns, counts.astype(float))
    assert ((model.posterior(patterns)[back] > 0.5) == truth).mean() > 0.95
    assert abs(model.rates[-1, 1, Q.GOOD] - right[-1]) < 0.03 and abs(model.prior - 0.7) < 0.05


def test_edges(spark):
    schema = "doc_id long, text string, quality_keep string, at long"
    rows = [(1, None, "x", 1), (None, "", None, 2), (2, "word", "", 3), (2, "word", "", 3), (3, "x " * 50000, "", 4), (4, "\0\t\n é", "", None)]
    got = Q.classify(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 6 and {r["at"] for r in got} == {1, 2, 3, 4, None} and all(isinstance(r["quality_keep"], bool) for r in got)
    assert Q.classify(spark.createDataFrame([], schema)).count() == 0
