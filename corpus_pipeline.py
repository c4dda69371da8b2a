"""A training corpus from ``documents``: five stages, each over all that its predecessor kept.

Stages but the last return the columns of documents. Each stage's result is
written as Parquet and read again as the next one's input.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postglean.llm import jaccard_join, mixing, packing, quality, suffix_dedup
from postglean.llm.common import clear_scratch, scratch_tables, shared_dir, written

#: Near-duplicate stages take five words and a similarity of 0.8.
NEAR_WORDS, NEAR_LEAST = 5, 80
#: Scratch tables of the stage that ran last.
_left: list[str] = []


def _stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """Deletes the scratch tables of the stage before: its result has been stored by then."""

    @functools.wraps(work)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        clear_scratch(spark, _left)
        before = set(scratch_tables())
        out = work(spark, docs, sf_dir)
        _left[:] = [x for x in scratch_tables() if x not in before]
        return out

    return stage


def _whole(docs: DataFrame) -> Column:
    """All columns of a document as one, so that none can clash with those of a stage."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")


def _numbered(docs: DataFrame, *more: str) -> DataFrame:
    """Documents as (row, whole, ``more``), stored, so that numbers are the same at each reading."""
    return written(docs.select(F.monotonically_increasing_id().alias("row"), _whole(docs), *more), "numbered")


@_stage
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject.

    Null and empty texts are judged as empty ones, equal texts and repeated
    rows alike, very long texts whole. Columns of any name pass unchanged; an
    empty table gives no rows.
    """
    judged = quality.classify(docs.select("text", _whole(docs)))
    return judged.where("quality_keep").select("whole.*")


@_stage
def one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the least id.

    Documents without words, null and empty texts among them, stay. Of rows of
    the same least id, and of repeated rows, one stays; if no row of the group
    has an id, any one. Very long texts are compared whole. Columns of any name
    pass unchanged; an empty table gives no rows.
    """
    rows = _numbered(docs)
    found = jaccard_join.near_duplicates(rows.select("row", "whole.doc_id", "whole.text"), words=NEAR_WORDS, least=NEAR_LEAST, row="row")
    return rows.join(found.where("first").select("row"), "row", "left_semi").select("whole.*")


@_stage
def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the long strings that the corpus holds more than once; a text that is all such strings goes.

    Where a removed run ends within a character, the character's rest goes too.
    n_chars is counted anew; null and empty texts stay as they are. Rows that
    repeat a longer text all go. Very long texts are read whole. Other columns
    of any name pass unchanged; an empty table gives no rows.
    """
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("whole")
    out = suffix_dedup.remove_repeats(docs.select("text", rest, F.col("text").isNull().alias("no_text")), carry=("whole", "no_text"))
    out = out.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_bytes")))
    text = F.when(~F.col("no_text"), F.col("kept_text"))
    made = {"text": text.alias("text")}
    if "n_chars" in docs.columns:
        n = F.when(F.col("n_removed") > 0, F.length(text)).otherwise(F.col("whole.n_chars"))
        made["n_chars"] = n.cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return out.select(*[made.get(c, F.col(f"whole.`{c}`").alias(c)) for c in docs.columns])


@_stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Texts that are null or have no words are not taken; a null source is a
    source. Equal rows are interchangeable, and any number of them may be
    taken. Columns of any name pass unchanged; an empty table gives no rows.
    """
    rows = _numbered(docs)
    copies = mixing.mix_sources(rows.select("row", "whole.doc_id", "whole.text", "whole.source"), carry="row").where("copies > 0").select("row", "copies")
    return rows.join(copies, "row").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("whole.*")


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 ids, as op6 packs them: null and empty texts are their end id, repeated rows are packed each, long texts are cut."""
    return packing.pack(docs)


STAGES = [("quality", keep_good), ("near_duplicates", one_of_near), ("repeats", without_repeats), ("mix", mixed), ("pack", packed)]

#: Votes, edit-tolerant joins, suffix sorting, random rounding and packing by subset sums are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
