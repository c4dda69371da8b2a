"""Dated feeds of JSON lines, the report over them, and the embedding store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.texts import markdown_cell
from ..operators.ingest import posting_source
from ..operators.views import ranked_value

#: A feed row's fields in order, with what stands where a row has none.
FIELDS = {"id": None, "title": None, "company": None, "location": "", "url": None, "source": None, "source_tenant": "linkedin-guest", "posted_at": "", "jd_text": "", "score": "0"}


def feed_rows(rows: DataFrame) -> DataFrame:
    """Rows with the feed's fields in their order, defaults applied."""
    have = set(rows.columns)
    value = {c: F.coalesce(F.col(c).cast("string"), F.lit(v)) if c in have else F.lit(v).cast("string") for c, v in FIELDS.items()}
    value["source"] = posting_source() if "source" in have else F.lit("linkedin")
    return rows.select(*[value[c].alias(c) for c in FIELDS])


def append_feed(rows: DataFrame, path: str, day: str) -> None:
    """Appends rows to the day's partition."""
    feed_rows(rows).withColumn("feed_date", F.lit(day)).write.mode("append").partitionBy("feed_date").json(path)


def annotated(feed: DataFrame, annotations: DataFrame) -> DataFrame:
    """A day's rows with what was annotated since (id, luna_status, fit_score), best first."""
    rows = feed.drop("luna_status", "fit_score").join(annotations.select("id", "luna_status", "fit_score"), "id", "left")
    return rows.orderBy(ranked_value("score", "fit_score", "luna_status").desc(), F.lower("title"), "id")


def rewrite_annotated(feed_path: str, day: str, annotations: DataFrame, out_path: str) -> None:
    """Writes the day's annotated rows to ``out_path``, replacing that day alone. Rows that are read aren't those that are replaced."""
    spark = annotations.sparkSession
    rows = annotated(spark.read.json(f"{feed_path}/feed_date={day}"), annotations).withColumn("feed_date", F.lit(day))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("feed_date").json(out_path)


def summary_lines(rows: DataFrame, most: int = 10) -> DataFrame:
    """The report's table: the best open rows, one Markdown line each, in order."""
    rank = ranked_value("score", "fit_score", "luna_status")
    top = rows.where(~F.col("alive").eqNullSafe(F.lit(False))).orderBy(rank.desc(), F.lower("title"), "id").limit(most)
    cells = [rank.cast("string"), markdown_cell("title"), markdown_cell("company"), markdown_cell("location")]
    return top.select("id", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


STORE_KEY = ("posting_id", "sha256", "model", "revision")


def store_embeddings(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """The store with vectors that it hasn't, by posting, text, model and revision; what it has stays. Vectors that aren't finite are refused."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    new = fresh.where(finite).dropDuplicates(list(STORE_KEY)).join(stored.select(*STORE_KEY), list(STORE_KEY), "left_anti")
    return stored.unionByName(new.select(stored.columns))


def as_document(rows: DataFrame, name: str) -> DataFrame:
    """All rows as one JSON array, in order of id: for callers that want one document. What it is used for is bounded by a limit before."""
    each = F.sort_array(F.collect_list(F.struct("id", F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("j"))))
    return rows.agg(F.concat(F.lit("["), F.array_join(F.transform(each, lambda x: x["j"]), ","), F.lit("]")).alias(name))
