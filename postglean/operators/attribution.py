"""Who hires: candidates from descriptions, against tables of intermediaries; one winner or none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.employers import employers_named
from .views import is_alias

VERSION = "17"


def employer_attribution(postings: DataFrame, publishers: DataFrame, intermediaries: DataFrame, boards: tuple[str, ...]) -> DataFrame:
    """(id, publisher, hiring_employer, employer_evidence, resolver_version, relationship, agency_evidence) of postings (id, company, source, description).

    Names with the role outweigh those of a company's description; if two
    different ones are left nobody wins. Names in ``publishers`` (name) or
    ``intermediaries`` (name) are agencies, by join. Without any name a board of
    the company's own (``boards``) tells who hires, unless something speaks of an
    intermediary.
    """
    key = lambda c: F.lower(F.btrim(c))
    agents = publishers.select(key("name").alias("k")).unionByName(intermediaries.select(key("name").alias("k"))).distinct()
    read = postings.select("id", "company", "source", employers_named("company", "description").alias("f"))
    names = read.select("id", F.explode("f.names").alias("n")).select("id", "n.*", key("n.name").alias("k"))
    judged = names.join(agents.withColumn("agent", F.lit(True)), "k", "left").withColumn("out", F.col("barred") | F.coalesce("agent", F.lit(False)))
    pick = lambda blurb: F.when(~F.col("out") & (F.col("blurb") == blurb), F.struct("k", "name", "evidence"))
    won = judged.groupBy("id").agg(
        F.count_distinct(pick(False)["k"]).alias("roles"), F.count_distinct(pick(True)["k"]).alias("blurbs"), F.max(pick(False)).alias("role"), F.max(pick(True)).alias("blurb_"),
        F.bool_or("out").alias("agents"), F.bool_or(F.col("out") & ~F.col("blurb")).alias("agents_in_role"),
    )
    listed = publishers.select(key("name").alias("pk"), F.lit(True).alias("listed")).distinct()
    rows = read.join(won, "id", "left").join(listed, key(F.col("company")) == F.col("pk"), "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    many = lambda c: F.coalesce(F.col(c), F.lit(0))
    by_role = (many("roles") > 0) | yes("agents_in_role") | F.col("f.agency_in_role") | F.col("f.client") | F.col("f.vague")
    n = F.when(by_role, many("roles")).otherwise(many("blurbs"))
    best = F.when(n == 1, F.when(by_role, F.col("role")).otherwise(F.col("blurb_")))
    quiet = ~(yes("listed") | F.col("f.agency").isNotNull() | yes("agents") | F.col("f.describes_publisher") | F.col("f.client") | F.col("f.vague"))
    own = (n == 0) & quiet & F.col("source").isin(*boards)
    employer = F.when(own, F.col("company")).otherwise(best["name"])
    evidence = F.when(own, F.concat(F.lit("source:"), "source", F.lit("; company:"), "company")).otherwise(best["evidence"])
    told = rows.select("id", F.col("company").alias("publisher"), employer.alias("hiring_employer"), evidence.alias("employer_evidence"), F.lit(VERSION).alias("resolver_version"), F.col("f.agency").alias("agency_evidence"))
    same = F.lower("hiring_employer") == F.lower("publisher")
    relation = F.when(F.col("hiring_employer").isNull(), "unknown").when(same, "unchanged").when(is_alias("publisher", "hiring_employer"), "alias").otherwise("resolved-different")
    return told.withColumn("relationship", relation)
