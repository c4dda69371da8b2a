"""Requirements against evidence, as joins: stack gaps and comparisons of years."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.experience import claimed_years, experience_requirements
from ..functions.stack import required_stack, technology

#: Verdicts of a person, which stand; advice that a gap takes back; longest line.
HUMAN = ("apply", "applied", "referral", "interesting", "skip", "not_relevant")
ACTIVE = ("apply", "referral")
LONGEST = 160


def demonstrated(signals: DataFrame, depth: DataFrame) -> DataFrame:
    """Distinct (name) that a profile shows: tags of verified ``signals`` (status, tags), less those of ``depth`` (name, modes) without hands-on work, and with those that have it."""
    tagged = signals.where("status = 'verified'").select(F.explode("tags").alias("tag")).select(technology("tag").alias("name"))
    deep = depth.select(technology("name").alias("name"), F.array_contains("modes", "hands-on").alias("hands_on")).where("name IS NOT NULL").groupBy("name").agg(F.max("hands_on").alias("hands_on"))
    shown = tagged.where("name IS NOT NULL").distinct().join(deep.where("NOT hands_on"), "name", "left_anti")
    return shown.unionByName(deep.where("hands_on").select("name")).distinct()


def stack_gaps(postings: DataFrame, shown: DataFrame, *keys: str) -> DataFrame:
    """(id, ``keys``, gaps) of postings (id, description, ``keys``): required clauses none of whose alternatives is among ``shown`` (``keys``, name). A posting without any has an empty list.

    Division by join: alternatives are rows, a clause is met if one of them
    has a partner. Small rows move, descriptions don't.
    """
    clauses = postings.select("id", *keys, F.posexplode_outer(required_stack("description")).alias("at", "clause"))
    rows = clauses.select("id", *keys, "at", "clause", F.explode_outer("clause").alias("name"))
    met = rows.join(shown.select(*keys, "name", F.lit(True).alias("met")).distinct(), [*keys, "name"], "left")
    by_clause = met.groupBy("id", *keys, "at", "clause").agg(F.coalesce(F.bool_or("met"), F.lit(False)).alias("met"))
    gap = F.when(~F.col("met") & F.col("clause").isNotNull(), F.array_join("clause", " or "))
    return by_clause.groupBy("id", *keys).agg(F.array_sort(F.collect_set(gap)).alias("gaps"))


def guarded_advice(rows: DataFrame) -> DataFrame:
    """Advice (recommendation, fit_tier, fit_line, detail, assessment, human_verdict, gaps) with what a gap changes: a note first, no positive evidence, no active advice unless a person said so."""
    said = F.array_join("gaps", "; ")
    note = F.concat(F.lit("Required stack not evidenced by verified skill tags/hands-on depth: "), said, F.lit(". Confirm before pursuing."))
    acts = (F.size("gaps") > 0) & ~F.startswith("detail", note)
    human = F.coalesce(F.lower(F.btrim("human_verdict")), F.lit("")).isin(*HUMAN)
    lead = F.when(F.col("fit_tier") == "weak", "Weak fit — ").otherwise("")
    line = F.concat(lead, F.lit("Check required stack: "), said, F.lit("."))
    line = F.when(F.length(line) <= LONGEST, line).otherwise(F.concat(lead, F.lit("Check required stack; see stack evidence.")))
    changes = {
        "detail": F.concat(note, F.lit(" "), F.col("detail")), "assessment": F.when(F.col("assessment") == "positive", "mixed").otherwise(F.col("assessment")),
        "recommendation": F.when(~human & F.col("recommendation").isin(*ACTIVE), "review").otherwise(F.col("recommendation")), "fit_line": line,
    }
    return rows.withColumns({c: F.when(acts, v).otherwise(F.col(c)) for c, v in changes.items()})


def evidenced_years(signals: DataFrame, *keys: str) -> DataFrame:
    """(``keys``, subject, years, at_least, evidence_id): the most years of a subject among verified ``signals`` (``keys``, status, claim, evidence_id)."""
    said = signals.where("status = 'verified'").withColumn("c", claimed_years("claim")).where("c.subject IS NOT NULL")
    best = F.max_by(F.struct("c.years", "c.at_least", "evidence_id"), F.struct(F.col("c.years"), F.negative(F.xxhash64("evidence_id"))))
    return said.groupBy(*keys, F.col("c.subject").alias("subject")).agg(best.alias("b")).select(*keys, "subject", "b.*")


def compared_experience(postings: DataFrame, signals: DataFrame, tenure: DataFrame, *keys: str) -> DataFrame:
    """One row a requirement of years in ``postings`` (id, ``keys``, description): what evidence of the very subject says, and met, below or unknown.

    ``tenure`` (``keys``, tenure_years) is compared with overall requirements;
    years that are a minimum can meet a requirement, not miss it.
    """
    asked = postings.select("id", *keys, F.posexplode(experience_requirements("description")).alias("at", "r")).select("id", *keys, "at", "r.*").drop("upper")
    known = evidenced_years(signals, *keys).withColumnsRenamed({"years": "own_years"})
    overall = tenure.select(*keys, F.lit("overall").alias("subject"), F.col("tenure_years").cast("double").alias("own_years"), F.lit(False).alias("at_least"), F.lit("profile:tenure").alias("evidence_id"))
    rows = asked.join(known.unionByName(overall), [*keys, "subject"], "left")
    told = F.when(F.col("own_years").isNull(), "unknown").when(F.col("own_years") >= F.col("years"), "met").when(F.col("at_least"), "unknown").otherwise("below")
    return rows.select(
        "id", *keys, "at", F.col("quote").alias("requirement_quote"), "subject", "subject_kind", F.col("years").alias("required_years"), F.col("own_years").alias("candidate_years"),
        F.coalesce("at_least", F.lit(False)).alias("candidate_years_is_minimum"), F.when(F.col("evidence_id").isNull(), F.array().cast("array<string>")).otherwise(F.array("evidence_id")).alias("candidate_evidence_ids"),
        told.alias("assessment"),
    )
