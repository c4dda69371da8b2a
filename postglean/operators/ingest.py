"""From landed rows to fresh postings: source, deduplication, scope, funnel, registry."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.places import Gazetteer, location_matches
from ..functions.postings import normalized_identity, title_tokens
from ..functions.texts import hard_excluded
from .graph import connected, stored

#: Sources in their order; the first is meant where nothing else is said.
SOURCES = ("linkedin", "comeet", "greenhouse", "lever", "workable", "ashby", "smartrecruiters", "workday")


def posting_source(source: str = "source", id_: str = "id") -> Column:
    """The source given, else the id's prefix if it is one, else the first."""
    prefix = F.lower(F.substring_index(id_, ":", 1))
    given = F.lower(F.coalesce(F.col(source), F.lit("")))
    return F.when(given != "", given).when(prefix.isin(*SOURCES[1:]), prefix).otherwise(SOURCES[0])


def secondary_key(rows: DataFrame) -> DataFrame:
    """``rows`` with ``key`` (company and title, normalised; null if either is empty)."""
    company, title = normalized_identity("company"), normalized_identity("title")
    return rows.withColumn("key", F.when((company != "") & (title != ""), F.concat_ws("|", company, title)))


def _kept_in_order(table: pa.Table) -> pa.Table:
    """Of rows that are linked: those that the rule keeps, in order of arrival."""
    kept, owner, keep = set(), {}, []
    table = table.sort_by("arrival")
    for source, id_, key in zip(*(table[c].to_pylist() for c in ("source", "id", "key"))):
        ok = (source, id_) not in kept and (key is None or owner.get(key, source) == source)
        keep.append(ok)
        if ok:
            kept.add((source, id_))
            owner.setdefault(key, source)
    return table.filter(pa.array(keep))


def dedupe_postings(rows: DataFrame, prior: DataFrame | None = None, prior_keys: DataFrame | None = None) -> DataFrame:
    """First arrivals of ``rows`` (id, source, company, title, arrival).

    A row goes if its id is empty, if (source, id) is in ``prior`` or has been
    kept before, or if its key belongs to another source: that of its first row
    that was kept, or the sources of ``prior_keys`` (key, source). A source of
    ``prior`` that is null means the first of SOURCES.

    Only a kept row marks its identity and claims its key. So where one (source,
    id) comes under several keys, rows that such keys link are taken in order,
    component by component; all others follow from two windows. Of rows of one
    (source, id, key) only the first can be kept, whatever becomes of it, so the
    fold sees each such triple once, however many rows it has.
    """
    rows = secondary_key(rows.where(F.coalesce("id", F.lit("")) != ""))
    if prior is not None:
        rows = rows.join(prior.select(F.coalesce("source", F.lit(SOURCES[0])).alias("source"), "id"), ["source", "id"], "left_anti")
    columns = rows.columns
    same = Window.partitionBy("source", "id", "key").orderBy("arrival")
    rows = rows.withColumn("nth", F.row_number().over(same)).where("nth = 1").drop("nth")
    if prior_keys is not None:
        known = rows.join(prior_keys.select("key").distinct(), "key", "left_semi").join(prior_keys.select("key", "source").distinct(), ["key", "source"], "left_semi")
        rows = rows.join(prior_keys.select("key").distinct(), "key", "left_anti").unionByName(known.select(columns))
        owned = prior_keys.select("key").distinct().withColumn("owned", F.lit(True))
        rows = rows.join(owned, "key", "left")
    else:
        rows = rows.withColumn("owned", F.lit(None).cast("boolean"))
    # a key that other sources can't claim any more ties nothing together
    rows = rows.withColumn("node", F.when(F.col("key").isNull() | F.col("owned"), F.concat_ws("\0", F.lit(""), "source", "id")).otherwise(F.col("key")))
    moved = rows.groupBy("source", "id").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most").select("source", "id", "least")
    links = rows.join(moved, ["source", "id"]).where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    tied = connected(links).withColumnRenamed("root", "group")
    ordered = rows.withColumn("key", F.when(F.col("owned"), F.lit(None)).otherwise(F.col("key"))).join(tied, "node")
    ordered = ordered.groupBy("group").applyInArrow(_kept_in_order, ordered.schema).select(columns)
    plain = rows.join(tied.select("node"), "node", "left_anti")
    first = Window.partitionBy("source", "id").orderBy("arrival")
    plain = plain.withColumn("n", F.row_number().over(first)).where("n = 1")
    owner = plain.where(F.col("key").isNotNull() & F.col("owned").isNull()).groupBy("key").agg(F.min_by("source", "arrival").alias("owner"))
    plain = plain.join(owner, "key", "left").where(F.col("owner").isNull() | (F.col("owner") == F.col("source")))
    return plain.select(columns).unionAll(ordered).drop("key")


def prior_identities(feed: DataFrame, today: str) -> DataFrame:
    """(source, id) of rows of dated feeds (feed_date: yyyy-MM-dd) before ``today``: a filter on the partition column."""
    rows = feed.where((F.col("feed_date") < F.lit(today).cast("date")) & (F.coalesce("id", F.lit("")) != ""))
    return rows.select(posting_source().alias("source"), "id").distinct()


def with_words(searches: DataFrame) -> DataFrame:
    """Searches (keywords, location) with the words that a title must have. They are a configuration, of BOUND rows at most."""
    return searches.select(title_tokens("keywords").alias("words"), "location" if "location" in searches.columns else F.lit(None).cast("string").alias("location"))


#: Searches that may be held as a literal.
BOUND = 1000


def in_scope(rows: DataFrame, searches: DataFrame, gazetteer: Gazetteer | None = None) -> DataFrame:
    """Rows whose title has all words of some search and none of the hard exclusions; with a gazetteer the same search's place must match too.

    Searches are at most BOUND rows; more are refused, as they are held as a literal.
    """
    wanted = with_words(searches).limit(BOUND + 1).collect()
    if len(wanted) > BOUND:
        raise ValueError(f"more than {BOUND} searches")
    tokens = F.col("tokens")
    by_place: dict[str | None, list[list[str]]] = {}
    for r in wanted:
        by_place.setdefault(r.location if gazetteer else None, []).append(r.words)
    matches = []
    for place, words in by_place.items():
        literal = F.array(*[F.array(*map(F.lit, w)).cast("array<string>") for w in words])
        titled = F.exists(literal, lambda w: F.size(F.array_except(w, tokens)) == 0)
        matches.append(titled & location_matches(F.col("location"), F.col("remote"), place, gazetteer) if gazetteer else titled)
    scope = reduce(lambda x, y: x | y, matches, F.lit(False))
    return rows.withColumn("tokens", title_tokens("title")).where(scope & ~hard_excluded("title")).drop("tokens")


def run_funnel(registered: DataFrame, landed: DataFrame, matched: DataFrame, upserted: DataFrame) -> DataFrame:
    """Per source: the registry's counts (of ``registry_funnel``), parsed, matched, filtered, inserted_new, updated_existing, and ``warnings``."""
    n = lambda df, name, where=F.lit(True): df.groupBy("source").agg(F.count_if(where).alias(name))
    written = upserted.groupBy("source").agg(F.count_if(F.col("disposition") == "inserted").alias("inserted_new"), F.count_if(F.col("disposition") == "updated").alias("updated_existing"))
    by = registered.withColumnRenamed("valid", "eligible").join(n(landed, "parsed"), "source", "full_outer")
    by = by.join(n(matched, "matched"), "source", "left").join(written, "source", "left").fillna(0)
    by = by.withColumn("filtered", F.col("parsed") - F.col("matched"))
    say = lambda *parts: F.concat(F.col("source"), *[F.lit(p) if i % 2 == 0 else F.col(p).cast("string") for i, p in enumerate(parts)])
    warnings = F.array(
        F.when((F.col("registered") > 0) & (F.col("eligible") == 0), say(": registered=", "registered", " but eligible=0 (stale=", "stale", ", disabled=", "disabled", ", invalid=", "invalid", ")")),
        F.when((F.col("parsed") > 0) & (F.col("matched") == 0), say(": parsed=", "parsed", " but matched=0; filtered=", "filtered")),
        F.when(F.col("expiring_within_7d") > 0, say(": expiring_within_7d=", "expiring_within_7d")),
    )
    return by.withColumn("warnings", F.array_compact(warnings))


def source_funnel(landed: DataFrame, matched: DataFrame, upserted: DataFrame) -> DataFrame:
    """Per source: parsed, matched, filtered, inserted, updated; and a warning where all was filtered."""
    n = lambda df, name, where=F.lit(True): df.groupBy("source").agg(F.count_if(where).alias(name))
    by = n(landed, "parsed").join(n(matched, "matched"), "source", "left")
    by = by.join(upserted.groupBy("source").agg(F.count_if(F.col("disposition") == "inserted").alias("inserted"), F.count_if(F.col("disposition") == "updated").alias("updated")), "source", "left")
    by = by.fillna(0).withColumn("filtered", F.col("parsed") - F.col("matched"))
    return by.withColumn("warning", F.when((F.col("parsed") > 0) & (F.col("matched") == 0), F.concat(F.col("source"), F.lit(": nothing matched"))))


def expanded_searches(terms: DataFrame, places: DataFrame, recency: str) -> DataFrame:
    """Every term in every place. Places are a configuration of BOUND rows at most; more are refused."""
    if recency not in ("24h", "3d", "7d", "30d"):
        raise ValueError(f"no such window: {recency}")
    given = places.limit(BOUND + 1).collect()
    if len(given) > BOUND:
        raise ValueError(f"more than {BOUND} places")
    each = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in r.asDict().items()]) for r in given]).cast(f"array<{places.schema.simpleString()}>")
    return terms.select("*", F.inline(each)).withColumn("recency", F.lit(recency))


def registry_states(tenants: DataFrame, today: int, stale_after: int = 45) -> DataFrame:
    """``tenants`` (source, key, company, enabled, verified: days) with ``state``: invalid (incomplete or a repeat), disabled, stale or valid."""
    repeat = F.row_number().over(Window.partitionBy("source", "key").orderBy("company")) > 1
    incomplete = (F.coalesce("key", F.lit("")) == "") | (F.coalesce("company", F.lit("")) == "") | F.col("verified").isNull() | (F.col("verified") > today)
    return tenants.withColumn("state", F.when(incomplete | repeat, "invalid").when(~F.col("enabled"), "disabled").when(today - F.col("verified") > stale_after, "stale").otherwise("valid"))


def registry_funnel(states: DataFrame, today: int, stale_after: int = 45) -> DataFrame:
    soon = (F.col("state") == "valid") & (today - F.col("verified") > stale_after - 7)
    return states.groupBy("source").agg(F.count("*").alias("registered"), *[F.count_if(F.col("state") == s).alias(s) for s in ("valid", "stale", "disabled", "invalid")], F.count_if(soon).alias("expiring_within_7d"))


def merged_registry(registry: DataFrame, candidates: DataFrame, key: tuple[str, ...] = ("source", "key")) -> DataFrame:
    """The registry with candidates that it hasn't, one of each; what it has stays as it is. Of equal candidates the least company is taken."""
    fresh = candidates.join(registry.select(*key), list(key), "left_anti")
    one = fresh.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy("company"))).where("n = 1").drop("n")
    return registry.unionByName(one.select(registry.columns))


def corpus_links(lines: DataFrame) -> DataFrame:
    """(reference, url) of each link in lines (reference, line): Markdown links, or bare addresses where there are none; each once a line."""
    linked = F.regexp_extract_all("line", F.lit(r"\[[^\]]*\]\((https?://[^)\s]+)\)"), 1)
    bare = F.regexp_extract_all("line", F.lit(r"(https?://[^\s)>|]+)"), 1)
    urls = F.array_distinct(F.when(F.size(linked) > 0, linked).otherwise(bare))
    return lines.select("reference", F.explode(urls).alias("url"))
