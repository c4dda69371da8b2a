"""The tenant registry: entries (at, entry: JSON) checked, classified, and read from corpora."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.places import let
from .graph import stored

#: An entry's fields; each source's identifiers, those it may have besides, and its hosts.
FIELDS = ("source", "identifiers", "company", "careers_url", "provenance", "last_verified_at", "enabled")
IDENTIFIERS = {
    "comeet": (("slug", "company_uid"), ()), "greenhouse": (("board",), ("region",)), "lever": (("account",), ()), "workable": (("account",), ()), "workday": (("account", "cluster", "site"), ()),
    "smartrecruiters": (("account",), ()), "ashby": (("account",), ()),
}
HOSTS = {
    "comeet": ("comeet.com", "www.comeet.com"), "greenhouse": ("boards.greenhouse.io", "boards.eu.greenhouse.io", "job-boards.greenhouse.io", "job-boards.eu.greenhouse.io"), "lever": ("jobs.lever.co",),
    "workable": ("apply.workable.com",), "smartrecruiters": ("careers.smartrecruiters.com",), "ashby": ("jobs.ashbyhq.com",),
}
STALE_AFTER = 45
ENTRY = "struct<source:string,identifiers:map<string,string>,company:string,careers_url:string,provenance:array<struct<kind:string,reference:string>>,last_verified_at:string,enabled:boolean>"


def _text(x: Column) -> Column:
    return F.coalesce(F.btrim(x) != "", F.lit(False))


def careers_url(source: Column, identifiers: Column) -> Column:
    """The address of a tenant's board."""
    i = lambda k: F.coalesce(F.try_element_at(identifiers, F.lit(k)), F.lit(""))
    at = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    region = F.when(i("region") == "eu", "job-boards.eu.greenhouse.io").otherwise("job-boards.greenhouse.io")
    return (
        F.when(source == "workday", at("https://", i("account"), ".", i("cluster"), ".myworkdayjobs.com/", i("site"))).when(source == "comeet", at("https://www.comeet.com/jobs/", i("slug"), "/", i("company_uid")))
        .when(source == "greenhouse", at("https://", region, "/", i("board"))).when(source == "lever", at("https://jobs.lever.co/", i("account"))).when(source == "smartrecruiters", at("https://careers.smartrecruiters.com/", i("account")))
        .when(source == "ashby", at("https://jobs.ashbyhq.com/", i("account"))).otherwise(at("https://apply.workable.com/", i("account"), "/"))
    )


def entry_errors(entry: Column, today: Column) -> Column:
    """Everything that is wrong with an entry (JSON), in order; empty if nothing is. An entry is parsed once for its kinds and once for its values."""
    kinds = let(F.try_parse_json(entry), lambda v: F.struct(*[F.schema_of_variant(F.try_variant_get(v, path, "variant")).alias(path[2:] or "whole") for path in ("$", "$.enabled", "$.identifiers")]))
    return let(F.struct(F.from_json(entry, ENTRY).alias("e"), F.json_object_keys(entry).alias("keys"), kinds.alias("kinds")), lambda x: _errors(x["e"], x["keys"], x["kinds"], today))


def _errors(e: Column, keys: Column, kinds: Column, today: Column) -> Column:
    names, source, known = e["identifiers"], e["source"], F.create_map(*[F.lit(v) for s in IDENTIFIERS for v in (s, True)])
    supported = F.coalesce(F.element_at(known, source), F.lit(False))
    listed = lambda values: F.array(*map(F.lit, values)).cast("array<string>")
    needed, allowed = F.array().cast("array<string>"), F.array().cast("array<string>")
    for s, (required, optional) in IDENTIFIERS.items():
        needed = F.when(source == s, listed(required)).otherwise(needed)
        allowed = F.when(source == s, listed(required + optional)).otherwise(allowed)
    have = F.coalesce(names, F.create_map().cast("map<string,string>"))
    missing = F.filter(needed, lambda k: F.coalesce(F.try_element_at(have, k), F.lit("")) == "")
    more, odd = F.array_sort(F.array_except(F.map_keys(have), allowed)), F.array_sort(F.array_except(keys, listed(FIELDS)))
    bad = F.transform(F.filter(F.map_entries(have), lambda x: ~F.coalesce(x["value"].rlike(r"^[A-Za-z0-9._-]+$"), F.lit(False))), lambda x: F.concat(F.lit("invalid public identifier: "), x["key"]))
    verified = F.coalesce(F.try_to_date(F.left(e["last_verified_at"], F.lit(10))))
    url = F.coalesce(e["careers_url"], F.lit(""))
    canonical = url.rlike(r"^https://[^/?#@\s]+(?:/[^?#]*)?$")
    host = F.lower(F.regexp_extract(url, r"^https://([^/?#:]+)", 1))
    of_source = reduce(lambda rest, s: F.when(source == s, host.isin(*HOSTS[s])).otherwise(rest), HOSTS, F.endswith(host, F.lit(".myworkdayjobs.com")))
    is_map = kinds["identifiers"].startswith("OBJECT")
    wrong = lambda when, *said: F.when(F.coalesce(when, F.lit(True)), F.concat(*[F.lit(x) if isinstance(x, str) else x for x in said]))
    first = F.array(
        wrong(F.size(odd) > 0, "unexpected entry field(s): ", F.array_join(odd, ", ")), wrong(~supported, "unsupported source"), wrong(~_text(e["company"]), "company must be a non-empty string"),
        wrong(kinds["enabled"] != "BOOLEAN", "enabled must be a boolean"), wrong(~is_map, "identifiers must be an object"),
        wrong(F.coalesce(is_map, F.lit(False)) & supported & (F.size(missing) > 0), "missing tenant identifier(s): ", F.array_join(missing, ", ")),
        wrong(F.coalesce(is_map, F.lit(False)) & supported & (F.size(more) > 0), "unexpected identifier field(s): ", F.array_join(more, ", ")),
    )
    listed_evidence = F.coalesce(F.size(e["provenance"]) > 0, F.lit(False))
    told = F.forall(e["provenance"], lambda p: _text(p["kind"]) & _text(p["reference"]))
    last = F.array(
        wrong(~listed_evidence, "provenance must be a non-empty list"), wrong(listed_evidence & ~F.coalesce(told, F.lit(False)), "each provenance item needs non-empty kind and reference"),
        wrong(verified.isNull(), "last_verified_at must be an ISO date or timestamp"), wrong(F.coalesce(verified > today, F.lit(False)), "last_verified_at cannot be in the future"),
        wrong(~canonical, "careers_url must be a canonical public HTTPS URL"), wrong(canonical & supported & ~of_source, "careers_url host does not match source"),
        wrong(canonical & supported & of_source & F.coalesce(is_map, F.lit(False)) & (url != careers_url(source, have)), "careers_url does not match tenant identifiers"),
    )
    errors = F.array_compact(F.concat(first, F.when(supported & F.coalesce(is_map, F.lit(False)), bad).otherwise(F.array().cast("array<string>")), last))
    return F.when(F.coalesce(kinds["whole"].startswith("OBJECT"), F.lit(False)), errors).otherwise(F.array(F.lit("entry must be an object")))


def registry_report(entries: DataFrame, today: str, stale_after: int = STALE_AFTER) -> DataFrame:
    """(at, source, state, reason) of each entry: invalid with its errors, a repeat of an earlier sound one, disabled, stale or valid, in this order."""
    day = F.lit(today).cast("date")
    rows = entries.withColumn("errors", entry_errors(F.col("entry"), day)).withColumn("e", F.from_json("entry", ENTRY))
    tenant = F.to_json(F.struct("e.source", F.array_sort(F.map_entries("e.identifiers")).alias("i")))
    # checked once, though read for the first of each tenant and again for all
    rows = stored(rows.select("at", "errors", F.struct("e.source", "e.enabled", "e.last_verified_at").alias("e"), F.when(F.size("errors") == 0, tenant).alias("tenant")))
    first = rows.where("tenant is not null").groupBy("tenant").agg(F.min("at").alias("first"))
    rows = rows.join(first, "tenant", "left")
    age = F.date_diff(day, F.left(F.col("e.last_verified_at"), F.lit(10)).try_cast("date"))
    state = F.when(F.size("errors") > 0, "invalid").when(F.col("at") > F.col("first"), "invalid").when(~F.col("e.enabled"), "disabled").when(age > stale_after, "stale").otherwise("valid")
    reason = (
        F.when(F.size("errors") > 0, F.array_join("errors", "; ")).when(F.col("at") > F.col("first"), "duplicate tenant identifiers").when(~F.col("e.enabled"), "disabled by registry")
        .when(age > stale_after, F.concat(F.lit("last verified "), age.cast("string"), F.lit(" days ago")))
    )
    return rows.select("at", "e.source", state.alias("state"), reason.alias("reason"))


def formula_links(cells: DataFrame) -> DataFrame:
    """(at, company, url) of a sheet's cells (at, cell): a hyperlink's address and text, or a plain name without address; empty ones are left out."""
    found = r'(?i)^=HYPERLINK\("([^"]+)","([^"]*)"\)$'
    url, name = (F.regexp_extract("cell", found, k) for k in (1, 2))
    plain = F.btrim("cell")
    company = F.when(url != "", F.coalesce(F.nullif(F.btrim(name), F.lit("")), F.lit("unknown"))).otherwise(plain)
    return cells.where((url != "") | (plain != "")).select("at", company.alias("company"), url.alias("url"))
