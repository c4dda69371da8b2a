"""Boards as they land, one text a tenant (tenant, body), to postings. What isn't an object, or has no id, is left out; a body that isn't the board's is no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.texts import plain_text

#: Jobs of JSON boards, as they land.
GREENHOUSE = "array<struct<id:string,title:string,company_name:string,content:string,absolute_url:string,location:struct<name:string>,first_published:string,updated_at:string>>"
LEVER = (
    "array<struct<id:string,text:string,descriptionPlain:string,openingPlain:string,additionalPlain:string,hostedUrl:string,createdAt:bigint,workplaceType:string,"
    "categories:struct<location:string>,lists:array<struct<text:string,content:string>>>>"
)
ASHBY = "array<struct<id:string,title:string,isListed:boolean,location:string,secondaryLocations:array<struct<location:string>>,jobUrl:string>>"
COMEET = (
    "array<struct<uid:string,name:string,company_name:string,workplace_type:string,url_comeet_hosted_page:string,time_updated:string,"
    "location:struct<name:string,displayName:string>,custom_fields:struct<details:array<struct<value:string>>>>>"
)
SMARTRECRUITERS = "struct<totalFound:int,offset:int,limit:int,content:array<struct<id:string,name:string>>>"
WORKDAY = "struct<total:int,jobPostings:array<struct<externalPath:string,title:string>>>"


def _jobs(landed: DataFrame, jobs: Column, key: str) -> DataFrame:
    return landed.select("tenant", F.explode(jobs).alias("j")).where(F.coalesce(F.col(f"j.{key}"), F.lit("")) != "")


def _id(source: str, key: str) -> Column:
    return F.concat(F.lit(f"{source}:"), "tenant", F.lit(":"), f"j.{key}").alias("id")


def greenhouse_jobs(landed: DataFrame) -> DataFrame:
    """Descriptions are markup that was encoded, often more than once: they are read until nothing changes, then as text."""
    jobs = _jobs(landed, F.from_json(F.get_json_object("body", "$.jobs"), GREENHOUSE), "id")
    return jobs.select("tenant", _id("greenhouse", "id"), "j.title", F.btrim(F.coalesce(F.nullif(F.col("j.company_name"), F.lit("")), "tenant")).alias("company"), F.col("j.location.name").alias("location"), F.col("j.absolute_url").alias("url"), plain_text(F.coalesce("j.content", F.lit("")), encoded=True).alias("text"))


def lever_jobs(landed: DataFrame) -> DataFrame:
    """The text is description, opening, lists and what is added, as far as they say something."""
    jobs = _jobs(landed, F.from_json("body", LEVER), "id")
    empty = F.array().cast("array<struct<text:string,content:string>>")
    lists = F.array_join(F.transform(F.coalesce("j.lists", empty), lambda x: F.concat_ws(" ", x["text"], x["content"])), " ")
    parts = F.array(*[F.coalesce(c, F.lit("")) for c in (F.col("j.descriptionPlain"), F.col("j.openingPlain"), lists, F.col("j.additionalPlain"))])
    text = plain_text(F.array_join(F.filter(parts, lambda x: F.btrim(x) != ""), " "))
    return jobs.select("tenant", _id("lever", "id"), F.col("j.text").alias("title"), F.col("j.categories.location").alias("location"), F.col("j.workplaceType").alias("work_mode"), F.col("j.hostedUrl").alias("url"), F.timestamp_millis("j.createdAt").alias("posted_at"), text.alias("text"))


def comeet_jobs(landed: DataFrame) -> DataFrame:
    """Positions stand as an array within the page's script. When a position was updated isn't when it was posted."""
    found = F.regexp_extract("body", r"(?s)COMPANY_POSITIONS_DATA\s*=\s*(\[.*?\]);", 1)
    jobs = _jobs(landed, F.from_json(found, COMEET), "uid")
    details = F.array_join(F.transform(F.coalesce("j.custom_fields.details", F.array().cast("array<struct<value:string>>")), lambda x: F.coalesce(x["value"], F.lit(""))), " ")
    mode = F.element_at(F.create_map(*map(F.lit, ("On-site", "on-site", "Hybrid", "hybrid", "Remote", "remote"))), F.col("j.workplace_type"))
    place = F.coalesce(F.nullif(F.col("j.location.displayName"), F.lit("")), F.col("j.location.name"))
    return jobs.select("tenant", _id("comeet", "uid"), F.col("j.name").alias("title"), F.col("j.company_name").alias("company"), place.alias("location"), F.col("j.url_comeet_hosted_page").alias("url"), F.col("j.time_updated").alias("updated_at"), mode.alias("work_mode"), plain_text(details).alias("text"))


def ashby_jobs(landed: DataFrame) -> DataFrame:
    """Listed jobs whose address is the tenant's; places joined in order, each once."""
    jobs = _jobs(landed, F.from_json(F.get_json_object("body", "$.jobs"), ASHBY), "id")
    jobs = jobs.where(F.col("j.isListed") & (F.col("j.jobUrl") == F.concat(F.lit("https://jobs.ashbyhq.com/"), "tenant", F.lit("/"), "j.id")))
    places = F.concat(F.array("j.location"), F.coalesce(F.transform("j.secondaryLocations", lambda x: x["location"]), F.array().cast("array<string>")))
    return jobs.select("tenant", _id("ashby", "id"), "j.title", F.array_join(F.array_distinct(F.filter(places, lambda x: x.isNotNull())), "; ").alias("location"), F.col("j.jobUrl").alias("url"))


def markdown_jobs(landed: DataFrame) -> DataFrame:
    """Pipe tables of seven cells."""
    lines = landed.select("tenant", F.explode(F.split("body", "\n")).alias("line"))
    cells = lines.select("tenant", F.transform(F.split(F.regexp_replace("line", r"^\||\|$", ""), r"\|"), lambda x: F.btrim(x)).alias("c")).where((F.size("c") == 7) & ~F.col("c")[0].rlike("^:?-+:?$") & (F.col("c")[0] != "Title"))
    return cells.select("tenant", F.col("c")[0].alias("title"), F.col("c")[1].alias("department"), F.col("c")[2].alias("location"), F.col("c")[5].alias("posted_at"), F.regexp_extract(F.col("c")[6], r"/view/([A-Za-z0-9]+)", 1).alias("token"))


def _whole(pages: DataFrame, total: str, most_pages: int) -> DataFrame:
    """Per tenant of ``pages`` (tenant, offset, n, total, ids): whether its pages are its whole list, each once and with one total."""
    by = pages.groupBy("tenant").agg(F.sum("n").alias("n"), F.max(total).alias("total"), F.min(total).alias("least"), F.count("*").alias("pages"), F.count_distinct("offset").alias("offsets"))
    return by.select("tenant", ((F.col("n") == F.col("total")) & (F.col("least") == F.col("total")) & (F.col("pages") <= most_pages) & (F.col("pages") == F.col("offsets"))).alias("whole"))


def smartrecruiters_list(landed: DataFrame, most_pages: int = 5) -> DataFrame:
    """(tenant, id, whole) of pages (tenant, offset, body): a list is whole if its total is stable, no id comes twice, and all of it is there."""
    p = landed.select("tenant", "offset", F.from_json("body", SMARTRECRUITERS).alias("p")).where("p.totalFound is not null")
    whole = _whole(p.select("tenant", "offset", F.size("p.content").alias("n"), F.col("p.totalFound").alias("total")), "total", most_pages)
    return _membership(p.select("tenant", F.explode("p.content.id").alias("id")), whole)


def workday_list(landed: DataFrame, most_pages: int = 25) -> DataFrame:
    """The same over pages of twenty; a later page's total of 0 means that of the first. ``too_large``: more than ``most_pages`` hold."""
    p = landed.select("tenant", "offset", F.from_json("body", WORKDAY).alias("p")).where("p.total is not null")
    first = p.where("offset = 0").groupBy("tenant").agg(F.max("p.total").alias("first"))
    p = p.join(first, "tenant").withColumn("total", F.when((F.col("offset") > 0) & (F.col("p.total") == 0), F.col("first")).otherwise(F.col("p.total")))
    whole = _whole(p.select("tenant", "offset", F.size("p.jobPostings").alias("n"), "total"), "total", most_pages)
    rows = _membership(p.select("tenant", F.explode("p.jobPostings.externalPath").alias("id")), whole)
    return rows.join(first.select("tenant", (F.col("first") > most_pages * 20).alias("too_large")), "tenant")


def _membership(rows: DataFrame, whole: DataFrame) -> DataFrame:
    twice = rows.groupBy("tenant", "id").agg(F.count("*").alias("n"))
    sound = twice.groupBy("tenant").agg((F.max("n") == 1).alias("once"))
    return twice.join(whole, "tenant").join(sound, "tenant").select("tenant", "id", (F.col("whole") & F.col("once")).alias("whole"))


def country_facets(landed: DataFrame, country: str, levels: int = 4) -> DataFrame:
    """(tenant, parameter, ids) of a board's facets (tenant, body): the first facet of countries or regions that names the country, at any of ``levels`` levels of nesting."""
    inner = "array<struct<facetParameter:string,id:string,descriptor:string{}>>"
    kind = inner.format("")
    for _ in range(levels):
        kind = inner.format(f",values:{kind}")
    rows = landed.select("tenant", F.from_json(F.get_json_object("body", "$.facets"), kind).alias("f"), F.lit("").alias("path"))
    found = []
    for _ in range(levels):
        rows = rows.select("tenant", "path", F.posexplode_outer("f").alias("at", "x")).where("x is not null").withColumn("path", F.concat("path", F.lpad(F.col("at").cast("string"), 4, "0")))
        named = F.filter("x.values", lambda v: (v["descriptor"] == country) & v["id"].isNotNull())
        found.append(rows.where(F.col("x.facetParameter").isin("locationCountry", "locationHierarchy1")).select("tenant", "path", F.col("x.facetParameter").alias("parameter"), F.transform(named, lambda v: v["id"]).alias("ids")).where("size(ids) > 0"))
        rows = rows.select("tenant", F.col("x.values").alias("f"), "path")
        if "values" not in rows.schema["f"].dataType.elementType.names:
            break
    every = found[0]
    for more in found[1:]:
        every = every.unionAll(more)
    return every.groupBy("tenant").agg(F.min_by(F.struct("parameter", "ids"), "path").alias("m")).select("tenant", "m.*")


def tolerant_json_lines(lines: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """Objects of JSON lines (value), and what isn't one; blank lines are neither."""
    parsed = lines.where(F.btrim("value") != "").withColumn("v", F.try_parse_json("value"))
    is_object = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    return parsed.where(is_object).select(F.from_json("value", schema).alias("r")).select("r.*"), parsed.where(~is_object).select("value")


#: Boards by source.
ADAPTERS = {"greenhouse": greenhouse_jobs, "lever": lever_jobs, "comeet": comeet_jobs, "ashby": ashby_jobs}


def all_boards(landed: DataFrame) -> DataFrame:
    """(source, tenant, id, title, location, url) of landed bodies (source, tenant, body) of every board that has an adapter; a bad body drops only its own rows."""
    columns = ["tenant", "id", "title", "location", "url"]
    parts = [adapter(landed.where(F.col("source") == source)).select(F.lit(source).alias("source"), *columns) for source, adapter in ADAPTERS.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
