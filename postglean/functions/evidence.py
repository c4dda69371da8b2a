"""What a listing says of the vacancy behind it: requisitions, a fingerprint of its text, its boards' keys, hints of its place."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .gate import holds
from .places import let, located, names_in


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def nfkc(text) -> Column:
    """Compatibility-normalised text: there is no built-in for it. Plain ASCII passes as it is."""
    t = _col(text)
    other = F.when(t.rlike(r"[^\x00-\x7F]"), t)
    return F.coalesce(F.pandas_udf(lambda s: s.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore"), "string")(other), t)


def identity_text(text) -> Column:
    """Compatibility-normalised, trimmed, single-spaced, lower-case text."""
    return F.lower(F.regexp_replace(F.regexp_replace(nfkc(F.coalesce(_col(text), F.lit(""))), F.lit(r"(?U)^\s+|\s+$"), F.lit("")), F.lit(r"(?U)\s+"), F.lit(" ")))


def _part(url: Column, part: str) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit(part)), F.lit(""))


def _first(url: Column, host: str, path: str, group: int = 1, decoded: bool = False) -> Column:
    """What a path names, on hosts that match; null elsewhere."""
    p = _part(url, "PATH")
    p = F.try_url_decode(p) if decoded else p
    return F.when(_part(url, "HOST").rlike(host), F.nullif(F.regexp_extract(p, path, group), F.lit("")))


_GREENHOUSE = r"^(?:job-)?boards(?:\.eu)?\.greenhouse\.io$"
_WORKABLE = r"^/([^/]+)/(?:j/([^/]+)/?|jobs/view/([^/]+)\.md)$"


def role_key(url) -> Column:
    """The board's own key of a role; null for any other address."""
    u = _col(url)
    region = F.when(F.contains(_part(u, "HOST"), F.lit(".eu.")), "eu").otherwise("us")
    key = lambda name, *parts: F.when(reduce(lambda a, b: a & b, [p.isNotNull() for p in parts]), F.concat(F.lit(name), *[x for p in parts for x in (F.lit(":"), p)]))
    workable = F.coalesce(_first(u, r"^apply\.workable\.com$", _WORKABLE, 2), _first(u, r"^apply\.workable\.com$", _WORKABLE, 3))
    comeet = r"^/jobs/([^/]+)/([^/]+)/([^/]+)(?:/[^/]+)?/?$"
    return F.coalesce(
        key("greenhouse", F.when(_first(u, _GREENHOUSE, r"^/([^/]+)/jobs/(\d+)/?$").isNotNull(), region), _first(u, _GREENHOUSE, r"^/([^/]+)/jobs/(\d+)/?$"), _first(u, _GREENHOUSE, r"^/([^/]+)/jobs/(\d+)/?$", 2)),
        key("workable", _first(u, r"^apply\.workable\.com$", _WORKABLE), workable),
        key("lever", _first(u, r"^jobs\.lever\.co$", r"^/([^/]+)/([a-f0-9-]{36})(?:/apply)?/?$"), _first(u, r"^jobs\.lever\.co$", r"^/([^/]+)/([a-f0-9-]{36})(?:/apply)?/?$", 2)),
        key("comeet", *[_first(u, r"^www\.comeet\.com$", comeet, k) for k in (1, 2, 3)]),
        key("linkedin", _first(u, r"^(?:www|il)\.linkedin\.com$", r"^/jobs/view/(?:[^/]*-)?(\d+)/?$")),
    )


def posting_ids(url) -> Column:
    """Numbers by which boards know a posting: they can't be requisitions."""
    u = _col(url)
    query = lambda k: F.try_parse_url(u, F.lit("QUERY"), F.lit(k))
    numeric = lambda x: F.when(x.rlike(r"^\d+$"), x)
    linkedin = r"^(?:[a-z]{2,3}\.)?linkedin\.com$"
    found = [
        numeric(query("gh_jid")), _first(u, _GREENHOUSE, r"^/[^/]+/jobs/(\d+)/?$", 1, True), _first(u, r"^jobs\.lever\.co$", r"(?i)^/[^/]+/([a-f\d]{8}(?:-[a-f\d]{4}){3}-[a-f\d]{12})(?:/apply)?/?$", 1, True),
        _first(u, r"^www\.comeet\.com$", r"^/jobs/[^/]+/[^/]+/([^/]+)(?:/[^/]+)?/?$", 1, True), _first(u, r"^apply\.workable\.com$", _WORKABLE, 2, True), _first(u, r"^apply\.workable\.com$", _WORKABLE, 3, True),
        _first(u, linkedin, r"^/jobs/view/(?:[^/]*-)?(\d+)/?$", 1, True), F.when(_part(u, "HOST").rlike(linkedin), numeric(query("currentJobId"))),
    ]
    return F.transform(F.array_compact(F.array(*found)), F.upper)


#: How texts name a requisition.
REQUISITION = (
    r"(?iU)\bJR\d{5,}\b|\b(?:job\s+req(?:uisition)?\s+|req(?:uisition)?\.?(?:\s*(?:id|number|no\.?)\s*[:#-]?|\s*[:#-])\s*)(?=[A-Z\d_-]*\d)([A-Z\d]+(?:[-_][A-Z\d]+)*)\b"
)


def requisitions(urls: Column, description) -> Column:
    """Requisitions that a description names, but for postings' own numbers, and those that one board's addresses hold; sorted."""
    prose = F.regexp_replace(_col(description), F.lit(r"(?i)https?://\S+"), F.lit(" "))
    # a number of its own, or words before one; other texts needn't be read
    whole = F.when(holds(description, "req", "jr"), F.regexp_extract_all(prose, F.lit(REQUISITION), 0)).otherwise(F.array().cast("array<string>"))
    named = F.transform(whole, lambda w: F.upper(F.coalesce(F.nullif(F.regexp_extract(w, REQUISITION, 1), F.lit("")), w)))
    number = lambda x: F.nullif(F.regexp_extract(x, r"^(?:JR)?(\d+)$", 1), F.lit(""))
    own = let(F.flatten(F.transform(urls, posting_ids)), lambda ids: F.struct(ids.alias("ids"), F.array_compact(F.transform(ids, number)).alias("numbers")))
    told = let(own, lambda x: F.filter(named, lambda r: ~F.array_contains(x["ids"], r) & ~F.coalesce(F.array_contains(x["numbers"], number(r)), F.lit(False))))
    workday = F.array_compact(F.transform(urls, lambda u: F.upper(_first(u, r"\.myworkdayjobs\.com$", r"(?i)_(JR\d+|R\d{5,})(?:-\d+)?(?:/apply)?/?$", 1, True))))
    return F.array_sort(F.array_distinct(F.concat(told, workday)))


#: Light markup, and paragraphs that all postings of an employer share.
_MARKUP = (
    (r"(?i)</?(?:p|br|div|span|li|ul|ol|strong|em|b|i|h[1-6])(?:\s[^>]*)?/?>", " "), (r"(?i)&nbsp;|&#160;", " "), (r"\[([^\]]+)\]\([^)]*\)", "$1"), (r"(\*\*|__)(.*?)\1", "$2"), ("`([^`]+)`", "$1"), (r"(^|\n)#{1,6}\s+", "$1"),
)
#: Of each markup, the characters of which one must be there.
_MARKS = (("<",), ("&",), ("[",), ("**", "__"), ("`",), ("#",))
_SHARED = r"(?iU)^\s*(?:we are an equal opportunity employer\b|equal (?:employment )?opportunity (?:employer|statement)\b|if you (?:need|require) (?:a reasonable )?accommodation\b)"
LEAST_BODY = 400


def fingerprint(description) -> Column:
    """Length and digest of a description's words; null for one that is too short to tell listings apart."""
    without = lambda t, m: let(t, lambda x: F.when(reduce(lambda a, b: a | b, [F.contains(x, F.lit(c)) for c in m[2]]), F.regexp_replace(x, F.lit(m[0]), F.lit(m[1]))).otherwise(x))
    text = reduce(without, [(*m, marks) for m, marks in zip(_MARKUP, _MARKS, strict=True)], nfkc(F.coalesce(_col(description), F.lit(""))))
    kept = F.filter(F.split(text, r"\n\s*\n"), lambda p: ~(holds(p, "equal", "accommodation") & p.rlike(_SHARED)))
    body = F.lower(F.btrim(F.regexp_replace(F.array_join(kept, " "), F.lit(r"(?U)\s+"), F.lit(" "))))
    return let(body, lambda b: F.when(F.length(b) >= LEAST_BODY, F.concat_ws(":", F.length(b).cast("string"), F.md5(b))))


#: Cities with their region and spellings; cities and states of the United States; names of countries.
ISRAEL_CITIES = (
    ("tel aviv", "tel aviv", "tel aviv|tel aviv yafo|tel aviv jaffa"), ("haifa", "haifa", "haifa"), ("jerusalem", "jerusalem", "jerusalem"), ("petah tikva", "center", "petah tikva|petach tikva|petah tiqwa"),
    ("ramat gan", "tel aviv", "ramat gan"), ("bnei brak", "tel aviv", "bnei brak"), ("raanana", "center", "raanana|ra anana"), ("kfar monash", "center", "kfar monash"), ("sarid", "north", "sarid"),
    ("ramat yishai", "north", "ramat yishai"), ("yokneam ilit", "north", "yokneam ilit|yokneam|yoqneam illit"),
)
AREAS = ("tel aviv", "haifa", "jerusalem", "center", "north", "south")
US_CITIES = (
    ("charlotte", "nc"), ("wayne", "pa"), ("skippack", "pa"), ("herndon", "va"), ("seattle", "wa"), ("chicago", "il"), ("lisle", "il"), ("rochester hills", "mi"), ("hialeah", "fl"), ("jersey city", "nj"),
    ("redmond", "wa"), ("bastrop", "tx"), ("austin", "tx"), ("san francisco", "ca"), ("new york", "ny"), ("stamford", "ct"),
)
US_STATES = {
    "minnesota": "mn", "illinois": "il", "alabama": "al", "georgia": "ga", "pennsylvania": "pa", "texas": "tx", "california": "ca", "maryland": "md", "michigan": "mi", "new york": "ny", "washington": "wa",
    "north carolina": "nc", "virginia": "va", "florida": "fl", "colorado": "co",
}
STATE_CODES = "al ak az ar ca co ct de dc fl ga hi id il in ia ks ky la me md ma mi mn ms mo mt ne nv nh nj nm ny nc nd oh ok or pa ri sc sd tn tx ut vt va wa wv wi wy".split(" ")
COUNTRIES = (
    ("israel", "israel"), ("us", "united states|usa|us"), ("canada", "canada"), ("uk", "united kingdom|uk|england"), ("france", "france"), ("germany", "germany"), ("netherlands", "netherlands"), ("poland", "poland"),
    ("australia", "australia"),
    *((c, c) for c in "india|china|japan|singapore|brazil|mexico|spain|italy|sweden|denmark|finland|norway|greece|portugal|switzerland|austria|new zealand|south africa".split("|")),
)


def place_hints(location) -> Column:
    """(text, countries, region, city): hints of identity, not geocoding. What isn't known is null or empty."""
    lit = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    table = lambda pairs: F.create_map(*[F.lit(x) for kv in pairs for x in kv])
    text = F.regexp_replace(F.lower(nfkc(F.coalesce(_col(location), F.lit("")))), F.lit(r"\([^)]*\)"), F.lit(""))
    text = F.btrim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, F.lit("[.’']"), F.lit("")), F.lit("[-–/|]"), F.lit(" ")), F.lit(r"(?U)\s+"), F.lit(" ")))
    of_country = {n: key for key, names in COUNTRIES for n in names.split("|")}
    il = {n: (city, area) for city, area, names in ISRAEL_CITIES for n in names.split("|")}
    edges = ("(?<![^ ,])", "(?![^ ,])")

    def read(text: Column) -> Column:
        """What single patterns find in the text."""
        named = F.transform(names_in(text, list(of_country), *edges), lambda n: F.element_at(table(of_country.items()), n))
        first = F.btrim(F.get(F.split(text, ","), F.lit(0)))
        states = F.transform(names_in(text, list(US_STATES), *edges), lambda n: F.element_at(table(US_STATES.items()), n))
        parts = F.transform(F.split(text, ","), lambda x: F.btrim(x))
        return F.struct(
            text.alias("text"), parts.alias("parts"), first.alias("first"), F.array_intersect(lit([k for k, _ in COUNTRIES]), named).alias("countries"), F.array_intersect(lit(list(US_STATES.values())), states).alias("states"),
            F.element_at(table((n, c) for n, (c, _) in il.items()), first).alias("il_city"), F.element_at(table(US_CITIES), first).alias("us_area"),
            F.coalesce(*[F.when(F.contains(text, F.lit(f"{a} district")), a) for a in reversed(AREAS)], F.element_at(table((n, a) for n, (_, a) in il.items()), first)).alias("il_region"),
        )

    def told(x: Column) -> Column:
        none = F.size(x["countries"]) == 0
        at_home = x["il_city"].isNotNull() | x["il_region"].isNotNull()
        us_area = F.when(none & ~at_home, x["us_area"])
        american = none & ~at_home & (us_area.isNotNull() | (F.size(x["states"]) > 0))
        where = F.when(none & at_home, lit(["israel"])).when(american, lit(["us"])).otherwise(x["countries"])
        codes = F.array_intersect(F.array_distinct(F.transform(x["parts"], lambda p: F.regexp_replace(p, F.lit("^or "), F.lit("")))), lit(STATE_CODES))
        areas = F.array_distinct(F.concat(codes, x["states"]))
        in_us = (F.size(where) == 1) & (where[0] == "us")
        region = F.when(in_us & (F.size(areas) == 1), areas[0]).otherwise(F.coalesce(us_area, x["il_region"]))
        plain = (F.size(x["countries"]) == 1) & (F.size(x["parts"]) > 1) & ~x["first"].isin(*of_country, *US_STATES) & ~x["first"].rlike("district|region|remote|central|customer")
        city = F.coalesce(x["il_city"], F.when(us_area.isNotNull(), x["first"]), F.when(plain, x["first"]))
        return F.struct(x["text"].alias("place"), where.alias("countries"), region.alias("region"), city.alias("city"))

    return let(let(text, read), told)


def vacancy_evidence(rows):
    """``rows`` (id, company, title, location, url, apply_url, raw_jd, …) with what grouping needs of each."""
    urls = F.array_distinct(F.array_compact(F.array(F.nullif(F.col("apply_url"), F.lit("")), F.col("url"))))
    rows = located(rows.withColumn("urls", urls), "location", place_hints, "hints")
    return (
        rows.withColumn("requisitions", requisitions(F.col("urls"), "raw_jd")).withColumn("fingerprint", fingerprint("raw_jd"))
        .withColumn("role_keys", F.array_distinct(F.array_compact(F.transform("urls", role_key)))).select("*", "hints.*").drop("urls", "hints")
    )
