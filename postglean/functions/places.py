"""Column functions over locations: split and resolved facts, matching of a search's place, hints for reposts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .postings import STATE_CITIES


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


#: Places of Israel with their region and name.
ISRAEL_PLACES = {
    "tel aviv": ("IL-TA", "Tel Aviv"), "tel aviv-yafo": ("IL-TA", "Tel Aviv"), "jerusalem": ("IL-JM", "Jerusalem"), "haifa": ("IL-HA", "Haifa"), "herzliya": ("IL-TA", "Herzliya"),
    "petah tikva": ("IL-TA", "Petah Tikva"), "ramat gan": ("IL-TA", "Ramat Gan"), "ra'anana": ("IL-TA", "Ra'anana"), "raanana": ("IL-TA", "Ra'anana"), "yavne": ("IL-TA", "Yavne"),
    "kfar saba": ("IL-TA", "Kfar Saba"), "netanya": ("IL-TA", "Netanya"), "yokneam": ("IL-HA", "Yokneam"), "beer sheva": ("IL-D", "Be'er Sheva"), "be'er sheva": ("IL-D", "Be'er Sheva"),
    "caesarea": ("IL-HA", "Caesarea"), "rehovot": ("IL-TA", "Rehovot"), "hod hasharon": ("IL-TA", "Hod Hasharon"), "bnei brak": ("IL-TA", "Bnei Brak"),
}
#: Metropolitan areas.
METRO_PLACES = {
    "san francisco bay area": ("US-CA", "San Francisco"), "new york city metropolitan area": ("US-NY", "New York"), "greater cleveland": ("US-OH", "Cleveland"),
    "greater chicago area": ("US-IL", "Chicago"), "austin, texas metropolitan area": ("US-TX", "Austin"), "san antonio, texas metropolitan area": ("US-TX", "San Antonio"),
    "columbia, south carolina metropolitan area": ("US-SC", "Columbia"),
}
#: Names of the countries.
COUNTRY_NAMES = {"israel": "IL", "il": "IL", "united states": "US", "united states of america": "US", "usa": "US", "u.s.": "US", "u.s.a.": "US", "us": "US"}
#: Codes of the states.
STATES = (
    "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY DC"
).split()
NOT_PLACES = ("remote", "hybrid", "onsite", "on-site", "worldwide", "anywhere")
RESOLVED = "struct<country:string,region:string,city:string>"


def _key(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.btrim(F.replace(text, F.lit("’"), F.lit("'")))), F.lit(r"\s+"), F.lit(" "))


def location_parts(location) -> Column:
    """The places that a location lists."""
    parts = F.split(F.coalesce(_col(location), F.lit("")), r"\s*(?:;|\||·|\n)\s*|\s+/\s+")
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, F.lit(r"^\s+|\s+$"), F.lit(""))), lambda x: x != "")


def _places() -> dict[str, tuple[str, str | None, str | None]]:
    cities = {c.lower(): ("US", f"US-{state}", c) for state, names in STATE_CITIES.items() for c in names.split("|")}
    return {k: ("IL", *v) for k, v in ISRAEL_PLACES.items()} | cities | {k: ("US", *v) for k, v in METRO_PLACES.items()}


def _fact(country: str, region: str | None = None, city: str | None = None) -> Column:
    return F.struct(*[F.lit(v).cast("string").alias(k) for k, v in (("country", country), ("region", region), ("city", city))])


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is read."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def names_in(text: Column, names: list[str], before: str, after: str) -> Column:
    """At each place of a text the first of ``names`` that begins there, by one pattern of them all."""
    spelled = "|".join("".join("\\" + c if not c.isalnum() and c != " " else c for c in n) for n in names)
    return F.regexp_extract_all(text, F.lit(f"{before}(?=({spelled}){after})"), 1)


def resolved_place(place) -> Column:
    """(country, region, city) of one place: a known name; ``City, ST``; the longest known name in it; a country in it; else null."""
    p, known = _col(place), _places()
    countries = {k: (c, None, None) for k, c in COUNTRY_NAMES.items()}
    facts = F.create_map(*[x for k, v in (known | countries).items() for x in (F.lit(k), _fact(*v))])
    town, state = (F.regexp_extract(F.btrim(p), r"^([^,]+),\s*([A-Z]{2})$", k) for k in (1, 2))
    of_country = F.element_at(F.create_map(*[F.lit(v) for kv in COUNTRY_NAMES.items() for v in kv]), _key(town)) == "US"
    in_state = F.struct(F.lit("US").alias("country"), F.concat(F.lit("US-"), state).alias("region"), F.when(~F.coalesce(of_country, F.lit(False)), F.btrim(town)).alias("city"))
    ordered = sorted(known, key=lambda k: -len(k)) + list(countries)
    rank = F.create_map(*[x for k, name in enumerate(ordered) for x in (F.lit(name), F.lit(k))])
    named = names_in(_key(p), ordered, "(?<![a-z])", "(?![a-z])")
    best = F.element_at(F.array_sort(F.transform(named, lambda n: F.struct(F.element_at(rank, n).alias("rank"), n.alias("name")))), 1)["name"]
    return let(F.coalesce(F.when(F.map_contains_key(facts, _key(p)), _key(p)), F.when(state.isin(*STATES), F.lit("")), F.when(F.size(named) > 0, best)), lambda n: F.when(n == "", in_state).otherwise(F.element_at(facts, n)))


def location_facts(location) -> Column:
    """(countries, regions, cities, unresolved): what the places of a location resolve to, each once, in order; words that name no place aren't unresolved."""

    def told(placed: Column) -> Column:
        each = lambda c: F.array_distinct(F.array_compact(F.transform(placed, lambda p: p["f"][c])))
        unresolved = F.transform(F.filter(placed, lambda p: p["f"].isNull() & ~_key(p["x"]).isin(*NOT_PLACES)), lambda p: p["x"])
        return F.struct(each("country").alias("countries"), each("region").alias("regions"), each("city").alias("cities"), unresolved.alias("unresolved"))

    return let(F.transform(location_parts(location), lambda x: F.struct(x.alias("x"), resolved_place(x).alias("f"))), told)


def located(rows: DataFrame, column: str, made, name: str) -> DataFrame:
    """``rows`` with ``name``, what ``made`` makes of a location: each different one is resolved once and joined back."""
    each = rows.select(column).distinct().withColumn(name, made(column)).withColumnRenamed(column, "of")
    return rows.join(each, F.col(column).eqNullSafe(F.col("of")), "left").drop("of")


def normalized_location(text) -> Column:
    """Lower-case words of letters and digits of any alphabet, single-spaced."""
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(_col(text), F.lit(""))), F.lit(r"(?U)[\W_]+"), F.lit(" ")))


@dataclass(frozen=True)
class Gazetteer:
    """What is known of places, all normalised: cities by country, a country's own names, names of any country, names of states, further names of a search's place."""

    cities: dict[str, tuple[str, ...]]
    own: dict[str, tuple[str, ...]]
    countries: tuple[str, ...]
    states: tuple[str, ...] = tuple(s.lower() for s in STATES)
    aliases: dict[str, tuple[str, ...]] = field(default_factory=dict)


def city_in_country(location, country: str, known: Gazetteer) -> Column:
    """Whether a part of the location is a city of ``country`` and no part names another one. A state right after a city of the United States is that city's."""
    cities = known.cities.get(country, ())
    if not cities:
        return F.lit(False)
    parts = F.split(F.coalesce(_col(location), F.lit("")), r"[,;|/\n()]|\s+[-–—]\s+")
    parts = F.filter(F.transform(parts, normalized_location), lambda x: x != "")
    american = country == "united states"
    before = lambda i: F.when(i > 0, F.get(parts, i - 1).isin(*cities)).otherwise(F.lit(False))

    def other(x: Column, i: Column) -> Column:
        own = x.isin(*known.own.get(country, ()))
        if american:
            return F.when(own | (before(i) & x.isin(*known.states)), False).otherwise(x.isin(*known.countries))
        return F.when(own, False).otherwise(x.isin(*known.countries) | x.isin(*known.states))

    found = F.exists(parts, lambda x: x.isin(*cities))
    return found & ~F.exists(F.transform(parts, other), lambda x: x)


def location_matches(location, remote, place: str, known: Gazetteer) -> Column:
    """Whether a posting's location is in a search's place: remote ones by flag or word, others by a name of it in the location or by a city of it."""
    where = normalized_location(location)
    if place.strip().lower() == "remote":
        return F.coalesce(_col(remote), F.lit(False)) | F.array_contains(F.split(where, " "), "remote")
    names = [normalized_location(F.lit(n)) for n in (place, *known.aliases.get(place, ()))]
    inside = lambda n: (n != "") & F.contains(F.concat(F.lit(" "), where, F.lit(" ")), F.concat(F.lit(" "), n, F.lit(" ")))
    out = city_in_country(location, " ".join(place.lower().split()), known)
    for n in names:
        out = out | inside(n)
    return out


#: Spellings of places, and how districts are called.
PLACE_SPELLINGS = {
    "Tel Aviv": ("tel aviv yafo", "תל אביב יפו", "tel aviv", "תל אביב", "tlv"), "Ramat Gan": ("ramat gan", "רמת גן"), "Raanana": ("ra anana", "raanana", "רעננה"),
    "Herzliya": ("herzeliya", "herzliya", "הרצליה"), "Petah Tikva": ("petach tikva", "petah tikva", "פתח תקווה"), "Kfar Saba": ("kefar sava", "kfar saba", "כפר סבא"),
}
DISTRICTS = {"Center": "Central Israel", "Central": "Central Israel", "North": "northern Israel", "South": "southern Israel", "Tel Aviv": "Tel Aviv", "Haifa": "Haifa", "Jerusalem": "Jerusalem"}


def normalized_israeli_location(text) -> Column:
    """One spelling of each place; qualifiers of boards read as what they mean."""
    out = _col(text)
    for name, spellings in PLACE_SPELLINGS.items():
        for s in spellings:
            words = r"[\W_]+".join(s.split())
            out = F.regexp_replace(out, F.lit(rf"(?iUu)(?<!\w){words}(?!\w)"), F.lit(name))
    out = F.regexp_replace(out, F.lit(r"(?i)^\d+\s+Locations?,\s*(Israel)\s*$"), F.lit("$1"))
    out = F.regexp_replace(out, F.lit(r"(?i)\band across Israel\b"), F.lit("and Israel"))
    out = F.regexp_replace(out, F.lit(r"(?i)\b(Gush Dan|Tel Aviv)\s+Area\b"), F.lit("$1"))
    for name, said in DISTRICTS.items():
        out = F.regexp_replace(out, F.lit(rf"(?i)\b{name}\s+District\b"), F.lit(said))
    return out
