"""Column functions over postings. Unknown stays unknown; the order of cases is part of the meaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_inactive(liveness: str) -> Column:
    """Only a JSON boolean false is inactive: a missing, null or string value is not."""
    alive = F.try_variant_get(F.try_parse_json(liveness), "$.alive", "variant")
    return F.coalesce((F.schema_of_variant(alive) == "BOOLEAN") & ~F.try_variant_get(alive, "$", "boolean"), F.lit(False))


def is_boolean_alive(liveness: str) -> Column:
    """What ``alive`` says if it is a JSON boolean; null for anything else."""
    alive = F.try_variant_get(F.try_parse_json(liveness), "$.alive", "variant")
    return F.when(F.schema_of_variant(alive) == "BOOLEAN", F.try_variant_get(alive, "$", "boolean"))


def is_active(liveness: str) -> Column:
    return ~is_inactive(liveness)


def _has_word(text: Column, words: str) -> Column:
    return F.coalesce(text.rlike(f"(?i)(?<![A-Za-z0-9_])({words})(?![A-Za-z0-9_])"), F.lit(False))


#: Words of each level in a title, in order of precedence.
TITLE_LEVELS = (
    ("Intern", "intern|internship"), ("Junior", r"junior|jr\.?|graduate|entry[- ]level"), ("Staff", "principal|staff"),
    ("Lead", "lead|manager|head|director"), ("Senior", r"senior|sr\.?"), ("Mid", "mid[- ]level|intermediate"),
)
#: What a level's name holds, and its rank.
LEVEL_RANKS = (("intern", 0), ("junior|entry|graduate", 1), ("staff|principal", 5), ("lead|manager|director|head", 4), ("senior", 3), ("mid|intermediate", 2))


def title_level(title: str) -> Column:
    out = F.lit(None).cast("string")
    for name, words in reversed(TITLE_LEVELS):
        out = F.when(_has_word(_col(title), words), name).otherwise(out)
    return out


def level_rank(seniority: str, title: str) -> Column:
    """0 intern, 1 junior, 2 mid, 3 senior, 4 lead, 5 staff, 6 unknown."""
    value, out = F.coalesce(_col(seniority), title_level(title)), F.lit(6)
    for words, rank in reversed(LEVEL_RANKS):
        out = F.when(F.coalesce(value.rlike(f"(?i){words}"), F.lit(False)), rank).otherwise(out)
    return out


#: Normalised levels of posting facts.
FACT_LEVELS = (
    ("intern", "intern|internship"), ("junior", r"junior|jr\.?|graduate|entry(?:[- ]level)?"), ("staff_principal", "staff|principal"),
    ("lead_manager", "lead|manager|head|director"), ("senior", r"senior|sr\.?"), ("mid", "mid(?:[- ]level)?|intermediate"),
)


def fact_level(value: str) -> Column:
    out = F.lit(None).cast("string")
    for name, words in reversed(FACT_LEVELS):
        out = F.when(F.coalesce(_col(value).rlike(rf"(?i)\b(?:{words})\b"), F.lit(False)), name).otherwise(out)
    return out


#: Words for no place, and places of the groups.
NOWHERE = r"remote|hybrid|on[- ]?site|worldwide|anywhere"
ISRAEL = r"israel|tel aviv(?:-yafo)?|jerusalem|haifa|herzliya|petah tikva|ramat gan|ra['’]?anana|yavne|kfar saba|netanya|yokneam|beer sheva|be['’]?er sheva|caesarea|rehovot|hod hasharon|bnei brak"
STATES = r"united states(?: of america)?|u\.?s\.?a?\.?"
METROS = r"san francisco bay area|new york city metropolitan area|greater (?:cleveland|chicago area)|(?:austin|san antonio), texas metropolitan area|columbia, south carolina metropolitan area"
STATE_CITIES = {
    "CA": "San Francisco|Los Angeles|Cupertino|Walnut Creek|Hawthorne|Fremont|Mountain View|Sunnyvale|Calabasas", "NY": "New York|Medina|Albany|Brooklyn",
    "WA": "Seattle|Redmond|Bellevue", "TX": "Bastrop|San Antonio|Austin", "FL": "Tampa|Jacksonville|Miami", "IL": "Chicago|Deer Park|Lisle", "VA": "McLean|Reston",
    "OH": "Celina|West Chester|Dayton", "PA": "Philadelphia|Williamsport|Lititz|Linden|Wayne", "MI": "Rochester Hills|Whitehall|Troy", "WI": "Pound|Madison",
    "CO": "Denver|Colorado Springs", "MA": "Cambridge|Boston", "MN": "Maple Plain", "CT": "Greenwich", "AR": "Conway", "IN": "Fortville", "GA": "Atlanta", "NC": "Charlotte",
    "NJ": "South Plainfield", "WY": "Cheyenne", "SC": "Aiken", "TN": "Memphis", "VT": "South Burlington", "AZ": "Scottsdale", "MD": "Columbia", "DC": "Washington",
}
_WS = r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def location_group(value: str) -> Column:
    """unknown, israel, united-states or other."""
    place = F.regexp_replace(F.coalesce(_col(value), F.lit("")), F.lit(f"^{_WS}+|{_WS}+$"), F.lit(""))
    plain = rf"(?:{NOWHERE})(?:{_WS}+(?:role|position|work))?"
    nowhere = rf"(?i)^{plain}(?:(?:{_WS}*[/|,·—–\-]{_WS}*|{_WS}+or{_WS}+|{_WS}+){plain})*$"
    cities = "|".join(rf"({c}){_WS}*,{_WS}*{s}" for s, c in STATE_CITIES.items())
    states = _has_word(place, STATES) | (place.rlike(f",{_WS}*[A-Z]{{2}}$") & place.rlike(f"(?i)^({cities})$")) | place.rlike(f"(?i)^(?:{METROS})$")
    return F.when((place == "") | place.rlike(nowhere), "unknown").when(_has_word(place, ISRAEL), "israel").when(states, "united-states").otherwise("other")


def score_band(score: str) -> Column:
    """strong, more or below; null without a score."""
    return F.when(_col(score) >= 70, "strong").when(_col(score) >= 40, "more").when(_col(score).isNotNull(), "below")


def fit_tier(score: str) -> Column:
    return F.when(_col(score) >= 80, "strong").when(_col(score) >= 60, "good").when(_col(score) >= 40, "stretch").when(_col(score).isNotNull(), "weak")


def hq_eligible(location: str, remote: str) -> Column:
    """A headquarters' point may stand for the posting's: it is remote, or its location names no place."""
    word = F.lower(F.btrim(F.coalesce(_col(location), F.lit(""))))
    return F.coalesce(_col(remote), F.lit(False)) | word.isin("", "remote", "hybrid", "on-site", "onsite", "worldwide", "anywhere")


def normalized_identity(value) -> Column:
    """Lower-case words of a-z and 0-9 with single spaces."""
    return F.btrim(F.regexp_replace(F.lower(_col(value)), F.lit("[^a-z0-9]+"), F.lit(" ")))


#: Title words and what they count as.
TITLE_WORDS = {"fullstack": "full stack", "frontend": "front end", "backend": "back end", "developer": "engineer", "web": "software"}


def title_tokens(title) -> Column:
    """Distinct words of a title by which it is matched."""
    words = F.transform(F.split(normalized_identity(title), " "), lambda x: F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in TITLE_WORDS.items() for v in kv]), x), x))
    joined = F.replace(F.array_join(words, " "), F.lit("machine learning"), F.lit("ai"))
    return F.array_distinct(F.filter(F.split(joined, " "), lambda x: x != ""))


def job_link_url(apply_url: str, url: str) -> Column:
    """A Markdown job address of the one board that has such as its page's address."""
    given = F.coalesce(F.nullif(_col(apply_url), F.lit("")), _col(url))
    return F.regexp_replace(given, F.lit(r"(?i)^(https?://apply[.]workable[.]com(?::[0-9]+)?)/([^/?#]+)/jobs/view/([a-z0-9]+)[.]md([?#].*)?$"), F.lit("$1/$2/j/$3/$4"))


def link_status(url: str) -> Column:
    """no_link, available (http or https with a host, without user or white space) or invalid_url."""
    x = _col(url)
    good = x.rlike(r"^(?i:https?)://[^/?#@\s]+([/?#]\S*)?$") & ~x.rlike(r"^(?i:https?)://:") & ~x.rlike(r"^(?i:https?)://[^/?#]*:[^/?#\d]")
    return F.when(x.isNull() | (x == ""), "no_link").when(good, "available").otherwise("invalid_url")


#: Years that lower a score.
YEAR_BANDS = ((10, "10+ years", -12), (8, "8-9+ years", -10), (6, "6+ years (stretch)", -7), (5, "5+ years", -4))


def years_band(highest: str) -> Column:
    """Label and weight of the highest stated minimum of years; null below the least band."""
    out = F.lit(None).cast("struct<label:string,weight:int>")
    for least, label, weight in reversed(YEAR_BANDS):
        out = F.when(_col(highest) >= least, F.struct(F.lit(label).alias("label"), F.lit(weight).alias("weight"))).otherwise(out)
    return out


def visible_text(html: str) -> Column:
    """Text of a page: without scripts, styles and tags, common entities read, white space collapsed."""
    text = F.regexp_replace(_col(html), F.lit(r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>"), F.lit(" "))
    text = F.regexp_replace(text, F.lit(r"(?s)<[^>]*>"), F.lit(" "))
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.btrim(F.regexp_replace(text, F.lit(r"\s+"), F.lit(" ")))
