"""Places in text: names of countries, cities and regions with what they mean to a search from Israel.

Names are words of a trie, so a place is the longest name that begins at a
word. Countries come from the JVM's own ISO tables, in English and Hebrew.
"""

from __future__ import annotations

import re
from functools import cache
from itertools import islice

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


#: Cities by country.
CITIES = {
    "israel": (
        "Tel Aviv", "Tel Aviv-Yafo", "TLV", "Tel-Aviv-Yafo", "Herzliya", "Herzeliya", "Ramat Gan", "Ramat-Gan", "Petah Tikva", "Petach Tikva", "Haifa", "Jerusalem", "Ra'anana", "Raanana", "Modiin", "Modi'in",
        "Hod Hasharon", "Netanya", "Rehovot", "Kfar Saba", "Kefar Sava", "Holon", "Rishon", "Rishon LeZion", "Rishon Le Zion", "Ramat HaSharon", "Lod", "Rosh HaAyin", "Nes Ziona", "Bnei Brak", "Yehud Monosson",
        "Beer Yaakov", "Be'er Sheva", "Yokneam", "תל אביב", "תל אביב-יפו", "הרצליה", "רמת גן", "פתח תקווה", "חיפה", "ירושלים", "רעננה", "מודיעין", "הוד השרון", "נתניה", "רחובות", "כפר סבא", "חולון", "ראשון לציון",
        "באר שבע", "יקנעם",
    ),
    "united states": ("San Francisco", "New York", "New York City", "Austin", "NYC", "SF"), "germany": ("Berlin",), "united kingdom": ("London", "לונדון"), "canada": ("Toronto",),
}
#: The countries' own names.
OWN_NAMES = {
    "israel": ("israel", "il", "isr"), "germany": ("germany", "de", "deu"), "united kingdom": ("united kingdom", "uk", "gb", "gbr"), "canada": ("canada", "ca", "can"),
    "united states": ("united states", "united states of america", "us", "usa", "u s", "u s a"),
}
#: What a place means.
NONCENTRAL = ("Sasa", "Kibbutz Sasa", "Galilee", "Upper Galilee", "Haifa", "Jerusalem", "Be'er Sheva", "Yokneam", "northern Israel", "southern Israel", "סאסא", "גליל", "חיפה", "ירושלים", "באר שבע", "יקנעם", "צפון", "דרום")
HOME = ("Israel", "State of Israel", "IL", "ISR", "ישראל", "Central Israel", "Gush Dan", "מרכז ישראל", "גוש דן")
FOREIGN = (
    "United States", "U.S.", "U.S.A.", "US", "USA", "Continental United States", "ארצות הברית", "ארה״ב", 'ארה"ב', "ארהב", "קנדה", "בריטניה", "אירופה", "Europe", "European Union", "EU", "UK", "New Jersey",
    "האיחוד האירופי", "איחוד האירופי", "אמריקה הלטינית", "אסיה", "Russian Federation", "Viet Nam", "Republic of Korea", "South Korea", "Czech Republic", "Türkiye", "Turkey",
)
UNCERTAIN = ("EMEA", "APAC", "EST", "PST")
WORLDWIDE = ("worldwide", "globally", "global", "anywhere in the world", "all countries")
#: Places that only descriptions name.
IN_PROSE = (
    "Warsaw", "ורשה", "וורשה", "Berlin", "ברלין", "Munich", "München", "מינכן", "Paris", "פריז", "Lyon", "Lisbon", "Dublin", "Zurich", "San Diego", "Rio de Janeiro", "São Paulo", "California", "DACH", "LATAM",
    "New South Wales", "ניו יורק", "ניו יורק סיטי", "מרכז אמריקה", "דרום אמריקה", "מזרח הרחוק",
)
#: States of the United States.
STATE_NAMES = (
    "Alabama|Alaska|Arizona|Arkansas|California|Colorado|Connecticut|Delaware|Florida|Georgia|Hawaii|Idaho|Illinois|Indiana|Iowa|Kansas|Kentucky|Louisiana|Maine|Maryland|Massachusetts|Michigan|Minnesota|Mississippi|"
    "Missouri|Montana|Nebraska|Nevada|New Hampshire|New Jersey|New Mexico|New York|North Carolina|North Dakota|Ohio|Oklahoma|Oregon|Pennsylvania|Rhode Island|South Carolina|South Dakota|Tennessee|Texas|Utah|Vermont|"
    "Virginia|Washington|West Virginia|Wisconsin|Wyoming|District of Columbia"
).split("|")
#: Words that make prose speak of places, and codes that are words of the trade.
CONTEXT = re.compile(
    r"\b(?:remote|reside|residents?|residence|residency|relocat\w*|located (?:in|within)|based (?:in|worldwide)|office|on[ -]?site|citizens?(?:hip)?|passport|work authorization|eligible to work|time[ -]?zone|country|"
    r"countries|jurisdiction|location|(?:candidates?|applicants?) (?:in|from))\b|(?<!\w)(?:מגורים|תושבי\w*|להתגורר|לגור|מרחוק|בישראל|אזרחות|[במ]?מדינ\w*|[במ]?אזור זמן)(?!\w)",
    re.I,
)
TRADE_CODES = ("ai", "ml", "sc", "it", "ci", "cd")
_APPLIES = re.compile(r"(?:\s+|[ -]based\s+)(?:candidates?|applicants?|residents?|citizens?|work\s+(?:permits?|authorization))\b", re.I)
_TOWARDS = re.compile(r"\b(?:in|from|within|across|to)\s+(?:the\s+)?$", re.I)
_WORD, _GAP = re.compile(r"[^\W_]+"), re.compile(r"[\W_]+")
HEBREW_PREFIX, HEBREW = "בלמוהש", re.compile("[א-ת]")
#: Time zones, which stand in lists; words on a side of a code that tell shouting, and within how many characters they are looked for.
ZONE, SHOUT_WORDS, SHOUT_REACH = re.compile("[PECM][SD]?T|[ECW]EST|WET|GMT|UTC|JST"), 5, 200
#: Names that a broadcast vocabulary may have.
MOST_NAMES = 100_000


def folded(text: str) -> str:
    """Words of letters and digits in lower case, one space between two."""
    return " ".join(_GAP.sub(" ", text.casefold()).split())


def words_of(text: str) -> list[str]:
    """Words in lower case."""
    return _WORD.findall(text.casefold())


@cache
def iso_countries() -> tuple[tuple[str, ...], ...]:
    """(names and codes in English, name in Hebrew) of each country, as the JVM of the session knows them."""
    locale = SparkSession.active().sparkContext._jvm.java.util.Locale
    english, hebrew = locale("en"), locale("he")
    countries = [(code, locale("", code)) for code in locale.getISOCountries()]
    return tuple((code, x.getISO3Country(), x.getDisplayCountry(english), x.getDisplayCountry(hebrew)) for code, x in countries)


class Places:
    """Names with their kinds: israel, noncentral, foreign, uncertain, worldwide."""

    def __init__(self, kinds: dict[str, str], codes: frozenset[str], prose: frozenset[str]):
        if len(kinds) > MOST_NAMES:
            raise ValueError("too many places to send to every task")
        self.kinds, self.codes = kinds, codes
        self.trie: dict = {}
        for names, only_prose in ((kinds, False), (prose, True)):
            for name in names:
                node = self.trie
                for word in name.split():
                    node = node.setdefault(word, {})
                if not only_prose or None not in node:
                    node[None] = (name, "foreign" if only_prose else kinds[name], only_prose)

        #: Words that names begin with; codes only in capitals.
        self.first = frozenset(n.split()[0] for n in (*kinds, *prose) if not self._in_capitals(n))
        self.capitals = frozenset(n.upper() for n in kinds if self._in_capitals(n))

    @classmethod
    def known(cls, countries: tuple[tuple[str, ...], ...]) -> Places:
        names = [n for own in countries for n in own if n]
        kinds = dict.fromkeys(map(folded, names), "foreign") | dict.fromkeys(map(folded, FOREIGN), "foreign")
        kinds |= {folded(c): "israel" if country == "israel" else "foreign" for country, cities in CITIES.items() for c in cities}
        for own, kind in ((NONCENTRAL, "noncentral"), (HOME, "israel"), (UNCERTAIN, "uncertain"), (WORLDWIDE, "worldwide")):
            kinds |= dict.fromkeys(map(folded, own), kind)
        codes = frozenset(folded(n) for own in countries for n in own[:2])
        prose = frozenset(map(folded, IN_PROSE)) | {folded(s) for s in STATE_NAMES}
        return cls({k: v for k, v in kinds.items() if k}, codes, prose)

    def _in_capitals(self, name: str) -> bool:
        return len(name) <= 3 and name in self.codes and name not in ("us", "uk", "eu")

    def at(self, text: str, start: int, prose: bool = False) -> tuple[str, int] | None:
        """Kind and end of the longest name that begins at ``start``; short codes count in capitals."""
        node, best, at = self.trie, None, start
        while word := _WORD.match(text, at):
            node = node.get(word.group().casefold())
            if node is None:
                break
            if None in node and (prose or not node[None][2]) and text[word.end() : word.end() + 1] != "_":
                best = node[None], word.end()
            gap = _GAP.match(text, word.end())
            if not gap:
                break
            at = gap.end()
        if not best:
            return None
        (name, kind, _), end = best
        if self._in_capitals(name) and not text[start:end].isupper():
            return None
        return kind, end + (name in ("u s", "u s a") and text[end : end + 1] == ".")

    def behind_prefix(self, text: str, start: int, prose: bool = False) -> tuple[str, int, int] | None:
        """Kind, begin and end of a name at ``start`` or after up to three letters that Hebrew puts before a name."""
        for skip in range(4):
            if skip and text[start + skip - 1 : start + skip] not in tuple(HEBREW_PREFIX):
                return None
            if found := self.at(text, start + skip, prose):
                return found[0], start + skip, found[1]
        return None

    def mentions(self, text: str, words: frozenset[str] = frozenset()) -> bool:
        """Whether a text has a word that begins a name, is one of ``words``, or has a letter that Hebrew puts before a name."""
        said = words_of(text)
        return not (self.first.isdisjoint(said) and words.isdisjoint(said) and self.capitals.isdisjoint(_WORD.findall(text))) or bool(HEBREW.search(text))

    def all(self, text: str, prose: bool = True) -> list[tuple[int, int, str]]:
        """(start, end, kind) of the names in a text, from left to right, none within another."""
        out, free = [], 0
        if not self.mentions(text):
            return out
        for word in _WORD.finditer(text):
            begins = word.group().casefold() in self.first or word.group() in self.capitals or word.group()[0] in HEBREW_PREFIX
            if begins and word.start() >= free and (found := self.behind_prefix(text, word.start(), prose)):
                kind, start, free = found
                out.append((start, free, kind))
        return out

    def speaks_of_places(self, text: str) -> bool:
        """Whether prose means places: a word that says so, or a name that isn't a word of the trade as well."""
        return bool(CONTEXT.search(text)) or any(self._meant(text, *found) for found in self.all(text, prose=False))

    def _shouted(self, text: str, start: int, end: int) -> bool:
        """Whether a code stands where all words are in capitals, which then tell no code from a word: those before or after it, some of them no codes."""
        before = (m[0][::-1] for m in _WORD.finditer(text[max(0, start - SHOUT_REACH) : start][::-1]))
        after = (m[0] for m in _WORD.finditer(text[end : end + SHOUT_REACH]))
        for side in (before, after):
            near = list(islice((w for w in side if w.isalpha() and not ZONE.fullmatch(w)), SHOUT_WORDS))
            if len(near) > 1 and all(w.isupper() for w in near) and any(w not in self.capitals for w in near):
                return True
        return False

    def _meant(self, text: str, start: int, end: int, kind: str) -> bool:
        said, name = text[start:end], folded(text[start:end])
        if kind == "worldwide":
            return False
        if said.isupper() and _APPLIES.match(text, end):
            return True
        if name in TRADE_CODES:
            return False
        if kind == "uncertain" and self._in_capitals(name):
            return not self._shouted(text, start, end)
        if len(name) > 3 or not name.isascii() or kind == "uncertain":
            return True
        return bool(_TOWARDS.search(text[:start])) and (name != "us" or said.isupper())


def known_places() -> Places:
    return Places.known(iso_countries())


_FOUND = "array<struct<start:int,end:int,kind:string,name:string>>"


def places_in(text, known: Places | None = None) -> Column:
    """The places that a text names: (start, end, kind, name), the longest at each word. Texts and places must differ in words alone, so each different text costs once."""
    places = SparkSession.active().sparkContext.broadcast(known or known_places())

    def found(texts: pd.Series) -> pd.Series:
        of = lambda t: [{"start": a, "end": b, "kind": k, "name": folded(t[a:b])} for a, b, k in places.value.all(t)] if t else []
        return texts.map(of)

    return F.pandas_udf(found, _FOUND)(F.col(text) if isinstance(text, str) else text)


def speaks_of_places(text, known: Places | None = None) -> Column:
    """Whether a text means places, beyond words that are codes of countries too."""
    places = SparkSession.active().sparkContext.broadcast(known or known_places())
    told = lambda texts: texts.map(lambda t: bool(t) and places.value.speaks_of_places(t))

    def found(texts: pd.Series) -> pd.Series:
        return told(texts)

    return F.pandas_udf(found, "boolean")(F.col(text) if isinstance(text, str) else text)


