"""What a description says of who hires: names with their places in the text, and what speaks against a name."""

from __future__ import annotations

import re
from functools import cache

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .gazetteer import CITIES, folded, iso_countries

_I = re.IGNORECASE
#: How a hiring company is named.
NAME = r"(?P<name>[A-Z][\w·&.,’'() \t-]{0,78}?)"
BEHALF = r"^(?:Recruiting |Hiring |We are recruiting )?on behalf of\s+\*{0,2}" + NAME + r"\*{0,2}(?=\s+(?:for|is|are|we)\b|[,:;\n]|$)"
CLIENT = r"^(?:Our|our) client[,:]?\s+\*{0,2}" + NAME + r"\*{0,2}(?=\s+(?:is|are|has|seeks)\b|[,;\n]|$)"
HIRES = r"^\*{0,2}" + NAME + r"\*{0,2}(?: in [A-Z][\w ,.-]{0,60}?)?\s+(?:is (?:the employer|hiring|looking for|seeking)|are hiring)\b[^\n]*"
ABOUT = r"^\*{0,2}About (?:[Tt]he )?[Cc]ompany\*{0,2}\s*\n+\*{0,2}" + NAME + r"\*{0,2}\s+(?:is|provides|develops|builds|היא|הינה)\b[^\n]*"
SUBJECT = r"^\*{0,2}" + NAME.replace("[A-Z]", "[A-Zא-ת]") + r"\*{0,2}\s+(?:is (?:hiring|looking for|seeking)|are hiring|מגייס(?:ת|ים|ות)?|מחפש(?:ת|ים|ות)?)\b"
ROLE_HEADING = r"^\*{0,2}About (?:[Tt]he )?[Rr]ole\*{0,2}"
#: Subjects that are no company.
GENERIC = (
    "i", "we", "our", "you", "they", "he", "she", "it", "company", "agency", "firm", "recruiter", "business", "organization", "team", "client", "publisher", "employer", "the company", "this company", "the client", "a company",
    "אני", "אנחנו", "אנו",
)
ORGANISATION_WORDS = frozenset(
    "data platform r d group hiring manager customer success engineering team department business unit networking ai role position remote fintech startup your next challenge idf veterans applicants in senior backend frontend "
    "engineer research development and of the צוות קבוצת קבוצה מחלקת מחלקה פלטפורמת פלטפורמה נתונים מחקר ופיתוח פיתוח מנהל מנהלת גיוס הצלחת לקוחות הנדסה תפקיד משרה מרחוק".split()
)
UNITS = frozenset("team teams department dept division unit squad crew chapter guild org organization function office desk".split())
HEBREW_UNIT = r"[הובלמש]*(?:צוות|מחלקה|מחלקת|אגף|יחידה|יחידת|קבוצת|דסק)"
#: Words of a third party, and of a staffing business.
THIRD_PARTY = (
    r"\bour client\b[^.\n!?]{0,100}\b(?:hiring|seeking|looking for|seeks)\b|\b(?:hiring|recruiting)\b[^.\n!?]{0,80}\bfor our clients?\b|\b(?:hiring|seeking|looking for|recruiting)\b[^.\n!?]{0,80}\bfor one of our clients\b|"
    r"\b(?:direct employment|directly hiring) with our client\b|\ba client of ours\b|\bon behalf of (?:our|an?|one of our) (?:[\w,-]+ ){0,8}clients?\b|\bon behalf of an? partner (?:company|organization|firm)\b|"
    r"(?:הלקוח שלנו|לקוח שלנו)\s+(?:מגייס|מחפש)|(?:עבור|מטעם)\s+(?:הלקוח שלנו|לקוח שלנו|אחד מלקוחותינו)"
)
STAFFING = (
    r"\b(?:is|are) (?:an?|the) (?:(?:leading|global|international|specialist|specialized) ){0,3}(?:staffing|recruiting|recruitment|talent(?: acquisition)?|placement) (?:agency|firm|company|consultancy)\b"
)
SERVICES = (
    STAFFING + r"(?=\s*(?:[.,;!?]|$)|\s+(?:that|which|specializing|connecting|helping)\b)|\b(?:is|are) a recruitment partner of this role\b|\b(?:provider of|provid(?:e|es|ing)) "
    r"(?:staffing|recruiting|recruitment|talent(?: acquisition)?|(?:permanent )?placement)(?: and (?:staffing|recruiting|recruitment))? services\b|\b(?:provider of|provid(?:e|es|ing)) (?:innovative )?staffing solutions\b|"
    r"(?:היא |הינה )?חברת (?:השמה|גיוס)\b(?=\s*(?:[.,;!?]|$)|\s+(?:אשר|המתמחה|מתמחה|המחברת|מחברת|המסייעת|מסייעת|שמתמחה|שמחברת|שמסייעת|שעוזרת)\b)"
)
DESCRIBED = STAFFING + r"(?=\s|[.,;!?]|$)|" + SERVICES + r"|(?:היא |הינה )?חברת (?:השמה|גיוס)\b(?=\s|[.,;!?]|$)"
PRODUCT, PLACING = r"\b(?:software|platform|tool|saas|app|product)s?\b", r"\b(?:clients?|candidates?|placement|placing|connecting (?:talented )?professionals)\b"
#: Other speakers, and parts of a posting.
QUOTED = r'"[^"]*"|“[^”]*”|«[^»]*»|(?<!\w)\'[^\']*\'(?!\w)'
ATTRIBUTED = (
    r"(?i:\b(?:says|said|testimonials?)\b|\breviews?(?:\s*:|\s+(?:by|from)\b)|\b(?:a|this|the) review\b|\b\w+[’']s review\b)|[—–][ \t]+[^\W\d_][\w’'-]*(?:[ \t]+[^\W\d_][\w’'-]*){0,3},[ \t]+"
    r"(?i:head|director|ceo|cto|vp|manager|recruiter|founder|engineer|talent|מנהלת?|מגייסת?)\b[^.\n]{0,80}\s*$|"
    r"[—–][ \t]+(?!(?i:remote|hybrid|on[- ]?site|full[- ]?time|part[- ]?time)\b)[A-Z][\w’'-]*(?:[ \t]+[A-Z][\w’'-]*){0,3}[.!]?\s*$"
)
TESTIMONIALS = r"^(?:(?:customer )?testimonials?|(?:customer )?reviews?|what our customers say|ממליצים|המלצות)(?:\s*:\s*.*|\s*)$"
SECTION = r"^(?:about|responsibilities|requirements|qualifications|benefits|job (?:description|details|requirements|responsibilities)|אודות)\b"
OF_CUSTOMERS = r"\b(?:testimonials?|reviews?|customers?|stories)\b|ממליצים|המלצות"
JOB_HEADING = r"^(?:about (?:the )?role|job description|the position|responsibilities|תיאור המשרה|על התפקיד)\s*:?$"
QUOTE_MARKS, SIGNATURE = "['\"‘’“”«»„‟‚‛״׳‹›`❛❜❝❞]", r"\s[—–-]\s+[^\W\d_][\w’'-]*(?:[ \t]+[^\W\d_][\w’'-]*)*(?:,[^\r\n]*)?[.!]?\s*$"
PREDICATE = r"\b(?:is|are|we|provides|builds|hiring|seeking)\b|מגייס|מחפש"
#: Lines and characters that open a posting; characters of evidence.
OPENING_LINES, OPENING, EVIDENCE = 32, 2000, 2000

_FRAMES = [re.compile(p, re.M) for p in (BEHALF, CLIENT, HIRES, ABOUT)]
_DESCRIBED, _SERVICES, _PRODUCT = re.compile(DESCRIBED, _I), re.compile(SERVICES, _I), re.compile(PRODUCT, _I)


#: What a text must hold for others to speak in it, for a staffing business and for a third party.
_OTHERS_SPEAK = re.compile(r"""["“«'>—–]|says|said|testimonial|review|what our customers say|ממליצים|המלצות""", _I)
_STAFFS, _THIRD, _THIRD_PARTY = re.compile("staffing|recruit|talent|placement|השמה|גיוס", _I), re.compile("client|partner|לקוח", _I), re.compile(THIRD_PARTY, _I)


def _blank(text: str) -> str:
    return re.sub(r"[^\r\n]", " ", text)


def _lines(text: str) -> list[tuple[int, str]]:
    out, at = [], 0
    for line in text.splitlines(keepends=True):
        out.append((at, line))
        at += len(line)
    return out


def attributable(text: str) -> str:
    """The text with what others say blanked: quotes, testimonials, signed lines. No character moves."""
    if not _OTHERS_SPEAK.search(text):
        return text
    unquoted, out, testimonials = re.sub(QUOTED, lambda m: _blank(m[0]), text), [], False
    for at, line in _lines(text):
        title = line.strip().strip("#* ").strip()
        if re.fullmatch(TESTIMONIALS, title, _I):
            testimonials = True
        elif re.match(SECTION, title, _I) and not re.search(OF_CUSTOMERS, title, _I):
            testimonials = False
        others = testimonials or line.lstrip().startswith(">") or re.search(ATTRIBUTED, line)
        out.append(_blank(line) if others else unquoted[at : at + len(line)])
    return "".join(out)


def own_voice(text: str, said: str) -> str:
    """Of an attributable text, the first paragraph and those that open a part about the job; the rest is blanked."""
    out, open_, begun = [], True, False
    for at, line in _lines(text):
        plain = line.strip()
        title = plain.strip("#* _").strip()
        is_job = bool(re.fullmatch(JOB_HEADING, title, _I))
        speaks = re.search(PREDICATE, title, _I)
        marked = re.fullmatch(r"(?:\*\*|__|\*|_)(.+?)(?:\*\*|__|\*|_)", plain) or re.fullmatch(r"[\w &:/()–—-]+", title)
        keep = False
        if is_job or plain.startswith("#") or (marked and not speaks):
            open_, begun = is_job, False
        elif plain:
            begun = True
            keep = open_ and not re.search(QUOTE_MARKS, line) and not re.search(SIGNATURE, line)
        elif begun:
            open_ = False
        out.append(said[at : at + len(line)] if keep else _blank(said[at : at + len(line)]))
    return "".join(out)


def is_unit(name: str, places: frozenset[str]) -> bool:
    """Whether a name is a place, a unit of a company, or words of one, rather than a company."""
    whole = folded(name)
    words = whole.split()
    if not words or whole in places or set(words) <= ORGANISATION_WORDS or words[-1] in UNITS or re.fullmatch(HEBREW_UNIT, words[0]):
        return True
    return any(" ".join(words[k:]) in places and set(words[:k]) <= ORGANISATION_WORDS for k in range(1, len(words)))


def places_staff(text: str, company: str, whole: bool = True) -> bool:
    """Whether a text says of a company, by name, that it is a staffing business. ``whole``: the statement must be complete."""
    for clause in re.split(r"[.;!?]\s+|\n+", text) if _STAFFS.search(text) else ():
        if not _STAFFS.search(clause):
            continue
        for m in (_SERVICES if whole else _DESCRIBED).finditer(clause):
            subject = re.sub(r"\s+(?:is|are)\s+(?:(?:an?|the|leading|global|international|specialist|specialized)\s*)*$", "", clause[: m.start()].strip(" *\t"), flags=_I)
            product = _PRODUCT.search(clause[: m.start()]) or re.match(rf"\s*{PRODUCT}", clause[m.end() :], _I)
            solutions = "staffing solutions" in m[0].casefold() and not re.search(PLACING, clause, _I)
            if subject.casefold() == company.casefold() and subject.casefold() not in GENERIC and not product and not solutions:
                return True
    return False


FOUND = "struct<names:array<struct<name:string,evidence:string,blurb:boolean,barred:boolean>>,vague:boolean,client:boolean,agency:string,agency_in_role:boolean,describes_publisher:boolean>"


def names_of(publisher: str | None, text: str | None, places: frozenset[str]) -> dict:
    """What a description says of employers: names by frame, vague subjects, words of a client, and the publisher's own staffing statement.

    A name is ``barred`` if it is an intermediary by the text's own words; ``blurb`` if it stands in a company's description rather than with the role.
    """
    publisher, text = publisher or "", text or ""
    said = attributable(text)
    voice, opening = cache(lambda: own_voice(text, said)), "".join(line for _, line in _lines(said)[:OPENING_LINES])[:OPENING]
    quote = lambda a, b: text[a : min(b, a + EVIDENCE)]
    role = re.search(ROLE_HEADING, opening, re.M)
    about = {m["name"].strip(" .,").casefold() for m in _FRAMES[3].finditer(opening) if places_staff(m[0], m["name"].strip(" .,"), whole=False)}
    agency = next((m for m in re.finditer(r"[^\n]+", said) if places_staff(m[0], publisher)), None) if _STAFFS.search(said) else None
    describes = places_staff(said, publisher, whole=False)
    vague = any(is_unit(m["name"], places) for m in re.finditer(SUBJECT, opening, re.M))
    names = []
    for k, frame in enumerate(_FRAMES):
        for m in frame.finditer(opening):
            name = m["name"].strip(" .,")
            own = name[len(publisher) :] if publisher and name.casefold().startswith(publisher.casefold()) else None
            if (k < 2 and not voice()[m.start() : m.end()].strip()) or not name:
                continue
            if k == 2 and is_unit(name, places):
                vague = True
                continue
            small = any(w[0].islower() and w not in ("of", "the", "and") for w in name.split())
            if name.casefold().startswith(("our ", "we ", "the ", "this ", "an ", "a ")) or name.casefold() in GENERIC or small:
                continue
            barred = name.casefold() in about or (describes and name.casefold() == publisher.casefold()) or (k >= 2 and bool(_THIRD_PARTY.search(m[0])))
            if not barred and own is not None and (not own or re.match(r"['’]s(?:\s|$)", own) or (re.match(r"\W", own) and is_unit(own.strip(" ()"), places))):
                name = publisher
            names.append({"name": name, "evidence": quote(*m.span()), "blurb": k == 3 or (k == 2 and role is not None and m.start() < role.start()), "barred": barred})
    return {
        "names": names, "vague": vague, "client": bool(_THIRD.search(text) and _THIRD_PARTY.search(text)), "agency": quote(*agency.span()) if agency else None,
        "agency_in_role": bool(agency and role and agency.start() > role.start()), "describes_publisher": describes,
    }


def place_names() -> frozenset[str]:
    """Folded names and codes of countries, and the known cities."""
    return frozenset(folded(n) for own in iso_countries() for n in own[:3]) | {folded(c) for cities in CITIES.values() for c in cities} | {"ישראל"}


def employers_named(publisher, text) -> Column:
    """``names_of`` as a column."""
    places = SparkSession.active().sparkContext.broadcast(place_names())

    def found(publishers: pd.Series, texts: pd.Series) -> pd.DataFrame:
        clean = lambda x: None if pd.isna(x) else x
        return pd.DataFrame([names_of(clean(p), clean(t), places.value) for p, t in zip(publishers, texts)])

    return F.pandas_udf(found, FOUND)(*[F.col(c) if isinstance(c, str) else c for c in (publisher, text)])
