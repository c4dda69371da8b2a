"""Years of experience that a description asks for: the quote of its minimum, and single requirements by subject.

``experience_phrase`` reads a table of patterns. A text is masked without moving
its characters, cut into clauses, and each clause goes through ordered checks:
one may pass over the clause, give up the text, or let the clause offer its
minimum. Offers of higher rank win; equal ranks must agree.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from enum import Enum
from functools import cached_property

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .gate import holds

_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()
#: The grammar. NUM is a number of up to two digits or a word, JOINS what stands between the ends of a range.
NUM = "(?:[0-9]{1,2}|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty)"
_ALONE = rf"(?<![A-Za-z0-9_]){NUM}(?![A-Za-z0-9_])"
_RANGE = rf"{NUM}(?:[ \t]*(?:[-–—]|to)[ \t]*{NUM})?[ \t]*\+?(?:[ \t]+or more)?"
_AT_LEAST = r"(?<![A-Za-z0-9_.])(?:(?:at least|minimum(?:[ \t]+of)?|over)[ \t]+)?"
TENURE = r"\b(?:years?|yrs?|yoe|y/o/e|decades?)\b|(?:שנות|שנים|שנה|שנתיים|עשור)"
LEAD = rf"{_AT_LEAST}{_RANGE}[ \t]+(?:overall[ \t]+)?years?\b(?:[ \t]+or more)?"
TAILS = (
    r"(?:(?:[ \t]+of)?(?:[ \t]+(?:[a-z][\w+/-]*,?|/)){0,7}?[ \t]+experience\b|[’'][ \t]*experience\b)",
    r"[ \t]+(?:in|with)[ \t]+[a-z][\w+/-]*(?:[ \t]+[a-z][\w+/-]*){0,2}",
    r"(?:[ \t]+of)?[ \t]+(?:(?:professional|hands-on)[ \t]+){0,2}(?:(?:backend|frontend|full[- ]stack|software|platform|infrastructure|devops|data|hardware)[ \t]+)?(?:engineering|development)\b",
    r"[ \t]+(?:developing|building|working|operating|maintaining|leading|managing|designing)\b",
    r"[ \t]+as[ \t]+(?:a[ \t]+)?(?:[a-z-]+[ \t]+){0,2}(?:engineer|developer)\b",
    r"(?:[ \t]+of)?[ \t]+(?:hands-on[ \t]+)?programming\b",
)
HEBREW = (
    r"(?<![A-Za-z0-9_.א-ת])(?:(?:לפחות|מינימום(?: של)?)[ \t]+)?[0-9]{1,2}(?:[ \t]*(?:[-–—]|עד)[ \t]*[0-9]{1,2})?\+?[ \t]+שנות[ \t]+נ[י]?סיון(?![א-ת])",
    r"(?<![A-Za-z0-9_.א-ת])נ[י]?סיון[ \t]+של[ \t]+(?:לפחות[ \t]+)?[0-9]{1,2}(?:[ \t]*(?:[-–—]|עד)[ \t]*[0-9]{1,2})?\+?[ \t]+שנים(?![א-ת])",
    r"(?<![A-Za-z0-9_.א-ת])(?:נ[י]?סיון[ ]+של[ ]+)?בין[ ]+[0-9]{1,2}[ ]+ל[- ]?[0-9]{1,2}[ ]+(?:שנים|שנות[ ]+נ[י]?סיון)(?![א-ת])",
)
SIMPLE = (
    rf"{_AT_LEAST}{_RANGE}[ \t]+(?:yrs?|yoe)\b(?:[ \t]+exp\b)?",
    r"(?<![A-Za-z0-9_.])a[ \t]+decade\b(?:[ \t]+of[ \t]+experience\b)?",
    r"(?<![A-Za-z0-9_.א-ת])עשור(?![א-ת])(?:[ \t]+(?:של[ \t]+)?נ[י]?סיון(?![א-ת]))?",
    r"(?<![A-Za-z0-9_.א-ת])[0-9]{1,2}\+?[ \t]+שנים[ \t]+ומעלה(?![א-ת])",
)
FRAME = "|".join([LEAD + t for t in TAILS] + list(HEBREW) + list(SIMPLE))
SPACES = " \t\x0b\x0c\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000\ufeff"
LINES = "\n\r\u2028\u2029"
#: With what each mask needs besides, where that is found faster.
MASKS = (
    (r"^[ ]*[-*•●▪◦‣–—]+[ ]*", ""), (r"[.!?;,\n][ .!?;,\n]*(?=(?:or\b|או(?: |$)))", r"[.!?;,\n ](?:or|או)"), (r"(?<=\bor|או)[ ]*\n[ ]*", r"(?:or|או)[ ]*\n"), (r"(?<=\bexp)\.", r"exp\."),
)
JOINED = rf"(?:(?<=[0-9+])|{'|'.join(f'(?<={w})' for w in _WORDS[1:])})[ ]*\n[ ]*(?=\+?[ ]*(?:years?|yrs?|yoe|y/o/e)\b|שנות|שנים|שנה)"
JOINED_NEEDS = r"\n[ ]*\+?[ ]*(?:y|שנ)"
HEADINGS = r"^[ \t]*(?:#{1,6}[ \t]+([^\n]+)|([^\n:]+))[ \t]*:?[ \t*]*$|(what we need to see|ways to stand out from a crowd|your expertise|basic qualifications):?"
_ASKS = (
    "required|requirements?|qualifications?|minimum qualifications?|what (?:we(?:'|’)re looking for|you bring|you(?:'|’)ll need|it takes)|you bring|your (?:experience|expertise)|skills?\\s*(?:&|and)\\s*experience|"
    "who (?:you are|are you)|all about you|what we value|what we need to see|דרישות(?: התפקיד)?|מה אנחנו מחפשים\\??"
)
REQUIRED_HEADING = rf"^(?:must[ -]haves?|(?:basic|required) qualifications?|{_ASKS})$"
INLINE_HEADING = rf"^[ ]*(?:(?:must[ -]haves?|required qualifications?|{_ASKS}))[ ]*:"
OTHER_HEADING = r"^(?:about(?: the)? company|about us|company|responsibilities|what you(?:'|’)ll do|the role|benefits|what we offer|compensation|ways to stand out from a crowd)$"
REJECT = (
    r"\b(?:no|not|without|ideally|preferably|wish|would|nice to have|up to|around|approximately|preferred|optional|desirable|bonus|advantage|a plus)\b|"
    r"(?:^|[^א-ת])(?:לא|ללא|עד|יתרון|אינן חובה|אינו חובה|אין חובה)(?![א-ת])|\bencouraged to apply\b"
)
OPTIONAL = (
    r"\b(?:prefer(?:red|ably)?|optional|nice[ -]to[ -]have|bonus|advantages?|desirable|helpful|useful|a plus)\b|(?:^|[^א-ת])(?:יתרונות|יתרון|רשות|אינן חובה|אינו חובה|אין חובה)(?![א-ת])"
)
COMPLEX = (
    r"\b(?:equivalent|in lieu)\b|\bor[ ]+(?:(?:a|an|the)[ ]+)?(?:relevant[ ]+)?(?:degree|diploma|doctorate|masters?|bachelors?)\b|(?:^|[^א-ת])או[ ]+תואר|\bplus[ ]+(?:[a-z-]+[ ]+){0,4}(?:work|experience)\b"
)
NUMBERED = rf"^[ ]*(?:\(?[0-9]+[.):]|\(?[A-Za-z][.):])[ ]+[^\n]*(?:{TENURE})"
FRACTION = rf"[0-9]+\.[0-9]+[^.!?;\n]*(?:{TENURE})"
REQUIRED_CONTEXT = (
    r"\b(?:you (?:need|have|bring)|we (?:require|seek)|looking for|seeking|must(?: have)?|required|requirements?|qualifications?|minimum|all about you|your (?:experience|expertise)|what you bring|"
    r"what you(?:'|’)ll need|at least)\b|נדרש|דרישות|לפחות|מינימום"
)
DOMAIN = (
    r"\b(?:software|engineering|developer|development|backend|frontend|full[- ]stack|devops|platform|infrastructure|data|hardware|verification|technical|programming|manufacturing|managing|products?|industry|commercial|sre)\b"
)
COMPANY = (
    r"\b(?:our|the|this)\s+(?:company|firm|business)\b|\bour team\s+(?:has|combines|brings|boasts|offers)\b|\bwe(?:'ve| have| bring| offer| boast)\b|\bserving (?:customers|clients)\b|\bin business\b|\bas a company\b|"
    r"(?:^|[^א-ת])(?:לחברה|לחברת|בחברה|החברה|חברתנו)(?![א-ת])|\b(?:our|the)[ ]+(?:founding[ ]+)?(?:team|group)[ ]+(?:has|have|combines|brings|boasts|offers|contributes)\b|\bwe[ ]+are[ ]+(?:a|an|the)[ ]+(?:company|firm|business)\b"
)
_TO = r"(?:[-–—]|to|עד|ל-?)"
QUANTITY = rf"(?:בין[ ]+)?{NUM}(?:[ \t]*{_TO}[ \t]*{NUM})?"
_ANY = NUM.replace("{1,2}", "+")
EXCLUDED_QUANTITY = rf"(?:בין[ ]+)?(?<![A-Za-z0-9_]){_ANY}(?:[ \t]*{_TO}[ \t]*{_ANY})?(?![A-Za-z0-9_])"
NUMERIC = (
    rf"{QUANTITY}[ \t]*\+?(?:[ ]+or more)?[ ]+(?:overall[ ]+)?years?\b|[0-9]+[^.!?;\n]{{0,30}}(?:שנות|שנים)|שנתיים|(?<![A-Za-z0-9_])(?:[0-9]+|{NUM})[ \t+–—/():-]*(?:years?|yrs?|yoe|y/o/e)\b|"
    rf"[0-9]+[^.!?;\n]{{0,30}}(?:שנה|שנתיים)|\bdecades?\b|עשור|(?<![A-Za-z0-9_])[0-9]+(?:[ ]*[-–—][ ]*[0-9]+)?[ ]*\+?[ ]*y\b|\b(?:experience|exp|yoe)(?:[ ]*\([ ]*YOE[ ]*\))?[ ]*:[ ]*{NUM}(?![A-Za-z_])|"
    rf"(?<![A-Za-z0-9_]){NUM}\+?[ ]*\([^()\n]*\)[ ]*(?:years?|yrs?|yoe)\b"
)
ALTERNATIVE = rf"(?:\([^)]*|\b(?:or|plus)\b[^.!?;\n]*|(?:/|[–—])[^.!?;\n]*|או[^.!?;\n]*){_ALONE}"
ROLE = (
    r"\boverall\b|\b(?:software|engineering|development|developer|programming|professional|industry|relevant|commercial|automation|platform|robotics|embedded|simulation)[ -]+(?:[a-z-]+[ ]+){0,3}experience\b|"
    r"\bexperience[ ]+(?:as[ ]+(?:a[ ]+)?(?:software[ ]+)?(?:engineer|developer)|in[ ]+(?:software|engineering|development))\b|נ[י]?סיון[ ]+בפיתוח|\byears?(?:[ ]+of)?[ ]+experience(?:[ ]+(?:is[ ]+)?required)?[ ]*$|"
    r"\b(?:professional|commercial)[ -]+(?:[a-z-]+[ ]+){0,3}track record\b|\bpaid[ ]+(?:[a-z-]+[ ]+){0,3}roles?\b|\b(?:yrs?|yoe)(?:[ ]+exp)?[ ]*$"
)
PREFERENCE = rf"\([ ]*{NUM}\+?(?:[ ]+years?)?[ ]+(?:preferred|ideal|ideally|preferable)[ ]*\)"
INTERRUPTED = rf"(?:^|\n)[ ]*(?:requirements?|required qualifications?|minimum qualifications?)[ ]*:?[ ]*(?:\n[ ]*)?(?:at least|we require)[ ]+{NUM}[ ]*$"
DOMAIN_PREFERENCE = r",?[ ]+\b(?:ideally|preferably)[ ]+(?:in|with|within)[ ]+[^.!?;\n]*$"
ANNOTATION = r"[ ]*\([ ]*YOE[ ]*\)(?![ ]*:)"
COLLECTIVE = r"\b(?:combined|collective|cumulative)[ ]+(?:team|group)[ ]+experience\b"
EMPLOYER_VERB, APPLICANT_VERB = r"\b(?:has|have|boasts?|brings?|offers?)[ ]*$", r"\b(?:you[ ]+(?:have|bring)|must[ ]+have)[ ]*$"

_FLAGS = re.IGNORECASE | re.ASCII
_p = lambda pattern, more=0: re.compile(pattern, _FLAGS | more)
_FRAME, _WHOLE_FRAME, _NUMERIC, _TENURE, _ONE = _p(FRAME), _p(f"(?:{FRAME})[ ]*$"), _p(NUMERIC), _p(TENURE), _p(_ALONE)
_OPTIONAL, _COMPLEX, _COMPANY, _HEADINGS = _p(OPTIONAL), _p(COMPLEX), _p(COMPANY), _p(HEADINGS, re.M)
_HEADED_TENURE = _p(rf"{TENURE}|\b{NUM}\b")
#: Of each heading that opens a part of its own, and of each clause that may speak of years, some piece.
_HEADING_WORDS = _p(r"prefer|option|nice|bonus|advantage|desirable|helpful|useful|a plus|must|requir|qualif|looking for|you|skill|who |it takes|we value|we need|דרישות|מחפשים|יתרון|יתרונות|רשות|חובה")
_OTHER_WORDS = _p(r"about|company|responsib|what|role|benefits|compensation|ways")
_MAY_SPEAK = _p(r"ye|yr|yoe|y/o/e|decade|exp|[0-9][ ]*\+?[ ]*y|שנ|עשור")
_SPACED = str.maketrans({**dict.fromkeys(SPACES, " "), **dict.fromkeys(LINES, "\n")})
_UNLIKE = re.compile(f"[{(SPACES + LINES).translate({32: None, 10: None})}]")
#: Bytes of a company's name or verb before a frame that are looked at.
BEFORE = 180


class Says(Enum):
    """What a check makes of a clause."""

    PASS_OVER = 1
    GIVE_UP = 2


def _blank(text: str, a: int, b: int) -> str:
    return text[:a] + " " * (b - a) + text[b:]


def _value(token: str) -> int:
    return int(token) if token.isdigit() else _WORDS.index(token.lower())


def masked(text: str) -> str:
    """The text with one kind of space and line end, and without list marks and breaks within a quantity; no character moves."""
    out = text.translate(_SPACED) if _UNLIKE.search(text) else text
    for pattern, needs, flags in (*((m, needs, re.M) for m, needs in MASKS), (JOINED, JOINED_NEEDS, 0)):
        if _p(needs).search(out):
            out = _p(pattern, flags).sub(lambda m: " " * len(m[0]), out)
    return out


@dataclass
class _Clause:
    start: int
    text: str
    #: The masked text before the clause.
    before: str

    def __post_init__(self):
        self._without_annotations()
        self._without_preferences()
        self.frames = list(_FRAME.finditer(self.text))
        self.lead = self.text[: self.frames[0].start()] if self.frames else self.text
        self.rest = self.text[: self.frames[0].start()] + self.text[self.frames[0].end() :] if len(self.frames) == 1 else self.text

    def _without_annotations(self) -> None:
        for m in list(_p(ANNOTATION).finditer(self.text)):
            if _WHOLE_FRAME.search(self.text[: m.start()]):
                self.text = _blank(self.text, *m.span())

    def _without_preferences(self) -> None:
        for m in list(_p(PREFERENCE).finditer(self.text)):
            asked, numbers = self.text[: m.start()], _ONE.findall(self.text[: m.start()])
            stands = _WHOLE_FRAME.search(asked) or _p(INTERRUPTED).search(self.before + asked)
            if stands and numbers and _value(_ONE.search(m[0])[0]) >= _value(numbers[-1]):
                self.text = _blank(self.text, *m.span())
        m = _p(DOMAIN_PREFERENCE).search(self.text)
        if m and not _ONE.search(m[0]) and not _TENURE.search(m[0]):
            self.text = _blank(self.text, *m.span())

    @cached_property
    def _section(self) -> str:
        if _p(INLINE_HEADING).search(self.text):
            return "applicant"
        above = self.before + self.lead
        if not _HEADING_WORDS.search(above):
            return "other"
        for m in reversed(list(_HEADINGS.finditer(above))):
            if not (_HEADING_WORDS.search(m[0]) or _OTHER_WORDS.search(m[0])):
                continue
            title = re.sub(r"^[^A-Za-zא-ת]+", "", re.sub(r"[:#*]+$", "", next(g for g in m.groups() if g is not None))).strip()
            if not re.search(r"[.!?;]", title) and _OPTIONAL.search(title) and not _HEADED_TENURE.search(title):
                return "optional"
            if _p(REQUIRED_HEADING).search(title):
                return "applicant"
            if _p(OTHER_HEADING).search(title):
                return "other"
        return "other"

    def section(self) -> str:
        """What the last heading before the frame opens: applicant, optional or other."""
        return self._section

    # Checks, in order; None goes on.

    def no_tenure(self):
        return None if _NUMERIC.search(self.text) else Says.PASS_OVER

    def optional(self):
        return Says.PASS_OVER if self.section() == "optional" else None

    def of_a_team(self):
        if _p(COLLECTIVE).search(self.text):
            return Says.GIVE_UP if _NUMERIC.search(_p(rf"{LEAD}[ ]+(?:of[ ]+)?{COLLECTIVE}").sub("", self.text)) else Says.PASS_OVER

    def of_the_employer(self):
        after = self.text[self.frames[0].end() :] if self.frames else ""
        verb = _p(EMPLOYER_VERB).search(self.lead) and not _p(APPLICANT_VERB).search(self.lead)
        if verb or _COMPANY.search(self.lead[-BEFORE:]) or _COMPANY.search(after):
            said = _NUMERIC.search(self.text)
            less = _p(EXCLUDED_QUANTITY).sub("", said[0], count=1)
            left = self.text[: said.start()] + ("" if less == said[0] else less) + self.text[said.end() :]
            return Says.GIVE_UP if _NUMERIC.search(left) else Says.PASS_OVER

    def unclear(self):
        after = self.frames and _COMPLEX.search(self.text[self.frames[0].end() :])
        return Says.GIVE_UP if _p(rf"{_ALONE}[ -]*$").search(self.lead) or after or _OPTIONAL.search(self.text) else None

    def of_nobody(self):
        asked = self.section() == "applicant" or _p(REQUIRED_CONTEXT).search(self.text) or _p(DOMAIN).search(self.text)
        return None if asked else Says.PASS_OVER

    def not_one_frame(self):
        left = len(self.frames) != 1 or any(p.search(self.rest) for p in (_TENURE, _NUMERIC, _p(REJECT), _p(ALTERNATIVE)))
        return Says.GIVE_UP if left else None

    def not_one_amount(self):
        frame = self.frames[0][0]
        return Says.GIVE_UP if _COMPLEX.search(frame) or _ONE.search(_p(QUANTITY).sub("", frame, count=1)) or not self.amounts() else None

    def amounts(self) -> list[int]:
        frame = self.frames[0][0]
        found = [10] if re.search(r"\bdecade\b|עשור", frame, _FLAGS) else [_value(t) for t in _ONE.findall(frame)]
        return [] if len(found) > 1 and found[1] < found[0] else found

    CHECKS = (no_tenure, optional, of_a_team, of_the_employer, unclear, of_nobody, not_one_frame, not_one_amount)

    def offer(self) -> tuple[int, int, int, int]:
        """(rank, least years, start, end)."""
        end = self.start + self.frames[0].end()
        quote = re.sub(r"^minimum(?:[ \t]+of)?[ \t]+", "", self.frames[0][0], flags=_FLAGS)
        return 2 * (self.section() == "applicant") + 4 * bool(_p(ROLE).search(self.text)), self.amounts()[0], end - len(quote), end


def phrase_of(description: str | None) -> str | None:
    """The part of a description that names the least years it asks for; null if it asks for none or can be read in two ways."""
    if not description or not _TENURE.search(description):
        return None
    text = masked(description)
    if _p(FRACTION).search(text) or _p(NUMBERED, re.M).search(text):
        return None
    offers = []
    for m in re.finditer(r"[^.!?;\n]+", text):
        if not _MAY_SPEAK.search(m[0]) or not _TENURE.search(m[0]) and not _NUMERIC.search(m[0]):
            continue
        clause = _Clause(m.start(), m[0], text[: m.start()])
        said = next((s for s in (check(clause) for check in _Clause.CHECKS) if s), None)
        if said is Says.GIVE_UP:
            return None
        if said is None:
            offers.append(clause.offer())
    best = [o for o in offers if o[0] == max(x[0] for x in offers)]
    return description[best[0][2] : best[0][3]] if best and len({o[1] for o in best}) == 1 else None


def experience_phrase(description) -> Column:
    """The quote of the least years of experience that a description asks for, or null."""
    column = F.col(description) if isinstance(description, str) else description
    told = F.pandas_udf(_phrases, "string")
    return told(F.when(holds(column, "year", "yr", "yoe", "y/o/e", "decade", "שנות", "שנים", "שנה", "שנתיים", "עשור"), column))


def _phrases(texts: pd.Series) -> pd.Series:
    return texts.map(phrase_of, na_action="ignore")


#: Single requirements of years.
YEARS = r"(?<![\w.\-–])(?P<years>\d+(?:\.\d+)?)(?:\s*[-–]\s*(?P<upper>\d+(?:\.\d+)?))?\s*(?P<plus>\+)?\s*(?:years?|yrs?)\b[’']?\s*(?P<tail>[^\n;]*?)(?=\.(?:\s|$)|[\n;]|$)"
SPECIALIST = ("react", "angular", "llm-based ai solutions", "backend")
OVERALL = r"(?:professional )?software (?:development|engineering)"
ASKED = r"\s*[-*•]*\s*(?:requirements?\s*:\s*)?(?:(?:you (?:must )?have|must have|requires?|minimum(?: of)?|at least)\s+)?"
ASKING_SECTION = r"(?:(?:minimum|required|mandatory) )?(?:requirements?|qualifications?|skills)|required|mandatory|must have"
SECTION_LINE = r"^[ \t]*(?:#{1,6}[ \t]+)?(?:\*\*|__)?([^\W\d_][^\n]*?):?(?:\*\*|__)?[ \t]*:?[ \t]*$"
MANDATORY = r"\s+(?:[-–—]\s*(?:mandatory|required)|\((?:mandatory|required)\))\s*$"

_YEARS, _SECTION_LINE = re.compile(YEARS, re.I), re.compile(SECTION_LINE, re.M)
REQUIREMENT = "array<struct<quote:string,subject:string,subject_kind:string,years:double,upper:boolean>>"


def subject_of(tail: str) -> tuple[str, str]:
    """(subject, kind) of what follows a number of years: overall, specialist for the few subjects that can be compared, or unknown."""
    said = " ".join(tail.casefold().strip(" .,:*").split())
    for lead in (r"^(?:of\s+)?(?:hands-on\s+)?(?:experience\s*)?", r"^(?:in|with|developing|using)\s+", r"\s+experience$"):
        said = re.sub(lead, "", said)
    if re.fullmatch(OVERALL, said):
        return "overall", "overall"
    said = re.sub(r"\s+development$", "", said)
    if said in ("", "experience"):
        return "unknown", "unknown"
    return said, "specialist" if said in SPECIALIST else "unknown"


def requirements_of(text: str | None) -> list[dict]:
    """Requirements of years in sections that ask for them, each that begins its sentence."""
    out, asking, at = [], True, 0
    for line in (text or "").splitlines(keepends=True):
        for m in _YEARS.finditer(text, at, at + len(line)):
            before = re.split(r"\n|;|\.(?:\s|$)", text[at : m.start()])[-1]
            if asking and re.fullmatch(ASKED, before, re.I):
                subject, kind = subject_of(re.sub(MANDATORY, "", m["tail"], flags=re.I))
                out.append({"quote": m[0], "subject": subject, "subject_kind": kind, "years": float(m["years"]), "upper": bool(m["plus"] or m["upper"])})
        heading = _SECTION_LINE.match(line.rstrip("\n")) if line.endswith("\n") else None
        if heading and not _YEARS.search(heading[1]):
            asking = bool(re.fullmatch(ASKING_SECTION, heading[1].strip(), re.I))
        at += len(line)
    return out


def experience_requirements(description) -> Column:
    """Requirements of years: (quote, subject, subject_kind, years, upper)."""
    column = F.col(description) if isinstance(description, str) else description
    return F.pandas_udf(_requirements, REQUIREMENT)(F.when(column.rlike(r"(?iU)\d\s*\+?\s*(?:years?|yrs?)\b"), column))


def _requirements(texts: pd.Series) -> pd.Series:
    return texts.map(requirements_of)


def claim_of(claim: str | None) -> dict | None:
    """What a verified claim says of years in one of the subjects that can be compared."""
    m = _YEARS.fullmatch((claim or "").strip().rstrip("."))
    subject, kind = subject_of(m["tail"]) if m else ("", "")
    return {"subject": subject, "years": float(m["years"]), "at_least": bool(m["plus"] or m["upper"])} if kind == "specialist" and float(m["years"]) <= 100 else None


def claimed_years(claim) -> Column:
    """(subject, years, at_least) of a claim such as ``4+ years of React``, or null."""
    column = F.col(claim) if isinstance(claim, str) else claim
    return F.pandas_udf(_claims, "struct<subject:string,years:double,at_least:boolean>")(column)


def _claims(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([claim_of(t) or {"subject": None, "years": None, "at_least": None} for t in texts], columns=["subject", "years", "at_least"])
