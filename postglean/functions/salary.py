"""Pay in a text: the span of an amount that nothing but pay owns, and a salary fact brought to it.

Amounts joined by a range are one group. A group has a window: what is written
before it since the last amount or sentence, and after it up to the next. Vetoes
look at the window for another owner of the number (funding, head counts,
percentages); then the group must show that it is money or pay.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_I = re.IGNORECASE
#: How amounts, pay and other owners of a number are written.
AMOUNT = r"(?:\d{1,3}(?:[, ]\d{3})+|\d+)(?:\.\d+)?"
CURRENCY = r"""(?:(?:US|CA|AU)?[$]|[€£₪]|\b(?:USD|EUR|GBP|ILS|NIS|CAD|AUD|ש[״"']?ח|שקל(?:ים)?)\b)"""
UNIT = r"(?:k|m|b|thousand|million|billion|אלף|מיליון)\b"
#: What may stand between an amount, its unit and its currency: a line's end parts them.
GAP = r"[^\S\n]*"
MONEY = rf"{CURRENCY}{GAP}{AMOUNT}(?:{GAP}{UNIT})?(?:{GAP}{CURRENCY})?|(?<!\w){AMOUNT}(?:{GAP}{UNIT})?{GAP}{CURRENCY}"
PAY = r"(?:salary|salaries|base\s+(?:salary|pay|comp(?:ensation)?)|pay|compensation|wage|OTE|(?:hourly|daily|day)\s+rate|gross|net|ו?שכר|ברוטו|נטו)"
CADENCE = r"(?:(?:/|\bper\s+)(?:hr|hour|day|month|year|annum|yr|mo)\b|\b(?:annually|monthly|yearly|hourly|daily|בחודש|לחודש|לשנה|בשנה|לשעה)\b)"
PAY_CONTEXT = rf"\b{PAY}\b|{CADENCE}"
CONTEXT_AMOUNT = rf"\b(?:up\s+to|עד)\s+{AMOUNT}(?![\w%])|(?<!\w){AMOUNT}\s*(?:k|thousand|אלף)\b|\b{PAY}\s*:?\s+(?:is\s+)?{AMOUNT}(?![\w%])|(?<!\w){AMOUNT}\s*{CADENCE}"
QUALIFIED = rf"\b(?:up\s+to|עד)\s+(?:{AMOUNT}\s*(?:k|thousand|אלף)\b|(?:\d{{2,3}}(?:[, ]\d{{3}})+|\d{{5,}})(?![\w%]))"
RETIREMENT = rf"\b401\s*(?:\(k\)|k)(?!\w)|(?<!\w){AMOUNT}\s*k\s+(?:retirement|pension)(?:[- ]plan)?\b"
FUNDING = r"\b(?:raised|funding|series|seed|round|investors?|valuation|ARR|revenue|גייסנו|הכנסות|מחזור)\b"
NUMBER = rf"{MONEY}|(?<!\w){AMOUNT}(?:{GAP}{UNIT})?(?!\w)"
OTHER_OWNER = (
    rf"{FUNDING}|%|\bbase\s+(?:of|is)\b|\b(?:customers?|users?|graduates?|headcount|people|investment|capital|years|offices?|retirement|pension|percent|לקוחות|משתמשים)\b|"
    rf"(?<!\w){AMOUNT}\s*(?:(?:k|thousand|אלף)\s*)?(?:employees?|locations?|עובדים)\b"
)
PAY_RAISED = rf"(?P<pay>{PAY_CONTEXT}|\brate)\s+(?:(?:was|is|has\s+been|had\s+been|have\s+been)\s+)?raised\s+to\s*$"
PAY_BEFORE = (
    rf"\b(?:(?:{PAY}|rate)(?:\s+range|\s+בסיס\s+של)?(?:\s+(?:(?:was|is|has\s+been|had\s+been|have\s+been)\s+)?raised\s+to|\s+הועלה\s+ל-?)?(?:\s+(?:is|of))?(?:\s+(?:up\s+to|עד))?|up\s+to|עד)\s*[:(]?\s*$"
)
PAY_AFTER = rf"^\s*(?:(?:(?:annual|monthly|hourly|daily)\s+)?{PAY}\b(?:\s+range)?|\+?\s*{CADENCE}|base\b(?=\s*(?:$|[).!?])))"
UNOWNED = r"\s*(?:(?:up\s+to|between|from|or|עד)\s*)?[:(=\s]*$"
LABEL = rf"(?:(?:competitive|annual|monthly|hourly|daily|gross|net)\s+)*{PAY}(?:\s+\((?:gross|net)\))?(?:\s+range)?(?:\s+for\s+this\s+role)?(?:\s+and\s+equity)?"
LABELLED = rf"\s*[,;/–—-]?\s*(?:{LABEL}\s*[,;/–—-]\s*)+"
REGION = (
    r"\s*(?:(?:California|Washington|New York|New Jersey|Connecticut|Canada|MA|NYC/NJ|DC Metro|All other (?:U\.S\. |US )?(?:states|Locations)|(?:US|Canadian) employees \(any location\)):\s*(?:Senior [IV]+:\s*)?|"
    r"Senior [IV]+:\s*)$"
)
BAND = (
    r"\s*(?:\((?:base|entry-level qualifications|highly experienced)\)|in (?:local currency|our (?:lowest|highest) geographic market)(?:\s+up\s+to)?|or more(?:, depending on experience)?|DOE)\s*[-–—]?\s*$"
)
RANGE, SENTENCE, CLAUSE, LIST = r"\s*(?:[-–—]|to|and|עד)\s*", r"\n|(?<=[.!?])\s+", r"[;\n]|,(?!\d)|(?<=[.!?])\s+", r"[;,\n&]|(?<=[.!?])\s+|\b(?:and|but)\b"
THOUSANDS = rf"{AMOUNT}\s*(?:k|thousand|אלף)\b"
#: Longest value, quote and remark of a salary fact.
LONGEST_VALUE, LONGEST_QUOTE = 256, 1000

_p = {k: re.compile(v, _I) for k, v in dict(globals()).items() if k.isupper() and isinstance(v, str)}


def _named_pay(before: str, after: str) -> bool:
    """Whether a word of pay touches the amount."""
    m = _p["PAY_BEFORE"].search(before)
    return bool(m and re.match(rf"{PAY}\b", m[0], _I)) or bool(re.match(rf"\s*{PAY}\b", after, _I))


def _governed(before: str, after: str) -> bool:
    """Whether something unknown stands before an amount that might own it."""
    if _p["LABELLED"].fullmatch(before) or _named_pay(before, "") or (_p["PAY_AFTER"].search(after) and re.fullmatch(r"\s*rate(?:\s+raised\s+to)?\s*", before, _I)):
        return False
    bare = re.sub(r"^[,;/–—\s-]+|[,;/–—\s-]+$", " ", before)
    return not (_p["UNOWNED"].fullmatch(bare) or _p["REGION"].fullmatch(bare))


@dataclass
class _Group:
    """Amounts of one range, with their window."""

    amounts: list[str]
    left: int
    right: int
    before: str
    #: After the amounts up to a further thing that is added, and of that up to a parenthesis.
    owner_after: str
    after: str
    #: The sentence so far, and whether the text anywhere has another owner of numbers.
    sentence: str
    others: bool

    @property
    def said(self) -> str:
        return "".join(self.amounts)

    @property
    def raised(self) -> str:
        """What is before, without a raise of pay."""
        return _p["PAY_RAISED"].sub(r"\g<pay> ", self.before)

    def of_unknown(self, text: str) -> bool:
        return _governed(self.before, self.after)

    def has_a_tail(self, text: str) -> bool:
        pay = _p["PAY_AFTER"].search(self.after)
        rest = self.owner_after[pay.end() :] if pay else self.owner_after
        return bool(re.search(r"[^\W\d_]", rest)) and not (_p["BAND"].fullmatch(rest) or _p["REGION"].fullmatch(rest))

    def of_another(self, text: str) -> bool:
        if re.match(r"\s*base\b", self.owner_after, _I) and not _p["PAY_AFTER"].search(self.owner_after):
            return True
        since = max((m.end() for m in _p["LIST"].finditer(self.raised)), default=0) if _named_pay(self.raised, "") else 0
        return bool(_p["OTHER_OWNER"].search(self.raised + text[self.left : self.right] + self.owner_after, since))

    def inherits(self, text: str) -> bool:
        """Whether amounts earlier in the sentence are another's, and nothing names pay anew."""
        if _p["LABELLED"].fullmatch(self.before) or _named_pay(self.before, self.after):
            return False
        earlier = list(_p["NUMBER"].finditer(self.sentence))
        if earlier and _p["OTHER_OWNER"].search(self.sentence[: earlier[-1].end()]):
            return True
        starts = [0, *(m.end() for m in earlier)]
        return any(_governed(self.sentence[a : m.start()], self.sentence[m.end() :]) for a, m in zip(starts, earlier))

    def untouched(self, text: str) -> bool:
        touched = _p["PAY_BEFORE"].search(self.before) or _p["PAY_AFTER"].search(self.after) or _p["LABELLED"].fullmatch(self.before)
        return self.others and not touched

    def not_pay(self, text: str) -> bool:
        context = self.raised + text[self.left : self.right] + self.after
        if _p["MONEY"].search(context) or _p["QUALIFIED"].search(context):
            return False
        each = all(_p["CONTEXT_AMOUNT"].search(self.before + a + self.after) for a in self.amounts)
        return not (_p["PAY_CONTEXT"].search(context) and (_p["THOUSANDS"].search(context) or each))

    VETOES = (of_unknown, has_a_tail, of_another, inherits, untouched, not_pay)

    def span(self) -> tuple[int, int]:
        before, after = _p["PAY_BEFORE"].search(self.before), _p["PAY_AFTER"].search(self.after)
        opens = before and not before[0].rstrip().endswith("(")
        return (self.left - len(self.before) + before.start() if opens else self.left), (self.right + after.end() if after else self.right)


def _groups(text: str) -> list[_Group]:
    amounts = list(_p["NUMBER"].finditer(text))
    joined: list[list[re.Match]] = []
    for m in amounts:
        if joined and _p["RANGE"].fullmatch(text[joined[-1][-1].end() : m.start()]):
            joined[-1].append(m)
        else:
            joined.append([m])
    out, others = [], bool(_p["OTHER_OWNER"].search(text))
    for k, group in enumerate(joined):
        left, right = group[0].start(), group[-1].end()
        sentence = max((m.end() for m in _p["SENTENCE"].finditer(text, 0, left)), default=0)
        clause = _p["CLAUSE"].search(text, right)
        start = max(sentence, joined[k - 1][-1].end() if k else 0)
        end = min(clause.start() if clause else len(text), joined[k + 1][0].start() if k + 1 < len(joined) else len(text))
        owner = re.split(r"\+(?!\s*/)|\b(?:and|but|plus)\b", text[right:end], maxsplit=1, flags=_I)[0]
        out.append(_Group([m[0] for m in group], left, right, text[start:left], owner, owner.split("(", 1)[0], text[sentence:left], others))
    return out


def salary_span_of(value: str | None) -> str | None:
    """The first span of a text that is pay and nothing else's."""
    text = _p["RETIREMENT"].sub(lambda m: " " * len(m[0]), value or "")
    for group in _groups(text):
        if not any(veto(group, text) for veto in _Group.VETOES):
            a, b = group.span()
            return value[a:b].strip()
    return None


def _supported(value: object, quote: object, text: str) -> bool:
    """A value must be in its quote, and that in the text; neither may stand alone."""
    if value is None and quote is None:
        return True
    return isinstance(value, str) and isinstance(quote, str) and bool(value.strip()) and bool(quote.strip()) and value in quote and quote in text


def normalized_salary_of(value: str | None, quote: str | None, remark: str | None, text: str) -> tuple[str | None, str | None, str | None]:
    """(value, quote, remark) of a salary fact: its stable span with its quote, and as a remark what the source says besides."""
    where = quote if quote and quote in text else text
    named = re.search(rf"(?<!\w){re.escape(value)}(?!\w)", where, _I) if value and value.strip() else None
    source = named[0] if named else None
    span = salary_span_of(source)
    sound = len(value or "") <= LONGEST_VALUE and len(quote or "") <= LONGEST_QUOTE and _supported(value, quote, text) and (remark is None or (remark.strip() and remark in text))
    stable = span is None or (_supported(span, quote, text) and salary_span_of(span) == span and (remark is None or salary_span_of(remark) == span))
    if not (sound and stable):
        span, remark = None, None
        source = source if source is not None or not (quote and quote.strip() and quote in text) else quote
    if source is not None and span != source:
        remark = source
    remark = remark[:LONGEST_QUOTE] if span is None and remark else remark
    return span, quote if span else None, remark if remark and remark.strip() and remark in text else None


def salary_span(value) -> Column:
    """The span of a text that is pay, or null; texts without a digit stay in the JVM."""
    column = F.col(value) if isinstance(value, str) else value
    return F.pandas_udf(_spans, "string")(F.when(column.rlike(r"\d"), column))


def _spans(texts: pd.Series) -> pd.Series:
    return texts.map(salary_span_of, na_action="ignore")


def normalized_salary(value, quote, remark, text) -> Column:
    """(value, quote, remark) of a salary fact against its text."""
    columns = [F.col(c) if isinstance(c, str) else c for c in (value, quote, remark, text)]
    return F.pandas_udf(_normalized, "struct<value:string,quote:string,remark:string>")(*columns)


def _normalized(values: pd.Series, quotes: pd.Series, remarks: pd.Series, texts: pd.Series) -> pd.DataFrame:
    clean = lambda s: [None if pd.isna(x) else x for x in s]
    rows = [normalized_salary_of(v, q, r, t or "") for v, q, r, t in zip(*map(clean, (values, quotes, remarks, texts)))]
    return pd.DataFrame(rows, columns=["value", "quote", "remark"])
