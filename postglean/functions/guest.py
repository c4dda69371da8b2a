"""What a landed guest fragment of one posting says of it: closed by its own words, of an open shape, reposted. A fragment whose structure isn't the expected one says nothing."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .pages import Node

#: Words of closure and reposts, and elements that show nothing or belong to the page.
CLOSED = ("no longer accepting applications", "not currently accepting applications")
REPOSTED = r"Reposted [1-9][0-9]* (?:minute|hour|day|week|month|year)s? ago"
EXCLUDED = frozenset("script style template noscript svg canvas textarea select iframe object aside nav footer".split())
FOREIGN = frozenset("html head body style link".split())
HIDING = frozenset("hidden inert style popover".split())
HIDDEN_CLASSES = frozenset("hidden invisible sr-only".split())
JOB_PATH = r"/(?:jobs/view/|(?:jobs-guest/)?jobs/api/jobposting/)"
#: Bytes of a fragment.
LARGEST = 512_000


@dataclass(frozen=True)
class Seen:
    """An element with what its ancestors make of it."""

    node: Node
    depth: int
    hidden: bool
    excluded: bool
    in_card: bool
    in_figure: bool

    @property
    def shows(self) -> bool:
        return not self.hidden and not self.excluded


def _hides(node: Node) -> bool:
    given = node.given
    return bool(HIDING & given.keys()) or (node.tag == "dialog" and "open" not in given) or given.get("aria-hidden", "").lower() == "true" or bool(HIDDEN_CLASSES & set(node.classes))


def _is_card(node: Node) -> bool:
    return node.tag == "section" and "top-card-layout" in node.classes


def walk(root: Node) -> Iterator[Seen]:
    """All elements in the page's order. Of a closed details element only the first summary shows."""
    left = [Seen(x, 0, _hides(x), x.tag in EXCLUDED, _is_card(x), False) for x in root.elements()][::-1]
    while left:
        s = left.pop()
        yield s
        closed = s.node.tag == "details" and "open" not in s.node.given
        children = list(s.node.elements())
        summary = next((x for x in children if x.tag == "summary"), None) if closed else None
        figure = s.in_figure or (s.node.tag == "figure" and "closed-job" in s.node.classes and s.in_card)
        left += [
            Seen(x, s.depth + 1, s.hidden or _hides(x) or (closed and x is not summary), s.excluded or x.tag in EXCLUDED, s.in_card or _is_card(x), figure) for x in children
        ][::-1]


def _words(seen: Seen) -> str:
    """What an element shows."""
    shown = Node("", {}, [seen.node])
    gone = {id(s.node) for s in walk(shown) if not s.shows and s.node is not seen.node}

    def text(node: Node) -> str:
        closed = node.tag == "details" and "open" not in node.given
        return "".join(("" if closed else x) if isinstance(x, str) else " " if x.tag in ("br", "hr") else "" if id(x) in gone else text(x) for x in node.children)

    return " ".join(text(seen.node).split()) if seen.shows else ""


def _linked_job(address: str) -> str | None:
    """The posting that an address names, relative ones and encoded ones included; an unclear one is named as nobody's."""
    try:
        path = unquote(urlparse(address).path, errors="strict").lower().rstrip("/")
    except ValueError:
        return ""
    found = re.search(JOB_PATH, path)
    named = re.fullmatch(r"(?:[^/]*-)?([0-9]+)", path[found.end() :]) if found else None
    return None if not found else named[1] if named and "%" not in path else ""


def _of_another(node: Node, identity: str) -> bool:
    urns = {x for v in node.given.values() for x in re.findall(r"urn:li:jobPosting:([0-9]+)", v)}
    link = _linked_job(node.given.get("href", ""))
    return bool(urns - {identity}) or node.given.get("data-job-id", identity) != identity or (link is not None and link != identity)


def fragment(page: str, identity: str) -> list[Seen] | None:
    """The elements of a fragment that is complete and this posting's alone: a top card, then details and hidden codes."""
    root = Node.of(page)
    seen = list(walk(root))
    roots = list(root.elements())
    rest_known = all(x.tag == "code" or (x.tag == "div" and "decorated-job-posting__details" in x.classes) for x in roots[1:])
    sound = root.sound and not root.declared and bool(roots) and _is_card(roots[0]) and rest_known and not any(isinstance(x, str) and x.strip() for x in root.children)
    cards = [s for s in seen if _is_card(s.node)]
    foreign = any(s.node.tag in FOREIGN or (s.node.tag in ("form", "title") and s.shows) or _of_another(s.node, identity) for s in seen)
    astray = any(s.node.tag == "figcaption" and "closed-job__flavor--closed" in s.node.classes and not (s.in_figure and s.in_card) for s in seen)
    return seen if sound and len(cards) == 1 and not foreign and not astray else None


def observation_of(page: str | None, identity: str | None) -> dict:
    """(closure, opened, reposted) of a fragment."""
    nothing = {"closure": None, "opened": False, "reposted": None}
    seen = fragment(page, identity) if page and identity and len(page.encode()) <= LARGEST else None
    if seen is None:
        return nothing
    has = lambda s, c: c in s.node.classes
    captions = [s for s in seen if s.node.tag == "figcaption" and has(s, "closed-job__flavor--closed")]
    ages = [s for s in seen if s.node.tag == "span" and has(s, "posted-time-ago__text") and s.in_card]
    controls = [s for s in seen if s.in_card and s.shows and ((s.node.tag == "h2" and has(s, "top-card-layout__title")) or (s.node.tag in ("a", "button") and has(s, "apply-button")))]
    said = _words(captions[0]).lower() if len(captions) == 1 else ""
    age = _words(ages[0]) if len(ages) == 1 else ""
    opened = not captions and not any(has(s, "closed-job") for s in seen) and any(_words(s) for s in controls)
    return {"closure": said if said in CLOSED else None, "opened": opened, "reposted": age if re.fullmatch(REPOSTED, age, re.I) else None}


def guest_observation(page, identity) -> Column:
    """(closure, opened, reposted): words by which a fragment of a posting says that it is closed, whether it has an open one's shape, and the label of a repost. Advice, not a verdict."""
    columns = [F.col(c) if isinstance(c, str) else c for c in (page, identity)]
    return F.pandas_udf(_observations, "struct<closure:string,opened:boolean,reposted:string>")(*columns)


def _observations(pages: pd.Series, identities: pd.Series) -> pd.DataFrame:
    clean = lambda x: None if pd.isna(x) else x
    return pd.DataFrame([observation_of(clean(p), clean(i)) for p, i in zip(pages, identities)], columns=["closure", "opened", "reposted"])
