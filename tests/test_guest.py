"""Guest fragments: by the letter, each structural fault once."""

import pytest

from postglean.functions import guest as g
from postglean.functions.pages import Node

CARD = '<section class="top-card-layout"><h2 class="top-card-layout__title">Dev</h2>{}</section><div class="decorated-job-posting__details"><p>Text</p></div><code>x</code>'
SHUT = '<figure class="closed-job"><figcaption class="closed-job__flavor--closed">No longer <b>accepting</b> applications</figcaption></figure>'
OPEN, CLOSED, NOTHING = (None, True, None), ("no longer accepting applications", False, None), (None, False, None)
CASES = [
    (CARD.format(""), OPEN), (CARD.format(SHUT), CLOSED), (CARD.format(SHUT + SHUT), NOTHING), (CARD.format(SHUT.replace("No longer", "Maybe")), NOTHING), (CARD.format('<span class="posted-time-ago__text">Reposted 2 weeks ago</span>'), (None, True, "Reposted 2 weeks ago")),
    ("<!doctype html>" + CARD.format(SHUT), NOTHING), ("<p>x</p>" + CARD.format(SHUT), NOTHING), (CARD.format(SHUT) + "text", NOTHING), (CARD.format("<div>"), NOTHING), (CARD.format("</p>"), NOTHING), (CARD.format('<i a="1" a="2">x</i>'), NOTHING),
    (CARD.format(SHUT) + CARD.format(""), NOTHING), (CARD.format('<a href="/jobs/view/dev-8">x</a>'), NOTHING), (CARD.format('<a href="/jobs/view/dev-7/">x</a>'), OPEN), (CARD.format('<a href="/jobs/view/%2537">x</a>'), NOTHING),
    (CARD.format('<i data-entity-urn="urn:li:jobPosting:8">x</i>'), NOTHING), (CARD.format('<i data-job-id="7">x</i>'), OPEN), (CARD.format("<form>x</form>"), NOTHING), (CARD.format("<nav><form>x</form></nav>"), OPEN), (CARD.format("<link>"), NOTHING),
    (CARD.format("<div hidden>" + SHUT + "</div>"), NOTHING), (CARD.format("<details>" + SHUT + "</details>"), NOTHING), (CARD.format("<details open>" + SHUT + "</details>"), CLOSED), (CARD.format("<details><summary>" + SHUT + "</summary></details>"), CLOSED),
    (CARD.format('<figcaption class="closed-job__flavor--closed">No longer accepting applications</figcaption>'), NOTHING), (CARD.format('<p class="closed-job">x</p>'), NOTHING), ("", NOTHING), (None, NOTHING), ("<section", NOTHING), (CARD.format("x" * 600_000), NOTHING),
]


@pytest.mark.parametrize("page,want", CASES)
def test_fragments(page, want):
    assert tuple(g.observation_of(page, "7").values()) == want


def test_trees():
    root = Node.of("<div class='a'>x<br><p>y<p>z</div><i>w")
    assert [x.tag for x in root.all(lambda _: True)] == ["div", "br", "p", "p", "i"] and not root.sound and root.text() == "x y z w"
    assert Node.of("<p>a<b>c</b></p>").sound and [x.text() for x in Node.of("<p>a<b>c</b></p>").outermost(lambda x: x.tag in "pb")] == ["a c"]


def test_column(spark):
    df = spark.createDataFrame([(1, CASES[1][0], "7"), (2, None, "7"), (3, CASES[1][0], None)], "id int, page string, job string")
    assert {r.id: tuple(r.o) for r in df.select("id", g.guest_observation("page", "job").alias("o")).collect()} == {1: CLOSED, 2: NOTHING, 3: NOTHING}
