"""Years, stack, pay and employers in descriptions: by the letter, and joins against plain loops."""

import random

import pytest

from postglean.functions import employers, experience, salary, stack
from postglean.operators import attribution, requirements

PHRASES = [
    ("Requirements:\n5+ years of experience in software development", "5+ years of experience"),
    ("You have 3-5 years of professional experience.", "3-5 years of professional experience"),
    ("Our company has 20 years of experience.\nAt least 4 years of software engineering required", "At least 4 years of software engineering"),
    ("Nice to have:\n3 years of experience with Go", None), ("2.5 years of experience in software", None), ("1. 5 years of experience", None),
    ("Must have 5 years of experience or a relevant degree", None), ("You need 5 years of experience with Java and 3 years with Go", None),
    ("Minimum of 7 years' experience", "7 years' experience"), ("Requirements\n- 5\n years of experience", "5\n years of experience"), ("10 years combined team experience", None),
    ("You have 5 years of experience (7 preferred)", "5 years of experience"), ("Requirements: 6-4 years of experience", None), ("דרישות:\nלפחות 3 שנות ניסיון", "לפחות 3 שנות ניסיון"),
    ("You bring a decade of experience", "a decade of experience"), ("we like 5 years", None), ("Requirements:\n3 years of experience\n4 years of experience", None),
    ("Required: 3 years of experience with Go\nYou have 4 years of software experience", "4 years of software experience"), ("You need 5 years of experience", "5 years of experience"),
    ("We have 10 years of experience and 5 years of fun", None), ("About us\nMust have 5 years of experience, ideally in finance", "5 years of experience"), (None, None), ("", None),
]


@pytest.mark.parametrize("text,phrase", PHRASES)
def test_phrases(text, phrase):
    assert experience.phrase_of(text) == phrase
    assert phrase is None or phrase in text


def test_masks_move_nothing():
    for text, _ in PHRASES:
        assert text is None or len(experience.masked(text)) == len(text)


def test_requirements():
    text = "Requirements:\n- 5+ years of React\nmust have 3 years experience in backend development. We had 2 years of Angular; minimum 4 years of software engineering - mandatory\nPerks\n9 years of React\n## Skills\n2-3 yrs Angular"
    got = [(r["quote"], r["subject"], r["subject_kind"], r["years"], r["upper"]) for r in experience.requirements_of(text)]
    assert got == [
        ("5+ years of React", "react", "specialist", 5.0, True), ("3 years experience in backend development", "backend", "specialist", 3.0, False),
        ("4 years of software engineering - mandatory", "overall", "overall", 4.0, False), ("2-3 yrs Angular", "angular", "specialist", 2.0, True),
    ]
    assert experience.claim_of("4+ years of React.") == {"subject": "react", "years": 4.0, "at_least": True}
    assert experience.claim_of("4 years of Cobol") is None and experience.claim_of("Knows React") is None and experience.claim_of(None) is None


def test_stack_clauses():
    text = (
        "Requirements\n- Experience with Java or Kotlin\n- 3+ years of experience with Python, TypeScript and React\n- Knowledge of Java and Go\n- Java/Scala skills\n- Experience with Java and Kotlin or Scala\nRust is required\n"
        "Nice to have\n- experience with Scala\nResponsibilities\n- Build services using Node.js\n- not using Java\nOther part\n- Experience with C#\n"
    )
    assert stack.required_clauses(text) == [["Java", "Kotlin"], ["Python"], ["React"], ["TypeScript"], ["Java", "Scala"], ["Rust"], ["Node.js"]]
    assert stack.required_clauses(None) == [] and stack.alternatives("Java and Cobol") == []


def test_division_against_loops(spark):
    rng, names = random.Random(4), ["Java", "Kotlin", "Python", "Rust", "Scala"]
    clauses = {k: [sorted(rng.sample(names, rng.randint(1, 3))) for _ in range(rng.randint(0, 4))] for k in range(60)}
    shown = {p: set(rng.sample(names, rng.randint(0, 3))) for p in range(4)}
    text = lambda c: "Requirements\n" + "".join(f"- Experience with {' or '.join(x)}\n" for x in c)
    posts = spark.createDataFrame([(k, k % 4, text(c)) for k, c in clauses.items()] + [(99, 0, None)], "id int, p int, description string")
    known = spark.createDataFrame([(p, n) for p, s in shown.items() for n in s] + [(0, None)], "p int, name string")
    got = {r.id: r.gaps for r in requirements.stack_gaps(posts, known, "p").collect()}
    assert got == {k: sorted({" or ".join(x) for x in c if not shown[k % 4] & set(x)}) for k, c in clauses.items()} | {99: []}


def test_demonstrated(spark):
    signals = spark.createDataFrame([("verified", ["java", "NodeJS", "tea"]), ("stated", ["rust"]), ("verified", ["scala"])], "status string, tags array<string>")
    depth = spark.createDataFrame([("Java", ["reading"]), ("Python", ["hands-on", "reading"]), ("Tea", ["hands-on"])], "name string, modes array<string>")
    assert sorted(r.name for r in requirements.demonstrated(signals, depth).collect()) == ["Node.js", "Python", "Scala"]


def test_guarded_advice(spark):
    rows = [
        (1, "apply", "strong", "Go", "ok", "positive", None, ["Java or Kotlin", "Rust"]), (2, "apply", "weak", "Go", "ok", "negative", " Skip ", ["Rust"]), (3, "skip", "weak", "No", "ok", "positive", None, []),
        (4, "referral", "weak", "Go", "ok", "mixed", "later", [f"T{k}" for k in range(60)]),
    ]
    df = spark.createDataFrame(rows, "id int, recommendation string, fit_tier string, fit_line string, detail string, assessment string, human_verdict string, gaps array<string>")
    once = requirements.guarded_advice(df)
    got = {r.id: r for r in once.collect()}
    assert (got[1].recommendation, got[1].assessment, got[1].fit_line) == ("review", "mixed", "Check required stack: Java or Kotlin; Rust.")
    assert got[1].detail == "Required stack not evidenced by verified skill tags/hands-on depth: Java or Kotlin; Rust. Confirm before pursuing. ok"
    assert (got[2].recommendation, got[2].assessment, got[2].fit_line) == ("apply", "negative", "Weak fit — Check required stack: Rust.")
    assert (got[3].recommendation, got[3].detail) == ("skip", "ok") and got[4].fit_line == "Weak fit — Check required stack; see stack evidence." and got[4].recommendation == "review"
    assert sorted(map(str, requirements.guarded_advice(once).collect())) == sorted(map(str, once.collect()))


def test_compared(spark):
    posts = spark.createDataFrame([(1, "4 years of React\n2 years of software development\n3 years of Cobol"), (2, None)], "id int, description string").selectExpr("*", "1 AS p")
    signals = spark.createDataFrame([(1, "verified", "3+ years of React", "a"), (1, "verified", "2 years of React", "b"), (1, "stated", "9 years of React", "c")], "p int, status string, claim string, evidence_id string")
    tenure = spark.createDataFrame([(1, 1.5)], "p int, tenure_years double")
    got = {r.subject: (r.candidate_years, r.candidate_evidence_ids, r.assessment) for r in requirements.compared_experience(posts, signals, tenure, "p").collect()}
    assert got == {"react": (3.0, ["a"], "unknown"), "overall": (1.5, ["profile:tenure"], "below"), "cobol": (None, [], "unknown")}


PAY = [
    ("Salary: $120,000 - $150,000 per year", "Salary: $120,000 - $150,000 per year"), ("We raised $20M in funding", None), ("up to 35k", "up to 35k"), ("Base salary range: 100k to 120k plus bonus", "Base salary range: 100k to 120k"),
    ("Pay: 40-50 per hour", "Pay: 40-50 per hour"), ("We have 500 employees", None), ("401k match", None), ("salary 30,000 ₪ gross", "salary 30,000 ₪ gross"), ("15% bonus", None), ("Series B $30M, salary $90,000", "salary $90,000"),
    ("revenue of $5M and 200 customers", None), ("שכר עד 30 אלף", "שכר עד 30 אלף"), ("New York: $120,000 - $140,000", "$120,000 - $140,000"), ("5 years", None), ("120000", None), ("$120k DOE", "$120k"),
    ("rate raised to $60 per hour", "rate raised to $60 per hour"), ("compensation is 100000", "compensation is 100000"), (None, None), ("", None), ("customers pay $5", None),
]


@pytest.mark.parametrize("text,span", PAY)
def test_pay(text, span):
    assert salary.salary_span_of(text) == span
    assert span is None or salary.salary_span_of(span) == span


def test_salary_facts():
    text = "Hi we pay $120k plus bonus now"
    assert salary.normalized_salary_of("$120k plus bonus", "we pay $120k plus bonus", None, text) == ("$120k", "we pay $120k plus bonus", "$120k plus bonus")
    assert salary.normalized_salary_of("great", "great pay", None, "great pay") == (None, None, "great")
    assert salary.normalized_salary_of("$120k", "nope", None, "we pay $120k") == (None, None, "$120k")
    assert salary.normalized_salary_of(None, None, "free tea", "free tea") == (None, None, "free tea")
    assert salary.normalized_salary_of("$9k", "$9k", "invented", "pay $9k") == (None, None, "$9k")


HIRING = [
    ("Acme", "Acme is hiring engineers.", "linkedin", ("Acme", "unchanged", None)), ("Pub", "Recruiting on behalf of Acme Robotics, for engineers.", "linkedin", ("Acme Robotics", "resolved-different", None)),
    ("Pub", "Acme Robotics is hiring.\nBeta Labs is hiring.", "lever", (None, "unknown", None)), ("Pub", "Our client is hiring an engineer.", "lever", (None, "unknown", None)),
    ("Pub", "Pub is a leading staffing agency.\nAcme Robotics is hiring.", "linkedin", ("Acme Robotics", "resolved-different", "Pub is a leading staffing agency.")), ("Pub", "The Data Team is hiring.", "lever", (None, "unknown", None)),
    ("Pub", "Build things.", "lever", ("Pub", "unchanged", None)), ("Pub", "Build things.", "linkedin", (None, "unknown", None)), ("Pub", "Agent is hiring.", "lever", (None, "unknown", None)),
    ("Pub", '"Acme Robotics is hiring", they said.', "linkedin", (None, "unknown", None)), ("Pub", "About the company\nGamma is a maker.\nAbout the role\nAcme Robotics is hiring.", "linkedin", ("Acme Robotics", "resolved-different", None)),
    ("Listed", "Build things.", "lever", (None, "unknown", None)), ("Acme", "Acme Labs Ltd is hiring.", "linkedin", ("Acme Labs Ltd", "alias", None)), (None, None, "lever", (None, "unknown", None)),
    ("Pub", "Israel is hiring.", "lever", (None, "unknown", None)), ("Pub", "Testimonials:\nAcme Robotics is hiring.", "linkedin", (None, "unknown", None)),
]


def test_attribution(spark):
    posts = spark.createDataFrame([(k, p, t, s) for k, (p, t, s, _) in enumerate(HIRING)], "id int, company string, description string, source string")
    name = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    got = {r.id: (r.hiring_employer, r.relationship, r.agency_evidence) for r in attribution.employer_attribution(posts, name("Listed"), name("agent", "Other"), ("lever",)).collect()}
    assert got == {k: want for k, (*_, want) in enumerate(HIRING)}


def test_voices_move_nothing():
    text = "Intro says hi.\n\n> quoted\n**Reviews**\n“long\nquote” here\n# Job description\nWe are Acme.\n"
    said = employers.attributable(text)
    assert len(said) == len(text) and "quote" not in said and "We are Acme" in said and len(employers.own_voice(text, said)) == len(text)
