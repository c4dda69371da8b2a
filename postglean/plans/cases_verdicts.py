"""Cases of pages, addresses, geocoding and annotations; as ``cases``."""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import functions as F

from ..functions import descriptions as D
from ..functions import verdicts as V
from ..operators import registry as R
from .cases import cases

SHARED = ("lever.co", "greenhouse.io", "linkedin.com")
cases("geocode_queries", [(t,) for t in (
    "Haifa", " Tel  Aviv (Hybrid) ", "Remote - Berlin", "Remote", "USA", "uk, Canada", "UK, United Kingdom", "Greater London Area", "SF Bay Area", "Chicago, IL", "12 Main", "Berlin or Paris", "customer site", "a/b", "", None, "AirportCity", "Head office", "usa, us")],
    out=(lambda: V.geocode_query("c0"), ["Haifa", "Tel Aviv", "Berlin", None, "United States", None, "UK, United Kingdom", None, "SF Bay Area", None, None, None, None, None, None, None, None, None, "usa, us"]))
_PLACE = '{"addresstype":"%s","category":"%s","type":"administrative","name":"%s","lat":"%s","lon":"34.5","osm_type":"node","osm_id":7}'
cases("geocoded_places", [(t,) for t in (
    "[" + _PLACE % ("city", "place", "X", "31.5") + "]", "[" + _PLACE % ("town", "boundary", "X Regional Council", "31.5") + "]", "[]", "[" + ",".join([_PLACE % ("city", "place", "X", "1")] * 2) + "]", "[" + _PLACE % ("house", "place", "X", "1") + "]",
    "[" + _PLACE % ("country", "place", "X", "91") + "]", "[" + _PLACE % ("state", "place", "X", "abc") + "]", "junk", None)],
    precision=(lambda: V.geocoded("c0")["precision"], ["city", "region"] + [None] * 7), source=(lambda: V.geocoded("c0")["source"], ["nominatim:osm:node:7"] * 2 + [None] * 7))
cases("company_names", [("Acmé Ltd.", "ACME"), ("Acme Labs Inc", "acme labs"), ("Acme", "Acmes"), ("Jobs Inc", "Jobs"), ("Data Dog", "datadog limited"), ("", "x"), (None, "x")],
    same=(lambda: V.same_company("c0", "c1"), [True, True, False, False, True, False, False]),
    slugs=(lambda: V.slugs("c0"), [["acme", "acme-israel", "acmeisrael"], ["acme-labs", "acme-labs-israel", "acmelabsisrael", "acme_labs", "acmelabs"], ["acme", "acme-israel", "acmeisrael"], [], ["data-dog", "data-dog-israel", "datadogisrael", "data_dog", "datadog"], [], []]),
    initials=(lambda: V.initials("c0"), ["AL", "AL", "A", "JI", "DD", "?", "?"]))
cases("company_domains", [
    ("Acme", "https://careers.acme.co.uk/x", "https://jobs.lever.co/acme"), ("Acme Labs", "https://acme.com", None), ("Security", "https://security.com", None), ("Other", "https://acme.com", "http://other-it.net/"), ("Acme", "https://1.2.3.4/", "ftp://acme.com"),
    ("", "https://acme.com", None), ("Data-Dog", "https://www.data-dog.io", None), ("Global Group", "https://group.com", None),
], domain=(lambda: V.company_domain("c0", F.array("c1", "c2"), SHARED), ["acme.co.uk", "acme.com", "security.com", None, None, None, "data-dog.io", None]),
   own=(lambda: V.own_domains(F.array("c1", "c2"), SHARED), [["acme.co.uk"], ["acme.com"], ["security.com"], ["acme.com", "other-it.net"], [], ["acme.com"], ["data-dog.io"], ["group.com"]]),
   boards=(lambda: V.source_companies(F.array("c1", "c2")), [["lever:acme"], [], [], [], [], [], [], []]))
cases("source_companies", [(t,) for t in ("https://boards.greenhouse.io/Acme/jobs/1", "https://jobs.eu.lever.co/acme", "https://jobs.ashbyhq.com/acme/1", "https://apply.workable.com/acme/j/1", "https://acme.firststage.co/jobs", "https://il.linkedin.com/company/Acme/", "https://u@jobs.lever.co/acme", "https://jobs.lever.co/", "https://acme.com/x")],
    out=(lambda: V.source_companies(F.array("c0")), [["greenhouse:acme"], ["lever:acme"], ["ashby:acme"], ["workable:acme"], ["firststage:acme"], ["linkedin:acme"], [], [], []]))
_GH = "https://job-boards.greenhouse.io/acme/jobs/1"
cases("page_verdicts", [
    ("https://a.b/1", 200, "https://a.b/1", "<p>This job has expired</p>"), ("https://a.b/1", 200, "https://a.b/1", "<script>This job has expired</script>Apply"), ("https://a.b/1", 404, "https://a.b/1", ""), ("https://a.b/1", 200, "https://a.b/login", "position is filled"),
    ("https://a.b/1", 200, "https://a.b/jobs/search?q=1", ""), (_GH, 200, "https://job-boards.greenhouse.io/acme?error=true", ""), (_GH, 302, "https://job-boards.greenhouse.io/acme?error=true", None), (_GH, 200, "https://job-boards.greenhouse.io/other?error=true", ""), ("ftp://x", 200, None, ""),
    ("https://a.b/1", None, None, None), ("https://a.b/1", 403, "https://a.b/authwall/x", None), ("https://a.b/1", 500, None, "job no longer available"), ("https://a.b/1", 410, "https://a.b/login", None),
], alive=(lambda: V.page_verdict("c0", "c1", "c2", "c3")["alive"], [False, None, False, None, False, False, False, None, None, None, None, None, None]),
   reason=(lambda: V.page_verdict("c0", "c1", "c2", "c3")["reason"], ["closed-page-text", "http-200-uncertain", "http-404", "redirect-to-auth", "redirect-to-search", "greenhouse-board-error-redirect", "greenhouse-board-error-redirect", "http-200-uncertain", "invalid-url",
       "network-uncertain", "redirect-to-auth", "http-500-uncertain", "redirect-to-auth"]))
cases("board_identities", [
    ("greenhouse", "greenhouse:acme:1", "https://boards.greenhouse.io/acme/jobs/1"), ("greenhouse", "greenhouse:acme:1", "https://boards.greenhouse.io/other/jobs/1"), ("lever", "lever:acme:x", "https://jobs.eu.lever.co/acme/x"), ("lever", "lever:acme:x", "https://acme.com"),
    ("comeet", "comeet:12.3:9", "https://www.comeet.com/jobs/acme/12.3/dev/9"), ("comeet", "comeet:12.3:9", "https://acme.com"), ("ashby", "lever:acme:x", None), ("workable", "workable:acme", None), ("ashby", "ashby:acme:1", "https://jobs.lever.co/acme/1"), ("ashby", "ashby:acme:1", None),
], tenant=(lambda: V.board_identity("c0", "c1", "c2")["tenant"], ["acme", None, "eu:acme", "acme", "acme/12.3", None, None, None, None, "acme"]),
   api=(lambda: V.board_identity("c0", "c1", "c2")["api"], ["https://boards-api.greenhouse.io/v1/boards/acme/jobs", None, "https://api.eu.lever.co/v0/postings/acme?mode=json", "https://api.lever.co/v0/postings/acme?mode=json", "https://www.comeet.com/jobs/acme/12.3",
       None, None, None, None, "https://api.ashbyhq.com/posting-api/job-board/acme"]))
cases("alert_lines", [(t,) for t in ('{"status":"success","alerts":0}', '{"status":"success","alerts":3}', '{"status":"failure"}', '{"status":"odd"}', "junk", None, '{"status":"success","alerts":"x"}', '{"status":"success","alerts":-1}')],
    line=(lambda: V.alert_line("liveness", "c0"), [None, *(f"WARNING: liveness: {m}; inspect the preserved run log and receipt" for m in ("3 new uncertainty or tenant list error(s)", "run failed", "receipt invalid", "receipt invalid", "receipt missing", "receipt invalid", "receipt invalid"))]))
_WHOLE = '{"employer_type":"direct","seniority_real":true,"fit_score":70,"fit_tier":"good","recommendation":"apply","reasons":[],"fit_line":"x","fit_line_evidence_ids":["a"],"luna_status":"ok"}'
_EARLIER = '{"employer_type":"agency","seniority_real":null,"fit_line":"","luna_status":"unavailable"}'
cases("annotation_checks", [(t,) for t in (
    _WHOLE, _EARLIER, _WHOLE.replace("70", "170"), _WHOLE.replace("70", '"70"'), _WHOLE.replace('"x"', '""'), _EARLIER.replace("unavailable", "ok"), _WHOLE[:-1] + ',"eligibility":"blocked"}', _WHOLE[:-1] + ',"eligibility":"blocked","eligibility_reason":"r"}', _WHOLE[:-1] + ',"z":1}',
    _WHOLE.replace("good", "fine"), _WHOLE.replace('"x"', '"' + "y" * 161 + '"'), "[]", None)],
    sound=(lambda: V.sound_annotation("c0"), [True, True, False, False, False, False, False, True, False, False, False, False, False]))
cases("derived_fits", [(85, None), (60, "skip"), (59, None), (10, None), (101, None), (None, "apply")],
    tier=(lambda: V.derived_fit("c0", "c1")["tier"], ["strong", "good", "stretch", "weak", None, None]), advice=(lambda: V.derived_fit("c0", "c1")["recommendation"], ["apply", "skip", "review", "skip", None, None]))
cases("location_evidence", [("Haifa", "In Haifa, remote.", "Haifa", "In Haifa", "remote"), ("", "In Haifa.", "Haifa", "In Haifa", "on the moon"), (None, None, "Haifa", "In Haifa", None), ("", "text", "Haifa", "In Haifa", None), ("", "In Haifa.", "Berlin", "In Haifa", " ")],
    location=(lambda: V.location_evidence("c0", "c1", "c2", "c3", "c4")["location"], ["Haifa", "Haifa", "Haifa", "", ""]),
    quotes=(lambda: V.location_evidence("c0", "c1", "c2", "c3", "c4")["quotes"], [["In Haifa, remote.", "In Haifa", "remote"], ["In Haifa.", "In Haifa"], ["In Haifa"], ["text"], ["In Haifa.", "In Haifa"]]))
_CARD = (
    '<ul><li><div class="base-card job-search-card" data-entity-urn="urn:li:jobPosting:%s"><a class="base-card__full-link" href="https://x/%s?r=1"></a><h3 class="base-search-card__title"> Dev &amp; <b>Ops</b></h3>'
    '<div><h4 class="base-search-card__subtitle">Acme</h4><span class="job-search-card__location">Haifa</span><time class="job-search-card__listdate" datetime="2024-01-02">2 days ago</time></div></div></li></ul>'
)
cases("guest_cards", within=(0, "html"), given=[(_CARD % ("1", "a") + _CARD % ("2", "b"),), (_CARD % ("", "a"),), ("<p>none</p>",), (None,)],
    ids=(lambda: F.transform(V.guest_cards("c0"), lambda c: c["id"]), [["1", "2"], [], [], []]),
    titles=(lambda: F.transform(V.guest_cards("c0"), lambda c: F.concat_ws("|", c["title"], c["company"], c["location"], c["url"], c["posted_at"], c["posted_ago"])),
        [[f"Dev & Ops|Acme|Haifa|https://x/{x}|2024-01-02T00:00:00Z|2 days ago" for x in "ab"], [], [], []]))
_PAGE = '<body><script>var x = "<p>no</p>";</script><div class="description__text">Outer <div class="show-more-less-html__markup x"><h2>About &amp; us</h2><p>We  build <strong>good<br>things</strong>.</p><ul><li>One</li><li>Two<br>lines</li></ul><style>.a</style></div> after</div></body>'
cases("descriptions", within=(0, "html"), given=[(_PAGE,), (_PAGE.replace("show-more-less-html__markup x", "other"),), ("<p>none</p>",), (None,), ('<div class="show-more-less-html__markup"> </div><section class="description__text"><p>Back</p></section>',)],
    markdown=(lambda: D.description_markdown("c0"), [
        "## About & us\n\nWe build **good**\n**things**.\n\n- One\n- Two\nlines", "Outer\n## About & us\n\nWe build **good**\n**things**.\n\n- One\n- Two\nlines\n\nafter".replace("Outer\n##", "Outer\n\n##"), "", "", "Back"]),
    text=(lambda: D.description_text("c0"), ["About & us We build good things. One Two lines", "Outer About & us We build good things. One Two lines after", None, None, "Back"]))
cases("attendances", within=(0, "text"), given=[(t,) for t in (
    "We meet three days a week in the office.", "Five days a week in our office.", "This is a hybrid role.", "You may work three days a week in the office.", "Remote or hybrid, your choice.", "Some teams work 2 days per week in the office.", "During onboarding: 5 days a week in the office",
    "Hybrid cloud systems", "Hybrid", "This role is fully in-person", "Hybrid working is optional", "Hybrid working depending on team", "2 ימים בשבוע במשרד", None, "No office, but this is a hybrid position")],
    mode=(lambda: D.attendance("c0")["mode"], ["hybrid", "on-site", "hybrid", None, "unknown", None, None, None, "hybrid", "on-site", None, "unknown", "hybrid", None, "hybrid"]))
cases("company_places", within=(1, "text"), given=[("Haifa", "We are headquartered in Haifa. Work in Haifa."), ("Haifa", "Work in Haifa. Headquarters in Berlin."), ("Haifa", "The company is based in Haifa"), ("Haifa", "nothing"), ("", "x"), (None, "x"), ("C++ (x)", "Offices in C++ (x); ok")],
    vetoed=(lambda: D.names_company_place("c0", "c1"), [True, False, True, False, False, False, True]))
cases("utf16_lengths", [("abc",), ("🙂a",), ("",), (None,), ("é",)], n=(lambda: D.utf16_length("c0"), [3, 3, 0, None, 1]))
cases("address_parts", [("https://A.b/x%20y?gh_jid=12&z=1",), ("https://a.b/%zz",), ("nope",), (None,)],
    host=(lambda: D.url_parts("c0", "gh_jid")["host"], ["a.b", None, None, None]), value=(lambda: D.url_parts("c0", "gh_jid")["value"], ["12", None, None, None]), path=(lambda: D.url_parts("c0", "gh_jid")["path"], ["/x y", None, "nope", None]))

_ENTRY = '{"source":"lever","identifiers":{"account":"acme"},"company":"Acme","careers_url":"https://jobs.lever.co/acme","provenance":[{"kind":"k","reference":"r"}],"last_verified_at":"2024-01-10","enabled":true}'
cases("registry_checks", [(t,) for t in (
    _ENTRY, _ENTRY.replace('"Acme"', '" "'), _ENTRY.replace('"lever"', '"other"'), _ENTRY.replace('{"account":"acme"}', '{"board":"a b"}'), _ENTRY.replace("2024-01-10", "2025-01-10"), _ENTRY.replace("2024-01-10", "soon"), _ENTRY.replace("https://jobs.lever.co/acme", "https://jobs.lever.co/else"),
    _ENTRY.replace("https://jobs.lever.co/acme", "http://jobs.lever.co/acme"), _ENTRY.replace("https://jobs.lever.co/acme", "https://x.com/acme"), _ENTRY.replace("true}", '"yes","z":1}'), _ENTRY.replace('[{"kind":"k","reference":"r"}]', "[]"), _ENTRY.replace('"reference":"r"', '"reference":""'), "[1]", None,
    _ENTRY.replace('{"account":"acme"}', '"acme"'))],
    errors=(lambda: R.entry_errors(F.col("c0"), F.lit("2024-01-20").cast("date")), [
        [], ["company must be a non-empty string"], ["unsupported source"], ["missing tenant identifier(s): account", "unexpected identifier field(s): board", "invalid public identifier: board", "careers_url does not match tenant identifiers"], ["last_verified_at cannot be in the future"],
        ["last_verified_at must be an ISO date or timestamp"], ["careers_url does not match tenant identifiers"], ["careers_url must be a canonical public HTTPS URL"], ["careers_url host does not match source"], ["unexpected entry field(s): z", "enabled must be a boolean"],
        ["provenance must be a non-empty list"], ["each provenance item needs non-empty kind and reference"], ["entry must be an object"], ["entry must be an object"], ["identifiers must be an object"]]))
_PRINT = '{"brain":"b","extractor_version":"3","jd_sha256":"%s","model":"m","schema_sha256":"s"}'
cases("extraction_fingerprints", [(t,) for t in ("text", "é", "")], digest=(lambda: V.extraction_fingerprint(F.lit("b"), F.lit("m"), F.lit("3"), F.lit("s"), "c0"), [sha256((_PRINT % sha256(t.encode()).hexdigest()).encode()).hexdigest() for t in ("text", "é", "")]))
cases("provider_payloads", [(" 7 ", "Dev", "Acme", None, "Text", "Applied"), ("8", None, "", "Haifa", None, "who knows")],
    payload=(lambda: V.provider_payload("c0", "c1", "c2", "c3", "c4", "c5"), [
        '{"id":"7","title":"Dev","company":"Acme","location":"","jd_text":"Text","explicit_human_recommendation":"apply"}', '{"id":"8","title":"","company":"","location":"Haifa","jd_text":""}']))
