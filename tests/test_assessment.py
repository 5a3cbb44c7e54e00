import hashlib
import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from gleaner.operators import assessment as A
from gleaner.operators.ranking import Policy

DAY = date(2026, 9, 6)
POLICY = Policy(3000, 90, 10, 40, 25, 10, frozenset({"en", "nl"}))
URL = "https://jobs.lever.co/acme/123-dev"
LD = lambda **kw: json.dumps({"@type": "JobPosting", "title": "PHP-Developer", "hiringOrganization": {"name": "Acme  BV"}, "datePosted": "2026-09-01", **kw})
FORM = "<form><input type=email name=x><input name=first_name><button>Send</button></form>"


def html(*scripts, body="<h1>php-developer at Acme</h1>", form=""):
    return "<html lang=en-GB><body>" + body + "".join(f'<script type="application/ld+json">{s}</script>' for s in scripts) + form + "</body></html>"


def canonical_digest(value):
    return hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def test_digests_are_those_of_canonical_json(spark):
    values = [{"b": 1, "a": [True, None, "é \"q\" \\ \n"], "c": {"z": -2.5, "y": {}}}, [], "text", None, 7]
    rows = spark.createDataFrame([(i, json.dumps(v, indent=2)) for i, v in enumerate(values)], "i int, j string")
    got = {r.i: r.d for r in rows.select("i", A.proof_digest(F.col("j")).alias("d")).collect()}
    assert got == {i: canonical_digest(v) for i, v in enumerate(values)}
    texts = ["claim", "with \"quotes\" and é", ""]
    got = [r.d for r in spark.createDataFrame([(t,) for t in texts], "c string").select(A.claim_digest(F.col("c")).alias("d")).collect()]
    assert got == [canonical_digest(t) for t in texts]
    one = spark.createDataFrame([("a", "1"), ("b", None)], "key string, value string")
    two = spark.createDataFrame([("b", None), ("a", "1")], "key string, value string")
    assert A.table_digest(one).first()[0] == A.table_digest(two).first()[0] != A.table_digest(one.limit(1)).first()[0]


@pytest.mark.parametrize("page,status", [
    (html(LD()), "matching_first_party_jobposting"),
    (html(LD(), LD()), "no_unique_matching_first_party_jobposting"),
    (html(LD(title="Other")), "no_unique_matching_first_party_jobposting"),
    (html(LD(hiringOrganization="Else")), "no_unique_matching_first_party_jobposting"),
    (html("{broken", LD()), "matching_first_party_jobposting"),
    (html(LD(), body="<p hidden>php-developer</p><p>Jobs</p>"), "structured_role_not_visible_on_page"),
    (html(), "no_unique_matching_first_party_jobposting"),
])
def test_page_identity(spark, page, status):
    df = spark.createDataFrame([(page, "php-Developer", "acme bv")], "html string, title string, employer string")
    r = A.page_signals(df).first()
    assert (r.status, r.page_language, r.structured is not None) == (status, "en", status.startswith("matching"))


def test_official_routes(spark):
    row = lambda k, apply=None, provider="lever": (f"https://jobs.lever.co/acme/{k}-dev", apply, "PHP-Developer", "Acme BV", provider, "acme" if provider else None)
    base = "https://jobs.lever.co/acme/"
    rows = [row(1), row(2, base + "2-dev/apply"), row(3, base + "9-dev/apply"), row(4), row(5), row(6, provider=None), row(7), row(8, "https://evil.example.org/acme/8-dev")]
    fetched = [
        (base + "1-dev", 200, html(LD(), form=FORM)), (base + "2-dev", 200, html(LD())), (base + "2-dev/apply", 200, html(form=FORM)), (base + "3-dev", 200, html(LD())),
        (base + "4-dev", 410, None), (base + "5-dev", 500, None), (base + "6-dev", 200, html(LD())), (base + "7-dev", 200, html(LD(), form="<form><input type=email><button></button></form>")), (base + "8-dev", 200, html(LD())),
    ]
    got = A.official_evidence(
        spark.createDataFrame(rows, "canonical_url string, apply_url string, title string, employer string, provider string, account string"), spark.createDataFrame(fetched, "url string, http_status int, html string")
    ).collect()
    by = {r.canonical_url.split("/")[-1][0]: (r.status, r.job_http_status, r.apply_http_status, r.application_form_detected) for r in got}
    match = "matching_first_party_jobposting"
    assert by == {
        "1": (match, 200, 200, True), "2": (match, 200, 200, True), "3": ("application_route_unverified", 200, None, False), "4": ("closed_at_exact_ats_route", 410, None, False),
        "5": ("unverified", 500, None, False), "6": ("unverified", None, None, False), "7": (match, 200, None, False), "8": ("application_route_unverified", 200, None, False),
    }


def test_official_pages_are_read_to_their_end(spark):
    base = "https://jobs.lever.co/acme/"
    long = "<p>" + "word " * 60_000 + "</p>"  # beyond 256 KB, and 100,000 characters of text
    tail = "php-developer at Acme Send"
    scripts = [LD(title=f"Other {i}") for i in range(12)] + ["[" * 200_000, json.dumps({"a": [{"b": {"c": {"d": {"e": {"f": {"g": {"h": json.loads(LD(description="x" * 100_001))}}}}}}}]})]
    deep = html(*scripts, body=long + "<h1>php-developer at Acme</h1>", form=FORM)
    row = lambda k, apply=None: (f"{base}{k}-dev", apply, "PHP-Developer", "Acme BV", "lever", "acme")
    fetched = [(base + "1-dev", 200, deep), (base + "2-dev", 200, html(LD())), (base + "2-dev/apply", 200, html(body=long, form=FORM)), (base + "3-dev", 200, html(LD()) + long + html(LD()))]
    got = A.official_evidence(
        spark.createDataFrame([row(1), row(2, base + "2-dev/apply"), row(3)], "canonical_url string, apply_url string, title string, employer string, provider string, account string"), spark.createDataFrame(fetched, "url string, http_status int, html string")
    ).collect()
    one, two, three = sorted(got, key=lambda r: r.canonical_url)
    match = "matching_first_party_jobposting"
    assert (one.status, one.structured.title, one.application_form_detected) == (match, "PHP-Developer", True)
    assert one.visible_text == one.application_visible_text == "word " * 60_000 + tail
    assert (two.status, two.application_form_detected, two.application_visible_text) == (match, True, "word " * 60_000 + "Send")
    assert (three.status, three.structured) == ("no_unique_matching_first_party_jobposting", None)


def test_long_official_pages_are_dealt_over_more_tasks(spark):
    rows = spark.createDataFrame([("https://jobs.lever.co/acme/1-dev", None, "Dev", "Acme", "lever", "acme")], "canonical_url string, apply_url string, title string, employer string, provider string, account string")
    fetched = spark.range(3).select(F.format_string("https://jobs.lever.co/acme/%s-dev", "id").alias("url"), F.lit(200).alias("http_status"), F.repeat(F.lit("<p>word</p>"), 1_250_000).alias("html"))
    plan = A.official_evidence(rows, fetched)._jdf.queryExecution().logical().toString()
    assert "RepartitionByExpression [canonical_url" in plan and "], 3" in plan.split("RepartitionByExpression [canonical_url")[1].split("\n")[0]


CLAIM = "Built WordPress plugins for ten shops"
EVIDENCE = ("e1", CLAIM, "github", "repo", "README", "high", "true", "2026-09-01")
ROW = "canonical_url string, title string, employer string, description string, visible_text string, application_visible_text string, page_date_posted string, page_language string, blockers array<string>, account_verified boolean, role_family_hints array<string>, policy_sha256 string, candidate_evidence_sha256 string, observation_sha256 string, official_page_sha256 string"


def good():
    ref = [{"evidence_id": "e1", "claim_sha256": canonical_digest(CLAIM), "source_ref": "repo", "source_status": "verified", "source_checked_on": "2026-09-06"}]
    req = lambda i, kind, **kw: {"id": i, "kind": kind, "mandatory": True, "outcome": "met", "quote": "We ask for WordPress", "rationale": "shown", "candidate_evidence": ref, **kw}
    fact = lambda v, q: {"value": v, "quote": q}
    return {
        "schema_version": 1, "reviewer": "reviewer", "reviewed_on": "2026-09-06", "canonical_url": URL, **{k: k[0] * 64 for k in ("policy_sha256", "candidate_evidence_sha256", "observation_sha256", "official_page_sha256")},
        "employer_verification": {"status": "verified", "checked_on": "2026-09-06", "employer_url": "https://acme.nl/about", "official_role_url": URL, "ownership_evidence": "imprint"},
        "facts": {"fully_remote": fact(True, "fully remote"), "netherlands_execution": fact(True, "in the Netherlands"), "original_publication": fact("2026-09-01", "posted 1 September"),
                  "application_language": fact("en", "apply in English"), "required_languages": fact(["en"], "you speak English")},
        "requirements_complete": True, "reviewed_dimensions": list(A.DIMENSIONS),
        "requirements": [req("r1", "skills"), req("r2", "languages", language="en"), req("r3", "workstyle", mandatory=False)],
        "anchors": {"core_fit": {"value": 50, "rationale": "x", "requirement_ids": ["r1"]}, "evidence_fit": {"value": 25, "rationale": "x", "requirement_ids": ["r1"]}, "workstyle_fit": {"value": 10, "rationale": "x", "requirement_ids": ["r3"]}},
        "role_families": ["wordpress_ecosystem"],
    }


def change(path, value):
    a = good()
    at = a
    for k in path[:-1]:
        at = at[k]
    at[path[-1]] = value
    return json.dumps(a)


@pytest.mark.parametrize("text,status,missing", [
    (json.dumps(good()), "verified", []),
    (None, "pending", ["specialist_evidence_assessment"]),
    ("{not json", "pending", ["specialist_evidence_assessment"]),
    (change(["reviewed_on"], "2026-09-05"), "pending", ["current_exact_role_assessment"]),
    (change(["observation_sha256"], "0" * 64), "pending", ["assessment_inputs_changed"]),
    (change(["employer_verification", "employer_url"], "https://jobs.lever.co/x"), "pending", ["independent_employer_and_ats_ownership_evidence"]),
    (change(["facts", "fully_remote", "quote"], "nowhere on the page"), "pending", ["visible_employer_fact:fully_remote"]),
    (change(["facts", "fully_remote", "value"], False), "pending", ["employer_remote_and_netherlands_confirmation"]),
    (change(["facts", "original_publication", "value"], "2026-08-01"), "pending", ["consistent_original_publication_date"]),
    (change(["facts", "required_languages", "value"], ["de"]), "pending", ["allowed_employer_languages"]),
    (change(["reviewed_dimensions"], ["skills"]), "pending", ["all_requirement_dimensions_reviewed"]),
    (change(["requirements"], []), "pending", ["complete_requirement_matrix"]),
    (change(["requirements", 0, "quote"], "made up words"), "pending", ["valid_requirement_matrix", "verified_anchor:core_fit", "verified_anchor:evidence_fit"]),
    (change(["requirements", 0, "candidate_evidence", 0, "claim_sha256"], "0" * 64), "pending", None),
    (change(["requirements", 0, "outcome"], "unknown"), "pending", ["mandatory_requirement_unknown", "verified_anchor:core_fit", "verified_anchor:evidence_fit"]),
    (change(["requirements", 1, "language"], "nl"), "pending", ["candidate_required_language_evidence"]),
    (change(["anchors", "core_fit", "value"], 49), "pending", ["verified_anchor:core_fit"]),
    (change(["anchors", "workstyle_fit", "requirement_ids"], ["r2"]), "pending", ["verified_anchor:workstyle_fit"]),
    (change(["role_families"], ["web_design_development"]), "pending", ["verified_material_role_family"]),
])
def test_validation(spark, text, status, missing):
    row = (URL, "PHP-Developer", "Acme BV", "We ask for WordPress.", "fully remote in the Netherlands posted 1 September you speak English We ask for WordPress", "apply in English", "2026-09-01", "en",
           ["verified_core_duties_and_score_anchors"], True, ["wordpress_ecosystem"], "p" * 64, "c" * 64, "o" * 64, "o" * 64)
    rows = spark.createDataFrame([row], ROW)
    notes = spark.createDataFrame([(URL, text)], "canonical_url string, assessment string")
    ev = spark.createDataFrame([EVIDENCE], "evidence_id string, claim string, source_type string, source_ref string, source_locator string, confidence string, active string, verified_at string")
    r = A.validate(rows, notes, ev, DAY, POLICY, reviewer="reviewer").first()
    assert r.status == status, r
    if missing is not None:
        own = ["verified_core_duties_and_score_anchors"] if missing and missing[0].split(":")[0] in ("specialist_evidence_assessment", "current_exact_role_assessment", "assessment_inputs_changed", "independent_employer_and_ats_ownership_evidence", "visible_employer_fact", "employer_remote_and_netherlands_confirmation", "consistent_original_publication_date", "allowed_employer_languages", "all_requirement_dimensions_reviewed", "complete_requirement_matrix") else []
        assert r.missing == own + missing
    else:
        assert "verified_candidate_requirement_evidence" in r.missing


def test_verified_mismatch_is_ineligible_and_double_assessments_fail(spark):
    row = (URL, "PHP-Developer", "Acme BV", "We ask for WordPress.", "fully remote in the Netherlands posted 1 September you speak English We ask for WordPress", "apply in English", "2026-09-01", "en",
           [], True, ["wordpress_ecosystem"], "p" * 64, "c" * 64, "o" * 64, "o" * 64)
    a = good()
    a["requirements"].append({**a["requirements"][0], "id": "r9", "outcome": "not_met"})
    ev = spark.createDataFrame([EVIDENCE], "evidence_id string, claim string, source_type string, source_ref string, source_locator string, confidence string, active string, verified_at string")
    notes = spark.createDataFrame([(URL, json.dumps(a))], "canonical_url string, assessment string")
    r = A.validate(spark.createDataFrame([row], ROW), notes, ev, DAY, POLICY, reviewer="reviewer").first()
    assert (r.status, r.reasons) == ("ineligible", ["verified_mandatory_requirement_mismatch"])
    with pytest.raises(ValueError, match="several"):
        A.validate(spark.createDataFrame([row], ROW), notes.union(notes), ev, DAY, POLICY, reviewer="reviewer")


def test_pages_and_assessments_are_dealt_by_number(spark):
    from gleaner.plans import catalog

    for name, key in (("q82_official_routes", "canonical_url"), ("q83_assessment_validation", "p_partkey")):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().logical().toString()
        assert f"RepartitionByExpression [{key}" in plan
