import json
from datetime import date

import pytest
from pyspark.sql import functions as F
from test_assessment import CLAIM, FORM, LD, good, html

from gleaner.operators import assessment as A
from gleaner.operators import evaluation as E
from gleaner.operators.ranking import Policy
from gleaner.sources import search as S

DAY = date(2026, 9, 6)
POLICY = Policy(0, 90, 10, 40, 25, 10, frozenset({"en", "nl"}))
OBS = "ordinal long, source_id string, source_type string, source_instance string, source_job_id string, canonical_url string, url string, title string, employer string, description string, location string, remote boolean, published_at string, valid_through string, listing_language string, workplace_type string, location_restrictions array<string>, apply_url string, provider string, account string"
BASE = "https://jobs.lever.co/acme/"


def obs(i, **kw):
    row = dict(ordinal=i, source_id="lever", source_type="ats", source_instance="lever:acme", source_job_id=f"acme:{i}", canonical_url=f"{BASE}{i}-dev", url=f"{BASE}{i}-dev", title="WordPress developer", employer="Acme BV", description="We ask for WordPress.",
               location="Netherlands", remote=True, published_at="2026-09-01", valid_through=None, listing_language="en", workplace_type="remote", location_restrictions=None, apply_url=None, provider="lever", account="acme")
    return tuple((row | kw).values())


def test_one_pass(spark):
    rows = [
        obs(1), obs(2, source_id="retired"), obs(3, canonical_url="https://acme.nl/careers", url="https://acme.nl/careers"), obs(4), obs(5, valid_through="2026-01-01"), obs(6, listing_language="de"), obs(7, title="Recruiter WordPress"),
        obs(8, employer="Old Co"), obs(9, provider=None, location="India"), obs(10, published_at="2026-10-01"), obs(11), obs(12, canonical_url=f"{BASE}1-dev", url=f"{BASE}1-dev", source_job_id="acme:1"),
    ]
    df = spark.createDataFrame(rows, OBS)
    page = html(LD(title="WordPress developer", jobLocationType="TELECOMMUTE", applicantLocationRequirements=[{"@type": "Country", "name": "Netherlands"}]), body="<h1>WordPress developer</h1><p>fully remote in the Netherlands posted 1 September you speak English We ask for WordPress apply in English</p>", form=FORM)
    fetched = spark.createDataFrame([(f"{BASE}1-dev", 200, page), (f"{BASE}11-dev", 410, None)], "url string, http_status int, html string")
    claims = spark.createDataFrame([("e1", CLAIM, "github", "repo", "README", "high", "true", "2026-09-01")], "evidence_id string, claim string, source_type string, source_ref string, source_locator string, confidence string, active string, verified_at string")
    config = spark.createDataFrame([("k", "v")], "key string, value string")
    known = spark.createDataFrame([(f"url:{BASE}4-dev",)], "key string")
    weak = spark.createDataFrame([("old co", "wordpress developer")], "employer string, title string")
    active = spark.createDataFrame([("lever",)], "source_id string")
    kept = df.where("ordinal = 1").withColumn("canonical_url", F.col("url"))
    seen = A.official_evidence(kept, fetched, F.lit(DAY))
    b = A.bind(kept, seen, config, claims).first().asDict()
    note = good() | {k: b[k] for k in ("policy_sha256", "candidate_evidence_sha256", "observation_sha256", "official_page_sha256")} | {"canonical_url": f"{BASE}1-dev"}
    note["employer_verification"]["official_role_url"] = f"{BASE}1-dev"
    notes = spark.createDataFrame([(f"{BASE}1-dev", json.dumps(note))], "canonical_url string, assessment string")
    out = E.evaluate(df, known, weak, active, fetched, notes, claims, config, POLICY, DAY, reviewer="reviewer")
    got = {r.ordinal: (r.reject_reason, r.status) for r in out.judged.collect()}
    assert {k: v[0] for k, v in got.items()} == {
        1: None, 2: "unapproved_source", 3: "unsafe_link", 4: "previously_registered", 5: "source_expired", 6: "explicit_mismatch", 7: "off_target", 8: "possible_prior_match", 9: "source_location_restricted", 10: "explicit_mismatch",
        11: "official_job_route_closed", 12: "duplicate",
    }
    first = out.judged.where("ordinal = 1").first()
    assert first.page_status == "matching_first_party_jobposting" and first.status in ("verified", "pending")
    if first.status == "pending":
        assert set(first.missing) <= {"netherlands_executable_from_employer", "verified_listing_language"}, first.missing
    else:
        assert [r.canonical_url for r in out.recommended.collect()] == [f"{BASE}1-dev"]
    none = E.evaluate(df, known, weak, active, fetched, notes, claims, config, POLICY, DAY, page_budget=0, reviewer="reviewer")
    assert none.judged.where("ordinal = 1").first().missing == ["official_page_check_budget_reached"]


def test_batches_until_the_target(spark, monkeypatch):
    seen = []

    def judge(rows, *, policy):
        seen.append(sorted(r.source_instance for r in rows.collect()))
        return E.Evaluation(rows, rows.where("good"), rows)

    monkeypatch.setattr(E, "evaluate", judge)
    rows = spark.createDataFrame([("a", False), ("b", True), ("c", True), ("d", True), ("x", True)], "source_instance string, good boolean")
    plan = spark.createDataFrame([("a", 0), ("b", 1), ("c", 1), ("d", 2), ("b", 2)], "source_instance string, batch int")
    got = E.one_pass(rows, plan, target=2, policy=1)
    assert (got.rounds, got.stop_reason, seen) == ([(0, 0), (1, 2)], "verified_target_reached", [["a"], ["a", "b", "c"]])
    got = E.one_pass(rows, plan, target=9, policy=1)
    assert (got.rounds, got.stop_reason) == ([(0, 0), (1, 2), (2, 3)], "planned_sources_exhausted")
    assert E.one_pass(rows, plan, target=1, exhaustive=True, policy=1).rounds == [(2, 3)]
    none = E.one_pass(rows, plan.limit(0), target=1, policy=1)
    assert (none.rounds, none.evaluation.judged.count()) == ([], 0)


def test_requests_take_turns(spark):
    q = spark.createDataFrame([(0, "first query"), (1, " second query"), (2, "first query")], "query_index int, query string")
    assert [(r.query, r.page) for r in S.request_plan(q, 2, 3).orderBy("turn").collect()] == [("first query", 1), ("second query", 1), ("first query", 2)]
    for bad in ([(0, "ab")], [], [(i, f"query {i}") for i in range(21)]):
        with pytest.raises(ValueError):
            S.request_plan(spark.createDataFrame(bad, "query_index int, query string"))
    with pytest.raises(ValueError):
        S.request_plan(q, 11, 3)


def test_answers(spark):
    hit = lambda *u: json.dumps({"organic_results": [{"link": x, "title": f"t {x}", "snippet": "s"} for x in u] + ["odd"]})
    none = json.dumps({"error": "Google hasn't returned any results for this query.", "search_metadata": {"status": "Success"}, "search_information": {"organic_results_state": "Fully empty"}})
    a = [("q1", 1, 0, hit("https://a.nl/j/1", "http://b.nl/2", "https://a.nl/j/3")), ("q2", 1, 1, none), ("q1", 2, 2, hit("https://a.nl/j/1?utm_source=x", "https://jobs.lever.co/acme/4")), ("q2", 2, 3, hit("https://late.nl/5"))]
    kind = "query string, page int, turn int, payload string"
    rows, outcome = S.results(spark.createDataFrame(a, kind), "2026-09-06")
    assert [(r.url, r.query, r.result_page) for r in rows.orderBy("result_page", "url").collect()] == [("https://a.nl/j/1", "q1", 1), ("https://a.nl/j/3", "q1", 1), ("https://jobs.lever.co/acme/4", "q1", 2)]
    assert tuple(outcome.first()) == (True, None, 3) and rows.where("ats_hint.provider = 'lever'").count() == 1
    for payload, category in ((json.dumps({"error": "no"}), "provider_error"), ("{}", "malformed_result"), ("{", "malformed_result")):
        rows, outcome = S.results(spark.createDataFrame([*a, ("q1", 3, 4, payload)], kind), "x")
        assert (outcome.first().success, outcome.first().failure_category, rows.count()) == (False, category, 0)
