from datetime import date

import pytest
from pyspark.sql import functions as F

from gleaner.operators import ranking

TODAY = date(2026, 9, 6)
POLICY = ranking.Policy(3000, 30, 10, 60, 40, 18, frozenset({"en", "nl"}))
BASE = {
    "title": "A", "url": "https://x.example/a", "posted_date": "2026-09-01", "fully_remote": True, "geography_compatible": True, "wordpress_related": True, "central_hard_mismatch": False,
    "listing_language": "en", "application_language": "nl-NL", "required_languages": ["english"], "core_fit": 50.0, "evidence_fit": 25.0, "workstyle_fit": 15.0,
    "salary": "4000", "low": None, "high": None,
}
SCHEMA = (
    "title string, url string, posted_date string, fully_remote boolean, geography_compatible boolean, wordpress_related boolean, central_hard_mismatch boolean, listing_language string,"
    "application_language string, required_languages array<string>, core_fit double, evidence_fit double, workstyle_fit double, salary string, low string, high string"
)


def frame(spark, *changes):
    rows = [tuple((BASE | {"title": str(i)} | c)[f.split()[0]] for f in SCHEMA.replace(",", ", ").split(", ") if f.strip()) for i, c in enumerate(changes)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name, src in (("salary_monthly_eur", "salary"), ("salary_min_monthly_eur", "low"), ("salary_max_monthly_eur", "high")):
        df = df.withColumn(name, F.try_parse_json(src))
    return df.drop("salary", "low", "high")


@pytest.mark.parametrize("change,reasons", [
    ({}, []),
    ({"posted_date": "2026-08-20Tignore"}, ["date_invalid"]),
    ({"posted_date": "2026-8-20"}, ["date_invalid"]),
    ({"posted_date": "2026-08-20T10:00:00+02:99"}, ["date_invalid"]),
    ({"posted_date": "2026-09-07"}, ["future_date"]),
    ({"posted_date": "2026-08-07"}, []),
    ({"posted_date": "2026-08-06"}, ["older_than_max_age"]),
    ({"posted_date": None}, []),
    ({"fully_remote": None, "geography_compatible": False}, ["not_remote", "country_restriction"]),
    ({"wordpress_related": None, "central_hard_mismatch": True}, ["not_wordpress_related", "central_hard_mismatch"]),
    ({"listing_language": " ", "application_language": "de"}, ["listing_language_missing", "application_language_not_allowed"]),
    ({"required_languages": None}, ["required_languages_invalid"]),
    ({"required_languages": []}, []),
    ({"required_languages": ["en", "fr"]}, ["required_language_not_allowed"]),
    ({"salary": '"4500"'}, ["salary_invalid"]),
    ({"salary": "true"}, ["salary_invalid"]),
    ({"salary": "-1"}, ["salary_invalid"]),
    ({"low": "1", "high": "2"}, ["salary_invalid"]),
    ({"salary": None, "low": "5", "high": "2"}, ["salary_invalid"]),
    ({"salary": None, "low": "5"}, []),
])
def test_reasons(spark, change, reasons):
    assert ranking.eligibility(frame(spark, change), TODAY, POLICY).select("gate.reasons").first()[0] == reasons


def test_order_and_tiers(spark):
    df = frame(spark, {"salary": None}, {"posted_date": "2026-08-10"}, {}, {"url": "https://x.example/b"}, {"posted_date": None}, {"core_fit": 41.0}, {"core_fit": 25.0})
    assert [r.title for r in ranking.top_vacancies(df, TODAY, POLICY).collect()] == ["3", "2", "1", "0"]
    shuffled = df.orderBy(F.desc("title"))
    assert [r.title for r in ranking.top_vacancies(shuffled, TODAY, POLICY).collect()] == ["3", "2", "1", "0"]


def test_policy_is_checked_first():
    good = {"min_monthly_salary_eur": "0", "max_posting_age_days": 7, "max_output_roles": 5, "min_output_score": 1, "min_core_fit": 1, "min_evidence_fit": 1, "allowed_listing_languages": "Dutch, en-GB"}
    assert ranking.Policy.from_config(good).allowed_listing_languages == {"nl", "en"}
    for bad in ({"max_output_roles": 0}, {"max_posting_age_days": 1.5}, {"min_core_fit": "x"}, {"min_core_fit": True}, {"allowed_listing_languages": ""}, {"target_role_families": "cook"}):
        with pytest.raises(ValueError):
            ranking.Policy.from_config(good | bad)


def test_opportunity_edges(spark):
    rows = [(1.0, "employer", 10, 72.0, True), (1.01, "ats", 11, 72.5, False), (None, "other", None, None, False)]
    df = spark.createDataFrame(rows, "age double, route string, n int, deadline double, ok boolean")
    got = df.select(ranking.opportunity(F.col("age"), F.col("route"), F.col("n"), F.col("deadline"), F.col("ok")).alias("o")).select("o.score", "o.warnings").collect()
    assert [r.score for r in got] == [100, 32 + 23 + 17 + 8, 8 + 8 + 8 + 4]
    assert got[2].warnings == ["freshness_unknown", "applicant_count_unknown", "deadline_unknown"]


def test_gate_plan_holds_each_part_once(spark):
    from gleaner.plans import catalog

    plan = catalog.QUERIES["q02_eligibility_reasons"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert len(plan) < 15_000 and plan.count("ArrowEvalPython") == 0 and "Exchange" not in plan
