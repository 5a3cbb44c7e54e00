from datetime import date

from pyspark.sql import functions as F

from gleaner import cli
from gleaner.operators import evidence, leads, ranking

TODAY = date(2026, 9, 6)
POLICY = ranking.Policy(0, 30, 10, 0, 0, 0, frozenset({"en", "nl"}))
PAGE = "id int, official_role string, page_status string, date_posted string, expired boolean, remote_check string, remote_signal boolean, visible_text string, netherlands string, applicant_locations array<string>, apply_http_status int, form_detected boolean, page_language string, application_language string, requirement_status string, technical_requirements int"
GOOD = (1, "confirmed_current_public_ats", evidence.MATCHING, "2026-09-01", False, "confirmed", True, "Travel up to 30% is possible.", "allowed", ["Netherlands"], 200, True, "en", "nl", "mapped_skills_have_evidence", 2)


def test_blockers_and_exclusion(spark):
    bad = (2, None, evidence.MATCHING, "2026-07-01", True, "confirmed", None, "You travel 40% of your time.", "allowed", ["India"], 404, True, "de", None, None, None)
    closed = (3, None, "closed_at_exact_ats_route", *[None] * 13)
    df = spark.createDataFrame([GOOD, bad, closed], PAGE).select("id", evidence.blockers(TODAY, POLICY).alias("b"), evidence.page_exclusion(TODAY, POLICY).alias("x")).orderBy("id").collect()
    assert df[0].b == ["employer_required_work_languages", "verified_core_duties_and_score_anchors"] and df[0].x is None
    assert df[1].b == [
        "official_employer_and_exact_role", "valid_original_publication_date", "unexpired_official_role", "fully_remote_from_first_party", "substantial_required_travel", "netherlands_executable_from_employer",
        "verified_application_form_at_exact_route", "verified_listing_language", "employer_authorized_application_language", "employer_required_work_languages", "complete_candidate_requirement_evidence",
        "verified_core_duties_and_score_anchors",
    ]
    assert (df[1].x, df[2].x) == ("official_job_expired", "official_job_route_closed") and "original_publication_date" in df[2].b


def test_travel_and_residency(spark):
    travel = [("Travelling for customers 25-30 % of the time", True), ("Travel up to 50%.", False), ("travel costs: 100% reimbursed", False), ("travel 15%", False), ("20% of the team likes travel", False), ("travel. Also 40%", False), (None, False), ("travel 10%, later travel 20%", True)]
    got = spark.createDataFrame(travel, "t string, want boolean").select("want", evidence.substantial_travel(F.col("t")).alias("x")).collect()
    assert [r.x for r in got] == [r.want for r in got]
    live = [("We are only considering experienced candidates based in the United States.", True), ("Applicants must currently be located in Canada", True), ("Our office is in Canada", False), ("Employees must reside in the EU", False), (None, False)]
    got = spark.createDataFrame(live, "t string, want boolean").select("want", evidence.exclusive_residency(F.col("t")).alias("x")).collect()
    assert [r.x for r in got] == [r.want for r in got]


def test_official_status(spark):
    df = spark.createDataFrame([(True, "Remote, Europe", None, None, "2026-07-01", "en"), (False, "x", True, None, None, None), (True, "Hybrid", None, "x", "2026-09-09", "de")], "from_official_feed boolean, location string, remote boolean, workplace_type string, published_at string, listing_language string")
    got = [tuple(r[0]) for r in df.select(evidence.official_status(TODAY, POLICY).alias("s")).collect()]
    assert got[0][2:5] == ("needs_structured_confirmation", "allowed", "too_old") and got[1] == ("unverified", "unknown", "unknown", "unknown", "unknown", "unknown") and got[2][2:5] == ("not_remote", "unknown", "future_publication_invalid")


def test_leads(spark):
    rows = [("q", 0, "Remote WordPress developer", "fully remote", "https://a.example/role/1#x"), ("q", 1, "Remote WordPress developer", "again", "https://a.example/role/1"), ("q", 2, "Remote WordPress jobs", "list", "https://a.example/role/2"), ("q", 3, "WordPress designer", "hybrid remote", "https://a.example/role/3"), ("q", 4, "WordPress designer", "remote", "https://a.example/jobs/"), ("q", 5, "WordPress designer", "remote", "http://a.example/role/5")]
    got = leads.metasearch_leads(spark.createDataFrame(rows, "query string, position int, title string, content string, url string")).collect()
    assert [(r.position, r.url) for r in got] == [(0, "https://a.example/role/1")]
    found = spark.createDataFrame([(0, "u", "plain"), (1, "v", "plain"), (2, "u", "JobPosting a"), (3, "u", "JobPosting b"), (4, "v", "other")], "ordinal int, url string, evidence string")
    saved = leads.report_leads(found)
    assert [(r.url, r.ordinal) for r in saved.collect()] == [("u", 3), ("v", 1)]
    s = spark.createDataFrame([("a", "ua", "2026", "http_200", "rendered"), ("b", "ub", "", "http_500", "")], "source_id string, url string, checked_at string, status string, browser string")
    assert tuple(leads.report_summary(s, found, saved).first()) == (2, 1, 1, 1, 5, 2)
    reg = spark.createDataFrame([("a", "ua"), ("b", "ub")], "source_id string, url string")
    assert leads.report_faults(F.lit("2026-09-06T11:00:00Z"), s, reg, "2026-09-06T12:00:00Z").first().faults == []
    assert leads.report_faults(F.lit("2026-09-06T01:00:00Z"), s, reg.limit(1), "2026-09-06T12:00:00Z").first().faults == ["stale_or_future", "source_inventory"]


def test_rank_document(spark):
    v = {"title": "A", "url": "u", "posted_date": "2026-09-01", "fully_remote": True, "geography_compatible": True, "wordpress_related": True, "listing_language": "en", "application_language": "en", "required_languages": [], "core_fit": 50, "evidence_fit": 25, "workstyle_fit": 15, "salary_monthly_eur": 4000}
    policy = {"min_monthly_salary_eur": 0, "max_posting_age_days": 30, "max_output_roles": 5, "min_output_score": 0, "min_core_fit": 0, "min_evidence_fit": 0, "allowed_listing_languages": "en,nl"}
    out = cli.rank(spark, {"today": "2026-09-06", "policy": policy, "vacancies": [v, v | {"title": "B", "salary_monthly_eur": "4000"}, v | {"title": "C", "salary_monthly_eur": None}, "odd", v | {"title": "D", "fully_remote": 1}]})
    assert [(r["title"], r["score"]) for r in out] == [("A", 100.0), ("C", 100.0)]
