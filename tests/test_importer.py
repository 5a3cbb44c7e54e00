import json

import pytest
from pyspark.sql import functions as F

from gleaner.operators import review
from gleaner.sources import importer as I
from gleaner.sources import register as R


def ask(spark, f, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(f(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first().x


@pytest.mark.parametrize("url,want", [
    ("https://a.nl/jobs/1/?utm_source=x&b=2&a=1&fbclid=3#top", "https://a.nl/jobs/1?b=2&a=1"), ("http://a.nl/x", None), ("https://localhost/x", None), ("https://1.2.3.4/x", None), ("https://A.nl/", "https://A.nl"), (None, None),
])
def test_lead_urls(spark, url, want):
    assert ask(spark, I.lead_url, url) == want


@pytest.mark.parametrize("url,shared", [("https://a.nl/careers/", True), ("https://a.nl/jobs/page/2", True), ("https://a.nl/jobs/php-dev", False), ("https://jobs.lever.co/acme", True), ("https://jobs.lever.co/acme/1", False), ("https://careers.a.nl/", True)])
def test_shared_pages(spark, url, shared):
    assert ask(spark, I.shared_page, url) is shared


def test_keys_links_and_retries(spark):
    key = lambda *v: ask(spark, I.observation_key, *v)
    assert key("lever", "s", "acme:1", "https://jobs.lever.co/acme/1", "Acme", "Dev") == "lever:s:acme:1"
    assert key("web", "s", "", "https://a.nl/careers", "Acme BV", "PHP Dev!") == "web:s:https://a.nl/careers:role:acme%20bv%3A%3Aphp%20dev"
    assert key("web", "s", "", "https://a.nl/careers", "", "PHP") == ""
    assert ask(spark, I.resolved, "/url?q=https%3A%2F%2Fa.nl%2Fj%2F1&sa=U", "https://g.nl/x") == "https://a.nl/j/1"
    assert ask(spark, I.resolved, "/jobs/2?a=1&amp;b=2", "https://a.nl/list") == "https://a.nl/jobs/2?a=1&b=2"
    now = F.lit(1_788_000_000.0)
    at = lambda h: ask(spark, lambda c: I.retry_at(c, now), h)
    assert at("120") == 1_788_000_120.0 and at("soon") == 0 and at(None) == 0 and at("Wed, 01 Jan 2020 00:00:00 GMT") == 0 and at("Fri, 01 Jan 2100 00:00:00 GMT") > 4e9


def test_spec_urls(spark):
    rows = [("greenhouse", "acme", None), ("lever", "acme", "eu"), ("lever", "acme", None), ("wordpressjobs", "design", None), ("wordpressjobs", "other", None), ("personio", "bad/acc", None), ("teamtailor", "servebolt", None), ("none", "x", None)]
    df = spark.createDataFrame(rows, "adapter string, account string, api_region string").withColumns({"source_id": F.lit("teamtailor"), "employer": F.lit("Servebolt"), "endpoint": F.lit("https://careers.servebolt.com/jobs.rss"), "registry_source_id": F.lit("company-servebolt")})
    got = [r.u for r in df.select(I.spec_url(df).alias("u")).collect()]
    assert got[:4] == ["https://boards-api.greenhouse.io/v1/boards/acme/jobs?content=true", "https://api.eu.lever.co/v0/postings/acme?mode=json&limit=100", "https://api.lever.co/v0/postings/acme?mode=json&limit=100", "https://jobs.wordpress.net/job_category/design/feed/"]
    assert got[4:] == ["", "", "https://careers.servebolt.com/jobs.rss", ""]


def test_candidates(spark):
    body = {
        "greenhouse": {"jobs": [{"id": 1, "title": "Dev", "absolute_url": "https://x.nl/1?utm_a=1", "location": {"name": "NL"}}, {"id": 2}]},
        "ashby": {"jobs": [{"id": "a", "title": "Dev", "jobUrl": "https://x.nl/a", "workplaceType": "Hybrid"}, {"id": "b", "title": "Dev", "jobUrl": "https://x.nl/b", "isListed": False}, {"id": "c", "title": "Dev", "jobUrl": "https://x.nl/c"}]},
        "lever": [{"id": "l", "text": "Dev", "hostedUrl": "https://x.nl/l", "workplaceType": "remote"}],
        "workable": {"jobs": [{"id": "w", "title": "Dev", "url": "https://x.nl/w", "locations": [{"country": "NL"}], "telecommuting": True}]},
        "himalayas": {"jobs": [{"guid": "h", "title": "Dev", "applicationLink": "https://x.nl/h", "locationRestrictions": ["NL", {"name": "BE"}]}]},
        "smartrecruiters": {"content": [{"id": "s", "name": "Dev"}, {"id": "t", "name": "Dev", "applyUrl": "https://x.nl/t", "location": {"city": "A"}}]},
        "remoteok": [{"legal": 1}, {"id": 7, "position": "Dev", "url": "https://x.nl/o"}],
    }
    xml = {
        "personio": "<workzag-jobs><position><id>3</id><name>Dev</name><office>NL</office></position></workzag-jobs>",
        "teamtailor": "<rss><channel><item><guid>g</guid><title>Dev</title><link>https://careers.servebolt.com/jobs/12-dev</link><remoteStatus>fully</remoteStatus></item><item><title>No</title><link>https://careers.servebolt.com/jobs/13-no</link><remoteStatus>hybrid</remoteStatus></item></channel></rss>",
        "wordpressjobs": "<rss><channel><item><guid>g</guid><title>Dev</title><link>https://jobs.wordpress.net/job/dev/</link></item></channel></rss>",
    }
    rows = [(a, "ats", a, "acme", None, json.dumps(p)) for a, p in body.items()] + [(a, "ats", a, "acme", "E", p) for a, p in xml.items()]
    got = {(r.adapter, r.job_id): (r.url, r.location, r.employer) for r in I.candidates(spark.createDataFrame(rows, "source_id string, source_type string, adapter string, account string, employer string, payload string")).collect()}
    assert got == {
        ("greenhouse", "acme:1"): ("https://x.nl/1", "NL", "acme"), ("ashby", "acme:c"): ("https://x.nl/c", "", "acme"), ("lever", "acme:l"): ("https://x.nl/l", "", "acme"), ("workable", "acme:w"): ("https://x.nl/w", "Remote - NL", "acme"),
        ("himalayas", "acme:h"): ("https://x.nl/h", "NL, BE", "acme"), ("smartrecruiters", "acme:t"): ("https://x.nl/t", "A", "acme"), ("remoteok", "acme:7"): ("https://x.nl/o", "Remote", "acme"),
        ("personio", "acme:3"): ("https://acme.jobs.personio.com/job/3", "NL", "E"), ("teamtailor", "acme:12"): ("https://careers.servebolt.com/jobs/12-dev", "Remote", "E"), ("wordpressjobs", "acme:g"): ("https://jobs.wordpress.net/job/dev", "", "E"),
    }


def test_pages_and_landing_scan(spark):
    ld = json.dumps({"@graph": [{"@type": "JobPosting", "title": "WP dev", "url": "/jobs/1", "jobLocationType": "TELECOMMUTE", "hiringOrganization": {"name": "Acme"}}, {"@type": "JobPosting", "title": "Office", "url": "/jobs/2"}]})
    html = f'<script type="application/ld+json">{ld}</script><a href="/jobs/3-dev">Remote WordPress developer</a><a href="/jobs">Remote website jobs</a><a href="/jobs/3-dev">Remote WordPress developer</a><a href="mailto:x">WordPress developer</a><a href="jobs/4-x">WooCommerce specialist</a>'
    pages = spark.createDataFrame([("s", "company", "Src", "https://a.nl/x", html)], "source_id string, source_type string, source_name string, url string, html string")
    assert [(r.url, r.employer, r.location) for r in I.page_postings(pages).collect()] == [("https://a.nl/jobs/1", "Acme", "Remote")]
    assert [r.url for r in I.page_links(pages).collect()] == ["https://a.nl/jobs/3-dev"]
    sources = spark.createDataFrame([("s", "employer_direct", "Src", "https://a.nl/x", "active"), ("t", "company", "T", "https://b.nl/", "active"), ("u", "company", "U", "https://c.nl/", "retired"), ("v", "company", "V", "https://d.nl/", "active")], "source_id string, source_type string, source_name string, base_url string, status string")
    fetched = spark.createDataFrame([("https://a.nl/x", 200, "text/html", html), ("https://b.nl/", 403, "text/html", None)], "url string, http_status int, content_type string, html string")
    attempts, found = I.landing_scan(sources, sources.where("source_id = 'v'"), fetched, "2026-09-06")
    assert {r.registry_source_ids[0]: (r.success, r.failure_category, r.attempt_kind, r.candidate_links_unverified) for r in attempts.collect()} == {
        "s": (True, None, "public_html_job_link_discovery", 2), "t": (False, "authentication_or_access_required", "public_landing_probe_failed", 0),
    }
    assert {(r.url, r.employer) for r in found.collect()} == {("https://a.nl/jobs/3-dev", "Src"), ("https://a.nl/jobs/4-x", "Src")}


def test_worker_rows(spark):
    o = "ordinal int, source_id string, job_id string, title string, description string, location string, url string, employer string, published_hint string, evidence string, review_status string"
    row = lambda i, **kw: tuple({**dict(ordinal=i, source_id="s", job_id="", title="WordPress developer", description="work", location="Remote, Europe", url=f"https://a.nl/j/{i}", employer="", published_hint="2026-09-05", evidence="x", review_status="unverified"), **kw}.values())
    rows = [row(0), row(1, title="Browse all WordPress jobs"), row(2, location="Utrecht"), row(3, description="hybrid"), row(4, url="https://a.nl/j/0/"), row(5, url="https://known.nl/x"), row(6, source_id="no"), row(7, review_status="ok"), row(8, title="Marketing WordPress marketer"), row(9, location="Remote, US only"), row(10)]
    sources = spark.createDataFrame([("s", "board", "Src")], "source_id string, source_type string, source_name string")
    old = spark.createDataFrame([("public_browser:s:https://a.nl/j/10",)], "candidate_key string")
    got = I.worker_rows(spark.createDataFrame(rows, o), sources, spark.createDataFrame([("https://known.nl/x",)], "url string"), old, "wordpress_ecosystem", 1_788_652_800.0).collect()
    assert [(r.ordinal, r.employer, r.review_status) for r in got] == [(0, "Src", "needs_official_review")]
    assert got[0].review_note.startswith("Public GitHub browser-worker: x; ")
    k = I.known_urls((spark.createDataFrame([("https://a.nl/j?utm_x=1", "https://a.nl/careers")], "a string, b string"), ("a", "b")))
    assert [r.url for r in k.collect()] == ["https://a.nl/j"]
    specs = spark.createDataFrame([("s", None, 1), ("s", "e", 2), ("x", None, 3)], "source_id string, registry_source_id string, k int")
    assert {r.k for r in I.admitted_specs(specs, sources).collect()} == {1}


def test_register(spark):
    cells = [(0, 0, "source_id"), (0, 1, "status"), (0, 2, ""), (1, 0, "a"), (1, 1, "active"), (1, 2, "x"), (2, 0, " "), (3, 0, "b"), (4, 0, "c"), (4, 1, " ACTIVE ")]
    sheet = spark.createDataFrame(cells, "row int, column int, value string")
    t = R.checked_table(sheet, ("source_id", "status"))
    assert sorted((r.source_id, r.status) for r in t.collect()) == [("a", "active"), ("b", ""), ("c", " ACTIVE ")]
    assert sorted(r.source_id for r in R.active_sources(t).collect()) == ["a", "c"]
    with pytest.raises(ValueError, match="missing"):
        R.checked_table(sheet, ("nope",))
    with pytest.raises(ValueError, match="duplicate"):
        R.checked_table(sheet.union(spark.createDataFrame([(0, 9, "status")], sheet.schema)))
    with pytest.raises(Exception, match="duplicate source id"):
        R.active_sources(t.union(t)).collect()
    assert R.readable(["Bronnen", "CandidateEvidence"], True) == ["Bronnen"] and R.bounded_integer({"a": "70"}, "a", 5, 60) == 60 and R.bounded_integer({}, "a", 5, 60) == 5
    for bad in ("0", "x", "-1"):
        with pytest.raises(ValueError):
            R.bounded_integer({"a": bad}, "a", 5, 60)
    R.preflight({"dedupe": "TRUE"}, {"dedupe": "true"})
    with pytest.raises(ValueError):
        R.preflight({}, {"dedupe": "true"})
    d = lambda x, url=False: ask(spark, lambda c: R.domain(c, url), x)
    assert d("Example.NL.") == "example.nl" and d("localhost") is None and d("1.2.3.4") is None and d("https://a.nl:443/x", True) == "a.nl" and d("https://u@a.nl/x", True) is None and d("https://a.nl:8080/", True) is None and d("a.local") is None
    assert ask(spark, R.public_role_link, "https://A.nl/x?y=1#z") == "https://a.nl/x" and ask(spark, R.public_role_link, "http://a.nl/x") is None
    src = spark.createDataFrame([("a", "t", "https://a.nl")], "source_id string, source_type string, base_url string")
    log = R.check_log(src, spark.createDataFrame([("a", "1", "200", 2, "n"), ("a", "2", "404", 0, "m")], "source_id string, attempted_utc string, http_result string, remote_candidate_links int, coverage_note string"))
    assert log.columns == list(R.CHECK_LOG) and log.first().http_result == "404"
    page = R.dashboard("<t>", src.select(F.lit("<b>").alias("k")), src)
    assert "&lt;t&gt;" in page and "<b>" not in page and "https://a.nl" in page
    assert R.config_values(spark.createDataFrame([(1, "a", "1"), (2, "a", "2"), (3, "", "x")], "_row int, key string, value string")) == {"a": "2"}


def test_hints_and_ages(spark):
    terms = {"wordpress_ecosystem": ("wordpress",), "web_design_development": ("web designer",)}
    hints = lambda t, d, s: ask(spark, lambda a, b, c: review.role_hints(a, b, c, tuple(terms), terms), t, d, s)
    assert hints("WordPress Recruiter", "", "ats") == [] and hints("WordPress dev", "", "board") == ["wordpress_ecosystem"] and hints("Software Engineer", "We use WooCommerce", "ats") == ["wordpress_ecosystem"]
    assert hints("Software Engineer", "We use WooCommerce", "board") == [] and hints("Accountant", "WooCommerce", "ats") == []
    age = lambda s, p: ask(spark, lambda a, b: review.observed_age(a, b, F.lit("2026-09-06").cast("date")), s, p)
    assert age("ats", "2026-09-01T10:00:00Z") == 5 and age("board", "2026-09-01") is None and age("ats", "2026-9-1") is None


def test_candidates_beyond_the_cap_when_all_is_asked(spark):
    jobs = json.dumps([{"id": str(i), "text": "Dev", "hostedUrl": f"https://x.nl/{i}", "workplaceType": "remote"} for i in range(260)])
    raw = spark.createDataFrame([("s", "ats", "lever", "acme", None, jobs)], "source_id string, source_type string, adapter string, account string, employer string, payload string")
    assert I.candidates(raw).count() == 250 and I.candidates(raw, most=None).count() == 260
