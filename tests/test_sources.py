import json

from pyspark.sql import functions as F

from gleaner.operators import requirements, review
from gleaner.sources import pages, providers

RAW = "source_id string, source_type string, adapter string, account string, employer string, endpoint string, listing_language string, max_jobs int, page int, payload string"
RSS = "<rss><channel><item><title>Acme: Dev</title><link>https://x.example/jobs/1</link><guid>g1</guid><pubDate>Tue, 01 Sep 2026 10:00:00 +0200</pubDate><category>a</category><category>b</category></item></channel></rss>"
PAYLOADS = {
    "greenhouse": {"jobs": [{"id": 1, "title": " Dev ", "absolute_url": "https://x.example/1", "location": {"name": "NL"}, "content": "<p>A &amp; B</p>", "first_published": "2026-09-01"}, {"id": 2}, "odd"]},
    "lever": [{"id": "l", "text": "Dev", "hostedUrl": "https://x.example/l", "categories": {"location": "NL"}, "workplaceType": "remote", "salaryRange": {"min": 1}}],
    "ashby": {"jobs": [{"id": "a", "title": "Dev", "jobUrl": "https://x.example/a", "workplaceType": "Hybrid"}, {"id": "b", "title": "Gone", "jobUrl": "https://x.example/b", "isListed": False}]},
    "smartrecruiters": {"postings": [{"id": "s", "name": "Dev", "applyUrl": "https://x.example/s", "location": {"city": "A", "country": "nl", "remote": True}}]},
    "workable": {"jobs": [{"shortcode": "w", "title": "Dev", "url": "https://x.example/w", "locations": [{"city": "A"}, {"city": "B", "country": "NL"}]}]},
    "himalayas": {"jobs": [{"guid": "h", "title": "Dev", "applicationLink": "https://x.example/h", "companyName": "Acme", "locationRestrictions": ["NL", {"name": "BE"}], "minSalary": 5}]},
    "jobicy": {"jobs": [{"id": 5, "jobTitle": "Dev", "url": "https://x.example/j", "companyName": "Acme", "jobType": ["full-time"]}]},
    "remotive": {"jobs": [{"id": 6, "title": "Dev", "url": "https://x.example/r", "company_name": "Acme"}]},
    "remoteok": [{"legal": "x"}, {"id": "7", "position": "Dev", "url": "https://x.example/o", "company": "Acme", "salary_min": 0, "salary_max": 0}],
    "publicfeed": {"data": [{"slug": "p", "title": "Dev", "url": "https://x.example/p", "company_name": "Acme", "remote": True}, {"slug": "q", "title": "Office", "url": "https://x.example/q", "remote": False}]},
    "workingnomads": [{"url": "https://www.workingnomads.com/job/go/123/", "title": "Dev", "company_name": "Acme", "pub_date": "2026-09-01"}],
    "personio": "<workzag-jobs><position><id>3</id><name>Dev</name><office>Remote NL</office><jobDescriptions><jobDescription><name>You</name><value>&lt;b&gt;PHP&lt;/b&gt;</value></jobDescription></jobDescriptions></position></workzag-jobs>",
    "weworkremotely": RSS, "wordpressjobs": RSS, "teamtailor": RSS, "jobicy_rss": RSS,
}


def test_every_provider(spark):
    rows = [(f"s-{a}", "ats", a, "acct", None, None, "en", 50, 0, p if isinstance(p, str) else json.dumps(p)) for a, p in PAYLOADS.items()]
    rows.append(("s-bad", "ats", "greenhouse", "acct", None, None, "en", 50, 0, "{not json"))
    got = {}
    for r in providers.observations(spark.createDataFrame(rows, RAW), "2026-09-06T00:00:00+00:00").collect():
        got.setdefault(r.provider, []).append(r)
    assert {a: len(x) for a, x in got.items()} == dict.fromkeys(PAYLOADS, 1)
    one = {a: x[0] for a, x in got.items()}
    assert (one["greenhouse"].title, one["greenhouse"].description, one["greenhouse"].source_job_id) == ("Dev", "A & B", "acct:1")
    assert (one["lever"].remote, one["ashby"].remote, one["greenhouse"].remote, one["personio"].remote) == (True, False, None, True)
    assert (one["himalayas"].location, one["workable"].location) == ("NL, BE", "A / B, NL")
    assert (one["weworkremotely"].employer, one["weworkremotely"].title, one["weworkremotely"].published_at) == ("Acme", "Dev", "2026-09-01T08:00:00+00:00")
    assert one["remoteok"].salary is None and json.loads(one["himalayas"].salary)["min"] == "5"


def test_pages(spark):
    html = '<html lang="nl"><head><title>t</title><script type="application/ld+json">{"@graph":[{"@type":"JobPosting","title":"Dev","hiringOrganization":{"name":"Acme"},"employmentType":["B","A","A"]}]}</script></head><body><p>See &eacute;n<div hidden>no <form></form></div><a href="/a">one <b>two</b></a><br></body>'
    df = spark.createDataFrame([(1, html), (2, None), (3, "<a <<<")], "page_id int, html string").withColumn("p", pages.page(F.col("html"))).withColumn("a", pages.anchors(F.col("html")))
    r = df.where("page_id = 1").select("p.*", "a", pages.job_postings(F.col("p.json_ld")).alias("j")).first()
    assert (r.lang, r.text, r.has_form, [tuple(a) for a in r.a], len(r.j)) == ("nl", "t See én one two", False, [("/a", "one two")], 1)
    s = df.where("page_id = 1").select(pages.posting_signals(pages.job_postings(F.col("p.json_ld"))[0]).alias("s")).first().s
    assert (s.title, s.hiring_organization, s.employment_types) == ("Dev", "Acme", ["A", "B"])
    assert df.count() == 3


def plain_signals(v, today):
    """The same signals from the parsed JSON, case by case."""
    from datetime import date, datetime

    text = lambda x: (" ".join(x.split()) or None) if isinstance(x, str) else None
    items = lambda x: x if isinstance(x, list) else [x]
    named = lambda x: text(x) if isinstance(x, str) else text(x.get("name")) if isinstance(x, dict) else None
    number = lambda x: float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else None
    several = lambda x, f: sorted({y for i in items(x) if (y := f(i))})
    has = lambda x, w: any(isinstance(i, str) and i.lower() == w for i in items(x))

    def day(x):
        try:
            return datetime.fromisoformat(x.strip()).date() if isinstance(x, str) and len(x.strip()) >= 10 else None
        except ValueError:
            return None

    posted, through, pay, ident = v.get("datePosted"), v.get("validThrough"), v.get("baseSalary"), v.get("identifier")
    value = pay.get("value") if isinstance(pay, dict) and isinstance(pay.get("value"), dict) else {}
    iso = lambda d: d.isoformat() if d else None
    return (
        "1.0", has(v.get("@type"), "jobposting"), text(ident) if isinstance(ident, str) else (text(ident.get("value")) or text(ident.get("name"))) if isinstance(ident, dict) else None, text(v.get("title")), named(v.get("hiringOrganization")),
        iso(day(posted)), None if posted is None else day(posted) is not None, day(posted) > today if day(posted) else None, iso(day(through)), None if through is None else day(through) is not None, day(through) < today if day(through) else None,
        has(v.get("jobLocationType"), "telecommute"), several(v.get("applicantLocationRequirements"), named), several(v.get("jobLocation"), named), several(v.get("employmentType"), text),
        v.get("directApply") if isinstance(v.get("directApply"), bool) else None, pay is not None, text(pay.get("currency")) if isinstance(pay, dict) else None, text(value.get("unitText")), number(value.get("value")), number(value.get("minValue")), number(value.get("maxValue")),
    )


def test_posting_signals_by_type(spark):
    import datetime
    import itertools
    import random

    rng, today = random.Random(4), datetime.date(2026, 9, 6)
    some = [None, "", "  a  b ", 7, True, {"name": " N "}, {"value": "v", "name": "n"}, {"value": 3}, ["x", {"name": "y"}, 3, None, "x"], [], [["z"]]]
    days = [None, "2026-09-07", " 2026-09-05T10:00:00+02:00 ", "2026-9-5", 20260905, "2026-13-01", "soon"]
    pays = [None, 5, "5", {}, {"currency": " EUR ", "value": 3}, {"currency": 3, "value": {"unitText": "YEAR", "value": 1.5, "minValue": "2", "maxValue": True}}, {"value": {"minValue": 10, "maxValue": 2e3}}, [{"currency": "EUR"}]]
    postings = []
    for _ in range(150):
        v = {k: rng.choice(some) for k in ("identifier", "title", "hiringOrganization", "applicantLocationRequirements", "jobLocation", "employmentType", "directApply")}
        v |= {"datePosted": rng.choice(days), "validThrough": rng.choice(days), "baseSalary": rng.choice(pays), "@type": rng.choice(["JobPosting", ["Thing", "jobposting"], None, 3]), "jobLocationType": rng.choice(["TELECOMMUTE", ["x", "Telecommute"], None, {}])}
        postings.append({k: x for k, x in v.items() if x is not None or rng.random() < 0.5})
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(postings)] + [(-1, "{broken"), (-2, None)], "i int, j string")
    got = {r.i: tuple(r.s) for r in df.select("i", pages.posting_signals(F.col("j"), F.lit(today)).alias("s")).collect()}
    for i, v in itertools.chain(enumerate(postings), ((-1, {}), (-2, {}))):
        assert got[i] == plain_signals(v, today), v


def test_requirements_and_geography(spark):
    text = "About us: we love Ruby. Requirements: PHP and WordPress. React or Vue. 3 years of Python. Nice to have: Docker.\nKnowledge of MySQL is needed."
    c = requirements.requirement_clauses(spark.createDataFrame([(1, text)], "ordinal long, description string"))
    got = [(r.tags, r.uncertain) for r in c.orderBy("line").collect()]
    assert (["php", "wordpress"], 0) in got and (["mysql"], 0) in got and not any("docker" in t or "ruby" in t for t, _ in got)
    n = requirements.requirement_counts(c, ["php", "wordpress"]).first()
    assert (n.required, n.matched, n.unmatched, n.unresolved) == (3, 1, 2, 2)
    geo = {"Remote": "unknown", "": "unknown", "Worldwide": "allowed", "worldwide except the EU": "restricted", "Remote, India": "restricted", None: "unknown"}
    df = spark.createDataFrame([(g,) for g in geo], "l string").select("l", requirements.geography(F.col("l")).alias("g"))
    assert {r.l: r.g for r in df.collect()} == geo
    cells = spark.createDataFrame([("=1+1",), ("ok",), (None,)], "x string").select(review.safe_cell(F.col("x")).alias("y"))
    assert [r.y for r in cells.collect()] == ["'=1+1", "ok", ""]


def test_quarantine_and_runs(spark):
    good = lambda k: {"slug": k, "title": "Dev", "url": f"https://www.arbeitnow.com/jobs/{k}", "remote": True}
    odd = [{**good("a"), "slug": s, "url": u} for s, u in (("x", "https://evil.example/jobs"), ("y", "https://arbeitnow.co.uk/j"), ("z", "http://www.arbeitnow.com/j"))]
    feed = {"data": [good("a"), good("a"), *odd, {"slug": "n"}, "text", good("b")]}
    rows = [
        ("arbeitnow-api", "board", "publicfeed", "main", None, None, "en", 50, 0, json.dumps(feed)), ("remotejobs-org", "board", "publicfeed", "main", None, None, "en", 50, 0, json.dumps(feed)),
        ("greenhouse", "ats", "greenhouse", "acme", None, None, "en", 2, 0, json.dumps(PAYLOADS["greenhouse"])), ("lever", "ats", "lever", "acme", None, None, "en", 9, 0, json.dumps(PAYLOADS["lever"])),
        ("ashby", "ats", "ashby", "acme", None, None, "en", 9, 0, "{broken"),
    ]
    got = providers.records(spark.createDataFrame(rows, RAW), "2026-09-06T00:00:00+00:00").cache()
    problems = sorted((r.source_id, str(r.problem)) for r in got.where("provider = 'publicfeed' and source_id = 'arbeitnow-api'").collect())
    assert [p for _, p in problems] == sorted(["None", "repeated", "untrusted_host", "uk_apex", "malformed", "filtered", "filtered", "None"])
    by = {r.source_instance + r.registry_source_ids[0]: r for r in providers.runs(got, "2026-09-06").collect()}
    a, b, g, v, h = (by[k] for k in ("publicfeed:mainarbeitnow-api", "publicfeed:mainremotejobs-org", "greenhouse:acmegreenhouse", "lever:acmelever", "ashby:acmeashby"))
    assert (a.success, a.normalized, a.quarantine_count, a.complete_snapshot) == (True, 2, 3, False)
    assert (b.success, b.normalized, b.failure_message) == (False, 0, "Unexpected public feed job URL: malformed")
    assert (g.success, g.fetched, g.complete_snapshot, v.complete_snapshot) == (True, 2, False, True)
    assert (h.success, h.failure_category, h.failure_message) == (False, "parsing_or_adapter_failure", "malformed_json")
    doc = providers.batch_document(providers.runs(got, "x"), got, got.where("problem is null").withColumn("ingestion_change", F.lit("new"))).first()
    assert (doc.sources, doc.successes, len(doc.runs)) == (5, 3, 5) and {o.source_id for o in doc.observations} == {"arbeitnow-api", "greenhouse", "lever"}
    ids = spark.createDataFrame([("s", '"x"'), ("s", '["b", " a ", "s", ""]'), ("s", None), ("s", "{}")], "i string, o string").select(providers.spec_registry_ids(F.col("i"), F.try_parse_json("o")).alias("r"))
    assert [r.r for r in ids.collect()] == [["s", "x"], ["a", "b", "s"], ["s"], ["s"]]


def test_clauses_languages_and_years(spark):
    ask = lambda f, x: spark.createDataFrame([(x,)], "x string").select(f(F.col("x")).alias("y")).first().y
    spec = lambda x, candidate=False: [tuple(s) for s in ask(lambda c: requirements.language_specs(c, candidate), x)]
    assert spec("Fluent English and Dutch B2") == [("en", "fluent"), ("nl", "b2")] and spec("English, Dutch") == [("en", "unparsed"), ("nl", "unparsed")] and spec("English C1 or native") == [("en", "unparsed")]
    assert spec("English is nice") == [("en", "unspecified")] and spec("English is nice", True) == [] and spec("I speak English", True) == [("en", "unspecified")] and spec("English, Dutch", True) == [] and spec("PHP") == []
    years = lambda x: ask(requirements.scoped_years, x)
    assert tuple(years("3+ years of experience with PHP")) == (3.0, "php") and tuple(years("2.5 jaar ervaring met Docker")) == (2.5, "docker") and tuple(years("4 years of strong PHP experience")) == (4.0, "php")
    assert years("3 years of experience with PHP or Python") is None and years("3 years PHP, 2 years Docker") is None and years("PHP, 5 years old") is None and years("3 years of experience with PHP and Docker") is None
    level = spark.createDataFrame([("c1", "c2", True), ("c2", "c1", False), ("fluent", "fluent", True), ("fluent", "c2", False), ("unspecified", "a1", True), ("unparsed", "unparsed", False)], "r string, h string, want boolean")
    assert all(x.want == x.got for x in level.select("want", requirements.level_matches(F.col("r"), F.col("h")).alias("got")).collect())
    tags = lambda x: ask(requirements.skill_tags, x)
    assert tags("git_flow and github") == ["git"] and tags("git-flow") == ["git"] and tags("legit") == []


def test_evidence_and_dimensions(spark):
    kind = "evidence_id string, claim string, source_type string, source_ref string, source_locator string, confidence string, active string, verified_at string"
    row = lambda i, claim="Built WordPress plugins", **kw: tuple({**dict(evidence_id=i, claim=claim, source_type="github", source_ref="r", source_locator="l", confidence="high", active="TRUE", verified_at="2026-01-01"), **kw}.values())
    rows = [row("a"), row("b"), row("b"), row("c", confidence="low"), row("d", active="no"), row("e", verified_at="2027-01-01"), row("f", claim="No experience with php"), row("g", source_type="library_cv"), row("h", source_type="library_cv", source_ref="file_" + "0" * 32), row("i", source_type="canonical_cv"), row("j", claim="I plan to learn PHP"), row("k", verified_at="soon")]
    df = spark.createDataFrame(rows, kind)
    assert sorted(r.evidence_id for r in requirements.verified_evidence(df, "2026-09-06").collect()) == ["a", "h"]
    assert sorted(r.evidence_id for r in requirements.verified_evidence(df, "2026-09-06", "r").collect()) == ["a", "h", "i"]
    assert requirements.strong_evidence_count(df, ["wordpress_ecosystem"]).first()[0] == 6
    text = "About us\nWe like Python.\nRequirements: 3 years of experience with PHP. Fluent English and Dutch B2. Portfolio of WordPress projects. No experience required with Ruby.\nNice to have: Docker.\nResponsibilities: You build WordPress plugins. We are async-first."
    said = spark.createDataFrame([("I have 4 years of experience with PHP.",), ("I speak native English. Dutch C1.",), ("Built WordPress plugins.",), ("Not familiar with Docker",)], "claim string")
    got = {(r.dimension, r.item or (r.skills or [""])[0], r.level): r.candidate_evidence for r in requirements.requirement_dimensions(spark.createDataFrame([(1, text)], "ordinal int, description string"), said).collect()}
    assert got == {
        ("mandatory_skills", "php", None): "present", ("mandatory_skills", "wordpress", None): "present", ("experience_years", "php", None): "present", ("languages", "en", "fluent"): "unknown", ("languages", "nl", "b2"): "present",
        ("projects", "wordpress", None): "present", ("optional_skills", "docker", None): "unknown", ("responsibilities", "develop", None): "present", ("work_style", "asynchronous_collaboration", None): "unknown",
    }
    place = lambda loc, rest, text, kind="board", ats=False: spark.createDataFrame([(loc, rest, text, kind)], "l string, r array<string>, d string, k string").select(requirements.region_conflict(F.col("l"), F.col("r"), F.col("d"), F.col("k"), ats).alias("x")).first().x
    assert place("Remote", ["USA", "Canada"], "") == "explicit_discovery_region_list" and place("India", None, "") == "restricted_discovery_location" and place("Remote", ["USA", "Europe"], "") is None
    assert place("Remote", None, "We only hire people in Brazil") == "explicit_discovery_residency_requirement" and place("Europe", None, "We only hire people in Brazil") is None
    assert place("India", None, "", "ats") is None and place("India", None, "", "ats", True) == "restricted_discovery_location"


def test_relevance_and_reasons(spark):
    rel = lambda t, d: spark.createDataFrame([(t, d)], "t string, d string").select(review.relevant(F.col("t"), F.col("d"), F.lit("")).alias("x")).first().x
    assert rel("Web developer", "work with WordPress") and not rel("Web developer", "WordPress is what we work with") and rel("Web developer", "WordPress sites to build") and not rel("Head of WordPress", "")
    lead = lambda loc, d: spark.createDataFrame([(loc, d)], "l string, d string").select(review.lead_status(F.lit(1000.0), F.col("l"), F.col("d"), F.lit(2000.0)).alias("x")).first().x
    assert tuple(lead("Remote", "work anywhere in Europe")) == ("remote_nl_unknown_review", False, "Full remote and NL eligibility still unverified")
    assert tuple(lead("Remote", "work from anywhere in Europe")) == ("needs_official_review", True, "Recent remote/NL signal; official verification still required")
    assert lead("Hybrid, Utrecht", "").reason == "Location indicates hybrid/on-site"


def test_feeds_beyond_their_cap_when_all_is_asked(spark):
    jobs = [{"url": f"https://www.workingnomads.com/job/go/{i}/", "title": "Dev"} for i in range(130)]
    raw = spark.createDataFrame([("s", "ats", "workingnomads", "acct", None, None, "en", None, 0, json.dumps(jobs))], RAW)
    assert providers.observations(raw, "2026-09-06", ["workingnomads"]).count() == 120
    assert providers.observations(raw, "2026-09-06", ["workingnomads"], most_feed=None).count() == 130


def test_rows_are_dealt_over_tasks_that_grow_in_number(spark, tmp_path):
    from gleaner.operators.graph import spread

    spark.range(10_001).coalesce(1).write.parquet(f"{tmp_path}/t.parquet")
    table = spark.read.parquet(f"{tmp_path}/t.parquet")
    parts = spread(table, "id", 1000).groupBy(F.spark_partition_id()).count().collect()
    assert table.rdd.getNumPartitions() == 1 and len(parts) == 11 and sum(r[1] for r in parts) == 10_001 and max(r[1] for r in parts) < 2000
