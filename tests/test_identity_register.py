import hashlib
import json

from pyspark.sql import functions as F

from gleaner.operators import identity, register


def test_url_keys(spark):
    cases = {
        "https://jobs.lever.co/Acme/1a-2/apply?x=1": ["source:lever:acme:1a-2", "url:https://jobs.lever.co/Acme/1a-2/apply?x=1"],
        "https://boards.greenhouse.io/acme/jobs/12": ["source:greenhouse:acme:12", "url:https://boards.greenhouse.io/acme/jobs/12"],
        "https://jobs.lever.co/acme": [], "https://jobs.smartrecruiters.com/Acme/77-dev": ["source:smartrecruiters:acme:77", "url:https://jobs.smartrecruiters.com/Acme/77-dev"],
        "https://acme.com/role/1": ["url:https://acme.com/role/1"], "https://acme.com/jobs": [], "http://acme.com/role/1": [], "https://127.0.0.1/role": [], "https://u:p@acme.com/role": [], None: [],
    }
    df = spark.createDataFrame([(c,) for c in cases], "u string").select("u", identity.url_keys(F.col("u")).alias("k"))
    assert {r.u: sorted(r.k) for r in df.collect()} == {u: sorted(k) for u, k in cases.items()}


def test_scoped_keys(spark):
    rows = [("lever", "acme:1", "lever:acme", "https://jobs.lever.co/acme/1"), ("lever", "1", "lever:acme", None), ("lever", "other:1", "lever:acme", None), ("lever", "1", None, None), ("lever", "1", "ashby:acme", None), ("lever", "1", "lever:acme", "https://jobs.lever.co/else/1")]
    df = spark.createDataFrame([(*r, r[3]) for r in rows], "source_id string, source_job_id string, source_instance string, canonical_url string, url string")
    assert [r.k for r in df.select(identity.scoped_key(df).alias("k")).collect()] == ["source:lever:acme:1", "source:lever:acme:1", None, None, None, None]
    assert [r.source_job_id for r in identity.scoped_identity(df).collect()][:3] == ["acme:1", "acme:1", None]
    keys = df.withColumn("vacancy_id", F.lit(" v1 ")).limit(1)
    assert keys.select(identity.history_keys(keys).alias("k")).first().k == ["source:lever:acme:1", "url:https://jobs.lever.co/acme/1", "vacancy:v1"]


def test_artifacts(spark):
    row = ("Zoë Ünal", "v1", "Acme & Co", "Dev " * 60, "https://x.example/1", "A" * 64, "b" * 64)
    bad = (*row[:4], "https://u@x.example", "A" * 64, "b" * 63)
    df = register.manifests(spark.createDataFrame([row, bad], "candidate_name string, vacancy_id string, employer string, title string, canonical_url string, source_cv_sha256 string, job_snapshot_sha256 string")).collect()
    digest = hashlib.sha256("\x1f".join((row[0], row[2], row[3].strip(), "v1")).encode()).hexdigest()[:10]
    assert df[0].output_file_name.startswith("CV_Zoe_Unal_Acme_Co_Dev_Dev") and df[0].output_file_name.endswith(f"_{digest}.docx") and len(df[0].output_file_name) <= 180
    fields = {k: df[0][k] for k in ("candidate_name", "vacancy_id", "employer", "title", "canonical_url", "source_cv_sha256", "job_snapshot_sha256", "contract_version", "output_mime", "output_file_name")}
    assert df[0].fault is None and df[0].identity == hashlib.sha256(json.dumps(fields, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    assert df[1].fault == "canonical_url has credentials" and df[1].identity is None


def test_quota(spark):
    good = {"account_status": "Active", "plan_id": "free", "plan_name": "Free Plan", "plan_monthly_price": 0.0, "searches_per_month": 250, "extra_credits": 0, "plan_searches_left": 60, "total_searches_left": 60, "account_rate_limit_per_hour": 50, "this_hour_searches": 1}
    cases = [good, good | {"plan_monthly_price": "0"}, good | {"extra_credits": 1}, good | {"plan_searches_left": 59}, good | {"searches_per_month": True}, {}]
    df = spark.createDataFrame([(json.dumps(c),) for c in cases], "j string").select(register.free_account(F.parse_json("j"), 40, 20).alias("ok"))
    assert [r.ok for r in df.collect()] == [True, False, False, False, False, False]
    empty = {"error": "Google hasn't returned any results for this query.", "search_metadata": {"status": "Success"}, "search_information": {"organic_results_state": "Fully empty"}}
    df = spark.createDataFrame([(json.dumps(c),) for c in (empty, empty | {"organic_results": []}, empty | {"organic_results": [1]}, empty | {"error": "x"})], "j string").select(register.confirmed_empty(F.parse_json("j")).alias("ok"))
    assert [r.ok for r in df.collect()] == [True, True, False, False]


def test_metrics_and_queue(spark):
    a = spark.createDataFrame([("v1", "submitted"), ("v1", " Applied "), ("v2", "interview"), ("test-1", "submitted"), (None, "closed"), ("v3", "rejected")], "vacancy_id string, status string")
    e = spark.createDataFrame([("v4", "submitted", "e1"), ("v1", "employer_reply", "e2"), ("v2", "employer_reply", "e2"), ("v2", "interview", "")], "vacancy_id string, event_type string, event_id string")
    v = spark.createDataFrame([("v9", "Closed")], "vacancy_id string, status string")
    assert tuple(register.application_metrics(a, e, v, ("test-",)).first()) == (0, 2, 1, 1, 1, 1)
    d = "0" * 64
    q = spark.createDataFrame([("https://a.example/x?y=1#z", ["b_two", "A bad", "a_one", "a_one"], d, d, d, d), ("http://a.example/x", [], d, d, d, d), ("https://b.example/x", None, d, d, d, "no")], "link string, still_to_verify array<string>, " + ", ".join(f"{x} string" for x in register.QUEUE_DIGESTS))
    got = register.specialist_queue(q).collect()
    assert [(r.link, r.still_to_verify, r.ready) for r in got] == [("https://a.example/x", ["a_one", "b_two"], True), ("https://b.example/x", [], False)]
    assert not any(r.ready for r in register.specialist_queue(q, False).collect())
