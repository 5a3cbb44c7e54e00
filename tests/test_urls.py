from urllib.parse import parse_qsl, urlencode, urlsplit

from pyspark.sql import functions as F

from gleaner.functions import urls

CASES = [
    "HTTP://User:pw@Example.COM:80/a/b//?b=2&a=1&utm_source=x#top", "https://example.com", "https://example.com:443/", "https://example.com:8443/x?q=a+b&q=%7E*&empty=", "ftp://example.com/x",
    "https://example.com:99999/x", "https://example.com:ab/x", "  https://example.com/jobs/1  ", "https:///x", "", None, "https://example.com/?GCLID=1&z", "https://example.com/ü?ü=ß",
]


def expected(raw):
    try:
        p = urlsplit((raw or "").strip())
        port, host = p.port, (p.hostname or "").lower()
    except ValueError:
        return None
    if p.scheme.lower() not in ("http", "https") or not host:
        return None
    site = host if port in (None, 80 if p.scheme == "http" else 443) else f"{host}:{port}"
    q = sorted((k, v) for k, v in parse_qsl(p.query, keep_blank_values=True) if not k.lower().startswith("utm_") and k.lower() not in urls.TRACKING_KEYS)
    return f"{p.scheme}://{site}{p.path.rstrip('/') or '/'}" + (f"?{urlencode(q)}" if q else "")


def test_canonical_agrees_with_the_standard_library(spark):
    df = spark.createDataFrame([(c,) for c in CASES], "u string").select("u", urls.canonical(F.col("u")).alias("c"))
    assert {r.u: r.c for r in df.collect()} == {c: expected(c) for c in CASES}


def test_role_specific_and_systems(spark):
    cases = {
        "https://x.example/": False, "https://x.example/jobs": False, "https://x.example/jobs/12-dev": True, "https://x.example/category/dev": False, "https://x.example/list/page/2": False,
        "https://x.example/j/apply": False, "https://x.example/j/apply?gh_jid=7": True,
    }
    df = spark.createDataFrame([(c,) for c in cases], "u string")
    assert {r.u: r.s for r in df.select("u", urls.role_specific(F.col("u")).alias("s")).collect()} == cases
    got = spark.createDataFrame([("https://jobs.lever.co/acme/1",), ("https://acme.recruitee.com/o/1",), ("https://x.example/acme",)], "u string").select(urls.ats(F.col("u")).alias("a")).collect()
    assert [r.a and tuple(r.a) for r in got] == [("lever", "acme"), ("recruitee", "acme"), None]
