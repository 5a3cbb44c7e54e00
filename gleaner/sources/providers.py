"""Provider payloads to observations: each provider is a declaration of where its fields are.

Input is `raw_payloads`: source_id, source_type, adapter, account, employer, endpoint, listing_language, max_jobs,
payload (text), page (position among a source's pages). JSON stays VARIANT until it is projected, XML feeds are parsed
with a fixed schema. Malformed collections fail their source, malformed records go to the quarantine.
"""

from __future__ import annotations

import html
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions.hashing import CONTENT, content_digest
from gleaner.functions.text import clean, stringify
from gleaner.functions.urls import parts
from gleaner.operators.canonical import fingerprint

CONTRACT = "1.1"


@F.pandas_udf(T.StringType())
def unescape(x: pd.Series) -> pd.Series:
    """HTML entities have no built-in decoder."""
    return x.map(lambda v: html.unescape(v) if isinstance(v, str) else None)


def html_text(x: Column) -> Column:
    return clean(unescape(F.regexp_replace(x, "<[^>]+>", " ")))


def text(v: Column, path: str) -> Column:
    """Clean text of a scalar member; objects and lists give null."""
    member = F.try_variant_get(v, path, "variant")
    return F.when(~F.schema_of_variant(member).rlike("^(OBJECT|ARRAY)"), stringify(F.try_variant_get(v, path, "string")))


def first(v: Column, *paths: str) -> Column:
    return F.coalesce(*[text(v, p) for p in paths])


def flag(v: Column, path: str) -> Column:
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "BOOLEAN", F.try_variant_get(v, path, "boolean"))


def texts(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def name_of(v: Column) -> Column:
    """Text of a label that is given as text or as an object with a name."""
    return F.coalesce(text(v, "$"), first(v, "$.label", "$.name"))


def joined(v: Column, path: str, glue: str, pick: Callable[[Column], Column] = name_of) -> Column:
    return F.nullif(F.array_join(F.array_compact(F.transform(F.coalesce(texts(v, path), F.array().cast("array<variant>")), pick)), glue), F.lit(""))


@dataclass(frozen=True)
class Provider:
    """Where a provider's records are and how each observation field is read from one."""

    records: tuple[str, ...]  # collections, the first that is present
    url: Callable[[Column], Column]
    title: Callable[[Column], Column]
    job_id: Callable[[Column], Column]
    source_url: str
    keep: Callable[[Column], Column] = lambda v: F.lit(True)
    needs_url: bool = True
    fields: dict[str, Callable[[Column], Column]] = field(default_factory=dict)
    salary: Callable[[Column], Column] | None = None


def at(*paths: str) -> Callable[[Column], Column]:
    return lambda v: first(v, *paths)


def rich(*paths: str) -> Callable[[Column], Column]:
    return lambda v: html_text(first(v, *paths))


def const(x: object) -> Callable[[Column], Column]:
    return lambda v: F.lit(x)


def or_else(f: Callable[[Column], Column], x: str) -> Callable[[Column], Column]:
    return lambda v: F.coalesce(f(v), F.lit(x))


def pay(low: str, high: str, currency: str | None = None, period: str | None = None, zero_is_null: bool = False) -> Callable[[Column], Column]:
    def amounts(v: Column) -> Column:
        lo, hi = (F.nullif(text(v, p), F.lit("0")) if zero_is_null else text(v, p) for p in (low, high))
        s = F.to_json(F.struct(lo.alias("min"), hi.alias("max"), (text(v, currency) if currency else F.lit(None).cast("string")).alias("currency"), (text(v, period) if period else F.lit(None).cast("string")).alias("period")))
        return F.when(lo.isNotNull() | hi.isNotNull(), s)

    return amounts


def as_json(path: str) -> Callable[[Column], Column]:
    return lambda v: F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")).startswith("OBJECT"), F.to_json(F.try_variant_get(v, path, "variant")))


#: Public feeds and the hosts that their postings may be at; the one whose odd records are put aside.
FEED_HOSTS = {
    "arbeitnow-api": ("www.arbeitnow.com", "arbeitnow.com", "www.arbeitnow.co.uk"),
    "remote-landers-api": ("remotelanders.com",),
    "remotejobs-org": ("remotejobs.org",),
}
QUARANTINED_SOURCE = "arbeitnow-api"
#: Providers that return all they have, so that what is missing is gone.
COMPLETE = ("greenhouse", "lever", "ashby", "smartrecruiters", "workable", "personio")
MOST_FEED_RECORDS = 120


def feed_problem(adapter: Column, source: Column, url: Column) -> Column:
    """What is wrong with a public feed's posting URL: malformed, untrusted_host, uk_apex; null for others and if all is well."""
    host, form = parts(url)["host"], url.rlike(r"^https://[^/?#@\\\s]+([/?#]|$)")
    known = F.lit(False)
    for name, hosts in FEED_HOSTS.items():
        known = known | ((source == name) & host.isin(*hosts))
    nomads = url.rlike(r"^https://www\.workingnomads\.com/job/go/[0-9]+/?$")
    listed = source.isin(*FEED_HOSTS)
    return F.when((adapter == "workingnomads") & ~nomads, "malformed").when(
        (adapter == "publicfeed") & listed,
        F.when(~form, "malformed").when(~known, F.when((source == QUARANTINED_SOURCE) & (host == "arbeitnow.co.uk"), "uk_apex").otherwise("untrusted_host")),
    )


REMOTE_BOARD = {"remote": const(True), "workplace_type": const("remote")}
PROVIDERS: dict[str, Provider] = {
    "greenhouse": Provider(
        ("$.jobs",), at("$.absolute_url"), at("$.title"), at("$.id"), "greenhouse://",
        fields={"location": at("$.location.name"), "description": rich("$.content"), "published_at": at("$.first_published"), "updated_at": at("$.updated_at")},
    ),
    "lever": Provider(
        ("$",), at("$.hostedUrl"), at("$.text"), at("$.id"), "lever://",
        fields={
            "location": at("$.categories.location"), "description": rich("$.descriptionPlain", "$.description"), "employment_type": at("$.categories.commitment"),
            "apply_url": at("$.applyUrl", "$.hostedUrl"), "workplace_type": at("$.workplaceType"),
            "remote": lambda v: F.when(text(v, "$.workplaceType") == "remote", True),
        },
        salary=as_json("$.salaryRange"),
    ),
    "ashby": Provider(
        ("$.jobs",), at("$.jobUrl"), at("$.title"), at("$.id"), "ashby://",
        keep=lambda v: F.coalesce(flag(v, "$.isListed"), F.lit(True)),
        fields={
            "location": at("$.location"), "description": lambda v: F.coalesce(text(v, "$.descriptionPlain"), html_text(text(v, "$.descriptionHtml"))), "published_at": at("$.publishedAt"),
            "employment_type": at("$.employmentType"), "apply_url": at("$.applyUrl", "$.jobUrl"), "workplace_type": at("$.workplaceType"),
            "remote": lambda v: F.when(F.lower(text(v, "$.workplaceType")) == "remote", True).when(F.lower(text(v, "$.workplaceType")).isin("hybrid", "onsite"), False),
        },
        salary=as_json("$.compensation"),
    ),
    "smartrecruiters": Provider(
        ("$.content", "$.postings"), at("$.applyUrl"), at("$.name", "$.title"), at("$.id", "$.uuid"), "smartrecruiters://", needs_url=False,
        fields={
            "location": lambda v: F.coalesce(text(v, "$.location"), F.nullif(F.concat_ws(", ", *[text(v, f"$.location.{p}") for p in ("city", "region", "country")]), F.lit(""))),
            "description": lambda v: html_text(F.nullif(F.concat_ws("\n", *[text(v, f"$.jobAd.sections.{s}.text") for s in ("companyDescription", "jobDescription", "qualifications", "additionalInformation")]), F.lit(""))),
            "published_at": at("$.releasedDate", "$.publicationDate"), "updated_at": at("$.updatedDate"), "apply_url": at("$.applyUrl"), "workplace_type": at("$.workplaceType"),
            "employment_type": lambda v: F.coalesce(name_of(F.try_variant_get(v, "$.typeOfEmployment", "variant")), name_of(F.try_variant_get(v, "$.employmentType", "variant"))),
            "remote": lambda v: flag(v, "$.location.remote"),
        },
    ),
    "workable": Provider(
        ("$.jobs", "$.results"), at("$.url", "$.shortlink", "$.application_url"), at("$.title"), at("$.shortcode", "$.id"), "workable://",
        fields={
            "location": lambda v: F.coalesce(
                joined(v, "$.locations", " / ", lambda i: F.nullif(F.concat_ws(", ", *[text(i, f"$.{p}") for p in ("city", "region", "country")]), F.lit(""))),
                first(v, "$.location.location_str"), F.nullif(F.concat_ws(", ", *[text(v, f"$.location.{p}") for p in ("city", "region", "country")]), F.lit("")), text(v, "$.location"),
            ),
            "description": lambda v: html_text(F.nullif(F.concat_ws("\n", first(v, "$.full_description", "$.description"), text(v, "$.requirements"), text(v, "$.benefits")), F.lit(""))),
            "published_at": at("$.published_on", "$.published", "$.created_at"), "employment_type": at("$.employment_type", "$.type"), "apply_url": at("$.application_url", "$.url"),
            "remote": lambda v: F.coalesce(flag(v, "$.remote"), flag(v, "$.telecommuting"), F.when(F.lower(text(v, "$.workplace_type")) == "remote", True)), "workplace_type": at("$.workplace_type"),
        },
        salary=as_json("$.salary"),
    ),
    "himalayas": Provider(
        ("$.jobs",), at("$.applicationLink"), at("$.title"), at("$.guid"), "https://himalayas.app/jobs/api",
        fields=REMOTE_BOARD | {
            "employer": at("$.companyName"), "location": lambda v: F.coalesce(joined(v, "$.locationRestrictions", ", "), F.lit("Worldwide")), "description": rich("$.description"),
            "published_at": at("$.pubDate"), "valid_through": at("$.expiryDate"), "employment_type": at("$.employmentType"),
        },
        salary=pay("$.minSalary", "$.maxSalary", "$.currency", "$.salaryPeriod"),
    ),
    "jobicy": Provider(
        ("$.jobs",), at("$.url"), at("$.jobTitle"), at("$.id"), "https://jobicy.com/api/v2/remote-jobs",
        fields=REMOTE_BOARD | {
            "employer": at("$.companyName"), "location": or_else(at("$.jobGeo"), "Remote"), "description": rich("$.jobDescription", "$.jobExcerpt"), "published_at": at("$.pubDate"),
            "employment_type": lambda v: F.coalesce(text(v, "$.jobType"), joined(v, "$.jobType", ", ")),
        },
        salary=pay("$.annualSalaryMin", "$.annualSalaryMax", "$.salaryCurrency"),
    ),
    "remotive": Provider(
        ("$.jobs",), at("$.url"), at("$.title"), at("$.id"), "https://remotive.com/api/remote-jobs",
        fields=REMOTE_BOARD | {
            "employer": at("$.company_name"), "location": or_else(at("$.candidate_required_location"), "Remote"), "description": rich("$.description"),
            "published_at": at("$.publication_date"), "employment_type": at("$.job_type"),
        },
        salary=at("$.salary"),
    ),
    "remoteok": Provider(
        ("$",), at("$.apply_url", "$.url"), at("$.position"), at("$.id"), "https://remoteok.com/api",
        keep=lambda v: text(v, "$.id").isNotNull() & text(v, "$.position").isNotNull(),
        fields=REMOTE_BOARD | {"employer": at("$.company"), "location": or_else(at("$.location"), "Remote"), "description": rich("$.description"), "published_at": at("$.date")},
        salary=pay("$.salary_min", "$.salary_max", zero_is_null=True),
    ),
    "publicfeed": Provider(
        ("$.data", "$.jobs", "$"), at("$.url"), at("$.title"), at("$.id", "$.slug", "$.url"), "https://",
        keep=lambda v: F.coalesce(flag(v, "$.remote"), F.lit(True)),
        fields=REMOTE_BOARD | {
            "employer": at("$.company_name", "$.company.name", "$.company"), "location": or_else(at("$.location"), "Remote (location unverified)"), "description": rich("$.description"),
            "published_at": at("$.posted_at", "$.postedDate"), "employment_type": at("$.type"), "apply_url": at("$.url"),
        },
        salary=at("$.salary_text", "$.salary"),
    ),
    "workingnomads": Provider(
        ("$",), at("$.url"), at("$.title"), lambda v: F.regexp_extract(text(v, "$.url"), "/([0-9]+)/?$", 1), "https://www.workingnomads.com/api/exposed_jobs/",
        fields={"employer": at("$.company_name"), "location": at("$.location"), "description": rich("$.description"), "apply_url": const(None)},
    ),
}

_ITEM = "struct<title:string, link:string, guid:string, pubDate:string, description:string, company:string, region:string, location:string, type:string, category:array<string>, remoteStatus:string>"
_RSS = f"channel struct<item: array<{_ITEM}>>"
_PERSONIO = (
    "position array<struct<id:string, name:string, office:string, department:string, employmentType:string, schedule:string, createdAt:string,"
    " jobDescriptions:struct<jobDescription:array<struct<name:string, value:string>>>>>"
)
RSS = ("weworkremotely", "wordpressjobs", "teamtailor", "jobicy_rss")
_TARGET = (
    "employer", "location", "description", "published_at", "updated_at", "valid_through", "employment_type", "apply_url", "workplace_type",
)


def rfc2822(x: Column) -> Column:
    """Date of a feed as UTC ISO text; null if it has no valid form."""
    forms = ("EEE, d MMM yyyy HH:mm:ss Z", "EEE, d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss Z")
    moment = F.coalesce(*[F.try_to_timestamp(F.regexp_replace(x, "^[A-Za-z]{3}, ", "") if not f.startswith("EEE") else x, F.lit(f)) for f in forms[2:]])
    return F.date_format(F.to_utc_timestamp(moment, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


_OBSERVED = ("url", "title", "job_id", *_TARGET, "salary", "remote", "source_url")


def _frame(df: DataFrame, records: Column) -> DataFrame:
    """One row per record with its place among its source's records, in page and record order."""
    rows = df.select("*", F.posexplode(records).alias("pos", "rec"))
    return rows.withColumn("ordinal", F.row_number().over(W.partitionBy("source_id", "account").orderBy("page", "pos")))


def _per_adapter(options: dict[str, Column]) -> Column:
    """The option of a row's adapter; one expression over all adapters, so that the payloads are read once."""
    return F.coalesce(*[F.when(F.col("adapter") == a, x) for a, x in options.items()])


def _read(p: Provider, v: Column) -> Column:
    url, title, job = p.url(v), p.title(v), p.job_id(v)
    none = F.lit(None).cast("string")
    own = {k: p.fields[k](v) if k in p.fields else none for k in _TARGET}
    own["employer"] = own["employer"] if "employer" in p.fields else F.coalesce("employer", "account")
    if "apply_url" not in p.fields:
        own["apply_url"] = url
    elif p.source_url.endswith("://"):
        own["apply_url"] = F.coalesce(own["apply_url"], url)
    remote = p.fields["remote"](v).cast("boolean") if "remote" in p.fields else F.lit(None).cast("boolean")
    source = F.coalesce("endpoint", F.concat(F.lit(p.source_url), F.col("account")) if p.source_url.endswith("://") else F.lit(p.source_url))
    said = {"url": url, "title": title, "job_id": job, **own, "salary": p.salary(v) if p.salary else none, "remote": remote, "source_url": source}
    object_ = F.schema_of_variant(v).startswith("OBJECT")
    keep = F.coalesce(object_ & p.keep(v) & title.isNotNull() & (url.isNotNull() if p.needs_url else job.isNotNull()), F.lit(False))
    return F.struct(keep.alias("keep"), *[(x if k == "remote" else x.cast("string")).alias(k) for k, x in said.items()])


def parse_json(raw: DataFrame) -> DataFrame:
    """Records of all JSON providers, and one row per page that failed, with error."""
    doc = raw.where(F.col("adapter").isin(*PROVIDERS)).withColumn("v", F.try_parse_json("payload"))
    records = _per_adapter({a: F.coalesce(*[F.try_variant_get("v", c, "array<variant>") for c in p.records]) for a, p in PROVIDERS.items()})
    doc = doc.withColumn("records", records).withColumn("error", F.when(F.col("v").isNull(), "malformed_json").when(F.col("records").isNull(), "missing_collection")).drop("v", "payload")
    rows = _frame(doc, F.coalesce("records", F.array().cast("array<variant>"))).drop("records")
    return _joined(doc.drop("records"), rows.withColumn("o", _per_adapter({a: _read(p, F.col("rec")) for a, p in PROVIDERS.items()})))


def parse_rss(raw: DataFrame) -> DataFrame:
    doc = raw.where(F.col("adapter").isin(*RSS)).withColumn("x", F.from_xml("payload", _RSS, {"rowTag": "rss", "mode": "PERMISSIVE"})).drop("payload")
    doc = doc.withColumn("error", F.when(F.col("x.channel").isNull(), "malformed_feed"))
    r = {k: clean(F.col(f"rec.{k}")) for k in ("title", "link", "guid", "pubDate", "description", "company", "region", "location", "type", "remoteStatus")}
    is_ = lambda a: F.col("adapter") == a
    url, split = F.coalesce(r["link"], r["guid"]), F.split(r["title"], ": ", 2)
    named = r["company"].isNull() & r["title"].contains(": ") & is_("weworkremotely")
    none = F.lit(None).cast("string")
    own = {k: none for k in _TARGET} | {
        "employer": F.when(named, clean(split[0])).otherwise(F.coalesce(r["company"], F.col("employer"))),
        "location": F.coalesce(r["region"], r["location"], F.lit("Remote")),
        "description": html_text(r["description"]),
        "published_at": rfc2822(r["pubDate"]),
        "employment_type": r["type"],
        "apply_url": url,
        "workplace_type": F.when(~is_("wordpressjobs"), "remote"),
    }
    pinned = url.rlike("/jobs/[0-9]+") & ~F.coalesce(F.lower(r["remoteStatus"]).isin("none", "hybrid", "temporary"), F.lit(False))
    keep = r["title"].isNotNull() & url.isNotNull() & (~is_("teamtailor") | pinned)
    title = F.when(named, F.coalesce(clean(split[1]), r["title"])).otherwise(r["title"])
    said = {"url": url, "title": title, "job_id": F.coalesce(r["guid"], url), **own, "salary": none, "remote": F.when(~is_("wordpressjobs"), True), "source_url": F.col("endpoint")}
    rows = _frame(doc, F.col("x.channel.item")).drop("x")
    return _joined(doc.drop("x"), rows.withColumn("o", F.struct(F.coalesce(keep, F.lit(False)).alias("keep"), *[x.alias(k) for k, x in said.items()])))


def parse_personio(raw: DataFrame) -> DataFrame:
    doc = raw.where("adapter = 'personio'").withColumn("x", F.from_xml("payload", _PERSONIO, {"rowTag": "workzag-jobs", "mode": "PERMISSIVE"})).drop("payload")
    doc = doc.withColumn("error", F.when(F.col("x.position").isNull(), "malformed_feed"))
    job, title, office = (clean(F.col(f"rec.{k}")) for k in ("id", "name", "office"))
    url = F.concat(F.lit("https://"), F.col("account"), F.lit(".jobs.personio.de/job/"), job)
    none = F.lit(None).cast("string")
    own = {k: none for k in _TARGET} | {
        "employer": F.coalesce("employer", "account"),
        "location": office,
        "description": html_text(F.array_join(F.transform("rec.jobDescriptions.jobDescription", lambda s: F.concat_ws("\n", s["name"], s["value"])), "\n")),
        "published_at": clean(F.col("rec.createdAt")),
        "employment_type": clean(F.col("rec.employmentType")),
        "apply_url": url,
    }
    keep = F.coalesce(title.isNotNull() & job.isNotNull(), F.lit(False))
    said = {"url": url, "title": title, "job_id": job, **own, "salary": none, "remote": F.when(F.lower(office).rlike(r"\bremote\b"), True), "source_url": F.col("endpoint")}
    rows = _frame(doc, F.col("x.position")).drop("x")
    return _joined(doc.drop("x"), rows.withColumn("o", F.struct(keep.alias("keep"), *[x.alias(k) for k, x in said.items()])))


_SOURCE = ("source_id", "source_type", "adapter", "account", "listing_language", "max_jobs", "page")


def _joined(doc: DataFrame, rows: DataFrame) -> DataFrame:
    none = {"ordinal": "int", "o": dict(rows.dtypes)["o"]}
    failed = doc.where("error is not null").select(*_SOURCE, "error", *[F.lit(None).cast(t).alias(n) for n, t in none.items()])
    return rows.select(*_SOURCE, "error", "ordinal", "o").where("error is null").union(failed)


PARSERS = {parse_json: tuple(PROVIDERS), parse_rss: RSS, parse_personio: ("personio",)}
ADAPTERS: dict[str, Callable[[DataFrame], DataFrame]] = {a: f for f, names in PARSERS.items() for a in names}


def records(raw: DataFrame, now: str, adapters: list[str] | None = None, most_feed: int | None = MOST_FEED_RECORDS) -> DataFrame:
    """All providers' records up to each source's cap (of feeds also `most_feed`; None: all), with problem (null: an observation), and pages that failed, with error.

    Each kind of payload is read in one pass, whatever the number of providers. Problems: filtered (what a provider says
    is not listed, or lacks a title, URL or id), repeated (a feed's record under an id that came before), no_identity,
    and those of feed_problem(), which fail the source unless it is the one whose odd records are put aside.
    """
    wanted = set(adapters or ADAPTERS)
    out = None
    for parser, names in PARSERS.items():
        if wanted & set(names):
            one = parser(raw.where(F.col("adapter").isin(*(wanted & set(names)))))
            out = one if out is None else out.unionByName(one)
    feed = F.col("adapter").isin("publicfeed", "workingnomads")
    key = F.when(feed & F.col("o.keep"), F.coalesce("o.job_id", "o.url"))
    first = F.row_number().over(W.partitionBy("source_id", "account", F.coalesce(key, F.concat(F.lit("\x00"), "ordinal"))).orderBy("ordinal"))
    within = F.col("ordinal") <= F.least(F.coalesce("max_jobs", F.lit(2**31 - 1)), F.when(feed, most_feed or 2**31 - 1).otherwise(2**31 - 1))
    rows = out.withColumn("_first", F.when(F.col("error").isNull() & feed, first).otherwise(1)).where(F.col("error").isNotNull() | within)
    job, url = F.concat_ws(":", "account", "o.job_id"), F.col("o.url")
    problem = F.when(
        F.col("error").isNull(),
        F.coalesce(
            F.when(~F.col("o.keep"), "filtered"),
            feed_problem(F.col("adapter"), F.col("source_id"), url),
            F.when(F.col("_first") > 1, "repeated"),
            F.when(url.isNull() & (F.col("source_id").isNull() | F.col("o.job_id").isNull()), "no_identity"),
        ),
    )
    shown = rows.select(
        "source_id", "source_type", F.when(F.col("o.job_id").isNotNull(), job).alias("source_job_id"), F.concat_ws(":", "adapter", "account").alias("source_instance"), "o.source_url",
        url.alias("canonical_url"), url.alias("url"), "o.title", *[f"o.{k}" for k in _TARGET], "o.salary", "listing_language", "o.remote", F.col("adapter").alias("provider"), "ordinal", "max_jobs",
        "error", problem.alias("problem"),
    )
    return (
        shown.withColumn("observation_contract_version", F.lit(CONTRACT))
        .withColumns({c: F.lit(now) for c in ("ingestion_timestamp", "first_seen_at", "last_seen_at")})
        .withColumn("duplicate_candidate_fingerprint", fingerprint(F.col("employer"), F.col("title"), F.col("location")))
        .withColumn("content_hash", content_digest(**{c: F.col(c) for c in CONTENT if c in shown.columns}))
    )


def observations(raw: DataFrame, now: str, adapters: list[str] | None = None, most_feed: int | None = MOST_FEED_RECORDS) -> DataFrame:
    """The observations among records()."""
    return records(raw, now, adapters, most_feed).where("error is null and problem is null").drop("error", "problem", "max_jobs")


def runs(rows: DataFrame, started_at: str, registry_ids: Column | None = None) -> DataFrame:
    """One row per source of records(): whether it succeeded and why not, its counts, and whether it was complete.

    A source whose page failed, or with a record of a kind that is not put aside, fails as a whole; the others go on. Only
    a provider that returns all, below its cap and with nothing put aside, says by silence that a posting is gone.
    """
    odd = F.col("problem").isin("malformed", "untrusted_host", "uk_apex")
    aside = odd & (F.col("source_id") == QUARANTINED_SOURCE)
    fetched = F.count_if(F.col("error").isNull() & F.coalesce(F.col("problem") != "repeated", F.lit(True)))
    per = rows.groupBy("source_instance", "source_id", "provider").agg(
        fetched.alias("fetched"), F.count_if(F.col("error").isNull() & F.col("problem").isNull()).alias("normalized"), F.count_if(F.coalesce(aside, F.lit(False))).alias("quarantine_count"),
        F.min(F.coalesce("error", F.when(odd & ~aside, F.concat(F.lit("Unexpected public feed job URL: "), "problem")))).alias("failure_message"), F.max("max_jobs").alias("max_jobs"),
    )
    ok = F.col("failure_message").isNull()
    ids = registry_ids if registry_ids is not None else F.array("source_id")
    return per.select(
        "source_instance", ok.alias("success"), F.when(ok, F.col("fetched")).otherwise(0).alias("fetched"), F.when(ok, F.col("normalized")).otherwise(0).alias("normalized"), ids.alias("registry_source_ids"),
        F.when(~ok, "parsing_or_adapter_failure").alias("failure_category"), "failure_message", F.when(ok, F.col("quarantine_count")).otherwise(0).alias("quarantine_count"),
        (ok & (F.col("quarantine_count") == 0) & F.col("provider").isin(*COMPLETE) & (F.col("fetched") < F.coalesce("max_jobs", F.lit(2**31 - 1)))).alias("complete_snapshot"), F.lit(started_at).alias("started_at"),
    )


def batch_document(run_table: DataFrame, rows: DataFrame, changes: DataFrame) -> DataFrame:
    """One row: sources, successes, runs, review queue and observations of a batch, for write.json.

    rows: records() of the batch; changes: rows with ingestion_change, of which new and updated ones are for review.
    Observations of failed sources stay out. The nested lists are one document's, so their size is what a reader asked for.
    """
    fine = rows.where("error is null and problem is null").join(run_table.where("success").select("source_instance"), "source_instance", "left_semi")
    pack = lambda df: df.agg(F.collect_list(F.struct(*df.columns)).alias("x"))
    counts = run_table.agg(F.count("*").alias("sources"), F.count_if("success").alias("successes"), F.collect_list(F.struct(*run_table.columns)).alias("runs"))
    queue = pack(changes.where("ingestion_change in ('new', 'updated')")).select(F.size("x").alias("review_queue_count"), F.col("x").alias("review_queue"))
    return counts.crossJoin(queue).crossJoin(pack(fine.drop("error", "problem", "max_jobs")).select(F.col("x").alias("observations")))  # one row each


def spec_registry_ids(source_id: Column, registry_source_id: Column) -> Column:
    """Sorted ids of the register that a source spec needs: its own, and those of its option, a text or a list (VARIANT)."""
    one = F.when(F.schema_of_variant(registry_source_id) == "STRING", F.array(F.try_variant_get(registry_source_id, "$", "string")))
    many = F.try_variant_get(registry_source_id, "$", "array<string>")
    every = F.concat(F.array(source_id), F.coalesce(one, many, F.array().cast("array<string>")))
    return F.array_sort(F.array_distinct(F.filter(F.transform(every, lambda x: F.trim(x)), lambda x: x != "")))
