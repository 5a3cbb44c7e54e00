"""The register's smaller decisions: artifact names and manifests, search quota, metrics, the specialist's queue."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions.urls import parts

#: Fixed values.
MANIFEST_VERSION = "1.0"
DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
QUEUE_DIGESTS = ("policy_sha256", "candidate_evidence_sha256", "observation_sha256", "official_page_sha256")
CLOSED = ("closed", "rejected", "declined", "withdrawn")


@F.pandas_udf(T.StringType())
def ascii_only(x: pd.Series) -> pd.Series:
    """Compatibility decomposition without what is not ASCII; no built-in does it."""
    return x.map(lambda v: unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode() if isinstance(v, str) else None)


def component(x: Column, most: int) -> Column:
    c = F.regexp_replace(F.regexp_replace(ascii_only(x), "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(F.regexp_replace(F.substring(c, 1, most), "_+$", ""), F.lit("")), F.lit("item"))


def artifact_name(candidate: Column, employer: Column, title: Column, vacancy_id: Column, most: int = 180) -> Column:
    """Stable file name of one candidate's document for one vacancy."""
    if most < 64:
        raise ValueError("most must be at least 64")
    a = [F.trim(x) for x in (candidate, employer, title, vacancy_id)]
    digest = F.substring(F.sha2(F.concat_ws("\x1f", *a), 256), 1, 10)
    stem = F.concat_ws("_", F.lit("CV"), component(a[0], 36), component(a[1], 48), component(a[2], 84), digest)
    cut = F.concat_ws("_", F.regexp_replace(F.substring(stem, 1, most - 16), "_+$", ""), digest)
    return F.concat(F.when(F.length(stem) + 5 > most, cut).otherwise(stem), F.lit(".docx"))


def manifests(df: DataFrame) -> DataFrame:
    """df with the manifest's columns, its identity, and fault: the first rule that it breaks."""
    text = ("candidate_name", "vacancy_id", "employer", "title", "canonical_url", "source_cv_sha256", "job_snapshot_sha256")
    rows = df.withColumns({c: F.trim(c) for c in text}).withColumns({c: F.lower(c) for c in text[5:]})
    p = parts(F.col("canonical_url"))
    rules = [(F.coalesce(F.col(c), F.lit("")) == "", f"{c} is empty") for c in text]
    rules += [(~p["scheme"].isin("http", "https") | (p["host"] == ""), "canonical_url is not an absolute HTTP(S) URL"), (F.col("canonical_url").rlike("^[^/]*//[^/?#]*@"), "canonical_url has credentials")]
    rules += [(~F.col(c).rlike("^[0-9a-f]{64}$"), f"{c} is not a SHA-256") for c in text[5:]]
    named = rows.withColumns({
        "fault": F.coalesce(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for c, n in rules]),
        "contract_version": F.lit(MANIFEST_VERSION),
        "output_mime": F.lit(DOCX),
        "output_file_name": artifact_name(*[F.col(c) for c in ("candidate_name", "employer", "title", "vacancy_id")]),
    })
    fields = sorted((*text, "contract_version", "output_mime", "output_file_name"))
    return named.withColumn("identity", F.when(F.col("fault").isNull(), F.sha2(F.to_json(F.struct(*fields)), 256)))


def free_account(account: Column, planned: int, reserve: int) -> Column:
    """Whether a provider's account (VARIANT) is surely free and has enough searches; doubtful types say no."""
    text = lambda k: F.lower(F.trim(F.try_variant_get(account, f"$.{k}", "string")))
    kind = lambda k: F.schema_of_variant(F.try_variant_get(account, f"$.{k}", "variant"))
    whole = lambda k: F.when(kind(k) == "BIGINT", F.try_variant_get(account, f"$.{k}", "bigint"))
    price = F.when(kind("plan_monthly_price").rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(account, "$.plan_monthly_price", "double"))
    fine = (
        (text("account_status") == "active")
        & (text("plan_id") == "free")
        & text("plan_name").isin("free", "free plan")
        & (price == 0)
        & whole("searches_per_month").between(1, 250)
        & (whole("extra_credits") == 0)
        & (whole("plan_searches_left") >= planned + reserve)
        & (whole("total_searches_left") >= planned + reserve)
        & (whole("account_rate_limit_per_hour") > 0)
        & (whole("this_hour_searches") >= 0)
        & (whole("account_rate_limit_per_hour") - whole("this_hour_searches") >= planned)
    )
    return F.coalesce(fine, F.lit(False))


def confirmed_empty(payload: Column) -> Column:
    """Whether a search (VARIANT) succeeded and surely found nothing."""
    text = lambda p: F.try_variant_get(payload, p, "string")
    rows = F.try_variant_get(payload, "$.organic_results", "variant")
    none = rows.isNull() | F.coalesce(F.is_variant_null(rows), F.lit(False)) | (F.to_json(rows) == "[]")
    said = text("$.error") == "Google hasn't returned any results for this query."
    return F.coalesce(said & (F.lower(text("$.search_metadata.status")) == "success") & (F.lower(F.trim(text("$.search_information.organic_results_state"))) == "fully empty") & none, F.lit(False))


def application_metrics(applications: DataFrame, events: DataFrame, vacancies: DataFrame, test_prefixes: tuple[str, ...] = ()) -> DataFrame:
    """One row of distinct counts; submitted and interviews come from two tables. One pass over their union."""

    def real(df: DataFrame, kind: Column, event: Column) -> DataFrame:
        ids = df.select(F.trim("vacancy_id").alias("id"), F.lower(F.trim(kind)).alias("kind"), event.alias("event"))
        return ids.where((F.coalesce("id", F.lit("")) != "") & ~F.exists(F.array(*[F.lit(p) for p in (*test_prefixes, "\x00")]), lambda p: F.lower("id").startswith(p)))

    none = F.lit(None).cast("string")
    a = real(applications, F.concat(F.lit("a:"), F.trim("status")), none)
    e = real(events, F.concat(F.lit("e:"), F.trim("event_type")), F.nullif(F.col("event_id"), F.lit("")))
    v = real(vacancies, F.concat(F.lit("v:"), F.trim("status")), none)
    count = lambda kinds, what="id": F.countDistinct(F.when(F.col("kind").isin(*kinds), F.col(what)))
    return a.unionByName(e).unionByName(v).agg(
        count(["a:prepared_cv_ready"]).alias("ready_packages"), count(["a:submitted", "a:applied", "e:submitted"]).alias("submitted"), count(["e:employer_reply"], "event").alias("replies"),
        count(["a:interview", "e:interview"]).alias("interviews"), count([f"a:{c}" for c in CLOSED]).alias("closed_or_rejected"), count(["v:closed"]).alias("closed_vacancies"),
    )


def specialist_queue(candidates: DataFrame, private_evidence: bool = True) -> DataFrame:
    """candidates (link, still_to_verify, four digests) as a public queue: links without query, safe blockers, no scores."""
    p = parts(F.col("link"))
    public = F.when((p["scheme"] == "https") & p["host"].contains(".") & (p["port"] == "") & ~F.col("link").rlike("^[^/]*//[^/?#]*@"), F.concat(F.lit("https://"), p["host"], p["path"]))
    ready = F.lit(private_evidence)
    for d in QUEUE_DIGESTS:
        ready = ready & F.coalesce(F.col(d).rlike("^[0-9a-f]{64}$"), F.lit(False))
    safe = F.array_sort(F.array_distinct(F.filter(F.coalesce("still_to_verify", F.array().cast("array<string>")), lambda s: s.rlike("^[a-z][a-z0-9_]{0,79}$"))))
    return candidates.select(public.alias("link"), safe.alias("still_to_verify"), ready.alias("ready"), *[F.when(ready, F.col(d)).alias(d) for d in QUEUE_DIGESTS]).where("link is not null")
