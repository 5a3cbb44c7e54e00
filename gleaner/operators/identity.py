"""Identities across runs: a posting at one tenant of an applicant system, whatever host or route its URL has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.urls import APPLY_LAST, ats, canonical, let, parts, role_specific

#: Where a posting's id stands in the path, counted from 1 (segments in all, fixed word before it, place).
SHAPES = {"ashby": (2, None, 2), "lever": (2, None, 2), "greenhouse": (3, "jobs", 3), "workable": (3, "j", 3), "personio": (2, "job", 2), "smartrecruiters": (2, None, 2)}
NOT_IDS = ("jobs", "careers", "apply", "application", "search")
URL_COLUMNS = ("canonical_url", "official_url", "application_url", "apply_url", "url")


def safe_url(url: Column) -> Column:
    """Public https URL without port, user, address or local name; canonical. Null for others."""
    return let(url, _safe)


def _safe(url: Column) -> Column:
    p = parts(url)
    user = F.regexp_extract(url, r"^[A-Za-z]+://([^/?#]*@)", 1) != ""
    public = p["host"].rlike(r"^([a-z0-9]([a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,}$") & ~p["host"].rlike(r"(^|\.)(localhost|local|internal|test|invalid|example)$")
    return F.when((p["scheme"] == "https") & ~user & public & p["port"].isin("", "443"), canonical(url))


def url_keys(url: Column) -> Column:
    """Strong keys of a URL: itself, and provider, account and id where an applicant system's route names one."""

    def of(u: Column) -> Column:
        seg = F.filter(F.split(parts(u)["path"], "/"), lambda s: s != "")
        return let(F.struct(u.alias("u"), ats(u).alias("system"), seg.alias("seg"), role_specific(u).alias("role")), _keys)

    return let(safe_url(url), of)


def _keys(x: Column) -> Column:
    u, system, seg = x["u"], x["system"], x["seg"]
    bare = F.when(F.lower(F.try_element_at(seg, F.lit(-1))).isin(*APPLY_LAST), F.slice(seg, F.lit(1), F.greatest(F.size(seg) - 1, F.lit(0)))).otherwise(seg)
    job = F.lit(None).cast("string")
    for provider, (n, word, at) in SHAPES.items():
        value = F.try_element_at(bare, F.lit(at))
        if provider == "smartrecruiters":
            value = F.when(F.substring_index(value, "-", 1).rlike("^[0-9]+$"), F.substring_index(value, "-", 1))
        fits = (system["provider"] == provider) & (F.size(bare) == n)
        if word:
            fits = fits & (F.try_element_at(bare, F.lit(at - 1)) == word)
        job = F.when(fits, value).otherwise(job)
    return let(job, lambda j: _named(x, F.when(j.rlike("^[A-Za-z0-9][A-Za-z0-9._-]{0,199}$") & ~F.lower(j).isin(*NOT_IDS), j)))


def _named(x: Column, job: Column) -> Column:
    u, system, seg = x["u"], x["system"], x["seg"]
    own = F.array(F.concat(F.lit("url:"), u))
    known = system["provider"].isin(*SHAPES)
    empty = F.array().cast("array<string>")
    return (
        F.when(u.isNull(), empty)
        .when(known & job.isNotNull(), F.array_union(F.array(F.lower(F.concat_ws(":", F.lit("source"), system["provider"], system["account"], job))), own))
        .when(known, F.when(x["role"] & ((F.size(seg) >= 2) | (system["provider"] == "personio")), own).otherwise(empty))
        .otherwise(F.when(x["role"], own).otherwise(empty))
    )


def scoped_key(df: DataFrame) -> Column:
    """source:provider:account:id; null unless instance, declared account and the URL's account agree."""
    low = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    provider, job, instance = low("source_id"), low("source_job_id"), low("source_instance")
    owner, tail = F.substring_index(instance, ":", 1), F.regexp_extract(instance, "^[^:]*:(.*)$", 1)
    bad_instance = (instance != "") & ((owner != provider) | (tail == ""))
    declared = F.when(job.contains(":"), F.substring_index(job, ":", 1))
    bare = F.regexp_replace(job, "^[^:]*:", "")
    system = ats(F.coalesce(F.nullif(F.col("canonical_url"), F.lit("")), F.col("url")))
    from_url = F.when(system["provider"] == provider, F.lower(system["account"]))
    named = F.array_compact(F.array(F.nullif(tail, F.lit("")), declared, from_url))
    agreed = F.size(F.array_distinct(named)) == 1
    return F.when((provider != "") & (bare != "") & ~bad_instance & agreed, F.concat_ws(":", F.lit("source"), provider, named[0], bare))


def scoped_identity(df: DataFrame) -> DataFrame:
    """df with source_job_id replaced by its scoped form for clustering, or null; the original stays beside it."""
    key = scoped_key(df)
    return df.withColumn("original_job_id", F.col("source_job_id")).withColumn("source_job_id", F.regexp_replace(key, "^source:[^:]*:", ""))


def history_keys(df: DataFrame) -> Column:
    """All keys of a row: its URL columns, its cluster's URLs, the scoped key and the register id."""
    found = [url_keys(F.col(c)) for c in URL_COLUMNS if c in df.columns]
    if "source_urls" in df.columns:
        found.append(F.flatten(F.transform(F.coalesce("source_urls", F.array().cast("array<string>")), url_keys)))
    if {"source_id", "source_job_id", "source_instance", "canonical_url", "url"} <= set(df.columns):
        found.append(F.array_compact(F.array(scoped_key(df))))
    if "vacancy_id" in df.columns:
        v = F.nullif(F.trim("vacancy_id"), F.lit(""))
        found.append(F.array_compact(F.array(F.concat(F.lit("vacancy:"), v))))
    return F.array_sort(F.array_distinct(F.concat(*found)))


def trusted_tenant(url: Column, provider: Column, account: Column) -> Column:
    """Whether a URL is one posting of this provider's account."""
    system = let(safe_url(url), ats)
    return F.coalesce((system["provider"] == provider) & (F.lower(system["account"]) == F.lower(account)) & (F.size(url_keys(url)) > 1), F.lit(False))
