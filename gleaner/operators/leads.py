"""Leads of the scheduled worker: discovery rules, de-duplication, the report and its checks on import."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.functions.urls import canonical, parts
from gleaner.operators.screening import first_wins, prefer_last_match

#: Patterns of titles, places and paths (Java regular expressions, lower-case text).
ROLE = r"\b(wordpress|woocommerce|elementor|gutenberg|acf|web[\s-]?design|web[\s-]?develop|front[\s-]?end|frontend|website|webshop)\b"
REMOTE = r"\b(fully remote|100%\s*remote|remote\b|work from anywhere|telecommut)"
NONREMOTE = r"\b(hybrid|on[\s-]?site|in office|office[\s-]?based|not remote|no remote|remote[\s-]?friendly)\b"
REGION_BLOCK = r"\b(us only|usa only|united states only|uk only|u\.s\.\s*only|w2 only|u\.?s\.?[\s-]+based|usa[\s-]+based)\b"
BAD_ROLE = r"\b(ai automation|automation engineer|sales engineer|systems engineer|product manager|mobile developer|data engineer|marketer|marketing|sales support|sales specialist|lending manager)\b"
LISTING_TITLE = r"\b(?:browse|more|search|find)\b.{0,45}\bjobs?\b|(?:remote[ -]?)?(?:wordpress|front[ -]?end|frontend|web[ -]?developer)\b.{0,35}\bjobs\b"
LIST_WORDS = r"\b(jobs|job openings|job listings|vacancies|opportunities|opdrachten)\b"
CAREERS_ROOT = r"^/(?:careers?|jobs?|openings?|vacancies|about/careers?)/?$"
LIST_PATHS = (
    r"/(?:search|job-search|remote-jobs|jobs-search)/?$",
    r"^/(?:in|groups)/",
    r"^/(?:company|companies|freelance-jobs)/[^/]+/?$",
    r"^/(?:opdrachten|category|job-category|tags?)/",
    r"^/q-[^/]+-jobs\.html$",
)
SEARCH_HOSTS = ("google.com", "www.google.com", "bing.com", "www.bing.com", "searxng.org", "search.brave.com", "duckduckgo.com", "serpapi.com")


def relevant(title: Column) -> Column:
    t = F.lower(F.substring(F.trim(F.coalesce(title, F.lit(""))), 1, 200))
    return t.rlike(ROLE) & ~t.rlike(BAD_ROLE) & ~t.rlike(LISTING_TITLE)


def remote_signal(title: Column, description: Column, location: Column, explicit: Column | None = None) -> Column:
    e = F.lower(F.substring(F.concat_ws(" ", *[F.coalesce(x, F.lit("")) for x in (title, description, location)]), 1, 5500))
    return (e.rlike(REMOTE) | (F.coalesce(explicit, F.lit(False)) if explicit is not None else F.lit(False))) & ~e.rlike(NONREMOTE) & ~e.rlike(REGION_BLOCK)


def role_page(url: Column) -> Column:
    """Whether a found URL can be one posting: no search engine, careers root or list page."""
    p = parts(url)
    path = F.lower(p["path"])
    out = url.isNotNull() & ~p["host"].isin(*SEARCH_HOSTS) & ~path.rlike(CAREERS_ROOT)
    for pattern in LIST_PATHS:
        out = out & ~path.rlike(pattern)
    return out


def metasearch_leads(results: DataFrame, per_query: int = 15, read: int = 60) -> DataFrame:
    """results (query, position, title, content, url) -> leads, the first of a URL in each query."""
    url = canonical(F.col("url"), sort_query=False, https_only=True)
    snippet = F.substring(F.regexp_replace(F.coalesce("content", F.lit("")), "<[^>]+>", " "), 1, 800)
    rows = results.where(F.col("position") < read).withColumns({"url": url, "title": F.substring(F.trim("title"), 1, 180), "description": snippet})
    fine = relevant(F.col("title")) & remote_signal(F.col("title"), F.col("description"), F.lit("")) & ~F.lower("title").rlike(LIST_WORDS) & role_page(F.col("url"))
    kept = first_wins(rows.where(F.coalesce(fine, F.lit(False))), ["query", "url"], F.col("position"))
    capped = kept.withColumn("_r", F.row_number().over(W.partitionBy("query").orderBy("position"))).where(F.col("_r") <= per_query)
    return capped.select("query", "position", "title", "url", "description", F.lit("Remote - unverified").alias("location"), F.lit("unverified").alias("review_status"))


def job_search_leads(jobs: DataFrame) -> DataFrame:
    """jobs (position, title, description, location, explicit_remote, links) -> leads by the first usable link of each."""
    urls = F.filter(F.transform("links", lambda x: canonical(x, sort_query=False, https_only=True)), role_page)
    fine = relevant(F.col("title")) & remote_signal(F.col("title"), F.col("description"), F.col("location"), F.col("explicit_remote"))
    rows = jobs.where(F.coalesce(fine, F.lit(False))).withColumn("url", F.try_element_at(urls, F.lit(1))).where("url is not null")
    return first_wins(rows, ["url"], F.col("position")).drop("links")


def metasearch_status(n_results: Column, n_blocked: Column, valid: Column) -> Column:
    return F.when(~valid, "searxng_unavailable_or_invalid_json").when(n_results > 0, "searxng_results").when(n_blocked > 0, "searxng_no_results_or_engines_blocked").otherwise("searxng_empty")


def report_leads(found: DataFrame, most: int = 150) -> DataFrame:
    """One row per URL: the last with structured evidence, else the first; in order of first sight, up to `most`."""
    return prefer_last_match(found, "url", F.col("evidence").startswith("JobPosting"), "ordinal").orderBy("position").limit(most)


def report_summary(sources: DataFrame, found: DataFrame, saved: DataFrame) -> DataFrame:
    s = sources.agg(
        F.count("*").alias("registered"), F.count_if(F.coalesce("checked_at", F.lit("")) != "").alias("attempted"), F.count_if(F.col("status") == "http_200").alias("ok"), F.count_if(F.col("browser") == "rendered").alias("rendered")
    )
    return s.crossJoin(found.agg(F.count("*").alias("discovered"))).crossJoin(saved.agg(F.count("*").alias("saved")))  # one row each


def report_faults(generated_at: Column, sources: DataFrame, register: DataFrame, now: str) -> DataFrame:
    """Reasons to refuse a report as a whole: a stale or future time, or sources that are not exactly the register's."""
    both = sources.select("source_id", F.col("url").alias("_u"), F.lit(1).alias("_s")).join(register.select("source_id", F.col("url").alias("_v"), F.lit(1).alias("_r")), "source_id", "full")
    odd = both.agg(F.count_if(F.col("_s").isNull() | F.col("_r").isNull() | (F.col("_u") != F.col("_v"))).alias("odd"), (F.count("*") - F.countDistinct("source_id")).alias("twice"))
    at, t = F.to_timestamp(generated_at), F.to_timestamp(F.lit(now))
    late = at.isNull() | (at < t - F.expr("interval 3 hours")) | (at > t + F.expr("interval 10 minutes"))
    return odd.select(F.array_compact(F.array(F.when(late, "stale_or_future"), F.when(F.col("odd") > 0, "source_inventory"), F.when(F.col("twice") > 0, "duplicate_source"))).alias("faults"))


def alert_digest(leads: DataFrame, most: int = 20) -> DataFrame:
    """The first alerts as lines of text."""
    line = F.concat_ws(" | ", "title", "employer", "location", "url")
    return leads.where("alert").orderBy("ordinal").limit(most).select("ordinal", line.alias("line"))
