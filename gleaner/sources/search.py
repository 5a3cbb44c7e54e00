"""The search provider: which requests a run makes, and what its answers hold. Answers come as a table; nothing is sent.

Requests go round the queries page by page, so that no query takes all of the quota. A query ends with its first page
without results; an answer that is an error, and not the provider's way of saying that nothing was found, ends the run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.functions.text import stringify
from gleaner.functions.urls import ats
from gleaner.operators.identity import safe_url
from gleaner.operators.register import confirmed_empty, free_account

MOST_QUERIES, MOST_PAGES, MOST_REQUESTS, MOST_RESERVE = 20, 10, 50, 100
SOURCE = ("google-jobs", "discovery")


def request_plan(queries: DataFrame, pages: int = 3, max_requests: int = 12) -> DataFrame:
    """queries (query_index, query) -> query, page (from 1), turn (from 0): each query once, page by page, up to the limit."""
    if not 1 <= pages <= MOST_PAGES or not 1 <= max_requests <= MOST_REQUESTS:
        raise ValueError("invalid page or request limits")
    q = queries.withColumn("query", F.trim("query"))
    n, bad = q.agg(F.count("*"), F.count_if(F.coalesce(~F.length("query").between(3, 300), F.lit(True)))).first()
    if bad or not 1 <= n <= MOST_QUERIES:
        raise ValueError(f"queries must be 1 to {MOST_QUERIES} texts of 3 to 300 characters")
    one = q.groupBy("query").agg(F.min("query_index").alias("query_index"))
    turns = one.select("query", "query_index", F.explode(F.sequence(F.lit(1), F.lit(pages))).alias("page"))
    # at most MOST_QUERIES x MOST_PAGES rows
    return turns.withColumn("turn", F.row_number().over(W.orderBy("page", "query_index")) - 1).where(F.col("turn") < max_requests).drop("query_index")


def may_search(account: DataFrame, plan: DataFrame, reserve: int = 10) -> DataFrame:
    """One row, allowed: whether the account (VARIANT) is surely free and has enough left for the plan and the reserve."""
    if not 0 <= reserve <= MOST_RESERVE:
        raise ValueError("invalid reserve")
    planned = plan.count()
    return account.select(free_account(F.col("account"), planned, reserve).alias("allowed"))


def answer_kind(payload: Column) -> Column:
    """results, empty, provider_error or malformed_result."""
    v = F.try_parse_json(payload)
    rows = F.try_variant_get(v, "$.organic_results", "array<variant>")
    error = F.try_variant_get(v, "$.error", "variant").isNotNull()
    return F.when(v.isNull(), "malformed_result").when(error, F.when(confirmed_empty(v), "empty").otherwise("provider_error")).when(rows.isNull(), "malformed_result").when(F.size(rows) == 0, "empty").otherwise("results")


def results(answers: DataFrame, now: str, max_jobs: int = 250) -> tuple[DataFrame, DataFrame]:
    """(observations, outcome) of answers (query, page, turn, payload).

    outcome is one row: success, failure_category, requests. A failed run has no observations. A result counts once, at
    its first place; what an empty page says is nothing about a posting being gone.
    """
    a = answers.withColumn("kind", answer_kind(F.col("payload")))
    ended = a.where("kind = 'empty'").groupBy("query").agg(F.min("page").alias("_end"))
    a = a.join(ended, "query", "left").where(F.col("_end").isNull() | (F.col("page") <= F.col("_end")))
    failed = F.col("kind").isin("provider_error", "malformed_result")
    outcome = a.agg(F.min(F.when(failed, F.struct("turn", "kind"))).alias("f"), F.count("*").alias("requests")).select(F.col("f").isNull().alias("success"), F.col("f.kind").alias("failure_category"), "requests")
    v = F.try_parse_json("payload")
    rows = a.where("kind = 'results'").select("query", "page", "turn", F.posexplode(F.try_variant_get(v, "$.organic_results", "array<variant>")).alias("pos", "r"))
    get = lambda k, n: F.substring(stringify(F.try_variant_get("r", f"$.{k}", "string")), 1, n)
    seen = rows.select("query", "page", "turn", "pos", safe_url(F.try_variant_get("r", "$.link", "string")).alias("url"), get("title", 400).alias("title"), get("snippet", 2000).alias("description")).where("url is not null and title is not null")
    order = [F.col("turn"), F.col("pos")]
    first = seen.withColumn("_r", F.row_number().over(W.partitionBy("url").orderBy(*order))).where("_r = 1").drop("_r")
    top = first.orderBy(*order).limit(max_jobs).crossJoin(F.broadcast(outcome.select("success"))).where("success")  # one row
    observed = top.select(
        F.lit(SOURCE[0]).alias("source_id"), F.lit(SOURCE[1]).alias("source_type"), F.concat(F.lit("main:"), F.sha2(F.col("url").cast("binary"), 256)).alias("source_job_id"), F.lit("google-jobs:main").alias("source_instance"),
        F.lit("https://www.google.com/search").alias("source_url"), F.col("url").alias("canonical_url"), "url", "title", "description", ats(F.col("url")).alias("ats_hint"), "query", F.col("page").alias("result_page"),
        F.lit(now).alias("observation_time"),
    )
    return observed, outcome
