"""Sources: routes by which they are covered, admission of specs, health proposals, query plans, rotations, metrics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Provider failures as register categories.
CATEGORIES = {
    "rate_limited": "robots/access restriction",
    "timeout_or_network": "timeout/transient network",
    "malformed_result": "malformed result",
    "parsing_or_adapter_failure": "parsing/structure change",
    "other_technical_failure": "other technical failure",
    "http_client_error": "other technical failure",
    "http_server_error": "other technical failure",
    "access_denied": "robots/access restriction",
    "blocked_by_provider": "robots/access restriction",
}
OTHER_FAILURE = "other technical failure"
INACTIVE = ("retired", "consolidated")
NOT_VACANCY = ("application_evidence",)


def routes(sources: DataFrame, has_adapter: Column, has_host: Column, search_id: str = "google-jobs") -> DataFrame:
    """sources (source_id, status, source_type) with coverage_route and execution."""
    status = F.coalesce("status", F.lit(""))
    rules = (
        (status.isin(*INACTIVE), "excluded_inactive", "excluded"),
        (status != "active", "excluded_unrecognized_status", "excluded"),
        (F.col("source_type").isin(*NOT_VACANCY), "non_vacancy_evidence", "not_applicable"),
        (has_adapter, "public_adapter", "not_attempted"),
        (F.col("source_id") == search_id, "free_google_optional", "not_attempted"),
        (has_host, "google_site_discovery_only", "not_attempted"),
        (F.lit(True), "missing_safe_public_site", "not_attempted"),
    )
    route = F.coalesce(*[F.when(c, F.lit(r)) for c, r, _ in rules])
    execution = F.coalesce(*[F.when(c, F.lit(e)) for c, _, e in rules])
    return sources.withColumn("coverage_route", route).withColumn("execution", execution)


def admit(specs: DataFrame, active: DataFrame) -> DataFrame:
    """specs (spec_id, required array) with missing: accepted are those of which every required source is active."""
    need = specs.select("spec_id", F.explode("required").alias("source_id"))
    gaps = need.join(active.select("source_id").distinct(), "source_id", "left_anti").groupBy("spec_id").agg(F.array_sort(F.collect_set("source_id")).alias("missing"))
    empty = F.array().cast("array<string>")
    return specs.join(gaps, "spec_id", "left").withColumn("missing", F.coalesce("missing", empty)).withColumn("accepted", F.size("missing") == 0)


def assert_admitted(specs: DataFrame) -> DataFrame:
    """Any spec that is blocked fails the run."""
    return specs.where(F.when(F.col("accepted"), True).otherwise(F.raise_error(F.concat(F.lit("blocked source: "), F.col("spec_id").cast("string"))).cast("boolean")))


def health_proposals(register: DataFrame, attempts: DataFrame) -> DataFrame:
    """register (source_id, last_success_at, last_failure_at, consecutive_failures), attempts (source_id, success, ts, category).

    A source with both outcomes is mixed; one whose evidence is not newer than the register is stale; both are skipped.
    """
    mapped = F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv])[F.col("category")]
    per = attempts.groupBy("source_id").agg(
        F.bool_or("success").alias("ok"), F.bool_and("success").alias("all_ok"), F.max("ts").alias("latest"), F.array_sort(F.collect_set(F.when(~F.col("success"), mapped))).alias("kinds")
    )
    x = register.join(per, "source_id")
    same, other = F.when(F.col("ok"), F.col("last_success_at")).otherwise(F.col("last_failure_at")), F.when(F.col("ok"), F.col("last_failure_at")).otherwise(F.col("last_success_at"))
    stale = F.coalesce(same >= F.col("latest"), F.lit(False)) | F.coalesce(other > F.col("latest"), F.lit(False))
    verdict = F.when(F.col("ok") != F.col("all_ok"), "mixed").when(stale, "stale").when(F.col("ok"), "success").otherwise("failure")
    fresh = F.col("verdict").isin("success", "failure")
    return x.withColumn("verdict", verdict).select(
        "source_id",
        "verdict",
        "latest",
        F.when(fresh, F.when(F.col("verdict") == "success", 0).otherwise(F.coalesce("consecutive_failures", F.lit(0)) + 1)).cast("long").alias("failures"),
        F.when(F.col("verdict") == "success", "").when(F.col("verdict") == "failure", F.when(F.size("kinds") == 1, F.col("kinds")[0]).otherwise(OTHER_FAILURE)).alias("failure_category"),
    )


def coprime_step(radix: int, combinations: int) -> int:
    """A stride over a cross product that meets every combination once and changes both parts at every step."""
    return next(s for s in range(radix + 1, radix + combinations + 2) if math.gcd(s, combinations) == 1)


def rotate(df: DataFrame, position: Column, size: int, epoch: int, n: int) -> DataFrame:
    """The n positions of this epoch's turn."""
    return df.where(F.pmod(position - (epoch * n) % max(1, size), F.lit(max(1, size))) < n)


def query_plan(left: DataFrame, right: DataFrame, n_left: int, n_right: int, budget: int, offset: int = 0) -> DataFrame:
    """left (i, a), right (j, b), both numbered from 0: `budget` combinations by stride, without a cross join."""
    total = n_left * n_right
    step = coprime_step(n_right, total) if total > 1 else 1
    k = F.pmod(F.lit(offset) + F.col("id") * step, F.lit(total))
    spark = left.sparkSession
    turns = spark.range(min(budget, total)).select(F.col("id").alias("turn"), F.floor(k / n_right).alias("i"), F.pmod(k, F.lit(n_right)).alias("j"))
    return turns.join(left, "i").join(right, "j").select("turn", "a", "b")


def two_lanes(specs: DataFrame, lane: Column, limit: int, *order: Column) -> DataFrame:
    """Half of the limit from lane true, the rest from the others, then filled up in the common order; with rank in it.

    Only the first rows of each lane can be chosen, so all but these are left to a top-k per lane.
    """
    x = specs.withColumn("_lane", lane)
    top = x.where("_lane").orderBy(*order).limit(limit).union(x.where("not _lane").orderBy(*order).limit(limit))
    ranked = top.withColumn("_g", F.row_number().over(W.orderBy(*order))).withColumn("_l", F.row_number().over(W.partitionBy("_lane").orderBy(*order)))
    half = max(1, limit // 2)
    first = ranked.withColumn("_in", F.col("_l") <= F.when(F.col("_lane"), half).otherwise(limit - half))
    filled = first.withColumn("_f", F.row_number().over(W.orderBy(F.desc("_in"), "_g"))).where(F.col("_f") <= limit)
    return filled.withColumn("rank", F.row_number().over(W.orderBy("_g"))).drop("_lane", "_l", "_in", "_f", "_g")


def half_open(reported: DataFrame, registered: DataFrame, key: str) -> DataFrame:
    """Counts of ids on one side only and on both."""
    a = reported.select(key).distinct().withColumn("_a", F.lit(True))
    b = registered.select(key).distinct().withColumn("_b", F.lit(True))
    side = F.when(F.col("_a").isNull(), "missing").when(F.col("_b").isNull(), "unexpected").otherwise("both")
    return a.join(b, key, "full").groupBy(side.alias("side")).agg(F.count("*").alias("n"))
