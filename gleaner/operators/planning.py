"""Which sources a run reads and in which batches, when it may stop, and what its attempts say about coverage.

Specs, sources and attempts are a register's rows. Per-source steps are joins and group-bys; the order of a plan is one
of a register's specs, some hundred rows.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.functions.text import is_true

MOST_SOURCES, MOST_BATCH = 20, 8
PRIORITIES = {"high": 0, "medium": 1, "low": 2}
#: Kinds of attempts that only look at a landing page, and how a source's coverage can end.
LANDING = ("public_landing_probe_only", "public_html_job_link_discovery", "public_landing_probe_failed")


def place_in(x: Column, order: list[str], beyond: int | None = None) -> Column:
    """Position of a value in an order of values; those that are not in it come after."""
    rest = len(order) if beyond is None else beyond
    table = F.create_map(*[F.lit(v) for i, name in enumerate(dict.fromkeys(order)) for v in (name, order.index(name))]) if order else None
    return F.coalesce(table[x], F.lit(rest)) if order else F.lit(rest)


def priority_of(x: Column) -> Column:
    return place_in(F.lower(F.trim(x)), list(PRIORITIES), 3)


def source_order(class_order: list[str], high_order: list[str]) -> list[Column]:
    """Public sources: by class, priority, place among the high ones, id."""
    return [place_in(F.col("source_type"), class_order), priority_of(F.col("priority")), place_in(F.col("source_id"), high_order), F.col("source_id")]


def spec_order(class_order: list[str], high_order: list[str]) -> list[Column]:
    """Specs: as sources, then by their place in the deploy list and their instance."""
    return [place_in(F.col("source_type"), class_order, 999), priority_of(F.col("priority")), place_in(F.col("source_id"), high_order), F.col("position"), F.col("instance")]


def pool(specs: DataFrame, ats: Column, order: list[Column], size: int = MOST_BATCH) -> DataFrame:
    """specs (instance, ...) with pool_index: the order in which repeated selections without replacement take them.

    A selection of `size` takes the next half of the applicant systems and the next feeds, then fills up from what is
    left of either. As both lanes are read in order, the selection that a spec falls into follows from its place in its
    lane and the lanes' lengths, without a loop.
    """
    if not 1 <= size <= MOST_BATCH:
        raise ValueError(f"batch size must be between 1 and {MOST_BATCH}")
    first = W.partitionBy("instance").orderBy("position")
    one = specs.withColumn("_one", F.row_number().over(first)).where("_one = 1").drop("_one")
    lane = W.partitionBy("_ats").orderBy(*order)
    x = one.withColumn("_ats", ats).withColumn("_i", F.row_number().over(lane) - 1)
    n = x.agg(F.count_if("_ats").alias("_a"), F.count_if(~F.col("_ats")).alias("_f"))
    x = x.crossJoin(F.broadcast(n))  # one row
    half = max(1, size // 2) if size >= 2 else size
    rest = max(1, size - half)
    own, other = (F.when(F.col("_ats"), a).otherwise(b) for a, b in ((F.lit(half), F.lit(rest)), (F.lit(rest), F.lit(half))))
    theirs = F.when(F.col("_ats"), F.col("_f")).otherwise(F.col("_a"))
    # selections in which the other lane is still full; in the next one it has `left`, after that none
    full = F.when(theirs > 0, F.floor(theirs / other)).otherwise(0)
    left = theirs - full * other
    over = F.col("_i") - full * own
    turn = F.when(F.lit(size < 2), F.lit(0)).when(over < 0, F.floor(F.col("_i") / own)).when(over < size - left, full).otherwise(full + 1 + F.floor((over - (size - left)) / size))
    alone = F.lit(size < 2)
    x = x.withColumn("_turn", F.when(alone, F.lit(0)).otherwise(turn))
    inside = [F.col("_turn"), F.when(alone, F.lit(0)).otherwise((~F.col("_ats")).cast("int")), *([] if size >= 2 else order), F.col("_i")]
    # one order over all: a register's specs
    return x.withColumn("pool_index", F.row_number().over(W.orderBy(*inside)) - 1).drop("_ats", "_i", "_a", "_f", "_turn")


def plan_batches(specs: DataFrame, ats: Column, order: list[Column], *, max_sources: int, size: int = MOST_BATCH, round_index: int = 0, exhaustive: bool = False) -> DataFrame:
    """specs of this round with turn and batch: a window of the pool that moves on with every round, cut into batches."""
    if not 1 <= max_sources <= MOST_SOURCES or round_index < 0:
        raise ValueError(f"at most {MOST_SOURCES} sources a round, rounds from 0")
    p = pool(specs, ats, order, size)
    n = p.agg(F.count("*").alias("_n"))
    p = p.crossJoin(F.broadcast(n))  # one row
    turn = F.col("pool_index") if exhaustive else F.pmod(F.col("pool_index") - F.pmod(F.lit(round_index * max_sources), F.col("_n")), F.col("_n"))
    p = p.withColumn("turn", turn.cast("long"))
    kept = p if exhaustive else p.where(F.col("turn") < max_sources)
    return kept.withColumn("batch", F.floor(F.col("turn") / size)).drop("_n", "pool_index")


def stop_after(batches: DataFrame, found: DataFrame, target: int, exhaustive: bool = False) -> DataFrame:
    """The batches that run: up to the first after which `target` verified roles are there; all in exhaustive mode.

    found: batch, verified (roles that a batch adds). stop_reason tells whether the target or the plan ended the run.
    """
    so_far = W.orderBy("batch").rowsBetween(W.unboundedPreceding, W.currentRow)  # a run has few batches
    total = batches.select("batch").distinct().join(found.groupBy("batch").agg(F.sum("verified").alias("verified")), "batch", "left").withColumn("verified", F.coalesce("verified", F.lit(0))).withColumn("total", F.sum("verified").over(so_far))
    before = F.col("total") - F.col("verified")
    reached = total.agg(F.max(F.col("total") >= target).alias("_reached"))
    keep = total if exhaustive else total.where(before < target)
    reason = F.when(F.lit(not exhaustive) & F.col("_reached"), "verified_target_reached").otherwise("planned_sources_exhausted")
    return batches.join(keep.select("batch", "total"), "batch").crossJoin(F.broadcast(reached)).withColumn("stop_reason", reason).drop("_reached", "total")


def page_budget(candidates: DataFrame, url: str, order: list[Column], n: int) -> DataFrame:
    """candidates with in_budget: whether their page is among the first n distinct ones in order."""
    first = candidates.groupBy(url).agg(F.min(F.struct(*order)).alias("_at")).orderBy("_at").limit(n).select(url, F.lit(True).alias("in_budget"))
    return candidates.join(F.broadcast(first), url, "left").withColumn("in_budget", is_true(F.col("in_budget")))


def with_context(candidates: DataFrame, originals: DataFrame, pages: DataFrame, assessments: DataFrame, url: str = "canonical_url") -> DataFrame:
    """Candidates beside their observation, page and assessment; those that have none keep nulls. Each side has one row a URL."""
    out = candidates
    for side, name in ((originals, "observation"), (pages, "page"), (assessments, "assessment")):
        out = out.join(side.select(url, F.struct(*[c for c in side.columns if c != url]).alias(name)), url, "left")
    return out


# ---------------------------------------------------------------- attempts and coverage
def utc_timestamp(x: Column, asof: datetime) -> Column:
    """Moment of an ISO time with an offset, from 2020 to five minutes after asof; null for others."""
    v = F.when(F.length(x) <= 40, F.regexp_replace(x, "Z", "+00:00"))
    form = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,6})?)?[+-]\d{2}:?\d{2}$"
    moment = F.try_to_timestamp(F.when(v.rlike(form), v))
    return F.when((moment >= F.lit("2020-01-01T00:00:00Z").cast("timestamp")) & (moment <= F.lit(asof).cast("timestamp") + F.expr("INTERVAL 5 MINUTES")), moment)


def valid_attempts(attempts: DataFrame, asof: datetime) -> DataFrame:
    """attempts (success VARIANT, started_at, registry_source_ids, fetched) with valid and at.

    Valid are those with a true or false outcome, a time with an offset, ids, and a count from 0 to 100,000.
    """
    at = utc_timestamp(F.col("started_at"), asof)
    ids = F.filter("registry_source_ids", lambda i: F.trim(i) != "")
    fine = (F.schema_of_variant("success") == "BOOLEAN") & at.isNotNull() & (F.size(ids) > 0) & (F.size(ids) == F.size("registry_source_ids")) & F.coalesce("fetched", F.lit(0)).between(0, 100_000)
    return attempts.withColumn("at", at).withColumn("valid", is_true(fine))


def by_source(attempts: DataFrame) -> DataFrame:
    """One row per attempt and source: of the ids it names, else of the id before the colon of its instance."""
    named = F.when(F.size("registry_source_ids") > 0, F.col("registry_source_ids"))
    older = F.when(F.col("source_instance").isNotNull(), F.array(F.substring_index("source_instance", ":", 1)))
    ids = F.array_distinct(F.coalesce(named, older))
    return attempts.select(F.explode(ids).alias("source_id"), *[c for c in attempts.columns if c not in ("registry_source_ids", "source_instance")])


def landing_outcome(found: Column, reached: Column) -> Column:
    return F.when(found, "public_job_links_discovered_unverified").when(reached, "public_landing_reachable_listing_unverified").otherwise("public_landing_probe_failed")


def complete(sources: DataFrame, attempts: DataFrame, google_status: str, mode: str) -> DataFrame:
    """sources (source_id, coverage_route, execution) with the execution that their attempts show.

    attempts: success, attempt_kind, candidate_links_unverified, registry_source_ids, source_instance. A landing page or a
    batch of searches is never taken for a scan of the source.
    """
    ok, probe = is_true(F.col("success")), is_true(F.col("attempt_kind").isin(*LANDING))
    links = F.coalesce("candidate_links_unverified", F.lit(0)) > 0
    per = by_source(attempts).groupBy("source_id").agg(F.bool_or(ok).alias("_ok"), F.bool_or(probe).alias("_probe"), F.bool_or(probe & ok & links).alias("_found"), F.bool_or(probe & ok).alias("_reached"), F.bool_or(ok & links).alias("_any_found"))
    x = sources.join(per, "source_id", "left")
    route, planned = F.col("coverage_route"), F.col("execution") == "google_query_planned_not_executed"
    own, probed = F.col("_ok").isNotNull(), is_true(F.col("_probe"))
    searched, live = google_status == "searched", mode != "check"
    # the optional search route looks at its probes alone; a site looks at all attempts once one is a probe
    of_site = landing_outcome(is_true(F.col("_any_found")), is_true(F.col("_ok")))
    execution = (
        F.when((route == "public_adapter") & own, F.when(F.col("_ok"), "direct_attempt_succeeded").otherwise("direct_attempt_failed"))
        .when((route == "public_adapter") & F.lit(live), "not_selected_within_round_limit")
        .when((route == "free_google_optional") & F.lit(searched), "google_provider_batch_succeeded")
        .when((route == "free_google_optional") & probed, landing_outcome(is_true(F.col("_found")), is_true(F.col("_reached"))))
        .when((route == "free_google_optional") & F.lit(google_status not in ("ready", "not_registered")), f"google_provider_{google_status}")
        .when(~route.isin("public_adapter", "free_google_optional") & probed, of_site)
        .when(~route.isin("public_adapter", "free_google_optional") & planned & F.lit(live), "google_batch_succeeded_query_unconfirmed" if searched else "google_query_not_executed_or_provider_blocked")
        .otherwise(F.col("execution"))
    )
    status = F.when((route == "free_google_optional") & probed & F.lit(not searched), google_status)
    return x.withColumn("execution", execution).withColumn("google_provider_status", status).drop("_ok", "_probe", "_found", "_reached", "_any_found")


def execution_counts(sources: DataFrame) -> DataFrame:
    return sources.groupBy("execution").agg(F.count("*").alias("sources"))


def coverage_summary(sources: DataFrame) -> DataFrame:
    """One row: sources in all, active and inactive, by route, and those whose search is planned or not."""
    route = lambda r: F.count_if(F.col("coverage_route") == r)
    site, planned = route("google_site_discovery_only"), F.countDistinct(F.when(F.col("execution") == "google_query_planned_not_executed", F.col("source_id")))
    return sources.agg(
        F.count("*").alias("registered_total"), F.count_if(F.col("status") == "active").alias("active_total"), F.count_if(F.col("status").isin("retired", "consolidated")).alias("inactive_total"),
        route("public_adapter").alias("adapter_registered"), site.alias("google_site_eligible"), planned.alias("google_site_planned"), (site - planned).alias("google_site_unplanned"),
        route("non_vacancy_evidence").alias("non_vacancy"), route("missing_safe_public_site").alias("unavailable_public_site"),
    )


def unmeasured(sources: DataFrame, attempts: DataFrame) -> DataFrame:
    """How many active sources of each route no valid attempt tells anything about."""
    seen = by_source(attempts.where("valid")).select("source_id").distinct()
    return sources.where("status = 'active'").join(seen, "source_id", "left_anti").groupBy("coverage_route").agg(F.count("*").alias("sources"))


def modes(specs: DataFrame, active: DataFrame, blocked: DataFrame) -> DataFrame:
    """First coverage report: one row per active source with its execution mode.

    specs: source_id, adapter, required (ids of the register); blocked: source_id. A source is read by its adapter, by the
    search provider, waits for the live web, is evidence only, or is blocked.
    """
    reads = specs.select(F.explode("required").alias("source_id"), F.when(F.col("adapter") == "serpapi_google", "search_adapter").otherwise("public_adapter").alias("mode"))
    best = reads.groupBy("source_id").agg(F.min("mode").alias("_mode"))
    x = active.join(best, "source_id", "left").join(blocked.select("source_id", F.lit(True).alias("_blocked")).distinct(), "source_id", "left")
    mode = F.when(is_true(F.col("_blocked")), "blocked").when(F.col("_mode").isNotNull(), F.col("_mode")).when(F.col("source_type") == "application_evidence", "evidence_only").otherwise("live_web_queue")
    return x.withColumn("execution_mode", mode).drop("_mode", "_blocked")


# ---------------------------------------------------------------- counts of runs and reviews
def review_counts(leads: DataFrame) -> DataFrame:
    return leads.groupBy("status").agg(F.count("*").alias("leads"), F.count_if("alert").alias("alerts"))


def run_status(results: DataFrame) -> DataFrame:
    """One row: sources, failed ones in order, and whether a run is success, partial or failed."""
    ok = F.count_if("success")
    status = F.when(ok == F.count("*"), "success").when(ok > 0, "partial").otherwise("failed")
    return results.agg(F.count("*").alias("sources"), ok.alias("successes"), F.array_sort(F.collect_set(F.when(~F.col("success"), F.col("source_instance")))).alias("failed"), status.alias("status"))


def visit_summary(visits: DataFrame) -> DataFrame:
    """visits (source_id, url, success) -> one row of distinct counts."""
    ok = F.col("success")
    return visits.agg(
        F.countDistinct("source_id").alias("sources_visited"), F.countDistinct("url").alias("pages_visited"), F.countDistinct(F.when(ok, F.col("source_id"))).alias("sources_reached"),
        F.countDistinct(F.when(~ok, F.col("url"))).alias("pages_failed"),
    )


def evaluation_summary(judged: DataFrame, ranked: DataFrame) -> DataFrame:
    """judged (canonical_url, status, reject_reason, in_budget), ranked (canonical_url): one row of counts.

    Verified roles that are not ranked are below a threshold of the ranking.
    """
    shown = ranked.select("canonical_url", F.lit(True).alias("_ranked")).distinct()
    verified = F.col("status") == "verified"
    return judged.join(shown, "canonical_url", "left").agg(
        F.count("*").alias("evaluated"), F.count_if("in_budget").alias("pages_checked"), F.count_if(F.col("reject_reason").isNotNull()).alias("excluded"), F.count_if(verified).alias("verified"),
        F.count_if(F.col("status") == "ineligible").alias("ineligible"), F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(verified & F.col("_ranked").isNull()).alias("verified_below_threshold"),
    )


def attempt_audit(results: DataFrame) -> DataFrame:
    """The columns of a run that may be shown: no messages, no URLs."""
    allowed = ("source_instance", "registry_source_ids", "success", "fetched", "normalized", "failure_category", "quarantine_count", "complete_snapshot", "started_at")
    return results.select(*[c for c in allowed if c in results.columns])
