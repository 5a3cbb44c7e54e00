"""Runs over sources: payloads to observations to the versioned state, with a log, a review queue and a document.

One source's failure is recorded and the others go on. Sources are applied in the order of their instances, a later one
seeing what an earlier one stored, all in one upsert (`run_upsert.py`).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.operators import coverage, planning
from gleaner.operators.canonical import identity_keys
from gleaner.operators.graph import stash
from gleaner.operators.run_upsert import upsert_sources
from gleaner.operators.state import State, source_health
from gleaner.sources import providers

MOST_SOURCES = 300


@dataclass
class Run:
    state: State
    records: DataFrame  # all records, with error and problem
    runs: DataFrame  # one row per source, with counters
    review: DataFrame  # new and updated observations

    def document(self) -> DataFrame:
        return providers.batch_document(self.runs, self.records, self.review)


def batch_of(rows: DataFrame) -> DataFrame:
    """Observations as a batch for the state; ordinals count in each source."""
    fields = [c for c in rows.columns if c not in ("error", "problem", "max_jobs", "ordinal")]
    snippet = F.col("source_type").isin("search", "discovery") & (F.length(F.coalesce("description", F.lit(""))) < 400)
    return rows.select(
        "source_instance", F.col("ordinal").cast("long").alias("ordinal"), identity_keys(rows, False).alias("keys"), "canonical_url", "content_hash", F.to_json(F.struct(*fields)).alias("payload"), F.coalesce(snippet, F.lit(False)).alias("snippet")
    )


def ingest(spark: SparkSession, raw: DataFrame, state: State, run_id: str, now: str, close_threshold: int = 2) -> Run:
    """Apply all sources of raw payloads to a state."""
    rows = stash(providers.records(raw, now), "records")
    table = stash(providers.runs(rows, now), "runs")
    fine = table.where("success").select("source_instance", F.col("complete_snapshot").alias("complete"))
    if table.count() > MOST_SOURCES:
        raise ValueError(f"a run takes at most {MOST_SOURCES} sources")
    sources = fine.withColumn("position", F.row_number().over(W.orderBy("source_instance"))).withColumn("authoritative", F.split_part("source_instance", F.lit(":"), F.lit(1)).isin(*providers.COMPLETE))
    own = rows.where(F.col("error").isNull() & F.col("problem").isNull()).join(F.broadcast(fine.select("source_instance")), "source_instance", "left_semi")  # at most MOST_SOURCES
    batch = stash(batch_of(own), "batch")
    new, tally, changes = upsert_sources(batch, stash(sources, "sources"), state, run_id=run_id, now=now, close_threshold=close_threshold)
    new = replace(new, **{n: stash(getattr(new, n), n) for n in ("jobs", "identities", "snapshots", "memberships")})
    review = own.join(changes.where("review in ('new', 'updated')").select("source_instance", "ordinal", F.col("review").alias("ingestion_change")), ["source_instance", "ordinal"])
    runs = table.join(tally.withColumnRenamed("duplicate", "duplicate_observations"), "source_instance", "left").fillna(0, ["new", "updated", "unchanged", "duplicate_observations", "closed"])
    return Run(replace(new, runs=state.runs.unionByName(run_log(table, run_id, now))), rows, stash(runs, "runs"), stash(review, "review"))


def run_log(table: DataFrame, run_id: str, now: str) -> DataFrame:
    """Rows of the state's log of runs."""
    return table.select(
        F.concat_ws("/", F.lit(run_id), "source_instance").alias("run_id"), "source_instance", "started_at", F.lit(now).alias("finished_at"), "success", F.col("normalized").cast("int").alias("result_count"), "failure_category"
    )


def export(state: State) -> dict[str, DataFrame]:
    """What a reader of the state gets: jobs in their order, counts by status, runs, and the sources' health."""
    return {
        "jobs": state.jobs.orderBy("first_seen_at", "job_id"),
        "counts": state.jobs.groupBy("status").agg(F.count("*").alias("jobs")),
        "runs": state.runs.orderBy("started_at", "run_id"),
        "health": source_health(state.runs),
    }


def admitted(specs: DataFrame, active: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, blocked) specs: those whose own and named sources are all active. specs: source_id, options (VARIANT), ..."""
    need = specs.withColumn("spec_id", F.monotonically_increasing_id()).withColumn("required", providers.spec_registry_ids(F.col("source_id"), F.try_variant_get("options", "$.registry_source_id", "variant")))
    need = stash(need.drop("options").join(specs.select(F.monotonically_increasing_id().alias("spec_id"), F.to_json("options").alias("options")), "spec_id"), "specs")
    judged = coverage.admit(need, active)
    return judged.where("accepted"), judged.where("not accepted")


def source_coverage(specs: DataFrame, active: DataFrame) -> DataFrame:
    """Execution mode of every active source, from its specs and those that are blocked."""
    fine, blocked = admitted(specs, active)
    gone = blocked.select(F.explode("required").alias("source_id"))
    return planning.modes(fine.select("source_id", "adapter", "required"), active, gone)
