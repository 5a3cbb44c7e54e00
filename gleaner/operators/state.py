"""Durable job state between runs: identities, change detection, upsert, missing runs and closing, source health.

State is a set of tables; every operator reads the old version and returns the new one, so nothing reads what it
overwrites. Versions are committed atomically (`commits.py`), each after the one it was made from. Orders within a batch
come from `ordinal`; job ids are digests of the first identity key, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.operators import commits
from gleaner.operators.canonical import clusters
from gleaner.operators.graph import stash

TABLES = {
    "jobs": "job_id string, canonical_url string, content_hash string, payload string, status string, first_seen_at string, last_seen_at string, closed_at string",
    "identities": "identity_key string, job_id string",
    "snapshots": "job_id string, content_hash string, payload string, first_seen_at string, last_seen_at string",
    "memberships": "source_instance string, job_id string, missing_runs int, last_seen_run string, close_threshold int",
    "runs": "run_id string, source_instance string, started_at string, finished_at string, success boolean, result_count int, failure_category string",
}


@dataclass
class State:
    jobs: DataFrame
    identities: DataFrame
    snapshots: DataFrame
    memberships: DataFrame
    runs: DataFrame
    version: int = 0
    label: str = ""

    @classmethod
    def empty(cls, spark: SparkSession) -> State:
        return cls(**{n: spark.createDataFrame([], s) for n, s in TABLES.items()})

    @classmethod
    def load(cls, spark: SparkSession, root: str) -> State:
        """The last committed version; empty where there was never one."""
        last = commits.latest(spark, root)
        if last is None:
            return cls.empty(spark)
        return cls(**{n: spark.read.schema(s).parquet(f"{last.folder}/{n}") for n, s in TABLES.items()}, version=last.number, label=last.label)

    def save(self, root: str, label: str = "") -> State:
        """Commit this state after the version that it was loaded from; commits.Conflict if another one came between."""
        spark = self.jobs.sparkSession
        commits.commit(spark, root, {n: getattr(self, n) for n in TABLES}, self.version, label)
        return State.load(spark, root)


def content_hash(*columns: Column) -> Column:
    """Digest of columns, null and empty apart."""
    return F.sha2(F.to_json(F.array(*[F.coalesce(F.to_json(F.struct(c.cast("string").alias("v"))), F.lit("")) for c in columns])), 256)


def change_state(batch: DataFrame, state: State, instance: str, authoritative: bool) -> DataFrame:
    """batch (ordinal, keys, content_hash, snippet) with change: new, updated or unchanged against the old state."""
    matched = batch.select("ordinal", F.explode("keys").alias("identity_key")).join(state.identities, "identity_key").select("ordinal", "job_id").distinct()
    known = matched.join(state.jobs.select("job_id", F.col("content_hash").alias("_old")), "job_id")
    foreign = state.memberships.where(F.col("source_instance") != instance).select("job_id", F.lit(True).alias("_foreign")).distinct()
    per = known.join(foreign, "job_id", "left").groupBy("ordinal").agg(F.collect_set("_old").alias("_hashes"), F.coalesce(F.bool_or("_foreign"), F.lit(False)).alias("_foreign"))
    same = (F.lit(not authoritative) & F.col("_foreign")) | F.coalesce(F.col("snippet"), F.lit(False)) | F.array_contains("_hashes", F.col("content_hash"))
    change = F.when(F.col("_hashes").isNull(), "new").when(same, "unchanged").otherwise("updated")
    return batch.join(per, "ordinal", "left").withColumn("change", change).drop("_hashes", "_foreign")


def duplicate_in_batch(batch: DataFrame, keys: str = "keys") -> DataFrame:
    """batch with duplicate: whether an earlier row has one of its keys."""
    owned = batch.select("ordinal", F.explode(keys).alias("key"))
    first = owned.groupBy("key").agg(F.min("ordinal").alias("first"))
    late = owned.join(first, "key").groupBy("ordinal").agg((F.min("first") < F.col("ordinal")).alias("duplicate"))
    return batch.join(late, "ordinal", "left").withColumn("duplicate", F.coalesce("duplicate", F.lit(False)))


def resolved(rows: DataFrame, state: State) -> tuple[DataFrame, DataFrame, Callable[[DataFrame], DataFrame]]:
    """rows (ordinal, keys) -> (ordinal, keys, part), (part, job_id, merged, least_key) and what takes stored tables to the parts' ids.

    Rows are tied to stored jobs and to each other by shared keys; a part takes the least stored id, or a digest of its
    least key.
    """
    stored = state.identities.select(F.col("identity_key").alias("key"), "job_id")
    # parts over batch rows, then over the stored jobs that they touch
    linked = clusters(rows, F.col("keys"))
    touched = linked.select("cluster", F.explode("keys").alias("key")).join(stored, "key").select("cluster", "job_id").distinct()
    bridge = clusters(touched.groupBy("cluster").agg(F.collect_set("job_id").alias("ids")).withColumnRenamed("cluster", "ordinal"), F.col("ids"))
    part = linked.join(bridge.select(F.col("ordinal").alias("cluster"), F.col("cluster").alias("_whole")), "cluster", "left").withColumn("part", F.coalesce("_whole", "cluster"))
    ids = part.join(touched, "cluster", "left").groupBy("part").agg(F.min("job_id").alias("old"), F.collect_set("job_id").alias("merged"), F.min(F.array_min("keys")).alias("least_key"))
    part = stash(part.select("ordinal", "keys", "part"), "parts")
    ids = stash(ids.withColumn("job_id", F.coalesce("old", F.sha2(F.col("least_key"), 256))), "ids")
    moved = ids.select(F.explode("merged").alias("from"), "job_id").where(F.col("from") != F.col("job_id"))
    if moved.isEmpty():  # stored tables stay where they are
        return part, ids, lambda df: df

    def follow(df: DataFrame) -> DataFrame:
        return df.join(moved.withColumnRenamed("job_id", "_to"), df["job_id"] == F.col("from"), "left").withColumn("job_id", F.coalesce("_to", "job_id")).drop("_to", "from")

    return part, ids, follow


def merged_jobs(state: State, ids: DataFrame, follow: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Stored jobs under the parts' ids; of those that became one, the one that keeps its id stays."""
    moved = ids.select(F.explode("merged").alias("from"), "job_id").where(F.col("from") != F.col("job_id"))
    if moved.isEmpty():
        return state.jobs
    kept = W.partitionBy("job_id").orderBy(F.col("_moved"), F.col("last_seen_at").desc())
    jobs = follow(state.jobs.withColumn("_id", F.col("job_id"))).withColumn("_moved", F.col("_id") != F.col("job_id"))
    jobs = jobs.join(moved.select("job_id").distinct(), "job_id", "left_semi").withColumn("_r", F.row_number().over(kept)).where("_r = 1").unionByName(
        jobs.join(moved.select("job_id").distinct(), "job_id", "left_anti").withColumn("_r", F.lit(1))
    )
    return jobs.drop("_id", "_moved", "_r")


def upsert(batch: DataFrame, state: State, *, instance: str, run_id: str, now: str, authoritative: bool = True, complete: bool = True, close_threshold: int = 2) -> tuple[State, DataFrame]:
    """Apply a batch (ordinal, keys, canonical_url, content_hash, payload, snippet); the new state and the counters.

    Row by row effects inside a part (each row compares with what the one before left) are a lag over the ordinal.
    """
    rows = batch.where(F.size("keys") > 0)
    part, ids, follow = resolved(rows.select("ordinal", "keys"), state)
    members = follow(state.memberships)
    if not authoritative:
        members = members.where(F.col("source_instance") != instance)
    members = members.groupBy("source_instance", "job_id").agg(
        F.min("missing_runs").alias("missing_runs"), F.max("last_seen_run").alias("last_seen_run"), F.max("close_threshold").alias("close_threshold")
    )
    owned = members.select("job_id").distinct().withColumn("_owned", F.lit(True))
    jobs_old = merged_jobs(state, ids, follow)
    seen = part.select("ordinal", "part").join(ids.select("part", "job_id"), "part").join(rows.drop("keys"), "ordinal")
    seen = seen.join(jobs_old.select("job_id", F.col("content_hash").alias("_stored")), "job_id", "left").join(owned, "job_id", "left")
    quiet = F.coalesce(F.col("snippet"), F.lit(False)) | (F.lit(not authoritative) & F.coalesce(F.col("_owned"), F.lit(False)))
    order = W.partitionBy("job_id").orderBy("ordinal")
    fresh = F.col("_stored").isNull() & (F.row_number().over(order) == 1)
    seen = seen.withColumn("_fresh", fresh)
    fresh = F.col("_fresh")
    effective = F.when(fresh | ~quiet, F.col("content_hash"))
    before = F.coalesce(F.last(effective, True).over(order.rowsBetween(W.unboundedPreceding, -1)), F.col("_stored"))
    seen = seen.withColumn("change", F.when(fresh, "new").when(quiet, "unchanged").when(before == F.col("content_hash"), "unchanged").otherwise("updated"))
    seen = stash(seen.withColumn("writes", fresh | ~quiet), "seen")

    last = lambda c: F.max_by(c, F.when(F.col("writes"), F.col("ordinal")))
    new = seen.groupBy("job_id").agg(last("canonical_url").alias("n_url"), last("content_hash").alias("n_hash"), last("payload").alias("n_payload"), F.bool_or("writes").alias("wrote"))
    jobs = jobs_old.join(new, "job_id", "full").select(
        "job_id",
        F.coalesce("n_url", "canonical_url").alias("canonical_url"),
        F.coalesce("n_hash", "content_hash").alias("content_hash"),
        F.coalesce("n_payload", "payload").alias("payload"),
        F.when(F.col("wrote"), F.lit("active")).otherwise(F.col("status")).alias("status"),
        F.coalesce("first_seen_at", F.lit(now)).alias("first_seen_at"),
        F.when(F.col("wrote").isNotNull(), F.greatest(F.col("last_seen_at"), F.lit(now))).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
        F.when(F.coalesce(F.col("wrote"), F.lit(False)), F.lit(None)).otherwise(F.col("closed_at")).alias("closed_at"),
    )
    keys = part.select("part", F.explode("keys").alias("identity_key")).join(ids.select("part", "job_id"), "part").select("identity_key", "job_id").distinct()
    identities = follow(state.identities).join(keys.select("identity_key"), "identity_key", "left_anti").unionByName(keys)
    shot = seen.where(F.col("writes") & (F.coalesce("content_hash", F.lit("")) != "")).select("job_id", "content_hash", "payload", F.lit(now).alias("first_seen_at"), F.lit(now).alias("last_seen_at"))
    snapshots = merge_snapshots(follow(state.snapshots).unionByName(shot))

    if authoritative:
        present = seen.where(~F.coalesce("snippet", F.lit(False))).select("job_id").distinct().withColumn("_here", F.lit(True))
        mine, others = members.where(F.col("source_instance") == instance), members.where(F.col("source_instance") != instance)
        both = mine.join(present, "job_id", "full")
        mine = both.select(
            F.lit(instance).alias("source_instance"),
            "job_id",
            F.when(F.col("_here"), 0).otherwise(F.col("missing_runs") + (1 if complete else 0)).cast("int").alias("missing_runs"),
            F.when(F.col("_here"), F.lit(run_id)).otherwise(F.col("last_seen_run")).alias("last_seen_run"),
            F.when(F.col("_here"), F.lit(max(2, close_threshold))).otherwise(F.col("close_threshold")).cast("int").alias("close_threshold"),
        )
        members = others.unionByName(mine)
    closing = globally_missing(members).join(members.where((F.col("source_instance") == instance) & (F.col("missing_runs") > 0)), "job_id", "left_semi")
    closes = authoritative and complete
    jobs = jobs.join(closing.select("job_id", F.lit(closes).alias("_close")), "job_id", "left")
    ends = F.coalesce(F.col("_close"), F.lit(False)) & (F.col("status") == "active")
    counters = seen.agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("new", "updated", "unchanged")])
    counters = counters.crossJoin(duplicate_in_batch(batch).agg(F.count_if("duplicate").alias("duplicate"))).crossJoin(jobs.agg(F.count_if(ends).alias("closed")))
    jobs = jobs.withColumn("closed_at", F.when(ends, F.lit(now)).otherwise(F.col("closed_at"))).withColumn("status", F.when(ends, "closed").otherwise(F.col("status"))).drop("_close")
    return replace(state, jobs=jobs, identities=identities, snapshots=snapshots, memberships=members), counters


def merge_snapshots(df: DataFrame) -> DataFrame:
    return df.groupBy("job_id", "content_hash").agg(F.max_by("payload", "last_seen_at").alias("payload"), F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"))


def globally_missing(members: DataFrame) -> DataFrame:
    """Jobs that every source has missed often enough."""
    gone = F.col("missing_runs") >= F.greatest(F.lit(2), F.col("close_threshold"))
    return members.groupBy("job_id").agg(F.bool_and(gone).alias("gone")).where("gone").select("job_id")


def missing_runs(runs: DataFrame, sightings: DataFrame) -> DataFrame:
    """runs (instance, run_no), sightings (instance, job, run_no) -> instance, job, missing: complete runs since the last sight."""
    numbered = runs.withColumn("n", F.row_number().over(W.partitionBy("instance").orderBy("run_no")))
    total = numbered.groupBy("instance").agg(F.max("n").alias("total"))
    seen = sightings.join(numbered, ["instance", "run_no"]).groupBy("instance", "job").agg(F.max("n").alias("last"))
    return seen.join(total, "instance").select("instance", "job", (F.col("total") - F.col("last")).alias("missing"))


def retry_delay(streak: Column) -> Column:
    return F.least(F.lit(3600), (60 * F.pow(F.lit(2), F.least(streak, F.lit(20)) - 1)).cast("int"))


def source_health(runs: DataFrame) -> DataFrame:
    """runs (source_instance, run_id, started_at, success, ...) -> last success and failure, trailing failures, retry delay."""
    at = F.struct("started_at", "run_id")
    ok = runs.groupBy("source_instance").agg(
        F.max(F.when(F.col("success"), at)).alias("ok"), F.max(F.when(~F.col("success"), at)).alias("bad"), F.max_by("result_count", at).alias("last_result_count"), F.count("*").alias("run_count")
    )
    fails = runs.where("not success").join(ok.select("source_instance", "ok"), "source_instance").where(F.col("ok").isNull() | (at > F.col("ok")))
    streak = fails.groupBy("source_instance").agg(F.count("*").alias("consecutive_failures"), F.max_by("failure_category", at).alias("failure_category"))
    n = F.coalesce("consecutive_failures", F.lit(0))
    return ok.join(streak, "source_instance", "left").select(
        "source_instance",
        F.col("ok.started_at").alias("last_success_at"),
        F.col("bad.started_at").alias("last_failure_at"),
        n.alias("consecutive_failures"),
        "failure_category",
        F.when(n > 0, retry_delay(n)).alias("retry_seconds"),
        "last_result_count",
        "run_count",
    )
