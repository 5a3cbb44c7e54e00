"""Keyed state with timers: source health and due times, and jobs that their sources stop showing, as streams.

Both are `transformWithState` processors on the RocksDB store, so state lives on the executors, is checkpointed with the
stream and grows with sources and jobs, not with runs. Rows of one micro-batch may come in any order; micro-batches come
in the order of time (a run reports when it ends). Rows with null keys are left out.
"""

from __future__ import annotations

import sys
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# the process that sets up a processor on the driver has not the application's path: send this module's classes themselves
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HEALTH = "source_instance string, event string, last_success double, last_failure double, consecutive_failures long, run_count long, due_at double"
NEVER = float("-inf")
SIGHTS = "source_instance string, job string, event string, run_number long"


def use_rocksdb(spark: SparkSession) -> None:
    """These processors need this store; streams started from now on use it."""
    spark.conf.set(_STORE, _ROCKSDB)


def backoff_seconds(failures: int) -> float:
    return 60 * min(240.0, 15 * 2.0 ** min(5, min(10, failures) - 1)) if failures > 0 else 0.0


class _Health(StatefulProcessor):
    """Per bucket of sources, for each: last success and failure, failures since then, number of runs, and when a timer is to
    fire; the bucket's own timer is that of the source that is due first.

    A call into the store or a data frame costs more than a source's rows do, so a bucket is read and written as a whole.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.health = handle.getListState("health", "source string, ok double, bad double, failures long, runs long, retry_at double, timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stored = {source: h for source, *h in self.health.get()}
        now, soon = {}, timerValues.getCurrentProcessingTimeInMs() + 1
        for part in rows:
            for source, at, success, cadence, wait in zip(*(part[c].tolist() for c in ("source_instance", "at", "success", "cadence", "retry_at"))):
                if source not in now:
                    ok, bad, _, _, retry_at, _ = stored.get(source, [None] * 6)
                    now[source] = [NEVER if ok is None else ok, NEVER if bad is None else bad, 0, None, retry_at or 0.0, array("d")]
                h = now[source]
                if not success:
                    h[5].append(at)
                    h[1] = max(h[1], at)
                elif at > h[0]:
                    h[0] = at
                h[2] += 1
                h[3] = cadence
                if wait > h[4]:  # no wait is not above anything
                    h[4] = wait
        out = []
        for source, (ok, bad, n, cadence, retry_at, fails) in now.items():
            ok_before, bad_before, failures, runs, _, _ = stored.get(source, (None, None, 0, 0, None, None))
            if ok > (NEVER if ok_before is None else ok_before) and not (bad_before is not None and bad_before > ok):
                failures = 0
            failures, runs = failures + sum(t > ok for t in fails), runs + n
            due = max(0.0, ok + cadence, bad + backoff_seconds(failures) if failures else 0.0, retry_at)
            ok, bad = (None if x == NEVER else x for x in (ok, bad))
            stored[source] = [ok, bad, failures, runs, retry_at or None, max(int(due * 1000), soon)]
            out.append((source, "run", ok, bad, failures, runs, due))
        self._keep(stored)
        yield self._rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentProcessingTimeInMs())
        stored, out = {source: h for source, *h in self.health.get()}, []
        for source, h in stored.items():
            if h[5] is not None and h[5] <= upto:
                out.append((source, "due", *h[:4], h[5] / 1000.0))
                h[5] = None
        if out:
            self._keep(stored)
            yield self._rows(out)

    def _keep(self, stored: dict[str, list]) -> None:
        self.health.put([(source, *h) for source, h in stored.items()])
        first = min((h[5] for h in stored.values() if h[5] is not None), default=None)
        timers = list(self.handle.listTimers())
        for t in timers:
            if t != first:
                self.handle.deleteTimer(t)
        if first is not None and first not in timers:
            self.handle.registerTimer(first)

    def _rows(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[f.split()[0] for f in HEALTH.split(", ")])

    def close(self) -> None:
        pass


def source_health_stream(runs: DataFrame, buckets: int = 1024) -> DataFrame:
    """runs (source_instance, at (epoch seconds), success, cadence (seconds between runs), retry_at (null: none)) -> HEALTH.

    One row, event run, per source and micro-batch with its health so far, and one, event due, once processing time has
    reached the source's due time: its cadence after the last success, its backoff after the last failure (`due` in
    review.py) and what a server asked to wait, whichever is last. A new run moves the timer. Sources are dealt over
    `buckets` keys, which a stream keeps for as long as its checkpoint lives; a bucket may have some thousand sources.
    """
    bucket = F.pmod(F.hash("source_instance"), F.lit(buckets)).alias("bucket")
    rows = runs.where("source_instance is not null and at is not null").select(bucket, "source_instance", F.col("at").cast("double").alias("at"), F.coalesce("success", F.lit(False)).alias("success"), F.col("cadence").cast("double").alias("cadence"), F.col("retry_at").cast("double").alias("retry_at"))
    return rows.groupBy("bucket").transformWithStateInPandas(_Health(), HEALTH, "Append", "ProcessingTime")


class _Sights(StatefulProcessor):
    """Per source and bucket of jobs: the number of complete runs, and the run in which each job was last seen."""

    def __init__(self, threshold: int) -> None:
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("total", "n long, last string")
        self.seen = handle.getMapState("seen", "job string", "n long, gone boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        total, last = self.total.get() if self.total.exists() else (0, "")
        latest: dict[str, str] = {}
        ended: set[str] = set()
        for part in rows:
            new = part[part["run_no"] > last]  # a run that came before is a repeat
            ended.update(new.loc[new["job"].isna(), "run_no"])
            top = new[new["job"].notna()].groupby("job")["run_no"].max()
            for job, run in top.items():
                latest[job] = max(run, latest.get(job, ""))
        number = {run: total + k for k, run in enumerate(sorted(ended), 1)}
        out = []
        for job, run in latest.items():
            n = number.get(run, total + len(number) + 1)
            gone = self.seen.containsKey((job,)) and bool(self.seen.getValue((job,))[1])
            self.seen.updateValue((job,), (n, False))
            out.append((key[0], job, "back" if gone else "seen", n))
        if number:
            total, last = total + len(number), max(number)
            self.total.update((total, last))
            for (job,), (n, gone) in list(self.seen.iterator()):
                if not gone and total - n >= self.threshold:
                    self.seen.updateValue((job,), (n, True))
                    out.append((key[0], job, "gone", n))
            out.append((key[0], None, "runs", total))
        if out:
            yield pd.DataFrame(out, columns=[f.split()[0] for f in SIGHTS.split(", ")])

    def close(self) -> None:
        pass


def sights_stream(sights: DataFrame, threshold: int = 2, buckets: int = 64) -> DataFrame:
    """sights (source_instance, job, run_no; job null: the complete run's end) -> SIGHTS.

    Events: seen and back (a job's last run, counted from 1), gone (missed by `threshold` complete runs since run_number)
    and runs (complete runs so far). A source's jobs are dealt over `buckets` keys, each of which gets the run's end, so
    that the largest source is spread over tasks; run_no sorts as text, and a job's missing runs are runs - run_number.
    """
    rows = sights.where("source_instance is not null and run_no is not null").select("source_instance", F.col("job").cast("string").alias("job"), F.col("run_no").cast("string").alias("run_no"))
    every = F.sequence(F.lit(0), F.lit(buckets - 1))
    bucket = F.when(F.col("job").isNull(), every).otherwise(F.array(F.pmod(F.hash("job"), F.lit(buckets))))
    dealt = rows.withColumn("bucket", F.explode(bucket))
    return dealt.groupBy("source_instance", "bucket").transformWithStateInPandas(_Sights(threshold), SIGHTS, "Append", "None")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, timers: bool = False) -> None:
    """Run a stream over what is there into parquet files, from where its checkpoint ends.

    With processing-time timers, which may always fire once more, the available-now trigger never ends: one micro-batch
    then takes all that is there, and fires the timers that are due by now.
    """
    use_rocksdb(stream.sparkSession)
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    query = (writer.trigger(once=True) if timers else writer.trigger(availableNow=True)).start()
    query.awaitTermination()
