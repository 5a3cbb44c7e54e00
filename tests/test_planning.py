from datetime import datetime, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.operators import planning as P


def select(ordered, limit):
    """One selection as a loop: half of the applicant systems, then feeds, then what is left in order."""
    ats, feeds = [x for x in ordered if x[1]], [x for x in ordered if not x[1]]
    if ats and feeds and limit >= 2:
        half = max(1, limit // 2)
        chosen = ats[:half] + feeds[: limit - half]
        chosen += [x for x in ordered if x not in chosen][: limit - len(chosen)]
        return chosen
    return ordered[:limit]


@pytest.mark.parametrize("n_ats,n_feeds,size", [(20, 20, 8), (3, 30, 8), (30, 2, 8), (0, 9, 4), (9, 0, 4), (7, 5, 3), (5, 5, 1), (1, 1, 8), (10, 4, 5)])
def test_pool_is_repeated_selection(spark, n_ats, n_feeds, size):
    rng = np.random.default_rng(n_ats * 100 + n_feeds)
    kinds = rng.permutation([True] * n_ats + [False] * n_feeds).tolist()
    rows = [(f"i{k}", bool(a), k) for k, a in enumerate(kinds)]
    left, want = list(rows), []
    while left:
        chosen = select(left, size)
        want.append({x[0] for x in chosen})
        left = [x for x in left if x not in chosen]
    df = spark.createDataFrame(rows + [(rows[0][0], rows[0][1], 999)], "instance string, ats boolean, position int")
    got = [r.instance for r in P.pool(df, F.col("ats"), [F.col("position")], size).orderBy("pool_index").collect()]
    at = 0
    for batch in want:
        assert set(got[at : at + len(batch)]) == batch
        at += len(batch)
    assert at == len(got)
    if len(rows) > 4:
        seen = []
        for r in range(-(-len(rows) // 4)):
            seen += [x.instance for x in P.plan_batches(df, F.col("ats"), [F.col("position")], max_sources=4, size=size, round_index=r).orderBy("turn").collect()]
        assert set(seen) == {x[0] for x in rows}


def test_stop_and_budget(spark):
    b = spark.createDataFrame([(i // 2, f"s{i}") for i in range(8)], "batch long, instance string")
    found = spark.createDataFrame([(0, 1), (1, 2), (3, 9)], "batch long, verified long")
    ran = P.stop_after(b, found, 3).collect()
    assert {r.batch for r in ran} == {0, 1} and {r.stop_reason for r in ran} == {"verified_target_reached"}
    assert {r.stop_reason for r in P.stop_after(b, found, 99).collect()} == {"planned_sources_exhausted"}
    assert {r.batch for r in P.stop_after(b, found, 1, exhaustive=True).collect()} == {0, 1, 2, 3}
    c = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c")], "k int, url string")
    assert {r.k for r in P.page_budget(c, "url", [F.col("k")], 2).where("in_budget").collect()} == {1, 2, 3}


@pytest.mark.parametrize("text,fine", [("2026-09-06T10:00:00Z", True), ("2026-09-06T10:00:00+02:00", True), ("2026-09-06T10:00:00", False), ("2019-12-31T23:00:00Z", False), ("2026-09-06T12:04:59Z", True), ("2026-09-06T12:06:00Z", False), ("soon", False), (None, False), ("2026-13-01T00:00:00Z", False)])
def test_timestamps(spark, text, fine):
    asof = datetime(2026, 9, 6, 12, tzinfo=timezone.utc)
    df = spark.createDataFrame([(text,)], "t string").select(P.utc_timestamp(F.col("t"), asof).alias("x"))
    assert (df.first().x is not None) == fine


def test_attempts_and_summaries(spark):
    asof = datetime(2026, 9, 6, 12, tzinfo=timezone.utc)
    rows = [("true", "2026-09-06T10:00:00Z", ["a", "b"], 5), ("1", "2026-09-06T10:00:00Z", ["a"], 5), ("false", "x", ["a"], 5), ("false", "2026-09-06T10:00:00Z", [], 5), ("true", "2026-09-06T10:00:00Z", ["a"], 100_001), ("true", "2026-09-06T10:00:00Z", ["a", " "], 1)]
    df = spark.createDataFrame(rows, "s string, started_at string, registry_source_ids array<string>, fetched long").withColumn("success", F.parse_json("s"))
    assert [r.valid for r in P.valid_attempts(df, asof).collect()] == [True, False, False, False, False, False]
    runs = spark.createDataFrame([("a:1", True), ("b:1", False), ("c:1", False)], "source_instance string, success boolean")
    assert tuple(P.run_status(runs).first()) == (3, 1, ["b:1", "c:1"], "partial")
    judged = spark.createDataFrame([("u1", "verified", None, True), ("u2", "verified", None, True), ("u3", "pending", None, False), ("u4", "ineligible", "x", True)], "canonical_url string, status string, reject_reason string, in_budget boolean")
    assert tuple(P.evaluation_summary(judged, judged.where("canonical_url = 'u1'")).first()) == (4, 3, 1, 2, 1, 1, 1)
    active = spark.createDataFrame([("a", "company"), ("b", "company"), ("c", "application_evidence"), ("d", "company")], "source_id string, source_type string")
    specs = spark.createDataFrame([("a", "lever", ["a"]), ("g", "serpapi_google", ["a", "d"])], "source_id string, adapter string, required array<string>")
    got = {r.source_id: r.execution_mode for r in P.modes(specs, active, active.where("source_id = 'd'")).collect()}
    assert got == {"a": "public_adapter", "b": "live_web_queue", "c": "evidence_only", "d": "blocked"}
