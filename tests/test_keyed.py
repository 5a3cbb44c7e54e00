"""Keyed streams: closings and returns, health, timers, all over a restart."""

from gleaner.streaming import keyed

RUNS = "source_instance string, at double, success boolean, cadence double, retry_at double"


def feed(spark, tmp_path, schema, parts, make, timers):
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        keyed.run_to_table(make(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp"), timers)
    return spark.read.parquet(str(tmp_path / "out"))


def test_jobs_go_and_come_back(spark, tmp_path):
    run = lambda n, *jobs: [("a", j, n) for j in jobs] + [("a", None, n)]
    parts = [run("1", "x", "y") + run("2", "x") + [("b", "x", "1"), (None, "x", "1")], run("2", "y") + run("3", "x") + run("4", "x", "y")]
    out = feed(spark, tmp_path, "source_instance string, job string, run_no string", parts, lambda s: keyed.sights_stream(s, buckets=2), False)
    got = sorted((r.source_instance, r.job or "", r.event, r.run_number) for r in out.distinct().collect())
    # run 2 is known by then, so its repeat changes nothing
    assert got == [("a", "", "runs", 2), ("a", "", "runs", 4), ("a", "x", "seen", 2), ("a", "x", "seen", 4), ("a", "y", "seen", 1), ("a", "y", "seen", 4), ("b", "x", "seen", 1)]


def test_gone_once_then_back(spark, tmp_path):
    parts = [[("a", "x", "1"), ("a", None, "1"), ("a", None, "2"), ("a", None, "3")], [("a", None, "4")], [("a", "x", "5"), ("a", None, "5")]]
    out = feed(spark, tmp_path, "source_instance string, job string, run_no string", parts, lambda s: keyed.sights_stream(s, buckets=1), False)
    assert sorted((r.event, r.run_number) for r in out.where("job is not null").collect()) == [("back", 5), ("gone", 1), ("seen", 1)]


def test_health_and_due_timers(spark, tmp_path):
    parts = [[("a", 1.0, True, 10.0, None), ("a", 3.0, False, 10.0, None), ("b", 1.0, False, 10.0, 5e10)], [("a", 4.0, False, 10.0, None)]]
    out = feed(spark, tmp_path, RUNS, parts, keyed.source_health_stream, True)
    run = sorted((r.source_instance, r.run_count, r.consecutive_failures, r.due_at) for r in out.where("event = 'run'").collect())
    assert run == [("a", 2, 1, 903.0), ("a", 3, 2, 1804.0), ("b", 1, 1, 5e10)]
    assert {r.source_instance for r in out.where("event = 'due'").collect()} <= {"a"}  # b was asked to wait for longer


def test_health_by_bucket(spark, tmp_path):
    # 40 sources in two buckets; each has one more run in the second micro-batch, but the last ten, whose timers then fire
    first = [(f"s{k}", 1.0 + k, k % 2 == 0, 10.0, None) for k in range(40)]
    later = [(f"s{k}", 100.0, False, 10.0, None) for k in range(30)]
    out = feed(spark, tmp_path, RUNS, [first, later], lambda s: keyed.source_health_stream(s, buckets=2), True)
    run = {(r.source_instance, r.run_count): (r.consecutive_failures, r.due_at) for r in out.where("event = 'run'").collect()}
    want = {(f"s{k}", 1): (0, 11.0 + k) if k % 2 == 0 else (1, 901.0 + k) for k in range(40)}
    assert run == want | {(f"s{k}", 2): (1, 1000.0) if k % 2 == 0 else (2, 1900.0) for k in range(30)}
    assert sorted(r.source_instance for r in out.where("event = 'due'").collect()) == [f"s{k}" for k in range(30, 40)]


def test_stored_failures_end_with_a_success(spark, tmp_path):
    # the success comes after the stored failure, in another part of the micro-batch than the next failure
    parts = [[("a", 3.0, False, 10.0, None)], [("a", 10.0, False, 10.0, None), ("a", 5.0, True, 10.0, None)]]
    most = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(most, "1")
    try:
        out = feed(spark, tmp_path, RUNS, parts, keyed.source_health_stream, True)
    finally:
        spark.conf.unset(most)
    assert sorted((r.run_count, r.consecutive_failures, r.due_at) for r in out.where("event = 'run'").collect()) == [(1, 1, 903.0), (3, 1, 910.0)]
