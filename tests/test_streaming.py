from gleaner.operators import state
from gleaner.streaming import lifecycle

BATCH = "ordinal long, keys array<string>, canonical_url string, content_hash string, payload string, snippet boolean"


def test_stream_equals_batch(spark, tmp_path):
    src, root = str(tmp_path / "in"), str(tmp_path / "state")
    runs = [[(0, ["x"], "u", "1", "{}", False), (1, ["y"], "u", "1", "{}", False)], [(0, ["x"], "u", "2", "{}", False)]]
    for n, r in enumerate(runs):
        spark.createDataFrame(r, BATCH).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(BATCH).parquet(src)
        lifecycle.upsert_stream(stream, root, "a", str(tmp_path / "cp"), "2026-01-01").start().awaitTermination(120)
    got = state.State.load(spark, root)
    want = state.State.empty(spark)
    for n, r in enumerate(runs):
        want, _ = state.upsert(spark.createDataFrame(r, BATCH), want, instance="a", run_id=str(n), now=f"2026-01-01#{n:09d}")
    pick = lambda s: sorted(tuple(r) for r in s.jobs.select("job_id", "content_hash", "status").collect())
    assert pick(got) == pick(want)
    assert got.snapshots.count() == 3
