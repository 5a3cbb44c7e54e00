"""The key log: ten runs equal one, repeated and dead runs change nothing, reports end to end."""

import random

import pytest

from gleaner.operators import commits
from gleaner.operators.known_keys import KnownKeys, import_report


def frame(spark, keys):
    return spark.createDataFrame([(k,) for k in keys], "key string")


def test_ten_runs_equal_one(spark, tmp_path):
    rng, known, all_ = random.Random(1), KnownKeys.load(spark, str(tmp_path / "k")), set()
    for run in range(6):
        keys = [f"k{rng.randrange(60)}" for _ in range(rng.choice([0, 3, 40]))] + [None]
        probe = [f"k{i}" for i in range(0, 60, 3)] + ["odd", None]
        assert {r.key for r in known.find(frame(spark, probe)).collect()} == all_ & set(probe)
        known = known.add(frame(spark, keys), f"run {run}")
        all_ |= set(keys) - {None}
        if run == 3:
            assert known.add(frame(spark, ["never"]), "run 3") is known  # the same run again
    assert sum(n for _, n, _ in known.layers) == len(all_) and len(known.layers) <= 4
    one = KnownKeys.load(spark, str(tmp_path / "one")).add(frame(spark, sorted(all_)), "all")
    probe = frame(spark, [f"k{i}" for i in range(90)])
    assert {r.key for r in one.find(probe).collect()} == {r.key for r in known.find(probe).collect()} == all_


def test_dead_run_and_two_writers(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "k")
    known = KnownKeys.load(spark, root).add(frame(spark, ["a"]), "1")

    def dies(*_):
        raise OSError

    with monkeypatch.context() as m:
        m.setattr(commits, "_publish", dies)
        with pytest.raises(OSError):
            known.add(frame(spark, ["b"]), "2")
    assert KnownKeys.load(spark, root).find(frame(spark, ["a", "b"])).count() == 1
    known.add(frame(spark, ["b"]), "2")
    with pytest.raises(commits.Conflict):
        known.add(frame(spark, ["c"]), "3")


def test_reports_end_to_end(spark, tmp_path):
    obs = "ordinal int, source_id string, job_id string, title string, description string, location string, url string, employer string, published_hint string, evidence string, review_status string"
    sources = spark.createDataFrame([("s", "board", "Source", "https://s.nl", "2026")], "source_id string, source_type string, source_name string, url string, checked_at string")
    lead = lambda n, i: (n, "s", f"j{i}", "WordPress developer", "", "Remote", f"https://x.nl/j/{i}", "Acme", "2026-09-06", "e", "unverified")

    def run(known, at, *ids):
        rows = spark.createDataFrame([lead(n, i) for n, i in enumerate(ids)], obs)
        return import_report(rows, sources, sources, known, generated_at=at, family="wordpress", now="2026-09-06T10:00:00Z", now_s=1788688800.0)

    known = KnownKeys.load(spark, str(tmp_path / "k"))
    faults, rows, known = run(known, "2026-09-06T09:00:00Z", 1, 2, 1)
    assert faults == [] and [r.job_id for r in rows.orderBy("ordinal").collect()] == ["j1", "j2"]
    faults, rows, known = run(known, "2026-09-06T09:30:00Z", 2, 3)
    assert [r.job_id for r in rows.collect()] == ["j3"] and len(known.labels) == 2
    faults, rows, same = run(known, "2026-09-05T09:30:00Z", 4)
    assert faults == ["stale_or_future"] and rows.count() == 0 and same is known
