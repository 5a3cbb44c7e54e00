import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.operators import canonical, graph, screening, state

OBS = "ordinal long, source_id string, source_type string, source_job_id string, canonical_url string, url string, title string, employer string, location string, published_at string, first_seen_at string, last_seen_at string"


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(41)} | {k: 100 for k in range(100, 130)}
    assert graph.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


@pytest.mark.parametrize("chunk", [3, 500_000])
def test_components_with_a_hub(spark, chunk):
    r = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in zip(r.integers(1000, 4000, 900), r.integers(1000, 4000, 900))]
    edges += [(7, int(x)) for x in r.choice(np.arange(1000, 4000), 1000, replace=False)] + [(9000 + i, 9001 + i) for i in range(60)] + [(10**6, 9000), (10**6, 9030)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    linked = {x for a, b in edges if a != b for x in (a, b)}
    df = spark.createDataFrame(edges, "src long, dst long").repartition(7)
    got = sorted(map(tuple, graph.connected_components(df, chunk=chunk).collect()))
    assert got == sorted((x, top(x)) for x in linked)


def test_components_grow_by_batches(spark):
    r = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in zip(r.integers(0, 120, 90), r.integers(0, 120, 90))] + [(None, 1), (4, 4)]
    make = lambda rows: spark.createDataFrame(rows, "src long, dst long")
    grown = spark.createDataFrame([], "node long, component long")
    for k in range(0, len(edges), 31):
        grown = graph.stash(graph.merge_components(grown, make(edges[k : k + 31])), "grown")
        assert sorted(map(tuple, grown.collect())) == sorted(map(tuple, graph.connected_components(make(edges[: k + 31])).collect()))


def test_components_that_do_not_end_are_an_error(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(500)], "src long, dst long").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    try:
        with pytest.raises(ValueError, match="not complete"):
            graph.connected_components(chain, max_rounds=0, chunk=1)
        assert graph.connected_components(chain, chunk=1).select("component").distinct().count() == 1
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_canonicalize(spark):
    rows = [
        (0, "b", "search", "1", None, "https://x.example/j/1?utm_source=a", "Dev", "Acme", None, None, "2026-01-02", "2026-01-03"),
        (1, "a", "ats", "9", None, "https://x.example/j/1", "Developer", "Acme", "NL", "2026-01-01", "2026-01-01", "2026-01-02"),
        (2, "b", "search", "1", None, "https://x.example/jobs", "Dev", "Acme", None, "2026-01-05", None, None),
        (3, "c", "search", None, None, "https://x.example/jobs", "Developer", "ACME ", "nl", None, None, None),
        (4, None, None, None, None, None, None, None, None, None, None, None),
    ]
    all_ = canonical.canonicalize(spark.createDataFrame(rows, OBS)).collect()
    a = [r for r in all_ if r.observation_count == 3][0]
    assert (a.title, a.published_at, a.published_at_candidates, a.published_at_conflict) == ("Developer", "2026-01-01", ["2026-01-01", "2026-01-05"], True)
    assert (a.first_seen_at, a.last_seen_at, a.source_ids) == ("2026-01-01", "2026-01-03", ["a", "b"])
    assert sorted(r.observation_count for r in all_) == [1, 1, 3]
    assert [r.duplicate_candidate_count for r in all_ if r.employer] == [2, 2]


BATCH = "ordinal long, keys array<string>, canonical_url string, content_hash string, payload string, snippet boolean"


def test_upsert_lifecycle(spark):
    s = state.State.empty(spark)

    def step(rows, n, **kw):
        nonlocal s
        s, c = state.upsert(spark.createDataFrame([(i, k, f"u{i}", h, "{}", False) for i, (k, h) in enumerate(rows)], BATCH), s, instance=kw.pop("instance", "a"), run_id=f"r{n}", now=f"2026-01-0{n}", **kw)
        s = state.State(*[graph.stash(getattr(s, t)) for t in state.TABLES])
        return tuple(c.first())

    names = ("new", "updated", "unchanged", "duplicate", "closed")
    assert dict(zip(names, step([(["x"], "1"), (["y"], "1"), (["x"], "2")], 1))) == {"new": 2, "updated": 1, "unchanged": 0, "duplicate": 1, "closed": 0}
    assert step([(["x"], "2")], 2) == (0, 0, 1, 0, 0)
    assert step([(["x"], "3")], 3, complete=False) == (0, 1, 0, 0, 0)
    assert step([(["x"], "3")], 4) == (0, 0, 1, 0, 1)
    status = {r.content_hash: r.status for r in s.jobs.collect()}
    assert status == {"3": "active", "1": "closed"}
    assert step([(["y"], "1")], 5) == (0, 0, 1, 0, 0)
    assert {r.status for r in s.jobs.collect()} == {"active"}
    assert s.snapshots.count() == 4
    step([(["x", "y"], "9")], 6)
    assert s.jobs.count() == 1 and s.identities.select("job_id").distinct().count() == 1


def test_change_state_and_health(spark):
    b = spark.createDataFrame([(0, ["x"], "u", "1", "{}", False), (1, ["n"], "u", "1", "{}", False), (2, ["x"], "u", "2", "{}", True), (3, ["x"], "u", "2", "{}", False)], BATCH)
    s, _ = state.upsert(b.where("ordinal = 0"), state.State.empty(spark), instance="a", run_id="r", now="2026")
    assert [r.change for r in state.change_state(b, s, "a", True).orderBy("ordinal").collect()] == ["unchanged", "new", "unchanged", "updated"]
    runs = spark.createDataFrame([("a", "1", "t1", True, 5, None), ("a", "2", "t2", False, None, "x"), ("a", "3", "t3", False, None, "y"), ("b", "4", "t1", True, 1, None)], "source_instance string, run_id string, started_at string, success boolean, result_count int, failure_category string")
    h = {r.source_instance: r for r in state.source_health(runs).collect()}
    assert (h["a"].consecutive_failures, h["a"].failure_category, h["a"].retry_seconds, h["b"].consecutive_failures) == (2, "y", 120, 0)


def test_screening(spark):
    rows = spark.createDataFrame([(0, ["a"]), (1, ["a", "b"]), (2, ["b"]), (3, ["c"])], "ordinal long, keys array<string>")
    assert [r.ordinal for r in screening.drop_seen(rows).orderBy("ordinal").collect()] == [0, 3]
    judged = screening.cascade(rows, [("odd", F.col("ordinal") == 1)], [F.desc("ordinal")], 2)
    assert {r.ordinal: r.reject_reason for r in judged.collect()} == {0: "limit", 1: "odd", 2: None, 3: None}
    t = lambda rows, s: spark.createDataFrame(rows, s)
    ids = screening.history_ids(t([("v1", "applied"), ("v2", "new")], "vacancy_id string, status string"), t([("v3",)], "vacancy_id string"), t([("v4", "Interested", "TRUE")], "vacancy_id string, state string, applied string"), t([("v5", "x", "rejected")], "vacancy_id string, event_type string, status_after string"), ["applied", "rejected"], [], {})
    assert sorted(r[0] for r in ids.collect()) == ["v1", "v3", "v4", "v5"]
    with pytest.raises(ValueError):
        screening.history_ids(None, None, None, None, [], [], {})
