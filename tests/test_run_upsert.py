"""All sources in one upsert against one source after the other, in plain Python and by the single-source upsert."""

import random

import pytest

from gleaner.operators import graph, state
from gleaner.operators.run_upsert import upsert_sources

BATCH = "source_instance string, ordinal long, keys array<string>, canonical_url string, content_hash string, payload string, snippet boolean"
SOURCES = "source_instance string, position int, authoritative boolean, complete boolean"


class Plain:
    """Sources in order, rows in order; jobs are named by their keys."""

    def __init__(self):
        self.jobs, self.members, self.shots = {}, {}, {}

    def job(self, keys):
        hit = [j for j in self.jobs if j & keys]
        assert len(hit) <= 1, "the made runs never join jobs"
        return hit[0] if hit else None

    def rename(self, old, new):
        self.jobs[new] = self.jobs.pop(old)
        self.members = {(i, new if j == old else j): n for (i, j), n in self.members.items()}
        self.shots = {(new if j == old else j, h): n for (j, h), n in self.shots.items()}

    def run(self, sources, batch, now):
        counts, review = {}, {}
        for name, _, authoritative, complete in sorted(sources, key=lambda s: s[1]):
            c = dict.fromkeys(("new", "updated", "unchanged", "duplicate", "closed"), 0)
            rows = sorted((r for r in batch if r[0] == name), key=lambda r: r[1])
            stored = {j: v["hash"] for j, v in self.jobs.items()}
            foreign = {j for i, j in self.members if i != name}
            if not authoritative:
                self.members = {k: v for k, v in self.members.items() if k[0] != name}
            used = set()
            for _, n, keys, url, h, payload, snippet in rows:
                keys = frozenset(keys)
                if not keys:
                    continue
                c["duplicate"] += bool(used & keys)
                used |= keys
                j = self.job(keys)
                old = [k for k in stored if j and k <= j]
                if not old:
                    review[name, n] = "new"
                elif (not authoritative and foreign & set(old)) or snippet or stored[old[0]] == h:
                    review[name, n] = "unchanged"
                else:
                    review[name, n] = "updated"
                if j is None:
                    j = keys
                    self.jobs[j] = {"hash": h, "status": "active", "first": now, "last": now, "closed": None, "url": url}
                    c["new"] += 1
                    wrote = True
                else:
                    if keys - j:
                        self.rename(j, j | keys)
                        j = j | keys
                    quiet = snippet or (not authoritative and any(m == j for _, m in self.members))
                    c["unchanged" if quiet or self.jobs[j]["hash"] == h else "updated"] += 1
                    wrote = not quiet
                    self.jobs[j]["last"] = now
                    if wrote:
                        self.jobs[j].update(hash=h, status="active", closed=None, url=url)
                if wrote and h:
                    self.shots.setdefault((j, h), now)
            if authoritative:
                here = {self.job(frozenset(r[2])) for r in rows if r[2] and not r[6]}
                for i, j in list(self.members):
                    if i == name and j not in here:
                        self.members[i, j] += complete
                for j in here:
                    self.members[name, j] = 0
                if complete:
                    for i, j in list(self.members):
                        if i == name and self.members[i, j] > 0 and all(v >= 2 for (_, k), v in self.members.items() if k == j) and self.jobs[j]["status"] == "active":
                            self.jobs[j].update(status="closed", closed=now)
                            c["closed"] += 1
            counts[name] = c
        return counts, review

    def tables(self):
        name = lambda j: ",".join(sorted(j))
        jobs = sorted((name(j), v["hash"], v["status"], v["first"], v["last"], v["closed"], v["url"]) for j, v in self.jobs.items())
        return jobs, sorted((i, name(j), n) for (i, j), n in self.members.items()), sorted((name(j), h, n) for (j, h), n in self.shots.items())


def tables(s):
    keys = {}
    for r in s.identities.collect():
        keys.setdefault(r.job_id, set()).add(r.identity_key)
    name = {j: ",".join(sorted(k)) for j, k in keys.items()}
    jobs = sorted((name[r.job_id], r.content_hash, r.status, r.first_seen_at, r.last_seen_at, r.closed_at, r.canonical_url) for r in s.jobs.collect())
    members = sorted((r.source_instance, name[r.job_id], r.missing_runs) for r in s.memberships.collect())
    return jobs, members, sorted((name[r.job_id], r.content_hash, r.first_seen_at) for r in s.snapshots.collect())


def made(rng, n_sources):
    sources = [(f"s{k}", rng.randrange(1, 9) * 10 + k, rng.random() < 0.7, rng.random() < 0.8) for k in range(n_sources)]
    batch = []
    for name, *_ in sources:
        for n in range(rng.randrange(0, 9)):
            job = rng.randrange(7)
            keys = [] if rng.random() < 0.1 else [f"j{job}", *([f"j{job}{rng.choice('ab')}"] if rng.random() < 0.5 else [])]
            batch.append((name, n, keys, f"u{n}", f"h{rng.randrange(3)}", "{}", rng.random() < 0.2))
    return sources, batch


def kept(s):
    return state.State(*[graph.stash(getattr(s, t)) for t in state.TABLES])


@pytest.mark.parametrize("seed,chunk", [(1, 4096), (2, 2)])
def test_equals_one_after_the_other(spark, seed, chunk):
    rng, plain, s = random.Random(seed), Plain(), state.State.empty(spark)
    for run in range(3):
        sources, batch = made(rng, 4)
        counts, review = plain.run(sources, batch, f"t{run}")
        s, c, changes = upsert_sources(spark.createDataFrame(batch, BATCH), spark.createDataFrame(sources, SOURCES), s, run_id=f"r{run}", now=f"t{run}", chunk=chunk)
        s = kept(s)
        assert tables(s) == plain.tables()
        assert {r.source_instance: {k: r[k] for k in ("new", "updated", "unchanged", "duplicate", "closed")} for r in c.collect()} == counts
        assert {(r.source_instance, r.ordinal): r.review for r in changes.collect()} == review


def test_equals_the_single_upsert(spark):
    rng, one, many = random.Random(5), state.State.empty(spark), state.State.empty(spark)
    for run in range(2):
        sources, batch = made(rng, 2)
        many = kept(upsert_sources(spark.createDataFrame(batch, BATCH), spark.createDataFrame(sources, SOURCES), many, run_id="r", now=f"t{run}")[0])
        for name, _, authoritative, complete in sorted(sources, key=lambda x: x[1]):
            mine = spark.createDataFrame([r[1:] for r in batch if r[0] == name], BATCH.split(", ", 1)[1])
            one = kept(state.upsert(mine, one, instance=name, run_id="r", now=f"t{run}", authoritative=authoritative, complete=complete)[0])
        assert tables(one) == tables(many)


def test_sources_that_join_jobs(spark):
    rows = [("a", 0, ["x"], "u", "1", "{}", False), ("b", 0, ["y"], "u", "2", "{}", False), ("c", 0, ["x", "y"], "u", "2", "{}", False)]
    sources = [(n, k, True, True) for k, n in enumerate("abc", 1)]
    s, c, _ = upsert_sources(spark.createDataFrame(rows, BATCH), spark.createDataFrame(sources, SOURCES), state.State.empty(spark), run_id="r", now="t")
    assert [(j[0], j[1]) for j in tables(s)[0]] == [("x,y", "2")] and {r.source_instance: r.new for r in c.collect()} == {"a": 1, "b": 0, "c": 0}


def test_no_rows_and_no_sources(spark):
    none = spark.createDataFrame([], BATCH)
    s, c, _ = upsert_sources(none, spark.createDataFrame([("a", 1, True, True)], SOURCES), state.State.empty(spark), run_id="r", now="t")
    assert s.jobs.count() == 0 and [(r.new, r.closed) for r in c.collect()] == [(0, 0)]
    s, c, _ = upsert_sources(none, spark.createDataFrame([], SOURCES), s, run_id="r", now="t")
    assert s.jobs.count() == 0 and c.count() == 0


def test_rows_are_moved_about_twice(spark):
    # two sources; a third of the rows belong to one job, which is more than a chunk
    n, job = 20_000, lambda k: 0 if k % 3 == 0 else 1 + k // 2 % 97
    rows = [(f"s{k % 2}", k, [f"j{job(k)}"], "u", f"h{k % 5}", "{}", False) for k in range(n)]
    batch = graph.stash(spark.createDataFrame(rows, BATCH))
    sources = graph.stash(spark.createDataFrame([("s0", 1, True, True), ("s1", 2, True, True)], SOURCES))
    sc = spark.sparkContext
    moved = lambda: sum(x.shuffleWriteRecords() for x in sc._gateway.jvm.scala.jdk.javaapi.CollectionConverters.asJava(sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._gateway.jvm.double, 0), sc._gateway.jvm.java.util.ArrayList())))
    before = moved()
    _, c, _ = upsert_sources(batch, sources, state.State.empty(spark), run_id="r", now="t")
    got = {r.source_instance: (r.new, r.updated, r.unchanged, r.duplicate) for r in c.collect()}
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    assert moved() - before < 3 * n

    last, want = {}, {"s0": [0] * 4, "s1": [0] * 4}
    met = set()
    for name, _, (key,), _, h, *_ in sorted(rows):
        want[name][0 if key not in last else 2 if last[key] == h else 1] += 1
        want[name][3] += (name, key) in met
        met.add((name, key))
        last[key] = h
    assert got == {k: tuple(v) for k, v in want.items()}
