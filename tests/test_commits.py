"""Versions of the state: a writer that dies anywhere loses nothing, two writers don't overwrite each other."""

import os
import shutil

import pytest

from gleaner.operators import commits, state

JOBS = state.TABLES["jobs"]


def with_jobs(spark, s, n):
    from dataclasses import replace

    return replace(s, jobs=spark.createDataFrame([(f"j{i}", "u", "h", "{}", "active", "t", "t", None) for i in range(n)], JOBS))


class Died(Exception):
    pass


def test_writer_dies_at_every_step(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "state")
    with_jobs(spark, state.State.load(spark, root), 1).save(root, "one")
    write, publish = commits.write_table, commits._publish
    for step in range(len(state.TABLES) + 1):
        seen = []

        def dies(*args, call=write):
            if len(seen) == step:
                raise Died
            seen.append(1)
            return call(*args)

        with monkeypatch.context() as m:
            m.setattr(commits, "write_table", dies)
            m.setattr(commits, "_publish", lambda *a: dies(*a, call=publish))
            with pytest.raises(Died):
                with_jobs(spark, state.State.load(spark, root), 2).save(root, "two")
        now = state.State.load(spark, root)
        assert (now.version, now.label, now.jobs.count()) == (1, "one", 1)
    two = with_jobs(spark, state.State.load(spark, root), 2).save(root, "two")
    assert (two.version, two.jobs.count()) == (2, 2)
    assert len(commits.prune(spark, root, keep=1)) == len(state.TABLES) + 1 and state.State.load(spark, root).jobs.count() == 2


def test_dead_between_file_and_name(spark, tmp_path):
    root = str(tmp_path / "state")
    with_jobs(spark, state.State.load(spark, root), 1).save(root, "one")
    (tmp_path / "state/commits/.000000000002-dead").write_text("{")
    assert state.State.load(spark, root).version == 1
    assert with_jobs(spark, state.State.load(spark, root), 3).save(root, "two").jobs.count() == 3


def test_two_writers(spark, tmp_path):
    root = str(tmp_path / "state")
    base = state.State.load(spark, root)
    with_jobs(spark, base, 1).save(root, "a")
    with pytest.raises(commits.Conflict):
        with_jobs(spark, base, 2).save(root, "b")
    with pytest.raises(commits.Conflict):  # the other commit comes after the tables were written
        commits._publish(spark, root, 1, "000000000001-x", "c")
    assert state.State.load(spark, root).label == "a" and len(os.listdir(tmp_path / "state/commits")) and state.State.load(spark, root).jobs.count() == 1


def test_lost_commits_are_an_error(spark, tmp_path):
    root = str(tmp_path / "state")
    s = with_jobs(spark, state.State.load(spark, root), 1).save(root)
    with_jobs(spark, s, 2).save(root)
    shutil.rmtree(tmp_path / "state/commits")
    with pytest.raises(FileNotFoundError):
        state.State.load(spark, root)
