import json

from gleaner import cli, runner
from gleaner.operators.state import State

RAW = cli.RAW


def jobs(*ids, title="Dev"):
    return json.dumps({"jobs": [{"id": i, "title": title, "absolute_url": f"https://x.nl/r/{i}", "content": "text"} for i in ids]})


def row(adapter, payload, account="acme", most=50):
    return (adapter, "ats", adapter, account, None, None, "en", most, 0, payload)


def test_runs_over_sources(spark):
    frame = lambda *rows: spark.createDataFrame(list(rows), RAW)
    one = runner.ingest(spark, frame(row("greenhouse", jobs(1, 2, 3)), row("ashby", "{broken")), State.empty(spark), "r1", "2026-09-01T00:00:00+00:00")
    by = {r.source_instance: r for r in one.runs.collect()}
    assert (by["greenhouse:acme"].new, by["greenhouse:acme"].success, by["ashby:acme"].success, by["ashby:acme"].failure_category) == (3, True, False, "parsing_or_adapter_failure")
    assert one.state.jobs.count() == 3 and one.review.count() == 3 and one.state.runs.count() == 2
    two = runner.ingest(spark, frame(row("greenhouse", jobs(1, 2))), one.state, "r2", "2026-09-02T00:00:00+00:00")
    three = runner.ingest(spark, frame(row("greenhouse", jobs(2, title="Lead"))), two.state, "r3", "2026-09-03T00:00:00+00:00")
    r = three.runs.first()
    assert (r.new, r.updated, r.closed) == (0, 1, 1)
    assert {x.status: x.jobs for x in runner.export(three.state)["counts"].collect()} == {"active": 2, "closed": 1}
    health = {x.source_instance: (x.consecutive_failures, x.run_count) for x in runner.export(three.state)["health"].collect()}
    assert health == {"greenhouse:acme": (0, 3), "ashby:acme": (1, 1)}
    doc = one.document().first()
    assert (doc.sources, doc.successes, doc.review_queue_count, len(doc.observations)) == (2, 1, 3, 3)


def test_command_line(spark, tmp_path, capsys):
    put = lambda name, rows: (tmp_path / name).write_text(json.dumps(rows)) and str(tmp_path / name)
    raw = put("raw.json", [{"source_id": "greenhouse", "source_type": "ats", "adapter": "greenhouse", "account": "acme", "payload": jobs(1, 2)}])
    assert cli.main(["ingest", "--payloads", raw, "--state", str(tmp_path / "state"), "--now", "2026-09-01T00:00:00+00:00", "--out", str(tmp_path / "doc")]) == 0
    assert json.loads(capsys.readouterr().out)[0]["normalized"] == 2
    assert spark.read.json(str(tmp_path / "doc")).first().sources == 1
    assert cli.main(["export", "--state", str(tmp_path / "state"), "--out", str(tmp_path / "export")]) == 0
    assert spark.read.json(str(tmp_path / "export/jobs")).count() == 2
    specs = put("specs.json", [{"source_id": "a", "adapter": "lever", "account": "x", "options": {"registry_source_id": "b"}}, {"source_id": "c", "adapter": "lever", "account": "y", "options": {"registry_source_id": ["zz"]}}])
    reg = put("register.json", [{"source_id": s, "status": "active", "source_type": "company"} for s in "abcd"])
    assert cli.main(["filter-specs", "--specs", specs, "--register", reg, "--out", str(tmp_path / "fine")]) == 0
    assert json.loads(capsys.readouterr().out) == [{"source_id": "c", "account": "y", "missing": ["zz"]}]
    assert [r.source_id for r in spark.read.json(str(tmp_path / "fine")).collect()] == ["a"]
    assert cli.main(["source-coverage", "--specs", specs, "--register", reg, "--out", str(tmp_path / "cover")]) == 2
    assert {r.source_id: r.execution_mode for r in spark.read.json(str(tmp_path / "cover")).collect()} == {"a": "public_adapter", "b": "public_adapter", "c": "blocked", "d": "live_web_queue"}
