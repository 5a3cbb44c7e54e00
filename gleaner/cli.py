"""Command line: rank a JSON document from standard input, ingest payloads, filter specs, show coverage and state, time an ingest.

Files are read and written by Spark, so any path that it knows will do; JSON files hold one object a line or one array.
"""

from __future__ import annotations

import argparse
import json
import resource
import sys
import time
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner import runner
from gleaner.operators import planning, ranking, state
from gleaner.sources import register

_FLAGS = ("fully_remote", "geography_compatible", "wordpress_related", "ai_workflow_related", "web_design_related", "central_hard_mismatch")
_TEXT = ("title", "url", "canonical_url", "posted_date", "listing_language", "application_language")
_FITS = ("core_fit", "evidence_fit", "workstyle_fit")
_PAY = ("salary_monthly_eur", "salary_min_monthly_eur", "salary_max_monthly_eur")


def vacancies(spark: SparkSession, items: list) -> DataFrame:
    """Rows of a JSON document; values of another type than their field's are as if absent, amounts keep their type."""

    def row(v: dict) -> tuple:
        text = [v.get(k) if isinstance(v.get(k), str) else None if v.get(k) is None else "?" for k in _TEXT]
        flags = [v.get(k) if isinstance(v.get(k), bool) else None for k in _FLAGS]
        fits = [float(v[k]) if isinstance(v.get(k), (int, float)) and not isinstance(v.get(k), bool) else None for k in _FITS]
        many = [x.split(",") if isinstance(x, str) and x.strip() else x if isinstance(x, list) else None for x in (v.get("required_languages"), v.get("role_families"))]
        return (*text, *flags, *fits, *[[str(i) if isinstance(i, str) else None for i in x] if x is not None else None for x in many], *[json.dumps(v[k]) if v.get(k) is not None else None for k in _PAY])

    lists = T.ArrayType(T.StringType())
    fields = [(k, T.StringType()) for k in _TEXT] + [(k, T.BooleanType()) for k in _FLAGS] + [(k, T.DoubleType()) for k in _FITS] + [("required_languages", lists), ("role_families", lists)] + [(k, T.StringType()) for k in _PAY]
    df = spark.createDataFrame([row(v) for v in items if isinstance(v, dict)], T.StructType([T.StructField(*f) for f in fields]))
    return df.withColumns({k: F.try_parse_json(k) for k in _PAY})


def rank(spark: SparkSession, document: dict) -> list[dict]:
    if not isinstance(document.get("today"), str) or not isinstance(document.get("policy"), dict) or not isinstance(document.get("vacancies"), list):
        raise ValueError("today, policy and vacancies are needed")
    policy, today = ranking.Policy.from_config(document["policy"]), date.fromisoformat(document["today"][:10])
    top = ranking.top_vacancies(vacancies(spark, document["vacancies"]), today, policy)
    return [json.loads(r[0]) for r in top.select(F.to_json(F.struct("title", "url", "posted_date", "score", "core_fit", "evidence_fit", "gate.age_days", "gate.salary_known", "gate.warnings"))).collect()]


def synthetic(spark: SparkSession, n: int) -> DataFrame:
    i = F.col("id")
    return spark.range(n).select(
        i.alias("ordinal"), F.array(F.concat(F.lit("source:bench:"), i)).alias("keys"), F.concat(F.lit("https://example.com/jobs/"), i).alias("canonical_url"), F.sha2(i.cast("string"), 256).alias("content_hash"),
        F.to_json(F.struct(F.concat(F.lit("Role "), i).alias("title"))).alias("payload"), F.lit(False).alias("snippet"),
    )


#: Commands over files and their options; a question mark ends those that can be left out.
COMMANDS = {
    "ingest": ("payloads", "state", "now", "out?"),
    "filter-specs": ("specs", "register", "out"),
    "source-coverage": ("specs", "register", "out"),
    "export": ("state", "out"),
}
RAW = "source_id string, source_type string, adapter string, account string, employer string, endpoint string, listing_language string, max_jobs int, page int, payload string"
SPECS = "source_id string, source_type string, adapter string, account string, options variant"


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def serve(spark: SparkSession, args: argparse.Namespace) -> int:
    """0 if all that was asked for could be done, 2 if a source failed or was blocked."""
    show = lambda df: print(json.dumps([json.loads(r[0]) for r in df.select(F.to_json(F.struct(*df.columns))).collect()]))
    if args.command == "export":
        for name, df in runner.export(state.State.load(spark, args.state)).items():
            df.coalesce(1).write.mode("overwrite").json(f"{args.out}/{name}")
        return 0
    if args.command == "ingest":
        old = state.State.load(spark, args.state)
        raw = read_json(spark, args.payloads, RAW).withColumn("page", F.coalesce("page", F.lit(0)))
        run = runner.ingest(spark, raw, old, f"run-{args.now}", args.now)
        run.state.save(args.state, "v" + "".join(c for c in args.now if c.isdigit()))
        if args.out:
            run.document().coalesce(1).write.mode("overwrite").json(args.out)
        show(planning.attempt_audit(run.runs))
        return 0 if run.runs.where("not success").limit(1).count() == 0 else 2
    specs = read_json(spark, args.specs, SPECS)
    active = register.active_sources(read_json(spark, args.register, "source_id string, status string, source_type string"))
    if args.command == "filter-specs":
        fine, blocked = runner.admitted(specs, active)
        fine.drop("spec_id", "required", "missing", "accepted").coalesce(1).write.mode("overwrite").json(args.out)
        show(blocked.select("source_id", "account", "missing"))
        return 0 if fine.limit(1).count() else 2
    modes = runner.source_coverage(specs, active)
    modes.coalesce(1).write.mode("overwrite").json(args.out)
    show(modes.groupBy("execution_mode").agg(F.count("*").alias("sources")))
    return 0 if modes.where("execution_mode = 'blocked'").limit(1).count() == 0 else 2


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="gleaner")
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("rank")
    sub.add_parser("benchmark").add_argument("--records", type=int, default=10_000)
    for name, options in COMMANDS.items():
        p = sub.add_parser(name)
        for o in options:
            p.add_argument(f"--{o.rstrip('?')}", required=not o.endswith("?"))
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("gleaner").getOrCreate()
    if args.command in COMMANDS:
        return serve(spark, args)
    if args.command == "rank":
        print(json.dumps(rank(spark, json.load(sys.stdin))))
        return 0
    t = time.time()
    _, counts = state.upsert(synthetic(spark, args.records), state.State.empty(spark), instance="bench", run_id="1", now="2026-01-01")
    new, s = counts.first()["new"], time.time() - t
    print(json.dumps({"records": new, "wall_seconds": round(s, 3), "records_per_second": round(new / s, 1), "max_rss_kb": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
