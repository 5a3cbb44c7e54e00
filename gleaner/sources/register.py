"""The register's tables: contracts of their headers, active sources, configuration, and what may be read in public mode."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.functions.text import is_true
from gleaner.functions.urls import parts

#: Header of the log of source checks, unsafe endings of hosts, and the tables by whether they are private.
CHECK_LOG = ("source_id", "source_type", "source_url", "attempted_utc", "http_result", "remote_candidate_links", "coverage_note")
UNSAFE_HOSTS = r"\.(local|internal|localhost|test|invalid)$"
PUBLIC_TABLES = ("Bronnen", "Config", "Vacatures", "Applications", "JobSnapshots")
PRIVATE_TABLES = ("CandidateEvidence",)


def checked_table(cells: DataFrame, required: tuple[str, ...] = (), row: str = "row", column: str = "column", value: str = "value") -> DataFrame:
    """A sheet given as cells (row, column, value; row 0 is the header) as a table of text columns.

    A name that occurs twice, or a required one that is missing, is an error. Blank rows go, short rows are padded with
    empty text. Only the header comes to the driver.
    """
    head = [(r[0], (r[1] or "").strip()) for r in cells.where(F.col(row) == 0).select(column, value).orderBy(column).collect()]
    names = [n for _, n in head if n]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"duplicate column: {twice[0]}")
    if gone := [n for n in required if n not in names]:
        raise ValueError(f"missing column: {gone[0]}")
    body = cells.where(F.col(row) > 0)
    picks = [F.coalesce(F.max(F.when(F.col(column) == at, F.col(value))), F.lit("")).alias(n) for at, n in head if n]
    wide = body.groupBy(row).agg(*picks)
    blank = F.lit(True)
    for n in names:
        blank = blank & (F.trim(F.col(f"`{n}`")) == "")
    return wide.where(~blank).withColumnRenamed(row, "_row")


def readable(names: list[str], public: bool) -> list[str]:
    """The tables that a run reads: in public mode the private ones are not so much as asked for."""
    return [n for n in names if not (public and n in PRIVATE_TABLES)]


def active_sources(sources: DataFrame) -> DataFrame:
    """Active rows (source_id, status, ...); an empty or repeated id is an error of the run, found while it runs."""
    n = F.count("*").over(W.partitionBy(F.trim("source_id")))
    bad = F.coalesce(F.trim("source_id"), F.lit("")) == ""
    checked = sources.withColumn("_n", n).where(
        F.when(bad | (F.col("_n") > 1), F.raise_error(F.concat(F.lit("missing or duplicate source id: "), F.coalesce("source_id", F.lit("")))).cast("boolean")).otherwise(True)
    )
    return checked.where(F.lower(F.trim("status")) == "active").drop("_n")


def config_values(table: DataFrame, keys: tuple[str, ...] | None = None) -> dict[str, str]:
    """Keys and values of the configuration; the last row of a key counts."""
    rows = table.where("key is not null and key <> ''")
    if keys:
        rows = rows.where(F.col("key").isin(*keys))
    return {r["key"]: r["value"] or "" for r in rows.orderBy("_row").collect()}


def bounded_integer(config: dict[str, str], key: str, default: int, most: int) -> int:
    """A whole number of the configuration, capped; the default where it is missing. Anything else is an error."""
    text = str(config.get(key, "")).strip()
    if not text:
        return default
    if not re.fullmatch(r"[1-9][0-9]{0,5}", text):
        raise ValueError(f"{key} must be a positive whole number")
    return min(int(text), most)


def preflight(config: dict[str, str], expected: dict[str, str]) -> None:
    """A run may start only if these settings are as expected, such as removal of duplicates across runs being on."""
    for key, want in expected.items():
        if str(config.get(key, "")).strip().lower() != want:
            raise ValueError(f"{key} must be {want}")


def domain(x: Column, url: bool = False) -> Column:
    """Valid public host name of a text, or of an http(s) URL without credentials and odd ports; null for others."""
    p = parts(x)
    host = F.regexp_replace(p["host"] if url else F.lower(F.trim(x)), r"\.+$", "")
    label = r"[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
    fine = host.rlike(rf"^{label}(\.{label})+$") & (F.length(host) <= 253) & ~host.rlike(UNSAFE_HOSTS) & ~host.rlike(r"^\d+(\.\d+){3}$")
    if url:
        fine = fine & p["scheme"].isin("http", "https") & p["port"].isin("", "80", "443") & (F.regexp_extract(x, r"^[A-Za-z]+://([^/?#]*@)", 1) == "")
    return F.when(is_true(fine), host)


def public_role_link(x: Column) -> Column:
    """https link to show: scheme, host and path alone."""
    p = parts(x)
    return F.when(is_true((p["scheme"] == "https") & domain(x, True).isNotNull()), F.concat(F.lit("https://"), p["host"], p["path"]))


def check_log(sources: DataFrame, attempts: DataFrame) -> DataFrame:
    """One row per source under the log's fixed header."""
    newest = attempts.withColumn("_r", F.row_number().over(W.partitionBy("source_id").orderBy(F.desc("attempted_utc")))).where("_r = 1")
    x = sources.select("source_id", "source_type", F.col("base_url").alias("source_url")).join(newest.select("source_id", "attempted_utc", "http_result", "remote_candidate_links", "coverage_note"), "source_id", "left")
    return x.select("source_id", "source_type", "source_url", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in CHECK_LOG[3:]]).orderBy("source_id")


def evidence_of_history(*tables: DataFrame) -> DataFrame:
    """Rows of several history tables as one, by name; columns that one lacks are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def listing(jobs: DataFrame) -> DataFrame:
    """Stored jobs in the order they are listed: first seen, then id."""
    return jobs.orderBy("first_seen_at", "job_id")


def escape(x: str) -> str:
    import html

    return html.escape(str(x), quote=True)


def dashboard(title: str, summary: DataFrame, counts: DataFrame, most: int = 500) -> str:
    """Static page of aggregates: a one-row summary and a table of counts; every value is escaped."""
    s = summary.first().asDict()
    cards = "".join(f"<dt>{escape(k)}</dt><dd>{escape(v)}</dd>" for k, v in s.items())
    rows = "".join("<tr>" + "".join(f"<td>{escape(v)}</td>" for v in r) + "</tr>" for r in counts.limit(most).collect())
    head = "".join(f"<th>{escape(c)}</th>" for c in counts.columns)
    return f'<!doctype html><html lang="en"><meta charset="utf-8"><title>{escape(title)}</title><h1>{escape(title)}</h1><dl>{cards}</dl><table><thead><tr>{head}</tr></thead><tbody>{rows}</tbody></table></html>'
