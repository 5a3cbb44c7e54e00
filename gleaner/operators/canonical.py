"""Observations of one run: strong identity keys, clusters, their representative and merged evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import clean, fold
from gleaner.functions.urls import canonical, role_specific
from gleaner.operators.graph import connected_components

CONTRACT = "1.2"
#: Preference among source classes.
CLASS_RANK = {"employer_direct": 0, "ats": 1, "job_board": 2, "wordpress_discovery": 2, "discovery_api": 3, "discovery": 4, "search": 5}


def link(df: DataFrame) -> Column:
    return canonical(F.coalesce(F.nullif(F.col("canonical_url"), F.lit("")), F.col("url")))


def fingerprint(employer: Column, title: Column, location: Column) -> Column:
    """Weak sign of a duplicate; it never merges anything."""
    e, t = fold(employer), fold(title)
    digest = F.sha2(F.concat_ws("\x1f", e, t, F.coalesce(fold(location), F.lit(""))), 256)
    return F.when(e.isNotNull() & t.isNotNull(), F.concat(F.lit("fingerprint:"), digest))


def identity_keys(df: DataFrame, role_urls_only: bool = True) -> Column:
    """Strong keys of a row: its URL if it names one posting (state keeps any valid URL), and its source's job id."""
    url = link(df)
    strong = role_specific(url) if role_urls_only else url.isNotNull()
    source, job = fold(F.col("source_id")), fold(F.col("source_job_id"))
    return F.array_compact(
        F.array(
            F.when(strong, F.concat(F.lit("url:"), url)),
            F.when(source.isNotNull() & job.isNotNull(), F.concat_ws(":", F.lit("source"), source, job)),
        )
    )


def clusters(df: DataFrame, keys: Column, ordinal: str = "ordinal") -> DataFrame:
    """df with cluster: the least ordinal that shared keys reach. A row links only to its key's least row."""
    owned = df.select(F.col(ordinal).alias("node"), F.explode(keys).alias("key"))
    least = owned.groupBy("key").agg(F.min("node").alias("dst"), F.count("*").alias("n")).where("n > 1").drop("n")
    edges = owned.join(least, "key").where("node <> dst").select(F.col("node").alias("src"), "dst")
    parts = connected_components(edges).withColumnRenamed("node", ordinal)
    return df.join(parts, ordinal, "left").withColumn("cluster", F.coalesce("component", ordinal)).drop("component")


def authority(df: DataFrame) -> Column:
    """Sort key of a row inside its cluster, the best first; ties go to the earlier row."""
    url = link(df)
    strong = role_specific(url)
    ranks = F.create_map(*[F.lit(x) for kv in CLASS_RANK.items() for x in kv])
    return F.struct(
        F.when(strong, 0).otherwise(1).alias("weak"),
        F.coalesce(ranks[F.coalesce(fold(F.col("source_type")), F.lit(""))], F.lit(99)).alias("rank"),
        F.when(clean(F.col("source_job_id")).isNotNull(), 0).otherwise(1).alias("no_job"),
        F.when(clean(F.col("published_at")).isNotNull(), 0).otherwise(1).alias("no_date"),
        F.coalesce(fold(F.col("source_id")), F.lit("")).alias("source"),
        F.coalesce(url, F.lit("")).alias("url"),
        F.col("ordinal"),
    )


def canonicalize(df: DataFrame) -> DataFrame:
    """One row per cluster: the representative's columns, and the cluster's merged evidence.

    One aggregation per cluster with map-side combine; nested columns ride along inside min_by.
    """
    rows = clusters(df, identity_keys(df)).withColumn("_auth", authority(df)).withColumn("_link", link(df))
    published = clean(F.col("published_at"))
    distinct = lambda c: F.array_sort(F.collect_set(c))
    merged = rows.groupBy("cluster").agg(
        F.min_by(F.struct(*df.columns), "_auth").alias("best"),
        F.min_by(published, F.when(published.isNotNull(), F.col("_auth"))).alias("published"),
        distinct(published).alias("published_at_candidates"),
        F.min(clean(F.col("first_seen_at"))).alias("first_seen"),
        F.max(clean(F.col("last_seen_at"))).alias("last_seen"),
        distinct(clean(F.col("source_id"))).alias("source_ids"),
        distinct(clean(F.col("source_type"))).alias("source_types"),
        distinct(F.col("_link")).alias("source_urls"),
        F.count("*").cast("int").alias("observation_count"),
    )
    own = {"published_at", "first_seen_at", "last_seen_at", "canonical_url"}
    out = merged.select(
        *[F.col(f"best.{c}") for c in df.columns if c not in own],
        F.coalesce(canonical(F.coalesce(F.nullif(F.col("best.canonical_url"), F.lit("")), F.col("best.url"))), F.col("best.canonical_url")).alias("canonical_url"),
        F.col("published").alias("published_at"),
        F.col("first_seen").alias("first_seen_at"),
        F.col("last_seen").alias("last_seen_at"),
        "published_at_candidates",
        (F.size("published_at_candidates") > 1).alias("published_at_conflict"),
        "source_ids",
        "source_types",
        "source_urls",
        "observation_count",
        fingerprint(F.col("best.employer"), F.col("best.title"), F.col("best.location")).alias("duplicate_candidate_fingerprint"),
        F.lit(CONTRACT).alias("observation_contract_version"),
    )
    return mark_duplicates(out)


def mark_duplicates(df: DataFrame, key: str = "duplicate_candidate_fingerprint") -> DataFrame:
    """df with how many rows share the key (0 for null); rows without one are spread, and a frequent key is counted before it moves."""
    counts = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_shared")).agg(F.count("*").cast("int").alias("duplicate_candidate_count"))
    shared = F.coalesce(F.col(key), F.concat(F.lit("\x00"), F.pmod(F.xxhash64(*df.columns), F.lit(4096)).cast("string")))
    out = df.withColumn("_key", shared).join(counts, F.col("_key") == F.col("_shared"), "left").drop("_key", "_shared")
    return out.withColumn("duplicate_candidate_count", F.coalesce("duplicate_candidate_count", F.lit(0))).withColumn("duplicate_candidate", F.col("duplicate_candidate_count") > 1)


def output_order(df: DataFrame) -> DataFrame:
    blank = F.lit("")
    return df.orderBy(F.coalesce(fold(F.col("employer")), blank), F.coalesce(fold(F.col("title")), blank), F.coalesce(link(df), blank))
