"""Screening: history of earlier applications, key propagation, first-failing-rule cascade, limits and caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.functions.text import fold
from gleaner.operators.canonical import clusters


def first_wins(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def cap_per_group(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def prefer_last_match(df: DataFrame, key: str, match: Column, ordinal: str) -> DataFrame:
    """Per key the last row that matches, else the first; `position` is where the key came first."""
    picked = df.groupBy(key).agg(
        F.coalesce(F.max_by(F.struct(*df.columns), F.when(match, F.col(ordinal))), F.min_by(F.struct(*df.columns), F.col(ordinal))).alias("row"), F.min(ordinal).alias("position")
    )
    return picked.select("row.*", "position")


def reject_unless_new(rows: DataFrame, history_keys: DataFrame, keys: str = "keys") -> DataFrame:
    """rows with seen_before: whether any key is in the history (one row per key)."""
    hits = rows.select("ordinal", F.explode(keys).alias("key")).join(history_keys.select("key").distinct(), "key", "left_semi").select("ordinal").distinct()
    return rows.join(hits.withColumn("seen_before", F.lit(True)), "ordinal", "left").withColumn("seen_before", F.coalesce("seen_before", F.lit(False)))


def weak_prior(rows: DataFrame, history: DataFrame) -> DataFrame:
    """rows with weak_prior: whether employer and title, folded, occur in the history."""
    pair = [fold(F.col("employer")).alias("_e"), fold(F.col("title")).alias("_t")]
    old = history.select(*pair).where("_e is not null and _t is not null").distinct().withColumn("weak_prior", F.lit(True))
    return rows.withColumns({"_e": pair[0], "_t": pair[1]}).join(old, ["_e", "_t"], "left").withColumn("weak_prior", F.coalesce("weak_prior", F.lit(False))).drop("_e", "_t")


def history_ids(vacancies: DataFrame, applications: DataFrame, feedback: DataFrame, events: DataFrame, statuses: list[str], event_types: list[str], aliases: dict[str, str]) -> DataFrame:
    """vacancy_id of all that was dealt with before: any application, and statuses or events that the policy names."""
    if not statuses:
        raise ValueError("no history statuses are configured")

    def named(c: Column) -> Column:
        v = F.lower(F.trim(c))
        hop = F.coalesce(F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])[v], v) if aliases else v
        return F.coalesce(v.isin(*statuses) | hop.isin(*statuses), F.lit(False))

    flags = [F.upper(F.trim(F.col(c))) == "TRUE" for c in ("applied", "interview", "offer") if c in feedback.columns and c in statuses]
    liked = named(F.col("state"))
    for f in flags:
        liked = liked | F.coalesce(f, F.lit(False))
    happened = named(F.col("status_after")) | named(F.col("event_type")) | F.coalesce(F.lower("event_type").isin(*event_types), F.lit(False))
    sets = [vacancies.where(named(F.col("status"))), applications, feedback.where(liked), events.where(happened)]
    out = sets[0].select("vacancy_id")
    for s in sets[1:]:
        out = out.unionByName(s.select("vacancy_id"))
    return out.where("vacancy_id is not null and trim(vacancy_id) <> ''").distinct()


def propagate_keys(rows: DataFrame, link: str, keys: str) -> DataFrame:
    """rows with all keys of the rows that share their link."""
    shared = rows.where(F.col(link).isNotNull()).select(link, F.explode(keys).alias("k")).groupBy(link).agg(F.array_sort(F.collect_set("k")).alias("_more"))
    return rows.join(shared, link, "left").withColumn(keys, F.array_union(F.col(keys), F.coalesce("_more", F.array().cast("array<string>")))).drop("_more")


def drop_seen(rows: DataFrame, keys: str = "keys") -> DataFrame:
    """Of rows whose keys connect, the first; a suppressed row also suppresses those after it."""
    return clusters(rows, F.col(keys)).where(F.col("cluster") == F.col("ordinal")).drop("cluster")


def cascade(rows: DataFrame, rules: list[tuple[str, Column]], order: list[Column], limit: int) -> DataFrame:
    """rows with reject_reason: the first rule that fails; survivors beyond the limit, in order, get `limit`."""
    reason = F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules])
    judged = rows.withColumn("reject_reason", reason)
    kept = judged.where("reject_reason is null").orderBy(*order).limit(limit).select("ordinal", F.lit(True).alias("_in"))
    return judged.join(kept, "ordinal", "left").withColumn("reject_reason", F.when(F.col("reject_reason").isNull() & F.col("_in").isNull(), "limit").otherwise(F.col("reject_reason"))).drop("_in")


def reason_counts(judged: DataFrame) -> DataFrame:
    return judged.groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))
