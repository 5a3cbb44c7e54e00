"""Mixing sources to target weights, in DataFrame operations only.

Every row gets a hash-random key (MD5 of its id, seed and source). Rows are range-sorted by that key inside their
source: the key's leading digits deal a source over `ranges` ranges, so a source with a third of all rows is spread
over many tasks; word counts are summed along each range, and the ranges' totals are summed along each source. A source
takes every row floor(target / size) times and, in the last epoch, the rows in key order up to its exact budget; the
row at the cut is taken in part.

Targets share the mix in proportion to the weights 1, 2, 3, 1, ... (sources by code point, null last), up to
`max_epochs` times a source's own size; what is over goes to the others by weight until none is above.

The windows over all sources hold one row per source. Null and empty texts have size 0 and are taken 0 times; a source without words has target 0. Rows with equal id and
source tie by size and then stand in any order, which gives the same set of rows. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.llm.common import WORD, table

_SRC = ["no_source", "src"]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float = 1.0, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """(no_source, src, source_size) -> the same with target; one row per source, so the windows over all are small.

    A source is at its cap when an even rate over it and all sources with a higher cap per weight would exceed it, so
    sorting by cap per weight finds the resharing's fixed point in one pass.
    """
    by_name = W.orderBy("no_source", "src")
    ring = F.array(*[F.lit(w) for w in weights])
    ranked = sizes.withColumn("w", F.element_at(ring, (F.row_number().over(by_name) - 1) % len(weights) + 1).cast("long"))
    ranked = ranked.withColumn("cap", F.col("source_size") * max_epochs)
    everything = W.partitionBy()
    order = W.orderBy((F.col("cap") / F.col("w")), "no_source", "src")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    ranked = (
        ranked.withColumn("want", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("w_left", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    )
    ranked = ranked.withColumn("full", (F.col("want") - F.col("capped")) * F.col("w") >= F.col("cap") * F.col("w_left"))
    ranked = ranked.withColumn("full", F.min("full").over(order))  # once one is below its cap, so are all after it
    rest = ranked.withColumn("sum_full", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(everything)).withColumn(
        "w_open", F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(everything)
    )
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise((F.col("want") - F.col("sum_full")) * F.col("w") / F.col("w_open"))
    return rest.select(*_SRC, "source_size", target.alias("target"))


def mix(docs: DataFrame, share: float = 1.0, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: str = "mix", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every row, and the columns `keep`."""
    digits = 3  # 4096 ranges of the key
    rows = docs.select(
        "doc_id",
        F.col("source").isNull().alias("no_source"),
        F.coalesce("source", F.lit("")).alias("src"),
        word_count(F.col("text")).alias("size"),
        *[F.col(c).alias(f"keep_{c}") for c in keep],
    ).withColumn("key", F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "src").cast("binary")))
    rows = rows.withColumn("range", F.substring("key", 1, digits))
    per_range = rows.groupBy(*_SRC, "range").agg(F.sum("size").alias("range_size"))
    goal = targets(per_range.groupBy(*_SRC).agg(F.sum("range_size").alias("source_size")), share, weights, max_epochs)
    along = W.partitionBy(*_SRC).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_range.select(*_SRC, "range", F.coalesce(F.sum("range_size").over(along), F.lit(0)).alias("offset")).join(goal, _SRC)
    inside = W.partitionBy(*_SRC, "range").orderBy("key", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    budget = F.round(F.col("target")).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    left = budget - epochs * F.col("source_size") - (F.col("offset") + F.col("upto") - F.col("size"))
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))
    return (
        rows.withColumn("upto", F.sum("size").over(inside))
        .join(offsets, [*_SRC, "range"])
        .select(
            "doc_id",
            F.when(~F.col("no_source"), F.col("src")).alias("source"),
            "size",
            "source_size",
            "target",
            taken.cast("long").alias("taken"),
            *[F.col(f"keep_{c}").alias(c) for c in keep],
        )
    )


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source")


ORACLE_MIX = """
d AS (SELECT *, source IS NULL AS no_source, coalesce(source, '') AS src,
        coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM {docs}),
k AS (SELECT *, md5(concat('mix:', coalesce(doc_id::VARCHAR, ''), ':', src)) AS key FROM d),
s AS (SELECT no_source, src, sum(size)::BIGINT AS source_size FROM k GROUP BY ALL),
r AS (SELECT *, ((row_number() OVER (ORDER BY no_source, src) - 1) % 3 + 1)::BIGINT AS w, source_size * 3 AS cap FROM s),
o AS (SELECT *, (sum(source_size) OVER ())::BIGINT * 1.0::DOUBLE AS want,
        coalesce(sum(cap) OVER b, 0)::BIGINT AS capped, (sum(w) OVER () - coalesce(sum(w) OVER b, 0))::BIGINT AS w_left
      FROM r WINDOW b AS (ORDER BY cap::DOUBLE / w, no_source, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, bool_and((want - capped) * w >= cap * w_left) OVER (ORDER BY cap::DOUBLE / w, no_source, src) AS at_cap FROM o),
t AS (SELECT no_source, src, source_size,
        CASE WHEN at_cap THEN cap::DOUBLE
             ELSE (want - (sum(CASE WHEN at_cap THEN cap ELSE 0 END) OVER ())::BIGINT) * w
                  / (sum(CASE WHEN at_cap THEN 0 ELSE w END) OVER ())::BIGINT END AS target FROM f),
u AS (SELECT k.*, source_size, target, round(target)::BIGINT AS budget,
        (sum(size) OVER (PARTITION BY k.no_source, k.src ORDER BY key, size ROWS UNBOUNDED PRECEDING))::BIGINT AS upto
      FROM k JOIN t ON k.no_source = t.no_source AND k.src = t.src),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM u),
mixed AS (SELECT *, (epochs * size
        + greatest(0, least(size, budget - epochs * source_size - (upto - size))))::BIGINT AS taken FROM e)
"""

ORACLE_OP7 = "WITH " + ORACLE_MIX.format(docs="documents") + "SELECT doc_id, size, source_size, target, taken FROM mixed"


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its taken words hold it whole, half a document or more counting as one.

    A source that has too few words repeats its documents, so ids can repeat after this stage. Rows are told apart by id,
    source and text; of rows equal in all three every one is taken alike. Null and empty texts, of size 0, go. Columns are
    carried as they are, whatever their names.
    """
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.struct(F.col("doc_id").alias("a"), F.col("source").alias("b"), text.alias("c")).alias("_key"))
    plan = mix(docs.select("doc_id", "source", "text", text.alias("h")), keep=("h",))
    copies = plan.where("size > 0").select(F.struct(F.col("doc_id").alias("a"), F.col("source").alias("b"), F.col("h").alias("c")).alias("_of"), F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias("_n"))
    copies = copies.groupBy("_of").agg(F.max("_n").alias("_n")).where("_n > 0")
    taken = rows.join(copies, F.col("_key").eqNullSafe(F.col("_of")))
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("_n")))).select("_row.*")
