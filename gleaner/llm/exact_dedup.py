"""Exact deduplication by content sort.

Sampled splitters range-partition the rows, Spark's external sort places equal texts next to each other, and each text
is compared in full with its neighbour. The sort key is (leading `prefix` characters, 64-bit hash of the whole text,
text, doc_id descending): the leading two only keep the driver's splitter sample small, order and equality are those of
the whole text. As doc_id is part of the key, a group of copies of any size is dealt over many partitions; its runs are
stitched at the partition borders, where at most two runs per partition are matched by the SHA-256 of the whole text.

Null text counts as the empty text. Of equal texts the row with the largest doc_id stays (a null doc_id only when the
group has no other); of repeated rows exactly one is marked kept. Any further columns are ignored, or carried along by
`first_rows`. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import bounded_batches, shuffles, stash, table


def _runs(batches: Iterator[pa.RecordBatch], text: str, heads_only: bool) -> Iterator[pa.RecordBatch]:
    """Neighbouring full comparisons in a sorted partition; a row (tail) without text tells the last run's number."""
    pid = TaskContext.get().partitionId()
    last, run, sha, schema = None, -1, "", None
    for b in batches:
        schema = b.schema
        rows, keep = [], []
        for i, t in enumerate(b.column(text).to_pylist()):
            head = run < 0 or t != last
            if head:
                run, last, sha = run + 1, t, hashlib.sha256(t).hexdigest()
            if head or not heads_only:
                rows.append((sha, run, head))
                keep.append(i)
        if rows:
            s, r, h = map(list, zip(*rows))
            yield _out(b.take(pa.array(keep)), text, heads_only, s, r, h, pid, False)
    if run >= 0:
        none = pa.RecordBatch.from_arrays([pa.nulls(1, f.type) for f in schema], schema=schema)
        yield _out(none, text, heads_only, [sha], [run], [False], pid, True)


def _out(b, text, heads_only, sha, run, head, pid, tail):
    cols = [b.column(i) for i, n in enumerate(b.schema.names) if heads_only or n != text]
    names = [n for n in b.schema.names if heads_only or n != text]
    n = len(run)
    new = [pa.array(sha, pa.string()), pa.array(run, pa.int64()), pa.array(head), pa.array([pid] * n, pa.int32()), pa.array([tail] * n)]
    return pa.RecordBatch.from_arrays([*cols, *new], names=[*names, "_sha", "_run", "_head", "_pid", "_tail"])


def _marked(rows: DataFrame, text: str, heads_only: bool, prefix: int = 64) -> DataFrame:
    """rows: (doc_id, text as binary, ...) sorted by content -> what _runs gives."""
    bounded_batches(rows.sparkSession)
    n = max(2, shuffles(rows.sparkSession))
    keys = [F.substring(text, 1, prefix).alias("_k1"), F.xxhash64(text).alias("_k2")]
    keyed = rows.select("*", *keys)
    order = [F.col("_k1"), F.col("_k2"), F.desc_nulls_last("doc_id")]
    inside = [F.col("_k1"), F.col("_k2"), F.col(text), F.desc_nulls_last("doc_id")]
    dealt = keyed.repartitionByRange(n, *order).sortWithinPartitions(*inside).drop("_k1", "_k2")
    fields = [f for f in dealt.schema.fields if heads_only or f.name != text]
    extra = "_sha string, _run long, _head boolean, _pid int, _tail boolean"
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields] + T._parse_datatype_string(extra).fields)
    return dealt.mapInArrow(lambda it: _runs(it, text, heads_only), schema)


def content_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("_text"))
    marks = stash(_marked(rows, "_text", False), "runs")
    runs = marks.groupBy("_pid", "_run").agg(
        F.max("_sha").alias("sha"),
        F.count(F.when(~F.col("_tail"), 1)).alias("n"),
        F.max("doc_id").alias("top"),
        (F.max("_tail") | (F.col("_run") == 0)).alias("border"),
    )
    # runs inside a partition are complete; those at its borders are joined by the digest of the whole text
    group = W.partitionBy(F.when(F.col("border"), F.col("sha")).otherwise(F.concat_ws(":", "_pid", "_run")))
    whole = runs.select(
        "_pid",
        "_run",
        F.sum("n").over(group).alias("group_size"),
        F.max("top").over(group).alias("keep_id"),
        (F.min("_pid").over(group) == F.col("_pid")).alias("first"),
    )
    return (
        marks.where("not _tail")
        .join(whole, ["_pid", "_run"])
        .select("doc_id", "keep_id", "group_size", (F.col("_head") & F.col("first")).alias("kept"), F.col("_sha").alias("text_sha256"))
    )


def first_rows(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns; each text moves through one range exchange only."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("_text"), F.struct(*docs.columns).alias("_row"))
    marks = stash(_marked(rows, "_text", True), "heads")
    heads = marks.where("not _tail")
    # a run that opens a partition may go on from an earlier one: two rows a partition at most
    border = heads.where("_run = 0").select("_sha", F.col("_pid").alias("p"))
    again = border.join(heads.select("_sha", F.col("_pid").alias("q")), "_sha").where("q < p").select(F.col("p").alias("_pid"), F.lit(0).cast("long").alias("_run")).distinct()
    return heads.join(again, ["_pid", "_run"], "left_anti").select("_row.*")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_groups(table(spark, sf_dir, "documents"))


ORACLE_OP6 = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def stage_exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return first_rows(docs)
