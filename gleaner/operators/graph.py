"""Connected components over an edge table."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_private: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir; unset, a private one, which only a local master can use."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _private:
            _private.append(tempfile.mkdtemp(prefix="gleaner-"))
        root = _private[0]
    return root.rstrip("/")


def stash(df: DataFrame, label: str = "t", files: int | None = None) -> DataFrame:
    """Write a table into the shared folder and read it again: lineage is cut, and lost executors cost no recompute."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")  # the shuffles of this write are not needed after it
    try:
        (df.coalesce(files) if files else df).write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def tasks_for(table: DataFrame, rows: int = 4000) -> int:
    """Number of tasks of about `rows` rows each."""
    return max(1, -(-table.count() // rows))


def spread(table: DataFrame, key: str, rows: int = 4000) -> DataFrame:
    """A stored table dealt over tasks of about `rows` rows: where rows are short and costly, one split of a file holds all of them."""
    return table.repartition(tasks_for(table, rows), key)


def discard(*tables: DataFrame) -> None:
    """Empty tables that stash() wrote, once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            spark.createDataFrame([], df.schema).write.mode("overwrite").parquet(folder)


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges -> every node that is not the least of its part, and that least node."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[a], root[b])
        if (low == root[a]).all() and (low == root[b]).all():
            far = root != np.arange(len(ids))
            return ids[far], ids[root[far]]
        for end in (root[a], root[b]):
            np.minimum.at(root, end, low)
        while (root != root[root]).any():
            root = root[root]


def _contracted(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def out():
        u, v = (np.concatenate([b.column(n).to_numpy() for b in held]) for n in ("u", "v"))
        u, v = _roots(u, v)
        return pa.record_batch([pa.array(u), pa.array(v)], names=["u", "v"])

    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= most:
            yield out()
            held = []
    if held:
        yield out()


def _with_least(rows: DataFrame, limit: int) -> DataFrame:
    """(u, v) -> (u, v, m), m being the least of u and its neighbours v.

    The minimum is taken on the map side first. Nodes of more than `limit` rows (at most rows / limit of them) are
    joined by broadcast, so that no task gets a hub's rows; all others have at most `limit`.
    """
    least = rows.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    hubs = F.broadcast(least.where(F.col("n") > limit).select("u", "m"))
    rest = rows.join(hubs.select("u"), "u", "left_anti").join(least.where(F.col("n") <= limit).select("u", "m"), "u")
    return rows.join(hubs, "u").select("u", "v", "m").union(rest.select("u", "v", "m"))


def _unfinished(pair: DataFrame) -> bool:
    """Whether some node has two links, or a link to a node that has one itself."""
    ends = pair.select(F.col("u").alias("x"), "v").union(pair.select(F.col("v"), F.lit(None)))
    seen = ends.groupBy("x").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.max(F.col("v").isNull()).alias("up"))
    return bool(seen.where("low <> high or (low is not null and up)").limit(1).count())


def connected_components(edges: DataFrame, max_rounds: int = 200, chunk: int = 500_000) -> DataFrame:
    """(src, dst) edges of any direction -> (node, component), the component being its smallest node.

    Edges are dealt evenly, and every partition contracts its own, `chunk` at a time, to a star per part (behind an
    exchange, so that no task has two Python workers); what is left goes through
    alternating large-star and small-star rounds, each contracted in the same way and written to the shared folder. Few
    edges lie in one partition and are done at once. Rounds map edges to edges (never pairs of a group) and end when
    what is left are stars; ValueError if they are not after `max_rounds`. Nodes with no edge do not appear. Nulls and
    self-loops are ignored.
    """
    pair = (
        edges.where("src is not null and dst is not null and src <> dst")
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .select(F.col("u").cast("long"), F.col("v").cast("long"))
    )
    shrink = lambda df: df.mapInArrow(lambda it: _contracted(it, chunk), "u long, v long")
    files = max(1, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)  # contracted edges are few and short
    pair = stash(shrink(pair.hint("rebalance")), "cc", files)
    rounds = 0
    while _unfinished(pair):
        if (rounds := rounds + 1) > max_rounds:
            raise ValueError(f"components are not complete after {max_rounds} rounds")
        limit = max(64, pair.count() // 1000)  # so there are about 2,000 hubs at most
        # large-star: each larger neighbour of a node is linked to the least node around it
        both = pair.union(pair.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, limit).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small-star: each smaller neighbour and the node itself are linked to the least one
        small = _with_least(large, limit).select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        )
        pair = stash(shrink(small.select("e.*").where("u <> v").distinct()), "cc", files)
    stars = pair.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select(F.col("component"), F.col("component"))).distinct()


def merge_components(components: DataFrame, edges: DataFrame, **options: int) -> DataFrame:
    """Components so far (node, component) and a batch's edges (src, dst) -> components of both.

    Ends are replaced by the components that they are in, so the rounds run over the batch's edges alone; of the earlier
    rows only those of joined components change. Equal to all edges at once, batch for batch. As there, nulls and
    self-loops are ignored, and a component is named by its smallest node.
    """
    ends = edges.where("src is not null and dst is not null and src <> dst").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    known = components.select("node", "component")
    named = ends.join(known.toDF("src", "a"), "src", "left").join(known.toDF("dst", "b"), "dst", "left")
    named = stash(named.select("src", "dst", F.coalesce("a", "src").alias("a"), F.coalesce("b", "dst").alias("b")), "ends")
    joined = stash(connected_components(named.select(F.col("a").alias("src"), F.col("b").alias("dst")), **options).toDF("was", "now"), "joined")
    seen = named.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("a").alias("component")), F.struct(F.col("dst").alias("node"), F.col("b").alias("component")))).alias("e")).select("e.*").distinct()
    both = known.union(seen.join(known.select("node"), "node", "left_anti"))
    return both.join(joined, both["component"] == joined["was"], "left").select("node", F.coalesce("now", "component").alias("component"))
