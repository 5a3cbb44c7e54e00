"""Prefix trie of conversations by heavy-path decomposition.

Turns are reduced to 128 bits of the SHA-256 of (role, text) and a length before anything moves. Rows are range-sorted by
(conv_id, turn), so that one conversation may lie over many tasks; each task runs the polynomial hash of the turns so far
modulo 2**127 - 1 over its rows, and what a conversation has before a task's first row is put in front afterwards (at
most one conversation goes on at each border, so that table is broadcast). Prefix hashes of a rebuilt conversation follow
from those of its parts by arithmetic, and so does a node's parent from its hash and last turn. Nodes are the groups by
(depth, hash); by induction over depth they are distinct sequences if all members have one last turn, which is checked.

Every node's largest child (most members; then the smallest conv_id) continues its path; every path ends in a leaf and is
named by the leaf's conv_id. A light child has at most half of its parent's members, so a way to the root crosses at most
log2(conversations) paths: totals of paths are attached to their parents' paths in so many rounds, on a table of one row
per path, and one suffix sum along each path then gives all subtree sums. It is taken by chunks of depth first, then
inside them. Nodes that many rows meet (the root, common openings) are joined by broadcast, at most `HUBS` of them.

The first h turns of a rebuilt conversation c are those of c - c % 100 (the remainder takes c's sign), h being
crc32(decimal c) % 6. Ids of conversations that end at a node are hashed in order: range-sorted, joined to pieces of up
to `piece` ids in many tasks, and the pieces of one node streamed through SHA-256 in one, as that hash allows no other way.

Null roles and texts are empty; turns with equal numbers stand by the digest of (role, text), so repeated rows are turns of
their own. Rows without conv_id belong to no conversation. Empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.llm.common import shuffles, stash, table

P = 2**127 - 1
BASE = int.from_bytes(hashlib.sha256(b"prefix of turns").digest()[:15], "big")
BACK = pow(BASE, -1, P)
HUBS = 1000
NODE = ["depth", "hash"]
ZERO = bytes(16)


def _num(x: bytes) -> int:
    return int.from_bytes(x, "big") % P


def _raw(x: int) -> bytes:
    return x.to_bytes(16, "big")


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conv_id, value, chars) of a task -> place and prefix hash among the task's rows of the conversation."""
    pid, last, pos, h = TaskContext.get().partitionId(), None, 0, 0
    for b in batches:
        places, hashes = [], []
        for conv, value in zip(b.column("conv_id").to_pylist(), b.column("value").to_pylist()):
            if conv != last:
                last, pos, h = conv, 0, 0
            h = (h * BASE + _num(value)) % P
            places.append(pos)
            hashes.append(_raw(h))
            pos += 1
        new = [pa.array([pid] * len(places), pa.int32()), pa.array(places, pa.int64()), pa.array(hashes, pa.binary())]
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("value"), b.column("chars"), *new], names=["conv_id", "value", "chars", "pid", "pos", "hash"])


def _before(runs: pd.DataFrame) -> pd.DataFrame:
    """The parts of one conversation over several tasks (as many rows as tasks) -> what lies before each of them."""
    out, n, h = [], 0, 0
    for r in runs.sort_values("pid").itertuples():
        out.append((r.conv_id, r.pid, n, _raw(h)))
        n, h = n + r.n, (h * pow(BASE, r.n, P) + _num(r.hash)) % P
    return pd.DataFrame(out, columns=["conv_id", "pid", "n_before", "h_before"])


def _continued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        pos, hashes = b.column("pos").to_pylist(), b.column("hash").to_pylist()
        for i, (n, h) in enumerate(zip(b.column("n_before").to_pylist(), b.column("h_before").to_pylist())):
            if n:
                hashes[i] = _raw((_num(h) * pow(BASE, pos[i] + 1, P) + _num(hashes[i])) % P)
                pos[i] += n
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("value"), b.column("chars"), pa.array(pos, pa.int64()), pa.array(hashes, pa.binary())], names=["conv_id", "value", "chars", "pos", "hash"])


def ordered_turns(rows: DataFrame) -> DataFrame:
    """conv_id, value, chars, pos, hash: place of every turn in its conversation, and the hash of the turns up to it."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    turns = rows.where("conv_id is not null").select(F.col("conv_id").cast("long"), "turn", F.unhex(F.substring(digest, 1, 32)).alias("value"), F.length(text).cast("long").alias("chars"))
    key = ["conv_id", F.col("turn").asc_nulls_first(), "value"]
    dealt = turns.repartitionByRange(max(2, shuffles(rows.sparkSession)), *key).sortWithinPartitions(*key).select("conv_id", "value", "chars")
    run = stash(dealt.mapInArrow(_running, "conv_id long, value binary, chars long, pid int, pos long, hash binary"), "turns")
    parts = run.groupBy("conv_id", "pid").agg(F.count("*").alias("n"), F.max_by("hash", "pos").alias("hash"))
    over = parts.groupBy("conv_id").agg(F.count("*").alias("k")).where("k > 1").select("conv_id")  # at most one per border
    before = parts.join(F.broadcast(over), "conv_id").groupBy("conv_id").applyInPandas(_before, "conv_id long, pid int, n_before long, h_before binary")
    whole = run.join(F.broadcast(before), ["conv_id", "pid"], "left").select("conv_id", "value", "chars", "pos", "hash", "n_before", "h_before")
    return stash(whole.mapInArrow(_continued, "conv_id long, value binary, chars long, pos long, hash binary"), "turns")


def _moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefix hash in the rebuilt conversation, and the parent's. Head turns keep theirs (skipped = base = zero)."""
    for b in batches:
        hashes, parents = [], []
        for h, v, base, skipped, k in zip(*(b.column(c).to_pylist() for c in ("hash", "value", "base", "skipped", "k"))):
            h = (_num(h) + (_num(base) - _num(skipped)) * pow(BASE, k, P)) % P if base != skipped else _num(h)
            hashes.append(_raw(h))
            parents.append(_raw((h - _num(v)) * BACK % P))
        keep = ("conv_id", "depth", "value", "chars", "last")
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(hashes, pa.binary()), pa.array(parents, pa.binary())], names=[*keep, "hash", "parent"])


def rebuilt(turns: DataFrame, share: int = 100, most: int = 6) -> DataFrame:
    """conv_id, depth, value, chars, hash, parent, last of every turn of the rebuilt conversations, the root included."""
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % most)
    head = F.struct("pos", "hash", "value", "chars")
    heads = turns.where((F.col("conv_id") % share == 0) & (F.col("pos") < most - 1)).groupBy(F.col("conv_id").alias("from")).agg(F.sort_array(F.collect_list(head)).alias("opening"))
    early = turns.where(F.col("pos") < most - 1).select("conv_id", F.col("pos") + 1, F.col("hash")).toDF("conv_id", "h", "skipped")
    zero = F.lit(bytearray(ZERO))
    info = (
        convs.withColumn("from", F.col("conv_id") - F.col("conv_id") % share)
        .join(heads, "from", "left")
        .withColumn("opening", F.when(F.col("h") > 0, F.slice(F.coalesce("opening", F.array()), F.lit(1), F.greatest("h", F.lit(1)).cast("int"))).otherwise(F.expr("slice(opening, 1, 0)")))
        .withColumn("opening", F.coalesce("opening", F.expr("slice(opening, 1, 0)")))
        .join(early, ["conv_id", "h"], "left")
        .withColumn("a", F.when(F.col("opening").isNull(), 0).otherwise(F.size("opening")))
        .withColumn("base", F.when(F.col("a") > 0, F.element_at("opening", -1)["hash"]).otherwise(zero))
        .withColumn("skipped", F.coalesce("skipped", zero))
        .withColumn("length", F.col("a") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    )
    info = stash(info.select("conv_id", "h", "a", "base", "skipped", "length", "opening"), "info")
    own = turns.join(info.drop("opening"), "conv_id").where("pos >= h").withColumn("depth", F.col("pos") - F.col("h") + F.col("a") + 1).withColumn("k", F.col("pos") - F.col("h") + 1)
    first = info.where("a > 0").select("conv_id", "length", F.explode("opening").alias("o")).select("conv_id", "length", "o.*").withColumn("depth", F.col("pos") + 1)
    first = first.withColumn("base", zero).withColumn("skipped", zero).withColumn("k", F.lit(0).cast("long"))
    columns = ["conv_id", "depth", "value", "chars", (F.col("depth") == F.col("length")).alias("last"), "hash", "base", "skipped", "k"]
    below = own.select(*columns).union(first.select(*columns)).mapInArrow(_moved, "conv_id long, depth long, value binary, chars long, last boolean, hash binary, parent binary")
    root = info.select("conv_id", F.lit(0).cast("long").alias("depth"), zero.alias("value"), F.lit(0).cast("long").alias("chars"), (F.col("length") == 0).alias("last"), zero.alias("hash"), zero.alias("parent"))
    return root.union(below)


def _meet(rows: DataFrame, facts: DataFrame, key: list[str], weight: str, total: int) -> DataFrame:
    """Inner join; facts that more than total / HUBS rows meet (weight) go by broadcast, so no task gets a hub's rows."""
    limit = max(64, total // HUBS)
    hubs = F.broadcast(facts.where(F.col(weight) > limit))
    rest = rows.join(hubs.select(*key), key, "left_anti")
    return rows.join(hubs, key).unionByName(rest.join(facts.where(F.col(weight) <= limit), key))


def _joined_ids(piece: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []

        def out():
            return pa.record_batch([pa.array([node[0]], pa.int64()), pa.array([node[1]], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], names=["depth", "hash", "first", "ids"])

        for b in batches:
            for d, h, conv in zip(*(b.column(c).to_pylist() for c in ("depth", "hash", "conv_id"))):
                if ids and ((d, h) != node or len(ids) >= piece):
                    yield out()
                    ids = []
                node = (d, h)
                ids.append(conv)
        if ids:
            yield out()

    return run


def _hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    node, sha = None, None
    for b in batches:
        done = []
        for d, h, ids in zip(*(b.column(c).to_pylist() for c in ("depth", "hash", "ids"))):
            if (d, h) != node:
                if node is not None:
                    done.append((*node, sha.hexdigest()))
                node, sha = (d, h), hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.encode())
        if done:
            yield _digests(done)
    if node is not None:
        yield _digests([(*node, sha.hexdigest())])


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.string()))], names=["depth", "hash", "ends_sha256"])


def ends(members: DataFrame, piece: int = 4096) -> DataFrame:
    """depth, hash, ends_sha256 of the nodes at which conversations end."""
    n = max(2, shuffles(members.sparkSession))
    at = members.where("last").select("depth", "hash", "conv_id")
    dealt = at.repartitionByRange(n, "hash", "depth", "conv_id").sortWithinPartitions("hash", "depth", "conv_id")
    pieces = dealt.mapInArrow(_joined_ids(piece), "depth long, hash binary, first long, ids string")
    return pieces.repartition(n, *NODE).sortWithinPartitions(*NODE, "first").mapInArrow(_hashed_ids, "depth long, hash binary, ends_sha256 string")


def _attached(paths: DataFrame) -> DataFrame:
    """path, level, up, saved, leaves -> path, up, up_depth, saved, leaves with all that hangs on the path, level by level from below."""
    low = paths.agg(F.max("level")).first()[0] or 0
    done, below = None, None
    for level in range(low, 0, -1):
        here = paths.where(F.col("level") == level)
        if below is not None:
            more = below.groupBy(F.col("up").alias("path")).agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l"))
            here = here.join(more, "path", "left").withColumn("saved", F.col("saved") + F.coalesce("s", F.lit(0))).withColumn("leaves", F.col("leaves") + F.coalesce("l", F.lit(0))).drop("s", "l")
        below = stash(here.select("path", "up", "up_depth", "saved", "leaves"), "paths")
        done = below if done is None else done.union(below)
    return done if done is not None else paths.select("path", "up", "up_depth", "saved", "leaves")


def trie(rows: DataFrame, share: int = 100, most: int = 6, chunk: int = 1024, piece: int = 4096) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    members = stash(rebuilt(ordered_turns(rows), share, most), "members")
    one = F.when(F.min("value") == F.max("value"), F.min("parent")).otherwise(F.raise_error(F.lit("two sequences of turns have one hash")))
    found = members.groupBy(*NODE).agg(F.min("conv_id").alias("first"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"), one.alias("parent"))
    found = stash(found, "nodes")
    child = F.struct("n_convs", (-F.col("first")).alias("k"), F.col("hash").alias("heir"))
    inner = found.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("hash")).agg(F.count("*").alias("n_children"), F.max(child).alias("c"))
    inner = stash(inner.select("depth", "hash", "n_children", "c.heir"), "inner")
    heirs = inner.select(F.col("depth") + 1, F.col("heir"), F.lit(False)).toDF("depth", "hash", "light")
    nodes = found.join(inner.drop("heir"), NODE, "left").join(heirs, NODE, "left")
    nodes = stash(nodes.withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")).withColumn("light", F.coalesce("light", F.lit(True))), "nodes")
    n_members, n_nodes = members.count(), nodes.count()

    # a path's rows are the lower end of its leaf's conversation, from the last light node on
    leaves = nodes.where("n_children = 0").select(F.col("first").alias("conv_id"))
    ways = _meet(members.join(leaves, "conv_id").select(F.col("conv_id").alias("path"), *NODE), nodes, NODE, "n_convs", n_members)
    tops = stash(ways.where("light").groupBy("path").agg(F.max("depth").alias("top"), F.count("*").alias("level")), "tops")
    on = stash(ways.join(tops.select("path", "top"), "path").where("depth >= top").withColumn("own", (F.col("n_convs") - 1) * F.col("chars")), "on")

    total = on.groupBy("path").agg(F.sum("own").alias("saved"), F.lit(1).cast("long").alias("leaves"))
    upper = on.where("depth = top and depth > 0").select("path", (F.col("depth") - 1).alias("depth"), F.col("parent").alias("hash"))
    holder = on.select(F.col("path").alias("up"), *NODE, F.col("first").alias("up_first"), "n_children")
    linked = _meet(upper, holder, NODE, "n_children", n_nodes).select("path", "up", F.col("depth").alias("up_depth"))
    paths = stash(total.join(tops.select("path", "level"), "path").join(linked, "path", "left"), "paths")
    hung = _attached(paths).where("up is not null").groupBy(F.col("up").alias("path"), F.col("up_depth").alias("depth")).agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l"))

    part = F.floor(F.col("depth") / chunk).alias("part")
    values = on.join(hung, ["path", "depth"], "left").select(
        "path", "depth", "hash", part, (F.col("own") + F.coalesce("s", F.lit(0))).alias("s"), ((F.col("n_children") == 0).cast("long") + F.coalesce("l", F.lit(0))).alias("l")
    )
    values = stash(values, "values")
    down = W.partitionBy("path").orderBy(F.desc("part")).rowsBetween(W.unboundedPreceding, -1)
    lower = values.groupBy("path", "part").agg(F.sum("s").alias("s"), F.sum("l").alias("l")).select("path", "part", *[F.coalesce(F.sum(c).over(down), F.lit(0)).alias(f"{c}_below") for c in "sl"])
    inside = W.partitionBy("path", "part").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = values.select("path", "part", *NODE, F.sum("s").over(inside).alias("s"), F.sum("l").over(inside).alias("l")).join(lower, ["path", "part"])
    summed = summed.select(*NODE, (F.col("l") + F.col("l_below")).alias("n_leaves"), (F.col("s") + F.col("s_below")).alias("saved_tokens"))

    asked = nodes.where("depth > 0").select(F.col("hash").alias("me"), (F.col("depth") - 1).alias("depth"), F.col("parent").alias("hash"))
    parents = _meet(asked, nodes.select(*NODE, F.col("first").alias("parent_conv_id"), "n_children"), NODE, "n_children", n_nodes).select(F.col("me").alias("hash"), (F.col("depth") + 1).alias("depth"), "parent_conv_id")
    out = nodes.join(summed, NODE).join(parents, NODE, "left").join(ends(members, piece), NODE, "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select(F.col("first").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))


ORACLE_OP13 = """
WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce([n::UBIGINT] || list_transform(range(8), lambda k: 0::UBIGINT),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS t),
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id
        ORDER BY turn NULLS FIRST, left(sha256(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))), 32)) AS pos
      FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY pos) AS turns FROM t GROUP BY conv_id),
h AS (SELECT conv_id, turns, conv_id - conv_id % 100 AS head,
        xor(list_reduce([4294967295::UBIGINT] || list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: unicode(substr(conv_id::VARCHAR, i, 1))::UBIGINT),
          lambda a, b: xor(a >> 8, crc.t[(xor(a, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT) % 6 AS h FROM s, crc),
r AS (SELECT h.conv_id, list_concat(CASE WHEN h.h > 0 THEN coalesce(s.turns[1:h.h::BIGINT], []) ELSE [] END, h.turns[h.h::BIGINT + 1:]) AS turns
      FROM h LEFT JOIN s ON s.conv_id = h.head),
m AS (SELECT conv_id, d AS depth, turns[1:d] AS seq, turns[1:d - 1] AS up, len(turns) = d AS ends, length(turns[d].text) AS chars
      FROM (SELECT conv_id, turns, unnest(range(1, len(turns) + 1)) AS d FROM r)
      UNION ALL SELECT conv_id, 0, [], NULL, len(turns) = 0, 0 FROM r),
n AS (SELECT depth, seq, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
        sha256(coalesce(string_agg(CASE WHEN ends THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM m GROUP BY depth, seq),
c AS (SELECT up AS seq, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY up),
k AS (SELECT n.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * coalesce(chars, 0) AS own FROM n LEFT JOIN c USING (seq)),
a AS (SELECT seq[1:d] AS seq, sum(own)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
      FROM (SELECT seq, own, n_children, unnest(range(0, depth + 1)) AS d FROM k) GROUP BY 1)
SELECT k.conv_id, k.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, a.n_leaves, a.saved_tokens, k.ends_sha256
FROM k JOIN a USING (seq) LEFT JOIN k p ON k.depth > 0 AND p.seq = k.up
"""
