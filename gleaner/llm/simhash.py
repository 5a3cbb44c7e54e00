"""SimHash near-duplicates: byte-position inverted index, count filtering, verification.

Two 64-bit fingerprints at most `max_bits` = 4 apart share at least 8 - 4 = 4 of their 8 positional bytes. Posting
lists of single bytes would hold a 256th of the corpus each, so postings carry three positional bytes: the 20 triples
of a Turan system, one of which lies inside every set of four positions. Within a posting list the shared positional
bytes of each pair are tallied, pairs with fewer than four are dropped, and the others are verified bit by bit. A list
longer than `block` is dealt into blocks that meet pairwise in separate tasks; a task emits a star per connected part,
not its pairs.

Nulls and texts without words have fingerprint 0 and are linked like any other. Each fingerprint is one node, whichever
rows hold it, so repeated rows and large groups of copies cost nothing after the first pass, and rows without doc_id
link others like any row. component_id is the smallest non-null doc_id of the component (null if there is none). An
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import bounded_batches, stash, table
from gleaner.operators.graph import connected_components

_xxh = partial(xxhash.xxh64_intdigest, seed=42)
#: Groups of byte positions from which the triples are drawn.
_GROUPS = ((0, 1, 2), (3, 4, 5), (6, 7))


def triples() -> list[tuple[int, int, int]]:
    """Three-element sets of the 8 positions such that every four positions include one."""
    out = [t for g in _GROUPS for t in combinations(g, 3)]
    for g, nxt in zip(_GROUPS, _GROUPS[1:] + _GROUPS[:1]):
        out += [tuple(sorted((*p, q))) for p in combinations(g, 2) for q in nxt]
    return sorted(out)


def hashed_shingles(text: bytes | None, width: int = 4) -> np.ndarray:
    """Hashes of all runs of `width` words, in order; a text of fewer words is one run, one without words has none."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        grams = [joined]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *ends[:-width].tolist()]
        grams = [joined[a:b] for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())]
    return np.fromiter(map(_xxh, grams), np.uint64, len(grams))


def fingerprint(text: bytes | None, width: int = 4) -> int:
    return fingerprint_of(hashed_shingles(text, width))


def fingerprint_of(h: np.ndarray) -> int:
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        ones += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [fingerprint(x, width) for x in b.column("t").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), pa.array(np.array(fp, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", F.col("text").cast("binary").alias("t")).mapInArrow(run, "doc_id long, fp long")


def _star(fp: np.ndarray, node: np.ndarray, least: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the parts of one posting list that are linked, as few as there are members at most."""
    x = fp[:, None] ^ fp[None, :]
    tally = (x.view(np.uint8).reshape(len(fp), len(fp), 8) == 0).sum(axis=2, dtype=np.uint8)
    near = (tally >= least) & (np.bitwise_count(x) <= bits)
    label = np.arange(len(fp))
    while True:
        low = np.where(near, label[None, :], len(fp)).min(axis=1)
        low = low[low]
        if (low == label).all():
            break
        label = low
    far = label != np.arange(len(fp))
    return node[far], node[label[far]]


def _links(batches: Iterator[pa.RecordBatch], least: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Rows (unit, fp, node) sorted by unit -> edges. Holds one batch and one posting list."""
    kept: list[np.ndarray] = [np.empty(0, np.int64)] * 3

    def links(u, fp, node):
        src, dst = [], []
        cut = np.flatnonzero(np.diff(u)) + 1
        lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [len(u)]])
        size = hi - lo
        fp = fp.view(np.uint64)
        for d in range(1, 8):  # short lists: each member with the d-th after it
            i = np.flatnonzero(np.repeat(size <= 8, size))
            i = i[i + d < len(u)]
            i = i[u[i] == u[i + d]]
            x = fp[i] ^ fp[i + d]
            tally = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
            i = i[(tally >= least) & (np.bitwise_count(x) <= bits)]
            src.append(node[i])
            dst.append(node[i + d])
        for k in np.flatnonzero(size > 8):
            a, b = _star(fp[lo[k] : hi[k]], node[lo[k] : hi[k]], least, bits)
            src.append(a)
            dst.append(b)
        return pa.record_batch([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], names=["src", "dst"])

    for b in batches:
        if not b.num_rows:
            continue
        u, fp, node = (np.concatenate([k, b.column(n).to_numpy()]) for k, n in zip(kept, ("unit", "fp", "node")))
        whole = int(np.searchsorted(u, u[-1]))  # the last list may go on in the next batch
        if whole:
            yield links(u[:whole], fp[:whole], node[:whole])
        kept = [x[whole:] for x in (u, fp, node)]
    if len(kept[0]):
        yield links(*kept)


def near_links(nodes: DataFrame, max_bits: int = 4, block: int = 512) -> DataFrame:
    """(fp, node), one row per fingerprint -> edges (src, dst) that connect what links of at most max_bits connect."""
    if not 0 <= max_bits <= 4:
        raise ValueError("the index of three positional bytes is complete up to 4 differing bits")
    byte = [F.shiftrightunsigned("fp", 8 * k).bitwiseAND(255) for k in range(8)]
    keys = [
        (F.lit(i).cast("long") * 2**24 + byte[a] * 65536 + byte[b] * 256 + byte[c]) for i, (a, b, c) in enumerate(triples())
    ]
    posts = nodes.select("fp", "node", F.explode(F.array(*keys)).alias("key"))
    long_lists = posts.groupBy("key").count().where(F.col("count") > block)
    parts = F.when(F.col("count").isNull(), 1).otherwise(F.ceil(F.col("count") / block))
    dealt = (
        posts.join(long_lists, "key", "left")
        .withColumn("parts", parts.cast("int"))
        .withColumn("own", F.pmod(F.hash("fp"), F.col("parts")))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(
            "fp",
            "node",
            # a hash, so that any number of blocks fits; lists that met by chance would be compared in vain, no more
            F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("unit"),
        )
    )
    return (
        dealt.repartition("unit")
        .sortWithinPartitions("unit", "fp")
        .mapInArrow(partial(_links, least=8 - max_bits, bits=max_bits), "src long, dst long")
        .distinct()
    )


def near_duplicates(docs: DataFrame, width: int = 4, max_bits: int = 4) -> DataFrame:
    """doc_id, fp, component_id of every row of docs."""
    fps = stash(fingerprints(docs, width), "fp")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    comps = connected_components(near_links(nodes.select("fp", F.col("fp").alias("node")), max_bits))
    parts = nodes.join(comps.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    parts = stash(parts, "components")
    ids = parts.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    # components of more than `limit` nodes, about 1,000 at most, are joined by broadcast: no task gets all of one
    limit = max(64, parts.count() // 1000)
    large = F.broadcast(ids.where(F.col("n") > limit))
    named = parts.join(large, "component").select("fp", "component_id")
    named = named.union(parts.join(large, "component", "left_anti").join(ids.where(F.col("n") <= limit), "component").select("fp", "component_id"))
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (Jaccard similarity of 5-word shingles >= 0.8) one row stays, whole.

    It is the one with the smallest doc_id, a null one only where the group has no other; of rows that share it, the one
    with the least hash of the text; of rows equal in both, any one. Null texts count as empty. A repeated doc_id means
    nothing: rows are told apart by doc_id and text. Columns are carried as they are, whatever their names.
    """
    from gleaner.llm.jaccard import near_copies, text_hash

    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").isNull().alias("_none"), F.coalesce("doc_id", F.lit(0)).alias("_id"), text_hash().alias("_h"))
    own = rows.select("_none", "_id", "_h").groupBy("_h").agg(F.min(F.struct("_none", "_id", "_h")).alias("best"))
    groups = own.join(near_copies(docs).withColumnRenamed("node", "_h"), "_h", "left").groupBy(F.coalesce("component", "_h").alias("c")).agg(F.min("best").alias("best"))
    kept = rows.join(groups.select("best.*"), ["_none", "_id", "_h"])
    return kept.groupBy("_none", "_id", "_h").agg(F.first("_row").alias("_row")).select("_row.*")
