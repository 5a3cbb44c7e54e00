"""The pipeline's form of the SimHash near-dedup: its links and wider candidates, verified by Jaccard similarity.

Candidates are what the byte-position index links (4 of 64 bits) and, as two fingerprints of similarity 0.8 differ by 9
to 10 bits, beyond what an index of bytes finds, documents that share one of `BANDS` keys of `ROWS` minima of the same
shingle hashes. A pair of similarity s shares one with probability 1 - (1 - s^7)^32: 0.9995 at 0.8, more above.
Candidates are joined into parts, every part's shingle sets (as 64-bit hashes) meet in one task, and all pairs of the
part are compared exactly, save pairs that are connected already. Parts of more than `block` shingles are dealt into
blocks that meet pairwise.

Words are separated by ASCII white space and lower-cased as in simhash; a text of fewer words than `width` is one
shingle, texts without words (null ones too) are equal. A node is a text's 64-bit hash, so rows with equal texts are one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import bounded_batches, stash
from gleaner.llm.simhash import fingerprint_of, hashed_shingles, near_links
from gleaner.operators.graph import connected_components

BANDS, ROWS = 32, 7
_rng = np.random.default_rng(42)
_MUL, _ADD, _MIX = (_rng.integers(0, 2**64, BANDS * ROWS, np.uint64) | np.uint64(1) for _ in range(3))


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles, one at least."""
    return _distinct(hashed_shingles(text, width))


def _distinct(h: np.ndarray) -> np.ndarray:
    return np.unique(h) if len(h) else np.zeros(1, np.uint64)


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def band_keys(s: np.ndarray) -> np.ndarray:
    low = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(s), 1024):
        np.minimum(low, (_MUL[:, None] * s[None, at : at + 1024] + _ADD[:, None]).min(axis=1), out=low)
    return ((low ^ (low >> np.uint64(29))) * _MIX).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64).view(np.int64)


def similar(sets: list[np.ndarray], least: float) -> Iterator[tuple[int, int]]:
    """Pairs of similarity >= least that connect all that such pairs connect."""
    size = np.array([len(s) for s in sets])
    rest = np.arange(len(sets))
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            fits = (size[rest] >= least * size[x] - 1e-9) & (size[x] >= least * size[rest] - 1e-9)
            near = np.zeros(len(rest), bool)
            if fits.any():
                others = rest[fits]
                flat = np.concatenate([sets[i] for i in others])
                at = np.minimum(np.searchsorted(sets[x], flat), size[x] - 1)
                both = np.add.reduceat(sets[x][at] == flat, np.cumsum(size[others]) - size[others], dtype=np.int64)
                near[fits] = both >= least * (size[others] + size[x] - both) - 1e-9
            for i in rest[near].tolist():
                yield int(x), i
            queue += rest[near].tolist()
            rest = rest[~near]


def _keys(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hashes = [hashed_shingles(x, width) for x in b.column("t").to_pylist()]
        fp = pa.array(np.array([fingerprint_of(h) for h in hashes], np.uint64).view(np.int64))
        sets = [_distinct(h) for h in hashes]
        keys = pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))
        yield pa.record_batch([b.column("node"), fp, pa.array([len(s) for s in sets], pa.int64()), keys], names=["node", "fp", "size", "keys"])


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [shingle_set(x, width).tobytes() for x in b.column("t").to_pylist()]
        yield pa.record_batch([*(b.column(n) for n in ("part", "own", "parts", "node")), pa.array(sets, pa.binary())], names=["part", "own", "parts", "node", "grams"])


def _links(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Rows (part, a, b, node, grams) sorted by part, a, b -> edges. Holds one batch and one unit."""
    at, nodes, sets = None, [], []

    def links():
        found = list(similar(sets, least))
        return pa.record_batch([pa.array([nodes[k[i]] for k in found], pa.int64()) for i in (0, 1)], names=["src", "dst"])

    for b in batches:
        for *unit, node, grams in zip(*(b.column(n).to_pylist() for n in ("part", "a", "b", "node", "grams"))):
            if unit != at:
                if len(nodes) > 1:
                    yield links()
                at, nodes, sets = unit, [], []
            nodes.append(node)
            sets.append(np.frombuffer(grams, np.uint64))
    if len(nodes) > 1:
        yield links()


def near_copies(docs: DataFrame, width: int = 5, least: float = 0.8, block: int = 1 << 19) -> DataFrame:
    """node, component of the texts that have near copies; component is the smallest node (text_hash()) of the group."""
    bounded_batches(docs.sparkSession)
    text = docs.select(text_hash().alias("node"), F.coalesce("text", F.lit("")).cast("binary").alias("t"))
    keyed = stash(text.mapInArrow(partial(_keys, width=width), "node long, fp long, size long, keys array<long>"), "minhash")
    posts = keyed.select("node", F.explode("keys").alias("key"))
    lists = posts.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("key", "low")
    shared = posts.join(lists, "key").where("node <> low").select(F.col("node").alias("src"), F.col("low").alias("dst")).distinct()
    fps = keyed.groupBy("fp").agg(F.min("node").alias("node"))
    equal = keyed.join(fps.withColumnRenamed("node", "dst"), "fp").where("node <> dst").select(F.col("node").alias("src"), "dst")
    parts = connected_components(shared.union(equal).union(near_links(fps.select("fp", "node"))))
    parts = stash(parts.withColumnRenamed("component", "part"), "parts")
    sizes = keyed.select("node", "size").distinct().join(parts, "node").groupBy("part").agg(F.sum("size").alias("size"))
    many = sizes.select("part", F.ceil(F.col("size") / block).cast("int").alias("parts"))
    units = parts.join(many, "part").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    one = text.join(units, "node").groupBy("part", "own", "parts", "node").agg(F.first("t").alias("t"))
    sets = one.mapInArrow(partial(_sets, width=width), "part long, own int, parts int, node long, grams binary")
    dealt = (
        sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .where("own <> other or parts = 1")
        .select("part", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "node", "grams")
    )
    edges = dealt.repartition("part", "a", "b").sortWithinPartitions("part", "a", "b").mapInArrow(partial(_links, least=least), "src long, dst long")
    return connected_components(edges)
