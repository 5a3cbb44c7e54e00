"""Language identification by prediction by partial matching.

For each language a byte context tree of orders 0 to 3 is counted on a bounded sample of labelled documents and then
frozen. A context predicts the bytes seen in it by their counts and escapes, with the count of distinct bytes (method
C), to the next shorter context over the bytes not yet excluded, in the end to all 256 bytes alike. A document's code
length under a tree is the exact sum over all its bytes; the shortest one wins, ties going to the smaller lang value,
and the score is its share of probability against the other languages. Bytes that no sample holds are one symbol, as
all trees treat them alike, so a context's tables are dense and texts are scored whole with three look-ups a byte.

Sample: per language `per_lang` documents at most, the first by a hash of the id and text, and of each at most a run of
`max_bytes` bytes that starts where the hash says, so that languages of long documents are learned too; no document with crc32(doc_id) mod 4 = 2 is
among them. Both bounds limit what the driver holds for a language; a repeated doc_id counts by row.

Text that is null or has no letter gives `und` and score 0, as does every text when nothing could be learned. A null
doc_id is not held out and not learned from. Repeated rows are answered each; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.llm.common import bounded_batches, crc32_id, slices, table

ORDER = 3
_trees: dict[bytes, tuple] = {}


class Tree:
    """Frozen context tree: bits[node * width + symbol], and the node of the longest known context of each length."""

    def __init__(self, texts: list[bytes], symbol: np.ndarray, width: int):
        seqs = [symbol[np.frombuffer(t, np.uint8)].astype(np.int64) for t in texts if t]
        flat = np.concatenate(seqs) if seqs else np.empty(0, np.int64)
        at = np.concatenate([np.arange(len(s)) for s in seqs]) if seqs else flat  # place inside its document
        count = np.bincount(flat, minlength=width).astype(float)
        n, d = count.sum(), np.count_nonzero(count)
        p = np.where(count > 0, count / (n + d), d / (n + d) / max(1, 256 - d)) if n else np.full(width, 1 / 256)
        tables, self.nodes = [p[None, :]], [np.zeros(1, np.int32)]
        total, ctx = 1, np.zeros(len(flat), np.int64)
        for k in range(1, ORDER + 1):
            ctx[k:] = ctx[k:] + flat[: len(flat) - k] * width ** (k - 1) if len(flat) > k else 0
            ok = at >= k
            pair, c = np.unique(ctx[ok] * width + flat[ok], return_counts=True)
            known, row = np.unique(pair // width, return_inverse=True)
            counts = np.zeros((len(known), width))
            counts[row, pair % width] = c
            shorter = np.concatenate(tables)[self.nodes[k - 1][known % width ** (k - 1)]]
            n, d = counts.sum(axis=1, keepdims=True), np.count_nonzero(counts, axis=1)[:, None]
            rest = 1 - np.where(counts > 0, shorter, 0).sum(axis=1, keepdims=True)
            tables.append(np.where(counts > 0, counts / (n + d), d / (n + d) * shorter / np.maximum(rest, 1e-12)))
            node = np.tile(self.nodes[k - 1], width)  # unknown contexts: the node of the next shorter one
            node[known] = total + np.arange(len(known))
            self.nodes.append(node.astype(np.int32))
            total += len(known)
        self.bits = -np.log2(np.maximum(np.concatenate(tables), 1e-30)).astype(np.float32).ravel()
        self.width = width

    def lengths(self, s: np.ndarray, ctx: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Bits of each document s[start:end]; ctx: the context of ORDER symbols before each place."""
        node = self.nodes[ORDER][ctx]
        for k in range(ORDER):
            i = starts[starts + k < ends] + k
            node[i] = self.nodes[k][ctx[i] % self.width**k]
        total = np.concatenate([[0.0], np.cumsum(self.bits[node.astype(np.int64) * self.width + s], dtype=np.float64)])
        return total[ends] - total[starts]


def learn(samples: dict[str, list[bytes]]) -> tuple[list[str], np.ndarray, int, list[Tree]]:
    seen = np.zeros(256, bool)
    for texts in samples.values():
        for t in texts:
            seen[np.frombuffer(t, np.uint8)] = True
    symbol = np.where(seen, np.cumsum(seen) - 1, seen.sum()).astype(np.int32)
    width = int(seen.sum()) + 1
    langs = sorted(samples)
    return langs, symbol, width, [Tree(samples[x], symbol, width) for x in langs]


def predict(model: tuple, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[str], np.ndarray]:
    langs, symbol, width, trees = model
    s = symbol[data]
    ctx = np.zeros(len(s), np.int32)
    for k in range(1, ORDER + 1):
        ctx[k:] += s[: max(0, len(s) - k)] * np.int32(width ** (k - 1))
    bits = np.stack([t.lengths(s, ctx, starts, ends) for t in trees], axis=1)
    best = bits.argmin(axis=1)
    gap = np.minimum(bits - bits.min(axis=1, keepdims=True), 1000)
    return [langs[i] for i in best], 1 / np.exp2(-gap).sum(axis=1)


def training_sample(docs: DataFrame, per_lang: int = 96, max_bytes: int = 16384, salts: int = 16) -> dict[str, list[bytes]]:
    """Bounded by languages x per_lang x max_bytes. Picked by id and hash first, so that texts are not shuffled."""
    fit = docs.where(F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}") & (crc32_id() % 4 != 2))
    key = F.xxhash64(F.col("doc_id"), F.lit("langid"), F.col("text"))
    order = W.partitionBy("lang", "salt").orderBy("key", "doc_id")
    keyed = fit.select("lang", "doc_id", key.alias("key"), F.pmod(key, F.lit(salts)).alias("salt"))
    ids = keyed.withColumn("r", F.row_number().over(order)).where(F.col("r") <= max(1, per_lang // salts)).select("doc_id", "key").distinct()
    out: dict[str, list[bytes]] = {}
    whole = F.col("text").cast("binary")
    start = F.pmod(F.col("key"), F.greatest(F.lit(1), F.octet_length(whole) - max_bytes + 1)).cast("int") + 1  # any run of a longer text
    part = F.substring(whole, start, F.lit(max_bytes)).alias("t")
    rows = fit.withColumn("key", key).join(F.broadcast(ids), ["doc_id", "key"]).select("lang", "doc_id", part).distinct().collect()
    for r in sorted(rows, key=lambda r: (r["lang"], r["doc_id"], bytes(r["t"]))):
        out.setdefault(r["lang"], []).append(bytes(r["t"]))
    return out


def identify(docs: DataFrame, samples: dict[str, list[bytes]]) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for b in batches:
            if model is None and shared.value:
                key = hashlib.sha256(repr(sorted(shared.value.items())).encode()).digest()
                if key not in _trees:
                    _trees.clear()
                    _trees[key] = learn(shared.value)
                model = _trees[key]
            lang, score = ["und"] * b.num_rows, np.zeros(b.num_rows)
            for lo, hi in slices(b, "t") if model else ():
                texts = b.column("t").slice(lo, hi - lo).to_pylist()
                data = np.frombuffer(b"".join(texts), np.uint8)
                ends = np.cumsum([len(t) for t in texts])
                lang[lo:hi], score[lo:hi] = predict(model, data, np.concatenate([[0], ends[:-1]]), ends)
            worded = b.column("worded").to_pylist()
            lang = [x if w else "und" for x, w in zip(lang, worded)]
            score = np.where(np.array(worded, bool), score, 0.0)
            yield pa.record_batch([b.column("doc_id"), b.column("held_out"), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id", F.coalesce(crc32_id() % 4 == 2, F.lit(False)).alias("held_out"), text.rlike("\\p{L}").alias("worded"), text.cast("binary").alias("t")
    ).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, training_sample(docs))
