"""Best-fit packing with matching of large items.

Documents become token ids of a public byte-level BPE vocabulary and a closing id 0. Longer ones are cut into pieces of
`capacity`, the first piece being the short one. How items share sequences depends on their lengths alone, so the
plan is made from the table of lengths (at most `capacity` rows, whatever the corpus): items above a third of the
capacity meet at most in pairs, each with the longest partner that fits, longest first; the others go, longest first,
to the open sequence with the smallest gap that holds them. Sequences of one filling are kept as ranges, so the plan is
a short list of (length, ranks, sequences, offset). Rows find their place by their rank among equal lengths, counted in
buckets of about `bucket_rows` rows per length, so that a length that many copies share is counted in many tasks. Pieces
of full length are sequences as they are.

Ids equal those of the `tokenizers` library for the same vocabulary, in which the end-of-text string is a special
token; the `tiktoken` form of the vocabulary is used because it is four times as fast (a test compares the two). Texts
with a run of `RUN` or more characters of one class, white space above all, for which its pattern matcher has too little
stack, go to `tokenizers` itself.

Null and empty texts are the single id 0. Repeated rows are packed each. Empty tables give an empty result; further
columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.llm.common import bounded_batches, stash, table

END = "<|endoftext|>"
RUN = 50_000
_CLASSES = re.compile(r"\s+|\w+|[^\w\s]+")
_encodings: dict[str, object] = {}


def encoding(vocabulary: str | None = None):
    """The vocabulary as a tiktoken encoding; one per worker process."""
    import public_tokenizers
    import tiktoken

    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
    if path not in _encodings:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={END: 50256})
    return _encodings[path]


def _long_run(text: str) -> bool:
    return len(text) >= RUN and any(m.end() - m.start() >= RUN for m in _CLASSES.finditer(text))


def token_ids(enc, text: str) -> np.ndarray:
    if _long_run(text):
        import public_tokenizers
        from tokenizers import Tokenizer

        if "json" not in _encodings:
            _encodings["json"] = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        return np.array([*_encodings["json"].encode(text, add_special_tokens=False).ids, 0], dtype="<u4")
    ids = enc.encode(text, allowed_special={END}, disallowed_special=()) if END in text else enc.encode_ordinary(text)
    return np.array([*ids, 0], dtype="<u4")


def pieces(docs: DataFrame, capacity: int = 2048, vocabulary: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32; texts are tokenised whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary)
        for b in batches:
            rows = []
            known: dict[str, list[tuple]] = {}  # copies in a batch are tokenised once
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                if (cut := known.get(text or "")) is None:
                    ids = token_ids(enc, text or "")
                    first = len(ids) % capacity or capacity
                    ends = range(first, len(ids) + 1, capacity)
                    starts = [0, *ends[:-1]]
                    cut = known[text or ""] = [(k, a, e - a, zlib.crc32(ids[a:e].tobytes())) for k, (a, e) in enumerate(zip(starts, ends))]
                rows += [(doc_id, *c) for c in cut]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))] if rows else [pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, sequences, offset): ranks go round the sequences, layer on layer."""
    out: list[tuple[int, int, int, int, int, int]] = []
    done = dict.fromkeys(counts, 0)
    left = dict(counts)
    made = 0
    gaps: dict[int, list[tuple[int, int]]] = {}

    def put(size: int, n: int, first: int, bins: int, offset: int) -> None:
        out.append((size, done[size], done[size] + n, first, bins, offset))
        done[size] += n
        left[size] -= n

    def open_gap(gap: int, first: int, bins: int) -> None:
        if gap and bins:
            gaps.setdefault(gap, []).append((first, bins))

    sizes = sorted(counts)
    large = [s for s in sizes if 3 * s > capacity]
    for s in reversed(large):
        while left[s]:
            k = bisect.bisect_right(large, min(s, capacity - s)) - 1
            while k >= 0 and (not left[large[k]] or large[k] == s and left[s] < 2):
                k -= 1
            if k < 0:
                n = left[s]
                put(s, n, made, n, 0)
                open_gap(capacity - s, made, n)
            else:
                t = large[k]
                n = left[s] // 2 if t == s else min(left[s], left[t])
                put(s, n, made, n, 0)
                put(t, n, made, n, s)
                open_gap(capacity - s - t, made, n)
            made += n
    for s in reversed([s for s in sizes if 3 * s <= capacity]):
        while left[s]:
            fit = min((g for g in gaps if g >= s), default=0)
            per = (fit or capacity) // s
            need = -(-left[s] // per)
            if fit:
                first, bins = gaps[fit].pop()
                if not gaps[fit]:
                    del gaps[fit]
                use = min(need, bins)
                open_gap(fit, first + use, bins - use)
            else:
                first, use, fit = made, need, capacity
                made += need
            n = min(left[s], use * per)
            put(s, n, first, use, capacity - fit)
            whole, over = divmod(n, use)  # `over` sequences hold one more than the others
            open_gap(fit - (whole + 1) * s, first, over)
            open_gap(fit - whole * s, first + over, use - over)
    return out


def pack(items: DataFrame, capacity: int = 2048, bucket_rows: int = 1000) -> DataFrame:
    """items with doc_id, piece, length -> the same with sequence_id and offset. items must be stable: it is read three times."""
    spark = items.sparkSession
    # at most `capacity` rows; the plan has at most a few for each
    counts = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}
    counts.pop(capacity, None)
    rows = plan(counts, capacity)
    made = max((first + bins for _, _, _, first, bins, _ in rows), default=0)
    full = items.where(F.col("length") == capacity).withColumn("sequence_id", made + F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    dealt = F.broadcast(spark.createDataFrame([(k, -(-n // bucket_rows)) for k, n in counts.items()], "length long, _buckets long"))
    placed = items.where(F.col("length") < capacity).join(dealt, "length").withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.col("_buckets")))
    per = placed.groupBy("length", "_b").agg(F.count("*").alias("_n"))
    along = W.partitionBy("length").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = per.select("length", "_b", F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_before"))
    steps = F.broadcast(spark.createDataFrame(rows, "_l long, lo long, hi long, first long, bins long, off long"))
    inside = W.partitionBy("length", "_b").orderBy("doc_id", "piece", "ids_crc32")
    ranked = placed.withColumn("_r", F.row_number().over(inside) - 1).join(offsets, ["length", "_b"]).withColumn("_r", F.col("_r") + F.col("_before"))
    at = F.col("_r") - F.col("lo")
    return (
        ranked.join(steps, (F.col("length") == F.col("_l")) & (F.col("_r") >= F.col("lo")) & (F.col("_r") < F.col("hi")))
        .withColumn("sequence_id", F.col("first") + at % F.col("bins"))
        .withColumn("offset", (F.col("off") + F.floor(at / F.col("bins")) * F.col("length")).cast("long"))
        .select(*items.columns, "sequence_id", "offset")
        .union(full)
    )


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(stash(pieces(table(spark, sf_dir, "documents")), "pieces"))


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: places of all pieces of all rows, repeated ones each; texts are found by doc_id in the stage before."""
    return pack(stash(pieces(docs), "pieces"))
