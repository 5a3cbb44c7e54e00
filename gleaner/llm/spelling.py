"""Spelling variants: words one edit apart, grouped under their far more frequent form.

Words are counted over all whole texts, runs of letters being counted per document and block before they move. A word w
is cut into two halves; an edit leaves one of them as it is, at the same end of the other word. Automaton shards
(Aho-Corasick) hold both halves of every word, dealt by hash of (end, half); shards grow in number with the words
(`shard_halves` each). Every word is scanned by the shards that can hold its beginnings or ends of fitting length, four
at most; a hit is kept if offset and length fit, and then the whole words are compared. A pair whose halves both fit is
counted from its beginning alone.

A half that more than `hot` words begin or end with would make pairs of its whole group. Its words meet by what is left
beside the half instead, with any one character taken out (64-bit hashes, then Spark's levenshtein): words of one edit
share such a key, and only some alphabet times length of words can share one. Frequent beginnings so cost what their
words' lengths cost.

Letters are [A-Za-z] and U+00C0 to U+00FF; only A-Z become lower case. So that there are variants, a run whose unsigned
crc32 of "<doc_id>:<run>" is divisible by `every` loses one code point. Words have `least_length` code points and
`least` occurrences or more. A form is the near word with the largest n (ties: the smallest in code-point order), if it
has `ratio` times the word's n; forms are followed to the last one by pointer doubling. Null texts are empty, a null
doc_id counts as the empty string, repeated rows count each. Empty tables give an empty result; further columns are
ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import bounded_batches, shuffles, stash, table

RUNS = "[A-Za-zÀ-ÿ]"


def word_counts(docs: DataFrame, least_length: int = 6, least: int = 5, every: int = 199, block_words: int = 100_000) -> DataFrame:
    """word, n."""
    runs = re.compile(f"{RUNS}{{{least_length},}}")  # runs are maximal and only become shorter, so shorter ones are left out

    def out(n: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(1)):
                seed = zlib.crc32(f"{doc_id.as_py() or ''}:".encode() if doc_id.is_valid else b":")
                lowered = (text.as_py() or "").encode().lower().decode()  # of bytes: A-Z alone
                for word, k in Counter(runs.findall(lowered)).items():
                    h = zlib.crc32(word.encode(), seed)
                    if h % every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least_length:
                            continue
                    n[word] += k
                if len(n) >= block_words:
                    yield out(n)
                    n = Counter()
        if n:
            yield out(n)

    bounded_batches(docs.sparkSession)
    found = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string")).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _half(end: str, length, word="word"):
    """The half of `length` code points at that end; words are at least as long."""
    part = F.substring(word, F.lit(1), length) if end == "L" else F.substring(word, F.length(word) - length + 1, length)
    return F.struct(F.lit(end).alias("end"), part.alias("half"))


def _halves(words: DataFrame) -> DataFrame:
    """end, half, word, n: both halves of every word, the first one being the shorter."""
    size = F.length("word")
    low = F.floor(size / 2).cast("int")
    return words.select(F.explode(F.array(_half("L", low), _half("R", size - low))).alias("h"), "word", "n").select("h.*", "word", "n")


def _probes(words: DataFrame) -> DataFrame:
    """end, half, word, n: what halves of words of the same length, one less or one more would be in this word."""
    size = F.length("word")
    fit = []
    for other in (size - 1, size, size + 1):
        low = F.floor(other / 2).cast("int")
        fit += [_half("L", low), _half("R", (other - low).cast("int"))]
    return words.select(F.explode(F.array_distinct(F.array(*fit))).alias("h"), "word", "n").select("h.*", "word", "n")


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    more = len(b) - len(a)
    if more > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + 1 - more :] == b[at + 1 :]


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (shard, scan, word): a shard's halves come first, then the words to be scanned."""
    shard, machine, last = None, None, None
    for b in batches:
        out = []
        for k, scan, end, half, word, n in zip(*(b.column(c).to_pylist() for c in ("shard", "scan", "end", "half", "word", "n"))):
            if k != shard:
                shard, machine, last, ready = k, ahocorasick.Automaton(), None, False
            if not scan:
                if half not in machine:
                    machine.add_word(half, [])
                machine.get(half).append((end, len(half), word, n))
                continue
            if word == last:
                continue
            last = word
            if not ready:
                machine.make_automaton()
                ready = True
            near, best_n, best = 0, 0, None
            for at, held in machine.iter(word) if len(machine) else ():
                for side, size, other, m in held:
                    if abs(len(other) - len(word)) > 1 or (at + 1 != size if side == "L" else at + 1 != len(word)):
                        continue
                    if side == "R" and word.startswith(other[: len(other) - size]) or not one_edit(word, other):
                        continue
                    near += 1
                    if m > best_n or m == best_n and other < best:
                        best_n, best = m, other
            if near:
                out.append((word, near, best_n, best))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "near", "best_n", "best"])


_BASE = 0x9E3779B97F4A7C15 | 1  # any odd number: false meetings are compared, none is missed
SHORT = 64


def _keys(rest: str) -> list[int]:
    """64-bit hashes of a text and of it with any one character taken out; long ones in time in proportion to the length."""
    n = len(rest)
    if n <= SHORT:
        return [xxhash.xxh64_intdigest(v) - (1 << 63) for v in {rest, *(rest[:i] + rest[i + 1 :] for i in range(n))}]
    x = np.frombuffer(rest.encode("utf-32-le"), "<u4").astype(np.uint64)
    power = np.full(n + 1, _BASE, np.uint64)
    power[0] = 1
    upto = np.zeros(n + 1, np.uint64)
    np.cumsum(x * np.cumprod(power)[:-1], out=upto[1:])
    keys = upto[-1:].view(np.int64).tolist()
    if n == SHORT + 1:  # without one character it is a short text
        return keys + [xxhash.xxh64_intdigest(v) - (1 << 63) for v in {rest[:i] + rest[i + 1 :] for i in range(n)}]
    after = (upto[-1] - upto[1:]) * np.uint64(pow(_BASE, -1, 1 << 64))
    return keys + np.unique(upto[:-1] + after).view(np.int64).tolist()


def _keyed(rows: DataFrame) -> DataFrame:
    """end, half, word, n of hot halves -> the same and key, one row per key of what is beside the half."""

    def run(batches: Iterator[pa.RecordBatch], most: int = 200_000) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, keys = [], []
            for i, (end, half, word) in enumerate(zip(*(b.column(c).to_pylist() for c in ("end", "half", "word")))):
                own = _keys(word[len(half) :] if end == "L" else word[: len(word) - len(half)])
                at += [i] * len(own)
                keys += own
                if len(keys) >= most or i + 1 == b.num_rows:
                    same = b.take(pa.array(at, pa.int64()))
                    yield pa.RecordBatch.from_arrays([*same.columns, pa.array(keys, pa.int64())], names=[*b.schema.names, "key"])
                    at, keys = [], []

    return rows.mapInArrow(run, "end string, half string, word string, n long, key long")


def near_words(words: DataFrame, hot: int = 200, shard_halves: int = 50_000) -> DataFrame:
    """word, n -> word, n_near, best_n, best for words that have near ones. words must be stable: it is read several times."""
    spark = words.sparkSession
    bounded_batches(spark)
    halves, probes = _halves(words), _probes(words)
    met = halves.select("end", "half", F.lit(1).alias("held"), F.lit(0).alias("asked")).union(probes.select("end", "half", F.lit(0), F.lit(1)))
    # a word meets its own halves; a half that no other word has finds nothing
    sizes = stash(met.groupBy("end", "half").agg(F.sum("held").alias("held"), F.sum("asked").alias("asked")).where("held > 0 and asked > 1"), "halves")
    cold, warm = sizes.where(F.col("asked") <= hot).select("end", "half"), sizes.where(F.col("asked") > hot).select("end", "half")
    shards = max(shuffles(spark), -(-int(cold.count()) // shard_halves))
    shard = F.pmod(F.xxhash64("end", "half"), F.lit(shards)).alias("shard")
    held = halves.join(cold, ["end", "half"]).select(shard, F.lit(False).alias("scan"), "end", "half", "word", "n")
    scan = probes.join(cold, ["end", "half"]).select(shard, F.lit(True).alias("scan"), F.lit("").alias("end"), F.lit("").alias("half"), "word", "n")
    found = held.union(scan).repartition(shards, "shard").sortWithinPartitions("shard", "scan", "word").mapInArrow(_scanned, "word string, near long, best_n long, best string")
    a = _keyed(probes.join(warm, ["end", "half"]))
    b = _keyed(halves.join(warm, ["end", "half"])).select("end", "half", "key", F.col("word").alias("other"), F.col("n").alias("m"))
    beside = ~((F.col("end") == "R") & F.col("word").startswith(F.expr("left(other, length(other) - length(half))")))
    pairs = a.join(b, ["end", "half", "key"]).where(F.col("word") != F.col("other")).where(beside).where(F.levenshtein("word", "other", 1) == 1)
    pairs = pairs.select("word", "other", "m").distinct().select("word", F.lit(1).cast("long").alias("near"), F.col("m").alias("best_n"), F.col("other").alias("best"))
    first = F.min(F.struct((-F.col("best_n")).alias("k"), "best"))
    both = found.union(pairs).groupBy("word").agg(F.sum("near").alias("n_near"), first.alias("f"))
    return both.select("word", "n_near", (-F.col("f.k")).alias("best_n"), F.col("f.best").alias("best"))


def variants(docs: DataFrame, ratio: int = 5, least_length: int = 6, least: int = 5, every: int = 199, hot: int = 200, shard_halves: int = 50_000) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    words = stash(word_counts(docs, least_length, least, every), "words")
    near = near_words(words, hot, shard_halves)
    fits = F.col("best_n") >= ratio * F.col("n")
    forms = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best")).alias("form"), F.when(fits, F.col("best_n")).alias("form_n")
    )
    forms = stash(forms, "forms")
    # n rises `ratio` times with every step, so the longest way is short and each round halves it
    roots = forms.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        far = roots.select(F.col("word").alias("root"), F.col("root").alias("far"))
        roots = stash(roots.join(far, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        if not roots.where("moved").limit(1).count():
            break
        roots = roots.drop("moved")
    return forms.join(roots.drop("moved"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
