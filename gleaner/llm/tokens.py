"""Token counts of whole texts: the pieces of each distinct pre-token are counted once.

A vocabulary of byte-level merges never joins two pre-tokens, so a text's count is the sum of its pre-tokens' piece
counts. Texts are read in blocks of about `block_bytes`. A block keeps its distinct pre-tokens, in the order of a 32-bit
hash, and per document which of them it has and how often; both are written to the shared folder. Pre-tokens go by range
of the hash to shards, whose number grows with what was found (`shard_bytes` each); a shard counts the pieces of each of
its pre-tokens once and answers every block with a packed list of counts. A block sends a pre-token at most once and to
one shard, so words that every document has weigh no more than others. Counts meet the frequencies again by block. Ids
are never made.

The counts are those of the `tokenizers` library for the file. Its special strings, of which it knows `content` alone
(no stripping, no normalising: ValueError for others), are one token each, and texts are cut at them first. Pre-tokens
are found by the library's pattern in the `regex` module, three times as fast. Code points that are letters or numbers
only in a newer Unicode than Python's own might be none to the library: texts that hold one go through the library's own
splitter. A test compares all code points.

Null text counts as empty: 0 bytes, 0 tokens. Repeated rows are counted each, rows of null doc_id too. Empty tables give
an empty result; further columns are ignored. A document longer than a block is a block of its own.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import bounded_batches, shuffles, stash, table

BLOCKS = "block long, sizes binary, letters binary, word_bytes long, doc_id array<long>, n_bytes array<long>, special array<long>, n_words array<int>, gaps binary, times binary"
_zstd = pa.Codec("zstd", compression_level=1)


class Vocabulary:
    """A file of the tokenizers library with byte-level pre-tokens; one per worker process, by `vocabulary()`."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens", [])
        plain = all(not any(t.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized")) for t in added)
        if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or spec.get("normalizer") or not plain:
            raise ValueError(f"{path}: only byte-level pre-tokens without prefix space, normalizer or stripping added tokens are known")
        library = Tokenizer.from_file(path)
        self.model, self.splitter = library.model, library.pre_tokenizer
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        # the alphabet of such vocabularies: printable bytes stand for themselves, the others follow from U+0100 on
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(shown)]
        self.alphabet = {b: 0x100 + i for i, b in enumerate(rest)}
        every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
        self.newer = {c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn"}
        self.beyond = re.compile(f"[{min(self.newer, default=chr(0x10FFFF))}-\U0010ffff]")

    def _found(self, text: str) -> list[str]:
        if text.isascii() or not self.beyond.search(text) or self.newer.isdisjoint(text):
            return self.pattern.findall(text)
        return [text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text)]

    def pre_tokens(self, text: str) -> tuple[Counter, int]:
        """Frequencies of the pre-tokens, and the number of special strings."""
        if self.special is None or not self.special.search(text):
            return Counter(self._found(text)), 0
        parts = self.special.split(text)
        found: Counter = Counter()
        for p in parts:
            found.update(self._found(p))
        return found, len(parts) - 1

    def pieces(self, pre_token: bytes) -> int:
        return len(self.model.tokenize(pre_token.decode("latin-1").translate(self.alphabet)))


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str | None = None) -> Vocabulary:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


class _Block:
    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.rows: list[tuple] = []
        self.at: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.bytes = 0

    def add(self, doc_id: int | None, text: str, vocab: Vocabulary) -> None:
        found, special = vocab.pre_tokens(text)
        known = self.known
        self.at.append(np.fromiter((known.setdefault(w, len(known)) for w in found), np.int64, len(found)))
        self.times.append(np.fromiter(found.values(), np.int64, len(found)))
        n = len(text.encode())
        self.rows.append((doc_id, n, special, len(found)))
        self.bytes += n

    def out(self, number: int) -> pa.RecordBatch:
        words = [w.encode() for w in self.known]
        hashes = np.fromiter(map(zlib.crc32, words), np.int64, len(words))
        order = np.argsort(hashes, kind="stable")
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        doc_ids, n_bytes, special, lens = (list(c) for c in zip(*self.rows))
        owner = np.repeat(np.arange(len(lens)), lens)
        key = owner << 32 | place[np.concatenate(self.at)]
        by = np.argsort(key)
        at = key[by] & 0xFFFFFFFF
        gaps = np.diff(at, prepend=0)  # within a document places rise, so gaps are short
        times = np.concatenate(self.times)[by]
        words = [words[i] for i in order]
        values = [[number], [_packed(np.fromiter(map(len, words), np.int64, len(words)))], [_small(b"".join(words))], [sum(map(len, words))], [doc_ids], [n_bytes], [special], [lens], [_packed(gaps)], [_packed(times)]]
        types = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), *[pa.list_(pa.int64())] * 3, pa.list_(pa.int32()), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], names=["block", "sizes", "letters", "word_bytes", "doc_id", "n_bytes", "special", "n_words", "gaps", "times"])


def _small(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + (_zstd.compress(raw, asbytes=True) if raw else b"")


def _large(x: bytes) -> bytes:
    n = int.from_bytes(x[:8], "little")
    return _zstd.decompress(x[8:], n, asbytes=True) if n else b""


def _packed(x: np.ndarray) -> bytes:
    return _small(x.astype("<i4").tobytes())


def _unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(_large(x), "<i4").astype(np.int64)


def _words(sizes: bytes, letters: bytes) -> list[bytes]:
    raw, ends = _large(letters), np.cumsum(_unpacked(sizes)).tolist()
    return [raw[a:b] for a, b in zip([0, *ends], ends)]


def frequencies(docs: DataFrame, path: str | None = None, block_bytes: int = 8_000_000) -> DataFrame:
    """BLOCKS: distinct pre-tokens of a block of documents and each document's frequencies of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, block, number = vocabulary(path), _Block(), TaskContext.get().partitionId() << 33
        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(1)):
                block.add(doc_id.as_py(), text.as_py() or "", vocab)
                if block.bytes >= block_bytes:
                    yield block.out(number)
                    block, number = _Block(), number + 1
        if block.rows:
            yield block.out(number)

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, BLOCKS)


def _dealt(shards: int):
    """(block, sizes, letters) -> one row per shard that has words of the block: they are neighbours in the block's list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, sizes, letters in zip(*(c.to_pylist() for c in b.columns)):
                words = _words(sizes, letters)
                shard = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) * shards >> 32
                starts = np.flatnonzero(np.diff(shard, prepend=-1)).tolist()
                parts = [words[i:j] for i, j in zip(starts, [*starts[1:], len(words)])]
                packed = [[_packed(np.fromiter(map(len, p), np.int64, len(p))) for p in parts], [_small(b"".join(p)) for p in parts]]
                values = [[block] * len(starts), shard[starts], starts, *packed]
                types = (*[pa.int64()] * 3, pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], names=["block", "shard", "start", "sizes", "letters"])

    return run


def _counted(path: str | None):
    """Rows sorted by shard: pieces of each pre-token once per shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, pieces, last = vocabulary(path), {}, None
        for b in batches:
            packed = []
            for shard, sizes, letters in zip(*(b.column(c).to_pylist() for c in ("shard", "sizes", "letters"))):
                if shard != last:
                    pieces, last = {}, shard
                words = _words(sizes, letters)
                for w in words:
                    if w not in pieces:
                        pieces[w] = vocab.pieces(w)
                packed.append(_packed(np.fromiter((pieces[w] for w in words), np.int64, len(words))))
            yield pa.RecordBatch.from_arrays([b.column("block"), b.column("start"), pa.array(packed, pa.binary())], names=["block", "start", "pieces"])

    return run


def _summed(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                lens = np.array(r["n_words"], np.int64)
                pieces = np.concatenate([_unpacked(p["pieces"]) for p in sorted(r["answers"] or [], key=lambda p: p["start"])] or [np.zeros(0, np.int64)])
                ends = np.cumsum(lens)
                gaps = _unpacked(r["gaps"])
                total = np.concatenate([[0], np.cumsum(pieces[np.cumsum(gaps)] * _unpacked(r["times"]))])
                n = total[ends] - total[ends - lens] + np.array(r["special"], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["doc_id"], pa.int64()), pa.array(r["n_bytes"], pa.int64()), pa.array(n), pa.array(n > limit)],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return run


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 1024, block_bytes: int = 8_000_000, shard_bytes: int = 4_000_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row."""
    blocks = stash(frequencies(docs, path, block_bytes), "pretokens")
    spark = docs.sparkSession
    found = blocks.agg(F.sum("word_bytes")).first()[0] or 0
    shards = max(shuffles(spark), -(-found // shard_bytes))
    sent = blocks.select("block", "sizes", "letters").mapInArrow(_dealt(shards), "block long, shard long, start long, sizes binary, letters binary")
    sent = sent.repartition(shards, "shard").sortWithinPartitions("shard")
    answers = sent.mapInArrow(_counted(path), "block long, start long, pieces binary")
    answers = answers.groupBy("block").agg(F.collect_list(F.struct("start", "pieces")).alias("answers"))
    met = blocks.drop("sizes", "letters", "word_bytes").join(answers, "block", "left")
    return met.mapInArrow(_summed(limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
