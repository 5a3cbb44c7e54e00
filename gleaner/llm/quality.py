"""Quality classifier: interpolated modified Kneser-Ney word bigrams, trained on trusted text.

Trusted text is every document that `labels` marks as good and not toxic. Words are what white space separates, case
and signs included; a word is told by 40 bits of its hash. Bigrams are counted per language and per half of the texts
(by a hash of the text), so what is gathered grows with the trusted text. A document is scored by its language's model
of the other half, which has seen neither it nor its copies; trusted documents too, so bands come from held-out scores.

The model in the form of a table of summands: an unknown word costs log p(unknown), a known word x gives
v(x) = log p1(x) + log b(x), where b(x) is the mass that x hands down as a context, and a known bigram adds
w(x, y) = log(1 + own(x, y) / (b(x) p1(y))), own being its discounted share. The sum over a text's words and bigrams is
its log-probability under the interpolated model, and each summand can be looked up by itself.

Scoring is a sharded count join. A bigram's first word decides its shard; the most frequent words (at most `HOT`, found
in a bounded sample, which moves work and changes no result) are split by the second word. Documents meet the shards in
blocks of `BLOCK` words: per shard one row with the distinct words of the block and its texts as numbers of these. A
Bloom filter of fixed size (`FILTER_MB`) over the model's words and bigrams goes to the blocks, so that what no trusted
text holds need not be sent; a full filter sends more and changes no result. Each shard answers a block with one sum per
document, and these are added up per block.

A document is kept if its log-perplexity is at most its language's bound: the `high` quantile over the language's
trusted documents, and beyond it `slack` times the distance from their median, `short` over the root of its number of
words, as short texts scatter more, and `few` bits over the number of trusted documents: the fewer they are the less is
rejected, up to nothing where there are none. Low perplexity is no fault: copies of trusted text have it.

Null text counts as empty; a text without words has no perplexity and is rejected. Null lang is a language of its own.
Documents whose language has no trusted text in the other half can't be judged and are kept. Every row gets an answer,
equal rows the same. Null doc_ids are not trusted. Empty tables give empty results; further columns are ignored by the
query and carried by the stage.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import bounded_batches, discard, shuffles, stash, table

NO_LANG = "\x00"
BLOCK, HOT, FAN, FILTER_MB = 400_000, 64, 16, 16
#: Numbers of the start and the end of a text, which no word has.
START, END = 1, 2
U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def word_numbers(words: list[str]) -> np.ndarray:
    return (np.fromiter(map(xxhash.xxh64_intdigest, words), U, len(words)) >> U(24)) | U(4)


def pair_keys(b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of the second word 32 bits are enough, as it only has to be told from others that follow the first."""
    return _mix(_mix(b) + (c & U(2**32 - 1)))


_tools: dict = {}


def _tool(kind, **options):
    """One compressor a process: each holds megabytes."""
    if kind not in _tools:
        _tools[kind] = kind(**options)
    return _tools[kind]


def pack(*columns: tuple[np.ndarray, int]) -> bytes:
    """Columns of whole numbers as planes of bytes (width each), compressed."""
    planes = [np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :w].T).tobytes() for a, w in columns]
    return _tool(zstandard.ZstdCompressor, level=1).compress(b"".join(planes))


def unpack(data: bytes, *widths: int) -> list[np.ndarray]:
    raw = np.frombuffer(_tool(zstandard.ZstdDecompressor).decompress(data), np.uint8)
    n, at, out = len(raw) // sum(widths), 0, []
    for w in widths:
        a = np.zeros((n, 8), np.uint8)
        a[:, :w] = raw[at : at + n * w].reshape(w, n).T
        out.append(a.reshape(-1).view("<u8"))
        at += n * w
    return out


class Deal:
    """Which shard has a bigram, and which have a word."""

    def __init__(self, shards: int, hot: np.ndarray):
        self.shards, self.hot = shards, np.sort(hot)

    def is_hot(self, b: np.ndarray) -> np.ndarray:
        if not len(self.hot):
            return np.zeros(len(b), bool)
        return self.hot[np.minimum(np.searchsorted(self.hot, b), len(self.hot) - 1)] == b

    def shard(self, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        part = np.where(self.is_hot(b), c % U(FAN), U(0))
        return (_mix(b + part * U(0x9E3779B97F4A7C15)) % U(self.shards)).astype(np.int64)

    def copies(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every shard at which x can be a first word: (positions in x, shards)."""
        hot = np.flatnonzero(self.is_hot(x))
        at = np.concatenate([np.arange(len(x)), np.repeat(hot, FAN - 1)])
        part = np.concatenate([np.zeros(len(x), U), np.tile(np.arange(1, FAN, dtype=U), len(hot))])
        return at, self.shard(x[at], part)


class Block:
    """Texts gathered up to a number of words, as numbers of the block's distinct words."""

    def __init__(self):
        self.words: dict[str, int] = defaultdict(count(2).__next__)  # 0 and 1 are start and end
        self.ids: list[np.ndarray] = []
        self.size = 0

    def add(self, text: str) -> int:
        w = text.split()
        self.ids.append(np.fromiter(map(self.words.__getitem__, w), np.int32, len(w)))
        self.size += len(w) + 2
        return len(w)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the words; document, first and second word of every bigram."""
        n = np.array([len(x) for x in self.ids])
        width = n + 2
        seq = np.zeros(width.sum(), np.int32)
        ends = np.cumsum(width)
        inner = np.ones(len(seq), bool)
        inner[ends - 1] = inner[ends - width] = False
        if n.sum():
            seq[inner] = np.concatenate(self.ids)
        seq[ends - 1] = 1
        keep = np.ones(len(seq), bool)
        keep[ends - 1] = False
        last = np.roll(keep, 1)  # all but the texts' starts
        return np.concatenate([np.array([START, END], U), word_numbers(list(self.words))]), np.repeat(np.arange(len(n), dtype=np.int32), width - 1), seq[keep], seq[last]


def model_name(other: bool) -> Column:
    """lang and the half of the texts that this one is in, or the other half. Copies are in one half."""
    half = F.pmod(F.xxhash64(F.coalesce("text", F.lit("")), F.lit("half")), F.lit(2))
    return F.concat(F.coalesce("lang", F.lit(NO_LANG)), (1 - half if other else half).cast("string"))


def _group(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(keys, kind="stable")
    cut = np.flatnonzero(np.diff(keys[order])) + 1
    for part in np.split(order, cut) if len(order) else ():
        yield int(keys[part[0]]), part


def _merged(b: np.ndarray, c: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((c, b))
    b, c, n = b[order], c[order], n[order]
    new = np.flatnonzero(np.concatenate([[True], (b[1:] != b[:-1]) | (c[1:] != c[:-1])]))
    return b[new], c[new], np.add.reduceat(n, new)


_GRAMS = "shard int, m string, grams binary"


def _batch(rows: list[tuple], names: tuple[str, ...], types: tuple) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(names)
    return pa.record_batch([pa.array(list(c), t) for c, t in zip(cols, types)], names=list(names))


def _counted(batches: Iterator[pa.RecordBatch], deal: Deal) -> Iterator[pa.RecordBatch]:
    """(m, z: compressed text) -> bigram counts per shard and model."""
    blocks: dict[str, Block] = {}
    unzip = _tool(zstandard.ZstdDecompressor)

    def out(m: str, block: Block) -> pa.RecordBatch:
        words, _, b, c = block.pairs()
        pair, n = np.unique(b.astype(np.int64) * len(words) + c, return_counts=True)
        b, c = words[pair // len(words)], words[pair % len(words)]
        rows = []
        for s, k in _group(deal.shard(b, c)):
            x, y, z = _merged(b[k], c[k], n[k])
            rows.append((s, m, pack((x, 5), (y, 5), (z, 4))))
        return _batch(rows, ("shard", "m", "grams"), (pa.int32(), pa.string(), pa.binary()))

    for batch in batches:
        for m, z in zip(batch.column("m").to_pylist(), batch.column("z").to_pylist()):
            block = blocks.setdefault(m, Block())
            block.add(unzip.decompress(z).decode() if z else "")
            if sum(b.size for b in blocks.values()) >= BLOCK:
                for name in list(blocks):
                    yield out(name, blocks.pop(name))
    for name, block in blocks.items():
        yield out(name, block)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard and model -> one row for each."""
    at, held = None, []

    def out():
        b, c, n = _merged(*(np.concatenate(x) for x in zip(*held)))
        return _batch([(*at, pack((b, 5), (c, 5), (n, 4)))], ("shard", "m", "grams"), (pa.int32(), pa.string(), pa.binary()))

    for batch in batches:
        for s, m, g in zip(*(batch.column(x).to_pylist() for x in ("shard", "m", "grams"))):
            if (s, m) != at:
                if held:
                    yield out()
                at, held = (s, m), []
            held.append(unpack(g, 5, 5, 4))
            if len(held) > 64:
                held = [_merged(*(np.concatenate(x) for x in zip(*held)))]
    if held:
        yield out()


def context_counts(index: np.ndarray, n: np.ndarray, size: int) -> list[np.ndarray]:
    """Of every first word its total, and its bigrams counted once, twice, more often."""
    return [np.bincount(index, n, size).astype(np.int64), *(np.bincount(index[(n == k) if k < 3 else (n >= 3)], minlength=size) for k in (1, 2, 3))]


_ASKED = "home int, m string, shard int, grams binary"
_ASKED_NAMES, _ASKED_TYPES = ("home", "m", "shard", "grams"), (pa.int32(), pa.string(), pa.int32(), pa.binary())
#: In place of a shard: context counts of hot words and numbers of bigrams by count; figures of a home's words.
SPECIAL, FIGURES = -1, -2


def _asked(batches: Iterator[pa.RecordBatch], deal: Deal) -> Iterator[pa.RecordBatch]:
    """A shard's words and their bigrams there as second words, for the words' homes."""
    for batch in batches:
        for s, m, g in zip(*(batch.column(x).to_pylist() for x in ("shard", "m", "grams"))):
            b, c, n = unpack(g, 5, 5, 4)
            x, at = np.unique(np.concatenate([b, c]), return_inverse=True)
            cont = np.bincount(at[len(b) :], minlength=len(x))
            home = (_mix(x) % U(deal.shards)).astype(np.int64)
            rows = [(h, m, s, pack((x[k], 5), (cont[k], 5))) for h, k in _group(home)]
            hot = np.flatnonzero(deal.is_hot(x))
            few = np.array([[(n == k).sum()] for k in (1, 2, 3, 4)])
            own = np.concatenate([np.array([v[hot] for v in context_counts(at[: len(b)], n, len(x))]).reshape(4, -1), few], axis=1).astype(np.int64)
            names = np.concatenate([x[hot], np.zeros(1, U)])  # no word has number 0: the numbers of bigrams counted 1 to 4 times
            rows.append((s % deal.shards, m, SPECIAL, pack((names, 8), *((v.view(U), 8) for v in own))))
            yield _batch(rows, _ASKED_NAMES, _ASKED_TYPES)


def _answered(batches: Iterator[pa.RecordBatch], deal: Deal) -> Iterator[pa.RecordBatch]:
    """Rows sorted by home and model -> what every shard asked for, in full, and figures."""
    at, held = None, []

    def out():
        (_, m), rows = at, []
        special = [(0, m, SPECIAL, g) for s, g in held if s == SPECIAL]
        parts = [(s, *unpack(g, 5, 5)) for s, g in held if s != SPECIAL]
        if parts:
            x, inv = np.unique(np.concatenate([p[1] for p in parts]), return_inverse=True)
            cont = np.bincount(inv, np.concatenate([p[2] for p in parts])).astype(np.int64)
            lo = 0
            for s, own, _ in parts:
                rows.append((0, m, s, pack((own, 5), (cont[inv[lo : lo + len(own)]], 5))))
                lo += len(own)
            hot = x[deal.is_hot(x)]
            of, where = deal.copies(hot)  # every part of a hot word needs it, whether it occurs there or not
            have = cont[np.searchsorted(x, hot)]
            rows += [(0, m, int(s), pack((hot[i : i + 1], 5), (have[i : i + 1], 5))) for i, s in zip(of, where)]
            figures = [(cont == k).sum() for k in (1, 2, 3, 4)] + [(cont > 0).sum(), cont.sum(), (cont >= 3).sum(), cont[x == END].sum()]
            rows.append((0, m, FIGURES, np.array(figures, np.int64).tobytes()))
        return _batch(rows + special, _ASKED_NAMES, _ASKED_TYPES)

    for batch in batches:
        for h, m, s, g in zip(*(batch.column(x).to_pylist() for x in _ASKED_NAMES)):
            if (h, m) != at:
                if held:
                    yield out()
                at, held = (h, m), []
            held.append((s, g))
    if held:
        yield out()


def discounts(n: np.ndarray) -> np.ndarray:
    """D1, D2, D3+ from the numbers of entries counted 1, 2, 3 and 4 times."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] + 2 * n[1] else 0.5
    d = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.5 * k for k in (1, 2, 3)]
    return np.clip(d, 0.05, [1, 2, 3])


def constants(answers: DataFrame, deal: Deal) -> dict[str, dict]:
    """Per model: discounts of both orders, total of continuations, probability of unknown words, context counts of the
    hot words: some hundred numbers each, from a row per home and shard."""
    figures: dict[str, np.ndarray] = {}
    special: dict[tuple[str, int], np.ndarray] = {}
    for r in answers.where("shard < 0").select("m", "shard", "grams").collect():
        if r["shard"] == FIGURES:
            figures[r["m"]] = figures.get(r["m"], 0) + np.frombuffer(r["grams"], np.int64)
        else:
            x, *counts = unpack(r["grams"], 8, 8, 8, 8, 8)
            for word, v in zip(x.tolist(), np.array(counts, np.int64).T):
                special[r["m"], word] = special.get((r["m"], word), 0) + v
    out = {}
    for m, f in figures.items():
        d1 = discounts(f[:4].astype(float))
        mass = float(d1 @ [f[0], f[1], f[6]]) / f[5]
        k = out[m] = {"d1": d1, "d2": discounts(special[m, 0].astype(float)), "cont": int(f[5]), "base": mass / (int(f[4]) + 1)}
        k["end"] = float(np.log2(p1(f[7:8], k)[0]))  # the end is no first word, so no shard has it
        k["hot"] = np.array([special.get((m, int(x)), np.zeros(4, np.int64)) for x in deal.hot]).reshape(-1, 4)
    return out


def p1(cont: np.ndarray, k: dict) -> np.ndarray:
    off = np.where(cont > 0, k["d1"][np.clip(cont, 1, 3) - 1], 0)
    return (cont - off) / k["cont"] + k["base"]


def handed_down(total: np.ndarray, n1: np.ndarray, n2: np.ndarray, n3: np.ndarray, k: dict) -> np.ndarray:
    d = k["d2"]
    return np.where(total > 0, (d[0] * n1 + d[1] * n2 + d[2] * n3) / np.maximum(total, 1), 1.0)


_MODEL = "shard int, m string, kind int, grams binary"
_MODEL_TYPES = (pa.int32(), pa.string(), pa.int32(), pa.binary())


def _weights(batches: Iterator[pa.RecordBatch], known: dict[str, dict], deal: Deal, segment: int) -> Iterator[pa.RecordBatch]:
    """Words (kind 0) and bigrams (kind 1) of a shard and model -> summands, and the shard's part of the filter."""
    at, held, grams, filters = None, [], [], {}
    names = ("shard", "m", "kind", "grams")

    def mark(s, keys):
        bits = filters.setdefault(s, np.zeros(segment, bool))
        for p in filter_places(keys, segment):
            bits[p] = True

    def summands() -> Iterator[pa.RecordBatch]:
        """All rows of (s, m) are there."""
        (s, m), k = at, known[at[1]]
        x, cont = (np.concatenate(v) for v in zip(*held)) if held else (np.empty(0, U), np.empty(0, U))
        x, at_first = np.unique(x, return_index=True)
        cont = cont[at_first].astype(np.int64)
        b, c, n = (np.concatenate(v) for v in zip(*grams)) if grams else [np.empty(0, U)] * 3
        first = np.searchsorted(x, b)
        context = context_counts(first, n, len(x))
        i, is_hot = _found(deal.hot, x)
        for e, v in enumerate(context):
            v[is_hot] = k["hot"][i[is_hot], e]
        down, p = handed_down(*context, k), p1(cont, k)
        of, where = deal.copies(x)
        mine = np.unique(of[where == s])
        v = np.where(x == START, 0, np.log2(p)) + np.log2(down)
        mark(s, _mix(x[mine]))
        yield _batch([(s, m, 0, pack((np.diff(x[mine], prepend=U(0)), 5), (np.round(-v[mine] * _STEP).astype(U), 2)))], names, _MODEL_TYPES)
        if len(b):
            own = (n - k["d2"][np.minimum(n, 3).astype(int) - 1]) / context[0][first]
            w = np.log2(1 + own / (down[first] * p[np.searchsorted(x, c)]))
            key = pair_keys(b, c)
            mark(s, key)
            yield _batch([(s, m, 1, packed_pairs(key, w))], names, _MODEL_TYPES)

    for batch in batches:
        for s, m, kind, g in zip(*(batch.column(x).to_pylist() for x in ("shard", "m", "kind", "grams"))):
            if (s, m) != at:
                if at:
                    yield from summands()
                at, held, grams = (s, m), [], []
            (held if kind == 0 else grams).append(unpack(g, 5, 5) if kind == 0 else unpack(g, 5, 5, 4))
    if at:
        yield from summands()
    yield _batch([(s, None, 9, zstandard.compress(np.packbits(bits, bitorder="little").tobytes())) for s, bits in filters.items()], names, _MODEL_TYPES)


#: Bits of a bigram's key that are kept, and steps of summands: 1 / 500 bit.
_KEY, _STEP = 40, 500


def packed_pairs(key: np.ndarray, w: np.ndarray) -> bytes:
    key = key >> U(64 - _KEY)
    order = np.argsort(key)
    return pack((np.diff(key[order], prepend=U(0)), 5), (np.round(w[order] * _STEP).astype(U), 2))


def unpacked_pairs(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    key, w = unpack(data, 5, 2)
    return np.cumsum(key, dtype=U), w.astype(np.float32) / _STEP


def filter_places(keys: np.ndarray, segment: int) -> Iterator[np.ndarray]:
    for k in range(3):
        yield ((keys >> U(16 * k)) * U(0x9E3779B1) % U(segment)).astype(np.int64)


class Model:
    """Summands of log2 probabilities by shard and model, the filter, and where everything lies."""

    def __init__(self, rows: DataFrame, known: dict[str, dict], deal: Deal, segment: int):
        self.rows, self.known, self.deal, self.segment = rows, known, deal, segment


def hot_words(docs: DataFrame, sample_docs: int = 256, chars: int = 20_000) -> np.ndarray:
    """The most frequent words of some documents; only used to deal work."""
    found: Counter[str] = Counter()
    for r in docs.select(F.substring("text", 1, chars).alias("t")).where("t is not null").limit(sample_docs).collect():
        found.update(r["t"].split())
    return np.unique(np.concatenate([np.array([START], U), word_numbers([w for w, _ in found.most_common(HOT - 1)])]))


def train(docs: DataFrame, trusted: DataFrame) -> Model:
    """All docs whose doc_id is in `trusted` are counted."""
    spark = docs.sparkSession
    shards = max(8, shuffles(spark) // 3)  # few, as every block sends each its words
    deal = Deal(shards, hot_words(docs))
    segment = FILTER_MB * 2**23 // shards

    def zipped(batches):
        z = _tool(zstandard.ZstdCompressor, level=1)
        for b in batches:
            yield pa.record_batch([b.column("doc_id"), b.column("m"), pa.array([z.compress(t.encode()) if t else b"" for t in b.column("text").to_pylist()], pa.binary())], names=["doc_id", "m", "z"])

    text = docs.where("doc_id is not null").select("doc_id", model_name(False).alias("m"), F.coalesce("text", F.lit("")).alias("text"))
    rows = text.mapInArrow(zipped, "doc_id long, m string, z binary").join(trusted.hint("merge"), "doc_id", "left_semi")
    counted = rows.select("m", "z").mapInArrow(lambda it: _counted(it, deal), _GRAMS)
    grams = stash(counted.repartition(shards, "shard").sortWithinPartitions("shard", "m").mapInArrow(_summed, _GRAMS), "bigrams")
    asked = grams.mapInArrow(lambda it: _asked(it, deal), _ASKED).repartition(shards, "home").sortWithinPartitions("home", "m")
    answers = stash(asked.mapInArrow(lambda it: _answered(it, deal), _ASKED), "words")
    known = constants(answers, deal)
    both = answers.where("shard >= 0").select("shard", "m", "grams", F.lit(0).alias("kind")).unionByName(grams.withColumn("kind", F.lit(1)))
    model = stash(both.repartition(shards, "shard").sortWithinPartitions("shard", "m", "kind").mapInArrow(lambda it: _weights(it, known, deal, segment), _MODEL), "model")
    discard(grams, answers)
    return Model(model, known, deal, segment)


_SENT = "shard int, kind int, m string, block string, grams binary, bv binary, cv binary, docs binary, toks binary"
_SENT_NAMES = tuple(f.split()[0] for f in _SENT.split(", "))
_SENT_TYPES = (pa.int32(), pa.int32(), pa.string(), pa.string(), *[pa.binary()] * 5)


def _sent(batches: Iterator[pa.RecordBatch], names: list[str], bloom, deal: Deal, segment: int) -> Iterator[pa.RecordBatch]:
    """Documents -> rows of blocks for the shards (kind 3), and one (kind 4) with the block's documents."""
    number = {m: i for i, m in enumerate(names)}
    filters = {s: np.frombuffer(zstandard.decompress(z), np.uint8) for s, z in bloom.items()}
    nothing = np.zeros(segment // 8 + 1, np.uint8)
    pid, made = TaskContext.get().partitionId(), 0
    block, info = Block(), []

    def known(shard, keys):
        ok = np.zeros(len(keys), bool)
        for s, k in _group(shard):
            bits = filters.get(s, nothing)
            fine = np.ones(len(k), bool)
            for p in filter_places(keys[k], segment):
                fine &= (bits[p >> 3] >> (p & 7)) & 1 > 0
            ok[k] = fine
        return ok

    def out():
        words, doc, b, c = block.pairs()
        judged = np.array([i[3] in number for i in info])
        if not judged.all():
            keep = judged[doc]
            doc, b, c = doc[keep], b[keep], c[keep]
        pair, inv = np.unique((b.astype(np.int64) << 32) | c, return_inverse=True)
        inv = inv.astype(np.int32)
        pb, pc = words[pair >> 32], words[pair & 0xFFFFFFFF]
        at = deal.shard(pb, pc)
        fine, both, shard = known(at, _mix(pb)), known(at, pair_keys(pb, pc)), at.astype(np.int32)[inv]
        ok, c = fine[inv], np.where(both[inv], c, np.int32(-1))
        unknown = np.bincount(doc[~ok], minlength=len(info))
        del pair, pb, pc, at, inv
        doc, b, c, shard = doc[ok], b[ok], c[ok], shard[ok]
        name, rows = f"{pid}-{made}", []
        model = np.array([number.get(i[3], 0) for i in info])
        for s, k in _group(shard):
            k = k[np.lexsort((c[k], b[k], doc[k]))]
            bw, bi = np.unique(b[k], return_inverse=True)
            has = c[k] >= 0
            cw, ci = np.unique(c[k][has], return_inverse=True)
            second = np.zeros(len(k), np.int64)
            second[has] = ci + 1
            d, n = np.unique(doc[k], return_counts=True)
            rows.append((s, 3, None, name, None, pack((words[bw], 5)), pack((words[cw] & U(2**32 - 1), 4)), pack((d, 4), (model[d], 4), (n, 4)), pack((bi, 4), (second, 4))))
        ids, h, n, m = zip(*info)
        has_id = np.array([i is not None for i in ids])
        heads = np.array([i or 0 for i in ids], np.int64).view(U)
        docs = pack((heads, 8), (has_id, 1), (np.array(h, np.int64).view(U), 8), (np.array(n), 8), (judged, 1), (unknown, 8))
        rows.append((int(pid + made) % deal.shards, 4, None, name, None, None, None, docs, "\x01".join(m).encode()))
        return _batch(rows, _SENT_NAMES, _SENT_TYPES)

    for batch in batches:
        for doc_id, h, m, text in zip(*(batch.column(x).to_pylist() for x in ("doc_id", "h", "m", "text"))):
            info.append((doc_id, h, block.add(text), m))
            if block.size >= BLOCK or len(info) >= 50_000:
                yield out()
                made, block, info = made + 1, Block(), []
    if info:
        yield out()


_SUMS = "block string, kind int, docs binary, toks binary"
_SUM_TYPES = (pa.string(), pa.int32(), pa.binary(), pa.binary())


def _found(keys: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(want), np.int64), np.zeros(len(want), bool)
    i = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    return i, keys[i] == want


def _scored(batches: Iterator[pa.RecordBatch], names: list[str], known: dict[str, dict]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard and kind: the shard's model, then blocks -> a sum per document of each block."""
    at, word, gram = None, {}, {}
    for batch in batches:
        rows = []
        for s, kind, m, block, grams, bv, cv, docs, toks in zip(*(batch.column(x).to_pylist() for x in _SENT_NAMES)):
            if s != at:
                at, word, gram = s, {}, {}
            if kind == 0:
                x, v = unpack(grams, 5, 2)
                word[m] = (np.cumsum(x, dtype=U), v.astype(np.float32) / -_STEP)
            elif kind == 1:
                gram[m] = unpacked_pairs(grams)
            elif kind == 4:
                rows.append((block, 0, docs, toks))
            else:
                bv, cv = unpack(bv, 5)[0], unpack(cv, 4)[0]
                d, model, n = (x.astype(np.int64) for x in unpack(docs, 4, 4, 4))
                b, c = (x.astype(np.int64) for x in unpack(toks, 4, 4))
                bits, mine = np.zeros(len(b)), np.repeat(model, n)
                for i in np.unique(model).tolist():
                    k = np.flatnonzero(mine == i) if len(model) > 1 else np.arange(len(b))
                    x, v = word.get(names[i], (np.empty(0, U), np.empty(0, np.float32)))
                    j, ok = _found(x, bv)
                    each = np.where(ok, v[j] if len(v) else 0.0, np.log2(known[names[i]]["base"]))
                    got = each[b[k]]
                    two = k[c[k] > 0]
                    if len(two) and names[i] in gram:
                        keys, w = gram[names[i]]
                        pair, inv = np.unique((b[two] << 32) | c[two], return_inverse=True)
                        j, ok = _found(keys, pair_keys(bv[pair >> 32], cv[(pair & 0xFFFFFFFF) - 1]) >> U(64 - _KEY))
                        add = np.zeros(len(b))
                        add[two] = np.where(ok, w[j], 0.0)[inv]
                        got = got + add[k]
                    bits[k] = got
                ends = np.cumsum(n)
                total = np.concatenate([[0.0], np.cumsum(bits)])
                sums = total[ends] - total[ends - n]
                rows.append((block, 1, pack((d, 4)), sums.astype(np.float64).tobytes()))
        if rows:
            yield _batch(rows, ("block", "kind", "docs", "toks"), _SUM_TYPES)


def _added(batches: Iterator[pa.RecordBatch], known: dict[str, dict]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block and kind: the documents, then the shards' sums."""
    held = None

    def out():
        (ids, has, h, n, judged, unknown), names, total = held
        each = {m: (np.log2(k["base"]), k["end"]) for m, k in known.items()}
        oov, end = np.array([each.get(m, (0.0, 0.0)) for m in names]).T
        bits = -(total + unknown.astype(np.int64) * oov + end)
        cols = [
            pa.array(ids.view(np.int64), mask=has == 0), pa.array(h.view(np.int64)), pa.array([m[:-1] for m in names], pa.string()), pa.array(n.astype(np.int64)),
            pa.array(bits, mask=judged == 0),
        ]
        return pa.record_batch(cols, names=["doc_id", "h", "lang", "n", "bits"])

    for batch in batches:
        for _, kind, docs, toks in zip(*(batch.column(x).to_pylist() for x in ("block", "kind", "docs", "toks"))):
            if kind == 0:
                if held:
                    yield out()
                cols = unpack(docs, 8, 1, 8, 8, 1, 8)
                held = (cols, toks.decode().split("\x01"), np.zeros(len(cols[0])))
            else:
                held[2][unpack(docs, 4)[0].astype(np.int64)] += np.frombuffer(toks, np.float64)
    if held:
        yield out()


def perplexities(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, h (hash of the text), lang, n (words) and bits (of the words and the end; null without a model) of every row.

    The halves of the texts, which have different models, are scored one after the other and written, so that one half's
    shuffle files are gone before the other's are there.
    """
    spark = docs.sparkSession
    deal, segment = model.deal, model.segment
    bloom = spark.sparkContext.broadcast({r["shard"]: bytes(r["grams"]) for r in model.rows.where("kind = 9").collect()})  # FILTER_MB at most
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("h"), model_name(True).alias("m"), text.alias("text"))

    def scored(half: str) -> DataFrame:
        known = {m: k for m, k in model.known.items() if m.endswith(half)}
        names = sorted(known)
        sent = rows.where(F.col("m").endswith(half)).mapInArrow(lambda it: _sent(it, names, bloom.value, deal, segment), _SENT)
        shards = model.rows.where(F.col("m").endswith(half)).select("shard", "kind", "m", "grams")
        both = sent.unionByName(shards, allowMissingColumns=True)
        sums = both.repartition(deal.shards, "shard").sortWithinPartitions("shard", "kind").mapInArrow(lambda it: _scored(it, names, known), _SUMS)
        added = sums.repartition("block").sortWithinPartitions("block", "kind")
        return stash(added.mapInArrow(lambda it: _added(it, known), "doc_id long, h long, lang string, n long, bits double"), "perplexity")

    return scored("0").union(scored("1"))


def classify(docs: DataFrame, labels: DataFrame, high: float = 0.99, slack: float = 0.2, short: float = 4.0, few: float = 8.0) -> DataFrame:
    """doc_id, h, lang, perplexity, highest, kept, n of every row of docs."""
    bounded_batches(docs.sparkSession)
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()
    model = train(docs, good)
    scored = perplexities(docs, model).withColumn("x", F.when(F.col("n") > 0, F.col("bits") / (F.col("n") + 1)))
    discard(model.rows)
    bands = stash(
        scored.join(good, "doc_id", "left_semi").groupBy("lang").agg(F.percentile_approx("x", [0.5, high], 10000).alias("q"), F.count("x").alias("texts")).where("texts > 0").select("lang", "texts", F.col("q")[0].alias("mid"), F.col("q")[1].alias("hi")),
        "bands",
    )
    wide = F.lit(slack) * (F.col("hi") - F.col("mid")) + short / F.sqrt(F.greatest("n", F.lit(1))) + few / F.col("texts")
    return (
        scored.join(bands, "lang", "left")
        .withColumn("kept", F.coalesce((F.col("n") > 0) & F.coalesce(F.col("x") <= F.col("hi") + wide, F.lit(True)), F.lit(False)))
        .select("doc_id", "h", F.nullif("lang", F.lit(NO_LANG)).alias("lang"), F.pow(F.lit(2.0), "x").alias("perplexity"), F.pow(F.lit(2.0), F.col("hi") + wide).alias("highest"), "kept", "n")
    )


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("h", "n")


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier rejects go; rows are told apart by doc_id, lang and text, and columns carried as they are."""
    gone = classify(docs, table(spark, sf_dir, "labels")).where("not kept").select("doc_id", "lang", "h").distinct()
    gone = gone.select(F.struct(F.col("doc_id").alias("a"), F.col("lang").alias("b"), F.col("h").alias("c")).alias("_gone"))
    key = F.struct(F.col("doc_id").alias("a"), F.col("lang").alias("b"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("c"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), key.alias("_key"))
    return rows.join(gone, F.col("_key").eqNullSafe(F.col("_gone")), "left_anti").select("_row.*")
