"""Secret scan: fixed patterns, and a linear-chain conditional random field that adds spans.

Each line is a chain of tokens tagged begin, inside or outside. Features are a token's shape (length, character
classes, digit share, variety, changes of class), the words and kinds around it, and two facts of the file (whether it
names a secret, how dense its digits are). A token can be begin or inside if its shape could be a secret's (6 or more
characters with a digit, a joining sign or capitals inside) or a naming word, `=` or `:` stands up to three tokens
before it; no other token is considered, so the chain falls into the runs of such tokens, and Viterbi over each run
with its outside neighbours is exact for the whole line.

Weights come from maximum likelihood on a bounded sample: the `sample_docs` documents that are first by a hash of the
id, those of up to `max_chars` characters. Tokens of a pattern's secret count as secrets. So that the field learns more
than the patterns, runs with secrets are also shown with evidence withheld: without the words around them, and with
the secret's letters drawn anew from other alphabets (from a fixed seed). Spans that touch a pattern's span are not
repeated.

Null text counts as empty: no spans. Repeated rows are answered each; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import bounded_batches, table

ASSIGN = re.compile(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
#: Lower-case pieces of the keywords of ASSIGN.
KEYWORDS = ("passw", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "crf")
NAMES = re.compile(r"(?ai:pass|secret|token|key|auth|cred|bearer)")
TOKEN = re.compile(r"[A-Za-z0-9+/_.\-]+|[=:\"']|[^\sA-Za-z0-9+/_.\-=:\"']+")
HINT = re.compile(r"[0-9=:_+/]|[a-z][A-Z]")
ODD = re.compile(r"[0-9_+/]|[a-z][A-Z]")
#: Lower-case pieces of NAMES, and alphabets from which secrets are drawn anew.
NAME_PIECES = ("pass", "secret", "token", "key", "auth", "cred", "bearer")
ALPHABETS = ("0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each kind that do not overlap; those that fall short are dropped after matching."""
    out: list[Span] = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=_place)


def _place(s: Span) -> tuple[int, int, int]:
    return s[1], KINDS.index(s[0]), s[2]


def secrets_of(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """What is secret in the patterns' spans: an assignment's value, else the whole."""
    out = []
    for kind, a, e in base:
        m = ASSIGN.match(text, a) if kind == "assign" else None
        out.append(m.span(2) if m else (a, e))
    return sorted(out)


def _kind(token: str) -> str:
    if token in "=:\"'":
        return token
    if NAMES.search(token):
        return "name"
    return "number" if any(c.isdigit() for c in token) else "word" if token[0].isalnum() else "sign"


class _Classes(dict):
    def __missing__(self, c: int) -> str:
        return "s"


_CLASSES = _Classes({c: k for k, signs in (("d", "0123456789"), ("U", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("l", "abcdefghijklmnopqrstuvwxyz")) for c in map(ord, signs)})


def _shape(t: str) -> list[str]:
    of = t.translate(_CLASSES)
    changes = sum(map(str.__ne__, of, of[1:]))
    size = 0 if len(t) < 12 else 1 if len(t) < 20 else 2 if len(t) < 32 else 3
    classes = "".join(k for k in "Ulds" if k in of)
    digits = min(3, 4 * of.count("d") // len(of))
    return [f"size{size}", f"class{classes}", f"size{size}class{classes}", f"digits{digits}", f"variety{min(3, 4 * len(set(t)) // len(t))}", f"changes{min(4, 8 * changes // len(of))}size{size}", f"hex{all(c in '0123456789abcdef' for c in t)}"]


def _around(tokens: list[str], kinds: list[str], i: int) -> list[str]:
    out = []
    for d in (-3, -2, -1, 1, 2):
        k = i + d
        if 0 <= k < len(tokens):
            out.append(f"at{d}{kinds[k]}")
            if kinds[k] in ("word", "name") and len(tokens[k]) <= 16:
                out.append(f"word{d}{tokens[k].lower()}")
        else:
            out.append(f"at{d}none")
    return out


def _lines(text: str) -> Iterator[tuple[int, int]]:
    """Lines in which some token's shape or surroundings could be a secret's."""
    low = text.lower()
    named = any(p in low for p in NAME_PIECES)
    at = 0
    while True:
        m = HINT.search(text, at)
        n = NAMES.search(text, at) if named else None
        first = min((x.start() for x in (m, n) if x), default=None)
        if first is None:
            return
        lo, hi = text.rfind("\n", 0, first) + 1, text.find("\n", first)
        hi = len(text) if hi < 0 else hi
        yield lo, hi
        at = hi


def runs(text: str) -> Iterator[tuple[list[tuple[int, int]], list[tuple[list[str], list[str], list[str]]]]]:
    """Maximal runs of tokens that can be secret: their spans and features (of shape, surroundings, file)."""
    file = None
    for lo, hi in _lines(text):
        if file is None:
            dense = min(3, 200 * sum(map(text.count, "0123456789")) // len(text))
            file = ["bias", f"file_name{bool(NAMES.search(text))}", f"file_dense{dense}"]
        found = list(TOKEN.finditer(text, lo, hi))
        tokens = [t[0] for t in found]
        kinds = list(map(_kind, tokens))
        spans, features, near = [], [], 0
        for i, t in enumerate(tokens):
            fine = len(t) >= 6 and kinds[i] in ("number", "word", "name") and (near > 0 or ODD.search(t))
            near = 3 if kinds[i] in ("name", "=", ":") else near - 1
            if fine:
                spans.append(found[i].span())
                features.append((_shape(t), _around(tokens, kinds, i), file))
            elif spans:
                yield spans, features
                spans, features = [], []
        if spans:
            yield spans, features


class Chain:
    """Weights of the field. States: 0 outside, 1 begin, 2 inside (never after outside)."""

    def __init__(self, names: dict[str, int], emit: np.ndarray, step: np.ndarray):
        self.names, self.emit, self.step = names, emit, step

    def scores(self, features: list[list[str]]) -> np.ndarray:
        return np.stack([self.emit[[self.names[f] for f in fs if f in self.names]].sum(axis=0) for fs in features])

    def decode(self, features: list[list[str]]) -> list[int]:
        e = self.scores(features)
        if len(e) == 1:
            return [int((self.step[0] + e[0] + self.step[:, 0]).argmax())]
        best, back = self.step[0] + e[0], []
        for row in e[1:]:
            all_ = best[:, None] + self.step
            back.append(all_.argmax(axis=0))
            best = all_.max(axis=0) + row
        state = int((best + self.step[:, 0]).argmax())
        path = [state]
        for b in reversed(back):
            path.append(state := int(b[state]))
        return path[::-1]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def fit(data: list[tuple[list[list[str]], list[int], int]], rounds: int = 12, rate: float = 0.3, l2: float = 1e-3) -> Chain:
    """Maximum likelihood by adaptive gradient steps, one run of tokens (features, tags, times it occurs) at a time."""
    names = {f: i for i, f in enumerate(sorted({f for fs, _, _ in data for row in fs for f in row}))}
    emit, step = np.zeros((len(names), 3)), np.zeros((3, 3))
    step[0, 2] = -1e4
    g_emit, g_step = np.full(emit.shape, 1e-2), np.full(step.shape, 1e-2)
    rng = np.random.default_rng(7)
    coded = [([[names[f] for f in row] for row in fs], y, min(n, 5)) for fs, y, n in data]
    for _ in range(rounds):
        for k in rng.permutation(len(coded)):
            fs, y, times = coded[k]
            e = np.stack([emit[row].sum(axis=0) for row in fs])
            a, b = np.empty_like(e), np.zeros_like(e)
            a[0] = step[0] + e[0]
            for i in range(1, len(e)):
                a[i] = _log_sum(a[i - 1][:, None] + step, 0) + e[i]
            b[-1] = step[:, 0]
            for i in range(len(e) - 2, -1, -1):
                b[i] = _log_sum(step + (e[i + 1] + b[i + 1])[None, :], 1)
            z = _log_sum(a[-1] + b[-1], 0)
            miss = -np.exp(a + b - z)
            miss[np.arange(len(y)), y] += 1
            d_step = np.zeros((3, 3))
            d_step[0] += miss[0]
            d_step[:, 0] += miss[-1]
            for i in range(1, len(y)):
                d_step -= np.exp(a[i - 1][:, None] + step + (e[i] + b[i])[None, :] - z)
                d_step[y[i - 1], y[i]] += 1
            for row, d in zip(fs, miss * times):
                d = d - l2 * emit[row]
                g_emit[row] += d * d
                emit[row] += rate * d / np.sqrt(g_emit[row])
            g_step += d_step * d_step
            step += rate * d_step / np.sqrt(g_step)
            step[0, 2] = -1e4
    return Chain(names, emit, step)


class Covered:
    """Disjoint, sorted union of spans; touches() by bisection."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.lo: list[int] = []
        self.hi: list[int] = []
        for a, e in sorted(spans):
            if self.hi and a < self.hi[-1]:
                self.hi[-1] = max(self.hi[-1], e)
            else:
                self.lo.append(a)
                self.hi.append(e)

    def touches(self, a: int, e: int) -> int | None:
        k = bisect.bisect_left(self.lo, e) - 1
        return k if k >= 0 and self.hi[k] > a else None


def labels(spans: list[tuple[int, int]], secret: Covered) -> list[int]:
    out, last = [], None
    for a, e in spans:
        hit = secret.touches(a, e)
        out.append(0 if hit is None else 2 if hit == last else 1)
        last = hit
    return out


def examples(text: str, kinds: tuple[str, ...] = KINDS) -> Iterator[tuple[list[list[str]], list[int]]]:
    """Runs of a text with their tags by the patterns of these kinds; those with secrets also with evidence withheld."""
    secret = Covered(secrets_of(text, [s for s in base_spans(text) if s[0] in kinds]))
    for spans, features in runs(text):
        y = labels(spans, secret)
        yield [sum(f, []) for f in features], y
        if any(y):
            yield [shape + file for shape, _, file in features], y
            rng = np.random.default_rng(zlib.crc32(text[spans[0][0] : spans[-1][1]].encode("utf-8", "surrogatepass")))
            letters = rng.choice(list(ALPHABETS[int(rng.integers(len(ALPHABETS)))]), 64)
            drawn = lambda n: _shape("".join(rng.choice(letters, min(max(n, 16), 64))))
            anew = [drawn(e - a) if t else shape for (shape, _, _), t, (a, e) in zip(features, y, spans)]
            yield [s + near + file for s, (_, near, file) in zip(anew, features)], y
            yield [s + file for s, (_, _, file) in zip(anew, features)], y


def all_spans(text: str, model: Chain | None) -> tuple[list[Span], list[Span]]:
    """The patterns' spans, and these with the field's."""
    base = base_spans(text)
    more: list[Span] = []
    taken = Covered([(a, e) for _, a, e in base])
    for spans, features in runs(text) if model else ():
        tags = model.decode([sum(f, []) for f in features])
        at = 0
        while at < len(tags):
            if tags[at]:
                end = at + 1
                while end < len(tags) and tags[end] == 2:
                    end += 1
                lo, hi = spans[at][0], spans[end - 1][1]
                if taken.touches(lo, hi) is None:
                    more.append(("crf", lo, hi))
                at = end
            else:
                at += 1
    return base, sorted(base + more, key=_place)


def train(docs: DataFrame, sample_docs: int = 4000, max_chars: int = 65536, kinds: tuple[str, ...] = KINDS) -> Chain | None:
    key = F.xxhash64(F.col("doc_id"), F.lit("secrets"))
    # a slice of the hash range holds about three times the sample, so that tasks don't each send a whole one
    part = min(1.0, 3 * sample_docs / max(1, docs.count()))
    near = docs.select("doc_id", F.xxhash64("text").alias("t")).where(F.col("doc_id").isNotNull() & (F.shiftrightunsigned(key, 33) < int(part * 2**31)))
    # of rows that share a doc_id one is taken, so that the sample is bounded
    ids = near.groupBy("doc_id").agg(F.min("t").alias("t")).orderBy(key, "doc_id").limit(sample_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = Counter(json.dumps(x) for text in b.column("text").to_pylist() for x in examples(text, kinds))
            yield pa.record_batch([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["run", "n"])

    picked = docs.where(F.length("text") <= max_chars).withColumn("t", F.xxhash64("text")).join(F.broadcast(ids), ["doc_id", "t"]).dropDuplicates(["doc_id", "t"])
    rows = picked.select("text").mapInArrow(run, "run string, n long").groupBy("run").agg(F.sum("n").alias("n")).collect()
    data = [(*json.loads(r["run"]), r["n"]) for r in sorted(rows, key=lambda r: r["run"])]
    return fit(data) if any(any(y) for _, y, _ in data) else None


def scan(docs: DataFrame, model: Chain | None) -> DataFrame:
    """doc_id and the spans, kind:start:end in code points, of the patterns and of all, of every row."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [all_spans(t or "", shared.value) for t in b.column("text").to_pylist()]
            base, every = ([[f"{k}:{a}:{e}" for k, a, e in x[i]] for x in found] for i in (0, 1))
            kind = pa.list_(pa.string())
            yield pa.record_batch([b.column("doc_id"), pa.array(base, kind), pa.array(every, kind)], names=["doc_id", "base", "every"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, base array<string>, every array<string>")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scan(docs, train(docs))
    n = [F.expr(f"cast(size(filter(base, x -> startswith(x, '{k}:'))) as bigint) AS n_{k}") for k in KINDS[:3]]
    return found.select("doc_id", *n, F.sha2(F.array_join("base", ",").cast("binary"), 256).alias("base_sha256"), F.array_join("every", ",").alias("spans"))
