"""Removal of bytes covered by `length`-byte strings that also start in a document with a smaller id.

This is not the induced suffix sort that the operator is named for (see the README): sorting every suffix needs several
times the disk that is allowed for it. It finds the same bytes by sampled anchors.

1. Of the `gram`-byte strings in every window of `length` bytes the one with the least hash is an anchor, so equal
   windows have equal anchors at equal places. An anchor goes with the hash of all that its windows can cover, its
   context. Anchors are dealt by hash and sorted: an occurrence with the same context as one in a smaller document is
   covered whole. Copies that meet in one batch are settled there, so a group of copies sends one row per batch.
2. Where an anchor has several contexts, the windows that belong to it are hashed for one occurrence of each, dealt by
   hash, and all but the smallest document's are covered. Only the surroundings of differences come this far.
3. The covered ranges meet their document's text again, which gives what is left.

Hashes are 64 bits of a polynomial of the whole string; contexts are told apart by 48 bits inside one anchor's 64. Null text counts as empty. Rows with a null doc_id are left
whole and remove nothing. Rows that share a doc_id don't remove each other's bytes; repeated rows get equal answers.
Texts under `length` bytes stay whole. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import bounded_batches, slices, stash, table

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_TAG = 40  # bits of a place; above them are 20 bits of the text's hash, which tell apart rows of one doc_id
_powers: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


_BYTE = _mix(np.arange(1, 257, dtype=U) * U(_BASE))


class Text:
    """Texts laid end to end, with hashes of any of their substrings."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        self.starts = self.ends - np.array([len(t) for t in texts], np.int64)
        n = len(self.data) + 1
        if not _powers or len(_powers[0]) < n:
            m = max(n, 1 << 20)
            _powers[:] = [np.cumprod(np.concatenate([np.ones(1, U), np.full(m, b, U)]), dtype=U) for b in (_BASE, pow(_BASE, -1, 2**64))]
        self.sums = np.concatenate([np.zeros(1, U), np.cumsum(_BYTE[self.data] * _powers[0][: n - 1], dtype=U)])

    def hash(self, at: np.ndarray, to: np.ndarray) -> np.ndarray:
        return _mix((self.sums[to] - self.sums[at]) * _powers[1][at])

    def anchors(self, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash of the gram at each place; the least one in each window (0: no window starts there); anchors' places."""
        n, w = len(self.data), length - gram + 1
        if n < length:
            return np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64)
        i = n - gram + 1
        h = _mix((self.sums[gram:] - self.sums[:i]) * _powers[1][:i]) | U(1)
        least = _slide(h, w, np.minimum)  # n - length + 1 places
        for e, s in zip(self.ends.tolist(), self.starts.tolist()):
            least[max(s, e - length + 1) : e] = 0
        most = _slide(np.concatenate([np.zeros(w - 1, U), least, np.zeros(w - 1, U)]), w, np.maximum)
        return h, least, np.flatnonzero(most[: len(h)] == h)


def _slide(x: np.ndarray, w: int, f) -> np.ndarray:
    """f over every w neighbours."""
    y, k = x, 1
    while 2 * k <= w:
        y = f(y[:-k], y[k:])
        k *= 2
    return f(y[: len(x) - w + 1], y[w - k : w - k + len(x) - w + 1]) if w > k else y


def _merged(doc: np.ndarray, place: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ranges of each (doc, tag) joined where they touch; lo and hi without tag, place with it."""
    if not len(doc):
        return doc, lo, hi
    tag = place >> _TAG
    order = np.lexsort((lo, tag, doc))
    doc, tag, lo, hi = doc[order], tag[order], lo[order], hi[order]
    first = np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(tag) != 0)])
    far = hi + np.cumsum(first) * 2**41  # a running maximum that starts anew with each text
    reach = np.maximum.accumulate(far) - np.cumsum(first) * 2**41
    new = first | np.concatenate([[True], lo[1:] > reach[:-1]])
    k = np.flatnonzero(new)
    return doc[k], (tag[k] << _TAG) | lo[k], (tag[k] << _TAG) | np.maximum.reduceat(hi, k)


def _rows(kind: int, a: np.ndarray, c: np.ndarray, doc: np.ndarray, at: np.ndarray, to: np.ndarray) -> pa.RecordBatch:
    cols = [np.full(len(a), kind, np.int32), a.view(np.int64) if a.dtype == U else a, c.view(np.int64) if c.dtype == U else c, doc, at, to]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["kind", "a", "c", "doc", "at", "upto"])


_ROW = "kind int, a long, c long, doc long, at long, upto long"


def _first_of_each(a: np.ndarray, c: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted by (a, c, doc): the order, and which rows belong to the smallest document of their (a, c)."""
    order = np.lexsort((at, doc, c, a))
    a, c, doc = a[order], c[order], doc[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (c[1:] != c[:-1])])
    least = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
    return order, doc == least


def _settle(parts: list[tuple], reach: int, span: int) -> Iterator[pa.RecordBatch]:
    """Occurrences of a batch -> those that must meet others (kind 0), and ranges covered within the batch (kind 1)."""
    if not parts:
        return
    a, c, doc, at, lo, hi = (np.concatenate(x) for x in zip(*parts))
    order, head = _first_of_each(a, c, doc, at)
    k, rest = order[head], order[~head]
    # how far the context reaches on both sides goes with the row: covered ranges are cut at the text's ends
    yield _rows(0, a[k], c[k], doc[k], at[k], ((at[k] & (2**_TAG - 1)) - lo[k]) * 256 + (hi[k] - (at[k] & (2**_TAG - 1))))
    fine = rest[hi[rest] - lo[rest] >= span]
    d, x, y = _merged(doc[fine], at[fine], lo[fine], hi[fine])
    if len(d):
        yield _rows(1, _mix(d.view(U)), np.zeros(len(d), np.int64), d, x, y)


def _occurrences(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    side = length - gram
    parts, held = [], 0
    for b in batches:
        for lo, hi in slices(b, "t", 1_000_000):
            part = b.slice(lo, hi - lo)
            t = Text(part.column("t").to_pylist())
            h, _, i = t.anchors(length, gram)
            if not len(i):
                continue
            k = np.searchsorted(t.ends, i, side="right")
            s, e = t.starts[k], t.ends[k]
            left, right = np.maximum(i - side, s), np.minimum(i + gram + side, e)
            ctx = _mix(t.hash(left, right) ^ _mix(((i - left) * 1024 + (right - i)).astype(U)))
            doc, tag = part.column("doc_id").to_numpy()[k], part.column("tag").to_numpy()[k]
            parts.append((h[i], ctx >> U(16), doc, (tag << _TAG) | (i - s), left - s, right - s))
            held += len(i)
            if held > 1_500_000:
                yield from _settle(parts, side, length)
                parts, held = [], 0
    yield from _settle(parts, side, length)


def _contexts(batches: Iterator[pa.RecordBatch], span: int, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (a, c, doc) -> ranges covered (kind 1) and occurrences whose windows must be compared (kind 2)."""
    kept: list[np.ndarray] = [np.empty(0, np.int64)] * 5
    many = False  # the first anchor of `kept` is known to have several contexts

    def settle(a, c, doc, at, upto, many):
        order, head = _first_of_each(a, c, doc, at)
        place = at & (2**_TAG - 1)
        lo, hi = place - (upto >> 8), place + (upto & 255)
        rest = order[~head]
        rest = rest[hi[rest] - lo[rest] >= span]
        d, x, y = _merged(doc[rest], at[rest], lo[rest], hi[rest])
        if len(d):
            yield _rows(1, d, d, d, x, y)
        k = order[head]
        a, c = a[k], c[k]
        new = np.concatenate([[True], a[1:] != a[:-1]])
        group = np.cumsum(new) - 1
        varied = np.bincount(group, np.concatenate([[False], (c[1:] != c[:-1]) & ~new[1:]])) > 0
        varied[0] |= many
        k = k[varied[group]]
        if len(k):
            yield _rows(2, doc[k], doc[k], doc[k], at[k], at[k])

    for b in batches:
        kind = b.column("kind").to_numpy()
        if (kind == 1).any():
            yield b.filter(pa.array(kind == 1))
        b = b.filter(pa.array(kind == 0))
        if not b.num_rows:
            continue
        rows = [np.concatenate([k, b.column(n).to_numpy()]) for k, n in zip(kept, ("a", "c", "doc", "at", "upto"))]
        whole = int(np.searchsorted(rows[0], rows[0][-1]))  # the last anchor may go on
        if not whole and len(rows[0]) > most:  # an anchor with very many contexts: those that are over go on their way
            whole = int(np.searchsorted(rows[1], rows[1][-1]))
            if whole:
                yield from settle(*(x[:whole] for x in rows), True)
                kept, many = [x[whole:] for x in rows], True
                continue
        if whole:
            yield from settle(*(x[:whole] for x in rows), many)
            many = False
        kept = [x[whole:] for x in rows]
    if len(kept[0]):
        yield from settle(*kept, many)


def _windows(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Texts with places of anchors -> hash, document and place of the windows that belong to these."""
    for b in batches:
        for r in range(b.num_rows):
            t = Text([b.column("t")[r].as_py()])
            h, least, _ = t.anchors(length, gram)
            at = np.unique(b.column("places")[r].values.to_numpy()) & (2**_TAG - 1)
            starts = (at[:, None] - np.arange(length - gram + 1)[None, :]).ravel()
            anchor = np.repeat(at, length - gram + 1)
            ok = (starts >= 0) & (starts < len(least))
            starts, anchor = starts[ok], anchor[ok]
            starts = np.unique(starts[least[starts] == h[anchor]])
            n = len(starts)
            if n:
                w = t.hash(starts, starts + length)
                doc, tag = b.column("doc_id")[r].as_py(), b.column("tag")[r].as_py()
                yield _rows(0, w, np.zeros(n, np.int64), np.full(n, doc), starts | (tag << _TAG), np.zeros(n, np.int64))


def _later(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Windows sorted by (hash, document) -> ranges of all but the smallest document's."""
    last: tuple[int, int] | None = None
    for b in batches:
        if not b.num_rows:
            continue
        a, doc, at = (b.column(n).to_numpy() for n in ("a", "doc", "at"))
        new = np.concatenate([[last is None or a[0] != last[0]], a[1:] != a[:-1]])
        base = np.concatenate([[last[1] if last else 0], doc[new]])
        least = base[np.cumsum(new)]
        last = (int(a[-1]), int(least[-1]))
        k = np.flatnonzero(doc > least)
        place = at[k] & (2**_TAG - 1)
        d, x, y = _merged(doc[k], at[k], place, place + length)
        if len(d):
            yield _rows(1, d, d, d, x, y)


def _left(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for doc_id, t, at, to in zip(*(b.column(n).to_pylist() for n in ("doc_id", "t", "los", "his"))):
            lo, hi = (np.array(x or [], np.int64) & (2**_TAG - 1) for x in (at, to))
            _, lo, hi = _merged(np.zeros(len(lo), np.int64), np.zeros(len(lo), np.int64), lo, hi)
            cuts = [0, *np.stack([lo, hi], axis=1).ravel().tolist(), len(t)]
            left = b"".join(t[a:e] for a, e in zip(cuts[::2], cuts[1::2]))
            rows.append((doc_id, len(t), len(t) - len(left), len(lo), hashlib.sha256(left).hexdigest(), left if with_text else b""))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], x) for i, x in enumerate(types)], names=names)


def remove_repeats(docs: DataFrame, length: int = 50, gram: int = 24, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the bytes kept if asked for, of every row."""
    if not 8 <= gram < length or length - gram > 120:
        raise ValueError("8 <= gram < length <= gram + 120")
    spark = docs.sparkSession
    bounded_batches(spark)
    t = F.coalesce("text", F.lit("")).cast("binary")
    again = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count() > 0
    tag = F.pmod(F.xxhash64(t), F.lit(2**20)) if again else F.lit(0)
    rows = docs.select("doc_id", tag.cast("long").alias("tag"), t.alias("t"))
    seen = rows.where(F.col("doc_id").isNotNull() & (F.octet_length("t") >= length))
    met = seen.mapInArrow(partial(_occurrences, length=length, gram=gram), _ROW)
    marks = met.repartition("a").sortWithinPartitions("a", "c", "doc", "at").mapInArrow(partial(_contexts, span=length), _ROW)
    marks = stash(marks.select("kind", "doc", "at", "upto"), "anchors")
    tag = F.shiftright("at", _TAG)
    asked = marks.where("kind = 2").groupBy(F.col("doc").alias("doc_id"), tag.alias("tag")).agg(F.collect_list("at").alias("places"))
    windows = seen.join(asked, ["doc_id", "tag"]).mapInArrow(partial(_windows, length=length, gram=gram), _ROW)
    later = windows.repartition("a").sortWithinPartitions("a", "doc").mapInArrow(partial(_later, length=length), _ROW)
    later = stash(later.select("kind", "doc", "at", "upto"), "windows")
    ranges = marks.where("kind = 1").unionByName(later)
    per_doc = ranges.groupBy(F.col("doc").alias("doc_id"), tag.alias("tag")).agg(F.collect_list("at").alias("los"), F.collect_list("upto").alias("his"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    out = rows.join(per_doc, ["doc_id", "tag"], "left").mapInArrow(partial(_left, with_text=with_text), schema)
    return out if with_text else out.drop("kept")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
