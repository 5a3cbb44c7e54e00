"""Each operator against brute force on small tables with nulls, empty and very long texts, ties, copies, clashing columns."""

import hashlib
import json
import re
import struct
import zlib
from itertools import combinations

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gleaner.llm import exact_dedup, langid, licenses, mixing, packing, quality, secrets, simhash, substrings, topk

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in that was with this from by on at are not all one for some more".split()


def prose(n, seed):
    r = np.random.default_rng(seed)
    return " ".join(r.choice(WORDS, n))


def texts():
    long = prose(9000, 1)
    return [
        None, "", " \t\n", "one", "two words", long, long + " end", long, prose(40, 2), prose(40, 2), prose(60, 3), prose(60, 3).replace("the", "The", 1),
        "password=abcdef123456 and token: xyz; AKIA" + "A1" * 9 + " " + "0af9" * 7, "password: token: abcdefgh", "ſecret=abcdefgh", "été 漢字 " + prose(30, 4), "!!! ??? 123",
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "fr", None][i % 3], [None, "b", "a", "é"][i % 4], 0) for i, t in enumerate(texts())]
    rows += [rows[8], (None, "null id " + prose(20, 5), "en", "a", 0)]
    df = spark.createDataFrame(rows, DOCS)
    for extra in ("component_id", "size", "run", "h", "key", "score", "length", "tag", "kept", "_text"):
        df = df.withColumn(extra, F.lit(1))
    return df


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# ------------------------------------------------------------------ 1
def base(text):
    out = []
    for kind, pat in (("assign", r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), ("access", r"AKIA[A-Z0-9]+"), ("hex", r"[0-9a-f]+")):
        for m in re.finditer(pat, text):
            if kind == "assign" and len(m[2]) >= 6 or kind == "access" and len(m[0]) >= 20 or kind == "hex" and len(m[0]) >= 24:
                out.append((m.start(), ("assign", "access", "hex").index(kind), m.end(), kind))
    return [f"{k}:{a}:{e}" for a, _, e, k in sorted(out)]


def test_secrets(spark, docs, none):
    model = secrets.train(docs)
    got = secrets.scan(docs, model).collect()
    assert len(got) == docs.count()
    by = dict(pairs(docs))
    for r in got:
        assert r.base == base(by[r.doc_id] or "") and set(r.base) <= set(r.every)
    assert secrets.scan(none, secrets.train(none)).count() == 0


def drawn(rng, letters, n):
    return "".join(rng.choice(list(letters), n))


def test_field_finds_a_kind_it_was_not_shown():
    """Trained on assignments and hex strings, the field tags access keys and bearer tokens in held-out lines."""
    rng = np.random.default_rng(1)
    hexed, upper, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    plain = lambda i: f"{prose(8, i)} on 2024-01-{i % 28 + 1:02d} chapter {1000 + i} of item_{i} at https://example.org/a{i} tel 0612345678 {rng.integers(10**15)} src/lib/mod_{i}.py"
    data = []
    for i in range(240):
        t = plain(i) + "\n" + (f"{prose(3, i)} api_key = \"{drawn(rng, mixed, 30)}\" {prose(3, i)}" if i % 2 else f"{prose(4, i)} {drawn(rng, hexed, 40)} {prose(2, i)}")
        data += [(f, y, 1) for f, y in secrets.examples(t, ("assign", "hex"))]
    model = secrets.fit(data)
    hits = wrong = 0
    for i in range(1000, 1100):
        lead, value = ("use ", "AKIA" + drawn(rng, upper, 16)) if i % 2 else ("authorization: Bearer ", drawn(rng, mixed, 32))
        text = plain(i) + "\n" + prose(3, i) + " " + lead + value + " " + prose(3, i)
        model_only = []
        for spans, features in secrets.runs(text):
            tags = model.decode([sum(f, []) for f in features])
            model_only += [s for s, t in zip(spans, tags) if t]
        at = text.index(value)
        hits += (at, at + len(value)) in model_only
        wrong += sum(s != (at, at + len(value)) for s in model_only)
        patterns, every = secrets.all_spans(text, model)
        assert set(patterns) <= set(every) and (i % 2 or any(k == "crf" for k, _, _ in every) or (at, at + len(value)) not in model_only)
    assert hits >= 90 and hits / (hits + wrong) >= 0.9, (hits, wrong)


def test_op1_query_by_brute_force(spark, docs, small, tmp_path):
    docs.select("doc_id", "text", "lang", "source", "n_chars").union(small.select("doc_id", "text", "lang", "source", "n_chars")).write.parquet(str(tmp_path / "documents.parquet"))
    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for i, t in pairs(df):
        b = base(t or "")
        want.append((str(i), *(sum(x.startswith(k + ":") for x in b) for k in ("assign", "access", "hex")), hashlib.sha256(",".join(b).encode()).hexdigest()))
    got = secrets.op1_secret_scan(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == sorted(want)
    for r in got:
        spans = r.spans.split(",") if r.spans else []
        assert spans == sorted(spans, key=lambda s: (int(s.split(":")[1]), secrets.KINDS.index(s.split(":")[0])))
        assert hashlib.sha256(",".join(s for s in spans if not s.startswith("crf")).encode()).hexdigest() == r.base_sha256


def test_many_spans_take_linear_time():
    import time

    text = "password=abcdef12 " * 60_000
    t = time.time()
    base_, every = secrets.all_spans(text, None)
    secrets.labels([(a, e) for _, a, e in base_], secrets.Covered(secrets.secrets_of(text, base_)))
    assert len(base_) == 60_000 and time.time() - t < 20


def test_viterbi_is_exact():
    rng = np.random.default_rng(3)
    names = {str(i): i for i in range(5)}
    step = rng.normal(size=(3, 3))
    step[0, 2] = -1e4
    chain = secrets.Chain(names, rng.normal(size=(5, 3)) * 2, step)
    for n in range(1, 6):
        f = [[str(x) for x in rng.choice(5, 2)] for _ in range(n)]
        e = chain.scores(f)
        total = lambda y: step[0, y[0]] + sum(e[i, s] for i, s in enumerate(y)) + sum(step[a, b] for a, b in zip(y, y[1:])) + step[y[-1], 0]
        best = max(np.ndindex(*[3] * n), key=total)
        assert tuple(chain.decode(f)) == best


# ------------------------------------------------------------------ 2
def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_triples_cover_every_four():
    t = simhash.triples()
    assert len(t) == 20 and all(any(set(x) <= set(f) for x in t) for f in combinations(range(8), 4))


@pytest.mark.parametrize("which", ["docs", "small"])
def test_simhash(request, which):
    df = request.getfixturevalue(which)
    rows = pairs(df)
    got = [(r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(df).collect()]
    fp = [plain_fingerprint(t) for _, t in rows]
    assert sorted((str(i), f) for (i, _), f in zip(rows, fp)) == sorted((str(i), f) for i, f, _ in got)
    label = list(range(len(rows)))
    for _ in range(len(rows)):
        new = [min(label[j] for j in range(len(rows)) if (fp[i] ^ fp[j]).bit_count() <= 4) for i in range(len(rows))]
        if new == label:
            break
        label = new
    least = {}
    for (i, _), k in zip(rows, label):
        if i is not None:
            least[k] = min(i, least.get(k, i))
    assert sorted((str(i), str(least.get(k))) for (i, _), k in zip(rows, label)) == sorted((str(i), str(c)) for i, _, c in got)


def test_long_posting_lists_lose_no_link(spark):
    rng = np.random.default_rng(5)
    centre = int(rng.integers(2**62))
    fps = {centre} | {centre ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 5)), replace=False)) for _ in range(400)}
    rows = [(f - 2**64 if f >= 2**63 else f, i) for i, f in enumerate(sorted(fps))]
    nodes = spark.createDataFrame(rows, "fp long, node long")
    for block in (16, 4096):
        parts = simhash.connected_components(simhash.near_links(nodes, block=block))
        assert parts.count() == len(rows) and parts.select("component").distinct().count() == 1


def test_rows_without_id_link_others(spark, monkeypatch):
    rows = [(1, "a", 0), (2, "b", 0xFF), (None, "c", 0x0F), (None, "d", 0xFFFF << 30), (5, "e", 0), (5, "f", 1 << 63)]
    table = spark.createDataFrame([(i, f if f < 2**63 else f - 2**64) for i, _, f in rows], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, width: table)
    got = simhash.near_duplicates(table).collect()
    assert sorted((str(r.doc_id), r.fp % 2**64, str(r.component_id)) for r in got) == sorted((str(i), f, "None" if f == 0xFFFF << 30 else "1") for i, _, f in rows)


def test_op2_and_op4_queries_by_brute_force(spark, docs, small, tmp_path):
    """The registered queries over a folder of tables: every column against a plain version."""
    from tokenizers import Tokenizer
    import public_tokenizers as P

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    docs.select("doc_id", "text", "lang", "source", "n_chars").union(small.limit(60).select("doc_id", "text", "lang", "source", "n_chars")).write.parquet(str(tmp_path / "documents.parquet"))
    rows = pairs(spark.read.parquet(str(tmp_path / "documents.parquet")))
    got = simhash.op2_simhash_near_dedup(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.fingerprint) for r in got) == sorted((str(i), f"{plain_fingerprint(t):016x}") for i, t in rows)
    packed = packing.op4_best_fit_packing(spark, str(tmp_path)).collect()
    want = []
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        want += [(str(i), k, a, e - a, zlib.crc32(struct.pack(f"<{e - a}I", *ids[a:e]))) for k, (a, e) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in packed) == sorted(want)
    bins = {}
    for r in packed:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        ends = [0]
        for at, n in sorted(b):
            assert at == ends[-1]
            ends.append(at + n)
        assert ends[-1] <= 2048
    assert len(bins) <= 1.05 * sum(x[3] for x in want) / 2048 + 2


def test_simhash_of_nothing(none):
    assert simhash.near_duplicates(none).count() == 0


# ------------------------------------------------------------------ 3
def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=4)], 0) for i in range(60)] + [(200, None, 0), (300, [1.0, None, 1.0, 1.0], 0), (400, [float("nan")] * 4, 0), (500, [float("inf")] * 4, 0)]
    rows += [(70 + i, rows[0][1], 0) for i in range(15)] + [(600, [1.0, 2.0], 0)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = sorted(tuple(r) for r in topk.top_k(e, e.where("vec_id % 10 = 0"), row_block=16, query_block=3).collect())
    ok = {i: [int(np.floor(1024 * x)) for x in v] for i, v, _ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in (i for i in ok if i % 10 == 0):
        s = sorted((-sum(a * b for a, b in zip(ok[q], v)), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))[:10]
        want += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s)]
    assert got == sorted(want)
    assert topk.top_k(e.limit(0), e.limit(0)).count() == 0


def test_lists_are_read_in_part_where_vectors_have_structure():
    rng = np.random.default_rng(6)
    n, d, k = 6000, 32, 10
    ids = np.arange(n)
    for decay, least in ((0.5, 25), (1.0, 0)):
        x = np.floor(1024 * rng.standard_t(3, (n, d)) * decay ** np.arange(d)).astype(np.int64)
        q, own = x[:50], ids[:50]
        got, early = topk.nra(x, ids, q, own, k)
        assert early >= least
        for j, (at, score) in enumerate(got):
            s = x @ q[j]
            s[j] = -(2**62)
            best = np.lexsort((ids, -s))[:k]
            assert at.tolist() == best.tolist() and score.tolist() == s[best].tolist()


def test_scores_beyond_64_bits_are_an_error(spark):
    e = spark.createDataFrame([(100, [1e17, 1.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(e, e.where("vec_id = 100")).collect()


# ------------------------------------------------------------------ 4
def test_ids_are_those_of_the_other_library(small, docs):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t, enc = Tokenizer.from_file(P.path("byte_bpe_50k.json")), packing.encoding()
    runs = ["a" + " " * 1_000_000 + "b", "\n" * 1_000_000, "x " + "1" * 1_000_000, "ab" * 500_000, "-" * 1_000_000, " \t" * 40_000]
    for _, text in pairs(small)[:60] + pairs(docs) + [(0, "a<|endoftext|>b <|endoftext|>")] + [(0, r) for r in runs]:
        assert [*t.encode(text or "", add_special_tokens=False).ids, 0] == packing.token_ids(enc, text or "").tolist()


def test_packing(docs, none):
    rows = packing.pack(packing.stash(packing.pieces(docs, 64)), 64, bucket_rows=2).collect()
    enc, by_doc, by_seq = packing.encoding(), {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == {i for i, _ in pairs(docs)}
    for i, text in pairs(docs):
        ids = packing.token_ids(enc, text or "")
        own = sorted({tuple(r)[1:5] for r in by_doc[i]})
        at = 0
        for k, (piece, start, length, crc) in enumerate(own):
            assert (piece, start) == (k, at) and crc == zlib.crc32(struct.pack(f"<{length}I", *ids[at : at + length].tolist()))
            assert length == 64 or k == 0
            at += length
        assert at == len(ids)
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert packing.pack(packing.pieces(none)).count() == 0


def test_plan_is_tight():
    rng = np.random.default_rng(4)
    for k in range(6):
        counts = {int(s): int(n) for s, n in zip(rng.choice(np.arange(1, 101), 30, replace=False), rng.integers(1, 500, 30))}
        steps = packing.plan(counts, 100)
        fill = {}
        for size, lo, hi, first, bins, off in steps:
            for r in range(hi - lo):
                b = first + r % bins
                assert fill.get(b, 0) == off + r // bins * size
                fill[b] = fill.get(b, 0) + size
        assert max(fill.values()) <= 100
        assert {s: sum(h - a for z, a, h, *_ in steps if z == s) for s in counts} == counts
        gaps = [0] * 101  # best fit decreasing, item by item
        for s in sorted(counts, reverse=True):
            for _ in range(counts[s]):
                g = next((g for g in range(s, 100) if gaps[g]), 100)
                gaps[g] -= g < 100
                gaps[g - s] += 1
        assert len(fill) <= 1.01 * sum(gaps) + 1


# ------------------------------------------------------------------ 5
def plain_kneser_ney(texts_):
    """log2 P(second | first) of an interpolated modified Kneser-Ney bigram model, from dictionaries."""
    from collections import Counter

    bi = Counter()
    for t in texts_:
        w = ["<s>", *t.split(), "</s>"]
        bi.update(zip(w, w[1:]))
    cont = Counter(c for _, c in bi)
    few = lambda n: [sum(v == k for v in n.values()) for k in (1, 2, 3, 4)]
    d1, d2 = quality.discounts(np.array(few(cont), float)), quality.discounts(np.array(few(bi), float))
    off = lambda d, n: d[min(n, 3) - 1]
    base = sum(off(d1, n) for n in cont.values()) / len(bi) / (len(cont) + 1)
    p1 = lambda c: (cont[c] - off(d1, cont[c]) if c in cont else 0) / len(bi) + base
    total, down = Counter(), Counter()
    for (b, _), n in bi.items():
        total[b] += n
        down[b] += off(d2, n)

    def p(b, c):
        own = (bi[b, c] - off(d2, bi[b, c])) / total[b] if (b, c) in bi else 0
        return own + (down[b] / total[b] if total[b] else 1) * p1(c)

    return p, {*cont, "not seen"}


def half(spark, rows):
    df = spark.createDataFrame(rows, DOCS).select("doc_id", quality.model_name(False).alias("m"), "text")
    return [(r.doc_id, r.m, r.text) for r in df.collect()]


@pytest.mark.parametrize("shards", [8, 23])
def test_perplexities_are_those_of_a_plain_model(spark, docs, monkeypatch, shards):
    monkeypatch.setattr(quality, "shuffles", lambda spark: 3 * shards)
    monkeypatch.setattr(quality, "BLOCK", 700)
    rows = [(i, t, ["en", "fr", None][i % 3], "s", 0) for i, t in enumerate(texts()[:-1] * 3)] + [(None, prose(30, 8), "en", "s", 0)] * 2
    rows += [(100 + i, prose(50, i % 30) + f" word{i}", "en", "s", 0) for i in range(60)] + [(300, "no model " + prose(9, 4), "xx", "s", 0)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    trusted = spark.createDataFrame([(i,) for i in range(40)] + [(i,) for i in range(100, 160, 2)], "doc_id long")
    ids = {r.doc_id for r in trusted.collect()}
    got = quality.perplexities(df, quality.train(df, trusted)).collect()
    assert len(got) == len(rows)
    by = {}
    for i, m, t in half(spark, rows):
        if i in ids:
            by.setdefault(m, []).append(t or "")
    plain = {m: plain_kneser_ney(t) for m, t in by.items()}
    for p, vocab in plain.values():
        assert sum(p("the", c) for c in vocab) == pytest.approx(1) and sum(p("not seen", c) for c in vocab) == pytest.approx(1)
    want = []
    for i, m, t in half(spark, rows):
        other = m[:-1] + str(1 - int(m[-1]))
        w = ["<s>", *(t or "").split(), "</s>"]
        bits = -sum(np.log2(plain[other][0](b, c)) for b, c in zip(w, w[1:])) if other in plain else None
        want.append((str(i), len(w) - 2, m[:-1], bits))
    key = lambda r: (r[0], r[1], r[2], r[3] or 0)
    mine = sorted(((str(r.doc_id), r.n, r.lang, r.bits) for r in got), key=key)
    for a, b in zip(mine, sorted(want, key=key)):
        assert a[:3] == b[:3] and (a[3] is None) == (b[3] is None) and (b[3] is None or a[3] == pytest.approx(b[3], rel=1e-3, abs=0.01))
    assert sum(b[3] is None for b in want) < 5


def test_packed_columns_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 700):
        a, b = (rng.integers(0, 2**k, n).astype(np.uint64) for k in (40, 30))
        x, y = quality.unpack(quality.pack((a, 5), (b, 4)), 5, 4)
        assert (x == a).all() and (y == b).all()


def test_what_is_gathered_grows_with_the_input(small, spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").select("doc_id")
    size = lambda df: quality.train(df, labels).rows.where("kind = 1").select(F.sum(F.length("grams"))).first()[0]
    assert size(small) > 1.6 * size(small.where("doc_id % 2 = 0"))


def test_quality(spark, docs, none, small):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = quality.classify(small, labels)
    judged = out.join(labels, "doc_id").collect()
    good, bad = [r for r in judged if r.quality == 1 and r.toxic == 0], [r for r in judged if r.quality == 0]
    assert out.count() == small.count() and sum(r.kept for r in good) >= 0.97 * len(good) and sum(not r.kept for r in bad) >= 0.3 * len(bad)
    odd = spark.createDataFrame([(i, 1, None) for i in range(17)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, odd).collect()
    assert len(got) == docs.count() and {r.doc_id for r in got if not r.n} == {0, 1, 2} and not any(r.kept for r in got if not r.n)
    assert all(r.kept for r in quality.classify(docs, odd.limit(0)).collect() if r.n)
    assert quality.classify(none, labels).count() == 0


def test_word_order_counts(spark):
    """Shuffled words have the same words, and a higher perplexity."""
    rng = np.random.default_rng(5)
    phrases = [" ".join(rng.choice(WORDS, 4)) for _ in range(40)]
    texts_ = [" ".join(rng.choice(phrases, 40)) for _ in range(80)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts_)] + [(1000 + i, " ".join(rng.permutation(t.split())), "en", "s", 0) for i, t in enumerate(texts_)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r.kept for r in quality.classify(spark.createDataFrame(rows, DOCS), labels).collect()}
    assert sum(kept[i] for i in range(80)) >= 76 and sum(kept[1000 + i] for i in range(80)) <= 8


def test_quality_stage_goes_by_row(spark):
    rows = [(1, prose(80, 1), "en", 1), (1, "\u00a7! " * 40, "en", 2), (None, prose(80, 2), "en", 3), (2, None, "en", 4), (3, prose(60, 3), None, 5), (1, prose(80, 1), "en", 6)]
    rows += [(10 + i, prose(80, 10 + i), "en", 7) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, _key long").withColumn("_row", F.lit(1)).withColumn("h", F.lit(2)).withColumn("kept", F.lit(3))
    labels = spark.createDataFrame([(10 + i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    import tempfile

    folder = tempfile.mkdtemp()
    labels.write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    out = quality.stage_quality(spark, df, folder)
    got = sorted(r._key for r in out.collect())
    assert out.columns == df.columns and got == sorted([1, 3, 5, 6] + [7] * 30)
    assert quality.stage_quality(spark, df.limit(0), folder).count() == 0


# ------------------------------------------------------------------ 6
def test_exact_dedup(docs, none):
    rows, got = pairs(docs), exact_dedup.content_groups(docs).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    assert len(got) == len(rows)
    for r in got:
        ids = next(g for t, g in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        assert r.doc_id in ids and r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
        assert not r.kept or r.doc_id == r.keep_id
    assert sum(r.kept for r in got) == len(groups)
    kept = exact_dedup.first_rows(docs)
    assert kept.columns == docs.columns and sorted(str(r.text or "") for r in kept.collect()) == sorted(groups)
    assert exact_dedup.content_groups(none).count() == 0 and exact_dedup.first_rows(none).count() == 0


def test_a_group_over_many_partitions(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.concat(F.lit("t"), F.col("id") % 700)).alias("text"))
    r = exact_dedup.content_groups(df).groupBy("text_sha256").agg(F.max("group_size").alias("a"), F.count("*").alias("b"), F.sum(F.col("kept").cast("int")).alias("k"), F.min("keep_id").alias("lo"), F.max("keep_id").alias("hi"), F.max("doc_id").alias("top")).collect()
    assert all(x.a == x.b and x.k == 1 and x.lo == x.hi == x.top for x in r)
    assert exact_dedup.first_rows(df).count() == len(r)


# ------------------------------------------------------------------ 7
def plain_targets(sizes, max_epochs=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, total, fixed = {}, sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        target = fixed | {s: rest * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if target[s] > max_epochs * sizes[s]]
        if not over:
            return target
        fixed |= {s: max_epochs * sizes[s] for s in over}


def test_mixing(spark, docs, none):
    rows = mixing.mix(docs).collect()
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    want = plain_targets(sizes)
    assert len(rows) == docs.count()
    taken = {}
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    assert mixing.mix(none).count() == 0
    skewed = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 390, "big").otherwise(F.concat(F.lit("s"), F.col("id") % 3)).alias("source"), F.lit("a b c").alias("text"))
    t = {r.source: (r.target, r.source_size) for r in mixing.mix(skewed).collect()}
    plain = plain_targets({s: z for s, (_, z) in t.items()})
    assert {s: pytest.approx(x) for s, x in plain.items()} == {s: x for s, (x, _) in t.items()}


# ------------------------------------------------------------------ 8
def test_licenses(spark, none):
    rows = [
        (1, "a/LICENSE", "Intro.\n" + prose(50, 1) + "\nReleased under the MIT License."), (2, "a/b/x.txt", prose(40, 2)), (3, "a/b/c/LICENSE.md", "Licensed under the Apache License, Version 2.0."),
        (4, "a/b/c/d/y.txt", ""), (5, "z/q.txt", None), (6, None, "All rights reserved."), (7, "a/b/c/own.txt", "x\nLicensed under CC BY-NC 4.0.\n"), (8, "LICENSES.txt/q", prose(1000, 3)), (2, "a/b/x.txt", prose(40, 2)),
    ]
    df = spark.createDataFrame(rows, "id long, path string, text string").withColumn("dir", F.lit(1)).withColumn("score", F.lit(1))
    got = sorted((r.id, r.license, r.declared, r.from_dir) for r in licenses.scan(df).collect())
    assert got == [
        (1, "MIT", True, None), (2, "MIT", False, "a"), (2, "MIT", False, "a"), (3, "Apache-2.0", True, None), (4, "Apache-2.0", False, "a/b/c"), (5, None, False, None), (6, "proprietary", True, None),
        (7, "CC-BY-NC-4.0", True, None), (8, None, False, None),
    ]
    assert licenses.scan(none.select(F.col("doc_id").alias("id"), F.col("source").alias("path"), "text")).count() == 0


def wrapped(text, sign="", width=70):
    import textwrap

    return "\n".join((sign + " " + line).strip() for line in textwrap.wrap(text, width))


def licence_files():
    t = {n: [x for m, x in licenses.TEMPLATES if m == n] for n, _ in licenses.TEMPLATES}
    bsd = lambda three: "\n\n".join(["Copyright (c) 2019, Jane Roe", licenses._BSD_OPEN, "1. " + licenses._BSD_1, "2. " + licenses._BSD_2, *(["3. " + licenses._BSD_3] if three else []), licenses._BSD_AS_IS])
    code = "\n\nint main(void) { return compute(17); }\n"
    return [
        ("MIT", " ".join([(licenses._MIT + " " + licenses._AS_IS).replace(".", "")] * 70)),  # over 11,000 words without a full stop
        ("MIT", "\n".join([licenses._MIT, licenses._AS_IS] * 70)),
        ("MIT", "MIT License\n\nCopyright (c) 2020 Jane Roe\n\n" + wrapped(licenses._MIT) + "\n\n" + wrapped(licenses._AS_IS)),
        ("MIT", wrapped(licenses._MIT, "//") + code),
        ("ISC", "ISC License\n\nCopyright 2021 Jane Roe\n\n" + wrapped(licenses._ISC) + "\n\n" + wrapped(licenses._ISC_AS_IS)),
        ("BSD-2-Clause", bsd(False)), ("BSD-3-Clause", bsd(True)),
        ("Apache-2.0", "/*\n * Copyright 2018 Jane Roe\n *\n" + wrapped(licenses._APACHE, " *") + "\n */" + code),
        ("Apache-2.0", "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/\n\nTERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n" + prose(300, 1)),
        ("GPL-3.0", wrapped(t["GPL-3.0"][1], "#") + code), ("GPL-2.0", wrapped(t["GPL-2.0"][1], " *") + code),
        ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nCopyright (C) 2007 Free Software Foundation, Inc.\n" + licenses._VERBATIM + "\n\n" + prose(200, 2)),
        ("LGPL-3.0", wrapped(t["LGPL-3.0"][1], "#") + code), ("AGPL-3.0", wrapped(t["AGPL-3.0"][1], "#") + code),
        ("MPL-2.0", wrapped(t["MPL-2.0"][1], "//") + code), ("MIT", "# SPDX-License-Identifier: MIT" + code), ("Apache-2.0", "// SPDX-License-Identifier: Apache-2.0" + code),
        ("GPL-2.0", "/* SPDX-License-Identifier: GPL-2.0-or-later */" + code), ("CC-BY-4.0", prose(30, 3) + "\nLicensed under CC BY 4.0."),
        (None, "Permission to copy was not given, and the software is not free of charge to any person." + prose(40, 4)), (None, "The licence of the driver expired; a copy of the permit must be included."),
        (None, "SPDX-License-Identifier: LicenseRef-Other"), (None, "merchantability and noninfringement are two long words"), (None, prose(500, 5)), (None, ""), (None, None),
    ]


def plain_best(texts_, threshold=0.7):
    """Cosine of every unit with every template, without filters or bounds."""
    from collections import Counter

    seen = Counter(w for t in texts_ for w in set(licenses.words(t or "")))
    weigh = lambda t: {w: n * licenses.idf(len(texts_), seen[w]) for w, n in Counter(licenses.words(t)).items()}
    norm = lambda v: sum(x * x for x in v.values()) ** 0.5
    temps = [(n, weigh(t)) for n, t in licenses.TEMPLATES]
    out = []
    for t in texts_:
        best = (None, 0.0)
        for u in licenses.units(t or ""):
            v = weigh(u)
            for n, w in temps if v else ():
                s = round(sum(x * w.get(k, 0) for k, x in v.items()) / norm(v) / norm(w), 6)
                if s >= threshold and (best[0] is None or (-s, n) < (-best[1], best[0])):
                    best = (n, s)
        out.append(best)
    return out


def test_licence_texts_and_headers(spark, small):
    made = licence_files()
    rows = [(i, f"p{i}/x.txt", t) for i, (_, t) in enumerate(made)] + [(1000 + i, f"q/{i}.txt", t) for i, (_, t) in enumerate(pairs(small))]
    got = {r.id: (r.own, r.score) for r in licenses.own_licenses(spark.createDataFrame(rows, "id long, path string, text string")).collect()}
    want = plain_best([t for _, _, t in rows])
    for (i, _, _), (name, score) in zip(rows, want):
        assert got[i][0] == name and got[i][1] == pytest.approx(score, abs=2e-6), (i, got[i], name, score)
    assert [got[i][0] for i in range(len(made))] == [n for n, _ in made]


def test_nearest_ancestor_by_walking(spark, tmp_path):
    rng = np.random.default_rng(3)
    says = [None, "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", None, "Released under the ISC License."]
    rows = []
    for i in range(300):
        folder = "/".join(rng.choice(list("ab"), int(rng.integers(0, 5))))
        file = str(rng.choice(["LICENSE", "license.md", "x.py", "y.txt", "z.c", "COPYING"]))
        rows.append((i, f"{folder}/{file}" if folder else file, says[int(rng.integers(5))]))
    rows += [(900, None, None), (901, None, says[1])]
    df = spark.createDataFrame(rows, "id long, path string, text string")
    own = {r.id: (r.own, r.score) for r in licenses.own_licenses(df).collect()}
    folder = lambda p: p.rsplit("/", 1)[0] if "/" in p else ""
    has = {}
    for i, p, _ in rows:
        if p and own[i][0] and re.match(licenses.LICENSE_FILES, p.rsplit("/", 1)[-1]):
            has.setdefault(folder(p), []).append((-own[i][1], own[i][0], p))
    for r in licenses.scan(df).collect():
        want, at = own[r.id][0], None
        if want is None and r.path is not None:
            d = folder(r.path)
            while True:
                if d in has:
                    want, at = min(has[d])[1], d
                    break
                if not d:
                    break
                d = folder(d)
        assert (r.license, r.from_dir, r.declared) == (want, at, own[r.id][0] is not None)
    docs_ = spark.createDataFrame([(i, "t", "en", "s", 0) for i in (0, 1, 50, 1000, 1051)] + [(None, "t", "en", None, 0)], DOCS)
    assert [r.path for r in licenses.document_files(docs_).collect()] == ["s/0/LICENSE", "s/0/0/1.txt", "s/0/1/LICENSE", "s/1/LICENSE", "s/1/21/1051.txt", None]


# ------------------------------------------------------------------ 9
def plain_bits(samples, alphabet, text):
    """Prediction by partial matching with dictionaries."""
    counts = {}
    for t in samples:
        for i in range(len(t)):
            for k in range(min(i, langid.ORDER) + 1):
                counts.setdefault(t[i - k : i], {}).setdefault(t[i], 0)
                counts[t[i - k : i]][t[i]] += 1

    def p(ctx):
        seen = counts.get(ctx)
        if not seen:
            return np.full(256, 1 / 256) if not ctx else p(ctx[1:])
        n, d = sum(seen.values()), len(seen)
        low = np.full(256, 1 / 256) if not ctx else p(ctx[1:])
        out = low / (1 - sum(low[b] for b in seen)) * d / (n + d) if d < 256 else low * 0
        for b, c in seen.items():
            out[b] = c / (n + d)
        return out

    return -sum(np.log2(p(text[max(0, i - langid.ORDER) : i])[text[i]]) for i in range(len(text)))


def test_code_lengths_are_exact():
    samples = {"en": [prose(30, 1).encode(), b"abc"], "fr": ["le été et là où".encode()]}
    model = langid.learn(samples)
    texts_ = [b"the of", b"", b"a", "été 漢 zz".encode(), b"ab"]
    data, ends = np.frombuffer(b"".join(texts_), np.uint8), np.cumsum([len(t) for t in texts_])
    starts = np.concatenate([[0], ends[:-1]])
    langs, symbol, width, trees = model
    s = symbol[data]
    ctx = np.zeros(len(s), np.int32)
    for k in range(1, langid.ORDER + 1):
        ctx[k:] += s[: max(0, len(s) - k)] * np.int32(width ** (k - 1))
    for lang, tree in zip(langs, trees):
        got = tree.lengths(s, ctx, starts, ends)
        assert got == pytest.approx([plain_bits(samples[lang], None, t) for t in texts_], rel=1e-4)


def test_language(spark, docs, none, small):
    got = langid.identify(small, langid.training_sample(small)).join(small.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in got)
    odd = {r.doc_id: r for r in langid.identify(docs, langid.training_sample(docs)).collect()}
    assert {i for i, r in odd.items() if r.lang_pred == "und"} == {0, 1, 2, 16} and odd[None].held_out is False
    assert langid.identify(none, langid.training_sample(none)).count() == 0


# ------------------------------------------------------------------ 10
def plain_removal(rows, n=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - n + 1):
            if i is not None:
                first[b[s : s + n]] = min(i, first.get(b[s : s + n], i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        m = bytearray(len(b))
        for s in range(len(b) - n + 1):
            if i is not None and first[b[s : s + n]] < i:
                m[s : s + n] = b"\1" * n
        kept = bytes(x for x, y in zip(b, m) if not y)
        out.append((str(i), len(b), sum(m), sum(1 for k in range(len(m)) if m[k] and not (k and m[k - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("which", ["docs", "made"])
def test_substrings(request, spark, which):
    if which == "docs":
        df = request.getfixturevalue("docs")
    else:
        rng = np.random.default_rng(9)
        shared = [prose(30, 50 + k) for k in range(4)]
        rows = [(int(i), prose(10, i) + shared[rng.integers(4)][rng.integers(20) :] + prose(10, 100 + i) + "x" * int(rng.integers(120)) + shared[rng.integers(4)]) for i in range(60)]
        rows += [(5, rows[6][1] + "y"), (5, rows[5][1]), (80, "a" * 500), (81, "a" * 49), (82, "a" * 60), (83, "ab" * 100), (90, "b" + "ab" * 60)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.remove_repeats(df).collect())
    assert got == plain_removal(pairs(df))


def test_many_contexts_of_one_anchor():
    import pyarrow as pa

    n = 300
    full = lambda k, v: np.full(k, v, np.int64)
    rows = substrings._rows(0, full(n, 7), np.arange(n), np.arange(n) + 10, full(n, 30), full(n, 26 * 256 + 50))
    batches = [rows.slice(i, 20) for i in range(0, n, 20)]
    out = pa.Table.from_batches(list(substrings._contexts(iter(batches), 50, most=50)))
    assert sorted(out["doc"].to_pylist()) == list(range(10, n + 10)) and set(out["kind"].to_pylist()) == {2}


def test_substrings_of_nothing(none):
    assert substrings.remove_repeats(none).count() == 0


# ------------------------------------------------------------------ queries and pipeline
def test_queries_agree_with_sql(spark):
    from gleaner.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name, sql in ORACLES.items():
        got, want = QUERIES[name](spark, SF).toPandas(), con.execute(sql).df()
        cols = sorted(got.columns)
        assert cols == sorted(want.columns)
        assert sorted(map(str, got[cols].values.tolist())) == sorted(map(str, want[cols].values.tolist())), name


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def near_losers(sets, close):
    """Every id but the smallest of each connected group."""
    label = {i: i for i in sets}
    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if close(sets[i], sets[j]) and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = {x: a if y == b else y for x, y in label.items()}
    return {i for i in ids if label[i] != i}


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], SF).persist())
        assert name == "packing" or seen[-1].columns == docs.columns
    start, good, exact, near, mix, packed = seen
    assert set(r.doc_id for r in good.collect()) <= set(r.doc_id for r in start.collect())
    assert exact.count() == good.select("text").distinct().count() and near.count() <= exact.count()
    gone = set(r.doc_id for r in exact.collect()) - set(r.doc_id for r in near.collect())
    sets = {r.doc_id: shingles(r.text) for r in exact.collect()}
    close = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    assert gone == near_losers(sets, close)
    per = mix.groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert per <= 3
    assert packed.select("doc_id").distinct().count() == mix.select("doc_id").distinct().count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 2048
    assert json.dumps(packed.columns)
