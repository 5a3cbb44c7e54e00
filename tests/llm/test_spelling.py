"""Spelling variants against brute force."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import spelling


def plain(rows, least=5):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= least}
    cut = defaultdict(set)  # by what is left without one code point, and where it was
    for w in n:
        for i in range(len(w)):
            cut[w[:i] + w[i + 1 :]].add((i, w))
    near = defaultdict(set)
    for v, who in cut.items():
        if v in n:
            for _, w in who:
                near[w].add(v), near[v].add(w)
        for i, w in who:
            near[w] |= {x for j, x in who if i == j and x != w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def result(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def crafted():
    r = np.random.default_rng(3)
    texts = [None, "", "short", "123 456", "Émile ÉMILES émiles ÷×÷×÷× " * 6, "x" * 3000 + " " + ("y" + "x" * 2999 + " ") * 6 + ("x" * 2999 + "z ") * 30]
    # chains: each form five times as frequent; ties; boundary insertions; the same letter repeated
    for w, k in (("abcdef", 3000), ("abcdefg", 600), ("abcdefgh", 120), ("abcdefghi", 24), ("bbcdef", 3000), ("aaaaaa", 50), ("aaaaaaa", 250), ("abcxdef", 9), ("abdcef", 7), ("zzzzzz", 5), ("zzzzzy", 24), ("zzzzzx", 25), ("zzzzzw", 25)):
        texts.append(f"{w} " * k)
    # a beginning and an end that very many words share
    letters = list("abcdé")
    for head, tail in (("common", ""), ("", "ending")):
        for i in range(400):
            w = "".join(r.choice(letters, 4 + i % 2))
            texts.append(f"{head}{w}{tail} " * int(r.choice([5, 6, 30, 200])))
    return [(i, t) for i, t in enumerate(texts)] + [(9, texts[9]), (None, "missing " * 7)]


@pytest.mark.parametrize("hot,halves", [(200, 50_000), (3, 400), (10**9, 400)])
def test_equals_brute_force(spark, hot, halves):
    rows = crafted()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for clash in ("word", "n", "form", "end", "half", "shard", "root"):
        docs = docs.withColumn(clash, F.lit(1))
    want = plain(rows)
    assert sum(x[1] is not None for x in want) > 50 and any(x[1] != x[2] and x[1] for x in want)
    assert result(spelling.variants(docs, hot=hot, shard_halves=halves)) == want


def test_long_and_short_words_share_keys():
    r = np.random.default_rng(1)
    for n in (3, 63, 64, 65, 66, 200):
        a = "".join(r.choice(list("abc"), n))
        for b in (a[:1] + a[2:], a[: n // 2] + "z" + a[n // 2 :], a[:2] + "z" + a[3:]):
            assert set(spelling._keys(a)) & set(spelling._keys(b))
        assert not set(spelling._keys(a)) & set(spelling._keys(a[::-1] + "zz"))


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert result(spelling.op11_spelling_variants(spark, "/root/testdata/sf0.001")) == plain(rows)


def test_empty_table(spark):
    assert result(spelling.variants(spark.createDataFrame([], "doc_id long, text string"))) == []


@pytest.mark.parametrize("a,b,near", [("abc", "abc", False), ("abc", "abcd", True), ("abc", "xabc", True), ("abc", "abd", True), ("abc", "acb", False), ("aab", "ab", True), ("ab", "abcd", False), ("", "a", True)])
def test_one_edit(a, b, near):
    assert spelling.one_edit(a, b) is near and spelling.one_edit(b, a) is near
