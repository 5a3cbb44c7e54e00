"""Places where an operator once did less than its whole job."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import jaccard, quality, simhash


def invented(n, seed):
    r = np.random.default_rng(seed)
    return " ".join("".join(r.choice(list("abcdefghijklmnop"), 5)) for _ in range(n))


def shingles(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


@pytest.mark.parametrize("block", [1 << 20, 500])
def test_pipeline_near_dedup_reaches_jaccard(spark, block):
    rng, texts = np.random.default_rng(2), [None, "", " \t", "one two", "One  two", "three"]
    for k in range(40):
        w = invented(120, k).split()
        texts.append(" ".join(w))
        for swaps in (1, 2, 3, 5):
            v = list(w)
            for i in rng.choice(120, swaps, replace=False):
                v[i] = f"new{rng.integers(1e9)}"
            texts.append(" ".join(v))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets, label = [shingles(t) for t in texts], list(range(len(texts)))
    pairs = [(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for _ in texts:
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
    node = {r.h: r.doc_id for r in df.select("doc_id", jaccard.text_hash().alias("h")).orderBy(F.desc("doc_id")).collect()}
    parts = {}
    for r in jaccard.near_copies(df, block=block).collect():
        parts.setdefault(r.component, set()).add(node[r.node])
    want = {}
    for i, k in enumerate(label):
        want.setdefault(k, set()).add(i if texts[i] else min(i, 0))
    assert sorted(map(sorted, parts.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)
    fp = [simhash.fingerprint((t or "").encode()) for t in texts]
    assert any((fp[i] ^ fp[j]).bit_count() > 4 for i, j in pairs)
    if block > 500:
        kept = simhash.stage_near_dedup(spark, df.withColumn("x", F.lit(1)), "")
        assert kept.columns == ["doc_id", "text", "x"] and sorted(r.doc_id for r in kept.collect()) == sorted(set(label))


@pytest.mark.parametrize("trusted", [1, 3])
def test_few_trusted_documents_reject_no_clean_ones(spark, trusted):
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("aeiounrstlmdc"), rng.integers(2, 9))) for _ in range(400)]
    rows = [(i, " ".join(rng.choice(words, 150)), "es") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(trusted)], "doc_id long, quality int, toxic int")
    assert sum(r.kept for r in quality.classify(docs, labels).collect()) >= 57


def test_near_dedup_goes_by_row(spark):
    """Repeated ids, null ids, null texts, copies and clashing columns: one whole row of each group stays."""
    a, b = invented(100, 1), invented(100, 2)
    near = a.split()
    near[50] = "changed"
    rows = [(1, a, 1), (1, b, 2), (2, " ".join(near), 3), (None, b, 4), (None, "only " + invented(50, 3), 5), (3, None, 6), (4, "", 7), (1, a, 8), (None, " ".join(near), 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _h long").withColumn("_row", F.lit(1)).withColumn("best", F.lit(2)).withColumn("c", F.lit(3))
    kept = simhash.stage_near_dedup(spark, df, "")
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert kept.columns == df.columns
    assert sorted(map(str, got)) == sorted(map(str, [(1, a), (1, b), (None, rows[4][1]), (3, None)]))
    assert simhash.stage_near_dedup(spark, df.limit(0), "").count() == 0


ODD = "doc_id long, text string, lang string, source string, n_chars long, _n long, _of int, _row string, size long"


def odd_rows(spark):
    prose = lambda n, k: invented(n, k)
    rows = [(None, prose(60, 1), "en", "a", 1), (None, prose(60, 2), "en", None, 1), (1, None, None, "a", 1), (2, "", "en", "b", 1), (3, prose(60, 3), "en", "b", 1), (3, prose(60, 4), "en", "b", 1), (3, prose(60, 4), "en", "b", 2)]
    rows += [(10 + i, prose(60, 10 + i), "en", ["a", "b", None, "\u00e9"][i % 4], 1) for i in range(20)] + [(50, prose(4000, 50), "en", "a", 1)]
    return spark.createDataFrame([(*r, 7, 8, "r", 9) for r in rows], ODD)


def test_mixing_stage_takes_whole_rows(spark):
    from gleaner.llm import mixing

    df = odd_rows(spark)
    out = mixing.stage_mixing(spark, df, "")
    assert out.columns == df.columns
    want = {}
    plan = mixing.mix(df.select("doc_id", "source", "text", F.xxhash64("text").alias("h")), keep=("h",)).collect()
    for r in plan:
        if r["size"]:
            key = (r.doc_id, r.source, r.h)
            want[key] = max(want.get(key, 0), int(r.taken / r["size"] + 0.5))
    got = {}
    for r in out.select("doc_id", "source", F.xxhash64("text").alias("h"), "n_chars").collect():
        got[r.doc_id, r.source, r.h, r.n_chars] = got.get((r.doc_id, r.source, r.h, r.n_chars), 0) + 1
    have = {(r.doc_id, r.source, r.h, r.n_chars) for r in df.select("doc_id", "source", F.xxhash64("text").alias("h"), "n_chars").collect()}
    assert got == {k: want[k[:3]] for k in have if want.get(k[:3])}
    assert mixing.stage_mixing(spark, df.limit(0), "").count() == 0


def test_pipeline_with_odd_tables(spark, tmp_path):
    """Null and repeated ids, null texts, clashing columns, very long texts; and empty tables."""
    import corpus_pipeline

    for name, df in (("odd", odd_rows(spark)), ("none", odd_rows(spark).limit(0))):
        folder = str(tmp_path / name)
        df.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(10 + i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        rows = corpus_pipeline.run(spark, folder).collect()
        assert bool(rows) == (name == "odd")
        if rows:
            ids = {r.doc_id for r in rows}
            assert {3, None, 50} <= ids and not {1, 2} & ids
            assert sum(r.length for r in rows if r.sequence_id == rows[0].sequence_id) <= 2048


def test_long_documents_are_learned_from(spark):
    from gleaner.llm import langid

    rows = [(i, invented(9000, i), "xx") for i in range(12)] + [(100 + i, "de het een van en " * 40, "nl") for i in range(12)] + [(5, invented(9000, 5), "xx")] * 3
    sample = langid.training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_bytes=1000)
    assert set(sample) == {"xx", "nl"} and max(map(len, sample["xx"])) == 1000 and len(sample["xx"]) <= 12
