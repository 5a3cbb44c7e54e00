"""Token counts against the library itself."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gleaner.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "  ", "a b<|endoftext|>  \n c <|endoftext|>", "<|endoftext|><|endoftext|>", "<|endof<|endoftext|>text|>", "՘՘ a႔0", "don't we'll I'M 12,345\t\t x   y\x1c\x85z",
    "漢字かな 12三", "q" * 200_000, " " * 50_000 + "a", "\n" * 3000, "é" * 999 + " ́", "🙂🙂 \U0001f468‍\U0001f469", "the the the cat",
]


def expected(texts):
    t = Tokenizer.from_file(PATH)
    return [(len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for x in texts]


@pytest.mark.parametrize("block,shard", [(8_000_000, 4_000_000), (40, 60)])
def test_counts_equal_the_library(spark, block, shard):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(4, TEXTS[4]), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for clash in ("block", "words", "start", "n_tokens", "answers"):
        docs = docs.withColumn(clash, F.lit(1))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_counts(docs, block_bytes=block, shard_bytes=shard).collect())
    want = sorted((i is None, i or 0, *n, n[1] > 1024) for (i, _), n in zip(rows, expected([t for _, t in rows])))
    assert got == want


def test_query_equals_the_library(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: n for r, n in zip(rows, expected([r.text for r in rows]))}
    got = tokens.op12_token_counts(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(rows) and {r.doc_id: (r.n_bytes, r.n_tokens) for r in got} == want


def test_empty_table(spark):
    assert tokens.token_counts(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_classes_of_all_code_points():
    """Where the library's splitter and the pattern differ, the splitter is used."""
    v, t = tokens.vocabulary(), Tokenizer.from_file(PATH)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    for i in range(0, len(points), 4096):
        s = "".join(f"a{c}1{c}!{c}x  " for c in points[i : i + 4096] if c not in v.newer)
        assert [a for _, a in t.pre_tokenizer.pre_tokenize_str(s)] == [m.span() for m in v.pattern.finditer(s)]
    assert v._found("՘a")[0] == "՘"  # not a letter to the library


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        tokens.vocabulary(public_tokenizers.path("word_bpe_49k.json"))
