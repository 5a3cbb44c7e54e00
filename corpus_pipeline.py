"""Corpus preparation: quality, exact copies, near copies, mix, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its rows are written as Parquet and
read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm.common import stash, table
from gleaner.llm.exact_dedup import stage_exact_dedup
from gleaner.llm.mixing import stage_mixing
from gleaner.llm.packing import stage_packing
from gleaner.llm.quality import stage_quality
from gleaner.llm.simhash import stage_near_dedup

STAGES = [
    ("quality", stage_quality),
    ("exact_dedup", stage_exact_dedup),
    ("near_dedup", stage_near_dedup),
    ("mixing", stage_mixing),
    ("packing", stage_packing),
]

#: Perplexities, fingerprints and token ids are not expressible in SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
