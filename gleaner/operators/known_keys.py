"""Keys that earlier runs have taken, without bound: a log of layers with filters, grown by each run and never rewritten whole.

A layer holds the keys of one or more runs, and a filter: one bit per key among 16 times as many, in bitmaps of 32,768
bits. Keys that are looked up meet the small bitmaps first; only those whose bit is set (all that are known, and about
one in sixteen of the others) meet a layer's keys. A run's keys become a layer of their own; layers that are not
larger are merged into it, so that there are about log2(keys) of them and a key is rewritten that often at most. Layers
become visible by one atomic commit with the run's label, so a run that is repeated adds nothing.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import commits, leads
from gleaner.operators.graph import stash

BITS = 32768
LAYERS = "layer string, keys long, bits long"
LABELS = "label string"


def _bit(bits) -> F.Column:
    return F.pmod(F.xxhash64("key"), bits)


@dataclass(frozen=True)
class KnownKeys:
    spark: SparkSession
    root: str
    version: int
    layers: tuple[tuple[str, int, int], ...]  # about log2(keys)
    labels: frozenset[str]  # one per run

    @classmethod
    def load(cls, spark: SparkSession, root: str) -> KnownKeys:
        last = commits.latest(spark, root)
        if last is None:
            return cls(spark, root, 0, (), frozenset())
        layers = spark.read.schema(LAYERS).parquet(f"{last.folder}/layers").collect()
        labels = spark.read.schema(LABELS).parquet(f"{last.folder}/labels").collect()
        return cls(spark, root, last.number, tuple(map(tuple, layers)), frozenset(r[0] for r in labels))

    def _keys(self, layer: str) -> DataFrame:
        return self.spark.read.schema("key string").parquet(f"{self.root}/layers/{layer}/keys")

    def find(self, keys: DataFrame) -> DataFrame:
        """keys (key) -> those that are known, each once."""
        asked = keys.select("key").where("key is not null").distinct()
        if not self.layers:
            return asked.limit(0)
        table = F.broadcast(self.spark.createDataFrame(self.layers, LAYERS))
        asked = stash(asked.join(table).select("layer", "key", _bit(F.col("bits")).alias("bit")), "asked")  # layers are few
        found = None
        for layer, _, _ in self.layers:
            maps = self.spark.read.schema("part long, bitmap binary").parquet(f"{self.root}/layers/{layer}/filter")
            mine = asked.where(F.col("layer") == layer).withColumn("part", F.floor(F.col("bit") / BITS)).withColumn("at", F.col("bit") % BITS)
            maybe = mine.join(maps, "part").where("shiftright(cast(conv(hex(substring(bitmap, cast(at div 8 as int) + 1, 1)), 16, 10) as int), cast(at % 8 as int)) & 1 = 1")
            here = maybe.select("key").join(self._keys(layer), "key", "left_semi")
            found = here if found is None else found.union(here)
        return found.distinct()

    def add(self, keys: DataFrame, label: str) -> KnownKeys:
        """With the keys of a run; nothing changes if the label was added before. commits.Conflict if another writer was first."""
        if label in self.labels:
            return self
        new = keys.select("key").where("key is not null").distinct()
        new = stash(new.join(self.find(new), "key", "left_anti"), "new_keys")
        n = new.count()
        layers = sorted(self.layers, key=lambda x: x[1])
        while n and layers and layers[0][1] <= n:  # smaller and equal layers become part of this one
            layer, more, _ = layers.pop(0)
            new, n = new.union(self._keys(layer)), n + more
        if n:
            name = uuid.uuid4().hex
            bits = max(BITS, 1 << (16 * n - 1).bit_length())
            commits.write_table(new, f"{self.root}/layers/{name}/keys")
            where = _bit(F.lit(bits))
            maps = self._keys(name).select(F.floor(where / BITS).alias("part"), (where % BITS).alias("at")).groupBy("part").agg(F.bitmap_construct_agg("at").alias("bitmap"))
            commits.write_table(maps, f"{self.root}/layers/{name}/filter")
            layers.append((name, n, bits))
        tables = {"layers": self.spark.createDataFrame(layers, LAYERS).coalesce(1), "labels": self.spark.createDataFrame([(x,) for x in sorted({*self.labels, label})], LABELS).coalesce(1)}
        commits.commit(self.spark, self.root, tables, self.version, label)
        return KnownKeys.load(self.spark, self.root)


def import_report(observations: DataFrame, sources: DataFrame, register: DataFrame, known: KnownKeys, *, generated_at: str, family: str, now: str, now_s: float, most: int = 150) -> tuple[list[str], DataFrame, KnownKeys]:
    """A worker's report, end to end: refused as a whole for its faults, else its new leads, at most `most`, whose keys are known from then on.

    observations and sources as in importer.worker_candidates; register: source_id, url. The report's time is its label.
    """
    from gleaner.sources import importer

    faults = leads.report_faults(F.lit(generated_at), sources, register, now).first().faults
    o = stash(importer.worker_candidates(observations, sources, family, now_s), "candidates")
    if faults:
        return faults, importer.worker_new(o.limit(0), o.limit(0), o.limit(0)), known
    tagged = lambda df, url: df.select(F.explode(F.array(F.concat(F.lit("url:"), url), F.concat(F.lit("key:"), F.col("candidate_key")))).alias("key"))
    old = stash(known.find(tagged(o, F.col("url"))), "old")
    cut = lambda kind, name: old.where(F.col("key").startswith(kind)).select(F.substring("key", 5, 10**6).alias(name))
    rows = stash(importer.worker_new(o, cut("url:", "url"), cut("key:", "candidate_key")).orderBy("ordinal").limit(most), "leads")
    return [], rows, known.add(tagged(rows, F.col("official_or_board_url")), generated_at)
