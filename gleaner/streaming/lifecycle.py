"""Scheduled runs as a stream: each micro-batch of observations is one upsert into the versioned state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from gleaner.operators.state import State, upsert


def fresh_reports(reports: DataFrame, now: str, late: str = "3 hours", early: str = "10 minutes") -> DataFrame:
    """Whole reports inside the window around now; a watermark would drop single rows, not reports."""
    at, t = F.to_timestamp("generated_at"), F.to_timestamp(F.lit(now))
    return reports.where((at >= t - F.expr(f"interval {late}")) & (at <= t + F.expr(f"interval {early}")))


def upsert_stream(batches: DataFrame, root: str, instance: str, checkpoint: str, clock: str, **options: object) -> DataStreamWriter:
    """Writer over batches (ordinal, keys, canonical_url, content_hash, payload, snippet).

    Each batch is committed with its id as the label, so a batch that is run again after its commit changes nothing, and
    one that died before it starts from the version before.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        state = State.load(batch.sparkSession, root)
        label = f"v{batch_id:09d}"
        if state.label >= label:
            return
        new, _ = upsert(batch, state, instance=instance, run_id=label, now=f"{clock}#{batch_id:09d}", **options)
        new.save(root, label)

    return batches.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True)
