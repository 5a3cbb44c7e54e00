"""All sources of a run applied to the state in one upsert, in a number of jobs that does not grow with the sources.

Sources come one after the other by `position`, and each sees what earlier ones left. That order is a fold over (job,
position, ordinal): what a row compares with is the last written hash before it, whether a source may write depends on
the memberships left at its turn, and whether it closes a job depends on which memberships have run out by then. Each is
a window or a sum along the order. For a job with more rows than a chunk it is taken in steps (rows in a chunk, chunks of a
source, sources of a job), so that a job that a third of all rows belong to is spread over many tasks.

Rows are tied together for the run as a whole: jobs that any source of the run shows to be one are one from its start.
Where no later source joins jobs that an earlier one of the same run made, the result is that of one source after the
other, the ids of new jobs aside (a digest of the least key of the run, not of the first source).
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.operators.graph import stash
from gleaner.operators.state import State, merge_snapshots, merged_jobs, resolved

SHIFT = 40  # rows of a source are numbered below 2**40


def _last(df: DataFrame, group: list[str], order: str, value: str, name: str) -> DataFrame:
    """The last value that is not null before each row."""
    before = W.partitionBy(*group).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn(name, F.last(value, True).over(before))


def memberships_after(state: State, follow, present: DataFrame, sources: DataFrame, run_id: str, close_threshold: int) -> DataFrame:
    """One row per membership before or after the run: what it was, what it is, and its source's turn."""
    old = follow(state.memberships).groupBy("source_instance", "job_id").agg(
        F.min("missing_runs").alias("missing"), F.max("last_seen_run").alias("seen_run"), F.max("close_threshold").alias("threshold")
    )
    both = old.withColumn("stored", F.lit(True)).join(present.select("source_instance", "job_id", F.lit(True).alias("here")), ["source_instance", "job_id"], "full")
    both = both.fillna(False, ["stored", "here"]).join(sources, "source_instance", "left")
    turn = F.col("position").isNotNull()
    gone = turn & ~F.col("authoritative")
    after = F.when(F.col("here"), 0).otherwise(F.col("missing") + F.when(turn & F.col("complete"), 1).otherwise(0)).cast("int")
    limit = F.when(F.col("here"), F.lit(max(2, close_threshold))).otherwise(F.col("threshold")).cast("int")
    alive = lambda missing, threshold: ~(missing >= F.greatest(F.lit(2), threshold))
    return both.withColumn("missing_runs", after).withColumn("close_threshold", limit).select(
        "source_instance", "job_id", "position", "stored", gone.alias("removed"), "missing_runs", F.when(F.col("here"), F.lit(run_id)).otherwise(F.col("seen_run")).alias("last_seen_run"), "close_threshold",
        (F.col("stored") & alive(F.col("missing"), F.col("threshold"))).cast("int").alias("alive_before"),
        (~gone & alive(F.col("missing_runs"), F.col("close_threshold"))).cast("int").alias("alive_after"),
        (turn & F.col("authoritative") & F.col("complete") & (F.col("missing_runs") > 0)).alias("closes"),
    )


def closings(members: DataFrame) -> DataFrame:
    """job_id, position: at the source's turn it has missed the job, and so has every source that has it then."""
    upto = W.partitionBy("job_id").orderBy(F.asc_nulls_last("position")).rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy("job_id")
    left = F.sum("alive_after").over(upto) + F.sum("alive_before").over(whole) - F.sum("alive_before").over(upto)
    return members.withColumn("_left", left).where("closes and _left = 0").select("job_id", "position")


def upsert_sources(batch: DataFrame, sources: DataFrame, state: State, *, run_id: str, now: str, close_threshold: int = 2, chunk: int = 4096) -> tuple[State, DataFrame, DataFrame]:
    """batch (source_instance, ordinal, keys, canonical_url, content_hash, payload, snippet), sources (source_instance, position,
    authoritative, complete) -> the new state, counters per source, and per row job_id, change (as written) and review (against
    what was stored before its source's turn)."""
    turns = sources.select("source_instance", F.col("position").cast("long").alias("position"), "authoritative", "complete")
    rows = batch.join(turns.select("source_instance", "position", "authoritative"), "source_instance").where(F.size("keys") > 0).withColumn("node", F.shiftleft("position", SHIFT) + F.col("ordinal"))
    rows = stash(rows.withColumn("snippet", F.coalesce("snippet", F.lit(False))), "rows")
    # jobs are found from each source's sets of keys, which are fewer than rows
    met = stash(rows.groupBy("keys", "position").agg(F.min("node").alias("node"), F.count("*").alias("n"), F.bool_or(F.col("authoritative") & ~F.col("snippet")).alias("shown")), "met")
    part, ids, follow = resolved(met.groupBy("keys").agg(F.min("node").alias("ordinal")), state)
    met = stash(met.join(part.select("keys", "part"), "keys"), "met")

    present = met.where("shown").select("part", "position").distinct().join(ids.select("part", "job_id"), "part").join(turns.select("source_instance", "position"), "position")
    members = stash(memberships_after(state, follow, present, turns, run_id, close_threshold), "members")
    old = merged_jobs(state, ids, follow)
    held = members.where("stored").groupBy("job_id").agg(F.max(F.when(F.col("removed"), F.col("position")).otherwise(F.lit(2**62))).alias("held_until"))
    facts = (
        met.groupBy("part").agg(F.min("node").alias("first_node"), F.min(F.when(F.col("shown"), F.col("position"))).alias("shown_at"), (F.sum("n") > chunk).alias("large"))
        .join(ids.select("part", "job_id"), "part")
        .join(old.select("job_id", F.col("content_hash").alias("stored_hash"), F.lit(True).alias("known")), "job_id", "left").join(held, "job_id", "left").drop("job_id")
    )
    facts = stash(met.groupBy("keys", "part").agg((F.sum("n") > chunk).alias("hot")).join(facts, "part"), "facts")
    # rows of frequent sets meet their job by broadcast: there are at most rows / chunk such sets
    hot = F.broadcast(facts.where("hot"))
    rest = rows.join(hot.select("keys"), "keys", "left_anti")
    owned = F.coalesce(F.col("held_until") > F.col("position"), F.lit(False)) | F.coalesce(F.col("shown_at") < F.col("position"), F.lit(False))

    def judged(df: DataFrame) -> DataFrame:
        quiet = F.col("snippet") | (~F.col("authoritative") & owned)
        fresh = F.col("known").isNull() & (F.col("node") == F.col("first_node"))
        df = df.withColumns({"quiet": quiet, "fresh": fresh, "owned": owned}).drop("keys", "hot", "large", "held_until", "shown_at")
        return df.withColumn("writes", F.col("fresh") | ~F.col("quiet")).withColumn("written", F.when(F.col("writes"), F.col("content_hash")))

    # the last hash written before a row: by the job's rows before it, else stored
    line, wrote_at = W.partitionBy("part"), F.when(F.col("written").isNotNull(), F.col("node"))
    light = judged(rest.join(facts.where("not large"), "keys"))
    light = _last(light, ["part"], "node", "written", "inside").withColumn("chunks", F.lit(None).cast("string"))
    light = light.withColumn("earlier", F.max_by("written", wrote_at).over(line.orderBy("position").rangeBetween(W.unboundedPreceding, -1)))
    # of a job with more rows than a chunk, in the row's chunk, else in its source's earlier chunks, else by earlier sources
    heavy = rows.join(hot, "keys").unionByName(rest.join(facts.where("large and not hot"), "keys"))
    heavy = stash(judged(heavy).withColumn("chunk", F.floor(F.col("ordinal") / chunk)), "heavy")
    when = F.when(F.col("written").isNotNull(), F.col("ordinal"))
    per_chunk = heavy.groupBy("part", "position", "chunk").agg(F.max_by("written", when).alias("end"))
    per_source = per_chunk.groupBy("part", "position").agg(F.max_by("end", F.when(F.col("end").isNotNull(), F.col("chunk"))).alias("source_end"))
    entry = _last(per_source, ["part"], "position", "source_end", "earlier").drop("source_end")
    entry = _last(per_chunk, ["part", "position"], "chunk", "end", "chunks").drop("end").join(entry, ["part", "position"])
    heavy = _last(heavy, ["part", "position", "chunk"], "ordinal", "written", "inside").join(entry, ["part", "position", "chunk"]).drop("chunk")
    rows = light.unionByName(heavy)
    start = F.coalesce("earlier", "stored_hash")
    before = F.coalesce(F.col("inside"), F.col("chunks"), start)
    change = F.when(F.col("fresh"), "new").when(F.col("quiet"), "unchanged").when(before == F.col("content_hash"), "unchanged").otherwise("updated")
    first_turn = F.col("known").isNull() & (F.shiftright("first_node", SHIFT) == F.col("position"))
    same = (~F.col("authoritative") & F.col("owned")) | F.col("snippet") | (start == F.col("content_hash"))
    review = F.when(first_turn, "new").when(same, "unchanged").otherwise("updated")
    changes = stash(rows.select("source_instance", "position", "ordinal", "node", "part", "canonical_url", "content_hash", "payload", "writes", change.alias("change"), review.alias("review")), "changes")
    named = ids.select("part", "job_id")
    wrote_at = F.when(F.col("writes"), F.col("node"))
    ended = changes.groupBy("part", "position").agg(F.max_by(F.struct("canonical_url", "content_hash", "payload"), wrote_at).alias("last"), F.max(wrote_at).alias("at"))
    ended = stash(ended.join(named, "part").drop("part"), "ended")

    # a job's status follows from its last event: a write makes it active, a closing ends it
    wrote = ended.where("at is not null").select("job_id", "position", F.lit(0).alias("kind"))
    events = wrote.unionByName(closings(members).withColumn("kind", F.lit(1)))
    line = W.partitionBy("job_id").orderBy("position", "kind")
    events = events.withColumn("prior", F.lag("kind").over(line)).join(old.select("job_id", "status"), "job_id", "left")
    ends = (F.col("kind") == 1) & F.coalesce(F.col("prior") == 0, F.col("status") == "active", F.lit(False))
    events = stash(events.select("job_id", "position", "kind", ends.alias("ends")), "events")
    outcome = events.groupBy("job_id").agg(F.max_by("kind", F.struct("position", "kind")).alias("last_kind"), F.bool_or("ends").alias("ended"))

    new = ended.groupBy("job_id").agg(F.max_by("last", "at").alias("n"), F.lit(True).alias("here"))
    new = new.select("job_id", F.col("n.canonical_url").alias("n_url"), F.col("n.content_hash").alias("n_hash"), F.col("n.payload").alias("n_payload"), "here")
    wrote_last, closed_last = F.coalesce(F.col("last_kind") == 0, F.lit(False)), F.coalesce(F.col("last_kind") == 1, F.lit(False))
    jobs = old.join(new, "job_id", "full").join(outcome, "job_id", "left").select(
        "job_id",
        F.coalesce("n_url", "canonical_url").alias("canonical_url"),
        F.coalesce("n_hash", "content_hash").alias("content_hash"),
        F.coalesce("n_payload", "payload").alias("payload"),
        F.when(wrote_last, F.lit("active")).when(closed_last, F.lit("closed")).otherwise(F.col("status")).alias("status"),
        F.coalesce("first_seen_at", F.lit(now)).alias("first_seen_at"),
        F.when(F.col("here"), F.greatest(F.col("last_seen_at"), F.lit(now))).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
        F.when(wrote_last, F.lit(None)).when(closed_last & F.col("ended"), F.lit(now)).otherwise(F.col("closed_at")).alias("closed_at"),
    )
    keys = part.select("part", F.explode("keys").alias("identity_key")).join(ids.select("part", "job_id"), "part").select("identity_key", "job_id").distinct()
    identities = follow(state.identities).join(keys.select("identity_key"), "identity_key", "left_anti").unionByName(keys)
    shot = changes.where(F.col("writes") & (F.coalesce("content_hash", F.lit("")) != "")).groupBy("part", "content_hash").agg(F.max("payload").alias("payload"))
    shot = shot.join(named, "part").select("job_id", "content_hash", "payload", F.lit(now).alias("first_seen_at"), F.lit(now).alias("last_seen_at"))
    snapshots = merge_snapshots(follow(state.snapshots).unionByName(shot))
    kept = members.where("not removed").select("source_instance", "job_id", "missing_runs", "last_seen_run", "close_threshold")

    # a source's first row with a key is the only one of its set that is no repeat of that key
    each = met.select("position", "node", "n", F.explode("keys").alias("key"))
    first = each.groupBy("position", "key").agg(F.min("node").alias("first"))
    repeats = each.join(first, ["position", "key"]).groupBy("position", "node", "n").agg(F.min("first").alias("first"))
    repeats = repeats.groupBy("position").agg(F.sum(F.col("n") - (F.col("first") == F.col("node")).cast("long")).alias("duplicate"))
    counts = turns.select("source_instance", "position").join(
        changes.groupBy("source_instance").agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("new", "updated", "unchanged")]), "source_instance", "left"
    )
    counts = counts.join(repeats, "position", "left")
    counts = counts.join(events.groupBy("position").agg(F.count_if("ends").alias("closed")), "position", "left").fillna(0).drop("position")
    return replace(state, jobs=jobs, identities=identities, snapshots=snapshots, memberships=kept), counts, changes.join(named, "part").select("source_instance", "ordinal", "job_id", "change", "review")
