"""Runs of failed heartbeats in event time, whatever order the events arrive in.

State is keyed by (shard of targets, time bucket) and lives in Spark's state store. A bucket
holds its events until the watermark has passed its end, so an event that is late
by less than the watermark's delay is put where it belongs. Then a timer fires, the bucket is cut
into the pieces that each target's neighbouring buckets need, and its state goes away. What comes
later than that is handed out as a dead letter instead of being lost.

A shard's targets are handled at once in arrays, as a call per target and bucket costs
far more than its few events. A target's work is spread over its buckets, so one with a third of all events is
many tasks; pieces, at most a few rows a bucket, are joined to runs over bucket borders by the
chunked running scan of ``operators.ordered``.

Buckets close when the watermark moves. Events without a target move it as well:
a poller that sends one such tick a round closes the buckets of silent targets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import Running, running

PIECE_SCHEMA = "target bigint, bucket bigint, kind string, part int, length bigint, first_us bigint, last_us bigint, tie bigint"
STATE_SCHEMA = "events binary"
DEAD = ("LATE", "NO TIME")
#: Groups that the targets are dealt to in each bucket. Fixed for the life of a checkpoint, as state is keyed by them.
SHARDS = 256


def _bucket_step(width: int, threshold: int) -> Callable:
    """The state function of one (shard, bucket). All that it needs is in here, as it travels to the workers.

    An event is four numbers: target, microseconds, tie, and flags (1: failed, 2: without a tie).
    """

    def step(key, frames, state):
        import numpy as np
        import pandas as pd

        names = ["target", "bucket", "kind", "part", "length", "first_us", "last_us", "tie"]
        shard, bucket = (None if k is None or k != k else int(k) for k in key)

        def frame(target, kind, part, length, first, last, tie, timed, tied):
            """Rows of one array a column; where not ``timed`` and ``tied`` the times and the tie are null."""
            whole = np.zeros(target.size, dtype=bool)
            columns = (
                pd.arrays.IntegerArray(target, whole),
                pd.arrays.IntegerArray(np.full(target.size, bucket or 0), np.full(target.size, bucket is None)),
                kind,
                part.astype(np.int32),
                pd.arrays.IntegerArray(length, whole),
                pd.arrays.IntegerArray(first, ~timed),
                pd.arrays.IntegerArray(last, ~timed),
                pd.arrays.IntegerArray(tie, ~tied),
            )
            return pd.DataFrame(dict(zip(names, columns)))

        def pieces(events):
            """Each target's runs: its head and tail may go on in other buckets, those between are complete."""
            target, at, tie, flags = events[np.lexsort((events[:, 2], (events[:, 3] & 2) == 0, events[:, 1], events[:, 0]))].T
            bad = (flags & 1) == 1
            opens = np.r_[True, target[1:] != target[:-1]]
            closes = np.r_[opens[1:], True]
            starts = np.flatnonzero(bad & (opens | ~np.r_[False, bad[:-1]]))
            ends = np.flatnonzero(bad & (closes | ~np.r_[bad[1:], False])) + 1
            first, last = np.flatnonzero(opens), np.flatnonzero(closes) + 1
            # Of each target: where its head ends and its tail begins.
            head, tail = first.copy(), last.copy()
            owner = np.cumsum(opens)[starts] - 1
            at_first, at_last = starts == first[owner], ends == last[owner]
            head[owner[at_first]] = ends[at_first]
            tail[owner[at_last]] = starts[at_last]
            whole = head == last
            inner = ~at_first & ~at_last & (ends - starts >= threshold)
            lo = np.concatenate([first, tail[~whole], starts[inner]])
            hi = np.concatenate([head, last[~whole], ends[inner]])
            part = np.repeat([0, 1, 2], [first.size, int((~whole).sum()), int(inner.sum())])
            kind = np.concatenate([np.where(whole, "ALL", "HEAD"), np.array(["HEAD", "TAIL", "RUN"])[part[first.size :]]]).astype(object)
            owned = np.concatenate([target[first], target[first[~whole]], target[starts[inner]]])
            some, none = hi > lo, np.zeros(lo.size, dtype=np.int64)
            return frame(owned, kind, part, hi - lo, at[np.minimum(lo, at.size - 1)], at[hi - 1], none, some, none > 0)

        def dead(kind, timed):
            """Every event of the call as a dead letter."""
            for f in frames:
                us, tie = f["us"].to_numpy(np.int64), f["tie"].to_numpy(np.int64)
                one = np.ones(us.size, dtype=np.int64)
                tied = (f["flags"].to_numpy(np.int64) & 2) == 0
                yield frame(f["target"].to_numpy(np.int64), np.full(us.size, kind, dtype=object), 3 * one, one, us, us, tie, np.full(us.size, timed), tied)

        if shard is None:
            for _ in frames:
                pass
            return
        if bucket is None:
            yield from dead("NO TIME", False)
            return
        end = (bucket + width) // 1000
        held = np.frombuffer(state.get[0], dtype=np.int64).reshape(-1, 4) if state.exists else np.empty((0, 4), dtype=np.int64)
        if state.hasTimedOut or end < state.getCurrentWatermarkMs():
            if len(held):
                yield pieces(held)
            if state.exists:
                state.remove()
            if not state.hasTimedOut:
                yield from dead("LATE", True)
            return
        new = [np.stack([f[c].to_numpy(np.int64) for c in ("target", "us", "tie", "flags")], axis=1) for f in frames]
        state.update((np.concatenate([held, *new]).tobytes(),))
        state.setTimeoutTimestamp(int(end))

    return step


def event_time_pieces(
    stream: DataFrame, key: str, ts: str, tie: str, failed: str, late: str, bucket_seconds: int = 3600, threshold: int = 3, shards: int = SHARDS
) -> DataFrame:
    """Stream of pieces (``PIECE_SCHEMA``) of closed buckets, and of dead letters (kind ``LATE`` or ``NO TIME``).

    ``failed`` is a SQL condition; null counts as not failed. ``late`` is the
    watermark's delay. Events of one target are ordered by (ts, tie), both whole
    numbers of 64 bits at most, those without a tie first. Events without a key only move the watermark.
    The targets are dealt to ``shards`` groups by their hash; a group's events of one bucket meet in one call.
    """
    width = bucket_seconds * 1_000_000
    time = F.col(ts).cast("timestamp")
    us = F.unix_micros(time)
    # Each event goes by the watermark with its time, to move it, and again without. Spark drops rows that are later than
    # the watermark; a row without a time is none, so the events themselves all reach the state function, which tells late ones.
    none = F.lit(None).cast("timestamp")
    twice = F.explode(F.when(time.isNull(), F.array(none)).otherwise(F.array(time, none))).alias("clock")
    target, order, nothing = F.col(key).cast("bigint"), F.col(tie).cast("bigint"), F.lit(0).cast("bigint")
    # No value is null: pandas would make floats of a column, which do not hold 64 bits.
    rows = stream.select(
        F.when(target.isNotNull(), F.pmod(F.xxhash64(target), F.lit(shards))).alias("shard"),
        (us - F.pmod(us, F.lit(width))).alias("bucket"),
        F.coalesce(target, nothing).alias("target"),
        F.coalesce(us, nothing).alias("us"),
        F.coalesce(order, nothing).alias("tie"),
        (F.coalesce(F.expr(failed), F.lit(False)).cast("bigint") + 2 * order.isNull().cast("bigint")).alias("flags"),
        twice,
    )
    return (
        rows.withWatermark("clock", late)
        .where("clock IS NULL")
        .groupBy("shard", "bucket")
        .applyInPandasWithState(_bucket_step(width, threshold), PIECE_SCHEMA, STATE_SCHEMA, "append", "EventTimeTimeout")
    )


def failure_runs(pieces: DataFrame, threshold: int = 3, **options) -> DataFrame:
    """Rows (target, run_start, run_end, run_length) of runs of at least ``threshold`` failures in the closed buckets.

    Each tail opens a run that the next buckets continue until a head ends it; runs
    are numbered by the tails before them, so they form by a partial aggregation.
    ``options`` go to ``ordered.running``.
    """
    border = pieces.where(F.col("kind").isin("ALL", "HEAD", "TAIL")).select("target", "bucket", "part", "kind", "length", "first_us", "last_us")
    opens = {"_island": Running("count", F.when(F.col("kind") == "TAIL", 1))}
    joined = running(border, ["target"], ["bucket", "part"], opens, **options).where("length > 0")
    crossing = joined.groupBy("target", "_island").agg(
        F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.sum("length").alias("length")
    )
    inside = pieces.where(F.col("kind") == "RUN")
    columns = ["target", "first_us", "last_us", "length"]
    found = crossing.select(columns).unionByName(inside.select(columns)).where(F.col("length") >= threshold)
    return found.select(
        "target",
        F.timestamp_micros("first_us").cast("timestamp_ntz").alias("run_start"),
        F.timestamp_micros("last_us").cast("timestamp_ntz").alias("run_end"),
        F.col("length").alias("run_length"),
    )


def dead_letters(pieces: DataFrame) -> DataFrame:
    """Rows (target, ts, tie, reason) of the events that came after their bucket was closed, or had no time."""
    rows = pieces.where(F.col("kind").isin(*DEAD))
    return rows.select("target", F.timestamp_micros("first_us").cast("timestamp_ntz").alias("ts"), "tie", F.col("kind").alias("reason"))
