"""Feedback and favourites as Structured Streaming state.

Votes: keyed by (session, movie), the state is the current vote. The keys are dealt to buckets and Spark's
state is that of a bucket, the votes of its keys, so that a call folds the events of many keys in numpy: a
call for each key took a millisecond for one event. Within a micro-batch a
key's events are applied in (ts, event_id) order; across batches the state carries over,
so the stream's final state equals the batch fold when events arrive in time order. A
cleared vote leaves no state, and events without a session or movie have no key. State expires ``timeout_ms`` (event time, 30 days by default)
after a key's last event, emitting a cleared row; with that timeout Spark drops events that
are older than the watermark. With ``timeout_ms=None`` nothing expires and late events are
applied on arrival. Events without a vote are ignored; events without a time come first
in their batch.

The final table of an update log is the row of the last batch per key: with late events the
latest time need not be the latest state.

Favourites: keyed by session, the state is the ordered list (at most ``cap`` ids): add
(repeats ignored, refused when full), remove, clear.
"""

from __future__ import annotations

import json
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

VOTE_OUT = "session_id long, movieId long, vote int, last_ts timestamp, last_id long"
#: Rows of int64: session, movie, vote, last time (microseconds), last id, expiry (ms).
VOTE_STATE = "votes binary"
VOTE_BUCKETS = 256
NO_TIME = np.iinfo(np.int64).min
NEVER = np.iinfo(np.int64).max
FAV_OUT = "session_id long, favourites string, last_ts timestamp, last_id long"
FAV_STATE = "ids string, last_ts timestamp, last_id long"


#: State of a key lives so long after its last event, unless a query says otherwise.
DEFAULT_TIMEOUT_MS = 30 * 24 * 3600 * 1000


def _expire(state, last_ts, timeout_ms: int | None) -> None:
    """Sets when the state expires; an event without a time before any watermark sets nothing."""
    if timeout_ms is None:
        return
    now = state.getCurrentWatermarkMs()
    at = now if last_ts is None else int(pd.Timestamp(last_ts).timestamp() * 1000)
    if at > 0:
        state.setTimeoutTimestamp(max(at + timeout_ms, now + 1))


def _fold_votes(kept: np.ndarray, events: np.ndarray, now: int, timeout_ms: int | None):
    """State rows and event rows (session, movie, vote, time, id, -) -> (rows to emit, new state rows).

    A kept vote is folded like an event before all others: a key's vote is that of its last event
    where the trailing run of equal votes is odd, and none where it is even."""
    rows = np.concatenate([kept, events])
    new = np.arange(len(rows)) >= len(kept)
    order = np.lexsort((rows[:, 4], rows[:, 3], new, rows[:, 1], rows[:, 0]))
    rows, new = rows[order], new[order]
    first = np.flatnonzero(np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1))[:len(rows)])
    end = np.append(first[1:], len(rows))
    out = rows[end - 1].copy()
    other = np.where(rows[:, 2] != np.repeat(out[:, 2], end - first), np.arange(len(rows)), -1)
    run = end - 1 - np.maximum(np.maximum.reduceat(other, first), first - 1)
    out[:, 2] *= run % 2
    changed = new[end - 1]
    at = np.where(out[:, 3] == NO_TIME, now, out[:, 3] // 1000)
    expires = np.full(len(out), NEVER) if timeout_ms is None else np.where(at > 0, np.maximum(at + (timeout_ms or 0), now + 1), NEVER)
    out[:, 5] = np.where(changed, expires, out[:, 5])
    expired = ~changed & (out[:, 5] < now)
    out[expired, 2] = 0
    return out[changed | expired], out[out[:, 2] != 0]


def _vote_fn(timeout_ms: int | None):
    def fn(key, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kept = np.frombuffer(bytes(state.get[0]), np.int64).reshape(-1, 6) if state.exists else np.empty((0, 6), np.int64)
        events = np.empty((0, 6), np.int64)
        if not state.hasTimedOut:
            batch = pd.concat(list(pdfs), ignore_index=True)
            batch = batch[batch["vote"].notna()]
            events = np.zeros((len(batch), 6), np.int64)
            events[:, 0], events[:, 1], events[:, 4] = batch["session_id"], batch["movieId"], batch["event_id"]
            events[:, 2] = np.where(batch["vote"] > 0, 1, -1)
            events[:, 3] = batch["ts"].to_numpy("datetime64[us]").astype(np.int64)         # NaT is the least number
        if not len(kept) and not len(events):
            return
        now = 0 if timeout_ms is None else state.getCurrentWatermarkMs()
        emit, left = _fold_votes(kept, events, now, timeout_ms)
        if len(left):
            state.update((left.tobytes(),))
            if (left[:, 5] < NEVER).any():
                state.setTimeoutTimestamp(max(int(left[:, 5].min()), now + 1))
        elif state.exists:
            state.remove()
        if len(emit):
            yield pd.DataFrame({"session_id": emit[:, 0], "movieId": emit[:, 1], "vote": emit[:, 2].astype(np.int32),
                                "last_ts": emit[:, 3].astype("datetime64[us]"), "last_id": emit[:, 4]})
    return fn


def _event_time(events: DataFrame) -> DataFrame:
    """Watermarks need a TIMESTAMP column; a TIMESTAMP_NTZ is read as UTC wall time."""
    if dict(events.dtypes).get("ts") == "timestamp_ntz":
        return events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events


def _timeout(timeout_ms):
    return GroupStateTimeout.NoTimeout if timeout_ms is None else GroupStateTimeout.EventTimeTimeout


def feedback_state_stream(events: DataFrame, watermark: str = "1 hour",
                          timeout_ms: int | None = DEFAULT_TIMEOUT_MS) -> DataFrame:
    """Streaming (session_id, movieId, vote, last_ts, last_id) updates; vote 0 = cleared or
    expired."""
    keyed = _event_time(events).withWatermark("ts", watermark).where(F.col("session_id").isNotNull() & F.col("movieId").isNotNull())
    return (keyed.withColumn("bucket", F.pmod(F.xxhash64("session_id", "movieId"), F.lit(VOTE_BUCKETS))).groupBy("bucket")
            .applyInPandasWithState(_vote_fn(timeout_ms), VOTE_OUT, VOTE_STATE, "update", _timeout(timeout_ms)))


def _fav_fn(cap: int, timeout_ms: int):
    def fn(key, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        session_id = int(key[0])
        if state.hasTimedOut:
            state.remove()
            return
        ids, last_ts, last_id = state.get if state.exists else ("[]", None, None)
        fav = json.loads(ids)
        batch = pd.concat(list(pdfs), ignore_index=True).sort_values(["ts", "event_id"], kind="stable", na_position="first")
        for action, mid, ts, eid in zip(batch["action"], batch["movieId"], batch["ts"], batch["event_id"]):
            mid = int(mid) if pd.notna(mid) else None
            if action == "add" and mid is not None and mid not in fav and len(fav) < cap:
                fav.append(mid)
            elif action == "remove" and mid in fav:
                fav.remove(mid)
            elif action == "clear":
                fav = []
            elif action not in ("add", "remove"):
                raise ValueError(f"unknown favourites action: {action}")
            last_ts, last_id = None if pd.isna(ts) else ts, int(eid)
        if fav:
            state.update((json.dumps(fav), last_ts, last_id))
            _expire(state, last_ts, timeout_ms)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"session_id": [session_id], "favourites": [",".join(map(str, fav))],
                            "last_ts": [last_ts], "last_id": [last_id]})
    return fn


def favourites_stream(events: DataFrame, cap: int = 10, watermark: str = "1 hour",
                      timeout_ms: int | None = DEFAULT_TIMEOUT_MS) -> DataFrame:
    """Streaming (session_id, favourites 'id,id,..', last_ts, last_id) updates."""
    return (_event_time(events).withWatermark("ts", watermark).groupBy("session_id")
            .applyInPandasWithState(_fav_fn(cap, timeout_ms), FAV_OUT, FAV_STATE, "update", _timeout(timeout_ms)))


def latest_per_key(updates: DataFrame, key: list[str]) -> DataFrame:
    """Final value per key from an update-mode log with the number of its micro-batch in
    ``_batch``: the row of the latest batch (one per key and batch)."""
    cols = [c for c in updates.columns if c not in (*key, "_batch")]
    agg = updates.groupBy(*key).agg(F.max_by(F.struct(*cols), "_batch").alias("_r"))
    return agg.select(*key, *[F.col(f"_r.{c}").alias(c) for c in cols])


def run_in_chunks(spark, batch_df: DataFrame, schema, build, key: list[str], src: str, sink: str,
                  checkpoint: str, chunks: int = 4, order: str = "ts") -> DataFrame:
    """Drive a stream over ``batch_df`` delivered in ``chunks`` time-ordered micro-batches:
    each chunk is appended to the source folder, then the query processes what is new.
    Returns the final state table (latest update per key)."""
    bounds = batch_df.agg(F.min(order).alias("lo"), F.max(order).alias("hi")).first()
    lo, hi = bounds["lo"], bounds["hi"]
    q = None
    try:
        step = (hi - lo) / chunks if lo is not None else None
        for i in range(chunks if lo is not None else 1):
            a = lo + step * i if lo is not None else None
            cond = F.lit(True) if i == 0 else (F.col(order) > F.lit(a))
            if i < chunks - 1 and lo is not None:
                cond = cond & (F.col(order) <= F.lit(lo + step * (i + 1)))
            if i == 0:                       # rows without a time come first
                cond = cond | F.col(order).isNull()
            batch_df.where(cond).write.mode("append").parquet(src)
            if q is None:   # update mode into an append-only log; the final state is read off it
                stream = spark.readStream.schema(schema).parquet(src)   # a chunk arrives whole in one micro-batch
                q = (build(stream).writeStream.outputMode("update")
                     .foreachBatch(lambda df, i: df.withColumn("_batch", F.lit(i).cast("long")).write.mode("append").parquet(sink))
                     .option("checkpointLocation", checkpoint).start())
            q.processAllAvailable()
    finally:
        if q is not None:
            q.stop()
    return latest_per_key(spark.read.parquet(sink), key)
