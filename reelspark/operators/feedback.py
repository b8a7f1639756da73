"""Thumbs feedback and favourites as batch state (the stream form is in ``streaming``).

Vote rule per (session, movie): the same vote again clears it, the other vote
replaces it. Folding a vote sequence therefore leaves the last vote set exactly when
the trailing run of equal votes has odd length. That takes two aggregates, combined before
their shuffles, and one join of the events by key, whose skew AQE can split; no key's
events are sorted in one task:

1. per key: latest +1 event and latest -1 event (partial max, combinable);
2. the later of the two is the last vote, the other bounds its trailing run;
3. per key: number of events after that bound (partial count, combinable).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ("session_id", "movieId")


def _ord(df: DataFrame, order: tuple[str, ...]):
    return F.struct(*[F.col(c) for c in order])


def feedback_state(events: DataFrame, key: tuple[str, ...] = KEY,
                   order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Final vote per key: (key..., vote) for keys whose vote is still set."""
    o = _ord(events, order)
    # any vote that is not positive counts as -1; an event without a vote is none
    events = events.where(F.col("vote").isNotNull())
    ends = events.groupBy(*key).agg(
        F.max(F.when(F.col("vote") > 0, o)).alias("last_pos"),
        F.max(F.when(F.col("vote") <= 0, o)).alias("last_neg"),
    )
    pos_last = F.col("last_neg").isNull() | (F.col("last_pos").isNotNull() & (F.col("last_pos") > F.col("last_neg")))
    ends = ends.select(
        *key,
        F.when(pos_last, F.lit(1)).otherwise(F.lit(-1)).alias("last_vote"),
        F.when(pos_last, F.col("last_neg")).otherwise(F.col("last_pos")).alias("bound"),
    )
    ev = events.select(*key, o.alias("o"))
    runs = (ev.join(ends, list(key))
            .groupBy(*key, "last_vote")
            .agg(F.count_if(F.col("bound").isNull() | (F.col("o") > F.col("bound"))).alias("run")))
    return runs.where(F.col("run") % 2 == 1).select(*key, F.col("last_vote").cast("int").alias("vote"))


def liked_disliked(state: DataFrame) -> DataFrame:
    """Per session: sorted liked and disliked ids (bounded by the catalog size)."""
    return state.groupBy("session_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("vote") > 0, F.col("movieId")))).alias("liked"),
        F.array_sort(F.collect_list(F.when(F.col("vote") < 0, F.col("movieId")))).alias("disliked"),
    )


def feedback_counts(state: DataFrame) -> DataFrame:
    return state.groupBy("session_id").agg(
        F.count_if(F.col("vote") > 0).alias("n_liked"),
        F.count_if(F.col("vote") < 0).alias("n_disliked"),
    )


def feedback_snapshot(state: DataFrame) -> DataFrame:
    """One hashable key per session: sorted 'movie:vote' pairs."""
    pairs = F.array_sort(F.collect_list(F.struct("movieId", "vote")))
    return state.groupBy("session_id").agg(
        F.array_join(F.transform(pairs, lambda p: F.concat(p["movieId"].cast("string"), F.lit(":"),
                                                           p["vote"].cast("string"))), ",").alias("snapshot"))


def favourites_state(events: DataFrame, cap: int = 10,
                     order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Favourites list per session for add / remove / clear events: (session_id, slot, movieId).

    An add puts a movie at the end unless it is in the list or the list has ``cap``
    movies, a remove takes it out, a clear empties the list. Whether an add is refused
    depends on all events before it, so a session's events are folded in order: they are
    dealt by session, sorted by Spark within partitions (which spills), and streamed; a task
    holds the list of one session, never its events. Events before a session's last clear
    can't matter and are dropped before the shuffle of the rest. Unknown actions are an
    error; a null movieId is ignored."""
    o = _ord(events, order)
    last_clear = events.where(F.col("action") == "clear").groupBy("session_id").agg(F.max(o).alias("clear_o"))
    after = (events.withColumn("_o", o).join(last_clear, "session_id", "left")
             .where((F.col("clear_o").isNull() | (F.col("_o") > F.col("clear_o"))))
             .withColumn("action", F.when(F.col("action").isin("add", "remove"), F.col("action"))
                         .otherwise(F.raise_error(F.concat(F.lit("unknown favourites action: "),
                                                           F.coalesce("action", F.lit("null"))))))
             .where(F.col("movieId").isNotNull()))

    def fold(batches):
        session, ids = None, []

        def out():
            return pd.DataFrame({"session_id": session, "slot": range(1, len(ids) + 1), "movieId": ids})

        for pdf in batches:
            done = []
            for s, m, action in zip(pdf["session_id"], pdf["movieId"], pdf["action"]):
                if s != session:
                    if ids:
                        done.append(out())
                    session, ids = s, []
                if action == "remove":
                    ids = [x for x in ids if x != m]
                elif m not in ids and len(ids) < cap:
                    ids = [*ids, m]
            if done:
                yield pd.concat(done, ignore_index=True)
        if ids:
            yield out()

    return (after.select("session_id", "movieId", "action", "_o").repartition("session_id")
            .sortWithinPartitions("session_id", "_o").select("session_id", "movieId", "action")
            .mapInPandas(fold, "session_id long, slot int, movieId long"))
