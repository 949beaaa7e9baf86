"""STRM-1: token events to messages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def fold_tokens(events: DataFrame) -> DataFrame:
    """(session_id, content, stop_reason, closed, tokens) from (session_id, seq, token, stop_reason).

    The same plan serves batch and streaming (update mode).  Tokens are ordered by ``seq``,
    so arrival order does not matter; the end event carries the stop reason.
    """
    ordered = F.array_sort(F.collect_list(F.when(F.col("token").isNotNull(), F.struct("seq", "token"))))
    return events.groupBy("session_id").agg(
        F.array_join(F.transform(ordered, lambda t: t["token"]), "").alias("content"),
        F.max("stop_reason").alias("stop_reason"),
        F.max(F.col("stop_reason").isNotNull()).alias("closed"),
        F.count("token").alias("tokens"))


def fold_closed(events: DataFrame, delay: str = "10 minutes", idle: str = "30 minutes") -> DataFrame:
    """Append-mode form for long streams: a message is emitted, and its state dropped, once its
    session has been silent for ``idle`` and the watermark has passed."""
    watched = events.withWatermark("ts", delay)
    ordered = F.array_sort(F.collect_list(F.when(F.col("token").isNotNull(), F.struct("seq", "token"))))
    return (watched.groupBy("session_id", F.session_window("ts", idle).alias("w"))
            .agg(F.array_join(F.transform(ordered, lambda t: t["token"]), "").alias("content"),
                 F.max("stop_reason").alias("stop_reason"))
            .select("session_id", F.col("w.start").alias("started"), "content", "stop_reason"))


IDLE = "idle"


def close_early(events: DataFrame, delay: str = "10 minutes", idle_seconds: int = 1800) -> DataFrame:
    """Append-mode form that emits a message as soon as it is complete: (session_id, content, stop_reason).

    A message is complete when its end event and every ``seq`` from 1 up to it have arrived, in whatever order. Its parts
    are dropped then, and only a mark stays, so that repeated and late events of the session add nothing; the mark goes
    when the watermark is ``idle_seconds`` past the last event. A session that is silent so long without being complete
    is emitted with what has arrived and the stop reason ``idle``. Of events that repeat a ``seq`` the first one counts.
    """
    out = "session_id string, content string, stop_reason string"
    kept = "done boolean, seqs array<long>, tokens array<string>, stop string, end long, last long"

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, seqs, tokens, stop, end, last = state.get if state.exists else (False, [], [], None, -1, 0)
        if state.hasTimedOut:
            state.remove()
            if not done:
                text = "".join(t for _, t in sorted(zip(seqs, tokens)) if t is not None)
                yield pd.DataFrame([(key[0], text, stop or IDLE)], columns=["session_id", "content", "stop_reason"])
            return
        parts = dict(zip(seqs, tokens))
        for batch in batches:
            last = max(last, int(batch["ts"].max().timestamp() * 1000))
            if not done:
                for seq, token, reason in zip(batch["seq"], batch["token"], batch["stop_reason"]):
                    if int(seq) not in parts:
                        parts[int(seq)] = token if isinstance(token, str) else None
                        if isinstance(reason, str) and end < 0:
                            stop, end = reason, int(seq)
        if not done and end >= 0 and all(n in parts for n in range(1, end + 1)):
            text = "".join(parts[n] for n in range(1, end + 1) if parts[n] is not None)
            yield pd.DataFrame([(key[0], text, stop)], columns=["session_id", "content", "stop_reason"])
            done, parts = True, {}
        state.update((done, list(parts), list(parts.values()), stop, end, last))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + idle_seconds * 1000)
    watched = events.select("session_id", "seq", "token", "stop_reason", "ts").withWatermark("ts", delay)
    return watched.groupBy("session_id").applyInPandasWithState(fold, out, kept, "append", GroupStateTimeout.EventTimeTimeout)
