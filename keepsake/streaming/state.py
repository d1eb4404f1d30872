"""Per-session state on a stream: last row, and rolling context, both with expiry."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from keepsake.operators import sessions as ss

TTL_MS = 14_400_000  # fixed value: four hours

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark) -> None:
    """State kept on executor disk with change logs in the checkpoint folder."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def _timeout(ttl_ms):
    return GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout


def previous_rows(stream: DataFrame, value: str, row_id: str, ttl_ms: int | None = TTL_MS) -> DataFrame:
    """(session_id, row id, previous, current) of a stream of (session_id, ts, row id, value).

    The state of a session is its last value, dropped ``ttl_ms`` after the last row.
    """

    def step(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        batch = pd.concat(list(batches)).sort_values(["ts", row_id])
        before = state.get[0] if state.exists else None
        values = batch[value].astype(str)
        state.update((values.iloc[-1],))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)
        previous = values.shift(1)
        previous.iloc[0] = before
        yield pd.DataFrame({"session_id": key[0], row_id: batch[row_id], "previous": previous, "current": values})

    kind = lambda c: stream.schema[c].dataType.simpleString()
    return stream.select("session_id", "ts", row_id, value).groupBy("session_id").applyInPandasWithState(
        step,
        outputStructType=f"session_id {kind('session_id')}, {row_id} {kind(row_id)}, previous string, current string",
        stateStructType="v string",
        outputMode="append",
        timeoutConf=_timeout(ttl_ms),
    )


def rolling_contexts(stream: DataFrame, ttl_ms: int | None = TTL_MS) -> DataFrame:
    """(session_id, turns, context), a row per session and batch, of a stream of (session_id, seq, summary).

    The state is the context itself, at most 1500 characters. Summaries are redacted before.
    """

    def step(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        text, turns = state.get if state.exists else ("", 0)
        for summary in pd.concat(list(batches)).sort_values("seq")["summary"]:
            joined = text + ss.JOIN + summary
            text = (summary if not text else joined[: ss.FOLD_TO] if len(joined) > ss.FOLD_OVER else joined)[: ss.CONTEXT_CAP]
            turns += 1
        state.update((text, turns))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({"session_id": [key[0]], "turns": [turns], "context": [text]})

    return stream.select("session_id", "seq", "summary").groupBy("session_id").applyInPandasWithState(
        step,
        outputStructType=f"session_id {stream.schema['session_id'].dataType.simpleString()}, turns bigint, context string",
        stateStructType="text string, turns bigint",
        outputMode="update",
        timeoutConf=_timeout(ttl_ms),
    )
