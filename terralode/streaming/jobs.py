"""Stateful work on event streams: windows, rate limits, alerts and status checks. Windows, sessions and status checks have
batch twins among the registered queries; alerts have none, and rate_limit_window counts all events, not the allowed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _timed(events: DataFrame) -> DataFrame:
    """Watermarks need timestamps with a time zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums in tumbling windows; a window is closed once the watermark has passed it."""
    rows = _timed(events).withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "event_type")
    return rows.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "2 hours") -> DataFrame:
    rows = _timed(events).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def rate_limited(requests: DataFrame, limit: int = 100, seconds: int = 60) -> DataFrame:
    """Whether each request of a key is within its limit of the last seconds: (key, ts, allowed, remaining, reset), reset
    being when the oldest request that counts drops out. Only allowed requests count. The state of a key is the times of its last `limit` allowed requests at most; a key that
    is silent for a window is forgotten."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held: list[float] = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values("ts")
        allowed, remaining, reset = [], [], []
        for at in rows["ts"].map(lambda t: t.timestamp()):
            held = [h for h in held if h > at - seconds]
            allowed.append(len(held) < limit)
            if allowed[-1]:
                held.append(at)
            remaining.append(limit - len(held))
            reset.append(pd.Timestamp((held[0] if held else at) + seconds, unit="s"))
        state.update((held,))
        state.setTimeoutDuration(seconds * 1000)
        yield pd.DataFrame({"key": key[0], "ts": rows["ts"].to_numpy(), "allowed": allowed, "remaining": remaining, "reset": reset})

    return requests.groupBy("key").applyInPandasWithState(
        step, "key string, ts timestamp, allowed boolean, remaining int, reset timestamp", "held array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def new_alerts(scored: DataFrame, active: DataFrame, key: str = "zona_id") -> DataFrame:
    """Critical and high rows of keys without an active alert."""
    known = active.where("activa").select(key).distinct()
    return scored.where(F.col("nivel").isin("critico", "alto")).join(known, key, "left_anti")


def alert_job(scored: DataFrame, read_active: Callable[[], DataFrame], append: Callable[[DataFrame], None], checkpoint: str, at: str = "ts") -> StreamingQuery:
    """Raises alerts from what has come in since the last run, once for a key while its alert is active: of a key's rows
    the most severe, and of these the latest by the column at, if there is such a column."""
    rank = [(F.col("nivel") == "critico").alias("severe"), *([F.col(at).alias("at")] if at in scored.columns else [])]

    def batch(df: DataFrame, _: int) -> None:
        worst = new_alerts(df, read_active()).groupBy(F.col("zona_id").alias("key")).agg(F.max_by(F.struct(*df.columns), F.struct(*rank)).alias("row"))
        append(worst.select("row.*"))

    return scored.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def illegal_transitions(history: DataFrame, legal: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Steps (before, after) of a key's history that the table of legal ones doesn't have."""
    from pyspark.sql import Window

    steps = history.withColumn("before", F.lag("estado").over(Window.partitionBy(key).orderBy(*order))).where("before is not null")
    return steps.withColumnRenamed("estado", "after").join(legal, ["before", "after"], "left_anti")
