"""Jobs as a stream with state: newest status, progress, retries; state goes once the watermark has passed a job."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# How far a job is when a step begins, and which statuses mean that it runs or has ended.
STEPS = {"queued": 0, "starting": 0, "fetching": 5, "parsing": 15, "chunking": 30, "snapshot": 45, "embedding": 50, "saving": 85, "completed": 100}
RUNNING = ["queued", "running"]
ENDED = ["completed", "failed", "cancelled"]

_ROW = "{key} {kind}, status string, step string, percent int, retrying boolean, updated timestamp, events long, final boolean"


def percent(status: Column, step: Column) -> Column:
    """0 to 100: what the step stands for; an unknown step is 0, a completed job 100."""
    known = F.create_map(*[F.lit(x) for pair in STEPS.items() for x in pair])
    return F.when(status == "completed", 100).otherwise(F.coalesce(F.try_element_at(known, step), F.lit(0))).cast("int")


def progress(events: DataFrame, key: str, time: str, status: str, step: str, tie: str) -> DataFrame:
    """(key, status, step, percent, retrying, updated, events) of each job, in whatever order its events came.

    The newest event by ``time``, then ``tie``, tells status and step; a job is retrying if it runs and has failed
    before. A job is one row of sums and extremes, so events are added up before they are shuffled.
    """
    newest = F.max(F.struct(time, F.coalesce(F.col(tie).cast("string"), F.lit("")), F.col(status).alias("status"), F.col(step).alias("step"))).alias("newest")
    failed = F.min(F.when(F.col(status) == "failed", F.col(time))).alias("failed")
    found = events.groupBy(key).agg(newest, failed, F.count(F.lit(1)).alias("events"))
    retrying = F.coalesce(F.col("newest.status").isin(RUNNING) & (F.col("failed") < F.col(f"newest.{time}")), F.lit(False))
    return found.select(key, "newest.status", "newest.step", percent(F.col("newest.status"), F.col("newest.step")).alias("percent"), retrying.alias("retrying"), F.col(f"newest.{time}").alias("updated"), "events")


def progress_stream(events: DataFrame, key: str, time: str, status: str, step: str, tie: str, late: str = "1 hour", keep_seconds: int = 3600) -> DataFrame:
    """:func:`progress` as a stream, for update mode: a job's row whenever events of it came, and once more, ``final``,
    when the watermark (``late`` behind the newest event) has passed its last event by ``keep_seconds``. Its state is dropped with that.

    State is six values a job, whatever the number of its events. Events older than the watermark are left out.
    """
    kind = events.schema[key].dataType.simpleString()
    rows = events.select(F.col(key).alias("_key"), F.col(time).alias("_time"), F.col(status).alias("_status"), F.col(step).alias("_step"), F.col(tie).cast("string").alias("_tie"), percent(F.col(status), F.col(step)).alias("_percent"))

    def row(job: tuple, state: tuple, final: bool) -> pd.DataFrame:
        at, _, name, at_step, share, failed, count = state
        retrying = name in RUNNING and failed is not None and failed < at
        return pd.DataFrame({key: [job[0]], "status": [name], "step": [at_step], "percent": [share], "retrying": [retrying], "updated": [pd.Timestamp(at, unit="us")], "events": [count], "final": [final]})

    def update(job: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            yield row(job, state.get, True)
            state.remove()
            return
        held = state.get if state.exists else None
        for batch in batches:
            at = batch["_time"].astype("datetime64[us]").astype("int64")
            plain = lambda x: None if pd.isna(x) else x
            for k in range(len(batch)):
                now = (int(at.iloc[k]), plain(batch["_tie"].iloc[k]) or "", plain(batch["_status"].iloc[k]), plain(batch["_step"].iloc[k]), int(batch["_percent"].iloc[k]))
                failed = now[0] if now[2] == "failed" else None
                if held is None:
                    held = (*now, failed, 1)
                else:
                    first = min((x for x in (held[5], failed) if x is not None), default=None)
                    held = (*(max(held[:5], now, key=lambda x: (x[0], x[1], x[2] or "", x[3] or ""))), first, held[6] + 1)
        state.update(held)
        state.setTimeoutTimestamp(max(held[0] // 1000 + 1000 * keep_seconds, state.getCurrentWatermarkMs() + 1))
        yield row(job, held, False)

    state = "at long, tie string, status string, step string, percent int, failed long, events long"
    return rows.withWatermark("_time", late).groupBy("_key").applyInPandasWithState(update, _ROW.format(key=key, kind=kind), state, "update", GroupStateTimeout.EventTimeTimeout)
