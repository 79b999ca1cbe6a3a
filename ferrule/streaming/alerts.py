"""Alerts at most once an interval for each key, on streams and on tables; model cool-downs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..shared import ship

SECONDS, FORGOTTEN = 60, 3600
LEVELS = ("CRITICAL", "ERROR")


def alert_worthy(df: DataFrame, level: str = "level") -> DataFrame:
    return df.where(F.col(level).isin(*LEVELS))


def limited(events: DataFrame, key: str, ts: str = "ts", seconds: int = SECONDS) -> DataFrame:
    """key and ts of the events that are sent. An event that isn't sent doesn't put off the next.

    A key's times come to one task in order and stream through it; it holds the last time sent and nothing else, so a
    key may have any number of events. Null keys are a key, null times are left out.
    """
    ship(events.sparkSession)
    kind = dict(events.dtypes)[key]
    gap = seconds * 1_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[object, int] | None = None
        for b in batches:
            keys, times = b.column(0), b.column(1).to_numpy()
            sent: list[int] = []
            ends = pc.run_end_encode(keys).run_ends.to_numpy() if len(keys) else []
            at = 0
            for end in ends:
                k = keys[at].as_py()
                due = last[1] + gap if last is not None and last[0] == k else None
                i = at if due is None else at + int(np.searchsorted(times[at:end], due))
                while i < end:
                    sent.append(i)
                    last = (k, int(times[i]))
                    i += int(np.searchsorted(times[i:end], times[i] + gap))
                at = end
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(sent, pa.int64())), pa.array(times[sent])], [key, "t"])

    rows = events.where(F.col(ts).isNotNull()).select(key, F.unix_micros(F.col(ts).cast("timestamp")).alias("t"))
    out = rows.repartition(key).sortWithinPartitions(key, "t").mapInArrow(run, f"`{key}` {kind}, t bigint")
    return out.select(key, F.timestamp_micros("t").alias(ts))


def alert_sink(events: DataFrame, path: str, key: str, ts: str = "ts", level: str = "level", seconds: int = SECONDS) -> DataStreamWriter:
    """A writer that sends a stream's alerts, at most one an interval for each key, to a Parquet table, a batch at a time.

    A batch that is run again replaces what it wrote before. Delivery to a chat is a job that reads the table.
    """

    def send(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return limited_stream(alert_worthy(events, level), key, ts, seconds).writeStream.foreachBatch(send)


def limited_stream(events: DataFrame, key: str, ts: str = "ts", seconds: int = SECONDS, lateness: str = "10 seconds") -> DataFrame:
    """The same on a stream with state for each key: the last time sent, forgotten after an hour without one.

    Within a micro-batch events are taken in the order of ts; one later than the watermark is dropped, and one older
    than the last sent isn't sent.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        sent = []
        for t in sorted(x for f in frames for x in f[ts] if pd.notna(x)):
            micros = t.value // 1000
            if last is None or micros - last >= seconds * 1_000_000:
                sent.append(t)
                last = micros
        if last is not None:
            state.update((last,))
            until = max(last // 1000 + FORGOTTEN * 1000, state.getCurrentWatermarkMs() + 1)
            state.setTimeoutTimestamp(until)
        if sent:
            yield pd.DataFrame({key: [k[0]] * len(sent), ts: sent})

    kind = dict(events.dtypes)[key]
    return events.select(key, ts).withWatermark(ts, lateness).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {ts} timestamp", "last bigint", "append", GroupStateTimeout.EventTimeTimeout)


def cooldown(errors: Column) -> Column:
    """Seconds that a model rests after so many errors in a row."""
    return F.least(30 * errors, F.lit(600))


def model_states(outcomes: DataFrame, model: str = "model", ts: str = "ts", ok: str = "ok") -> DataFrame:
    """outcomes with error_count (errors since the last success), seconds of rest and cooldown_until after each of them.

    A success sets the count and the rest to none; the end of a rest leaves the count as it is. Outcomes are in the
    order of ts, a success after an error of the same time.
    """
    order = Window.partitionBy(model).orderBy(ts, ok).rowsBetween(Window.unboundedPreceding, 0)
    since = Window.partitionBy(model, "__run").orderBy(ts, ok).rowsBetween(Window.unboundedPreceding, 0)
    counted = outcomes.withColumn("__run", F.count_if(F.col(ok)).over(order)).withColumn("error_count", F.count_if(~F.col(ok)).over(since))
    rest = F.when(F.col("error_count") > 0, cooldown(F.col("error_count")))
    return counted.drop("__run").withColumns({"seconds": F.coalesce(rest, F.lit(0)), "cooldown_until": F.when(rest.isNotNull(), F.timestamp_micros(F.unix_micros(F.col(ts).cast("timestamp")) + rest * 1_000_000))})


def available(models: DataFrame, now: Column) -> DataFrame:
    """The first model in order that isn't resting; a rest that is over counts as available."""
    free = models.where(F.col("is_available") | (F.col("cooldown_until") <= now))
    return free.orderBy("rank").limit(1)
