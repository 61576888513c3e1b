"""Streaming forms (T): late and repeated rows, the rolling day, activity blocks, archive merges."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import growing


def first_seen(stream: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Rows with a key not seen within the watermark."""
    return stream.withWatermark("timestamp", lateness).dropDuplicatesWithinWatermark(["tool", "dedup_key"])


def rolling_day(stream: DataFrame, lateness: str = "2 hours") -> DataFrame:
    """The last 24 hours, moved on every hour."""
    return stream.withWatermark("timestamp", lateness).groupBy(F.window("timestamp", "24 hours", "1 hour"), "tool").agg(F.sum("cost").alias("cost"), F.count("*").alias("calls"), F.sum("tokens").alias("tokens"))


def activity_blocks(stream: DataFrame, gap: str = "15 minutes", lateness: str = "2 hours") -> DataFrame:
    """Session windows; a gap of just 15 minutes still joins, where the batch form goes by whole minutes."""
    return stream.withWatermark("timestamp", lateness).groupBy(F.session_window("timestamp", gap), "session_key").agg(F.count("*").alias("calls"), F.sum("cost").alias("cost"))


def merge_batches(path: str, buckets: int = growing.BUCKETS) -> Callable[[DataFrame, int], None]:
    """For foreachBatch; each batch rewrites those buckets of the archive that its keys change.

    A repeated batch changes nothing; a key that comes again in a later batch is one row.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        growing.upsert(batch.sparkSession, path, batch, batch_id, buckets=buckets)

    return write


#: A usage alert's thresholds and the least time between two alerts.
ALERT_COST, ALERT_TOKENS, ALERT_CALLS, COOLDOWN_MS = 1.0, 100_000, 25, 30 * 60_000
State = tuple[float, int, int, int]


def alert_step(state: State | None, total: tuple[float, int, int], now_ms: int) -> tuple[State, tuple[float, int, int] | None]:
    """The next (baseline cost, tokens, calls, time of the last alert) and what an alert reports.

    Small growth adds up, as the baseline moves only with an alert; totals that shrink set it anew, and
    within the cooldown it stays where it is.
    """
    if state is None or any(t < b for t, b in zip(total, state[:3], strict=True)):
        return (*total, -COOLDOWN_MS if state is None else state[3]), None
    grown = tuple(t - b for t, b in zip(total, state[:3], strict=True))
    if now_ms - state[3] < COOLDOWN_MS or not (grown[0] >= ALERT_COST or grown[1] >= ALERT_TOKENS or grown[2] >= ALERT_CALLS):
        return state, None
    return (*total, now_ms), grown


def _alerts(key, frames, state):
    import pandas as pd

    cost, tokens, calls, baseline = state.get if state.exists else (0.0, 0, 0, None)
    for frame in frames:
        cost, tokens, calls = cost + float(frame["cost"].sum()), tokens + int(frame["tokens"].sum()), calls + int(frame["calls"].sum())
    last = tuple(baseline) if baseline is not None else (0.0, 0, 0, -COOLDOWN_MS)
    after, alert = alert_step(last, (cost, tokens, calls), state.getCurrentProcessingTimeMs())
    state.update((cost, tokens, calls, after))
    if alert:
        yield pd.DataFrame([(key[0], *alert)], columns=["tool", "cost", "tokens", "calls"])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each tool of a task."""
    parts = [pa.Table.from_batches([b]).group_by("tool").aggregate([("cost", "sum"), ("tokens", "sum"), ("cost", "count")]) for b in batches if b.num_rows]
    if parts:
        total = pa.concat_tables(parts).group_by("tool").aggregate([("cost_sum", "sum"), ("tokens_sum", "sum"), ("cost_count", "sum")])
        yield from total.select(["tool", "cost_sum_sum", "tokens_sum_sum", "cost_count_sum"]).rename_columns(["tool", "cost", "tokens", "calls"]).to_batches()


def usage_alerts(stream: DataFrame) -> DataFrame:
    """By tool, a row whenever what was used since the last alert passes a threshold.

    Tasks send on one row for each tool, so the few keys carry no load; state is a few numbers for each tool.
    """
    calls = stream.select("tool", F.coalesce(F.col("cost").cast("double"), F.lit(0.0)).alias("cost"), F.coalesce(F.col("tokens").cast("long"), F.lit(0)).cast("long").alias("tokens"))
    return calls.mapInArrow(_sums, "tool string, cost double, tokens long, calls long").groupBy("tool").applyInPandasWithState(
        _alerts, "tool string, cost double, tokens long, calls long", "cost double, tokens long, calls long, baseline struct<cost:double,tokens:long,calls:long,at:long>", "append", "NoTimeout"
    )
