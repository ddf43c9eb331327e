"""The data of figures: traces within a viewport, limits of axes, and shaded spans. Drawing is left to the reader's tools."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breathmark.config import Config
from breathmark.operators import intervals
from breathmark.schema import CHANNELS, REC


def traces(signals: DataFrame, config: Config, low: float, high: float) -> DataFrame:
    """``t, channel, value`` of every channel with samples, from second ``low`` to ``high``, both included."""
    t = F.col("k") / F.lit(float(config.fs))
    values = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("value")) for c in CHANNELS])
    inside = signals.where(t.between(low, high)).select(*REC, t.alias("t"), F.inline(values))
    return inside.where(F.col("value").isNotNull())


def limits(signals: DataFrame) -> DataFrame:
    """Mean, spread, least and greatest value of each channel with samples, by recording."""
    values = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("value")) for c in CHANNELS])
    long = signals.select(*REC, F.inline(values)).where(F.col("value").isNotNull())
    return long.groupBy(*REC, "channel").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("least"), F.max("value").alias("greatest")
    )


def event_spans(events: DataFrame, low: float, high: float) -> DataFrame:
    """``left, right``: the part of each event that lies within the viewport."""
    seen = events.where((F.col("end_t") >= low) & (F.col("start_t") <= high))
    return seen.select(*REC, "type", F.greatest("start_t", F.lit(float(low))).alias("left"), F.least("end_t", F.lit(float(high))).alias("right"))


def mask_spans(cond: DataFrame, config: Config) -> DataFrame:
    """``left, right`` of each run of flagged grid points, of one point too, in seconds."""
    step = F.lit(float(config.grid_step_sec))
    found = intervals.runs(cond, F.col("flag"), "g", 1)
    return found.select(*REC, (F.col("first") * step).alias("left"), (F.col("last") * step).alias("right"))
