"""Interval algebra: runs, mapping to samples, overlap, padding, merging, masks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from breathmark.config import Config, half_up
from breathmark.operators.stretches import STRETCH, carried, numbered_groups
from breathmark.schema import REC, SHORT

#: Seconds of a bin under which spans meet.
BIN = 300.0
EVENT = [*REC, "type", "start_idx", "end_idx", "start_t", "end_t"]


def runs(points: DataFrame, flag: Column, pos: str, min_points: int, block: int = STRETCH) -> DataFrame:
    """``first, last, n`` of each run of neighbouring positions where ``flag``; shorter ones than ``min_points`` go.

    Runs are found within blocks of ``block`` positions. Only those that touch an edge of theirs, two a block at most, meet by recording to be stitched.
    """
    true = points.where(F.coalesce(flag, F.lit(False))).select(*REC, F.col(pos).cast("long").alias("p"))
    true = true.withColumn("block", F.floor(F.col("p") / F.lit(block)))
    island = F.col("p") - F.row_number().over(Window.partitionBy(*REC, "block").orderBy("p"))
    pieces = true.withColumn("island", island).groupBy(*REC, "block", "island").agg(F.min("p").alias("first"), F.max("p").alias("last"), F.count(F.lit(1)).alias("n"))
    start = F.col("block") * block
    edge = (F.col("first") == start) | (F.col("last") == start + block - 1)
    # Pieces within a block keep it as their part; all that touch edges are one part of the recording.
    pieces = pieces.withColumn("part", F.when(~edge, F.col("block")))
    order = Window.partitionBy(*REC, "part").orderBy("first")
    new = F.coalesce((F.col("first") != F.lag("last").over(order) + 1).cast("long"), F.lit(1))
    run = F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    found = pieces.withColumn("new", new).withColumn("run", run).groupBy(*REC, "part", "run")
    return (
        found.agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
        .where(F.col("n") >= min_points).drop("part", "run")
    )


def least_points(min_sec: float, rate: float) -> int:
    """Points from which n / rate reaches ``min_sec``."""
    n = max(1, int(min_sec * rate))
    while n / rate < min_sec:
        n += 1
    return n


def grid_runs(cond: DataFrame, config: Config, min_sec: float, label: str, flag: str = "flag") -> DataFrame:
    """Events in grid points: a run lasts its number of points times the step; no half cells are added."""
    rate = 1.0 / config.grid_step_sec
    step = F.lit(float(config.grid_step_sec))
    return runs(cond, F.col(flag), "g", least_points(min_sec, rate)).select(
        *REC, F.lit(label).alias("type"), (F.col("first") + 1).alias("start_idx"), (F.col("last") + 1).alias("end_idx"),
        (F.col("first") * step).alias("start_t"), (F.col("last") * step).alias("end_t"),
    )


def to_samples(events: DataFrame, lengths: DataFrame, config: Config) -> DataFrame:
    """Indices and times of the nearest samples, kept within the recording (``lengths``: ``n`` by recording)."""
    fs = F.lit(float(config.fs))

    def index(t: str) -> Column:
        return F.least(F.col("n"), F.greatest(F.lit(1), F.round(F.col(t) * fs) + 1)).cast("long")

    placed = events.join(lengths, REC).withColumn("start_idx", index("start_t")).withColumn("end_idx", index("end_t"))
    return placed.select(
        *REC, "type", "start_idx", "end_idx", ((F.col("start_idx") - 1) / fs).alias("start_t"), ((F.col("end_idx") - 1) / fs).alias("end_t")
    )


def lengths(signals: DataFrame) -> DataFrame:
    return signals.groupBy(*REC).agg((F.max("k") + 1).alias("n"))


def pad(events: DataFrame, lengths: DataFrame, seconds: float, config: Config) -> DataFrame:
    """Times moved apart by ``seconds``, kept within the recording; indices stay as they are."""
    end = (F.col("n") - 1) / F.lit(float(config.fs))
    return events.join(lengths, REC).select(
        *REC, "type", "start_idx", "end_idx",
        F.greatest(F.lit(0.0), F.col("start_t") - F.lit(float(seconds))).alias("start_t"),
        F.least(end, F.col("end_t") + F.lit(float(seconds))).alias("end_t"),
    )


def _spans(events: DataFrame) -> DataFrame:
    """The spans of events, once for each bin of BIN seconds that they touch."""
    return events.select(*[F.col(c).alias(f"_{c}") for c in REC], F.col("start_t").alias("_s"), F.col("end_t").alias("_e"), F.explode(_bins("start_t", "end_t")).alias("_bin"))


def _bins(start: str, end: str, more: float = 0.0) -> Column:
    first, last = (F.floor(t / F.lit(BIN)) for t in (F.col(start), F.col(end) + F.lit(float(more))))
    return F.sequence(first, F.greatest(first, last))


def _same_bin() -> list[Column]:
    """Rows meet under recording and bin, so a recording of any length is many groups."""
    return [F.col(c) == F.col(f"_{c}") for c in REC] + [F.col("_at") == F.col("_bin")]


def meets(lag: float = 0.0) -> Column:
    """Closed overlap of an event, longer by ``lag`` at its end, with a span; touching counts."""
    return (F.col("_e") >= F.col("start_t")) & (F.col("_s") <= F.col("end_t") + F.lit(float(lag)))


def overlapping(events: DataFrame, others: DataFrame, lag: float = 0.0) -> DataFrame:
    """Events that some other meets."""
    own = events.columns
    hits = events.withColumn("_at", F.explode(_bins("start_t", "end_t", lag))).join(_spans(others), [*_same_bin(), meets(lag)], "left_semi")
    hits = hits.select(own).distinct().withColumnsRenamed({c: f"_{c}" for c in own})
    return events.join(hits, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in own], "left_semi")


def with_overlap(events: DataFrame, others: DataFrame, name: str, lag: float = 0.0) -> DataFrame:
    """``events`` with whether some other meets each."""
    keyed = events.withColumn("_event", F.struct(*events.columns)).withColumn("_at", F.explode_outer(_bins("start_t", "end_t", lag)))
    met = keyed.join(_spans(others), [*_same_bin(), meets(lag)], "left")
    met = met.groupBy("_event").agg(F.coalesce(F.bool_or(F.col("_s").isNotNull()), F.lit(False)).alias(name))
    return met.select("_event.*", name)


def points_outside(points: DataFrame, events: DataFrame, t: Column) -> DataFrame:
    """Points in no event; ends belong to events."""
    binned = points.withColumn("_at", F.floor(t / F.lit(BIN)))
    return binned.join(_spans(events), [*_same_bin(), t.between(F.col("_s"), F.col("_e"))], "left_anti").drop("_at")


def merge(events: DataFrame, tolerance: float, by_type: bool = True) -> DataFrame:
    """Events that begin no later than ``tolerance`` after all before them end become one, of one type or of any.

    Start and type come from the first of them, ends are the largest. The greatest end so far runs within bins of BIN seconds and is
    carried from bin to bin, so a recording of any length is many groups.
    """
    key = [*REC, "type"] if by_type else REC
    order = ["start_t", "end_t", "start_idx", "end_idx", "type"]
    rows = events.select(EVENT).withColumn("bin", F.coalesce(F.floor(F.col("start_t") / F.lit(BIN)), F.lit(-(1 << 40))))
    rows = carried(rows, key, "bin", order, before=("max", F.col("end_t")))
    new = F.coalesce(F.col("start_t") > F.col("before") + F.lit(float(tolerance)), F.lit(True))
    rows = numbered_groups(rows, key, "bin", [*order, "before"], new)  # equal events keep the order in which the end ran
    return (
        rows.groupBy(*key, "group")
        .agg(
            F.min_by(F.struct(F.col("type").alias("kind"), "start_idx", "start_t"), F.struct(*order)).alias("f"),
            F.max("end_idx").alias("end_idx"), F.max("end_t").alias("end_t"),
        )
        .select(*REC, F.col("f.kind").alias("type"), "f.start_idx", "end_idx", "f.start_t", "end_t")
    )


def concat(lists: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [e.select(EVENT) for e in lists])


def covered_samples(events: DataFrame, lengths: DataFrame) -> DataFrame:
    """``type, k``: each sample of each type's events, once."""
    clamped = events.join(lengths, REC).select(
        *REC, "type",
        F.least("n", F.greatest(F.lit(1), F.col("start_idx"))).alias("a"), F.least("n", F.greatest(F.lit(1), F.col("end_idx"))).alias("b"),
    )
    # Merged first, so that no sample comes up twice.
    spans = clamped.where("b >= a").select(
        *REC, "type", F.col("a").alias("start_idx"), F.col("b").alias("end_idx"), F.col("a").cast("double").alias("start_t"), F.col("b").cast("double").alias("end_t")
    )
    return merge(spans, 0.0).select(*REC, "type", F.explode(F.sequence(F.col("start_idx") - 1, F.col("end_idx") - 1)).alias("k"))


def sample_mask(signals: DataFrame, events: DataFrame, labels: list[str] = SHORT) -> DataFrame:
    """One row per sample, a flag for each label."""
    own = covered_samples(events, lengths(signals)).groupBy(*REC, "k").agg(
        *[F.bool_or(F.col("type") == x).alias(x) for x in labels]
    )
    rows = signals.select(*REC, "k").join(own, [*REC, "k"], "left")
    return rows.select(*REC, "k", *[F.coalesce(F.col(x), F.lit(False)).alias(x) for x in labels])


def event_sample_mask(events: DataFrame, signals: DataFrame, config: Config) -> DataFrame:
    """``k`` and ``flag``: in any event, with indices from the events' times."""
    n = lengths(signals)
    one = to_samples(events, n, config).withColumn("type", F.lit("any"))
    own = covered_samples(one, n).select(*REC, "k", F.lit(True).alias("flag"))
    return signals.select(*REC, "k").join(own, [*REC, "k"], "left").select(*REC, "k", F.coalesce("flag", F.lit(False)).alias("flag"))


def label_order(events: DataFrame) -> DataFrame:
    """The distinct types of a recording by first appearance in its sorted events."""
    order = Window.partitionBy(*REC).orderBy("raw_type", "start_t", "end_t")
    first = events.withColumn("_nr", F.row_number().over(order)).groupBy(*REC, "type").agg(F.min("_nr").alias("_nr"))
    return first.select(*REC, "type", F.row_number().over(Window.partitionBy(*REC).orderBy("_nr")).cast("long").alias("position"))


def rows_for(seconds: float, config: Config) -> int:
    return max(1, half_up(seconds * config.fs))
