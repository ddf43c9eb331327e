"""The evaluation grid, its trailing windows over breaths, and the conditions on them."""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from breathmark.config import Config, Rate, Shallow
from breathmark.operators import stretches
from breathmark.schema import BELTS, REC

BELT = [*REC, "belt"]
#: Window lengths in one stretch of a recording; stretches are worked on apart.
STRETCH = 512


def _by_stretch(rows: DataFrame) -> DataFrame:
    return stretches.spread(rows, *BELT, "stretch")


class SlidingMedian:
    """The numbers in a window, kept in order while it moves: a step costs a search, not a sort of the whole window."""

    def __init__(self):
        self.own: list[float] = []

    def add(self, x: float) -> None:
        insort(self.own, x)

    def drop(self, x: float) -> None:
        del self.own[bisect_left(self.own, x)]

    @property
    def median(self) -> float | None:
        n = len(self.own)
        return 0.5 * self.own[(n - 1) // 2] + 0.5 * self.own[n // 2] if n else None


def sliding(at: np.ndarray, x: np.ndarray, places: np.ndarray, low: int, high: int) -> list[float | None]:
    """For each of ``places``, rising, the exact median of the numbers ``x`` that stand from place + ``low`` to place + ``high``, both included.

    ``at`` rises too; what isn't a number counts nowhere.
    """
    there = ~np.isnan(x)
    at, x = at[there], x[there].tolist()
    begins, ends = np.searchsorted(at, places + low), np.searchsorted(at, places + high, side="right")
    moved = np.ones(len(places), bool)
    moved[1:] = (begins[1:] != begins[:-1]) | (ends[1:] != ends[:-1])
    window, first, last, out = SlidingMedian(), 0, 0, []
    for begin, end in zip(begins[moved].tolist(), ends[moved].tolist(), strict=True):
        while last < end:
            window.add(x[last])
            last += 1
        while first < min(begin, last):
            window.drop(x[first])
            first += 1
        out.append(window.median)
    return [out[i] for i in (np.cumsum(moved) - 1).tolist()]


def sliding_median(rows: DataFrame, group: list[str], at: str, value: str, low: int, high: int, asked: Column) -> DataFrame:
    """The ``asked`` rows with the ``median`` of ``value`` over the rows of their group from ``at`` + ``low`` to ``at`` + ``high``.

    A group goes to one task: long sequences come in stretches that see the window's reach before them. Where rows are dealt by ``group`` already they
    are not dealt again.
    """
    rows = rows.withColumn("asked", asked)
    kept = [f for f in rows.schema.fields if f.name not in ("asked", "median")]

    def work(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(at, kind="stable", ignore_index=True)
        found = part[part["asked"].to_numpy(bool)].drop(columns="asked")
        medians = sliding(part[at].to_numpy(), part[value].to_numpy(float), found[at].to_numpy(), low, high)
        return found.assign(median=pd.array(medians, "Float64"))

    return rows.groupBy(*group).applyInPandas(work, T.StructType([*kept, T.StructField("median", T.DoubleType())]))


def trailing_median(rows: DataFrame, key: list[str], at: str, value: str, reach: int, stretch: int = stretches.STRETCH) -> DataFrame:
    """Every row with the exact ``median`` of ``value`` over the rows of its key from ``reach`` positions before it up to it."""
    view = stretches.spread(stretches.dealt(rows, at, max(stretch, reach), before=reach), *key, "stretch")
    return sliding_median(view, [*key, "stretch"], at, value, -reach, 0, F.col("own")).drop("stretch", "own")


def grid_points(lengths: DataFrame, step_rows: int) -> DataFrame:
    """``g`` = 0, 1, ...: points every ``step_rows`` samples, up to the last sample (``lengths``: ``n``)."""
    last = F.floor((F.col("n") - 1) / F.lit(step_rows)).cast("long")
    return lengths.where("n > 0").select(*REC, F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("g"))


def windows(breaths: DataFrame, lengths: DataFrame, win_sec: int, config: Config) -> DataFrame:
    """Of each belt and grid point, the breaths with peaks in the closed window of ``win_sec`` up to it.

    Columns: ``n`` rows (breaths without an amplitude count), ``med_amp``, ``amp_ref``, ``k0, k1`` first and last peak,
    ``rr`` (beats a minute, of the mean interval), ``cov`` and ``rmssd`` (seconds) of the intervals within the window,
    ``pauses``: intervals of ``pause_sec`` or more among them.

    A band join without a join: a recording is cut into stretches of STRETCH windows, and breaths that windows of the next stretch still see go to
    both, so a long recording is many groups. Only breaths and one row a stretch are dealt out; grid points arise in the task that rates them. A window
    is a range of places among its stretch's breaths, found by search, and its sums are differences of running sums of whole numbers. Medians slide along the same places.
    """
    fs = float(config.fs)
    pause, step, reach = config.irregular.pause_sec * config.fs, config.grid_rows, win_sec * config.fs
    size = STRETCH * reach
    refs = breaths.groupBy(*BELT).agg(F.first("amp_ref").cast("double").alias("amp_ref"))
    last = F.floor((F.col("n") - 1) / F.lit(size))
    bounds = lengths.where("n > 0").join(refs, REC).select(
        *BELT, F.lit(None).cast("long").alias("peak_k"), F.lit(None).cast("double").alias("amp"), "amp_ref", "n", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("stretch")
    )
    own = stretches.dealt(breaths.select(*BELT, F.col("peak_k").cast("long").alias("peak_k"), F.col("amp").cast("double").alias("amp")), "peak_k", size, before=reach)
    both = own.select(*BELT, "peak_k", "amp", F.lit(None).cast("double").alias("amp_ref"), F.lit(None).cast("long").alias("n"), "stretch").unionByName(bounds)

    def rate(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        stretch = key[-1].as_py()
        bound = part.filter(part["n"].is_valid()).slice(0, 1)
        # A stretch after the recording's end has breaths of the one before it, and no points.
        stop = min(bound["n"][0].as_py(), (stretch + 1) * size) if bound.num_rows else 0
        g = np.arange(-(-stretch * size // step), (stop - 1) // step + 1, dtype=np.int64)
        seen = part.filter(part["peak_k"].is_valid()).sort_by("peak_k")
        k, amp = seen["peak_k"].to_numpy(), seen["amp"].to_numpy()
        begin, end = np.searchsorted(k, g * step - reach), np.searchsorted(k, g * step, side="right")
        n = end - begin
        ibi = np.diff(k)
        none = np.zeros(1, np.int64)
        i2, pauses = (np.concatenate([none, np.cumsum(x)])[: max(1, len(k))] for x in (ibi * ibi, (ibi >= pause).astype(np.int64)))
        d2 = np.concatenate([none, none, np.cumsum(np.diff(ibi) ** 2)])[: max(1, len(k))]
        first, final = np.minimum(begin, max(0, len(k) - 1)), np.maximum(end - 1, 0)
        places = k if len(k) else none
        empty = n == 0
        found = {
            "n": n, "med_amp": sliding(k, amp.astype(float), g * step, -reach, 0), "amp_ref": [bound["amp_ref"][0].as_py()] * len(g) if bound.num_rows else [],
            "k0": pa.array(places[first], mask=empty), "k1": pa.array(places[final], mask=empty),
            "s2": pa.array(i2[final] - i2[first], mask=empty), "e2": pa.array(d2[final] - d2[np.minimum(first + 1, final)], mask=empty),
            "pauses": pa.array(pauses[final] - pauses[first], mask=empty),
        }
        keys = {name: pa.repeat(value, len(g)) for name, value in zip(BELT, key, strict=False)}
        kinds = {"med_amp": pa.float64(), "amp_ref": pa.float64()}
        return pa.table({**keys, "g": g, **{c: pa.array(x, kinds.get(c, pa.int64())) if not isinstance(x, pa.Array) else x for c, x in found.items()}})

    kept = [breaths.schema[c] for c in BELT]
    numbers = [T.StructField(c, T.DoubleType() if c in ("med_amp", "amp_ref") else T.LongType()) for c in ("g", "n", "med_amp", "amp_ref", "k0", "k1", "s2", "e2", "pauses")]
    found = _by_stretch(both).groupBy(*BELT, "stretch").applyInArrow(rate, T.StructType([*kept, *numbers]))
    span, m = (F.col("k1") - F.col("k0")).cast("double"), F.col("n").cast("double")
    var = F.greatest(F.lit(0.0), (F.col("s2") - span * span / F.nullif(m - 1, F.lit(0.0))) / F.nullif(m - 2, F.lit(0.0)))
    return found.select(
        *BELT, "g", "n", "med_amp", "amp_ref", "k0", "k1", "pauses",
        F.when(F.col("n") >= 2, F.try_divide(F.lit(60.0 * fs) * (m - 1), span)).alias("rr"),
        F.when(F.col("n") >= 3, F.try_divide(F.sqrt(var) * (m - 1), span)).alias("cov"),
        F.when(F.col("n") >= 3, F.sqrt(F.try_divide(F.col("e2").cast("double"), m - 2)) / fs).alias("rmssd"),
    )


def _late_enough(win_sec: int, config: Config) -> Column:
    return F.col("g") * config.grid_step_sec >= win_sec


@dataclass(frozen=True)
class Condition:
    """``flag`` of a belt's window must hold on both belts, or on either; ``rows``: least breaths that each belt must have in the window."""

    flag: Column
    both: bool = False
    rows: int | None = None


def at_points(windows: DataFrame, **conditions: Condition) -> DataFrame:
    """Whether each of ``conditions`` holds, by its name, at each grid point: all of them in one pass over the belts' windows."""
    belts = len(BELTS)
    found = windows.groupBy(*REC, "g").agg(
        F.min("n").alias("_least"), F.count(F.lit(1)).alias("_belts"),
        *[(F.bool_and if c.both else F.bool_or)(F.coalesce(c.flag, F.lit(False))).alias(name) for name, c in conditions.items()],
    )

    def holds(name: str, c: Condition) -> Column:
        ok = F.col(name)
        if c.both or c.rows is not None:
            ok = ok & (F.col("_belts") == belts)
        if c.rows is not None:
            ok = ok & (F.col("_least") >= c.rows)
        return ok.alias(name)

    return found.select(*REC, "g", *[holds(name, c) for name, c in conditions.items()])


def shallow_rule(p: Shallow | Rate, config: Config) -> Condition:
    """The median amplitude of either belt is reduced by a share between two bounds."""
    low, high = (p.ratio_low, p.ratio_high) if isinstance(p, Shallow) else (p.shallow_low, p.shallow_high)
    ratio = F.try_divide("med_amp", "amp_ref")
    return Condition(ratio.between(F.lit(1.0 - high), F.lit(1.0 - low)) & _late_enough(p.win_sec, config), rows=3)


def slow_rule(rate: Rate, config: Config) -> Condition:
    span = F.col("k1") - F.col("k0")
    return Condition((F.col("n") >= 3) & (60.0 * config.fs * (F.col("n") - 1) <= rate.rr_bpm * span) & _late_enough(rate.win_sec, config))


def rapid_rule(rate: Rate, config: Config) -> Condition:
    span = F.col("k1") - F.col("k0")
    return Condition((F.col("n") >= 3) & (60.0 * config.fs * (F.col("n") - 1) >= rate.rr_bpm * span) & _late_enough(rate.win_sec, config))


def irregular_rule(config: Config) -> Condition:
    p = config.irregular
    spread = (F.col("cov") >= p.cov) | (F.col("rmssd") >= p.rmssd)
    return Condition((F.col("n") >= 3) & (F.col("pauses") == 0) & spread & _late_enough(p.win_sec, config))


def apnea_rule(config: Config) -> Condition:
    p = config.apnea
    ratio = F.try_divide("med_amp", "amp_ref")
    return Condition((ratio <= p.ratio) & _late_enough(p.win_sec, config), both=True, rows=2)


def conditions(config: Config) -> dict[str, tuple[int, Condition]]:
    """The length of its windows in seconds and the rule of each condition, by name; the depth of slow and rapid breathing is one of its own."""
    c = config
    rules = {
        "shallow": (c.shallow, shallow_rule(c.shallow, c)), "irregular": (c.irregular, irregular_rule(c)), "slow": (c.slow, slow_rule(c.slow, c)), "slow_depth": (c.slow, shallow_rule(c.slow, c)),
        "rapid": (c.rapid, rapid_rule(c.rapid, c)), "rapid_depth": (c.rapid, shallow_rule(c.rapid, c)), "apnea": (c.apnea, apnea_rule(c)),
    }
    return {name: (p.win_sec, rule) for name, (p, rule) in rules.items()}


def shallow_of(windows: DataFrame, config: Config, p: Shallow | Rate) -> DataFrame:
    return at_points(windows, flag=shallow_rule(p, config))


def slow(windows: DataFrame, rate: Rate, config: Config) -> DataFrame:
    return at_points(windows, flag=slow_rule(rate, config))


def rapid(windows: DataFrame, rate: Rate, config: Config) -> DataFrame:
    return at_points(windows, flag=rapid_rule(rate, config))


def irregular(windows: DataFrame, config: Config) -> DataFrame:
    return at_points(windows, flag=irregular_rule(config))


def apnea(windows: DataFrame, config: Config) -> DataFrame:
    return at_points(windows, flag=apnea_rule(config))


def amp_ratio(windows: DataFrame) -> DataFrame:
    """The trace of the apnea figure: the median ratio from two breaths on, at any time."""
    return windows.select(*BELT, "g", F.when(F.col("n") >= 2, F.try_divide("med_amp", "amp_ref")).alias("ratio"))


def sigh_flags(breaths: DataFrame, config: Config) -> DataFrame:
    """Breaths ``ratio`` times as deep as the median of those before it in the window, itself left out."""
    p = config.sigh
    reach = p.prev_win_sec * config.fs
    order = Window.partitionBy(*BELT).orderBy("peak_k")
    rows = breaths.select(*BELT, "peak_k", F.col("amp").cast("double").alias("amp"), F.lag("peak_k").over(order).alias("prev_k"), F.lead("peak_k").over(order).alias("next_k"))
    size = STRETCH * reach
    seen = _by_stretch(stretches.dealt(rows, "peak_k", size, before=reach))
    w = Window.partitionBy(*BELT, "stretch").orderBy("peak_k").rangeBetween(-reach, -1)
    seen = seen.withColumn("n_prev", F.count(F.lit(1)).over(w))
    found = sliding_median(seen, [*BELT, "stretch"], "peak_k", "amp", -reach, -1, F.col("own")).withColumnRenamed("median", "med_prev")
    flag = (F.col("peak_k") >= reach) & (F.col("n_prev") >= p.min_prev_breaths) & (F.col("med_prev") > 0)
    return found.select(*BELT, "peak_k", "amp", "n_prev", "med_prev", "prev_k", "next_k").withColumn(
        "flag", F.coalesce(flag & (F.col("amp") >= p.ratio * F.col("med_prev")), F.lit(False))
    )
