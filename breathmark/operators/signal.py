"""From belt samples to breaths: detrending, smoothing, peak picking, troughs, rates and the baseline."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from breathmark.config import Config
from breathmark.operators.stretches import STRETCH, carried, dealt, medians, spread
from breathmark.schema import BELTS, REC

KEY = [*REC, "segment", "belt"]
#: Samples whose candidates are looked at together, and distances in which groups of peaks begin that are.
BLOCK = 32768


def head_segment(signals: DataFrame, config: Config) -> DataFrame:
    """The samples of the baseline."""
    return signals.where(F.col("k") < config.baseline_sec * config.fs)


def belt_samples(signals: DataFrame, config: Config) -> DataFrame:
    """``segment, belt, k, x``: both belts of the whole recording (``full``) and again of its head (``baseline``).

    One scan and no join: each sample is spread to the rows that it stands for.
    """
    n0 = config.baseline_sec * config.fs
    segments = F.when(F.col("k") < n0, F.array(F.lit("full"), F.lit("baseline"))).otherwise(F.array(F.lit("full")))
    belts = F.array(*[F.struct(F.lit(b).alias("belt"), F.col(c).cast("double").alias("x")) for b, c in BELTS.items()])
    return (
        signals.select(*REC, "k", F.explode(belts).alias("b"), segments.alias("s"))
        .select(*REC, F.explode("s").alias("segment"), "b.belt", "k", "b.x")
    )


def _centred(samples: DataFrame, before: int, after: int, stretch: int) -> DataFrame:
    """Samples in stretches with so much reach, less the median of their segment, which comes to each stretch as one row."""
    middle = medians(samples, KEY, "x", last=F.col("k"))
    stretches = F.sequence(F.lit(0).cast("long"), F.floor((F.col("last") + before) / F.lit(stretch)))
    middle = middle.select(*KEY, "median", F.explode(stretches).alias("stretch"))
    rows = spread(dealt(samples.select(*KEY, "k", "x"), "k", stretch, before, after), *KEY, "stretch")
    return rows.join(middle, [*KEY, "stretch"], "left").withColumn("x", F.col("x") - F.col("median")).drop("median")


def detrend(samples: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """``x`` less the median of its segment."""
    return _centred(samples, 0, 0, stretch).select(*KEY, "k", "x")


def _averaged(view: DataFrame, rows: int) -> DataFrame:
    """``x0`` within each stretch, right where the stretch sees the whole reach of the mean."""
    if rows <= 1:
        return view.withColumn("x0", F.col("x"))
    frame = Window.partitionBy(*KEY, "stretch").orderBy("k").rowsBetween(-(rows // 2), rows - 1 - rows // 2)
    return view.withColumn("x0", F.avg("x").over(frame))


def moving_mean(samples: DataFrame, rows: int, stretch: int = STRETCH) -> DataFrame:
    """``x0``: the mean of ``rows`` samples, of an even number one more before than after; fewer at the ends."""
    view = spread(dealt(samples, "k", stretch, rows // 2, max(0, rows - 1 - rows // 2)), *KEY, "stretch")
    return _averaged(view, rows).where("own").select(*samples.columns, "x0")


def _smooth_view(signals: DataFrame, config: Config, stretch: int) -> DataFrame:
    """Smoothed samples in stretches, each with the one before it and the one after it."""
    rows = config.smooth_rows
    view = _centred(belt_samples(signals, config), rows // 2 + 1, max(0, rows - 1 - rows // 2) + 1, stretch)
    start = F.col("stretch") * stretch
    return _averaged(view, rows).where(F.col("k").between(start - 1, start + stretch))


def smoothed(signals: DataFrame, config: Config, stretch: int = STRETCH) -> DataFrame:
    return _smooth_view(signals, config, stretch).where("own").select(*KEY, "k", "x", "x0")


def _parts(view: DataFrame, stretch: int) -> DataFrame:
    """Samples of each stretch up to its maxima, one row a part: the ``least`` of them, the ``first`` that differs from what is before it, and the maximum ``top``.

    A flat run counts once, at its first sample, and is a maximum where it is higher than the runs before and after it. Of one that
    runs on beyond the stretch (``open``) the next stretches decide.
    """
    order = Window.partitionBy(*KEY, "stretch").orderBy("k")
    whole = Window.partitionBy(*KEY, "stretch")
    new = (F.row_number().over(order) == 1) | ~F.col("x0").eqNullSafe(F.lag("x0").over(order))
    runs = view.select(*KEY, "stretch", "own", "k", "x0", new.alias("new"), (F.max("k").over(whole) >= (F.col("stretch") + 1) * stretch).alias("more")).where("new")
    runs = runs.withColumns({"before": F.lag("x0").over(order), "after": F.lead("x0").over(order), "later": F.lead("k").over(order)})
    runs = runs.withColumn("open", F.col("later").isNull() & F.col("more"))
    top = F.col("own") & (F.col("x0") > F.col("before")) & (F.col("open") | (F.col("x0") > F.col("after")))
    runs = runs.withColumn("top", F.coalesce(top, F.lit(False)))
    part = F.coalesce(F.sum(F.col("top").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (
        runs.withColumn("piece", part).where("own").groupBy(*KEY, "stretch", "piece")
        .agg(
            F.min(F.when(F.col("x0").isNotNull(), F.struct("x0", "k"))).alias("least"), F.min(F.struct("k", "x0")).alias("first"),
            F.max(F.when(F.col("top"), F.struct("k", "x0", "open"))).alias("top"),
        )
    )


def _view(samples: DataFrame, stretch: int) -> DataFrame:
    return spread(dealt(samples, "k", stretch, 1, 1), *KEY, "stretch")


def _candidates(view: DataFrame, stretch: int) -> DataFrame:
    """Candidates from samples in stretches, and a last row without a place for what lies after the last of them.

    Only the first and the last part of a stretch, which may go on in the next, meet by recording and belt; all others are settled in their stretch.
    """
    parts = _parts(view, stretch)
    settled = (F.col("piece") > 0) & F.col("top.k").isNotNull() & ~F.col("top.open")
    parts = parts.withColumn("part", F.when(settled, F.col("stretch")))
    order = Window.partitionBy(*KEY, "part").orderBy("stretch", "piece")
    # Of a flat top at the end of a stretch the next value that differs decides.
    high = F.col("top.k").isNotNull() & (~F.col("top.open") | (F.col("top.x0") > F.lead("first.x0").over(order)))
    parts = parts.withColumn("high", F.coalesce(high, F.lit(False)))
    closed = F.sum(F.col("high").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    merged = parts.withColumn("group", F.coalesce(closed, F.lit(0))).groupBy(*KEY, "part", "group")
    found = merged.agg(F.min("least").alias("least"), F.max(F.when(F.col("high"), F.struct("top.k", F.col("top.x0").alias("h")))).alias("top"))
    return found.select(*KEY, "top.k", "top.h", F.col("least.x0").alias("low"), F.col("least.k").alias("low_k"))


def candidates(samples: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Local maxima of ``x0`` with ``low``, the least value since the one before, at ``low_k`` first; one row more, without ``k``, has the least after the last.

    A flat top counts once, at its first sample. First and last runs and neighbours of missing samples are none.
    """
    return _candidates(_view(samples, stretch), stretch)


def smooth_candidates(signals: DataFrame, config: Config, stretch: int = STRETCH) -> DataFrame:
    """The candidates of smoothed belts, from the stretches in which they are smoothed."""
    return _candidates(_smooth_view(signals, config, stretch), stretch)


def local_maxima(samples: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """The place ``k`` and height ``x0`` of each local maximum."""
    return candidates(samples, stretch).where(F.col("k").isNotNull()).select(*KEY, "k", F.col("h").alias("x0"))


def least_up_to_higher(h: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each height the least of ``low`` back to the nearest higher one before it, or to the start, and whether there is such a one.

    ``low[i]`` lies between heights i - 1 (or the start) and i.
    """
    out, found, stack = np.empty(len(h)), np.zeros(len(h), bool), []
    for i, (height, least) in enumerate(zip(h.tolist(), low.tolist(), strict=True)):
        while stack and stack[-1][0] <= height:
            least = min(least, stack.pop()[1])
        found[i] = bool(stack)
        stack.append((height, least))
        out[i] = least
    return out, found


def _sides(h: np.ndarray, low: np.ndarray, tail: float) -> tuple[np.ndarray, ...]:
    """least_up_to_higher to the left and to the right; ``tail`` is the least after the last height."""
    left, left_found = least_up_to_higher(h, low)
    right, right_found = least_up_to_higher(h[::-1], np.append(low[1:], tail)[::-1])
    return left, left_found, right[::-1], right_found[::-1]


def prominences(h: np.ndarray, low: np.ndarray, tail: float) -> np.ndarray:
    """Height over the higher of the two lowest points towards the nearest higher maximum, or the end, on each side.

    ``low[i]`` lies between maximum i - 1 (or the start) and i; ``tail`` after the last.
    """
    if not len(h):
        return np.empty(0)
    left, _, right, _ = _sides(h, low, tail)
    return h - np.maximum(left, right)


def spaced(k: np.ndarray, h: np.ndarray, distance: int) -> np.ndarray:
    """Tallest first, the earlier of equals first: whether each maximum stays when it deletes all within ``distance``."""
    keep = np.ones(len(k), bool)
    for i in np.lexsort((k, -h)):
        if keep[i]:
            a, b = np.searchsorted(k, [k[i] - distance, k[i] + distance + 1])
            keep[a:b] = False
            keep[i] = True
    return keep


_CANDIDATE = "subject int, condition int, segment string, belt string, k long, h double, low double, low_k long"


def with_prominence(cands: DataFrame, block: int = BLOCK) -> DataFrame:
    """Candidates with their ``prominence``, in two levels: blocks of ``block`` samples, then what blocks couldn't settle.

    A block settles each side of a candidate on which it holds a higher one. What is left over, and all that other blocks can run into, are candidates that are
    highest so far from one end of their block, some of a hundred in waves; those between leave the least of their lows to the next one, and the shorter sequence is
    gone through in the same way. (Heights that rise all along leave all.)
    """
    numbers = ["prominence", "lft", "rgt", "gap"]
    shape = f"{_CANDIDATE}, block long, " + ", ".join(f"{c} double" for c in numbers)

    def first(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("k", ignore_index=True)
        if pd.isna(group["block"].iloc[0]):  # what lies after the last candidate
            return group.assign(prominence=np.nan, lft=np.nan, rgt=np.nan, gap=group["low"].astype(float))
        low, h = group["low"].to_numpy(float), group["h"].to_numpy(float)
        left, left_found, right, right_found = _sides(h, low, np.inf)
        kept = ~(left_found & right_found)
        gaps = np.full(len(h), np.nan)
        gaps[kept] = np.minimum.reduceat(low, np.append(0, np.flatnonzero(kept)[:-1] + 1))
        values = (np.where(kept, np.nan, h - np.maximum(left, right)), np.where(left_found, left, np.nan), np.where(right_found, right, np.nan), gaps)
        return group.assign(**dict(zip(numbers, values, strict=True)))

    def second(group: pd.DataFrame) -> pd.DataFrame:
        if group["part"].notna().iloc[0]:
            return group
        group = group.sort_values("k", ignore_index=True, na_position="last")
        h, gap = group["h"].to_numpy(float), group["gap"].to_numpy(float)
        n = len(h) - int(pd.isna(group["k"].iloc[-1]))
        if not n:
            return group
        tail = gap[n] if n < len(h) and not np.isnan(gap[n]) else np.inf
        left, _, right, _ = _sides(h[:n], gap[:n], tail)
        own = group.iloc[:n]
        left, right = np.where(own["lft"].isna(), left, own["lft"]), np.where(own["rgt"].isna(), right, own["rgt"])
        group.loc[: n - 1, "prominence"] = h[:n] - np.maximum(left, right)
        return group

    rows = cands.select(*KEY, "k", "h", "low", "low_k", F.floor(F.col("k") / block).alias("block"))
    one = spread(rows, *KEY, "block").groupBy(*KEY, "block").applyInPandas(first, shape)
    open_rows = F.col("prominence").isNull() | F.isnan("prominence")
    one = one.withColumn("part", F.when(~open_rows, F.col("block")))
    return one.groupBy(*KEY, "part").applyInPandas(second, f"{shape}, part long").select(*KEY, "k", "h", "low", "low_k", "prominence")


def pick_peaks(cands: DataFrame, min_prominence: float, distance: int | None) -> DataFrame:
    """Candidates that stand out by ``min_prominence``, then thinned to ``distance`` samples; None leaves them.

    ``low_val`` at ``low_k``: the least value up to the next peak, at the last one up to the end. Peaks are thinned in independent groups: where neighbours are
    further apart, no peak deletes one of the other group. Many groups go to one task, those that begin within the same BLOCK distances; a group is never cut.
    """
    order = Window.partitionBy(*KEY).orderBy(F.col("k").asc_nulls_last())
    rated = with_prominence(cands).withColumn("stands", F.coalesce(F.col("prominence") >= min_prominence, F.lit(False)))
    if distance is None:
        rated = rated.withColumn("kept", F.col("stands"))
    else:
        before = F.last(F.when(F.col("stands"), F.col("k")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
        starts = F.when(F.col("stands") & (F.col("before").isNull() | (F.col("k") - F.col("before") > distance)), F.col("k"))
        rated = rated.withColumn("before", before).withColumn("start", starts)
        start = F.last("start", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
        rated = rated.withColumn("some", F.floor(start / (BLOCK * (distance + 1)))).drop("before", "start")

        def pick(group: pd.DataFrame) -> pd.DataFrame:
            own = group[group["stands"]].sort_values("k")
            near = own["k"][spaced(own["k"].to_numpy(), own["h"].to_numpy(float), distance)]
            return group.assign(kept=group["k"].isin(near) & group["stands"])

        rated = rated.groupBy(*KEY, "some").applyInPandas(pick, f"{_CANDIDATE}, prominence double, stands boolean, some long, kept boolean")
    # A low belongs to the last peak before its candidate.
    peak = F.last(F.when(F.col("kept"), F.col("k")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    low = F.struct(peak.alias("k"), F.when(F.col("low").isNotNull(), F.struct("low", "low_k")).alias("least"), F.lit(None).cast("struct<h: double, prominence: double>").alias("own"))
    own = F.struct(F.when(F.col("kept"), F.col("k")).alias("k"), F.lit(None).cast("struct<low: double, low_k: bigint>").alias("least"), F.struct("h", "prominence").alias("own"))
    both = rated.select(*KEY, F.array(low, own).alias("both")).select(*KEY, F.inline("both")).where(F.col("k").isNotNull())
    found = both.groupBy(*KEY, "k").agg(F.max("own").alias("own"), F.min("least").alias("least"))
    return found.select(*KEY, "k", "own.h", "own.prominence", F.col("least.low").alias("low_val"), F.col("least.low_k").alias("low_k"))


def breath_table(signals: DataFrame, config: Config, stretch: int = STRETCH) -> DataFrame:
    """One row per peak: trough before the next peak, amplitude, interval and rate; nulls at the last one.

    Segments with fewer than ``min_num_peaks`` peaks have none.
    """
    view = _smooth_view(signals, config, stretch)
    peaks = pick_peaks(_candidates(view, stretch), config.resp.min_peak_prom, config.peak_dist_rows)
    return breaths_of(view.where("own"), peaks, config, stretch)


def breaths_of(samples: DataFrame, peaks: DataFrame, config: Config, stretch: int = STRETCH) -> DataFrame:
    """Breaths from picked peaks; only troughs at a percentile look at ``samples`` again."""
    order = Window.partitionBy(*KEY).orderBy("k")
    whole = Window.partitionBy(*KEY)
    peaks = (
        peaks.withColumn("n", F.count(F.lit(1)).over(whole)).where(F.col("n") >= config.resp.min_num_peaks)
        .select(
            *KEY, "k", "h", F.lead("k").over(order).alias("next_k"), F.row_number().over(order).cast("long").alias("breath_no"),
            F.struct(F.col("low_val").alias("x0"), F.col("low_k").alias("k")).alias("low"),
        )
    )
    if config.resp.trough_method != "min":
        low = percentile_troughs(samples, peaks, config.resp.trough_prct, stretch)
        peaks = peaks.drop("low").join(low, [*KEY, "breath_no"], "left")
    last = F.col("next_k").isNull()
    ibi = (F.col("next_k") - F.col("k")) / F.lit(float(config.fs))
    return peaks.select(
        *KEY, "breath_no", F.col("k").alias("peak_k"), F.col("h").alias("peak_val"),
        F.when(~last, F.col("low.k")).alias("trough_k"),
        F.when(~last, F.col("low.x0")).alias("trough_val"),
        F.when(~last, F.col("h") - F.col("low.x0")).alias("amp"),
        ibi.alias("ibi_s"), F.try_divide(F.lit(60.0), ibi).alias("rr_bpm"),
    )


def percentile_troughs(samples: DataFrame, peaks: DataFrame, prct: float, stretch: int = STRETCH) -> DataFrame:
    """``low`` of each breath: the sample nearest to the value at plotting position (i - 0.5) / n, both peaks included."""
    # Each sample joins the breath that it lies in; a peak closes the breath before it too.
    tagged = samples.select(*KEY, "k", "x0").join(peaks.select(*KEY, "k", "breath_no"), [*KEY, "k"], "left")
    tagged = tagged.withColumn("stretch", F.floor(F.col("k") / F.lit(stretch)))
    tagged = carried(tagged, KEY, "stretch", ["k"], b=("last", F.col("breath_no")))
    tagged = tagged.withColumn("b", F.coalesce("breath_no", "b")).where(F.col("b").isNotNull())
    both = F.when(F.col("breath_no") > 1, F.array(F.col("b") - 1, F.col("b"))).otherwise(F.array("b"))
    spread = tagged.select(*KEY, "k", "x0", F.explode(both).alias("b"))
    own = Window.partitionBy(*KEY, "b")
    rank = F.row_number().over(own.orderBy(F.col("x0").asc_nulls_last(), "k"))
    place = F.lit(prct / 100) * F.col("m") + F.lit(0.5)
    at = F.least(F.greatest(place, F.lit(1.0)), F.col("m").cast("double"))
    ranked = spread.withColumn("m", F.count("x0").over(own)).withColumn("r", rank)
    lower = F.max(F.when(F.col("r") == F.floor(at), F.col("x0"))).over(own)
    upper = F.max(F.when(F.col("r") == F.ceil(at), F.col("x0"))).over(own)
    ranked = ranked.withColumn("p", lower + (upper - lower) * (at - F.floor(at)))
    nearest = F.min_by(F.struct("x0", "k"), F.struct(F.abs(F.col("x0") - F.col("p")), F.col("k")))
    return ranked.where(F.col("x0").isNotNull()).groupBy(*KEY, F.col("b").alias("breath_no")).agg(nearest.alias("low"))


def rate_summary(breaths: DataFrame) -> DataFrame:
    """Mean rate, of the mean interval, and the spread of instantaneous rates, by recording, segment and belt."""
    return breaths.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_peaks"),
        F.try_divide(F.lit(60.0), F.avg("ibi_s")).alias("rr_mean_bpm"),
        F.stddev_samp("rr_bpm").alias("rr_std_bpm"),
    )


def spo2_baseline(signals: DataFrame, config: Config) -> DataFrame:
    """Median and mean of the oxygen signal's head, which is as long as the configuration says."""
    head = head_segment(signals, config)
    return head.groupBy(*REC).agg(F.median("spo2").alias("spo2_median"), F.avg("spo2").alias("spo2_mean"))


def oxygen_units(base: DataFrame) -> DataFrame:
    """``base`` with ``plausible``: whether the median of oxygen saturation lies from 50 to 100; null where there is none."""
    return base.withColumn("plausible", F.col("spo2_median").between(50, 100))


def baseline(signals: DataFrame, breaths: DataFrame, config: Config) -> DataFrame:
    """One row per recording; references are null where the head has too few breaths."""
    head = breaths.where(F.col("segment") == "baseline")
    of = {b: F.col("belt") == b for b in BELTS}
    refs = head.groupBy(*REC).agg(
        *[F.median(F.when(of[b], F.col("amp"))).alias(f"{n}_amp_ref") for b, n in (("lungs", "lungs"), ("diaph", "diap"))],
        *[F.try_divide(F.lit(60.0), F.avg(F.when(of[b], F.col("ibi_s")))).alias(f"{n}_rr_ref") for b, n in (("lungs", "lungs"), ("diaph", "diap"))],
    )
    return spo2_baseline(signals, config).join(refs, REC, "left").select(
        *REC, "spo2_median", "spo2_mean", "lungs_amp_ref", "lungs_rr_ref", "diap_amp_ref", "diap_rr_ref"
    )


def usable_breaths(breaths: DataFrame, base: DataFrame) -> DataFrame:
    """Breaths of whole recordings with positive amplitude references and breaths on both belts."""
    good = base.where((F.col("lungs_amp_ref") > 0) & (F.col("diap_amp_ref") > 0)).select(*REC, "lungs_amp_ref", "diap_amp_ref")
    full = breaths.where(F.col("segment") == "full").drop("segment")
    both = full.groupBy(*REC).agg(F.count_distinct("belt").alias("_b")).where("_b = 2").select(*REC)
    return full.join(both, REC, "left_semi").join(good, REC).withColumn(
        "amp_ref", F.when(F.col("belt") == "lungs", F.col("lungs_amp_ref")).otherwise(F.col("diap_amp_ref"))
    ).drop("lungs_amp_ref", "diap_amp_ref")
