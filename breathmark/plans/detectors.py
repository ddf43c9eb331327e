"""The eight label detectors, each a lazy plan from shared tables to events."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breathmark.config import Config, Rate
from breathmark.operators import grid, intervals, signal
from breathmark.schema import REC, empty_events
from breathmark.sources.recordings import with_channels
from breathmark.sources.storage import durable, stored


class Recordings:
    """Tables that the detectors share, each planned once. ``signals``: recordings by sample."""

    def __init__(self, signals: DataFrame, config: Config):
        self.signals, self.config = with_channels(signals), config

    @cached_property
    def lengths(self) -> DataFrame:
        return intervals.lengths(self.signals)

    @cached_property
    def all_breaths(self) -> DataFrame:
        return signal.breath_table(self.signals, self.config)

    @cached_property
    def baseline(self) -> DataFrame:
        return signal.baseline(self.signals, self.all_breaths, self.config)

    @cached_property
    def breaths(self) -> DataFrame:
        return signal.usable_breaths(self.all_breaths, self.baseline)

    @cached_property
    def desat(self) -> DataFrame:
        return desaturations(self.signals, self.config)

    def windows(self, win_sec: int) -> DataFrame:
        """One table for all conditions on windows of one length."""
        made = self.__dict__.setdefault("_windows", {})
        if win_sec not in made:
            made[win_sec] = grid.windows(self.breaths, self.lengths, win_sec, self.config)
        return made[win_sec]

    def condition(self, name: str) -> DataFrame:
        """``flag`` by grid point: whether the condition of that name (grid.conditions) holds."""
        win_sec, rule = grid.conditions(self.config)[name]
        made = self.__dict__.get("_conditions", {})
        if win_sec in made:
            return made[win_sec].select(*REC, "g", F.col(name).alias("flag"))
        return grid.at_points(self.windows(win_sec), flag=rule)

    def settle_breaths(self, *more: str) -> Recordings:
        """Works out the samples, the breaths and their baseline, and the tables named in ``more``, for plans that read them more than once."""
        self.signals = stored(self.signals)
        for name in (*more, "all_breaths", "baseline"):
            self.__dict__[name] = durable(getattr(self, name))
        return self

    def settle_conditions(self) -> Recordings:
        """Works out all conditions on windows of one length in one pass over these windows, which themselves are not kept."""
        rules, made = grid.conditions(self.config), {}
        for win in {w for w, _ in rules.values()}:
            made[win] = stored(grid.at_points(self.windows(win), **{name: rule for name, (w, rule) in rules.items() if w == win}))
        self.__dict__["_conditions"] = made
        return self

    def settle(self) -> Recordings:
        """Works out the tables that several detectors read and cuts their lineage.

        Samples and conditions are written once, in columns, and read by all; the others have a row per recording, event or breath.
        """
        self.settle_breaths("lengths")
        for name in ("breaths", "desat"):
            self.__dict__[name] = durable(getattr(self, name))
        return self.settle_conditions()


def desat_flags(signals: DataFrame, config: Config) -> DataFrame:
    """``flag`` by sample: below the floor, or ``drop`` or more under the recording's median at its head."""
    base = signal.spo2_baseline(signals, config).where(F.abs("spo2_median") < float("inf")).select(*REC, "spo2_median")
    x, p = F.col("spo2"), config.spo2
    low = (x < p.floor) | (F.col("spo2_median") - x >= p.drop)
    return signals.join(base, REC).select(*REC, "k", F.coalesce(low & (F.abs(x) < float("inf")), F.lit(False)).alias("flag"))


def desaturations(signals: DataFrame, config: Config) -> DataFrame:
    found = intervals.runs(desat_flags(signals, config), F.col("flag"), "k", intervals.rows_for(config.spo2.min_dur_sec, config))
    fs = F.lit(float(config.fs))
    return found.select(
        *REC, F.lit("desaturation").alias("type"), (F.col("first") + 1).alias("start_idx"), (F.col("last") + 1).alias("end_idx"),
        (F.col("first") / fs).alias("start_t"), (F.col("last") / fs).alias("end_t"),
    )


def _state(r: Recordings, cond: DataFrame, min_sec: float, label: str) -> DataFrame:
    return intervals.to_samples(intervals.grid_runs(cond, r.config, min_sec, label), r.lengths, r.config)


def detect_shallow(r: Recordings) -> DataFrame:
    """Shallow, and not within a desaturation."""
    true = r.condition("shallow").where("flag")
    free = intervals.points_outside(true, r.desat, F.col("g") * float(r.config.grid_step_sec))
    return _state(r, free, r.config.shallow.min_dur_sec, "shallow_breathing")


def detect_irregular(r: Recordings) -> DataFrame:
    return _state(r, r.condition("irregular"), r.config.irregular.min_dur_sec, "irregular_breathing")


def depth_vote(r: Recordings, events: DataFrame, cond: DataFrame) -> DataFrame:
    """``share`` of the event's grid points that are shallow; null where there are none."""
    step = float(r.config.grid_step_sec)
    last = F.floor((F.col("n") - 1) / F.lit(r.config.grid_rows)).cast("long")
    spans = events.join(r.lengths, REC).withColumn("g", F.explode(F.sequence(
        F.least(last, F.round(F.col("start_t") / step).cast("long")), F.greatest(F.least(last, F.round(F.col("end_t") / step).cast("long")), F.least(last, F.round(F.col("start_t") / step).cast("long"))),
    )))
    votes = spans.join(cond, [*REC, "g"], "left").groupBy(*intervals.EVENT)
    return votes.agg(F.avg(F.col("flag").cast("double")).alias("share"))


def _rate(r: Recordings, name: str, p: Rate, label: str) -> DataFrame:
    events = _state(r, r.condition(name), p.min_dur_sec, label)
    if p.classify_depth:
        voted = depth_vote(r, events, r.condition(f"{name}_depth"))
        kind = F.when(F.col("share") >= 0.5, f"{label}_shallow").when(F.col("share").isNotNull(), f"{label}_deep").otherwise(label)
        events = voted.withColumn("type", kind).select(intervals.EVENT)
    if p.mark_desat:
        near = intervals.pad(r.desat, r.lengths, p.desat_delay_sec, r.config)
        events = _mark(intervals.with_overlap(events, near, "met"))
    return events


def _mark(events: DataFrame) -> DataFrame:
    kind = F.when(F.col("met"), F.concat("type", F.lit("_desat"))).otherwise(F.col("type"))
    return events.withColumn("type", kind).select(intervals.EVENT)


def detect_slow(r: Recordings) -> DataFrame:
    return _rate(r, "slow", r.config.slow, "slow_breathing")


def detect_rapid(r: Recordings) -> DataFrame:
    return _rate(r, "rapid", r.config.rapid, "rapid_breathing")


def detect_asynchrony(r: Recordings) -> DataFrame:
    """A placeholder: no rule is defined for this label, so there are no events."""
    return empty_events(r.signals.sparkSession)


def detect_desaturation(r: Recordings) -> DataFrame:
    return r.desat


def detect_apnea(r: Recordings) -> DataFrame:
    p = r.config.apnea
    events = _state(r, r.condition("apnea"), p.min_dur_sec, "apnea")
    if p.desat_pad_sec > 0:
        events = intervals.pad(events, r.lengths, p.desat_pad_sec, r.config)
    return _mark(intervals.with_overlap(events, r.desat, "met", p.desat_lag_sec)) if p.mark_desat else events


def sigh_intervals(r: Recordings) -> DataFrame:
    """An event for each flagged breath of each belt, between the middles to its neighbours."""
    fs = F.lit(float(r.config.fs))
    flags = grid.sigh_flags(r.breaths, r.config).where("flag")
    start = F.lit(0.5) * (F.col("prev_k") / fs + F.col("peak_k") / fs)
    end = F.lit(0.5) * (F.col("peak_k") / fs + F.col("next_k") / fs)
    raw = flags.select(*REC, F.concat(F.lit("sigh:"), "belt").alias("type"), F.lit(0).alias("start_idx"), F.lit(0).alias("end_idx"), start.alias("start_t"), end.alias("end_t"))
    placed = intervals.to_samples(raw.where("start_t is not null and end_t is not null"), r.lengths, r.config)
    return placed.select(*REC, F.substring_index("type", ":", -1).alias("belt"), F.lit("sigh").alias("type"), "start_idx", "end_idx", "start_t", "end_t")


def detect_sigh(r: Recordings) -> DataFrame:
    found = sigh_intervals(r)
    if r.config.sigh.use_either_belt:
        return intervals.merge(found.select(intervals.EVENT), r.config.sigh.merge_tol_sec, by_type=False)
    lungs, diaph = (found.where(F.col("belt") == b).select(intervals.EVENT) for b in ("lungs", "diaph"))
    return intervals.overlapping(lungs, diaph)


def sigh_frequency(r: Recordings, sighs: DataFrame | None = None) -> DataFrame:
    """Sighs with their middle in the ``freq_win_sec`` before each minute, and whether they are many."""
    p, c = r.config.sigh, r.config
    sighs = detect_sigh(r) if sighs is None else sighs
    points = grid.grid_points(r.lengths, p.freq_step_sec * c.fs).join(sighs.select(*REC).distinct(), REC, "left_semi")
    middles = sighs.select(*REC, (F.lit(0.5) * (F.col("start_t") + F.col("end_t"))).alias("m"))
    # A middle counts at the points from it on for the window's length.
    step = float(p.freq_step_sec)
    first = F.ceil(F.col("m") / step).cast("long")
    last = F.floor((F.col("m") + p.freq_win_sec) / step).cast("long")
    hits = middles.where(first <= last).select(*REC, F.explode(F.sequence(first, last)).alias("g")).groupBy(*REC, "g").agg(F.count(F.lit(1)).alias("sighs"))
    counted = points.join(hits, [*REC, "g"], "left").select(*REC, "g", F.coalesce("sighs", F.lit(0)).alias("sighs"))
    return counted.withColumn("many", F.col("sighs") >= p.freq_count)


#: Detectors in the order in which their events are put together. An extension adds its own.
DETECTORS: dict[str, Callable[[Recordings], DataFrame]] = {
    "ShB": detect_shallow, "IrB": detect_irregular, "SlB": detect_slow, "RaB": detect_rapid,
    "ReA": detect_asynchrony, "Des": detect_desaturation, "Apn": detect_apnea, "Sig": detect_sigh,
}
