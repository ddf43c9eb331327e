"""The registered queries of the labeling engine, over the driver's ``events`` table read as recordings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from breathmark.config import EVENTS_PROFILE as C
from breathmark.functions.normalize import normalize
from breathmark.operators import grid, intervals, signal
from breathmark.operators.asof import asof_join
from breathmark.operators.stretches import medians
from breathmark.oracles import ORACLES, SAMPLE_TYPES
from breathmark.plans import detectors, figures, pipeline
from breathmark.plans.detectors import Recordings
from breathmark.schema import REC
from breathmark.sources.adapter import signals_from_events
from breathmark.sources.recordings import file_name, read_recordings, read_results, write_recordings, write_results
from breathmark.sources.storage import durable, remove, shared_folder

KEY = signal.KEY
BELT = grid.BELT
#: Bytes of a split where a scan of files in splits is shown.
SPLIT = 16 << 10


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def _on(plan: Callable[[Recordings], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: plan(Recordings(signals_from_events(spark, sf_dir), C))


def _on_shared(plan: Callable[[Recordings], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """For plans that read samples, breaths and conditions several times: those tables are worked out first."""
    return lambda spark, sf_dir: plan(Recordings(signals_from_events(spark, sf_dir), C).settle())


def _on_breaths(plan: Callable[[Recordings], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """For plans that read breaths and their baseline: breaths are worked out first, once."""
    return lambda spark, sf_dir: plan(Recordings(signals_from_events(spark, sf_dir), C).settle_breaths())


def _on_events(plan: Callable[[Recordings], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """For plans that read windows once and place runs of them: breaths and lengths are worked out first, windows pass by."""
    return lambda spark, sf_dir: plan(Recordings(signals_from_events(spark, sf_dir), C).settle_breaths("lengths"))


def _on_conditions(plan: Callable[[Recordings], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """For plans that read several conditions: these are worked out in one pass over the windows."""
    return lambda spark, sf_dir: plan(Recordings(signals_from_events(spark, sf_dir), C).settle_breaths("lengths").settle_conditions())


def _smooth(r: Recordings) -> DataFrame:
    return signal.smoothed(r.signals, C)


def _proms(r: Recordings) -> DataFrame:
    return signal.pick_peaks(signal.smooth_candidates(r.signals, C), float("-inf"), None)


def _slow_runs(r: Recordings) -> DataFrame:
    return intervals.to_samples(intervals.grid_runs(r.condition("slow"), C, C.slow.min_dur_sec, "slow_breathing"), r.lengths, C)


def _apnea_runs(r: Recordings) -> DataFrame:
    return intervals.to_samples(intervals.grid_runs(r.condition("apnea"), C, C.apnea.min_dur_sec, "apnea"), r.lengths, C)


def _intersect(r: Recordings) -> DataFrame:
    found = detectors.sigh_intervals(r)
    lungs, diaph = (found.where(F.col("belt") == b).select(intervals.EVENT) for b in ("lungs", "diaph"))
    return intervals.overlapping(lungs, diaph)


def _types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event under one of the raw types, counted by the labels that these stand for."""
    raw = F.element_at(F.array(*map(F.lit, SAMPLE_TYPES)), (F.col("event_id") % len(SAMPLE_TYPES) + 1).cast("int"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", raw.alias("type"))
    return normalize(events).groupBy("event_type", "raw_type", "type", "desat", "depth").agg(F.count(F.lit(1)).alias("n"))


def _prctile(r: Recordings) -> DataFrame:
    low = replace(C, resp=replace(C.resp, trough_method="prctile", trough_prct=25.0))
    return signal.breath_table(r.signals, low).where("trough_k is not null").select(*KEY, "breath_no", "trough_k", *r6("trough_val"))


def _files(layout: str) -> Callable[[SparkSession, str], DataFrame]:
    """Recordings written as text files to the shared folder and read again."""

    def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = f"{shared_folder(spark)}/recordings-{uuid4().hex}"
        write_recordings(signals_from_events(spark, sf_dir), folder, layout)
        return read_recordings(spark, f"{folder}/*", layout).select(*REC, "k", "spo2", "resp_l", "resp_d")

    return scan


def _split_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings written as text files and read again in splits of SPLIT bytes, so that each is many splits. The bound holds for this scan only."""
    folder, name = f"{shared_folder(spark)}/recordings-{uuid4().hex}", "spark.sql.files.maxPartitionBytes"
    write_recordings(signals_from_events(spark, sf_dir), folder)
    before = spark.conf.get(name)
    spark.conf.set(name, SPLIT)
    try:
        return durable(read_recordings(spark, f"{folder}/*").select(*REC, "k", "spo2", "resp_l", "resp_d"))
    finally:
        spark.conf.set(name, before)
        remove(spark, folder)


def _last_breath(r: Recordings) -> DataFrame:
    """Each belt's last breath at or before each grid point, and how long ago it was."""
    points = grid.grid_points(r.lengths, C.grid_rows).join(r.breaths.select(*BELT).distinct(), REC).withColumn("at", F.col("g") * C.grid_rows)
    found = asof_join(points, r.breaths.select(*BELT, "peak_k", "amp"), BELT, "at", "peak_k")
    return found.select(*BELT, "g", "peak_k", *r6("amp"), (F.col("at") - F.col("peak_k")).alias("since"))


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results written by recording and read again."""
    folder = f"{shared_folder(spark)}/results-{uuid4().hex}"
    write_results(folder, {"events": Recordings(signals_from_events(spark, sf_dir), C).desat}, C)
    return read_results(spark, folder, "events").select(intervals.EVENT)


#: Detectors that need no breaths, or read two conditions.
HOW = {"Des": _on, "SlB": _on_conditions, "RaB": _on_conditions}

QUERIES = {
    "scan_wide_files": _files("wide"),
    "scan_channel_major_files": _files("channel_major"),
    "stored_events": _stored,
    "trough_prctile": _on(_prctile),
    "figure_traces": _on(lambda r: figures.traces(r.signals, C, 1, 10)),
    "figure_limits": _on(lambda r: figures.limits(r.signals).select(*REC, "channel", *r6("mean", "std", "least", "greatest"))),
    "figure_event_spans": _on(lambda r: figures.event_spans(r.desat, 100, 1000)),
    "figure_mask_spans": _on_breaths(lambda r: figures.mask_spans(r.condition("shallow"), C)),
    "scan_signals": _on(lambda r: r.signals.select(*REC, "k", "spo2", "resp_l", "resp_d")),
    "head_segment": _on(lambda r: signal.head_segment(r.signals, C).select(*REC, "k", "spo2")),
    "grid_points": _on(lambda r: grid.grid_points(r.lengths, 60)),
    "label_dictionary": _on_shared(lambda r: pipeline.label_counts(pipeline.pipeline_events(r), r.lengths)),
    "scan_split_files": _split_files,
    "recording_files": _on(lambda r: r.lengths.select(*REC, "n", F.format_string(file_name("%d", "%d"), *REC).alias("file"))),
    "config_rows": _on(lambda r: pipeline.row_counts(r.lengths, C)),
    "spo2_units": _on(lambda r: signal.oxygen_units(signal.spo2_baseline(r.signals, C)).select(*REC, *r6("spo2_median"), "plausible")),
    "belt_medians": _on(lambda r: medians(signal.belt_samples(r.signals, C), KEY, "x")),
    "sliding_median": _on(lambda r: grid.trailing_median(r.signals.select(*REC, "k", "spo2"), REC, "k", "spo2", 60).select(*REC, "k", *r6("median"))),
    "asof_breath": _on_breaths(_last_breath),
    "baseline_spo2": _on(lambda r: signal.spo2_baseline(r.signals, C).select(*REC, *r6("spo2_median", "spo2_mean"))),
    "detrend": _on(lambda r: signal.detrend(signal.belt_samples(r.signals, C))),
    "moving_mean": _on(lambda r: _smooth(r).select(*KEY, "k", *r6("x0"))),
    "local_maxima": _on(lambda r: signal.local_maxima(_smooth(r)).select(*KEY, "k", F.round("x0", 6).alias("h"))),
    "peak_prominence": _on(lambda r: _proms(r).select(*KEY, "k", *r6("h", "prominence"))),
    "peak_distance_nms": _on(
        lambda r: signal.pick_peaks(signal.smooth_candidates(r.signals, C), C.resp.min_peak_prom, C.peak_dist_rows).select(*KEY, "k")
    ),
    "breath_table": _on(
        lambda r: r.all_breaths.select(*KEY, "breath_no", "peak_k", *r6("peak_val"), "trough_k", *r6("trough_val", "amp", "ibi_s", "rr_bpm"))
    ),
    "trough_argmin": _on(lambda r: r.all_breaths.where("trough_k is not null").select(*KEY, "breath_no", "trough_k")),
    "ibi_rr": _on(lambda r: signal.rate_summary(r.all_breaths).select(*KEY, "n_peaks", *r6("rr_mean_bpm", "rr_std_bpm"))),
    "baseline_amp_ref": _on_breaths(
        lambda r: r.baseline.select(*REC, *r6("spo2_median", "spo2_mean", "lungs_amp_ref", "lungs_rr_ref", "diap_amp_ref", "diap_rr_ref"))
    ),
    "win_median_amp": _on_breaths(lambda r: r.windows(30).select(*BELT, "g", "n", *r6("med_amp"))),
    "win_rr": _on_breaths(lambda r: r.windows(30).select(*BELT, "g", "n", *r6("rr"))),
    "win_cov_rmssd": _on_breaths(lambda r: r.windows(30).select(*BELT, "g", *r6("cov", "rmssd"), "pauses")),
    "win_amp_ratio": _on_breaths(lambda r: grid.amp_ratio(r.windows(30)).select(*BELT, "g", *r6("ratio"))),
    "cond_shallow": _on_breaths(lambda r: r.condition("shallow")),
    "cond_slow": _on_breaths(lambda r: r.condition("slow")),
    "cond_rapid": _on_breaths(lambda r: r.condition("rapid")),
    "cond_irregular": _on_breaths(lambda r: r.condition("irregular")),
    "cond_apnea": _on_breaths(lambda r: r.condition("apnea")),
    "desat_flags": _on(lambda r: detectors.desat_flags(r.signals, C)),
    "runs_desat": _on(lambda r: r.desat),
    "runs_to_events": _on_breaths(
        lambda r: intervals.grid_runs(r.condition("irregular"), C, C.irregular.min_dur_sec, "irregular_breathing")
    ),
    "grid_to_sample": _on_events(_slow_runs),
    "pad_intervals": _on(lambda r: intervals.pad(r.desat, r.lengths, C.slow.desat_delay_sec, C)),
    "overlap_semi": _on_events(lambda r: intervals.overlapping(durable(_slow_runs(r)), r.desat)),
    "overlap_lag": _on_events(lambda r: intervals.with_overlap(_apnea_runs(r), r.desat, "met", C.apnea.desat_lag_sec)),
    "point_anti": _on_shared(
        lambda r: intervals.points_outside(r.condition("shallow").where("flag"), r.desat, F.col("g").cast("double")).select(*REC, "g")
    ),
    "intersect_events": _on_breaths(_intersect),
    "merge_within_type": _on_shared(lambda r: intervals.merge(pipeline.raw_events(r), C.merge_gap_sec)),
    "merge_tolerance": _on_breaths(lambda r: intervals.merge(detectors.sigh_intervals(r).select(intervals.EVENT), 0.5, by_type=False)),
    "depth_vote": _on_conditions(
        lambda r: detectors.depth_vote(r, _slow_runs(r), r.condition("slow_depth")).select(*intervals.EVENT, *r6("share"))
    ),
    "sigh_flags": _on_breaths(
        lambda r: grid.sigh_flags(r.breaths, C).select(*BELT, "peak_k", *r6("amp"), "n_prev", *r6("med_prev"), "flag")
    ),
    "sigh_intervals": _on_breaths(lambda r: detectors.sigh_intervals(r).select(*intervals.EVENT, "belt")),
    "sigh_frequency": _on_shared(detectors.sigh_frequency),
    "normalize_types": _types,
    **{f"detect_{label.lower()}": HOW.get(label, _on_events)(detect) for label, detect in detectors.DETECTORS.items() if label != "ReA"},
    "detect_rea": _on(lambda r: pipeline.recording_counts(detectors.detect_asynchrony(r), r.lengths)),
    "pipeline_events": _on_shared(pipeline.pipeline_events),
    "event_sample_mask": _on(lambda r: intervals.event_sample_mask(r.desat, r.signals, C)),
    "sample_mask": _on_shared(lambda r: intervals.sample_mask(r.signals, durable(pipeline.pipeline_events(r)))),
    "label_order": _on_shared(lambda r: intervals.label_order(pipeline.pipeline_events(r))),
    "label_cube": _on_shared(lambda r: pipeline.label_cube(pipeline.pipeline_events(r))),
}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Desaturations, end to end: scan, baseline, flags, runs."""
    return QUERIES["detect_des"](spark, sf_dir)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
