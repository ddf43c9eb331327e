"""The whole pipeline: signals to merged, normalised events, masks and stored results."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from breathmark.config import Config
from breathmark.functions.normalize import normalize
from breathmark.operators import intervals
from breathmark.operators.signal import oxygen_units
from breathmark.plans.detectors import DETECTORS, Recordings
from breathmark.schema import LABELS, REC
from breathmark.sources.recordings import read_recordings, write_results
from breathmark.sources.storage import durable


def raw_events(r: Recordings) -> DataFrame:
    return intervals.concat([detect(r) for detect in DETECTORS.values()])


def pipeline_events(r: Recordings) -> DataFrame:
    """All detectors' events, merged within raw types, then normalised. The detectors' plans are run first: what follows reads a row an event."""
    return normalize(intervals.merge(durable(raw_events(r)), r.config.merge_gap_sec)).select(
        *REC, "type", "start_idx", "end_idx", "start_t", "end_t", "desat", "depth", "raw_type"
    )


def recording_counts(events: DataFrame, lengths: DataFrame) -> DataFrame:
    """How many of ``events`` each recording has, none too."""
    counted = events.groupBy(*REC).agg(F.count(F.lit(1)).alias("n_events"))
    return lengths.select(*REC).join(counted, REC, "left").select(*REC, F.coalesce("n_events", F.lit(0)).alias("n_events"))


def label_counts(events: DataFrame, lengths: DataFrame) -> DataFrame:
    """The label dictionary for each recording, with how many events each label has there."""
    labels = F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(long).alias("long_name"), F.lit(short).alias("short_name")) for i, long, short in LABELS])
    counted = events.groupBy(*REC, F.col("type").alias("short_name")).agg(F.count(F.lit(1)).alias("n_events"))
    found = lengths.select(*REC, F.inline(labels)).join(counted, [*REC, "short_name"], "left")
    return found.select(*REC, "idx", "long_name", "short_name", F.coalesce("n_events", F.lit(0)).alias("n_events"))


def row_counts(lengths: DataFrame, config: Config) -> DataFrame:
    """What the configuration's seconds come to in rows of each recording."""
    n = F.col("n")
    return lengths.select(
        *REC, (n / F.lit(float(config.fs))).alias("seconds"), F.least(n, F.lit(config.baseline_sec * config.fs)).alias("baseline_rows"),
        F.lit(config.smooth_rows).alias("smooth_rows"), F.lit(config.peak_dist_rows).alias("peak_dist_rows"),
        (F.floor((n - 1) / F.lit(config.grid_rows)) + 1).alias("grid_points"), F.lit(intervals.rows_for(config.spo2.min_dur_sec, config)).alias("desat_rows"),
    )


def label_cube(events: DataFrame) -> DataFrame:
    """Number and seconds of events by condition and label, with totals."""
    return events.cube("condition", "type").agg(
        F.count(F.lit(1)).alias("n_events"), F.round(F.sum(F.col("end_t") - F.col("start_t")), 6).alias("seconds")
    )


def run(spark: SparkSession, paths: str | list[str], out: str, config: Config | None = None, layout: str = "wide") -> None:
    """Reads recordings, labels them and writes ``events``, ``mask``, ``baseline``, ``config`` and ``labels`` under ``out``.

    Warns of recordings whose oxygen signal is not in per cent: a normalised one would be one desaturation.
    """
    config = config or Config()
    r = Recordings(read_recordings(spark, paths, layout), config).settle()
    odd = oxygen_units(r.baseline).where("not plausible").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*REC)).alias("one")).first()
    if odd["n"]:
        warnings.warn(f"{odd['n']} recordings have a median oxygen saturation outside of 50 to 100, one of them {tuple(odd['one'])}", stacklevel=2)
    events = durable(pipeline_events(r))
    write_results(out, {"events": events, "mask": intervals.sample_mask(r.signals, events), "baseline": r.baseline}, config)
