"""Sources, whole recordings, streaming and the driver's entry."""

import math
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from breathmark.config import Breathing, Config, Rate
from breathmark.operators import grid
from breathmark.plans import figures, pipeline
from breathmark.plans.detectors import DETECTORS, Recordings
from breathmark.schema import EVENTS, LABELS, SIGNALS
from breathmark.sources import recordings
from breathmark.sources.recordings import read_recordings, write_recordings

FS = 4
CONFIG = Config(fs=FS, resp=Breathing(min_peak_dist_sec=0.8, min_peak_prom=0.2, smooth_sec=0.25))


def breathe(seconds, bpm=15, amp=1.0, spo2=97.0):
    return [(amp, bpm, spo2)] * (seconds * FS)


def recording(parts):
    """Sine belts, the phase running on from part to part."""
    rows, phase = [], 0.0
    for k, (amp, bpm, spo2) in enumerate(parts):
        phase += 2 * math.pi * bpm / 60 / FS
        y = amp * math.sin(phase) / 2
        rows.append((k, float(spo2), y, y))
    return rows


def signals(spark, *recs):
    rows = [(s + 1, 1, *row) for s, rec in enumerate(recs) for row in recording(rec)]
    return spark.createDataFrame(rows, "subject int, condition int, k long, spo2 double, resp_l double, resp_d double")


def labels(rows):
    out = {}
    for r in rows:
        out.setdefault((r["subject"], r["type"]), []).append((r["start_t"], r["end_t"]))
    return out


def test_recordings(spark):
    base = breathe(90)
    recs = [
        base + breathe(150),
        base + breathe(150, bpm=8),
        base + breathe(150, bpm=25),
        base + breathe(150, amp=0.72),
        base + breathe(20, spo2=93) + breathe(60),
        base + breathe(9, spo2=85) + breathe(60),
        breathe(30),
        [(0.0, 15, 97.0)] * 800,
    ]
    rows = pipeline.pipeline_events(Recordings(signals(spark, *recs), CONFIG).settle()).collect()
    got = labels(rows)
    assert not [k for k in got if k[0] in (1, 6, 8)]
    assert (2, "SlB") in got and (3, "RaB") in got and (4, "ShB") in got
    assert got[5, "Des"] == [(90.0, 109.75)]
    slow = next(r for r in rows if r["subject"] == 2 and r["type"] == "SlB")
    assert slow["depth"] == "deep" and not slow["desat"] and slow["raw_type"] == "slow_breathing_deep"
    alone = labels(DETECTORS["Des"](Recordings(signals(spark, recs[4]), CONFIG)).collect())
    assert alone[1, "desaturation"] == got[5, "Des"]


def test_samples_and_conditions_are_worked_out_once(spark):
    """Plans over settled tables read stored samples and conditions, not the source or the windows again; flags are those of each condition alone."""
    config = replace(CONFIG, rapid=Rate(rr_bpm=20.0, win_sec=30))
    source = signals(spark, breathe(90) + breathe(80, bpm=8) + breathe(80, bpm=25, amp=0.7))
    lazy, r = Recordings(source, config).settle_breaths(), Recordings(source, config).settle()
    assert r.signals.inputFiles() and lazy.signals.inputFiles() and r.signals.count() == source.count()
    plan = pipeline.raw_events(r)._jdf.queryExecution().optimizedPlan().toString()
    assert "belts" not in plan
    some = 0
    for name, (win, rule) in grid.conditions(config).items():
        alone = {(x["g"], x["flag"]) for x in grid.at_points(lazy.windows(win), flag=rule).collect()}
        assert {(x["g"], x["flag"]) for x in r.condition(name).collect()} == alone and len(alone) == 250, name
        some += any(flag for _, flag in alone)
    assert some > 3


def test_apnea_and_sigh(spark):
    config = replace(CONFIG, resp=Breathing(0.8, 0.02, 3, 0.25))
    sigh = breathe(92) + breathe(4, amp=2.5) + breathe(60)
    r = Recordings(signals(spark, breathe(90) + breathe(80, amp=0.05, spo2=85) + breathe(60), sigh), config).settle()
    rows = pipeline.pipeline_events(r).collect()
    got = labels(rows)
    assert (1, "Apn") in got and (2, "Sig") in got
    row = next(r for r in rows if r["type"] == "Apn")
    assert row["desat"] and row["raw_type"] == "apnea_desat"
    assert DETECTORS["ReA"](r).count() == 0


def test_files(spark, tmp_path):
    rec = recording(breathe(70) + breathe(20, spo2=80) + breathe(10))
    wide = "\n".join(f"0 1.5 {s} {a:.6f},2 {b:.6f}" for _, s, a, b in rec) + "\n"
    (tmp_path / recordings.file_name(42, 1)).write_text(wide)
    got = recordings.read_recordings(spark, str(tmp_path))
    assert got.count() == len(rec) and got.where("subject = 42 and condition = 1").count() == len(rec)
    assert got.orderBy("k").first()["ecg2"] == 1.5
    other = tmp_path / "flat"
    other.mkdir()
    columns = [[0] * len(rec), [1.5] * len(rec), [s for _, s, _, _ in rec], [round(a, 6) for _, _, a, _ in rec], [2] * len(rec), [round(b, 6) for *_, b in rec]]
    (other / recordings.file_name(42, 1)).write_text(" ".join(str(x) for c in columns for x in c).replace("2 2 ", "2 NaN ", 1))
    flat = recordings.read_recordings(spark, str(other), "channel_major")
    assert flat.drop("bp").orderBy("k").collect() == got.drop("bp").orderBy("k").collect() and flat.where("bp is null").count() == 1
    out = str(tmp_path / "out")
    pipeline.run(spark, str(tmp_path / recordings.file_name(42, 1)), out, CONFIG)
    events = recordings.read_results(spark, out, "events").where("subject = 42")
    assert [(r["type"], r["start_t"]) for r in events.collect()] == [("Des", 70.0)]
    assert recordings.read_results(spark, out, "mask").where("Des").count() == 20 * FS
    (tmp_path / "bad_Sub1_Pom1.dat").write_text("1 2 3\n")
    with pytest.raises(Exception, match="six numbers"):
        recordings.read_recordings(spark, str(tmp_path / "bad_Sub1_Pom1.dat")).collect()
    assert recordings.file_names([1, 2], [1, 2])[3].endswith("Sub2_Pom2_DeTr_Norm.dat")


def test_stream_equals_batch(spark, tmp_path):
    from breathmark.plans.detectors import desaturations
    from breathmark.operators.signal import spo2_baseline
    from breathmark.streaming.desaturation import desaturation_stream, flagged

    pytest.importorskip("google.protobuf")
    df = signals(spark, breathe(70) + breathe(20, spo2=80) + breathe(10), breathe(65) + breathe(12, spo2=90) + breathe(5)).select("subject", "condition", "k", "spo2")
    for i, (a, b) in enumerate(((0, 300), (300, 330), (330, 1000))):
        df.where(f"k >= {a} and k < {b}").coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
    conf = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        events = desaturation_stream(flagged(stream, spo2_baseline(df, CONFIG).select("subject", "condition", "spo2_median"), CONFIG), CONFIG)
        query = events.writeStream.format("memory").queryName("desats").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        query.awaitTermination(180)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", conf)
    assert sorted(map(tuple, spark.table("desats").collect())) == sorted(map(tuple, desaturations(df, CONFIG).collect()))


def test_late_stream_equals_batch(spark, tmp_path):
    from breathmark.operators.signal import spo2_baseline
    from breathmark.plans.detectors import desaturations
    from breathmark.streaming.desaturation import flagged, late_desaturation_stream

    pytest.importorskip("google.protobuf")
    df = signals(spark, breathe(70) + breathe(20, spo2=80) + breathe(10), breathe(65) + breathe(12, spo2=90) + breathe(5)).select("subject", "condition", "k", "spo2")
    df = df.withColumn("ts", F.timestamp_millis(F.lit(1_700_000_000_000) + F.col("k") * (1000 // FS)))
    # Batches overlap in time by five seconds: samples are dealt to one of two, some come twice; the last one is an hour on.
    late = F.when(F.pmod(F.xxhash64("k"), F.lit(3)) == 0, F.least(F.floor((F.col("k") + 20) / 60), F.lit(6))).otherwise(F.floor(F.col("k") / 60))
    dealt = df.withColumn("part", late).union(df.where("k % 50 = 0").withColumn("part", F.floor(F.col("k") / 60)))
    end = df.groupBy("subject", "condition").agg((F.max("k") + 3600 * FS).alias("k"), F.lit(97.0).alias("spo2"))
    dealt = dealt.union(end.select("subject", "condition", "k", "spo2", F.timestamp_millis(F.lit(1_700_000_000_000) + F.col("k") * (1000 // FS)).alias("ts"), F.lit(9).alias("part")))
    for i in range(10):
        dealt.where(F.col("part") == i).drop("part").orderBy(F.rand(i)).coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
    conf = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        flags = flagged(stream, spo2_baseline(df, CONFIG).select("subject", "condition", "spo2_median"), CONFIG)
        query = late_desaturation_stream(flags, CONFIG, "20 seconds").writeStream.format("memory").queryName("late_desats").option(
            "checkpointLocation", f"{tmp_path}/cp"
        ).trigger(availableNow=True).start()
        query.awaitTermination(240)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", conf)
    assert sorted(map(tuple, spark.table("late_desats").collect())) == sorted(map(tuple, desaturations(df, CONFIG).collect()))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_files_round_trip_and_one_file_a_recording(spark, tmp_path):
    rows = [(s, 1, k, float(k) / 3, None, float("nan"), -1e-7 * k, None, 5.0) for s in (1, 22) for k in range(7)]
    signals = spark.createDataFrame(rows, SIGNALS)
    for layout in ("wide", "channel_major"):
        write_recordings(signals, f"{tmp_path}/{layout}", layout)
        got = read_recordings(spark, f"{tmp_path}/{layout}/*", layout)
        want = [(*r[:4], None, None, r[6], None, 5.0) for r in rows]
        assert sorted(map(tuple, got.collect())) == want
    write_recordings(signals.where("subject = 1"), f"{tmp_path}/again")
    with pytest.raises(Exception, match="more than one file of subject 1, condition 1"):
        read_recordings(spark, [f"{tmp_path}/wide/*", f"{tmp_path}/again/*"]).collect()


def test_results_come_with_their_labels_and_odd_units_are_told(spark, tmp_path):
    rows = [(k, 0.1 * math.sin(k), math.sin(k / 3), math.sin(k / 3)) for k in range(90 * FS)]
    (tmp_path / recordings.file_name(5, 2)).write_text("\n".join(f"0 0 {s:.4f} {a:.4f} 0 {b:.4f}" for _, s, a, b in rows))
    with pytest.warns(UserWarning, match="1 recordings have a median oxygen saturation outside"):
        pipeline.run(spark, str(tmp_path / recordings.file_name(5, 2)), f"{tmp_path}/out", CONFIG)
    assert sorted(map(tuple, recordings.read_labels(spark, f"{tmp_path}/out").collect())) == LABELS
    config = spark.read.text(f"{tmp_path}/out/config").first()[0]
    assert config == CONFIG.to_json()


def test_spans_are_clipped_to_the_viewport(spark):
    events = spark.createDataFrame([(1, 1, "a", 1, 5, 0.0, 4.0), (1, 1, "a", 9, 12, 8.0, 11.0), (1, 1, "a", 20, 21, 19.0, 20.0)], EVENTS)
    got = sorted(tuple(r)[3:] for r in figures.event_spans(events, 2, 10).collect())
    assert got == [(2.0, 4.0), (8.0, 10.0)]
