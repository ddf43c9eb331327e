"""Operators against worked examples."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from breathmark.config import Breathing, Config, Oxygen
from breathmark.functions.normalize import normalize
from breathmark.operators import grid, intervals, signal
from breathmark.plans import detectors
from breathmark.schema import EVENTS, label_dictionary

KEYED = "subject int, condition int, segment string, belt string, k long"
ONE = Config(fs=1, resp=Breathing(min_peak_dist_sec=1, min_peak_prom=1.5, smooth_sec=0), spo2=Oxygen(90, 3, 1))


def samples(spark, xs, name="x0"):
    return spark.createDataFrame([(1, 1, "full", "lungs", k, None if x is None else float(x)) for k, x in enumerate(xs)], f"{KEYED}, {name} double")


def events(spark, rows, kind="a"):
    full = [(1, 1, r[2] if len(r) > 2 else kind, int(r[0]) + 1, int(r[1]) + 1, float(r[0]), float(r[1])) for r in rows]
    return spark.createDataFrame(full, EVENTS)


def times(df):
    return sorted((r["type"], r["start_t"], r["end_t"]) for r in df.collect())


def peaks(spark, xs, prominence=1.5, distance=1):
    found = signal.pick_peaks(signal.candidates(samples(spark, xs)), prominence, distance)
    return sorted((r["k"], r["prominence"]) for r in found.collect())


def test_moving_mean(spark):
    got = signal.moving_mean(samples(spark, [1, 2, 3, 4, 5], "x"), 4).orderBy("k").collect()
    assert [r["x0"] for r in got] == [1.5, 2, 2.5, 3.5, 4]
    got = signal.moving_mean(samples(spark, [1, None, 3], "x"), 3).orderBy("k").collect()
    assert [r["x0"] for r in got] == [1, 2, 3]


def test_peaks(spark):
    xs = [0, 3, 1, 5, 2, 4, 0]
    assert peaks(spark, xs) == [(1, 2), (3, 5), (5, 2)]
    assert [k for k, _ in peaks(spark, xs, distance=2)] == [3]
    assert [k for k, _ in peaks(spark, [0, 2, 2, 1], 1)] == [1]
    assert peaks(spark, [5, 1, 4, None, 4, 0, 3]) == []
    assert peaks(spark, [1, 1, 1]) == []


def test_prominence_by_definition():
    rng = np.random.default_rng(0)
    for _ in range(200):
        x = rng.permutation(30).astype(float)
        top = [i for i in range(1, 29) if x[i] > x[i - 1] and x[i] > x[i + 1]]
        if not top:
            continue
        cuts = [0, *top, 29]
        low = np.array([x[a : b + 1].min() for a, b in zip(cuts, cuts[1:-1], strict=False)])
        got = signal.prominences(x[top], low, x[top[-1] :].min())
        for i, p in zip(top, got, strict=True):
            left = max([j for j in range(i) if x[j] > x[i]], default=0)
            right = min([j for j in range(i + 1, 30) if x[j] > x[i]], default=29)
            assert p == x[i] - max(x[left : i + 1].min(), x[i : right + 1].min())


def test_spacing_by_definition():
    rng = np.random.default_rng(1)
    for _ in range(100):
        k = np.unique(rng.integers(0, 60, 20))
        h = rng.integers(0, 5, len(k)).astype(float)
        kept = []
        for i in sorted(range(len(k)), key=lambda i: (-h[i], k[i])):
            if all(abs(k[i] - k[j]) > 4 for j in kept):
                kept.append(i)
        assert np.flatnonzero(signal.spaced(k, h, 4)).tolist() == sorted(kept)


def test_breaths_over_missing_samples(spark):
    x = samples(spark, [0, 5, 1, None, 0.5, None, 2, 5, 3])
    rows = signal.breaths_of(x, signal.pick_peaks(signal.candidates(x), 1.5, 1), Config(fs=1, resp=Breathing(1, 1.5, 2, 0))).orderBy("peak_k").collect()
    assert [(r["peak_k"], r["trough_k"], r["trough_val"], r["amp"]) for r in rows] == [(1, 4, 0.5, 4.5), (7, None, None, None)]


@pytest.mark.parametrize("method", ["min", "prctile"])
def test_breaths(spark, method):
    config = Config(fs=1, resp=Breathing(1, 1.5, 3, 0, method, 5.0))
    x = samples(spark, [0, 3, 1, 5, 2, 4, 0])
    rows = signal.breaths_of(x, signal.pick_peaks(signal.candidates(x), 1.5, 1), config).orderBy("peak_k").collect()
    assert [(r["peak_k"], r["trough_k"], r["amp"], r["ibi_s"], r["rr_bpm"]) for r in rows] == [(1, 2, 2, 2, 30), (3, 4, 3, 2, 30), (5, None, None, None, None)]
    few = Config(fs=1, resp=Breathing(1, 1.5, 4, 0, method))
    assert signal.breaths_of(x, signal.pick_peaks(signal.candidates(x), 1.5, 1), few).count() == 0


def test_trough_ties_take_the_first(spark):
    x = samples(spark, [0, 5, 1, 2, 1, 5, 0, 5, 0])
    rows = signal.breaths_of(x, signal.pick_peaks(signal.candidates(x), 1.5, 1), ONE).orderBy("peak_k").collect()
    assert [r["trough_k"] for r in rows] == [2, 6, None]


def test_runs(spark):
    cond = spark.createDataFrame([(1, 1, g, bool(f)) for g, f in enumerate([0, 1, 1, 1, 0, 1, 1])], "subject int, condition int, g long, flag boolean")
    assert [tuple(r)[3:] for r in intervals.grid_runs(cond, ONE, 3, "x").collect()] == [(2, 4, 1.0, 3.0)]
    assert intervals.least_points(30, 1.0) == 30 and intervals.least_points(0, 1.0) == 1 and intervals.least_points(5, 0.5) == 3


def test_merge(spark):
    rows = events(spark, [(0, 5, "A"), (5, 7, "A"), (8, 9, "A"), (5, 6, "B")])
    assert times(intervals.merge(rows, 0)) == [("A", 0, 7), ("A", 8, 9), ("B", 5, 6)]
    assert times(intervals.merge(rows, 1)) == [("A", 0, 9), ("B", 5, 6)]
    assert times(intervals.merge(rows, 0, by_type=False)) == [("A", 0, 7), ("A", 8, 9)]
    once = intervals.merge(rows, 1)
    assert times(intervals.merge(once, 1)) == times(once)
    inner = events(spark, [(0, 10), (1, 2), (3, 4), (9, 12)])
    assert times(intervals.merge(inner, 0)) == [("a", 0, 12)]


def test_overlap(spark):
    one = events(spark, [(1, 2)])
    for other, met in (((2, 3), True), ((2.001, 3), False), ((0, 1), True), ((0, 0.5), False)):
        assert intervals.overlapping(one, events(spark, [other])).count() == met
        assert intervals.with_overlap(one, events(spark, [other]), "met").first()["met"] == met
    assert intervals.with_overlap(one, events(spark, [(46, 47)]), "met", 45).first()["met"]
    assert not intervals.with_overlap(one, events(spark, []), "met").first()["met"]


def test_padding_and_samples(spark):
    n = spark.createDataFrame([(1, 1, 101)], "subject int, condition int, n long")
    assert times(intervals.pad(events(spark, [(10, 95)]), n, 20, ONE)) == [("a", 0, 100)]
    n = spark.createDataFrame([(1, 1, 100)], "subject int, condition int, n long")
    rows = intervals.to_samples(events(spark, [(-0.4, 250), (1.5, 2.5)]), n, ONE).orderBy("start_idx").collect()
    assert [(r["start_idx"], r["end_idx"], r["end_t"]) for r in rows] == [(1, 100, 99), (3, 4, 3)]


def test_points_outside(spark):
    pts = spark.createDataFrame([(1, 1, g) for g in range(6)], "subject int, condition int, g long")
    left = intervals.points_outside(pts, events(spark, [(1, 2), (4, 4)]), F.col("g").cast("double"))
    assert sorted(r["g"] for r in left.collect()) == [0, 3, 5]


def breaths(spark, lungs, diaph=None, amp=1.0):
    rows = [(1, 1, b, int(k), None if a is None else float(a), amp) for b, ks in (("lungs", lungs), ("diaph", lungs if diaph is None else diaph)) for k, a in ks]
    return spark.createDataFrame(rows, "subject int, condition int, belt string, peak_k long, amp double, amp_ref double")


def length(spark, n):
    return spark.createDataFrame([(1, 1, n)], "subject int, condition int, n long")


def test_trailing_window_is_closed(spark):
    config = Config(fs=1)
    w = grid.windows(breaths(spark, [(0, 1), (30, 1), (60, 1)]), length(spark, 70), 60, config)
    rows = {r["g"]: r for r in w.where("belt = 'lungs'").collect()}
    assert rows[60]["n"] == 3 and rows[60]["rr"] == 2 and rows[61]["n"] == 2 and rows[29]["n"] == 1
    flags = {r["g"]: r["flag"] for r in grid.slow(w, config.slow, config).collect()}
    assert flags[60] and not flags[61] and not flags[59]


def test_irregular(spark):
    config = Config(fs=1)
    w = grid.windows(breaths(spark, [(0, 1), (2, 1), (4, 1), (8, 1)]), length(spark, 80), 60, config)
    row = w.where("belt = 'lungs' and g = 60").first()
    assert row["cov"] == pytest.approx(0.4330, abs=1e-4) and row["rmssd"] == pytest.approx(1.4142, abs=1e-4)
    assert {r["g"] for r in grid.irregular(w, config).where("flag").collect()} == {60, 61, 62}
    w = grid.windows(breaths(spark, [(0, 1), (2, 1), (12, 1), (14, 1)]), length(spark, 80), 60, config)
    # The pause leaves the window with its first peak.
    assert {r["g"] for r in grid.irregular(w, config).where("flag").collect()} == set()


@pytest.mark.parametrize("stretch", [1, 3, 64])
def test_windows_by_brute_force(spark, monkeypatch, stretch):
    monkeypatch.setattr(grid, "STRETCH", stretch)
    rng = np.random.default_rng(5)
    ks = np.unique(rng.integers(0, 300, 60))
    rows = [(k, None if i % 9 == 4 else float(rng.integers(1, 9))) for i, k in enumerate(ks)]
    config = Config(fs=2)
    got = grid.windows(breaths(spark, rows), length(spark, 300), 20, config).where("belt = 'lungs'").collect()
    assert len(got) == 150
    for r in got:
        own = [(k, a) for k, a in rows if 2 * r["g"] - 40 <= k <= 2 * r["g"]]
        amps = [a for _, a in own if a is not None]
        ibi = np.diff([k for k, _ in own]) / 2
        assert r["n"] == len(own)
        assert (r["med_amp"] is None) == (not amps) and (not amps or r["med_amp"] == np.median(amps))
        if len(own) >= 3:
            assert r["rr"] == pytest.approx(60 / ibi.mean()) and r["cov"] == pytest.approx(ibi.std(ddof=1) / ibi.mean(), abs=1e-9)
            assert r["rmssd"] == pytest.approx(np.sqrt(np.mean(np.diff(ibi) ** 2)), abs=1e-9) and r["pauses"] == (ibi >= 10).sum()


def test_missing_amplitudes_count_as_rows(spark):
    config = Config(fs=1)
    w = grid.windows(breaths(spark, [(10, 0.7), (20, 0.7), (30, None)]), length(spark, 62), 60, config)
    assert {r["g"] for r in grid.shallow_of(w, config, config.shallow).where("flag").collect()} == {60, 61}


def test_sighs(spark):
    config = Config(fs=1)
    rows = grid.sigh_flags(breaths(spark, [(0, 1), (20, 1), (40, 1), (60, 1.5), (80, None)]), config).where("belt = 'lungs' and flag").collect()
    assert [r["peak_k"] for r in rows] == [60]
    r = type("R", (), {"config": config, "breaths": breaths(spark, [(0, 1), (20, 1), (40, 1), (60, 1.5), (80, None)]), "lengths": length(spark, 100)})
    assert times(detectors.detect_sigh(r)) == [("sigh", 50, 70)]
    freq = detectors.sigh_frequency(r, detectors.detect_sigh(r)).orderBy("g").collect()
    assert [(x["g"], x["sighs"], x["many"]) for x in freq] == [(0, 0, False), (1, 1, False)]


def test_desaturation_samples(spark):
    def flags(base, xs):
        rows = [(1, 1, k, float(x) if x is not None else None) for k, x in enumerate([base] * 60 + xs)]
        df = spark.createDataFrame(rows, "subject int, condition int, k long, spo2 double")
        return [r["flag"] for r in detectors.desat_flags(df, ONE).where("k >= 60").orderBy("k").collect()]

    assert flags(97, [94, 94.5, None, float("-inf")]) == [True, False, False, False]
    assert flags(92, [90, 89.9]) == [False, True]


def test_normalize(spark):
    raw = ["slow_breathing_shallow_desat", "apnea_desat", "desaturation", "Rapid Breathing", "foo-bar", " SHB "]
    got = [(r["type"], r["depth"], r["desat"]) for r in normalize(spark.createDataFrame([(x,) for x in raw], "type string")).collect()]
    assert got == [("SlB", "shallow", True), ("Apn", "", True), ("Des", "", True), ("RaB", "", False), ("foo_bar", "", False), ("ShB", "", False)]


def test_masks(spark):
    signals = spark.createDataFrame([(1, 1, k) for k in range(6)], "subject int, condition int, k long")
    rows = events(spark, [(1, 2, "ShB"), (2, 3, "ShB"), (4, 99, "Apn")])
    got = intervals.sample_mask(signals, rows).orderBy("k").collect()
    assert [(r["ShB"], r["Apn"], r["Sig"]) for r in got] == [(k in (1, 2, 3), k >= 4, False) for k in range(6)]
    merged = intervals.sample_mask(signals, intervals.merge(rows, 0)).orderBy("k").collect()
    assert merged == got
    flat = intervals.event_sample_mask(rows, signals, ONE).where("flag")
    assert sorted(r["k"] for r in flat.collect()) == [1, 2, 3, 4, 5]


def test_labels(spark):
    assert [r["short_name"] for r in label_dictionary(spark).orderBy("idx").collect()] == ["ShB", "IrB", "SlB", "RaB", "ReA", "Des", "Apn", "Sig"]


def test_windows_deal_breaths_not_points(spark, monkeypatch):
    rows, config = [(k, float(k % 7)) for k in range(3, 40, 5)], Config(fs=1)
    w = grid.windows(breaths(spark, rows), length(spark, 400), 20, config)
    assert "Window [" not in w._jdf.queryExecution().executedPlan().toString()  # no row of the grid is sorted or framed in the JVM
    monkeypatch.setattr(grid, "STRETCH", 1)
    cut = grid.windows(breaths(spark, rows), length(spark, 400), 20, config)
    assert sorted(map(str, w.collect())) == sorted(map(str, cut.collect()))
    asked = []
    monkeypatch.setattr(grid, "SlidingMedian", type("Counted", (grid.SlidingMedian,), {"median": property(lambda self: asked.append(1) or grid_median(self))}))
    k = np.array([0, 10, 20])
    assert grid.sliding(k, np.array([1.0, 3.0, 5.0]), np.arange(30), -5, 0) == [1.0] * 6 + [None] * 4 + [3.0] * 6 + [None] * 4 + [5.0] * 6 + [None] * 4
    assert len(asked) == 6  # only where the window's content changes


def grid_median(window):
    return 0.5 * window.own[(len(window.own) - 1) // 2] + 0.5 * window.own[len(window.own) // 2] if window.own else None
