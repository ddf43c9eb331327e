"""Operators in stretches: results do not depend on where sequences are cut, and equal plain ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from breathmark.config import Config
from breathmark.operators import grid, intervals, signal
from breathmark.operators.asof import asof_join
from breathmark.operators.stretches import carried, dealt, medians, value_bin
from breathmark.schema import EVENTS
from breathmark.sources.recordings import read_recordings

KEYED = "subject int, condition int, segment string, belt string, k long"


def samples(spark, waves, name="x0"):
    rows = [(s, 1, "full", "lungs", k, None if x is None else float(x)) for s, xs in enumerate(waves) for k, x in enumerate(xs)]
    return spark.createDataFrame(rows, f"{KEYED}, {name} double").repartition(3)


def plain_maxima(xs):
    """(k, height) of runs that are higher than the runs before and after."""
    runs = [(k, x) for k, x in enumerate(xs) if k == 0 or x != xs[k - 1]]
    return [b for a, b, c in zip(runs, runs[1:], runs[2:], strict=False) if None not in (a[1], b[1], c[1]) and b[1] > a[1] and b[1] > c[1]]


def test_rows_go_to_all_stretches_that_see_them(spark):
    rows = dealt(spark.range(20).select(F.col("id").alias("k")), "k", 5, before=2, after=1).collect()
    for s in range(4):
        assert sorted(r["k"] for r in rows if r["stretch"] == s) == [k for k in range(20) if 5 * s - 2 <= k <= 5 * s + 5]
    assert sorted(r["k"] for r in rows if r["own"]) == list(range(20))


def test_carried_by_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(int(key), k, None if rng.random() < 0.3 else float(rng.integers(0, 9))) for key in range(3) for k in range(40)]
    df = spark.createDataFrame(rows, "key int, k long, x double").withColumn("block", F.floor(F.col("k") / 7)).where("not (key = 1 and block in (2, 3))")
    x = F.col("x")
    got = carried(df, ["key"], "block", ["k"], a=("sum", x), b=("max", x), c=("last", x), d=("prev", x), e=("next", x), f=("all_sum", x), g=("all_max", x)).collect()
    for key in range(3):
        own = [r for r in rows if r[0] == key and not (key == 1 and r[1] // 7 in (2, 3))]
        found = {r["k"]: r for r in got if r["key"] == key}
        assert len(found) == len(own)
        for i, (_, k, _) in enumerate(own):
            before, there = [r[2] for r in own[:i]], [r[2] for r in own if r[2] is not None]
            known = [v for v in before if v is not None]
            want = (sum(known), max(known, default=None), known[-1] if known else None, before[-1] if before else None, own[i + 1][2] if i + 1 < len(own) else None)
            assert tuple(found[k][c] for c in "abcde") == want and (found[k]["f"], found[k]["g"]) == (sum(there), max(there))


def test_value_bins_never_fall(spark):
    rng = np.random.default_rng(1)
    xs = np.sort(np.concatenate([rng.normal(0, 10.0**p, 200) for p in range(-300, 300, 40)] + [[0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308, np.inf, -np.inf, 1.0, 2.0, 4.0, np.nextafter(2, 0)]]))
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    bins = np.array([r["b"] for r in df.select("x", value_bin(F.col("x")).alias("b")).orderBy("x").collect()])
    assert (np.diff(bins) >= 0).all() and len(set(bins.tolist())) > 2000


def test_medians_by_brute_force(spark):
    rng = np.random.default_rng(2)
    waves = [rng.normal(0, 5, 501), rng.integers(0, 4, 400), np.full(33, 7.25), [3.5], [None, 2.0, None, 4.0], [None, None], rng.normal(0, 1e-9, 90) + 97]
    got = {r["subject"]: r for r in medians(samples(spark, waves), ["subject"], "x0", last=F.col("k")).collect()}
    for s, xs in enumerate(waves):
        own = [(k, x) for k, x in enumerate(xs) if x is not None]
        if own:
            assert got[s]["median"] == np.median([x for _, x in own]) and got[s]["last"] == own[-1][0]
    assert set(got) == {0, 1, 2, 3, 4, 6}


@pytest.mark.parametrize("stretch", [1, 3, 64])
def test_smoothing_does_not_depend_on_stretches(spark, stretch):
    rng = np.random.default_rng(3)
    waves = [rng.integers(0, 50, 70), [1, None, 3, None, None, 4] * 4, [5]]
    for rows in (1, 2, 3, 4, 7):
        got = {(r["subject"], r["k"]): r["x0"] for r in signal.moving_mean(samples(spark, waves, "x"), rows, stretch).collect()}
        for s, xs in enumerate(waves):
            for k in range(len(xs)):
                own = [x for x in xs[max(0, k - rows // 2) : k + (rows + 1) // 2] if x is not None]
                assert got.pop((s, k)) == (pytest.approx(np.mean(own)) if own else None)
        assert not got
    level = {(r["subject"], r["k"]): r["x"] for r in signal.detrend(samples(spark, waves, "x"), stretch).collect()}
    for s, xs in enumerate(waves):
        middle = np.median([x for x in xs if x is not None])
        assert [level[s, k] for k in range(len(xs))] == [None if x is None else x - middle for x in xs]


@pytest.mark.parametrize("stretch", [1, 2, 5, 64])
def test_maxima_and_lows_across_stretches(spark, stretch):
    rng = np.random.default_rng(4)
    # Flat tops that run on over several stretches, to the end too, and missing samples.
    waves = [rng.integers(0, 4, 90), np.repeat(rng.integers(0, 3, 20), rng.integers(1, 12, 20)), [0, 2, *[3] * 30], [0, *[3] * 30, 1], [0, *[3] * 20, None, 1], [1] * 9, [2]]
    waves = [[None if rng.random() < 0.02 and s < 2 else int(x) if x is not None else None for x in xs] for s, xs in enumerate(waves)]
    got = {}
    for r in signal.candidates(samples(spark, waves), stretch).orderBy("subject", F.col("k").asc_nulls_last()).collect():
        got.setdefault(r["subject"], []).append((r["k"], r["h"], r["low"], r["low_k"]))
    for s, xs in enumerate(waves):
        tops, want = plain_maxima(xs), []
        for before, (k, h) in zip([(-1, 0), *tops], [*tops, (len(xs) - 1, None)], strict=True):
            part = [(xs[j], j) for j in range(before[0] + 1, k + 1) if xs[j] is not None and (j == 0 or xs[j] != xs[j - 1])]
            want.append((k if h is not None else None, h, *min(part, default=(None, None))))
        rest = want.pop()
        assert [r for r in got[s] if r[0] is not None] == want, s
        assert [r for r in got[s] if r[0] is None] in ([rest], [] if rest[2] is None else [rest]), s


@pytest.mark.parametrize("block", [1, 3, 10, 1000])
def test_prominence_does_not_depend_on_blocks(spark, block):
    rng = np.random.default_rng(5)
    waves = [rng.integers(0, 30, 200), np.cumsum(rng.integers(-1, 2, 300)), [0, 3, 1, 4, 2, 5, 3, 6, 0], [0, 6, 3, 5, 2, 4, 1, 3, 0], [0, 3, 1, 3, 0, 3, 2, 3, 1]]
    cands = signal.candidates(samples(spark, waves), 16)
    got = {(r["subject"], r["k"]): r["prominence"] for r in signal.with_prominence(cands, block).collect() if r["k"] is not None}
    for s, xs in enumerate(waves):
        for k, h in plain_maxima(list(map(int, xs))):
            left = max([j for j in range(k) if xs[j] > h], default=0)
            right = min([j for j in range(k + 1, len(xs)) if xs[j] > h], default=len(xs) - 1)
            assert got.pop((s, k)) == h - max(min(xs[left : k + 1]), min(xs[k : right + 1]))
    assert not got


def test_peaks_keep_their_lows_and_distances(spark, monkeypatch):
    monkeypatch.setattr(signal, "BLOCK", 2)
    rng = np.random.default_rng(6)
    waves = [rng.integers(0, 20, 150) for _ in range(3)]
    for distance in (None, 1, 4):
        found = {}
        for r in signal.pick_peaks(signal.candidates(samples(spark, waves), 8), 3, distance).orderBy("subject", "k").collect():
            found.setdefault(r["subject"], []).append((r["k"], r["low_val"], r["low_k"]))
        for s, xs in enumerate(waves):
            tops = plain_maxima(list(map(int, xs)))
            k, h = np.array([t[0] for t in tops]), np.array([float(t[1]) for t in tops])
            low = np.array([min(xs[a : b + 1]) for a, b in zip([0, *k[:-1]], k, strict=True)], float)
            keep = signal.prominences(h, low, float(min(xs[k[-1] :]))) >= 3
            k, h = k[keep], h[keep]
            if distance is not None:
                near = signal.spaced(k, h, distance)
                k, h = k[near], h[near]
            assert [r[0] for r in found[s]] == k.tolist()
            for (a, least, at), b in zip(found[s], k[1:], strict=False):
                assert (least, at) == min((xs[j], j) for j in range(a, b + 1))


@pytest.mark.parametrize("block", [1, 2, 7, 1000])
def test_runs_do_not_depend_on_blocks(spark, block):
    rng = np.random.default_rng(7)
    flags = [rng.random(120) < p for p in (0.5, 0.95, 0.0)] + [np.ones(50, bool)]
    df = spark.createDataFrame([(s, 1, k, bool(f)) for s, own in enumerate(flags) for k, f in enumerate(own)], "subject int, condition int, k long, flag boolean")
    for least in (1, 3):
        got = sorted((r["subject"], r["first"], r["last"], r["n"]) for r in intervals.runs(df, F.col("flag"), "k", least, block).collect())
        want = []
        for s, own in enumerate(flags):
            edges = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(int), [0]])))
            want += [(s, int(a), int(b) - 1, int(b - a)) for a, b in zip(edges[::2], edges[1::2], strict=True) if b - a >= least]
        assert got == want


def spans(spark, rng, n, reach=2000):
    starts = rng.integers(0, reach, n)
    rows = [(int(rng.integers(0, 3)), 1, str(rng.choice(["a", "b"])), 0, i, float(s), float(s + rng.choice([0, 1, 5, 80, 700]))) for i, s in enumerate(starts)]
    return rows, spark.createDataFrame(rows, EVENTS)


@pytest.mark.parametrize("width", [1.0, 50.0, 300.0])
def test_overlaps_and_merges_do_not_depend_on_bins(spark, monkeypatch, width):
    monkeypatch.setattr(intervals, "BIN", width)
    rng = np.random.default_rng(8)
    one, ones = spans(spark, rng, 60)
    two, twos = spans(spark, rng, 15)
    one += one[:2]
    ones = ones.union(ones.where("end_idx in (0, 1)"))
    for lag in (0.0, 45.0):
        hit = [a for a in one if any(a[0] == b[0] and b[6] >= a[5] and b[5] <= a[6] + lag for b in two)]
        assert sorted(map(tuple, intervals.overlapping(ones, twos, lag).collect())) == sorted(hit)
        assert {tuple(r)[:7]: r["met"] for r in intervals.with_overlap(ones, twos, "met", lag).collect()} == {a: a in hit for a in one}
    points = spark.createDataFrame([(s, 1, g) for s in range(3) for g in range(0, 2000, 7)], "subject int, condition int, g long")
    free = {(s, g) for s in range(3) for g in range(0, 2000, 7) if not any(b[0] == s and b[5] <= g <= b[6] for b in two)}
    assert {(r["subject"], r["g"]) for r in intervals.points_outside(points, twos, F.col("g").cast("double")).collect()} == free
    for by_type in (True, False):
        for tolerance in (0.0, 10.0):
            want, last = [], {}
            for r in sorted(one, key=lambda r: (r[5], r[6], r[3], r[4], r[2])):
                key = (r[0], r[2] if by_type else "")
                if key in last and r[5] <= last[key][6] + tolerance:
                    last[key][4], last[key][6] = max(last[key][4], r[4]), max(last[key][6], r[6])
                else:
                    last[key] = list(r)
                    want.append(last[key])
            assert sorted(map(tuple, intervals.merge(ones, tolerance, by_type).collect())) == sorted(map(tuple, want))


@pytest.mark.parametrize("block", [1, 5, 1000])
def test_asof_join_by_brute_force(spark, block):
    rng = np.random.default_rng(9)
    left = [(int(rng.integers(0, 3)), int(rng.integers(0, 60)), i) for i in range(80)] + [(9, 5, 1), (0, 7, 1), (0, 7, 1)]
    right = [(int(rng.integers(0, 3)), int(rng.integers(5, 60)), None if i % 7 == 0 else float(i)) for i in range(30)]
    one, two = spark.createDataFrame(left, "key int, g long, id long"), spark.createDataFrame(right, "key int, p long, v double")
    for within in (None, 6):
        want = []
        for key, g, i in left:
            own = [(p, v is not None, v) for k, p, v in right if k == key and p <= g]
            p, _, v = max(own, default=(None, None, None), key=lambda x: x[:1] + (x[1], x[2] or 0))
            want.append((key, g, i, p, v) if p is not None and (within is None or g - p <= within) else (key, g, i, None, None))
        got = asof_join(one, two, ["key"], "g", "p", within, block).collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert asof_join(one, two.limit(0), ["key"], "g", "p").where("p is null").count() == len(left)
    with pytest.raises(ValueError, match="both tables"):
        asof_join(one, two.withColumnRenamed("v", "id"), ["key"], "g", "p")


@pytest.mark.parametrize("stretch", [1, 9, 1000])
def test_trailing_median_by_brute_force(spark, stretch):
    rng = np.random.default_rng(10)
    waves = [rng.integers(0, 9, 80).tolist(), [None, 3, None, None, 1, 2], [4]]
    got = {(r["subject"], r["k"]): r["median"] for r in grid.trailing_median(samples(spark, waves), ["subject"], "k", "x0", 6, stretch).collect()}
    for s, xs in enumerate(waves):
        for k in range(len(xs)):
            own = [x for x in xs[max(0, k - 6) : k + 1] if x is not None]
            assert got.pop((s, k)) == (np.median(own) if own else None)
    assert not got


def test_sigh_windows_do_not_depend_on_stretches(spark, monkeypatch):
    monkeypatch.setattr(grid, "STRETCH", 1)
    rng = np.random.default_rng(11)
    ks = np.unique(rng.integers(0, 500, 120))
    amps = [None if i % 11 == 5 else float(rng.integers(1, 30)) for i in range(len(ks))]
    rows = [(1, 1, "lungs", int(k), a, 1.0) for k, a in zip(ks, amps, strict=True)]
    df = spark.createDataFrame(rows, "subject int, condition int, belt string, peak_k long, amp double, amp_ref double")
    got = {r["peak_k"]: r for r in grid.sigh_flags(df, Config(fs=1)).collect()}
    assert len(got) == len(ks)
    for i, (k, a) in enumerate(zip(ks.tolist(), amps, strict=True)):
        own = [b for q, b in zip(ks.tolist(), amps, strict=True) if k - 60 <= q < k]
        there = [b for b in own if b is not None]
        med = float(np.median(there)) if there else None
        assert (got[k]["n_prev"], got[k]["med_prev"]) == (len(own), med)
        assert got[k]["flag"] == (k >= 60 and len(own) >= 3 and a is not None and med is not None and a >= 1.5 * med)
        assert got[k]["prev_k"] == (ks[i - 1] if i else None)


def test_files_in_many_splits(spark, tmp_path):
    rng = np.random.default_rng(12)
    wide = rng.integers(0, 99, (400, 6))
    (tmp_path / "wide").mkdir()
    (tmp_path / "flat").mkdir()
    (tmp_path / "wide" / "Sub3_Pom2.dat").write_text("\n \n".join(" ".join(map(str, r)) + ("\n\n" if i % 50 == 0 else "") for i, r in enumerate(wide)) + "\n")
    (tmp_path / "wide" / "Sub4_Pom2.dat").write_text("1,2,3,4,5,6\n")
    numbers = wide.T.ravel().tolist()
    (tmp_path / "flat" / "Sub3_Pom2.dat").write_text("\n".join(" ".join(map(str, numbers[i : i + 7])) for i in range(0, len(numbers), 7)))
    name, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set(name, 500)
    try:
        one = read_recordings(spark, str(tmp_path / "wide"))
        assert one.rdd.getNumPartitions() > 10
        for df in (one.where("subject = 3"), read_recordings(spark, str(tmp_path / "flat"), "channel_major")):
            rows = df.orderBy("k").collect()
            assert [r["k"] for r in rows] == list(range(400)) and [tuple(r)[3:] for r in rows] == [tuple(map(float, r)) for r in wide]
        assert one.where("subject = 4").count() == 1
        (tmp_path / "flat" / "Sub5_Pom1.dat").write_text("1 2 3 4 5 6 7\n")
        with pytest.raises(Exception, match="six channels"):
            read_recordings(spark, str(tmp_path / "flat"), "channel_major").collect()
        (tmp_path / "wide" / "x_Sub4_Pom2.dat").write_text("1,2,3,4,5,6\n")
        with pytest.raises(Exception, match="more than one file"):
            read_recordings(spark, str(tmp_path / "wide")).collect()
    finally:
        spark.conf.set(name, before)


def test_recordings_are_written_in_parts_and_numbered_by_hours(spark, tmp_path):
    from breathmark.schema import SIGNALS
    from breathmark.sources.adapter import signals_from_events
    from breathmark.sources.recordings import write_recordings

    rows = [(s, 1, k, float(k), None, None, -float(k), None, 5.0) for s in (1, 22) for k in range(25)]
    signals = spark.createDataFrame(rows, SIGNALS)
    for layout in ("wide", "channel_major"):
        write_recordings(signals, f"{tmp_path}/{layout}", layout, 2)
        assert len(list((tmp_path / layout).glob("*Sub22_Pom1*-part*/*.txt"))) == 13 * (1 if layout == "wide" else 6)
        assert sorted(map(tuple, read_recordings(spark, f"{tmp_path}/{layout}/*", layout).collect())) == rows
    write_recordings(signals, f"{tmp_path}/again", "wide", 2)
    with pytest.raises(Exception, match="more than one file"):
        read_recordings(spark, [f"{tmp_path}/wide/*", f"{tmp_path}/again/*"], "wide").collect()

    # Hours of none, one, two and many samples; times and numbers that are missing.
    hours = [0, 0, 0, 2, 3, 3, 5, 7, 8, 8, 8, 8, None]
    events = [(i, None if h is None else 3600.0 * h + 0.1 * (i % 5), "click" if i % 13 else None, 0.5 * i, None if i in (4, 7) else f'{{"k": {3 * i}}}') for i, h in enumerate(hours)]
    df = spark.createDataFrame(events, "event_id long, s double, event_type string, value double, props string").withColumn("ts", F.timestamp_millis((F.col("s") * 1000).cast("long")))
    df.write.parquet(f"{tmp_path}/events.parquet")
    got = {(r["subject"], r["k"]): (r["spo2"], r["resp_l"]) for r in signals_from_events(spark, str(tmp_path)).collect()}
    want = {}
    for subject in (0, 1):
        own = sorted((e for e in events if (e[2] == "click") == bool(subject)), key=lambda e: (e[1] is None, e[1] or 0.0, e[0]))
        digits = [None if e[4] is None else 3 * e[0] for e in own]
        for k, e in enumerate(own):
            near = [d for d in digits[max(0, k - 2) : k + 2] if d is not None]
            want[subject, k] = (100.0 - sum(near) / (len(near) * 5.0) if near else None, 50.0 * e[0])
    assert got == want


def test_value_ranges_are_worked_out_of_distinct_values(spark):
    rows = spark.createDataFrame([(1, float(v % 5)) for v in range(40)], "g int, x double")
    found = medians(rows, ["g"], "x")
    assert found.collect()[0]["median"] == 2.0
    plan = found._jdf.queryExecution().optimizedPlan().toString().upper()
    line, _, below = plan[plan.rindex("AGGREGATE ") :].partition("\n")
    assert "LOG2" in plan and "LOG2" not in line.split("], [")[0] and "LOG2" not in below
