"""Properties that hold for any recording."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from breathmark.config import Breathing, Config, Sigh, half_up
from breathmark.operators import signal
from breathmark.plans import detectors
from breathmark.plans.detectors import Recordings

CONFIG = Config(fs=1, baseline_sec=60, resp=Breathing(2, 2.0, 3, 3))


def wave(seed, n=240):
    rng = np.random.default_rng(seed)
    return np.round(5 * np.sin(np.arange(n) / 1.3) + rng.normal(0, 1, n), 2)


def signals(spark, waves):
    rows = [(s, 1, k, 97.0, float(v), float(w[::-1][k])) for s, w in enumerate(waves) for k, v in enumerate(w)]
    return spark.createDataFrame(rows, "subject int, condition int, k long, spo2 double, resp_l double, resp_d double")


def shapes(df, *columns):
    return sorted(tuple(None if v is None else round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect())


COLUMNS = ("segment", "belt", "breath_no", "peak_k", "trough_k", "ibi_s")


def test_breaths_do_not_depend_on_the_level(spark):
    w = wave(1)
    assert shapes(signal.breath_table(signals(spark, [w]), CONFIG), *COLUMNS) == shapes(signal.breath_table(signals(spark, [w + 1000]), CONFIG), *COLUMNS)


def test_recordings_do_not_touch_each_other_and_order_does_not_matter(spark):
    both = signals(spark, [wave(1), wave(2)])
    one = shapes(signal.breath_table(both.where("subject = 1"), CONFIG), *COLUMNS)
    mixed = both.orderBy(F.xxhash64("k", "subject")).repartition(3)
    assert shapes(signal.breath_table(mixed, CONFIG).where("subject = 1"), *COLUMNS) == one and one


def test_sighs_of_both_belts_lie_within_those_of_either(spark):
    config = replace(CONFIG, sigh=Sigh(prev_win_sec=30, ratio=1.05))
    strict = replace(config, sigh=replace(config.sigh, use_either_belt=False))
    r = Recordings(signals(spark, [wave(3)]), config).settle()
    either = [(x["start_t"], x["end_t"]) for x in detectors.detect_sigh(r).collect()]
    r.config = strict
    both = [(x["start_t"], x["end_t"]) for x in detectors.detect_sigh(r).collect()]
    assert either and all(any(a <= s and e <= b for a, b in either) for s, e in both)


def test_rounding():
    assert [half_up(x) for x in (0.5, 1.5, 2.5, -0.5, -1.5, 0.49)] == [1, 2, 3, -1, -2, 0]
    with pytest.raises(ValueError):
        Config(fs=0)
    with pytest.raises(ValueError):
        Config(resp=Breathing(trough_method="mode"))
