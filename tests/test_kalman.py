import numpy as np
import pytest

from axonlake.operators.kalman import SpikeRules, flag_readings, implausible

SCHEMA = "sample_id long, session_id string, signal string, t double, value double"


def series(n=400, seed=0, session="s", signal="jaw_distance", first=0, level=100.0):
    r = np.random.default_rng(seed)
    noise = np.zeros(n)
    for i in range(1, n):
        noise[i] = 0.7 * noise[i - 1] + r.normal()
    t = np.cumsum(r.uniform(0.03, 0.15, n))
    return [[first + i, session, signal, float(t[i]), float(level + noise[i])] for i in range(n)]


def found(spark, data, **kw):
    return {r[0] for r in implausible(flag_readings(spark.createDataFrame([tuple(x) for x in data], SCHEMA), **kw)).collect()}


def test_each_kind_and_what_is_no_case(spark):
    d = series()
    d[50][4] += 60
    d[51][4] += 62  # an excursion of two
    d[100][4] = -1.0  # impossible
    for i in range(150, 165):
        d[i][4] = 99.5  # stuck
    for i in range(200, 205):
        d[i][4] = 101.25  # a short repeat
    for i in range(250, 262):
        d[i][4] += 80  # a longer movement
    for i in range(320, 400):
        d[i][4] += 70  # a new level
    assert found(spark, d) == {50, 51, 100, *range(150, 165)}


def test_blocks_change_nothing(spark):
    d = []
    for k in range(3):
        s = series(900, k, f"s{k}", first=k * 1000)
        for i in range(60, 900, 97):
            s[i][4] += 50 * (-1) ** i
        for i in range(500, 520):
            s[i][4] = s[500][4]
        d += s
    whole = found(spark, d)
    assert whole and whole == found(spark, d, block=128, halo=48, bucket_seconds=5.0)


def test_nulls_repeats_ties_and_empty(spark):
    d = series(120)
    d[40][4] += 90
    d += [d[40][:], [900, "s", "jaw_distance", None, 5.0], [901, "s", "jaw_distance", 3.0, None], [902, "s", "jaw_distance", 3.0, float("nan")], [903, None, None, 1.0, 1.0], [904, None, None, 1.0, 1.0]]
    assert found(spark, d) == {40}
    assert found(spark, []) == set()
    flat = [[i, "c", "jaw_distance", float(i), 5.0] for i in range(30)]
    assert found(spark, flat) == set(range(30))  # stuck from end to end


def test_clashing_columns(spark):
    from pyspark.sql import functions as F

    d = series(120)
    d[40][4] += 90
    df = spark.createDataFrame([tuple(x) for x in d], SCHEMA)
    for c in ("_t", "_v", "_b", "rank", "sd", "z", "stuck", "_k"):
        df = df.withColumn(c, F.lit("x"))
    assert {r[0] for r in implausible(flag_readings(df)).collect()} == {40}


@pytest.mark.parametrize("signal,bad", [("pupil_area", 20001.0), ("whisker_velocity", -6001.0), ("nose_distance", 1500.5)])
def test_limits(spark, signal, bad):
    d = series(60, signal=signal)
    d[30][4] = bad
    assert 30 in found(spark, d)


def test_rules_are_parameters(spark):
    d = series(200)
    d[100][4] += 25
    assert found(spark, d, rules=SpikeRules(excursion_sd=100.0)) == set()
