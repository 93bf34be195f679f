"""Operators that never need a whole series or group in one task, against brute force."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from chronolith.functions import fourier
from chronolith.operators import calendar, forecast, intervals, quantiles


def brute_union(rows):
    out = []
    for k in {r[0] for r in rows}:
        own = sorted((a, b) for key, a, b in rows if key == k and a is not None and b is not None)
        held = []
        for a, b in own:
            if held and a <= held[-1][1]:
                held[-1][1] = max(held[-1][1], b)
            else:
                held.append([a, b])
        out += [(k, a, b) for a, b in held]
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_union_over_many_days(spark, seed):
    draw = random.Random(seed)
    base = dt.datetime(2020, 1, 1)
    rows = []
    for k in ("a", "b", None):
        for _ in range(300):
            a = base + dt.timedelta(hours=draw.randint(0, 24 * 60))
            length = draw.choice([0, 1, 2, 5, 24, 24, 60, 200]) if draw.random() < 0.25 else draw.randint(0, 2)
            rows.append((k, a, a + dt.timedelta(hours=length)))
    rows += [("c", base, None), ("c", None, base), ("d", base, base + dt.timedelta(days=9)), ("d", base + dt.timedelta(days=9), base + dt.timedelta(days=9)), ("d", base + dt.timedelta(days=3), base + dt.timedelta(days=3, hours=1)), ("d", base + dt.timedelta(days=10), base + dt.timedelta(days=10))]
    df = spark.createDataFrame(rows, "k string, start_local timestamp_ntz, end_local timestamp_ntz").repartition(3)
    assert sorted(map(tuple, intervals.merged(df, ["k"]).collect()), key=repr) == brute_union(rows)


def series(spark, days=90, subjects=2):
    draw = random.Random(1)
    rows = [(f"s{s}", dt.date(1969, 12, 1) + dt.timedelta(days=d), draw.choice([None, float(draw.randint(0, 50))]), float(d % 7)) for s in range(subjects) for d in range(days + s)]
    return spark.createDataFrame(rows, "subject_id string, date date, x double, y double")


@pytest.mark.parametrize("size", [1, 5, 32])
def test_blocks_of_days(spark, monkeypatch, size):
    """The same values as windows over whole series."""
    monkeypatch.setattr(calendar, "BLOCK_DAYS", size)
    df = series(spark)
    w = Window.partitionBy("subject_id").orderBy("date")
    got = sorted(calendar.with_trailing_means(df, {"m7": ("x", 7, 3), "m1": ("y", 1, 1)}).collect(), key=repr)
    assert got == sorted(df.withColumns({"m7": calendar.trailing_mean("x", 7, 3), "m1": calendar.trailing_mean("y", 1)}).collect(), key=repr)
    orders = {"s0": {"x": 1, "y": 2}}
    got = sorted(calendar.differenced(df, orders, ["x", "y"]).collect(), key=repr)
    x, y = F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)
    whole = df.withColumns({"dx": x, "dy": y}).withColumn("ddy", F.col("dy") - F.lag("dy").over(w))
    first = F.col("subject_id") == "s0"
    assert got == sorted(whole.select("subject_id", "date", F.when(first, F.col("dx")).otherwise(F.col("x")).alias("x"), F.when(first, F.col("ddy")).otherwise(F.col("y")).alias("y")).collect(), key=repr)
    table = forecast.lag_table(df, 3, targets=("x",), inputs=("y",), lags=(0, 28))
    want = df.withColumns({"l28": F.lag("y", 28).over(w), "ahead": F.lead("x", 3).over(w), "before": F.lag("x").over(w)}).filter("ahead IS NOT NULL")
    assert sorted(map(tuple, table.frame.select("subject_id", "date", "y__lag_28", "target__x", "anchor__x__previous").collect()), key=repr) == sorted(map(tuple, want.select("subject_id", "date", "l28", "ahead", "before").collect()), key=repr)


def test_blocks_keep_rows_without_a_day(spark):
    df = spark.createDataFrame([("a", None, 1.0, 2.0), ("a", dt.date(2020, 1, 1), 3.0, 4.0), (None, dt.date(2020, 1, 1), 5.0, 6.0)], "subject_id string, date date, x double, y double")
    got = calendar.with_trailing_means(df, {"m": ("x", 7, 1)}).collect()
    assert sorted((r.m for r in got)) == [1.0, 3.0, 5.0] and got[0].__fields__ == [*df.columns, "m"]


@pytest.mark.parametrize("accuracy", [quantiles.ACCURACY, 50])
def test_quantiles_without_gathering(spark, monkeypatch, accuracy):
    """With a coarse sketch the second pass has much to tell apart."""
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    monkeypatch.setattr(quantiles, "_MARGIN", 3 / accuracy)
    draw = np.random.default_rng(2)
    groups = {"one": [5.0], "two": [1.0, 2.0], "same": [3.0] * 50, "none": [], "few": draw.integers(0, 4, 999).astype(float).tolist(), "many": draw.normal(size=20_000).tolist(), "wild": (10.0 ** draw.integers(-300, 300, 3000)).tolist(), None: [7.0, 1.0, 1.0]}
    rows = [(k, v) for k, vs in groups.items() for v in [*vs, None]]
    wanted = {f"{kind[0]}{int(100 * p)}": ("v", p, kind) for kind in ("linear", "nearest") for p in (0.0, 0.1, 0.25, 0.5, 0.75, 0.95, 1.0)}
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    out = {r.k: r for r in quantiles.exact(df, ["k"], wanted).collect()}
    assert set(out) == set(groups)
    for k, vs in groups.items():
        vs = sorted(vs)
        for name, (_, p, kind) in wanted.items():
            if not vs:
                assert out[k][name] is None
            elif kind == "nearest":
                assert out[k][name] == vs[int(np.floor((len(vs) - 1) * p + 0.5))], (k, name)
            else:
                assert out[k][name] == pytest.approx(np.quantile(vs, p), rel=1e-12), (k, name)


@pytest.mark.parametrize("radices", [(3, 2, 4, 4), (2, 2, 3), (5, 3), (7,)])
def test_transform(spark, radices):
    n = int(np.prod(radices))
    rows = np.random.default_rng(1).normal(size=(4, n))
    df = spark.createDataFrame([(r.tolist(),) for r in rows], "v array<double>").repartition(1)
    got = df.select("v", fourier.powers(F.col("v"), n, n // 2, radices).alias("p")).collect()
    for r in got:
        assert r.p == pytest.approx(np.abs(np.fft.rfft(r.v))[1 : n // 2 + 1] ** 2)
    with pytest.raises(ValueError):
        fourier.powers(F.col("v"), n + 1, 3, radices)
