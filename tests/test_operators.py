"""Features, series and models on known answers."""

import datetime as dt
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from chronolith.functions import schema, vocabulary
from chronolith.operators import calendar, daily, embedding, forecast, insight, intervals, relational, scores, stationarity, trajectory
from chronolith.plans import export, ingest, model
from chronolith.streaming import ingest as streaming

DAY = dt.date(2026, 1, 1)


def days(spark, columns, rows, subject="subject_a"):
    return spark.createDataFrame([(subject, DAY + dt.timedelta(days=i), *r) for i, r in enumerate(rows)], "subject_id string, date date, " + ", ".join(f"{c} double" for c in columns))


def observation(metric, start, end=None, num=None, text=None):
    return ("subject_a", "flat_csv", metric, None, num, text, start, end or start, None, start, end or start, "phone")


def test_smoothing_is_causal(spark):
    rows = [(float(i + 1),) for i in range(28)]
    out = {r.date: r for r in scores.smoothed(days(spark, ["resting_hr_bpm"], rows), ["resting_hr_bpm"]).collect()}
    last = out[DAY + dt.timedelta(days=27)]
    assert (last.resting_hr_bpm_7d, last.resting_hr_bpm_28d, last.resting_hr_change_bpm) == (25.0, 14.5, 10.5)
    assert out[DAY + dt.timedelta(days=1)].resting_hr_bpm_7d is None


def test_sleep_unites_overlapping_sources(spark):
    at = lambda d, h, m=0: dt.datetime(2026, 1, d, h, m)
    stage = "HKCategoryValueSleepAnalysis"
    rows = [
        observation(daily.SLEEP, at(1, 23), at(2, 3), text=stage + "AsleepCore"),
        observation(daily.SLEEP, at(2, 2), at(2, 6, 30), text=stage + "AsleepUnspecified"),
        observation(daily.SLEEP, at(1, 22), at(2, 8), text=stage + "InBed"),
        observation(daily.SLEEP, at(2, 6, 30), at(2, 7), text=stage + "Awake"),
    ]
    (got,) = daily.sleep(spark.createDataFrame(rows, schema.SCHEMA)).collect()
    assert got.date == DAY and got.sleep_hours == 7.5 and abs(got.sleep_efficiency - 7.5 / 8) < 1e-12


def test_touching_intervals_merge(spark):
    t = lambda h: dt.datetime(2026, 1, 1, h)
    df = spark.createDataFrame([("a", t(1), t(2)), ("a", t(2), t(3)), ("a", t(4), t(4)), ("a", None, t(9))], "k string, start_local timestamp_ntz, end_local timestamp_ntz")
    assert sorted((r.start_local.hour, r.end_local.hour) for r in intervals.merged(df, ["k"]).collect()) == [(1, 3), (4, 4)]


def test_dense_window(spark):
    rows = [(None, None)] * 2 + [(1.0, 1.0)] * 7 + [(None, None)] * 3
    d = days(spark, ["a", "b"], rows)
    (w,) = scores.dense_windows(d, ["a", "b"], width=7, threshold=1.0).collect()
    assert (w.start, w.end, w.days, w.meets_threshold) == (dt.date(2026, 1, 3), dt.date(2026, 1, 9), 7, True)
    assert scores.apply_windows(d, scores.dense_windows(d, ["a", "b"], 7, 1.0)).count() == 7
    (none,) = scores.dense_windows(days(spark, ["a"], [(None,)] * 3), ["a"], 30).collect()
    assert none.days == 3 and not none.meets_threshold
    with pytest.raises(KeyError):
        scores.dense_windows(d, ["zz"])


def test_spectrum_of_a_daily_wave(spark):
    start = dt.datetime(2026, 1, 1)
    rows = [observation(daily.HEART_RATE, start + dt.timedelta(minutes=15 * i), num=65 + 10 * math.sin(2 * math.pi * i / 96)) for i in range(96)]
    (got,) = daily.heart_spectrum(spark.createDataFrame(rows, schema.SCHEMA)).collect()
    assert got.hr_spectral_entropy < 0.01 and got.hr_low_frequency_power > 0.99
    flat = spark.createDataFrame([observation(daily.HEART_RATE, start + dt.timedelta(minutes=15 * i), num=60.0) for i in range(96)], schema.SCHEMA)
    assert daily.heart_spectrum(flat).collect() == []
    assert daily.heart_spectrum(spark.createDataFrame(rows[:20], schema.SCHEMA)).collect() == []


def test_axis_directions(spark):
    d = days(spark, ["steps", "sedentary_hours", "sleep_hours", "resting_hr_bpm"], [(1000.0, 10.0, 5.0, 70.0), (5000.0, 8.0, 7.0, 60.0), (9000.0, 6.0, 9.0, 50.0)])
    a, b, c = scores.axis_scores(d).orderBy("date").collect()
    assert a.activity_score < b.activity_score == 0 < c.activity_score and a.recovery_score < c.recovery_score and c.activity_coverage == 1


def test_differencing_respects_gaps(spark):
    rows = [("subject_a", DAY + dt.timedelta(days=i), float(v)) for i, v in ((0, 1), (1, 2), (2, 3), (4, 5), (5, 6), (6, 7))]
    full = calendar.filled(spark.createDataFrame(rows, "subject_id string, date date, score double"))
    out = [r.score for r in calendar.differenced(full, {"subject_a": {"score": 1}}, ["score"]).orderBy("date").collect()]
    assert out == [None, 1, 1, None, None, 1, 1]


def test_undifference(spark):
    df = spark.createDataFrame([("a", 2.0, 10.0, 7.0)], "subject_id string, p double, anchor__t__origin double, anchor__t__previous double")
    value = lambda order, h: df.select(forecast.undifferenced(df, "p", "t", h, F.lit(order))).first()[0]
    assert (value(0, 3), value(1, 3), value(2, 3)) == (2.0, 16.0, 31.0)


def test_splits(spark):
    for n, train in ((1, 1), (2, 1), (10, 8), (5, 4)):
        d = days(spark, ["x"], [(0.0,)] * n)
        assert calendar.temporal_split(d, 0.2).filter("part = 'train'").count() == train


def test_stationarity_orders():
    rng = np.random.default_rng(41)
    noise = rng.normal(size=500)
    assert [stationarity.order_of(x)[0] for x in (noise, noise.cumsum(), noise.cumsum().cumsum())] == [0, 1, 2]
    assert stationarity.order_of(noise[:20]) == (0, 20, "too short") and stationarity.order_of(np.ones(60))[2] == "constant"
    gapped = noise.copy()
    gapped[100] = np.nan
    assert stationarity.order_of(gapped)[1] == 399


def test_ridge_matches_the_textbook(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3)) * [1, 5, 0.2] + 3
    y = x @ [1.0, -2.0, 3.0] + rng.normal(size=200)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y, strict=True)], "a double, b double, c double, y double")
    z = (x - x.mean(0)) / x.std(0)
    w = np.linalg.solve(z.T @ z + np.eye(3), z.T @ (y - y.mean()))
    got = np.array([r.p for r in forecast.fit(df, ["a", "b", "c"], "y", "ridge").predict(df, "p").orderBy("a").select("p").collect()])
    assert np.allclose(got, (z @ w + y.mean())[np.argsort(x[:, 0])], atol=1e-6)
    (sums,) = trajectory.ridge_sums(df.withColumn("k", F.lit(1)), ["a", "b", "c"], ["y"], ["k"]).collect()
    v, b = trajectory.solve(sums.asDict(), ["a", "b", "c"], "y")
    c = x - x.mean(0)
    assert np.allclose(v, np.linalg.solve(c.T @ c + np.eye(3), c.T @ (y - y.mean()))) and abs(b - (y.mean() - x.mean(0) @ v)) < 1e-8


def test_positions_and_contributions(spark):
    rng = np.random.default_rng(1)
    rows = [(None if i % 9 == 4 else float(rng.normal()), float(rng.normal())) for i in range(5000)]
    d = days(spark, ["steps", "sleep_hours"], rows)
    scored = scores.axis_scores(d)
    p = trajectory.positions(scored).orderBy("date").collect()
    position = 0.0
    for r in p:
        if r.activity_score is not None:
            position = position * trajectory.KEEP + r.activity_score * (1 - trajectory.KEEP)
        assert abs(r.activity_position - position) < 1e-9
    parts = trajectory.contributions(trajectory.positions(scored), "activity", scores.AXES["activity"]).groupBy("date").agg(F.sum("value").alias("v"))
    moves = {r.date: r.activity_velocity for r in p}
    assert all(abs(r.v - moves[r.date]) < 1e-9 for r in parts.collect())


def test_trust_and_series(spark):
    rows = [("s", DAY, "StepCount", 5.0, "phone"), ("s", DAY, "StepCount", 7.0, "wearable"), ("s", DAY, "BodyMass", 80.0, "wearable"), ("s", DAY, "BodyMass", 81.0, "scale")]
    got = {r.series: (r.value, r.chosen, r.available) for r in relational.trusted(spark.createDataFrame(rows, "subject_id string, date date, series string, value double, source_type string")).collect()}
    assert got == {"StepCount": (7.0, "wearable", 2), "BodyMass": (81.0, "scale", 2)}
    assert relational.similarity_order({("a", "b"): 0.2, ("a", "c"): 0.9, ("c", "b"): 0.1}, {"a": 9, "b": 5, "c": 2, "d": 7}) == ["a", "c", "b", "d"]
    assert relational.similarity_order({}, {"a": 1, "b": 3, "c": 3}) == ["b", "c", "a"] and relational.similarity_order({}, {}) == []


def test_standardizer_falls_back(spark):
    train = spark.createDataFrame([("a", DAY, 1.0, None), ("a", DAY, 3.0, None), ("b", DAY, 10.0, 4.0)], "subject_id string, date date, x double, y double")
    stats = embedding.standardizer(train, ["x", "y"])
    unseen = spark.createDataFrame([("c", DAY, None, 4.0)], "subject_id string, date date, x double, y double")
    (r,) = embedding.standardized(unseen, stats, ["x", "y"], mask=True).collect()
    assert abs(r.x - (3.0 - 14 / 3) / np.std([1, 3, 10])) < 1e-9 and r.y == 0 and (r.observed__x, r.observed__y) == (0, 1)


def test_maps_need_three_rows():
    for f in (embedding.tsne, embedding.neighbour_map):
        with pytest.raises(ValueError, match="three"):
            f(np.zeros((2, 2)))
        assert np.isfinite(f(np.random.default_rng(0).normal(size=(30, 3)))).all()


def test_maps_hold_every_row(spark):
    d = spark.range(5101).select(F.lit("a").alias("subject_id"), F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")).alias("date"), F.sin("id").alias("x"), F.cos(F.col("id") * 3).alias("y"))
    got = embedding.mapped(d, ["x", "y"], "umap")
    assert got.count() == 5101 == got.select("subject_id", "date").distinct().count()
    for name in ("tsne_map", "umap_map"):
        assert __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").count() == 500


def test_map_sums_are_those_of_all_pairs():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 4))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    index, dist = embedding.nearest(x, 15, block_cells=4000)
    assert (index == np.argsort(d, axis=1)[:, :15]).all() and np.allclose(dist, np.sort(d, axis=1)[:, :15])
    for scale in (1e-4, 1.0, 40.0):
        y = rng.normal(size=(400, 2)) * scale
        gap = y[:, None] - y[None]
        k = 1 / (1 + (gap**2).sum(axis=2))
        push, total = embedding.repulsion(y, direct=0)
        want = (gap * (k**2)[:, :, None]).sum(axis=1)
        assert abs(total - (k.sum() - 400)) < 0.01 * (k.sum() - 400) and ((push - want) ** 2).mean() < 0.06**2 * (want**2).mean()
    parts = np.vstack([rng.normal(size=(100, 4)), rng.normal(size=(100, 4)) + 30])
    for f in (embedding.tsne, embedding.neighbour_map):
        near, _ = embedding.nearest(f(parts), 5)
        assert ((near < 100) == (np.arange(200) < 100)[:, None]).mean() > 0.98


def test_series_queries_do_the_whole_job(spark, monkeypatch):
    sf, queries = "/root/testdata/sf0.001", __spark_entry__.queries()
    made = queries["trajectory_forecast"](spark, sf).groupBy("subject_id").agg(F.sort_array(F.collect_list("horizon")).alias("h")).collect()
    assert made and all(r.h == list(range(1, 31)) for r in made)
    assert {r.horizon for r in queries["ridge_coefficients"](spark, sf).select("horizon").collect()} == set(range(1, 31))
    asked = {}
    monkeypatch.setattr(trajectory, "clusters", lambda d, **k: (None, asked.update(most=k) or [{"center": [0.0, 0.0], "weight": 1.0, "kind": "healthy"}]))
    monkeypatch.setattr(embedding, "autoencoder", lambda s, c, **k: asked.update(epochs=k) or {f"{n}{i}": np.zeros(z) for i, (a, b) in enumerate([(8, 8), (8, 3), (3, 8), (8, 4)]) for n, z in (("w", (a, b)), ("b", b))})
    queries["gmm_clusters"](spark, sf), queries["autoencoder_latent"](spark, sf)
    assert asked == {"most": {}, "epochs": {}}


def test_models_are_fitted_on_every_row(spark, monkeypatch):
    seen = []
    at = F.date_add(F.lit("1800-01-01").cast("date"), F.col("id").cast("int")).alias("date")
    monkeypatch.setattr(trajectory.GaussianMixture, "fit", lambda self, x: seen.append(x.count()) or type("m", (), {"summary": type("s", (), {"logLikelihood": math.nan})}))
    assert trajectory.clusters(spark.range(50_003).select(F.lit("a").alias("subject_id"), at, *[F.rand(1).alias(f"{a}_position") for a in trajectory.AXIS_NAMES]), most=2) == (None, [])
    assert seen == [50_003]
    split = embedding.forward
    rows = []
    monkeypatch.setattr(embedding, "forward", lambda net, x: rows.append(len(x)) or split(net, x))
    embedding.autoencoder(spark.range(20_003).select(F.lit("a").alias("subject_id"), at, F.rand(1).alias("x"), F.lit(1.0).alias("observed__x")), ["x"], epochs=1)
    assert sum(rows) == 3 * 20_003


def test_autoencoder_learns(spark):
    rng = np.random.default_rng(0)
    z = rng.normal(size=(300, 2))
    x = z @ rng.normal(size=(2, 5))
    df = spark.createDataFrame([("a", DAY + dt.timedelta(days=i), *map(float, r), *([1.0] * 5)) for i, r in enumerate(x)], "subject_id string, date date, " + ", ".join(f"f{k} double" for k in range(5)) + ", " + ", ".join(f"observed__f{k} double" for k in range(5)))
    names = [f"f{k}" for k in range(5)]
    net = embedding.autoencoder(df, names)
    rebuilt = embedding.forward(net, np.hstack([x, np.ones_like(x)]))[-1]
    assert ((rebuilt - x) ** 2).mean() < 0.7 * (x**2).mean()
    assert embedding.latent(df, names, net).count() == 300


def test_whole_model_and_export(spark, tmp_path):
    start = dt.datetime(2026, 1, 1)
    rng = np.random.default_rng(2)
    rows = []
    for subject in ("subject_a", "subject_b"):
        for d in range(60):
            base = start + dt.timedelta(days=d)
            rows.append((subject, "flat_csv", "HKQuantityTypeIdentifierStepCount", "count", float(rng.integers(3000, 9000)), None, base, base, None, base, base, "phone"))
            rows.append((subject, "flat_csv", "SleepDurationDaily", "s", float(rng.integers(5, 9) * 3600), None, base, base, None, base, base, "phone"))
            rows.append((subject, "flat_csv", "HKQuantityTypeIdentifierRestingHeartRate", "count/min", float(rng.integers(50, 65)), None, base, base, None, base, base, "phone"))
            rows += [(subject, "flat_csv", daily.HEART_RATE, "count/min", float(rng.integers(50, 120)), None, base + dt.timedelta(hours=h), base + dt.timedelta(hours=h), None, base + dt.timedelta(hours=h), base + dt.timedelta(hours=h), "wearable") for h in range(12)]
    spark.createDataFrame(rows, schema.SCHEMA).write.parquet(str(tmp_path / "obs"))
    report = model.run(spark, str(tmp_path / "obs"), str(tmp_path / "m"))
    assert report["subjects"] == 2 and report["days"] == 120 and "steps" in report["features"]
    assert {"pca_1", "ae_1", "umap_1", "tsne_1"} <= set(spark.read.parquet(str(tmp_path / "m/embeddings.parquet")).columns)
    assert model.combined(spark, str(tmp_path / "m")).count() == 120 and {"steps", "pca_1"} <= set(model.combined(spark, str(tmp_path / "m")).columns)
    scored = model.run_forecast(spark, str(tmp_path / "obs"), str(tmp_path / "f"), horizons=(1,))
    assert {s["name"].split("__")[0] for s in scored["scores"]} == set(forecast.MODELS)
    with pytest.raises(ValueError, match="positive"):
        model.run_forecast(spark, str(tmp_path / "obs"), str(tmp_path / "f"), horizons=(0,))
    export.run(spark, str(tmp_path / "m/daily_features.parquet"), str(tmp_path / "x"))
    docs = spark.read.json(str(tmp_path / "x/subjects"))
    assert {"trajectory", "series", "scaling"} <= set(docs.columns) and docs.count() == 2
    assert {r.label for r in spark.read.json(str(tmp_path / "x/index")).collect()} == {"Subject a", "Subject b"}
    made = json.loads((tmp_path / "x/model.json").read_text())
    assert set(made) == {"halfLifeDays", "keep", "axes", "factors", "pullFactor", "clusterRule", "forecast"} and len(made["forecast"]["coefficients"]) == 30


def test_subject_payload_day_by_day(spark):
    rng = np.random.default_rng(6)
    names = ["steps", "sedentary_hours", "sleep_hours", "resting_hr_bpm", "hrv_sdnn_ms", "exercise_minutes"]
    rows = [tuple(None if rng.random() < 0.2 else float(rng.integers(0, 50)) for _ in names[:5]) + (None,) for _ in range(420)]
    rows[-1] = (None, None, *rows[-1][2:])  # no activity on the last day
    d = scores.axis_scores(days(spark, names, rows).withColumn("exercise_minutes", F.col("exercise_minutes").cast("double")))
    fitted = trajectory.fit(trajectory.positions(d), horizons=(1, 7))
    (found,) = export.payloads(d, fitted).collect()
    got = json.loads(found.document)
    subject = found.subject_id

    x = {c: [r[k] for r in rows] for k, c in enumerate(names)}
    spread, part = {}, {}
    for c in names[:5]:
        seen = sorted(v for v in x[c] if v is not None)
        at = lambda p: seen[int((len(seen) - 1) * p + 0.5)]  # noqa: B023, E731
        spread[c] = at(0.75) - at(0.25)
        part[c] = [None if v is None or not spread[c] else (v - float(np.median(seen))) / spread[c] for v in x[c]]
    assert got["scaling"]["iqr"] == dict(sorted(spread.items()))
    axes = {a: {c: s for c, s in own.items() if c in names[:5]} for a, own in scores.AXES.items()}
    position, velocity, count, share = ({a: [] for a in axes} for _ in range(4))
    for a, own in axes.items():
        before = 0.0
        for i in range(len(rows)):
            values = {c: s * part[c][i] for c, s in own.items() if part[c][i] is not None}
            moved, own_share = 0.0, {}
            if values:
                for c, v in values.items():
                    own_share[trajectory.FACTORS[c]] = own_share.get(trajectory.FACTORS[c], 0.0) + (1 - trajectory.KEEP) * v / len(values)
                own_share["pull"] = -(1 - trajectory.KEEP) * before
                moved = (1 - trajectory.KEEP) * (sum(values.values()) / len(values) - before)
            before += moved
            position[a].append(before), velocity[a].append(moved), count[a].append(len(values)), share[a].append(own_share)
    path = got["trajectory"]
    dates = [r.date.isoformat() for r in d.orderBy("date").collect()]
    assert (path["subjectId"], path["asOf"], path["keep"]) == (subject, dates[-1], trajectory.KEEP)
    assert [h["date"] for h in path["history"]] == dates[-180:]
    for k, h in enumerate(path["history"], len(rows) - 180):
        for a in axes:
            assert abs(h["position"][a] - position[a][k]) < 1e-9 and abs(h["velocity"][a] - velocity[a][k]) < 1e-9
    want = [f for f in export.factors() if any(share[a][-1].get(f, 0.0) for a in axes)]
    assert [c["factor"] for c in path["contributions"]] == want
    assert all(abs(c[a] - share[a][-1].get(c["factor"], 0.0)) < 1e-9 for c in path["contributions"] for a in axes)
    assert [p["date"] for p in path["prediction"]] == [(dt.date.fromisoformat(dates[-1]) + dt.timedelta(days=h)).isoformat() for h in (1, 7)]
    for h, p in zip((1, 7), path["prediction"], strict=True):
        z = np.array([position[a][-1 - k] for a in axes for k in (0, 7)])
        for a in axes:
            w, b = fitted["models"][h][a]
            assert abs(p["position"][a] - (w @ z + b)) < 1e-9 and p["low"][a] <= p["high"][a]
    points = np.array([position[a] for a in axes]).T
    made = trajectory.grouped(points)
    assert len(path["clusters"]) == len(made) >= 2
    for c in path["clusters"]:
        assert any(np.allclose([c["center"][a] for a in axes], m, atol=1e-6) and np.allclose(c["covariance"], v, atol=1e-6) for m, v in made)
        assert c["kind"] == ("healthy" if sum(c["center"].values()) >= 0 else "unhealthy")
    assert [s["metric"] for s in got["series"]] == [c for c in export.CARDS if c in names[:5]]
    for s in got["series"]:
        assert s["points"] == [{"date": t, "value": v} for t, v in zip(dates[-365:], x[s["metric"]][-365:], strict=True) if v is not None]
    last = max(i for i in range(len(rows)) if all(count[a][i] for a in axes))
    assert got["scaling"]["counts"] == {a: count[a][last] for a in axes}


def test_mixture_finds_made_clusters():
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(300, 2)) * [0.3, 0.1] + [2, 0], rng.normal(size=(200, 2)) * 0.2 - [2, 1], rng.normal(size=(250, 2)) * [0.1, 0.4] + [0, 3]])
    found = sorted((tuple(m), v) for m, v in trajectory.grouped(x))
    assert len(found) == 3
    for (m, v), (want, spread) in zip(found, [((-2, -1), (0.04, 0.04)), ((0, 3), (0.01, 0.16)), ((2, 0), (0.09, 0.01))], strict=True):
        assert np.allclose(m, want, atol=0.1) and np.allclose(np.diag(v), spread, atol=0.03)
    assert trajectory.grouped(x[:15]) == []
    assert len(trajectory.grouped(np.zeros((40, 2)))) >= 2  # points that are all the same


def test_names_of_series(spark):
    rows = [("HKQuantityTypeIdentifierStepCount", None, "StepCount"), ("HKCategoryTypeIdentifierSleepAnalysis", "HKCategoryValueSleepAnalysisAsleepREM", "SleepAnalysis/AsleepREM"), ("HKCategoryTypeIdentifierAudioExposureEvent", "HKCategoryValueNotApplicable", "AudioExposureEvent/Event"), ("HKCategoryTypeIdentifierAppleStandHour", "HKCategoryValueAppleStandHourStood", "AppleStandHour/Stood"), ("HKCategoryTypeIdentifierMindfulSession", "", "MindfulSession/Event"), ("SleepScore", None, "SleepScore"), ("HKCategoryTypeIdentifierToothbrushingEvent", "HKCategoryValueToothbrushingEvent", "ToothbrushingEvent/Event")]
    got = spark.createDataFrame(rows, "m string, v string, want string").select("want", vocabulary.series_name(F.col("m"), F.col("v")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_names_of_places(spark):
    rows = [(0.3, 0.3, "Strong stretch"), (0.3, 0.0, "More active"), (0.3, -0.3, "Pushing hard"), (0.25, 0.26, "Well rested"), (0.0, -0.25, "Your usual"), (0.0, -0.3, "Less rested"), (-0.3, 0.3, "Resting"), (-0.3, 0.1, "Less active"), (-1.0, -1.0, "Worn out")]
    got = spark.createDataFrame(rows, "a double, r double, want string").select("want", insight.region(F.col("a"), F.col("r")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_streaming_matches_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    obs = ingest.from_events(events)
    obs.repartition(3).write.parquet(str(tmp_path / "in"))
    streaming.gated_append(streaming.stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == obs.count()
    q = streaming.rollup(streaming.stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("rolled").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination()
    want = obs.filter("value_num IS NOT NULL").groupBy("subject_id", "metric", F.to_date("start_utc").alias("date")).agg(F.count("*").alias("n"))
    assert {tuple(r) for r in spark.table("rolled").select("subject_id", "metric", "date", "n").collect()} == {tuple(r) for r in want.collect()}


def test_whatif(spark):
    iqr = spark.createDataFrame([("s", "activity", "steps", 2500.0, 2), ("s", "activity", "distance_m", 0.0, 2)], "subject_id string, axis string, feature string, iqr double, n int")
    got = {r.preset: r.delta for r in insight.whatif(iqr).collect()}
    assert got["walk"] == 1.0 and got["restDay"] == -0.8 and "workout" not in got
