"""Positions on two axes, their clusters, and their forecasts by ridge regression from sums."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.operators.calendar import filled, in_blocks, ordered, split_dates
from chronolith.operators.scores import AXES

HALF_LIFE, HORIZONS, LAGS, ALPHA, BANDS = 7, 30, (0, 7), 1.0, (0.1, 0.9)
KEEP = 0.5 ** (1 / HALF_LIFE)
AXIS_NAMES = tuple(AXES)
#: What a contribution is shown as.
FACTORS = {
    "steps": "steps", "distance_m": "steps", "exercise_minutes": "exerciseTime", "active_energy_kcal": "activeEnergy", "light_activity_hours": "sitting", "sedentary_hours": "sitting",
    "hr_active_excess_bpm": "heartRate", "resting_hr_bpm": "heartRate", "resting_hr_change_bpm": "heartRate", "hrv_sdnn_ms": "hrv", "sleep_hours": "sleep", "sleep_efficiency": "sleep",
    "sleep_score": "sleep", "sleep_restlessness": "sleep", "respiratory_rate": "breathing",
}


#: Observations of a block of the running sums: keep to the power of two blocks stays within a double's range.
BLOCK = 2048
#: Rows of a task of the mixture's fit.
TASK_ROWS = 100_000


def _position(axis: str, keep: float) -> tuple[dict[str, Column], Column]:
    """Working columns and the position: sum of (1 - keep) keep^(n - i) score_i over the observed days i so far.

    Powers are taken from the start of a block of 2 * BLOCK observations. Blocks come twice, the second set shifted by
    half; a row uses the set in which it has BLOCK predecessors, so what a block leaves out weighs less than 1e-80.
    """
    score, n = F.col(f"{axis}_score"), F.col(f"__n_{axis}")
    columns, ready = {}, {}
    for k, shift in enumerate((0, BLOCK)):
        block = F.floor((n + shift) / (2 * BLOCK)).cast("int")
        inside = Window.partitionBy("subject_id", f"__b{k}_{axis}").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
        offset = (n + shift - F.col(f"__b{k}_{axis}") * 2 * BLOCK).cast("double")
        columns[f"__b{k}_{axis}"] = block
        columns[f"__s{k}_{axis}"] = F.coalesce(F.sum(F.when(score.isNotNull(), score * F.pow(F.lit(keep), -offset))).over(inside), F.lit(0.0))
        ready[k] = (offset, F.lit(1 - keep) * F.pow(F.lit(keep), offset) * F.col(f"__s{k}_{axis}"))
    return columns, F.when((F.col(f"__b0_{axis}") == 0) | (ready[0][0] >= BLOCK), ready[0][1]).otherwise(ready[1][1])


def positions(scored: DataFrame, axes: Sequence[str] = AXIS_NAMES, keep: float = KEEP) -> DataFrame:
    """``<axis>_position`` and ``<axis>_velocity`` on a complete calendar.

    A position starts at 0 and moves towards the day's score by a share 1 - keep, on days that have one; gaps hold it.
    """
    out = filled(scored)
    for axis in axes:
        out = out.withColumn(f"__n_{axis}", F.count(f"{axis}_score").over(ordered().rowsBetween(Window.unboundedPreceding, 0)))
        columns, position = _position(axis, keep)
        for name, column in columns.items():
            out = out.withColumn(name, column)
        out = out.withColumn(f"{axis}_position", position).drop(f"__n_{axis}", *columns)
        out = out.withColumn(f"{axis}_velocity", F.col(f"{axis}_position") - F.coalesce(F.lag(f"{axis}_position").over(ordered()), F.lit(0.0)))
    return out


def contributions(positioned: DataFrame, axis: str, parts: Mapping[str, int], keep: float = KEEP) -> DataFrame:
    """``subject_id, date, axis, factor, value``: each factor's share of the day's move, and the pull back; they add up
    to the velocity."""
    present = [c for c in parts if f"{axis}__{c}" in positioned.columns]
    count = sum((F.col(f"{axis}__{c}").isNotNull().cast("int") for c in present), F.lit(0))
    positioned = positioned.withColumn("__before", F.coalesce(F.lag(f"{axis}_position").over(ordered()), F.lit(0.0)))
    moved = F.col(f"{axis}_score").isNotNull()
    rows = [F.struct(F.lit(FACTORS[c]).alias("factor"), F.when(moved, F.lit(1 - keep) * F.coalesce(F.col(f"{axis}__{c}"), F.lit(0.0)) / count).otherwise(0.0).alias("value")) for c in present]
    rows.append(F.struct(F.lit("pull").alias("factor"), F.when(moved, -F.lit(1 - keep) * F.col("__before")).otherwise(0.0).alias("value")))
    long = positioned.select("subject_id", "date", F.lit(axis).alias("axis"), F.inline(F.array(*rows)))
    return long.groupBy("subject_id", "date", "axis", "factor").agg(F.sum("value").alias("value"))


def clusters(positioned: DataFrame, axes: Sequence[str] = AXIS_NAMES, most: int = 6, seed: int = 42) -> tuple[object, list[dict]]:
    """The Gaussian mixture of 2 to ``most`` components with the least BIC, and its components.

    Fitted on every row that has a position on all axes. A fit is some hundred short Spark jobs, so the rows are kept
    without their history, a task a ``TASK_ROWS`` rows whatever the session's partitions, and the fits run at once.
    """
    columns = [f"{a}_position" for a in axes]
    spark = positioned.sparkSession
    rows = positioned.dropna(subset=columns).select("subject_id", "date", *columns).persist()
    n = rows.count()
    data = rows.repartition(max(1, math.ceil(n / TASK_ROWS)), "subject_id", "date").sortWithinPartitions(F.xxhash64("subject_id", "date"), "subject_id", "date")
    x = VectorAssembler(inputCols=columns, outputCol="x").transform(data).select("x")
    x = (x.checkpoint() if spark.sparkContext.getCheckpointDir() else x.localCheckpoint()).persist()
    rows.unpersist()

    def fitted(k: int) -> tuple[float, object]:
        model = GaussianMixture(k=k, featuresCol="x", seed=seed).fit(x)
        return -2 * model.summary.logLikelihood + (k * 5 + k - 1) * math.log(n), model

    tried = range(2, min(most, n // 10) + 1)
    with ThreadPoolExecutor(max(1, len(tried))) as pool:
        found = list(pool.map(inheritable_thread_target(spark)(fitted), tried))
    x.unpersist()
    best = min((f for f in found if math.isfinite(f[0])), key=lambda f: f[0], default=(math.inf, None))
    if best[1] is None:
        return None, []
    found = best[1].gaussiansDF.collect()
    return best[1], [{"center": (c := r["mean"].toArray()).tolist(), "covariance": r["cov"].toArray().tolist(), "weight": w, "kind": kind_of(c)} for r, w in zip(found, best[1].weights, strict=True)]


def kind_of(center: np.ndarray) -> str:
    """A cluster is healthy if its axes together are not below the usual level."""
    return "healthy" if center.sum() >= 0 else "unhealthy"


def _log_density(x: np.ndarray, weights: np.ndarray, means: np.ndarray, covariances: np.ndarray) -> np.ndarray:
    """Log of weight times Gaussian density: a row a point, a column a component."""
    out = np.empty((len(x), len(means)))
    for j, (w, m, c) in enumerate(zip(weights, means, covariances, strict=True)):
        root = np.linalg.cholesky(c)
        z = np.linalg.solve(root, (x - m).T)
        out[:, j] = np.log(w) - (z**2).sum(axis=0) / 2 - np.log(np.diag(root)).sum() - x.shape[1] * math.log(2 * math.pi) / 2
    return out


def mixture(x: np.ndarray, k: int, seed: int = 0, rounds: int = 100, gain: float = 1e-3, floor: float = 1e-4) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """One Gaussian mixture by expectation and maximisation from k-means: log-likelihood, weights, means, covariances.
    ``floor`` is added to the variances; it ends when a point's likelihood gains less than ``gain``."""
    rng = np.random.default_rng(seed)
    means = x[[rng.integers(len(x))]]
    while len(means) < k:
        far = ((x[:, None] - means[None]) ** 2).sum(axis=2).min(axis=1)
        means = np.vstack([means, x[rng.choice(len(x), p=far / far.sum()) if far.sum() > 0 else rng.integers(len(x))]])
    for _ in range(rounds):
        own = ((x[:, None] - means[None]) ** 2).sum(axis=2).argmin(axis=1)
        moved = np.array([x[own == j].mean(axis=0) if (own == j).any() else means[j] for j in range(k)])
        if np.allclose(moved, means):
            break
        means = moved
    share = np.eye(k)[own]
    before = -math.inf
    for _ in range(rounds):
        n = share.sum(axis=0) + 1e-12
        means = share.T @ x / n[:, None]
        gaps = x[:, None] - means[None]
        covariances = np.einsum("nk,nki,nkj->kij", share, gaps, gaps) / n[:, None, None] + floor * np.eye(x.shape[1])
        logs = _log_density(x, n / n.sum(), means, covariances)
        total = np.logaddexp.reduce(logs, axis=1)
        share = np.exp(logs - total[:, None])
        if abs(total.mean() - before) < gain:
            break
        before = total.mean()
    return float(total.sum()), n / n.sum(), means, covariances


def grouped(x: np.ndarray, most: int = 6, seed: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """Means and covariances of the mixture of 2 to ``most`` components (ten points each at least) with the least BIC."""
    n, d = x.shape
    tried = []
    for k in range(2, min(most, n // 10) + 1):
        likelihood, _, means, covariances = mixture(x, k, seed)
        free = k * d + k * d * (d + 1) // 2 + k - 1
        tried.append((-2 * likelihood + free * math.log(n), k, list(zip(means, covariances, strict=True))))
    return min(tried, key=lambda t: t[:2])[2] if tried else []


def subject_clusters(positioned: DataFrame, axes: Sequence[str] = AXIS_NAMES, most: int = 6, seed: int = 0) -> DataFrame:
    """``subject_id, x, y, var_x, var_y, cov, sign, kind``: the clusters of each subject's own days; a group is one
    subject's days. Subjects of fewer than twenty days have none."""
    columns = [f"{a}_position" for a in axes]
    rows = positioned.dropna(subset=columns).select("subject_id", "date", *[F.col(c).cast("double").alias(c) for c in columns])

    def run(key, days):
        import pandas as pd

        found = grouped(days.sort_values("date")[columns].to_numpy(float), most, seed)
        out = [(key[0], m[0], m[1], c[0, 0], c[1, 1], c[0, 1], 1.0 if kind_of(m) == "healthy" else -1.0, kind_of(m)) for m, c in found]
        return pd.DataFrame(out, columns=["subject_id", "x", "y", "var_x", "var_y", "cov", "sign", "kind"])

    return rows.groupBy("subject_id").applyInPandas(run, "subject_id string, x double, y double, var_x double, var_y double, cov double, sign double, kind string")


def lagged_positions(positioned: DataFrame, axes: Sequence[str] = AXIS_NAMES, horizons: Sequence[int] = range(1, HORIZONS + 1)) -> DataFrame:
    """One row per subject, day and horizon: positions now and a week ago, and at the horizon."""
    columns = [f"{a}_lag_{k}" for a in axes for k in LAGS]

    def made(days: DataFrame, by: list[str]) -> DataFrame:
        w = ordered(by)
        leads = F.array(*[F.struct(F.lit(h).alias("horizon"), F.date_add("date", h).alias("target_date"), *[F.lead(f"{a}_position", h).over(w).alias(f"{a}_target") for a in axes]) for h in horizons])
        return days.withColumns({f"{a}_lag_{k}": F.lag(f"{a}_position", k).over(w) for a in axes for k in LAGS}).withColumn("__l", leads)

    return in_blocks(positioned, made, max(LAGS), max(horizons)).select("subject_id", "date", *columns, F.inline("__l"))


def ridge_sums(rows: DataFrame, features: Sequence[str], targets: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Sums for the normal equations by key, one pass with map-side sums."""
    measures = [F.count("*").alias("n"), *[F.sum(c).alias(f"s_{c}") for c in (*features, *targets)]]
    measures += [F.sum(F.col(a) * F.col(b)).alias(f"xx_{i}_{j}") for i, a in enumerate(features) for j, b in enumerate(features) if i <= j]
    measures += [F.sum(F.col(a) * F.col(t)).alias(f"xy_{i}_{t}") for i, a in enumerate(features) for t in targets]
    return rows.dropna(subset=[*features, *targets]).groupBy(*keys).agg(*measures)


def solve(sums: Mapping[str, float], features: Sequence[str], target: str, alpha: float = ALPHA) -> tuple[np.ndarray, float]:
    """Ridge coefficients and intercept from centred sums."""
    n, p = sums["n"], len(features)
    mean = np.array([sums[f"s_{c}"] / n for c in features])
    ty = sums[f"s_{target}"] / n
    xx = np.array([[sums[f"xx_{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)]) - n * np.outer(mean, mean)
    xy = np.array([sums[f"xy_{i}_{target}"] for i in range(p)]) - n * mean * ty
    w = np.linalg.solve(xx + alpha * np.eye(p), xy)
    return w, float(ty - w @ mean)


def ridge(rows: DataFrame, axes: Sequence[str] = AXIS_NAMES, alpha: float = ALPHA) -> dict[int, dict[str, tuple[np.ndarray, float]]]:
    """Coefficients by horizon and axis, for all horizons from one aggregate (a row a horizon comes to the driver)."""
    features, targets = [f"{a}_lag_{k}" for a in axes for k in LAGS], [f"{a}_target" for a in axes]
    found = ridge_sums(rows, features, targets, ["horizon"]).collect()
    return {r["horizon"]: {a: solve(r.asDict(), features, f"{a}_target", alpha) for a in axes} for r in found}


def predictions(rows: DataFrame, models: Mapping[int, Mapping[str, tuple[np.ndarray, float]]], axes: Sequence[str] = AXIS_NAMES) -> DataFrame:
    """``<axis>_predicted`` of every row, by its horizon's model."""
    features = [f"{a}_lag_{k}" for a in axes for k in LAGS]
    spark = rows.sparkSession
    table = spark.createDataFrame([(h, *[float(v) for a in axes for v in (*m[a][0], m[a][1])]) for h, m in models.items()], "horizon int, " + ", ".join(f"__{a}_{i} double" for a in axes for i in range(len(features) + 1)))
    out = rows.join(F.broadcast(table), "horizon")
    made = {f"{a}_predicted": sum((F.col(f"__{a}_{i}") * F.col(c) for i, c in enumerate(features)), F.col(f"__{a}_{len(features)}")) for a in axes}
    return out.withColumns(made).drop(*[f"__{a}_{i}" for a in axes for i in range(len(features) + 1)])


def bands(predicted: DataFrame, axes: Sequence[str] = AXIS_NAMES, keys: Sequence[str] = ("horizon",)) -> DataFrame:
    """Residual quantiles by horizon: ``<axis>_low, <axis>_high``."""
    measures = []
    for a in axes:
        e = F.col(f"{a}_target") - F.col(f"{a}_predicted")
        measures += [F.percentile(e, F.lit(q)).alias(f"{a}_{name}") for q, name in zip(BANDS, ("low", "high"), strict=True)]
    return predicted.groupBy(*keys).agg(*measures)


def coverage(predicted: DataFrame, band_table: DataFrame, axes: Sequence[str] = AXIS_NAMES) -> DataFrame:
    """Share of targets inside their band (to 1e-9, as a band may be an error itself), and mean absolute errors of the model, of today's position, and of 0."""
    joined = predicted.join(F.broadcast(band_table), "horizon")
    measures = [F.count("*").alias("n")]
    for a in axes:
        e = F.col(f"{a}_target") - F.col(f"{a}_predicted")
        measures += [F.avg(e.between(F.col(f"{a}_low") - F.lit(1e-9), F.col(f"{a}_high") + F.lit(1e-9)).cast("double")).alias(f"{a}_inside"), F.avg(F.abs(e)).alias(f"{a}_mae"), F.avg(F.abs(F.col(f"{a}_target") - F.col(f"{a}_lag_0"))).alias(f"{a}_mae_hold"), F.avg(F.abs(f"{a}_target")).alias(f"{a}_mae_usual")]
    return joined.groupBy("horizon").agg(*measures)


def fit(positioned: DataFrame, axes: Sequence[str] = AXIS_NAMES, horizons: Sequence[int] = range(1, HORIZONS + 1)) -> dict:
    """Models on all rows, bands from the test period, and the check of bands from the period before it: all small, a row
    a horizon."""
    rows = lagged_positions(positioned, axes, horizons).dropna()
    cuts = split_dates(positioned.filter(F.col(f"{axes[0]}_position").isNotNull()), (0.2, 0.4))
    rows = rows.join(cuts, "subject_id").persist()
    train = rows.filter("target_date < start_20")
    before = predictions(rows.filter("target_date >= start_40 AND target_date < start_20"), ridge(rows.filter("target_date < start_40"), axes), axes)
    test = predictions(rows.filter("target_date >= start_20"), ridge(train, axes), axes)
    small = lambda df: rows.sparkSession.createDataFrame(df.collect(), df.schema)  # noqa: E731  a row a horizon
    out = {"models": ridge(rows, axes), "bands": small(bands(test, axes)), "coverage": small(coverage(test, bands(before, axes), axes))}
    rows.unpersist()
    return out


def forecast(positioned: DataFrame, fitted: Mapping, axes: Sequence[str] = AXIS_NAMES) -> DataFrame:
    """From each subject's last day: dates, centres, and bands for every horizon."""
    last = positioned.withColumns({f"{a}_lag_{k}": F.lag(f"{a}_position", k).over(ordered()) for a in axes for k in LAGS})
    at = F.row_number().over(Window.partitionBy("subject_id").orderBy(F.desc("date")))
    last = last.withColumn("__at", at).filter("__at = 1").withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in sorted(fitted["models"])])))
    out = predictions(last, fitted["models"], axes).join(F.broadcast(fitted["bands"]), "horizon")
    made = {f"{a}_{k}_value": F.col(f"{a}_predicted") + F.col(f"{a}_{k}") for a in axes for k in ("low", "high")}
    return out.withColumns(made).select("subject_id", "horizon", F.date_add("date", F.col("horizon")).alias("date"), *[c for a in axes for c in (f"{a}_predicted", f"{a}_low_value", f"{a}_high_value")])


def effect_once(days: Column, keep: float = KEEP) -> Column:
    """What one changed day still moves a position after some days."""
    return F.lit(1 - keep) * F.pow(F.lit(keep), days)


def effect_habit(days: Column, keep: float = KEEP) -> Column:
    """What a change kept up moves a position after some days."""
    return 1 - F.pow(F.lit(keep), days + 1)
