"""Queries over time series and models: calendars, lags, baselines, ridge, bands, embeddings, trajectories, insight."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolith.operators import calendar, embedding, forecast, insight, scores, stationarity, trajectory
from chronolith.plans import export
from chronolith.queries.base import by_day, days, on_calendar, rounded, table
from chronolith.queries.features import SCORES

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = days(spark, sf_dir).select("subject_id", "date", "steps", "sedentary_hours", "sleep_hours", "resting_hr_bpm")
    return scores.axis_scores(d)


@query(on_calendar("SELECT subject_id, date, steps, sleep_hours FROM cal"))
def calendar_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.filled(days(spark, sf_dir)).select("subject_id", "date", "steps", "sleep_hours")


@query(by_day("SELECT subject_id, date, CASE WHEN row_number() OVER w <= greatest(1, least(n - 1, CAST(round_even(n * 0.8::DOUBLE, 0) AS BIGINT))) THEN 'train' ELSE 'test' END AS part FROM (SELECT *, count(*) OVER (PARTITION BY subject_id) AS n FROM days) WINDOW w AS (PARTITION BY subject_id ORDER BY date)"))
def temporal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.temporal_split(days(spark, sf_dir), 0.2).select("subject_id", "date", "part")


@query(by_day("SELECT subject_id, d[CAST(len(d) - ceil(len(d) * 0.2::DOUBLE) + 1 AS INT)] AS start_20, d[CAST(len(d) - ceil(len(d) * 0.4::DOUBLE) + 1 AS INT)] AS start_40 FROM (SELECT subject_id, list_sort(list(DISTINCT date)) AS d FROM days GROUP BY 1)"))
def split_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.split_dates(days(spark, sf_dir), (0.2, 0.4))


@query(on_calendar("SELECT subject_id, date, round(steps - lag(steps) OVER w, 6) + 0.0::DOUBLE AS steps FROM cal WINDOW w AS (PARTITION BY subject_id ORDER BY date)"))
def diff_order1(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = calendar.filled(days(spark, sf_dir).select("subject_id", "date", "steps"))
    orders = {f"subject_{i}": {"steps": 1} for i in range(8)}
    return rounded(calendar.differenced(full, orders, ["steps"]))


@query(on_calendar("SELECT subject_id, date, round(CASE WHEN subject_id < 'subject_4' THEN d2 ELSE steps END, 6) + 0.0::DOUBLE AS steps FROM (SELECT *, d - lag(d) OVER w AS d2 FROM (SELECT *, steps - lag(steps) OVER w AS d FROM cal WINDOW w AS (PARTITION BY subject_id ORDER BY date)) WINDOW w AS (PARTITION BY subject_id ORDER BY date))"))
def diff_order2(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = calendar.filled(days(spark, sf_dir).select("subject_id", "date", "steps"))
    orders = {f"subject_{i}": {"steps": 2} for i in range(4)}
    return rounded(calendar.differenced(full, orders, ["steps"]))


_H = 3
_LAGS = forecast.LAGS  # those of baselines, the weekday of three days ahead among them, are there already
_INPUTS = ("steps", "sleep_hours", "hr_mean_bpm", "resting_hr_bpm")
_LAG_SQL = "lt AS (SELECT * FROM (SELECT subject_id, date, date + 3 AS target_date, " + ", ".join(f"lag({c}, {k}) OVER w AS {c}__lag_{k}" for c in _INPUTS for k in _LAGS) + ", lead(steps, 3) OVER w AS target__steps, lead(steps, 3) OVER w AS actual__steps, steps AS anchor__steps__origin, lag(steps) OVER w AS anchor__steps__previous FROM cal WINDOW w AS (PARTITION BY subject_id ORDER BY date)) WHERE target__steps IS NOT NULL)"


def _lag_table(spark: SparkSession, sf_dir: str) -> forecast.LagTable:
    """All default inputs that the table has, and all default lags."""
    return forecast.lag_table(days(spark, sf_dir), _H, targets=("steps",))


@query(on_calendar(f"SELECT * FROM (WITH {_LAG_SQL} SELECT * FROM lt)"))
def lag_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lag_table(spark, sf_dir).frame


_BASE_SQL = "bl AS (SELECT *, steps__lag_0 AS persistence__steps, steps__lag_4 AS seasonal__steps, (coalesce(steps__lag_0, 0) + coalesce(steps__lag_1, 0) + coalesce(steps__lag_2, 0) + coalesce(steps__lag_3, 0)) / nullif((steps__lag_0 IS NOT NULL)::INT + (steps__lag_1 IS NOT NULL)::INT + (steps__lag_2 IS NOT NULL)::INT + (steps__lag_3 IS NOT NULL)::INT, 0) AS moving_mean__steps FROM lt)"


@query(on_calendar(f"SELECT * FROM (WITH {_LAG_SQL}, {_BASE_SQL} SELECT subject_id, date, persistence__steps, seasonal__steps, round(moving_mean__steps, 6) AS moving_mean__steps FROM bl)"))
def baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = forecast.baselines(_lag_table(spark, sf_dir))
    return rounded(out.select("subject_id", "date", "persistence__steps", "seasonal__steps", "moving_mean__steps"))


@query(on_calendar(f"SELECT * FROM (WITH {_LAG_SQL} SELECT subject_id, date, round(CASE WHEN subject_id < 'subject_3' THEN anchor__steps__origin + 3 * steps__lag_0 WHEN subject_id < 'subject_6' THEN anchor__steps__origin + 3 * (anchor__steps__origin - anchor__steps__previous) + 6 * steps__lag_0 ELSE steps__lag_0 END, 4) + 0.0::DOUBLE AS value FROM lt)"))
def undifference(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = _lag_table(spark, sf_dir).frame
    order = F.when(F.col("subject_id") < "subject_3", 1).when(F.col("subject_id") < "subject_6", 2).otherwise(0)
    value = forecast.undifferenced(frame, "steps__lag_0", "steps", _H, order)
    return rounded(frame.select("subject_id", "date", value.alias("value")), 4)


_ERR = " UNION ALL ".join(f"SELECT '{m}' AS name, round(avg(abs({m}__steps - actual__steps)), 4) AS mae, round(sqrt(avg(pow({m}__steps - actual__steps, 2))), 4) AS rmse, CAST(count({m}__steps - actual__steps) AS BIGINT) AS n FROM bl" for m in ("persistence", "seasonal", "moving_mean"))


@query(on_calendar(f"SELECT * FROM (WITH {_LAG_SQL}, {_BASE_SQL} {_ERR})"))
def forecast_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = forecast.baselines(_lag_table(spark, sf_dir))
    return rounded(forecast.errors(out, {m: (f"{m}__steps", "actual__steps") for m in ("persistence", "seasonal", "moving_mean")}), 4)


def _fit_table(spark: SparkSession, sf_dir: str) -> forecast.LagTable:
    """What the regressors are fitted on: one input and the lags of the baselines."""
    return forecast.lag_table(days(spark, sf_dir), _H, targets=("steps",), inputs=("sleep_hours",), lags=(0,))


@query()
def forecast_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six models; trees and coordinate descent have no SQL."""
    lags = forecast.lag_table(days(spark, sf_dir), _H, targets=("steps",), inputs=("sleep_hours", "resting_hr_bpm"), lags=(0, 7), orders=None)
    return rounded(forecast.evaluate(lags)[1], 4)


@query()
def elasticnet_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    lags = _fit_table(spark, sf_dir)
    model = forecast.fit(lags.frame, lags.features, "target__steps", "elastic_net", 0.01)
    rows = [(c, float(w)) for c, w in zip(lags.features, model.model.coefficients, strict=True)]
    return rounded(spark.createDataFrame(rows, "feature string, coefficient double"), 4)


@query()
def gbt_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    lags = _fit_table(spark, sf_dir)
    model = forecast.fit(lags.frame, lags.features, "target__steps", "boosted")
    rows = [(c, float(w)) for c, w in zip(lags.features, model.model.featureImportances.toArray(), strict=True)]
    return rounded(spark.createDataFrame(rows, "feature string, importance double"), 4)


@query()
def stationarity_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stationarity.plan(days(spark, sf_dir), ["steps", "sleep_hours", "resting_hr_bpm"])


_POS = f"""{SCORES}, cc AS (SELECT g.subject_id, g.date, s.activity_score, s.recovery_score FROM (SELECT subject_id, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM days GROUP BY 1) g LEFT JOIN sc s ON s.subject_id = g.subject_id AND s.date = g.date),
nn AS (SELECT *, count(activity_score) OVER w AS na, count(recovery_score) OVER w AS nr FROM cc WINDOW w AS (PARTITION BY subject_id ORDER BY date ROWS UNBOUNDED PRECEDING)),
pos AS (SELECT subject_id, date, activity_score, recovery_score, (1 - pow(0.5::DOUBLE, 1 / 7.0::DOUBLE)) * pow(0.5::DOUBLE, na / 7.0::DOUBLE) * coalesce(sum(activity_score * pow(0.5::DOUBLE, -na / 7.0::DOUBLE)) OVER w, 0) AS activity_position,
(1 - pow(0.5::DOUBLE, 1 / 7.0::DOUBLE)) * pow(0.5::DOUBLE, nr / 7.0::DOUBLE) * coalesce(sum(recovery_score * pow(0.5::DOUBLE, -nr / 7.0::DOUBLE)) OVER w, 0) AS recovery_position FROM nn WINDOW w AS (PARTITION BY subject_id ORDER BY date ROWS UNBOUNDED PRECEDING)),
ps AS (SELECT *, activity_position - coalesce(lag(activity_position) OVER w, 0) AS activity_velocity, recovery_position - coalesce(lag(recovery_position) OVER w, 0) AS recovery_velocity FROM pos WINDOW w AS (PARTITION BY subject_id ORDER BY date))"""


@query(by_day(f"SELECT * FROM (WITH {_POS} SELECT subject_id, date, round(activity_position, 6) + 0.0::DOUBLE AS activity_position, round(activity_velocity, 6) + 0.0::DOUBLE AS activity_velocity, round(recovery_position, 6) + 0.0::DOUBLE AS recovery_position FROM ps)"))
def ewma_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(trajectory.positions(_axes(spark, sf_dir)).select("subject_id", "date", "activity_position", "activity_velocity", "recovery_position"))


@query(by_day(f"SELECT * FROM (WITH {_POS} SELECT subject_id, round(sum(activity_velocity), 6) + 0.0::DOUBLE AS total FROM ps GROUP BY 1)"))
def factor_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contributions of all days and factors add up to the moves."""
    positioned = trajectory.positions(_axes(spark, sf_dir))
    parts = trajectory.contributions(positioned, "activity", scores.AXES["activity"])
    return rounded(insight.contribution_totals(parts).groupBy("subject_id").agg(F.sum("total").alias("total")))


_RIDGE_FEATURES = ("activity_lag_0", "activity_lag_7", "recovery_lag_0", "recovery_lag_7")
_LP = """lp AS (SELECT a.subject_id, a.date, CAST(r.h AS INT) AS horizon, a.activity_position AS activity_lag_0, l.activity_position AS activity_lag_7, a.recovery_position AS recovery_lag_0, l.recovery_position AS recovery_lag_7, t.activity_position AS activity_target
FROM ps a CROSS JOIN range(1, 31) r(h) JOIN ps t ON t.subject_id = a.subject_id AND t.date = a.date + CAST(r.h AS INT) JOIN ps l ON l.subject_id = a.subject_id AND l.date = a.date - 7)"""


@query(by_day(f"SELECT * FROM (WITH {_POS}, {_LP} SELECT horizon, CAST(count(*) AS BIGINT) AS n, round(sum(activity_lag_0 * activity_lag_7), 4) AS xx, round(sum(activity_lag_0 * activity_target), 4) AS xy, round(sum(recovery_lag_7 * recovery_lag_7), 4) AS rr, round(sum(activity_target), 4) AS y FROM lp GROUP BY 1)"))
def ridge_normal_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trajectory.lagged_positions(trajectory.positions(_axes(spark, sf_dir)))
    sums = trajectory.ridge_sums(rows, _RIDGE_FEATURES, ("activity_target",), ["horizon"])
    return rounded(sums.select("horizon", "n", F.col("xx_0_1").alias("xx"), F.col("xy_0_activity_target").alias("xy"), F.col("xx_3_3").alias("rr"), F.col("s_activity_target").alias("y")), 4)


def _ridge_sql() -> str:
    """The normal equations of every horizon and both axes, solved by elimination, a step a table."""
    f, y = _RIDGE_FEATURES, ("activity_target", "recovery_target")
    p = len(f)
    sums = [f"avg({c}) AS m{i}" for i, c in enumerate(f)] + [f"avg({t}) AS t{k}" for k, t in enumerate(y)]
    sums += [f"sum({a} * {b}) AS s{i}_{j}" for i, a in enumerate(f) for j, b in enumerate(f)] + [f"sum({a} * {t}) AS s{i}_{p + k}" for i, a in enumerate(f) for k, t in enumerate(y)]
    mean = lambda j: f"m{j}" if j < p else f"t{j - p}"
    first = [f"s{i}_{j} - n * m{i} * {mean(j)}{f' + {float(trajectory.ALPHA)}::DOUBLE' if i == j else ''} AS a{i}_{j}" for i in range(p) for j in range(p + 2)]
    parts = [f"su AS (SELECT horizon, count(*) AS n, {', '.join(sums)} FROM lp GROUP BY 1)", f"e0 AS (SELECT horizon, {', '.join(first)} FROM su)"]
    for k in range(p):
        made = [(f"a{k}_{j} / a{k}_{k}" if i == k else f"a{i}_{j} - a{i}_{k} * a{k}_{j} / a{k}_{k}") + f" AS a{i}_{j}" for i in range(p) for j in range(p + 2)]
        parts.append(f"e{k + 1} AS (SELECT horizon, {', '.join(made)} FROM e{k})")
    rows = " UNION ALL ".join(f"SELECT horizon, '{a}' AS axis, {i} AS term, round(a{i}_{p + k}, 4) + 0.0::DOUBLE AS weight FROM e{p}" for k, a in enumerate(("activity", "recovery")) for i in range(p))
    lp = _LP.replace("t.activity_position AS activity_target", "t.activity_position AS activity_target, t.recovery_position AS recovery_target")
    return by_day(f"SELECT * FROM (WITH {_POS}, {lp}, {', '.join(parts)} {rows})")


@query(_ridge_sql())
def ridge_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trajectory.lagged_positions(trajectory.positions(_axes(spark, sf_dir))).dropna()
    found = trajectory.ridge(rows)
    out = [(h, a, i, float(w)) for h, m in found.items() for a, (ws, _) in m.items() for i, w in enumerate(ws)]
    return rounded(spark.createDataFrame(out, "horizon int, axis string, term int, weight double"), 4)


@query(by_day(f"SELECT * FROM (WITH {_POS}, {_LP} SELECT horizon, round(quantile_cont(activity_target - activity_lag_0, 0.1), 6) AS low, round(quantile_cont(activity_target - activity_lag_0, 0.9), 6) AS high FROM lp GROUP BY 1)"))
def residual_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands of the forecast that holds today's position."""
    rows = trajectory.lagged_positions(trajectory.positions(_axes(spark, sf_dir))).dropna()
    held = rows.withColumn("activity_predicted", F.col("activity_lag_0"))
    return rounded(trajectory.bands(held, ("activity",)).select("horizon", F.col("activity_low").alias("low"), F.col("activity_high").alias("high")))


@query(by_day(f"SELECT * FROM (WITH {_POS}, {_LP}, bd AS (SELECT horizon, quantile_cont(activity_target - activity_lag_0, 0.1) AS lo, quantile_cont(activity_target - activity_lag_0, 0.9) AS hi FROM lp GROUP BY 1) SELECT horizon, CAST(count(*) AS BIGINT) AS n, round(avg((activity_target - activity_lag_0 BETWEEN lo - 1e-9::DOUBLE AND hi + 1e-9::DOUBLE)::INT), 4) AS inside, round(avg(abs(activity_target - activity_lag_0)), 6) AS mae, round(avg(abs(activity_target)), 6) AS mae_usual FROM lp JOIN bd USING (horizon) GROUP BY 1)"))
def band_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trajectory.lagged_positions(trajectory.positions(_axes(spark, sf_dir))).dropna()
    held = rows.withColumn("activity_predicted", F.col("activity_lag_0"))
    out = trajectory.coverage(held, trajectory.bands(held, ("activity",)), ("activity",))
    return out.select("horizon", "n", F.round("activity_inside", 4).alias("inside"), F.round("activity_mae", 6).alias("mae"), F.round("activity_mae_usual", 6).alias("mae_usual"))


@query()
def trajectory_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    positioned = trajectory.positions(_axes(spark, sf_dir))
    return rounded(trajectory.forecast(positioned, trajectory.fit(positioned)), 4)


@query()
def gmm_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found = trajectory.clusters(trajectory.positions(_axes(spark, sf_dir)))
    rows = [(float(c["center"][0]), float(c["center"][1]), float(c["weight"]), c["kind"]) for c in found]
    return rounded(spark.createDataFrame(rows, "x double, y double, weight double, kind string"), 3)


_DIMS = ("v1", "v2", "v3", "v4")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    at = lambda i: F.col("embedding")[i].cast("double")
    return e.select(F.concat(F.lit("subject_"), F.col("label").cast("string")).alias("subject_id"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("vec_id").cast("int")).alias("date"), *[F.when(F.pmod("vec_id", F.lit(k + 3)) != 0, at(k)).alias(c) for k, c in enumerate(_DIMS)])


_VEC = "vec AS (SELECT 'subject_' || CAST(label AS VARCHAR) AS subject_id, DATE '2024-01-01' + CAST(vec_id AS INT) AS date, " + ", ".join(f"CASE WHEN vec_id % {k + 3} <> 0 THEN CAST(embedding[{k + 1}] AS DOUBLE) END AS {c}" for k, c in enumerate(_DIMS)) + " FROM embeddings)"
_STD = "sd AS (" + " UNION ALL ".join(f"SELECT subject_id, '{c}' AS feature, coalesce(median({c}), (SELECT median({c}) FROM vec)) AS m, coalesce(avg({c}), (SELECT avg({c}) FROM vec)) AS a, coalesce(stddev_pop({c}), (SELECT stddev_pop({c}) FROM vec)) AS s FROM vec GROUP BY 1 UNION ALL SELECT NULL, '{c}', median({c}), avg({c}), stddev_pop({c}) FROM vec" for c in _DIMS) + "), sx AS (SELECT subject_id, feature, m, a, CASE WHEN s > 1e-12 THEN s ELSE 1 END AS s FROM sd)"


@query(f"WITH {_VEC}, {_STD} SELECT subject_id, feature, round(m, 6) AS median, round(a, 6) AS mean, round(s, 6) AS scale FROM sx")
def standardizer_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(embedding.standardizer(_vectors(spark, sf_dir), _DIMS))


@query(f"WITH {_VEC}, {_STD} SELECT vec.subject_id, date, " + ", ".join(f"round((coalesce({c}, x_{c}.m) - x_{c}.a) / x_{c}.s, 6) + 0.0::DOUBLE AS {c}, CAST({c} IS NOT NULL AS INT)::DOUBLE AS observed__{c}" for c in _DIMS) + " FROM vec " + " ".join(f"JOIN sx x_{c} ON x_{c}.subject_id = vec.subject_id AND x_{c}.feature = '{c}'" for c in _DIMS))
def standardize_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    out = embedding.standardized(v, embedding.standardizer(v, _DIMS), _DIMS, mask=True)
    return rounded(out.select("subject_id", "date", *[c for d in _DIMS for c in (d, f"observed__{d}")]))


@query(f"WITH {_VEC} SELECT unnest(['v1', 'v2', 'v3', 'v4']) AS feature, unnest([avg((v1 IS NOT NULL)::INT) >= 0.7, avg((v2 IS NOT NULL)::INT) >= 0.7, avg((v3 IS NOT NULL)::INT) >= 0.7, avg((v4 IS NOT NULL)::INT) >= 0.7]) AS kept FROM vec")
def feature_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = set(embedding.selected(_vectors(spark, sf_dir), _DIMS, 0.7))
    return spark.createDataFrame([(c, c in kept) for c in _DIMS], "feature string, kept boolean")


def _scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return embedding.standardized(v, embedding.standardizer(v, _DIMS), _DIMS, mask=True)


@query()
def pca_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scaled(spark, sf_dir)
    means, loadings, _ = embedding.pca(s, _DIMS)
    return rounded(embedding.project(s, _DIMS, means, loadings), 4)


@query()
def pca_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, explained = embedding.pca(_scaled(spark, sf_dir), _DIMS)
    running = [(k + 1, float(e), float(explained[: k + 1].sum())) for k, e in enumerate(explained)]
    return rounded(spark.createDataFrame(running, "component int, explained double, cumulative double"), 4)


_AVG = "rebuilt AS (SELECT subject_id, date, v1, v2, v3, v4 FROM vec)"


@query(f"WITH {_VEC}, er AS (SELECT unnest(['v1', 'v2', 'v3', 'v4']) AS feature, unnest([v1, v2, v3, v4]) AS e FROM vec) SELECT feature, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(abs(e)), 6) AS mae, CAST(count(e) AS BIGINT) AS n FROM er GROUP BY 1 UNION ALL SELECT 'all', round(sqrt(avg(e * e)), 6), round(avg(abs(e)), 6), CAST(count(e) AS BIGINT) FROM er")
def reconstruction_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of the reconstruction that is 0 everywhere."""
    v = _vectors(spark, sf_dir)
    scaled = v.withColumns({f"observed__{c}": F.col(c).isNotNull().cast("double") for c in _DIMS})
    return rounded(embedding.reconstruction_errors(scaled, v.withColumns({c: F.lit(0.0) for c in _DIMS}), _DIMS))


@query()
def pca_reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scaled(spark, sf_dir)
    means, loadings, _ = embedding.pca(s, _DIMS)
    return rounded(embedding.reconstruction_errors(s, embedding.reconstructed(s, _DIMS, means, loadings), _DIMS), 4)


@query()
def autoencoder_latent(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scaled(spark, sf_dir)
    return rounded(embedding.latent(s, _DIMS, embedding.autoencoder(s, _DIMS)), 4)


@query()
def tsne_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scaled(spark, sf_dir)
    return rounded(embedding.mapped(s.select("subject_id", "date", *_DIMS), _DIMS, "tsne"), 3)


@query()
def umap_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scaled(spark, sf_dir)
    return rounded(embedding.mapped(s.select("subject_id", "date", *_DIMS), _DIMS, "umap"), 3)


_CLUSTERS = [(0.5, 0.5, 0.2, 0.3, 0.05, 1.0), (-0.5, -0.25, 0.25, 0.2, -0.05, -1.0), (0.0, 0.0, 0.1, 0.1, 0.1, 1.0)]
_C_SQL = "c AS (SELECT * FROM (VALUES (0.5::DOUBLE, 0.5::DOUBLE, 0.2::DOUBLE, 0.3::DOUBLE, 0.05::DOUBLE, 1.0::DOUBLE), (-0.5, -0.25, 0.25, 0.2, -0.05, -1.0), (0.0, 0.0, 0.1, 0.1, 0.1, 1.0)) t(x, y, vx, vy, cov, sign) WHERE vx * vy - cov * cov > 0)"


def _made_clusters(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_CLUSTERS, "x double, y double, var_x double, var_y double, cov double, sign double")


def _height(x: str, y: str) -> str:
    return f"(SELECT sum(sign * exp(-(vy * pow({x} - x, 2) - 2 * cov * ({x} - x) * ({y} - y) + vx * pow({y} - y, 2)) / (vx * vy - cov * cov) / 2) / (2 * pi() * sqrt(vx * vy - cov * cov))) FROM c)"


_FITTED = """f AS (SELECT subject_id, date, steps / avg(steps) OVER (PARTITION BY subject_id) - 1 AS a, sedentary_hours / avg(sedentary_hours) OVER (PARTITION BY subject_id) - 1 AS r FROM days),
c AS (SELECT * FROM (SELECT avg(a) AS x, avg(r) AS y, var_pop(a) AS vx, var_pop(r) AS vy, covar_pop(a, r) AS cov, CASE WHEN avg(a) + avg(r) >= 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sign FROM f GROUP BY subject_id, date_trunc('month', date)) WHERE vx * vy - cov * cov > 0)"""
_GRID = f"{_FITTED}, g AS (SELECT -1 + i * (2 / 20.0::DOUBLE) AS gx, -1 + j * (2 / 20.0::DOUBLE) AS gy FROM range(21) a(i), range(21) b(j)), d AS (SELECT gx, gy, {_height('gx', 'gy')} AS height FROM g)"


def _monthly_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Gaussian of every subject's month, fitted by its moments: two features against the subject's mean."""
    d = days(spark, sf_dir)
    usual = lambda c: F.col(c) / F.avg(c).over(Window.partitionBy("subject_id")) - 1
    placed = d.select("subject_id", F.trunc("date", "month").alias("month"), usual("steps").alias("a"), usual("sedentary_hours").alias("r"))
    fitted = placed.groupBy("subject_id", "month").agg(F.avg("a").alias("x"), F.avg("r").alias("y"), F.var_pop("a").alias("var_x"), F.var_pop("r").alias("var_y"), F.covar_pop("a", "r").alias("cov"))
    return fitted.withColumn("sign", F.when(F.col("x") + F.col("y") >= 0, 1.0).otherwise(-1.0))


@query(by_day(f"SELECT * FROM (WITH {_GRID} SELECT round(gx, 6) + 0.0::DOUBLE AS gx, round(gy, 6) + 0.0::DOUBLE AS gy, round(height, 6) + 0.0::DOUBLE AS height FROM d)"))
def terrain_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(insight.terrain(_monthly_clusters(spark, sf_dir), -1.0, 1.0, 21))


@query(by_day(f"SELECT * FROM (WITH {_GRID} SELECT CAST(k AS INT) AS level, round((k + 0.5::DOUBLE) * (SELECT max(abs(height)) FROM d) / 9.0::DOUBLE, 4) AS threshold FROM range(9) t(k))"))
def contour_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(insight.contours(insight.terrain(_monthly_clusters(spark, sf_dir), -1.0, 1.0, 21)), 4)


@query(by_day("SELECT subject_id, round(avg(CASE WHEN age < 30 THEN steps END), 6) AS now, round(avg(CASE WHEN age >= 30 THEN steps END), 6) AS before, round(avg(CASE WHEN age < 30 THEN steps END) - avg(CASE WHEN age >= 30 THEN steps END), 6) AS change FROM (SELECT *, date_diff('day', date, max(date) OVER (PARTITION BY subject_id)) AS age FROM days) WHERE age < 60 GROUP BY 1"))
def period_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(insight.period_change(days(spark, sf_dir), "steps", 30))


_USED = {"steps": "activity", "sedentary_hours": "activity", "sleep_hours": "recovery", "resting_hr_bpm": "recovery"}
_CHANGES_SQL = " UNION ALL ".join(f"SELECT subject_id, '{p}' AS preset, '{_USED[c]}' AS axis, {float(change * scores.AXES[_USED[c]][c])}::DOUBLE AS signed, q_{c} AS q, n_{_USED[c]} AS n FROM st JOIN td USING (subject_id)" for p, changes in insight.PRESETS.items() for c, change in changes.items() if c in _USED)
_TODAY_SQL = "td AS (SELECT subject_id, " + ", ".join("arg_max(" + " + ".join(f"({c} IS NOT NULL)::INT" for c, a in _USED.items() if a == axis) + f", date) AS n_{axis}" for axis in ("activity", "recovery")) + " FROM days GROUP BY 1)"


@query(by_day(f"SELECT * FROM (WITH {SCORES.split(', cp AS')[0]}, {_TODAY_SQL} SELECT subject_id, preset, axis, round(sum(signed / q / n), 6) AS delta FROM ({_CHANGES_SQL}) WHERE q > 0 AND n > 0 GROUP BY 1, 2, 3)"))
def whatif_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All presets, of whose features the table has four; an axis has the ingredients of the subject's last day."""
    d = days(spark, sf_dir)
    spread = export.spreads(d, list(_USED))
    axis = F.create_map(*[F.lit(v) for pair in _USED.items() for v in pair])[F.col("feature")]
    today = calendar.latest(d, 1).select("subject_id", F.inline(F.array(*[F.struct(F.lit(a).alias("axis"), sum((F.col(c).isNotNull().cast("int") for c, own in _USED.items() if own == a), F.lit(0)).alias("n")) for a in ("activity", "recovery")])))
    return rounded(insight.whatif(spread.withColumn("axis", axis).join(today, ["subject_id", "axis"])))


@query(by_day("SELECT subject_id, date, CAST(age AS INT) AS age, round(steps * (1 - pow(0.5::DOUBLE, 1 / 7.0::DOUBLE)) * pow(0.5::DOUBLE, age / 7.0::DOUBLE), 4) AS once, round(steps * (1 - pow(0.5::DOUBLE, (age + 1) / 7.0::DOUBLE)), 4) AS habit FROM (SELECT *, date_diff('day', date, max(date) OVER (PARTITION BY subject_id)) AS age FROM days)"))
def position_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each day's value still moves on the subject's last day, as a change of that day alone and as one kept up."""
    age = F.datediff(F.max("date").over(Window.partitionBy("subject_id")), "date")
    d = days(spark, sf_dir).select("subject_id", "date", "steps", age.alias("age"))
    return rounded(d.select("subject_id", "date", "age", (F.col("steps") * trajectory.effect_once(F.col("age"))).alias("once"), (F.col("steps") * trajectory.effect_habit(F.col("age"))).alias("habit")), 4)


@query(by_day("SELECT subject_id, date, round(steps + 2 * (1 - pow(0.5::DOUBLE, (date_diff('day', f, date) + 2) / 7.0::DOUBLE)), 6) AS simulated FROM (SELECT *, min(date) OVER (PARTITION BY subject_id) AS f FROM days)"))
def simulate_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = days(spark, sf_dir)
    first = d.groupBy("subject_id").agg(F.min("date").alias("f"))
    path = d.join(first, "subject_id").select("subject_id", "date", F.col("steps").alias("value"), (F.datediff("date", "f") + 1).alias("horizon"))
    return rounded(insight.simulated(path, F.lit(2.0), "habit").select("subject_id", "date", "simulated"))


def _band(x: str) -> str:
    return f"CASE WHEN {x} > 0.25 THEN 1 WHEN {x} < -0.25 THEN 3 ELSE 2 END"


_NAMES = "[['Strong stretch', 'More active', 'Pushing hard'], ['Well rested', 'Your usual', 'Less rested'], ['Resting', 'Less active', 'Worn out']]"


@query(by_day(f"SELECT * FROM (WITH {_POS} SELECT subject_id, date, {_NAMES}[{_band('activity_position')}][{_band('recovery_position')}] AS region FROM ps)"))
def region_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = trajectory.positions(_axes(spark, sf_dir))
    return p.select("subject_id", "date", insight.region(F.col("activity_position"), F.col("recovery_position")).alias("region"))


_WORD = "CASE WHEN {0} > 0.05 THEN 'rose' WHEN {0} < -0.05 THEN 'fell' ELSE 'held steady' END"


@query(by_day(f"""SELECT * FROM (WITH {_POS}, {_C_SQL}, td AS (SELECT subject_id, date, activity_position AS a, recovery_position AS r, activity_position - lag(activity_position, 7) OVER w AS ma, recovery_position - lag(recovery_position, 7) OVER w AS mr FROM ps WINDOW w AS (PARTITION BY subject_id ORDER BY date) QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY date DESC) = 1),
hs AS (SELECT *, ({_height('(a + 0.5::DOUBLE)', '(r - 0.25::DOUBLE)')} - {_height('a', 'r')}) / (SELECT max(abs(h)) FROM (SELECT sum(c.sign * exp(-(c.vy * pow(k.x - c.x, 2) - 2 * c.cov * (k.x - c.x) * (k.y - c.y) + c.vx * pow(k.y - c.y, 2)) / (c.vx * c.vy - c.cov * c.cov) / 2) / (2 * pi() * sqrt(c.vx * c.vy - c.cov * c.cov))) AS h FROM (SELECT x, y FROM c UNION ALL SELECT 0.0, 0.0) k, c GROUP BY k.x, k.y)) AS climb FROM td)
SELECT subject_id, round(climb, 6) AS climb, CASE WHEN climb > 0.08 THEN 'You are climbing toward healthier ground' WHEN climb < -0.08 THEN 'You are sliding toward a low point' ELSE 'You are holding steady' END AS headline,
'Over the past week, ' || CASE WHEN {_WORD.format('ma')} = {_WORD.format('mr')} THEN 'Fitness and Reserve both ' || {_WORD.format('ma')} ELSE 'Fitness ' || {_WORD.format('ma')} || ' and Reserve ' || {_WORD.format('mr')} END || '. In 30 days the model expects you in the “' || {_NAMES}[{_band('a + 0.5')}][{_band('r - 0.25')}] || '” area.' AS dek FROM hs)"""))
def story_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories on made clusters and a made path, half a unit up and a quarter down."""
    p = trajectory.positions(_axes(spark, sf_dir))
    end = calendar.latest(p, 1).select("subject_id", F.lit(30).alias("horizon"), (F.col("activity_position") + 0.5).alias("activity_predicted"), (F.col("recovery_position") - 0.25).alias("recovery_predicted"))
    clusters = p.select("subject_id").distinct().crossJoin(F.broadcast(_made_clusters(spark)))
    return rounded(insight.story(p, end, clusters))


@query(by_day("SELECT subject_id, max(date) AS date, max(CASE WHEN age = 0 THEN steps END) AS today, round(median(CASE WHEN age BETWEEN 1 AND 30 THEN steps END), 6) AS usual, round(max(CASE WHEN age = 0 THEN steps END) - median(CASE WHEN age BETWEEN 1 AND 30 THEN steps END), 6) AS delta, CASE WHEN max(CASE WHEN age = 0 THEN steps END) > median(CASE WHEN age BETWEEN 1 AND 30 THEN steps END) THEN 'good' ELSE 'bad' END AS tone FROM (SELECT *, date_diff('day', date, max(date) OVER (PARTITION BY subject_id)) AS age FROM days) GROUP BY 1"))
def metric_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = insight.card(days(spark, sf_dir), "steps")
    return rounded(c.withColumn("tone", insight.tone(F.col("delta"), F.lit(1))))


@query(by_day(f"SELECT * FROM (WITH {_POS} SELECT subject_id, round(m, 6) AS median_velocity, round(CASE WHEN t > 0 THEN least(84, greatest(20, 40 * t / CASE WHEN m > 0 THEN m ELSE 1 END)) / t ELSE 0 END, 6) AS scale FROM (SELECT subject_id, median(v) AS m, arg_max(v, date) AS t FROM (SELECT *, sqrt(pow(activity_velocity * 120, 2) + pow(recovery_velocity * 90, 2)) AS v FROM ps) GROUP BY 1))"))
def arrow_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrows on a screen of 120 and 90 pixels a unit."""
    return rounded(insight.arrow_scale(trajectory.positions(_axes(spark, sf_dir)), {"activity": 120.0, "recovery": 90.0}))


@query(by_day("""SELECT * FROM (WITH n AS (SELECT subject_id, date, steps, row_number() OVER (PARTITION BY subject_id ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY subject_id) AS n FROM days),
s AS (SELECT *, least(4.0::DOUBLE, i / 2.0::DOUBLE, (n - 1 - i) / 2.0::DOUBLE) AS s FROM n)
SELECT a.subject_id, a.date, round(sum(CASE WHEN a.s > 0 THEN exp(-pow(b.i - a.i, 2) / (2 * a.s * a.s)) ELSE 1 END * b.steps) / sum(CASE WHEN a.s > 0 THEN exp(-pow(b.i - a.i, 2) / (2 * a.s * a.s)) ELSE 1 END), 4) AS steps
FROM s a JOIN n b ON b.subject_id = a.subject_id AND b.i BETWEEN a.i - ceil(3 * a.s) AND a.i + ceil(3 * a.s) GROUP BY 1, 2)"""))
def smoothed_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(insight.smooth_path(days(spark, sf_dir).select("subject_id", "date", "steps"), ["steps"], 4.0), 4)


@query(by_day("SELECT subject_id, date, round(avg(steps) OVER (PARTITION BY subject_id ORDER BY date RANGE BETWEEN INTERVAL 13 DAYS PRECEDING AND CURRENT ROW), 6) AS mean FROM days"))
def trend_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = days(spark, sf_dir)
    return rounded(calendar.with_trailing_means(d, {"mean": ("steps", 14, 1)}).select("subject_id", "date", "mean"))


@query(by_day("SELECT name, kind, CAST(rank AS INT) AS rank FROM (SELECT name, kind, row_number() OVER (PARTITION BY kind ORDER BY abs(height) DESC, name) AS rank FROM (SELECT subject_id AS name, avg(steps) - 180000 AS height, CASE WHEN avg(steps) >= 180000 THEN 'peak' ELSE 'valley' END AS kind FROM days GROUP BY 1)) WHERE kind = 'peak' AND rank <= 3 OR kind = 'valley' AND rank <= 2"))
def ranked_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = days(spark, sf_dir).groupBy(F.col("subject_id").alias("name")).agg((F.avg("steps") - 180000).alias("height"))
    return insight.ranked_regions(c).select("name", "kind", "rank")


@query(by_day("SELECT DISTINCT subject_id, upper(replace(subject_id, '_', ' ')[1]) || lower(replace(subject_id, '_', ' ')[2:]) AS label FROM days"))
def export_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.index(days(spark, sf_dir))


@query()
def subject_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON documents; a test rebuilds them day by day. A row a subject's day is kept, so orders are read once, not by every
    model and part of a document."""
    d = _axes(spark, sf_dir).persist()
    return export.payloads(d, trajectory.fit(trajectory.positions(d)))


@query(by_day("SELECT subject_id, unnest(['steps', 'resting_hr_bpm', 'sleep_hours']) AS metric, unnest([s, r, h]) AS points FROM (SELECT subject_id, CAST(count(steps) AS BIGINT) AS s, CAST(count(resting_hr_bpm) AS BIGINT) AS r, CAST(count(sleep_hours) AS BIGINT) AS h FROM (SELECT * FROM days QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY date DESC) <= 365) GROUP BY 1)"))
def card_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cards of a subject's document with the number of their points."""
    found = export.series(days(spark, sf_dir)).select("subject_id", F.explode("series").alias("s"))
    return found.select("subject_id", F.col("s.metric").alias("metric"), F.size("s.points").cast("long").alias("points"))


@query(by_day(f"SELECT * FROM (WITH {SCORES} SELECT subject_id, CAST(arg_max((activity__steps IS NOT NULL)::INT + (activity__sedentary_hours IS NOT NULL)::INT, date) AS INT) AS activity, CAST(arg_max((recovery__sleep_hours IS NOT NULL)::INT + (recovery__resting_hr_bpm IS NOT NULL)::INT, date) AS INT) AS recovery FROM sc WHERE activity_score IS NOT NULL AND recovery_score IS NOT NULL GROUP BY 1)"))
def ingredient_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.counts(trajectory.positions(_axes(spark, sf_dir))).select("subject_id", "counts.*")


@query()
def subject_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixtures of a subject's own positions; expectation and maximisation has no SQL."""
    return rounded(trajectory.subject_clusters(trajectory.positions(_axes(spark, sf_dir))), 4)


def nullable_any(columns: list[str]):
    """Whether any column is set."""
    return reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in columns])


@query(by_day("SELECT subject_id, date, sleep_hours IS NOT NULL OR hr_mean_bpm IS NOT NULL AS has_any, sleep_hours IS NOT NULL AND hr_mean_bpm IS NOT NULL AS has_all, coalesce(sleep_hours, 0) + coalesce(hr_mean_bpm, 0) AS total FROM days"))
def horizontal(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = days(spark, sf_dir)
    columns = ["sleep_hours", "hr_mean_bpm"]
    every = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in columns), F.lit(0.0))
    return d.select("subject_id", "date", nullable_any(columns).alias("has_any"), every.alias("has_all"), total.alias("total"))
