"""Documents for a dashboard: one a subject, and an index."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.operators import calendar, quantiles, scores, trajectory
from chronolith.sources import sinks

HISTORY_DAYS, SERIES_DAYS = 180, 365
#: The daily values that cards and tables show.
CARDS = ("steps", "resting_hr_bpm", "sleep_hours", "hrv_sdnn_ms", "active_energy_kcal", "exercise_minutes")


def spreads(days: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``subject_id, feature, iqr`` by nearest ranks."""
    wanted = {f"{k}_{c}": (c, p, "nearest") for c in columns for k, p in (("a", 0.25), ("b", 0.75))}
    found = quantiles.exact(days, ["subject_id"], wanted).select("subject_id", *[(F.col(f"b_{c}") - F.col(f"a_{c}")).alias(c) for c in columns])
    return found.unpivot("subject_id", list(columns), "feature", "iqr").filter("iqr IS NOT NULL")


def _listed(df: DataFrame, name: str, *fields: Column) -> DataFrame:
    """A subject's rows as one array, in the order of the first field."""
    return df.groupBy("subject_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))


def _axis_struct(pattern: str, name: str) -> Column:
    return F.struct(*[F.col(pattern.format(a)).alias(a) for a in trajectory.AXIS_NAMES]).alias(name)


def history(positioned: DataFrame) -> DataFrame:
    """``subject_id, history``: date, position and velocity of the last days."""
    rows = calendar.latest(positioned, HISTORY_DAYS)
    return _listed(rows, "history", F.col("date").cast("string").alias("date"), _axis_struct("{}_position", "position"), _axis_struct("{}_velocity", "velocity"))


def series(days: DataFrame) -> DataFrame:
    """``subject_id, series``: for every card with any value, the points of a subject's last rows that have one."""
    cards = [c for c in CARDS if c in days.columns]
    if not cards:
        return days.select("subject_id").distinct().withColumn("series", F.array().cast("array<struct<metric:string,points:array<struct<date:string,value:double>>>>"))
    last = calendar.latest(days, SERIES_DAYS).groupBy("subject_id").agg(*[F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(F.col("date").cast("string").alias("date"), F.col(c).cast("double").alias("value"))))).alias(c) for c in cards])
    known = days.groupBy("subject_id").agg(*[F.count(c).alias(f"__n_{c}") for c in cards])
    parts = F.array(*[F.when(F.col(f"__n_{c}") > 0, F.struct(F.lit(c).alias("metric"), F.col(c).alias("points"))) for c in cards])
    return last.join(known, "subject_id").select("subject_id", F.array_compact(parts).alias("series"))


def moves(positioned: DataFrame) -> DataFrame:
    """``subject_id, contributions``: today's share of every factor that moves an axis, in the factors' order."""
    axes, order = trajectory.AXIS_NAMES, factors()
    parts = reduce(DataFrame.unionByName, [trajectory.contributions(positioned, a, scores.AXES[a]) for a in axes])
    today = parts.join(positioned.groupBy("subject_id").agg(F.max("date").alias("date")), ["subject_id", "date"])
    shares = today.groupBy("subject_id", "factor").agg(*[F.coalesce(F.sum(F.when(F.col("axis") == a, F.col("value"))), F.lit(0.0)).alias(a) for a in axes])
    shares = shares.filter(" OR ".join(f"{a} <> 0" for a in axes))
    at = F.array_position(F.array(*[F.lit(f) for f in order]), F.col("factor")).alias("at")
    listed = _listed(shares, "ranked", at, F.col("factor"), *[F.col(a) for a in axes])
    return listed.select("subject_id", F.transform("ranked", lambda r: F.struct(r["factor"].alias("factor"), *[r[a].alias(a) for a in axes])).alias("contributions"))


def factors() -> list[str]:
    return [*dict.fromkeys(trajectory.FACTORS.values()), "pull"]


def counts(positioned: DataFrame) -> DataFrame:
    """``subject_id, counts``: ingredients of each axis on the last day on which every axis has any."""
    axes = trajectory.AXIS_NAMES
    count = {a: sum((F.col(f"{a}__{c}").isNotNull().cast("int") for c in scores.AXES[a] if f"{a}__{c}" in positioned.columns), F.lit(0)) for a in axes}
    rows = positioned.select("subject_id", "date", *[n.alias(a) for a, n in count.items()]).filter(" AND ".join(f"{a} > 0" for a in axes))
    return rows.groupBy("subject_id").agg(F.max_by(F.struct(*axes), "date").alias("counts"))


def payloads(days: DataFrame, fitted: dict) -> DataFrame:
    """``subject_id, document``: all that a dashboard shows of a subject, as JSON.

    ``trajectory``: subjectId, asOf (the last day), keep, history, prediction, clusters, contributions; ``series``;
    ``scaling``: iqr (spreads above 0, by name) and counts. ``days`` has the axes' components and scores.
    """
    axes = trajectory.AXIS_NAMES
    positioned = trajectory.positions(days).persist()  # five parts of a document read it
    ahead = trajectory.forecast(positioned, fitted)
    prediction = _listed(ahead, "prediction", F.col("date").cast("string").alias("date"), _axis_struct("{}_predicted", "position"), _axis_struct("{}_low_value", "low"), _axis_struct("{}_high_value", "high"))
    center = F.struct(F.col("x").alias(axes[0]), F.col("y").alias(axes[1])).alias("center")
    covariance = F.array(F.array("var_x", "cov"), F.array("cov", "var_y")).alias("covariance")
    clusters = _listed(trajectory.subject_clusters(positioned), "clusters", center, covariance, F.col("kind"))
    used = list(dict.fromkeys(c for parts in scores.AXES.values() for c in parts if c in days.columns))
    iqr = spreads(days, used).filter("iqr > 0").groupBy("subject_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", "iqr")))).alias("iqr"))
    out = days.groupBy("subject_id").agg(F.max("date").cast("string").alias("asOf"))
    for part in (history(positioned), prediction, clusters, moves(positioned), series(days), iqr, counts(positioned)):
        out = out.join(part, "subject_id", "left")
    none = lambda c: F.coalesce(F.col(c), F.array().cast(dict(out.dtypes)[c])).alias(c)
    path = F.struct(F.col("subject_id").alias("subjectId"), "asOf", F.lit(trajectory.KEEP).alias("keep"), "history", none("prediction"), none("clusters"), none("contributions")).alias("trajectory")
    scaling = F.struct(F.coalesce("iqr", F.create_map().cast("map<string,double>")).alias("iqr"), F.coalesce("counts", F.struct(*[F.lit(0).alias(a) for a in axes])).alias("counts")).alias("scaling")
    return out.select("subject_id", F.to_json(F.struct(path, none("series"), scaling)).alias("document"))


def index(days: DataFrame) -> DataFrame:
    """``subject_id, label`` of every subject."""
    name = F.regexp_replace("subject_id", "_", " ")
    return days.select("subject_id").distinct().select("subject_id", F.concat(F.upper(F.substring(name, 1, 1)), F.lower(F.substr(name, F.lit(2)))).alias("label"))


def model_document(fitted: dict) -> dict:
    """What the index says of the model: constants, coefficients and errors by horizon."""
    axes = trajectory.AXIS_NAMES
    names = [f"{a}_position__lag{k}" for a in axes for k in trajectory.LAGS]
    weights = {str(h): {a: {"intercept": float(b), **dict(zip(names, map(float, w), strict=True))} for a, (w, b) in m.items()} for h, m in sorted(fitted["models"].items())}
    measured = {
        str(r["horizon"]): {a: {"ridge_mae": r[f"{a}_mae"], "hold_today_mae": r[f"{a}_mae_hold"], "usual_level_mae": r[f"{a}_mae_usual"], "band_coverage": r[f"{a}_inside"], "test_rows": r["n"]} for a in axes}
        for r in fitted["coverage"].orderBy("horizon").collect()
    }
    return {
        "halfLifeDays": trajectory.HALF_LIFE,
        "keep": trajectory.KEEP,
        "axes": scores.AXES,
        "factors": factors(),
        "pullFactor": "pull",
        "clusterRule": "healthy when activity + recovery at the cluster center is at least 0",
        "forecast": {"model": "Ridge, one per horizon, pooled across subjects", "alpha": trajectory.ALPHA, "lags": list(trajectory.LAGS), "bandQuantiles": list(trajectory.BANDS), "coefficients": weights, "evaluation": measured},
    }


def run(spark: SparkSession, source: str, out: str) -> None:
    """A document a subject, the list of subjects, and the model."""
    days = spark.read.parquet(source)
    parts = [f"{a}__{c}" for a, own in scores.AXES.items() for c in own if c in days.columns]
    if not set(parts) <= set(days.columns):
        days = scores.axis_scores(days)
    fitted = trajectory.fit(trajectory.positions(days))
    sinks.write_documents(payloads(days, fitted), f"{out}/subjects")
    index(days).coalesce(1).write.mode("overwrite").json(f"{out}/index")
    sinks.write_report(model_document(fitted), f"{out}/model.json")
