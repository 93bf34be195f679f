"""From observations to scored days, embeddings and forecasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.operators import calendar, daily, embedding, forecast, scores, stationarity
from chronolith.sources import sinks


def scored_days(observations: DataFrame, window_columns: Sequence[str] = daily.CORE_FEATURES) -> DataFrame:
    """Daily features of the dense periods, smoothed, with axis scores. Smoothing comes first: a change is an ingredient."""
    days = daily.build(observations)
    kept = scores.apply_windows(days, scores.dense_windows(days, window_columns))
    kept = scores.smoothed(kept).persist()  # exact quantiles read the days three times
    scored = scores.axis_scores(kept)
    return scores.smoothed(scored, ["activity_score", "recovery_score"])


def run(spark: SparkSession, source: str, out: str, test_share: float = 0.2) -> dict:
    """Daily features, embeddings and a report."""
    days = scored_days(spark.read.parquet(source))
    sinks.write_table(days, f"{out}/daily_features.parquet")
    days = spark.read.parquet(f"{out}/daily_features.parquet")
    parted = calendar.temporal_split(days, test_share)
    train = parted.filter("part = 'train'")
    columns = embedding.selected(train, [c for c in daily.MODEL_FEATURES if c in days.columns])
    stats = embedding.standardizer(train, columns)
    scaled = embedding.standardized(parted, stats, columns, mask=True).persist()
    means, loadings, explained = embedding.pca(scaled.filter("part = 'train'"), columns)
    coordinates = embedding.project(scaled, columns, means, loadings)
    net = embedding.autoencoder(scaled.filter("part = 'train'"), columns)
    hidden = embedding.latent(scaled, columns, net)
    maps = [embedding.mapped(coordinates, [f"pca_{i + 1}" for i in range(loadings.shape[1])], kind) for kind in ("umap", "tsne")]
    joined = coordinates.join(hidden, list(embedding.KEYS))
    for m in maps:
        joined = joined.join(m, list(embedding.KEYS))
    sinks.write_table(joined, f"{out}/embeddings.parquet")
    test = scaled.filter("part = 'test'")
    errors = {r["feature"]: (r["rmse"], r["mae"], r["n"]) for r in embedding.reconstruction_errors(test, embedding.reconstructed(test, columns, means, loadings), columns).collect()}
    report = {"features": columns, "explained": explained.tolist(), "reconstruction": errors, "subjects": days.agg(F.countDistinct("subject_id")).first()[0], "days": days.count()}
    sinks.write_report(report, f"{out}/embedding_report.json")
    return report


def combined(spark: SparkSession, out: str) -> DataFrame:
    """Days with their coordinates, of days that have both."""
    return spark.read.parquet(f"{out}/daily_features.parquet").join(spark.read.parquet(f"{out}/embeddings.parquet"), list(embedding.KEYS))


def run_forecast(spark: SparkSession, source: str, out: str, horizons: Sequence[int] = forecast.HORIZONS, test_share: float = 0.2) -> dict:
    """Predictions of all horizons in one table, and scores; orders of differencing are found once."""
    steps = sorted(set(horizons))
    if not steps or steps[0] < 1:
        raise ValueError("horizons are positive")
    days = scored_days(spark.read.parquet(source)).persist()
    columns = [c for c in dict.fromkeys([*forecast.INPUTS, *forecast.TARGETS]) if c in days.columns]
    orders = stationarity.plan(days, columns).persist()
    predictions, measured = None, None
    for h in steps:
        table = forecast.lag_table(days, h, orders=orders)
        p, e = forecast.evaluate(table, test_share)
        predictions = p if predictions is None else predictions.unionByName(p, allowMissingColumns=True)
        measured = e if measured is None else measured.unionByName(e)
    sinks.write_table(predictions, f"{out}/forecast_predictions.parquet")
    rows = [r.asDict() for r in measured.collect()]
    report = {"horizons": steps, "scores": rows, "orders": [r.asDict() for r in orders.collect()], "subjects": days.agg(F.countDistinct("subject_id")).first()[0]}
    sinks.write_report(report, f"{out}/forecast_report.json")
    return report
