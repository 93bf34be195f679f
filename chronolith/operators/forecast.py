"""Supervised lag tables, baselines, regressors and their scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.operators.calendar import filled, in_blocks, ordered, temporal_split, with_differences, with_lags, with_leads, with_orders
from chronolith.operators.scores import mean_of

#: Lags, targets, inputs and horizons.
LAGS = (*range(10), 14, 28)
TARGETS = ("activity_score", "recovery_score")
INPUTS = ("steps", "sleep_hours", "hr_mean_bpm", "resting_hr_bpm", "hr_active_excess_bpm", "hrv_sdnn_ms", "resting_hr_change_bpm", "activity_score", "recovery_score")
HORIZONS = (1, 3, 7, 14)
MODELS = ("persistence", "seasonal", "moving_mean", "ridge", "elastic_net", "boosted")


@dataclass
class LagTable:
    """The lag table of one horizon: rows, feature and target columns, and the orders of differencing it was made with."""

    frame: DataFrame
    features: list[str]
    targets: list[str]
    horizon: int
    orders: DataFrame | None = None
    lags: tuple[int, ...] = field(default=LAGS)


def seasonal_lag(horizon: int) -> int:
    """The lag at which a value a whole number of weeks before the target is known."""
    return (7 - horizon % 7) % 7


def lag_table(daily: DataFrame, horizon: int, targets: Sequence[str] = TARGETS, inputs: Sequence[str] = INPUTS, lags: Sequence[int] = LAGS, orders: DataFrame | None = None) -> LagTable:
    """Lags of inputs and targets and the target ``horizon`` days ahead, on differenced series; raw anchors beside them.

    ``actual__t`` is the target's raw value, ``anchor__t__origin`` and ``anchor__t__previous`` the raw values today and
    yesterday, from which differences are put together again. Rows without a target are left out.
    """
    used = sorted({*lags, 0, 1, 2, 3, seasonal_lag(horizon)})
    columns = [c for c in dict.fromkeys([*inputs, *targets]) if c in daily.columns]
    full = filled(daily.select("subject_id", "date", *columns))
    full = full if orders is None else with_orders(full, orders, columns)

    def made(days: DataFrame, by: list[str]) -> DataFrame:
        anchors = {f"anchor__{t}__origin": F.col(t) for t in targets} | {f"anchor__{t}__previous": F.lag(t).over(ordered(by)) for t in targets} | {f"actual__{t}": F.lead(t, horizon).over(ordered(by)) for t in targets}
        days = days.withColumns(anchors)
        days = days if orders is None else with_differences(days, columns, by)
        return with_leads(with_lags(days, columns, used, by), list(targets), horizon, by)

    table = in_blocks(full, made, max(used) + 2, horizon)
    whole = table.dropna(subset=[f"target__{t}" for t in targets]).drop(*columns)
    return LagTable(whole, [f"{c}__lag_{k}" for c in columns for k in used], list(targets), horizon, orders, tuple(used))


def baselines(table: LagTable) -> DataFrame:
    """Predictions ``<model>__<target>``: today's value, that of the same weekday, and the mean of four days."""
    made = {}
    for t in table.targets:
        made[f"persistence__{t}"] = F.col(f"{t}__lag_0")
        made[f"seasonal__{t}"] = F.col(f"{t}__lag_{seasonal_lag(table.horizon)}")
        made[f"moving_mean__{t}"] = mean_of([f"{t}__lag_{k}" for k in range(4)])
    return table.frame.withColumns(made)


def split(frame: DataFrame, test_share: float = 0.2) -> tuple[DataFrame, DataFrame]:
    parted = temporal_split(frame, test_share, day="target_date")
    return parted.filter("part = 'train'").drop("part"), parted.filter("part = 'test'").drop("part")


def undifferenced(frame: DataFrame, prediction: str, target: str, horizon: int, order: Column) -> Column:
    """A predicted difference as a value again, from the raw anchors; null where an anchor is missing."""
    v, origin, previous = F.col(prediction), F.col(f"anchor__{target}__origin"), F.col(f"anchor__{target}__previous")
    h = float(horizon)
    return F.when(order == 1, origin + F.lit(h) * v).when(order == 2, origin + F.lit(h) * (origin - previous) + F.lit(h * (h + 1) / 2) * v).otherwise(v)


def order_of(orders: DataFrame, target: str) -> DataFrame:
    """``subject_id, order`` of one target, for a join."""
    return orders.filter(F.col("feature") == target).select("subject_id", F.col("order").alias("__order"))


def medians(train: DataFrame, features: Sequence[str]) -> DataFrame:
    """Exact medians for imputation; 0 where a column has no values."""
    return train.agg(*[F.coalesce(F.median(c), F.lit(0.0)).alias(c) for c in features])


@dataclass
class Regressor:
    """Imputation, scaling and a linear or boosted model of one target."""

    features: list[str]
    fills: dict[str, float]
    means: dict[str, float]
    scales: dict[str, float]
    model: object
    offset: float = 0.0

    def _columns(self) -> list[Column]:
        return [((F.coalesce(F.col(c), F.lit(self.fills[c])) - F.lit(self.means[c])) / F.lit(self.scales[c])).alias(f"__x_{c}") for c in self.features]

    def matrix(self, df: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=[f"__x_{c}" for c in self.features], outputCol="__features").transform(df.select("*", *self._columns()))

    def predict(self, df: DataFrame, name: str) -> DataFrame:
        out = self.model.transform(self.matrix(df))
        return out.withColumn(name, F.col("prediction") + F.lit(self.offset)).drop("__features", "prediction", *[f"__x_{c}" for c in self.features])


def fit(train: DataFrame, features: Sequence[str], target: str, kind: str, alpha: float = 1.0, l1_ratio: float = 0.5, seed: int = 42) -> Regressor:
    """``ridge`` and ``elastic_net`` with the penalties of the textbook objectives, or ``boosted`` trees.

    Features are scaled by their population deviation. Spark's regularisation is per row and relative to the target's
    deviation, hence the conversion.
    """
    features = list(features)
    fills = medians(train, features).first().asDict()
    imputed = [F.coalesce(F.col(c), F.lit(fills[c])).alias(c) for c in features]
    stats = train.select(*imputed, F.col(target).alias("__y")).agg(*[F.avg(c).alias(f"m_{c}") for c in features], *[F.stddev_pop(c).alias(f"s_{c}") for c in features], F.stddev_pop("__y").alias("sy"), F.count("*").alias("n")).first().asDict()
    scales = {c: s if (s := stats[f"s_{c}"]) and s > 1e-12 else 1.0 for c in features}
    out = Regressor(features, fills, {c: stats[f"m_{c}"] or 0.0 for c in features}, scales, None)
    data = out.matrix(train.filter(F.col(target).isNotNull()))
    if kind == "boosted":
        model = GBTRegressor(featuresCol="__features", labelCol=target, maxIter=100, stepSize=0.05, seed=seed)
    else:
        sy = stats["sy"] or 1.0
        strength = alpha / stats["n"] * sy if kind == "ridge" else alpha * (l1_ratio + (1 - l1_ratio) * sy)
        mixing = 0.0 if kind == "ridge" else alpha * l1_ratio / strength
        model = LinearRegression(featuresCol="__features", labelCol=target, regParam=strength, elasticNetParam=mixing, standardization=False, solver="normal" if kind == "ridge" else "auto")
    out.model = model.fit(data)
    return out


def errors(predictions: DataFrame, pairs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """``name, mae, rmse, n`` of finite pairs (prediction, actual), in one pass."""
    measures = []
    for name, (p, a) in pairs.items():
        e = F.col(p) - F.col(a)
        e = F.when(e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")), e)
        measures.append(F.struct(F.lit(name).alias("name"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.count(e).alias("n")))
    return predictions.agg(F.array(*measures).alias("m")).select(F.inline("m"))


def evaluate(table: LagTable, test_share: float = 0.2, models: Sequence[str] = MODELS) -> tuple[DataFrame, DataFrame]:
    """Predictions of the test rows in raw units, and the scores of every model and target."""
    train, test = split(baselines(table), test_share)
    pairs = {}
    for t in table.targets:
        if table.orders is not None:
            test = test.join(order_of(table.orders, t), "subject_id", "left")
        order = F.coalesce(F.col("__order"), F.lit(0)) if table.orders is not None else F.lit(0)
        for kind in models:
            name = f"{kind}__{t}"
            if kind in ("ridge", "elastic_net", "boosted"):
                alpha = 1.0 if kind == "ridge" else 0.01
                test = fit(train, table.features, f"target__{t}", kind, alpha).predict(test, name)
            test = test.withColumn(name, undifferenced(test, name, t, table.horizon, order))
            pairs[name] = (name, f"actual__{t}")
        if table.orders is not None:
            test = test.drop("__order")
    keep = ["subject_id", "date", "target_date", *[f"actual__{t}" for t in table.targets], *pairs]
    predictions = test.select(*keep).withColumn("horizon_days", F.lit(table.horizon))
    return predictions, errors(predictions, pairs).withColumn("horizon_days", F.lit(table.horizon))
