"""Dense periods, smoothing, and personal activity and recovery scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.operators import quantiles
from chronolith.operators.calendar import filled, with_trailing_means

WINDOW_DAYS, THRESHOLD = 30, 0.6
#: The ingredients of each axis and their sign.
AXES: dict[str, dict[str, int]] = {
    "activity": {"steps": 1, "distance_m": 1, "exercise_minutes": 1, "active_energy_kcal": 1, "light_activity_hours": 1, "sedentary_hours": -1, "hr_active_excess_bpm": 1},
    "recovery": {"sleep_hours": 1, "sleep_efficiency": 1, "hrv_sdnn_ms": 1, "sleep_score": 1, "sleep_restlessness": -1, "resting_hr_bpm": -1, "resting_hr_change_bpm": -1, "hr_active_excess_bpm": -1, "respiratory_rate": -1},
}
#: What is smoothed, and the changes made of it.
SMOOTHED = ("steps", "sleep_hours", "hr_mean_bpm", "hr_p10_bpm", "hr_active_excess_bpm", "resting_hr_bpm", "activity_score", "recovery_score")
CHANGES = {"resting_hr_bpm": "resting_hr_change_bpm", "hr_p10_bpm": "hr_p10_change_bpm"}


def dense_windows(daily: DataFrame, columns: Sequence[str], width: int = WINDOW_DAYS, threshold: float = THRESHOLD) -> DataFrame:
    """A subject's best period: ``subject_id, start, end, days, mean_completeness, meets_threshold``.

    A day scores the share of ``columns`` that are set; windows of ``width`` days (or all, if fewer) qualify at the
    threshold, neighbouring ones merge, and the longest, then fullest, then first wins. Without one the single best
    window is returned and ``meets_threshold`` is false. Sums are of integers, so the boundary is exact.
    """
    missing = [c for c in columns if c not in daily.columns]
    if missing:
        raise KeyError(f"no columns {missing}")
    k = len(columns)
    score = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    days = filled(daily.select("subject_id", "date", *columns)).select("subject_id", "date", score.alias("s"))
    own = Window.partitionBy("subject_id")
    days = days.withColumns({"n": F.count("*").over(own), "at": F.row_number().over(own.orderBy("date"))}).withColumn("w", F.least("n", F.lit(width)))
    total = F.sum("s").over(own.orderBy("date").rowsBetween(0, width - 1))
    starts = days.withColumn("total", total).filter("at + w - 1 <= n").withColumn("ok", F.col("total") >= F.lit(threshold) * F.col("w") * k - F.lit(1e-9))
    good = starts.filter("ok").withColumn("island", F.col("at") - F.row_number().over(own.orderBy("at")))
    merged = good.groupBy("subject_id", "island").agg(F.min("at").alias("lo"), (F.max("at") + F.first("w") - 1).alias("hi"), F.lit(True).alias("meets_threshold"))
    best = F.row_number().over(own.orderBy(F.desc("total"), "at"))
    single = starts.withColumn("r", best).filter("r = 1").select("subject_id", F.col("at").alias("lo"), (F.col("at") + F.col("w") - 1).alias("hi"), F.lit(False).alias("meets_threshold"))
    candidates = merged.drop("island").unionByName(single)
    held = candidates.join(days.select("subject_id", "date", "s", "at"), "subject_id").filter("at BETWEEN lo AND hi")
    measured = held.groupBy("subject_id", "lo", "hi", "meets_threshold").agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count("*").alias("days"), (F.sum("s") / F.lit(float(k)) / F.count("*")).alias("mean_completeness"))
    rank = F.row_number().over(own.orderBy(F.desc("meets_threshold"), F.desc("days"), F.desc("mean_completeness"), "start"))
    return measured.withColumn("r", rank).filter("r = 1").select("subject_id", "start", "end", "days", "mean_completeness", "meets_threshold")


def apply_windows(daily: DataFrame, windows: DataFrame) -> DataFrame:
    """Rows inside their subject's window, ends included. There is one window a subject."""
    w = windows.select(F.col("subject_id").alias("__s"), F.col("start").alias("__a"), F.col("end").alias("__b"))
    return daily.join(w, (daily.subject_id == w["__s"]) & daily.date.between(w["__a"], w["__b"]), "left_semi")


def smoothed(daily: DataFrame, columns: Sequence[str] = SMOOTHED) -> DataFrame:
    """Trailing means over 7 days (3 observations) and 28 days (7), and their difference for two heart-rate features; a week less four weeks."""
    present = [c for c in columns if c in daily.columns]
    out = with_trailing_means(daily, {f"{c}_{days}d": (c, days, least) for c in present for days, least in ((7, 3), (28, 7))})
    changes = {name: F.col(f"{c}_7d") - F.col(f"{c}_28d") for c, name in CHANGES.items() if c in present}
    return out.withColumns(changes) if changes else out


def axis_components(daily: DataFrame, axes: dict[str, dict[str, int]] = AXES) -> DataFrame:
    """``<axis>__<feature>``: sign * (value - personal median) / personal interquartile range, null where that is 0."""
    used = sorted({c for parts in axes.values() for c in parts if c in daily.columns})
    if not used:
        return daily
    wanted = {f"__{k}_{c}": (c, p, kind) for c in used for k, p, kind in (("m", 0.5, "linear"), ("a", 0.25, "nearest"), ("b", 0.75, "nearest"))}
    stats = quantiles.exact(daily, ["subject_id"], wanted)
    stats = stats.select("subject_id", *[f"__m_{c}" for c in used], *[(F.col(f"__b_{c}") - F.col(f"__a_{c}")).alias(f"__q_{c}") for c in used])
    joined = daily.join(stats, "subject_id", "left")
    part = lambda c, sign: F.when(F.col(f"__q_{c}") > 0, F.lit(sign) * (F.col(c) - F.col(f"__m_{c}")) / F.col(f"__q_{c}"))
    made = {f"{axis}__{c}": part(c, sign) for axis, parts in axes.items() for c, sign in parts.items() if c in used}
    return joined.withColumns(made).drop(*[f"__{k}_{c}" for k in "mq" for c in used])


def mean_of(columns: Sequence[str]) -> Column:
    """The mean of the columns that are set."""
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in columns), F.lit(0.0))
    n = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    return F.when(n > 0, total / n)


def axis_scores(daily: DataFrame, axes: dict[str, dict[str, int]] = AXES) -> DataFrame:
    """``<axis>_score``, the mean of an axis' components, and ``<axis>_coverage``, the share of its ingredients set."""
    out = axis_components(daily, axes)
    for axis, parts in axes.items():
        present = [c for c in parts if c in daily.columns]
        score = mean_of([f"{axis}__{c}" for c in present]) if present else F.lit(None).cast("double")
        share = sum((F.col(c).isNotNull().cast("int") for c in present), F.lit(0)) / F.lit(float(max(1, len(present))))
        out = out.withColumns({f"{axis}_score": score, f"{axis}_coverage": share})
    return out
