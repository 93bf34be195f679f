"""Orders of differencing by unit-root tests: ADF and KPSS agree, or the series is differenced again."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolith.operators.calendar import filled

LEAST, FLOOR, MOST = 30, 12, 2
#: Critical values of the level-stationarity test, and their p-values.
KPSS_TABLE = ((0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01))
PLAN = "subject_id string, feature string, `order` int, observations int, status string"


def _ols(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients, their standard errors, and the residual sum of squares."""
    q, r = np.linalg.qr(x)
    b = np.linalg.solve(r, q.T @ y)
    rss = float(((y - x @ b) ** 2).sum())
    inverse = np.linalg.inv(r)
    return b, np.sqrt(np.maximum((inverse**2).sum(axis=1) * rss / max(1, len(y) - x.shape[1]), 0)), rss


def _regressors(series: np.ndarray, lags: int, trim: int) -> tuple[np.ndarray, np.ndarray]:
    change = np.diff(series)
    y = change[trim:]
    columns = [series[trim:-1], *[change[trim - k : len(change) - k] for k in range(1, lags + 1)], np.ones(len(y))]
    return y, np.column_stack(columns)


def adf(series: np.ndarray) -> float:
    """p-value of the augmented Dickey-Fuller test with a constant, lags by AIC (MacKinnon 1994)."""
    n = len(series)
    most = max(0, min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2))
    best = (math.inf, 0)
    for p in range(most + 1):
        y, x = _regressors(series, p, most)
        rss = _ols(y, x)[2]
        m = len(y)
        likelihood = -m / 2 * (math.log(2 * math.pi) + math.log(max(rss, 1e-300) / m) + 1)
        best = min(best, (-2 * likelihood + 2 * x.shape[1], p))
    y, x = _regressors(series, best[1], best[1])
    b, se, _ = _ols(y, x)
    t = float(b[0] / se[0]) if se[0] > 0 else -math.inf
    if t > 2.74:
        return 1.0
    if t < -18.83:
        return 0.0
    z = 2.1659 + 1.4412 * t + 0.038269 * t * t if t <= -1.61 else 1.7339 + 0.93202 * t - 0.12745 * t * t - 0.010368 * t**3
    return 0.5 * (1 + math.erf(z / math.sqrt(2)))


def kpss(series: np.ndarray) -> float:
    """p-value of the KPSS test for a level, automatic bandwidth (Hobijn, Franses, Ooms 1998), clipped to 0.01 to 0.1."""
    n = len(series)
    r = series - series.mean()
    m = int(n ** (2 / 9))
    gamma = [float(r[i:] @ r[: n - i]) / (n / 2) for i in range(1, m + 1)]
    s0 = float(r @ r) / n + sum(gamma)
    s1 = sum(i * g for i, g in enumerate(gamma, 1))
    width = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1) if s0 else 0
    variance = float(r @ r) / n + 2 / n * sum((1 - i / (width + 1)) * float(r[i:] @ r[: n - i]) for i in range(1, width + 1))
    statistic = float((np.cumsum(r) ** 2).sum()) / n**2 / variance
    return float(np.interp(statistic, [a for a, _ in KPSS_TABLE], [p for _, p in KPSS_TABLE]))


def longest_segment(series: np.ndarray) -> np.ndarray:
    """The longest run without gaps, the first of equal ones."""
    finite = np.isfinite(series)
    edge = np.diff(np.concatenate([[0], finite.astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
    if not len(starts):
        return series[:0]
    k = int(np.argmax(ends - starts))
    return series[starts[k] : ends[k]]


def order_of(series: np.ndarray, alpha: float = 0.05) -> tuple[int, int, str]:
    """(order, observations, status) of one series."""
    part = longest_segment(series)
    if np.isfinite(series).sum() < LEAST or len(part) < LEAST:
        return 0, len(part), "too short"
    for d in range(MOST + 1):
        now = np.diff(part, n=d) if d else part
        if len(now) < max(LEAST - d, FLOOR):
            return d, len(part), "too short"
        if now.std() <= 1e-12 * max(1.0, abs(float(now.mean()))):
            return d, len(part), "constant"
        try:
            settled = adf(now) <= alpha and kpss(now) > alpha
        except (np.linalg.LinAlgError, ZeroDivisionError, FloatingPointError, ValueError):
            return max(0, d - 1), len(part), "inconclusive"
        if settled:
            return d, len(part), "stationary"
    return MOST, len(part), "not stationary"


def plan(daily: DataFrame, columns: Sequence[str], train_share: float = 0.8, alpha: float = 0.05) -> DataFrame:
    """``subject_id, feature, order, observations, status`` from the first share of each subject's calendar."""
    full = filled(daily.select("subject_id", "date", *columns))
    n = F.count("*").over(Window.partitionBy("subject_id"))
    at = F.row_number().over(Window.partitionBy("subject_id").orderBy("date"))
    train = full.withColumns({"n": n, "at": at}).filter(F.col("at") <= F.ceil(F.lit(train_share) * F.col("n")))
    long = train.select("subject_id", "date", *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(["subject_id", "date"], list(columns), "feature", "value")

    def decide(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        values = frame.sort_values("date")["value"].to_numpy(np.float64, na_value=np.nan)
        return pd.DataFrame([(key[0], key[1], *order_of(values, alpha))], columns=["subject_id", "feature", "order", "observations", "status"])

    return long.groupBy("subject_id", "feature").applyInPandas(decide, PLAN)
