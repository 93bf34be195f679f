"""Complete calendars, differences, lags, splits and trailing windows of series by subject and day."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


#: Days of a block; a subject's series is worked on block by block.
BLOCK_DAYS = 1024


def ordered(by: Sequence[str] = ("subject_id",)) -> WindowSpec:
    """A subject's days in order."""
    return Window.partitionBy(*by).orderBy("date")


def in_blocks(df: DataFrame, make: Callable[[DataFrame, list[str]], DataFrame], before: int, after: int = 0, key: str = "subject_id", day: str = "date") -> DataFrame:
    """``make(rows, by)`` adds columns by windows over ``by``: the subject and a block of days with the ``before`` days
    ahead of it and the ``after`` days behind, so that no window needs a whole series. Rows lent to another block are
    dropped again; rows without a day are a block of their own."""
    at = F.unix_date(day)
    block = lambda d: F.floor(d / F.lit(BLOCK_DAYS)).cast("int")
    needed = F.explode_outer(F.sequence(block(at - after), block(at + before)))
    lent = df.withColumn("__block", needed)
    made = make(lent, [key, "__block"])
    return made.filter(F.col("__block").isNull() | (F.col("__block") == block(at))).drop("__block")


def filled(df: DataFrame, key: str = "subject_id", day: str = "date") -> DataFrame:
    """Every day from a subject's first to its last; days without a row have nulls."""
    ends = df.groupBy(key).agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    grid = ends.select(key, F.explode(F.sequence("lo", "hi")).alias(day))
    return grid.join(df, [key, day], "left")


def trailing_mean(column: str, days: int, least: int = 1, by: Sequence[str] = ("subject_id",), day: str = "date") -> Column:
    """Mean of a calendar window that ends today, null with fewer observations than ``least``."""
    w = Window.partitionBy(*by).orderBy(F.unix_date(day)).rangeBetween(-(days - 1), 0)
    return F.when(F.count(column).over(w) >= least, F.avg(column).over(w))


def with_trailing_means(df: DataFrame, wanted: Mapping[str, tuple[str, int, int]]) -> DataFrame:
    """A column a name: ``wanted`` maps it to (column, days, least observations) of its trailing mean."""
    if not wanted:
        return df
    return in_blocks(df, lambda d, by: d.withColumns({name: trailing_mean(*x, by) for name, x in wanted.items()}), max(days for _, days, _ in wanted.values()) - 1)


def with_orders(df: DataFrame, orders: Mapping[str, Mapping[str, int]] | DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each subject's orders of differencing beside its rows: ``__o_<column>``."""
    spark = df.sparkSession
    if not isinstance(orders, DataFrame):
        orders = spark.createDataFrame([(s, f, o) for s, own in orders.items() for f, o in own.items()], "subject_id string, feature string, `order` int")
    wide = orders.groupBy("subject_id").pivot("feature", list(columns)).agg(F.first("order")).withColumnsRenamed({c: f"__o_{c}" for c in columns})
    return df.join(wide, "subject_id", "left")


def with_differences(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Columns differenced by the orders that ``with_orders`` put beside them."""
    once = {f"__d_{c}": F.col(c) - F.lag(c).over(ordered(by)) for c in columns}
    twice = {f"__e_{c}": F.col(f"__d_{c}") - F.lag(f"__d_{c}").over(ordered(by)) for c in columns}
    made = {c: F.when(F.coalesce(f"__o_{c}", F.lit(0)) == 0, F.col(c)).when(F.col(f"__o_{c}") == 1, F.col(f"__d_{c}")).otherwise(F.col(f"__e_{c}")) for c in columns}
    return df.withColumns(once).withColumns(twice).withColumns(made).drop(*[f"__{k}_{c}" for k in "ode" for c in columns])


def differenced(df: DataFrame, orders: Mapping[str, Mapping[str, int]] | DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns differenced 0, 1 or 2 times on a complete calendar, by each subject's order.

    ``orders`` is a table ``subject_id, feature, order`` (or a nested mapping); a subject without one keeps the column.
    """
    return in_blocks(with_orders(df, orders, columns), lambda d, by: with_differences(d, columns, by), 2)


def with_lags(df: DataFrame, columns: Sequence[str], lags: Sequence[int], by: Sequence[str] = ("subject_id",)) -> DataFrame:
    """``column__lag_k`` for every lag, in one window pass over a complete calendar."""
    return df.withColumns({f"{c}__lag_{k}": F.lag(c, k).over(ordered(by)) for c in columns for k in lags})


def with_leads(df: DataFrame, columns: Sequence[str], horizon: int, by: Sequence[str] = ("subject_id",)) -> DataFrame:
    """``target__column`` ``horizon`` days ahead, and ``target_date``."""
    made = {f"target__{c}": F.lead(c, horizon).over(ordered(by)) for c in columns}
    return df.withColumns(made | {"target_date": F.date_add("date", horizon)})


def temporal_split(df: DataFrame, test_share: float = 0.2, key: str = "subject_id", day: str = "date") -> DataFrame:
    """``part`` train or test: the last share of each subject's rows is test, at least one row is train."""
    n = F.count("*").over(Window.partitionBy(key))
    cut = F.greatest(F.lit(1), F.least(n - 1, F.bround(n * (1 - F.lit(test_share)), 0).cast("long")))
    at = F.row_number().over(Window.partitionBy(key).orderBy(day))
    return df.withColumn("part", F.when(at <= cut, "train").otherwise("test"))


def split_dates(df: DataFrame, shares: Sequence[float], key: str = "subject_id", day: str = "date") -> DataFrame:
    """For each share the date at which a subject's last ceil(n * share) days begin: ``start_<percent>``."""
    dates = F.array_sort(F.collect_set(day))
    grouped = df.groupBy(key).agg(dates.alias("d"))
    return grouped.select(key, *[F.element_at("d", (F.size("d") - F.ceil(F.size("d") * F.lit(float(s))) + 1).cast("int")).alias(f"start_{round(s * 100)}") for s in shares])


def latest(df: DataFrame, n: int, key: str = "subject_id", day: str = "date") -> DataFrame:
    """A subject's last n rows."""
    at = F.row_number().over(Window.partitionBy(key).orderBy(F.col(day).desc()))
    return df.withColumn("__at", at).filter(F.col("__at") <= n).drop("__at")
