"""Per-source rollups, trust, coverage, co-occurrence, and nearest sessions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.functions import vocabulary
from chronolith.operators.intervals import covered, day_runs

#: Who is trusted first, in general and for the body's measures.
TRUST = ("wearable", "scale", "phone", "app", "manual", "derived", "unknown")
BODY_TRUST = ("scale", "manual", "wearable", "phone", "app", "derived", "unknown")
BODY = ("BodyMass", "BodyFatPercentage", "LeanBodyMass", "BodyMassIndex")
_ACTIVITY = ("StepCount", "DistanceWalkingRunning", "FlightsClimbed", "ActiveEnergyBurned", "BasalEnergyBurned")
_GAIT = ("WalkingSpeed", "WalkingStepLength", "WalkingAsymmetryPercentage", "WalkingDoubleSupportPercentage")
#: Named sets of series.
FEATURE_SETS: dict[str, tuple[str, ...]] = {
    "steps and heart": ("StepCount", "HeartRate"),
    "core": ("StepCount", "HeartRate", "SleepTotal"),
    "cardio": ("HeartRate", "RestingHeartRate", "HeartRateVariabilitySDNN"),
    "activity": _ACTIVITY,
    "gait": _GAIT,
    "sleep stages": tuple(f"SleepAnalysis/{s}" for s in ("AsleepCore", "AsleepDeep", "AsleepREM", "Awake", "InBed")),
    "core plus activity": ("HeartRate", "SleepTotal", *_ACTIVITY),
    "rich": ("HeartRate", "RestingHeartRate", "SleepTotal", *_ACTIVITY, *_GAIT),
}
ROLLUP = ["subject_id", "date", "metric", "value_str", "source_type"]


def by_source(observations: DataFrame) -> DataFrame:
    """Rows, days and values by source and metric."""
    return observations.groupBy("source_type", "metric").agg(F.count("*").alias("n_rows"), F.countDistinct(F.to_date("start_local")).alias("n_days"), F.sum("value_num").alias("total"))


def subject_coverage(observations: DataFrame) -> DataFrame:
    return observations.groupBy("subject_id", "source_type").agg(F.count("*").alias("n_rows"), F.countDistinct(F.to_date("start_local")).alias("n_days"), F.min("start_local").alias("first_seen"), F.max("start_local").alias("last_seen"))


def per_day(observations: DataFrame, metric: str) -> DataFrame:
    """Total, mean and rows of one metric by subject and day, in one pass."""
    own = observations.filter(F.col("metric") == metric)
    return own.groupBy("subject_id", F.to_date("start_local").alias("date")).agg(F.sum("value_num").alias("total"), F.avg("value_num").alias("mean"), F.count("*").alias("n_rows"))


def daily_values(observations: DataFrame) -> DataFrame:
    """One value per subject, day, metric, category value and source, by the catalogue's rule.

    Sums and means of numbers (a sum of nulls is 0), distinct starts for counts (null counts as one), covered seconds of
    instants for durations; skipped metrics are left out.
    """
    df = observations.withColumns({"rule": vocabulary.rule_of(F.col("metric")), "date": F.to_date("start_local")})
    starts = F.countDistinct("start_local") + F.max(F.col("start_local").isNull().cast("int"))
    value = F.when(F.first("rule") == "sum", F.coalesce(F.sum("value_num"), F.lit(0.0))).when(F.first("rule") == "mean", F.avg("value_num")).otherwise(starts.cast("double"))
    plain = df.filter("rule IN ('sum', 'mean', 'count')").groupBy(*ROLLUP).agg(value.alias("value"))
    spans = covered(df.filter("rule = 'duration'"), ROLLUP, "start_utc", "end_utc").select(*ROLLUP, F.col("seconds").alias("value"))
    return plain.unionByName(spans)


def trust_rank(series: Column, source: Column) -> Column:
    """Smaller is more trusted."""
    orders = [F.create_map(*[v for i, s in enumerate(order) for v in (F.lit(s), F.lit(i))]) for order in (TRUST, BODY_TRUST)]
    return F.coalesce(F.when(series.isin(*BODY), F.try_element_at(orders[1], source)).otherwise(F.try_element_at(orders[0], source)), F.lit(len(TRUST)))


def trusted(daily: DataFrame, keys: Sequence[str] = ("subject_id", "date", "series")) -> DataFrame:
    """The most trusted source's value of every series and day: ``value, chosen, available``. Ties go to the name."""
    rank = F.struct(trust_rank(F.col("series"), F.col("source_type")), F.col("source_type"))
    return daily.groupBy(*keys).agg(F.min_by("value", rank).alias("value"), F.min_by("source_type", rank).alias("chosen"), F.count("*").alias("available"))


def wide(daily: DataFrame, series: Sequence[str], value: str = "value") -> DataFrame:
    """One column a series, by subject and day; the list of series is given, so no pass is spent on finding it."""
    return daily.groupBy("subject_id", "date").pivot("series", list(series)).agg(F.first(value))


def wide_by_source(daily: DataFrame, pairs: Sequence[tuple[str, str]], value: str = "value") -> DataFrame:
    """One column ``series@source`` for each of the given pairs, by subject and day."""
    named = daily.withColumn("__at", F.concat_ws("@", "series", "source_type"))
    return named.groupBy("subject_id", "date").pivot("__at", [f"{s}@{k}" for s, k in pairs]).agg(F.first(value))


def sleep_total(daily: DataFrame) -> Column:
    """A bridge over sleep recordings: the stages' sum if any is there, else unspecified, in bed, or the daily total."""
    stages = [c for c in ("SleepAnalysis/AsleepCore", "SleepAnalysis/AsleepDeep", "SleepAnalysis/AsleepREM") if c in daily.columns]
    col = lambda c: F.col(f"`{c}`")
    parts = []
    if stages:
        total = sum((F.coalesce(col(c), F.lit(0.0)) for c in stages), F.lit(0.0))
        parts.append(F.when(F.coalesce(*[col(c) for c in stages]).isNotNull(), total))
    parts += [col(c) for c in ("SleepAnalysis/AsleepUnspecified", "SleepAnalysis/InBed", "SleepDurationDaily") if c in daily.columns]
    return F.coalesce(*parts) if parts else F.lit(None).cast("double")


def density(long: DataFrame) -> DataFrame:
    """Days with a series, and their share of the days from its first to its last, by subject."""
    days = long.filter("value IS NOT NULL").groupBy("subject_id", "series").agg(F.countDistinct("date").alias("days"), F.min("date").alias("first"), F.max("date").alias("last"))
    return days.withColumn("density", F.col("days") / (F.datediff("last", "first") + 1))


def usable(density_table: DataFrame, least_days: int = 30) -> DataFrame:
    """Series by how many subjects have them densely."""
    return density_table.filter(F.col("days") >= least_days).groupBy("series").agg(F.countDistinct("subject_id").alias("subjects"), F.sum("density").alias("total_density")).orderBy(F.desc("subjects"), F.desc("total_density"), "series")


def set_coverage(long: DataFrame, sets: Mapping[str, Sequence[str]] = FEATURE_SETS) -> DataFrame:
    """Days on which a subject has all series of a set, their longest run, first and last, for every set."""
    spark = long.sparkSession
    members = spark.createDataFrame([(name, s, len(set(own))) for name, own in sets.items() for s in dict.fromkeys(own)], "feature_set string, series string, size int")
    days = long.filter("value IS NOT NULL").select("subject_id", "date", "series").distinct()
    complete = days.join(F.broadcast(members), "series").groupBy("subject_id", "feature_set", "date", "size").agg(F.count("*").alias("n")).filter("n = size")
    return day_runs(complete, ["subject_id", "feature_set"]).groupBy("subject_id", "feature_set").agg(F.sum("days").alias("days"), F.max("days").alias("longest"), F.min("first").alias("first"), F.max("last").alias("last"))


def set_summary(coverage: DataFrame) -> DataFrame:
    return coverage.groupBy("feature_set").agg(F.count("*").alias("subjects"), F.sum("days").alias("days"), F.min("days").alias("least_days"), F.max("days").alias("most_days"), F.max("longest").alias("longest"))


def cooccurrence(long: DataFrame) -> DataFrame:
    """How often two series fall on the same subject's day: share of the first's days, and Jaccard.

    A day's series are one array, of as many entries as there are series; its pairs are counted in each task first. A
    series with itself counts its days.
    """
    days = long.filter("value IS NOT NULL").groupBy("subject_id", "date").agg(F.collect_set("series").alias("s"))
    both = days.select(F.explode("s").alias("a"), "s").select("a", F.explode("s").alias("b")).groupBy("a", "b").agg(F.count("*").alias("both"))
    total = both.filter("a = b").select("a", F.col("both").alias("n"))
    out = both.join(total.toDF("a", "n_a"), "a").join(total.toDF("b", "n_b"), "b")
    return out.select("a", "b", "both", (F.col("both") / F.col("n_a")).alias("given_a"), (F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both"))).alias("jaccard"))


def similarity_order(pairs: Mapping[tuple[str, str], float], counts: Mapping[str, int]) -> list[str]:
    """A greedy chain for a chart of some dozens of names: the most common first, then always the one most like the last,
    the more common one of two; ties go to the name."""
    left, out = dict(counts), []
    while left:
        like = lambda n: (pairs.get((out[-1], n), 0.0) if out else 0.0, left[n])
        best = max(like(n) for n in left)
        out.append(min(n for n in left if like(n) == best))
        del left[out[-1]]
    return out


def chain(pairs: DataFrame) -> DataFrame:
    """``position, series``: the chain of a co-occurrence table, whose rows are the pairs of some dozens of series."""
    rows = pairs.select("a", "b", "both", "jaccard").collect()
    order = similarity_order({(r["a"], r["b"]): r["jaccard"] for r in rows}, {r["a"]: r["both"] for r in rows if r["a"] == r["b"]})
    return pairs.sparkSession.createDataFrame(list(enumerate(order, 1)), "position int, series string")


def choices(df: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column in order, without null."""
    return df.select(column).dropna().distinct().orderBy(column)


def free_series(table: DataFrame, chosen: Sequence[str], keys: Sequence[str] = ("subject_id", "date"), least: float = 0.5) -> DataFrame:
    """Series outside a set that come along on more than ``least`` of its complete days."""
    complete = table.dropna(subset=list(chosen))
    others = [c for c in table.columns if c not in {*chosen, *keys}]
    shares = complete.agg(*[F.avg(F.col(f"`{c}`").isNotNull().cast("double")).alias(c) for c in others])
    return shares.unpivot([], others, "series", "share").filter(F.col("share") > least).orderBy(F.desc("share"), "series")


def nearest_session(reports: DataFrame, sessions: DataFrame, key: str, at: str, hours: float = 3.0) -> DataFrame:
    """Each report with the session nearest in time, before or after, less than ``hours`` away; the earlier on a tie.

    Sessions are met by time bucket (the report's and its two neighbours), so the join is an equality, not a range.
    """
    width = int(hours * 3600)
    epoch = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    bucket = lambda c: F.floor(epoch(c) / (width * 1_000_000)).cast("long")
    points = reports.select(key, at).distinct().withColumn("__b", F.explode(F.array(bucket(at) - 1, bucket(at), bucket(at) + 1)))
    s = sessions.select(F.col(key).alias("__k"), F.col(at).alias("session_at"), F.col("session_id"), bucket(at).alias("__sb"))
    gap = F.abs(epoch(at) - epoch("session_at")) / F.lit(1e6)
    met = points.join(s, (points[key] == s["__k"]) & (points["__b"] == s["__sb"])).withColumn("gap_seconds", gap).filter(F.col("gap_seconds") < width)
    rank = F.struct("gap_seconds", "session_at", "session_id")
    best = met.groupBy(key, at).agg(F.min_by(F.struct("session_id", "session_at", "gap_seconds"), rank).alias("x"))
    return reports.join(best, [key, at], "left").select(*reports.columns, "x.*")


def matched_by_id(left: DataFrame, right: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """Rows of two logs that carry the same id, whatever type it was read as; ids that are no numbers match nothing."""
    a = left.withColumn("__id", F.col(left_id).try_cast("long"))
    b = right.withColumn("__jd", F.col(right_id).try_cast("long"))
    return a.join(b, F.col("__id") == F.col("__jd")).drop("__id", "__jd")


def monthly_mean(df: DataFrame, columns: Sequence[str], day: str = "date") -> DataFrame:
    """Means by subject and month, long: ``subject_id, month, series, value``."""
    means = df.groupBy("subject_id", F.to_date(F.date_trunc("month", day)).alias("month")).agg(*[F.avg(c).alias(c) for c in columns])
    return means.unpivot(["subject_id", "month"], list(columns), "series", "value").filter("value IS NOT NULL")
