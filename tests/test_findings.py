"""Queries on small made tables that have what only large ones had: full days, dense days, files of several tasks."""

import datetime as dt

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from chronolith.operators import embedding, trajectory

QUERIES, ORACLES = __spark_entry__.queries(), __spark_entry__.oracle_sql()


def against_sql(spark, folder, name, table):
    """The query's rows and those of its SQL, over one table of the folder."""
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    return sorted(map(tuple, QUERIES[name](spark, str(folder)).collect()), key=repr), sorted(duck.execute(ORACLES[name]).fetchall(), key=repr)


@pytest.fixture
def full_days(spark, tmp_path):
    """Every subject has every priority on every day, so no month's cluster has an extent."""
    rows = [(k * 40 + i, k, float(100 + (i * 7 + k) % 13), dt.datetime(2024, 1, 1) + dt.timedelta(days=i // 5), f"{i % 5}") for k in range(8) for i in range(100)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    return tmp_path


def test_terrain_without_extent_has_no_height(spark, full_days):
    got, want = against_sql(spark, full_days, "terrain_height", "orders")
    assert got == want and len(got) == 441 and {r[2] for r in got} == {None}


def test_contours_without_a_height_have_no_threshold(spark, full_days):
    got, want = against_sql(spark, full_days, "contour_thresholds", "orders")
    assert got == want and [r[1] for r in got] == [None] * 9


def test_completeness_of_dense_days(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=10 * i), 5, "error", 60.0 + i * i % 17) for i in range(144)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got, want = against_sql(spark, tmp_path, "daily_features", "events")
    assert got == want and len(got) == 1


def test_one_file_a_kind_of_event_whatever_the_partitions(spark, tmp_path):
    kinds = ("view", "click", "purchase", "error", "signup")
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), i % 7, kinds[i % 5], float(i)) for i in range(5000)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    small = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1"}
    try:
        for name, value in small.items():
            spark.conf.set(name, value)
        got, want = against_sql(spark, tmp_path, "file_probe", "events")
    finally:
        for name in small:
            spark.conf.unset(name)
    assert got == want and len(got) == 5


def test_a_subjects_document_reads_kept_days(spark):
    """No part of the documents reads orders for itself."""
    plan = QUERIES["subject_payload"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "InMemoryRelation" in plan and "Relation [o_" not in plan


def test_mixtures_take_few_tasks_whatever_the_partitions(spark, monkeypatch):
    """All fits are of the same rows, in tasks of many rows, and give the same clusters in any session."""
    at = F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")).alias("date")
    rows = spark.range(3000).select(F.lit("a").alias("subject_id"), at, *[(F.pmod("id", F.lit(3)) + F.randn(k) / 3).alias(f"{a}_position") for k, a in enumerate(trajectory.AXIS_NAMES)]).localCheckpoint()
    fit, tasks, found = trajectory.GaussianMixture.fit, [], []
    monkeypatch.setattr(trajectory.GaussianMixture, "fit", lambda self, x: tasks.append(x.rdd.getNumPartitions()) or fit(self, x))
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (3, 7):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(trajectory.clusters(rows.repartition(n), most=3)[1])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert tasks == [1] * 4 and found[0] == found[1] and len(found[0]) == 3


def test_neighbours_and_maps_of_tasks_are_those_of_the_driver(spark, monkeypatch):
    """Exact neighbours with many copies and ties; beyond the driver's rows no map searches or pulls on the driver."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    x[:900], x[1000:1300, 0] = x[0], 0
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    near, dist = embedding.nearest(x, 90, spark=spark)
    assert np.allclose(dist, np.sort(d, axis=1)[:, :90]) and np.allclose(np.take_along_axis(d, near, axis=1), dist)
    assert all(len(set(r)) == 90 for r in near)
    assert np.allclose(embedding.tsne(x, steps=3, spark=spark), embedding.tsne(x, steps=3), atol=1e-12)
    assert np.allclose(embedding.neighbour_map(x[900:], epochs=3, spark=spark), embedding.neighbour_map(x[900:], epochs=3))
    asked = []
    monkeypatch.setattr(embedding, "ALONE", 100)
    for f in ("tsne", "neighbour_map"):
        monkeypatch.setattr(embedding, f, lambda x, seed, spark: asked.append(spark) or x[:, :2])
    for name in ("tsne_map", "umap_map"):
        assert QUERIES[name](spark, "/root/testdata/sf0.001").count() == 500
    assert asked == [spark, spark]


def test_neighbours_compare_a_small_part_of_all_pairs(monkeypatch):
    """Pairs compared grow with the points, not with their square."""
    met = []
    for n in (8000, 32_000):
        tree = embedding.leaves(np.random.default_rng(1).random((n, 2)))
        compared = []

        with monkeypatch.context() as m:
            m.setattr(np, "argpartition", lambda d, *a, whole=np.argpartition, seen=compared, **k: seen.append(d.size) or whole(d, *a, **k))
            for leaf in range(4):
                embedding.leaf_nearest(tree, leaf, 15)
        met.append(sum(compared))
    assert met[1] < 2 * met[0]


def test_moves_of_a_map_are_summed_by_row():
    rng = np.random.default_rng(2)
    at, moves, want = rng.integers(0, 50, 1000), rng.normal(size=(1000, 2)), np.zeros((60, 2))
    np.add.at(want, at, moves)
    assert np.allclose(embedding.added(at, moves, 60), want)
