"""Writing behind the gate: nothing is published while there are findings."""

from __future__ import annotations

import json
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession

from chronolith.functions import schema
from chronolith.operators import validate

PARTITIONS = ["subject_id", "source_format"]


class FindingsError(ValueError):
    """Validation found something."""

    def __init__(self, findings: list[tuple[str, str]]) -> None:
        super().__init__("; ".join(f"{c}: {d}" for c, d in findings))
        self.findings = findings


def _system(spark: SparkSession, path: str):
    """The path and its file system, whatever store it is in."""
    p = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def write_observations(df: DataFrame, path: str) -> None:
    """Canonical rows as Parquet by subject and format, replacing those partitions only.

    The input is computed once: rows are counted on their way into a hidden folder beside the data, the other checks read
    what was written there, and only then is each partition moved into its place. With a finding, or where a run is
    lost, readers see what was there before.
    """
    if df.columns != schema.COLUMNS:
        raise FindingsError([(r.check, r.detail) for r in validate.check(df).collect()])
    spark = df.sparkSession
    folder, _, name = str(path).rstrip("/").rpartition("/")
    staged = f"{folder}/_{name}-{uuid.uuid4().hex}" if folder else f"_{name}-{uuid.uuid4().hex}"
    at, system = _system(spark, staged)
    try:
        seen = Observation()
        df.observe(seen, *validate.measures()).write.partitionBy(*PARTITIONS).parquet(staged)
        rows = spark.read.schema(df.schema).parquet(staged).select(*schema.COLUMNS)
        findings = [(r.check, r.detail) for r in validate.check(rows, seen.get).collect()]
        if findings:
            raise FindingsError(findings)
        for outer in _folders(spark, system, at):
            for inner in _folders(spark, system, outer.getPath()):
                _publish(spark, system, inner.getPath(), f"{path}/{outer.getPath().getName()}", inner.getPath().getName())
    finally:
        system.delete(at, True)


def _folders(spark: SparkSession, system, at) -> list:
    return [f for f in system.listStatus(at) if f.isDirectory() and not f.getPath().getName().startswith("_")]


def _publish(spark: SparkSession, system, new, folder: str, name: str) -> None:
    """Move a partition into its place; the old one is set aside until the new one is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    place, aside = path(f"{folder}/{name}"), path(f"{folder}/_old-{uuid.uuid4().hex}")
    system.mkdirs(place.getParent())
    replaced = system.exists(place) and system.rename(place, aside)
    if not system.rename(new, place):
        if replaced:
            system.rename(aside, place)
        raise OSError(f"{place} could not be written")
    if replaced:
        system.delete(aside, True)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_text(spark: SparkSession, path: str | Path, text: str) -> None:
    """A small file in any store."""
    at, system = _system(spark, path)
    stream = system.create(at, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def write_report(report: dict, path: str | Path, spark: SparkSession | None = None) -> None:
    """A small report of aggregates."""
    write_text(spark or SparkSession.active(), path, json.dumps(report, indent=2, sort_keys=True, default=str))


def write_documents(df: DataFrame, path: str, key: str = "subject_id", text: str = "document") -> None:
    """One JSON document a key, each in its own folder ``key=...``."""
    df.select(key, text).write.mode("overwrite").partitionBy(key).text(path)


def write_stub(path: str | Path, section: str, keys: list[str], value: str = "", spark: SparkSession | None = None) -> bool:
    """A TOML stub for people to fill in; an existing file is never touched."""
    spark = spark or SparkSession.active()
    at, system = _system(spark, path)
    if system.exists(at):
        return False
    write_text(spark, path, f"[{section}]\n" + "".join(f"{json.dumps(k, ensure_ascii=False)} = {json.dumps(value)}\n" for k in keys))
    return True
