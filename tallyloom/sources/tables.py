"""Readers and writers: Parquet, CSV seeds, JSON artifacts, YAML settings, and result tables."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

#: The driver's tables.
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> None:
    """Temporary views of a folder's tables, for SQL text."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def query(spark: SparkSession, sql: str, params: dict[str, Any] | list[Any] | None = None) -> DataFrame:
    """SQL with bound parameters (:name, or ? with a list); values never become SQL text."""
    return spark.sql(sql, args=params) if params else spark.sql(sql)


def csv_seed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header and a declared schema; a row that doesn't fit it fails the read."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)


def json_artifact(path: str | Path) -> Any:
    return json.loads(Path(path).read_text())


def json_rows(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def yaml_settings(path: str | Path) -> Any:
    import yaml

    return yaml.safe_load(Path(path).read_text())


def save(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Replaces a Parquet table."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def materialise(df: DataFrame, layer: str, name: str) -> DataFrame:
    """Writes a model as a managed table of its layer's schema and returns it."""
    spark = df.sparkSession
    spark.sql(f"create schema if not exists `{layer}`")
    df.write.mode("overwrite").saveAsTable(f"`{layer}`.`{name}`")
    return spark.table(f"`{layer}`.`{name}`")


def work_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, under spark.checkpoint.dir; a temporary
    one where that is unset and the session is a single process, as in tests."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return f"{base.rstrip('/')}/tallyloom-{uuid.uuid4().hex}"
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + tempfile.mkdtemp(prefix="tallyloom-")
