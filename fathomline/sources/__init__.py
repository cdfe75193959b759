"""Readers and writers."""

from __future__ import annotations

import json
import re
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StringType, StructField, StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether any file system that Spark reads has something at ``path``, which may be a glob."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all machines share (``spark.checkpoint.dir``)."""
    from fathomline.operators.entities import shared_checkpoints

    shared_checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def read_csv(spark: SparkSession, path: str, schema: StructType | str, columns: list[str] | None = None, day_format: str = "yyyy-MM-dd") -> DataFrame:
    """A CSV file with a header under ``schema``; only ``columns`` where given, and only those are parsed.

    A missing file is an empty table; text that isn't of its column's type, and NaN, is null.
    """
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    if not exists(spark, path):
        df = spark.createDataFrame([], schema)
    else:
        df = spark.read.schema(schema).csv(path, header=True, enforceSchema=False, nullValue="", dateFormat=day_format, mode="PERMISSIVE")
    df = df.select(*columns) if columns else df
    real = [f.name for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))]
    return df.withColumns({c: F.nanvl(c, F.lit(None)) for c in real}) if real else df


def read_strings(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All columns of a CSV file as strings, blanks around them gone, "" for missing values."""
    df = read_csv(spark, path, StructType([StructField(c, StringType()) for c in columns]))
    return df.select(*[F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in columns])


def snake(name: str) -> str:
    return re.sub(r"_+", "_", re.sub(r"[^0-9a-z]+", "_", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name).lower())).strip("_")


def read_parquet_tree(spark: SparkSession, path: str) -> DataFrame:
    """Files under ``key=value`` folders: partition columns, names in snake case, ``raw_file``, repeated rows of one file once. A missing path raises nothing but has no rows and no columns."""
    if not exists(spark, path):
        return spark.createDataFrame([], StructType([]))
    df = spark.read.option("mergeSchema", True).option("basePath", path.split("/*")[0].rstrip("/")).parquet(path)
    return df.select(*[F.col(f"`{c}`").alias(snake(c)) for c in df.columns], F.col("_metadata.file_path").alias("raw_file")).distinct()


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Replaces what is at ``path``. With ``by``, rows are dealt by those columns and a random part, so a large value is written by several tasks and no task opens all folders."""
    if not by:
        return df.write.mode("overwrite").parquet(path)
    spread = F.pmod(F.xxhash64(*df.columns), F.lit(8))
    return df.repartition(*by, spread).write.mode("overwrite").partitionBy(*by).parquet(path)


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV with a header; ``one_file`` is for small results, which one task then writes."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").csv(path, header=True)


def read_json(spark: SparkSession, path: str, schema: StructType | str, lines: bool = False) -> DataFrame:
    """JSON under ``schema``, a document or an array of them a file, or with ``lines`` a document a line; a missing file is an empty table."""
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    return spark.read.schema(schema).option("multiLine", not lines).json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def write_params(spark: SparkSession, params: dict, path: str) -> None:
    """A few parameters or figures as one JSON line."""
    spark.createDataFrame([(json.dumps(params, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_params(spark: SparkSession, path: str, default: dict | None = None) -> dict:
    if not exists(spark, path):
        return default or {}
    return json.loads("\n".join(r.value for r in spark.read.text(path).limit(10_000).collect()))


def chain(df: DataFrame, *steps) -> DataFrame:
    """The steps, functions from a DataFrame to a DataFrame, one after the other."""
    return reduce(lambda d, f: d.transform(f), steps, df)


def known_first(df: DataFrame, first: list[str]) -> DataFrame:
    """The columns of ``first`` that there are, in that order, then the rest."""
    own = [c for c in first if c in df.columns]
    return df.select(*own, *[c for c in df.columns if c not in own])


def filled(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Each named column with its default for null; columns that are missing are made of the default."""
    return df.withColumns({c: F.coalesce(F.col(c), d) if c in df.columns else d for c, d in defaults.items()})
