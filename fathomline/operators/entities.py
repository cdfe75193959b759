"""Matching of entities by inverted names, and where lineage is cut."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions.names import inverted
from fathomline.operators.windows import best_per_key


def shared_checkpoints(spark: SparkSession) -> None:
    """Points checkpoints to the folder that ``spark.checkpoint.dir`` names; a temporary one for local sessions alone."""
    if spark.sparkContext.getCheckpointDir() is not None:
        return
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.setCheckpointDir(found)


def match_either_way(left: DataFrame, right: DataFrame, key: str, value: str, tie: str, out: str) -> DataFrame:
    """Right's ``value`` by name or by name with its first word last; of several the largest value, then the smallest ``tie``."""
    both = right.select(F.explode(F.array_distinct(F.array(F.col(key), inverted(F.col(key))))).alias(key), F.col(value).alias(out), F.col(tie).alias("_tie")).where(F.col(key) != "")
    best = best_per_key(both, [key], [F.col(out).desc_nulls_last(), F.col("_tie")]).drop("_tie")
    return left.join(best, key, "left")
