"""Helpers on DataFrames."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def number(df: DataFrame, order: list[Column], name: str = "pos") -> DataFrame:
    """df with a gapless number from 0 in a stated order, without sending all rows to one task.

    Rows are range-partitioned by the order, counted by partition, and numbered inside partitions; the
    partitions' counts, a row each, are all that is summed in one place. The order must be total
    (or ties interchangeable).
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = ordered.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__row"))
    ordered = ordered.persist()
    sizes = ordered.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("__part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__first"))
    # The row number inside a partition is in the low 33 bits.
    inside = F.col("__row").bitwiseAND((1 << 33) - 1)
    return ordered.join(F.broadcast(sizes), "__part").withColumn(name, (F.col("__first") + inside).cast("long")).drop("__part", "__row", "__first")


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key, the first in the order; null keys are keys. Aggregates before it shuffles."""
    columns = df.columns
    first = F.min_by(F.struct(*columns), F.struct(*order))
    return df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(first.alias("__row")).select("__row.*").select(*columns)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it; where none is named, a temporary one, but only in local mode."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        named = context.getCheckpointDir()
    elif context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    if named is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="normweave-checkpoint-")
        context.setCheckpointDir(named)
    return named


def settled(df: DataFrame) -> DataFrame:
    """The same rows, made once and without the plan that made them; for small tables that several branches of a plan read.

    A cached table won't do: each scan of it is planned and logged with all that is below it, so branches of
    branches multiply. Where no shared folder is named it has to.
    """
    try:
        shared_dir(df.sparkSession)
    except ValueError:
        return df.persist()
    return df.checkpoint(eager=True)
