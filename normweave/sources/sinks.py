"""Writers: quarantine, guarded replacement, operational stores, and the dashboard."""

from __future__ import annotations

import html
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .corpus import exists


def append_failures(failures: DataFrame, path: str) -> None:
    """One JSON line for each failed rule, with its stage; earlier lines stay."""
    failures.write.mode("append").json(path)


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def replace_table(df: DataFrame, path: str, check: Callable[[DataFrame], bool] | None = None, kind: str = "parquet") -> None:
    """Writes beside path, checks what was written, and only then puts it in path's place; else path stays as it was."""
    spark, mark = df.sparkSession, uuid.uuid4().hex
    staged, old = f"{path}.new-{mark}", f"{path}.old-{mark}"
    fs, to = _files(spark, path)
    staged_at, old_at = _files(spark, staged)[1], _files(spark, old)[1]
    df.write.format(kind).save(staged)
    if check is not None and not check(spark.read.format(kind).load(staged)):
        fs.delete(staged_at, True)
        raise ValueError(f"the check failed; {path} is unchanged")
    had = fs.exists(to)
    if had:
        fs.rename(to, old_at)
    if not fs.rename(staged_at, to):
        if had:
            fs.rename(old_at, to)
        raise OSError(f"could not replace {path}")
    if had:
        fs.delete(old_at, True)


def read_store(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """An operational table of JSON lines; empty if there is none. A corrupt one is copied aside and is an error, never overwritten."""
    if not exists(spark, path):
        return spark.createDataFrame([], ddl)
    rows = spark.read.schema(ddl + ", `_bad` string").option("columnNameOfCorruptRecord", "_bad").json(path).cache()
    if rows.where(F.col("_bad").isNotNull()).limit(1).count():
        fs, at = _files(spark, path)
        util = spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil
        util.copy(fs, at, fs, _files(spark, f"{path}.corrupt-{uuid.uuid4().hex[:8]}.bak")[1], False, spark.sparkContext._jsc.hadoopConfiguration())
        raise ValueError(f"{path} is corrupt; a copy was kept")
    return rows.drop("_bad")


def snapshot(listing: DataFrame, path: str) -> None:
    """The listing as it was posted, JSON lines of name, key, division and source_url, in place of the last one."""
    replace_table(listing.select("name", "key", "division", "source_url"), path, kind="json")


def dashboard(title: str, tables: dict[str, DataFrame], rows: int = 50) -> str:
    """One HTML page of small tables, at most `rows` rows of each; every cell is escaped."""
    parts = [f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]
    for name, df in tables.items():
        head = "".join(f"<th>{html.escape(c)}" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{html.escape('' if v is None else str(v))}" for v in r) for r in df.limit(rows).collect())
        parts.append(f"<h2>{html.escape(name)}</h2><table><tr>{head}{body}</table>")
    return "\n".join(parts)
