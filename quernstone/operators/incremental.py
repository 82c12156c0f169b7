"""Work only on files that changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def manifest(files: DataFrame, version: str) -> DataFrame:
    """(file, crc32, length, engine_version) of binary files."""
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), F.crc32("content").alias("crc32"), F.octet_length("content").cast("long").alias("length"), F.lit(version).alias("engine_version"))


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file, state): added, changed, deleted or unchanged; another engine version changes every file."""
    seal = lambda df, n: df.select("file", F.struct("crc32", "length", "engine_version").alias(n))
    state = F.when(F.col("was").isNull(), F.lit("added")).when(F.col("now").isNull(), F.lit("deleted")).when(F.col("was") != F.col("now"), F.lit("changed")).otherwise(F.lit("unchanged"))
    return seal(old, "was").join(seal(new, "now"), "file", "full").select("file", state.alias("state"))


def work_list(diff: DataFrame, failed: DataFrame) -> DataFrame:
    """Files that changed, were added, or failed last time and are still there."""
    present = diff.where("state <> 'deleted'").select("file")
    return diff.where("state in ('added', 'changed')").select("file").union(failed.select("file").join(present, "file", "left_semi")).distinct()


def merge_snapshots(cached: DataFrame, loaded: DataFrame, diff: DataFrame) -> DataFrame:
    """Rows of files that stayed, and all rows of the files worked on."""
    stale = diff.where("state <> 'unchanged'").select("file").union(loaded.select("file")).distinct()
    return cached.join(stale, "file", "left_anti").unionByName(loaded)


def missing(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def write_snapshot(df: DataFrame, path: str) -> None:
    """Replace the partitions (table, file) that ``df`` has, keep all others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("table", "file").parquet(path)


def read_snapshot(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows as they were written: names of tables and files are texts, whatever they look like."""
    return spark.read.schema(schema).parquet(path).select([f"`{c}`" for c in schema.names])


def refresh(spark: SparkSession, path: str, rows: DataFrame, work: DataFrame) -> DataFrame:
    """Recompute the snapshot of the files on the work list; the rest is read as it is."""
    write_snapshot(rows.join(work, "file", "left_semi"), path)
    return read_snapshot(spark, path, rows.schema)


def write_error_files(found: DataFrame, path: str) -> None:
    found.select("file").where("file is not null").distinct().write.mode("overwrite").json(path)
