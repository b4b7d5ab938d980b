"""Exports and table writes. All writes are made by the tasks, none by the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T


def export_name(report: str, preset: str, extension: str) -> str:
    return f"admin_analytics_{report}_{preset}.{extension}"


def _flat(df: DataFrame) -> DataFrame:
    """CSV holds no nested values; they are written as JSON."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    return df.select(
        *[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema]
    )


def export_csv(sections: dict[str, DataFrame], folder: str, report: str, preset: str) -> dict[str, str]:
    """Every section of a report as CSV files with a header; returns the paths.

    NULL and empty text are both written as an empty field.
    """
    paths = {}
    for section, df in sections.items():
        path = f"{folder}/{export_name(report, preset, 'csv')}/{section}"
        _flat(df).write.mode("overwrite").options(header=True, emptyValue="").csv(path)
        paths[section] = path
    return paths


def export_json(sections: dict[str, DataFrame], folder: str, report: str, preset: str) -> dict[str, str]:
    """Every section as JSON lines; NULL fields are kept."""
    paths = {}
    for section, df in sections.items():
        path = f"{folder}/{export_name(report, preset, 'json')}/{section}"
        df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
        paths[section] = path
    return paths


def append_by_day(df: DataFrame, path: str, ts: str) -> None:
    """Append log rows below one folder per day.

    The rebalance keeps a day's rows together in few files and splits a busy day.
    """
    dated = df.withColumn("date", F.to_date(ts))
    dated.hint("rebalance", F.col("date")).write.mode("append").partitionBy("date").parquet(path)


def replace_days(df: DataFrame, path: str) -> None:
    """Replace the day folders that occur in ``df`` and leave the others alone."""
    df.hint("rebalance", F.col("date")).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("date").parquet(path)


def write_version(df: DataFrame, root: str, version: int) -> str:
    """Write a whole table under its version; writing the same version again replaces it."""
    path = f"{root}/v={version}"
    df.write.mode("overwrite").parquet(path)
    return path


def committed_versions(spark: SparkSession, root: str) -> list[int]:
    """Versions whose write was committed, oldest first."""
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{root}/v=*/_SUCCESS")
    files = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in files or [])


def drop_versions(spark: SparkSession, root: str, versions: list[int]) -> None:
    """Remove versions that no reader needs any more."""
    jvm = spark.sparkContext._jvm
    for version in versions:
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/v={version}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def keep_newest(spark: SparkSession, root: str, count: int = 2) -> None:
    """Drop all but the newest versions; two, so that a reader of the last but one can finish."""
    drop_versions(spark, root, committed_versions(spark, root)[:-count])


def latest_version(spark: SparkSession, root: str) -> int | None:
    return max(committed_versions(spark, root), default=None)


def read_version(spark: SparkSession, root: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{root}/v={version}")


def rebuild(df: DataFrame, root: str) -> DataFrame:
    """Truncate-and-rebuild: a new version beside the one still being read."""
    spark = df.sparkSession
    current = latest_version(spark, root)
    version = 0 if current is None else current + 1
    write_version(df, root, version)
    keep_newest(spark, root)
    return read_version(spark, root, version)
