"""Batch and streaming reads with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from tallyforge.sources.schemas import schema_of

CORRUPT = "_corrupt_record"


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    return spark.read.schema(schema_of(table)).parquet(path)


def parse_requests(raw: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """JSON request bodies as columns, in one pass.

    ``schema`` is the expected body as DDL. A body that is not valid JSON keeps its
    text in ``malformed`` and NULL in every field; ``malformed`` is NULL otherwise.
    """
    fields = T.StructType.fromDDL(f"{schema}, {CORRUPT} STRING")
    body = F.from_json(F.col(column), fields, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    bad = F.col(f"_body.{CORRUPT}").isNotNull() | F.col("_body").isNull()
    others = [c for c in raw.columns if c != column]
    return raw.withColumn("_body", body).select(
        *others,
        *[F.when(~bad, F.col(f"_body.{f.name}")).alias(f.name) for f in fields if f.name != CORRUPT],
        F.when(bad, F.col(column)).alias("malformed"),
    )


def stream_files(
    spark: SparkSession,
    path: str,
    schema: str,
    file_format: str = "parquet",
    files_per_batch: int | None = None,
) -> DataFrame:
    """A file-based event feed; a message-queue source takes the same place in production."""
    reader = spark.readStream.schema(schema).format(file_format)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", str(files_per_batch))
    return reader.load(path)
