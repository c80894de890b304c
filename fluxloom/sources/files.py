"""Sources and sinks: logger CSV, biomet CSV, plain datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DATE_LINE = r"^\d{4}-\d{2}-\d{2}"


def _text_csv(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.csv(path, schema=schema, header=False, mode="PERMISSIVE")


def _header(spark: SparkSession, path: str, line: int) -> list[str]:
    """Column names from a line of the first file; only a few lines reach the driver."""
    first = spark.read.text(path).limit(line + 1).collect()
    if len(first) <= line:
        raise ValueError(f"{path} has no header line {line + 1}")
    return [c.strip() for c in first[line]["value"].split(",")]


def read_flux_output(spark: SparkSession, path: str) -> DataFrame:
    """Logger output with group, header and units lines; all columns text, data lines only, of one or many files."""
    df = _text_csv(spark, path, _header(spark, path, 1))
    return df.where(F.col("date").rlike(DATE_LINE))


def read_biomet(spark: SparkSession, path: str) -> DataFrame:
    """Biomet file with header and units lines; all columns text, lines whose date parses."""
    df = _text_csv(spark, path, _header(spark, path, 0))
    return df.where(F.col("date").rlike(DATE_LINE))


def read_dataset(spark: SparkSession, path: str, fmt: str = "csv", keep: tuple[str, ...] = ("datetime", "date", "time", "filename", "site_id")) -> DataFrame:
    """A dataset with a header line (or Parquet); measurements become doubles, datetime a wall-clock timestamp."""
    if fmt == "parquet":
        return spark.read.parquet(path)
    df = spark.read.csv(path, header=True)
    df = df.select([F.col(f"`{c}`") if c in keep else F.col(f"`{c}`").try_cast("double").alias(c) for c in df.columns])
    return df.withColumn("datetime", F.try_to_timestamp("datetime").cast("timestamp_ntz")) if "datetime" in df.columns else df


def write_dataset(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = ()) -> None:
    """Overwrite a dataset, as Parquet partitioned by ``partition_by`` or as CSV with a header.

    Rows of one folder are brought together first, else each task writes a file into each folder; Spark divides a folder too large for a task.
    """
    together = df.hint("rebalance", *[F.col(f"`{c}`") for c in partition_by]) if partition_by else df
    writer = together.write.mode("overwrite")
    writer = writer.partitionBy(*partition_by) if partition_by else writer
    writer.csv(path, header=True) if fmt == "csv" else writer.parquet(path)
