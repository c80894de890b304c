"""The package on executors, whatever path the driver found it on, and tables in the folder that the cluster shares."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``. Where that is unset, a temporary one, if all tasks run on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    if "://" not in base and not base.startswith("file:"):
        base = f"file://{base}"
    return f"{base.rstrip('/')}/tables-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again: a cut of its lineage."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of a batch of rows between Spark and Python, in place of Spark's 64 MB: texts are long, and a task holds a few batches.
BATCH_BYTES = "4m"


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once per Spark context, as any Python job does with its code.

    Bounds the session's batches to BATCH_BYTES, unless a bound of the user's own is set.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").removesuffix("b") == str(64 << 20):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    context = spark.sparkContext
    if not getattr(context, "_fluxloom_shipped", False):
        root = Path(__file__).resolve().parent
        target = os.path.join(tempfile.mkdtemp(prefix="spark-"), "fluxloom.zip")
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, f"fluxloom/{p.relative_to(root)}")
        context.addPyFile(target)
        context._fluxloom_shipped = True
    return spark
