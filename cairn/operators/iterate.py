"""Tables written between the rounds of iterative operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; a local one only where that is unset, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "cairn-checkpoints")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/cairn-{uuid.uuid4().hex}"


#: Estimated input bytes that one task of ``dealt`` gets at most.
TASK_BYTES = 1 << 20


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of equal keys brought together in a number of tasks that grows with the input. AQE does not merge them: it goes by compressed bytes,
    of which narrow rows have so few that its 64 MB are gigabytes in a hash table."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # up to 200 files a task are written without sorting in memory, so more are taken only where tasks would be eight times as large
    n = max(spark.sparkContext.defaultParallelism, min(size // TASK_BYTES, 200), min(size // (8 * TASK_BYTES), 10_000))
    return df.repartition(n, *keys)


def materialize(df: DataFrame) -> DataFrame:
    """Written as Parquet and read again: the lineage is cut and no lost executor takes rows along."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
