"""Change detection as a stream: new or rewritten source files are hashed as they arrive, and each batch is merged into the manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from cairn.operators.incremental import upsert
from cairn.operators.iterate import materialize
from cairn.sources.files import plain_path, stage

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def watch_files(spark: SparkSession, root: str, manifest: str, checkpoint: str, glob: str = "*.{h,cpp,inl}", once: bool = False) -> StreamingQuery:
    """Keeps ``manifest`` (path, sha256, size, seq) up to date with the files below ``root``; a replayed batch changes nothing."""
    files = spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    rows = files.select(plain_path().alias("path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), F.unix_micros("modificationTime").alias("seq"))

    def merge(batch: DataFrame, _: int) -> None:
        old = stage(batch.sparkSession, manifest)
        new = batch if old is None else upsert(old, batch, ["path"])
        materialize(new).write.mode("overwrite").parquet(manifest)

    w = rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
