"""Upserts, manifests and incremental rebuilds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .joins import diff
from .stats import hash_of_hashes


def upsert(old: DataFrame, new: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Rows of both, of each key (nulls are equal) the last by ``seq``; new rows come after old ones."""
    both = old.withColumn("is_new", F.lit(0)).unionByName(new.withColumn("is_new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.desc("is_new"), F.desc(seq))
    return both.withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth", "is_new")


def with_columns(df: DataFrame, schema) -> DataFrame:
    """``df`` with the columns of ``schema`` that it lacks, as nulls, in the schema's order."""
    return df.select(*[F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])


def manifest(files: DataFrame) -> DataFrame:
    """name, hash, file_count of each module of ``files`` (module, path, sha256)."""
    return hash_of_hashes(files).withColumnRenamed("module", "name")


def check(old: DataFrame, new: DataFrame, sample: int = 10) -> DataFrame:
    """status, n and the first names of each status of change."""
    d = diff(old, new)
    first = F.row_number().over(Window.partitionBy("status").orderBy("name"))
    names = d.withColumn("nth", first).filter(F.col("nth") <= sample).groupBy("status").agg(F.sort_array(F.collect_list("name")).alias("names"))
    return d.groupBy("status").agg(F.count(F.lit(1)).alias("n")).join(names, "status")


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    return diff(old, new).filter("status in ('added', 'modified')").select("name")


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """The manifest after an update: unchanged rows of the old one, modified and added ones of the new, without the removed."""
    d = diff(old, new).select("name", "status")
    keep = old.join(d.filter("status = 'unchanged'").select("name"), "name", "left_semi")
    return keep.unionByName(new.join(d.filter("status in ('added', 'modified')").select("name"), "name", "left_semi"))


def rebuild(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """Writes the partitions of the modules in ``rows`` anew, leaving others untouched."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("module").parquet(path)
