"""Source trees as DataFrames. Readers list and read on the executors; predicates on paths come before any parsing. Files without a byte are not read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cairn.functions import expr as X

DESCRIPTOR = "*.Build.cs"
SOURCES = "*.{h,cpp}"
HASHED = "*.{h,cpp,inl}"


def _binary(spark: SparkSession, paths: list[str] | str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(paths)


def _text(c: str = "content") -> Column:
    """The bytes as UTF-8, without those that are none."""
    return F.translate(F.make_valid_utf8(F.col(c).cast("string")), "\ufffd", "")


def plain_path(c: str = "path") -> Column:
    """Without the scheme."""
    return F.regexp_replace(c, "^[a-z]+:/*(?=/)", "")


def descriptors(spark: SparkSession, root: str, roots: list[str] | None = None) -> DataFrame:
    """name, category, path (relative), absolute_path, file_hash, file_size, file_mtime of every build descriptor below, by name."""
    f = _binary(spark, roots or root, DESCRIPTOR)
    absolute = plain_path()
    relative = F.regexp_replace(absolute, "^" + _quoted(root) + "/?", "")
    out = f.select(X.module_name("path").alias("name"), X.category_of_path(relative).alias("category"), X.dirname(relative).alias("path"), X.dirname(absolute).alias("absolute_path"), F.sha2("content", 256).alias("file_hash"), F.col("length").alias("file_size"), F.col("modificationTime").alias("file_mtime"), _text().alias("text"))
    return out.orderBy("name", "path")


def _quoted(path: str) -> str:
    import re

    return re.escape(re.sub("^[a-z]+:/*(?=/)", "", path).rstrip("/"))


def engine_descriptors(spark: SparkSession, root: str) -> DataFrame:
    """The whole-tree scan restricted to Source, Plugins and Platforms, those that exist."""
    from . import storage

    roots = [p for p in (f"{root.rstrip('/')}/{x}" for x in ("Source", "Plugins", "Platforms")) if storage.exists(spark, p)]
    return descriptors(spark, root, roots)


def plugin_descriptors(spark: SparkSession, root: str) -> DataFrame:
    return descriptors(spark, root, [f"{root.rstrip('/')}/Source"])


def category_modules(found: DataFrame) -> DataFrame:
    """One-level scan: a folder counts only if it holds the descriptor of its own name."""
    return found.filter(F.col("name") == X.basename("absolute_path"))


def core_modules(found: DataFrame, core: list[str]) -> DataFrame:
    """The first match, by path, of each configured module."""
    from cairn.operators.sequence import first_of

    return first_of(found.filter(F.col("name").isin(core)), ["name"], ["path"])


def not_generated(path: str = "path") -> Column:
    return ~F.col(path).rlike("(^|/)(Intermediate|Saved|Binaries)/")


def sources(spark: SparkSession, roots: list[str] | str, glob: str = SOURCES, pruned: bool = True) -> DataFrame:
    """path and text of source files, generated folders left out if ``pruned``. Undecodable bytes are dropped."""
    f = _binary(spark, roots, glob)
    f = f.filter(not_generated()) if pruned else f
    return f.select(plain_path().alias("path"), _text().alias("text"))


def test_sources(spark: SparkSession, roots: list[str] | str) -> DataFrame:
    return sources(spark, roots, "*Test*.cpp")


def hashed_files(spark: SparkSession, roots: list[str] | str, glob: str = HASHED) -> DataFrame:
    """path, sha256, size, mtime."""
    return _binary(spark, roots, glob).select(plain_path().alias("path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def with_module(files: DataFrame, found: DataFrame) -> DataFrame:
    """Files with the module whose folder holds them, the deepest one: an equi-join on every ancestor folder."""
    parts = F.split(X.dirname("path"), "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    above = files.withColumn("folder", F.explode(ups)).join(found.select(F.col("name").alias("module"), F.col("absolute_path").alias("folder")), "folder")
    deepest = above.groupBy("path").agg(F.max_by("module", F.length("folder")).alias("module"))
    return files.join(deepest, "path")


def metadata_map(kv: DataFrame) -> DataFrame:
    """m: the key-value table as one map."""
    return kv.agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("m"))


def stage(spark: SparkSession, path: str) -> DataFrame | None:
    """A stage's table, or None where it was not written. The schema beside it, if any, is the table's."""
    import json

    from pyspark.sql.types import StructType

    from . import storage

    if not storage.exists(spark, f"{path}/_SUCCESS"):
        return None
    known = f"{path}/_schema.json"
    reader = spark.read.schema(StructType.fromJson(json.loads(storage.read_text(spark, known)))) if storage.exists(spark, known) else spark.read
    return reader.parquet(path)


LEGACY = "name string, category string, path string, absolute_path string, build_cs_path string, dependencies array<string>, file_count long, estimated_lines long, indexed_at string"


def legacy_registry(spark: SparkSession, path: str) -> DataFrame:
    """Modules of an old registry file, a JSON object of records by name; fields that a record lacks are null, null lists empty.

    The old format also came as a pickle; unpickling runs code of the file's author, so those must be exported as JSON.
    """
    m = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,struct<{', '.join(c.strip().replace(' ', ':', 1) for c in LEGACY.split(','))}>>").alias("m"))
    rows = m.select(F.explode("m").alias("key", "r"))
    return rows.select(F.coalesce("r.name", "key").alias("name"), *[F.col(f"r.{c.split()[0]}") if not c.strip().startswith("dependencies") else F.coalesce("r.dependencies", F.array().cast("array<string>")).alias("dependencies") for c in LEGACY.split(", ")[1:]])


def import_legacy(spark: SparkSession, path: str, current: DataFrame | None) -> DataFrame:
    """The old registry's modules upserted by name under the current ones: a module that is there already keeps its row. An import that has been made stays as it is."""
    old = legacy_registry(spark, path)
    if current is None:
        return old
    return current.select(*old.columns).unionByName(old.join(current.select("name"), "name", "left_anti"))
