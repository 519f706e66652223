"""Aggregations; ties in top lists break by name, sums over nothing are 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cairn.functions.expr import or_empty


def known(category: str | Column) -> Column:
    """Null or empty as Unknown."""
    return F.coalesce(F.nullif(F.col(category) if isinstance(category, str) else category, F.lit("")), F.lit("Unknown"))


def _sum0(c: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("long")


def by_category(modules: DataFrame) -> DataFrame:
    """category, n_modules, files, lines by falling count, with grand totals in every row's last three columns."""
    by = modules.groupBy("category").agg(F.count(F.lit(1)).alias("n_modules"), _sum0("file_count").alias("files"), _sum0("estimated_lines").alias("lines"))
    total = by.agg(_sum0("n_modules").alias("total_modules"), _sum0("files").alias("total_files"), _sum0("lines").alias("total_lines"))
    return by.crossJoin(total).orderBy(F.desc("n_modules"), "category")  # one row on the right


def registry(modules: DataFrame) -> DataFrame:
    """category (Unknown for none), n_modules, last_indexed ('' for none)."""
    return modules.groupBy(known("category").alias("category")).agg(F.count(F.lit(1)).alias("n_modules"), F.coalesce(F.max("indexed_at"), F.lit("")).alias("last_indexed"))


def flag_counts(df: DataFrame, **flags: str) -> DataFrame:
    """total and a count for each flag column."""
    return df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(c)).alias(name) for name, c in flags.items()])


def top_modules(df: DataFrame, n: int = 10) -> DataFrame:
    return df.groupBy("module").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "module").limit(n)


def count_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(known(column).alias(column)).agg(F.count(F.lit(1)).alias("n"))


def graph_types(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind (node, edge), type, n."""
    n = nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(F.lit("node").alias("kind"), "type", "n")
    return n.unionByName(edges.groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("kind"), "type", "n"))


def coverage(modules: DataFrame, expected: int = 609, threshold: float = 90.0) -> DataFrame:
    """n_modules, coverage in per cent, passed, and counts of modules with dependencies, files, and neither."""
    deps, files = F.size(or_empty("dependencies")) > 0, F.coalesce("file_count", F.lit(0)) > 0
    out = modules.agg(F.count(F.lit(1)).alias("n_modules"), F.count_if(deps).alias("with_dependencies"), F.count_if(files).alias("with_files"), F.count_if(~deps & ~files).alias("orphans"))
    return out.withColumn("coverage", F.round(F.col("n_modules") * 100.0 / expected, 2)).withColumn("passed", F.col("coverage") >= threshold)


def merge_partitions(parts: DataFrame) -> DataFrame:
    """Totals over partition results (n_modules, categories) and their distinct categories."""
    cats = parts.select(F.explode("categories").alias("c")).agg(F.sort_array(F.collect_set("c")).alias("categories"))
    return parts.agg(_sum0("n_modules").alias("total")).crossJoin(cats)


def content_hash(files: DataFrame, key: str = "module", path: str = "path", text: str = "text") -> DataFrame:
    """SHA-256 of a module's files laid end to end, the descriptor first, then by path.

    Such a hash is a chain, so a module is read in one task, but as a sorted stream: no module lies in memory. See ``hash_of_hashes`` for one that is combined.
    """
    import hashlib

    import pyarrow as pa

    first = (~F.col(path).endswith(".Build.cs")).cast("int")
    rows = files.select(F.col(key).alias("k"), first.alias("o"), F.col(path).alias("p"), F.coalesce(text, F.lit("")).cast("binary").alias("t"))

    def run(batches):
        none = object()
        at, digest = none, None
        for rb in batches:
            out = []
            for i in range(rb.num_rows):
                k = rb.column(0)[i].as_py()
                if k != at or at is none:
                    if at is not none:
                        out.append((at, digest.hexdigest()))
                    at, digest = k, hashlib.sha256()
                digest.update(rb.column(3)[i].as_buffer())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], names=["k", "hash"])
        if at is not none:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.string()), pa.array([digest.hexdigest()])], names=["k", "hash"])

    out = rows.withColumn("k", F.col("k").cast("string")).repartition("k").sortWithinPartitions("k", "o", "p").mapInArrow(run, "k string, hash string")
    return out.select(F.col("k").cast(files.schema[key].dataType).alias(key), "hash")


def hash_of_hashes(files: DataFrame, key: str = "module", path: str = "path", digest: str = "sha256") -> DataFrame:
    """A module's hash from its files' paths and hashes alone: what change detection uses at scale."""
    parts = F.array_sort(F.collect_list(F.concat_ws(":", path, digest)))
    return files.groupBy(key).agg(F.sha2(F.array_join(parts, "\n"), 256).alias("hash"), F.count(F.lit(1)).alias("file_count"))


EXTENSIONS = ("h", "hpp", "cpp", "c", "cc", "inl")


def file_counts(files: DataFrame) -> DataFrame:
    """module, file_count, n_lines over source files (module, path, text)."""
    own = files.filter(F.lower(F.substring_index("path", ".", -1)).isin(*EXTENSIONS))
    return own.groupBy("module").agg(F.count(F.lit(1)).alias("file_count"), F.sum(F.size(F.split(F.coalesce("text", F.lit("")), "\n"))).cast("long").alias("n_lines"))


def estimated_lines(c: str = "file_count") -> Column:
    return F.coalesce(F.col(c), F.lit(0)) * 200


def run_totals(results: DataFrame, samples: int = 10) -> DataFrame:
    """Totals of classes, functions and enums over module results, number of failed modules and the first of them by name."""
    failed = results.filter("failed").select("module").orderBy("module").limit(samples).agg(F.sort_array(F.collect_list("module")).alias("failed_sample"))
    return results.agg(*[_sum0(c).alias(c) for c in ("n_classes", "n_functions", "n_enums")], F.count_if("failed").alias("n_failed")).crossJoin(failed)


def cache_stats(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count(F.lit(1)).alias("entries"), _sum0("access_count").alias("accesses"), F.round(F.coalesce(F.avg("access_count"), F.lit(0.0)), 4).alias("average"))


def budget_stats(uses: DataFrame) -> DataFrame:
    """category, used, budget and utilisation as text, with a row for the total."""
    by = uses.groupBy("category").agg(F.sum("used").alias("used"), F.max("budget").alias("budget"))
    all_ = by.agg(F.sum("used").alias("used"), F.sum("budget").alias("budget")).select(F.lit("total").alias("category"), "used", "budget")
    return by.unionByName(all_).withColumn("utilisation", F.format_string("%.1f%%", F.when(F.col("budget") > 0, F.col("used") * 100.0 / F.col("budget")).otherwise(F.lit(0.0))))
