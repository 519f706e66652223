"""Ordered and windowed operators over lines and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cairn.functions.expr import shorten


def lines(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, line_number from 1, line."""
    return df.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("pos", "line")).select(key, (F.col("pos") + 1).alias("line_number"), "line")


def with_context(ln: DataFrame, key: str, before: int = 5, after: int = 5, joiner: str = "\n") -> DataFrame:
    """Lines with the joined lines before and after them."""
    w = Window.partitionBy(key).orderBy("line_number")
    part = lambda a, b: F.array_join(F.collect_list("line").over(w.rowsBetween(a, b)), joiner)
    return ln.withColumn("context_before", part(-before, -1)).withColumn("context_after", part(1, after))


def first_of(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("nth = 1").drop("nth")


def body_end(ln: DataFrame, key: str, start: str = "start_line", cap: int = 500) -> DataFrame:
    """key, end_line: where the brace depth counted from ``start`` is back at 0 after an opening, within ``cap`` lines."""
    own = ln.filter((F.col("line_number") >= F.col(start)) & (F.col("line_number") < F.col(start) + cap))
    count = lambda c: F.length("line") - F.length(F.replace(F.col("line"), F.lit(c), F.lit("")))
    w = Window.partitionBy(key).orderBy("line_number").rowsBetween(Window.unboundedPreceding, 0)
    depth = own.withColumn("depth", F.sum(count("{") - count("}")).over(w)).withColumn("opened", F.sum(count("{")).over(w))
    return depth.groupBy(key).agg(F.coalesce(F.min(F.when((F.col("opened") > 0) & (F.col("depth") <= 0), F.col("line_number"))), F.max("line_number")).alias("end_line"))


def snippet(ln: DataFrame, spans: DataFrame, key: str, before: int = 6, after: int = 2, limit: int = 10_000) -> DataFrame:
    """key, code: lines from ``start_line - before`` to ``end_line + after``, cut at ``limit`` characters."""
    own = ln.join(spans, key).filter((F.col("line_number") >= F.col("start_line") - before) & (F.col("line_number") <= F.col("end_line") + after))
    parts = F.array_sort(F.collect_list(F.struct("line_number", "line")))
    return own.groupBy(key).agg(shorten(F.array_join(F.transform(parts, lambda x: x["line"]), "\n"), limit, "\n... (truncated)").alias("code"))


def numbered(df: DataFrame, order: list[str], name: str = "nth") -> DataFrame:
    """Row numbers from 0 in an order, without a window over all rows: rows of a range of the order are numbered in its task, after the rows of the ranges before."""
    from .iterate import materialize

    ranged = materialize(df.repartitionByRange(*order).withColumn("range_id", F.spark_partition_id()))
    sizes = ranged.groupBy("range_id").agg(F.count(F.lit(1)).alias("n"))  # a row for each partition
    starts = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    nth = F.row_number().over(Window.partitionBy("range_id").orderBy(*order)) - 1
    return ranged.withColumn("in_range", nth).join(F.broadcast(starts), "range_id").withColumn(name, F.col("before") + F.col("in_range")).drop("range_id", "in_range", "before")


def worker_of(df: DataFrame, order: list[str], workers: int) -> DataFrame:
    """Round-robin worker numbers in an order."""
    return numbered(df, order, "worker").withColumn("worker", F.pmod("worker", F.lit(workers)))


def merge_declarations(df: DataFrame, keys: list[str], order: str, fill: list[str], any_of: list[str]) -> DataFrame:
    """One row a key: of each column in ``fill`` the first value that is not empty, of each in ``any_of`` whether any is true."""
    value = lambda c: F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.col(c))
    return df.groupBy(*keys).agg(*[F.min_by(value(c), F.when(value(c).isNotNull(), F.col(order))).alias(c) for c in fill], *[F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in any_of])


def last_write(df: DataFrame, keys: list[str], order: str, merge: list[str]) -> DataFrame:
    """One row a key: of each column the last value that is not null."""
    return df.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in merge])
