"""Lookups, keyword search and flag filters over index tables, each with a total order before its limit.

Keywords match as plain substrings, case-folded by Unicode rules; ``%`` and ``_`` are no wildcards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cairn.functions.expr import or_empty


def contains_folded(c: Column | str, keyword: str) -> Column:
    return F.contains(F.lower(F.col(c) if isinstance(c, str) else c), F.lower(F.lit(keyword)))


def lookup(df: DataFrame, name: str, column: str = "name") -> DataFrame:
    return df.filter(F.col(column) == name)


def by_name(df: DataFrame, name: str, flag: str, module_hint: str | None = None) -> DataFrame:
    """Exact name, module containing the hint; flagged rows first, then by module."""
    out = lookup(df, name)
    if module_hint:
        out = out.filter(contains_folded("module", module_hint))
    return out.orderBy(F.desc(flag), "module", *[c for c in ("file_path", "line_number") if c in df.columns])


def by_keyword(df: DataFrame, keyword: str, flag: str | None = None, limit: int = 50, column: str = "name", ties: tuple[str, ...] = ()) -> DataFrame:
    order = ([F.desc(flag)] if flag else []) + [F.col(column), *map(F.col, ties)]
    return df.filter(contains_folded(column, keyword)).orderBy(*order).limit(limit)


def by_keyword_counted(df: DataFrame, keyword: str, limit: int = 50, column: str = "name", keep: tuple[str, ...] = ()) -> DataFrame:
    """The first rows of all hits, each with the number of all hits."""
    hits = df.filter(contains_folded(column, keyword)).select(column, *keep)
    return hits.orderBy(column, *keep).limit(limit).crossJoin(hits.agg(F.count(F.lit(1)).alias("n_hits")))  # one row on the right


def by_module(df: DataFrame, module: str) -> DataFrame:
    return df.filter(F.col("module") == module)


def subclasses(classes: DataFrame, parent: str, limit: int = 100) -> DataFrame:
    return classes.filter(F.array_contains("parent_classes", parent)).orderBy("name", "module", "line_number").limit(limit)


def by_value(enums: DataFrame, keyword: str, limit: int = 50) -> DataFrame:
    return enums.filter(F.exists("values", lambda v: contains_folded(v, keyword))).orderBy("name", "module").limit(limit)


def flagged(df: DataFrame, flag: str, limit: int = 100, order: tuple[str, ...] = ("name", "module")) -> DataFrame:
    return df.filter(F.col(flag)).orderBy(*order).limit(limit)


def by_category(modules: DataFrame, category: str, prefix: bool = False) -> DataFrame:
    return modules.filter(F.col("category").startswith(category) if prefix else F.col("category") == category)


CLASS_TYPES = {None: None, "uclass": "is_uclass", "struct": "is_struct", "interface": "is_interface"}


def module_classes(classes: DataFrame, module: str, kind: str | None = None, limit: int = 100) -> DataFrame:
    """A module's classes of one kind: the first rows, each with the total."""
    if kind not in CLASS_TYPES:
        raise ValueError(f"unknown class type {kind!r}")
    out = by_module(classes, module)
    if kind:
        out = out.filter(F.col(CLASS_TYPES[kind]))
    return out.orderBy("name", "line_number").limit(limit).crossJoin(out.agg(F.count(F.lit(1)).alias("n_total")))


def good_examples(examples: DataFrame, target: str, min_quality: float = 0.5, limit: int = 5) -> DataFrame:
    return examples.filter((F.col("target_name") == target) & (F.col("quality_score") >= min_quality)).orderBy(F.desc("quality_score"), F.desc("is_verified"), "source_file", "line_number").limit(limit)


def nodes_of_type(nodes: DataFrame, kind: str) -> DataFrame:
    return nodes.filter(F.col("type") == kind)


def exists(df: DataFrame, name: str) -> bool:
    return bool(lookup(df, name).limit(1).count())


def no_keywords(df: DataFrame, column: str, words: list[str], longer_than: int = 1) -> DataFrame:
    return df.filter(~F.col(column).isin(words) & (F.length(column) > longer_than))


def orphans(modules: DataFrame) -> DataFrame:
    return modules.filter((F.size(or_empty("dependencies")) == 0) & (F.coalesce("file_count", F.lit(0)) == 0))


def suggestions(df: DataFrame, keyword: str, limit: int = 10) -> DataFrame:
    return df.filter(contains_folded("name", keyword)).select("name").distinct().orderBy("name").limit(limit)
