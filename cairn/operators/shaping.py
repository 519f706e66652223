"""Bounded answers: summary, detail and source levels, masks with references, token budgets, a result cache."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from cairn.functions.expr import or_empty, shorten, stable_ref, token_estimate

LEVELS = {"summary": 200, "details": 1000, "source": 5000}


def class_summary(classes: DataFrame, n_methods: int = 5) -> DataFrame:
    """name, module, parent, method_count, methods (the first ones), ref."""
    return classes.select("name", "module", F.try_element_at(or_empty("parent_classes"), F.lit(1)).alias("parent"), F.size(or_empty("methods")).alias("method_count"), F.slice(or_empty("methods"), 1, n_methods).alias("methods"), stable_ref(F.concat_ws("::", F.lit("class"), "module", "name")).alias("ref"))


def class_details(classes: DataFrame, key: str) -> DataFrame:
    """All columns of a class, by its name or its reference."""
    ref = stable_ref(F.concat_ws("::", F.lit("class"), "module", "name"))
    return classes.filter(ref == key if key.startswith("ref_") else F.col("name") == key)


def class_source(classes: DataFrame, files: DataFrame, key: str, limit: int = 10_000) -> DataFrame:
    """name, file_path and the text of its file, cut at ``limit`` characters."""
    return class_details(classes, key).join(files, "file_path").select("name", "file_path", shorten("text", limit, "\n... (truncated)").alias("source"))


def query_class(classes: DataFrame, files: DataFrame, key: str, level: str = "summary") -> DataFrame:
    if level not in LEVELS:
        raise ValueError(f"unknown detail level {level!r}")
    if level == "summary":
        return class_summary(class_details(classes, key))
    return class_details(classes, key) if level == "details" else class_source(classes, files, key)


def function_summary(functions: DataFrame, order: list[str]) -> DataFrame:
    """The first match of each name, with the number of matches."""
    w = Window.partitionBy("name")
    return functions.withColumn("n_matches", F.count(F.lit(1)).over(w)).withColumn("nth", F.row_number().over(w.orderBy(*order))).filter("nth = 1").drop("nth")


def function_details(functions: DataFrame) -> DataFrame:
    return functions.select("name", "module", "class_name", "return_type", F.concat_ws(":", "file_path", F.col("line_number").cast("string")).alias("location"))


def mask(df: DataFrame, order: list[str], threshold: int = 5) -> DataFrame:
    """The first rows, each with the number of all and whether some are masked."""
    n = df.agg(F.count(F.lit(1)).alias("n_total"))
    return df.orderBy(*order).limit(threshold).crossJoin(n).withColumn("masked", F.col("n_total") > threshold)


KEY_FIELDS = ("name", "module", "signature", "type")


def key_fields(df: DataFrame) -> DataFrame:
    """Only the key fields that there are."""
    return df.select(*[c for c in KEY_FIELDS if c in df.columns])


def summary_of(c: str, limit: int = 100) -> Column:
    return shorten(c, limit, "...")


def greedy_budget(df: DataFrame, group: str, order: str, cost: str, budget: int) -> DataFrame:
    """group, used, n_allowed: in order, each item that still fits is allowed; a refused one uses nothing."""
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(cost).cast("long").alias("c"))))
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("n"))
    fits = lambda a, x: a["used"] + x["c"] <= budget
    fold = F.aggregate(items, zero, lambda a, x: F.when(fits(a, x), F.struct((a["used"] + x["c"]).alias("used"), (a["n"] + 1).alias("n"))).otherwise(a))
    return df.groupBy(group).agg(fold.alias("r")).select(group, F.col("r.used").alias("used"), F.col("r.n").alias("n_allowed"))


class TokenBudget:
    """Budgets by category on the driver: ``allocate`` refuses what does not fit and marks the category."""

    DEFAULT = {"class": 3000, "function": 2000, "module": 2000, "search": 2000, "other": 1000}

    def __init__(self, budgets: dict[str, int] | None = None):
        self.budgets, self.used, self.triggered = dict(budgets or self.DEFAULT), {}, set()

    def allocate(self, category: str, tokens: int) -> bool:
        if self.used.get(category, 0) + tokens > self.budgets.get(category, 0):
            self.triggered.add(category)
            return False
        self.used[category] = self.used.get(category, 0) + tokens
        return True

    def utilisation(self, category: str) -> float:
        b = self.budgets.get(category, 0)
        return self.used.get(category, 0) / b if b > 0 else 0.0

    def is_over(self, category: str, threshold: float = 0.8) -> bool:
        return self.utilisation(category) >= threshold

    def remaining(self, category: str) -> int:
        return self.budgets.get(category, 0) - self.used.get(category, 0)

    def reset(self, category: str | None = None) -> None:
        for c in [category] if category else list(self.used):
            self.used.pop(c, None)
            self.triggered.discard(c)

    def statistics(self) -> dict[str, dict]:
        out = {c: {"used": self.used.get(c, 0), "budget": b, "utilisation": f"{100 * self.utilisation(c):.1f}%"} for c, b in self.budgets.items()}
        total, used = sum(self.budgets.values()), sum(self.used.values())
        return out | {"total": {"used": used, "budget": total, "utilisation": f"{100 * used / total if total else 0:.1f}%"}}

    def optimise(self, df: DataFrame, category: str, order: list[str], sample: int = 3) -> DataFrame:
        """The rows if their token estimate fits the budget, else the first ``sample`` by their key fields with the total."""
        tokens = df.agg(F.coalesce(F.sum(token_estimate(*df.columns)), F.lit(0))).first()[0]
        if self.allocate(category, int(tokens)):
            return df
        keep = [c for c in KEY_FIELDS if c in df.columns] or df.columns
        return mask(df, order, sample).select(*keep, "n_total")


class ResultCache:
    """Results by reference on the driver, with a time to live and access counts. A result is a DataFrame, held by its plan, or any value."""

    def __init__(self, ttl_seconds: float = 3600, clock: Callable[[], float] = time.time):
        self.ttl, self.clock, self.entries = ttl_seconds, clock, {}

    def store(self, result, summary=None) -> str:
        ref = f"ref_{uuid.uuid4().hex[:8]}"
        self.entries[ref] = {"result": result, "summary": summary if summary is not None else self.summarise(result), "created": self.clock(), "accesses": 0}
        return ref

    def _live(self, ref: str) -> dict | None:
        e = self.entries.get(ref)
        if e and self.clock() - e["created"] > self.ttl:
            del self.entries[ref]
            return None
        return e

    def retrieve(self, ref: str):
        if e := self._live(ref):
            e["accesses"] += 1
            return e["result"]
        return None

    def summary(self, ref: str):
        e = self._live(ref)
        return e and e["summary"]

    @staticmethod
    def summarise(result):
        """Of rows: columns and three of them; of a list its length and three items; of a dict ten keys; else 100 characters."""
        if isinstance(result, DataFrame):
            return {"columns": result.columns, "sample": [r.asDict() for r in result.take(3)]}
        if isinstance(result, list):
            return {"count": len(result), "sample": result[:3]}
        if isinstance(result, dict):
            return {"keys": list(result)[:10]}
        return str(result)[:100]

    def mask(self, result, threshold: int = 5, max_tokens: int = 1000):
        """A long list as a sample and a reference, a large dict by its first keys and a reference; anything else as it is."""
        if isinstance(result, list) and len(result) > threshold:
            return {"sample": result[:threshold], "total": len(result), "ref": self.store(result)}
        if isinstance(result, dict) and len(json.dumps(result, default=str)) // 4 > max_tokens:
            return {"keys": list(result)[:10], "ref": self.store(result)}
        return result

    def cleanup_expired(self) -> int:
        old = [r for r, e in self.entries.items() if self.clock() - e["created"] > self.ttl]
        for r in old:
            del self.entries[r]
        return len(old)

    def clear(self) -> None:
        self.entries.clear()

    def statistics(self) -> dict:
        n, a = len(self.entries), sum(e["accesses"] for e in self.entries.values())
        return {"entries": n, "accesses": a, "average": a / n if n else 0}
