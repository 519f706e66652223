"""The query commands over index tables, as DataFrames; ``run`` dispatches by name. Works on engine and plugin tables alike: what a table lacks, a command says."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from cairn.functions.expr import shorten
from cairn.operators import graph, joins, search, sequence, stats


@dataclass
class Index:
    """The tables of a knowledge base; those a build has not made are None."""

    modules: DataFrame
    classes: DataFrame
    functions: DataFrame
    enums: DataFrame | None = None
    examples: DataFrame | None = None
    files: DataFrame | None = None
    info: dict | None = None

    @classmethod
    def load(cls, spark: SparkSession, root: str) -> Index:
        from cairn.sources.files import stage

        read = lambda name: stage(spark, f"{root}/{name}")
        tables = {t: read(t) for t in ("modules", "classes", "functions", "enums", "examples", "files", "kb")}
        if tables["files"] is not None:
            tables["files"] = tables["files"].withColumnRenamed("path", "file_path")
        kb = tables.pop("kb")
        return cls(**tables, info={r.key: r.value for r in kb.collect()} if kb is not None else None)  # a handful of settings

    # -- classes

    def query_class_info(self, name: str) -> DataFrame:
        return self.classes.filter(F.col("name") == name).orderBy(F.desc("is_uclass"), "module", "line_number").limit(1)

    def query_class_hierarchy(self, name: str, depth: int = 3) -> DataFrame:
        """start, level, name, module of the class and its first parents."""
        up = self.classes.select(F.col("name").alias("child"), F.try_element_at("parent_classes", F.lit(1)).alias("parent"))
        start = self.classes.filter(F.col("name") == name).select("name").limit(1)
        where = self.classes.groupBy("name").agg(F.min("module").alias("module"))
        return graph.hierarchy(up, start, depth).join(where, "name", "left").select("start", "level", "name", "module")

    def query_subclasses(self, parent: str, limit: int = 100) -> DataFrame:
        return search.subclasses(self.classes, parent, limit)

    def search_classes(self, keyword: str, limit: int = 50) -> DataFrame:
        return search.by_keyword(self.classes, keyword, "is_uclass", limit, ties=("module", "line_number"))

    # -- modules

    def query_module_dependencies(self, name: str) -> DataFrame:
        """The module's lists; if it is unknown, rows with suggestions in ``suggestion``."""
        found = search.lookup(self.modules, name).select("name", "category", "dependencies").withColumn("suggestion", F.lit(None).cast("string"))
        if found.limit(1).count():
            return found
        near = search.suggestions(self.modules, name)
        return near.select(F.lit(name).alias("name"), F.lit(None).cast("string").alias("category"), F.array().cast("array<string>").alias("dependencies"), F.col("name").alias("suggestion"))

    def query_module_classes(self, module: str, kind: str | None = None, limit: int = 100) -> DataFrame:
        return search.module_classes(self.classes, module, kind, limit)

    def query_module_dependents(self, name: str) -> DataFrame:
        return joins.dependents_of_any_kind(self.modules, name)

    def search_modules(self, keyword: str) -> DataFrame:
        return search.by_keyword_counted(self.modules, keyword, keep=("category", "path"))

    def get_statistics(self) -> DataFrame:
        return stats.count_by(self.modules, "category")

    # -- functions

    def query_function_info(self, name: str, module_hint: str | None = None, limit: int = 20) -> DataFrame:
        return search.by_name(self.functions, name, "is_blueprint_callable", module_hint).limit(limit)

    def search_functions(self, keyword: str, limit: int = 50) -> DataFrame:
        return search.by_keyword(self.functions, keyword, "is_blueprint_callable", limit, ties=("module", "file_path", "line_number"))

    def get_function_implementation(self, name: str, class_name: str | None = None, module_hint: str | None = None) -> DataFrame:
        """name, file_path, start_line, end_line, code of the first definition found in the files' text."""
        f = self.query_function_info(name, module_hint)
        if class_name:
            f = f.filter(F.col("class_name") == class_name)
        ln = sequence.lines(self.files.join(f.select("module").distinct(), "module", "left_semi"), "file_path").withColumnRenamed("file_path", "file")
        names = ln.select(F.lit(name).alias("name"), "file").distinct()
        hit = joins.definition_lines(names, ln).filter("line_number > 0").orderBy("file").limit(1).select("file", F.col("line_number").alias("start_line"))
        body = ln.join(hit, "file")
        spans = hit.join(sequence.body_end(body, "file"), "file")
        return sequence.snippet(ln, spans, "file").join(spans, "file").select(F.lit(name).alias("name"), F.col("file").alias("file_path"), "start_line", "end_line", shorten("code", 10_000).alias("code"))

    # -- enums and examples

    def _need(self, table: str) -> DataFrame:
        df = getattr(self, table)
        if df is None:
            raise LookupError(f"this knowledge base has no {table}")
        return df

    def query_enum_info(self, name: str, module_hint: str | None = None) -> DataFrame:
        return search.by_name(self._need("enums"), name, "is_uenum", module_hint).limit(20)

    def search_enums(self, keyword: str, limit: int = 50) -> DataFrame:
        return search.by_keyword(self._need("enums"), keyword, "is_uenum", limit, ties=("module",))

    def query_examples(self, target: str, limit: int = 5) -> DataFrame:
        return search.good_examples(self._need("examples"), target, limit=limit)

    def get_kb_info(self) -> dict:
        return dict(self.info or {})

    # -- routing

    TOPICS = {"overview": "get_statistics", "statistic": "get_statistics", "how many": "get_statistics"}

    def route(self, question: str) -> tuple[str, list[str]]:
        """Command and arguments for a question in words: a fixed topic, else dependencies of a named module, else a search by its words."""
        low = question.lower()
        for words, command in self.TOPICS.items():
            if words in low:
                return command, []
        import re

        names = re.findall(r"\b[A-Z]\w{2,}\b", question)
        if "depend" in low and names:
            return ("query_module_dependents" if "on " + names[-1].lower() in low or "uses" in low else "query_module_dependencies"), [names[-1]]
        words = names or [w for w in re.findall(r"\w{3,}", low)]
        return "search_modules", words[-1:] or [""]

    def ask(self, question: str) -> DataFrame:
        command, args = self.route(question)
        return getattr(self, command)(*args)

    COMMANDS = ("query_class_info", "query_class_hierarchy", "query_module_dependencies", "query_module_classes", "query_function_info", "get_function_implementation", "search_functions", "search_classes", "search_modules", "query_subclasses", "query_module_dependents", "query_enum_info", "search_enums", "query_examples", "get_statistics", "get_kb_info", "ask")

    def run(self, command: str, *args) -> str:
        """A command's answer as JSON; an unknown command or a missing table as an error."""
        if command not in self.COMMANDS:
            return json.dumps({"error": f"unknown command {command}", "commands": list(self.COMMANDS)})
        try:
            out = getattr(self, command)(*args)
        except LookupError as e:
            return json.dumps({"error": str(e)})
        rows = out if isinstance(out, dict) else [json.loads(x) for x in out.toJSON().collect()]  # every command's answer is bounded by its limit
        if rows == [] and args:
            return json.dumps({"error": f"nothing found for {args[0]}", "fallback_command": f"search_classes {str(args[0])[:8]}"})
        return json.dumps(rows, default=str)


def plugin_index(index: Index) -> Index:
    """A plugin's knowledge base has no enums and no examples."""
    return Index(index.modules, index.classes, index.functions, files=index.files, info=(index.info or {}) | {"mode": "plugin"})
