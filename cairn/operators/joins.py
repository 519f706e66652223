"""The engine's joins. Sides are left to Catalyst; nothing is broadcast by hand."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from cairn.functions.expr import basename, col, dirname, normal_path, or_empty, stem, union_sorted

from .iterate import dealt

KINDS = ("public", "private", "dynamic", "weak", "circular")


def with_dependencies(modules: DataFrame, deps: DataFrame) -> DataFrame:
    """Modules with the five lists of ``deps`` (name, public_dependencies, ..), empty where there are none, and their union."""
    cols = [f"{k}_dependencies" for k in KINDS]
    out = modules.join(deps.select("name", *cols), "name", "left").select(*modules.columns, *[or_empty(c).alias(c) for c in cols])
    return out.withColumn("dependencies", union_sorted(*cols))


def dependency_edges(modules: DataFrame) -> DataFrame:
    """src, dst of each dependency that is itself a known module."""
    edges = modules.select(F.col("name").alias("src"), F.explode(or_empty("dependencies")).alias("dst")).distinct()
    return edges.join(modules.select(F.col("name").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")


def dependents(modules: DataFrame, name: str) -> DataFrame:
    return modules.filter(F.array_contains(or_empty("dependencies"), name))


def dependents_of_any_kind(modules: DataFrame, name: str, limit: int = 200) -> DataFrame:
    return modules.filter(F.array_contains(union_sorted("dependencies", "public_dependencies", "private_dependencies"), name)).select("name", "category").orderBy("name").limit(limit)


def diff(old: DataFrame, new: DataFrame, key: str = "name", value: str = "hash") -> DataFrame:
    """key, old and new value, status (added, removed, modified, unchanged)."""
    o, n = old.select(F.col(key).alias("k"), F.col(value).alias("old_value")), new.select(F.col(key).alias("j"), F.col(value).alias("new_value"))
    both = o.join(n, F.col("k") == F.col("j"), "full_outer")
    status = F.when(F.col("k").isNull(), "added").when(F.col("j").isNull(), "removed").when(~F.col("old_value").eqNullSafe(F.col("new_value")), "modified").otherwise("unchanged")
    return both.select(F.coalesce("k", "j").alias(key), "old_value", "new_value", status.alias("status"))


def still_to_do(work: DataFrame, done: DataFrame, key: str = "name") -> DataFrame:
    return work.join(done.select(key).distinct(), key, "left_anti")


def missing(expected: DataFrame, present: DataFrame, key: str = "name") -> DataFrame:
    return still_to_do(expected.select(key), present, key)


def resolve_includes(includes: DataFrame, headers: DataFrame, max_basename: int | None = None) -> DataFrame:
    """cpp, include, header, strategy: relative to the including file; in Public, Private, Classes or the root of its module; else by base name,
    a header whose path ends in the include before others, then the first by path. ``includes``: module_root, cpp, include."""
    inc = includes.select("module_root", "cpp", "include").distinct()
    head = headers.select(F.col("path").alias("header")).distinct()
    roots = F.array(*[F.struct(F.lit(p).alias("priority"), F.lit(s).alias("sub")) for p, s in ((2, "Public/"), (3, "Private/"), (4, "Classes/"), (5, ""))])
    near = inc.select("cpp", "include", F.lit(1).alias("priority"), normal_path(F.concat_ws("/", dirname("cpp"), F.col("include"))).alias("header"))
    rooted = inc.withColumn("r", F.explode(roots)).select("cpp", "include", F.col("r.priority").alias("priority"), normal_path(F.concat(F.col("module_root"), F.lit("/"), F.col("r.sub"), F.col("include"))).alias("header"))
    exact = near.unionByName(rooted).join(head, "header")
    # by base name: a best header for each include as it is written, however many files hold it
    other = inc.select("include").distinct().withColumn("base", basename("include")).join(head.withColumn("base", basename("header")), "base")
    other = other.groupBy("include").agg(F.min(F.struct(F.when(F.col("header").contains(F.col("include")), 6).otherwise(7).alias("priority"), "header")).alias("b"))
    named = inc.select("cpp", "include").distinct().join(other, "include").select("cpp", "include", "b.priority", "b.header")
    best = F.row_number().over(Window.partitionBy("cpp", "include").orderBy("priority", "header"))
    strategy = F.when(F.col("priority") == 1, "relative").when(F.col("priority") <= 5, "module").otherwise("basename")
    return exact.select(*named.columns).unionByName(named).withColumn("nth", best).filter("nth = 1").select("cpp", "include", "header", strategy.alias("strategy"))


def sources_of_headers(resolved: DataFrame) -> DataFrame:
    """header, cpps (sorted)."""
    return resolved.groupBy("header").agg(F.sort_array(F.collect_set("cpp")).alias("cpps"))


def implementation_file(declarations: DataFrame, sources: DataFrame) -> DataFrame:
    """name, header, cpp: of a header's sources (header, cpp) the one with the same stem, else the first by path."""
    same = stem("header") == stem("cpp")
    rank = F.when(same, 0).when(~same, 1).otherwise(2)
    # the choice hangs on the header alone, so each header's sources are looked through once, in tasks that grow with the input
    best = dealt(sources.select("header", "cpp"), "header").groupBy("header").agg(F.min(F.struct(rank.alias("rank"), "cpp")).alias("b"))
    return declarations.select("name", "header").distinct().join(best, "header").select("name", "header", "b.cpp")


def definition_lines(functions: DataFrame, lines: DataFrame) -> DataFrame:
    """name, file, line of the first line in its file that defines a function (``name(`` after a word, not ended by ``;``); 0 if none does."""
    own = functions.select("name", "file").distinct()
    plain = F.col("name").rlike(r"^\w+$")
    # a plain name meets the lines that have it before a bracket; only operators and the like meet every line of their file
    called = lines.withColumn("name", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(r"(\w+)\s*\("), F.lit(1)))))
    meet = own.filter(plain).join(called, ["file", "name"]).select("name", "file", "line_number", "line")
    meet = meet.unionByName(own.filter(~plain).join(lines, "file").select("name", "file", "line_number", "line"))
    hit = meet.filter(F.regexp_like("line", F.concat(F.lit(r"[\w>&*:]\s*\b"), F.col("name"), F.lit(r"\s*\([^;]*$"))))
    first = hit.groupBy("name", "file").agg(F.min("line_number").alias("found"))
    return functions.select("name", "file").distinct().join(first, ["name", "file"], "left").select("name", "file", F.coalesce("found", F.lit(0)).alias("line_number"))


def best_node(classes: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """The class's node in the module that declares it: reflected classes first, then by module."""
    first = classes.filter(F.col("name") == name).orderBy(F.desc("is_uclass"), "module", "line_number").limit(1).select("name", "module")
    return nodes.join(first, ["name", "module"])


def by_priority(classes: DataFrame, name: str, core: list[str], runtime: list[str]) -> DataFrame:
    """One row of the class: from a core module, else a runtime module, else any, by module."""
    rank = F.when(F.col("module").isin(core), 0).when(F.col("module").isin(runtime), 1).otherwise(2)
    return classes.filter(F.col("name") == name).withColumn("rank", rank).orderBy("rank", "module", "line_number").limit(1)


def neighbours(edges: DataFrame, node: str | int, direction: str = "out", relation: str | None = None) -> DataFrame:
    """node, direction, type of the edges at a node."""
    e = edges.filter(F.col("type") == relation) if relation else edges
    parts = {"out": e.filter(F.col("src") == node).select(F.col("dst").alias("node"), F.lit("out").alias("direction"), "type"), "in": e.filter(F.col("dst") == node).select(F.col("src").alias("node"), F.lit("in").alias("direction"), "type")}
    return reduce(DataFrame.unionByName, parts.values()) if direction == "both" else parts[direction]


def document(declarations: DataFrame, docs: DataFrame, key: str = "file", reach: int = 2) -> DataFrame:
    """Declarations (file, line) with the comment (file, line, doc) at their own line, else one line above, else two."""
    near = docs.select(col(key), F.col("doc"), F.explode(F.sequence(F.lit(0), F.lit(reach))).alias("off"), F.col("line").alias("at")).select(key, "doc", "off", (F.col("at") + F.col("off")).alias("line"))
    best = near.groupBy(key, "line").agg(F.min_by("doc", "off").alias("doc"))
    return declarations.join(best, [key, "line"], "left")


def carry_macro(lines: DataFrame, is_macro: str, is_declaration: str, value: str, file: str = "file", line: str = "line") -> DataFrame:
    """Each declaration with the macro before it that no other declaration has consumed, else null."""
    w = Window.partitionBy(file).orderBy(line)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    last_macro = F.max(F.when(F.col(is_macro), F.struct(F.col(line), F.col(value)))).over(before)
    last_decl = F.max(F.when(F.col(is_declaration), F.col(line))).over(before)
    marked = lines.withColumn("m", last_macro).withColumn("d", last_decl).filter(F.col(is_declaration))
    return marked.withColumn("macro", F.when(F.col("d").isNull() | (F.col(f"m.{line}") > F.col("d")), F.col(f"m.{value}"))).drop("m", "d")


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose target is no node."""
    return edges.join(nodes.select(F.col("node_id").alias("dst")).distinct(), "dst", "left_anti").select("src", "dst")


def find_everywhere(sources: list[DataFrame], name: str) -> DataFrame:
    """One lookup over all sources at once instead of an index and fallbacks; earlier sources first."""
    all_ = reduce(DataFrame.unionByName, [s.withColumn("source_rank", F.lit(i)) for i, s in enumerate(sources)])
    hit = all_.filter(F.col("name") == name)
    first = hit.agg(F.min("source_rank").alias("best"))
    return hit.join(first, hit["source_rank"] == F.col("best")).drop("best")
