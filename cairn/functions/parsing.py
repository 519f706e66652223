"""The declaration parser over DataFrames: ``mapInArrow`` tables and SQL table functions.

Filters on paths belong before these functions, projections after them: Python is a
barrier to the optimizer. A text that cannot be parsed gives a row in ``failures``.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import Row

from . import cpp

_PROPS = "array<struct<name:string,type:string,is_uproperty:boolean,flags:array<string>,category:string>>"
_PARAMS = "array<struct<type:string,name:string,default:string>>"
COLUMNS = {
    "classes": f"name string, namespace string, line int, parent_class string, parent_classes array<string>, interfaces array<string>, is_uclass boolean, is_struct boolean, is_interface boolean, is_blueprintable boolean, flags array<string>, category string, doc string, properties {_PROPS}, methods array<string>",
    "functions": f"name string, class_name string, namespace string, return_type string, parameters {_PARAMS}, is_virtual boolean, is_static boolean, is_const boolean, is_override boolean, is_final boolean, is_pure_virtual boolean, is_ufunction boolean, flags array<string>, category string, is_blueprint_callable boolean, doc string, line int, signature string",
    "definitions": "name string, class_name string, line int, body string",
    "enums": "name string, underlying string, namespace string, values array<string>, is_uenum boolean, flags array<string>, doc string, line int",
    "delegates": "name string, kind string, return_type string, params array<string>, line int",
    "aliases": "name string, underlying string, kind string, line int",
    "includes": "include string, line int",
    "calls": "caller string, callee string",
    "docs": "line int, doc string",
    "code": "code string",
    "failures": "error string",
}


def records(text: str | None, kind: str) -> list[dict]:
    if kind == "calls":
        return [{"caller": a, "callee": b} for a, b in cpp.calls(text)]
    if kind == "code":
        return [{"code": cpp.strip_comments(text or "")}]
    if kind == "docs":
        return [{"line": n, "doc": t} for n, t in cpp.doc_lines(text or "")]
    return cpp.parse(text)[kind]


def _tried(text: str | None, kind: str) -> tuple[list[dict], str | None]:
    """The records, or none and the error: whatever a file does to the parser concerns that file alone."""
    try:
        return (cpp.parse(text), [])[1] if kind == "failures" else records(text, kind), None
    except Exception as e:
        return [], f"{type(e).__name__}: {e}"


def parse_table(files: DataFrame, kind: str, text: str = "text") -> DataFrame:
    """The records of one kind in each row's text, after the row's other columns."""
    keep = [c for c in files.columns if c != text]
    src = files.select(*keep, text)
    ddl = ", ".join([f"`{c}` {src.schema[c].dataType.simpleString()}" for c in keep] + [COLUMNS[kind]])
    target = _arrow(src.sparkSession, ddl)

    def run(batches):
        for rb in batches:
            for at in range(0, rb.num_rows, 64):
                out = []
                for row in rb.slice(at, 64).to_pylist():
                    found, error = _tried(row.pop(text), kind)
                    out.extend(row | r for r in ([{"error": error}] if error and kind == "failures" else found))
                yield pa.RecordBatch.from_pylist(out, schema=target)

    return src.mapInArrow(run, ddl)


#: What one parse of a file gives.
KINDS = ("classes", "functions", "enums", "delegates", "includes", "calls", "failures")


def parse_all(files: DataFrame, text: str = "text") -> DataFrame:
    """Each text parsed once: after the row's other columns ``kind`` and a struct column for each of KINDS, of which the row's kind is filled. See ``of_kind``."""
    keep = [c for c in files.columns if c != text]
    src = files.select(*keep, text)
    columns = {k: f"struct<{_fields(COLUMNS[k])}>" for k in KINDS}
    ddl = ", ".join([f"`{c}` {src.schema[c].dataType.simpleString()}" for c in keep] + ["kind string"] + [f"`{k}` {t}" for k, t in columns.items()])
    target = _arrow(src.sparkSession, ddl)

    def run(batches):
        for rb in batches:
            for at in range(0, rb.num_rows, 64):
                out = []
                for row in rb.slice(at, 64).to_pylist():
                    t = row.pop(text)
                    try:
                        found = cpp.parse(t)
                        found["calls"] = [{"caller": d["name"], "callee": c} for d in found["definitions"] for c in cpp.callees(d["body"])]
                    except Exception as e:  # whatever a file does to the parser concerns that file alone
                        found = {"failures": [{"error": f"{type(e).__name__}: {e}"}]}
                    out.extend(row | {"kind": k, k: r} for k in KINDS for r in found.get(k, ()))
                yield pa.RecordBatch.from_pylist(out, schema=target)

    return src.mapInArrow(run, ddl)


def count_kinds(files: DataFrame, kinds: tuple[str, ...], text: str = "text") -> DataFrame:
    """kind, n: how many records of each kind all texts give, each text parsed once; a kind without records counts 0."""
    spark = files.sparkSession
    target = _arrow(spark, "kind string, n long")

    def run(batches):
        n = dict.fromkeys(kinds, 0)
        for rb in batches:
            for t in rb.column(0).to_pylist():
                try:
                    found = cpp.parse(t)
                except Exception:  # whatever a file does to the parser concerns that file alone
                    continue
                for k in kinds:
                    n[k] += len(found[k])
        yield pa.RecordBatch.from_pylist([{"kind": k, "n": v} for k, v in n.items()], schema=target)

    none = spark.createDataFrame([(k, 0) for k in kinds], "kind string, n long")
    return files.select(text).mapInArrow(run, "kind string, n long").unionByName(none).groupBy("kind").agg(F.sum("n").alias("n"))


def of_kind(parsed: DataFrame, kind: str) -> DataFrame:
    """One kind's records of ``parse_all``, as ``parse_table`` gives them."""
    keep = parsed.columns[: parsed.columns.index("kind")]
    return parsed.filter(F.col("kind") == kind).select(*keep, f"{kind}.*")


def _fields(ddl: str) -> str:
    from pyspark.sql.types import StructType

    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in StructType.fromDDL(ddl).fields)


def _arrow(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def register(spark: SparkSession) -> None:
    """Table functions parse_classes, parse_functions, parse_enums, parse_delegates, parse_aliases, doc_comments for SQL with LATERAL."""
    for name, kind in {"parse_classes": "classes", "parse_functions": "functions", "parse_enums": "enums", "parse_delegates": "delegates", "parse_aliases": "aliases", "doc_comments": "docs"}.items():
        spark.udtf.register(name, F.udtf(_table_function(kind), returnType=COLUMNS[kind]))


def _table_function(kind: str):
    from pyspark.sql.types import StructType

    names = StructType.fromDDL(COLUMNS[kind]).names

    class Parse:
        def eval(self, text: str):
            for r in records(text, kind):
                yield tuple(_rows(r.get(n)) for n in names)

    return Parse


def _rows(v):
    return [Row(**x) if isinstance(x, dict) else x for x in v] if isinstance(v, list) else v


def examples(ln: DataFrame, file: str = "source_file") -> DataFrame:
    """Example rows of lines (file, line_number, line): classes made or held and functions called, with context and quality, each target and code once."""
    from cairn.operators.sequence import first_of, with_context

    from . import expr as X

    ctx = with_context(ln, file)
    made = ctx.select(file, "line_number", "line", "context_before", "context_after", X.used_class("line").alias("target_name"), F.lit("class").alias("target_type")).filter("target_name is not null")
    called = ctx.select(file, "line_number", "line", "context_before", "context_after", F.explode(X.called_functions("line")).alias("target_name"), F.lit("function").alias("target_type"))
    rows = made.unionByName(called).withColumn("example_code", F.trim("line"))
    rows = first_of(rows, ["target_name", "example_code"], [file, "line_number", "target_type"])
    return rows.select("target_name", "target_type", "example_code", "context_before", "context_after", file, "line_number", X.describe("example_code", "target_name").alias("description"), F.lit(False).alias("is_verified"), X.quality_score("example_code").alias("quality_score"))
