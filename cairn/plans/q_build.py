"""Queries for trees, stores, builds and driver-side helpers. Their source tree has a module for each nation; one build of it serves all of a session's queries."""

from __future__ import annotations

import contextlib
import io
import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from cairn.functions import expr as X, parsing as P
from cairn.operators import incremental, joins, sequence, shaping
from cairn.operators.iterate import shared_dir
from cairn.sources import detect, files as S, storage

from . import bindings as B
from .build import OUTPUTS, STAGES, Build, main, partition_status, partitioned, render_column
from .commands import Index, plugin_index
from .registry import query

# ---------------------------------------------------------------- the tree

_DESC = "concat('PublicDependencyModuleNames.AddRange(new string[] { \"Mod', n_nationkey + 1, '\", \"Core\" });\\nPrivateDependencyModuleNames.Add(\"Mod', n_regionkey, '\");\\n')"
_HEAD = "concat('/** About ', n_name, ' */\\nUCLASS()\\nclass UT', n_nationkey, ' : public UObject\\n{\\n  UFUNCTION(BlueprintCallable)\\n  void Go', n_nationkey, '(int32 A);\\n};\\nUENUM()\\nenum class EK', n_nationkey, ' : uint8 { A', n_regionkey, ', B };\\n')"
_CPP = "concat('#include \"T', n_nationkey, '.h\"\\nvoid UT', n_nationkey, '::Go', n_nationkey, '(int32 A)\\n{\\n  Helper', n_regionkey, '(A);\\n}\\n')"
_TEST = "concat('#include \"T', n_nationkey, '.h\"\\nvoid Check', n_nationkey, '()\\n{\\n  UT', n_nationkey, '* T = NewObject<UT', n_nationkey, '>(this);\\n}\\n')"
#: The same texts and folders in DuckDB.
_HEAD_SQL = "'/** About ' || n_name || ' */' || chr(10) || 'UCLASS()' || chr(10) || 'class UT' || n_nationkey || ' : public UObject' || chr(10) || '{' || chr(10) || '  UFUNCTION(BlueprintCallable)' || chr(10) || '  void Go' || n_nationkey || '(int32 A);' || chr(10) || '};' || chr(10) || 'UENUM()' || chr(10) || 'enum class EK' || n_nationkey || ' : uint8 { A' || n_regionkey || ', B };' || chr(10)"
_PLUGIN = "n_nationkey % 2 = 1"
_MODS = f"mods AS (SELECT 'Mod' || n_nationkey AS name, CASE WHEN {_PLUGIN} THEN 'Plugins.FX.Kit' || n_regionkey ELSE 'Runtime' END AS category, * FROM nation)"
_M = f"WITH {_MODS}"

_made: dict[tuple, tuple[str, Build]] = {}


def _tree(s: SparkSession, d: str) -> tuple[str, Build]:
    """The tree's root and a build of it that has run."""
    key = (s.sparkContext.applicationId, d)
    if key not in _made:
        base = shared_dir(s)
        root = f"{base}/Engine-5.3"
        for r in B.table(s, d, "nation").selectExpr("n_nationkey AS k", "n_regionkey AS r", f"{_DESC} AS d", f"{_HEAD} AS h", f"{_CPP} AS c", f"{_TEST} AS t").collect():  # 25 rows
            at = f"{root}/Engine/Plugins/FX/Kit{r.r}/Source/Mod{r.k}" if r.k % 2 else f"{root}/Engine/Source/Runtime/Mod{r.k}"
            for name, text in ((f"Mod{r.k}.Build.cs", r.d), (f"Public/T{r.k}.h", r.h), (f"Private/T{r.k}.cpp", r.c), (f"Private/T{r.k}Test.cpp", r.t), (f"Intermediate/Gen{r.k}.h", f"class AGen{r.k} {{}};"), ("Public/Extra.inl", "int x;\n")):
                storage.write_text(s, f"{at}/{name}", text)
            storage.write_bytes(s, f"{at}/Private/Bytes{r.k}.cpp", f"// Na\xefve {r.k}\n".encode("latin-1"))
        b = Build(s, root, f"{base}/kb")
        failed = {k: v for k, v in b.run().items() if isinstance(v, str)}
        if failed:
            raise RuntimeError(f"the build stopped: {failed}")
        _made[key] = root, b
    return _made[key]


def _rows(s, rows, ddl) -> DataFrame:
    return s.createDataFrame(rows, ddl)


def _index(s, d) -> Index:
    return Index.load(s, _tree(s, d)[1].out)


# ---------------------------------------------------------------- sources


@query("SRC02_mode_switch", "SELECT * FROM (VALUES ('root', 'engine'), ('below', 'plugin')) t(path, kind)")
def _(s, d):
    root, b = _tree(s, d)
    return _rows(s, [("root", b._mode()), ("below", Build(s, f"{root}/Engine/Plugins", b.out)._mode())], "path string, kind string")


@query("SRC03_tree_scan", f"{_M} SELECT name, category FROM mods")
def _(s, d):
    return S.engine_descriptors(s, f"{_tree(s, d)[0]}/Engine").select("name", "category")


@query("SRC05_plugin_scan", f"{_M} SELECT name FROM mods WHERE {_PLUGIN} AND n_regionkey = 1")
def _(s, d):
    return S.plugin_descriptors(s, f"{_tree(s, d)[0]}/Engine/Plugins/FX/Kit1").select("name")


@query("SRC07_source_scan", "SELECT f || n_nationkey || e AS file FROM nation, (VALUES ('T', '.h'), ('T', '.cpp'), ('T', 'Test.cpp'), ('Gen', '.h'), ('Bytes', '.cpp')) t(f, e)")
def _(s, d):
    return S.sources(s, _tree(s, d)[0], pruned=False).select(X.basename("path").alias("file"))


@query("SRC09_text_read", "SELECT 'Bytes' || n_nationkey || '.cpp' AS file, '// Nave ' || n_nationkey || chr(10) AS text FROM nation")
def _(s, d):
    f = S.sources(s, _tree(s, d)[0]).select(X.basename("path").alias("file"), "text")
    return f.filter(F.col("file").startswith("Bytes"))


@query("SRC10_hashed_files", f"SELECT 'T' || n_nationkey || '.h' AS file, sha256({_HEAD_SQL}) AS sha256, octet_length(encode({_HEAD_SQL}))::BIGINT AS size FROM nation UNION ALL SELECT 'Extra.inl', sha256('int x;' || chr(10)), 7 FROM nation")
def _(s, d):
    f = S.hashed_files(s, _tree(s, d)[0]).select(X.basename("path").alias("file"), "sha256", "size")
    return f.filter(F.col("file").rlike(r"^(T\d+\.h|Extra\.inl)$"))


@query("SRC11_stage_result", "SELECT s_suppkey, s_name, 'read' AS state FROM supplier UNION ALL SELECT NULL, NULL, 'absent'")
def _(s, d):
    at = shared_dir(s)
    absent = S.stage(s, at)
    B.table(s, d, "supplier").select("s_suppkey", "s_name").write.parquet(at)
    return S.stage(s, at).withColumn("state", F.lit("read")).unionByName(_rows(s, [(None, None, "absent" if absent is None else "there")], "s_suppkey long, s_name string, state string"))


@query("SRC13_module_graph", "SELECT 'class_UT4' AS src, 'class_UObject' AS dst, 'inherits' AS type")
def _(s, d):
    return _tree(s, d)[1].read("edges").filter("module = 'Mod4' and type = 'inherits'").select("src", "dst", "type")


@query("SRC14_all_modules", f"{_M} SELECT name, category, 'Core,Mod' || (n_nationkey + 1) AS pub, 'Mod' || n_regionkey AS priv FROM mods")
def _(s, d):
    return _index(s, d).modules.select("name", "category", F.array_join("public_dependencies", ",").alias("pub"), F.array_join("private_dependencies", ",").alias("priv"))


@query("SRC15_configuration", "SELECT * FROM (VALUES ('build.partitions', '6'), ('project.version', '5.3'), ('storage.tables', '/base/tables'), ('storage.none', '-')) t(key, value)")
def _(s, d):
    c = detect.Config(base="/base")
    c.set("project.version", "5.3")
    return _rows(s, [(k, str(c.get(k, "-"))) for k in ("build.partitions", "project.version", "storage.tables", "storage.none")], "key string, value string")


@query("SRC16_legacy_import", "SELECT n_name AS name, CASE WHEN n_nationkey < 5 THEN 'kept' ELSE 'old' END AS category, CASE WHEN n_nationkey >= 5 THEN n_nationkey END AS file_count FROM nation")
def _(s, d):
    n = B.table(s, d, "nation")
    at = f"{shared_dir(s)}/registry.json"
    storage.write_text(s, at, json.dumps({r.n_name: {"name": r.n_name, "category": "old", "file_count": r.n_nationkey} for r in n.collect()}))  # 25 rows
    old = S.legacy_registry(s, at)
    now = old.filter(F.col("file_count") < 5).withColumn("category", F.lit("kept")).withColumn("file_count", F.lit(None).cast("long"))
    return S.import_legacy(s, at, now).select("name", "category", "file_count")


@query("SRC18_test_sources", "SELECT 'T' || n_nationkey || 'Test.cpp' AS file FROM nation")
def _(s, d):
    return S.test_sources(s, _tree(s, d)[0]).select(X.basename("path").alias("file"))


@query("SRC19_detection", "SELECT * FROM (VALUES ('.', 'engine', 'high'), ('Engine/Source/Runtime', 'engine', 'medium'), ('/', 'unknown', 'low')) t(path, kind, confidence)")
def _(s, d):
    root = _tree(s, d)[0].removeprefix("file://")  # detection starts from the working folder, which is local
    found = [(p, detect.detect(p if p == "/" else f"{root}/{p}".removesuffix("/."))) for p in (".", "Engine/Source/Runtime", "/")]
    return _rows(s, [(p, x.kind, x.confidence) for p, x in found], "path string, kind string, confidence string")


# ---------------------------------------------------------------- sinks


@query("SNK03_full_refresh", "SELECT p_partkey, p_name FROM part")
def _(s, d):
    b, p = Build(s, "", shared_dir(s)), B.table(s, d, "part").select("p_partkey", "p_name")
    b._write(p.limit(3), "parts")
    b._write(p, "parts")
    return b.read("parts")


@query("SNK04_append", "SELECT s_suppkey, 2::BIGINT AS n FROM supplier")
def _(s, d):
    at = shared_dir(s)
    for _ in range(2):
        B.table(s, d, "supplier").select("s_suppkey").write.mode("append").parquet(at)
    return s.read.parquet(at).groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("n"))


@query("SNK05_registry_json", f"{_M} SELECT name, category FROM mods")
def _(s, d):
    at = shared_dir(s)
    _index(s, d).modules.select("name", "category").write.json(at)
    return s.read.schema("name string, category string").json(at)


@query("SNK06_graph_tables", "SELECT * FROM (SELECT 'node' AS kind, unnest(['file', 'class', 'method', 'enum', 'include']) AS type, unnest([3, 1, 1, 1, 1]) * (SELECT count(*) FROM nation) AS n) UNION ALL SELECT * FROM (SELECT 'edge', unnest(['contains', 'inherits', 'has_method', 'includes']), unnest([2, 1, 1, 2]) * (SELECT count(*) FROM nation))")
def _(s, d):
    from cairn.operators.stats import graph_types

    b = _tree(s, d)[1]
    return graph_types(b.read("nodes"), b.read("edges"))


@query("SNK07_stage_metadata", "SELECT 'parts' AS stage, count(*) AS n_rows, true AS is_read FROM part")
def _(s, d):
    b = Build(s, "", shared_dir(s))
    b.save_result(B.table(s, d, "part").select("p_partkey"), "parts")
    m = b.metadata("parts")
    return _rows(s, [(m["stage"], m["n_rows"], b.read("parts").count() == m["n_rows"])], "stage string, n_rows long, is_read boolean")


@query("SNK09_per_module_json", "SELECT 'Mod' || n_nationkey AS module, 'Go' || n_nationkey AS caller, 'Helper' || n_regionkey AS callee FROM nation")
def _(s, d):
    at = shared_dir(s)
    _tree(s, d)[1].read("parsed_calls").filter("caller like 'Go%'").select("module", "caller", "callee").write.partitionBy("module").json(at)
    return s.read.schema("caller string, callee string, module string").json(at).select("module", "caller", "callee")


@query("SNK10_manifest", f"{_M} SELECT name, 7::BIGINT AS file_count FROM mods")
def _(s, d):
    return _tree(s, d)[1].read("manifest").select("name", "file_count")


@query("SNK11_template", "SELECT s_suppkey, 'Supplier ' || s_name || ' {x} ' || s_suppkey AS text FROM supplier")
def _(s, d):
    return B.table(s, d, "supplier").select("s_suppkey", render_column("Supplier {NAME} {{x}} {KEY}", {"NAME": "s_name", "KEY": "s_suppkey"}).alias("text"))


@query("SNK13_partition_results", "SELECT CASE WHEN n_nationkey % 2 = 1 THEN 'Plugins' ELSE 'Runtime' END AS part, count(*) AS n_modules, count(*) AS n_parsed, CASE WHEN n_nationkey % 2 = 1 THEN 'error' ELSE 'done' END AS result FROM nation GROUP BY ALL")
def _(s, d):
    b = _tree(s, d)[1]

    def run(found):
        if found.filter(F.col("category").startswith("Plugins.")).limit(1).count():
            raise ValueError("not these")

    result = partitioned(b, run)
    return partition_status(b).join(_rows(s, [(k, v.split(":")[0]) for k, v in result.items()], "part string, result string"), "part").select("part", "n_modules", "n_parsed", "result")


@query("SNK14_clean", "SELECT * FROM (VALUES ('extract', true), ('generate', false)) t(stage, is_complete)")
def _(s, d):
    src = _tree(s, d)[1]
    b = Build(s, src.root, shared_dir(s))
    b._write(src.read("manifest"), "manifest")
    storage.write_text(s, b.path("README.md"), "x")
    b.clean("generate")
    return b.status().filter("stage in ('extract', 'generate')").select("stage", "is_complete")


# ---------------------------------------------------------------- parsing


@query("WIN04_comment_state", "SELECT s_suppkey, n AS line_number, ['a' || s_suppkey, '', 'b' || s_suppkey || ' \"/* no */\"', ''][n] AS code FROM supplier, range(1, 5) t(n)")
def _(s, d):
    p = B.table(s, d, "supplier").selectExpr("s_suppkey", "concat('a', s_suppkey, ' /* x\\n y \" ', s_suppkey, '\\n */ b', s_suppkey, ' \"/* no */\" // c\\n// d') AS text")
    return sequence.lines(P.parse_table(p, "code"), "s_suppkey", "code").select("s_suppkey", F.col("line_number").cast("long").alias("line_number"), F.trim("line").alias("code"))


@query("WIN05_namespace_stack", "SELECT 'CA' || s_suppkey AS name, 'N' || s_nationkey || '::M' AS namespace FROM supplier UNION ALL SELECT 'CB' || s_suppkey, 'N' || s_nationkey FROM supplier UNION ALL SELECT 'CD' || s_suppkey, '' FROM supplier")
def _(s, d):
    p = B.table(s, d, "supplier").selectExpr("concat('namespace N', s_nationkey, ' {\\nnamespace M {\\nclass CA', s_suppkey, ' { int x; };\\n}\\nclass CB', s_suppkey, ' { };\\n}\\nclass CD', s_suppkey, ' { };\\n') AS text")
    return P.parse_table(p, "classes").select("name", "namespace")


@query("PAR13_facades", "SELECT 'C' || s_suppkey AS name, 'B' || s_nationkey AS parent_class FROM supplier")
def _(s, d):
    P.register(s)
    B.table(s, d, "supplier").selectExpr("concat('class C', s_suppkey, ' : public B', s_nationkey, ' { };') AS text").createOrReplaceTempView("cairn_texts")
    return s.sql("SELECT c.name, c.parent_class FROM cairn_texts, LATERAL parse_classes(text) c")


@query("PAR24_dependency_kinds", "SELECT s_suppkey, 'Core,P' || s_nationkey AS pub, 'Q' || s_suppkey AS priv, '' AS dyn, 'Core,P' || s_nationkey || ',Q' || s_suppkey AS all_kinds FROM supplier")
def _(s, d):
    p = B.table(s, d, "supplier").selectExpr("s_suppkey", "concat('PublicDependencyModuleNames.AddRange(new string[] { \"P', s_nationkey, '\", \"Core\" });\\nPrivateDependencyModuleNames.Add(\"Q', s_suppkey, '\");') AS text")
    one = lambda k: F.array_join(F.sort_array(X.dependencies("text", k)), ",")
    return p.select("s_suppkey", one("Public").alias("pub"), one("Private").alias("priv"), one("Dynamic").alias("dyn"), F.array_join(X.all_dependencies("text"), ",").alias("all_kinds"))


# ---------------------------------------------------------------- commands


@query("CMD06_function_implementation", "SELECT 'Go8' AS name, 2 AS start_line, 5 AS end_line, true AS has_body")
def _(s, d):
    return _index(s, d).get_function_implementation("Go8").select("name", F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"), F.contains("code", F.lit("Helper")).alias("has_body"))


@query("CMD14_examples", "SELECT 'UT8' AS target_name, 'class' AS target_type, 'UT8* T = NewObject<UT8>(this);' AS example_code")
def _(s, d):
    return _index(s, d).query_examples("UT8").select("target_name", "target_type", "example_code")


@query("CMD16_kb_info", "SELECT * FROM (VALUES ('kb_version', '1'), ('engine_version', '5.3'), ('build_mode', 'engine'), ('plugin_name', '')) t(key, value)")
def _(s, d):
    return _rows(s, list(_index(s, d).get_kb_info().items()), "key string, value string")


@query("CMD17_dispatch", "SELECT * FROM (VALUES ('query_class_info UT3', 'UT3'), ('query_class_info UNone', 'error'), ('drop_tables', 'error'), ('get_kb_info', 'engine')) t(command, answer)")
def _(s, d):
    ix = _index(s, d)

    def answer(c):
        r = json.loads(ix.run(*c.split()))
        return r[0]["name"] if isinstance(r, list) else "error" if "error" in r else r["build_mode"]

    return _rows(s, [(c, answer(c)) for c in ("query_class_info UT3", "query_class_info UNone", "drop_tables", "get_kb_info")], "command string, answer string")


@query("CMD18_plugin_variants", f"{_M} SELECT 'search_modules' AS command, name AS answer FROM (SELECT name FROM mods WHERE contains(name, '1') ORDER BY name LIMIT 50) UNION ALL SELECT 'search_enums', 'this knowledge base has no enums'")
def _(s, d):
    ix = plugin_index(_index(s, d))
    found = ix.search_modules("1").select(F.lit("search_modules").alias("command"), F.col("name").alias("answer"))
    return found.unionByName(_rows(s, [("search_enums", json.loads(ix.run("search_enums", "E"))["error"])], "command string, answer string"))


@query("CMD20_build_commands", "SELECT * FROM (VALUES ('status', 0), ('partition-status', 0), ('', 1), ('nonsense', 1)) t(command, code)")
def _(s, d):
    root, b = _tree(s, d)
    with contextlib.redirect_stdout(io.StringIO()):
        rows = [(c, main([c, root, b.out] if c else [])) for c in ("status", "partition-status", "", "nonsense")]
    return _rows(s, rows, "command string, code int")


# ---------------------------------------------------------------- shaping


@query("SHP04_levels", f"WITH {B.CLASSES}, n AS (SELECT count(*) AS n FROM classes WHERE name = 'Part17') SELECT level, n, budget FROM n, (VALUES ('summary', 200), ('details', 1000), ('source', 5000)) t(level, budget) UNION ALL SELECT 'all', NULL, NULL")
def _(s, d):
    c = B.classes(s, d)
    files = c.select("file_path").distinct().withColumn("text", F.lit("x"))
    rows = [(k, shaping.query_class(c, files, "Part17", k).count(), v) for k, v in shaping.LEVELS.items()]
    try:
        shaping.query_class(c, files, "Part17", "all")
    except ValueError:
        rows.append(("all", None, None))
    return _rows(s, rows, "level string, n long, budget int")


@query("SHP07_class_in_all_graphs", "SELECT 'Mod' || n_nationkey AS module, 'UT' || n_nationkey AS name FROM nation WHERE n_nationkey = 12")
def _(s, d):
    return _tree(s, d)[1].read("nodes").filter("node_id = 'class_UT12'").select("module", "name")


@query("SHP09_result_cache", "SELECT count(*) AS n, 2 AS accesses, true AS expired FROM supplier")
def _(s, d):
    now = [0.0]
    cache = shaping.ResultCache(10, lambda: now[0])
    ref = cache.store(B.table(s, d, "supplier"))
    cache.retrieve(ref)
    n, accesses = cache.retrieve(ref).count(), cache.statistics()["accesses"]
    now[0] = 11
    return _rows(s, [(n, accesses, cache.cleanup_expired() == 1 and cache.retrieve(ref) is None)], "n long, accesses int, expired boolean")


@query("SHP13_reset", "SELECT * FROM (VALUES ('class', 0.0::DOUBLE, 3000), ('function', 0.5::DOUBLE, 1000)) t(category, utilisation, remaining)")
def _(s, d):
    b = shaping.TokenBudget()
    for c in ("class", "function"):
        b.allocate(c, 1000)
    b.reset("class")
    return _rows(s, [(c, b.utilisation(c), b.remaining(c)) for c in ("class", "function")], "category string, utilisation double, remaining int")


@query("SHP14_cache_statistics", "SELECT * FROM (SELECT 'before' AS at, count(*) AS entries, count(*) AS accesses, 1.0::DOUBLE AS average FROM nation) UNION ALL SELECT 'after', 0, 0, 0.0")
def _(s, d):
    cache, out = shaping.ResultCache(), []
    for r in B.table(s, d, "nation").collect():  # 25 rows
        cache.retrieve(cache.store(r.n_name))
    for at in ("before", "after"):
        x = cache.statistics()
        out.append((at, x["entries"], x["accesses"], float(x["average"])))
        cache.clear()
    return _rows(s, out, "at string, entries long, accesses long, average double")


# ---------------------------------------------------------------- orchestration

_STAGES = ", ".join(f"('{x}', {i})" for i, x in enumerate(STAGES))


@query("INC07_stage_state", f"SELECT stage, 'skipped' AS result FROM (VALUES {_STAGES}) t(stage, i) UNION ALL SELECT 'build alone', 'error: run discover first'")
def _(s, d):
    b = _tree(s, d)[1]
    alone = Build(s, b.root, shared_dir(s)).run(only="build")["build"]
    return _rows(s, [*b.run().items(), ("build alone", alone)], "stage string, result string")


@query("ORC01_all_stages", f"SELECT stage, true AS is_timed, i FROM (VALUES {_STAGES}) t(stage, i) WHERE i < 2")
def _(s, d):
    src = _tree(s, d)[1]
    b = Build(s, src.root, shared_dir(s))
    out = b.run(only="discover") | b.run(only="extract")
    return _rows(s, [(k, isinstance(v, float), i) for i, (k, v) in enumerate(out.items())], "stage string, is_timed boolean, i int")


@query("ORC02_stage_status", f"SELECT stage, i AS position, true AS is_complete FROM (VALUES {_STAGES}) t(stage, i)")
def _(s, d):
    return _tree(s, d)[1].status()


@query("ORC03_completion", f"SELECT stage, false AS is_complete FROM (VALUES {_STAGES}) t(stage, i)")
def _(s, d):
    return Build(s, "", shared_dir(s)).status().select("stage", "is_complete")


@query("ORC04_extraction", f"{_M} SELECT name, 'Core,Mod' || (n_nationkey + 1) AS pub FROM mods")
def _(s, d):
    return _tree(s, d)[1].read("found").select("name", F.array_join(X.dependencies("text", "Public"), ",").alias("pub")).withColumn("pub", F.array_join(F.array_sort(F.split("pub", ",")), ","))


@query("ORC05_analysis", "SELECT 'Mod' || n_nationkey AS module, 'UT' || n_nationkey AS name, 'About ' || n_name AS doc, 1 AS n_methods FROM nation")
def _(s, d):
    return _tree(s, d)[1].read("parsed_classes").select("module", "name", "doc", F.size("methods").alias("n_methods"))


@query("ORC06_graph_build", "SELECT 'Go' || n_nationkey AS src, 'Helper' || n_regionkey AS dst FROM nation")
def _(s, d):
    return _tree(s, d)[1].read("calls").filter("src like 'Go%'")


@query("ORC07_core_modules", "SELECT 'Mod' || n_nationkey AS name FROM nation WHERE n_nationkey IN (1, 2, 3)")
def _(s, d):
    return S.core_modules(_tree(s, d)[1].read("found"), ["Mod1", "Mod2", "Mod3", "ModNone"]).select("name")


@query("ORC09_schemas", "SELECT * FROM (VALUES ('calls', 'caller,callee'), ('docs', 'line,doc'), ('includes', 'include,line')) t(kind, columns)")
def _(s, d):
    from pyspark.sql.types import StructType

    return _rows(s, [(k, ",".join(StructType.fromDDL(P.COLUMNS[k]).names)) for k in ("calls", "docs", "includes")], "kind string, columns string")


@query("ORC10_commits", f"SELECT unnest({sorted(t for x in OUTPUTS.values() for t in x if t != 'README')}) AS name, true AS is_committed")
def _(s, d):
    b = _tree(s, d)[1]
    return _rows(s, [(t, storage.exists(s, b.path(t) + "/_SUCCESS")) for x in OUTPUTS.values() for t in x if t != "README"], "name string, is_committed boolean")


@query("ORC12_parser_records", "SELECT kind, n * (SELECT count(*) FROM part) AS n FROM (VALUES ('classes', 1), ('functions', 2), ('enums', 1), ('includes', 1)) t(kind, n)")
def _(s, d):
    from .q_text import _CLASS, _part

    return P.parse_all(_part(s, d, _CLASS)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("ORC13_ask", f"{_M} SELECT name, category, 'Core,Mod4,Mod5' AS deps FROM mods WHERE n_nationkey = 4")
def _(s, d):
    return _index(s, d).ask("What does Mod4 depend on").select("name", "category", F.array_join("dependencies", ",").alias("deps"))


@query("ORC14_plugin_twins", f"{_M} SELECT 'class' AS what, 'UT9' AS name UNION ALL SELECT 'hierarchy', unnest(['UT9', 'UObject']) UNION ALL SELECT 'classes', 'UT9' UNION ALL SELECT 'functions', 'Go9' UNION ALL SELECT 'statistics', category FROM mods GROUP BY category")
def _(s, d):
    ix = plugin_index(_index(s, d))
    parts = {"class": ix.query_class_info("UT9"), "hierarchy": ix.query_class_hierarchy("UT9"), "classes": ix.query_module_classes("Mod9"), "functions": ix.search_functions("go9"), "statistics": ix.get_statistics().withColumnRenamed("category", "name")}
    out = None
    for k, df in parts.items():
        df = df.select(F.lit(k).alias("what"), "name")
        out = df if out is None else out.unionByName(df)
    return out


@query("ORC15_result_table", f"SELECT i AS position, stage, 'skipped' AS result FROM (VALUES {_STAGES}) t(stage, i)")
def _(s, d):
    return _rows(s, [(i, k, str(v)) for i, (k, v) in enumerate(_tree(s, d)[1].run().items())], "position int, stage string, result string")
