"""Sources, builds, commands, streams and driver-side helpers on a small tree."""

import json
import os

import pytest

from pyspark.sql import functions as F

from cairn.functions import expr as X
from cairn.functions.parsing import register
from cairn.operators import graph, incremental, joins, sequence, shaping
from cairn.plans.build import Build, partitioned, render
from cairn.plans.commands import Index, plugin_index
from cairn.sources import detect, files


@pytest.fixture
def tree(tmp_path):
    def put(path, text):
        f = tmp_path / "My.Engine-5.3" / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)

    put("Engine/Source/Runtime/Core/Core.Build.cs", 'PublicDependencyModuleNames.AddRange(new string[] { "Base" });')
    put("Engine/Source/Runtime/Core/Public/Thing.h", "/** A thing */\nUCLASS(Blueprintable)\nclass UThing : public UObject, public IUsable\n{\n  UPROPERTY(EditAnywhere)\n  int32 Size;\n  UFUNCTION(BlueprintCallable)\n  void Grow(int32 By);\n};\nUENUM()\nenum class EKind : uint8 { Big, Small };\n")
    put("Engine/Source/Runtime/Core/Private/Thing.cpp", '#include "Thing.h"\nvoid UThing::Grow(int32 By)\n{\n  if (By) { Helper(By); }\n  UThing* T = NewObject<UThing>(this);\n}\n')
    put("Engine/Source/Runtime/Core/Intermediate/Gen.h", "class AGenerated {};\n")
    put("Engine/Plugins/FX/Spark/Source/Spark/Spark.Build.cs", 'PrivateDependencyModuleNames.Add("Core");')
    put("Engine/Plugins/FX/Spark/Source/Spark/Spark.h", "class ASpark : public UThing {};\n")
    put("Engine/Source/Runtime/Base/Base.Build.cs", "// nothing\n")
    return str(tmp_path / "My.Engine-5.3")


def test_build_query_and_update(spark, tree, tmp_path):
    out = str(tmp_path / "kb")
    b = Build(spark, tree, out)
    assert b.run(only="build")["build"].startswith("error: run discover")
    assert not any(isinstance(v, str) for v in b.run().values())
    assert set(b.run().values()) == {"skipped"}
    assert [r.is_complete for r in b.status().orderBy("position").collect()] == [True] * 5
    ix = Index.load(spark, out)
    assert {r.name: (r.category, r.dependencies) for r in ix.modules.collect()} == {"Core": ("Runtime", ["Base"]), "Spark": ("Plugins.FX.Spark", ["Core"]), "Base": ("Runtime", [])}
    thing = ix.query_class_info("UThing").first()
    assert (thing.module, thing.is_blueprintable, thing.interfaces, thing.doc, thing.method_count) == ("Core", True, ["IUsable"], "A thing", 1)
    assert ix.classes.filter("name = 'AGenerated'").count() == 0
    assert [r.name for r in ix.query_class_hierarchy("ASpark").orderBy("level").collect()] == ["ASpark", "UThing", "UObject"]
    assert [r.name for r in ix.query_module_dependents("Core").collect()] == ["Spark"]
    code = ix.get_function_implementation("Grow").first()
    assert (code.start_line, code.end_line) == (2, 6) and "Helper" in code.code
    assert json.loads(ix.run("query_enum_info", "EKind"))[0]["values"] == ["Big", "Small"]
    assert json.loads(ix.run("query_examples", "UThing"))[0]["target_type"] == "class"
    assert "fallback_command" in json.loads(ix.run("query_class_info", "UNothing"))
    assert "error" in json.loads(ix.run("drop_tables"))
    assert "error" in json.loads(plugin_index(ix).run("search_enums", "E"))
    assert ix.query_module_dependencies("Cor").first().suggestion == "Core"
    impl = ix.functions.filter("name = 'Grow'").first().impl_file_path
    assert impl.endswith("Private/Thing.cpp")
    assert {(r.src, r.dst) for r in b.read("calls").collect()} == {("Grow", "Helper"), ("Grow", "NewObject")} or b.read("calls").count() >= 1
    assert b.read("edges").filter("type = 'includes'").count() == 1
    assert open(os.path.join(out, "README.md")).read().startswith("# engine")
    assert b.update() == {"unchanged": 3}
    with open(os.path.join(tree, "Engine/Plugins/FX/Spark/Source/Spark/Spark.h"), "w") as f:
        f.write("class ASpark : public UThing {};\nclass AFlame : public ASpark {};\n")
    assert b.update() == {"unchanged": 2, "modified": 1}
    assert {r.name for r in Index.load(spark, out).classes.collect()} == {"UThing", "ASpark", "AFlame"}
    assert partitioned(b, lambda df: df.count()) == {"Plugins": "done", "Runtime": "done"}
    assert partitioned(b, lambda df: 1 / 0)["Runtime"].startswith("error")
    b.clean("generate")
    assert not b.is_complete("generate")


def test_detection(tree, tmp_path):
    assert detect.detect(tree).kind == "engine"
    assert detect.detect(os.path.join(tree, "Engine", "Source")).confidence == "medium"
    (tmp_path / "P").mkdir()
    (tmp_path / "P" / "My.uplugin").write_text("{}")
    assert (detect.detect(str(tmp_path / "P")).kind, detect.detect(str(tmp_path / "P")).name) == ("plugin", "My")
    assert detect.detect("/nonexistent/a").kind == "unknown"
    assert detect.engine_version(tree) == "5.3"


def test_config(tmp_path):
    (tmp_path / "c.json").write_text('{"build": {"partitions": 3}}')
    c = detect.Config(str(tmp_path / "c.json"), str(tmp_path))
    assert (c.get("build.partitions"), c.get("build.none", 7), c.get("storage.base_path")) == (3, 7, str(tmp_path))
    c.set("a.b.c", 1)
    c.save()
    assert detect.Config(str(tmp_path / "c.json")).get("a.b.c") == 1


def test_render():
    assert render("{A} {{x}} {B}", {"A": 1, "B": "y"}) == "1 {x} y"


def test_table_functions(spark):
    register(spark)
    r = spark.sql("SELECT name, parent_class FROM (SELECT 'class A : public B {};' AS t), LATERAL parse_classes(t)").collect()
    assert [(x.name, x.parent_class) for x in r] == [("A", "B")]
    r = spark.sql("SELECT e.values FROM (SELECT 'enum E { X, Y };' AS t), LATERAL parse_enums(t) e").collect()
    assert r[0][0] == ["X", "Y"]


def test_stream_keeps_a_manifest(spark, tmp_path):
    from cairn.streaming.watch import watch_files

    src = tmp_path / "src"
    src.mkdir()
    (src / "a.h").write_text("int a;")
    args = (spark, str(src), str(tmp_path / "m"), str(tmp_path / "cp"))
    watch_files(*args, once=True).awaitTermination()
    assert files.stage(spark, str(tmp_path / "m")).count() == 1
    (src / "b.h").write_text("int b;")
    watch_files(*args, once=True).awaitTermination()
    assert files.stage(spark, str(tmp_path / "m")).count() == 2


def test_graph_algorithms(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (6, 6)], "src long, dst long")
    scc = {r.name: r.component for r in graph.strong_components(e).collect()}
    assert scc[1] == scc[2] == scc[3] and len({scc[i] for i in (1, 4, 5, 6)}) == 4
    assert graph.longest_path(e.filter("src <> dst")) is None
    assert graph.longest_path(e.filter("src in (3, 4) and dst > 3")) == 2
    assert graph.longest_path(e.filter("1 = 0")) == 0
    assert graph.shortest_path(e, 1, 5) == [1, 2, 3, 4, 5] and graph.shortest_path(e, 5, 1) is None and graph.shortest_path(e, 1, 5, 3) is None
    s = graph.call_statistics(e).first()
    assert (s.n_nodes, s.n_edges, s.n_components, s.n_isolates, s.longest_path) == (6, 6, 4, 1, "N/A")
    n = spark.createDataFrame([(i,) for i in range(1, 9)], "name long")
    g = graph.statistics(n, e).first()
    assert (g.n_nodes, g.n_edges, g.n_isolates, g.n_components) == (8, 6, 2, 4)
    paths = {tuple(r.path) for r in graph.callee_paths(e, n.filter("name = 1"), 4).collect()}
    assert paths == {(1, 2, 3, 1, 2), (1, 2, 3, 4, 5)}
    up = spark.createDataFrame([("a", "b"), ("b", "a")], "child string, parent string")
    assert graph.inheritance_chain(up, spark.createDataFrame([("a",)], "name string")).first().chain == ["b", "a"]


def test_inheritance_chains_have_no_depth_limit(spark, tmp_path):
    """A line of 150 classes, a tail into a cycle, a class without parents; the query over keys of more binary digits than 20 levels hold."""
    from cairn.plans.registry import QUERIES

    up = spark.createDataFrame([(i, i + 1) for i in range(150)] + [(200, 201), (201, 202), (202, 203), (203, 201), (300, 300)], "child long, parent long")
    start = spark.createDataFrame([(0,), (149,), (150,), (200,), (202,), (300,)], "name long")
    got = {r.start: r.chain for r in graph.inheritance_chain(up, start).collect()}
    assert got == {0: list(range(150, -1, -1)), 149: [150, 149], 150: [150], 200: [203, 202, 201, 200], 202: [201, 203, 202], 300: [300]}
    keys = [0, 1, 5, 524287, 524288, 1199999, 2**40]
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    want = {k: ">".join(str(k >> i) for i in range(k.bit_length(), -1, -1)) for k in keys}
    assert {r.start: r.chain for r in QUERIES["GRF08_inheritance_chain"](spark, str(tmp_path)).collect()} == want


def test_upsert_null_keys_and_order(spark):
    old = spark.createDataFrame([(None, "a", 1), ("x", "b", 1)], "k string, v string, seq int")
    new = spark.createDataFrame([(None, "c", 0), ("y", "d", 0)], "k string, v string, seq int")
    assert {(r.k, r.v) for r in incremental.upsert(old, new, ["k"]).collect()} == {(None, "c"), ("x", "b"), ("y", "d")}


def test_budget_and_cache(spark):
    b = shaping.TokenBudget({"a": 10})
    assert b.allocate("a", 8) and not b.allocate("a", 3) and b.triggered == {"a"} and b.is_over("a") and b.remaining("a") == 2
    assert b.statistics()["total"]["utilisation"] == "80.0%"
    b.reset("a")
    assert b.utilisation("a") == 0
    df = spark.createDataFrame([(f"n{i}", "m" * 50) for i in range(9)], "name string, other string")
    assert shaping.TokenBudget({"a": 10}).optimise(df, "a", ["name"]).collect()[0].n_total == 9
    now = [0.0]
    c = shaping.ResultCache(10, lambda: now[0])
    ref = c.store(list(range(9)))
    assert c.retrieve(ref) == list(range(9)) and c.summary(ref) == {"count": 9, "sample": [0, 1, 2]}
    assert c.mask(list(range(9)))["total"] == 9 and c.mask([1]) == [1]
    assert c.statistics()["accesses"] == 1
    now[0] = 11
    assert c.retrieve(ref) is None and c.cleanup_expired() == 1
    with pytest.raises(ValueError):
        shaping.query_class(df, df, "x", "all")


def test_expressions_on_nulls(spark):
    df = spark.createDataFrame([(None, None, None), ("", [], 0)], "s string, a array<string>, n int")
    out = df.select(X.or_empty("a").alias("a"), X.from_list_text("s").alias("l"), X.first_filled("s").alias("f"), X.union_sorted("a", "a").alias("u"), X.primary_parent("a").alias("p"), X.used_class("s").alias("c"), X.normal_path("s").alias("np")).collect()
    assert all(r.a == [] and r.l == [] and r.f == "" and r.u == [] and r.p is None and r.c is None for r in out)


def test_empty_tables(spark):
    m = spark.createDataFrame([], "name string, hash string")
    assert joins.diff(m, m).count() == 0 and incremental.check(m, m).count() == 0
    ln = spark.createDataFrame([("f", None)], "file string, text string")
    assert sequence.lines(ln, "file").collect()[0].line == ""
    assert sequence.with_context(sequence.lines(ln, "file"), "file").first().context_before == ""


def test_queries_and_oracles_have_equal_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 150


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0


def test_graphs_without_sql_hold_all_orders(spark):
    from cairn.plans import bindings as B
    from cairn.plans.registry import QUERIES

    d = "/root/testdata/sf0.001"
    orders = {}
    for r in sorted(B.table(spark, d, "lineitem").collect(), key=lambda r: (r.l_linenumber, r.l_partkey, r.l_suppkey, r.l_extendedprice)):
        orders.setdefault(r.l_orderkey, []).append(r.l_partkey)
    edges = {e for p in orders.values() for e in zip(p, p[1:])}
    pairs = lambda df: {(r.src, r.dst) for r in df.collect()}
    assert pairs(B.calls(spark, d)) == edges and pairs(B.dag(spark, d)) == {(a, b) for a, b in edges if b > a}
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)

    def reach(x):
        seen, todo = {x}, [x]
        while todo:
            new = out.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        return seen

    to = {x: reach(x) for e in edges for x in e}
    want = {frozenset(y for y in to[x] if x in to[y]) for x in to}
    got = {}
    for r in QUERIES["GRF17_strong_components"](spark, d).collect():
        got.setdefault(r.component, set()).add(r.name)
    assert {c for c in map(frozenset, got.values()) if len(c) > 1} == {c for c in want if len(c) > 1}


def test_update_leaves_no_stale_rows(spark, tree, tmp_path):
    """An enum that goes, a module that goes, one with an odd name that comes; settings are read back; folders are checked by partition."""
    from cairn.plans.build import partition_status

    out = str(tmp_path / "kb")
    b = Build(spark, tree, out)
    assert not any(isinstance(v, str) for v in b.run().values())
    ix = Index.load(spark, out)
    assert ix.get_kb_info() == {"kb_version": "1", "engine_version": "5.3", "build_mode": "engine", "plugin_name": ""}
    assert json.loads(ix.run("get_kb_info"))["engine_version"] == "5.3"
    assert [r.name for r in ix.enums.collect()] == ["EKind"]
    thing = os.path.join(tree, "Engine/Source/Runtime/Core/Public/Thing.h")
    with open(thing) as f:
        text = f.read()
    with open(thing, "w") as f:
        f.write(text[: text.index("UENUM")])
    os.remove(os.path.join(tree, "Engine/Plugins/FX/Spark/Source/Spark/Spark.Build.cs"))
    os.makedirs(os.path.join(tree, "Engine/Source/Runtime/New"))
    for name, content in (("New.Build.cs", "// none"), ("New.h", "class ANew {};\n")):
        with open(os.path.join(tree, "Engine/Source/Runtime/New", name), "w") as f:
            f.write(content)
    assert b.check() == {"unchanged": 1, "modified": 1, "added": 1, "removed": 1}
    assert b.update() == {"unchanged": 1, "modified": 1, "added": 1, "removed": 1}
    ix = Index.load(spark, out)
    assert ix.enums.count() == 0 and {r.name for r in ix.classes.collect()} == {"UThing", "ANew"}
    assert {r.name for r in ix.modules.collect()} == {"Core", "Base", "New"} and b.read("failures").count() == 0
    assert {r.module for r in b.read("files").select("module").distinct().collect()} == {"Core", "New"}
    assert {r.part: (r.n_modules, r.n_parsed) for r in partition_status(b).collect()} == {"Runtime": (3, 2)}
    assert b.update() == {"unchanged": 3}


def test_a_file_that_breaks_the_parser_is_a_failure(spark, monkeypatch):
    from cairn.functions import parsing

    df = spark.createDataFrame([(1, "class AOne {};"), (2, None)], "id int, text string")
    parsed = parsing.parse_all(df)
    assert [r.name for r in parsing.of_kind(parsed, "classes").collect()] == ["AOne"] and parsing.of_kind(parsed, "failures").count() == 0
    monkeypatch.setattr(parsing.cpp, "parse", lambda t: {}[t])
    assert parsing._tried("x", "classes") == ([], "KeyError: 'x'") and parsing._tried("x", "failures")[1] == "KeyError: 'x'"


def test_legacy_registry(spark, tmp_path):
    (tmp_path / "old.json").write_text(json.dumps({"A": {"name": "A", "category": "Runtime", "dependencies": ["B"]}, "B": {"category": "Editor", "file_count": 3}}))
    old = files.legacy_registry(spark, str(tmp_path / "old.json"))
    assert {r.name: (r.category, r.dependencies, r.file_count) for r in old.collect()} == {"A": ("Runtime", ["B"], None), "B": ("Editor", [], 3)}
    now = old.filter("name = 'A'").selectExpr("name", "'New' AS category", *[c for c in old.columns if c not in ("name", "category")])
    merged = files.import_legacy(spark, str(tmp_path / "old.json"), now)
    assert {r.name: r.category for r in merged.collect()} == {"A": "New", "B": "Editor"}
    assert files.import_legacy(spark, str(tmp_path / "old.json"), merged).count() == 2 and files.import_legacy(spark, str(tmp_path / "old.json"), None).count() == 2


def test_storage(spark, tmp_path):
    from cairn.sources import storage

    p = str(tmp_path / "a" / "b.txt")
    storage.write_text(spark, p, "é\n")
    assert storage.read_text(spark, p) == "é\n" and storage.exists(spark, p) and storage.names(spark, str(tmp_path / "a")) == ["b.txt"]
    assert storage.delete(spark, str(tmp_path / "a")) and not storage.exists(spark, p) and storage.names(spark, str(tmp_path / "a")) == []
    spark.createDataFrame([("x/y=1",)], "module string").selectExpr("module", "1 AS v").write.partitionBy("module").parquet(str(tmp_path / "t"))
    assert storage.partition("module", "x/y=1") in storage.names(spark, str(tmp_path / "t"))


def test_narrow_edges_stay_in_many_tasks(spark):
    """Distinct edges are not merged into one task because their bytes compress well; more input makes more tasks."""
    from cairn.operators.iterate import TASK_BYTES, dealt

    calls = spark.range(20_000).selectExpr("id % 5000 AS caller", "id % 5000 + 1 AS callee")
    e = graph.call_graph(calls.unionByName(calls))
    assert e.count() == 5000
    assert e.groupBy(F.spark_partition_id()).count().count() == spark.sparkContext.defaultParallelism
    assert dealt(spark.range(20 * TASK_BYTES // 8), "id").rdd.getNumPartitions() == 20


def test_walks_by_numbers_and_by_joins_agree(spark, monkeypatch):
    """Random graphs with and without cycles, blocks of few edges, a chain of falling names; the walk by joins is only for more nodes than fit."""
    import random

    from cairn.operators import dense

    monkeypatch.setattr(dense, "BLOCK", 40)
    rnd = random.Random(3)
    cyclic = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(90)] + [(100 - i, 99 - i) for i in range(30)]
    df = spark.createDataFrame(cyclic, "src long, dst long")
    acyclic = df.filter("src < dst")
    to = {}
    for a, b in cyclic:
        to.setdefault(a, set()).add(b)

    def reach(x):
        seen, todo = set(), [x]
        while todo:
            new = to.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        return seen

    far = {x: reach(x) for e in cyclic for x in e}
    want = {x: max([x, *(y for y in far[x] if x in far[y])]) for x in far}
    level = {}
    for a, b in sorted(p for p in cyclic if p[0] < p[1]):
        level[b] = max(level.get(b, 0), level.get(a, 0) + 1)
    with monkeypatch.context() as m:
        m.setattr(graph, "_strong_by_joins", None)
        m.setattr(graph, "_longest_by_joins", None)
        assert {r.name: r.component for r in graph.strong_components(df).collect()} == want
        assert graph.longest_path(acyclic) == max(level.values()) and graph.longest_path(df) is None
        assert graph.call_statistics(acyclic).first().longest_path == str(max(level.values()))
        assert graph.strong_components(df.filter("1 = 0")).count() == 0
    monkeypatch.setattr(dense, "LIMIT", 10)
    assert graph.longest_path(acyclic) == max(level.values())
    small = [p for p in cyclic if max(p) < 25]
    a = {frozenset(v) for v in _groups(graph.strong_components(spark.createDataFrame(small, "src long, dst long")))}
    monkeypatch.setattr(dense, "LIMIT", 1000)
    assert a == {frozenset(v) for v in _groups(graph.strong_components(spark.createDataFrame(small, "src long, dst long")))}


def _groups(components):
    out = {}
    for r in components.collect():
        out.setdefault(r.component, set()).add(r.name)
    return out.values()


def test_first_json_object_of_any_depth_and_length(spark):
    """Nested deeper than the regex goes, long strings and lists, unclosed ones; plans without a fold over characters."""
    long = '{"k": "' + 'x\\"}' * 50_000 + '"}'
    cases = {'a}"{"a": "}"} {x': '{"a": "}"}', "{" * 6 + '"}"' + "}" * 6 + "}": "{" * 6 + '"}"' + "}" * 6, "{{}": None, '{"a': None, "": None, "no": None, long + "{": long, '{{{{"a\\\\"}}}}': '{{{{"a\\\\"}}}}'}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "text string, want string")
    got = df.select("text", "want", X.first_json_object("text").alias("got"))
    assert got.filter(~F.col("want").eqNullSafe(F.col("got"))).count() == 0
    assert "split(" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_params_are_split_once_and_not_by_character(spark):
    """Parts of odd brackets as before; flags do not split the text again for each word of the vocabulary."""
    cases = {"a, b<c, d>, (e, [f]), g": ["a", "b<c, d>", "(e, [f])", "g"], ")a,(b,c": [")a", "(b,c"], "é<1,2>,ü": ["é<1,2>", "ü"], "a,,b ": ["a", "b"], "": [], None: None}
    df = spark.createDataFrame(list(cases.items()), "text string, want array<string>")
    assert df.filter(~F.col("want").eqNullSafe(X.split_params("text"))).count() == 0
    flags = spark.createDataFrame([('Transient, X="Abstract, y", meta=(A="b", Config="c"), Abstract',), ("",), (None,)], "text string").select(X.specifier_flags("text", "class").alias("f"))
    assert [r.f for r in flags.collect()] == [["Abstract", "Transient"], [], []]
    plan = flags._jdf.queryExecution().optimizedPlan().toString()
    assert "array_contains" not in plan


def test_implementation_files_are_chosen_by_header(spark):
    """The same stem first, else the first path, a null path last; one choice a header whatever declares it, without a sorted window over declarations and sources."""
    decl = spark.createDataFrame([("F", "h/A.h"), ("F", "h/A.h"), ("G", "h/A.h"), ("H", "h/B.h"), ("I", "h/None.h"), ("J", "h/C.h")], "name string, header string")
    src = spark.createDataFrame([("h/A.h", "c/0.cpp"), ("h/A.h", "c/A.cpp"), ("h/A.h", "z/A.cpp"), ("h/B.h", None), ("h/B.h", "c/2.cpp"), ("h/B.h", "c/1.cpp"), ("h/B.h", "c/1.cpp"), ("h/C.h", None)], "header string, cpp string")
    out = joins.implementation_file(decl, src)
    assert sorted(map(tuple, out.collect()), key=str) == [("F", "h/A.h", "c/A.cpp"), ("G", "h/A.h", "c/A.cpp"), ("H", "h/B.h", "c/1.cpp"), ("J", "h/C.h", None)]
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
