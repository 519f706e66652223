"""Queries for graphs, commands, result shaping and incremental operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import expr as X
from cairn.operators import graph, incremental, joins, shaping

from . import bindings as B
from .commands import Index
from .registry import query

_C, _F, _E, _M = f"WITH {B.CLASSES}", f"WITH {B.FUNCTIONS}", f"WITH {B.ENUMS}", f"WITH {B.MODULES}"
_START = "start AS (SELECT p_partkey AS name FROM part WHERE p_partkey IN (7, 11, 42))"


def _start(s, d):
    return B.parts(s, d).filter("name in (7, 11, 42)")


@query("GRF01_dependency_graph", f"{_M} SELECT DISTINCT name AS src, dst FROM (SELECT name, unnest(dependencies) AS dst FROM modules) WHERE dst IN (SELECT name FROM modules)")
def _(s, d):
    return joins.dependency_edges(B.modules(s, d))


@query("GRF02_direct_dependents", f"WITH {B.DAG} SELECT dst AS name, count(*) AS n FROM dag GROUP BY 1")
def _(s, d):
    return B.dag(s, d).groupBy(F.col("dst").alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query("GRF03_layers", f"WITH {B.DAG}, i AS (SELECT dst AS name, count(*) AS n_in FROM dag GROUP BY 1), o AS (SELECT src AS name, count(*) AS n_out FROM dag GROUP BY 1) SELECT p_partkey AS name, coalesce(n_in, 0) AS n_in, coalesce(n_out, 0) AS n_out, CASE WHEN n_in IS NULL AND n_out IS NULL THEN 'isolated' WHEN n_in IS NULL THEN 'bottom' WHEN n_out IS NULL THEN 'top' ELSE 'middle' END AS layer FROM part LEFT JOIN i ON i.name = p_partkey LEFT JOIN o ON o.name = p_partkey")
def _(s, d):
    return graph.layers(B.parts(s, d), B.dag(s, d))


@query("GRF04_class_graph", f"{_C} SELECT module, 'class_' || name AS src, 'class_' || p AS dst, 'inherits' AS type FROM (SELECT module, name, unnest(parent_classes) AS p FROM classes) UNION ALL SELECT module, 'class_' || name, 'class_' || i, 'implements' FROM (SELECT module, name, unnest(interfaces) AS i FROM classes)")
def _(s, d):
    return graph.class_graph(B.classes(s, d))[1]


@query("GRF05_module_graph", "SELECT type, count(*) * (SELECT count(*) FROM part) AS n FROM (VALUES ('contains'), ('contains'), ('inherits'), ('implements'), ('has_method'), ('has_method'), ('includes')) t(type) GROUP BY 1")
def _(s, d):
    from cairn.functions.parsing import of_kind, parse_all
    from cairn.operators.iterate import materialize

    from .q_text import _CLASS

    p = B.table(s, d, "part").repartition(s.sparkContext.defaultParallelism).selectExpr("p_brand AS module", "concat('f', p_partkey) AS path", f"{_CLASS} AS text")
    parsed = materialize(parse_all(p))
    nodes, edges = graph.module_graph(*[of_kind(parsed, k) for k in ("classes", "functions", "enums", "delegates", "includes")])
    return edges.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("GRF06_add_nodes", "SELECT DISTINCT p_partkey AS name FROM part UNION SELECT -1")
def _(s, d):
    return graph.add(B.parts(s, d), s.range(1).select((F.col("id") - 1).alias("name")))


@query("GRF07_neighbours", f"WITH {B.DAG} SELECT dst AS node FROM dag WHERE src = 11")
def _(s, d):
    return joins.neighbours(B.dag(s, d).withColumn("type", F.lit("calls")), 11, "out", "calls").select("node")


@query("GRF08_inheritance_chain", "WITH RECURSIVE r AS (SELECT p_partkey AS start, p_partkey AS cur, 0 AS lvl FROM part UNION ALL SELECT start, cur // 2, lvl + 1 FROM r WHERE cur > 0) SELECT start, string_agg(cur::VARCHAR, '>' ORDER BY lvl DESC) AS chain FROM r GROUP BY 1")
def _(s, d):
    p = B.parts(s, d)
    # parents lead on through keys that are no part, and a key that is there n times repeats n times, as in the SQL
    up = p.filter("name > 0").select(F.explode(F.expr("transform(sequence(0, cast(log2(name) AS int) + 1), i -> shiftright(name, i))")).alias("child")).filter("child > 0").distinct()
    n = p.filter("name is not null").groupBy("name").agg(F.count(F.lit(1)).cast("int").alias("n"))
    c = graph.inheritance_chain(up.selectExpr("child", "child div 2 AS parent"), n).join(n, F.col("start") == F.col("name"))
    return c.select("start", F.array_join(F.flatten(F.transform("chain", lambda x: F.array_repeat(x.cast("string"), F.col("n")))), ">").alias("chain"))


@query("GRF09_hierarchy", "WITH RECURSIVE r(start, name, level) AS (SELECT p_partkey, p_partkey, 0 FROM part UNION ALL SELECT start, name // 2, level + 1 FROM r WHERE name > 0 AND level < 2) SELECT start, level, name FROM r")
def _(s, d):
    p = B.parts(s, d)
    return graph.hierarchy(p.filter("name > 0").selectExpr("name AS child", "name div 2 AS parent"), p)


@query("GRF10_subclasses", f"{_C} SELECT name FROM classes WHERE list_contains(parent_classes, 'Part5') ORDER BY name LIMIT 100")
def _(s, d):
    c = B.classes(s, d)
    return Index(None, c, None).query_subclasses("Part5").select("name")



@query("GRF11_graph_statistics", f"""WITH RECURSIVE {B.DAG}, e AS MATERIALIZED (SELECT src, dst FROM dag UNION SELECT dst, src FROM dag), r(a, b) AS (SELECT p_partkey, p_partkey FROM part UNION SELECT r.a, e.dst FROM r JOIN e ON r.b = e.src),
 m AS (SELECT a, min(b) AS component, count(*) AS n FROM r GROUP BY a) SELECT count(*) AS n_nodes, (SELECT count(*) FROM dag) AS n_edges, count(*) FILTER (WHERE n = 1) AS n_isolates, count(DISTINCT component) AS n_components FROM m""")
def _(s, d):
    return graph.statistics(B.parts(s, d), B.dag(s, d))


@query("GRF11_isolates", f"WITH {B.DAG} SELECT p_partkey AS name FROM part WHERE p_partkey NOT IN (SELECT src FROM dag UNION SELECT dst FROM dag)")
def _(s, d):
    return graph.isolates(B.parts(s, d), B.dag(s, d))


@query("GRF11_components", "WITH RECURSIVE f(name, comp) AS (SELECT p_partkey, p_partkey FROM part WHERE p_partkey % 7 = 0 UNION ALL SELECT name + 1, comp FROM f WHERE (name + 1) % 7 <> 0 AND name + 1 <= (SELECT max(p_partkey) FROM part)) SELECT name, comp AS component FROM f")
def _(s, d):
    p = B.parts(s, d)
    return graph.weak_components(p, p.filter("name % 7 <> 0").selectExpr("name AS src", "name - 1 AS dst"))


@query("GRF12_verify", f"WITH {B.DAG}, n AS (SELECT p_partkey FROM part WHERE p_size > 10) SELECT 'isolate' AS problem, p_partkey AS name FROM n WHERE p_partkey NOT IN (SELECT src FROM dag UNION SELECT dst FROM dag) UNION ALL SELECT DISTINCT 'dangling', dst FROM dag WHERE dst NOT IN (SELECT p_partkey FROM n)")
def _(s, d):
    return graph.verify(B.table(s, d, "part").filter("p_size > 10").select(F.col("p_partkey").alias("node_id")), B.dag(s, d))


@query("GRF13_call_graph", f"WITH {B.CALLS} SELECT src, dst FROM calls")
def _(s, d):
    c = B.calls(s, d).select(F.col("src").alias("caller"), F.col("dst").alias("callee"))
    return graph.call_graph(c.unionByName(c))


@query("GRF14_caller_paths", f"WITH {B.DAG}, start AS (SELECT p_partkey AS name FROM part ORDER BY 1 DESC LIMIT 3), a AS (SELECT name, src AS c1 FROM start JOIN dag ON dst = name), b AS (SELECT a.*, src AS c2 FROM a LEFT JOIN dag ON dst = c1) SELECT CASE WHEN c2 IS NULL THEN c1 || '>' || name ELSE c2 || '>' || c1 || '>' || name END AS path FROM b")
def _(s, d):
    p = graph.caller_paths(B.dag(s, d), B.parts(s, d).orderBy(F.desc("name")).limit(3))
    return p.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query("GRF15_callee_paths", f"WITH {B.CALLS}, {_START}, a AS (SELECT name, dst AS c1 FROM start JOIN calls ON src = name), b AS (SELECT a.*, dst AS c2 FROM a LEFT JOIN calls ON src = c1) SELECT CASE WHEN c2 IS NULL THEN name || '>' || c1 ELSE name || '>' || c1 || '>' || c2 END AS path FROM b")
def _(s, d):
    p = graph.callee_paths(B.calls(s, d), _start(s, d))
    return p.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query("GRF16_distances", f"WITH RECURSIVE {B.DAG}, r(name, n) AS (SELECT 7::BIGINT, 0 UNION SELECT dst, n + 1 FROM r JOIN dag ON src = name WHERE n < 5) SELECT name, min(n)::INT AS n_steps FROM r GROUP BY 1")
def _(s, d):
    return graph.distances(B.dag(s, d), 7)


_SCC = f"""WITH RECURSIVE {B.CALLS}, e AS MATERIALIZED (SELECT src, dst FROM calls WHERE src <> dst), n AS (SELECT src AS name FROM calls UNION SELECT dst FROM calls), r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON r.b = e.src),
 scc AS (SELECT name, greatest(name, coalesce(top, name)) AS component FROM n LEFT JOIN (SELECT x.a, max(x.b) AS top FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a) ON a = name)"""


@query("GRF17_strong_components", f"{_SCC} SELECT name, component FROM scc")
def _(s, d):
    return graph.strong_components(B.calls(s, d))


@query("GRF17_call_statistics", f"""{_SCC} SELECT count(*) AS n_nodes, count(DISTINCT component) AS n_components, (SELECT count(*) FROM calls) AS n_edges, count(*) FILTER (WHERE name NOT IN (SELECT src FROM e UNION SELECT dst FROM e)) AS n_isolates,
 CASE WHEN EXISTS (SELECT 1 FROM calls WHERE src = dst) OR count(DISTINCT component) < count(*) THEN 'N/A' END AS longest_path FROM scc""")
def _(s, d):
    return graph.call_statistics(B.calls(s, d))


@query("GRF17_longest_path", f"WITH RECURSIVE {B.DAG}, e AS MATERIALIZED (SELECT src, dst FROM dag), r(name, n) AS (SELECT src, 0 FROM e UNION SELECT e.dst, n + 1 FROM r JOIN e ON r.name = e.src) SELECT max(n)::BIGINT AS longest_path FROM r")
def _(s, d):
    return s.createDataFrame([(graph.longest_path(B.dag(s, d)),)], "longest_path long")


@query("GRF18_sources_of_header", "SELECT DISTINCT 'c' || o_custkey AS cpp FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_suppkey = 7")
def _(s, d):
    r = B.table(s, d, "orders").join(B.table(s, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.concat(F.lit("h"), "l_suppkey").alias("header"), F.concat(F.lit("c"), "o_custkey").alias("cpp"))
    return joins.sources_of_headers(r).filter("header = 'h7'").select(F.explode("cpps").alias("cpp"))


# ---------------------------------------------------------------- commands


def _index(s, d):
    return Index(B.modules(s, d), B.classes(s, d), B.functions(s, d), B.enums(s, d))


@query("CMD01_class_info", f"{_C} SELECT name, module, line_number FROM classes WHERE name = 'Part9' ORDER BY is_uclass DESC, module, line_number LIMIT 1")
def _(s, d):
    return _index(s, d).query_class_info("Part9").select("name", "module", "line_number")


@query("CMD02_class_hierarchy", "SELECT 'Part100' AS start, level, 'Part' || n AS name, 'Mod' || regexp_extract(p_brand, '([0-9]+)', 1) AS module FROM (VALUES (0, 100), (1, 50), (2, 25)) t(level, n) JOIN part ON p_partkey = n")
def _(s, d):
    return _index(s, d).query_class_hierarchy("Part100")


@query("CMD03_module_dependencies", f"{_M} SELECT name, array_to_string(dependencies, ',') AS deps FROM modules WHERE name = 'Supplier#000000005'")
def _(s, d):
    return _index(s, d).query_module_dependencies("Supplier#000000005").select("name", F.array_join("dependencies", ",").alias("deps"))


@query("CMD04_module_classes", f"{_C} SELECT name FROM classes WHERE module = 'Mod7' AND is_uclass ORDER BY name, line_number LIMIT 100")
def _(s, d):
    return _index(s, d).query_module_classes("Mod7", "uclass").select("name")


@query("CMD05_function_info", f"{_F} SELECT name, module, file_path, line_number FROM functions WHERE name = 'Fn21' ORDER BY is_blueprint_callable DESC, module, file_path, line_number LIMIT 20")
def _(s, d):
    return _index(s, d).query_function_info("Fn21").select("name", "module", "file_path", "line_number")


@query("CMD07_search_functions", f"{_F} SELECT name, module, file_path, line_number FROM functions WHERE contains(lower(name), 'fn19') ORDER BY is_blueprint_callable DESC, name, module, file_path, line_number LIMIT 50")
def _(s, d):
    return _index(s, d).search_functions("FN19").select("name", "module", "file_path", "line_number")


@query("CMD08_search_classes", f"{_C} SELECT name, module FROM classes WHERE contains(lower(name), 't19') ORDER BY is_uclass DESC, name, module, line_number LIMIT 50")
def _(s, d):
    return _index(s, d).search_classes("t19").select("name", "module")


@query("CMD09_search_modules", f"{_M} SELECT name, category, path, (SELECT count(*) FROM modules WHERE contains(name, '00001')) AS n_hits FROM modules WHERE contains(name, '00001') ORDER BY name LIMIT 50")
def _(s, d):
    return _index(s, d).search_modules("00001")


@query("CMD10_subclasses", f"{_C} SELECT name, module FROM classes WHERE list_contains(parent_classes, 'Part33') ORDER BY name LIMIT 100")
def _(s, d):
    return _index(s, d).query_subclasses("Part33").select("name", "module")


@query("CMD11_module_dependents", f"{_M} SELECT name, category FROM modules WHERE list_contains(dependencies, 'Supplier#000000009') ORDER BY name LIMIT 200")
def _(s, d):
    return _index(s, d).query_module_dependents("Supplier#000000009")


@query("CMD12_enum_info", f"{_E} SELECT name, module, len(values)::INT AS n FROM enums WHERE name = 'E4' ORDER BY is_uenum DESC, module LIMIT 20")
def _(s, d):
    return _index(s, d).query_enum_info("E4").select("name", "module", F.size("values").alias("n"))


@query("CMD13_search_enums", f"{_E} SELECT name, module FROM enums WHERE contains(lower(name), 'e1') ORDER BY is_uenum DESC, name, module LIMIT 50")
def _(s, d):
    return _index(s, d).search_enums("E1").select("name", "module")


@query("CMD15_statistics", f"{_M} SELECT coalesce(category, 'Unknown') AS category, count(*) AS n FROM modules GROUP BY 1")
def _(s, d):
    return _index(s, d).get_statistics()


@query("CMD19_routed_question", f"{_M} SELECT coalesce(category, 'Unknown') AS category, count(*) AS n FROM modules GROUP BY 1")
def _(s, d):
    return _index(s, d).ask("Give me an overview")


# ---------------------------------------------------------------- result shaping


@query("SHP01_class_summary", f"{_C} SELECT name, module, parent_classes[1] AS parent, len(methods)::INT AS method_count, array_to_string(methods[1:5], ',') AS methods, 'ref_' || md5('class::' || module || '::' || name)[1:8] AS ref FROM classes")
def _(s, d):
    return shaping.class_summary(B.classes(s, d)).withColumn("methods", F.array_join("methods", ","))


@query("SHP02_class_details", f"{_C} SELECT name, module, file_path FROM classes WHERE name = 'Part17'")
def _(s, d):
    return shaping.class_details(B.classes(s, d), "Part17").select("name", "module", "file_path")


@query("SHP03_class_source", f"{_C}, files AS (SELECT p_brand || '/' || p_name || '.h' AS file_path, min(p_type) AS text FROM part GROUP BY 1) SELECT name, file_path, text AS source FROM classes JOIN files USING (file_path) WHERE name = 'Part17'")
def _(s, d):
    files = B.table(s, d, "part").groupBy(F.concat("p_brand", F.lit("/"), "p_name", F.lit(".h")).alias("file_path")).agg(F.min("p_type").alias("text"))
    return shaping.query_class(B.classes(s, d), files, "Part17", "source")


@query("SHP05_function_summary", f"{_F} SELECT name, module, file_path, line_number, count(*) OVER (PARTITION BY name) AS n_matches FROM functions QUALIFY row_number() OVER (PARTITION BY name ORDER BY module, file_path, line_number, price, quantity) = 1")
def _(s, d):
    return shaping.function_summary(B.functions(s, d), ["module", "file_path", "line_number", "price", "quantity"]).select("name", "module", "file_path", "line_number", "n_matches")


@query("SHP06_function_details", f"{_F} SELECT name, module, class_name, return_type, file_path || ':' || line_number AS location FROM functions WHERE name = 'Fn3'")
def _(s, d):
    return shaping.function_details(B.functions(s, d).filter("name = 'Fn3'"))


@query("SHP08_mask", f"{_C} SELECT name, (SELECT count(*) FROM classes WHERE module = 'Mod3') AS n_total, (SELECT count(*) FROM classes WHERE module = 'Mod3') > 5 AS masked FROM classes WHERE module = 'Mod3' ORDER BY name LIMIT 5")
def _(s, d):
    return shaping.mask(B.classes(s, d).filter("module = 'Mod3'"), ["name"]).select("name", "n_total", "masked")


@query("SHP10_summary", "SELECT doc_id, CASE WHEN length(text) > 100 THEN text[1:100] || '...' ELSE text END AS summary FROM documents")
def _(s, d):
    return B.table(s, d, "documents").select("doc_id", shaping.summary_of("text").alias("summary"))


_GREEDY = """WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn, (length(text) // 4)::BIGINT AS c FROM conversations), r AS (SELECT conv_id, 0::BIGINT AS rn, 0::BIGINT AS used, 0::BIGINT AS n FROM (SELECT DISTINCT conv_id FROM t) UNION ALL SELECT r.conv_id, t.rn, CASE WHEN used + c <= 200 THEN used + c ELSE used END, CASE WHEN used + c <= 200 THEN n + 1 ELSE n END FROM r JOIN t ON t.conv_id = r.conv_id AND t.rn = r.rn + 1)
 SELECT conv_id, arg_max(used, rn) AS used, arg_max(n, rn) AS n_allowed FROM r GROUP BY 1"""


@query("SHP11_greedy_budget", _GREEDY)
def _(s, d):
    return shaping.greedy_budget(B.table(s, d, "conversations").select("conv_id", "turn", X.text_tokens("text").alias("tokens")), "conv_id", "turn", "tokens", 200)


@query("SHP12_compressed_list", f"{_C} SELECT name, module, (SELECT count(*) FROM classes) AS n_total FROM classes ORDER BY name LIMIT 3")
def _(s, d):
    c = B.classes(s, d)
    return shaping.mask(shaping.key_fields(c), ["name"], 3).select("name", "module", "n_total")


# ---------------------------------------------------------------- incremental


@query("INC01_module_hash", "SELECT source AS name, sha256(string_agg(p, chr(10) ORDER BY p)) AS hash, count(*) AS file_count FROM (SELECT source, 'd' || doc_id || ':' || sha256(text) AS p FROM documents) GROUP BY 1")
def _(s, d):
    return incremental.manifest(B.table(s, d, "documents").select(F.col("source").alias("module"), F.concat(F.lit("d"), "doc_id").alias("path"), F.sha2(F.col("text"), 256).alias("sha256")))


@query("INC02_diff", f"WITH {B.MANIFESTS} SELECT status, count(*) AS n FROM diff GROUP BY 1")
def _(s, d):
    return joins.diff(*B.manifests(s, d)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("INC03_check_only", f"WITH {B.MANIFESTS} SELECT status, count(*) AS n, array_to_string(list_sort(list(name))[1:10], ',') AS names FROM diff GROUP BY 1")
def _(s, d):
    return incremental.check(*B.manifests(s, d)).withColumn("names", F.array_join("names", ","))


@query("INC04_changed_modules", f"WITH {B.MANIFESTS} SELECT name FROM diff WHERE status IN ('added', 'modified')")
def _(s, d):
    return incremental.changed(*B.manifests(s, d))


@query("INC05_manifest_merge", f"WITH {B.MANIFESTS} SELECT name, hash FROM new")
def _(s, d):
    return incremental.merge(*B.manifests(s, d))


@query("INC06_resume", f"WITH {B.MANIFESTS} SELECT name FROM new EXCEPT SELECT name FROM old")
def _(s, d):
    o, n = B.manifests(s, d)
    return joins.still_to_do(n.select("name"), o)


@query("INC08_partitioned", f"{_M} SELECT CASE WHEN starts_with(category, 'Plugins.') THEN 'Plugins' ELSE category END AS part, count(*) AS n FROM (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'Plugins.' || category ELSE category END AS category FROM modules WHERE category IS NOT NULL) GROUP BY 1")
def _(s, d):
    m = B.modules(s, d).filter("category is not null").withColumn("category", F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("Plugins."), "category")).otherwise(F.col("category")))
    return m.groupBy(X.partition_of("category").alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query("INC09_stage_metrics", "SELECT event_type, count(*) AS n, CASE WHEN sum(value) = 0 THEN 0 ELSE round(count(*) / sum(value), 6) END AS speed FROM events GROUP BY 1")
def _(s, d):
    e = B.table(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))
    return e.select("event_type", "n", F.round(X.speed("n", "v"), 6).alias("speed"))


@query("ORC08_registry_upsert", f"{_M} SELECT name, CASE WHEN s_suppkey % 3 = 0 THEN '2024-02-01' ELSE indexed_at END AS indexed_at FROM modules")
def _(s, d):
    m = B.modules(s, d).select("name", "indexed_at", F.col("s_suppkey").alias("seq"))
    return incremental.upsert(m, m.filter("seq % 3 = 0").withColumn("indexed_at", F.lit("2024-02-01")), ["name"]).select("name", "indexed_at")


@query("ORC11_manifest", "SELECT source AS name, count(*) AS file_count FROM documents GROUP BY 1")
def _(s, d):
    return incremental.manifest(B.table(s, d, "documents").select(F.col("source").alias("module"), F.col("doc_id").cast("string").alias("path"), F.sha2(F.col("text"), 256).alias("sha256"))).select("name", "file_count")
