"""Queries for projections, filters, joins, aggregations, windows, sorts, sets and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import expr as X
from cairn.operators import incremental, joins, search, sequence, stats

from . import bindings as B
from .registry import query

_C, _F, _E, _M = f"WITH {B.CLASSES}", f"WITH {B.FUNCTIONS}", f"WITH {B.ENUMS}", f"WITH {B.MODULES}"

# ---------------------------------------------------------------- projections


@query("PRJ01_typed_record", f"{_M} SELECT name, len(public_dependencies)::INT AS n_public, coalesce(category, '') AS category, coalesce(file_count, 0)::BIGINT AS file_count FROM modules")
def _(s, d):
    return B.modules(s, d).select("name", F.size("public_dependencies").alias("n_public"), F.coalesce("category", F.lit("")).alias("category"), F.coalesce("file_count", F.lit(0)).cast("long").alias("file_count"))


@query("PRJ02_list_round_trip", f"{_M} SELECT name, '[' || array_to_string([('\"' || x || '\"') FOR x IN dependencies], ',') || ']' AS as_text, len(dependencies)::INT AS n FROM modules")
def _(s, d):
    m = B.modules(s, d).select("name", X.to_list_text("dependencies").alias("as_text"))
    return m.withColumn("n", F.size(X.from_list_text("as_text")))


@query("PRJ03_sparse_record", """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '{"name":"' || p_name || '","size":' || p_size || '}' ELSE '{"name":"' || p_name || '"}' END AS record FROM part""")
def _(s, d):
    return B.table(s, d, "part").select("p_partkey", F.to_json(F.struct(F.col("p_name").alias("name"), F.when(F.col("p_size") % 2 == 0, F.col("p_size")).alias("size")), {"ignoreNullFields": "true"}).alias("record"))


@query("PRJ04_field_reconciliation", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name WHEN p_size % 3 = 1 THEN p_brand ELSE '' END AS file FROM part")
def _(s, d):
    p = B.table(s, d, "part").withColumn("file", F.when(F.col("p_size") % 3 == 0, F.col("p_name")).otherwise("")).withColumn("file_path", F.when(F.col("p_size") % 3 == 1, F.col("p_brand")))
    return p.select("p_partkey", X.first_filled("file", "file_path").alias("file"))


@query("PRJ05_dependency_reconciliation", f"{_M} SELECT name, array_to_string(CASE WHEN len(public_dependencies) > 0 THEN public_dependencies ELSE private_dependencies END, ',') AS deps FROM modules")
def _(s, d):
    return B.modules(s, d).select("name", F.array_join(X.first_filled_list("public_dependencies", "private_dependencies"), ",").alias("deps"))


@query("PRJ06_module_columns", f"{_M} SELECT name, category, path FROM modules")
def _(s, d):
    return B.modules(s, d).select("name", "category", "path")


@query("PRJ07_key_fields", f"{_F} SELECT name, module FROM functions")
def _(s, d):
    from cairn.operators.shaping import key_fields

    return key_fields(B.functions(s, d))


@query("PRJ08_signature", f"{_F} SELECT name, line_number, file_path, return_type || ' ' || name || '(int32 A' || l_linenumber || ')' || CASE WHEN is_const THEN ' const' ELSE '' END AS signature FROM functions")
def _(s, d):
    return B.functions(s, d).select("name", "line_number", "file_path", X.signature("return_type", "name", "parameters", "is_const").alias("signature"))


@query("PRJ09_location", f"{_C} SELECT name, file_path || ':' || line_number AS location FROM classes")
def _(s, d):
    return B.classes(s, d).select("name", X.location("file_path", "line_number").alias("location"))


@query("PRJ10_summary_columns", f"{_M} SELECT name, file_count, estimated_lines FROM modules")
def _(s, d):
    return B.modules(s, d).select("name", "file_count", "estimated_lines")


# ---------------------------------------------------------------- filters


@query("FLT01_point_lookup", f"{_M} SELECT name, category FROM modules WHERE name = 'Supplier#000000007'")
def _(s, d):
    return search.lookup(B.modules(s, d), "Supplier#000000007").select("name", "category")


@query("FLT02_name_and_module_hint", f"{_F} SELECT name, module, file_path, line_number, is_blueprint_callable FROM functions WHERE name = 'Fn7' AND contains(lower(module), 'mod1')")
def _(s, d):
    return search.by_name(B.functions(s, d), "Fn7", "is_blueprint_callable", "mod1").select("name", "module", "file_path", "line_number", "is_blueprint_callable")


@query("FLT03_keyword_search", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'widget') ORDER BY (p_type = 'PROMO') DESC, p_name, p_partkey LIMIT 50")
def _(s, d):
    p = B.table(s, d, "part").withColumn("promo", F.col("p_type") == "PROMO")
    return search.by_keyword(p, "WIDGET", "promo", 50, "p_name", ("p_partkey",)).select("p_partkey", "p_name")


@query("FLT04_module_keyword", f"{_M} SELECT name, category FROM modules WHERE contains(lower(name), '0001') ORDER BY name LIMIT 50")
def _(s, d):
    return search.by_keyword(B.modules(s, d), "0001").select("name", "category")


@query("FLT05_counted_keyword", f"{_M} SELECT name, category, path, (SELECT count(*) FROM modules WHERE contains(lower(name), '#00000000')) AS n_hits FROM modules WHERE contains(lower(name), '#00000000') ORDER BY name, category, path LIMIT 50")
def _(s, d):
    return search.by_keyword_counted(B.modules(s, d), "#00000000", keep=("category", "path"))


@query("FLT06_by_module", f"{_C} SELECT name, line_number FROM classes WHERE module = 'Mod4'")
def _(s, d):
    return search.by_module(B.classes(s, d), "Mod4").select("name", "line_number")


@query("FLT07_subclasses", f"{_C} SELECT name, module FROM classes WHERE list_contains(parent_classes, 'Part12') ORDER BY name LIMIT 100")
def _(s, d):
    return search.subclasses(B.classes(s, d), "Part12").select("name", "module")


@query("FLT08_enum_value_search", f"{_E} SELECT name, module FROM enums WHERE len(list_filter(values, lambda v: contains(lower(v), 'red'))) > 0 ORDER BY name, module LIMIT 50")
def _(s, d):
    return search.by_value(B.enums(s, d), "RED").select("name", "module")


@query("FLT09_flagged", f"{_C} SELECT name, module FROM classes WHERE is_blueprintable ORDER BY name, module LIMIT 100")
def _(s, d):
    return search.flagged(B.classes(s, d), "is_blueprintable").select("name", "module")


@query("FLT10_category", f"{_M} SELECT name FROM modules WHERE category = 'NATION_3'")
def _(s, d):
    return search.by_category(B.modules(s, d), "NATION_3").select("name")


@query("FLT11_category_prefix", f"{_M} SELECT name, category FROM modules WHERE starts_with(category, 'NATION_1')")
def _(s, d):
    return search.by_category(B.modules(s, d), "NATION_1", prefix=True).select("name", "category")


@query("FLT12_module_classes", f"{_C} SELECT name, line_number, (SELECT count(*) FROM classes WHERE module = 'Mod4' AND is_struct) AS n_total FROM classes WHERE module = 'Mod4' AND is_struct ORDER BY name, line_number LIMIT 100")
def _(s, d):
    return search.module_classes(B.classes(s, d), "Mod4", "struct").select("name", "line_number", "n_total")


_EX = """ex AS (SELECT lang AS target_name, doc_id AS line_number, source AS source_file, doc_id % 3 = 0 AS is_verified, (doc_id % 11) / 10.0 AS quality_score FROM documents)"""


@query("FLT13_quality_threshold", f"WITH {_EX} SELECT source_file, line_number FROM ex WHERE target_name = 'fr' AND quality_score >= 0.5 ORDER BY quality_score DESC, is_verified DESC, source_file, line_number LIMIT 5")
def _(s, d):
    ex = B.table(s, d, "documents").select(F.col("lang").alias("target_name"), F.col("doc_id").alias("line_number"), F.col("source").alias("source_file"), (F.col("doc_id") % 3 == 0).alias("is_verified"), ((F.col("doc_id") % 11) / 10.0).alias("quality_score"))
    return search.good_examples(ex, "fr").select("source_file", "line_number")


@query("FLT14_nodes_of_type", f"{_C} SELECT 'class_' || name AS node_id FROM classes")
def _(s, d):
    from cairn.operators.graph import class_graph

    return search.nodes_of_type(class_graph(B.classes(s, d))[0], "class").select("node_id")


@query("FLT15_membership", f"{_M} SELECT count(*) FILTER (WHERE name = 'Supplier#000000003') > 0 AS found, count(*) AS n FROM modules")
def _(s, d):
    return B.modules(s, d).agg((F.count_if(F.col("name") == "Supplier#000000003") > 0).alias("found"), F.count(F.lit(1)).alias("n"))


@query("FLT16_keyword_exclusion", "SELECT DISTINCT event_type FROM events WHERE event_type NOT IN ('click', 'if', 'for') AND length(event_type) > 4")
def _(s, d):
    return search.no_keywords(B.table(s, d, "events").select("event_type").distinct(), "event_type", ["click", "if", "for"], 4)


@query("FLT17_ttl", "SELECT event_id FROM events WHERE epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts) <= 86400::BIGINT * 1000000")
def _(s, d):
    e = B.table(s, d, "events")
    return e.crossJoin(e.agg(F.max("ts").alias("now"))).filter(~X.expired("now", "ts", 86400)).select("event_id")


@query("FLT18_orphans", f"{_M} SELECT name FROM modules WHERE len(dependencies) = 0 AND coalesce(file_count, 0) = 0")
def _(s, d):
    return search.orphans(B.modules(s, d)).select("name")


@query("FLT19_class_post_filter", f"{_F} SELECT name, class_name, file_path, line_number FROM functions WHERE name = 'Fn7' AND class_name = 'Part3'")
def _(s, d):
    return search.lookup(B.functions(s, d), "Fn7").filter("class_name = 'Part3'").select("name", "class_name", "file_path", "line_number")


@query("FLT20_reflected_classes", f"{_C} SELECT name FROM classes WHERE is_uclass")
def _(s, d):
    return B.classes(s, d).filter("is_uclass").select("name")


# ---------------------------------------------------------------- joins


@query("JON01_modules_with_dependencies", f"{_M} SELECT name, array_to_string(public_dependencies, ',') AS pub, array_to_string(dependencies, ',') AS deps FROM modules")
def _(s, d):
    m = B.modules(s, d)
    deps = m.filter(F.size("dependencies") > 0).select("name", "public_dependencies", "private_dependencies", *[F.array().cast("array<string>").alias(f"{k}_dependencies") for k in ("dynamic", "weak", "circular")])
    return joins.with_dependencies(m.select("name"), deps).select("name", F.array_join("public_dependencies", ",").alias("pub"), F.array_join("dependencies", ",").alias("deps"))


@query("JON02_dependency_edges", f"{_M}, sel AS (SELECT name, list_concat(dependencies, [name || 'X', 'Unknown']) AS dependencies FROM modules) SELECT DISTINCT name AS src, dst FROM (SELECT name, unnest(dependencies) AS dst FROM sel) WHERE dst IN (SELECT name FROM sel)")
def _(s, d):
    unknown = F.array(F.concat("name", F.lit("X")), F.lit("Unknown"))
    return joins.dependency_edges(B.modules(s, d).withColumn("dependencies", F.concat("dependencies", unknown)))


@query("JON03_dependents", f"{_M} SELECT name FROM modules WHERE list_contains(dependencies, 'Supplier#000000007')")
def _(s, d):
    return joins.dependents(B.modules(s, d), "Supplier#000000007").select("name")


@query("JON04_dependents_of_any_kind", f"{_M} SELECT name, category FROM modules WHERE list_contains(public_dependencies, 'Supplier#000000004') OR list_contains(private_dependencies, 'Supplier#000000004') OR list_contains(dependencies, 'Supplier#000000004') ORDER BY name LIMIT 200")
def _(s, d):
    return joins.dependents_of_any_kind(B.modules(s, d), "Supplier#000000004")


@query("JON05_manifest_diff", f"WITH {B.MANIFESTS} SELECT name, old_value, new_value, status FROM diff")
def _(s, d):
    return joins.diff(*B.manifests(s, d))


@query("JON06_resume", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')")
def _(s, d):
    return joins.still_to_do(B.table(s, d, "orders").select("o_orderkey"), B.table(s, d, "lineitem").filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("JON07_missing_core", f"{_M}, core AS (SELECT 'Supplier#' || lpad(i::VARCHAR, 9, '0') AS name FROM range(0, 200000, 997) t(i)) SELECT name FROM core WHERE name NOT IN (SELECT name FROM modules)")
def _(s, d):
    core = s.range(0, 200000, 997).select(F.format_string("Supplier#%09d", "id").alias("name"))
    return joins.missing(core, B.modules(s, d))


_INC = """inc AS (SELECT 'Src/' || s_suppkey || '/Private/a.cpp' AS cpp, CASE s_suppkey % 4 WHEN 0 THEN '../Public/h' || (s_suppkey % 50) || '.h' WHEN 1 THEN 'h' || (s_suppkey % 50) || '.h' WHEN 2 THEN 'Sub/h' || (s_suppkey % 50) || '.h' ELSE 'none.h' END AS include, s_suppkey FROM supplier)"""


@query("JON08_include_resolution", f"""WITH {_INC}, heads AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'Src/' || s_suppkey || '/Public/h' || (s_suppkey % 50) || '.h' ELSE 'Src/' || s_suppkey || '/Public/Sub/h' || (s_suppkey % 50) || '.h' END AS header FROM supplier),
 cand AS (SELECT cpp, include, 1 AS p, header FROM inc JOIN heads ON s_suppkey % 4 = 0 AND header = 'Src/' || s_suppkey || '/Public/h' || (s_suppkey % 50) || '.h'
 UNION ALL SELECT cpp, include, 2, header FROM inc JOIN heads ON s_suppkey % 4 <> 0 AND header = 'Src/' || s_suppkey || '/Public/' || include
 UNION ALL SELECT cpp, include, CASE WHEN contains(header, include) THEN 6 ELSE 7 END, header FROM inc JOIN heads ON regexp_extract(header, '[^/]+$') = regexp_extract(include, '[^/]+$'))
 SELECT cpp, include, header, CASE WHEN p = 1 THEN 'relative' WHEN p <= 5 THEN 'module' ELSE 'basename' END AS strategy FROM cand QUALIFY row_number() OVER (PARTITION BY cpp, include ORDER BY p, header) = 1""")
def _(s, d):
    sup = B.table(s, d, "supplier")
    inc = sup.selectExpr("concat('Src/', s_suppkey) AS module_root", "concat('Src/', s_suppkey, '/Private/a.cpp') AS cpp", "CASE s_suppkey % 4 WHEN 0 THEN concat('../Public/h', s_suppkey % 50, '.h') WHEN 1 THEN concat('h', s_suppkey % 50, '.h') WHEN 2 THEN concat('Sub/h', s_suppkey % 50, '.h') ELSE 'none.h' END AS include")
    heads = sup.selectExpr("CASE WHEN s_suppkey % 2 = 0 THEN concat('Src/', s_suppkey, '/Public/h', s_suppkey % 50, '.h') ELSE concat('Src/', s_suppkey, '/Public/Sub/h', s_suppkey % 50, '.h') END AS path")
    return joins.resolve_includes(inc, heads)


@query("JON09_sources_of_headers", "SELECT 'h' || l_suppkey AS header, array_to_string(list_sort(list(DISTINCT 'c' || o_custkey)), ',') AS cpps FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def _(s, d):
    r = B.table(s, d, "orders").join(B.table(s, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.concat(F.lit("h"), "l_suppkey").alias("header"), F.concat(F.lit("c"), "o_custkey").alias("cpp"))
    return joins.sources_of_headers(r).select("header", F.array_join("cpps", ",").alias("cpps"))


@query("JON10_implementation_file", """WITH s AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) SELECT 'F' || l_suppkey AS name, 'h/' || l_suppkey || '.h' AS header, 'c/' || l_partkey || '.cpp' AS cpp FROM s QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY (l_partkey = l_suppkey) DESC, 'c/' || l_partkey || '.cpp') = 1""")
def _(s, d):
    r = B.table(s, d, "lineitem").selectExpr("concat('h/', l_suppkey, '.h') AS header", "concat('c/', l_partkey, '.cpp') AS cpp")
    decl = B.table(s, d, "supplier").selectExpr("concat('F', s_suppkey) AS name", "concat('h/', s_suppkey, '.h') AS header")
    return joins.implementation_file(decl, r)


@query("JON11_definition_lines", "SELECT 'Fn' || p_partkey AS name, p_brand || p_type AS file, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) END AS line_number FROM part")
def _(s, d):
    p = B.table(s, d, "part").selectExpr("concat('Fn', p_partkey) AS name", "concat(p_brand, p_type) AS file", "row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS line_number", "concat('void Fn', p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '(int a);' ELSE '(int a) {' END) AS line")
    return joins.definition_lines(p.select("name", "file"), p.select("file", "line_number", "line")).select("name", "file", F.col("line_number").cast("long").alias("line_number"))


@query("JON12_class_node", f"{_C} SELECT name, module, line_number FROM classes WHERE name = 'Part12' ORDER BY is_uclass DESC, module, line_number LIMIT 1")
def _(s, d):
    c = B.classes(s, d)
    return joins.best_node(c, c, "Part12").select("name", "module", "line_number")


@query("JON13_module_priority", "SELECT name, module FROM (SELECT 'Fn' || l_partkey AS name, 'Mod' || l_suppkey AS module, l_linenumber FROM lineitem WHERE l_partkey = 7) ORDER BY CASE WHEN module IN ('Mod9', 'Mod11') THEN 0 WHEN module IN ('Mod3', 'Mod32', 'Mod57') THEN 1 ELSE 2 END, module, l_linenumber LIMIT 1")
def _(s, d):
    return joins.by_priority(B.functions(s, d), "Fn7", ["Mod9", "Mod11"], ["Mod3", "Mod32", "Mod57"]).select("name", "module")


@query("JON14_neighbours", f"WITH {B.CALLS} SELECT dst AS node, 'out' AS direction FROM calls WHERE src = 7 UNION ALL SELECT src, 'in' FROM calls WHERE dst = 7")
def _(s, d):
    return joins.neighbours(B.calls(s, d).withColumn("type", F.lit("calls")), 7, "both").select("node", "direction")


@query("JON15_document_association", """WITH doc AS (SELECT p_brand AS file, p_partkey % 97 AS line, min(p_name) AS doc FROM part GROUP BY ALL), decl AS (SELECT p_partkey, p_brand AS file, p_size AS line FROM part)
 SELECT p_partkey, coalesce(a.doc, b.doc, c.doc) AS doc FROM decl LEFT JOIN doc a ON decl.file = a.file AND decl.line = a.line LEFT JOIN doc b ON decl.file = b.file AND decl.line = b.line + 1 LEFT JOIN doc c ON decl.file = c.file AND decl.line = c.line + 2""")
def _(s, d):
    p = B.table(s, d, "part")
    docs = p.groupBy(F.col("p_brand").alias("file"), (F.col("p_partkey") % 97).alias("line")).agg(F.min("p_name").alias("doc"))
    return joins.document(p.select("p_partkey", F.col("p_brand").alias("file"), F.col("p_size").alias("line")), docs).select("p_partkey", "doc")


@query("JON16_macro_carry", """WITH l AS (SELECT user_id, event_id, event_type, value FROM events), m AS (SELECT *, lag(event_type) OVER w AS before, lag(value) OVER w AS v FROM l WHERE event_type IN ('click', 'view') WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
 SELECT event_id, CASE WHEN before = 'click' THEN v END AS macro FROM m WHERE event_type = 'view'""")
def _(s, d):
    e = B.table(s, d, "events").filter("event_type in ('click', 'view')").select("user_id", "event_id", "value", (F.col("event_type") == "click").alias("m"), (F.col("event_type") == "view").alias("v"))
    e = e.withColumnsRenamed({"m": "is_macro", "v": "is_decl"})
    return joins.carry_macro(e, "is_macro", "is_decl", "value", "user_id", "event_id").select("event_id", "macro")


@query("JON17_dangling", f"WITH {B.DAG} SELECT src, dst FROM dag WHERE dst NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def _(s, d):
    return joins.dangling(B.dag(s, d), B.table(s, d, "part").filter("p_size > 10").select(F.col("p_partkey").alias("node_id")))


@query("JON18_single_scan", f"{_F} SELECT name, file_path FROM functions WHERE name = 'Fn9' AND is_blueprint_callable")
def _(s, d):
    f = B.functions(s, d)
    return joins.find_everywhere([f.filter("is_blueprint_callable"), f], "Fn9").select("name", "file_path")


# ---------------------------------------------------------------- aggregations


@query("AGG01_category_statistics", f"""{_M}, bycat AS (SELECT category, count(*) AS n_modules, coalesce(sum(file_count), 0)::BIGINT AS files, coalesce(sum(estimated_lines), 0)::BIGINT AS lines FROM modules GROUP BY category)
 SELECT *, (SELECT sum(n_modules)::BIGINT FROM bycat) AS total_modules, (SELECT sum(files)::BIGINT FROM bycat) AS total_files, (SELECT sum(lines)::BIGINT FROM bycat) AS total_lines FROM bycat""")
def _(s, d):
    return stats.by_category(B.modules(s, d))


@query("AGG02_registry", f"{_M} SELECT coalesce(category, 'Unknown') AS category, count(*) AS n_modules, coalesce(max(indexed_at), '') AS last_indexed FROM modules GROUP BY 1")
def _(s, d):
    return stats.registry(B.modules(s, d))


@query("AGG03_class_statistics", f"{_C} SELECT count(*) AS total, count(*) FILTER (WHERE is_uclass) AS uclasses, count(*) FILTER (WHERE is_struct) AS structs, count(*) FILTER (WHERE is_blueprintable) AS blueprintable FROM classes")
def _(s, d):
    return stats.flag_counts(B.classes(s, d), uclasses="is_uclass", structs="is_struct", blueprintable="is_blueprintable")


@query("AGG04_function_top_modules", f"{_F} SELECT module, count(*) AS n FROM functions GROUP BY 1 ORDER BY n DESC, module LIMIT 10")
def _(s, d):
    return stats.top_modules(B.functions(s, d))


@query("AGG05_enum_statistics", f"{_E} SELECT count(*) AS total, count(*) FILTER (WHERE is_uenum) AS uenums FROM enums")
def _(s, d):
    return stats.flag_counts(B.enums(s, d), uenums="is_uenum")


@query("AGG06_example_statistics", "SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def _(s, d):
    return stats.count_by(B.table(s, d, "documents"), "lang")


@query("AGG07_category_counts", f"{_M} SELECT coalesce(nullif(category, ''), 'Unknown') AS category, count(*) AS n FROM modules GROUP BY 1")
def _(s, d):
    return stats.count_by(B.modules(s, d), "category")


@query("AGG08_graph_types", f"{_C} SELECT 'node' AS kind, 'class' AS type, count(*) AS n FROM classes UNION ALL SELECT 'edge', 'inherits', count(*) FROM classes WHERE len(parent_classes) > 0 UNION ALL SELECT 'edge', 'implements', count(*) FROM classes UNION ALL SELECT 'node', 'placeholder', count(*) FROM (SELECT DISTINCT module, unnest(parent_classes) AS n FROM classes EXCEPT SELECT module, name FROM classes) UNION ALL SELECT 'node', 'placeholder', count(*) FROM (SELECT DISTINCT module, unnest(interfaces) FROM classes)".replace("UNION ALL SELECT 'node', 'placeholder', count(*) FROM (SELECT DISTINCT module, unnest(parent_classes) AS n FROM classes EXCEPT SELECT module, name FROM classes) UNION ALL SELECT 'node', 'placeholder', count(*) FROM (SELECT DISTINCT module, unnest(interfaces) FROM classes)", "UNION ALL SELECT 'node', 'placeholder', (SELECT count(*) FROM (SELECT DISTINCT module, unnest(parent_classes) AS n FROM classes EXCEPT SELECT module, name FROM classes)) + (SELECT count(*) FROM (SELECT DISTINCT module, unnest(interfaces) FROM classes))"))
def _(s, d):
    from cairn.operators.graph import class_graph

    return stats.graph_types(*class_graph(B.classes(s, d)))


@query("AGG09_coverage", f"{_M} SELECT count(*) AS n_modules, count(*) FILTER (WHERE len(dependencies) > 0) AS with_dependencies, count(*) FILTER (WHERE coalesce(file_count, 0) > 0) AS with_files, count(*) FILTER (WHERE len(dependencies) = 0 AND coalesce(file_count, 0) = 0) AS orphans, round(count(*) * 100.0 / 609, 2)::DOUBLE AS coverage, round(count(*) * 100.0 / 609, 2) >= 90 AS passed FROM modules")
def _(s, d):
    return stats.coverage(B.modules(s, d)).withColumn("coverage", F.col("coverage").cast("double"))


@query("AGG10_partition_merge", f"{_M} SELECT count(*) AS total, array_to_string(list_sort(list(DISTINCT category)), ',') AS categories FROM modules WHERE category IS NOT NULL")
def _(s, d):
    p = B.modules(s, d).filter("category is not null").groupBy(F.col("s_suppkey") % 6).agg(F.count(F.lit(1)).alias("n_modules"), F.collect_set("category").alias("categories"))
    return stats.merge_partitions(p).select("total", F.array_join("categories", ",").alias("categories"))


@query("AGG11_content_hash", "SELECT source AS module, sha256(string_agg(text, '' ORDER BY doc_id)) AS hash FROM documents GROUP BY 1")
def _(s, d):
    docs = B.table(s, d, "documents").select(F.col("source").alias("module"), F.format_string("%012d", "doc_id").alias("path"), "text")
    return stats.content_hash(docs)


@query("AGG12_file_counts", "SELECT source AS module, count(*) AS file_count, sum(len(string_split(text, chr(10))))::BIGINT AS n_lines FROM documents WHERE lang IN ('en', 'de') GROUP BY 1")
def _(s, d):
    docs = B.table(s, d, "documents").select(F.col("source").alias("module"), F.concat("doc_id", F.when(F.col("lang").isin("en", "de"), ".cpp").otherwise(".txt")).alias("path"), "text")
    return stats.file_counts(docs)


@query("AGG13_estimated_lines", f"{_M} SELECT name, coalesce(file_count, 0) * 200 AS n FROM modules")
def _(s, d):
    return B.modules(s, d).select("name", stats.estimated_lines().alias("n"))


@query("AGG14_run_totals", "SELECT sum(p_size)::BIGINT AS n_classes, sum(p_partkey)::BIGINT AS n_functions, count(*) AS n_enums, count(*) FILTER (WHERE p_size = 7) AS n_failed, (SELECT array_to_string(list(p_partkey ORDER BY p_partkey), ',') FROM (SELECT p_partkey FROM part WHERE p_size = 7 ORDER BY 1 LIMIT 10)) AS failed_sample FROM part")
def _(s, d):
    r = B.table(s, d, "part").select(F.col("p_partkey").alias("module"), F.col("p_size").alias("n_classes"), F.col("p_partkey").alias("n_functions"), F.lit(1).alias("n_enums"), (F.col("p_size") == 7).alias("failed"))
    return stats.run_totals(r).withColumn("failed_sample", F.array_join("failed_sample", ","))


@query("AGG15_cache_statistics", "SELECT count(*) AS entries, sum(user_id)::BIGINT AS accesses, round(avg(user_id), 4) AS average FROM events")
def _(s, d):
    return stats.cache_stats(B.table(s, d, "events").select(F.col("user_id").alias("access_count")))


@query("AGG16_budget_statistics", "WITH b AS (SELECT role AS category, sum(length(text) // 4)::BIGINT AS used, 100000 AS budget FROM conversations GROUP BY 1), t AS (SELECT * FROM b UNION ALL SELECT 'total', sum(used)::BIGINT, sum(budget)::INT FROM b) SELECT category, used, budget::BIGINT AS budget, printf('%.1f%%', used * 100.0 / budget) AS utilisation FROM t")
def _(s, d):
    u = B.table(s, d, "conversations").select(F.col("role").alias("category"), X.text_tokens("text").alias("used"), F.lit(100000).cast("long").alias("budget"))
    return stats.budget_stats(u)


@query("AGG17_union_of_kinds", f"{_M} SELECT name, array_to_string(dependencies, ',') AS deps FROM modules")
def _(s, d):
    return B.modules(s, d).select("name", F.array_join(X.union_sorted("private_dependencies", "public_dependencies", "public_dependencies"), ",").alias("deps"))


@query("AGG18_member_counts", f"{_C} SELECT name, len(methods)::INT AS method_count FROM classes")
def _(s, d):
    return B.classes(s, d).select("name", F.size("methods").alias("method_count"))


@query("AGG19_stage_speed", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_tax = 0 THEN 0 ELSE round(l_quantity / l_tax, 4) END AS speed FROM lineitem")
def _(s, d):
    return B.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(X.speed("l_quantity", "l_tax"), 4).alias("speed"))


@query("AGG20_eta", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_tax = 0 OR l_quantity = 0 THEN 0 ELSE round((100 - l_quantity) / (l_quantity / l_tax), 4) END AS eta FROM lineitem")
def _(s, d):
    return B.table(s, d, "lineitem").withColumn("all", F.lit(100)).select("l_orderkey", "l_linenumber", "l_partkey", F.round(X.eta("all", "l_quantity", "l_tax"), 4).alias("eta"))


# ---------------------------------------------------------------- ordered operators


@query("WIN01_line_context", f"WITH {B.LINES} SELECT doc_id, line_number, coalesce(array_to_string(list(line) OVER (PARTITION BY doc_id ORDER BY line_number ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), chr(10)), '') AS context_before, coalesce(array_to_string(list(line) OVER (PARTITION BY doc_id ORDER BY line_number ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), chr(10)), '') AS context_after FROM lines")
def _(s, d):
    return sequence.with_context(B.doc_lines(s, d), "doc_id").select("doc_id", F.col("line_number").cast("long").alias("line_number"), "context_before", "context_after")


@query("WIN02_first_occurrence", "SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text")
def _(s, d):
    return sequence.first_of(B.table(s, d, "documents"), ["text"], ["doc_id"]).select("text", "doc_id")


_BODY = "concat('void F() {\\n', repeat('if (x) {\\n', p_size % 5), 'a;\\n', repeat('}\\n', p_size % 5), '}\\nint z;\\n{\\n')"


@query("WIN03_body_end", "SELECT p_partkey, 3 + 2 * (p_size % 5) AS end_line FROM part")
def _(s, d):
    ln = sequence.lines(B.table(s, d, "part").selectExpr("p_partkey", f"{_BODY} AS text"), "p_partkey").withColumn("start_line", F.lit(1))
    return sequence.body_end(ln, "p_partkey").select("p_partkey", F.col("end_line").cast("int").alias("end_line"))


@query("WIN06_level", f"WITH RECURSIVE r AS (SELECT p_partkey AS start, p_partkey AS name, 0 AS level FROM part UNION ALL SELECT start, name // 2, level + 1 FROM r WHERE name > 0 AND level < 2) SELECT start, name, level FROM r")
def _(s, d):
    from cairn.operators.graph import hierarchy

    p = B.parts(s, d)
    return hierarchy(p.filter("name > 0").selectExpr("name AS child", "name div 2 AS parent"), p, 3).select("start", "name", "level")


@query("WIN07_round_robin", f"SELECT s_suppkey, (row_number() OVER (ORDER BY s_suppkey) - 1) % 8 AS worker FROM supplier")
def _(s, d):
    return sequence.worker_of(B.table(s, d, "supplier").select("s_suppkey"), ["s_suppkey"], 8).withColumn("worker", F.col("worker").cast("long"))


@query("WIN08_merge_declarations", "SELECT p_brand, p_type, arg_min(p_name, p_partkey) FILTER (WHERE p_size % 3 <> 0) AS doc, bool_or(p_size = 9) AS is_uclass FROM part GROUP BY ALL")
def _(s, d):
    p = B.table(s, d, "part").select("p_brand", "p_type", "p_partkey", F.when(F.col("p_size") % 3 != 0, F.col("p_name")).otherwise("").alias("doc"), (F.col("p_size") == 9).alias("is_uclass"))
    return sequence.merge_declarations(p, ["p_brand", "p_type"], "p_partkey", ["doc"], ["is_uclass"])


@query("WIN09_last_write", "SELECT p_brand, arg_max(p_name, p_partkey) FILTER (WHERE p_size % 2 = 0) AS name, arg_max(p_type, p_partkey) AS type FROM part GROUP BY 1")
def _(s, d):
    p = B.table(s, d, "part").select("p_brand", "p_partkey", F.when(F.col("p_size") % 2 == 0, F.col("p_name")).alias("name"), F.col("p_type").alias("type"))
    return sequence.last_write(p, ["p_brand"], "p_partkey", ["name", "type"])


# ---------------------------------------------------------------- sorts, sets, sinks


@query("SRT01_flag_then_name", f"{_C} SELECT name, module FROM classes ORDER BY is_uclass DESC, name, module LIMIT 50")
def _(s, d):
    return B.classes(s, d).orderBy(F.desc("is_uclass"), "name", "module").limit(50).select("name", "module")


@query("SRT02_top_groups", f"{_C} SELECT module, count(*) AS n FROM classes GROUP BY 1 ORDER BY n DESC, module LIMIT 10")
def _(s, d):
    return stats.top_modules(B.classes(s, d))


@query("SRT03_names", f"{_M} SELECT name FROM modules")
def _(s, d):
    return B.modules(s, d).select("name").orderBy("name")


@query("SRT04_suggestions", f"{_M} SELECT DISTINCT name FROM modules WHERE contains(lower(name), '#0000000') ORDER BY name LIMIT 10")
def _(s, d):
    return search.suggestions(B.modules(s, d), "#0000000")


@query("SRT05_sorted_layer", f"{_C} SELECT module, array_to_string(list_sort(list(name)), ',') AS names FROM classes GROUP BY 1")
def _(s, d):
    return B.classes(s, d).groupBy("module").agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("names"))


@query("SRT06_union_of_hits", f"{_M} SELECT DISTINCT name FROM modules WHERE contains(lower(name), '01') OR contains(lower(coalesce(category, '')), '_1') ORDER BY name LIMIT 50")
def _(s, d):
    m = B.modules(s, d)
    hits = m.filter(search.contains_folded("name", "01")).select("name").unionByName(m.filter(search.contains_folded("category", "_1")).select("name"))
    return hits.distinct().orderBy("name").limit(50)


@query("SRT07_sample_with_total", f"{_C} SELECT name, (SELECT count(*) FROM classes) AS n_total, (SELECT count(*) FROM classes) > 3 AS masked FROM classes ORDER BY name LIMIT 3")
def _(s, d):
    from cairn.operators.shaping import mask

    return mask(B.classes(s, d), ["name"], 3).select("name", "n_total", "masked")


@query("SET01_difference", f"WITH {B.MANIFESTS} SELECT name FROM old EXCEPT SELECT name FROM new")
def _(s, d):
    o, n = B.manifests(s, d)
    return o.select("name").subtract(n.select("name"))


@query("SET02_intersection", f"WITH {B.MANIFESTS} SELECT name FROM old INTERSECT SELECT name FROM new")
def _(s, d):
    o, n = B.manifests(s, d)
    return o.select("name").intersect(n.select("name"))


@query("SET03_list_union", f"{_M} SELECT name, len(list_distinct(list_concat(dependencies, ['Core', name, 'Core'])))::INT AS n FROM modules")
def _(s, d):
    return B.modules(s, d).select("name", F.size(X.union_sorted("dependencies", F.array(F.lit("Core"), F.col("name"), F.lit("Core")))).alias("n"))


@query("SET04_union_of_keywords", f"{_C} SELECT name FROM classes WHERE contains(lower(name), '11') UNION SELECT name FROM classes WHERE contains(lower(file_path), 'bolt')")
def _(s, d):
    c = B.classes(s, d)
    return c.filter(search.contains_folded("name", "11")).select("name").unionByName(c.filter(search.contains_folded("file_path", "bolt")).select("name")).distinct()


@query("SET05_manifest_merge", f"WITH {B.MANIFESTS} SELECT name, new_value AS hash FROM diff WHERE status <> 'removed'")
def _(s, d):
    return incremental.merge(*B.manifests(s, d))


@query("SET06_layer_partition", f"WITH {B.DAG} SELECT CASE WHEN i IS NULL AND o IS NULL THEN 'isolated' WHEN i IS NULL THEN 'bottom' WHEN o IS NULL THEN 'top' ELSE 'middle' END AS layer, count(*) AS n FROM part LEFT JOIN (SELECT dst, count(*) AS i FROM dag GROUP BY 1) ON dst = p_partkey LEFT JOIN (SELECT src, count(*) AS o FROM dag GROUP BY 1) ON src = p_partkey GROUP BY 1")
def _(s, d):
    from cairn.operators.graph import layers

    return layers(B.parts(s, d), B.dag(s, d)).groupBy("layer").agg(F.count(F.lit(1)).alias("n"))


@query("SNK01_upsert", "SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'new' ELSE 'old' END AS origin FROM part WHERE p_partkey % 3 <> 0 OR p_partkey % 4 = 0")
def _(s, d):
    p = B.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.lit(1).alias("seq"))
    return incremental.upsert(p.filter("id % 3 <> 0").withColumn("origin", F.lit("old")), p.filter("id % 4 = 0").withColumn("origin", F.lit("new")), ["id"]).select("id", "origin")


@query("SNK02_batch_upsert_null_keys", "SELECT l_returnflag, l_linestatus, nullif(l_returnflag, 'N') AS key, max(l_orderkey) AS seq FROM lineitem GROUP BY ALL")
def _(s, d):
    rows = B.table(s, d, "lineitem").select("l_returnflag", "l_linestatus", F.nullif("l_returnflag", F.lit("N")).alias("key"), F.col("l_orderkey").alias("seq"))
    return incremental.upsert(rows.filter("1 = 0"), rows, ["key", "l_linestatus"]).select("l_returnflag", "l_linestatus", "key", "seq")


@query("SNK08_metadata_upsert", "SELECT 'k' || (p_partkey % 50) AS key, max(p_partkey)::VARCHAR AS value FROM part GROUP BY 1")
def _(s, d):
    kv = B.table(s, d, "part").selectExpr("concat('k', p_partkey % 50) AS key", "cast(p_partkey AS string) AS value", "p_partkey AS seq")
    return incremental.upsert(kv.filter("seq % 2 = 0"), kv, ["key"]).select("key", "value")


@query("SNK12_added_columns", "SELECT r_regionkey, r_name, NULL::VARCHAR AS doc FROM region")
def _(s, d):
    from pyspark.sql.types import IntegerType, StringType, StructType

    return incremental.with_columns(B.table(s, d, "region"), StructType().add("r_regionkey", IntegerType()).add("r_name", StringType()).add("doc", StringType()))
