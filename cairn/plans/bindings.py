"""The engine's tables bound to the driver's: each as a DataFrame and as a DuckDB common table expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cairn.functions.expr import union_sorted
from cairn.operators.iterate import dealt


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def classes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").selectExpr(
        "concat('Part', p_partkey) AS name", "concat('Mod', regexp_extract(p_brand, '([0-9]+)', 1)) AS module", "lower(p_type) AS namespace",
        "CASE WHEN p_partkey > 0 THEN array(concat('Part', p_partkey div 2)) ELSE cast(array() AS array<string>) END AS parent_classes",
        "array(concat('IBrand', regexp_extract(p_brand, '([0-9]+)', 1))) AS interfaces", "concat(p_brand, '/', p_name, '.h') AS file_path", "p_size AS line_number",
        "p_size % 2 = 0 AS is_uclass", "p_size % 3 = 0 AS is_struct", "p_size % 5 = 0 AS is_interface", "p_size % 7 = 0 AS is_blueprintable",
        "transform(sequence(1, p_size % 8 + 1), i -> concat('M', i)) AS methods", "p_partkey AS id",
    )


CLASSES = """classes AS (SELECT 'Part' || p_partkey AS name, 'Mod' || regexp_extract(p_brand, '([0-9]+)', 1) AS module, lower(p_type) AS namespace,
 CASE WHEN p_partkey > 0 THEN ['Part' || (p_partkey // 2)] ELSE [] END AS parent_classes, ['IBrand' || regexp_extract(p_brand, '([0-9]+)', 1)] AS interfaces,
 p_brand || '/' || p_name || '.h' AS file_path, p_size AS line_number, p_size % 2 = 0 AS is_uclass, p_size % 3 = 0 AS is_struct, p_size % 5 = 0 AS is_interface,
 p_size % 7 = 0 AS is_blueprintable, [('M' || i) FOR i IN range(1, p_size % 8 + 2)] AS methods, p_partkey AS id FROM part)"""


def functions(spark: SparkSession, d: str) -> DataFrame:
    """Line items repeat their key, so every column takes part where rows are told apart."""
    return table(spark, d, "lineitem").selectExpr(
        "concat('Fn', l_partkey) AS name", "concat('Mod', l_suppkey) AS module", "CASE WHEN l_returnflag <> 'N' THEN concat('Part', l_partkey div 2) END AS class_name",
        "CASE l_linestatus WHEN 'O' THEN 'void' ELSE 'int32' END AS return_type", "array(named_struct('type', 'int32', 'name', concat('A', l_linenumber), 'default', cast(NULL AS string))) AS parameters",
        "concat('F', l_orderkey, '.h') AS file_path", "l_linenumber AS line_number", "l_returnflag = 'R' AS is_const", "l_returnflag = 'A' AS is_blueprint_callable", "l_extendedprice AS price", "l_quantity AS quantity",
    )


FUNCTIONS = """functions AS (SELECT 'Fn' || l_partkey AS name, 'Mod' || l_suppkey AS module, CASE WHEN l_returnflag <> 'N' THEN 'Part' || (l_partkey // 2) END AS class_name,
 CASE l_linestatus WHEN 'O' THEN 'void' ELSE 'int32' END AS return_type, l_linenumber, 'F' || l_orderkey || '.h' AS file_path, l_linenumber AS line_number,
 l_returnflag = 'R' AS is_const, l_returnflag = 'A' AS is_blueprint_callable, l_extendedprice AS price, l_quantity AS quantity FROM lineitem)"""


def enums(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy(F.concat(F.lit("E"), F.regexp_extract("p_brand", "([0-9]+)", 1)).alias("name"), F.col("p_type").alias("module")).agg(F.sort_array(F.collect_set("p_name")).alias("values"), F.bool_or(F.col("p_size") % 2 == 0).alias("is_uenum"))


ENUMS = """enums AS (SELECT 'E' || regexp_extract(p_brand, '([0-9]+)', 1) AS name, p_type AS module, list_sort(list(DISTINCT p_name)) AS values, bool_or(p_size % 2 = 0) AS is_uenum FROM part GROUP BY ALL)"""


def modules(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers; they depend publicly on the next supplier in an order, privately on the customer's nation's suppliers of equal size class."""
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    base = s.selectExpr("s_name AS name", "CASE WHEN s_suppkey % 11 <> 0 THEN n_name END AS category", "concat('Engine/Source/', n_name, '/', s_name) AS path", "s_suppkey", "CASE WHEN s_suppkey % 7 <> 0 THEN s_suppkey % 50 END AS file_count", "(s_suppkey % 50) * 200 AS estimated_lines", "CASE WHEN s_suppkey % 5 <> 0 THEN concat('2024-01-', lpad(cast(s_suppkey % 28 + 1 AS string), 2, '0')) END AS indexed_at")
    e = supplier_edges(spark, d)
    names = table(spark, d, "supplier").select(F.col("s_suppkey").alias("dst"), F.col("s_name").alias("dep"))
    deps = e.join(names, "dst").groupBy(F.col("src").alias("s_suppkey")).agg(F.sort_array(F.collect_set(F.when(F.col("dst") % 2 == 0, F.col("dep")))).alias("public_dependencies"), F.sort_array(F.collect_set(F.when(F.col("dst") % 2 == 1, F.col("dep")))).alias("private_dependencies"))
    out = base.join(deps, "s_suppkey", "left")
    return out.withColumn("dependencies", union_sorted("public_dependencies", "private_dependencies")).withColumn("public_dependencies", F.coalesce("public_dependencies", F.array().cast("array<string>"))).withColumn("private_dependencies", F.coalesce("private_dependencies", F.array().cast("array<string>")))


MODULES = """sup_edges AS (SELECT DISTINCT l_suppkey AS src, nxt AS dst FROM (SELECT l_orderkey, l_suppkey, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS nxt FROM lineitem) WHERE nxt IS NOT NULL AND l_suppkey <> nxt),
sup_deps AS (SELECT src, coalesce(list_sort(list(DISTINCT s_name) FILTER (WHERE dst % 2 = 0)), []) AS public_dependencies, coalesce(list_sort(list(DISTINCT s_name) FILTER (WHERE dst % 2 = 1)), []) AS private_dependencies FROM sup_edges JOIN supplier ON dst = s_suppkey GROUP BY src),
modules AS (SELECT s_name AS name, CASE WHEN s_suppkey % 11 <> 0 THEN n_name END AS category, 'Engine/Source/' || n_name || '/' || s_name AS path, s_suppkey, CASE WHEN s_suppkey % 7 <> 0 THEN s_suppkey % 50 END AS file_count, (s_suppkey % 50) * 200 AS estimated_lines,
 CASE WHEN s_suppkey % 5 <> 0 THEN '2024-01-' || lpad((s_suppkey % 28 + 1)::VARCHAR, 2, '0') END AS indexed_at, coalesce(public_dependencies, []) AS public_dependencies, coalesce(private_dependencies, []) AS private_dependencies,
 list_sort(list_distinct(list_concat(coalesce(public_dependencies, []), coalesce(private_dependencies, [])))) AS dependencies
 FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN sup_deps ON src = s_suppkey)"""


def supplier_edges(spark: SparkSession, d: str) -> DataFrame:
    return _successors(spark, d, "l_suppkey", "src <> dst").distinct()


def _successors(spark: SparkSession, d: str, key: str, where: str) -> DataFrame:
    """src, dst: the key of each line and of the next of its order, repeated as they are."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    lines = dealt(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"), "l_orderkey")
    return lines.select(F.col(key).alias("src"), F.lead(key).over(w).alias("dst")).filter(F.col("dst").isNotNull()).filter(where)


def _part_edges(spark: SparkSession, d: str, where: str) -> DataFrame:
    return dealt(_successors(spark, d, "l_partkey", where), "src", "dst").distinct()


def _part_edges_sql(name: str, where: str) -> str:
    return f"""{name} AS (SELECT DISTINCT l_partkey AS src, nxt AS dst FROM (SELECT l_orderkey, l_partkey, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS nxt FROM lineitem) WHERE nxt IS NOT NULL AND {where})"""


#: Binding of graph shapes, each over all orders: a dense cyclic call graph, and an acyclic dependency graph (edges to larger keys).
_ALL, _DAG = "true", "nxt > l_partkey"


def calls(spark, d):
    return _part_edges(spark, d, "true")


def dag(spark, d):
    return _part_edges(spark, d, "dst > src")


CALLS, DAG = _part_edges_sql("calls", _ALL), _part_edges_sql("dag", _DAG)


def parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("name"))


def manifests(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents' hashes before and after a fixed edit: some rows dropped, some altered, some added."""
    docs = table(spark, d, "documents")
    name = F.format_string("doc%d", F.col("doc_id"))
    old = docs.select(name.alias("name"), F.sha2(F.col("text"), 256).alias("hash"))
    kept = docs.filter("doc_id % 17 <> 0").select(name.alias("name"), F.sha2(F.when(F.col("doc_id") % 13 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("hash"))
    more = docs.filter("doc_id % 50 = 0").select(F.format_string("doc%d", F.col("doc_id") + 100000000).alias("name"), F.sha2(F.col("text"), 256).alias("hash"))
    return old, kept.unionByName(more)


MANIFESTS = """old AS (SELECT 'doc' || doc_id AS name, sha256(text) AS hash FROM documents),
new AS (SELECT 'doc' || doc_id AS name, sha256(CASE WHEN doc_id % 13 = 0 THEN text || '!' ELSE text END) AS hash FROM documents WHERE doc_id % 17 <> 0 UNION ALL SELECT 'doc' || (doc_id + 100000000), sha256(text) FROM documents WHERE doc_id % 50 = 0),
diff AS (SELECT coalesce(o.name, n.name) AS name, o.hash AS old_value, n.hash AS new_value, CASE WHEN o.name IS NULL THEN 'added' WHEN n.name IS NULL THEN 'removed' WHEN o.hash IS DISTINCT FROM n.hash THEN 'modified' ELSE 'unchanged' END AS status FROM old o FULL JOIN new n ON o.name = n.name)"""


def doc_lines(spark: SparkSession, d: str) -> DataFrame:
    from cairn.operators.sequence import lines

    return lines(table(spark, d, "documents"), "doc_id")


LINES = "lines AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line_number, unnest(string_split(text, chr(10))) AS line FROM documents)"
