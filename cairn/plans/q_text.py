"""Queries for sources, scalar functions and parsers. Code parsers are bound by round trip: text is rendered from rows, parsed, and compared with the rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import expr as X, parsing as P
from cairn.operators import sequence

from . import bindings as B
from .registry import query


def _part(s, d, text):
    """Texts rendered from parts. Parsing takes time by the row, not by the byte, so the few bytes of that table are dealt out to all cores first."""
    return B.table(s, d, "part").repartition(s.sparkContext.defaultParallelism).selectExpr("p_partkey", f"{text} AS text")


# ---------------------------------------------------------------- sources over text columns


@query("SRC01_content_scan", "SELECT doc_id, sha256(text) AS hash, octet_length(encode(text)) AS n_bytes FROM documents")
def _(s, d):
    return B.table(s, d, "documents").select("doc_id", X.sha256("text").alias("hash"), F.octet_length("text").cast("long").alias("n_bytes"))


@query("SRC04_one_level_category", "SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 = 0")
def _(s, d):
    p = B.table(s, d, "supplier").selectExpr("s_suppkey", "concat('Src/X', s_suppkey, '/X', CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey ELSE s_suppkey + 1 END, '.Build.cs') AS path")
    return p.filter(X.module_name("path") == X.basename(X.dirname("path"))).select("s_suppkey")


@query("SRC06_first_match", "SELECT p_brand, min(p_partkey) AS p_partkey FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') GROUP BY 1")
def _(s, d):
    p = B.table(s, d, "part").filter(F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3"))
    return sequence.first_of(p, ["p_brand"], ["p_partkey"]).select("p_brand", "p_partkey")


@query("SRC08_pruned_walk", "SELECT s_suppkey FROM supplier WHERE s_suppkey % 4 = 0")
def _(s, d):
    from cairn.sources.files import not_generated

    p = B.table(s, d, "supplier").selectExpr("s_suppkey", "concat('M/', element_at(array('Public', 'Intermediate', 'Saved', 'Binaries'), cast(s_suppkey % 4 AS int) + 1), '/a.h') AS path")
    return p.filter(not_generated("path")).select("s_suppkey")


@query("SRC12_first_json_object", "SELECT event_id, props AS obj FROM events")
def _(s, d):
    return B.table(s, d, "events").select("event_id", X.first_json_object(F.concat("props", F.lit('{"x": "}"}'))).alias("obj"))


@query("SRC17_metadata", "SELECT count(DISTINCT p_type) AS n, 'PROMO' AS promo FROM part")
def _(s, d):
    from cairn.sources.files import metadata_map

    kv = B.table(s, d, "part").select(F.col("p_type").alias("key"), F.col("p_type").alias("value")).distinct()
    return metadata_map(kv).select(F.size("m").cast("long").alias("n"), F.element_at("m", "PROMO").alias("promo"))


@query("SRC20_version", "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN '5.' || (s_suppkey % 10) || '.1' WHEN 1 THEN '4.' || (s_suppkey % 30) ELSE 'unknown' END AS version FROM supplier")
def _(s, d):
    p = B.table(s, d, "supplier").selectExpr("s_suppkey", "CASE WHEN s_suppkey % 3 = 0 THEN concat('{\"MajorVersion\":5,\"MinorVersion\":', s_suppkey % 10, ',\"PatchVersion\":1}') END AS j", "CASE WHEN s_suppkey % 3 = 1 THEN concat('/x/Engine_4.', s_suppkey % 30) ELSE '/x/tree' END AS dir")
    return p.select("s_suppkey", X.version("j", "dir").alias("version"))


# ---------------------------------------------------------------- scalars


@query("SCL01_token_estimate", """SELECT p_partkey, length('{"p_name":"' || p_name || '","p_brand":"' || p_brand || '"}') // 4 AS n FROM part""")
def _(s, d):
    return B.table(s, d, "part").select("p_partkey", X.token_estimate("p_name", "p_brand").alias("n"))


@query("SCL02_stable_reference", "SELECT p_partkey, 'ref_' || md5(p_name)[1:8] AS ref FROM part")
def _(s, d):
    return B.table(s, d, "part").select("p_partkey", X.stable_ref("p_name").alias("ref"))


@query("SCL03_random_reference", "SELECT p_partkey, 12 AS n FROM part")
def _(s, d):
    return B.table(s, d, "part").select("p_partkey", F.length(X.random_ref()).alias("n"))


@query("SCL04_sha256", "SELECT page_id, sha256(html) AS h FROM pages")
def _(s, d):
    return B.table(s, d, "pages").select("page_id", X.sha256("html").alias("h"))


@query("SCL05_quality_score", f"WITH {B.LINES}, t AS (SELECT doc_id, line_number, trim(line) AS c FROM lines) SELECT doc_id, line_number, round(least(1.0, 0.5 + CASE WHEN length(c) > 50 AND length(c) < 500 THEN 0.2 ELSE 0 END + CASE WHEN contains(c, '//') OR contains(c, '/*') THEN 0.1 ELSE 0 END + CASE WHEN contains(c, 'if') AND (contains(c, '!') OR contains(c, 'nullptr')) THEN 0.2 ELSE 0 END), 2)::DOUBLE AS score FROM t")
def _(s, d):
    return B.doc_lines(s, d).select("doc_id", F.col("line_number").cast("long").alias("line_number"), X.quality_score("line").alias("score"))


@query("SCL06_description", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Creates an instance of A' || p_partkey WHEN 1 THEN 'Creates A' || p_partkey || ' as a default subobject' WHEN 2 THEN 'Holds A' || p_partkey || ' in a smart pointer' ELSE 'Uses A' || p_partkey END AS text FROM part")
def _(s, d):
    p = B.table(s, d, "part").selectExpr("p_partkey", "concat('A', p_partkey) AS t", "concat(element_at(array('NewObject<A', 'CreateDefaultSubobject<A', 'TSharedPtr<A', 'Foo(A'), cast(p_partkey % 4 AS int) + 1), p_partkey, '>()') AS code")
    return p.select("p_partkey", X.describe("code", "t").alias("text"))


_PATHS = "concat('Engine/', element_at(array('Source/Runtime/', 'Source/Editor/', 'Source/Developer/', 'Plugins/FX/Niagara/', 'Platforms/XB/', 'Source/Foo/'), cast(p_partkey % 6 AS int) + 1), p_name, '/x.Build.cs')"


@query("SCL07_category_of_path", "SELECT p_partkey, ['Runtime', 'Editor', 'Developer', 'Plugins.FX.Niagara', 'Platforms.XB', 'Unknown'][p_partkey % 6 + 1] AS category FROM part")
def _(s, d):
    return _part(s, d, _PATHS).select("p_partkey", X.category_of_path("text").alias("category"))


@query("SCL08_category_of_parts", "SELECT p_partkey, ['Runtime', 'Editor', 'Developer', 'Plugins.FX.Niagara', 'Platforms.XB', 'Foo'][p_partkey % 6 + 1] AS category FROM part")
def _(s, d):
    return _part(s, d, _PATHS).select("p_partkey", X.category_of_parts(F.substring("text", 8, 1000)).alias("category"))


@query("SCL09_module_name", "SELECT p_partkey, 'Mod' || p_partkey AS name FROM part")
def _(s, d):
    return _part(s, d, "concat('a/b/Mod', p_partkey, '.Build.cs')").select("p_partkey", X.module_name("text").alias("name"))


@query("SCL10_strip_comments", "SELECT p_partkey, 'int ' || p_name || '; ' || chr(10) || ' x' AS code FROM part")
def _(s, d):
    return _part(s, d, "concat('int /* a\\nb */', p_name, '; // end ', p_brand, '\\n/**/ x')").select("p_partkey", X.strip_comments("text").alias("code"))


@query("SCL11_blank_strings", """SELECT p_partkey, 'f("", ' || p_size || ', "")' AS code FROM part""")
def _(s, d):
    return _part(s, d, """concat('f("', p_name, '\\\\"x", ', p_size, ', "")')""").select("p_partkey", X.blank_strings("text").alias("code"))


@query("SCL12_split_params", "SELECT p_partkey, 'TMap<FString, ' || p_type || '> M|float V|F(a, b)' AS parts FROM part")
def _(s, d):
    return _part(s, d, "concat('TMap<FString, ', p_type, '> M, float V, F(a, b)')").select("p_partkey", F.array_join(X.split_params("text"), "|").alias("parts"))


@query("SCL13_parameters", "SELECT p_partkey, 'TMap<FString, int32> M -|const A' || p_type || '& X ' || p_size || '|unknown int32 -' AS p FROM part")
def _(s, d):
    p = _part(s, d, "concat('TMap<FString, int32> M, const A', p_type, '& X = ', p_size, ', int32')").select("p_partkey", X.parse_parameters("text").alias("ps"))
    return p.select("p_partkey", F.array_join(F.transform("ps", lambda x: F.concat_ws(" ", x["type"], x["name"], F.coalesce(x["default"], F.lit("-")))), "|").alias("p"))


@query("SCL14_specifiers", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'Blueprintable' ELSE 'NotBlueprintable' END AS flags, p_type AS category, p_name AS tip FROM part")
def _(s, d):
    p = _part(s, d, """concat(CASE WHEN p_size % 2 = 0 THEN 'Blueprintable' ELSE 'NotBlueprintable' END, ', Category="', p_type, '", meta=(ToolTip="', p_name, '", X="y")')""")
    return p.select("p_partkey", F.array_join(X.specifier_flags("text", "class"), ",").alias("flags"), X.specifier_category("text").alias("category"), F.element_at(X.specifier_meta("text"), "ToolTip").alias("tip"))


@query("SCL15_namespace_path", "SELECT p_partkey, 'A::' || p_type AS ns FROM part")
def _(s, d):
    return B.table(s, d, "part").select("p_partkey", X.namespace_path(F.array(F.lit("A"), F.col("p_type"))).alias("ns"))


@query("SCL16_node_id", "SELECT p_partkey, 'file_a_' || p_type || '_b_' || p_partkey AS id FROM part")
def _(s, d):
    p = B.table(s, d, "part").withColumn("path", F.concat(F.lit("a/"), "p_type", F.lit("\\b")))
    return p.select("p_partkey", X.node_id("file", "path", "p_partkey").alias("id"))


@query("SCL17_primary_parent", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'A' || p_type ELSE 'IBrand' END AS parent FROM part")
def _(s, d):
    p = B.table(s, d, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.array(F.lit("IBrand"), F.concat(F.lit("A"), "p_type"))).otherwise(F.array(F.lit("IBrand"))).alias("ps"))
    return p.select("p_partkey", X.primary_parent("ps").alias("parent"))


@query("SCL18_delegate_kind", "SELECT p_partkey, ['single', 'multicast', 'dynamic', 'dynamic_multicast'][p_partkey % 4 + 1] AS kind FROM part")
def _(s, d):
    return _part(s, d, "element_at(array('DECLARE_DELEGATE', 'DECLARE_MULTICAST_DELEGATE', 'DECLARE_DYNAMIC_DELEGATE', 'DECLARE_DYNAMIC_MULTICAST_DELEGATE'), cast(p_partkey % 4 AS int) + 1)").select("p_partkey", X.delegate_kind("text").alias("kind"))


@query("SCL19_callable", "SELECT p_partkey, p_size % 2 = 0 AS callable FROM part")
def _(s, d):
    p = B.table(s, d, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.array(F.lit("Exec"), F.lit("BlueprintPure"))).otherwise(F.array(F.lit("Exec"))).alias("f"))
    return p.select("p_partkey", X.is_callable("f").alias("callable"))


@query("SCL20_shorten", "SELECT doc_id, CASE WHEN length(text) > 1000 THEN text[1:1000] || '...' ELSE text END AS t FROM documents")
def _(s, d):
    return B.table(s, d, "documents").select("doc_id", X.shorten("text", 1000, "...").alias("t"))


@query("SCL21_confidence", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'engine' WHEN s_suppkey % 3 = 0 THEN 'plugin' WHEN s_suppkey % 5 = 0 THEN 'engine' ELSE 'unknown' END AS kind, CASE WHEN s_suppkey % 2 = 0 OR s_suppkey % 3 = 0 THEN 'high' WHEN s_suppkey % 5 = 0 THEN 'medium' ELSE 'low' END AS confidence FROM supplier")
def _(s, d):
    from cairn.sources.detect import kind_of

    p = B.table(s, d, "supplier").selectExpr("s_suppkey", "s_suppkey % 2 = 0 AS is_engine", "s_suppkey % 3 = 0 AS is_plugin", "s_suppkey % 5 = 0 AS in_engine")
    return p.select("s_suppkey", *[kind_of("is_engine", "is_plugin", "in_engine")[c].alias(c) for c in ("kind", "confidence")])


@query("SCL22_paths", "SELECT p_partkey, 'b' || p_partkey || '.h' AS base, 'a/../x' AS dir, 'b' || p_partkey AS stem, 'x/b' || p_partkey || '.h' AS norm FROM part")
def _(s, d):
    return _part(s, d, "concat('a/../x/b', p_partkey, '.h')").select("p_partkey", X.basename("text").alias("base"), X.dirname("text").alias("dir"), X.stem("text").alias("stem"), X.normal_path("text").alias("norm"))


@query("SCL23_utilisation", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_tax > 0 THEN round(l_discount / l_tax, 6) ELSE 0 END AS u, CASE WHEN l_tax > 0 THEN l_discount / l_tax >= 0.8 ELSE false END AS over FROM lineitem")
def _(s, d):
    return B.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(X.utilisation("l_discount", "l_tax"), 6).alias("u"), X.is_over("l_discount", "l_tax").alias("over"))


@query("SCL24_hint_on_miss", "SELECT p_partkey, CASE WHEN p_size > 10 THEN NULL ELSE 'search_classes AVeryLon' END AS hint FROM part")
def _(s, d):
    return B.table(s, d, "part").select("p_partkey", X.hint_on_miss(F.col("p_size") > 10, "search_classes", "AVeryLongName").alias("hint"))


# ---------------------------------------------------------------- parsers, by round trip

_CLASS = """concat('#include "Brand', p_size, '/P.h"\\n/** Doc of ', p_name, ' */\\nUCLASS(', CASE WHEN p_size % 2 = 0 THEN 'Blueprintable' ELSE 'NotBlueprintable' END, ')\\nclass APart', p_partkey, ' : public A', p_type, ', public IBrand', regexp_extract(p_brand, '([0-9]+)', 1),
'\\n{\\n  UPROPERTY(EditAnywhere, Category="', p_type, '")\\n  int32 Size', p_partkey, ';\\n  float W = 1.0f; // {\\n  virtual void F', p_partkey, '(int32 A, TMap<FString, float> M) = 0;\\n  static int32 G', p_partkey, '(float Q = ', p_size, ') const;\\n  void Gone() = delete;\\n};\\nclass Forward;\\nenum class E', p_type, p_partkey, ' : uint8 { V', p_partkey, ' = 1, W', p_size, ' UMETA(DisplayName="x, y") };\\n')"""


@query("PAR01_all_kinds", "SELECT 'classes' AS kind, count(*) AS n FROM part UNION ALL SELECT 'functions', 2 * count(*) FROM part UNION ALL SELECT 'enums', count(*) FROM part UNION ALL SELECT 'includes', count(*) FROM part")
def _(s, d):
    return P.count_kinds(_part(s, d, _CLASS), ("classes", "functions", "enums", "includes"))


@query("PAR02_classes", "SELECT p_partkey, 'APart' || p_partkey AS name, 'A' || p_type AS parent_class, 'IBrand' || regexp_extract(p_brand, '([0-9]+)', 1) AS interfaces, 4 AS line, true AS is_uclass, p_size % 2 = 0 AS is_blueprintable, 'Doc of ' || p_name AS doc FROM part")
def _(s, d):
    return P.parse_table(_part(s, d, _CLASS), "classes").select("p_partkey", "name", "parent_class", F.array_join("interfaces", ",").alias("interfaces"), "line", "is_uclass", "is_blueprintable", "doc")


@query("PAR03_class_bodies", "SELECT p_partkey, 2 AS n_properties, 2 AS n_methods FROM part")
def _(s, d):
    return P.parse_table(_part(s, d, _CLASS), "classes").select("p_partkey", F.size("properties").alias("n_properties"), F.size("methods").alias("n_methods"))


@query("PAR04_properties", "SELECT p_partkey, 'Size' || p_partkey AS name, 'int32' AS type, true AS is_uproperty, 'EditAnywhere' AS flags, p_type AS category FROM part UNION ALL SELECT p_partkey, 'W', 'float', false, '', NULL FROM part")
def _(s, d):
    c = P.parse_table(_part(s, d, _CLASS), "classes").select("p_partkey", F.explode("properties").alias("p"))
    return c.select("p_partkey", "p.name", "p.type", "p.is_uproperty", F.array_join("p.flags", ",").alias("flags"), "p.category")


@query("PAR05_methods", "SELECT p_partkey, 'void F' || p_partkey || '(int32 A, TMap<FString, float> M) = 0' AS method FROM part UNION ALL SELECT p_partkey, 'int32 G' || p_partkey || '(float Q = ' || p_size || ') const' FROM part")
def _(s, d):
    return P.parse_table(_part(s, d, _CLASS), "classes").select("p_partkey", F.explode("methods").alias("method"))


@query("PAR06_enums", "SELECT p_partkey, 'E' || p_type || p_partkey AS name, 'uint8' AS underlying, 14 AS line FROM part")
def _(s, d):
    return P.parse_table(_part(s, d, _CLASS), "enums").select("p_partkey", "name", "underlying", "line")


@query("PAR07_enum_values", "SELECT p_partkey, 'V' || p_partkey || ',W' || p_size AS v FROM part")
def _(s, d):
    return P.parse_table(_part(s, d, _CLASS), "enums").select("p_partkey", F.array_join("values", ",").alias("v"))


@query("PAR08_delegates", "SELECT event_id, 'FOn' || event_type || event_id AS name, 'multicast' AS kind, 'int32' AS params FROM events UNION ALL SELECT event_id, 'FAsk' || event_id, 'single', '' FROM events")
def _(s, d):
    e = B.table(s, d, "events").selectExpr("event_id", "concat('DECLARE_MULTICAST_DELEGATE_OneParam(FOn', event_type, event_id, ',\\n  int32);\\nDECLARE_DELEGATE_RetVal(bool, FAsk', event_id, ');') AS text")
    return P.parse_table(e, "delegates").select("event_id", "name", "kind", F.array_join("params", ",").alias("params"))


@query("PAR09_aliases", "SELECT p_partkey, 'FA' || p_partkey AS name, 'TArray<A' || p_type || '>' AS underlying FROM part UNION ALL SELECT p_partkey, 'FB' || p_partkey, 'TMap<int, A' || p_type || '>' FROM part")
def _(s, d):
    p = _part(s, d, "concat('using FA', p_partkey, ' = TArray<A', p_type, '>;\\ntypedef TMap<int, A', p_type, '> FB', p_partkey, ';\\nusing namespace X::Y;')")
    ln = sequence.lines(p, "p_partkey").select("p_partkey", X.type_alias("line").alias("a")).filter("a is not null")
    return ln.select("p_partkey", "a.name", "a.underlying")


@query("PAR10_functions", "SELECT p_partkey, 'F' || p_partkey AS name, 'void' AS return_type, true AS is_virtual, false AS is_static, false AS is_const, true AS is_pure_virtual, 2 AS n_params FROM part UNION ALL SELECT p_partkey, 'G' || p_partkey, 'int32', false, true, true, false, 1 FROM part")
def _(s, d):
    return P.parse_table(_part(s, d, _CLASS), "functions").select("p_partkey", "name", "return_type", "is_virtual", "is_static", "is_const", "is_pure_virtual", F.size("parameters").alias("n_params"))


@query("PAR11_doc_comments", "SELECT p_partkey, 3 AS line, p_name || ' ' || p_brand AS doc FROM part UNION ALL SELECT p_partkey, 6, p_type FROM part")
def _(s, d):
    p = _part(s, d, "concat('/// ', p_name, '\\n/// ', p_brand, '\\nint a;\\n/**\\n * ', p_type, ' */\\nint b; // no\\n')")
    return P.parse_table(p, "docs").select("p_partkey", "line", "doc")


@query("PAR12_comment_lines", "SELECT p_partkey, 'int a' || p_size || ';' AS code, 4 AS n_lines FROM part")
def _(s, d):
    p = P.parse_table(_part(s, d, "concat('/* a\\n b\\n*/ int a', p_size, '; // ', p_name, '\\n')"), "code").withColumnRenamed("code", "t")
    return p.select("p_partkey", F.trim(F.regexp_replace("t", r"\s+", " ")).alias("code"), F.size(F.split("t", "\n")).alias("n_lines"))


_DESC = """concat('// PublicDependencyModuleNames.Add("No");\\nPublicDependencyModuleNames.AddRange(new string[] { "P', p_partkey, '", "Core", // "Not"\\n "Core" });\\nPrivateDependencyModuleNames.Add("Q', p_size, '");\\nDynamicallyLoadedModuleNames.Add("D', p_size, '");\\nPublicWeakDependencyModuleNames.AddRange(new string[]{"W"});\\nCircularlyReferencedDependentModules.AddRange(new string[] { "C" });')"""


@query("PAR14_descriptor", "SELECT p_partkey, 'Core,P' || p_partkey AS pub, 'Q' || p_size AS priv, 'D' || p_size AS dyn, 'W' AS weak, 'C' AS circ FROM part")
def _(s, d):
    return _part(s, d, _DESC).select("p_partkey", *[F.array_join(X.dependencies("text", k), ",").alias(n) for k, n in (("Public", "pub"), ("Private", "priv"), ("Dynamic", "dyn"), ("Weak", "weak"), ("Circular", "circ"))])


@query("PAR15_includes", "SELECT p_partkey, 'Brand' || p_size || '/P.h' AS include FROM part")
def _(s, d):
    return _part(s, d, _CLASS).select("p_partkey", F.explode(X.includes("text")).alias("include"))


@query("PAR16_include_edges", "SELECT p_partkey, 'include_Brand' || p_size || '_P.h' AS dst, 1 AS line FROM part")
def _(s, d):
    return P.parse_table(_part(s, d, _CLASS), "includes").select("p_partkey", X.node_id("include", "include").alias("dst"), "line")


_CALLS = """concat('void Fn', p_partkey, '(int a)\\n{ if (a) { Go', p_size, '(1, "No(x)"); } /* Not(1) */ Fn', p_partkey div 2, '(2); }\\nint AX::Get', p_partkey, '() const { return Go', p_size, '(3); }\\n')"""


@query("PAR17_definitions", "SELECT p_partkey, 'Fn' || p_partkey AS name, NULL AS class_name FROM part UNION ALL SELECT p_partkey, 'Get' || p_partkey, 'AX' FROM part")
def _(s, d):
    return P.parse_table(_part(s, d, _CALLS), "definitions").select("p_partkey", "name", "class_name")


@query("PAR18_callees", "SELECT p_partkey, 'Go' || p_size || ',Fn' || (p_partkey // 2) AS callees FROM part")
def _(s, d):
    b = P.parse_table(_part(s, d, _CALLS), "definitions").filter("class_name is null")
    return b.select("p_partkey", F.array_join(X.callees("body"), ",").alias("callees"))


@query("PAR19_call_edges", "SELECT p_partkey, 'Fn' || p_partkey AS caller, 'Go' || p_size AS callee FROM part UNION ALL SELECT p_partkey, 'Fn' || p_partkey, 'Fn' || (p_partkey // 2) FROM part UNION ALL SELECT p_partkey, 'Get' || p_partkey, 'Go' || p_size FROM part")
def _(s, d):
    return P.parse_table(_part(s, d, _CALLS), "calls")


@query("PAR20_class_usage", "SELECT p_partkey, ['UA' || p_partkey, 'UB' || p_partkey, 'FC' || p_partkey, NULL][p_partkey % 4 + 1] AS used FROM part")
def _(s, d):
    return _part(s, d, "element_at(array(concat('x = NewObject<UA', p_partkey, '>(this);'), concat('CreateDefaultSubobject<UB', p_partkey, '>(n)'), concat('TSharedPtr<FC', p_partkey, '> p;'), 'int a = 2;'), cast(p_partkey % 4 AS int) + 1)").select("p_partkey", X.used_class("text").alias("used"))


@query("PAR21_function_calls", "SELECT p_partkey, 'Go' || p_partkey || 'x' AS called FROM part")
def _(s, d):
    return _part(s, d, "concat('if (Go', p_partkey, 'x(a)) { go(1); }')").select("p_partkey", F.explode(X.called_functions("text")).alias("called"))


@query("PAR22_examples", "SELECT 'Go' || p_size || 'x' AS target_name, 'function' AS target_type, 'Go' || p_size || 'x(1);' AS example_code, min(p_partkey) AS source_file, 0.5::DOUBLE AS quality_score, 'int a;' AS context_before FROM part GROUP BY p_size")
def _(s, d):
    ln = sequence.lines(_part(s, d, "concat('int a;\\n  Go', p_size, 'x(1);\\nint b;')"), "p_partkey").withColumnRenamed("p_partkey", "source_file")
    return P.examples(ln).select("target_name", "target_type", "example_code", "source_file", "quality_score", "context_before")


@query("PAR23_module_totals", "SELECT p_type AS module, count(*) AS n_classes FROM part GROUP BY 1")
def _(s, d):
    p = B.table(s, d, "part").repartition(s.sparkContext.defaultParallelism).selectExpr("p_type AS module", f"{_CLASS} AS text")
    return P.parse_table(p, "classes").groupBy("module").agg(F.count(F.lit(1)).alias("n_classes"))
