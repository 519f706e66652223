"""Scalar functions and pure-regex extractors as built-in column expressions (they stay in whole-stage codegen).

Arguments are columns or column names. Regexes use ASCII ``\\w``.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .cpp import CALLABLE, CLASS_FLAGS, FUNCTION_FLAGS, KEYWORDS, PROPERTY_FLAGS

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def texts(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values])


def empty() -> Column:
    return F.array().cast("array<string>")


# ---- records and lists


def or_empty(c: ColumnOrName) -> Column:
    """A null list as an empty one."""
    return F.coalesce(col(c), empty())


def to_list_text(c: ColumnOrName) -> Column:
    return F.to_json(or_empty(c))


def from_list_text(c: ColumnOrName) -> Column:
    """A JSON list; anything else, or null, is an empty list."""
    return F.coalesce(F.from_json(col(c), "array<string>"), empty())


def first_filled(*cs: ColumnOrName) -> Column:
    """The first that is neither null nor empty, else the empty string (reconciles renamed fields)."""
    return F.coalesce(*[F.nullif(col(c), F.lit("")) for c in cs], F.lit(""))


def first_filled_list(*cs: ColumnOrName) -> Column:
    """The first list that has an element, else an empty one."""
    return F.coalesce(*[F.when(F.size(col(c)) > 0, col(c)) for c in cs], empty())


def union_sorted(*cs: ColumnOrName) -> Column:
    """Distinct elements of all lists, sorted."""
    return F.array_sort(F.array_distinct(F.flatten(F.array(*[or_empty(c) for c in cs]))))


# ---- identifiers, hashes, sizes


def token_estimate(*cs: ColumnOrName) -> Column:
    """Characters of the compact JSON of the columns, divided by four."""
    return F.floor(F.length(F.to_json(F.struct(*[col(c) for c in cs]))) / 4).cast("long")


def text_tokens(c: ColumnOrName) -> Column:
    return F.floor(F.length(col(c)) / 4).cast("long")


def stable_ref(c: ColumnOrName) -> Column:
    return F.concat(F.lit("ref_"), F.substring(F.md5(col(c)), 1, 8))


def random_ref() -> Column:
    return F.concat(F.lit("ref_"), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 8))


def sha256(c: ColumnOrName) -> Column:
    return F.sha2(col(c), 256)


def node_id(kind: str, *parts: ColumnOrName) -> Column:
    """``kind_part_part`` with slashes and backslashes as underscores."""
    return F.concat_ws("_", F.lit(kind), *[F.translate(col(p).cast("string"), "/\\", "__") for p in parts])


def utilisation(used: ColumnOrName, budget: ColumnOrName) -> Column:
    return F.when(col(budget) > 0, col(used) / col(budget)).otherwise(F.lit(0.0))


def is_over(used: ColumnOrName, budget: ColumnOrName, threshold: float = 0.8) -> Column:
    return utilisation(used, budget) >= threshold


def shorten(c: ColumnOrName, n: int, marker: str = "") -> Column:
    return F.when(F.length(col(c)) > n, F.concat(F.substring(col(c), 1, n), F.lit(marker))).otherwise(col(c))


def hint_on_miss(found: Column, command: str, keyword: str) -> Column:
    """``command keyword`` (its first 8 characters) where nothing was found."""
    return F.when(~found, F.lit(f"{command} {keyword[:8]}"))


# ---- paths


def basename(c: ColumnOrName) -> Column:
    return F.substring_index(F.translate(col(c), "\\", "/"), "/", -1)


def dirname(c: ColumnOrName) -> Column:
    return F.regexp_extract(F.translate(col(c), "\\", "/"), "^(.*)/[^/]*$", 1)


def stem(c: ColumnOrName) -> Column:
    return F.regexp_replace(basename(c), r"(?<=.)\.[^.]*$", "")


def module_name(path: ColumnOrName) -> Column:
    """The descriptor's name without ``.Build.cs``; empty where the path is no descriptor."""
    return F.regexp_extract(F.translate(col(path), "\\", "/"), r"([^/]+)\.Build\.cs$", 1)


def normal_path(c: ColumnOrName) -> Column:
    """Resolves ``.`` and ``..`` parts by a fold."""
    parts = F.split(F.translate(col(c), "\\", "/"), "/")
    folded = F.aggregate(
        parts,
        empty(),
        lambda acc, p: F.when((p == ".") | (p == ""), acc).when((p == "..") & (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))),
    )
    return F.concat(F.when(col(c).startswith("/"), F.lit("/")).otherwise(F.lit("")), F.array_join(folded, "/"))


def category_of_path(path: ColumnOrName) -> Column:
    """Runtime, Editor, Developer, Programs, ``Plugins.T.N``, ``Platforms.P`` or Unknown; the first that fits."""
    p = F.translate(col(path), "\\", "/")
    plugin = r"Plugins/([^/]+)/([^/]+)/"
    out = F.when(p.contains("Source/Runtime/"), "Runtime")
    for name in ("Editor", "Developer", "Programs"):
        out = out.when(p.contains(f"Source/{name}/"), name)
    out = out.when(p.rlike(plugin), F.concat_ws(".", F.lit("Plugins"), F.regexp_extract(p, plugin, 1), F.regexp_extract(p, plugin, 2)))
    out = out.when(p.rlike("Platforms/([^/]+)/"), F.concat_ws(".", F.lit("Platforms"), F.regexp_extract(p, "Platforms/([^/]+)/", 1)))
    return out.otherwise("Unknown")


def category_of_parts(relative: ColumnOrName) -> Column:
    """By the parts of a relative path: ``Source/X/..`` is X whatever it is, ``Plugins/T/N/..`` and ``Platforms/P/..`` as above."""
    parts = F.split(F.translate(col(relative), "\\", "/"), "/")
    at = lambda i: F.try_element_at(parts, F.lit(i))
    return F.when((at(1) == "Source") & (F.size(parts) > 2), at(2)).when((at(1) == "Plugins") & (F.size(parts) > 3), F.concat_ws(".", F.lit("Plugins"), at(2), at(3))).when((at(1) == "Platforms") & (F.size(parts) > 2), F.concat_ws(".", F.lit("Platforms"), at(2))).otherwise("Unknown")


def partition_of(category: ColumnOrName) -> Column:
    """The build partition of a category: the prefixes Plugins. and Platforms., else the category itself."""
    c = col(category)
    return F.when(c.startswith("Plugins."), "Plugins").when(c.startswith("Platforms."), "Platforms").otherwise(c)


# ---- code


def strip_comments(c: ColumnOrName) -> Column:
    return F.regexp_replace(F.regexp_replace(col(c), r"(?s)/\*.*?\*/", ""), r"(?m)//[^\n]*", "")


def blank_strings(c: ColumnOrName) -> Column:
    return F.regexp_replace(col(c), r'"(?:\\.|[^"\\\n])*"', '""')


def split_params(c: ColumnOrName) -> Column:
    """Parts at commas outside brackets: a plain split where there are no brackets, else cut where a fold over brackets, commas and what is between says."""
    x = col(c)
    tokens = F.regexp_extract_all(x, F.lit(r"[<>()\[\]{},]|[^<>()\[\]{},]++"), F.lit(0))
    start = F.struct(F.array().cast("array<int>").alias("cuts"), F.lit(0).alias("depth"), F.lit(1).alias("at"))

    def step(acc, t):
        depth = acc["depth"] + F.when(t.isin("<", "(", "[", "{"), 1).when(t.isin(">", ")", "]", "}"), -1).otherwise(0)
        cuts = F.when((t == ",") & (acc["depth"] == 0), F.concat(acc["cuts"], F.array(acc["at"]))).otherwise(acc["cuts"])
        return F.struct(cuts.alias("cuts"), F.greatest(depth, F.lit(0)).alias("depth"), (acc["at"] + F.length(t)).alias("at"))

    def pieces(acc):
        begins = F.concat(F.array(F.lit(1)), F.transform(acc["cuts"], lambda i: i + 1))
        return F.transform(F.arrays_zip(begins.alias("a"), F.concat(acc["cuts"], F.array(acc["at"])).alias("z")), lambda p: F.substr(x, p["a"], p["z"] - p["a"]))

    parts = F.when(x.rlike(r"[<(\[{]"), F.aggregate(tokens, start, step, pieces)).otherwise(F.split(x, ","))
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


_PARAM = r"(?s)^(.*[\s&*>])\s*([A-Za-z_]\w*)\s*(?:\[\w*\])?\s*(?:=\s*(.*))?$"


def parse_parameters(c: ColumnOrName) -> Column:
    """array<struct<type,name,default>>; ``void`` or nothing: empty; without a name: type ``unknown``."""
    one = lambda p: F.when(
        F.substring_index(p, "=", 1).rlike(r"^.*[\s&*>]\s*[A-Za-z_]\w*\s*(\[\w*\])?\s*$"),
        F.struct(F.trim(F.regexp_extract(p, _PARAM, 1)).alias("type"), F.regexp_extract(p, _PARAM, 2).alias("name"), F.nullif(F.trim(F.regexp_extract(p, _PARAM, 3)), F.lit("")).alias("default")),
    ).otherwise(F.struct(F.lit("unknown").alias("type"), F.trim(F.substring_index(p, "=", 1)).alias("name"), F.lit(None).cast("string").alias("default")))
    none = F.array().cast("array<struct<type:string,name:string,default:string>>")
    return F.when(F.trim(col(c)).isin("", "void"), none).otherwise(F.transform(split_params(c), one))


def specifier_flags(c: ColumnOrName, kind: str) -> Column:
    """Known flags of a macro's arguments, whole specifiers only, in the vocabulary's order."""
    words = {"class": CLASS_FLAGS, "property": PROPERTY_FLAGS, "function": FUNCTION_FLAGS}[kind]
    have = F.transform(split_params(c), lambda p: F.trim(F.substring_index(p, "=", 1)))
    return F.coalesce(F.array_intersect(texts(*words), have), empty())  # parts are split once, not for each word


def specifier_category(c: ColumnOrName, bare: bool = False) -> Column:
    """``Category="x"``; with ``bare`` also ``Category=x``."""
    quoted = F.nullif(F.regexp_extract(col(c), r'Category\s*=\s*"([^"]*)"', 1), F.lit(""))
    return F.coalesce(quoted, F.nullif(F.regexp_extract(col(c), r"Category\s*=\s*([A-Za-z_]\w*)", 1), F.lit(""))) if bare else quoted


def specifier_meta(c: ColumnOrName) -> Column:
    """The pairs ``k="v"`` of ``meta=(..)`` as a map."""
    meta = F.regexp_extract(col(c), r"meta\s*=\s*\(([^)]*)\)", 1)
    pair = r'(\w+)\s*=\s*"([^"]*)"'
    return F.map_from_arrays(F.regexp_extract_all(meta, F.lit(pair), F.lit(1)), F.regexp_extract_all(meta, F.lit(pair), F.lit(2)))


def is_callable(flags: ColumnOrName) -> Column:
    return F.arrays_overlap(col(flags), texts(*sorted(CALLABLE)))


def namespace_path(c: ColumnOrName) -> Column:
    return F.array_join(col(c), "::")


def is_interface_name(c: ColumnOrName) -> Column:
    return col(c).rlike("^I[A-Z]")


def primary_parent(parents: ColumnOrName) -> Column:
    """The first parent that is no interface, else the first, else null."""
    return F.coalesce(F.try_element_at(F.filter(col(parents), lambda p: ~is_interface_name(p)), F.lit(1)), F.try_element_at(col(parents), F.lit(1)))


def delegate_kind(macro: ColumnOrName) -> Column:
    dynamic, multi = col(macro).contains("_DYNAMIC"), col(macro).contains("MULTICAST_")
    return F.when(dynamic & multi, "dynamic_multicast").when(multi, "multicast").when(dynamic, "dynamic").otherwise("single")


def signature(ret: ColumnOrName, name: ColumnOrName, params: ColumnOrName, const: ColumnOrName | None = None) -> Column:
    """``ret name(type name, ..)`` and `` const``."""
    inner = F.array_join(F.transform(col(params), lambda p: F.concat_ws(" ", p["type"], p["name"])), ", ")
    out = F.concat(F.when(F.coalesce(col(ret), F.lit("")) != "", F.concat(col(ret), F.lit(" "))).otherwise(F.lit("")), col(name), F.lit("("), inner, F.lit(")"))
    return out if const is None else F.concat(out, F.when(col(const), F.lit(" const")).otherwise(F.lit("")))


def location(file: ColumnOrName, line: ColumnOrName) -> Column:
    return F.concat_ws(":", col(file), col(line).cast("string"))


# ---- examples


def quality_score(code: ColumnOrName) -> Column:
    """.5, and .2 for 51 to 499 characters, .1 for a comment, .2 for ``if`` with ``!`` or ``nullptr``; 1.0 at most."""
    c = F.trim(col(code))
    some = lambda cond, x: F.when(cond, F.lit(x)).otherwise(F.lit(0.0))
    n = F.length(c)
    return F.round(F.least(F.lit(1.0), F.lit(0.5) + some((n > 50) & (n < 500), 0.2) + some(c.contains("//") | c.contains("/*"), 0.1) + some(c.contains("if") & (c.contains("!") | c.contains("nullptr")), 0.2)), 2)


def describe(code: ColumnOrName, target: ColumnOrName) -> Column:
    c = col(code)
    return F.when(c.contains("NewObject"), F.format_string("Creates an instance of %s", col(target))).when(c.contains("CreateDefaultSubobject"), F.format_string("Creates %s as a default subobject", col(target))).when(c.rlike(r"T(Shared|Unique|Weak)Ptr"), F.format_string("Holds %s in a smart pointer", col(target))).otherwise(F.format_string("Uses %s", col(target)))


# ---- extractors


def dependencies(descriptor: ColumnOrName, kind: str) -> Column:
    """Sorted distinct names of one dependency kind (Public, Private, Dynamic, Weak, Circular) in a build descriptor."""
    words = {"Public": "PublicDependencyModuleNames", "Private": "PrivateDependencyModuleNames", "Dynamic": "DynamicallyLoadedModuleNames", "Weak": "PublicWeakDependencyModuleNames|WeakDependencyModuleNames", "Circular": "CircularlyReferencedDependentModules"}
    text = strip_comments(descriptor)
    blocks = F.regexp_extract_all(text, F.lit(rf"(?s)\b(?:{words[kind]})\s*\.\s*(?:AddRange|Add)\s*\(\s*(?:new\s+(?:string)?\s*\[\s*\]\s*)?\{{?(.*?)\)"), F.lit(1))
    names = F.flatten(F.transform(blocks, lambda b: F.regexp_extract_all(b, F.lit(r'"([^"]+)"'), F.lit(1))))
    return F.array_sort(F.array_distinct(names))


def all_dependencies(descriptor: ColumnOrName) -> Column:
    return union_sorted(*[dependencies(descriptor, k) for k in ("Public", "Private", "Dynamic", "Weak", "Circular")])


def includes(source: ColumnOrName) -> Column:
    return F.regexp_extract_all(col(source), F.lit(r'(?m)^[ \t]*#[ \t]*include\s+["<]([^">]+)[">]'), F.lit(1))


def callees(body: ColumnOrName) -> Column:
    names = F.regexp_extract_all(blank_strings(strip_comments(body)), F.lit(r"\b([A-Za-z_]\w*)\s*\("), F.lit(1))
    return F.array_distinct(F.filter(names, lambda n: ~n.isin(sorted(KEYWORDS)) & (F.length(n) > 1)))


def called_functions(line: ColumnOrName) -> Column:
    """Identifiers of more than two letters before a bracket in a line."""
    return F.filter(callees(line), lambda n: F.length(n) > 2)


def used_class(line: ColumnOrName) -> Column:
    """The class a line makes or holds, by the first pattern that fits; null if none does."""
    part = lambda p: F.nullif(F.regexp_extract(col(line), p, 1), F.lit(""))
    direct = part(r"\bnew\s+([A-Z]\w*)\s*\(")
    plain = part(r"\b([AU][A-Z]\w*)\s*\(")
    return F.coalesce(part(r"(?:NewObject|CreateDefaultSubobject)\s*<\s*(\w+)"), part(r"T(?:Shared|Unique|Weak)Ptr\s*<\s*(\w+)"), F.when(~F.coalesce(direct, F.lit("F")).startswith("F"), direct), plain)


def type_alias(line: ColumnOrName) -> Column:
    """struct<name,underlying> of ``using A = B;`` or ``typedef B A;``, else null."""
    u, t = r"^\s*using\s+([A-Za-z_]\w*)\s*=\s*([^;]+?)\s*;", r"^\s*typedef\s+([^;]+?)\s+([A-Za-z_]\w*)\s*;"
    x = col(line)
    return F.when(x.rlike(u), F.struct(F.regexp_extract(x, u, 1).alias("name"), F.regexp_extract(x, u, 2).alias("underlying"))).when(x.rlike(t), F.struct(F.regexp_extract(x, t, 2).alias("name"), F.regexp_extract(x, t, 1).alias("underlying")))


def enum_values(body: ColumnOrName) -> Column:
    """Names of an enum's body: values and ``UMETA(..)`` dropped."""
    parts = F.transform(split_params(F.regexp_replace(strip_comments(body), r"UMETA\s*\([^)]*\)", "")), lambda p: F.trim(F.substring_index(p, "=", 1)))
    return F.filter(parts, lambda p: p.rlike(r"^[A-Za-z_]\w*$"))


def first_json_object(text: ColumnOrName) -> Column:
    """The first complete top-level object of concatenated JSON, braces within strings and escapes aside; null if there is none."""
    at = F.locate("{", col(text))
    # objects of up to three levels by one regex; deeper ones by a fold over braces, strings and what is between, not over characters
    fold = F.when(at > 0, _outer_object(F.substr(col(text), at)))
    return F.coalesce(F.nullif(F.regexp_extract(col(text), r"(?s)\A[^{]*+(" + _OBJECT + ")", 1), F.lit("")), fold)


_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_OBJECT = rf'\{{(?:[^{{}}"]++|{_STRING})*+\}}'
for _ in range(2):
    _OBJECT = rf'\{{(?:[^{{}}"]++|{_STRING}|{_OBJECT})*+\}}'


def _outer_object(c: Column) -> Column:
    """The object that a text begins with, or null."""
    tokens = F.regexp_extract_all(c, F.lit(rf'(?s)[{{}}]|{_STRING}|"(?:.*+)|[^{{}}"]++'), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(False).alias("over"))

    def step(a, x):
        depth = a["depth"] + F.when(x == "{", 1).when(x == "}", -1).otherwise(0)
        return F.when(a["over"], a).otherwise(F.struct(depth.alias("depth"), (a["n"] + F.length(x)).alias("n"), (depth == 0).alias("over")))

    end = F.aggregate(tokens, start, step, lambda a: F.when(a["over"], a["n"]))
    return F.substr(c, F.lit(1), end)


def version(build_json: ColumnOrName, directory: ColumnOrName, default: str = "unknown") -> Column:
    """Major.Minor.Patch of a version file, else the number in the directory's name, else the default."""
    part = lambda k: F.get_json_object(col(build_json), f"$.{k}")
    return F.coalesce(F.concat(part("MajorVersion"), F.lit("."), part("MinorVersion"), F.lit("."), F.coalesce(part("PatchVersion"), F.lit("0"))), F.nullif(F.regexp_extract(basename(directory), r"(\d+\.\d+(?:\.\d+)?)", 1), F.lit("")), F.lit(default))


def expired(now: ColumnOrName, created: ColumnOrName, ttl_seconds: ColumnOrName | int) -> Column:
    ttl = (F.lit(ttl_seconds) if isinstance(ttl_seconds, int) else col(ttl_seconds)).cast("long")
    return F.unix_micros(col(now).cast("timestamp")) - F.unix_micros(col(created).cast("timestamp")) > ttl * 1_000_000


def speed(n: ColumnOrName, seconds: ColumnOrName) -> Column:
    """Items a second, 0 in no time."""
    return F.when(col(seconds) == 0, F.lit(0.0)).otherwise(col(n) / col(seconds))


def eta(total: ColumnOrName, done: ColumnOrName, seconds: ColumnOrName) -> Column:
    return F.when(speed(done, seconds) == 0, F.lit(0.0)).otherwise((col(total) - col(done)) / speed(done, seconds))
