"""Graphs as node and edge tables. Edges run from the class to its parent, from caller to callee.

Bounded walks are chains of equi-joins; unbounded ones loop until a round changes
nothing, each round written to the shared folder. Walks carry their path and stop at
a node that is on it, unless cycles are asked for.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cairn.functions.expr import node_id, or_empty

from . import dense
from .iterate import dealt, materialize
from .joins import dangling

# ---------------------------------------------------------------- building


def class_graph(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (module, node_id, type, name) and edges (module, src, dst, type): classes, inherits and implements; parents unknown in the module get a placeholder node."""
    own = classes.select("module", node_id("class", "name").alias("node_id"), F.lit("class").alias("type"), "name").distinct()
    edge = lambda c, kind: classes.select("module", F.col("name"), F.explode(or_empty(c)).alias("to")).select("module", node_id("class", "name").alias("src"), node_id("class", "to").alias("dst"), F.lit(kind).alias("type"), "to")
    edges = edge("parent_classes", "inherits").unionByName(edge("interfaces", "implements")).distinct()
    unknown = edges.select("module", F.col("dst").alias("node_id"), F.lit("placeholder").alias("type"), F.col("to").alias("name")).distinct().join(own.select("module", "node_id"), ["module", "node_id"], "left_anti")
    return own.unionByName(unknown), edges.drop("to")


def module_graph(classes: DataFrame, functions: DataFrame, enums: DataFrame, delegates: DataFrame, includes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The full graph of parsed records (module, path, name, line, ..): file, class, method, function, enum, delegate and include nodes;
    contains, inherits, implements, has_method and includes edges. Ids of functions hold their line, so overloads stay apart."""
    file_id = node_id("file", "path")

    def kind(df, name, *parts):
        return df.select("module", "path", node_id(name, *parts).alias("node_id"), F.lit(name).alias("type"), "name", "line")

    named = [
        kind(classes, "class", "name"),
        kind(functions.filter("class_name is not null"), "method", "class_name", "name", "line"),
        kind(functions.filter("class_name is null"), "function", "name", "line"),
        kind(enums, "enum", "name"),
        kind(delegates, "delegate", "name"),
    ]
    inner = named[0]
    for n in named[1:]:
        inner = inner.unionByName(n)
    inc = includes.select("module", "path", F.col("include").alias("name"), node_id("include", "include").alias("node_id"), F.lit("include").alias("type"), "line")
    files = inner.select("module", "path").unionByName(inc.select("module", "path")).distinct().select("module", "path", file_id.alias("node_id"), F.lit("file").alias("type"), F.col("path").alias("name"), F.lit(0).cast("int").alias("line"))
    nodes = files.unionByName(inner).unionByName(inc)
    nodes = nodes.groupBy("module", "node_id", "type").agg(F.min("name").alias("name"), F.min("path").alias("path"), F.min("line").alias("line"))
    contains = inner.filter("type <> 'method'").select("module", file_id.alias("src"), F.col("node_id").alias("dst"), F.lit("contains").alias("type"))
    includes_ = inc.select("module", file_id.alias("src"), F.col("node_id").alias("dst"), F.lit("includes").alias("type"))
    methods = functions.filter("class_name is not null").select("module", node_id("class", "class_name").alias("src"), node_id("method", "class_name", "name", "line").alias("dst"), F.lit("has_method").alias("type"))
    _, heirs = class_graph(classes)
    edges = contains.unionByName(includes_).unionByName(methods).unionByName(heirs).distinct()
    return nodes, edges


def call_graph(calls: DataFrame) -> DataFrame:
    """src, dst of distinct caller, callee pairs."""
    return dealt(calls.select(F.col("caller").alias("src"), F.col("callee").alias("dst")), "src", "dst").distinct()


def add(df: DataFrame, rows: DataFrame) -> DataFrame:
    """Nodes or edges added; equal rows once."""
    return df.unionByName(rows, allowMissingColumns=True).distinct()


# ---------------------------------------------------------------- degrees


def layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """name, n_in, n_out, layer: isolated, bottom (nothing points here), top (points nowhere), middle."""
    n_in = edges.groupBy(F.col("dst").alias("name")).agg(F.count(F.lit(1)).alias("n_in"))
    n_out = edges.groupBy(F.col("src").alias("name")).agg(F.count(F.lit(1)).alias("n_out"))
    deg = nodes.select("name").distinct().join(n_in, "name", "left").join(n_out, "name", "left").select("name", F.coalesce("n_in", F.lit(0)).alias("n_in"), F.coalesce("n_out", F.lit(0)).alias("n_out"))
    layer = F.when((F.col("n_in") == 0) & (F.col("n_out") == 0), "isolated").when(F.col("n_in") == 0, "bottom").when(F.col("n_out") == 0, "top").otherwise("middle")
    return deg.withColumn("layer", layer)


def isolates(nodes: DataFrame, edges: DataFrame, key: str = "name") -> DataFrame:
    used = edges.select(F.explode(F.array("src", "dst")).alias(key)).distinct()
    return nodes.select(key).distinct().join(used, key, "left_anti")


# ---------------------------------------------------------------- hierarchy


def hierarchy(parents: DataFrame, start: DataFrame, depth: int = 3) -> DataFrame:
    """start, level, name: the chain of first parents (child, parent), the class itself at level 0, below ``depth``; a cycle ends it."""
    walk = start.select(F.col("name").alias("start"), F.lit(0).alias("level"), F.col("name"), F.array("name").alias("path"))
    out = walk
    up = parents.filter("parent is not null").groupBy("child").agg(F.min("parent").alias("parent"))
    for level in range(1, depth):
        walk = walk.join(up, walk["name"] == up["child"]).filter(~F.array_contains("path", F.col("parent"))).select("start", F.lit(level).alias("level"), F.col("parent").alias("name"), F.concat("path", F.array("parent")).alias("path"))
        out = out.unionByName(walk)
    return out.select("start", "level", "name")


def inheritance_chain(parents: DataFrame, start: DataFrame) -> DataFrame:
    """start, chain: root first, the class last, however long; a cycle ends it. Chains double with each round, so that there are as many rounds as the longest one has binary digits."""
    up = parents.filter("parent is not null").groupBy("child").agg(F.min("parent").alias("parent"))
    # of each child the next ancestors, nearest first, and the last of them as long as it may lead on
    reach = materialize(up.select("child", F.array_distinct(F.array("child", "parent")).alias("path"), F.when(F.col("child") != F.col("parent"), F.col("parent")).alias("at")))
    while reach.filter("at is not null").limit(1).count():
        far = reach.select(F.col("child").alias("via"), F.col("path").alias("far"), F.col("at").alias("far_at"))
        both = F.array_distinct(F.concat("path", "far"))
        grown = reach.join(far, reach["at"] == far["via"], "left").select(
            "child", F.when(F.col("via").isNull(), F.col("path")).otherwise(both).alias("path"),
            F.when(F.size(both) == F.size("path") + F.size("far") - 1, F.col("far_at")).alias("at"),
        )
        reach = materialize(grown)
    chain = F.coalesce(F.reverse("path"), F.array("name"))
    return start.join(reach, start["name"] == reach["child"], "left").select(F.col("name").alias("start"), chain.alias("chain"))


# ---------------------------------------------------------------- paths


def callee_paths(edges: DataFrame, start: DataFrame, max_depth: int = 2) -> DataFrame:
    """path: every walk from a start along the edges that has ``max_depth`` steps or ends where nothing leads on. Cycles are walked."""
    e = edges.select("src", "dst").distinct()
    walk = start.select(F.array("name").alias("path"), F.col("name").alias("at"))
    out = None
    for _ in range(max_depth):
        step = walk.join(e, walk["at"] == e["src"], "left")
        ended = step.filter("dst is null and size(path) > 1").select("path")
        out = ended if out is None else out.unionByName(ended)
        walk = step.filter("dst is not null").select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("at"))
    return out.unionByName(walk.select("path"))


def caller_paths(edges: DataFrame, start: DataFrame, max_depth: int = 2) -> DataFrame:
    """path: walks that end in a start, the farthest caller first."""
    back = callee_paths(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), start, max_depth)
    return back.select(F.reverse("path").alias("path"))


def shortest_path(edges: DataFrame, source, target, max_depth: int = 5) -> list | None:
    """The shortest path, of several the smallest by its nodes in order; None if there is none of ``max_depth`` steps."""
    found = distances(edges, source, max_depth, target, paths=True).filter(F.col("name") == F.lit(target)).select("path").first()
    return list(found[0]) if found else None


def distances(edges: DataFrame, source, max_depth: int = 5, target=None, paths: bool = False) -> DataFrame:
    """name, n_steps (and path) of every node within reach: breadth first, a frontier at a time, against the nodes seen."""
    spark = edges.sparkSession
    e = materialize(edges.select("src", "dst").distinct())
    kind = e.schema["src"].dataType.simpleString()
    level = spark.range(1).select(F.lit(source).cast(kind).alias("name"), F.lit(0).alias("n_steps"), F.array(F.lit(source).cast(kind)).alias("path"))
    seen = materialize(level)
    level = seen
    for d in range(1, max_depth + 1):
        if target is not None and level.filter(F.col("name") == F.lit(target)).limit(1).count():
            break
        nxt = level.join(e, level["name"] == e["src"]).select(F.col("dst").alias("name"), F.lit(d).alias("n_steps"), F.concat("path", F.array("dst")).alias("path"))
        nxt = nxt.groupBy("name", "n_steps").agg(F.min("path").alias("path")).join(seen.select("name"), "name", "left_anti")
        level = materialize(nxt)
        if not level.limit(1).count():
            break
        seen = seen.unionByName(level)
    return seen if paths else seen.drop("path")


# ---------------------------------------------------------------- components


def weak_components(nodes: DataFrame, edges: DataFrame, key: str = "name") -> DataFrame:
    """name, component (the smallest name reachable, directions ignored)."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    both = materialize(both)
    label = materialize(nodes.select(F.col(key).alias("name")).distinct().withColumn("component", F.col("name")))
    while True:
        near = both.join(label, both["dst"] == label["name"]).groupBy("src").agg(F.min("component").alias("near"))
        step = label.join(near, label["name"] == near["src"], "left").select("name", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = label.select(F.col("name").alias("via"), F.col("component").alias("far"))
        new = materialize(step.join(jump, step["component"] == jump["via"], "left").select("name", "old", F.least("component", "far").alias("component")))
        if not new.filter("component <> old").limit(1).count():
            return new.drop("old")
        label = new.drop("old")


def _dense(edges: DataFrame) -> dense.Dense | None:
    """The written edges (src, dst) by numbered nodes; None where there are more than ``dense.LIMIT``."""
    nodes = materialize(edges.select(F.explode(F.array("src", "dst")).alias("name")).distinct())
    n = nodes.count()
    return dense.Dense(edges, nodes, n) if n <= dense.LIMIT else None


def strong_components(edges: DataFrame) -> DataFrame:
    """name, component (the largest name in it)."""
    edges = materialize(edges.select("src", "dst"))
    g = _dense(edges)
    try:
        found = g and g.components()
    except dense.SplitNode:
        found = None
    if found is None:
        return _strong_by_joins(edges)
    held = edges.sparkSession.sparkContext.broadcast(found)

    def run(batches):
        for rb in batches:
            yield pa.RecordBatch.from_arrays([rb.column("name"), pa.array(held.value[rb.column("id").to_numpy()])], names=["name", "root"])

    root = g.nodes.mapInArrow(run, f"name {g.nodes.schema['name'].dataType.simpleString()}, root int")
    return root.join(g.nodes.select(F.col("id").alias("root"), F.col("name").alias("component")), "root").select("name", "component")


def _strong_by_joins(edges: DataFrame) -> DataFrame:
    """Forward colouring by the largest id, then the backward reach of each colour's root; rounds until no node is left."""
    e = materialize(edges.filter("src <> dst").select("src", "dst").distinct())
    left = materialize(edges.select(F.explode(F.array("src", "dst")).alias("name")).distinct())
    done = None
    while left.limit(1).count():
        colour = materialize(left.withColumn("colour", F.col("name")))
        while True:
            came = e.join(colour, e["src"] == colour["name"]).groupBy("dst").agg(F.max("colour").alias("came"))
            new = materialize(colour.join(came, colour["name"] == came["dst"], "left").select("name", F.col("colour").alias("old"), F.greatest("colour", "came").alias("colour")))
            colour = new.drop("old")
            if not new.filter("colour <> old").limit(1).count():
                break
        c = colour
        within = e.join(c.select(F.col("name").alias("src"), F.col("colour").alias("cs")), "src").join(c.select(F.col("name").alias("dst"), F.col("colour").alias("cd")), "dst").filter("cs = cd").select("src", "dst", F.col("cs").alias("colour"))
        within = materialize(within)
        reach = materialize(c.filter("name = colour").select("name", F.col("colour").alias("component")))
        front = reach
        while front.limit(1).count():
            back = within.join(front, (within["dst"] == front["name"]) & (within["colour"] == front["component"])).select(F.col("src").alias("name"), "component").distinct()
            front = materialize(back.join(reach.select("name"), "name", "left_anti"))
            reach = reach.unionByName(front)
        reach = materialize(reach)
        done = reach if done is None else done.unionByName(reach)
        left = materialize(left.join(reach.select("name"), "name", "left_anti"))
        e = materialize(e.join(left.select(F.col("name").alias("src")), "src", "left_semi").join(left.select(F.col("name").alias("dst")), "dst", "left_semi"))
    return done if done is not None else left.select("name", F.col("name").alias("component"))


def longest_path(edges: DataFrame) -> int | None:
    """Edges of the longest path of an acyclic graph; None if there is a cycle."""
    edges = materialize(edges.select("src", "dst"))
    g = _dense(edges)
    try:
        level = g and g.levels(g.forward)
    except dense.SplitNode:
        level = None
    if level is None:
        return _longest_by_joins(edges)
    return None if (level < 0).any() else int(level.max(initial=0))


def _longest_by_joins(edges: DataFrame) -> int | None:
    """Nodes without predecessors are peeled, level by level."""
    e = materialize(edges.select("src", "dst").distinct())
    level, n = 0, e.count()
    while n:
        rest = materialize(e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi"))
        left = rest.count()
        if left == n:
            return None
        e, level, n = rest, level + 1, left
    return level


def statistics(nodes: DataFrame, edges: DataFrame, key: str = "name") -> DataFrame:
    """n_nodes, n_edges, n_isolates, n_components."""
    lone = isolates(nodes, edges, key).agg(F.count(F.lit(1)).alias("n_isolates"))
    comps = weak_components(nodes, edges, key).agg(F.countDistinct("component").alias("n_components"))
    n = nodes.agg(F.countDistinct(key).alias("n_nodes"))
    return n.crossJoin(edges.agg(F.count(F.lit(1)).alias("n_edges"))).crossJoin(lone).crossJoin(comps)  # four single rows


def call_statistics(edges: DataFrame) -> DataFrame:
    """n_nodes, n_edges, n_isolates (nodes whose only edges are their own), n_components (strong), longest_path ('N/A' with a cycle)."""
    edges = materialize(edges.select("src", "dst"))
    scc = materialize(strong_components(edges))
    n = scc.agg(F.count(F.lit(1)).alias("n_nodes"), F.countDistinct("component").alias("n_components"))
    lone = isolates(edges.select(F.explode(F.array("src", "dst")).alias("name")), edges.filter("src <> dst")).agg(F.count(F.lit(1)).alias("n_isolates"))
    one = n.first()
    cyclic = one.n_components < one.n_nodes or edges.filter("src = dst").limit(1).count() > 0
    path = None if cyclic else longest_path(edges)
    return n.crossJoin(edges.agg(F.count(F.lit(1)).alias("n_edges"))).crossJoin(lone).withColumn("longest_path", F.lit("N/A" if path is None else str(path)))


def verify(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """problem (isolate, dangling), name."""
    lone = isolates(nodes, edges, "node_id").select(F.lit("isolate").alias("problem"), F.col("node_id").alias("name"))
    return lone.unionByName(dangling(edges, nodes).select(F.lit("dangling").alias("problem"), F.col("dst").alias("name")).distinct())
