"""The knowledge-base build: descriptors and sources in, Parquet tables out; resumable, incremental, one lazy plan a stage.

Stages, in order: discover, extract, analyze, build, generate. Each writes its table with
an atomic commit (``_SUCCESS``) and is skipped where that is there, unless forced. Files
are read and parsed once; a file that fails gives a row in ``failures``, not a failed
run. Tables, schemas and marks are written through Spark's file systems, so the
knowledge base and the source tree may lie on HDFS or an object store.
"""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from cairn.functions import expr as X
from cairn.functions.parsing import KINDS, examples, of_kind, parse_all
from cairn.operators import graph, incremental, joins, sequence, stats
from cairn.operators.iterate import materialize
from cairn.sources import detect, files as S, storage

STAGES = ("discover", "extract", "analyze", "build", "generate")
#: What a parse gives, by module.
PARSED = ("files", *(f"parsed_{k}" for k in KINDS if k != "failures"), "failures")
OUTPUTS = {"discover": ["found"], "extract": ["manifest"], "analyze": [*PARSED], "build": ["modules", "classes", "functions", "enums", "examples", "nodes", "edges", "calls", "kb"], "generate": ["README"]}
PARTITIONED = (*PARSED, "nodes", "edges", "classes", "functions")
#: Changed modules whose folders alone an update reads; with more, it lists the whole tree.
FOLDERS = 1000
TEMPLATE = "# {NAME} knowledge base\n\nVersion {VERSION}, {MODULES} modules. Open with `Index.load(spark, \"{PATH}\")`; commands: {COMMANDS}.\n"


def render(template: str, values: dict[str, object]) -> str:
    """``{KEY}`` replaced by its value, then doubled braces by single ones."""
    for k, v in values.items():
        template = template.replace("{" + k + "}", str(v))
    return template.replace("{{", "{").replace("}}", "}")


def render_column(template: str, values: dict[str, str]) -> F.Column:
    """``render`` over rows, with a column for each key."""
    out = F.lit(template)
    for k, c in values.items():
        out = F.replace(out, F.lit("{" + k + "}"), F.col(c).cast("string"))
    return F.replace(F.replace(out, F.lit("{{"), F.lit("{")), F.lit("}}"), F.lit("}"))


@dataclass
class Build:
    spark: SparkSession
    root: str
    out: str
    config: dict = field(default_factory=dict)

    # ---- stage state

    def path(self, table: str) -> str:
        return f"{self.out.rstrip('/')}/{table}"

    def read(self, table: str) -> DataFrame | None:
        return S.stage(self.spark, self.path(table))

    def is_complete(self, stage: str) -> bool:
        return all(storage.exists(self.spark, self.path(t) + (".md" if t == "README" else "/_SUCCESS")) for t in OUTPUTS[stage])

    def status(self) -> DataFrame:
        """stage, position, is_complete."""
        return self.spark.createDataFrame([(s, i, self.is_complete(s)) for i, s in enumerate(STAGES)], "stage string, position int, is_complete boolean")

    def clean(self, stage: str | None = None) -> None:
        for s in [stage] if stage else STAGES:
            for t in OUTPUTS[s]:
                storage.delete(self.spark, self.path(t) + ".md" * (t == "README"))

    def _write(self, df: DataFrame, table: str) -> None:
        w = df.write.mode("overwrite").option("partitionOverwriteMode", "static")
        (w.partitionBy("module") if table in PARTITIONED else w).parquet(self.path(table))
        storage.write_text(self.spark, self.path(table) + "/_schema.json", df.schema.json())  # a table without rows tells no schema

    def _replace(self, df: DataFrame, table: str, modules: list[str]) -> None:
        """The partitions of ``modules`` anew: those of which ``df`` has no row are gone."""
        for m in modules:
            storage.delete(self.spark, f"{self.path(table)}/{storage.partition('module', m)}")
        df.write.mode("append").partitionBy("module").parquet(self.path(table))
        if not storage.exists(self.spark, self.path(table) + "/_schema.json"):
            storage.write_text(self.spark, self.path(table) + "/_schema.json", df.schema.json())

    def _replace_all(self, df: DataFrame, table: str) -> None:
        """The partitions of the modules that ``df`` has rows of anew."""
        self._replace(df, table, [r.module for r in df.select("module").distinct().toLocalIterator()])

    def save_result(self, df: DataFrame, table: str) -> None:
        """A stage's result with what is known of it: its name, rows and time."""
        self._write(df, table)
        n = self.read(table).count()
        storage.write_text(self.spark, self.path(table) + "/_metadata.json", json.dumps({"stage": table, "n_rows": n, "created": time.time()}))

    def metadata(self, table: str) -> dict | None:
        at = self.path(table) + "/_metadata.json"
        return json.loads(storage.read_text(self.spark, at)) if storage.exists(self.spark, at) else None

    def run(self, force: bool = False, only: str | None = None) -> dict[str, float | str]:
        """Runs the stages in order and stops at the first that fails; seconds of each, ``skipped`` or the error."""
        result: dict[str, float | str] = {}
        for s in [only] if only else STAGES:
            missing = [p for p in STAGES[: STAGES.index(s)] if not self.is_complete(p)]
            if missing:
                result[s] = f"error: run {missing[0]} first"
                break
            if self.is_complete(s) and not force:
                result[s] = "skipped"
                continue
            began = time.time()
            try:
                getattr(self, s)()
            except Exception as e:  # a stage's error is its result, as the caller goes on to report it
                result[s] = f"error: {e}"
                break
            result[s] = time.time() - began
        return result

    # ---- stages

    def _mode(self) -> str:
        return "engine" if storage.exists(self.spark, f"{self.root.rstrip('/')}/Engine") else "plugin"

    def _version(self) -> str:
        at = f"{self.root.rstrip('/')}/Engine/Build/Build.version"
        return detect.engine_version(self.root, info=storage.read_text(self.spark, at) if storage.exists(self.spark, at) else None)

    def discover(self) -> None:
        found = S.engine_descriptors(self.spark, f"{self.root.rstrip('/')}/Engine") if self._mode() == "engine" else S.plugin_descriptors(self.spark, self.root)
        self._write(found, "found")

    def _hashes(self) -> DataFrame:
        found = self.read("found")
        hashed = S.with_module(S.hashed_files(self.spark, self.root), found).select("module", "path", "sha256")
        hashed = hashed.unionByName(found.select(F.col("name").alias("module"), F.concat("absolute_path", F.lit("/"), "name", F.lit(".Build.cs")).alias("path"), F.col("file_hash").alias("sha256")))
        return incremental.manifest(hashed)

    def extract(self) -> None:
        self._write(self._hashes(), "manifest")

    def _parse(self, src: DataFrame, write) -> None:
        """Reads and parses each file of ``src`` (path, text, module) once and writes its text and its records by kind."""
        src = materialize(src)
        write(src, "files")
        parsed = materialize(parse_all(src))
        for kind in KINDS:
            df = of_kind(parsed, kind)
            write(df.filter(F.col("path").endswith(".cpp")) if kind == "calls" else df, kind if kind == "failures" else f"parsed_{kind}")

    def analyze(self) -> None:
        self._parse(S.with_module(S.sources(self.spark, self.root), self.read("found")), self._write)

    def build(self) -> None:
        found, src = self.read("found"), self.read("files")
        classes, functions, enums, delegates, includes, calls = (self.read(f"parsed_{k}") for k in ("classes", "functions", "enums", "delegates", "includes", "calls"))
        rename = {"path": "file_path", "line": "line_number"}
        deps = found.select("name", *[X.dependencies("text", k).alias(f"{k.lower()}_dependencies") for k in ("Public", "Private", "Dynamic", "Weak", "Circular")])
        modules = joins.with_dependencies(found.select("name", "category", "path", F.concat("absolute_path", F.lit("/"), "name", F.lit(".Build.cs")).alias("build_cs_path")), deps)
        counts = stats.file_counts(src).withColumnRenamed("module", "name").withColumnRenamed("n_lines", "estimated_lines")
        main = classes.filter("is_uclass").groupBy(F.col("module").alias("name")).agg(F.slice(F.sort_array(F.collect_set("name")), 1, 20).alias("main_classes"))
        modules = modules.join(counts, "name", "left").join(main, "name", "left").withColumn("plugin", F.lit("Engine")).withColumn("indexed_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"))
        self._write(modules, "modules")
        self._write(classes.withColumnsRenamed(rename).withColumn("method_count", F.size("methods")).withColumn("property_count", F.size("properties")), "classes")
        impl = joins.implementation_file(functions.select("name", F.col("path").alias("header")).distinct(), joins.resolve_includes(includes.filter(F.col("path").endswith(".cpp")).join(found.select(F.col("name").alias("module"), F.col("absolute_path").alias("module_root")), "module").select("module_root", F.col("path").alias("cpp"), "include"), src.filter(F.col("path").endswith(".h")).select("path")).select("header", "cpp"))
        self._write(functions.join(impl.select("name", F.col("header").alias("path"), F.col("cpp").alias("impl_file_path")), ["name", "path"], "left").withColumnsRenamed(rename), "functions")
        self._write(enums.withColumnsRenamed(rename), "enums")
        ln = sequence.lines(src.withColumnRenamed("path", "source_file"), "source_file")
        self._write(examples(ln), "examples")
        nodes, edges = graph.module_graph(classes, functions, enums, delegates, includes)
        self._write(nodes, "nodes")
        self._write(edges, "edges")
        self._write(graph.call_graph(calls), "calls")
        info = {"kb_version": "1", "engine_version": self._version(), "build_mode": self._mode(), "plugin_name": next((n[: -len(".uplugin")] for n in storage.names(self.spark, self.root) if n.endswith(".uplugin")), "")}
        self._write(self.spark.createDataFrame([(k, str(v)) for k, v in info.items()], "key string, value string"), "kb")

    def generate(self) -> None:
        from .commands import Index

        info = {r.key: r.value for r in self.read("kb").collect()}  # a handful of settings
        text = render(self.config.get("template", TEMPLATE), {"NAME": info["plugin_name"] or info["build_mode"], "VERSION": info["engine_version"], "MODULES": self.read("modules").count(), "PATH": self.out, "COMMANDS": ", ".join(Index.COMMANDS)})
        storage.write_text(self.spark, self.path("README") + ".md", text)

    # ---- updates

    def check(self) -> dict[str, int]:
        """Modules by status of change against the manifest; writes nothing but the list of modules found."""
        return self._changes()[0]

    def _changes(self) -> tuple[dict[str, int], DataFrame, DataFrame]:
        old = self.read("manifest")
        self.discover()
        new = materialize(self._hashes())
        status = {r.status: r.n for r in joins.diff(old, new).groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
        return status, old, new

    def update(self) -> dict[str, int]:
        """Hashes the tree, reads and parses the modules that changed, puts their partitions in place of the old ones (also of kinds of which they have no
        record any more), removes those of modules that are gone, and makes the index tables again from the parsed ones. Counts by status."""
        status, old, new = self._changes()
        if set(status) <= {"unchanged"}:
            return status
        d = materialize(joins.diff(old, new).filter("status <> 'unchanged'").select("name", "status"))
        names = [r.name for r in d.select("name").toLocalIterator()]  # the names of the modules to replace, streamed
        changed = d.filter("status <> 'removed'").select(F.col("name").alias("module"))
        found = self.read("found")
        roots = [r.absolute_path for r in found.join(changed.withColumnRenamed("module", "name"), "name", "left_semi").select("absolute_path").limit(FOLDERS + 1).collect()]
        src = S.sources(self.spark, self.root if len(roots) > FOLDERS else roots) if roots else self.read("files").limit(0).select("path", "text")
        src = S.with_module(src, found).join(changed, "module", "left_semi").dropDuplicates(["path"])  # a module within another's folder is listed twice
        self._parse(src.select("path", "text", "module"), lambda df, t: self._replace(df, t, names))
        self._write(materialize(incremental.merge(old, new)), "manifest")
        self.build()
        self.generate()
        return status


def partitioned(build: Build, run) -> dict[str, str]:
    """Runs ``run(modules)`` for each build partition of the discovered modules; one that fails does not stop the others."""
    found = build.read("found").withColumn("part", X.partition_of("category"))
    out = {}
    for r in found.select("part").distinct().orderBy("part").collect():  # a handful of partitions
        try:
            run(found.filter(F.col("part") == r.part))
            out[r.part] = "done"
        except Exception as e:  # reported to the caller by partition
            out[r.part] = f"error: {e}"
    return out


def partition_status(build: Build) -> DataFrame:
    """part, n_modules, n_parsed: modules found in each build partition, and of how many a file has been read."""
    found = build.read("found").withColumn("part", X.partition_of("category"))
    files = build.read("files")
    done = files.select(F.col("module").alias("name")).distinct() if files is not None else found.limit(0).select("name")
    return found.join(done.withColumn("done", F.lit(1)), "name", "left").groupBy("part").agg(F.count(F.lit(1)).alias("n_modules"), F.count("done").alias("n_parsed"))


def main(args: list[str] | None = None) -> int:
    """init, update [--check], status, partitioned, partition-status, clean, query: ``python -m cairn.plans.build COMMAND ROOT OUT [ARGUMENTS]``."""
    import sys

    from .commands import Index

    args = sys.argv[1:] if args is None else args
    if len(args) < 3:
        print(main.__doc__)
        return 1
    spark = SparkSession.builder.getOrCreate()
    b = Build(spark, args[1], args[2])
    if args[0] == "init":
        out = b.run(force="--force" in args)
    elif args[0] == "update":
        out = b.check() if "--check" in args else b.update()
    elif args[0] == "status":
        out = [r.asDict() for r in b.status().collect()]  # five rows
    elif args[0] == "partitioned":
        out = b.run(only="discover") | partitioned(b, lambda found: b._parse(S.with_module(S.sources(spark, [r.absolute_path for r in found.select("absolute_path").toLocalIterator()]), found), lambda df, t: b._replace_all(df, t)))
    elif args[0] == "partition-status":
        out = [r.asDict() for r in partition_status(b).orderBy("part").collect()]  # six rows
    elif args[0] == "clean":
        out = b.clean(args[3] if len(args) > 3 else None)
    elif args[0] == "query":
        print(Index.load(spark, args[2]).run(*args[3:]))
        return 0
    else:
        print(main.__doc__)
        return 1
    print(json.dumps(out))
    return int(isinstance(out, dict) and any(str(v).startswith("error") for v in out.values()))


if __name__ == "__main__":
    raise SystemExit(main())
