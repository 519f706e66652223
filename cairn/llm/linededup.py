"""Line dedup over levelled sorted runs of line hashes.

A run is a table bucketed and sorted by a 128-bit hash of the line's key, with
the number of documents that hold the line and the largest doc_id among them.
Each new batch is aggregated (map-side first, so a line in a third of all rows
is one row per task) and merge-anti-joined with the runs: the lines that none of
them holds are written as a run of level 0, the counts of the others as a run of
repeats. When a level holds ``fanout``
runs they are merged into one run of the next level, so a table of n batches
keeps about ``fanout * log(n)`` runs. Runs lie in the shared folder: a lost
executor loses none, and bucketing makes the merge joins and compactions free of
shuffles of earlier runs.

The lines that go are found in the texts where they are read: the repeated lines' hashes
are broadcast while they are ``MAX_REPEATED`` or fewer (24 bytes each), so no text is
shuffled. Beyond that, each row's own are gathered by doc_id and the text's hash (a
row's lines at most), and joined to the texts by shuffle, those that many rows share by
broadcast.

Rows count as documents: repeated rows of one doc_id each count, and all of them
keep the line where that doc_id is the largest. A null doc_id is below all
others. A null text is one empty line. An empty table gives an empty result; extra
columns of any name are ignored. Keys that differ but have equal hashes: about one in
2**128 pairs.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from ._common import batch, binary, materialize, mix, only, remove, shared_dir, skew_join, slices

MIN_CHARS, MIN_DOCS, BATCHES, FANOUT = 20, 3, 4, 4
#: Repeated lines that are broadcast at most (48 MB).
MAX_REPEATED = 2_000_000

_LINES = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("n_docs", pa.int64()), ("last_doc", pa.int64()), ("batch", pa.int32())])
_NULL_ID = np.int64(-(2**63))


def _keys(text: bytes, min_chars: int) -> list[tuple[bytes, bytes | None]]:
    """Each line with its key's digest, or None where the key is shorter than ``min_chars`` code points."""
    out = []
    for line in text.split(b"\n"):
        key = line.strip().lower()
        long = len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars)
        out.append((line, xxhash.xxh3_128_digest(key) if long else None))
    return out


def _combine(h: np.ndarray, doc: np.ndarray, part: np.ndarray) -> list:
    """Rows of equal hash and batch as one: h1, h2, how many, the largest document."""
    order = np.lexsort((doc, h[:, 1], h[:, 0], part))
    h, doc, part = h[order], doc[order], part[order]
    last = np.append((h[1:] != h[:-1]).any(1) | (part[1:] != part[:-1]), True)[: len(h)]
    end = np.flatnonzero(last)
    top = doc[end]
    return [h[end, 0], h[end, 1], np.diff(np.append(-1, end)), pa.array(top, mask=top == _NULL_ID), part[end].astype(np.int32)]


def _explode(min_chars: int, batches: int):
    def run(record_batches):
        for rb in record_batches:
            ids, text = rb.column(0).fill_null(int(_NULL_ID)).to_numpy(), binary(rb.column(1))
            digests, owner = [], []
            for a, b in slices(text):
                for i, t in enumerate(text.slice(a, b - a).to_pylist(), a):
                    own = {d for _, d in _keys(t or b"", min_chars) if d}
                    digests.extend(own)
                    owner.append(np.full(len(own), i))
            if digests:
                doc = ids[np.concatenate(owner)]
                part = (mix(doc.view(np.uint64)) % np.uint64(batches)).astype(np.int64)
                yield batch(_LINES, _combine(np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2), doc, part))

    return run


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = 1) -> DataFrame:
    """h1, h2, n_docs, last_doc, batch: of each long enough line key, its documents among those that a task reads together, and the largest doc_id. Documents fall into batches by their id."""
    return only(docs, "doc_id", "text").mapInArrow(_explode(min_chars, batches), "h1 long, h2 long, n_docs long, last_doc long, batch int")


class LineRuns:
    """The levelled runs: ``add`` a batch of line hashes, read ``counts``."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.fanout, self.dir = spark, fanout, shared_dir(spark)
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.repeats: list[str] = []

    def _write(self, df: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        # every table here comes partitioned by the buckets; the writer sorts
        df.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{self.dir}/{name}").saveAsTable(name)
        return name

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(r) for level in self.levels for r in level]

    def add(self, lines: DataFrame) -> DataFrame:
        """Adds a batch (h1, h2, n_docs, last_doc); returns the aggregated lines that no run held before.

        Those become the batch's own run; the counts of lines that a run holds already go to a smaller run of repeats.
        """
        # one exchange into the buckets' partitions, which the aggregation and the writer take as they are; a line of very many
        # documents is a row for each batch of them that a task has read
        lines = lines.repartition(self.buckets, "h1", "h2")
        own = self._write(lines.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc")))
        new = own
        if self.levels:
            fresh = self.spark.table(own)
            for r in self.runs():
                fresh = fresh.join(r.hint("merge"), ["h1", "h2"], "left_anti")
            new = self._write(fresh)
            self.repeats.append(self._write(self.spark.table(own).join(self.spark.table(new).hint("merge"), ["h1", "h2"], "left_anti")))
            self._forget([own])
        else:
            self.levels.append([])
        self.levels[0].append(new)
        added = self.spark.table(new)
        self._compact()
        return added

    def _compact(self) -> None:
        if len(self.repeats) >= self.fanout:
            old, self.repeats = self.repeats, [self._write(self._merged([self.spark.table(r) for r in self.repeats]))]
            self._forget(old)
        for k, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                merged = self._write(self._merged([self.spark.table(r) for r in level]))
                self.levels[k] = []
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(merged)
                self._forget(level)

    def _forget(self, names: list[str]) -> None:
        """Takes tables that a merge has replaced out of the catalog and deletes their files."""
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")
            remove(self.spark, f"{self.dir}/{name}")

    def close(self) -> None:
        """Removes all runs; what was read from them must be written before."""
        self._forget([r for level in self.levels for r in level] + self.repeats)
        self.levels, self.repeats = [], []

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        """Sorted runs merged two at a time by full outer merge joins, which their bucketing serves without a shuffle."""
        df = runs[0]
        for r in runs[1:]:
            x, y = df.alias("x"), r.alias("y")
            both = x.join(y.hint("merge"), ["h1", "h2"], "full_outer")
            df = both.select("h1", "h2", (F.coalesce("x.n_docs", F.lit(0)) + F.coalesce("y.n_docs", F.lit(0))).alias("n_docs"), F.greatest("x.last_doc", "y.last_doc").alias("last_doc"))
        return df

    def counts(self) -> DataFrame:
        """h1, h2, n_docs, last_doc over all runs."""
        return self._merged([*self.runs(), *map(self.spark.table, self.repeats)])


class Repeated:
    """The repeated lines and their last documents, as arrays sorted by hash."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray, last: np.ndarray, known: np.ndarray):
        order = np.lexsort((h2, h1))
        self.h1, self.h2, self.last, self.known = h1[order], h2[order], last[order], known[order]

    def gone(self, h: np.ndarray, doc: np.ndarray, has_id: np.ndarray) -> np.ndarray:
        """Whether each line hash is repeated and its document not the last that holds it."""
        a, b = np.searchsorted(self.h1, h[:, 0], "left"), np.searchsorted(self.h1, h[:, 0], "right")
        out = np.zeros(len(h), bool)
        while True:  # equal first halves are almost always one row
            at = np.flatnonzero(a < b)
            if not len(at):
                return out
            hit = at[self.h2[a[at]] == h[at, 1]]
            k = a[hit]
            out[hit] = np.where(self.known[k], ~has_id[hit] | (self.last[k] != doc[hit]), has_id[hit])
            a[at] += 1


def _finish(texts: list[bytes], keys: list, gone: list) -> list[tuple[bytes, int, int]]:
    """Each text without the lines that go, its lines and how many went."""
    out = []
    for t, own, g in zip(texts, keys, gone):
        if any(g):
            lines = [x for (x, _), drop in zip(own, g) if not drop]
            out.append((b"\n".join(lines), len(own), len(own) - len(lines)))
        else:
            out.append((t, len(own), 0))
    return out


def _drop_known(repeated, min_chars: int, schema: pa.Schema, finish):
    """Drops lines by the broadcast of all repeated ones."""

    def run(batches):
        known = repeated.value
        for rb in batches:
            ids, text = rb.column(0), binary(rb.column(1))
            doc, has_id = ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False)
            for a, b in slices(text):
                texts = [t or b"" for t in text.slice(a, b - a).to_pylist()]
                keys = [_keys(t, min_chars) for t in texts]
                digests = [d for own in keys for _, d in own if d]
                owner = np.repeat(np.arange(a, b), [sum(d is not None for _, d in own) for own in keys])
                lost = iter(known.gone(np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2), doc[owner], has_id[owner]).tolist())
                gone = [[d is not None and next(lost) for _, d in own] for own in keys]
                yield batch(schema, finish(rb.slice(a, b - a), _finish(texts, keys, gone)))

    return run


def _drop_listed(min_chars: int, schema: pa.Schema, finish):
    """Drops the lines whose hashes the row's ``digests`` lists."""

    def run(batches):
        for rb in batches:
            text, sets = binary(rb.column(1)), rb.column(rb.schema.get_field_index("digests"))
            for a, b in slices(text):
                texts, keys, gone = [t or b"" for t in text.slice(a, b - a).to_pylist()], [], []
                for t, s in zip(texts, sets.slice(a, b - a).to_pylist()):
                    lost = {int(x["h1"]).to_bytes(8, "little", signed=True) + int(x["h2"]).to_bytes(8, "little", signed=True) for x in s or ()}
                    keys.append(_keys(t, min_chars))
                    gone.append([d in lost for _, d in keys[-1]])
                yield batch(schema, finish(rb.slice(a, b - a), _finish(texts, keys, gone)))

    return run


def repeated_lines(docs: DataFrame, min_chars: int, min_docs: int, batches: int) -> DataFrame:
    """h1, h2, n_docs, last_doc of the line keys that ``min_docs`` documents or more hold, from runs that ``batches`` batches of documents are added to."""
    spark = docs.sparkSession
    path = shared_dir(spark)
    lines = line_hashes(docs, min_chars, batches)
    lines.write.partitionBy("batch").parquet(path)  # a batch reads its own files alone
    lines = spark.read.schema(lines.schema).parquet(path)
    runs = LineRuns(spark)
    for k in range(batches):
        runs.add(lines.filter(F.col("batch") == k).drop("batch"))
    repeated = materialize(runs.counts().filter(F.col("n_docs") >= min_docs))
    runs.close()
    remove(spark, path)
    return repeated


_KEY = ["doc_id", "t1", "t2"]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit("line"), "text")})


def _explode_keyed(min_chars: int):
    schema = pa.schema([(c, pa.int64()) for c in ("h1", "h2", "doc_id", "t1", "t2")])

    def run(batches):
        for rb in batches:
            text = binary(rb.column(1))
            for a, b in slices(text):
                own = [list({d for _, d in _keys(t or b"", min_chars) if d}) for t in text.slice(a, b - a).to_pylist()]
                h = np.frombuffer(b"".join(d for ds in own for d in ds), np.int64).reshape(-1, 2)
                at = pa.array(np.repeat(np.arange(a, b), list(map(len, own))))
                yield batch(schema, [h[:, 0], h[:, 1], *(rb.column(c).take(at) for c in (0, 2, 3))])

    return run


def _listed(docs: DataFrame, repeated: DataFrame, min_chars: int) -> DataFrame:
    """``docs`` with ``digests``: the hashes of the lines that the row loses, or null."""
    rows = _keyed(docs)
    lines = rows.select("doc_id", "text", "t1", "t2").mapInArrow(_explode_keyed(min_chars), "h1 long, h2 long, doc_id long, t1 long, t2 long")
    total = repeated.agg(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0]
    hit = skew_join(lines, repeated, ["h1", "h2"], "n_docs", total).filter(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
    # rows that repeat a doc_id and text lose the same lines: one list of them, made map-side first
    gone = hit.groupBy(*_KEY).agg(F.collect_set(F.struct("h1", "h2")).alias("digests"), F.count(F.lit(1)).alias("c")).withColumn("c", F.col("c") / F.size("digests"))
    gone = materialize(gone)
    same = lambda g: rows["doc_id"].eqNullSafe(g["doc_id"]) & (rows["t1"] == g["t1"]) & (rows["t2"] == g["t2"])
    # fewer than 4096 lists of rows that repeat so often, and as many bytes as 4096 average texts: a bound for their broadcast
    most = gone.agg(F.coalesce(F.sum("c"), F.lit(0.0))).first()[0] / 4096
    often, rest = gone.filter(F.col("c") > max(most, 1.0)), gone.filter(F.col("c") <= max(most, 1.0))
    out = rows.join(F.broadcast(often.select(*_KEY, F.col("digests").alias("d1"))).alias("o"), same(often), "left").select(*[rows[c] for c in rows.columns], "d1")
    rest = rest.select(*[F.col(c).alias(f"r_{c}") for c in _KEY], F.col("digests").alias("d2")).hint("shuffle_hash")
    # rows that lose nothing or are listed above spread by their hash instead of meeting under one id
    out = out.join(rest, F.col("doc_id").eqNullSafe(F.col("r_doc_id")) & (F.col("t1") == F.col("r_t1")) & (F.col("t2") == F.col("r_t2")), "left")
    return out.select(*docs.columns, F.coalesce("d1", "d2").alias("digests"))


def _apply(docs: DataFrame, min_chars: int, min_docs: int, batches: int, schema: pa.Schema, ddl: str, finish) -> DataFrame:
    repeated = repeated_lines(docs, min_chars, min_docs, batches)
    if repeated.limit(MAX_REPEATED + 1).count() > MAX_REPEATED:
        return _listed(docs, repeated, min_chars).mapInArrow(_drop_listed(min_chars, schema, finish), ddl)
    known = repeated.select("h1", "h2", F.coalesce("last_doc", F.lit(0)).alias("last"), F.col("last_doc").isNotNull().alias("known")).toPandas()
    known = docs.sparkSession.sparkContext.broadcast(Repeated(*(known[c].to_numpy(t) for c, t in (("h1", np.int64), ("h2", np.int64), ("last", np.int64), ("known", bool)))))
    return docs.mapInArrow(_drop_known(known, min_chars, schema, finish), ddl)


_REPORT = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string())])
_DOCS = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])


def _report(rb, kept):
    return [rb.column(0), [n for _, n, _ in kept], [d for _, _, d in kept], [hashlib.sha256(t).hexdigest() for t, _, _ in kept]]


def _clean(rb, kept):
    text = [t.decode("utf-8", "replace") if d or not null else None for (t, _, d), null in zip(kept, rb.column(1).is_null().to_pylist())]
    return [rb.column(0), text, rb.column(2), rb.column(3), [None if t is None else len(t) for t in text]]


def report_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped and the SHA-256 of the lines that stay."""
    return _apply(only(docs, "doc_id", "text"), min_chars, min_docs, batches, _REPORT, "doc_id long, n_lines long, n_dropped long, kept_sha256 string", _report)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """``docs`` (doc_id, text, lang, source, n_chars) without the lines that ``report_lines`` counts as dropped."""
    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    return _apply(only(docs, *cols), min_chars, min_docs, batches, _DOCS, "doc_id long, text string, lang string, source string, n_chars long", _clean)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The white space of a key's ends, as DuckDB's trim() takes it.
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP6_SQL = f"""
WITH ids AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM ids),
k AS (SELECT r, doc_id, n, line, {_LOWER.format(f"trim(line, {_SPACE})")} AS key FROM l),
c AS (SELECT key, max(doc_id) AS last_doc FROM (SELECT DISTINCT r, doc_id, key FROM k WHERE length(key) >= 20) GROUP BY key HAVING count(*) >= 3),
j AS (SELECT k.*, (c.key IS NOT NULL AND k.doc_id IS DISTINCT FROM c.last_doc) AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY r, doc_id
"""
