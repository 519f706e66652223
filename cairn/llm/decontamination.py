"""Benchmark decontamination: size-partitioned MinHash containment search.

A document of 20,000 words and a test item of 30 have a Jaccard similarity near
zero, so sketches of documents cannot find it. The sketches here are the items':
items are partitioned by their number of distinct word shingles, sizes of 2**c to
2**(c+1)-1 in one partition, and each partition has its own sketch length, the
``(1 - threshold) * 2**(c+1) + MARGIN`` first hashes of an item (its bottom
MinHash sketch) in an order that puts shingles of few items before those of many, and
then goes by hash: a template that all items share is in no sketch, unless an item
is little else. A document that contains at least ``threshold`` of an item's
shingles misses at most ``size - ceil(threshold * size)`` of them, so it holds
all but that many of the sketch: this bound loses nothing. Candidates are
verified by exact containment of the whole shingle sets. Items with equal sets are
one entry.

The index of items is broadcast in blocks of at most ``BLOCK`` shingle hashes (and one
item), one after the other: a block's broadcast is taken back when its scan has been
written, so however large the benchmark, one block is in memory. Documents are scanned
once for each block (one block is 4 million words of items) and never shuffled.

Items with fewer than ``k`` words are searched by shingles of their own length.
Items or documents without words or text match nothing. Repeated rows match each
on its own; null ids stay null. Empty tables give an empty result. Extra columns of any
name are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ._common import batch, binary, materialize, mix, only, raw, slices, word_hashes, _SHIFT

K, THRESHOLD, MARGIN, BLOCK = 5, Fraction(4, 5), 4, 4_000_000


def _grams(words: np.ndarray, k: int) -> np.ndarray:
    m = len(words) - k + 1
    if m < 1:
        return np.zeros(0, np.uint64)
    h = words[:m] * _SHIFT[0]
    for j in range(1, k):
        h += words[j : m + j] * _SHIFT[j]
    return mix(h)


class Index:
    """Items' shingle sets and, by shingle length, their sketches as sorted (hash, item) arrays behind a bitmap."""

    def __init__(self, items: list[tuple[int | None, str | None]], k: int, threshold: Fraction):
        self.ids: list[list[int | None]] = []
        self.sets, self.least, self.length = [], [], []
        known: dict[tuple[int, bytes], int] = {}
        by_length: dict[int, list[int]] = {}
        for item_id, text in items:
            data = np.frombuffer((text or "").encode(), np.uint8)
            words, _ = word_hashes(data, np.array([0, len(data)]))
            if not len(words):
                continue
            n = min(k, len(words))
            own = np.unique(_grams(words, n))
            i = known.setdefault((n, own.tobytes()), len(self.ids))
            if i < len(self.ids):
                self.ids[i].append(item_id)
                continue
            by_length.setdefault(n, []).append(i)
            self.ids.append([item_id])
            self.sets.append(own)
            self.length.append(n)
        self.needed = [ceil(threshold * len(s)) for s in self.sets]
        self.least = [0] * len(self.sets)
        self.parts = {}
        for n, members in by_length.items():
            all_hashes, count = np.unique(np.concatenate([self.sets[i] for i in members]), return_counts=True)
            h, item = [], []
            for i in members:
                own = self.sets[i]
                size = len(own)
                upper = 1 << size.bit_length()  # the size partition's end
                spread = np.log2(count[np.searchsorted(all_hashes, own)]).astype(np.int64)
                sketch = own[np.lexsort((own, spread))[: min(size, floor((1 - threshold) * upper) + MARGIN)]]
                self.least[i] = max(1, len(sketch) - (size - self.needed[i]))
                h.append(sketch)
                item.append(np.full(len(sketch), i))
            h, item = np.concatenate(h), np.concatenate(item)
            order = np.argsort(h, kind="stable")
            bits = max(16, min(26, int(64 * len(h)).bit_length()))
            seen = np.zeros(1 << bits, bool)
            seen[(h >> np.uint64(64 - bits)).astype(np.int64)] = True
            self.parts[n] = (h[order], item[order], seen, np.uint64(64 - bits))

    def matches(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(document's place, entry's place, shared shingles) of each match in documents laid end to end."""
        for n, (keys, item, seen, shift) in self.parts.items():
            h = _grams(words, n)
            at = np.flatnonzero(seen[(h >> shift).astype(np.int64)])
            if not len(at):
                continue
            lo = np.searchsorted(keys, h[at], "left")
            hi = np.searchsorted(keys, h[at], "right")
            hit = hi > lo
            at, lo, hi = at[hit], lo[hit], hi[hit]
            doc = np.searchsorted(first, at, "right") - 1
            inside = at + n <= first[doc + 1]
            at, lo, hi, doc = at[inside], lo[inside], hi[inside], doc[inside]
            for d in np.unique(doc).tolist():
                mine = doc == d
                # each sketch hash counts once for a document, however often its shingle is repeated
                slots = np.unique(np.concatenate([np.arange(x, y) for x, y in zip(lo[mine].tolist(), hi[mine].tolist())]))
                found, count = np.unique(item[slots], return_counts=True)
                own = None
                for i, c in zip(found.tolist(), count.tolist()):
                    if c >= self.least[i]:
                        if own is None:
                            own = np.unique(h[first[d] : max(first[d], first[d + 1] - n + 1)])
                        shared = int(np.isin(self.sets[i], own, assume_unique=True).sum())
                        if shared >= self.needed[i]:
                            yield d, i, shared


def _blocks(benchmark: DataFrame) -> Iterator[list]:
    rows, words = [], 0
    for r in only(benchmark, "item_id", "text").toLocalIterator():  # one block at a time in the driver
        rows.append((r[0], r[1]))
        words += len((r[1] or "").split()) + 1
        if words >= BLOCK:
            yield rows
            rows, words = [], 0
    if rows:
        yield rows


_OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_item_shingles", pa.int64()), ("n_shared", pa.int64())])


def _search(index):
    def run(batches):
        ix = index.value
        for rb in batches:
            ids, text = rb.column(0), binary(rb.column(1))
            for a, b in slices(text):
                data, off = raw(text.slice(a, b - a))
                found = [(d, item, len(ix.sets[i]), s) for d, i, s in ix.matches(*word_hashes(data, off)) for item in ix.ids[i]]
                own = ids.slice(a, b - a)
                yield batch(_OUT, [own.take(pa.array([x[0] for x in found], pa.int64())), *([x[c] for x in found] for c in (1, 2, 3))])

    return run


def _keep(index):
    def run(batches):
        ix = index.value
        for rb in batches:
            text = binary(rb.column(1))
            for a, b in slices(text):
                data, off = raw(text.slice(a, b - a))
                good = np.ones(b - a, bool)
                good[[d for d, _, _ in ix.matches(*word_hashes(data, off))]] = False
                yield rb.slice(a, b - a).filter(pa.array(good))

    return run


def _scan_blocks(benchmark: DataFrame, k: int, threshold: Fraction, scan) -> DataFrame | None:
    """``scan(broadcast index)`` of each block: lazily where there is one block, else each written, and its broadcast taken back, before the next."""
    spark, out, last = benchmark.sparkSession, [], None
    for rows in _blocks(benchmark):
        if last is not None:
            out.append(materialize(scan(last)))
            last.destroy()
        last = spark.sparkContext.broadcast(Index(rows, k, threshold))
    if last is None:
        return None
    df = scan(last)
    for part in out:
        df = df.unionByName(part)
    return df


def find_items(docs: DataFrame, benchmark: DataFrame, k: int = K, threshold: Fraction = THRESHOLD) -> DataFrame:
    """doc_id, item_id, n_item_shingles, n_shared, containment of each item that a document holds to ``threshold`` or more."""
    base, ddl = only(docs, "doc_id", "text"), "doc_id long, item_id long, n_item_shingles long, n_shared long"
    out = _scan_blocks(benchmark, k, threshold, lambda index: base.mapInArrow(_search(index), ddl))
    if out is None:
        out = docs.sparkSession.createDataFrame([], ddl)
    return out.withColumn("containment", F.col("n_shared") / F.col("n_item_shingles"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, k: int = K, threshold: Fraction = THRESHOLD) -> DataFrame:
    """``docs`` (doc_id, text, lang, source, n_chars) without those in which ``find_items`` finds an item."""
    spark, out, last = docs.sparkSession, only(docs, "doc_id", "text", "lang", "source", "n_chars"), None
    for rows in _blocks(benchmark):
        if last is not None:  # the rows that the blocks so far leave are written before the next
            out = materialize(out)
            last.destroy()
        last = spark.sparkContext.broadcast(Index(rows, k, threshold))
        out = out.mapInArrow(_keep(last), out.schema)
    return out


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

OP1_SQL = f"""
WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
ik AS (SELECT item_id, w, least(5, len(w)) AS k FROM i WHERE len(w) > 0),
ig AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS g FROM (SELECT item_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS p FROM ik)),
n AS (SELECT item_id, count(*) AS n_item_shingles FROM ig GROUP BY item_id),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dg AS (SELECT DISTINCT doc_id, k, array_to_string(w[p:p + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS p FROM d, (SELECT DISTINCT k FROM ik) WHERE len(w) >= k)),
h AS (SELECT doc_id, item_id, count(*) AS n_shared FROM dg JOIN ig USING (k, g) GROUP BY ALL)
SELECT doc_id, item_id, n_item_shingles, n_shared, n_shared / n_item_shingles AS containment FROM h JOIN n USING (item_id) WHERE 5 * n_shared >= 4 * n_item_shingles
"""
