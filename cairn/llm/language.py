"""Language identification with bit-sliced Bloom filters of n-grams.

One Bloom filter a language, stored crosswise: position i of the table holds a
bitmask with the bit of each language whose filter has i set (beyond 64 languages,
in several words, 16 MB for each 64 languages). The masks at an
n-gram's positions, and-ed, name all languages that contain it with one lookup.
Each language's hits in a text are its bits' popcount, corrected by its filter's
measured false-positive rate; the largest corrected count decides, of equal ones the
language that comes first in the alphabet.

A language contains an n-gram (4 bytes of lower-cased UTF-8, runs of other
characters than letters as one blank) if its part of the language's n-grams is at
least ``LEAST`` and at least ``SHARE`` of the largest such part in any language. The
filters are fitted on a bounded sample, about ``SAMPLE`` documents of each language
by a hash of the doc_id; no more than ``1 / LEAST`` n-grams a language can pass, so
what reaches the driver is bounded: 250,000 rows of 12 bytes for each language. Prediction reads each text once, in numpy.

Null text or one without a letter: ``und`` with score 0. A text too odd for any
filter: the language with most training documents, score 0. Null lang: not
learned from. Null doc_id: held out of training. Repeated rows are predicted each, and
learned from as often as they are drawn. An empty table gives an empty result; without
a learned language all are ``und``. Extra columns of any name are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ._common import batch, binary, only, slices

SAMPLE, LEAST, SHARE, BITS, PROBES = 2000, 4e-6, 0.2, 21, 3
_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]

_KEEP = np.full(256, 32, np.uint8)
for _b in range(256):
    if 97 <= _b <= 122 or _b >= 128:
        _KEEP[_b] = _b
    elif 65 <= _b <= 90:
        _KEEP[_b] = _b + 32


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: 4-byte n-grams, whether each counts, and where each text's begin (and the end)."""
    data = _KEEP[np.frombuffer(b" " + b"  ".join(texts) + b"    ", np.uint8)]
    upper = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)) + 1
    data[upper] += 32  # capital letters of Latin-1
    n = len(data) - 3
    g = data[:n].astype(np.uint64)
    for j in (1, 2, 3):
        g |= data[j : n + j].astype(np.uint64) << np.uint64(8 * j)
    blank = data == 32
    two = blank[:-1] & blank[1:]
    ok = ~(two[:n] | two[1 : n + 1] | two[2 : n + 2])
    off = np.concatenate([[0], np.cumsum([len(t) + 2 for t in texts])])
    return g, ok, np.minimum(off, n)


def _probes(g: np.ndarray) -> list[np.ndarray]:
    return [(((g * c) ^ (g >> np.uint64(13))) * _C[3] >> np.uint64(64 - BITS)).astype(np.int64) for c in _C[:PROBES]]


class Filters:
    def __init__(self, langs: list[str], members: list[np.ndarray], default: str | None):
        self.langs, self.default = langs, default
        kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if np.dtype(k).itemsize * 8 >= min(64, len(langs)))
        self.width = np.dtype(kind).itemsize * 8
        self.tables = [np.zeros(1 << BITS, kind) for _ in range(max(1, -(-len(langs) // self.width)))]
        for l, g in enumerate(members):
            for p in _probes(g):
                self.tables[l // self.width][p] |= kind(1 << l % self.width)
        fill = [float(self._bit(self.tables, l).mean()) for l in range(len(langs))]
        self.wrong = np.array([f**PROBES for f in fill])

    def _bit(self, words: list[np.ndarray], l: int) -> np.ndarray:
        w = words[l // self.width]
        return (w >> w.dtype.type(l % self.width)) & w.dtype.type(1)

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], list[float]]:
        g, ok, off = grams([t or b"" for t in texts])
        at = np.flatnonzero(ok)
        g = g[at]
        first = np.searchsorted(at, off)
        at_probes = _probes(g)
        masks = [np.bitwise_and.reduce([t[p] for p in at_probes]) for t in self.tables]
        n = np.diff(first)
        hits = np.zeros((len(texts), max(1, len(self.langs))))
        for l in range(len(self.langs)):
            c = np.concatenate([[0], np.cumsum(self._bit(masks, l), dtype=np.int64)])
            count = c[first[1:]] - c[first[:-1]]
            hits[:, l] = np.maximum(0, (count - n * self.wrong[l]) / (1 - self.wrong[l]))
        best = hits.argmax(1)
        top = hits[np.arange(len(texts)), best]
        second = np.partition(hits, -2, axis=1)[:, -2] if hits.shape[1] > 1 else np.zeros(len(texts))
        score = np.where(top > 0, top / np.maximum(top + second, 1e-9), 0.0)
        lang = []
        for t, b, s in zip(texts, best.tolist(), top.tolist()):
            if not self.langs or not t or not _has_letter(t):
                lang.append("und")
            else:
                lang.append(self.langs[b] if s > 0 else self.default)
        return lang, np.where([x == "und" for x in lang], 0.0, np.clip(score, 0, 1)).tolist()


_ASCII_LETTERS = bytes([*range(65, 91), *range(97, 123)])


def _has_letter(t: bytes) -> bool:
    if t.isascii():
        return len(t.translate(None, _ASCII_LETTERS)) < len(t)
    return any(c.isalpha() for c in t.decode("utf-8", "replace"))


_COUNTS = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("c", pa.int64())])


def _count(batches):
    for rb in batches:
        text = binary(rb.column(0))
        for a, b in slices(text):
            g, ok, off = grams([t or b"" for t in text.slice(a, b - a).to_pylist()])
            langs = rb.column(1).slice(a, b - a).to_pylist()
            for lang in dict.fromkeys(langs):
                own = np.concatenate([g[x:y][ok[x:y]] for x, y, l in zip(off, off[1:], langs) if l == lang])
                u, c = np.unique(own, return_counts=True)
                yield batch(_COUNTS, [[lang] * len(u), u.view(np.int64), c])


def held_out(doc_id: str = "doc_id", parts: int = 3, rest: int = 1) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(parts)) == rest, F.lit(True))


def fit(train: DataFrame, sample: int = SAMPLE) -> Filters:
    """Filters from ``train`` (doc_id, text, lang); about ``sample`` documents a language."""
    sizes = {r.lang: r.n for r in train.filter("lang is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").collect()}
    if not sizes:
        return Filters([], [], None)
    spark = train.sparkSession
    rates = spark.createDataFrame([(l, min(1.0, sample / n)) for l, n in sizes.items()], "lang string, rate double")
    drawn = train.join(F.broadcast(rates), "lang").filter(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1_000_000)) < F.col("rate") * 1_000_000)
    counts = drawn.select("text", "lang").mapInArrow(_count, "lang string, gram long, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c"))
    total = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("c").alias("n")).collect()}
    if not total:
        return Filters([], [], None)
    langs = sorted(total)
    all_of = spark.createDataFrame([(l, i, float(total[l])) for i, l in enumerate(langs)], "lang string, l int, all_of double")
    parts = counts.join(F.broadcast(all_of), "lang").withColumn("f", F.col("c") / F.col("all_of")).filter(F.col("f") >= LEAST)  # 1 / LEAST rows a language at most
    parts = parts.withColumn("top", F.max("f").over(Window.partitionBy("gram"))).filter(F.col("f") >= SHARE * F.col("top")).select("l", "gram").toPandas()
    parts = parts.sort_values(["l", "gram"])
    at = np.searchsorted(parts["l"].to_numpy(), np.arange(len(langs) + 1))
    grams_of = parts["gram"].to_numpy(np.int64).view(np.uint64)
    return Filters(langs, [grams_of[x:y] for x, y in zip(at, at[1:])], next(iter(sizes)))


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def _predict(filters):
    def run(batches):
        f = filters.value
        for rb in batches:
            text = binary(rb.column(2))
            for a, b in slices(text):
                yield batch(_OUT, [rb.column(0).slice(a, b - a), rb.column(1).slice(a, b - a), *f.predict(text.slice(a, b - a).to_pylist())])

    return run


def identify_languages(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per document: doc_id, held_out (crc32 of the doc_id modulo 3 is 1: not learned from), lang_pred, score."""
    rows = only(docs, "doc_id", "text", "lang").withColumn("held_out", held_out())
    filters = docs.sparkSession.sparkContext.broadcast(fit(rows.filter("not held_out"), sample))
    return rows.select("doc_id", "held_out", "text").mapInArrow(_predict(filters), "doc_id long, held_out boolean, lang_pred string, score double")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
