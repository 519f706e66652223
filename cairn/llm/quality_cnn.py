"""Quality classifier: a byte-level convolutional network in numpy.

A text is cut into overlapping chunks of ``CHUNK`` bytes that cover all of it. A
learned embedding of each byte goes through learned filters of ``WIDTH`` bytes at
every ``STRIDE``-th place, a rectifier and a maximum over the chunk; the mean and the
maximum of the chunks' features feed a small hidden layer that gives one
probability. Because inputs are bytes, embedding and filters are folded into one
table per filter tap, so a convolution is ``WIDTH`` table lookups.

The network is fitted on the driver, on about ``SAMPLE`` labelled documents of at most
``LONGEST`` bytes each, drawn by a hash of the doc_id, half of them of each label where
there are so many: a documented bound in rows and bytes (some 200 MB at most). Scoring reads each text once, whole, in Arrow batches, without
a shuffle.

Null or empty text: one chunk of padding, scored like any other. Null labels are
not learned from; with one label only or none, the score is the part of ones among
the labels, or 0.5. Null doc_id: held out. Repeated rows and empty tables need
nothing special.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ._common import batch, binary, only, slices
from .language import held_out

CHUNK, STEP, WIDTH, STRIDE, FILTERS, DIM, HIDDEN = 512, 384, 8, 2, 16, 8, 8
#: Bytes of a document that is learned from at most; longer ones are scored whole, but not learned from.
LONGEST = 1 << 16
SAMPLE, EPOCHS, RATE, MINIBATCH, THRESHOLD, SEED = 3000, 6, 0.01, 16, 0.3, 20
#: Steps of training at least, where there are few labels.
LEAST_STEPS = 600
#: Chunks convolved at once.
BLOCK = 64
_PLACES = np.arange(0, CHUNK - WIDTH + 1, STRIDE)


def chunks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A row of ``CHUNK`` bytes for each chunk, zeros after the text's end, and where each text's rows begin (and the end)."""
    count = [max(1, -(-max(0, len(t) - (CHUNK - STEP)) // STEP)) for t in texts]
    first = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros((first[-1], CHUNK), np.uint8)
    for t, a, n in zip(texts, first.tolist(), count):
        data = np.zeros((n - 1) * STEP + CHUNK, np.uint8)
        data[: len(t)] = np.frombuffer(t, np.uint8)
        out[a : a + n] = np.lib.stride_tricks.sliding_window_view(data, CHUNK)[::STEP]
    return out, first


class Network:
    def __init__(self, seed: int = SEED, prior: float | None = None):
        r = np.random.default_rng(seed)
        self.prior = prior
        self.w = {
            "embed": r.normal(0, 0.5, (256, DIM)),
            "filter": r.normal(0, 1 / np.sqrt(WIDTH * DIM), (WIDTH, DIM, FILTERS)),
            "bias": np.zeros(FILTERS),
            "h": r.normal(0, 1 / np.sqrt(2 * FILTERS), (2 * FILTERS, HIDDEN)),
            "hb": np.zeros(HIDDEN),
            "o": r.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN),
            "ob": np.zeros(1),
        }

    def table(self) -> np.ndarray:
        return np.einsum("bd,tdf->tbf", self.w["embed"], self.w["filter"]).astype(np.float32)

    def features(self, rows: np.ndarray, table: np.ndarray, where: bool = False):
        """Each chunk's largest activation by filter, and the places of these if ``where``."""
        out = np.empty((len(rows), FILTERS), np.float32)
        at = np.empty((len(rows), FILTERS), np.int64) if where else None
        for a in range(0, len(rows), BLOCK):
            part = rows[a : a + BLOCK]
            acc = table[0][part[:, _PLACES]]
            for t in range(1, WIDTH):
                acc += table[t][part[:, _PLACES + t]]
            if where:
                at[a : a + BLOCK] = acc.argmax(1)
            out[a : a + BLOCK] = acc.max(1)
        out += self.w["bias"].astype(np.float32)
        return (np.maximum(out, 0), at)

    def forward(self, z: np.ndarray, first: np.ndarray):
        n = np.diff(first)[:, None]
        mean, top = np.add.reduceat(z, first[:-1]) / n, np.maximum.reduceat(z, first[:-1])
        x = np.concatenate([mean, top], axis=1).astype(np.float64)
        h = np.tanh(x @ self.w["h"] + self.w["hb"])
        return x, h, 1 / (1 + np.exp(-np.clip(h @ self.w["o"] + self.w["ob"], -30, 30)))

    def score(self, texts: list[bytes], table: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(texts), self.prior)
        if not texts:
            return np.zeros(0)
        rows, first = chunks(texts)
        return self.forward(self.features(rows, table)[0], first)[2]

    def gradients(self, texts: list[bytes], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        rows, first = chunks(texts)
        z, at = self.features(rows, self.table(), True)
        x, h, p = self.forward(z, first)
        g = {k: np.zeros_like(v) for k, v in self.w.items()}
        d = (p - y) * weight / len(texts)
        g["o"], g["ob"] = h.T @ d, d.sum(keepdims=True)
        dh = np.outer(d, self.w["o"]) * (1 - h**2)
        g["h"], g["hb"] = x.T @ dh, dh.sum(0)
        dx = dh @ self.w["h"].T
        n = np.diff(first)
        text = np.repeat(np.arange(len(texts)), n)
        dz = dx[text, :FILTERS] / n[text][:, None]
        is_top = z == x[text, FILTERS:]
        dz += dx[text, FILTERS:] * is_top / np.maximum(1, np.add.reduceat(is_top, first[:-1])[text])
        dz *= z > 0
        g["bias"] = dz.sum(0)
        used = rows[np.arange(len(rows))[:, None, None], _PLACES[at][:, :, None] + np.arange(WIDTH)]  # chunk, filter, tap
        e = self.w["embed"][used]
        g["filter"] = np.einsum("cf,cftd->tdf", dz, e)
        np.add.at(g["embed"], used, np.einsum("cf,tdf->cftd", dz, self.w["filter"]))
        return g

    def fit(self, texts: list[bytes], labels: np.ndarray, seed: int = SEED) -> Network:
        """Adam on the cross-entropy, both labels weighing the same."""
        r = np.random.default_rng(seed)
        ones = labels.mean()
        weight = np.where(labels > 0, 0.5 / ones, 0.5 / (1 - ones))
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(x) for k, x in self.w.items()}
        each = -(-len(texts) // MINIBATCH)
        epochs = max(EPOCHS, -(-LEAST_STEPS // each))
        step, steps = 0, epochs * each
        for _ in range(epochs):
            order = r.permutation(len(texts))
            for a in range(0, len(order), MINIBATCH):
                b = order[a : a + MINIBATCH]
                g = self.gradients([texts[i] for i in b], labels[b], weight[b])
                step += 1
                rate = RATE * (1 - 0.9 * step / steps)
                for k in self.w:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                    self.w[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return self


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network:
    """A network fitted on about ``sample`` documents of ``docs`` (doc_id, text) that ``labels`` (doc_id, quality) marks and that aren't held out."""
    known = only(labels, "doc_id", "quality").filter("quality is not null").filter(~held_out("doc_id", 5, 0))
    sizes = {r.quality: r.n for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return Network(prior=float(next(iter(sizes), 0.5)))
    rate = F.lit(0.0)
    for q, n in sizes.items():
        rate = F.when(F.col("quality") == q, min(1.0, sample / 2 / n)).otherwise(rate)
    drawn = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1_000_000)) < rate * 1_000_000)  # about ``sample`` rows
    rows = only(docs, "doc_id", "text").filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= LONGEST).join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "quality").orderBy("doc_id", "quality").collect()
    y = np.array([r.quality > 0 for r in rows], float)
    if len(set(y.tolist())) < 2:
        return Network(prior=float(y.mean()) if len(y) else 0.5)
    return Network().fit([(r.text or "").encode() for r in rows], y)


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def _score(network):
    def run(batches):
        net = network.value
        table = net.table()
        for rb in batches:
            text = binary(rb.column(2))
            for a, b in slices(text):
                p = net.score([t or b"" for t in text.slice(a, b - a).to_pylist()], table)
                yield batch(_OUT, [rb.column(0).slice(a, b - a), rb.column(1).slice(a, b - a), p, (p >= THRESHOLD).astype(np.int32)])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per document: doc_id, held_out (crc32 of the doc_id modulo 5 is 0: not learned from), score, predicted."""
    network = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))
    rows = only(docs, "doc_id", "text").select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "text")
    return rows.mapInArrow(_score(network), "doc_id long, held_out boolean, score double, predicted int")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
