"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Documents with equal texts form a group and stay together, unless the group is
larger than a whole shard in bytes, tokens or rows: that one is split into chunks of about
1/SPLIT of a shard (a group with a third of all rows cannot lie in one shard, even if it
is of empty texts). Groups of more than 1/OWN of a shard, and chunks, are items of
their own; all others are hashed into a fixed number of bundles. The items' three-part
weights are summed with map-side combining. Only those sums, at most some
``n_shards * (BUNDLES * LANES + 3 * (BUNDLES + OWN))`` rows whatever the corpus, reach the
driver, which places the items by falling weight, each into the shard where the dot
product of its weight with the residual capacity is highest; then single items move or
change places between the fullest and emptiest shards while that evens them out. The
placement goes back as a broadcast of that same bounded size. Slots are a row number
inside each lane of an item plus that lane's offset in its shard, and an item has lanes
by its weight, so no task sorts a large part of a shard.

Null text: no bytes, no tokens; null texts form one group. Null or repeated
doc_id: each row is placed and gets a slot of its own; ties in a lane go by where the
row was read. Empty table: empty result. Extra columns of any name are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ._common import batch, binary, materialize, only, slices

#: Bundles a shard is filled with on average.
BUNDLES = 256
#: A group above this part of a shard's bytes, tokens or rows is an item of its own.
OWN = 64
#: A group that no shard holds is split into chunks of this part of a shard.
SPLIT = 8
#: Each bundle is numbered in this many lanes, so that no sort holds a whole bundle.
LANES = 4
#: How much bytes, tokens and rows weigh when items are moved, and moves at most for each shard.
CARE, MOVES = (1.0, 0.3, 0.3), 50
#: Bytes counted for a row besides its text.
ROW_BYTES = 16

_OUT = pa.schema([("doc_id", pa.int64()), ("size", pa.int64()), ("text_crc32", pa.int64()), ("n_tokens", pa.int64()), ("g1", pa.int64()), ("g2", pa.int64()), ("salt", pa.int64())])


def _weigh(batches):
    part, seen = TaskContext.get().partitionId(), 0
    for rb in batches:
        ids, text = rb.column(0), binary(rb.column(1))
        for a, b in slices(text):
            size, crc, tok, g = [], [], [], []
            for t in text.slice(a, b - a).to_pylist():
                data = t or b""
                size.append(len(data) + ROW_BYTES)
                crc.append(zlib.crc32(data))
                tok.append(len(data.split()))
                g.append(xxhash.xxh3_128_intdigest(data, seed=t is None))
            hi = np.array([x >> 64 for x in g], np.uint64).view(np.int64)
            lo = np.array([x & (1 << 64) - 1 for x in g], np.uint64).view(np.int64)
            salt = np.arange(seen, seen + b - a, dtype=np.int64) * 1_000_003 + part
            seen += b - a
            yield batch(_OUT, [ids.slice(a, b - a), size, crc, tok, hi, lo, salt])


def pack(weights: np.ndarray, n_shards: int) -> np.ndarray:
    """Shard of each row of ``weights`` (items x dimensions): heaviest first, each where the dot product with the residual capacity is highest."""
    total = weights.sum(0)
    unit = weights / np.where(total > 0, total / n_shards, 1)
    left = np.ones((n_shards, weights.shape[1]))
    shard = np.zeros(len(weights), np.int64)
    for i in np.lexsort((np.arange(len(unit)), -unit.sum(1))):
        s = int(np.argmax(left @ unit[i]))
        shard[i] = s
        left[s] -= unit[i]
    return shard


def even_out(weights: np.ndarray, shard: np.ndarray, n_shards: int) -> np.ndarray:
    """``shard`` after moves and exchanges of single items between two shards, each the one that lessens their squared deviations most."""
    total = weights.sum(0)
    unit = weights / np.where(total > 0, total / n_shards, 1) * np.sqrt(CARE)
    load = np.zeros((n_shards, unit.shape[1]))
    np.add.at(load, shard, unit)
    load -= unit.sum(0) / n_shards
    shard, idle = shard.copy(), 0
    for _ in range(n_shards * MOVES):
        order = np.argsort(-load[:, 0], kind="stable")
        # the fullest shard with the emptiest, or, where that gains nothing, the next pairs inwards
        if idle >= n_shards // 2:
            break
        a, b = order[idle], order[n_shards - 1 - idle]
        mine, other = np.flatnonzero(shard == a), np.flatnonzero(shard == b)
        give = np.concatenate([unit[mine], np.zeros((1, unit.shape[1]))])[:, None, :] - np.concatenate([unit[other], np.zeros((1, unit.shape[1]))])[None, :, :]
        after = np.square(load[a] - give).sum(2) + np.square(load[b] + give).sum(2)
        i, j = np.unravel_index(int(np.argmin(after)), after.shape)
        if after[i, j] >= np.square(load[a]).sum() + np.square(load[b]).sum() - 1e-12:
            idle += 1
            continue
        idle = 0
        load[a] -= give[i, j]
        load[b] += give[i, j]
        if i < len(mine):
            shard[mine[i]] = b
        if j < len(other):
            shard[other[j]] = a
    return shard


def assign_shards(docs: DataFrame, n_shards: int = 40, bundles: int = BUNDLES) -> DataFrame:
    """doc_id, size, text_crc32, n_tokens (words), law (``bytes``), shard, slot (gapless from 0 in each shard), grown_shard (null)."""
    rows = materialize(only(docs, "doc_id", "text").mapInArrow(_weigh, "doc_id long, size long, text_crc32 long, n_tokens long, g1 long, g2 long, salt long"))
    n_bundles = n_shards * bundles
    weights = {"bytes": F.sum("size"), "tokens": F.sum("n_tokens"), "n_rows": F.count(F.lit(1))}
    groups = rows.groupBy("g1", "g2").agg(*[w.alias(c) for c, w in weights.items()])
    total = rows.agg(*[w.alias(c) for c, w in weights.items()]).first()
    parts = F.greatest(*[F.col(c) / max(1.0, (total[c] or 0) / n_shards) for c in weights])
    # each weight adds up to its total, so 3 * n_shards * OWN groups at most are above the part: a proven bound for the broadcast
    heavy = groups.filter(parts > 1 / OWN).withColumn("chunks", F.when(parts > 1, F.ceil(parts * SPLIT)).otherwise(1)).select("g1", "g2", "chunks", F.ceil(parts * bundles / F.col("chunks")).alias("lanes"))
    placed = rows.join(F.broadcast(heavy), ["g1", "g2"], "left").withColumn("chunk", F.when(F.col("chunks").isNotNull(), F.pmod(F.xxhash64("salt"), F.col("chunks"))))
    of_its_own = -1 - F.pmod(F.xxhash64("g1", "g2", "chunk"), F.lit(1 << 62))
    placed = placed.withColumn("bundle", F.when(F.col("chunks").isNull(), F.pmod(F.xxhash64("g1", "g2"), F.lit(n_bundles))).otherwise(of_its_own))
    placed = placed.withColumn("lane", F.pmod(F.xxhash64(F.lit("lane"), "salt"), F.coalesce("lanes", F.lit(LANES))))
    sums = placed.groupBy("bundle", "lane").agg(F.sum("size").alias("bytes"), F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_rows")).orderBy("bundle", "lane").collect()  # at most n_bundles * LANES rows and 3 * n_shards * (bundles + OWN)
    number = {b: i for i, b in enumerate(dict.fromkeys(r.bundle for r in sums))}
    weights = np.zeros((len(number), 3))
    for r in sums:
        weights[number[r.bundle]] += (r.bytes, r.tokens, r.n_rows)
    shard, used, plan = even_out(weights, pack(weights, n_shards), n_shards), [0] * n_shards, []
    for r in sums:
        s = int(shard[number[r.bundle]])
        plan.append((r.bundle, r.lane, s, used[s]))
        used[s] += r.n_rows
    plan = docs.sparkSession.createDataFrame(plan, "bundle long, lane long, shard int, start long")
    nth = F.row_number().over(Window.partitionBy("bundle", "lane").orderBy("doc_id", "salt"))
    return placed.join(F.broadcast(plan), ["bundle", "lane"]).select("doc_id", "size", "text_crc32", "n_tokens", F.lit("bytes").alias("law"), "shard", (F.col("start") + nth - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
