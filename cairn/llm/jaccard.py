"""N-gram Jaccard self-join with token-combination prefixes.

Tokens are the distinct 5-word shingles of a document, as 64-bit hashes. Equal
sets form a class; the join runs on one representative a class, and members are
counted back in, so a group of copies costs as much as one document.

For ``J >= t`` a set of ``n`` tokens misses at most ``e = n - ceil(t * n)`` of the
other's. Tokens have a global order; a set's prefix is extended until it covers
``e + 1`` misses. A token of the rare class covers one and is indexed alone. In
the frequent class, tokens fall by hash into ``G`` subclasses and every
pair of tokens within a subclass is indexed (k = 2), so that ``m`` tokens of a
subclass cover ``m - 1``: fewer, so the prefix is longer, but a pair of
tokens is far more selective than one. If two sets are similar, the shorter of
their prefixes keeps at least one indexed token or combination whole in the
other's: no link is lost. ``G`` grows with the size band of the set, and a set
near a band's end is indexed for both bands, so combinations stay linear in
``n``.

The order puts the tokens whose hash is below ``ZONE`` first, among them rare
before frequent, then by hash. Frequencies are counted over that zone of all
documents; a token is frequent if more than ``RARE`` classes hold it, or it is
beyond the zone. The frequent tokens are sent to the tasks as a Bloom filter of
bounded size: a false positive only makes a rare token frequent, for all
documents alike, and keeps the result exact.

Pairs are then cut by how many signatures they share in the prefixes (an exact
bound, see ``_need``), and the rest verified on the whole sets. Sets that need
combinations are near copies of many others: connected ones meet in cells of at
most ``BLOCK`` sets a side, where the shared signatures of all their pairs are
counted in one matrix. Sets connected by pairs to verify meet in cells of about that
size, too, so no large group of near copies lies in one task.

Null or empty text: an empty set, linked with nothing, a component of its own.
Rows that repeat a doc_id are documents of their own with the same id. A null
doc_id takes part, but gives no component its id unless all of them are null. An empty
table gives an empty result; extra columns of any name are ignored.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ._common import batch, binary, doc_shingles, materialize, only, skew_join

K, THRESHOLD = 5, Fraction(9, 10)
#: Classes that hold a token of the rare class at most.
RARE = 16
#: The part of the hash range whose tokens come first, and are counted.
ZONE = 0.25
#: Rows of one list or sets of one side that meet in a task at most.
BLOCK = 1024
#: Bits of the Bloom filter at most (bytes in memory: an eighth).
MAX_BITS = 1 << 29
#: Rows kept once of those that repeat, whose keys are broadcast at most; beyond, they are joined by shuffle.
MAX_IDS = 500_000
#: 64-bit words of the ids, hashes and cells of the sets to verify that are broadcast to the scan at most (32 MB); beyond, the scan is joined by shuffle.
MAX_WORDS = 4_000_000

_NULL_ID = -(2**63)
_ZONE = np.uint64(int(ZONE * 2**64))


def misses(n, t: Fraction):
    """How many of ``n`` tokens a set at ``J >= t`` can lack."""
    return n - -(-t.numerator * n // t.denominator)


def subclasses(band: int) -> int:
    return max(1, (1 << band) // 40)


def bands(n: int, t: Fraction) -> range:
    """The size bands that a set is indexed for: its own, and the next if a set similar to it can lie there."""
    return range(n.bit_length() - 1, (n * t.denominator // t.numerator).bit_length())


# ---------------------------------------------------------------- first pass: sets

_SETS = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("tokens", pa.binary())])


def _sets(k: int, t: Fraction, keep: list[str]):
    """Per document the set's size, its hash, the tokens that a prefix can reach, and the columns ``keep``."""
    schema = pa.schema([*_SETS, *((c, pa.int64()) for c in keep)])

    def run(batches):
        uid = TaskContext.get().partitionId() << 33
        for rb in batches:
            ids, text = rb.column(0), binary(rb.column(1))
            for a, sets in doc_shingles(text, k):
                size, digest, toks = [], [], []
                for s in sets:
                    n = len(s)
                    size.append(n)
                    digest.append(xxhash.xxh3_128_digest(s.tobytes()))
                    upto = 0
                    if misses(n, t) or n * t.denominator // t.numerator > n:  # else only equal sets are similar
                        upto = max(int(np.searchsorted(s, _ZONE)), misses(n, t) + 1 + subclasses(bands(n, t)[-1]))
                    toks.append(s[:upto].tobytes())
                h = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
                own = np.arange(uid, uid + len(sets))
                uid += len(sets)
                yield batch(schema, [own, ids.slice(a, len(sets)), size, h[:, 0], h[:, 1], toks, *(rb.column(i).slice(a, len(sets)) for i in range(2, rb.num_columns))])

    return run


def _zone_tokens(batches):
    for rb in batches:
        for a in range(0, rb.num_rows, 500):
            t = np.frombuffer(b"".join(rb.column(0).slice(a, 500).to_pylist()), np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(t[t < _ZONE].view(np.int64))], names=["token"])


# ---------------------------------------------------------------- Bloom filter of the frequent tokens


def _probe(h: np.ndarray, bits: int) -> list[np.ndarray]:
    mask = np.uint64(bits - 1)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) + step * np.uint64(j) & mask) for j in range(4)]


class Frequent:
    def __init__(self, tokens: np.ndarray, bits: int):
        self.bits, self.set = bits, np.zeros(bits // 8, np.uint8)
        self.add(tokens)

    def add(self, tokens: np.ndarray) -> None:
        for p in _probe(tokens, self.bits):
            np.bitwise_or.at(self.set, (p >> np.uint64(3)).astype(np.int64), (1 << (p & np.uint64(7)).astype(np.uint8)).astype(np.uint8))

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for p in _probe(h, self.bits):
            out &= (self.set[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 != 0
        return out


def _bloom_parts(bits: int):
    def run(batches):
        f = Frequent(np.zeros(0, np.uint64), bits)
        for rb in batches:
            f.add(rb.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        chunk = 1 << 16
        for i in range(0, len(f.set), chunk):
            part = f.set[i : i + chunk]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([part.tobytes()], pa.binary())], names=["at", "bits"])

    return run


def _or_parts(batches):
    at, acc = None, None
    for rb in batches:
        for i, b in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist()):
            if i != at:
                if at is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([acc.tobytes()], pa.binary())], names=["at", "bits"])
                at, acc = i, np.frombuffer(b, np.uint8).copy()
            else:
                acc |= np.frombuffer(b, np.uint8)
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([acc.tobytes()], pa.binary())], names=["at", "bits"])


def frequent_tokens(reps: DataFrame) -> Frequent:
    counts = materialize(reps.select("tokens").mapInArrow(_zone_tokens, "token long").groupBy("token").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > RARE).select("token"))
    n = counts.count()
    bits = min(MAX_BITS, 1 << max(16, (16 * n).bit_length()))
    parts = counts.mapInArrow(_bloom_parts(bits), "at long, bits binary").repartition("at").sortWithinPartitions("at").mapInArrow(_or_parts, "at long, bits binary")
    f = Frequent(np.zeros(0, np.uint64), bits)
    for r in parts.toLocalIterator():  # bits / 8 bytes in all
        f.set[r.at : r.at + len(r.bits)] = np.frombuffer(bytes(r.bits), np.uint8)
    return f


# ---------------------------------------------------------------- signatures


def signatures(tokens: np.ndarray, n: int, frequent: np.ndarray, t: Fraction) -> tuple[np.ndarray, np.ndarray, bool]:
    """The rare tokens and the combination hashes that a set is indexed under, and whether rare tokens alone cover it.

    ``tokens``: the set's stored tokens in hash order, ``frequent``: the class of each.
    """
    need = misses(n, t) + 1
    zone = tokens < _ZONE
    rare = tokens[~frequent & zone]
    if len(rare) >= need:
        return rare[:need], np.zeros(0, np.uint64), True
    rest = np.concatenate([tokens[frequent & zone], tokens[~zone]])
    left, combos = need - len(rare), []
    for band in bands(n, t):
        g = (rest >> np.uint64(7)) % np.uint64(subclasses(band))
        # the m-th token of a subclass covers one more miss, but for the first
        first = np.zeros(len(rest), bool)
        first[np.unique(g, return_index=True)[1]] = True
        upto = int(np.searchsorted(np.cumsum(~first), left)) + 1
        order = np.argsort(g[:upto], kind="stable")
        part, cls = rest[:upto][order], g[:upto][order]
        ends = np.append(np.flatnonzero(cls[1:] != cls[:-1]) + 1, len(part)) if len(part) else []
        a = 0
        for b in ends:
            if b - a > 1:
                i, j = np.triu_indices(b - a, 1)
                x, y = part[a:b][i], part[a:b][j]
                lo, hi = np.minimum(x, y), np.maximum(x, y)
                combos.append((lo * np.uint64(0xC2B2AE3D27D4EB4F) ^ (hi + np.uint64(band)) * np.uint64(0x165667B19E3779F9)) * np.uint64(0x9E3779B97F4A7C15))
            a = b
    return rare, np.concatenate(combos) if combos else np.zeros(0, np.uint64), False


_SIG = pa.schema([("sig", pa.int64()), ("id", pa.int64()), ("n", pa.int32()), ("rare", pa.int32()), ("combo", pa.bool_())])


def _index(frequent, t: Fraction):
    """Rows of the index. ``rare``: the rare tokens indexed, or -1 - that number if they alone cover the set."""

    def run(batches):
        f = frequent.value
        for rb in batches:
            for a in range(0, rb.num_rows, 500):
                ids, ns, toks = (rb.column(c).slice(a, 500).to_pylist() for c in range(3))
                flat = np.frombuffer(b"".join(toks), np.uint64)
                often = f.has(flat)
                sig, cnt, rare, combo, at = [], [], [], [], 0
                for n, raw in zip(ns, toks):
                    m = len(raw) // 8
                    r, c, alone = signatures(flat[at : at + m], n, often[at : at + m], t) if m else (flat[:0], flat[:0], False)
                    at += m
                    sig += [r, c]
                    cnt.append(len(r) + len(c))
                    rare.append(-1 - len(r) if alone else len(r))
                    combo += [np.zeros(len(r), bool), np.ones(len(c), bool)]
                if sum(cnt):
                    yield batch(_SIG, [np.concatenate(sig).view(np.int64), np.repeat(np.array(ids, np.int64), cnt), np.repeat(np.array(ns, np.int32), cnt), np.repeat(np.array(rare, np.int32), cnt), np.concatenate(combo)])

    return run


# ---------------------------------------------------------------- candidate pairs

_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("na", pa.int32()), ("nb", pa.int32()), ("ra", pa.int32()), ("rb", pa.int32()), ("shared", pa.int64())])


def _pairs(t: Fraction):
    """Pairs of similar size within each list of rare tokens of a partition, one side at least covered by them; ``shared``: the tokens counted."""
    num, den = t.numerator, t.denominator

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        tab = pa.Table.from_batches(held)
        key, ids, n, rare = (tab.column(c).to_numpy() for c in ("sig", "id", "n", "rare"))
        del held, tab
        order = np.argsort(key, kind="stable")
        key, ids, n, rare = (c[order] for c in (key, ids, n, rare))
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(start, len(key)))
        reach = np.repeat(start + size, size) - np.arange(len(key)) - 1  # later rows of the same list
        i, d, acc = np.arange(len(key)), 1, []
        while True:
            i = i[reach[i] >= d]
            if not len(i):
                break
            x, y = i, i + d
            d += 1
            ok = (den * np.minimum(n[x], n[y]).astype(np.int64) >= num * np.maximum(n[x], n[y]).astype(np.int64)) & (ids[x] != ids[y]) & ((rare[x] < 0) | (rare[y] < 0))
            x, y = x[ok], y[ok]
            swap = ids[x] > ids[y]
            x, y = np.where(swap, y, x), np.where(swap, x, y)
            acc.append(np.stack([x, y]))
        if not acc:
            return
        x, y = np.concatenate(acc, axis=1)
        order = np.lexsort((ids[y], ids[x]))
        x, y = x[order], y[order]
        new = np.concatenate([[True], (ids[x[1:]] != ids[x[:-1]]) | (ids[y[1:]] != ids[y[:-1]])])[: len(x)]
        at = np.flatnonzero(new)
        count = np.diff(np.append(at, len(x)))
        x, y = x[at], y[at]
        for a in range(0, len(x), 50_000):
            p, q = x[a : a + 50_000], y[a : a + 50_000]
            yield batch(_PAIR, [ids[p], ids[q], n[p], n[q], rare[p], rare[q], count[a : a + 50_000]])

    return run


def _cell_pairs(t: Fraction):
    """Rows sorted by cell and signature: counts each pair's shared signatures in a matrix of the cell's sets, and yields the pairs with enough."""
    num, den = t.numerator, t.denominator

    def pairs(side, ids, n, sig):
        members, at = np.unique(ids, return_index=True)
        place = np.searchsorted(members, ids)
        whole = side[0] == 2
        count = np.zeros((len(members), len(members)), np.int32)
        starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        for a, b in zip(starts.tolist(), np.append(starts[1:], len(sig)).tolist()):
            if b - a > 1:
                m = place[a:b]
                count[np.ix_(m, m)] += 1
        x, y = np.nonzero(np.triu(count, 1))
        nx, ny = n[at][x].astype(np.int64), n[at][y].astype(np.int64)
        overlap = -(-num * (nx + ny) // (num + den))
        need = np.minimum(*((m - -(-num * m // den) + 1) - (m - overlap) for m in (nx, ny)))
        ok = (count[x, y] >= need) & (den * np.minimum(nx, ny) >= num * np.maximum(nx, ny))
        if not whole:
            ok &= side[at][x] != side[at][y]
        return members[x[ok]], members[y[ok]]

    def run(batches):
        held, cell = [], None

        def done():
            a, b = pairs(*(np.concatenate(c) for c in zip(*held)))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for rb in batches:
            if not rb.num_rows:
                continue
            cols = [rb.column(c).to_numpy() for c in range(5)]
            key = cols[0]
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for a, b in zip(cuts, cuts[1:]):
                if held and key[a] != cell:
                    yield done()
                    held = []
                cell = key[a]
                held.append([c[a:b] for c in cols[1:]])
        if held:
            yield done()

    return run


def _families(rows: DataFrame) -> DataFrame:
    """id, family: sets connected by signatures, by the smallest id that a signature's sets have, until nothing changes."""
    lists = materialize(rows.groupBy("sig").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"))
    total = rows.count()
    edges = materialize(skew_join(rows.select("sig", "id"), lists, ["sig"], "c", total).select("sig", "id"))
    labels = materialize(edges.select("id", F.col("id").alias("family")).distinct())
    while True:
        least = edges.join(labels, "id").groupBy("sig").agg(F.min("family").alias("least"), F.count(F.lit(1)).alias("c"))
        near = skew_join(edges, least, ["sig"], "c", total).groupBy("id").agg(F.min("least").alias("least"))
        new = materialize(labels.join(near, "id").select("id", F.col("family").alias("old"), F.least("family", "least").alias("family")))
        labels = new.select("id", "family")
        if not new.filter("old <> family").limit(1).count():
            return labels


def _candidates(index: DataFrame, t: Fraction) -> DataFrame:
    """Pairs (a, b) that share enough signatures."""
    # where one side is covered by rare tokens alone: their lists hold RARE classes at most
    pairs = index.filter("not combo").select("sig", "id", "n", "rare").repartition("sig").mapInArrow(_pairs(t), "a long, b long, na int, nb int, ra int, rb int, shared long")
    pairs = pairs.groupBy("a", "b").agg(*[F.max(c).alias(c) for c in ("na", "nb", "ra", "rb")], F.sum("shared").alias("shared"))
    pairs = pairs.filter(F.col("shared") >= _need(t)).select("a", "b")
    # where neither is: near copies by the hundred share most of their combinations, so their pairs are not emitted list by list;
    # connected sets meet in cells of BLOCK sets a side, where shared signatures are counted at once
    rows = materialize(index.filter("rare >= 0").select("sig", "id", "n"))
    family = _families(rows)
    size = family.groupBy("family").agg(F.count(F.lit(1)).alias("c"))
    parts = F.ceil(F.col("c") / BLOCK).cast("int")
    member = skew_join(family, size, ["family"], "c", family.count()).select("id", "family", parts.alias("parts"), F.pmod(F.xxhash64("id", F.lit(1)), parts).cast("int").alias("mine"))
    split = rows.join(member, "id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    side = F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1).cast("byte")
    split = split.select(F.xxhash64("family", F.least("mine", "other"), F.greatest("mine", "other")).alias("cell"), side.alias("side"), "id", "n", "sig")
    cells = split.repartition("cell").sortWithinPartitions("cell", "sig").mapInArrow(_cell_pairs(t), "a long, b long")
    return pairs.unionByName(cells)


def _need(t: Fraction):
    """The rare tokens that two similar sets share in their prefixes at least, where one side is covered by rare tokens alone.

    With overlap ``o`` needed, one set misses ``n - o`` of its tokens at most. The prefix that ends first lies wholly
    within the other's range, so of its ``e + 1`` covered misses all but ``n - o`` are shared signatures. A set that is
    covered by its rare tokens alone ends before one that is not.
    """
    overlap = F.ceil((F.col("na") + F.col("nb")).cast("long") * t.numerator / F.lit(t.numerator + t.denominator) - F.lit(1e-6))
    need = {x: -1 - F.col(f"r{x}") - (F.col(f"n{x}") - overlap) for x in "ab"}
    a, b = F.col("ra") < 0, F.col("rb") < 0
    return F.when(a & b, F.least(need["a"], need["b"])).when(a, need["a"]).otherwise(need["b"])


# ---------------------------------------------------------------- verification

_FULL = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("tokens", pa.binary())])


def _full(k: int):
    """Hash and whole set of each text, equal sets once in a task."""

    def run(batches):
        seen: set[bytes] = set()
        for rb in batches:
            for _, sets in doc_shingles(binary(rb.column(0)), k):
                raws, digests = [], []
                for s in sets:
                    data = s.tobytes()
                    d = xxhash.xxh3_128_digest(data)
                    if d not in seen:
                        seen.add(d)
                        raws.append(data)
                        digests.append(d)
                h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                yield batch(_FULL, [h[:, 0], h[:, 1], raws])

    return run


def _verify(t: Fraction):
    """Rows sorted by group, sets before pairs: keeps one group's sets, checks its pairs."""
    num, den = t.numerator, t.denominator

    def run(batches):
        group, sets = None, {}
        for rb in batches:
            a_out, b_out = [], []
            for at in range(0, rb.num_rows, 256):
                for g, kind, a, b, toks in zip(*(rb.column(c).slice(at, 256).to_pylist() for c in range(5))):
                    if g != group:
                        group, sets = g, {}
                    if kind == 0:
                        sets[a] = np.frombuffer(toks, np.uint64)
                        continue
                    both = np.concatenate([sets[a], sets[b]])
                    both.sort(kind="stable")
                    shared = int((both[1:] == both[:-1]).sum())
                    if den * shared >= num * (len(both) - shared):
                        a_out.append(a)
                        b_out.append(b)
            if a_out:
                yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])

    return run


def _links(docs: DataFrame, rows: DataFrame, sets: DataFrame, pairs: DataFrame, k: int, t: Fraction) -> DataFrame:
    """The pairs (a, b) that are similar. ``rows``: doc_id of every row, ``sets``: id, doc_id, h1, h2 of the classes' representatives.

    Sets connected by pairs meet in one cell, or in cells of about BLOCK sets a side. Which cells a set goes to is known before
    the scan that makes the sets, so each set is sent once, straight to its cell.
    """
    groups = components(pairs)
    size = groups.groupBy("component").agg(F.count(F.lit(1)).alias("c"))
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("c") / BLOCK))
    place = materialize(skew_join(groups, size, ["component"], "c", groups.count()).select("id", F.xxhash64("component", part).alias("cell")))
    ca, cb = place.select(F.col("id").alias("a"), F.col("cell").alias("ca")), place.select(F.col("id").alias("b"), F.col("cell").alias("cb"))
    placed = materialize(pairs.join(ca, "a").join(cb, "b").select(F.xxhash64(F.least("ca", "cb"), F.greatest("ca", "cb")).alias("g"), "a", "b"))
    members = placed.select("g", F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.collect_set("g").alias("gs"))
    key = F.coalesce("doc_id", F.lit(_NULL_ID))
    wanted = materialize(sets.join(members, "id").select(key.alias("key"), "id", "h1", "h2", "gs"))
    size = wanted.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("gs")), F.lit(0)).alias("cells")).first()
    small = size.n * 5 + size.cells <= MAX_WORDS
    # the rows that have a wanted doc_id: each once, however often the id is repeated or null
    keys = rows.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("rows_of")).join(wanted.select("key").distinct(), "key", "left_semi")
    base = docs.select("text", key.alias("key"))
    base = base.join(F.broadcast(wanted.select("key").distinct()), "key", "left_semi") if small else skew_join(base, keys, ["key"], "rows_of", rows.count())
    # another row of the same doc_id may have another text: the set's hash decides
    full = base.select("text").mapInArrow(_full(k), "h1 long, h2 long, tokens binary").join(F.broadcast(wanted) if small else wanted, ["h1", "h2"])
    none = F.lit(None)
    meet = full.select(F.explode("gs").alias("g"), F.lit(0).alias("kind"), F.col("id").alias("a"), none.cast("long").alias("b"), "tokens")
    meet = meet.unionByName(placed.select("g", F.lit(1).alias("kind"), "a", "b", none.cast("binary").alias("tokens")))
    return materialize(meet.repartition("g").sortWithinPartitions("g", "kind").mapInArrow(_verify(t), "a long, b long"))


# ---------------------------------------------------------------- components


def components(links: DataFrame) -> DataFrame:
    """id, component (smallest id reachable) of the ids in ``links`` (a, b): smallest neighbour's label, then the label's label, until nothing changes."""
    edges = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = materialize(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("label")))
    while True:
        near = edges.join(labels, edges["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["id"] == near["a"], "left").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("id").alias("via"), F.col("label").alias("far"))
        new = materialize(step.join(jump, step["label"] == jump["via"], "left").select("id", "old", F.least("label", "far").alias("label")))
        changed = new.filter("label <> old").limit(1).count()
        labels = new.select("id", "label")
        if not changed:
            return labels.withColumnRenamed("label", "component")


# ---------------------------------------------------------------- the operator

def _components(docs: DataFrame, k: int, threshold: Fraction, keyed: bool) -> DataFrame:
    """Per row: doc_id, n_shingles, n_similar, component_id; if ``keyed``, its text's t1 and t2 and first_key, the smallest key (doc_id, t1, t2) of its component (null without shingles)."""
    base = only(docs, "doc_id", "text")
    t = ["t1", "t2"] if keyed else []
    least = lambda c, name: [F.min(c).alias(name)] if keyed else []
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *t)
    sets = materialize(base.select("doc_id", "text", *(_text_key() if keyed else [])).mapInArrow(_sets(k, threshold, t), "uid long, doc_id long, n long, h1 long, h2 long, tokens binary" + "".join(f", {c} long" for c in t)))
    classes = materialize(sets.filter("n > 0").groupBy("h1", "h2", "n").agg(F.min("uid").alias("id"), F.min("doc_id").alias("first_doc"), *least(own, "own_key"), F.count(F.lit(1)).alias("size")))
    reps = sets.drop(*t).join(classes.select("id"), sets["uid"] == F.col("id"), "left_semi").withColumnRenamed("uid", "id")
    reps = materialize(reps.withColumn("n", F.col("n").cast("int")))
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_tokens(reps))
    index = materialize(reps.filter("length(tokens) > 0").select("id", "n", "tokens").mapInArrow(_index(frequent, threshold), "sig long, id long, n int, rare int, combo boolean"))
    pairs = materialize(_candidates(index, threshold))
    links = _links(base, sets.select("doc_id"), reps.select("id", "doc_id", "h1", "h2"), pairs, k, threshold)
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.join(classes.select(F.col("id").alias("b"), "size"), "b").groupBy(F.col("a").alias("id")).agg(F.sum("size").alias("linked"))
    comp = components(links).join(classes.select("id", "first_doc", *["own_key"] * keyed), "id")
    comp = comp.join(comp.groupBy("component").agg(F.min("first_doc").alias("least_doc"), *least("own_key", "least_key")), "component").select("id", "least_doc", *["least_key"] * keyed)
    classes = classes.join(degree, "id", "left").join(comp, "id", "left").select("h1", "h2", "n", "size", (F.col("size") - 1 + F.coalesce("linked", F.lit(0))).alias("n_similar"), F.coalesce("least_doc", "first_doc").alias("component_id"), *[F.coalesce("least_key", "own_key").alias("first_key") for _ in t[:1]])
    rows = sets.select("doc_id", "n", "h1", "h2", *t)
    found = skew_join(rows.filter("n > 0"), classes, ["h1", "h2", "n"], "size", rows.count()).select("doc_id", "n", "n_similar", "component_id", *t, *["first_key"] * keyed)
    empty = rows.filter("n = 0").select("doc_id", "n", F.lit(0).cast("long").alias("n_similar"), F.col("doc_id").alias("component_id"), *t)
    return found.unionByName(empty, allowMissingColumns=True).withColumnRenamed("n", "n_shingles")


def similar_documents(docs: DataFrame, k: int = K, threshold: Fraction = THRESHOLD) -> DataFrame:
    """Per document: doc_id, n_shingles, n_similar (other documents at ``J >= threshold``), component_id (smallest doc_id reachable)."""
    return _components(docs, k, threshold, False).select("doc_id", "n_shingles", "n_similar", "component_id")


def _text_key() -> list[F.Column]:
    """128 bits of the text, computed alike wherever it is read."""
    return [F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("key"), "text").alias("t2")]


_KEY = ["doc_id", "t1", "t2"]
_COLS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_similar(docs: DataFrame, k: int = K, threshold: Fraction = THRESHOLD) -> DataFrame:
    """``docs`` (doc_id, text, lang, source, n_chars) with one row of each component: the one with the smallest doc_id.

    Rows are told apart by doc_id and text. A null doc_id comes last; of one doc_id's texts in a component one stays, and
    of rows that repeat both, one (with the smallest lang, source and n_chars). Rows without a word are components of their own.
    """
    keys = _components(docs, k, threshold, True).filter("first_key is not null")
    first = F.col("doc_id").eqNullSafe(F.col("first_key.doc_id")) & (F.col("t1") == F.col("first_key.t1")) & (F.col("t2") == F.col("first_key.t2"))
    keys = materialize(keys.select(*_KEY, first.alias("first")).groupBy(*_KEY).agg(F.bool_or("first").alias("first"), F.count(F.lit(1)).alias("c")).filter("not first or c > 1"))
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["t1"] == b["t1"]) & (a["t2"] == b["t2"])
    rows = only(docs, *_COLS).withColumns({c: e for c, e in zip(("t1", "t2"), _text_key())})
    out = rows.join(keys, same(rows, keys), "left_anti").select(*_COLS)
    repeated = keys.filter("first").select(*_KEY)
    n = repeated.count()
    if not n:
        return out
    # one of the rows that repeat a kept doc_id and text: combined map-side, however many there are
    copies = rows.join(F.broadcast(repeated) if n <= MAX_IDS else repeated, same(rows, repeated), "left_semi")
    one = copies.groupBy(*_KEY).agg(F.first("text").alias("text"), F.min(F.struct("lang", "source", "n_chars")).alias("least"))
    return out.unionByName(one.select("doc_id", "text", "least.lang", "least.source", "least.n_chars"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_WORDS = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

OP9_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.reach = l.a),
m AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id),
k AS (SELECT a AS doc_id, count(*) AS n FROM l GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(k.n, 0) AS n_similar, component_id FROM d JOIN m USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""
