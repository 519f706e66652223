"""Graph walks over numbered nodes: one small number a node is held by every task and the driver, edges stay in sorted blocks of which a task reads one.

A round gives each task the numbers of all nodes; it follows its own edges until they change nothing more, and the driver merges what changed. Nodes beyond
``LIMIT`` would make those numbers large: for them ``graph`` walks by joins.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .iterate import materialize
from .sequence import numbered

#: Nodes of which numbers are held at once: 64 MB of them.
LIMIT = 16_000_000
#: Edges of a block.
BLOCK = 1_000_000


class SplitNode(Exception):
    """The edges of one node were read by several tasks (a file of more than one row group): none of them can tell when it is done."""


class Dense:
    """``nodes`` (name, id from 0 in the order of names), ``n`` of them, and blocks of the edges."""

    def __init__(self, edges: DataFrame, nodes: DataFrame, n: int):
        """``edges`` (src, dst) and ``nodes`` (name) are written tables without other columns; an edge's ends are nodes."""
        self.n = n
        self.nodes = materialize(numbered(nodes, ["name"], "id").select("name", F.col("id").cast("int").alias("id")))
        a, b = (self.nodes.select(F.col("name").alias(c), F.col("id").alias(f"{c}_id")) for c in ("src", "dst"))
        self.edges = materialize(edges.join(a, "src").join(b, "dst").select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst")))
        self.parts = max(edges.sparkSession.sparkContext.defaultParallelism, self.edges.count() // BLOCK)
        self.forward = self._blocks("src", "dst")

    def _blocks(self, src: str, dst: str) -> DataFrame:
        e = self.edges.select(F.col(src).alias("src"), F.col(dst).alias("dst"))
        return materialize(e.repartitionByRange(self.parts, "dst").sortWithinPartitions("dst"))

    def backward(self) -> DataFrame:
        return self._blocks("dst", "src")

    def _round(self, blocks: DataFrame, step: Callable, *state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their new numbers, of ``step(src, dst, *state)`` over each task's edges, sorted by dst."""
        held = blocks.sparkSession.sparkContext.broadcast(state)

        most = 4 * BLOCK

        def found(s, d):
            if (d[1:] < d[:-1]).any():  # several blocks
                order = np.argsort(d, kind="stable")
                s, d = s[order], d[order]
            ids, new = step(s, d, *held.value)
            return pa.RecordBatch.from_pydict({"ids": [ids.astype(np.int32).tobytes()], "new": [new.astype(np.int32).tobytes()]})

        def run(batches):
            got, n = [], 0
            for rb in batches:
                got.append((rb.column(0).to_numpy(), rb.column(1).to_numpy()))
                n += rb.num_rows
                if n >= most:  # small blocks read by one task: what is there but for the last node, whose edges may go on
                    s, d = (np.concatenate(x) for x in zip(*got))
                    before = np.flatnonzero(d != d[-1])
                    if len(before):
                        yield found(s[: before[-1] + 1], d[: before[-1] + 1])
                        s, d = s[before[-1] + 1 :], d[before[-1] + 1 :]
                    got, n = [(s, d)], len(d)
            if n:
                yield found(*(np.concatenate(x) for x in zip(*got)))

        rows = blocks.mapInArrow(run, "ids binary, new binary").collect()
        held.destroy()
        return tuple(np.concatenate([np.frombuffer(r[c], np.int32) for r in rows] or [np.empty(0, np.int32)]) for c in ("ids", "new"))

    def levels(self, blocks: DataFrame, done: np.ndarray | None = None) -> np.ndarray:
        """Of each node the steps of the longest way to it, -1 on cycles and behind them. Nodes in ``done`` count as gone."""
        level = np.zeros(self.n, np.int32)
        ids = self._round(blocks, _targets)[0]
        level[ids] = -1
        if len(ids) > np.count_nonzero(level):
            raise SplitNode
        if done is not None:
            level[done] = 0
        while (level < 0).any():
            ids, new = self._round(blocks, _peel, level)
            if not len(ids):
                break
            level[ids] = new
        return level

    def components(self) -> np.ndarray:
        """Of each node the largest id of its strong component: nodes on no cycle are peeled from both sides, the rest is coloured by the largest id that leads to it and each colour walked back from its own id."""
        own, back = np.arange(self.n, dtype=np.int32), self.backward()
        comp = np.full(self.n, -1, np.int32)
        while True:
            for blocks in (self.forward, back):
                if (comp < 0).any():
                    single = (self.levels(blocks, comp >= 0) >= 0) & (comp < 0)
                    comp[single] = own[single]
            alive = comp < 0
            if not alive.any():
                return comp
            colour = own.copy()
            while len((got := self._round(self.forward, _colour, colour, alive))[0]):
                np.maximum.at(colour, *got)
            mark = alive & (colour == own)
            while len((got := self._round(back, _reach, colour, alive, mark))[0]):
                mark[got[0]] = True
            comp[mark] = colour[mark]


def _starts(d: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))


def _targets(s, d):
    u = d[_starts(d)]
    return u, u


def _peel(s, d, level):
    level, found = level.copy(), [np.empty(0, np.int32)]
    left = level[d] < 0
    while left.any():
        s, d = s[left], d[left]
        at, v = _starts(d), level[s]
        ready = np.minimum.reduceat(v, at) >= 0
        if not ready.any():
            break
        ids = d[at][ready]
        level[ids] = np.maximum.reduceat(v, at)[ready] + 1
        found.append(ids)
        left = ~np.repeat(ready, np.diff(np.append(at, len(d))))
    ids = np.concatenate(found)
    return ids, level[ids]


def _colour(s, d, colour, alive):
    keep = alive[s] & alive[d]
    s, d, new = s[keep], d[keep], colour.copy()
    if len(d):
        at = _starts(d)
        u = d[at]
        while True:
            v = np.maximum.reduceat(new[s], at)
            more = v > new[u]
            if not more.any():
                break
            new[u[more]] = v[more]
    ids = np.flatnonzero(new != colour)
    return ids, new[ids]


def _reach(s, d, colour, alive, mark):
    keep = alive[s] & alive[d] & (colour[s] == colour[d]) & ~mark[d]
    s, d, new = s[keep], d[keep], mark.copy()
    if len(d):
        at = _starts(d)
        u = d[at]
        while True:
            more = np.maximum.reduceat(new[s], at) & ~new[u]
            if not more.any():
                break
            new[u[more]] = True
    ids = np.flatnonzero(new != mark)
    return ids, ids
