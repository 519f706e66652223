"""Token counts by rank-synchronous array merging.

Texts are cut into pre-tokens by the byte-level pattern; pre-tokens not counted
yet are held, a batch at a time, as one ragged numpy array of symbols. In each
round every sequence's lowest-rank adjacent pair is found by a segmented minimum
and all its occurrences, left to right without overlap, are merged at once in all
sequences; sequences without a mergeable pair leave the batch. The symbols that
survive are the tokens. Counts of pre-tokens are kept in a two-generation memo of
bounded size in each worker.

The vocabulary's path is a parameter; every executor must be able to read it. A
null or empty text has no tokens. Special strings inside a text count as one
token each, as the library's default has it. Repeated rows are counted each, null ids
stay null, an empty table gives an empty result, extra columns of any name are ignored.
"""

from __future__ import annotations

import functools
import json
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from ._common import batch, binary, only, slices

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LIMIT = 1024
#: Pre-tokens in each generation of a worker's memo, and merged in one batch; characters of one that is kept in the memo at most.
MEMO, BATCH, MEMO_CHARS = 300_000, 20_000, 128
_NONE = np.int64(1 << 40)


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    out.update({b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in out)})
    return out


class Merges:
    """The vocabulary's pair ranks as sorted arrays."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        vocab, pairs = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [p.split(" ") if isinstance(p, str) else p for p in pairs]
        self.base = np.array([vocab[c] for _, c in sorted(byte_symbols().items())], np.int64)
        self.width = np.int64(max(vocab.values()) + 1)
        key = np.array([vocab[a] * int(self.width) + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.key, self.rank = key[order], order.astype(np.int64)
        self.result = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.split = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        k = a * self.width + b
        at = np.minimum(np.searchsorted(self.key, k), len(self.key) - 1)
        return np.where(self.key[at] == k, self.rank[at], _NONE)

    def count(self, words: list[bytes]) -> np.ndarray:
        """Surviving symbols of each word."""
        out = np.zeros(len(words), np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.base[np.frombuffer(b"".join(words), np.uint8)]
        seq = np.repeat(np.arange(len(words)), size)
        rank = np.full(len(sym), _NONE)
        if len(sym) > 1:
            same = seq[1:] == seq[:-1]
            rank[:-1][same] = self.ranks(sym[:-1][same], sym[1:][same])
        while len(sym):
            start = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
            n = np.diff(np.append(start, len(seq)))
            low = np.minimum.reduceat(rank, start)
            done = low == _NONE
            if done.any():
                out[seq[start[done]]] = n[done]
                keep = np.repeat(~done, n)
                sym, seq, rank, low, n = sym[keep], seq[keep], rank[keep], low[~done], n[~done]
                if not len(sym):
                    break
            hit = rank == np.repeat(low, n)
            at = np.flatnonzero(hit)
            # in a run of hits side by side (a pair of equal symbols) every second one counts, from the left
            run = np.concatenate([[True], at[1:] != at[:-1] + 1])
            nth = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[nth % 2 == 0]
            sym[at] = self.result[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            new = at - np.arange(len(at))  # the merged symbols' places once the right halves are gone
            sym, seq, rank = sym[keep], seq[keep], rank[keep]
            for left in (new, new[new > 0] - 1):
                rank[left] = _NONE
                left = left[left + 1 < len(sym)]
                left = left[seq[left] == seq[left + 1]]
                rank[left] = self.ranks(sym[left], sym[left + 1])
        return out


@functools.cache
def _merges(path: str) -> Merges:
    return Merges(path)


_memo: dict[str, dict[str, int]] = {}
_old: dict[str, dict[str, int]] = {}
_pattern = regex.compile(PATTERN)


def count_tokens(texts: list[str], path: str) -> list[int]:
    m = _merges(path)
    memo = _memo.setdefault(path, {})
    if len(memo) > MEMO:
        _old[path], memo = memo, {}
        _memo[path] = memo
    old = _old.get(path, {})
    parts, special = [], []
    for t in texts:
        if m.split is not None and any(s in t for s in m.special):
            pieces = m.split.split(t)
            special.append(len(pieces) - 1)
            parts.append([w for p in pieces for w in _pattern.findall(p)])
        else:
            special.append(0)
            parts.append(_pattern.findall(t))
    missing = set(chain.from_iterable(parts)).difference(memo)
    for w in missing & old.keys():
        memo[w] = old[w]
    todo = list(missing.difference(old))
    long: dict[str, int] = {}
    for i in range(0, len(todo), BATCH):
        some = todo[i : i + BATCH]
        for w, n in zip(some, m.count([w.encode() for w in some]).tolist()):
            (memo if len(w) <= MEMO_CHARS else long)[w] = n
    if long:
        return [sum(long[w] if w in long else memo[w] for w in p) + s for p, s in zip(parts, special)]
    return [sum(map(memo.__getitem__, p)) + s for p, s in zip(parts, special)]


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def _count(path: str, limit: int):
    def run(batches):
        for rb in batches:
            ids, text = rb.column(0), binary(rb.column(1))
            for a, b in slices(text):
                raw = [t or b"" for t in text.slice(a, b - a).to_pylist()]
                n = count_tokens([t.decode("utf-8", "replace") for t in raw], path)
                yield batch(_OUT, [ids.slice(a, b - a), list(map(len, raw)), n, [x > limit for x in n]])

    return run


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens)."""
    return only(docs, "doc_id", "text").mapInArrow(_count(path, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
