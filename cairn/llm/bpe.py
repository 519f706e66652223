"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A pre-token's symbols are a linked list; leaf i of a tree holds the rank of the
pair that begins at symbol i, each inner node the smaller of its children with the
left one winning ties. The root is the leftmost lowest-rank merge; a merge changes
three leaves at most, each a logarithmic update, until the root holds no pair. So a
pre-token of n symbols costs O(n log n), however long. Encoded pre-tokens are kept
in a two-generation memo of bounded size in each worker.

The vocabulary's path is a parameter; every executor must be able to read it. Its
normalizer (NFC, lower case), splitting pattern, end-of-word suffix and missing
decoder (token strings joined by spaces) are those of the word-level file. A null
or empty text encodes to no ids and decodes to an empty text. Special strings
inside a text are their own tokens, as the library's default has it. Repeated rows are
coded each, null ids stay null, an empty table gives an empty result, extra columns of any
name are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from ._common import batch, binary, only, slices
from .token_counts import byte_symbols

#: Pre-tokens in each generation of a worker's memo, and characters of one that is kept there at most.
MEMO, MEMO_CHARS = 250_000, 128
#: Symbols of a pre-token beyond which its tree and links are packed arrays (40 bytes a symbol and its token strings).
PACKED = 1 << 16
_SHIFT = 32
_MASK = (1 << _SHIFT) - 1
_NONE = 1 << 62


def merge_all(symbols: list, ranks: dict, result: dict) -> list:
    """``symbols`` after all merges: always the leftmost pair of lowest rank. ``ranks``: pair -> rank, ``result``: pair -> symbol."""
    n = len(symbols)
    if n < 2:
        return symbols
    get = ranks.get
    size = 1
    while size < n - 1:
        size *= 2
    # a leaf is rank and place in one integer: smaller is lower rank, then further left; long runs lie in packed arrays
    tree = [_NONE] * (2 * size) if n <= PACKED else array("q", [_NONE]) * (2 * size)
    for i in range(n - 1):
        r = get((symbols[i], symbols[i + 1]))
        if r is not None:
            tree[size + i] = r << _SHIFT | i
    for i in range(size - 1, 0, -1):
        x, y = tree[2 * i], tree[2 * i + 1]
        tree[i] = x if x < y else y
    nxt, prev = (list(r) if n <= PACKED else array("q", r) for r in (range(1, n + 1), range(-1, n - 1)))

    def put(i: int, value: int) -> None:
        i += size
        tree[i] = value
        while i > 1:
            other, i = tree[i ^ 1], i >> 1
            if other < value:
                value = other
            if tree[i] == value:
                return
            tree[i] = value

    while tree[1] != _NONE:
        i = tree[1] & _MASK
        j = nxt[i]
        symbols[i] = result[symbols[i], symbols[j]]
        symbols[j] = None
        k = nxt[i] = nxt[j]
        if j < n - 1:
            put(j, _NONE)
        if k < n:
            prev[k] = i
            r = get((symbols[i], symbols[k]))
            put(i, _NONE if r is None else r << _SHIFT | i)
        else:
            put(i, _NONE)
        p = prev[i]
        if p >= 0:
            r = get((symbols[p], symbols[i]))
            put(p, _NONE if r is None else r << _SHIFT | p)
    return [s for s in symbols if s is not None]


class Coder:
    """Encodes and decodes with a BPE vocabulary file; ``encode`` and ``decode`` are each other's inverse up to normalization."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.suffix = model["end_of_word_suffix"] or ""
        pairs = [tuple(p.split(" ")) if isinstance(p, str) else tuple(p) for p in model["merges"]]
        self.ranks = {p: i for i, p in enumerate(pairs)}
        self.result = {p: p[0] + p[1] for p in pairs}
        self.byte = byte_symbols()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.vocab.update(self.special)
        self.token = {i: t for t, i in self.vocab.items()}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.memo: dict[str, tuple[str, str]] = {s: (str(i), s) for s, i in self.special.items()}
        self.old: dict[str, tuple[str, str]] = {}

    def words(self, text: str) -> list[str]:
        """The pre-tokens of a text; special strings stay whole."""
        if any(s in text for s in self.special):
            return list(chain.from_iterable([p] if p in self.special else self._plain(p) for p in self.cut.split(text)))
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")  # lower case without the rule for a final sigma
        return self.pattern.findall(text.lower())

    def pieces(self, word: str) -> list[str]:
        if word in self.special:
            return [word]
        symbols = [self.byte[b] for b in word.encode()]
        symbols[-1] += self.suffix
        return merge_all(symbols, self.ranks, self.result)

    def renew(self) -> None:
        if len(self.memo) > MEMO:
            self.old, self.memo = self.memo, {s: (str(i), s) for s, i in self.special.items()}

    def coded(self, words: list[str]) -> list[tuple[str, str]]:
        """Of each pre-token its ids and its token strings, each joined by spaces."""
        memo, long = self.memo, {}
        for w in set(words).difference(memo):
            known = self.old.get(w)
            if known is None:
                p = self.pieces(w)
                known = " ".join([str(self.vocab[x]) for x in p]), " ".join(p)
            (memo if len(w) <= MEMO_CHARS else long)[w] = known
        return [memo[w] for w in words] if not long else [long[w] if w in long else memo[w] for w in words]

    def encode(self, text: str) -> list[int]:
        return [self.vocab[p] for w in self.words(text) for p in self.pieces(w)]

    def decode(self, ids: list[int]) -> str:
        """Token strings joined by spaces: the file names no decoder."""
        return " ".join(self.token[i] for i in ids)

    def text(self, ids: list[int]) -> str:
        """The words that the ids stand for, separated by spaces: what ``decode`` means once byte symbols and suffixes are undone."""
        back = {c: b for b, c in self.byte.items()}
        out = bytearray()
        for i in ids:
            t = self.token[i]
            if i in self.special.values():
                out += t.encode() + b" "
                continue
            end = t.endswith(self.suffix)
            out += bytes(back[c] for c in (t[: -len(self.suffix)] if end else t)) + b" " * end
        return out.decode("utf-8", "replace").rstrip(" ")


@functools.cache
def coder(path: str) -> Coder:
    return Coder(path)


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
_OUT = pa.schema([*_DIGEST, ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
_DDL = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _code(path: str, whole: bool):
    def run(batches):
        c = coder(path)
        for rb in batches:
            doc, text = rb.column(0), binary(rb.column(1))
            for a, b in slices(text):
                c.renew()
                ids, back = [], []
                for t in text.slice(a, b - a).to_pylist():
                    both = c.coded(c.words((t or b"").decode("utf-8", "replace")))
                    ids.append(" ".join([x for x, _ in both]))
                    back.append(" ".join([x for _, x in both]))
                n = [i.count(" ") + 1 if i else 0 for i in ids]
                cols = [doc.slice(a, b - a), n, *([hashlib.sha256(x.encode()).hexdigest() for x in xs] for xs in (ids, back))]
                yield batch(_OUT, [*cols, [np.array(i.split(), np.int32) for i in ids], back]) if whole else batch(_DIGEST, cols)

    return run


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by spaces), decoded_sha256, ids, decoded."""
    return only(docs, "doc_id", "text").mapInArrow(_code(path, True), f"{_DDL}, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """The first four columns of ``encode_documents``, without building the rest."""
    return only(docs, "doc_id", "text").mapInArrow(_code(path, False), _DDL)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
