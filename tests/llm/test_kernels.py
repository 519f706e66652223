"""The operators' kernels against brute force, without Spark."""

import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from cairn.llm import bpe, decontamination as dc, jaccard as jc, language as lg, licenses as lc, quality_cnn as cnn, quality_rules as qr, sharding as sh, token_counts as tc
from cairn.llm._common import doc_shingles

PIECES = ["a", "b", "é", "é", " ", "  ", "\n", "\t", "'s", "'LL", "1", "23", "!", "?!", "<|endoftext|>", "<|startoftext|>", "ß", "日本", "\x1c", "\x85", "😀", "İ", "Σ", "aaaa", "The", "ing", "²", "ﬁ", "\x00"]


def random_texts(n, seed=3):
    r = random.Random(seed)
    return ["".join(r.choice(PIECES) for _ in range(r.randint(0, 40))) for _ in range(n)] + ["", "a" * 3000, "ab" * 1000, " " * 500]


def test_token_counts_are_the_librarys():
    P, tokenizers = pytest.importorskip("public_tokenizers"), pytest.importorskip("tokenizers")
    path, xs = P.path("byte_bpe_50k.json"), random_texts(3000)
    t = tokenizers.Tokenizer.from_file(path)
    assert tc.count_tokens(xs, path) == [len(e.ids) for e in t.encode_batch(xs, add_special_tokens=False)]


def test_bpe_is_the_librarys_and_round_trips():
    P, tokenizers = pytest.importorskip("public_tokenizers"), pytest.importorskip("tokenizers")
    path, xs = P.path("word_bpe_49k.json"), random_texts(3000)
    t, c = tokenizers.Tokenizer.from_file(path), bpe.coder(path)
    for x, e in zip(xs, t.encode_batch(xs, add_special_tokens=False)):
        assert c.encode(x) == e.ids and c.decode(e.ids) == t.decode(e.ids, skip_special_tokens=False)
    assert c.text(c.encode("Hello, the WORLD é")) == "hello , the world é"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=30), st.randoms(use_true_random=False))
def test_segment_tree_merges_like_a_scan(symbols, r):
    words = sorted({"".join(r.choice("abc") for _ in range(r.randint(2, 5))) for _ in range(12)})
    pairs = [(w[:i], w[i:]) for w in words for i in range(1, len(w))]
    r.shuffle(pairs)
    ranks = {p: i for i, p in enumerate(pairs)}
    want = list(symbols)
    while True:
        best = min(((ranks[p], i) for i, p in enumerate(zip(want, want[1:])) if p in ranks), default=None)
        if best is None:
            break
        i = best[1]
        want[i : i + 2] = [want[i] + want[i + 1]]
    assert bpe.merge_all(list(symbols), ranks, {p: p[0] + p[1] for p in ranks}) == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbé \n\t\x0b|", max_size=60)), max_size=6))
def test_shingles_are_sets_of_words(texts):
    col = pa.array([None if t is None else t.encode() for t in texts], pa.binary())
    got = [s for _, part in doc_shingles(col, 3) for s in part]
    want = []
    for t in texts:
        w = (t or "").encode().lower().split()
        want.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set()))
    assert [len(s) for s in got] == [len(s) for s in want]
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert len(np.intersect1d(got[i], got[j])) == len(want[i] & want[j])


@settings(max_examples=200, deadline=None)
@given(st.integers(9, 300), st.data())
def test_similar_sets_share_signatures(n, data):
    t, r = Fraction(9, 10), np.random.default_rng(data.draw(st.integers(0, 2**32)))
    x = np.sort(r.integers(0, 2**64, n, dtype=np.uint64))
    drop = data.draw(st.integers(0, jc.misses(n, t)))
    y = np.delete(x, r.choice(n, drop, replace=False))
    while True:  # as many new tokens as the threshold allows
        z = np.sort(np.append(y, r.integers(0, 2**64, dtype=np.uint64)))
        both = len(np.intersect1d(x, z))
        if 10 * both < 9 * (n + len(z) - both):
            break
        y = z
    often = lambda s: (s * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(62)) >= data_share
    data_share = np.uint64(data.draw(st.integers(0, 4)))
    sides = []
    for s in (x, y):
        upto = max(int(np.searchsorted(s, jc._ZONE)), jc.misses(len(s), t) + 1 + jc.subclasses(jc.bands(len(s), t)[-1]))
        rare, combos, _ = jc.signatures(s[:upto], len(s), often(s[:upto]), t)
        sides.append(set(rare.tolist()) | {("c", c) for c in combos.tolist()})
    assert sides[0] & sides[1]


def test_containment_index_finds_what_brute_force_finds():
    r = random.Random(1)
    vocab = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, text(r.choice([2, 4, 9, 30, 60]))) for i in range(40)] + [(98, ""), (99, None)]
    docs = []
    for i in range(80):
        w = text(r.randint(0, 300)).split()
        if i % 2:
            own = items[i % 40][1].split()
            cut = own[: max(1, len(own) - r.randint(0, len(own) // 3))]
            at = r.randint(0, len(w))
            w[at:at] = cut
        docs.append(" ".join(w))
    grams = lambda t, k: {tuple(t.lower().split()[i : i + k]) for i in range(len(t.split()) - k + 1)}
    want = set()
    for d, t in enumerate(docs):
        for i, (_, q) in enumerate(items):
            k = min(5, len((q or "").split()))
            if k and 5 * len(grams(q, k) & grams(t, k)) >= 4 * len(grams(q, k)):
                want.add((d, items[i][0]))
    ix = dc.Index(items, 5, Fraction(4, 5))
    data = "".join(docs).encode()
    off = np.concatenate([[0], np.cumsum([len(d.encode()) for d in docs])])
    got = {(d, x) for d, i, _ in ix.matches(*dc.word_hashes(np.frombuffer(data, np.uint8), off)) for x in ix.ids[i]}
    assert got == want and want


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab #*\n\té", max_size=80))
def test_text_statistics(t):
    w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", t) if x]
    c = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i, g in enumerate(zip(w, w[1:], w[2:])) if c[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if x.strip(" \t\x0b\x0c\r\n")]
    assert qr.text_stats(t.encode())[:5] == (len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t), len(lines) - len(set(lines)), len(covered))


def test_packing_balances_all_dimensions():
    r = np.random.default_rng(0)
    w = np.stack([r.lognormal(3, 1, 4000), r.lognormal(2, 1, 4000), np.ones(4000)], axis=1)
    s = sh.pack(w, 40)
    load = np.stack([np.bincount(s, w[:, k], 40) for k in range(3)])
    assert (load.max(1) / load.mean(1) < 1.05).all()


def test_license_rules():
    lib = lc.Library()
    mit = "MIT License\n\nCopyright (c) 2020 X\n\n" + lc.SENTENCES["mit-grant"][0].replace("Software", "Software\n", 2) + "\n\n" + lc.SENTENCES["mit-notice"][0] + "\n" + lc.SENTENCES["as-is-software"][0]
    assert lc.scan(mit.encode(), lib)[2:] == ("mit-name,mit-grant,mit-notice,as-is-software", "MIT", "permissive")
    two = b"prose here\nReleased under the MIT License. More.\nThis work is licensed under the GNU General Public License, version 3."
    assert lc.scan(two, lib)[3:] == ("GPL-3.0-only,MIT", "copyleft")
    assert lc.scan(b"Licensed under the Foo License, version 9.", lib) == (0, 1, "", "", "unknown")
    assert lc.scan(b"", lib) == lc.scan(b"plain", lib) == (0, 0, "", "", "none")
    bsd2 = ". ".join(lc.SENTENCES[k][0] for k in ("bsd-grant", "bsd-source", "bsd-binary"))
    assert lc.scan(bsd2.encode(), lib)[3] == "BSD-2-Clause"
    assert lc.scan((bsd2 + " " + lc.SENTENCES["bsd-names"][0].replace("...", "the copyright holder")).encode(), lib)[3] == "BSD-3-Clause"


def test_language_filters():
    en, de = b"the thing is of that and with ", b"der die und nicht mit einer sch "
    members = []
    for t in (en, de):
        g, ok, _ = lg.grams([t * 3])
        members.append(np.unique(g[ok]))
    f = lg.Filters(["de", "en"], members[::-1], "en")
    lang, score = f.predict([en, de, None, b"", b"123 !?", "¡¿".encode(), b"zzqqxxyy"])
    assert lang[:6] == ["en", "de", "und", "und", "und", "und"] and lang[6] == "en" and score[6] == 0 and all(0 <= s <= 1 for s in score)


def test_chunks_cover_the_whole_text():
    t = bytes(range(1, 256)) * 9
    rows, first = cnn.chunks([b"", t, b"x"])
    assert first.tolist()[1] == 1 and len(rows) == first[-1]
    own = rows[first[1] : first[2]]
    rebuilt = np.concatenate([own[0], *[r[cnn.CHUNK - cnn.STEP :] for r in own[1:]]]).tobytes()
    assert rebuilt[: len(t)] == t and not rebuilt[len(t) :].strip(b"\0")


def test_network_gradients_and_learning():
    net, texts, y = cnn.Network(1), [b"abc " * 40, b"### $$$ " * 30, b"", b"plain words"], np.array([1.0, 0, 0, 1])
    w = np.ones(4)
    net.w = {k: v.astype(float) for k, v in net.w.items()}
    g = net.gradients(texts, y, w)

    def loss():
        p = np.clip(net.score(texts, net.table()), 1e-9, 1 - 1e-9)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for k, at in (("h", (3, 2)), ("o", (1,)), ("bias", (4,)), ("filter", (2, 3, 4))):
        e, keep = 1e-3, net.w[k][at]
        net.w[k][at] = keep + e
        up = loss()
        net.w[k][at] = keep - e
        down = loss()
        net.w[k][at] = keep
        assert abs((up - down) / (2 * e) - g[k][at]) < 2e-3 + 0.1 * abs(g[k][at])
    r = random.Random(0)
    good = [" ".join(r.choice(["tree", "house", "river"]) for _ in range(60)).encode() for _ in range(40)]
    bad = [" ".join(r.choice(["tr##e", "h$$use", "ri%%er"]) for _ in range(60)).encode() for _ in range(40)]
    net = cnn.Network().fit(good[:30] + bad[:30], np.array([1.0] * 30 + [0.0] * 30))
    p = net.score(good[30:] + bad[30:], net.table())
    assert (p[:10] > 0.5).all() and (p[10:] < 0.5).all()


def test_license_trigger_loses_nothing():
    lib = lc.Library()
    for t in (b"Released under the FPL, version 2.", b"Use it under the terms of the AGPL.", b"Released  under the\tGPL"):
        assert lc.scan(t, lib) == (0, 1, "", "", "unknown")
    for forms in lc.SENTENCES.values():
        for f in forms:
            assert all(lc.triggers(f.replace(" ", gap).encode()) for gap in ("\n", "\n * ", "  "))
    for speaks in lc._SPEAKS.pattern.split("|"):
        assert all(lc.triggers(speaks.replace(" ", gap).encode()) for gap in (" ", "\n", ", ", "\n * "))
