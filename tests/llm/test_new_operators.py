"""Operators 11 to 13 against brute force, and on nulls, empty and long texts,
ties, repeated rows, empty tables and clashing column names."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from flowlens.llm import divergence as V
from flowlens.llm import packing as P
from flowlens.llm import whitening as E

PATH = str(public_tokenizers.path("word_bpe_49k.json"))
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def rounded(p, q):
    return (p - q) ** 2 // (p + q)


def brute_divergence(rows, least, top=10):
    rows = [tuple(x or "" for x in r) for r in rows]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups, docs, total = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for text, lang, source in rows:
        ws = TERM.findall(text.translate(lower))
        groups[lang, source].update(ws)
        total[lang].update(ws)
        docs[lang].update(set(ws))
    out = []
    for lang in total.keys() | {k[0] for k in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        v = len(kept)

        def values(count):
            n = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (n + 2 * v) for t in kept}

        p = {s: values(c) for (g, s), c in groups.items() if g == lang}
        q = values(total[lang])
        for a in p:
            pairs = [(b, sum(rounded(p[a][t], p[b][t]) for t in kept)) for b in p if b != a]
            terms = [(t, rounded(p[a][t], q[t])) for t in kept if groups[lang, a][t] and p[a][t] > q[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, a, part, i, x, n) for n, (i, x) in enumerate(items[:most], 1)]
    return sorted(out)


def text_rows():
    rng = random.Random(5)
    vocab = [f"{x}{y}" for x in ("lo", "na", "Été", "漢字", "zu") for y in ("r", "mi", "", "Q")] + ["rare" * 3]
    rows = [(" ".join(rng.choices(vocab, weights=range(1, len(vocab) + 1), k=rng.randint(0, 40))) + ", 12x_y don't", rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "", None]))
            for _ in range(150)]
    rows += [("same words here here", "en", "hot")] * 80 + [(None, "fr", "x"), ("", "fr", "y"), ("lonely", "fr", "z"), ("12 34", "it", "only"), (None, None, None)]
    return [*rows, ("longlong " * 30000, "en", "a")]


def test_divergence(spark, monkeypatch):
    rows = text_rows()
    df = spark.createDataFrame([(*r, 1, "v") for r in rows], "text string, lang string, source string, p int, value string").repartition(7)
    got = sorted(tuple(r) for r in V.divergence(df).collect())
    assert got == brute_divergence(rows, 10)
    assert len(got) > 100 and {r[2] for r in got} == {"pair", "term"}
    assert [r[4] for r in got if r[0] == "fr" and r[2] == "pair"] == [0] * 6  # no kept terms
    assert not [r for r in got if r[0] == "it"]  # one source, no terms
    assert V.divergence(df.limit(0)).count() == 0
    few = V.divergence(df, V.DivergenceParams(min_documents=60, top_terms=2))
    assert sorted(tuple(r) for r in few.collect()) == brute_divergence(rows, 60, 2)


def test_scatter_in_small_slices(monkeypatch):
    """Slices, products and flushes of a few entries give the same sums."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    rows = sorted({(f"l{rng.integers(2)}", f"t{rng.integers(12):02}", f"s{rng.integers(6)}") for _ in range(140)})
    p = rng.integers(1, 10**9, len(rows))
    z = {k: int(rng.integers(1, 10**6)) for k in {(r[0], r[2]) for r in rows}}
    t = pa.table({"lang": [r[0] for r in rows], "term": [r[1] for r in rows], "source": [r[2] for r in rows], "p": p, "z": [z[r[0], r[2]] for r in rows]})
    want = collections.Counter()
    for (i, a), (j, b) in itertools.permutations(enumerate(rows), 2):
        if a[:2] == b[:2]:
            x, y, u, w = int(p[i]), int(p[j]), z[a[0], a[2]], z[b[0], b[2]]
            want[a[0], a[2], b[2]] += rounded(x, y) - rounded(x, w) - rounded(u, y) + rounded(u, w)
    for slice_rows, products in ((1 << 20, 1 << 20), (5, 3)):
        monkeypatch.setattr(V, "SLICE_POSTINGS", slice_rows)
        monkeypatch.setattr(V, "PRODUCTS", products)
        got = collections.Counter()
        for b in V.accumulate(iter(t.to_batches(max_chunksize=4))):
            for r in b.to_pylist():
                got[r["lang"], r["source"], r["item"]] += r["value"]
        assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


def brute_whitening(x):
    """n, S, explained shares, components and the mean of the distinct rows."""
    u = np.unique(x, axis=0)
    y = (u * len(u) - u.sum(axis=0)) / len(u)
    _, s, vt = np.linalg.svd(y, full_matrices=False)
    return len(u), u.sum(axis=0), s**2 / (s**2).sum(), vt, s**2 / len(u)


def whole(c):
    return np.floor(256 * np.array(c, float)).astype(np.int64)


VECTORS = "vec_id long, embedding array<float>, label int, x string, d int"


def check_whitening(spark, vectors, d, near=1e-9):
    df = spark.createDataFrame([(i, v, 0, "x", 3) for i, v in vectors], VECTORS).repartition(5)
    got = E.whiten(df).collect()
    left = [(i, whole(np.float32(v))) for i, v in vectors if v is not None and len(v) == d and all(c is not None and np.isfinite(c) for c in v)]
    n, sums, share, vt, e = brute_whitening(np.array([x for _, x in left]))
    k = min(4, int((e > 1e-18 * e[0]).sum())) if e[0] > 0 else 0
    assert len(got) == k * len(left) and all(r.n == n for r in got)
    by = collections.defaultdict(list)
    for r in got:
        by[r.vec_id, r.component].append(r)
    for c in range(k):
        want = {i: (x - sums / n) @ vt[c] / np.sqrt(e[c]) for i, x in left if i is not None}
        sign = np.sign(sum(by[i, c + 1][0].whitened * w for i, w in want.items()))
        for i, w in want.items():
            for r in by[i, c + 1]:
                assert abs(sign * r.whitened - w) < near and abs(r.explained / share[c] - 1) < near and r.identity_error < near
    for i, x in left:
        if k and i is not None:
            assert by[i, 1][0].deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x, sums, strict=True))
    return got


def test_whitening(spark):
    rng = np.random.default_rng(4)
    basis = rng.normal(size=(6, 6)) * [9, 5, 3, 1, 0.5, 0.1]
    vectors = [(i, (rng.normal(size=6) @ basis.T).tolist()) for i in range(300)]
    vectors += [(1000 + i, vectors[0][1]) for i in range(150)] + [(7, vectors[7][1]), (None, vectors[3][1])]  # copies, a repeated row, no id
    vectors += [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2002, [float("nan")] * 6), (2003, [float("inf")] * 6), (2004, []), (2005, [1.0, 2.0])]
    got = check_whitening(spark, vectors, 6)
    assert {r.component for r in got} == {1, 2, 3, 4}


def test_whitening_without_spread(spark):
    """Fewer directions than components, nearly dependent ones, one vector, none."""
    rng = np.random.default_rng(5)
    flat = [(i, [float(a), float(b), float(a + b), 3.0, -0.0]) for i, (a, b) in enumerate(rng.integers(-9, 9, (80, 2)))]
    assert {r.component for r in check_whitening(spark, flat, 5)} == {1, 2}
    narrow = [(i, [float(a), float(a) + float(b) / 256, float(c)]) for i, (a, b, c) in enumerate(rng.integers(0, 4, (90, 3)) * [4000, 1, 1])]
    assert {r.component for r in check_whitening(spark, narrow, 3, 1e-6)} == {1, 2, 3}
    assert check_whitening(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])], 2) == []
    empty = spark.createDataFrame([], VECTORS)
    assert E.whiten(empty).count() == 0


def test_whitening_of_large_numbers(spark):
    rng = np.random.default_rng(6)
    vectors = [(i, (rng.normal(size=3) * 1e12).tolist()) for i in range(60)] + [(99, [3e38, -3e38, 0.0])]
    df = spark.createDataFrame([(i, v, 0, "x", 3) for i, v in vectors], VECTORS)
    got = E.whiten(df).collect()
    assert len(got) == 61 * 3 and all(r.deviation is None for r in got) and max(r.identity_error for r in got) < 1e-4


def test_pieces_are_the_library_s(spark):
    rng = random.Random(8)
    alphabet = ["word", "Words", " ", "  ", "\n", "\t", "\r\n", " ", "\x1c", "'s", "don't", "İ", "ΣΑΣ", "ß", "é", "́", "漢字", "😀", "<|endoftext|>", "<|startoftext|>", "12", "x.y", "!?", "\x00", "ﬁ", "​"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(3000)]
    enc, tok = P.WordEncoder(PATH), Tokenizer.from_file(PATH)
    for t, e in zip(texts, tok.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(b"".join(enc.ids(t)), "<u4").tolist() == e.ids, t


@pytest.fixture(scope="module")
def packed(spark):
    rng = random.Random(9)
    texts = [None, "", "one", "word " * 5000, *["copy of a text " * 9] * 90, *(" ".join(rng.choices(["alpha", "beta", "gammas", "x"], k=rng.randint(0, 1500))) for _ in range(150))]
    texts += ["ab " * 2046 + "ab", "ab " * 2047 + "ab"]  # one piece exactly; one id more
    rows = [(None if i == 7 else 3 if i in (8, 9) else i, t, "l", "s", 1, "b") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part string, k string, length int, block string").repartition(6)
    pieces = P.cut_documents(df, PATH)
    return rows, P.pack(pieces)


def test_packing(spark, packed):
    rows, out = packed
    got = out.collect()
    tok = Tokenizer.from_file(PATH)
    want = collections.Counter()
    for i, t, *_ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        want.update((i, n, s, tuple(ids[s:s + 2048])) for n, s in enumerate(range(0, len(ids), 2048)))
    assert collections.Counter((r.doc_id, r.piece, r.start, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        assert r.length == len(r.ids) // 4
        by[r.sequence_id].append(r)
    for held in by.values():
        held.sort(key=lambda r: r.offset)
        assert [r.offset for r in held] == [0, *itertools.accumulate(r.length for r in held)][:-1]
        assert sum(r.length for r in held) <= 2048
    assert len(by) <= 1.02 * -(-sum(r.length for r in got) // 2048) + 1
    seqs = {r.sequence_id: r for r in P.sequences(out).collect()}
    assert {k: (r.length, r.n_documents, bytes(r.ids)) for k, r in seqs.items()} == {k: (sum(r.length for r in h), len(h), b"".join(r.ids for r in h)) for k, h in by.items()}


def one_by_one(counts, params):
    """The same rule on single pieces: how many sequences it opens."""
    cap = params.capacity()
    w = np.array(params.weights) / cap.astype(float) ** 2
    free = []
    for size in sorted(counts, reverse=True):
        item = np.array([size, 1, size * size])
        for _ in range(counts[size]):
            fits = [b for b in free if (b >= item).all()]
            if fits:
                score = [(w * (b - item) ** 2).sum() if params.rule == "norm" else -(w * b * item).sum() for b in fits]
                fits[int(np.argmin(score))] -= item
            else:
                free.append(cap - item)
    return len(free), sorted(tuple(b) for b in free)


@pytest.mark.parametrize("params", [P.PackParams(64), P.PackParams(64, documents=5), P.PackParams(64, attention=900), P.PackParams(64, 6, 1100, rule="dot"), P.PackParams(64, rule="dot")])
def test_classes_equal_single_pieces(params):
    rng = random.Random(3)
    for _ in range(15):
        counts = {s: rng.randint(1, 40) for s in rng.sample(range(1, 28), 12)} | {30: 1}
        places = P.best_fit(counts, params)
        held = collections.defaultdict(list)
        for size, n in counts.items():
            seq, off = places.find(np.full(n, size), np.arange(n))
            for s, o in zip(seq.tolist(), off.tolist(), strict=True):
                held[s].append((o, size))
        cap = params.capacity()
        for x in held.values():
            x.sort()
            assert [o for o, _ in x] == [0, *itertools.accumulate(s for _, s in x)][:-1]
            assert (np.array([sum(s for _, s in x), len(x), sum(s * s for _, s in x)]) <= cap).all()
        n, free = one_by_one(counts, params)
        assert len(held) == places.n_sequences == n
        mine = sorted(tuple(cap - [sum(s for _, s in x), len(x), sum(s * s for _, s in x)]) for x in held.values())
        assert mine == free


def test_packing_edges(spark):
    with pytest.raises(ValueError):
        P.best_fit({40: 1}, P.PackParams(64, attention=900))
    assert P.best_fit({}, P.PackParams()).n_sequences == 0
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert P.pack(P.cut_documents(empty, PATH)).count() == 0
    again = spark.createDataFrame([(1, "a b c")] * 3000, "doc_id long, text string").repartition(3)
    out = P.pack(P.cut_documents(again, PATH).select("doc_id", "length", "part", "k", F.crc32("ids").alias("crc")))
    assert out.select("sequence_id", "offset").distinct().count() == 3000 and out.select("sequence_id").distinct().count() == -(-3000 // 512)
    assert {r.crc for r in out.select("crc").distinct().collect()} == {zlib.crc32(np.array(Tokenizer.from_file(PATH).encode("a b c").ids + [0], "<u4").tobytes())}
