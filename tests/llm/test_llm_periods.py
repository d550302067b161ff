"""Periodic runs against trying every period."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from sheaf.llm import periods
from sheaf.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_runs(w):
    """(start, length, period) of every run, by start, then period."""
    seen = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                seen.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in seen.items()), key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def word_lists(rng):
    """Words with many near and nested periods."""
    kind = rng.randrange(6)
    if kind == 0:
        out = []
        while len(out) < 150:
            root = [rng.randrange(3) for _ in range(rng.randint(1, 50))]
            root = root[: rng.randint(1, 4)] * rng.randint(1, 20) + root[: rng.randint(0, 9)]
            out += (root * rng.randint(1, 8))[: rng.randint(1, 300)]
        return out
    if kind == 1:
        a, b = [0], [0, 1]
        for _ in range(rng.randint(3, 11)):
            a, b = b, b + a
        return b[:400]
    if kind == 2:
        return [bin(i).count("1") % 2 for i in range(300)]
    if kind == 3:
        return [0] * rng.randint(0, 200)
    if kind == 4:
        return [rng.randrange(2) for _ in range(rng.randint(0, 400))]
    root = [rng.randrange(2) for _ in range(rng.randint(1, 40))] + [0] * rng.randint(0, 40)
    return (root * 6)[: rng.randint(1, 350)]


@pytest.mark.parametrize("seed", range(4))
def test_all_runs_are_found(seed):
    rng, total = random.Random(seed), 0
    for _ in range(40):
        docs = [word_lists(rng) for _ in range(rng.randint(1, 4))]
        owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        start, end, period = periods.find_runs(np.array([x for d in docs for x in d], np.int64), owner)
        before = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
        whose = owner[start] if len(start) else start
        for k, d in enumerate(docs):
            got = [(s - before[k], e - s, p) for s, e, p, o in zip(start, end, period, whose, strict=True) if o == k]
            want = brute_runs(d)
            total += len(want)
            assert sorted(got) == sorted(want)
    assert total > 50


def test_wavelet_tree_counts_and_orders():
    rng = np.random.default_rng(3)
    values = rng.permutation(1000)
    tree = periods.WaveletTree(values)
    low = rng.integers(0, 1000, 300)
    high = np.minimum(low + rng.integers(1, 400, 300), 1000)
    bound = rng.integers(0, 1300, 300)
    below = tree.below(low, high, bound)
    assert below.tolist() == [int((values[a:b] < x).sum()) for a, b, x in zip(low, high, bound, strict=True)]
    rank = (high - low) // 2
    assert tree.smallest(low, high, rank).tolist() == [int(np.sort(values[a:b])[r]) for a, b, r in zip(low, high, rank, strict=True)]


def test_collapsed_texts_and_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "x " * 23), (5, "x " * 24), (5, "x " * 24), (None, "a\nb\t" * 12)]
    rows += [(6, "é ü " * 20 + "tail"), (7, "a b c d e f g h i " * 3), (8, "a" * 1_200_000 + " b" * 30)]
    rows += [(9, " ".join(f"w{i % 700}" for i in range(2100))), (10, " ".join(f"w{i % 700}" for i in range(2099)))]
    rows += [(11, "go " * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'own' AS runs")
    with pytest.raises(ValueError):
        periods.collapse_runs(df)
    got = periods.collapse_runs(df, "p_").collect()
    assert len(got) == len(rows)
    for r in got:
        w = WORD.findall(r.text or "")
        if r.doc_id == 11:
            assert [tuple(x) for x in r.p_runs] == [(0, 200_000, 1)] and r.p_collapsed == "go"
            continue
        assert r.p_n_words == len(w) and r.runs == "own"
        assert [tuple(x) for x in r.p_runs] == brute_runs(w)
        assert r.p_collapsed == collapsed(w, brute_runs(w))
    assert periods.collapse_runs(df.where("1 = 0"), "p_").count() == 0


def test_query_against_brute_force(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = QUERIES["op11_periods"](spark, SMALL).collect()
    assert len(got) == len(rows)
    planted = 0
    for r in got:
        w = WORD.findall(rows[r.doc_id] or "")
        h, n = zlib.crc32(str(r.doc_id).encode()), len(w)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(w)
        planted += bool(runs)
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period) == (best or (None, None, None))
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert r.runs_sha256 == sha("".join(f"{s},{m},{q}\n" for s, m, q in runs))
        assert r.collapsed_sha256 == sha(collapsed(w, runs))
    assert planted > 10
