"""Source audit against counting every term of every pair."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from sheaf.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOW = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
DOCS = "doc_id long, text string, lang string, source string"


def brute(rows, documents, top):
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        words = TERM.findall((text or "").translate(LOW))
        groups[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = []
    for lang, held in docs.items():
        kept = [w for w, n in held.items() if n >= documents]
        own = {s: c for (g, s), c in groups.items() if g == lang}
        whole = Counter()
        for c in own.values():
            whole.update(c)

        def shares(c, kept=kept):
            below = sum(c[w] for w in kept) + 5 * len(kept)
            return {w: 1 + 10**9 * (c[w] + 5) // below for w in kept}

        p, q = {s: shares(c) for s, c in own.items()}, shares(whole)
        for s in own:
            pairs = [(o, sum(abs(p[s][w] - p[o][w]) for w in kept)) for o in own if o != s]
            terms = [(w, p[s][w] - q[w]) for w in kept if own[s][w] and p[s][w] > q[w]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                found = found if part == "pair" else found[:top]
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(found)]
    return sorted(out)


def corpus(seed, sources, n):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "abcdeÉß" for b in ("", "x", "Yz", "ü")]
    rows = []
    for i in range(n):
        source = rng.choice(sources)
        weights = [1 + (hash((str(source), w)) + seed) % 7 for w in range(len(vocabulary))]
        text = " ".join(rng.choices(vocabulary, weights, k=rng.randint(0, 12)))
        rows.append((i, text, rng.choice(["de", "de", "en"]), source))
    return rows


@pytest.mark.parametrize("documents, top", [(1, 50), (8, 3)])
def test_pairs_and_terms_against_brute_force(spark, documents, top):
    rows = corpus(documents, ["a", "b", "c", "é", None, "a"], 150)
    rows += [(900, None, "fr", "x"), (901, "", "fr", "y"), (902, "7 + 7", None, None), (902, "7 + 7", None, None)]
    rows += [(903, "only " * 40, "it", "one"), (904, "w" * 1_100_000, "it", "two"), (905, None, None, "z")]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS rank", "'x' AS item", "2 AS value", "3 AS part")
    got = [tuple(r) for r in divergence.audit_sources(df, documents, top).collect()]
    assert sorted(got) == brute(rows, documents, top)
    assert ("fr", "x", "pair", "y", 0, 1) in got


def test_empty_table(spark):
    assert divergence.audit_sources(spark.createDataFrame([], DOCS)).count() == 0


def test_slices_and_blocks_change_nothing(spark, monkeypatch):
    rows = corpus(5, [f"s{k}" for k in range(9)], 200)
    df = spark.createDataFrame(rows, DOCS)
    monkeypatch.setattr(divergence, "SLICE_COUNTS", 20)
    want = brute(rows, 2, 5)
    assert sorted(tuple(r) for r in divergence.audit_sources(df, 2, 5).collect()) == want


def test_run_columns_hold_the_counts(monkeypatch):
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 3, (60, 300)) * (rng.random((60, 300)) < 0.2)
    counts = counts[counts.any(axis=1)]
    many = rng.integers(1, 5, len(counts))
    held = [[{"source": f"s{c:03}", "n": int(n)} for c, n in enumerate(row) if n] for row in counts]
    kind = pa.list_(pa.struct([("source", pa.string()), ("n", pa.int64())]))
    table = pa.table({"held": pa.array(held, kind), "terms": many})
    sources = pa.array([f"s{c:03}" for c in range(300)])
    totals = (counts * many[:, None]).sum(axis=0)
    terms = int(many.sum())
    monkeypatch.setattr(divergence, "BLOCK_SOURCES", 64)
    columns, length = divergence._columns(table, sources, totals, terms)
    assert length == terms
    groups = pa.table(
        {"lang": ["x"] * 300, "source": sources, "total": totals, "terms": [terms] * 300, "slice": [0] * 300, "block": [3] * 300}
    )
    got = divergence._pairs(table, groups).to_pylist()
    assert {int(r["left"][1:]) for r in got} == set(range(192, 256))
    p = np.stack([[1 + 10**9 * (int(c) + 5) // (int(totals[k]) + 5 * terms) for c in counts[:, k]] for k in range(300)])
    for r in got[:: max(1, len(got) // 400)]:
        a, b = int(r["left"][1:]), int(r["right"][1:])
        assert r["value"] == int((abs(p[a] - p[b]) * many).sum())
    # equal counts lie side by side: the fullest column has a run a value
    fullest = int((counts > 0).sum(axis=0).argmax())
    assert len(columns[fullest][0]) <= 3


def test_shares_are_exact(spark):
    from pyspark.sql import functions as F

    cases = [(0, 0, 1), (10**13, 10**13, 7), (7 * 10**14, 9 * 10**14, 10**9), (3, 11, 4)]
    counts = [1 + 10**9 * (c + 5) // (n + 5 * v) for c, n, v in cases]
    assert [int(divergence.shares(np.array([c]), n, v)[0]) for c, n, v in cases] == counts
    df = spark.createDataFrame(cases, "c long, n long, v long")
    assert [r[0] for r in df.select(divergence.share(F.col("c"), F.col("n"), F.col("v"))).collect()] == counts
