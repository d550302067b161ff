"""Quality rules, n-gram join, decontamination and repeats against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheaf.llm import decontamination, jaccard, quality, repeats
from sheaf.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
CORE = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOW = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
DOCS = "doc_id long, text string"


def nulls_last(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]


# --- quality ---------------------------------------------------------------------------


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(again)


def test_quality_counts_and_base_rule(spark):
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, "a"), (5, "a b c\na b c\n\na b c"), (5, "é " * 60), (None, "x | y\n" * 30)]
    rows += [(9, "w%d " * 70 % tuple(range(70)))] + documents(spark)
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "'own' AS score")
    trees = quality.fit_quality(df, spark.read.parquet(f"{SMALL}/labels.parquet"))
    with pytest.raises(ValueError):
        quality.score_documents(df, trees)
    got = quality.score_documents(df, trees, "q_").collect()
    assert len(got) == len(rows)
    for r in got:
        want = counts(r.text)
        assert (r.q_n_words, r.q_word_chars, r.q_n_symbols, r.q_n_dup_lines, r.q_n_repeat_words) == want
        assert r.q_base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r.q_kept == (not r.q_base_failed and r.q_score >= 0.5)
    assert quality.keep_quality(df, spark.read.parquet(f"{SMALL}/labels.parquet")).columns == df.columns


def test_quality_on_documents_it_was_not_fitted_on(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    half = labels.where("doc_id % 2 = 0")
    got = quality.score_documents(docs.select("doc_id", "text"), quality.fit_quality(docs, half))
    rest = got.join(labels.where("doc_id % 2 = 1").select("doc_id", "quality"), "doc_id").where("NOT base_failed").collect()
    assert np.mean([(r.score >= 0.5) == (r.quality == 1) for r in rest]) > 0.97


def test_quality_without_labels_keeps_all_but_the_base_rule(spark):
    df = spark.createDataFrame([(1, "w%d " * 70 % tuple(range(70))), (2, "a")], DOCS)
    none = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, quality int")
    assert [r.doc_id for r in quality.keep_quality(df, none).collect()] == [1]
    assert quality.keep_quality(df.where("1 = 0"), none).count() == 0


# --- n-gram Jaccard join -----------------------------------------------------------------


def grams(text, n):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def linked(rows, n, percent):
    sets, parent, holders = [grams(t, n) for _, t in rows], list(range(len(rows))), {}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        for j, k in Counter(j for g in s for j in holders[g] if j < i).items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if sets[i] and d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [(d, len(sets[i]), least.get(root(i), d) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def family(rng, base, copies, rate, vocabulary):
    return [" ".join(rng.choice(vocabulary) if rng.random() < rate else w for w in base) for _ in range(copies)]


def texts(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    out = []
    for length in (5, 8, 20, 60, 200):
        for rate in (0.002, 0.01, 0.03):
            out += family(rng, [rng.choice(vocabulary) for _ in range(length)], 8, rate, vocabulary)
    return rng, vocabulary, out


def join(spark, rows, n, percent):
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    return nulls_last(map(tuple, jaccard.link_components(df, jaccard.Rule(n, percent)).drop("set").collect()))


@pytest.mark.parametrize("n, percent", [(4, 85), (5, 80)])
def test_components(spark, n, percent):
    _, _, found = texts(n)
    found += ["", "  ", None, "A b", "a B", "a b c", "a b c d", "a b c d", "x", "X"]
    rows = list(enumerate(found)) + [(3, found[3]), (3, found[9]), (None, found[40]), (None, "q q q"), (None, None)]
    assert join(spark, rows, n, percent) == nulls_last(linked(rows, n, percent))


def test_large_regions_are_cut_by_pivots(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "REGION", 6000)
    monkeypatch.setattr(jaccard, "LEAF", 8)
    rng, vocabulary, _ = texts(1)
    base = [rng.choice(vocabulary) for _ in range(120)]
    found = family(rng, base, 60, 0.015, vocabulary) + family(rng, base, 40, 0.05, vocabulary)
    found += family(rng, found[-1].split(), 30, 0.01, vocabulary)
    rows = list(enumerate(found))
    assert join(spark, rows, 4, 85) == nulls_last(linked(rows, 4, 85))


def test_regions_that_pivots_cannot_separate(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "REGION", 6000)
    monkeypatch.setattr(jaccard, "LEAF", 8)
    weights = []

    def join_regions(rows, rule, plain=jaccard.join_regions):
        weights.extend(r[1] for r in rows.groupBy("region").agg(F.sum(F.octet_length("grams") / 8)).collect())
        return plain(rows, rule)

    monkeypatch.setattr(jaccard, "join_regions", join_regions)
    rng, vocabulary, _ = texts(2)
    form = [rng.choice(vocabulary) for _ in range(100)]
    found = [" ".join(form[:50] + [rng.choice(vocabulary) for _ in range(13)] + form[50:]) for _ in range(150)]
    found += [" ".join(w.split()[:-k]) for k, w in enumerate(found[::6], 1) if k < 12]
    rows = list(enumerate(found))
    assert join(spark, rows, 4, 85) == nulls_last(linked(rows, 4, 85))
    assert 0 < max(weights) <= 6000 and sum(weights) < 12 * 161 * 110


def test_region_finds_all_components():
    rng, vocabulary, found = texts(7)
    sets = [{hash(g) & (2**63 - 1) for g in grams(t, 4)} for t in found]
    rule = jaccard.Rule(4, 85)
    region = jaccard.Region(np.arange(len(sets)), [np.array(sorted(s), np.uint64) for s in sets], rule)
    region.solve(np.arange(len(sets)))
    want = linked(list(enumerate(found)), 4, 85)
    groups = {}
    for i, r in enumerate(region.roots(np.arange(len(sets))).tolist()):
        groups.setdefault(r, []).append(i)
    assert sorted(map(min, groups.values())) == sorted({c for _, _, c in want})


def test_linked_sets_share_a_class():
    """Whatever is taken for common, sets that link share a class hash."""
    rng = np.random.default_rng(2)
    rule = jaccard.Rule(4, 85)
    for size in [4, 5, 6, 7, 9, 12, 20, 50, 130, 400] * 4:
        one = rng.integers(0, 1 << 62, size).astype(np.uint64)
        swap = rng.integers(0, rule.differ(size) // 2 + 1)
        two = np.unique(np.concatenate([one[swap:], rng.integers(0, 1 << 62, swap).astype(np.uint64)]))
        one = np.unique(one)
        shared = len(np.intersect1d(one, two))
        if not rule.linked(shared, len(one), len(two)) or shared == max(len(one), len(two)):
            continue
        for common in (np.empty(0, np.uint64), np.sort(one[: size // 2]), one, np.sort(rng.choice(one, size // 4))):
            a, b = (jaccard.class_hashes(s, rule, common) for s in (one, two))
            assert np.intersect1d(a, b).size


def test_keep_one(spark):
    rows = [(1, "a b c d e f", "x"), (2, "A B c d e f", "y"), (2, "A B c d e f", "y"), (3, "", "z"), (4, None, "z"), (5, "q", "n"), (5, "q", "n")]
    df = spark.createDataFrame(rows, DOCS + ", source string").selectExpr("*", "1 AS set", "2 AS n_shingles")
    got = jaccard.keep_one(df, jaccard.Rule(5, 80))
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == [1, 3, 4, 5]
    assert jaccard.keep_one(df.where("1 = 0"), jaccard.Rule(5, 80)).count() == 0


def test_join_query(spark):
    assert nulls_last(map(tuple, QUERIES["op4_jaccard_join"](spark, SMALL).collect())) == nulls_last(linked(documents(spark), 4, 85))


# --- decontamination -----------------------------------------------------------------------


def leaks(docs, items, n):
    windows = {}
    for name, text in items:
        w = CORE.findall((text or "").translate(LOW))
        for k in range(max(1, len(w) - n + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + n]), []).append(str(name))
    out = []
    for _, text in docs:
        w, hit, found = CORE.findall((text or "").translate(LOW)), set(), set()
        for size in {len(k) for k in windows}:
            for k in range(len(w) - size + 1):
                names = windows.get(tuple(w[k : k + size]))
                if names:
                    hit.update(range(k, k + size))
                    found.update(names)
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((len(w), len(hit), len(found), digest))
    return out


@pytest.mark.parametrize("block", [1 << 24, 200])
def test_decontamination(spark, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK", block)
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").limit(12).collect()]
    items += [(900, "The"), (901, "of the"), (902, ""), (903, None), (904, "..."), (905, items[0][1])]
    rows = documents(spark) + [(None, None), (2000, ""), (2001, "the!THE"), (2002, items[0][1]), (2002, items[0][1])]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS n_words")
    bench = spark.createDataFrame(items, "item_id long, text string")
    with pytest.raises(ValueError):
        decontamination.find_contamination(df, bench, 10)
    got = decontamination.find_contamination(df, bench, 10, "x_").collect()
    want = leaks([(r.doc_id, r.text) for r in got], items, 10)
    assert [(r.x_n_words, r.x_n_hit, r.x_n_items, r.x_items_sha256) for r in got] == want
    clean = decontamination.decontaminate(df, bench, 10)
    assert clean.columns == df.columns
    assert clean.count() == sum(w[1] == 0 for w in want)
    longest = max((m for r in got if r.doc_id == 2002 for m in r.x_matches), key=lambda m: m.n_words)
    assert longest.n_words == len(CORE.findall(items[0][1])) and longest.doc_word == 0


def test_empty_benchmark_and_documents(spark):
    df = spark.createDataFrame([(1, "a b")], DOCS)
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in decontamination.find_contamination(df, none).collect()] == [0]
    assert decontamination.decontaminate(df.where("1 = 0"), none).count() == 0


# --- repeats -------------------------------------------------------------------------------


def removed(rows, span):
    first = {}
    for d, t in sorted(((d if d is not None else 1 << 62, t) for d, t in rows), key=lambda r: r[0]):
        data = (t or "").encode()
        for i in range(len(data) - span + 1):
            first.setdefault(data[i : i + span], d)
    out = []
    for d, t in rows:
        data, key = (t or "").encode(), d if d is not None else 1 << 62
        gone = bytearray(len(data))
        for i in range(len(data) - span + 1):
            if first[data[i : i + span]] < key:
                gone[i : i + span] = b"\1" * span
        left = bytes(x for x, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(data)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(data), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return nulls_last(out)


def pieces():
    rng = random.Random(3)
    w = ["a", "bb", "ccc", "the", "é", "of", "and to"] + [f"v{i}" for i in range(40)]
    parts = [" ".join(rng.choice(w) for _ in range(rng.randint(0, 150))) for _ in range(40)]
    rows = []
    for i in range(100):
        text = ""
        for _ in range(rng.randint(0, 4)):
            part = rng.choice(parts)
            at = rng.randint(0, max(0, len(part) - 1))
            text += part[at : at + rng.randint(1, 400)]
        rows.append((i, text))
    rows += [(200 + i, rng.choice(parts)) for i in range(20)] + [(5, parts[1]), (5, parts[1]), (5, parts[2])]
    rows += [(None, parts[1]), (None, parts[3]), (None, None), (300, ""), (301, None), (302, "ab" * 800), (303, "ab" * 1001)]
    return rows + [(304, "x" * 49), (305, "x" * 50), (306, "x" * 51)]


@pytest.mark.parametrize("small", [False, True])
def test_repeats(spark, monkeypatch, small):
    if small:
        for name, value in (("HOT", 3), ("FIRST_ROUND", 20000), ("MERGE", 8000), ("SHARD", 3000), ("LONGEST", 100)):
            monkeypatch.setattr(repeats, name, value)
    rows = pieces()
    df = spark.createDataFrame(rows, DOCS).repartition(4).selectExpr("*", "1 AS tie", "2 AS cuts")
    got = repeats.remove_repeats(df, 50, with_text=True).collect()
    assert nulls_last((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == removed(rows, 50)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)


def test_repeats_of_nothing(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], DOCS)).collect() == []


def test_repeats_query(spark):
    got = nulls_last(map(tuple, QUERIES["op2_repeats"](spark, SMALL).collect()))
    assert got == removed(documents(spark), 50)


def test_rows_without_an_id_meet_their_own_text_only(spark):
    words = [" ".join(f"w{i}x{k}" for k in range(30)) for i in range(120)]
    rows = [(None, w) for w in words] + [(None, w + " more") for w in words] + [(None, words[0])] * 40
    df = spark.createDataFrame(rows, DOCS)
    rule = jaccard.Rule(4, 85)
    sets = jaccard.with_sets(jaccard.named(df), rule)
    members = sets.groupBy("set").agg(F.min(F.struct("doc_id", "_h1", "_h2")).alias("_rep")).withColumn("region", F.lit("r"))
    joined = jaccard.named(df).join(members, (F.col("_h1") == F.col("_rep._h1")) & (F.col("_h2") == F.col("_rep._h2")))
    assert joined.count() == len(rows)
    assert jaccard.member_sets(df, members, rule).count() == 240
    assert nulls_last(map(tuple, jaccard.link_components(df, rule).drop("set").collect())) == nulls_last(linked(rows, 4, 85))


def test_keep_one_of_rows_that_share_an_id(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(1, text, "a"), (1, text, "a"), (1, text.replace(" ", "  "), "b"), (1, "other words only here", "c"), (2, text + " x", "d")]
    rows += [(3, None, "e"), (3, " \n", "f"), (3, "", "g"), (None, text, "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _h1 string").select("_h1", "text", "doc_id")
    got = jaccard.keep_one(df, jaccard.Rule(5, 80))
    assert got.columns == df.columns
    kept = sorted((r.doc_id, (r.text or "").split(), r["_h1"]) for r in got.collect())
    assert [k[0] for k in kept] == [1, 1, 3, 3, 3]
    assert [k[2] for k in kept if k[0] == 3] == ["e", "f", "g"]
    assert {tuple(k[1]) for k in kept if k[0] == 1} == {tuple(text.split()), ("other", "words", "only", "here")}
