"""Min-max hashing against brute-force Jaccard on two-word shingles."""

import random

import numpy as np
from meterloom.llm import minmax, set_links
from meterloom.llm.registry import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, node long, hub long, member long, key string, t1 long, size long, bucket long, id long, low long, root long, part int, bands string"


def table(spark, rows):
    """Documents with extra columns whose names the operator uses itself."""
    return spark.createDataFrame([(i, t, 1, 1, 1, "k", 1, 1, 1, 1, 1, 1, 1, "b") for i, t in rows], SCHEMA)


def shingles(text, words=2):
    tokens = (text or "").encode().lower().split()
    return {tuple(tokens[k:k + words]) for k in range(max(1, len(tokens) - words + 1))} if tokens else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if root[i] != root[j] and a and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    names = {}
    for (i, _), r in zip(rows, root):
        names[r] = min((x for x in (names.get(r), i) if x is not None), default=None)
    return [(i, len(s), names[r], i == names[r]) for (i, _), s, r in zip(rows, sets, root)]


def query(spark, rows, tmp):
    table(spark, rows).write.parquet(f"{tmp}/documents.parquet")
    return sorted(map(repr, map(tuple, QUERIES["op11_minmax_near_dedup"](spark, str(tmp)).collect())))


def test_equals_brute_force(spark, tmp_path):
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(300)]
    texts = []
    for size in (1, 2, 3, 6, 12, 20, 40, 80, 150, 300) * 3:
        base = rng.choices(vocabulary, k=size)
        for copy in range(8):  # edits that bring similarities on both sides of 0.8
            text = list(base)
            for at in rng.sample(range(size), min(copy, size)) if size < 100 else range(copy * size // 60):
                text[at] = rng.choice(vocabulary)
            texts.append(" ".join(text))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert query(spark, rows, tmp_path) == sorted(map(repr, brute(rows)))


def test_group_that_no_hub_holds_together(spark, tmp_path):
    """Copies of one text with edits of their own: most pairs are below 0.8, the text itself links them all."""
    rng = random.Random(2)
    base = [f"w{k}" for k in range(300)]
    texts = [" ".join(base)]
    for k in range(200):
        text = list(base)
        for at in rng.sample(range(10, 290), 20):
            text[at] = f"x{k}_{at}"
        texts.append(" ".join(text))
    rows = list(enumerate(texts[::-1]))
    assert query(spark, rows, tmp_path) == sorted(map(repr, brute(rows)))


def test_odd_rows(spark, tmp_path):
    long = " ".join(f"v{k % 9001}" for k in range(300_000))
    rows = [(None, "a b c d e f"), (None, "A  b c\td e\nf"), (7, "a b c d e f"), (1, "p q"), (1, "other words"), (0, "other words"), (None, None), (3, ""), (4, " \n"),
            (5, "one"), (6, "ONE"), (6, "ONE"), (8, long), (9, long + " end"), (10, "Ä b"), (11, "ä b"), (None, "alone"), (12, "p q p q"), (13, "q p q")]
    assert query(spark, rows, tmp_path) == sorted(map(repr, brute(rows)))


def test_empty_table(spark, tmp_path):
    assert query(spark, [], tmp_path) == []


def test_both_kinds_of_slots_are_unbiased():
    rng = np.random.default_rng(1)
    factors, agree = minmax.permutations(400, 10), []
    for _ in range(20):
        whole = rng.integers(0, 1 << 63, 500, np.uint64)
        a, b = (minmax.signature(x, factors) for x in (whole[:450], whole[50:]))
        agree.append((a == b).reshape(2, -1).mean(1))
    assert len(factors) == 2000 and np.abs(np.mean(agree, 0) - 0.8).max() < 0.01


def test_bands_find_pairs_at_the_threshold():
    rng, factors, found = np.random.default_rng(3), minmax.permutations(), 0
    for _ in range(1000):
        whole = rng.integers(0, 1 << 63, 100, np.uint64)
        found += (minmax.buckets(minmax.signature(whole[:90], factors)) == minmax.buckets(minmax.signature(whole[10:], factors))).any()
    assert found == 1000


def test_shingles_are_words_and_runs():
    sets = set_links.Shingles(5)
    assert (sets(b"a b c d e f") == sets(b"A  b c d e\nf")).all() and len(sets(b"a b c d e f")) == 2
    assert len(sets(b"a b")) == 1 and len(sets(b"  ")) == 0 and sets(b"a b") != sets(b"a c")


def test_equals_sql(spark):
    import os
    import sys

    import corpus_pipeline

    sys.path.insert(0, os.path.join(os.path.dirname(corpus_pipeline.__file__), "tools"))
    from oracle_check import connect, rows_of

    sf = "/root/testdata/sf0.001"
    df = QUERIES["op11_minmax_near_dedup"](spark, sf)
    res = connect(sf).execute(ORACLES["op11_minmax_near_dedup"])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in res.description], res.fetchall())
