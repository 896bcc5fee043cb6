"""Near-dedup stage: classes by exact similarity of five-word shingles."""

import random

import corpus_pipeline
from meterloom.llm import near_text
from test_llm_dedup import table


def brute_classes(texts):
    """Class number of each text, by brute-force Jaccard of five-word shingles."""
    sets = []
    for t in texts:
        words = t.lower().split()
        sets.append({tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))})
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_stage_equals_brute_force_jaccard(spark):
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = []
    for size in (6, 12, 20, 40, 80, 150, 300) * 3:
        base = rng.choices(vocabulary, k=size)
        for copy in range(7):  # 0 to 6 edits, so similarities on both sides of 0.8
            text = list(base)
            for at in rng.sample(range(size), min(copy, size)) if size < 100 else range(copy * size // 90):
                text[at] = rng.choice(vocabulary)
            texts.append(" ".join(text))
    texts = list(dict.fromkeys(texts))
    rng.shuffle(texts)
    root = brute_classes(texts)
    assert len(set(root)) < len(texts)
    got = corpus_pipeline.one_of_near_texts(spark, table(spark, list(enumerate(texts))), "")
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(root))


def test_group_that_no_leader_holds_together(spark):
    """Copies of one text with edits of their own: most pairs are below 0.8, the text itself links them all."""
    rng = random.Random(2)
    base = [f"w{k}" for k in range(300)]
    texts = [" ".join(base)]
    for k in range(60):
        text = list(base)
        for at in rng.sample(range(10, 290), 6):
            text[at] = f"x{k}_{at}"
        texts.append(" ".join(text))
    root = brute_classes(texts)
    got = near_text.one_per_class(table(spark, list(enumerate(texts))))
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(root)) and len(set(root)) < 30


def test_rows_without_identifier_and_clashing_ones(spark):
    rows = [(None, "a b c d e f"), (None, "A b c d e f"), (1, "p q r s t u"), (1, "other words of the same name"), (0, "other words of the same name"), (None, None), (None, ""), (3, " ")]
    got = near_text.one_per_class(table(spark, rows)).collect()
    assert sorted(((r["doc_id"], (r["text"] or "").lower().strip()) for r in got), key=repr) == [(0, "other words of the same name"), (1, "p q r s t u"), (3, ""), (None, "a b c d e f")]


def test_columns_that_the_stage_uses_itself(spark):
    names = ["key", "owner", "node", "hub", "root", "id", "t1", "size"]
    rows = [(i, t, *[f"{c}{i}" for c in names]) for i, t in enumerate(["a b c d e f", "A b c d e f", "something else altogether here", None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    got = near_text.one_per_class(docs)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == [rows[0], rows[2], rows[3]]


def test_large_group_below_the_threshold(spark):
    """Texts that share most of a template, but less than a link asks for, and some that do link."""
    rng = random.Random(6)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for k in range(700):
        text = list(base)
        for at in rng.sample(range(3, 117), 3 if k % 9 else 1):
            text[at] = f"x{k % 600}_{at}"
        texts.append(" ".join(text))
    texts = list(dict.fromkeys(texts))
    root = brute_classes(texts)
    got = near_text.one_per_class(table(spark, list(enumerate(texts))))
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(root)) and 20 < len(set(root)) < 700
