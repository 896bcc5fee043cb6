"""Spelling variants against a brute-force version."""

import random
import re
import zlib
from collections import Counter

import numpy as np
from meterloom.llm import spelling
from meterloom.llm.registry import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, word string, n long, w long, id long, part int, at long, nodes string, p long, s long, r long, form string, leads int"


def table(spark, rows):
    """Documents with extra columns whose names the operator uses itself."""
    return spark.createDataFrame([(i, t, "w", 1, 1, 1, 1, 1, "n", 1, 1, 1, "f", 1) for i, t in rows], SCHEMA)


def near(a, b):
    """Whether one inserted, deleted or replaced code point makes one of two words the other."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + 1:] == b[k + 1:] if len(a) == len(b) else a[k:] == b[k + 1:]


def counted(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            code = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if code % 31 == 0:
                run = run[:code % len(run)] + run[code % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def brute(rows):
    words = counted(rows)
    beside = {w: [v for v in words if abs(len(w) - len(v)) < 2 and near(w, v)] for w in words}
    best = {w: min(vs, key=lambda v: (-words[v], v)) for w, vs in beside.items() if vs}
    form = {w: v for w, v in best.items() if words[v] >= 10 * words[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return [(w, form.get(w), root(w), n, len(beside[w]), words[form[w]] if w in form else None) for w, n in words.items()]


def query(spark, rows, tmp):
    table(spark, rows).write.parquet(f"{tmp}/documents.parquet")
    return sorted(map(repr, map(tuple, QUERIES["op13_spelling_variants"](spark, str(tmp)).collect())))


def texts(seed, count=400):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcéÿ") for _ in range(rng.randint(7, 9))) for _ in range(60)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "abababab", "Àbababab"]
    weights = [rng.choice((1, 2, 30, 400)) for _ in stems]
    out = []
    for i in range(count):
        words = rng.choices(stems, weights, k=40)
        for k in range(0, 40, 7):
            w, at = words[k], rng.randrange(len(words[k]))
            words[k] = rng.choice([w[:at] + w[at + 1:], w[:at] + rng.choice("abz") + w[at:], w[:at] + rng.choice("abz") + w[at + 1:], w.upper()])
        out.append((i, rng.choice([" ", ", ", "1", "\n"]).join(words)))
    chain = [("chainaaa", 800), ("chainaab", 40), ("chainabb", 2)]
    return out + [(1000 * k + i, f"{word} " * 2) for k, (word, n) in enumerate(chain, 1) for i in range(n // 2)]


def test_equals_brute_force(spark, tmp_path):
    rows = texts(3)
    want = brute(rows)
    assert any(w[1] and w[1] != w[2] for w in want)  # chains of forms
    assert query(spark, rows, tmp_path) == sorted(map(repr, want))


def test_odd_rows(spark, tmp_path):
    long, other = "xy" * 50_000, "xy" * 25_000 + "z" + "xy" * 25_000
    rows = [(None, None), (None, "letters letters"), (1, ""), (2, f"{long} {long} {other} {other}"), (3, "Straßen straßen STRAßEN Štraßen ×÷×÷×÷× ×÷×÷×÷×"), (4, "letterz letterz"), (4, "letterz letterz"),
            *[(10 + k, "letters aletters") for k in range(40)]]
    assert query(spark, rows, tmp_path) == sorted(map(repr, brute(rows)))


def test_empty_table(spark, tmp_path):
    assert query(spark, [], tmp_path) == []


def test_nodes_number_prefixes(spark):
    """Over many ranges, two words pass the same node exactly where they have the same prefix."""
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(500)})
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = spelling.trie_nodes(spark.createDataFrame([(w,) for w in words], "word string"), "word").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len({r["part"] for r in got}) > 10 and [r["word"] for r in sorted(got, key=lambda r: (r["part"], r["at"]))] == words
    of_prefix, of_node = {}, {}
    for r in got:
        assert len(r["nodes"]) == len(r["word"]) + 1 and len(r["leads"]) == len(r["word"])
        for k, node in enumerate(r["nodes"]):
            assert of_prefix.setdefault(r["word"][:k], node) == node and of_node.setdefault(node, r["word"][:k]) == r["word"][:k]


def test_nodes_of_sorted_words():
    nodes = spelling.numbered(["abc", "abd", "b"])
    assert [n.tolist() for n in nodes] == [[0, 1, 2, 3], [0, 1, 2, 4], [0, 5]]
    assert spelling.shared("abc", "abd") == 2 and spelling.shared("", "x") == 0 and np.all(nodes[0][:3] == nodes[1][:3])


def test_equals_sql(spark):
    import os
    import sys

    import corpus_pipeline

    sys.path.insert(0, os.path.join(os.path.dirname(corpus_pipeline.__file__), "tools"))
    from oracle_check import connect, rows_of

    sf = "/root/testdata/sf0.001"
    df = QUERIES["op13_spelling_variants"](spark, sf)
    res = connect(sf).execute(ORACLES["op13_spelling_variants"])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in res.description], res.fetchall())
