import hashlib
import random

import numpy as np
import pytest
import xxhash
from meterloom.llm import common, exact_dedup, simhash

CLASHING = "doc_id long, text string, lang string, source string, n_chars long, id long, fp long, n long, key string, length long, sha string, root long, words string"
LONG = "word " * 60_000


def table(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", 0, 7, 7, 7, "k", 7, "x", 7, "w") for i, t in rows], CLASHING)


ODD = [(1, "Same Text"), (2, "same text"), (3, "SAME TEXT"), (4, None), (5, ""), (None, "same text"), (6, "Ä"), (7, "ä"), (8, LONG),
       (9, LONG.upper()), (9, LONG.upper()), (None, "alone"), (None, "alone"), (10, "same tex"), (11, "same text!")]


def fold(text):
    return (text or "").encode().lower()


@pytest.mark.parametrize("trie_bytes, gather_bytes", [(1 << 20, 1 << 20), (9_000, 2_000)])
def test_owners_equal_brute_force(spark, trie_bytes, gather_bytes):
    rng = random.Random(4)
    rows = ODD + [(100 + k, "".join(rng.choice("ab") for _ in range(rng.randint(0, 6)))) for k in range(300)]
    for keep, best in (("smallest", min), ("largest", max)):
        got = exact_dedup.exact_duplicates(table(spark, rows), keep=keep, trie_bytes=trie_bytes, gather_bytes=gather_bytes).collect()
        groups = {}
        for i, t in rows:
            groups.setdefault(fold(t), []).append(i)
        want = []
        for i, t in rows:
            ids = groups[fold(t)]
            named = [x for x in ids if x is not None]
            owner = best(named) if named else None
            want.append((i, owner, len(ids), i == owner, hashlib.sha256(fold(t)).hexdigest()))
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_trie_gives_up_subtrees_whole():
    trie, texts = exact_dedup.Trie(), [b"aa", b"aab", b"ab", b"b", b"", b"aab"]
    for k, t in enumerate(texts):
        trie.insert(t, 1, k, k)
    assert {t: tuple(o) for t, o in trie.terminals()} == {b"aa": (1, 0, 0), b"aab": (2, 1, 5), b"ab": (1, 2, 2), b"b": (1, 3, 3), b"": (1, 4, 4)}
    first, gone = trie.give_up()
    assert first == ord("a") and {t for t, _ in gone} == {b"aa", b"aab", b"ab"} and {t for t, _ in trie.terminals()} == {b"b", b""}


def test_empty_tables(spark):
    none = table(spark, [])
    assert exact_dedup.exact_duplicates(none).count() == 0
    assert simhash.near_classes(none).count() == 0


def slow_fingerprint(text, words):
    tokens = text.lower().split()
    shingles = [b" ".join(tokens[k:k + words]) for k in range(max(1, len(tokens) - words + 1))] if tokens else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_equal_their_definition(spark):
    texts = ["", " \t\x0b", "One", "one two", "one two three", "a b c d a b c d", "ÄÖ ü x", LONG[:3000]]
    for t in texts:
        assert simhash.fingerprint(t.encode(), 3) == slow_fingerprint(t.encode(), 3)
    got = spark.range(1).selectExpr("xxhash64('a b c')").first()[0]
    assert got % 2**64 == slow_fingerprint(b"a b c", 3)


@pytest.mark.parametrize("bits", [3, 7])
def test_forest_links_what_brute_force_links(spark, bits):
    rng = np.random.default_rng(bits)
    points = {int(x) for x in rng.integers(0, 1 << 63, 400)}
    for centre in list(points)[:40] + [list(points)[0]] * 300:
        for k in rng.integers(0, 64, rng.integers(1, 9)):
            centre ^= 1 << int(k)
        points.add(centre)
    signed = np.array(sorted(points), np.uint64).view(np.int64)
    frame = spark.createDataFrame([(int(p),) for p in signed], "fp long")
    got = {r[0]: r[1] for r in common.components(simhash.link_forest(frame, bits, sample=200, shard=50)).collect()}
    near = np.bitwise_count(signed[:, None].view(np.uint64) ^ signed[None, :].view(np.uint64)) <= bits
    parent = np.arange(len(signed))
    a, b = np.nonzero(near)
    simhash.join_roots(parent, a, b)
    simhash.join_roots(parent, np.arange(len(signed)), parent.copy())
    sizes = np.bincount(parent, minlength=len(signed))
    want = {}
    for k, p in enumerate(parent):
        if sizes[p] > 1:
            want.setdefault(p, []).append(int(signed[k]))
    roots = {x: min(group) for group in want.values() for x in group}
    assert {x: got.get(x, x) for x in map(int, signed)} == {x: roots.get(x, x) for x in map(int, signed)}


def test_near_classes_of_odd_rows(spark):
    got = {(r[0], r[2]) for r in simhash.near_classes(table(spark, ODD)).collect()}
    assert {(1, 1), (2, 1), (3, 1), (None, 1), (4, 4), (5, 4), (8, 8), (9, 8), (None, None)} <= got and (6, 6) in got and (7, 7) in got


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(60)] + [(1000, 2000 + k) for k in range(500)] + [(5, 5)]
    got = dict(common.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {got.get(k, k) for k in range(61)} == {0} and {got.get(k, k) for k in [1000, *range(2000, 2500)]} == {1000}


def test_partitions_follow_the_bytes(spark, monkeypatch):
    """Texts of twenty times the budget of all default partitions take at most one more round."""
    rng, rounds = random.Random(1), []
    rows = [(k, "".join(rng.choices("abcdefgh", k=600))) for k in range(6_000)]
    budget = 6_000 * 600 // (20 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    plain = exact_dedup.parts_for
    monkeypatch.setattr(exact_dedup, "parts_for", lambda *a: rounds.append(a) or plain(*a))
    assert exact_dedup.text_owners(table(spark, rows), trie_bytes=budget).count() == 6_000 and len(rounds) <= 2
