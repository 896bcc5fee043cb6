"""Merkle manifest against a plain recursive version."""

import hashlib
import zlib

import pytest
from meterloom.llm import merkle
from meterloom.llm.registry import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, grp string, n long, pos long, hash string, id long, block long, level int"


def table(spark, rows):
    """Documents with extra columns whose names the operator uses itself."""
    return spark.createDataFrame([(i, t, lang, s, n, "g", 1, 1, "h", 1, 1, 1) for i, t, lang, s, n in rows], SCHEMA)


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    i, _, lang, source, n = row
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def root_of(nodes):
    while len(nodes) > 1:
        nodes = [h("".join(nodes[k:k + 8])) for k in range(0, len(nodes), 8)]
    return nodes[0]


def siblings(nodes, at):
    out = []
    while len(nodes) > 1:
        run = range(at // 8 * 8, min(at // 8 * 8 + 8, len(nodes)))
        out += [nodes[k] for k in run if k != at]
        nodes, at = [h("".join(nodes[k:k + 8])) for k in range(0, len(nodes), 8)], at // 8
    return out


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        mine = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees[g] = mine, [leaf(r, r[1]) for r in mine]
    subroots = [root_of(trees[g][1]) for g in order]
    root, out = root_of(subroots), []
    for k, g in enumerate(order):
        mine, leaves = trees[g]
        for at, r in enumerate(mine):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            low = r[1] and "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1])
            tops = list(subroots)
            tops[k] = root_of([*leaves[:at], leaf(r, low) if hit else leaves[at], *leaves[at + 1:]])
            folded = root_of(tops)
            out.append((r[0], leaves[at], subroots[k], root, h("".join(siblings(leaves, at) + siblings(subroots, k))), folded, folded == root))
    return out


def query(spark, rows, tmp):
    table(spark, rows).write.parquet(f"{tmp}/documents.parquet")
    return QUERIES["op12_merkle_manifest"](spark, str(tmp)).collect()


def rows_of(sizes):
    out, i = [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            i += 1
            out.append((i * 7 % 9973, f"Text NUMBER {i} Ä" if i % 5 else f"plain {i}", lang, None if i % 11 == 0 else f"s{i % 3}", i))
    return out


@pytest.mark.parametrize("sizes", [{"en": 600, None: 3, "é": 1, "de": 9, "": 8}, {f"l{k}": 2 for k in range(70)}, {"en": 1}])
def test_equals_plain_version(spark, tmp_path, sizes):
    rows = rows_of(sizes)
    assert sorted(map(tuple, query(spark, rows, tmp_path))) == sorted(brute(rows))


def test_odd_rows(spark, tmp_path):
    rows = [(None, None, None, None, None), (None, "A", "en", "s", 1), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (1, "B", "en", "s", 0), (-3, "x Y " * 100_000, "en", None, 7)]
    assert sorted(map(repr, map(tuple, query(spark, rows, tmp_path)))) == sorted(map(repr, brute(rows)))


def test_empty_table(spark, tmp_path):
    assert query(spark, [], tmp_path) == []


def test_a_version_shares_all_but_its_path(spark):
    rows = rows_of({"en": 530, "de": 10, "fr": 1})
    tree = merkle.Manifest(table(spark, rows))
    nodes, versions = tree.nodes().cache(), tree.versions().cache()
    base = {r[:3]: r[3] for r in map(tuple, nodes.select("grp", "level", "pos", "hash").collect())}
    changed = versions.where("changed IS NOT NULL AND changed <> leaf").orderBy("id").collect()
    for v in (changed[0], changed[-1]):
        seen = {r[:3]: r[3] for r in map(tuple, merkle.version_nodes(nodes, versions, v["id"]).collect())}
        assert seen.keys() == base.keys() and sum(seen[k] != base[k] for k in base) == len(v["copied"]) + 1  # a subroot stands in both trees
        for (grp, level, pos), value in seen.items():
            below = [seen[k] for k in sorted(k for k in seen if k[0] == grp and k[1] == level - 1 and k[2] // 8 == pos)]
            assert level == 0 or h("".join(below)) == value
        assert seen["", 1, 0] == v["copied"][-1]


def test_equals_sql(spark):
    import os
    import sys

    import corpus_pipeline

    sys.path.insert(0, os.path.join(os.path.dirname(corpus_pipeline.__file__), "tools"))
    from oracle_check import connect, rows_of

    sf = "/root/testdata/sf0.01"
    df = QUERIES["op12_merkle_manifest"](spark, sf)
    res = connect(sf).execute(ORACLES["op12_merkle_manifest"])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in res.description], res.fetchall())
