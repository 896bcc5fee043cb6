import pytest
from meterloom.llm import mixing
from pyspark.sql import functions as F
from test_llm_dedup import LONG, table


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 1000, "c": 50, None: 7}, {"x": 5}, {"a": 0, "b": 3}, {"é": 100, "z": 1, "Z": 500, "y": 2, "x": 90}, {"a": 0}])
def test_targets_equal_repeated_resharing(spark, sizes):
    frame = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(frame).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_permutation_is_one(spark):
    keys = F.array(*[F.pmod(F.xxhash64(F.lit(r)), F.lit(997)) for r in range(mixing.ROUNDS)])
    frame = spark.range(997).withColumn("size", F.lit(997).cast("long")).withColumn("keys", keys)
    got = [r[0] for r in frame.select(mixing.permuted("id", "size", "keys")).collect()]
    assert sorted(got) == list(range(997)) and got != sorted(got)


def mixture(spark, rows):
    frame = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return frame, mixing.mixed(frame).collect()


def test_taken_words_are_those_of_the_drawn_blocks(spark):
    rows = [(k, " ".join(["w"] * (k * 37 % 400)), ["a", "b", "b", None][k % 4]) for k in range(400)]
    frame, got = mixture(spark, rows)
    assert got == mixture(spark, rows)[1] or sorted(map(repr, got)) == sorted(map(repr, mixture(spark, rows)[1]))
    sizes = mixing.sized(frame)
    slots = mixing.drawn_slots(mixing.source_targets(sizes)).collect()
    times = {}
    for s in slots:
        times[s["skey"], s["block"]] = times.get((s["skey"], s["block"]), 0) + 1
    want = {}
    for p in mixing.document_blocks(sizes).collect():
        want[p["id"]] = want.get(p["id"], 0) + p["words"] * times.get((p["skey"], p["block"]), 0)
    assert {r["id"]: r["taken"] for r in got} == {i: want.get(i, 0) for i, _, _ in rows}
    for source in ("a", "b", None):
        mine = [r for r in got if r["source"] == source]
        assert sum(r["size"] for r in mine) == mine[0]["source_size"]
        assert sum(r["taken"] for r in mine) == pytest.approx(mine[0]["target"], rel=0.03)
    assert all(r["taken"] <= 3 * r["size"] for r in got)


def test_streams_are_cut_without_gaps(spark):
    frame = spark.createDataFrame([(k % 7, "s", k % 50) for k in range(500)], "id long, source string, size long")
    parts = mixing.document_blocks(frame).groupBy("block").agg(F.sum("words").alias("n")).orderBy("block").collect()
    assert [r["n"] for r in parts[:-1]] == [mixing.BLOCK] * (len(parts) - 1) and sum(r["n"] for r in parts) == sum(k % 50 for k in range(500))


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (None, "a b"), (None, "a b"), (4, LONG), (5, "x"), (5, "x")]
    got = mixing.mixed(table(spark, rows)).collect()
    assert sorted(r["size"] for r in got) == [0, 0, 0, 1, 1, 2, 2, 60_000] and all(r["taken"] <= 3 * r["size"] for r in got)
    assert mixing.mixed(table(spark, [])).count() == 0
    assert [r["taken"] for r in mixing.mixed(table(spark, [(1, None)])).collect()] == [0]
