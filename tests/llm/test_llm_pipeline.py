import corpus_pipeline
from meterloom.llm import decontam
from meterloom.llm.registry import ORACLES, QUERIES
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_stages_hand_on_what_they_keep(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, texts = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "exact_dedup", "simhash_near_dedup", "benchmark_decontamination", "source_mixing"]
    kept = [set(texts)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        ids = [r[0] for r in docs.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) < kept[-1], name
        assert docs.join(before, columns, "left_semi").count() == len(ids)
        kept.append(set(ids))
    folded = [texts[i].encode().lower() for i in kept[2]]
    assert len(folded) == len(set(folded))
    assert {texts[i].encode().lower() for i in kept[1]} == set(folded)
    items = [" ".join(decontam.tokens(r[0])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()]
    plain = {i: " ".join(decontam.tokens(texts[i])) for i in kept[3]}
    assert kept[4] == {i for i, t in plain.items() if not any(q in t for q in items)}
    mix = corpus_pipeline.mix(spark, docs, SF)
    assert {r[0] for r in mix.select("doc_id").collect()} == kept[4]


def test_stages_of_odd_rows(spark):
    rows = [(None, "a b c", "en", None, 1), (None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "x " * 50_000, "en", "s", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns and out.count() <= docs.count()
        assert corpus_pipeline.mix(spark, docs, SF).count() == docs.count()


def test_equal_texts_without_identifier_and_of_a_repeated_one(spark):
    rows = [(None, "a b", 1), (None, "A b", 2), (None, "c", 3), (7, "C", 4), (9, "d", 5), (9, "e", 6), (8, "E", 7), (9, "d", 8)]
    docs = spark.createDataFrame([(i, t, "en", "s", n, 0) for i, t, n in rows], "doc_id long, text string, lang string, source string, n_chars long, _owned long")
    got = corpus_pipeline.one_of_equal_texts(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"].lower()) for r in got.collect()), key=repr) == [(7, "c"), (9, "d"), (9, "e"), (None, "a b")]


def test_every_operator_has_a_query():
    assert [f"op{n}" for n in range(1, 14)] == sorted((q.split("_")[0] for q in QUERIES), key=lambda q: int(q[2:])) and set(ORACLES) <= set(QUERIES)


def test_exact_dedup_equals_sql(spark):
    import os
    import sys

    sys.path.insert(0, os.path.join(os.path.dirname(corpus_pipeline.__file__), "tools"))
    from oracle_check import connect, rows_of

    df = QUERIES["op10_exact_dedup"](spark, SF)
    res = connect(SF).execute(ORACLES["op10_exact_dedup"])
    assert rows_of(df.columns, df.select(*[F.col(c) for c in df.columns]).collect()) == rows_of([d[0] for d in res.description], res.fetchall())
