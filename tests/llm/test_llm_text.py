"""Decontamination, quality, language, language model, token counts and secrets."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from meterloom.llm import decontam, langid, lm_scoring, quality, secret_scan, token_counts
from pyspark.sql import functions as F
from test_llm_dedup import LONG, ODD, table

SF = "/root/testdata/sf0.01"


def brute_wand(lists, terms, threshold):
    scores = {}
    for t in terms:
        for item, w in lists[t]:
            scores[item] = scores.get(item, 0) + w
    return sorted(i for i, s in scores.items() if s >= threshold)


def test_block_max_wand_equals_brute_force():
    rng = random.Random(3)
    for _ in range(100):
        lists = {}
        for item in range(rng.randint(1, 120)):
            for t in rng.sample(range(40), rng.randint(1, 12)):
                lists.setdefault(t, []).append((item, rng.random() * 0.3))
        size = decontam.BLOCK
        postings = {t: ([i for i, _ in e], [w for _, w in e], [max(w for _, w in e[k:k + size]) for k in range(0, len(e), size)], max(w for _, w in e)) for t, e in lists.items()}
        terms = [t for t in rng.sample(range(40), rng.randint(1, 20)) if t in lists]
        for threshold in (0.2, 0.5, 1.0):
            assert sorted(i for i, _ in decontam.block_max_wand(postings, terms, threshold)) == brute_wand(lists, terms, threshold)


ITEMS = [(1, "what is the capital of the far country over the hills it is called Oz"), (2, "short"), (3, None), (4, ""), (4, ""), (5, " ".join(f"w{k}" for k in range(300)))]


def hits(spark, docs, items=ITEMS, **more):
    asked = decontam.questions_of(spark.createDataFrame(items, "item_id long, text string"))
    return sorted((r["id"], r["item_id"]) for r in decontam.contaminated(table(spark, docs), asked, **more).collect())


def test_leaks_are_found_and_others_left_alone(spark):
    filler = " ".join(f"x{k}" for k in range(500))
    docs = [(10, f"{filler} {ITEMS[0][1].upper()} {filler}"), (11, filler), (12, "it was short"), (13, f"{filler} {ITEMS[5][1]}"), (13, ITEMS[5][1]),
            (14, None), (15, ""), (16, "what is the capital of the far"), (17, ITEMS[5][1][:300])]
    assert hits(spark, docs) == [(10, 1), (12, 2), (13, 5), (13, 5)]
    assert hits(spark, [], ITEMS) == [] and hits(spark, docs, []) == [] and hits(spark, docs, [(1, None)]) == []
    asked = decontam.questions_of(spark.createDataFrame(ITEMS, "item_id long, text string"))
    kept = decontam.without_items(table(spark, docs), asked)
    assert kept.columns == table(spark, []).columns and sorted(r["doc_id"] for r in kept.collect()) == [11, 14, 15, 16, 17]


def test_shards_of_the_index_find_the_same(spark):
    asked = decontam.questions_of(spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert len(list(decontam.index_shards(asked, 200))) > 1
    whole, small = (sorted(c for s in decontam.index_shards(asked, n) for c, _, _ in s["checks"]) for n in (1 << 20, 200))
    assert whole == small


def test_one_changed_word_hides_no_item(spark):
    words = [f"q{k}" for k in range(15)]
    item, filler = (1, " ".join(words)), " ".join(f"x{k}" for k in range(300))
    docs = [(k, f"{filler} {' '.join([*words[:k], 'other', *words[k + 1:]])} {filler}") for k in range(15)]
    docs += [(20, f"{filler} {' '.join(words[:12])} {filler}"), (21, f"{filler} {' '.join(words[:6])} {filler}"), (22, filler)]
    assert hits(spark, docs, [item]) == [(k, 1) for k in [*range(15), 20]]
    # an answer that the caller gives has to be there too
    asked = spark.createDataFrame([(1, " ".join(words[:12]), " ".join(words[12:]))], "item_id long, question string, answer string")
    assert sorted(r["id"] for r in decontam.contaminated(table(spark, docs), asked).collect()) == [*range(12)]


def test_query_equals_word_for_word_search(spark):
    from meterloom.llm.registry import QUERIES

    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op1_decontamination"](spark, SF).collect()}
    items = {r[0]: " ".join(decontam.tokens(r[1])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    want = {(d, i) for d, t in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
            for text in [" ".join(decontam.tokens(t))] for i, q in items.items() if q in text}
    assert got == want and want


def test_kth_largest(spark):
    values = [1.5, -2.0, 1.5, 7.25, 0.0, 1e9, -1e-9]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    for k in range(1, 8):
        assert quality.kth_largest(frame, "v", k) == sorted(values)[-k]
    assert quality.kth_largest(frame, "v", 8) is None and quality.kth_largest(frame.where("v > 2e9"), "v", 1) is None


def test_quality_rejects_labelled_junk_and_keeps_clean(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r["id"]: r["kept"] for r in quality.resampled(docs, labels).collect()}
    known = labels.collect()
    clean, junk = ([got[r["doc_id"]] for r in known if r["quality"] == q and not r["toxic"]] for q in (1, 0))
    assert np.mean(clean) > 0.98 and np.mean(junk) < 0.02
    kept = quality.kept_documents(docs, labels)
    assert kept.columns == docs.columns and {r[0] for r in kept.select("doc_id").collect()} == {i for i, k in got.items() if k}


def test_few_toxic_words_in_long_texts_are_rejected(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(400):
        words = rng.choices([f"w{x}" for x in range(300)], k=rng.choice((60, 600)))
        toxic = k % 4 == 1
        if toxic:
            for at in rng.sample(range(len(words)), 2):
                words[at] = rng.choice(("vile", "nasty", "awful"))
        rows.append((k, " ".join(words)))
        labels.append((k, 1, int(toxic)))
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["id"]: r["kept"] for r in quality.resampled(table(spark, rows), labels).collect()}
    clean, toxic = ([v for k, v in got.items() if (k % 4 == 1) == t] for t in (False, True))
    assert np.mean(clean) > 0.95 and np.mean(toxic) < 0.05
    assert {r["doc_id"] for r in quality.kept_documents(table(spark, rows), labels).collect()} == {k for k, v in got.items() if v}


def test_kept_documents_keep_columns_of_clashing_names(spark):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)], "doc_id long, quality int, toxic int")
    rows = [(k, "good plain words stand here" if k % 2 else "@@ ## spam 0x0 !!") for k in range(40)] + [(None, None)]
    plain = table(spark, rows)
    docs = plain.withColumns({"key": F.lit("k"), "toxicity": F.lit(7), "log_weight": F.lit(True), "id": F.lit(-5), "fold": F.lit(0)})
    kept = quality.kept_documents(docs, labels)
    assert kept.columns == docs.columns and {tuple(r) for r in kept.select("key", "toxicity", "log_weight", "id", "fold").collect()} == {("k", 7, True, -5, 0)}
    assert sorted(map(str, kept.select("doc_id", "text").collect())) == sorted(map(str, quality.kept_documents(plain, labels).select("doc_id", "text").collect()))


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, None), (1, 1, 0), (None, 1, 0), (77, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.resampled(table(spark, ODD), labels).count() == len(ODD)
    assert quality.resampled(table(spark, ODD), labels.where("false")).where("kept").count() == len(ODD)
    assert quality.resampled(table(spark, []), labels).count() == 0


def bucket(i, parts):
    return None if i is None else zlib.crc32(str(i).encode()) % parts


def test_languages_are_told_apart(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["id"]: r for r in langid.identified(docs).collect()}
    rows = docs.select("doc_id", "lang").collect()
    assert all(got[i]["held_out"] == (bucket(i, 4) == 2) and 0 <= got[i]["score"] <= 1 for i, _ in rows)
    held = [got[i]["lang_pred"] == lang for i, lang in rows if bucket(i, 4) == 2]
    assert np.mean(held) > 0.98
    groups = {r["id"]: r["lang_pred"] for r in langid.identified(docs, model_bytes=1).collect()}
    assert groups == {i: r["lang_pred"] for i, r in got.items()}


def test_groups_of_languages_keep_rows_apart(spark):
    english, german = "the cat sat on the mat and then it ran away over the hill", "das haus steht auf dem berg und der hund schläft im garten"
    rows = [(k, english if k % 2 else german) for k in range(40)] + [(None, english), (None, german), (None, None), (7, german), (7, english), (None, "123"), (8, ""), (8, english)]
    docs = table(spark, rows).withColumn("lang", F.when(F.col("text").startswith("the"), "en").when(F.col("text").startswith("das"), "de"))
    whole, groups = (sorted(((r["id"], r["lang_pred"], round(r["score"], 6), r["held_out"]) for r in langid.identified(docs, **more).collect()), key=repr) for more in ({}, {"model_bytes": 1}))
    assert groups == whole and len(groups) == len(rows)
    assert Counter(r[1] for r in groups if r[0] is None) == {"en": 1, "de": 1, "und": 2}


def test_kneser_ney_probabilities_sum_to_one():
    runs = ["abc", "abd", "ba", "abcabc", "d"]
    run, orders = langid.grams(runs)
    columns = {c: [] for c in ("gram", "key", "suffix", "context", "starts", "n")}
    for n, (places, key, suffix, context, starts) in enumerate(orders, 1):
        seen = {}
        for k in range(len(places)):
            seen.setdefault(int(key[k]), [int(suffix[k]), int(context[k]), bool(starts[k]), 0])[3] += 1
        for k, (s, c, b, count) in seen.items():
            for name, v in zip(columns, (n, k, s, c, b, count)):
                columns[name].append(v)
    import pyarrow as pa

    fitted = langid.fit_language(pa.table({"lang": ["x"] * len(columns["gram"]), "gram": pa.array(columns["gram"], pa.int32()), "key": pa.array(columns["key"], pa.int32()),
                                           "suffix": pa.array(columns["suffix"], pa.int32()), "context": pa.array(columns["context"], pa.int32()),
                                           "starts": columns["starts"], "n": columns["n"]}))
    model = langid.side_by_side(fitted.to_pylist(), ["x"])
    for context in ("", "a", "ab", "b", "abc", "ba", "d"):
        after = len(context) + 1
        total = 10 ** step_chance(model, context, after) + sum(10 ** step_chance(model, context + x, after) for x in "abcdz")  # z was never seen
        assert total == pytest.approx(1, rel=1e-3)


def step_chance(model, run, place):
    """log10 chance of the character at ``place`` of the marked run."""
    out = None
    for n, (places, key, _, context, _) in enumerate(langid.grams([run])[1], 1):
        at = np.nonzero(places == place)[0]
        if len(at):
            keys, chances, contexts, backoffs = model["orders"][n - 1]
            seen = langid.sought(keys, chances, key[at], 1.0)[0, 0]
            lower = model["unseen"][0] if n == 1 else out + langid.sought(contexts, backoffs, context[at], 0.0)[0, 0]
            out = lower if seen > 0 else seen
    return out


def test_language_of_odd_rows(spark):
    rows = [(1, "the cat"), (2, None), (3, ""), (4, "123 _ ²"), (None, "das Haus"), (5, "das haus"), (5, "das haus"), (6, LONG), (7, "日本語")]
    docs = table(spark, rows).withColumn("lang", F.when(F.col("doc_id") == 5, "de").when(F.col("doc_id") < 5, "en"))
    got = sorted(((r["id"], r["lang_pred"], r["score"]) for r in langid.identified(docs).collect()), key=repr)
    assert len(got) == len(rows) and {(2, "und", 0.0), (3, "und", 0.0), (4, "und", 0.0)} <= set(got)
    assert {p for _, p, _ in langid.identified(docs.withColumn("lang", F.lit(None).cast("string"))).select("id", "lang_pred", "score").collect()} == {"und"}
    assert langid.identified(table(spark, [])).count() == 0


def test_language_model_against_counts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    split = {i: lm_scoring.tokens(t.encode()) for i, t in rows}
    counts = Counter(w for i, words in split.items() if bucket(i, 5) != 1 for w in words)
    total = sum(counts.values())
    scale = math.log10(total + 0.5 * (len(counts) + 1))
    gain = []
    for r in lm_scoring.scored(docs).collect():
        words = split[r["id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (bucket(r["id"], 5) == 1, len(words), sum(w in counts for w in words), total)
        assert r["base_score"] == pytest.approx(sum(math.log10(counts[w] + 0.5) - scale for w in words))
        if r["held_out"]:
            gain.append((r["score"] - r["base_score"], len(words)))
    assert sum(g for g, _ in gain) / sum(n for _, n in gain) > 0.1


def test_class_chances_sum_to_one():
    rng = np.random.default_rng(0)
    weights = rng.normal(size=(lm_scoring.ROWS, lm_scoring.CLASSES)).astype(np.float32)
    kind, rows = lm_scoring.history(rng.integers(0, 48, 50), rng.integers(0, 9, 50), np.array([20, 1, 29]))
    assert lm_scoring.chances(weights, rows).sum(1) == pytest.approx(np.ones(50), rel=1e-5)


def test_columns_are_cut_as_single_texts():
    texts = ["", None, " a  B\x0b\x1fc\x85d \n", "\t", "É x\x0cy", "z z"]
    words, lengths = lm_scoring.split_words(pa.array(texts))
    plain = [lm_scoring.tokens((t or "").encode()) for t in texts]
    assert words.to_pylist() == [w for x in plain for w in x[:-1]] and lengths.tolist() == [len(x) - 1 for x in plain]
    vocabulary = lm_scoring.Vocabulary({b"z": (5, 2)})
    codes, sizes = lm_scoring.batch_codes(vocabulary, pa.array(texts))
    assert [vocabulary.words[k] for k in codes] == [w for x in plain for w in x] and sizes.tolist() == [len(x) for x in plain]
    assert vocabulary.table[2, codes[-2]] == 2 and vocabulary.encode(pa.array([], pa.binary())).tolist() == []


def test_sums_of_runs_are_those_of_reduceat():
    rng = np.random.default_rng(1)
    for top in (1, 3, 400, 9_000):
        values, keys = rng.normal(size=(3_000, 48)).astype(np.float32), np.sort(rng.integers(0, top, 3_000))
        order, starts = rng.permutation(3_000), np.nonzero(np.diff(keys, prepend=-1))[0]
        assert np.array_equal(lm_scoring.run_sums(values, order, starts, np.empty_like(values)), np.add.reduceat(values[order], starts, axis=0))


def test_language_model_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "FREQUENT", 3)  # most words take the way of rare ones
    got = {(r["id"], r["n_tokens"]) for r in lm_scoring.scored(table(spark, ODD)).collect()}
    assert {(4, 1), (5, 1), (8, 60_001), (None, 3)} <= got
    assert lm_scoring.scored(table(spark, [])).count() == 0
    alone = lm_scoring.scored(table(spark, [(None, "a b")])).first()
    assert (alone["n_tokens"], alone["n_known"], alone["train_tokens"]) == (3, 0, 0)


def test_histogram_answers_equal_brute_force(spark):
    texts = ["", "a", "hello world", "hello world", LONG[:5000], None, "x y z " * 400]
    lengths = [r["length"] for r in token_counts.encoded_lengths(table(spark, list(enumerate(texts)))).collect()]
    encode = token_counts.encoder().encode_ordinary
    assert sorted(lengths) == sorted(len(encode(t or "")) for t in texts)
    hist = token_counts.histogram(token_counts.encoded_lengths(table(spark, list(enumerate(texts)))))
    for r in token_counts.suffix_sums(hist).collect():
        n = r["length"]
        assert (r["docs"], r["docs_at_least"], r["docs_over"]) == (lengths.count(n), sum(x >= n for x in lengths), sum(x > n for x in lengths))
        assert (r["tokens_at_least"], r["truncated_total"]) == (sum(x for x in lengths if x >= n), sum(min(x, n) for x in lengths))
        assert r["share_up_to"] == pytest.approx(sum(x <= n for x in lengths) / len(lengths))
    for r in token_counts.limit_totals(hist, [0, 2, 100, 10**9]).collect():
        assert (r["docs_over"], r["truncated_total"]) == (sum(x > r["limit"] for x in lengths), sum(min(x, r["limit"]) for x in lengths))
    assert token_counts.length_quantile(token_counts.suffix_sums(hist), 0.5).first()[0] == sorted(lengths)[3]
    assert token_counts.suffix_sums(token_counts.histogram(token_counts.encoded_lengths(table(spark, [])))).count() == 0


def test_secrets_are_found_and_numbers_left_alone(spark):
    rows = []
    for k in range(60):
        rows.append((k, f'see token = "{zlib.crc32(str(k).encode()):08x}{k * 7919 % 10**8:08d}deadbeef" end'))
        rows.append((100 + k, f"pay to 44{k:014d} now"))
        rows.append((200 + k, f"key AKIA{k:016d} here"))
    rows += [(None, "password=abcdef0123456789ab"), (1, None), (2, ""), (3, "plainwordswithoutanydigits at all"), (4, LONG), (5, "password=abcdef0123456789ab"), (5, "password=abcdef0123456789ab")]
    got = [(r["id"], r["candidate"], r["secret"]) for r in secret_scan.scan(table(spark, rows)).collect()]
    assert len(got) == 183 and all(s == (i is None or i < 100 or i >= 200) for i, _, s in got)
    assert secret_scan.scan(table(spark, [])).count() == 0
    assert [r["score"] for r in secret_scan.scan(table(spark, [(1, "pay 4400000000000000 now")])).collect()] == [0.0]
    # labels of the caller decide: here only what follows the word "leak" is a secret
    own = lambda found: F.when(F.col("id") % 2 == 0, F.when(F.col("before") == "leak", 1.0).otherwise(0.0))
    rows = [(k, f"{'leak' if k % 4 < 2 else 'fine'} {zlib.crc32(str(k).encode()):08x}{zlib.crc32(str(-k).encode()):08x}00") for k in range(200)]
    got = {r["id"]: r["secret"] for r in secret_scan.scan(table(spark, rows), label=own).collect()}
    assert np.mean([got[k] == (k % 4 < 2) for k in range(1, 200, 2)]) > 0.95


def test_short_assigned_values_and_passwords_of_addresses_are_candidates(spark):
    cases = {
        "set password=Hunter2pass now": ["Hunter2pass"],
        "password: Hunter2pass.": ["Hunter2pass"],
        'my "db_password" = "tr0ub4" end': ["tr0ub4"],
        "secret => correct-horse-battery": ["correct-horse-battery"],
        "api_key=ab12.cd34.ef56gh78&x=1": ["ab12.cd34.ef56gh78"],
        "token=abc.def0123456789abcdef": ["abc.def0123456789abcdef"],
        "open postgres://me:s3cret!pw@host/db": ["s3cret!pw"],
        "password=abcdef0123456789ab": ["abcdef0123456789ab"],
        "password=short": [], "a token of thanks": [], "see http://host:8080/path": [], "password": [], "= longword": [], "x = longword": [],
    }
    docs = spark.createDataFrame([(k, "src", t) for k, t in enumerate(cases)], "doc_id long, source string, text string")
    got = {}
    for r in secret_scan.candidates(docs).collect():
        got.setdefault(r["id"], []).append(r["candidate"])
    assert {t: got.get(k, []) for k, t in enumerate(cases)} == cases
    rows = [(k, f"password=Hunt{k}pass") for k in range(80)] + [(100 + k, f"pay to 44{k:014d} now") for k in range(80)] + [(900, "open postgres://me:s3cret9pw@host/db")]
    scored = {r["id"]: r["secret"] for r in secret_scan.scan(table(spark, rows)).collect()}
    assert all(scored[k] for k in range(80)) and not any(scored[100 + k] for k in range(80)) and 900 in scored


def test_a_rare_label_is_never_lost(spark):
    rows = [(k, f"pay to 44{k:014d} now") for k in range(3_000)] + [(5_000, "my token=k3yA8f2bQ9zLm4Xw7Rt1 here")]
    got = {r["id"]: (r["label"], r["score"]) for r in secret_scan.scan(table(spark, rows), limit=100).collect()}
    assert got[5_000][0] == 1 and len(got) == len(rows)
    assert got[5_000][1] >= 0.5 and max(s for i, (_, s) in got.items() if i < 5_000) < 0.5


def test_long_runs_of_blanks_are_counted_as_the_pattern_joins_them(spark):
    import random

    from meterloom.llm import token_counts

    encoding, rng = token_counts.encoder(), random.Random(9)
    for _ in range(300):
        text = "".join(rng.choice(["a", "word", "7", "!", " ", "\n", "\t", "\u3000", "\x1f", "  ", " \n \n"]) for _ in range(40))
        assert token_counts.token_count(encoding, text, 3) == len(encoding.encode_ordinary(text)), repr(text)
    texts = [" " * 2_000_000, "\n" * 2_000_000, "a" + " " * 1_500_000 + "b" + "\n" * 1_500_000 + "c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: r["length"] for r in token_counts.encoded_lengths(docs).collect()}
    assert got == {0: 2_000_000, 1: 1_000_000, 2: 1 + 1_499_999 + 1 + 750_000 + 1 + 1}
