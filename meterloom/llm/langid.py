"""Language identification by interpolated Kneser-Ney character models, one per language.

A text is its lower-cased runs of letters, each with a start and an end mark; contexts stay within
a run, so the score of a run depends on the run alone and is computed once per task and distinct
run.  Character n-grams up to ``ORDER`` are counted where the texts are scanned; only distinct
n-grams are shuffled.  They are hashed to ``HASH_BITS`` bits per order, which bounds a language's
model whatever the input: one task fits it (continuation counts, discounts, back-off weights), and
it is stored as sorted hash arrays that are searched by bisection.  If the models of all languages
exceed ``MODEL_BYTES``, languages are scored in groups, a pass each over stored rows with a number,
by which the scores of a row meet.

The prediction is the language of the lowest cross-entropy per character.  ``score`` is its share
among the languages at a fixed number of characters.  ``rejected`` marks texts whose cross-entropy
exceeds what ``ACCEPTED`` of the learned texts of that language stay below.

Null texts and texts without letters are ``und`` with score 0 (also every text, when nothing could
be learned); ties go to the first language in order; a null identifier is neither learned nor held
out; repeated rows are learned and predicted each; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.llm.common import crc_bucket, stored

ORDER, HASH_BITS, MODEL_BYTES = 4, 20, 96 << 20
FOLDS, HELD, ACCEPTED, SHARPNESS = 4, 2, 0.995, 20.0
#: Distinct letter runs that a task remembers before it counts or forgets them.
RUNS = 200_000
LETTERS = re.compile(r"[^\W\d_]+")
START, END = "\x01", "\x02"
GRAM_DDL = "lang string, gram int, key int, suffix int, context int, starts boolean, n long"
ENTROPY_DDL = "id long, names array<string>, entropies array<double>"


def runs_of(text: str | None) -> list[str]:
    found = LETTERS.findall(text.lower()) if text else []
    if text and not text.isascii():  # the pattern also takes numerals that are not digits
        found = [r if r.isalpha() else "".join(filter(str.isalpha, r)) for r in found]
    return [r for r in found if r]


def grams(runs: list[str]):
    """Of all marked runs end to end: the run of each character, and per order the places with such
    an n-gram, its key, the keys of its suffix and of its context, and whether it begins a run."""
    codes = np.frombuffer("".join(START + r + END for r in runs).encode("utf-32-le"), np.uint32).astype(np.uint64)
    begins = codes == ord(START)
    at = np.arange(len(codes))
    first = np.maximum.accumulate(np.where(begins, at, 0))
    multiplier, spread = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
    shift = np.uint64(64 - HASH_BITS)
    rolling = [np.zeros(len(codes), np.uint64)]
    for _ in range(ORDER):
        longer = codes + np.uint64(7)
        longer[1:] += rolling[-1][:-1] * multiplier
        rolling.append(longer)
    keys = [((h ^ (h >> np.uint64(31)) ^ np.uint64(n << 40)) * spread >> shift).astype(np.int32) for n, h in enumerate(rolling)]
    found = []
    for n in range(1, ORDER + 1):
        places = np.nonzero(~begins & (at - n + 1 >= first))[0]
        found.append((places, keys[n][places], keys[n - 1][places], keys[n - 1][places - 1], places - n + 1 == first[places]))
    return np.cumsum(begins) - 1, found


def gram_counts(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """Counts of the n-grams of the documents to learn from, by language."""
    remainder = crc_bucket(F.col(id_col), FOLDS)
    learned = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (remainder != HELD))

    def count(batches):
        def handed_on(seen: dict[str, Counter]):
            for lang, counts in seen.items():
                runs, weights = list(counts), np.fromiter(counts.values(), np.int64)
                run, orders = grams(runs)
                for n, (places, key, suffix, context, starts) in enumerate(orders, 1):
                    unique, where, inverse = np.unique(key, return_index=True, return_inverse=True)
                    total = np.bincount(inverse, weights=weights[run[places]]).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(unique)), pa.array(np.full(len(unique), n, np.int32)), pa.array(unique), pa.array(suffix[where]),
                         pa.array(context[where]), pa.array(starts[where]), pa.array(total)],
                        names=["lang", "gram", "key", "suffix", "context", "starts", "n"])

        seen: dict[str, Counter] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if found := runs_of(text):
                    seen.setdefault(lang, Counter()).update(found)
            if sum(map(len, seen.values())) > RUNS:
                yield from handed_on(seen)
                seen = {}
        yield from handed_on(seen)

    counted = learned.select(F.col(text_col).cast("string"), F.col(lang_col).cast("string")).mapInArrow(count, GRAM_DDL)
    return counted.groupBy("lang", "gram", "key").agg(
        F.min("suffix").alias("suffix"), F.min("context").alias("context"), F.max("starts").alias("starts"), F.sum("n").alias("n"))


def fit_language(table: pa.Table) -> pa.Table:
    """Sorted keys with log10 probabilities, and contexts with log10 back-off weights, per order."""
    size, below, rows = 1 << HASH_BITS, None, []
    part = {c: table.column(c).to_numpy() for c in ("gram", "key", "suffix", "context", "starts", "n")}
    orders = [{c: part[c][part["gram"] == n] for c in part} for n in range(1, ORDER + 1)]
    for n, own in enumerate(orders, 1):
        amount = own["n"].astype(float)
        if n < ORDER:  # distinct characters to the left, except where a run begins
            left = np.bincount(orders[n]["suffix"], minlength=size)[own["key"]]
            amount = np.where(own["starts"], amount, np.maximum(left, 1))
        once, twice = (amount == 1).sum(), (amount == 2).sum()
        discount = min(0.9, max(0.1, once / max(1, once + 2 * twice)))
        context = own["context"] if n > 1 else np.zeros(len(amount), np.int32)
        total, kinds = np.bincount(context, amount, size), np.bincount(context, minlength=size)
        backoff = discount * kinds / np.maximum(total, 1)
        lower = np.full(len(amount), 1 / (len(amount) + 1)) if n == 1 else below[own["suffix"]]
        chance = (amount - discount) / total[context] + backoff[context] * lower
        below = np.full(size, 1e-9)
        below[own["key"]] = chance
        order, known = np.argsort(own["key"]), np.nonzero(kinds)[0]
        rows.append((n, own["key"][order].astype(np.int32).tobytes(), np.log10(chance[order]).astype(np.float32).tobytes(),
                     known.astype(np.int32).tobytes(), np.log10(backoff[known]).astype(np.float32).tobytes(), float(np.log10(backoff[0] / (len(amount) + 1))) if n == 1 else 0.0))
    return pa.table({"lang": [table.column("lang")[0].as_py()] * len(rows)} | {
        c: pa.array([r[k] for r in rows], t) for k, (c, t) in enumerate(
            [("gram", pa.int32()), ("keys", pa.binary()), ("chances", pa.binary()), ("contexts", pa.binary()), ("backoffs", pa.binary()), ("unseen", pa.float64())])})


def language_models(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per language and order."""
    return gram_counts(docs, id_col, text_col, lang_col).groupBy("lang").applyInArrow(
        fit_language, "lang string, gram int, keys binary, chances binary, contexts binary, backoffs binary, unseen double")


def side_by_side(rows: list, langs: list[str]) -> dict:
    """The models of some languages on common sorted keys: chances (1 where missing), back-offs (0)."""
    out: dict = {"langs": langs, "orders": [], "unseen": np.zeros(len(langs), np.float32)}
    for n in range(1, ORDER + 1):
        mine = {r["lang"]: r for r in rows if r["gram"] == n}
        pair = []
        for names, values, missing in (("keys", "chances", 1.0), ("contexts", "backoffs", 0.0)):
            keys = {lang: np.frombuffer(r[names], np.int32) for lang, r in mine.items()}
            every = np.unique(np.concatenate(list(keys.values())))
            matrix = np.full((len(every), len(langs)), missing, np.float32)
            for lang, own in keys.items():
                matrix[np.searchsorted(every, own), langs.index(lang)] = np.frombuffer(mine[lang][values], np.float32)
            pair += [every, matrix]
        out["orders"].append(tuple(pair))
        if n == 1:
            out["unseen"] = np.array([mine[lang]["unseen"] for lang in langs], np.float32)
    return out


def sought(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    out = values[at]
    out[keys[at] != wanted] = missing
    return out


def run_scores(runs: list[str], model: dict) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability of each run by each language, and its number of characters with the end."""
    run, orders = grams(runs)
    chance = np.empty((len(run), len(model["langs"])), np.float32)
    for n, (places, key, _, context, _) in enumerate(orders, 1):
        keys, chances, contexts, backoffs = model["orders"][n - 1]
        seen = sought(keys, chances, key, 1.0)
        if n == 1:
            chance[places] = np.where(seen > 0, model["unseen"], seen)
        else:
            chance[places] = np.where(seen > 0, chance[places] + sought(contexts, backoffs, context, 0.0), seen)
    places = orders[0][0]
    totals = np.zeros((len(runs), len(model["langs"])))
    for k in range(totals.shape[1]):
        totals[:, k] = np.bincount(run[places], chance[places, k], len(runs))
    return totals, np.bincount(run[places], minlength=len(runs))


def entropies(docs: DataFrame, model, id_col: str, text_col: str) -> DataFrame:
    """``id, names, entropies``: log10 per character by language; empty for texts without letters."""

    def score(batches):
        known: dict[str, int] = {}
        totals, lengths = np.zeros((0, len(model.value["langs"]))), np.zeros(0, np.int64)
        for batch in batches:
            if len(known) > RUNS:
                known, totals, lengths = {}, totals[:0], lengths[:0]
            texts = [[known.setdefault(r, len(known)) for r in runs_of(t)] for t in batch.column(1).to_pylist()]
            fresh = list(known)[len(totals):]
            for k in range(0, len(fresh), 50_000):
                t, n = run_scores(fresh[k:k + 50_000], model.value)
                totals, lengths = np.concatenate([totals, t]), np.concatenate([lengths, n])
            out = [(-totals[x].sum(0) / lengths[x].sum()).tolist() if x else None for x in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([model.value["langs"] if x else None for x in out], pa.list_(pa.string())), pa.array(out, pa.list_(pa.float64()))],
                names=["id", "names", "entropies"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(score, ENTROPY_DDL)


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model_bytes: int = MODEL_BYTES) -> DataFrame:
    """``id, held_out, lang_pred, score, entropy, rejected`` of every row."""
    spark = docs.sparkSession
    models = stored(language_models(docs, id_col, text_col, lang_col))
    sizes = models.groupBy("lang").agg(F.sum(sum(F.octet_length(c) for c in ("keys", "chances", "contexts", "backoffs"))).alias("size")).orderBy("lang").collect()
    groups: list[list[str]] = []
    room = 0
    for lang, size in sizes:
        if not groups or room + size > model_bytes:
            groups.append([])
            room = 0
        groups[-1].append(lang)
        room += size
    held = F.coalesce(crc_bucket(F.col("id"), FOLDS) == HELD, F.lit(False))
    if not groups:
        return docs.select(F.col(id_col).cast("long").alias("id")).select(
            "id", held.alias("held_out"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("entropy"), F.lit(False).alias("rejected"))
    found, keyed, name = None, docs, id_col
    if len(groups) > 1:  # identifiers may be null or repeated: the passes meet by a row number
        keyed = stored(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias(text_col)).withColumn("row", F.monotonically_increasing_id()))
        name = "row"
    for group in groups:
        model = spark.sparkContext.broadcast(side_by_side(models.where(F.col("lang").isin(group)).collect(), group))
        if found is None:
            found = entropies(keyed, model, name, text_col)
        else:  # another pass over the documents
            more = entropies(keyed, model, name, text_col).select("id", F.col("names").alias("n2"), F.col("entropies").alias("e2"))
            found = found.join(more, "id").select("id", F.concat("names", "n2").alias("names"), F.concat("entropies", "e2").alias("entropies"))
    if len(groups) > 1:
        found = found.withColumnRenamed("id", "row").join(keyed.select("row", "id"), "row").drop("row")
    least = F.array_min("entropies")
    share = 1 / F.aggregate("entropies", F.lit(0.0), lambda s, e: s + F.exp((least - e) * (SHARPNESS * float(np.log(10)))))
    best = F.element_at("names", F.array_position("entropies", least).cast("int"))
    scored = stored(found.select(
        "id", held.alias("held_out"), F.coalesce(best, F.lit("und")).alias("lang_pred"), F.coalesce(share, F.lit(0.0)).alias("score"), least.alias("entropy")))
    cuts = scored.where("NOT held_out AND id IS NOT NULL").groupBy("lang_pred").agg(F.percentile_approx("entropy", ACCEPTED, 10_000).alias("cut"))
    return scored.join(F.broadcast(cuts), "lang_pred", "left").select(  # a row per language
        "id", "held_out", "lang_pred", "score", "entropy", F.coalesce(F.col("entropy") > F.col("cut"), F.lit(False)).alias("rejected"))


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    return identified(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
