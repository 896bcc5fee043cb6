"""Quality by importance resampling: two hashed n-gram models and a Gumbel top-k.

A text's features are its words, its word shapes (case, digits, marks at the end, repeat of the word
before) and pairs of neighbouring shapes, hashed into ``BUCKETS`` buckets.  The raw model counts all
documents; the target model counts labelled good documents of the training folds, at most ``TARGETS``
of them, drawn by hash.  Both are smoothed alike, and a document's log weight is the sum of the log
ratios of its features: how much likelier the target makes it.

The number to keep, k, is the number of documents whose weight reaches the cut: that of the raw text
itself (0), or lower if need be so that ``SPARED`` of the good documents of the fold left out of
training reach it.  Which documents are kept is a sample
without replacement in proportion to the weights: the k largest of log weight plus Gumbel noise.

A few toxic words change the sum over a whole text little, so toxicity has a ratio of its own: in how
many toxic and in how many good documents of the training folds a hashed word occurs.  A document's
toxicity is the sum over its worst ``SPAN`` neighbouring words; above what ``SPARED`` of the good
documents of the fold left out stay at, it is rejected before the sample is drawn.

The noise is a hash of the identifier, so reruns agree.  The k-th largest key is found by counting
in ever finer bins; nothing is sorted or gathered.

Null and empty texts have weight and toxicity 0; without toxic labels nothing is toxic.  Labels may be missing (everything is kept if no document is
labelled good), repeated, or name unknown documents.  Repeated rows share weight and noise, rows
that tie with the k-th key are all kept, an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from meterloom.llm.common import arrow, crc_bucket, each_utf8, stored, unused

BUCKETS = 1 << 16
TARGETS, FOLDS, SPARED, PSEUDO, SEED = 50_000, 4, 0.998, 10.0, 11
#: Neighbouring words that are judged together for toxicity, and the documents added to both counts of a word.
SPAN, FEW = 8, 3.0
CACHE = 100_000


def word_code(word: bytes) -> int:
    """52 bits that stand for the word, then 12 for its shape."""
    text = word.decode("utf-8", "replace")
    case = "U" if len(text) > 1 and text.isupper() else "T" if text[:1].isupper() else "d" if any(c.isdigit() for c in text) else "l"
    marks = "".join(sorted({c for c in text[-3:] if not c.isalnum()}))
    return (xxhash.xxh64_intdigest(word) & ~0xFFF) | (xxhash.xxh64_intdigest((case + marks).encode()) & 0xFFF)


class Features:
    """Buckets of the features of texts, with a bounded memory of words."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def __call__(self, text: bytes) -> np.ndarray:
        words, known = text.split(), self.known
        if len(known) > CACHE:
            known.clear()
        get = known.get
        codes = np.fromiter((get(w, 0) for w in words), np.uint64, len(words))
        for k in np.nonzero(codes == 0)[0].tolist():
            codes[k] = known[words[k]] = known.get(words[k]) or word_code(words[k])
        shape = codes & np.uint64(0xFFF)
        shape[1:] |= np.where(codes[1:] == codes[:-1], np.uint64(1 << 12), np.uint64(0))
        mix = np.uint64(0x9E3779B97F4A7C15)
        pair = (shape[1:] << np.uint64(13) | shape[:-1]) + np.uint64(1 << 40)
        return ((np.concatenate([codes >> np.uint64(12), shape, pair]) * mix) >> np.uint64(48)).astype(np.int64)


def noise(key: int | None, seed: int) -> float:
    u = (xxhash.xxh64_intdigest(f"{seed}:{key}") + 0.5) / 2**64
    return -math.log(-math.log(u))


def kth_largest(df: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest value (of doubles without NaN), by counting in bins; None when there are fewer."""
    low, high, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if not 0 < k <= n:
        return None
    while low < high:
        step = (high - low) / 1024
        if low + step <= low:
            break
        place = F.least(F.lit(1023), F.floor((F.col(column) - low) / step))
        bins = df.where(F.col(column).between(low, high)).groupBy(place.alias("bin")).agg(
            F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).orderBy(F.desc("bin")).collect()
        for b in bins:
            if k <= b["n"]:
                low, high = b["low"], b["high"]
                break
            k -= b["n"]
    return high


GOOD, TOXIC = "quality = 1 AND coalesce(toxic, 0) = 0", "toxic = 1"


def good_ids(labels: DataFrame, id_col: str = "doc_id", limit: int = TARGETS, which: str = GOOD) -> DataFrame:
    """``id, fold`` of documents labelled good and not toxic (or toxic), about ``limit`` of them, drawn by hash."""
    good = labels.where(which).select(F.col(id_col).cast("long").alias("id")).where("id IS NOT NULL").distinct()
    share = min(1.0, limit / max(1, good.count()))
    return good.where(F.pmod(F.xxhash64("id", F.lit("target")), F.lit(1 << 30)) < int(share * (1 << 30))).withColumn("fold", crc_bucket(F.col("id"), FOLDS))


def words_of(found: np.ndarray) -> np.ndarray:
    """The buckets of the words among the features of a text, in order."""
    return found[:(len(found) + 1) // 3]


def toxicity(found: np.ndarray, ratios: np.ndarray) -> float:
    """The largest sum of ratios over ``SPAN`` neighbouring words (all, if there are fewer), at least 0."""
    sums = np.concatenate([[0.0], np.cumsum(ratios[words_of(found)])])
    span = min(SPAN, len(sums) - 1)
    return max(0.0, float((sums[span:] - sums[:len(sums) - span]).max()))


def fit_ratios(docs: DataFrame, good: DataFrame, toxic: DataFrame, id_col: str, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Log ratios for every bucket: target to raw by occurrences, toxic to good by documents with the word."""
    chosen, marked = (docs.sparkSession.sparkContext.broadcast(np.sort(np.array([r[0] for r in d.where("fold <> 0").select("id").collect()], np.int64))) for d in (good, toxic))

    def count(batches):
        # Of the last two counts, the place behind the buckets holds the number of documents.
        features, counts = Features(), np.zeros((4, BUCKETS + 1), np.int64)
        raw, target, clean, bad = counts
        for batch in batches:
            ids, named = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False), batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for text, is_target, is_bad in zip(each_utf8(batch.column(1)), np.isin(ids, chosen.value) & named, np.isin(ids, marked.value) & named):
                found = features(text)
                np.add.at(raw, found, 1)
                if is_target:
                    np.add.at(target, found, 1)
                if is_target or is_bad:
                    (bad if is_bad else clean)[np.append(np.unique(words_of(found)), BUCKETS)] += 1
        some = np.nonzero(counts.any(0))[0]
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(c[some]) for c in counts)], names=["bucket", "raw", "target", "clean", "bad"])

    counted = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(count, "bucket long, raw long, target long, clean long, bad long")
    sums = np.zeros((4, BUCKETS + 1))
    for bucket, *row in counted.groupBy("bucket").agg(*[F.sum(c) for c in ("raw", "target", "clean", "bad")]).collect():
        sums[:, bucket] = row
    (raw, target), (clean, bad) = sums[:2, :BUCKETS], sums[2:, :BUCKETS]
    n_clean, n_bad = sums[2:, BUCKETS]
    likelier = np.log((target + PSEUDO) / (raw * (target.sum() / raw.sum()) + PSEUDO)) if target.sum() else np.zeros(BUCKETS)
    worse = np.log((bad + FEW) / (clean * (n_bad / n_clean) + FEW)) if n_bad and n_clean else np.zeros(BUCKETS)
    return likelier, worse


def scored(docs: DataFrame, ratios, id_col: str, text_col: str, seed: int, given: list[str], names: list[str]) -> DataFrame:
    """The columns ``given`` of every row with its log weight, key and toxicity under ``names``."""
    key, text, *rest = (docs.columns.index(c) for c in (id_col, text_col, *given))
    marks = pa.schema([(n, pa.float64()) for n in names])

    def run(batches):
        features = Features()
        for batch in batches:
            rows = []
            for i, t in zip(batch.column(key).to_pylist(), each_utf8(batch.column(text))):
                found = features(t)
                weight = float(ratios.value[0][found].sum())
                rows.append((weight, weight + noise(i, seed), toxicity(found, ratios.value[1])))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in rest), *arrow(rows, marks).columns], names=[*given, *names])

    return docs.mapInArrow(run, StructType([*(docs.schema[c] for c in given), *(StructField(n, DoubleType()) for n in names)]))


def fitted(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, seed: int, given: list[str]):
    """The stored scores, the names of their marks, the key that a kept document reaches and the toxicity that it may have."""
    good, toxic = (stored(good_ids(labels, id_col, which=which)) for which in (GOOD, TOXIC))
    good = good.join(toxic.select("id"), "id", "left_anti")  # labels that disagree
    ratios = docs.sparkSession.sparkContext.broadcast(fit_ratios(docs, good, toxic, id_col, text_col))
    names = unused(docs, "log_weight", "key", "toxicity")
    scores = stored(scored(docs, ratios, id_col, text_col, seed, given, names))
    marks = scores.select(F.col(id_col).cast("long").alias("id"), *[F.col(n).alias(c) for n, c in zip(names, ("log_weight", "key", "toxicity"))])
    held = stored(marks.join(good.where("fold = 0"), "id").select("log_weight", "toxicity"))
    count = held.count()
    cut = kth_largest(held, "log_weight", max(1, math.ceil(SPARED * count)))
    if cut is None:
        return scores, names, -math.inf, math.inf
    most = kth_largest(held, "toxicity", count - math.ceil(SPARED * count) + 1)
    clean = marks.where(F.col("toxicity") <= most)
    k = clean.where(F.col("log_weight") >= min(cut, 0.0)).count()  # what the target makes likelier always counts
    least = kth_largest(clean, "key", k)
    return scores, names, -math.inf if least is None else least, most


def resampled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """``id, log_weight, key, kept`` of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    scores, (weight, key, worst), least, most = fitted(rows, labels, id_col, text_col, seed, [id_col])
    kept = (F.col(key) >= least) & (F.col(worst) <= most)
    return scores.select(F.col(id_col).alias("id"), F.col(weight).alias("log_weight"), F.col(key).alias("key"), kept.alias("kept"))


def kept_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """The kept rows with all their columns; rows and scores are stored together, so no text is scored again."""
    scores, names, least, most = fitted(docs, labels, id_col, text_col, seed, docs.columns)
    return scores.where((F.col(names[1]) >= least) & (F.col(names[2]) <= most)).drop(*names)


def op5_quality_resampling(spark, sf_dir: str) -> DataFrame:
    found = resampled(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.withColumnRenamed("id", "doc_id")
