"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

A token's probability is P(class | history) x P(token | class).  Classes are the end of a text, a
repeat of the last or the last but one token, the most frequent words (one each), and hashed word
endings.  The class softmax sums hashed features of the history: class pairs of the last two tokens,
skip features of the classes before them, and the last word with marks of repetition.  The word
softmax has one weight per word, so its maximum-entropy solution is the smoothed relative frequency
within the class.

Training is a sequence of rounds, each over another part of the training texts: every task starts
from the model of the round before, takes AdaGrad steps over minibatches of its texts, and hands on
its weights; the mean over all tasks, by their tokens, is the next model.  The sums stream through
two shuffles, first by salt, so no task gathers all.  The model has ``ROWS`` x classes weights
whatever the corpus, and so has its broadcast.

Word counts are exact.  The most frequent words (at most ``FREQUENT``) are broadcast with their
counts; the rarer tokens of each text are shuffled once by word to meet their counts, so any
vocabulary can be scored.

A null or empty text is one end token.  A null identifier is neither learned nor held out.  Repeated
rows are scored each.  If nothing was learned, both scores are those of a single unknown word.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.llm.common import crc_bucket, stored
from meterloom.llm.quality import kth_largest

FOLDS, HELD = 5, 1
FREQUENT, OWN, CLASSES, ROWS, FEATURES = 200_000, 24, 48, 1 << 14, 3
ROUNDS, RATE, MINIBATCH, FLUSH = 2, 0.2, 8_192, 300_000
END, REPEAT, REPEAT2, FIRST = 0, 1, 2, 3
END_TOKEN = b"\n"
MARKS = b".,;:!?"
#: Weights travel in pieces of so many rows.
PIECE = 1 << 10


def tokens(text: bytes) -> list[bytes]:
    """Folded words and the end, of one text; ``split_words`` cuts whole columns alike."""
    return [*text.lower().split(), END_TOKEN]


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Folded words of texts end to end, without the ends, and the number of words of each text; a null text has none."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, lengths = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    real = pc.greater(pc.binary_length(words), 0)  # white space at either end splits off an empty piece
    blank = np.nonzero(~real.to_numpy(zero_copy_only=False))[0]
    if len(blank):
        lengths -= np.bincount(np.searchsorted(np.cumsum(lengths), blank, side="right"), minlength=len(lengths))
        words = words.filter(real)
    return words.cast(pa.binary()), lengths


def ending_class(word: bytes) -> int:
    """The class of a word without a class of its own: by its last two letters."""
    ending = word.rstrip(MARKS).decode("utf-8", "replace")[-2:]
    return FIRST + OWN + xxhash.xxh32_intdigest(ending) % (CLASSES - FIRST - OWN)


class Vocabulary:
    """Class, hash and count of words, numbered as they come; count 0 for words that are not frequent."""

    def __init__(self, frequent: dict[bytes, tuple[int, int]]) -> None:
        self.frequent, self.codes, self.words, self.table = frequent, {}, [], np.zeros((3, 1 << 16), np.int64)

    def encode(self, words: pa.Array) -> np.ndarray:
        met = words.dictionary_encode()
        distinct = met.dictionary.to_numpy(zero_copy_only=False).tolist()
        out = np.fromiter(map(self.codes.get, distinct, repeat(-1)), np.int64, len(distinct))
        missing = np.nonzero(out < 0)[0]
        if len(missing):
            out[missing] = np.arange(len(missing)) + len(self.codes)
            self.add([distinct[k] for k in missing.tolist()])
        return out[met.indices.to_numpy()]

    def clear(self) -> None:
        self.codes.clear()
        self.words.clear()

    def add(self, words: list[bytes]) -> None:
        first = len(self.codes)
        self.codes.update(zip(words, range(first, first + len(words))))
        self.words += words
        while self.table.shape[1] < len(self.codes):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)], axis=1)
        known = [self.frequent.get(w, (-1, 0)) for w in words]
        self.table[:, first:len(self.codes)] = (
            [kind if kind >= 0 else ending_class(w) for w, (kind, _) in zip(words, known)], list(map(xxhash.xxh32_intdigest, words)), [n for _, n in known])


def batch_codes(vocabulary: Vocabulary, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all tokens of the texts end to end, and the number of tokens of each text."""
    if len(vocabulary.codes) > FLUSH:
        vocabulary.clear()
    words, lengths = split_words(texts)
    end = vocabulary.encode(pa.array([END_TOKEN], pa.binary()))
    return np.insert(vocabulary.encode(words), np.cumsum(lengths), end[0]), lengths + 1


def history(classes: np.ndarray, hashes: np.ndarray, lengths: np.ndarray):
    """Class of every token (repeats have their own) and the rows of its features."""
    at = np.arange(len(classes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)  # place in its text
    beyond = CLASSES  # the class before the start of a text

    def back(values: np.ndarray, n: int, missing: int) -> np.ndarray:
        out = np.full(len(values), missing, np.int64)
        out[n:] = values[:-n or None]
        out[at < n] = missing
        return out

    c1, c2, c3, c4 = (back(classes, n, beyond) for n in (1, 2, 3, 4))
    h1, h2, h3 = (back(hashes, n, -n) for n in (1, 2, 3))
    kind = classes.copy()
    kind[(hashes == h2) & (classes != END)] = REPEAT2
    kind[(hashes == h1) & (classes != END)] = REPEAT
    same = (h1 == h2) + 2 * (h1 == h3)

    def row(values: np.ndarray, feature: int) -> np.ndarray:
        mixed = (values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(feature * 0x632BE59B)) * np.uint64(0xD6E8FEB86659FD93)
        return (mixed >> np.uint64(64 - 14)).astype(np.uint16)

    wide = CLASSES + 1
    return kind, [row(c1 * wide + c2, 1), row(c3 * wide + c4, 2), row(h1 * 4 + same, 3)]


def buffers() -> np.ndarray:
    """Room for two minibatches of class values, used again and again: fresh pages cost more than the sums in them."""
    return np.empty((2, MINIBATCH, CLASSES), np.float32)


def raised(weights: np.ndarray, rows: list[np.ndarray], held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(class | features) but for a factor, a row per token, and the factors."""
    out, other = held[:, :len(rows[0])]
    np.take(weights, rows[0], axis=0, out=out, mode="clip")
    for r in rows[1:]:
        out += np.take(weights, r, axis=0, out=other, mode="clip")
    np.exp(np.clip(out, -30, 30, out=out), out=out)
    return out, 1 / (out @ np.ones(out.shape[1], np.float32))


def chances(weights: np.ndarray, rows: list[np.ndarray], held: np.ndarray | None = None) -> np.ndarray:
    """P(class | features), a row per token."""
    out, factors = raised(weights, rows, buffers() if held is None else held)
    out *= factors[:, None]
    return out


def run_sums(values: np.ndarray, order: np.ndarray, starts: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Sums of the runs of ``values[order]`` that begin at ``starts``, as ``add.reduceat`` gives them, bit by bit.

    ``reduceat`` makes a call for each run and column, so it is left the runs of more than eight rows; the
    others are added up row by row, all runs at once.
    """
    lengths = np.diff(starts, append=len(order))
    out = np.empty((len(starts), values.shape[1]), values.dtype)
    longer = lengths > 8
    rows = order[np.repeat(longer, lengths)]
    if len(rows):
        ends = np.cumsum(lengths[longer])
        out[longer] = np.add.reduceat(np.take(values, rows, axis=0, out=room[:len(rows)], mode="clip"), ends - lengths[longer], axis=0)
    brief = np.nonzero(~longer)[0]
    brief = brief[np.argsort(-lengths[brief], kind="stable")]
    lengths, starts = lengths[brief], starts[brief]
    rest = np.zeros((len(brief), values.shape[1]), values.dtype)
    for k in range(1, 8):
        n = np.searchsorted(-lengths, -k)  # the runs of more than k rows come first
        if n:
            rest[:n] += np.take(values, order[starts[:n] + k], axis=0, out=room[:n], mode="clip")
    rest += np.take(values, order[starts], axis=0, out=room[:len(brief)], mode="clip")
    out[brief] = rest
    return out


def descend(weights: np.ndarray, slopes: np.ndarray, kind: np.ndarray, rows: list[np.ndarray], held: np.ndarray) -> None:
    """One AdaGrad step on a minibatch, in place."""
    error = chances(weights, rows, held)
    error[np.arange(len(kind)), kind] -= 1
    for r in rows:
        order = np.argsort(r, kind="stable")
        sorted_rows = r[order]
        starts = np.nonzero(np.concatenate([[True], sorted_rows[1:] != sorted_rows[:-1]]))[0]
        gradient = run_sums(error, order, starts, held[1])
        touched = sorted_rows[starts]
        slope = slopes[touched] + gradient * gradient
        slopes[touched] = slope
        weights[touched] -= RATE * gradient / np.sqrt(slope)


def word_counts(texts: DataFrame) -> DataFrame:
    """``word, n`` of the tokens of the frame ``text``; words are counted in the task first."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for j in range(0, batch.num_rows, 50):
                words, lengths = split_words(batch.column(0)[j:j + 50])
                met, n = words.value_counts().flatten()
                seen.update(dict(zip(met.to_numpy(zero_copy_only=False).tolist(), n.to_numpy().tolist())))
                seen[END_TOKEN] += len(lengths)
                if len(seen) > FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], schema=schema)
                    seen = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], schema=schema)

    return texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def averaged(trained: DataFrame, parts: int) -> np.ndarray:
    """The mean of all tasks' weights, by their tokens: first by piece and salt, then by piece."""
    shape = (PIECE, CLASSES)

    def add(batches):
        sums: dict[int, list] = {}
        for batch in batches:
            for piece, n, data in zip(*(c.to_pylist() for c in batch.columns)):
                own = sums.setdefault(piece, [0, np.zeros(shape)])
                own[0] += n
                own[1] += n * np.frombuffer(data, np.float32).reshape(shape)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([n for n, _ in sums.values()], pa.int64()),
             pa.array([(w / n).astype(np.float32).tobytes() for n, w in sums.values()], pa.binary())],
            names=["piece", "tokens", "weights"])

    ddl = "piece int, tokens long, weights binary"
    by_salt = trained.repartition(parts, "piece", "salt").select("piece", "tokens", "weights").mapInArrow(add, ddl)
    weights = np.zeros((ROWS, CLASSES), np.float32)
    for piece, _, data in by_salt.repartition(ROWS // PIECE, "piece").mapInArrow(add, ddl).collect():
        weights[piece * PIECE:(piece + 1) * PIECE] = np.frombuffer(data, np.float32).reshape(shape)
    return weights


def train(learned: DataFrame, frequent) -> np.ndarray:
    """Weights of the class softmax from the frame ``round, text``; ``frequent`` is broadcast."""
    sc = learned.sparkSession.sparkContext
    parts = int(learned.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    weights = np.zeros((ROWS, CLASSES), np.float32)
    for k in range(ROUNDS):
        start = sc.broadcast(weights)

        def run(batches, start=start):
            own, slopes, vocabulary, seen = start.value.copy(), np.full((ROWS, CLASSES), 1e-2, np.float32), Vocabulary(frequent.value), 0
            held = buffers()
            for batch in batches:
                for j in range(0, batch.num_rows, 500):
                    codes, lengths = batch_codes(vocabulary, batch.column(0)[j:j + 500])
                    classes, hashes, _ = vocabulary.table
                    kind, rows = history(classes[codes], hashes[codes], lengths)
                    for m in range(0, len(kind), MINIBATCH):
                        descend(own, slopes, kind[m:m + MINIBATCH], [r[m:m + MINIBATCH] for r in rows], held)
                    seen += len(kind)
            if seen:
                salt, pieces = TaskContext.get().partitionId() % 64, range(ROWS // PIECE)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pieces, pa.int32()), pa.array([salt] * len(pieces), pa.int32()), pa.array([seen] * len(pieces), pa.int64()),
                     pa.array([own[p * PIECE:(p + 1) * PIECE].tobytes() for p in pieces], pa.binary())],
                    names=["piece", "salt", "tokens", "weights"])

        part = learned.where(F.col("round") == k).select("text")
        weights = averaged(part.mapInArrow(run, "piece int, salt int, tokens long, weights binary"), parts)
    return weights


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    remainder = crc_bucket(F.col(id_col), FOLDS)
    learned = docs.where(remainder != HELD).select(F.pmod(F.xxhash64(id_col), F.lit(ROUNDS)).alias("round"), F.col(text_col).cast("string").alias("text"))
    counts = stored(word_counts(learned.select("text")))
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    cut = kth_largest(counts, "n", FREQUENT) or 0
    common = counts.where((F.col("word") != END_TOKEN) & (F.col("n") > cut)).orderBy(F.desc("n"), "word").collect()
    # Frequent words with a class of their own, and the counts of all frequent words.
    frequent = {bytes(w): (FIRST + k if k < OWN else -1, n) for k, (w, n) in enumerate(common)}
    ended = counts.where(F.col("word") == END_TOKEN).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent[END_TOKEN] = (END, ended)
    frequent = sc.broadcast(frequent)

    def classed(batches):
        for batch in batches:
            kinds = np.array([END if w == END_TOKEN else k if (k := frequent.value.get(w, (-1,))[0]) >= 0 else ending_class(w) for w in batch.column(0).to_pylist()], np.int64)
            n = batch.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(CLASSES)), pa.array(np.bincount(kinds, n, CLASSES).astype(np.int64)), pa.array(np.bincount(kinds, minlength=CLASSES))], names=["kind", "n", "v"])

    sizes = {r[0]: (r[1], r[2]) for r in counts.select("word", "n").mapInArrow(classed, "kind long, n long, v long").groupBy("kind").agg(F.sum("n"), F.sum("v")).collect()}
    within = np.array([math.log10(sizes.get(k, (0, 0))[0] + 0.5 * (sizes.get(k, (0, 0))[1] + 1)) for k in range(CLASSES)])
    model = sc.broadcast((train(learned, frequent), within))

    word = pa.struct([("word", pa.binary()), ("n", pa.int64()), ("fresh", pa.int64())])
    schema = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("all_logs", pa.float64()),
                        ("fresh_logs", pa.float64()), ("rest", pa.float64()), ("words", pa.list_(word))])

    def score(batches):
        weights, inner = model.value
        held, vocabulary, number, place = buffers(), Vocabulary(frequent.value), 0, TaskContext.get().partitionId()
        for batch in batches:
            for j in range(0, batch.num_rows, 500):
                codes, lengths = batch_codes(vocabulary, batch.column(1)[j:j + 500])
                classes, hashes, counted = (column[codes] for column in vocabulary.table)
                kind, rows = history(classes, hashes, lengths)
                chance = np.empty(len(kind))
                for m in range(0, len(kind), MINIBATCH):
                    out, factors = raised(weights, [r[m:m + MINIBATCH] for r in rows], held)
                    chance[m:m + MINIBATCH] = out[np.arange(len(factors)), kind[m:m + MINIBATCH]] * factors
                fresh = (kind != REPEAT) & (kind != REPEAT2)  # a repeat names its word; other classes choose one
                logs, doc = np.where(counted > 0, np.log10(counted + 0.5), 0.0), np.repeat(np.arange(len(lengths)), lengths)
                sums = [np.bincount(doc, x, len(lengths)) for x in (
                    counted > 0, logs, logs * fresh, np.log10(np.maximum(chance, 1e-30)) - inner[classes] * fresh)]
                rare = np.nonzero(counted == 0)[0]
                # One entry per text and rare word: its tokens, and those of them that are no repeats.
                entry, at = np.unique(doc[rare] * len(vocabulary.words) + codes[rare], return_inverse=True)
                ends = np.concatenate([[0], np.cumsum(np.bincount(entry // len(vocabulary.words), minlength=len(lengths)))])
                entries = pa.StructArray.from_arrays(
                    [pa.array([vocabulary.words[k] for k in (entry % len(vocabulary.words)).tolist()], pa.binary()), pa.array(np.bincount(at, minlength=len(entry))),
                     pa.array(np.bincount(at, fresh[rare], len(entry)).astype(np.int64))], fields=list(word))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(number, number + len(lengths)) + (place << 40)), batch.column(0)[j:j + 500], pa.array(lengths), pa.array(sums[0].astype(np.int64)),
                     *(pa.array(x) for x in sums[1:]), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), entries)], schema=schema)
                number += len(lengths)

    found = stored(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(
        score, "row long, id long, n_tokens long, n_known long, all_logs double, fresh_logs double, rest double, words array<struct<word: binary, n: long, fresh: long>>"))
    rare = found.select("row", F.inline("words")).join(counts.select("word", F.col("n").alias("c")), "word", "left")
    log = F.log10(F.coalesce("c", F.lit(0)) + 0.5)
    rare = rare.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("k"), F.sum(F.col("n") * log).alias("a"), F.sum(F.col("fresh") * log).alias("f"))
    none = lambda c: F.coalesce(c, F.lit(0))
    return found.drop("words").join(rare, "row", "left").select(
        "id", F.coalesce(crc_bucket(F.col("id"), FOLDS) == HELD, F.lit(False)).alias("held_out"), "n_tokens", (F.col("n_known") + none("k")).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("all_logs") + none("a") - F.col("n_tokens") * math.log10(total + 0.5 * (distinct + 1))).alias("base_score"),
        (F.col("rest") + F.col("fresh_logs") + none("f")).alias("score"))


def op2_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
