"""Benchmark decontamination: a BM25 index of test items, searched by every training passage.

The terms of the index are pairs of neighbouring words (the word itself for an item of one word):
single words of the items stand in nearly every passage and would prune nothing.  An item's postings
carry BM25 impacts, scaled by the item's score against itself, so a passage's score is the share of
the item that it covers and one threshold serves all items.  Passages are
overlapping windows, twice as long as the longest item of the index (128 words at least), so every
item lies whole in some window.  Every window of every document is a query that retrieves all items
at or above the threshold by block-max WAND.  Before that a bound is summed over the window from
the rare terms alone: common terms cannot add more than their largest total within one item.  What
is retrieved is verified: the share of the question's word trigrams and, where the item has an
answer of its own, of the answer's word pairs that the window holds.  An item that is one text is
verified as a whole, by its trigrams.

Terms and statistics of the items are Spark aggregates.  The index is dealt into shards of bounded
text (``SHARD_BYTES``), each broadcast and searched in a pass over the documents, which stay where
they are: no document is shuffled, however often its passages are shared.

Null and empty texts hold nothing, items without words match nothing, repeated items count once,
repeated documents are each reported, null identifiers stay null, empty tables give an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.llm.common import arrow, stored

K1, B = 1.2, 0.75
THRESHOLD, QUESTION, ANSWER = 0.5, 0.6, 0.6
WINDOW, BLOCK, SHARD_BYTES = 128, 16, 4 << 20
TOKEN = re.compile(r"\w+")

POSTING = pa.schema([("item", pa.int64()), ("term", pa.string()), ("tf", pa.int64()), ("length", pa.int64())])
HIT = pa.schema([("id", pa.int64()), ("item_id", pa.int64()), ("at_word", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])
HIT_DDL = "id long, item_id long, at_word long, score double, question_overlap double, answer_overlap double"


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def grams(words: list[str], n: int) -> set[tuple]:
    return {tuple(words[k:k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()


def share(part: list[str], window: list[str], n: int) -> float:
    """Share of the n-grams of a part (shorter ones if it is shorter) that a window holds."""
    n = min(n, len(part))
    return len(grams(part, n) & grams(window, n)) / len(grams(part, n)) if part else 1.0


def terms_of(words: list[str]) -> list[str]:
    return [f"{a} {b}" for a, b in pairwise(words)] if len(words) > 1 else words


def questions_of(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id, question, answer`` of items that are one text: all of it is the question, none of it the answer."""
    return items.select(F.col(id_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("question"), F.lit("").alias("answer"))


def _postings(batches):
    for batch in batches:
        rows = []
        for item, question, answer in zip(*(c.to_pylist() for c in batch.columns)):
            terms = terms_of(tokens(question) + tokens(answer))
            rows += [(item, term, n, len(terms)) for term, n in Counter(terms).items()]
        yield arrow(rows, POSTING)


def index_shards(items: DataFrame, shard_bytes: int = SHARD_BYTES):
    """Yield the shards of the index: plain values, ready to broadcast.  ``items`` has item_id, question, answer."""
    items = items.distinct().withColumn("item", F.xxhash64("item_id", "question", "answer"))
    items = stored(items)
    terms = stored(items.select("item", "question", "answer").mapInArrow(_postings, "item long, term string, tf long, length long"))
    count, longest, mean = terms.agg(F.count_distinct("item"), F.max("length"), F.sum("tf") / F.count_distinct("item")).first()
    if not count:
        return
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    weight = F.log(1 + (count - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / mean))
    scored = terms.join(df, "term").withColumn("weight", weight)
    own = scored.groupBy("item").agg(F.sum("weight").alias("own"))
    scored = stored(scored.join(own, "item").select("item", "term", "df", (F.col("weight") / F.col("own")).alias("impact")))
    size = items.agg(F.sum(F.coalesce(F.octet_length("question"), F.lit(0)) + F.coalesce(F.octet_length("answer"), F.lit(0)))).first()[0]
    shards = math.ceil(size / shard_bytes) or 1
    for shard in range(shards):
        mine = lambda d: d.where(F.pmod("item", F.lit(shards)) == shard)  # noqa: B023, E731
        texts = mine(items).orderBy("item").collect()
        number = {r["item"]: k for k, r in enumerate(texts)}
        lists: dict[str, list] = {}
        frequency: dict[str, int] = {}
        for r in mine(scored).orderBy("item").collect():
            lists.setdefault(r["term"], []).append((number[r["item"]], r["impact"]))
            frequency[r["term"]] = r["df"]
        # The most frequent terms are common as long as no item gets over half the threshold from them.
        mass, common = [0.0] * len(texts), set()
        for term in sorted(lists, key=lambda t: (-frequency[t], t)):
            if all(mass[k] + w <= THRESHOLD / 2 for k, w in lists[term]):
                common.add(term)
                for k, w in lists[term]:
                    mass[k] += w
        # Words get numbers and terms the codes (first word, second word); a term of one word has no second.
        words = {w: k for k, w in enumerate(sorted({w for term in lists for w in term.split(" ")}))}
        code = lambda t: words[t.split(" ")[0]] * (len(words) + 1) + (words[t.split(" ")[1]] if " " in t else len(words))
        postings, bounds = {}, {}
        for term, entries in lists.items():
            weights = [w for _, w in entries]
            postings[code(term)] = ([k for k, _ in entries], weights, [max(weights[k:k + BLOCK]) for k in range(0, len(weights), BLOCK)], max(weights))
            bounds[code(term)] = 0.0 if term in common else max(weights)
        checks = [(r["item_id"], tokens(r["question"]), tokens(r["answer"])) for r in texts]
        codes = np.array(sorted(bounds), np.int64)
        yield {"words": words, "codes": codes, "bounds": np.array([bounds[c] for c in codes.tolist()]), "postings": postings,
               "single": any(" " not in t for t in lists), "spare": max(mass, default=0.0), "checks": checks, "window": max(WINDOW, 2 * (longest + 1))}


def block_max_wand(postings: dict, terms: list, threshold: float) -> list[tuple[int, float]]:
    """All ``(item, score)`` with a score of at least the threshold."""
    cursors = [[*postings[t], 0] for t in terms]  # items, impacts, block maxima, bound, position
    found, floor = [], threshold - 1e-9
    while True:
        cursors = sorted((c for c in cursors if c[4] < len(c[0])), key=lambda c: c[0][c[4]])
        total, pivot = 0.0, None
        for c in cursors:
            total += c[3]
            if total >= floor:
                pivot = c[0][c[4]]
                break
        if pivot is None:
            return found
        ahead = [c for c in cursors if c[0][c[4]] <= pivot]
        bound, ends = 0.0, []
        for c in ahead:  # the block in which the pivot would stand
            items, block = c[0], c[4] // BLOCK
            while (block + 1) * BLOCK < len(items) and items[(block + 1) * BLOCK - 1] < pivot:
                block += 1
            bound += c[2][block]
            ends.append(items[min(len(items), (block + 1) * BLOCK) - 1])
        if bound < floor:  # nothing up to the nearest block end can reach the threshold
            beyond = max(pivot, min(ends)) + 1
            behind = [c[0][c[4]] for c in cursors if c[0][c[4]] > pivot]
            goal = min([beyond, *behind])
        else:
            goal = pivot
            if cursors[0][0][cursors[0][4]] == pivot:
                score = sum(c[1][c[4]] for c in ahead)
                if score >= floor:
                    found.append((pivot, score))
                goal = pivot + 1
        for c in ahead:
            items, at = c[0], c[4]
            while at < len(items) and items[at] < goal:
                at += 1
            c[4] = at


def term_places(ids: np.ndarray, spread: int, index: dict) -> tuple[np.ndarray, np.ndarray]:
    """Where the terms of the index stand in a text, in order, and their places in ``codes``."""
    found = []
    both = np.nonzero((ids[:-1] >= 0) & (ids[1:] >= 0))[0]
    found.append((both, ids[both] * spread + ids[both + 1]))
    if index["single"]:
        one = np.nonzero(ids >= 0)[0]
        found.append((one, ids[one] * spread + spread - 1))
    at, code = (np.concatenate(x) for x in zip(*found))
    place = np.minimum(np.searchsorted(index["codes"], code), len(index["codes"]) - 1)
    hit = index["codes"][place] == code
    order = np.argsort(at[hit], kind="stable")
    return at[hit][order], place[hit][order]


def contaminations(text: str | None, index: dict, threshold: float = THRESHOLD, question: float = QUESTION, answer: float = ANSWER) -> list[tuple]:
    """``(item_id, at_word, score, question share, answer share)`` of the best window per verified item.

    The answer share is null for an item without an answer.
    """
    words = tokens(text)
    number, spread = index["words"].get, len(index["words"]) + 1
    ids = np.fromiter((number(w, -1) for w in words), np.int64, len(words))
    at, codes = term_places(ids, spread, index)
    if not len(at):
        return []
    length = index["window"]
    sums = np.zeros(len(words) + 1)
    np.add.at(sums, at + 1, index["bounds"][codes])
    sums = np.cumsum(sums)
    starts = np.arange(0, max(1, len(words) - length // 2), length // 2)
    starts = starts[sums[np.minimum(starts + length, len(words))] - sums[starts] >= threshold - index["spare"] - 1e-6]
    best: dict = {}
    for start in starts.tolist():
        window = words[start:start + length]
        held = index["codes"][codes[np.searchsorted(at, start):np.searchsorted(at, start + length)]]
        for item, score in block_max_wand(index["postings"], np.unique(held).tolist(), threshold):
            name, asked, answered = index["checks"][item]
            q, a = share(asked, window, 3), share(answered, window, 2) if answered else None
            if q >= question and (a is None or a >= answer) and (name not in best or score > best[name][1]):
                best[name] = (start, round(score, 9), q, a)
    return [(name, *rest) for name, rest in best.items()]


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and item that it holds.  ``items`` has item_id, question, answer."""
    spark, out = docs.sparkSession, None
    for shard in index_shards(items):
        index = spark.sparkContext.broadcast(shard)

        def run(batches, index=index):
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                yield arrow([(i, *hit) for i, t in zip(ids, texts) for hit in contaminations(t, index.value)], HIT)

        hits = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, HIT_DDL)
        out = hits if out is None else out.union(hits)
    return spark.createDataFrame([], HIT_DDL) if out is None else out


def without_items(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that hold no item, with all their columns."""
    for shard in index_shards(items):
        index, place = docs.sparkSession.sparkContext.broadcast(shard), docs.columns.index(text_col)

        def run(batches, index=index, place=place):
            for batch in batches:
                yield batch.filter(pa.array([not contaminations(t, index.value) for t in batch.column(place).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    found = contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), questions_of(spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    return found.withColumnRenamed("id", "doc_id")
