"""Spelling variants by a dictionary of trie-node pairs.

The words go into two tries, one forward and one of the reversed words, whose nodes are numbered.  A
word of L letters passes L + 1 nodes of each: ``p[i]`` stands for its first ``i`` letters, ``s[i]`` for
its letters from ``i`` on.  The integer pair ``(p[i], s[i])`` stands for the whole word, ``(p[i], s[i + 1])``
for the word without letter ``i``.  Two words that differ by a replaced letter share a pair of the second
kind; a word and the same word with an inserted letter share one of the first with one of the second.  So
all words at a pair are neighbours of each other, no others are, and there are at most as many as letters
in the alphabet, plus one: no pair gathers more.  Where a letter repeats, only the first of its run counts
as the one inserted, so each two neighbours meet exactly once.

The tries are never in one place.  Words are sorted by range, and a node is new where a word leaves its
predecessor, so a task numbers the nodes of its range from its own number on and holds two words.  A
prefix that spans two ranges is a prefix of the later range's first word; the tries of these first words,
one per range, are numbered by the driver.

Occurrences are counted where they are scanned, in a bounded memory, and summed by word.  Forms lead to
words of at least ``TIMES`` the count, so following them ends after few steps, which double.

Null texts have no words; a null identifier counts as empty in the hash that plants variants; repeated
rows count each; other columns are ignored, whatever their names; an empty table gives an empty result.
Words and texts may be of any length: a word's nodes take work in proportion to its length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.llm.common import salted, stored, utf8

#: The letters, the shortest word, the fewest occurrences, how much commoner a form is, one run in so many is altered.
LETTERS = "A-Za-zÀ-ÿ"
SHORTEST, FEWEST, TIMES, EVERY = 7, 2, 10, 31
#: Distinct words that a scanning task counts before it hands them on; texts unpacked at a time; nodes handed on at a time.
GATHER, SLICE, NODES = 200_000, 64, 1 << 20
#: Bits of a node's or word's number within its range.
SHIFT = 40


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, every: int = EVERY) -> DataFrame:
    """``word, n`` of all words of at least ``shortest`` letters; one in ``every`` (document, run) has lost a letter."""

    def run(batches):
        counts: Counter = Counter()
        long_runs = re.compile(f"[{LETTERS}]{{{shortest},}}").findall

        def rows():
            words = list(counts.items())
            for k in range(0, len(words), 10_000):
                part = words[k:k + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.string()), pa.array([c for _, c in part], pa.int64())], names=["word", "n"])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for k in range(0, len(ids), SLICE):
                for i, text in zip(ids[k:k + SLICE], utf8(batch.column(1).slice(k, SLICE))):
                    start = zlib.crc32(b"%d:" % i if i is not None else b":")
                    for word, count in Counter(long_runs(text.lower().decode())).items():
                        code = zlib.crc32(word.encode(), start)
                        if code % every == 0:
                            gone = code % len(word)
                            word = word[:gone] + word[gone + 1:]
                            if len(word) < shortest:
                                continue
                        counts[word] += count
                    if len(counts) > GATHER:
                        yield from rows()
                        counts.clear()
        yield from rows()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    if b.startswith(a):
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a.startswith(b[:mid]) else (low, mid - 1)
    return low


def grown(nodes: np.ndarray, old: int, length: int, first: int) -> np.ndarray:
    """The nodes of a word that shares ``old`` letters with a numbered one; its own are counted from ``first``."""
    return np.concatenate([nodes[:old + 1], np.arange(first, first + length - old)])


def numbered(words: list[str], first: int = 1) -> list[np.ndarray]:
    """The trie nodes that each of the sorted words passes, from the root, which is 0."""
    out: list[np.ndarray] = []
    last, nodes = "", np.zeros(1, np.int64)
    for word in words:
        old = shared(last, word)
        nodes = grown(nodes, old, len(word), first)
        last, first = word, first + len(word) - old
        out.append(nodes)
    return out


def trie_nodes(words: DataFrame, column: str) -> DataFrame:
    """The distinct words with their ``part`` and place ``at`` in the order of all, the ``nodes`` each passes, and whether each letter ``leads`` its run."""
    others = [c for c in words.columns if c != column]
    schema = ", ".join(["part int, at long", *(f"{c} {words.schema[c].dataType.simpleString()}" for c in (column, *others))])

    def place(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(batch), pa.int32()), pa.array(range(at, at + len(batch)), pa.int64()), *batch.columns], names=["part", "at", *batch.schema.names])
            at += len(batch)

    ranged = stored(words.select(column, *others).repartitionByRange(column).sortWithinPartitions(column).mapInArrow(place, schema))
    firsts = sorted((r["part"], r["first"]) for r in ranged.groupBy("part").agg(F.min(column).alias("first")).collect())  # one row per part
    border = ranged.sparkSession.sparkContext.broadcast(([w for _, w in firsts], numbered([w for _, w in firsts]), {p: k for k, (p, _) in enumerate(firsts)}))

    def run(batches):
        heads, known, places = border.value
        part, last, nodes, free, after, beyond_nodes = None, "", np.zeros(1, np.int64), 0, None, None
        for batch in batches:
            out, begin, held = [], 0, 0
            for k, (mine, word) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                if mine != part:
                    part, at, free = mine, places[mine], (mine + 1) << SHIFT
                    last, nodes = heads[at], known[at]
                    after, beyond_nodes = (heads[at + 1], known[at + 1]) if at + 1 < len(heads) else ("", known[at])
                old, beyond = shared(last, word), shared(after, word)
                if beyond > old:  # what the word shares with the first of the next range, but not with its predecessor
                    nodes, old = beyond_nodes, beyond
                nodes = grown(nodes, old, len(word), free)
                last, free = word, free + len(word) - old
                codes = np.frombuffer(word.encode("utf-32-le"), np.uint32)
                out.append((nodes, np.concatenate([[True], codes[1:] != codes[:-1]])))
                held += len(nodes)
                if held > NODES or k == len(batch) - 1:
                    lists = [pa.ListArray.from_arrays(np.cumsum([0, *map(len, rows)]).astype(np.int32), pa.array(np.concatenate(rows))) for rows in zip(*out)]
                    yield pa.RecordBatch.from_arrays([*batch.slice(begin, len(out)).columns, *lists], names=[*batch.schema.names, "nodes", "leads"])
                    out, begin, held = [], k + 1, 0

    return ranged.repartitionByRange("part").sortWithinPartitions("part", "at").mapInArrow(run, f"{schema}, nodes array<long>, leads array<boolean>")


def neighbours(words: DataFrame) -> DataFrame:
    """``w, near, near_n`` of every two words one edit apart, both ways; ``words`` has ``w, n``, the nodes ``p`` and ``r`` of both tries, and ``leads``."""
    sized = words.withColumn("len", F.size("leads"))
    pair = "transform(sequence(0, len{0}), i -> named_struct('p', element_at(p, i + 1), 's', element_at(r, len - i{1}), 'kind', {2}))"
    skips = sized.select("w", "n", F.explode(F.expr(pair.format(" - 1", "", "if(element_at(leads, i + 1), 1, 2)"))).alias("at"))
    wholes = sized.select("w", "n", F.explode(F.expr(pair.format("", " + 1", "0"))).alias("at"))
    met = skips.union(wholes).groupBy("at.p", "at.s").agg(F.collect_list(F.struct("w", "n", F.col("at.kind").alias("kind"))).alias("words")).where("size(words) > 1")
    pairs = met.select("words", F.explode("words").alias("one")).select("one", F.explode("words").alias("other"))
    return pairs.where("one.w <> other.w AND abs(one.kind - other.kind) < 2").select(F.col("one.w").alias("w"), F.col("other.w").alias("near"), F.col("other.n").alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``w, root``: the last word that each ``w, form`` leads to; every round doubles the steps."""
    now = stored(forms.select("w", F.col("form").alias("to")))
    while True:
        onward = now.select(F.col("w").alias("to"), F.col("to").alias("beyond"))
        if now.join(onward, "to", "left_semi").isEmpty():
            return now.select("w", F.col("to").alias("root"))
        far = salted(now.withColumn("key", F.col("w")), "to", onward).select("w", F.col("beyond").alias("to"))
        now = stored(far.union(now.join(onward, "to", "left_anti").select("w", "to")))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, fewest: int = FEWEST, times: int = TIMES, every: int = EVERY) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of at least ``fewest`` occurrences."""
    counts = word_counts(docs, id_col, text_col, shortest, every).where(F.col("n") >= fewest)
    # The numbers of words follow their order.
    forward = trie_nodes(counts, "word").select(F.expr(f"shiftleft(cast(part as long), {SHIFT}) + at").alias("w"), "word", "n", F.col("nodes").alias("p"), "leads")
    forward = stored(forward)
    backward = trie_nodes(forward.select("w", F.reverse("word").alias("back")), "back").select("w", F.col("nodes").alias("r"))
    near = neighbours(forward.drop("word").join(backward, "w"))
    best = F.max(F.struct("near_n", (-F.col("near")).alias("order"))).alias("best")
    found = stored(near.groupBy("w").agg(F.count("*").alias("n_near"), best).select("w", "n_near", F.col("best.near_n").alias("form_n"), (-F.col("best.order")).alias("form")))
    words = forward.select("w", "word", "n")
    chosen = stored(words.select("w", "n").join(found, "w").where(F.col("form_n") >= times * F.col("n")).select("w", "form", "form_n"))
    ends = roots(chosen)
    name = lambda c: words.select(F.col("w").alias(c), F.col("word").alias(f"{c}_word"))
    named = chosen.join(ends, "w").join(name("form"), "form").join(name("root"), "root").select("w", "form_word", "root_word", "form_n")
    return words.join(found.select("w", "n_near"), "w", "left").join(named, "w", "left").select(
        "word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
    WITH RECURSIVE table_of AS (
        SELECT list_transform(range(0, 256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
            lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS t),
    runs AS (
        SELECT doc_id, run, count(*) AS c
        FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
        WHERE length(run) >= 7 GROUP BY doc_id, run),
    bytes AS (
        SELECT run, c, list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':', ''), lambda x: unicode(x)::BIGINT)
            || flatten(list_transform(string_split(run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x)::BIGINT - 64] END)) AS b
        FROM runs),
    hashed AS (
        SELECT run, c, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda s, x: xor(s >> 8, t[(xor(s, x) & 255) + 1])), 4294967295::BIGINT) AS h FROM bytes, table_of),
    altered AS (
        SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM hashed),
    words AS (SELECT word, sum(c)::BIGINT AS n FROM altered WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
    skips AS (
        SELECT word, n, substr(word, 1, i) AS p, substr(word, i + 2) AS s
        FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)),
    pairs AS (
        SELECT a.word, b.word AS near, b.n AS near_n FROM skips a JOIN skips b ON a.p = b.p AND a.s = b.s AND a.word <> b.word
        UNION SELECT a.word, b.word, b.n FROM skips a JOIN words b ON a.p || a.s = b.word
        UNION SELECT b.word, a.word, a.n FROM skips a JOIN words b ON a.p || a.s = b.word),
    ranked AS (
        SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place FROM pairs),
    forms AS (
        SELECT w.word, w.n, coalesce(r.n_near, 0)::BIGINT AS n_near, CASE WHEN r.near_n >= 10 * w.n THEN r.near END AS form, CASE WHEN r.near_n >= 10 * w.n THEN r.near_n END AS form_n
        FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.place = 1),
    walk AS (SELECT word, word AS at FROM forms UNION ALL SELECT k.word, f.form FROM walk k JOIN forms f ON f.word = k.at WHERE f.form IS NOT NULL),
    ends AS (SELECT k.word, k.at AS root FROM walk k JOIN forms f ON f.word = k.at WHERE f.form IS NULL)
    SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM forms f JOIN ends e ON e.word = f.word
"""
