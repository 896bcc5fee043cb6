"""Exact histogram of encoded lengths, and the totals it answers for every context limit.

Documents are encoded where they are scanned and counted by length, so only ``(length, documents)``
pairs are shuffled.  Suffix sums over the lengths then hold all that a limit can ask: documents that
reach it, tokens that remain when longer documents are cut, and the share of shorter ones.  The sums
run within ranges of ``RANGE`` lengths and over the ranges, so no task needs all lengths.

A null or empty text has length 0 and is counted; repeated rows count each; an empty table gives an
empty histogram.  A text is encoded whole, whatever its length and however long its runs of blanks.
"""

from __future__ import annotations

import base64
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterloom.llm.common import stored

RANGE = 64
#: A public byte-pair vocabulary (ranks) and the pattern that belongs to it.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoder(vocabulary: str = VOCABULARY, pattern: str = PATTERN):
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("lengths", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


#: The blanks of the pattern; runs of at least so many are encoded apart.
BLANKS, RUN = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000", 50_000


def token_count(encoding, text: str, run: int = RUN) -> int:
    """Tokens of a text; long runs of blanks, which would overflow the matcher's stack, are encoded apart.

    Of a run of blanks before a word the pattern joins all but the last, which goes with the word if it
    is a space and stands alone if not; at the end of the text it joins all.  So what it joins is one
    piece, encoded without the matcher, and the text goes on behind it.
    """
    count = begin = 0
    for found in re.finditer(f"[{BLANKS}]{{{run},}}", text):
        last = found.end() - (found.end() < len(text))
        count += len(encoding.encode_ordinary(text[begin:found.start()])) + len(encoding._encode_single_piece(text[found.start():last]))
        begin = last
    return count + len(encoding.encode_ordinary(text[begin:]))


def encoded_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``id, length`` of every row.  ``vocabulary`` is a file that every executor has."""

    def run(batches):
        encoding = encoder(vocabulary, pattern)
        for batch in batches:
            lengths = [token_count(encoding, t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64())], names=["id", "length"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "id long, length long")


def histogram(lengths: DataFrame) -> DataFrame:
    return lengths.groupBy("length").agg(F.count("*").alias("docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """Per length: ``docs, docs_at_least, docs_over, tokens_at_least, truncated_total, share_up_to``.

    ``truncated_total`` is the number of tokens when every document is cut at this length, and
    ``share_up_to`` the share of documents of at most this length, from which quantiles are read.
    """
    tokens = F.col("docs") * F.col("length")
    ranged = hist.withColumns({"range": F.expr(f"length div {RANGE}"), "tokens": tokens})
    up = W.partitionBy().orderBy(F.desc("range")).rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    ranges = ranged.groupBy("range").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    ranges = ranges.select(
        "range", F.coalesce(F.sum("d").over(up), F.lit(0)).alias("docs_above"), F.coalesce(F.sum("t").over(up), F.lit(0)).alias("tokens_above"),
        F.sum("d").over(everything).alias("all_docs"), F.sum("t").over(everything).alias("all_tokens"))
    within = W.partitionBy("range").orderBy(F.desc("length"))
    summed = ranged.withColumns({"d": F.sum("docs").over(within), "t": F.sum("tokens").over(within)}).join(ranges, "range")
    at_least, tokens_at_least = F.col("docs_above") + F.col("d"), F.col("tokens_above") + F.col("t")
    return summed.select(
        "length", "docs", at_least.alias("docs_at_least"), (at_least - F.col("docs")).alias("docs_over"), tokens_at_least.alias("tokens_at_least"),
        (F.col("all_tokens") - tokens_at_least + F.col("length") * at_least).alias("truncated_total"),
        ((F.col("all_docs") - at_least + F.col("docs")) / F.col("all_docs")).alias("share_up_to"))


def limit_totals(hist: DataFrame, limits: list[int]) -> DataFrame:
    """``limit, docs_over, truncated_total`` of any limits, in one pass over the histogram."""
    each = hist.withColumn("limit", F.explode(F.array(*map(F.lit, limits))))
    return each.groupBy("limit").agg(
        F.sum(F.when(F.col("length") > F.col("limit"), F.col("docs")).otherwise(0)).alias("docs_over"),
        F.sum(F.least("length", "limit") * F.col("docs")).alias("truncated_total"))


def length_quantile(sums: DataFrame, q: float) -> DataFrame:
    """The smallest length that at least the share ``q`` of documents does not exceed."""
    return sums.where(F.col("share_up_to") >= q).agg(F.min("length").alias("length"))


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    return suffix_sums(stored(histogram(encoded_lengths(spark.read.parquet(f"{sf_dir}/documents.parquet")))))
