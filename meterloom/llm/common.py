"""Helpers shared by the operators: the shared folder, cut lineage, words, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z and a-z, for folding that leaves every other letter alone.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word is a longest run without space, tab, line feed, vertical tab, form feed, carriage return:
#: what ``bytes.split()`` yields.
WORD = r"[^\x20\x09-\x0D]+"
#: Parts into which the edges of a node are dealt.
SALTS = 16


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under ``spark.checkpoint.dir``, which all executors share.

    Only a session in one process may go without that setting; it then gets a folder of its own.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    known = sc._jsc.sc().getCheckpointDir()
    if base and known.isEmpty():
        sc.setCheckpointDir(base)
    if not base and known.isEmpty():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
        known = sc._jsc.sc().getCheckpointDir()
    return f"{(base or known.get()).rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read again: later steps restart from there."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with marks added to those that ``df`` has itself."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow string column as bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def each_utf8(column: pa.Array, size: int = 64) -> Iterator[bytes]:
    """As ``utf8``, with no more than ``size`` texts unpacked at a time."""
    for k in range(0, len(column), size):
        yield from utf8(column.slice(k, size))


def arrow(rows: Iterable[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def crc_bucket(column: F.Column, parts: int) -> F.Column:
    """crc32 of the value as text, modulo ``parts``; null when the value is null."""
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(parts)).cast("int")


def salted(rows: DataFrame, by: str, few: DataFrame) -> DataFrame:
    """``rows`` joined with ``few`` on a column; a frequent value is dealt over ``SALTS`` parts by the column ``key`` of the rows."""
    salt = F.pmod(F.xxhash64("key", F.lit("salt")), F.lit(SALTS)).cast("int")
    return rows.withColumn("salt", salt).join(few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [by, "salt"]).drop("salt")


def joined_to_hot(rows: DataFrame, by: str, few: DataFrame, copies: str, hot: int = 10_000) -> DataFrame:
    """``rows`` joined with ``few`` on a column whose frequency is known; only values of over ``hot`` rows are salted."""
    return salted(rows, by, few.where(F.col(copies) > hot)).unionByName(rows.join(few.where(F.col(copies) <= hot), by))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest reachable node of every node of an edge list ``(a, b)`` of longs: ``(node, root)``.

    Large-star and small-star contraction alternate until the edges no longer change.  A node's
    smallest neighbour is a partial aggregate and reaches its edges by a salted join, so a node with
    very many neighbours is never gathered in one place.  Each round is checkpointed.
    """
    shared_dir(edges.sparkSession)

    def star(e: DataFrame, large: bool) -> DataFrame:
        near = e.union(e.select(F.col("b"), F.col("a"))) if large else e
        low = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        spread = near.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
        met = spread.join(low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["a", "salt"])
        out = met.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")) if large else (
            met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))))
        return out.where("a <> b").distinct()

    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    mark = None
    for _ in range(rounds):
        now = star(star(now, True), False).checkpoint()
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = seen
    raise RuntimeError("the components did not settle")
