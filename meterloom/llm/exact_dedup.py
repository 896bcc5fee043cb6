"""Exact deduplication by owners in Patricia tries.

Texts are partitioned by their length and content hash.  Every partition inserts the full byte
strings into a compressed radix trie, whose terminal nodes keep the number of rows and the smallest
and largest identifier; so two texts are equal only if all their bytes are.

Copies collapse in the scanning task before the shuffle, so a text that a third of all rows share
arrives once per task.  The number of partitions follows from the bytes.  A trie that still outgrows its budget gives up its largest subtree: those texts
leave the task unresolved, go through the shared folder, and are dealt anew over more partitions; a
text that is alone in its trie is held whatever its length, so this ends.
A document finds its owner by length and SHA-256, in a join whose large keys adaptive execution splits.

Null texts count as empty.  Repeated rows of the owner are all kept, a null identifier owns a text
only if all its copies lack one, and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.llm.common import arrow, stored, utf8

#: Bytes of distinct texts that a scanning task gathers before it hands them on, and that one trie holds.
GATHER_BYTES, TRIE_BYTES = 24 << 20, 64 << 20
#: Bytes of a text's nodes beside the text; partitions that a shuffle is asked for at most by size.
NODE, MOST = 800, 200_000

PARTIAL = pa.schema([("length", pa.int64()), ("hash", pa.int64()), ("text", pa.binary()), ("n", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])
PARTIAL_DDL = "length long, hash long, text binary, n long, low long, high long"
OWNER = pa.schema([("length", pa.int64()), ("sha", pa.binary()), ("n", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("hash", pa.int64()), ("text", pa.binary())])
OWNER_DDL = "length long, sha binary, n long, low long, high long, hash long, text binary"


def merged(a: list | None, n: int, low: int | None, high: int | None) -> list:
    if a is None:
        return [n, low, high]
    a[0] += n
    if low is not None:
        a[1] = low if a[1] is None else min(a[1], low)
        a[2] = high if a[2] is None else max(a[2], high)
    return a


class Trie:
    """A compressed radix trie of byte strings; ``held`` counts its bytes, by subtree of the root."""

    def __init__(self) -> None:
        self.root: list = [b"", {}, None]  # label, children by first byte, owner
        self.held: dict[int, int] = {}

    def insert(self, text: bytes, n: int, low: int | None, high: int | None) -> None:
        node, at = self.root, 0
        while at < len(text):
            child = node[1].get(text[at])
            if child is None:
                node[1][text[at]] = [text[at:], {}, [n, low, high]]
                self.held[text[0]] = self.held.get(text[0], 0) + len(text) - at + 400
                return
            label = child[0]
            if text.startswith(label, at):
                node, at = child, at + len(label)
                continue
            known, beyond = 1, min(len(label), len(text) - at)  # common prefix by bisection
            while known < beyond:
                mid = (known + beyond + 1) // 2
                known, beyond = (mid, beyond) if text.startswith(label[:mid], at) else (known, mid - 1)
            fork = [label[:known], {label[known]: child}, None]
            child[0] = label[known:]
            node[1][text[at]] = fork
            self.held[text[0]] += 400
            node, at = fork, at + known
        node[2] = merged(node[2], n, low, high)

    def terminals(self, first: int | None = None) -> Iterator[tuple[bytes, list]]:
        todo = [(self.root, b"")] if first is None else [(self.root[1][first], b"")]
        while todo:
            (label, children, owner), path = todo.pop()
            path += label
            if owner is not None:
                yield path, owner
            todo += [(child, path) for child in children.values()]

    def alone(self) -> bool:
        """Whether there is one text only, which has to be held however long it is."""
        terminals = self.terminals()
        next(terminals, None)
        return next(terminals, None) is None

    def give_up(self) -> tuple[int, list[tuple[bytes, list]]]:
        """The largest subtree of the root: its first byte and its terminals, which leave the trie."""
        first = max(self.held, key=self.held.get)
        gone = list(self.terminals(first))
        del self.root[1][first], self.held[first]
        return first, gone


def _gather(budget: int):
    def run(batches):
        seen: dict[bytes, list] = {}
        size = 0

        def rows(items):
            block: list = []
            for text, (n, low, high) in items:
                block.append((len(text), xxhash.xxh64_intdigest(text) - (1 << 63), text, n, low, high))
                if len(block) == 1000:
                    yield arrow(block, PARTIAL)
                    block = []
            if block:
                yield arrow(block, PARTIAL)

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                text = text.lower()
                if text not in seen:
                    size += len(text) + 300
                seen[text] = merged(seen.get(text), 1, key, key)
                if size > budget:  # texts met more than once stay: their copies go on collapsing
                    hot = {t: o for t, o in seen.items() if o[0] > 1}
                    if sum(map(len, hot)) + 300 * len(hot) > budget // 2:
                        hot = {}
                    yield from rows((t, o) for t, o in seen.items() if t not in hot)
                    seen, size = hot, sum(map(len, hot)) + 300 * len(hot)
        yield from rows(seen.items())

    return run


def _insert(budget: int):
    def run(batches):
        trie, gone = Trie(), set()
        resolved = lambda t, o: (len(t), hashlib.sha256(t).digest(), *o, 0, None)
        pending = lambda t, o: (len(t), None, *o, xxhash.xxh64_intdigest(t) - (1 << 63), t)
        for batch in batches:
            left = []
            for text, *owner in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5))):
                if text and text[0] in gone:
                    left.append(pending(text, owner))
                    continue
                trie.insert(text, *owner)
                if sum(trie.held.values()) > budget and not trie.alone():
                    first, out = trie.give_up()
                    gone.add(first)
                    left += [pending(t, o) for t, o in out]
            for k in range(0, len(left), 1000):
                yield arrow(left[k:k + 1000], OWNER)
        block = []
        for text, owner in trie.terminals():
            block.append(resolved(text, owner))
            if len(block) == 5000:
                yield arrow(block, OWNER)
                block = []
        yield arrow(block, OWNER)

    return run


def _keys(batches):
    schema = pa.schema([("id", pa.int64()), ("length", pa.int64()), ("sha", pa.binary())])
    for batch in batches:
        texts = [t.lower() for t in utf8(batch.column(1))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())], schema=schema)


def parts_for(size: int, least: int, trie_bytes: int) -> int:
    """Partitions for so many bytes of texts."""
    return max(least, min(MOST, -(-3 * size // trie_bytes)))


def text_owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trie_bytes: int = TRIE_BYTES, gather_bytes: int = GATHER_BYTES) -> DataFrame:
    """One row per distinct folded text: length, sha, n rows, smallest (low) and largest (high) id."""
    spark = docs.sparkSession
    # A third of a trie's budget each on average, so that only odd partitions outgrow it; a node costs NODE bytes beside its text.
    bulk = F.sum(F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)) + NODE)
    parts = parts_for(docs.agg(bulk).first()[0] or 0, int(spark.conf.get("spark.sql.shuffle.partitions")), trie_bytes)
    todo = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(_gather(gather_bytes), PARTIAL_DDL)
    done = None
    while True:
        met = stored(todo.repartition(parts, "length", "hash").mapInArrow(_insert(trie_bytes), OWNER_DDL))
        ready = met.where(F.col("sha").isNotNull()).select("length", "sha", "n", "low", "high")
        done = ready if done is None else done.union(ready)
        todo = met.where(F.col("sha").isNull()).select("length", "hash", "text", "n", "low", "high")
        left = met.where(F.col("sha").isNull()).agg(F.sum(F.col("length") + NODE)).first()[0]
        if left is None:
            return done
        parts = parts_for(left, 4 * parts, trie_bytes)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", **sizes: int) -> DataFrame:
    """``id, keep_id, group_size, kept, text_sha256`` of every row; ``keep`` is smallest or largest."""
    owners = text_owners(docs, id_col, text_col, **sizes)
    owners = owners.select("length", "sha", F.col("n").alias("group_size"), F.col("low" if keep == "smallest" else "high").alias("keep_id"))
    keys = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string")).mapInArrow(_keys, "id long, length long, sha binary")
    return keys.join(owners, ["length", "sha"]).select(
        "id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_duplicates(docs, keep="largest").withColumnRenamed("id", "doc_id")


ORACLE = """
    WITH folded AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    owners AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM folded GROUP BY t)
    SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256
    FROM folded JOIN owners USING (t)
"""
