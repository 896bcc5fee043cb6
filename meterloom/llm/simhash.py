"""SimHash fingerprints and near-duplicate classes by vantage-point trees.

A fingerprint has 64 bits; a bit is set if more than half of the text's word shingles (repeats
count) have it set in their XXH64.  Fingerprints at ``bits`` or fewer differing bits are linked and
the components of the links are the classes.

Links are searched among distinct fingerprints only, so exact copies cost nothing.  The 64 bits are
cut into ``blocks`` equal blocks.  If two fingerprints differ in at most ``bits`` bits, they differ
in at most ``bits // blocks`` bits of some block.  So there is one tree per block: its inner nodes
hold a vantage point and a cut, distances are Hamming distances within the block, and the triangle
bound of a query is only ``bits // blocks`` wide, which prunes far better than all 64 bits.  Where
the block no longer separates the points, a node falls back to the distance over all bits with its
wider bound.  The leaves are the shards: each fingerprint lives in one leaf per tree and also asks
every leaf that its bound overlaps.  Within a shard the same recursion goes on in memory, and pairs
are checked over all 64 bits, so no link is lost and none is added.

The trees are fitted on a bounded sample (``SAMPLE``), which decides only how even the shards are.
A shard hands on a spanning forest, never its pairs: one row per linked fingerprint.

Null and wordless texts have fingerprint zero and are linked like any other; a text of fewer words
than a shingle is one shingle; repeated rows share a class; null identifiers are passed over in the
choice of the class name; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.llm.common import components, each_utf8, stored

SEED = 42
#: Fingerprints (about) on which the trees are fitted, and that a shard should hold.
SAMPLE, SHARD = 65_536, 4_096
#: Comparisons of one vectorised step.
STEP = 1 << 21


def fingerprint(text: bytes, words: int) -> int:
    """The fingerprint of a text as an unsigned number."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = list(accumulate(len(t) + 1 for t in tokens))
    spans = zip([0, *ends], ends[words - 1:]) if len(tokens) > words else [(0, len(joined) + 1)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b - 1], SEED) for a, b in spans], np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k:k + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    def run(batches):
        for batch in batches:
            values = np.array([fingerprint(t, words) for t in each_utf8(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "id long, fp long")


def distance(points: np.ndarray, point: np.uint64, mask: np.uint64) -> np.ndarray:
    return np.bitwise_count((points ^ point) & mask)


def best_cut(home: np.ndarray, query: np.ndarray, metrics: list[tuple[int, int]], rng: np.random.Generator):
    """The vantage point and cut that leave the fewest comparisons, or None if none saves a tenth."""
    whole, best = len(home) * len(query), None
    for mask, radius in metrics:
        for point in rng.choice(home, min(6, len(home)), replace=False):
            at, asked = distance(home, point, np.uint64(mask)), distance(query, point, np.uint64(mask))
            for cut in np.unique(np.quantile(at, [0.3, 0.5, 0.7], method="lower")):
                cut = int(cut)
                inside = int((at <= cut).sum())
                cost = inside * int((asked <= cut + radius).sum()) + (len(home) - inside) * int((asked > cut - radius).sum())
                if inside < len(home) and cost < 0.9 * whole and (best is None or cost < best[0]):
                    best = cost, mask, radius, int(point), cut
        if best:
            return best[1:]
    return None


def sides(points: np.ndarray, home: np.ndarray, query: np.ndarray, node: tuple) -> list[tuple[np.ndarray, np.ndarray]]:
    """Indices of home points and of queries, inside the cut and outside; overlapping queries go both ways."""
    mask, radius, point, cut = node
    at, asked = (distance(points[x], np.uint64(point), np.uint64(mask)).astype(np.int16) for x in (home, query))
    return [(home[at <= cut], query[asked <= cut + radius]), (home[at > cut], query[asked > cut - radius])]


def fit_tree(sample: np.ndarray, metrics: list[tuple[int, int]], shard: float, first: int) -> tuple[list, int]:
    """A nested tree ``(node, inside, outside)`` or leaf number, and the next free leaf number."""
    rng = np.random.default_rng(first)

    def grow(home: np.ndarray, query: np.ndarray, leaf: int):
        node = best_cut(sample[home], sample[query], metrics, rng) if len(home) > max(shard, 16) else None
        if node is None:
            return leaf, leaf + 1
        (h1, q1), (h2, q2) = sides(sample, home, query, node)
        inside, leaf = grow(h1, q1, leaf)
        outside, leaf = grow(h2, q2, leaf)
        return (node, inside, outside), leaf

    whole = np.arange(len(sample))
    return grow(whole, whole, first)


def route(tree, points: np.ndarray):
    """``(leaf, home indices, query indices)`` of the leaves that the points reach."""
    todo = [(tree, np.arange(len(points)), np.arange(len(points)))]
    while todo:
        branch, home, query = todo.pop()
        if isinstance(branch, int):
            if len(query):
                yield branch, home, query
            continue
        inside, outside = sides(points, home, query, branch[0])
        todo += [(branch[1], *inside), (branch[2], *outside)]


def join_roots(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unite the classes of each pair ``(a, b)``; a class is named by its smallest index."""
    while len(a):
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up
        a, b = parent[a], parent[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def linked(points: np.ndarray, home: np.ndarray, bits: int, metrics: list[tuple[int, int]]) -> np.ndarray:
    """Class of every point, by the links from each point to home points within ``bits``."""
    parent, rng = np.arange(len(points)), np.random.default_rng(len(points))
    todo = [(home, np.arange(len(points)))]
    while todo:
        h, q = todo.pop()
        if not len(h) or not len(q):
            continue
        node = best_cut(points[h], points[q], metrics, rng) if len(h) > 256 and len(h) * len(q) > STEP else None
        if node:
            todo += sides(points, h, q, node)
            continue
        for k in range(0, len(h), STEP):
            some = h[k:k + STEP]
            rows = max(1, STEP // len(some))
            for j in range(0, len(q), rows):
                part = q[j:j + rows]
                a, b = np.nonzero(np.bitwise_count(points[part][:, None] ^ points[some][None, :]) <= bits)
                a, b = part[a], some[b]
                apart = a != b
                join_roots(parent, a[apart], b[apart])
    join_roots(parent, np.arange(len(points)), parent.copy())
    return parent


def link_forest(distinct: DataFrame, bits: int, blocks: int = 4, sample: int = SAMPLE, shard: int = SHARD) -> DataFrame:
    """Edges ``(a, b)`` whose components are those of all links between the distinct ``fp``."""
    total = distinct.count()
    share = min(1.0, sample / max(total, 1))
    drawn = distinct if share == 1 else distinct.where(F.pmod(F.xxhash64("fp", F.lit("tree")), F.lit(1 << 30)) < int(share * (1 << 30)))
    points = np.sort(np.array([r[0] for r in drawn.select("fp").collect()], np.int64)).view(np.uint64)
    width, every = 64 // blocks, (1 << 64) - 1
    masks = [((1 << width) - 1) << (width * k) if k < blocks - 1 else every ^ ((1 << (width * k)) - 1) for k in range(blocks)]
    metrics = [[(m, bits // blocks), (every, bits)] for m in masks]
    trees, owner, leaf = [], {}, 0
    for k in range(blocks):
        tree, after = fit_tree(points, metrics[k], shard * share, leaf)
        trees.append(tree)
        owner.update(dict.fromkeys(range(leaf, after), k))
        leaf = after

    def deal(batches):
        schema = pa.schema([("leaf", pa.int32()), ("fp", pa.int64()), ("home", pa.bool_())])
        for batch in batches:
            mine = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for tree in trees:
                for number, home, query in route(tree, mine):
                    at_home = np.zeros(len(mine), bool)
                    at_home[home] = True
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(query), number, np.int32)), pa.array(mine[query].view(np.int64)), pa.array(at_home[query])], schema=schema)

    def search(key, table):
        mine = table.column("fp").to_numpy().view(np.uint64)
        home = np.nonzero(table.column("home").to_numpy(zero_copy_only=False))[0]
        root = linked(mine, home, bits, metrics[owner[key[0].as_py()]])
        moved = np.nonzero(root != np.arange(len(root)))[0]
        return pa.table({"a": pa.array(mine[moved].view(np.int64)), "b": pa.array(mine[root[moved]].view(np.int64))})

    return distinct.select("fp").mapInArrow(deal, "leaf int, fp long, home boolean").groupBy("leaf").applyInArrow(search, "a long, b long")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, bits: int = 3, blocks: int = 4) -> DataFrame:
    """``id, fp, component_id`` of every row; the component is named by its smallest id."""
    prints = stored(fingerprints(docs, id_col, text_col, words))
    distinct = stored(prints.groupBy("fp").agg(F.min("id").alias("low")))
    nodes = components(link_forest(distinct, bits, blocks))
    classes = distinct.join(nodes, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    names = classes.groupBy("root").agg(F.min("low").alias("component_id"))
    return prints.join(classes.join(names, "root").select("fp", "component_id"), "fp").select("id", "fp", "component_id")


def op8_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
