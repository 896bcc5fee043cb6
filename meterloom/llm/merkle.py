"""Merkle manifest of a table, kept as a persistent tree that is changed by path copying.

A row's leaf is the SHA-256 of its fields; null is ``-``, any other value its UTF-8 length, ``:`` and
the value.  Within a group (language) the leaves ascend by identifier, and while several nodes remain
every ``FAN`` neighbours, the last run as many as are left, become their hash.  The nodes that remain,
one per group, form a last tree in the order of the groups (null first), whose top is the root.

Levels are climbed in aligned blocks of ``FAN ** DEPTH`` neighbours, one small group of rows each, so
neither a task nor the driver ever holds a group: a third of all rows under one language are a third of
all blocks.  Leaves get their places from a range-partitioned sort and one count per sorted part.

A change of a leaf makes a version.  A version owns copies of the ancestors of its leaf and shares every
other node with the tree before the change.  The lower copies are made in the leaf's own block; the
siblings above the block come down from the upper blocks (``descended``), so each block goes on with the
upper copies of its own versions, and no upper block ever gathers versions.  ``versions`` is that
table; ``version_nodes`` reads one version as a whole tree.

Null identifiers come first, rows of equal identifier by leaf; equal rows are leaves of their own.  A row
without identifier is not tampered with.  Other columns are ignored, whatever their names; an empty table
gives an empty result.  Texts are hashed where they are scanned, whatever their length.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterloom.llm.common import LOWER, UPPER, stored

FAN, DEPTH = 8, 3
BLOCK = FAN**DEPTH
FIELDS, EVERY = ("doc_id", "source", "lang", "n_chars", "text"), 3

NODE_DDL = "grp string, n long, level int, pos long, hash string, top boolean"
PATH_DDL = "grp string, pos long, above array<struct<before:string,after:string>>"
VERSION_DDL = "id long, grp string, pos long, leaf string, above array<struct<before:string,after:string>>, proof string, changed string, copied array<string>"
SIDES = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def height(n: int) -> int:
    """Levels above ``n`` neighbours."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def levels_of(hashes: list[str], steps: int) -> list[list[str]]:
    """The nodes of a block, level by level from the given ones."""
    levels = [hashes]
    for _ in range(steps):
        low = levels[-1]
        levels.append([digest("".join(low[k:k + FAN])) for k in range(0, len(low), FAN)])
    return levels


def sides(levels: list[list[str]], at: int) -> list[tuple[str, str]]:
    """What stands left and right of a node's path in each of its runs, from the bottom."""
    out = []
    for low in levels[:-1]:
        first = at // FAN * FAN
        out.append(("".join(low[first:at]), "".join(low[at + 1:first + FAN])))
        at //= FAN
    return out


def copied_path(leaf: str, above: list[tuple[str, str]]) -> list[str]:
    """A leaf and its ancestors up to the root."""
    path = [leaf]
    for before, after in above:
        path.append(digest(before + path[-1] + after))
    return path


def hashed(rows: DataFrame, columns: tuple[str, ...] = FIELDS, text_col: str = "text", id_col: str = "doc_id", group_col: str = "lang", every: int = EVERY) -> DataFrame:
    """``grp, id, leaf, changed``: the leaf of each row, and that of the row after tampering (null: not tampered)."""
    def leaf(value) -> F.Column:
        each = [value(c).cast("string") for c in columns]
        return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in each]).cast("binary"), 256)

    hit = F.crc32(F.col(id_col).cast("string").cast("binary")) % every == 0
    low = lambda c: F.translate(F.col(c).cast("string"), UPPER, LOWER) if c == text_col else F.col(c)
    return rows.select(
        F.coalesce(F.concat(F.lit("s"), F.col(group_col).cast("string")), F.lit("n")).alias("grp"), F.col(id_col).cast("long").alias("id"),
        leaf(F.col).alias("leaf"), F.when(hit, leaf(low)).alias("changed"))


def placed(leaves: DataFrame) -> DataFrame:
    """``grp, n, pos, id, hash, changed``: each leaf's place in its group, and the size of the group."""
    order = ["grp", "id", "hash", "tie"]

    def number(batches):
        part, now, count = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            at = []
            for grp in batch.column(0).to_pylist():
                now, count = grp, (count + 1 if grp == now else 0)
                at.append(count)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array([part] * len(at), pa.int32()), pa.array(at, pa.int64())], names=["grp", "id", "hash", "changed", "part", "at"])

    rows = leaves.select("grp", "id", F.col("leaf").alias("hash"), "changed", F.monotonically_increasing_id().alias("tie"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("grp", "id", "hash", "changed")
    rows = stored(rows.mapInArrow(number, "grp string, id long, hash string, changed string, part int, at long"))
    sizes = rows.groupBy("grp", "part").agg(F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(W.partitionBy("grp").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = stored(sizes.select("grp", "part", before.alias("base"), F.sum("rows").over(W.partitionBy("grp")).alias("n")))
    return rows.join(sizes, ["grp", "part"]).select("grp", "n", (F.col("base") + F.col("at")).alias("pos"), "id", "hash", "changed")


def climbed(nodes: DataFrame) -> list[DataFrame]:
    """Stored stages of ``grp, n, level, pos, hash, top``; the next one starts from the top nodes of the last one."""
    def climb(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        grp, n, level, first = (table.column(c)[0].as_py() for c in ("grp", "n", "level", "pos"))
        levels = levels_of(table.column("hash").to_pylist(), min(DEPTH, height(n)))
        out = [(grp, -(-n // FAN**up), level + up, first // FAN**up + k, h, up == len(levels) - 1)
               for up, row in enumerate(levels) if up or len(levels) == 1 for k, h in enumerate(row)]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_()))],
                        names=["grp", "n", "level", "pos", "hash", "top"])

    now, stages = nodes.select("grp", "n", F.lit(0).alias("level"), "pos", "hash"), []
    while True:
        found = stored(now.groupBy("grp", F.expr(f"pos div {BLOCK}").alias("block")).applyInArrow(climb, NODE_DDL))
        stages.append(found)
        now = found.where("top").drop("top")
        if not (now.agg(F.max("n")).first()[0] or 0) > 1:
            return stages


def blocks_with(nodes: DataFrame, above: DataFrame):
    """Nodes grouped by block, beside what stands above each block: one row of ``above`` per node of the next stage."""
    return nodes.withColumn("block", F.expr(f"pos div {BLOCK}")).groupBy("grp", "block").cogroup(above.withColumn("block", F.col("pos")).groupBy("grp", "block"))


def paths_in(nodes: pa.Table, above: pa.Table) -> tuple[pa.Table, list[list[tuple[str, str]]]]:
    """The nodes of a block in order, and the sides of each one's path up to the top of all."""
    nodes = nodes.sort_by("pos")
    levels = levels_of(nodes.column("hash").to_pylist(), min(DEPTH, height(nodes.column("n")[0].as_py())))
    rest = [(s["before"], s["after"]) for s in above.column("above")[0].as_py()]
    return nodes, [sides(levels, k) + rest for k in range(len(levels[0]))]


def as_sides(paths: list[list[tuple[str, str]]]) -> pa.Array:
    return pa.array([[{"before": b, "after": a} for b, a in p] for p in paths], SIDES)


def descended(leaves: DataFrame, stages: list[DataFrame], top: DataFrame) -> DataFrame:
    """``grp, pos, above`` for the nodes over the lowest blocks, given that of the top nodes of the groups."""
    def descend(nodes: pa.Table, above: pa.Table) -> pa.Table:
        if not len(nodes):
            return pa.table({"grp": pa.array([], pa.string()), "pos": pa.array([], pa.int64()), "above": pa.array([], SIDES)})
        nodes, paths = paths_in(nodes, above)
        return pa.table({"grp": nodes.column("grp"), "pos": nodes.column("pos"), "above": as_sides(paths)})

    above = top
    for stage in reversed(stages[:-1]):
        above = stored(blocks_with(stage.where("top").select("grp", "n", "pos", "hash"), above).applyInArrow(descend, PATH_DDL))
    return above


class Manifest:
    """The stored tree of a table: its leaves, its nodes, the top of each group, the root."""

    def __init__(self, rows: DataFrame, **columns) -> None:
        self.leaves = stored(placed(hashed(rows, **columns)))
        self.stages = climbed(self.leaves)
        tops = self.stages[-1].where("top").select(F.col("grp").alias("name"), "hash")
        # One row per group, which is a catalogue: its order is a window in one task.
        self.groups = stored(tops.select(
            F.lit("").alias("grp"), F.count("*").over(W.partitionBy()).alias("n"), (F.row_number().over(W.orderBy("name")) - 1).cast("long").alias("pos"), "hash", "name"))
        self.upper = climbed(self.groups)
        root = self.upper[-1].where("top").select("hash").first()
        self.root = root[0] if root else None

    def nodes(self) -> DataFrame:
        """``grp, level, pos, hash`` of every node; leaves are level 0, the tree of the groups is ``grp`` ''."""
        parts = [d.select("grp", F.lit(0).alias("level"), "pos", "hash") for d in (self.leaves, self.groups)]
        for stage in (*self.stages, *self.upper):
            parts.append(stage.where("level > 0").select("grp", "level", "pos", "hash"))
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.union(part)
        return whole.distinct()

    def versions(self) -> DataFrame:
        """Per leaf: its place and path, the digest of its proof and, where it is changed, the changed leaf and its copied ancestors."""
        empty = F.expr("cast(array() as array<struct<before:string,after:string>>)")
        top = self.upper[-1].where("top").select("grp", "pos", empty.alias("above"))

        def finish(nodes: pa.Table, above: pa.Table) -> pa.Table:
            if not len(nodes):
                return pa.table([pa.array([], t) for t in (pa.int64(), pa.string(), pa.int64(), pa.string(), SIDES, pa.string(), pa.string(), pa.list_(pa.string()))],
                                names=["id", "grp", "pos", "leaf", "above", "proof", "changed", "copied"])
            nodes, paths = paths_in(nodes, above)
            changed = nodes.column("changed").to_pylist()
            copied = [copied_path(c or h, p) for c, h, p in zip(changed, nodes.column("hash").to_pylist(), paths)]
            return pa.table({
                "id": nodes.column("id"), "grp": nodes.column("grp"), "pos": nodes.column("pos"), "leaf": nodes.column("hash"), "above": as_sides(paths),
                "proof": pa.array([digest("".join(b + a for b, a in p)) for p in paths], pa.string()), "changed": nodes.column("changed"), "copied": pa.array(copied, pa.list_(pa.string()))})

        def of_groups(nodes: pa.Table, above: pa.Table) -> pa.Table:
            if not len(nodes):
                return pa.table({"grp": pa.array([], pa.string()), "pos": pa.array([], pa.int64()), "above": pa.array([], SIDES)})
            nodes, paths = paths_in(nodes, above)
            return pa.table({"grp": nodes.column("name"), "pos": pa.array([0] * len(nodes), pa.int64()), "above": as_sides(paths)})

        over_groups = blocks_with(self.groups, descended(self.groups, self.upper, top)).applyInArrow(of_groups, PATH_DDL)
        return blocks_with(self.leaves, descended(self.leaves, self.stages, stored(over_groups))).applyInArrow(finish, VERSION_DDL)


def version_nodes(nodes: DataFrame, versions: DataFrame, version: int) -> DataFrame:
    """``grp, level, pos, hash``: the tree as the version of one identifier sees it, its own copies and all shared nodes."""
    mine = versions.where((F.col("id") == version) & F.col("changed").isNotNull())
    own = mine.select("grp", "pos", F.posexplode("copied").alias("level", "copy"))
    tall = nodes.groupBy("grp").agg(F.max("level").alias("tall"))
    below = own.join(tall, "grp").where("level <= tall").select("grp", "level", F.expr(f"cast(floor(pos / pow({FAN}, level)) as long)").alias("pos"), "copy")
    at = nodes.where("grp <> '' AND level = 0").select("grp").distinct().withColumn("place", (F.row_number().over(W.orderBy("grp")) - 1).cast("long"))
    over = own.join(tall, "grp").where("level >= tall").join(at, "grp").select(
        F.lit("").alias("grp"), (F.col("level") - F.col("tall")).alias("level"), F.expr(f"cast(floor(place / pow({FAN}, level - tall)) as long)").alias("pos"), "copy")
    return nodes.join(below.union(over), ["grp", "level", "pos"], "left").select("grp", "level", "pos", F.coalesce("copy", "hash").alias("hash"))


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    tree = Manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    subroots = tree.groups.select(F.col("name").alias("grp"), F.col("hash").alias("subroot"))
    folded = F.element_at("copied", -1)
    return tree.versions().join(subroots, "grp").select(
        F.col("id").alias("doc_id"), "leaf", "subroot", F.lit(tree.root).cast("string").alias("root"), F.col("proof").alias("proof_sha256"),
        folded.alias("folded_root"), (folded == F.lit(tree.root)).alias("verified"))


def _oracle(leaf_levels: int = 10, group_levels: int = 4) -> str:
    """Both trees level by level: enough for 8^10 rows of a language and 8^4 languages."""
    def leaf(text: str) -> str:
        parts = [f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars")]
        return f"sha256({' || '.join([*parts, f'''coalesce(strlen({text})::VARCHAR || ':' || {text}, '-')'''])})"

    def climb(name: str, levels: int) -> list[str]:
        out = []
        for k in range(levels + 1):
            if k:
                out.append(f"{name}{k} AS (SELECT grp, i // {FAN} AS i, CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE min(h) END AS h, (n + {FAN - 1}) // {FAN} AS n "
                           f"FROM {name}{k - 1} GROUP BY grp, i // {FAN}, n)")
            over = f"OVER (PARTITION BY grp, i // {FAN} ORDER BY i ROWS BETWEEN"
            out.append(f"{name}s{k} AS (SELECT grp, i, n, coalesce(string_agg(h, '') {over} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b, "
                       f"coalesce(string_agg(h, '') {over} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a FROM {name}{k})")
        return out

    def fold(name: str, tree: str, start: str, levels: int) -> list[str]:
        out, last = [], start
        for k in range(levels):
            out.append(f"{name}{k} AS (SELECT r.doc_id, r.name, r.leaf, r.grp, r.i // {FAN} AS i, r.proof || s.b || s.a AS proof, "
                       f"CASE WHEN s.n > 1 THEN sha256(s.b || r.h || s.a) ELSE r.h END AS h FROM {last} r JOIN {tree}s{k} s ON r.grp = s.grp AND r.i = s.i)")
            last = f"{name}{k}"
        return out

    steps = "[0, 0, 0, 0, 0, 0, 0, 0]"
    crc = ("xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: unicode(c)::BIGINT)), lambda s, x: "
           f"list_reduce(list_prepend(xor(s, x), {steps}::BIGINT[]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)), 4294967295::BIGINT)")
    parts = [
        f"d AS (SELECT doc_id, coalesce('s' || lang, 'n') AS grp, {leaf('text')} AS leaf, {leaf(f'''translate(text, '{UPPER}', '{LOWER}')''')} AS low, {crc} % {EVERY} = 0 AS hit FROM documents)",
        "l0 AS (SELECT grp, doc_id, leaf AS h, low, hit, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY grp) AS n FROM d)",
        *climb("l", leaf_levels),
        f"t0 AS (SELECT '' AS grp, grp AS name, h, row_number() OVER (ORDER BY grp) - 1 AS i, count(*) OVER () AS n FROM l{leaf_levels})",
        *climb("t", group_levels),
        "r AS (SELECT doc_id, grp AS name, h AS leaf, grp, i, '' AS proof, CASE WHEN hit THEN low ELSE h END AS h FROM l0)",
        *fold("f", "l", "r", leaf_levels),
        f"g AS (SELECT f.doc_id, f.name, f.leaf, '' AS grp, t0.i, f.proof, f.h, t0.h AS subroot FROM f{leaf_levels - 1} f JOIN t0 ON t0.name = f.name)",
        *fold("e", "t", "g", group_levels),
    ]
    return (f"WITH {', '.join(parts)} SELECT e.doc_id, e.leaf, t0.h AS subroot, top.h AS root, sha256(e.proof) AS proof_sha256, e.h AS folded_root, e.h = top.h AS verified "
            f"FROM e{group_levels - 1} e JOIN t0 ON t0.name = e.name CROSS JOIN t{group_levels} top")


ORACLE = _oracle()
