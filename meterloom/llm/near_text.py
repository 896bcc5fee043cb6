"""Near-duplicate stage: SimHash trees and min-max bands propose pairs, exact shingle sets decide.

A text is the set of its runs of ``WORDS`` words (lower-cased).  Two texts are linked if they share
``PERCENT`` of the union of their sets, and the components of the links are the classes.  Pairs are
proposed by the vantage-point trees over the texts' fingerprints, at ``BITS`` differing bits, and by the
bands of ``minmax``, since texts at a similarity of 0.8 differ in up to 11 bits and more, at which trees
no longer prune.  No proposal is trusted, and verification neither ships pairs of texts nor forms all
pairs of a group (see ``set_links`` and ``minmax``).

Null, empty and wordless texts are one class; a text of fewer words than a run is one shingle.  Texts are
told apart by 128 bits.  One row of a class stays, the one of the smallest identifier (null last), also
where rows are repeated; other columns keep their values, whatever their names; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.llm.common import joined_to_hot, stored, unused
from meterloom.llm.minmax import BANDS, ROWS, prints, set_classes
from meterloom.llm.set_links import text_key
from meterloom.llm.simhash import fingerprints, link_forest

WORDS, PERCENT = 5, 80
#: Radius of the trees; with four blocks of 16 bits, one bit within a block.
BITS = 7


def tree_proposals(docs: DataFrame, text_col: str, distinct: DataFrame, bits: int = BITS) -> DataFrame:
    """``hub, member``: texts of one fingerprint, and of fingerprints that the trees hold together."""
    first = text_key(text_col)[0]
    found = fingerprints(docs.select(first.alias("named"), F.col(text_col).cast("string").alias("text")), "named", "text").distinct()
    prints_of = stored(found.join(distinct.select("node", F.col("t1").alias("id")), "id").select("fp", "node"))
    heads = stored(prints_of.groupBy("fp").agg(F.min("node").alias("hub"), F.count("*").alias("texts")))
    alike = joined_to_hot(prints_of.withColumn("key", F.col("node")), "fp", heads.where("texts > 1"), "texts").where("node <> hub").select("hub", F.col("node").alias("member"))
    edges = link_forest(heads, bits).distinct()
    name = lambda c, as_: heads.select(F.col("fp").alias(c), F.col("hub").alias(as_))
    return alike.union(edges.join(name("a", "hub"), "a").join(name("b", "member"), "b").select("hub", "member")).where("hub <> member").distinct()


def one_per_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row of each class, with all its columns: that of the smallest identifier (null last)."""
    found = stored(prints(docs, id_col, text_col, WORDS, BANDS, ROWS))
    place = F.struct(F.col("id").isNull().alias("none"), "id", "t1", "t2")
    distinct = found.where("key IS NOT NULL").groupBy("key").agg(F.min(place).alias("low"), F.first(F.struct("size", "bands", "slots", "t1", "t2")).alias("one"))
    distinct = stored(distinct.select("low", "one.*", F.monotonically_increasing_id().alias("node")))
    nodes = set_classes(distinct, docs, text_col, WORDS, percent, tree_proposals(docs, text_col, distinct))
    classes = distinct.join(nodes, "node", "left").select(F.coalesce("root", "node").alias("root"), "low")
    wordless = found.where("key IS NULL").select(F.lit(-1).cast("long").alias("root"), place.alias("low"))
    root, owner, left, right, one, two = unused(docs, "root", "owner", "left", "right", "one", "two")
    chosen = stored(classes.union(wordless).groupBy(F.col("root").alias(root)).agg(F.min("low").alias("low")).select(
        root, F.col("low.id").alias(owner), F.col("low.t1").alias(left), F.col("low.t2").alias(right)))
    rows = docs.withColumns(dict(zip((one, two), text_key(text_col))))
    met = rows.join(chosen, (F.col(one) == F.col(left)) & (F.col(two) == F.col(right)) & F.col(id_col).cast("long").eqNullSafe(F.col(owner)))
    return met.dropDuplicates([root]).select(docs.columns)
