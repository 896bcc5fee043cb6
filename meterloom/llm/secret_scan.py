"""Secret scan with a random forest against false positives, in DataFrame operations only.

Candidates are runs of at least ``SHORTEST`` key characters that hold a digit, no small letter, or a
change from small to capital letters; and whatever is assigned to a credential name or stands as the
password of an address, from ``ASSIGNED`` characters on, whatever its letters.  An assigned value ends
at white space, a quote or one of ``& ; , < >``, loses closing punctuation, and stands for the runs
inside it.  Features of a candidate: its length, its changes between
kinds of characters, the share of its letters that lie in words of a dictionary (the words that the
corpus itself uses at least ``DICTIONARY`` times), the path it was found under, and its neighbours:
credential names, assignment, quotes, and how often labelled findings beside the same words were
secrets.  The forest is trained on labelled findings, at most about ``LABELLED`` of them, drawn by
hash and in equal parts of each label, so a rare label is never lost; weights restore the true
rates.  It scores every candidate; what it holds unlikely is a false positive.

Labels come from the caller.  Where there are none, ``rule_labels`` labels what rules can settle:
issuer formats and values with a digit assigned to a credential name are secrets; plain numbers and
runs without a digit are not; the rest is left to the forest.  If only one kind of label exists, every
candidate gets it as its score.

Candidates are few and small; texts are never shuffled, only their words' counts.  Null and empty
texts have no candidates, repeated rows yield theirs each, null identifiers and paths stay null, an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterloom.llm.common import stored

SHORTEST, ASSIGNED, DICTIONARY, LABELLED, THRESHOLD, SEED = 16, 6, 5, 20_000, 0.5, 5
TREES, DEPTH = 30, 6
#: Key characters, formats of well-known issuers, names that announce a credential.
KEY = r"[A-Za-z0-9+/_\-]"
ISSUED = r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9\-]{10,}|AIza[0-9A-Za-z_\-]{35}|sk_live_[0-9a-zA-Z]{24,})$"
NAMED = r"(?i)(password|passwd|pwd|secret|token|api_?key|access_?key|auth|bearer|credential)"
#: A name with its assignment, the name alone, a value, and the password of an address.
ASSIGNS = NAMED + r"[A-Za-z0-9_\-]*['\"]?[=:]+>?"
NAME_ENDS = NAMED + r"[A-Za-z0-9_\-]*['\"]?$"
VALUE = r"['\"(]*([^'\"&;,<>]{%d,})" % ASSIGNED
ADDRESS = r"://[^/@:]*:([^/@]{%d,})@" % ASSIGNED
FEATURES = [
    "length", "digits", "capitals", "kind_changes", "case_changes", "vowel_changes", "distinct_share", "hex", "coverage",
    "path_depth", "path_test", "named", "named_near", "assigned", "address", "quoted", "before_rate",
]


def _follows_a_name(before: Column, before2: Column) -> Column:
    """Whether the words before end in a credential name and its assignment."""
    apart = before.rlike("^[=:]+>?$") & before2.rlike(NAME_ENDS)
    return F.coalesce(before.rlike("[=:]>?$") & (before.rlike(ASSIGNS + "$") | apart), F.lit(False))


def _assigned_values(token: Column, before: Column, before2: Column) -> Column:
    """Values of a word that are assigned to a credential name or are the password of an address."""
    inner = F.regexp_extract_all(token, F.lit(ASSIGNS + VALUE), F.lit(2))
    address = F.regexp_extract_all(token, F.lit(ADDRESS), F.lit(1))
    outer = F.when(_follows_a_name(before, before2), F.array(F.regexp_extract(token, "^" + VALUE, 1))).otherwise(F.array())
    trimmed = F.transform(F.concat(inner, address, outer), lambda v: F.regexp_replace(v, r"[.!?:)\]}]+$", ""))
    return F.filter(trimmed, lambda v: F.length(v) >= ASSIGNED)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """``id, path, at_word, candidate, token, before, before2, after`` of every candidate."""
    text = F.col(text_col).cast("string")
    words = F.split(text, r"[\x20\x09-\x0D]+")
    word = lambda i: F.get("words", i)  # noqa: E731 (null outside the text)
    holds = lambda i: (
        (F.length(word(i)) >= SHORTEST)
        | (F.col("speaks") & (F.length(word(i)) >= ASSIGNED) & (word(i).rlike(ASSIGNS + VALUE) | word(i).rlike(ADDRESS) | _follows_a_name(word(i - 1), word(i - 2)))))
    speaks = text.rlike(NAMED) | text.contains("://")
    placed = docs.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(path_col).cast("string").alias("path"), words.alias("words"), speaks.alias("speaks"))
    at = F.col("at_word") - 1
    placed = placed.withColumn("at_word", F.explode(F.transform(F.filter(F.sequence(F.lit(0), F.size("words") - 1), holds), lambda i: i + 1))).select(
        "id", "path", "at_word", word(at).alias("token"), word(at - 1).alias("before"), word(at - 2).alias("before2"), word(at + 1).alias("after"))
    runs = F.filter(
        F.regexp_extract_all("token", F.lit("(%s{%d,})" % (KEY, SHORTEST)), F.lit(1)),
        lambda run: run.rlike("[0-9]") | ~run.rlike("[a-z]") | run.rlike("[a-z][A-Z]"))
    found = placed.withColumn("values", _assigned_values(F.col("token"), F.col("before"), F.col("before2")))
    apart = F.filter(runs, lambda run: ~F.exists("values", lambda v: v.contains(run)))
    return found.withColumn("candidate", F.explode(F.concat(apart, F.array_distinct("values")))).drop("values")


def dictionary(docs: DataFrame, text_col: str = "text", least: int = DICTIONARY) -> DataFrame:
    """Words of three letters or more that the corpus uses at least ``least`` times."""
    words = docs.select(F.explode(F.split(F.lower(F.col(text_col)), r"[^\p{L}]+")).alias("word")).where(F.length("word") >= 3)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("word")


def features(found: DataFrame, words: DataFrame) -> DataFrame:
    """Candidates with their FEATURES, except ``before_rate``; ``found`` has a key ``row``."""
    c = F.col("candidate")
    count = lambda pattern: F.regexp_count(c, F.lit(pattern)).cast("double")
    size = F.length(c).cast("double")
    runs = found.select("row", F.explode(F.regexp_extract_all("candidate", F.lit("([A-Za-z]{3,})"), F.lit(1))).alias("run"))
    known = runs.join(words, F.lower("run") == F.col("word")).groupBy("row").agg(F.sum(F.length("run")).alias("letters"))
    context = F.concat_ws(" ", "before2", "before")
    ahead = F.expr("substring_index(token, candidate, 1)")
    shaped = found.withColumns({
        "length": size, "digits": count("[0-9]") / size, "capitals": count("[A-Z]") / size,
        "kind_changes": (count("[A-Za-z](?=[0-9])") + count("[0-9](?=[A-Za-z])")) / size,
        "case_changes": (count("[a-z](?=[A-Z])") + count("[A-Z](?=[a-z])")) / size,
        "vowel_changes": (count("(?i)[aeiou](?=[b-df-hj-np-tv-z])") + count("(?i)[b-df-hj-np-tv-z](?=[aeiou])")) / size,
        "distinct_share": F.size(F.array_distinct(F.split(c, ""))) / size, "hex": c.rlike("^[0-9a-f]+$").cast("double"),
        "path_depth": F.coalesce(F.regexp_count("path", F.lit("/")), F.lit(0)).cast("double"),
        "path_test": F.coalesce(F.col("path").rlike("(?i)(test|example|sample|fixture|mock)"), F.lit(False)).cast("double"),
        "named": ahead.rlike(NAMED).cast("double"),
        "named_near": context.rlike(NAMED).cast("double"),
        "assigned": (ahead.rlike(r"[=:]>?['\"(]*$") | F.coalesce(F.col("before").rlike(r"[=:]>?$"), F.lit(False))).cast("double"),
        "address": ahead.rlike("://[^/@:]*:$").cast("double"),
        "quoted": F.col("token").rlike(r"^['\"]|['\"]$").cast("double"),
    })
    return shaped.join(known, "row", "left").withColumn("coverage", F.coalesce(F.col("letters") / size, F.lit(0.0))).drop("letters")


def rule_labels(found: DataFrame) -> F.Column:
    """1 or 0 where rules settle the case, else null; for frames with FEATURES."""
    c = F.col("candidate")
    told = (F.col("named") + F.col("named_near") > 0) & (F.col("assigned") > 0)
    return (
        F.when(c.rlike(ISSUED) | (told & (F.col("digits") > 0)), 1.0)
        .when(~told & (F.col("address") == 0) & (c.rlike(r"^[0-9\-]+$") | ~c.rlike("[0-9]")), 0.0))


def with_neighbour_rates(shaped: DataFrame, labelled: DataFrame) -> DataFrame:
    """Adds ``before_rate``: the smoothed share of secrets among labelled findings after the same word.

    ``labelled`` has row, before, label, weight (how many findings a drawn one stands for).
    A labelled finding is not counted for itself, so the rate cannot give away its own label.
    """
    word = F.coalesce(F.regexp_replace(F.lower("before"), r"[^\p{L}=:]", ""), F.lit(""))
    rates = labelled.withColumn("beside", word).groupBy("beside").agg(F.sum(F.col("label") * F.col("weight")).alias("hits"), F.sum("weight").alias("all"))
    mine = labelled.select("row", F.col("label").alias("own"), F.col("weight").alias("own_weight"))
    joined = shaped.withColumn("beside", word).join(rates, "beside", "left").join(mine, "row", "left")
    hits, everything = (F.coalesce(x, F.lit(0.0)) for x in (F.col("hits") - F.coalesce(F.col("own") * F.col("own_weight"), F.lit(0.0)), F.col("all") - F.coalesce("own_weight", F.lit(0.0))))
    return joined.withColumn("before_rate", (hits + 1) / (everything + 2)).drop("beside", "hits", "all", "own", "own_weight")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", label=rule_labels, limit: int = LABELLED) -> DataFrame:
    """``id, path, at_word, candidate, label, score, secret`` of every candidate.

    ``label`` makes the column of labels from a frame of candidates with FEATURES.
    """
    found = stored(candidates(docs, id_col, text_col, path_col).withColumn("row", F.monotonically_increasing_id()))
    shaped = features(found, dictionary(docs, text_col))
    shaped = stored(shaped.withColumn("label", label(shaped)))
    labelled = shaped.where("label IS NOT NULL")
    kinds = {r[0]: r[1] for r in labelled.groupBy("label").count().collect()}
    draw = F.xxhash64("candidate", "id", "at_word", F.lit(SEED))
    part = F.lit(1.0)
    for kind, n in sorted(kinds.items()):  # all of a rare label, a share of a frequent one
        part = F.when(F.col("label") == kind, min(1.0, limit / len(kinds) / n) if sum(kinds.values()) > limit else 1.0).otherwise(part)
    drawn = labelled.withColumn("weight", 1 / part).where(F.pmod(draw, F.lit(1 << 30)) < F.floor(part * (1 << 30)))
    ready = stored(with_neighbour_rates(shaped, drawn.select("row", "before", "label", "weight")))
    # The sample is dealt and ordered by content, so the forest does not depend on where rows were read.
    sample = ready.join(drawn.select("row", "weight"), "row").withColumn("draw", draw).repartition(4, "draw").sortWithinPartitions("draw", *FEATURES)
    out = ["id", "path", "at_word", "candidate", "label"]
    if len(kinds) < 2:
        only = float(next(iter(kinds), 0.0))
        return ready.select(*out, F.lit(only).alias("score"), F.lit(only >= THRESHOLD).alias("secret"))
    gather = VectorAssembler(inputCols=FEATURES, outputCol="vector")
    forest = RandomForestClassifier(featuresCol="vector", labelCol="label", weightCol="weight", numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(gather.transform(sample))
    scored = forest.transform(gather.transform(ready)).withColumn("score", vector_to_array("probability")[1])
    return scored.select(*out, "score", (F.col("score") >= THRESHOLD).alias("secret"))


def op3_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
