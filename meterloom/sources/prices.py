"""Price override files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterloom.operators.pricing import RATE_FIELDS

# Cache rates as multiples of the input rate.
DERIVED_RATES = {"cache_read": 0.1, "cache_write_5m": 1.25, "cache_write_1h": 2.0}


def load_price_rules(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Valid rules and rejected entries of one JSON override file.

    A missing file gives nothing.  Invalid JSON, or a file without ``models``, gives no rules and one
    rejected entry without a key; the size of a file does not matter.
    """
    files = (
        spark.read.format("binaryFile").option("ignoreMissingFiles", True).load(path)
        if _exists(spark, path)
        else spark.createDataFrame([], "content binary")
    )
    return price_rules(files.select(F.col("content").cast("string").alias("value")))


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def price_rules(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As ``load_price_rules`` for a frame whose ``value`` holds the file's text."""
    whole = F.trim(F.regexp_replace("value", r"\s+$", ""))
    models = F.when(whole.endswith("}"), F.from_json("value", "models map<string,string>")["models"])
    entries = (
        texts.select(F.explode(models).alias("raw_key", "entry"))
        .withColumn("given", F.from_json("entry", "map<string,string>"))
        .withColumn("r", F.from_json("entry", ", ".join(f"{f} double" for f in RATE_FIELDS)))
    )

    def has(name: str) -> Column:
        return F.coalesce(F.map_contains_key("given", F.lit(name)), F.lit(False))

    def good(name: str) -> Column:
        v = F.col(f"r.{name}")
        return F.coalesce((v >= 0) & ~F.isnan(v) & (v < float("inf")), F.lit(False))

    parts = good("input") & good("output")
    for name in DERIVED_RATES:
        parts = parts & (~has(name) | good(name))
    judged = entries.withColumn("valid", F.when(has("blended"), good("blended")).otherwise(parts))
    component = ~has("blended")
    valid = judged.filter("valid").select(
        F.lower("raw_key").alias("key"),
        "raw_key",
        F.col("r.blended").alias("blended"),
        F.when(component, F.col("r.input")).alias("input"),
        F.when(component, F.col("r.output")).alias("output"),
        *[
            F.when(component, F.coalesce(f"r.{f}", F.col("r.input") * ratio)).alias(f)
            for f, ratio in DERIVED_RATES.items()
        ],
    )
    unread = texts.filter(models.isNull()).select(F.lit(None).cast("string").alias("raw_key"), F.col("value").alias("entry"))
    return valid, judged.filter(~F.col("valid")).select("raw_key", "entry").unionByName(unread)
