"""Sources and sinks: tab-separated records without quoting, ground truth, match lists, Parquet, model metadata."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tessera.functions.text import record_text

RECORD = StructType([StructField(c, StringType()) for c in ("entity_id", "business_name", "business_address", "country")])
TRUTH = StructType([StructField(c, StringType()) for c in ("source1_entity_id", "matched_entity_ids")])


def read_tsv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Tab-separated with a header, no quote character, no inference."""
    return spark.read.schema(schema).option("sep", "\t").option("quote", "").option("header", True).csv(path)


def load_source(spark: SparkSession, path: str) -> DataFrame:
    """Records with null as empty."""
    return read_tsv(spark, path, RECORD).na.fill("")


def long_truth(wide: DataFrame, id_col: str = "source1_entity_id", list_col: str = "matched_entity_ids") -> DataFrame:
    """s1, cand: one row for each match, one with null for an S1 without any."""
    parts = F.split(F.coalesce(F.col(list_col), F.lit("")), ",")
    return wide.select(F.col(id_col).alias("s1"), F.explode_outer(parts).alias("cand")).withColumn("cand", F.nullif(F.trim("cand"), F.lit("")))


def truth_sets(truth: DataFrame) -> DataFrame:
    """s1, cands: the sorted set of each S1's matches, empty for none."""
    return truth.groupBy("s1").agg(F.array_sort(F.collect_set("cand")).alias("cands"))


def scan(spark: SparkSession, path: str, columns: list[str] | None = None, country: str | None = None) -> DataFrame:
    """Parquet records; the filter and the columns reach the files."""
    df = spark.read.parquet(path)
    df = df if country is None else df.where(F.col("country") == country)
    return df if columns is None else df.select(*columns)


def pool(second: DataFrame, third: DataFrame) -> DataFrame:
    """Both pool sources with src 2 or 3."""
    return second.withColumn("src", F.lit(2).cast("byte")).unionByName(third.withColumn("src", F.lit(3).cast("byte")))


def write_shards(df: DataFrame, path: str, by: str = "country") -> None:
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def match_lists(ids: DataFrame, pairs: DataFrame, column: str = "matched_entity_ids") -> DataFrame:
    """One row for every id (column s1): its candidates, unique, sorted, comma-joined; empty if it has none."""
    lists = pairs.groupBy("s1").agg(F.array_join(F.array_sort(F.collect_set(F.col("cand").cast("string"))), ",").alias(column))
    return ids.select("s1").distinct().join(lists, "s1", "left").na.fill("", [column]).withColumnRenamed("s1", "source1_entity_id")


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("quote", "").option("header", True).option("emptyValue", "").csv(path)


def same_candidates(first: DataFrame, second: DataFrame) -> bool:
    """Whether two candidate lists have the same rows, counted."""
    return first.exceptAll(second).isEmpty() and second.exceptAll(first).isEmpty()


def hybrid(first: DataFrame, second: DataFrame, ids_of_second: DataFrame, key: str = "source1_entity_id", candidates: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Rows of the second list for the given ids, of the first for all others. candidates: both runs' candidate lists; if they
    differ, the runs aren't of the same pairs, which is an error."""
    if candidates is not None and not same_candidates(*candidates):
        raise ValueError("the two runs have different candidates")
    ids = ids_of_second.select(key).distinct()
    return first.join(ids, key, "left_anti").unionByName(second.join(ids, key, "left_semi"))


def country_report(lists: DataFrame, countries: DataFrame, column: str = "matched_entity_ids") -> DataFrame:
    """country, n_s1, mean_list, empty_percent. countries: source1_entity_id, country."""
    size = F.when(F.col(column) == "", 0).otherwise(F.regexp_count(column, F.lit(",")) + 1)
    df = lists.join(countries, "source1_entity_id").withColumn("_n", size)
    return df.groupBy("country").agg(F.count("*").alias("n_s1"), F.round(F.avg("_n"), 3).alias("mean_list"), F.round(100 * F.avg((F.col("_n") == 0).cast("int")), 2).alias("empty_percent"))


def pair_texts(pairs: DataFrame, s1: DataFrame, cand: DataFrame) -> DataFrame:
    """pairs with text_a and text_b: name | address of either record (entity_id, business_name, business_address)."""
    side = lambda df, key, name: df.select(F.col("entity_id").alias(key), record_text(F.col("business_name"), F.col("business_address")).alias(name))
    return pairs.join(side(s1, "s1", "text_a"), "s1", "left").join(side(cand, "cand", "text_b"), "cand", "left")


def write_meta(spark: SparkSession, meta: dict, path: str) -> None:
    """Model metadata as one JSON row, through Spark, so that any store will do."""
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_meta(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first().value)


