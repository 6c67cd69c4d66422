"""An extension: new pool records are matched against a fixed S1 side as they arrive.

Exact keys are a stream-static join; each micro-batch then keeps the best S1 of every candidate and is written once per batch id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tessera.operators.decide import one_to_one


def match_stream(stream: DataFrame, s1: DataFrame) -> DataFrame:
    """s1, cand, p of arriving records with a known key. stream: id, key, p; s1: id, key."""
    known = s1.select(F.col("id").alias("s1"), "key")
    return stream.where("key <> ''").select(F.col("id").alias("cand"), "key", "p").join(known, "key").select("s1", "cand", "p")


def write_matches(matches: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """One folder for each batch, overwritten if the batch is run again."""

    def put(batch: DataFrame, batch_id: int) -> None:
        one_to_one(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return matches.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def claims_per_window(matches: DataFrame, time: str = "ts", size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """How many pairs arrive in each window of event time; later ones than the watermark are dropped."""
    return matches.withWatermark(time, late).groupBy(F.window(time, size).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")
