"""Language identification by nearest centroid.

Features are the bytes' bigrams and trigrams of the lower-cased text, without digits and ASCII punctuation, hashed into a fixed
number of dimensions; a vector is (1 + ln tf) * idf, of length one. Each language has several centroids, found by spherical
k-means. A text takes the language of the nearest centroid by cosine, and is marked as rejected if it is farther from it than
nearly all that the centroids were fitted on.

The fit is on a bounded sample: at most SAMPLE labelled rows in all, the same share of it for each language, chosen by a hash of
the id. Prediction reads whole texts of all rows.

Defined results: a null text or one without a letter is `und` with score 0, and so is every text if no row has a label; rows
without an id are predicted but not learned from; repeated rows are predicted one by one; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.llm.common import documents

DIMENSIONS = 1 << 13
#: Bound on the labelled rows that the fit looks at, over all languages.
SAMPLE = 2400
CENTROIDS = 4
ROUNDS = 12
#: Share of the fitted texts that lie beyond the rejection distance.
REJECT_SHARE = 0.005
UNKNOWN = "und"

LETTER = re.compile(r"[^\W\d_]")
PLAIN = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def counts(text: str, size: int = 1 << 20) -> np.ndarray:
    """Hashed n-gram counts of a whole text, taken in parts that overlap by two bytes."""
    raw = text.lower().encode("utf-8", "surrogatepass").translate(PLAIN)
    out = np.zeros(DIMENSIONS, np.int64)
    for start in range(0, max(1, len(raw)), size):
        b = np.frombuffer(raw[max(0, start - 2) : start + size], np.uint8).astype(np.uint32)
        first = start == 0
        if len(b) > 1:
            two = b[:-1] * np.uint32(0x01000193) ^ b[1:] * np.uint32(0x85EBCA6B)
            h2 = two[0 if first else 1 :]
            out += np.bincount((h2 ^ h2 >> np.uint32(15)) & np.uint32(DIMENSIONS - 1), minlength=DIMENSIONS)
            h3 = two[:-1] * np.uint32(0x9E3779B1) + b[2:] * np.uint32(0xC2B2AE35)
            out += np.bincount((h3 >> np.uint32(13)) & np.uint32(DIMENSIONS - 1), minlength=DIMENSIONS)
    return out


def damped(found: np.ndarray) -> np.ndarray:
    return np.where(found > 0, 1 + np.log(np.maximum(found, 1)), 0).astype(np.float32)


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=-1, keepdims=True), 1e-12)


@dataclass
class Model:
    languages: list[str]  # of each centroid
    idf: np.ndarray
    centroids: np.ndarray
    least: np.ndarray  # cosine below which a centroid rejects

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not LETTER.search(text) or not self.languages:
            return UNKNOWN, 0.0, True
        found = counts(text)
        some = np.flatnonzero(found)
        v = damped(found[some]) * self.idf[some]
        cosine = self.centroids[:, some] @ v / max(float(np.linalg.norm(v)), 1e-12)
        i = int(np.argmax(cosine))
        return self.languages[i], float(min(1.0, max(0.0, cosine[i]))), bool(cosine[i] < self.least[i])


def k_means(rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Centroids and the rows' cosines to their own; starts from the rows farthest from the centroids so far."""
    centroids = unit(rows.mean(axis=0, keepdims=True))
    while len(centroids) < min(k, len(rows)):
        centroids = np.vstack([centroids, rows[np.argmin((rows @ centroids.T).max(axis=1))]])
    for _ in range(ROUNDS):
        own = (rows @ centroids.T).argmax(axis=1)
        centroids = unit(np.vstack([rows[own == i].mean(axis=0) if (own == i).any() else c for i, c in enumerate(centroids)]))
    return centroids, rows @ centroids.T


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """labelled: doc_id, text, lang, none of them null."""
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], np.ones(DIMENSIONS, np.float32), np.zeros((0, DIMENSIONS), np.float32), np.zeros(0))
    share = max(1, sample // len(sizes))
    spark = labelled.sparkSession
    wanted = spark.createDataFrame([(k, min(1.0, 1.2 * share / n)) for k, n in sizes.items()], "lang string, wanted double")
    order = F.xxhash64(F.col("doc_id"), F.lit("sample"))
    chosen = labelled.join(F.broadcast(wanted), "lang").withColumn("order", order).where((F.col("order") / 2.0**64 + 0.5) < F.col("wanted"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("order", "doc_id"))
    chosen = chosen.withColumn("place", place).where(F.col("place") <= share).select("lang", "order", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = pa.array([damped(counts(x.as_py())).astype(np.float16).tobytes() for x in batch.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), v], names=["lang", "order", "v"])

    rows = sorted(chosen.mapInArrow(run, "lang string, order long, v binary").collect(), key=lambda r: (r.lang, r.order, bytes(r.v)))
    x = np.vstack([np.frombuffer(bytes(r.v), np.float16).astype(np.float32) for r in rows])
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1).astype(np.float32)
    x = unit(x * idf)
    languages, centroids, least = [], [], []
    for lang in sorted({r.lang for r in rows}):
        own = x[[r.lang == lang for r in rows]]
        c, cosines = k_means(own, CENTROIDS)
        languages += [lang] * len(c)
        centroids.append(c)
        least += [float(np.quantile(cosines.max(axis=1), REJECT_SHARE))] * len(c)
    return Model(languages, idf, np.vstack(centroids).astype(np.float32), np.array(least))


def predict(docs: DataFrame, model: Model, keep: list[str] = ()) -> DataFrame:
    """doc_id, the kept columns, lang_pred, score and rejected of each row; reads nothing of a row but its text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, "text")
    schema = T.StructType([*kept.drop("text").schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(zip(*(shared.value.predict(x.as_py()) for x in batch.column(batch.num_columns - 1)))) or [(), (), ()]
            new = [pa.array(c, t) for c, t in zip(found, (pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays(batch.columns[:-1] + new, names=schema.names)

    return kept.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is 2 modulo 4; false without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document, learned from three quarters of them."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    labelled = docs.where("not held_out").select("doc_id", "text", "lang").dropna()
    return predict(docs.select("doc_id", "held_out", "text"), fit(labelled), ["held_out"])
