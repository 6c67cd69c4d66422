"""What the operators share: reading documents, cutting lineage, and helpers on whole texts."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import settled as cut
from tessera.session import shared_folder

__all__ = ["apart", "bounded", "cut", "documents", "merged", "shared_folder", "text_chunks", "text_column", "word_chunks"]


#: Most bytes of texts that go to a Python worker at once.
BATCH_BYTES = 8 << 20


def bounded(spark: SparkSession) -> SparkSession:
    """The session with Arrow batches of so many bytes: with the default of 64 MB two tasks of long texts take much of an executor."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounded(spark).read.parquet(f"{sf_dir}/documents.parquet")


def apart(df: DataFrame, *keys: str, values: int = 8) -> DataFrame:
    """df with a small hash of the keys as a further join key, `apart`.

    Next to an aggregate on the same keys a join takes the aggregate's partitioning over, and adaptive execution can't split a
    hot key. With a key more, the join deals both sides out itself, and it can. Joins in a row need different `values`."""
    return df.withColumn("apart", F.pmod(F.xxhash64(*keys), F.lit(values)))


def merged(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """The join of two sides that both grow with the corpus. It is never a broadcast: a side that has few bytes, or is thought to, may
    have many rows, and the driver would hold them all."""
    return left.join(right.hint("merge"), on, how)


def text_column(name: str = "text") -> "F.Column":
    """The text with null as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def text_chunks(text: str, size: int = 1 << 20) -> Iterator[str]:
    """Parts of a long text, cut only before white space, so that no word is cut."""
    if len(text) <= size:
        yield text
        return
    start, n = 0, len(text)
    while start < n:
        end = min(n, start + size)
        while end < n and not text[end].isspace():
            end += 1
        yield text[start:end]
        start = end


def word_chunks(raw: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words [^\\x20\\x09-\\x0D]+ of a text in UTF-8, in lists of bounded size; no word is cut."""
    if len(raw) <= size:
        yield raw.split()
        return
    start, n = 0, len(raw)
    while start < n:
        end = min(n, start + size)
        while end < n and raw[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield raw[start:end].split()
        start = end
