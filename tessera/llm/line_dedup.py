"""Exact substring dedup of lines or paragraphs and the sentences in them.

Units are the lines of a text, or its paragraphs (parts between empty lines), or the sentences of one that has several, so that a
passage is found in the middle of a line. A unit is normalised (lower case, single spaces, trimmed, without final marks) and
hashed to 128 bits. Digests are grouped over all documents with an aggregate that keeps only the earliest occurrence and a count;
occurrences are then matched with the digests found twice or more. Earliest is by doc_id, then by row, then by place in the text.
All occurrences but the earliest are removed, with their original offsets, where they are part of a run of neighbouring units that
all have an earlier occurrence somewhere and have `run_words` words or more together: a passage, not a phrase. Offsets are code
points of the original text, end exclusive; a sentence ends before its final mark if another one follows.

Units of fewer than `min_words` words are left alone; a run goes on behind them.

Defined results: a null or empty text has no units; rows without an id rank last; of rows that share an id the first by position
in the input ranks first; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import apart, cut, documents, text_column

MIN_WORDS = 3
RUN_WORDS = 20
BREAKS = {"line": re.compile(r"\n"), "paragraph": re.compile(r"\n[^\S\n]*\n\s*")}
SENTENCE = re.compile("[.!?] ")
MARKS = ".!?"
#: What goes with a unit: its final marks, and the space or line break behind them.
BEHIND = re.compile(r"[.!?]*[ \n]?")
FIELDS = ["doc_id", "row", "seq", "unit", "part", "start", "end", "words", "high", "low"]


def split(text: str, at: re.Pattern, start: int, end: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the parts of text[start:end]."""
    for m in at.finditer(text, start, end):
        yield start, m.start()
        start = m.end()
    yield start, end


def split_units(text: str, kind: str) -> Iterator[tuple[int, int, int, int]]:
    """(unit, part, start, end): the sentences of a line or paragraph that has several count from 1, else it is part 0."""
    for unit, (a, b) in enumerate(split(text, BREAKS[kind], 0, len(text))):
        parts = list(split(text, SENTENCE, a, b))
        for i, (c, d) in enumerate(parts, 1):
            yield unit, i if len(parts) > 1 else 0, c, d


def numbered(docs: DataFrame) -> DataFrame:
    """row, doc_id and text. Only a checkpoint of it, or of what is made of it, has the same numbers each time."""
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"))


def units(rows: DataFrame, kind: str, min_words: int) -> DataFrame:
    """A row for each unit of enough words; seq numbers those of a text. rows: row, doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row, doc, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                text, seq = x.as_py(), 0
                for unit, part, a, b in split_units(text, kind):
                    words = text[a:b].lower().split()
                    if len(words) >= min_words:
                        digest = xxhash.xxh3_128_digest(" ".join(words).rstrip(MARKS).encode("utf-8", "surrogatepass"))
                        high, low = (int.from_bytes(d, "big", signed=True) for d in (digest[:8], digest[8:]))
                        out.append((doc, row, seq, unit, part, a, b, len(words), high, low))
                        seq += 1
                if len(out) > 20_000:
                    yield as_batch(out)
                    out = []
            yield as_batch(out)

    return rows.mapInArrow(run, ", ".join(f"{f} long" for f in FIELDS))


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(FIELDS)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=FIELDS)


def repeats_in(rows: DataFrame, kind: str, min_words: int, run_words: int) -> DataFrame:
    found = cut(units(rows, kind, min_words))
    counts = found.groupBy("high", "low").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    twice = apart(found, "high", "low").join(apart(counts, "high", "low"), ["high", "low", "apart"])
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "unit", "part")
    first = twice.groupBy("high", "low").agg(F.min(rank).alias("first"))
    both = apart(twice, "high", "low", values=7).join(apart(first, "high", "low", values=7), ["high", "low", "apart"])
    later = both.where((F.col("row") != F.col("first.row")) | (F.col("unit") != F.col("first.unit")) | (F.col("part") != F.col("first.part")))
    run = F.col("seq") - F.row_number().over(Window.partitionBy("row").orderBy("seq"))  # the same for neighbours
    total = F.sum("words").over(Window.partitionBy("row", "run"))
    kept = [F.col(f"first.{c}").alias(f"kept_{c}") for c in ("doc_id", "unit", "part")]
    return later.withColumn("run", run).withColumn("total", total).where(F.col("total") >= run_words).select("doc_id", "row", "unit", "part", "start", "end", *kept)


def repeats(docs: DataFrame, kind: str = "line", min_words: int = MIN_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """A row for each unit to be removed: doc_id, row, unit, part, start, end, and doc_id, unit and part of the one that stays."""
    return repeats_in(numbered(docs), kind, min_words, run_words)


def deduplicate(docs: DataFrame, kind: str = "line", min_words: int = MIN_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """doc_id, text without the repeated units, and removed: the (start, end) spans taken out of the original text."""
    rows = cut(numbered(docs))
    spans = repeats_in(rows, kind, min_words, run_words).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("removed"))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for text, removed in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                at, parts = 0, []
                for s in removed or ():
                    parts.append(text[at : max(at, s["start"])])
                    at = max(at, BEHIND.match(text, s["end"]).end())
                kept.append("".join([*parts, text[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string()), batch.column(2)], names=["doc_id", "text", "removed"])

    whole = rows.join(spans, "row", "left").select("doc_id", "text", "removed")
    return whole.mapInArrow(strip, "doc_id long, text string, removed array<struct<start: long, end: long>>")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines and sentences of repeated passages but the first of each, with their original offsets."""
    return repeats(documents(spark, sf_dir)).drop("row")
