"""Benchmark decontamination by greedy string tiling.

The benchmark is a stated query set: its items are read in blocks of bounded size, and each block is broadcast to one map over
all documents, so a benchmark of any size costs more passes, never more memory. In a map, words are numbered by the block's
vocabulary, and Karp-Rabin hashes of `seed_words` words in a row find the seeds that a document shares with an item. Seeds on
one diagonal grow into runs; the longest unmarked run is marked again and again, and what is left of a run that overlaps a mark
goes back, until no unmarked match of `seed_words` words is left. The marked share of the item is its coverage, whatever the
order in which the document has its parts.

Words are runs of letters, digits and non-ASCII characters of the lower-cased text.

Defined results: null or empty texts and items match nothing, and neither does an item of fewer than `seed_words` words;
repeated rows are judged one by one; extra columns are ignored or kept as they are; a null id is carried through.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, text_column

#: Shortest match in words, and the covered share of an item from which a document counts as contaminated.
SEED_WORDS = 5
COVERAGE = 0.5
#: Most characters of benchmark text in one broadcast.
BLOCK_CHARS = 8 << 20

BASE = 0x9E3779B97F4A7C15
WORD_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def rolling(ids: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of k ids, modulo 2**64."""
    out = np.zeros(max(0, len(ids) - k + 1), np.uint64)
    for j in range(k):
        out = out * np.uint64(BASE) + ids[j : j + len(out)]
    return out


class Block:
    """Part of the benchmark, ready for tiling."""

    def __init__(self, items: list[tuple[int, str]], k: int) -> None:
        self.k = k
        self.vocabulary: dict[bytes, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # hashes, items, places: arrays, for a block has many
        for item_id, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text or "")], np.uint64)
            if len(ids) >= k:
                h = rolling(ids, k)
                parts.append((h, np.full(len(h), len(self.items), np.int32), np.arange(len(h), dtype=np.int32)))
                self.items.append((item_id, ids))
        every, owner, place = (np.concatenate(x) for x in zip(*parts)) if parts else (np.empty(0, np.uint64), *[np.empty(0, np.int32)] * 2)
        order = np.argsort(every, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.hashes, first = np.unique(every[order], return_index=True)
        self.first = np.concatenate([first, [len(every)]]).astype(np.int64)

    def matches(self, text: str, coverage: float) -> Iterator[tuple[int, int, int, int]]:
        """(item_id, item's words, words marked, tiles) of each item that the text covers."""
        if not len(self.hashes) or not text:
            return
        words = words_of(text)
        ids = np.fromiter(map(self.vocabulary.get, words, _zeros()), np.uint64, len(words))
        if len(ids) < self.k:
            return
        outside = np.cumsum(ids == 0)
        whole = np.flatnonzero(outside[self.k - 1 :] == np.concatenate([[0], outside[: -self.k]]))
        if not len(whole):
            return
        h = rolling(ids, self.k)[whole]
        at = np.searchsorted(self.hashes, h)
        at[at == len(self.hashes)] = 0
        hit = self.hashes[at] == h
        seeds = defaultdict(list)
        for t, slot in zip(whole[hit].tolist(), at[hit].tolist()):
            here = slice(self.first[slot], self.first[slot + 1])
            for item, p in zip(self.owner[here].tolist(), self.place[here].tolist()):
                seeds[item].append((t - p, p))
        for item, found in seeds.items():
            item_id, own = self.items[item]
            marked, tiles = tile(own, ids, found, self.k)
            if marked >= coverage * len(own):
                yield item_id, len(own), marked, tiles


def _zeros() -> Iterator[int]:
    while True:
        yield 0


def tile(item: np.ndarray, text: np.ndarray, seeds: list[tuple[int, int]], k: int) -> tuple[int, int]:
    """Words of the item that greedy tiling marks, and the number of tiles. seeds: (diagonal, place in the item)."""
    heap = []
    seeds.sort()
    i = 0
    while i < len(seeds):
        diagonal, start = seeds[i]
        end = start
        while i < len(seeds) and seeds[i][0] == diagonal and seeds[i][1] <= end + 1:
            end = seeds[i][1]
            i += 1
        length = end - start + k
        if (item[start : start + length] == text[diagonal + start : diagonal + start + length]).all():
            heap.append((-length, start, diagonal + start))
    heapq.heapify(heap)
    in_item = np.zeros(len(item), bool)
    in_text: set[int] = set()
    tiles = 0
    while heap:
        length, p, t = heapq.heappop(heap)
        free = [not in_item[p + j] and t + j not in in_text for j in range(-length)]
        if all(free):
            in_item[p : p - length] = True
            in_text.update(range(t, t - length))
            tiles += 1
            continue
        j = 0
        while j < -length:
            e = j
            while e < -length and free[e]:
                e += 1
            if e - j >= k:
                heapq.heappush(heap, (j - e, p + j, t + j))
            j = e + 1
    return int(in_item.sum()), tiles


def blocks(benchmark: DataFrame, k: int, chars: int = BLOCK_CHARS) -> Iterator[Block]:
    """The benchmark in blocks of so many characters, at least one item each; read one after the other."""
    held, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("long").alias("i"), text_column().alias("x")).orderBy("i", "x").toLocalIterator():
        if held and size + len(row.x) > chars:
            yield Block(held, k)
            held, size = [], 0
        held.append((row.i, row.x))
        size += len(row.x)
    if held:
        yield Block(held, k)


MATCHES = "doc_id long, item_id long, item_words long, covered_words long, tiles long"


def contaminated(docs: DataFrame, benchmark: DataFrame, seed_words: int = SEED_WORDS, coverage: float = COVERAGE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row for each document and each item that it covers to the given share or more."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"))
    out = None
    for block in blocks(benchmark, seed_words, block_chars):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(doc, *m) for doc, x in zip(batch.column(0).to_pylist(), batch.column(1)) for m in shared.value.matches(x.as_py(), coverage)]
                columns = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "item_words", "covered_words", "tiles"])

        found = texts.mapInArrow(run, MATCHES)
        out = found if out is None else out.unionAll(found)
    out = spark.createDataFrame([], MATCHES) if out is None else out
    return out.withColumn("coverage", F.col("covered_words") / F.col("item_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, seed_words: int = SEED_WORDS, coverage: float = COVERAGE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs, all columns as they are, whose text covers no item."""
    spark = docs.sparkSession
    place = docs.columns.index("text")
    for block in blocks(benchmark, seed_words, block_chars):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = [next(shared.value.matches(x.as_py() or "", coverage), None) is None for x in batch.column(place)]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, and how much of each."""
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
