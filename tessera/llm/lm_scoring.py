"""Cross-entropy difference between a target and a background n-gram model.

Both are interpolated bigram models over one vocabulary, all words of all documents; words and pairs of words are counted as
they are, under 64-bit digests, so the models grow with the corpus. They are matched: same order, vocabulary and smoothing, the
background's counts are scaled to the target's number of tokens, and no model has seen the text that it scores: a text's own
counts are taken off the sums that it is in. (Otherwise the background, which is all documents, would know each text by heart, and
the score would tell the target's texts from others instead of what is like them.) A document's score is its mean loss per token
under the target model less that under the background model: the lower, the more it is like the target.

No model is gathered. Documents are put into bags of bounded size, a bag counts its own words, ends of texts and pairs, and sends
the counts to slices of the digests' range. A slice adds up what all bags sent and answers each bag with the sums of the digests
that the bag has; the bag's documents are scored with these. A common word or pair is one entry in each bag, so no slice is hot,
and the number of slices grows with the number of entries.

Words are split at white space, lower-cased.

Defined results: a null text or one without words has no tokens and a null score; if the target is empty, all scores are null;
documents that share an id are scored one by one; an id is in the target if any of its labels says so; a text that is the whole
target has the score 0; of a text that is longer than a bag each part counts as a text of its own in what is taken off.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, documents, text_column, word_chunks

#: The vocabulary counts as this power of two of words at least, so that a small corpus leaves room for unseen words.
WORD_BITS = 17
#: Weight of the pair model, and what each word's count is raised by.
PAIR_WEIGHT = 0.6
RAISE = 0.5
#: Words in a bag, entries in a slice, and the least number of slices.
BAG_WORDS = 1 << 21
SLICE_ENTRIES = 1 << 21
SLICES = 64

BAG = "bag long, entries long, rows array<long>, ids array<long>, lengths array<int>, tokens binary, words binary"
BLOCK = "slice long, bag long, asks boolean, keys binary, counts binary"
ANSWER = "bag long, slice long, totals array<long>, counts binary"
PART = "row long, doc_id long, n long, target double, background double"


def cells(words: list[bytes]) -> np.ndarray:
    """The words' digests; 0 stands for the start of a text."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def pair_cells(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The pairs' digests."""
    h = (left * np.uint64(0x9E3779B97F4A7C15)) ^ (right * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9))
    for _ in range(2):
        h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


def pack(a: np.ndarray) -> bytes:
    """Numbers, byte planes apart, compressed."""
    planes = np.ascontiguousarray(np.frombuffer(a.tobytes(), np.uint8).reshape(-1, a.itemsize).T)
    return a.nbytes.to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(raw: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def bags(texts: DataFrame) -> DataFrame:
    """Documents as the numbers of their words in a bag, with the words' digests. texts: doc_id, text.

    A text's part starts with the number of the word before it, 0 for none. A text longer than a bag has parts in several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = bag = TaskContext.get().partitionId() << 33
        number: dict[bytes, int] = {}
        parts: list[tuple] = []
        n = 0

        def settle() -> pa.RecordBatch:
            tokens = np.concatenate([p[2] for p in parts])
            words = cells(list(number))
            often = np.argsort(-np.bincount(tokens, minlength=len(words) + 1)[1:], kind="stable")  # low numbers for common words
            new = np.zeros(len(words) + 1, np.int32)
            new[often + 1] = np.arange(1, len(words) + 1)
            tokens, words = new[tokens], np.concatenate([np.zeros(1, np.uint64), words[often]])
            rows, ids = ([p[i] for p in parts] for i in range(2))
            lengths = [len(p[2]) for p in parts]
            values = [[bag], [len(entries(tokens, lengths, words)[0])], [rows], [ids], [lengths], [pack(tokens)], [words.tobytes()]]
            types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], names=[c.split()[0] for c in BAG.split(", ")])

        for batch in batches:
            for doc, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                last: bytes | None = None
                for words in word_chunks(x.as_py().lower().encode("utf-8", "surrogatepass")):
                    before = 0 if last is None else number.setdefault(last, len(number) + 1)
                    own = np.fromiter((number.setdefault(w, len(number) + 1) for w in words), np.int32, len(words))
                    parts.append((row, doc, np.concatenate([np.array([before], np.int32), own])))
                    last = words[-1] if words else last
                    n += len(words) + 1
                    if n >= BAG_WORDS:
                        yield settle()
                        bag, number, parts, n = bag + 1, {}, [], 0
                row += 1
        if parts:
            yield settle()

    return texts.select("doc_id", "text").mapInArrow(run, BAG)


def entries(tokens: np.ndarray, lengths: list[int], words: np.ndarray) -> tuple:
    """A bag's sorted distinct keys, and for each token behind a part's first the places of its word, the word before and the pair.

    Words have odd keys, the start of a text too, pairs even ones."""
    first = np.zeros(len(tokens), bool)
    first[np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)] = True
    at = np.flatnonzero(~first)
    left, right = tokens[at - 1].astype(np.int64), tokens[at].astype(np.int64)
    codes, pair = np.unique(left * len(words) + right, return_inverse=True)
    both = pair_cells(words[codes // len(words)], words[codes % len(words)]) & np.uint64(0xFFFFFFFFFFFFFFFE)
    keys, place = np.unique(np.concatenate([words | np.uint64(1), both]), return_inverse=True)
    return keys, at, place[right], place[left], place[len(words) + pair]


def unbag(r: dict) -> tuple:
    return entries(unpack(r["tokens"], "<i4"), r["lengths"], np.frombuffer(r["words"], "<u8"))


def blocks(found: DataFrame, slices: int, counted: bool, asks: bool) -> DataFrame:
    """The keys of each bag with how often each is found and how often it is the word before another, in the target (rows `good`)
    and in all texts: one row for each slice. With counted=False the bag counts for nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                keys, at, word, before, pair = unbag(r)
                counts = np.zeros((4, len(keys)), np.int64)
                if counted:
                    good = np.repeat(np.isin(r["rows"], r["good"] or []), r["lengths"])[at]
                    for i, chosen in enumerate((good, slice(None))):
                        seen, context = (np.bincount(p[chosen], minlength=len(keys)) for p in (word, before))
                        counts[i] = seen + np.bincount(pair[chosen], minlength=len(keys))
                        counts[2 + i] = context - seen  # nearly always 0: only starts and ends of texts differ
                ends = bounds(keys, slices)
                cuts = list(zip(ends[:-1], ends[1:]))
                n = len(cuts)
                steps = [pack(np.diff(keys[a:b], prepend=np.uint64(0))) for a, b in cuts]
                yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([r["bag"]] * n, pa.int64()), pa.array([asks] * n), pa.array(steps, pa.binary()), pa.array([pack(counts[:, a:b]) for a, b in cuts], pa.binary())], names=["slice", "bag", "asks", "keys", "counts"])

    return found.mapInArrow(run, BLOCK)


def bounds(keys: np.ndarray, slices: int) -> list[int]:
    starts = np.array([(i << 64) // slices for i in range(1, slices)], np.uint64)
    return [0, *np.searchsorted(keys, starts).tolist(), len(keys)]


def answer(table: pa.Table) -> pa.Table:
    """The sums over all bags of one slice for each bag that asks, and the slice's tokens of the target, tokens and words."""
    sent = [np.cumsum(unpack(x.as_py(), "<u8"), dtype=np.uint64) for x in table["keys"]]
    keys, place = np.unique(np.concatenate(sent), return_inverse=True)
    sums = np.zeros((4, len(keys)), np.int64)
    at = np.concatenate([[0], np.cumsum([len(x) for x in sent])]).astype(np.int64)
    for i, x in enumerate(table["counts"]):
        sums[:, place[at[i] : at[i + 1]]] += unpack(x.as_py(), "<i8").reshape(4, -1)  # a bag has a key once
    word = (keys & np.uint64(1)).astype(bool) & (sums[1] > 0)
    totals = [int(sums[0, word].sum()), int(sums[1, word].sum()), int(word.sum())]
    asked = [i for i, x in enumerate(table["asks"].to_pylist()) if x]
    columns = [table["bag"].take(pa.array(asked, pa.int64())).combine_chunks(), table["slice"].take(pa.array(asked, pa.int64())).combine_chunks()]
    columns += [pa.array([totals] * len(asked), pa.list_(pa.int64())), pa.array([pack(sums[:, place[at[i] : at[i + 1]]]) for i in asked], pa.binary())]
    return pa.table(columns, names=["bag", "slice", "totals", "counts"])


def in_part(part: np.ndarray, place: np.ndarray, tokens: int = 1 << 17) -> np.ndarray:
    """For each token how often its place occurs in the same part; some parts at a time, for the search sorts."""
    out = np.empty(len(part), np.int32)
    ends = np.flatnonzero(np.diff(part, append=-1)) + 1
    start = 0
    while start < len(part):
        end = int(ends[min(len(ends) - 1, np.searchsorted(ends, start + tokens))])
        codes = (part[start:end] - part[start]) * (place.max() + 1) + place[start:end]
        _, at, times = np.unique(codes, return_inverse=True, return_counts=True)
        out[start:end] = times[at]
        start = end
    return out


def losses(own: pa.Table, answers: pa.Table) -> pa.Table:
    """Sums of the losses of the parts in a bag."""
    r = own.to_pylist()[0]
    _, at, word, before, pair = unbag(r)
    told = sorted(answers.to_pylist(), key=lambda x: x["slice"])
    tokens, every, vocabulary = (sum(x["totals"][i] for x in told) for i in range(3))
    sums = np.concatenate([unpack(x["counts"], "<i8").reshape(4, -1) for x in told], axis=1)
    part = np.repeat(np.arange(len(r["lengths"])), r["lengths"])[at]
    size = np.array(r["lengths"])[part] - 1
    seen_here = [in_part(part, x) for x in (word, before, pair)]
    # what the target and all documents have counted of the text itself
    counted = [np.isin(r["rows"], r["good"] or [])[part], np.ones(len(part), bool)] if r["counted"] else [np.zeros(len(part), bool)] * 2
    n_target, n_every = (n - size * c for n, c in zip((tokens, every), counted))
    found = []
    for i, scale in ((0, np.ones(len(part))), (1, n_target / np.maximum(1, n_every))):
        one, seen, both = (x - h * counted[i] for x, h in zip((sums[i][word], (sums[i] + sums[2 + i])[before], sums[i][pair]), seen_here))
        p = (one * scale + RAISE) / (n_target + RAISE * max(1 << WORD_BITS, vocabulary))
        p = np.where((seen > 0) & (scale > 0), PAIR_WEIGHT * both / np.maximum(seen, 1) + (1 - PAIR_WEIGHT) * p, p)
        found.append(-np.bincount(part, np.log(p), len(r["lengths"])) if tokens else [None] * len(r["lengths"]))
    values = [r["rows"], r["ids"], [n - 1 for n in r["lengths"]], *found]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    return pa.table([pa.array(v, t) for v, t in zip(values, types)], names=["row", "doc_id", "n", "target", "background"])


@dataclass
class Models:
    """Both models, as the bags of the documents that they count, and (bag, good): the rows in them that the target has."""

    docs: DataFrame
    bags: DataFrame
    good: DataFrame


def fit(docs: DataFrame, target_ids: DataFrame) -> Models:
    """docs: doc_id, text. target_ids: doc_id of the target's documents."""
    own = cut(bags(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"))))
    target = target_ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    rows = own.select("bag", F.explode(F.arrays_zip("rows", "ids")).alias("r")).select("bag", "r.rows", F.col("r.ids").alias("doc_id"))
    # the labels grow with the corpus: the same join at every size, instead of a broadcast of small ones
    good = rows.join(target.hint("merge"), "doc_id").groupBy("bag").agg(F.collect_set("rows").alias("good"))
    return Models(docs, own, good)


def score(docs: DataFrame, models: Models) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score of each document."""
    same = docs is models.docs
    own = models.bags if same else cut(bags(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"))))
    size = (models.bags if same else models.bags.unionByName(own)).agg(F.sum("entries")).first()[0] or 0
    slices = max(SLICES, -(-size // SLICE_ENTRIES))
    sent = blocks(models.bags.join(models.good, "bag", "left"), slices, True, same)
    sent = sent if same else sent.unionByName(blocks(own, slices, False, True))
    told = sent.groupBy("slice").applyInArrow(answer, ANSWER)
    asking = own.join(models.good, "bag", "left").withColumn("counted", F.lit(True)) if same else own.withColumns({"good": F.lit(None).cast("array<long>"), "counted": F.lit(False)})
    parts = asking.groupBy("bag").cogroup(told.groupBy("bag")).applyInArrow(losses, PART)
    out = parts.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sum("n").alias("n_tokens"), F.sum("target").alias("t"), F.sum("background").alias("b"))
    mean = lambda c: F.when(F.col("n_tokens") > 0, F.col(c) / F.col("n_tokens"))
    out = out.select("doc_id", "n_tokens", mean("t").alias("target_loss"), mean("b").alias("background_loss"))
    return out.withColumn("score", F.col("target_loss") - F.col("background_loss"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against the labelled ones of good quality."""
    docs = documents(spark, sf_dir)
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    return score(docs, fit(docs, good))
