"""Packing of tokenised documents into sequences by Karmarkar-Karp multiway differencing.

Two steps. A map over the texts turns each document into ids and cuts it into pieces: whole windows first, then the tail in
pieces of at most `piece` ids. Only the pieces' measures (no ids) are then dealt out evenly, and each task packs them in blocks
of a bounded number of windows. A block's pieces start as partial partitions with one load each; the two with the largest
spread are merged again and again, largest loads against smallest, until one partition into near-equal windows is left. When
its largest window exceeds the capacity, the block is packed again with one window more.

Defined results: a null or empty text is the single end id; documents that share an id are packed as separate documents; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, text_chunks, text_column

CAPACITY = 2048
END_ID = 1
#: Longest piece of a tail, and windows of a block: bounds on the work of one merge, not on the data.
PIECE = 256
BLOCK_WINDOWS = 256
#: Words whose ids a worker remembers, and characters of texts that it takes apart at once.
MEMO = 300_000
CHUNK = 1 << 18

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


#: Final marks that the tokenizer splits from the letters before them.
MARKS = ".,;:!?|)"
#: Where Python's splitting or lower-casing differs from the tokenizer's: U+001C to U+001F and the capital sigma.
ODD = re.compile("[\x1c-\x1f\u03a3]")


END = "</w>"


def letter_encoder(vocabulary: dict[str, int]):
    """The same merges for words of letters, each with a NUL behind it in the place of the word end.

    A merge's rank is its id in the file, single bytes with a word end come before all merges, and a pair can only ever merge
    into a token of the vocabulary by the rule that made that token, so ranks of joined bytes give the same merges."""
    import tiktoken

    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    ranks = {}
    for token, i in vocabulary.items():
        body = token.removesuffix(END) if len(token) > len(END) else token
        if all(c in byte for c in body):
            ranks[bytes(map(byte.get, body)) + b"\0" * (body != token)] = i
    return tiktoken.Encoding("letters", pat_str="[^\0]+\0", mergeable_ranks=ranks, special_tokens={})


class Codes(dict):
    """A number for each word, given out as words come up; `new` lists those without ids."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = code = len(self)
        self.new.append(word)
        return code


class WordIds:
    """Ids of whole texts, remembered by word.

    The tokenizer of the given file never joins characters across white space and lower-cases each character by itself, so a
    text's ids are the ids of its lower-cased words in turn. Normalised words of letters are learned many at a time; the last id
    of each is one that ends a word. A text with a character of ODD goes to the tokenizer whole."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core, and each thread holds memory of its own
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for x, i in vocabulary.items() if x.endswith(END)]] = True
        self.letters = letter_encoder(vocabulary)
        self.clear()

    def clear(self) -> None:
        self.code = Codes()
        self.used = 0
        self.flat = np.empty(1 << 18, np.uint16 if len(self.ends_word) <= 1 << 16 else np.uint32)
        self.first = np.zeros(1 << 16, np.int64)
        self.count = np.zeros(1 << 16, np.int64)

    def add(self, codes: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while len(self.code) > len(self.first):
            self.first, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.count))
        self.flat[self.used : self.used + len(ids)] = ids
        self.first[codes] = self.used + np.cumsum(counts) - counts
        self.count[codes] = counts
        self.used += len(ids)

    def learn(self) -> None:
        """The ids of the words that have a code but no ids yet."""
        new, code = self.code.new, self.code
        letters, other, marked = [], [], []
        for w in new:  # grows as the parts of words get codes of their own
            if w.isalpha() and (w.isascii() or is_normalized("NFC", w)):
                letters.append(w)
                continue
            core = w.rstrip(MARKS)
            if len(core) < len(w) and core.isalpha() and (core.isascii() or is_normalized("NFC", core)):
                marked.append((code[w], code[core], code[w[len(core) :]]))
            else:
                other.append(w)
        for i in range(0, len(letters), 16384):
            part = letters[i : i + 16384]
            ids = np.array(self.letters.encode_ordinary("\0".join([*part, ""])), np.int64)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            self.add(np.fromiter(map(code.__getitem__, part), np.int64, len(part)), ids, np.diff(ends, prepend=0))
        for i in range(0, len(other), 4096):
            part = other[i : i + 4096]
            ids = [x.ids for x in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            counts = np.fromiter(map(len, ids), np.int64, len(ids))
            self.add(np.fromiter(map(code.__getitem__, part), np.int64, len(part)), np.fromiter(chain.from_iterable(ids), np.int64, counts.sum()), counts)
        if marked:
            whole, core, mark = np.array(marked).T
            ids, counts = self.known(np.stack([core, mark], axis=1).ravel())
            self.add(whole, ids, counts[0::2] + counts[1::2])
        new.clear()

    def known(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, count = self.first[codes], self.count[codes]
        before = np.cumsum(count)
        total = int(before[-1]) if len(before) else 0
        return self.flat[np.repeat(first - before + count, count) + np.arange(total)], count

    def of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in turn, and the number of ids of each word."""
        if len(self.code) > MEMO:
            self.clear()
        codes = np.fromiter(map(self.code.__getitem__, words), np.int64, len(words))
        if self.code.new:
            self.learn()
        return self.known(codes)

    def texts(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        held: list[str] = []
        size = 0
        for text in texts:
            if size and size + len(text) > CHUNK:
                yield from self.together(held)
                held, size = [], 0
            held.append(text)
            size += len(text)
        yield from self.together(held)

    def together(self, texts: list[str]) -> Iterator[np.ndarray]:
        if len(texts) == 1:
            yield self.long(texts[0])
            return
        words: list[str] = []
        ends = [0]
        odd = {}
        for i, text in enumerate(texts):
            if ODD.search(text):
                odd[i] = self.long(text)
            else:
                words += text.lower().split()
            ends.append(len(words))
        ids, count = self.of_words(words)
        at = np.concatenate([[0], np.cumsum(count)])[ends]
        for i in range(len(texts)):
            yield odd[i] if i in odd else ids[at[i] : at[i + 1]]

    def long(self, text: str) -> np.ndarray:
        if ODD.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        parts = [self.of_words(words)[0] for x in text_chunks(text) if (words := x.lower().split())]
        return np.concatenate(parts) if parts else np.empty(0, np.uint32)


_loaded: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def cuts(n: int, capacity: int, piece: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: whole windows, then the tail in pieces and a remainder.

    The remainders' many lengths are what lets the merges level the windows."""
    base = n - n % capacity
    return [(a, capacity) for a in range(0, base, capacity)] + [(a, min(piece, n - a)) for a in range(base, n, piece)]


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, piece: int = PIECE, end_id: int = END_ID) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = word_ids(tokenizer or default_tokenizer())
        tail = np.array([end_id], "<u4")
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), memo.texts(x.as_py() for x in batch.column(1))):
                raw = memoryview(np.concatenate([ids.astype("<u4", copy=False), tail])).cast("B")
                n = len(ids) + 1
                rows += [(doc, a, k, zlib.crc32(raw[4 * a : 4 * (a + k)]), n) for a, k in cuts(n, capacity, piece)]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text")).mapInArrow(run, PIECES)


def differencing(lengths: np.ndarray, windows: int) -> np.ndarray:
    """The window of each length, by Karmarkar-Karp multiway differencing; ties by position."""
    m = len(lengths)
    if windows == 1 or not m:
        return np.zeros(m, np.int64)
    loads: list = [None] * m
    made: list = [None] * m  # (left, right, left's slots, right's slots) in the merged order
    heap = [(-int(x), i) for i, x in enumerate(lengths)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        total = np.zeros(windows, np.int64)
        if loads[a] is None:
            total[0] = lengths[a]
        else:
            total += loads[a]
        if loads[b] is None:
            total[-1] += lengths[b]
        else:
            total += loads[b][::-1]
        order = np.argsort(-total, kind="stable")
        total = total[order]
        made.append((a, b, order, windows - 1 - order))
        loads.append(total - total[-1])  # only differences matter from here on
        loads[a] = loads[b] = False
        heapq.heappush(heap, (-int(total[0] - total[-1]), len(loads) - 1))
    window = np.empty(m, np.int64)
    stack = [(heap[0][1], np.arange(windows))]
    while stack:  # from the last partition down: which window each slot has become
        node, slots = stack.pop()
        if made[node] is None:
            window[node] = slots[0]
            continue
        a, b, left, right = made[node]
        for child, own in ((a, left), (b, right)):
            back = np.empty(windows, np.int64)
            back[own] = slots
            stack.append((child, back))
    return window


def near_equal(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Windows within the capacity; their number rises until the largest fits."""
    windows = max(1, -(-int(lengths.sum()) // capacity))
    while True:
        window = differencing(lengths, windows)
        if np.bincount(window, lengths, windows).max(initial=0) <= capacity:
            return window
        windows += 1


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, piece: int = PIECE, block_windows: int = BLOCK_WINDOWS, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for each piece of each document."""
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        next_id = TaskContext.get().partitionId() << 40
        held, size = [], 0

        def settle(rest: pd.DataFrame, done: bool) -> Iterator[pd.DataFrame]:
            nonlocal next_id, held, size
            ends = rest["length"].to_numpy().cumsum()
            a = 0
            while a < len(rest) and (done or ends[-1] - (ends[a - 1] if a else 0) >= block_windows * capacity):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + block_windows * capacity, "right")))
                block = rest.iloc[a:b]
                window = near_equal(block["length"].to_numpy(), capacity)
                block = block.assign(sequence_id=window).sort_values(["sequence_id", *key], kind="stable")
                block["offset"] = block.groupby("sequence_id")["length"].cumsum() - block["length"]
                _, dense = np.unique(block["sequence_id"].to_numpy(), return_inverse=True)
                block["sequence_id"] = dense + next_id
                next_id += int(dense[-1]) + 1
                yield block
                a = b
            held = [rest.iloc[a:]]
            size = int(held[0]["length"].sum())

        for frame in frames:
            whole = frame[frame["length"] == capacity]
            if len(whole):
                yield whole.assign(sequence_id=np.arange(len(whole)) + next_id, offset=np.int64(0))
                next_id += len(whole)
            held.append(frame[frame["length"] != capacity])
            size += int(held[-1]["length"].sum())
            if size >= block_windows * capacity:
                yield from settle(pd.concat(held), False)
        if held:
            yield from settle(pd.concat(held), True)

    dealt = pieces(docs, tokenizer, capacity, piece, end_id).repartition("doc_id", "start").sortWithinPartitions(*key)
    return dealt.mapInPandas(run, f"{PIECES}, sequence_id long, offset long")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 ids."""
    return pack(documents(spark, sf_dir))
