"""Token counts of a unigram tokenizer by count-only Viterbi.

An Aho-Corasick automaton over the vocabulary yields all pieces that end at a place, longest first; for each place only the best
score so far and the number of pieces on its path are carried, never the pieces themselves. Ties go to the longer piece, and an
unknown character, which scores ten less than the worst piece and counts one for each of its bytes, only wins if strictly better:
the rules of the tokenizers library's Unigram model with byte fallback and a Metaspace pre-tokenizer, which gives the same counts.

A text falls apart before each space, so counts are remembered by word; a line break, which no piece contains, is one token.

Defined results: a null or empty text has no tokens; documents that share an id each have a row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, text_column

SPACE = "▁"
#: How much worse than the worst piece an unknown character scores.
UNKNOWN_PENALTY = 10.0
#: Words whose counts a worker remembers.
MEMO = 500_000


def vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) in the order of ids of a sentencepiece model file."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Counter:
    """Counts the pieces of texts under one vocabulary of (piece, score)."""

    def __init__(self, pieces: list[tuple[str, float]]) -> None:
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {piece for piece, _ in pieces if len(piece) == 1}
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.breaks = not any("\n" in piece or "\0" in piece for piece, _ in pieces)
        self.memo: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Pieces of the best path over one word."""
        if not self.single.issuperset(word):
            return self.word_with_unknown(word)
        n = len(word)
        best = [0.0] + [float("-inf")] * n
        count = [0] * (n + 1)
        for end, (length, score) in self.automaton.iter(word):
            start = end + 1 - length
            score += best[start]
            if score > best[end + 1]:
                best[end + 1] = score
                count[end + 1] = count[start] + 1
        return count[n]

    def word_with_unknown(self, word: str) -> int:
        n = len(word)
        found: list[list] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(word):
            found[end].append(match)
        best = [0.0] * (n + 1)
        count = [0] * (n + 1)
        for end in range(n):
            top, pieces = float("-inf"), 0
            for length, score in found[end]:
                score += best[end + 1 - length]
                if score > top:
                    top, pieces = score, count[end + 1 - length] + 1
            if word[end] not in self.single and best[end] + self.unknown > top:
                top, pieces = best[end] + self.unknown, count[end] + len(word[end].encode("utf-8", "surrogatepass"))
            best[end + 1], count[end + 1] = top, pieces
        return count[n]

    def text(self, text: str, size: int = 1 << 20) -> int:
        """Pieces of a text, taken in parts that start at a space."""
        total, start = 0, 0
        while start < len(text):
            end = text.find(" ", start + size) if len(text) > start + size else -1
            part = text[start : end if end >= 0 else len(text)]
            total += self.part(part if part[0] in (" ", SPACE) else SPACE + part)
            start += len(part)
        return total

    def part(self, part: str) -> int:
        marked = part.replace(SPACE, " ").replace(" ", "\0" + SPACE)
        total = 0
        if self.breaks and part.count("\0") == 0:
            total = marked.count("\n")
            words = marked.replace("\n", "\0").split("\0")
        else:
            words = [SPACE + x for x in part.replace(SPACE, " ").split(" ")[1:]]
        memo = self.memo
        if missing := set(words).difference(memo):
            if len(memo) + len(missing) > MEMO:
                memo.clear()
                missing = set(words)
            memo.update((x, self.word(x)) for x in missing)
        return total + sum(map(memo.__getitem__, words))


_loaded: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _loaded:
        _loaded[path] = Counter(vocabulary(path))
    return _loaded[path]


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path or default_vocabulary()).text
        for batch in batches:
            n = pa.array([count(x.as_py()) for x in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n], names=["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text")).mapInArrow(run, "doc_id long, n_tokens long")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document."""
    return token_counts(documents(spark, sf_dir))
