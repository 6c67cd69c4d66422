"""Removal of long repeated strings by a run-length index.

Which strings can repeat is found first. Every window of `least` bytes picks an anchor, its least hashed gram (the leftmost of
equals), so equal windows pick equal anchors, wherever they are. The windows of one anchor in a row form a segment; it holds
`length` bytes from its last window's start, so that the longer strings that start in it lie in it too. Anchors that occur once
are dropped. Of the others' segments, told apart by a digest within the anchor,

- two copies of each that occurs twice or more go to the index: the first row that has any and another one, in whole stretches of
  neighbouring segments. What the index confirms holds for all copies;
- where an anchor has single segments as well, one copy of each of its segments goes to the index, but for those none of whose
  classes of windows (by where the anchor lies in them) share a core with another.

Blocks of such strings, those of a row that overlap made one, are concatenated and indexed: the suffix order gives the
Burrows-Wheeler transform, of which only the runs are kept, with the text positions at the runs' ends as samples. Matches with
the neighbours in suffix order are measured at the samples alone; everywhere else the length of the match is one less than at
the position before. Suffixes are sorted no further than `length` bytes, and those without a match of `least` left out. Streaming these matching statistics over the text marks the starts of repeated strings, of `length` bytes
(these are removed) and of `least` bytes. A passage is a stretch that repeated strings of `least` bytes cover and that holds
`passage_words` words or more; passages are reported and, where they are shorter than `length` bytes, not removed.

An anchor with more distinct segments than HOT_SEGMENTS isn't gathered into one task: the windows of its segments are hashed
and counted instead, with partial counts before the shuffle.

Texts are told apart by their SHA-256. Strings are judged on the input; marks are united per text.

Defined results: a null or empty text has no bytes, nothing removed, and the digest of nothing; rows that share an id are
separate documents; equal texts of at least `length` bytes are removed in full; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import apart, cut, documents, text_column

LENGTH = 400
#: Bytes and words of a passage that is reported.
LEAST = 256
PASSAGE_WORDS = 50
GRAM = 64
#: Window starts handled at once in pass one, bytes of an indexed block, suffix pairs compared at once, and the bound on a gathered group.
PART = 1 << 21
BLOCK = 1 << 20
PAIRS = 1 << 16
HOT_SEGMENTS = 4096

POSITION_BITS = np.uint64(23)
MULTIPLIERS = [np.uint64((0x9E3779B97F4A7C15 * (2 * j + 1) ** 5 | 1) & (1 << 64) - 1) for j in range(GRAM // 8)]


def gram_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes at each place."""
    n = len(raw) - GRAM + 1
    words = np.empty(n + GRAM - 8, np.uint64)
    for j in range(8):
        part = words[j::8]
        part[:] = np.frombuffer(raw, "<u8", len(part), j)
    h = sum(words[8 * j : 8 * j + n] * m for j, m in enumerate(MULTIPLIERS))
    h ^= h >> np.uint64(32)
    h *= MULTIPLIERS[0]
    h ^= h >> np.uint64(29)
    return h


def window_anchors(h: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` hashes the place of its least, the leftmost of equals."""
    n = len(h) - width + 1
    key = (h >> POSITION_BITS << POSITION_BITS) | np.arange(len(h), dtype=np.uint64)
    rows = np.full(-(-len(h) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    rows[: len(h)] = key
    rows = rows.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])
    return (least & ((np.uint64(1) << POSITION_BITS) - np.uint64(1))).astype(np.int64)


def segments(raw: bytes, length: int = LENGTH, least: int = LEAST) -> Iterator[tuple[np.ndarray, list[int], np.ndarray]]:
    """(anchors, digests, places) of a text's segments, in parts. A place packs the first window's start, how many windows
    follow it, and how far behind the start the anchor lies."""
    for base in range(0, len(raw) - least + 1, PART):
        part = raw[base : base + PART + least - 1]
        h = gram_hashes(part)
        place = window_anchors(h, least - GRAM + 1)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.concatenate([first[1:], [len(place)]]) - 1
        span = last - first
        digests = [signed(xxhash.xxh3_64_intdigest(raw[a + base : b + base + length], b - a)) for a, b in zip(first.tolist(), last.tolist())]
        yield h[place[first]].view(np.int64), digests, (first + base << 24) | (span << 12) | (place[first] - first)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def ordered(key: np.ndarray, at: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of so many bits, sorted, and the places that have them, ascending before and where keys are equal."""
    low = int(at[-1]).bit_length() if len(at) else 0
    if bits + low > 63:
        order = np.argsort(key, kind="stable")
        return key[order], at[order]
    both = np.sort(key << low | at)  # much faster than argsort
    return both >> low, both & (1 << low) - 1


def first_places(first: np.ndarray) -> np.ndarray:
    """For each place the last one up to it where `first` is true."""
    return np.maximum.accumulate(np.arange(len(first), dtype=np.int32) * first)


class RunIndex:
    """Run-length Burrows-Wheeler transform of some strings, with samples at the runs' ends.

    owned: ranges of starts in each string; only these are compared with each other (None: all). Their matches are exact from
    `least` to `depth` (None: any length); shorter ones may be given too short, longer ones too short but not below `depth`."""

    def __init__(self, strings: list[bytes], owned: list[list[tuple[int, int]]] | None = None, least: int = 1, depth: int | None = None) -> None:
        sizes = np.array([len(x) + 1 for x in strings])
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.size = int(self.ends[-1])
        self.levels: list[tuple[int, int]] = []
        raw = np.frombuffer(b"\0".join([*strings, b""]), np.uint8)
        wanted = np.full(self.size, owned is None)
        for start, ranges in zip(self.starts.tolist(), owned or []):
            for lo, hi in ranges:
                wanted[start + lo : start + hi] = True
        suffixes, tied, reached = self.sort(raw, wanted, least, depth or int(sizes.max()))
        # a run goes on where both suffixes have the same symbol before them and the suffixes from there are looked at, too
        inside = np.append(False, wanted[:-1])
        inside[self.starts] = False
        upper, lower = suffixes[:-1], suffixes[1:]
        new_run = np.flatnonzero((raw[upper - 1] != raw[lower - 1]) | ~inside[upper] | ~inside[lower])
        self.runs = len(new_run) + 1
        # at a run's first suffix the match with the suffix above, at its last the match with the one below
        new_run = new_run[~(tied[new_run] & tied[new_run + 1])]
        upper, lower = suffixes[new_run], suffixes[new_run + 1]
        shared = self.common(raw, upper, lower)
        self.samples = np.zeros(self.size, np.int64)
        self.samples[lower] = shared
        self.samples[upper] = np.maximum(self.samples[upper], shared)
        self.samples[suffixes[tied]] = reached

    def sort(self, raw: np.ndarray, wanted: np.ndarray, least: int, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The wanted suffixes that may have a match of `least` in order, which of them are tied, and the symbols that these share.

        By prefix doubling from four symbols on, until nothing is tied or `depth` is reached. A suffix's rank is its place among all,
        the tied ones' that of the first. Each string's end is a symbol of its own, the earlier the less: a suffix differs from all
        others once its end is reached.

        Only what is needed is sorted again. A suffix that nothing is tied with has no longer match, nor has one that reaches it by
        whole steps a match of `least`. The others need the ranks at whole steps from them, up to the last length."""
        n, steps = self.size, [4]
        while steps[-1] < depth:
            steps.append(2 * steps[-1])
        one = np.zeros(n + 3, np.int64)  # 0 ends a string; bytes count from 1
        one[:n] = raw
        one[:n] += 1
        one[self.ends - 1] = 0
        two = one[:-1] << 9 | one[1:]
        key = two[:n] << 18 | two[2:]
        alone = np.zeros(n, bool)
        for j in range(4):
            last = self.ends - 1 - j
            last = last[last >= self.starts]
            key[last] = key[last] >> 9 * (4 - j) << 9 * (4 - j)
            alone[last] = True
        key, at = ordered(key, np.arange(n), 36)
        first = np.append(True, key[1:] != key[:-1]) | alone[at]
        rank = np.empty(n, np.int32)
        rank[at] = first_places(first)
        alone[at[first & np.append(first[1:], True)]] = True

        bits = n.bit_length()
        wanted = wanted.copy()
        for i, step in enumerate(steps):
            if step <= least:
                reaching, reach = alone.copy(), step
                while 2 * reach <= least:
                    reaching[:-reach] |= reaching[reach:]
                    reach *= 2
                wanted &= ~reaching
            needed = wanted.copy()
            for wider in reversed(steps[i + 1 : -1]):
                needed[wider:] |= needed[:-wider]
            at = np.flatnonzero(needed & ~alone)
            if step == steps[-1] or not len(at):
                break
            self.levels.append((step, len(at)))
            key, at = ordered(rank[at].astype(np.int64) << bits | rank[at + step], at, 2 * bits)
            own = key >> bits
            first, group = np.append(True, key[1:] != key[:-1]), np.append(True, own[1:] != own[:-1])
            rank[at] = own + first_places(first) - first_places(group)
            alone[at[first & np.append(first[1:], True)]] = True
        chosen = np.flatnonzero(wanted)
        order = ordered(rank[chosen].astype(np.int64), chosen, bits)[1]
        return order, ~alone[order], step

    def common(self, raw: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Lengths of the common prefixes of the suffixes at i and at j."""
        left = np.minimum(*(self.ends[np.searchsorted(self.ends, x, "right")] - 1 - x for x in (i, j)))
        length = np.zeros(len(i), np.int64)
        width = 64
        windows = np.lib.stride_tricks.sliding_window_view(np.append(raw, np.zeros(width, np.uint8)), width)
        for base in range(0, len(i), PAIRS):
            rest = base + np.flatnonzero(left[base : base + PAIRS] > 0)
            while len(rest):
                at = length[rest]
                differs = windows[i[rest] + at] != windows[j[rest] + at]
                end = differs.any(axis=1)
                length[rest] += np.where(end, differs.argmax(axis=1), width)
                rest = rest[~end & (length[rest] < left[rest])]
        return np.minimum(length, left)

    def matching_statistics(self) -> np.ndarray:
        """For each position the length of its longest match with another position: the samples' lengths carried on, one less at
        each position. None runs over a string's end."""
        place = np.arange(self.size)
        return np.maximum.accumulate(self.samples + place) - place


def runs_of(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of true values."""
    edges = np.diff(np.concatenate([[0], marked.view(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


FOUND = "t binary, doc_id long, a array<long>, d array<long>, place array<long>"
KIND = pa.struct([("a", pa.int64()), ("d", pa.int64()), ("lo", pa.int32()), ("span", pa.int32())])
PIECE = "twin boolean, key long, row long, t binary, lo int, raw binary, span int, ahead int, kinds array<struct<a: long, d: long, lo: int, span: int>>"
#: level is the length of the repeated strings; 0 stands for a kind of segment (a, d) that the index confirms.
MARKED = "level int, t binary, lo int, hi int, a long, d long"


def with_key(docs: DataFrame) -> DataFrame:
    """t (half of the text's SHA-256, never null), doc_id and text."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"))
    key = F.substring(F.unhex(F.sha2(F.col("text").cast("binary"), 256)), 1, 16)
    return texts.select(F.coalesce(key, F.lit(b"")).alias("t"), "doc_id", "text")


def find_segments(texts: DataFrame, length: int, least: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, parts = [0], [[], [], []]
            for x in batch.column(2).cast(pa.large_binary()):
                n = 0
                for new in segments(x.as_py(), length, least):
                    n += len(new[0])
                    for held, values in zip(parts, new):
                        held.append(np.asarray(values, np.int64))
                counts.append(counts[-1] + n)
            ends = pa.array(counts, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(p) if p else np.empty(0, np.int64))) for p in parts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=["t", "doc_id", "a", "d", "place"])

    return texts.mapInArrow(run, FOUND)


def unpacked(place: int) -> tuple[int, int, int]:
    """First window's start, number of further windows, and where the anchor lies."""
    return place >> 24, place >> 12 & 4095, place & 4095


def pieces(asked: DataFrame, length: int) -> DataFrame:
    """The strings that the index compares. asked: row, t, text, asks: array<struct<key, twin, a, d, place>>.

    For each key of twins the stretches of the row that its segments cover, with these segments if the key is the row itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row, t, text, asks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.large_binary()), batch.column(3).to_pylist()):
                raw = text.as_py()
                stretch: dict[int, tuple] = {}
                for x in sorted(asks, key=lambda x: (x["key"], x["place"])):
                    lo, span, ahead = unpacked(x["place"])
                    hi = min(len(raw), lo + span + length)
                    if not x["twin"]:
                        out.append((False, x["key"], row, t, lo, raw[lo:hi], span, ahead, []))
                        continue
                    held = stretch.get(x["key"])
                    if held is None or lo > held[1]:
                        if held:
                            out.append((True, x["key"], row, t, held[0], raw[held[0] : held[1]], 0, 0, held[2]))
                        held = (lo, hi, [])
                    if x["key"] == row:
                        held[2].append({"a": x["a"], "d": x["d"], "lo": lo, "span": span})
                    stretch[x["key"]] = (held[0], max(hi, held[1]), held[2])
                out += [(True, key, row, t, lo, raw[lo:hi], 0, 0, kinds) for key, (lo, hi, kinds) in stretch.items()]
            columns = list(zip(*out)) or [()] * 9
            types = [pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.list_(KIND)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types)], names=[c.split()[0] for c in PIECE.split(", ")[:9]])

    return asked.select("row", "t", "text", "asks").mapInArrow(run, PIECE)


CLASSES = 4


def sharing(group: list[dict], least: int) -> list[dict]:
    """The members of an anchor's group that share the core of a class of windows."""
    width = least - GRAM + 1
    step = -(-width // CLASSES)
    cores: dict[tuple[int, int], set[int]] = {}
    for i, x in enumerate(group):
        for c in range(CLASSES):
            first = x["ahead"] - width + 1 + step * c
            last = min(first + step - 1, x["ahead"])
            if last >= 0 and first <= x["span"]:
                cores.setdefault((c, xxhash.xxh3_64_intdigest(x["raw"][last : first + least])), set()).add(i)
    kept = {i for found in cores.values() if len(found) > 1 for i in found}
    return [group[i] for i in sorted(kept)]


def marks_of(held: list[dict], length: int, least: int) -> pa.RecordBatch:
    """What the index over these strings marks, and the kinds that it confirms. Strings of a row that overlap are made one.

    Of a single segment only its windows' starts are looked at; what starts behind them is in the segment of another anchor."""
    strings: list[list] = []  # row, t, lo, raw, kinds, owned
    for x in sorted(held, key=lambda x: (x["row"], x["lo"])):
        at = x["lo"] - strings[-1][2] if strings and strings[-1][0] == x["row"] else None
        if at is not None and at <= len(strings[-1][3]):
            strings[-1][3] += x["raw"][len(strings[-1][3]) - at :]
            strings[-1][4] += x["kinds"]
        else:
            at = 0
            strings.append([x["row"], x["t"], x["lo"], bytearray(x["raw"]), list(x["kinds"]), []])
        strings[-1][5].append((at, at + (len(x["raw"]) if x["twin"] else x["span"] + 1)))
    index = RunIndex([bytes(x[3]) for x in strings], [x[5] for x in strings], least, length)
    found = index.matching_statistics()
    out: list[tuple] = []
    missed = []
    for level in (length, least):
        marked = found >= level
        missed.append(np.concatenate([[0], np.cumsum(~marked)]))
        first, end = runs_of(marked)
        for s, a, b in zip(np.searchsorted(index.ends, first, "right").tolist(), first.tolist(), end.tolist()):
            base = strings[s][2] - int(index.starts[s])
            out.append((level, strings[s][1], base + a, base + b - 1 + level, None, None))
    for s, (_, _, lo, _, kinds, _) in enumerate(strings):
        base = int(index.starts[s]) - lo
        for k in kinds:
            a, b = k["lo"] + base, k["lo"] + k["span"] + 1 + base
            long = max(a, min(b, int(index.ends[s]) - length))  # starts from which that many bytes are left in the text's stretch
            if missed[1][b] == missed[1][a] and missed[0][long] == missed[0][a]:
                out.append((0, None, None, None, k["a"], k["d"]))
    columns = list(zip(*out)) or [()] * 6
    types = [pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types)], names=[c.split()[0] for c in MARKED.split(", ")])


def compare(strings: DataFrame, length: int, least: int) -> DataFrame:
    """The index's marks, in blocks of whole groups (twin, key) of pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        group: list[dict] = []
        size = 0

        def close() -> int:
            new = group if not group or group[0]["twin"] else sharing(group, least)
            held.extend(new)
            return sum(len(x["raw"]) + 1 for x in new)

        last = None
        for batch in batches:
            names, kinds = batch.schema.names[:8], batch.column(8)
            for i, row in enumerate(zip(*(c.to_pylist() for c in batch.columns[:8]))):
                if row[:2] != last:
                    size += close()
                    group = []
                    if size >= BLOCK:
                        yield marks_of(held, length, least)
                        held, size = [], 0
                last = row[:2]
                if not group or row[2] != group[-1]["row"] or row[4] != group[-1]["lo"]:  # rows that share id and text come twice
                    group.append(dict(zip(names, row)) | {"kinds": kinds[i].as_py() if row[0] else ()})
        close()
        if held:
            yield marks_of(held, length, least)

    dealt = strings.repartition("twin", "key").sortWithinPartitions("twin", "key", "row", "lo")
    return dealt.mapInArrow(run, MARKED)


def count_windows(groups: DataFrame, length: int, least: int) -> DataFrame:
    """level, t, lo, hi of what repeats in hot groups, by counting the hashes of all windows of both lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                raw = x["raw"]
                for level in (length, least):
                    n = min(x["span"] + 1, len(raw) - level + 1)
                    if n > 0:
                        w = [xxhash.xxh3_128_digest(raw[i : i + level]) for i in range(n)]
                        yield pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), pa.array([level] * n, pa.int32()), pa.array([x["t"]] * n, pa.binary()), pa.array(range(x["lo"], x["lo"] + n), pa.int32())], names=["w", "level", "t", "lo"])

    windows = groups.dropDuplicates(["row", "lo"]).mapInArrow(run, "w binary, level int, t binary, lo int")
    twice = windows.groupBy("w").agg(F.count("*").alias("n")).where("n > 1").select("w")
    return apart(windows, "w").join(apart(twice, "w"), ["w", "apart"], "left_semi").select("level", "t", "lo", (F.col("lo") + F.col("level")).cast("int").alias("hi"))


def cut_out(docs: DataFrame, length: int = LENGTH, hot_segments: int = HOT_SEGMENTS, least: int = LEAST) -> DataFrame:
    """doc_id, text and spans: what repeated strings of both lengths cover, null if nothing. A span packs its start, its end and
    whether it is of the longer strings, in 31, 31 and 1 bits; one at a text's end may reach beyond it."""
    texts = apart(with_key(docs), "t")
    # rows get a number once, in the checkpoint; what is shuffled most carries it instead of the text's digest
    found = cut(find_segments(texts.drop("apart"), length, least).where(F.size("a") > 0).withColumn("row", F.monotonically_increasing_id()))
    owner = found.select("row", "t", F.col("doc_id").alias("own_id"))
    every = found.select("row", F.explode(F.arrays_zip("a", "d", "place")).alias("s")).select("row", "s.*")
    often = found.select(F.explode("a").alias("a")).groupBy("a").agg(F.count("*").alias("times")).where("times > 1").select("a")
    every = cut(apart(every, "a").join(apart(often, "a"), ["a", "apart"]).drop("apart"))
    at = F.struct("row", "place")
    counts = cut(every.groupBy("a", "d").agg(F.count("*").alias("times"), F.min(at).alias("one"), F.max(at).alias("other")))
    mixed = counts.groupBy("a").agg(F.count("*").alias("kinds"), F.count_if(F.col("times") == 1).alias("single")).where("kinds > 1 and single > 0")
    mixed = mixed.select("a", (F.col("kinds") > hot_segments).alias("hot"))

    ask = lambda key, twin: F.struct(F.col(key).alias("key"), F.lit(twin).alias("twin"), "a", "d", "place").alias("ask")
    twice = counts.where("times > 1").withColumn("first", F.col("one.row"))
    twins = twice.select("a", "d", "first", F.explode(F.array("one", "other")).alias("at")).select("a", "d", "first", "at.*").select("row", ask("first", True), F.lit(False).alias("hot"))
    singles = apart(counts, "a").join(apart(mixed, "a"), ["a", "apart"]).select("a", "d", "hot", "one.*").select("row", ask("a", False), "hot")

    def strings(asks: DataFrame) -> DataFrame:
        lists = asks.groupBy("row").agg(F.collect_list("ask").alias("asks")).join(owner, "row")
        asked = apart(lists, "t").join(texts, ["t", "apart"]).where(F.col("doc_id").eqNullSafe(F.col("own_id")))
        return pieces(asked, length)

    every_ask = cut(twins.unionByName(singles))
    marked = cut(compare(strings(every_ask.where("not hot")), length, least))
    marks = marked.where("level > 0").select("level", "t", "lo", "hi")
    marks = marks.unionByName(count_windows(strings(every_ask.where("hot")), length, least))
    # what holds for two copies holds for the others
    lo, span = F.shiftright("place", 24).cast("int"), F.shiftright("place", 12).bitwiseAND(4095).cast("int")
    many = counts.where("times > 2").select("a", "d").join(marked.where("level = 0").select("a", "d").distinct(), ["a", "d"])
    copies = apart(every, "a", "d").join(apart(many, "a", "d"), ["a", "d", "apart"]).groupBy("row").agg(F.collect_list("place").alias("places")).join(owner, "row")
    copies = copies.select("t", F.explode("places").alias("place")).select("t", lo.alias("lo"), span.alias("span"))
    levels = [F.struct(F.lit(x).alias("level"), "t", "lo", (F.col("lo") + F.col("span") + x).cast("int").alias("hi")) for x in (length, least)]
    marks = marks.unionByName(copies.select(F.explode(F.array(*levels)).alias("m")).select("m.*"))

    packed = F.shiftleft(F.col("lo").cast("long"), 32).bitwiseOR(F.shiftleft(F.col("hi").cast("long"), 1)).bitwiseOR((F.col("level") == length).cast("long"))
    lists = marks.groupBy("t").agg(F.collect_set(packed).alias("spans"))
    return texts.join(apart(lists, "t"), ["t", "apart"], "left").select("doc_id", "text", "spans")


def united(spans: np.ndarray, size: int, length: int, least: int) -> Iterator[list[tuple[int, int]]]:
    """The unions of the longer strings' spans and of the shorter ones'. A span counts if a string of its length starts at it."""
    lo, hi, longer = spans >> 32, np.minimum(spans >> 1 & 0x7FFFFFFF, size), (spans & 1).astype(bool)
    for n, chosen in ((length, longer), (least, ~longer if least != length else longer)):
        own = chosen & (lo + n <= size)
        order = np.argsort(lo[own])
        a, b = lo[own][order], np.maximum.accumulate(hi[own][order])
        first = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]])) if len(a) else np.empty(0, np.int64)
        yield list(zip(a[first].tolist(), b[np.concatenate([first[1:] - 1, [len(a) - 1]])].tolist() if len(a) else []))


def whole_words(raw: bytes, lo: int, hi: int) -> int:
    """Words of the text that lie in [lo, hi)."""
    n = len(raw[lo:hi].split())
    cut_off = lambda i: 0 < i < len(raw) and not raw[i - 1 : i].isspace() and not raw[i : i + 1].isspace()
    return max(0, n - cut_off(lo) - cut_off(hi))


REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, n_passage_words long"
NAMES = [c.split()[0] for c in REMOVED.split(", ")]


def removed(docs: DataFrame, length: int = LENGTH, hot_segments: int = HOT_SEGMENTS, least: int = LEAST, passage_words: int = PASSAGE_WORDS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row, and its repeated passages and the words in them."""
    marked = cut_out(docs, length, hot_segments, least)
    whole = F.sha2(F.col("text").cast("binary"), 256)
    rows = marked.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.when(F.col("spans").isNull(), whole).alias("digest"), F.when(F.col("spans").isNotNull(), F.col("text").cast("binary")).alias("raw"), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, n, digest, x, spans in zip(*(c for c in batch.columns[:5])):
                if not spans.is_valid:
                    out.append((doc.as_py(), n.as_py(), 0, 0, digest.as_py(), 0, 0))
                    continue
                raw, at, kept = x.as_py(), 0, hashlib.sha256()
                runs, stretches = united(spans.values.to_numpy(zero_copy_only=False), len(raw), length, least)
                for lo, hi in runs:
                    kept.update(raw[at:lo])
                    at = hi
                kept.update(raw[at:])
                words = [whole_words(raw, lo, hi) for lo, hi in stretches]
                words = [n for n in words if n >= passage_words]
                out.append((doc.as_py(), len(raw), sum(b - a for a, b in runs), len(runs), kept.hexdigest(), len(words), sum(words)))
            columns = list(zip(*out)) or [()] * len(NAMES)
            types = [pa.int64()] * 4 + [pa.string()] + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types)], names=NAMES)

    return rows.mapInArrow(run, REMOVED)


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document loses to repeated 400-byte strings, and the repeated passages in it."""
    return removed(documents(spark, sf_dir))
