"""SimHash near-duplicates with pigeonring candidate filtering.

A fingerprint of 64 bits is cut into a ring of segments, one more than the distance. If two fingerprints differ in at most that
many bits, some segment starts a chain in which the first l segments differ in at most l * distance / segments bits, for each l
(pigeonring). So the first segment of the chain is equal and the second differs in one bit at most: both are part of the join
key, with the one-bit variants on one side. The rest of the chain is tested before the full Hamming distance.

Fingerprints are compared once each, however many documents share one. Links become components by star contraction.

A distance that stands for a similarity of 0.8 is too wide to leave 64 bits selective, and no whole segment of a SimHash ring is
sure to be equal. `deduplicate` applies the same principle to the sets of five-word shingles themselves, as bits over all hash
values: the values are cut into a ring of about as many segments as two sets that are alike can differ in shingles, and those
whose content is equal in both are the join keys. Candidates are pruned by pigeonring chains and the full Hamming distance of
4096-bit SimHash rings, and what is left is decided by the Jaccard similarity of the sets.

Defined results: a text without words has fingerprint zero and links like any other; documents that share an id have the same
component; a null id has its own fingerprint but no say in the component's id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import apart, cut, documents, merged, text_column, word_chunks
from tessera.llm.components import components

BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
OFFSETS = np.arange(0, 2048, 256)


def shingle_hashes(raw: bytes, words: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of each run of so many words, space-joined; a shorter text has one shingle, an empty one none."""
    held: list[bytes] = []
    hashed = False
    for part in word_chunks(raw.lower()):
        held += part
        if len(held) >= words:
            runs = map(b" ".join, zip(*(held[i:] for i in range(words))))
            yield np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(seed)), np.uint64, len(held) - words + 1)
            hashed = True
            held = held[len(held) - words + 1 :]
    if held and not hashed:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(held), seed)], np.uint64)


def fingerprint(raw: bytes, words: int = 3, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes; as a signed 64-bit number."""
    n, ones = 0, np.zeros((8, 8), np.int64)
    for h in shingle_hashes(raw, words, seed):
        n += len(h)
        found = np.bincount((h.astype("<u8").view(np.uint8).reshape(-1, 8) + OFFSETS).ravel(), minlength=2048)
        ones += found.reshape(8, 256) @ BITS
    return int.from_bytes(np.packbits((2 * ones > n).ravel() & bool(n), bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp (long) of each document's whole text, ASCII capitals lower-cased."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()) if batch.schema.types[1] == pa.string() else batch.column(1).cast(pa.large_binary())
            fps = pa.array([fingerprint(x.as_py(), words, seed) for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), fps], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text")).mapInArrow(run, "doc_id long, fp long")


def segment(fp: Column, i: int, count: int) -> Column:
    """Segment i of the ring; widths differ by one bit at most."""
    a, b = 64 * (i % count) // count, 64 * (i % count + 1) // count
    return F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1))


def links(fps: DataFrame, distance: int = 3) -> DataFrame:
    """Pairs a < b of distinct fingerprints (column fp) that differ in at most `distance` bits."""
    m = distance + 1
    width = max(64 * (i + 1) // m - 64 * i // m for i in range(m))
    fp = F.col("fp")
    parts = [F.struct(F.lit(i).alias("i"), segment(fp, i, m).alias("s"), segment(fp, i + 1, m).alias("t")) for i in range(m)]
    ring = fps.select("fp", F.explode(F.array(*parts)).alias("k")).select("fp", "k.*")
    near = F.array(F.lit(0).cast("long"), *(F.lit(1 << j).cast("long") for j in range(width)))
    probe = ring.select(F.col("fp").alias("b"), "i", "s", "t", F.explode(near).alias("d")).select("b", "i", "s", F.col("t").bitwiseXOR(F.col("d")).alias("t"))
    both = merged(ring.withColumnRenamed("fp", "a"), probe, ["i", "s", "t"]).where("a < b")
    diff = F.col("a").bitwiseXOR(F.col("b"))
    chain = F.lit(True)
    for length in range(3, m):
        for i in range(m):
            total = sum((F.bit_count(segment(diff, i + k, m)) for k in range(1, length)), F.bit_count(segment(diff, i, m)))
            chain &= (F.col("i") != i) | (total <= length * distance // m)
    return both.where(chain).where(F.bit_count(diff) <= distance).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, words: int = 3, seed: int = 42, distance: int = 3) -> DataFrame:
    """doc_id, fp and component_id (the least doc_id reachable over links) of each document."""
    own = cut(fingerprints(docs, words, seed))
    distinct = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct.select("fp"), distance)).select(F.col("node").alias("fp"), "root")
    members = merged(distinct, roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = members.groupBy("root").agg(F.min("least").alias("component_id"))
    return merged(own, merged(members, lowest, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


SIMILARITY = 0.8
#: Bits of the ring of shingles, in segments of 64, and the longest chain that is tested.
RING_BITS = 4096
CHAIN = 4
#: Standard deviations of the distance by which its limit exceeds the mean at the least similarity; the limit only rules out.
MARGIN = 5
#: Segments of a set that become keys, how many of the differing shingles a segment stands for, and the ratio of a size class.
SEGMENTS = 32
STRETCH = 0.6
CLASS_RATIO = 1.5
#: Sets of fewer shingles aren't ruled out by their rings: a bit of a few hashes is no fair sample of the angle.
SMALL = 16
#: Members of a key's group that one task compares with as many others.
BLOCK = 1024
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)]


def shingle_set(raw: bytes, words: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order."""
    return np.unique(np.concatenate([np.empty(0, np.uint64), *shingle_hashes(raw, words, 42)]))


def spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * ODD[1]
    h = (h ^ h >> np.uint64(29)) * ODD[0]
    return h ^ h >> np.uint64(32)


@cache
def ring_cuts(size_class: int, similarity: float, ratio: float) -> tuple[int, np.ndarray]:
    """How many segments the ring of hash values has for sets of a size class, and where those that become keys begin and end.

    Two sets of the class that are alike differ in at most `most` shingles, so of most + 1 segments one is equal in both; where
    that takes more segments than become keys, a pair at the very limit of similarity is missed with odds under one in 800."""
    largest = int(np.ceil(ratio ** (size_class + 1))) - 1
    most = int(2 * largest * (1 - similarity) / (1 + similarity) + 1e-9)
    count = max(int(STRETCH * (most + 1)), min(2 * (most + 1), SEGMENTS), 1)
    used = min(count, SEGMENTS)
    return count, np.array([min((i << 64) // count, (1 << 64) - 1) for i in range(used + 1)], np.uint64)


def segment_keys(hashes: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """One key for each segment of the set that has a shingle: its class, place and content. hashes: distinct, in order.

    A set near the next size class has the keys of that class too, so that sets that are alike share a class."""
    if not len(hashes):
        return np.empty(0, np.int64)
    ratio = max(CLASS_RATIO, 1 / similarity)
    own = int(np.log(len(hashes)) / np.log(ratio) + 1e-9)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(spread(hashes), dtype=np.uint64)])
    found = []
    for c in (own, own + 1):
        if c == own or len(hashes) >= similarity * ratio**c:
            count, cuts = ring_cuts(c, similarity, ratio)
            ends = np.searchsorted(hashes, cuts)
            if len(cuts) > count:
                ends[-1] = len(hashes)
            place = np.flatnonzero(ends[1:] > ends[:-1])
            content = sums[ends[1:][place]] - sums[ends[:-1][place]]
            found.append(spread(content ^ spread(np.uint64(c << 32) + place.astype(np.uint64) + np.uint64(1))))
    return np.concatenate(found).view(np.int64)


def wide_fingerprint(hashes: np.ndarray, width: int = RING_BITS) -> bytes:
    """A ring of so many bits: each is 1 if it is set in over half of the distinct hashes, each spread over all bits."""
    seeds = np.arange(1, width // 32, 2, dtype=np.uint64) * ODD[0]
    ones = np.zeros(width, np.int64)
    for i in range(0, len(hashes), 4080):
        h = hashes[i : i + 4080, None] * seeds
        h ^= h >> np.uint64(32)
        h *= ODD[1]
        h ^= h >> np.uint64(29)
        bits = np.unpackbits(h.astype("<u8").view(np.uint8), axis=1)
        for j in range(0, len(bits), 255):  # sums of 255 rows fit in a byte
            ones += np.add.reduce(bits[j : j + 255], axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes)).tobytes()


def greatest_distance(similarity: float) -> int:
    """Differing bits beyond which two rings can't stand for sets of at least this Jaccard similarity, but for odds under one in a million."""
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(RING_BITS * share + MARGIN * np.sqrt(RING_BITS * share * (1 - share)))


def ring_distances(left: np.ndarray, right: np.ndarray, most: int) -> np.ndarray:
    """Hamming distances of rings (rows of segments); above `most` + 1 where no chain stays in its budget or the whole exceeds it.

    If the whole differs in at most `most` bits, some segment starts a chain whose first l segments differ in at most
    l * most / segments bits, for each l. Rings without such a chain are pruned before the whole distance is summed."""
    boxes = np.bitwise_count(left ^ right).astype(np.int16)
    count = boxes.shape[1]
    chain, viable = boxes.copy(), boxes * count <= most
    for length in range(2, CHAIN + 1):
        chain += np.roll(boxes, 1 - length, axis=1)
        viable &= chain * count <= length * most
    out = np.full(len(boxes), most + 1, np.int64)
    left_over = np.flatnonzero(viable.any(axis=1))
    out[left_over] = boxes[left_over].sum(axis=1)
    return out


def jaccard_at_least(x: bytes, y: bytes, similarity: float) -> bool:
    left, right = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    both = len(np.intersect1d(left, right, assume_unique=True))
    return both >= similarity * (len(left) + len(right) - both)


def keyed(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """doc_id, t, s (the digest of the text's set of shingles) and keys. docs: doc_id, t, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, keys = [], []
            for x in batch.column(2).cast(pa.large_binary()):
                own = shingle_set(x.as_py(), words)
                digests.append(xxhash.xxh3_128_digest(own.tobytes()))
                keys.append(segment_keys(own, similarity))
            ends = pa.array(np.cumsum([0, *map(len, keys)]), pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.empty(0, np.int64), *keys])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(digests, pa.binary()), lists], names=["doc_id", "t", "s", "keys"])

    return docs.mapInArrow(run, "doc_id long, t binary, s binary, keys array<long>")


def ringed(texts: DataFrame, words: int) -> DataFrame:
    """id, small (too few shingles for the ring to tell), ring and set of shingles. texts: id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x.as_py(), words) for x in batch.column(1).cast(pa.large_binary())]
            columns = [pa.array([len(x) < SMALL for x in sets], pa.bool_()), pa.array(map(wide_fingerprint, sets), pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "small", "ring", "set"])

    return texts.mapInArrow(run, "id long, small boolean, ring binary, set binary")


def rings_of(column: pa.Array | list) -> np.ndarray:
    raw = column.to_pylist() if isinstance(column, pa.Array) else column
    return np.frombuffer(b"".join(raw), "<u8").reshape(-1, RING_BITS // 64)


def alike(pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose sets have at least this Jaccard similarity. pairs: a, b, and small, ring and set of both."""
    most = greatest_distance(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = (ring_distances(rings_of(batch.column(2)), rings_of(batch.column(3)), most) <= most) | batch.column(6).to_numpy(zero_copy_only=False)
            for i in np.flatnonzero(near).tolist():
                near[i] = jaccard_at_least(batch.column(4)[i].as_py(), batch.column(5)[i].as_py(), similarity)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(near))

    return pairs.select("a", "b", "ring_a", "ring_b", "set_a", "set_b", "small_a").mapInArrow(run, "a long, b long")


def task_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """The rows of each (k, i, j), as lists by column, from sorted batches."""
    held: list[tuple] = []
    names: list[str] = []
    for batch in batches:
        names = batch.schema.names
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and row[:3] != held[-1][:3]:
                yield dict(zip(names, zip(*held)))
                held = []
            held.append(row)
    if held:
        yield dict(zip(names, zip(*held)))


def candidates(group: dict[str, list], most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each member but the last, the later ones of another label whose rings are near, with their distances. Where the
    group joins two blocks, only members of different blocks are compared."""
    rings, labels, sides, small = rings_of(group["ring"]), np.array(group["label"]), np.array(group["side"]), np.array(group["small"])
    within = group["i"][0] == group["j"][0]
    for r in range(len(labels) - 1):
        other = labels[r + 1 :] != labels[r]
        if not within:
            other &= sides[r + 1 :] != sides[r]
        at = np.flatnonzero(other) + r + 1
        if len(at):
            far = ring_distances(rings[at], rings[r], most)
            near = (far <= most) | (small[at] & small[r])
            if near.any():
                yield r, at[near], far[near]


def with_partners(groups: DataFrame, similarity: float) -> DataFrame:
    """The rows k, i, j, id of groups for which `candidates` finds another. groups: k, i, j, side, id, label, ring."""
    most = greatest_distance(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in task_groups(batches):
            found = np.zeros(len(group["id"]), bool)
            for r, at, _ in candidates(group, most):
                found[r] = True
                found[at] = True
            if found.any():
                rows = [pa.array(np.array(group[c])[found], pa.int64()) for c in ("k", "i", "j", "id")]
                yield pa.RecordBatch.from_arrays(rows, names=["k", "i", "j", "id"])

    dealt = groups.select("k", "i", "j", "side", "id", "label", "small", "ring").repartition("k", "i", "j").sortWithinPartitions("k", "i", "j", "id")
    return dealt.mapInArrow(run, "k long, i long, j long, id long")


def compare(groups: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between members of a group with different labels: all that are alike are joined by the links, of which there
    are fewer than members. groups: k, i, j, side, id, label, small, ring, set."""
    most = greatest_distance(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in task_groups(batches):
            root: dict[int, int] = {}

            def find(x: int) -> int:
                while (y := root.setdefault(x, x)) != x:
                    root[x] = root[y]
                    x = y
                return x

            a, b = [], []
            for r, at, far in candidates(group, most):
                for m in at[np.argsort(far, kind="stable")].tolist():  # the nearest first: they save the others' comparison
                    x, y = find(group["label"][r]), find(group["label"][m])
                    if x != y and jaccard_at_least(group["set"][r], group["set"][m], similarity):
                        root[x] = y
                        a.append(group["id"][r])
                        b.append(group["id"][m])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    dealt = groups.select("k", "i", "j", "side", "id", "label", "small", "ring", "set").repartition("k", "i", "j").sortWithinPartitions("k", "i", "j", "id")
    return dealt.mapInArrow(run, "a long, b long")


def dealt_groups(rows: DataFrame) -> DataFrame:
    """rows (k, id, n, label, and as `top` the count and label of the group's largest label) for the tasks that compare them: i, j
    and side more.

    A group of up to BLOCK members is one task's. A larger one is cut into blocks, those of the largest label's members apart from the
    others', and each pair of blocks is a task's but for two of the largest label, whose members are joined already. So a large
    group of copies with a few others near it is read once for each block of the others."""
    small, major = F.col("n") <= BLOCK, F.col("label") == F.col("top.label")
    blocks = lambda n: F.greatest(F.ceil(n / BLOCK).cast("long"), F.lit(1).cast("long"))
    minors, majors = blocks(F.col("n") - F.col("top.c")), blocks(F.col("top.c"))
    place = F.xxhash64("id", "k")
    zero = F.lit(0).cast("long")
    side = F.when(small, zero).when(major, minors + F.pmod(place, majors)).otherwise(F.pmod(place, minors))
    last = F.when(small, zero).when(major, minors - 1).otherwise(minors + majors - 1)
    own = rows.select("k", "id", "label", side.alias("side"), F.explode(F.sequence(zero, last)).alias("other"))
    return own.withColumn("i", F.least("side", "other")).withColumn("j", F.greatest("side", "other")).drop("other")


def linked(keys: DataFrame, nodes: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """(id, root) of the nodes that have a text alike. keys: id, k. nodes: id, t, doc_id. texts: t, doc_id, text.

    First each node is compared with one other, that which of all nodes that share a key with it shares most with the rest;
    where texts are copies of one, that's the one, and its copies become a group at a link each. Then the nodes of all keys with the
    same such node are put together, and those of different groups are compared, all with all, in blocks, by the task that holds
    them; what leaves it are links. So all that share a key are compared."""
    counts = keys.groupBy("k").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut(apart(keys, "k").join(apart(counts, "k"), ["k", "apart"]).drop("apart"))
    degree = shared.groupBy("id").agg(F.sum("n").alias("degree"))
    needed = nodes.join(degree.select("id"), "id").select("id", F.col("t").alias("own_t"), F.col("doc_id").alias("own_id"))
    own = texts.join(needed, (F.col("t") == F.col("own_t")) & F.col("doc_id").eqNullSafe(F.col("own_id"))).select("id", "text")
    sets = cut(ringed(own, words).dropDuplicates(["id"]))
    both = lambda pairs, *names: pairs.join(sets.select(F.col("id").alias("a"), *(F.col(c).alias(f"{c}_a") for c in names)), "a").join(sets.select(F.col("id").alias("b"), *(F.col(c).alias(f"{c}_b") for c in names)), "b")

    ranked = shared.join(degree, "id").select("k", "id", F.struct(F.col("degree"), (-F.col("id")).alias("minus")).alias("rank"))
    best = ranked.groupBy("k").agg(F.max("rank").alias("best"))
    led = cut(apart(ranked, "k").join(apart(best, "k"), ["k", "apart"]).select("id", "rank", "best"))
    near = led.where("best <> rank").groupBy("id").agg(F.max("best").alias("best"))
    links = cut(alike(both(near.select((-F.col("best.minus")).alias("a"), F.col("id").alias("b")), "small", "ring", "set"), similarity))
    roots = cut(components(links).toDF("id", "label"))

    # keys with the same most connected member are one group, so that a family is dealt out once, not for each key that it shares
    rows = cut(led.select((-F.col("best.minus")).alias("k"), "id").distinct().join(roots, "id", "left").select("k", "id", F.coalesce("label", "id").alias("label")))
    sizes = rows.groupBy("k", "label").agg(F.count("*").alias("c")).groupBy("k").agg(F.count("*").alias("labels"), F.sum("c").alias("n"), F.max(F.struct("c", "label")).alias("top"))
    mixed = sizes.where("labels > 1").select("k", "n", "top")
    groups = cut(dealt_groups(apart(rows, "k").join(apart(mixed, "k"), ["k", "apart"]).drop("apart")))
    held = with_partners(groups.join(sets.drop("set"), "id"), similarity)
    more = compare(groups.join(held, ["k", "i", "j", "id"]).join(sets, "id"), similarity)
    # few links are left to be found, so the groups that they join, not the members, go through another round
    at = lambda name: F.coalesce(F.col(f"label_{name}"), F.col(name)).alias(name)
    named = more.join(roots.toDF("a", "label_a"), "a", "left").join(roots.toDF("b", "label_b"), "b", "left").select(at("a"), at("b"))
    joined = cut(components(named).toDF("label", "whole"))
    every = roots.join(joined, "label", "left").select("id", F.coalesce("whole", "label").alias("root"))
    return every.unionByName(joined.select(F.col("label").alias("id"), F.col("whole").alias("root"))).distinct()


def deduplicate(docs: DataFrame, words: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs that stay, all columns as they are: of each group of near copies the one with the least doc_id.

    Rows with equal sets of shingles are one group (null counts as an empty text); of rows that also share id and text one stays;
    a null id ranks last."""
    key = F.substring(F.unhex(F.sha2(text_column().cast("binary"), 256)), 1, 16)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("t"), text_column().alias("text"))
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "t")
    nodes = keyed(own, words, similarity).groupBy("s").agg(F.min(rank).alias("rank"), F.first("keys").alias("keys"))
    nodes = cut(nodes.select(F.monotonically_increasing_id().alias("id"), "rank", "keys"))
    roots = linked(nodes.select("id", F.explode("keys").alias("k")), nodes.select("id", "rank.t", "rank.doc_id"), own, words, similarity)
    groups = nodes.select("id", "rank").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    stays = groups.groupBy("root").agg(F.min("rank").alias("one")).select("one.*")
    # the join and the dropping of rows that share id and text need the same partitioning, so texts are shuffled once
    named = lambda t, doc_id: {"__key": t, "__id": F.coalesce(doc_id.cast("long"), F.lit(0)), "__none": doc_id.isNull()}
    marked = docs.withColumns(named(key, F.col("doc_id")))
    place = ["__key", "__id", "__none"]
    return marked.join(stays.withColumns(named(F.col("t"), F.col("doc_id"))).select(place), place, "left_semi").dropDuplicates(place).select(docs.columns)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of each document."""
    out = near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
