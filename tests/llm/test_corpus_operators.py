"""Each operator against a plain version on small data."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from tessera.llm import decontamination, language_id, line_dedup, lm_scoring, packing, quality, run_index, secrets, simhash, token_counts
from tessera.session import reach

WORD = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def docs(spark, sf):
    reach(spark)
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


def make(spark, rows):
    reach(spark)
    return spark.createDataFrame(rows, "doc_id long, text string")


# ---------------------------------------------------------------- 1


def test_packing_round_trip(docs, texts):
    from tokenizers import Tokenizer

    out = packing.pack(docs).toPandas()
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    by_doc = dict(list(out.sort_values(["doc_id", "start"]).groupby("doc_id")))
    for doc, text in texts.items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in by_doc[doc].itertuples():
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= 2048 and (g.length.cumsum() - g.length == g.offset).all()
    assert out.length.sum() / (2048 * out.sequence_id.nunique()) > 0.95


def test_differencing_places_all_and_levels():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 257, 900)
    window = packing.differencing(lengths, 50)
    loads = np.bincount(window, lengths, 50)
    assert loads.sum() == lengths.sum() and loads.max() - loads.min() < 64
    fitted = packing.near_equal(lengths, 2048)
    assert np.bincount(fitted, lengths).max() <= 2048


def test_odd_texts_have_the_tokenizers_ids():
    memo = packing.WordIds(packing.default_tokenizer())
    cases = ["ΑΣ ος", "a\x1cb c", "<|endoftext|> hi", "don't 'S x's", "İstanbul Å K ½", "क़क 한글", "a,b.c;;", "", " x​y"]
    for got, text in zip(memo.texts(cases), cases):
        assert got.tolist() == memo.tokenizer.encode(text, add_special_tokens=False).ids, text


# ---------------------------------------------------------------- 2


def plain_fingerprint(text):
    w = re.findall(WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    runs = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    ones = [0] * 64
    for r in runs:
        h = xxhash.xxh64_intdigest(r.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(runs))


def roots(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_equals_brute_force(spark, sf, texts):
    out = {r.doc_id: r for r in simhash.op2_simhash_near_dedup(spark, sf).collect()}
    fp = {i: plain_fingerprint(t) for i, t in texts.items()}
    near = [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 3]
    root = roots(fp, near)
    for i in fp:
        assert int(out[i].fingerprint, 16) == fp[i] and out[i].component_id == root[i]


def test_links_equal_brute_force(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(15)]
    fps = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) & (1 << 64) - 1 for b in base for _ in range(8)} | {0, 1, (1 << 64) - 1})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    assert got == want and len(want) > 10


def test_wide_dedup_keeps_one_of_each_group(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(4000)]
    rows = []
    for g in range(12):
        own = rng.choices(words, k=300)
        for c in range(3):
            copy = list(own)
            for _ in range(c * 2):
                copy[rng.randrange(300)] = rng.choice(words)
            rows.append((100 * g + c, " ".join(copy)))
    rows += [(5000 + i, " ".join(rng.choices(words, k=300))) for i in range(20)] + [(0, rows[0][1]), (None, rows[0][1])]
    kept = sorted(r.doc_id for r in simhash.deduplicate(make(spark, rows)).collect())
    assert kept == sorted([100 * g for g in range(12)] + [5000 + i for i in range(20)])


def shingles(text):
    w = text.lower().encode().split()
    return set(zip(*(w[j:] for j in range(5)))) or ({tuple(w)} if w else set())


def test_wide_dedup_decides_by_similarity(spark):
    """Pairs just above 0.8 go and those just below stay; the distance of rings errs on both sides there."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=9))
    rows = []
    for g in range(60):
        own = [word() for _ in range(504)]
        for c, last in ((0, 504), (1, 449 if g % 2 else 447)):  # with the tail replaced: 445 or 443 of 500 shingles are shared
            rows.append((10 * g + c, " ".join(own[:last] + [word() for _ in range(504 - last)])))
    sets = {i: shingles(t) for i, t in rows}
    similar = {i: len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in range(0, 600, 10)}
    assert all((0.8 <= s < 0.81) if i // 10 % 2 else (0.79 < s < 0.8) for i, s in similar.items())
    rings = {i: simhash.rings_of([simhash.wide_fingerprint(simhash.shingle_set(t.encode(), 5))]) for i, t in rows}
    most = simhash.greatest_distance(0.8)
    far = [int(simhash.ring_distances(rings[i], rings[i + 1], most)[0]) for i in similar]
    assert max(far) <= most
    kept = {r.doc_id for r in simhash.deduplicate(make(spark, rows)).collect()}
    assert {i for i in similar if i + 1 not in kept} == {i for i, s in similar.items() if s >= 0.8}


def test_chains_prune_only_what_is_too_far():
    rng = np.random.default_rng(5)
    bits = simhash.RING_BITS
    most = simhash.greatest_distance(0.8)
    one = rng.integers(0, 1 << 63, (1, bits // 64)).astype(np.uint64)
    flips = [sum(1 << int(b) for b in rng.choice(bits, n, replace=False)) for n in range(0, 2 * most, 5) for _ in range(3)]
    many = one ^ np.array([[f >> 64 * i & (1 << 64) - 1 for i in range(bits // 64)] for f in flips], np.uint64)
    plain = np.array([f.bit_count() for f in flips])
    got = simhash.ring_distances(many, one, most)
    assert (got[plain <= most] == plain[plain <= most]).all() and (got[plain > most] > most).all()


def edited(rng, words, own):
    """A copy with some words replaced, taken out or put in, or cut at an end."""
    own = list(own)
    kind = rng.randrange(4)
    if kind == 3:
        lost = rng.randrange(len(own) // 4)
        return own[lost:] if rng.random() < 0.5 else own[: len(own) - lost]
    for _ in range(rng.randrange(1 + len(own) // 40)):
        at = rng.randrange(len(own))
        own[at : at + (kind < 2)] = [rng.choice(words)] if kind else []
    return own


@pytest.mark.parametrize("block", [1024, 8])
def test_wide_dedup_equals_brute_force(spark, monkeypatch, block):
    """Copies of copies, families whose members are less alike, short texts, and one passage in many texts."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(3000)]
    texts = [rng.choices(words, k=n) for n in (0, 1, 2, 3, 4, 5, 5, 6, 7, 8, 9, 12, 20)]
    texts += [t[:-1] for t in texts if len(t) > 1]
    for n in (30, 60, 120, 200, 400, 900):
        for _ in range(3):
            family = [rng.choices(words, k=n)]
            for _ in range(14):
                family.append(edited(rng, words, rng.choice(family)))
            texts += family
    passage = rng.choices(words, k=80)
    texts += [rng.choices(words, k=40) + passage + rng.choices(words, k=40) for _ in range(40)]
    far = rng.choices(words, k=200)
    texts += [[w if rng.random() < 0.95 else rng.choice(words) for w in far] for _ in range(40)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = [shingles(t) for _, t in rows]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = {i for i, r in roots(range(len(rows)), links).items() if i == r}
    assert 60 < len(want) < len(rows) - 150
    assert {r.doc_id for r in simhash.deduplicate(make(spark, rows)).collect()} == want


# ---------------------------------------------------------------- 3


def test_token_counts_equal_the_library(texts):
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = token_counts.vocabulary(token_counts.default_vocabulary())
    reference = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    reference.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    count = token_counts.Counter(pieces)
    odd = ["", " ", "  a  ", "▁", "a▁b", "\n\n a\n", "<s> <0x0A>", "日本語 😀", "a\x00 b", "é" * 50, "\t\ta"]
    for text in [*odd, *list(texts.values())[:60]]:
        want = len(reference.encode(text).ids)
        assert count.text(text) == want and count.text(text, size=41) == want, text[:40]


def test_token_counts_of_the_table_equal_a_plain_search(spark, sf, texts):
    """The whole query against a dynamic program over all substrings, with the tie rule: the first of equal scores by start."""
    pieces = dict(token_counts.vocabulary(token_counts.default_vocabulary()))
    unknown = min(pieces.values()) - 10
    longest = max(map(len, pieces))

    def plain(word):
        best = [(0.0, 0)] + [None] * len(word)
        for end in range(1, len(word) + 1):
            for start in range(max(0, end - longest), end):
                x = word[start:end]
                step = (pieces[x], 1) if x in pieces else (unknown, None) if end - start == 1 else None
                if step and (best[end] is None or best[start][0] + step[0] > best[end][0]):
                    n = step[1] if step[1] else len(x.encode()) if all(f"<0x{b:02X}>" in pieces for b in x.encode()) else 1
                    best[end] = (best[start][0] + step[0], best[start][1] + n)
        return best[-1][1]

    out = {r.doc_id: r.n_tokens for r in token_counts.op3_token_counts(spark, sf).collect()}
    assert set(out) == set(texts)
    memo = {}
    for i, t in list(texts.items())[:40]:
        if t and "\n" not in t and "▁" not in t:
            total = 0
            for w in t.split(" "):
                w = "▁" + w
                memo[w] = memo.get(w) or plain(w)
                total += memo[w]
            assert out[i] == total, t[:60]


# ---------------------------------------------------------------- 4


def plain_tiles(item, text, k):
    used_i, used_t, marked = [False] * len(item), [False] * len(text), 0
    while True:
        best = (0, 0, 0)
        for p in range(len(item)):
            for t in range(len(text)):
                n = 0
                while p + n < len(item) and t + n < len(text) and item[p + n] == text[t + n] and not used_i[p + n] and not used_t[t + n]:
                    n += 1
                if n > best[0]:
                    best = (n, p, t)
        n, p, t = best
        if n < k:
            return marked
        for j in range(n):
            used_i[p + j] = used_t[t + j] = True
        marked += n


def test_tiling_equals_brute_force():
    rng = random.Random(4)
    for _ in range(150):
        item = [rng.choice("abc") for _ in range(rng.randint(3, 14))]
        text = [rng.choice("abc") for _ in range(rng.randint(3, 22))]
        block = decontamination.Block([(1, " ".join(item))], 3)
        got = next((m[2] for m in block.matches(" ".join(text), 0.0)), 0)
        assert got == plain_tiles(item, text, 3), (item, text)


def test_contaminated_documents_equal_brute_force(spark, sf, texts):
    """The whole query: tiling written again, over all pairs that share five words in a row."""
    words = lambda t: re.findall("[a-z0-9\x80-\U0010ffff]+", (t or "").lower())
    runs = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    want = set()
    items = [(r.item_id, words(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    of_items = [(i, w, runs(w)) for i, w in items]
    for doc, text in texts.items():
        own = words(text)
        seeds = runs(own)
        for item, w, grams in of_items:
            if grams & seeds and (n := plain_tiles(w, own, 5)) >= 0.5 * len(w):
                want.add((doc, item, len(w), n))
    got = {(r.doc_id, r.item_id, r.item_words, r.covered_words) for r in decontamination.op4_decontamination(spark, sf).collect()}
    assert got == want and len(want) >= 3


def test_reordered_passages_are_found(spark):
    item = " ".join(f"w{i}" for i in range(30))
    parts = item.split()
    moved = " ".join(parts[20:] + ["x"] * 40 + parts[:20])
    docs = make(spark, [(1, moved), (2, " ".join(parts[:8])), (3, "clean text " * 20), (4, None), (None, item)])
    benchmark = spark.createDataFrame([(7, item), (8, None), (9, "too short"), (10, item)], "item_id long, text string")
    got = decontamination.contaminated(docs, benchmark, block_chars=60).collect()
    assert sorted((r.doc_id or 0, r.item_id) for r in got) == [(0, 7), (0, 10), (1, 7), (1, 10)]
    assert sorted(r.doc_id for r in decontamination.decontaminate(docs, benchmark, block_chars=60).collect()) == [2, 3, 4]
    assert decontamination.contaminated(docs, benchmark.where("false")).count() == 0


# ---------------------------------------------------------------- 5


def test_language_is_predicted_on_held_out_rows(spark):
    path = "/root/testdata/sf0.01"
    reach(spark)
    out = language_id.op5_language_id(spark, path).toPandas()
    want = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "lang").toPandas()
    both = out.merge(want, on="doc_id")
    held = both[both.held_out]
    assert (held.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in held.doc_id]).all()
    assert len(held) > 200 and (held.lang_pred == held.lang).mean() > 0.97
    assert out.score.between(0, 1).all()


def test_language_of_nothing(spark):
    docs = spark.createDataFrame([(1, None, "en"), (2, "12 !?", "en"), (3, "the words of a text", "en"), (4, "les mots", None)], "doc_id long, text string, lang string")
    model = language_id.fit(docs.select("doc_id", "text", "lang").dropna())
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    assert got[1].lang_pred == got[2].lang_pred == "und" and got[1].score == 0 and got[4].lang_pred == "en"
    empty = language_id.fit(docs.where("false"))
    assert {r.lang_pred for r in language_id.predict(docs, empty).collect()} == {"und"}


# ---------------------------------------------------------------- 6


def plain_losses(texts, good):
    """(target, background) mean losses of each text under models without it, by counting again."""
    bags = {i: ["", *t.lower().encode().split()] for i, t in texts.items()}

    def counts(w):
        return collections.Counter(w[1:]), collections.Counter(w[:-1]), collections.Counter(zip(w, w[1:]))

    own = {i: counts(w) for i, w in bags.items()}
    sums = []
    for chosen in (good, set(texts)):
        total = tuple(collections.Counter() for _ in range(3))
        for i in chosen:
            for t, c in zip(total, own[i]):
                t.update(c)
        sums.append((chosen, total))
    size = max(1 << lm_scoring.WORD_BITS, len(sums[1][1][0]))

    def of(i):
        w = bags[i]
        n = [sum(t[0].values()) - (i in chosen) * (len(w) - 1) for chosen, t in sums]
        for (chosen, (one, context, two)), scale in zip(sums, (1, n[0] / max(1, n[1]))):
            out, less = 0, i in chosen
            for a, b in zip(w, w[1:]):
                p = ((one[b] - less * own[i][0][b]) * scale + lm_scoring.RAISE) / (n[0] + lm_scoring.RAISE * size)
                seen = context[a] - less * own[i][1][a]
                if seen > 0 and scale > 0:
                    p = lm_scoring.PAIR_WEIGHT * (two[a, b] - less * own[i][2][a, b]) / seen + (1 - lm_scoring.PAIR_WEIGHT) * p
                out -= np.log(p)
            yield out / max(1, len(w) - 1)

    return of


def test_scores_equal_plain_cross_entropies(spark, sf, texts):
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()} & set(texts)
    of = plain_losses(texts, good)
    out = {r.doc_id: r for r in lm_scoring.op6_lm_scoring(spark, sf).collect()}
    assert set(out) == set(texts) and 0 < len(good) < len(texts)
    for i, t in texts.items():
        if t.split():
            assert (out[i].target_loss, out[i].background_loss) == pytest.approx(tuple(of(i)), abs=1e-9)


def test_scores_equal_brute_force_at_size(spark, monkeypatch):
    """More words and pairs than any fixed table holds, and other documents scored too."""
    monkeypatch.setattr(lm_scoring, "BAG_WORDS", 5000)
    rng = random.Random(6)
    words = [f"w{i}" for i in range(150_000)]
    rows = [(i, " ".join(rng.sample(words, 3000) + ["end", "of", "text"])) for i in range(250)]
    texts, docs = dict(rows), make(spark, rows)
    good = set(range(0, 250, 5))
    of = plain_losses(texts, good)
    models = lm_scoring.fit(docs, docs.where("doc_id % 5 = 0"))
    out = {r.doc_id: r for r in lm_scoring.score(docs, models).collect()}
    assert set(out) == set(texts)
    for i in (0, 1, 249):
        assert (out[i].n_tokens, out[i].target_loss, out[i].background_loss) == pytest.approx((3003, *of(i)), abs=1e-9)
    new = " ".join(rng.choices(rows[3][1].split(), k=12_000))  # longer than a bag, and in no model
    far = plain_losses(texts | {900: new}, good)
    got = lm_scoring.score(make(spark, [(900, new)]), models).first()
    assert got.target_loss == pytest.approx(next(far(900)), abs=1e-9) and got.n_tokens == 12_000


def test_a_copy_is_no_news_to_the_background(spark):
    """Texts of one language: one that occurs twice is known to the model of all documents, one that occurs once isn't."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(500)]
    rows = [(i, " ".join(rng.choices(words, k=100))) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(20, 30)]
    docs = make(spark, rows)
    out = {r.doc_id: r.score for r in lm_scoring.score(docs, lm_scoring.fit(docs, docs.where("doc_id < 20"))).collect()}
    twice = [out[i] for i in out if 20 <= i < 30 or i >= 100]
    assert min(twice) > max(out[i] for i in out if i < 20 or 30 <= i < 60)


def test_scores_of_nothing(spark):
    docs = make(spark, [(1, None), (2, ""), (3, "a b a b"), (3, "a b")])
    got = lm_scoring.score(docs, lm_scoring.fit(docs, docs.where("doc_id = 3"))).collect()
    assert sorted((r.doc_id, r.n_tokens, r.score is None) for r in got) == [(1, 0, True), (2, 0, True), (3, 2, False), (3, 4, False)]
    assert all(r.score is None for r in lm_scoring.score(docs, lm_scoring.fit(docs, docs.where("false"))).collect())


# ---------------------------------------------------------------- 7


def test_quality_measures_equal_plain_ones(spark, sf, texts):
    for r in quality.op7_quality_rules(spark, sf).collect():
        x = texts[r.doc_id]
        w = re.findall(WORD, x)
        windows = list(zip(w, w[1:], w[2:]))
        n = collections.Counter(windows)
        inside = {j for i, k in enumerate(windows) if n[k] > 1 for j in (i, i + 1, i + 2)}
        seen, repeated = set(), 0
        for line in x.split("\n"):
            if re.search(WORD, line):
                repeated += line in seen
                seen.add(line)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), repeated, len(inside))
        assert r.base_failed == (len(w) < 50 or 100 * len(inside) > 50 * len(w))


def test_depleted_documents_go_and_copies_stay(spark):
    reach(spark)
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    own = lambda n: " ".join(word() for _ in range(n))
    menu = [own(12) for _ in range(6)]
    long = "\n".join(own(40) for _ in range(4))
    rows = [(i, "\n".join([*menu, own(10)]), "h") for i in range(20)] + [(100 + i, "\n".join([menu[0], own(30), own(30)]), "h") for i in range(20)]
    rows += [(200 + i, long + f"\nx{i}", "h") for i in range(20)] + [(300, "\n".join([*menu, own(10)]), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sorted(r.doc_id for r in quality.keep(docs).collect()) == [*range(100, 120), *range(200, 220), 300]


def test_paragraphs_are_left_to_the_dedup_operators(spark):
    """A long line that 30 different texts of a host have stays in them; substring dedup takes it out of all but the first."""
    reach(spark)
    rng = random.Random(14)
    own = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    long, short = own(quality.LINE_WORDS + 1), own(quality.LINE_WORDS)
    docs = spark.createDataFrame([(i, f"{own(40)}\n{long}\n{short}\n{own(30)}", "h") for i in range(30)], "doc_id long, text string, source string")
    kept = quality.keep(docs).collect()
    assert len(kept) == 30 and all(long in r.text and short not in r.text for r in kept)
    assert {r.doc_id for r in line_dedup.deduplicate(docs).collect() if long in r.text} == {0}


def test_limited_lines_go_from_the_texts_that_stay(spark):
    reach(spark)
    rng = random.Random(8)
    own = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    rows = []
    for i in range(20):
        a, b = own(40), own(30)
        rows.append((i, f"{a}\n  Read  MORE here\n{b}\nread more here", "h", 7, f"{a}\n{b}\n"))
    rows += [(50, rows[0][1], "other", 7, rows[0][1])]
    docs = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, source string, n_chars long")
    got = {r.doc_id: r for r in quality.clean(docs).collect()}
    kept = {r.doc_id: r for r in quality.keep(docs).collect()}
    words = {r.doc_id: r.n_removed_words for r in quality.judge(docs).collect()}
    assert set(got) == set(kept) == {r[0] for r in rows}
    for i, text, _, n, left in rows:
        assert got[i].text == kept[i].text == left and kept[i].n_chars == (n if text == left else len(left))
        assert [text[s.start : s.end].lower().split() for s in got[i].removed] == [["read", "more", "here"]] * (2 if i < 50 else 0)
        assert words[i] == sum(len(text[s.start : s.end].split()) for s in got[i].removed)


# ---------------------------------------------------------------- 8


def plain_repeats(texts, min_words, run_words):
    first, want = {}, set()
    for i in sorted(texts):
        at, runs = 0, [[]]
        for unit, line in enumerate(texts[i].split("\n")):
            pieces, inner = re.split("[.!?] ", line), at
            for part, piece in enumerate(pieces, 1):
                key, part = " ".join(piece.lower().split()), part if len(pieces) > 1 else 0
                n = len(key.split())
                if n >= min_words:
                    key = key.rstrip(".!?")
                    if key in first:
                        runs[-1].append((n, (i, unit, part, inner, inner + len(piece), *first[key])))
                    else:
                        first[key] = (i, unit, part)
                        runs.append([])
                inner += len(piece) + 2
            at += len(line) + 1
        want |= {x for run in runs if sum(n for n, _ in run) >= run_words for _, x in run}
    return want


@pytest.mark.parametrize("least", [(3, 20), (1, 1), (5, 60)])
def test_line_dedup_equals_plain(spark, docs, texts, least):
    got = {(r.doc_id, r.unit, r.part, r.start, r.end, r.kept_doc_id, r.kept_unit, r.kept_part) for r in line_dedup.repeats(docs, "line", *least).collect()}
    want = plain_repeats(texts, *least)
    assert got == want and any(x[2] for x in want)


def test_line_dedup_text_and_order(spark):
    line = "one two three four five"
    rows = [(2, f"a\n{line}\nb"), (1, f"{line}\nc"), (None, line), (3, None), (1, f"{line.upper()}\nd")]
    got = sorted(((r.doc_id or 0, r.text) for r in line_dedup.deduplicate(make(spark, rows), run_words=5).collect()), key=str)
    assert got == sorted([(2, "a\nb"), (1, f"{line}\nc"), (0, ""), (3, ""), (1, "d")], key=str)
    paragraphs = make(spark, [(1, f"{line}\n\nx"), (2, f"y\n\n{line}")])
    assert [(r.doc_id, r.start, r.end) for r in line_dedup.repeats(paragraphs, "paragraph", run_words=5).collect()] == [(2, 3, 3 + len(line))]


def test_passages_inside_of_lines(spark):
    """Sentences of a repeated passage go, also short ones; a repeated phrase or a single short sentence doesn't."""
    rng = random.Random(12)
    words = lambda n: " ".join("".join(rng.choices("abcdefghijklmnop", k=5)) for _ in range(n))
    passage = [words(n) for n in (9, 4, 2, 12, 6, 9, 10)]
    inside = ". ".join(passage)
    rows = [(1, f"{words(9)}. {inside}. {words(8)}"), (2, f"{words(7)}! {inside.upper()}! {words(7)}"), (3, f"{passage[0]}. {words(30)}.\n{passage[3]}.")]
    got = {(r.doc_id, r.part) for r in line_dedup.repeats(make(spark, rows)).collect()}
    assert got == {(2, i) for i in (2, 3, 5, 6, 7, 8)}
    text = {r.doc_id: r.text for r in line_dedup.deduplicate(make(spark, rows)).collect()}
    assert text[1] == rows[0][1] and text[3] == rows[2][1] and len(text[2].split()) == 16


def test_line_dedup_finds_passages_and_leaves_the_rest(spark):
    """Planted passages of 51 words and more at random places: nearly all are found, and no text without one loses a line."""
    rng = random.Random(13)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(3000)]

    def prose(n):
        out = []
        while len(out) < n:
            out += [*rng.choices(vocabulary, k=rng.randint(3, 14)), "."]
        return " ".join(out[: n + n // 8]).replace(" .", ".")

    passages = [prose(rng.randint(51, 80)) for _ in range(60)]
    rows = [(i, f"{prose(rng.randint(20, 90))} {passages[i % 60]} {prose(rng.randint(20, 90))}") for i in range(120)] + [(200 + i, prose(150)) for i in range(120)]
    found = {r.doc_id for r in line_dedup.repeats(make(spark, rows)).collect()}
    assert len(found & set(range(60, 120))) >= 57 and not found - set(range(60, 120))


# ---------------------------------------------------------------- 9


def plain_covered(raws, length):
    """Of each text which bytes strings of that length cover that start anywhere else too."""
    seen = collections.Counter(x[i : i + length] for x in raws for i in range(len(x) - length + 1))
    for x in raws:
        m = np.zeros(len(x), bool)
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                m[i : i + length] = True
        yield x, m, [(int(a), int(b)) for a, b in zip(*run_index.runs_of(m))]


def plain_removed(raws, length, least, words):
    out = []
    for (x, m, runs), (_, _, wide) in zip(plain_covered(raws, length), plain_covered(raws, least)):
        inside = [sum(a <= w.start() and w.end() <= b for w in re.finditer(rb"[^\x20\x09-\x0D]+", x)) for a, b in wide]
        inside = [n for n in inside if n >= words]
        out.append((len(x), int(m.sum()), len(runs), hashlib.sha256(np.frombuffer(x, np.uint8)[~m].tobytes()).hexdigest(), len(inside), sum(inside)))
    return sorted(out)


@pytest.mark.parametrize(("hot", "length", "least"), [(4096, 400, 256), (2, 400, 256), (4096, 100, 64), (4096, 120, 120)])
def test_run_index_equals_brute_force(spark, hot, length, least):
    rng = random.Random(6)
    text = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    base = [text(rng.randint(0, 1500)) for _ in range(20)]
    rows = []
    for _ in range(40):
        parts = []
        for _ in range(rng.randint(0, 4)):
            b = rng.choice(base)
            a = rng.randint(0, len(b))
            parts.append(b[a : a + rng.randint(0, 900)] + rng.choice(["", text(30)]))
        rows.append("".join(parts))
    rows += ["a" * 900, "ab" * 400, "a" * 399, None, "", rows[3], rows[3], "é" * 300, "xyz" * 100 + rows[5], "\0" * 50 + rows[5] + "\0" * 50]
    docs = make(spark, [(i if i % 9 else None, x) for i, x in enumerate(rows)])
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_passages, r.n_passage_words) for r in run_index.removed(docs, length, hot, least, 30).collect())
    want = plain_removed([(x or "").encode() for x in rows], length, least, 30)
    assert got == want


def test_passages_of_fifty_words_are_reported(spark):
    """Passages of 51 words in the middle of texts, most of them shorter than what is removed; the other texts stay as they are."""
    rng = random.Random(11)
    words = lambda n: " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 7))) for _ in range(n))
    passages = [words(51) for _ in range(30)]
    rows = [f"{words(40)} {passages[i // 2]} {words(30)}" for i in range(60)] + [words(120) for _ in range(60)]
    got = {r.doc_id: r for r in run_index.removed(make(spark, list(enumerate(rows)))).collect()}
    assert sum(len(p) < 400 for p in passages) > 20
    assert all((got[i].n_passages == 1 and got[i].n_passage_words >= 51) == (i < 60) for i in got)


def test_rows_equal_to_brute_force_on_the_table(spark, docs):
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_passages, r.n_passage_words) for r in run_index.removed(docs).collect())
    assert got == plain_removed([(r.text or "").encode() for r in docs.collect()], 400, 256, 50)


def test_index_statistics_equal_brute_force():
    rng = random.Random(7)
    strings = ["".join(rng.choices("ab", k=rng.randint(1, 12))).encode() for _ in range(8)]
    index = run_index.RunIndex(strings)
    got = index.matching_statistics()
    places = [(s, i) for s, x in enumerate(strings) for i in range(len(x))]
    for s, i in places:
        best = 0
        for u, j in places:
            if (s, i) != (u, j):
                n = 0
                while i + n < len(strings[s]) and j + n < len(strings[u]) and strings[s][i + n] == strings[u][j + n]:
                    n += 1
                best = max(best, n)
        assert got[index.starts[s] + i] == best
    assert index.runs < index.size


def test_index_sorts_no_further_than_its_strings():
    rng = random.Random(8)
    strings = ["".join(rng.choices("abc\0", k=rng.randint(20, 60))).encode() for _ in range(100)] * 2
    index = run_index.RunIndex(strings)
    assert max(step for step, _ in index.levels) < 60
    assert index.matching_statistics().tolist() == [n for x in strings for n in range(len(x), -1, -1)]


def test_index_sorts_only_what_can_be_repeated():
    rng = random.Random(9)
    noise = lambda n: bytes(rng.choices(b"abcdefgh", k=n))
    long, short = noise(3000), noise(300)
    strings = [noise(2000) + long + noise(2000), long, noise(2000) + short, short + noise(2000)]
    index = run_index.RunIndex(strings, None, 256, 400)
    got = index.matching_statistics()
    assert max(step for step, _ in index.levels) < 400
    assert index.levels[-1][1] < 7000 < index.size / 2
    for level in (256, 400):
        want = {(s, i) for s, base in ((0, 2000), (1, 0)) for i in range(base, base + 3001 - level)}
        want |= {(s, i) for s, base in ((2, 2000), (3, 0)) for i in range(base, base + 301 - level)}
        assert {(s, i) for s, x in enumerate(strings) for i in range(len(x)) if got[index.starts[s] + i] >= level} == want
    # matches of owned starts alone, the others' ranks are needed for them
    index = run_index.RunIndex(strings, [[(2500, 2600)], [(400, 450), (500, 600)], [], []], 256, 400)
    got = index.matching_statistics()
    assert (got[2500:2600] >= 400).all() and (got[index.starts[1] + 500 : index.starts[1] + 600] >= 400).all()
    assert index.levels[-1][1] <= 250


def test_long_texts_are_read_in_parts(monkeypatch):
    rng = random.Random(8)
    raw = bytes(rng.choices(b"abcd", k=5000))
    whole = {(a, d, p >> 24) for part in run_index.segments(raw, 400, 400) for a, d, p in zip(part[0].tolist(), part[1], part[2].tolist())}
    monkeypatch.setattr(run_index, "PART", 1000)
    windows = [(p >> 24, p >> 12 & 4095) for part in run_index.segments(raw, 400, 400) for p in part[2].tolist()]
    assert sorted(i for lo, n in windows for i in range(lo, lo + n + 1)) == list(range(4601)) and whole


# ---------------------------------------------------------------- 10

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain_secrets(t):
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return [f"{k}:{a}:{e}" for a, _, k, e in sorted(out)]


def test_secrets_equal_plain(spark, texts):
    rng = random.Random(9)
    parts = ["token", "SECRET", "api_key", "apikey", "passwd", "=", ":", " ", "'", '"', "abc", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "é😀", "\n", "x-y."]
    cases = ["".join(rng.choices(parts, k=rng.randint(1, 25))) for _ in range(300)] + ["a secret=token: abcdefgh", None, ""]
    docs = make(spark, list(enumerate(cases)) + [(1000 + i, t) for i, t in texts.items()])
    for r in secrets.scan(docs).collect():
        got = [f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.place < 3]
        assert got == plain_secrets(r.text), r.text[:200]


def test_trigram_queries_are_mandatory():
    assert secrets.trigram_query("[0-9a-f]{24,}") == []
    assert secrets.trigram_query("AKIA[A-Z]+") == [{frozenset({"aki", "kia"})}]
    assert secrets.trigram_query("a(?:bcd|efg)?h") == [] or all(secrets.trigram_query("a(?:bcd|efg)?h"))
    assert frozenset({"tok", "oke", "ken"}) in secrets.trigram_query(secrets.BASE[0].pattern)[0]


def test_more_kinds_and_masking(spark):
    docs = make(spark, [(1, "ghp_" + "a" * 36 + " and more"), (2, "clean"), (3, None), (4, "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSM")])
    got = {r.doc_id: r.text for r in secrets.mask(docs).collect()}
    assert got == {1: "[secret] and more", 2: "clean", 3: None, 4: "[secret]"}
