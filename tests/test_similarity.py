import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.functions import similarity as S

WORDS = st.text(alphabet="abc ", max_size=12)


def lcs_table(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row[-1]


@given(WORDS, WORDS)
@settings(max_examples=300, deadline=None)
def test_lcs_equals_the_table(a, b):
    assert S.lcs(a, b) == lcs_table(a, b)


@given(st.text(alphabet="abc", min_size=1, max_size=6), st.text(alphabet="abc", min_size=1, max_size=10))
@settings(max_examples=200, deadline=None)
def test_partial_ratio_is_the_best_part(a, b):
    if len(a) > len(b):
        a, b = b, a
    parts = lambda x, y: [y[i:j] for i in range(len(y)) for j in range(i + 1, min(len(y), i + len(x)) + 1) if j - i == len(x) or i == 0 or j == len(y)]
    best = max(S.ratio(a, p) for p in parts(a, b))
    if len(a) == len(b):
        best = max(best, *(S.ratio(b, p) for p in parts(b, a)))
    assert S.partial_ratio(a, b) == pytest.approx(best)


@given(WORDS, WORDS)
@settings(max_examples=200, deadline=None)
def test_scores_are_bounded_and_symmetric(a, b):
    for f in (S.ratio, S.token_sort_ratio, S.token_set_ratio):
        assert 0 <= f(a, b) <= 100
        assert f(a, b) == pytest.approx(f(b, a))
    assert 0 <= S.jaro_winkler(a, b) <= 1


def test_jaro_winkler_equals_duckdb():
    import duckdb

    random.seed(1)
    pairs = [("".join(random.choices("abcd", k=random.randint(1, 9))), "".join(random.choices("abcd", k=random.randint(1, 9)))) for _ in range(500)]
    for a, b in pairs:
        assert S.jaro_winkler(a, b) == pytest.approx(duckdb.execute("select jaro_winkler_similarity(?, ?)", [a, b]).fetchone()[0]), (a, b)


def test_token_ratios():
    assert S.token_set_ratio("alpha beta", "beta alpha gamma") == 100
    assert S.token_set_ratio("", "x") == 0
    assert S.token_sort_ratio("b a", "a b") == 100
    assert S.weighted_ratio("", "x") == 0
    assert S.ratio("", "") == 100


def test_alignment():
    assert S.align(["peak", "seafod", "zzz"], ["seafood", "peak", "extra"]) == (["zzz"], ["extra"], 1, 1)


def test_number_relation(spark):
    rows = [("12", "12", 0), ("12", "012", 1), ("569", "5690", 2), ("5591", "5592", 3), ("5591", "5604", 4)]
    df = spark.createDataFrame(rows, "a string, b string, want int")
    assert df.where(S.number_relation(df.a, df.b) != df.want).count() == 0


def test_null_safe_sets(spark):
    df = spark.createDataFrame([("", ""), ("a b", "b c")], "a string, b string")
    a, b = S.token_set(df.a), S.token_set(df.b)
    got = df.select(S.jaccard(a, b), S.containment(a, b)).collect()
    assert got[0][0] is None and got[0][1] is None
    assert got[1][0] == pytest.approx(1 / 3) and got[1][1] == 0.5


def plain_ratio(a, b):
    """Twice the longest common subsequence over both lengths, by the table."""
    return 100.0 if not a and not b else 200 * lcs_table(a, b) / (len(a) + len(b))


def plain_partial(a, b):
    if not a or not b:
        return 100.0 if a == b else 0.0
    if len(a) > len(b):
        a, b = b, a
    sides = [(a, b), (b, a)] if len(a) == len(b) else [(a, b)]
    return max(plain_ratio(x, y[max(0, e - len(x)) : min(e, len(y))]) for x, y in sides for e in range(1, len(y) + len(x)))


def plain_sets(a, b):
    x, y = set(a.split()), set(b.split())
    join = lambda t: " ".join(sorted(t))
    return join(x & y), join(x - y), join(y - x)


def plain_token_set(a, b):
    both, left, right = plain_sets(a, b)
    if not a.split() or not b.split():
        return 0.0
    if both and (not left or not right):
        return 100.0
    first, second = (f"{both} {x}".strip() for x in (left, right))
    return max([plain_ratio(first, second)] + ([plain_ratio(both, first), plain_ratio(both, second)] if both else []))


def plain_weighted(a, b):
    if not a or not b:
        return 0.0
    order = lambda t: " ".join(sorted(t.split()))
    far = max(len(a), len(b)) / min(len(a), len(b))
    if far < 1.5:
        return max(plain_ratio(a, b), 0.95 * plain_ratio(order(a), order(b)), 0.95 * plain_token_set(a, b))
    scale = 0.6 if far > 8 else 0.9
    both, left, right = plain_sets(a, b)
    parts = 0.0 if not a.split() or not b.split() else 100.0 if both else max(plain_partial(order(a), order(b)), plain_partial(left, right))
    return max(plain_ratio(a, b), scale * plain_partial(a, b), 0.95 * scale * parts)


def test_score_family_equals_plain_forms():
    """Each score against a form written again from its definition, on names, parts of names and typos of them."""
    rng = random.Random(3)
    words = ["acme", "acne", "bolt", "bolts", "corner", "shop", "st", "12", "7", "delta"]
    names = ["", "a", *(" ".join(rng.choices(words, k=rng.randint(1, 5))) for _ in range(60)), " ".join(words * 3)]
    plain = {"ratio": plain_ratio, "partial_ratio": plain_partial, "token_sort_ratio": lambda a, b: plain_ratio(*(" ".join(sorted(t.split())) for t in (a, b))), "token_set_ratio": plain_token_set, "weighted_ratio": plain_weighted}
    for _ in range(900):
        a, b = rng.choice(names), rng.choice(names)
        for name, f in plain.items():
            assert getattr(S, name)(a, b) == pytest.approx(f(a, b)), (name, a, b)


def test_scores_of_many_are_those_of_each():
    rng = random.Random(5)
    text = lambda: "".join(rng.choice("abc 01é漢") for _ in range(rng.choice([0, 1, 2, 5, 9, 20, 20, 30, 140 if rng.random() < 0.05 else 12])))
    a, b = [text() for _ in range(900)], [text() for _ in range(900)]
    for i in range(0, 900, 3):
        b[i] = a[i].replace("a", rng.choice("abc"), 1)
    for name in ("ratio", "partial_ratio", "token_sort_ratio", "token_set_ratio", "partial_token_ratio", "weighted_ratio", "jaro_winkler"):
        one, many = getattr(S, name), getattr(S, f"many_{name}s")
        assert many(a, b).tolist() == [one(x, y) for x, y in zip(a, b)], name
        assert many(a[:5], b[:5]).tolist() == [one(x, y) for x, y in zip(a[:5], b[:5])], name
    pairs = [(tuple(x.split()), tuple(y.split())) for x, y in zip(a, b)]
    assert S.aligned(pairs) == [S.align(list(x), list(y)) for x, y in pairs]
