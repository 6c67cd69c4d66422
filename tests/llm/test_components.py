"""Components against union-find, and what near-dedup leaves to the driver."""

import random

import pytest

from tessera.llm import simhash
from tessera.llm.components import components
from tessera.session import reach


def plain(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {x: find(x) for x in root}


GRAPHS = {
    "path": [(i, i + 1) for i in range(60)],
    "hub of the greatest id": [(i, 500) for i in range(300)] + [(900, 500), (901, 902)],
    "stars": [(i, i % 7) for i in range(7, 90)],
    "repeats and loops": [(3, 3), (4, 9), (9, 4), (4, 9), (9, 11)],
    "one loop": [(5, 5)],
}


@pytest.mark.parametrize("name", [*GRAPHS, "random", "strings"])
def test_components_equal_union_find(spark, name):
    draw = random.Random(name)
    edges = GRAPHS.get(name) or [tuple(draw.sample(range(400), 2)) for _ in range(330)]
    if name == "strings":
        edges = [(str(a), str(b)) for a, b in edges]
    found = components(spark.createDataFrame(edges, "a string, b string" if name == "strings" else "a long, b long")).collect()
    assert len(found) == len({r.node for r in found})
    assert {r.node: r.root for r in found} == plain(edges)


def test_near_duplicates_broadcast_nothing(spark):
    reach(spark)
    docs = spark.createDataFrame([(i, f"some words of text {i % 40} and more of them {i % 3}") for i in range(400)], "doc_id long, text string")
    fps = simhash.fingerprints(docs).select("fp").distinct()
    for df in (simhash.near_duplicates(docs), simhash.links(fps.localCheckpoint())):
        df.collect()
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_a_family_is_dealt_out_once(spark, monkeypatch):
    """Texts that share many keys are compared in one group, not again for each of the keys."""
    reach(spark)
    draw = random.Random(5)
    base = [f"w{draw.randrange(9999)}" for _ in range(300)]
    rows = [(0, " ".join(base))]
    for i in range(1, 60):  # each a tenth of its words away from the base, so two of them are further from each other than 0.8
        own, at = list(base), draw.randrange(260)
        own[at : at + 24] = [f"x{i}_{j}" for j in range(24)]
        rows.append((i, " ".join(own)))
    rows += [(100 + i, " ".join(base[:150] + [f"y{i}_{j}" for j in range(150)])) for i in range(20)]
    seen = []
    plain_deal = simhash.dealt_groups
    monkeypatch.setattr(simhash, "dealt_groups", lambda df: seen.append(df.count()) or plain_deal(df))
    left = {r.doc_id for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left == {0, *range(100, 120)}
    assert seen and seen[0] <= 2 * len(rows)
