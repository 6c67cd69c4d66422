"""Both stages on small records, and the chain from files to lists."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import context, decide, features, learn, models, stages
from tessera.plans import linkage
from tessera.session import reach
from tessera.sources import io

TREES = {"rounds": 4, "depth": 3}
FIRST = "acme bolt corner delta eagle fresh golden harbor iron jolly king lunar maple north ocean prime quick royal silver tiger".split()
LAST = "bakery motors foods clinic garage textiles optics printing roofing books".split()


def records(seed, n):
    """S1 rows and pool rows (id, name, address, country), with the true pairs; each S1 has two noisy copies in the pool."""
    rng = random.Random(seed)
    s1, pool, truth = [], [], []
    for i in range(n):
        name = f"{rng.choice(FIRST)} {rng.choice(FIRST)} {rng.choice(LAST)}"
        house, street, state = rng.randint(1, 999), rng.choice(FIRST), rng.choice(["TX", "IL", "NY", "CA"])
        s1.append((f"S1-{i}", f"{name.title()} Inc", f"{house} {street.title()} Street, Springfield, {state}", "US"))
        for k in (2, 3):
            kept = name if rng.random() < 0.7 else name.replace("e", "a", 1)
            pool.append((f"S{k}-{i}", f"{kept} {rng.choice(['inc', 'llc', ''])}", f"{house} {street} st, springfield, {state.lower()}", "US"))
            truth.append((f"S1-{i}", f"S{k}-{i}"))
    return s1, pool, truth


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    reach(spark)
    place = str(tmp_path_factory.mktemp("records"))
    truth = {}
    for split, seed in (("train", 1), ("test", 2)):
        s1, pool, truth[split] = records(seed, 120)
        rows = {1: s1, 2: [r for r in pool if r[0].startswith("S2")], 3: [r for r in pool if r[0].startswith("S3")]}
        for i, own in rows.items():
            io.write_tsv(spark.createDataFrame(own, io.RECORD), f"{place}/{split}_source{i}.tsv")
    lists = {}
    for a, b in truth["train"]:
        lists.setdefault(a, []).append(b)
    io.write_tsv(spark.createDataFrame([(a, ",".join(b)) for a, b in lists.items()], io.TRUTH), f"{place}/train_matches.tsv")
    return place, truth


def test_from_files_to_lists(spark, folder, tmp_path):
    place, truth = folder
    options = linkage.Options(train=80, validation=30, train_cap=100, first=TREES, second=TREES)
    trained = linkage.run(spark, place, str(tmp_path), options)
    assert trained.rule in ("expected", "threshold") and trained.validation_f05 > 0.8
    assert {"e_n_exact", "e_llr_miss_sum", "r_s1_key_n", "c_rank_s1", "g_size", "p"} <= set(trained.context_columns)
    found = io.long_truth(io.read_tsv(spark, f"{tmp_path}/matches", io.TRUTH))
    want = spark.createDataFrame(truth["test"], "s1 string, cand string")
    ids = want.select("s1").distinct()
    assert found.select("s1").distinct().count() == 120
    assert decide.evaluate(found.where("cand is not null"), want, ids).first().f05 > 0.8
    lists = io.read_tsv(spark, f"{tmp_path}/candidates", io.TRUTH)
    assert lists.count() == 120
    again = stages.load(spark, f"{tmp_path}/models")
    assert (again.rule, again.threshold, again.columns, again.context_columns) == (trained.rule, trained.threshold, trained.columns, trained.context_columns)
    assert {(r.kind, r.word, r.llr) for r in again.tables.collect()} == {(r.kind, r.word, r.llr) for r in trained.tables.collect()}


def test_whole_context(spark):
    reach(spark)
    rows = [(i, f"{n} shop", f"{n} shop", f"shop {n}", f"{n}shop", "", f"{i} main st", str(i), str(i), "main", "x", "tx", "", "US") for i, n in ((1, "acme"), (2, "bolt"), (11, "acme"), (12, "acmes"))]
    names = "entity_id long, name_clean string, name_core string, name_sorted string, name_concat string, legal string, addr_clean string, addr_nums string, house string, street string, city string, state string, postcode string, country string"
    df = spark.createDataFrame(rows, names)
    s1, pool = df.where("entity_id < 10"), df.where("entity_id > 10").withColumn("src", F.lit(2))
    pairs = spark.createDataFrame([(1, 11, 0.9, 1), (1, 12, 0.4, 0), (2, 12, 0.3, 0), (2, 11, 0.001, 0)], "s1 long, cand long, p double, y int")
    tables = spark.createDataFrame([("miss", "bolt", -1.5), ("extra", "acmes", 2.0)], "kind string, word string, llr double")
    scores = {"a": spark.createDataFrame([(1, 11, 0.8), (2, 12, 0.1)], "s1 long, cand long, ce double")}
    got = {(r.s1, r.cand): r for r in context.build(pairs, context.Evidence(s1, pool, tables, scores=scores)).collect()}
    assert set(got) == {(1, 11), (1, 12), (2, 12)}  # 0.001 is below the least score
    assert [got[1, 12][c] for c in ("c_rank_s1", "c_nclaim", "e_n_typo", "e_n_miss", "ce_a", "r_s1_key_n", "r_same_key")] == [2, 2, 1, 0, None, 1, 0]
    assert [got[2, 12][c] for c in ("e_n_exact", "e_n_miss", "e_llr_miss_sum", "e_llr_extra_sum", "e_unk_miss", "cx_rank_s1", "y")] == [1, 1, -1.5, 2.0, 0, 1, 0]
    assert got[1, 11].r_same_key == 1 and got[1, 11].r_pool_key_n == 1 and got[1, 11].cx_mean == 0.8


def test_folds_are_whole_states(spark):
    records_of = spark.createDataFrame([(i, f"s{i % 7}") for i in range(70)] + [(100, None)], "entity_id long, state string")
    pairs = spark.createDataFrame([(i, 0) for i in (*range(70), 100, 200)], "s1 long, cand long")
    fold = {r.s1: r.fold for r in models.with_fold(pairs, records_of).collect()}
    assert len(fold) == 72 and all(fold[i] == fold[i + 7] for i in range(63)) and fold[100] == fold[200] and set(fold.values()) == {0, 1}
    parts = [{r.s1 for r in df.collect()} for df in models.split_folds(pairs, records_of)]
    assert parts == [{i for i in fold if fold[i] == k} for k in (0, 1)]


def test_pairs_for_pair_scorers(spark):
    df = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.001)], "s1 long, cand long, p double")
    got = models.pairs_to_score({"train": df, "test": df})
    assert {k: [tuple(r) for r in v.collect()] for k, v in got.items()} == {"train": [(1, 2)], "test": [(1, 2)]}


def test_rules_and_scans(spark, tmp_path):
    assert decide.choose_rule(0.9, 0.8) == "expected" and decide.choose_rule(0.8, 0.8) == "threshold"
    df = spark.createDataFrame([("a", "US", 1), ("b", "France", 2)], "entity_id string, country string, x int")
    io.write_shards(df, str(tmp_path / "shards"))
    out = io.scan(spark, str(tmp_path / "shards"), ["entity_id"], "US")
    assert out.columns == ["entity_id"] and [r.entity_id for r in out.collect()] == ["a"]
    assert "PartitionFilters: [isnotnull(country" in out._jdf.queryExecution().toString()


def test_tables_without_folds_are_of_all_pairs(spark):
    df = spark.createDataFrame([(1, ["a"]), (1, ["a"]), (0, ["a"])], "y int, miss array<string>")
    with_fold = df.withColumn("fold", F.monotonically_increasing_id() % 2)
    assert learn.llr_table(df, ["miss"]).collect() == learn.llr_table(with_fold, ["miss"]).collect()


def test_hybrid_wants_equal_candidates(spark):
    lists = spark.createDataFrame([("a", "1"), ("b", "2")], "source1_entity_id string, matched_entity_ids string")
    other = spark.createDataFrame([("a", "9"), ("b", "8")], lists.schema)
    got = io.hybrid(lists, other, lists.where("source1_entity_id = 'b'"), candidates=(lists, lists.orderBy("matched_entity_ids")))
    assert {tuple(r) for r in got.collect()} == {("a", "1"), ("b", "8")}
    with pytest.raises(ValueError):
        io.hybrid(lists, other, lists, candidates=(lists, other))


def test_context_scores_names_once_for_each_part(spark):
    """Python runs once for siblings and once for clusters, however many parts read the ranks; edits that are there aren't made again."""
    reach(spark)
    rows = [(i, *["x y"] * len(features.FIELDS), "US") for i in (1, 2, 11, 12)]
    df = spark.createDataFrame(rows, ", ".join(["entity_id long", *(f"{c} string" for c in features.FIELDS), "country string"]))
    s1, pool = df.where("entity_id < 10"), df.where("entity_id > 10").withColumns({"src": F.lit(2), "is_domain": F.lit(0)})
    pairs = spark.createDataFrame([(1, 11, 0.9), (1, 12, 0.4), (2, 12, 0.3)], "s1 long, cand long, p double")
    plain = context.build(pairs, context.Evidence(s1, pool))
    table = features.pair_features(pairs, s1, pool, with_edits=True)
    assert not {*learn.EDITS, *learn.EDIT_COUNTS} & set(stages.feature_columns(table))
    given = context.build(table.select(*pairs.columns, *learn.EDITS, *learn.EDIT_COUNTS), context.Evidence(s1, pool))
    assert given.columns == plain.columns and sorted(map(tuple, given.collect())) == sorted(map(tuple, plain.collect()))
    plan = given._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2
