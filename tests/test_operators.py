"""Blocking, dense search, learned tables, sources, models and augmentation on small data."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import augment, blocking, context, dense, features, grams, learn, models
from tessera.session import reach
from tessera.sources import io


@pytest.fixture(scope="module", autouse=True)
def reachable(spark):
    reach(spark)


def test_word_grams(spark):
    df = spark.createDataFrame([("Ab c",)], "x string")
    assert df.select(blocking.word_grams(F.col("x"))).first()[0] == [" ab", "ab ", " c "]


def test_exact_keys_skip_large_buckets(spark):
    s1 = spark.createDataFrame([(1, "x", "k"), (2, "x", "big"), (3, "x", "")], "id long, region string, key string")
    pool = spark.createDataFrame([(10, "x", "k"), (11, "y", "k"), *[(100 + i, "x", "big") for i in range(31)], (12, "x", "")], "id long, region string, key string")
    assert [(r.s1, r.cand) for r in blocking.exact_key(s1, pool, "k").collect()] == [(1, 10)]


def test_similarities_equal_a_plain_cosine(spark):
    names = ["alpha beta", "alpha betta", "gamma", "alpha", "beta gamma delta"]
    rows = [(i, "x", "p", n) for i, n in enumerate(names)]
    side = spark.createDataFrame(rows, "id long, region string, part string, text string")
    terms = blocking.idf(side, max_df=1.0, min_df=1)
    w = blocking.weights(side, terms)
    idf = {r.term: r.idf for r in terms.collect()}

    def vector(name):
        grams = [g for word in name.split() for p in [f" {word} "] for g in (p[i : i + 3] for i in range(len(p) - 2))]
        v = {g: (1 + np.log(grams.count(g))) * idf[g] for g in set(grams)}
        n = np.sqrt(sum(x * x for x in v.values()))
        return {g: x / n for g, x in v.items()}

    for r in blocking.similarities(w, w).collect():
        a, b = vector(names[r.s1]), vector(names[r.cand])
        assert r.sim == pytest.approx(sum(a[g] * b.get(g, 0) for g in a), abs=1e-6)


def test_ranks_count_all_rows_of_a_side(spark):
    sims = spark.createDataFrame([(1, 9, 0.9), (2, 9, 0.8), (3, 9, 0.8)], "s1 long, cand long, sim double")
    got = {(r.s1, r.rk_r) for r in blocking.leg(sims, 2, "cand", "r").collect()}
    assert got == {(1, 1), (2, 2)}


def test_legs_are_merged_by_maximum(spark):
    a = spark.createDataFrame([(1, 1, 0.5)], "s1 long, cand long, sim_f double")
    b = spark.createDataFrame([(1, 1, 0.7), (2, 2, 0.1)], "s1 long, cand long, sim_r double")
    got = {(r.s1, r.cand): (r.sim_f, r.sim_r) for r in blocking.merge_legs([a, b]).collect()}
    assert got == {(1, 1): (0.5, 0.7), (2, 2): (None, 0.1)}


def test_partition_keys(spark):
    s1 = spark.createDataFrame([("pune", "mh"), ("pune", "mh"), ("hyd", "tg")], "city string, state string")
    pool = spark.createDataFrame([("pune", "mh"), ("pune", ""), ("nowhere", ""), ("x", "tg")], "city string, state string")
    a, b = blocking.partition_keys(s1, pool)
    assert sorted(r.part for r in a.collect()) == ["ap", "mh", "mh"] and sorted(r.part for r in b.collect()) == ["?", "ap", "mh", "mh"]


@pytest.mark.parametrize("values", [9, 100, 1 << 20])
def test_dense_search_equals_plain(spark, values):
    """String ids, two countries, an id that both tables have, and small blocks."""
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 8))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(f"R{i}", "US" if i % 2 else None, x.tolist()) for i, x in enumerate(v)]
    pool = spark.createDataFrame([*rows, ("none", "US", None)], "id string, country string, vector array<double>").repartition(4)
    s1 = spark.createDataFrame(rows[::7], pool.schema)
    ids = list(range(0, 60, 7))
    sims = np.round(u @ u.T, 6)
    order = lambda own, others, k: sorted(others, key=lambda j: (-sims[own][j], f"R{j}"))[:k]
    ahead = {(f"R{i}", f"R{j}") for i in ids for j in order(i, [j for j in range(60) if j % 2 == i % 2], 5)}
    back = {(f"R{i}", f"R{j}") for j in range(60) for i in order(j, [i for i in ids if i % 2 == j % 2], 2)}
    got = dense.search(s1, pool, 5, 2, country="country", values=values).collect()
    assert {(r.s1, r.cand) for r in got} == ahead | back and all((f"R{i}", f"R{i}") in ahead for i in ids)
    for i in ids:
        ranked = sorted((r for r in got if r.s1 == f"R{i}"), key=lambda r: r.rk_dense)
        assert [r.sim_dense for r in ranked] == sorted((r.sim_dense for r in ranked), reverse=True)
    alone = dense.similar(s1, pool, 5, country="country", same=True, values=values).collect()
    assert {(r.query, r.row) for r in alone} == {(f"R{i}", f"R{j}") for i in ids for j in order(i, [j for j in range(60) if j % 2 == i % 2 and j != i], 5)}


def test_dense_recall_with_other_legs(spark):
    truth = spark.createDataFrame([(1, 10), (1, 11), (2, 12)], "s1 long, cand long")
    found = spark.createDataFrame([(1, 10, 1), (2, 12, 9)], "s1 long, cand long, rk_dense short")
    base = spark.createDataFrame([(1, 11), (1, 10), (5, 5)], "s1 long, cand long")
    got = {r["rank"]: (r.n_true, r.n_found, r.n_base, r.n_union) for r in dense.recall_by_rank(found, truth, [5, 10], base).collect()}
    assert got == {5: (3, 1, 2, 2), 10: (3, 2, 2, 3)}


def test_records_of_states(spark, tmp_path):
    df = spark.createDataFrame([(1, "va"), (2, "tx"), (3, ""), (4, None)], "id long, state string")
    assert sorted(r.id for r in dense.records(df, ["va"]).collect()) == [1, 3, 4]
    assert sorted(r.id for r in dense.records(df, ["va"], invert=True).collect()) == [2, 3, 4]
    vectors = spark.createDataFrame([("a", [0.5, 0.25])], "id string, vector array<double>")
    dense.save(vectors, str(tmp_path / "v"))
    assert [(r.id, r.vector) for r in dense.load(spark, str(tmp_path / "v")).collect()] == [("a", [0.5, 0.25])]


def test_embedding_is_unit_and_in_place(spark):
    df = spark.createDataFrame([(1, "some text"), (2, None), (3, "another")], "id long, text string")
    got = {r.id: np.array(r.vector) for r in dense.embed(df, "text").collect()}
    assert np.linalg.norm(got[1]) == pytest.approx(1, abs=1e-5) and len(got) == 3


def test_pair_features_have_all_columns(spark):
    fields = [("1", "Raab Treasury LLC", "12 Main St, Peoria, IL", "US")]
    df = spark.createDataFrame(fields, "entity_id string, business_name string, business_address string, country string")
    s1 = text.normalise_addresses(text.normalise_names(df, "business_name"), "business_address", "country")
    pool = s1.withColumns({"entity_id": F.lit("2"), "src": F.lit(2).cast("byte")})
    pairs = spark.createDataFrame([("1", "2")], "s1 string, cand string")
    r = features.pair_features(pairs, s1, pool).first()
    assert r.n_ratio == 100 and r.h_eq == 1 and r.legal_state == 2 and r.state_state == 1 and r.pin_state == 0 and r.h_diff == 0 and r.src == 2 and r.n_s1_same_name == 1
    assert len(r) == 2 + 42


def test_learned_dictionaries(spark):
    pairs = spark.createDataFrame([("New Delhi", "न्यू दिल्ली", "7 karol bagh", "7 करोल बाग"), ("delhi", "दिल्ली", "karol", "करोल"), ("a b", "दिल्ली", "karol x", "करोल y")], "name_a string, name_b string, addr_a string, addr_b string")
    names = {r.token: r.latin for r in learn.aligned_tokens(pairs).collect()}
    assert names == {"दिल्ली": "delhi"}
    both = {r.token: r.latin for r in learn.dictionary(learn.aligned_tokens(pairs), learn.cooccurring_tokens(pairs)).collect()}
    assert both == {"दिल्ली": "delhi", "करोल": "karol"}


def test_out_of_fold_tables_exclude_their_fold(spark):
    df = spark.createDataFrame([(0, 1, ["w"]), (0, 0, ["w"]), (1, 1, ["w"]), (1, 1, ["w"]), (1, 0, [])], "fold int, y int, miss array<string>")
    got = {r.fold: r.llr for r in learn.llr_table_oof(df, ["miss"], least=2).collect()}
    assert got[0] == pytest.approx(np.log(2.5 / 3) - np.log(0.5 / 2)) and got[1] == pytest.approx(np.log(1.5 / 2) - np.log(1.5 / 2))


def test_edits(spark):
    row = ("acme seafod", "acme seafood shop", "12 main st", "14 main ave", "12", "14", "12", "14")
    names = [f"{c}_{s}" for c in ("name_core", "addr_clean", "addr_nums", "house") for s in "ab"]
    r = learn.edits(spark.createDataFrame([row], ", ".join(f"{n} string" for n in names))).first()
    assert (r.miss, r.extra, r.e_n_exact, r.e_n_typo) == ([], ["shop"], 1, 1) and r.amiss == ["st"] and r.e_house_rel == 3


def test_tab_separated_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("S1-1", 'a "quoted" name', "x, y", "US"), ("S1-2", None, "", "India")], io.RECORD)
    io.write_tsv(df.na.fill(""), str(tmp_path / "a"))
    got = {r.entity_id: r.business_name for r in io.load_source(spark, str(tmp_path / "a")).collect()}
    assert got == {"S1-1": 'a "quoted" name', "S1-2": ""}
    io.write_meta(spark, {"threshold": 0.5}, str(tmp_path / "m"))
    assert io.read_meta(spark, str(tmp_path / "m")) == {"threshold": 0.5}


def test_lists_and_truth(spark):
    ids = spark.createDataFrame([("a",), ("b",)], "s1 string")
    lists = io.match_lists(ids, spark.createDataFrame([("a", "2"), ("a", "10"), ("a", "2")], "s1 string, cand string"))
    assert {r.source1_entity_id: r.matched_entity_ids for r in lists.collect()} == {"a": "10,2", "b": ""}
    long = io.long_truth(lists)
    assert sorted((r.s1, r.cand or "") for r in long.collect()) == [("a", "10"), ("a", "2"), ("b", "")]
    assert io.same_candidates(lists, lists) and not io.same_candidates(lists, lists.limit(1))


def test_trees_learn_and_score_out_of_fold(spark):
    rows = [(i, float(i % 10), None if i % 7 == 0 else float(i % 3), int(i % 10 > 4), i // 10 % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y int, fold int")
    out = models.out_of_fold(df, ["a", "b"], rounds=3, depth=2)
    assert models.report(out)["auc"] > 0.99 and out.count() == 200
    model = models.fit(df, ["a", "b"], rounds=2, depth=2)
    assert models.gains(model, ["a", "b"])[0][0] == "a" and models.predict(model, df, ["a", "b"], least=0.5).count() == 100


def test_pair_scorer_hook(spark):
    df = spark.createDataFrame([(1, "a", "a"), (2, "a", None)], "id long, text_a string, text_b string")
    got = {r.id: r.ce for r in models.score_texts(df, lambda: lambda a, b: np.array([float(x == y) for x, y in zip(a, b)])).collect()}
    assert got == {1: 1.0, 2: 0.0}


LOCALE = augment.Locale(
    words={"bakery": "Boulangerie", "llc": "SARL"},
    streets={"street": ("Rue", "R.")},
    regions={"Nord": ("Hauts-de-France",)},
    states={"IL": ("Illinois",)},
    legal_forms=("SARL", "SAS"),
    family_suffixes=("& Fils",),
)
PAIR = "s1 long, cand long, text_a string, text_b string, y int"


def test_rewrites_change_both_sides_alike(spark):
    rows = [(i, 2, "ACME Bakery L.L.C | 12 Old Main Street, Peoria, IL", "Acme BAKERY llc. | 12 old main STREET, PEORIA, Illinois, x", 1) for i in range(30)] + [(99, 1, None, "no bar here", 0)]
    df = spark.createDataFrame(rows, PAIR)
    got = augment.rewrite(df, LOCALE, [("Lille", "Nord"), ("L$1", "Nord")]).orderBy("s1").collect()
    assert got == augment.rewrite(df.repartition(3), LOCALE, [("Lille", "Nord"), ("L$1", "Nord")]).orderBy("s1").collect()
    forms = set()
    for r in got[:30]:
        city = "Lille" if "Lille" in r.text_a else "L$1"
        region = "Nord" if "Nord" in r.text_a else "Hauts-de-France"
        form = "Rue" if "Rue" in r.text_a else "R."
        assert r.text_a == f"ACME Boulangerie L.L.C | 12 {form} Old Main, {city}, {region}"
        assert r.text_b == f"Acme BOULANGERIE SARL | 12 {form} old main, {city}, {region}, x"
        forms.add((city, region, form))
    assert len(forms) >= 5 and (got[30].text_a, got[30].text_b) == ("", "no bar here")


def test_each_kind_of_noise(spark):
    row = (1, 2, "", "Café Dupont SARL | 12 Rue Émile, Lille, Nord", 1)
    want = {
        "marked_number": {f"Café Dupont SARL | {n} Rue Émile, Lille, Nord" for n in ("no. 12", "#12", "0012")},
        "longer_number": {f"Café Dupont SARL | 12 {n} Rue Émile, Lille, Nord" for n in ("bis", "ter")},
        "other_region": {"Café Dupont SARL | 12 Rue Émile, Lille, Hauts-de-France"},
        "other_street_form": {"Café Dupont SARL | 12 R. Émile, Lille, Nord"},
        "turned": {"Café Dupont SARL | Lille, Nord, 12 Rue Émile", "Café Dupont SARL | Nord, 12 Rue Émile, Lille"},
        "plain_address": {"Café Dupont SARL | 12 Rue Emile, Lille, Nord"},
        "capital_address": {"Café Dupont SARL | 12 RUE ÉMILE, LILLE, NORD"},
        "family_suffix": {"Café Dupont SARL & Fils | 12 Rue Émile, Lille, Nord"},
        "other_legal_form": {f"Café Dupont {x} | 12 Rue Émile, Lille, Nord" for x in ("SARL", "SAS")},
        "plain_name": {"Cafe Dupont SARL | 12 Rue Émile, Lille, Nord"},
        "capital_name": {"CAFÉ DUPONT SARL | 12 Rue Émile, Lille, Nord"},
    }
    assert set(want) == set(augment.STEPS)
    df = spark.createDataFrame([row, (3, 4, "", "No bar 12", 1), (5, 6, "", None, 0)], PAIR)
    for name, texts in want.items():
        got = {r.s1: r.text_b for r in augment.add_noise(df, LOCALE, {x: float(x == name) for x in want}).collect()}
        assert got[1] in texts and got[3] == "No bar 12" and got[5] == "", name
    false = spark.createDataFrame([(*row[:4], 0)], PAIR)
    assert augment.add_noise(false, LOCALE, {x: float(x == "family_suffix") for x in want}).first().text_b == row[3]


def test_noise_comes_as_often_as_asked(spark):
    df = spark.range(4000).select(F.col("id").alias("s1"), F.lit(0).alias("cand"), F.lit("").alias("text_a"), F.lit("ab | cd").alias("text_b"), F.lit(0).alias("y"))
    got = augment.add_noise(df, augment.Locale(), {x: 0.3 if x.startswith("capital") else 0.0 for x in augment.STEPS}).groupBy("text_b").count().collect()
    n = {r.text_b: r["count"] / 4000 for r in got}
    assert n["AB | CD"] == pytest.approx(0.09, abs=0.02) and n["ab | CD"] == pytest.approx(0.21, abs=0.03)


def test_whole_states_for_each_part(spark):
    sizes = spark.createDataFrame([("US", f"s{i}", 10 + i) for i in range(50)] + [("India", "mh", 500), ("India", "ka", 80), ("India", "kl", 60)], "country string, state string, n long")
    got = augment.split_states(sizes, 1000, 400, 90)
    total = sum(r.n for r in sizes.collect())
    n = {(r.country, r.state): r.n for r in sizes.collect()}
    for country, own in got.items():
        share = sum(v for (c, _), v in n.items() if c == country) / total
        assert not set(own["train"]) & set(own["validation"])
        for part, want, cap in (("validation", 400 * share, 400 * share * (0.6 if country == "US" else 1.5)), ("train", 1000 * share, 90)):
            sizes_of = [n[country, s] for s in own[part]]
            assert all(x <= cap for x in sizes_of) and sum(sizes_of[:-1]) < want
    pairs = spark.createDataFrame([("a", 1), ("b", 2)], "s1 string, cand long")
    records = spark.createDataFrame([("a", "France"), ("b", "US")], "entity_id string, country string")
    assert [r.s1 for r in augment.of_country(pairs, records, "France").collect()] == ["a"]


def test_samples_and_splits(spark):
    df = spark.createDataFrame([(i, "x" if i % 3 else "y") for i in range(60)], "id long, state string")
    assert augment.sample(df, 7, "id").count() == 7 and augment.sample(df, 7, "id").collect() == augment.sample(df, 7, "id").collect()
    assert {r["state"]: r["count"] for r in augment.sample_per_class(df, 5, "state", "id").groupBy("state").count().collect()} == {"x": 5, "y": 5}
    assert augment.pack_states(df.groupBy("state").agg(F.count("*").alias("n")), 1, 30) == ["y"]
    assert augment.by_states(df, ["y"]).count() == 20


def test_cities_of_regions(spark):
    df = spark.createDataFrame([("1 Rue X, Lille, Nord",)] * 3 + [("2 bis, Nord",), (None,)], "business_address string")
    assert [(r.city, r.region, r.n) for r in augment.cities_of_regions(df, ["nord"], least=2).collect()] == [("Lille", "Nord", 3)]


def test_stream_of_arriving_records(spark, tmp_path):
    from tessera.streaming import match

    s1 = spark.createDataFrame([(1, "k"), (2, "k"), (3, "z")], "id long, key string")
    spark.createDataFrame([(10, "k", 0.5), (11, "none", 0.5), (12, "z", 0.9)], "id long, key string, p double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, key string, p double").parquet(str(tmp_path / "in"))
    q = match.write_matches(match.match_stream(stream, s1), str(tmp_path / "out"), str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.s1, r.cand) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, 10), (3, 12)}


def test_context_of_a_record_with_more_candidates_than_a_short_holds(spark):
    n = 33_000
    pairs = spark.range(n).select(F.lit(1).cast("long").alias("s1"), F.col("id").alias("cand"), (1 - F.col("id") / n).alias("p"))
    pool = pairs.select(F.col("cand").alias("entity_id"), F.lit("x").alias("name_core"), F.lit("y").alias("addr_clean"), F.lit("1").alias("house"))
    same = lambda a, b: F.when(a == b, 100.0).otherwise(50.0)
    ranked = context.competition(pairs)
    out = context.clusters(context.siblings(ranked, pool, score=same), pool, score=same)
    scored = context.score_context(context.attach_scores(out, {"a": pairs.withColumnRenamed("p", "ce")}), ["ce_a"])
    last = scored.where(F.col("cand") == n - 1).first()
    assert (last.c_rank_s1, last.c_ncand_s1, last.c_n05_s1, last.cx_rank_s1, last.c_sib_house_agree) == (n, n, n // 2 + 1, n, 3)
    assert scored.where("g_size is not null").count() == 8


def test_candidates_claimed_by_more_records_than_a_short_holds(spark):
    n = 33_000
    pairs = spark.range(n).select(F.col("id").alias("s1"), F.lit(1).cast("long").alias("cand"), (1 - F.col("id") / n).alias("p"))
    out = context.score_context(context.competition(pairs).withColumn("ce_a", F.col("p")), ["ce_a"])
    last = out.where(F.col("s1") == n - 1).first()
    assert (last.c_rank_cand, last.c_nclaim, last.cx_rank_cand) == (n, n, n)


def test_block_legs_equal_ranks_over_all_similarities(spark, monkeypatch):
    rng = np.random.default_rng(3)
    words = ["ab", "abc", "bcd", "xyz", "zz", "É", "ab c"]
    rows = [(i, "x", "pq"[i % 2], " ".join(rng.choice(words, 4)) if i % 9 else " \t") for i in range(80)]
    rows += [(7, "x", "q", "xyz xyz"), (80, "x", "p", None)]
    side = spark.createDataFrame(rows, "id long, region string, part string, text string")
    pool = grams.whole(side)
    terms = blocking.idf(pool, max_df=0.6)
    w = blocking.weights(side, terms).localCheckpoint()
    v = grams.vectors(pool, grams.vocabulary(terms)).localCheckpoint()
    for size in (1 << 14, 16):  # one block, and several of either side
        monkeypatch.setattr(grams, "ROWS", size)
        for within in (("region", "part"), ("region",)):
            sims = blocking.similarities(w.where("id % 4 = 0"), w, within=within)
            for over, k, found in (("s1", 5, grams.nearest(v.where("id % 4 = 0"), v, 5, within=within)), ("cand", 3, grams.nearest(v.where("id % 4 = 0"), v, 0, 3, within=within)), ("cand", 3, grams.nearest(v.where("id % 4 = 0"), v, 5, 3, within=within))):
                plain = {tuple(r) for r in blocking.leg(sims, k, over, "x").collect()}
                assert plain and {tuple(r) for r in blocking.leg(found, k, over, "x").collect()} == plain
                if (over, within) == ("cand", ("region", "part")):
                    assert found.count() < sims.count()


def test_a_group_of_copies_sends_no_more_than_the_best_of_each_side(spark):
    rows = [(i, "x", "p", "same words" if i < 200 else f"other {i}") for i in range(1000)]
    side = spark.createDataFrame(rows, "id long, region string, part string, text string").repartition(7, "text", "id")
    v = grams.vectors(side, grams.vocabulary(blocking.idf(side, max_df=0.5))).localCheckpoint()
    copies = v.where("id < 200")
    found = grams.nearest(copies.where("id % 4 = 0"), copies, 5)
    assert sorted((r.s1, r.cand) for r in found.collect()) == [(a, b) for a in range(0, 200, 4) for b in range(5)]


def test_grams_of_many_texts_are_those_of_each(monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abc \té𝄞") for _ in range(rng.choice([0, 1, 3, 30, 90]))) for _ in range(400)] + ["", " "]
    monkeypatch.setattr(grams, "LETTERS", 300)
    got, end = {}, 0
    for begin, stop, rows, keys, tf in grams.all_grams(texts):
        assert begin == end
        end = stop
        for row, key, n in zip(rows.tolist(), keys.tolist(), tf.tolist()):
            got.setdefault(row, []).append((key, n))
    assert end == len(texts)
    assert [got.get(i, []) for i in range(len(texts))] == [list(zip(*(x.tolist() for x in grams.grams(t)))) for t in texts]
