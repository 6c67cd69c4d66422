"""The pair features of the first stage: 40 comparisons of normalised columns, and evidence that pairs carry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.similarity import SCORERS, containment, flag, house_features, jaccard, legal_state, levenshtein_similarity, three_way, token_set
from tessera.operators.learn import EDIT_COUNTS, EDITS, edits

FIELDS = ["name_clean", "name_core", "name_sorted", "name_concat", "legal", "addr_clean", "addr_nums", "house", "street", "city", "state", "postcode"]


def attach(pairs: DataFrame, records: DataFrame, key: str, suffix: str, extra: list[str] = ()) -> DataFrame:
    """pairs with the records' fields under a suffix; absent ones are empty."""
    names = [*FIELDS, *extra]
    side = records.select(F.col("entity_id").alias(key), *(F.col(c).alias(c + suffix) for c in names))
    return pairs.join(side, key, "left").na.fill("", [c + suffix for c in FIELDS])


def pair_features(pairs: DataFrame, s1: DataFrame, pool: DataFrame, with_edits: bool = False) -> DataFrame:
    """All comparison features of (s1, cand, ...), and if wanted the token edits that the context reads; other columns stay. s1, pool:
    entity_id and normalised columns; pool: is_domain, src."""
    df = attach(attach(pairs, s1, "s1", "_a"), pool, "cand", "_b", ["is_domain", "src"])
    a, b = (lambda c: F.col(c + "_a")), (lambda c: F.col(c + "_b"))
    s = SCORERS
    score = lambda name, field: s[name](a(field), b(field))
    sets = {c: (token_set(a(c)), token_set(b(c))) for c in ("name_core", "addr_clean", "addr_nums", "legal")}
    first = lambda c: F.substring_index(c, " ", 1)
    swap = lambda x: (x[1], x[0])
    n_a, n_b = sets["name_core"]
    features = {
        "n_ratio": score("ratio", "name_core"),
        "n_partial": score("partial_ratio", "name_core"),
        "n_tsort": score("token_sort_ratio", "name_core"),
        "n_tset": score("token_set_ratio", "name_core"),
        "n_wratio": score("weighted_ratio", "name_clean"),
        "n_concat_jw": score("jaro_winkler", "name_concat"),
        "n_concat_lev": levenshtein_similarity(a("name_concat"), b("name_concat")),
        "n_concat_partial": score("partial_ratio", "name_concat"),
        "n_jacc": jaccard(n_a, n_b),
        "n_cont_ab": containment(n_a, n_b),
        "n_cont_ba": containment(n_b, n_a),
        "n_len_a": F.length(a("name_core")),
        "n_len_b": F.length(b("name_core")),
        "n_ntok_diff": F.size(n_a) - F.size(n_b),
        "n_first_eq": flag(first(a("name_core")) == first(b("name_core"))),
        "n_sorted_eq": flag(a("name_sorted") == b("name_sorted")),
        "legal_state": legal_state(*sets["legal"]),
        "a_ratio": score("ratio", "addr_clean"),
        "a_tset": score("token_set_ratio", "addr_clean"),
        "a_tsort": score("token_sort_ratio", "addr_clean"),
        "a_partial": score("partial_ratio", "addr_clean"),
        "a_jacc": jaccard(*sets["addr_clean"]),
        "a_cont_ba": containment(*swap(sets["addr_clean"])),
        "a_len_b": F.length(b("addr_clean")),
        "num_jacc": jaccard(*sets["addr_nums"]),
        "num_cont_ba": containment(*swap(sets["addr_nums"])),
        **house_features(a("house"), b("house")),
        "h_in_nums": flag((a("house") != "") & F.array_contains(sets["addr_nums"][1], a("house"))),
        "st_jw": score("jaro_winkler", "street"),
        "st_tset": score("token_set_ratio", "street"),
        "st_empty": flag((a("street") == "").cast("int") + 2 * (b("street") == "").cast("int")),
        "city_tset": score("token_set_ratio", "city"),
        "city_partial": score("partial_ratio", "city"),
        "state_state": three_way(a("state"), b("state")),
        "pin_state": three_way(a("postcode"), b("postcode")),
        "x_name_in_addr": s["partial_ratio"](b("name_core"), a("addr_clean")),
        "is_domain_b": F.coalesce(F.col("is_domain_b"), F.lit(0)).cast("byte"),
        "src": F.col("src_b"),
    }
    same = s1.groupBy("name_sorted").agg(F.count("*").cast("int").alias("n_s1_same_name"))
    df = df.join(same.withColumnRenamed("name_sorted", "name_sorted_a"), "name_sorted_a", "left").na.fill(0, ["n_s1_same_name"])
    more = [*EDITS, *EDIT_COUNTS] if with_edits else []
    df = edits(df) if with_edits else df
    return df.select(*pairs.columns, *(c.alias(k) for k, c in features.items()), "n_s1_same_name", *more)


def labelled(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """pairs with y: 1 if the pair is true."""
    t = truth.where("cand is not null").select("s1", "cand").distinct().withColumn("y", F.lit(1).cast("byte"))
    return pairs.join(t, ["s1", "cand"], "left").na.fill(0, ["y"])
