"""Candidate pairs from several legs: similarity of character n-grams both ways, exact keys, and their union.

A side is a DataFrame with an id, a text and a partition key; a country or state is a column, never a loop. The work of a leg is the
sum of the products of both sides' document frequencies within a partition; frequent terms are dropped before. `weights` and
`similarities` state what a leg ranks, as rows; the legs themselves come from blocks of both sides (grams.py), which keep the best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.tables import STATE_GROUPS
from tessera.functions.text import lookup
from tessera.operators import grams
from tessera.session import settled


def view(name: str) -> Column:
    """Text of a blocking view over the normalised columns."""
    if name == "name":
        return F.col("name_core")
    if name == "addr":
        return F.col("addr_clean")
    return F.concat_ws(" ", "name_core", "house", "street", "city")


def word_grams(text: Column, n: int = 3) -> Column:
    """n-grams of each word with a space on either side, repeats kept; a shorter padded word is one gram."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    grams = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(n)))
    return F.flatten(F.transform(padded, grams))


def idf(pool: DataFrame, n: int = 3, min_df: int = 2, max_df: float = 0.05, by: str = "region") -> DataFrame:
    """region, term, idf of the terms that are neither rare nor frequent within a region. pool: id, region, text."""
    size = pool.groupBy(by).agg(F.count("*").alias("n"))
    each = lambda: F.explode(F.array_distinct(word_grams(F.col("text"), n))).alias("term")
    df = grams.document_counts(pool, by) if n == 3 else pool.select(by, each()).groupBy(by, "term").agg(F.count("*").alias("df"))
    kept = df.join(F.broadcast(size), by).where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n")))
    return kept.select(by, "term", (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def weights(side: DataFrame, terms: DataFrame, n: int = 3, by: str = "region") -> DataFrame:
    """id, region, part, term and weight: (1 + ln tf) * idf, unit length per id."""
    tf = side.select("id", by, "part", F.explode(word_grams(F.col("text"), n)).alias("term")).groupBy("id", by, "part", "term").agg(F.count("*").alias("tf"))
    w = tf.join(terms, [by, "term"]).withColumn("w", (1 + F.ln("tf")) * F.col("idf"))
    return w.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))).select("id", by, "part", "term", "w")


def similarities(s1: DataFrame, pool: DataFrame, least: float = 0.05, within: tuple[str, ...] = ("region", "part"), digits: int = 6) -> DataFrame:
    """s1, cand, sim of all pairs of a partition above the least similarity: computed once, ranked both ways."""
    a = s1.select(F.col("id").alias("s1"), *within, "term", F.col("w").alias("wa"))
    b = pool.select(F.col("id").alias("cand"), *within, "term", F.col("w").alias("wb"))
    sims = a.join(b, [*within, "term"]).groupBy("s1", "cand").agg(F.sum(F.col("wa") * F.col("wb")).alias("sim"))
    return sims.withColumn("sim", F.round("sim", digits)).where(F.col("sim") > least)


def leg(sims: DataFrame, k: int, over: str, name: str) -> DataFrame:
    """The k best of each row of a side, with sim_<name> and rk_<name>. over: s1 (forward) or cand (reverse, orphan)."""
    other = "cand" if over == "s1" else "s1"
    rank = F.row_number().over(Window.partitionBy(over).orderBy(F.desc("sim"), other))
    return sims.withColumn("_r", rank).where(F.col("_r") <= k).select("s1", "cand", F.col("sim").alias(f"sim_{name}"), F.col("_r").cast("short").alias(f"rk_{name}"))


def exact_key(s1: DataFrame, pool: DataFrame, name: str, least_length: int = 0, most: int = 30) -> DataFrame:
    """Pairs with equal keys; keys that more than `most` pool rows share are no evidence. s1, pool: id, region, key."""
    long = F.length("key") >= max(1, least_length)
    counted = pool.where(long).select(F.col("id").alias("cand"), "region", "key")
    few = counted.groupBy("region", "key").agg(F.count("*").alias("n")).where(F.col("n") <= most).select("region", "key")
    return s1.where(long).select(F.col("id").alias("s1"), "region", "key").join(few, ["region", "key"]).join(counted, ["region", "key"]).select("s1", "cand", F.lit(1.0).alias(f"sim_k_{name}"))


def merge_legs(legs: list[DataFrame]) -> DataFrame:
    """One row for each pair with the maximum of every column; null where a leg didn't find the pair."""
    out = legs[0]
    for df in legs[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out.groupBy("s1", "cand").agg(*(F.max(c).alias(c) for c in out.columns if c not in ("s1", "cand")))


def city_states(places: DataFrame, share: float = 0.8, least: int = 3) -> DataFrame:
    """city, state of the cities that lie in one state in nearly all records. places: city, state."""
    n = places.where("city <> '' and state <> ''").groupBy("city", "state").agg(F.count("*").alias("n"))
    whole = F.sum("n").over(Window.partitionBy("city"))
    return n.withColumn("total", whole).where((F.col("n") >= share * F.col("total")) & (F.col("n") >= least)).select("city", "state")


def grouped_state(state: Column) -> Column:
    return F.coalesce(lookup(STATE_GROUPS, state), state)


def partition_keys(s1: DataFrame, pool: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with `part`: the grouped state; pool rows without one take their city's, else "?". Columns: city, state."""
    known = city_states(s1.select("city", grouped_state(F.col("state")).alias("state")).unionByName(pool.select("city", grouped_state(F.col("state")).alias("state"))))
    own = grouped_state(F.col("state"))
    filled = pool.join(known.select("city", F.col("state").alias("_city_state")), "city", "left")
    part = F.when(F.col("state") != "", own).otherwise(F.coalesce("_city_state", F.lit("?")))
    return s1.withColumn("part", own), filled.withColumn("part", part).drop("_city_state")


def candidates(s1: DataFrame, pool: DataFrame, requested: DataFrame | None = None, forward: dict[str, int] | None = None, reverse: dict[str, int] | None = None, orphan: int = 5) -> DataFrame:
    """All legs of all views, merged. s1, pool: entity_id, country, and the normalised columns.

    Ranks count all S1 rows; requested (entity_id) then keeps some of them."""
    forward = forward or {"name": 10, "addr": 15, "name_addr": 20}
    reverse = reverse or {"name": 3, "addr": 3, "name_addr": 5}
    s1, pool = (settled(x.select("entity_id", "country", "part", "name_core", "name_sorted", "addr_clean", "house", "street", "city")) for x in partition_keys(s1, pool))
    legs = []
    for name, k in forward.items():
        a, b = (x.select(F.col("entity_id").alias("id"), F.col("country").alias("region"), "part", view(name).alias("text")) for x in (s1, pool))
        b = grams.whole(b)
        known = grams.vocabulary(idf(b))
        wa, wb = settled(grams.vectors(grams.whole(a), known)), settled(grams.vectors(b, known))
        sims = settled(grams.nearest(wa, wb, k, reverse[name]))
        legs += [leg(sims, k, "s1", f"f_{name}"), leg(sims, reverse[name], "cand", f"r_{name}")]
        if name == "name":
            legs.append(leg(grams.nearest(wa, wb.where("part = '?'"), reverse=orphan, within=("region",)), orphan, "cand", "o_name"))
    keys = {"addr": (F.col("addr_clean"), 12), "namecity": (F.when(F.col("city") != "", F.concat("name_sorted", F.lit("|"), "city")).otherwise(""), 0)}
    for name, (key, length) in keys.items():
        a, b = (x.select(F.col("entity_id").alias("id"), F.col("country").alias("region"), key.alias("key")) for x in (s1, pool))
        legs.append(exact_key(a, b, name, length))
    out = merge_legs(legs)
    return out if requested is None else out.join(requested.select(F.col("entity_id").alias("s1")), "s1", "left_semi")


def new_pairs(found: DataFrame, base: DataFrame) -> DataFrame:
    """Pairs of S1 rows that base has, which base itself hasn't."""
    return found.join(base.select("s1").distinct(), "s1", "left_semi").join(base.select("s1", "cand"), ["s1", "cand"], "left_anti")


def known_pairs(found: DataFrame, base: DataFrame) -> DataFrame:
    return found.join(base.select("s1", "cand"), ["s1", "cand"], "left_semi")


def united(base: DataFrame, found: DataFrame) -> DataFrame:
    """Full outer join on the pair."""
    return base.join(found, ["s1", "cand"], "full")


def with_dense(shard: DataFrame, dense: DataFrame, schema) -> DataFrame:
    """A shard with the dense leg's columns, cast to a common schema; columns that it lacks are null."""
    joined = shard.join(dense, ["s1", "cand"], "left")
    return joined.select(*(F.col(f.name).cast(f.dataType) if f.name in joined.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))
