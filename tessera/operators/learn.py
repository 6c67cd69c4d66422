"""Dictionaries learned by aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.similarity import alignment, number_relation
from tessera.functions.text import digits, is_latin, tokens

Foreign = type(lambda c: c)


def _foreign(t: Column) -> Column:
    return ~is_latin(t)


def aligned_tokens(pairs: DataFrame, foreign: Foreign = _foreign, least: int = 2) -> DataFrame:
    """token, latin, n: the most frequent partner by position in pairs of equally long names. pairs: name_a, name_b."""
    a, b = tokens(F.lower("name_a")), tokens(F.col("name_b"))
    zipped = pairs.where(F.size(a) == F.size(b)).select(F.explode(F.arrays_zip(a.alias("x"), b.alias("y"))).alias("z")).select("z.x", "z.y")
    n = zipped.where(foreign(F.col("y")) & ~foreign(F.col("x"))).groupBy("y", "x").agg(F.count("*").alias("n"))
    best = Window.partitionBy("y").orderBy(F.desc("n"), "x")
    return n.withColumn("_r", F.row_number().over(best)).where((F.col("_r") == 1) & (F.col("n") >= least)).select(F.col("y").alias("token"), F.col("x").alias("latin"), "n")


def cooccurring_tokens(pairs: DataFrame, foreign: Foreign = _foreign, least: int = 2) -> DataFrame:
    """token, latin: the partner in the address with the greatest count over the root of its frequency. pairs: addr_a, addr_b."""
    split = lambda c: F.array_distinct(F.filter(F.split(c, r"[\s,.;:()\[\]\-/#]+"), lambda t: t != ""))
    both = pairs.select(F.filter(split(F.col("addr_b")), foreign).alias("ys"), F.filter(split(F.lower("addr_a")), lambda t: ~digits(t)).alias("xs")).where(F.size("ys") > 0)
    freq = both.select(F.explode("xs").alias("x")).groupBy("x").agg(F.count("*").alias("f"))
    k = both.select(F.explode("ys").alias("y"), "xs").select("y", F.explode("xs").alias("x")).groupBy("y", "x").agg(F.count("*").alias("k")).where(F.col("k") >= least)
    best = Window.partitionBy("y").orderBy(F.desc("score"), "x")
    scored = k.join(freq, "x").withColumn("score", F.col("k") / F.sqrt("f"))
    return scored.withColumn("_r", F.row_number().over(best)).where("_r = 1").select(F.col("y").alias("token"), F.col("x").alias("latin"))


def dictionary(names: DataFrame, addresses: DataFrame) -> DataFrame:
    """token, latin: names come before addresses."""
    a, n = addresses.select("token", F.col("latin").alias("_a")), names.select("token", F.col("latin").alias("_n"))
    return n.join(a, "token", "full").select("token", F.coalesce("_n", "_a").alias("latin"))


EDITS = ["miss", "extra", "amiss", "aextra"]
EDIT_COUNTS = ["e_n_exact", "e_n_typo", "e_n_miss", "e_n_extra", "e_a_miss", "e_a_extra", "e_num_a_unrel", "e_num_b_unrel", "e_num_a_best", "e_num_b_cnt", "e_house_rel"]


def edits(pairs: DataFrame) -> DataFrame:
    """Token edits of each pair and what its numbers have to do with each other.

    pairs: name_core, addr_clean, addr_nums and house with the suffixes _a and _b, as features.attach() gives them."""
    words = lambda c: F.filter(tokens(F.col(c)), lambda t: ~digits(t))
    df = pairs.withColumn("_n", alignment(tokens(F.col("name_core_a")), tokens(F.col("name_core_b")))).withColumn("_d", alignment(words("addr_clean_a"), words("addr_clean_b")))
    na, nb = tokens(F.col("addr_nums_a")), tokens(F.col("addr_nums_b"))
    none = F.lit(5).cast("byte")
    rel = lambda xs, ys: F.transform(xs, lambda x: F.coalesce(F.array_min(F.transform(ys, lambda y: number_relation(x, y))), none))
    df = df.withColumns({"_ra": rel(na, nb), "_rb": rel(nb, na)})
    unrelated = lambda c: F.size(F.filter(c, lambda r: r == 4))
    a, b = F.col("house_a"), F.col("house_b")
    out = {
        "miss": F.col("_n.missing"), "extra": F.col("_n.extra"), "amiss": F.col("_d.missing"), "aextra": F.col("_d.extra"),
        "e_n_exact": F.col("_n.n_exact"), "e_n_typo": F.col("_n.n_typo"), "e_n_miss": F.size("_n.missing"), "e_n_extra": F.size("_n.extra"),
        "e_a_miss": F.size("_d.missing"), "e_a_extra": F.size("_d.extra"), "e_num_a_unrel": unrelated("_ra"), "e_num_b_unrel": unrelated("_rb"),
        "e_num_a_best": F.coalesce(F.array_min("_ra"), none), "e_num_b_cnt": F.size("_rb"),
        "e_house_rel": F.when((a != "") & (b != ""), number_relation(a, b)).otherwise(none),
    }
    return df.withColumns(out).drop("_n", "_d", "_ra", "_rb")


def word_counts(df: DataFrame, kinds: list[str]) -> DataFrame:
    """kind, word, fold, pos, neg: in how many pairs of either label the word is among the kind's. df: y, array columns and perhaps
    fold, without which all pairs are one fold."""
    df = df if "fold" in df.columns else df.withColumn("fold", F.lit(0))
    sets = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.array_distinct(k).alias("words")) for k in kinds))).alias("e")
    rows = df.select("fold", "y", sets).select("fold", "y", "e.kind", F.explode("e.words").alias("word"))
    return rows.groupBy("kind", "word", "fold").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))


def log_ratio(pos: Column, neg: Column, all_pos: Column, all_neg: Column) -> Column:
    return F.ln((pos + 0.5) / (all_pos + 1)) - F.ln((neg + 0.5) / (all_neg + 1))


def llr_table(df: DataFrame, kinds: list[str], least: int = 3) -> DataFrame:
    """kind, word, llr from all pairs; words in fewer pairs than `least` are unknown."""
    sizes = F.broadcast(df.agg(F.count_if(F.col("y") == 1).alias("P"), F.count_if(F.col("y") == 0).alias("N")))
    n = word_counts(df, kinds).groupBy("kind", "word").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where(F.col("pos") + F.col("neg") >= least)
    return n.crossJoin(sizes).select("kind", "word", log_ratio(F.col("pos"), F.col("neg"), F.col("P"), F.col("N")).alias("llr"))


def llr_table_oof(df: DataFrame, kinds: list[str], least: int = 3) -> DataFrame:
    """kind, word, fold, llr where a fold's table is learned from all other folds: total less own, from one count."""
    n = word_counts(df, kinds)
    folds = df.groupBy("fold").agg(F.count_if(F.col("y") == 1).alias("fp"), F.count_if(F.col("y") == 0).alias("fn"))
    total = n.groupBy("kind", "word").agg(F.sum("pos").alias("tp"), F.sum("neg").alias("tn"))
    sizes = folds.crossJoin(F.broadcast(folds.agg(F.sum("fp").alias("P"), F.sum("fn").alias("N"))))
    every = total.crossJoin(F.broadcast(sizes)).join(n, ["kind", "word", "fold"], "left").na.fill(0, ["pos", "neg"])
    out = every.withColumns({"op": F.col("tp") - F.col("pos"), "on": F.col("tn") - F.col("neg")}).where(F.col("op") + F.col("on") >= least)
    return out.select("kind", "word", "fold", log_ratio(F.col("op"), F.col("on"), F.col("P") - F.col("fp"), F.col("N") - F.col("fn")).alias("llr"))


def llr_features(df: DataFrame, table: DataFrame, kinds: list[str], keys: list[str], source: DataFrame | None = None) -> DataFrame:
    """e_llr_<kind>_sum, e_llr_<kind>_min and e_unk_<kind> of each row; a table with a fold is matched on it. source: where the rows'
    words are read, if that is less work than df."""
    by = ["kind", "word", *(["fold"] if "fold" in table.columns else [])]
    words = (df if source is None else source).select(*keys, *by[2:], F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("words")) for k in kinds))).alias("e")).select(*keys, *by[2:], "e.kind", F.explode("e.words").alias("word"))
    known = words.join(table, by, "left")
    aggs = []
    for k in kinds:
        mine = F.col("kind") == k
        value = F.when(mine, F.col("llr"))
        aggs += [F.coalesce(F.sum(value), F.lit(0.0)).alias(f"e_llr_{k}_sum"), F.coalesce(F.min(value), F.lit(0.0)).alias(f"e_llr_{k}_min"), F.count_if(mine & F.col("llr").isNull()).alias(f"e_unk_{k}")]
    out = known.groupBy(*keys).agg(*aggs)
    names = [c for c in out.columns if c not in keys]
    return df.join(out, keys, "left").na.fill(0, names)
