"""The linkage queries over the test tables, each with its SQL where SQL can express it.

Roles: benchmark items are the reference side (s1) and documents the pool; embeddings with an id divisible by 20 are queries
against all embeddings; parts, suppliers and customers stand in for records with names and partition keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tessera.functions import similarity, text
from tessera.operators import augment, blocking, context, decide, dense, features, grams, learn, models, stages
from tessera.session import reach, settled, stored
from tessera.sources import io

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------------------------------------------ scored pairs

WORD = r"[^\p{L}\p{N}]+"


def words_of(df: DataFrame, key: str, name: str) -> DataFrame:
    """(name, tokens): the distinct tokens of each text."""
    return df.select(F.col(key).alias(name), F.array_distinct(F.filter(F.split(F.lower("text"), WORD), lambda t: t != "")).alias("tokens"))


def shared_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cand, token, n (all documents): what documents share with any item. Other tokens link nothing and aren't shuffled."""
    docs = table(spark, sf_dir, "documents")
    wanted = words_of(table(spark, sf_dir, "benchmark"), "item_id", "s1").select(F.explode("tokens").alias("token")).distinct()
    found = words_of(docs, "doc_id", "cand").select("cand", F.explode("tokens").alias("token")).join(wanted, "token", "left_semi")
    return settled(found.withColumn("n", F.lit(docs.count())))


def scored(spark: SparkSession, sf_dir: str, tokens: DataFrame | None = None) -> DataFrame:
    """s1, cand, p: the share of an item's informative tokens (in at most a twentieth of the documents) that a document has.

    Written once; the branches of a query read it."""
    pool = shared_tokens(spark, sf_dir) if tokens is None else tokens
    items = words_of(table(spark, sf_dir, "benchmark"), "item_id", "s1").select("s1", F.explode("tokens").alias("token"))
    df = pool.groupBy("token").agg(F.count("*").alias("df"), F.first("n").alias("n")).where(F.col("df") <= 0.05 * F.col("n")).select("token")
    rare = items.join(df, "token")
    size = rare.groupBy("s1").agg(F.count("*").alias("size"))
    hits = rare.join(pool, "token").groupBy("s1", "cand").agg(F.count("*").alias("hits"))
    return settled(hits.join(size, "s1").select("s1", "cand", F.round(F.col("hits") / F.col("size"), 6).alias("p")))


SCORED_SQL = r"""
pool AS (SELECT DISTINCT doc_id AS cand, unnest(string_split_regex(lower(text), '[^\p{L}\p{N}]+')) AS token FROM documents),
pool1 AS (SELECT * FROM pool WHERE token <> ''),
item AS (SELECT DISTINCT item_id AS s1, unnest(string_split_regex(lower(text), '[^\p{L}\p{N}]+')) AS token FROM benchmark),
freq AS (SELECT token FROM pool1 GROUP BY token HAVING count(*) <= 0.05 * (SELECT count(*) FROM documents)),
rare AS (SELECT i.* FROM item i JOIN freq USING (token) WHERE token <> ''),
size AS (SELECT s1, count(*) AS size FROM rare GROUP BY s1),
hits AS (SELECT s1, cand, count(*) AS hits FROM rare JOIN pool1 USING (token) GROUP BY s1, cand),
pairs AS (SELECT s1, cand, round(hits / size, 6) AS p FROM hits JOIN size USING (s1))"""


def truth_of(spark: SparkSession, sf_dir: str, tokens: DataFrame | None = None) -> DataFrame:
    """s1, cand: the item's text is part of the document's.

    Where it is, all of its tokens but the first and the last, which may be cut, are tokens of the document. So the documents of the
    rarest such token are read. An item without one is looked for in all documents; there are few, and they are a stated set."""
    pool = shared_tokens(spark, sf_dir) if tokens is None else tokens
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("s1"), F.col("text").alias("needle"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("cand"), "text")
    every = F.filter(F.split(F.lower("needle"), WORD), lambda t: t != "")
    inner = items.select("s1", F.array_distinct(F.slice(every, 2, F.greatest(F.size(every) - 2, F.lit(0)))).alias("inner"))
    often = pool.groupBy("token").agg(F.count("*").alias("df"))
    named = inner.select("s1", F.explode("inner").alias("token")).join(often, "token")
    anchor = named.groupBy("s1").agg(F.min(F.struct("df", "token")).alias("a")).select("s1", F.col("a.token").alias("token"))
    maybe = anchor.join(pool.select("cand", "token"), "token").select("s1", "cand")
    found = maybe.join(items, "s1").join(docs, "cand").where(F.contains("text", "needle"))
    short = items.join(inner.where(F.size("inner") == 0).select("s1"), "s1", "left_semi").agg(F.collect_list(F.struct("s1", "needle")).alias("items"))
    few = [(r.s1, r.needle) for r in short.first()["items"]]
    out = found.select("s1", "cand")
    for s1, needle in few:
        out = out.unionByName(docs.where(F.contains("text", F.lit(needle))).select(F.lit(s1).alias("s1"), "cand"))
    return settled(out)


TRUTH_SQL = SCORED_SQL + """,
truth AS (SELECT b.item_id AS s1, d.doc_id AS cand FROM benchmark b JOIN documents d ON contains(d.text, b.text))"""
BEST_SQL = """,
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cand ORDER BY p DESC, s1) AS r FROM pairs) WHERE r = 1)"""


def ids_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("s1"))


F05 = """CASE WHEN n_true = 0 AND n_pred = 0 THEN 1.0::DOUBLE WHEN n_true = 0 OR n_pred = 0 OR n_both = 0 THEN 0.0::DOUBLE
  ELSE 1.25::DOUBLE * n_both / (0.25::DOUBLE * n_true + n_pred) END"""


def entity_sql(pred: str) -> str:
    return f"""entity AS (SELECT b.item_id AS s1,
  (SELECT count(*) FROM {pred} x WHERE x.s1 = b.item_id) AS n_pred,
  (SELECT count(*) FROM truth x WHERE x.s1 = b.item_id) AS n_true,
  (SELECT count(*) FROM {pred} x JOIN truth t USING (s1, cand) WHERE x.s1 = b.item_id) AS n_both FROM benchmark b)"""


# ------------------------------------------------------------------------------------------------ decisions


@query(f"WITH {TRUTH_SQL}{BEST_SQL}, pred AS (SELECT s1, cand FROM best WHERE p >= 0.7), {entity_sql('pred')} SELECT round(avg({F05}), 6) AS f05, count(*) AS n_s1 FROM entity")
def link_f05_macro(spark, sf_dir):
    pairs = scored(spark, sf_dir)
    out = decide.evaluate(decide.select(pairs, 0.7), truth_of(spark, sf_dir), ids_of(spark, sf_dir))
    return out.select(F.round("f05", 6).alias("f05"), "n_s1")


@query(f"WITH {TRUTH_SQL}{BEST_SQL}, pred AS (SELECT s1, cand FROM best WHERE p >= 0.7), {entity_sql('pred')} SELECT s1, n_pred, n_true, n_both, round({F05}, 6) AS f05 FROM entity")
def entity_f05(spark, sf_dir):
    pairs = scored(spark, sf_dir)
    out = decide.entity_scores(decide.select(pairs, 0.7), truth_of(spark, sf_dir), ids_of(spark, sf_dir))
    return out.select("s1", "n_pred", "n_true", "n_both", F.round("f05", 6).alias("f05"))


@query(f"WITH {SCORED_SQL} SELECT s1, cand, p FROM pairs")
def token_containment_join(spark, sf_dir):
    return scored(spark, sf_dir)


@query(f"WITH {SCORED_SQL}{BEST_SQL} SELECT s1, cand, p FROM best")
def one_to_one(spark, sf_dir):
    return decide.one_to_one(scored(spark, sf_dir))


@query(f"WITH {SCORED_SQL}{BEST_SQL} SELECT s1, cand FROM best WHERE p >= 0.5")
def threshold_select(spark, sf_dir):
    return decide.select(scored(spark, sf_dir), 0.5)


@query(f"""WITH {SCORED_SQL}, d AS (SELECT s1, cand, p, row_number() OVER w AS k, sum(p) OVER (PARTITION BY s1 ORDER BY p DESC, cand ROWS UNBOUNDED PRECEDING) AS cs,
  sum(p) OVER (PARTITION BY s1) AS et, CASE WHEN max(p) OVER (PARTITION BY s1) >= 1 THEN 0 ELSE exp(sum(CASE WHEN p < 1 THEN ln(1 - p) END) OVER (PARTITION BY s1)) END AS p0
  FROM pairs WHERE p >= 0.05 WINDOW w AS (PARTITION BY s1 ORDER BY p DESC, cand)),
e AS (SELECT *, round(1.25 * cs / (0.25 * et + k), 9) AS ef FROM d),
b AS (SELECT *, max(ef) OVER (PARTITION BY s1) AS best FROM e),
l AS (SELECT *, min(CASE WHEN ef = best THEN k END) OVER (PARTITION BY s1) AS last FROM b)
SELECT s1, cand, p FROM l WHERE k <= last AND best > p0""")
def expected_f05_select(spark, sf_dir):
    return decide.expected_f05_select(scored(spark, sf_dir)).select("s1", "cand", "p")


GRID = [round(0.30 + 0.05 * i, 2) for i in range(14)]


@query(f"""WITH {TRUTH_SQL}{BEST_SQL}, grid AS (SELECT unnest([{', '.join(f'{x}::DOUBLE' for x in GRID)}]) AS threshold),
c AS (SELECT threshold, s1, count(*) AS n_pred, count(t.cand) AS n_both FROM best LEFT JOIN truth t USING (s1, cand) JOIN grid ON p >= threshold GROUP BY 1, 2),
nt AS (SELECT s1, count(*) AS n_true FROM truth GROUP BY s1),
e AS (SELECT g.threshold, b.item_id, coalesce(n_pred, 0) AS n_pred, coalesce(n_both, 0) AS n_both, coalesce(n_true, 0) AS n_true
  FROM grid g CROSS JOIN benchmark b LEFT JOIN c ON c.threshold = g.threshold AND c.s1 = b.item_id LEFT JOIN nt ON nt.s1 = b.item_id)
SELECT threshold, round(avg({F05}), 6) AS f05 FROM e GROUP BY threshold""")
def threshold_sweep(spark, sf_dir):
    pairs = scored(spark, sf_dir)
    out = decide.sweep(pairs, truth_of(spark, sf_dir), ids_of(spark, sf_dir), GRID)
    return out.select("threshold", F.round("f05", 6).alias("f05"))


@query(f"WITH {SCORED_SQL}{BEST_SQL} SELECT s1, cand, p FROM best ORDER BY p DESC, s1, cand LIMIT 25")
def budget_topn(spark, sf_dir):
    return decide.budget_top(scored(spark, sf_dir), 25)


# ------------------------------------------------------------------------------------------------ context

CTX_S1 = ["c_rank_s1", "c_pmax_s1", "c_gap_s1", "c_n05_s1", "c_n02_s1", "c_psum_s1", "c_ncand_s1"]
CTX_CAND = ["c_nclaim", "c_pmax_cand", "c_rank_cand", "c_pother_cand", "c_margin_cand"]


def rounded(df: DataFrame, keys: list[str], columns: list[str], digits: int = 6) -> DataFrame:
    """Counts as long, measures as double rounded to so many digits."""
    whole = {"tinyint", "smallint", "int", "bigint"}
    kinds = dict(df.dtypes)
    return df.select(*keys, *((F.col(c).cast("long") if kinds[c] in whole else F.round(F.col(c).cast("double"), digits)).alias(c) for c in columns))


@query(f"""WITH {SCORED_SQL} SELECT s1, cand, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, cand) AS c_rank_s1, round(max(p) OVER w, 6) AS c_pmax_s1,
  round(max(p) OVER w - p, 6) AS c_gap_s1, count(CASE WHEN p >= 0.5 THEN 1 END) OVER w AS c_n05_s1, count(CASE WHEN p >= 0.2 THEN 1 END) OVER w AS c_n02_s1,
  round(sum(p) OVER w, 6) AS c_psum_s1, count(*) OVER w AS c_ncand_s1 FROM pairs WINDOW w AS (PARTITION BY s1)""")
def ctx_s1_windows(spark, sf_dir):
    return rounded(context.competition(scored(spark, sf_dir)), ["s1", "cand"], CTX_S1)


@query(f"""WITH {SCORED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY cand ORDER BY p DESC, s1) AS rk FROM pairs),
s AS (SELECT *, max(CASE WHEN rk = 2 THEN p END) OVER (PARTITION BY cand) AS p2 FROM r)
SELECT s1, cand, count(*) OVER w AS c_nclaim, round(max(p) OVER w, 6) AS c_pmax_cand, rk AS c_rank_cand, round(sum(p) OVER w - p, 6) AS c_pother_cand,
  round(CASE WHEN rk = 1 THEN p - coalesce(p2, 0) ELSE p - max(p) OVER w END, 6) AS c_margin_cand FROM s WINDOW w AS (PARTITION BY cand)""")
def ctx_cand_windows(spark, sf_dir):
    return rounded(context.competition(scored(spark, sf_dir)), ["s1", "cand"], CTX_CAND)


def doc_attributes(spark, sf_dir):
    """Documents as records: language as name, source as address, length class as house."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entity_id"), F.col("lang").alias("name_core"), F.col("source").alias("addr_clean"), F.floor(F.col("n_chars") / 1000).cast("string").alias("house"))


def same_score(a, b):
    """100 for equal strings, else 50: a score that SQL can repeat."""
    return F.when(a == b, F.lit(100.0)).otherwise(F.lit(50.0))


SIB_SQL = SCORED_SQL + """,
rk AS (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, cand) AS c_rank_s1 FROM pairs),
att AS (SELECT doc_id, lang, source, CAST(CAST(floor(n_chars / 1000) AS BIGINT) AS VARCHAR) AS house FROM documents)"""


@query(f"""WITH {SIB_SQL}, j AS (SELECT a.s1, a.cand, b.p AS pd, CASE WHEN x.lang = y.lang THEN 100.0::DOUBLE ELSE 50.0::DOUBLE END AS ns,
  CASE WHEN x.source = y.source THEN 100.0::DOUBLE ELSE 50.0::DOUBLE END AS ad, x.house = y.house AS same
  FROM rk a JOIN rk b ON a.s1 = b.s1 AND a.cand <> b.cand AND b.c_rank_s1 <= 3 JOIN att x ON x.doc_id = a.cand JOIN att y ON y.doc_id = b.cand),
g AS (SELECT s1, cand, max(ns) AS c_sib_name_max, max(ad) AS c_sib_addr_max, round(avg(ns), 6) AS c_sib_name_mean, round(avg(ad), 6) AS c_sib_addr_mean,
  count(CASE WHEN same THEN 1 END) AS c_sib_house_agree, round(max(pd * (ns + ad) / 200), 6) AS c_sib_weighted FROM j GROUP BY s1, cand)
SELECT s1, cand, c_sib_name_max, c_sib_addr_max, c_sib_name_mean, c_sib_addr_mean, coalesce(c_sib_house_agree, 0) AS c_sib_house_agree, c_sib_weighted FROM pairs LEFT JOIN g USING (s1, cand)""")
def sibling_agreement(spark, sf_dir):
    ranked = context.competition(scored(spark, sf_dir))
    out = context.siblings(ranked, doc_attributes(spark, sf_dir), score=same_score)
    return rounded(out, ["s1", "cand"], ["c_sib_name_max", "c_sib_addr_max", "c_sib_name_mean", "c_sib_addr_mean", "c_sib_house_agree", "c_sib_weighted"])


@query(f"""WITH {SIB_SQL}, base AS (SELECT * FROM rk WHERE p >= 0.1 AND c_rank_s1 <= 8),
j AS (SELECT a.s1, a.cand, b.p AS pd, CASE WHEN x.lang = y.lang THEN 100.0::DOUBLE ELSE 50.0::DOUBLE END AS ns,
  CASE WHEN x.source = y.source THEN 100.0::DOUBLE ELSE 50.0::DOUBLE END AS ad, x.house = y.house AS same
  FROM base a JOIN base b ON a.s1 = b.s1 AND a.cand <> b.cand JOIN att x ON x.doc_id = a.cand JOIN att y ON y.doc_id = b.cand),
l AS (SELECT *, (ns >= 85 AND ad >= 80) OR (ns >= 75 AND same AND ad >= 60) AS link FROM j),
g AS (SELECT s1, cand, count(CASE WHEN link THEN 1 END) AS g_size, round(avg(CASE WHEN link THEN pd END), 6) AS g_pmean, round(max(CASE WHEN link THEN pd END), 6) AS g_pmax,
  round(max(CASE WHEN NOT link THEN pd END), 6) AS g_rival_pmax, max(ns) AS g_name_max, max(ad) AS g_addr_max, round(coalesce(sum(CASE WHEN link THEN pd END), 0), 6) AS g_psum FROM l GROUP BY s1, cand)
SELECT s1, cand, g_size, g_pmean, g_pmax, g_rival_pmax, g_name_max, g_addr_max, g_psum FROM pairs LEFT JOIN g USING (s1, cand)""")
def cluster_links(spark, sf_dir):
    ranked = context.competition(scored(spark, sf_dir))
    out = context.clusters(ranked, doc_attributes(spark, sf_dir), score=same_score)
    return rounded(out, ["s1", "cand"], ["g_size", "g_pmean", "g_pmax", "g_rival_pmax", "g_name_max", "g_addr_max", "g_psum"])


@query(f"""WITH {SCORED_SQL}, r AS (SELECT item_id AS s1, 'x' AS country, CAST(length(text) % 7 AS VARCHAR) AS key FROM benchmark),
q AS (SELECT doc_id AS cand, 'x' AS country, CAST(length(text) % 7 AS VARCHAR) AS key, n_chars < 500 AS no_addr FROM documents)
SELECT s1, cand, (SELECT count(*) FROM r z WHERE z.key = r.key) AS r_s1_key_n, (SELECT count(*) FROM r z WHERE z.key = q.key) AS r_s1_of_cand_key_n,
  (SELECT count(*) FROM q z WHERE z.key = q.key) AS r_pool_key_n, (SELECT count(*) FROM q z WHERE z.key = q.key AND z.no_addr) AS r_pool_key_noaddr_n,
  CAST(r.key = q.key AS BIGINT) AS r_same_key, CAST(no_addr AS BIGINT) AS r_cand_no_addr FROM pairs JOIN r USING (s1) JOIN q USING (cand)""")
def rarity_counts(spark, sf_dir):
    key = (F.char_length("text") % 7).cast("string").alias("key")
    s1 = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("entity_id"), F.lit("x").alias("country"), key)
    pool = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entity_id"), F.lit("x").alias("country"), key, (F.col("n_chars") < 500).alias("no_addr"))
    names = ["r_s1_key_n", "r_s1_of_cand_key_n", "r_pool_key_n", "r_pool_key_noaddr_n", "r_same_key", "r_cand_no_addr"]
    return rounded(context.rarity(scored(spark, sf_dir).select("s1", "cand"), s1, pool), ["s1", "cand"], names)


@query(f"""WITH {SCORED_SQL}, c AS (SELECT s1, cand, p AS ce_a, CASE WHEN cand % 2 = 0 THEN round(p * p, 6) END AS ce_b FROM pairs),
m AS (SELECT s1, cand, CASE WHEN ce_b IS NULL THEN ce_a ELSE (ce_a + ce_b) / 2 END AS cx FROM c)
SELECT s1, cand, round(cx, 7) AS cx_mean, row_number() OVER (PARTITION BY s1 ORDER BY cx DESC, cand) AS cx_rank_s1, round(max(cx) OVER (PARTITION BY s1) - cx, 7) AS cx_gap_s1,
  count(CASE WHEN cx > 0.5 THEN 1 END) OVER (PARTITION BY s1) AS cx_n05_s1, row_number() OVER (PARTITION BY cand ORDER BY cx DESC, s1) AS cx_rank_cand,
  round(max(cx) OVER (PARTITION BY cand) - cx, 7) AS cx_gap_cand FROM m""")
def score_context(spark, sf_dir):
    pairs = scored(spark, sf_dir)
    half = pairs.where("cand % 2 = 0").select("s1", "cand", F.round(F.col("p") * F.col("p"), 6).alias("ce"))
    both = context.attach_scores(pairs, {"a": pairs.withColumnRenamed("p", "ce"), "b": half})
    out = context.score_context(both, ["ce_a", "ce_b"])
    return rounded(out, ["s1", "cand"], ["cx_mean", "cx_rank_s1", "cx_gap_s1", "cx_n05_s1", "cx_rank_cand", "cx_gap_cand"], 7)


# ------------------------------------------------------------------------------------------------ blocking


def names(spark, sf_dir):
    """Documents: those with an id divisible by 20 (s1) against all (pool); id, region, part (language), whole text."""
    docs = table(spark, sf_dir, "documents")
    side = docs.select(F.col("doc_id").alias("id"), F.lit("x").alias("region"), F.coalesce("lang", F.lit("")).alias("part"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    return side.where("id % 20 = 0"), side


GRAM_SQL = r"""
pool AS (SELECT doc_id AS id, 'x' AS region, coalesce(lang, '') AS part, lower(coalesce(text, '')) AS t FROM documents),
pw AS (SELECT id, region, part, ' ' || w || ' ' AS w FROM (SELECT id, region, part, unnest(string_split_regex(t, '\s+')) AS w FROM pool) WHERE w <> ''),
pg AS (SELECT id, region, part, unnest(list_transform(range(1, greatest(length(w) - 1, 2)), lambda i: substring(w, i, 3))) AS term FROM pw),
n AS (SELECT region, count(*) AS n FROM pool GROUP BY 1),
terms AS (SELECT region, term, ln((1 + any_value(n)) / (1 + count(DISTINCT id))) + 1 AS idf FROM pg JOIN n USING (region) GROUP BY 1, 2 HAVING count(DISTINCT id) >= 2 AND count(DISTINCT id) <= 0.05 * any_value(n)),
pt AS (SELECT id, region, part, term, (1 + ln(count(*))) * any_value(idf) AS w FROM pg JOIN terms USING (region, term) GROUP BY 1, 2, 3, 4),
pv AS (SELECT id, region, part, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM pt),
sv AS (SELECT * FROM pv WHERE id % 20 = 0),
sims AS (SELECT a.id AS s1, b.id AS cand, round(sum(a.w * b.w), 6) AS sim FROM sv a JOIN pv b USING (region, part, term) GROUP BY 1, 2 HAVING round(sum(a.w * b.w), 6) > 0.05),
osims AS (SELECT a.id AS s1, b.id AS cand, round(sum(a.w * b.w), 6) AS sim FROM sv a JOIN pv b USING (region, term) WHERE b.part = 'fr' GROUP BY 1, 2 HAVING round(sum(a.w * b.w), 6) > 0.05)"""


def name_weights(spark, sf_dir):
    pool = grams.whole(names(spark, sf_dir)[1])
    every = settled(grams.vectors(pool, grams.vocabulary(blocking.idf(pool))))
    return every.where("id % 20 = 0"), every


def leg_sql(sims: str, over: str, k: int, name: str) -> str:
    other = "cand" if over == "s1" else "s1"
    return f"SELECT s1, cand, sim AS sim_{name}, r AS rk_{name} FROM (SELECT *, row_number() OVER (PARTITION BY {over} ORDER BY sim DESC, {other}) AS r FROM {sims}) WHERE r <= {k}"


def longs(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(c).cast("long").alias(c) if k in ("smallint", "int", "tinyint") else F.col(c) for c, k in df.dtypes))


@query(f"WITH {GRAM_SQL} {leg_sql('sims', 's1', 10, 'f_name')}")
def tfidf_forward(spark, sf_dir):
    return longs(blocking.leg(grams.nearest(*name_weights(spark, sf_dir), forward=10), 10, "s1", "f_name"))


@query(f"WITH {GRAM_SQL} {leg_sql('sims', 'cand', 3, 'r_name')}")
def tfidf_reverse(spark, sf_dir):
    return longs(blocking.leg(grams.nearest(*name_weights(spark, sf_dir), reverse=3), 3, "cand", "r_name"))


@query(f"WITH {GRAM_SQL} {leg_sql('osims', 'cand', 5, 'o_name')}")
def tfidf_orphan(spark, sf_dir):
    s1, pool = name_weights(spark, sf_dir)
    return longs(blocking.leg(grams.nearest(s1, pool.where("part = 'fr'"), reverse=5, within=("region",)), 5, "cand", "o_name"))


def two_legs(spark, sf_dir):
    sims = settled(grams.nearest(*name_weights(spark, sf_dir), 10, 3))
    return blocking.leg(sims, 10, "s1", "f_name"), blocking.leg(sims, 3, "cand", "r_name")


SHARD = StructType([StructField("s1", LongType()), StructField("cand", LongType()), StructField("sim_f_name", DoubleType()), StructField("sim_dense", DoubleType()), StructField("rk_dense", LongType()), StructField("sim_k_addr", DoubleType())])
TWO_LEGS_SQL = f"{GRAM_SQL}, f AS ({leg_sql('sims', 's1', 10, 'f_name')}), r AS ({leg_sql('sims', 'cand', 3, 'r_name')})"


@query(f"WITH {TWO_LEGS_SQL} SELECT s1, cand, sim_f_name, rk_f_name, sim_r_name, rk_r_name FROM f FULL JOIN r USING (s1, cand)")
def leg_merge_max(spark, sf_dir):
    return longs(blocking.merge_legs(list(two_legs(spark, sf_dir))))


@query(f"WITH {TWO_LEGS_SQL} SELECT s1, cand, sim_f_name, rk_f_name, sim_r_name, rk_r_name FROM f FULL JOIN r USING (s1, cand)")
def full_union_pairs(spark, sf_dir):
    return longs(blocking.united(*two_legs(spark, sf_dir)))


@query(f"WITH {TWO_LEGS_SQL} SELECT s1, cand FROM r WHERE s1 IN (SELECT s1 FROM f) AND (s1, cand) NOT IN (SELECT (s1, cand) FROM f)")
def anti_new_pairs(spark, sf_dir):
    f, r = two_legs(spark, sf_dir)
    return blocking.new_pairs(r, f).select("s1", "cand")


@query(f"WITH {TWO_LEGS_SQL} SELECT s1, cand FROM r WHERE (s1, cand) IN (SELECT (s1, cand) FROM f)")
def semi_known_pairs(spark, sf_dir):
    f, r = two_legs(spark, sf_dir)
    return blocking.known_pairs(r, f).select("s1", "cand")


@query(f"WITH {TWO_LEGS_SQL} SELECT f.s1, f.cand, sim_f_name, sim_r_name AS sim_dense, rk_r_name AS rk_dense, NULL::DOUBLE AS sim_k_addr FROM f LEFT JOIN r USING (s1, cand)")
def dense_join_shard(spark, sf_dir):
    f, r = two_legs(spark, sf_dir)
    return blocking.with_dense(f, r.withColumnsRenamed({"sim_r_name": "sim_dense", "rk_r_name": "rk_dense"}), SHARD)


@query(f"""WITH {TWO_LEGS_SQL}, truth AS (SELECT a.doc_id AS s1, b.doc_id AS cand FROM documents a JOIN documents b ON a.text = b.text WHERE a.doc_id % 20 = 0),
legs AS (SELECT 'f' AS leg, s1, cand FROM f UNION ALL SELECT 'r', s1, cand FROM r UNION ALL SELECT DISTINCT 'all', s1, cand FROM (SELECT s1, cand FROM f UNION ALL SELECT s1, cand FROM r)),
c AS (SELECT leg, count(*) AS n_found FROM legs JOIN truth USING (s1, cand) GROUP BY leg)
SELECT l.leg, (SELECT count(*) FROM truth) AS n_true, coalesce(n_found, 0) AS n_found, round(coalesce(n_found, 0) / nullif((SELECT count(*) FROM truth), 0), 6) AS recall
FROM (SELECT unnest(['f', 'r', 'all']) AS leg) l LEFT JOIN c USING (leg)""")
def blocking_recall_per_leg(spark, sf_dir):
    f, r = two_legs(spark, sf_dir)
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("same"))  # not the texts themselves are shuffled
    truth = d.where("doc_id % 20 = 0").select(F.col("doc_id").alias("s1"), "same").join(d.select(F.col("doc_id").alias("cand"), "same"), "same").select("s1", "cand")
    return decide.recall_by_leg({"f": f, "r": r}, truth).withColumn("recall", F.round("recall", 6))


@query("""WITH k AS (SELECT doc_id, lang, lower(trim(text)) AS key FROM documents),
first AS (SELECT lang, key, min(doc_id) AS s1 FROM k GROUP BY lang, key), rest AS (SELECT k.* FROM k ANTI JOIN first ON k.doc_id = first.s1),
few AS (SELECT lang, key FROM rest WHERE length(key) >= 12 GROUP BY lang, key HAVING count(*) <= 30)
SELECT s1, doc_id AS cand FROM first JOIN few USING (lang, key) JOIN rest USING (lang, key)""")
def exact_key_blocking(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("region"), F.lower(F.trim("text")).alias("key"))
    first = df.groupBy("region", "key").agg(F.min("id").alias("id"))
    return blocking.exact_key(first, df.join(first.select("id"), "id", "left_anti"), "text", 12).select("s1", "cand")


@query("""WITH k AS (SELECT p_partkey, p_type, array_to_string(list_sort(string_split(p_name, ' ')), ' ') || '|' || p_brand AS key FROM part),
few AS (SELECT p_type, key FROM k WHERE p_partkey % 2 = 1 GROUP BY 1, 2 HAVING count(*) <= 30)
SELECT a.p_partkey AS s1, b.p_partkey AS cand FROM k a JOIN few USING (p_type, key) JOIN k b USING (p_type, key) WHERE a.p_partkey % 2 = 0 AND b.p_partkey % 2 = 1""")
def name_partition_key(spark, sf_dir):
    key = F.concat(text.sorted_key(F.col("p_name")), F.lit("|"), F.col("p_brand"))
    df = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("region"), key.alias("key"))
    return blocking.exact_key(df.where("id % 2 = 0"), df.where("id % 2 = 1"), "namecity").select("s1", "cand")


@query("""WITH a AS (SELECT n_name AS city, CAST(n_regionkey AS VARCHAR) AS state FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT c_mktsegment, CAST(n_regionkey AS VARCHAR) FROM customer JOIN nation ON c_nationkey = n_nationkey),
g AS (SELECT city, state, count(*) AS n FROM a GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY city) AS total FROM g)
SELECT city, state FROM t WHERE n >= 0.8 * total AND n >= 3""")
def city_to_state_table(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").cast("string").alias("state"))
    a = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("city"), "state")
    b = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_mktsegment").alias("city"), "state")
    return blocking.city_states(a.unionByName(b))


@query("""WITH s AS (SELECT s_suppkey AS id, n_name AS city, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE CAST(n_regionkey AS VARCHAR) END AS state FROM supplier JOIN nation ON s_nationkey = n_nationkey),
c AS (SELECT c_custkey AS id, n_name AS city, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE CAST(n_regionkey AS VARCHAR) END AS state FROM customer JOIN nation ON c_nationkey = n_nationkey),
g AS (SELECT city, state, count(*) AS n FROM (SELECT city, state FROM s UNION ALL SELECT city, state FROM c) WHERE state <> '' GROUP BY 1, 2),
k AS (SELECT city, state FROM (SELECT *, sum(n) OVER (PARTITION BY city) AS t FROM g) WHERE n >= 0.8 * t AND n >= 3)
SELECT 's1' AS side, id, state AS part FROM s UNION ALL SELECT 'pool', id, CASE WHEN c.state <> '' THEN c.state ELSE coalesce(k.state, '?') END FROM c LEFT JOIN k USING (city)""")
def state_partition_keys(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    side = lambda t, k, n: table(spark, sf_dir, t).join(nation, F.col(n) == F.col("n_nationkey")).select(F.col(k).alias("id"), F.col("n_name").alias("city"), F.when(F.col(k) % 3 == 0, "").otherwise(F.col("n_regionkey").cast("string")).alias("state"))
    a, b = blocking.partition_keys(side("supplier", "s_suppkey", "s_nationkey"), side("customer", "c_custkey", "c_nationkey"))
    return a.select(F.lit("s1").alias("side"), "id", "part").unionByName(b.select(F.lit("pool").alias("side"), "id", "part"))


# ------------------------------------------------------------------------------------------------ dense leg


def vectors(spark, sf_dir):
    """Embeddings with ids as strings, in two countries; those with an id divisible by 20 are searched in all of their country."""
    country = F.when(F.col("vec_id") % 3 == 0, "a").otherwise("b").alias("country")
    df = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("V-"), F.col("vec_id").cast("string")).alias("id"), F.col("embedding").alias("vector"), country, "vec_id", "label")
    return df.where("vec_id % 20 = 0"), df


DENSE_SQL = """
v AS (SELECT 'V-' || vec_id AS id, vec_id, vec_id % 3 = 0 AS country, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
sims AS (SELECT a.id AS s1, b.id AS cand, round(list_cosine_similarity(a.e, b.e), 6) AS sim FROM v a JOIN v b ON a.id <> b.id AND a.country = b.country WHERE a.vec_id % 20 = 0)"""
SAME = {"country": "country", "same": True}


@query(f"WITH {DENSE_SQL} {leg_sql('sims', 's1', 20, 'dense')}")
def dense_topk_fwd(spark, sf_dir):
    out = dense.similar(*vectors(spark, sf_dir), 20, "query", **SAME)
    return out.select(F.col("query").alias("s1"), F.col("row").alias("cand"), F.col("sim").alias("sim_dense"), F.col("rank").cast("long").alias("rk_dense"))


@query(f"WITH {DENSE_SQL} {leg_sql('sims', 'cand', 3, 'dense')}")
def dense_topk_rev(spark, sf_dir):
    out = dense.similar(*vectors(spark, sf_dir), 3, "row", **SAME)
    return out.select(F.col("query").alias("s1"), F.col("row").alias("cand"), F.col("sim").alias("sim_dense"), F.col("rank").cast("long").alias("rk_dense"))


DENSE_BOTH_SQL = f"""{DENSE_SQL}, f AS ({leg_sql('sims', 's1', 20, 'x')}), r AS ({leg_sql('sims', 'cand', 3, 'x')}),
u AS (SELECT s1, cand, max(sim_x) AS sim_dense FROM (SELECT * FROM f UNION ALL SELECT * FROM r) GROUP BY 1, 2),
d AS (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY sim_dense DESC, cand) AS rk_dense FROM u)"""


@query(f"WITH {DENSE_BOTH_SQL} SELECT s1, cand, sim_dense, rk_dense FROM d")
def dense_search(spark, sf_dir):
    return longs(dense.search(*vectors(spark, sf_dir), **SAME))


def same_label(spark, sf_dir):
    """s1, cand: embeddings of one label and country."""
    queries, rows = vectors(spark, sf_dir)
    return queries.select(F.col("id").alias("s1"), "country", "label").join(rows.select(F.col("id").alias("cand"), "country", "label"), ["country", "label"]).where("s1 <> cand").select("s1", "cand")


@query(f"""WITH {DENSE_BOTH_SQL}, truth AS (SELECT 'V-' || a.vec_id AS s1, 'V-' || b.vec_id AS cand FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id AND (a.vec_id % 3 = 0) = (b.vec_id % 3 = 0) WHERE a.vec_id % 20 = 0),
base AS (SELECT s1, cand FROM truth WHERE CAST(substr(cand, 3) AS BIGINT) % 4 = 0)
SELECT CAST(k AS BIGINT) AS rank, (SELECT count(*) FROM truth) AS n_true, (SELECT count(*) FROM truth JOIN d USING (s1, cand) WHERE rk_dense <= k) AS n_found, (SELECT count(*) FROM base) AS n_base,
  (SELECT count(*) FROM truth t WHERE EXISTS (SELECT 1 FROM base b WHERE b.s1 = t.s1 AND b.cand = t.cand) OR EXISTS (SELECT 1 FROM d WHERE d.s1 = t.s1 AND d.cand = t.cand AND rk_dense <= k)) AS n_union FROM (SELECT unnest([5, 10, 20]) AS k)""")
def dense_recall(spark, sf_dir):
    truth = same_label(spark, sf_dir)
    base = truth.where(F.substring("cand", 3, 20).cast("long") % 4 == 0)
    return longs(dense.recall_by_rank(dense.search(*vectors(spark, sf_dir), **SAME), truth, [5, 10, 20], base))


# ------------------------------------------------------------------------------------------------ texts and pair features


@query()
def norm_name(spark, sf_dir):
    html = F.coalesce("html", F.lit(""))
    words = F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), r"\s+", " "))
    return text.normalise_names(table(spark, sf_dir, "pages").select("page_id", words.alias("raw")), "raw").drop("raw")


@query()
def norm_address(spark, sf_dir):
    df = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return text.normalise_addresses(df, "text").drop("text")


@query(r"""SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(regexp_replace(regexp_extract(url, '^https?://([^/]+)', 1), '^.*\.([^.]+\.[^.]+)$', '\1'), '^(?:www\.)?([a-z0-9\-]+)\.(com|in|net|org|co|io|biz|fr|us|info)\b', 1) AS domain FROM pages""")
def norm_url_domain(spark, sf_dir):
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    site = F.regexp_replace(host, r"^.*\.([^.]+\.[^.]+)$", "$1")
    return table(spark, sf_dir, "pages").select("page_id", host.alias("host"), F.regexp_extract(site, text.T.DOMAIN, 1).alias("domain"))


def sql_map(table: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in table.items()) + "}"


FORMS, FILLERS = sql_map(text.T.LEGAL_FORMS), "[" + ", ".join(f"'{w}'" for w in text.T.FILLER_WORDS) + "]"


@query(f"""WITH t AS (SELECT p_partkey, list_filter(string_split(lower('The ' || p_name || ' and ' || p_type || CASE p_size % 4 WHEN 0 THEN ' Inc.' WHEN 1 THEN ', LLC' WHEN 2 THEN ' Private Limited' ELSE '' END).replace('.', '').replace(',', ' '), ' '), lambda x: x <> '') AS t, {FORMS} AS m FROM part),
k AS (SELECT p_partkey, list_transform(t, lambda x: coalesce(m[x], x)) AS clean, list_filter(t, lambda x: m[x] IS NULL AND NOT list_contains({FILLERS}, x)) AS core, list_filter(list_transform(t, lambda x: m[x]), lambda x: x IS NOT NULL) AS legal FROM t)
SELECT p_partkey, array_to_string(clean, ' ') AS name_clean, array_to_string(core, ' ') AS name_core, array_to_string(list_sort(list_distinct(core)), ' ') AS name_sorted, array_to_string(core, '') AS name_concat, array_to_string(list_sort(list_distinct(legal)), ' ') AS legal, 0::BIGINT AS is_domain FROM k""")
def norm_name_parts(spark, sf_dir):
    ends = F.when(F.col("p_size") % 4 == 0, " Inc.").when(F.col("p_size") % 4 == 1, ", LLC").when(F.col("p_size") % 4 == 2, " Private Limited").otherwise("")
    df = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("The "), "p_name", F.lit(" and "), "p_type", ends).alias("raw"))
    return longs(text.normalise_names(df, "raw").drop("raw"))


US = sql_map(text.T.US_STATES)


@query(f"""SELECT c_custkey, c_custkey || ' main st nation ' || c_nationkey AS addr_clean, CASE WHEN c_custkey = c_nationkey THEN CAST(c_custkey AS VARCHAR) ELSE c_custkey || ' ' || c_nationkey END AS addr_nums,
  CAST(c_custkey AS VARCHAR) AS house, 'main' AS street, '' AS city, CASE c_custkey % 3 WHEN 0 THEN ({US})['texas'] WHEN 1 THEN 'il' ELSE '' END AS state, '' AS postcode FROM customer""")
def norm_address_parts(spark, sf_dir):
    state = F.when(F.col("c_custkey") % 3 == 0, ", TEXAS").when(F.col("c_custkey") % 3 == 1, ", IL").otherwise("")
    raw = F.concat(F.lit("##0"), F.col("c_custkey").cast("string"), F.lit(" Main Street, Nation-0"), F.col("c_nationkey").cast("string"), state, F.lit(", null"))
    df = table(spark, sf_dir, "customer").select("c_custkey", raw.alias("raw"), F.lit("US").alias("country"))
    return text.normalise_addresses(df, "raw", "country").drop("raw", "country")


@query("SELECT doc_id, NOT regexp_matches(text, '[^\\x{0}-\\x{24F}]') AS latin FROM documents")
def latin_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.is_latin(F.col("text")).alias("latin"))


@query("SELECT doc_id, lower(strip_accents(text)) AS folded FROM documents")
def strip_accents_fold(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.folder()(F.col("text")).alias("folded"))


@query("""WITH t AS (SELECT p_partkey, unnest(string_split(lower(p_name || ' ' || replace(p_brand, '#', '') || ' x' || p_size), ' ')) AS t, p_partkey AS k FROM part)
SELECT DISTINCT t AS token, CASE WHEN regexp_matches(t, '[0-9]') AND length(regexp_replace(t, '[^a-z]', '', 'g')) >= 2 THEN translate(t, '0134578@$', 'oleastbas') ELSE t END AS letters FROM t""")
def unleeted_tokens(spark, sf_dir):
    raw = F.lower(F.concat("p_name", F.lit(" "), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit(" x"), F.col("p_size").cast("string")))
    return table(spark, sf_dir, "part").select(F.explode(F.split(raw, " ")).alias("token")).distinct().withColumn("letters", text.unleeted(F.col("token")))


def part_pairs(spark, sf_dir):
    """Pairs of distinct part names that share a word."""
    n = table(spark, sf_dir, "part").select("p_name").distinct().select("p_name", F.explode(text.tokens(F.col("p_name"))).alias("word"))
    return n.select(F.col("p_name").alias("a"), "word").join(n.select(F.col("p_name").alias("b"), "word"), "word").select("a", "b").distinct()


PART_SQL = "WITH n AS (SELECT DISTINCT p_name FROM part), q AS (SELECT x.p_name AS a, y.p_name AS b, string_split(x.p_name, ' ') AS ta, string_split(y.p_name, ' ') AS tb FROM n x JOIN n y ON list_has_any(string_split(x.p_name, ' '), string_split(y.p_name, ' ')))"


@query(f"{PART_SQL} SELECT a, b, round(len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb))), 6) AS jaccard, round(len(list_intersect(ta, tb)) / len(list_distinct(ta)), 6) AS contained FROM q")
def token_jaccard(spark, sf_dir):
    x, y = text.tokens(F.col("a")), text.tokens(F.col("b"))
    x, y = F.array_distinct(x), F.array_distinct(y)
    return part_pairs(spark, sf_dir).select("a", "b", F.round(similarity.jaccard(x, y), 6).alias("jaccard"), F.round(similarity.containment(x, y), 6).alias("contained"))


@query(f"{PART_SQL} SELECT a, b, round(1 - levenshtein(a, b) / greatest(length(a), length(b)), 6) AS similarity FROM q")
def lev_similarity(spark, sf_dir):
    return part_pairs(spark, sf_dir).select("a", "b", F.round(similarity.levenshtein_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@query(f"{PART_SQL} SELECT a, b, round(jaro_winkler_similarity(a, b), 6) AS similarity FROM q")
def jaro_winkler(spark, sf_dir):
    return part_pairs(spark, sf_dir).select("a", "b", F.round(similarity.SCORERS["jaro_winkler"](F.col("a"), F.col("b")), 6).alias("similarity"))


@query()
def fuzz_ratio_family(spark, sf_dir):
    names = [k for k in similarity.SCORERS if k != "jaro_winkler"]
    return part_pairs(spark, sf_dir).select("a", "b", *(F.round(similarity.SCORERS[k](F.col("a"), F.col("b")), 6).alias(k) for k in names))


def order_pairs(spark, sf_dir):
    """s1, cand: suppliers and customers that have traded."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("s1"))
    return lines.join(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("cand")), "o_orderkey").select("s1", "cand").distinct()


def number_pairs(spark, sf_dir):
    return order_pairs(spark, sf_dir).select(F.col("s1").cast("string").alias("a"), F.lpad(F.col("cand").cast("string"), 4, "0").alias("b")).distinct()


TRADED_SQL = "traded AS (SELECT DISTINCT l_suppkey AS s1, o_custkey AS cand FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
NUMBER_SQL = f"WITH {TRADED_SQL}, q AS (SELECT DISTINCT CAST(s1 AS VARCHAR) AS a, CASE WHEN cand > 9999 THEN left(CAST(cand AS VARCHAR), 4) ELSE lpad(CAST(cand AS VARCHAR), 4, '0') END AS b FROM traded)"
AFFIX_SQL = "(starts_with(a, b) OR starts_with(b, a) OR ends_with(a, b) OR ends_with(b, a))"


@query(f"{NUMBER_SQL} SELECT a, b, CAST(CASE WHEN a = b THEN 0 WHEN ltrim(a, '0') = ltrim(b, '0') THEN 1 WHEN {AFFIX_SQL} THEN 2 WHEN levenshtein(a, b) <= 1 THEN 3 ELSE 4 END AS BIGINT) AS relation FROM q")
def num_relation(spark, sf_dir):
    return number_pairs(spark, sf_dir).select("a", "b", similarity.number_relation(F.col("a"), F.col("b")).cast("long").alias("relation"))


@query(f"{NUMBER_SQL} SELECT a, b, CAST(a = b AS BIGINT) AS h_eq, CAST(0 AS BIGINT) AS h_absent, CAST(a <> b AND {AFFIX_SQL} AS BIGINT) AS h_pref, CAST(abs(CAST(a AS BIGINT) - CAST(b AS BIGINT)) AS DOUBLE) AS h_diff, CAST(CASE WHEN a = b THEN 1 ELSE 2 END AS BIGINT) AS state FROM q")
def house_relation(spark, sf_dir):
    df = number_pairs(spark, sf_dir)
    f = similarity.house_features(F.col("a"), F.col("b"))
    return rounded(df.select("a", "b", *(c.alias(k) for k, c in f.items()), similarity.three_way(F.col("a"), F.col("b")).alias("state")), ["a", "b"], ["h_eq", "h_absent", "h_pref", "h_diff", "state"])


@query(f"""{PART_SQL}, l AS (SELECT a, b, list_filter(ta, lambda t: t IN ('small', 'large', 'red')) AS x, list_filter(tb, lambda t: t IN ('small', 'large', 'blue')) AS y FROM q)
SELECT a, b, CAST(CASE WHEN len(x) = 0 AND len(y) = 0 THEN 0 WHEN len(x) = 0 OR len(y) = 0 THEN 1 WHEN list_sort(x) = list_sort(y) THEN 2 WHEN list_has_any(x, y) THEN 3 ELSE 4 END AS BIGINT) AS state FROM l""")
def legal_state(spark, sf_dir):
    only = lambda c, words: F.filter(text.tokens(F.col(c)), lambda t: t.isin(words))
    return part_pairs(spark, sf_dir).select("a", "b", similarity.legal_state(only("a", ["small", "large", "red"]), only("b", ["small", "large", "blue"])).cast("long").alias("state"))


@query()
def align_tokens(spark, sf_dir):
    return part_pairs(spark, sf_dir).select("a", "b", similarity.alignment(text.tokens(F.col("a")), text.tokens(F.col("b"))).alias("x")).select("a", "b", "x.*")


# ------------------------------------------------------------------------------------------------ learned tables


def labelled_words(spark, sf_dir):
    """doc_id, y, fold and the distinct words of labelled documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(F.filter(F.split(F.lower("text"), WORD), lambda t: t != "")).alias("miss"))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"), (F.col("doc_id") % 2).cast("int").alias("fold"))
    return docs.join(labels, "doc_id")


LLR_SQL = r"""w AS (SELECT DISTINCT doc_id, quality AS y, doc_id % 2 AS fold, unnest(string_split_regex(lower(text), '[^\p{L}\p{N}]+')) AS word FROM documents JOIN labels USING (doc_id)),
k AS (SELECT fold, count(CASE WHEN quality = 1 THEN 1 END) AS fp, count(CASE WHEN quality = 0 THEN 1 END) AS fn FROM (SELECT quality, doc_id % 2 AS fold FROM labels JOIN documents USING (doc_id)) GROUP BY fold),
c AS (SELECT word, fold, count(CASE WHEN y = 1 THEN 1 END) AS pos, count(CASE WHEN y = 0 THEN 1 END) AS neg FROM w WHERE word <> '' GROUP BY 1, 2)"""


@query(f"""WITH {LLR_SQL}, t AS (SELECT word, sum(pos) AS pos, sum(neg) AS neg FROM c GROUP BY word HAVING sum(pos) + sum(neg) >= 3), z AS (SELECT sum(fp) AS P, sum(fn) AS N FROM k)
SELECT 'miss' AS kind, word, round(ln((pos + 0.5) / (P + 1)) - ln((neg + 0.5) / (N + 1)), 6) AS llr FROM t CROSS JOIN z""")
def edit_llr_table(spark, sf_dir):
    return learn.llr_table(labelled_words(spark, sf_dir), ["miss"]).withColumn("llr", F.round("llr", 6))


@query(f"""WITH {LLR_SQL}, t AS (SELECT word, sum(pos) AS tp, sum(neg) AS tn FROM c GROUP BY word), z AS (SELECT sum(fp) AS P, sum(fn) AS N FROM k),
o AS (SELECT t.word, k.fold, tp - coalesce(pos, 0) AS op, tn - coalesce(neg, 0) AS neg_o, P - fp AS pp, N - fn AS nn FROM t CROSS JOIN k CROSS JOIN z LEFT JOIN c ON c.word = t.word AND c.fold = k.fold)
SELECT 'miss' AS kind, word, CAST(fold AS BIGINT) AS fold, round(ln((op + 0.5) / (pp + 1)) - ln((neg_o + 0.5) / (nn + 1)), 6) AS llr FROM o WHERE op + neg_o >= 3""")
def llr_oof(spark, sf_dir):
    out = learn.llr_table_oof(labelled_words(spark, sf_dir), ["miss"])
    return out.select("kind", "word", F.col("fold").cast("long").alias("fold"), F.round("llr", 6).alias("llr"))


@query(f"""WITH {LLR_SQL}, t AS (SELECT word, sum(pos) AS pos, sum(neg) AS neg FROM c GROUP BY word HAVING sum(pos) + sum(neg) >= 3), z AS (SELECT sum(fp) AS P, sum(fn) AS N FROM k),
l AS (SELECT word, ln((pos + 0.5) / (P + 1)) - ln((neg + 0.5) / (N + 1)) AS llr FROM t CROSS JOIN z),
g AS (SELECT doc_id, round(coalesce(sum(llr), 0), 5) AS s, round(coalesce(min(llr), 0), 6) AS m, count(*) - count(llr) AS u FROM w LEFT JOIN l USING (word) WHERE word <> '' GROUP BY doc_id)
SELECT doc_id, coalesce(s, 0) AS e_llr_miss_sum, coalesce(m, 0) AS e_llr_miss_min, coalesce(u, 0) AS e_unk_miss FROM documents JOIN labels USING (doc_id) LEFT JOIN g USING (doc_id)""")
def llr_features(spark, sf_dir):
    df = labelled_words(spark, sf_dir)
    out = learn.llr_features(df, learn.llr_table(df, ["miss"]), ["miss"], ["doc_id"])
    return out.select("doc_id", F.round("e_llr_miss_sum", 5).alias("e_llr_miss_sum"), F.round("e_llr_miss_min", 6).alias("e_llr_miss_min"), "e_unk_miss")


def accented(t):
    return t.rlike(r"[^\x00-\x7F]")


@query(r"""WITH z AS (SELECT string_split_regex(lower(strip_accents(text)), '\s+') AS a, string_split_regex(text, '\s+') AS b FROM documents),
y AS (SELECT unnest(list_zip(list_filter(a, lambda t: t <> ''), list_filter(b, lambda t: t <> ''))) AS q FROM z WHERE len(list_filter(a, lambda t: t <> '')) = len(list_filter(b, lambda t: t <> ''))),
n AS (SELECT q[2] AS token, q[1] AS latin, count(*) AS n FROM y WHERE regexp_matches(q[2], '[^\x00-\x7F]') AND NOT regexp_matches(q[1], '[^\x00-\x7F]') GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY n DESC, latin) AS r FROM n) SELECT token, latin, n FROM r WHERE r = 1 AND n >= 2""")
def translit_dictionary(spark, sf_dir):
    fold = text.folder().asNondeterministic()  # so that it runs once on a text, however often its result is read
    pairs = table(spark, sf_dir, "documents").where(accented(F.col("text"))).select(F.col("text").alias("name_b")).select(fold(F.col("name_b")).alias("name_a"), "name_b")
    return learn.aligned_tokens(pairs, accented)


# ------------------------------------------------------------------------------------------------ lists and reports


@query(f"""WITH {SCORED_SQL}{BEST_SQL}, l AS (SELECT s1, string_agg(CAST(cand AS VARCHAR), ',' ORDER BY CAST(cand AS VARCHAR)) AS l FROM best WHERE p >= 0.5 GROUP BY s1)
SELECT item_id AS source1_entity_id, coalesce(l, '') AS matched_entity_ids FROM benchmark LEFT JOIN l ON s1 = item_id""")
def submission_lists(spark, sf_dir):
    return io.match_lists(ids_of(spark, sf_dir), decide.select(scored(spark, sf_dir), 0.5))


@query(f"""WITH {SCORED_SQL}, l AS (SELECT s1, string_agg(CAST(cand AS VARCHAR), ',' ORDER BY CAST(cand AS VARCHAR)) AS l FROM pairs WHERE p >= 0.1 GROUP BY s1)
SELECT item_id AS source1_entity_id, coalesce(l, '') AS candidate_entity_ids FROM benchmark LEFT JOIN l ON s1 = item_id""")
def candidate_lists(spark, sf_dir):
    return io.match_lists(ids_of(spark, sf_dir), scored(spark, sf_dir).where("p >= 0.1"), "candidate_entity_ids")


def two_lists(spark, sf_dir):
    pairs = scored(spark, sf_dir)
    return tuple(io.match_lists(ids_of(spark, sf_dir), decide.select(pairs, t)) for t in (0.5, 0.9))


@query(f"""WITH {SCORED_SQL}{BEST_SQL}, l AS (SELECT s1, string_agg(CAST(cand AS VARCHAR), ',' ORDER BY CAST(cand AS VARCHAR)) AS l FROM best WHERE p >= CASE WHEN s1 % 2 = 0 THEN 0.9 ELSE 0.5 END GROUP BY s1)
SELECT item_id AS source1_entity_id, coalesce(l, '') AS matched_entity_ids FROM benchmark LEFT JOIN l ON s1 = item_id""")
def hybrid_merge(spark, sf_dir):
    first, second = two_lists(spark, sf_dir)
    return io.hybrid(first, second, first.where("source1_entity_id % 2 = 0"))


@query(f"""WITH {SCORED_SQL}{BEST_SQL}, l AS (SELECT item_id, CAST(item_id % 3 AS VARCHAR) AS country, (SELECT count(*) FROM best WHERE s1 = item_id AND p >= 0.5) AS n FROM benchmark)
SELECT country, count(*) AS n_s1, round(avg(n), 3) AS mean_list, round(100 * avg(CASE WHEN n = 0 THEN 1 ELSE 0 END), 2) AS empty_percent FROM l GROUP BY country""")
def country_check(spark, sf_dir):
    countries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("source1_entity_id"), (F.col("item_id") % 3).cast("string").alias("country"))
    return io.country_report(two_lists(spark, sf_dir)[0], countries)


def wide_truth(spark, sf_dir):
    pairs = scored(spark, sf_dir)
    return io.match_lists(ids_of(spark, sf_dir), truth_of(spark, sf_dir))


@query(f"WITH {TRUTH_SQL} SELECT item_id AS s1, CAST(cand AS VARCHAR) AS cand FROM benchmark LEFT JOIN truth ON s1 = item_id")
def truth_long(spark, sf_dir):
    return io.long_truth(wide_truth(spark, sf_dir))


@query(f"WITH {TRUTH_SQL} SELECT item_id AS s1, coalesce(string_agg(CAST(cand AS VARCHAR), ',' ORDER BY CAST(cand AS VARCHAR)), '') AS cands FROM benchmark LEFT JOIN truth ON s1 = item_id GROUP BY item_id")
def truth_sets(spark, sf_dir):
    return io.truth_sets(io.long_truth(wide_truth(spark, sf_dir))).select("s1", F.array_join("cands", ",").alias("cands"))


@query(f"WITH {TRUTH_SQL} SELECT s1, cand, p, CAST(t.cand IS NOT NULL AS BIGINT) AS y FROM pairs LEFT JOIN truth t USING (s1, cand)".replace("t.cand IS NOT NULL", "EXISTS (SELECT 1 FROM truth t2 WHERE t2.s1 = pairs.s1 AND t2.cand = pairs.cand)"))
def labelled_pairs(spark, sf_dir):
    pairs = scored(spark, sf_dir)
    return longs(features.labelled(pairs, truth_of(spark, sf_dir)))


@query(f"""WITH {SCORED_SQL}, n AS (SELECT s1, cand, round(p * p, 6) AS b FROM pairs WHERE cand % 2 = 0)
SELECT s1, cand, coalesce(b, p) AS p FROM pairs LEFT JOIN n USING (s1, cand)""")
def replace_scores(spark, sf_dir):
    old = scored(spark, sf_dir)
    return decide.replace_scores(old, old.where("cand % 2 = 0").withColumn("p", F.round(F.col("p") * F.col("p"), 6)))


@query(f"""WITH {SCORED_SQL}, n AS (SELECT p AS a, round(p * p, 6) AS b FROM pairs WHERE cand % 2 = 0) SELECT count(*) AS n, round(corr(a, b), 6) AS correlation, round(avg(b - a), 6) AS shift FROM n""")
def score_shift(spark, sf_dir):
    old = scored(spark, sf_dir)
    out = decide.score_shift(old, old.where("cand % 2 = 0").withColumn("p", F.round(F.col("p") * F.col("p"), 6)))
    return out.select("n", F.round("correlation", 6).alias("correlation"), F.round("shift", 6).alias("shift"))


@query("SELECT p_type AS country FROM part GROUP BY p_type ORDER BY 1")
def countries(spark, sf_dir):
    return augment.countries(table(spark, sf_dir, "part").select(F.col("p_type").alias("country")))


@query("SELECT doc_id, CAST(2 + doc_id % 2 AS BIGINT) AS src FROM documents")
def pool_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return longs(io.pool(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")))


@query(f"WITH {SCORED_SQL} SELECT s1, cand, b.text || ' | ' AS text_a, coalesce(d.text, '') || ' | ' || coalesce(d.source, '') AS text_b FROM pairs JOIN benchmark b ON item_id = s1 JOIN documents d ON doc_id = cand WHERE p >= 0.5")
def pair_texts(spark, sf_dir):
    item = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("entity_id"), F.col("text").alias("business_name"), F.lit("").alias("business_address"))
    doc = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entity_id"), F.col("text").alias("business_name"), F.col("source").alias("business_address"))
    return io.pair_texts(scored(spark, sf_dir).where("p >= 0.5").select("s1", "cand"), item, doc)


# ------------------------------------------------------------------------------------------------ models and augmentation


STATE_OF_REGION = ["TX", "IL", "CA", "NY", "FL"]


def records(spark, sf_dir):
    """Suppliers (s1) and customers (pool) as normalised records, in the state that stands for their region."""
    nation = table(spark, sf_dir, "nation")
    states = F.array(*(F.lit(x) for x in STATE_OF_REGION))
    out = []
    for t, k, n, c, src in (("supplier", "s_suppkey", "s_name", "s_nationkey", 1), ("customer", "c_custkey", "c_name", "c_nationkey", 2)):
        df = table(spark, sf_dir, t).repartition(k).join(nation, F.col(c) == F.col("n_nationkey"))
        address = F.concat(F.col(k).cast("string"), F.lit(" Main St, "), "n_name", F.lit(", "), F.get(states, F.col("n_regionkey").cast("int")))
        df = df.select(F.col(k).alias("entity_id"), F.regexp_replace(n, "#", " ").alias("business_name"), address.alias("business_address"), F.lit("US").alias("country"), F.lit(src).cast("byte").alias("src"))
        out.append(settled(text.normalise_addresses(text.normalise_names(df, "business_name"), "business_address", "country")))
    return out


def same_number(s1, pool):
    """s1, cand: the true pairs, a supplier and the customer of the same number and state."""
    a, b = s1.select(F.col("entity_id").alias("s1"), "state"), pool.select(F.col("entity_id").alias("cand"), F.col("state").alias("_state"))
    return a.join(b, (F.col("s1") == F.col("cand")) & (F.col("state") == F.col("_state"))).select("s1", "cand")


def stage1_pairs(spark, sf_dir, s1, pool):
    return settled(features.labelled(features.pair_features(blocking.candidates(s1, pool), s1, pool), same_number(s1, pool)))


@query()
def candidate_legs(spark, sf_dir):
    return blocking.candidates(*records(spark, sf_dir))


@query()
def pair_features(spark, sf_dir):
    return stage1_pairs(spark, sf_dir, *records(spark, sf_dir))


RECORD_SQL = f"""{TRADED_SQL},
place AS (SELECT n_nationkey, n_nationkey AS num, (['tx', 'il', 'ca', 'ny', 'fl'])[n_regionkey + 1] AS state FROM nation),
s AS (SELECT s_suppkey AS k, lower(replace(s_name, '#', ' ')) AS name, num, state FROM supplier JOIN place ON s_nationkey = n_nationkey),
c AS (SELECT c_custkey AS k, lower(replace(c_name, '#', ' ')) AS name, num, state FROM customer JOIN place ON c_nationkey = n_nationkey),
q AS (SELECT s1, cand, a.name AS na, b.name AS nb, string_split(a.name, ' ') AS nta, string_split(b.name, ' ') AS ntb, a.k || ' main st nation ' || a.num AS aa, b.k || ' main st nation ' || b.num AS ab,
  list_distinct([CAST(a.k AS VARCHAR), CAST(a.num AS VARCHAR)]) AS ua, list_distinct([CAST(b.k AS VARCHAR), CAST(b.num AS VARCHAR)]) AS ub, a.state AS sa, b.state AS sb, replace(a.name, ' ', '') AS ca, replace(b.name, ' ', '') AS cb
  FROM traded JOIN s a ON a.k = s1 JOIN c b ON b.k = cand)"""
SET_FEATURES = ["n_concat_jw", "n_concat_lev", "n_jacc", "n_cont_ab", "n_cont_ba", "n_len_a", "n_len_b", "n_ntok_diff", "n_first_eq", "n_sorted_eq", "legal_state", "a_jacc", "a_cont_ba", "a_len_b", "num_jacc", "num_cont_ba", "h_eq", "h_absent", "h_pref", "h_diff", "h_in_nums", "st_jw", "st_empty", "state_state", "pin_state", "is_domain_b", "src", "n_s1_same_name"]


def shares(name: str, x: str, y: str, kinds: str) -> str:
    both, every = f"len(list_intersect({x}, {y}))", f"len(list_distinct(list_concat({x}, {y})))"
    parts = {"jacc": f"{both} / {every}", "cont_ab": f"{both} / len(list_distinct({x}))", "cont_ba": f"{both} / len(list_distinct({y}))"}
    return ", ".join(f"round({parts[k]}, 6) AS {name}_{k}" for k in kinds.split())


@query(f"""WITH {RECORD_SQL}
SELECT s1, cand, round(jaro_winkler_similarity(ca, cb), 6) AS n_concat_jw, round(1 - levenshtein(ca, cb) / greatest(length(ca), length(cb)), 6) AS n_concat_lev, {shares('n', 'nta', 'ntb', 'jacc cont_ab cont_ba')},
  length(na) AS n_len_a, length(nb) AS n_len_b, 0::BIGINT AS n_ntok_diff, 0::BIGINT AS n_first_eq, 0::BIGINT AS n_sorted_eq, 0::BIGINT AS legal_state,
  {shares('a', "string_split(aa, ' ')", "string_split(ab, ' ')", 'jacc cont_ba')}, length(ab) AS a_len_b, {shares('num', 'ua', 'ub', 'jacc cont_ba')},
  CAST(s1 = cand AS BIGINT) AS h_eq, 0::BIGINT AS h_absent, CAST(s1 <> cand AND (starts_with(CAST(s1 AS VARCHAR), CAST(cand AS VARCHAR)) OR starts_with(CAST(cand AS VARCHAR), CAST(s1 AS VARCHAR)) OR ends_with(CAST(s1 AS VARCHAR), CAST(cand AS VARCHAR)) OR ends_with(CAST(cand AS VARCHAR), CAST(s1 AS VARCHAR))) AS BIGINT) AS h_pref,
  CAST(abs(s1 - cand) AS DOUBLE) AS h_diff, CAST(list_contains(ub, CAST(s1 AS VARCHAR)) AS BIGINT) AS h_in_nums, 1.0::DOUBLE AS st_jw, 0::BIGINT AS st_empty, CAST(CASE WHEN sa = sb THEN 1 ELSE 2 END AS BIGINT) AS state_state, 0::BIGINT AS pin_state, 0::BIGINT AS is_domain_b, 2::BIGINT AS src, 1::BIGINT AS n_s1_same_name FROM q""")
def pair_set_features(spark, sf_dir):
    s1, pool = records(spark, sf_dir)
    return rounded(features.pair_features(order_pairs(spark, sf_dir), s1, pool), ["s1", "cand"], SET_FEATURES)


@query(f"""WITH {RECORD_SQL}, e AS (SELECT *, list_filter(nta, lambda x: NOT list_contains(ntb, x)) AS m, list_filter(ntb, lambda x: NOT list_contains(nta, x)) AS x FROM q)
SELECT s1, cand, len(nta) - len(m) AS e_same, len(m) AS e_less, len(x) AS e_more, CAST(CASE WHEN s1 = cand THEN 0 WHEN starts_with(CAST(s1 AS VARCHAR), CAST(cand AS VARCHAR)) OR starts_with(CAST(cand AS VARCHAR), CAST(s1 AS VARCHAR)) OR ends_with(CAST(s1 AS VARCHAR), CAST(cand AS VARCHAR)) OR ends_with(CAST(cand AS VARCHAR), CAST(s1 AS VARCHAR)) THEN 2
  WHEN levenshtein(CAST(s1 AS VARCHAR), CAST(cand AS VARCHAR)) <= 1 THEN 3 ELSE 4 END AS BIGINT) AS e_house_rel, len(ub) AS e_num_b_cnt FROM e""")
def edit_counts(spark, sf_dir):
    """The token edits' totals: a token of one side is matched (equal or a typo), or missing; equal ones and typos share a count's rest."""
    s1, pool = records(spark, sf_dir)
    pairs = features.attach(features.attach(order_pairs(spark, sf_dir), s1, "s1", "_a"), pool, "cand", "_b")
    out = learn.edits(pairs).withColumns({"e_same": F.col("e_n_exact"), "e_less": F.col("e_n_miss") + F.col("e_n_typo"), "e_more": F.col("e_n_extra") + F.col("e_n_typo")})
    return rounded(out, ["s1", "cand"], ["e_same", "e_less", "e_more", "e_house_rel", "e_num_b_cnt"])


@query()
def edit_features(spark, sf_dir):
    s1, pool = records(spark, sf_dir)
    pairs = features.attach(features.attach(blocking.candidates(s1, pool).select("s1", "cand"), s1, "s1", "_a"), pool, "cand", "_b")
    return learn.edits(pairs).select("s1", "cand", *learn.EDITS, *learn.EDIT_COUNTS)


TREES = {"rounds": 10, "depth": 4}


@query()
def stage1_gbt(spark, sf_dir):
    s1, pool = records(spark, sf_dir)
    df = settled(models.with_fold(stage1_pairs(spark, sf_dir, s1, pool), s1))
    return models.out_of_fold(df, stages.feature_columns(df), **TREES).where("p >= 0.01").select("s1", "cand", "p", "y")


def linked_records(spark, sf_dir):
    s1, pool = records(spark, sf_dir)
    part = F.pmod(F.xxhash64("entity_id"), F.lit(4))
    return stages.link(s1, pool, same_number(s1, pool), s1.where(part != 0), s1.where(part == 0), first=TREES, second=TREES)


@query()
def stage2_gbt(spark, sf_dir):
    """Scores of both stages for all suppliers: fitted on three quarters of them, the rule chosen on the rest."""
    return linked_records(spark, sf_dir)[1]


@query()
def linked_pairs(spark, sf_dir):
    """The matches that the whole chain decides on, from raw records on."""
    return linked_records(spark, sf_dir)[2]


@query()
def context_table(spark, sf_dir):
    """All context of scored pairs: records as evidence, word tables learned from their own labels, and an attached score."""
    s1, pool = records(spark, sf_dir)
    pairs = features.labelled(features.pair_features(blocking.candidates(s1, pool), s1, pool, with_edits=True), same_number(s1, pool))
    pairs = stored(pairs.select("s1", "cand", "y", F.round(F.col("n_jacc") / 2 + F.col("a_jacc") / 2, 6).alias("p"), *learn.EDITS, *learn.EDIT_COUNTS))
    tables = settled(learn.llr_table(pairs.where("p >= 0.01"), learn.EDITS))
    return context.build(pairs, context.Evidence(s1, pool, tables, scores={"a": pairs.select("s1", "cand", F.col("p").alias("ce"))})).drop(*learn.EDITS)


#: A few forms of another country for the rewriting query; a real table is the caller's.
ABROAD = augment.Locale(
    words={"the": "Le", "of": "de", "with": "avec", "market": "Marché", "bank": "Banque", "garden": "Jardin"},
    streets={"street": ("Rue", "R."), "road": ("Route", "Rte")},
    regions={"Nord": ("Hauts-de-France",), "Gironde": ("Nouvelle-Aquitaine",)},
    states={"IL": ("Illinois",), "TX": ("Texas",)},
    legal_forms=("SARL", "SAS"),
    family_suffixes=("& Fils", "Frères"),
)


@query()
def augment_pairs(spark, sf_dir):
    pairs = pair_texts(spark, sf_dir).withColumn("y", F.lit(1))
    return augment.add_noise(augment.rewrite(pairs, ABROAD, [("Lille", "Nord"), ("Bordeaux", "Gironde")]), ABROAD).select("s1", "cand", "text_a", "text_b")


@query()
def embed_texts(spark, sf_dir):
    return dense.embed(table(spark, sf_dir, "benchmark"), "text").select("item_id", "vector")


@query(f"""WITH {DENSE_BOTH_SQL}, truth AS (SELECT 'V-' || a.vec_id AS s1, 'V-' || b.vec_id AS cand FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id AND (a.vec_id % 3 = 0) = (b.vec_id % 3 = 0) WHERE a.vec_id % 20 = 0),
both_ways AS (SELECT s1, cand FROM d WHERE rk_dense <= 8 UNION SELECT s1, cand FROM truth) SELECT s1, cand, CAST(EXISTS (SELECT 1 FROM truth t WHERE t.s1 = b.s1 AND t.cand = b.cand) AS BIGINT) AS y FROM both_ways b""")
def encoder_training_pairs(spark, sf_dir):
    return longs(models.encoder_pairs(dense.search(*vectors(spark, sf_dir), **SAME), same_label(spark, sf_dir)).drop("held_out"))


def queries() -> dict[str, Query]:
    return {k: (lambda spark, sf_dir, f=f: f(reach(spark), sf_dir)) for k, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
