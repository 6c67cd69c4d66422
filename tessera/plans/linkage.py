"""The whole chain from tab-separated records to match lists: read, normalise, block, compare, score twice, decide, write.

A folder has, for each split (train, test), `<split>_source1.tsv` (the S1 records) and `<split>_source2.tsv`, `<split>_source3.tsv`
(the pool), and `train_matches.tsv` with the true matches of the training records."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import augment, blocking, features, learn, models, stages
from tessera.operators.context import Evidence
from tessera.session import settled
from tessera.sources import io

#: Most learned tokens that are sent to every worker; a dictionary of more is an error, not cut.
MOST_TOKENS = 1_000_000


@dataclass(frozen=True)
class Options:
    """Sizes of the parts and the trees' options by stage."""

    train: int = 900_000
    validation: int = 150_000
    train_cap: int = 200_000
    first: dict = field(default_factory=dict)
    second: dict = field(default_factory=dict)


def read(spark: SparkSession, folder: str, split: str) -> tuple[DataFrame, DataFrame]:
    """S1 and pool records of a split, as they are."""
    sources = [io.load_source(spark, f"{folder}/{split}_source{i}.tsv") for i in (1, 2, 3)]
    return sources[0], io.pool(*sources[1:])


def dictionary(s1: DataFrame, pool: DataFrame, truth: DataFrame) -> dict[str, str]:
    """Latin forms of tokens of other scripts, learned from the true pairs."""
    side = lambda df, key, end: df.select(F.col("entity_id").alias(key), F.col("business_name").alias(f"name_{end}"), F.col("business_address").alias(f"addr_{end}"))
    pairs = truth.where("cand is not null").join(side(s1, "s1", "a"), "s1").join(side(pool, "cand", "b"), "cand")
    learned = settled(learn.dictionary(learn.aligned_tokens(pairs), learn.cooccurring_tokens(pairs)))
    if (n := learned.count()) > MOST_TOKENS:
        raise ValueError(f"{n} learned tokens are more than the {MOST_TOKENS} that a worker holds")
    return {r.token: r.latin for r in learned.collect()}


def normalised(df: DataFrame, learned: dict[str, str]) -> DataFrame:
    fold = text.folder(learned)
    return settled(text.normalise_addresses(text.normalise_names(df, "business_name", fold), "business_address", "country", fold))


def train(s1: DataFrame, pool: DataFrame, truth: DataFrame, options: Options) -> stages.Trained:
    """Both stages from normalised records, on whole states; the rule is chosen on other whole states."""
    place = s1.withColumn("state", blocking.grouped_state(F.col("state")))
    sizes = settled(place.groupBy("country", "state").agg(F.count("*").alias("n")))
    split = augment.split_states(sizes, options.train, options.validation, options.train_cap)
    chosen = {}
    for part in ("train", "validation"):
        states = [(c, x) for c, own in split.items() for x in own[part]]
        inside = F.lit(False)
        for c, x in states:
            inside |= (F.col("country") == c) & (F.col("state") == x)
        chosen[part] = place.where(inside).select("entity_id")
    parts, _ = stages.candidate_parts(s1, pool, chosen)
    table = {k: settled(features.labelled(features.pair_features(v, s1, pool), truth)) for k, v in parts.items()}
    ids = chosen["validation"].select(F.col("entity_id").alias("s1"))
    own = truth.join(ids, "s1", "left_semi")
    return stages.fit(models.with_fold(table["train"], place), table["validation"], own, ids, Evidence(s1, pool), options.first, options.second)


def match(trained: stages.Trained, s1: DataFrame, pool: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs that the second stage scored (s1, cand, p, p2) and the matches (s1, cand) of all S1s."""
    pairs = features.pair_features(blocking.candidates(s1, pool), s1, pool)
    scored = settled(stages.score(trained, pairs, Evidence(s1, pool)).select("s1", "cand", "p", "p2"))
    return scored, stages.decided(trained, scored)


def run(spark: SparkSession, folder: str, out: str, options: Options | None = None) -> stages.Trained:
    """Trains on the train split and writes, for the test split, `matches` and `candidates` (lists), and the models."""
    truth = io.long_truth(io.read_tsv(spark, f"{folder}/train_matches.tsv", io.TRUTH))
    raw = {split: read(spark, folder, split) for split in ("train", "test")}
    learned = dictionary(*raw["train"], truth)
    sides = {split: [normalised(df, learned) for df in own] for split, own in raw.items()}
    trained = train(*sides["train"], truth, options or Options())
    trained.save(spark, f"{out}/models")
    scored, matches = match(trained, *sides["test"])
    ids = sides["test"][0].select(F.col("entity_id").alias("s1"))
    io.write_tsv(io.match_lists(ids, matches), f"{out}/matches")
    io.write_tsv(io.match_lists(ids, scored, "candidate_entity_ids"), f"{out}/candidates")
    return trained
