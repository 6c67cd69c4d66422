"""Both stages end to end: scores of pairs, their context, scores of pairs in context, and the rule that decides.

Each stage's table is written once to the shared folder and read from there by whatever trains on it."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import blocking, context, decide, features, learn, models
from tessera.operators.context import Evidence
from tessera.session import settled, stored
from tessera.sources import io

GRID = [round(0.30 + 0.02 * i, 2) for i in range(33)]
KEYS = ("s1", "cand", "y", "fold", "p", *learn.EDITS, *learn.EDIT_COUNTS)  # edits are context, which the first stage doesn't read


@dataclass(frozen=True)
class Trained:
    """Models of both stages, the words' tables, and the rule that the validation pairs favour."""

    first: PipelineModel
    second: PipelineModel
    columns: list[str]
    context_columns: list[str]
    tables: DataFrame
    rule: str
    threshold: float
    validation_f05: float

    def save(self, spark: SparkSession, path: str) -> None:
        self.first.write().overwrite().save(f"{path}/first")
        self.second.write().overwrite().save(f"{path}/second")
        self.tables.write.mode("overwrite").parquet(f"{path}/tables")
        meta = {"columns": self.columns, "context_columns": self.context_columns, "rule": self.rule, "threshold": self.threshold, "validation_f05": self.validation_f05}
        io.write_meta(spark, meta, f"{path}/meta")


def load(spark: SparkSession, path: str) -> Trained:
    meta = io.read_meta(spark, f"{path}/meta")
    return Trained(PipelineModel.load(f"{path}/first"), PipelineModel.load(f"{path}/second"), tables=spark.read.parquet(f"{path}/tables"), **meta)


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in KEYS]


def fit(train: DataFrame, validation: DataFrame, truth: DataFrame, ids: DataFrame, evidence: Evidence, first: dict | None = None, second: dict | None = None, least: float = 0.01) -> Trained:
    """train, validation: s1, cand, y, features; train also fold (of whole states). truth: the validation S1s' true pairs; ids: all
    of these S1s (column s1). first, second: options of the trees.

    The second stage learns from scores and word tables that never saw the row's fold, as it will meet them on new pairs."""
    first, second = first or {}, second or {}
    columns = feature_columns(train)
    train, validation = stored(train), stored(validation)
    scored = models.out_of_fold(train, columns, **first)
    one = models.fit(train, columns, **first)
    own = stored(context.build(scored, evidence, least))
    by_fold = learn.llr_table_oof(own.select("fold", "y", *learn.EDITS), learn.EDITS)
    tables = settled(learn.llr_table(own.select("fold", "y", *learn.EDITS), learn.EDITS))
    told = learn.llr_features(own, by_fold, learn.EDITS, ["s1", "cand"])
    context_columns = [*columns, "p", *context.names_of(told)]
    two = models.fit(told, context_columns, **second)
    fitted = Trained(one, two, columns, context_columns, tables, "threshold", 0.5, 0.0)
    checked = settled(score(fitted, validation, evidence, least).select("s1", "cand", F.col("p2").alias("p")))
    threshold, swept = decide.best_threshold(decide.sweep(checked, truth, ids, GRID)).first()
    expected = decide.evaluate(decide.expected_f05_select(decide.one_to_one(checked)), truth, ids).first()["f05"]
    return replace(fitted, rule=decide.choose_rule(expected, swept), threshold=threshold, validation_f05=max(expected, swept))


def score(trained: Trained, pairs: DataFrame, evidence: Evidence, least: float = 0.01) -> DataFrame:
    """The pairs that the first stage leaves, with p, their context and p2. pairs: s1, cand and features."""
    one = models.predict(trained.first, pairs, trained.columns, least=least)  # build() writes it
    told = context.build(one, replace(evidence, tables=trained.tables), least)
    return models.predict(trained.second, told, trained.context_columns, "p2")


def decided(trained: Trained, scored: DataFrame) -> DataFrame:
    """s1, cand of the matches: each candidate with one S1 at most, then the rule."""
    kept = decide.one_to_one(scored, "p2")
    if trained.rule == "expected":
        return decide.expected_f05_select(kept, "p2").select("s1", "cand")
    return kept.where(F.col("p2") >= trained.threshold).select("s1", "cand")


def candidate_parts(s1: DataFrame, pool: DataFrame, subsets: dict[str, DataFrame], truth: DataFrame | None = None, dense: DataFrame | None = None) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Candidates of each subset of S1s (column entity_id), and with a truth each subset's recall, whole and by leg.

    Competition is over all S1s; the dense leg's pairs (s1, cand, sim_dense, rk_dense) are joined where given."""
    found = blocking.candidates(s1, pool)
    found = settled(found if dense is None else blocking.united(found, dense))
    parts = {name: found.join(ids.select(F.col("entity_id").alias("s1")), "s1", "left_semi") for name, ids in subsets.items()}
    if truth is None:
        return parts, {}
    legs = [c for c in found.columns if c.startswith("sim_")]
    report = {}
    for name, ids in subsets.items():
        own = truth.join(ids.select(F.col("entity_id").alias("s1")), "s1", "left_semi")
        report[name] = decide.recall_by_leg({c: parts[name].where(F.col(c).isNotNull()) for c in legs}, own)
    return parts, report


def link(s1: DataFrame, pool: DataFrame, truth: DataFrame, train: DataFrame, validation: DataFrame, requested: DataFrame | None = None, dense: DataFrame | None = None, **options) -> tuple[Trained, DataFrame, DataFrame]:
    """From normalised records to matches: blocking, pair features, both stages, the rule. train, validation: entity_id of the S1s
    of either part; requested: the S1s to be matched, all if none are named.

    Returns the models, the pairs that the second stage scored (s1, cand, p, p2) and the matches (s1, cand)."""
    requested = s1.select("entity_id") if requested is None else requested
    parts, _ = candidate_parts(s1, pool, {"every": s1.select("entity_id")}, dense=dense)
    table = stored(features.labelled(features.pair_features(parts["every"], s1, pool, with_edits=True), truth))
    of = lambda df, ids: df.join(ids.select(F.col("entity_id").alias("s1")), "s1", "left_semi")
    evidence = Evidence(s1, pool)
    ids = validation.select(F.col("entity_id").alias("s1"))
    trained = fit(models.with_fold(of(table, train), s1), of(table, validation), of(truth, validation), ids, evidence, **options)
    scored = settled(score(trained, of(table, requested), evidence).select("s1", "cand", "p", "p2"))
    return trained, scored, decided(trained, scored)
