"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import decontamination, language_id, line_dedup, lm_scoring, packing, quality, run_index, secrets, simhash, token_counts
from tessera.session import reach

EXTRA = ["t", "fp", "a", "b", "id", "row", "h", "kinds", "spans", "host", "digest", "root", "start", "offset", "item_id", "score", "place", "rank", "key"]


@pytest.fixture(scope="module")
def hard(spark):
    reach(spark)
    # over 2 MB: beyond the size at which texts are cut into parts
    long = " ".join(f"word{i % 977} token{i % 31}." for i in range(130_000))
    same = "\n".join(f"line {i} of the same text that others have too" for i in range(20))
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "s", 0),
        (3, long, "en", "s", len(long)),
        (4, same, "en", None, 1),
        (4, same, "en", None, 1),
        (5, same, None, "s", None),
        (None, same, "en", "s", 5),
        (None, None, None, None, None),
        (6, "x" * 200_000, "en", "s", 200_000),
        (7, "\n\n \t\n", "en", "s", 5),
        (8, "Ünïcödé 😀 \u0000 " * 30, "de", "s", 3),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("clash") for c in EXTRA})


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "nothing that any of the hard texts has in it"), (None, None), (2, "")], "item_id long, text string")


def per_row(hard, items):
    return {
        "op2": simhash.near_duplicates(hard),
        "op3": token_counts.token_counts(hard),
        "op5": language_id.predict(hard, language_id.fit(hard.select("doc_id", "text", "lang").dropna())),
        "op6": lm_scoring.score(hard, lm_scoring.fit(hard, hard.where("doc_id < 5"))),
        "op7": quality.judge(hard),
        "op8": line_dedup.deduplicate(hard),
        "op9": run_index.removed(hard),
        "op10": secrets.scan(hard),
    }


def test_one_row_each(hard, items):
    n = hard.count()
    for name, df in per_row(hard, items).items():
        assert len(df.collect()) == n, name


def test_empty_tables(hard, items):
    none = hard.where("false")
    for name, df in per_row(none, items).items():
        assert df.collect() == [], name
    assert packing.pack(none).collect() == [] and decontamination.contaminated(none, items).collect() == []
    assert simhash.deduplicate(none).collect() == []


def test_all_tokens_are_packed(hard):
    out = packing.pack(hard).toPandas()
    assert out.groupby("sequence_id").length.sum().max() <= 2048
    assert (out[out.doc_id.isin([1, 2, 7])].doc_tokens == 1).all() and len(out[out.doc_id == 4]) == 2 * len(out[out.doc_id == 5])


def test_equal_texts_are_one_component_and_one_class(hard):
    got = simhash.near_duplicates(hard).collect()
    assert {r.component_id for r in got if r.fp == next(x.fp for x in got if x.doc_id == 4)} == {4}
    removed = {(r.doc_id, r.n_removed == r.n_bytes > 0) for r in run_index.removed(hard).collect()}
    assert (4, True) in removed and (5, True) in removed and (2, False) in removed


def test_each_stage_keeps_columns_and_survives(spark, hard, sf):
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, hard, sf)
        assert out.columns == hard.columns, name
        kept[name] = sorted((r.doc_id or 0) for r in out.collect())
    every = sorted((r.doc_id or 0) for r in hard.collect())
    assert kept["quality rules"] == []  # too few or repeated words, all of them
    assert kept["near-dedup"] == [1, 3, 4, 6, 8]  # null, empty and wordless texts are one group
    assert kept["decontamination"] == kept["secret scans"] == every
    assert corpus_pipeline.STAGES[-1][1](spark, hard, sf).count() > 0


def test_stages_on_an_empty_table(spark, hard, sf):
    docs = hard.where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0, name


def test_the_long_text_is_cut(hard):
    text = hard.where("doc_id = 3").first().text
    assert len(text) > 2 * (1 << 20) and len(text.encode()) > run_index.PART


def test_long_texts_count_whole(hard):
    """What operators that read a long text in parts make of it, against one look at the whole."""
    text = hard.where("doc_id = 3").first().text
    row = lambda df: df.where("doc_id = 3").first()
    words = text.split()
    assert row(quality.judge(hard)).n_words == len(words) == 260_000
    assert row(lm_scoring.score(hard, lm_scoring.fit(hard, hard.where("doc_id < 5")))).n_tokens == len(words)
    assert row(simhash.near_duplicates(hard)).fp == simhash.fingerprint(text.encode(), 3, 42)
    assert simhash.shingle_set(text.encode(), 5).size == len(set(zip(*(words[i:] for i in range(5)))))


def test_decontamination_of_hard_rows(hard, items):
    assert decontamination.contaminated(hard, items).collect() == []
    whole = hard.where("doc_id = 4").select(F.lit(9).alias("item_id"), "text").limit(1)
    assert sorted((r.doc_id or 0) for r in decontamination.contaminated(hard, whole).collect()) == [0, 4, 4, 5]


def test_ties(spark):
    """Equal lengths, scores and centroids: the same result each time, and the least or first wins."""
    import numpy as np

    window = packing.differencing(np.full(64, 100), 8)
    assert (np.bincount(window) == 8).all() and (packing.differencing(np.full(64, 100), 8) == window).all()
    counter = token_counts.Counter([("▁", -1.0), ("a", -1.0), ("aa", -2.0), ("▁a", -2.0), ("<0x61>", -9.0)])
    assert [counter.text(x) for x in ("a", "aa", "aaa")] == [1, 2, 2]  # of equal paths the one whose last piece is longer
    same = spark.createDataFrame([(i, "one and the same text", lang) for i, lang in enumerate(["fr", "de", "fr", "de"])], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language_id.predict(same, language_id.fit(same)).collect()} == {"de"}
    copies = spark.createDataFrame([(i, "words that are the same in both of these texts") for i in (7, 3, 5)], "doc_id long, text string")
    assert [r.doc_id for r in simhash.deduplicate(copies).collect()] == [3]
    assert {r.kept_doc_id for r in line_dedup.repeats(copies, run_words=5).collect()} == {3}
