"""The pipeline over a whole small table, stage by stage against plain versions."""

import re

import pytest

import corpus_pipeline
from tessera.llm import registry
from tessera.session import reach


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    reach(spark)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        place = str(tmp_path_factory.mktemp("stages") / str(i))
        stage(spark, docs, sf).write.parquet(place)
        docs = spark.read.parquet(place)
        out.append(docs)
    return [{r.doc_id: r for r in df.collect()} if i < 5 else df.collect() for i, df in enumerate(out)]


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-dedup", "decontamination", "secret scans", "packing"]
    assert sorted(registry.queries(), key=lambda n: int(re.match(r"op(\d+)_", n)[1])) == list(registry.queries())
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in registry.queries()] == list(range(1, 11))


def test_quality_stage(stages):
    for i, r in stages[0].items():
        if len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) < 50:
            assert i not in stages[1]


def shingles(text):
    w = text.lower().split()
    return set(zip(*(w[j:] for j in range(5))))


def test_near_dedup_stage(stages):
    before, after = stages[1], stages[2]
    sets = {i: shingles(r.text) for i, r in before.items()}
    ids = sorted(before)
    similar = {(a, b): len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b])) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] & sets[b]}
    assert not [p for p, s in similar.items() if s >= 0.8 and p[0] in after and p[1] in after]
    for i in set(before) - set(after):
        assert max((s for p, s in similar.items() if i in p), default=0) >= 0.8


def test_decontamination_stage(spark, sf, stages):
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for i, r in stages[2].items():
        assert (i in stages[3]) == (not any(x in r.text for x in items))


def test_secrets_stage(stages):
    assert set(stages[3]) == set(stages[4])
    for i, r in stages[4].items():
        assert not re.search("[0-9a-f]{24}|AKIA[A-Z0-9]{16}", r.text)
        assert r.n_chars == (stages[3][i].n_chars if r.text == stages[3][i].text else len(r.text))


def test_packing_stage_and_run(spark, sf, stages):
    assert {r.doc_id for r in stages[5]} == set(stages[4])
    key = lambda rows: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in rows)
    assert key(corpus_pipeline.run(spark, sf).collect()) == key(stages[5])
