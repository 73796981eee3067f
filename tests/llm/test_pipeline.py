"""The pipeline against plain stages, and its contract."""

from __future__ import annotations

import pytest
from conftest import DATA

import __spark_entry__ as entry
import corpus_pipeline
from tidegauge.llm import queries, secrets_scan, toxicity
from tidegauge.llm._shared import table


def test_registered():
    q = entry.queries()
    assert set(queries.queries()) < set(q) and "pipeline" in q
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))


@pytest.fixture(scope="module")
def stages(spark):
    docs = table(spark, DATA, "documents")
    out = [docs]
    for _, f in corpus_pipeline.STAGES:
        out.append(f(spark, out[-1], DATA).cache())
    return out


def test_stages_keep_what_they_should(spark, stages):
    docs, clean, exact, near, masked, packed = ([r.asDict() for r in s.collect()] for s in stages)
    model = toxicity.train(stages[0], table(spark, DATA, "labels"))
    toxic = {r.doc_id for r in toxicity.score(stages[0], model).filter("predicted = 1").collect()}
    assert toxic and {r["doc_id"] for r in clean} == {r["doc_id"] for r in docs} - toxic

    from test_operators import normal, plain_components

    best = {}
    for r in clean:
        key = normal(r["text"])
        best[key] = min(best.get(key, (1, 0)), (-len(r["text"]), r["doc_id"]))
    assert {r["doc_id"] for r in exact} == {d for _, d in best.values()}
    small = [r for r in exact if len(r["text"]) < 2500]  # the plain version compares all pairs
    rows = [(r["doc_id"], r["text"]) for r in small]
    kept = {r["doc_id"] for r in near}
    for d, _, c in plain_components(rows):
        assert c == d or d not in kept
    assert [s.columns for s in stages[:-1]] == [stages[0].columns] * 5
    assert {r["doc_id"] for r in masked} == kept
    assert not any(secrets_scan.base_spans(r["text"]) for r in masked)
    assert {r["doc_id"] for r in packed} == kept
    assert sum(r["length"] for r in packed) == sum({r["doc_id"]: r["doc_tokens"] for r in packed}.values())


def test_run_equals_stages(spark, stages):
    got = corpus_pipeline.run(spark, DATA)
    same = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(tuple, got.select(same).collect())) == sorted(map(tuple, stages[-1].select(same).collect()))


def test_empty(spark):
    docs = table(spark, DATA, "documents").limit(0)
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, DATA)
    assert docs.count() == 0
