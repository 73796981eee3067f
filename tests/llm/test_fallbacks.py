"""The shuffled joins that replace broadcasts beyond their bounds give the same."""

from __future__ import annotations

import pytest
from test_keep import plain_kept_equal, plain_kept_near, rows_of
from test_operators import ROWS, plain_components, table
from test_operators import docs as docs  # noqa: F401  the fixture

from tidegauge.llm import components, lsm_dedup, neardup, substring, warc


@pytest.fixture
def unbounded(monkeypatch):
    for module in (components, neardup, substring, warc, lsm_dedup):
        monkeypatch.setattr(module, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(components, "TASK_EDGES", 0)


def test_near_duplicates(docs, unbounded):  # noqa: F811
    got = neardup.near_duplicates(docs)
    assert table(got.select("doc_id", "n_shingles", "component_id")) == plain_components(ROWS)


def test_small_cells(docs, monkeypatch):  # noqa: F811
    """Blocks of one set: every pair of nodes still meets."""
    monkeypatch.setattr(neardup, "CELL_SETS", 1)
    got = neardup.near_duplicates(docs)
    assert table(got.select("doc_id", "n_shingles", "component_id")) == plain_components(ROWS)


def test_passages(docs, unbounded):  # noqa: F811
    pairs = {(r.doc_id, r.other_id) for r in substring.repeated_passages(docs).collect()}
    assert {(9, 8), (2, 1)} <= pairs and {d for p in pairs for d in p} == {1, 2, 3, 7, 8, 9}


def test_archives(spark, unbounded):
    pages = spark.createDataFrame([(3, "u", "x"), (1, "u", "x"), (2, "u", None), (4, "v", "y")], "page_id long, url string, html string")
    got = {(r.page_id, r.record_type, r.refers_to) for r in warc.read_archives(warc.write_archives(pages)).collect()}
    assert got == {(3, "revisit", 1), (1, "response", None), (2, "response", None), (4, "response", None)}


def test_kept_rows(docs, unbounded):  # noqa: F811
    assert rows_of(lsm_dedup.keep_one(docs)) == plain_kept_equal(ROWS)
    assert rows_of(neardup.keep_one(docs)) == plain_kept_near(ROWS)
