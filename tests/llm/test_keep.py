"""One row of each group, where ids repeat, clash or are missing."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from test_operators import BASE, EDITED, ROWS, normal, plain_components, plain_sets, prose, table
from test_operators import docs as docs  # noqa: F401  the fixture

from tidegauge.llm import lsm_dedup, neardup

A, B, C = prose(31, 60), prose(32, 60), prose(33, 60)
SEVERAL = {
    "clash": [(1, A), (2, A), (2, B), (3, C), (3, C)],
    "near clash": [(1, A), (2, A + " x"), (2, B), (3, B + " y")],
    "no ids": [(None, A), (None, A), (None, A + " x"), (None, B), (None, None), (None, "")],
    "one id": [(7, A), (7, A + " x"), (7, A.replace(" ", "  ")), (7, B), (7, C + " y"), (7, C)],
    "spaces": [(4, A.replace(" ", "\t")), (4, A), (4, A.replace(" ", "\n")), (2, A + "\n"), (9, " " + A)],
    "empty": [(1, ""), (1, ""), (2, None), (3, " \n")],
    "linked by a row without id": [(1, BASE), (None, EDITED), (2, " ".join("other" if i in (20, 80, 220) else w for i, w in enumerate(EDITED.split())))],
}


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def best(rows):
    """The longest text, then the largest, of rows that are kept alike."""
    return max(rows, key=lambda r: (len(r[1] or ""), r[1] or ""))


def plain_kept_equal(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[normal(t)].append((d, t))
    out = []
    for g in groups.values():
        top = min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        out.append(best([r for r in g if r[0] == top[0]]))
    return sorted(out, key=repr)


def groups_near(rows):
    """Rows by component, found by comparing all pairs; the empty set is alone."""
    sets = [s for _, s in plain_sets(rows)]
    at = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                old, new = at[i], at[j]
                at = [new if x == old else x for x in at]
    out = defaultdict(list)
    for i, r in enumerate(rows):
        out[at[i]].append(r)
    return list(out.values())


def plain_kept_near(rows):
    out = []
    for g in groups_near(rows):
        ids = [d for d, _ in g if d is not None]
        out.append(best([r for r in g if r[0] == min(ids, default=None)]))
    return sorted(out, key=repr)


def test_awkward_ids(spark):
    """All cases in one table, in words of their own; ids clash between them too."""
    rows = [(d, t and t.replace("w", f"{chr(97 + i)}w")) for i, case in enumerate(SEVERAL.values()) for d, t in case]
    df = spark.createDataFrame([(d, t, 5, "z") for d, t in rows], "doc_id long, text string, _0 int, kept string").repartition(2)
    assert table(neardup.near_duplicates(df).select("doc_id", "n_shingles", "component_id")) == plain_components(rows)
    exact, near = lsm_dedup.keep_one(df), neardup.keep_one(df)
    assert exact.schema == near.schema == df.schema
    size = lambda got: sorted(((d, len(t or "")) for d, t in got), key=repr)
    assert size(rows_of(exact)) == size(plain_kept_equal(rows))
    assert rows_of(near) == plain_kept_near(rows)


def test_tables(docs):  # noqa: F811
    assert rows_of(lsm_dedup.keep_one(docs)) == plain_kept_equal(ROWS)
    assert rows_of(neardup.keep_one(docs)) == plain_kept_near(ROWS)
    assert lsm_dedup.keep_one(docs.limit(0)).count() == neardup.keep_one(docs.limit(0)).count() == 0


def test_unique_texts_stay_under_any_ids(spark):
    """Ids say nothing: one row of each text stays, whatever they are."""
    r = np.random.default_rng(4)
    texts = [prose(500 + i, 40) for i in range(30)]
    rows = [(int(r.integers(0, 8)) if r.random() < 0.8 else None, texts[i]) for i in r.integers(0, 30, 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(t for _, t in rows_of(lsm_dedup.keep_one(df))) == sorted({t for _, t in rows})
