import hashlib
from collections import defaultdict

import pytest

from loomline.llm import exact_dedup
from tests.llm.cases import CLASHING, DOCUMENTS, documents, with_clashes


def expected(rows, keep):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[text or ""].append(doc_id)
    pick = (lambda ids: max(ids, default=None)) if keep == "largest" else (lambda ids: min(ids, default=None))
    return {t: (pick([i for i in ids if i is not None]), len(ids)) for t, ids in groups.items()}


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("fan_in,range_rows", [(2, 3), (8, 1 << 20)])
def test_every_row_and_one_kept(spark, keep, fan_in, range_rows):
    rows = DOCUMENTS + [(100 + k, f"text {k % 7}", "en", "s", 1) for k in range(60)]
    df = with_clashes(documents(spark, rows).repartition(13))
    out = exact_dedup.exact_dedup(df, keep=keep, fan_in=fan_in, range_rows=range_rows).collect()
    want = expected(rows, keep)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in want.items()}
    assert len(out) == len(rows)
    for r in out:
        assert (r.keep_id, r.group_size) == by_sha[r.text_sha256]
    assert sum(r.kept for r in out) == len(want)
    assert all(r.doc_id == r.keep_id for r in out if r.kept)


def test_kept_rows_have_all_columns(spark):
    df = with_clashes(documents(spark))
    out = exact_dedup.keep_one_of_each(df, keep="largest")
    assert out.columns == df.columns and set(CLASHING) <= set(out.columns) | {"n"}
    assert sorted(r.text or "" for r in out.collect()) == sorted({t or "" for _, t, *_ in DOCUMENTS})


def test_empty(spark):
    assert exact_dedup.exact_dedup(documents(spark, [])).count() == 0
    assert exact_dedup.keep_one_of_each(documents(spark, [])).count() == 0


def test_merge_refuses_two_lengths():
    import numpy as np

    a = np.array([(b"x" * 32, 1, 1, 1, 5, 7)], exact_dedup.ENTRY)
    for other in ((6, 7), (5, 8)):
        b = np.array([(b"x" * 32, 2, 2, 1, *other)], exact_dedup.ENTRY)
        with pytest.raises(ValueError):
            exact_dedup.merge_runs([a, b], "largest")


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_runs_are_woven_as_if_sorted(keep):
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(20):
        parts = []
        for size in rng.integers(0, 60, 7):
            part = np.zeros(size, exact_dedup.ENTRY)
            part["digest"] = [bytes([k]) * 32 for k in rng.integers(1, 40, size)]
            part["id"], part["row"], part["rows"] = rng.integers(-5, 5, size), rng.permutation(size), 1
            parts.append(part)
        got = exact_dedup.merge_runs([exact_dedup._collapse(p, keep) for p in parts], keep)
        every = np.concatenate(parts)
        best = max if keep == "largest" else min
        want = [(d, *best((e["id"], e["row"]) for e in every[every["digest"] == d]), (every["digest"] == d).sum()) for d in sorted(set(every["digest"]))]
        assert [(e["digest"], e["id"], e["row"], e["rows"]) for e in got] == want


def test_ties_that_differ_elsewhere(spark):
    rows = [(1, "t", "de", "s1", 1), (1, "t", "en", "s0", 1), (1, "t", None, "s2", 1), (1, "t", "de", "s0", None), (2, "u", "en", "s", 1), (2, "u", "en", "s", 1)]
    for n in (1, 5):
        for order in (rows, rows[::-1]):
            out = exact_dedup.keep_one_of_each(documents(spark, order).repartition(n), keep="largest").collect()
            assert sorted(tuple(r) for r in out) == [(1, "t", "de", "s0", None), (2, "u", "en", "s", 1)]
