import random

import numpy as np
import pytest

from loomline.llm import ngram_join
from loomline.llm.common import materialise
from loomline.llm.components import connected_components
from tests.llm.cases import DOCUMENTS, documents, with_clashes
from tests.llm.plain import components, shingles


def near_copies(seed, groups=40, copies=6, words=(5, 60)):
    """Texts in groups whose members differ in a few words, with a passage that many share."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    passage = [word() for _ in range(30)]
    out = []
    for _ in range(groups):
        text = [word() for _ in range(rng.randint(*words))]
        if rng.random() < 0.5:
            text += passage
        for _ in range(rng.randint(1, copies)):
            edited = list(text)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                at = rng.randrange(len(edited))
                edited[at : at + rng.randint(0, 1)] = [word()] * rng.randint(0, 1)
            out.append(" ".join(edited))
    rng.shuffle(out)
    return out


def check(spark, texts, **how):
    out = ngram_join.ngram_components(documents(spark, [(k, t, "en", "s", 1) for k, t in enumerate(texts)]), **how).collect()
    sets = [shingles(t, how.get("width", 5)) for t in texts]
    want = {k: (len(s), c) for k, (s, c) in enumerate(zip(sets, components(sets, how.get("pct", 80)), strict=True))}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == want and len(out) == len(texts)
    return want


@pytest.mark.parametrize("seed", [1, 2])
def test_all_links_of_random_near_copies(spark, seed):
    want = check(spark, near_copies(seed))
    assert len({c for _, c in want.values()}) < len(want) - 20


def test_short_texts_and_other_thresholds(spark):
    check(spark, near_copies(3, words=(1, 14)), pct=60, width=2)
    check(spark, near_copies(4, groups=15, copies=40, words=(15, 20)), tile=4, broadcast_ids=5)  # tiles and the shuffled way


def test_sets_of_four_and_five(spark):
    eight, nine = "a b c d e f g h", "a b c d e f g h i"
    want = check(spark, [eight, nine, eight + " x y", "A B  C D E F G H", "a b", "B a", "A\tb"])
    assert [c for _, c in want.values()] == [0, 0, 2, 0, 4, 5, 4]


def test_edge_documents(spark):
    out = ngram_join.ngram_components(with_clashes(documents(spark))).collect()
    assert len(out) == len(DOCUMENTS)
    of = {}
    for r in out:
        of.setdefault(r.doc_id, set()).add((r.n_shingles, r.component_id))
    assert of[1] == {(4, 1)} and of[4] == {(4, 1)} and of[2] == {(0, 2)} and of[3] == {(0, 3)} and of[9] == {(0, 9)}
    assert of[None] == {(1, None)} and of[6] == {(6, 5)} and of[5] == {(5, 5)}
    kept = ngram_join.keep_one_of_each(with_clashes(documents(spark)))
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 5, 7, 8, 9]
    assert ngram_join.ngram_components(documents(spark, [])).count() == 0 and ngram_join.keep_one_of_each(documents(spark, [])).count() == 0


def test_kept_rows_name_their_components(spark):
    texts = near_copies(7)
    df = documents(spark, [(k, t, "en", "s", 1) for k, t in enumerate(texts)])
    kept = {r.doc_id for r in ngram_join.keep_one_of_each(df).collect()}
    assert kept == set(components([shingles(t) for t in texts]))


def test_bounds_hold_for_all_sizes():
    """Sets linked at the threshold agree on as many blocks as each side counts on."""
    rng = np.random.default_rng(1)
    for n in [*range(1, 70), 127, 128, 160, 255, 256, 1000]:
        for _ in range(3):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * 2)
            drop = rng.integers(0, len(a) // 5 + 1)
            most = (100 * (len(a) - drop) - 80 * len(a)) // 80
            b = np.unique(np.r_[a[: len(a) - drop], rng.integers(0, 1 << 63, max(0, rng.integers(0, most + 1))).astype(np.uint64) * 2 + 1])
            both = len(np.intersect1d(a, b))
            assert 100 * both >= 80 * (len(a) + len(b) - both)
            sides = [{(g, s) for g, (_, sig) in enumerate(ngram_join.agreements(x, 80)) for s in sig.tolist()} for x in (a, b)]
            shared = {s for _, s in sides[0]} & {s for _, s in sides[1]}
            needs = [[need for need, sig in ngram_join.agreements(x, 80) if len(shared & set(sig.tolist())) >= need] for x in (a, b)]
            assert needs[0] and needs[1]


def test_a_chain_of_weak_agreements(spark, monkeypatch):
    """Each text shares most of its blocks with the next but links with none: twice the texts take twice the rows, in as many tables."""
    written: list[int] = []

    def counted(df, name, *more):
        out = materialise(df, name, *more)
        written.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "materialise", counted)
    work = {}
    for n in (1_000, 2_000):
        texts = [" ".join(f"v{w}" for w in range(12 * k, 12 * k + 100)) for k in range(n)]
        written.clear()
        out = ngram_join.ngram_components(documents(spark, [(k, t, "en", "s", 1) for k, t in enumerate(texts)])).collect()
        assert len(out) == n and all(r.component_id == r.doc_id and r.n_shingles == 96 for r in out)
        work[n] = (len(written), sum(written))
    assert work[2_000][0] <= work[1_000][0] and work[2_000][1] <= 2.1 * work[1_000][1]


def test_groups_of_many_tiles(spark):
    """Copies of one text and ones that link with few of them or none, in components of more than TOGETHER tiles."""
    rng = random.Random(11)
    base = [f"b{k}" for k in range(60)]
    texts = []
    for _ in range(150):
        t = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
            t[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(t))
    for shift in range(0, 60, 3):  # a chain away from the base
        texts.append(" ".join([*base[shift:], *(f"c{k}" for k in range(shift))]))
    rng.shuffle(texts)
    for pct in (80, 90):
        want = check(spark, texts, tile=4, pct=pct)
        assert len({c for _, c in want.values()}) > 1


def test_counts_by_entries_equal_counts_by_matrix(monkeypatch):
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 90)).astype(np.uint64)) for _ in range(40)]
    owner, _, lengths = ngram_join._columns(sets)
    counts = ngram_join._sparse_counts(owner, lengths, 40)
    for a in range(40):
        for b in range(40):
            assert a == b or counts[a, b] == len(np.intersect1d(sets[a], sets[b]))
    for columns in (7, 4096):
        got = ngram_join.linked(sets, 50, columns)
        assert all(got[a, b] == (a != b and 100 * len(np.intersect1d(sets[a], sets[b])) >= 50 * len(np.union1d(sets[a], sets[b]))) for a in range(40) for b in range(40))


def test_ties_that_differ_elsewhere(spark):
    rows = [(1, "a b c d e f", "de", "s1", 1), (1, "a b c d e f", "de", "s0", 2), (1, "a b c d e f", None, "s0", 2), (2, "a b c d e f", "aa", "s", 1)]
    for n in (1, 4):
        out = ngram_join.keep_one_of_each(documents(spark, rows[::-1]).repartition(n)).collect()
        assert [tuple(r) for r in out] == [(1, "a b c d e f", "de", "s0", 2)]


def test_few_edges_make_few_tasks(spark):
    """A round's stages go with the edges, not with the shuffle partitions."""
    held = {"spark.sql.shuffle.partitions": "160", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in held}
    pairs = [(k + 1, k) for k in range(40)] + [(k, 1000) for k in range(1001, 1400)]
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        out = connected_components(spark.createDataFrame(pairs, "a long, b long"))
        assert len(out.inputFiles()) <= 2 * (8 + 160 // 8)
        assert {r.node: r.label for r in out.collect()} == {k: 0 for k in range(41)} | {k: 1000 for k in range(1000, 1400)}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
