"""Queries take whole texts and all rows, held against plain Python on small tables."""

import math
import random
import re
from collections import Counter

from loomline.plans import evaluate, ingest, story

TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
PAD = "Common words of an opening. " * 20


def save(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_document_tokens_are_those_of_the_whole_text(spark, tmp_path):
    texts = [PAD + "first Ending it's", PAD + "Second ending", "short ending", PAD, ""]
    save(spark, tmp_path, "documents", list(enumerate(texts)), "doc_id long, text string")
    words = [TOKEN.findall(t.lower()) for t in texts]
    got = {r.doc_id: r.tokens for r in ingest.tokens(spark, str(tmp_path)).collect()}
    assert got == {k: "|".join(w) for k, w in enumerate(words)}
    df = Counter(t for w in words for t in set(w))
    got = {r.token: (r.df, r.idf) for r in evaluate.token_idf(spark, str(tmp_path)).collect()}
    assert got == {t: (n, round(math.log((len(texts) + 1) / (n + 1)) + 1, 6)) for t, n in df.items()} and got["ending"][0] == 3


def lcs(a, b):
    m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            m[i + 1][j + 1] = m[i][j] + 1 if x == y else max(m[i][j + 1], m[i + 1][j])
    return m[-1][-1]


def swept(joined):
    """Counts of (expected, joined) pairs."""
    c = Counter(joined)
    return c[True, True], c[False, True], c[False, False], c[True, False]


def test_benchmark_similarities_are_those_of_the_whole_text(spark, tmp_path):
    opening = "Some words in common at the start. " * 7
    texts = [opening + "red green blue green", opening + "green blue red", opening + "grey", "green blue", opening, "", opening + "grey green", "red"]
    save(spark, tmp_path, "benchmark", list(enumerate(texts)), "item_id long, text string")
    words = [TOKEN.findall(t.lower()) for t in texts]
    sets, n = [set(w) for w in words], len(texts)
    pairs = [(i, j) for j in range(n) for i in range(j)]
    df = Counter(t for s in sets for t in s)
    idf = {t: math.log((n + 1) / (d + 1)) + 1 for t, d in df.items()}
    rows = lambda query: query(spark, str(tmp_path)).collect()
    key = lambda r: (r.left_item_id, r.right_item_id)

    jaccard = {(i, j): round(len(sets[i] & sets[j]) / len(sets[i] | sets[j]), 6) if sets[i] and sets[j] else 0.0 for i, j in pairs}
    assert {key(r): r.jaccard for r in rows(evaluate.pairwise_lexical)} == jaccard
    assert {key(r): r.token_order for r in rows(evaluate.token_order_lcs)} == {(i, j): round(lcs(words[i], words[j]) / max(len(words[i]), len(words[j])), 6) if words[i] and words[j] else 0.0 for i, j in pairs}
    weighted = {key(r): r.weighted_jaccard for r in rows(evaluate.weighted_jaccard)}
    assert weighted.keys() == set(pairs)
    for i, j in pairs:
        every = sum(idf[t] for t in sets[i] | sets[j])
        assert abs(weighted[i, j] - (sum(idf[t] for t in sets[i] & sets[j]) / every if every else 0.0)) < 2e-6

    distinctive = {}
    for cut in set(df.values()):
        for i, j in pairs:
            a, b = ({t for t in sets[k] if df[t] <= cut} for k in (i, j))
            distinctive[i, j, cut] = (len(a & b), round(len(a & b) / len(a | b), 6) if a | b else 0.0)
    assert {(*key(r), r.cutoff): (r.shared, r.distinctive_jaccard) for r in rows(evaluate.distinctive_jaccard)} == distinctive
    want = {}
    for cut in set(df.values()):
        at = {(i, j): distinctive[i, j, cut][1] for i, j in pairs}
        for t in {0.0, *at.values()}:
            want[cut, t] = swept(((i + j) % 2 == 0, v >= t) for (i, j), v in at.items())
    assert {(r.cutoff, r.threshold): (r.tp, r.fp, r.tn, r.fn) for r in rows(evaluate.distinctive_sweep)} == want

    both = {(i, j): (round(x, 3), abs(i - j) * 60_000 / 600_000) for (i, j), x in jaccard.items()}
    want = {(x, y): swept(((i + j) % 2 == 0, a >= x and b >= y) for (i, j), (a, b) in both.items()) for x in {0.0, *(a for a, _ in both.values())} for y in {0.0, *(b for _, b in both.values())}}
    assert {(r.first_threshold, r.second_threshold): (r.tp, r.fp, r.tn, r.fn) for r in rows(evaluate.lexical_threshold_grid)} == want


def test_every_earlier_vector_of_a_scenario_is_a_seed(spark, tmp_path):
    rng = random.Random(3)
    vectors = {k: [rng.gauss(0, 1) for _ in range(4)] for k in (*range(0, 400, 5), *range(999_900, 1_000_100, 5))}
    save(spark, tmp_path, "embeddings", [(k, k % 3, v) for k, v in vectors.items()], "vec_id long, label long, embedding array<double>")
    length = {k: math.sqrt(sum(a * a for a in v)) for k, v in vectors.items()}
    want = {}
    for j, w in vectors.items():
        seeds = [i for i in vectors if i < j and i // 50 == j // 50]
        match = [f"{i:06d}" for i in seeds if round(sum(a * b for a, b in zip(vectors[i], w, strict=True)) / (length[i] * length[j]), 6) >= story.THRESHOLD]
        kind = "assign-existing-story" if len(match) == 1 else "seed-new-story"
        reason = "no-candidates" if not seeds else "no-matching-candidates" if not match else "ambiguous-matching-candidates" if len(match) > 1 else None
        want[j] = (kind, reason, match[0] if len(match) == 1 else None, len(seeds), len(match), ",".join(match) if len(match) > 1 else "")
    got = {r.article_id: (r.kind, r.reason, r.story_id, r.considered, r.matching, r.matching_ids) for r in story.cluster_assignment(spark, str(tmp_path)).collect()}
    assert got == want
