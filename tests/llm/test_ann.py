import numpy as np
import pytest

from loomline.llm import ann


def brute(ids, x, every=20, top=20):
    out = {}
    for q in [i for i in ids if i % every == 0]:
        s = x @ x[ids.index(q)]
        others = sorted((-float(s[k]), i) for k, i in enumerate(ids) if i != q)[:top]
        out[q] = [(i, -v) for v, i in others]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("scale", [1.0, 1e-3])
def test_recall_on_many_small_blocks(spark, scale):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 24)).astype(np.float32).astype(np.float64) * scale
    df = spark.createDataFrame([(k, v.tolist(), "c") for k, v in enumerate(x)], "vec_id long, embedding array<double>, node string")
    out, want = found(ann.nearest(df, k=16, orders=2, beam=96)), brute(list(range(3000)), x)
    hits = [len({i for i, _ in out[q]} & {i for i, _ in w}) for q, w in want.items()]
    assert out.keys() == want.keys() and np.mean(hits) >= 18
    for q, rows in out.items():
        assert [s for _, s in rows] == sorted((s for _, s in rows), reverse=True)
        for i, s in rows:
            assert abs(s - x[i] @ x[q]) <= 1e-12 * scale**2 * 100


def test_graph_from_runs_alone_improves(spark):
    """NN-descent finds what small runs of one order miss."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 16)).astype(np.float32)
    from loomline.llm.common import materialise

    vectors = materialise(spark.createDataFrame([(k, bytearray(v.tobytes())) for k, v in enumerate(x)], "node long, vector binary"), "t")
    truth = np.argsort(-(x @ x.T - 1e9 * np.eye(len(x))), axis=1)[:, :10]

    def recall(rounds):
        graph = ann.build_graph(vectors, len(x), x[:500], k=16, orders=2, chunk=64, rounds=rounds).toPandas()
        node_of = dict(zip(graph["nid"], graph["node"], strict=True))
        hits = [len({node_of.get(i) for i in np.frombuffer(ids, np.int64)} & set(truth[node])) for node, ids in zip(graph["node"], graph["ids"], strict=True)]
        return np.mean(hits) / 10

    start, end = recall(0), recall(4)
    assert start < 0.7 and end > 0.9


def test_equal_vectors_ties_and_rows_that_take_no_part(spark):
    bad = [(1000, None), (1001, []), (1002, [0.0, 0.0, 0.0]), (1003, [1.0, None, 0.0]), (1004, [float("nan"), 1.0, 0.0]), (1005, [float("inf"), 1.0, 0.0]), (1006, [1.0]), (None, [1.0, 0.0, 0.0]), (1020, None)]
    good = [(k, [1.0, 0.0, 0.0]) for k in range(60)] + [(k, [0.0, float(k), 1.0]) for k in range(60, 70)]
    rows = good + bad + [(0, [1.0, 0.0, 0.0])] * 2
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = found(ann.nearest(df))
    ids, x = [i for i, _ in good], np.array([v for _, v in good])
    assert out == {q: [(i, s) for i, s in w] for q, w in brute(ids, x).items()}


@pytest.mark.parametrize("rows", [[], [(0, [1.0, 2.0])], [(0, [1.0, 2.0]), (20, [2.0, 1.0]), (3, [0.5, 0.5])]])
def test_few_rows(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = np.array([v for _, v in rows]).reshape(len(rows), 2)
    assert found(ann.nearest(df)) == {q: w for q, w in brute([i for i, _ in rows], x).items() if w}


def mean_recall(spark, x, **options):
    ids = list(range(len(x)))
    out = found(ann.nearest(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>"), **options))
    want = brute(ids, x)
    assert out.keys() == want.keys()
    return np.mean([len({i for i, _ in out[q]} & {i for i, _ in w}) / len(w) for q, w in want.items()])


@pytest.mark.parametrize("times", [1e4, 1e9])
def test_one_long_vector_does_not_flatten_the_others(spark, times):
    x = np.random.default_rng(7).normal(size=(3000, 24))
    x[1234] *= times
    assert mean_recall(spark, x, k=16, orders=2, beam=96) > 0.95


def test_many_near_copies(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 16))
    x[:2500] = x[0] + 1e-4 * rng.normal(size=(2500, 16))
    assert mean_recall(spark, x) > 0.95


def test_every_length_has_its_neighbours(spark):
    rng = np.random.default_rng(8)
    rows = [(k, rng.normal(size=16 if k % 3 else 5).tolist()) for k in range(600)] + [(1000, [1.0]), (1020, [])]
    out = found(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=16, orders=2, beam=96))
    hits = []
    for n in (16, 5):
        ids = [i for i, v in rows if len(v) == n]
        for q, near in brute(ids, np.array([v for _, v in rows if len(v) == n])).items():
            hits.append(len({i for i, _ in out[q]} & {i for i, _ in near}))
            assert all(len(rows[i][1]) == n for i, _ in out[q])
    assert len(hits) == 30 and np.mean(hits) > 19 and 1000 not in out


def test_blocks_that_many_send_to_are_dealt_out(spark, monkeypatch):
    """With a load of a few kilobytes every block is copied and thinned; a long vector is met by all queries."""
    monkeypatch.setattr(ann, "LOAD", 20_000)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1500, 12))
    x[7] *= 1000
    out = found(ann.nearest(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>"), k=16, orders=2, rounds=3, beam=96))
    want = brute(list(range(1500)), x)
    assert np.mean([len({i for i, _ in out[q]} & {i for i, _ in w}) for q, w in want.items()]) > 18.5


def test_recall_on_the_table_itself(spark):
    """op8_ann on all of sf0.1's embeddings against brute force."""
    from loomline.llm import queries

    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    ids, x = table["vec_id"].tolist(), np.stack(table["embedding"]).astype(np.float64)
    out = found(queries.op8_ann(spark, "/root/testdata/sf0.1"))
    place = {i: k for k, i in enumerate(ids)}
    hits = []
    for q in [i for i in ids if i % 20 == 0]:
        s = x @ x[place[q]]
        s[place[q]] = -np.inf
        near = np.argsort(-s, kind="stable")[:20]
        hits.append(len({i for i, _ in out[q]} & {ids[k] for k in near}) / 20)
    assert len(out) == len(hits) and np.mean(hits) > 0.97
