import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from loomline.llm import quality  # noqa: E402
from loomline.llm.common import table  # noqa: E402
from tests.llm.cases import DOCUMENTS, documents, with_clashes  # noqa: E402
from tests.llm.plain import components, quality_score, shingles  # noqa: E402
from tests.llm.test_packing import check as check_packing  # noqa: E402
from tests.llm.test_secret_scan import base  # noqa: E402


def test_every_stage_against_plain_python(spark, small):
    stages = dict(pipeline.STAGES)
    docs = table(spark, small, "documents")
    rows = {r.doc_id: r for r in docs.collect()}

    model = quality.fit_table(docs.select("doc_id", "text"), table(spark, small, "labels"))
    good = stages["quality classifier"](spark, docs, small)
    want = {i for i, r in rows.items() if quality_score(model, r.text) >= 0.3}
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == want

    unique = stages["exact dedup"](spark, good, small)
    last = {rows[i].text: i for i in sorted(want)}
    assert unique.columns == docs.columns and sorted(r.doc_id for r in unique.collect()) == sorted(last.values())

    single = stages["n-gram Jaccard join"](spark, unique, small)
    ids = sorted(last.values())
    first = {ids[c] for c in components([shingles(rows[i].text) for i in ids])}
    assert single.columns == docs.columns and {r.doc_id for r in single.collect()} == first

    clean = stages["secret scans"](spark, single, small)
    assert clean.columns == docs.columns
    for r in clean.collect():
        assert not base(r.text) and r.n_chars == len(r.text)
        if not base(rows[r.doc_id].text) and "[owned]" not in r.text:
            assert r.text == rows[r.doc_id].text
    assert {r.doc_id for r in clean.collect()} == first

    packed = pipeline.run(spark, small).collect()
    check_packing([(r.doc_id, r.text) for r in clean.collect()], packed)


def test_stages_take_trouble(spark, small):
    """Null and repeated ids, null, empty, blank and long texts, repeated rows, clashing columns; each stage on its own."""
    docs, stages = documents(spark), dict(pipeline.STAGES)
    order = lambda rows: sorted(map(tuple, rows), key=repr)
    kept = lambda name: order(stages[name](spark, with_clashes(docs), small).collect())
    of = lambda *ids: order(r for r in DOCUMENTS if r[0] in ids)
    one = of(None)[:1]  # of the two equal rows without an id

    model = quality.fit_table(docs.sparkSession.read.parquet(f"{small}/documents.parquet"), table(spark, small, "labels"))
    learned = quality.fit_table(docs, table(spark, small, "labels"))
    assert kept("quality classifier") == order(r for r in DOCUMENTS if (quality_score(learned, r[1]) if learned.folds else learned.share) >= 0.3)
    assert model.folds
    assert kept("exact dedup") == order([*one, *of(3, 5, 6, 7, 8, 9), of(4)[0]])
    assert kept("n-gram Jaccard join") == order([*one, *of(1, 2, 3, 5, 7, 8, 9)])
    assert kept("secret scans") == order((*r[:4], None if r[1] is None else len(r[1])) for r in DOCUMENTS)
    packed = stages["packing"](spark, docs.where("doc_id IN (1, 2, 3, 5, 7, 8, 9)"), small).collect()
    check_packing([r[:2] for r in DOCUMENTS if r[0] in (1, 2, 3, 5, 7, 8, 9)], packed)
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.where("false"), small).count() == 0


def test_who_stays_does_not_depend_on_the_order_of_rows(spark, small):
    rows = [(1, "a b c d e f g", "de", "s1", 13), (1, "a b c d e f g", "de", "s0", 13), (1, "a b c d e f g", None, "s0", 13), (2, "h", "en", "s", 1)]
    for name in ("exact dedup", "n-gram Jaccard join"):
        for some in (rows, rows[::-1]):
            out = dict(pipeline.STAGES)[name](spark, documents(spark, some).repartition(3), small).collect()
            assert sorted(map(tuple, out)) == [rows[1], rows[3]]
