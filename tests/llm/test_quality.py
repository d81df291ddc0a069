import zlib

import numpy as np

from loomline.llm import quality, queries
from tests.llm.cases import DOCUMENTS, documents, with_clashes
from tests.llm.plain import quality_score


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    out = queries.op5_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    held = out[out.held_out]
    assert (held.held_out == held.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all() and len(held) > 500
    assert (held.predicted == held.quality).mean() > 0.97
    assert (held[held.quality == 1].predicted == 1).mean() > 0.99
    assert (held[held.quality == 0].predicted == 0).mean() > 0.85
    # calibrated: the mean score of the held-out rows is near their share of good ones
    assert abs(held.score.mean() - held.quality.mean()) < 0.03


def test_edge_rows(spark):
    model = quality.fit(["plain words in a row " * 9 + str(k) for k in range(40)], ["### $$$ %%% " * 9 + str(k) for k in range(40)], 0.5)
    df = with_clashes(documents(spark))
    out = quality.score_table(df, model)
    assert out.columns == [c for c in df.columns if c != "score"] + ["score", "predicted"]
    rows = out.collect()
    assert len(rows) == len(DOCUMENTS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert len({r.score for r in rows if not r.text}) == 1
    assert quality.score_table(documents(spark, []), model).count() == 0
    assert model.score(["plain words again"])[0] > model.score(["%%% $$$ again ###"])[0]


def test_labels_with_gaps(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (3, None), (4, 7)], "doc_id long, quality int")
    assert np.allclose(quality.fit_table(docs, labels).score(["x", ""]), 0.5)
    some = spark.createDataFrame([(k, 1) for k in range(30)], "doc_id long, quality int")
    assert quality.fit_table(docs, some).score(["x"])[0] > 0.99


def test_scores_against_plain_python(spark, small):
    """Every row of op5_quality, its fold and decision, from the model's dictionaries and weights."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    model = quality.fit_table(docs, labels)
    assert len(model.folds) == quality.FOLDS
    text = {r.doc_id: r.text for r in docs.collect()}
    out = queries.op5_quality(spark, small).collect()
    assert sorted(r.doc_id for r in out) == sorted(text)
    for r in out:
        want = quality_score(model, text[r.doc_id])
        assert abs(r.score - want) < 1e-9 and r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_held_out_labels_and_other_columns_teach_nothing(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    from pyspark.sql import functions as F

    held = quality.fold(F.col("doc_id")) == 0
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    other = docs.withColumns({"lang": F.lit("x"), "source": F.lit("y"), "text": F.when(held, F.reverse("text")).otherwise(F.col("text"))})
    probe = [r.text or "" for r in docs.limit(50).collect()]
    assert (quality.fit_table(docs, labels).score(probe) == quality.fit_table(other, flipped).score(probe)).all()


def test_long_labelled_texts_teach(spark):
    long = "%%% ### " * 20_000
    rows = [(k, "plain words in a row " * 9 + str(k), "en", "s", 1) for k in range(60)] + [(100 + k, long + str(k), "en", "s", 1) for k in range(60)]
    labels = spark.createDataFrame([(r[0], int(r[0] < 100)) for r in rows], "doc_id long, quality int")
    model = quality.fit_table(documents(spark, rows), labels)
    assert model.score([long])[0] < 0.3 < model.score([rows[0][1]])[0]
    bounded = quality.fit_table(documents(spark, rows), labels, sample_bytes=1)  # one text of each class: too few
    assert not bounded.folds
