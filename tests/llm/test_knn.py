import zlib

import numpy as np

from gridsonde.llm import knn, queries


def brute(model, text):
    """Score of one text by comparing it with every labelled vector in turn."""
    x = model.project(knn.term_counts(text)[None, :])[0]
    near = sorted(((-round(float(np.float64(x @ v)), 6), k) for k, v in enumerate(model.vectors)))[:model.k]
    cosines = np.array([-n for n, _ in near])
    weights = np.exp(knn.SHARPNESS * (cosines - cosines.max()) / max(1e-3, 1 - cosines.min()))
    return float((weights * model.labels[[k for _, k in near]]).sum() / weights.sum())


def tables(spark):
    sf = "/root/testdata/sf0.001"
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


def test_scores_equal_single_comparisons(spark):
    docs, labels = tables(spark)
    model = queries.quality_model(docs, labels)
    rows = knn.score(docs.withColumn("score", docs.lang), model).collect()
    assert len(rows) == docs.count()
    for r in rows[:60]:
        assert abs(r["score"] - brute(model, r["text"])) < 1e-4 and r["predicted"] == (r["score"] >= 0.5)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    good = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.op8_neighbour_quality(spark, sf).collect() if r["held_out"] and r["doc_id"] in good]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert np.mean([r["predicted"] == good[r["doc_id"]] for r in rows]) > 0.95


def test_odd_rows_and_missing_labels(spark):
    docs = spark.createDataFrame([(1, "good plain words here"), (2, "### $$$ %%%"), (None, None), (3, ""), (3, ""), (4, "x " * 50000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, label int")
    assert {r["score"] for r in knn.score(docs, knn.fit(docs, none)).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (1, 1), (None, 0), (2, None), (9, 0)], "doc_id long, label int")
    assert {r["score"] for r in knn.score(docs, knn.fit(docs, one)).collect()} == {1.0}
    both = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, label int")
    got = knn.score(docs, knn.fit(docs, both)).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
    assert knn.score(docs.limit(0), knn.fit(docs, both)).collect() == []
