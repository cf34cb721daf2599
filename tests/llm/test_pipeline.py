import sentencepiece
from test_bagminhash import brute_classes
from test_knn import brute as brute_score
from test_linededup import brute as brute_lines

import __spark_entry__ as entry
import corpus_pipeline
from gridsonde.llm import queries
from gridsonde.llm.shared import words

SF = "/root/testdata/sf0.001"


def holds(text, item):
    """Whether the words of an item stand in a text in one run (as they do in these tables)."""
    return f" {' '.join(words(item))} " in f" {' '.join(words(text))} "


def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = queries.quality_model(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if brute_score(model, r["text"]) >= 0.5}
    ids = sorted(texts)
    texts = dict(zip(ids, (t for t, _, _ in brute_lines([texts[d] for d in ids], [texts[d] for d in ids], 10, 1))))
    classes = brute_classes(sorted(texts.items()))
    texts = {d: t for d, t in texts.items() if classes[d] == d}
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = {d: t for d, t in texts.items() if not any(holds(t, i) for i in items)}
    library = sentencepiece.SentencePieceProcessor(model_file=queries.MODEL_PATH)
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert sorted(got) == sorted(texts)
    for d, t in texts.items():
        assert got[d]["ids"] == library.encode(t) and got[d]["round_trip"]


def test_stages_keep_the_columns_of_documents(spark):
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "a b c\na b c", None, None, 11)],
                                spark.read.parquet(f"{SF}/documents.parquet").schema)
    for df in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, SF)
            assert name == "piece encoding" or df.columns == odd.columns
        assert {"doc_id", "ids"} <= set(df.columns)
        df.collect()


def test_every_operator_is_registered():
    names = entry.queries()
    assert "pipeline" in names and [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13
    assert set(queries.ORACLES) <= set(entry.oracle_sql())
