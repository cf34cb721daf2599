import re
from collections import Counter
from math import isclose, log

from gridsonde.llm import llr, queries

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    runs = Counter(zip(w, w[1:], w[2:]))
    marked = {i + k for i, x in enumerate(zip(w, w[1:], w[2:])) if runs[x] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(marked) > 50 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(marked), failed)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_base_counts_equal_brute_force(spark):
    texts = [None, "", " ", "\n\n", "a", "a b", "a b c", "a b c a b c", "x x x x", "é b  c\td\x0be\x0cf\rg\x1fh", "# $ <>|&*%",
             "same\nsame\n same\n\n\nsame", " ".join(f"w{i % 7}" for i in range(300)), " ".join(f"w{i}" for i in range(60)),
             " ".join(f"w{i % 5000}" for i in range(30000)), "A b C a B c A b C", "🙂 🙂 🙂 🙂"]
    rows = [(k, t, "x", 7) for k, t in enumerate(texts)] + [(None, "a b", None, None), (3, "again", "y", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words int")
    got = llr.base_counts(df)
    assert set(got.columns) == {"doc_id", "text", "kept", *NAMES}
    for r in got.collect():
        assert tuple(r[c] for c in NAMES) == brute(r["text"]), (r["text"] or "")[:60]
    assert llr.base_counts(df.limit(0)).collect() == []


def test_query_counts_and_verdicts(spark):
    sf = "/root/testdata/sf0.001"
    rows = queries.op6_likelihood_ratio(spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    good = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r[c] for c in NAMES) == brute(texts[r["doc_id"]])
    passed = [r for r in rows if not r["base_failed"]]
    least = min(r["score"] for r in passed if r["kept"])
    assert all(r["kept"] == (r["score"] >= least) for r in passed) and not any(r["kept"] for r in rows if r["base_failed"])
    judged = [(r["kept"], good[r["doc_id"]]) for r in passed if r["doc_id"] in good]
    assert sum(k for k, q in judged if q) >= 0.97 * sum(q for _, q in judged)


def test_scores_equal_plain_sums(spark):
    df = spark.createDataFrame([(1, "a b a b c"), (2, "c c d"), (3, None), (None, "a b")], "doc_id long, text string")
    trusted = spark.createDataFrame([(1,)], "doc_id long")
    ratios = llr.log_ratios(df, trusted)
    grams = {(r["doc_id"]): r["g"] for r in df.select("doc_id", llr.ngram_buckets(df["text"]).alias("g")).collect()}
    assert [len(grams[k]) for k in (1, 2, 3, None)] == [9, 5, 0, 3]
    raw, target = Counter(b for g in grams.values() for b in g), Counter(grams[1])
    share = sum(target.values()) / sum(raw.values())
    for b in raw:
        assert isclose(ratios[b], log((target[b] + llr.PRIOR) / (raw[b] * share + llr.PRIOR)), abs_tol=1e-12)
    for r in llr.judged(df, ratios, 0.0).collect():
        g = grams[r["doc_id"]]
        assert isclose(r["score"], sum(ratios[b] for b in g) / len(g) if g else 0.0, abs_tol=1e-12)


def test_no_trusted_documents(spark):
    df = spark.createDataFrame([(1, "w " * 10), (2, " ".join(map(str, range(80)))), (None, None)], "doc_id long, text string")
    for trusted in (spark.createDataFrame([(None,), (9,)], "doc_id long"), spark.createDataFrame([], "doc_id long")):
        assert {r["doc_id"]: r["kept"] for r in llr.filtered(df, trusted).collect()} == {1: False, 2: True, None: False}
        assert llr.filtered(df.limit(0), trusted).collect() == []


def test_all_trusted_documents_count(spark):
    n = 20_500  # more than the 20,000 that were once used
    ids = spark.range(n).withColumnRenamed("id", "doc_id")
    halves = llr.halves_of(ids.unionByName(ids.limit(50)).unionByName(spark.createDataFrame([(None,)], "doc_id long")))
    assert [r["doc_id"] for r in halves.orderBy("doc_id").collect()] == list(range(n))
    docs = ids.selectExpr("doc_id", "concat('all w', doc_id % 50) AS text")
    ratios = llr.log_ratios(docs, ids)
    assert all(abs(x) < 1e-9 for x in ratios), "the target is the corpus"


def test_threshold_is_the_exact_order_statistic(spark):
    docs = spark.createDataFrame([(k % 300, " ".join(f"w{k % 7}x{i % (20 + k % 60)}" for i in range(40 + k % 60))) for k in range(330)], "doc_id long, text string")
    held = docs.select("doc_id").where("doc_id % 2 = 0").distinct()
    ratios = [((b * 37) % 101 - 50) / 50 for b in range(llr.BUCKETS)]
    rows = llr.judged(docs, ratios, 0.0).where("not base_failed and doc_id % 2 = 0").select("doc_id", "score").collect()
    scores = sorted({r["doc_id"]: r["score"] for r in rows}.values())
    assert len(scores) > 20
    for loss in (0.005, 0.3):
        assert llr.held_out_threshold(docs, held, ratios, loss=loss) == scores[int(loss * len(scores))]
    for values in ([1.0], [2.0] * 5 + [3.0], [1e-300, 1.0, 1e300, 1e300], [-0.5, 0.0, 0.25, 0.25, 7.0]):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        assert [llr.share_below(df, "v", k / len(values) + 1e-9) for k in range(len(values))] == values
    assert llr.share_below(df.limit(0), "v", 0.5) is None
