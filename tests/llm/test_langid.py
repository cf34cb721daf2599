import zlib
from collections import Counter

import numpy as np

from gridsonde.llm import langid, queries


def grams(line):
    """Counts of n-grams of padded words, by slicing."""
    out = Counter()
    for w in line.split():
        w = f" {w} "
        for n in (1, 2, 3):
            out.update(g for g in (w[i:i + n] for i in range(len(w) - n + 1)) if g != " ")
    return out


def spelt(gram):
    g = int(np.int64(gram).view(np.uint64))
    size = 3 if g >> 61 == 3 else 2 if g >> 62 == 1 else 1
    return "".join(chr((g >> (21 * k)) & 0x3FFFF) if (g >> (21 * k)) & 0x3FFFF else " " for k in reversed(range(size)))


def brute(text, profiles, size):
    """Nearest language by plain lists of ranks; n-grams in the operator's order of equals."""
    line = langid.letters_only(text)
    if not line or not profiles:
        return "und", 0.0
    codes, counts = langid.gram_counts(langid._codes(line))
    own = [g for _, g in sorted((-int(c), int(g)) for g, c in zip(codes, counts))][:size]
    best = None
    for name in sorted(profiles):
        rank = {int(np.int64(g).view(np.uint64)): k for k, g in enumerate(profiles[name])}
        d = sum(min(abs(rank[g] - k), size) if g in rank else size for k, g in enumerate(own))
        if best is None or d < best[0]:
            best = (d, name)
    return best[1], 1 - best[0] / (size * len(own))


def test_counts_equal_slicing():
    for text in ("a", "Hello, world  hello", "çé ñ ß x1y2 _z", "word " * 500, "日本語 テスト", "𝒳𝒴 𝒳"):
        line = langid.letters_only(text)
        codes, counts = langid.gram_counts(langid._codes(line))
        assert {spelt(g.view(np.int64)): int(n) for g, n in zip(codes, counts)} == dict(grams(line))


def test_predictions_equal_brute_force_and_are_right(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r for r in queries.op3_language_id(spark, sf).collect()}
    profiles = langid.learn(docs.where("crc32(cast(cast(doc_id as string) as binary)) % 5 != 0"))
    hits = []
    for r in docs.collect():
        got = rows[r["doc_id"]]
        assert got["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= got["score"] <= 1
        if r["doc_id"] % 7 == 0:
            want = brute(r["text"], profiles, langid.PROFILE)
            assert got["lang_pred"] == want[0] and abs(got["score"] - want[1]) < 1e-9
        if got["held_out"]:
            hits.append(got["lang_pred"] == r["lang"])
    assert np.mean(hits) > 0.97


def test_odd_rows(spark):
    rows = [(1, "der die das und", "de", "x"), (2, "the and of to", "en", "y"), (3, None, "en", "z"), (4, "the", None, "z"), (None, "1234 ... ²", "de", None), (5, "", "fr", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    profiles = langid.learn(df)
    assert sorted(profiles) == ["de", "en"]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(df, profiles).collect()}
    assert got[1] == ("de", 1.0) and got[2] == ("en", 1.0) and got[4][0] == "en"
    assert got[3] == got[5] == got[None] == ("und", 0.0)
    assert {r["lang_pred"] for r in langid.predict(df, langid.learn(df.limit(0))).collect()} == {"und"}
    assert langid.predict(df.limit(0), profiles).collect() == []
