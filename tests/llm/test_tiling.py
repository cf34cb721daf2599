import random

import numpy as np

from gridsonde.llm import tiling
from gridsonde.llm.shared import words


def brute_tiles(doc, item, least):
    """Greedy string tiling by plain comparison of every pair of positions."""
    free_d, free_i, tiles = [True] * len(doc), [True] * len(item), []
    while True:
        best = 0
        for q in range(len(item)):
            for p in range(len(doc)):
                n = 0
                while q + n < len(item) and p + n < len(doc) and item[q + n] == doc[p + n] and free_i[q + n] and free_d[p + n]:
                    n += 1
                best = max(best, n)
        if best < least:
            return tiles
        for q in range(len(item) - best + 1):
            for p in range(len(doc) - best + 1):
                if all(free_i[q:q + best]) and all(free_d[p:p + best]) and item[q:q + best] == doc[p:p + best]:
                    free_i[q:q + best] = [False] * best
                    free_d[p:p + best] = [False] * best
                    tiles.append((q, p, best))


def brute(docs, items, min_match, threshold):
    out = []
    for d, t in docs:
        for i, s in items:
            a, b = words(t), words(s)
            tiles = brute_tiles(a, b, min(min_match, len(b))) if a and b else []
            if tiles and sum(x[2] for x in tiles) >= threshold * len(b):
                out.append((d, i, sum(x[2] for x in tiles) / len(b), len(tiles), max(x[2] for x in tiles)))
    return sorted(out, key=str)


def test_tiles_equal_plain_comparison():
    rng = random.Random(3)
    for _ in range(150):
        doc = [rng.randint(0, 3) for _ in range(rng.randint(1, 40))]
        item = [rng.randint(0, 3) for _ in range(rng.randint(1, 20))]
        got = tiling.tile(np.array(doc, np.int64), np.array(item, np.int64), 3)
        assert got == brute_tiles(doc, item, min(3, len(item)))


def test_window_hashes_are_equal_for_equal_runs():
    tokens = np.array([1, 2, 3, 1, 2, 3, 1, 2], np.int64)
    for n in range(1, 9):
        h = window_hashes = tiling.window_hashes(tokens, n)
        assert len(window_hashes) == 9 - n
        for a in range(len(h)):
            for b in range(len(h)):
                assert (h[a] == h[b]) == (tokens[a:a + n].tolist() == tokens[b:b + n].tolist())


def cases():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcd") for _ in range(3))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate((30, 18, 24, 4, 40))] + [(7, None), (8, ""), (9, "... !")]
    items.append((10, items[1][1]))
    text = items[0][1].split()
    docs = [(1, "Intro. " + items[0][1].upper() + " end"), (2, " ".join(text[20:] + ["x"] + text[8:20] + ["y"] + text[:8])),
            (3, " ".join(word() for _ in range(200))), (4, None), (5, ""), (6, items[3][1] + " tail"), (7, items[1][1] + "\n" + items[2][1]),
            (None, items[2][1]), (1, "Intro. " + items[0][1].upper() + " end"), (8, "w " * 3000 + items[4][1]), (9, " ".join(text[:9]))]
    return docs, items


def test_both_ways_equal_brute_force(spark):
    docs, items = cases()
    d = spark.createDataFrame([(i, t, "extra", 1.5) for i, t in docs], "doc_id long, text string, item_id string, coverage double")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute([x for x in docs if x[0] != 8], items, 6, 0.5)
    for limit in (tiling.MAX_WORDS, 0):
        got = [tuple(r) for r in tiling.contaminated(d, b, max_words=limit).collect()]
        assert sorted((r for r in got if r[0] != 8), key=str) == want, limit
        assert [r[1] for r in got if r[0] == 8] == [4]
    assert {r[0] for r in want} == {1, 2, 6, 7, None}
    kept = tiling.clean_documents(d, b)
    assert kept.columns == d.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 3, 4, 5, 9]
    for few in (tiling.contaminated(d.limit(0), b), tiling.contaminated(d, b.limit(0)), tiling.contaminated(d, b.limit(0), max_words=-1)):
        assert few.collect() == []


def test_size_bound_counts_words_of_any_script(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(tiling, "_joined", lambda docs, *_: seen.append(1) or docs.limit(0))
    items = spark.createDataFrame([(1, "слово " * 300), (2, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    tiling.contaminated(docs, items, max_words=200)
    assert seen == [1]
