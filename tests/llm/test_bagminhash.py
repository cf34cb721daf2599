import random
from collections import Counter

import numpy as np

from gridsonde.llm import bagminhash as B
from gridsonde.llm.shared import words


def bag(text, width=5):
    w = words(text)
    n = min(width, len(w))
    return Counter(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if w else Counter()


def brute_classes(docs, threshold=0.8):
    """Least id of each connected component; by comparing all pairs."""
    bags, root = {d: bag(t) for d, t in docs}, {d: d for d, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(bags)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if bags[a] and bags[b]:
                both = sum((bags[a] & bags[b]).values())
                if both >= threshold * sum((bags[a] | bags[b]).values()):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def changed(rng, text, share):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randint(0, 999)) if rng.random() < share else w for w in text.split())


def corpus():
    rng = random.Random(11)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(n))
    docs, k = [], 100
    for _ in range(6):
        base = text(150)
        for share in (0, 0, 0.005, 0.01, 0.02, 0.03, 0.05, 0.2):
            docs.append((k := k + 1, changed(rng, base, share)))
    star = text(200)  # copies near their source, not near one another
    docs += [(k := k + 1, changed(rng, star, 0.018)) for _ in range(25)] + [(k := k + 1, star)]
    docs += [(k := k + 1, text(40)) for _ in range(20)]
    docs += [(1, "one two three"), (2, "One, two THREE!"), (3, ""), (4, ""), (5, None), (6, "... !"), (7, "a b c d"), (8, "spam " * 5000), (9, "spam " * 4500),
             (10, "spam " * 3000)]
    return docs


def test_signature_estimates_the_weighted_similarity():
    rng = np.random.default_rng(4)
    for wide in (1, 3, 400):
        elements = B.mixed(rng.integers(1, 1 << 62, 80).astype(np.uint64))
        a, b = rng.integers(0, 2 + wide, 80), rng.integers(0, 2 + wide, 80)
        b[:60] = a[:60]
        true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        agree = np.mean([(B.signature(elements[a > 0] + np.uint64(k), a[a > 0], 64) == B.signature(elements[b > 0] + np.uint64(k), b[b > 0], 64)).mean()
                         for k in range(150)])
        assert abs(agree - true) < 0.03


def test_classes_equal_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame([(d, t, "x", 3) for d, t in docs], "doc_id long, text string, class_id string, node int")
    got = {r["doc_id"]: r["class_id"] for r in B.near_duplicates(df).select("doc_id", "class_id").collect()}
    assert got == brute_classes(docs)
    kept = B.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(got.values()))


def test_nulls_repeated_rows_and_empty_tables(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (2, "a b c d e f g"), (3, None), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["class_id"]) for r in B.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (None, None), (2, 1), (3, 3), (3, 3)], key=str)
    assert sorted((r["doc_id"] for r in B.one_of_each(df).collect()), key=str) == sorted([1, 3, None], key=str)
    assert B.near_duplicates(df.limit(0)).collect() == []


def test_buckets_of_passages_are_finished_exactly(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = " ".join(word() for _ in range(60))
    docs = [(k, " ".join(word() for _ in range(rng.choice((3, 8, 12, 20)))) + " " + passage) for k in range(60)]  # alike, some of them duplicates
    docs += [(100 + k, docs[k][1] + " " + word()) for k in range(10)]  # each a copy of one of them
    df = spark.createDataFrame(docs, "doc_id long, text string")
    seen, plain = [], B._accepted
    monkeypatch.setattr(B, "_accepted", lambda pairs, *a: seen.append(pairs.count()) or plain(pairs, *a))
    assert {r["doc_id"]: r["class_id"] for r in B.near_duplicates(df).collect()} == brute_classes(docs)
    assert sum(seen) < 700  # of 2,415 pairs


def test_texts_of_one_document_join_their_classes(spark):
    rng = random.Random(6)
    a, b, c = (" ".join(rng.choice("abcdefgh") + str(rng.randint(0, 99)) for _ in range(80)) for _ in range(3))
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (4, c), (5, None), (5, c + " z"), (6, "..."), (6, "")]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "doc_id long, text string, __text string, node int")
    got = sorted((r["doc_id"], r["class_id"]) for r in B.near_duplicates(df).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (5, 4), (6, 6), (6, 6)]
    kept = B.one_of_each(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 6]


def test_prefixes_of_similar_documents_meet():
    rng = random.Random(3)
    base = " ".join(f"w{rng.randint(0, 60)}" for _ in range(300))
    for common in (np.zeros(64, np.int64), np.arange(64)):
        for k in range(300):
            a, b = (B.shingles(words(changed(rng, base, 0.01))) for _ in range(2))
            if B.overlap(a, b) >= 0.8:
                assert np.intersect1d(B.prefix(*a, common, 0.8), B.prefix(*b, common, 0.8)).size, k


def test_pairs_over_the_threshold_pass_the_test_of_places(spark):
    """Some shared unit stands early enough in both orders for every pair at the threshold."""
    rng = random.Random(8)
    base = " ".join(f"w{rng.randint(0, 60)}" for _ in range(200))
    common, kept = np.arange(64), 0
    for _ in range(300):
        a, b = (B.shingles(words(changed(rng, base, rng.choice((0.005, 0.01, 0.02))))) for _ in range(2))
        if B.overlap(a, b) >= 0.8:
            kept += 1
            n, m = int(a[1].sum()), int(b[1].sum())
            need = int(np.ceil((n + m) * (0.8 / 1.8) - 1e-9))
            shared, at, to = np.intersect1d(B.prefix(*a, common, 0.8), B.prefix(*b, common, 0.8), return_indices=True)
            assert ((n - at >= need) & (m - to >= need)).any()
    assert kept > 50
