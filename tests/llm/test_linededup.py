import hashlib
import random
from collections import Counter

import numpy as np

from gridsonde.llm import linededup as L

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(SPACE).translate(LOWER)


def brute(texts, counted, threshold, min_chars):
    """Kept text, lines and dropped lines of every text, by plain counting over ``counted``."""
    n = Counter(k for t in counted for k in {key(x) for x in (t or "").split("\n")} if len(k) >= min_chars)
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if n[key(x)] < threshold]
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    common = ["Menu", "All Rights reserved", "ÄÖ ü", "x", "İstanbul", "a b"]
    lines = lambda: [rng.choice([rng.choice(common), f"{rng.choice(SPACE[:2])}{rng.choice(common).upper()} ", f"own {rng.random()}", "", "  "])
                     for _ in range(rng.randint(0, 9))]
    return ["\n".join(lines()) for _ in range(n)] + [None, "", "\n", " \n\n", "Menu\nMenu\nMenu", "Menu"]


def frame(spark, texts):
    return spark.createDataFrame([(k % 7 if k % 5 else None, t, "x", "y") for k, t in enumerate(texts)], "doc_id long, text string, n_lines string, key string")


def results(index, df):
    rows = index.drop_lines(df).collect()
    return sorted((r["text"] or "\0", r["kept_text"], r["n_lines"], r["n_dropped"]) for r in rows)


def expected(texts, counted, threshold=4, min_chars=1):
    return sorted((t or "\0", *b) for t, b in zip(texts, brute(texts, counted, threshold, min_chars)))


def plain(texts):
    """Empty text stands for itself in ``expected``; null is told apart."""
    return [t for t in texts if t]


def test_insert_and_delete_equal_counting_anew(spark, monkeypatch):
    one, two = corpus(1, 40), corpus(2, 30)
    first = L.LineIndex.empty(spark, threshold=4, shards=4).insert(frame(spark, one))
    both = first.insert(frame(spark, two))
    assert results(both, frame(spark, plain(two))) == expected(plain(two), one + two)
    back = both.delete(frame(spark, two))
    assert results(back, frame(spark, plain(one))) == expected(plain(one), one) == results(first, frame(spark, plain(one)))
    table = lambda x: sorted((bytes(r["key"]), r["n_docs"]) for r in x.counts.collect())
    assert table(back) == table(first)
    rows = both.drop_lines(frame(spark, one))
    assert rows.columns == ["doc_id", "text", "key", "n_lines", "n_dropped", "kept_text"] and rows.count() == len(one)
    monkeypatch.setattr(L, "MAX_FILTER_BYTES", -1)  # without the filters the exact table alone gives the same
    assert results(both, frame(spark, plain(two))) == expected(plain(two), one + two)


def test_short_lines_empty_tables_and_nulls(spark):
    texts = corpus(3, 30)
    index = L.LineIndex.empty(spark, threshold=2, min_chars=3, shards=2).insert(frame(spark, texts))
    assert results(index, frame(spark, plain(texts))) == expected(plain(texts), texts, 2, 3)
    none = frame(spark, texts).limit(0)
    assert index.drop_lines(none).collect() == []
    empty = L.LineIndex.empty(spark).insert(none)
    assert {r["n_dropped"] for r in empty.drop_lines(frame(spark, texts)).collect()} == {0}
    got = L.LineIndex.empty(spark).drop_lines(frame(spark, [None, ""])).collect()
    assert [(r["n_lines"], r["kept_text"]) for r in got] == [(1, ""), (1, "")]


def test_filters_hold_what_was_inserted_and_forget_what_left():
    keys = np.frombuffer(b"".join(hashlib.sha256(str(k).encode()).digest()[:16] for k in range(6000)), "<u8").reshape(-1, 2)
    f = L.Cuckoo.sized(6000)
    assert f.insert(keys[:3000]) and f.holds(keys[:3000]).all() and f.holds(keys[3000:]).mean() < 0.01
    f.delete(keys[:1500])
    assert f.holds(keys[1500:3000]).all() and f.holds(keys[:1500]).mean() < 0.01
    small = L.Cuckoo.sized(10)
    assert not small.insert(keys[:1000])
    assert L.Cuckoo.load(f.dump()).holds(keys[1500:3000]).all()
