import hashlib
import zlib

from gridsonde.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string, tree string, leaf int, at string, n int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows):
    """Levels as lists, node by node."""
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def low(t):
        return None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)

    trees = {}
    for doc_id, source, lang, n, text in rows:
        leaf = sha("".join(map(field, (doc_id, source, lang, n, text))))
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
        trees.setdefault(source, []).append((doc_id, leaf, sha("".join(map(field, (doc_id, source, lang, n, low(text))))) if hit else leaf))

    def climb(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            last = levels[-1]
            levels.append([sha("".join(last[i:i + 16])) for i in range(0, len(last), 16)])
        return levels

    def path(levels, i):
        out = []
        for level in levels[:-1]:
            start = i // 16 * 16
            out.append(("".join(level[start:i]), "".join(level[i + 1:start + 16])))
            i //= 16
        return out

    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for s in order:
        trees[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        built[s] = climb([r[1] for r in trees[s]])
    top = climb([built[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (doc_id, leaf, changed) in enumerate(trees[s]):
            steps = path(built[s], i) + path(top, k)
            node = changed
            for left, right in steps:
                node = sha(left + node + right)
            out.append((doc_id, leaf, built[s][-1][0], top[-1][0], sha("".join(a + b for a, b in steps)), node, node == top[-1][0]))
    return out


def key(row):
    return tuple((v is not None, v) for v in row)


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], SCHEMA)
    got = [tuple(r) for r in merkle.manifest(df).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    return got


def test_equals_lists_of_nodes(spark):
    rows = [(i, "hot", "de", i % 7, f"Text {i}") for i in range(4700)]  # two rounds of blocks
    rows += [(i, f"s{i % 21}", None, None, "É A🙂b") for i in range(5000, 5400)]  # more than one run of sources
    rows += [(i, "r17", "en", 1, "Z") for i in range(17)] + [(i, "r256", "en", 1, "Z") for i in range(256)] + [(i, "r257", "en", 1, "Z") for i in range(257)]
    got = check(spark, rows)
    assert not all(r[-1] for r in got) and any(r[-1] for r in got)


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, "", "", 0, ""), (1, "", "x", 1, "A" * 300_000), (1, "", "x", 1, "B"), (1, "", "x", 1, "B"), (1, None, "x", 1, "B"),
            (7, "-", "-", 3, "-"), (-4, "é", "x", 1, "ABC"), (10, "z", "x", 1, "no capitals"), (5, "\U0001f642", "x", 1, "A"), (6, "～", "x", 1, "A")]
    check(spark, rows)
    assert check(spark, rows[:1])[0][4] == sha("")
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_equal_rows_in_large_numbers(spark):
    check(spark, [(3, "hot", "de", 1, "Same")] * 600)


def test_numbers_follow_the_order(spark):
    df = spark.range(3000).selectExpr("case when id % 3 = 0 then 'a' else concat('b', id % 5) end as tree", "(id * 7919) % 3001 as k")
    got = merkle.numbered(df, "tree", ["k"], "test").collect()
    trees = {}
    for r in df.collect():
        trees.setdefault(r["tree"], []).append(r["k"])
    want = {(t, k): (i, len(ks)) for t, ks in trees.items() for i, k in enumerate(sorted(ks))}
    assert {(r["tree"], r["k"]): (r["at"], r["n"]) for r in got} == want
