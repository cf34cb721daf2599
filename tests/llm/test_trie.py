import hashlib
import random
import zlib

import pytest

from gridsonde.llm import trie

SCHEMA = "conv_id long, turn int, role string, text string, node string, shard int, depth string"


def brute(rows):
    """Every prefix of every rebuilt conversation in a dictionary."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    built = {c: own.get(c - c % 5, [])[:zlib.crc32(str(c).encode()) % 9] + own[c][zlib.crc32(str(c).encode()) % 9:] for c in own}
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for node, cs in members.items():
        below = [n for n in members if n[:len(node)] == node]
        kids = {n[:len(node) + 1] for n in below if len(n) > len(node)}
        parents = {n[:k] for n in members for k in range(len(n))}
        ends = sorted(c for c in cs if len(built[c]) == len(node))
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(kids), sum(n not in parents for n in below),
                    sum((len(members[n]) - 1) * (len(n[-1][1].encode()) if n else 0) for n in below), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows, families):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    got = sorted(map(tuple, trie.nodes(df, families).collect()), key=str)
    assert got == brute(rows)


@pytest.mark.parametrize("families", [1, 3, 200])
def test_equals_prefixes(spark, families):
    rng = random.Random(families)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "b", "é"])) for c in range(60) for t in range(rng.randint(1, 5))]
    rows += [(c, t, "user", f"long {t}") for c in (61, 66, 67, 90) for t in range(12)]
    rows += [(c, t, "user", "same") for c in range(100, 160) for t in range(10)]
    rng.shuffle(rows)
    check(spark, rows, families)


@pytest.mark.parametrize("families", [1, 200])
def test_odd_rows(spark, families):
    rows = [(1, None, None, None), (1, 0, "user", ""), (1, 2, "", "x" * 200_000), (2, 0, None, "a"), (2, 0, None, "a"), (3, 5, "u", None), (None, 1, "u", "lost"),
            (7, 0, "u", "no first of its family"), (8, 0, "u", "nor here"), (-4, 0, "u", "a"), (-5, 0, "u", "b"), (10**15, 0, "u", "b"), (10**15 + 4, 0, "u", "b")]
    check(spark, rows, families)
    assert trie.nodes(spark.createDataFrame([], SCHEMA), families).collect() == []


def test_walk_intersects_bitsets():
    convs = {3: [(b"a", 1), (b"b", 1)], 5: [(b"a", 1)], 9: [(b"a", 1), (b"c", 2)]}
    got = [(up, depth, members, ended) for up, _, depth, members, ended, _, _ in trie.walk(convs)]
    assert got == [(-1, 0, 0b111, 0), (0, 1, 0b111, 0b010), (1, 2, 0b100, 0b100), (1, 2, 0b001, 0b001)]
