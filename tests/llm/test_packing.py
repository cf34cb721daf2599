import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from gridsonde.llm import packing
from gridsonde.llm.queries import BYTE_PATH


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(BYTE_PATH)


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def verify(rows, docs, length=1024):
    """Every id of every document in exactly one piece, windows gapless, their sizes full or a power of two."""
    pieces, windows = {}, {}
    for r in rows:
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
        windows.setdefault(r["sequence_id"], []).append(r)
    sizes = []
    for w in windows.values():
        at = 0
        for r in sorted(w, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= length
        sizes.append(at)
    for doc_id, ids in docs:
        mine, at = sorted(pieces[doc_id, len(ids)], key=lambda r: r["start"]), 0
        for r in mine:
            assert r["start"] == at
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at:at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    assert sum(sizes) == sum(len(ids) for _, ids in docs)
    return sizes


def test_every_id_lies_in_one_piece(spark, tokenizer):
    rng = random.Random(1)
    texts = [None, "", " ", "a  b", "x <|endoftext|> y", "Été 日本 🙂\n\n\t z", "word " * 30_000, "a" * 50_000] + [
        " ".join(rng.choice(["alpha", "beta", "gammadelta", "é", "7"]) for _ in range(rng.randint(0, 2500))) for _ in range(150)]
    rows = [(i, t, "x", 3) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, offset string, start int").repartition(3)
    got = packing.packed(df, BYTE_PATH).collect()
    sizes = verify(got, [(i, ids_of(tokenizer, t)) for i, t in enumerate(texts)])
    assert all(s == 1024 or s & (s - 1) == 0 for s in sizes)
    assert sum(s != 1024 for s in sizes) <= 3 * 10


def test_repeated_null_and_no_rows(spark, tokenizer):
    schema = "doc_id long, text string"
    got = packing.packed(spark.createDataFrame([(None, "one two"), (1, None)], schema).coalesce(1), BYTE_PATH).collect()
    verify(got, [(None, ids_of(tokenizer, "one two")), (1, [0])])
    same = packing.packed(spark.createDataFrame([(1, "one two")] * 5, schema).coalesce(1), BYTE_PATH).collect()
    assert sum(r["length"] for r in same) == 5 * len(ids_of(tokenizer, "one two"))
    assert packing.packed(spark.createDataFrame([], schema), BYTE_PATH).collect() == []


def test_level_is_the_one_of_least_squares():
    rng = random.Random(2)
    for _ in range(200):
        p = packing.Packer(16, 1000)
        for k in range(rng.randint(0, 40)):
            size = rng.randint(1, 15)
            costs = {}
            for level in [h for h in range(1, 17 - size) if p.count[h]] + [0]:
                n = p.count.copy()
                n[level] -= level > 0
                n[level + size] += level + size < 16
                costs[level] = int((n[1:16] ** 2).sum())
            least = min(costs.values())
            assert p.level_for(size) == max(h for h in costs if costs[h] == least)
            p.add(k, b"\0\0\0\0" * size)


@pytest.mark.parametrize("limit", [3, 50])
def test_open_windows_are_bounded(limit):
    p, rng, out = packing.Packer(64, limit), random.Random(3), []
    docs = [(k, list(range(rng.randint(1, 200)))) for k in range(400)]
    for k, ids in docs:
        out += p.add((k, len(ids)), np.array(ids, "<u4").tobytes())
        assert p.open <= limit
    out += p.finish()
    rows = [{"doc_id": k, "start": s, "length": len(b) // 4, "ids_crc32": zlib.crc32(b), "doc_tokens": n, "sequence_id": q, "offset": at} for (k, n), s, b, q, at in out]
    sizes = verify(rows, docs, 64)
    assert sum(s != 64 for s in sizes) <= 6


def test_fast_ids_are_the_tokenizers(tokenizer):
    encode, rng = packing.Encoder(BYTE_PATH), random.Random(4)
    assert encode.ranked is not None
    letters = [*" ab\n\t.'s1é\x1c\x85\xa0 ​́語’", "<|endoftext|>", "'ll", "'S", "  "]
    for _ in range(3000):
        text = "".join(rng.choices(letters, k=rng.randint(0, 40)))
        assert encode(text) == np.array(ids_of(tokenizer, text)[:-1], "<u4").tobytes()


def test_other_tokenizers_go_through_their_library():
    path = "/opt/tokenizers/word_bpe_49k.json"
    encode = packing.Encoder(path)
    assert encode.ranked is None
    assert encode("Hello, World") == np.array(Tokenizer.from_file(path).encode("Hello, World", add_special_tokens=False).ids, "<u4").tobytes()
