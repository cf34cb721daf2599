import os
import random

import pytest
import sentencepiece

from gridsonde.llm import pieces

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
pytestmark = pytest.mark.skipif(not os.path.exists(MODEL), reason="vocabulary file not present")


def texts():
    rng = random.Random(2)
    letters = "aaabe hettion  sing.ñé\n\t▁世界🙂x\x00"
    out = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    return out + ["", " ", "\n", "   \n\n ", "a" * 5000, "the " * 4000, "▁", "Ünïcödé 👩‍👩‍👧 text", "x\r\ny"]


def test_ids_equal_the_library_and_decode(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = [(k, t, "old", 0.5) for k, t in enumerate(texts())] + [(None, None, None, None), (3, "again", None, 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded double")
    out = pieces.encode(df, MODEL, decoded="decoded")
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        want = library.encode(r["text"] or "")
        assert r["ids"] == want
        assert r["decoded"] == library.decode(want)
        if "▁" not in (r["text"] or ""):
            assert r["decoded"] == (r["text"] or "")
    again = {(r["doc_id"], r["text"]): r["decoded"] for r in pieces.decode(out.drop("decoded"), MODEL).collect()}
    assert again == {(r["doc_id"], r["text"]): r["decoded"] for r in got}
    assert pieces.encode(df.limit(0), MODEL).collect() == []
    same = pieces.encode(df.select("doc_id", "text"), MODEL, ids="text").collect()
    assert same[0]["text"] == library.encode(rows[0][1])


def test_whole_documents_are_spelt_again(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = pieces.encoded_documents(docs, MODEL).collect()
    assert len(rows) == docs.count() and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in rows)


def test_spines_settle_pairs_as_the_rules_do():
    m = pieces.Transducer(pieces.read_model(MODEL))
    rng, names = random.Random(3), list(pieces.Transducer(pieces.read_model(MODEL)).score)
    for _ in range(6000):
        left, right = rng.choice(names), rng.choice(names)
        assert m._stand(left, right) == (m._derived(left + right)[0] == [left, right])
    rules = {"a": -1, "b": -1, "c": -1, "ab": -2, "bc": -2, "abc": -3, "ca": -3, "aa": -2, "aab": -2, "bca": -4, "cab": -2, "abca": -1}  # equal and rising scores
    m = pieces.Transducer(_model([("<unk>", 0.0, 2), *[(f"<0x{b:02X}>", 0.0, pieces.BYTE) for b in range(256)], *[(p, s, 1) for p, s in rules.items()]], pieces.PAIRS))
    for left in rules:
        for right in rules:
            assert m._stand(left, right) == (m._derived(left + right)[0] == [left, right]), (left, right)
    for _ in range(300):
        text = "".join(rng.choices("abcd", k=rng.randint(1, 12)))
        want = [m.ids[p] if p in m.ids else m.bytes_ids[100] for part in text.replace("d", " d ").split() for p in m._derived(part)[0]]
        assert m._finite_path(text) == want, text


def _model(entries, kind):
    """A small model file: (piece, score, type) entries."""
    import struct

    def field(number, data):
        return bytes([number << 3 | 2, len(data)]) + data

    out = b"".join(field(1, field(1, p.encode()) + b"\x15" + struct.pack("<f", s) + bytes([3 << 3, t])) for p, s, t in entries)
    return out + field(2, bytes([3 << 3, kind])) + field(3, bytes([3 << 3, 1, 4 << 3, 0]))


def test_unigram_models_take_the_cheapest_path():
    bytes_ = [(f"<0x{b:02X}>", 0.0, pieces.BYTE) for b in range(256)]
    entries = [("<unk>", 0.0, 2), *bytes_, ("▁", -2.0, 1), ("a", -3.0, 1), ("b", -3.5, 1), ("ab", -4.0, 1), ("▁ab", -7.5, 1), ("ba", -2.5, 1)]
    m = pieces.Transducer(_model(entries, pieces.UNIGRAM))
    spell = lambda t: [m.pieces[i] for i in __import__("numpy").frombuffer(m.encode(t), "i4")]
    assert spell("ab") == ["▁", "ab"]  # 6.0 beats 7.5 and 8.5
    assert spell("aba") == ["▁", "a", "ba"]  # 7.5 beats 9.0
    assert spell("é") == ["▁", "<0xC3>", "<0xA9>"]
