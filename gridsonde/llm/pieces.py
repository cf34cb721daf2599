"""SentencePiece encoding and decoding as a weighted finite-state transducer.

A model is compiled into three machines: the normaliser (a space becomes the visible space, one is put in
front), the piece machine (a prefix tree whose arcs write piece ids) and the byte fallback (a character that no
piece spells writes one id per UTF-8 byte). Each input is composed with them into a lattice, and the
tropical-semiring shortest path through it is the encoding.

Arc weights. In a unigram model an arc costs the negated log probability of its piece. A byte-pair model has no
such costs: its segmentation is the only one in which every neighbouring pair of pieces, merged on its own by the
pair rules, comes out as that same pair. So the piece machine also remembers the last piece, and an arc costs 0
if the pair stands and infinity if it does not; each position of the lattice then has one finite state.

Whether a pair stands is compiled as well: every piece keeps its two spines, the symbols that stood at its edges while the
rules made it, and a pair is settled by walking the right spine of the one and the left spine of the other.

Results in odd cases: null text gives no ids, as empty text does; a text of blanks gives
their pieces. Texts of any length are encoded whole. Of equally cheap unigram paths the one whose last piece starts first is
taken; byte-pair paths have no ties. Repeated rows are encoded alike, an empty table gives no rows, other columns pass through
and columns named like results are replaced.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, PAIRS = 1, 2
INF = float("inf")
MAX_MODEL_BYTES = 64 << 20


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protocol buffer message."""
    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            n, at = varint(at)
            value, at = data[at:at + n], at + n
        elif kind == 5:
            value, at = struct.unpack_from("<f", data, at)[0], at + 4
        elif kind == 1:
            value, at = struct.unpack_from("<d", data, at)[0], at + 8
        else:
            raise ValueError("not a SentencePiece model")
        yield tag >> 3, value


class Transducer:
    """The compiled machines of one model. Its caches are bounded."""

    CACHE_PAIRS, CACHE_CHARS = 300_000, 3_000_000

    def __init__(self, model: bytes) -> None:
        self.pieces: list[str] = []
        self.score: dict[str, float] = {}
        self.bytes_ids, self.kinds = [0] * 256, []
        self.kind, self.dummy, self.collapse, self.escape = UNIGRAM, True, True, True
        ids: dict[str, int] = {}
        scores = []
        for number, value in _fields(model):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in _fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = v
                    elif n == 3:
                        kind = v
                if kind in (USER, UNUSED):
                    raise ValueError("user-defined and unused pieces are not supported")
                if kind == NORMAL:
                    ids[piece], self.score[piece] = len(self.pieces), score
                    scores.append(score)
                elif kind == BYTE:
                    self.bytes_ids[int(piece[3:5], 16)] = len(self.pieces)
                self.pieces.append(piece)
                self.kinds.append(kind)
            elif number == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                rules = dict(_fields(value))
                if rules.get(2):
                    raise ValueError("a normaliser with a character map is not supported")
                self.dummy, self.collapse, self.escape = (bool(rules.get(k, 1)) for k in (3, 4, 5))
        if self.kind not in (UNIGRAM, PAIRS) or BYTE not in self.kinds:
            raise ValueError("a unigram or byte-pair model with byte fallback is needed")
        self.fallback = 10.0 - min(scores, default=0.0)
        self.arcs: dict[str, int] = {}  # each prefix of a piece; the id if it is a piece, else -1
        for piece in ids:
            for k in range(1, len(piece)):
                self.arcs.setdefault(piece[:k], -1)
        self.arcs.update(ids)
        self.ids = ids
        sizes: dict[str, set[int]] = {}
        for piece in ids:
            sizes.setdefault(piece[-3:], set()).add(len(piece))
        # Lengths of the pieces that end in three given characters, the likeliest first; only one of them can stand.
        self.sizes = {end: (2, 3, 1, *sorted(found - {1, 2, 3})) for end, found in sizes.items() if len(end) == 3}
        alphabet = {c for p in ids for c in p}
        self.single = {c for c in alphabet if c in ids}
        cut = "\n" not in alphabet
        inner = any(SPACE in p.lstrip(SPACE) for p in ids)
        # No piece crosses such a boundary, so that the stretches between them can be encoded one by one.
        self.stretches = re.compile(".+" if inner else r"▁*[^▁\n]+|▁+|\n" if cut else r"▁*[^▁]+|▁+", re.S).findall
        self.done: dict[str, bytes] = {}
        self.held = 0
        self.stands: dict[int, bool] = {}
        self.spines: dict[str, tuple[list, list] | None] = {}
        self.decoded: list[bytes] = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else
                                     p.replace(SPACE, " ").encode() if self.escape else p.encode() for p, k in zip(self.pieces, self.kinds)]

    def normalise(self, text: str) -> str:
        if self.collapse:
            text = re.sub(" +", " ", text.strip(" "))
        if self.dummy and text:
            text = " " + text
        return text.replace(" ", SPACE) if self.escape else text

    def _derived(self, text: str) -> tuple[list[str], list[tuple[str, str, float]]]:
        """The pair rules run on a string alone, always the best-scored pair, the leftmost of equals: what is left, and the merges (left, right, score)."""
        parts, score, merges = list(text), self.score, []
        while len(parts) > 1:
            found = [(score[p], -k) for k, p in enumerate(map("".join, zip(parts, parts[1:]))) if p in score]
            if not found:
                break
            best, k = max(found)
            merges.append((parts[-k], parts[1 - k], best))
            parts[-k:2 - k] = [parts[-k] + parts[1 - k]]
        return parts, merges

    def _compiled(self, piece: str) -> tuple[list, list] | None:
        """The left and the right spine of a piece: the symbols that stood at that edge while the rules made it, each with the score of the
        merge that took it up. None if the rules do not make the piece, empty spines if its merges do not come in falling scores."""
        parts, merges = self._derived(piece)
        if parts != [piece]:
            return None
        scores = [s for _, _, s in merges]
        if any(b > a for a, b in zip(scores, scores[1:])):
            return [], []
        left, right = [], []
        tree = {a + b: (a, b, s) for a, b, s in merges}
        spine = piece
        while spine in tree:
            a, _, s = tree[spine]
            left.append((a, s))
            spine = a
        spine = piece
        while spine in tree:
            _, b, s = tree[spine]
            right.append((b, s))
            spine = b
        return [*left[::-1], (piece, -INF)], [*right[::-1], (piece, -INF)]

    def _spines(self, piece: str) -> tuple[list, list] | None:
        if piece not in self.spines:  # at most one entry a piece
            self.spines[piece] = self._compiled(piece)
        return self.spines[piece]

    def _remembered(self, key: int, left: str, right: str) -> bool:
        if len(self.stands) >= self.CACHE_PAIRS:
            self.stands.clear()
        self.stands[key] = self._stand(left, right)
        return self.stands[key]

    def _stand(self, left: str, right: str) -> bool:
        """Whether an arc ``right`` costs 0 after ``left`` (empty: the start) and not infinity: no merge ever crosses the edge. Two symbols meet there until the better of the merges that take them up; the right edge of the one
        piece and the left edge of the other pass in that order, so a few look-ups replace the merges of both."""
        own = self._spines(right)
        if own is None or not left:
            return own is not None
        other = self._spines(left)
        if other is None:
            return False
        xs, ys = other[1], own[0]
        if not xs or not ys:
            return self._derived(left + right)[0] == [left, right]
        score, i, j = self.score, 0, 0
        while True:
            (x, taken), (y, taken_too) = xs[i], ys[j]
            across = score.get(x + y)
            if across is not None and across > taken and across >= taken_too:
                return False
            if taken >= taken_too:
                if taken == -INF:
                    return True
                i += 1
            else:
                j += 1

    def _written(self, text: str) -> list[int]:
        """Ids of one arc: a piece, or the bytes of a character without one."""
        found = self.arcs.get(text, -1)
        return [found] if found >= 0 else [self.bytes_ids[b] for b in text.encode("utf-8", "surrogatepass")]

    def _finite_path(self, text: str) -> list[int]:
        """Shortest path where arcs cost 0 or infinity. The beginning of a text has one encoding, so a position has one finite state, the piece
        that ends there: the one that stands beside the state it starts from. One pass forward finds the states, one back reads the path."""
        ids, stands, sizes, pieces, start = self.ids, self.stands, self.sizes, self.pieces, len(self.pieces)
        n = len(text)
        states = [start] * (n + 1)
        for end in range(1, n + 1):
            if text[end - 1] not in self.single:
                continue
            for size in sizes.get(text[end - 3:end], (2, 1)) if end > 2 else (2, 1):
                i = end - size
                if i >= 0:
                    piece = text[i:end]
                    found = ids.get(piece)
                    if found is not None:
                        key = states[i] * start + found
                        stand = stands.get(key)
                        if stand is None:
                            stand = self._remembered(key, "" if states[i] == start else pieces[states[i]], piece)
                        if stand:
                            states[end] = found
                            break
        out, end = [], n
        while end:
            found = states[end]
            if found == start:
                out += reversed(self._written(text[end - 1]))
                end -= 1
            else:
                out.append(found)
                end -= len(pieces[found])
        return out[::-1]

    def _cheapest_path(self, text: str) -> list[int]:
        """Shortest path over the lattice of a unigram model."""
        n, arcs, score = len(text), self.arcs, self.score
        cost, start = [0.0] + [INF] * n, [-1] * (n + 1)
        for i in range(n):
            here = cost[i]
            if text[i] not in self.single and here + self.fallback < cost[i + 1]:
                cost[i + 1], start[i + 1] = here + self.fallback, i
            for j in range(i + 1, n + 1):
                found = arcs.get(text[i:j])
                if found is None:
                    break
                if found >= 0 and here - score[text[i:j]] < cost[j]:
                    cost[j], start[j] = here - score[text[i:j]], i
        cuts = [n]
        while cuts[-1] > 0:
            cuts.append(start[cuts[-1]])
        cuts.reverse()
        return [k for a, b in zip(cuts, cuts[1:]) for k in self._written(text[a:b])]

    def shortest_path(self, text: str) -> tuple[int, ...]:
        """Ids on the cheapest path through the lattice of ``text`` (already normalised)."""
        return tuple(self._finite_path(text) if self.kind == PAIRS else self._cheapest_path(text))

    def encode(self, text: str) -> bytes:
        """Ids of a text as consecutive 32-bit integers."""
        parts = self.stretches(self.normalise(text))
        done = self.done
        new = set(parts).difference(done)
        if new:
            if self.held > self.CACHE_CHARS:
                done.clear()
                self.held, new = 0, set(parts)
            self.held += sum(map(len, new))
            for part in new:
                ids = self.shortest_path(part)
                done[part] = struct.pack(f"={len(ids)}i", *ids)
        return b"".join(map(done.__getitem__, parts))

    def decode(self, ids: list[int]) -> str:
        table = self.decoded
        text = b"".join([table[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.dummy and text[:1] == " " else text


_compiled: dict[bytes, Transducer] = {}


def _transducer(model: bytes) -> Transducer:
    """One per Python worker."""
    if model not in _compiled:
        _compiled.clear()
        _compiled[model] = Transducer(model)
    return _compiled[model]


def read_model(path: str) -> bytes:
    """Model bytes, read on the driver; their size is checked because every executor gets them."""
    with open(path, "rb") as f:
        model = f.read(MAX_MODEL_BYTES + 1)
    if len(model) > MAX_MODEL_BYTES:
        raise ValueError("the model is too large to be handed to every executor")
    return model


def encode(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Adds the piece ids of every whole text as array<int>, and in ``decoded`` (if named) the text they spell.
    No shuffle; columns of the same names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(read_model(model_path))
    more = [T.StructField(ids, T.ArrayType(T.IntegerType(), False))]
    if decoded:
        more.append(T.StructField(decoded, T.StringType()))
    out = docs.select([c for c in docs.columns if c == text or c not in (ids, decoded)])
    schema = T.StructType([*(f for f in out.schema.fields if f.name not in (ids, decoded)), *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _transducer(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = batch.column(text).to_pylist()
                coded = [machine.encode(t) if t else b"" for t in texts]
                offsets = np.cumsum([0, *map(len, coded)]) // 4
                columns = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(coded), "=i4")))]
                if decoded:
                    columns.append(pa.array([machine.decode(np.frombuffer(c, "=i4").tolist()) for c in coded], pa.string()))
                kept = [k for k, name in enumerate(batch.schema.names) if name not in (ids, decoded)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), *columns], schema.names)

    return out.mapInArrow(run, schema)


def decode(encoded: DataFrame, model_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds the text that ids spell (null for null ids)."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_model(model_path))
    out = encoded.drop(text)
    schema = T.StructType([*out.schema.fields, T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _transducer(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [None if x is None else machine.decode(x) for x in batch.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, text])

    return out.mapInArrow(run, schema)


def encoded_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids and whether the ids spell the text again."""
    both = encode(docs.select("doc_id", "text"), model_path, decoded="decoded")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
                       F.coalesce(F.col("decoded") == F.coalesce("text", F.lit("")), F.lit(False)).alias("round_trip"))
