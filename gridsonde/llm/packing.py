"""Packing of tokenised documents into windows by the sum-of-squares rule.

Method. A document is its ids followed by an end id. Whole windows are cut off first; the rest of s ids goes online to the
fill level at which the sum over levels of the squared count of partly filled windows becomes least. The counts are a level
array: a step from level h to h + s changes the sum by 2 (count[h + s] - count[h]) + 2, a step that fills a window by
1 - 2 count[h], a new window by 2 count[s] + 1; of equal steps the fullest level wins. Every task packs the documents it
reads, in the order read, so nothing is shuffled. A window is given out once it is full.

End of a task, or ``OPEN`` partly filled windows: the open ones are emptied into each other, emptiest into fullest, cutting
documents where needed, until one is left. At the end that one is cut at powers of two, so that no window needs padding.

Ids are those of the tokenizer file at ``path``, special tokens inside a text counted as the file's library counts them.

Odd cases: a null or empty text is its end id alone. Repeated rows and rows without an id are packed like any other. Very long
texts are encoded whole. Ties are settled as above. An empty table gives no rows. Other columns are ignored.
``sequence_id`` holds the task's number in its upper bits; a task that is run again gives the same rows.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH, OPEN = 1024, 4096
# Fixed value: the word pattern of byte-level pre-tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RUN = re.compile(r"\S{20000}|\s{20000}")
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Ids of a text as little-endian 32-bit words, as the tokenizer file says.

    A byte-level file whose merges stand in the order of their ids is the same thing as a list of ranks, which the other library
    encodes several times faster; whether it is one is checked on loading. Any other file goes through its own library, and so
    does a text with a very long run without a word's end."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.ranked = Tokenizer.from_file(path), None
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, split = told["model"], told.get("pre_tokenizer") or {}
        vocab, merges = model.get("vocab"), [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", [])]
        special = {t["content"]: t["id"] for t in told["added_tokens"] if not (t["lstrip"] or t["rstrip"] or t["single_word"])}
        plain = {w: i for w, i in vocab.items() if w not in special} if isinstance(vocab, dict) else {}
        if (told["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
                and model["type"] == "BPE" and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix") and not model.get("ignore_merges")
                and len(special) == len(told["added_tokens"]) and len(plain) == 256 + len(merges)
                and all(plain.get(a + b) == 256 + i for i, (a, b) in enumerate(merges))):
            import tiktoken

            byte = byte_letters()
            self.ranked = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={bytes(byte[c] for c in w): i for w, i in plain.items()},
                                            special_tokens=special)

    def __call__(self, text: str) -> bytes:
        if self.ranked is None or RUN.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.ranked.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level tokenizer files write bytes: printable ones as they are, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = (b for b in range(256) if b not in set(shown))
    return {**{chr(b): b for b in shown}, **{chr(256 + n): b for n, b in enumerate(hidden)}}


class Packer:
    """Windows of one task. ``add`` and ``finish`` return the pieces of windows that are closed: (key, start, ids, sequence, offset)."""

    def __init__(self, length: int = LENGTH, open_limit: int = OPEN):
        self.length, self.limit = length, open_limit
        self.count = np.zeros(length + 1, np.int64)  # the level array; the last entry, full windows, stays 0
        self.levels: list[list[list]] = [[] for _ in range(length)]
        self.open = self.sequence = 0

    def _closed(self, window: list) -> list[tuple]:
        at, out = 0, []
        for key, start, ids in window:
            out.append((key, start, ids, self.sequence, at))
            at += len(ids) // 4
        self.sequence += 1
        return out

    def _put(self, level: int, window: list) -> None:
        self.levels[level].append(window)
        self.count[level] += 1
        self.open += 1

    def _take(self, level: int) -> list:
        self.count[level] -= 1
        self.open -= 1
        return self.levels[level].pop()

    def level_for(self, size: int) -> int:
        """The fill level at which ``size`` ids make the sum of squares least; 0 is a new window."""
        last = self.length - size
        here, there = self.count[1:last + 1], self.count[1 + size:self.length + 1]
        change = np.where(here > 0, 2 * (there - here) + 2, np.iinfo(np.int64).max)
        if here[-1] > 0:
            change[-1] = 1 - 2 * here[-1]
        best = last - 1 - int(np.argmin(change[::-1]))
        return best + 1 if change[best] <= 2 * self.count[size] + 1 else 0

    def add(self, key: object, ids: bytes) -> list[tuple]:
        out, step = [], 4 * self.length
        whole = len(ids) // step * step
        for at in range(0, whole, step):
            out += self._closed([(key, at // 4, ids[at:at + step])])
        size = (len(ids) - whole) // 4
        if size:
            level = self.level_for(size)
            window = self._take(level) if level else []
            window.append((key, whole // 4, ids[whole:]))
            if level + size == self.length:
                out += self._closed(window)
            else:
                self._put(level + size, window)
                if self.open > self.limit:
                    out += self._emptied()
        return out

    def _emptied(self) -> list[tuple]:
        """Open windows emptied into each other until at most one is left."""
        ordered = [(level, w) for level in range(self.length - 1, 0, -1) for w in self.levels[level]]
        for level in range(1, self.length):
            self.levels[level] = []
        self.count[:], self.open = 0, 0
        out, front, back, rest = [], 0, len(ordered) - 1, []
        level, window = ordered[0] if ordered else (0, [])
        while front < back or rest:
            if not rest:
                rest = ordered[back][1][::-1]
                back -= 1
            key, start, ids = rest.pop()
            room = 4 * (self.length - level)
            window.append((key, start, ids[:room]))
            level += len(window[-1][2]) // 4
            if len(ids) > room:
                rest.append((key, start + room // 4, ids[room:]))
            if level == self.length:
                out += self._closed(window)
                front += 1
                level, window = ordered[front] if front <= back else (0, [])
        if window:
            self._put(level, window)
        return out

    def finish(self) -> list[tuple]:
        out = self._emptied()
        for level in range(1, self.length):
            for window in self.levels[level]:
                size = 1 << (level.bit_length() - 1)
                part, room = [], size
                while window:
                    key, start, ids = window.pop(0)
                    part.append((key, start, ids[:4 * room]))
                    if len(ids) > 4 * room:
                        window.insert(0, (key, start + room, ids[4 * room:]))
                    room -= len(part[-1][2]) // 4
                    if not room:
                        out += self._closed(part)
                        level -= size
                        size = 1 << max(level.bit_length() - 1, 0)
                        part, room = [], size
        return out


def packed(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = 0, open_limit: int = OPEN) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of every document (doc_id, text)."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = Encoder(path), Packer(length, open_limit)
        high, names = TaskContext.get().partitionId() << 40, [x.split()[0] for x in SCHEMA.split(", ")]
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            table = [(key[0], start, len(ids) // 4, zlib.crc32(ids), key[1], high + sequence, at) for key, start, ids, sequence, at in rows]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*table)], names=names)

        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(1)):
                ids = encode(text.as_py()) + end
                rows += packer.add((doc_id.as_py(), len(ids) // 4), ids)
                if len(rows) >= 2000:
                    yield batch()
        rows += packer.finish()
        if rows:
            yield batch()

    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))).mapInArrow(run, SCHEMA)
