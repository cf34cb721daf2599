"""Reversible incremental line deduplication.

Exact reference counts (how many documents hold a line key) are kept in a table; a cuckoo filter per shard holds
the fingerprints of the *common* keys, those whose count has reached the threshold. Documents can be inserted and
deleted: the counts move, and a key that crosses the threshold enters or leaves its shard's filter. Only filters of
shards with such keys are rewritten, and one that overflows is rebuilt from the exact table at twice the size.

When lines are dropped, the filter settles nearly all of them without a shuffle; what it lets through is compared
with the exact table, so false positives cost time and never a line.

A key is the line stripped of ASCII white space and with A-Z lower-cased, taken as 128 bits of its SHA-256. A
document is one row. Lines shorter than ``min_chars`` are never dropped. Null and empty text is one empty line. Rows
with equal text have equal results, so that repeated rows and equal or null ids need no care; extra columns pass
through, and columns named like results are replaced. An index over no documents drops nothing. Deleting documents
that were never inserted takes counts to zero or below, where they are forgotten.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridsonde.llm.shared import written

BLANKS = b" \t\n\x0b\x0c\r"
SLOTS = 4  # of a bucket
KICKS = 500
MAX_FILTER_BYTES = 64 << 20  # all filters together, when they are handed to every executor


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """Key of a line in UTF-8; None for lines that always stay."""
    bare = line.strip(BLANKS).lower()  # of bytes: A-Z only
    return hashlib.sha256(bare).digest()[:16] if len(bare) >= min_chars and (min_chars <= 1 or len(bare.decode()) >= min_chars) and bare else None


def text_keys(text: str | None, min_chars: int) -> tuple[list[bytes], list[bytes | None]]:
    """The lines of a text and their keys."""
    lines = (text or "").encode().split(b"\n")
    return lines, [line_key(x, min_chars) for x in lines]


class Cuckoo:
    """Cuckoo filter over 16-byte keys: 16-bit fingerprints, two buckets of four slots each."""

    def __init__(self, slots: np.ndarray) -> None:
        self.slots = slots

    @classmethod
    def sized(cls, keys: int) -> Cuckoo:
        buckets = 4
        while buckets * SLOTS * 0.85 < keys:
            buckets *= 2
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @staticmethod
    def marks(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint (never 0) and both buckets of keys given as an n x 2 array of 64-bit halves."""
        mark = (keys[:, 1] >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        first = (keys[:, 0] & np.uint64(buckets - 1)).astype(np.int64)
        return mark, first, first ^ Cuckoo.shift(mark, buckets)

    @staticmethod
    def shift(mark: np.ndarray, buckets: int) -> np.ndarray:
        return ((mark.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)).astype(np.int64) & (buckets - 1)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        mark, a, b = self.marks(keys, len(self.slots))
        return ((self.slots[a] == mark[:, None]) | (self.slots[b] == mark[:, None])).any(axis=1)

    def insert(self, keys: np.ndarray) -> bool:
        """False if a key found no place; the filter is then to be rebuilt."""
        mark, a, b = self.marks(keys, len(self.slots))
        for f, i, j in zip(mark.tolist(), a.tolist(), b.tolist()):
            for at in (i, j):
                free = np.flatnonzero(self.slots[at] == 0)
                if len(free):
                    self.slots[at, free[0]] = f
                    break
            else:
                for kick in range(KICKS):
                    slot = kick % SLOTS
                    f, self.slots[j, slot] = int(self.slots[j, slot]), f
                    j ^= int(self.shift(np.array([f], np.uint16), len(self.slots))[0])
                    free = np.flatnonzero(self.slots[j] == 0)
                    if len(free):
                        self.slots[j, free[0]] = f
                        break
                else:
                    return False
        return True

    def delete(self, keys: np.ndarray) -> None:
        """Of keys that were inserted."""
        mark, a, b = self.marks(keys, len(self.slots))
        for f, i, j in zip(mark.tolist(), a.tolist(), b.tolist()):
            for at in (i, j):
                own = np.flatnonzero(self.slots[at] == f)
                if len(own):
                    self.slots[at, own[0]] = 0
                    break

    def dump(self) -> bytes:
        return self.slots.tobytes()

    @classmethod
    def load(cls, data: bytes) -> Cuckoo:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())


def _halves(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2) if keys else np.zeros((0, 2), np.uint64)


def _shard(key: Column, shards: int) -> Column:
    """The sixth byte of the key, modulo ``shards`` (256 at most)."""
    return (F.conv(F.hex(F.substring(key, 6, 1)), 16, 10).cast("int") % shards).cast("int")


def _shard_of(halves: np.ndarray, shards: int) -> np.ndarray:
    return ((halves[:, 0] >> np.uint64(40)) & np.uint64(255)).astype(np.int64) % shards


@dataclass(frozen=True)
class LineIndex:
    """``counts``: shard, key, n_docs. ``filters``: shard, data. Every change gives a new index; both its tables are
    stored in the shared folder, and the old ones stay as they were."""

    counts: DataFrame
    filters: DataFrame
    threshold: int
    min_chars: int
    shards: int

    @classmethod
    def empty(cls, spark, threshold: int = 10, min_chars: int = 1, shards: int = 64) -> LineIndex:
        return cls(spark.createDataFrame([], "shard int, key binary, n_docs long"),
                   spark.createDataFrame([], "shard int, data binary"), threshold, min_chars, shards)

    def insert(self, docs: DataFrame, text: str = "text") -> LineIndex:
        return self._changed(docs, text, 1)

    def delete(self, docs: DataFrame, text: str = "text") -> LineIndex:
        return self._changed(docs, text, -1)

    def _changed(self, docs: DataFrame, text: str, sign: int) -> LineIndex:
        least = self.min_chars

        def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [k for t in batch.column(0).to_pylist() for k in {*text_keys(t, least)[1]} if k]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["key"])

        own = docs.select(text).mapInArrow(keys, "key binary")
        none, one = F.lit(0).cast("long"), F.lit(sign).cast("long")
        both = (self.counts.select("key", F.col("n_docs").alias("was"), none.alias("by"))
                .unionByName(own.select("key", none.alias("was"), one.alias("by"))))
        now = both.groupBy("key").agg(F.sum("was").alias("was"), F.sum("by").alias("by"))
        now = now.select(_shard(F.col("key"), self.shards).alias("shard"), "key", "was", (F.col("was") + F.col("by")).alias("n_docs"))
        stored = written(now, "line-counts")
        new = replace(self, counts=stored.where("n_docs > 0").drop("was"))
        least = self.threshold
        crossed = stored.where((F.col("was") >= least) != (F.col("n_docs") >= least)).select(
            "shard", "key", (F.col("n_docs") >= least).alias("enters"))
        return replace(new, filters=written(new._filtered(self.filters, crossed), "line-filters"))

    def common(self) -> DataFrame:
        """Keys found in at least ``threshold`` documents."""
        return self.counts.where(F.col("n_docs") >= self.threshold).select("shard", "key")

    def _filtered(self, old: DataFrame, crossed: DataFrame) -> DataFrame:
        """Filters after the given keys entered or left. A shard is one task's work: its common keys only, spread
        evenly over ``shards`` by hash."""
        schema = "shard int, data binary, failed boolean"

        def update(pdf_old: pd.DataFrame, pdf_new: pd.DataFrame) -> pd.DataFrame:
            if not len(pdf_new):
                return pdf_old.assign(failed=False)[["shard", "data", "failed"]]
            enters = pdf_new[pdf_new["enters"]]["key"].tolist()
            leaves = pdf_new[~pdf_new["enters"]]["key"].tolist()
            f = Cuckoo.load(pdf_old["data"].iloc[0]) if len(pdf_old) else Cuckoo.sized(2 * len(enters))
            f.delete(_halves(leaves))
            ok = f.insert(_halves(enters))
            return pd.DataFrame({"shard": [int(pdf_new["shard"].iloc[0])], "data": [f.dump()], "failed": [not ok]})

        def rebuild(pdf: pd.DataFrame) -> pd.DataFrame:
            keys = _halves(pdf["key"].tolist())
            size = 2 * len(keys)
            while not (f := Cuckoo.sized(size)).insert(keys):
                size *= 2
            return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "data": [f.dump()]})

        changed = written(old.groupBy("shard").cogroup(crossed.groupBy("shard")).applyInPandas(update, schema), "line-filters-try")
        good = changed.where("not failed").drop("failed")
        full = changed.where("failed").select("shard")
        again = self.common().join(full, "shard", "left_semi").groupBy("shard").applyInPandas(rebuild, "shard int, data binary")
        return good.unionByName(again)

    def _shared_filters(self) -> dict[int, Cuckoo] | None:
        """All filters, if together they are small enough to be handed to every executor."""
        size = self.filters.agg(F.sum(F.length("data"))).first()[0] or 0
        if size > MAX_FILTER_BYTES:
            return None
        return {r["shard"]: Cuckoo.load(r["data"]) for r in self.filters.toLocalIterator()}

    def drop_lines(self, docs: DataFrame, text: str = "text", into: str = "kept_text") -> DataFrame:
        """Adds n_lines, n_dropped and the text without lines of common keys (in ``into``)."""
        new = ("n_lines", "n_dropped", into)
        base = docs.select([F.col(text).alias("__text"), *(c for c in docs.columns if c not in new)])
        asked = written(self._asked(base), "line-asked")
        some = asked.where(F.size("__maybe") > 0)
        # Per distinct text the common keys it holds, from the exact table.
        digest = F.sha2(F.coalesce("__text", F.lit("")), 256)
        pairs = some.select(digest.alias("__digest"), F.explode("__maybe").alias("key")).distinct()
        found = pairs.join(self.common().select("key"), "key").groupBy("__digest").agg(F.collect_set("key").alias("__common"))
        # Stored, so that the join below reads two plain tables and copies of one text can be split among tasks.
        found = written(found, "line-common")
        hit = some.withColumn("__digest", digest).drop("__maybe").join(found, "__digest", "left").drop("__digest")
        rest = asked.where(F.size("__maybe") == 0)
        rest = rest.withColumn("n_dropped", F.lit(0).cast("long")).withColumn(into, F.coalesce("__text", F.lit("")))
        order = [*(c for c in base.columns if c != "__text"), *new]
        return self._without(hit, into).select(order).unionByName(rest.select(order))

    def _asked(self, base: DataFrame) -> DataFrame:
        """Adds n_lines and the distinct keys of each row that the filters let through (all keys, if the filters are too
        large to be handed out)."""
        filters = self._shared_filters()
        shared, shards, least = base.sparkSession.sparkContext.broadcast(filters), self.shards, self.min_chars
        schema = T.StructType([*base.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("__maybe", T.ArrayType(T.BinaryType()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sizes, keys = [], []
                for t in batch.column("__text").to_pylist():
                    own = text_keys(t, least)[1]
                    sizes.append(len(own))
                    keys.append([*dict.fromkeys(k for k in own if k)])
                maybe = keys if shared.value is None else _let_through(keys, shared.value, shards)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64()), pa.array(maybe, pa.list_(pa.binary()))], schema.names)

        return base.mapInArrow(run, schema)

    def _without(self, hit: DataFrame, into: str) -> DataFrame:
        """Adds n_dropped and the text without the lines whose keys are in ``__common``."""
        least = self.min_chars
        schema = T.StructType([*hit.schema.fields, T.StructField("n_dropped", T.LongType()), T.StructField(into, T.StringType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dropped, texts = [], []
                for t, common in zip(batch.column("__text").to_pylist(), batch.column("__common").to_pylist()):
                    gone, (lines, keys) = set(common or ()), text_keys(t, least)
                    kept = [x for x, k in zip(lines, keys) if k not in gone]
                    dropped.append(len(lines) - len(kept))
                    texts.append(b"\n".join(kept).decode())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dropped, pa.int64()), pa.array(texts, pa.string())], schema.names)

        return hit.mapInArrow(run, schema)


def _let_through(keys: list[list[bytes]], filters: dict[int, Cuckoo], shards: int) -> list[list[bytes]]:
    """Of each list the keys that their shards' filters hold."""
    flat = [k for own in keys for k in own]
    if not flat or not filters:
        return [[] for _ in keys]
    halves = _halves(flat)
    where, hit = _shard_of(halves, shards), np.zeros(len(flat), bool)
    for s in np.unique(where).tolist():
        if s in filters:
            own = where == s
            hit[own] = filters[s].holds(halves[own])
    passed, at, out = hit.tolist(), 0, []
    for own in keys:
        out.append([k for k, ok in zip(own, passed[at:at + len(own)]) if ok])
        at += len(own)
    return out
