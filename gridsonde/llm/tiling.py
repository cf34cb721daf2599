"""Benchmark decontamination by greedy string tiling.

Words are lower-cased runs of letters and digits. Seeds are runs of ``min_match`` words that a document shares with
a benchmark item; they are found by hash and compared word by word. A pair of document and item whose seeds could
cover enough of the item is tiled: the longest common runs of unmarked words are found by running Karp-Rabin (rolling
hashes of one length at a time, the length found by bisection), marked wherever they do not overlap, and so on down
to ``min_match``. The share of the item's words under tiles is its coverage; since tiles may lie in any order,
reordered passages are caught. A document is contaminated by an item if coverage reaches ``threshold``.

The benchmark goes to every executor only if it has at most ``max_words`` words; a larger one is joined by seed hash.
Both ways give the same rows.

Odd cases: null or empty texts, and texts with fewer words than ``min_match``, match nothing; an item shorter than
``min_match`` is matched as one run of all its words, an item without words never. Repeated items are reported each;
repeated documents too. Null ids are carried through. Of equally long runs the one first in the item, then first in
the document, is marked.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsonde.llm.shared import words

MIN_MATCH, THRESHOLD = 6, 0.5
MAX_WORDS = 2_000_000
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
RESULT = "doc_id long, item_id long, coverage double, n_tiles int, longest int"


def window_hashes(tokens: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of ``length`` tokens, by doubling: a run is two shorter runs side by side."""
    if len(tokens) < length:
        return np.zeros(0, np.uint64)
    out, done = None, 0  # hashes of runs of ``done`` tokens
    block, size, shift = tokens.astype(np.uint64), 1, np.array([BASE])
    while True:
        if length & size:
            if out is None:
                out, done = block, size
            else:
                n = len(tokens) - done - size + 1
                out, done = out[:n] * shift + block[done:done + n], done + size
        if size * 2 > length:
            return out
        n = len(tokens) - 2 * size + 1
        block = block[:n] * shift + block[size:size + n]
        size, shift = size * 2, shift * shift


def _candidates(doc: np.ndarray, item: np.ndarray, free_doc: np.ndarray, free_item: np.ndarray, length: int) -> list[tuple[int, list[int]]]:
    """(start in item, starts in doc) of unmarked runs with equal hashes."""
    def starts(free: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(free)])
        return np.flatnonzero(sums[length:] - sums[:-length] == length)

    at_doc, at_item = starts(free_doc), starts(free_item)
    if not len(at_doc) or not len(at_item):
        return []
    hash_doc, hash_item = window_hashes(doc, length)[at_doc], window_hashes(item, length)[at_item]
    near = np.isin(hash_doc, hash_item)
    by_hash = defaultdict(list)
    for p, h in zip(at_doc[near].tolist(), hash_doc[near].tolist()):
        by_hash[h].append(p)
    return [(q, by_hash[h]) for q, h in zip(at_item.tolist(), hash_item.tolist()) if h in by_hash]


def _equal_run(doc: np.ndarray, item: np.ndarray, q: int, starts: list[int], length: int, free: np.ndarray | None = None) -> int:
    """The first start in the document (unmarked, if ``free`` is given) that is equal word by word; -1: none."""
    return next((p for p in starts if (free is None or free[p] and free[p:p + length].all()) and
                 np.array_equal(item[q:q + length], doc[p:p + length])), -1)


def tile(doc: np.ndarray, item: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Tiles (start in item, start in doc, length) of two token arrays, greedily from the longest.

    Tokens of the document that the item lacks are negative. Every round works on the longest length left."""
    free_doc, free_item = doc >= 0, np.ones(len(item), bool)
    tiles: list[tuple[int, int, int]] = []
    most = min(len(doc), len(item))
    least = max(1, min(min_match, len(item)))
    while most >= least:
        low, high, runs = least - 1, most, []
        while low < high:  # the longest length that still has a common run
            mid = (low + high + 1) // 2
            found = _candidates(doc, item, free_doc, free_item, mid)
            if any(_equal_run(doc, item, q, starts, mid) >= 0 for q, starts in found):
                low, runs = mid, found
            else:
                high = mid - 1
        if low < least:
            break
        for q, starts in runs:
            p = _equal_run(doc, item, q, starts, low, free_doc) if free_item[q:q + low].all() else -1
            if p >= 0:
                free_item[q:q + low] = False
                free_doc[p:p + low] = False
                tiles.append((q, p, low))
        most = low - 1
    return tiles


class Benchmark:
    """Items as token arrays with the hashes of their seeds."""

    def __init__(self, items: list[tuple[object, str | None]], min_match: int) -> None:
        self.min_match, self.vocabulary, self.items = min_match, {}, []
        for item_id, text in items:
            tokens = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)]
            if tokens:
                self.items.append((item_id, np.array(tokens, np.int64)))
        self.lengths = sorted({min(min_match, len(t)) for _, t in self.items})
        seeds: dict[int, list[np.ndarray]] = {n: [[], [], []] for n in self.lengths}
        for k, (_, tokens) in enumerate(self.items):
            n = min(min_match, len(tokens))
            own = window_hashes(tokens, n)
            for column, part in zip(seeds[n], (own, np.full(len(own), k), np.arange(len(own)))):
                column.append(part)
        self.seeds = {}
        for n, (hashes, owners, starts) in seeds.items():
            hashes, owners, starts = map(np.concatenate, (hashes, owners, starts))
            order = np.argsort(hashes, kind="stable")
            self.seeds[n] = hashes[order], owners[order], starts[order]

    def matches(self, text: str | None, threshold: float) -> list[tuple[object, float, int, int]]:
        """(item_id, coverage, tiles, longest tile) of the items that the text covers."""
        get = self.vocabulary.get
        tokens = np.array([get(w, -1) for w in words(text)], np.int64)
        reach: dict[int, set[int]] = defaultdict(set)  # positions of the item that some shared seed covers
        for n, (hashes, owners, starts) in self.seeds.items():
            own = np.unique(window_hashes(tokens, n)) if len(tokens) >= n else np.zeros(0, np.uint64)
            first, last = np.searchsorted(hashes, own), np.searchsorted(hashes, own, "right")
            for a, b in zip(first[last > first].tolist(), last[last > first].tolist()):
                for k, s in zip(owners[a:b].tolist(), starts[a:b].tolist()):
                    reach[k].update(range(s, s + n))
        out = []
        for k, covered in sorted(reach.items()):
            item_id, item = self.items[k]
            if len(covered) < threshold * len(item):  # tiles lie under seeds, so they cannot cover more
                continue
            known = np.isin(tokens, item)
            tiles = tile(np.where(known, tokens, -1), item, self.min_match)
            coverage = sum(t[2] for t in tiles) / len(item)
            if coverage >= threshold:
                out.append((item_id, coverage, len(tiles), max(t[2] for t in tiles)))
        return out


def _rows(found: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(found, columns=["doc_id", "item_id", "coverage", "n_tiles", "longest"]).astype(
        {"doc_id": "Int64", "item_id": "Int64", "coverage": "float64", "n_tiles": "int32", "longest": "int32"})


def contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, threshold: float = THRESHOLD,
                 max_words: int = MAX_WORDS) -> DataFrame:
    """doc_id, item_id, coverage, n_tiles, longest of every document and item where coverage reaches ``threshold``."""
    docs, items = docs.select("doc_id", "text"), benchmark.select("item_id", "text")
    # each word begins at a code point of its own, so code points bound the words of any script
    size = items.agg(F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0))).first()[0]
    if size > max_words:
        return _joined(docs, items, min_match, threshold)
    shared = docs.sparkSession.sparkContext.broadcast([(r["item_id"], r["text"]) for r in items.collect()])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bench = Benchmark(shared.value, min_match)
        for batch in batches:
            yield _rows([(d, *m) for d, t in zip(batch["doc_id"].astype("Int64"), batch["text"]) for m in bench.matches(t, threshold)])

    return docs.mapInPandas(run, RESULT)


def _joined(docs: DataFrame, items: DataFrame, min_match: int, threshold: float) -> DataFrame:
    """The same for a benchmark of any size: a join on seed hashes finds the pairs, tiling judges each."""
    def seeds(of: DataFrame, key: str, lengths: list[int] | None) -> DataFrame:
        """One row for each seed; of its own length for items, of all the lengths that items have for documents."""
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                keys, hashes, sizes = [], [], []
                for k, t in zip(batch["_row"], batch["text"]):
                    tokens = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words(t)], np.uint64)
                    for n in lengths or [min(min_match, len(tokens))]:
                        own = window_hashes(tokens, n) if n and len(tokens) >= n else np.zeros(0, np.uint64)
                        own = np.unique(own) if lengths else own
                        keys += [k] * len(own)
                        hashes.extend(own.view(np.int64).tolist())
                        sizes += [n] * len(own)
                yield pd.DataFrame({key: keys, "seed": hashes, "n": sizes}).astype({"seed": "int64", "n": "int32"})

        return of.mapInPandas(run, f"{key} string, seed long, n int")

    def rows_of(df: DataFrame, key: str) -> DataFrame:
        return df.withColumn("_row", F.sha2(F.concat_ws(" ", F.col(key).cast("string"), F.coalesce("text", F.lit(""))), 256))

    d, i = rows_of(docs, "doc_id"), rows_of(items, "item_id")
    item_seeds = seeds(i.dropDuplicates(["_row"]), "item_row", None).groupBy("item_row", "seed", "n").agg(F.count("*").alias("times"))
    lengths = [r["n"] for r in item_seeds.select("n").distinct().collect()]  # at most min_match numbers
    if not lengths:
        return docs.sparkSession.createDataFrame([], RESULT)
    doc_seeds = seeds(d, "doc_row", lengths).join(item_seeds.select("seed", "n").distinct(), ["seed", "n"], "left_semi").distinct()
    sizes = item_seeds.groupBy("item_row").agg(F.sum("times").alias("n_seeds"))
    pairs = doc_seeds.join(item_seeds, ["seed", "n"]).groupBy("doc_row", "item_row").agg(F.sum("times").alias("hits"))
    # A seed covers at most min_match words, so fewer seeds than this cannot reach the threshold.
    pairs = pairs.join(sizes, "item_row").where(F.col("hits") * min_match >= F.lit(threshold) * F.col("n_seeds"))
    both = (pairs.join(d.withColumnRenamed("_row", "doc_row"), "doc_row")
            .join(i.select(F.col("_row").alias("item_row"), "item_id", F.col("text").alias("item_text")), "item_row")
            .select("doc_id", "text", "item_id", "item_text"))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield _rows([(d, *m) for d, t, i, s in zip(batch["doc_id"].astype("Int64"), batch["text"], batch["item_id"].astype("Int64"), batch["item_text"])
                         for m in Benchmark([(i, s)], min_match).matches(t, threshold)])

    return both.mapInPandas(judge, RESULT)


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that no item contaminates. Rows that share a doc_id go together; rows without an id stay."""
    found = contaminated(docs, benchmark, **options).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(docs.columns)
