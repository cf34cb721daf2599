"""Near-duplicate classes by BagMinHash signatures of word-shingle multisets.

A document is the multiset of its runs of five lower-cased words. Every shingle and every unit of its weight owns an
independent Poisson process; each point of it falls into one of the registers at random, and a register keeps the
earliest point. Two registers agree with the probability of the weighted Jaccard similarity. Weights are cut into
dyadic ranges (0,1], (1,2], (2,4], ... with one process each, whose points are placed inside the range by their hash and
count only up to the weight, so that a shingle repeated a million times costs about twenty processes. Points are
generated up to a time by which all registers are usually filled, then further if not, so that the signature is exact.

Registers are hashed in bands, each register in two of them. Within a bucket (documents that share a band) documents are
not compared all with all. First each is compared with a pivot, the member that shares most buckets, and accepted if the
overlap of the multisets, counted exactly, reaches ``threshold``. Classes are the connected components of accepted pairs.
Buckets that then still hold different classes (documents that share a passage but are no duplicates, mostly) are finished
exactly, whatever their size: their documents are dealt anew by units of their multisets, the rarest first. Two multisets of n
and m units that reach the threshold have o = threshold / (1 + threshold) (n + m) units in common at least, so they share one
among the first n - o + 1 of the one and the first m - o + 1 of the other. That test, which uses only sizes and places, stands
in the join itself, so documents that merely share a passage do not become rows; a pivot round comes first here too. So no
bucket is capped and no pair of a bucket is lost, and groups of copies cost their size and not its square.

Storage. Texts of documents in buckets are found by a bitmap of their hashes (2 MB at any size; an exact join follows), so that
other texts are not shuffled. Every stored table is deleted as soon as its successor is complete.

Odd cases: copies with the same words are one node, whatever their number. Texts with fewer than five words are one
shingle of all their words. Texts without words (null, empty, signs only) match nothing and are their own class. Rows
that share a doc_id count as one document, so all its texts join their classes, also if these differ; rows without a doc_id
match nothing and have a null class. Very long texts are taken whole. An empty table gives no rows. Extra columns pass through
whatever their names; a column named like the result is replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsonde.llm.shared import discard, words, written
from gridsonde.llm.tiling import window_hashes

WIDTH, BANDS, ROWS, THRESHOLD = 5, 40, 6, 0.8
SLOTS, BITS, CACHED = 1 << 18, 1 << 24, 1 << 21
U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-mixed function of 64-bit numbers."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_words: dict[str, int] = {}


def shingles(tokens: list[str], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles as 64-bit hashes, and how often each occurs."""
    if not tokens:
        return np.zeros(0, U), np.zeros(0, np.int64)
    if len(_words) > 60_000:
        _words.clear()
    for w in set(tokens).difference(_words):
        _words[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
    hashes = np.array([*map(_words.__getitem__, tokens)], U)
    size = min(width, len(tokens))
    return np.unique(mixed(window_hashes(hashes, size) + U(size)), return_counts=True)


def signature(elements: np.ndarray, weights: np.ndarray, registers: int) -> np.ndarray:
    """BagMinHash signature: per register the identity of its earliest point."""
    seeds, low, length, most = [elements], [np.zeros(len(elements))], [np.ones(len(elements))], [weights]
    top, j = int(weights.max()), 1
    while (1 << (j - 1)) < top:
        own = weights > (1 << (j - 1))
        n = int(own.sum())
        seeds.append(mixed(elements[own] + U(j)))
        low.append(np.full(n, float(1 << (j - 1))))
        length.append(np.full(n, float(1 << (j - 1))))
        most.append(weights[own])
        j += 1
    seed, low, rate, most = map(np.concatenate, (seeds, low, length, most))
    until = registers * (np.log(registers) + 3.0) / float(weights.sum())
    while True:
        found = _points(seed, low, rate, most, until, registers)
        time, register, name = found
        if len(np.unique(register)) == registers:
            break
        until *= 2.0
    order = np.argsort(-time, kind="stable")
    out = np.zeros(registers, U)
    out[register[order]] = name[order]  # the earliest is written last
    return out


def _points(seed: np.ndarray, low: np.ndarray, rate: np.ndarray, most: np.ndarray, until: float, registers: int):
    """All points up to a time: when, register and identity of those inside the weights."""
    times, places, names = [], [], []
    at, clock, first = np.arange(len(seed)), np.zeros(len(seed)), 0
    while len(at):
        n = int(np.ceil(until * float(rate[at].max()))) + 2 if first == 0 else 4
        n = max(2, min(n, 4_000_000 // len(at)))
        steps = (np.arange(first + 1, first + n + 1, dtype=U) * U(0x9E3779B97F4A7C15))[None, :]
        name = mixed(seed[at][:, None] + steps)
        gap = -np.log(((name >> U(11)).astype(np.float64) + 0.5) / float(1 << 53)) / rate[at][:, None]
        gap[:, 0] += clock
        when = np.cumsum(gap, axis=1)
        more = mixed(name ^ U(0xD6E8FEB86659FD93))
        row, col = np.nonzero(when <= until)
        draw = more[row, col]
        own = at[row]
        unit = low[own] + np.floor((draw >> U(32)).astype(np.float64) / 4294967296.0 * rate[own]) + 1
        inside = unit <= most[own]
        times.append(when[row, col][inside])
        places.append(((draw & U(0xFFFFFFFF)) % U(registers)).astype(np.int64)[inside])
        names.append(name[row, col][inside])
        on = when[:, -1] <= until
        at, clock, first = at[on], when[on, -1], first + n
    return np.concatenate(times), np.concatenate(places), np.concatenate(names)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    same = b[0][at] == a[0]
    both = int(np.minimum(a[1][same], b[1][at[same]]).sum())
    return both / (int(a[1].sum()) + int(b[1].sum()) - both)


def _layout(bands: int, rows: int) -> tuple[int, np.ndarray]:
    """Number of registers, and the registers of each band: two shuffles of all registers, cut into bands."""
    half = (bands + 1) // 2
    rng = np.random.default_rng(7)
    return half * rows, np.concatenate([rng.permutation(half * rows).reshape(half, rows) for _ in range(2)])[:bands]


def _described(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """doc_id, tkey (of the text), key (of its words; null without words) and the band hashes."""
    registers, layout = _layout(bands, rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        factor = mixed(np.arange(1, rows + 1, dtype=U)) | U(1)
        for batch in batches:
            keys, hashes = [], []
            for t in batch["text"]:
                tokens = words(t)
                if not tokens:
                    keys.append(None)
                    hashes.append(None)
                    continue
                keys.append(hashlib.blake2b(" ".join(tokens).encode("utf-8", "surrogatepass"), digest_size=16).digest())
                own = mixed(signature(*shingles(tokens, width), registers))
                hashes.append(mixed((own[layout] * factor).sum(axis=1, dtype=U) + np.arange(bands, dtype=U)).view(np.int64))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "tkey": batch["tkey"], "key": keys, "bands": hashes})

    rows_in = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias("tkey"), "text")
    return rows_in.mapInPandas(run, "doc_id long, tkey long, key binary, bands array<long>")


def prefix(elements: np.ndarray, weights: np.ndarray, common: np.ndarray, threshold: float) -> np.ndarray:
    """The rarest units of a multiset: two multisets whose similarity reaches ``threshold`` have one of them in common."""
    first = np.cumsum(weights) - weights
    times = np.arange(int(weights.sum())) - np.repeat(first, weights)  # which occurrence of its shingle
    units = mixed(np.repeat(elements, weights) + times.astype(U) * U(0x9E3779B97F4A7C15))
    n = len(units)
    order = np.lexsort((units, common[(np.repeat(elements, weights) % U(len(common))).astype(np.int64)]))
    return units[order[:n - int(np.ceil(threshold * n - 1e-9)) + 1]]


def _needed(threshold: float, n: Column, m: Column) -> Column:
    """Units that multisets of n and m units must have in common."""
    return F.ceil((n + m) * (threshold / (1 + threshold)) - 1e-9)


def _dealt(open_nodes: DataFrame, texts: DataFrame, width: int, threshold: float) -> DataFrame:
    """bucket, node, degree, n, place: a row for each unit of the prefixes, its place in the order of the units and their number. Any global
    order keeps all pairs; counts in ``SLOTS`` slots (all that reaches the driver) put rare ones first."""
    whole = open_nodes.join(texts, "node")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for t in batch["text"]:
                np.add.at(total, (shingles(words(t), width)[0] % U(SLOTS)).astype(np.int64), 1)
        at = np.nonzero(total)[0]
        yield pd.DataFrame({"slot": at, "n": total[at]})

    common = np.zeros(SLOTS, np.int64)
    for r in whole.select("text").mapInPandas(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        common[r["slot"]] = r["n"]
    shared = whole.sparkSession.sparkContext.broadcast(common)
    schema = pa.schema([("bucket", pa.int64()), ("node", pa.int64()), ("degree", pa.int64()), ("n", pa.int64()), ("place", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, 100):
                batch = whole_batch.slice(at, 100)
                parts = []
                for node, degree, t in zip(*(batch.column(k).to_pylist() for k in range(3))):
                    elements, weights = shingles(words(t), width)
                    own = prefix(elements, weights, shared.value, threshold)
                    parts.append((own.view(np.int64), *(np.full(len(own), v, np.int64) for v in (node, degree, weights.sum())), np.arange(len(own))))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], schema=schema)

    return whole.select("node", "degree", "text").mapInArrow(run, "bucket long, node long, degree long, n long, place long")


def _texts(docs: DataFrame, need: DataFrame) -> DataFrame:
    """node, text of the nodes in ``need`` (node, doc_id, tkey)."""
    slot = F.col("tkey").bitwiseAND(BITS - 1)
    words_ = need.groupBy(F.shiftright(slot, 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(tkey & 63 as int))")).alias("bits")).toArrow()
    bitmap = np.zeros(BITS // 64, np.int64)
    bitmap[words_["at"].to_numpy()] = words_["bits"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(1).to_numpy() & (BITS - 1)
            hit = (shared.value[own >> 6] >> (own & 63)) & 1
            if hit.any():
                yield batch.filter(pa.array(hit.astype(bool)))

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tkey"), F.col("text").cast("string").alias("text"))
    likely = rows.mapInArrow(run, "doc_id long, tkey long, text string")
    return likely.join(need, ["doc_id", "tkey"]).dropDuplicates(["node"]).select("node", "text")


def _accepted(pairs: DataFrame, texts: DataFrame, width: int, threshold: float) -> DataFrame:
    """The pairs (a, b) whose multisets overlap enough."""
    both = (pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
            .join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, held = {}, 0

        def bag(node: int, text: str) -> tuple[np.ndarray, np.ndarray]:
            nonlocal held
            if node not in known:
                if held > CACHED:
                    known.clear()
                    held = 0
                known[node] = shingles(words(text), width)
                held += len(known[node][0])
            return known[node]

        for batch in batches:
            good = [overlap(bag(a, ta), bag(b, tb)) >= threshold for a, b, ta, tb in zip(batch["a"], batch["b"], batch["text_a"], batch["text_b"])]
            yield batch.loc[good, ["a", "b"]]

    return both.select("a", "b", "text_a", "text_b").mapInPandas(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, label of every node of ``edges`` (a, b): the least node it is connected to.

    Each round takes the least label among neighbours and then the label of that label; a table of (node, label) is
    stored per round, and only a count of changes reaches the driver."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = (both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node"))
                .agg(F.min("label").alias("near")))
        step = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("root"))
        new = written(step.join(jump, "label").select("node", "was", F.least("label", "root").alias("label")), "labels")
        discard(labels)
        labels = new
        if not new.where("label < was").limit(1).count():
            discard(both)
            return labels


def _labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return members.withColumn("label", F.col("node"))
    return members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _with_pivot(members: DataFrame, may: Callable[[Column, Column, Column, Column], Column] | None = None) -> DataFrame:
    """(a, b): members of a bucket and its pivot, where their classes differ and ``may`` (of sizes and places) does not rule the pair out."""
    more = ["n", "place"] if may else []
    first = F.max(F.struct("degree", (-F.col("node")).alias("k"), "label", *more))
    pivots = members.groupBy("bucket").agg(first.alias("p"))
    met = members.join(pivots, "bucket").where(F.col("label") != F.col("p.label"))
    if may:
        met = met.where(may(F.col("n"), F.col("place"), F.col("p.n"), F.col("p.place")))
    return met.select(F.col("node").alias("a"), (-F.col("p.k")).alias("b"))


def _open(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Labelled members of the buckets that hold several classes, with ``main``, the largest of them."""
    now = _labelled(members, labels)
    sizes = now.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    state = sizes.groupBy("bucket").agg(F.count("*").alias("classes"), F.max(F.struct("n", "label")).alias("most"))
    return now.join(state.where("classes > 1").select("bucket", F.col("most.label").alias("main")), "bucket")


def _between_classes(members: DataFrame, may: Callable[[Column, Column, Column, Column], Column]) -> DataFrame:
    """(a, b): pairs of different classes within buckets that ``may`` does not rule out, found from the members outside a bucket's main class."""
    aside = members.where("label != main").select("bucket", F.col("node").alias("b"), F.col("label").alias("to"), F.col("n").alias("m"), F.col("place").alias("at"))
    other = (F.col("label") != F.col("to")) & ((F.col("label") == F.col("main")) | (F.col("node") > F.col("b")))
    fits = may(F.col("n"), F.col("place"), F.col("m"), F.col("at"))
    return members.join(aside, (members["bucket"] == aside["bucket"]) & other & fits).select(F.col("node").alias("a"), "b")


def _joined(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels after classes were linked."""
    if labels is None:
        return components(links)
    if links.isEmpty():
        return labels
    of = lambda side: labels.select(F.col("node").alias(side), F.col("label").alias(f"{side}_label"))
    between = (links.join(of("a"), "a", "left").join(of("b"), "b", "left")
               .select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b")).where("a != b"))
    found = components(between)
    moved = found.select(F.col("node").alias("label"), F.col("label").alias("root"))
    every = labels.select("node", "label").unionByName(moved.select(F.col("label").alias("node"), "label")).distinct()
    new = written(every.join(moved, "label", "left").select("node", F.coalesce("root", "label").alias("label")), "labels")
    discard(labels, found)
    return new


def _same_document(described: DataFrame, contents: DataFrame) -> DataFrame:
    """(a, b): contents that rows of one doc_id hold, all linked with the first of them."""
    known = described.where("key is not null").select("doc_id", "key")
    several = known.groupBy("doc_id").agg(F.min("key").alias("hub"), F.max("key").alias("last")).where("hub != last")
    pairs = known.join(several.select("doc_id", "hub"), "doc_id").where("key != hub").select("hub", "key").distinct()
    ids = contents.select("key", "node")
    return (pairs.join(ids.select(F.col("key"), F.col("node").alias("a")), "key")
            .join(ids.select(F.col("key").alias("hub"), F.col("node").alias("b")), "hub").select("a", "b"))


def classes(docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, class_id of every doc_id, stored: the least doc_id of its class of near-duplicates."""
    def may(n: Column, place: Column, m: Column, at: Column) -> Column:
        need = _needed(threshold, n, m)
        return (n - place >= need) & (m - at >= need)

    described = written(_described(docs, width, bands, rows), "signatures")
    own = described.where("key is not null").groupBy("key").agg(F.min(F.struct("doc_id", "tkey", "bands")).alias("x"))
    # Stored, so that the numbers of the nodes stay as they are.
    contents = written(own.select("key", F.col("x.doc_id").alias("doc_id"), "x.tkey", "x.bands", F.monotonically_increasing_id().alias("node")), "contents")
    banded = contents.select("node", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    found = written(banded.join(shared, "bucket"), "members")
    degree = found.groupBy("node").agg(F.sum("size").alias("degree"))
    members = found.join(degree, "node").select("bucket", "node", "degree")
    need = contents.join(degree, "node", "left_semi").select("node", "doc_id", "tkey")
    texts = written(_texts(docs, need), "texts")

    def linked(labels: DataFrame | None, pairs: DataFrame, *more: DataFrame) -> DataFrame:
        listed = written(pairs.distinct(), "pairs")
        links = written(reduce(DataFrame.unionByName, more, _accepted(listed, texts, width, threshold)), "links")
        new = _joined(labels, links)
        discard(listed, links)
        return new

    labels = linked(None, _with_pivot(_labelled(members, None)), _same_document(described, contents))
    left = _open(members, labels).select("node", "degree").distinct()
    dealt = written(_dealt(left, texts, width, threshold), "prefixes")
    discard(found)
    labels = linked(labels, _with_pivot(_labelled(dealt, labels), may))
    labels = linked(labels, _between_classes(_open(dealt, labels), may))
    discard(dealt, texts)
    labelled = contents.select("key", "node", "doc_id").join(labels.select("node", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = labelled.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    by_key = labelled.join(least, "label").select("key", "class_id")
    by_id = described.select("doc_id", "key").distinct().join(by_key, "key", "left").groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    out = written(by_id.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id")), "classes")
    discard(described, contents, labels)
    return out


def near_duplicates(docs: DataFrame, into: str = "class_id", **options) -> DataFrame:
    """Adds class_id (or ``into``): the least doc_id of the document's class of near-duplicates."""
    base = docs.drop(into)
    return base.join(classes(docs, **options).withColumnRenamed("class_id", into), "doc_id", "left").select(*base.columns, into)


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """Of each class the row of its least doc_id; rows without an id stay."""
    kept = classes(docs, **options).where("doc_id = class_id").select("doc_id")
    named = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(docs.where("doc_id is null")).select(docs.columns)
