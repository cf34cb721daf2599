"""Quality by nearest-neighbour voting over latent-semantic vectors.

Terms of a document are its character pairs over a folded alphabet (letters in lower case, other characters in
classes), and per word its shape (case, signs, repetition of earlier words and lines). Counts are damped by a
logarithm, weighted by inverse document frequency and scaled to length one. A truncated singular value decomposition
of the labelled vectors gives the latent space. Labelled vectors in that space are broadcast; every document is
compared with all of them by cosine products in blocks, and its ``k`` nearest vote for their labels with weights that
fall with distance. The score is the weighted share of label 1.

Bounds: at most ``sample`` labelled rows are learned from (those with the least hashes of their ids, drawn alike for
either label), so the broadcast has at most ``sample`` x ``rank`` + ``TERMS`` x ``rank`` numbers.

Odd cases: null text counts as empty, and an empty text is a vector without terms beside one constant term, so it
resembles short texts; with no labelled row, every score is 0.5; with one label only, its value. Of equally near
neighbours the first in the order of the sample counts. Rows without label or id teach nothing. Of repeated ids one row
teaches. Very long texts count whole. Letters of all scripts are letters: those without a class of their own share eight. Extra columns
pass through, columns named like results are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridsonde.llm.shared import bounded_rows

SAMPLE, RANK, NEIGHBOURS, SHARPNESS = 4000, 64, 15, 8.0
CLASSES = 48
PAIRS = CLASSES * CLASSES
SHAPES = 64
TERMS = PAIRS + SHAPES + 1
BLOCK = 256
RUN = re.compile(r"\S+")


def _alphabet() -> np.ndarray:
    """Class of each code point below 0x20000: a-z 1-26, other letters 27-34 by their number, then blanks, digits and signs."""
    table = np.zeros(0x20000, np.int64)
    signs = {c: 37 + k for k, c in enumerate(".,!?|#$%&*<>")}  # 37 to 48 is cut to CLASSES - 1 below
    for point in range(len(table)):
        c = chr(point)
        low = c.lower()
        if len(low) == 1 and "a" <= low <= "z":
            table[point] = ord(low) - 96
        elif c.isalpha():
            table[point] = 27 + ord(low[0]) % 8
        elif c == "\n":
            table[point] = 35
        elif c.isspace():
            table[point] = 36
        elif c.isdigit():
            table[point] = 0
        else:
            table[point] = signs.get(c, 47)
    return np.minimum(table, CLASSES - 1)


FOLD = _alphabet()


def folded(points: np.ndarray) -> np.ndarray:
    """Classes of code points; those beyond the table are letters of large scripts."""
    return np.where(points < len(FOLD), FOLD[np.minimum(points, len(FOLD) - 1)], 27 + points % 8)


def term_counts(text: str | None) -> np.ndarray:
    """Counts of all terms of a text."""
    out = np.zeros(TERMS, np.float32)
    out[-1] = 1.0
    if not text:
        return out
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    classes = folded(points)
    if len(classes) > 1:
        out[:PAIRS] = np.bincount(classes[:-1] * CLASSES + classes[1:], minlength=PAIRS)
    words = RUN.findall(text)
    n = len(words)
    if n:
        lines = [x for x in text.split("\n") if x.strip()]
        alike = sum(a == b for a, b in zip(words, words[1:])) / n
        shape = out[PAIRS:PAIRS + SHAPES]
        shares = (1 - len(set(words)) / n, alike, sum(map(str.isupper, words)) / n, sum(not w[-1].isalnum() for w in words) / n,
                  sum(not w[0].isalnum() for w in words) / n, 1 - len(set(lines)) / max(1, len(lines)))
        for k, share in enumerate(shares):  # a share is one of eight terms, that of its step
            shape[8 * k + min(7, int(share * 8))] = n
        shape[48 + min(15, n.bit_length())] = n
    return out


def packed(counts: np.ndarray) -> bytes:
    """The terms that occur and their counts, exactly."""
    at = np.flatnonzero(counts).astype(np.uint32)
    return np.concatenate([at, counts[at].view(np.uint32)]).tobytes()


def unpack(data: bytes, row: np.ndarray) -> None:
    at, counts = np.frombuffer(data, np.uint32).reshape(2, -1)
    row[at] = counts.view(np.float32)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of damped and weighted counts, each of length one."""
    x = np.log1p(counts) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class Neighbours:
    """What every executor gets."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    k: int

    def project(self, counts: np.ndarray) -> np.ndarray:
        return unit_rows(weighted(counts, self.idf) @ self.axes)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(texts), 0.5)
        near = self.project(np.stack([term_counts(t) for t in texts])) @ self.vectors.T
        near = np.round(near.astype(np.float64), 6)
        k = min(self.k, near.shape[1])
        # Equally near ones in the order of the sample: a small step per place settles ties.
        near -= np.arange(near.shape[1]) * 1e-12
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        cosines = np.take_along_axis(near, best, axis=1)
        weights = np.exp(SHARPNESS * (cosines - cosines.max(axis=1, keepdims=True)) / np.maximum(1e-3, 1 - cosines.min(axis=1, keepdims=True)))
        return np.clip((weights * self.labels[best]).sum(axis=1) / weights.sum(axis=1), 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "label", key: str = "doc_id", sample: int = SAMPLE,
        rank: int = RANK, k: int = NEIGHBOURS) -> Neighbours:
    """Latent space and labelled vectors of a bounded sample: half of either label, as far as there are such rows. The
    sample is drawn from the ids of ``labels``; its at most ``sample`` rows are broadcast to find the texts."""
    own = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
    own = own.groupBy("key").agg(F.min("label").alias("label")).withColumn("draw", F.xxhash64(F.col("key").cast("string")))
    halves = [own.where(F.col("label") == y).orderBy("draw", "key").limit(sample // 2) for y in (0, 1)]
    taught = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(halves[0].unionByName(halves[1])), "key")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                part = batch.iloc[at:at + BLOCK]
                yield pd.DataFrame({"draw": part["draw"], "label": part["label"],
                                    "counts": [packed(term_counts(t)) for t in part["text"]]})

    counted = taught.mapInPandas(count, "draw long, label int, counts binary").groupBy("draw").agg(F.min(F.struct("label", "counts")).alias("x"))
    drawn = bounded_rows(counted.select("draw", "x.label", "x.counts").orderBy("draw"), sample, "labelled sample")
    if not drawn:
        return Neighbours(np.zeros(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), k)
    labels = np.array([r["label"] for r in drawn], np.float64)
    x = np.zeros((len(drawn), TERMS), np.float32)
    for row, r in zip(x, drawn):
        unpack(r["counts"], row)
    del drawn
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1).astype(np.float32)
    np.log1p(x, out=x)  # in place: the sample is the largest thing on the driver
    x *= idf
    x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x))[:, None], 1e-12)
    axes = principal_axes(x, rank)
    return Neighbours(idf, axes, unit_rows(x @ axes), labels, k)


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def principal_axes(x: np.ndarray, rank: int, rounds: int = 12) -> np.ndarray:
    """The first right singular vectors, by subspace iteration from a fixed start."""
    rank = min(rank, *x.shape)
    q = np.random.default_rng(0).standard_normal((x.shape[1], min(rank + 16, *x.shape))).astype(np.float32)
    for _ in range(rounds):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, turn = np.linalg.svd(x @ q, full_matrices=False)
    return np.ascontiguousarray((q @ turn.T)[:, :rank])


def score(docs: DataFrame, model: Neighbours, text: str = "text") -> DataFrame:
    """Adds score (0 to 1) and predicted (1 if score >= 0.5). One narrow pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.drop("score", "predicted")
    schema = T.StructType([*out.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                part = batch.iloc[at:at + BLOCK]
                yield part.assign(score=shared.value.scores(part[text].tolist()))

    return out.mapInPandas(run, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
