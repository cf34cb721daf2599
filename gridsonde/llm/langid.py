"""Language identification by rank-order profiles.

A profile is the list of the most frequent letter n-grams (one to three characters, words padded with a blank on
either side), most frequent first, equals in n-gram order. The distance of a document to a language is the
out-of-place sum: for each n-gram of the document's profile the difference of its ranks, or the profile size if
the language lacks it. The nearest language wins; of equally near ones the first in alphabetical order.

Odd cases: null text and text without any letter is ``und`` with score 0; so is everything if no language could
be learned. Rows with null text or null language teach nothing. Extra columns pass through; columns named like the
results are replaced. Profiles are learned from all training rows: counts are summed per batch, then per
language and n-gram, so a language or a source with most of the rows is no hot group.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridsonde.llm.shared import bounded_rows

PROFILE = 300
MAX_LANGUAGES = 2000
NOT_LETTERS = re.compile(r"[\W\d_]+")
BITS = 21  # of a code point; three fit into one integer


def letters_only(text: str | None) -> str:
    """Lower-case words joined by single blanks, blanks at both ends; empty if there is no letter."""
    if not text:
        return ""
    line = NOT_LETTERS.sub(" ", text.lower()).strip(" ")
    return f" {line} " if any(map(str.isalpha, line)) else ""


def gram_counts(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram, count) of padded text given as code points, blanks as 0. Bigrams and single letters follow from
    the trigrams around each letter."""
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    inner = b != 0
    three, n = np.unique((a[inner] << (2 * BITS)) | (b[inner] << BITS) | c[inner], return_counts=True)
    head, last, low = three >> BITS, three & ((1 << BITS) - 1), (1 << BITS) - 1
    tail = last == 0
    two = np.concatenate([head, (head[tail] & low) << BITS])  # every pair once, and the pairs that end a word
    marks = [three | (3 << 61), two | (1 << 62), (head & low) | (1 << 61)]
    grams = np.concatenate([x.astype(np.uint64) for x in (marks[1], marks[2])])
    grams, where = np.unique(grams, return_inverse=True)
    weights = np.bincount(where, np.concatenate([n, n[tail], n]))
    return np.concatenate([marks[0].astype(np.uint64), grams]), np.concatenate([n, weights.astype(np.int64)])


def _codes(line: str) -> np.ndarray:
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    codes[codes == 32] = 0
    return codes


def ranked(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent n-grams in order of rank."""
    if len(grams) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= least
        grams, counts = grams[keep], counts[keep]
    return grams[np.lexsort((grams, -counts))[:size]]


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE) -> dict[str, list[int]]:
    """Profiles by language: at most ``MAX_LANGUAGES`` lists of ``size`` n-grams reach the driver."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, rows in batch.groupby("lang"):
                lines = "".join(letters_only(t) for t in rows["text"])
                if lines:
                    grams, counts = gram_counts(_codes(lines.replace("  ", " ")))
                    yield pd.DataFrame({"lang": name, "gram": grams.view(np.int64), "n": counts})

    known = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    counts = known.mapInPandas(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows = bounded_rows(counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= size), MAX_LANGUAGES * size,
                        "language profiles")
    profiles: dict[str, list[int]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["rank"])):
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return profiles


class Ranks:
    """Ranks of all known n-grams in each language, as one table for look-ups by sorted search."""

    def __init__(self, profiles: dict[str, list[int]], size: int) -> None:
        self.size, self.names = size, sorted(profiles)
        self.grams = np.unique(np.array([g for p in profiles.values() for g in p], np.int64).view(np.uint64))
        self.ranks = np.full((len(self.names), len(self.grams)), -1, np.int64)
        for k, name in enumerate(self.names):
            own = np.array(profiles[name], np.int64).view(np.uint64)
            self.ranks[k, np.searchsorted(self.grams, own)] = np.arange(len(own))

    def nearest(self, text: str | None) -> tuple[str, float]:
        line = letters_only(text)
        if not line or not self.names:
            return "und", 0.0
        own = ranked(*gram_counts(_codes(line)), self.size)
        at = np.searchsorted(self.grams, own)
        at[at == len(self.grams)] = 0
        ranks = self.ranks[:, at]
        lacking = (ranks < 0) | (self.grams[at] != own)
        places = np.where(lacking, self.size, np.minimum(np.abs(ranks - np.arange(len(own))), self.size)).sum(axis=1)
        k = int(np.argmin(places))
        return self.names[k], float(1.0 - places[k] / (self.size * len(own)))


def predict(docs: DataFrame, profiles: dict[str, list[int]], text: str = "text", size: int = PROFILE) -> DataFrame:
    """Adds lang_pred and score. One narrow pass; profiles are bounded by ``MAX_LANGUAGES`` x ``size`` numbers."""
    shared = docs.sparkSession.sparkContext.broadcast(Ranks(profiles, size))
    out = docs.drop("lang_pred", "score")
    schema = T.StructType([*out.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranks = shared.value
        for batch in batches:
            found = [ranks.nearest(t) for t in batch[text]]
            yield batch.assign(lang_pred=[f[0] for f in found], score=[f[1] for f in found])

    return out.mapInPandas(run, schema)
