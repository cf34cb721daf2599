"""Quality rules: counts per document, and a log-likelihood ratio between a trusted target and the raw corpus.

Words are runs of other than ASCII white space. Lower-cased words and pairs of neighbouring words are hashed into
``BUCKETS`` buckets. Two multinomials over the buckets, of trusted documents and of all documents, are smoothed by
``PRIOR`` counts on the scale of the target, so that a bucket about which the target says little has a ratio near 0. The
score of a document is the mean log ratio of its n-grams, which its length leaves alone. Half of the trusted documents
make the target; the scores of the other half, which the target has not seen, set the threshold: all but ``LOSS`` of them
are kept. A document is kept if its base rules hold and its score reaches the threshold; the same for every document.

Everything is built of SQL functions; arrays are worked on row by row. All documents are counted where they lie, at most
``BUCKETS`` rows a task are shuffled. Trusted documents are found by a merge join on their ids: nothing that grows with the
input is broadcast. The half is a hash of the id, so each half's join moves only the texts that may belong to it.

Bounds: all trusted documents are used, those of one half as target, those of the other for the threshold, which is the exact
order statistic of their stored scores: counts over ever narrower ranges find it. ``BUCKETS`` ratios and at most ``BINS`` counts
a range reach the driver.

Odd cases: null text has no words, lines or symbols and fails the base rules; its score is 0, as that of any text without
words. Without trusted documents every ratio is 0 and only the base rules decide. Trusted ids that are null or
repeated count not or once. Rows are judged one by one, so repeated rows have equal results. Extra columns pass through,
columns named like results are replaced.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsonde.llm.shared import bounded_rows, discard, let, written

BLANKS = " \t\n\x0b\x0c\r"
BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
BUCKETS, BINS, PRIOR, LOSS = 16384, 4096, 5.0, 0.005
FEW = 32  # windows that a text repeats, up to which they are looked up one by one


def words_of(text: Column) -> Column:
    bare = F.trim(text, F.lit(BLANKS))
    return F.when(bare == "", _none("string")).otherwise(F.split(bare, BLANK, -1))


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _runs(w: Column, n: int, of: Callable[[Column], Column]) -> Column:
    """``of`` each start of a run of ``n`` elements."""
    return F.transform(F.sequence(F.lit(0), F.size(w) - n), of)


def repeated_words(w: Column) -> Column:
    """How many words lie in runs of three that occur twice or more."""
    def covered(starts: Column) -> Column:
        """Words under runs of three that begin at sorted places."""
        step = lambda s: lambda x, k: F.least(F.lit(3), F.coalesce(F.get(s, k + 1) - x, F.lit(3)))
        return let(starts, lambda s: F.aggregate(F.transform(s, step(s)), F.lit(0), lambda a, x: a + x))

    def few(runs: Column, again: Column) -> Column:
        return F.filter(F.transform(runs, lambda x, k: F.when(F.array_contains(again, x), k)), lambda k: k.isNotNull())

    def many(runs: Column) -> Column:
        def alike(p: Column) -> Callable[[Column, Column], Column]:
            near = lambda x, at: F.coalesce(F.get(p, at)["h"] == x["h"], F.lit(False))
            return lambda x, k: near(x, k + 1) | F.when(k > 0, near(x, k - 1)).otherwise(False)

        placed = F.sort_array(F.transform(runs, lambda x, k: F.struct(x.alias("h"), k.alias("k"))))
        return let(placed, lambda p: F.sort_array(F.transform(F.filter(p, alike(p)), lambda x: x["k"])))

    def of_runs(runs: Column) -> Column:
        again = let(F.sort_array(runs), lambda s: F.array_distinct(F.filter(s, lambda x, k: F.when(k > 0, x == F.get(s, k - 1)).otherwise(False))))
        return let(again, lambda a: F.when(F.size(a) == 0, 0).when(F.size(a) <= FEW, covered(few(runs, a))).otherwise(covered(many(runs))))

    hashes = _runs(w, 3, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return let(F.when(F.size(w) >= 3, hashes).otherwise(_none("bigint")), of_runs)


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    new = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    whole = F.coalesce(F.col(text), F.lit(""))
    counted = let(words_of(whole), lambda w: F.struct(F.size(w).alias("n"), F.char_length(F.array_join(w, "")).alias("chars"), repeated_words(w).alias("again")))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: F.trim(x, F.lit(BLANKS)) != "")
    df = docs.drop(*(c for c in new if c != text)).withColumn("_counted", counted).withColumns({
        "n_words": F.col("_counted.n").cast("long"), "word_chars": F.col("_counted.chars").cast("long"),
        "n_symbols": F.regexp_count(whole, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": F.col("_counted.again").cast("long"),
    })
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return df.withColumn("base_failed", failed).drop("_counted")


def ngram_buckets(text: Column) -> Column:
    """Buckets of all words and word pairs of a text, as an array."""
    bucket = lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int")
    pairs = lambda h: F.when(F.size(h) >= 2, _runs(h, 2, lambda i: bucket(F.xxhash64(F.get(h, i), F.get(h, i + 1))))).otherwise(_none("int"))
    hashes = F.transform(words_of(F.lower(F.coalesce(text, F.lit("")))), lambda x: F.xxhash64(x))
    return let(hashes, lambda h: F.concat(F.transform(h, bucket), pairs(h)))


def half_of(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.xxhash64(doc_id, F.lit(1)), F.lit(2)).cast("int")


def halves_of(trusted: DataFrame) -> DataFrame:
    """doc_id and half (0 teaches, 1 sets the threshold) of all trusted ids."""
    return trusted.select("doc_id").where("doc_id is not null").distinct().withColumn("half", half_of())


def documents_of(docs: DataFrame, ids: DataFrame, text: str) -> DataFrame:
    """doc_id and text of the documents with these ids, which may be as many as the documents."""
    return docs.select("doc_id", text).join(ids.select("doc_id").hint("merge"), "doc_id", "left_semi")


def log_ratios(docs: DataFrame, trusted: DataFrame, text: str = "text", among: DataFrame | None = None) -> list[float]:
    """Per bucket ln p(bucket | trusted) - ln p(bucket | corpus). ``trusted``: doc_id. ``among``: documents that hold all trusted ones, if fewer than ``docs``."""
    def grams(df: DataFrame, n: int, t: int) -> DataFrame:
        # explode_outer, as explode would make the optimiser compute the array twice
        return df.select(F.explode_outer(ngram_buckets(F.col(text))).alias("bucket"), F.lit(n).alias("n"), F.lit(t).alias("t")).where("bucket is not null")

    both = grams(docs, 1, 0).unionAll(grams(documents_of(docs if among is None else among, trusted, text), 0, 1))
    rows = bounded_rows(both.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("t").alias("t")), BUCKETS, "buckets")
    share = sum(r["t"] for r in rows) / max(1, sum(r["n"] for r in rows))
    ratios = [0.0] * BUCKETS
    for r in rows:
        ratios[r["bucket"]] = math.log((r["t"] + PRIOR) / (r["n"] * share + PRIOR))
    return ratios


def share_below(df: DataFrame, value: str, share: float) -> float | None:
    """The element of a column of finite numbers that ``share`` of the others (rounded down) precede in order; None without rows.

    Each pass counts the rows in ``BINS`` parts of the range that still holds the element and goes on with the part it lies in."""
    n, low, high = df.agg(F.count("*"), F.min(value), F.max(value)).first()
    place, x = int(share * n), F.col(value)
    while n and low < high:
        part = F.least(F.lit(BINS - 1), F.floor((x - low) / (high - low) * BINS)).alias("part")
        counts = df.where(x.between(low, high)).groupBy(part).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
        for r in sorted(bounded_rows(counts, BINS, "parts of a range")):
            if place < r["n"]:
                low, high = r["low"], r["high"]
                break
            place -= r["n"]
    return low


def held_out_threshold(docs: DataFrame, held: DataFrame, ratios: list[float], text: str = "text", loss: float = LOSS) -> float:
    """The score that all but ``loss`` of the held-out trusted documents reach, those that fail the base rules aside."""
    own = judged(documents_of(docs, held, text), ratios, -math.inf, text)
    once = own.groupBy("doc_id").agg(F.min(F.struct("base_failed", "score")).alias("r")).where("not r.base_failed").select("r.score")
    scores = written(once, "held_out_scores")
    least = share_below(scores, "score", loss)
    discard(scores)
    return -math.inf if least is None else least


def judged(docs: DataFrame, ratios: list[float], threshold: float, text: str = "text") -> DataFrame:
    """Adds the base counts, score and kept."""
    base = base_counts(docs.drop("score", "kept"), text)
    table = F.from_json(F.lit(json.dumps(ratios)), "array<double>")
    mean = lambda g: F.when(F.size(g) > 0, F.aggregate(g, F.lit(0.0), lambda a, b: a + F.get(table, b)) / F.size(g)).otherwise(0.0)
    df = base.withColumn("score", let(ngram_buckets(F.col(text)), mean))
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def filtered(docs: DataFrame, trusted: DataFrame, text: str = "text") -> DataFrame:
    """All documents with counts, score and kept, by ratios and a threshold learned from ``trusted`` (doc_id)."""
    halves = halves_of(trusted.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType)))
    teaching, held = (docs.where(half_of() == k) for k in (0, 1))
    ratios = log_ratios(docs, halves.where("half = 0"), text, teaching)
    return judged(docs, ratios, held_out_threshold(held, halves.where("half = 1"), ratios, text), text)
