"""Licence scans: a trained classifier of paragraphs, an unknown class, and templates that confirm.

A paragraph is a line of the text; a block of several lines (up to a blank line) is also judged as one paragraph, its lines
joined by blanks, if none of its lines is of a family by itself, so that wrapped notices are found. Sparse features (hashed
words and word pairs) and multinomial logistic regression give each paragraph a family, ``unknown`` or none. It is trained
on the written templates, on written notices of licences without a template (unknown), on deterministic variants of both
(single words left out of all but the shortest, words put around), and on lines and blocks of the corpus that resemble no template: those that
declare a licence are unknown, the others none. A family counts if its probability reaches a threshold calibrated on
held-out examples and a template confirms it: the paragraph holds at least ``CONFIRM`` of the words and word pairs of one of
the family's templates. Else a family or unknown is ``unknown`` if it is likelier a licence than any held-out none
example was, or if it holds as much of any template.

Words and pairs are hashed into ``BUCKETS`` buckets; those that the training sample holds are features, others weigh nothing.
Every paragraph is scored. A sum over its features of the largest weight that any class has above none bounds how far a
class can be above none; where the bound is negative the paragraph is none, else all classes are summed. Everything is built
of SQL functions and the DataFrame learner; there is no shuffle but that of the bounded sample.

Bounds: at most ``SAMPLE`` paragraphs of the corpus are learned from, of half as many documents (least hashes, some with and some
without hints of a licence).

A bare two-word heading (``MIT License``) has too few features to be told from prose and counts as none.

Odd cases: null and empty text has one empty paragraph, class none, as has any paragraph without words. Repeated paragraphs
each count. Rows are judged one by one. Over an empty table the classifier learns from templates and written examples alone.
Extra columns pass through, columns named like results are replaced.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsonde.llm.shared import bounded_rows, let, spare, written

# Fixed texts: headings, notices and paragraphs by which licences are declared.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0", "Apache License Version 2.0, January 2004", "Apache 2.0 licensed",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    "MIT": (
        "Released under the MIT License", "Licensed under the MIT license", "SPDX-License-Identifier: MIT", "MIT License", "This project is MIT licensed",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY"),
    "GPL-3.0": (
        "licensed under GPLv3", "This work is licensed under the GNU General Public License, version 3", "SPDX-License-Identifier: GPL-3.0", "Licensed under the GPLv3",
        "Licensed under the GNU GPL v3", "Licensed under GPL-3.0-or-later", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3"),
    "GPL-2.0": (
        "licensed under GPLv2", "licensed under the GNU General Public License, version 2", "SPDX-License-Identifier: GPL-2.0", "Licensed under the GNU GPL v2",
        "Licensed under GPL-2.0-only", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2"),
    "LGPL": (
        "licensed under LGPLv3", "licensed under LGPLv2.1", "licensed under the GNU Lesser General Public License", "SPDX-License-Identifier: LGPL",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    "BSD": (
        "Licensed under the BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause", "released under the BSD license", "BSD 3-Clause License", "BSD 2-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation"),
    "MPL-2.0": (
        "subject to the terms of the Mozilla Public License, v. 2.0", "SPDX-License-Identifier: MPL-2.0", "Mozilla Public License Version 2.0",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY": ("Licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    "CC0": ("Released under CC0 1.0", "CC0 1.0 Universal Public Domain Dedication"),
}
# Notices of licences that have no template.
STRANGERS = ("Licensed under the Open Software License 3.0", "Licensed under the CeCILL License, Version 2.1", "Distributed under the Python Software Foundation License", "SPDX-License-Identifier: NCSA",
             "This is free and unencumbered software released into the public domain", "Licensed under the Eclipse Public License 2.0", "SPDX-License-Identifier: Zlib",
             "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Released under the Unlicense",
             "Licensed under AGPLv3", "This program is released under the Artistic License 2.0", "Distributed under the zlib license", "SPDX-License-Identifier: OSL-3.0",
             "This font is licensed under the SIL Open Font License, Version 1.1", "Use is subject to the terms of the Common Development and Distribution License",
             "Licensed under the Academic Free License version 3.0", "SPDX-License-Identifier: Ruby", "Released under the WTFPL", "AGPLv3",
             "Licensed under the Open Database License", "This software is provided under the terms of the PostgreSQL License")
# Words by which the training sample is drawn and weakly labelled; nothing that is scored depends on them.
DECLARES = (r"(?:\blicen[sc]ed (?:\w+ )?under\b|\b(?:released|distributed|available|provided|published) under (?:\w+ ){0,6}licen[sc]e|license-identifier"
            r"|subject to the terms of .*licen[sc]e|\bpermission (?:is hereby granted|to use, copy)|\ba?l?gplv?[0-9])")
HINT = r"[Ll][Ii][Cc][Ee][Nn][SsCc][Ee]"
KEYS = r"(?:apache|\bmit licen[sc]e|license-identifier|permission is hereby granted|\bgnu\b|\bgpl\b|\blgpl\b|\bbsd\b|mozilla public|\bmpl\b|\bcc by\b|\bcc0\b|creative commons)"
# Written paragraphs with key words that declare nothing.
OTHERS = ("The apache helicopter landed near the village", "gnu and zebra grazed on the plain", "The committee of the creative commons met on Tuesday",
          "We compared the bsd kernel with others in a benchmark", "apache server logs were rotated every night", "The gpl debate went on for years in the press",
          "creative commons summit speakers announced", "mozilla public relations office opened", "she wrote about gnu tools and their history",
          "All rights reserved.", "Copyright 2020 the authors.", "See the file for details.", "Notice:", "Copyright 2020 the authors. All rights reserved.",
          "their license fee rose to 20 dollars", "a driver must carry a licence at all times", "the license plate was found by police")
NONE, UNKNOWN = "none", "unknown"
CLASSES = (*TEMPLATES, UNKNOWN, NONE)
BUCKETS, SAMPLE, CONFIRM, PRECISION, SEEN = 1 << 15, 2000, 0.7, 0.99, 10


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def grams(text: Column) -> Column:
    """Distinct words and word pairs."""
    pairs = lambda w: F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1)))).otherwise(
        F.array().cast("array<string>"))
    return let(words_of(text), lambda w: F.array_distinct(F.concat(w, pairs(w))))


def hashed(text: Column) -> Column:
    """Hashes of the words of a text, in order."""
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def buckets(words: Column) -> Column:
    """Buckets of words and word pairs, from the hashes of the words."""
    of = lambda x: F.pmod(x, F.lit(BUCKETS)).cast("int")
    return F.when(F.size(words) == 0, F.array().cast("array<int>")).otherwise(F.concat(
        F.transform(words, of), F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda x, y: of(F.xxhash64(x, y)))))


def blocks(sizes: Column) -> Column:
    """array<struct<first, n>>: the runs of lines that hold words, from the numbers of words of the lines."""
    ends = F.filter(F.sequence(F.lit(0), F.size(sizes)), lambda k: F.coalesce(F.get(sizes, k), F.lit(0)) == 0)
    spans = F.zip_with(F.concat(F.array(F.lit(-1)), F.slice(ends, F.lit(1), F.size(ends) - 1)), ends, lambda a, b: F.struct((a + 1).alias("first"), (b - a - 1).alias("n")))
    return F.filter(spans, lambda x: x["n"] > 0)


def _template_table() -> Column:
    return F.array(*(F.struct(F.lit(name).alias("family"), F.lit(t).alias("text")) for name, texts in TEMPLATES.items() for t in texts))


def template_grams() -> Column:
    """array<struct<family, g>>; foldable, so computed once."""
    return F.transform(_template_table(), lambda t: F.struct(t["family"].alias("family"), grams(t["text"]).alias("g")))


def support(line: Column, templates: Column) -> Column:
    """array<struct<family, share>>: how much of each template a paragraph holds."""
    return let(grams(line), lambda g: F.transform(templates, lambda t: F.struct(
        t["family"].alias("family"), (F.size(F.array_intersect(t["g"], g)) / F.size(t["g"])).alias("share"))))


def examples(docs: DataFrame, text: str, sample: int) -> DataFrame:
    """label, line, draw: templates and strangers with variants, written others, and paragraphs of the corpus that resemble no template."""
    spark = docs.sparkSession
    strangers = F.array(*(F.struct(F.lit(UNKNOWN).alias("family"), F.lit(t).alias("text")) for t in STRANGERS))
    seeds = spark.range(1).select(F.explode_outer(F.concat(_template_table(), strangers)).alias("t")).select("t.family", "t.text")
    w = seeds.select("family", F.split("text", " ").alias("w"))
    around = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in (("", ""), ("Copyright 2020 the authors.", ""), ("", "See the file for details."), ("Notice:", "All rights reserved."))))
    varied = w.select("family", "w", F.explode_outer(F.sequence(F.lit(-1), F.when(F.size("w") < 3, -1).otherwise(F.size("w") - 1))).alias("k")).select("family", "w", "k", F.explode_outer(around).alias("x"))
    line = F.concat_ws(" ", F.col("x.a"), F.array_join(F.filter("w", lambda _, i: i != F.col("k")), " "), F.col("x.b"))
    good = varied.select(F.col("family").alias("label"), line.alias("line"))
    other = spark.range(1).select(F.lit(NONE).alias("label"), F.explode_outer(F.array(*map(F.lit, OTHERS))).alias("line"))
    # Whole documents are drawn first, by hashes alone, some with and some without hints of a licence; of their lines and blocks as many again.
    body = F.coalesce(F.col(text), F.lit(""))
    hint = F.regexp_like(body, F.lit(HINT))
    hashes = docs.select(hint.alias("hint"), F.xxhash64(body).alias("draw"))
    least = [hashes.where("hint" if some else "not hint").select("draw").distinct().orderBy("draw").limit(sample // 4) for some in (True, False)]
    chosen = written(least[0].unionByName(least[1]), "licence-draws")
    texts = docs.select(body.alias("text")).withColumn("draw", F.xxhash64("text")).join(F.broadcast(chosen), "draw", "left_semi")
    lines = F.split("text", "\n", -1)
    joined = let(lines, lambda p: F.concat(p, F.transform(F.filter(blocks(F.transform(p, lambda x: F.size(words_of(x)))), lambda b: b["n"] > 1),
                                                          lambda b: F.array_join(F.slice(p, b["first"] + 1, b["n"]), " "))))
    keyed = F.regexp_like(F.lower("line"), F.lit(KEYS)) | F.regexp_like(F.lower("line"), F.lit(DECLARES))
    every = written(texts.select(F.explode_outer(joined).alias("line")).where("line != ''").distinct(), "licence-lines").withColumns({"keyed": keyed, "draw": F.xxhash64("line")})
    drawn = written(every.where("keyed").orderBy("draw", "line").limit(sample // 2).unionByName(every.where("not keyed").orderBy("draw", "line").limit(sample // 2)).select("line"), "licence-sample")
    near = F.array_max(F.transform(support(F.col("line"), template_grams()), lambda s: s["share"]))
    own = drawn.where(near < 0.5).select(F.when(F.regexp_like(F.lower("line"), F.lit(DECLARES)), UNKNOWN).otherwise(NONE).alias("label"), "line")
    return good.unionByName(other).unionByName(own).distinct().withColumn("draw", F.xxhash64("line", F.lit(3)))


def _constant(values: list, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(values)), kind)


@dataclass
class Classifier:
    """The feature of each bucket (0: none), weights by class and feature, intercepts, the least probability of a family, and the least one
    of not being none."""

    index: list[int]
    weights: list[list[float]]
    intercepts: list[float]
    least: float
    strange: float = 0.5

    def features(self, words: Column) -> Column:
        """Distinct features of a paragraph; buckets without one weigh nothing."""
        return F.array_distinct(F.filter(F.transform(buckets(words), lambda x: F.get(_constant(self.index, "array<int>"), x)), lambda x: x > 0))

    def far(self, known: Column) -> Column:
        """Whether no class can be above none: an upper bound of all margins over that of none is negative."""
        none = CLASSES.index(NONE)
        others = [w for c, w in enumerate(self.weights) if c != none]
        gain = [round(max(column) - base, 9) for base, column in zip(self.weights[none], zip(*others))]
        lead = max(self.intercepts[c] - self.intercepts[none] for c in range(len(CLASSES)) if c != none)
        return F.aggregate(known, F.lit(lead + 1e-5), lambda a, x: a + F.get(_constant(gain, "array<double>"), x)) < 0

    def best(self, words: Column) -> Column:
        """struct<p, family, any> from the hashes of a paragraph's words: the most probable class; of equals the last in alphabetical order;
        ``any``: the probability that it is not none. Null if it is none by ``far``."""
        return let(self.features(words), lambda g: F.when(~self.far(g), self.most_probable(g)))

    def most_probable(self, known: Column) -> Column:
        w, b = _constant(self.weights, "array<array<double>>"), _constant(self.intercepts, "array<double>")
        names = F.array(*map(F.lit, CLASSES))
        margins = lambda g: F.transform(w, lambda own, c: F.get(b, c) + F.aggregate(g, F.lit(0.0), lambda a, x: a + F.get(own, x)))

        def chosen(e: Column) -> Column:
            return let(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda total: F.array_max(F.transform(e, lambda x, c: F.struct(
                (x / total).alias("p"), F.get(names, c).alias("family"), (1 - F.get(e, F.lit(CLASSES.index(NONE))) / total).alias("any")))))

        powers = lambda m: let(F.array_max(m), lambda top: F.transform(m, lambda x: F.exp(x - top)))
        return let(let(margins(known), powers), chosen)


def fit(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> Classifier:
    written_down = F.col("line").isin([t for texts in TEMPLATES.values() for t in texts])  # always taught, and with more weight than variants
    rows = examples(docs, text, sample).withColumns({"weight": F.when(written_down, 6.0).otherwise(1.0),
                                                     "held": (F.pmod(F.col("draw"), F.lit(5)) == 0) & ~written_down})
    rows = written(rows, "licence-examples")
    index = F.array_position(F.array(*map(F.lit, CLASSES)), F.col("label")) - 1
    named = let(hashed(F.col("line")), lambda w: F.array_distinct(F.transform(buckets(w), lambda x: x.cast("string"))))
    train = rows.where("not held").select(index.cast("double").alias("label"), "weight", named.alias("names")).coalesce(2)
    # Features: the buckets of licence paragraphs, and those of several other paragraphs of the sample.
    seen = train.select("label", F.explode("names").alias("name")).groupBy("name").agg(F.count("*").alias("n"), F.min("label").alias("least"))
    chosen = seen.where((F.col("n") >= SEEN) | (F.col("least") < CLASSES.index(NONE))).select("name")
    names = sorted(int(r["name"]) for r in bounded_rows(chosen, BUCKETS, "features"))
    vectors = CountVectorizerModel.from_vocabulary([*map(str, names)], inputCol="names", outputCol="features").setBinary(True).setMinTF(1.0)
    model = LogisticRegression(family="multinomial", maxIter=30, regParam=0.002, standardization=False, weightCol="weight").fit(
        vectors.transform(train).select("label", "weight", "features"))
    matrix, shift = model.coefficientMatrix.toArray().tolist(), model.interceptVector.toArray().tolist()
    gone, place = len(CLASSES) - len(matrix), {x: k for k, x in enumerate(names, 1)}
    fitted = Classifier([place.get(x, 0) for x in range(BUCKETS)], [[0.0, *(round(x, 6) for x in r)] for r in matrix] + [[0.0] * (len(names) + 1)] * gone,
                        [*shift, *[-1e9] * gone], 1.0)
    tested = rows.where("held").select("label", let(hashed(F.col("line")), fitted.best).alias("x")).select("label", "x.*")
    judged = bounded_rows(tested, 100_000, "calibration paragraphs")
    fitted.strange = max([0.5, *(r["any"] + 1e-6 for r in judged if r["label"] == NONE and r["any"] is not None)])
    scored = sorted(((r["p"], r["label"] == r["family"]) for r in judged if r["family"] not in (None, NONE, UNKNOWN)), reverse=True)
    right = 0
    for n, (p, ok) in enumerate(scored, 1):
        right += ok
        if right >= PRECISION * n and (n == len(scored) or scored[n][0] < p):
            fitted.least = math.floor(p * 1e6) / 1e6
    return fitted


def scanned(docs: DataFrame, model: Classifier, text: str = "text") -> DataFrame:
    """Adds families (array<string>, in order), n_licence (confirmed paragraphs), n_unknown and licence: the family of most
    paragraphs, ``unknown`` or ``none``."""
    new = ("families", "n_licence", "n_unknown", "licence")
    templates = template_grams()

    def judged(words: Column, paragraph: Callable[[], Column]) -> Column:
        """The class of a paragraph, from the hashes of its words; its text is looked at only where no class is ruled out."""
        def of(best: Column) -> Column:
            held = lambda: support(paragraph(), templates)
            confirmed = F.exists(held(), lambda s: (s["family"] == best["family"]) & (s["share"] >= CONFIRM))
            return (F.when(best.isNull() | (best["family"] == NONE), NONE)
                    .when((best["family"] != UNKNOWN) & (best["p"] >= model.least) & confirmed, best["family"])
                    .when((best["any"] >= model.strange) | F.exists(held(), lambda s: s["share"] >= CONFIRM), UNKNOWN).otherwise(NONE))

        return F.when(F.size(words) > 0, let(model.best(words), of)).otherwise(NONE)

    def wrapped(lines: Column, words: Column, own: Column, block: Column) -> Column:
        """What a block says: the classes of its lines, or the family of the whole where no line is of a family."""
        part = lambda x: F.slice(x, block["first"] + 1, block["n"])
        alone = part(own)
        whole = lambda: let(judged(F.flatten(part(words)), lambda: F.array_join(part(lines), " ")), lambda x: F.when(
            x == NONE, alone).when((x == UNKNOWN) & F.exists(alone, lambda y: y == UNKNOWN), alone).otherwise(F.array(x)))
        return F.when((block["n"] < 2) | F.exists(alone, lambda x: ~x.isin(NONE, UNKNOWN)), alone).otherwise(whole())

    # Every line is taken apart once; lines and blocks are judged on slices of the result.
    by_line = lambda p, h: F.zip_with(p, h, lambda line, w: judged(w, lambda: line))
    every = lambda p: let(F.transform(p, hashed), lambda h: let(by_line(p, h), lambda own: F.flatten(F.transform(
        blocks(F.transform(h, F.size)), lambda b: wrapped(p, h, own, b)))))
    found = let(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), every)
    real = lambda f: F.filter(f, lambda x: ~x.isin(NONE, "unknown"))
    most = lambda f: F.array_max(F.transform(F.array_distinct(f), lambda x: F.struct(F.size(F.filter(f, lambda y: y == x)).alias("n"), x.alias("family"))))["family"]
    result = let(found, lambda f: let(F.struct(real(f).alias("real"), F.size(F.filter(f, lambda x: x == "unknown")).alias("unknown")), lambda s: F.struct(
        F.array_sort(F.array_distinct(s["real"])).alias("families"), F.size(s["real"]).cast("long").alias("n_licence"), s["unknown"].cast("long").alias("n_unknown"),
        F.coalesce(most(s["real"]), F.when(s["unknown"] > 0, "unknown").otherwise(NONE)).alias("licence"))))
    kept = [c for c in docs.columns if c not in new or c == text]
    scan = spare(docs, "scan")
    return docs.withColumn(scan, result).select(*kept, *(F.col(f"{scan}.{c}").alias(c) for c in new))
