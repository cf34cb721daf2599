import itertools
import re
import struct

import numpy as np
import xxhash
from pyspark.sql import functions as F

from gridsonde.llm import licences, queries

LINES = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
         "Licensed under CC BY-NC 4.0.": "CC-BY-NC", "Released under the MIT License.": "MIT"}


def words(t):
    return re.findall(r"[^\W_]+", t.lower())


def gram_set(t):
    w = words(t)
    return {*w, *map(" ".join, zip(w, w[1:]))}


def test_support_equals_sets(spark):
    lines = [*LINES, "", "gnu", "the apache license", "licensed under CC BY 4.0 and the MIT license"]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    for r in df.select("line", licences.support(df["line"], licences.template_grams()).alias("s")).collect():
        want = [(f, len(gram_set(t) & gram_set(r["line"])) / len(gram_set(t))) for f, ts in licences.TEMPLATES.items() for t in ts]
        assert [(s["family"], round(s["share"], 9)) for s in r["s"]] == [(f, round(x, 9)) for f, x in want]


def test_planted_lines_are_found_and_others_left(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.op7_licences(spark, sf).collect()}
    assert set(got) == set(texts)
    for d, t in texts.items():
        want = sorted({LINES[x] for x in t.split("\n") if x in LINES})
        assert got[d]["families"] == want and got[d]["n_unknown"] == 0, t[:80]
        assert got[d]["n_licence"] == sum(x in LINES for x in t.split("\n")) and (got[d]["licence"] == "none") == (not want)


def test_variants_unknown_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, "x\nThis file is licensed under the MIT license, see below\ny"), (2, "The apache helicopter landed near the village"), (3, None), (4, ""),
                                  (5, "Licensed under CC BY-SA 4.0\nLicensed under CC BY-SA 4.0\nReleased under the BSD license"), (None, "plain"), (6, "word " * 40000 + "\ngnu")],
                                 "doc_id long, text string").selectExpr("*", "'z' AS licence", "1 AS n_unknown")
    model = licences.fit(docs)
    got = {r["doc_id"]: r for r in licences.scanned(docs, model).collect()}
    assert got[1]["licence"] == "MIT" and got[2]["licence"] == "none" and got[5]["licence"] == "CC-BY-SA" and got[5]["families"] == ["BSD", "CC-BY-SA"]
    assert all(got[k]["licence"] == "none" and got[k]["families"] == [] for k in (3, 4, None))
    assert licences.scanned(docs.limit(0), licences.fit(docs.limit(0))).collect() == []


def test_paragraphs_without_key_words_wrapped_lines_and_strangers(spark):
    texts = {1: ("Licensed under CC-BY-SA 4.0", "CC-BY-SA"), 2: ("Licensed under CC  BY 4.0", "CC-BY"), 3: ("Released under the MIT-License", "MIT"),
             4: ("intro words\n\nPermission is hereby granted, free of charge,\nto any person obtaining\na copy of this software\n\nmore words", "MIT"),
             5: ("Licensed under the GPLv3", "GPL-3.0"), 6: ("Licensed under LGPLv2.1", "LGPL"), 7: ("Licensed under the ISC License.", "unknown"),
             8: ("Licensed under the EUPL, Version 1.2 or later", "unknown"), 9: ("Distributed under the Boost Software License, Version 1.0.", "unknown"),
             10: ("The river rose in the night.\nThe bridge was closed for a week.\n\nNothing else happened.", "none"), 11: ("?!\n\n...", "none")}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    own = spark.createDataFrame([(k, t) for k, (t, _) in texts.items()], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licences.scanned(own, licences.fit(docs)).collect()}
    assert {k: got[k]["licence"] for k in texts} == {k: want for k, (_, want) in texts.items()}
    assert got[4]["n_licence"] == 1 and got[4]["n_unknown"] == 0


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def bucket_set(line):
    """Buckets of words and pairs as Spark hashes them."""
    h = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in words(line)]
    pairs = [xxhash.xxh64_intdigest(struct.pack("<Q", b), seed=xxhash.xxh64_intdigest(struct.pack("<Q", a), seed=42)) for a, b in zip(h, h[1:])]
    return {signed(x) % licences.BUCKETS for x in (*h, *pairs)}


def test_classes_margins_and_blocks_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    model = licences.fit(docs)
    lines = sorted({x for r in docs.limit(60).collect() for x in r["text"].split("\n") if words(x)})[:300]
    lines += [t for ts in licences.TEMPLATES.values() for t in ts] + [*licences.STRANGERS, *licences.OTHERS, "word " * 3000]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    none, ruled_out = licences.CLASSES.index(licences.NONE), 0
    for r in df.select("line", licences.let(licences.hashed(df["line"]), model.best).alias("x")).collect():
        own = {model.index[k] for k in bucket_set(r["line"])} - {0}
        margins = np.array([b + sum(w[k] for k in own) for w, b in zip(model.weights, model.intercepts)])
        powers = np.exp(margins - margins.max())
        p = powers / powers.sum()
        if r["x"] is None:
            ruled_out += 1
            assert margins.argmax() == none, r["line"]
        else:
            assert r["x"]["family"] == licences.CLASSES[int(p.argmax())] and abs(r["x"]["p"] - p.max()) < 1e-6 and abs(r["x"]["any"] - (1 - p[none])) < 1e-6
    assert ruled_out > 200
    for sizes in ([], [0], [1], [0, 0], [1, 2, 0, 3], [0, 1, 0, 0, 2, 2], [3, 3, 3]):
        got = spark.range(1).select(licences.blocks(F.lit(sizes).cast("array<int>")).alias("b")).first()["b"]
        want, at = [], 0
        for full, run in itertools.groupby(sizes, bool):
            n = len(list(run))
            want += [(at, n)] if full else []
            at += n
        assert [tuple(x) for x in got] == want


def test_headings_and_paragraphs_of_licences(spark):
    told = {"This project is MIT licensed": "MIT", "Licensed under the GNU GPL v3": "GPL-3.0", "Licensed under GPL-3.0-or-later": "GPL-3.0",
            "                                 Apache License\n                           Version 2.0, January 2004": "Apache-2.0",
            "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007": "GPL-3.0",
            "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:": "BSD",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal": "MIT"}
    odd = {"Beerware": "unknown", "Released under the Elastic License 2.0": "unknown", "The driving licence was renewed in June": "none"}
    every = [*told.items(), *odd.items()]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    own = spark.createDataFrame([(k, f"Some words.\n\n{t}\n\nMore words.") for k, (t, _) in enumerate(every)] * 2, "doc_id long, text string")
    rows = licences.scanned(own, licences.fit(docs)).collect()
    got = {r["doc_id"]: r["licence"] for r in rows}
    assert len(rows) == 2 * len(every)
    assert {every[k][0]: x for k, x in got.items() if every[k][0] in told} == told
    assert got[len(told) + 2] == "none" and "none" != got[len(told) + 1]
