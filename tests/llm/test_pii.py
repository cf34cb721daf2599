import hashlib
import random
import re

from gridsonde.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    total = 0
    for k, c in enumerate(reversed(d)):
        n = int(c) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def brute(text):
    t = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(t) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 10 <= len(digits(m)) <= 15]
    return sorted(out)


def digest(spans):
    shown = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
    return shown, hashlib.sha256(shown.encode()).hexdigest()


def texts():
    rng = random.Random(9)
    parts = ["a.b@c.d", "@", "x@y", "x@y.z.", "1.2.3.4", "001.2.3.0255", "1.2.3.4.5.6.7.8", "256.1.1.1", "4539 1488 0343 6467", "4539148803436467", "4111-1111-1111-1111",
             "+1 (017) 555-7713", "+49 30 1234567", "+1", "é", "🙂", "\n", " ", "-", "..", "%", "123", "0" * 25, "a@b.c_x@y.z", "tel ", "(", ")", "a@b..c@d.e", "call 030 1234567"]
    out = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(250)]
    out += [None, "", "a" * 20000, "1" * 20000, "1." * 8000, "a@b" + ".c" * 6000, "+" * 3000 + "1" * 3000, "9" * 30 + "\n" + "é" * 300 + " joe@x.example.com"]
    out.append(" ".join(f"u{k}@h{k}.org" for k in range(700)))
    return out


def test_base_spans_equal_brute_force(spark):
    rows = [(k, t, "old", "x") for k, t in enumerate(texts())] + [(None, None, None, None), (0, "again a@b.c", "y", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, extra string")
    got = pii.spans(df, pii.Trees([], float("inf")))
    assert got.columns == ["doc_id", "text", "extra", *(f"n_{k}" for k in pii.KINDS), "base_sha256", "spans"]
    for r in got.collect():
        want = brute(r["text"])
        shown, sha = digest(want)
        assert (r["spans"], r["base_sha256"]) == (shown, sha), (r["text"] or "")[:80]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == k for s in want) for k in range(4)]
    assert pii.spans(df.limit(0), pii.Trees([], 0.0)).collect() == []


def test_prefix_sums(spark):
    for n in (0, 1, 63, 64, 65, 200, 5000):
        values = [k % 7 for k in range(n)]
        df = spark.createDataFrame([(values,)], "x array<int>")
        want = [sum(values[:k + 1]) for k in range(n)] if n < 1000 else [sum(values[:5])]
        got = df.select(pii.prefix_sums(df["x"])).first()[0]
        assert (got if n < 1000 else [got[4]]) == want and len(got) == n


def test_learned_spans_add_to_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    model = pii.fit(docs)
    assert model.trees and model.least < float("inf")
    own = spark.createDataFrame([(1, "please call me: (212) 555-0188 today"), (2, "mail kim (at) mail [dot] example [dot] com"), (3, "order 20230415 page 3"),
                                 (4, "Nothing here at all. Numbers 12 and 1999 only."), (5, "mail a.b@c.org now")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.spans(own, model).collect()}
    assert got[1]["spans"] == "phone:16:30" and got[2]["spans"].startswith("email:5:")
    assert got[3]["spans"] == got[4]["spans"] == "" and got[5]["spans"] == "email:5:14"
    for r in pii.spans(docs, model).collect():
        base = brute(r["text"])
        every = [tuple(x.split(":")) for x in r["spans"].split(",") if x]
        assert r["base_sha256"] == digest(base)[1] and {f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base} <= set(r["spans"].split(","))
        added = [(int(a), int(b)) for _, a, b in every if (int(a), int(b)) not in {(s[0], s[2]) for s in base}]
        assert all(a >= s[2] or b <= s[0] for a, b in added for s in base)
    empty = pii.fit(docs.limit(0))
    assert pii.spans(docs, empty).count() == docs.count()


SEP = r"(?:[ ().-]{0,2}|[ ]?[(\[](?:\.|dot)[)\]][ ]?|[ ]dot[ ])"


def brute_numbers(t):
    """All runs of neighbouring digit groups as (start, kind, end)."""
    groups = [(m.start(), m.end()) for m in re.finditer("[0-9]+", t)]
    out = set()
    for i, (a, _) in enumerate(groups):
        for j in range(i, min(i + pii.GROUPS, len(groups))):
            gaps = [t[groups[k][1]:groups[k + 1][0]] for k in range(i, j)]
            if not all(re.fullmatch(SEP, g) for g in gaps):
                break
            d = re.sub("[^0-9]", "", t[a:groups[j][1]])
            lead = re.search(r"\+?\(?$", t[max(0, a - 2):a])[0]
            span = lambda k: (a - len(lead), k, groups[j][1])
            dots = all(re.fullmatch(r" ?[(\[]?(?:\.|dot)[)\]]? ?", g) for g in gaps)
            if j == i + 3 and dots and not lead and len(d) <= 12 and all(y - x <= 3 for x, y in groups[i:j + 1]):
                out.add(span(1))
            if 13 <= len(d) <= 19 and luhn(d):
                out.add(span(2))
            if 7 <= len(d) <= 15:
                out.add(span(3))
    return out


def test_candidates_equal_all_runs(spark):
    rng = random.Random(4)
    parts = ["4539", "1488 0343", "6467", " ", "-", ".", "(212)", "555", "0188", "[.]", " dot ", "(dot)", "7", "1", "x", "\n", ", ", "192.168", "0" * 12, "00000000", "é"]
    own = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 16))) for _ in range(300)]
    own += ["", "card no 12 4539 1488 0343 6467", "212-555-0188 212-555-0199", "1 " * 400, "12.34." * 100, "9" * 5000]
    df = spark.createDataFrame([(k, "a " + t) for k, t in enumerate(own)], "id long, text string")
    for r in df.select("id", "text", pii.candidates(df["text"]).alias("c")).collect():
        got = [(c["start"], c["kind"], c["end"]) for c in r["c"] if c["kind"] != 0]
        assert len(set(got)) == len(got) and set(got) == brute_numbers(r["text"]), r["text"][:80]
        assert all(c["text"] == r["text"][c["start"]:c["end"]] and len(c["f"]) == len(pii.FEATURES) for c in r["c"])


def test_mail_is_cut_after_every_label(spark):
    df = spark.createDataFrame([("to kim at a dot b dot c now",), ("x@y.z",), ("x@y",), ("j [at] k . l . M",)], "text string")
    got = [[r[0][c["start"]:c["end"]] for c in r[1]] for r in df.select("text", pii.candidates(df["text"])).collect()]
    assert got == [["kim at a dot b", "kim at a dot b dot c"], ["x@y.z"], [], ["j [at] k . l", "j [at] k . l . M"]]


def test_overlapping_candidates_are_chosen_by_margin(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    model = pii.fit(docs)
    own = {"card no 12 4539 1488 0343 6467": ["card:11:30"], "visa 4539 1488 0343 6467 12/27": ["card:5:24"], "call 212-555-0188 212-555-0199": ["phone:5:17", "phone:18:30"],
           "card 4539.1488.0343.6467": ["card:5:24"], "server at 192[.]168[.]1[.]7": ["ip:10:27"], "kim at example dot com": ["email:0:22"], "ssn 123-45-6789": [],
           "he sat at home . Then": [], "2024-01-15 10:30 to 2024-01-16": [], "1 2 3 4 5 6 7 8 9 10 11 12": []}
    df = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")
    for r in pii.spans(df, model).collect():
        assert [s for s in r["spans"].split(",") if s] == own[r["text"]], r["text"]

    def margin(f):
        def value(node):
            while isinstance(node, tuple):
                node = node[2] if f[node[0]] <= node[1] else node[3]
            return node
        return sum(w * value(t) for w, t in model.trees)

    some = docs.unionByName(df).where("length(text) < 3000")
    for r in pii.spans(some, model).withColumn("c", pii.candidates(some["text"])).collect():
        taken = [(a, b) for a, _, b in brute(r["text"])]
        scored = sorted((-margin(c["f"]), c["start"], c["kind"], c["end"]) for c in r["c"])
        want = []
        for m, a, k, b in scored:
            if -m >= model.least and all(b <= x or a >= y for x, y in taken):
                taken.append((a, b))
                want.append((a, k, b))
        assert r["spans"] == digest(sorted(brute(r["text"]) + want))[0]


def test_greedy_choice_over_blocks_and_pages(spark):
    rng = random.Random(8)
    rows = []
    for length in (1, 600, pii.BLOCK * pii.PAGE - 1, 3 * pii.BLOCK * pii.PAGE + 5):
        own = [(-rng.randint(0, 9) / 4, a, rng.randint(0, 3), min(length, a + rng.randint(1, pii.BLOCK))) for a in (rng.randrange(length) for _ in range(400))]
        rows.append((sorted(own), length))
    rows.append(([], 0))
    df = spark.createDataFrame(rows, f"ranked array<{pii.CHOSEN}>, length int")
    for r in df.select("ranked", pii.without_overlaps(df["ranked"], df["length"]).alias("taken")).collect():
        want = []
        for c in r["ranked"]:
            if all(c["end"] <= o["start"] or c["start"] >= o["end"] for o in want):
                want.append(c)
        assert sorted(r["taken"]) == sorted(want)


def test_long_texts_of_numbers_alone(spark):
    tree = (3, 8.5, (0, 0.5, -1.0, 0.3), (5, 3.5, 1.0, 0.2))
    model = pii.Trees([(1.0, tree)], 0.0)
    unit = "+1 (017) 555-7713 a@b.c 12 12 12 4539148803436467 1.2.3.4 "
    own = ["12 " * 12000, "1. " * 12000, unit * 700]
    df = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")
    for r in pii.spans(df, model).collect():
        t = r["text"]
        every = [(int(a), pii.KINDS.index(k), int(b)) for k, a, b in (x.split(":") for x in r["spans"].split(",") if x)]
        base = brute(t)
        assert r["base_sha256"] == digest(base)[1] and set(base) <= set(every) and every == sorted(every)
        taken = bytearray(len(t))
        for a, _, b in base:
            taken[a:b] = b"1" * (b - a)
        for a, _, b in sorted(set(every) - set(base)):
            assert not any(taken[a:b])
            taken[a:b] = b"1" * (b - a)
    assert every
