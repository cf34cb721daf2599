"""Personal data: patterns that always count, and overlapping candidates chosen by boosted trees.

Base spans are the leftmost matches of a pattern per kind that pass its check (address parts up to 255, Luhn digits, ten
to fifteen digits). Generators of high recall propose further spans, which overlap one another and the base spans:

* every run of neighbouring digit groups, from each group on up to 19 digits in up to ``GROUPS`` groups, as phone (7 to 15
  digits), as card (13 to 19 that pass Luhn's check) and, of four short groups between plain or spelt dots, as network
  address; a sign or bracket in front belongs to the run;
* mail addresses with plain or spelt-out signs, cut after every label of the domain (up to ``MAIL_CHARS`` code points).

Features describe a candidate's kind, its format, the words around it and whether digits go on beside it. Gradient-boosted
trees are fitted on candidates of the corpus (positive if they equal a base span of their kind) and on written examples:
contexts crossed with formats, whose digits are drawn by hash and whose only positives are the spans written in. A threshold
calibrated on held-out examples selects candidates; among overlapping ones the greatest margin goes first (ties: the first by
start, kind, end). Base spans are never dropped, and added spans overlap neither these nor one another.

Everything is built of SQL functions on one row, so that there is no shuffle but that of the bounded training sample.
Offsets count code points of the whole text, ends are exclusive. Patterns are written so that matching takes time in
proportion to the text: runs are possessive, and matches start at the beginning of a run. A text has at most ``GROUPS`` runs
from each digit group, so candidates too grow in proportion to the text. Candidates are scored as they are made and only those above
the threshold are held; what they overlap is looked up by place, so that texts of numbers alone take time in proportion, too.

Bounds: at most ``SAMPLE`` candidates of the corpus are learned from, those with the least hashes; the written examples are
a fixed number. Only held-out examples reach the driver.

Odd cases: null and empty text has no spans. Without candidates, or with one class only, nothing is added. Rows are judged
one by one, so repeated rows have equal results. Extra columns pass through, columns named like results are replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridsonde.llm.shared import bounded_rows, let, spare, written

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators: mail addresses with plain or spelt-out signs, their label parts, and runs of digit groups.
_DOT = r"(?:\x20?(?:\.|[(\[]dot[)\]]|DOT)\x20?|\x20dot\x20)"
_MAIL_HEAD = r"[A-Za-z0-9._%+-]{1,64}+(?:\x20?(?:@|[(\[]at[)\]]|AT)\x20?|\x20at\x20)[A-Za-z0-9-]++"
MAIL = rf"(?:\G|(?<![A-Za-z0-9._%+-])){_MAIL_HEAD}(?:{_DOT}[A-Za-z0-9-]++)++"
MAIL_HINT = r"@|[(\[]at[)\]]|AT|\x20at\x20[A-Za-z0-9-]++\x20dot\x20"
RUN = r"(?:\+|(?<![0-9]))\(?[0-9](?:(?:[\x20().-]{0,2}|\x20?[(\[](?:\.|dot)[)\]]\x20?|\x20dot\x20)[0-9])++"
QUAD = r"^[0-9]{1,3}(?:\x20?[(\[]?(?:\.|dot)[)\]]?\x20?[0-9]{1,3}){3}$"
SAMPLE, DEPTH, ROUNDS, STEP, PRECISION = 4000, 5, 20, 0.4, 0.998
COPIES, WRITTEN = 4, 100_000
CONTEXT, MAIL_CHARS, GROUPS = 24, 320, 8
#: Code points of a block (more than the longest candidate) and blocks of a page, in which chosen spans are looked up.
BLOCK, PAGE = 512, 64
SPAN = "struct<start:int,kind:int,end:int>"
CHOSEN = "struct<m:double,start:int,kind:int,end:int>"


def cut(values: Column, first: Column, count: Column) -> Column:
    """Up to ``count`` elements from position ``first`` on. ``slice`` copies the whole array first, so taking many short cuts of a long
    array that way would cost its square."""
    last = F.least(first + count, F.size(values)) - 1
    return F.when(last >= first, F.transform(F.sequence(first, last), lambda k: F.get(values, k))).otherwise(F.filter(F.array(F.get(values, F.lit(0))), lambda _: F.lit(False)))


def prefix_sums(lengths: Column, block: int = 128) -> Column:
    """Running totals of an array of integers, by blocks, so that long arrays stay cheap."""
    add = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)

    def sums(x: Column) -> Column:
        place = lambda k: F.floor(k / block).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), place(F.size(x) - 1)), lambda b: add(cut(x, b * block, F.lit(block))))
        whole = lambda t: F.transform(t, lambda _, b: add(cut(t, F.lit(0), b)))
        within = lambda w: F.transform(x, lambda _, k: F.get(w, place(k)) + add(cut(x, place(k) * block, k % block + 1)))
        return let(blocks, lambda t: let(whole(t), within))

    return let(lengths, lambda x: F.when(F.size(x) == 0, F.array().cast("array<int>")).otherwise(sums(x)))


def matches(text: Column, pattern: str, hint: Column) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, end, text, before, after>>; ``hint``: there may be some."""
    kind = "array<struct<start:int,end:int,text:string,before:string,after:string>>"

    def placed(m: Column) -> Column:
        def with_gaps(g: Column) -> Column:
            steps = F.transform(m, lambda x, k: F.char_length(F.get(g, k)) + F.char_length(x))
            found = lambda ends: F.transform(m, lambda x, k: F.struct(
                (F.get(ends, k) - F.char_length(x)).alias("start"), F.get(ends, k).alias("end"), x.alias("text"),
                F.right(F.get(g, k), F.lit(CONTEXT)).alias("before"), F.left(F.get(g, k + 1), F.lit(CONTEXT)).alias("after")))
            return let(prefix_sums(steps), found)

        return F.when(F.size(m) == 0, F.array().cast(kind)).otherwise(let(F.split(text, pattern, -1), with_gaps))

    return F.when(hint, let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)).otherwise(F.array().cast(kind))


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn_sum(number: Column) -> Column:
    """Sum of a string of digits, every second one from the right doubled."""
    def total(r: Column) -> Column:
        doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        value = lambda i: F.substr(r, i, F.lit(1)).cast("int")
        worth = F.transform(F.sequence(F.lit(1), F.length(r)), lambda i: F.when(i % 2 == 0, let(value(i), doubled)).otherwise(value(i)))
        return F.aggregate(worth, F.lit(0), lambda a, x: a + x)

    return F.when(F.length(number) > 0, let(F.reverse(number), total))


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    return F.coalesce(luhn_sum(number) % 10 == 0, F.lit(False))


def quad(x: Column) -> Column:
    """Whether all parts of a dotted number are at most 255."""
    small = lambda z: (F.length(z) <= 3) & (F.when(F.length(z).between(1, 3), z.cast("int")).otherwise(0) <= 255)
    return F.forall(F.split(x, r"\.", -1), lambda p: let(F.regexp_replace(p, "^0+", ""), small))


CHECKS: dict[str, Callable[[Column], Column]] = {
    "email": lambda x: F.lit(True),
    "ip": quad,
    "card": lambda x: let(digits(x), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False)),
    "phone": lambda x: F.length(digits(x)).between(10, 15),
}


def _hint(kind: str, text: Column) -> Column:
    if kind == "email":
        return F.contains(text, F.lit("@"))
    if kind == "phone":
        return F.contains(text, F.lit("+"))
    return F.regexp_like(text, F.lit("[0-9]"))


def _passes(check: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda m: check(m["text"])


def _span(kind: int, *more: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"), *(of(m) for of in more))


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, end>> of all kinds, sorted by start, then kind."""
    parts = []
    for k, kind in enumerate(KINDS):
        good = F.filter(matches(text, PATTERNS[kind], _hint(kind, text)), _passes(CHECKS[kind]))
        parts.append(F.transform(good, _span(k)))
    return F.sort_array(F.concat(*parts))


FEATURES = ("is_email", "is_ip", "is_card", "digits", "length", "groups", "first_group", "last_group", "plus", "at", "spelt", "spaces", "dots", "hyphens",
            "open", "close", "luhn", "quad", "long_group", "fours", "top_label", "phone_words", "card_words", "ip_words", "mail_words", "number_words",
            "letter_before", "letter_after", "sign_before", "sign_after", "tight_before", "tight_after", "loose_before", "loose_after",
            "label_after")


def features(kind: Column, m: Column) -> Column:
    """Kind, format and context of a candidate as numbers, in the order of ``FEATURES``."""
    x, before, after, yes = m["text"], F.lower(m["before"]), m["after"], lambda c: c.cast("double")

    def of(d: Column) -> Column:
        count = lambda p: F.regexp_count(x, F.lit(p)).cast("double")
        like = lambda s, p: yes(F.regexp_like(s, F.lit(p)))
        size = lambda p: yes(F.length(F.regexp_extract(x, p, 0)))
        n = F.length(d)
        return F.array(
            yes(kind == 0), yes(kind == 1), yes(kind == 2), n.cast("double"), F.char_length(x).cast("double"), count("[0-9]++"), size("[0-9]+"), size("[0-9]+$"),
            like(x, r"^\+"), like(x, "@"), like(x, r"[(\[](?:at|dot|\.)|AT|DOT|\x20(?:at|dot)\x20"), count(r"\x20"), count(r"\."), count("-"), count(r"\("), count(r"\)"),
            yes(F.when(n.between(12, 19), luhn(d)).otherwise(False)), yes(F.forall(F.regexp_extract_all(x, F.lit("[0-9]+"), F.lit(0)), lambda g: (F.length(g) <= 3) & (F.when(F.length(g) <= 3, g.cast("int")).otherwise(256) <= 255))),
            like(x, "[0-9]{5}"), like(x, r"^[0-9]{4}(?:[\x20.-]?[0-9]{4}){2,3}[\x20.-]?[0-9]{0,4}$"), like(x, r"[\x20.)\]T][A-Za-z]{2,6}$"),
            like(before, r"(?:phone|tel|call|mobile|fax|cell|text|ring|dial)\b"), like(before, r"(?:card|visa|credit|iban|account|amex|paid)\b"),
            like(before, r"(?:ip|server|host|address|from|ping|dns)\b"), like(before, r"(?:mail|contact|write to|reach)\b"),
            like(before, r"(?:version|order|id|page|chapter|ref|isbn|year|total|invoice|ssn|serial|score|tracking|batch|sum|section)\b"),
            like(before, r"[a-z0-9_]$"), like(after, "^[A-Za-z0-9_]"), like(before, r"[#$%*/=:.,\"-]$"), like(after, r"^[#$%*/=:\"-]"),
            like(before, r"[0-9][.-]$"), like(after, r"^[.-][0-9]"), like(before, r"[0-9][\x20().-]{1,2}$"), like(after, r"^[\x20().-]{1,2}[0-9]"),
            like(after, f"^{_DOT}[A-Za-z0-9]"))

    return let(digits(x), of)


def _candidate(kind: Column, m: Column) -> Column:
    return F.struct(m["start"].alias("start"), kind.alias("kind"), m["end"].alias("end"), m["text"].alias("text"), features(kind, m).alias("f"))


def _part(start: Column, end: Column, text: Column, before: Column, after: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"), text.alias("text"), F.right(before, F.lit(CONTEXT)).alias("before"),
                    F.left(after, F.lit(CONTEXT)).alias("after"))


def _mail_cuts(m: Column) -> Column:
    """A mail match cut after each label of its domain but the first."""
    x = m["text"]

    def cuts(head: Column) -> Column:
        def at(labels: Column) -> Column:
            one = lambda n: F.concat(head, F.array_join(cut(labels, F.lit(0), n), ""))
            part = lambda t: _part(m["start"], m["start"] + F.char_length(t), t, m["before"], F.concat(F.substr(x, F.char_length(t) + 1, F.lit(CONTEXT)), m["after"]))
            return F.filter(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: let(one(n), part)), lambda c: c["end"] - c["start"] <= MAIL_CHARS)

        # a label and its dot take two code points at least
        rest = F.left(F.substr(x, F.char_length(head) + 1, F.char_length(x)), F.lit(MAIL_CHARS))
        return let(F.regexp_extract_all(rest, F.lit(f"{_DOT}[A-Za-z0-9-]++"), F.lit(0)), lambda y: F.when(F.size(y) > 0, at(y)).otherwise(F.array().cast(PART)))

    return let(F.regexp_extract(x, f"^{_MAIL_HEAD}", 0), cuts)


PART = "array<struct<start:int,end:int,text:string,before:string,after:string>>"


def _digit_runs(m: Column, finish: Callable[[Column], Column]) -> Column:
    """What ``finish`` makes of the runs of neighbouring digit groups within a match, of 4 to 19 digits, group by group: no more than
    the runs of one group is held besides the results."""
    x = m["text"]

    def of(groups: Column) -> Column:
        def with_gaps(gaps: Column) -> Column:
            tokens = F.transform(groups, lambda g, k: F.concat(F.get(gaps, k), g))
            return let(F.struct(tokens.alias("t"), prefix_sums(F.transform(groups, lambda g, k: F.char_length(F.get(gaps, k)) + F.length(g))).alias("ends"),
                                prefix_sums(F.transform(groups, lambda g: F.length(g))).alias("sums")), lambda s: runs(s, gaps))

        def runs(s: Column, gaps: Column) -> Column:
            n = F.size(groups)

            def from_group(i: Column) -> Column:
                own = F.length(F.get(groups, i))
                held = lambda j: F.get(s["sums"], j) - F.get(s["sums"], i) + own
                lasts = F.filter(F.sequence(i, F.least(i + GROUPS - 1, n - 1)), lambda j: held(j).between(4, 19))

                def with_lead(lead: Column) -> Column:
                    gap = F.get(gaps, i)
                    before = F.concat(F.when(i <= CONTEXT, m["before"]).otherwise(""), F.array_join(cut(s["t"], F.greatest(i - CONTEXT, F.lit(0)), F.least(i, F.lit(CONTEXT))), ""),
                                      F.left(gap, F.char_length(gap) - F.char_length(lead)))
                    text = lambda j: F.concat(lead, F.get(groups, i), F.array_join(cut(s["t"], i + 1, j - i), ""))
                    after = lambda j: F.concat(F.array_join(cut(s["t"], j + 1, F.lit(CONTEXT)), ""), F.when(n - 1 - j <= CONTEXT, m["after"]).otherwise(""))
                    start = m["start"] + F.get(s["ends"], i) - own - F.char_length(lead)
                    return finish(F.transform(lasts, lambda j: _part(start, m["start"] + F.get(s["ends"], j), text(j), before, after(j))))

                return let(F.regexp_extract(F.get(gaps, i), r"\+?\(?$", 0), with_lead)

            return F.flatten(F.transform(F.sequence(F.lit(0), n - 1), from_group))

        return let(F.split(x, "[0-9]++", -1), with_gaps)

    return let(F.regexp_extract_all(x, F.lit("[0-9]++"), F.lit(0)), of)


def candidates(text: Column, make: Callable[[Column, Column], Column] = _candidate, keep: Callable[[Column], Column] | None = None) -> Column:
    """array<struct<start, kind, end, text, f>> of what the generators propose; spans of all kinds may overlap. ``make`` may turn a kind and
    a span into something smaller, and only what passes ``keep`` is held."""
    kept = (lambda a: F.filter(a, keep)) if keep else (lambda a: a)

    def kinds(m: Column) -> Column:
        def of(d: Column) -> Column:
            n, groups = F.length(d), F.regexp_count(m["text"], F.lit("[0-9]++"))
            fits = F.array(F.when((groups == 4) & (n <= 12) & F.regexp_like(m["text"], F.lit(QUAD)), F.lit(1)),
                           F.when(n.between(13, 19) & luhn(d), F.lit(2)), F.when(n.between(7, 15), F.lit(3)))
            return F.transform(F.array_compact(fits), lambda k: make(k, m))

        return let(digits(m["text"]), of)

    mails = F.transform(matches(text, MAIL, F.regexp_like(text, F.lit(MAIL_HINT))), lambda m: kept(F.transform(_mail_cuts(m), lambda c: make(F.lit(0), c))))
    long = F.filter(matches(text, RUN, _hint("card", text)), lambda m: F.char_length(m["text"]) >= 7)
    numbers = F.transform(long, lambda m: _digit_runs(m, lambda parts: kept(F.flatten(F.transform(parts, kinds)))))
    return F.sort_array(F.concat(F.flatten(mails), F.flatten(numbers)))


def covered(base: Column) -> Column:
    """One byte string a kind, with a 1 for every code point that a span of the kind covers."""
    def of(kind: int) -> Column:
        return let(F.filter(base, _of_kind(kind)), lambda x: F.array_join(F.transform(x, lambda s, k: F.concat(
            F.repeat(F.lit("0"), s["start"] - F.coalesce(F.get(x, k - 1)["end"], F.lit(0))), F.repeat(F.lit("1"), s["end"] - s["start"]))), "").cast("binary"))

    return F.array(*map(of, range(len(KINDS))))


def is_covered(masks: Column, c: Column) -> Column:
    return F.exists(masks, lambda w: F.contains(F.substr(w, c["start"] + 1, c["end"] - c["start"]), F.lit("1").cast("binary")))


def without_overlaps(ranked: Column, length: Column) -> Column:
    """Spans in their order that overlap none taken before. What is taken lies in blocks of the text, so that a span of at most ``BLOCK``
    code points is compared with three blocks, however long the text."""
    def near(a: Column, b: Column, c: Column) -> Column:
        return F.coalesce(F.exists(F.get(F.get(a, F.floor(b / PAGE).cast("int")), b % PAGE), lambda o: _overlaps(o, c)), F.lit(False))

    def step(a: Column, c: Column) -> Column:
        own = F.floor(c["start"] / BLOCK).cast("int")
        page = lambda p: F.transform(p, lambda b, k: F.when(k == own % PAGE, F.concat(b, F.array(c))).otherwise(b))
        put = F.transform(a, lambda p, k: F.when(k == F.floor(own / PAGE).cast("int"), page(p)).otherwise(p))
        return F.when(near(a, own - 1, c) | near(a, own, c) | near(a, own + 1, c), a).otherwise(put)

    none = F.array().cast(f"array<{CHOSEN}>")
    blank = F.array_repeat(F.array_repeat(none, PAGE), (F.floor(length / (BLOCK * PAGE)) + 1).cast("int"))
    return F.when(F.size(ranked) == 0, none).otherwise(F.flatten(F.flatten(F.aggregate(ranked, blank, step))))


def _overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


# Written examples. Within formats # is some digit, * and ~ are a right and a wrong last digit of Luhn's, % is a number up to 255,
# ? is some letter; a context shows its format at {}. The first list of a kind is personal data, the second is not.
EXAMPLES = {
    "phone": (("call {}", "call me: {} today", "Phone: {}", "tel. {}", "my mobile {}, evenings", "fax {}", "text {} or {}", "dial {} now", "call {} {}", "phone {} {}", "mobile {} {} {}", "tel {} / {}",
               "ring {}. Thanks"),
              ("##########", "(###) ###-####", "###-###-####", "#### ######", "### ### ####", "###.###.####", "+## ### #######", "0## #######", "+# (###) ###-####", "#-###-###-####")),
    "card": (("card no {}", "card no 12 {}", "visa {} 12/27", "credit card: {}", "card {} ok", "paid with {}", "account {} exp 01/29", "amex {}", "my card 3 {} 04/26", "card {}, {}"),
             ("#### #### #### ###*", "####-####-####-###*", "####.####.####.###*", "###############*", "#### ###### ####*", "#### #### #### #### ##*")),
    "ip": (("server at {}", "ip {}", "host {} is down", "ping {}, please", "address {}", "from {} again", "dns {}"),
           ("%[.]%[.]%[.]%", "%(.)%(.)%(.)%", "% dot % dot % dot %", "%[dot]%[dot]%[dot]%", "% [.] % [.] % [.] %", "%.%.%.%")),
    "email": (("mail {}", "contact {}", "write to {} soon", "mail: {}. Thanks", "{} is mine", "reach me, {}"),
              ("???.??## (at) ????.org", "??? [at] ???? [dot] ????.com", "??.?@????# . com", "??? AT ????? DOT net", "???? at ?????? dot com", "??# at ???? dot co dot uk", "?? @ ????.de", "???@????.???", "??? (at) ???? [dot] ???? [dot] com",
               "??(at)????(dot)org", "???# [at] ??? (dot) ????")),
}
REFUSED = {
    "phone": (("order {}", "version {}", "id {}", "page {}", "isbn {}", "total {} units", "ref {}", "year {}", "invoice {}", "score {} points", "hash a{}b", "x = {}",
               "${}", "ssn {}", "serial {}", "tracking {}", "section {}", "the {} of", "sum {}", "batch {} - done", "token = \"{}e4c\""),
              ("##########", "########", "###-##-####", "### - ####", "###-#-##-######-#", "20##-0#-1# 1#:3#", "### ### ###", "####-####-##", "##.##.####", "####-####", "## ## ## ##", "19## 20## 20##", "#. #. #. ####")),
    "card": (("order {}", "id {}", "tracking {}", "serial {} ok", "ref {}", "card {} declined", "isbn {}", "hash {}f", "batch {}"),
             ("#### #### #### ###~", "####-####-####-###~", "###############~", "##############", "#############", "#### ###### ####~")),
    "ip": (("version {}", "section {}", "chapter {}", "page {}", "release {}"), ("#.#.#.#", "#.##.#.#", "##.#.#.##", "#. #. #. #")),
    "email": (("{}", "we {}", "then {} more", "all {}"),
              ("meet (at) noon . ??", "???? at ???? . ?????", "look at ?? dot dot", "???? AT ????. ????", "???? @ ????? . ????", "sat at ????? . ???")),
}


def _filled(form: Column, *seed: Column) -> Column:
    """A format with its places filled, as drawn by hash."""
    def place(c: Column, i: Column) -> Column:
        h = F.xxhash64(*seed, i)
        return F.when(c == "#", F.pmod(h, F.lit(10)).cast("string")).when(c == "%", F.pmod(h, F.lit(256)).cast("string")).when(
            c == "?", F.substr(F.lit("abcdefghijklmnopqrstuvwxyz"), F.pmod(h, F.lit(26)).cast("int") + 1, F.lit(1))).otherwise(c)

    def checked(x: Column) -> Column:
        right = (10 - F.coalesce(luhn_sum(digits(F.translate(x, "*~", "00"))), F.lit(0)) % 10) % 10
        wrong = (right + 1 + F.pmod(F.xxhash64(*seed), F.lit(9))) % 10
        return F.replace(F.replace(x, F.lit("*"), right.cast("string")), F.lit("~"), wrong.cast("string"))

    return let(F.array_join(F.transform(F.split(form, ""), place), ""), checked)


def written_examples(spark: SparkSession, copies: int = COPIES) -> DataFrame:
    """Candidates of all contexts with all formats of their kind, ``copies`` of each with other digits: label, f, draw."""
    strings = lambda values: F.array(*map(F.lit, values))
    rows = F.array(*(F.struct(F.lit(KINDS.index(kind)).alias("kind"), F.lit(good).alias("good"), strings(contexts).alias("contexts"), strings(forms).alias("forms"))
                     for good, lists in ((1, EXAMPLES), (0, REFUSED)) for kind, (contexts, forms) in lists.items()))
    df = spark.range(copies).select("id", F.explode(rows).alias("x")).select("id", "x.*").select("id", "kind", "good", F.explode("contexts").alias("context"), "forms")
    df = df.select("id", "kind", "good", "context", F.explode("forms").alias("form"))
    df = df.withColumn("own", _filled(F.col("form"), F.col("id"), F.col("context"), F.col("form")))
    draw = F.xxhash64("id", "context", "form").alias("draw")  # all candidates of one text fall on the same side
    df = df.select("kind", "good", "own", draw, F.explode(candidates(F.replace(F.col("context"), F.lit("{}"), F.col("own")))).alias("c"))
    label = (F.col("good") == 1) & (F.col("c.kind") == F.col("kind")) & (F.col("c.text") == F.col("own"))
    return df.select(label.cast("int").alias("label"), "draw", "c.f")


def corpus_examples(docs: DataFrame, text: str, sample: int = SAMPLE) -> DataFrame:
    """Candidates of the corpus with weak labels: label, f, draw. At most ``sample`` rows, half of either label."""
    whole = F.coalesce(F.col(text), F.lit(""))
    same = lambda o, c: (o["start"] == c["start"]) & (o["end"] == c["end"]) & (o["kind"] == c["kind"])
    # columns of their own, see ``spans``; explode_outer, as explode would make the optimiser search every text twice
    searched = docs.select(base_spans(whole).alias("base"), candidates(whole).alias("proposed"))
    each = searched.select(let(F.col("base"), lambda b: F.transform("proposed", lambda c: F.struct(
        F.exists(b, lambda o: same(o, c)).cast("int").alias("label"), c["f"].alias("f")))).alias("found")).select(F.explode_outer("found").alias("c"))
    rows = each.where("c is not null").select("c.label", F.xxhash64("c.f").alias("draw"), "c.f").distinct()
    least = Window.partitionBy("label").orderBy("draw", "f")
    return rows.withColumn("n", F.row_number().over(least)).where(F.col("n") <= sample // 2).drop("n")


@dataclass
class Trees:
    """Boosted trees as nested (feature, threshold, left, right) tuples with numbers as leaves, and the least margin of a
    chosen candidate."""

    trees: list
    least: float

    def margin(self, f: Column) -> Column:
        def value(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            feature, threshold, left, right = node
            return F.when(F.get(f, F.lit(feature)) <= threshold, value(left)).otherwise(value(right))

        total = F.lit(0.0)
        for weight, root in self.trees:
            total = total + value(root) * weight
        return total


def _tree(lines: list[str]):
    """A tree from its printed form, one node a line: If (feature i <= t), Else (...), Predict: v."""
    line = lines.pop(0).strip()
    if line.startswith("Predict:"):
        return float(line.split(":")[1])
    feature, threshold = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
    left = _tree(lines)
    lines.pop(0)
    return (int(feature), float(threshold), left, _tree(lines))


def fit(docs: DataFrame, text: str = "text", sample: int = SAMPLE, precision: float = PRECISION) -> Trees:
    """Three quarters of the examples grow the trees; on the rest the threshold is the least margin from which on the
    share of positives is at least ``precision``, and not below even odds."""
    rows = corpus_examples(docs, text, sample).unionByName(written_examples(docs.sparkSession))
    held = F.pmod(F.xxhash64("draw", F.lit(7)), F.lit(4)) == 0
    rows = written(rows.select("label", "f", held.alias("held")), "examples")
    classes = rows.where("not held").agg(F.countDistinct("label")).first()[0]
    test = bounded_rows(rows.where("held").select("label", "f"), sample + WRITTEN, "examples")
    if classes < 2 or not test:
        return Trees([], math.inf)
    train = rows.where("not held").select(F.col("label").cast("double").alias("label"), array_to_vector("f").alias("features")).coalesce(1)
    model = GBTClassifier(maxDepth=DEPTH, maxIter=ROUNDS, stepSize=STEP, seed=1, maxBins=64).fit(train)
    trees = []
    for weight, tree in zip(model.treeWeights, model.trees):
        trees.append((float(weight), _tree([x for x in tree.toDebugString.splitlines()[1:] if x.strip()])))
    fitted = Trees(trees, math.inf)

    def margin(f: list[float]) -> float:
        def value(node):
            while isinstance(node, tuple):
                node = node[2] if f[node[0]] <= node[1] else node[3]
            return node

        return sum(w * value(t) for w, t in trees)

    scored = sorted(((margin(r["f"]), r["label"]) for r in test), reverse=True)
    good = 0
    for n, (m, y) in enumerate(scored, 1):
        good += y
        if good >= precision * n and (n == len(scored) or scored[n][0] < m):
            fitted.least = max(m, 0.0)  # and the likelier class
    return fitted


def _of_kind(kind: int) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def spans(docs: DataFrame, model: Trees, text: str = "text") -> DataFrame:
    """Adds n_email, n_ip, n_card, n_phone, base_sha256 (of the base spans) and spans (all)."""
    new = (*(f"n_{k}" for k in KINDS), "base_sha256", "spans")
    whole = F.coalesce(F.col(text), F.lit(""))
    own, masks, good, taken = (spare(docs, f"__{c}") for c in ("base", "masks", "good", "taken"))

    def scored(k: Column, m: Column) -> Column:
        return let(features(k, m), lambda f: F.struct((-model.margin(f)).alias("m"), m["start"].alias("start"), k.alias("kind"), m["end"].alias("end")))

    # Columns of their own, as the analyser goes through nested functions a few levels at a time; each is read by ``let``, outside of any other function.
    df = docs.drop(*(c for c in new if c != text)).withColumn(own, base_spans(whole))
    if model.trees:
        df = df.withColumn(masks, covered(F.col(own)))
        df = df.withColumn(good, let(F.col(masks), lambda w: candidates(whole, scored, lambda c: (c["m"] <= -model.least) & ~is_covered(w, c))))
        df = df.withColumn(taken, let(F.col(good), lambda ranked: F.transform(without_overlaps(ranked, F.char_length(whole)), lambda c: F.struct(
            c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))))
    else:
        df = df.withColumn(taken, F.array().cast(f"array<{SPAN}>"))

    names = F.array(*map(F.lit, KINDS))
    shown = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = (F.size(F.filter(own, _of_kind(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS))
    return df.select(*(c for c in docs.columns if c not in new or c == text), *counts, F.sha2(shown(F.col(own)), 256).alias("base_sha256"),
                     shown(F.sort_array(F.concat(own, taken))).alias("spans"))
