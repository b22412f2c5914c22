"""Personal data: high-recall patterns propose overlapping spans, boosted trees over format and context select among them.

All of it runs as built-in functions over each row's text. Spans that follow the strict rules below are always kept; the
trees decide on what only the wide patterns find. There are no labels for this, so the trees learn from made-up spans
planted in the corpus's own prose, next to look-alikes; formats that they never saw set the thresholds.
"""

from __future__ import annotations

import random
from functools import reduce
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import as_sql, boost, calibrated, predict
from .common import free_name, held_out, let, table

#: In the order that breaks ties between spans of an equal start.
KINDS = ("email", "ip", "card", "phone", "secret")
SPAN = "struct<start:bigint,end:bigint,text:string,before:string,after:string>"
CONTEXT = 24
#: Precision on formats that the trees didn't see, which a kind's threshold must reach.
PRECISION = 0.97
#: Values in a block of a running sum, and characters in a block of a text that is cut.
BLOCK, PIECE = 128, 4096
#: Beyond every text.
FAR = 1 << 62
#: Texts, at most about, whose prose carries the examples; examples of a format.
CARRIERS, EACH = 300, 24
#: Trees of a kind.
ROUNDS = 16

#: kind: (a cheap test of the text, the strict pattern). Repeats are possessive and begin at the beginning of a run where
#: that leaves the leftmost match as it is, so that long runs cost time in proportion.
STRICT = {
    "email": ("@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    "card": (r"[0-9](?:[ -]?[0-9]){13}", r"[0-9](?:[ -]?[0-9])++"),
    "phone": (r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]"),
}

#: kind: (a cheap test of the text, the wide pattern).
WIDE = {
    "email": (r"(?i)[\[(]at[\])]|\bdot\b", r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?: ?[\[(]at[\])] ?| at )[A-Za-z0-9-]{1,63}(?:(?: ?[\[(]dot[\])] ?| dot |\.)[A-Za-z0-9-]{2,24}){1,4}"),
    "ip": (r":[0-9A-Fa-f]{0,4}:", r"(?<![0-9A-Za-z:.])(?=:{0,2}[0-9A-Fa-f])(?=[0-9A-Fa-f]*+:[0-9A-Fa-f]*+:)(?:[0-9A-Fa-f]++|::?(?=[0-9A-Fa-f])|::)++(?![0-9A-Za-z]|:[0-9A-Za-z:])"),
    "card": (r"[0-9]{3}[ ._/-]", r"(?<![0-9])[0-9]{3,6}(?:[ ._/-]{1,2}[0-9]{2,6}){2,5}(?![0-9])"),
    "phone": (r"[0-9](?:[ ()./-]{0,3}[0-9]){6}", r"(?<![0-9A-Za-z+.])\(?[0-9](?:[ ()./-]{0,3}[0-9]){6,14}(?![0-9A-Za-z])"),
    "secret": (r"(?i)token|secret|passw|key|bearer", r"(?i)\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key|private[_-]?key|bearer)[\"']?[ \t]{0,3}[:= ][ \t]{0,3}[\"']?[A-Za-z0-9+/_=.-]{8,}+"),
}

#: Words before a span that speak for its kind, and against any.
CLUES = {
    "email": r"(?i)mail|contact|write|reach|address",
    "ip": r"(?i)\bip|host|server|addr|ping|from",
    "card": r"(?i)card|visa|master|amex|credit|debit|pay|konto|tarjeta|carte",
    "phone": r"(?i)phone|tel|call|mobil|fax|cell|whatsapp|sms",
    "secret": r"(?i)auth|login|export|config|set|use",
}
AGAINST = r"(?i)version|order|invoice|isbn|serial|release|page|date|on |born|chapter|section|model|part|build"
#: name: SQL over a candidate ``s`` (text, before, after, kind), ``d`` its digits and ``g`` its alphanumeric groups.
FEATURES = {
    "length": "length(s.text)",
    "digits": "length(s.d)",
    "letters": "length(regexp_replace(s.text, '[^A-Za-z]', ''))",
    "separators": "length(regexp_replace(s.text, '[0-9A-Za-z]', ''))",
    "groups": "size(s.g)",
    "longest_group": "coalesce(array_max(transform(s.g, x -> length(x))), 0)",
    "shortest_group": "coalesce(array_min(transform(s.g, x -> length(x))), 0)",
    "last_group": "coalesce(length(element_at(s.g, -1)), 0)",
    "tail_digit": "if(s.text rlike '[0-9]$', 1, 0)",
    "shifts": "size(split(s.text, '(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[a-z])(?=[A-Z])'))",
    "vowels": "length(regexp_replace(s.text, '[^aeiouAEIOU]', ''))",
    "distinct": "size(array_distinct(split(s.text, '')))",
    "colons": "length(regexp_replace(s.text, '[^:]', ''))",
    "assigned": "if(s.text rlike '^[^=:]*[=:]', 1, 0)",
    "brackets": "length(regexp_replace(s.text, '[^()\\\\[\\\\]]', ''))",
    "doubled": "if(s.text rlike '([^0-9A-Za-z])\\\\1', 1, 0)",
    "zero_first": "if(s.text rlike '^[(]?0', 1, 0)",
    "year_first": "if(s.text rlike '^(?:19|20)[0-9]{2}(?![0-9])', 1, 0)",
    "domain": r"if(s.text rlike '(?i)(?:[.]|dot[)\\\\]]? ?)(?:com|org|net|edu|gov|info|io|co|eu|de|fr|es|it|uk|ch|nl)$', 1, 0)",
    "article": "if(s.text rlike '(?i) at (?:the|an?|this|that|every|each|its?|his|her|my) ', 1, 0)",
    "luhn": "if(s.luhn, 1, 0)",
    "word_before": "if(s.before rlike '[\\\\p{L}0-9_]$', 1, 0)",
    "word_after": "if(s.after rlike '^[\\\\p{L}0-9_]', 1, 0)",
    "clue": "if(s.clue, 1, 0)",
    "against": "if(s.before rlike '" + AGAINST + "', 1, 0)",
}


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid check digit."""

    def total(d: Column) -> Column:
        def add(acc: Column, i: Column) -> Column:
            x = F.substring(d, i, F.lit(1)).cast("int")
            twice = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
            return acc + F.when(i % 2 == 0, twice).otherwise(x)

        return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add)

    return F.when(F.length(digits) > 0, let(F.reverse(digits), total) % 10 == 0).otherwise(F.lit(False))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _of(test, kind: str):
    """test(kind, span) as a function of the span alone."""
    return lambda s: test(kind, s)


def strict(kind: str, s: Column) -> Column:
    """Whether a match of the strict pattern is a span."""
    text = s["text"]
    n = F.length(_digits(text))
    if kind == "ip":
        small = lambda p: let(F.ltrim(p, F.lit("0")), lambda z: (F.length(z) < 3) | ((F.length(z) == 3) & (z <= "255")))
        return F.forall(F.split(text, r"\."), small)
    if kind == "card":
        return F.when((n >= 14) & (n <= 19), luhn(_digits(text))).otherwise(F.lit(False))
    if kind == "phone":
        return (n >= 10) & (n <= 15)
    return F.lit(True)


def running(values: Column, op, zero: int) -> Column:
    """The values combined up to each place, as array_agg over a window would give them. Blocks keep the work in proportion to the length."""
    none = F.array().cast("array<bigint>")
    start = F.struct(F.lit(zero).cast("bigint").alias("v"), none.alias("out"))

    def of(v: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            now = op(acc["v"], x)
            return F.struct(now.alias("v"), F.concat(acc["out"], F.array(now)).alias("out"))

        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: F.aggregate(F.slice(v, b * BLOCK + 1, F.lit(BLOCK)), start, step, lambda acc: acc["out"]))

        def chained(own: Column) -> Column:
            before = F.aggregate(own, start, lambda acc, b: F.struct(op(acc["v"], F.element_at(b, -1)).alias("v"), F.concat(acc["out"], F.array(acc["v"])).alias("out")), lambda acc: acc["out"])
            return F.flatten(F.zip_with(own, before, lambda b, o: F.transform(b, lambda x: op(o, x))))

        return F.when(F.size(v) > 0, let(blocks, chained)).otherwise(none)

    return let(values, of)


def matches(text: Column, test: str, pattern: str) -> Column:
    """Leftmost matches with their code-point places and what stands around them. Places add up the pieces between matches, so no text is searched again for a match."""
    none = F.array().cast(f"array<{SPAN}>")

    def places(x: Column) -> Column:
        ends = running(F.zip_with(x["m"], F.slice(x["p"], F.lit(1), F.size(x["m"])), lambda m, p: (F.length(m) + F.length(p)).cast("bigint")), lambda a, b: a + b, 0)

        def span(at: Column) -> Column:
            return F.transform(x["m"], lambda m, i: F.struct((F.get(at, i) - F.length(m)).alias("start"), F.get(at, i).alias("end"), m.alias("text"), F.right(F.get(x["p"], i), F.lit(CONTEXT)).alias("before"), F.left(F.get(x["p"], i + 1), F.lit(CONTEXT)).alias("after")))

        return F.when(F.size(x["m"]) > 0, let(ends, span)).otherwise(none)

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p"))
    return F.when(text.rlike(test), let(both, places)).otherwise(none)


def _possible(kind: str, s: Column) -> Column:
    n = F.length(_digits(s["text"]))
    if kind == "card":
        return (n >= 13) & (n <= 19)
    if kind == "phone":
        return (n >= 7) & (n <= 15)
    return F.lit(True)


def candidates(text: Column) -> dict[str, Column]:
    """What the wide patterns find, by kind; spans may overlap each other and strict ones."""
    return {k: F.filter(matches(text, *WIDE[k]), _of(_possible, k)) for k in WIDE}


def _described(text: Column) -> Column:
    """All candidates of a text with their kind's number and what the features are computed from."""

    def more(kind: str, s: Column) -> Column:
        d = _digits(s["text"])
        return F.struct(
            s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("k"), s["end"].alias("end"), s["text"].alias("text"), s["before"].alias("before"), s["after"].alias("after"), d.alias("d"),
            F.filter(F.split(s["text"], "[^0-9A-Za-z]+"), lambda g: g != "").alias("g"), F.when(F.length(d).between(8, 19), luhn(d)).otherwise(F.lit(False)).alias("luhn"), F.concat(s["before"], F.when(F.lit(kind == "secret"), s["text"]).otherwise(F.lit(""))).rlike(CLUES[kind]).alias("clue"),
        )

    return reduce(F.concat, [F.transform(found, _of(more, k)) for k, found in candidates(text).items()])


class Example(NamedTuple):
    """A text with one span from start to end; ``format`` numbers the formats of a kind and class."""

    kind: str
    personal: bool
    format: int
    text: str
    start: int
    end: int


def formats(r: random.Random) -> dict[tuple[str, bool], list]:
    """Makers of spans by kind and class: formats in use, and look-alikes that the wide patterns propose too."""
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    hexa = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    mixed = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("bcdfghlmnprstv") + r.choice("aeiou") for _ in range(r.randint(2, 4))) + r.choice(["", "n", "s", "r"])
    some = lambda *x: r.choice(x)
    h = lambda: f"{r.randint(1, 0xFFFF):x}"
    four = lambda x, sep: sep.join(x[i : i + 4] for i in range(0, len(x), 4))

    def carded(n: int = 16) -> str:
        body = r.choice("3456") + d(n - 2)
        return body + next(c for c in "0123456789" if sum(int(x) if i % 2 == 0 else (2 * int(x) - 9 if int(x) > 4 else 2 * int(x)) for i, x in enumerate(reversed(body + c))) % 10 == 0)

    def uncarded(n: int = 16) -> str:
        good = carded(n)
        return good[:-1] + str((int(good[-1]) + r.randint(1, 9)) % 10)

    tld = lambda: some("com", "org", "net", "de", "fr", "io", "co")
    return {
        ("email", True): [
            lambda: f"{word()}.{word()} [at] {word()}.{tld()}", lambda: f"{word()}(at){word()}(dot){tld()}", lambda: f"{word()} at {word()} dot {tld()}", lambda: f"{word()}{d(2)} [at] {word()} [dot] {tld()}", lambda: f"{word()}_{word()} (at) {word()}-{word()}.{tld()}",
            lambda: f"{word()} AT {word()} DOT {tld()}", lambda: f"{word()}[at]{word()}.{word()}.{tld()}", lambda: f"{word()}.{word()} at {word()} dot {word()} dot {tld()}", lambda: f"{word()[0]}{word()} [at] {word()} dot {tld()}", lambda: f"{word()}+{word()}(at){word()}.{tld()}",
            lambda: f"{word()} at {word()} dot {word()} dot {tld()}", lambda: f"{word()}.{word()}(at){word()}-{word()} dot {tld()}", lambda: f"{word()}{d(3)} at {word()}.{tld()}", lambda: f"{word()}-{word()} [at] {word()} [dot] {word()} [dot] {tld()}", lambda: f"{word()}.{d(2)}[at]{word()}{d(1)}.{tld()}",
        ],
        ("email", False): [
            lambda: f"{word()} at {word()}.{word().title()}", lambda: f"{word()}ed at the dot {word()}", lambda: f"{word()} at the dot {tld()} {word()}", lambda: f"{word()} at a dot {word()}", lambda: f"stop at this dot {word()}", lambda: f"{word()} at every dot {word()}",
            lambda: f"{word()} [at] {d(2)}.{d(2)}", lambda: f"price at {d(2)}.{d(2)} dot {word()}", lambda: f"meet at {d(1)}.{d(2)}", lambda: f"look at {word()} dot {word()} dot {word()}",
            lambda: f"{word()} at {word()} dot {word()}", lambda: f"{word()} at {word()} dot {word()} dot {word()}", lambda: f"{word()} [at] {word()}.{word()}", lambda: f"{word()}s at {word()}.{d(3)}", lambda: f"{word()} (at) {word()} dot {word()}",
            lambda: f"{word()} at {word()} dot {d(2)}", lambda: f"{word()} (at) {d(1)}.{d(3)}", lambda: f"{word()} at {word()}.{word()}.{word()}", lambda: f"{word()} at {d(2)} dot {d(2)}", lambda: f"{word()} at his dot {word()}",
            lambda: f"{word()} at this dot {tld()}", lambda: f"{word()} at every dot {tld()}", lambda: f"{word()} [at] {word()} dot {d(3)}", lambda: f"{word()} at a dot {tld()}", lambda: f"{word()}.{word()} at {word()} dot {d(1)}",
        ],
        ("ip", True): [
            lambda: ":".join(hexa(4) for _ in range(8)), lambda: f"2001:db8:{h()}:{h()}::{h()}", lambda: f"fe80:{h()}:{h()}:{h()}:{h()}:{h()}:{h()}:1", lambda: f"fe80::{d(1)}", lambda: f"::{d(1)}", lambda: f"fe80::{hexa(3)}:{hexa(4)}:{hexa(4)}:{hexa(4)}",
            lambda: f"2001:db8:{hexa(4)}::{hexa(4)}:{hexa(3)}:{d(4)}", lambda: f"2a{d(2)}:{h()}::{h()}:{h()}", lambda: ":".join(h() for _ in range(8)), lambda: f"2001:{h()}::{h()}",
            lambda: f"fe80::{h()}:{h()}", lambda: f"2{d(3)}:{hexa(4)}:{hexa(4)}:{hexa(4)}:{hexa(4)}:{hexa(4)}:{hexa(4)}:{hexa(4)}", lambda: f"fd{hexa(2)}:{hexa(4)}:{hexa(4)}::{d(1)}", lambda: f"2a{d(2)}:{hexa(4)}::{d(2)}", lambda: f"2001:{hexa(3)}:{h()}::{h()}:{h()}:{h()}",
        ],
        ("ip", False): [
            lambda: f"{r.randint(10, 23)}:{d(2)}:{d(2)}", lambda: ":".join(hexa(2) for _ in range(6)), lambda: f"{d(1)}:{d(1)}:{d(1)}", lambda: f"{some('add', 'bad', 'face', 'dead')}::{some('cab', 'be', 'fade', 'ace')}", lambda: f"::{some('add', 'bad', 'fade', 'be')}",
            lambda: f"0{d(1)}:{d(2)}:{d(2)}", lambda: ":".join(hexa(2).upper() for _ in range(6)), lambda: f"{d(2)}:{d(2)}:{d(2)}:{d(2)}", lambda: f"{d(3)}:{d(2)}:{d(1)}", lambda: f"{some('a', 'b', 'c')}::{some('d', 'e', 'f')}",
            lambda: ":".join(hexa(2).upper() for _ in range(8)), lambda: f"{d(2)}:{d(2)}:{d(2)}:{d(3)}", lambda: ":".join(hexa(2) for _ in range(8)), lambda: ":".join(hexa(2) for _ in range(5)), lambda: f"{some('dad', 'bed')}::{some('fed', 'ad')}::{some('ace', 'be')}",
            lambda: f"1{d(1)}:{d(1)}{d(1)}:{d(1)}{d(1)}", lambda: ":".join(d(2) for _ in range(6)), lambda: f"{d(1)}:{d(2)}:{d(3)}:{d(2)}", lambda: ":".join(hexa(2).upper() for _ in range(16)), lambda: ":".join(hexa(2) for _ in range(20)),
        ],
        ("card", True): [
            lambda: four(carded(), "."), lambda: four(carded(), "_"), lambda: four(carded(), "  "), lambda: four(carded(), "/"), lambda: four(carded(), " -"), lambda: (lambda c: f"{c[:4]}.{c[4:10]}.{c[10:]}")(carded(15)), lambda: four(carded(), ". "), lambda: (lambda c: f"{c[:4]}/{c[4:10]}/{c[10:]}")(carded(15)),
            lambda: (lambda c: f"{c[:4]}_{c[4:10]}_{c[10:]}")(carded(14)), lambda: four(carded(), "--"),
            lambda: (lambda c: f"{c[:4]}.{c[4:10]}.{c[10:]}")(carded(14)), lambda: (lambda c: f"{c[:4]}_{c[4:10]}_{c[10:]}")(carded(15)), lambda: (lambda c: f"{c[:4]}/{c[4:10]}/{c[10:]}")(carded(14)), lambda: four(carded(), "-."), lambda: (lambda c: f"{c[:4]}  {c[4:10]}  {c[10:]}")(carded(15)),
        ],
        ("card", False): [
            lambda: four(uncarded(), "-"), lambda: f"{d(4)}-{d(2)}-{d(2)} {d(2)}.{d(3)}", lambda: f"{d(3)}-{d(2)}-{d(6)}-{d(2)}", lambda: ".".join(d(3) for _ in range(5)), lambda: four(uncarded(), "."), lambda: four(uncarded(), "/"), lambda: f"{d(4)}/{d(4)}/{d(6)}", lambda: four(uncarded(), "_"),
            lambda: " ".join(d(3) for _ in range(5)), lambda: f"20{d(2)}/{d(4)}/{d(5)}/{d(3)}",
            lambda: (lambda c: f"{c[:4]}.{c[4:10]}.{c[10:]}")(uncarded(15)), lambda: four(uncarded(), " -"), lambda: (lambda c: f"{c[:4]}/{c[4:10]}/{c[10:]}")(uncarded(14)), lambda: "-".join(d(3) for _ in range(5)), lambda: f"{d(5)}.{d(5)}.{d(4)}",
        ],
        ("phone", True): [
            lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"0{d(2)}/{d(4)} {d(3)}", lambda: f"0049 {d(3)} {d(4)} {d(3)}", lambda: f"{r.randint(2, 9)}{d(2)}-{d(3)}-{d(4)}", lambda: f"0{r.randint(1, 9)}{d(2)} {d(7)}", lambda: f"0{r.randint(1, 9)}{d(1)} {d(8)}", lambda: f"0{r.randint(1, 9)}{d(9)}", lambda: f"(0{d(2)}) {d(7)}",
            lambda: f"0{r.randint(1, 9)} {d(2)} {d(2)} {d(2)} {d(2)}", lambda: f"0{r.randint(1, 9)}.{d(2)}.{d(2)}.{d(2)}.{d(2)}", lambda: f"00{d(2)}-{d(3)}-{d(7)}", lambda: f"0{d(3)}-{d(6)}", lambda: f"{r.randint(2, 9)}{d(2)} {d(3)} {d(4)}", lambda: f"({d(3)}) {d(3)} {d(4)}",
            lambda: f"0{d(4)} {d(6)}", lambda: f"0{r.randint(1, 9)}{d(8)}", lambda: f"0{r.randint(1, 9)}{d(10)}", lambda: f"0{d(2)}-{d(7)}", lambda: f"0{d(3)}/{d(7)}", lambda: f"00{d(2)}{d(9)}", lambda: f"(0{d(3)}) {d(3)}-{d(3)}",
        ],
        ("phone", False): [
            lambda: f"20{d(2)}-0{r.randint(1, 9)}-{r.randint(10, 28)}", lambda: f"{r.randint(10, 28)}.{r.randint(10, 12)}.20{d(2)}", lambda: f"{r.randint(10, 28)}.0{r.randint(1, 9)}.19{d(2)} {d(2)}", lambda: f"{r.randint(1, 9)}{d(1)} {d(3)} {d(3)}", lambda: f"{d(4)}/{d(4)}", lambda: f"{d(3)}.{d(2)}.{d(3)}",
            lambda: f"20{d(2)}-0{r.randint(1, 9)}-{r.randint(10, 28)} {d(2)}", lambda: f"{r.randint(1, 9)}{d(r.randint(6, 14))}", lambda: f"978-{r.randint(1, 9)}-{d(4)}-{d(4)}-{d(1)}", lambda: f"{r.randint(1, 9)}{d(2)} {d(3)} {d(3)}", lambda: f"{r.randint(1, 28)}/{r.randint(1, 12)}/20{d(2)}", lambda: f"19{d(2)}-20{d(2)}",
            lambda: f"{r.randint(1, 9)}.{d(3)}.{d(3)}", lambda: f"{r.randint(1, 9)}{d(5)}-{d(4)}", lambda: f"{d(2)} {d(2)} {d(2)} {d(2)} {d(2)}", lambda: four(f"{r.randint(1, 9)}{d(11)}", " "),
            lambda: f"{r.randint(1, 9)}{d(4)}-{d(5)}", lambda: f"{d(4)} {d(4)}", lambda: f"{r.randint(1, 9)}{d(3)}-{d(4)}", lambda: " ".join(f"{r.randint(1, 9)}{d(2)}" for _ in range(4)), lambda: f"{r.randint(1, 9)}{d(4)} {d(5)}", lambda: f"{r.randint(1, 9)}{d(3)} {d(4)} {d(3)}", lambda: f"{r.randint(1, 9)}{d(6)}-{d(3)}",
        ],
        ("secret", True): [
            lambda: f"api_key: {hexa(32)}", lambda: f"api-key={mixed(24)}", lambda: f'password="{word()}{d(4)}{word().upper()}"', lambda: f"Bearer {mixed(36)}.{mixed(r.randint(60, 400))}.{mixed(43)}", lambda: f"secret: {mixed(40)}", lambda: f"access_key = AKIA{mixed(16).upper()}", lambda: f"passwd {word().title()}{d(3)}{mixed(4)}",
            lambda: f"token: ghp_{mixed(36)}", lambda: f"private_key='{mixed(20)}/{mixed(19)}+'", lambda: f"secret=sk-{hexa(24)}", lambda: f"token {d(2)}{hexa(22)}", lambda: f"password: {word()}-{d(3)}-{word()}{d(2)}",
        ],
        ("secret", False): [
            lambda: f"token {word()}{word()}", lambda: f"secret {word()}{word()}", lambda: f"password {word()}{word()}", lambda: f"bearer {word()}{word()}", lambda: f"token: {word()}{word()}", lambda: f"password={some('required', 'forgotten', 'not-needed', 'whatever.', 'protected', 'optional')}", lambda: f"secret {word()}-{word()}{word()}",
            lambda: f"token {word()}{word()}.{word().title()}", lambda: f"password: {word().title()}{word()}", lambda: f"bearer {word()}{word()}-{word()}", lambda: f"secret = {word()}{word()}{word()}", lambda: f"token {word().title()}{word()}",
        ],
    }


def examples(carriers: list[str], seed: int = 7, each: int = EACH) -> list[Example]:
    """Each format ``each`` times, planted between words of the carriers' prose, most of the time without a word that tells."""
    r = random.Random(seed)
    prose = [w for w in (" ".join(x for x in t.split() if not any(c.isdigit() or c in "@:=" for c in x)).split() for t in carriers) if len(w) > 12] or [["and", "the", "of", "it", "was"] * 4]
    clues = {"email": ["mail", "contact", "write to"], "ip": ["ip", "host", "from server"], "card": ["card", "visa", "pay with"], "phone": ["phone", "tel.", "call"], "secret": ["auth", "use", "set"]}
    against = ["version", "order", "invoice", "serial", "released on", "part", "build"]
    out = []
    for (kind, personal), made in formats(r).items():
        for k, make in enumerate(made):
            for _ in range(each):
                words = r.choice(prose)
                at = r.randrange(2, len(words) - 4)
                hint = r.choice(clues[kind]) + " " if r.random() < (0.4 if personal else 0.15) else r.choice(against) + " " if r.random() < (0.05 if personal else 0.4) else ""
                before, span = " ".join(words[max(0, at - 6) : at]) + " " + hint, make()
                out.append(Example(kind, personal, k, f"{before}{span} {' '.join(words[at : at + 6])}", len(before), len(before) + len(span)))
    return out


def described(spark: SparkSession, made: list[Example]) -> list[tuple[Example, bool, list[float], int, int]]:
    """(example, whether personal, features, start, end) of each candidate of the example's kind that touches its span."""
    rows = spark.createDataFrame([(n, KINDS.index(e.kind), e.text, e.start, e.end) for n, e in enumerate(made)], "n int, kind int, text string, a int, b int")
    found = rows.select("n", "kind", "a", "b", F.explode(_described(F.col("text"))).alias("s")).filter("s.k = kind and s.start < b and s.end > a")
    got = found.select("n", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.expr(f"array({', '.join(f'cast({x} as double)' for x in FEATURES.values())})").alias("f")).orderBy("n", "start").collect()
    return [(made[r["n"]], made[r["n"]].personal, r["f"], r["start"], r["end"]) for r in got]


#: Formats are left out in turn, in so many groups by their number.
FOLDS = 5


class Model(NamedTuple):
    """kind: (trees, threshold of their sum), and how thresholds did on formats that neither they nor the trees had seen: (precision, recall, candidates)."""

    kinds: dict[str, tuple[list, float]]
    unseen: dict[str, tuple[float, float, int]]


def fit(spark: SparkSession, carriers: list[str]) -> Model:
    """Boosted trees for each kind over examples in the carriers' prose.

    The threshold comes from all formats: each is judged by trees that learned from the other groups of formats alone.
    What is reported as unseen goes one step further: the threshold, too, is set without the group that is judged.
    """
    rows = described(spark, examples(carriers))
    kinds, unseen = {}, {}
    for kind in KINDS:
        own = [(e.format % FOLDS, y, f) for e, y, f, _, _ in rows if e.kind == kind]
        fold, y, x = np.array([k for k, _, _ in own]), np.array([y for _, y, _ in own], float), np.array([f for _, _, f in own])
        p, kept = np.zeros(len(y)), np.zeros(len(y), bool)
        for k in range(FOLDS):
            learn, judge = fold != k, fold == k
            if not 0 < y[learn].sum() < learn.sum():
                raise ValueError(f"{kind}: the examples lack candidates of one class")
            p[judge] = predict(boost(x[learn], y[learn], rounds=ROUNDS), x[judge])
        for k in range(FOLDS):
            kept[fold == k] = p[fold == k] >= calibrated(p[fold != k], y[fold != k], PRECISION)
        right = y == 1
        unseen[kind] = (float(right[kept].mean()) if kept.any() else 0.0, float(kept[right].mean()) if right.any() else 0.0, len(right))
        least = calibrated(p, y, PRECISION)
        trees = boost(x, y, rounds=ROUNDS)
        kinds[kind] = (trees, float(np.log(least / (1 - least))) if 0 < least < 1 else np.inf if least >= 1 else -np.inf)
    return Model(kinds, unseen)


def carriers(df: DataFrame, text: str = "text", id: str = "doc_id") -> list[str]:
    """About ``CARRIERS`` texts of df, drawn by a hash of id and text, the first thousand words of each."""
    n, spread = df.count(), 1 << 30
    drawn = df.filter(F.pmod(F.xxhash64(id, text), F.lit(spread)) < min(spread, int(spread * CARRIERS / max(1, n)) + 1)).filter(F.col(text).isNotNull())
    return sorted(r[0] for r in drawn.select(F.array_join(F.slice(F.split(text, r"\s+"), 1, 1000), " ")).distinct().toLocalIterator())


_DEFAULT: list[Model] = []


def default_model(spark: SparkSession) -> Model:
    """A model over plain carrier words, fitted once a process."""
    if not _DEFAULT:
        _DEFAULT.append(fit(spark, []))
    return _DEFAULT[0]


def _named(kind: str, found: Column) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("k"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def _selected(model: Model, found: str) -> Column:
    """The candidates of a column whose trees' sum reaches their kind's threshold, as spans."""
    case = " ".join(f"when {k} then {_sql(model.kinds[kind][0])} >= {_number(model.kinds[kind][1])}" for k, kind in enumerate(KINDS))
    features = ", ".join(f"cast({x} as double) as {n}" for n, x in FEATURES.items())
    names = ", ".join(f"'{k}'" for k in KINDS)
    scored = f"transform(`{found}`, s -> named_struct('start', s.start, 'k', s.k, 'end', s.end, 'f', struct({features})))"
    return F.expr(f"transform(filter({scored}, x -> case x.k {case} end), x -> named_struct('start', x.start, 'k', x.k, 'end', x.end, 'kind', element_at(array({names}), x.k + 1)))")


def _sql(trees: list) -> str:
    return as_sql(trees, [f"x.f.{n}" for n in FEATURES])


def _number(x: float) -> str:
    return f"{x!r}D" if np.isfinite(x) else f"double('{'-' if x < 0 else ''}infinity')"


def _apart(base: Column, wide: Column) -> Column:
    """The wide spans that no base span overlaps: in order of their starts, none begun before ends later, and none begins before their end."""
    tagged = F.sort_array(F.concat(F.transform(base, lambda s: F.struct(s["start"].alias("start"), F.lit(0).alias("w"), s.alias("s"))), F.transform(wide, lambda s: F.struct(s["start"].alias("start"), F.lit(1).alias("w"), s.alias("s")))))

    def free(x: Column) -> Column:
        ended = running(F.transform(x, lambda t: F.when(t["w"] == 0, t["s"]["end"]).otherwise(F.lit(-1))), lambda a, b: F.greatest(a, b), -1)
        begun = F.reverse(running(F.reverse(F.transform(x, lambda t: F.when(t["w"] == 0, t["start"]).otherwise(F.lit(FAR)))), lambda a, b: F.least(a, b), FAR))

        def kept(y: Column) -> Column:
            good = F.filter(x, lambda t, i: (t["w"] == 1) & (F.get(y["ended"], i) <= t["start"]) & (F.get(y["begun"], i) >= t["s"]["end"]))
            return F.transform(good, lambda t: t["s"])

        return let(F.struct(ended.alias("ended"), begun.alias("begun")), kept)

    return F.when((F.size(base) == 0) | (F.size(wide) == 0), wide).otherwise(let(tagged, free))


def find_pii(df: DataFrame, text: str = "text", into: str = "pii", model: Model | None = None) -> DataFrame:
    """df with a struct ``into`` of two span arrays, base and added, each (start, k, end, kind) in order of start and kind.

    ``base`` are the spans of the strict rules; ``added`` those that the trees select and no base span overlaps. Places
    are code points, ends exclusive. Projections of built-in functions, no shuffle. Null and empty texts have no spans;
    repeated rows are judged alike; an empty table stays empty; other columns pass through, one named ``into`` is
    replaced.
    """
    model = model or default_model(df.sparkSession)
    t = F.coalesce(F.col(text), F.lit(""))
    base = F.sort_array(reduce(F.concat, [_named(k, F.filter(matches(t, *STRICT[k]), _of(strict, k))) for k in STRICT]))
    b, w = (free_name(df, x) for x in ("_base", "_wide"))
    found = df.withColumns({b: base, w: _described(t)})
    found = found.withColumn(w, F.sort_array(_selected(model, w)))
    return found.withColumn(into, F.struct(F.col(b).alias("base"), _apart(F.col(b), F.col(w)).alias("added"))).drop(b, w)


def _merged(spans: Column) -> Column:
    """Overlapping spans as one, of the first's kind: (start, end, kind)."""

    def of(x: Column) -> Column:
        ended = running(F.transform(x, lambda s: s["end"]), lambda a, b: F.greatest(a, b), -1)

        def firsts(e: Column) -> Column:
            heads = F.filter(F.transform(x, lambda s, i: F.struct(i.alias("i"), s["start"].alias("start"), s["kind"].alias("kind"))), lambda s: (s["i"] == 0) | (F.get(e, s["i"] - 1) <= s["start"]))
            return let(heads, lambda h: F.transform(h, lambda s, j: F.struct(s["start"].alias("start"), F.get(e, F.coalesce(F.get(h, j + 1)["i"], F.size(x)) - 1).alias("end"), s["kind"].alias("kind"))))

        return let(ended, firsts)

    return let(spans, of)


def redact(df: DataFrame, text: str = "text", model: Model | None = None) -> DataFrame:
    """df with every span, base and added, replaced by its kind in brackets; overlapping spans become one of the first's kind.

    Null texts stay null, repeated rows are written alike, an empty table stays empty; all other columns stay.
    """

    def written(spans: Column, blocks: Column) -> Column:
        def between(a: Column, e: Column) -> Column:
            def piece(i: Column) -> Column:
                low = F.greatest(a - i * PIECE, F.lit(0))
                return F.substring(F.get(blocks, i.cast("int")), (low + 1).cast("int"), (F.least(e - i * PIECE, F.lit(PIECE)) - low).cast("int"))

            return F.when(e > a, F.array_join(F.transform(F.sequence(F.floor(a / PIECE), F.floor((e - 1) / PIECE)), piece), "")).otherwise(F.lit(""))

        end = F.length(F.col(text)).cast("bigint")
        parts = F.transform(spans, lambda s, i: F.concat(between(F.coalesce(F.get(spans, i - 1)["end"], F.lit(0).cast("bigint")), s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]")))
        return F.concat(F.array_join(parts, ""), between(F.element_at(spans, -1)["end"], end))

    into = free_name(df, "_pii")
    found = find_pii(df, text, into, model)
    spans = F.sort_array(F.concat(f"{into}.base", f"{into}.added"))
    blocks = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    new = F.when(F.size(spans) > 0, let(F.struct(_merged(spans).alias("s"), blocks.alias("b")), lambda x: written(x["s"], x["b"]))).otherwise(F.col(text))
    return found.withColumn(text, new).drop(into)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def fitted(docs: DataFrame) -> Model:
    """A model whose carriers are drawn from the documents that aren't held out."""
    return fit(docs.sparkSession, carriers(docs.filter(~held_out())))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_pii(docs, model=fitted(docs))
    base = F.col("pii.base")
    counts = [F.size(F.filter(base, _of(lambda kind, s: s["kind"] == kind, k))).cast("long").alias(f"n_{k}") for k in STRICT]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.sort_array(F.concat(base, "pii.added"))).alias("spans"))
