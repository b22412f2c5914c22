"""Quality rules: a threshold table compiled into one projection of built-in functions."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table

#: Words are runs of anything but ASCII white space.
BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Frequent function words of the supported languages.
STOP_WORDS = (
    "the of and to in is that it for with as be on by at this an from are was or "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als "
    "de la le et les des en un du une que est pour qui dans par sur au pas avec "
    "el que y a los se del las por con no para al lo como más su"
).split()


class Rule(NamedTuple):
    """A document fails where metric is below low or above high; a null metric passes."""

    name: str
    metric: str
    low: float | None
    high: float | None


#: The production thresholds. Ratios are to words, lines or characters as their names say.
RULES: tuple[Rule, ...] = (
    Rule("length", "n_words", 10, None),
    Rule("word_length", "mean_word_chars", 2.0, 14.0),
    Rule("symbols", "symbol_ratio", None, 0.10),
    Rule("stop_words", "stop_ratio", 0.02, None),
    Rule("duplicate_lines", "dup_line_ratio", None, 0.30),
    Rule("repeats", "repeat_ratio", None, 0.20),
    Rule("capitals", "capital_ratio", None, 0.40),
)


def _repeat_words(words: Column) -> Column:
    """Words covered by a five-word window that occurs twice or more. Windows are sorted by hash, then text, so equal ones are neighbours."""

    def covered(w: Column) -> Column:
        windows = F.when(
            F.size(w) > WINDOW,
            F.transform(
                F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)),
                lambda i: let(F.concat_ws(" ", F.slice(w, i, WINDOW)), lambda s: F.struct(F.xxhash64(s).alias("h"), s.alias("s"), i.alias("i"))),
            ),
        )

        def count(s: Column) -> Column:
            same = lambda x, j: F.coalesce((F.get(s, j)["h"] == x["h"]) & (F.get(s, j)["s"] == x["s"]), F.lit(False))
            at = F.sort_array(F.transform(F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))
            return F.aggregate(
                at,
                F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
                lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n")),
                lambda acc: acc["n"],
            )

        return F.coalesce(let(F.sort_array(windows), count), F.lit(0))

    return let(words, covered)


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """df with one struct column ``quality`` of counts. Null and empty texts have no words and count zero everywhere."""
    t = F.coalesce(F.col(text), F.lit(""))

    def counts(words: Column) -> Column:
        lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
        stop = F.array(*[F.lit(w) for w in dict.fromkeys(STOP_WORDS)])
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
            (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup"), F.size(x).cast("long").alias("n"))).alias("lines"),
            _repeat_words(words).cast("long").alias("n_repeat_words"),
            F.size(F.filter(words, lambda w: F.lower(F.translate(w, ".,;:!?", "")).isin(*dict.fromkeys(STOP_WORDS)))).cast("long").alias("n_stop"),
            F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        )

    return df.withColumn("quality", let(F.filter(F.split(t, BLANK, -1), lambda x: x != ""), counts))


def metrics() -> dict[str, Column]:
    """The ratios that rules may name, over the struct of ``measures``; null where there is nothing to divide by."""
    q = F.col("quality")
    part = lambda a, b: F.try_divide(a, b.cast("double"))
    return {
        "n_words": q["n_words"].cast("double"),
        "mean_word_chars": part(q["word_chars"], q["n_words"]),
        "symbol_ratio": part(q["n_symbols"], q["n_words"]),
        "stop_ratio": part(q["n_stop"], q["n_words"]),
        "dup_line_ratio": part(q["lines"]["n_dup"], q["lines"]["n"]),
        "repeat_ratio": part(q["n_repeat_words"], q["n_words"]),
        "capital_ratio": part(q["n_capitals"], q["word_chars"]),
    }


def compiled(rules: Sequence[Rule] = RULES) -> Column:
    """The names of the rules that a document fails, as one expression."""
    known = metrics()
    fails = []
    for r in rules:
        m = known[r.metric]
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (m < r.low)
        if r.high is not None:
            bad = bad | (m > r.high)
        fails.append(F.when(F.coalesce(bad, F.lit(False)), F.lit(r.name)))
    return F.array_compact(F.array(*fails))


def quality_rules(df: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """df with ``quality`` (counts), ``failed`` (names of failed rules) and ``kept``.

    One projection without user functions or shuffles. Null and empty texts fail ``length``; texts without lines or
    words have null ratios, which pass. Repeated rows are judged alike and all returned; other columns pass through,
    columns of these three names are replaced.
    """
    return measures(df, text).withColumn("failed", compiled(rules)).withColumn("kept", F.size("failed") == 0)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("quality")
    failed = (q["n_words"] < 10) | (100 * q["n_repeat_words"] > 20 * q["n_words"])
    return quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id",
        q["n_words"].alias("n_words"),
        q["word_chars"].alias("word_chars"),
        q["n_symbols"].alias("n_symbols"),
        q["lines"]["n_dup"].alias("n_dup_lines"),
        q["n_repeat_words"].alias("n_repeat_words"),
        failed.alias("base_failed"),
        (~failed & F.col("kept")).alias("kept"),
        F.concat_ws(",", "failed").alias("failed_rules"),
    )
