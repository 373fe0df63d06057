"""Quality rules: a table of thresholds compiled into Spark projections of built-in functions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelf.functions.names import let
from shelf.llm import common

#: Frequent short words of the languages at hand, lower case.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "on", "was", "be", "with", "as", "by", "this", "are", "at", "from",
    "de", "la", "le", "et", "les", "des", "un", "une", "en", "que", "el", "los", "las", "y", "del",
    "der", "die", "und", "den", "von", "zu", "das", "mit",
)

#: Measure: least and greatest value kept; None leaves a side open. A text without words fails the first rule.
RULES: Mapping[str, tuple[float | None, float | None]] = {
    "n_words": (1, None),
    "chars_per_word": (2.5, 12.0),
    "symbols_per_word": (None, 0.2),
    "stop_word_ratio": (0.05, None),
    "dup_line_ratio": (None, 0.6),
}
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def compiled(rules: Mapping[str, tuple[float | None, float | None]], measures: Mapping[str, Column]) -> Column:
    """One boolean: each measure lies within its bounds; a measure without a value passes."""
    passed = F.lit(True)
    for name, (low, high) in rules.items():
        for bound, holds in ((low, lambda m, b: m >= b), (high, lambda m, b: m <= b)):
            if bound is not None:
                passed = passed & F.coalesce(holds(measures[name], F.lit(bound)), F.lit(True))
    return passed


def measured(
    docs: DataFrame, text: str = "text", rules: Mapping[str, tuple[float | None, float | None]] = RULES, stop_words: Sequence[str] = STOP_WORDS,
    min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT, into: str = "quality",
) -> DataFrame:
    """``docs`` with a struct ``into`` (underscores added if taken): counts, base_failed and kept.

    A null or empty text has no words and fails; texts of any length are read whole; equal rows get equal verdicts.
    A 3-word window is compared by a 64-bit hash; windows are sorted within their text, so a text of repeats costs n log n.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    longest = max((len(w.encode()) for w in stop_words), default=0)  # spares most words the lower case

    def grams(words: Column) -> Column:
        starts = F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0)))
        return F.sort_array(F.transform(starts, lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i"))))

    def repeated(sorted_: Column) -> Column:
        same = lambda g, k: F.coalesce(F.get(sorted_, k)["h"] == g["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(sorted_, lambda g, k: same(g, k - 1) | same(g, k + 1)), lambda g: g["i"]))

    def covered(starts: Column) -> Column:
        """Words under windows of three that start at these places, in order."""
        none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("at"))
        return F.aggregate(starts, none, lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["at"])).alias("n"), i.alias("at")), lambda a: a["n"])

    def counts(words: Column) -> Column:
        lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(common.WORD))
        return F.struct(
            F.size(words).cast("long").alias("n_words"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(whole, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("d"))).alias("lines"),
            let(grams(words), lambda g: covered(repeated(g))).alias("n_repeat_words"),
            F.size(F.filter(words, lambda w: (F.octet_length(w) <= longest) & F.lower(w).isin(*stop_words))).cast("long").alias("n_stop_words"),
        )

    def verdict(c: Column) -> Column:
        total, lines = F.nullif(c["n_words"], F.lit(0)), c["lines"]
        measures = {
            "n_words": c["n_words"], "chars_per_word": c["word_chars"] / total, "symbols_per_word": c["n_symbols"] / total,
            "stop_word_ratio": c["n_stop_words"] / total, "dup_line_ratio": (lines["n"] - lines["d"]) / F.nullif(lines["n"], F.lit(0)),
        }
        failed = (c["n_words"] < min_words) | (c["n_repeat_words"] * 100 > c["n_words"] * max_repeat_percent)
        return F.struct(
            c["n_words"].alias("n_words"), c["word_chars"].alias("word_chars"), c["n_symbols"].alias("n_symbols"),
            (lines["n"] - lines["d"]).alias("n_dup_lines"), c["n_repeat_words"].alias("n_repeat_words"), c["n_stop_words"].alias("n_stop_words"),
            failed.alias("base_failed"), (~failed & compiled(rules, measures)).alias("kept"),
        )

    words = F.regexp_extract_all(whole, F.lit(common.WORD), F.lit(0))
    return docs.withColumn(common.fresh(docs, into), let(let(words, counts), verdict))


def kept(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose text passes, columns unchanged."""
    verdict = common.fresh(docs, "quality")
    return measured(docs, into=verdict, **options).filter(F.col(verdict)["kept"]).select(*[F.col(f"`{c}`") for c in docs.columns])
