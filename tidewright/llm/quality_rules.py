"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is a Spark expression over the whole text, and a rule is a row (name, measure, comparison, bound).
No user function, pandas or Arrow takes part, and there is no shuffle: a text is judged by itself.

Null and empty texts have no words: all measures are 0 and the base rule rejects them. A very long text is measured as a
whole, in one row. A ratio equal to its bound passes; equal lines count from the second on, so there are no ties. Repeated
rows are each judged. An empty table gives no rows. Columns of the input other than the text stay as they are; the measures
take the names in MEASURES, and an input column of such a name is replaced; `passing` gives rows back with their own columns, whatever
their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, set_aside

#: Frequent function words, as they stand in a text (fixed values).
STOP_WORDS = {
    "en": ["the", "be", "to", "of", "and", "that", "have", "with", "is", "in", "for", "on", "it", "as", "was", "a", "by", "at", "or", "this"],
    "de": ["der", "die", "das", "und", "in", "zu", "den", "nicht", "von", "ist", "mit", "dem", "des", "für", "im", "ein", "eine", "auf"],
    "fr": ["le", "la", "les", "de", "des", "et", "en", "un", "une", "que", "qui", "du", "dans", "est", "pas", "pour", "il", "ce"],
    "es": ["el", "la", "los", "las", "de", "y", "que", "en", "un", "una", "por", "con", "no", "es", "se", "para", "del", "al"],
}
WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_bullet_lines", "base_failed", "broken_rules", "kept")


@dataclass(frozen=True)
class Rule:
    """A text fails where `measure` is below (`min`) or above (`max`) the bound."""

    name: str
    measure: str
    comparison: str
    bound: float


#: The method's table: length, symbol, stop-word and line ratios.
RULES = (
    Rule("short_words", "mean_word_length", "min", 2.0),
    Rule("long_words", "mean_word_length", "max", 12.0),
    Rule("symbols", "symbol_ratio", "max", 0.1),
    Rule("few_stop_words", "stop_word_ratio", "min", 0.01),
    Rule("repeated_lines", "dup_line_ratio", "max", 0.5),
    Rule("bullet_lines", "bullet_line_ratio", "max", 0.9),
)


def _count_without(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def measured(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with the measures of each text as long and double columns."""
    kept = [c for c in docs.columns]
    body = F.coalesce(F.col(text), F.lit(""))
    out = docs.select(
        "*",
        F.array_remove(F.split(body, SPACE, -1), "").alias("__words"),
        F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__lines"),
        F.length(F.translate(body, " \t\n\x0b\x0c\r", "")).cast("long").alias("__chars"),
        _count_without(body, "#*$%&|<>").cast("long").alias("__symbols"),
    )
    windows = F.transform(F.sequence(F.lit(1), F.size("__words") - (window - 1)), lambda i: F.xxhash64(F.slice("__words", i, window)))
    out = out.withColumn("__hashes", F.when(F.size("__words") > window, windows))
    # Only a text in which a window repeats is sorted.
    placed = F.sort_array(F.transform("__hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("__placed", F.when(F.size("__hashes") > F.size(F.array_distinct("__hashes")), placed))
    same = lambda x, j: F.coalesce(F.get("__placed", j)["h"] == x["h"], F.lit(False))
    twice = F.filter(F.col("__placed"), lambda x, j: (j > 0) & same(x, j - 1) | same(x, j + 1))
    out = out.withColumn("__at", F.sort_array(F.transform(twice, lambda x: x["i"])))
    new = F.transform("__at", lambda p, j: F.least(F.lit(window), F.get("__at", j + 1) - p))
    stop = sorted({w for words in STOP_WORDS.values() for w in words} | {w.capitalize() for words in STOP_WORDS.values() for w in words})
    out = out.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.col("__chars"),
            "n_symbols": F.col("__symbols"),
            "n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": F.coalesce(F.aggregate(new, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"),
            "n_stop_words": F.size(F.filter("__words", lambda w: w.isin(stop))).cast("long"),
            "n_bullet_lines": F.size(F.filter("__lines", lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•|]"))).cast("long"),
        }
    )
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_bullet_lines"]
    return out.select(*[c for c in kept if c not in names], *names)


def ratios() -> dict[str, Column]:
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "mean_word_length": share("word_chars", "n_words"),
        "symbol_ratio": share("n_symbols", "n_words"),
        "stop_word_ratio": share("n_stop_words", "n_words"),
        "dup_line_ratio": share("n_dup_lines", "n_lines"),
        "bullet_line_ratio": share("n_bullet_lines", "n_lines"),
    }


def failed(rules: tuple[Rule, ...] = RULES) -> Column:
    """The names of the rules that a text breaks, as one expression over its measures."""
    of = ratios()
    tests = [F.when((of[r.measure] < r.bound) if r.comparison == "min" else (of[r.measure] > r.bound), r.name) for r in rules]
    return F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>")


def judged(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, min_words: int = 20, max_repeat_percent: int = 30) -> DataFrame:
    """docs with measures, base_failed, broken_rules and kept."""
    out = measured(docs, text)
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    out = out.withColumns({"base_failed": base, "broken_rules": failed(rules)})
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("broken_rules") == 0))


def passing(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """The rows of docs that are kept, with their own columns.

    The row number keeps the filter above the projection: pushed below it, each of the filter's measures would be
    written out and computed anew wherever another one uses it.
    """
    own, restored = set_aside(docs, MEASURES)
    found = judged(own, text, **how).withColumn("__row", F.monotonically_increasing_id())
    return restored(found.where(F.col("kept") & (F.col("__row") >= 0)))
