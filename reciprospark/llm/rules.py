"""Quality rules: a threshold table compiled into one Spark projection.

Texts are split into words ``[^\\x20\\x09-\\x0D]+`` and into ``\\n``-separated lines; counts come from
array functions, ratios from the counts, verdicts from the table of thresholds. No user function runs.

Defined cases: a null text counts as empty (all counts 0, base_failed true, kept false); rows that repeat
are judged each by itself; other columns, whatever their names, pass through ``judge`` untouched or are
left out by ``measure``; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is it that for with was on as are be this by at from or an he which not "
    "der die das und ist nicht ein eine von zu den mit sich auf dem des im auch es an "
    "le la les et un une du que est pour qui dans par sur au se avec elle pas "
    "el los las de en y del con no su al por para una lo como"
).split()


@dataclass(frozen=True)
class Rule:
    """A document fails where ``metric`` is below ``low`` or above ``high``."""

    metric: str
    low: float | None = None
    high: float | None = None


#: The production thresholds, applied to documents that pass the base rules.
THRESHOLDS = (
    Rule("mean_word_chars", 2.0, 14.0),
    Rule("symbol_ratio", high=0.10),
    Rule("exclamation_ratio", high=0.30),
    Rule("stop_word_ratio", low=0.04),
    Rule("dup_line_ratio", high=0.50),
)

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words that stand in a 3-word window which the text holds twice or more.

    Windows are compared by a 64-bit hash of their three words. Repeated windows are found by sorting
    (hash, place); the places then give the number of words covered.
    """

    def covered(hashes: Column) -> Column:
        places = _let(
            F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
            lambda s: F.sort_array(
                F.transform(
                    F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))),
                    lambda x: x["i"],
                )
            ),
        )
        start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
        return F.aggregate(places, start, lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last")))["n"]

    windows = F.when(
        F.size(words) >= 3,
        F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))),
    )
    return F.coalesce(_let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0)), F.lit(0))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the ratios."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.select(
        F.col(id_col),
        F.array_remove(F.split(text, SPACES), "").alias("words"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.regexp_count(text, F.lit(SYMBOLS)).alias("n_symbols"),
        F.regexp_count(text, F.lit("!")).alias("n_exclamations"),
    )
    counts = split.select(
        id_col,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        "n_exclamations",
        F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))).alias("n_stop_words"),
    )
    per_word = lambda c: F.col(c) / F.greatest(F.col("n_words"), F.lit(1))
    return counts.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        per_word("word_chars").alias("mean_word_chars"),
        per_word("n_symbols").alias("symbol_ratio"),
        per_word("n_exclamations").alias("exclamation_ratio"),
        per_word("n_stop_words").alias("stop_word_ratio"),
        (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("dup_line_ratio"),
    )


def compiled(rules: tuple[Rule, ...]) -> Column:
    """The names of the rules that fail, as an array column."""
    tests = []
    for rule in rules:
        bad = [t for t in ((F.col(rule.metric) < rule.low) if rule.low is not None else None, (F.col(rule.metric) > rule.high) if rule.high is not None else None) if t is not None]
        tests.append(F.when(reduce(Column.__or__, bad), F.lit(rule.metric)))
    return F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>")


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = THRESHOLDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``measure`` with base_failed, the failed rules and kept. A row per row of ``docs``."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    judged = measure(docs, id_col, text_col).withColumn("base_failed", base).withColumn("failed_rules", compiled(rules))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = THRESHOLDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns. Needs no join: a row is judged where it is read."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("judged_text"))
    # the number keeps the optimiser from moving the filter below the projections, where it would repeat their work for each word
    judged = quality_rules(row, rules, "row", "judged_text").withColumn("number", F.monotonically_increasing_id())
    return judged.filter("kept AND number >= 0").select("row.*")
