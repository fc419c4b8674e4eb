"""Quality rules: a threshold table compiled into one projection.

Every metric is a built-in expression over the text; the thresholds become one
boolean expression each.  No user function, no shuffle, one pass over the text.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellshift.llm.common import WHITE, let, text_of, words_of

SYMBOLS = "#*$%&|<>"
# Frequent function words of the corpus languages (English, German, French, Spanish).
STOP_WORDS = (
    "the and of to in is that with for on are as it at was by this be have from or not "
    "der die das und ist von mit für auf im den ein eine nicht sich zu dem des "
    "le la les de et un une est que pour dans sur par pas des du au qui "
    "el los las en y con por para su una del se no lo"
).split()
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


@dataclass(frozen=True)
class Threshold:
    """Keep a document whose metric lies in [low, high]; a missing bound is open."""

    metric: str
    low: float | None = None
    high: float | None = None


THRESHOLDS = (
    Threshold("mean_word_chars", 2.0, 25.0),
    Threshold("symbol_ratio", high=0.1),
    Threshold("stop_word_ratio", low=0.02),
    Threshold("dup_line_ratio", high=0.5),
    Threshold("ellipsis_line_ratio", high=0.3),
    Threshold("bullet_line_ratio", high=0.9),
)


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def repeat_words(words: Column, width: int = 3) -> Column:
    """Words inside a window of ``width`` words that occurs at least twice in the array.

    Windows are sorted with their positions, equal neighbours are kept, and the
    covered words are summed over the kept positions in order.
    """

    def kept(ordered: Column) -> Column:
        return F.filter(
            ordered,
            lambda item, i: (F.get(ordered, i - 1)["window"] == item["window"]) | (F.get(ordered, i + 1)["window"] == item["window"]),
        )

    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - width),
        lambda i: F.struct(F.concat_ws(" ", *[words[i + k] for k in range(width)]).alias("window"), i.alias("at")),
    )
    positions = F.array_sort(F.transform(let(F.sort_array(windows), kept), lambda item: item["at"]))
    covered = F.aggregate(
        positions,
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-width).alias("last")),
        lambda acc, at: F.struct((acc["n"] + F.least(F.lit(width), at - acc["last"])).cast("bigint").alias("n"), at.alias("last")),
        lambda acc: acc["n"],
    )
    return F.when(F.size(words) >= width, covered).otherwise(F.lit(0).cast("bigint"))


def counts(text: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """All raw counts of a text as one struct."""

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("bigint").alias("n_words"),
            F.size(F.filter(words, lambda word: F.lower(word).isin(*stop_words))).cast("bigint").alias("n_stop_words"),
            repeat_words(words).alias("n_repeat_words"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(
            F.size(lines).cast("bigint").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
            F.size(F.filter(lines, lambda line: line.endswith("...") | line.endswith("…"))).cast("bigint").alias("n_ellipsis_lines"),
            F.size(F.filter(lines, lambda line: line.startswith("- ") | line.startswith("* ") | line.startswith("•"))).cast("bigint").alias("n_bullet_lines"),
        )

    lines = F.filter(F.split(text, "\n"), lambda line: F.length(_without(line, WHITE)) > 0)
    return F.struct(
        let(words_of(text), of_words).alias("w"),
        let(lines, of_lines).alias("l"),
        F.length(_without(text, WHITE)).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(_without(text, SYMBOLS))).cast("bigint").alias("n_symbols"),
    )


def _share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


METRICS = {
    "mean_word_chars": lambda: _share("word_chars", "n_words"),
    "symbol_ratio": lambda: _share("n_symbols", "n_words"),
    "stop_word_ratio": lambda: _share("n_stop_words", "n_words"),
    "dup_line_ratio": lambda: _share("n_dup_lines", "n_lines"),
    "ellipsis_line_ratio": lambda: _share("n_ellipsis_lines", "n_lines"),
    "bullet_line_ratio": lambda: _share("n_bullet_lines", "n_lines"),
}


def passes(thresholds: Sequence[Threshold]) -> Column:
    """Compile a threshold table into one boolean expression over the metric columns."""
    verdict = F.lit(True)
    for rule in thresholds:
        if rule.low is not None:
            verdict = verdict & (F.col(rule.metric) >= F.lit(float(rule.low)))
        if rule.high is not None:
            verdict = verdict & (F.col(rule.metric) <= F.lit(float(rule.high)))
    return verdict


def judge(docs: DataFrame, text: str = "text", thresholds: Sequence[Threshold] = THRESHOLDS) -> DataFrame:
    """Append counts, metrics, ``base_failed`` and ``kept`` to every row.

    Base rule: fewer than 50 words, or more than half of the words inside repeated
    3-word windows.  A row that fails it is never kept; otherwise the thresholds decide.
    Null texts count as empty (zero words, base failed).  Repeated rows are judged
    one by one.  Existing columns keep their names and values except those with the
    names of the appended ones, which are replaced.
    """
    names = ["_words", "_lines", "_chars", "_symbols"]
    while set(names) & {*docs.columns, text}:
        names = [name + "_" for name in names]
    w, l_, chars, symbols = (F.col(name) for name in names)
    fields = {name: w[name] for name in ("n_words", "n_stop_words", "n_repeat_words")}
    fields |= {name: l_[name] for name in ("n_lines", "n_dup_lines", "n_ellipsis_lines", "n_bullet_lines")}
    fields |= {"word_chars": chars, "n_symbols": symbols}
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    # A generator of one row: its columns cannot be inlined, so a filter on them does not count the text again.
    return (
        docs.select("*", F.inline(F.array(counts(text_of(text)))).alias(*names))
        .withColumns(fields)
        .drop(*names)
        .withColumns({name: metric() for name, metric in METRICS.items()})
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & passes(thresholds))
    )


def filter_quality(docs: DataFrame, text: str = "text", thresholds: Sequence[Threshold] = THRESHOLDS) -> DataFrame:
    """Rows that the rules keep, with the input's columns."""
    return judge(docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("_text")), "_text", thresholds).filter("kept").select("_row.*")
