"""Quality rules: a threshold table compiled into one projection of ratios.

The features are column expressions over the text alone; the rules are rows of (name, feature, least,
most), compiled into one boolean projection.  No user function runs, no row moves.

Cases: null text - no words, all counts 0, fails; empty text - the same; very long texts - whole, in one
row; ties and repeated rows - judged alike; empty table - empty result; other columns - passed by
``keep_good`` and ignored by ``quality``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]"
GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
# fixed values: frequent function words of the languages the rules are meant for
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "au avec dans de des du elle en est et la le les mais par pas pour que qui se sur un une "
    "als auch auf das dem den der des die ein eine für im ist mit nicht sich sie und von zu "
    "al como con del el ella en es esta los las lo no o para por se su sus un y"
)


@dataclass(frozen=True)
class Rule:
    """A document passes if ``least <= feature <= most`` (either side may be open)."""

    name: str
    feature: str
    least: float | None = None
    most: float | None = None


RULES = (
    Rule("enough_words", "n_words", least=50),
    Rule("repeated_windows", "repeat_ratio", most=0.5),
    Rule("word_length_low", "mean_word_chars", least=2.0),
    Rule("word_length_high", "mean_word_chars", most=14.0),
    Rule("symbols", "symbol_ratio", most=0.05),
    Rule("stop_words", "stop_ratio", least=0.02),
    Rule("duplicate_lines", "dup_line_ratio", most=0.5),
)


def _bound(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _window_hash(words: Column, i: Column) -> Column:
    return F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))


def _twins(ordered: Column, key) -> Column:
    """Members of a sorted array whose key equals that of a neighbour."""
    return F.filter(
        ordered,
        lambda x, j: (key(F.get(ordered, j - 1)) == key(x)) | (key(F.get(ordered, j + 1)) == key(x)),
    )


def _repeated(words: Column) -> Column:
    """Words that lie in a window of three that occurs at least twice.

    A sort of plain longs, half hash and half place, leaves few windows that may have a twin; these are
    sorted by their whole hash.  In order of place, each adds the words the one before did not cover.
    """
    n = F.size(words)
    high, low = F.lit(-(1 << 32)), F.lit((1 << 32) - 1)
    packed = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: _window_hash(words, i).bitwiseAND(high).bitwiseOR(i.cast("bigint")),
    )

    def cover(places: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(0), F.size(places) - 1),
            F.lit(0).cast("bigint"),
            lambda total, j: total
            + F.least(F.lit(3), F.coalesce(F.get(places, j + 1) - F.get(places, j), F.lit(3))),
        )

    def exact(likely: Column) -> Column:
        windows = F.transform(likely, lambda x: F.struct(_window_hash(words, x).alias("h"), x.alias("i")))
        twins = _bound(F.sort_array(windows), lambda w: _twins(w, lambda x: x["h"]))
        return _bound(F.sort_array(F.transform(twins, lambda x: x["i"])), lambda p: F.when(F.size(p) == 0, 0).otherwise(cover(p)))

    likely = _bound(F.sort_array(packed), lambda p: _twins(p, lambda x: F.shiftrightunsigned(x, 32)))
    places = F.transform(likely, lambda x: x.bitwiseAND(low).cast("int"))
    return F.when(n < 4, F.lit(0)).otherwise(_bound(places, lambda p: F.when(F.size(p) == 0, 0).otherwise(exact(p)))).cast("bigint")


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the base counts and the ratios as further columns."""
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(body, GAP), lambda w: w != "")
    lines = F.filter(F.split(body, "\n", -1), lambda line: line.rlike(WORD))
    stops = [F.lit(w) for w in sorted(set(STOP_WORDS.split()))]
    staged = docs.select("*", words.alias("_words"), lines.alias("_lines"), body.alias("_body"))
    counted = staged.select(
        *docs.columns,
        F.size("_words").cast("bigint").alias("n_words"),
        F.length(F.translate("_body", " \t\n\x0b\x0c\r", "")).cast("bigint").alias("word_chars"),
        (F.length("_body") - F.length(F.translate("_body", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        F.size(F.filter("_words", lambda w: F.lower(w).isin(stops))).cast("bigint").alias("n_stop_words"),
        _bound(F.col("_words"), _repeated).alias("n_repeat_words"),
    )
    n = F.greatest(F.col("n_words"), F.lit(1))
    return counted.select(
        "*",
        (F.col("word_chars") / n).alias("mean_word_chars"),
        (F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))).alias("symbol_ratio"),
        (F.col("n_stop_words") / n).alias("stop_ratio"),
        (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("dup_line_ratio"),
        (F.col("n_repeat_words") / n).alias("repeat_ratio"),
    )


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """True where every rule of the table holds."""
    tests = [F.lit(True)]
    for rule in rules:
        if rule.least is not None:
            tests.append(F.col(rule.feature) >= F.lit(rule.least))
        if rule.most is not None:
            tests.append(F.col(rule.feature) <= F.lit(rule.most))
    kept = tests[0]
    for test in tests[1:]:
        kept = kept & test
    return kept


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Base counts, ratios and verdict of each document."""
    found = features(docs.select(F.col(key), F.col(text)), text)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return found.drop(text).select("*", base.alias("base_failed")).select("*", (~F.col("base_failed") & compile_rules(rules)).alias("kept"))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The documents that pass every rule, with the columns of ``docs``."""
    judged = features(docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("_text")), "_text")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.where(~base & compile_rules(rules)).select("_row.*")
