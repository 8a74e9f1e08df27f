"""Quality rules of texts as one projection: a table of thresholds, compiled to columns.

DataFrame functions only: no Python runs on executors, and no row meets another.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space between words.
SPACE = "\\x20\\x09-\\x0D"
#: What counts as a symbol.
SYMBOLS = "#*$%&|<>"
#: Frequent function words of German, English, French, Spanish, Italian, Portuguese and Dutch.
STOP_WORDS = (
    "der die und den von das mit auf für ist nicht ein eine sich dem im zu"
    " the of and to in is that it for was on with as by this are"
    " le la les et des un une du que pour est par dans sur"
    " el los las del se por con para su no al"
    " il di che non per della sono"
    " o os da do em uma não com"
    " het een van niet zijn op te dat"
).split()
#: Bits of a packed window that hold its place; the others hold its hash.
PLACE_BITS = 31


class Rule(NamedTuple):
    """A document fails ``name`` if ``metric`` is null, under ``least`` or over ``most``."""

    name: str
    metric: str
    least: float | None = None
    most: float | None = None


#: The thresholds, by the metrics of :func:`measured`.
RULES = [
    Rule("short_words", "mean_word_chars", least=2.0),
    Rule("long_words", "mean_word_chars", most=12.0),
    Rule("symbols", "symbol_ratio", most=0.1),
    Rule("shouting", "exclamation_ratio", most=0.3),
    Rule("few_letters", "letter_ratio", least=0.8),
    Rule("few_stop_words", "stop_ratio", least=0.02),
    Rule("repeated_lines", "dup_line_ratio", most=0.4),
    Rule("bullets", "bullet_ratio", most=0.9),
    Rule("ellipses", "ellipsis_ratio", most=0.3),
]


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _packed(words: Column) -> Column:
    """Each window of three words as a hash above its place, sorted."""

    def pack(word: Column, place: Column) -> Column:
        gram = F.xxhash64(word, F.get(words, place + 1), F.get(words, place + 2))
        return F.shiftleft(gram, PLACE_BITS).bitwiseOR(place.cast("long"))

    return F.sort_array(F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), pack))


def _alike(sorted_: Column) -> Column:
    """Places of the windows whose hash is that of a neighbour in order: those that may be repeated."""
    key = lambda x: F.shiftright(x, PLACE_BITS)
    beside = lambda x, i: (key(F.get(sorted_, i - 1)) == key(x)) | (key(F.get(sorted_, i + 1)) == key(x))
    same = F.filter(sorted_, lambda x, i: F.coalesce(beside(x, i), F.lit(False)))
    return F.transform(same, lambda x: x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int"))


def _spelled(words: Column, places: Column) -> Column:
    """The windows at ``places`` with their words, sorted by these."""
    return F.sort_array(F.transform(places, lambda p: F.struct(F.slice(words, p + 1, 3).alias("said"), p.alias("place"))))


def _covered(spelled: Column) -> Column:
    """How many words lie in windows that are found twice or more."""
    said = lambda i: F.get(spelled, i)["said"]
    twice = F.filter(spelled, lambda x, i: F.coalesce((said(i - 1) == x["said"]) | (said(i + 1) == x["said"]), F.lit(False)))
    first = F.transform(twice, lambda x: x["place"])
    return F.size(F.array_distinct(F.concat(first, F.transform(first, lambda p: p + 1), F.transform(first, lambda p: p + 2))))


def _ends_in_dots(line: Column) -> Column:
    end = F.rtrim(line, F.lit(" \t\v\f\r"))
    return end.endswith("...") | end.endswith("…")


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def measured(docs: DataFrame, text: str = "text", stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """``docs`` in a struct ``row``, with the measures of its texts.

    Counts (long): n_words, word_chars, n_symbols, n_dup_lines (lines with a word that equal an
    earlier one), n_repeat_words (words in windows of three that the text holds twice or more).
    Shares (double, 0 without words or lines): mean_word_chars, symbol_ratio and exclamation_ratio
    (symbols or exclamation marks to words), letter_ratio (words with a letter), stop_ratio (words
    that are stop words, case aside), dup_line_ratio, bullet_ratio (lines that begin with a bullet)
    and ellipsis_ratio (lines that end in dots or an ellipsis), of lines with a word. A null text
    has no words.

    Repeated windows are found by sorting hashes with places beside them, and only those whose
    hash is another's are compared word by word; work and memory go with the text's length.
    """
    aside = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    cut = aside.select("row", "t", F.array_remove(F.split("t", f"[{SPACE}]+"), "").alias("w"), F.filter(F.split("t", "\n"), lambda x: x.rlike(f"[^{SPACE}]")).alias("l"))
    sized = cut.select("row", "t", "w", "l", F.size("w").alias("n"), F.size("l").alias("k"), _packed(F.col("w")).alias("p"))
    alike = sized.select("row", "t", "w", "l", "n", "k", _alike(F.col("p")).alias("p"))
    spelled = alike.select("row", "t", "w", "l", "n", "k", _spelled(F.col("w"), F.col("p")).alias("p"))
    n, k, t, w, lines = F.col("n"), F.col("k"), F.col("t"), F.col("w"), F.col("l")
    measures = F.struct(
        n.cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(_without(t, SYMBOLS))).cast("long").alias("n_symbols"),
        (k - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _covered(F.col("p")).cast("long").alias("n_repeat_words"),
        (F.length(t) - F.length(_without(t, "!"))).alias("_marks"),
        F.size(F.filter(w, lambda x: x.rlike("\\p{L}"))).alias("_letters"),
        F.size(F.filter(F.split(F.lower(t), f"[{SPACE}]+"), lambda x: x.isin(stop_words))).alias("_stops"),
        k.alias("_lines"),
        F.size(F.filter(lines, lambda x: x.rlike(f"^[{SPACE}]*[-*•‣▪●]"))).alias("_bullets"),
        F.size(F.filter(lines, _ends_in_dots)).alias("_dots"),
    )
    # A generator keeps filters on measures above it, where each is made once.
    counted = spelled.select("row", F.inline(F.array(measures)))
    words, lines_ = F.col("n_words"), F.col("_lines")
    return counted.select(
        "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        _share(F.col("word_chars"), words).alias("mean_word_chars"),
        _share(F.col("n_symbols"), words).alias("symbol_ratio"),
        _share(F.col("_marks"), words).alias("exclamation_ratio"),
        _share(F.col("_letters"), words).alias("letter_ratio"),
        _share(F.col("_stops"), words).alias("stop_ratio"),
        _share(F.col("n_dup_lines"), lines_).alias("dup_line_ratio"),
        _share(F.col("_bullets"), lines_).alias("bullet_ratio"),
        _share(F.col("_dots"), lines_).alias("ellipsis_ratio"),
    )


def compiled(rules: list[Rule]) -> Column:
    """The names of the rules that a row of measures fails, in their order."""

    def failed(rule: Rule) -> Column:
        inside = F.lit(True)
        if rule.least is not None:
            inside = inside & (F.col(rule.metric) >= rule.least)
        if rule.most is not None:
            inside = inside & (F.col(rule.metric) <= rule.most)
        return F.when(~F.coalesce(inside, F.lit(False)), F.lit(rule.name))

    return F.array_compact(F.array(*map(failed, rules))) if rules else F.array().cast("array<string>")


def quality(docs: DataFrame, text: str = "text", rules: list[Rule] = RULES, stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """:func:`measured` with base_failed (under 50 words, or more than half of the words in repeated
    windows), failed (names of the rules of the table that the text fails) and kept (neither).

    Rows that repeat are rows of their own; an empty table gives none; an empty or null text fails
    the base. Columns of ``docs``, of whatever names, stay in ``row``.
    """
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    told = measured(docs, text, stop_words).withColumns({"base_failed": base, "failed": compiled(rules)})
    return told.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))


def well_made(docs: DataFrame, text: str = "text", rules: list[Rule] = RULES, stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """The rows of ``docs`` that :func:`quality` keeps."""
    return quality(docs, text, rules, stop_words).where("kept").select("row.*")
