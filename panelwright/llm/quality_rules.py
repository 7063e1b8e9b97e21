"""Quality rules: a threshold table compiled into Spark projections, without user functions and without a shuffle.

Words are runs of anything but space and 0x09-0x0D. A text that is NULL or has no words gets zeros everywhere and
fails the base rule. Rows are judged one by one: repeated rows get the same verdict, an empty table gives an empty
result, and columns of the input whose names clash with new ones are replaced only in `measure`'s output, which keeps
`keep` columns alone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAPS = r"[ \t-\r]+"
SYMBOLS = "#*$%&|<>"

# Frequent short words of the four languages of the corpus, as they stand in a text.
STOP_WORDS = (
    "the of and to a in is that for it with as was on be at by this from are or an "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als "
    "de la le et les des en un du une que est pour qui dans par sur au pas "
    "el y los se del las por con una su al es lo como"
).split()


@dataclass(frozen=True)
class Rule:
    """Pass when low * per <= 1000 * part <= high * per, in whole numbers; None leaves a side open."""

    name: str
    part: str
    per: str
    low: int | None = None
    high: int | None = None

    def holds(self) -> Column:
        part, per = F.col(self.part) * 1000, F.col(self.per)
        ok = F.lit(True)
        if self.low is not None:
            ok = ok & (part >= per * self.low)
        if self.high is not None:
            ok = ok & (part <= per * self.high)
        return ok


RULES = (
    Rule("word_length", "word_chars", "n_words", low=2500, high=12000),
    Rule("symbols", "n_symbols", "n_words", high=100),
    Rule("exclamations", "n_exclaimed", "n_words", high=100),
    Rule("capitals", "n_capitals", "word_chars", high=300),
    Rule("stop_words", "n_stop", "n_words", low=5),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=300),
)

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURES = (*BASE, "n_lines", "n_exclaimed", "n_capitals", "n_stop")


def measure(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """`keep` and the MEASURES of every text."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], body.alias("__text"))
    rows = rows.withColumn("__words", F.filter(F.split("__text", GAPS), lambda w: w != ""))
    rows = rows.withColumn("__lines", F.filter(F.split("__text", "\n"), lambda line: F.length(_without(line, " \t\n\x0b\f\r")) > 0))
    rows = rows.withColumn("n_words", F.size("__words").cast("long"))
    rows = rows.withColumn("__low", F.pow(F.lit(2.0), F.ceil(F.log2(F.size("__words") + 1))).cast("long") - 1)
    rows = rows.withColumn("__keys", _window_keys())
    rows = rows.withColumn("__places", _repeat_pairs())
    word_chars = F.length(_without(F.col("__text"), " \t\n\x0b\f\r"))
    measures = F.struct(
        "n_words",
        word_chars.cast("long").alias("word_chars"),
        _count_of(SYMBOLS).alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        _covered().alias("n_repeat_words"),
        F.size("__lines").cast("long").alias("n_lines"),
        F.size(F.filter("__words", lambda w: w.endswith("!!"))).cast("long").alias("n_exclaimed"),
        _count_of("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_capitals"),
        F.size(F.filter("__words", lambda w: w.isin(STOP_WORDS))).cast("long").alias("n_stop"),
    )
    # Through `inline` no later filter is pushed below, where it would measure each text again, word by word.
    return rows.select(*[F.col(f"`{c}`") for c in keep], F.inline(F.array(measures)))


def judge(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """With base_failed, kept and the names of the broken rules (in table order)."""
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    broken = F.array_compact(F.array(*[F.when(~rule.holds(), F.lit(rule.name)) for rule in rules]))
    return measured.withColumns({"base_failed": failed, "broken_rules": broken}).withColumn(
        "kept", ~F.col("base_failed") & (F.size("broken_rules") == 0)
    )


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _count_of(chars: str) -> Column:
    return (F.length("__text") - F.length(_without(F.col("__text"), chars))).cast("long")


def _window_keys() -> Column:
    """One long for each 3-word window, sorted: a hash above, the window's place in the low bits that the text's
    length needs. Sorting brings equal windows together."""
    words, low = F.col("__words"), F.col("__low")
    high = F.bitwise_not(low)
    places = F.sequence(F.lit(0), F.size(words) - 3)
    keys = F.transform(
        places,
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).bitwiseAND(high).bitwiseOR(i.cast("long")),
    )
    return F.when(F.size(words) >= 3, F.sort_array(keys)).otherwise(F.array().cast("array<bigint>"))


def _repeat_pairs() -> Column:
    """Places of neighbouring windows whose hashes are equal, which is rare enough to compare the words themselves."""
    words, keys, low = F.col("__words"), F.col("__keys"), F.col("__low")

    def alike(a: Column, b: Column) -> Column:
        return F.when(a.bitwiseXOR(b).between(F.lit(0), low), F.array(a.bitwiseAND(low).cast("int"), b.bitwiseAND(low).cast("int")))

    def same(pair: Column) -> Column:
        p, q = F.get(pair, F.lit(0)), F.get(pair, F.lit(1))
        return (F.slice(words, p + 1, 3) == F.slice(words, q + 1, 3)) & pair.isNotNull()

    near = F.array_compact(F.zip_with(keys, F.slice(keys, 2, F.size(keys)), alike))
    return F.sort_array(F.array_distinct(F.flatten(F.filter(near, same))))


def _covered() -> Column:
    """Words inside windows at the sorted places."""
    places = F.col("__places")
    gaps = F.zip_with(places, F.slice(places, 2, F.size(places)), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    return F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap).cast("long")
