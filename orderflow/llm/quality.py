"""Quality rules: a table of thresholds, compiled into one projection.

Every measure is a built-in column expression over the whole text, so the rules
run inside the scan's stage without a shuffle and without user functions.

Defined cases: a null text counts as empty; an empty text has zero words and
fails the base rule; ratios over zero words or lines are 0; ties and repeated
rows are judged alike; an empty table gives an empty table. Other columns of the
input pass through; those named like an output are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
#: Frequent function words of the corpus languages.
STOP_WORDS = (
    "the and of to in a is that it for on was with as be by at from or an are this not which but have "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus "
    "le la les de des du et un une est que dans en pour qui sur par au avec il elle ne pas plus "
    "el los las y que se un una por con no para su al lo como más del es"
).split()
STOP_WORDS = sorted(set(STOP_WORDS))


@dataclass(frozen=True)
class Rule:
    """A document passes if low <= measure <= high (None: open)."""

    measure: str
    low: float | None = None
    high: float | None = None


#: The thresholds. The measures are the names in ``measures``.
RULES = (
    Rule("n_words", low=50),
    Rule("repeat_word_ratio", high=0.5),
    Rule("mean_word_length", low=2, high=14),
    Rule("symbol_ratio", high=0.1),
    Rule("stop_word_ratio", low=0.05),
    Rule("number_word_ratio", high=0.25),
    Rule("dup_line_ratio", high=0.4),
    Rule("bullet_line_ratio", high=0.9),
    Rule("ellipsis_line_ratio", high=0.3),
)


def repeated_words(words: Column) -> Column:
    """Words in 3-word windows that occur at least twice in ``words``.

    Windows are compared by 64-bit hashes. Only if some are equal are they sorted
    with their places; equal neighbours are repeats. Windows at p and q cover
    min(3, q - p) words of their own.
    """
    size = F.size(words)
    none = F.lit(0).cast("long")
    hashes = F.transform(
        F.sequence(F.lit(0), size - 3),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
    )

    def places(s: Column) -> Column:
        def place(x: Column, j: Column) -> Column:
            twice = F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))
            return F.when(twice, x["i"])

        return F.sort_array(F.filter(F.transform(s, place), lambda p: p.isNotNull()))

    start = F.struct(none.alias("n"), F.lit(-3).alias("last"))
    covered = lambda ps: F.aggregate(
        ps,
        start,
        lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"],
    )
    placed = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    found = lambda h: let(placed(h), lambda s: let(places(s), covered))
    return F.when(size < 3, none).otherwise(
        let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(found(h)))
    )


def measures(text: Column) -> Column:
    """A struct with all counts and ratios of one text."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(" \t\n\x0b\f\r")) != "")
    count = lambda xs, test: F.size(F.filter(xs, test)).cast("long")
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))

    def build(w: Column, x: Column) -> Column:
        n = F.size(w).cast("long")
        base = F.struct(
            n.alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
            count(w, lambda v: v.isin(STOP_WORDS)).alias("n_stop_words"),
            count(w, lambda v: (v >= "0") & (v < ":")).alias("n_number_words"),
            count(x, lambda v: F.ltrim(v).rlike("^[*•-]")).alias("n_bullet_lines"),
            count(x, lambda v: F.rtrim(v).endswith("...") | F.rtrim(v).endswith("…")).alias("n_ellipsis_lines"),
        )
        ratios = lambda m: F.struct(
            *(m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")),
            share(m["word_chars"], n).alias("mean_word_length"),
            share(m["n_symbols"], m["word_chars"]).alias("symbol_ratio"),
            share(m["n_repeat_words"], n).alias("repeat_word_ratio"),
            share(m["n_stop_words"], n).alias("stop_word_ratio"),
            share(m["n_number_words"], n).alias("number_word_ratio"),
            share(m["n_dup_lines"], m["n_lines"]).alias("dup_line_ratio"),
            share(m["n_bullet_lines"], m["n_lines"]).alias("bullet_line_ratio"),
            share(m["n_ellipsis_lines"], m["n_lines"]).alias("ellipsis_line_ratio"),
        )
        return let(base, ratios)

    return let(words, lambda w: let(lines, lambda x: build(w, x)))


def failures(m: Column, rules=RULES) -> Column:
    """The names of the rules that the measures ``m`` break, in the table's order."""
    tests = []
    for r in rules:
        v = m[r.measure]
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (v < r.low)
        if r.high is not None:
            bad = bad | (v > r.high)
        tests.append(F.when(bad, F.lit(r.measure)))
    return F.filter(F.array(*tests), lambda x: x.isNotNull())


def judge(df: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """``df`` with ``measures`` (a struct), ``failed_rules`` and ``kept``.

    Measures and failures are one expression, so that a filter on ``kept`` evaluates
    the measures once and not for every rule.
    """
    outs = ("measures", "failed_rules", "kept")
    df = df.select(*[f"`{c}`" for c in df.columns if c.lower() not in outs or c == text])
    names = [F.col(f"`{c}`") for c in df.columns if c.lower() not in outs]
    m = fresh(df, "m")
    both = let(measures(F.col(f"`{text}`")), lambda x: F.struct(x.alias("measures"), failures(x, rules).alias("failed")))
    judged = F.col(m)
    out = df.withColumn(m, both)
    return out.select(*names, judged["measures"].alias("measures"), judged["failed"].alias("failed_rules"), (F.size(judged["failed"]) == 0).alias("kept"))
