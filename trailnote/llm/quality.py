"""Quality rules as one Spark projection: a threshold table compiled to built-in expressions.

Everything runs in the JVM on the row at hand: no join, no shuffle, no user function. Words
are ``[^\\x20\\x09-\\x0D]+``; a null text has none. ``let`` binds an intermediate array to a
lambda variable, so each is computed once per row whatever Catalyst collapses.

Repeated 5-word windows are found by hashing each window to 64 bits; only rows with fewer
distinct hashes than windows sort (hash, place) pairs to find which words they cover.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = "[#*$%&|<>]"
BLANKS = r"[\x20\x09-\x0D]+"
#: What parts two words and ends the last one, with the punctuation before it; begins at no place inside a run of it, so a long run is read once.
ENDS = r"(?<![.,;:!?])[.,;:!?]*+(?:[\x20\x09-\x0D]+|\z)"
WINDOW = 5

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the and of to in a is it for on with as at by this that from was be are or an "
    "der die und das von zu mit den ein des im auf nicht eine sich dem ist für "
    "le la de et les en un une du que dans est pour qui par sur au pas "
    "el los las y del se por con para al lo su como más no"
).split()

# Rule, measure, least, most, words from which the rule applies.
THRESHOLDS = (
    ("length", "n_words", 10, 100_000, 0),
    ("word_length", "mean_word_chars", 2.0, 12.0, 0),
    ("symbols", "symbols_per_word", 0.0, 0.1, 0),
    ("exclamations", "shouts_per_word", 0.0, 0.3, 10),
    ("stop_words", "stop_ratio", 0.06, 1.0, 50),
    ("lines", "dup_line_ratio", 0.0, 0.5, 0),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def _covered(hashes: Column) -> Column:
    """Words that lie in a window whose hash occurs twice or more."""
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(s: Column) -> Column:
        same = lambda x, j, k: F.coalesce(F.get(s, j + k).getField("h") == x.getField("h"), F.lit(False))
        return F.array_sort(F.transform(F.filter(s, lambda x, j: same(x, j, F.lit(-1)) | same(x, j, F.lit(1))), lambda x: x.getField("i")))

    def total(at: Column) -> Column:
        steps = F.transform(at, lambda p, j: F.when(j == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), p - F.get(at, j - 1))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    return let(let(pairs, places), total)


def repeated_words(words: Column) -> Column:
    n = F.size(words)
    window = lambda h: lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])
    starts = F.when(n >= WINDOW, F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    hashes = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.transform(starts, window(h)))
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(h)))


def measures(text: Column) -> Column:
    """A struct of the counts and ratios of one text."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    without = lambda pattern: F.length(F.regexp_replace(text, pattern, ""))
    plain = F.split(F.lower(text), ENDS)

    def counted(words: Column) -> Column:
        n = F.size(words)
        return F.struct(
            n.cast("long").alias("n_words"),
            without(BLANKS).cast("long").alias("word_chars"),
            (F.length(text) - without(SYMBOLS)).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("lines"),
            repeated_words(words).cast("long").alias("n_repeat_words"),
            F.size(F.filter(plain, lambda w: w.isin(STOP_WORDS))).alias("n_stop"),
            (F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))).alias("n_shouts"),
        )

    return let(words_of(text), counted)


def scored(docs: DataFrame, thresholds=THRESHOLDS, text: str = "text") -> DataFrame:
    """docs' doc_id with the counts, base_failed, failed_rules (array of rule names) and kept."""
    m = docs.select(F.col("doc_id").cast("long").alias("doc_id"), measures(F.col(text).cast("string")).alias("m")).select("doc_id", "m.*")
    per_word = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("n_words")), F.lit(0.0))
    ratio = {
        "n_words": F.col("n_words"),
        "mean_word_chars": per_word("word_chars"),
        "symbols_per_word": per_word("n_symbols"),
        "shouts_per_word": per_word("n_shouts"),
        "stop_ratio": per_word("n_stop"),
        "dup_line_ratio": F.coalesce(F.try_divide(F.col("lines.dup"), F.col("lines.n")), F.lit(0.0)),
    }
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    fails = [F.when((F.col("n_words") >= since) & ~ratio[measure].between(least, most), F.lit(rule)) for rule, measure, least, most, since in thresholds]
    failed = F.filter(F.array(*fails), lambda x: x.isNotNull())
    return m.select("doc_id", "n_words", "word_chars", "n_symbols", F.col("lines.dup").cast("long").alias("n_dup_lines"), "n_repeat_words", base.alias("base_failed"), failed.alias("failed_rules")).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
