"""Spelling variants: words one letter apart, each pointing at a much more frequent one, down to a root.

1. Words are runs of letters of at least LEAST code points with A-Z lowered, counted over all texts before
   any shuffle of single occurrences.
2. Symmetric deletion: a word emits the hash of itself and of each distinct deletion of one letter,
   with the places whose deletion gives it (a run of equal letters). Words at distance one meet
   in an equi-join on these hashes, each pair once: one is a deletion of the other, or both lose
   a letter at a common place. Places are part of the join, so words that only share a deletion
   form no pair. Words with one deletion at one place differ in one letter, so no more of
   them meet than there are letters: the join's size is in proportion to the words' lengths.
3. Pairs are verified on the words themselves, since hashes may agree by chance.
4. A word's near words are counted and the most frequent taken, in one aggregate; roots are found by
   following forms, doubling the distance in each round.

A word of any length emits hashes only, computed from prefix sums in time and space linear in its length.

Defined cases: null and empty texts have no words; a null doc_id counts as an empty string in the hash;
rows repeated whole count again; no words, no rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailnote.llm.common import _BYTE, _UNBASE, landed, mapped, mixed, powers, spread

LEAST, OFTEN, TIMES = 6, 5, 5
LETTERS = r"a-zÀ-ÿ"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of keys that are handed on at once.
SLICE = 1 << 16


def spoilt(doc_id: Column, run: Column, every: int = 199) -> Column:
    """run without one letter wherever every divides the CRC-32 of doc_id:run."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def counted(docs: DataFrame, text: str = "text", key: str = "doc_id", every: int = 199, least: int = LEAST, often: int = OFTEN) -> DataFrame:
    """(wid, word, n) of the words with at least least code points and often occurrences."""
    runs = F.regexp_extract_all(F.translate(F.col(text).cast("string"), _UPPER, _LOWER), F.lit(f"([{LETTERS}]{{{least},}})"))
    each = docs.select(F.col(key).alias("doc_id"), F.explode(runs).alias("run")).select(spoilt(F.col("doc_id"), F.col("run"), every).alias("word"))
    words = each.filter(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= often)
    return landed(words.select(F.monotonically_increasing_id().alias("wid"), "word", "n"), "words")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, wid, from, to) of rows (wid, word): the word itself with from -1, and its distinct deletions with the places that give them."""
    for batch in batches:
        if not batch.num_rows:
            continue
        # Letters are below U+0100, so Latin-1 has one byte a letter.
        each = [w.encode("latin-1") for w in batch.column(1).to_pylist()]
        data = np.frombuffer(b"".join(each), np.uint8)
        bounds = np.cumsum([0, *map(len, each)])
        wid, word = batch.column(0).to_numpy(), np.repeat(np.arange(len(each)), np.diff(bounds))
        power, undo = powers(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * power[:-1], out=total[1:])
        starts, ends = bounds[:-1], bounds[1:]
        whole = mixed((total[ends] - total[starts]) * undo[starts])
        new = np.ones(len(data), bool)
        new[1:] = (data[1:] != data[:-1]) | (word[1:] != word[:-1])
        at = np.flatnonzero(new)
        to = np.append(at[1:], len(data)) - 1
        of = word[at]
        lost = mixed(((total[at] - total[starts[of]]) + (total[ends[of]] - total[at + 1]) * np.uint64(_UNBASE)) * undo[starts[of]])
        none = np.full(len(each), -1)
        columns = [np.concatenate(x) for x in ((whole.view(np.int64), lost.view(np.int64)), (wid, wid[of]), (none, at - starts[of]), (none, to - starts[of]))]
        for a in range(0, len(columns[0]), SLICE):
            yield pa.RecordBatch.from_arrays([pa.array(c[a : a + SLICE]) for c in columns], ["key", "wid", "from", "to"])


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b): both orders of each pair of words (by wid) that differ by one letter put in, left out or replaced."""
    keys = mapped(words.select("wid", "word"), _keys, "key long, wid long, from long, to long")
    left, right = (keys.select("key", *[F.col(c).alias(f"{side}_{c}") for c in ("wid", "from", "to")]) for side in "lr")
    lost = lambda side: F.col(f"{side}_from") >= 0
    either = (~lost("l") & lost("r")) | (~lost("r") & lost("l")) | (lost("l") & lost("r") & (F.col("l_from") <= F.col("r_to")) & (F.col("r_from") <= F.col("l_to")))
    met = left.join(spread(right), (left.key == right.key) & (F.col("l_wid") < F.col("r_wid")) & either).select(F.col("l_wid").alias("a"), F.col("r_wid").alias("b"))
    met = met.join(spread(words.select(F.col("wid").alias("a"), F.col("word").alias("a_word"))), "a").join(spread(words.select(F.col("wid").alias("b"), F.col("word").alias("b_word"))), "b")
    sure = met.filter(F.levenshtein("a_word", "b_word", 1) == 1).select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x"))
    return sure.select("x.a", "x.b")


def forms(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, n, n_near, form, form_n): of near words the most frequent, ties by code points, if it occurs times as often."""
    other = near_pairs(words).join(spread(words.select(F.col("wid").alias("b"), F.col("word").alias("other"), F.col("n").alias("other_n"))), "b")
    best = other.groupBy(F.col("a").alias("wid")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    met = words.join(spread(best), "wid", "left")
    more = -F.col("best.less") >= times * F.col("n")
    return met.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(more, F.col("best.other")).alias("form"), F.when(more, -F.col("best.less")).alias("form_n"))


def grouped(words: DataFrame, times: int = TIMES) -> DataFrame:
    """forms with root: from the word, its forms followed to the last. A form is more frequent, so there are no cycles."""
    found = landed(forms(words, times), "forms")
    roots = landed(found.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        step = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = landed(roots.join(spread(step), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if roots.filter("moved").isEmpty():
            break
        roots = roots.select("word", "root")
    met = found.join(spread(roots.select("word", "root")), "word", "left")
    return met.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
