"""Near-duplicate passages by anchors.

Tokens are hashes of 5-word grams. Of each RUN consecutive grams of a text the one of smallest
hash is an anchor, so two texts that share RUN grams in a row share an anchor there, wherever
the run stands, and a text gives about two anchors for each RUN grams. A passage of
similarity 0.8 has shared grams >= 4 * unshared grams of both sides; with MIN_WORDS words or
more it therefore holds a run of RUN shared grams if each of its gaps has at least 7 unshared
ones (a word replaced: 10, put in or left out: 9, doubled: 7). So no near passage is left to chance.

1. Texts that equal an earlier one repeat it whole; only the first of them goes on.
2. Anchors meet by their gram. In a group of at most NEAR + 1 anchors all pairs are candidates;
   in a larger one each anchor and the first; what stands in one text alone goes no further. A pair goes on where RUN grams around the
   anchor can be equal, told by the hashes of three times four words on each side.
3. In a larger group texts with a part of a passage can stand before the one that has it whole. So its
   anchors meet again, each time as in 2: by the gram and the words on one side, by two grams of
   PAIRED + 1 such anchors that follow each other in a text, and by 2, 4, 8, ... of them, until no
   group is large. And the frames of MIN_WORDS words around them meet by the hash of all their
   words, so every exact repeat is found. A near one is missed only if all that its two texts share stays
   in large groups through these steps, each with a first text that has less of it.
4. Verification: the candidates' grams, cut in blocks of the source text, are compared at all shifts
   in reach; of equal runs every stretch of MIN_WORDS words with shared grams / all grams >= SIMILARITY
   is a passage, from wherever it begins.

Defined cases: null, empty and short texts have no passages; repeats inside one document do
not count; rows repeated whole count once; of unlike texts of one doc_id that of the smallest
hash counts and the others are left alone; rows with null doc_id are left alone. A text may
have 2**26 words (one of more is a step whose places no longer fit beside their values).
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailnote.llm.common import _COMBINE, GRAM, Words, keyed, landed, mapped, mixed, packed, powers, settled, shelf, spread, steps, unpacked

MIN_WORDS = 50
SIMILARITY = 0.8
RUN = 16
#: In a group of at most one anchor more than this all pairs meet; larger ones meet again by longer keys.
NEAR = 8
#: Of the anchors of larger groups in a text, so many that follow each other are paired.
PAIRED = 6
#: Shifts that are asked for together, and how far from the middle one runs are sought.
SHIFTS = 64
REACH = SHIFTS // 2 + MIN_WORDS
BLOCK = 256
#: Grams of fragments that one Arrow batch holds, 1 MB.
HELD = 1 << 18
#: Pairs of equal grams that a task orders at once.
PAIRS = 1 << 20
#: Anchors that a task lets meet at once.
MEETING = 1 << 16
_PLACE_BITS = 26
#: Bits of the grams of a run of equal ones, which ends with its block.
_RUN_BITS = 10
_PLACE = np.uint64((1 << _PLACE_BITS) - 1)
_SALT = np.random.default_rng(41).integers(1, 1 << 63, 1, dtype=np.uint64)[0]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each width consecutive values, by doubling."""
    have = 1
    while 2 * have <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return np.minimum(values[: len(values) - (width - have)], values[width - have :]) if have < width else values


def anchors(values: np.ndarray, width: int) -> np.ndarray:
    """Places of the smallest of each width consecutive values, where 0 ends a text. Of equal values the first is the smallest."""
    if len(values) < width:
        return np.zeros(0, np.int64)
    coded = np.where(values == 0, np.uint64(0), (values | np.uint64(1 << _PLACE_BITS)) & ~_PLACE) + np.arange(len(values), dtype=np.uint64) * (values > 0)
    least = sliding_min(coded, width)
    # Neighbouring frames mostly have the same smallest value.
    least = least[np.concatenate([[True], least[1:] != least[:-1]])]
    return np.unique((least[least > _PLACE] & _PLACE).astype(np.int64))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, data, offsets in steps(batch.column(0), batch.column(1)):
            words = Words(data, offsets)
            grams, valid = words.grams()
            # One value per word; the last words of each text, where no gram begins, are its end marks.
            c = anchors(np.where(valid, mixed(grams ^ _SALT) | np.uint64(1 << 63), np.uint64(0)), RUN)
            if not len(c):
                continue
            text = np.searchsorted(words.bounds, c, "right") - 1
            own, end = words.bounds[text], words.bounds[text + 1]
            hashes = np.concatenate([words.hashes, np.zeros(GRAM + 16, np.uint64)])
            sides = [np.zeros(len(c), np.uint64), np.zeros(len(c), np.uint64)]
            for side, places in enumerate(((c - 4, c - 8, c - 12), (c + GRAM, c + GRAM + 4, c + GRAM + 8))):
                told = np.zeros(len(c), np.uint64)
                for first, bits, at in zip(places, _BITS, _AT):
                    four = sum(hashes[np.maximum(first + m, 0)] * _COMBINE[m] for m in range(4))
                    # Beyond the text's end the words before it tell more bits of themselves.
                    told = mixed(np.where((first >= own) & (first + 4 <= end), four, told))
                    sides[side] |= told >> np.uint64(64 - bits) << np.uint64(at)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (grams[c].view(np.int64), ids.to_numpy(zero_copy_only=False)[text], (c - own).astype(np.int32), (end - GRAM - c).astype(np.int32), *(x.astype(np.uint32).view(np.int32) for x in sides))], _ANCHOR)


#: Hashes of three times four words on a side of an anchor, nearest first: bits, and the lowest one's place.
_BITS, _AT = (11, 11, 10), (0, 11, 22)
_ANCHOR = ["key", "doc", "c", "rest", "before", "after"]
_ANCHOR_SCHEMA = "key long, doc long, c int, rest int, before int, after int"
_MET_SCHEMA = _ANCHOR_SCHEMA + ", source long, s_c int, s_rest int"


def _same_words(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many times four words from the gram on are the same on one side, three at most."""
    differ, go, n = x ^ y, np.ones(len(x), bool), np.zeros(len(x), np.int8)
    for bits, at in zip(_BITS, _AT):
        go &= (differ >> np.int32(at)) & np.int32((1 << bits) - 1) == 0
        n += go
    return n


def _meeting(rows: list[np.ndarray], done: int, to: int, more: bool) -> pa.RecordBatch:
    """Pairs of rows done..to-1 with all earlier ones of their key, in large groups with the first, and if more is asked for the rows of these groups again, without source.

    What stands in one text alone has no pair, nor has any longer key that holds it.
    """
    key, doc, c, rest, before, after = rows
    begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    ends = np.append(begins[1:], len(key))
    sizes, alone = ends - begins, doc[begins] == doc[ends - 1]
    start, large, alone = (np.repeat(x, sizes) for x in (begins, sizes > NEAR + 1, alone))
    at = np.arange(done, to)
    at = at[~alone[at]]
    again = at[large[at]]
    ours, theirs = [again], [start[again]]
    for lag in range(1, NEAR + 1):
        i = at[(at - lag >= start[at]) & ~large[at]]
        ours.append(i)
        theirs.append(i - lag)
    ours, theirs = np.concatenate(ours), np.concatenate(theirs)
    good = doc[theirs] < doc[ours]
    ours, theirs = ours[good], theirs[good]
    # RUN equal grams around the gram are that many words beside it.
    good = _same_words(before[ours], before[theirs]) + _same_words(after[ours], after[theirs]) >= (RUN - 1) // 4
    ours, theirs = ours[good], theirs[good]
    again = again if more else again[:0]
    sources = [pa.concat_arrays([pa.array(x[theirs]), pa.nulls(len(again), pa.from_numpy_dtype(x.dtype))]) for x in (doc, c, rest)]
    both = np.concatenate([ours, again])
    return pa.RecordBatch.from_arrays([*(pa.array(x[both]) for x in rows), *sources], [*_ANCHOR, "source", "s_c", "s_rest"])


def _joined(rows: list[np.ndarray], more: list[list[np.ndarray]]) -> list[np.ndarray]:
    """rows and more, those of texts that are there twice once."""
    rows = [np.concatenate(x) for x in zip(rows, *more)]
    new = np.ones(len(rows[0]), bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in rows[:3]], axis=0)
    return [x[new] for x in rows]


def _meetings(batches: Iterator[pa.RecordBatch], more: bool = True) -> Iterator[pa.RecordBatch]:
    """Of rows in order of key, doc and c; a key's rows may come in several batches: all are kept until they are more than NEAR + 1 and of two texts, then its first and the NEAR last, which tell both."""
    rows = [np.zeros(0, t) for t in (np.int64, np.int64, np.int32, np.int32, np.int32, np.int32)]
    held, count, done = [], 0, 0
    for batch in batches:
        held.append([x.to_numpy(zero_copy_only=False) for x in batch.columns])
        count += batch.num_rows
        if count < MEETING:
            continue
        rows, held, count = _joined(rows, held), [], 0
        begin = int(np.searchsorted(rows[0], rows[0][-1]))
        told = len(rows[0]) - begin > NEAR + 1 and rows[1][begin] != rows[1][-1]
        yield _meeting(rows, done, len(rows[0]) if told else begin, more)
        keep = np.r_[begin, len(rows[0]) - NEAR : len(rows[0])] if told else np.arange(begin, len(rows[0]))
        rows, done = [x[keep] for x in rows], NEAR + 1 if told else 0
    rows = _joined(rows, held)
    if len(rows[0]) > done:
        yield _meeting(rows, done, len(rows[0]), more)


def _met(anchored: DataFrame, name: str, folder: str, more: bool = True) -> DataFrame:
    """(key, doc, c, rest, before, after, source, s_c, s_rest): pairs of anchors that meet, and without source, if more is asked for, the anchors of large groups."""
    rows = anchored.select(*_ANCHOR).repartition("key").sortWithinPartitions("key", "doc", "c")
    return landed(mapped(rows, partial(_meetings, more=more), _MET_SCHEMA), name, folder)


def _frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text and its spans (first, last): hash and place of the MIN_WORDS words that begin at each of first..last."""
    for batch in batches:
        spans, at = batch.column(2), 0
        where, (begin, end) = spans.offsets.to_numpy(), (spans.values.field(i).to_numpy() for i in (0, 1))
        for ids, data, offsets in steps(batch.column(0), batch.column(1)):
            words = Words(data, offsets)
            count = len(words.hashes)
            power, undo = powers(count + 1)
            total = np.zeros(count + 1, np.uint64)
            np.cumsum(words.hashes * power[:-1], out=total[1:])
            own = slice(where[at], where[at + len(ids)])
            lens = end[own] - begin[own] + 1
            text = np.repeat(np.repeat(np.arange(len(ids)), np.diff(where[at : at + len(ids) + 1])), lens)
            place = np.repeat(begin[own] - np.cumsum(lens) + lens, lens) + np.arange(lens.sum())
            first = words.bounds[text] + place
            frame = mixed((total[first + MIN_WORDS] - total[first]) * undo[first])
            at += len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(frame.view(np.int64)), pa.array(ids.to_numpy(zero_copy_only=False)[text]), pa.array(place.astype(np.int32))], ["frame", "doc", "at"])


def _exact(docs: DataFrame, large: DataFrame) -> DataFrame:
    """(doc, c, rest, source, s_c, s_rest) of the frames of MIN_WORDS words around anchors of large groups that an earlier text has: the first text that has it is the source."""
    width = MIN_WORDS - GRAM + 1
    first, last = F.greatest(F.lit(0), F.col("c") - (width - 1)), F.least(F.col("c"), F.col("c") + F.col("rest") - (width - 1))
    spans = large.select("doc", first.alias("first"), last.alias("last")).filter("first <= last")
    # Spans that meet are one.
    order = Window.partitionBy("doc").orderBy("first", "last")
    spans = spans.withColumn("new", (F.col("first") > F.coalesce(F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-2)) + 1).cast("int"))
    spans = spans.withColumn("n", F.sum("new").over(order)).groupBy("doc", "n").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    spans = landed(spans.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("first", "last")).alias("spans")), "frame-spans")
    frames = mapped(docs.join(spread(spans), "doc_id").select("doc_id", "text", "spans"), _frames, "frame long, doc long, at int")
    met = frames.withColumn("s", F.first(F.struct("doc", "at")).over(Window.partitionBy("frame").orderBy("doc", "at"))).filter("s.doc < doc")
    none = {x: F.lit(None).cast(t).alias(x) for x, t in (y.split() for y in _ANCHOR_SCHEMA.split(", "))}
    return met.select(none["key"], "doc", F.col("at").alias("c"), F.lit(width - 1).alias("rest"), none["before"], none["after"], F.col("s.doc").alias("source"), F.col("s.at").alias("s_c"), F.lit(width - 1).alias("s_rest"))


def _bounds(met: DataFrame) -> DataFrame:
    """(doc, source, slot, first, last, low, high): the anchors by pair and slot of SHIFTS shifts, and how far both texts go."""
    met = met.filter("source IS NOT NULL").withColumn("slot", F.floor((F.col("s_c") - F.col("c")) / SHIFTS).cast("int"))
    low, high = F.col("c") - F.least("c", F.col("s_c") + SHIFTS), F.col("c") + F.least("rest", F.col("s_rest") + SHIFTS)
    return met.groupBy("doc", "source", "slot").agg(F.min("c").alias("first"), F.max("c").alias("last"), F.min(low).alias("low"), F.max(high).alias("high"))


def candidates(docs: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """(doc, source, shift, lo, hi): grams lo..hi of doc may repeat grams of the earlier source that stand shift places on, or up to SHIFTS / 2 more or less.

    texts has the texts of docs, and may have others: what is read again by its doc_id is read from there.
    """
    # All pairs go to one folder, so they are read in one scan however many steps gave them.
    spark, folder = docs.sparkSession, shelf(docs.sparkSession, "met")
    met = _met(mapped(docs.filter("doc_id IS NOT NULL").select("doc_id", "text"), _windows, _ANCHOR_SCHEMA), "anchors", folder)
    large = met.filter("source IS NULL").select(*_ANCHOR)
    if not large.isEmpty():
        by_doc = Window.partitionBy("doc").orderBy("c", "key")
        # Near an unequal word the two texts have other anchors, so not only the next ones are paired.
        others = [F.lead("key", k).over(by_doc) for k in range(2, PAIRED + 1)]
        # A text that repeats itself has the same two grams more than once.
        more = large.select("key", "doc", "c", "rest", "before", "after", F.array_distinct(F.array_compact(F.array(*[F.xxhash64("key", F.lit(side), side) for side in ("before", "after")], *[F.when(x.isNotNull(), F.xxhash64("key", x)) for x in others]))).alias("keys"))
        more = more.withColumn("key", F.explode("keys"))
        landed(_exact(docs if texts is None else texts, large), "exact", folder)
        _met(more, "more", folder, more=False)
        chains, length = large, 1
        while not chains.isEmpty():
            # A chain is told by its two halves. Whether a group is large depends on its key alone, so equal chains have equal halves left.
            half = F.lead("key", length).over(by_doc)
            longer = chains.withColumn("half", half).filter("half IS NOT NULL").withColumn("key", F.xxhash64("key", "half"))
            met = _met(longer, f"chains-{length}", folder)
            chains, length = met.filter("source IS NULL").select(*_ANCHOR), 2 * length
    rows = _bounds(spark.read.schema(_MET_SCHEMA).option("recursiveFileLookup", True).parquet(folder))
    # Beyond its last anchors a passage can go on in runs of under RUN grams, over no more places than the anchors have.
    reach = F.col("last") - F.col("first") + SHIFTS
    return rows.select("doc", "source", (F.col("slot") * SHIFTS + SHIFTS // 2).alias("shift"), F.greatest("low", F.col("first") - reach).alias("lo"), F.least("high", F.col("last") + reach).alias("hi"))


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text and its requests (source, shift, lo, hi): gram slices by block of the source, at most about HELD grams at once; source = doc asks for blocks lo..hi, each with REACH more grams on both sides."""
    for batch in batches:
        at = 0
        for ids, data, offsets in steps(batch.column(0), batch.column(1)):
            words = Words(data, offsets)
            # The upper half of each hash: a wrong match needs equal halves at places in reach beside a run of true ones.
            grams = (words.grams()[0] >> np.uint64(32)).astype(np.uint32)
            out, lists, held = [], [], 0
            for i, doc in enumerate(ids.to_pylist()):
                own = grams[words.bounds[i] : words.bounds[i + 1]]
                own = own[: max(0, len(own) - GRAM + 1)]
                requests = batch.column(2)[at + i].values
                for source, shift, lo, hi in zip(*(requests.field(k).to_pylist() for k in range(4))):
                    for q in range(lo, hi + 1) if source == doc else range((lo + shift) // BLOCK, (hi + shift) // BLOCK + 1):
                        if source == doc:
                            out.append((True, doc, q, doc, 0, q * BLOCK))
                            lists.append(own[max(0, q * BLOCK - REACH) : max(0, (q + 1) * BLOCK + REACH)])
                        else:
                            first, last = max(lo + shift, q * BLOCK), min(hi + shift, (q + 1) * BLOCK - 1)
                            out.append((False, source, q, doc, shift, first))
                            lists.append(own[first - shift : last - shift + 1])
                        held += len(lists[-1])
                        if held >= HELD:
                            yield _fragment_rows(out, lists)
                            out, lists, held = [], [], 0
            at += len(ids)
            if out:
                yield _fragment_rows(out, lists)


def _fragment_rows(out: list[tuple], lists: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [*(pa.array(x, t) for x, t in zip(zip(*out), (pa.bool_(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32()))), pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lists)], dtype=np.int32)), pa.array(np.concatenate(lists).view(np.int32)))],
        ["is_source", "source", "block", "doc", "shift", "first", "grams"],
    )


def _equal_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, source, runs): runs of equal grams at shifts up to REACH from the one asked for, each a number of its place in doc, its place in the source and its grams."""
    for batch in batches:
        a, b = (batch.column(k).flatten().to_numpy().view(np.uint32).astype(np.int64) for k in ("theirs", "ours"))
        sizes = [batch.column(k).value_lengths().to_numpy() for k in ("theirs", "ours")]
        a_row, b_row = (np.repeat(np.arange(batch.num_rows), n) for n in sizes)
        a_at, b_at = (np.cumsum(n) - n for n in sizes)
        doc, source, block, asked, first = (batch.column(k).to_numpy().astype(np.int64) for k in ("doc", "source", "block", "shift", "first"))
        begins_at = np.maximum(0, block * BLOCK - REACH)
        a |= a_row << 32
        b |= b_row << 32
        order = np.argsort(a)
        a = a[order]
        begin = np.searchsorted(a, b)
        count = np.searchsorted(a, b, "right") - begin
        total = np.cumsum(count)
        # Texts of few words have many equal grams; of others these are one piece.
        at = 0
        while at < len(b):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
            to = len(b) if to >= len(b) else max(int(np.searchsorted(b_row, b_row[to])), int(np.searchsorted(b_row, b_row[at], "right")))
            n = count[at:to]
            ours = np.repeat(np.arange(at, to), n)
            theirs = order[np.repeat(begin[at:to] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            at = to
            row = b_row[ours]
            place = theirs - a_at[row]
            # By how much the shift is more than the least that counts.
            over = begins_at[row] + place - (first[row] + ours - b_at[row]) + REACH
            near = (over >= 0) & (over <= 2 * REACH)
            coded = np.sort((row[near] << 20) | (over[near] << 10) | place[near])
            if not len(coded):
                continue
            begins = np.flatnonzero(np.concatenate([[True], np.diff(coded) != 1]))
            n, coded = np.diff(np.append(begins, len(coded))), coded[begins]
            row, shift, place = coded >> 20, ((coded >> 10) & 1023) - REACH, coded & 1023
            place += begins_at[row]
            told = ((place - shift - asked[row]) << (_PLACE_BITS + _RUN_BITS)) | (place << _RUN_BITS) | n
            order_of = np.lexsort((told, source[row], doc[row]))
            row, told = row[order_of], told[order_of]
            pairs = np.concatenate([[True], (doc[row[1:]] != doc[row[:-1]]) | (source[row[1:]] != source[row[:-1]])])
            # Requests that overlap find the same runs.
            new = pairs | np.concatenate([[True], told[1:] != told[:-1]])
            row, told, pairs = row[new], told[new], np.flatnonzero(pairs[new])
            yield pa.RecordBatch.from_arrays([pa.array(doc[row[pairs]]), pa.array(source[row[pairs]]), pa.ListArray.from_arrays(pa.array(np.append(pairs, len(told)).astype(np.int32)), pa.array(told))], ["doc", "source", "runs"])


def held(spans: list[list[int]], runs: list) -> bool:
    """Whether one of the spans of words, apart and in order, has all words from the first to the last of the runs."""
    return within(spans, min(r[0] for r in runs), max(r[0] + r[2] for r in runs) + GRAM - 1)


def within(spans: list[list[int]], first: int, end: int) -> bool:
    """Whether one of the spans of words has words first..end-1."""
    k = bisect_right(spans, first, key=lambda x: x[0]) - 1
    return k >= 0 and spans[k][1] >= end


def hold(spans: list[list[int]], first: int, end: int) -> None:
    """Adds words first..end-1 to the spans."""
    a = bisect_left(spans, first, key=lambda x: x[1])
    b = bisect_right(spans, end, key=lambda x: x[0])
    spans[a:b] = [[min(first, spans[a][0]), max(end, spans[b - 1][1])] if a < b else [first, end]]


def chained(runs: list[tuple[int, int, int]], min_words: int = MIN_WORDS, similarity: float = SIMILARITY, spans: list[list[int]] | None = None) -> list[tuple[int, int, int, float]]:
    """(first word, end, source's first word, similarity) of passages in runs (first gram of doc, of source, grams) of one source.

    Every stretch from one run to a later one whose shared grams are at least similarity of all grams of both
    sides is a passage, and for each first run the longest such stretch is given. With t = similarity that
    is (1 + t) * shared >= t * (ours + theirs): runs count for it, gaps against, so a
    stretch holds where a running sum at its end is no less than at its beginning. Runs chain
    if both sides go on and shifts of neighbours (by shift) are at most MIN_WORDS apart.
    Passages within spans, which known passages cover, may be left out; new ones are added to spans.
    """
    spans = [] if spans is None else spans
    least = similarity * (min_words - GRAM + 1)
    if sum(n for *_, n in runs) < least:
        return []
    merged: list[list[int]] = []
    for f, s, n in sorted(runs, key=lambda x: (x[1] - x[0], x[0])):
        if merged and (last := merged[-1])[1] - last[0] == s - f and f <= last[0] + last[2]:
            last[2] = max(last[2], f + n - last[0])
        else:
            merged.append([f, s, n])
    groups: list[list[list[int]]] = []
    for run in merged:
        if groups and (run[1] - run[0]) - (groups[-1][-1][1] - groups[-1][-1][0]) <= MIN_WORDS:
            groups[-1].append(run)
        else:
            groups.append([run])
    out = []
    for group in groups:
        for part in _parts(group, least, similarity, spans):
            chain = _heaviest(part)
            gone = set(chain)
            chains = [[part[i] for i in chain]]
            for rest in _parts([r for i, r in enumerate(part) if i not in gone], least, similarity, []):
                chains += _nearest(rest)
            for chain in chains:
                if sum(r[2] for r in chain) >= least and not held(spans, chain):
                    for passage in _stretches(chain, min_words, similarity):
                        out.append(passage)
                        hold(spans, *passage[:2])
    return out


def _parts(runs: list[list[int]], least: float, t: float, spans: list[list[int]]) -> list[list[list[int]]]:
    """Runs in order, by the stretches of words that can hold a passage if each shared gram of ours counts, whatever its shift; none of stretches that spans have."""
    if sum(r[2] for r in runs) < least:
        return []
    runs = sorted(runs)
    f, _, n = np.array(runs, np.int64).T
    reach = np.maximum.accumulate(f + n)
    firsts = np.flatnonzero(np.concatenate([[True], f[1:] > reach[:-1]]))
    begin, end = f[firsts], reach[np.append(firsts[1:], len(f)) - 1]
    ends = np.cumsum((1 - t) * (end - begin) - t * np.concatenate([[0], begin[1:] - end[:-1]]))
    later = np.maximum.accumulate(ends[::-1])[::-1]
    last = len(end) - 1 - np.searchsorted(later[::-1], ends - (1 - t) * (end - begin) - 1e-9)
    wide = np.flatnonzero(end[last] - begin >= least / t - 1e-9)
    out: list[list[int]] = []
    for i, j in zip(firsts[wide].tolist(), np.append(firsts, len(f))[last[wide] + 1].tolist()):
        if out and i < out[-1][1]:
            out[-1][1] = max(out[-1][1], j)
        else:
            out.append([i, j])
    return [runs[i:j] for i, j in out if n[i:j].sum() >= least and not held(spans, runs[i:j])]


def _heaviest(runs: list[list[int]]) -> list[int]:
    """Places in runs (first, source's first, grams), in order, of the chain of most grams in which both sides go on."""
    ends = sorted(range(len(runs)), key=lambda i: runs[i][0] + runs[i][2])
    # Of the chains that have ended, by the source's end: those of more grams than any that ends before.
    where, weight, which, ended = [], [], [], 0
    total, before = [], []
    for f, s, n in runs:
        while ended < len(ends) and runs[j := ends[ended]][0] + runs[j][2] <= f:
            ended += 1
            end, w = runs[j][1] + runs[j][2], total[j]
            k = bisect_right(where, end)
            if k and weight[k - 1] >= w:
                continue
            k = k - 1 if k and where[k - 1] == end else k
            to = k
            while to < len(where) and weight[to] <= w:
                to += 1
            where[k:to], weight[k:to], which[k:to] = [end], [w], [j]
        k = bisect_right(where, s)
        total.append(n + (weight[k - 1] if k else 0))
        before.append(which[k - 1] if k else -1)
    at, taken = max(range(len(runs)), key=total.__getitem__), []
    while at >= 0:
        taken.append(at)
        at = before[at]
    return taken[::-1]


def _nearest(runs: list[list[int]]) -> list[list[list[int]]]:
    """Runs in order, each in one chain in which both sides go on: that of its own shift, else the one that ends nearest before it."""
    by_shift: dict[int, list[list[int]]] = {}
    ends: list[tuple[int, int, list]] = []
    for i, run in enumerate(runs):
        f, s, n = run
        chain = by_shift.get(s - f)
        if chain is None or chain[-1][1] - chain[-1][0] != s - f:
            k = bisect_right(ends, s, key=lambda x: x[0]) - 1
            chain = next((c for end, at, c in ends[max(0, k - 7) : k + 1][::-1] if c[-1][0] + c[-1][2] <= f and c[-1][1] + c[-1][2] == end), None)
        if chain is None:
            chain = []
        chain.append(run)
        by_shift[s - f] = chain
        insort(ends, (s + n, i, chain), key=lambda x: x[0])
    return list({id(c): c for *_, c in sorted(ends, key=lambda x: x[1])}.values())


def _stretches(chain: list[list[int]], min_words: int, t: float) -> list[tuple[int, int, int, float]]:
    """The longest stretch from each run of a chain, without those inside another."""
    if len(chain) == 1:
        ((f, s, n),) = chain
        return [(f, f + n + GRAM - 1, s, 1.0)] if n + GRAM - 1 >= min_words else []
    f, s, n = (np.array(x, np.int64) for x in zip(*chain))
    gap = np.concatenate([[0], (f[1:] - f[:-1] - n[:-1]) + (s[1:] - s[:-1] - n[:-1])])
    ends = np.cumsum((1 - t) * n - t * gap)
    begins = ends - (1 - t) * n
    # What the best of all later ends is falls along the chain, so the last one that is enough is found by halving.
    later = np.maximum.accumulate(ends[::-1])[::-1]
    last = len(n) - 1 - np.searchsorted(later[::-1], begins - 1e-9)
    shared, out, reach = np.concatenate([[0], np.cumsum(n)]), [], -1
    for i, j in enumerate(last.tolist()):
        if j > reach:
            reach, ours, theirs, both = j, int(f[j] + n[j] - f[i]), int(s[j] + n[j] - s[i]), int(shared[j + 1] - shared[i])
            if ours + GRAM - 1 >= min_words:
                out.append((int(f[i]), int(f[i]) + ours + GRAM - 1, int(s[i]), both / (ours + theirs - both)))
    return out


def telling(found: list[tuple]) -> list[tuple]:
    """As few of the passages (first, end, source, ...) of one text as cover all their words: from the left, each time the one that reaches farthest."""
    kept: list[tuple] = []
    rest = sorted(found, key=lambda x: (x[0], -x[1], x[2]))
    at, reach = 0, -1
    while at < len(rest):
        # The next uncovered word is at reach, or where the next passage begins.
        reach = max(reach, rest[at][0])
        best = rest[at]
        while at < len(rest) and rest[at][0] <= reach:
            best = max(best, rest[at], key=lambda x: x[1])
            at += 1
        if best[1] > reach:
            kept.append(best)
            reach = best[1]
    return kept


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        lists = batch.column(1)
        sources, runs = (lists.values.field(k) for k in range(2))
        sources, where, values, at = sources.to_numpy(), runs.offsets.to_numpy(), runs.values.to_numpy(), lists.offsets.to_numpy()
        for i, doc in enumerate(batch.column(0).to_pylist()):
            bounds = where[at[i] : at[i + 1] + 1]
            source, told = np.repeat(sources[at[i] : at[i + 1]], np.diff(bounds)), values[bounds[0] : bounds[-1]]
            order = np.lexsort((told, source))
            source, told = source[order], told[order]
            # Tasks with overlapping requests give the same runs.
            new = np.ones(len(told), bool)
            new[1:] = (source[1:] != source[:-1]) | (told[1:] != told[:-1])
            source, told = source[new], told[new]
            begin, first, n = told >> (_PLACE_BITS + _RUN_BITS), (told >> _RUN_BITS) & int(_PLACE), told & ((1 << _RUN_BITS) - 1)
            names, starts = np.unique(source, return_index=True)
            # No passage has fewer shared grams.
            shares = np.add.reduceat(n, starts)
            bounds = np.append(starts, len(source))
            spans, found = [], []
            # Those that share most first: what they cover need not be found in others again.
            for k in np.lexsort((names, -shares)).tolist():
                if shares[k] < SIMILARITY * (MIN_WORDS - GRAM + 1):
                    break
                own = slice(bounds[k], bounds[k + 1])
                if not within(spans, int(begin[own].min()), int((begin[own] + n[own]).max()) + GRAM - 1):
                    rows = zip(begin[own].tolist(), first[own].tolist(), n[own].tolist())
                    found += [(f, end, int(names[k]), start, score) for f, end, start, score in chained(list(rows), spans=spans)]
            out += [(doc, *x) for x in telling(found)]
        if out:
            yield _passage_rows(*zip(*out))


def _passage_rows(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.float64()))], ["doc_id", "start_word", "end_word", "source_doc_id", "source_start", "similarity"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts that an earlier document has as a whole."""
    for batch in batches:
        for doc, text, source in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            data = np.frombuffer((text.as_py() or "").encode(), np.uint8)
            n = len(Words(data, np.array([0, len(data)])).starts)
            if n >= MIN_WORDS:
                yield _passage_rows([doc], [0], [n], [source], [0], [1.0])


def _one_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text, digest) of rows (doc_id, text): of unlike texts of one doc_id only that of the smallest digest."""
    docs = docs.withColumn("digest", F.xxhash64("text"))
    told = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("digest").alias("least"), F.max("digest").alias("most"))
    unlike = landed(told.filter("least < most").select("doc_id", "least"), "unlike-texts")
    return docs.join(unlike, "doc_id", "left").filter("least IS NULL OR digest = least").select("doc_id", "text", "digest")


def repeated_passages(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, start_word, end_word, source_doc_id, source_start, similarity): words start..end-1 repeat those of the earlier source.

    All words of exact repeats are covered, and those of near ones that are found; where several sources have a stretch, the one that covers most of it is named.
    """
    return _found(_one_text(keyed(docs, text, key)))


def _found(docs: DataFrame) -> DataFrame:
    docs = docs.withColumn("check", F.crc32(F.col("text").cast("binary")))
    copied = docs.filter("doc_id IS NOT NULL").groupBy("digest", "check").agg(F.min("doc_id").alias("holder"), F.max("doc_id").alias("most"))
    # Both reads below need them, so they stay until the result is read.
    later = landed(copied.filter("holder < most").drop("most"), "copied-texts")
    told = docs.join(later, ["digest", "check"], "left")
    copies = told.filter("doc_id > holder").select("doc_id", "text", "holder")
    # Their lengths are exchanged, not their texts.
    whole = mapped(copies, _whole, _PASSAGE_SCHEMA).dropDuplicates(["doc_id"])
    return _near(told.filter("holder IS NULL OR doc_id = holder").select("doc_id", "text"), docs.select("doc_id", "text")).union(whole)


def _near(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """_found() of unlike texts. By doc_id they are read again from texts, which has copies too, so that these need not be told apart at each reading."""
    found = settled(docs.sparkSession, "passage-candidates", lambda: candidates(docs, texts))
    asked = F.struct("source", "shift", "lo", "hi")
    members = found.select("doc", asked.alias("w"))
    blocks = found.select("source", F.explode(F.sequence(F.floor((F.col("lo") + F.col("shift")) / BLOCK).cast("int"), F.floor((F.col("hi") + F.col("shift")) / BLOCK).cast("int"))).alias("q")).distinct()
    givers = blocks.select(F.col("source").alias("doc"), F.struct(F.col("source"), F.lit(0).alias("shift"), F.col("q").alias("lo"), F.col("q").alias("hi")).alias("w"))
    wanted = landed(members.union(givers).groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list("w").alias("wanted")), "wanted-fragments")
    # Rows repeated whole give their fragments once. Nothing stands between the join below and its exchanges, so Spark can split the blocks of a source that many texts repeat.
    once = texts.join(spread(wanted), "doc_id").groupBy("doc_id").agg(F.first("text").alias("text"), F.first("wanted").alias("wanted"))
    cut = landed(mapped(once, _fragments, "is_source boolean, source long, block int, doc long, shift int, first int, grams array<int>"), "fragments")
    given = cut.filter("is_source").select("source", "block", F.col("grams").alias("theirs"))
    taken = cut.filter("NOT is_source").select("source", "block", "doc", "shift", "first", F.col("grams").alias("ours"))
    runs = mapped(taken.join(given, ["source", "block"]).select("doc", "source", "shift", "first", "block", "theirs", "ours"), _equal_runs, "doc long, source long, runs array<long>")
    per_doc = runs.groupBy("doc").agg(F.collect_list(F.struct("source", "runs")).alias("runs"))
    return mapped(per_doc, _passages, _PASSAGE_SCHEMA)


_PASSAGE_SCHEMA = "doc_id long, start_word int, end_word int, source_doc_id long, source_start int, similarity double"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            texts = []
            for text, spans in zip(part.column(2), part.column(3)):
                data = np.frombuffer(text.as_py().encode(), np.uint8)
                words = Words(data, np.array([0, len(data)]))
                keep = np.ones(len(data), bool)
                starts = np.concatenate([words.starts, [len(data)]])
                for first, end in zip(*(spans.values.field(k).to_pylist() for k in range(2))):
                    keep[starts[first] : starts[min(end, len(starts) - 1)]] = False
                texts.append(data[keep].tobytes().decode())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["doc_id", "digest", "cut"])


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with every repeated passage cut from all but its first document; texts left without a word go.

    n_chars, where there is one, is set anew for the texts that changed.
    """
    own = _one_text(keyed(docs))
    spans = settled(docs.sparkSession, "spans", lambda: _found(own).groupBy("doc_id").agg(F.collect_set(F.struct("start_word", "end_word")).alias("spans")))
    once = own.join(spans, "doc_id").groupBy("doc_id").agg(F.first("digest").alias("digest"), F.first("text").alias("text"), F.first("spans").alias("spans"))
    cut = landed(mapped(once, _cut, "doc_id long, digest long, cut string"), "cut-texts")
    joined = docs.select(packed(docs), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("digest")).join(cut, ["doc_id", "digest"], "left")
    joined = joined.filter(F.col("cut").isNull() | F.col("cut").rlike(r"[^\x20\x09-\x0D]"))
    changed = {"text": F.coalesce("cut", "row.text"), "n_chars": F.when(F.col("cut").isNotNull(), F.length("cut").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return joined.select(*[changed.get(c, unpacked(c)).alias(c) for c in docs.columns])
