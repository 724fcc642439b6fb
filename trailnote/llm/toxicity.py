"""Toxicity by a classifier chain.

Categories are predicted one after another by linear models on presence of hashed words and word stems and a
few shape measures; each later model also gets the earlier categories' probabilities. In
training these come out of fold, so a later model learns how far to trust an earlier one
on texts it has not seen. Folds go by the smallest word hash, which keeps most near copies
of a text together.

The models are fitted on at most SAMPLE labelled texts and FEATURES features a class of the
last category, the smallest by a hash of doc_id, weighted back to the classes' true shares.
That bound is the only one: every document is scored on its whole text, in the executors,
with weights of fixed size (2**BITS numbers a category). Each fold's model and the final one
is fitted by a task of its own; the driver gets two fitted models and one probability a
sampled text. A category of one class only has a constant model.

Decision: a document is rejected if the last category's probability reaches a threshold
fitted on out-of-fold probabilities, the one of greatest F-score with weight BETA on recall
(under 1: precision counts more), never under LEAST; nothing is rejected where less than
PRECISE of the rejected would be right.

Defined cases: null, empty or blank text has no words and is kept; with fewer
than FEWEST labelled texts of either class nothing is rejected; labels repeated whole count once; of unlike labels of one doc_id the larger holds; of
unlike texts of one doc_id one, the smallest by its features, is fitted on, and each is scored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trailnote.llm.common import _LOWER, landed, mapped, mixed, packed, run_hashes, scratch, steps, unpacked

CATEGORIES = ("low_quality", "toxic")
SAMPLE = 4000
#: Features (four bytes each) of the labelled texts of a class that models are fitted on, which bounds their bytes: 32 MB for both.
FEATURES = 4 << 20
BITS = 18
FOLDS = 3
ROUNDS = 80
PENALTY = 1e-3
BETA = 0.5
LEAST = 0.3
PRECISE = 0.6
FEWEST = 8
SHAPES = 6
#: Bytes of a longer word that count as its stem.
STEM = 5

_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_KIND = np.zeros((4, 256), np.int64)
_KIND[0, [ord(c) for c in "#*$%&|<>"]] = 1
_KIND[1, 65:91] = 1
_KIND[2, 48:58] = 1
_KIND[3, [ord("!"), ord("?")]] = 1


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature numbers, their bounds by text, shapes): which hashed words and stems a text has, each once."""
    inside = _ALNUM[data]
    begins, ends = inside.copy(), inside.copy()
    firsts, lasts = offsets[:-1][offsets[:-1] < len(data)], offsets[1:][offsets[1:] > 0] - 1
    begins[1:] &= ~inside[:-1]
    begins[firsts] = inside[firsts]
    ends[:-1] &= ~inside[1:]
    ends[lasts] = inside[lasts]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    kept = lambda stops, salt: (run_hashes(data, starts, stops, _LOWER, salt) >> np.uint64(64 - BITS)).astype(np.int64)
    bounds = np.searchsorted(starts, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    stems = stops - starts > STEM
    once = np.unique(np.concatenate([text << BITS | kept(stops, 0), text[stems] << BITS | kept(np.minimum(stops, starts + STEM), 1)[stems]]))
    own = np.searchsorted(once, np.arange(len(offsets)) << BITS)
    size, words = np.maximum(np.diff(offsets), 1), np.maximum(np.diff(bounds), 1)
    shares = [np.diff(np.concatenate([[0], np.cumsum(kind[data])])[offsets]) / size for kind in _KIND]
    shapes = np.stack([*(np.minimum(1, 10 * x) for x in shares), np.diff(own) / words, np.log1p(words) / 10], 1)
    return once & ((1 << BITS) - 1), own, shapes.astype(np.float32)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sums(w: np.ndarray, numbers: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(numbers) + 1)
    np.cumsum(w[numbers], dtype=np.float64, out=total[1:])
    return np.diff(total[bounds])


class Linear:
    """Logistic regression on presence features and dense columns, by Adam on all rows at once."""

    def __init__(self, numbers, bounds, dense, target, weight):
        self.w, self.d, self.b = np.zeros(1 << BITS, np.float32), np.zeros(dense.shape[1], np.float32), 0.0
        share = float((target * weight).sum() / max(weight.sum(), 1e-9))
        if not 0 < share < 1:
            self.b = -30.0 if share <= 0 else 30.0
            return
        df = np.bincount(numbers, minlength=1 << BITS)
        seen = np.flatnonzero(df)
        place, df = (np.cumsum(df > 0, dtype=np.int32) - 1)[numbers], df[seen]
        row = np.repeat(np.arange(len(target), dtype=np.int32), np.diff(bounds))
        n, m = len(seen), dense.shape[1]
        # Features are scaled by their smoothed log count ratio, so words that tell the classes apart in many texts are cheap to use.
        # Words of one text only can just be learnt by heart: they get no weight.
        positive = np.bincount(place, target[row], n)
        ratio = np.log((positive + 1) / (target.sum() + 2)) - np.log((df - positive + 1) / ((1 - target).sum() + 2))
        scale = np.where(df > 1, ratio, 0.0)
        value = scale[place]
        x = np.zeros(n + m + 1)
        x[-1] = np.log(share / (1 - share))
        first, second = np.zeros_like(x), np.zeros_like(x)
        weight = weight / weight.sum()
        for t in range(1, ROUNDS + 1):
            z = _sums(x[:n] * scale, place, bounds) + dense @ x[n : n + m] + x[-1]
            slope = weight * (_logistic(z) - target)
            g = np.concatenate([np.bincount(place, value * slope[row], n), dense.T @ slope, [slope.sum()]])
            g[: n + m] += PENALTY * x[: n + m]
            first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
            x -= 0.1 * (1 - t / (ROUNDS + 1)) * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-5)
        self.w[seen], self.d, self.b = x[:n] * scale, x[n : n + m].astype(np.float32), float(x[-1])

    def probability(self, numbers, bounds, dense) -> np.ndarray:
        return _logistic(_sums(self.w, numbers, bounds) + dense @ self.d + self.b)


class Chain:
    """Fitted models in order, with the threshold on the last category."""

    def __init__(self, models: list[Linear], threshold: float):
        self.models, self.threshold = models, threshold

    def probabilities(self, numbers, bounds, dense) -> list[np.ndarray]:
        out = []
        for model in self.models:
            p = model.probability(numbers, bounds, dense)
            out.append(p)
            dense = np.concatenate([dense, p[:, None].astype(np.float32)], 1)
        return out


def threshold(p: np.ndarray, target: np.ndarray, weight: np.ndarray) -> float:
    """Between the last probability that is still rejected and the next, where the F-score is greatest; out of reach where less than PRECISE of the rejected would be right."""
    if not target.any():
        return 2.0
    order = np.argsort(-p, kind="stable")
    hits, all_ = np.cumsum((target * weight)[order]), np.cumsum(weight[order])
    score = (1 + BETA**2) * hits / (BETA**2 * (target * weight).sum() + all_)
    at = int(score.argmax())
    if hits[at] < PRECISE * all_[at]:
        return 2.0
    below = p[order[at + 1]] if at + 1 < len(p) else 0.0
    return max(LEAST, float((p[order[at]] + below) / 2))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, data, offsets in steps(batch.column(0), batch.column(1)):
            numbers, bounds, shapes = features(data, offsets)
            own = [numbers[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
            folds = [int(mixed(x.astype(np.uint64) + np.uint64(5)).min() % np.uint64(FOLDS)) if len(x) else 0 for x in own]
            yield pa.RecordBatch.from_arrays([ids, pa.array(folds, pa.int32()), pa.array(map(len, own), pa.int64()), pa.array([x.astype("<i4").tobytes() for x in own], pa.binary()), pa.array([x.tobytes() for x in shapes], pa.binary())], _FEATURED)


_FEATURED = ["doc_id", "own_fold", "n_features", "numbers", "shapes"]


def _fit(table: pa.Table) -> pa.Table:
    """One model of one category: without the texts of its fold, whose probabilities it gives, or on all texts, and then it gives itself."""
    rows = table.sort_by("doc_id")
    del table
    fold, ids, own = rows["fold"][0].as_py(), rows["doc_id"].to_numpy(), rows["own_fold"].to_numpy()
    texts = [np.frombuffer(x.as_py(), "<i4") for x in rows["numbers"]]
    numbers, sizes = np.concatenate(texts), np.array([len(x) for x in texts])
    del texts
    dense = np.concatenate([np.stack([np.frombuffer(x.as_py(), np.float32) for x in rows["shapes"]]), np.array(rows["earlier"].to_pylist(), np.float32).reshape(len(rows), -1)], 1)
    target, weight, row = rows["target"].to_numpy().astype(float), rows["weight"].to_numpy(), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    del rows
    cut = lambda some: (numbers[some[row]], np.concatenate([[0], np.cumsum(sizes[some])]), dense[some])
    held = own == fold
    if fold < FOLDS:
        p = Linear(*cut(~held), target[~held], weight[~held]).probability(*cut(held)) if not held.all() else np.zeros(held.sum())
        return pa.table([pa.array(ids[held], pa.int64()), pa.array(p, pa.float64()), pa.nulls(len(p), pa.binary())], ["doc_id", "p", "model"])
    return pa.table([pa.nulls(1, pa.int64()), pa.nulls(1, pa.float64()), pa.array([pickle.dumps(Linear(*cut(~held), target, weight))], pa.binary())], ["doc_id", "p", "model"])


def sampled(docs: DataFrame, labels: DataFrame, totals: dict[int, int], sample: int, most_features: int) -> DataFrame:
    """(doc_id, toxic, low_quality, own_fold, numbers, shapes) of the texts to fit on, a bounded table."""
    chosen = None
    for toxic in totals:
        part = labels.filter(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.union(part)
    # At most 2 * sample rows of three numbers: a proven bound.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen.select("doc_id")), "doc_id")
    rows = mapped(texts.select("doc_id", "text"), _featured, "doc_id long, own_fold int, n_features long, numbers binary, shapes binary")
    rows = landed(rows.join(F.broadcast(chosen), "doc_id"), "labelled-texts").groupBy("doc_id").agg(F.min(F.struct("toxic", "low_quality", "own_fold", "n_features", "numbers", "shapes")).alias("r")).select("doc_id", "r.*")
    so_far = F.sum("n_features").over(Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    return landed(rows.withColumn("so_far", so_far).filter(F.col("so_far") <= most_features).drop("so_far", "n_features"), "toxicity-sample")


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_features: int = FEATURES) -> Chain:
    """A chain fitted on at most sample labelled documents with and as many without the last category, and at most most_features features of either."""
    with scratch(docs.sparkSession):
        return _fitted(docs, labels, sample, most_features)


def _fitted(docs: DataFrame, labels: DataFrame, sample: int, most_features: int) -> Chain:
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"), F.coalesce(F.max(1 - F.col("quality")), F.lit(0)).cast("int").alias("low_quality")).filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
    totals = dict(marks.groupBy("toxic").count().collect())
    if not totals:
        return Chain([], 2.0)
    rows = sampled(docs, marks, totals, sample, most_features)
    seen = dict(rows.groupBy("toxic").count().collect())
    if min(seen.get(0, 0), seen.get(1, 0)) < FEWEST:
        return Chain([], 2.0)
    weight = F.create_map(*[F.lit(x) for t in seen for x in (t, totals[t] / seen[t])])[F.col("toxic")]
    rows = rows.withColumns({"weight": weight, "earlier": F.array().cast("array<double>")})
    models = []
    for category in CATEGORIES:
        # A task for each model; each of them gets the bounded table once.
        each = rows.withColumn("target", F.col(category)).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(FOLDS)))).repartitionByRange(FOLDS + 1, "fold")
        got = landed(each.groupBy("fold").applyInArrow(_fit, "doc_id long, p double, model binary"), f"fitted-{category}")
        models.append(pickle.loads(got.filter("model IS NOT NULL").first().model))
        outside = got.filter("model IS NULL").select("doc_id", "p")
        rows = rows.join(outside, "doc_id").withColumn("earlier", F.concat("earlier", F.array("p"))).drop("p")
    last = rows.select("doc_id", F.element_at("earlier", -1).alias("p"), F.col(CATEGORIES[-1]).alias("target"), "weight").orderBy("doc_id").collect()
    p, target, weight = (np.array([r[k] for r in last], float) for k in ("p", "target", "weight"))
    return Chain(models, threshold(p, target, weight))


def scored(docs: DataFrame, chain: Chain, keep_row: bool = False) -> DataFrame:
    """(doc_id, p_low_quality, p_toxic, rejected), with keep_row also the whole row as a struct. Without models p is 0."""
    least, models = chain.threshold, bool(chain.models)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, texts = 0, batch.column(1).flatten()[place].cast(pa.string()) if keep_row else batch.column(1)
            for ids, data, offsets in steps(batch.column(0), texts):
                numbers, bounds, shapes = features(data, offsets)
                found = chain.probabilities(numbers, bounds, shapes) if models else [np.zeros(len(ids))] * len(CATEGORIES)
                rest = [batch.column(1).slice(at, len(ids))] if keep_row else []
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(p, pa.float64()) for p in found), pa.array((found[-1] >= least) & (np.diff(bounds) > 0)), *rest], names)
                at += len(ids)

    names = ["doc_id", "p_low_quality", "p_toxic", "rejected", *(["row"] if keep_row else [])]
    # The text goes to Python once, as a field of the row where the row is kept.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), packed(docs) if keep_row else F.col("text").cast("string").alias("text"))
    schema = StructType().add("doc_id", "long").add("p_low_quality", "double").add("p_toxic", "double").add("rejected", "boolean")
    return mapped(rows, run, schema.add("row", rows.schema["row"].dataType) if keep_row else schema)


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the chain does not reject. Fitted on the labelled ones among docs."""
    kept = scored(docs, fitted(docs, labels), keep_row=True).filter("NOT rejected")
    return kept.select(*[unpacked(c) for c in docs.columns])
