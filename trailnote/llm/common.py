"""What the training-data operators share: shared-folder tables and byte-level word scanning.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``. In UTF-8 those six byte
values only ever stand for themselves, so scanning bytes gives the same words as
scanning characters.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

WHITE_SPACE = r"\x20\x09-\x0D"
WORD = "[^" + WHITE_SPACE + "]+"
GRAM = 5
#: Bytes of text that one vectorised step handles; a longer text is a step of its own.
STEP_BYTES = 1 << 18
#: Bytes that are hashed at once.
SPAN = 1 << 16
#: Rows that Spark hands to a Python stage at once. Texts are long: Spark's own 10,000 would be 30 to 60 MB a task on either side.
BATCH_ROWS = 1000
#: Bytes of such a batch; a larger row is a batch of its own. Blocks of vectors with their queries are some hundred KB a row, of which Spark's own 64 MB would be held on either side.
BATCH_BYTES = 8 << 20

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_BASE = int(_rng.integers(1 << 62, 1 << 63, dtype=np.uint64) | np.uint64(1))
_UNBASE = pow(_BASE, -1, 1 << 64)
_POWER, _UNDO = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(2 * SPAN, x, np.uint64)])) for x in (_BASE, _UNBASE))
_COMBINE = _rng.integers(1 << 62, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.gettempdir()}/checkpoints"
    return found


#: Paths that landed() wrote in the innermost scratch(), None outside of any.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def shelf(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder: of a table, or of several of one schema that are read together."""
    path = f"{shared_dir(spark)}/trailnote-{name}-{uuid.uuid4().hex}"
    written = _written.get()
    if written is not None:
        written.append(path)
    return path


def landed(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """df written as Parquet in the shared folder (or in a shelf() of it) and read again: cuts the lineage and gives the planner true sizes."""
    spark = df.sparkSession
    path = f"{folder}/{name}" if folder else shelf(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df for a join by exchange: it grows with the input, so it shall not pass the driver as a broadcast while its files are still small enough for one."""
    return df.hint("merge")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that landed() writes inside are deleted at the end; nothing that reads them may leave the block."""
    mark = _written.set([])
    try:
        yield
    finally:
        paths = _written.get()
        _written.reset(mark)
        for path in paths:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def settled(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """build()'s rows landed; the tables that it landed on the way are deleted, as nothing else needs them."""
    outer = _written.get()
    with scratch(spark):
        out = landed(build(), name)
        path = _written.get().pop()
    if outer is not None:
        outer.append(path)
    return out


def mapped(df: DataFrame, function: Callable, schema: str | StructType) -> DataFrame:
    """df through a Python stage on Arrow batches of at most BATCH_ROWS rows and about BATCH_BYTES (settings of the session, which this sets)."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            give_back()

    return df.mapInArrow(task, schema)


def give_back() -> None:
    """Returns freed memory to the system: Python workers are used again, and else keep the largest step of any stage before."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def steps(ids: pa.Array, texts: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(ids, bytes, offsets) of consecutive rows, about STEP_BYTES at a time. Null texts are empty."""
    if len(texts) == 0:
        return
    if texts.null_count:
        texts = texts.fill_null("")
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + STEP_BYTES, "right")) - 1)
        yield ids.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """The first count powers of the hash base, and of its inverse."""
    if count <= len(_POWER):
        return _POWER[:count], _UNDO[:count]
    out = []
    for base in (_BASE, _UNBASE):
        x = np.full(count, base, np.uint64)
        x[0] = 1
        out.append(np.cumprod(x))
    return tuple(out)


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte run starts..ends-1 by the bytes' codes, SPAN bytes at a time, so a long text needs no more than a short one."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(starts, base + SPAN - 1, "right")))
        power, undo = powers(int(ends[at:to].max() - base) + 1)
        total = np.zeros(len(power), np.uint64)
        np.cumsum(codes[data[base : base + len(power) - 1]] * power[:-1], out=total[1:])
        own = starts[at:to] - base
        out[at:to] = mixed((total[ends[at:to] - base] - total[own]) * undo[own] + np.uint64(salt))
        at = to
    return out


class Words:
    """Words of a run of texts: start and end bytes, 64-bit hashes, and for each text its first word's place."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True):
        inside = _IS_WORD[data]
        firsts = offsets[:-1][offsets[:-1] < len(data)]
        lasts = offsets[1:][offsets[1:] > 0] - 1
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        begins[firsts] = inside[firsts]
        ends[:-1] &= ~inside[1:]
        ends[lasts] = inside[lasts]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        self.hashes = run_hashes(data, self.starts, self.ends, _LOWER if lower else _BYTE)

    def grams(self, n: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, valid) by the gram's first word; not valid where n words would pass the text's end."""
        count = len(self.hashes)
        out = np.zeros(count, np.uint64)
        for k in range(min(n, count)):
            out[: count - k] += self.hashes[k:] * _COMBINE[k]
        room = np.repeat(self.bounds[1:], np.diff(self.bounds)) - np.arange(count)
        return mixed(out), room >= n

    def whole(self, i: int) -> np.uint64:
        """One hash for the whole word sequence of text i, other than any gram's."""
        own = self.hashes[self.bounds[i] : self.bounds[i + 1]]
        return mixed(np.array([np.sum(own * _COMBINE[40 : 40 + len(own)]) + np.uint64(len(own))], np.uint64))[0]


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts one after the other, bounds). Under five words: the sequence as one shingle."""
    words = Words(data, offsets)
    grams, valid = words.grams()
    sets, sizes = [], np.zeros(len(offsets), np.int64)
    for i, (a, b) in enumerate(zip(words.bounds[:-1], words.bounds[1:])):
        if b - a >= GRAM:
            own = np.unique(grams[a : b - GRAM + 1])
        elif b > a:
            own = np.array([words.whole(i)], np.uint64)
        else:
            continue
        sets.append(own)
        sizes[i + 1] = len(own)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.cumsum(sizes)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def packed(docs: DataFrame, without: str | None = None) -> Column:
    """docs' columns (but one) as the struct row: Python stages then see no names that clash or hold dots."""
    return F.struct(*[F.col(quoted(c)) for c in docs.columns if c != without]).alias("row")


def unpacked(name: str) -> Column:
    return F.col(f"row.{quoted(name)}").alias(name)


def keyed(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Only key and text, under fixed names, so that extra or clashing columns do not matter."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
