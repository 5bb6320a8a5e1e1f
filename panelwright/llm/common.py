"""Shared helpers: table reading, and words of Arrow text columns as flat numpy arrays.

Text is worked on as UTF-8 bytes.  One Arrow column becomes one byte array with
word bounds, so splitting and hashing cost a few vector passes and no Python step
per word.  Slices are cut by bytes, so memory does not depend on the batch size.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from panelwright.session import store  # noqa: F401  the operators take it from here

SLICE_BYTES = 1 << 20

#: White space as the contracts state it: blank and the controls 9 to 13.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

#: Everything ASCII but digits and lower-case letters.
NOT_WORD = np.zeros(256, dtype=bool)
NOT_WORD[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BYTE_CODE = np.random.default_rng(0x5EED).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOW = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, dtype=np.uint64))
_HIGH_STEP = int(_LOW[-1])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def remainder(doc_id: str, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; NULL ids hash as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(by))


def even_starts(rows: DataFrame, by: str, most: int) -> DataFrame:
    """The rows, their ``text`` cut so that a group by ``by`` holds ``most`` bytes about.

    Shorter texts stay whole and longer ones keep starts of one length, the largest
    that the bytes allow, so no row drops out because of another's length.
    """
    length = F.octet_length("text").cast("long")
    group = Window.partitionBy(by)
    order = group.orderBy(length, "place")
    before = F.coalesce(F.sum(length).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.count("*").over(group) - F.row_number().over(order) + 1
    found = rows.withColumn("_share", F.floor((F.lit(most) - before) / left)).withColumn("_level", F.max("_share").over(group).cast("int"))
    start = F.make_valid_utf8(F.substring(F.encode("text", "UTF-8"), F.lit(1), F.col("_level")).cast("string"))
    return found.withColumn("text", F.when(length <= F.col("_level"), F.col("text")).otherwise(start)).drop("_share", "_level")


_HELD: dict[Hashable, object] = {}


def remembered(key: Hashable, make: Callable[[], object]) -> object:
    """What ``make`` gives, remembered for the next tasks of this worker in place of what was held before.

    One worker serves the operators of a pipeline in turn, and the tables of all of
    them together would not fit beside its executor.
    """
    if key not in _HELD:
        let_go()
        _HELD[key] = make()
    return _HELD[key]


def let_go() -> None:
    """Give back the memory of what is held; costs nothing where nothing is."""
    if _HELD:
        _HELD.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        # the C library keeps freed blocks otherwise; not every one has this call
        getattr(ctypes.CDLL(None), "malloc_trim", lambda _: None)(0)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the bounds of its rows; NULL is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset: column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    bytes_ = np.frombuffer(data, dtype=np.uint8)[bounds[0]: bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return bytes_, bounds - bounds[0]


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a slice holds about ``most`` bytes of text, at least one row."""
    if not batch.num_rows:
        return
    lengths = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string()).fill_null("")
    ends = np.cumsum(np.diff(np.frombuffer(lengths.buffers()[1], dtype=np.int64)[lengths.offset: lengths.offset + len(lengths) + 1]))
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        yield batch.slice(at, upto - at)
        at = upto


def kept_rows(docs: DataFrame, decide: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows of whose ``text`` ``decide`` is true, all their columns unchanged; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(decide(part.column(part.schema.get_field_index("text")))))

    return docs.mapInArrow(run, docs.schema)


class Words:
    """Words of a text column, A-Z lower-cased unless told not to.

    ``start`` and ``end`` are byte bounds of all words, ``rows`` the bounds of each
    row in the list of words.
    """

    def __init__(self, column: pa.Array, separators: np.ndarray = SPACES, lower: bool = True):
        raw, self.bounds = flat(column)
        self.data = LOWER[raw] if lower else raw
        inside = ~separators[self.data]
        n = len(self.data)
        before, after = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[self.bounds[:-1][self.bounds[:-1] < n]] = False
        after[self.bounds[1:][self.bounds[1:] > 0] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.rows = np.searchsorted(self.start, self.bounds)
        self._inside = inside

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.rows)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word."""
        if not len(self):
            return np.zeros(0, np.uint64)
        lengths = self.end - self.start
        first = np.cumsum(lengths) - lengths
        place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
        codes = _BYTE_CODE[self.data[self._inside]] * _LOW[place & 4095]
        if int(lengths.max()) > 4096:
            high = np.cumprod(np.full(int(lengths.max()) // 4096 + 1, _HIGH_STEP, dtype=np.uint64))
            codes *= high[place >> 12]
        return mix(np.add.reduceat(codes, first) + lengths.astype(np.uint64))

    def text(self, i: int) -> str:
        return self.data[self.start[i]: self.end[i]].tobytes().decode("utf-8", "replace")


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of ``width`` consecutive words per row, and the rows' bounds.

    A row of fewer words has its whole sequence as one shingle, a row without words none.
    """
    h, counts = words.hashes(), words.counts()
    rows = len(counts)
    n = len(h)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    combined = np.zeros(n, np.uint64)
    for k in range(width):
        combined[: n - k] = mix(combined[: n - k] * np.uint64(0xD6E8FEB86659FD93) + h[k:])
    row = words.row_of()
    position = np.arange(n) - words.rows[row]
    keep = position <= counts[row] - width
    out, of = combined[keep], row[keep]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for j, r in enumerate(short):
            x = np.uint64(0)
            with np.errstate(over="ignore"):
                for v in h[words.rows[r]: words.rows[r + 1]]:
                    x = mix(np.array([x * np.uint64(0xD6E8FEB86659FD93) + v]))[0]
            whole[j] = x + np.uint64(counts[r])
        out, of = np.concatenate([out, whole]), np.concatenate([of, short])
    order = np.lexsort((out, of))
    out, of = out[order], of[order]
    new = np.ones(len(out), dtype=bool)
    new[1:] = (out[1:] != out[:-1]) | (of[1:] != of[:-1])
    out, of = out[new], of[new]
    return out, np.searchsorted(of, np.arange(rows + 1))
