"""Language-model scores from a log-frequency Bloom filter.

N-gram counts of the training documents are quantised to powers of two, and an
n-gram of count c is put into a Bloom filter once for each level up to
1 + floor(log2 c).  A worker asks level after level until the first miss, which
gives the count back within its power of two.  The filter is broadcast and built in
segments by the tasks that merge the counts; each segment has the bits that its own
n-grams and levels need for the error rate ``RATE``.  All pairs are
stored, also those that occur once.

Counting: tasks sum what they read, then send sorted, delta-coded blocks per hash
range, so a range is merged from a few arrays instead of one row per n-gram, and a
frequent n-gram is one entry per task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from panelwright.llm.common import Words, mix, read, remainder, slices, store

#: Probes per level, share of false hits at a level, the bits that an n-gram then needs at each, and the least count of a stored pair.
PROBES, RATE, LEAST_PAIR = 3, 0.01, 1
BITS_EACH = -PROBES / np.log1p(-(RATE ** (1 / PROBES)))
LEVELS = 40
#: Segments have a multiple of so many bits.
LEAST_SEGMENT = 64
#: At most so many of the most frequent words have their exact counts at hand in every task; the others are joined.
HEAD = 1 << 18
#: Share of a pair's relative frequency in a token's probability; the rest is the word's own.
PAIR_SHARE = 0.25
END = mix(np.array([0xE0D], np.uint64))[0]
_PAIR = np.uint64(0xD6E8FEB86659FD93)
#: Hashes with counts, words and pairs together, that a task holds before it sums them; it changes no count.
FLUSH = 1_500_000


def tokens(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, hash of the pair with the token before, row bounds) of all tokens, each row closed by the end token.

    The first token's pair is with the end token of a text before it.
    """
    h = np.insert(words.hashes(), words.rows[1:], END)
    bounds = words.rows + np.arange(len(words.rows))
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[bounds[:-1]] = END
    with np.errstate(over="ignore"):
        return h, mix(before * _PAIR + h), bounds


def _packed(values: np.ndarray) -> bytes:
    """Eight byte planes, so that the zeros of small numbers lie together for the shuffle's compression."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel().astype(np.uint64)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def ngram_counts(texts: DataFrame, ranges: int) -> DataFrame:
    """(range, kind, keys, counts): blocks of sorted hashes; kind 1 words, 2 pairs; a range is the hash's top bits."""
    shift = np.uint64(64 - (ranges.bit_length() - 1))

    def blocks(kind: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys, counts = _summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        at = np.searchsorted(keys >> shift, np.arange(ranges + 1, dtype=np.uint64))
        rows = []
        for r in np.flatnonzero(np.diff(at)):
            own = keys[at[r]: at[r + 1]]
            rows.append((int(r), kind, _packed(np.diff(own, prepend=np.uint64(0))), _packed(counts[at[r]: at[r + 1]])))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["range", "kind", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {1: [], 2: []}
        size = {1: 0, 2: 0}
        for batch in batches:
            for part in slices(batch):
                h, pairs, _ = tokens(Words(part.column(0)))
                for kind, keys in ((1, h), (2, pairs)):
                    keys, n = np.unique(keys, return_counts=True)
                    held[kind].append((keys, n.astype(np.int64)))
                    size[kind] += len(keys)
                if sum(size.values()) > FLUSH:
                    for kind, parts in held.items():
                        # what is still large once it is summed goes on, the rest stays
                        keys, n = _summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
                        held[kind], size[kind] = [(keys, n)], len(keys)
                        if len(keys) > FLUSH // 4:
                            yield blocks(kind, held[kind])
                            held[kind], size[kind] = [], 0
        for kind, parts in held.items():
            if parts:
                yield blocks(kind, parts)

    return texts.select("text").mapInArrow(run, "range long, kind int, keys binary, counts binary")


def level(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64)


def _bits(keys: np.ndarray, lev: np.ndarray | int, probe: int, kind: int, segment: np.ndarray) -> np.ndarray:
    """Place of a probe inside its segment, whose bits are given; the segment is the hash's range."""
    with np.errstate(over="ignore"):
        salt = np.uint64(kind * 1000 + probe) * np.uint64(0x9E3779B97F4A7C15)
        return (mix(keys ^ mix(np.asarray(lev, np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + salt)) % segment).astype(np.int64)


def _segment_of(ranges: int, bits: int | None, least: int):
    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        stored = []
        words, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for kind in (1, 2):
            part = pdf[pdf["kind"] == kind]
            if not len(part):
                continue
            keys, n = _summed(np.concatenate([np.cumsum(_unpacked(k)) for k in part["keys"]]), np.concatenate([_unpacked(c) for c in part["counts"]]).astype(np.int64))
            if kind == 1:
                words, counts = keys, n
            else:
                keys, n = keys[n >= least], n[n >= least]
            stored.append((kind, keys, level(n)))
        need = sum(int(top.sum()) for *_, top in stored) * BITS_EACH
        own = np.zeros(bits // ranges if bits else LEAST_SEGMENT * (1 + int(need // LEAST_SEGMENT)), dtype=bool)
        for kind, keys, top in stored:
            for lev in range(1, int(top.max()) + 1 if len(top) else 1):
                keys, top = keys[top >= lev], top[top >= lev]
                for probe in range(PROBES):
                    own[_bits(keys, lev, probe, kind, np.uint64(len(own)))] = True
        return pd.DataFrame({"range": [key[0]], "bits": [np.packbits(own).tobytes()], "words": [words.view(np.int64)], "counts": [counts]})

    return merge


@dataclass
class Filter:
    """The filter with the totals that the smoothing needs, and exact counts of the most frequent words."""

    bits: np.ndarray
    starts: np.ndarray
    total: int
    kinds: int
    head: np.ndarray
    head_counts: np.ndarray

    def count(self, keys: np.ndarray, kind: int) -> np.ndarray:
        """Estimated counts: the middle of the last level found, 0 without a first."""
        out = np.zeros(len(keys))
        segment = (keys >> np.uint64(64 - ((len(self.starts) - 1).bit_length() - 1))).astype(np.int64)
        start, size = self.starts[segment], np.diff(self.starts)[segment].astype(np.uint64)
        left = np.arange(len(keys))
        for lev in range(1, LEVELS):
            for probe in range(PROBES):
                at = start[left] + _bits(keys[left], lev, probe, kind, size[left])
                hit = (self.bits[at >> 3] >> (np.uint8(7) - (at & 7).astype(np.uint8))) & 1
                left = left[hit.astype(bool)]
            if not len(left):
                break
            out[left] = 1.0 if lev == 1 else 1.5 * 2.0 ** (lev - 1)
        return out

    def log_probability(self, h: np.ndarray, pairs: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """log10 of every token given the one before, the pair's share interpolated with the word's."""
        kinds, which = np.unique(h, return_inverse=True)
        counts = self.count(kinds, 1)
        word = (counts[which] + 0.5) / (self.total + 0.5 * (self.kinds + 1))
        context = np.empty(len(h))
        context[1:] = counts[which][:-1]
        end = self.count(np.array([END]), 1)[0]
        context[bounds[:-1]] = end
        pair = np.minimum(self.count(pairs, 2), context)
        return np.log10(PAIR_SHARE * pair / np.maximum(context, 1) + (1 - PAIR_SHARE) * word)


def _least_frequent(counts: DataFrame, most: int = HEAD) -> int:
    """The smallest count from which on there are at most ``most`` words, by a histogram of sixteenths of a power of two."""
    step = F.floor(F.log2("c") * 16)
    floor = 1 << 62
    found = 0
    for row in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("c").alias("c")).orderBy(F.desc("step")).collect():
        found += row["n"]
        if found > most:
            break
        floor = row["c"]
    return floor


def train(texts: DataFrame, bits: int | None = None, least: int = LEAST_PAIR) -> tuple[Filter, DataFrame]:
    """The filter, of as many bits as its n-grams need unless told, and the exact counts (h, c) of all words."""
    spark = texts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = 1 << max(8, (4 * parts - 1).bit_length())
    merged = ngram_counts(texts, ranges).groupBy("range").applyInPandas(
        _segment_of(ranges, bits, least), "range long, bits binary, words array<long>, counts array<long>")
    merged = store(merged)
    counts = merged.select(F.explode(F.arrays_zip(F.col("words").alias("h"), F.col("counts").alias("c"))).alias("x")).select("x.h", "x.c")
    total = counts.agg(F.sum("c"), F.count("*")).first()
    head = counts.filter(F.col("c") >= _least_frequent(counts)).toPandas()
    keys = head["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    size = np.full(ranges, LEAST_SEGMENT // 8)
    for row in merged.select("range", F.octet_length("bits").alias("size")).collect():
        size[row["range"]] = row["size"]
    starts = np.concatenate([[0], np.cumsum(size)])
    filled = np.zeros(starts[-1], np.uint8)
    for row in merged.select("range", "bits").toLocalIterator():
        filled[starts[row["range"]]: starts[row["range"] + 1]] = np.frombuffer(row["bits"], np.uint8)
    return Filter(filled, starts * 8, total[0] or 0, total[1], keys[order], head["c"].to_numpy(np.int64)[order]), counts


def score(docs: DataFrame, model: Filter, counts: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of whole texts.

    ``base_score`` is exact: words that are not among the most frequent are summed
    per document and joined with their counts.  NULL and empty texts consist of the
    end token.  With nothing learned the base is log10 of 1 for each token.  Rows
    repeated with one doc_id are scored each for itself; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = shared.value
        serial = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch):
                h, pairs, bounds = tokens(Words(part.column(1)))
                row = np.repeat(np.arange(part.num_rows), np.diff(bounds))
                at = np.minimum(np.searchsorted(filter_.head, h), max(len(filter_.head) - 1, 0))
                frequent = filter_.head[at] == h if len(filter_.head) else np.zeros(len(h), dtype=bool)
                known = np.bincount(row[frequent], minlength=part.num_rows)
                sums = np.bincount(row[frequent], np.log10(filter_.head_counts[at[frequent]] + 0.5), minlength=part.num_rows).astype(float)
                model_sums = np.bincount(row, filter_.log_probability(h, pairs, bounds), minlength=part.num_rows).astype(float)
                rest, of = h[~frequent], row[~frequent]
                order = np.lexsort((rest, of))
                rest, of = rest[order], of[order]
                new = np.flatnonzero(np.concatenate([[True], (rest[1:] != rest[:-1]) | (of[1:] != of[:-1])])) if len(rest) else np.zeros(0, np.int64)
                times = np.diff(np.concatenate([new, [len(rest)]]))
                cut = pa.array(np.searchsorted(of[new], np.arange(part.num_rows + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(serial + np.arange(part.num_rows)), pa.array(np.diff(bounds).astype(np.int64)), pa.array(known.astype(np.int64)),
                     pa.array(sums), pa.array(model_sums), pa.ListArray.from_arrays(cut, pa.array(rest[new].view(np.int64))), pa.ListArray.from_arrays(cut, pa.array(times.astype(np.int64)))],
                    ["doc_id", "row", "n_tokens", "head_known", "head_sum", "score", "rest", "times"])
                serial += part.num_rows

    rows = store(docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, row long, n_tokens long, head_known long, head_sum double, score double, rest array<long>, times array<long>"))
    rare = rows.select("row", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("row", F.col("x.rest").alias("h"), F.col("x.times").alias("n"))
    joined = rare.join(counts, "h", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    per = joined.groupBy("row").agg(
        F.sum(F.col("n") * F.log10(F.col("c") + F.lit(0.5))).alias("rare_sum"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"))
    below = float(np.log10(model.total + 0.5 * (model.kinds + 1)))
    out = rows.drop("rest", "times").join(per, "row", "left")
    return out.select(
        "doc_id", "n_tokens", (F.col("head_known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("head_sum") + F.coalesce("rare_sum", F.lit(0.0)) - F.col("n_tokens") * F.lit(below)).alias("base_score"), "score")


def op6(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 5) == 1
    out = score(docs, *train(docs.filter(~held_out)))
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
