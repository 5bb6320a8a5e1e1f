"""Near-duplicate groups: an LSH forest over MinHash signatures, links confirmed on full shingle sets.

Documents with one shingle set form a class, and only classes are compared.  A
class has ``TREES`` labels, each a stretch of its signature in an order of its own.
Rows that agree on the first ``DEPTH`` values of a tree form a region; inside it rows
are sorted by the values that follow, so neighbours share the longest prefixes and
the depth in use grows with the crowding of a region.

Candidates of the classes that share a region with another come in rounds.  First
each row meets one head of its regions, the class whose regions are most crowded: the
text that copies derive from heads nearly all regions it is in, so a group of
thousands is linked with few candidates a row.  Then each row meets its neighbour by
label, where they are not in one component yet.  After that, rows of a region meet
those of its other components, the ``NEAREST`` by parity first; each further turn
takes ``GROWTH`` times as many, until no two rows of a region that are in different
components and may be linked have not met.

Each row carries the parity of its shingles in ``PARITY`` bits: a bit is turned once
for every shingle that falls on it.  Bits in which two rows differ are never more
than the shingles that only one of them has, and a link of similarity 0.8 has a ninth
of both sizes of those at most.  Pairs beyond are dropped where they are formed, which
loses no link and leaves few pairs that are not close.  For sets of more shingles than
bits the test says less and less; such pairs are confirmed on their sets like others.

For two sets of similarity 0.8 the chance to share no region is
(1 - 0.8**5)**32, three in a million.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from panelwright.llm.common import SLICE_BYTES, Words, let_go, mix, read, shingles, slices, store

TREES, DEPTH = 32, 5
HASHES = TREES * DEPTH
#: Rows of other components that a row meets in the first turn of the second round, and the factor of every further turn.
NEAREST, GROWTH = 4, 8
#: Places of a comparison by parity that a task holds at a time; it changes no result.
CELLS = 1 << 17
PARITY = 512
WORDS = [f"p{k}" for k in range(PARITY // 64)]
#: Bits of the filter that names wanted documents.  A full filter only lets more rows through; the join after it is exact.
FILTER_BITS = 1 << 23

_FACTORS = np.random.default_rng(0xF0E5).integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TREE_SEEDS = mix(np.arange(1, TREES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _set_keys(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name the set of each row, whatever its order; zero for an empty set."""
    rows = len(bounds) - 1
    hi, lo = np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        hi[full] = np.add.reduceat(mix(hashes), bounds[full])
        lo[full] = np.add.reduceat(mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)), bounds[full])
    return hi, lo


def signatures(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(rows, HASHES) with 16 bits of the smallest hash values; rows with an empty set hold zeros.

    The leading bits of a smallest value are nearly always zero, these are not: two
    different shingles agree once in 65,536, which only adds candidates.
    """
    out = np.zeros((len(bounds) - 1, HASHES), np.uint16)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        for m in range(HASHES):
            out[full, m] = (np.minimum.reduceat(hashes * _FACTORS[m], bounds[full]) >> np.uint64(16)).astype(np.uint16)
    return out


def parities(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(rows, PARITY / 64) words, a bit turned for every hash that falls on it."""
    rows = len(bounds) - 1
    out = np.zeros(rows * len(WORDS), np.uint64)
    bit = mix(hashes) % np.uint64(PARITY)
    at = np.repeat(np.arange(rows), np.diff(bounds)) * len(WORDS) + (bit >> np.uint64(6)).astype(np.int64)
    np.bitwise_xor.at(out, at, np.uint64(1) << (bit & np.uint64(63)))
    return out.reshape(rows, len(WORDS))


def sign(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, hi, lo, signature, parity) of whole texts; NULL text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            for part in slices(batch):
                hashes, bounds = shingles(Words(part.column(1)), width)
                hi, lo = _set_keys(hashes, bounds)
                sig = signatures(hashes, bounds)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(bounds).astype(np.int64)), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)),
                     pa.array([r.tobytes() for r in sig], pa.binary()), pa.array([r.tobytes() for r in parities(hashes, bounds)], pa.binary())],
                    ["doc_id", "n", "hi", "lo", "signature", "parity"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, hi long, lo long, signature binary, parity binary")


def _regions(sig: np.ndarray) -> np.ndarray:
    """(rows, TREES) names of tree and first values."""
    region = np.repeat(_TREE_SEEDS[None, :], len(sig), axis=0)
    for d in range(DEPTH):
        region = mix(region * np.uint64(0xD6E8FEB86659FD93) + sig[:, d::DEPTH])
    return region


def _signature(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), HASHES).astype(np.uint64)


def forest(classes: DataFrame) -> DataFrame:
    """A row (region, label, id, n, comp) and the parity words for each class and tree.

    ``region`` names tree and first values, ``label`` sorts by the values that follow.
    Where classes carry ``trees``, a bit for each tree, only those trees are planted.
    """
    schema = "region long, label long, id long, n long, comp long, " + ", ".join(f"{c} long" for c in WORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                sig = _signature(part.column(0))
                region = _regions(sig)
                label = np.zeros((part.num_rows, TREES), np.uint64)
                for d in range(4):
                    label = (label << np.uint64(16)) | np.roll(sig, -DEPTH * (d + 1), axis=1)[:, d::DEPTH]
                trees = part.column(5).to_numpy(zero_copy_only=False).astype(np.uint64) if part.num_columns > 5 else np.full(part.num_rows, (1 << TREES) - 1, np.uint64)
                row, tree = np.nonzero((trees[:, None] >> np.arange(TREES, dtype=np.uint64)) & np.uint64(1))
                parity = np.frombuffer(b"".join(part.column(4).to_pylist()), np.int64).reshape(part.num_rows, len(WORDS))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(region[row, tree].view(np.int64)), pa.array(label[row, tree].view(np.int64)),
                     *[pa.array(part.column(c).to_numpy(zero_copy_only=False)[row]) for c in (1, 2, 3)],
                     *[pa.array(x[row]) for x in parity.T]],
                    ["region", "label", "id", "n", "comp", *WORDS])

    wanted = ["signature", "id", "n", "comp", "parity", *(["trees"] if "trees" in classes.columns else [])]
    return classes.select(*wanted).mapInArrow(run, schema)


def _by_region(rows: DataFrame, *order: str) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "region").sortWithinPartitions("region", *order)


def _short(hi: np.ndarray) -> np.ndarray:
    """40 bits of the name of a set."""
    return hi.view(np.uint64) >> np.uint64(24)


def crowded(signed: DataFrame) -> DataFrame:
    """(short, trees): by 40 bits of their names, the sets that share a region with another, and the trees of these regions, a bit each.

    Copies of a set are let through once a task.  Only 40 bits of region and name are
    shuffled: sets wrongly taken for neighbours are turned away by later checks.  Two
    neighbours whose names agree in 40 bits, one pair in 10**12, would pass for copies.
    """

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        seen = np.zeros(0, np.uint64)
        for batch in batches:
            short, first = np.unique(_short(batch.column(0).to_numpy()), return_index=True)
            new = ~np.isin(short, seen)
            seen = np.concatenate([seen, short[new]])
            for at in range(0, int(new.sum()), 2048):
                part = batch.column(1).take(pa.array(first[new][at:at + 2048]))
                region = _regions(_signature(part)) >> np.uint64(24)
                name = (short[new][at:at + 2048, None] << np.uint64(5)) | np.arange(TREES, dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(region.ravel().view(np.int64)), pa.array(name.ravel().view(np.int64))], ["region", "name"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        last = np.zeros((2, 0), np.int64)
        for batch in batches:
            # rows of one region and set are one
            rows = np.concatenate([last, np.stack([batch.column(c).to_numpy() for c in range(2)])], axis=1)
            new = np.ones(rows.shape[1], dtype=bool)
            new[1:] = (rows[:, 1:] != rows[:, :-1]).any(axis=0)
            rows = rows[:, new]
            same = np.zeros(rows.shape[1] + 1, dtype=bool)
            same[1:-1] = rows[0, 1:] == rows[0, :-1]
            found = np.unique(rows[1, same[1:] | same[:-1]])
            last = rows[:, -1:]
            yield pa.RecordBatch.from_arrays([pa.array(found >> 5), pa.array(np.int64(1) << (found & 31))], ["short", "tree"])

    planted = signed.filter("n > 0").select("hi", "signature").mapInArrow(plant, "region long, name long")
    return _by_region(planted, "name").mapInArrow(run, "short long, tree long").groupBy("short").agg(F.bit_or("tree").alias("trees"))


def _met(signed: DataFrame) -> DataFrame:
    """The classes, one row for each set, that share a region with another; ``trees`` says in which trees."""
    near = store(crowded(signed))
    bitmap = _bitmap(near.select("short"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for batch in batches:
            hit = _in_bitmap(bits, _short(batch.column(2).to_numpy()))
            yield batch.filter(pa.array(hit & (batch.column(1).to_numpy() > 0)))

    maybe = signed.mapInArrow(run, signed.schema)
    classes = maybe.groupBy("hi", "lo").agg(F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("n", "signature", "parity")])
    short = F.shiftrightunsigned("hi", 24)
    met = classes.join(near.withColumnRenamed("short", "_short"), short == F.col("_short")).drop("_short")
    return store(met.withColumn("id", F.monotonically_increasing_id()).withColumn("comp", F.col("id")))


def _possible(rows: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether the rows may be linked by size and parity, and the bits in which they differ."""
    n = rows[2]
    apart = np.bitwise_count((rows[4:, i] ^ rows[4:, j]).view(np.uint64)).sum(axis=0, dtype=np.int64)
    return (np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * 80) & (9 * apart <= n[i] + n[j]), apart


def _nearest(rows: np.ndarray, head: np.ndarray, upto: np.ndarray, i: np.ndarray, most: int) -> tuple[np.ndarray, bool]:
    """(rows, rows before ``upto``) that may be linked, the ``most`` nearest by parity, and whether a row has more."""
    found, more = [np.zeros((2, 0), np.int64)], False
    n = rows[2]
    span = upto[i] - head[i]
    i = i[np.argsort(-span, kind="stable")][: np.count_nonzero(span)]
    at = 0
    while at < len(i):
        reach = int(upto[i[at]] - head[i[at]])
        own = i[at: at + max(1, CELLS // reach)]
        at += len(own)
        j = head[own][:, None] + np.arange(reach)[None, :]
        valid = j < upto[own][:, None]
        j = np.minimum(j, len(n) - 1)
        valid &= np.minimum(n[j], n[own][:, None]) * 100 >= np.maximum(n[j], n[own][:, None]) * 80
        r, c = np.nonzero(valid)
        c = j[r, c]
        fits, apart = _possible(rows, own[r], c)
        r, c, apart = r[fits], c[fits], apart[fits]
        order = np.lexsort((apart, r))
        r, c = r[order], c[order]
        chosen = np.arange(len(r)) - np.searchsorted(r, r) < most
        more |= not chosen.all()
        found.append(np.stack([own[r[chosen]], c[chosen]]))
    return np.concatenate(found, axis=1), more


def neighbours(trees: DataFrame, order: tuple[str, ...], meet: str, most: int = NEAREST) -> DataFrame:
    """Distinct candidate pairs (head, id) of regions sorted in ``order``, of sets that size and parity allow to be linked.

    A row meets the ``head`` of its region; or the row ``before`` it, if that is of
    another component; or, rows being sorted by component, ``most`` rows of all
    ``others`` before its own, and a pair (-1, -1) says that some row has more.  Sorted
    rows stream through a task, which holds one batch and, for ``others``, the region
    so far.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        held = None
        for batch in batches:
            rows = np.stack([c.to_numpy() for c in batch.columns])
            if not rows.shape[1]:
                continue
            old = 0
            if held is not None and held[0, -1] == rows[0, 0]:
                rows, old = np.concatenate([held, rows], axis=1), held.shape[1]
            region, ids, _, comp = rows[:4]
            total = len(region)
            starts = np.ones(total, dtype=bool)
            starts[1:] = region[1:] != region[:-1]
            head = np.maximum.accumulate(np.where(starts, np.arange(total), 0))
            i = np.arange(old, total)
            i = i[i > head[i]]
            last = head[-1]
            if meet == "others":
                starts[1:] |= comp[1:] != comp[:-1]
                (i, j), more = _nearest(rows, head, np.maximum.accumulate(np.where(starts, np.arange(total), 0)), i, most)
                if more:
                    yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64())] * 2, ["head", "id"])
                held = rows[:, last:]
            else:
                j = head[i] if meet == "head" else i - 1
                fits = _possible(rows, i, j)[0] & ((meet == "head") | (comp[i] != comp[j]))
                i, j = i[fits], j[fits]
                held = rows[:, np.unique([last, total - 1])]
            yield pa.RecordBatch.from_arrays([pa.array(ids[j]), pa.array(ids[i])], ["head", "id"])

    sorted_ = _by_region(trees, *order).select("region", "id", "n", "comp", *WORDS)
    return sorted_.mapInArrow(run, "head long, id long").distinct()


def _bitmap(ids: DataFrame):
    """A broadcast bitmap of ids, of fixed size: each of a few tasks returns one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS, dtype=bool)
        for batch in batches:
            bits[mix(batch.column(0).to_numpy().view(np.uint64)) % np.uint64(FILTER_BITS)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], ["bits"])

    rows = ids.repartition(6).mapInArrow(run, "bits binary").collect()
    all_ = np.bitwise_or.reduce([np.frombuffer(r["bits"], np.uint8) for r in rows]) if rows else np.zeros(FILTER_BITS // 8, np.uint8)
    return ids.sparkSession.sparkContext.broadcast(all_)


def _in_bitmap(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = mix(ids) % np.uint64(FILTER_BITS)
    return ((bits[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & 1).astype(bool)


def maybe_among(ids: DataFrame) -> Callable[[Column], Column]:
    """A test of ids (long) by a bitmap of the column ``ids``: false is certain, true is not; false for NULL."""
    bitmap = _bitmap(ids)

    @F.pandas_udf("boolean")
    def hit(column: pd.Series) -> pd.Series:
        let_go()
        return pd.Series(_in_bitmap(bitmap.value, column.to_numpy().view(np.uint64)))

    return lambda column: column.isNotNull() & hit(F.coalesce(column, F.lit(0)))


def _texts(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(id, size, packed) of the wanted classes (id, doc_id, hi, lo): the compressed text of their first documents and its bytes.

    Texts are a third of their sets in bytes, and the sets are recomputed where two of them meet.
    """
    bitmap = _bitmap(wanted.filter("doc_id IS NOT NULL").select("doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        bits = bitmap.value
        for batch in batches:
            ids = batch.column(0)
            hit = _in_bitmap(bits, ids.fill_null(0).to_numpy().astype(np.int64).view(np.uint64))
            chosen = batch.filter(pa.array(hit | ids.is_null().to_numpy(zero_copy_only=False)))
            for part in slices(chosen):
                hashes, bounds = shingles(Words(part.column(1)), width)
                hi, lo = _set_keys(hashes, bounds)
                texts = [t or b"" for t in part.column(1).cast(pa.large_binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), pa.array([len(t) for t in texts], pa.int64()),
                     pa.array([pa.compress(t, "zstd", asbytes=True) if t else b"" for t in texts], pa.binary())],
                    ["hi", "lo", "size", "packed"])

    made = docs.select("doc_id", "text").mapInArrow(run, "hi long, lo long, size long, packed binary")
    # a class is one (hi, lo), so dropping repeats by it needs no further shuffle
    return made.join(wanted.select("hi", "lo", "id"), ["hi", "lo"]).dropDuplicates(["hi", "lo"]).select("id", "size", "packed")


def _shared(a: pa.Array, b: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of intersection and union of the sets of two text columns, row by row."""
    both = [shingles(Words(x), width) for x in (a, b)]
    row = np.concatenate([np.repeat(np.arange(len(a)), np.diff(bounds)) for _, bounds in both])
    hashes = np.concatenate([h for h, _ in both])
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    twice = (row[1:] == row[:-1]) & (hashes[1:] == hashes[:-1])
    shared = np.bincount(row[1:][twice], minlength=len(a))
    return shared, np.diff(both[0][1]) + np.diff(both[1][1]) - shared


def confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """The pairs as links (a, b) whose full sets have 100 * intersection >= 80 * union.

    The head, which may be in very many pairs, is joined while rows are slim.
    """
    wanted = pairs.select(F.explode(F.array("head", "id")).alias("id")).distinct().join(classes.select("id", "doc_id", "hi", "lo"), "id")
    texts = store(_texts(docs, wanted, width))
    one = pairs.join(texts.withColumnsRenamed({"id": "head", "size": "na", "packed": "ta"}), "head")
    both = one.join(texts.withColumnsRenamed({"size": "nb", "packed": "tb"}), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            sizes = np.cumsum(batch.column(2).to_numpy() + batch.column(4).to_numpy())
            at = 0
            while at < batch.num_rows:
                # as many pairs as hold about a slice of bytes, one at least
                upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE_BYTES, "right")))
                part = batch.slice(at, upto - at)
                text = [pa.array([pa.decompress(t, n, "zstd", asbytes=True) if n else b"" for n, t in zip(part.column(c).to_pylist(), part.column(c + 1).to_pylist(), strict=True)], pa.large_binary()).view(pa.large_string())
                        for c in (2, 4)]
                shared, union = _shared(*text, width)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(100 * shared >= 80 * union))
                at = upto

    return both.select("head", "id", "na", "ta", "nb", "tb").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(id, comp) of every linked node, comp the smallest id reachable; alternating large and small stars.

    Each round hangs neighbours under the smallest one seen, so the number of
    rounds grows with the logarithm of the longest chain.
    """
    edges = store(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("comp"))
        state = now
        both = edges.union(edges.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        # as many files as the edges fill, however many partitions the session has
        edges = store(small.select("e.u", "e.v").filter("u <> v").distinct().coalesce(max(8, now[0] // 100_000)))


def _closure(comps: DataFrame, classes: DataFrame) -> DataFrame:
    return classes.drop("comp").join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))


def _either_way(pairs: DataFrame) -> DataFrame:
    return pairs.union(pairs.select("id", "head").toDF("head", "id"))


def near_duplicates(docs: DataFrame, width: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    A document's set are its distinct ``width``-word shingles, the whole sequence
    as one if it has fewer words; NULL and wordless texts have none, link with
    nothing and stand alone.  Rows of equal sets are linked.  component_id is the smallest
    doc_id of the group; a NULL doc_id takes part in links but never names a group
    unless all are NULL, and is kept only then.  Rows repeated with one doc_id are
    all kept or all dropped.  Other columns of ``docs`` are ignored; an empty table gives an empty table.
    """
    signed = store(sign(docs, width))
    met = _met(signed)
    trees = forest(met)
    sizes = trees.groupBy("region").agg(F.count("*").alias("size"))
    crowd = trees.select("region", "id").join(sizes, "region").groupBy("id").agg(F.sum("size").alias("crowd"))
    # the place in the order goes with the class, in the column that names components later
    ranked = forest(met.drop("comp").join(crowd, "id").withColumn("comp", -F.col("crowd")))
    heads = neighbours(ranked, ("comp", "id"), "head")
    # the head of the most crowded region alone: texts travel with pairs, and the rounds below meet what it leaves open
    first = F.max_by("head", F.struct("crowd", "head")).alias("head")
    done = store(heads.join(crowd.withColumnRenamed("id", "head"), "head").groupBy("id").agg(first).select("head", "id"))
    comps = components(confirmed(done, docs, met, width))
    # then only pairs that would join components
    meet, most = "before", NEAREST
    while True:
        order = ("label", "id") if meet == "before" else ("comp", "id")
        found = store(neighbours(forest(_closure(comps, met)), order, meet, most).join(_either_way(done), ["head", "id"], "left_anti"))
        new = found.filter("head >= 0")
        if not new.isEmpty():
            comps = components(comps.toDF("a", "b").union(confirmed(new, docs, met, width)))
        if meet == "others" and found.filter("head < 0").isEmpty():
            break
        done, meet, most = done.union(new), "others", NEAREST if meet == "before" else most * GROWTH
    named = _closure(comps, met.select("id", "doc_id", "hi", "lo", "comp"))
    first = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    joined = named.join(first, "comp").select("hi", "lo", "component_id", F.lit(True).alias("met"))
    # the other sets have no neighbours but their copies
    copies = signed.filter("n > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("_first"))
    groups = copies.join(joined, ["hi", "lo"], "left").select(
        "hi", "lo", F.when(F.col("met"), F.col("component_id")).otherwise(F.col("_first")).alias("component_id"), F.lit(True).alias("grouped"))
    out = signed.select("doc_id", "n", "hi", "lo").join(groups, ["hi", "lo"], "left")
    component = F.when(F.col("grouped"), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op7(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), width=2)
