"""Hierarchical packing of tokenized documents into windows of several lengths.

A document first fills windows of the longest tier by itself; what is left is
routed to the shortest tier that holds it.  Tiers are packed from long to short: a
routed piece opens a window of its tier, the gap takes whole pieces of shorter
tiers, the longest that fit first, and last a cut piece, whose rest is routed
again.  Windows therefore come out exactly full.  Pieces that no window could be
filled with wait for the next slice of the task; what waits at its end is cut along
the powers of two, so no sequence is padded.

A task packs its own rows, in slices of bounded size, and numbers sequences below
its partition number, so nothing is shuffled.
"""

from __future__ import annotations

import base64
import os
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from panelwright.llm.common import Words, mix, read, remembered, slices

TIERS = (2048, 1024, 512, 256)
END = 1
#: Tokens of a step group; a step holds windows of one tier, so all steps cost the same.
STEP_TOKENS = 16384
_BLANK = np.zeros(256, dtype=bool)
_BLANK[0x20] = True
_SPACE_BYTES = np.zeros(256, dtype=bool)
_SPACE_BYTES[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
#: Lead bytes of characters that may be white space.
_LEADS = np.zeros(256, dtype=bool)
_LEADS[[0xC2, 0xE1, 0xE2, 0xE3]] = True


class Encoder:
    """Ids of texts, with the ids of blank-separated stretches remembered by hash.

    The splitting pattern joins a single blank to what follows it, so a text whose
    blanks all stand between other characters is the sequence of its stretches,
    each encoded with its blank.  Other texts are encoded whole.  ``ranks`` is the
    same vocabulary for the faster library and serves Latin text, where both agree.
    """

    def __init__(self, vocabulary: str, ranks: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        # texts that hold an added token as such go to the unmodified tokenizer, whole
        self.plain = Tokenizer.from_file(vocabulary)
        self.added = [t.content.encode() for t in self.plain.get_added_tokens_decoder().values()]
        self.whole = Tokenizer.from_file(vocabulary)
        self.whole.encode_special_tokens = True
        self.fast = None
        if ranks:
            import public_tokenizers
            import tiktoken

            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
            self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.keys = np.zeros(0, np.uint64)
        self.slots = np.zeros(0, np.int64)
        self.starts, self.lengths = np.zeros(1, np.int64), np.ones(1, np.int64)  # slot 0 is the end mark
        self.pool = np.array([END], np.uint32)

    def ids(self, text: str) -> list[int]:
        if self.fast is not None and (text.isascii() or max(text) < "ɐ"):
            return self.fast.encode_ordinary(text)
        return self.whole.encode(text, add_special_tokens=False).ids

    def _with_added(self, data: np.ndarray, bounds: np.ndarray) -> list[int]:
        """Rows whose text holds an added token."""
        blob, rows = data.tobytes(), set()
        for token in self.added:
            at = blob.find(token)
            while at >= 0:
                row = int(np.searchsorted(bounds, at, "right")) - 1
                if at + len(token) <= bounds[row + 1]:
                    rows.add(row)
                at = blob.find(token, at + 1)
        return sorted(rows)

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        new = [self.ids(t) for t in texts]
        lengths = np.array([len(x) for x in new], np.int64)
        first = len(self.starts)
        self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.pool = np.concatenate([self.pool, np.fromiter((i for x in new for i in x), np.uint32, int(lengths.sum()))])
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.slots = np.insert(self.slots, at, first + np.arange(len(keys)))

    def encode(self, column: pa.Array, most: int = 4_000_000) -> list[np.ndarray]:
        """Ids of every row, the end mark last.  ``most`` stretches are remembered, then memory starts anew."""
        if len(self.keys) > most:
            self.keys, self.slots, self.starts, self.lengths, self.pool = self.keys[:0], self.slots[:0], self.starts[:1], self.lengths[:1], self.pool[:1]
        words = Words(column, _BLANK, lower=False)
        data, bounds = words.data, words.bounds
        blank = np.flatnonzero(_BLANK[data])
        odd = np.zeros(len(bounds) - 1, dtype=bool)
        if len(blank):
            at = lambda k: data[np.clip(blank + k, 0, len(data) - 1)]
            bad = _SPACE_BYTES[at(-1)] | _SPACE_BYTES[at(1)] | _LEADS[at(1)] | _LEADS[at(-2)] | _LEADS[at(-3)]
            row = np.searchsorted(bounds, blank, "right") - 1
            bad |= (blank == bounds[row]) | (blank + 1 == bounds[row + 1])
            odd[row[bad]] = True
        keys = words.hashes()
        heads = words.rows[:-1][words.counts() > 0]
        keys[heads] = mix(keys[heads] + np.uint64(1))
        kinds, first, which = np.unique(keys, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, kinds)
        known = np.zeros(len(kinds), dtype=bool)
        if len(self.keys):
            known = self.keys[np.minimum(at, len(self.keys) - 1)] == kinds
        if not known.all():
            leading = np.zeros(len(keys), dtype=bool)
            leading[heads] = True
            todo = np.flatnonzero(~known)
            self._learn(kinds[todo], [("" if leading[i] else " ") + words.text(i) for i in first[todo]])
        slot = self.slots[np.searchsorted(self.keys, kinds)] if len(kinds) else np.zeros(0, np.int64)
        slot = np.insert(slot[which], words.rows[1:], 0)
        lengths = self.lengths[slot]
        ends = np.cumsum(lengths)
        flat = self.pool[np.arange(int(lengths.sum())) + np.repeat(self.starts[slot] - (ends - lengths), lengths)]
        row_ends = ends[words.rows[1:] + np.arange(len(odd))]
        row_starts = np.concatenate([[0], row_ends[:-1]]).astype(np.int64)
        out = [flat[a:b] for a, b in zip(row_starts, row_ends, strict=True)]
        for r in np.flatnonzero(odd):
            out[r] = np.array([*self.ids(data[bounds[r]: bounds[r + 1]].tobytes().decode()), END], np.uint32)
        for r in self._with_added(data, bounds):
            text = data[bounds[r]: bounds[r + 1]].tobytes().decode()
            out[r] = np.array([*self.plain.encode(text, add_special_tokens=False).ids, END], np.uint32)
        return out


def _encoder(vocabulary: str, ranks: str | None) -> Encoder:
    return remembered(("packing", vocabulary, ranks), lambda: Encoder(vocabulary, ranks))


class Packer:
    """Packs pieces (length, document, start); ``emit`` gets the pieces of each finished window with its tier."""

    def __init__(self, tiers: tuple[int, ...], emit):
        self.tiers, self.emit = tiers, emit
        self.pools: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}

    def add(self, doc: int, length: int) -> None:
        longest = self.tiers[0]
        for start in range(0, length - length % longest, longest):
            self.emit(longest, [(longest, doc, start)])
        if length % longest:
            self._route(length % longest, doc, length - length % longest)

    def _route(self, length: int, doc: int, start: int) -> None:
        insort(self.pools[min(t for t in self.tiers if t >= length)], (length, doc, start))

    def pack(self) -> None:
        for k, tier in enumerate(self.tiers):
            shorter = self.tiers[k + 1:] or (tier,)
            waiting = sum(p[0] for t in self.tiers[k:] for p in self.pools[t])
            while self.pools[tier] and waiting >= tier:
                window = [self.pools[tier].pop()]
                gap = tier - window[0][0]
                while gap:
                    piece = self._fitting(shorter, gap) or self._cut((*shorter[::-1], tier), gap)
                    window.append(piece)
                    gap -= piece[0]
                self.emit(tier, window)
                waiting -= tier

    def _fitting(self, tiers: tuple[int, ...], gap: int) -> tuple[int, int, int] | None:
        """The longest waiting piece of these tiers that fits."""
        for t in tiers:
            at = bisect_right(self.pools[t], gap, key=lambda p: p[0])
            if at:
                return self.pools[t].pop(at - 1)
        return None

    def _cut(self, tiers: tuple[int, ...], gap: int) -> tuple[int, int, int]:
        """The head of the longest piece of the first tier that has one; its rest is routed again."""
        for t in tiers:
            if self.pools[t]:
                length, doc, start = self.pools[t].pop()
                if length > gap:
                    self._route(length - gap, doc, start + gap)
                return min(length, gap), doc, start
        raise AssertionError("a window was opened without enough to fill it")

    def finish(self) -> None:
        """Cut what waits along the powers of two of its total."""
        self.pack()
        rest = sorted(p for pool in self.pools.values() for p in pool)
        total = sum(p[0] for p in rest)
        for power in (1 << b for b in reversed(range(self.tiers[0].bit_length()))):
            while total >= power:
                window, gap = [], power
                while gap:
                    length, doc, start = rest.pop()
                    window.append((min(length, gap), doc, start))
                    if length > gap:
                        rest.append((length - gap, doc, start + gap))
                    gap -= window[-1][0]
                self.emit(power, window)
                total -= power
        self.pools = {t: [] for t in self.tiers}

    def waiting(self) -> set[int]:
        return {p[1] for pool in self.pools.values() for p in pool}


COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]
SCHEMA = ", ".join(f"{c} long" for c in COLUMNS)


def pack(docs: DataFrame, vocabulary: str, ranks: str | None = None, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row per piece of a document, with its sequence, its place there, the window tier and the step group.

    NULL and empty texts have one token, the end mark.  Repeated rows are packed
    each for itself, ties between pieces are settled by length, order of rows and
    start.  Very long texts fill windows of their own.  Other columns are ignored;
    an empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary, ranks)
        base = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        held: dict[int, tuple] = {}
        made = dict.fromkeys((1 << b for b in range(tiers[0].bit_length())), 0)
        count = serial = 0

        def emit(tier: int, window: list[tuple[int, int, int]]) -> None:
            nonlocal count
            offset = 0
            step = base + (tier.bit_length() << 34) + made[tier] * tier // step_tokens
            made[tier] += 1
            for length, doc, start in window:
                doc_id, ids = held[doc]
                rows.append((doc_id, start, length, zlib.crc32(ids[start: start + length].data), len(ids), base + count, offset, tier, step))
                offset += length
            count += 1

        def table() -> pa.RecordBatch:
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] or [pa.array([], pa.int64())] * len(COLUMNS)
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, COLUMNS)

        packer = Packer(tiers, emit)
        for batch in batches:
            for part in slices(batch):
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1)), strict=True):
                    held[serial] = (doc_id, ids)
                    packer.add(serial, len(ids))
                    serial += 1
                packer.pack()
                held = {d: (held[d][0], held[d][1].copy()) for d in packer.waiting()}
                yield table()
        packer.finish()
        yield table()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op4(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
