"""License scan: fuzzy search for short notices.

A notice of which ``k`` characters may be wrong is cut into ``k + 1`` pieces; any
occurrence with at most ``k`` edits holds one piece unchanged.  The pieces are
searched exactly and each hit gives a window, in which the regex library looks for
the whole notice with bounded errors and reports span and edits.  Text is searched
as its lower-case words joined by single blanks, so line breaks, punctuation and
spacing inside a notice do not matter, and spans are word positions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from panelwright.llm.common import NOT_WORD, Words, slices


@dataclass(frozen=True)
class Notice:
    phrase: str
    label: str
    base: bool = False

    @property
    def errors(self) -> int:
        """One edit for every ten characters, at most four."""
        return min(4, len(self.phrase) // 10)


NOTICES = (
    Notice("mit license", "mit", True),
    Notice("apache license", "apache", True),
    Notice("general public license", "gpl", True),
    Notice("lesser general public license", "lgpl"),
    Notice("affero general public license", "agpl"),
    Notice("mozilla public license", "mpl"),
    Notice("eclipse public license", "epl"),
    Notice("bsd license", "bsd"),
    Notice("redistribution and use in source and binary forms", "bsd"),
    Notice("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    Notice("licensed under cc by", "cc"),
    Notice("creative commons attribution", "cc"),
    Notice("released into the public domain", "public-domain"),
    Notice("all rights reserved", "all-rights-reserved"),
)


@lru_cache(maxsize=8)
def _compiled(notices: tuple[Notice, ...]) -> tuple[list, list]:
    """Patterns, and for each distinct piece the notices it comes from with its offset."""
    patterns, pieces = [], {}
    for i, n in enumerate(notices):
        raw = n.phrase.encode()
        patterns.append(regex.compile(rb"(?b)(?<![^ ])(?:" + regex.escape(raw, special_only=True) + rb"){e<=%d}(?![^ ])" % n.errors))
        cuts = np.linspace(0, len(raw), n.errors + 2).astype(int)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            pieces.setdefault(raw[a:b], []).append((i, int(a)))
    return patterns, list(pieces.items())


def matches(text: bytes, notices: tuple[Notice, ...] = NOTICES) -> list[tuple[int, int, int, int]]:
    """(notice, first byte, end, edits) of every place, sorted; ``text`` is words joined by single blanks.

    A window reaches the notice's errors beyond the place a piece points to.  Of
    overlapping places of one notice that with fewest edits stays, the first of equal ones.
    """
    patterns, pieces = _compiled(notices)
    windows: set[tuple[int, int]] = set()
    for piece, owners in pieces:
        at = text.find(piece)
        while at >= 0:
            windows.update((i, at - offset) for i, offset in owners)
            at = text.find(piece, at + 1)
    found: dict[int, list] = {}
    for i, expected in sorted(windows):
        k, length = notices[i].errors, len(notices[i].phrase)
        m = patterns[i].search(text, max(0, expected - k), min(len(text), expected + length + 2 * k), concurrent=False)
        # pos and endpos hide what lies outside from the assertion at the end, so look again here
        if m and (m.end() == len(text) or text[m.end()] == 32):
            found.setdefault(i, []).append((sum(m.fuzzy_counts), m.start(), m.end()))
    out = []
    for i, spans in found.items():
        kept: list[tuple[int, int, int]] = []
        for edits, a, b in sorted(set(spans)):
            if all(b <= x or a >= y for _, x, y in kept):
                kept.append((edits, a, b))
        out += [(i, a, b, edits) for edits, a, b in kept]
    return sorted(out)


SCHEMA = """doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double,
            spans array<struct<label: string, notice: string, first_word: long, n_words: long, edits: int>>"""


def _row(words: Words, r: int, notices: tuple[Notice, ...]) -> dict:
    lo, hi = words.rows[r], words.rows[r + 1]
    base, spans, score = [], [], 0.0
    if hi > lo:
        text = b" ".join(words.data[words.bounds[r]: words.bounds[r + 1]].tobytes().translate(_BLANKS).split())
        for i, a, b, edits in matches(text, notices):
            n = notices[i]
            first = text.count(b" ", 0, a)
            spans.append((n.label, n.phrase, first, text.count(b" ", a, b) + 1, edits))
            score = max(score, 1 - edits / len(n.phrase))
            if n.base and edits == 0:
                base.append((first, n.label))
    return {
        "n_words": int(hi - lo), "n_base": len(base),
        "first_word": min(base)[0] if base else None, "last_word": max(base)[0] if base else None,
        "base_labels": ",".join(sorted({x for _, x in base})), "labels": ",".join(sorted({s[0] for s in spans})), "score": score,
        "spans": [dict(zip(("label", "notice", "first_word", "n_words", "edits"), s, strict=True)) for s in spans],
    }


_BLANKS = bytes(32 if NOT_WORD[b] else b for b in range(256))


def scan(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """One row per document: word count, exact places of base phrases, labels, score and all spans.

    ``n_base`` counts places without edits of base notices, ``first_word`` and
    ``last_word`` are their smallest and largest start.  ``labels`` also holds what
    fuzzy places say; ``score`` is the best place's share of right characters, 0
    without one.  NULL text is empty: no words, empty labels.  Whole texts are
    read; rows are independent, so ties and repeats need no rule.  The notices are
    the parameter; other columns of ``docs`` are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column(1), NOT_WORD)
                rows = [{"doc_id": d} | _row(words, r, notices) for r, d in enumerate(part.column(0).to_pylist())]
                yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ("spans", pa.list_(pa.struct([("label", pa.string()), ("notice", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("edits", pa.int32())]))),
])


def op1(spark, sf_dir: str) -> DataFrame:
    from panelwright.llm.common import read

    return scan(read(spark, sf_dir, "documents")).drop("spans")
