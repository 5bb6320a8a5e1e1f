"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of labelled
text.  A text is parsed greedily into the longest stretches that occur in the
sample; the language that needs fewest phrases per character wins.  Text is cut in
stretches of ``CHUNK`` characters that are parsed side by side, all languages at
once, so one step of the parse is a few vector operations.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from panelwright.llm.common import LOWER, even_starts, flat, kept_rows, read, remainder, remembered, slices

#: Rows of each language and bytes of their text that the automata are built on at most.
ROWS, SAMPLE_BYTES = 200, 48 << 10
CHUNK = 512
SYMBOLS = 64
UNKNOWN = "und"
_ENDED = np.int32(1 << 30)

#: Letters are 1 to 26, bytes above ASCII fold their case bit away, all else is a gap.
_SYMBOL = np.zeros(256, dtype=np.uint8)
_SYMBOL[0x61:0x7B] = np.arange(1, 27)
_SYMBOL[0x80:] = 27 + (np.arange(0x80, 0x100) & 31)
_SYMBOL = _SYMBOL[LOWER]


def symbols(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all rows and their bounds, runs of gaps made one."""
    s = _SYMBOL[data]
    keep = np.ones(len(s), dtype=bool)
    keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
    keep[bounds[:-1][bounds[:-1] < len(s)]] = True
    before = np.concatenate([[0], np.cumsum(keep)])
    return s[keep], before[bounds]


def automaton(text: np.ndarray) -> np.ndarray:
    """(states, SYMBOLS) next states of the suffix automaton, -1 where a stretch does not go on.

    Edges lie in one flat array from the start, so that nothing is larger while it is built.
    """
    step = array("i", [-1]) * (max(2, 2 * len(text)) * SYMBOLS)
    link, length = [-1], [0]
    last = 0
    for c in text.tolist():
        new = len(link)
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and step[p * SYMBOLS + c] < 0:
            step[p * SYMBOLS + c] = new
            p = link[p]
        if p >= 0:
            q = step[p * SYMBOLS + c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(link)
                step[twin * SYMBOLS: (twin + 1) * SYMBOLS] = step[q * SYMBOLS: (q + 1) * SYMBOLS]
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p * SYMBOLS + c] == q:
                    step[p * SYMBOLS + c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return np.frombuffer(step, np.int32).reshape(-1, SYMBOLS)[: len(link)]


def _parser(samples: tuple[bytes, ...]) -> tuple[np.ndarray, np.ndarray]:
    """One table for all languages: the next state's place, with the ``_ENDED`` bit where a new phrase begins; and the roots.

    A symbol that the sample lacks is a phrase of its own: it leads to a last state from which all begins anew.
    """
    tables, roots, base = [], [], 0
    for sample in samples:
        data = np.frombuffer(sample, np.uint8)
        go = automaton(symbols(data, np.array([0, len(data)]))[0])
        if (base + len(go) + 1) * SYMBOLS >= _ENDED:
            raise ValueError("too many languages for one table of states; give smaller samples")
        table = np.empty((len(go) + 1, SYMBOLS), np.int32)
        table[:-1] = go
        gone = table < 0
        table += np.int32(base)
        table *= np.int32(SYMBOLS)
        first = np.where(go[0] >= 0, (go[0] + base) * SYMBOLS, (len(go) + base) * SYMBOLS).astype(np.int32)
        np.copyto(table, (first | _ENDED)[None, :], where=gone)
        table[0], table[-1] = first, first | _ENDED
        tables.append(table)
        roots.append(base * SYMBOLS)
        base += len(go) + 1
    return np.concatenate(tables).ravel(), np.array(roots, np.int32)


def phrases(samples: tuple[bytes, ...], text: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(rows, languages) number of phrases; the parse starts anew every ``CHUNK`` symbols."""
    table, roots = remembered(("language", samples), lambda: _parser(samples))
    lengths = np.diff(bounds)
    per_row = -(-lengths // CHUNK)
    row = np.repeat(np.arange(len(lengths)), per_row)
    at = np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    start = bounds[row] + at * CHUNK
    size = np.minimum(CHUNK, bounds[row + 1] - start)
    order = np.argsort(-size, kind="stable")
    row, start, size = row[order], start[order], size[order]
    counts = np.ones((len(row), len(roots)), np.int32)
    state = np.repeat(roots[None, :], len(row), axis=0)
    active = len(row) - np.searchsorted(size[::-1], np.arange(1, CHUNK + 1), "left")
    for j in range(CHUNK):
        n = active[j]
        if not n:
            break
        went = table[state[:n] + text[start[:n] + j].astype(np.int32)[:, None]]
        counts[:n] += went >> 30
        state[:n] = went & (_ENDED - 1)
    out = np.zeros((len(lengths), len(roots)), np.int64)
    np.add.at(out, row, counts)
    return out


def sample(docs: DataFrame, rows: int = ROWS, most: int = SAMPLE_BYTES) -> dict[str, bytes]:
    """Bytes of text per language, from the training rows with the smallest id hashes, longer texts cut; NULL languages and texts are passed over."""
    labelled = docs.filter("lang IS NOT NULL AND text IS NOT NULL").filter(remainder("doc_id", 3) != 1)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    first = labelled.select("doc_id", "lang").withColumn("place", place).filter(F.col("place") <= rows).collect()
    chosen = docs.sparkSession.createDataFrame([(r["doc_id"], r["lang"], r["place"]) for r in first], "_id long, _lang string, place int")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("lang") == F.col("_lang"))
    texts = labelled.select("doc_id", "lang", "text").join(F.broadcast(chosen), same).select("lang", "place", "text")
    # a blank goes before each text
    kept = even_starts(texts, "lang", most - rows).select("lang", "place", F.encode("text", "UTF-8").alias("text")).collect()
    out: dict[str, bytes] = {}
    for r in sorted(kept, key=lambda r: (r["lang"], r["place"], bytes(r["text"]))):
        out[r["lang"]] = (out.get(r["lang"], b"") + b" " + bytes(r["text"]))[:most]
    return out


def predict(docs: DataFrame, samples: dict[str, bytes]) -> DataFrame:
    """(doc_id, lang_pred, score) of whole texts; only the text is read.

    ``score`` is the share of phrases that the winner saves against the second.
    NULL texts and texts without a letter are ``und`` with score 0; so are all if
    nothing was learned.  Of equal languages the first by name wins.  Repeated rows
    get equal answers; other columns of ``docs`` are ignored.
    """
    answer = _answers(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                lang, score = answer(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep(docs: DataFrame, samples: dict[str, bytes]) -> DataFrame:
    """The rows with a predicted language, all their columns unchanged; no shuffle."""
    answer = _answers(samples)
    return kept_rows(docs, lambda text: answer(text)[0] != UNKNOWN)


def _answers(samples: dict[str, bytes]):
    """A function from a text column to (languages, scores)."""
    names = sorted(samples)
    learned = tuple(samples[n] for n in names)

    def answer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, bounds = flat(column)
        text, at = symbols(data, bounds)
        among = lambda hit: np.diff(np.concatenate([[0], np.cumsum(hit)])[at]) > 0
        letters = among((text > 0) & (text < 27))
        for r in np.flatnonzero(~letters & among(text > 0)):
            letters[r] = any(c.isalpha() for c in data[bounds[r]: bounds[r + 1]].tobytes().decode())
        lang, score = np.full(len(letters), UNKNOWN, dtype=object), np.zeros(len(letters))
        if learned:
            need = phrases(learned, text, at) / np.maximum(np.diff(at), 1)[:, None]
            lang[letters] = np.array(names, dtype=object)[np.argmin(need, axis=1)[letters]]
            ranked = np.sort(need, axis=1)
            second = ranked[:, 1] if len(names) > 1 else np.ones(len(need))
            score = np.where(letters, 1 - ranked[:, 0] / np.maximum(second, 1e-12), 0.0)
        return lang, np.clip(score, 0, 1)

    return answer


def op8(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return predict(docs, sample(docs)).select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
