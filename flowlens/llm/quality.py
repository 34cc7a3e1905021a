"""Quality rules by repetition coverage.

Words are runs of non-space characters. Rolling hashes of several n-gram
lengths mark the words inside n-grams that a text holds twice or more; hashes
of lines mark repeated lines. A text is rejected when too large a share of its
word characters lies inside duplicated n-grams of any length or on repeated
lines, or when symbols outnumber words too far.

Everything is per document: one scan, no shuffle. Texts go through numpy a
megabyte at a time, whole; a longer text is a chunk of its own.

Edge cases: null and empty texts have no words (all counts 0, base_failed,
not kept); repeated rows are judged each by itself; other columns pass
through unchanged where ``keep`` names them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C

U64 = C.U64


@dataclass(frozen=True)
class QualityParams:
    """Shares of word characters: the most that may lie inside duplicated
    n-grams of each length, and on lines that repeat an earlier one; and the
    most symbols to a word."""

    gram_share: dict[int, float] = field(default_factory=lambda: {5: 0.5, 7: 0.45, 10: 0.4})
    line_share: float = 0.5
    symbols_per_word: float = 0.3
    min_words: int = 50
    repeat_percent: int = 50


SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def _in_repeats(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs twice or more."""
    s = np.sort(keys)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    twice = np.unique(twice)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys


def _repeated_words(h: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Words inside an n-gram that its own text holds twice or more."""
    m = len(h) - n + 1
    out = np.zeros(len(h), bool)
    if m <= 0:
        return out
    own = np.flatnonzero(row[:m] == row[n - 1 :])  # windows inside one text
    g = C.gram_hash(h, n)[own]
    hit = own[_in_repeats(C.mix64(g ^ (row[own].astype(U64) * U64(0xA24BAED4963EE407))))]
    if len(hit):
        step = np.zeros(len(h) + 1, np.int64)
        np.add.at(step, hit, 1)
        np.add.at(step, hit + n, -1)
        out = np.cumsum(step[:-1]) > 0
    return out


def measure(data: np.ndarray, offs: np.ndarray, params: QualityParams) -> dict[str, np.ndarray]:
    """All measures of a chunk of texts, one value for each row."""
    w, rows = C.Words(data, offs, C.SPACED), len(offs) - 1
    h, cp = w.hash(), w.code_points()
    chars = cp[w.end] - cp[w.start]
    n_words, word_chars = np.diff(w.first), C.per_row(rows, w.row, chars)
    sym = np.concatenate([[0], np.cumsum(SYMBOLS[data])]) if len(data) else np.zeros(1, np.int64)
    n_symbols = sym[offs[1:]] - sym[offs[:-1]]

    # lines: cut at \n and at the ends of texts; only those with a word count
    cut = np.flatnonzero(data == 0x0A)
    start = np.unique(np.concatenate([offs[:-1], cut + 1]))
    start = start[start < len(data)]
    end = np.concatenate([start[1:], [len(data)]]).astype(np.int64) if len(start) else start
    row = np.searchsorted(offs, start, "right") - 1
    bare = np.where((end > start) & (data[np.maximum(end - 1, 0)] == 0x0A), end - 1, end) if len(start) else end
    has = np.searchsorted(w.start, bare) > np.searchsorted(w.start, start) if len(start) else np.zeros(0, bool)
    start, bare, row = start[has], bare[has], row[has]
    key = C.mix64(w.span_hash(start, bare) ^ (row.astype(U64) * U64(0xA24BAED4963EE407)))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    line_chars = np.zeros(rows, np.int64)
    if again.any():
        upto = np.concatenate([[0], np.cumsum(chars)])
        a, b = np.searchsorted(w.start, start[again]), np.searchsorted(w.start, bare[again])
        line_chars = C.per_row(rows, row[again], upto[b] - upto[a])

    out = {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols,
           "n_dup_lines": C.per_row(rows, row[again]),
           "n_repeat_words": C.per_row(rows, w.row[_repeated_words(h, w.row, 3)])}
    for n in params.gram_share:
        hit = _repeated_words(h, w.row, n)
        out[f"dup_chars_{n}"] = C.per_row(rows, w.row[hit], chars[hit])
    out["dup_line_chars"] = line_chars
    base = (n_words < params.min_words) | (100 * out["n_repeat_words"] > params.repeat_percent * n_words)
    bad = (line_chars > params.line_share * word_chars) | (n_symbols > params.symbols_per_word * n_words)
    for n, share in params.gram_share.items():
        bad |= out[f"dup_chars_{n}"] > share * word_chars
    return out | {"base_failed": base, "kept": ~base & ~bad}


def quality_rules(docs: DataFrame, params: QualityParams | None = None, text: str = "text",
                  keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row, the measures, base_failed and kept."""
    params = params or QualityParams()
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    more = [f"dup_chars_{n}" for n in params.gram_share] + ["dup_line_chars"]
    types = dict(docs.select(*keep).dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in keep] + [f"{c} long" for c in longs]
                       + ["base_failed boolean", "kept boolean"] + [f"{c} long" for c in more])
    names = longs + ["base_failed", "kept"] + more

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = C.text_bytes(b.column(b.num_columns - 1))
            parts = [measure(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], params) for i, j in C.chunks(offs)]
            if parts:
                cols = [pa.array(np.concatenate([p[c] for p in parts])) for c in names]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], names=[*keep, *names])

    picked = docs.select(*keep, docs[text].cast("string").alias("__text"))
    return C.map_batches(picked, run, schema)
