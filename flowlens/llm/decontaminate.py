"""Benchmark decontamination by winnowing.

Words are lower-cased (A-Z) runs of digits, letters and non-ASCII characters.
A benchmark item's windows are its runs of ``span`` consecutive words; an item
with fewer words is one window. Fingerprints of a text are the smallest of
each ``span - gram + 1`` consecutive gram hashes (the rightmost of equals), so
any two texts that share ``span`` words share a fingerprint at the same place.
For items shorter than ``span`` every n-gram of their length is a fingerprint.

Plan: one scan of the documents makes their fingerprints. A bitmap of fixed
size (``FILTER_BITS``) over the benchmark's fingerprints goes to the tasks;
documents without a set bit need nothing more, the others keep their text and
their possible hits. Those are joined with the benchmark on the fingerprint,
and each (document, item, diagonal) is extended over all words of the item,
comparing the words themselves. Document ids never meet in one task; no
fingerprint of a document reaches the driver.

Edge cases: null or empty texts have no words and no hits; items without id
or words are no items; rows of the benchmark that repeat count once (an item
is its id); repeated documents are judged each by itself; a text is used
whole; an empty table on either side gives no hits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.session import write_scratch

from . import common as C

U64 = C.U64
#: Bits of the fingerprint filter: 4 MB at most on the driver and in a worker.
FILTER_BITS = 1 << 25
WORDS = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.translate(str.maketrans(UPPER, LOWER)))


def winnow(g: np.ndarray, width: int) -> np.ndarray:
    """Positions of the smallest value (rightmost of equals) of every
    ``width`` consecutive gram hashes."""
    m = len(g) - width + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    best, at = g[:m].copy(), np.arange(m)
    for j in range(1, width):
        less = g[j : m + j] <= best
        best = np.where(less, g[j : m + j], best)
        at = np.where(less, np.arange(j, m + j), at)
    return np.unique(at)


def fingerprints(h: np.ndarray, span: int, gram: int, short: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, word position) of a text with word hashes ``h``: winnowed grams,
    and every n-gram of each length in ``short``."""
    g = C.gram_hash(h, gram)
    at = winnow(g, span - gram + 1)
    fps, pos = [g[at]], [at]
    for n in short:
        s = C.mix64(C.gram_hash(h, n) + U64(0x5851F42D4C957F2D))  # apart from the winnowed grams
        fps.append(s)
        pos.append(np.arange(len(s)))
    return np.concatenate(fps), np.concatenate(pos)


def _list_array(offs: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), values)


def _fingerprint_rows(b: pa.RecordBatch, i: int, j: int, span: int, gram: int, short: tuple[int, ...],
                      wanted: np.ndarray | None) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Word counts, lists of fingerprints and lists of their places of rows i..j."""
    data, offs = C.text_bytes(b.column(b.num_columns - 1).slice(i, j - i))
    w = C.Words(C.LOWER[data], offs, C.ALNUM)
    h = w.hash()
    sizes, fps, pos = [0], [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for r in range(j - i):
        f, p = fingerprints(h[w.first[r] : w.first[r + 1]], span, gram, short)
        if wanted is not None and len(f):
            bit = f & U64(FILTER_BITS - 1)
            hit = (wanted[bit >> U64(3)] >> (bit & U64(7)).astype(np.uint8)) & 1 > 0
            f, p = f[hit], p[hit]
        sizes.append(len(f))
        fps.append(f)
        pos.append(p)
    at = np.cumsum(sizes)
    return (np.diff(w.first), _list_array(at, pa.array(np.concatenate(fps).view(np.int64))),
            _list_array(at, pa.array(np.concatenate(pos).astype(np.int32))))


def _filter_bits(bench_fps: DataFrame) -> np.ndarray:
    """The fixed-size bitmap of the benchmark's fingerprints. Spark sets the
    bits; the driver gets at most FILTER_BITS / 8 bytes."""
    bit = F.col("fp").bitwiseAND(F.lit(FILTER_BITS - 1))
    # bitmap_bucket_number / bitmap_bit_position number from 1
    rows = (bench_fps.select((bit + 1).alias("b"))
            .groupBy(F.bitmap_bucket_number("b").alias("k"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("m")).collect())
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in rows:
        chunk = np.frombuffer(bytes(r["m"]), np.uint8)
        out[(r["k"] - 1) * len(chunk) : r["k"] * len(chunk)] = chunk
    return out


def hit_spans(doc: list[str], item: list[str], diagonal: int, span: int) -> list[tuple[int, int]]:
    """Runs of document words inside windows of the item along a diagonal
    (document place less item place): [start, end)."""
    need = min(span, len(item))
    out, run = [], 0
    for i in range(len(item) + 1):
        d = i + diagonal
        if i < len(item) and 0 <= d < len(doc) and doc[d] == item[i]:
            run += 1
        else:
            if run >= need:
                out.append((d - run, d))
            run = 0
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, span: int = 10, gram: int = 5,
                  doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """For every row of ``docs``: doc_id, ``keep``, n_words, n_hit (words
    inside an occurrence of a window), items (sorted ids as strings)."""
    spark = docs.sparkSession

    def item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [words_of(t) if t else [] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.list_(pa.string()))], names=["item", "words"])

    items = (benchmark.select(benchmark[item_id].cast("string").alias("item"), benchmark[item_text].cast("string").alias("t"))
             .where("item is not null and t is not null").distinct())
    items = write_scratch(C.with_row_id(C.map_batches(items, item_rows, "item string, words array<string>")
                                        .where("size(words) > 0"), "entry"), "decontam-items")
    # at most span - 1 lengths
    short = tuple(sorted(r[0] for r in items.select(F.size("words").alias("n")).where(F.col("n") < span).distinct().collect()))

    def bench_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: dict[str, list] = {"entry": [], "fp": [], "ipos": []}
            for entry, words in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                # hashed as documents are; an item takes only its own length of the short ones
                one = C.text_bytes(pa.array([" ".join(words)]))
                h = C.Words(*one, C.ALNUM).hash()
                f, p = fingerprints(h, span, gram, (len(words),) if len(words) < span else ())
                rows["entry"] += [entry] * len(f)
                rows["fp"] += f.view(np.int64).tolist()
                rows["ipos"] += p.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(rows["entry"], pa.int64()), pa.array(rows["fp"], pa.int64()),
                                              pa.array(rows["ipos"], pa.int32())], names=list(rows))

    bench_fps = write_scratch(C.map_batches(items.select("entry", "words"), bench_rows, "entry long, fp long, ipos int"), "decontam-bench")
    bits = spark.sparkContext.broadcast(_filter_bits(bench_fps).tobytes())  # FILTER_BITS / 8 bytes, whatever the tables

    def doc_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.frombuffer(bits.value, np.uint8)
        for b in batches:
            _, offs = C.text_bytes(b.column(b.num_columns - 1))
            for i, j in C.chunks(offs):
                n, fps, pos = _fingerprint_rows(b, i, j, span, gram, short, wanted)
                text_col = b.column(b.num_columns - 1).slice(i, j - i)
                none = np.diff(fps.offsets.to_numpy()) == 0
                kept = text_col.take(pa.array(np.arange(j - i), mask=none))
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(i, j - i) for c in b.columns[:-1]), pa.array(n), kept, fps, pos],
                    names=[*names, "n_words", "text", "fps", "pos"])

    names = [f"c{k}" for k in range(len(keep) + 1)]  # clear of any name of the input
    picked = docs.select(*(docs[c].alias(n) for c, n in zip((doc_id, *keep), names, strict=True)), docs[text].cast("string").alias("text"))
    schema = ", ".join([f"{n} {t}" for n, t in picked.dtypes[:-1]] + ["n_words long", "text string", "fps array<long>", "pos array<int>"])
    scanned = write_scratch(C.with_row_id(C.map_batches(picked, doc_rows, schema)), "decontam-docs")

    seeds = (scanned.where("size(fps) > 0").select("row_id", F.explode(F.arrays_zip("fps", "pos")).alias("s"))
             .select("row_id", F.col("s.fps").alias("fp"), F.col("s.pos").alias("dpos")))
    pairs = (seeds.join(bench_fps, "fp").select("row_id", "entry", (F.col("dpos") - F.col("ipos")).alias("diagonal"))
             .groupBy("row_id", "entry").agg(F.collect_set("diagonal").alias("diagonals")))  # at most a text's places
    tasks = (pairs.join(items, "entry").join(scanned.select("row_id", "text"), "row_id")
             .select("row_id", "item", "words", "diagonals", "text"))

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, [])
        for b in batches:
            out: dict[str, list] = {"row_id": [], "item": [], "a": [], "b": []}
            for row, item, words, diagonals, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if last[0] != row:
                    last = (row, words_of(text))
                for s, e in sorted({x for d in diagonals for x in hit_spans(last[1], words, d, span)}):
                    for k, v in zip(out, (row, item, s, e), strict=True):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["row_id"], pa.int64()), pa.array(out["item"], pa.string()),
                                              pa.array(out["a"], pa.int64()), pa.array(out["b"], pa.int64())], names=list(out))

    hits = C.map_batches(tasks, extend, "row_id long, item string, a long, b long")
    before = Window.partitionBy("row_id").orderBy("a", "b", "item").rowsBetween(Window.unboundedPreceding, -1)
    found = (hits.withColumn("upto", F.coalesce(F.max("b").over(before), F.lit(0)))
             .groupBy("row_id").agg(F.sum(F.greatest(F.lit(0), F.col("b") - F.greatest("a", "upto"))).alias("n_hit"),
                                    F.sort_array(F.collect_set("item")).alias("items")))
    return (scanned.select("row_id", *names, "n_words").join(found, "row_id", "left")
            .select(*(F.col(n).alias(c) for n, c in zip(names, (doc_id, *keep), strict=True)), "n_words",
                    F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items")))
