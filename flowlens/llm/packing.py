"""Packing tokenised documents into sequences by vector best-fit.

A document is its token ids and an end id, cut into pieces of at most
``tokens`` ids; only documents that are longer are cut. A sequence has three
capacities: tokens, documents and attention cost (the sum of squared lengths).
Pieces go in by falling length, each to the sequence that it fits under every
capacity and whose residual vector it leaves smallest (``norm``: weighted
squared norm of what remains) or with which it has the largest weighted dot
product (``dot``); where none fits, a new one is opened.

Pieces of one length are alike to the rule, and so are sequences that hold the
same lengths. The choice therefore runs on counts: a table of lengths (at most
``tokens`` rows, whatever the size of the corpus) becomes classes of sequences
of one pattern, each with the number of its sequences. A class is split only by
the last pieces of a length, so there are a few times ``tokens`` classes at
most. Every piece then finds its place by its number among the pieces of its
length: the number in its part, counted while the part is written, and a prefix
sum over the parts. No task holds the pieces of a length; texts are read once
and never shuffled.

Edge cases: a null or empty text is the end id alone; repeated rows and rows
without an id are documents of their own; an empty table has no sequences; a
piece that no empty sequence can hold is an error; texts of any length are
encoded whole, a slice at a time. Extra columns don't matter: the results have
their own.
"""

from __future__ import annotations

import array
from collections.abc import Iterator
from dataclasses import dataclass
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.session import write_scratch

from . import common as C

#: Characters of a text that are encoded at once, up to the next space.
SLICE_CHARS = 1 << 20
#: Words that a worker remembers; longer ones are encoded anew each time.
HELD_WORDS, HELD_CHARS = 1 << 20, 64
#: Marks that often end a word, and words that are encoded in one text.
MARKS, JOINED = ".,!?;:", 4096
#: Bytes of ids in an Arrow batch.
BATCH_BYTES = 8 << 20
#: Pieces of a part and length that share a row of the join.
BLOCK = 256
PIECE = "doc_id long, piece int, start long, length long, ids binary, part int, k long"


@dataclass(frozen=True)
class PackParams:
    """Capacities of a sequence. The documents and the attention cost that fit
    into ``tokens`` tokens are the default, so tokens alone bind."""
    tokens: int = 2048
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    rule: str = "norm"

    def capacity(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens**2], np.int64)


class WordEncoder:
    """Token ids of texts, little-endian unsigned 32-bit, where white space is
    dropped between words: a text may be cut at every space and line end."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.held: dict[str, bytes] = {"": b""}
        self.marks = dict(zip(MARKS, self.encode_each(list(MARKS)), strict=True))
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def compute(self, words: list[str]) -> list[bytes]:
        """A mark after letters is a pre-token of its own, and case is dropped:
        a word is its letters, looked up first, and its mark."""
        cut, todo = [], {}
        for w in words:
            mark = self.marks.get(w[-1])
            core = w[:-1] if mark is not None else w
            if core.isalpha() and core.lower().isalpha() and is_normalized("NFC", core):
                core = core.lower() if core.isascii() else core
                cut.append((core, mark or b""))
                if core not in self.held:
                    todo[core] = None
            else:
                cut.append((w, b""))
        plain = list(todo)
        for i in range(0, len(plain), JOINED):
            group = plain[i : i + JOINED]
            todo.update(zip(group, self.encode_side_by_side(group), strict=True))
        rest = list({w for w, _ in cut if w not in self.held and w not in todo})
        todo.update(zip(rest, self.encode_each(rest), strict=True))
        out = [(todo[w] if w in todo else self.held[w]) + mark for w, mark in cut]
        self.held.update((w, x) for w, x in todo.items() if len(w) <= HELD_CHARS)
        return out

    def encode_side_by_side(self, words: list[str]) -> list[bytes]:
        """Words of letters, encoded in one text: the last token of each is one
        that ends a word."""
        ids = np.array(self.tok.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words):
            return self.encode_each(words)
        at = [0, *(4 * ends).tolist()]
        data = ids.tobytes()
        return [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def encode_each(self, texts: list[str]) -> list[bytes]:
        return [array.array("I", e.ids).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def slice(self, text: str) -> bytes:
        words = text.replace("\n", " ").split(" ")
        ids = list(map(self.held.get, words))
        if None in ids:
            new = list(dict.fromkeys(w for w, x in zip(words, ids, strict=True) if x is None))
            fresh = dict(zip(new, self.compute(new), strict=True))
            ids = [fresh[w] if x is None else x for w, x in zip(words, ids, strict=True)]
            self.held.update((w, x) for w, x in fresh.items() if len(w) <= HELD_CHARS)
            if len(self.held) > HELD_WORDS:
                self.held = {"": b""}
        return b"".join(ids)

    def ids(self, text: str) -> Iterator[bytes]:
        at = 0
        while at < len(text):
            end = text.find(" ", at + SLICE_CHARS)
            end = len(text) if end < 0 else end
            yield self.slice(text[at:end])
            at = end


_encoders: dict[str, WordEncoder] = {}  # one for each worker and file


def word_encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker on each core
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def pieces_of(blocks: Iterator[bytes], size: int) -> Iterator[bytes]:
    """The stream of ids cut after every ``size`` ids."""
    held = b""
    for b in blocks:
        held += b
        whole = len(held) // (4 * size) * 4 * size
        for i in range(0, whole, 4 * size):
            yield held[i : i + 4 * size]
        held = held[whole:]
    if held:
        yield held


def cut_documents(docs: DataFrame, path: str, tokens: int = 2048, end_id: int = 0,
                  doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of every document, as a table in the shared folder: doc_id,
    piece, start, length and ids (little-endian unsigned 32-bit), and the
    piece's number ``k`` among those of its length in its ``part``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        enc = word_encoder(path)
        end = np.array([end_id], "<u4").tobytes()
        seen = np.zeros(tokens + 1, np.int64)
        rows: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            ids, piece, start, data, k = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array([len(x) // 4 for x in data], pa.int64()), pa.array(data, pa.binary()),
                 pa.array([part] * len(rows), pa.int32()), pa.array(k, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids", "part", "k"])

        def stream(t: str | None) -> Iterator[bytes]:
            yield from enc.ids(t or "")
            yield end

        for b in batches:
            for i in range(b.num_rows):
                doc = b.column(0)[i].as_py()
                for n, x in enumerate(pieces_of(stream(b.column(1)[i].as_py()), tokens)):
                    size = len(x) // 4
                    rows.append((doc, n, n * tokens, x, int(seen[size])))
                    seen[size] += 1
                    held += len(x)
                    if held >= BATCH_BYTES:
                        yield batch()
                        rows.clear()
                        held = 0
        if rows:
            yield batch()

    thin = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    return write_scratch(C.map_batches(thin, run, PIECE), "pieces")


class Places:
    """Where the pieces of a length go, by their number among them: arrays over
    the runs of a pattern, ordered by length and number."""

    def __init__(self, runs: list[tuple], counts: dict[int, int], n_sequences: int):
        runs = sorted(runs)
        self.n_sequences = n_sequences
        lengths = sorted(counts)
        self.before = np.zeros(max(lengths, default=0) + 1, np.int64)  # pieces of smaller lengths
        self.before[lengths] = np.concatenate([[0], np.cumsum([counts[x] for x in lengths])[:-1]]) if lengths else 0
        length, first, self.copies, self.sequence, self.offset = np.array(runs, np.int64).reshape(-1, 5).T.copy()
        self.first = first + self.before[length] if len(runs) else first

    def find(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequences and offsets of pieces."""
        number = number + self.before[length]
        at = np.searchsorted(self.first, number, "right") - 1
        rest, copies = number - self.first[at], self.copies[at]
        return self.sequence[at] + rest // copies, self.offset[at] + rest % copies * length


def best_fit(counts: dict[int, int], params: PackParams) -> Places:
    """Vector best-fit on the number of pieces of each length."""
    cap = params.capacity()
    weight = np.array(params.weights) / cap.astype(float) ** 2
    free = np.zeros((64, 3), np.int64)  # residual capacities of each class of sequences
    many: list[int] = []  # sequences in a class
    runs: list[list[list[int]]] = []  # its lengths and their copies

    def add(rest: np.ndarray, n: int, pattern: list[list[int]]) -> None:
        nonlocal free
        if len(many) == len(free):
            free = np.concatenate([free, np.zeros_like(free)])
        free[len(many)] = rest
        many.append(n)
        runs.append(pattern)

    def put(pattern: list[list[int]], size: int, copies: int) -> list[list[int]]:
        if pattern and pattern[-1][0] == size:
            return [*pattern[:-1], [size, pattern[-1][1] + copies]]
        return [*pattern, [size, copies]]

    for size in sorted(counts, reverse=True):
        item = np.array([size, 1, size * size], np.int64)
        if (item > cap).any():
            raise ValueError(f"a piece of {size} tokens exceeds the capacities {cap.tolist()} of an empty sequence")
        left = counts[size]
        while left:
            rest = free[: len(many)]
            fits = np.flatnonzero((rest >= item).all(axis=1))
            if len(fits):
                r = rest[fits]
                score = ((r - item) ** 2 * weight).sum(axis=1) if params.rule == "norm" else -(r * item * weight).sum(axis=1)
                at = int(fits[np.argmin(score)])
                # what was just filled stays the tightest fit, but has a smaller dot product
                copies = int((free[at] // item).min()) if params.rule == "norm" else 1
                n = min(many[at], left // copies)
                if n == 0:
                    copies, n = left, 1
                pattern, rest_after = put(runs[at], size, copies), free[at] - copies * item
                if n == many[at]:
                    free[at], runs[at] = rest_after, pattern
                else:
                    many[at] -= n
                    add(rest_after, n, pattern)
            else:
                copies = int((cap // item).min()) if params.rule == "norm" else 1
                n = left // copies
                if n == 0 or params.rule != "norm":
                    copies, n = min(left, copies), 1
                add(cap - copies * item, n, [[size, copies]])
            left -= n * copies
    out, first, sequence = [], dict.fromkeys(counts, 0), 0
    for n, pattern in zip(many, runs, strict=True):
        offset = 0
        for size, copies in pattern:
            out.append((size, first[size], copies, sequence, offset))
            first[size] += n * copies
            offset += size * copies
        sequence += n
    return Places(out, counts, sequence)


def pack(pieces: DataFrame, params: PackParams | None = None) -> DataFrame:
    """The rows of ``pieces`` (columns length, part and k as ``cut_documents``
    writes them; others pass through) with sequence_id and offset."""
    p = params or PackParams()
    in_part = write_scratch(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "pack-counts")
    counts = {r["length"]: r["n"] for r in in_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row for each length
    places = best_fit(counts, p)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = in_part.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # many pieces of one length in a part: dealt out in blocks
    base = base.select("length", "part", "base", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / BLOCK).cast("long"))).alias("block"))
    at = pieces.withColumn("block", F.floor(F.col("k") / BLOCK)).join(base, ["length", "part", "block"])
    at = at.withColumn("number", F.col("base") + F.col("k")).drop("block", "base")
    keep = [c for c in pieces.columns if c not in ("part", "k")]
    at = at.select(*keep, "number")
    fields = [*at.select(*keep).schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", sequence_id long, offset long"
    found = pieces.sparkSession.sparkContext.broadcast(places)  # at most a few rows for each length and class

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.schema.names
            length, number = (b.column(names.index(c)).to_numpy() for c in ("length", "number"))
            sequence, offset = found.value.find(length, number)
            yield pa.RecordBatch.from_arrays([*(b.column(names.index(c)) for c in keep), pa.array(sequence), pa.array(offset)],
                                             names=[*keep, "sequence_id", "offset"])

    return C.map_batches(at, run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, length, n_documents and ids, from
    packed pieces that carry their ids. A sequence is bounded by its capacity."""
    held = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.count("*").alias("n_documents"),
                                             F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("held"))
    joined = F.aggregate("held", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return held.select("sequence_id", "length", "n_documents", joined.alias("ids"))
