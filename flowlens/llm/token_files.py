"""Token ids in flat binary files with 64-bit document offsets.

Layout of a data set (a folder on storage that driver and executors share):
for each range of document ids one triple of little-endian files,
``<part>.bin`` (token ids, unsigned 16 or 32 bits by the vocabulary's size),
``<part>.idx`` (unsigned 64-bit: the first id of each document in the .bin,
and the end) and ``<part>.doc`` (signed 64-bit document ids), plus the table
``manifest`` that names the files of the tasks that succeeded and their sizes.
A document's place in the whole is its part's base, a prefix sum over the
manifest, plus its offset in the part. Readers memory-map the files where the
storage is a mounted folder.

Documents are ranged by id, sorted within a range, encoded and written in one
pass; the texts are shuffled once. File names hold a random part, so a task
that runs twice never writes into the files of another attempt.

Edge cases: null ids come first (``n_null`` in the manifest counts them);
equal ids keep the order of the input; null and empty texts are the end id
alone; an empty table gives no parts; texts are encoded whole.
"""

from __future__ import annotations

import array
import gc
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlens.session import scratch_path

from . import common as C
from .pieces import PieceCache

#: Marks that often follow a word.
ENDS = ".,!?;:"
#: Bytes of pieces that are encoded at once.
JOINED_BYTES = 1 << 14
MANIFEST = "part int, name string, n_docs long, n_null long, n_tokens long, width int"


class Encoder:
    """Token ids of texts as bytes, by the tokenizers library; the ids of
    recurring pieces come from a cache. Others are given to the library joined,
    up to ``JOINED_BYTES`` at once, and their ids are told apart by the bytes
    that each id stands for."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab(with_added_tokens=True)
        top = max(vocab.values())
        self.dtype = np.dtype("<u2" if top < 1 << 16 else "<u4")
        added = self.tok.get_added_tokens_decoder()
        #: Bytes of text of each id: an entry of the vocabulary has a character for each byte.
        self.n_bytes = np.zeros(top + 1, np.int64)
        for token, i in vocab.items():
            self.n_bytes[i] = len(added[i].content.encode()) if i in added else len(token)
        self.pieces = PieceCache(self.encode_pieces)
        self.marks = dict(zip(ENDS, self.encode_texts(list(ENDS)), strict=True))

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """A mark after letters is a token run of its own, so a word followed
        by one is encoded as the word and the mark, each looked up first."""
        held, marks = self.pieces.held, self.marks
        ids: dict[str, bytes] = {}
        todo: dict[str, None] = {}
        marked = []
        for p in pieces:
            if p[-1:] in marks and p[:-1].removeprefix(" ").isalpha():
                word = p[:-1]
                marked.append((p, word))
                known = held.get(word[1:]) if word[0] == " " else None
                if known is None:
                    todo[word] = None
                else:
                    ids[word] = known
            else:
                todo[p] = None
        words = [p for p in todo if p[:1] == " " and not p[-1].isspace()]
        ids.update(zip(words, self.encode_joined(words), strict=True))
        rest = [p for p in todo if p not in ids]
        ids.update(zip(rest, self.encode_texts(rest), strict=True))
        for p, word in marked:
            ids[p] = ids[word] + marks[p[-1]]
        return [ids[p] for p in pieces]

    def encode_joined(self, words: list[str]) -> list[bytes]:
        """Ids of pieces that begin with a space and don't end in white space.
        Joined, they are cut there again, so they have the ids of the single
        ones; if the ids' bytes don't end where the pieces do (an added token
        that spans two, say), the pieces go one by one."""
        out: list[bytes] = []
        size = self.dtype.itemsize
        data = np.frombuffer("".join(words).encode(), np.uint8)
        chars = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        offs = chars[np.cumsum([0, *map(len, words)])]  # in bytes
        for i, j in C.chunks(offs, JOINED_BYTES):
            coded = self.encode_texts(["".join(words[i:j])])[0]
            ends = np.cumsum(self.n_bytes[np.frombuffer(coded, self.dtype)])
            want = offs[i + 1 : j + 1] - offs[i]
            at = np.searchsorted(ends, want)
            if len(ends) and ends[-1] == want[-1] and (ends[at] == want).all():
                cuts = [0, *((at + 1) * size).tolist()]
                out += [coded[a:b] for a, b in zip(cuts, cuts[1:])]
            else:
                out += self.encode_texts(words[i:j])
        return out

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        kind = "H" if self.dtype.itemsize == 2 else "I"
        return [array.array(kind, e.ids).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str | None], end: bytes) -> list[bytes]:
        gc.disable()  # strings and bytes only: no cycles to look for
        try:
            return [b"".join(p) + end for p in self.pieces.texts(texts)]
        finally:
            gc.enable()


_encoders: dict[str, Encoder] = {}  # one for each worker and file


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker on each core
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_token_files(docs: DataFrame, out_dir: str, path: str, end_id: int = 0,
                      doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the data set and returns its manifest (a table in ``out_dir``)."""
    spark = docs.sparkSession
    parts = C.input_partitions(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        name = f"{part:06d}-{uuid.uuid4().hex[:12]}"
        fs, base = _filesystem(out_dir)
        enc = encoder(path)
        end = np.array([end_id], enc.dtype).tobytes()
        sizes, ids, n_null, out = [], [], 0, None
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                fs.create_dir(base, recursive=True)
                out = fs.open_output_stream(f"{base}/{name}.bin")
            n_null += b.column(0).null_count
            ids.append(b.column(0).fill_null(0).to_numpy())
            col = b.column(1)
            _, offs = C.text_bytes(col)
            for i, j in C.chunks(offs):
                coded = enc.encode(col.slice(i, j - i).to_pylist(), end)
                sizes += [len(x) // enc.dtype.itemsize for x in coded]
                out.write(b"".join(coded))
        if out is None:
            return
        out.close()
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype("<u8")
        for kind, a in (("idx", offsets), ("doc", np.concatenate(ids).astype("<i8"))):
            with fs.open_output_stream(f"{base}/{name}.{kind}") as f:
                f.write(a.tobytes())
        yield pa.RecordBatch.from_pydict(
            {"part": pa.array([part], pa.int32()), "name": [name], "n_docs": [len(sizes)], "n_null": [n_null],
             "n_tokens": [int(offsets[-1])], "width": pa.array([enc.dtype.itemsize], pa.int32())})

    rows = (docs.select(docs[doc_id].cast("long").alias("id"), docs[text].cast("string").alias("text"))
            .withColumn("at", F.monotonically_increasing_id())
            .repartitionByRange(parts, F.col("id").asc_nulls_first(), "at")
            .sortWithinPartitions(F.col("id").asc_nulls_first(), "at").select("id", "text"))
    C.map_batches(rows, run, MANIFEST).write.mode("overwrite").parquet(f"{out_dir}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{out_dir}/manifest")


def _mapped(fs: pafs.FileSystem, path: str, dtype) -> np.ndarray:
    if isinstance(fs, pafs.LocalFileSystem):
        import os

        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def read_token_files(spark: SparkSession, out_dir: str) -> DataFrame:
    """One row for each document of the data set, in any order: doc_id, start,
    n_tokens and ids_crc32, read from the files."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{out_dir}/manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                fs, base = _filesystem(out_dir)
                ids = _mapped(fs, f"{base}/{r['name']}.bin", f"<u{r['width']}")
                at = _mapped(fs, f"{base}/{r['name']}.idx", "<u8").astype(np.int64)
                doc = _mapped(fs, f"{base}/{r['name']}.doc", "<i8")
                if len(ids) != r["n_tokens"] or len(doc) != r["n_docs"]:
                    raise ValueError(f"{r['name']}: file sizes differ from the manifest")
                for s in range(0, len(doc), 4096):
                    e = min(s + 4096, len(doc))
                    crc = [zlib.crc32(ids[at[i]:at[i + 1]].astype("<u4").tobytes()) for i in range(s, e)]
                    null = np.arange(s, e) < r["n_null"]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.asarray(doc[s:e]), mask=null), pa.array(at[s:e] + r["base"]),
                         pa.array(at[s + 1:e + 1] - at[s:e]), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return C.map_batches(based.repartition(C.input_partitions(spark)), run, schema)


def token_files(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """Writes ``docs`` as a data set in the shared scratch folder and reads it back."""
    out_dir = scratch_path(docs.sparkSession, "token-files")
    write_token_files(docs, out_dir, path, end_id)
    return read_token_files(docs.sparkSession, out_dir)
