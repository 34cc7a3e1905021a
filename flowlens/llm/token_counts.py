"""Token counts by heap-and-linked-list byte-pair merging.

A pre-token starts as one symbol for each UTF-8 byte. A heap holds the
adjacent pairs that have a merge rank; the lowest rank is popped (leftmost
first among equals), its two symbols become one in a linked list, and the two
new neighbouring pairs are pushed. Stale heap entries are skipped. The count
of a pre-token is its bytes less its merges; no token ids are made.

Per document: one scan, no shuffle. A bounded cache in each Python worker
holds the counts of pieces and pre-tokens, which recur.

Edge cases: null and empty texts have 0 bytes and 0 tokens; a special string
inside a text is one token, as the tokenizer file's default has it; texts are
counted whole; repeated rows are counted each by itself.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import common as C
from .pieces import CACHE_ENTRIES, PieceCache

# Fixed value: the public split pattern of byte-level BPE.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it is
    printable Latin-1, else the next free code point from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in own else next(spare)) for b in range(256)]


class MergeCounter:
    """Counts tokens of texts from a byte-level BPE tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.rank = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.symbol = byte_symbols()
        self.split = regex.compile(SPLIT).findall
        special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.known: dict[str, int] = {}
        self.pieces = PieceCache(self.count_pieces)

    def count_pretoken(self, token: str) -> int:
        """Bytes less merges."""
        rank = self.rank
        sym: list = [self.symbol[b] for b in token.encode("utf-8", "surrogatepass")]
        n = len(sym)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank.get((sym[i], sym[i + 1]))) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            r, i = heapq.heappop(heap)
            j = nxt[i] if sym[i] is not None else n
            if j >= n or rank.get((sym[i], sym[j])) != r:
                continue  # one of the two has been merged meanwhile
            sym[i] += sym[j]
            sym[j] = None
            merges += 1
            k = nxt[i] = nxt[j]
            if k < n:
                prv[k] = i
                if (r := rank.get((sym[i], sym[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            h = prv[i]
            if h >= 0 and (r := rank.get((sym[h], sym[i]))) is not None:
                heapq.heappush(heap, (r, h))
        return n - merges

    def _plain(self, text: str) -> int:
        total, known = 0, self.known
        for t in self.split(text):
            n = known.get(t)
            if n is None:
                n = self.count_pretoken(t)
                if len(t) <= 64:
                    if len(known) >= CACHE_ENTRIES:
                        known.clear()
                    known[t] = n
            total += n
        return total

    def count_pieces(self, pieces: list[str]) -> list[int]:
        special, out = self.special, []
        for p in pieces:
            if special and special.search(p):
                out.append(sum(map(self._plain, special.split(p))) + len(special.findall(p)))
            else:
                out.append(self._plain(p))
        return out

    def count(self, texts: list[str | None]) -> list[int]:
        return list(map(sum, self.pieces.texts(texts)))


_counters: dict[str, MergeCounter] = {}  # one for each worker and file


def counter(path: str) -> MergeCounter:
    if path not in _counters:
        _counters[path] = MergeCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, path: str, limit: int = 512, text: str = "text",
                 keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` of every row, n_bytes, n_tokens and over_limit. ``path`` names
    the tokenizer file on every executor."""
    types = dict(docs.select(*keep).dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in keep] + ["n_bytes long", "n_tokens long", "over_limit boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for b in batches:
            col = b.column(b.num_columns - 1)
            _, offs = C.text_bytes(col)
            tokens: list[int] = []
            for i, j in C.chunks(offs):
                tokens += count(col.slice(i, j - i).to_pylist())
            n = pa.array(tokens, pa.int64())
            over = pa.array([x > limit for x in tokens], pa.bool_())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(offs[1:] - offs[:-1]), n, over],
                                             names=[*keep, "n_bytes", "n_tokens", "over_limit"])

    return C.map_batches(docs.select(*keep, docs[text].cast("string").alias("__text")), run, schema)
