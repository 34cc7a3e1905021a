"""Near-duplicate join on word n-grams by chosen paths.

A text is the set of hashes of its runs of five words (a shorter text: the
hash of all its words). Texts with equal sets form one class of copies and are
handled once. For two sets x, y to be joined their Jaccard similarity must be
at least ``similarity`` (0.8).

Chosen paths: at a node of a run's tree each set picks those of its tokens
whose node hash is below 1 / (similarity * size), 1.25 on average, and goes to
the children that they name. Two similar sets share one picked token or more
on average at each node, so they keep meeting. A node with few sets is a
bucket: brute force. A node with more is split again, ``levels`` deep. A run
finds a pair of similarity exactly 0.8 with probability q1 = 1 - 1/e in
buckets at the first level, 1 - exp(-q1) at the second and so on; runs are
repeated until the probability to miss it falls below 1 - ``recall``. A node
that is still large at the last level (a large group of near copies) is
compared exactly, tile by tile.

In buckets 64 minhash values decide which sets are candidates (four standard
deviations below the threshold); candidates meet in connected components, and
there the whole sets decide: all pairs of a component, by exact intersection
counts in tiles of bounded size. Tiles give one row for each set (its links)
and the edges of a spanning forest, never the pairs. So copies are counted,
not expanded, and every link between different texts of a component counts.

Edge cases: rows without words or without doc_id have no links and are a
class of their own (class_id is their doc_id); repeated rows count as copies;
texts are used whole; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.session import write_scratch

from . import common as C
from .components import connected_components

U64 = C.U64
SKETCH = 64
SLACK = 0.2


@dataclass(frozen=True)
class JoinParams:
    """``bucket`` sets at most are compared by brute force at a node that
    could still be split, ``tile`` at most on each side of a tile (and
    ``tile_tokens`` tokens). Neither drops anything: more sets are split
    further, or compared in more tiles."""

    similarity: float = 0.8
    words: int = 5
    recall: float = 0.99
    levels: int = 3
    bucket: int = 1000
    tile: int = 1000
    tile_tokens: int = 2_000_000
    seed: int = 20240229

    @property
    def runs(self) -> int:
        q = 1.0
        for _ in range(self.levels):
            q = 1 - math.exp(-q)
        return max(1, math.ceil(math.log(1 - self.recall) / math.log(1 - q)))


def shingles(data: np.ndarray, offs: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted token set of each text of a chunk."""
    w = C.Words(data, offs, C.SPACED)
    h, g = w.hash(), None
    out = []
    g = C.gram_hash(h, n)
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        if b - a >= n:
            out.append(np.unique(g[a : b - n + 1]))
        else:
            out.append(C.gram_hash(h[a:b], b - a) if b > a else np.zeros(0, U64))
    return out


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    two = [int(np.add.reduce(C.mix64(s ^ U64(c)))) for c in (0x6A09E667F3BCC908, 0xBB67AE8584CAA73B)]
    return tuple(x - (1 << 64) if x >> 63 else x for x in two)


def _picked(s: np.ndarray, nodes: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, token) index pairs that nodes pick from a set."""
    if len(s) * len(nodes) <= 1 << 22:
        return np.nonzero(s[None, :] * (nodes | U64(1))[:, None] <= below)
    each = [np.flatnonzero(s * (x | U64(1)) <= below) for x in nodes]
    return np.repeat(np.arange(len(nodes)), [len(x) for x in each]), np.concatenate(each)


def paths(s: np.ndarray, roots: np.ndarray, levels: int, similarity: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level the (parent, key) of every node that a set reaches."""
    below = U64(min(2**64 - 1, int(2**64 / max(1.0, similarity * len(s)))))
    out, nodes = [], roots
    for _ in range(levels):
        at, token = _picked(s, nodes, below)
        keys = C.mix64(nodes[at] ^ C.mix64(s[token]))
        out.append((nodes[at], keys))
        nodes = keys
    return out


def sketch(s: np.ndarray, mults: np.ndarray) -> bytes:
    """64 minhash values of 16 bits."""
    if len(s) <= 1 << 14:
        low = (s[None, :] * mults[:, None]).min(axis=1)
    else:
        low = np.array([(s * m).min() for m in mults])
    return (C.mix64(low) >> U64(48)).astype("<u2").tobytes()


def _roots(seed: int, n: int) -> np.ndarray:
    return C.mix64(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


def _longs(lists: list[np.ndarray]) -> pa.Array:
    offs = np.cumsum([0, *map(len, lists)])
    return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(np.concatenate([np.zeros(0, U64), *lists]).view(np.int64)))


def sketch_rows(docs: DataFrame, p: JoinParams) -> DataFrame:
    """doc_id, mark, size, digest, minhash sketch and path keys of every text;
    ``docs`` has doc_id, text and mark."""
    roots, mults = _roots(p.seed, p.runs), _roots(p.seed + 1, SKETCH) | U64(1)
    deeper = range(2, p.levels + 1)
    schema = ("doc_id long, mark long, n int, k1 long, k2 long, sig binary, key1 array<long>, "
              + ", ".join(f"parent{d} array<long>, key{d} array<long>" for d in deeper)).rstrip(", ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = C.text_bytes(b.column(1))
            for i, j in C.chunks(offs):
                sets = shingles(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], p.words)
                ways = [paths(s, roots, p.levels, p.similarity) if len(s) else [(s, s)] * p.levels for s in sets]
                names = [digest(s) for s in sets]
                cols = [b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), pa.array([len(s) for s in sets], pa.int32()),
                        pa.array([x for x, _ in names], pa.int64()), pa.array([x for _, x in names], pa.int64()),
                        pa.array([sketch(s, mults) if len(s) else None for s in sets], pa.binary()),
                        _longs([w[0][1] for w in ways])]
                for d in deeper:
                    cols += [_longs([w[d - 1][0] for w in ways]), _longs([w[d - 1][1] for w in ways])]
                yield pa.RecordBatch.from_arrays(cols, names=[c.split(" ")[0] for c in schema.split(", ")])

    return C.map_batches(docs.select("doc_id", "text", "mark"), run, schema)


def text_mark(text: str) -> F.Column:
    """Tells rows of one id apart by their text."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def _buckets(sets: DataFrame, p: JoinParams) -> DataFrame:
    """(key, tile, nid) of the nodes to compare, splitting large nodes again."""
    at = sets.select("nid", F.explode("key1").alias("key"))
    out = None
    for level in range(1, p.levels + 1):
        shared = at.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
        at = write_scratch(at.join(shared, "key"), "path-nodes")
        last = level == p.levels
        small = at.where(F.col("c") <= p.bucket).select("key", F.lit(0).alias("tile"), "nid")
        out = small if out is None else out.unionByName(small)
        large = at.where(F.col("c") > p.bucket)
        if large.isEmpty():
            break
        if last:
            out = out.unionByName(_tiled(large.withColumn("side", F.ceil(F.col("c") / p.tile).cast("int")), "side").select("key", "tile", "nid"))
        else:
            split = large.select(F.col("key").alias("parent")).distinct()
            d = level + 1
            at = (sets.select("nid", F.explode(F.arrays_zip(F.col(f"parent{d}").alias("parent"), F.col(f"key{d}").alias("key"))).alias("x"))
                  .select("nid", F.col("x.parent").alias("parent"), F.col("x.key").alias("key"))
                  .join(split, "parent").select("nid", "key"))
    return out


def _tiled(rows: DataFrame, blocks: str) -> DataFrame:
    """Deals the sets of a group into ``blocks`` blocks and each set to the
    tiles (pairs of blocks) that its block is part of."""
    own = F.pmod(F.xxhash64("nid"), F.col(blocks)).cast("int")
    return (rows.withColumn("block", own)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col(blocks).cast("int") - 1)))
            .withColumn("within", F.col("block") == F.col("other"))  # a tile of one block, not of two of which one is empty
            .withColumn("tile", F.least("block", "other") * F.col(blocks).cast("int") + F.greatest("block", "other")))


def forest(n: int, similar) -> list[tuple[int, int]]:
    """A spanning forest (root, node) of n items; ``similar(i, others)`` tells
    which of the others are joined with i. An item that has been reached is
    never compared again with what has been reached before it."""
    left, out = np.arange(n), []
    while len(left) > 1:
        root, left = left[0], left[1:]
        queue = [root]
        while queue and len(left):
            hit = similar(queue.pop(), left)
            if hit.any():
                found, left = left[hit], left[~hit]
                out += [(root, x) for x in found.tolist()]
                queue += found.tolist()
    return out


def _candidate_edges(buckets: DataFrame, sets: DataFrame, p: JoinParams) -> DataFrame:
    least = math.ceil((p.similarity - SLACK) * SKETCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[int] = []
        b: list[int] = []

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for _, g in C.sorted_groups(batches, 2):
            if g.num_rows < 2:
                continue
            nid = g.column("nid").to_numpy()
            sig = np.frombuffer(b"".join(g.column("sig").to_pylist()), "<u2").reshape(len(nid), SKETCH)
            if len(nid) == 2:
                pairs = [(0, 1)] if np.count_nonzero(sig[0] == sig[1]) >= least else []
            else:
                pairs = forest(len(nid), lambda i, o, sig=sig: np.count_nonzero(sig[o] == sig[i], axis=1) >= least)
            a += [int(nid[i]) for i, _ in pairs]
            b += [int(nid[j]) for _, j in pairs]
            if len(a) > 20_000:
                yield rows()
                a, b = [], []
        yield rows()

    rows = (buckets.join(sets.select("nid", "sig"), "nid").select("key", "tile", "nid", "sig")
            .repartition(C.input_partitions(sets.sparkSession), "key", "tile").sortWithinPartitions("key", "tile"))
    return C.map_batches(rows, run, "a long, b long").distinct()


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Exact intersection sizes of every set of a with every set of b."""
    if len(a) * len(b) <= 36:
        return np.array([[np.isin(x, y, assume_unique=True).sum() for y in b] for x in a], np.int64).reshape(len(a), len(b))
    va, vb = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(va, vb)
    out = np.zeros((len(a), len(b)), np.int64)
    ra, rb = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])

    def columns(v: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(both, v), max(0, len(both) - 1))
        ok = both[at] == v if len(both) else np.zeros(len(v), bool)
        at, r = at[ok], r[ok]
        order = np.argsort(at, kind="stable")
        return at[order], r[order]

    (ca, ra), (cb, rb) = columns(va, ra), columns(vb, rb)
    width = 4096
    for s in range(0, len(both), width):
        x, y = np.zeros((len(a), width), np.float32), np.zeros((len(b), width), np.float32)
        i, j = np.searchsorted(ca, [s, s + width])
        x[ra[i:j], ca[i:j] - s] = 1
        i, j = np.searchsorted(cb, [s, s + width])
        y[rb[i:j], cb[i:j] - s] = 1
        out += (x @ y.T).astype(np.int64)
    return out


def _verified(docs: DataFrame, sets: DataFrame, comp: DataFrame, p: JoinParams) -> DataFrame:
    """(a, b, links): a row for each set with its links to other sets in a
    tile (b null), and rows for the edges of a spanning forest."""
    near = sets.select("nid", "rep", "n", "copies", "k1", "k2").join(comp.withColumnRenamed("node", "nid"), "nid")
    blocks = (near.groupBy("component").agg(F.count("*").alias("c"), F.sum("n").alias("t"))
              .select("component", F.greatest(F.ceil(F.col("c") / p.tile), F.ceil(F.col("t") / p.tile_tokens)).cast("int").alias("blocks")))
    near = near.join(blocks, "component")
    texts = (docs.join(near, F.col("doc_id") == F.col("rep")).select("component", "blocks", "nid", "copies", "k1", "k2", "doc_id", "text")
             .dropDuplicates(["doc_id", "nid", "text"]).select("component", "blocks", "nid", "copies", "k1", "k2", "text"))

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = C.text_bytes(b.column(6))
            k1, k2 = b.column(4).to_pylist(), b.column(5).to_pylist()
            for i, j in C.chunks(offs):
                found = shingles(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], p.words)
                own = [digest(s) == (k1[i + r], k2[i + r]) for r, s in enumerate(found)]  # rows of one id may differ
                part = b.slice(i, j - i)
                part = pa.RecordBatch.from_arrays([*part.columns[:4], pa.array([s.tobytes() for s in found], pa.binary())],
                                                  names=["component", "blocks", "nid", "copies", "tokens"])
                yield part.filter(pa.array(own, pa.bool_()))

    rows = C.map_batches(texts, to_sets, "component long, blocks int, nid long, copies long, tokens binary")
    rows = (_tiled(rows, "blocks").select("component", "tile", "block", "within", "nid", "copies", "tokens")
            .repartition(C.input_partitions(docs.sparkSession), "component", "tile")
            .sortWithinPartitions("component", "tile", "block", "nid"))
    s = p.similarity / (1 + p.similarity)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            cols = list(zip(*held, strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b", "links"])

        for _, g in C.sorted_groups(batches, 2):
            nid, block, copies = (g.column(c).to_numpy() for c in ("nid", "block", "copies"))
            _, once = np.unique(nid, return_index=True)
            once = once[np.lexsort((nid[once], block[once]))]
            nid, block, copies = nid[once], block[once], copies[once]
            raw = g.column("tokens").to_pylist()
            sets = [np.frombuffer(raw[i], U64) for i in once]
            within = g.column("within")[0].as_py()
            cut = int(np.searchsorted(block, block[0], "right"))
            if not within and cut == len(nid):
                continue  # the other block has no sets
            a, b = (slice(0, cut), slice(cut, None)) if cut < len(nid) else (slice(None), slice(None))
            size = np.array([len(x) for x in sets])
            link = overlaps(sets[a], sets[b]) >= s * (size[a][:, None] + size[b][None, :]) - 1e-9
            if cut == len(nid):
                np.fill_diagonal(link, False)
                full = link
            else:
                full = np.zeros((len(nid), len(nid)), bool)
                full[a, b], full[b, a] = link, link.T
            total = full @ copies
            held += [(int(x), None, int(t)) for x, t in zip(nid, total, strict=True) if t]
            held += [(int(nid[i]), int(nid[j]), 0) for i, j in forest(len(nid), lambda i, o, full=full: full[i, o])]
            if len(held) > 20_000:
                yield out()
                held = []
        yield out()

    return C.map_batches(rows, compare, "a long, b long, links long")


def jaccard_join(docs: DataFrame, params: JoinParams | None = None, doc_id: str = "doc_id", text: str = "text", marks: bool = False) -> DataFrame:
    """For every row: doc_id, class_id (the smallest doc_id that links lead
    to) and n_links (other rows with similarity at or above the threshold);
    with ``marks`` also mark (``text_mark``) and class_no, which unlike
    class_id differs between classes whose smallest ids are equal (null: the
    row has no class)."""
    p = params or JoinParams()
    docs = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    rows = write_scratch(sketch_rows(docs.withColumn("mark", text_mark("text")), p), "sketches")
    deeper = [f"{c}{d}" for d in range(2, p.levels + 1) for c in ("parent", "key")]
    sets = write_scratch(
        rows.where("n > 0 and doc_id is not null").groupBy("k1", "k2")
        .agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("n", "sig", "key1", *deeper)))
        .transform(lambda d: C.with_row_id(d, "nid")), "sets")

    near = write_scratch(_candidate_edges(_buckets(sets, p), sets, p), "candidates")
    found = write_scratch(_verified(docs, sets, connected_components(near), p), "links")
    links = found.where("b is null").groupBy(F.col("a").alias("nid")).agg(F.sum("links").alias("links"))
    comp = connected_components(found.where("b is not null").select("a", "b"))
    named = sets.select("nid", "rep").join(comp.withColumnRenamed("node", "nid"), "nid")
    classes = named.groupBy("component").agg(F.min("rep").alias("class_id"))
    more = ["mark", "class_no"] if marks else []
    of_set = (sets.select("k1", "k2", "nid", "rep", "copies")
              .join(named.join(classes, "component").select("nid", "class_id", "component"), "nid", "left").join(links, "nid", "left")
              .select("k1", "k2", F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("component", "nid").alias("class_no"),
                      (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    lone = F.expr("n = 0 or doc_id is null")
    return (rows.select("doc_id", "mark", "n", "k1", "k2").join(of_set, ["k1", "k2"], "left")
            .select("doc_id", F.when(lone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                    F.when(lone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
                    *(F.when(~lone, F.col(c)).alias(c) if c == "class_no" else c for c in more)))
