"""Divergence between the sources of a language, and the terms behind it.

Terms are runs of ASCII letters and non-ASCII characters, A-Z lower-cased. A
language keeps the V terms of at least ``min_documents`` of its documents. A
group (language and source) with N occurrences of kept terms gives each kept
term p = 1 + floor(10^9 * (count + 2) / (N + 2 V)); the divergence of two
values is f(p, q) = floor((p - q)^2 / (p + q)), summed over all kept terms for
a pair of sources, and taken for single terms against the whole language.

Most terms of a language don't occur in most sources. There p is the group's
baseline z, so a pair's sum is

    V f(z, z') + sum over the terms of the one of f(p, z') - f(z, z')
               + sum over the terms of the other of f(z, p') - f(z, z')
               + sum over common terms of f(p, p') - f(p, z') - f(z, p') + f(z, z').

The last line is a product of the group-term table with its own transpose, in
Gustavson's way: the table is dealt by term; a task holds a slice of the
term-major index, and each group of the slice scatters its terms through the
index into a dense accumulator over its peers. Only the accumulators leave the
task, never a pair of postings. The two lines before it need only how often a
group has each value p. All sums are integers and exact.

Skew: occurrences are added up in the task that reads them, so a group with a
third of all rows sends its terms once for each flush; the index is dealt by
(language, term), where a term has a row for each source; ``rank`` sorts the
peers of a group, and of its terms only the first ten of each task.

Edge cases: null text, lang and source are ''; each row is a document, repeated
ones too; a group without terms has rows for all its pairs; a language without
kept terms has values of 0 and no terms; a language with one source has no
pairs; an empty table gives no rows. Texts are counted whole, a slice at a
time. Other columns don't matter, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.session import write_scratch

from . import common as C

SCALE = 1_000_000_000
#: Maps A-Z to a-z and every ASCII character that isn't a letter to a space.
TERMS = bytes(c if c >= 0x80 or 0x61 <= c <= 0x7A else c + 0x20 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
#: Bytes of a text that are split at once.
SLICE_BYTES = 1 << 20
#: (group, term) entries that a counting task holds before it sends them on.
HELD_TERMS = 400_000
#: Postings of the index that a task holds, and products that it makes at once.
SLICE_POSTINGS, PRODUCTS = 1 << 20, 1 << 20


@dataclass(frozen=True)
class DivergenceParams:
    min_documents: int = 10
    top_terms: int = 10


def slices(text: bytes) -> Iterator[bytes]:
    """A text in slices that end between terms."""
    at = 0
    while at < len(text):
        end = text.find(b" ", at + SLICE_BYTES)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, text -> lang, source, term, n, docs, added up in the task;
    an empty term stands for the group itself."""
    n: dict[tuple, Counter] = {}
    docs: dict[tuple, Counter] = {}
    held = 0

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in n.items():
            d = docs[lang, source]
            held_terms = list(counts)
            for i in range(0, len(held_terms), 1 << 16):
                terms = held_terms[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()),
                     pa.array(terms, pa.binary()).cast(pa.string()), pa.array([counts[t] for t in terms], pa.int64()),
                     pa.array([d[t] for t in terms], pa.int64())], names=["lang", "source", "term", "n", "docs"])

    for b in batches:
        langs, sources = b.column(0).to_pylist(), b.column(1).to_pylist()
        data, offs = C.text_bytes(b.column(2))
        for i, key in enumerate(zip(langs, sources, strict=True)):
            count, seen = n.setdefault(key, Counter({b"": 0})), docs.setdefault(key, Counter())
            before = len(count)
            text = data[offs[i] : offs[i + 1]].tobytes().translate(TERMS)
            own: Counter = Counter()
            for s in slices(text):
                own.update(s.split())
            for t, c in own.items():
                count[t] += c
            seen.update(own.keys())
            held += len(count) - before
            if held > HELD_TERMS:
                yield from out()
                n, docs, held = {}, {}, 0
    yield from out()


def scatter(lang: np.ndarray, term: np.ndarray, group: np.ndarray, p: np.ndarray, z: np.ndarray):
    """Gustavson's rows on a slice of the index, which is ordered by term: for
    each group its peers and the sums over common terms. Yields (group, peers,
    sums); ``z`` is by group, ``term`` numbers the terms from 0."""
    first = np.concatenate([np.flatnonzero(np.diff(term, prepend=-1)), [len(term)]])  # where a term's postings begin
    order = np.argsort(group, kind="stable")
    edges = np.concatenate([np.flatnonzero(np.diff(group[order], prepend=-1)), [len(order)]])
    sums = np.zeros(len(z), np.int64)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        row = order[a:b]
        g = int(group[row[0]])
        width = first[term[row] + 1] - first[term[row]]
        done, upto = 0, np.cumsum(width)
        while done < len(row):
            base = int(upto[done - 1]) if done else 0
            stop = max(done + 1, int(np.searchsorted(upto, base + PRODUCTS, "right")))
            w = width[done:stop]
            at = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w) + np.repeat(first[term[row[done:stop]]], w)
            mine, peer, theirs = np.repeat(p[row[done:stop]], w), group[at], p[at]
            np.add.at(sums, peer, f_np(mine, theirs) - f_np(mine, z[peer]) - f_np(z[g], theirs) + f_np(z[g], z[peer]))
            done = stop
        sums[g] = 0
        peers = np.flatnonzero(sums)
        yield g, peers, sums[peers]
        sums[peers] = 0


def f_np(p, q) -> np.ndarray:
    """f on arrays of whole numbers up to 10^9 + 1: no product leaves 64 bits."""
    d = p - q
    return d * d // (p + q)


def accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, term, source, p, z ordered by (lang, term) -> lang, source, item, value."""
    def out(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        pairs = [t.column(c).combine_chunks().dictionary_encode() for c in ("lang", "source")]
        pairs = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in pairs]
        lang, source = (x.indices.to_numpy() for x in pairs)
        names = [x.dictionary.to_pylist() for x in pairs]
        key, group = np.unique(lang.astype(np.int64) * len(names[1]) + source, return_inverse=True)
        z = np.zeros(len(key), np.int64)
        z[group] = t.column("z").to_numpy()
        for g, peers, sums in scatter(lang, starts(t).cumsum() - 1, group, t.column("p").to_numpy(), z):
            if len(peers):
                lang_no, no = divmod(int(key[g]), len(names[1]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[0][lang_no]] * len(peers)), pa.array([names[1][no]] * len(peers)),
                     pa.array([names[1][int(key[h]) % len(names[1])] for h in peers]), pa.array(sums)],
                    names=["lang", "source", "item", "value"])

    held: list[pa.Table] = []
    rows = 0
    for b in batches:
        if b.num_rows:
            held.append(pa.Table.from_batches([b]))
            rows += b.num_rows
        if rows >= SLICE_POSTINGS:  # all but the last term, which may go on
            t = pa.concat_tables(held)
            cut = int(np.flatnonzero(starts(t))[-1])
            if cut:
                yield from out(t.slice(0, cut))
            held = [t.slice(cut)]
            rows = t.num_rows - cut
    if rows:
        yield from out(pa.concat_tables(held))


def starts(t: pa.Table) -> np.ndarray:
    """True where a (lang, term) begins."""
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for c in ("lang", "term"):
        x = t.column(c).combine_chunks().dictionary_encode()
        x = x.chunk(0) if isinstance(x, pa.ChunkedArray) else x
        new[1:] |= np.diff(x.indices.to_numpy()) != 0
    return new


def share(count, total, terms):
    """p in exact decimals; null for a language without kept terms."""
    return F.lit(1).cast("long") + F.expr(f"(cast({count} + 2 as decimal(20,0)) * {SCALE}) div nullif(cast({total} as decimal(20,0)) + 2 * {terms}, 0)")


def divergence_tables(docs: DataFrame, params: DivergenceParams | None = None, text: str = "text",
                      lang: str = "lang", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """(groups, postings): lang, source, n, z and V of every group; lang, term,
    source, count n, p, z and the language's q of every kept term in a group."""
    p = params or DivergenceParams()
    blank = lambda c: F.coalesce(docs[c].cast("string"), F.lit(""))
    thin = docs.select(blank(lang).alias("lang"), blank(source).alias("source"), blank(text).alias("text"))
    counted = C.map_batches(thin, count_terms, "lang string, source string, term string, n long, docs long")
    counts = write_scratch(counted.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "terms")
    kept = (counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"), F.collect_list(F.struct("source", "n")).alias("at"))
            .where(F.col("docs") >= p.min_documents).select("lang", "term", "lang_n", "at"))
    index = write_scratch(kept, "term-index")
    langs = index.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    own = (index.select("lang", F.explode("at").alias("at")).select("lang", "at.source", "at.n")
           .unionByName(counts.where("term = ''").select("lang", "source", F.lit(0).cast("long").alias("n")))
           .groupBy("lang", "source").agg(F.sum("n").alias("total")))
    groups = (own.join(langs, "lang", "left").withColumn("v", F.coalesce("v", F.lit(0).cast("long")))
              .withColumn("z", share("0", "total", "v")))
    groups = write_scratch(groups, "term-groups")
    postings = (index.select("lang", "term", "lang_n", F.explode("at").alias("at")).select("lang", "term", "lang_n", "at.source", "at.n")
                .join(groups, ["lang", "source"])
                .select("lang", "term", "source", "n", share("n", "total", "v").alias("p"), "z", share("lang_n", "lang_total", "v").alias("q")))
    return groups, write_scratch(postings, "term-postings")


def pair_values(groups: DataFrame, postings: DataFrame) -> DataFrame:
    """lang, source, item (another source), value."""
    spark = groups.sparkSession
    by_term = postings.select("lang", "term", "source", "p", "z").repartition(C.input_partitions(spark), "lang", "term").sortWithinPartitions("lang", "term")
    common = C.map_batches(by_term, accumulate, "lang string, source string, item string, value long")
    # how often a group has a value, and what that adds against each peer's baseline
    often = postings.groupBy("lang", "source", "p").agg(F.count("*").alias("n"))
    often = often.groupBy("lang", "source").agg(F.collect_list(F.struct("p", "n")).alias("often"))
    peers = groups.groupBy("lang").agg(F.collect_list(F.struct(F.col("source").alias("item"), F.col("z").alias("peer_z"))).alias("peers"))
    each = (groups.join(often, ["lang", "source"], "left").join(peers, "lang")
            .select("lang", "source", "z", "v", F.coalesce("often", F.array().cast("array<struct<p:bigint,n:bigint>>")).alias("often"), F.explode("peers").alias("peer"))
            .select("lang", "source", "z", "v", "often", "peer.*").where("item <> source"))
    both = "((z - peer_z) * (z - peer_z)) div (z + peer_z)"
    mine = F.expr(f"aggregate(often, 0L, (a, x) -> a + x.n * (((x.p - peer_z) * (x.p - peer_z)) div (x.p + peer_z) - {both}))")
    each = each.select("lang", "source", "item", mine.alias("mine"), F.expr(f"v * ({both})").alias("none"))
    parts = (common.unionByName(each.select("lang", "source", "item", (F.col("mine") + F.coalesce("none", F.lit(0))).alias("value")))
             .unionByName(each.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("mine").alias("value"))))
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, params: DivergenceParams | None = None) -> DataFrame:
    """lang, source, part (pair or term), item, q, value and rank."""
    p = params or DivergenceParams()
    groups, postings = divergence_tables(docs, p)
    first = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pair_values(groups, postings).withColumn("rank", F.row_number().over(first))
    terms = (postings.where("n > 0 and p > q").select("lang", "source", F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))
             .withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= p.top_terms))
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank").unionByName(
        terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
