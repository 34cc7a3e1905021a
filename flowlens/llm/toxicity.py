"""Toxicity by non-negative positive-unlabelled learning.

Features of a text are the presence of its lower-cased words and of their
first 4, 5 and 6 bytes, hashed to 2^20 weights. A linear classifier is trained
in numpy on confirmed toxic texts and unlabelled texts by minimising
``prior * E_p[l(f)] + max(0, E_u[l(-f)] - prior * E_p[l(-f)])`` with the
logistic loss: when the second part falls below zero its gradient is turned
round, as in the non-negative risk estimator. The prior is the toxic share of
the labelled texts, and the margin is scaled to a probability on them; without
labelled negatives both come from toxic and unlabelled texts alone.

The features that take part are chosen by their frequency in all documents, one
aggregation, against that in the toxic texts. The steps of the fit see bounded
samples: ``positives`` toxic texts, ``unlabelled`` texts and ``labelled`` texts
at most, picked by a hash of their id. Their feature ids (not the texts) come to
the driver; the fitted weights (4 MB) go to the tasks. Scoring is one scan of
all texts, whole, without a shuffle.

Edge cases: null and empty texts have no features and get the score of the
intercept; without toxic labels every score is 0; with toxic labels alone the
prior is the largest that the unlabelled texts allow; labels without document and
labels that repeat or are null are ignored or count once (toxic wins);
repeated documents are scored each by itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

U64 = C.U64


@dataclass(frozen=True)
class ToxicityParams:
    bits: int = 20
    positives: int = 4000
    unlabelled: int = 8000
    labelled: int = 4000
    epochs: int = 30
    batch: int = 500
    rate: float = 0.02
    l1: float = 2e-5
    least_texts: int = 4
    least_z: float = 6.0
    beta: float = 0.0
    threshold: float = 0.7
    seed: int = 7


def features(data: np.ndarray, offs: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) pairs, with repeats, of a chunk of texts."""
    w = C.Words(C.LOWER[data], offs, C.ALNUM)
    rows, feats = [w.row], [w.hash() >> U64(64 - bits)]
    for n in (4, 5, 6):
        at = np.flatnonzero(w.end - w.start > n)
        h = w.span_hash(w.start[at], w.start[at] + n)
        rows.append(w.row[at])
        feats.append(C.mix64(h + U64(n)) >> U64(64 - bits))
    return np.concatenate(rows), np.concatenate(feats).astype(np.int64)


def _feature_rows(texts: DataFrame, bits: int) -> DataFrame:
    """kind and the sorted distinct feature ids of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = C.text_bytes(b.column(1))
            for i, j in C.chunks(offs):
                row, feat = features(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], bits)
                key = np.unique((row << bits) | feat)
                at = np.searchsorted(key >> bits, np.arange(j - i + 1))
                ids = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array((key & ((1 << bits) - 1)).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), ids], names=["kind", "ids"])

    return C.map_batches(texts, run, "kind int, ids array<int>")


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    intercept: float
    scale: float
    shift: float

    def margin(self, rows: int, row: np.ndarray, feat: np.ndarray, bits: int) -> np.ndarray:
        w = self.weights[feat]
        live = w != 0
        key = np.unique((row[live] << bits) | feat[live])
        return np.bincount(key >> bits, weights=self.weights[key & ((1 << bits) - 1)], minlength=rows) + self.intercept

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * margin + self.shift, -50, 50)))


def _csr(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.zeros(0, np.int64), *lists]).astype(np.int64), np.cumsum([0, *map(len, lists)])


def _only(ids: np.ndarray, at: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ok = keep[ids]
    return ids[ok], np.concatenate([[0], np.cumsum(ok)])[at]


def _batch(ids: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    take = np.concatenate([ids[at[r] : at[r + 1]] for r in rows])
    return take, np.repeat(np.arange(len(rows)), at[rows + 1] - at[rows])


def chosen(cp: np.ndarray, n_pos: int, cu: np.ndarray, n_unl: int, p: ToxicityParams) -> np.ndarray:
    """Features whose shares among toxic texts and in the corpus differ by
    ``least_z`` standard errors, in ``least_texts`` toxic texts or more."""
    n_pos, n_unl = max(1, n_pos), max(1, n_unl)
    pool = (cp + cu) / (n_pos + n_unl)
    z = (cp / n_pos - cu / n_unl) / np.sqrt(np.maximum(pool * (1 - pool), 1e-12) * (1 / n_pos + 1 / n_unl))
    return (np.abs(z) >= p.least_z) & (cp >= p.least_texts)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def risk(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the risk with l(z) = log(1 + e^-z): that of the toxic
    texts, and that of the others, which is estimated from unlabelled texts less
    the toxic share of them."""
    return prior * np.logaddexp(0, -zp).mean(), np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()


def risk_gradient(zp: np.ndarray, zu: np.ndarray, prior: float, beta: float) -> tuple[np.ndarray, np.ndarray]:
    """By the margins of toxic and unlabelled texts, the gradient of both parts;
    where the second is below -beta, which no true risk is, that of its negative."""
    if risk(zp, zu, prior)[1] < -beta:
        return prior * sigmoid(zp) / len(zp), -sigmoid(zu) / len(zu)
    return -prior * (sigmoid(-zp) + sigmoid(zp)) / len(zp), sigmoid(zu) / len(zu)


def fit_pu(pos: list[np.ndarray], unl: list[np.ndarray], prior: float, p: ToxicityParams, common: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise the non-negative risk (Adam, with a
    proximal l1 step). Only the features ``common`` (a mask) take part; the
    others keep weight 0."""
    size = 1 << p.bits
    (pi, pat), (ui, uat) = _csr(pos), _csr(unl)
    picked = np.flatnonzero(common)
    place = np.cumsum(common) - 1  # train on the picked features only
    (pi, pat), (ui, uat) = ((place[i], at) for i, at in (_only(pi, pat, common), _only(ui, uat, common)))
    full, size = np.zeros(size), len(picked)
    w, c = np.zeros(size + 1), math.log(prior / (1 - prior))
    w[size] = c
    m, v, step = np.zeros(size + 1), np.zeros(size + 1), 0
    rng = np.random.default_rng(p.seed)
    turns = max(1, math.ceil(len(unl) / p.batch))
    share = max(1, math.ceil(len(pos) / turns))
    for _ in range(p.epochs):
        order_u, order_p = rng.permutation(len(unl)), rng.permutation(len(pos))
        for t in range(turns):
            ru = order_u[t * p.batch : (t + 1) * p.batch]
            rp = np.take(order_p, np.arange(t * share, (t + 1) * share), mode="wrap")
            (fp, bp), (fu, bu) = _batch(pi, pat, rp), _batch(ui, uat, ru)
            zp = np.bincount(bp, weights=w[fp], minlength=len(rp)) + w[size]
            zu = np.bincount(bu, weights=w[fu], minlength=len(ru)) + w[size]
            gp, gu = risk_gradient(zp, zu, prior, p.beta)
            g = np.bincount(fp, weights=gp[bp], minlength=size + 1) + np.bincount(fu, weights=gu[bu], minlength=size + 1)
            g[size] = gp.sum() + gu.sum()
            step += 1
            m = 0.9 * m + 0.1 * g
            v = 0.999 * v + 0.001 * g * g
            w -= p.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
            w[:size] = np.sign(w[:size]) * np.maximum(0, np.abs(w[:size]) - p.rate * p.l1 / (np.sqrt(v[:size] / (1 - 0.999**step)) + 1e-3))
    full[picked] = w[:size]
    return full.astype(np.float32), float(w[size])


def fit_scale(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Scale and shift that turn margins into probabilities (Newton steps on
    the log loss with a small ridge; the scale stays positive)."""
    a, b = 1.0, 0.0
    x = np.stack([margin, np.ones(len(margin))], 1)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ [a, b], -50, 50)))
        g = x.T @ (q - label) + 1e-2 * np.array([a - 1, b])
        h = (x * (q * (1 - q))[:, None]).T @ x + 1e-2 * np.eye(2)
        d = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = max(1e-2, a - d[0]), b - d[1]
        if np.abs(d).max() < 1e-6:
            break
    return a, b


def fit_prior(zp: np.ndarray, zu: np.ndarray) -> float:
    """The largest share of toxic texts that the unlabelled ones allow: above any
    margin, they hold at least that share of what the toxic texts have there."""
    at = np.quantile(zp, np.linspace(0.05, 0.8, 76))
    toxic, all_ = (1 - np.searchsorted(np.sort(z), at, "left") / len(z) for z in (zp, zu))
    return float(np.clip((all_ + np.sqrt(all_ / len(zu))) / toxic, 1e-3, 0.5).min())


def fit_scale_unlabelled(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, float]:
    """Scale and shift without negatives: with the logistic loss the risk of
    positives and unlabelled texts is E_u[log(1 + e^z)] - prior E_p[z], which is
    convex (Newton steps)."""
    a, b = 1.0, 0.0
    xp, xu = np.array([zp.mean(), 1.0]), np.stack([zu, np.ones(len(zu))], 1)
    for _ in range(60):
        q = sigmoid(xu @ [a, b])
        g = (xu * q[:, None]).mean(axis=0) - prior * xp + 1e-4 * np.array([a - 1, b])
        h = (xu * (q * (1 - q))[:, None]).T @ xu / len(xu) + 1e-4 * np.eye(2)
        d = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = max(1e-2, a - d[0]), b - d[1]
        if np.abs(d).max() < 1e-6:
            break
    return a, b


def document_frequencies(docs: DataFrame, wanted: np.ndarray, bits: int) -> tuple[np.ndarray, int]:
    """In how many documents each wanted feature is, over all of them, and how
    many there are. A task sends a row for each wanted feature that it saw."""
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(wanted))  # 2^bits bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.unpackbits(sent.value).astype(bool)
        seen, rows = np.zeros(1 << bits, np.int64), 0
        for b in batches:
            data, offs = C.text_bytes(b.column(0))
            rows += b.num_rows
            for i, j in C.chunks(offs):
                row, feat = features(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], bits)
                live = mask[feat]
                key = np.unique((row[live] << bits) | feat[live])
                seen += np.bincount(key & ((1 << bits) - 1), minlength=1 << bits)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(seen[at], rows))], names=["feature", "n"])

    counted = C.map_batches(docs.select(docs["text"].cast("string").alias("text")), run, "feature int, n long")
    got = counted.groupBy("feature").agg(F.sum("n").alias("n")).toArrow()  # a row for each wanted feature
    feature, n = got.column("feature").to_numpy(), got.column("n").to_numpy()
    out = np.zeros(1 << bits, np.int64)
    out[feature[feature >= 0]] = n[feature >= 0]
    return out, int(n[feature < 0].sum())


def train(docs: DataFrame, labels: DataFrame, p: ToxicityParams) -> Model | None:
    """``docs``: doc_id, text. ``labels``: doc_id, toxic; the training rows only.
    Without labelled negatives the prior and the scale come from positives and
    unlabelled texts alone."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    by_hash = F.xxhash64("doc_id", F.lit(p.seed))
    ids = docs.select("doc_id").where("doc_id is not null").distinct()
    known = known.join(ids, "doc_id", "left_semi")
    kinds = (known.where("toxic = 1").orderBy(by_hash).limit(p.positives).select("doc_id", F.lit(1).alias("kind"))
             .unionByName(ids.orderBy(by_hash).limit(p.unlabelled).select("doc_id", F.lit(2).alias("kind")))
             .unionByName(known.orderBy(by_hash).limit(p.labelled).select("doc_id", (F.col("toxic") + 3).alias("kind"))))
    n, toxic = known.agg(F.count("*"), F.sum("toxic")).first()
    if not toxic:
        return None
    texts = docs.join(F.broadcast(kinds), "doc_id")  # at most positives + unlabelled + labelled ids
    texts = texts.dropDuplicates(["doc_id", "kind"]).select("kind", "text")
    got = _feature_rows(texts, p.bits).toArrow().combine_chunks()
    kind, lists = got.column("kind").to_numpy(), [x.to_numpy() for x in _split(got.column("ids"))]
    group = lambda *k: [x for x, y in zip(lists, kind, strict=True) if y in k]
    pos, unl = group(1), group(2)
    cp = np.bincount(_csr(pos)[0], minlength=1 << p.bits)
    cu, n_docs = document_frequencies(docs, cp >= p.least_texts, p.bits)
    common = chosen(cp, len(pos), cu, n_docs, p)

    def margins(model: Model, rows: list[np.ndarray]) -> np.ndarray:
        feat, at = _csr(rows)
        return model.margin(len(rows), np.repeat(np.arange(len(rows)), np.diff(at)), feat, p.bits)

    if toxic < n:
        model = Model(*fit_pu(pos, unl, toxic / n, p, common), 1.0, 0.0)
        label = np.array([y - 3 for y in kind if y in (3, 4)], float)
        return replace(model, **dict(zip(("scale", "shift"), fit_scale(margins(model, group(3, 4)), label), strict=True)))
    prior = 0.2
    for _ in range(2):
        model = Model(*fit_pu(pos, unl, prior, p, common), 1.0, 0.0)
        zp, zu = margins(model, pos), margins(model, unl)
        prior = fit_prior(zp, zu)
    return replace(model, **dict(zip(("scale", "shift"), fit_scale_unlabelled(zp, zu, prior), strict=True)))


def _split(col: pa.ChunkedArray) -> list[pa.Array]:
    out = []
    for chunk in col.chunks:
        at = chunk.offsets.to_numpy()
        out += [chunk.values.slice(a, b - a) for a, b in zip(at[:-1], at[1:], strict=True)]
    return out


def score(docs: DataFrame, model: Model | None, p: ToxicityParams, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` of every row, score and predicted, from the text alone."""
    types = dict(docs.select(*keep).dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in keep] + ["score double", "predicted int"])
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2^bits weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            data, offs = C.text_bytes(b.column(b.num_columns - 1))
            parts = [np.zeros(0)]
            for i, j in C.chunks(offs):
                if model is None:
                    parts.append(np.zeros(j - i))
                else:
                    row, feat = features(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], p.bits)
                    parts.append(model.score(model.margin(j - i, row, feat, p.bits)))
            s = np.concatenate(parts)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s), pa.array((s >= p.threshold).astype(np.int32))],
                                             names=[*keep, "score", "predicted"])

    return C.map_batches(docs.select(*keep, docs["text"].cast("string").alias("__text")), run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, params: ToxicityParams | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted of every document. Labels of
    held-out ids (crc32 of the id's text modulo 3 is 1) are never read."""
    p = params or ToxicityParams()
    held = lambda c: F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")) % 3 == 1, F.lit(False))
    d = docs.select("doc_id", "text")
    model = train(d, labels.select("doc_id", "toxic").where(~held("doc_id")), p)
    return score(d, model, p).select("doc_id", held("doc_id").alias("held_out"), "score", "predicted")
