"""Tree Shapley values for the forest's class probabilities.

Value function: the path-dependent one of Tree SHAP (features outside S are
averaged over both branches by training cover). For one tree and one leaf ℓ
reached by a path whose distinct split features are U,

    v_ℓ(S) = value_ℓ · Π_{f∈U} (o_f if f ∈ S else z_f)

where o_f ∈ {0, 1} says whether the row satisfies every split on f along the
path and z_f is the product of the cover ratios (child / parent) of those
splits. The Shapley value of this product game is closed-form:

    φ_i = value_ℓ · (o_i − z_i) · Σ_s  s!(d−s−1)!/d! · e_s,
    e_s = coefficient of t^s in Π_{j∈U, j≠i} (z_j + o_j t)

Summing over leaves, then averaging over trees (the forest's probability is
the mean of the trees' normalised leaf class counts), gives φ for every
(row, feature, class). Base value per class = Σ_ℓ value_ℓ · Π z = the cover
weighted mean of leaf values; base + Σ φ = predicted probability.

Distribution: the leaf table depends only on the model (its size is bounded
by numTrees · 2^maxDepth), so it is built on the driver from the saved
model's node table and broadcast. For leaves with at most 8 distinct path
features the Shapley scalars of all 2^d o-patterns are precomputed there, so
a row only needs its pattern code. Rows are processed by ``mapInArrow`` in
Arrow batches (numpy per batch, result arrays built from numpy buffers).
Filter rows *before* this step: the Python stage blocks predicate pushdown.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.session import scratch_path, ship_package, write_scratch


PRECOMPUTE_MAX_D = 8          # leaves with ≤ 8 distinct path features get a pattern table,
PATTERN_BYTES = 64 << 20      # as long as all tables together stay below this; the others' patterns
                              # are computed for each batch, with the same values
ROW_BLOCK, LEAF_BLOCK = 16384, 8  # rows, and leaves of a feature, that are added up at once
SEEN_BYTES = 16 << 20         # impacts of the places that a task has met, kept for its next batches
LEAF_GROUP_BYTES = 256 << 20  # a model above this is explained in several passes


@dataclass
class Leaf:
    features: np.ndarray      # distinct split features on the path (d,)
    z: np.ndarray             # cover-ratio product per feature (d,)
    conds: list               # per path node: (feature slot, kind, threshold/set, go_left)
    value: np.ndarray         # class distribution (C,)
    table: np.ndarray | None = None   # (2^d, d) Shapley scalars for every o-pattern


@dataclass
class LeafTable:
    n_features: int
    n_classes: int
    n_trees: int
    leaves: list
    base: np.ndarray          # (C,)
    tests: tuple | None = None        # of the leaves, made by the first batch of a worker


def _node_table(spark: SparkSession, forest) -> list:
    """The forest's nodes (treeID, nodeData), read from a saved copy of the
    model in the shared folder. Size is the model's, not the data's."""
    path = scratch_path(spark, "forest")
    forest.write().overwrite().save(path)
    return spark.read.parquet(f"{path}/data").collect()


def _tree_leaves(nodes: dict, value_fn, cover_fn, n_out: int):
    """Leaves of one tree (node id -> node row) and its expected output.
    ``value_fn(node) -> (n_out,)`` gives a leaf's output, ``cover_fn(stats)``
    a node's training cover."""
    leaves, base = [], np.zeros(n_out)
    root = min(nodes)                        # the root has the smallest id

    def walk(nid, path):
        nd = nodes[nid]
        if nd["leftChild"] < 0:
            value = value_fn(nd)
            feats = []
            for (f, _, _, _, _) in path:
                if f not in feats:
                    feats.append(f)
            z = np.ones(len(feats))
            conds = []
            for (f, kind, thr, go_left, ratio) in path:
                slot = feats.index(f)
                z[slot] *= ratio
                conds.append((slot, kind, thr, go_left))
            leaves.append(Leaf(np.asarray(feats, dtype=int), z, conds, value))
            base[:] += value * (np.prod([p[4] for p in path]) if path else 1.0)
            return
        sp = nd["split"]
        f = int(sp["featureIndex"])
        kind = "cont" if sp["numCategories"] < 0 else "cat"
        thr = (float(sp["leftCategoriesOrThreshold"][0]) if kind == "cont"
               else frozenset(float(v) for v in sp["leftCategoriesOrThreshold"]))
        cover = cover_fn(np.asarray(nd["impurityStats"], dtype=float))
        for child, go_left in ((nd["leftChild"], True), (nd["rightChild"], False)):
            c_cover = cover_fn(np.asarray(nodes[child]["impurityStats"], dtype=float))
            walk(child, path + [(f, kind, thr, go_left, c_cover / cover if cover > 0 else 0.0)])

    walk(root, [])
    return leaves, base


def _add_patterns(leaves: list) -> None:
    """Pattern tables, small leaves first, within ``PATTERN_BYTES`` in all."""
    left = PATTERN_BYTES
    for leaf in sorted(leaves, key=lambda x: len(x.features)):
        d = len(leaf.features)
        left -= (8 * d) << d
        if d > PRECOMPUTE_MAX_D or left < 0:
            return
        if d > 0:
            codes = np.arange(1 << d, dtype=np.int64)
            # a slot's scalars side by side, as they are looked up
            leaf.table = np.asfortranarray(leaf_phi(((codes[:, None] >> np.arange(d)) & 1).astype(float), leaf.z))


def _trees_of(rows) -> dict[int, dict[int, object]]:
    trees: dict[int, dict[int, object]] = {}
    for r in rows:
        trees.setdefault(r["treeID"], {})[r["nodeData"]["id"]] = r["nodeData"]
    return trees


def build_leaf_table(spark: SparkSession, forest, n_features: int) -> LeafTable:
    """Random forest classifier: leaf output = normalised class counts, cover =
    weighted count; the forest output is the mean over trees."""
    return leaf_table(_trees_of(_node_table(spark, forest)), n_features, int(forest.numClasses))


def leaf_table(trees: dict[int, dict], n_features: int, n_classes: int) -> LeafTable:
    """The leaf table of given trees: tree id -> node id -> node (a row or a
    dict with leftChild, rightChild, split and impurityStats, the weighted
    class counts)."""
    def value(nd):
        stats = np.asarray(nd["impurityStats"], dtype=float)
        tot = stats.sum()
        return stats / tot if tot > 0 else np.zeros(n_classes)

    leaves, base = [], np.zeros(n_classes)
    for tid in sorted(trees):
        lv, b = _tree_leaves(trees[tid], value, lambda st: float(st.sum()), n_classes)
        leaves += lv
        base += b
    n_trees = len(trees)
    _add_patterns(leaves)
    return LeafTable(n_features, n_classes, n_trees, leaves, base / n_trees)


def build_margin_table(spark: SparkSession, models: list, n_features: int) -> LeafTable:
    """One boosted-tree model per class (one-vs-rest): class c's output is its
    raw margin Σ_t w_t · tree_t(x). Leaf output = w_t · leaf value in slot c;
    cover = the regression node's weighted count. Outputs add over trees."""
    n_classes = len(models)
    leaves, base = [], np.zeros(n_classes)
    for c, m in enumerate(models):
        trees = _trees_of(_node_table(spark, m))
        weights = list(m.treeWeights)
        for tid in sorted(trees):
            w = weights[tid]

            def value(nd, _c=c, _w=w):
                v = np.zeros(n_classes)
                v[_c] = _w * float(nd["prediction"])
                return v
            lv, b = _tree_leaves(trees[tid], value, lambda st: float(st[0]), n_classes)
            leaves += lv
            base += b
    _add_patterns(leaves)
    return LeafTable(n_features, n_classes, 1, leaves, base)


def build_softmax_table(model) -> LeafTable:
    """A softmax booster (``boosting.SoftmaxModel``): class c's output is its
    margin, the start plus the values of its trees; cover = training rows. Rows
    without a value go right, as the model has them."""
    n_classes = len(model.labels)
    leaves, base = [], np.array(model.start, dtype=float)
    for trees in model.rounds:
        for c, tree in enumerate(trees):
            nodes = {}
            for i, (f, b, left, right) in enumerate(zip(*(a.tolist() for a in tree.arrays), strict=True)):
                split = {"featureIndex": f, "numCategories": -1, "leftCategoriesOrThreshold": [model.cuts[f][b]]} if f >= 0 else None
                nodes[i] = {"leftChild": left, "rightChild": right, "split": split, "impurityStats": [tree.cover[i]], "value": tree.value[i]}

            def value(nd, _c=c):
                v = np.zeros(n_classes)
                v[_c] = nd["value"]
                return v
            lv, b = _tree_leaves(nodes, value, lambda st: float(st[0]), n_classes)
            leaves += lv
            base += b
    _add_patterns(leaves)
    return LeafTable(len(model.features), n_classes, 1, leaves, base)


def leaf_phi(o: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Shapley scalars of the product game for each row pattern.

    o: (m, d) 0/1 path indicators, z: (d,) cover ratios. Returns (m, d);
    multiply by the leaf value. The weight of a coalition of s out of d - 1
    others is the integral of t^s (1 - t)^(d - 1 - s) over [0, 1], so the
    scalar of i is (o_i - z_i) times the integral of the product over the
    others of (z_j (1 - t) + o_j t): a polynomial of degree d - 1, integrated
    exactly by Gauss-Legendre nodes, half as many as features. Products
    without i come from prefixes and suffixes: O(d^2), no division."""
    m, d = o.shape
    if not d:
        return np.zeros((m, 0))
    node, weight = np.polynomial.legendre.leggauss((d + 1) // 2)
    t, weight = (node + 1) / 2, weight / 2
    factor = z[:, None, None] * (1 - t)[:, None] + o.T[:, None, :] * t[:, None]     # (d, nodes, m)
    rest = np.ones_like(factor)
    for i in range(1, d):
        rest[i] = rest[i - 1] * factor[i - 1]
    after = np.ones_like(factor[0])
    for i in range(d - 2, -1, -1):
        after = after * factor[i + 1]
        rest[i] *= after
    return (o - z) * np.einsum("dqm,q->md", rest, weight)


def path_tests(table: LeafTable) -> tuple[dict[int, np.ndarray], list[list]]:
    """The thresholds of each feature, and for each leaf and slot what a row on
    its path must meet: the path's thresholds on a feature leave one interval,
    so ``(a, w)`` stands for a value whose number of thresholds below it is from
    a to a + w (a value that is NaN goes right: above all); categories are kept
    as ``(set, go_left)`` pairs."""
    seen: dict[int, set] = {}
    for leaf in table.leaves:
        for slot, kind, thr, _ in leaf.conds:
            if kind == "cont":
                seen.setdefault(int(leaf.features[slot]), set()).add(thr)
    cuts = {f: np.array(sorted(v)) for f, v in seen.items()}
    place = {f: {t: i for i, t in enumerate(v.tolist())} for f, v in cuts.items()}
    out = []
    for leaf in table.leaves:
        spans = [[0, len(cuts.get(int(f), ()))] for f in leaf.features]
        sets: list[list] = [[] for _ in leaf.features]
        for slot, kind, thr, go_left in leaf.conds:
            if kind != "cont":
                sets[slot].append((list(thr), go_left))
            elif go_left:
                spans[slot][1] = min(spans[slot][1], place[int(leaf.features[slot])][thr])
            else:
                spans[slot][0] = max(spans[slot][0], place[int(leaf.features[slot])][thr] + 1)
        out.append([sets[i] or (a, b - a) for i, (a, b) in enumerate(spans)])
    return cuts, out


def shap_matrix(x: np.ndarray, table: LeafTable) -> np.ndarray:
    """φ for a batch: x (n, F) → (n, C, F).

    Values are replaced by their number of thresholds below, once a batch. Per
    leaf: the o-pattern code of every row from one interval a feature, its
    Shapley scalars looked up in the leaf's pattern table (or computed for the
    distinct patterns of the rows). The scalars of a feature are gathered for
    ``LEAF_BLOCK`` leaves and added for all classes by one matrix product."""
    n = x.shape[0]
    if table.tests is None:
        table.tests = path_tests(table)
    cuts, tests = table.tests
    used = sorted({int(f) for leaf in table.leaves for f in leaf.features})
    out = np.zeros((n, table.n_classes, table.n_features))
    for s in range(0, n, ROW_BLOCK):
        _block(x[s:s + ROW_BLOCK], table, cuts, tests, used, out[s:s + ROW_BLOCK])
    return out


def places(x: np.ndarray, table: LeafTable) -> np.ndarray:
    """All that a row's impacts depend on, as a number or bytes: of each tested
    feature how many thresholds are below its value, and its value where
    categories are tested."""
    if table.tests is None:
        table.tests = path_tests(table)
    cuts, tests = table.tests
    sets = {int(f) for leaf, slots in zip(table.leaves, tests, strict=True) for f, t in zip(leaf.features, slots, strict=True) if not isinstance(t, tuple)}
    words, size = [np.zeros(len(x), np.int64)], 1
    for f, at in sorted(cuts.items()):
        if size * (len(at) + 1) >= 1 << 63:
            words, size = [*words, np.zeros(len(x), np.int64)], 1
        words[-1] = words[-1] * (len(at) + 1) + np.searchsorted(at, np.ascontiguousarray(x[:, f]), "left")
        size *= len(at) + 1
    words += [(np.ascontiguousarray(x[:, f]) + 0.0).view(np.int64) for f in sorted(sets)]
    return words[0] if len(words) == 1 else np.stack(words, axis=1).view(f"V{8 * len(words)}").ravel()


class Explainer:
    """``shap_matrix`` for batch after batch: rows at the same places among the
    thresholds have the same impacts, so each place is worked once in a batch, and
    those that fit in ``SEEN_BYTES`` are kept for the next batches."""

    def __init__(self, table: LeafTable):
        self.table = table
        self.number: dict = {}
        self.kept = np.zeros((max(1, SEEN_BYTES // max(1, 8 * table.n_classes * table.n_features)), table.n_classes, table.n_features))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        place, first, of_row = np.unique(places(x, self.table), return_index=True, return_inverse=True)
        keys = place.tolist()
        at = np.array([self.number.get(k, -1) for k in keys], np.int64)
        new = np.flatnonzero(at < 0)
        out = self.kept[at]
        if len(new):
            out[new] = shap_matrix(x[first[new]], self.table)
            held = len(self.number)
            keep = new[:len(self.kept) - held]
            self.kept[held:held + len(keep)] = out[keep]
            self.number.update((keys[i], held + j) for j, i in enumerate(keep.tolist()))
        return out[of_row.reshape(-1)]


def _block(x: np.ndarray, table: LeafTable, cuts: dict, tests: list, used: list[int], out: np.ndarray) -> None:
    n = x.shape[0]
    below = {}
    for f, at in cuts.items():
        dtype = np.uint8 if len(at) < 1 << 8 else np.uint16 if len(at) < 1 << 16 else np.uint32
        below[f] = np.searchsorted(at, np.ascontiguousarray(x[:, f]), "left").astype(dtype)
    acc = {f: np.zeros((table.n_classes, n)) for f in used}
    gathered = {f: np.empty((LEAF_BLOCK, n)) for f in used}
    values = {f: np.empty((LEAF_BLOCK, table.n_classes)) for f in used}
    filled = dict.fromkeys(used, 0)

    def flush(f):
        m = filled[f]
        acc[f] += values[f][:m].T @ gathered[f][:m]
        filled[f] = 0

    for leaf, slots in zip(table.leaves, tests, strict=True):
        d = len(leaf.features)
        if d == 0:
            continue
        codes = np.zeros(n, np.uint8 if d <= 8 else np.int64)
        for slot, test in enumerate(slots):
            f = int(leaf.features[slot])
            if isinstance(test, tuple):
                b, (first, wide) = below[f], test
                # unsigned: what is below the first wraps round
                o = (b - b.dtype.type(first)) <= b.dtype.type(wide) if wide >= 0 else np.zeros(n, bool)
            else:
                o = np.ones(n, bool)
                for members, go_left in test:
                    o &= np.isin(x[:, f], members) == go_left
            bit = o.view(np.uint8) if d <= 8 else o.astype(np.int64)
            codes |= bit << bit.dtype.type(slot)
        if leaf.table is not None:
            at, scalars = codes.astype(np.intp), leaf.table.T
        else:
            uniq, at = np.unique(codes, return_inverse=True)
            at = at.reshape(-1)
            scalars = leaf_phi(((uniq[:, None] >> np.arange(d)) & 1).astype(float), leaf.z).T
        for k, f in enumerate(leaf.features.tolist()):
            m = filled[f]
            np.take(scalars[k], at, out=gathered[f][m], mode="clip")
            values[f][m] = leaf.value
            filled[f] = m + 1
            if m + 1 == LEAF_BLOCK:
                flush(f)
    for f in used:
        flush(f)
        np.divide(acc[f].T, table.n_trees, out=out[:, :, f])


def leaf_groups(table: LeafTable, group_bytes: int) -> list[LeafTable]:
    """The leaves in groups of about ``group_bytes`` each."""
    groups, size = [[]], 0
    for leaf in table.leaves:
        mine = 400 + 160 * len(leaf.conds) + 16 * len(leaf.features) + 8 * len(leaf.value) + (0 if leaf.table is None else leaf.table.nbytes)
        if groups[-1] and size + mine > group_bytes:
            groups.append([])
            size = 0
        groups[-1].append(leaf)
        size += mine
    return [LeafTable(table.n_features, table.n_classes, table.n_trees, g, table.base) for g in groups]


def shap_values(df: DataFrame, features: list[str], table: LeafTable,
                keep: list[str], with_values: bool = False, group_bytes: int = LEAF_GROUP_BYTES) -> DataFrame:
    """For each row of ``df``: ``keep`` columns, ``base`` array<double>
    (per class) and ``shap`` array<array<double>> ([class][feature]).

    Runs as ``mapInArrow``: feature columns arrive as Arrow buffers, the
    nested result arrays are built from the flat numpy buffer by offsets (no
    per-value Python objects). Impacts add over leaves, so a model of more than
    ``group_bytes`` is sent in groups, one pass each, which adds its part to the
    rows that the pass before wrote: a task holds one group, however many trees
    there are, and rows are never shuffled."""
    ship_package(df.sparkSession)
    n_feat = len(features)
    values = [f"_f{i}" for i in range(n_feat)]
    rows = df.select(*[F.col(f"`{c}`") for c in keep], *[F.col(f"`{c}`").cast("double").alias(f"_f{i}") for i, c in enumerate(features)])
    groups = leaf_groups(table, group_bytes)
    for i, group in enumerate(groups):
        rows = _add_group(rows, group, [*keep, *values], n_feat, first=not i)
        if i + 1 < len(groups):
            rows = write_scratch(rows, "shap-part")
    out = [*[F.col(f"`{c}`") for c in keep], F.col("base"), F.col("shap")]
    return rows.select(*out, *([F.array(*values).alias("values")] if with_values else []))


def _add_group(src: DataFrame, group: LeafTable, carried: list[str], n_feat: int, first: bool) -> DataFrame:
    """``src`` with the impacts of a group of leaves added."""
    bc = src.sparkSession.sparkContext.broadcast(group)      # at most group_bytes, or one leaf
    schema = T.StructType([src.schema[c] for c in carried] + [
        T.StructField("base", T.ArrayType(T.DoubleType())),
        T.StructField("shap", T.ArrayType(T.ArrayType(T.DoubleType())))])

    def run(batches):
        import pyarrow as pa
        tab = bc.value
        n_cls = tab.n_classes
        explain = Explainer(tab)
        for rb in batches:
            n = rb.num_rows
            if n == 0:
                continue
            x = np.column_stack([rb.column(f"_f{i}").to_numpy(zero_copy_only=False)
                                 for i in range(n_feat)]).astype(float)
            phi = explain(x)                                            # (n, C, F)
            if not first:
                phi = phi + rb.column("shap").flatten().flatten().to_numpy(zero_copy_only=False).reshape(phi.shape)
            inner = pa.ListArray.from_arrays(
                pa.array(np.arange(0, n * n_cls * n_feat + 1, n_feat, dtype=np.int32)),
                pa.array(phi.reshape(-1)))
            outer = pa.ListArray.from_arrays(
                pa.array(np.arange(0, n * n_cls + 1, n_cls, dtype=np.int32)), inner)
            base = pa.ListArray.from_arrays(
                pa.array(np.arange(0, n * n_cls + 1, n_cls, dtype=np.int32)),
                pa.array(np.tile(np.asarray(tab.base, dtype=float), n)))
            yield pa.RecordBatch.from_arrays([*(rb.column(c) for c in carried), base, outer], names=[*carried, "base", "shap"])

    return src.mapInArrow(run, schema)


# -- views over the Shapley table ---------------------------------------------

def predicted_class_impacts(shap: DataFrame, features: list[str], pred_index_col: str) -> DataFrame:
    """Impacts for the predicted class only, as a long table
    (keys…, position, feature, impact) plus ``base_value``."""
    names = F.array(*[F.lit(f) for f in features])
    i = F.col(pred_index_col).cast("int") + 1
    return (shap.withColumn("base_value", F.element_at("base", i))
                .withColumn("_imp", F.element_at("shap", i))
                .select("*", F.posexplode("_imp").alias("position", "impact"))
                .withColumn("feature", F.element_at(names, F.col("position") + 1))
                .drop("_imp", "base", "shap"))


def top_impacts(impacts: DataFrame, row_keys: list[str], k: int = 3) -> DataFrame:
    """The k largest |impact| per row, ties by feature order, as a map
    feature -> impact (ordered entries) plus the ordered list."""
    w = Window.partitionBy(*row_keys).orderBy(F.abs("impact").desc(), F.col("position").asc())
    top = impacts.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
    return top.groupBy(*row_keys).agg(
        F.array_sort(F.collect_list(F.struct("_r", "feature", "impact"))).alias("_t")).select(
        *row_keys,
        F.map_from_entries(F.transform("_t", lambda e: F.struct(e["feature"], e["impact"]))).alias("features"),
        F.transform("_t", lambda e: e["feature"]).alias("top_features"))


def _ranked(pred_index_col: str):
    """The predicted class's impacts as (order, position, impact) by decreasing
    |impact|, ties by feature order; sorted inside the row."""
    impacts = F.element_at("shap", F.col(pred_index_col).cast("int") + 1)
    return F.array_sort(F.transform(impacts, lambda x, p: F.struct(
        (-F.abs(x)).alias("order"), p.alias("position"), x.alias("impact"))))


def with_top_impacts(shap: DataFrame, features: list[str], pred_index_col: str, k: int = 3) -> DataFrame:
    """X3 + T2 inside the row: ``features``, the map of the k largest |impact| on
    the predicted class in their order, and ``top_features``; the other columns
    stay, but for base and shap. No shuffle."""
    names = F.array(*[F.lit(f) for f in features])
    top = F.transform(F.slice(_ranked(pred_index_col), 1, k), lambda e: F.struct(
        F.element_at(names, e["position"] + 1).alias("feature"), e["impact"].alias("impact")))
    return (shap.withColumn("_top", top)
                .withColumn("features", F.map_from_entries("_top"))
                .withColumn("top_features", F.transform("_top", lambda e: e["feature"]))
                .drop("_top", "base", "shap"))


def waterfall_rows(shap: DataFrame, row_keys: list[str], features: list[str], pred_index_col: str) -> DataFrame:
    """X6 for any number of rows, inside the row: contributions to the predicted
    class by decreasing |impact| with the running total from the base value."""
    names = F.array(*[F.lit(f) for f in features])
    steps = F.transform("_ranked", lambda e, i: F.struct(
        (i + 1).alias("step"), e["position"].alias("position"), e["impact"].alias("impact"),
        F.aggregate(F.slice("_ranked", 1, i + 1), F.col("base_value"), lambda a, x: a + x["impact"]).alias("running_total")))
    return (shap.withColumn("_ranked", _ranked(pred_index_col))
                .withColumn("base_value", F.element_at("base", F.col(pred_index_col).cast("int") + 1))
                .select(*row_keys, "base_value", F.explode(steps).alias("s"))
                .select(*row_keys, "base_value", "s.*", F.element_at(names, F.col("s.position") + 1).alias("feature")))


def global_importance(shap: DataFrame, features: list[str], classes: list[str]) -> DataFrame:
    """Mean |φ| per (class, feature) over all rows — partial
    aggregation over the exploded (class, feature) cells."""
    cls = F.array(*[F.lit(c) for c in classes])
    names = F.array(*[F.lit(f) for f in features])
    per_class = shap.select(F.posexplode("shap").alias("ci", "row"))
    cells = per_class.select("ci", F.posexplode("row").alias("fi", "phi"))
    return (cells.groupBy("ci", "fi").agg(F.avg(F.abs("phi")).alias("mean_abs_impact"))
                 .select(F.element_at(cls, F.col("ci") + 1).alias("class"),
                         F.col("fi").alias("position"),
                         F.element_at(names, F.col("fi") + 1).alias("feature"),
                         "mean_abs_impact"))


def shap_long(shap: DataFrame, row_keys: list[str], features: list[str],
              classes: list[str]) -> DataFrame:
    """The long table (row keys…, class, feature, phi[, feature_value])
    of a Shapley result (``values`` is used when present)."""
    cls = F.array(*[F.lit(c) for c in classes])
    names = F.array(*[F.lit(f) for f in features])
    has_v = "values" in shap.columns
    per_class = shap.select(*row_keys, *(["values"] if has_v else []),
                            F.posexplode("shap").alias("ci", "row"))
    cells = per_class.select("*", F.posexplode("row").alias("fi", "phi"))
    out = [*row_keys, F.element_at(cls, F.col("ci") + 1).alias("class"),
           F.element_at(names, F.col("fi") + 1).alias("feature"), "phi"]
    if has_v:
        out.append(F.element_at("values", F.col("fi") + 1).alias("feature_value"))
    return cells.select(*out)


def direction_data(shap: DataFrame, row_keys: list[str], features: list[str],
                   class_index: int = 0) -> DataFrame:
    """(row keys, feature, phi, feature value) for one class; ``shap``
    must carry ``values`` (``shap_values(..., with_values=True)``)."""
    names = F.array(*[F.lit(f) for f in features])
    pairs = F.arrays_zip(F.element_at("shap", class_index + 1).alias("phi"), F.col("values").alias("v"))
    return (shap.select(*row_keys, F.posexplode(pairs).alias("fi", "pv"))
                .select(*row_keys, F.element_at(names, F.col("fi") + 1).alias("feature"),
                        F.col("pv.phi").alias("phi"), F.col("pv.v").alias("feature_value")))


def waterfall(impacts: DataFrame, row_keys: list[str]) -> DataFrame:
    """Per row, contributions by decreasing |impact| (ties by feature
    order) with the running total starting from the base value."""
    w = Window.partitionBy(*row_keys).orderBy(F.abs("impact").desc(), F.col("position").asc())
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return (impacts.withColumn("step", F.row_number().over(w))
                   .withColumn("running_total", F.col("base_value") + F.sum("impact").over(run)))


def critical_case(scored: DataFrame, order_by: str | list[str], label_col: str = "label",
                  pred_col: str = "prediction", targets=("u2r", "r2l")) -> DataFrame:
    """T5: first correctly predicted u2r/r2l row; else first correct attack;
    else the first row. One row; ``order_by`` should be a key, or a tie may
    fall either way."""
    correct = F.col(label_col) == F.col(pred_col)
    prio = (F.when(correct & F.col(label_col).isin(*targets), 0)
             .when(correct & (F.col(label_col) != "normal"), 1).otherwise(2))
    return scored.withColumn("priority", prio).orderBy("priority", *([order_by] if isinstance(order_by, str) else order_by)).limit(1)

