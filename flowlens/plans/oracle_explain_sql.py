"""DuckDB oracle SQL for scoring and explanation with the fixed forest.

Shapley values by their definition: a tree's value for every subset of known
features (an unknown feature averages both branches by training count), then
the weighted differences over the subsets without the feature. Nothing here
uses the closed form of ``operators/explain.py``.
"""

from __future__ import annotations

import math

from flowlens.plans import fixed_forest as FF
from flowlens.plans.oracle_prep_sql import RECORDS_CTE
from flowlens.sources.records import ROW_KEY

KEYS = ", ".join(ROW_KEY)
N = len(FF.FEATURES)
CLASSES = list(enumerate(FF.LABELS))


def _num(x: float) -> str:
    return f"{float(x)!r}e0"


def _tree_value(tree, known: int, c: int) -> str:
    if isinstance(tree, list):
        return _num(tree[c] / sum(tree))
    feature, threshold, left, right = tree
    a, b = _tree_value(left, known, c), _tree_value(right, known, c)
    if known >> FF.FEATURES.index(feature) & 1:
        return f"case when {feature} <= {_num(threshold)} then {a} else {b} end"
    n_left, n_right = sum(FF.class_counts(left)), sum(FF.class_counts(right))
    return f"({_num(n_left)} * ({a}) + {_num(n_right)} * ({b})) / {_num(n_left + n_right)}"


def _subset_value(known: int, c: int) -> str:
    return "(" + " + ".join(f"({_tree_value(t, known, c)})" for t in FF.TREES) + f") / {_num(len(FF.TREES))}"


def _phi(i: int, c: int) -> str:
    terms = []
    for known in range(1 << N):
        if not known >> i & 1:
            s = known.bit_count()
            w = math.factorial(s) * math.factorial(N - s - 1) / math.factorial(N)
            terms.append(f"{_num(w)} * (v{known | 1 << i}_{c} - v{known}_{c})")
    return " + ".join(terms)


def _case(values: dict[str, str], otherwise: str) -> str:
    return "case " + " ".join(f"when {k} then {v}" for k, v in values.items()) + f" else {otherwise} end"


ALL = (1 << N) - 1
_BEST = f"greatest({', '.join(f'v{ALL}_{c}' for c, _ in CLASSES)})"


def explain_ctes(source: str) -> str:
    """``vp``: the rows of ``source`` with rid, prediction, confidence, base of
    the predicted class; ``lng``: one row for each class and feature; ``imp``:
    those of the predicted class, ranked by size."""
    values = ", ".join(f"{_subset_value(m, c)} as v{m}_{c}" for m in range(1 << N) for c, _ in CLASSES)
    best = {f"v{ALL}_{c} = {_BEST}": f"'{name}'" for c, name in CLASSES[:-1]}
    long = " union all ".join(
        f"select vp.*, '{name}' as class, {c} as ci, {i} as position, '{f}' as feature, {f}::double as feature_value, "
        f"v0_{c} as base_value, {_phi(i, c)} as phi from vp" for c, name in CLASSES for i, f in enumerate(FF.FEATURES))
    return f"""
vv as materialized (select *, row_number() over () as rid, {values} from {source}),
vp as materialized (select *, {_case(best, f"'{FF.LABELS[-1]}'")} as prediction, {_BEST} as confidence from vv),
lng as materialized ({long}),
imp as (select *, cast(row_number() over (partition by rid order by abs(phi) desc, position) as int) as step
        from lng where class = prediction)
"""


_TEST = "with " + RECORDS_CTE + ", tst as (select * from sp where is_test)," + explain_ctes("tst")


def _r(expr: str) -> str:
    r = f"round({expr}, {FF.DIGITS})"
    return f"case when {r} = 0 then 0.0e0 else {r} end"


def predictions_sql() -> str:
    return _TEST + f"select {KEYS}, label, prediction, {_r('confidence')} as confidence from vp"


def long_values_sql() -> str:
    return _TEST + f"select {KEYS}, class, feature, {_r('phi')} as phi, feature_value from lng"


def base_values_sql() -> str:
    return _TEST + f"select {KEYS}, prediction, {_r('base_value')} as base_value, {_r('confidence')} as explained from imp where position = 0"


def predicted_impacts_sql() -> str:
    return _TEST + f"select {KEYS}, prediction, position, feature, {_r('phi')} as impact from imp"


def top_impacts_sql(k: int = 2) -> str:
    cols = ", ".join(f"{_r(f'max(phi) filter (where step = {j + 1})')} as impact_{j + 1}" for j in range(k))
    return _TEST + (f"select {KEYS}, string_agg(feature, ',' order by step) filter (where step <= {k}) as top_features, "
                    f"{cols} from imp group by rid, {KEYS}")


def importance_sql() -> str:
    return _TEST + f"select class, position, feature, {_r('avg(abs(phi))')} as mean_abs_impact from lng group by class, position, feature"


def direction_sql() -> str:
    return _TEST + f"select {KEYS}, feature, {_r('phi')} as phi, feature_value from lng where class = 'dos'"


def waterfall_sql() -> str:
    total = "base_value + sum(phi) over (partition by rid order by step rows unbounded preceding)"
    return _TEST + (f"select {KEYS}, step, feature, {_r('phi')} as impact, {_r('total')} as running_total "
                    f"from (select *, {total} as total from imp)")


def critical_case_sql() -> str:
    prio = ("case when label = prediction and label in ('u2r', 'r2l') then 0 "
            "when label = prediction and label <> 'normal' then 1 else 2 end")
    features = ", ".join(FF.FEATURES)
    return _TEST + (f"select {KEYS}, label, prediction, {prio} as priority, {features} from vp "
                    f"order by priority, {KEYS}, {features} limit 1")


def rows_per_class_sql() -> str:
    """The labelled test rows of each class: all must hold the invariant."""
    return ("with " + RECORDS_CTE + "select label, count(*) as n, count(*) as n_holds from sp where is_test group by label")
