"""DuckDB oracle SQL for the first round of softmax boosting: the trees grown
from the gradients of the class shares, level by level."""

from __future__ import annotations

from flowlens import constants as K
from flowlens.plans.oracle_prep_sql import RECORDS_CTE

#: Attributes and cut points of the check (a row goes left of a cut when its value is not above it).
FEATURES: dict[str, list[float]] = {
    "src_bytes": [10000.0, 20000.0, 30000.0, 45000.0, 60000.0],
    "count": [5.0, 10.0, 14.0, 19.0, 25.0, 32.0, 39.0, 44.0],
    "serror_rate": [0.005, 0.015, 0.035, 0.055, 0.085],
    "rerror_rate": [0.005, 0.015, 0.035, 0.065],
    "num_root": [0.0, 1.0, 2.0, 4.0],
}
DEPTH, MIN_ROWS, RATE = 3, 20, 0.03


def first_round_sql() -> str:
    bins = ", ".join(f"case when {c} is null then {len(cuts)} else " + " + ".join(f"({c} > {t})::int" for t in cuts) + f" end as b{i}"
                     for i, (c, cuts) in enumerate(FEATURES.items()))
    names = [f"b{i}" for i in range(len(FEATURES))]
    ctes = [f"""
r0 as (select label as y, {bins} from lab where label <> '{K.UNKNOWN_CATEGORY}'),
r as (select y, {", ".join(names)}, count(*)::double as n from r0 group by all),
cl as (select y as c, sum(n) / sum(sum(n)) over () as s, count(*) over () as k from r group by y),
l0 as (select r.*, c, s, k, 1 as node from r cross join cl)"""]
    for d in range(DEPTH + 1):
        unpivot = " union all ".join(f"select c, node, {i} as f, {b} as bin, sum(n) as n, sum(n * (s - (y = c)::int)) as g, sum(n * s * (1 - s) * k / (k - 1)) as h from l{d} group by c, node, {b}"
                                     for i, b in enumerate(names))
        over = "over (partition by c, node, f order by bin)"
        down = " ".join(f"when t.f = {i} then {b}" for i, b in enumerate(names))
        ctes.append(f"""
h{d} as ({unpivot}),
t{d} as (select c, node, sum(n) as n, sum(g) as g, sum(h) as h from h{d} where f = 0 group by c, node),
a{d} as (select c, node, f, bin, sum(n) {over} as nl, sum(g) {over} as gl, sum(h) {over} as hl from h{d}),
g{d} as (select a.*, round(gl * gl / hl + (t.g - gl) * (t.g - gl) / (t.h - hl) - t.g * t.g / t.h, 6) as gain
        from a{d} a join t{d} t using (c, node) where nl >= {MIN_ROWS} and t.n - nl >= {MIN_ROWS}),
s{d} as (select * from (select *, row_number() over (partition by c, node order by gain desc, f, bin) as k from g{d} where gain > 0) where k = 1 and {d} < {DEPTH}),
l{d + 1} as (select l.* exclude (node), 2 * l.node + (case {down} end > t.bin)::int as node from l{d} l join s{d} t using (c, node))""")
    cut = "case " + " ".join(f"when s.f = {i} and s.bin = {j} then {t}::double" for i, cuts in enumerate(FEATURES.values()) for j, t in enumerate(cuts)) + " end"
    name = "case " + " ".join(f"when s.f = {i} then '{c}'" for i, c in enumerate(FEATURES)) + " end"
    rows = " union all ".join(f"select t.c as label, 0 as round, t.node::int as node, {name} as feature, {cut} as cut, "
                              f"round(case when t.node = 1 and s.f is null then 0 else -{RATE} * t.g / t.h end, 9) + 0.0 as value from t{d} t left join s{d} s using (c, node)" for d in range(DEPTH + 1))
    return "with " + RECORDS_CTE.rstrip() + "," + ",".join(ctes) + "\n" + rows
