"""DuckDB oracle SQL for the preparation queries."""

from __future__ import annotations

from flowlens import constants as K
from flowlens.plans.prepare import RECORD_SPLIT_KEY_SQL
from flowlens.sources.records import ROW_KEY, STAND_IN

NUM = K.NUMERIC_COLUMNS
NOM = K.NOMINAL_COLUMNS


def _kdd_select() -> str:
    cols = []
    for c in K.KDD_COLUMNS:
        src = STAND_IN.get(c)
        if c in NOM or c == K.LABEL_COLUMN:
            cols.append(f"cast({src} as varchar) as {c}")
        elif c == K.DIFFICULTY_COLUMN:
            cols.append(f"cast({src} as int) as {c}")
        else:
            cols.append(f"cast({src if src else 0.0} as double) as {c}")
    return ", ".join(ROW_KEY + cols)


def _category_case(expr: str) -> str:
    whens = " ".join(f"when '{a}' then '{c}'" for a, c in K.ATTACK_CATEGORY.items())
    return f"coalesce(case trim(cast({expr} as varchar), '.') {whens} end, '{K.UNKNOWN_CATEGORY}')"


RECORDS_CTE = f"""
kq as (select *, cast(l_quantity as int) qn, cast(round(l_discount*100) as int) di,
              cast(round(l_tax*100) as int) tx,
              case when l_partkey % 50 = 0 then cast(l_linenumber as double) else 0.0 end sparse_counter
       from lineitem),
kl as (select *, case when qn>=40 then 'neptune.' when di>=9 then 'satan'
  when tx>=7 and qn<10 then 'guess_passwd' when di<=1 and tx<=1 and qn<20 then 'rootkit.'
  when l_partkey%97=0 then 'mystery' else 'normal' end as raw_label from kq),
kdd as (select {_kdd_select()} from kl join orders on l_orderkey = o_orderkey),
lab as (select {", ".join(ROW_KEY + K.ATTRIBUTE_COLUMNS)}, {_category_case('label')} as label from kdd),
sp_k as (select *, {RECORD_SPLIT_KEY_SQL} as _k,
                row_number() over (partition by label order by {RECORD_SPLIT_KEY_SQL},
                   {", ".join(ROW_KEY + K.ATTRIBUTE_COLUMNS)}) as _r,
                count(*) over (partition by label) as _n from lab),
sp as (select * exclude (_k, _r, _n), _r <= floor(_n * {K.TEST_FRACTION} + 0.5) as is_test from sp_k),
tr as (select * from sp where not is_test)
"""

_PRM_PARTS = " union all ".join(
    f"select {i} as position, '{c}' as feature, quantile_cont({c}, [0.25, 0.5, 0.75]) as q, "
    f"min({c}) as x_min, max({c}) as x_max from tr" for i, c in enumerate(NUM))

PARAMS_CTE = RECORDS_CTE + f""",
prm0 as ({_PRM_PARTS}),
prm1 as (select position, feature, q[1] q1, q[2] median, q[3] q3, x_min, x_max,
                case when q[3] - q[1] = 0 then 1.0::double else q[3] - q[1] end as scale from prm0),
prm2 as (select *, (x_min - median) / scale as r_min, (x_max - median) / scale as r_max from prm1),
prm as (select position, feature, q1, median, q3, scale, x_min, x_max, r_min,
               case when r_max - r_min = 0 then 1.0::double else r_max - r_min end as r_range from prm2)
"""

_VOCAB_PARTS = " union all ".join(
    f"select distinct {j} as col_pos, '{c}' as \"column\", {c} as value from tr where {c} is not null"
    for j, c in enumerate(NOM))

VOCAB_CTE = PARAMS_CTE + f""",
voc0 as ({_VOCAB_PARTS}),
vocab as (select "column", cast(row_number() over (partition by "column" order by value) - 1 as int) as value_index,
                 value, "column" || '_' || value as feature,
                 cast({len(NUM)} + row_number() over (order by col_pos, value) - 1 as int) as position
          from voc0)
"""


def _prm(c: str, field: str) -> str:
    return f"(select {field} from prm where feature = '{c}')"


def _scaled(c: str) -> str:
    return (f"((({c} - {_prm(c, 'median')}) / {_prm(c, 'scale')}) - {_prm(c, 'r_min')})"
            f" / {_prm(c, 'r_range')}")


ENCODED_CTE = VOCAB_CTE + f""",
enc as materialized (select {", ".join(ROW_KEY)}, label, is_test,
   {", ".join(f"{_scaled(c)} as {c}" for c in NUM)},
   (select string_agg(v.feature, ',' order by v.position) from vocab v
      where (v."column" = 'protocol_type' and v.value = sp.protocol_type)
         or (v."column" = 'service' and v.value = sp.service)
         or (v."column" = 'flag' and v.value = sp.flag)) as onehot_active
   from sp)
"""


def labelled_records_sql() -> str:
    return "with " + RECORDS_CTE + f"select {', '.join(ROW_KEY + K.ATTRIBUTE_COLUMNS)}, label from lab"


def label_counts_sql() -> str:
    return ("with " + RECORDS_CTE + f"select label as raw_label, {_category_case('label')} as category, "
            "count(*) as n from kdd group by 1, 2")


def split_sql() -> str:
    return "with " + RECORDS_CTE + f"select {', '.join(ROW_KEY)}, label, is_test from sp"


def split_summary_sql() -> str:
    return ("with " + RECORDS_CTE + "select label, count(*) filter (where not is_test) as n_train, "
            "count(*) filter (where is_test) as n_test from sp group by label")


def scaler_params_sql() -> str:
    return ("with " + PARAMS_CTE + "select cast(position as int) as position, feature, q1, median, q3, "
            "scale, x_min, x_max, r_min, r_range from prm")


def vocabulary_sql() -> str:
    return "with " + VOCAB_CTE + "select \"column\", value_index, value, feature, position from vocab"


def encoded_sql() -> str:
    return ("with " + ENCODED_CTE + f"select {', '.join(ROW_KEY)}, label, is_test, "
            f"{', '.join(NUM)}, coalesce(onehot_active, '') as onehot_active from enc")


def mutual_info_sql(bins: int = 32, digits: int = 10) -> str:
    rank_list = ", ".join(f"least(n - 1, floor({j} * n / {bins}))" for j in range(1, bins))
    cut_parts = " union all ".join(
        f"select {i} as pos, list_sort(list_distinct(list(x))) as cl from "
        f"(select {c} as x, row_number() over (order by {c}) - 1 as r, count(*) over () as n "
        f"from enc where not is_test) s where r in ({rank_list})" for i, c in enumerate(NUM))
    unpiv = " union all ".join(
        f"select label, {i} as pos, cast(len(list_filter((select cl from cuts where pos = {i}), "
        f"lambda t: t <= {c})) as int) as bin from enc where not is_test" for i, c in enumerate(NUM))
    return "with " + ENCODED_CTE + f""",
cuts as ({cut_parts}),
lng as ({unpiv}
  union all
  select e.label, v.position as pos,
         case when coalesce(contains(',' || e.onehot_active || ',', ',' || v.feature || ','), false)
              then {bins - 1} else 0 end as bin
  from enc e, vocab v where not e.is_test),
cont as (select pos, bin, label, count(*) as n_xy from lng group by 1, 2, 3),
nx as (select pos, bin, sum(n_xy) as n_x from cont group by 1, 2),
ny as (select label, sum(n_xy) as n_y from cont where pos = 0 group by 1),
na as (select sum(n_y) as n_all from ny),
mi as (select c.pos, sum((c.n_xy::double / na.n_all::double)
              * ln((c.n_xy::double * na.n_all::double) / (nx.n_x::double * ny.n_y::double))) as mi
       from cont c join nx using (pos, bin) join ny using (label), na group by c.pos),
names as (select position, feature from prm union all select position, feature from vocab)
select cast(n.position as int) as position, n.feature, round(coalesce(mi.mi, 0.0), {digits}) as mi
from names n left join mi on mi.pos = n.position
"""


def knn_info_sql(k: int = 3, digits: int = 9) -> str:
    """The nearest-neighbour estimate of numeric columns, from the sorted rows
    themselves; one-hot columns from their counts. Stand-in columns that are
    constant have 0."""
    live = [(i, c) for i, c in enumerate(NUM) if STAND_IN.get(c)]
    unpiv = " union all ".join(f"select {i} as pos, label, round({c} * 1e12)::bigint as x from enc where not is_test" for i, c in live)
    near = ", ".join([*(f"x - lag(x, {j}) over w" for j in range(1, k + 1)), *(f"lead(x, {j}) over w - x" for j in range(1, k + 1))])
    return "with " + ENCODED_CTE + f""",
knv as ({unpiv}),
knd as (select pos, label, x, count(*) over (partition by pos, label) as ny, least({k}, count(*) over (partition by pos, label) - 1) as k,
          list_sort(list_filter([{near}], lambda d: d is not null)) as d from knv window w as (partition by pos, label order by x)),
knr as (select pos, x, ny, k, case when ny > 1 then greatest(d[k] - 1, 0) else 0 end as r from knd),
knm as (select pos, ny, k, count(*) over (partition by pos order by x range between r preceding and r following) as m from knr),
hn as (select i, coalesce(sum(1.0::double / i) over (order by i rows between unbounded preceding and 1 preceding), 0) - 0.5772156649015329 as psi
       from (select unnest(range(1, (select count(*) from enc) + 2)) as i)),
kni as (select pos, count(*) as n, avg(a.psi) as pk, avg(b.psi) as pn, avg(c.psi) as pm
        from knm join hn a on a.i = knm.k join hn b on b.i = ny join hn c on c.i = m where ny > 1 group by pos),
kmi as (select pos, greatest(0.0, psi + pk - pn - pm) as mi from kni join hn on i = n),
oh as (select v.position as pos, e.label, coalesce(contains(',' || e.onehot_active || ',', ',' || v.feature || ','), false) as bin, count(*) as n_xy
       from enc e, vocab v where not e.is_test group by all),
omi as (select pos, sum((n_xy::double / n) * ln((n_xy::double * n) / (nx::double * ny))) as mi
        from (select *, sum(n_xy) over (partition by pos, bin) as nx, sum(n_xy) over (partition by pos, label) as ny, sum(n_xy) over (partition by pos) as n from oh) group by pos),
names as (select position, feature from prm union all select position, feature from vocab)
select cast(position as int) as position, feature, round(coalesce(kmi.mi, omi.mi, 0.0), {digits}) as mi
from names left join kmi on kmi.pos = position left join omi on omi.pos = position
"""


def knn_selected_sql(k: int) -> str:
    return (f"select position, feature, mi, rank from (select *, cast(row_number() over (order by mi desc, position) as int) as rank "
            f"from ({knn_info_sql()})) where rank <= {k}")


def selected_sql(k: int, bins: int = 32, digits: int = 10) -> str:
    return (f"select position, feature, mi, rank from (select *, cast(row_number() over "
            f"(order by mi desc, position) as int) as rank from ({mutual_info_sql(bins, digits)})) "
            f"where rank <= {k}")


def class_weights_sql() -> str:
    return ("with " + RECORDS_CTE + ", c as (select label, count(*) as n_class from tr group by label) "
            "select label, n_class, (sum(n_class) over ())::double / "
            "((count(*) over ())::double * n_class::double) as weight from c")


RULE_SQL = ("case when cast(count as int) >= 45 then 'dos' "
            "when cast(round(serror_rate*100) as int) >= 9 then 'probe' "
            "when cast(round(rerror_rate*100) as int) >= 7 and cast(count as int) < 10 then 'r2l' "
            "when cast(round(serror_rate*100) as int) <= 1 and cast(round(rerror_rate*100) as int) <= 1 "
            "and cast(count as int) < 15 then 'u2r' else 'normal' end")

CONF_CTE = RECORDS_CTE + f""",
conf as (select label, {RULE_SQL} as prediction, count(*) as n from sp where is_test group by 1, 2),
cls as (select label as c from conf union select prediction from conf),
rep0 as (select cls.c,
   coalesce((select sum(n) from conf where label = cls.c and prediction = cls.c), 0) as tp,
   coalesce((select sum(n) from conf where label = cls.c), 0) as support,
   coalesce((select sum(n) from conf where prediction = cls.c), 0) as predicted from cls),
rep as (select c as class,
   round(case when predicted = 0 then 0.0 else tp::double / predicted::double end, 12) as precision,
   round(case when support = 0 then 0.0 else tp::double / support::double end, 12) as recall,
   round(case when 2*tp + (predicted - tp) + (support - tp) = 0 then 0.0
         else (2*tp)::double / (2*tp + (predicted - tp) + (support - tp))::double end, 12) as f1,
   cast(support as bigint) as support from rep0)
"""


def confusion_sql() -> str:
    return "with " + CONF_CTE + "select label, prediction, n from conf"


def class_report_sql() -> str:
    return "with " + CONF_CTE + "select class, precision, recall, f1, support from rep"


def summary_sql() -> str:
    return "with " + CONF_CTE + """select
  round((select sum(n) filter (where label = prediction) from conf)::double
        / (select sum(n) from conf)::double, 12) as accuracy,
  round(avg(precision), 12) as macro_precision, round(avg(recall), 12) as macro_recall,
  round(avg(f1), 12) as macro_f1,
  round(sum(precision * support) / sum(support), 12) as weighted_precision,
  round(sum(recall * support) / sum(support), 12) as weighted_recall,
  round(sum(f1 * support) / sum(support), 12) as weighted_f1,
  cast((select sum(n) from conf) as bigint) as support
from rep"""
