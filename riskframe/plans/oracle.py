"""DuckDB SQL twins of the registered queries (the correctness oracle).

Each query re-derives its stand-in view from the driver tables with a CTE.
Output conventions match ``riskframe.plans.tidy``: integral → bigint,
fractional → double rounded to 6 decimals.
"""

from __future__ import annotations

from riskframe.functions.rng import h_sql as H
from riskframe.operators.explain import PERMUTED


def R(x: str, d: int = 6) -> str:
    return f"round(cast({x} as double), {d})"


def B(x: str) -> str:
    return f"cast({x} as bigint)"


SCORED = f"""
scored as (
  select id, m, pi, (cast(pi as double)*pi)/1000000.0E0 as p,
         case when {H("'y'", "id")} % 1000000 < pi0*pi0 then 1 else 0 end as y
  from (select id, m, pi0,
               greatest(0, least(1000, pi0 + m*(({H("'n'", "concat(id,'|',m)")} % 201) - 100))) as pi
        from (select concat(l_orderkey,'-',l_linenumber,'-',l_partkey,'-',l_suppkey) as id,
                     12*cast(l_quantity as bigint) + 40*cast(round(l_discount*100) as bigint) as pi0
              from lineitem) a,
             (select unnest([0, 1, 2]) as m) b) c)"""

OBS = f"""
obs as (
  select o_orderkey as id, o_totalprice, c_acctbal, cast(n_lines as double) as n_lines, qty, max_price,
         cast(n_regionkey as double) as region_no, o_orderstatus,
         nullif(c_mktsegment, 'MACHINERY') as c_mktsegment, n_name,
         case when {H("3", "o_orderkey")} % 50 = 0 then null
              else cast(substr(o_orderpriority,1,1) as int) - 1 end as num
  from orders
  left join (select l_orderkey, count(*) n_lines, sum(l_quantity) qty, max(l_extendedprice) max_price
             from lineitem group by l_orderkey) li on l_orderkey = o_orderkey
  join customer on o_custkey = c_custkey
  join nation on c_nationkey = n_nationkey)"""

# curve table per model: cumulative counts over scores >= threshold
CURVE = """
g as (select m, p, sum(y) as pos, count(*) as cnt from scored group by m, p),
c as (select m, p as threshold, pos, cnt,
             sum(pos) over (partition by m order by p desc rows between unbounded preceding and current row) as tp,
             sum(cnt) over (partition by m order by p desc rows between unbounded preceding and current row) as n,
             sum(pos) over (partition by m) as tt,
             sum(cnt) over (partition by m) - sum(pos) over (partition by m) as nn
      from g)"""


def _with(*ctes: str) -> str:
    return "with " + ",\n".join(c.strip() for c in ctes) + "\n"


ORACLE: dict[str, str] = {}

ORACLE["confusion_matrix"] = _with(SCORED) + f"""
select {B('m')} as m,
       {B("count(*) filter (where y = 0 and p < 0.5)")} as tn,
       {B("count(*) filter (where y = 0 and p >= 0.5)")} as fp,
       {B("count(*) filter (where y = 1 and p < 0.5)")} as fn,
       {B("count(*) filter (where y = 1 and p >= 0.5)")} as tp
from scored group by m"""

ORACLE["pr_curve"] = _with(SCORED, CURVE) + f"""
select {B('m')} as m, {R('threshold')} as threshold, {R('tp*1.0E0/n')} as precision,
       {R('case when tt = 0 then 1.0E0 else tp*1.0E0/tt end')} as recall, {B('tp')} as tp, {B('n - tp')} as fp
from c"""

ORACLE["roc_curve"] = _with(SCORED, CURVE) + f"""
select {B('m')} as m, {R('threshold')} as threshold, {R('(n-tp)*1.0E0/nullif(nn,0)')} as fpr,
       {R('tp*1.0E0/nullif(tt,0)')} as tpr
from c
union all
select distinct {B('m')} as m, cast(null as double) as threshold, 0.0E0 as fpr, 0.0E0 as tpr from scored"""

_AUC = "sum((cnt - pos) * (tp - pos/2.0E0)) / nullif(max(tt)*max(nn), 0)"
_AP = "sum(pos * (tp*1.0E0/n)) / nullif(max(tt), 0)"

ORACLE["roc_auc"] = _with(SCORED, CURVE) + f"""
select {B('m')} as m, {R(_AUC)} as roc_auc from c group by m"""

ORACLE["average_precision"] = _with(SCORED, CURVE) + f"""
select {B('m')} as m, {R(_AP)} as pr_auc from c group by m"""

ORACLE["cost_optimal_threshold"] = _with(SCORED, CURVE) + f"""
select {B('m')} as m, {R('threshold')} as threshold, {R('cost')} as cost from (
  select m, threshold, round(5*(1 - case when tt = 0 then 1.0E0 else tp*1.0E0/tt end) + 1*(1 - tp*1.0E0/n), 12) as cost,
         row_number() over (partition by m order by
            round(5*(1 - case when tt = 0 then 1.0E0 else tp*1.0E0/tt end) + 1*(1 - tp*1.0E0/n), 12), threshold) as rk
  from c) z where rk = 1"""

_CM = """
cm as (select m,
              count(*) filter (where y = 0 and p < 0.5) as tn, count(*) filter (where y = 0 and p >= 0.5) as fp,
              count(*) filter (where y = 1 and p < 0.5) as fn, count(*) filter (where y = 1 and p >= 0.5) as tp
       from scored group by m)"""


def _z(num: str, den: str) -> str:
    return f"coalesce(({num})*1.0E0/nullif({den}, 0), 0.0E0)"


ORACLE["core_metrics"] = _with(SCORED, CURVE, _CM) + f"""
select {B('cm.m')} as m, {R(_z('tp+tn', 'tp+tn+fp+fn'))} as accuracy, {R(_z('tp', 'tp+fp'))} as precision,
       {R(_z('tp', 'tp+fn'))} as recall, {R(_z('2*tp', '2*tp+fp+fn'))} as f1_score,
       {R('a.roc_auc')} as roc_auc, {R('a.pr_auc')} as pr_auc, {B('fn')} as false_negatives, {B('fp')} as false_positives
from cm join (select m, {_AUC} as roc_auc, {_AP} as pr_auc from c group by m) a on a.m = cm.m"""

ORACLE["compare_models"] = ORACLE["core_metrics"].replace(
    f"select {B('cm.m')} as m,", "select concat('m', cm.m) as model,")

ORACLE["rank_models"] = f"""
select model, recall, precision from ({ORACLE['compare_models']}) z
order by recall desc, precision desc, model asc limit 1"""

ORACLE["melt_metrics"] = f"""
select model, metric, score from ({ORACLE['compare_models']}) z
unpivot (score for metric in (accuracy, precision, recall, f1_score, roc_auc, pr_auc))"""

ORACLE["classification_report"] = _with(SCORED, _CM) + f"""
select {B('m')} as m, label, {R('pr')} as precision, {R('rc')} as recall, {R('f')} as f1_score, {B('sup')} as support
from (
  select m, '0' as label, {_z('tn', 'tn+fn')} as pr, {_z('tn', 'tn+fp')} as rc, {_z('2*tn', '2*tn+fn+fp')} as f,
         tn+fp as sup from cm
  union all
  select m, '1', {_z('tp', 'tp+fp')}, {_z('tp', 'tp+fn')}, {_z('2*tp', '2*tp+fp+fn')}, tp+fn from cm
  union all
  select m, 'accuracy', null, null, {_z('tp+tn', 'tp+tn+fp+fn')}, tp+tn+fp+fn from cm
  union all
  select m, 'macro avg', ({_z('tn', 'tn+fn')} + {_z('tp', 'tp+fp')})/2, ({_z('tn', 'tn+fp')} + {_z('tp', 'tp+fn')})/2,
         ({_z('2*tn', '2*tn+fn+fp')} + {_z('2*tp', '2*tp+fp+fn')})/2, tp+tn+fp+fn from cm
  union all
  select m, 'weighted avg',
         {_z(f"{_z('tn', 'tn+fn')}*(tn+fp) + {_z('tp', 'tp+fp')}*(tp+fn)", 'tp+tn+fp+fn')},
         {_z(f"{_z('tn', 'tn+fp')}*(tn+fp) + {_z('tp', 'tp+fn')}*(tp+fn)", 'tp+tn+fp+fn')},
         {_z(f"{_z('2*tn', '2*tn+fn+fp')}*(tn+fp) + {_z('2*tp', '2*tp+fp+fn')}*(tp+fn)", 'tp+tn+fp+fn')},
         tp+tn+fp+fn from cm) z"""

ORACLE["threshold_simulation"] = _with(SCORED) + f"""
select {B('m')} as m, {R('t')} as threshold,
       {B('count(*) filter (where p >= t and y = 1)')} as tp, {B('count(*) filter (where p < t and y = 1)')} as fn,
       {B('count(*) filter (where p >= t and y = 0)')} as fp,
       case when count(*) filter (where y = 0) > 0
            then printf('%.3f%%', count(*) filter (where p >= t and y = 0) * 100.0E0 / count(*) filter (where y = 0))
            else '0.000%' end as healthy_flagged_rate
from scored, (select unnest([0.1E0, 0.2E0, 0.3E0, 0.5E0, 0.7E0, 0.9E0]) as t) ts
group by m, t"""

ORACLE["threshold_confusions"] = _with(SCORED, CURVE) + f""",
opt as (select m, threshold as t from (
  select m, threshold, row_number() over (partition by m order by
     round(5*(1 - case when tt = 0 then 1.0E0 else tp*1.0E0/tt end) + 1*(1 - tp*1.0E0/n), 12), threshold) as rk
  from c) z where rk = 1),
cuts as (select m, 'low' as cut, 0.2E0 as t from opt union all select m, 'optimal', t from opt
         union all select m, 'high', 0.3E0 from opt)
select {B('s.m')} as m, cut, {R('cuts.t')} as threshold,
       {B('count(*) filter (where p < cuts.t and y = 0)')} as tn, {B('count(*) filter (where p >= cuts.t and y = 0)')} as fp,
       {B('count(*) filter (where p < cuts.t and y = 1)')} as fn, {B('count(*) filter (where p >= cuts.t and y = 1)')} as tp
from scored s join cuts on s.m = cuts.m
group by s.m, cut, cuts.t"""

ORACLE["brier_score"] = _with(SCORED) + f"""
select {B('m')} as m, {R('avg((p - y)*(p - y))')} as brier_score from scored group by m"""

ORACLE["calibration_curve"] = _with(SCORED) + f""",
e as (select m, quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as q from scored group by m)
select {B('s.m')} as m, {B('len(list_filter(e.q, lambda x: x < s.p))')} as bin,
       {R('avg(s.p)')} as mean_pred, {R('avg(cast(s.y as double))')} as frac_pos, {B('count(*)')} as n
from scored s join e on s.m = e.m
group by s.m, len(list_filter(e.q, lambda x: x < s.p))"""


# --------------------------------------------------------------------------- `obs`: targets, splits, profiling

LAB = "lab as (select *, cast(num > 0 as int) as y from obs where num is not null)"
SPLIT = f"""
sp as (select *, case when rk <= round(0.2E0 * cn) then 'test' else 'train' end as split
       from (select *, row_number() over (partition by y order by {H("42", "id")}, id) as rk,
                    count(*) over (partition by y) as cn from lab) z)"""
TRAIN = "tr as (select * from sp where split = 'train')"
OBS_NUM = ["o_totalprice", "c_acctbal", "n_lines", "qty", "max_price", "region_no"]
OBS_CAT = ["o_orderstatus", "c_mktsegment", "n_name"]

ORACLE["value_counts_with_null"] = _with(OBS) + f"""
select {B('num')} as num, {B('count(*)')} as n from obs group by num"""

ORACLE["binarize_target"] = _with(OBS, LAB) + f"""
select {B('id')} as id, {B('num')} as num, {B('y')} as y from lab"""

ORACLE["stratified_split"] = _with(OBS, LAB, SPLIT) + f"""
select {B('id')} as id, {B('y')} as y, split from sp"""

ORACLE["stratified_kfold"] = _with(OBS, LAB) + f"""
select {B('id')} as id, {B('y')} as y,
       {B(f"(row_number() over (partition by y order by {H('42', 'id')}, id) - 1) % 5")} as fold
from lab"""

ORACLE["shape_report"] = _with(OBS, LAB, SPLIT) + f"""
select split, {B('count(*)')} as n_rows, {B(str(len(OBS_NUM) + len(OBS_CAT)))} as n_cols from sp group by split"""

ORACLE["describe_numeric"] = _with(OBS) + f"""
select feature, {B('count(v)')} as count, {R('avg(v)')} as mean, {R('stddev_samp(v)')} as std,
       {R('min(v)')} as min, {R('quantile_cont(v, 0.25)')} as p25, {R('quantile_cont(v, 0.5)')} as p50,
       {R('quantile_cont(v, 0.75)')} as p75, {R('max(v)')} as max
from (select * from (select {', '.join(f'cast({c} as double) as {c}' for c in OBS_NUM)} from obs)
      unpivot include nulls (v for feature in ({', '.join(OBS_NUM)}))) u
group by feature"""

_OBS_TYPES = [("id", "bigint"), ("o_totalprice", "double"), ("c_acctbal", "double"), ("n_lines", "double"),
              ("qty", "double"), ("max_price", "double"), ("region_no", "double"), ("o_orderstatus", "string"),
              ("c_mktsegment", "string"), ("n_name", "string"), ("num", "int")]
_TYPE_MAP = ("case typeof({c}) when 'BIGINT' then 'bigint' when 'DOUBLE' then 'double' "
             "when 'VARCHAR' then 'string' when 'INTEGER' then 'int' else lower(typeof({c})) end")

ORACLE["schema_profile"] = _with(OBS) + "\n union all\n".join(
    f"select {B(str(i))} as position, '{c}' as column, (select {_TYPE_MAP.format(c=c)} from obs limit 1) as dtype, "
    f"{B(f'count({c})')} as non_null from obs" for i, (c, _) in enumerate(_OBS_TYPES))

ORACLE["select_numeric"] = _with(OBS) + f"""
select {B('id')} as id, {', '.join(f'{R(c)} as {c}' for c in OBS_NUM)} from obs"""


def _corr_sql(a: str, b: str) -> str:
    both = f"{a} is not null and {b} is not null"
    xa, xb = f"case when {both} then {a} end", f"case when {both} then {b} end"
    return f"covar_samp({xa}, {xb}) / nullif(stddev_samp({xa}) * stddev_samp({xb}), 0)"


_PAIRS = [(OBS_NUM[i], OBS_NUM[j]) for i in range(len(OBS_NUM)) for j in range(i + 1, len(OBS_NUM))]
_CORR = "corr as (" + "\n union all\n".join(
    f"select '{a}' as feature_a, '{b}' as feature_b, {_corr_sql(a, b)} as r from obs" for a, b in _PAIRS) + ")"

ORACLE["correlation_matrix"] = _with(OBS, _CORR) + f"""
select feature_a, feature_b, {R('r')} as r from corr"""

ORACLE["prune_correlated"] = _with(OBS, _CORR) + """
select distinct feature_b as column from corr where abs(r) > 0.85"""

HEART_OBS = f"""
heart_obs as (
  select o_orderkey as id, cast(29 + {H("'age'", 'o_orderkey')} % 49 as double) as age,
         case when {H("'na1'", 'o_orderkey')} % 20 = 0 then null
              else cast(90 + {H("'bp'", 'o_orderkey')} % 111 as double) end as trestbps,
         case when {H("'na3'", 'o_orderkey')} % 30 = 0 then null
              else cast(120 + {H("'ch'", 'o_orderkey')} % 400 as double) end as chol,
         case when {H("'na2'", 'o_orderkey')} % 25 = 0 then null
              else cast(60 + {H("'hr'", 'o_orderkey')} % 143 as double) end as thalch,
         ({H("'op'", 'o_orderkey')} % 63) / 10.0E0 as oldpeak,
         case when {H("'na4'", 'o_orderkey')} % 40 = 0 then null
              else cast({H("'ca'", 'o_orderkey')} % 4 as double) end as ca,
         case when {H("3", "o_orderkey")} % 50 = 0 then null
              else cast(substr(o_orderpriority,1,1) as int) - 1 end as num,
         ['female', 'male', 'male'][{H("'sx'", 'o_orderkey')} % 3 + 1] as sex,
         ['asymptomatic', 'atypical angina', 'non-anginal', 'typical angina'][{H("'cp'", 'o_orderkey')} % 4 + 1] as cp,
         case when {H("'na5'", 'o_orderkey')} % 15 = 0 then null
              else ['fixed defect', 'normal', 'reversable defect'][{H("'th'", 'o_orderkey')} % 3 + 1] end as thal,
         {H("'fb'", 'o_orderkey')} % 5 = 0 as fbs
  from orders)"""
HLAB = "hlab as (select *, cast(num > 0 as int) as y from heart_obs where num is not null)"
HSPLIT = f"""
hsp as (select *, case when rk <= round(0.2E0 * cn) then 'test' else 'train' end as split
        from (select *, row_number() over (partition by y order by {H("42", "id")}, id) as rk,
                     count(*) over (partition by y) as cn from hlab) z)"""
HEART_NUM = ["age", "trestbps", "chol", "thalch", "oldpeak", "ca"]

ORACLE["heart_features"] = _with(HEART_OBS) + f"""
select {B('id')} as id, {R('thalch / ((220.0E0 - age) + 1e-5)')} as max_hr_ratio,
       {R('trestbps / (thalch + 1e-5)')} as bp_hr_index, {R('age * oldpeak')} as age_st_interaction
from heart_obs"""

ORACLE["risk_band"] = _with(SCORED) + f"""
select {B('m')} as m, case when p < 0.2 then 'Low Risk' when p < 0.5 then 'Medium Risk' else 'High Risk' end
       as risk_level, {B('count(*)')} as n
from scored group by all"""

ORACLE["label_names"] = _with(OBS, LAB) + f"""
select case when y = 0 then 'Healthy' when y = 1 then 'Disease' end as label, {B('count(*)')} as n
from lab group by all"""

_CAT_LONG = "cl as (" + "\n union all\n".join(
    f"select id, split, '{c}' as column_name, cast({c} as varchar) as value from sp" for c in OBS_CAT) + ")"

ORACLE["fit_mode"] = _with(OBS, LAB, SPLIT, _CAT_LONG) + f"""
select column_name, value, {B('n')} as n from (
  select column_name, value, count(*) as n,
         row_number() over (partition by column_name order by count(*) desc, value) as rk
  from cl where split = 'train' and value is not null group by column_name, value) z where rk = 1"""

ORACLE["mode_impute"] = _with(OBS, LAB, SPLIT, _CAT_LONG) + f""",
md as (select column_name, value from (
  select column_name, value, row_number() over (partition by column_name order by count(*) desc, value) as rk
  from cl where split = 'train' and value is not null group by column_name, value) z where rk = 1)
select {B('id')} as id, {', '.join(f"coalesce({c}, (select value from md where column_name = '{c}')) as {c}" for c in OBS_CAT)}
from sp"""

_ROBUST = "rb as (" + "\n union all\n".join(
    f"select '{c}' as column_name, quantile_cont({c}, 0.5) as median, "
    f"quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) as iqr from tr" for c in OBS_NUM) + ")"
_STD = "st as (" + "\n union all\n".join(
    f"select '{c}' as column_name, avg({c}) as mean, stddev_pop({c}) as sd_pop from tr" for c in OBS_NUM) + ")"

ORACLE["fit_robust"] = _with(OBS, LAB, SPLIT, TRAIN, _ROBUST) + f"""
select column_name, {R('median')} as median, {R('iqr')} as iqr from rb"""

ORACLE["fit_standard"] = _with(OBS, LAB, SPLIT, TRAIN, _STD) + f"""
select column_name, {R('mean')} as mean, {R('sd_pop')} as sd_pop from st"""

ORACLE["robust_scale"] = _with(OBS, LAB, SPLIT, TRAIN, _ROBUST) + f"""
select {B('id')} as id, {', '.join(
    R(f"({c} - (select median from rb where column_name = '{c}')) / "
      f"coalesce(nullif((select iqr from rb where column_name = '{c}'), 0), 1)") + f' as {c}' for c in OBS_NUM)}
from sp"""

ORACLE["standard_scale"] = _with(OBS, LAB, SPLIT, TRAIN, _STD) + f"""
select {B('id')} as id, {', '.join(
    R(f"({c} - (select mean from st where column_name = '{c}')) / "
      f"coalesce(nullif((select sd_pop from st where column_name = '{c}'), 0), 1)") + f' as {c}' for c in OBS_NUM)}
from sp"""

_CATS = "cats as (select distinct column_name, value from cl where split = 'train' and value is not null)"

ORACLE["fit_one_hot"] = _with(OBS, LAB, SPLIT, _CAT_LONG, _CATS) + f"""
select column_name, value, {B('row_number() over (partition by column_name order by value) - 1')} as pos from cats"""

ORACLE["one_hot"] = _with(OBS, LAB, SPLIT, _CAT_LONG, _CATS) + f"""
select {B('cl.id')} as id, cl.column_name || '_' || cl.value as feature
from cl join cats on cl.column_name = cats.column_name and cl.value = cats.value"""

ORACLE["unseen_category_report"] = _with(OBS, LAB, SPLIT, _CAT_LONG, _CATS) + f"""
select c.column_name, {B('count(cl.value)')} as n_unseen
from (select unnest({OBS_CAT}) as column_name) c
left join (select * from cl where split = 'test' and value is not null
           and (column_name, value) not in (select (column_name, value) from cats)) cl on cl.column_name = c.column_name
group by c.column_name"""


def _nan_dist(cols, a="q", b="t"):
    d = len(cols)
    pres = " + ".join(f"cast({a}.{c} is not null and {b}.{c} is not null as int)" for c in cols)
    ss = " + ".join(f"coalesce(({a}.{c} - {b}.{c})*({a}.{c} - {b}.{c}), 0.0E0)" for c in cols)
    return f"case when ({pres}) > 0 then sqrt({float(d)} / ({pres}) * ({ss})) end"


ORACLE["knn_impute"] = _with(HEART_OBS, HLAB, HSPLIT) + f""",
tr as (select * from hsp where split = 'train'),
ql as (select id, f from hsp unpivot include nulls (v for f in ({', '.join(HEART_NUM)})) u where v is null),
tl as (select id, f, v from tr unpivot (v for f in ({', '.join(HEART_NUM)})) u),
pairs as (select ql.id as qid, ql.f, tl.v, {_nan_dist(HEART_NUM)} as dist, t.id as rid
          from ql join hsp q on q.id = ql.id join tl on tl.f = ql.f join tr t on t.id = tl.id),
top as (select qid, f, v from (select *, row_number() over (partition by qid, f order by dist, rid) as rk
                                from pairs where dist is not null) z where rk <= 5),
imp as (select qid, f, avg(v) as v from top group by qid, f)
select {B('h.id')} as id, {', '.join(
    R(f"coalesce(h.{c}, (select v from imp where imp.qid = h.id and imp.f = '{c}'), (select avg({c}) from tr))") + f" as {c}"
    for c in HEART_NUM)}
from hsp h"""


# --------------------------------------------------------------------------- anomaly detectors, clustering

PTS = [f"x{i}" for i in range(1, 9)]
POINTS = "points as (select vec_id, " + ", ".join(
    "(" + " + ".join(f"cast(embedding[{8 * (j - 1) + i}] as double)" for i in range(1, 9)) + f") as x{j}"
    for j in range(1, 9)) + ", label from embeddings)"
SPOINTS = "sp_pts as (select vec_id, " + ", ".join(
    f"(x{i} - avg(x{i}) over ()) / coalesce(nullif(stddev_pop(x{i}) over (), 0), 1) as x{i}" for i in range(1, 9)) + \
    " from points)"
_TAILS = f"""
pl as (select vec_id, feature, v from points unpivot (v for feature in ({', '.join(PTS)})) u),
sk as (select feature, sign(coalesce(avg(power(v - mv, 3)), 0)) as s
       from (select feature, v, avg(v) over (partition by feature) as mv from pl) z group by feature),
tl as (select vec_id, pl.feature, cume_dist() over (partition by pl.feature order by v) as l,
              cume_dist() over (partition by pl.feature order by v desc) as r, sk.s
       from pl join sk on pl.feature = sk.feature),
us as (select vec_id, feature, l, r, -ln(l) as ul, -ln(r) as ur,
              -ln(l) * (-sign(s - 1)) + -ln(r) * sign(s + 1) as uskew from tl),
tails as (select vec_id, sum(greatest(ul, ur, uskew)) as ecod, sum(greatest(uskew, (ul + ur) / 2)) as copod
          from us group by vec_id)"""

ORACLE["ecod_copod"] = _with(POINTS, _TAILS) + f"""
select {B('vec_id')} as vec_id, {R('ecod')} as ecod, {R('copod')} as copod from tails"""

ORACLE["ecdf"] = _with(POINTS, _TAILS) + f"""
select {B('vec_id')} as vec_id, feature, {R('l')} as left, {R('r')} as right from tl"""

ORACLE["contamination_cut"] = _with(POINTS, _TAILS) + f"""
select {B('vec_id')} as vec_id,
       {B("case when ecod > (select quantile_cont(ecod, 0.95) from tails) then -1 else 1 end")} as flag from tails"""

_VOTES = "votes as (" + "\n union all\n".join(
    f"select id, '{c}' as detector, case when {c} > (select quantile_cont({c}, 0.95) from obs) then -1 else 1 end as flag "
    f"from obs" for c in OBS_NUM) + ")"

ORACLE["stack_detector_votes"] = _with(OBS, _VOTES) + f"""
select {B('id')} as id, detector, {B('flag')} as flag from votes"""

ORACLE["normalize_anomaly_flag"] = ORACLE["stack_detector_votes"]

ORACLE["anomaly_counts"] = _with(OBS, _VOTES) + f"""
select detector, {B('count(*) filter (where flag = -1)')} as anomalies, {B('count(*) filter (where flag = 1)')} as normals,
       printf('%.2f%%', count(*) filter (where flag = -1) * 100.0E0 / count(*)) as anomaly_pct
from votes group by detector"""

ORACLE["anomaly_consensus"] = _with(OBS, _VOTES) + f"""
select {B('count(*) filter (where k >= 1)')} as any_detector, {B('count(*) filter (where k >= 3)')} as majority,
       {B(f'count(*) filter (where k = {len(OBS_NUM)})')} as all_detectors
from (select id, count(*) filter (where flag = -1) as k from votes group by id) z"""

ORACLE["mahalanobis"] = _with(POINTS) + f""",
m as (select avg(x1) as m1, avg(x2) as m2, var_pop(x1) as s11, var_pop(x2) as s22, covar_pop(x1, x2) as s12 from points)
select {B('vec_id')} as vec_id,
       {R('(s22*(x1-m1)*(x1-m1) - 2*s12*(x1-m1)*(x2-m2) + s11*(x2-m2)*(x2-m2)) / (s11*s22 - s12*s12)')} as mahalanobis
from points, m"""

_EPS = "sqrt(" + " + ".join(f"(a.x{i} - b.x{i})*(a.x{i} - b.x{i})" for i in range(1, 9)) + ")"
_PAIRS = f"pairs as (select a.vec_id as a, b.vec_id as b from sp_pts a join sp_pts b on {_EPS} <= 2.0)"

ORACLE["eps_range_self_join"] = _with(POINTS, SPOINTS, _PAIRS) + f"""
select {B('a')} as vec_id, {B('count(*)')} as degree from pairs group by a"""

ORACLE["dbscan"] = "with recursive " + ",\n".join(c.strip() for c in (POINTS, SPOINTS, _PAIRS)) + f""",
core as (select a as id from pairs group by a having count(*) >= 5),
ce as (select p.a, p.b from pairs p join core c1 on p.a = c1.id join core c2 on p.b = c2.id),
cc(id, lbl) as (select id, id from core union select ce.b, cc.lbl from cc join ce on ce.a = cc.id),
comp as (select id, min(lbl) as lbl from cc group by id),
border as (select p.a as id, min(comp.lbl) as lbl from pairs p join comp on p.b = comp.id
           where p.a not in (select id from core) group by p.a),
lab as (select * from comp union all select * from border)
select {B('s.vec_id')} as vec_id, {B('coalesce(lab.lbl, -1)')} as cluster
from sp_pts s left join lab on lab.id = s.vec_id"""


# --------------------------------------------------------------------------- estimators

LPTS = "lpts as (select *, cast(label >= 7 as int) as y from points)"
PSPLIT = f"""
psp as (select *, case when rk <= round(0.2E0 * cn) then 'test' else 'train' end as split
        from (select *, row_number() over (partition by y order by {H("42", "vec_id")}, vec_id) as rk,
                     count(*) over (partition by y) as cn from lpts) z)"""


def _nb_ll(cls: int) -> str:
    terms = [f"ln(s{cls}.prior)"]
    for c in PTS:
        v = f"(s{cls}.v_{c} + e.eps)"
        terms.append(f"- 0.5 * ln(2.0 * pi() * {v}) - (p.{c} - s{cls}.m_{c}) * (p.{c} - s{cls}.m_{c}) / (2.0 * {v})")
    return " ".join(terms)


ORACLE["gaussian_nb"] = _with(POINTS, LPTS) + f""",
st as (select y, count(*) * 1.0E0 / (select count(*) from lpts) as prior,
              {', '.join(f'avg({c}) as m_{c}, var_pop({c}) as v_{c}' for c in PTS)} from lpts group by y),
e as (select 1e-9 * greatest({', '.join(f'var_pop({c})' for c in PTS)}) as eps from lpts),
sc as (select p.vec_id, 1.0E0 / (1.0E0 + exp(({_nb_ll(0)}) - ({_nb_ll(1)}))) as prob
       from lpts p, e, (select * from st where y = 0) s0, (select * from st where y = 1) s1)
select {B('vec_id')} as vec_id, {R('prob')} as p, {B('prob > 0.5')} as pred from sc"""

_PD = "sqrt(" + " + ".join(f"(a.{c} - b.{c})*(a.{c} - b.{c})" for c in PTS) + ")"

ORACLE["knn_classifier"] = _with(POINTS, LPTS, PSPLIT) + f""",
nb as (select a.vec_id as q, b.y, row_number() over (partition by a.vec_id order by {_PD}, b.vec_id) as rk
       from (select * from psp where split = 'test') a, (select * from psp where split = 'train') b)
select {B('q')} as vec_id, {R('avg(y)')} as proba, {B('avg(y) > 0.5')} as pred from nb where rk <= 5 group by q"""

ORACLE["knn_join"] = _with(POINTS) + f"""
select {B('vec_id')} as vec_id, {B('neighbor_id')} as neighbor_id, {R('dist')} as dist, {B('rank')} as rank from (
  select a.vec_id, b.vec_id as neighbor_id, {_PD} as dist,
         row_number() over (partition by a.vec_id order by {_PD}, b.vec_id) as rank
  from points a join points b on a.vec_id <> b.vec_id) z where rank <= 5"""

ORACLE["smote"] = _with(POINTS, LPTS) + f""",
cnt as (select count(*) filter (where y = 1) as n_min, count(*) filter (where y = 0) as n_maj from lpts),
mino as (select * from lpts where y = 1),
rk as (select *, row_number() over (order by {H("42", "vec_id")}, vec_id) - 1 as r from mino),
nb as (select q, rid, rank from (select a.vec_id as q, b.vec_id as rid,
              row_number() over (partition by a.vec_id order by {_PD}, b.vec_id) as rank
       from mino a join mino b on a.vec_id <> b.vec_id) z where rank <= 5),
jobs as (select rk.*, cp * n_min + r as j from rk, cnt,
         unnest(range(0, (n_maj - n_min) // n_min + case when r < (n_maj - n_min) % n_min then 1 else 0 end)) t(cp)),
pick as (select jobs.*, {H("42", "concat('nn|', j)")} % least(5, n_min - 1) + 1 as nn,
                {H("42", "concat('lam|', j)")} / 4294967296.0E0 as lam from jobs, cnt)
select cast(vec_id as varchar) as vec_id, {B('y')} as y, {', '.join(f'{R(c)} as {c}' for c in PTS)}, false as synthetic
from lpts
union all
select 'syn-' || cast(j as varchar), {B('pick.y')}, {', '.join(R(f'pick.{c} + lam * (o.{c} - pick.{c})') + f' as {c}' for c in PTS)}, true
from pick join nb on nb.q = pick.vec_id and nb.rank = pick.nn join mino o on o.vec_id = nb.rid"""

ORACLE["isotonic_fit"] = _with(SCORED) + f""",
g as (select m, p, sum(y) as sy, count(*) as n, row_number() over (partition by m order by p) as i from scored group by m, p),
c as (select *, sum(sy) over (partition by m order by i) as cs, sum(n) over (partition by m order by i) as cn from g),
pr as (select a.m, a.i, b.i as j, (b.cs - a.cs + a.sy) * 1.0E0 / (b.cn - a.cn + a.n) as av
       from c a join c b on a.m = b.m and a.i <= b.i),
gk as (select m, i, j as k, min(av) over (partition by m, i order by j desc rows between unbounded preceding and current row) as g
       from pr),
fit as (select m, k, max(g) as fitted from gk group by m, k)
select {B('c.m')} as m, {R('c.p')} as p, {R('fit.fitted')} as fitted from c join fit on c.m = fit.m and c.i = fit.k"""


# --------------------------------------------------------------------------- explanations and cascade

_NB = """
st as (select y, count(*) * 1.0E0 / (select count(*) from lpts) as prior,
              {mv} from lpts group by y),
e as (select 1e-9 * greatest({vp}) as eps from lpts),
s0 as (select * from st where y = 0), s1 as (select * from st where y = 1)""".format(
    mv=", ".join(f"avg({c}) as m_{c}, var_pop({c}) as v_{c}" for c in PTS),
    vp=", ".join(f"var_pop({c})" for c in PTS))


def _term(cls: int, c: str, x: str) -> str:
    v = f"(s{cls}.v_{c} + e.eps)"
    return f"(-0.5 * ln(2.0 * pi() * {v}) - ({x} - s{cls}.m_{c}) * ({x} - s{cls}.m_{c}) / (2.0 * {v}))"


def _nb_prob(xs: dict) -> str:
    l0 = " + ".join(["ln(s0.prior)"] + [_term(0, c, xs[c]) for c in PTS])
    l1 = " + ".join(["ln(s1.prior)"] + [_term(1, c, xs[c]) for c in PTS])
    return f"1.0E0 / (1.0E0 + exp(({l0}) - ({l1})))"


_G = "gt as (select p.vec_id, " + ", ".join(
    f"{_term(1, c, 'p.' + c)} - {_term(0, c, 'p.' + c)} as {c}" for c in PTS) + " from lpts p, e, s0, s1)"
_PHI = f"""
phi as (select vec_id, feature, g - avg(g) over (partition by feature) as phi
        from gt unpivot (g for feature in ({', '.join(PTS)})) u)"""
_RANKED = "rk as (select *, row_number() over (partition by vec_id order by abs(phi) desc, feature) as rank from phi)"

ORACLE["shap_additive"] = _with(POINTS, LPTS, _NB, _G, _PHI) + f"""
select {B('vec_id')} as vec_id, feature, {R('phi')} as phi from phi"""

ORACLE["mean_abs_shap"] = _with(POINTS, LPTS, _NB, _G, _PHI) + f"""
select feature, {R('avg(abs(phi))')} as mean_abs_shap from phi group by feature"""

ORACLE["rank_factors"] = _with(POINTS, LPTS, _NB, _G, _PHI, _RANKED) + f"""
select {B('vec_id')} as vec_id, feature, {R('phi')} as phi, {B('rank')} as rank from rk"""

ORACLE["top_factors"] = _with(POINTS, LPTS, _NB, _G, _PHI) + f"""
select {B('vec_id')} as vec_id, feature, {R('phi')} as phi, {B('rank')} as rank from (
  select *, row_number() over (partition by vec_id order by abs(phi) desc, feature) as rank
  from phi where abs(phi) > 0.001) z where rank <= 4"""

ORACLE["waterfall_table"] = _with(POINTS, LPTS, _NB, _G, _PHI, _RANKED) + f""",
base as (select sum(m) as b from (select avg(g) as m from gt unpivot (g for feature in ({', '.join(PTS)})) u group by feature) z),
f as (select vec_id, case when rank < 10 then rank else 10 end as rank,
             case when rank < 10 then feature else 'other features' end as feature, sum(phi) as phi
      from rk group by all)
select {B('vec_id')} as vec_id, {B('rank')} as rank, feature, {R('phi')} as phi,
       {R('(select b from base) + sum(phi) over (partition by vec_id order by rank rows between unbounded preceding and current row)')} as cumulative
from f"""

_SWAP = {c: f"case when g.j = '{c}' then d.donor else rc.{c} end" for c in PTS}
ORACLE["permutation_importance"] = _with(POINTS, LPTS, _NB) + f""",
grid as (select j, r from (select unnest({PTS}) as j) a, (select unnest(range(10)) as r) b),
rk as (select *, row_number() over (order by {H("'42|base'", 'vec_id')}, vec_id) - 1 as place from lpts),
rc as (select *, place // {PERMUTED} as blk, place % {PERMUTED} + 1 as pos from rk),
d as (select g.j, g.r, l.blk, case {' '.join(f"when g.j = '{c}' then l.{c}" for c in PTS)} end as donor,
             row_number() over (partition by g.j, g.r, l.blk order by {H('42', "g.j || '|' || g.r || '|' || l.vec_id")},
                                g.j || '|' || g.r || '|' || l.vec_id) as pos
      from rc l, grid g),
base as (select avg(cast(({_nb_prob({c: f'p.{c}' for c in PTS})} > 0.5) = (p.y = 1) as double)) as acc
         from lpts p, e, s0, s1),
acc as (select g.j, g.r, avg(cast(({_nb_prob(_SWAP)} > 0.5) = (rc.y = 1) as double)) as acc
        from rc, grid g, e, s0, s1, d where d.j = g.j and d.r = g.r and d.blk = rc.blk and d.pos = rc.pos group by g.j, g.r)
select j as feature, {R('(select acc from base) - avg(acc)')} as importance_mean from acc group by j"""

_NBSCORE = f"nbs as (select p.*, {_nb_prob({c: f'p.{c}' for c in PTS})} as prob from lpts p, e, s0, s1)"
_NBCURVE = """
ng as (select prob as p, sum(y) as pos, count(*) as cnt from nbs group by prob),
nc as (select p as threshold, sum(pos) over (order by p desc rows between unbounded preceding and current row) as tp,
              sum(cnt) over (order by p desc rows between unbounded preceding and current row) as n,
              sum(pos) over () as tt from ng),
opt as (select threshold as t from nc order by round(5*(1 - case when tt = 0 then 1.0E0 else tp*1.0E0/tt end)
                                                   + 1*(1 - tp*1.0E0/n), 12), threshold limit 1)"""
_CASC = f"""
casc as (select nbs.vec_id, (tails.ecod > (select quantile_cont(ecod, 0.95) from tails)) as flagged, nbs.prob
         from nbs join tails on tails.vec_id = nbs.vec_id),
out as (select vec_id, flagged as anomaly_flagged, case when not flagged then prob end as probability,
               case when not flagged then cast(prob >= (select t from opt) as int) end as prediction,
               case when flagged then 'Anomaly - Manual Review' when prob < 0.2 then 'Low Risk'
                    when prob < 0.5 then 'Medium Risk' else 'High Risk' end as risk_level from casc)"""

ORACLE["score_cascade"] = _with(POINTS, LPTS, _NB, _NBSCORE, _NBCURVE, _TAILS, _CASC) + f"""
select {B('vec_id')} as vec_id, anomaly_flagged, {R('probability')} as probability, {B('prediction')} as prediction,
       risk_level from out"""

ORACLE["explain_cascade"] = _with(POINTS, LPTS, _NB, _NBSCORE, _NBCURVE, _TAILS, _CASC, _G, _PHI) + f""",
tf as (select * from (select *, row_number() over (partition by vec_id order by abs(phi) desc, feature) as rank
                      from phi where abs(phi) > 0.001) z where rank <= 4),
txt as (select vec_id, string_agg(printf('%d. %s (%+.2f)', rank, upper(substr(feature, 1, 1)) || substr(feature, 2), phi),
                                  '; ' order by rank) as explanation from tf group by vec_id)
select {B('out.vec_id')} as vec_id, anomaly_flagged, {R('probability')} as probability, {B('prediction')} as prediction,
       risk_level, explanation
from out left join txt on txt.vec_id = out.vec_id where not anomaly_flagged"""


# --------------------------------------------------------------------------- sources

ORACLE["scan_patients_csv"] = _with(HEART_OBS) + f"""
select {B('id')} as id, {', '.join(f'{R(c)} as {c}' for c in HEART_NUM)}, sex, cp, thal, fbs, {B('num')} as num
from heart_obs where num is not null"""


# --------------------------------------------------------------------------- remaining projections, top-k, reshape

_KSPEC = [("age", 18, 63, 1, 0), ("bmi", 160, 300, 10, 30), ("bp_systolic", 90, 110, 1, 25),
          ("bp_diastolic", 50, 60, 1, 25), ("serum_creatinine", 3, 120, 10, 20), ("blood_urea_nitrogen", 5, 60, 1, 20),
          ("calcium", 80, 30, 10, 35), ("phosphorus", 20, 40, 10, 35), ("egfr", 10, 120, 1, 0)]


_CENTS = "cast(round(o_totalprice * 100) as bigint)"


def _kcol(name, off, mod, div, na):
    v = f"cast(({off} + ({H(repr('k' + name), 'o_orderkey')} + {_CENTS}) % {mod}) / {float(div)} as double)"
    return (f"case when {H(repr('na' + name), 'o_orderkey')} % {na} = 0 then null else {v} end" if na else v) + f" as {name}"


KIDNEY_OBS = "kidney_obs as (select o_orderkey as participant_id, " + ", ".join(_kcol(*s) for s in _KSPEC) + \
    f", cast(({H(repr('kckd'), 'o_orderkey')} + {_CENTS}) % 7 = 0 as double) as ckd_present from orders)"

ORACLE["kidney_features"] = _with(KIDNEY_OBS) + f"""
select {B('participant_id')} as participant_id, {R('bp_systolic - bp_diastolic')} as pulse_pressure,
       {R('(bp_systolic + 2 * bp_diastolic) / 3')} as map,
       {R('blood_urea_nitrogen / (serum_creatinine + 1e-5)')} as bun_cr_ratio,
       {R('calcium * phosphorus')} as ca_p_product, {R('bmi * bp_systolic')} as bmi_bp_interaction
from kidney_obs where ckd_present is not null"""

ORACLE["top_importances"] = _with(POINTS, LPTS, _NB, _G, _PHI) + f"""
select feature, {R('avg(abs(phi))')} as mean_abs_shap from phi group by feature
order by avg(abs(phi)) desc, feature limit 10"""

ORACLE["preview_rows"] = _with(OBS) + f"""
select {B('id')} as id, {', '.join(f'{R(c)} as {c}' for c in OBS_NUM)}, o_orderstatus, c_mktsegment, n_name,
       {B('num')} as num from obs order by id limit 5"""

ORACLE["explain_sample"] = _with(POINTS) + f"""
select {B('vec_id')} as vec_id, {', '.join(f'{R(c)} as {c}' for c in PTS)} from points
order by {H('42', 'vec_id')}, vec_id limit 200"""

ORACLE["downsample"] = _with(POINTS) + f"""
select {B('vec_id')} as vec_id from points order by {H('42', 'vec_id')}, vec_id limit 20000"""

_DESC_LONG = f"""
dl as (select feature, count(v) as count, avg(v) as mean, stddev_samp(v) as std, min(v) as min,
              quantile_cont(v, 0.25) as p25, quantile_cont(v, 0.5) as p50, quantile_cont(v, 0.75) as p75, max(v) as max
       from (select * from (select {', '.join(f'cast({c} as double) as {c}' for c in OBS_NUM)} from obs)
             unpivot include nulls (v for feature in ({', '.join(OBS_NUM)}))) u group by feature),
st as (select feature, stat, cast(value as double) as value from (select feature, cast(count as double) as count, mean,
              std, min, p25, p50, p75, max from dl) unpivot (value for stat in (count, mean, std, min, p25, p50, p75, max)))"""

ORACLE["transpose_table"] = _with(OBS, _DESC_LONG) + f"""
select stat, {', '.join(R(f"max(value) filter (where feature = '{c}')") + f' as {c}' for c in OBS_NUM)}
from st group by stat"""

ORACLE["format_metrics"] = f"""
select model, printf('%.4f', accuracy) as accuracy_txt, printf('%.2f%%', recall * 100.0) as recall_pct,
       printf('%+.2f', f1_score - precision) as f1_minus_precision
from ({ORACLE['compare_models']}) z"""


def _initcap(x: str) -> str:
    return (f"array_to_string(list_transform(string_split(lower({x}), ' '), "
            f"lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ')")


ORACLE["feature_names"] = _with(OBS, LAB, SPLIT, _CAT_LONG, _CATS) + f"""
select 'cat__' || column_name || '_' || value as raw_name, column_name || '_' || value as feature,
       {_initcap("replace(column_name || '_' || value, '_', ' ')")} as display_name
from cats"""

ORACLE["bool_to_label"] = _with(HEART_OBS) + f"""
select case when fbs then 'True' else 'False' end as fbs, {B('count(*)')} as n from heart_obs group by all"""


def _knn_impute_sql(src: str, train: str, cols: list, key: str = "id") -> str:
    """CTEs 'imp' (key, f, v) for a brute-force kNN imputation of src from train."""
    return f"""
ql as (select {key} as qid, f from {src} unpivot include nulls (v for f in ({', '.join(cols)})) u where v is null),
tl as (select {key} as tid, f, v from {train} unpivot (v for f in ({', '.join(cols)})) u),
pairs as (select ql.qid, ql.f, tl.v, {_nan_dist(cols)} as dist, t.{key} as rid
          from ql join {src} q on q.{key} = ql.qid join tl on tl.f = ql.f join {train} t on t.{key} = tl.tid),
top as (select qid, f, v from (select *, row_number() over (partition by qid, f order by dist, rid) as rk
                                from pairs where dist is not null) z where rk <= 5),
imp as (select qid, f, avg(v) as v from top group by qid, f)"""


def _imputed(src: str, train: str, cols: list, name: str, key: str = "id") -> str:
    return f"""{name} as (select h.*, {', '.join(
        f"coalesce(h.{c}, (select v from imp where imp.qid = h.{key} and imp.f = '{c}'), (select avg({c}) from {train})) as i_{c}"
        for c in cols)} from {src} h)"""


ORACLE["preprocess_pipeline"] = _with(OBS, LAB, SPLIT, TRAIN) + "," + _knn_impute_sql("sp", "tr", OBS_NUM) + ",\n" + \
    _imputed("sp", "tr", OBS_NUM, "im") + f""",
rs as (select {', '.join(f'quantile_cont(i_{c}, 0.5) as m_{c}, quantile_cont(i_{c}, 0.75) - quantile_cont(i_{c}, 0.25) as q_{c}'
                          for c in OBS_NUM)} from im where split = 'train')
select {B('id')} as id, {', '.join(R(f'(i_{c} - m_{c}) / coalesce(nullif(q_{c}, 0), 1)') + f' as {c}' for c in OBS_NUM)}
from im, rs"""

ORACLE["unsupervised_matrix"] = _with(OBS) + "," + _knn_impute_sql("obs", "obs", OBS_NUM) + ",\n" + \
    _imputed("obs", "obs", OBS_NUM, "im") + f""",
ss as (select {', '.join(f'avg(i_{c}) as m_{c}, stddev_pop(i_{c}) as s_{c}' for c in OBS_NUM)} from im)
select {B('id')} as id, {', '.join(R(f'(i_{c} - m_{c}) / coalesce(nullif(s_{c}, 0), 1)') + f' as {c}' for c in OBS_NUM)}
from im, ss"""

_KASSIGN = f"""
lab_pts as (select s.*, p.label from sp_pts s join points p on p.vec_id = s.vec_id),
ctr as (select label, {', '.join(f'avg({c}) as c_{c}' for c in PTS)} from lab_pts group by label),
ctr_i as (select *, row_number() over (order by label) - 1 as j from ctr),
d as (select l.vec_id, c.j, {' + '.join(f'(l.{c} - c.c_{c})*(l.{c} - c.c_{c})' for c in PTS)} as d2
      from lab_pts l, ctr_i c),
assign as (select vec_id, j as cluster from (
  select *, row_number() over (partition by vec_id order by d2, j) as rk from d) z where rk = 1)"""

ORACLE["kmeans_assign"] = _with(POINTS, SPOINTS, _KASSIGN) + f"""
select {B('vec_id')} as vec_id, {B('cluster')} as cluster from assign"""

ORACLE["cluster_profile"] = _with(POINTS, SPOINTS, _KASSIGN) + f""",
mean as (select a.cluster, {', '.join(f'avg(p.{c}) as {c}' for c in PTS)}
         from points p join assign a on a.vec_id = p.vec_id group by a.cluster)
select {B('cluster')} as cluster, feature, {R('mean')} as mean from mean unpivot (mean for feature in ({', '.join(PTS)})) u"""

_SQ = " + ".join(f"(a.{c} - b.{c})*(a.{c} - b.{c})" for c in PTS)
ORACLE["silhouette_labels"] = _with(POINTS, SPOINTS) + f""",
l as (select s.*, p.label from sp_pts s join points p on p.vec_id = s.vec_id),
n as (select label, count(*) as n from l group by label),
d as (select a.vec_id, a.label as own, b.label as other, sum(sqrt({_SQ})) as e, sum({_SQ}) as q
      from l a, l b group by a.vec_id, a.label, b.label),
s as (select vec_id, max(case when own = other then e / greatest(n - 1, 1) end) as ea,
             min(case when own <> other then e / n end) as eb,
             max(case when own = other then q / greatest(n - 1, 1) end) as qa,
             min(case when own <> other then q / n end) as qb, max(case when own = other then n end) as size
      from d join n on n.label = d.other group by vec_id)
select {R('avg(case when size > 1 and greatest(qa, qb) > 0 then (qb - qa) / greatest(qa, qb) else 0 end)')} as silhouette_sq,
       {R('avg(case when size > 1 and greatest(ea, eb) > 0 then (eb - ea) / greatest(ea, eb) else 0 end)')} as silhouette
from s"""

ORACLE["score_cascade_stream"] = _with(POINTS, LPTS, _NB, _NBSCORE) + f""",
m as (select avg(x1) as m1, avg(x2) as m2, var_pop(x1) as s11, var_pop(x2) as s22, covar_pop(x1, x2) as s12 from lpts),
g as (select vec_id, (s22*(x1-m1)*(x1-m1) - 2*s12*(x1-m1)*(x2-m2) + s11*(x2-m2)*(x2-m2)) / (s11*s22 - s12*s12) as d2
      from lpts, m),
f as (select nbs.vec_id, prob, d2 > (select quantile_cont(d2, 0.95) from g) as flagged from nbs join g on g.vec_id = nbs.vec_id)
select {B('vec_id')} as vec_id, flagged as anomaly_flagged, {R('case when not flagged then prob end')} as probability,
       {B('case when not flagged then cast(prob >= 0.5 as int) end')} as prediction,
       case when flagged then 'Anomaly - Manual Review' when prob < 0.2 then 'Low Risk'
            when prob < 0.5 then 'Medium Risk' else 'High Risk' end as risk_level
from f"""

ORACLE["score_direct"] = _with(POINTS, LPTS, _NB, _NBSCORE) + f"""
select {B('vec_id')} as vec_id, {R('prob')} as probability, {B('prob >= 0.5')} as prediction,
       case when prob < 0.2 then 'Low Risk' when prob < 0.5 then 'Medium Risk' else 'High Risk' end as risk_level
from nbs"""

ORACLE["bootstrap_given_weights"] = _with(SCORED) + f""",
bw as (select m, b, p, y, case when p >= 0.5 then 1 else 0 end as pred,
              count(*) * ({H("concat('boot', any_value(b))", "concat(any_value(m), '|', any_value(pi), '|', any_value(y))")} % 3) as w
       from scored, (select unnest(range(12)) as b) bs group by m, pi, p, y, b),
bg as (select m, b, p, sum(w) as cnt, sum(w * y) as pos, sum(w * y * pred) as hit from bw group by m, b, p),
bc as (select *, sum(cnt) over up as cc, sum(pos) over up as cp from bg
       window up as (partition by m, b order by p desc rows unbounded preceding))
select {B('m')} as m, {B('b')} as b, {R('sum(hit) * 1.0E0 / sum(pos)')} as recall,
       {R('sum((cnt - pos) * (cp - pos / 2.0E0)) / (sum(pos) * 1.0E0 * sum(cnt - pos))')} as roc_auc,
       {R('sum(case when cc > 0 then pos * 1.0E0 * cp / cc else 0 end) / sum(pos)')} as pr_auc
from bc group by m, b having sum(pos) > 0 and sum(cnt - pos) > 0"""

def _grid_ll(cls: int) -> str:
    terms = [f"ln(s{cls}.n * 1.0E0 / (s0.n + s1.n))"]
    for c in PTS:
        var = f"(s{cls}.v_{c} + g.vs * e.top)"
        terms.append(f"(-0.5E0 * ln(2 * pi() * {var}) - (fo.{c} - s{cls}.m_{c}) * (fo.{c} - s{cls}.m_{c}) / (2 * {var}))")
    return " + ".join(terms)


ORACLE["grid_search_naive_bayes"] = _with(POINTS, LPTS) + f""",
fo as (select *, (row_number() over (partition by y order by {H('42', 'vec_id')}, vec_id) - 1) % 5 as fold from lpts),
tr as (select f.held, fo.* from fo, (select unnest(range(5)) as held) f where fo.fold <> f.held),
st as (select held, y, count(*) as n, {", ".join(f"avg({c}) as m_{c}, var_pop({c}) as v_{c}" for c in PTS)} from tr group by held, y),
e as (select held, greatest({", ".join(f"var_pop({c})" for c in PTS)}) as top from tr group by held),
g as (select i as grid_id, power(10.0E0, -9.0E0 * i / 19) as vs from (select unnest(range(20)) as i) z),
sc as (select g.grid_id, fo.fold, cast(({_grid_ll(1)}) > ({_grid_ll(0)}) as double) as hit
       from fo, g, st s0, st s1, e
       where fo.y = 1 and s0.held = fo.fold and s1.held = fo.fold and e.held = fo.fold and s0.y = 0 and s1.y = 1),
rc as (select grid_id, fold, avg(hit) as recall from sc group by grid_id, fold)
select {B('grid_id')} as grid_id, {R('avg(recall)')} as mean_recall from rc group by grid_id"""
