"""Registered queries of the analytics operators, and the SQL that must agree with each."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import kernels, stats
from tidemark.functions import text as X
from tidemark.operators import bagging, detect, distance, evaluate, graph, learn, prep, rca, windows
from tidemark.plans import fixtures as fx
from tidemark.plans import workflow
from tidemark.plans.fixtures import with_tables
from tidemark.session import shared_folder
from tidemark.sources import npy, readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def rounded(df: DataFrame, digits=6) -> DataFrame:
    """Doubles to so many digits (and no negative zero): sums in another order differ in the last ones."""
    return df.select([(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(name: str, sql: str | None = None, *needs: str):
    def register(make):
        QUERIES[name] = lambda spark, sf_dir: rounded(make(spark, sf_dir))
        if sql is not None and name not in ORACLE_SQL:
            text = with_tables(sql, *needs)
            text = text.replace("with ", "with recursive ", 1) if re.search(r"^(walk|sq|solved|run_)\(", text, re.M) else text
            ORACLE_SQL[name] = re.sub(r"\bprecision\b", '"precision"', text)  # a reserved word
        return make

    return register


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def sql_rows(rows: list[tuple], columns: str) -> str:
    lit = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)
    return f"(values {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) v({columns})"


# preparation ---------------------------------------------------------------------------------------------------------

SV = ["t", "var", "value"]
query("series_grid", "select t, var, var_idx, round(value, 6) as value from raw", "raw")(lambda s, d: fx.raw(s, d).select("t", "var", "var_idx", "value"))
query("ffill", "select t, var, round(value, 6) as value from filled", "filled")(lambda s, d: prep.forward_fill(fx.raw(s, d)).select(*SV))
query("drop_incomplete_rows", "select t, var, round(value, 6) as value from raw where t not in (select t from raw where value is null)", "raw")(lambda s, d: prep.drop_incomplete(fx.raw(s, d)).select(*SV))
query("positivity_shift", "select var, round(min(case when m <= 0 then abs(m) + 1e-10 else 1e-10 end) * 1e10, 6) shift_e10 from (select var, min(value) m from (select var, value - 1 as value from series) group by 1) group by 1", "series")(
    lambda s, d: prep.positivity_shift(fx.series(s, d).withColumn("value", F.col("value") - 1)).groupBy("var").agg(F.min(F.col("shift") * 1e10).alias("shift_e10"))
)
query("log_shift", "select t, var, round(value, 6) as value from logged", "logged")(lambda s, d: prep.log_shift(fx.series(s, d)).select(*SV))
query("rolling_median_trend", "select t, var, round(coalesce(median(value) over (partition by var order by t rows between 60 preceding and 1 preceding), value), 6) trend from logged", "logged")(
    lambda s, d: prep.median_trend(prep.log_shift(fx.series(s, d))).select("t", "var", "trend")
)
query("rolling_median_detrend", "select t, var, round(value, 6) + 0.0 as value from detrended", "detrended")(lambda s, d: prep.detrend(prep.log_shift(fx.series(s, d))).select(*SV))
query("constant_guard", "select var, count(value) n, round(stddev_pop(value), 6) std, stddev_pop(value) > 0 usable from (select var, case when var = 'view' then 1.0 else value end as value from series) group by 1", "series")(
    lambda s, d: prep.constant_guard(fx.series(s, d).withColumn("value", F.when(F.col("var") == "view", 1.0).otherwise(F.col("value"))))
)
TESTS = [("a", 0.01, 0.1), ("b", 0.2, 0.1), ("c", 0.01, 0.02), ("d", None, 0.1), ("e", 0.049, 0.051)]
query("stationary_vars", f"select var, round(adf_p, 6) adf_p, round(kpss_p, 6) kpss_p from (select var, cast(adf_p as double) adf_p, cast(kpss_p as double) kpss_p from {sql_rows(TESTS, 'var, adf_p, kpss_p')}) where adf_p < 0.05 and kpss_p > 0.05")(
    lambda s, d: prep.stationary_vars(values(s, TESTS, "var string, adf_p double, kpss_p double"))
)
query("stationary_vars_none", f"select var from {sql_rows(TESTS[1:3], 'var, adf_p, kpss_p')}")(lambda s, d: prep.stationary_vars(values(s, TESTS[1:3], "var string, adf_p double, kpss_p double")).select("var"))
query("zscore", "select t, var, round(value, 6) + 0.0 as value from prepared", "prepared")(lambda s, d: fx.prepared(s, d).select(*SV))
query("ljung_box_p", """
select var, n, round(q, 6) q, round(exp(-q / 2) * (1 + q / 2 + power(q / 2, 2) / 2 + power(q / 2, 3) / 6 + power(q / 2, 4) / 24), 6) p from (
  select var, n, n * (n + 2) * sum(power(c / s, 2) / (n - k)) q from (
    select x.var, k.k, any_value(x.n) n, any_value(x.s) s, sum(x.e * y.e) c
    from (select *, count(*) over (partition by var) n, sum(e * e) over (partition by var) s from c) x cross join (select unnest(range(1, 11)) k) k join c y on y.var = x.var and y.t = x.t - k.k group by 1, 2) group by 1, 2)
""".replace("from c) x", "from cen) x").replace("join c y", "join cen y").replace("\nselect var, n, round(q", "\n, cen as (select t, var, value - avg(value) over (partition by var) e from prepared)\nselect var, n, round(q"), "prepared")(lambda s, d: prep.ljung_box(fx.prepared(s, d)))  # fmt: skip
query("ar1_fit", "select var, round(regr_intercept(value, x), 6) + 0.0 const, round(regr_slope(value, x), 6) phi, count(*) n from (select var, value, lag(value) over (partition by var order by t) x from prepared) where x is not null group by 1", "prepared")(
    lambda s, d: prep.ar1_fit(fx.prepared(s, d))
)
LAGS = [("click", 5), ("view", 10)]


def _variables(s, d):
    return fx.series(s, d).select(F.col("var").alias("variable")).distinct()


query("provided_lags", f"select t.var variable, cast(coalesce(v.k, 1) as int) optimal_lag from types t left join {sql_rows(LAGS, 'variable, k')} on v.variable = t.var", "types")(
    lambda s, d: prep.provided_lags(values(s, LAGS, "variable string, optimal_lag int"), _variables(s, d))
)
query("override_lags", "select var variable, cast(5 as int) optimal_lag from types", "types")(lambda s, d: prep.override_lags(_variables(s, d)))
query("lag_order", "select cast(max(length(var)) as int) p from types", "types")(lambda s, d: prep.lag_order(_variables(s, d).withColumn("optimal_lag", F.length("variable"))))
query("validate_series", """
select var, count(*) n, cast(sum(case when value is null then 1 else 0 end) as bigint) n_missing, cast(sum(case when back then 1 else 0 end) as bigint) n_unordered,
  count(*) > 0 and sum(case when value is null then 1 else 0 end) = 0 and sum(case when back then 1 else 0 end) = 0 valid
from (select *, coalesce(t <= lag(t) over (partition by var order by t // 2 * 2 + (1 - t % 2)), false) back from raw) group by 1""", "raw")(
    lambda s, d: prep.validate_series(fx.raw(s, d).withColumn("pos", F.floor(F.col("t") / 2) * 2 + (1 - F.col("t") % 2))).select("var", "n", "n_missing", "n_unordered", "valid")
)
query("dedupe_renumber", "select row_number() over (partition by var order by k) - 1 t, var, round(value, 6) as value from (select var, t // 2 k, arg_min(value, t) as value from series group by 1, 2)", "series")(
    lambda s, d: prep.dedupe_renumber(fx.series(s, d).withColumn("pos", F.col("t")).withColumn("t", F.floor(F.col("t") / 2))).select(*SV)
)
CUT = "cut as (select t, var, value, cast(sum(case when t - p > 1 then 1 else 0 end) over (partition by var order by t) as int) realisation_id from (select *, lag(t) over (partition by var order by t) p from series where t % 50 <> 7))"


def _cut(s, d):
    return prep.cut_discontinuities(fx.series(s, d).where("t % 50 != 7").select(*SV))


query("discontinuity_cut", f", {CUT} select t, var, realisation_id, round(value, 6) as value from cut", "series")(_cut)
query("lag_embed_cut", f", {CUT} select t, var, realisation_id, round(value, 6) as value, round(lag1, 6) lag1, round(lag2, 6) lag2 from (select *, lag(value, 1) over w lag1, lag(value, 2) over w lag2, row_number() over w n from cut window w as (partition by var, realisation_id order by t)) where n > 2", "series")(
    lambda s, d: prep.lag_embed(_cut(s, d), 2)
)
query("lag_embed_zero_pad", "select t, var, round(value, 6) as value, round(coalesce(lag(value, 1) over w, 0), 6) lag1, round(coalesce(lag(value, 2) over w, 0), 6) lag2 from series window w as (partition by var order by t)", "series")(
    lambda s, d: prep.lag_embed_zero(fx.series(s, d).select(*SV), 2)
)
query("labelled_lags", """
select a.t, round(a.value, 6) click_lag0, round(b.value, 6) view_lag0, round(a1.value, 6) click_lag1, round(b1.value, 6) view_lag1
from series a join series b on b.t = a.t and b.var = 'view' join series a1 on a1.t = a.t - 1 and a1.var = 'click' join series b1 on b1.t = a.t - 1 and b1.var = 'view' where a.var = 'click'""", "series")(
    lambda s, d: prep.labelled_lags(fx.series(s, d), ["click", "view"], 1)
)
query("finite", "select t, var, round(case when value is null or t % 3 = 0 or t % 5 = 0 then 0 else value end, 6) as value from raw", "raw")(
    lambda s, d: prep.finite(fx.raw(s, d).withColumn("value", F.when(F.col("t") % 3 == 0, F.lit(float("nan"))).when(F.col("t") % 5 == 0, F.lit(float("-inf"))).otherwise(F.col("value")))).select(*SV)
)
query("positional_split", "select t, case when k < floor(0.4 * n) then 'train' when k < floor(0.5 * n) then 'val' else 'test' end part from (select t, row_number() over (order by t) - 1 k, count(*) over () n from (select distinct t from series))", "series")(
    lambda s, d: prep.positional_split(fx.series(s, d).select("t").distinct(), [("train", 0.4), ("val", 0.1), ("test", 0.5)])
)
query("contiguous_block", "select t, round(value, 6) as value from series where var = 'click' and t >= 100 and t < 150", "series")(lambda s, d: prep.contiguous_block(fx.series(s, d).where("var = 'click'"), 100, 50).select("t", "value"))
query("k_fold")(lambda s, d: prep.k_fold(fx.series(s, d).select("t").distinct(), 5))
query("subsample")(lambda s, d: prep.subsample(fx.series(s, d).select("t").distinct(), 50))


@query("stationarity_tests")
def _stationarity(s, d):
    import pandas as pd

    def one(key, rows: pd.DataFrame) -> pd.DataFrame:
        a, k = stats.stationarity(rows.sort_values("t").value.to_numpy())
        return pd.DataFrame([(key[0], a, k)], columns=["var", "adf_p", "kpss_p"])

    return fx.prepared(s, d).select("t", "var", "value").groupBy("var").applyInPandas(one, "var string, adf_p double, kpss_p double")


def solve_sql(rows: int, system: str, key: str) -> str:
    """solved(k, key, r, c, v): the augmented matrices (key, r, c, v) of ``system``, all cells there, with one row eliminated at each k; at
    k = rows the columns from ``rows`` on are the solution. No row is exchanged, so pivots must not vanish."""
    return f"""
solved(k, {key}, r, c, v) as (
  select 0, {key}, r, c, v from {system} union all
  select x.k + 1, x.{key}, x.r, x.c, case when x.r = x.k then x.v / p.v else x.v - q.v * s.v / p.v end
  from solved x join solved p on p.{key} = x.{key} and p.r = x.k and p.c = x.k join solved q on q.{key} = x.{key} and q.r = x.r and q.c = x.k
  join solved s on s.{key} = x.{key} and s.r = x.k and s.c = x.c where x.k < {rows})"""


@query("optimal_lags", f"""
, y_ as (select var, t, ln(1 + value + case when min(value) over (partition by var) <= 0 then abs(min(value) over (partition by var)) + 1e-10 else 1e-10 end) y from prepared),
p_ as (select unnest(range(1, 21)) p),
x_ as (select var, t, 0 k, 1.0::double v from y_ union all select var, t, 21, y from y_ union all
  select a.var, a.t, l.p, b.y from y_ a cross join p_ l join y_ b on b.var = a.var and b.t = a.t - l.p),
normal as (
  select a.var || '|' || p id, a.k r, b.k c, sum(a.v * b.v) v from p_ join x_ a on a.t >= p and a.k <= p join x_ b on b.var = a.var and b.t = a.t and (b.k <= p or b.k = 21) group by all
  union all select var || '|' || p, r, c, case when r = c then 1.0 else 0.0 end from types cross join p_ cross join (select unnest(range(21)) r) cross join (select unnest(range(22)) c) where r > p or c > p and c < 21),
{solve_sql(21, 'normal', 'id')},
e_ as (select b.id, x.var, p, x.t, sum(case when x.k = 21 then x.v else -b.v * x.v end) e
  from p_ join x_ x on x.t >= p and (x.k <= p or x.k = 21) join (select id, r, v from solved where k = 21 and c = 21 union all select distinct id, 21, 1.0 from solved where k = 21) b on b.id = x.var || '|' || p and b.r = x.k group by all),
c_ as (select id, var, p, t, e - avg(e) over (partition by id) e, count(*) over (partition by id) n from e_),
s_ as (select id, sum(e * e) s from c_ group by 1),
q_ as (select id, var, p, any_value(n) n, any_value(n) * (any_value(n) + 2) * sum(power(c / s, 2) / (n - k)) q from (
  select a.id, a.var, a.p, l.p k, any_value(a.n) n, sum(a.e * b.e) c from c_ a cross join p_ l join c_ b on b.id = a.id and b.t = a.t - l.p where l.p <= 10 group by a.id, a.var, a.p, l.p) join s_ using (id) group by all),
good as (select var, min(p) p from q_ where n > 11 and exp(-q / 2) * (1 + q / 2 + power(q / 2, 2) / 2 + power(q / 2, 3) / 6 + power(q / 2, 4) / 24) > 0.05 group by 1)
select var variable, cast(coalesce(p, 20) as int) optimal_lag from types left join good using (var)""", "prepared", "types")
def _optimal_lags(s, d):
    import pandas as pd

    def one(key, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], stats.optimal_lag(rows.sort_values("t").value.to_numpy()))], columns=["variable", "optimal_lag"])

    return fx.prepared(s, d).select("t", "var", "value").groupBy("var").applyInPandas(one, "variable string, optimal_lag int")


# windows -------------------------------------------------------------------------------------------------------------

query("sliding_windows", "select window_idx, var_idx, count(*) n, min(t) first_t, max(t) last_t, round(avg(value), 6) + 0.0 mean from windowed group by 1, 2", "windowed")(
    lambda s, d: fx.windowed(s, d).groupBy("window_idx", "var_idx").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.avg("value").alias("mean"))
)


def _ids(s, d):
    return fx.edges(s, d).select("window_idx").distinct()


query("window_meta", "select window_idx, cast(window_idx * 10 as bigint) t_start, cast(window_idx * 10 + 99 as bigint) t_end, cast(window_idx * 10 + 50 as bigint) t_center from w", "w")(lambda s, d: windows.window_meta(_ids(s, d)))
query("window_first_meta", "select window_idx, round(coalesce(arg_min(value, t), window_idx), 6) + 0.0 as value from windowed where var_idx = 0 group by 1", "windowed")(lambda s, d: windows.first_meta(fx.windowed(s, d).where("var_idx = 0"), "value"))
query("window_of_point", "select t, var, cast((t - 5) // 10 as int) window_idx from series where t >= 5", "series")(
    lambda s, d: fx.series(s, d).where("t >= 5").select("t", "var", windows.window_of(F.col("t"), 5).alias("window_idx"))
)
query("window_span", "select cast(max(t) + 2 as bigint) overlap_start, cast(min(t) + 102 as bigint) overlap_end, cast(min(t) + 2 as bigint) union_start, cast(max(t) + 102 as bigint) union_end from (select window_idx * 10 t from w)", "w")(
    lambda s, d: windows.common_span(fx.windowed(s, d).groupBy("window_idx").agg(F.min("t").alias("start")).select("start"), lag=2)
)
query("windows_with_point", "select p.t, w.window_idx from (select unnest([7, 250]) t) p join w on p.t >= w.window_idx * 10 and p.t < w.window_idx * 10 + 100", "w")(
    lambda s, d: windows.windows_with(values(s, [(7,), (250,)], "t int"), _ids(s, d)).select("t", "window_idx")
)
query("windows_not_done", "select window_idx from w where window_idx % 3 <> 0 order by 1 limit 10", "w")(lambda s, d: windows.not_done(_ids(s, d), _ids(s, d).where("window_idx % 3 = 0"), 10))
query("tumbling_chunks", "select cast(window_idx // 20 as int) chunk, count(*) n from w group by 1", "w")(lambda s, d: windows.tumbling(_ids(s, d)).groupBy("chunk").agg(F.count(F.lit(1)).alias("n")))

# learning ------------------------------------------------------------------------------------------------------------

E = "window_idx, i, j, lag, round(weight, 6) + 0.0 weight"
query("corr_edges", f"select {E} from edges", "edges")(fx.edges)
query("edge_threshold", f"select {E} from edges where abs(weight) >= 0.2", "edges")(lambda s, d: learn.threshold(fx.edges(s, d), 0.2))
query("edge_sparse", "select count(*) n from edges where abs(weight) > 1e-8", "edges")(lambda s, d: learn.sparse(fx.edges(s, d)).agg(F.count(F.lit(1)).alias("n")))
query("edge_tabu", f"select {E} from edges where i <> 2 and j <> 3 and not (i = 0 and j = 1 and lag = 0)", "edges")(
    lambda s, d: learn.without_tabu(fx.edges(s, d), values(s, [(0, 1, 0)], "i int, j int, lag int"), [2], [3])
)
query("edge_no_diagonal", "select count(*) n from edges where lag > 0 or i <> j", "edges")(lambda s, d: learn.without_diagonal(fx.edges(s, d)).agg(F.count(F.lit(1)).alias("n")))
query("edges_to_matrix", "select w.window_idx, l.lag, round(sum(coalesce(e.weight, 0) * (r.i * 5 + c.j + 1)), 5) checksum from w cross join (select unnest([0, 1, 2]) lag) l cross join (select unnest(range(5)) i) r cross join (select unnest(range(5)) j) c left join edges e on e.window_idx = w.window_idx and e.lag = l.lag and e.i = r.i and e.j = c.j group by 1, 2", "w", "edges")(
    lambda s, d: learn.edges_to_matrix(fx.edges(s, d), 5).select("window_idx", "lag", F.round(F.aggregate(F.transform(F.flatten("m"), lambda x, k: x * (k + 1)), F.lit(0.0), lambda a, x: a + x), 5).alias("checksum"))
)
query("matrix_to_edges", f"select {E} from edges where weight <> 0", "edges")(lambda s, d: learn.matrix_to_edges(learn.edges_to_matrix(fx.edges(s, d), 5)))


def _names(s, d):
    return fx.series(s, d).select("var_idx", "var").distinct()


NAMED = "named as (select e.window_idx, a.var || '_lag' || e.lag parent_name, b.var || '_lag0' child_name, e.weight from edges e join types a on a.var_idx = e.i join types b on b.var_idx = e.j)"
query("edges_named", f", {NAMED} select window_idx, parent_name, child_name, round(weight, 6) + 0.0 weight from named", "edges", "types")(lambda s, d: learn.named(fx.edges(s, d), _names(s, d)).select("window_idx", "parent_name", "child_name", "weight"))
query("edges_from_names", f"select {E} from edges", "edges")(lambda s, d: learn.from_names(learn.named(fx.edges(s, d), _names(s, d)), _names(s, d)))
query("edge_counts", "select window_idx, count(*) filter (abs(weight) > 0.15 and lag = 0) n_instant, count(*) filter (abs(weight) > 0.15 and lag > 0) n_lagged from edges group by 1", "edges")(lambda s, d: learn.edge_counts(fx.edges(s, d), 0.15))


def _two_means(source: str, least: int) -> str:
    return f"""
, x as (select *, ln(1 + abs(weight)) x, row_number() over (partition by window_idx order by round(abs(weight), 12), i, j, lag) k, count(*) over (partition by window_idx) n from {source}),
s as (select *, sum(x) over (partition by window_idx order by k rows unbounded preceding) s, sum(x) over (partition by window_idx) t, sum(x * x) over (partition by window_idx) q from x),
c as (select window_idx, any_value(n) n, arg_min(k, (round(q - s * s / k - (t - s) * (t - s) / (n - k), 9), k)) cut from s where k < n group by 1),
f as (select *, case when n - cut < {least} and n >= {least} then {least} else n - cut end kept from c)
select s.window_idx, s.i, s.j, s.lag, round(s.weight, 6) + 0.0 weight from s join f using (window_idx) where s.k > s.n - f.kept"""


query("two_means_threshold", _two_means("edges", 10), "edges")(lambda s, d: learn.two_means_threshold(fx.edges(s, d), 10))
query("two_means_least", _two_means("edges", 60), "edges")(lambda s, d: learn.two_means_threshold(fx.edges(s, d), 60))
query("merged_threshold", _two_means("edges", 10), "edges")(lambda s, d: learn.merged([fx.golden(s, d), fx.test(s, d)], 10))
query("weight_histogram", "select cast(least(floor(round((weight - lo) / 0.02, 9)), bins - 1) as int) bin, round(any_value(lo) + cast(least(floor(round((weight - lo) / 0.02, 9)), bins - 1) as int) * 0.02, 6) + 0.0 as \"left\", count(*) n from (select weight, min(weight) over () lo, greatest(1, ceil(round((max(weight) over () - min(weight) over ()) / 0.02, 9))) bins from edges where weight <> 0) group by 1", "edges")(
    lambda s, d: learn.histogram(fx.edges(s, d))
)
query("weight_kde", """
, p as (select min(weight) lo, max(weight) hi, stddev_samp(weight) * power(count(*), -0.2) h, count(*) n from edges where weight <> 0),
g as (select k, lo + (hi - lo) * k / 99 x, h, n from p, unnest(range(0, 100)) u(k))
select cast(g.k as int) k, round(g.x, 6) + 0.0 x, round(sum(exp(-power((g.x - e.weight) / g.h, 2) / 2)) / (any_value(g.n) * any_value(g.h) * sqrt(2 * pi())), 6) density
from g cross join (select weight from edges where weight <> 0) e group by g.k, g.x""", "edges")(lambda s, d: learn.kde(fx.edges(s, d), 100))
GRID = [(0.01, 0.01, 30), (0.01, 0.1, 9), (0.1, 0.01, 6), (0.1, 0.1, 2)]
query("pick_lambdas", "select 0.01::double lambda_w, 0.1::double lambda_a, cast(9 as int) n_edges, 2.25::double as cost")(lambda s, d: learn.pick_lambdas(values(s, GRID, "lambda_w double, lambda_a double, n_edges int"), 5))
query("model_settings", "select * from (values (10, 0.05::double, 0.1::double), (50, 0.01, 0.1), (200, 0.001, 0.1), (600, 0.0001, round(0.1 * sqrt(6.0), 6))) v(d, lr, lam)")(
    lambda s, d: values(s, [(n, learn.learning_rate(n), learn.scaled_lambda(0.1, n)) for n in (10, 50, 200, 600)], "d int, lr double, lam double")
)
query("tucker_compression", "select cast(2889 as int) d, cast(2889 as bigint) * 2889 * 7 * 21 as \"full\"")(lambda s, d: values(s, [(2889, learn.compression(2889, 20, 5, (20, 10, 5))["full"])], "d int, full long"))
query("ridge_var_edges", f"""
, at_ as (select distinct window_idx, t from windowed where t >= window_idx * 10 + 2),
col as (
  select a.window_idx, a.t, (l.lag - 1) * 5 + x.var_idx f, x.value v from at_ a cross join (select unnest([1, 2]) lag) l join windowed x on x.window_idx = a.window_idx and x.t = a.t - l.lag
  union all select a.window_idx, a.t, 10 + x.var_idx, x.value from at_ a join windowed x using (window_idx, t)),
cen as (select window_idx, t, f, v - avg(v) over (partition by window_idx, f) v from col),
normal as (select window_idx, r, c, v + case when r = c then 0.1 else 0 end v from (select a.window_idx, a.f r, b.f c, sum(a.v * b.v) v from cen a join cen b using (window_idx, t) where a.f < 10 group by all)),
{solve_sql(10, 'normal', 'window_idx')}
select window_idx, cast(r % 5 as int) i, cast(c - 10 as int) j, cast(r // 5 + 1 as int) lag, round(v, 6) + 0.0 weight, cast(null as varchar) error from solved where k = 10 and c >= 10 and abs(v) > 0.01""", "windowed")(lambda s, d: learn.fit_windows(fx.windowed(s, d), kernels.ridge_kernel(2)))
query("dynotears_edges")(lambda s, d: learn.fit_windows(fx.windowed(s, d), kernels.dynotears_kernel(1, lambda_w=0.05, lambda_a=0.05, steps=200)))
query("tucker_edges")(lambda s, d: learn.fit_windows(fx.windowed(s, d), kernels.tucker_kernel(1, least=0.0, steps=40)))


@query("lambda_calibration")
def _calibration(s, d):
    import pandas as pd

    pairs = values(s, [(a, b) for a in (0.01, 0.05, 0.1, 0.5) for b in (0.01, 0.05, 0.1, 0.5)], "lambda_w double, lambda_a double")
    sample = fx.prepared(s, d).select("t", "var_idx", "value").crossJoin(F.broadcast(pairs))

    def one(key, rows: pd.DataFrame) -> pd.DataFrame:
        x = rows.pivot(index="t", columns="var_idx", values="value").sort_index().to_numpy()
        return pd.DataFrame(kernels.calibrate(x, 1, [key], steps=100), columns=["lambda_w", "lambda_a", "n_edges"])

    return learn.pick_lambdas(sample.groupBy("lambda_w", "lambda_a").applyInPandas(one, "lambda_w double, lambda_a double, n_edges int"), 5)


# graphs --------------------------------------------------------------------------------------------------------------


def _graph(s, d):
    """Strong lagged edges of all windows as one graph over variable-lag nodes: node = 100 * window + 5 * lag + i for sources."""
    e = fx.edges(s, d).where("abs(weight) > 0.12")
    return e.select((F.col("window_idx") * 100 + F.col("lag") * 5 + F.col("i")).alias("src"), (F.col("window_idx") * 100 + F.col("j")).alias("dst"), F.col("weight"), F.when(F.col("lag") == 0, "learned").otherwise("expert").alias("origin")).where("src != dst")


GRAPH = "graph as (select cast(window_idx * 100 + lag * 5 + i as int) src, cast(window_idx * 100 + j as int) dst, weight, case when lag = 0 then 'learned' else 'expert' end origin from edges where abs(weight) > 0.12 and lag * 5 + i <> j)"
G = "src, dst, round(weight, 6) + 0.0 weight, origin"
query("graph_upsert", f", {GRAPH} select src, dst, round(case when src % 100 = 1 then 2 else weight end, 6) + 0.0 weight, case when src % 100 = 1 then 'expert' else origin end origin from graph", "edges")(
    lambda s, d: graph.upsert_edges(_graph(s, d).withColumn("seq", F.lit(0)), _graph(s, d).where("src % 100 = 1").withColumns({"weight": F.lit(2.0), "origin": F.lit("expert"), "seq": F.lit(1)}))
)
query("graph_with_origin", f", {GRAPH} select {G} from graph where origin = 'expert'", "edges")(lambda s, d: graph.edges_with_origin(_graph(s, d), "expert"))
query("graph_remove_below", f", {GRAPH} select {G} from graph where abs(weight) >= 0.15", "edges")(lambda s, d: graph.remove_below(_graph(s, d), 0.15))
REACH = "both_ as (select src u, dst v from sparse_ union select dst, src from sparse_), reach(u, v) as (select u, u from both_ union select r.u, b.v from reach r join both_ b on b.u = r.v), label as (select u node, min(v) component from reach group by 1)"
SPARSE = "sparse_ as (select * from (select cast(window_idx // 4 * 100 + lag * 10 + i + 5 * (window_idx % 2) as int) src, cast(window_idx // 4 * 100 + j + 5 * (window_idx % 2) as int) dst, max(weight) weight from edges where abs(weight) > 0.2 group by 1, 2) where src <> dst)"


def _sparse_graph(s, d):
    """Strong edges of all windows; each four windows share their nodes, two by two."""
    e = fx.edges(s, d).where("abs(weight) > 0.2")
    of = (F.floor(F.col("window_idx") / 4) * 100 + 5 * (F.col("window_idx") % 2)).cast("int")
    e = e.select((of + F.col("lag") * 10 + F.col("i")).alias("src"), (of + F.col("j")).alias("dst"), "weight")
    return e.groupBy("src", "dst").agg(F.max("weight").alias("weight")).where("src != dst")


query("graph_components")(lambda s, d: graph.reachable_labels(_sparse_graph(s, d)))
query("largest_wcc")(lambda s, d: graph.largest_subgraph(_sparse_graph(s, d)))
query("target_subgraph")(lambda s, d: graph.target_subgraph(_sparse_graph(s, d), _sparse_graph(s, d).agg(F.min("dst")).first()[0]))
_head = "with recursive " + with_tables("", "edges").strip().removeprefix("with ") + f",\n{SPARSE}, {REACH}\n"
ORACLE_SQL["graph_components"] = _head + "select cast(node as int) node, cast(component as int) component from label"
ORACLE_SQL["largest_wcc"] = _head + "select src, dst, round(weight, 6) + 0.0 weight from sparse_ join label on node = src where component = (select component from sparse_ join label on node = src group by 1 order by count(*) desc, component limit 1)"
ORACLE_SQL["target_subgraph"] = _head + "select src, dst, round(weight, 6) + 0.0 weight from sparse_ join label on node = src where component = (select component from label where node = (select min(dst) from sparse_))"
query("markov_blanket", f", {GRAPH}, q as (select unnest([1, 201, 302]) n), mb as (select src node from graph where src in (select n from q) or dst in (select n from q) union select dst from graph where src in (select n from q) or dst in (select n from q) union select g.src from graph g join graph c on c.src in (select n from q) and g.dst = c.dst) select {G} from graph where src in (select node from mb) and dst in (select node from mb)", "edges")(
    lambda s, d: graph.markov_blanket(_graph(s, d), [1, 201, 302])
)
query("dag_edges", """
, e as (select *, row_number() over (partition by window_idx order by abs(weight) desc, i desc, j desc) k from (select window_idx, i, j, lag, round(weight, 9) weight from edges where lag = 1 and i <> j)),
walk(window_idx, u, v, k, n) as (
  select window_idx, i, j, k, 1 from e union
  select w.window_idx, w.u, e.j, greatest(w.k, e.k), n + 1 from walk w join e on e.window_idx = w.window_idx and e.i = w.v where n < 5),
cycle as (select window_idx, min(k) first from walk where u = v group by 1)
select e.window_idx, i, j, lag, round(weight, 6) + 0.0 weight from e left join cycle using (window_idx) where first is null or k < first""", "edges")(
    lambda s, d: graph.to_dag(fx.edges(s, d).where("lag = 1 and i <> j").withColumn("weight", F.round("weight", 9)))
)
query("graph_recovery", """
, p as (select window_idx * 10 + i i, j from edges where lag = 0 and abs(weight) > 0.1), t as (select window_idx * 10 + i i, j from edges where lag = 1 and weight > 0),
c as (select count(*) filter (p.i is not null and t.i is not null) tp, count(*) filter (t.i is null) fp, count(*) filter (p.i is null) fn from p full join t on p.i = t.i and p.j = t.j)
select tp, fp, fn, fp + fn shd, round(case when tp + fp > 0 then tp / (tp + fp) else 0 end, 6) precision, round(case when tp + fn > 0 then tp / (tp + fn) else 0 end, 6) recall, round(case when tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end, 6) f1 from c""", "edges")(
    lambda s, d: graph.recovery(*[fx.edges(s, d).where(f"lag = {k}").select((F.col("window_idx") * 10 + F.col("i")).alias("src"), F.col("j").alias("dst"), "weight") for k in (0, 1)], eps=0.1)
)
query("causal_paths", """
, e as (select i s, j t, abs(avg(weight)) w from edges where lag = 0 and i <> j group by all), p1 as (select [s, t] path, w score, s head from e where t = 2),
p2 as (select list_prepend(e.s, p1.path) path, score + w score, e.s head from p1 join e on e.t = p1.head where not list_contains(path, e.s)),
p3 as (select list_prepend(e.s, p2.path) path, score + w score, e.s head from p2 join e on e.t = p2.head where not list_contains(path, e.s))
select path, round(score, 6) score, cast(rank as int) rank from (select path, score, row_number() over (order by round(score, 9) desc, path) rank from (select array_to_string(path, '>') path, score from (select * from p1 union all select * from p2 union all select * from p3))) where rank <= 5""", "edges")(
    lambda s, d: graph.causal_paths(fx.edges(s, d).where("lag = 0").groupBy(F.col("i").alias("src"), F.col("j").alias("dst")).agg(F.avg("weight").alias("weight")), 2)
)

# ensembles -----------------------------------------------------------------------------------------------------------


def _voters(s, d):
    return fx.runs(s, d).where("abs(weight) > 0.08")


VOTERS = "voters as (select * from runs where abs(weight) > 0.08)"
query("bag_mean_zero", f", {VOTERS} select window_idx, i, j, lag, round(sum(weight) / 5, 6) + 0.0 weight from voters group by all", "runs")(lambda s, d: bagging.mean_absent_zero(_voters(s, d), 5))
query("bag_mean_present", f", {VOTERS} select window_idx, i, j, lag, round(avg(weight), 6) + 0.0 weight from voters group by all", "runs")(lambda s, d: bagging.mean_present(_voters(s, d)))
query("bag_vote", f", {VOTERS} select window_idx, i, j, lag, round(avg(weight), 6) + 0.0 weight from voters group by all having count(*) >= 5 * 0.6", "runs")(lambda s, d: bagging.vote(_voters(s, d), 5, 0.6))
query("bag_vote_eps", "select window_idx, i, j, lag, round(avg(weight), 6) + 0.0 weight from runs group by all having count(*) filter (abs(weight) > 0.1) >= 5 * 0.6", "runs")(lambda s, d: bagging.vote(fx.runs(s, d), 5, 0.6, 0.1))
query("bag_support", "select window_idx, i, j, lag, round(count(*) filter (abs(weight) > 0.1) / 5, 6) as support from runs group by all", "runs")(lambda s, d: bagging.support(fx.runs(s, d), 5, 0.1))
query("causal_stability", """
, c as (select run_id, i, j, sum(abs(weight)) w from runs group by all), g as (select run_id, i, j from (select distinct run_id from runs) cross join (select unnest(range(5)) i) cross join (select unnest(range(5)) j)),
v as (select g.i, g.j, var_pop(coalesce(c.w, 0)) v from g left join c on c.run_id = g.run_id and c.i = g.i and c.j = g.j group by all)
select round(exp(-avg(v)), 6) stability, cast(5 as bigint) n_runs from v""", "runs")(lambda s, d: bagging.stability(fx.runs(s, d), 5))
query("bagging_runs", "select cast(r.run_id as int) run_id, window_idx from w cross join (select unnest(range(0, 3)) run_id) r", "w")(lambda s, d: bagging.runs_of(_ids(s, d), 3).drop("seed"))

# distances -----------------------------------------------------------------------------------------------------------


def _lag0(s, d):
    return fx.edges(s, d).where("lag = 0")


def _pairs(s, d):
    ids = _ids(s, d)
    return ids.select(F.col("window_idx").alias("a"), (F.col("window_idx") - 1).alias("b")).where("b >= 0")


def _cells(s, d):
    return distance.pair_cells(_pairs(s, d), _lag0(s, d).where("abs(weight) > 0.05"), _lag0(s, d).where("abs(weight) > 0.05"))


CELLS = "cells as (select * from (select window_idx a, window_idx - 1 b, i, j, case when abs(x) > 0.05 then x else 0 end x, case when abs(y) > 0.05 then y else 0 end y from prev) where x <> 0 or y <> 0)"
query("dimension", "select cast(greatest(max(i), max(j)) + 1 as int) d from edges where lag = 0", "edges")(lambda s, d: distance.dimension(fx.edges(s, d), 0))
query("matrix_slice", "select window_idx, i, j, round(arg_max(weight, lag), 6) + 0.0 weight from (select * from edges union all select window_idx, i, j, cast(0 as int) lag, weight from edges where false) where lag = 1 and i < 4 and j < 4 group by all", "edges")(
    lambda s, d: distance.matrix_slice(fx.edges(s, d).withColumn("seq", F.col("lag")), 1, 4, "seq")
)
query("frobenius", f", {CELLS} select a, b, round(sqrt(sum(power(x - y, 2))), 6) distance from cells group by all", "prev")(lambda s, d: distance.distance(_cells(s, d), "frobenius"))
query("weighted_edge", f", {CELLS} select a, b, round(sqrt(sum(power(x - y, 2))), 6) distance from cells where abs(x) > 0.1 or abs(y) > 0.1 group by all", "prev")(lambda s, d: distance.weighted_edges(_cells(s, d), 0.1))
def spectral_sql(cells: str) -> str:
    """norms(a, b, distance): greatest singular values of x - y. M = D'D is divided by its trace and squared, again and again; what was
    divided by adds up, halved at each step, to the logarithm of its greatest eigenvalue."""
    return f"""
m0 as (select p.a, p.b, p.j r, q.j c, sum((p.x - p.y) * (q.x - q.y)) v from {cells} p join {cells} q on q.a = p.a and q.b = p.b and q.i = p.i group by all),
sq(k, a, b, r, c, v, t, log_) as (
  select 0, a, b, r, c, v, sum(case when r = c then v else 0 end) over (partition by a, b), 0.0::double from m0
  union all
  select k + 1, a, b, r, c, v, sum(case when r = c then v else 0 end) over (partition by a, b), log_ from (
    select x.k, x.a, x.b, x.r, y.c, sum(x.v / x.t * y.v / x.t) v, any_value(x.log_ + ln(x.t) / power(2, x.k)) log_
    from sq x join sq y on y.a = x.a and y.b = x.b and y.r = x.c where x.k < 30 and x.t > 0 group by x.k, x.a, x.b, x.r, y.c)),
norms as (select a, b, coalesce(exp(max(log_) filter (k = 30) / 2), 0) distance from sq group by 1, 2)"""


query("spectral", f", {CELLS}, {spectral_sql('cells')} select a, b, round(distance, 6) distance from norms", "prev")(lambda s, d: distance.distance(_cells(s, d), "spectral"))
query("structural_hamming", f", {CELLS} select a, b, count(*) filter ((abs(x) > 0.1) <> (abs(y) > 0.1)) shd, round(max(abs(x - y)), 6) max_edge_change from cells group by all", "prev")(lambda s, d: distance.structural_hamming(_cells(s, d), 0.1))
query("nn_abs_score", """
, d as (select t.window_idx, g.window_idx nearest, sqrt(sum(power(t.weight - g.weight, 2))) dist from (select * from test where lag = 0) t join (select * from golden where lag = 0 and window_idx % 10 = 0) g on g.i = t.i and g.j = t.j group by all)
select window_idx, cast(arg_min(nearest, (round(dist, 9), nearest)) as int) nearest, round(min(dist), 6) abs_score from d group by 1""", "test", "golden")(
    lambda s, d: distance.nearest_golden(fx.test(s, d).where("lag = 0").select("window_idx", "i", "j", "weight"), fx.golden(s, d).where("lag = 0").select("window_idx", "i", "j", "weight"))
)
query("golden_sampled_mean", """
, ids as (select distinct cast(floor(k * (n - 1) / 6.0) as int) window_idx from (select unnest(range(7)) k) cross join (select count(distinct window_idx) n from golden))
select i, j, lag, round(sum(weight) / 7, 6) + 0.0 weight from golden join ids using (window_idx) group by all""", "golden")(lambda s, d: distance.golden_sampled_mean(fx.golden(s, d), 7))
query("golden_sampled_zero_fill", """
, ids as (select distinct cast(floor(k * 29 / 9.0) as int) window_idx from (select unnest(range(10)) k))
select i, j, lag, round(sum(weight) / 10, 6) + 0.0 weight from golden join ids using (window_idx) group by all""", "golden")(lambda s, d: distance.golden_sampled_mean(fx.golden(s, d), 10, zero_fill_ids=30))
query("golden_mean", "select i, j, round(weight, 6) + 0.0 weight from gmean", "gmean")(lambda s, d: distance.golden_mean(fx.golden(s, d)))
query("baseline_abs_score", "select window_idx, round(abs_score, 6) abs_score from base_score", "base_score")(lambda s, d: distance.to_baseline(fx.edges(s, d), distance.golden_mean(fx.golden(s, d))))
query("change_score", "select window_idx, round(change_score, 6) change_score from chg", "chg")(lambda s, d: distance.change_scores(_lag0(s, d)))
query("change_score_by_id", """
, o as (select * from e0 where window_idx % 4 <> 2), ids as (select distinct window_idx from o), ce as (select distinct i, j from e0)
select ids.window_idx, round(case when ids.window_idx = 0 then 0 else sqrt(sum(power(coalesce(e.weight, 0) - coalesce(p.weight, 0), 2))) end, 6) change_score
from ids cross join ce c left join o e on e.window_idx = ids.window_idx and e.i = c.i and e.j = c.j left join o p on p.window_idx = ids.window_idx - 1 and p.i = c.i and p.j = c.j group by 1""", "e0")(
    lambda s, d: distance.change_scores(_lag0(s, d).where("window_idx % 4 != 2"), observed=False)
)
query("abs_trend", "select window_idx, round(abs_score, 6) abs_score, round(change_score, 6) change_score, round(abs_trend, 6) + 0.0 abs_trend from scores", "scores")(fx.scores)
query("top_dims", "select window_idx, top_dims from \"top\"", "top")(fx.top)


def _shifted(s, d):
    """Golden windows beside test windows of the same id, as two runs of the same windows have."""
    g = fx.golden(s, d).withColumn("window_idx", F.col("window_idx") + fx.GOLDEN)
    return fx.test(s, d), g


SHIFT = "g as (select window_idx + 20 window_idx, lag, i, j, weight from golden), jd as (select t.window_idx, t.lag, t.i, t.j, t.weight, g.weight golden, abs(t.weight - g.weight) diff from test t join g using (window_idx, lag, i, j)), st as (select window_idx, avg(diff) mean_diff, max(diff) max_diff, stddev_samp(diff) std_diff, count(*) n_edges, count(*) filter (diff > 0.1) n_large from jd group by 1)"
query("edge_diff_stats", f", {SHIFT} select window_idx, round(mean_diff, 6) mean_diff, round(max_diff, 6) max_diff, round(std_diff, 6) std_diff, n_edges, n_large from st", "golden", "test")(lambda s, d: distance.edge_difference_stats(*_shifted(s, d)))
query("pairwise_summary", f"""
, pc as (select t.window_idx a, t.window_idx b, t.i, t.j, t.weight x, coalesce(g.weight, 0) y from (select * from test where lag = 0) t left join (select window_idx + 20 window_idx, i, j, weight from golden where lag = 0) g using (window_idx, i, j)
  union all select g.window_idx, g.window_idx, g.i, g.j, 0, g.weight from (select window_idx + 20 window_idx, i, j, weight from golden where lag = 0) g where exists (select 1 from test t where t.lag = 0 and t.window_idx = g.window_idx)
    and not exists (select 1 from test t where t.lag = 0 and t.window_idx = g.window_idx and t.i = g.i and t.j = g.j)),
{spectral_sql('pc')},
f as (select a, b, sqrt(sum(power(x - y, 2))) frobenius, count(*) filter ((abs(x) > 0.01) <> (abs(y) > 0.01)) structural_hamming, max(abs(x - y)) max_edge_change from pc group by 1, 2)
select a window_idx, round(frobenius, 6) frobenius, structural_hamming, round(distance, 6) spectral, round(max_edge_change, 6) max_edge_change, round((frobenius + distance + max_edge_change) / 3, 6) ensemble_score
from f join norms using (a, b)""", "test", "golden")(lambda s, d: workflow.pairwise(_shifted(s, d)[1], _shifted(s, d)[0]))
query("top_windows", f", {SHIFT} select window_idx, round(mean_diff, 6) mean_diff from st order by st.mean_diff desc, window_idx limit 5", "golden", "test")(lambda s, d: distance.top_windows(distance.edge_difference_stats(*_shifted(s, d)), 5).select("window_idx", "mean_diff"))
query("top_edges", f", {SHIFT} select window_idx, i, j, lag, round(diff, 6) diff, cast(rank as int) rank, round(weight / (abs(golden) + 1e-10), 3) + 0.0 ratio from (select *, row_number() over (partition by window_idx order by round(diff, 9) desc, lag, i, j) rank from jd) where rank <= 5", "golden", "test")(
    lambda s, d: distance.top_edges(*_shifted(s, d)).select("window_idx", "i", "j", "lag", "diff", "rank", F.round("ratio", 3).alias("ratio"))
)
query("spike_ratio", f", {SHIFT} select round(spike, 6) spike, round(other, 6) other, round(spike / other, 6) ratio, case when spike / other > 2 then 'strong' when spike / other > 1.5 then 'moderate' else 'weak' end band from (select avg(mean_diff) filter (window_idx in (21, 25, 30)) spike, avg(mean_diff) filter (window_idx not in (21, 25, 30)) other from st)", "golden", "test")(
    lambda s, d: distance.spike_ratio(distance.edge_difference_stats(*_shifted(s, d)), values(s, [(21,), (25,), (30,)], "window_idx int"))
)
query("normalised_score", "select window_idx, round(abs_score / (select sqrt(sum(weight * weight)) from gmean), 6) score from base_score", "base_score")(lambda s, d: distance.normalised_score(fx.edges(s, d), distance.golden_mean(fx.golden(s, d))))
query("mad_threshold", """
, l as (select window_idx, abs_score score, median(abs_score) over w m, list(abs_score) over w xs from scores window w as (order by window_idx rows between 50 preceding and 1 preceding))
select window_idx, round(score, 6) score, round(m + 2 * list_median(list_transform(xs, lambda x: abs(x - m))), 6) threshold from l""".replace("list_median(", "list_aggregate(").replace("abs(x - m)))", "abs(x - m)), 'median')"), "scores")(
    lambda s, d: distance.mad_threshold(fx.scores(s, d).select("window_idx", F.col("abs_score").alias("score")))
)

# detection -----------------------------------------------------------------------------------------------------------

STATIC = (0.5, 0.6, 0.05)


def _states(s, d):
    return detect.fixed_states(fx.scores(s, d), STATIC).select("window_idx", "abs_score", "change_score", "abs_trend", "status")


query("fixed_states", "select window_idx, status from states", "states")(lambda s, d: _states(s, d).select("window_idx", "status"))
query("golden_thresholds", "select round(t, 6) threshold_normal, round(1.5 * t, 6) threshold_change, round(0.5 * t, 6) threshold_trend from (select greatest(avg(abs_score) + 3 * stddev_pop(abs_score), 0.001) t from scores where window_idx < 20)", "scores")(
    lambda s, d: detect.golden_thresholds(fx.scores(s, d).where("window_idx < 20"))
)
query("static_states", """
, th as (select greatest(avg(abs_score) + 1 * stddev_pop(abs_score), 0.001) t from scores where window_idx < 20)
select window_idx, case when abs_score < t then 'NORMAL' when change_score > 1.5 * t and abs_trend > 0.5 * t then 'NEW_ANOMALY_ONSET' when change_score > 1.5 * t and abs_trend < -0.5 * t then 'RECOVERY_FLUCTUATION' when abs_score > t then 'CASCADE_OR_PERSISTENT' else 'NORMAL' end status
from scores cross join th""", "scores")(lambda s, d: detect.static_states(fx.scores(s, d), detect.golden_thresholds(fx.scores(s, d).where("window_idx < 20"), 1.0)).select("window_idx", "status"))


def _small(s, d):
    """Scores brought down so that the fixed thresholds of the beginning let a history build up, and every state occurs."""
    k = F.col("window_idx")
    calm = F.when(k % 9 < 6, 0.04).otherwise(0.5)
    return fx.scores(s, d).select("window_idx", F.round(F.col("abs_score") * calm, 9).alias("abs_score"), F.round(F.col("change_score") * calm, 9).alias("change_score"), F.round(F.when(k % 9 == 6, 0.2).when(k % 9 == 8, -0.2).otherwise(F.col("abs_trend") * 0.04), 9).alias("abs_trend"))


ORACLE_SQL["adaptive_states"] = "with recursive " + with_tables("", "scores").strip().removeprefix("with ") + """,
sm as (select window_idx, row_number() over (order by window_idx) k, round(abs_score * f, 9) a, round(change_score * f, 9) c, round(case when window_idx % 9 = 6 then 0.2 when window_idx % 9 = 8 then -0.2 else abs_trend * 0.04 end, 9) t
  from (select *, case when window_idx % 9 < 6 then 0.04 else 0.5 end f from scores)),
fold(k, window_idx, status, ha, hc, tn, tc, tt) as (
  select cast(0 as bigint), cast(-1 as int), '', cast([] as double[]), cast([] as double[]), 0.0::double, 0.0::double, 0.0::double
  union all
  select k, window_idx, case when a < tn then 'NORMAL' when c > tc and t > tt then 'NEW_ANOMALY_ONSET' when c > tc and t < -tt then 'RECOVERY_FLUCTUATION' else 'CASCADE_OR_PERSISTENT' end,
    case when a < tn then list_append(ha, a)[greatest(1, len(ha) - 98):] else ha end, case when a < tn then list_append(hc, c)[greatest(1, len(hc) - 98):] else hc end, tn, tc, tt
  from (
    select s.k, s.window_idx, cast(s.a as double) a, cast(s.c as double) c, cast(s.t as double) t, f.ha, f.hc,
      case when len(f.ha) >= 5 then list_avg(f.ha) + 3 * list_stddev_pop(f.ha) else 0.05 end tn,
      case when len(f.ha) >= 5 then list_avg(f.hc) + 3 * list_stddev_pop(f.hc) else 0.15 end tc,
      case when len(f.ha) >= 5 then 0.2 * (list_avg(f.ha) + 3 * list_stddev_pop(f.ha)) else 0.1 end tt
    from fold f join sm s on s.k = f.k + 1))
select window_idx, status, round(tn, 6) threshold_normal, round(tc, 6) threshold_change, round(tt, 6) threshold_trend from fold where k > 0"""
query("adaptive_states")(lambda s, d: detect.adaptive_states(_small(s, d)).select("window_idx", "status", "threshold_normal", "threshold_change", "threshold_trend"))
query("status_summary", "select status, count(*) n, round(100.0 * count(*) / sum(count(*)) over (), 6) pct from states group by 1", "states")(lambda s, d: detect.status_histogram(_states(s, d)))
query("anomaly_span", "select count(*) n, min(window_idx) as \"first\", max(window_idx) as \"last\" from states where status <> 'NORMAL'", "states")(lambda s, d: detect.anomaly_span(_states(s, d)))
query("vote_k_of_metrics", """
, l as (select avg(abs_score) + 0.5 * stddev_pop(abs_score) a, avg(change_score) + 0.5 * stddev_pop(change_score) c, avg(abs_trend) + 0.5 * stddev_pop(abs_trend) t from scores where window_idx < 20)
select window_idx, cast((abs_score > a)::int + (change_score > c)::int + (abs_trend > t)::int as int) votes, (abs_score > a)::int + (change_score > c)::int + (abs_trend > t)::int >= 2 is_anomaly from scores cross join l""", "scores")(
    lambda s, d: detect.vote_of_metrics(fx.scores(s, d), ["abs_score", "change_score", "abs_trend"], fx.scores(s, d).where("window_idx < 20"), 2, 0.5).select("window_idx", "votes", "is_anomaly")
)
query("label_taxonomy", "select event_id, case when event_type = 'error' then 'spike' when event_type = 'view' then 'drift,level_shift,trend_change,amplitude_change' else '' end types from events")(
    lambda s, d: detect.type_of_class(fx.events(s, d).select("event_id", F.when(F.col("event_type") == "error", "point").when(F.col("event_type") == "view", "contextual").otherwise("other").alias("class"))).select("event_id", F.array_join("types", ",").alias("types"))
)

# root causes ---------------------------------------------------------------------------------------------------------

query("rca_top_anomalies", "select window_idx, status, round(abs_score, 6) abs_score from states where status <> 'NORMAL' order by states.abs_score desc, window_idx limit 5", "states")(lambda s, d: rca.top_anomalies(_states(s, d)).select("window_idx", "status", "abs_score"))
query("rca_root_effect", """
, k as (select window_idx from w where window_idx >= 20), ce as (select distinct i, j from (select i, j from e0 union all select i, j from gmean)),
dl as (select k.window_idx, c.i, c.j, coalesce(e.weight, 0) - coalesce(g.weight, 0) delta from k cross join ce c left join e0 e on e.window_idx = k.window_idx and e.i = c.i and e.j = c.j left join gmean g on g.i = c.i and g.j = c.j),
o as (select window_idx, i, round(sum(round(abs(delta), 12)), 9) s from dl group by all), n as (select window_idx, j, round(sum(round(abs(delta), 12)), 9) s from dl group by all)
select a.window_idx, a.root, b.effect, c.edge, c.edge_change from (select window_idx, arg_min(i, (-s, i)) root from o group by 1) a join (select window_idx, arg_min(j, (-s, j)) effect from n group by 1) b using (window_idx)
join (select window_idx, arg_min(i || '->' || j, (-round(abs(delta), 9), i, j)) edge, round(arg_min(delta, (-round(abs(delta), 9), i, j)), 6) + 0.0 edge_change from dl group by 1) c using (window_idx)""", "e0", "gmean", "w")(
    lambda s, d: rca.root_effect(fx.edges(s, d), distance.golden_mean(fx.golden(s, d)), _ids(s, d).where("window_idx >= 20"))
)


def _ranking(s, d):
    return rca.strength_ranking(fx.test(s, d), fx.golden(s, d), fx.test(s, d), 6, per_window=True)


RANK = """
gi as (select j node, sum(weight) / 20 s from golden group by 1), go as (select i node, sum(weight) / 20 s from golden group by 1), ti as (select window_idx, j node, sum(weight) s from test group by 1, 2), tz as (select window_idx, i node, sum(weight) s from test group by 1, 2),
sc as (select w.window_idx, cast(n.node as int) node, abs(coalesce(ti.s, 0) - coalesce(gi.s, 0)) + abs(coalesce(tz.s, 0) - coalesce(go.s, 0)) score
  from (select distinct window_idx from test) w cross join (select unnest(range(6)) node) n left join ti on ti.window_idx = w.window_idx and ti.node = n.node left join tz on tz.window_idx = w.window_idx and tz.node = n.node left join gi on gi.node = n.node left join go on go.node = n.node),
rk as (select *, cast(row_number() over (partition by window_idx order by round(score, 9) desc, node) as int) rank from sc)"""
query("rca_strength_rank", f", {RANK} select window_idx, node, round(score, 6) score, rank from rk", "golden", "test")(_ranking)
query("rca_recall_at_k", f""", {RANK},
cu as (select cast(floor(start / 10) as int) window_idx, unnest(dims) - 1 node from labelled), rr as (select coalesce(rk.rank, 999) rank from cu left join rk on rk.window_idx = cu.window_idx and rk.node = cu.node where cu.window_idx in (select window_idx from test))
select count(*) n, round(avg((rank <= 1)::int), 6) recall_at_1, round(avg((rank <= 3)::int), 6) recall_at_3, round(avg((rank <= 5)::int), 6) recall_at_5, round(avg(rank), 6) mean_rank from rr""", "golden", "test", "labelled")(
    lambda s, d: rca.recall_at(_ranking(s, d), fx.labelled(s, d))
)


def _roots(s, d):
    return fx.top(s, d).select("window_idx", F.get(F.split("top_dims", ","), 0).cast("int").alias("root"))


query("rca_top1_accuracy", """
, p as (select window_idx, cast(split_part(top_dims, ',', 1) as int) root from "top"), h as (select p.window_idx, max(list_contains(n.dims, p.root + 1)::int) hit from p join near n using (window_idx) group by 1)
select count(*) n, cast(sum(hit) as bigint) correct, round(avg(hit), 6) accuracy from h""", "top", "near")(lambda s, d: rca.top1_accuracy(_roots(s, d), fx.labelled(s, d)))
query("rca_macro_accuracy", """
, e as (select cast(window_idx % 7 as varchar) entity, count(*) n, count(*) filter (status <> 'NORMAL') correct from states group by 1)
select round(sum(correct) / sum(n), 6) global_accuracy, round(avg(correct / n), 6) macro_accuracy from e""", "states")(
    lambda s, d: rca.macro_accuracy(_states(s, d).groupBy((F.col("window_idx") % 7).cast("string").alias("entity")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") != detect.NORMAL).alias("correct")))
)
query("counterfactual", f"""
, five as (select unnest(range(5)) k),
sys as (select 0 one, r.k r, c.k c, case when r.k = c.k then 1 else 0 end - coalesce(0.1 * g.weight, 0) v from five r cross join five c left join gmean g on g.i = r.k and g.j = c.k
  union all select 0, r.k, c.k + 5, case when r.k = c.k then 1.0 else 0.0 end from five r cross join five c),
{solve_sql(5, 'sys', 'one')},
step as (select w.window_idx, l.lag, i.k i, s.c - 5 j, sum(coalesce(0.1 * e.weight, 0) * s.v) v
  from w cross join (select unnest([1, 2]) lag) l cross join five i join solved s on s.k = 5 and s.c >= 5 left join edges e on e.window_idx = w.window_idx and e.lag = l.lag and e.i = i.k and e.j = s.r group by all),
steps as (select window_idx, list(m order by j) filter (lag = 1) m1, list(m order by j) filter (lag = 2) m2 from (select window_idx, lag, j, list(v order by i) m from step group by all) group by 1),
given as (select window_idx, t - window_idx * 10 n, list(value order by var_idx) x from windowed group by all),
run_(window_idx, n, x, y) as (
  select a.window_idx, 1::bigint, a.x, b.x from given a join given b using (window_idx) where a.n = 1 and b.n = 0 union all
  select r.window_idx, n + 1, [list_dot_product(x, m1[j]) + list_dot_product(y, m2[j]) for j in [1, 2, 3, 4, 5]], x from run_ r join steps using (window_idx) where n < 99),
every_ as (select window_idx, n, x from run_ union all select window_idx, n, x from given where n = 0)
select window_idx, window_idx * 10 + n t, cast(k as int) var_idx, round(x[k + 1], 6) + 0.0 as value from every_ cross join five""", "windowed", "edges", "gmean")(lambda s, d: rca.counterfactual(fx.windowed(s, d), fx.edges(s, d).withColumn("weight", F.col("weight") * 0.1), distance.golden_mean(fx.golden(s, d)).withColumn("weight", F.col("weight") * 0.1), 5))

# evaluation ----------------------------------------------------------------------------------------------------------


def _window_labels(s, d):
    return evaluate.window_labels(fx.points(s, d).select("t", "label"))


def _scored_labels(s, d):
    return _window_labels(s, d).join(fx.scores(s, d), "window_idx").select("window_idx", F.round("abs_score", 2).alias("score"), "label")


SL = "sl as (select wl.window_idx, round(abs_score, 2) score, label from wl join scores using (window_idx))"
PRF = "round(case when tp + fp > 0 then tp / (tp + fp) else 0 end, 6) precision, round(case when tp + fn > 0 then tp / (tp + fn) else 0 end, 6) recall, round(case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end, 6) f1"
query("label_windows", "select window_idx, label from wl", "wl")(_window_labels)
query("segments", "select a as start, b as \"end\" from segs", "segs")(lambda s, d: evaluate.segments(fx.points(s, d)))
query("dense_scores", "select cast(k as int) window_idx, round(coalesce(s.abs_score, 0), 6) abs_score from unnest(range(0, 70)) u(k) left join (select * from scores where window_idx % 5 <> 1) s on s.window_idx = k", "scores")(lambda s, d: evaluate.dense_scores(fx.scores(s, d).where("window_idx % 5 != 1"), 70))
query("prf_window", f"select *, {PRF} from (select count(*) filter (p and l) tp, count(*) filter (p and not l) fp, count(*) filter (not p and l) fn, count(*) filter (not p and not l) tn from (select status in ('NEW_ANOMALY_ONSET', 'CASCADE_OR_PERSISTENT') p, label = 1 l from wl join states using (window_idx)))", "wl", "states")(
    lambda s, d: evaluate.window_prf(_states(s, d), _window_labels(s, d))
)
query("window_confusion", "select *, round((tp + tn) / (tp + fp + fn + tn), 6) accuracy from (select count(*) filter (p and l) tp, count(*) filter (p and not l) fp, count(*) filter (not p and l) fn, count(*) filter (not p and not l) tn from (select status <> 'NORMAL' p, label = 1 l from wl join states using (window_idx)))", "wl", "states")(
    lambda s, d: evaluate.window_confusion(_states(s, d), _window_labels(s, d))
)
CURVE = f"{SL}, g as (select score, sum(label) p, count(*) n from sl group by 1), cv as (select score, sum(p) over w tp, sum(n) over w - sum(p) over w fp, sum(p) over w / sum(n) over w precision, sum(p) over w / sum(p) over () recall from g window w as (order by score desc))"
query("pr_curve", f", {CURVE} select score, cast(tp as bigint) tp, cast(fp as bigint) fp, round(precision, 6) precision, round(recall, 6) recall from cv", "wl", "scores")(lambda s, d: evaluate.pr_curve(_scored_labels(s, d)))
query("auc_pr_trapezoid", f", {CURVE} select round(sum((recall - r0) * (precision + p0) / 2), 6) auc_pr from (select *, coalesce(lag(recall) over (order by score desc), 0) r0, coalesce(lag(precision) over (order by score desc), 1) p0 from cv)", "wl", "scores")(lambda s, d: evaluate.auc_pr(_scored_labels(s, d)))
query("average_precision", f", {CURVE} select round(sum((recall - r0) * precision), 6) average_precision from (select *, coalesce(lag(recall) over (order by score desc), 0) r0 from cv)", "wl", "scores")(lambda s, d: evaluate.average_precision(_scored_labels(s, d)))
query("max_f1", f", {CURVE} select score, cast(tp as bigint) tp, cast(fp as bigint) fp, round(precision, 6) precision, round(recall, 6) recall, round(2 * precision * recall / (precision + recall + 1e-8), 6) f1 from cv order by round(2 * cv.precision * cv.recall / (cv.precision + cv.recall + 1e-8), 9) desc, score desc limit 1", "wl", "scores")(
    lambda s, d: evaluate.max_f1(_scored_labels(s, d))
)
SEG = "sg as (select *, case when label = 1 then sum(b) over (order by t) end segment from (select *, case when label = 1 and coalesce(lag(label) over (order by t), 0) = 0 then 1 else 0 end b from points))"
THR = "th as (select k, lo + (hi - lo) * k / 19 threshold from (select min(score) lo, max(score) hi from points), unnest(range(0, 20)) u(k))"
ADJ = f"{SEG}, {THR}, aj as (select th.threshold, case when segment is null then score >= threshold else max(score) over (partition by th.threshold, segment) >= threshold end p, label = 1 l from sg cross join th), ac as (select threshold, count(*) filter (p and l) tp, count(*) filter (p and not l) fp, count(*) filter (not p and l) fn from aj group by 1)"


def _adjusted(s, d):
    return evaluate.adjusted(fx.points(s, d), evaluate.linear_thresholds(fx.points(s, d), 20).select("threshold"))


query("point_adjusted_sweep", f", {ADJ} select round(threshold, 6) threshold, tp, fp, fn, {PRF} from ac", "points")(_adjusted)
query("best_f1_sweep", f", {ADJ} select round(threshold, 6) threshold, tp, fp, fn, {PRF} from ac order by round(case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end, 9) desc, ac.threshold limit 1", "points")(
    lambda s, d: evaluate.best_adjusted(fx.points(s, d), 20).drop("k")
)
query("point_adjust_latency", f""", {SEG}, x as (select *, min(case when score > 60 and segment is not null then t end) over (partition by segment) f from sg),
y as (select *, segment is not null and f is not null and t < f and t > 0 back, segment is not null and f is not null and t >= f fwd from x),
c as (select count(*) filter ((score > 60 or back or fwd) and label = 1) tp, count(*) filter ((score > 60 or back or fwd) and label = 0) fp, count(*) filter (not (score > 60 or back or fwd) and label = 1) fn, count(*) filter (back and not score > 60) late, count(distinct segment) filter (f is not null) ns from y)
select tp, fp, fn, {PRF}, round(late / (ns + 1e-4), 6) latency from c""", "points")(lambda s, d: evaluate.adjusted_latency(fx.points(s, d), 60.0))


def _thresholds(s, d, n=25):
    return evaluate.linear_thresholds(fx.scores(s, d), n, "abs_score").select("threshold")


STH = "sth as (select lo + (hi - lo) * k / 24 threshold from (select min(abs_score) lo, max(abs_score) hi from scores), unnest(range(0, 25)) u(k))"
RW = "rg as (select event_id, greatest(0, cast(trunc((start - {size}) / 10) as bigint)) lo, cast(trunc(stop / 10) as bigint) + {extra} hi from labelled)"
query("range_f1", f""", {STH}, {RW.format(size=250, extra=2)},
r as (select threshold, avg(hit) recall from (select sth.threshold, rg.event_id, max(case when s.abs_score > sth.threshold then 1 else 0 end) hit from sth cross join rg left join scores s on s.window_idx between rg.lo and rg.hi group by all) group by 1),
p as (select threshold, avg(t) precision from (select sth.threshold, s.window_idx, max(case when rg.event_id is not null then 1 else 0 end) t from sth join scores s on s.abs_score > sth.threshold left join rg on s.window_idx between rg.lo and rg.hi group by all) group by 1)
select round(threshold, 6) threshold, round(recall, 6) recall, round(precision, 6) precision, round(case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end, 6) f1 from r join p using (threshold)""", "scores", "labelled")(
    lambda s, d: evaluate.range_f1(fx.scores(s, d), fx.labelled(s, d), _thresholds(s, d))
)
query("event_f1", """
, od as (select window_idx from states where status <> 'NORMAL'),
c as (select (select count(*) from labelled) n_events, (select count(*) from od) n_windows, (select count(distinct event_id) from near where window_idx in (select window_idx from od)) hits, (select count(*) from od where window_idx in (select window_idx from near)) as "true")
select *, round(case when n_events > 0 then hits / n_events else 0 end, 6) recall, round(case when n_windows > 0 then "true" / n_windows else 0 end, 6) precision,
  round(case when hits > 0 and "true" > 0 then 2 * (hits / n_events) * ("true" / n_windows) / (hits / n_events + "true" / n_windows) else 0 end, 6) f1 from c""", "states", "near")(lambda s, d: evaluate.event_f1(_states(s, d), fx.labelled(s, d)))
query("truth_mask", "select distinct window_idx from near where window_idx < 40", "near")(lambda s, d: evaluate.truth_mask(fx.labelled(s, d), 40))
query("detected_runs", """
, od as (select window_idx, window_idx - row_number() over (order by window_idx) g from states where status <> 'NORMAL')
select min(window_idx) as "first", max(window_idx) as "last", bool_or(window_idx in (select window_idx from near)) is_true from od group by g""", "states", "near")(
    lambda s, d: evaluate.detected_runs(_states(s, d), evaluate.truth_mask(fx.labelled(s, d), 10_000))
)
query("missed_events", "select event_id, start from labelled where event_id not in (select event_id from near where window_idx in (select window_idx from states where status = 'NEW_ANOMALY_ONSET'))", "near", "states")(
    lambda s, d: evaluate.missed_events(_states(s, d).withColumn("status", F.when(F.col("status") == detect.ONSET, detect.ONSET).otherwise(detect.NORMAL)), fx.labelled(s, d)).select("event_id", "start")
)


SWEEP = f"""{STH}, tr as (select distinct window_idx from near),
rg as (select event_id, greatest(0, cast(trunc((start - 100) / 10) as bigint)) lo, cast(trunc(stop / 10) as bigint) + 1 hi from labelled),
hi as (select threshold, sum(hit) hits, count(*) n from (select sth.threshold, rg.event_id, max(case when s.abs_score > sth.threshold then 1 else 0 end) hit from sth cross join rg left join scores s on s.window_idx between rg.lo and rg.hi group by all) group by 1),
od as (select sth.threshold, s.window_idx, s.window_idx - row_number() over (partition by sth.threshold order by s.window_idx) g from sth join scores s on s.abs_score > sth.threshold),
fr as (select threshold, count(*) filter (not t) false_runs from (select threshold, g, bool_or(window_idx in (select window_idx from tr)) t from od group by 1, 2) group by 1),
sw as (select hi.threshold, cast(hits as bigint) hits, coalesce(false_runs, 0) false_runs, case when hits + coalesce(false_runs, 0) > 0 then hits / (hits + coalesce(false_runs, 0)) else 0 end precision, hits / n recall from hi left join fr using (threshold)),
sf as (select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end f1 from sw)"""


def _sweep(s, d):
    return evaluate.event_sweep(fx.scores(s, d), fx.labelled(s, d), _thresholds(s, d), 10_000)


SWEPT = "round(threshold, 6) threshold, hits, false_runs, round(precision, 6) precision, round(recall, 6) recall, round(f1, 6) f1"
query("event_sweep", f", {SWEEP} select {SWEPT} from sf", "scores", "near")(_sweep)
query("event_sweep_best", f", {SWEEP} select {SWEPT} from sf order by round(sf.f1, 9) desc, sf.threshold desc limit 1", "scores", "near")(lambda s, d: evaluate.best_of_sweep(_sweep(s, d)))
query("event_sweep_area", f", {SWEEP} select round(coalesce(sum(a), 0), 6) auc_pr from (select (recall - lag(recall) over (order by recall, precision)) * (precision + lag(precision) over (order by recall, precision)) / 2 a from sf)", "scores", "near")(lambda s, d: evaluate.area_of_sweep(_sweep(s, d)))
query("percentile_thresholds", "select distinct round(q, 6) threshold from (select unnest(quantile_cont(abs_score, [0.8, 0.85, 0.9, 0.95])) q from scores)", "scores")(lambda s, d: evaluate.percentile_thresholds(fx.scores(s, d), 80, 95, 4, "abs_score"))
query("strict_percentile_sweep", f", {SL}, th as (select distinct unnest(quantile_cont(score, [0.0, 0.25, 0.5, 0.75])) threshold from sl), c as (select threshold, count(*) filter (score > threshold and label = 1) tp, count(*) filter (score > threshold and label = 0) fp, count(*) filter (score <= threshold and label = 1) fn from sl cross join th group by 1) select round(threshold, 6) threshold, tp, fp, fn, {PRF} from c", "wl", "scores")(
    lambda s, d: evaluate.strict_percentile_sweep(_scored_labels(s, d), evaluate.percentile_thresholds(_scored_labels(s, d), 0, 75, 4))
)
HIT = f"{RW.format(size=100, extra=2)}, td as (select window_idx, list_transform(split(top_dims, ',')[1:{{k}}], lambda x: cast(x as int) + 1) dims from \"top\"), jn as (select l.event_id, l.dims, td.dims p from labelled l join rg using (event_id) left join td on td.window_idx >= rg.lo and td.window_idx < rg.hi)"
query("ac_at_k", f", {HIT.format(k=1)} select count(*) n, count(*) filter (h) hits, round(count(*) filter (h) / count(*), 6) hit_rate from (select event_id, bool_or(coalesce(list_has_any(p, dims), false)) h from jn group by 1)", "top", "labelled")(lambda s, d: evaluate.hit_rate(fx.top(s, d), fx.labelled(s, d), 1))
query("rca_dim_f1", f""", {HIT.format(k=2)}, u as (select event_id, any_value(dims) dims, coalesce(list_distinct(flatten(list(p) filter (p is not null))), []) p from jn group by 1),
c as (select event_id, len(list_intersect(p, dims)) tp, len(p) np, len(dims) nd from u), r as (select event_id, case when np > 0 then tp / np else 0 end precision, tp / nd recall from c)
select event_id, round(precision, 6) precision, round(recall, 6) recall, round(case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end, 6) f1 from r""", "top", "labelled")(
    lambda s, d: evaluate.dimension_f1(fx.top(s, d), fx.labelled(s, d), 2)
)
query("macro_average", "select count(*) n, round(avg(abs_score), 6) abs_score, round(avg(change_score), 6) change_score from scores", "scores")(lambda s, d: evaluate.macro(fx.scores(s, d), "abs_score", "change_score"))
query("describe_scores", "select round(avg(abs_score), 6) abs_score_mean, round(min(abs_score), 6) abs_score_min, round(max(abs_score), 6) abs_score_max from scores", "scores")(lambda s, d: evaluate.described(fx.scores(s, d), "abs_score"))
query("missing_entities", "select w.window_idx entity, round(case when s.status = 'NEW_ANOMALY_ONSET' then 0 else coalesce(s.abs_score, 0) end, 6) f1, case when s.window_idx is null then 'missing' else 'ok' end status from w left join (select * from states where status <> 'NORMAL') s on s.window_idx = w.window_idx", "w", "states")(
    lambda s, d: evaluate.with_missing(_ids(s, d).withColumnRenamed("window_idx", "entity"), _states(s, d).where("status != 'NORMAL'").select(F.col("window_idx").alias("entity"), F.when(F.col("status") != detect.ONSET, F.col("abs_score")).alias("f1")), "f1")
)
query("mean_ci", "select var, count(*) n, round(avg(value), 6) + 0.0 mean, round(stddev_samp(value), 6) std, round(avg(value) - 1.96 * stddev_samp(value) / sqrt(count(*)), 6) + 0.0 ci_low, round(avg(value) + 1.96 * stddev_samp(value) / sqrt(count(*)), 6) + 0.0 ci_high from prepared group by 1", "prepared")(
    lambda s, d: evaluate.mean_ci(fx.prepared(s, d), "value", ["var"])
)
query("paired_t", "select count(*) n, round(avg(abs_score - change_score), 6) mean_diff, round(avg(abs_score - change_score) / (stddev_samp(abs_score - change_score) / sqrt(count(*))), 6) t from scores", "scores")(lambda s, d: evaluate.paired_t(fx.scores(s, d), "abs_score", "change_score"))
query("convergence", "select count(*) n, round(stddev_samp(w), 6) std, stddev_samp(w) < 1.0 converged from (select run_id, avg(abs(weight)) w from runs group by 1)", "runs")(
    lambda s, d: evaluate.converged(fx.runs(s, d).groupBy("run_id").agg(F.avg(F.abs("weight")).alias("loss")), "loss", 1.0)
)
query("sample_complexity", "select round(sum((1 - f) / sqrt(n)) / sum(1.0 / n), 6) c from (select window_idx + 1 n, avg(abs(weight)) f from edges group by 1)", "edges")(
    lambda s, d: evaluate.sample_complexity(evaluate.by_size(fx.edges(s, d).select((F.col("window_idx") + 1).alias("n"), F.abs("weight").alias("f1"))))
)
query("by_size", "select window_idx n, round(avg(abs(weight)), 6) mean_f1, round(stddev_pop(abs(weight)), 6) std_f1, count(*) seeds from edges group by 1", "edges")(lambda s, d: evaluate.by_size(fx.edges(s, d).select(F.col("window_idx").alias("n"), F.abs("weight").alias("f1"))))
query("parameter_grid", "select * from (select unnest([0.1::double, 0.2]) a) cross join (select unnest([1::int, 2, 3]) b) cross join (select unnest(['x', 'y']) c)")(lambda s, d: evaluate.grid(s, a=[0.1, 0.2], b=[1, 2, 3], c=["x", "y"]))
query("random_search")(lambda s, d: evaluate.grid(s, 5, a=[0.1, 0.2], b=[1, 2, 3], c=["x", "y"]))
query("runtime_projection", "select window_idx, round(abs_score * 100 / 3600, 6) as hours from scores", "scores")(lambda s, d: fx.scores(s, d).select("window_idx", evaluate.runtime_projection(F.col("abs_score")).alias("hours")))
query("ablation_variants", f"select * from {sql_rows([(a['variant'],) for a in evaluate.ABLATIONS], 'variant')}")(lambda s, d: values(s, [(a["variant"],) for a in evaluate.ABLATIONS], "variant string"))

# text formats --------------------------------------------------------------------------------------------------------



def _interval_lines():
    """A label line for each event; every third is malformed: without a colon, or with two."""
    i, u = F.col("event_id"), F.col("user_id")
    line = F.concat(i.cast("string"), F.lit("-"), (i + u).cast("string"), F.lit(":"), (i % 38 + 1).cast("string"), F.lit(", "), (u % 38 + 1).cast("string"))
    return F.when(i % 6 == 0, F.replace(line, F.lit(":"), F.lit(" "))).when(i % 6 == 3, F.concat(line, F.lit(":4"))).otherwise(line)


query("parse_interval_labels", "select event_id start, event_id + user_id as \"end\", event_id % 38 + 1 || ',' || user_id % 38 + 1 dims from events where event_id % 3 > 0")(
    lambda s, d: fx.events(s, d).select(_interval_lines().alias("line")).select(X.interval_label(F.col("line")).alias("x")).where("x is not null").select("x.start", "x.end", F.array_join(F.transform("x.dims", lambda k: k.cast("string")), ",").alias("dims"))
)
query("parse_nested_list", "select event_id id, unnest([event_id, user_id]) start, unnest([event_id + 5, user_id + 1]) as \"end\" from events")(
    lambda s, d: fx.events(s, d).select(F.col("event_id").alias("id"), F.format_string("[[%d, %d], [%d,%d]]", "event_id", F.col("event_id") + 5, "user_id", F.col("user_id") + 1).alias("x")).select("id", F.explode(X.nested_list(F.col("x"))).alias("p")).select("id", "p.*")
)
query("parse_bare_list", "select event_id id, case when event_id % 3 = 0 then '' when event_id % 3 = 1 then event_type else event_type || ',contextual' end classes from events")(
    lambda s, d: fx.events(s, d).select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 3 == 0, "[]").when(F.col("event_id") % 3 == 1, F.concat(F.lit("['"), "event_type", F.lit("']"))).otherwise(F.concat(F.lit("["), "event_type", F.lit(", contextual]"))).alias("x")).select("id", F.array_join(X.bare_list(F.col("x")), ",").alias("classes"))
)
query("parse_report", "select window_idx, round(abs_score, 4) score, cast(window_idx % 7 as int) root, cast(window_idx % 5 as int) effect from scores where window_idx % 4 > 0", "scores")(
    lambda s, d: fx.scores(s, d).select(F.when(F.col("window_idx") % 4 == 0, "window | score | root | effect | edge").otherwise(F.format_string("%d | %.4f | Var_%d | Var_%d | Var_1 -> Var_2 (+0.1)", "window_idx", F.round("abs_score", 4), F.col("window_idx") % 7, F.col("window_idx") % 5)).alias("x")).select(X.report_row(F.col("x")).alias("r")).where("r is not null").select("r.*")
)
query("json_field", "select event_id, cast(json_extract_string(props, '$.k') as varchar) k, 'none' missing from events")(
    lambda s, d: fx.events(s, d).select("event_id", X.json_field(F.col("props"), "absent // k").alias("k"), X.json_field(F.col("props"), "absent", "none").alias("missing"))
)
query("json_lambda", "select event_id, coalesce(cast(json_extract_string(props, '$.k') as double), 0.1) lambda_w, 0.1::double lambda_a from events")(lambda s, d: fx.events(s, d).select("event_id", X.json_lambda(F.col("props"), "k").alias("lambda_w"), X.json_lambda(F.col("props"), "lambda_a").alias("lambda_a")))
query("run_of_path", "select event_id, cast(event_id % 1000 as int) run_id from events")(lambda s, d: fx.events(s, d).select("event_id", X.window_of_path(F.format_string("file:/x/run_%03d/weights/weights_enhanced.csv", F.col("event_id") % 1000)).alias("run_id")))
query("last_window", "select max(window_idx) last_window from edges", "edges")(lambda s, d: fx.edges(s, d).agg(F.max("window_idx").alias("last_window")))

# tables that went through files ---------------------------------------------------------------------------------------


def _wide(s, d):
    return readers.to_wide(fx.series(s, d), [r.var for r in fx.series(s, d).select("var").distinct().orderBy("var").collect()])


def _file(s, name: str) -> str:
    return f"{shared_folder(s)}/{name}-{uuid.uuid4().hex}"


def _through_csv(s, d):
    path = _file(s, "wide")
    _wide(s, d).withColumnRenamed("t", "index").write.option("header", True).csv(path)
    return readers.to_long(readers.wide_csv(s, path))


def _through_npy(s, d):
    path, wide = _file(s, "series") + ".npy", _wide(s, d)
    npy.save_npy(wide, wide.columns[1:], path)
    s.dataSource.register(npy.NpyDataSource)
    return s.read.format("npy").option("rowsPerPartition", 500).load(path)


def _through_text(s, d):
    path, wide = _file(s, "headerless"), _wide(s, d)
    # one file, whose order is that of the rows
    wide.coalesce(1).sortWithinPartitions("t").drop("t").write.csv(path)
    read = readers.with_time(readers.headerless_csv(s, path, len(wide.columns) - 1), "pos")
    return read.select("t", *[F.col(c).cast("double").alias(c) for c in read.columns if c.startswith("dim_")])


def _through_edges(s, d):
    path = _file(s, "edges")
    fx.edges(s, d).select("window_idx", "i", "j", "lag", "weight").write.option("header", True).csv(path)
    return readers.edges_csv(s, path, fx.GOLDEN, 2 * fx.GOLDEN)


def _through_runs(s, d):
    path = _file(s, "runs")
    for k in range(fx.N_RUNS):
        fx.runs(s, d).where(F.col("run_id") == k).select("window_idx", "i", "j", "lag", "weight").write.option("header", True).csv(f"{path}/run_{k:03d}/weights/weights_enhanced.csv")
    return readers.edge_runs(s, f"{path}/*/weights/weights_enhanced.csv", ("run_003",))


def _through_labels(s, d):
    path = _file(s, "labels")
    fx.points(s, d).coalesce(1).sortWithinPartitions("t").select(F.col("label").cast("string")).write.text(path)
    return readers.point_labels(s, path)


def _resumed(s, d):
    path, edges = _file(s, "resumed"), fx.edges(s, d).select("window_idx", "i", "j", "lag", "weight")
    readers.append_new(edges.where(F.col("window_idx") % 3 != 1), path)
    readers.append_new(edges, path)
    return s.read.parquet(path).groupBy("window_idx").agg(F.count(F.lit(1)).alias("n_edges"), F.sum("weight").alias("weight"))


LONG = "select t, var, var_idx, round(value, 6) as value from series"
query("wide_csv_series", LONG, "series")(_through_csv)
query("npy_series", LONG, "series")(_through_npy)
query("headerless_series", "select t, " + ", ".join(f"round(cast(cast(max(value) filter (var_idx = {k}) as float) as double), 6) dim_{k}" for k in range(5)) + " from series group by 1", "series")(_through_text)
query("edges_csv_range", "select window_idx, i, j, lag, round(weight, 6) + 0.0 weight from edges where window_idx >= 20 and window_idx < 40", "edges")(_through_edges)
query("edge_runs_glob", "select window_idx, i, j, lag, round(weight, 6) + 0.0 weight, run_id from runs where run_id <> 3", "runs")(_through_runs)
query("point_labels_file", "select row_number() over (order by t) - 1 t, cast(label as int) label from points", "points")(_through_labels)
query("append_resumed", "select window_idx, count(*) n_edges, round(sum(weight), 6) + 0.0 weight from edges group by 1", "edges")(_resumed)

# a second series, from sales, and the whole way ----------------------------------------------------------------------

query("sales_detrended", """
with dy as (select cast(l_shipdate as date) dt, l_returnflag var, sum(l_extendedprice) v from lineitem group by all),
x as (select dt, var, ln(1 + v + 1e-10) v from dy)
select cast(dt as varchar) dt, var, round(v - coalesce(median(v) over (partition by var order by dt rows between 60 preceding and 1 preceding), v), 6) + 0.0 as value from x""")(
    lambda s, d: prep.detrend(prep.log_shift(s.read.parquet(f"{d}/lineitem.parquet").groupBy(F.to_date("l_shipdate").alias("dt"), F.col("l_returnflag").alias("var")).agg(F.sum("l_extendedprice").alias("value")).withColumn("t", F.col("dt")))).select(F.col("dt").cast("string").alias("dt"), "var", "value")
)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events to anomaly states: fill, detrend, standardise, window, correlate, score against the golden mean, classify."""
    s = fx.scores(spark, sf_dir)
    return rounded(detect.static_states(s, detect.golden_thresholds(s.where(F.col("window_idx") < fx.GOLDEN))).select("window_idx", "abs_score", "change_score", "abs_trend", "status"))


query("pipeline_states", """
, th as (select greatest(avg(abs_score) + 3 * stddev_pop(abs_score), 0.001) t from scores where window_idx < 20)
select window_idx, round(abs_score, 6) abs_score, round(change_score, 6) change_score, round(abs_trend, 6) + 0.0 abs_trend,
  case when abs_score < t then 'NORMAL' when change_score > 1.5 * t and abs_trend > 0.5 * t then 'NEW_ANOMALY_ONSET' when change_score > 1.5 * t and abs_trend < -0.5 * t then 'RECOVERY_FLUCTUATION' when abs_score > t then 'CASCADE_OR_PERSISTENT' else 'NORMAL' end status
from scores cross join th""", "scores")(flagship)
