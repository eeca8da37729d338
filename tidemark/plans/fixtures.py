"""Tables that the registered queries start from, in Spark and as SQL of the same meaning.

``series`` is the hourly mean value of each event type; ``edges`` are correlations within sliding windows, an estimator
with an exact SQL counterpart that stands in for the model of the kernels; ``runs`` leaves a fifth of the events out in
each of five runs. Results are kept for a session, as queries share them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import distance, learn, prep, windows
from tidemark.session import durable

N_RUNS, GOLDEN, MAX_LAG, ALARM = 5, 20, 2, 180.0
_kept: dict[tuple, DataFrame] = {}


def kept(make: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """One written result per session and input: what is built on it has a plan of its own length only."""

    def get(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir, make.__name__)
        if key not in _kept:
            _kept[key] = durable(make(spark, sf_dir))
        return _kept[key]

    return get


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).cast("long")
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("hour", hour)


def _grid(e: DataFrame, spark: SparkSession, sf_dir: str, by: list[str]) -> DataFrame:
    """Every hour between the first and the last, for every type (and run): missing where there is no event."""
    all_events = events(spark, sf_dir)
    hours = all_events.agg(F.min("hour").alias("lo"), F.max("hour").alias("hi")).select("lo", F.explode(F.sequence("lo", "hi")).alias("hour"))
    types = all_events.select(F.col("event_type").alias("var")).distinct().withColumn("var_idx", (F.row_number().over(Window.orderBy("var")) - 1).cast("int"))
    keys = e.select(*by).distinct() if by else None
    grid = hours.crossJoin(F.broadcast(types))
    grid = grid.crossJoin(F.broadcast(keys)) if by else grid
    means = e.groupBy(*by, "hour", F.col("event_type").alias("var")).agg(F.avg("value").alias("value"))
    return grid.join(means, [*by, "hour", "var"], "left").select(*by, (F.col("hour") - F.col("lo")).alias("t"), "hour", "var", "var_idx", "value")


@kept
def raw(spark, sf_dir):
    return _grid(events(spark, sf_dir), spark, sf_dir, [])


def _complete(series: DataFrame, by: list[str]) -> DataFrame:
    full = prep.drop_incomplete(prep.forward_fill(series, by), by)
    order = Window.partitionBy(*by, "var").orderBy("t")
    return full.withColumn("t", (F.row_number().over(order) - 1).cast("long"))


@kept
def series(spark, sf_dir):
    return _complete(raw(spark, sf_dir), [])


@kept
def prepared(spark, sf_dir):
    return prep.standardise(prep.detrend(prep.log_shift(series(spark, sf_dir)).drop("shift")))


@kept
def windowed(spark, sf_dir):
    return windows.sliding(prepared(spark, sf_dir).select("t", "var_idx", "value"))


@kept
def edges(spark, sf_dir):
    return learn.correlation_edges(windowed(spark, sf_dir), MAX_LAG)


def golden(spark, sf_dir):
    return edges(spark, sf_dir).where(F.col("window_idx") < GOLDEN)


def test(spark, sf_dir):
    return edges(spark, sf_dir).where(F.col("window_idx") >= GOLDEN)


@kept
def runs(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("run_id", F.explode(F.sequence(F.lit(0), F.lit(N_RUNS - 1)))).where(F.pmod("event_id", F.lit(N_RUNS)) != F.col("run_id"))
    full = _complete(_grid(e, spark, sf_dir, ["run_id"]), ["run_id"]).select("run_id", "t", "var_idx", "value")
    return learn.correlation_edges(windows.sliding(full, by=["run_id"]), 1, ("run_id", "window_idx"))


@kept
def scores(spark, sf_dir):
    """window_idx, abs_score, change_score, abs_trend of all windows against the golden mean."""
    base = distance.golden_mean(golden(spark, sf_dir))
    e = edges(spark, sf_dir).where("lag = 0")
    s = distance.to_baseline(e, base).join(distance.change_scores(e), "window_idx")
    return distance.trend(s).select(F.col("window_idx").cast("int").alias("window_idx"), F.round("abs_score", 9).alias("abs_score"), F.round("change_score", 9).alias("change_score"), F.round("abs_trend", 9).alias("abs_trend"))


@kept
def top(spark, sf_dir):
    """window_idx, top_dims: what differs from the window before."""
    e = edges(spark, sf_dir).where("lag = 0")
    ids = e.select(F.col("window_idx").alias("a")).distinct().withColumn("b", F.col("a") - 1).where("b >= 0")
    return distance.top_dims(distance.pair_cells(ids, e, e)).select(F.col("a").alias("window_idx"), "top_dims")


@kept
def points(spark, sf_dir):
    """t, label, score: an hour is positive if its greatest error value is above ALARM; its score is the mean error value."""
    alarm = events(spark, sf_dir).where("event_type = 'error'").groupBy("hour").agg(F.max("value").alias("m"))
    s = series(spark, sf_dir).where("var = 'error'").join(alarm, "hour", "left")
    return s.select("t", F.when(F.col("m") > ALARM, 1).otherwise(0).alias("label"), F.round("value", 6).alias("score"))


@kept
def labelled(spark, sf_dir):
    """event_id, start, end (half-open), dims from 1: runs of positive points."""
    from tidemark.operators.evaluate import segments

    s = segments(points(spark, sf_dir)).withColumn("event_id", (F.row_number().over(Window.orderBy("start")) - 1).cast("int"))
    dims = F.array((F.col("event_id") % 5 + 1).cast("int"), ((F.col("event_id") + 2) % 5 + 1).cast("int"))
    return s.select("event_id", "start", (F.col("end") + 1).alias("end"), dims.alias("dims"))


#: The same as SQL: name -> (what it needs, text).
CTE: dict[str, tuple[tuple[str, ...], str]] = {
    "ev": ((), "select *, cast(floor(epoch(ts) / 3600) as bigint) as hour from events"),
    "span": (("ev",), "select min(hour) lo, max(hour) hi from ev"),
    "hours": (("span",), "select lo, unnest(range(lo, hi + 1)) as hour from span"),
    "types": ((), "select var, cast(row_number() over (order by var) - 1 as int) var_idx from (select distinct event_type var from events)"),
    "raw": (("ev", "hours", "types"), """
        select h.hour - h.lo t, h.hour, y.var, y.var_idx, m.value
        from hours h cross join types y
        left join (select hour, event_type var, avg(value) as value from ev group by all) m on m.hour = h.hour and m.var = y.var"""),
    "filled": (("raw",), "select t, hour, var, var_idx, last_value(value ignore nulls) over (partition by var order by t rows between unbounded preceding and current row) as value from raw"),
    "series": (("filled",), """
        select cast(row_number() over (partition by var order by t) - 1 as bigint) t, hour, var, var_idx, value
        from filled where t not in (select t from filled where value is null)"""),
    "logged": (("series",), """
        select t, var, var_idx, ln(1 + value + case when min(value) over (partition by var) <= 0 then abs(min(value) over (partition by var)) + 1e-10 else 1e-10 end) as value from series"""),
    "detrended": (("logged",), """
        select t, var, var_idx, value - coalesce(median(value) over (partition by var order by t rows between 60 preceding and 1 preceding), value) as value from logged"""),
    "prepared": (("detrended",), """
        select t, var, var_idx, (value - avg(value) over (partition by var)) / case when stddev_pop(value) over (partition by var) = 0 then 1 else stddev_pop(value) over (partition by var) end as value from detrended"""),
    "n_w": (("prepared",), "select greatest(0, (max(t) + 1 - 100) // 10 + 1) n from prepared"),
    "w": (("n_w",), "select cast(unnest(range(0, n)) as int) window_idx from n_w"),
    "windowed": (("w", "prepared"), "select window_idx, t, var_idx, value from w join prepared p on p.t >= window_idx * 10 and p.t < window_idx * 10 + 100"),
    "edges": (("windowed",), """
        select x.window_idx, x.var_idx i, y.var_idx j, cast(l.lag as int) lag, corr(x.value, y.value) weight
        from windowed x cross join (select unnest([0, 1, 2]) lag) l join windowed y on y.window_idx = x.window_idx and y.t = x.t + l.lag
        where l.lag > 0 or x.var_idx <> y.var_idx group by all having weight is not null and not isnan(weight)"""),
    "golden": (("edges",), "select * from edges where window_idx < 20"),
    "test": (("edges",), "select * from edges where window_idx >= 20"),
    "rev": (("ev",), "select e.*, cast(r.run_id as int) run_id from ev e cross join (select unnest(range(0, 5)) run_id) r where event_id % 5 <> r.run_id"),
    "rraw": (("rev", "hours", "types"), """
        select r.run_id, h.hour - h.lo t, y.var, y.var_idx, m.value
        from hours h cross join types y cross join (select distinct run_id from rev) r
        left join (select run_id, hour, event_type var, avg(value) as value from rev group by all) m on m.hour = h.hour and m.var = y.var and m.run_id = r.run_id"""),
    "rfilled": (("rraw",), "select run_id, t, var, var_idx, last_value(value ignore nulls) over (partition by run_id, var order by t rows between unbounded preceding and current row) as value from rraw"),
    "rseries": (("rfilled",), """
        select run_id, row_number() over (partition by run_id, var order by t) - 1 t, var_idx, value
        from rfilled where (run_id, t) not in (select (run_id, t) from rfilled where value is null)"""),
    "rwin": (("rseries",), """
        select s.run_id, cast(g.window_idx as int) window_idx, s.t, s.var_idx, s.value
        from (select run_id, unnest(range(0, greatest(0, (max(t) + 1 - 100) // 10 + 1))) window_idx from rseries group by run_id) g
        join rseries s on s.run_id = g.run_id and s.t >= g.window_idx * 10 and s.t < g.window_idx * 10 + 100"""),
    "runs": (("rwin",), """
        select x.run_id, x.window_idx, x.var_idx i, y.var_idx j, cast(l.lag as int) lag, corr(x.value, y.value) weight
        from rwin x cross join (select unnest([0, 1]) lag) l join rwin y on y.run_id = x.run_id and y.window_idx = x.window_idx and y.t = x.t + l.lag
        where l.lag > 0 or x.var_idx <> y.var_idx group by all having weight is not null and not isnan(weight)"""),
    "e0": (("edges",), "select window_idx, i, j, weight from edges where lag = 0"),
    "gmean": (("golden",), "select i, j, avg(weight) weight from golden where lag = 0 group by all"),
    "base_score": (("e0", "gmean", "w"), """
        select w.window_idx, sqrt(sum(power(coalesce(e.weight, 0) - coalesce(g.weight, 0), 2))) abs_score
        from w cross join (select distinct i, j from e0 union select i, j from gmean) c
        left join e0 e on e.window_idx = w.window_idx and e.i = c.i and e.j = c.j left join gmean g on g.i = c.i and g.j = c.j group by 1"""),
    "chg": (("e0", "w"), """
        select w.window_idx, case when w.window_idx = 0 then 0.0::double else sqrt(sum(power(coalesce(e.weight, 0) - coalesce(p.weight, 0), 2))) end change_score
        from w cross join (select distinct i, j from e0) c
        left join e0 e on e.window_idx = w.window_idx and e.i = c.i and e.j = c.j left join e0 p on p.window_idx = w.window_idx - 1 and p.i = c.i and p.j = c.j group by 1"""),
    "scores": (("base_score", "chg"), """
        select window_idx, round(abs_score, 9) abs_score, round(change_score, 9) change_score,
          round(coalesce(abs_score - lag(abs_score, 5) over (order by window_idx), 0), 9) abs_trend from base_score join chg using (window_idx)"""),
    "prev": (("e0", "w"), """
        select w.window_idx, c.i, c.j, coalesce(e.weight, 0) x, coalesce(p.weight, 0) y
        from w cross join (select distinct i, j from e0) c
        left join e0 e on e.window_idx = w.window_idx and e.i = c.i and e.j = c.j left join e0 p on p.window_idx = w.window_idx - 1 and p.i = c.i and p.j = c.j where w.window_idx > 0"""),
    "top": (("prev",), """
        select window_idx, string_agg(cast(dim as varchar), ',' order by r) top_dims from (
          select window_idx, dim, row_number() over (partition by window_idx order by s desc, dim) r from (
            select window_idx, dim, round(sum(d), 9) s from (
              select window_idx, i dim, round(abs(x - y), 12) d from prev union all select window_idx, j, round(abs(x - y), 12) from prev) group by all))
        where r <= 5 group by 1"""),
    "points": (("ev", "series"), """
        select s.t, case when a.m > 180 then 1 else 0 end label, round(s.value, 6) score
        from series s left join (select hour, max(value) m from ev where event_type = 'error' group by 1) a on a.hour = s.hour where s.var = 'error'"""),
    "segs": (("points",), "select min(t) a, max(t) b from (select t, t - row_number() over (order by t) g from points where label = 1) group by g"),
    "labelled": (("segs",), """
        select event_id, a as start, b + 1 as stop, [cast(event_id % 5 + 1 as int), cast((event_id + 2) % 5 + 1 as int)] dims
        from (select *, cast(row_number() over (order by a) - 1 as int) event_id from segs)"""),
    "near": (("labelled",), "select event_id, start, stop, dims, cast(unnest(range(greatest(0, cast(floor((start - 100) / 10) as bigint) + 1), cast(ceil(stop / 10) as bigint))) as int) window_idx from labelled where start < stop"),
    "states": (("scores",), """
        select *, case when abs_score < 0.5 then 'NORMAL' when change_score > 0.6 and abs_trend > 0.05 then 'NEW_ANOMALY_ONSET'
          when change_score > 0.6 and abs_trend < -0.05 then 'RECOVERY_FLUCTUATION' else 'CASCADE_OR_PERSISTENT' end status from scores"""),
    "wl": (("points", "w"), "select window_idx, cast(max(label) as int) label from w join points p on p.t >= window_idx * 10 and p.t < window_idx * 10 + 100 group by 1"),
}


def with_tables(body: str, *needs: str) -> str:
    """The query with what it needs before it, each after what it needs itself."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in CTE[name][0]:
            add(n)
        if name not in order:
            order.append(name)

    for n in needs:
        add(n)
    return ("with " + ",\n".join(f"{n} as ({CTE[n][1].strip()})" for n in order) + "\n" if order else "") + body
