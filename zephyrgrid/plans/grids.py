"""Time-grid operators (survey section 2.4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.timeaxis import hour_of, shift
from ..models import seasonal_naive
from ..operators import grid
from ..sources.driver_tables import Tables
from .catalog import query

NAIVE_FORECAST = """
forecast as (
  select n.unique_id, e.last_ds + to_hours(cast(h as int)) as ds, h as horizon_step, n.y as yhat
  from numbered n join (select unique_id, max(ds) as last_ds from series group by 1) e using (unique_id),
    range(1, 25) r(h) where n.pos = n.n - 24 + (h - 1) % 24)"""


@query("regrid_15m", """
with holes as (select id, "time", temp, wpgt, wpgt as g, id || '-' || cast(floor(wpgt) as int) as tag from hourly_full),
known as (
  select id, "time", temp, wpgt, tag,
    last_value(case when temp is not null then struct_pack(a := "time", v := temp) end ignore nulls) over w as pt,
    first_value(case when temp is not null then struct_pack(a := "time", v := temp) end ignore nulls) over f as nt,
    last_value(case when wpgt is not null then struct_pack(a := "time", v := wpgt) end ignore nulls) over w as pw,
    first_value(case when wpgt is not null then struct_pack(a := "time", v := wpgt) end ignore nulls) over f as nw,
    last_value(tag ignore nulls) over w as ptag, first_value(tag ignore nulls) over f as ntag,
    lead("time") over (partition by id order by "time") as nxt
  from holes window w as (partition by id order by "time" rows unbounded preceding),
    f as (partition by id order by "time" rows between 1 following and unbounded following)),
points as (select *, unnest(generate_series("time", coalesce(nxt - interval 15 minute, "time"), interval 15 minute)) as moment
  from known)
---
  select id, moment as "time",
    case when moment = "time" and temp is not null then temp when nt is null then pt.v
      else pt.v + (nt.v - pt.v) * (epoch(moment) - epoch(pt.a)) / (epoch(nt.a) - epoch(pt.a)) end as temp,
    case when moment = "time" and wpgt is not null then wpgt when nw is null then pw.v
      else pw.v + (nw.v - pw.v) * (epoch(moment) - epoch(pw.a)) / (epoch(nw.a) - epoch(pw.a)) end as wpgt,
    coalesce(ptag, ntag) as tag from points""", "temp wpgt")
def regrid_15m(t: Tables):
    df = t.hourly_full().select("id", "time", "temp", "wpgt",
                                F.concat("id", F.lit("-"), F.floor("wpgt")).alias("tag"))
    return grid.regrid(df, ["id"], "time", ["temp", "wpgt"], ["tag"])


@query("interpolate_rows", """
with placed as (select id, "time", wpgt, tsun, row_number() over (partition by id order by "time") as p from hourly),
near as (select *, """ + ", ".join(
    f"last_value(case when {c} is not null then struct_pack(a := p, v := {c}) end ignore nulls) over w as p{c}, "
    f"first_value(case when {c} is not null then struct_pack(a := p, v := {c}) end ignore nulls) over f as n{c}"
    for c in ("wpgt", "tsun")) + """
  from placed window w as (partition by id order by "time" rows unbounded preceding),
    f as (partition by id order by "time" rows between current row and unbounded following))
---
  select id, "time", """ + ", ".join(
    f"case when {c} is not null then {c} when n{c} is null then p{c}.v "
    f"else p{c}.v + (n{c}.v - p{c}.v) * (p - p{c}.a) / (n{c}.a - p{c}.a) end as {c}" for c in ("wpgt", "tsun"))
    + " from near", "wpgt tsun")
def interpolate_rows(t: Tables):
    return grid.interpolate_rows(t.staged("hourly").select("id", "time", "wpgt", "tsun"), ["id"], "time", ["wpgt", "tsun"])


FREQUENCY = """
steps as (select unique_id, cast(epoch(ds) - epoch(lag(ds) over (partition by unique_id order by ds)) as bigint) as step
  from sparse),
ranked as (select unique_id, step, row_number() over (partition by unique_id order by count(*) desc, step) as r
  from steps where step is not null group by 1, 2),
frequency as (select unique_id, step as step_seconds,
  case when step <= 900 then '15min' when step <= 3600 then 'H' else 'D' end as freq,
  cast(case when step <= 900 then 96 when step <= 3600 then 24 else 7 end as int) as season from ranked where r = 1)"""
SPARSE = """sparse as (select cast(user_id as varchar) as unique_id, date_trunc('hour', "time") as ds, avg(temp) as y
  from obs group by 1, 2)"""


def _sparse(t: Tables):
    return t.obs_by_user().groupBy(F.col("id").alias("unique_id"), hour_of("time").alias("ds")).agg(
        F.avg("temp").alias("y"))


@query("detect_freq", f"with {SPARSE}, {FREQUENCY}\n---\n select * from frequency", "season")
def detect_freq(t: Tables):
    return grid.detect_frequency(_sparse(t))


@query("future_grid", f"""with {SPARSE}, {FREQUENCY},
ends as (select unique_id, max(ds) as last_ds from sparse group by 1)
---
  select unique_id, last_ds + to_seconds(h * case freq when '15min' then 900 when 'H' then 3600 else 86400 end) as ds,
    cast(h as int) as horizon_step from ends join frequency using (unique_id), range(1, 97) r(h)
  where h <= case freq when 'H' then 24 when 'D' then 1 else 96 end""")
def future_grid(t: Tables):
    return grid.future_grid(_sparse(t))


@query("realign_dates", f"""with {NAIVE_FORECAST.strip()}
---
  select unique_id, 'SeasonalNaive' as model, ds, cast(horizon_step as int) as horizon_step, yhat from forecast""", "yhat")
def realign_dates(t: Tables):
    """A forecast that came out a day late is put back on its grid."""
    late = seasonal_naive.forecast(t.series(), 24, 3600).withColumn("ds", shift("ds", 86400))
    return grid.realign_dates(late, t.series(), 3600)


@query("bridge_series", f"""with {NAIVE_FORECAST.strip()},
moved as (select unique_id, ds + interval 4 hour as ds, yhat, yhat - 1 as lo, yhat + 2 as hi from forecast),
ends as (select a.*, b.* exclude (u) from
  (select unique_id, max(ds) as a_ds, arg_max(y, ds) as a_y from series group by 1) a
  join (select unique_id as u, min(ds) as b_ds, arg_min(yhat, ds) as b_y, arg_min(lo, ds) as b_lo, arg_min(hi, ds) as b_hi
    from moved group by 1) b on a.unique_id = b.u)
---
  select unique_id, a_ds as ds, a_y as yhat, a_y as lo, a_y as hi, 'bridge' as part from ends
  union all select unique_id, a_ds + to_hours(cast(i as int)), a_y + (b_y - a_y) * i / 5, a_y + (b_lo - a_y) * i / 5,
    a_y + (b_hi - a_y) * i / 5, 'gap' from ends, range(1, 5) r(i)
  union all select unique_id, ds, yhat, lo, hi, 'forecast' from moved""", "yhat lo hi")
def bridge_series(t: Tables):
    moved = seasonal_naive.forecast(t.series(), 24, 3600).select(
        "unique_id", shift("ds", 4 * 3600).alias("ds"), "yhat", (F.col("yhat") - 1).alias("lo"), (F.col("yhat") + 2).alias("hi"))
    return grid.bridge(t.series(), moved, 3600)


@query("train_test_split", """select unique_id, ds, y, case when pos < floor(n * 0.8) then 'train' else 'test' end as by_share,
    case when pos < n - 90 then 'train' else 'test' end as by_rows,
    case when ds <= timestamp '2024-01-21 00:00:00' then 'train' else 'test' end as by_date from numbered""", "y")
def train_test_split(t: Tables):
    shared = grid.split_by_fraction(t.series(), 0.8).withColumnRenamed("part", "by_share")
    rows = grid.split_last_rows(shared, 90).withColumnRenamed("part", "by_rows")
    cutoff = F.lit("2024-01-21 00:00:00").cast("timestamp_ntz")
    return grid.split_by_cutoff(rows, cutoff).withColumnRenamed("part", "by_date")


@query("difference", """
with d as (select unique_id, ds, y, y - lag(y) over (partition by unique_id order by ds) as d1 from series)
---
  select unique_id, ds, d1, d1 - lag(d1) over (partition by unique_id order by ds) as d2 from d""", "d1 d2")
def difference(t: Tables):
    first = grid.difference(t.series()).withColumnsRenamed({"y": "level", "dy": "y"})
    return grid.difference(first).select("unique_id", "ds", F.col("y").alias("d1"), F.col("dy").alias("d2"))


@query("cv_folds", """select unique_id, cast(f as int) as fold, ds as cutoff, pos + 1 as n_train from numbered, range(0, 5) r(f)
    where pos = n - 12 - (4 - f) * 12 - 1""")
def cv_folds(t: Tables):
    return grid.fold_cutoffs(t.series(), 12, 12, 5)


@query("incremental_fetch", """
with start as (select u.id, coalesce(s.m, timestamp '2024-01-31 00:00:00' - interval 365 day) as start
  from (select distinct id from obs_user) u left join (select id, max("time") as m from obs_user
    where "time" <= timestamp '2024-01-03 00:00:00' group by 1) s using (id))
---
  select o.id, o."time", o.temp from obs_user o join start using (id) where o."time" > start""")
def incremental_fetch(t: Tables):
    source = t.obs_by_user().select("id", "time", "temp")
    stored = source.filter(F.col("time") <= F.lit("2024-01-03 00:00:00").cast("timestamp_ntz"))
    starts = grid.incremental_start(source.select("id").distinct(), stored, "id", "time", "2024-01-31 00:00:00")
    return grid.incremental_fetch(source, starts, "id", "time")


@query("seasonal_decompose", """
with trended as (
  select unique_id, ds, y, pos % 12 as phase, case when count(*) over full_w = 13
    then (0.5 * lag(y, 6) over w + sum(y) over mid + 0.5 * lead(y, 6) over w) / 12 end as trend
  from numbered window w as (partition by unique_id order by ds),
    mid as (partition by unique_id order by ds rows between 5 preceding and 5 following),
    full_w as (partition by unique_id order by ds rows between 6 preceding and 6 following)),
phases as (select unique_id, phase, avg(y - trend) as raw from trended group by 1, 2),
seasonal as (select unique_id, phase, raw - avg(raw) over (partition by unique_id) as seasonal from phases)
---
  select unique_id, ds, y, trend, seasonal, y - trend - seasonal as resid
  from trended join seasonal using (unique_id, phase)""", "y trend seasonal resid")
def seasonal_decompose(t: Tables):
    return grid.seasonal_decompose(t.series(), 12)


@query("make_sequences", """
with made as (select unique_id, ds, """ + ", ".join(
    f"lag(y, {8 - k}) over w as x{k}" for k in range(1, 8)) + """, y as target, pos from numbered
  window w as (partition by unique_id order by ds))
---
  select unique_id, ds, x1, x2, x3, x4, x5, x6, x7, target from made where pos >= 7""", "x1 x2 x3 x4 x5 x6 x7 target")
def make_sequences(t: Tables):
    made = grid.make_sequences(t.series(), 7)
    return made.select("unique_id", "ds", *[F.col("x")[k - 1].alias(f"x{k}") for k in range(1, 8)], "target")
