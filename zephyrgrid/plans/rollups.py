"""Roll-ups, normals and coverage (survey section 2.5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.timeaxis import hour_of
from ..operators import rollup
from ..schema import MEASURES
from ..sources.driver_tables import Tables
from .catalog import query

CIRCLE = "(degrees(atan2(avg(sin(radians(wdir))), avg(cos(radians(wdir))))) + 360) % 360 as wdir"
REST = f"""avg(dwpt) as dwpt, avg(rhum) as rhum, coalesce(sum(prcp), 0) as prcp, max(snow) as snow, {CIRCLE},
  avg(wspd) as wspd, max(wpgt) as wpgt, avg(pres) as pres, coalesce(sum(tsun), 0) as tsun, max(coco) as coco"""
MEANS = "dwpt rhum wdir wspd pres"


def full_daily(source: str) -> str:
    return f"""
rolled as (select id, date_trunc('day', "time") as "day", {REST}, min(temp) as tmin, max(temp) as tmax, avg(temp) as tavg
  from {source} group by 1, 2),
days as (select id, unnest(generate_series(min("day"), max("day"), interval 1 day)) as "day" from rolled group by 1),
daily as (select * replace (coalesce(prcp, 0) as prcp, coalesce(tsun, 0) as tsun) from days left join rolled using (id, "day"))"""


@query("daily_rollup", f"with {full_daily('obs').strip()}\n---\n select * from daily", MEANS + " tavg")
def daily_rollup(t: Tables):
    return rollup.daily_rollup(t.obs().select("id", "time", *MEASURES), ["id"], "time")


@query("daily_rollup_sparse", f"with {full_daily('obs_user').strip()}\n---\n select * from daily", MEANS + " tavg")
def daily_rollup_sparse(t: Tables):
    """Series with empty days, which stay in the result."""
    return rollup.daily_rollup(t.obs_by_user().select("id", "time", *MEASURES), ["id"], "time")


@query("weekly_rollup", f"""
with rolled as (select id, date_trunc('week', "time") + interval 6 day as week, avg(temp) as temp, {REST}
  from obs_user group by 1, 2),
weeks as (select id, unnest(generate_series(min(week), max(week), interval 7 day)) as week from rolled group by 1)
---
  select * replace (coalesce(prcp, 0) as prcp, coalesce(tsun, 0) as tsun)
  from weeks left join rolled using (id, week)""", MEANS + " temp")
def weekly_rollup(t: Tables):
    return rollup.weekly_rollup(t.obs_by_user().select("id", "time", *MEASURES), ["id"], "time")


@query("monthly_rollup", f"""with {full_daily('obs_user').strip()}
---
  select id, date_trunc('month', "day") as "month", avg(tavg) as tavg, min(tmin) as tmin, max(tmax) as tmax,
    sum(prcp) as prcp, avg(wspd) as wspd, avg(pres) as pres, sum(tsun) as tsun from daily group by 1, 2""",
       "tavg wspd pres")
def monthly_rollup(t: Tables):
    daily = rollup.daily_rollup(t.obs_by_user().select("id", "time", *MEASURES), ["id"], "time")
    return rollup.monthly_rollup(daily, ["id"])


@query("circular_mean", f"""select id, date_trunc('day', "time") as "day", {CIRCLE} from obs group by 1, 2""", "wdir")
def circular_mean(t: Tables):
    return rollup.direction_rollup(t.obs(), ["id"], "time")


@query("daily_mean", "select unique_id, date_trunc('day', ds) as ds, avg(y) as y from series group by 1, 2", "y")
def daily_mean(t: Tables):
    return rollup.daily_mean(t.hourly_mean())


@query("coverage", """
with counted as (select id, count(*) as n, count(temp) as temp, count(snow) as snow, count(wpgt) as wpgt,
  count(tsun) as tsun from hourly_full group by 1)
---
  select id, measure, n_present, n_present / cast(n as double) as coverage from counted
    unpivot (n_present for measure in (temp, snow, wpgt, tsun))""", "coverage")
def coverage(t: Tables):
    return rollup.coverage(t.hourly_full(), ["id"], ["temp", "snow", "wpgt", "tsun"])


NORMALS = """normals as (select id, cast(month("time") as int) as month, cast(hour("time") as int) as hour,
  avg(temp) as normal, count(temp) as n from obs group by 1, 2, 3)"""


@query("climate_normals", f"with {NORMALS}\n---\n select * from normals", "normal")
def climate_normals(t: Tables):
    return rollup.climate_normals(t.obs(), ["id"], "time", "temp")


@query("anomaly", f"""with {NORMALS}
---
  select event_id, temp, normal, temp - normal as anomaly from obs o
  join normals m on o.id = m.id and month(o."time") = m.month and hour(o."time") = m.hour""", "normal anomaly")
def anomaly(t: Tables):
    return rollup.anomaly(t.obs().select("id", "time", "event_id", "temp"), ["id"], "time", "temp").select(
        "event_id", "temp", "normal", "anomaly")


@query("temp_load_trend", """select date_trunc('hour', "time") as hour, avg(temp) as temp, count(temp) as n from obs
  where "time" > (select max("time") from obs) - interval 24 hour group by 1""", "temp")
def temp_load_trend(t: Tables):
    return rollup.trailing_trend(t.obs(), "time", "temp", hour_of("time"))
