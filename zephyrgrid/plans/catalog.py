"""Query registry and the SQL views the checks are written against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.driver_tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6
# Added before rounding on both sides, so that a decimal tie does not hang on the last bit.
OFF_TIES = 3e-11

VIEWS = r"""
obs as (
  select event_type as id, ts as "time", event_id, user_id, k,
    round(value * 4) / 4 as temp, round(value * 4) / 4 - (100 - k) / 4.0 as dwpt, cast(k as double) as rhum,
    floor(value) / 8 as prcp, case when k % 3 <> 0 then floor(k / 10.0) / 4 end as snow,
    (k * cast(1.75 as double) + 300) % 360 as wdir, floor(value) / 4 as wspd,
    case when k % 5 <> 0 then floor(value) / 2 end as wpgt, 1000 + k / 4.0 as pres,
    case when k % 4 <> 0 then k / 2.0 end as tsun, 1 + k % 27 as coco
  from (select *, cast(regexp_extract(props, '(\d+)', 1) as int) as k from events)),
obs_user as (select * replace (cast(user_id as varchar) as id) from obs),
hourly as (
  select id, date_trunc('hour', "time") as "time", avg(temp) as temp, avg(dwpt) as dwpt, avg(rhum) as rhum,
    sum(prcp) as prcp, max(snow) as snow,
    (degrees(atan2(avg(sin(radians(wdir))), avg(cos(radians(wdir))))) + 360) % 360 as wdir,
    avg(wspd) as wspd, max(wpgt) as wpgt, avg(pres) as pres, sum(tsun) as tsun, max(coco) as coco
  from obs group by 1, 2),
spine as (
  select id, unnest(generate_series(min("time"), max("time"), interval 1 hour)) as "time" from hourly group by id),
hourly_full as (select * from spine left join hourly using (id, "time")),
series as (select id as unique_id, "time" as ds, temp as y from hourly),
numbered as (
  select *, row_number() over (partition by unique_id order by ds) - 1 as pos,
    count(*) over (partition by unique_id) as n from series),
zones as (
  select 'US-' || r_name || '-' || n_nationkey as zone, r_name as state, n_name, n_nationkey
  from nation join region on n_regionkey = r_regionkey),
load as (
  select n_name as zone, cast(o_orderdate as timestamp) as period,
    cast(sum(cast(o_totalprice as decimal(18, 2))) as double) as value
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2),
price as (
  select n_name as zone, cast(l_shipdate as timestamp) as period,
    floor(cast(sum(cast(l_extendedprice as decimal(18, 2))) * 100 as double) / sum(l_quantity)) / 100 as value
  from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey group by 1, 2),
generation as (
  select n_name as zone, cast(l_shipdate as timestamp) as period, p_type as fueltype, sum(l_quantity) as value
  from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
    join part on l_partkey = p_partkey group by 1, 2, 3),
flows as (
  select a.n_name as from_zone, b.n_name as to_zone, cast(l_shipdate as timestamp) as period, sum(l_quantity) as value
  from lineitem join supplier on l_suppkey = s_suppkey join nation a on s_nationkey = a.n_nationkey
    join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
    join nation b on c_nationkey = b.n_nationkey group by 1, 2, 3),
capacity as (
  select zone, p_type as fuel, cast(sum(p_size) as double) as capacity from (
    select distinct n_name as zone, l_partkey from lineitem join supplier on l_suppkey = s_suppkey
      join nation on s_nationkey = n_nationkey) join part on l_partkey = p_partkey group by 1, 2),
lagged as (
  select unique_id, ds, y, pos, lag(y, 1) over w as naive_1, lag(y, 24) over w as naive_24,
    lag(y, 168) over w as naive_168 from numbered window w as (partition by unique_id order by ds)),
paired as (
  select unique_id, ds, y, cast(1 + pos % 24 as int) as horizon_step, model, yhat from lagged
    unpivot (yhat for model in (naive_1, naive_24, naive_168)))
"""


def sql(body: str, rounded: str = "") -> str:
    """The views, then ``body``; the named columns are rounded as the query's doubles are."""
    body = body.strip()
    if body.lower().startswith("with "):
        body = ",\n" + body[5:]
    if not rounded:
        return f"with {VIEWS.strip()} {body}"
    fixes = ", ".join(f"round({c} + {OFF_TIES}, {DIGITS}) + 0.0 as {c}" for c in rounded.split())
    head, tail = _split_ctes(body)
    return f"with {VIEWS.strip()}{head}, result as ({tail}) select * replace ({fixes}) from result"


def _split_ctes(body: str) -> tuple[str, str]:
    """Leading common tables and the final SELECT, which a line ``---`` separates."""
    if body.startswith(","):
        head, tail = body.split("\n---\n")
        return head, tail
    return "", body


def rounded(df: DataFrame) -> DataFrame:
    doubles = {c: F.round(F.col(c) + OFF_TIES, DIGITS) for c, t in df.dtypes if t == "double"}
    return df.withColumns(doubles) if doubles else df


def query(name: str, oracle: str | None = None, round_columns: str = "", recursive: bool = False):
    """Register ``fn(tables) -> DataFrame``; doubles are rounded so that both sides compare exactly."""
    def register(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return rounded(fn(Tables(spark, folder)))
        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            text = sql(oracle, round_columns).replace("\n---\n", "\n")
            ORACLES[name] = text.replace("with ", "with recursive ", 1) if recursive else text
        return fn
    return register
