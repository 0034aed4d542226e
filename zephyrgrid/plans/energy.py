"""Energy questions and joins (survey sections 2.5 to 2.7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.timeaxis import day_of, shift
from ..operators import energy
from ..sources.driver_tables import FUELS, RENEWABLE, Tables
from .catalog import query

# Prefix rules over the fixture's zones: the first one hides the more specific second one.
PATTERNS = [("US-ASIA-", "Far East"), ("US-ASIA-1", "never reached"), ("US-EUROPE-2", "Coast"),
            ("US-EUROPE-", "Continent"), ("US-A", "Atlantic")]
COMPOSITES = {"Far East": ["East", "South East"], "Atlantic": ["North", "Middle", "South"]}
REGION_SQL = """case when starts_with(zone, 'US-ASIA-') then 'Far East' when starts_with(zone, 'US-EUROPE-2') then 'Coast'
  when starts_with(zone, 'US-EUROPE-') then 'Continent' when starts_with(zone, 'US-A') then 'Atlantic' end"""
BRIDGE = f"""matched as (select zone, n_name, {REGION_SQL} as region from zones),
bridge as (select zone, n_name, region, unnest(case region when 'Far East' then ['East', 'South East']
  when 'Atlantic' then ['North', 'Middle', 'South'] else [region] end) as state from matched where region is not null)"""


def _bridge(t: Tables):
    return energy.match_patterns(t.zones().select("zone", "n_name"), "zone", PATTERNS, COMPOSITES)


@query("peak_load", """
with monthly as (select *, date_trunc('month', period) as "month" from load)
---
  select zone, "month", max(value) as peak, arg_max(period, (value, -epoch(period))) as peak_at from monthly group by 1, 2""")
def peak_load(t: Tables):
    return energy.peak_load(t.load())


@query("renewable_share", """
with s as (select zone, sum(value) as total, sum(case when fueltype in ('ECONOMY', 'SMALL') then value else 0 end) as g
  from generation group by 1)
---
  select zone, round(g / total * 100, 2) as renewable, round(100 - g / total * 100, 2) as conventional from s""")
def renewable_share(t: Tables):
    return energy.renewable_share(t.generation(), RENEWABLE)


@query("capacity_by_fuel", f"""with {BRIDGE}
---
  select b.zone, c.fuel, sum(c.capacity) as capacity from capacity c
  join (select n_name as cap_zone, state from bridge) s on c.zone = s.cap_zone
  join bridge b on b.state = s.state group by 1, 2""")
def capacity_by_fuel(t: Tables):
    """A zone's states come from the prefix rules; a state's capacity is that of its nations."""
    bridge = _bridge(t)
    by_state = t.capacity().join(bridge.select(F.col("n_name").alias("zone"), "state"), "zone").select(
        "state", "fuel", "capacity")
    return energy.capacity_by_fuel(by_state, bridge.select("zone", "state"))


@query("generation_mix", """
with wide as (select zone, period, """ + ", ".join(
    f"coalesce(sum(value) filter (fueltype = '{f}'), 0) as {f}" for f in FUELS)
    + ", sum(value) as total from generation group by 1, 2)\n---\n select *, "
    + ", ".join(f"{f} / total * 100 as {f}_pct" for f in FUELS) + " from wide",
    " ".join(f"{f}_pct" for f in FUELS))
def generation_mix(t: Tables):
    return energy.generation_mix(t.generation(), FUELS)



@query("transfer_capacity", """
with limits as (select a.n_name as from_zone, b.n_name as to_zone, cast(20 + a.n_nationkey as double) as capacity
  from nation a join nation b on a.n_regionkey = b.n_regionkey),
mean as (select from_zone, to_zone, avg(value) as current_flow from flows group by 1, 2)
---
  select from_zone, to_zone, coalesce(capacity, 0) as total_capacity, current_flow,
    greatest(0, coalesce(capacity, 0) - abs(current_flow)) as available_capacity,
    case when capacity > 0 then abs(current_flow) / capacity * 100 else 0 end as utilization_pct
  from mean left join limits using (from_zone, to_zone)""", "current_flow available_capacity utilization_pct")
def transfer_capacity(t: Tables):
    n = t.raw("nation")
    a = n.select(F.col("n_name").alias("from_zone"), "n_regionkey", (F.col("n_nationkey") + 20).cast("double").alias("capacity"))
    b = n.select(F.col("n_name").alias("to_zone"), "n_regionkey")
    return energy.transfer_capacity(t.flows(), a.join(b, "n_regionkey").select("from_zone", "to_zone", "capacity"))


@query("reserve_margin", """
with total as (select zone, sum(capacity) * 10 as total_capacity from capacity group by 1),
current as (select zone, arg_max(value, period) as current_load from load group by 1)
---
  select zone, coalesce(total_capacity, 0) as total_capacity, coalesce(current_load, 0) as current_load,
    greatest(0, coalesce(total_capacity, 0) - coalesce(current_load, 0)) as available_capacity,
    case when current_load > 0 then greatest(0, coalesce(total_capacity, 0) - current_load) / current_load * 100 else 0 end
      as reserve_margin_pct
  from total full join current using (zone)""", "available_capacity reserve_margin_pct")
def reserve_margin(t: Tables):
    return energy.reserve_margin(t.capacity().withColumn("capacity", F.col("capacity") * 10), t.load())


@query("reserves", """
  select n_name as zone, cast(l_shipdate as timestamp) as period, sum(l_quantity) filter (l_linestatus = 'O') as SR,
    sum(l_quantity) filter (l_linestatus = 'F') as NR
  from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey group by 1, 2""")
def reserves(t: Tables):
    kind = F.when(F.col("l_linestatus") == "O", "SR").otherwise("NR")
    return energy.reserves(t.sales().select("zone", "period", kind.alias("kind"), F.col("l_quantity").alias("value")))


@query("zones_by_state", f"""with {BRIDGE}
---
  select state, count(distinct zone) as n_zones, string_agg(distinct zone, ',' order by zone) as zones from bridge group by 1""")
def zones_by_state(t: Tables):
    return energy.zones_by_state(_bridge(t))


@query("prefix_match", f"with {BRIDGE}\n---\n select zone, region, state from bridge")
def prefix_match(t: Tables):
    return _bridge(t).select("zone", "region", "state")


@query("price_trend", """
  select n_name as zone, date_trunc('month', l_shipdate) as period,
    cast(sum(cast(l_extendedprice as decimal(18, 2))) as double) as revenue, sum(l_quantity) as sales,
    cast(sum(cast(l_extendedprice as decimal(18, 2))) as double) / sum(l_quantity) as price
  from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey group by 1, 2""", "price")
def price_trend(t: Tables):
    revenue, sales = F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double"), F.sum("l_quantity")
    return energy.history(t.sales(), "monthly", [
        revenue.alias("revenue"), sales.alias("sales"), (revenue / sales).alias("price")])


@query("load_history", """select zone, date_trunc('month', period) as period, max(value) as peak,
    cast(sum(cast(value as decimal(18, 2))) as double) / count(*) as value from load group by 1, 2""", "value")
def load_history(t: Tables):
    return energy.history(t.load(), "monthly", [
        F.max("value").alias("peak"),
        (F.sum(F.col("value").cast("decimal(18,2)")).cast("double") / F.count("value")).alias("value")])


@query("congestion", """
with mean as (select date_trunc('hour', period) as hour, avg(value) as avg_price from price group by 1)
---
  select zone, period, value, avg_price, value - avg_price as price_deviation from price
  join mean on date_trunc('hour', period) = hour where abs(value - avg_price) > 10""", "value avg_price price_deviation")
def congestion(t: Tables):
    return energy.congestion(t.staged("price"))


@query("latest_per_zone", """select id, arg_max(temp, ("time", event_id)) as temp, arg_max(wspd, ("time", event_id)) as wspd,
    max("time") as "time" from obs_user group by 1""")
def latest_per_zone(t: Tables):
    newest = F.max_by(F.struct("time", "temp", "wspd"), F.struct("time", "event_id")).alias("r")
    return t.obs_by_user().groupBy("id").agg(newest).select("id", "r.*")


@query("zone_lookup", """select zone, state, period, value from load join zones z(zone2, state, zone, k) using (zone)""", "value")
def zone_lookup(t: Tables):
    zones = t.zones().select(F.col("n_name").alias("zone"), "state")
    return energy.zone_lookup(t.load(), zones, "zone").select("zone", "state", "period", "value")


@query("zone_unknown", """select distinct id as zone from obs_user where cast(id as bigint) not in
  (select s_suppkey from supplier)""")
def zone_unknown(t: Tables):
    known = t.raw("supplier").select(F.col("s_suppkey").cast("string").alias("zone"))
    return energy.unknown_zones(t.obs_by_user().withColumnRenamed("id", "zone"), known, "zone")


@query("temp_load_corr", """
with temps as (select ("day" % 30) as slot, temp from (select cast(day("time") as bigint) - 1 as "day", avg(temp) as temp
  from obs group by 1)),
loads as (select date_diff('day', date '1995-01-01', cast(period as date)) % 30 as slot,
  cast(sum(cast(value as decimal(18, 2))) as double) as load from load group by 1)
---
  select count(*) as n, corr(temp, load) as corr, avg(temp) as avg_temp, avg(load) as avg_load
  from temps join loads using (slot)""", "corr avg_temp avg_load")
def temp_load_corr(t: Tables):
    """Days of the two fixtures do not meet, so both are folded on a cycle of thirty days."""
    temps = t.obs().groupBy((F.dayofmonth("time") - 1).cast("bigint").alias("slot")).agg(F.avg("temp").alias("temp"))
    slot = (F.datediff(F.col("period").cast("date"), F.lit("1995-01-01").cast("date")) % 30).cast("bigint")
    loads = t.load().groupBy(slot.alias("slot")).agg(
        F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("load"))
    return energy.weather_link(temps, loads, ["slot"], "temp", "load")


@query("renewable_weather", """
with w as (select day("time") - 1 as slot, avg(wspd) as wspd from obs group by 1),
g as (select date_diff('day', date '1995-01-01', cast(period as date)) % 30 as slot, fueltype, sum(value) as output
  from generation where fueltype in ('ECONOMY', 'SMALL') group by 1, 2)
---
  select fueltype, count(*) as n, corr(wspd, output) as corr, avg(wspd) as avg_wspd, avg(output) as avg_output
  from w join g using (slot) group by 1""", "corr avg_wspd avg_output")
def renewable_weather(t: Tables):
    wind = t.obs().groupBy((F.dayofmonth("time") - 1).alias("slot")).agg(F.avg("wspd").alias("wspd"))
    slot = F.datediff(F.col("period").cast("date"), F.lit("1995-01-01").cast("date")) % 30
    green = t.generation().filter(F.col("fueltype").isin(*RENEWABLE)).groupBy(slot.alias("slot"), "fueltype").agg(
        F.sum("value").alias("output"))
    return energy.weather_link(wind, green, ["slot"], "wspd", "output", ["fueltype"])


@query("dam_rt_spread", """
with ahead as (select zone, period + interval 1 day as period, value as day_ahead from price)
---
  select zone, period, value as real_time, day_ahead, day_ahead - value as spread
  from price full join ahead using (zone, period)""", "real_time day_ahead spread")
def dam_rt_spread(t: Tables):
    """The day-ahead price is the price of the day before."""
    price = t.staged("price")
    return energy.price_spread(price, price.withColumn("period", shift("period", 86400)))


def _load_forecasts(t: Tables):
    load = t.staged("load")
    day = load.select("zone", shift("period", 86400).alias("period"), F.col("value").alias("forecast"), F.lit("day").alias("ahead"))
    week = load.select("zone", shift("period", 7 * 86400).alias("period"), F.col("value").alias("forecast"), F.lit("week").alias("ahead"))
    return day.unionByName(week)


@query("load_forecast_error", """
with f as (select zone, period + interval 1 day as period, value as forecast, 'day' as ahead from load
  union all select zone, period + interval 7 day, value, 'week' from load)
---
  select zone, period, value as actual, forecast, ahead, forecast - value as error, abs(forecast - value) as abs_error,
    (forecast - value) / value * 100 as pct_error from load join f using (zone, period)""",
       "actual forecast error abs_error pct_error")
def load_forecast_error(t: Tables):
    return energy.load_forecast_error(t.staged("load"), _load_forecasts(t))


@query("interface_flows", """
with pairs as (select least(from_zone, to_zone) as zone_a, greatest(from_zone, to_zone) as zone_b, period,
  coalesce(sum(value) filter (from_zone < to_zone), 0) as a_to_b, coalesce(sum(value) filter (from_zone > to_zone), 0) as b_to_a
  from flows where from_zone <> to_zone group by 1, 2, 3)
---
  select *, a_to_b - b_to_a as net from pairs""")
def interface_flows(t: Tables):
    return energy.interface_flows(t.flows())


@query("day_ahead_panel", """
with weather as (select n_name as zone, "day" + interval 1 day as period, tmin, tavg, tmax, wspd from
  (select n_nationkey, date_trunc('day', "time") as "day", min(temp) as tmin, avg(temp) as tavg, max(temp) as tmax,
    avg(wspd) as wspd from obs join nation on user_id % 25 = n_nationkey group by 1, 2) join nation using (n_nationkey)),
l as (select zone, period + interval 1 day as period, value as load_forecast from load),
p as (select zone, period + interval 1 day as period, value as price_forecast from price)
---
  select zone, period, tmin, tavg, tmax, wspd, load_forecast, price_forecast
  from weather full join l using (zone, period) full join p using (zone, period)""",
       "tavg wspd load_forecast price_forecast")
def day_ahead_panel(t: Tables):
    """Day-ahead forecasts by persistence: tomorrow is like today."""
    n = t.raw("nation").select(F.col("n_nationkey").cast("bigint").alias("k"), F.col("n_name").alias("zone"))
    daily = t.obs().withColumn("k", F.col("user_id") % 25).join(n, "k").groupBy("zone", day_of("time").alias("day")).agg(
        F.min("temp").alias("tmin"), F.avg("temp").alias("tavg"), F.max("temp").alias("tmax"), F.avg("wspd").alias("wspd"))
    measures = ["tmin", "tavg", "tmax", "wspd"]
    forecasts = daily.select("zone", shift("day", 86400).alias("period"), *measures).unpivot(
        ["zone", "period"], measures, "measure", "yhat")

    def ahead(df):
        return df.select("zone", shift("period", 86400).alias("period"), F.col("value").alias("forecast"))

    return energy.day_ahead_panel(forecasts, measures, ahead(t.load()), ahead(t.price()))
