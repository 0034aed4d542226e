"""Sources, sinks and cleaning (survey sections 2.1 to 2.3)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.timeaxis import day_of, hour_of, shift
from ..functions.weather import feels_like, sky_class, wind_u, wind_v
from ..operators import clean, grid, rollup, spatial
from ..operators.blocks import time_blocks
from ..schema import MEASURES
from ..session import scratch_path, stage
from ..sinks import merge, tables as files
from ..sources import kinds, readers
from ..sources.driver_tables import Tables
from .catalog import query

M = ", ".join(MEASURES)
LAST_DAY, MIDDLE = "2024-01-21 00:00:00", "2024-01-08 00:00:00"


@query("scan_hourly", f'select id, "time", {M} from obs')
def scan_hourly(t: Tables):
    raw = t.obs().withColumnRenamed("time", "date")
    return clean.nan_to_null(readers.normalise_time(raw)).select("id", "time", *MEASURES)


@query("min_rows_guard", 'select id, "time", temp from obs_user where id in '
       "(select id from obs_user group by id having count(*) >= 2)")
def min_rows_guard(t: Tables):
    return clean.min_rows(t.obs_by_user().select("id", "time", "temp"), ["id"], 2)


@query("range_select_hourly", f"""select id, "time", temp, wdir from hourly
    where "time" between timestamp '{MIDDLE}' and timestamp '{LAST_DAY}'""", "temp wdir")
def range_select_hourly(t: Tables):
    return readers.select_range(t.hourly(MIDDLE, LAST_DAY), "id", "time", None, MIDDLE, LAST_DAY).select("id", "time", "temp", "wdir")


@query("range_select_daily", f"""select id, date_trunc('day', "time") as "day", min(temp) as tmin, max(temp) as tmax,
    avg(temp) as tavg from obs where "time" >= timestamp '{MIDDLE}'
    and "time" < timestamp '{LAST_DAY}' + interval 1 day group by 1, 2""", "tavg")
def range_select_daily(t: Tables):
    daily = rollup.daily_rollup(t.obs().select("id", "time", "temp"), ["id"], "time", False)
    return readers.select_range(daily, "id", "day", None, MIDDLE, LAST_DAY)


@query("list_regions", "select zone, state from zones")
def list_regions(t: Tables):
    return t.zones().select("zone", "state").orderBy("zone")


@query("json_envelope", "select event_id, cast(json_extract(props, '$.k') as int) as k from events")
def json_envelope(t: Tables):
    landed = t.raw("events").select(
        "event_id", F.concat(F.lit('{"response":{"data":['), "props", F.lit("]}}")).alias("payload"))
    return readers.parse_envelope(landed, "payload", "struct<k: int>")


GEO = """
with geo as (
  select n_name as zone, c_custkey, floor(c_acctbal) / 4 as x, c_custkey / 4.0 as y,
    case when c_custkey % 7 = 0 then 'Elsewhere' else 'United States' end as country,
    case when c_custkey % 5 = 0 then 'Polygon' else 'MultiPolygon' end as geometry_type,
    case when c_custkey % 3 = 0 then 10 else 5 end as n_points
  from customer join nation on c_nationkey = n_nationkey)
---
"""


@query("geo_features", GEO.replace("---\n", "") + "select c_custkey, zone, country, geometry_type, n_points from geo")
def geo_features(t: Tables):
    return readers.parse_features(t.geo_lines()).select(
        "c_custkey", "zone", "country", "geometry_type", F.size(F.flatten(F.flatten("coordinates"))).alias("n_points"))


@query("zone_centroid", GEO + """
  select zone, sum(5 * y + 4.0 + case when n_points = 10 then 5 * y + 1.0 else 0 end) / sum(n_points) as lat,
    sum(5 * x + 4.0 + case when n_points = 10 then 5 * x + 1.0 else 0 end) / sum(n_points) as lon,
    cast(sum(n_points) as bigint) as n_points
  from geo where country = 'United States' and geometry_type = 'MultiPolygon' group by 1""", "lat lon")
def zone_centroid(t: Tables):
    return readers.zone_centroids(readers.parse_features(t.geo_lines()))


def _landed(t: Tables):
    """JSON lines of all kinds, with some that do not fit."""
    text = lambda c, unit: F.date_format(c, {"day": "yyyy-MM-dd", "month": "yyyy-MM", "hour": "yyyy-MM-dd\'T\'HH"}[unit])
    def lines(kind, df, **fields):
        return df.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])).alias("payload"))
    zone, value, day = F.col("zone"), F.col("value"), text("period", "day")
    load, price, made = t.staged("load"), t.staged("price"), t.staged("generation")
    month = F.trunc("period", "MM")
    sold = load.groupBy("zone", month.alias("period")).agg(F.max("value").alias("value"), F.count(F.lit(1)).alias("n"))
    every = [
        lines("D", load, respondent=zone, period=day, value=value), lines("DF", load, respondent=zone, period=text(F.date_add("period", 1), "day"), value=value),
        lines("NG", made, respondent=zone, period=day, fueltype=F.col("fueltype"), value=value.cast("string")),
        lines("TI", t.flows(), respondent=F.col("from_zone"), period=text("period", "hour"), fromba=F.col("from_zone"), toba=F.col("to_zone"), value=value),
        lines("SR", made.filter("fueltype = 'ECONOMY'"), respondent=zone, period=day, type=F.lit("spin"), value=value),
        lines("NR", made.filter("fueltype = 'SMALL'"), respondent=zone, period=day, type=F.lit("non-spin"), value=value),
        lines("LMP", price, respondent=zone, period=day, value=value), lines("DAM", price, respondent=zone, period=text(F.date_add("period", 1), "day"), value=value),
        lines("capacity", t.capacity(), stateid=zone, plantprimaryFuel=F.col("fuel"), capacity=F.col("capacity")),
        lines("retail", sold, stateid=zone, period=text("period", "month"), price=value / 4, revenue=value, sales=F.when(F.col("n") > 2, F.col("n"))),
        lines("peak", sold, respondent=zone, period=text("period", "month"), value=value),
        lines("XX", sold, respondent=zone), lines("D", sold, respondent=zone, period=F.lit("soon"), value=value),
        lines("LMP", sold, respondent=zone, period=text("period", "month"), value=F.lit("n/a")), lines("D", sold, period=text("period", "month"), value=value),
        sold.select(F.lit("NG").alias("kind"), F.lit("{").alias("payload")),
    ]
    out = every[0]
    for part in every[1:]:
        out = out.unionByName(part)
    return stage(out, "landed-kinds")


KIND_ROWS = """
with sold as (select zone, date_trunc('month', period) as period, max(value) as value, count(*) as n from load group by 1, 2),
kinds as (
  select 'D' as kind, zone as respondent, period, '' as item, value from load
  union all select 'DF', zone, period + interval 1 day, '', value from load
  union all select 'NG', zone, period, fueltype, value from generation
  union all select 'TI', from_zone, period, from_zone || '>' || to_zone, value from flows
  union all select 'SR', zone, period, 'spin', value from generation where fueltype = 'ECONOMY'
  union all select 'NR', zone, period, 'non-spin', value from generation where fueltype = 'SMALL'
  union all select 'LMP', zone, period, '', value from price
  union all select 'DAM', zone, period + interval 1 day, '', value from price
  union all select 'capacity', zone, null, fuel, capacity from capacity
  union all select 'retail', zone, period, 'price', value / 4 from sold union all select 'retail', zone, period, 'revenue', value from sold
  union all select 'retail', zone, period, 'sales', n from sold where n > 2
  union all select 'peak', zone, period, '', value from sold)
"""


@query("series_by_kind", KIND_ROWS + "---\n  select * from kinds", "value")
def series_by_kind(t: Tables):
    """All rows of all kinds."""
    return kinds.series(kinds.parse(_landed(t)))


@query("series_recent", KIND_ROWS + """,
n as (select max(period) as now from load),
back(kind, hours) as (values ('D', 24), ('DF', 24), ('NG', 24), ('TI', 24), ('SR', 24), ('NR', 24), ('LMP', 72), ('DAM', 24), ('peak', 43800), ('retail', null), ('capacity', null))
---
  select kinds.* from kinds join back using (kind), n where period is null or (period <= now and (hours is null or period >= now - to_hours(hours)))""", "value")
def series_recent(t: Tables):
    """Every kind in its own default range before the latest load."""
    now = t.staged("load").agg(F.max("period")).first()[0]
    return kinds.series(kinds.parse(_landed(t)), now=str(now))


@query("kind_report", KIND_ROWS + """,
m as (select count(*) as n, count(*) filter (n <= 2) as few from sold)
---
  select kind, null as problem, count(*) as n from kinds group by 1 union all select 'XX', 'unknown kind', n from m union all select 'D', 'no period', n from m
  union all select 'LMP', 'no value', n from m union all select 'D', 'no respondent', n from m union all select 'NG', 'broken payload', n from m
  union all select 'retail', 'no value', few from m where few > 0""")
def kind_report(t: Tables):
    return kinds.report(kinds.parse(_landed(t)))


@query("tariff_fallback", """
with first_source as (
  select l_partkey as state, cast(sum(cast(l_extendedprice as decimal(18, 2))) as double) / sum(l_quantity) as rate
  from lineitem where l_returnflag = 'R' group by 1)
---
  select state, rate, 'primary' as source from first_source
  union all select p_partkey, p_retailprice, 'fallback' from part
    where p_partkey not in (select state from first_source)""", "rate")
def tariff_fallback(t: Tables):
    first = t.raw("lineitem").filter(F.col("l_returnflag") == "R").groupBy(F.col("l_partkey").alias("state")).agg(
        (F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double") / F.sum("l_quantity")).alias("rate"))
    second = t.raw("part").select(F.col("p_partkey").alias("state"), F.col("p_retailprice").alias("rate"))
    return readers.with_fallback(first, second, ["state"])


POSITIONS = """
with stations as (select s_suppkey, s_acctbal as rate,
    25 + (s_suppkey * 37 % 1200) / 100.0 as lat, -(75 + (s_suppkey * 91 % 1500) / 100.0) as lon from supplier),
homes as (select c_custkey, 25 + (c_custkey * 53 % 1201) / 100.0 as lat, -(75 + (c_custkey * 71 % 1499) / 100.0) as lon from customer)
"""


@query("tariff_near", POSITIONS + """,
pairs as (select c_custkey, s_suppkey, rate, 2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin((radians(s.lat) - radians(h.lat)) / 2), 2)
    + cos(radians(h.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - h.lon) / 2), 2)))) as km from homes h, stations s)
---
  select c_custkey, s_suppkey, km, cast(row_number() over (partition by c_custkey order by km, s_suppkey) as int) as rank, rate
  from pairs where km <= 40""", "km")
def tariff_near(t: Tables):
    """Tariffs served within 40 km of each customer."""
    lat = lambda key, a, b: (F.lit(25) + (F.col(key) * a % b) / 100).alias("lat")
    lon = lambda key, a, b: (-(F.lit(75) + (F.col(key) * a % b) / 100)).alias("lon")
    rates = t.raw("supplier").select("s_suppkey", F.col("s_acctbal").alias("rate"), lat("s_suppkey", 37, 1200), lon("s_suppkey", 91, 1500))
    homes = t.raw("customer").select("c_custkey", lat("c_custkey", 53, 1201), lon("c_custkey", 71, 1499))
    return readers.tariffs_near(homes, rates, 40.0, "c_custkey", "s_suppkey")


@query("zone_at_point", GEO.replace("---\n", "") + """,
points as (select c_custkey as home, floor(c_acctbal) / 4 + (c_custkey % 9) / 4.0 + 0.125 as lon, c_custkey / 4.0 + (c_custkey % 11) / 4.0 + 0.125 as lat
  from customer)
---
  select distinct home, zone from points join geo on geometry_type = 'MultiPolygon'
    and lon >= x and lon < x + 2 and lat >= y and lat < y + 2
    and not (n_points = 10 and lon < x + 0.5 and lat < y + 0.5)""")
def zone_at_point(t: Tables):
    """Zones of the features that hold a position somewhat off each customer's own."""
    features = readers.parse_features(t.geo_lines()).where("geometry_type = 'MultiPolygon'")
    key = F.col("c_custkey")
    points = t.raw("customer").select(key.alias("home"), (F.floor("c_acctbal") / 4 + (key % 9) / 4 + 0.125).alias("lon"),
                                      (key / 4 + (key % 11) / 4 + 0.125).alias("lat"))
    return spatial.zone_at(points, features, "home")


@query("gen_series", """
with quarter as (
  select id as unique_id, unnest(generate_series(min("time"), max("time"), interval 15 minute)) as ds
  from hourly group by id),
stepped as (select *, cast(epoch(ds) as bigint) // 900 as i from quarter),
hashed as (select *, md5('42|' || unique_id || '|' || i) as h from stepped),
even as (select *, (cast(('0x' || substr(h, 1, 8)) as ubigint) + 0.5::double) / 4294967296 as u,
  (cast(('0x' || substr(h, 9, 8)) as ubigint) + 0.5::double) / 4294967296 as v from hashed)
---
  select unique_id, ds, 20 + 5 * sqrt(-2 * ln(u)) * cos(2 * pi() * v) + 10 * sin(2 * pi() * (i % 96) / 96) + 5 * sin(2 * pi() * (i % 672) / 672) as y
  from even""", "y")
def gen_series(t: Tables):
    bounds = t.hourly().groupBy(F.col("id").alias("unique_id")).agg(F.min("time").alias("a"), F.max("time").alias("b"))
    return readers.synthetic_series(grid.time_spine(bounds, ["unique_id"], "a", "b", "ds", 900))


@query("history_lookup", """
with facts as (select id, count(*) as n, avg(temp) as mean_temp, max("time") as last from hourly group by 1)
---
  select h.id, h."time", h.temp, n, mean_temp, last from hourly h join facts using (id)""", "temp mean_temp")
def history_lookup(t: Tables):
    """Stored history beside a fact row per region, both in buckets of the region: the join moves no rows."""
    hourly = t.staged("hourly").select("id", "time", "temp")
    facts = hourly.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.avg("temp").alias("mean_temp"), F.max("time").alias("last"))
    history = files.write_lookup(hourly, scratch_path(t.spark, "lookup-history"), "id", "time", 8)
    return history.join(files.write_lookup(facts, scratch_path(t.spark, "lookup-facts"), "id", "last", 8).hint("merge"), "id")


# Sinks -----------------------------------------------------------------------------------------


@query("upsert_region", """
with writes as (
  select n_name as region_name, cast(n_nationkey as double) as lat, cast(-n_nationkey as double) as lon, -1 as seq
  from nation
  union all select n_name, s_acctbal, cast(s_suppkey as double), s_suppkey
  from supplier join nation on s_nationkey = n_nationkey)
---
  select region_name, arg_max(lat, seq) as lat, arg_max(lon, seq) as lon from writes group by 1""", "lat")
def upsert_region(t: Tables):
    n = t.raw("nation")
    stored = n.select(F.col("n_name").alias("region_name"), F.col("n_nationkey").cast("double").alias("lat"),
                      (-F.col("n_nationkey")).cast("double").alias("lon"))
    incoming = t.raw("supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("region_name"), F.col("s_acctbal").alias("lat"),
        F.col("s_suppkey").cast("double").alias("lon"), "s_suppkey")
    return merge.upsert(stored, incoming, ["region_name"], "s_suppkey")


@query("upsert_hourly", """
with last_write as (
  select id, date_trunc('hour', "time") as "time", arg_max(temp, event_id) as temp, arg_max(rhum, event_id) as rhum
  from obs group by 1, 2)
---
  select h.id, h."time", coalesce(w.temp, h.temp) as temp, coalesce(w.rhum, h.rhum) as rhum
  from hourly_full h left join last_write w on h.id = w.id and h."time" = w."time" """, "temp rhum")
def upsert_hourly(t: Tables):
    stored = t.hourly_full().select("id", "time", "temp", "rhum")
    incoming = t.obs().select("id", hour_of("time").alias("time"), "temp", "rhum", "event_id")
    return merge.upsert(stored, incoming, ["id", "time"], "event_id")


@query("upsert_daily", """select id, date_trunc('day', "time") as "day", arg_max(temp, event_id) as tmin,
    arg_max(temp, event_id) as tmax, arg_max(temp, event_id) as tavg from obs group by 1, 2""")
def upsert_daily(t: Tables):
    stored = rollup.daily_rollup(t.obs().select("id", "time", "temp"), ["id"], "time", False)
    incoming = t.obs().select("id", day_of("time").alias("day"), F.col("temp").alias("tmin"),
                              F.col("temp").alias("tmax"), F.col("temp").alias("tavg"), "event_id")
    return merge.upsert(stored, incoming, ["id", "day"], "event_id")


@query("insert_if_absent", """
with stored as (select o_custkey as id, min(o_totalprice) as lat from orders group by 1)
---
  select id, lat from stored
  union all select c_custkey, c_acctbal from customer where c_custkey not in (select id from stored)""", "lat")
def insert_if_absent(t: Tables):
    stored = t.raw("orders").groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_totalprice").alias("lat"))
    incoming = t.raw("customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("lat"), F.lit(1).alias("seq"))
    return merge.insert_if_absent(stored, incoming, ["id"], "seq").select("id", "lat")


@query("append_history_dedup", 'select id, "time", temp from obs')
def append_history_dedup(t: Tables):
    history = t.obs().select("id", "time", "temp")
    stored = history.filter(F.col("time") <= F.lit(MIDDLE).cast("timestamp_ntz"))
    starts = stored.groupBy("id").agg(F.max("time").alias("start"))
    # The fetch begins at the last stored reading, which is therefore delivered twice.
    fetched = history.join(starts, "id", "left").filter(
        F.col("start").isNull() | (F.col("time") >= F.col("start"))).drop("start")
    return merge.append_deduplicated(stored, fetched, ["id", "time"])


@query("replace_forecasts", """
  select unique_id as region_id, model as model_type, ds as "timestamp", case when model = 'naive_24' then y else yhat end
    as predicted_value from paired""", "predicted_value")
def replace_forecasts(t: Tables):
    paired = t.staged("paired")
    stored = paired.select(
        F.col("unique_id").alias("region_id"), F.col("model").alias("model_type"), F.col("ds").alias("timestamp"),
        F.col("yhat").alias("predicted_value"))
    rerun = paired.filter(F.col("model") == "naive_24").select(
        F.col("unique_id").alias("region_id"), F.col("model").alias("model_type"), F.col("ds").alias("timestamp"),
        F.col("y").alias("predicted_value"))
    return merge.replace_groups(stored, rerun, ["region_id", "model_type"])


@query("replace_metrics", """
with stored as (select unique_id as region_id, model as model_type, avg(abs(yhat - y)) as mae, count(*) as rows
  from paired group by 1, 2)
---
  select region_id, model_type, case when model_type = 'naive_1' then 'rows' else 'mae' end as metric_name,
    case when model_type = 'naive_1' then rows else mae end as metric_value from stored""", "metric_value")
def replace_metrics(t: Tables):
    keys = [F.col("unique_id").alias("region_id"), F.col("model").alias("model_type")]
    p = t.staged("paired")
    stored = p.groupBy(*keys).agg(F.avg(F.abs(F.col("yhat") - F.col("y"))).alias("metric_value")).withColumn(
        "metric_name", F.lit("mae"))
    rerun = p.filter(F.col("model") == "naive_1").groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("metric_value")).withColumn("metric_name", F.lit("rows"))
    return merge.replace_groups(stored, rerun, ["region_id", "model_type"])


@query("export_csv", """
  select 'regions' as name, count(*) as n_rows, cast(sum(n_nationkey) as double) as total from zones
  union all select 'history', count(*), sum(temp) from obs
  union all select 'forecasts', count(*), sum(yhat) from paired
  union all select 'metrics', count(*), sum(mae) from (
    select unique_id, model, avg(abs(yhat - y)) as mae from paired group by 1, 2)""", "total")
def export_csv(t: Tables):
    """Four tables to CSV, read back and summed."""
    metrics = t.staged("paired").groupBy("unique_id", "model").agg(F.avg(F.abs(F.col("yhat") - F.col("y"))).alias("mae"))
    parts = {
        "regions": (t.zones().select("zone", "n_nationkey"), "n_nationkey"),
        "history": (t.obs().select("id", "time", "temp"), "temp"),
        "forecasts": (t.staged("paired").select("unique_id", "ds", "model", "yhat"), "yhat"),
        "metrics": (metrics, "mae"),
    }
    paths = files.export_csv({n: df for n, (df, _) in parts.items()}, scratch_path(t.spark, "export"))
    out = None
    for name, (df, column) in parts.items():
        back = files.read_csv(t.spark, paths[name], T.StructType(df.schema.fields)).agg(
            F.lit(name).alias("name"), F.count(F.lit(1)).alias("n_rows"), F.sum(column).cast("double").alias("total"))
        out = back if out is None else out.unionByName(back)
    return out


@query("history_layout", f"""select id, "time", temp from obs
    where "time" between timestamp '{MIDDLE}' and timestamp '{LAST_DAY}'""")
def history_layout(t: Tables):
    """Written by date, then read back for a time range: other dates are pruned."""
    path = scratch_path(t.spark, "history")
    history = t.obs().select("id", "time", "temp")
    files.write_history(history, path, "id", "time")
    return files.select_dates(files.read_history(t.spark, path, history.schema), "time", MIDDLE, LAST_DAY)


ROLLED = """select id, date_trunc('day', "time") as "day", sum(prcp) as prcp, min(temp) as tmin, max(temp) as tmax,
    avg(temp) as tavg from obs group by 1, 2"""


@query("incremental_rollup", ROLLED, "tavg")
def incremental_rollup(t: Tables):
    every = t.obs().select("id", "time", "temp", "prcp", "k")
    late = F.col("k") >= 98
    def roll(df):
        return rollup.daily_rollup(df.select("id", "time", "temp", "prcp"), ["id"], "time", False)
    return merge.incremental_rollup(roll(every.filter(~late)), every, every.filter(late), ["id"], "time", roll)


@query("retention", """select id, "time", temp from obs
    where "time" >= (select max("time") from obs) - interval 14 day""")
def retention(t: Tables):
    return merge.retain(t.obs().select("id", "time", "temp"), "time", 14)


# Cleaning --------------------------------------------------------------------------------------


@query("drop_all_null", """select id, "time", temp, wpgt from hourly_full
    where coalesce(temp, rhum, wspd, wpgt) is not null""", "temp")
def drop_all_null(t: Tables):
    return clean.drop_all_null(t.hourly_full().select("id", "time", "temp", "rhum", "wspd", "wpgt")).select(
        "id", "time", "temp", "wpgt")


FILL = ["temp", "wpgt", "snow", "tsun"]


@query("ffill", "select id, \"time\", " + ", ".join(
    f'last_value({c} ignore nulls) over w as {c}' for c in FILL)
    + ' from hourly_full window w as (partition by id order by "time" rows unbounded preceding)', "temp")
def ffill(t: Tables):
    return clean.fill(t.hourly_full().select("id", "time", *FILL), ["id"], "time", FILL)


@query("ffill_bfill", "with forward as (select id, \"time\", " + ", ".join(
    f'last_value({c} ignore nulls) over w as {c}' for c in FILL)
    + """ from (select cast(user_id as varchar) as id, date_trunc('hour', "time") as "time", avg(temp) as temp,
        max(wpgt) as wpgt, max(snow) as snow, max(tsun) as tsun from obs group by 1, 2)
    window w as (partition by id order by "time" rows unbounded preceding))
---
 select id, "time", """ + ", ".join(
    f'coalesce({c}, first_value({c} ignore nulls) over w) as {c}' for c in FILL)
    + ' from forward window w as (partition by id order by "time" rows between current row and unbounded following)',
    "temp")
def ffill_bfill(t: Tables):
    hourly = t.obs_by_user().groupBy("id", hour_of("time").alias("time")).agg(
        F.avg("temp").alias("temp"), *[F.max(c).alias(c) for c in FILL[1:]])
    return clean.fill(hourly, ["id"], "time", FILL, True, True)


@query("impute_snow", """
  select o.event_id, cast(n.zone as varchar) as zone, o."time", case
    when starts_with(n.zone, 'US-FLA') or starts_with(n.zone, 'US-SE') or starts_with(n.zone, 'US-CAR')
      then coalesce(snow, 0) when month(o."time") between 5 and 9 then 0 else snow end as snow
  from (select event_id, snow, user_id, "time" + interval (user_id % 12 * 30) day as "time" from obs) o
  join (select case when n_nationkey % 5 = 0 then 'US-FLA-' || n_nationkey when n_nationkey % 5 = 1
    then 'US-SE-' || n_nationkey else zone end as zone, n_nationkey from zones) n
  on o.user_id % 25 = n.n_nationkey""")
def impute_snow(t: Tables):
    key = F.col("n_nationkey")
    zones = t.zones().select("n_nationkey", F.when(key % 5 == 0, F.concat(F.lit("US-FLA-"), key)).when(
        key % 5 == 1, F.concat(F.lit("US-SE-"), key)).otherwise(F.col("zone")).alias("zone"))
    # Readings are spread over the year so that summers occur.
    moved = t.obs().select("event_id", "snow", (F.col("user_id") % 25).cast("int").alias("n_nationkey"),
                           shift("time", F.col("user_id") % 12 * 30 * 86400).alias("time"))
    joined = moved.join(zones, "n_nationkey").drop("n_nationkey")
    return clean.impute_snow(joined, "zone", "time").select("event_id", "zone", "time", "snow")


@query("impute_gust", "select event_id, coalesce(wpgt, wspd * 1.5) as wpgt from obs", "wpgt")
def impute_gust(t: Tables):
    return clean.impute_gust(t.obs()).select("event_id", "wpgt")


@query("impute_sun", """select event_id, case when hour("time") < 6 or hour("time") > 18 then 0
    else coalesce(tsun, (1 - coco / 100.0) * 60) end as tsun from obs""", "tsun")
def impute_sun(t: Tables):
    return clean.impute_sun(t.obs(), "time").select("event_id", "tsun")


@query("unit_convert", "select event_id, temp * 9 / 5 + 32 as temp_f, wspd * 0.621371 as wspd_mph from obs",
       "temp_f wspd_mph")
def unit_convert(t: Tables):
    return clean.add_units(t.obs()).select("event_id", "temp_f", "wspd_mph")


@query("zscore", """
with stats as (select id, avg(temp) as m, stddev_samp(temp) as s, avg(rhum) as mr, stddev_samp(rhum) as sr from obs group by 1)
---
  select event_id, (temp - m) / s as temp_z, (rhum - mr) / sr as rhum_z from obs join stats using (id)""", "temp_z rhum_z")
def zscore(t: Tables):
    return clean.zscore(t.obs().select("id", "event_id", "temp", "rhum"), ["id"], ["temp", "rhum"], ["event_id"]).select(
        "event_id", "temp_z", "rhum_z")


@query("minmax_scale", """
with stats as (select id, min(temp) as lo, max(temp) - min(temp) as span from obs group by 1)
---
  select event_id, (temp - lo) / span as scaled, temp as restored from obs join stats using (id)""", "scaled")
def minmax_scale(t: Tables):
    scaled = clean.minmax_scale(t.obs().select("id", "event_id", "temp"), ["id"], "temp", ["event_id"])
    return clean.minmax_restore(scaled, "scaled", "restored").select("event_id", "scaled", "restored")


@query("standard_scale", """
with stats as (select id, avg(wspd) as m, stddev_pop(wspd) as s from obs group by 1)
---
  select event_id, (wspd - m) / case when s = 0 then 1 else s end as wspd_std from obs join stats using (id)""", "wspd_std")
def standard_scale(t: Tables):
    return clean.standard_scale(t.obs().select("id", "event_id", "wspd"), ["id"], ["wspd"], ["event_id"]).select(
        "event_id", "wspd_std")


@query("log_transform", "select unique_id, ds, case when y > 20 then ln(y - 20) end as log_y from series", "log_y")
def log_transform(t: Tables):
    return clean.log_transform(t.series().withColumn("y", F.col("y") - 20), "y").select("unique_id", "ds", "log_y")


TZ = {"AFRICA": "Africa/Lagos", "AMERICA": "America/New_York", "ASIA": "Asia/Tokyo",
      "EUROPE": "Europe/Berlin", "MIDDLE EAST": "Asia/Dubai"}


@query("local_time", """
with tz as (select r_regionkey, case r_name when 'AFRICA' then 'Africa/Lagos' when 'AMERICA' then 'America/New_York'
  when 'ASIA' then 'Asia/Tokyo' when 'EUROPE' then 'Europe/Berlin' else 'Asia/Dubai' end as tz from region)
---
  select event_id, tz, timezone(tz, timezone('UTC', "time")) as local_time
  from obs join tz on user_id % 5 = r_regionkey""")
def local_time(t: Tables):
    tz = F.create_map(*[F.lit(x) for pair in TZ.items() for x in pair])
    zones = t.raw("region").select(F.col("r_regionkey").cast("bigint").alias("r"), tz[F.col("r_name")].alias("tz"))
    joined = t.obs().withColumn("r", F.col("user_id") % 5).join(zones, "r")
    return clean.local_time(joined, "time", "tz").select("event_id", "tz", "local_time")


@query("validate_series", """
  select unique_id, count(*) as n_rows, count(*) filter (y is null) as n_null, cast(0 as bigint) as n_not_finite,
    count(*) - count(distinct ds) as n_duplicate_ds
  from (select id as unique_id, "time" as ds, wpgt as y from hourly_full) group by 1""")
def validate_series(t: Tables):
    return clean.validate_series(t.hourly_full().select(
        F.col("id").alias("unique_id"), F.col("time").alias("ds"), F.col("wpgt").alias("y")))


@query("feels_like", """
with f as (select event_id, temp as t, rhum as r, wspd * 0.621371 as v from obs),
g as (select *, 0.5 * (t + 61.0 + (t - 68.0) * 1.2 + r * 0.094) as easy,
  -42.379 + 2.04901523 * t + 10.14333127 * r - 0.22475541 * t * r - 0.00683783 * t * t - 0.05481717 * r * r
  + 0.00122874 * t * t * r + 0.00085282 * t * r * r - 0.00000199 * t * t * r * r as hot from f)
---
  select event_id, case
    when t >= 80 and (easy + t) / 2 < 80 then easy
    when t >= 80 and r < 13 and t <= 112 then hot - (13 - r) / 4 * sqrt((17 - abs(t - 95)) / 17)
    when t >= 80 and r > 85 and t <= 87 then hot + (r - 85) / 10 * ((87 - t) / 5)
    when t >= 80 then hot
    when t <= 50 and v > 3 then 35.74 + 0.6215 * t - 35.75 * pow(v, 0.16) + 0.4275 * t * pow(v, 0.16)
    else t end as feels from g""", "feels")
def feels(t: Tables):
    return t.obs().select("event_id", feels_like("temp", "rhum", F.col("wspd") * 0.621371).alias("feels"))


@query("sky_class", """select event_id, case when tsun >= 40 or (tsun is null and coco <= 2) then 'sunny'
    when tsun >= 15 or (tsun is null and coco = 3) then 'partly cloudy' else 'cloudy' end as sky from obs""")
def sky(t: Tables):
    return t.obs().select("event_id", sky_class("tsun", "coco").alias("sky"))


@query("recent_precip", """
with summed as (select id, "time", sum(prcp) over (partition by id order by "time"
    range between interval 86399 second preceding and current row) as prcp_24h from hourly)
---
  select * from summed where prcp_24h >= 100""", "prcp_24h")
def recent_precip(t: Tables):
    trailing = time_blocks(
        t.hourly().select("id", "time", "prcp"), ["id"], "time",
        lambda w: {"prcp_24h": F.sum("prcp").over(w.rangeBetween(-86399, 0))}, 86400)
    return trailing.filter(F.col("prcp_24h") >= 100).select("id", "time", "prcp_24h")


@query("to_long", """
with long as (
  select id || '/temp' as unique_id, "time" as ds, temp as y from hourly_full union all
  select id || '/wdir', "time", wdir from hourly_full union all
  select id || '/wpgt', "time", wpgt from hourly_full)
---
  select * from long where y is not null""", "y")
def to_long(t: Tables):
    return clean.to_long(t.hourly_full(), "id", "time", ["temp", "wdir", "wpgt"])


@query("wind_components", "select event_id, -wspd * sin(radians(wdir)) as u, -wspd * cos(radians(wdir)) as v from obs",
       "u v")
def wind_components(t: Tables):
    return t.obs().select("event_id", wind_u("wspd", "wdir").alias("u"), wind_v("wspd", "wdir").alias("v"))
