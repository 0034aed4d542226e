"""Energy questions on long series: load, price, generation, interchange and reserves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timeaxis import hour_of, month_of, truncate
from ..schema import COMPOSITE_STATES, RENEWABLE_FUELS, STATE_PATTERNS
from .blocks import attach


def peak_load(load: DataFrame) -> DataFrame:
    """Highest load per zone and month, and when it was reached (earliest on ties)."""
    best = F.max_by("period", F.struct(F.col("value"), -F.unix_seconds(F.col("period").cast("timestamp"))))
    return load.groupBy("zone", month_of("period").alias("month")).agg(
        F.max("value").alias("peak"), best.alias("peak_at"))


def renewable_share(generation: DataFrame, renewable: Sequence[str] = RENEWABLE_FUELS) -> DataFrame:
    """Renewable and conventional percentages to two places; both 0 where nothing was generated."""
    total = F.sum("value")
    green = F.sum(F.when(F.col("fueltype").isin(*renewable), F.col("value")).otherwise(0.0))
    share = green / total * 100
    return generation.groupBy("zone").agg(
        F.when(total > 0, F.round(share, 2)).otherwise(0.0).alias("renewable"),
        F.when(total > 0, F.round(F.lit(100.0) - share, 2)).otherwise(0.0).alias("conventional"))


def capacity_by_fuel(capacity: DataFrame, zone_states: DataFrame) -> DataFrame:
    """Capacity per zone and fuel over all states of the zone; states are summed first."""
    per_state = capacity.groupBy("state", "fuel").agg(F.sum("capacity").alias("capacity"))
    return per_state.join(zone_states, "state").groupBy("zone", "fuel").agg(F.sum("capacity").alias("capacity"))


def generation_mix(generation: DataFrame, fuels: Sequence[str]) -> DataFrame:
    """One column per fuel, the row total and each fuel's percentage."""
    wide = generation.groupBy("zone", "period").pivot("fueltype", list(fuels)).agg(F.sum("value"))
    wide = wide.na.fill(0.0, list(fuels))
    total = sum((F.col(f) for f in fuels[1:]), F.col(fuels[0]))
    out = wide.withColumn("total", total)
    return out.withColumns({f"{f}_pct": F.when(F.col("total") > 0, F.col(f) / F.col("total") * 100) for f in fuels})


def transfer_capacity(flows: DataFrame, limits: DataFrame) -> DataFrame:
    """Room left on each interface: its limit less the mean flow's size; unknown limits count as 0."""
    mean = flows.groupBy("from_zone", "to_zone").agg(F.avg("value").alias("current_flow"))
    cap = F.coalesce("capacity", F.lit(0.0))
    return mean.join(limits, ["from_zone", "to_zone"], "left").select(
        "from_zone", "to_zone", cap.alias("total_capacity"), "current_flow",
        F.greatest(F.lit(0.0), cap - F.abs("current_flow")).alias("available_capacity"),
        F.when(cap > 0, F.abs("current_flow") / cap * 100).otherwise(0.0).alias("utilization_pct"))


def reserve_margin(capacity: DataFrame, load: DataFrame) -> DataFrame:
    """Total capacity less the latest load, at least 0, also as a share of that load."""
    total = capacity.groupBy("zone").agg(F.sum("capacity").alias("total_capacity"))
    current = load.groupBy("zone").agg(F.max_by("value", "period").alias("current_load"))
    left = F.greatest(F.lit(0.0), F.col("total_capacity") - F.col("current_load"))
    filled = total.join(current, "zone", "full").na.fill(0.0, ["total_capacity", "current_load"])
    return filled.select(
        "zone", "total_capacity", "current_load", left.alias("available_capacity"),
        F.when(F.col("current_load") > 0, left / F.col("current_load") * 100).otherwise(0.0).alias("reserve_margin_pct"))


def reserves(readings: DataFrame, kinds: Sequence[str] = ("SR", "NR")) -> DataFrame:
    """Spinning and non-spinning reserves side by side."""
    return readings.filter(F.col("kind").isin(*kinds)).groupBy("zone", "period").pivot("kind", list(kinds)).agg(
        F.sum("value"))


def history(readings: DataFrame, frequency: str, aggs: Sequence[Column]) -> DataFrame:
    """Price or load history at an hourly, daily or monthly frequency."""
    return readings.groupBy("zone", truncate("period", frequency).alias("period")).agg(*aggs)


def congestion(prices: DataFrame, threshold: float = 10.0) -> DataFrame:
    """Prices further than ``threshold`` from the hour's mean over all zones.

    The mean is aggregated (and so combined map-side) and joined back, not windowed over the hour.
    """
    hourly = prices.withColumn("hour", hour_of("period"))
    mean = hourly.groupBy("hour").agg(F.avg("value").alias("avg_price"))
    return (
        attach(hourly, mean, ["hour"], ["zone"], "inner")
        .withColumn("price_deviation", F.col("value") - F.col("avg_price"))
        .filter(F.abs("price_deviation") > threshold)
        .select("zone", "period", "value", "avg_price", "price_deviation")
    )


def interface_flows(flows: DataFrame) -> DataFrame:
    """Flow per pair and day with the flow the other way and the net."""
    daily = flows.groupBy("from_zone", "to_zone", "period").agg(F.sum("value").alias("flow"))
    low, high = F.least("from_zone", "to_zone"), F.greatest("from_zone", "to_zone")
    # Both directions of a pair meet in one aggregation, so no self-join is needed.
    return daily.filter(F.col("from_zone") != F.col("to_zone")).groupBy(
        low.alias("zone_a"), high.alias("zone_b"), "period"
    ).agg(
        F.coalesce(F.sum(F.when(F.col("from_zone") == low, F.col("flow"))), F.lit(0.0)).alias("a_to_b"),
        F.coalesce(F.sum(F.when(F.col("from_zone") == high, F.col("flow"))), F.lit(0.0)).alias("b_to_a"),
    ).withColumn("net", F.col("a_to_b") - F.col("b_to_a"))


def price_spread(real_time: DataFrame, day_ahead: DataFrame) -> DataFrame:
    """Day-ahead against real-time price; hours known to one side only are kept."""
    rt = real_time.select("zone", "period", F.col("value").alias("real_time"))
    da = day_ahead.select("zone", "period", F.col("value").alias("day_ahead"))
    return rt.join(da, ["zone", "period"], "full").withColumn("spread", F.col("day_ahead") - F.col("real_time"))


def load_forecast_error(actual: DataFrame, forecast: DataFrame) -> DataFrame:
    """Actual load beside each forecast made for it."""
    a = actual.select("zone", "period", F.col("value").alias("actual"))
    joined = a.join(forecast, ["zone", "period"], "inner")
    error = F.col("forecast") - F.col("actual")
    return joined.withColumns({
        "error": error, "abs_error": F.abs(error),
        "pct_error": F.when(F.col("actual") != 0, error / F.col("actual") * 100),
    })


def weather_link(left: DataFrame, right: DataFrame, keys: Sequence[str], x: str, y: str,
                 by: Sequence[str] = ()) -> DataFrame:
    """Correlation of two hourly series joined on their keys."""
    joined = left.join(right, list(keys))
    return joined.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("corr"), F.avg(x).alias(f"avg_{x}"), F.avg(y).alias(f"avg_{y}"))


def state_of(zone: Column) -> Column:
    """State of a zone by prefix: the first matching pattern wins, as in an ordered rule list."""
    out = F.lit(None).cast("string")
    for prefix, state in reversed(STATE_PATTERNS):
        out = F.when(zone.startswith(prefix), F.lit(state)).otherwise(out)
    return out


def match_patterns(zones: DataFrame, zone: str, patterns: Sequence[tuple[str, str]],
                   composites: dict[str, Sequence[str]]) -> DataFrame:
    """Region by first matching prefix, then its constituent states; unmatched zones are left out.

    The rules are constants of the plan, so there is neither a join nor a comparison of all pairs.
    """
    region = F.lit(None).cast("string")
    for prefix, name in reversed(list(patterns)):
        region = F.when(F.col(zone).startswith(prefix), F.lit(name)).otherwise(region)
    states = F.array(F.col("region"))
    for name, parts in composites.items():
        states = F.when(F.col("region") == name, F.array(*[F.lit(p) for p in parts])).otherwise(states)
    return (
        zones.withColumn("region", region).filter(F.col("region").isNotNull())
        .withColumn("state", F.explode(states))
    )


def zone_states(zones: DataFrame, zone: str = "zone") -> DataFrame:
    return match_patterns(zones, zone, STATE_PATTERNS, COMPOSITE_STATES)


def zones_by_state(bridge: DataFrame) -> DataFrame:
    """Zones of each state, sorted, with their count; a zone is listed once."""
    return bridge.select("state", "zone").distinct().groupBy("state").agg(
        F.count(F.lit(1)).alias("n_zones"), F.array_join(F.sort_array(F.collect_list("zone")), ",").alias("zones"))


def zone_lookup(readings: DataFrame, zones: DataFrame, key: str) -> DataFrame:
    """Zone attributes beside readings; only known zones."""
    return attach(readings, zones, [key], ["period"], "inner")


def unknown_zones(readings: DataFrame, zones: DataFrame, key: str) -> DataFrame:
    return readings.select(key).distinct().join(zones, key, "left_anti")


def day_ahead_panel(forecasts: DataFrame, measures: Sequence[str], load: DataFrame, price: DataFrame) -> DataFrame:
    """Forecast measures of each zone and hour beside the load and price forecasts."""
    wide = forecasts.groupBy("zone", "period").pivot("measure", list(measures)).agg(F.first("yhat"))
    return (
        wide.join(load.select("zone", "period", F.col("forecast").alias("load_forecast")), ["zone", "period"], "full")
        .join(price.select("zone", "period", F.col("forecast").alias("price_forecast")), ["zone", "period"], "full")
    )
