"""Weather expressions: directions, units, comfort and sky class."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .timeaxis import as_col


def circular_mean(degrees) -> Column:
    """Aggregate: mean direction in [0, 360), NULL when every input is NULL."""
    rad = F.radians(as_col(degrees))
    return F.pmod(F.degrees(F.atan2(F.avg(F.sin(rad)), F.avg(F.cos(rad)))) + 360.0, F.lit(360.0))


def wind_u(speed, direction) -> Column:
    return -as_col(speed) * F.sin(F.radians(as_col(direction)))


def wind_v(speed, direction) -> Column:
    return -as_col(speed) * F.cos(F.radians(as_col(direction)))


def celsius_to_fahrenheit(c) -> Column:
    return as_col(c) * 9 / 5 + 32


def kmh_to_mph(c) -> Column:
    return as_col(c) * 0.621371


def heat_index(temp_f, humidity) -> Column:
    """National Weather Service heat index in Fahrenheit: simple form below 80, else the regression."""
    t, r = as_col(temp_f), as_col(humidity)
    simple = (t + 61.0 + (t - 68.0) * 1.2 + r * 0.094) * 0.5
    # The published regression coefficients and adjustments.
    full = (
        F.lit(-42.379) + t * 2.04901523 + r * 10.14333127 - t * r * 0.22475541
        - t * t * 0.00683783 - r * r * 0.05481717 + t * t * r * 0.00122874
        + t * r * r * 0.00085282 - t * t * r * r * 0.00000199
    )
    dry = (F.lit(13.0) - r) / 4 * F.sqrt((F.lit(17.0) - F.abs(t - 95.0)) / 17)
    humid = (r - 85.0) / 10 * ((F.lit(87.0) - t) / 5)
    adjusted = (
        F.when((r < 13) & t.between(80, 112), full - dry)
        .when((r > 85) & t.between(80, 87), full + humid)
        .otherwise(full)
    )
    return F.when((simple + t) / 2 < 80, simple).otherwise(adjusted)


def wind_chill(temp_f, speed_mph) -> Column:
    """National Weather Service wind chill in Fahrenheit (2001 formula)."""
    t, v = as_col(temp_f), F.pow(as_col(speed_mph), F.lit(0.16))
    return F.lit(35.74) + t * 0.6215 - v * 35.75 + t * v * 0.4275


def feels_like(temp_f, humidity, speed_mph) -> Column:
    """Heat index from 80 F up, wind chill to 50 F with wind over 3 mph, else the temperature."""
    t = as_col(temp_f)
    return (
        F.when(t >= 80, heat_index(t, humidity))
        .when((t <= 50) & (as_col(speed_mph) > 3), wind_chill(t, speed_mph))
        .otherwise(t)
    )


def sky_class(sunshine_minutes, condition_code) -> Column:
    """Sunny, partly cloudy or cloudy from sunshine per hour, or from the condition code without it.

    Thresholds: 40 and 15 minutes of sun; codes 1-2 clear or fair, 3 partly clouded, above that clouded.
    """
    sun, code = as_col(sunshine_minutes), as_col(condition_code)
    by_sun = F.when(sun >= 40, "sunny").when(sun >= 15, "partly cloudy").otherwise("cloudy")
    by_code = F.when(code <= 2, "sunny").when(code == 3, "partly cloudy").otherwise("cloudy")
    return F.when(sun.isNotNull(), by_sun).when(code.isNotNull(), by_code)
