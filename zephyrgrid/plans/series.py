"""Window features, series statistics, metrics and combinations (survey sections 2.6 to 2.9)."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import features, metrics, stats
from ..schema import FULL_WINDOW_LAGS, FULL_WINDOW_ROLLING, LAGS, ROLLING
from ..sources.driver_tables import NAIVE_LAGS, Tables
from .catalog import query

W = "w as (partition by unique_id order by ds)"
FN = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}


def lag_sql(lags) -> str:
    return ", ".join(f"lag(y, {k}) over w as lag_{k}" for k in lags)


def rolling_sql(sizes, names=tuple(FN)) -> str:
    return ", ".join(
        f"{FN[s]}(y) over (partition by unique_id order by ds rows between {w - 1} preceding and current row) as rolling_{s}_{w}"
        for w in sizes for s in names)


def lag_names(lags) -> str:
    return " ".join(f"lag_{k}" for k in lags)


def rolling_names(sizes, names=tuple(FN)) -> str:
    return " ".join(f"rolling_{s}_{w}" for w in sizes for s in names)


CALENDAR = """cast(hour(ds) as int) as hour, cast(isodow(ds) - 1 as int) as dayofweek, cast(quarter(ds) as int) as quarter,
  cast(month(ds) as int) as month, cast(year(ds) as int) as year, cast(dayofyear(ds) as int) as dayofyear,
  cast(day(ds) as int) as dayofmonth, cast(weekofyear(ds) as int) as weekofyear,
  sin(2 * pi() * hour(ds) / 24) as hour_sin, cos(2 * pi() * hour(ds) / 24) as hour_cos,
  sin(2 * pi() * (isodow(ds) - 1) / 7) as dayofweek_sin, cos(2 * pi() * (isodow(ds) - 1) / 7) as dayofweek_cos,
  sin(2 * pi() * month(ds) / 12) as month_sin, cos(2 * pi() * month(ds) / 12) as month_cos"""
CYCLES = "hour_sin hour_cos dayofweek_sin dayofweek_cos month_sin month_cos"


@query("lag_features", f"select unique_id, ds, y, {lag_sql(LAGS['H'])} from series window {W}", "y " + lag_names(LAGS["H"]))
def lag_features(t: Tables):
    return features.lag_features(t.series(), "H")


@query("rolling_features", f"select unique_id, ds, y, {rolling_sql(ROLLING['H'])} from series", "y " + rolling_names(ROLLING["H"]))
def rolling_features(t: Tables):
    return features.rolling_features(t.series(), "H")


@query("rolling_full", f"""
with r as (select unique_id, ds, y, {lag_sql(FULL_WINDOW_LAGS)}, {rolling_sql(FULL_WINDOW_ROLLING, ('mean', 'std'))},
  row_number() over w as p from series window {W})
---
  select unique_id, ds, y, {', '.join(f'lag_{k}' for k in FULL_WINDOW_LAGS)}, """ + ", ".join(
    f"case when p >= {w} then rolling_{s}_{w} end as rolling_{s}_{w}" for w in FULL_WINDOW_ROLLING for s in ("mean", "std"))
    + " from r", f"y {lag_names(FULL_WINDOW_LAGS)} {rolling_names(FULL_WINDOW_ROLLING, ('mean', 'std'))}")
def rolling_full(t: Tables):
    return features.rolling_full(t.series())


@query("calendar_features", f"""select unique_id, ds, {CALENDAR}, sin(2 * pi() * day(ds) / 31) as day_sin,
    cos(2 * pi() * day(ds) / 31) as day_cos from series""", CYCLES + " day_sin day_cos")
def calendar_features(t: Tables):
    return features.calendar_features(t.series(), True, True).drop("y")


@query("xgb_features", f"""
with f as (select unique_id, ds, y, {CALENDAR}, {lag_sql(LAGS['H'])}, {rolling_sql(ROLLING['H'])} from series window {W})
---
  select * from f where lag_168 is not null and rolling_std_6 is not null""",
       f"y {CYCLES} {lag_names(LAGS['H'])} {rolling_names(ROLLING['H'])}")
def xgb_features(t: Tables):
    return features.model_features(t.series(), "H")


ACF = """centred as (select unique_id, pos, y - avg(y) over (partition by unique_id) as z from numbered),
acf as (select a.unique_id, k as lag, sum(a.z * b.z) / any_value(v) as acf from centred a, range(0, {top}) r(k),
  (select unique_id as u, pos as p, z from centred) b, (select unique_id as vu, sum(z * z) as v from centred group by 1) s
  where b.u = a.unique_id and b.p = a.pos - k and s.vu = a.unique_id group by 1, 2)"""


@query("acf", f"with {ACF.format(top=41)}\n---\n select unique_id, cast(lag as int) as lag, acf from acf", "acf")
def acf(t: Tables):
    return stats.acf(t.series(), 40)


@query("pacf_two_lags", f"""with {ACF.format(top=3)},
r as (select unique_id, max(acf) filter (lag = 1) as r1, max(acf) filter (lag = 2) as r2 from acf group by 1)
---
  select unique_id, r1 as pacf_1, (r2 - r1 * r1) / (1 - r1 * r1) as pacf_2 from r""", "pacf_1 pacf_2")
def pacf_two_lags(t: Tables):
    return stats.pacf_two_lags(t.series())


@query("pacf")
def pacf(t: Tables):
    return stats.pacf(t.series(), 40)


@query("adf_lag0_stat", f"""
with s as (select unique_id, y - lag(y) over w as d, lag(y) over w as x from series window {W}),
r as (select unique_id, count(*) as n, regr_slope(d, x) as gamma, regr_sxx(d, x) as sxx, regr_syy(d, x) as syy,
  regr_sxy(d, x) as sxy from s where x is not null group by 1)
---
  select unique_id, n, gamma, gamma / sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx) as adf_stat from r""", "gamma adf_stat")
def adf_lag0_stat(t: Tables):
    return stats.adf_lag0(t.series())


@query("adf_stat", f"""
with l as (select unique_id, y - lag(y, 1) over w as d, lag(y, 1) over w as x, lag(y, 1) over w - lag(y, 2) over w as e
  from series window {W}),
g as (select unique_id, count(*) as n, regr_sxx(d, x) as xx, regr_sxx(d, e) as ee, regr_sxy(e, x) as xe,
  regr_sxy(d, x) as xd, regr_sxy(d, e) as ed, regr_syy(d, x) as dd from l where e is not null group by 1),
f as (select *, (xd * ee - ed * xe) / (xx * ee - xe * xe) as gamma, (ed * xx - xd * xe) / (xx * ee - xe * xe) as b from g)
---
  select unique_id, n as n_obs, gamma,
    gamma / sqrt((dd - gamma * xd - b * ed) / (n - 3) * ee / (xx * ee - xe * xe)) as adf_stat,
    -2.86154 - 2.8903 / n - 4.234 / pow(n, 2) - 40.04 / pow(n, 3) as crit_5 from f""", "gamma adf_stat crit_5")
def adf_stat(t: Tables):
    return stats.adf(t.series(), 1).select("unique_id", "n_obs", "gamma", "adf_stat", "crit_5")


@query("adf")
def adf(t: Tables):
    return stats.adf(t.series(), 1)


@query("adf_autolag", """
with l as (select unique_id, pos, y - y1 as d, y1 as x, y1 - y2 as z from (
    select unique_id, pos, y, lag(y, 1) over w as y1, lag(y, 2) over w as y2 from numbered window w as (partition by unique_id order by ds)) where pos >= 1),
c as (select unique_id, count(*) as n, regr_sxx(d, x) as xx, regr_sxx(d, z) as zz, regr_sxy(z, x) as xz, regr_sxy(d, x) as xd, regr_sxy(d, z) as zd,
    regr_syy(d, x) as dd from l where pos >= 2 group by 1),
b as (select *, (xd * zz - zd * xz) / (xx * zz - xz * xz) as bx, (zd * xx - xd * xz) / (xx * zz - xz * xz) as bz from c),
r as (select *, dd - xd * xd / xx as rss0, dd - bx * xd - bz * zd as rss1 from b),
o as (select unique_id, count(*) as n0, regr_slope(d, x) as g0, regr_sxx(d, x) as xx0, regr_syy(d, x) - regr_sxy(d, x) * regr_sxy(d, x) / regr_sxx(d, x) as full0
  from l group by 1),
k as (select *, n * ln(rss1 / n) + 6 < n * ln(rss0 / n) + 4 as one from r join o using (unique_id))
---
  select unique_id, cast(case when one then 1 else 0 end as int) as lags, case when one then n else n0 end as n_obs, case when one then bx else g0 end as gamma,
    case when one then bx / sqrt(rss1 / (n - 3) * zz / (xx * zz - xz * xz)) else g0 / sqrt(full0 / (n0 - 2) / xx0) end as adf_stat from k""", "gamma adf_stat")
def adf_autolag(t: Tables):
    """The unit-root test with no or one lagged difference, by AIC."""
    return stats.adf_autolag(t.series(), 1).select("unique_id", "lags", "n_obs", "gamma", "adf_stat")


# Forecasts against actuals ------------------------------------------------------------------------


@query("forecast_vs_actual", "select unique_id, ds, y, horizon_step, model, yhat from paired", "y yhat")
def forecast_vs_actual(t: Tables):
    forecasts = t.paired().drop("y")
    return metrics.pair(t.series(), forecasts)


@query("cv_join", """
with tests as (select unique_id, ds, y, cast(f as int) as fold from numbered, range(0, 5) r(f)
  where pos >= n - 12 - (4 - f) * 12 and pos < n - (4 - f) * 12)
---
  select unique_id, ds, fold, t.y, model, yhat from tests t left join paired using (unique_id, ds)""", "y yhat")
def cv_join(t: Tables):
    from ..operators.grid import fold_test_rows
    tests = fold_test_rows(t.series(), 12, 12, 5).select("unique_id", "ds", "fold", "y")
    return metrics.pair(tests, t.paired().select("unique_id", "ds", "model", "yhat"), "left")


@query("semi_ds", """select unique_id, ds, y from series where ds in
    (select ds from numbered where pos >= n - 90)""", "y")
def semi_ds(t: Tables):
    from ..operators.grid import split_last_rows
    test = split_last_rows(t.series(), 90).filter(F.col("part") == "test").select("ds").distinct()
    return t.series().join(test, "ds", "left_semi")


METRIC_SQL = """avg(abs(yhat - y)) as mae, avg(case when y <> 0 then abs((yhat - y) / y) end) * 100 as mape,
  avg((yhat - y) * (yhat - y)) as mse, sqrt(avg((yhat - y) * (yhat - y))) as rmse,
  avg(200 * abs(yhat - y) / (abs(yhat) + abs(y) + 1e-8)) as smape,
  1 - sum((yhat - y) * (yhat - y)) / nullif(var_pop(y) * count(y), 0) as r2"""


@query("forecast_metrics", f"""
with m as (select unique_id, model, {METRIC_SQL} from paired group by 1, 2)
---
  select * from m unpivot (value for metric in (mae, mape, mse, rmse, smape, r2))""", "value")
def forecast_metrics(t: Tables):
    return metrics.forecast_metrics(t.paired())


@query("metrics_by_horizon", f"select unique_id, model, horizon_step, {METRIC_SQL} from paired group by 1, 2, 3",
       "mae mape mse rmse smape r2")
def metrics_by_horizon(t: Tables):
    return metrics.metrics_wide(t.paired(), ["unique_id", "model", "horizon_step"])


@query("mase", """
with scale as (select unique_id, avg(abs(y - naive_24)) as scale from lagged group by 1),
e as (select unique_id, model, avg(abs(yhat - y)) as mae from paired group by 1, 2)
---
  select unique_id, model, mae, scale, mae / scale as mase from e join scale using (unique_id)""", "mae scale mase")
def mase(t: Tables):
    return metrics.mase(t.paired(), t.series(), 24)


@query("directional_accuracy", """
with d as (select unique_id, model, sign(y - lag(y) over w) as a, sign(yhat - lag(yhat) over w) as f from paired
  window w as (partition by unique_id, model order by ds))
---
  select unique_id, model, count(*) as n_steps, avg(case when a = f then 1.0 else 0.0 end) as mda from d
  where a is not null group by 1, 2""", "mda")
def directional_accuracy(t: Tables):
    return metrics.directional_accuracy(t.paired())


@query("residuals", """select unique_id, ds, model, y - yhat as residual, abs(y - yhat) as abs_residual,
    case when y <> 0 then (y - yhat) / y * 100 end as pct_residual from paired""", "residual abs_residual pct_residual")
def residuals(t: Tables):
    return metrics.residuals(t.paired()).select("unique_id", "ds", "model", "residual", "abs_residual", "pct_residual")


@query("residual_hist", """
with e as (select unique_id, model, y - yhat as r from paired),
ends as (select unique_id, model, min(r) as lo, (max(r) - min(r)) / 20 as width from e group by 1, 2)
---
  select unique_id, model, cast(least(19, floor((r - lo) / width)) as int) as bin, count(*) as n,
    any_value(lo + least(19, floor((r - lo) / width)) * width) as bin_start
  from e join ends using (unique_id, model) group by 1, 2, 3""", "bin_start")
def residual_hist(t: Tables):
    return metrics.histogram(metrics.residuals(t.staged("paired")), ["unique_id", "model"], "residual", 20)


PROBS = {"q05": 0.05, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95}


@query("residual_quantiles", "select unique_id, model, " + ", ".join(
    f"quantile_cont(y - yhat, {p}) as {n}" for n, p in PROBS.items()) + " from paired group by 1, 2", " ".join(PROBS))
def residual_quantiles(t: Tables):
    return metrics.quantile_table(metrics.residuals(t.staged("paired")), ["unique_id", "model"], "residual", PROBS)


QQ = [(i - 0.5) / 21 for i in range(1, 22)]


@query("qq_table", f"""
with e as (select unique_id, model, y - yhat as r from paired),
q as (select unique_id, model, avg(r) as m, stddev_samp(r) as s, quantile_cont(r, {QQ}) as sample from e group by 1, 2),
rows as (select unique_id, model, m, s, unnest({list(range(1, 22))}) as point, unnest({QQ}::double[]) as prob,
  unnest({[NormalDist().inv_cdf(p) for p in QQ]}::double[]) as z, unnest(sample) as sample from q)
---
  select unique_id, model, cast(point as int) as point, prob, z, sample, m + s * z as normal from rows""", "prob z sample normal")
def qq_table(t: Tables):
    return metrics.qq_table(metrics.residuals(t.staged("paired")), ["unique_id", "model"], "residual")


@query("residual_acf", f"""
with res as (select unique_id || '/' || model as unique_id, row_number() over (partition by unique_id, model order by ds) - 1 as pos, y - yhat as y from paired),
{ACF.replace('from numbered', 'from res').format(top=25)}
---
  select split_part(unique_id, '/', 1) as unique_id, split_part(unique_id, '/', 2) as model, cast(lag as int) as lag, acf from acf""", "acf")
def residual_acf(t: Tables):
    left = metrics.residuals(t.staged("paired"))
    found = stats.autocorrelation(left, 24, "residual", ["unique_id", "model"])
    # Lags that a short series does not reach have no pair of rows.
    return found.select("unique_id", "model", "n_obs", F.posexplode("acf").alias("lag", "acf")).where("lag < n_obs").drop("n_obs")


@query("pct_bounds", """select unique_id, model, ds, yhat, yhat - abs(yhat) * 0.1 as lo, yhat + abs(yhat) * 0.1 as hi, 80 as level
    from paired""", "yhat lo hi")
def pct_bounds(t: Tables):
    return metrics.percent_bounds(t.paired().select("unique_id", "model", "ds", "yhat"))


@query("error_bounds", """
with f as (select unique_id, model, ds, y, yhat from paired),
q as (select unique_id, model, quantile_cont(y - yhat, 0.1) as l80, quantile_cont(y - yhat, 0.9) as h80,
  quantile_cont(y - yhat, 0.025) as l95, quantile_cont(y - yhat, 0.975) as h95 from f group by 1, 2)
---
  select unique_id, model, ds, yhat, 80 as level, yhat + l80 as lo, yhat + h80 as hi from f join q using (unique_id, model)
  union all select unique_id, model, ds, yhat, 95, yhat + l95, yhat + h95 from f join q using (unique_id, model)""", "yhat lo hi")
def error_bounds(t: Tables):
    fitted = t.staged("paired")
    return metrics.error_bounds(fitted.select("unique_id", "model", "ds", "yhat"), fitted)


@query("compare_models", f"""
with m as (select unique_id, model, {METRIC_SQL} from paired group by 1, 2),
rows as (select * from m unpivot (value for metric in (mae, mape, mse, rmse, smape, r2)))
---
  select unique_id, metric, """ + ", ".join(f"max(value) filter (model = '{m}') as {m}" for m in NAIVE_LAGS)
    + " from rows group by 1, 2", " ".join(NAIVE_LAGS))
def compare_models(t: Tables):
    return metrics.compare_models(metrics.forecast_metrics(t.paired()), list(NAIVE_LAGS))


@query("ensemble", """
with w as (select unique_id, model, 1 / (sqrt(avg((yhat - y) * (yhat - y))) + 1e-9) as w from paired group by 1, 2)
---
  select unique_id, ds, sum(w * yhat) / sum(w) as yhat, count(*) as n_models
  from paired join w using (unique_id, model) group by 1, 2""", "yhat")
def ensemble(t: Tables):
    p = t.staged("paired")
    return metrics.ensemble(p, metrics.metrics_wide(p).select("unique_id", "model", "rmse"))


@query("ensemble_by_horizon", """
with w as (select unique_id, model, horizon_step, 1 / (sqrt(avg((yhat - y) * (yhat - y))) + 1e-9) as w
  from paired group by 1, 2, 3)
---
  select unique_id, ds, horizon_step, sum(w * yhat) / sum(w) as yhat, count(*) as n_models
  from paired join w using (unique_id, model, horizon_step) group by 1, 2, 3""", "yhat")
def ensemble_by_horizon(t: Tables):
    by = ["unique_id", "horizon_step"]
    p = t.staged("paired")
    return metrics.ensemble(p, metrics.metrics_wide(p, [*by, "model"]).select(*by, "model", "rmse"), by)


@query("ensemble_recent", """
with ends as (select unique_id, max(ds) as e from paired group by 1),
f as (select unique_id, ds, model, y, yhat, pow(0.5, (epoch(e) - epoch(ds)) / (48.0 * 3600)) as fade
  from paired join ends using (unique_id)),
w as (select unique_id, model, 1 / (sqrt(sum(fade * (yhat - y) * (yhat - y)) / sum(fade)) + 1e-9) as w from f group by 1, 2)
---
  select unique_id, ds, sum(w * yhat) / sum(w) as yhat, count(*) as n_models
  from paired join w using (unique_id, model) group by 1, 2""", "yhat")
def ensemble_recent(t: Tables):
    p = t.staged("paired")
    return metrics.ensemble(p, metrics.recent_rmse(p, 48))


# Top rows, unions, distinct -------------------------------------------------------------------------


@query("topk_recent", """
with r as (select id, "time", event_id, temp, row_number() over (partition by id order by "time" desc, event_id desc) as rank
  from obs_user)
---
  select * from r where rank <= 5""")
def topk_recent(t: Tables):
    """Spark limits each group inside every partition before the shuffle (WindowGroupLimit)."""
    newest = Window.partitionBy("id").orderBy(F.desc("time"), F.desc("event_id"))
    return t.obs_by_user().select("id", "time", "event_id", "temp").withColumn(
        "rank", F.row_number().over(newest)).filter(F.col("rank") <= 5)


@query("union_sources", """select unique_id, ds, y, null as value from series
    union all select zone, period, null, value from load""", "y value")
def union_sources(t: Tables):
    load = t.load().select(F.col("zone").alias("unique_id"), F.col("period").alias("ds"), "value")
    return t.series().unionByName(load, allowMissingColumns=True)


@query("distinct_ids", "select distinct id from obs_user")
def distinct_ids(t: Tables):
    return t.obs_by_user().select("id").distinct()
