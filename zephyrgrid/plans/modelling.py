"""Models, back-tests and summaries (survey section 2.9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..models import arima, backtest, boosted, fourier_trend, recurrent, seasonal_ar, seasonal_naive, weekly_sequence
from ..models.folds import FoldPlan
from ..models.forecaster import model_summary
from ..operators.rollup import daily_mean
from ..session import stage
from ..sources.driver_tables import Tables
from .catalog import query
from .grids import NAIVE_FORECAST
from .series import METRIC_SQL

STEP = 3600
AR1 = """
with p as (select unique_id, y, lag(y) over (partition by unique_id order by ds) as x from series),
r as (select unique_id, count(*) as n, regr_slope(y, x) as phi, regr_intercept(y, x) as intercept,
  regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x) as rss from p where x is not null group by 1)
---
"""


@query("ar1_fit", AR1 + " select unique_id, n, phi, intercept from r", "phi intercept")
def ar1_fit(t: Tables):
    return seasonal_ar.ar1(t.series()).select("unique_id", "n", "phi", "intercept")


@query("ar1_aic", AR1 + """ select unique_id, n * ln(rss / n) + 4 as aic, n * ln(rss / n) + 2 * ln(n) as bic from r""", "aic bic")
def ar1_aic(t: Tables):
    return seasonal_ar.ar1(t.series()).select("unique_id", "aic", "bic")


@query("trend_fit", """
with d as (select unique_id, y, (epoch(ds) - epoch(min(ds) over (partition by unique_id))) / 86400 as day from series)
---
  select unique_id, count(*) as n, regr_slope(y, day) as slope, regr_intercept(y, day) as intercept, regr_r2(y, day) as r2
  from d group by 1""", "slope intercept r2")
def trend_fit(t: Tables):
    return fourier_trend.trend_line(t.series())


@query("seasonal_ar_forecast")
def seasonal_ar_forecast(t: Tables):
    return seasonal_ar.forecast(t.series(), 24, STEP, 24)


@query("ar2_d1_fit", """
with l as (select unique_id, pos, y, lag(y, 1) over w as l1, lag(y, 2) over w as l2, lag(y, 3) over w as l3
  from numbered window w as (partition by unique_id order by ds)),
d as (select unique_id, y - l1 as d, l1 - l2 as a, l2 - l3 as b from l where pos >= 25),
g as (select unique_id, count(*) as n, sum(a * a) as aa, sum(a * b) as ab, sum(b * b) as bb, sum(a * d) as ad,
  sum(b * d) as bd, sum(d * d) as dd from d group by 1),
f as (select *, (ad * bb - bd * ab) / (aa * bb - ab * ab) as u, (bd * aa - ad * ab) / (aa * bb - ab * ab) as v from g),
e as (select *, dd - u * ad - v * bd as rss from f)
---
  select unique_id, n as n_obs, 1 + u as l1, v - u as l2, -v as l3, rss / (n - 2) as sigma2,
    n * ln(rss / n) + 6 + 24.0 / (n - 4) as aicc, 'd1:1,2' as form from e""", "l1 l2 l3 sigma2 aicc")
def ar2_d1_fit(t: Tables):
    fitted = seasonal_ar.fixed_order(t.series(), (1, 2), 1)
    return fitted.select("unique_id", "n_obs", F.col("coef")[1].alias("l1"), F.col("coef")[2].alias("l2"),
                         F.col("coef")[3].alias("l3"), "sigma2", "aicc", "form")


@query("arima_residuals", """
with centred as (select unique_id, ds, pos, y - avg(y) over (partition by unique_id) as w from numbered),
e as (select unique_id, ds, pos, w, w as e from centred where pos = 0
  union all select c.unique_id, c.ds, c.pos, c.w, c.w - 0.5 * e.e from e join centred c on c.unique_id = e.unique_id and c.pos = e.pos + 1)
---
  select unique_id, pos, w, e from e""", "w e", recursive=True)
def arima_residuals(t: Tables):
    """Innovations of every series under a first-order moving average of 0.5."""
    rows = arima.differenced(t.series(), 24, 0, 0)
    return arima.innovations(rows, arima.fixed(rows, ma={1: 0.5}), 1)


@query("arima_search")
def arima_search(t: Tables):
    """Orders, coefficients and fit of every series."""
    return arima.fit(t.series(), 24)


@query("arima_forecast")
def arima_forecast(t: Tables):
    return arima.forecast(t.series(), 24, STEP, 24)


@query("fourier_trend_forecast")
def fourier_trend_forecast(t: Tables):
    return fourier_trend.forecast(t.series(), 24, STEP, "H")


@query("components")
def components(t: Tables):
    return fourier_trend.components(t.series(), fourier_trend.fit(t.series(), "H"), "H")


@query("weekly_seq_forecast")
def weekly_seq_forecast(t: Tables):
    return weekly_sequence.forecast(daily_mean(t.hourly_mean()), 7)


@query("lstm_forecast")
def lstm_forecast(t: Tables):
    """A recurrent network over all series, a week ahead."""
    return recurrent.forecast(stage(daily_mean(t.hourly_mean()), "days"), 7)


@query("gbt_forecast")
def gbt_forecast(t: Tables):
    model = boosted.train(t.series(), "H")
    return boosted.forecast(model, t.series(), 24, STEP, "H")


@query("feature_importance")
def feature_importance(t: Tables):
    return boosted.feature_importance(boosted.train(t.series(), "H"), t.series(), "H")


@query("seasonal_naive_forecast", f"""with {NAIVE_FORECAST.strip()}
---
  select unique_id, ds, 'SeasonalNaive' as model, cast(horizon_step as int) as horizon_step, yhat from forecast""", "yhat")
def seasonal_naive_forecast(t: Tables):
    return seasonal_naive.forecast(t.series(), 24, STEP)


@query("backtest_naive", f"""
with tests as (select unique_id, ds, y, f as fold, pos - (n - 12 - (4 - f) * 12) + 1 as s, n - 12 - (4 - f) * 12 as cut
  from numbered, range(0, 5) r(f) where pos >= n - 12 - (4 - f) * 12 and pos < n - (4 - f) * 12),
paired_folds as (select t.unique_id, t.y, p.y as yhat, 'SeasonalNaive' as model from tests t
  join (select unique_id, pos, y from numbered) p on p.unique_id = t.unique_id and p.pos = t.cut - 24 + t.s - 1),
m as (select unique_id, model, {METRIC_SQL} from paired_folds group by 1, 2)
---
  select * from m unpivot (value for metric in (mae, mape, mse, rmse, smape, r2))""", "value")
def backtest_naive(t: Tables):
    return backtest.evaluate(t.series(), [seasonal_naive.NAME])


@query("backtest")
def backtest_models(t: Tables):
    """Seasonal autoregression and Fourier trend, refitted in each of five folds."""
    return backtest.evaluate(t.series(), [seasonal_ar.NAME, fourier_trend.NAME], FoldPlan(12, 12, 5))


@query("backtest_weekly")
def backtest_weekly(t: Tables):
    return backtest.evaluate(stage(daily_mean(t.hourly_mean()), "days"), [weekly_sequence.NAME], FoldPlan(7, 7, 2), freq="D")


@query("model_summary", """
with steps as (select unique_id, cast(epoch(ds) - epoch(lag(ds) over (partition by unique_id order by ds)) as bigint) as step from series),
ranked as (select unique_id, step, row_number() over (partition by unique_id order by count(*) desc, step) as r
  from steps where step is not null group by 1, 2),
freq as (select unique_id, case when step <= 900 then '15min' when step <= 3600 then 'H' else 'D' end as freq from ranked where r = 1)
---
  select unique_id, count(*) as n_obs, min(ds) as first_ds, max(ds) as last_ds, any_value(freq) as freq,
    cast(any_value(case freq when '15min' then 96 when 'H' then 24 else 7 end) as int) as season, cast(24 as bigint) as n_forecast
  from series join freq using (unique_id) group by 1""")
def summary(t: Tables):
    return model_summary(t.series(), seasonal_naive.forecast(t.series(), 24, STEP))
