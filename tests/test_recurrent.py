"""The recurrent network: gradients, what it learns, folds, and how rows are dealt."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from zephyrgrid.models import recurrent, weekly_sequence
from zephyrgrid.models.folds import FoldPlan


@pytest.fixture
def daily(spark):
    def make(named):
        frames = [pd.DataFrame({"unique_id": uid, "k": np.arange(len(y)), "y": np.asarray(y, dtype=float)}) for uid, y in named.items()]
        rows = spark.createDataFrame(pd.concat(frames), "unique_id string, k long, y double")
        return rows.select("unique_id", F.timestamp_seconds(F.col("k") * 86400).cast("timestamp_ntz").alias("ds"), "y")
    return make


def logistic(n, start, r=3.7, noise=0.0):
    y = [start]
    for _ in range(n - 1):
        y.append(r * y[-1] * (1 - y[-1]))
    return 20 + 10 * np.array(y)


@pytest.mark.parametrize("hidden", [(3,), (4, 2)])
def test_gradient_against_differences(hidden):
    network, rng = recurrent.Network(hidden), np.random.default_rng(1)
    theta = network.start(3) + rng.normal(scale=0.1, size=network.size)
    x, y = rng.uniform(size=(9, 7)), rng.uniform(size=9)
    _, grad = network.loss(theta, x, y)
    for i in range(network.size):
        move = np.zeros(network.size)
        move[i] = 1e-5
        slope = (network.loss(theta + move, x, y)[0] - network.loss(theta - move, x, y)[0]) / 2e-5
        assert abs(slope - grad[i]) < 1e-6 * max(1, abs(slope)), i


def test_learns_what_a_line_cannot(daily):
    # The logistic map: the next value is a parabola of the last one, its linear correlation is weak.
    series = {f"s{i}": logistic(260, 0.1 + 0.07 * i) for i in range(6)}
    frame = daily({k: v[:253] for k, v in series.items()})
    thetas, rows = recurrent.train(frame, hidden=(8,), steps=60)
    mine = recurrent.fitted_errors(rows, thetas[0], hidden=(8,)).agg(F.sqrt(F.avg(F.col("e") * F.col("e")))).first()[0]
    scaled = weekly_sequence.scale(frame)
    line = weekly_sequence.fitted_errors(scaled, weekly_sequence.fit(scaled)).agg(F.sqrt(F.avg(F.col("e") * F.col("e")))).first()[0]
    assert mine < 0.5 * line
    made = recurrent.forecast(frame, 7, (80,), (thetas, rows), (8,)).filter("horizon_step = 1").collect()
    errors = [r["yhat"] - series[r["unique_id"]][253] for r in made]
    assert len(made) == 6 and np.sqrt(np.mean(np.square(errors))) < 0.5 * np.std(logistic(260, 0.3))
    assert all(r["lo"] <= r["hi"] and r["level"] == 80 for r in made)


def test_folds_equal_separate_fits_however_rows_are_dealt(daily):
    series = {"a": logistic(60, 0.2), "b": 3 * logistic(50, 0.4), "short": logistic(6, 0.3)}
    plan = FoldPlan(3, 4, 2)
    folds = recurrent.predict_folds(daily(series).repartition(5), plan, (4,), 8).toPandas()
    assert set(folds["unique_id"]) == {"a", "b"}
    for fold in range(2):
        cut = {uid: y[:len(y) - 3 - (1 - fold) * 4] for uid, y in series.items() if len(y) > 20}
        frame = daily(cut)
        thetas, rows = recurrent.train(frame, hidden=(4,), steps=8)
        alone = recurrent.predict(thetas, frame, rows, 3, hidden=(4,)).toPandas().sort_values(["unique_id", "horizon_step"])
        got = folds[folds.fold == fold].sort_values(["unique_id", "horizon_step"])
        assert np.allclose(got["yhat"], alone["yhat"], rtol=1e-6)


def test_nothing_to_learn_from(daily):
    frame = daily({"short": [1.0, 2.0, 3.0], "flat": [4.0] * 30})
    made = recurrent.forecast(frame, 2, (80,), hidden=(2,)).collect()
    assert {r["unique_id"] for r in made} == {"flat"}
    assert recurrent.forecast(frame.filter("unique_id = 'short'"), 2, (80,), hidden=(2,)).count() == 0
