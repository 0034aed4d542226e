"""Week-ahead recurrent network: long short-term memory layers over the last seven scaled daily values.

One network per fold learns from the windows of all series. Training is data-parallel: every step sends the parameters (some
kilobytes) to the tasks, each task adds up loss and gradient over its windows in numpy batches, Spark adds those up by
parameter, and the driver takes a quasi-Newton step on the sums. Full sums do not depend on how rows are dealt, so a fold's
network is the one that a fit on its own rows alone gives. The last fifth of each series' windows is held out: its
loss stops the training and picks the parameters.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timeaxis import DAY, shift
from ..operators.blocks import attach, exact_quantiles, row_blocks
from ..session import stage
from .common import FORECAST_COLUMNS
from .folds import FULL, FoldPlan, numbered, tails

NAME = "Recurrent"
LENGTH = 7
HIDDEN = (16,)
HELD_OUT = 0.2
STEPS, PATIENCE, MEMORY = 60, 8, 10
BATCH = 4096
SEED = 42


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


class Network:
    """Stacked layers with one linear output; parameters are one flat vector."""

    def __init__(self, hidden: Sequence[int] = HIDDEN) -> None:
        self.hidden = tuple(hidden)
        self.shapes = []
        for below, units in zip((1, *self.hidden), self.hidden):
            self.shapes += [(below, 4 * units), (units, 4 * units), (4 * units,)]
        self.shapes += [(self.hidden[-1],), (1,)]
        self.size = sum(int(np.prod(s)) for s in self.shapes)

    def start(self, seed: int = SEED) -> np.ndarray:
        """Uniform weights by fan-in, zero biases but for open forget gates."""
        rng, parts = np.random.default_rng(seed), []
        for shape in self.shapes:
            part = rng.uniform(-1, 1, shape) * np.sqrt(3 / shape[0]) * 0.5 if len(shape) > 1 else np.zeros(shape)
            parts.append(part)
        for layer, units in enumerate(self.hidden):
            parts[3 * layer + 2][units:2 * units] = 1.0
        parts[-2] = rng.uniform(-1, 1, self.hidden[-1]) / np.sqrt(self.hidden[-1])
        return np.concatenate([p.ravel() for p in parts])

    def parts(self, theta: np.ndarray) -> list[np.ndarray]:
        ends = np.cumsum([int(np.prod(s)) for s in self.shapes])
        return [p.reshape(s) for p, s in zip(np.split(theta, ends[:-1]), self.shapes)]

    def forward(self, theta: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, list]:
        """Output per window (oldest value first) and what the backward pass needs."""
        weights, tape = self.parts(theta), []
        series = [x[:, t:t + 1] for t in range(x.shape[1])]
        for layer, units in enumerate(self.hidden):
            w, u, b = weights[3 * layer:3 * layer + 3]
            h, c, out, kept = np.zeros((len(x), units)), np.zeros((len(x), units)), [], []
            for value in series:
                z = value @ w + h @ u + b
                i, f, o = (_sigmoid(z[:, k * units:(k + 1) * units]) for k in (0, 1, 3))
                g = np.tanh(z[:, 2 * units:3 * units])
                last_c, last_h = c, h
                c = f * c + i * g
                s = np.tanh(c)
                h = o * s
                kept.append((value, i, f, g, o, s, last_c, last_h))
                out.append(h)
            tape.append(kept)
            series = out
        return series[-1] @ weights[-2] + weights[-1], tape

    def loss(self, theta: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        """Sum of squared errors and its gradient."""
        out, tape = self.forward(theta, x)
        weights, error = self.parts(theta), out - y
        grads = [np.zeros(s) for s in self.shapes]
        last = tape[-1][-1]
        grads[-2], grads[-1] = 2 * error @ (last[4] * last[5]), np.array([2 * error.sum()])
        above = [np.zeros((len(x), self.hidden[-1]))] * (x.shape[1] - 1) + [2 * error[:, None] * weights[-2]]
        for layer in range(len(self.hidden) - 1, -1, -1):
            w, u, _ = weights[3 * layer:3 * layer + 3]
            dh, dc, below = 0.0, 0.0, []
            for t in range(x.shape[1] - 1, -1, -1):
                value, i, f, g, o, s, last_c, last_h = tape[layer][t]
                dh = dh + above[t]
                dc = dc + dh * o * (1 - s * s)
                dz = np.concatenate([dc * g * i * (1 - i), dc * last_c * f * (1 - f), dc * i * (1 - g * g), dh * s * o * (1 - o)], axis=1)
                grads[3 * layer] += value.T @ dz
                grads[3 * layer + 1] += last_h.T @ dz
                grads[3 * layer + 2] += dz.sum(axis=0)
                below.append(dz @ w.T)
                dh, dc = dz @ u.T, dc * f
            above = below[::-1]
        return float(error @ error), np.concatenate([g.ravel() for g in grads])


def windows(daily: DataFrame, plan: FoldPlan = FULL) -> DataFrame:
    """Each value after its seven predecessors, with every fold's scale: unique_id, pos, n, segment, x, y, lo, span; staged.

    A fold's scale is the least value and the span of its own training rows. Rows without a target are left out first.
    """
    rows = numbered(daily.filter(F.col("y").isNotNull())).withColumn("segment", plan.segment())
    lows = [F.min(F.when(F.col("segment") <= f, F.col("y"))) for f in range(plan.n_windows)]
    highs = [F.max(F.when(F.col("segment") <= f, F.col("y"))) for f in range(plan.n_windows)]
    spans = [F.when(high > low, high - low).otherwise(1.0) for low, high in zip(lows, highs)]
    scales = rows.groupBy("unique_id").agg(F.array(*lows).alias("lo"), F.array(*spans).alias("span"))
    lagged = row_blocks(rows, ["unique_id"], lambda w: {f"x{k}": F.lag("y", k).over(w) for k in range(1, LENGTH + 1)}, LENGTH)
    past = F.array(*[F.col(f"x{k}") for k in range(LENGTH, 0, -1)])
    made = attach(lagged.filter(F.col(f"x{LENGTH}").isNotNull()), scales, ["unique_id"], ["pos"], "inner")
    return stage(made.select("unique_id", "pos", "n", "segment", past.alias("x"), "y", "lo", "span"), "windows")


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def _sums(rows: DataFrame, network: Network, plan: FoldPlan, thetas: dict[int, np.ndarray]) -> dict[int, tuple[float, float, float, float, np.ndarray]]:
    """By fold: windows and squared error trained on, windows and squared error held out, and the gradient."""
    def run(batches):
        totals = {f: np.zeros(4 + network.size) for f in thetas}
        for pdf in batches:
            x, y, lo, span = _matrix(pdf["x"]), pdf["y"].to_numpy(), _matrix(pdf["lo"]), _matrix(pdf["span"])
            segment, pos, n = (pdf[c].to_numpy() for c in ("segment", "pos", "n"))
            for f, theta in thetas.items():
                mine = segment <= f
                rows_of_fold = n - plan.h - (plan.n_windows - 1 - f) * plan.step_size
                held = mine & (pos - LENGTH >= np.floor((rows_of_fold - LENGTH) * (1 - HELD_OUT)))
                for kind, chosen in enumerate((mine & ~held, held)):
                    at = np.flatnonzero(chosen)
                    for first in range(0, len(at), BATCH):
                        k = at[first:first + BATCH]
                        scaled = (x[k] - lo[k, f, None]) / span[k, f, None]
                        goal = (y[k] - lo[k, f]) / span[k, f]
                        if kind == 0:
                            loss, grad = network.loss(theta, scaled, goal)
                            totals[f][4:] += grad
                        else:
                            loss = float(((network.forward(theta, scaled)[0] - goal) ** 2).sum())
                        totals[f][2 * kind] += len(k)
                        totals[f][2 * kind + 1] += loss
        yield pd.DataFrame([(f, t.tolist()) for f, t in totals.items()], columns=["fold", "part"])

    parts = rows.select("segment", "pos", "n", "x", "y", "lo", "span").mapInPandas(run, "fold int, part array<double>")
    cells = parts.select("fold", F.posexplode("part").alias("i", "v")).groupBy("fold", "i").agg(F.sum("v").alias("v"))
    out = {f: np.zeros(4 + network.size) for f in thetas}
    for row in cells.collect():  # as many as parameters
        out[row["fold"]][row["i"]] = row["v"]
    return {f: (*t[:4], t[4:]) for f, t in out.items()}


class _Descent:
    """Limited-memory quasi-Newton steps for one network; a step that raises the loss is halved."""

    def __init__(self, theta: np.ndarray) -> None:
        self.theta, self.loss, self.grad = theta, np.inf, None
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.trial, self.step = theta, None
        self.best, self.best_held, self.since, self.done, self.halved = theta, np.inf, 0, False, 0

    def tell(self, loss: float, grad: np.ndarray, held: float) -> None:
        """What the trial point gave; sets the next trial."""
        if self.grad is not None and not loss < self.loss:
            self.halved += 1
            self.step = self.step / 2
            self.trial = self.theta + self.step
            self.done = self.halved > 12
            return
        if self.grad is not None:
            s, y = self.trial - self.theta, grad - self.grad
            if s @ y > 1e-12:
                self.pairs = [*self.pairs[1 - MEMORY:], (s, y)]
        small = np.isfinite(self.loss) and self.loss - loss < 1e-9 * max(self.loss, 1e-12)
        self.theta, self.loss, self.grad, self.halved = self.trial, loss, grad, 0
        if held < self.best_held:
            self.best, self.best_held, self.since = self.theta, held, 0
        else:
            self.since += 1
        self.done = self.since >= PATIENCE or small or not np.any(grad)
        self.step = self._direction()
        self.trial = self.theta + self.step

    def _direction(self) -> np.ndarray:
        q, used = self.grad.copy(), []
        for s, y in reversed(self.pairs):
            a = (s @ q) / (s @ y)
            q -= a * y
            used.append((a, s, y))
        if self.pairs:
            s, y = self.pairs[-1]
            q *= (s @ y) / (y @ y)
        else:
            q *= min(1.0, 0.1 / max(np.linalg.norm(q), 1e-12))
        for a, s, y in reversed(used):
            q += (a - (y @ q) / (s @ y)) * s
        return -q


def fit(rows: DataFrame, plan: FoldPlan = FULL, hidden: Sequence[int] = HIDDEN, steps: int = STEPS, seed: int = SEED) -> dict[int, np.ndarray]:
    """Parameters by fold from ``windows``. A fold without a window keeps its starting values."""
    network = Network(hidden)
    runs = {f: _Descent(network.start(seed)) for f in range(plan.n_windows)}
    for _ in range(steps):
        active = {f: r.trial for f, r in runs.items() if not r.done}
        if not active:
            break
        for f, (n, loss, n_held, held, grad) in _sums(rows, network, plan, active).items():
            if n == 0:
                runs[f].done = True
                continue
            runs[f].tell(loss / n, grad / n, held / n_held if n_held else loss / n)
    return {f: r.best for f, r in runs.items()}


def predict(thetas: dict[int, np.ndarray], daily: DataFrame, rows: DataFrame, h: int = 7, plan: FoldPlan = FULL, hidden: Sequence[int] = HIDDEN) -> DataFrame:
    """Recursive path of every series and fold: unique_id, fold, cutoff, horizon_step, scaled, yhat, lo, span."""
    network = Network(hidden)
    ends = tails(numbered(daily.filter(F.col("y").isNotNull())), plan, LENGTH)
    scales = rows.groupBy("unique_id").agg(F.first("lo").alias("lo"), F.first("span").alias("span"))
    ready = ends.filter(F.size("tail") == LENGTH).join(scales, "unique_id").select(
        "unique_id", "fold", "cutoff", "tail", F.col("lo")[F.col("fold")].alias("lo"), F.col("span")[F.col("fold")].alias("span"))

    def run(batches):
        for pdf in batches:
            out = []
            for fold, part in pdf.groupby("fold"):
                lo, span = part["lo"].to_numpy(), part["span"].to_numpy()
                x = (_matrix(part["tail"])[:, ::-1] - lo[:, None]) / span[:, None]
                for s in range(1, h + 1):
                    value = network.forward(thetas[fold], x)[0]
                    x = np.concatenate([x[:, 1:], value[:, None]], axis=1)
                    out.append(pd.DataFrame({"unique_id": part["unique_id"], "fold": part["fold"], "cutoff": part["cutoff"], "horizon_step": s,
                                             "scaled": value, "yhat": value * span + lo, "lo": lo, "span": span}))
            if out:
                yield pd.concat(out)

    return ready.mapInPandas(run, "unique_id string, fold int, cutoff timestamp_ntz, horizon_step int, scaled double, yhat double, lo double, span double")


def fitted_errors(rows: DataFrame, theta: np.ndarray, fold: int = 0, hidden: Sequence[int] = HIDDEN) -> DataFrame:
    """One-step errors on a fold's training windows, scaled: unique_id, e."""
    network = Network(hidden)

    def run(batches):
        for pdf in batches:
            x, lo, span = _matrix(pdf["x"]), _matrix(pdf["lo"])[:, fold], _matrix(pdf["span"])[:, fold]
            guess = np.concatenate([network.forward(theta, (x[k:k + BATCH] - lo[k:k + BATCH, None]) / span[k:k + BATCH, None])[0] for k in range(0, len(x), BATCH)] or [np.zeros(0)])
            yield pd.DataFrame({"unique_id": pdf["unique_id"], "e": (pdf["y"].to_numpy() - lo) / span - guess})

    return rows.filter(F.col("segment") <= fold).select("unique_id", "x", "y", "lo", "span").mapInPandas(run, "unique_id string, e double")


def train(daily: DataFrame, plan: FoldPlan = FULL, hidden: Sequence[int] = HIDDEN, steps: int = STEPS, seed: int = SEED) -> tuple[dict[int, np.ndarray], DataFrame]:
    rows = windows(daily, plan)
    return fit(rows, plan, hidden, steps, seed), rows


def forecast(daily: DataFrame, h: int = 7, levels: Sequence[int] = (80, 95), trained: tuple | None = None, hidden: Sequence[int] = HIDDEN) -> DataFrame:
    """``h`` daily steps; bounds are error percentiles around each step, clamped to the scale's range before it is undone."""
    thetas, rows = trained or train(daily, hidden=hidden)
    path = predict(thetas, daily, rows, h, hidden=hidden)
    probs = {f"{side}_{lv}": (100 + sign * lv) / 200 for lv in levels for side, sign in (("lo", -1), ("hi", 1))}
    bounds = exact_quantiles(fitted_errors(rows, thetas[0], hidden=hidden), ["unique_id"], "e", probs)

    def bound(name: str):
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("scaled") + F.col(name))) * F.col("span") + F.col("lo")

    bands = F.explode(F.array(*[F.struct(F.lit(lv).alias("level"), bound(f"lo_{lv}").alias("lo"), bound(f"hi_{lv}").alias("hi")) for lv in levels]))
    return path.join(bounds, "unique_id").withColumn("_b", bands).select(
        "unique_id", shift("cutoff", F.col("horizon_step") * DAY).alias("ds"), F.lit(NAME).alias("model"), "horizon_step", "yhat", "_b.level", "_b.lo", "_b.hi")


def predict_folds(daily: DataFrame, plan: FoldPlan, hidden: Sequence[int] = HIDDEN, steps: int = STEPS) -> DataFrame:
    """One network per fold, all trained in the same jobs: unique_id, fold, horizon_step, yhat."""
    thetas, rows = train(daily, plan, hidden, steps)
    return predict(thetas, daily, rows, plan.h, plan, hidden).select("unique_id", "fold", "horizon_step", "yhat")
