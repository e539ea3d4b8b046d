"""Window-to-next-value forecasters, trained by epochs on aggregated moments.

The inputs are the last ``n_steps`` scaled vectors of each entity, the output the
next target value. A squared-error loss depends on the rows only through their
sums of products, so rows are read once; every epoch then updates all entities'
coefficients from one small matrix each, and the loss curve comes with it.

With ``hidden`` units the inputs are joined by what a recurrent layer of fixed
random weights makes of the window, so that the model bends where a linear one
cannot; only its readout is trained, on the same sums of products. The layer
starts from zero in every window, so its outputs belong to one row alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.operators.companion import affine_paths
from panelwright.operators.gram import gram_wide, map_batches, unpack_batch
from panelwright.operators.impute import attach, inverse_minmax, minmax
from panelwright.operators.series import numbered, series
from panelwright.session import settle


def train_epochs(
    xtx: np.ndarray, xty: np.ndarray, yy: np.ndarray, epochs: int = 300, patience: int = 20, min_delta: float = 0.0
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Accelerated gradient descent on mean squared error, for many systems at once.

    A system stops when its loss has not improved for ``patience`` epochs; its
    best coefficients are kept. Returns coefficients, losses (m, epochs) with NaN
    after the stop, and the epochs run.
    """
    n = np.maximum(xtx[:, 0, 0], 1.0)
    g, b, c = xtx / n[:, None, None], xty / n[:, None], yy / n
    step = 1 / np.maximum(2 * np.linalg.eigvalsh(g)[:, -1], 1e-12)
    beta = np.zeros_like(b)
    ahead, best = beta.copy(), beta.copy()
    best_loss = np.full(len(b), np.inf)
    since = np.zeros(len(b), int)
    run = np.zeros(len(b), int)
    active = np.ones(len(b), bool)
    curve = np.full((len(b), epochs), np.nan)
    for epoch in range(epochs):
        grad = 2 * (np.einsum("mij,mj->mi", g, ahead) - b)
        new = ahead - step[:, None] * grad
        ahead = new + epoch / (epoch + 3) * (new - beta)
        beta = new
        loss = np.maximum(c - 2 * np.einsum("mi,mi->m", beta, b) + np.einsum("mi,mij,mj->m", beta, g, beta), 0.0)
        curve[active, epoch] = loss[active]
        run[active] += 1
        better = active & (loss < best_loss - min_delta)
        best[better], best_loss[better] = beta[better], loss[better]
        since = np.where(better, 0, since + 1)
        active &= since < patience
        if not active.any():
            break
    return best, curve, run


class SequenceResult(tuple):
    """(forecasts, losses), and ``status``: a row for every entity, those too short to be fitted included."""

    status: DataFrame

    def __new__(cls, forecasts: DataFrame, losses: DataFrame, status: DataFrame) -> SequenceResult:
        self = super().__new__(cls, (forecasts, losses))
        self.status = status
        return self


@dataclass(frozen=True)
class Layer:
    """A recurrent layer with fixed random weights for windows of ``n_steps`` vectors of ``width`` numbers."""

    hidden: int
    width: int
    n_steps: int
    seed: int = 0

    def weights(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        into = rng.normal(0, 2 / np.sqrt(self.width), (self.hidden, self.width))
        back = rng.normal(size=(self.hidden, self.hidden))
        back *= 0.9 / max(np.abs(np.linalg.eigvals(back)).max(), 1e-12)
        return into, back, rng.uniform(-1, 1, self.hidden)

    def outputs(self, x: np.ndarray, weights: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """(m, hidden) from rows [1, newest vector, ..., oldest vector]; values scaled to 0..1 are centred."""
        into, back, bias = weights
        h = np.zeros((len(x), self.hidden))
        for j in range(self.n_steps, 0, -1):
            z = 2 * x[:, 1 + (j - 1) * self.width : 1 + j * self.width] - 1
            h = np.tanh(z @ into.T + h @ back.T + bias)
        return h

    def joined(self, column: str):
        """A function for ``mapInPandas`` that puts the outputs before the last number, the target."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            weights = self.weights()
            for pdf in batches:
                if len(pdf):
                    x = np.vstack(pdf[column].to_numpy()).astype(float)
                    pdf[column] = np.concatenate([x[:, :-1], self.outputs(x, weights), x[:, -1:]], axis=1).tolist()
                yield pdf

        return run


def sequence_forecast(
    df: DataFrame,
    target: str,
    features: Sequence[str] = (),
    by: Sequence[str] = ("industry",),
    order: str = "year",
    split: str = "split",
    n_steps: int = 2,
    fit_on: str = "train",
    recursive: bool = True,
    epochs: int = 300,
    patience: int = 20,
    min_delta: float = 0.0,
    validate: bool = False,
    min_train: int = 4,
    model: str = "window",
    hidden: int = 0,
    seed: int = 0,
) -> SequenceResult:
    """Forecasts and loss curves of one window model per entity.

    Without ``features`` the model is univariate. Scaling uses the training rows
    or, with ``fit_on="all"``, every row. Test rows are predicted recursively
    (own predictions fed back, other columns known) or one step ahead from true
    values. ``validate`` adds the test loss of every epoch. ``hidden`` units of
    a random recurrent layer (by ``seed``) make the model non-linear.

    Returns (forecasts: by, model, split, order, actual, forecast;
    losses: by, model, epoch, train_loss, val_loss), with the ``status`` of every
    entity (by, n_train, status) as an attribute.
    """
    by, cols = list(by), [target, *[c for c in features if c != target]]
    names = [f"_c{i}" for i in range(len(cols))]
    rows = df.select(
        *dict.fromkeys([*by, order]), F.col(split).alias("split"),
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(n) for c, n in zip(cols, names, strict=True)],
    )
    is_train = F.col("split") == "train"
    rows = minmax(rows.withColumn("actual", F.col("_c0")), names, by, None if fit_on == "all" else is_train, keep_stats=True)
    rows = rows.drop(*[f"{n}_{s}" for n in names[1:] for s in ("min", "max")])
    rows = numbered(rows, by, order, t="_t", n="_n")
    sizes = rows.groupBy(*by).agg(F.count(F.when(is_train, 1)).alias("_train"))
    refused = F.when(F.col("_train") < min_train, "too few observations").otherwise("ok")
    status = sizes.select(*by, F.col("_train").alias("n_train"), refused.alias("status"))
    rows = attach(rows, sizes, by, ["_train"]).filter(F.col("_train") >= min_train)
    ser = series(rows, by, order)
    vector = F.array(*[F.col(n) for n in names])
    past = {f"_p{j}": ser.shift(vector, j) for j in range(1, n_steps + 1)}
    rows = ser.df.withColumns(past).filter(F.col(f"_p{n_steps}").isNotNull())
    lags = [F.col(f"_p{j}") for j in range(1, n_steps + 1)]
    x = F.concat(F.array(F.lit(1.0)), *lags, F.array(F.col("_c0")))
    rows = rows.select(*by, order, "split", "actual", "_c0", "_c0_min", "_c0_max", x.alias("_x"))
    layer = Layer(hidden, len(cols), n_steps, seed)
    if hidden:
        rows = rows.mapInPandas(layer.joined("_x"), rows.schema)
    rows = settle(rows, "sequence-rows")
    k = 1 + n_steps * len(cols) + hidden

    moments = gram_wide(rows.filter(is_train), by, "_x", k + 1)
    if validate:
        held = gram_wide(rows.filter(F.col("split") == "test"), by, "_x", k + 1).withColumnRenamed("g", "v")
        moments = attach(moments, held, by, ["v"])
    else:
        moments = moments.withColumn("v", F.lit(None).cast("array<double>"))
    doubles = T.ArrayType(T.DoubleType())
    schema = T.StructType(
        [*[rows.schema[c] for c in by], *[T.StructField(c, doubles) for c in ("_b", "train_loss", "val_loss")]]
    )

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        g = unpack_batch(pdf["g"], k + 1)
        beta, curve, run = train_epochs(g[:, :k, :k], g[:, :k, k], g[:, k, k], epochs, patience, min_delta)
        curves = [c[:r].tolist() for c, r in zip(curve, run, strict=True)]
        val = [None] * len(pdf)
        for i, v in enumerate(pdf["v"]):
            if v is not None:
                val[i] = _held_out(g[i], unpack_batch([v], k + 1)[0], k, int(run[i]))
        return pdf[by].assign(_b=list(beta.tolist()), train_loss=curves, val_loss=pd.Series(val, dtype=object))

    models = settle(map_batches(moments, fit, schema), "sequence-models")
    rows = attach(rows, models, by, ["_b"]).filter(F.col("_b").isNotNull())
    products = F.zip_with(F.slice("_x", 1, k), "_b", lambda a, b: a * b)
    one_step = F.aggregate(products, F.lit(0.0), lambda s, v: s + v)
    rows = rows.withColumn("_one", one_step)

    def unscaled(c: str) -> Column:
        return inverse_minmax(c, {"min": "_c0_min", "max": "_c0_max"})

    head = [*by, F.lit(model).alias("model"), "split", order, "actual"]
    if not recursive:
        forecasts = rows.select(*head, unscaled("_one").alias("forecast"))
    else:
        fitted = rows.filter(is_train).select(*head, unscaled("_one").alias("forecast"))
        test = rows.filter(F.col("split") == "test")
        fed = _hidden_rollout(test, by, order, model, layer) if hidden else _rollout(test, by, order, model, n_steps, len(cols))
        forecasts = fitted.unionByName(fed)
    losses = models.select(
        *by, F.lit(model).alias("model"), F.posexplode("train_loss").alias("_i", "train_loss"), "val_loss"
    ).select(
        *by, "model", (F.col("_i") + 1).alias("epoch"), "train_loss", F.try_element_at("val_loss", F.col("_i") + 1).alias("val_loss")
    )
    return SequenceResult(forecasts, losses, status)


def _held_out(g: np.ndarray, v: np.ndarray, k: int, run: int) -> list[float]:
    """Loss on the held-out moments along the same training path."""
    n, m = max(g[0, 0], 1.0), max(v[0, 0], 1.0)
    a, b = g[:k, :k] / n, g[:k, k] / n
    step = 1 / max(2 * np.linalg.eigvalsh(a)[-1], 1e-12)
    beta, ahead, out = np.zeros(k), np.zeros(k), []
    for epoch in range(run):
        new = ahead - step * 2 * (a @ ahead - b)
        ahead = new + epoch / (epoch + 3) * (new - beta)
        beta = new
        out.append(float(max(v[k, k] - 2 * beta @ v[:k, k] + beta @ v[:k, :k] @ beta, 0.0) / m))
    return out


def _rollout(test: DataFrame, by: list[str], order: str, model: str, n_steps: int, width: int) -> DataFrame:
    """Feed predictions back over the test rows of each entity.

    Per row only the target's own lags change, so the known part of a prediction
    is computed row by row and is the input of a recursion in the last
    ``n_steps`` targets.
    """
    at = [1 + j * width for j in range(n_steps)]
    own = reduce(lambda a, b: a + b, [F.col("_x")[i] * F.col("_b")[i] for i in at])
    place = F.row_number().over(Window.partitionBy(*by).orderBy(order)).cast("long")
    test = test.withColumn("step", place)
    row = F.struct(F.col(order).alias("period"), "actual")
    steps = test.select(*by, "step", (F.col("_one") - own).alias("x"), row.alias("row"))
    lags = [F.col("_x")[i] for i in at]
    starts = test.filter("step = 1").select(
        *by, F.array(*[F.col("_b")[i] for i in at]).alias("coefs"), F.array(*lags, F.lit(0.0), F.lit(0.0)).alias("state"), F.lit(0).alias("d"),
        "_c0_min", "_c0_max",
    )
    paths = attach(affine_paths(steps, starts, by), starts, by, ["_c0_min", "_c0_max"])
    return paths.select(
        *by, F.lit(model).alias("model"), F.lit("test").alias("split"), F.col("row.period").alias(order), F.col("row.actual").alias("actual"),
        inverse_minmax("value", {"min": "_c0_min", "max": "_c0_max"}).alias("forecast"),
    )


def _hidden_rollout(test: DataFrame, by: list[str], order: str, model: str, layer: Layer) -> DataFrame:
    """The same for a model that is not linear in what is fed back, so that its steps cannot be chained.

    Entities are dealt to tasks, and a task takes one step of all its entities at
    a time, as rows arrive sorted by step; it holds their last predictions alone.
    """
    place = F.row_number().over(Window.partitionBy(*by).orderBy(order)).cast("long")
    rows = test.withColumn("_step", place).repartition(*by).sortWithinPartitions("_step")
    rows = rows.select(*by, order, "actual", "_step", "_x", "_b", "_c0_min", "_c0_max")
    at = [1 + j * layer.width for j in range(layer.n_steps)]
    linear = 1 + layer.n_steps * layer.width
    schema = T.StructType([*[rows.schema[c] for c in [*by, order, "actual", "_c0_min", "_c0_max"]], T.StructField("value", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, places, lags = layer.weights(), {}, np.zeros((0, layer.n_steps))
        for pdf in batches:
            out = np.empty(len(pdf))
            names = list(zip(*[pdf[c] for c in by])) if by else [()] * len(pdf)
            entity = np.array([places.setdefault(n, len(places)) for n in names], int)
            lags = np.concatenate([lags, np.zeros((len(places) - len(lags), layer.n_steps))])
            step = pdf["_step"].to_numpy()
            for i in np.split(np.arange(len(pdf)), np.flatnonzero(np.diff(step)) + 1):
                if not len(i):
                    continue
                x = np.vstack(pdf["_x"].to_numpy()[i]).astype(float)[:, :linear]
                own = entity[i]
                if step[i[0]] == 1:
                    lags[own] = x[:, at]
                x[:, at] = lags[own]
                beta = np.vstack(pdf["_b"].to_numpy()[i]).astype(float)
                y = (np.concatenate([x, layer.outputs(x, weights)], axis=1) * beta).sum(axis=1)
                lags[own] = np.concatenate([y[:, None], lags[own][:, :-1]], axis=1)
                out[i] = y
            yield pdf[[*by, order, "actual", "_c0_min", "_c0_max"]].assign(value=out)

    paths = rows.mapInPandas(run, schema)
    return paths.select(
        *by, F.lit(model).alias("model"), F.lit("test").alias("split"), order, "actual",
        inverse_minmax("value", {"min": "_c0_min", "max": "_c0_max"}).alias("forecast"),
    )
