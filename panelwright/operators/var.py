"""Vector autoregression and impulse responses for many entities at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.operators.derive import clean_numeric
from panelwright.operators.gram import map_batches
from panelwright.operators.impute import attach
from panelwright.operators.series import numbered, series

_OUT = (
    "lag_order int, nobs int, intercept array<double>, coefs array<double>, sigma_u array<double>, "
    "bic double, status string"
)


def _points(values, k: int, width: int, from_end: bool = False) -> np.ndarray:
    """(m, width, k): the first vectors of each series, or its last ones, newest first."""
    out = np.zeros((len(values), width, k))
    for i, v in enumerate(values):
        z = np.array([np.asarray(x, float) for x in v]).reshape(-1, k)
        z = z[::-1][:width] if from_end else z[:width]
        out[i, : len(z)] = z
    return out


def _joint_moments(pdf: pd.DataFrame, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Moments of constant, lags and the current vector on the common sample, and the first vectors.

    Blocks of products one lag further follow by one row entering the sample and
    one leaving it. Lags beyond a series' own limit are unit columns.
    """
    n, own = pdf["_n"].to_numpy(int), pdf["_m"].to_numpy(int)
    m = len(pdf)
    head, tail = _points(pdf["_head"], k, width + 1), _points(pdf["_tail"], k, width + 1, from_end=True)
    c = np.vstack([np.asarray(v, float) for v in pdf["_c"]]).reshape(m, width + 1, k, k)
    lag = np.arange(1, width + 1)
    used = lag <= own[:, None]
    at = np.clip(own[:, None] - lag, 0, width)
    # Lag l enters with the vector at own + 1 - l and leaves with the l-th last one.
    start = np.where(used[:, :, None], np.take_along_axis(head, at[:, :, None], 1), 0.0)
    end = np.where(used[:, :, None], tail[:, :width], 0.0)
    size = 1 + k * width
    x = np.zeros((m, size + k, size + k))
    x[:, 0, 0] = n - own
    total = np.vstack([np.asarray(v, float) for v in pdf["_s"]])
    x[:, 0, size:] = total
    x[:, size:, size:] = c[:, 0]
    prev = c
    for i in range(1, width + 1):
        a = slice(1 + k * (i - 1), 1 + k * i)
        total = total + start[:, i - 1] - end[:, i - 1]
        x[:, 0, a] = np.where(used[:, i - 1, None], total, 0.0)
        x[:, a, size:] = np.where(used[:, i - 1, None, None], c[:, i].transpose(0, 2, 1), 0.0)
        entering = np.einsum("ma,mjb->mjab", start[:, i - 1], start[:, i - 1 :])
        prev = prev[:, : width + 1 - i] + entering - np.einsum("ma,mjb->mjab", end[:, i - 1], end[:, i - 1 :])
        prev = np.where(used[:, i - 1 :, None, None], prev, 0.0)
        for j in range(width + 1 - i):
            b = slice(1 + k * (i + j - 1), 1 + k * (i + j))
            x[:, a, b] = prev[:, j]
    x = np.triu(x) + np.triu(x, 1).transpose(0, 2, 1)
    spare = np.zeros((m, size + k), bool)
    spare[:, 1:size] = np.repeat(~used, k, axis=1)
    x[:, np.arange(size + k), np.arange(size + k)] += spare
    return x, head


def _eliminated(x: np.ndarray, size: int, tol: float = 1e-13) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(regressors so far, what is left of the last columns' products, which systems are singular by then)."""
    a, scale = x.copy(), np.diagonal(x, axis1=1, axis2=2).copy()
    bad = np.zeros(len(x), bool)
    for j in range(size):
        pivot = a[:, j, j]
        bad |= ~(pivot > tol * scale[:, j])
        row = a[:, j, j + 1 :] / np.where(bad, 1.0, pivot)[:, None]
        row[bad] = 0.0
        a[:, j + 1 :, j + 1 :] -= row[:, :, None] * a[:, j, None, j + 1 :]
        yield j + 1, a[:, size:, size:], bad


def _solve_batch(pdf: pd.DataFrame, k: int, width: int) -> pd.DataFrame:
    """Order by BIC on the common sample, then the fit on all rows, for many series at once."""
    n, own = pdf["_n"].to_numpy(int), pdf["_m"].to_numpy(int)
    m, size = len(pdf), 1 + k * width
    sd, mean = (np.vstack([np.asarray(v, float) for v in pdf[c]]) for c in ("_sd", "_mean"))
    few, flat = n < k + 2, (sd == 0).any(axis=1)
    x, head = _joint_moments(pdf, k, width)
    x[few | flat] = np.eye(size + k)
    rows = np.maximum(n - own, 1).astype(float)
    bic = np.full((m, width + 1), np.inf)
    stopped = np.zeros(m, bool)
    for q, left, bad in _eliminated(x, size):
        if (q - 1) % k == 0:
            p = (q - 1) // k
            sign, value = np.linalg.slogdet(left / rows[:, None, None])
            stopped |= bad | (rows <= q) | (p > own) | (sign <= 0)
            bic[:, p] = np.where(stopped, np.inf, value + np.log(rows) / rows * k * q)
    best = bic.min(axis=1)
    p = np.maximum(1, np.where(np.isfinite(best), bic.argmin(axis=1), 1))
    keep = np.concatenate([np.ones((m, 1), bool), np.repeat(np.arange(1, width + 1) <= p[:, None], k, axis=1), np.ones((m, k), bool)], axis=1)
    x = np.where(keep[:, :, None] & keep[:, None, :], x, 0.0)
    for t in range(2, width + 1):
        # Rows that the common sample left out.
        more = (t > p) & (t <= own)
        if more.any():
            v = np.zeros((m, size + k))
            v[:, 0] = 1.0
            v[:, 1 : 1 + k * (t - 1)] = head[:, t - 2 :: -1].reshape(m, -1)[:, : k * (t - 1)]
            v[:, size:] = head[:, t - 1]
            v = np.where(keep & more[:, None], v, 0.0)
            x += v[:, :, None] * v[:, None, :]
    x[:, np.arange(size + k), np.arange(size + k)] += ~keep
    singular = np.zeros(m, bool)
    for _, left, bad in _eliminated(x, size):
        singular = bad
    total, q = n - p, 1 + k * p
    status = np.select(
        [few, flat, total < q, singular], ["too few observations", "constant column", "too few observations", "singular regressors"], "ok"
    )
    ok = status == "ok"
    x[~ok] = np.eye(size + k)
    beta = np.linalg.solve(x[:, :size, :size], x[:, :size, size:])
    sigma = left / np.maximum(total - q, 1)[:, None, None] * sd[:, :, None] * sd[:, None, :]
    with np.errstate(all="ignore"):
        lags = beta[:, 1:].reshape(m, width, k, k).transpose(0, 1, 3, 2) * (sd[:, :, None] / sd[:, None, :])[:, None]
        const = mean + sd * beta[:, 0] - np.einsum("mpij,mj->mi", np.where(np.isfinite(lags), lags, 0.0), mean)
        level = best + 2 * np.log(sd).sum(axis=1)
    whole = lambda v: pd.Series(v).astype("Int32").where(ok)
    return pd.DataFrame(
        {
            "lag_order": whole(p), "nobs": whole(total),
            "intercept": [v.tolist() if o else None for v, o in zip(const, ok)],
            "coefs": [v[:i].ravel().tolist() if o else None for v, i, o in zip(lags, p, ok)],
            "sigma_u": [v.ravel().tolist() if o else None for v, o in zip(sigma, ok)],
            "bic": pd.Series(level).astype(object).where(ok & np.isfinite(level), None), "status": status,
        }
    )


def fit_var(
    df: DataFrame,
    cols: Sequence[str],
    by: Sequence[str] = ("industry",),
    order: Sequence[str] | str = "year",
    maxlags: int = 5,
    layout: str = "panel",
) -> DataFrame:
    """VAR(p) with a constant per group; p by BIC on a common sample, at least 1.

    The lag limit is min(maxlags, max(1, (n - 1) // k - 1)). One aggregation sums
    the products of the current vector with each lag; the other products and the
    refit on all rows follow from the first and last few vectors of a series.
    """
    by, cols, k = list(by), list(cols), len(cols)
    order_cols = [order] if isinstance(order, str) else list(order)
    rows = clean_numeric(df.withColumns({c: F.col(c).cast("double") for c in cols}), cols).na.drop(subset=cols)
    stats = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"),
        F.array(*[F.avg(c) for c in cols]).alias("_mean"),
        F.array(*[F.when(F.min(c) == F.max(c), 0.0).otherwise(F.stddev_pop(c)) for c in cols]).alias("_sd"),
    )
    limit = F.least(F.lit(maxlags), F.greatest(F.lit(1), F.floor((F.col("_n") - 1) / k) - 1)).cast("int")
    rows = attach(rows.select(*dict.fromkeys([*by, *order_cols, *cols])), stats, by, ["_n", "_mean", "_sd"])
    scaled = [
        F.when(F.col("_sd")[i] > 0, (F.col(c) - F.col("_mean")[i]) / F.col("_sd")[i]).otherwise(0.0)
        for i, c in enumerate(cols)
    ]
    rows = rows.withColumns({f"_v{i}": z for i, z in enumerate(scaled)}).withColumn("_m", limit)
    rows = numbered(rows, by, order_cols, layout, "_t", "_len", keep_pos=True)
    ser = series(rows, by, order_cols, back=maxlags, layout=layout)
    lags = {f"_v{i}_{j}": ser.shift(f"_v{i}", j) for j in range(1, maxlags + 1) for i in range(k)}
    rows = ser.finish(ser.df.withColumns(lags))
    now = [f"_v{i}" for i in range(k)]
    # As text: many sums are one call.
    cells = [
        f"coalesce(sum({a} * {b}{f'_{j}' if j else ''}) FILTER (WHERE _t > _m), 0D)"
        for j in range(maxlags + 1)
        for a in now
        for b in now
    ]
    totals = [f"coalesce(sum({a}) FILTER (WHERE _t > _m), 0D)" for a in now]
    point = F.struct(F.col("_t").alias("t"), F.array(*now).alias("z"))
    moments = rows.groupBy(*by).agg(
        F.max("_n").alias("_n"),
        F.max("_m").alias("_m"),
        F.any_value("_mean").alias("_mean"),
        F.any_value("_sd").alias("_sd"),
        F.expr(f"array({', '.join(cells)})").alias("_c"),
        F.expr(f"array({', '.join(totals)})").alias("_s"),
        F.sort_array(F.collect_list(F.when(F.col("_t") <= maxlags + 1, point))).getField("z").alias("_head"),
        F.sort_array(F.collect_list(F.when(F.col("_t") >= F.col("_n") - maxlags, point))).getField("z").alias("_tail"),
    )
    schema = T.StructType([*[moments.schema[c] for c in by], *T.StructType.fromDDL(_OUT).fields])
    out = map_batches(moments, lambda pdf: pd.concat([pdf[by], _solve_batch(pdf, k, maxlags)], axis=1), schema)
    return out.withColumnRenamed("nobs", "n_obs").withColumn("variables", F.array(*[F.lit(c) for c in cols]))


def var_coefficients(var: DataFrame, by: Sequence[str] = ("industry",)) -> DataFrame:
    """Coefficients as rows: (equation, lag, variable, value)."""
    k = F.size("variables")
    rows = var.filter("status = 'ok'").select(*by, "variables", F.posexplode("coefs").alias("_i", "value"))
    return rows.select(
        *by,
        F.col("variables")[(F.floor(F.col("_i") / k) % k).cast("int")].alias("equation"),
        (F.floor(F.col("_i") / (k * k)) + 1).cast("int").alias("lag"),
        F.col("variables")[(F.col("_i") % k).cast("int")].alias("variable"),
        "value",
    )


def impulse_response(
    var: DataFrame,
    steps: int = 10,
    response: str = "free_cash_flow",
    by: Sequence[str] = ("industry",),
    scale: str = "unit",
) -> DataFrame:
    """Response of one variable to an impulse in each other one, horizon 0..steps.

    Impulses are one unit, or with ``scale="sd"`` one residual deviation.
    """
    by = list(by)

    fits = var.filter(F.col("status") == "ok")
    schema = T.StructType([*[var.schema[c] for c in [*by, "variables"]], T.StructField("path", T.ArrayType(T.DoubleType()))])

    def respond(pdf: pd.DataFrame) -> pd.DataFrame:
        names = list(pdf["variables"].iloc[0])
        k, p = len(names), pdf["lag_order"].to_numpy(int)
        a = np.zeros((len(pdf), p.max(), k, k))
        for i, v in enumerate(pdf["coefs"]):
            a[i, : p[i]] = np.asarray(v, float).reshape(-1, k, k)
        phi = np.zeros((len(pdf), steps + 1, k, k))
        phi[:, 0] = np.eye(k)
        for h in range(1, steps + 1):
            for j in range(1, min(h, p.max()) + 1):
                phi[:, h] += phi[:, h - j] @ a[:, j - 1]
        path = phi[:, :, names.index(response)]
        if scale == "sd":
            sigma = np.vstack([np.asarray(v, float) for v in pdf["sigma_u"]]).reshape(-1, k, k)
            path = path * np.sqrt(np.diagonal(sigma, axis1=1, axis2=2))[:, None, :]
        return pdf[[*by, "variables"]].assign(path=path.reshape(len(pdf), -1).tolist())

    one = map_batches(fits, respond, schema)
    k = F.size("variables")
    rows = one.select(*by, "variables", F.posexplode("path").alias("_i", "response"))
    impulse = F.col("variables")[(F.col("_i") % k).cast("int")]
    return rows.select(
        *by, impulse.alias("impulse"), F.floor(F.col("_i") / k).cast("int").alias("horizon"), "response"
    ).filter(F.col("impulse") != response)
