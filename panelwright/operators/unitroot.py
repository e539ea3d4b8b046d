"""Augmented Dickey-Fuller test and differencing order for many series at once."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.functions.special import adf_critical, adf_p_value
from panelwright.operators.gram import lag_products, map_batches
from panelwright.operators.impute import attach
from panelwright.operators.series import numbered, series

_OUT = "statistic double, n_lags_used int, nobs int, icbest double, status string"


def _max_lag(n: int) -> int:
    return min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)


def nested_rss(x: np.ndarray, y: np.ndarray, yy: np.ndarray, tol: float = 1e-13) -> tuple[np.ndarray, np.ndarray]:
    """Residual sums with the first 1, 2, ... k regressors, for many systems (m, k, k) at once.

    One factorisation serves all of them: eliminating regressor by regressor, what
    is left of ``yy`` is the residual sum so far. Also (m, k): whether a
    regressor depends on those before it (its residual sums are infinite).
    """
    m, k = y.shape
    a = np.empty((m, k + 1, k + 1))
    a[:, :k, :k], a[:, k, :k], a[:, :k, k], a[:, k, k] = x, y, y, yy
    size = np.diagonal(x, axis1=1, axis2=2).copy()
    out, bad = np.empty((m, k)), np.zeros((m, k), bool)
    for j in range(k):
        pivot = a[:, j, j]
        bad[:, j] = ~(pivot > tol * size[:, j])
        row = a[:, j, j + 1 :] / np.where(bad[:, j], 1.0, pivot)[:, None]
        row[bad[:, j]] = 0.0
        a[:, j + 1 :, j + 1 :] -= row[:, :, None] * a[:, j, None, j + 1 :]
        out[:, j] = a[:, k, k]
    out[np.logical_or.accumulate(bad, axis=1)] = np.inf
    return out, bad


def _padded(values, width: int, from_end: bool = False) -> np.ndarray:
    """Rows of equal length from lists, newest first if ``from_end``."""
    out = np.zeros((len(values), width))
    for i, v in enumerate(values):
        v = np.asarray(v, float)
        out[i, : len(v)] = v[::-1][:width] if from_end else v[:width]
    return out


def _lag_moments(pdf: pd.DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Moments of constant, level and lags on the common sample, (m, width + 2, width + 2) and so on, and the first values.

    Lags beyond a series' own limit are unit columns that explain nothing.
    """
    n, m = pdf["_n"].to_numpy(int), pdf["_m"].to_numpy(int)
    first = _padded(pdf["_head"], width + 2)
    last = _padded(pdf["_tail"], width + 3, from_end=True)
    s, g, r = (_padded(pdf[c], width + 1) for c in ("_s", "_g", "_r"))
    lag = np.arange(width + 1)
    own = lag <= m[:, None]
    at = np.clip(m[:, None] + 1 - lag, 1, width + 1)
    start = np.where(own, np.take_along_axis(first, at, 1) - np.take_along_axis(first, at - 1, 1), 0.0)
    end = np.zeros_like(start)
    end[:, 1:] = np.where(own[:, 1:], last[:, :width] - last[:, 1 : width + 1], 0.0)
    x = np.zeros((len(pdf), width + 2, width + 2))
    x[:, 0, 0], x[:, 0, 1], x[:, 1, 1] = n - 1 - m, pdf["_z1"].fillna(0.0), pdf["_z11"].fillna(0.0)
    x[:, 0, 2:], x[:, 1, 2:] = np.where(own, s, 0.0)[:, 1:], np.where(own, g, 0.0)[:, 1:]
    x[:, 2:, 2:] = lag_products(r, start, end, own)[:, 1:, 1:]
    x = np.triu(x) + np.triu(x, 1).transpose(0, 2, 1)
    spare = np.arange(width + 2) > m[:, None] + 1
    x[:, np.arange(width + 2), np.arange(width + 2)] += spare
    y = np.concatenate([s[:, :1], g[:, :1], np.where(own, r, 0.0)[:, 1:]], axis=1)
    return x, y, r[:, 0], first, spare


def _fit_batch(pdf: pd.DataFrame, width: int) -> pd.DataFrame:
    """Many series at once: choose the lag on the common sample, refit on all rows."""
    n, m, sd = pdf["_n"].to_numpy(int), pdf["_m"].to_numpy(int), pdf["_sd"].fillna(0.0).to_numpy(float)
    x, y, yy, first, _ = _lag_moments(pdf, width)
    rows = (n - 1 - m).astype(float)
    short = (n < 4) | (m < 0) | (rows < 1)
    flat = (n >= 4) & ~(sd > 0)
    x[short | flat] = np.eye(width + 2)
    lag = pdf["_fixed"].to_numpy(int).copy()
    best = np.full(len(pdf), np.nan)
    if (lag < 0).any():
        rss, _ = nested_rss(x, y, yy)
        with np.errstate(all="ignore"):
            level = np.log(2 * np.pi * np.maximum(rss[:, 1:], 0) / rows[:, None]) + 1 + 2 * np.log(sd)[:, None]
            aic = rows[:, None] * level + 2 * np.arange(2, width + 3)
        aic[np.arange(width + 1) > m[:, None]] = np.inf
        aic[np.isnan(aic)] = np.inf
        found = np.argmin(aic, axis=1)
        best = np.where(lag < 0, aic[np.arange(len(pdf)), found], best)
        lag = np.where(lag < 0, found, lag)
    # The chosen regressors, with the rows that the common sample left out.
    spare = np.arange(width + 2) > lag[:, None] + 1
    x[spare[:, :, None] | spare[:, None, :]] = 0.0
    y = np.where(spare, 0.0, y)
    steps = np.diff(first, axis=1)
    for t in range(2, width + 2):
        more = (t >= lag + 2) & (t < m + 2)
        if more.any():
            back = np.zeros((len(pdf), width + 2))
            back[:, 0], back[:, 1] = 1.0, first[:, t - 2]
            back[:, 2 : t] = steps[:, : t - 2][:, ::-1]
            back = np.where(spare | ~more[:, None], 0.0, back)
            now = np.where(more, steps[:, t - 2], 0.0)
            x += back[:, :, None] * back[:, None, :]
            y += back * now[:, None]
            yy = yy + now * now
    x[:, np.arange(width + 2), np.arange(width + 2)] += spare
    _, bad = nested_rss(x, y, yy)
    singular = bad.any(axis=1)
    x[singular | short | flat] = np.eye(width + 2)
    unit = np.zeros((len(pdf), width + 2, 1))
    unit[:, 1] = 1.0
    solved = np.linalg.solve(x, np.concatenate([y[:, :, None], unit], axis=2))
    beta, spread = solved[:, :, 0], solved[:, 1, 1]
    left = yy - np.einsum("mi,mi->m", beta, y)
    dof = n - 1 - lag - lag - 2
    status = np.select(
        [n < 4, flat, short, singular, dof <= 0, (left <= 1e-13 * yy) | (spread <= 0)],
        ["too few observations", "constant series", "too few observations", "singular regressors", "too few observations", "perfect fit"],
        "ok",
    )
    with np.errstate(all="ignore"):
        tau = beta[:, 1] / np.sqrt(left / dof * spread)
    ok = status == "ok"
    number = lambda v: pd.Series(v).astype("Int32").where(ok)
    return pd.DataFrame(
        {
            "statistic": pd.Series(tau).where(ok).astype(object).where(ok, None), "n_lags_used": number(lag), "nobs": number(n - 1 - lag),
            "icbest": pd.Series(best).astype(object).where(ok & np.isfinite(best), None), "status": status,
        }
    )


def _edges(width: int) -> list[Column]:
    """Per series: its size and its first and last few values."""
    point = F.struct(F.col("_t").alias("t"), F.col("_z").alias("z"))
    few = lambda where: F.sort_array(F.collect_list(F.when(where, point))).getField("z")
    return [
        F.max("_n").alias("_n"),
        F.max("_m").alias("_m"),
        F.max("_sd").alias("_sd"),
        few(F.col("_t") <= width + 2).alias("_head"),
        few(F.col("_t") >= F.col("_n") - width - 2).alias("_tail"),
    ]


def _moments(rows: DataFrame, by: list[str], order: list[str], width: int, layout: str) -> DataFrame:
    """Sums of products of the newest difference and the level with every lag."""
    ser = series(rows, by, order, back=width + 1, layout=layout)
    past = {f"_l{k}": ser.shift("_z", k) for k in range(1, width + 2)}
    rows = ser.finish(ser.df.withColumns(past))
    # As text, many sums are one call. Rows before the common sample add nothing.
    steps = [f"{'_z' if j == 0 else f'_l{j}'} - _l{j + 1} AS _d{j}" for j in range(width + 1)]
    rows = rows.selectExpr("*", "_t >= _m + 2 AS _use", *steps)

    def sums(value: str) -> Column:
        cells = [f"coalesce(sum({value.format(j)}) FILTER (WHERE _use), 0D)" for j in range(width + 1)]
        return F.expr(f"array({', '.join(cells)})")

    return rows.groupBy(*by).agg(
        *_edges(width),
        F.expr("sum(_l1) FILTER (WHERE _use)").alias("_z1"),
        F.expr("sum(_l1 * _l1) FILTER (WHERE _use)").alias("_z11"),
        sums("_d{}").alias("_s"),
        sums("_l1 * _d{}").alias("_g"),
        sums("_d0 * _d{}").alias("_r"),
    )


def _block_moments(rows: DataFrame, by: list[str], order: list[str], width: int, layout: str) -> DataFrame:
    """The same sums for pooled and very long series.

    Each block of rows (with the rows its lags reach) is reduced to one array of
    sums per series in it; the arrays are added up element by element.
    """
    ser = series(rows, by, order, back=width + 1, layout="blocks")
    rows = rows.drop("_pos")
    blocks = ser.df.select(*by, "_block", "_pos", "_core", "_t", "_m", "_z")
    schema = T.StructType([*[rows.schema[c] for c in by], T.StructField("_p", T.ArrayType(T.DoubleType()))])

    def reduce_block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos").reset_index(drop=True)
        z, t, m = (pdf[c].to_numpy() for c in ("_z", "_t", "_m"))
        at = np.flatnonzero(pdf["_core"].to_numpy() & (t >= m + 2))
        if not len(at):
            return pdf[by].iloc[:0].assign(_p=pd.Series([], dtype=object))
        starts = np.r_[0, np.flatnonzero(np.diff(np.cumsum(t == 1)[at])) + 1]
        d = np.r_[0.0, np.diff(z)]
        level, newest, limit = z[at - 1], d[at], m[at]
        parts = [np.add.reduceat(level, starts), np.add.reduceat(level * level, starts)]
        lagged = [np.where(limit >= j, d[np.maximum(at - j, 0)], 0.0) for j in range(width + 1)]
        for factor in (1.0, level, newest):
            parts += [np.add.reduceat(factor * v, starts) for v in lagged]
        out = pdf[by].iloc[at[starts]].reset_index(drop=True)
        out["_p"] = list(np.array(parts).T.tolist())
        return out

    cells = blocks.groupBy("_block").applyInPandas(reduce_block, schema)
    cells = cells.select(*by, F.posexplode("_p").alias("_i", "_v")).groupBy(*by, "_i").agg(F.sum("_v").alias("_v"))
    packed = cells.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_i", "_v"))).alias("_c"))
    values, k = F.col("_c._v"), width + 1
    packed = packed.select(
        *by,
        values[0].alias("_z1"),
        values[1].alias("_z11"),
        *[F.slice(values, 3 + i * k, k).alias(name) for i, name in enumerate(("_s", "_g", "_r"))],
    )
    edges = rows.groupBy(*by).agg(*_edges(width))
    sums = ["_z1", "_z11", "_s", "_g", "_r"]
    out = attach(edges, packed, by, sums)
    # Series without a single usable row have no sums; their status says so.
    nothing = F.array_repeat(F.lit(0.0), k)
    return out.withColumns({c: F.coalesce(c, F.lit(0.0) if c in ("_z1", "_z11") else nothing) for c in sums})


def adf(
    df: DataFrame,
    col: str,
    by: Sequence[str] = ("industry",),
    order: Sequence[str] | str = "year",
    lag: int | None = None,
    signif: float = 0.05,
    layout: str = "panel",
) -> DataFrame:
    """Unit-root test with a constant; the lag is chosen by AIC unless given.

    Each series may use up to ceil(12 (n/100)^(1/4)) lags. One pass sums the
    products of the newest row with each lag; all other cross products follow
    from these and the first and last few values of a series, so the width of
    the aggregation grows with the number of lags, not with its square. One
    factorisation per series then gives the residual sum of every shorter lag.
    In the ``blocks`` layout the sums are taken block by block in numpy.
    """
    by = list(by)
    rows = df.filter(F.col(col).isNotNull() & ~F.isnan(col))
    order_cols = [order] if isinstance(order, str) else list(order)
    rows = rows.select(*dict.fromkeys([*by, *order_cols]), F.col(col).cast("double").alias("_y"))
    stats = rows.groupBy(*by).agg(
        F.count("_y").alias("_n"),
        F.avg("_y").alias("_mean"),
        F.when(F.min("_y") == F.max("_y"), 0.0).otherwise(F.stddev_pop("_y")).alias("_sd"),
    )
    # Longest series: it sets how many lag columns the plan needs.
    longest = stats.agg(F.max("_n")).first()[0] or 0
    width = max(0, _max_lag(longest)) if lag is None else lag
    n = F.col("_n")
    if lag is None:
        m = F.least(F.ceil(12 * F.pow(n / 100, F.lit(0.25))), F.floor(n / 2) - 2)
    else:
        m = F.lit(lag)
    z = F.when(F.col("_sd") > 0, (F.col("_y") - F.col("_mean")) / F.col("_sd")).otherwise(0.0)
    rows = attach(rows, stats, by, ["_n", "_mean", "_sd"]).withColumn("_z", z).withColumn("_m", m.cast("int"))
    rows = numbered(rows, by, order_cols, layout, "_t", "_len", keep_pos=True).drop("_len")
    moments = (_moments if layout == "panel" and by else _block_moments)(rows, by, order_cols, width, layout)
    moments = moments.withColumn("_fixed", F.lit(-1 if lag is None else lag))
    schema = T.StructType([*[moments.schema[k] for k in by], *T.StructType.fromDDL(_OUT).fields])
    out = map_batches(moments, lambda pdf: pd.concat([pdf[by], _fit_batch(pdf, width)], axis=1), schema)
    p = adf_p_value(F.col("statistic"))
    crit = adf_critical(F.col("nobs").cast("double"))
    return (
        out.withColumn("p_value", F.when(F.col("statistic").isNotNull(), p))
        .withColumns({k: F.when(F.col("statistic").isNotNull(), c) for k, c in crit.items()})
        .withColumn("stationary", F.col("p_value") < signif)
        .select(
            *by,
            F.col("statistic").alias("test_statistic"),
            "p_value",
            "n_lags_used",
            F.col("nobs").alias("n_obs"),
            *crit,
            "icbest",
            "stationary",
            "status",
        )
    )


def differencing_order(
    df: DataFrame,
    col: str,
    by: Sequence[str] = ("industry",),
    order: str = "year",
    signif: float = 0.05,
    layout: str = "panel",
) -> DataFrame:
    """Smallest number of differences (0 to 2) that makes each series stationary.

    All three differences are tested side by side, with d as part of the key.
    A series that is too short, constant or untestable at some d stops there.
    """
    by = list(by)
    ser = series(df.filter(F.col(col).isNotNull()), by, order, back=2, layout=layout)
    l0, l1, l2 = (ser.shift(col, k) for k in range(3))
    wide = ser.finish(ser.df.withColumns({"_w0": l0, "_w1": l0 - l1, "_w2": l0 - 2 * l1 + l2}))
    long = wide.select(
        *by, order, F.inline(F.array(*[F.struct(F.lit(d).alias("d"), F.col(f"_w{d}").alias("_w")) for d in range(3)]))
    )
    # A series of one or two rows has no rows at d = 1, 2: the short d decides.
    tests = adf(long, "_w", [*by, "d"], order, signif=signif, layout=layout)
    stop = (F.col("status") != "ok") | F.col("stationary")
    return tests.groupBy(*by).agg(F.coalesce(F.min(F.when(stop, F.col("d"))), F.lit(2)).alias("d"))
