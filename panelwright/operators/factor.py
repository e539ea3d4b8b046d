"""Common factor of several measures: principal component and dynamic filter."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.functions.scalar import dot
from panelwright.operators.derive import clean_numeric
from panelwright.operators.gram import gram, map_rows, unpack
from panelwright.operators.impute import attach, impute_median, standardize
from panelwright.operators.series import numbered, series
from panelwright.session import settle

# Fixed value: fewest rows, of all groups together, from which a factor is extracted.
MIN_OBS = 20
#: Fewest rows of one group that give it loadings of its own.
GROUP_OBS = 3


def _prepared(df: DataFrame, cols: Sequence[str], by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Add the cleaned, imputed and standardised columns as ``_z0, _z1, ...``."""
    names = [f"_z{i}" for i in range(len(cols))]
    rows = df.withColumns({n: F.col(c).cast("double") for n, c in zip(names, cols, strict=True)})
    return standardize(impute_median(clean_numeric(rows, names), names, by), names, by), names


def _loadings(k: int, min_obs: int):
    def solve(row: dict) -> dict:
        n = int(row["n"])
        if n < min_obs:
            return {"status": "too few observations"}
        cov = unpack(row["g"], k) / n
        w, v = np.linalg.eigh(cov)
        first = v[:, -1]
        if w[-1] <= 0:
            return {"status": "constant columns"}
        if first[0] < 0:
            first = -first
        noise = np.clip(np.diag(cov) - w[-1] * first**2, 1e-6, None)
        return {
            "loadings": first.tolist(),
            "noise": noise.tolist(),
            "variance": float(w[-1]),
            "share": float(w[-1] / np.trace(cov)),
            "status": "ok",
        }

    return solve


_LOADINGS = "loadings array<double>, noise array<double>, variance double, share double, status string"


def factor_loadings(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), min_obs: int = MIN_OBS) -> DataFrame:
    """Loadings of the first principal component, its variance and share, per group."""
    rows, names = _prepared(df, cols, by)
    moments = gram(rows, by, [F.col(c) for c in names])
    return map_rows(moments, _loadings(len(cols), min_obs), _LOADINGS, [*by, "n"])


def pca_factor(
    df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), name: str = "liquidity_factor_pca", min_obs: int = MIN_OBS
) -> DataFrame:
    """Add the first principal factor; it never correlates negatively with the first column.

    Only the k-by-k moments leave the rows; scores are a projection expression.
    """
    cols = [c for c in cols if c in df.columns]
    if not cols:
        raise ValueError("none of the factor columns exist")
    rows, names = _prepared(df, cols, by)
    moments = gram(rows, by, [F.col(c) for c in names])
    loads = map_rows(moments, _loadings(len(cols), min_obs), _LOADINGS, [*by, "n"])
    rows = attach(rows, loads, by, ["loadings"])
    score = dot([F.col("loadings")[i] for i in range(len(cols))], [F.col(c) for c in names])
    return rows.withColumn(name, score).drop("loadings", *names)


def _gains(phi: float, q: float, info: float, start: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Predicted and filtered state variance for places start+1..start+n.

    The recursion does not depend on the data and settles quickly: a block in the
    middle of a series replays it only until it stands still.
    """
    pred, settled = q / (1 - phi * phi), False
    preds = np.empty(n)
    for i in range(start + n):
        if i >= start:
            preds[i - start] = pred
        after = phi * phi * pred / (1 + info * pred) + q
        settled = abs(after - pred) <= 1e-15 * pred
        pred = after
        if settled:
            preds[max(i + 1 - start, 0) :] = pred
            break
    return preds, preds / (1 + info * preds)


def linear_scan(keep: np.ndarray, drive: np.ndarray, start: float) -> np.ndarray:
    """All states of s(t) = keep(t) s(t-1) + drive(t), by repeated doubling.

    Neighbouring steps are merged into steps of twice the length until the oldest
    state no longer matters, so the work is vectorised.
    """
    a, s = keep.copy(), drive.copy()
    s[0] += a[0] * start
    a[0] = 0.0
    shift = 1
    while shift < len(s) and np.abs(a[shift:]).max() > 1e-20:
        s[shift:] = s[shift:] + a[shift:] * s[:-shift]
        a[shift:] = a[shift:] * a[:-shift]
        shift *= 2
    return s


def _filter_block(pdf: pd.DataFrame, k: int, summary: bool) -> dict | pd.DataFrame:
    pdf = pdf.sort_values("_t")
    head = pdf.iloc[0]
    n = len(pdf)
    if head["loadings"] is None or not np.isfinite(head["_phi"]):
        if summary:
            return {"_a": 0.0, "_b": 0.0}
        return pdf.assign(_factor=np.nan, _shock=np.nan, _innovation=np.nan)
    load, noise = np.asarray(head["loadings"], float), np.asarray(head["noise"], float)
    phi, q = float(head["_phi"]), float(head["_q"])
    info = float((load * load / noise).sum())
    x = pdf[[f"_z{i}" for i in range(k)]].to_numpy(float)
    preds, filt = _gains(phi, q, info, int(head["_t"]) - 1, n)
    drive = filt * (x @ (load / noise))
    keep = phi * (1 - filt * info)
    start = 0.0 if summary else float(head["_carry"])
    out = linear_scan(keep, drive, start)
    if summary:
        return {"_a": float(np.prod(keep)), "_b": float(out[-1])}
    prior = np.r_[start, out[:-1]]
    error = (x[:, 0] - load[0] * phi * prior) / np.sqrt(load[0] ** 2 * preds + noise[0])
    return pdf.assign(_factor=out, _shock=error, _innovation=out - phi * prior)


def dynamic_factor(
    df: DataFrame,
    cols: Sequence[str],
    by: Sequence[str] = ("industry",),
    order: Sequence[str] | str = "year",
    min_obs: int = MIN_OBS,
    layout: str = "panel",
    block_rows: int = 100_000,
    factor: str = "liquidity_factor_dfm",
    shock: str = "liquidity_shock_dfm",
) -> DataFrame:
    """One-factor AR(1) model per group: filtered factor, shock and innovation.

    Loadings and noise come from the principal component, the AR(1) from its
    scores; the Kalman recursion of the scalar state then runs over each series.
    The shock is the standardised one-step error of the first column.

    In the block layout (always for pooled series) the recursion runs per block:
    a first pass gives each block's effect on the state as a straight line, the
    lines are chained, and a second pass starts each block at its carried state.
    """
    by = list(by)
    order_cols = [order] if isinstance(order, str) else list(order)
    blocked = layout != "panel" or not by
    k = len(cols)
    rows, names = _prepared(df, cols, by)
    rows = settle(rows, "factor-columns")
    # The panel as a whole has to be large enough; a yearly group never is by itself.
    least = GROUP_OBS if by and rows.count() >= min_obs else min_obs
    loads = map_rows(gram(rows, by, [F.col(c) for c in names]), _loadings(k, least), _LOADINGS, [*by, "n"])
    rows = attach(rows, loads, by, ["loadings", "noise"])
    score = dot([F.col("loadings")[i] for i in range(k)], [F.col(c) for c in names])
    rows = numbered(rows.withColumn("_score", score), by, order_cols, layout, "_t", "_n", keep_pos=True)
    ser = series(rows, by, order_cols, back=1, layout=layout)
    rows = settle(ser.finish(ser.df.withColumn("_before", ser.shift("_score", 1))), "factor-scores")

    pair = F.col("_before").isNotNull()
    f, b = F.col("_score"), F.col("_before")
    ar = rows.groupBy(*by).agg(
        F.sum(F.when(pair, f * b)).alias("_fb"),
        F.sum(F.when(pair, b * b)).alias("_bb"),
        F.sum(F.when(pair, f * f)).alias("_ff"),
        F.count(b).alias("_m"),
    )
    phi = F.greatest(F.least(F.try_divide(F.col("_fb"), F.col("_bb")), F.lit(0.999)), F.lit(-0.999))
    spread = (F.col("_ff") - 2 * F.col("_phi") * F.col("_fb") + F.col("_phi") * F.col("_phi") * F.col("_bb")) / F.col("_m")
    ar = ar.withColumn("_phi", phi).withColumn("_q", F.greatest(spread, F.lit(1e-10))).select(*by, "_phi", "_q")
    rows = attach(rows, ar, by, ["_phi", "_q"])

    extra = [T.StructField(c, T.DoubleType()) for c in ("_factor", "_shock", "_innovation")]
    if not blocked:
        rows = rows.withColumn("_carry", F.lit(0.0))
        groups = by
    else:
        rows = rows.withColumn("_block", F.floor((F.col("_t") - 1) / block_rows))
        groups = [*by, "_block"]
        lines_schema = T.StructType(
            [*[rows.schema[c] for c in groups], *[T.StructField(c, T.DoubleType()) for c in ("_a", "_b")]]
        )

        def line(pdf):
            return pd.DataFrame([{**{g: pdf[g].iloc[0] for g in groups}, **_filter_block(pdf, k, True)}])

        def chain(pdf):
            pdf = pdf.sort_values("_block")
            state, carried = 0.0, []
            for a, c in zip(pdf["_a"], pdf["_b"], strict=True):
                carried.append(state)
                state = a * state + c
            return pdf[groups].assign(_carry=carried)

        carry_schema = T.StructType([*[rows.schema[c] for c in groups], T.StructField("_carry", T.DoubleType())])
        lines = rows.groupBy(*groups).applyInPandas(line, lines_schema)
        # One line per block_rows rows: short even for a very long series.
        carry = lines.groupBy(*by).applyInPandas(chain, carry_schema)
        rows = attach(rows, carry, groups, ["_carry"])
    schema = T.StructType([*rows.schema.fields, *extra])
    out = rows.groupBy(*groups).applyInPandas(lambda pdf: _filter_block(pdf, k, False), schema)
    nan_to_null = lambda c: F.when(~F.isnan(c), F.col(c))
    return out.select(
        *df.columns,
        nan_to_null("_factor").alias(factor),
        nan_to_null("_shock").alias(shock),
        nan_to_null("_innovation").alias("factor_innovation"),
        F.col("_score").alias("_pca_score"),
    ).drop("_pca_score")


def fallback_factor(
    df: DataFrame,
    by: Sequence[str] = ("industry",),
    order: Sequence[str] | str = "year",
    pca: str = "liquidity_factor_pca",
    factor: str = "liquidity_factor_dfm",
    shock: str = "liquidity_shock_dfm",
    layout: str = "panel",
) -> DataFrame:
    """Principal factor in place of the dynamic one; its first difference is the shock.

    Fills only where ``factor`` is null or absent. The first shock is 0.
    """
    ser = series(df, by, order, back=1, layout=layout)
    step = F.coalesce(F.col(pca) - ser.shift(pca, 1), F.lit(0.0))
    rows = ser.finish(ser.df.withColumn("_step", step))
    if factor not in df.columns:
        return rows.withColumn(factor, F.col(pca)).withColumn(shock, F.col("_step")).drop("_step")
    missing = F.col(factor).isNull()
    return (
        rows.withColumn(shock, F.when(missing, F.col("_step")).otherwise(F.col(shock)))
        .withColumn(factor, F.coalesce(factor, pca))
        .drop("_step")
    )


def liquidity_factors(
    df: DataFrame, cols: Sequence[str], by: Sequence[str] = ("industry",), order: Sequence[str] | str = "year", layout: str = "panel"
) -> DataFrame:
    """Principal factor over the whole panel, dynamic factor and shock per series."""
    cols = [c for c in cols if c in df.columns]
    pooled = settle(pca_factor(df, cols), "factor-pca")
    out = dynamic_factor(pooled, cols, by, order, layout=layout).drop("factor_innovation")
    return fallback_factor(out, by, order, layout=layout)
