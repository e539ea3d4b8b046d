"""Least squares from moments.

Rows stay in the JVM: one aggregation sums all products of the regressors per
group (algebraic sums, so each task combines its rows before the shuffle, and a
hot group costs no more than any other). The k-by-k systems that remain are one
row per group; numpy solves them in batches where Spark has put those rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def gram(
    df: DataFrame, by: Sequence[str], columns: Sequence[Column], where: Column | None = None, extra: Sequence[Column] = ()
) -> DataFrame:
    """Per group: ``n`` and ``g``, the upper triangle of sums of products.

    Rows outside ``where`` or with a null among the columns do not count.
    """
    ok = F.lit(True) if where is None else where
    for c in columns:
        ok = ok & c.isNotNull()
    names = [f"_q{i}" for i in range(len(columns))]
    rows = df.withColumn("_use", ok).select(
        "*", *[F.when(F.col("_use"), c).alias(n) for c, n in zip(columns, names, strict=True)]
    )
    cells = [f"coalesce(sum({a} * {b}), 0D)" for i, a in enumerate(names) for b in names[i:]]
    # As text: hundreds of sums are one call to the JVM.
    return rows.groupBy(*by).agg(
        F.expr("count_if(_use)").alias("n"), F.expr(f"array({', '.join(cells)})").alias("g"), *extra
    )


def unpack(values: Sequence[float], k: int) -> np.ndarray:
    """Symmetric k-by-k matrix from its upper triangle."""
    out = np.zeros((k, k))
    out[np.triu_indices(k)] = np.asarray(values, float)
    return out + np.triu(out, 1).T


def least_squares(
    xtx: np.ndarray, xty: np.ndarray, ridge: float = 0.0, tol: float = 1e-13
) -> tuple[np.ndarray, int, np.ndarray]:
    """Coefficients, rank and inverse from moments; minimum norm if deficient.

    Columns are scaled to unit length first, so the rank does not depend on units.
    """
    scale = np.sqrt(np.clip(np.diag(xtx), 0, None))
    scale[scale == 0] = 1.0
    a = xtx / np.outer(scale, scale)
    if ridge:
        a = a + ridge * np.eye(len(a))
    w, v = np.linalg.eigh(a)
    good = w > tol * max(w[-1], 1e-300)
    inv = (v[:, good] / w[good]) @ v[:, good].T
    inv = inv / np.outer(scale, scale)
    beta = inv @ xty
    return beta, int(good.sum()), inv


def map_rows(df: DataFrame, fn: Callable[[pd.Series], dict], schema: T.StructType | str, keep: Sequence[str]) -> DataFrame:
    """Apply a small numeric function to each row of a one-row-per-group table.

    ``fn`` returns the new columns; the columns ``keep`` are passed through.
    """
    added = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = T.StructType([*[df.schema[k] for k in keep], *added.fields])
    names = [f.name for f in added.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [fn(row) for row in pdf.to_dict("records")]
            new = pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n in names})
            yield pd.concat([pdf[list(keep)].reset_index(drop=True), new], axis=1)

    return df.mapInPandas(run, full)


def least_squares_batch(
    xtx: np.ndarray, xty: np.ndarray, ridge: np.ndarray | float = 0.0, tol: float = 1e-11
) -> np.ndarray:
    """Coefficients of many systems at once: (m, k, k) and (m, k) to (m, k)."""
    scale = np.sqrt(np.clip(np.diagonal(xtx, axis1=1, axis2=2), 0, None))
    scale = np.where(scale == 0, 1.0, scale)
    a = xtx / (scale[:, :, None] * scale[:, None, :])
    a = a + np.asarray(ridge, float).reshape(-1, 1, 1) * np.eye(a.shape[1])
    w, v = np.linalg.eigh(a)
    good = w > tol * np.maximum(w[:, -1:], 1e-300)
    inv = np.where(good, 1 / np.where(good, w, 1.0), 0.0)
    coef = np.einsum("mij,mj,mkj,mk->mi", v, inv, v, xty / scale, optimize=True)
    return coef / scale


#: Ridge penalties (of columns of unit length) that are tried in turn.
RIDGES = (0.0, 1e-8, 1e-6, 1e-4, 1e-3, 1e-2, 1e-1, 1.0, 10.0, 100.0)


def ridge_batch(
    xtx: np.ndarray, xty: np.ndarray, yy: np.ndarray, n: np.ndarray, spare: float = 2.0, tol: float = 1e-11
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients, residual sums and effective degrees of freedom of many systems.

    One rule for all sizes: the least penalty of ``RIDGES`` that leaves ``spare``
    degrees of freedom, none at all where there are rows enough. NaN degrees
    where no penalty does.
    """
    m, k = xty.shape
    if not k:
        return np.zeros((m, 0)), yy.copy(), np.where(n >= spare, 0.0, np.nan)
    scale = np.sqrt(np.clip(np.diagonal(xtx, axis1=1, axis2=2), 0, None))
    scale = np.where(scale == 0, 1.0, scale)
    w, v = np.linalg.eigh(xtx / (scale[:, :, None] * scale[:, None, :]))
    good = w > tol * np.maximum(w[:, -1:], 1e-300)
    w = np.where(good, w, 0.0)
    grid = np.array(RIDGES)[:, None, None]
    freedom = np.where(good, w / np.where(good, w + grid, 1.0), 0.0).sum(axis=2)
    fits = n - freedom >= spare - 1e-9
    pick = np.argmax(fits, axis=0)
    at = np.arange(m)
    inverse = np.where(good, 1 / np.where(good, w + np.array(RIDGES)[pick][:, None], 1.0), 0.0)
    beta = np.einsum("mij,mj,mkj,mk->mi", v, inverse, v, xty / scale, optimize=True) / scale
    rss = yy - 2 * np.einsum("mi,mi->m", beta, xty) + np.einsum("mi,mij,mj->m", beta, xtx, beta)
    return beta, rss, np.where(fits[pick, at], freedom[pick, at], np.nan)


def lag_products(r: np.ndarray, start: np.ndarray, end: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Sums of products of lags i and j (m, L + 1, L + 1) from those of lag 0 with each lag, ``r``.

    The sum for lags i and j is that for i - 1 and j - 1 with one product entering
    at the start of the sample and one leaving at its end: those of the values
    ``start`` and ``end`` (m, L + 1). Lags outside ``own`` (m, L + 1) give zeros.
    """
    m, size = r.shape
    out = np.zeros((m, size, size))
    out[:, 0] = prev = np.where(own, r, 0.0)
    for i in range(1, size):
        prev = prev[:, : size - i] + start[:, i : i + 1] * start[:, i:] - end[:, i : i + 1] * end[:, i:]
        prev = np.where(own[:, i:], prev, 0.0)
        out[:, i, i:] = prev
    return np.triu(out) + np.triu(out, 1).transpose(0, 2, 1)


def masked_fit(xtx: np.ndarray, xty: np.ndarray, yy: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients, zero outside ``mask`` (m, k), and residual sums of many systems."""
    k = xty.shape[1]
    a = np.where(mask[:, :, None] & mask[:, None, :], xtx, 0.0)
    a[:, np.arange(k), np.arange(k)] += ~mask
    beta = np.where(mask, least_squares_batch(a, np.where(mask, xty, 0.0)), 0.0)
    return beta, yy - np.einsum("mi,mi->m", beta, xty)


def sparse_fit(
    xtx: np.ndarray, xty: np.ndarray, yy: np.ndarray, n: np.ndarray, optional: np.ndarray, patience: int = 3
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients, residual sums and chosen columns (m, k) of least squares with few of the ``optional`` columns (k,).

    For all systems at once the column that helps most joins, one at a time, also
    where it does not pay yet (a kink may pay with the next one only), until
    ``patience`` in a row have paid for no system; of the sets on the way the best
    is kept, and columns leave it one by one as long as that pays. What pays is
    told by the extended BIC, which counts how many sets of that size there are.
    """
    offered = np.flatnonzero(optional)
    price = 2 * np.log(max(len(offered), 1))

    def score(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        beta, rss = masked_fit(xtx, xty, yy, mask)
        size, extra = mask.sum(axis=1), mask[:, offered].sum(axis=1)
        with np.errstate(all="ignore"):
            value = n * np.log(np.maximum(rss, 1e-14 * np.maximum(yy, 1e-300)) / n) + size * np.log(n) + extra * price
        return np.where(size < n, value, np.inf), beta, rss

    def changed(mask: np.ndarray, on: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The best way to switch one optional column on (or off) for each system."""
        best = (np.full(len(mask), np.inf), mask.copy(), np.zeros_like(xty), np.zeros(len(mask)))
        for j in offered:
            able = mask[:, j] != on
            if able.any():
                other = mask.copy()
                other[:, j] = on
                value, beta, rss = score(other)
                win = able & (value < best[0])
                for held, new in zip(best, (value, other, beta, rss)):
                    held[win] = new[win]
        return best

    at = np.repeat(~optional[None], len(xty), axis=0)
    value, beta, rss = score(at)
    best, since = [value, at.copy(), beta, rss], 0
    while since < patience:
        step = changed(at, True)
        if not np.isfinite(step[0]).any():
            break
        at = np.where(np.isfinite(step[0])[:, None], step[1], at)
        win = step[0] < best[0]
        for held, new in zip(best, step):
            held[win] = new[win]
        since = 0 if win.any() else since + 1
    while True:
        step = changed(best[1], False)
        win = step[0] < best[0]
        if not win.any():
            break
        for held, new in zip(best, step):
            held[win] = new[win]
    return best[2], best[3], best[1]


def unpack_batch(values: Sequence[Sequence[float]], k: int) -> np.ndarray:
    """Symmetric matrices (m, k, k) from upper triangles."""
    flat = np.vstack([np.asarray(v, float) for v in values]) if len(values) else np.zeros((0, k * (k + 1) // 2))
    out = np.zeros((len(flat), k, k))
    i, j = np.triu_indices(k)
    out[:, i, j] = flat
    out[:, j, i] = flat
    return out


def gram_wide(df: DataFrame, by: Sequence[str], col: str, size: int) -> DataFrame:
    """Like ``gram`` for an array column too long for one sum expression per product.

    Each Arrow batch is reduced to one triangle per group it holds; the triangles
    are then added up element by element, again combined before the shuffle.
    """
    by = list(by)
    upper = np.triu_indices(size)
    schema = T.StructType([*[df.schema[k] for k in by], T.StructField("_p", T.ArrayType(T.DoubleType()))])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.vstack(pdf[col].to_numpy()).astype(float)
            codes, first = _codes(pdf, by)
            order = np.argsort(codes, kind="stable")
            cuts = np.flatnonzero(np.diff(codes[order])) + 1
            parts = [(x[i].T @ x[i])[upper] for i in np.split(order, cuts)]
            out = pdf.iloc[first][by].reset_index(drop=True)
            out["_p"] = [p.tolist() for p in parts]
            yield out

    def _codes(pdf: pd.DataFrame, keys: list[str]):
        if not keys:
            return np.zeros(len(pdf), int), np.array([0])
        codes = pdf.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
        _, first = np.unique(codes, return_index=True)
        return codes, first

    cells = df.select(*by, col).mapInPandas(partial, schema).select(*by, F.posexplode("_p").alias("_i", "_v"))
    sums = cells.groupBy(*by, "_i").agg(F.sum("_v").alias("_v"))
    # At most size * (size + 1) / 2 cells per group.
    packed = sums.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_i", "_v"))).alias("_c"))
    return packed.select(*by, F.col("_c._v").alias("g"))


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str) -> DataFrame:
    """Apply a vectorised function to each batch of a one-row-per-group table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield fn(pdf.reset_index(drop=True))

    return df.mapInPandas(run, schema)
