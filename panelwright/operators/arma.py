"""ARMA models with differencing, seasonal lags and regressors, for many series.

Conditional least squares in two stages (Hannan-Rissanen): a long autoregression
gives the shocks, then the series is regressed on its own lags, lagged shocks
and regressors. All candidate orders of a model are sub-matrices of one moment
matrix on a common sample, so the whole grid costs one pass over the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.functions.scalar import later_period, order_str
from panelwright.operators.companion import affine_paths
from panelwright.operators.css import refine
from panelwright.operators.gram import gram, lag_products, least_squares_batch, map_batches, ridge_batch, unpack_batch
from panelwright.operators.impute import attach
from panelwright.operators.metrics import forecast_metrics, gaussian_llf, information_criteria
from panelwright.operators.series import numbered, series
from panelwright.operators.unitroot import differencing_order
from panelwright.operators.window import rolling_folds
from panelwright.session import settle

#: Least upper bound of the long autoregression's order; it grows as log(rows) ** 1.5.
LONG_AR = 4


@dataclass(frozen=True)
class Arma:
    """One model family: which orders are searched and what may enter."""

    max_p: int = 2
    max_q: int = 2
    seasonal: bool = False
    exog: tuple[str, ...] = ()
    intercepts: tuple[bool, ...] = (False, True)
    min_p: int = 0
    min_q: int = 0


def default_models(exog: Sequence[str] = ()) -> dict[str, Arma]:
    """The three families that are compared: plain, seasonal, seasonal with regressors."""
    return {"arima": Arma(), "sarima": Arma(seasonal=True), "sarimax": Arma(seasonal=True, exog=tuple(exog))}


@dataclass(frozen=True)
class ArmaRows:
    """Feature rows of all series, ready for fitting, fitted values and forecasts."""

    df: DataFrame
    by: tuple[str, ...]
    order: str
    models: Mapping[str, Arma]
    season: int
    long_ar: int
    status: DataFrame

    @property
    def max_p(self) -> int:
        return max(m.max_p for m in self.models.values())

    @property
    def max_q(self) -> int:
        return max(m.max_q for m in self.models.values())

    @property
    def has_season(self) -> bool:
        return self.season > max(self.max_p, self.max_q) and any(m.seasonal for m in self.models.values())

    @property
    def exog(self) -> list[str]:
        return list(dict.fromkeys(c for m in self.models.values() for c in m.exog))

    def regressors(self) -> list[str]:
        """Order of the coefficient array: constant, lags, shocks, regressors."""
        names = ["one", *[f"w{i}" for i in range(1, self.max_p + 1)], *[f"e{i}" for i in range(1, self.max_q + 1)]]
        if self.has_season:
            names += ["ws", "es"]
        return names + [f"x_{c}" for c in self.exog]


def arma_rows(
    df: DataFrame,
    target: str,
    by: Sequence[str],
    order: str,
    train: Column | str,
    d: DataFrame | int | None = None,
    models: Mapping[str, Arma] | None = None,
    season: int = 1,
    long_ar: int | None = None,
) -> ArmaRows:
    """Difference, lag and pre-whiten every series.

    ``d`` is a fixed order, a table (by, d), or None to test for it on the
    training rows. Target and regressors are taken about their training means,
    the target in units of its training deviation, so that estimates don't
    depend on level or unit. The long autoregression grows with the series and
    covers the season where there are seasonal terms, unless ``long_ar`` bounds
    it; its moments cost each series two sums a lag. The status has a row for
    every series; its column ``reduced`` says what a series could not have.
    """
    by = list(by)
    models = dict(models or default_models())
    spec = ArmaRows(df, tuple(by), order, models, season, 0, df)
    rows = df.select(
        *dict.fromkeys([*by, order]), F.col(target).cast("double").alias("y"), (F.expr(train) if isinstance(train, str) else train).alias("is_train"),
        *[F.col(c).cast("double").alias(f"x0_{c}") for c in spec.exog],
    ).filter(F.col("y").isNotNull())
    tr = F.when(F.col("is_train"), F.col("y"))
    sizes = rows.groupBy(*by).agg(
        F.max(order).alias("last_period"),
        F.count(tr).alias("n_train"),
        (F.min(tr) == F.max(tr)).alias("_flat"),
        F.stddev_pop(tr).alias("_scale"),
        F.avg(tr).alias("_center"),
        *[F.coalesce(F.avg(F.when(F.col("is_train"), F.col(f"x0_{c}"))), F.lit(0.0)).alias(f"_m_{c}") for c in spec.exog],
    )
    if d is None:
        d = differencing_order(rows.filter("is_train"), "y", by, order)
    if isinstance(d, int):
        sizes = sizes.withColumn("d", F.lit(d))
    else:
        sizes = attach(sizes, d, by, ["d"])
    sizes = sizes.withColumn("d", F.col("d").cast("int"))
    status = (
        F.when(F.col("n_train") < 4, "too few observations").when(F.col("_flat"), "constant series").otherwise("ok")
    )
    # Seasonal terms need a few seasons of training rows.
    long_enough = F.lit(spec.has_season) & (F.col("n_train") >= 3 * season)
    sizes = sizes.withColumn("status", status).withColumn("seasonal_ok", long_enough)
    most = F.lit(long_ar) if long_ar is not None else F.greatest(F.lit(LONG_AR), F.ceil(F.pow(F.log(F.greatest("n_train", F.lit(1))), F.lit(1.5))))
    own = F.greatest(F.lit(1), F.least(most, F.floor(F.col("n_train") / 8)))
    if long_ar is None:
        own = F.when(F.col("seasonal_ok"), F.greatest(own, F.lit(season))).otherwise(own)
    sizes = sizes.withColumn("long_ar", own.cast("int") if spec.max_q else F.lit(0))
    reduced = F.when(F.lit(spec.has_season) & ~F.col("seasonal_ok"), "no seasonal terms")
    sizes = settle(sizes.withColumn("reduced", reduced), "arma-series")
    ok = sizes.filter("status = 'ok'")
    long_ar = ok.agg(F.max("long_ar")).first()[0] or 0
    means = [f"_m_{c}" for c in spec.exog]
    rows = attach_inner(rows, ok, by, ["n_train", "d", "_scale", "_center", "seasonal_ok", "long_ar", *means])
    about = {f"x0_{c}": F.col(f"x0_{c}") - F.col(f"_m_{c}") for c in spec.exog}
    rows = rows.withColumns({"actual": F.col("y"), "y": (F.col("y") - F.col("_center")) / F.col("_scale"), **about}).drop(*means)
    rows = numbered(rows, by, order, t="t", n="_n").drop("_n")

    seasonal = season if spec.has_season else 0
    reach = max(spec.max_p, long_ar, seasonal) + 2
    ser = series(rows, by, order)
    rows = ser.df.withColumns({f"_y{i}": ser.shift("y", i) for i in range(reach + 1)})

    def w(i: int, c: str = "_y") -> Column:
        a, b, e = (f"`{c}{j}`" for j in (i, i + 1, i + 2))
        return F.expr(f"CASE d WHEN 0 THEN {a} WHEN 1 THEN {a} - {b} ELSE {a} - 2 * {b} + {e} END")

    made = {f"w{i}": w(i) for i in range(max(spec.max_p, long_ar) + 1)}
    if seasonal:
        made["ws"] = w(seasonal)
        # Recent values, newest first, from which a seasonal forecast starts.
        made["recent_w"] = F.array(*[w(i) for i in range(seasonal)])
    else:
        made["recent_w"] = F.array(*[F.col(f"w{i}") for i in range(max(spec.max_p, 1))])
        rows = rows.withColumns({k: made.pop(k) for k in list(made) if k != "recent_w"})
    rows = rows.withColumns(made)
    if spec.exog:
        x = {f"_{c}_{i}": ser.shift(f"x0_{c}", i) for c in spec.exog for i in range(3)}
        rows = rows.withColumns(x).withColumns({f"x_{c}": w(0, f"_{c}_") for c in spec.exog})
        rows = rows.withColumns({f"x1_{c}": F.col(f"_{c}_1") for c in spec.exog}).drop(*x)
    rows = rows.withColumn("prior_level", F.col("y") - F.col("w0")).drop(
        *[f"_y{i}" for i in range(2, reach + 1)]
    )

    if spec.max_q:
        rows = settle(rows, "arma-lags")
        # A series' longer lags than its own order count as absent (zero).
        lags = [F.when(F.col("long_ar") >= i, F.col(f"w{i}")).otherwise(0.0) for i in range(1, long_ar + 1)]
        schema = T.StructType([*[rows.schema[k] for k in by], T.StructField("_ar", T.ArrayType(T.DoubleType()))])

        def stage_one(pdf: pd.DataFrame) -> pd.DataFrame:
            return pdf[by].assign(_ar=[c.tolist() for c in long_autoregressions(pdf, long_ar)])

        rows = attach(rows, map_batches(_lag_sums(rows, by, long_ar), stage_one, schema), by, ["_ar"])
        fitted = F.col("_ar")[0]
        for i, lag in enumerate(lags, 1):
            fitted = fitted + F.col("_ar")[i] * F.coalesce(lag, F.lit(0.0))
        usable = F.col("t") > F.col("d") + F.col("long_ar")
        rows = rows.withColumn("e0", F.when(usable, F.col("w0") - fitted))
        ser = series(rows, by, order)
        shocks = {f"e{i}": ser.shift("e0", i) for i in range(1, max(spec.max_q, 1) + 1)}
        depth = seasonal or spec.max_q
        if seasonal:
            shocks["es"] = ser.shift("e0", seasonal)
        shocks["recent_e"] = F.array(*[F.coalesce(ser.shift("e0", i), F.lit(0.0)) for i in range(depth)])
        rows = ser.df.withColumns(shocks).drop("_ar")
    else:
        rows = rows.withColumn("recent_e", F.array(F.lit(0.0)))
        if seasonal:
            rows = rows.withColumn("es", F.lit(0.0))
    rows = settle(rows.withColumn("one", F.lit(1.0)), "arma-rows")
    return ArmaRows(rows, tuple(by), order, models, season, long_ar, sizes)


def _lag_sums(rows: DataFrame, by: list[str], width: int) -> DataFrame:
    """Per series: sums of the newest value with each lag on its own sample, and its first and last values."""
    s, own = F.col("t") - F.col("d"), F.col("long_ar")
    use = F.col("is_train") & (s > own)
    rows = rows.withColumn("_use", use)
    products = [f"coalesce(sum(w0 * w{j}) FILTER (WHERE _use AND long_ar >= {j}), 0D)" for j in range(width + 1)]
    point = F.struct(s.alias("s"), "w0")
    few = lambda where: F.sort_array(F.collect_list(F.when(F.col("is_train") & where, point))).getField("w0")
    return rows.groupBy(*by).agg(
        F.expr("count_if(_use)").alias("n"), F.max("long_ar").alias("own"), F.expr("coalesce(sum(w0) FILTER (WHERE _use), 0D)").alias("s"),
        F.expr(f"array({', '.join(products)})").alias("r"), few((s >= 1) & (s <= own)).alias("head"),
        few((s >= 1) & (F.col("t") > F.col("n_train") - own)).alias("tail"),
    )


def long_autoregressions(pdf: pd.DataFrame, width: int) -> np.ndarray:
    """Constant and coefficients (m, width + 1) of each series' long autoregression, zero beyond its own order."""
    m, own = len(pdf), pdf["own"].to_numpy(int)
    head, tail = np.zeros((m, width + 1)), np.zeros((m, width + 1))
    for i, (first, last) in enumerate(zip(pdf["head"], pdf["tail"])):
        # Lag i enters with the value at own + 1 - i and leaves with the i-th last one.
        head[i, 1 : len(first) + 1] = np.asarray(first, float)[::-1]
        tail[i, 1 : len(last) + 1] = np.asarray(last, float)[::-1]
    lags = np.arange(width + 1) <= own[:, None]
    r = np.vstack([np.asarray(v, float) for v in pdf["r"]])
    sums = np.where(lags, pdf["s"].to_numpy(float)[:, None] + np.cumsum(head - tail, axis=1), 0.0)
    g = np.zeros((m, width + 2, width + 2))
    g[:, 1:, 1:] = lag_products(r, head, tail, lags)
    g[:, 0, 0], g[:, 0, 1:], g[:, 1:, 0] = pdf["n"], sums, sums
    at = [0, *range(2, width + 2)]
    return least_squares_batch(g[:, at][:, :, at], g[:, at, 1])


def attach_inner(df: DataFrame, stats: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Like ``attach``, but rows of groups without statistics go."""
    marked = attach(df, stats.withColumn("_found", F.lit(True)), by, [*names, "_found"])
    return marked.filter(F.col("_found")).drop("_found")


def _candidates(spec: ArmaRows, m: Arma, names: list[str]) -> list[tuple]:
    """All orders of a family with the positions of their regressors."""
    out = []
    season = (0, 1) if m.seasonal and spec.has_season else (0,)
    for p in range(m.min_p, m.max_p + 1):
        for q in range(m.min_q, m.max_q + 1):
            for sp in season:
                for sq in season if spec.max_q else (0,):
                    for const in m.intercepts:
                        used = (["one"] if const else []) + [f"w{i}" for i in range(1, p + 1)]
                        used += ["ws"] * sp + [f"e{i}" for i in range(1, q + 1)] + ["es"] * sq
                        used += [f"x_{c}" for c in m.exog]
                        out.append((p, q, sp, sq, const, [names.index(u) for u in used]))
    return out


_FIT = (
    "model string, p int, q int, sp int, sq int, with_constant boolean, n_obs long, n_params int, edf double, rss double, "
    "coefs array<double>, const double, fit_status string"
)


def _stable(coefs: np.ndarray, season_coef: np.ndarray, season: int) -> np.ndarray:
    """Whether 1 - sum(c_i z^i) - s z^m has all roots outside the unit circle."""
    good = np.abs(coefs).sum(axis=1) + np.abs(season_coef) < 1
    doubt = np.flatnonzero(~good)
    if not len(doubt):
        return good
    size = season if season and np.any(season_coef[doubt]) else coefs.shape[1]
    if not size:
        return good
    companion = np.zeros((len(doubt), size, size))
    companion[:, 0, : coefs.shape[1]] = coefs[doubt]
    if size == season:
        companion[:, 0, season - 1] += season_coef[doubt]
    companion[:, np.arange(1, size), np.arange(size - 1)] = 1.0
    good[doubt] = np.abs(np.linalg.eigvals(companion)).max(axis=1) < 1
    return good


def fit_arma(rows: ArmaRows) -> DataFrame:
    """Every candidate of every family for every series, with information criteria.

    All families share the sample of a series, so their criteria compare. A
    candidate with more regressors than its rows bear is shrunk until two
    degrees of freedom are left, and its criteria count its effective ones.
    Candidates with explosive lag or shock polynomials are marked, not selected.
    ``coefs`` belong to the rows about their means, ``const`` to the series itself.
    """
    by, names = list(rows.by), rows.regressors()
    seasonal_ok = F.col("seasonal_ok")
    columns = [F.when(seasonal_ok, F.col(n)).otherwise(0.0) if n in ("ws", "es") else F.col(n) for n in names]
    where = F.col("is_train") & (F.col("t") > _sample_start(rows))
    parts = gram(rows.df, by, [*columns, F.col("w0")], where=where)
    means = [f"_m_{c}" for c in rows.exog]
    parts = attach(parts, rows.status.filter("status = 'ok'"), by, ["_scale", "_center", "d", "seasonal_ok", *means])
    added = T.StructType.fromDDL(_FIT)
    schema = T.StructType([*[parts.schema[k] for k in by], parts.schema["d"], parts.schema["_scale"], *added.fields])
    k, season = len(names), rows.season
    at_w = [names.index(f"w{i}") for i in range(1, rows.max_p + 1)]
    at_e = [names.index(f"e{i}") for i in range(1, rows.max_q + 1)]
    at_level = [*at_w, *([names.index("ws")] if "ws" in names else [])]
    at_x = [names.index(f"x_{c}") for c in rows.exog]
    jobs = [(model, _candidates(rows, m, names)) for model, m in rows.models.items()]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        g = unpack_batch(pdf["g"], k + 1)
        n = pdf["n"].to_numpy(float)
        with_season = pdf["seasonal_ok"].to_numpy(bool)
        zero = np.zeros(len(pdf))
        # Without a constant a model is about zero, not about the means.
        level = (pdf["d"] == 0).to_numpy(float)
        mean = level * (pdf["_center"] / pdf["_scale"]).to_numpy(float)
        mean_x = level[:, None] * pdf[means].to_numpy(float)
        back = np.repeat(np.eye(k + 1)[None], len(pdf), axis=0)
        back[:, [*at_level, k], 0] = mean[:, None]
        back[:, at_x, 0] = mean_x
        plain = np.einsum("mij,mjk,mlk->mil", back, g, back)
        out = []
        for model, candidates in jobs:
            for p, q, sp, sq, const, at in candidates:
                of = g if const else plain
                xtx, xty, yy = of[:, at][:, :, at], of[:, at, k], of[:, k, k]
                beta, rss, edf = ridge_batch(xtx, xty, yy, n)
                rss = np.maximum(rss, 1e-12 * yy)
                params = len(at) + 1
                enough = (n > 0) & (yy > 0) & np.isfinite(rss) & np.isfinite(edf)
                enough &= with_season | (not sp and not sq)
                full = np.zeros((len(pdf), k))
                full[:, at] = beta
                full = np.where(np.isfinite(full), full, 0.0)
                shift = mean * (1 - full[:, at_level].sum(axis=1)) - (full[:, at_x] * mean_x).sum(axis=1)
                if not const:
                    full[:, 0] = -shift
                stable = _stable(full[:, at_w], full[:, names.index("ws")] if sp else zero, season)
                stable &= _stable(-full[:, at_e], -full[:, names.index("es")] if sq else zero, season)
                state = np.where(enough, np.where(stable, "ok", "explosive"), "too few observations")
                out.append(
                    pdf[[*by, "d", "_scale"]].assign(
                        model=model, p=p, q=q, sp=sp, sq=sq, with_constant=const, n_obs=n.astype(int), n_params=params,
                        edf=edf, rss=rss, coefs=list(full.tolist()), const=(full[:, 0] + shift) * pdf["_scale"], fit_status=state,
                    )
                )
        return pd.concat(out, ignore_index=True)

    fits = map_batches(parts, solve, schema)
    rss = F.col("rss") * F.col("_scale") * F.col("_scale")
    ic = _criteria()
    usable = F.col("fit_status") != "too few observations"
    m = F.when(F.col("sp") + F.col("sq") > 0, F.lit(season)).otherwise(0)
    return (
        fits.withColumn("rss", rss)
        .withColumns({name: F.when(usable, c) for name, c in ic.items()})
        .withColumn("order", order_str("p", "d", "q"))
        .withColumn("seasonal_order", order_str("sp", F.lit(0), "sq", m))
        .withColumnRenamed("fit_status", "status")
        .drop("_scale")
    )


def _criteria() -> dict[str, Column]:
    return information_criteria(gaussian_llf(F.col("rss"), F.col("n_obs")), F.col("edf") + 1, F.col("n_obs"))


def _sample_start(rows: ArmaRows) -> Column:
    """The row after which all regressors of all families are there: the sample that a series' candidates share."""
    start = F.greatest(F.lit(rows.max_p), F.col("long_ar") + rows.max_q if rows.max_q else F.lit(0))
    if rows.has_season:
        lead = F.lit(rows.season) + (F.col("long_ar") if rows.max_q else 0)
        start = F.greatest(start, F.when(F.col("seasonal_ok"), lead).otherwise(0))
    return F.col("d") + start


def refine_shocks(rows: ArmaRows, best: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fits with shock terms estimated by conditional least squares, and the shocks of their rows (by, model, t, e).

    The two-stage estimates in ``best`` are where the search starts (see
    ``css``); sample and degrees of freedom stay, so criteria still compare. Fits
    without shock terms pass unchanged.
    """
    by, names = list(rows.by), rows.regressors()
    keys = [*by, "model"]
    regs = [n for n in names if n == "ws" or not n.startswith("e")]
    depth = max(rows.max_q, rows.season if rows.has_season else 0)
    moving = (F.col("q") > 0) | (F.col("sq") > 0)
    if not rows.max_q:
        nothing = rows.df.limit(0).select(*by, F.lit("").alias("model"), "t", F.lit(0.0).alias("e"))
        return best, nothing
    todo = best.filter(moving)
    fixed = rows.status.select(*by, "_scale", "_center", *[f"_m_{c}" for c in rows.exog])
    todo = attach(todo, fixed, by, ["_scale", "_center", *[f"_m_{c}" for c in rows.exog]])
    # Without a constant a model is about zero, not about the means.
    plain = ~F.col("with_constant") & (F.col("d") == 0)
    mean = F.when(plain, F.col("_center") / F.col("_scale")).otherwise(0.0)
    at = {n: i for i, n in enumerate(names)}
    slopes = [F.when(F.col("with_constant"), F.col("coefs")[0]).otherwise(0.0), *[F.col("coefs")[at[n]] for n in regs[1:]]]
    lags = F.sequence(F.lit(1), F.greatest(F.col("q"), F.lit(1)))
    shocks = F.filter(F.transform(lags, lambda i: F.struct(i.alias("lag"), F.element_at("coefs", i + at["e1"]).alias("c"))), lambda s: s.lag <= F.col("q"))
    if rows.has_season:
        seasonal = F.array(F.struct(F.lit(rows.season).alias("lag"), F.col("coefs")[at["es"]].alias("c")))
        shocks = F.concat(shocks, F.when(F.col("sq") > 0, seasonal).otherwise(F.slice(seasonal, 1, 0)))
    todo = todo.withColumns({"beta": F.array(*slopes), "_s": shocks, "_mean": mean, "_plain": plain})
    todo = settle(todo.withColumns({"lags": F.col("_s.lag"), "shocks": F.col("_s.c")}), "arma-shocks")
    start = _sample_start(rows)
    data = rows.df.withColumn("_start", start).filter("t > _start").withColumn("model", F.explode(F.array(*[F.lit(m) for m in rows.models])))
    means = [f"_m_{c}" for c in rows.exog]
    data = attach_inner(data.drop("_scale", "_center"), todo, keys, ["beta", "_mean", "_plain", "with_constant", "p", "sp", *means])
    zero = F.lit(0.0)

    def used(n: str) -> Column:
        value = F.coalesce(F.col(n), zero)
        if n == "one":
            return F.when(F.col("with_constant"), 1.0).otherwise(0.0)
        if n == "ws":
            return F.when(F.col("sp") > 0, value + F.col("_mean")).otherwise(0.0)
        if n.startswith("x_"):
            value = value + F.when(F.col("_plain"), F.col(f"_m_{n[2:]}")).otherwise(0.0)
            return F.when(F.element_at("beta", regs.index(n) + 1) != 0, value).otherwise(0.0)
        return F.when(F.col("p") >= int(n[1:]), value + F.col("_mean")).otherwise(0.0)

    z = F.array(F.coalesce("w0", zero) + F.col("_mean"), *[used(n) for n in regs])
    data = data.select(*keys, (F.col("t") - F.col("_start")).alias("step"), z.alias("z"), F.col("is_train").alias("fit"))
    fits, errors = refine(data, todo.select(*keys, "beta", "shocks", "lags"), keys, depth)
    todo = attach(todo.drop("beta", "shocks"), fits, keys, ["beta", "shocks", "ss"])
    # Back to coefficients of the rows about their means.
    b = {n: F.col("beta")[i] for i, n in enumerate(regs)}
    level = [b[n] for n in regs if n.startswith("w")]
    shift = F.col("_mean") * (1 - sum(level, zero))
    for c in rows.exog:
        shift = shift - F.when(F.col("_plain"), b[f"x_{c}"] * F.col(f"_m_{c}")).otherwise(0.0)
    one = F.when(F.col("with_constant"), b["one"]).otherwise(-shift)
    shock = lambda lag: F.coalesce(F.element_at("shocks", F.nullif(F.array_position("lags", lag), F.lit(0)).cast("int")), zero)
    full = {**b, "one": one, **{f"e{i}": F.when(F.col("q") >= i, shock(i)).otherwise(0.0) for i in range(1, rows.max_q + 1)}}
    if rows.has_season:
        full["es"] = F.when(F.col("sq") > 0, shock(rows.season)).otherwise(0.0)
    raw = F.when(F.col("d") == 0, F.col("_center") / F.col("_scale")).otherwise(0.0) * (1 - sum(level, zero))
    for c in rows.exog:
        raw = raw - F.when(F.col("d") == 0, b[f"x_{c}"] * F.col(f"_m_{c}")).otherwise(0.0)
    const = F.when(F.col("with_constant"), (b["one"] + raw) * F.col("_scale")).otherwise(0.0)
    todo = todo.withColumns({"coefs": F.array(*[full[n] for n in names]), "const": const, "rss": F.col("ss") * F.col("_scale") * F.col("_scale")})
    done = settle(best.filter(~moving).unionByName(todo.withColumns(_criteria()).select(*best.columns)), "arma-refined")
    starts = rows.status.select(*by, start.alias("_start"))
    errors = attach(errors, starts, by, ["_start"])
    return done, settle(errors.select(*keys, (F.col("step") + F.col("_start")).alias("t"), "e"), "arma-errors")


def select_order(fits: DataFrame, by: Sequence[str], criterion: str = "AIC") -> DataFrame:
    """The candidate with the smallest criterion per series and model.

    Equal values go to fewer parameters, then to lower orders.
    """
    ok = fits.filter((F.col("status") == "ok") & F.col(criterion).isNotNull())
    payload = [c for c in fits.columns if c not in (*by, "model")]
    keyed = F.struct(F.col(criterion).alias("_c"), F.col("n_params").alias("_k"), *payload)
    best = ok.groupBy(*by, "model").agg(F.min(keyed).alias("_best"))
    return best.select(*by, "model", *[F.col(f"_best.{c}").alias(c) for c in payload])


def _per_model(rows: ArmaRows, best: DataFrame) -> tuple[DataFrame, Column]:
    """Feature rows once per model with its coefficients, and the fitted expression."""
    by, names = list(rows.by), rows.regressors()
    models = F.array(*[F.lit(m) for m in rows.models])
    out = rows.df.withColumn("model", F.explode(models))
    out = attach_inner(out, best, [*by, "model"], ["coefs", "order", "seasonal_order"])
    # An unused regressor may be null in early rows; it must not hide the others.
    terms = [f"if(coefs[{i}] = 0, 0D, coefs[{i}] * `{n}`)" for i, n in enumerate(names)]
    return out, F.expr(" + ".join(terms))


def fitted_values(rows: ArmaRows, best: DataFrame, shocks: DataFrame | None = None) -> DataFrame:
    """In-sample one-step fits and residuals of the training rows; ``shocks`` are those of refined fits."""
    out, fitted = _per_model(rows, best)
    usable = F.col("t") > F.col("d")
    if shocks is not None:
        out = attach(out, shocks, [*rows.by, "model", "t"], ["e"])
        fitted = F.when(F.col("e").isNotNull(), F.col("w0") - F.col("e")).otherwise(fitted)
    fit = F.when(usable, (fitted + F.col("prior_level")) * F.col("_scale") + F.col("_center"))
    out = out.filter("is_train").select(*rows.by, "model", rows.order, "actual", fit.alias("fitted"))
    return out.withColumn("residual", F.col("actual") - F.col("fitted"))


def forecast(
    rows: ArmaRows,
    best: DataFrame,
    h: int | None = None,
    future_exog: DataFrame | None = None,
    unit: str = "step",
    shocks: DataFrame | None = None,
) -> DataFrame:
    """Multi-step forecasts: (by, model, period, actual, forecast, status).

    Without ``h`` the rows after the training part are forecast from its end.
    With ``h`` the next ``h`` periods after a series' last row are, whether it
    is a training row or not; ``unit`` says how periods are counted (see
    ``later_period``) and ``actual`` is null. Families with regressors then need
    ``future_exog`` (by, period, regressors), exactly ``h`` rows per series;
    nulls in it are filled by the median of the series' rows, then by zero.
    ``shocks`` are those of refined fits (see ``refine_shocks``).

    Recursions run as a scan over blocks of steps (see ``companion``). A path
    that is not finite falls back to the last fitted value, and if there is none
    to zero; with ``h``, so do series for which no model could be fitted.
    """
    by, names = list(rows.by), rows.regressors()
    keys, kind = [*by, "model"], rows.df.schema[rows.order].dataType
    if h is not None and h <= 0:
        raise ValueError(f"h must be > 0, got {h}")
    if h is not None and rows.exog and future_exog is None:
        raise ValueError(f"the next values of {', '.join(rows.exog)} are needed")
    out, fitted = _per_model(rows, best)
    x_at = {c: names.index(f"x_{c}") for c in rows.exog}
    if h is None:
        origin = out.filter(F.col("is_train") & (F.col("t") == F.col("n_train")))
        contribution = F.lit(0.0)
        for c, i in x_at.items():
            contribution = contribution + F.coalesce(F.col("coefs")[i] * F.col(f"x_{c}"), F.lit(0.0))
        row = F.struct(F.col(rows.order).alias("period"), "actual")
        steps = out.filter(~F.col("is_train")).select(*keys, (F.col("t") - F.col("n_train")).alias("step"), contribution.alias("x"), row.alias("row"))
    else:
        size = rows.df.groupBy(*by).agg(F.max("t").alias("_last"))
        origin = attach(out, size, by, ["_last"]).filter(F.col("t") == F.col("_last")).drop("_last")
    if shocks is not None:
        origin = _with_shocks(rows, origin, shocks)
    starts = settle(origin.select(*keys, rows.order, "_scale", "_center", *_start(rows, names, fitted)), "forecast-starts")
    if h is not None:
        steps = starts.select(*keys, "coefs_all", rows.order, F.expr(f"explode(sequence(1L, {h}L))").alias("step"))
        x = F.lit(0.0)
        if rows.exog:
            steps = attach(steps, _future_regressors(rows, h, future_exog), [*by, "step"], [f"x_{c}" for c in rows.exog])
            for c, i in x_at.items():
                x = x + F.coalesce(F.col("coefs_all")[i] * F.col(f"x_{c}"), F.lit(0.0))
        row = F.struct(later_period(rows.order, "step", unit).cast(kind).alias("period"), F.lit(None).cast("double").alias("actual"))
        steps = steps.select(*keys, "step", x.alias("x"), row.alias("row"))
    steps = attach(steps, starts, keys, ["given"])
    given = F.coalesce(F.try_element_at("given", F.col("step").cast("int")), F.element_at("given", -1))
    steps = steps.select(*keys, "step", (F.col("x") + given).alias("x"), "row")
    paths = attach(affine_paths(steps, starts, keys), starts, keys, ["_scale", "_center", "fit"])
    fallback = F.when(F.col("fit").isNotNull() & ~F.isnan("fit") & (F.abs("fit") < 1e300), F.col("fit"))
    value = F.when(F.col("ok"), F.col("value")).otherwise(fallback) * F.col("_scale") + F.col("_center")
    value = F.coalesce(value, F.lit(0.0))
    status = F.when(F.col("ok"), "ok").when(fallback.isNotNull(), "fallback_last").otherwise("fallback_zero")
    done = paths.select(*keys, F.col("row.period").alias(rows.order), F.col("row.actual").alias("actual"), value.alias("forecast"), status.alias("status"))
    return done if h is None else done.unionByName(_zeros(rows, best, h, unit))


def _with_shocks(rows: ArmaRows, origin: DataFrame, shocks: DataFrame) -> DataFrame:
    """Origins of refined fits with their own last shocks, newest first."""
    keys = [*rows.by, "model"]
    depth = max(rows.max_q, rows.season if rows.has_season else 0, 1)
    ends = attach_inner(shocks.withColumnRenamed("t", "_t"), origin.select(*keys, "t"), keys, ["t"])
    back = F.col("t") - F.col("_t")
    last = ends.filter((back >= 0) & (back < depth)).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(back.alias("i"), "e"))).alias("_l"))
    held = attach(origin, last, keys, ["_l"])
    own = F.concat(F.col("_l.e"), F.array_repeat(F.lit(0.0), depth))
    return held.withColumn("recent_e", F.when(F.col("_l").isNotNull(), own).otherwise(F.col("recent_e"))).drop("_l")


def _start(rows: ArmaRows, names: list[str], fitted: Column) -> list[Column]:
    """What a path starts from: coefs, state and d of the recursion, the inputs known at the start, the last fit."""
    coef = {n: F.col("coefs")[i] for i, n in enumerate(names)}
    depth = rows.season if rows.has_season else max(rows.max_p, 1)
    zero = F.lit(0.0)
    lags = [coef[f"w{i}"] if i <= rows.max_p else zero for i in range(1, depth + 1)]
    if rows.has_season:
        lags[rows.season - 1] = lags[rows.season - 1] + coef["ws"]
    state = [F.coalesce(F.col("recent_w")[i], zero) for i in range(depth)]
    # Shocks after the origin are zero, so the lagged ones are inputs of the first steps.
    reach = (rows.season if rows.has_season else rows.max_q) if rows.max_q else 0
    shocks = {i: coef[f"e{i}"] for i in range(1, rows.max_q + 1)}
    if reach and rows.has_season:
        shocks[rows.season] = shocks.get(rows.season, zero) + coef["es"]
    given = []
    for step in range(1, reach + 2):
        terms = [c * F.coalesce(F.col("recent_e")[i - step], zero) for i, c in shocks.items() if i >= step]
        given.append(sum(terms, coef["one"]))
    return [
        F.col("coefs").alias("coefs_all"), F.array(*lags).alias("coefs"), F.array(*state, F.col("y"), F.coalesce("_y1", zero)).alias("state"),
        F.col("d"), F.array(*given).alias("given"), (fitted + F.col("prior_level")).alias("fit"),
    ]


def _future_regressors(rows: ArmaRows, h: int, future_exog: DataFrame) -> DataFrame:
    """(by, step, x_...): the next regressor values, differenced like the series; ``h`` rows per series or an error."""
    by, cols = list(rows.by), rows.exog
    ahead = future_exog.select(*by, F.col(rows.order).alias("_period"), *[F.col(c).cast("double").alias(f"x0_{c}") for c in cols])
    size = rows.df.groupBy(*by).agg(F.max("t").alias("_last"), F.max("d").alias("d"))
    counts = attach(size, ahead.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")), by, ["_n"])
    wrong = counts.filter(F.coalesce("_n", F.lit(0)) != h).select(*by, F.coalesce("_n", F.lit(0)).alias("_n")).limit(5).collect()
    if wrong:
        told = ", ".join(f"{tuple(r[k] for k in by)}: {r['_n']}" for r in wrong)
        raise ValueError(f"future regressors must have h={h} rows per series, but have: {told}")
    middle = ahead.groupBy(*by).agg(*[F.median(F.when(~F.isnan(f"x0_{c}"), F.col(f"x0_{c}"))).alias(f"m_{c}") for c in cols])
    ahead = attach(ahead, middle, by, [f"m_{c}" for c in cols])
    ahead = attach(ahead, rows.status, by, [f"_m_{c}" for c in cols])
    clean = [(F.coalesce(F.nanvl(f"x0_{c}", F.lit(None)), F.col(f"m_{c}"), F.lit(0.0)) - F.col(f"_m_{c}")).alias(f"x0_{c}") for c in cols]
    place = F.row_number().over(Window.partitionBy(*by).orderBy("_period")).cast("long")
    ahead = ahead.select(*by, place.alias("step"), *clean)
    # The last known values, from which the first differences are taken.
    known = attach(rows.df, size.select(*by, "_last"), by, ["_last"]).filter("t = _last")
    known = known.select(*by, F.inline(F.array(*[F.struct(F.lit(-i).cast("long").alias("step"), *[F.col(f"x{i}_{c}").alias(f"x0_{c}") for c in cols]) for i in range(2)])))
    w = Window.partitionBy(*by).orderBy("step")
    line = attach(ahead.unionByName(known), size.select(*by, "d"), by, ["d"])
    for c in cols:
        a, b, e = F.col(f"x0_{c}"), F.lag(f"x0_{c}", 1).over(w), F.lag(f"x0_{c}", 2).over(w)
        line = line.withColumn(f"x_{c}", F.when(F.col("d") == 0, a).when(F.col("d") == 1, a - b).otherwise(a - 2 * b + e))
    return line.filter("step > 0").select(*by, "step", *[f"x_{c}" for c in cols])


def _zeros(rows: ArmaRows, best: DataFrame, h: int, unit: str) -> DataFrame:
    """Zero rows for every series and model without a usable fit."""
    by = list(rows.by)
    every = rows.status.select(*by, "last_period", F.explode(F.array(*[F.lit(m) for m in rows.models])).alias("model"))
    fitted = best.select(*by, "model", F.lit(True).alias("_found"))
    left = attach(every, fitted, [*by, "model"], ["_found"]).filter("_found IS NULL")
    left = left.select(*by, "model", "last_period", F.expr(f"explode(sequence(1L, {h}L))").alias("step"))
    return left.select(
        *by, "model", later_period("last_period", "step", unit).cast(rows.df.schema[rows.order].dataType).alias(rows.order), F.lit(None).cast("double").alias("actual"),
        F.lit(0.0).alias("forecast"), F.lit("fallback_zero").alias("status"),
    )


def cross_validate(
    df: DataFrame,
    target: str,
    by: Sequence[str] = ("industry",),
    order: str = "year",
    models: Mapping[str, Arma] | None = None,
    season: int = 1,
    n_splits: int = 3,
    criterion: str = "AIC",
    d: int | None = None,
) -> DataFrame:
    """Rolling-origin metrics per (entity, model, fold); all folds in one run.

    Folds are part of the key, so each fold tests its own differencing order and
    selects its own model. A fold without a usable fit has null metrics and the
    reason in ``error``.
    """
    by = list(by)
    models = dict(models or default_models())
    folds = settle(rolling_folds(df, by, order, n_splits), "folds")
    keys = [*by, "fold"]
    rows = arma_rows(folds, target, keys, order, F.col("role") == "train", d, models, season)
    best = settle(select_order(fit_arma(rows), keys, criterion), "cv-best")
    scores = forecast_metrics(forecast(rows, best), [*keys, "model"])
    scores = attach(scores, best, [*keys, "model"], ["order", "seasonal_order"])
    every = rows.status.select(*keys, "n_train", "status").withColumn(
        "model", F.explode(F.array(*[F.lit(m) for m in models]))
    )
    metrics = ["MSE", "RMSE", "MAE", "MAPE", "SMAPE", "MSRE", "R2", "order", "seasonal_order"]
    out = attach(every, scores, [*keys, "model"], metrics)
    error = F.when(F.col("status") != "ok", F.col("status")).when(F.col("MSE").isNull(), "no usable candidate")
    return out.select(*by, "model", "fold", F.col("n_train").alias("train_end"), *metrics, error.alias("error"))
