"""Conditional least squares of moving-average terms by Gauss-Newton.

The two-stage regression gives good starting values and orders, but its estimates
of the shock terms are biased: its shocks come from a long autoregression. Here
the shocks are those of the model itself, e = w - x b - t1 e[-1] - ... - tQ e[-Q],
zero before the first row. Both the shocks and their derivatives are the rows
filtered by the same recursion: with f(z) = z - t1 f(z)[-1] - ..., the shocks are
f(w) - f(x) b, their derivatives by b are -f(x), those by tj are -f(e)[-j].

A series is cut into blocks. The state of both filters (of every column) at a
block's end is an affine map of that at its start; blocks are first run from
zero, the maps are chained, and every block is then run from its own state and
adds up its products of derivatives and shocks. One step so is one pass of sums
over the rows. A series of one block takes all its steps where it lies.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.operators.gram import map_batches
from panelwright.operators.impute import attach
from panelwright.session import settle

#: Rows of a series in one block.
BLOCK = 4096
#: A step that changes the sum of squares by less than this share is the last one.
TOL = 1e-10
#: Halvings of a step before the search is given up where it stands.
HALVINGS = 20


def run_filters(z: np.ndarray, theta: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns filtered once and twice (rows, 2 C), and the state after the last row.

    ``z`` (rows, C); ``theta`` (Q,); ``state`` (Q, 2 C): the last values of the
    filtered columns, newest first.
    """
    rows, c = z.shape
    q = len(theta)
    if not q:
        return np.concatenate([z, z], axis=1), state
    # Newest values towards the front, so that no row shifts the lags.
    out = np.empty((rows + q, 2 * c))
    out[rows:] = state
    used = np.flatnonzero(theta)
    weights = theta[used][:, None]
    with np.errstate(all="ignore"):
        for i in range(rows):
            at = rows - i
            past = (weights * out[at + used]).sum(axis=0)
            out[at - 1, :c] = z[i] - past[:c]
            out[at - 1, c:] = out[at - 1, :c] - past[c:]
    return out[:rows][::-1], out[:q].copy()


def state_matrix(theta: np.ndarray, rows: int) -> np.ndarray:
    """(2 Q, 2 Q): what so many rows of zeros do to the two states of a column (once, then twice filtered)."""
    q = len(theta)
    one = np.zeros((2 * q, 2 * q))
    one[0, :q] = -theta
    one[q, :q] = -theta
    one[q, q:] = -theta
    for at in (0, q):
        one[np.arange(at + 1, at + q), np.arange(at, at + q - 1)] = 1.0
    with np.errstate(all="ignore"):
        return np.linalg.matrix_power(one, rows)


def _as_column_state(state: np.ndarray, q: int, c: int) -> np.ndarray:
    """(2 Q, C) from (Q, 2 C)."""
    return np.concatenate([state[:, :c], state[:, c:]], axis=0)


def _as_row_state(state: np.ndarray, q: int, c: int) -> np.ndarray:
    return np.concatenate([state[:q], state[q:]], axis=1)


def products(z: np.ndarray, theta: np.ndarray, beta: np.ndarray, lags: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Products (P + 1, P + 1) of derivatives and shock over the rows of a block, and the shocks.

    ``z``: the target, then the regressors; ``lags``: which lags have a coefficient.
    """
    c, q = z.shape[1], len(theta)
    both, _ = run_filters(z, theta, state)
    weight = np.r_[1.0, -beta]
    with np.errstate(all="ignore"):
        e = both[:, :c] @ weight
        twice = np.concatenate([(state[::-1, c:] @ weight) if q else np.zeros(0), both[:, c:] @ weight])
        back = np.column_stack([twice[q - j : q - j + len(e)] for j in lags]) if len(lags) else np.zeros((len(e), 0))
        j = np.column_stack([both[:, 1:c], back, e])
        return j.T @ j, e


def next_step(state: dict, moments: np.ndarray, theta_of) -> dict:
    """One move of the search: accept the point tried if it is better, else halve the step.

    ``state``: best, point (parameters), step, ss (of best), halved, done.
    """
    ss = moments[-1, -1]
    out = dict(state)
    if np.isfinite(moments).all() and ss < state["ss"]:
        small = state["ss"] < np.inf and state["ss"] - ss <= TOL * ss
        a, b = moments[:-1, :-1], moments[:-1, -1]
        size = np.sqrt(np.maximum(np.diag(a), 0))
        size[size == 0] = 1.0
        step = np.linalg.lstsq(a / np.outer(size, size), b / size, rcond=1e-12)[0] / size
        out |= {"best": state["point"], "ss": ss, "step": step, "halved": 0, "done": bool(small)}
    else:
        out |= {"step": state["step"] / 2, "halved": state["halved"] + 1}
        out["done"] = out["halved"] > HALVINGS or not np.isfinite(state["ss"])
    # A point at which the shocks would explode is not tried.
    out["point"] = out["best"] + out["step"]
    while not out["done"] and not invertible(theta_of(out["point"])):
        out |= {"step": out["step"] / 2, "halved": out["halved"] + 1}
        out["done"] = out["halved"] > HALVINGS
        out["point"] = out["best"] + out["step"]
    return out


def invertible(theta: np.ndarray) -> bool:
    q = len(theta)
    if not q or np.abs(theta).sum() < 1:
        return True
    companion = np.zeros((q, q))
    companion[0] = -theta
    companion[np.arange(1, q), np.arange(q - 1)] = 1.0
    return bool(np.abs(np.linalg.eigvals(companion)).max() < 1)


def first_state(beta: np.ndarray, shocks: np.ndarray, theta_of) -> dict:
    point = np.r_[beta, shocks]
    # Starting shocks that explode are drawn in.
    while not invertible(theta_of(point)):
        point = np.r_[beta, point[len(beta) :] * 0.9]
    return {"best": point, "point": point, "step": np.zeros_like(point), "ss": np.inf, "halved": 0, "done": False}


def search(z: np.ndarray, beta: np.ndarray, shocks: np.ndarray, lags: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """Coefficients, shock coefficients, sum of squares and shocks of one whole series."""
    k = len(beta)

    def theta_of(point: np.ndarray) -> np.ndarray:
        theta = np.zeros(q)
        np.add.at(theta, lags - 1, point[k:])
        return theta

    state, zero = first_state(beta, shocks, theta_of), np.zeros((q, 2 * z.shape[1]))
    while not state["done"]:
        moments, _ = products(z, theta_of(state["point"]), state["point"][:k], lags, zero)
        state = next_step(state, moments, theta_of)
    best = state["best"]
    _, e = products(z, theta_of(best), best[:k], lags, zero)
    return best[:k], best[k:], float(state["ss"]), e


def refine(
    rows: DataFrame, starts: DataFrame, keys: Sequence[str], depth: int, block: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Refined coefficients (keys, beta, shocks, ss) and the shocks of every row (keys, step, e).

    ``rows``: keys, step (1, 2, ... without gaps), ``z`` array<double> of target
    and regressors, ``fit`` (whether a row counts; later ones only get shocks).
    ``starts``: keys, beta array<double>, shocks array<double>, lags array<int>
    (their lags). ``depth`` is the longest lag.
    """
    keys, block = list(keys), block or BLOCK
    of = F.floor((F.col("step") - 1) / block).cast("long")
    item = F.struct("step", "z", "fit")
    # At most ``block`` rows are gathered.
    blocks = rows.select(*keys, of.alias("block"), item.alias("i")).groupBy(*keys, "block").agg(F.sort_array(F.collect_list("i")).alias("i"))
    blocks = blocks.select(*keys, "block", F.col("i.z").alias("z"), F.expr("size(filter(i.fit, f -> f))").alias("n_fit"))
    sizes = blocks.groupBy(*keys).agg(F.max("block").alias("_last"))
    blocks = settle(attach(blocks, sizes, keys, ["_last"]), "css-blocks")
    doubles = T.ArrayType(T.DoubleType())
    key_fields = [rows.schema[k] for k in keys]
    fitted = T.StructType([*key_fields, T.StructField("beta", doubles), T.StructField("shocks", doubles), T.StructField("ss", T.DoubleType()), T.StructField("e", doubles)])

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in pdf.itertuples(index=False):
            z, lags = np.vstack([np.asarray(v, float) for v in r.z]), np.asarray(r.lags, int)
            b, t, ss, _ = search(z[: int(r.n_fit)], np.asarray(r.beta, float), np.asarray(r.shocks, float), lags, depth)
            theta = np.zeros(depth)
            np.add.at(theta, lags - 1, t)
            _, e = products(z, theta, b, lags, np.zeros((depth, 2 * z.shape[1])))
            out.append((b.tolist(), t.tolist(), ss, e.tolist()))
        return pd.concat([pdf[keys], pd.DataFrame(out, columns=["beta", "shocks", "ss", "e"])], axis=1)

    names = ["beta", "shocks", "lags"]
    short = attach(blocks.filter("_last = 0"), starts, keys, names).filter("beta IS NOT NULL")
    short = settle(map_batches(short.select(*keys, "z", "n_fit", *names), whole, fitted), "css-short")
    fits = short.select(*keys, "beta", "shocks", "ss")
    shocks = short.select(*keys, F.posexplode("e").alias("_i", "e")).select(*keys, (F.col("_i") + 1).cast("long").alias("step"), "e")
    long = blocks.filter("_last > 0")
    if long.isEmpty():
        return fits, shocks
    more, more_shocks = _refine_long(long, starts, keys, depth, block)
    return fits.unionByName(more), shocks.unionByName(more_shocks)


def _refine_long(blocks: DataFrame, starts: DataFrame, keys: list[str], depth: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Series of several blocks: one pass of sums a step, until every series is done."""
    doubles, key_fields = T.ArrayType(T.DoubleType()), [blocks.schema[k] for k in keys]
    numbers = ["beta", "shocks", "lags"]
    state_ddl = "best array<double>, point array<double>, step array<double>, ss double, halved int, done boolean"
    state_fields = T.StructType([*key_fields, T.StructField("k", T.IntegerType()), T.StructField("lags", T.ArrayType(T.IntegerType())), *T.StructType.fromDDL(state_ddl).fields])

    def theta_at(point: np.ndarray, k: int, lags: np.ndarray) -> np.ndarray:
        theta = np.zeros(depth)
        np.add.at(theta, lags - 1, point[k:])
        return theta

    def begin(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in pdf.itertuples(index=False):
            beta, lags = np.asarray(r.beta, float), np.asarray(r.lags, int)
            s = first_state(beta, np.asarray(r.shocks, float), lambda p, k=len(beta), at=lags: theta_at(p, k, at))
            out.append((len(beta), lags.tolist(), *_row(s)))
        return pd.concat([pdf[keys], pd.DataFrame(out, columns=state_fields.names[len(keys) :])], axis=1)

    def _row(s: dict) -> tuple:
        return s["best"].tolist(), s["point"].tolist(), s["step"].tolist(), float(s["ss"]), s["halved"], bool(s["done"])

    def offsets(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in pdf.itertuples(index=False):
            z = np.vstack([np.asarray(v, float) for v in r.z])
            c = z.shape[1]
            _, end = run_filters(z, theta_at(np.asarray(r.point, float), int(r.k), np.asarray(r.lags, int)), np.zeros((depth, 2 * c)))
            out.append(_as_column_state(end, depth, c).ravel().tolist())
        return pdf[[*keys, "block"]].assign(offset=out)

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in pdf.itertuples(index=False):
            a = state_matrix(theta_at(np.asarray(r.point, float), int(r.k), np.asarray(r.lags, int)), block)
            held = [np.asarray(o, float).reshape(2 * depth, -1) for o in r.o]
            state, found = np.zeros_like(held[0]), []
            with np.errstate(all="ignore"):
                for o in held:
                    state = a @ state + o
                    found.append(state.ravel().tolist())
            out.append(found)
        return pdf[keys].assign(states=out)

    def started(states: DataFrame) -> DataFrame:
        """Blocks with their series' point and own start state."""
        held = attach(blocks, states, keys, ["point", "k", "lags"]).filter("point IS NOT NULL")
        cut = map_batches(held.filter("block < _last"), offsets, T.StructType([*key_fields, T.StructField("block", T.LongType()), T.StructField("offset", doubles)]))
        maps = cut.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("block", "offset"))).alias("o")).select(*keys, F.col("o.offset").alias("o"))
        found = map_batches(attach(maps, states, keys, ["point", "k", "lags"]), chain, T.StructType([*key_fields, T.StructField("states", T.ArrayType(doubles))]))
        found = found.select(*keys, F.posexplode("states").alias("block", "state")).withColumn("block", F.col("block").cast("long") + 1)
        return attach(held, found, [*keys, "block"], ["state"])

    def of_block(r) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        z, point, lags = np.vstack([np.asarray(v, float) for v in r.z]), np.asarray(r.point, float), np.asarray(r.lags, int)
        c = z.shape[1]
        state = np.zeros((depth, 2 * c)) if r.state is None else _as_row_state(np.asarray(r.state, float).reshape(2 * depth, c), depth, c)
        return z, theta_at(point, int(r.k), lags), point[: int(r.k)], lags, state

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in pdf.itertuples(index=False):
            z, theta, beta, lags, state = of_block(r)
            out.append(products(z[: int(r.n_fit)], theta, beta, lags, state)[0].ravel().tolist())
        return pdf[keys].assign(g=out)

    def move(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in pdf.itertuples(index=False):
            lags = np.asarray(r.lags, int)
            s = {"best": np.asarray(r.best, float), "point": np.asarray(r.point, float), "step": np.asarray(r.step, float), "ss": r.ss, "halved": int(r.halved), "done": r.done}
            size = len(s["best"]) + 1
            s = next_step(s, np.asarray(r.g, float).reshape(size, size), lambda p, k=int(r.k), at=lags: theta_at(p, k, at))
            out.append((int(r.k), lags.tolist(), *_row(s)))
        return pd.concat([pdf[keys], pd.DataFrame(out, columns=state_fields.names[len(keys) :])], axis=1)

    own = attach(blocks.select(*keys).distinct(), starts, keys, numbers).filter("beta IS NOT NULL")
    states = settle(map_batches(own.select(*keys, *numbers), begin, state_fields), "css-states")
    finished = states.limit(0)
    while not states.isEmpty():
        live = started(states).filter("point IS NOT NULL AND n_fit > 0")
        parts = map_batches(live.select(*keys, "z", "n_fit", "point", "k", "lags", "state"), sums, T.StructType([*key_fields, T.StructField("g", doubles)]))
        parts = parts.select(*keys, F.posexplode("g").alias("_i", "_v")).groupBy(*keys, "_i").agg(F.sum("_v").alias("_v"))
        g = parts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_i", "_v"))).alias("g")).select(*keys, F.col("g._v").alias("g"))
        states = settle(map_batches(attach(states, g, keys, ["g"]), move, state_fields), "css-states")
        finished = finished.unionByName(states.filter("done"))
        states = states.filter("NOT done")
    finished = finished.withColumn("point", F.col("best"))

    def shocks(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in pdf.itertuples(index=False):
            z, theta, beta, lags, state = of_block(r)
            out.append(products(z, theta, beta, lags, state)[1].tolist())
        return pdf[[*keys, "block"]].assign(e=out)

    e = started(finished).filter("point IS NOT NULL").select(*keys, "block", "z", "point", "k", "lags", "state")
    e = map_batches(e, shocks, T.StructType([*key_fields, T.StructField("block", T.LongType()), T.StructField("e", doubles)]))
    e = settle(e.select(*keys, "block", F.posexplode("e").alias("_i", "e")).select(*keys, (F.col("block") * block + F.col("_i") + 1).alias("step"), "e"), "css-shocks")
    size = F.col("k")
    fits = finished.select(*keys, F.slice("best", F.lit(1), size).alias("beta"), F.slice("best", size + 1, F.size("lags")).alias("shocks"), "ss")
    return fits, e
