"""Linear recursions of many series as a scan of affine maps.

One step of w = x + a1 w[-1] + ... + aL w[-L], added up d times to a level, is an
affine map of a state: the last L values of w and the last two levels. A path is
cut into blocks of steps. A block's map is known without its start: its matrix is
a power of the companion matrix, its offset the block's end from a zero state.
Those maps are chained from block to block, and every block is then replayed
from its own start. So no task walks more than one block of a path, and only
block offsets of a series meet, never its steps.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.operators.gram import map_batches
from panelwright.operators.impute import attach

#: Steps of a path in one block.
BLOCK = 1024

_MAX = 1e300


def walk(state: np.ndarray, coefs: np.ndarray, d: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Levels (m, steps) and end states of m recursions, one step at a time for all of them.

    ``state`` (m, L + 2): the last values of w, newest first, and the last two
    levels; ``coefs`` (m, L); ``d`` (m,) from 0 to 2; ``x`` (m, steps).
    """
    m, steps = x.shape
    size = coefs.shape[1]
    last, before = np.array([0.0, 1.0, 2.0])[d], np.array([0.0, 0.0, -1.0])[d]
    # Newest values move towards the front, so that no step shifts the lags.
    w = np.empty((m, steps + size))
    w[:, steps:] = state[:, :size]
    y1, y2 = state[:, size].copy(), state[:, size + 1].copy()
    out = np.empty((m, steps))
    with np.errstate(all="ignore"):
        for j in range(steps):
            at = steps - j
            now = x[:, j] + np.einsum("ml,ml->m", coefs, w[:, at : at + size])
            w[:, at - 1] = now
            level = now + last * y1 + before * y2
            y1, y2 = level, y1
            out[:, j] = level
    return out, np.concatenate([w[:, :size], y1[:, None], y2[:, None]], axis=1)


def block_matrices(coefs: np.ndarray, d: np.ndarray, steps: int) -> np.ndarray:
    """(m, L + 2, L + 2): what a block of so many steps does to a state, by repeated squaring."""
    m, size = coefs.shape
    one = np.zeros((m, size + 2, size + 2))
    one[:, 0, :size] = coefs
    one[:, np.arange(1, size), np.arange(size - 1)] = 1.0
    one[:, size, :size] = coefs
    one[:, size, size] = np.array([0.0, 1.0, 2.0])[d]
    one[:, size, size + 1] = np.array([0.0, 0.0, -1.0])[d]
    one[:, size + 1, size] = 1.0
    with np.errstate(all="ignore"):
        return np.linalg.matrix_power(one, steps)


def chained(states: np.ndarray, matrices: np.ndarray, offsets: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Start states of the blocks after each series' blocks with the given offsets (blocks, L + 2)."""
    longest = max((len(o) for o in offsets), default=0)
    out = [np.empty((len(o), states.shape[1])) for o in offsets]
    with np.errstate(all="ignore"):
        for b in range(longest):
            live = np.array([i for i, o in enumerate(offsets) if len(o) > b])
            states[live] = np.einsum("mij,mj->mi", matrices[live], states[live]) + np.array([offsets[i][b] for i in live])
            for i in live:
                out[i][b] = states[i]
    return out


def _lists(values) -> np.ndarray:
    return np.vstack([np.asarray(v, float) for v in values])


def affine_paths(steps: DataFrame, starts: DataFrame, keys: Sequence[str], block: int | None = None) -> DataFrame:
    """Every step's row with its level: (keys, row, value, ok).

    ``steps`` has the keys, ``step`` (1, 2, ... without gaps), ``x`` and a struct
    ``row`` that is handed on; ``starts`` one row per key with ``coefs``
    array<double> (L), ``state`` array<double> (L + 2) and ``d``. ``ok`` says
    whether the whole path of the series is finite.
    """
    block, keys = block or BLOCK, list(keys)
    of = F.floor((F.col("step") - 1) / block).cast("long")
    item = F.struct("step", F.coalesce("x", F.lit(0.0)).alias("x"), "row")
    # At most ``block`` steps are gathered.
    cut = steps.select(*keys, of.alias("block"), item.alias("i")).groupBy(*keys, "block").agg(F.sort_array(F.collect_list("i")).alias("i"))
    cut = cut.select(*keys, "block", F.col("i.x").alias("x"), F.col("i.row").alias("rows"))
    starts = starts.select(*keys, F.col("coefs").alias("_a"), F.col("state").alias("_s"), F.col("d").alias("_d"))
    key_fields = [steps.schema[k] for k in keys]
    doubles = T.ArrayType(T.DoubleType())

    def offsets(pdf: pd.DataFrame) -> pd.DataFrame:
        a = _lists(pdf["_a"])
        _, end = walk(np.zeros((len(pdf), a.shape[1] + 2)), a, pdf["_d"].to_numpy(int), _lists(pdf["x"]))
        return pdf[[*keys, "block"]].assign(offset=end.tolist())

    # Only a full block has one after it.
    full = attach(cut.filter(F.size("x") == block).select(*keys, "block", "x"), starts, keys, ["_a", "_d"])
    schema = T.StructType([*key_fields, T.StructField("block", T.LongType()), T.StructField("offset", doubles)])
    maps = map_batches(full, offsets, schema)
    maps = maps.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("block", "offset"))).alias("o"))
    maps = attach(maps.select(*keys, F.col("o.offset").alias("_o")), starts, keys, ["_a", "_s", "_d"])

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        matrices = block_matrices(_lists(pdf["_a"]), pdf["_d"].to_numpy(int), block)
        found = chained(_lists(pdf["_s"]), matrices, [_lists(o) for o in pdf["_o"]])
        return pdf[keys].assign(states=[s.tolist() for s in found])

    later = map_batches(maps, chain, T.StructType([*key_fields, T.StructField("states", T.ArrayType(doubles))]))
    later = later.select(*keys, F.posexplode("states").alias("block", "_s")).withColumn("block", F.col("block").cast("long") + 1)
    states = starts.select(*keys, F.lit(0).cast("long").alias("block"), "_s").unionByName(later.select(*keys, "block", "_s"))
    cut = attach(attach(cut, starts, keys, ["_a", "_d"]), states, [*keys, "block"], ["_s"]).filter("_s IS NOT NULL")

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = {n: batch.column(n) for n in ("x", "_a", "_s", "_d")}
            sizes = column["x"].value_lengths().to_numpy()
            x = np.zeros((batch.num_rows, sizes.max()))
            inside = np.arange(x.shape[1]) < sizes[:, None]
            x[inside] = column["x"].flatten().to_numpy()
            a, s = (column[n].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for n in ("_a", "_s"))
            path, _ = walk(s, a, column["_d"].to_numpy().astype(int), x)
            values = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(path[inside]))
            ok = (~inside | (np.abs(path) < _MAX)).all(axis=1)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in [*keys, "rows"]], values, pa.array(ok)], [*keys, "rows", "path", "ok"])

    schema = T.StructType([*key_fields, cut.schema["rows"], T.StructField("path", doubles), T.StructField("ok", T.BooleanType())])
    paths = cut.select(*keys, "rows", "x", "_a", "_s", "_d").mapInArrow(replay, schema)
    # A value that is not finite stays in the state, but only from its block on.
    whole = paths.groupBy(*keys).agg(F.min("ok").alias("_ok"))
    paths = attach(paths, whole, keys, ["_ok"])
    return paths.select(*keys, F.inline(F.arrays_zip(F.col("rows").alias("row"), F.col("path").alias("value"))), F.col("_ok").alias("ok"))
