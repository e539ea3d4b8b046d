"""Exact grouped medians in two scans, for groups of any size.

The first scan builds one mergeable quantile sketch per group and measure; two
of its quantiles, a little below and above the middle, bracket the median. The
second scan counts what lies below the bracket and how often each value inside it
occurs, so only counts are shuffled, and from a group of n rows about
4 n / ``accuracy`` of them. The middle ranks are then looked up. If one falls
outside the counted bracket, which the sketch's error bound rules out, that group
is done again with a wider one; the answer never rests on the sketch. One path
serves all sizes: of a small group the bracket is the middle value or two.
Infinities are values like others; NaN sorts last, as in Spark's ``median``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.session import settle

#: Ranks of the sketch are off by one part in so many at most.
ACCURACY = 10_000
#: Brackets (groups times measures, about 80 bytes each) up to which every task that counts holds them all.
HELD = 100_000


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality on all keys (a null key is a group of its own)."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys], F.lit(True))


def gathered(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """``df`` as a stored table with the rows of a group side by side, for ``exact_median``.

    Worth its one shuffle where there are many groups, or where ``df`` is dear to
    compute: sketches and counts of a group then meet in the task that reads it,
    and not as many small parts from every task, and both scans read the stored
    rows. A large group is cut over several tasks by its size; none is gathered whole.
    """
    return settle(df.hint("rebalance", *by) if by else df, "median-rows")


def exact_median(
    df: DataFrame, by: Sequence[str], cols: Sequence[str], *, accuracy: int = ACCURACY, count_as: str | None = None
) -> DataFrame:
    """Median of each column per group, nulls ignored; ``count_as`` names a column with the number of rows.

    The result is a stored table. Groups in which a measure is always null have
    a null median; without ``by`` there is one row, also of an empty table.
    """
    by, cols = list(by), list(cols)
    rows = df.select(*by, *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(cols)])
    found, share = _bracketed(rows, by, len(cols), accuracy, 2 / accuracy), 2 / accuracy
    out = found.filter("_ok")
    while share < 0.5 and not found.filter("NOT _ok").isEmpty():
        share *= 8
        left = found.filter("NOT _ok").select(*by)
        again = rows if not by else rows.join(left, same_keys(rows, left, by), "left_semi")
        found = _bracketed(again, by, len(cols), accuracy, min(share, 0.5))
        out = out.unionByName(found.filter("_ok"))
    count = [F.col("_rows").alias(count_as)] if count_as else []
    return out.select(*by, *[F.col(f"_v{i}").alias(c) for i, c in enumerate(cols)], *count)


def _bracketed(rows: DataFrame, by: list[str], n_cols: int, accuracy: int, share: float) -> DataFrame:
    """Per group: _rows, _v0, _v1, ... and whether the middle ranks lay inside the brackets (_ok)."""
    infinite = F.lit(float("inf"))
    nan = [F.isnan(f"_v{i}") for i in range(n_cols)]
    # NaN stands with infinity until the end: both sort after all other values.
    value = [F.when(nan[i], infinite).otherwise(F.col(f"_v{i}")) for i in range(n_cols)]
    ends = F.array(F.lit(max(0.5 - share, 0.0)), F.lit(min(0.5 + share, 1.0)))
    sketch = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[
            F.struct(F.percentile_approx(value[i], ends, accuracy).alias("q"), F.count(f"_v{i}").alias("n"), F.count(F.when(nan[i], 1)).alias("nan")).alias(f"_s{i}")
            for i in range(n_cols)
        ],
    )
    # Stored, so that the planner knows its size when it joins it to the rows.
    sketch = settle(sketch, "median-sketch")
    cell = [F.struct(F.lit(i).alias("_m"), value[i].alias("_v"), F.col(f"_s{i}.q").alias("_q"), F.col(f"_s{i}.n").alias("_n"), F.col(f"_s{i}.nan").alias("_nan")) for i in range(n_cols)]
    names = [f"_s{i}" for i in range(n_cols)]
    if by:
        small = sketch.select(*[F.col(k).alias(f"_key_{k}") for k in by], *names)
        on = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in by]
        # Rows are not shuffled again to meet a few brackets; the stored table is counted cheaply.
        most = HELD // n_cols
        held = rows.join(F.broadcast(small) if sketch.limit(most + 1).count() <= most else small, on)
    else:
        held = rows.withColumns({n: sketch.select(n).scalar() for n in names})
    held = held.select(*by, F.inline(F.array(*cell))).filter((F.col("_v") <= F.col("_q")[1]))
    inside = F.when(F.col("_v") >= F.col("_q")[0], F.col("_v"))
    keys = [*by, "_m"]
    counts = held.groupBy(*keys, "_n", "_nan", inside.alias("_x")).agg(F.count(F.lit(1)).alias("_c"))
    # Null, what lies below the bracket, comes first.
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy(F.asc_nulls_first("_x")))
    counts = counts.withColumn("_to", upto).withColumn("_from", F.col("_to") - F.col("_c"))
    middle = [F.expr("(_n - 1) div 2"), F.expr("_n div 2")]

    def at(rank: Column) -> Column:
        found = F.max(F.when((F.col("_from") <= rank) & (rank < F.col("_to")), F.col("_x")))
        return F.when(F.max(rank >= F.col("_n") - F.col("_nan")), float("nan")).otherwise(found)

    picked = counts.groupBy(*keys).agg(at(middle[0]).alias("_a"), at(middle[1]).alias("_b"))
    a, b = F.col("_a"), F.col("_b")
    median = F.when(a == b, a).otherwise(a / 2 + b / 2)
    wide = picked.groupBy(*by).agg(*[F.max(F.when(F.col("_m") == i, median)).alias(f"_v{i}") for i in range(n_cols)])
    if by:
        wide = wide.select(*[F.col(k).alias(f"_key_{k}") for k in by], *[f"_v{i}" for i in range(n_cols)])
        full = sketch.join(wide, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in by], "left")
    else:
        full = sketch.withColumns({f"_v{i}": wide.select(f"_v{i}").scalar() for i in range(n_cols)})
    ok = reduce(lambda x, y: x & y, [(F.col(f"_s{i}.n") == 0) | F.col(f"_v{i}").isNotNull() for i in range(n_cols)], F.lit(True))
    return settle(full.select(*by, "_rows", *[f"_v{i}" for i in range(n_cols)], ok.alias("_ok")), "medians")
