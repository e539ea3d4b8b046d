"""Pairs of different components that may be similar, for similarity joins.

Groups (rows that share a key) may hold many members of few components. Sets are
ruled out one by one before any pair is formed: what no other set of the groups
has, no pair can share, and a set with too much of that has no partner.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import among, keep
from panelwright.llm.grams import U, batches, mix

#: Growth of the size cells.
CELL = 1.02
#: Least keys of a row by which a pair is known under several groups.
LEAST = 8
LEAST_KEYS = [f"key_{i}" for i in range(LEAST)]
#: Minima of four bits by which pairs are sieved before their sets are fetched.
FINE = 1024
_FINE_SEEDS = mix(np.arange(1, FINE + 1, dtype=U) * U(0xC2B2AE3D27D4EB4F))


def several(held: DataFrame) -> DataFrame:
    """Rows of the groups (``key``) that have members of more than one component (``comp``)."""
    span = held.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("key")
    return held.join(span, "key")


def gram_rows(shingles, k: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rids = part.column("rid").to_numpy()
            for start, texts in batches(part.column("text")):
                row, gram = shingles(texts, k)
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(rids[row + start])], ["gram", "rid"])

    return run


def shareable(held: DataFrame, texts: DataFrame, shingles, k: int) -> DataFrame:
    """(rid, alone): how many of a set's n-grams no other set of ``held`` has, which no pair can share."""
    ids = keep(held.select("rid").distinct(), "across-ids")
    each = among(texts, ids).mapInArrow(gram_rows(shingles, k), "gram long, rid long")
    alone = each.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("rid").alias("rid")).filter("n = 1")
    alone = alone.groupBy("rid").agg(F.count(F.lit(1)).alias("alone"))
    return keep(ids.join(alone, "rid", "left").select("rid", F.coalesce("alone", F.lit(0)).alias("alone")), "across-alone")


def minima(gram: np.ndarray, starts: np.ndarray, seeds: np.ndarray, bits: int) -> np.ndarray:
    """Longs of as many minima of ``bits`` bits as fit, a row for each of the sets that start at ``starts``."""
    lanes = 64 // bits
    out = np.zeros((len(starts), len(seeds) // lanes), U)
    for i, seed in enumerate(seeds):
        h = gram ^ seed
        h *= U(0xD6E8FEB86659FD93)
        h ^= h >> U(32)
        h *= seed | U(1)
        low = mix(np.minimum.reduceat(h, starts)) & U((1 << bits) - 1)
        out[:, i // lanes] |= low << U(bits * (i % lanes))
    return out


def fine_rows(shingles, k: int):
    """(rid, fine): signatures of FINE minima of four bits."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rids = part.column("rid").to_numpy()
            for start, texts in batches(part.column("text")):
                row, gram = shingles(texts, k)
                if len(row):
                    first = np.flatnonzero(np.diff(row, prepend=-1))
                    sig = minima(gram, first, _FINE_SEEDS, 4)
                    offsets = pa.array(np.arange(len(first) + 1, dtype=np.int32) * sig.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(rids[row[first] + start]), pa.ListArray.from_arrays(offsets, pa.array(sig.ravel().view(np.int64)))], ["rid", "fine"])

    return run


def fine_limit(percent: int) -> int:
    """Differing fine minima that a pair at the threshold exceeds with a chance of about 1e-7."""
    p = (1 - percent / 100) * 15 / 16
    return int(FINE * p + 5.2 * (FINE * p * (1 - p)) ** 0.5)


def _fine_errors(a: Column, b: Column) -> Column:
    x = a.bitwiseXOR(b)
    for shift in (2, 1):
        x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
    return F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))

def fine_signatures(ids: DataFrame, texts: DataFrame, shingles, k: int) -> DataFrame:
    """(rid, fine) of the sets in ``ids``."""
    return keep(among(texts, ids.select("rid")).mapInArrow(fine_rows(shingles, k), "rid long, fine array<long>"), "across-fine")


def fine_like(percent: int) -> Column:
    """Whether two sets may be similar by their fine signatures."""
    fine = F.aggregate(F.zip_with("fine_x", "fine_y", _fine_errors), F.lit(0), lambda total, e: total + e)
    return fine <= fine_limit(percent)


def like(x: str, y: str, percent: int) -> Column:
    """Whether two sets may be similar by their sizes."""
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def least_keys(held: DataFrame, key: str) -> DataFrame:
    """(rid, key_0, key_1, ...): of LEAST classes of keys, the least one that a row has."""
    place = F.pmod(F.xxhash64(key), F.lit(LEAST))
    return held.groupBy("rid").agg(*[F.min(F.when(place == i, F.col(key))).alias(v) for i, v in enumerate(LEAST_KEYS)])


def meets_here(key: str) -> Column:
    """Whether a pair that meets under ``key`` counts there.

    A pair with many keys in common has some least key (see ``least_keys``) in
    common too, and counts under the first of those alone; one without counts
    under every key that it shares.
    """
    first = F.coalesce(*[F.when(F.col(f"{v}_x") == F.col(f"{v}_y"), F.col(f"{v}_x")) for v in LEAST_KEYS])
    return F.coalesce(first == F.col(key), F.lit(True))


def across(held: DataFrame, info: DataFrame, percent: int, more: Sequence[str] = (), also: Column | None = None) -> DataFrame:
    """(x, y): pairs of a group but not of a component that may be similar; a pair may come from a few groups.

    ``held`` has key, rid, comp and the columns ``more``; ``info`` has rid, n,
    alone and columns ``more`` too. ``also`` is a further condition on columns
    with the endings ``_x`` and ``_y``.

    With at most ``a`` n-grams that another set may have, a set of n is similar
    to one of m only if (100 + percent) a >= percent (n + m). So the smaller set
    of a pair has to be ``free``: able to share enough with a set of its own
    size. Copies of a text too far from it share too little with each other, and
    are tried against smaller sets alone, found by cells of size. Of the free
    members those outside a group's largest component meet all others.
    """
    extra = [c for c in (*held.columns, *info.columns) if c in more]
    a = F.col("n") - F.col("alone")
    reach = F.floor((100 + percent) * a / percent) - F.col("n")
    info = info.withColumn("a", a).withColumn("reach", reach).filter(F.col("reach") * 100 >= F.col("n") * percent)
    cell = lambda n: F.log(n.cast("double")) / F.log(F.lit(CELL))
    rows = held.join(info.drop("alone"), "rid").withColumn("free", F.col("reach") >= F.col("n")).withColumn("cell", F.floor(cell(F.col("n"))))
    rows = keep(rows, "across-rows")
    free = rows.filter("free")
    held_free = several(free)
    sizes = held_free.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.max(F.struct("c", "comp")).alias("m"))
    held_free = keep(held_free.join(sizes.select("key", F.col("m.comp").alias("major")), "key"), "across-free")

    def side(df: DataFrame, v: str, *columns: str) -> DataFrame:
        return df.select(*[F.col(c).alias(f"{c}_{v}") for c in ("key", "rid", "comp", "n", "a", *columns, *extra)])

    enough = (100 + percent) * F.least("a_x", "a_y") >= percent * (F.col("n_x") + F.col("n_y"))
    fit = (F.col("key_x") == F.col("key_y")) & (F.col("comp_x") != F.col("comp_y")) & like("n_x", "n_y", percent) & enough
    fit = fit if also is None else fit & also
    once = (F.col("comp_y") == F.col("major_y")) | (F.col("rid_x") < F.col("rid_y"))
    pairs = side(held_free.filter("comp <> major"), "x").join(side(held_free, "y", "major"), fit & once)
    # Larger members that aren't free, against free ones of the sizes that they can match.
    bound = rows.filter("NOT free").join(free.select("key").distinct(), "key")
    low, high = F.floor(cell(F.col("n") * (percent / 100)) - 1e-9), F.floor(cell(F.col("reach")) + 1e-9)
    bound = bound.withColumn("cell", F.explode(F.sequence(low, F.greatest(low, high))))
    wide = side(bound, "x", "cell").join(side(free, "y", "cell"), fit & (F.col("cell_x") == F.col("cell_y")))
    pick = [F.least("rid_x", "rid_y").alias("x"), F.greatest("rid_x", "rid_y").alias("y")]
    return pairs.select(*pick).unionByName(wide.select(*pick))
