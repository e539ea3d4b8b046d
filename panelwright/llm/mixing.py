"""Mixing sources to target weights.

Tokens are summed per source. Targets share the corpus' tokens by weight; no
target exceeds ``cap`` times its source, and what that frees is shared again.
A source's repetition rate is target over tokens: each document is emitted
floor(rate) times, plus one hash-seeded Bernoulli copy with the fraction as its
probability. Several hash seeds are tried per source and the one whose total is
nearest the target is kept, so that small sources come near their targets too;
within one seed every document is still an independent draw.

Defined results: a null text has size 0; a null source is a source of its own,
last in order; a draw hashes the doc_id, the text and the row's place among rows
equal in both and in source, so rows of one doc_id (null, too) draw on their own and equal rows are
interchangeable; sources without tokens have rate 1, and an empty table gives no
rows. Other columns are left alone, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import WORD, keep, numbered_in, sized, with_rid
from panelwright.operators.series import positioned

SEEDS = 32


def n_tokens(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(seed: Column) -> Column:
    """A number from 0 to 1 that depends on the row's key and the seed alone."""
    text = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.hex("mark"), F.col("ordinal").cast("string"), seed.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def with_ordinal(rows: DataFrame) -> DataFrame:
    """``rows`` (rid, doc_id, source, mark) with ``ordinal``: 0, 1, 2 ... among equal rows.

    Only rows that have an equal one are numbered, within their input partitions.
    """
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("source", F.lit("")), "mark")
    slim = rows.select("rid", key.alias("key"))
    again = keep(slim.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "again")
    if again.isEmpty():
        return rows.withColumn("ordinal", F.lit(0).cast("long"))
    some = keep(numbered_in(slim.join(sized(again), "key"), "key", "ordinal").select("rid", "ordinal"), "ordinals")
    return rows.join(sized(some), "rid", "left").withColumn("ordinal", F.coalesce("ordinal", F.lit(0)))


def targets(sizes: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """``sizes`` (source, source_size; one row per source) with weight and target.

    The level ``share`` (tokens per unit of weight) rises until the capped and
    the uncapped targets use up all tokens; each step is one aggregated row.
    """
    spread = positioned(sizes.withColumn("_null", F.col("source").isNull()), ["_null"], ["source"])
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    spread = keep(
        spread.withColumn("weight", F.element_at(cycle, (F.col("_pos") % len(weights) + 1).cast("int"))).drop("_pos", "_null"),
        "weights",
    )
    limit = F.col("source_size") * float(cap)
    total = spread.agg(F.sum("source_size")).first()[0] or 0
    share = 0.0
    while total:
        full = F.col("weight") * share >= limit
        row = spread.agg(
            F.coalesce(F.sum(F.when(full, limit)), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))
        ).first()
        new = (total - row[0]) / row[1] if row[1] else share
        if new <= share:
            break
        share = new
    return spread.withColumn("target", F.least(limit, F.col("weight") * F.lit(share)))


def rates(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0) -> tuple[DataFrame, DataFrame]:
    """The documents' sizes (rid, doc_id, source, size, mark, ordinal) and, per source, target, rate, whole, fraction and seed."""
    mark = F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark")
    sizes = keep(with_rid(docs.select("doc_id", "source", n_tokens("text").alias("size"), mark)), "sizes")
    sizes = with_ordinal(sizes)
    sources = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(1.0)
    sources = sources.withColumn("rate", rate).withColumn("whole", F.floor("rate")).withColumn("fraction", F.col("rate") - F.col("whole"))
    sources = keep(sources, "rates")
    drawn = by_source(sizes.filter("size > 0"), sources)
    got = [
        F.sum(F.when(draw(F.lit(s)) < F.col("fraction"), F.col("size")).otherwise(0)).alias(f"s{s}") for s in range(SEEDS)
    ]
    totals = drawn.groupBy("source", "source_size", "fraction").agg(*got)
    off = [F.abs(F.col(f"s{s}") - F.col("fraction") * F.col("source_size")) for s in range(SEEDS)]
    best = F.array_position(F.array(*off), F.array_min(F.array(*off))).cast("int") - 1
    seeds = totals.select(F.col("source").alias("_s"), best.alias("_seed"))
    sources = sources.join(seeds, F.col("source").eqNullSafe(F.col("_s")), "left").withColumn("seed", F.coalesce("_seed", F.lit(0)))
    return sizes, keep(sources.drop("_s", "_seed"), "seeds")


def by_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows with their source's figures; broadcast if there are few sources."""
    side = sized(sources.withColumnRenamed("source", "_source"))
    return rows.join(side, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")


def copies() -> Column:
    """How often a document is emitted, from its source's whole, fraction and seed."""
    return (F.col("whole") + F.when(draw(F.col("seed")) < F.col("fraction"), 1).otherwise(0)).cast("int")


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """The mixed corpus: the documents' own columns, each row as often as it is taken."""
    sizes, sources = rates(docs, weights, cap)
    mark = F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark")
    rows = with_rid(docs.select("doc_id", "source", mark, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")))
    # Rows without an equal one have ordinal 0; the others' is looked up.
    rows = rows.join(sized(keep(sizes.filter("ordinal > 0").select("rid", "ordinal"), "ordinals")), "rid", "left")
    rows = by_source(rows.withColumn("ordinal", F.coalesce("ordinal", F.lit(0))), sources)
    taken = rows.withColumn("copies", copies()).filter("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def mixture(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """Per document: doc_id, size, source_size, target (its source's), taken, copies, source."""
    sizes, sources = rates(docs, weights, cap)
    rows = by_source(sizes, sources).withColumn("copies", copies())
    return rows.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies", "source"
    )
