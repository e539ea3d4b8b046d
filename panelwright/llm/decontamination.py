"""Benchmark decontamination with built-in functions alone.

Benchmark items become windows of ``n`` consecutive normalised words (a shorter
item is one window). A text is scanned at every sixth word only: of the six
five-word seeds inside a ten-word window exactly one starts at such a word, so
looking those up in the hash set of all windows' seeds misses nothing (other
lengths likewise: seeds of half the length). Hits are verified word by word.
The hash set is broadcast if it is small; a larger one is joined by shuffle,
with only the words around each seed.

Defined results: null and empty texts and items have no words; repeated rows
are judged alike; items with equal windows all count; an item without an id
marks words but is not listed; empty tables give no hits, or no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.common import ascii_lower, keep, sized, with_rid

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Seed rows (about 150 bytes each) up to which the hash set is broadcast.
SEED_ROWS = 400_000


def words(text: Column | str, keep_case: bool = False) -> Column:
    """The words of a text, lower-case unless ``keep_case``; none for null."""
    text = F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit(""))
    if keep_case:
        return F.regexp_extract_all(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORDS), F.lit(0))


def seed_length(length: int) -> int:
    return max(1, length // 2)


@dataclass(frozen=True)
class Windows:
    """``seeds`` (seed hash, class, offset, window) and ``items`` (window, item_id) of a benchmark."""

    seeds: DataFrame
    items: DataFrame
    lengths: list[int]


def windows(bench: DataFrame, n: int = 10) -> Windows:
    items = bench.select("item_id", words("text").alias("w")).filter(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(n))
    at = F.explode(F.sequence(F.lit(1), F.size("w") - length + 1))
    cut = items.select("item_id", "w", length.alias("len"), at.alias("at"))
    cut = keep(cut.select("item_id", "len", F.slice("w", F.col("at"), F.col("len")).alias("w")), "windows")
    lengths = sorted(r[0] for r in cut.select("len").distinct().collect())  # at most n numbers
    distinct = cut.select("len", "w").distinct()
    text = F.array_join("w", " ")
    parts = []
    for kind, size in enumerate(lengths):
        q = seed_length(size)
        off = distinct.filter(F.col("len") == size).select("w", F.explode(F.sequence(F.lit(0), F.lit(size - q))).alias("off"))
        seed = F.xxhash64(F.slice("w", F.col("off") + 1, F.lit(q)), F.lit(kind))
        parts.append(off.select(seed.alias("seed"), F.lit(size).alias("len"), "off", text.alias("window")))
    empty = bench.sparkSession.createDataFrame([], "seed long, len int, off int, window string")
    seeds = empty
    for p in parts:
        seeds = seeds.unionByName(p)
    return Windows(keep(seeds, "seeds"), keep(cut.select(text.alias("window"), "item_id").distinct(), "items"), lengths)


def occurrences(docs: DataFrame, win: Windows) -> DataFrame:
    """One row per document (rid, doc_id, n_words; window null) and one per occurrence (start, len, window)."""
    base = with_rid(docs.select("doc_id", "text")).select("rid", "doc_id", words("text").alias("w"))
    m, nw = len(win.lengths) + 1, F.size("w")
    codes = [F.array(F.lit(-1))]
    q_of, back_of = F.lit(0), F.lit(0)
    for kind, size in enumerate(win.lengths):
        q = seed_length(size)
        run = F.sequence(F.lit(kind), (nw - q) * m + kind, F.lit((size - q + 1) * m))
        codes.append(F.when(nw >= size, run).otherwise(F.array().cast("array<int>")))
        q_of = F.when(F.col("kind") == kind, q).otherwise(q_of)
        back_of = F.when(F.col("kind") == kind, size - q).otherwise(back_of)
    at = base.select("rid", "doc_id", "w", nw.alias("n_words"), F.explode(F.concat(*codes)).alias("code"))
    at = at.withColumn("pos", F.floor(F.col("code") / m).cast("int")).withColumn("kind", F.pmod("code", F.lit(m)))
    hashed = F.when(F.col("code") >= 0, F.xxhash64(F.slice("w", F.col("pos") + 1, q_of), F.col("kind")))
    at = at.withColumn("seed", hashed)
    seeds = sized(win.seeds, SEED_ROWS)
    if seeds is win.seeds:
        # Too large to broadcast: rows are shuffled, each with the words around its seed.
        first = F.greatest(F.col("pos") - back_of, F.lit(0))
        around = F.slice("w", first + 1, F.when(F.col("code") >= 0, q_of + 2 * back_of).otherwise(0))
        at = at.select("rid", "doc_id", "n_words", "code", "pos", "seed", around.alias("w"), first.alias("first"))
    else:
        at = at.select("rid", "doc_id", "n_words", "code", "pos", "seed", "w", F.lit(0).alias("first"))
    joined = at.join(seeds, "seed", "left").filter("code < 0 OR window IS NOT NULL")
    start = F.col("pos") - F.col("off")
    inside = (start >= F.col("first")) & (start + F.col("len") <= F.col("n_words"))
    same = F.array_join(F.slice("w", start - F.col("first") + 1, F.col("len")), " ") == F.col("window")
    return joined.filter((F.col("code") < 0) | (F.when(inside, same).otherwise(False))).select(
        "rid", F.when(F.col("code") < 0, F.col("doc_id")).alias("doc_id"), F.when(F.col("code") < 0, F.col("n_words")).alias("n_words"),
        start.alias("start"), "len", "window",
    )


def coverage(found: DataFrame) -> DataFrame:
    """rid, doc_id, n_words, n_hit: the words that lie inside any occurrence."""
    end = F.col("start") + F.col("len")
    before = F.max(end).over(Window.partitionBy("rid").orderBy(F.col("start").asc_nulls_first(), "len").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(end - F.greatest("start", F.coalesce(before, F.lit(0))), F.lit(0))
    return (
        found.withColumn("new", F.coalesce(new, F.lit(0)))
        .groupBy("rid")
        .agg(F.max("doc_id").alias("doc_id"), F.max("n_words").cast("long").alias("n_words"), F.sum("new").cast("long").alias("n_hit"))
    )


def contamination(docs: DataFrame, bench: DataFrame, n: int = 10) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items."""
    win = windows(bench, n)
    found = keep(occurrences(docs, win), "occurrences")
    hits = found.filter(F.col("window").isNotNull()).select("rid", "window").distinct()
    listed = hits.join(sized(win.items), "window").filter(F.col("item_id").isNotNull()).select("rid", F.col("item_id").cast("string").alias("item"))
    items = listed.distinct().groupBy("rid").agg(F.sort_array(F.collect_list("item")).alias("items"))
    out = coverage(found).join(items, "rid", "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), items.alias("items"),
    )


def decontaminate(docs: DataFrame, bench: DataFrame, n: int = 10, remove: str = "documents") -> DataFrame:
    """The documents without benchmark passages, in their own columns.

    ``remove="documents"`` drops every document with an occurrence;
    ``remove="spans"`` drops the covered words of those and joins the other
    words by a space (texts without an occurrence stay as they are).
    """
    found = keep(occurrences(docs, windows(bench, n)).filter(F.col("window").isNotNull()).select("rid", "start", "len"), "hits")
    rows = with_rid(docs.select(F.struct("*").alias("row")))
    if remove == "documents":
        return rows.join(sized(found.select("rid").distinct()), "rid", "left_anti").select("row.*")
    spots = found.groupBy("rid").agg(F.collect_set(F.struct("start", "len")).alias("spots"))
    rows = rows.join(sized(spots, 10_000), "rid", "left")
    covered = lambda i: F.exists("spots", lambda s: (s.start <= i) & (i < s.start + s.len))
    left = F.filter(words("row.text", keep_case=True), lambda w, i: ~covered(i))
    text = F.when(F.col("spots").isNull(), F.col("row.text")).otherwise(F.array_join(left, " "))
    return rows.select(*[text.alias("text") if c == "text" else F.col(f"row.{c}").alias(c) for c in docs.columns])
