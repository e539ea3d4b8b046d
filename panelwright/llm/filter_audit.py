"""Filter interaction audit from sorted posting lists.

Every filter has a posting list: the sorted row ids that fail it, kept for each
part and each range of ids. What a filter removes after others is the size of a
difference, its list less the union of theirs; what it finds gone is the rest.
Unions and differences are galloping merges within one id range, so no list is
ever whole in one place, and the sizes of all ranges are summed. Thirty-two
sets of earlier filters and five filters give all 120 orders.

Defined results: a null text is empty; a null part is the empty string; rows of
one doc_id are rows of their own; a null doc_id is never larger than another, so
it fails no comparison and has no labels; of several label rows of one doc_id
any 1 counts; a part is listed with all orders and steps, zeros included, and an
empty table has no parts. Other columns of the inputs are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import UPPER, keep, sized, with_rid

FILTERS = "ABCDE"
LISTS = [*FILTERS, "good", "toxic"]
#: Ids of one range: the longest posting list that a task holds.
SPAN = 1 << 16
#: Ids of the longest list between two cuts of a merge.
RUN = 512
#: Groups of equal texts up to which they are broadcast.
GROUPS = 200_000


def content_failures(text: Column) -> dict[str, Column]:
    """The four filters that look at one text: length, repetition, capitals, marks."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return {
        "A": F.size(words) < 100,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 80,
        "C": capitals * 100 > F.length(text) * 10,
        "D": text.rlike(r"[#$%&*|]"),
    }


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: rid, part, and whether it fails each filter, is good, is toxic."""
    text = F.coalesce("text", F.lit(""))
    own = [c.alias(f) for f, c in content_failures(text).items()]
    part = F.coalesce("lang", F.lit("")).alias("part")
    rows = keep(with_rid(docs.select("doc_id", part, F.unhex(F.sha2(text, 256)).alias("digest"), *own)), "audit-rows")
    # Partial aggregation: the rows of one text, however many, don't meet.
    groups = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first")
    rows = rows.join(sized(keep(groups, "audit-groups"), GROUPS), "digest", "left")
    marks = [F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(m) for c, m in (("quality", "good"), ("toxic", "toxic"))]
    marked = labels.select("doc_id", "quality", "toxic").filter("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy("doc_id").agg(*marks)
    rows = rows.join(sized(keep(marked, "audit-marks")), "doc_id", "left")
    return rows.select(
        "rid", "part", *"ABCD", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("E"),
        F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"),
    )


def posting_lists(rows: DataFrame) -> DataFrame:
    """(part, span, n, one sorted list of ids per filter and label): at most SPAN ids a list."""
    lists = [F.sort_array(F.collect_list(F.when(F.col(c), F.col("rid")))).alias(c) for c in LISTS]
    span = F.shiftright("rid", SPAN.bit_length() - 1)
    return rows.groupBy("part", span.alias("span")).agg(F.count(F.lit(1)).alias("n"), *lists)


def gallop(ids: np.ndarray, start: int, wanted: int) -> int:
    """First place from ``start`` on with an id of ``wanted`` or more, by steps that double."""
    low, step = start, 1
    while low + step < len(ids) and ids[low + step] < wanted:
        low += step
        step *= 2
    return low + int(np.searchsorted(ids[low : low + step + 1], wanted))


def windows(lists: list[np.ndarray], run: int = RUN) -> Iterator[list[np.ndarray]]:
    """The lists cut alike at every ``run``-th id of the longest; the others gallop to each cut."""
    at = [0] * len(lists)
    for cut in [*max(lists, key=len)[run::run], None]:
        ends = [len(x) if cut is None else gallop(x, a, cut) for x, a in zip(lists, at)]
        yield [x[a:e] for x, a, e in zip(lists, at, ends)]
        at = ends


def union(lists: list[np.ndarray]) -> np.ndarray:
    """Ids in any of the sorted lists."""
    full = [x for x in lists if len(x)]
    if len(full) < 2:
        return full[0] if full else np.zeros(0, np.int64)
    out = []
    for cut in windows(full):
        some = [x for x in cut if len(x)]
        out.append(some[0] if len(some) == 1 else np.unique(np.concatenate(some)))
    return np.concatenate(out)


def less(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ids of ``a`` that ``b`` lacks."""
    if not len(a) or not len(b):
        return a
    out = []
    for x, y in windows([a, b]):
        if len(x) and len(y):
            x = x[y[np.minimum(np.searchsorted(y, x), len(y) - 1)] != x]
        out.append(x)
    return np.concatenate(out)


def sizes_of(n: int, lists: list[np.ndarray]) -> Iterator[tuple[int, int, int, int, int, int, int]]:
    """(before, step, kept, removed, redundant, good, toxic): every set of earlier filters with every other filter."""
    k = len(FILTERS)
    fail, good, toxic = lists[:k], lists[k], lists[k + 1]
    unions = [union([fail[i] for i in range(k) if s >> i & 1]) for s in range(1 << k)]
    for s in range(1 << k):
        for f in range(k):
            if s >> f & 1:
                continue
            gone = less(fail[f], unions[s])
            lost = [len(gone) - len(less(gone, x)) for x in (good, toxic)]
            yield s, f, n - len(unions[s | 1 << f]), len(gone), len(fail[f]) - len(gone), *lost


def size_rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for i in range(part.num_rows):
            row = part.slice(i, 1)
            lists = [row.column(c).flatten().to_numpy(zero_copy_only=False) for c in LISTS]
            sizes = list(zip(*sizes_of(row.column("n")[0].as_py(), lists)))
            name = pa.array([row.column("part")[0].as_py()] * len(sizes[0]), pa.string())
            yield pa.RecordBatch.from_arrays([name, *[pa.array(x, pa.int64()) for x in sizes]], ["part", *SIZES])


SIZES = ["before", "filter", "kept", "removed", "redundant", "good_lost", "toxic_lost"]


def orders(like: DataFrame) -> DataFrame:
    """(filter_order, step, before, filter): the steps of all orders, 600 rows."""
    out = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(order):
            out.append(("".join(FILTERS[i] for i in order), step + 1, before, f))
            before |= 1 << f
    return like.sparkSession.createDataFrame(out, "filter_order string, step int, before long, filter long")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, order of the filters and step: what stays, goes, was gone already, and each filter's share."""
    lists = posting_lists(failures(docs, labels))
    kinds = ", ".join(["part string", *[f"{c} long" for c in SIZES]])
    sums = lists.mapInArrow(size_rows, kinds).groupBy("part", "before", "filter").agg(*[F.sum(c).alias(c) for c in SIZES[2:]])
    sums = keep(sums, "audit-sizes")
    # What only this filter would remove: all others before it.
    others = F.array(*[F.lit((1 << len(FILTERS)) - 1 - (1 << f)) for f in range(len(FILTERS))])
    alone = sums.filter(F.col("before") == others[F.col("filter")]).select("part", "filter", F.col("removed").alias("unique_fails"))
    steps = orders(docs)
    times = steps.groupBy("before", "filter").agg(F.count(F.lit(1)).alias("times"))
    share = sums.join(F.broadcast(times), ["before", "filter"]).groupBy("part", "filter").agg(F.sum(F.col("removed") * F.col("times")).alias("shapley"))
    out = sums.join(F.broadcast(steps), ["before", "filter"]).join(alone, ["part", "filter"]).join(share, ["part", "filter"])
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
