"""MinHash near-dedup by a multi-index Hamming join.

A document is its set of distinct word n-grams; its signature is ``CHUNKS`` x 4
minima of independent hashes, ``b`` = 16 bits of each, four to a chunk. The
distance of two signatures is the number of minima that differ. With
``CHUNKS`` x 2 - 1 differences or fewer, some chunk has one error at most
(pigeonhole); the allowed errors of a chunk are enumerated by leaving out each
of its minima in turn, so all pairs within that distance meet under an equal
key. Sets with similarity 0.8 differ in a fifth of the minima on average; that
ten chunks all have two errors then has the chance 0.18 ** 10, about 4e-8.

Pairs that meet are filtered by size and signature distance and confirmed on
full sets. Links need no pairs of one group: first each member is tried against
the group's centre, the member with most company; what these links join is one
component. Then only members of different components are tried, each pair under
the first key that it shares, and only those with n-grams enough that other such
sets have too: copies of one text too far from it are ruled out one by one, not
in pairs. Pairs left by then are sieved by longer signatures before their sets
are fetched. Equal sets are one class throughout.

Defined results: null and empty texts have no n-grams and link with nothing; a
text of fewer words is one n-gram; repeated rows are rows with equal sets; a
null doc_id counts after all others and is not kept; an empty table gives no
rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.across import across, fine_like, fine_signatures, like, minima, several, shareable
from panelwright.llm.common import among, keep, with_rid
from panelwright.llm.grams import U, batches, mix
from panelwright.llm.jaccard import components, counted, set_rows, shingles, similar

CHUNKS = 10
LANES = 4
#: Signatures with so many differing minima have a chunk with one error at most.
DISTANCE = 2 * CHUNKS - 1
_SEEDS = mix(np.arange(1, CHUNKS * LANES + 1, dtype=U) * U(0x9E3779B97F4A7C15))


def signature_rows(k: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for start, texts in batches(part.column("text")):
                row, gram = shingles(texts, k)
                n = np.bincount(row, minlength=len(texts)).astype(np.int64)
                starts = np.flatnonzero(np.diff(row, prepend=-1))
                a, b = np.zeros(len(texts), U), np.zeros(len(texts), U)
                sig = np.zeros((len(texts), CHUNKS), U)
                if len(row):
                    a[row[starts]] = np.add.reduceat(mix(gram + U(11)), starts)
                    b[row[starts]] = np.add.reduceat(mix(gram ^ U(0xC2B2AE3D27D4EB4F)), starts)
                    sig[row[starts]] = minima(gram, starts, _SEEDS, 16)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("rid").slice(start, len(texts)), part.column("doc_id").slice(start, len(texts)),
                        pa.array(n), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * CHUNKS), pa.array(sig.ravel().view(np.int64))),
                    ],
                    ["rid", "doc_id", "n", "a", "b", "sig"],
                )

    return run


def keyed(rows: DataFrame) -> DataFrame:
    """(key, chunk, rid): every chunk with each of its minima left out."""
    keys = []
    for chunk in range(CHUNKS):
        for lane in range(LANES):
            mask = ~(0xFFFF << 16 * lane) & (2**64 - 1)
            held = F.element_at("sig", chunk + 1).bitwiseAND(F.lit(mask - 2**64 if mask >> 63 else mask))
            keys.append(F.struct(F.xxhash64(F.lit(chunk * LANES + lane), held).alias("key"), F.lit(chunk * LANES + lane).alias("place")))
    return rows.select("rid", F.explode(F.array(*keys)).alias("k")).select("k.key", "k.place", "rid")


def _errors(a: Column, b: Column) -> Column:
    """In how many of its four minima a chunk differs.

    Each minimum's bits are folded into its lowest one; the shifts add up to 15,
    so nothing of the next minimum gets that far.
    """
    x = a.bitwiseXOR(b)
    for shift in (8, 4, 2, 1):
        x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
    return F.bit_count(x.bitwiseAND(F.lit(0x0001000100010001)))


def errors(x: str, y: str) -> list[Column]:
    """The errors of every chunk."""
    return [_errors(F.element_at(x, i), F.element_at(y, i)) for i in range(1, CHUNKS + 1)]


def distance(x: str, y: str) -> Column:
    return reduce(lambda a, b: a + b, errors(x, y))


def near_links(rows: DataFrame, texts: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Components (rid, comp) of the rows that meet another one, and the links that join them.

    ``rows`` has rid, n and sig of one row for each set; ``texts`` rid and text.
    """
    keys = keep(keyed(rows), "minhash-keys")
    common = keys.groupBy("key").agg(F.min("rid").alias("low"), F.max("rid").alias("high"), F.count(F.lit(1)).alias("size")).filter("low < high")
    groups = keep(keys.join(common.select("key", "size"), "key"), "minhash-groups")
    weight = keep(groups.groupBy("rid").agg(F.sum("size").alias("weight")), "minhash-weights")
    taking = rows.join(weight, "rid").select("rid", "n", "sig")
    taking = keep(taking, "minhash-taking")

    # Every member against the centre of each of its groups.
    centre = groups.join(weight, "rid").groupBy("key").agg(F.max(F.struct("weight", "rid")).alias("c")).select("key", F.col("c.rid").alias("c"))
    stars = groups.select("key", "rid").join(centre, "key").filter("c <> rid").select(F.least("c", "rid").alias("x"), F.greatest("c", "rid").alias("y")).distinct()
    ends = [taking.select(F.col("rid").alias(v), F.col("n").alias(f"n_{v}"), F.col("sig").alias(f"sig_{v}")) for v in ("x", "y")]
    near = like("n_x", "n_y", percent) & (distance("sig_x", "sig_y") <= DISTANCE)
    stars = keep(stars.join(ends[0], "x").join(ends[1], "y").filter(near).select("x", "y"), "minhash-stars")
    sets = among(texts, stars.select(F.col("x").alias("rid")).unionByName(stars.select(F.col("y").alias("rid"))))
    sets = keep(sets.mapInArrow(set_rows(k), "rid long, n long, cuts int, piece int, grams binary"), "minhash-sets")
    links = keep(similar(counted(stars, sets), percent), "minhash-links")
    label = components(keep(taking.select("rid", F.col("rid").alias("comp")), "minhash-labels"), links)

    # Then members of one group in different components.
    held = groups.select("key", "place", "rid").join(label, "rid")
    held = keep(several(held), "minhash-held")
    alone = shareable(held, texts, shingles, k)
    info = taking.join(alone, "rid").join(fine_signatures(alone, texts, shingles, k), "rid")
    rest = across(held, info, percent, ["place", "sig", "fine"], may_link() & fine_like(percent))
    rest = keep(rest.join(stars, ["x", "y"], "left_anti"), "minhash-rest")
    if not rest.isEmpty():
        sets = among(texts, rest.select(F.col("x").alias("rid")).unionByName(rest.select(F.col("y").alias("rid"))))
        sets = keep(sets.mapInArrow(set_rows(k), "rid long, n long, cuts int, piece int, grams binary"), "minhash-sets")
        more = keep(similar(counted(rest, sets), percent), "minhash-links")
        links, label = links.unionByName(more), components(label, more)
    return label, links


def may_link() -> Column:
    """Signatures within the distance, and the key is the first that the two rows share.

    Chunk by chunk, with no function of arrays: large groups try many pairs, and
    most are ruled out by the first chunk (they meet under an earlier key).
    """
    # A chunk without an error meets under all four of its keys, one with an error under one;
    # chunks before the key's have two errors at least.
    least = [(F.col("place_x") >= LANES * (i + 1)).cast("int") + (F.col("place_x") > LANES * i).cast("int") for i in range(CHUNKS)]
    first = reduce(lambda a, b: a & b, [e >= n for e, n in zip(errors("sig_x", "sig_y"), least)])
    return first & (distance("sig_x", "sig_y") <= DISTANCE)


def near_duplicates(docs: DataFrame, k: int = 4, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept (it is that one)."""
    base = with_rid(docs.select("doc_id", "text"))
    rows = keep(base.mapInArrow(signature_rows(k), "rid long, doc_id long, n long, a long, b long, sig array<long>"), "minhash-rows")
    reps = rows.filter("n > 0").groupBy("a", "b", "n").agg(F.min("rid").alias("rep"), F.count(F.lit(1)).alias("rows"))
    copies = keep(rows.join(reps.filter("rows > 1"), ["a", "b", "n"]).filter("rid <> rep").select("rid", "rep"), "minhash-copies")
    label, _ = near_links(rows.filter("n > 0").join(copies, "rid", "left_anti").select("rid", "n", "sig"), base.select("rid", "text"), k, percent)
    comp = copies.join(label.withColumnRenamed("rid", "rep"), "rep", "left").select("rid", F.coalesce("comp", "rep").alias("comp"))
    out = rows.select("rid", "doc_id", "n").join(label.unionByName(comp), "rid", "left").withColumn("comp", F.coalesce("comp", "rid"))
    out = keep(out, "minhash-classes")
    ids = out.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept")
    return out.join(ids, "comp").select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept)
