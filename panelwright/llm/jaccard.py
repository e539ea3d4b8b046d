"""N-gram Jaccard join by vertical partitioning.

A document is its set of distinct word n-grams. The global order of n-grams is
that of their hashes, cut into equal fragments; sets of like size are cut alike.
Two sets with similarity at or over the threshold differ in at most D n-grams,
so of D + 1 fragments one is the same in both: fragments with equal content
propose pairs, without a frequency table and without the lists of common
n-grams. (A few fragments more than that allow for empty ones, which say
nothing; sets with too many empty fragments are cut again by another hash.)
Proposed pairs are counted fragment by fragment: each fragment's shared n-grams
separately, summed per pair.

Links are found in two rounds. First every set is tried against one centre of
each equal-fragment group, the member with most fragments in common with others
(of a text and its edited copies, the text); members joined by those links are
one component. Where components alone are wanted, groups that still hold several
then try their members across components (see ``across``). For all links the
groups try their members in pairs, but for those that their common hub rules
out. A set's
hub is found by going from centre to centre while half of the n-grams are
shared, so that a text and its edited copies have one hub however many groups
they fall into. With a and b as n-grams shared with the hub, two members share
min(a, b) of the hub's at most; where that is too little they have to share an
n-gram that the hub lacks, and are found by joining on those. No link is missed;
all links among copies similar to each other are as many as their pairs.

Defined results: null and empty texts have no n-grams and link with nothing; a
text of fewer words is one n-gram; repeated rows are rows with equal sets; a
null doc_id counts after all others; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.across import LEAST_KEYS, across, fine_like, fine_signatures, least_keys, meets_here, several, shareable
from panelwright.llm.common import among, keep, sized, with_rid
from panelwright.llm.grams import U, batches, grams, inside, mix, row_of, words
from panelwright.session import let_go

LAST = 2**63 - 1
#: Growth of the size classes.
STEP = 1.25
#: Hashes in one fragment of a set as it is counted.
PIECE = 4096
#: Turns in which the sets of many pairs are dealt.
TURNS = 2
#: Turns of the signatures, and of the pairs with their sets, where components alone are wanted.
SIGNATURE_TURNS, PAIR_TURNS = 2, 4
LEVELS = 8


def size_classes(percent: int, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Upper ends of the classes up to ``top``, their fragments, and the empty ones allowed for."""
    ends = [1]
    while ends[-1] < top:
        ends.append(max(ends[-1] + 1, int(ends[-1] * STEP)))
    ends = np.array(ends, np.int64)
    most = 2 * ends * (100 - percent) // (100 + percent)
    # About a thirteenth of the fragments may be empty in the smallest sets of a class.
    spare = np.where(most > 0, 1 + most // 12, 0)
    return ends, most + 1 + spare, spare


def shingles(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of the distinct k-grams, sorted by both; a shorter text is one gram."""
    h, counts = words(texts, lower=True)
    parts_row, parts_hash = [], []
    row = row_of(counts)
    ok = inside(counts, k, len(h))
    parts_row.append(row[: len(ok)][ok])
    parts_hash.append(grams(h, k)[ok])
    starts = np.cumsum(counts) - counts
    for n in range(1, k):
        short = np.flatnonzero(counts == n)
        if len(short):
            parts_row.append(short)
            parts_hash.append(mix(grams(h, n)[starts[short]] + U(n)))
    row, gram = np.concatenate(parts_row), np.concatenate(parts_hash)
    order = np.lexsort((gram, row))
    row, gram = row[order], gram[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])
    return row[new], gram[new]


def _fragment(gram: np.ndarray, fragments: np.ndarray) -> np.ndarray:
    """Which of so many equal ranges of hashes each one lies in."""
    return (((gram >> U(32)) * fragments.astype(U)) >> U(32)).astype(np.int64)


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts) if len(starts) else np.zeros(0, U)


def signatures(row: np.ndarray, gram: np.ndarray, n_rows: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature) of the non-empty fragments of each set, for its own size class and the next ones where a partner may be."""
    size = np.bincount(row, minlength=n_rows)
    if not len(row):
        return row, gram
    ends, cuts, spare = size_classes(percent, int(size.max() * 100 // percent + 1))
    own = np.searchsorted(ends, size)
    out_row, out_sig = [], []
    # The class of the largest partner.
    reach = np.searchsorted(ends, size * 100 // percent)
    for ahead in range(int((reach - own).max()) + 1):
        cls = own + ahead
        todo = (size > 0) & (reach >= cls)
        for level in range(LEVELS):
            if not todo.any():
                break
            pick = todo[row]
            r, g = row[pick], gram[pick]
            if level:
                g = mix(g ^ U(level * 0x9E3779B97F4A7C15 % 2**64))
                order = np.lexsort((g, r))
                r, g = r[order], g[order]
            c = cls[r]
            if level == LEVELS - 1:
                # Cut again and again in vain: each n-gram is a fragment of its own.
                part, starts = None, np.arange(len(r))
            else:
                part = _fragment(g, cuts[c])
                key = np.ones(len(r), bool)
                key[1:] = (r[1:] != r[:-1]) | (part[1:] != part[:-1])
                starts = np.flatnonzero(key)
            total = _sums(mix(g + U(0x632BE59BD9B4E019)), starts)
            where = total if part is None else total ^ mix(part[starts].astype(U) + U(1))
            label = (c[starts] * (2 * LEVELS) + level).astype(U)
            out_row.append(r[starts])
            out_sig.append(mix(where + mix(label + U(0x9E3779B9))))
            if part is None:
                break
            full = np.bincount(r[starts], minlength=n_rows)
            empty = cuts[np.minimum(cls, len(cuts) - 1)] - full
            todo = todo & (empty > spare[np.minimum(cls, len(cuts) - 1)])
    return np.concatenate(out_row), np.concatenate(out_sig)


def signature_rows(k: int, percent: int, turn: int = 0, turns: int = 1):
    """(sig, rid) of one turn: signatures are dealt to the turns by themselves, so equal ones share a turn."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rids = part.column("rid").to_numpy()
            for start, texts in batches(part.column("text")):
                row, gram = shingles(texts, k)
                row, sig = signatures(row, gram, len(texts), percent)
                if turns > 1:
                    now = sig % U(turns) == U(turn)
                    row, sig = row[now], sig[now]
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(rids[row + start])], ["sig", "rid"])

    return run


def size_rows(k: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for start, texts in batches(part.column("text")):
                row, gram = shingles(texts, k)
                size = np.bincount(row, minlength=len(texts)).astype(np.int64)
                # A digest of the set in two sums; equal sets are one class.
                starts = np.flatnonzero(np.diff(row, prepend=-1))
                a, b = np.zeros(len(texts), U), np.zeros(len(texts), U)
                a[row[starts]] = _sums(mix(gram + U(11)), starts)
                b[row[starts]] = _sums(mix(gram ^ U(0xC2B2AE3D27D4EB4F)), starts)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("rid").slice(start, len(texts)), part.column("doc_id").slice(start, len(texts)),
                        pa.array(size), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)),
                    ],
                    ["rid", "doc_id", "n", "a", "b"],
                )

    return run


SET_KINDS = "rid long, n long, cuts int, piece int, grams binary"


def set_rows(k: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rids = part.column("rid").to_numpy()
            for start, texts in batches(part.column("text")):
                row, gram = shingles(texts, k)
                size = np.bincount(row, minlength=len(texts))
                # Fragments by powers of two, so that those of two sets can be laid over each other.
                cuts = 1 << np.ceil(np.log2(np.maximum(size / PIECE, 1))).astype(np.int64)
                piece = _fragment(gram, cuts[row])
                starts = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(piece, prepend=-1) != 0))
                ends = np.append(starts[1:], len(row)) if len(starts) else starts
                raw = gram.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rids[row[starts] + start]), pa.array(size[row[starts]]), pa.array(cuts[row[starts]].astype(np.int32)),
                        pa.array(piece[starts].astype(np.int32)), pa.array([raw[8 * s : 8 * e] for s, e in zip(starts, ends)], pa.binary()),
                    ],
                    ["rid", "n", "cuts", "piece", "grams"],
                )

    return run


def shared_rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shared n-grams of two fragments."""
    for part in parts:
        a, b = part.column("grams_a"), part.column("grams_b")
        n = [len(np.intersect1d(np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U), assume_unique=True)) for x, y in zip(a, b)]
        yield pa.RecordBatch.from_arrays([part.column("x"), part.column("y"), part.column("n_a"), part.column("n_b"), pa.array(n, pa.int64())], ["x", "y", "n_a", "n_b", "shared"])


def counted(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(x, y, n_a, n_b, shared) of ``pairs`` (x, y), counted fragment by fragment."""
    ends = pairs.select(F.col("x").alias("rid")).unionByName(pairs.select(F.col("y").alias("rid")))
    sets = among(sets, ends)
    whole = sets.filter("cuts = 1")
    few = pairs.join(whole.select(F.col("rid").alias("x"), F.col("n").alias("n_a"), F.col("grams").alias("grams_a")), "x")
    few = few.join(whole.select(F.col("rid").alias("y"), F.col("n").alias("n_b"), F.col("grams").alias("grams_b")), "y")
    # Larger sets meet fragment by fragment, at the coarser of their two cuts; only pairs with one of them are looked at again.
    long = keep(sets.filter("cuts > 1").select("rid", "cuts").distinct(), "long")
    long_x, long_y = [long.select(F.col("rid").alias(v), F.col("cuts").alias(f"cuts_{v}")) for v in ("x", "y")]
    big = pairs.join(long_x, "x").join(long_y, "y", "left").unionByName(pairs.join(long_y, "y").join(long_x, "x", "left_anti").withColumn("cuts_x", F.lit(1)))
    cut = F.least("cuts_x", F.coalesce("cuts_y", F.lit(1)))
    big = keep(big.select("x", "y", cut.alias("cut")), "big")
    sets = among(sets, big.select(F.col("x").alias("rid")).unionByName(big.select(F.col("y").alias("rid"))))
    a = big.join(sets.select(F.col("rid").alias("x"), F.col("n").alias("n_a"), "cuts", "piece", F.col("grams").alias("grams_a")), "x")
    a = a.select("x", "y", "cut", "n_a", "grams_a", F.floor(F.col("piece") * F.col("cut") / F.col("cuts")).cast("int").alias("at"))
    b = big.join(sets.select(F.col("rid").alias("y"), F.col("n").alias("n_b"), "cuts", "piece", F.col("grams").alias("grams_b")), "y")
    b = b.select("x", "y", "n_b", "grams_b", F.floor(F.col("piece") * F.col("cut") / F.col("cuts")).cast("int").alias("at"))
    large = a.drop("cut").join(b, ["x", "y", "at"])
    cols = ["x", "y", "n_a", "n_b", "grams_a", "grams_b"]
    kinds = "x long, y long, n_a long, n_b long, shared long"
    parts = few.select(*cols).unionByName(large.select(*cols)).mapInArrow(shared_rows, kinds)
    return parts.groupBy("x", "y").agg(F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"), F.sum("shared").alias("shared"))


def counted_in_turns(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``counted`` for a stored table of many pairs, a part of them at a time: the sets of one part go before the next are dealt."""
    turn = F.pmod(F.xxhash64("x"), F.lit(TURNS))
    return reduce(DataFrame.unionByName, [keep(counted(pairs.filter(turn == i), sets), "sums") for i in range(TURNS)])


def counted_with_sets(pairs: DataFrame, texts: DataFrame, k: int, turns: int = 1) -> DataFrame:
    """``counted`` for a stored table of pairs in turns, each with the sets of its own pairs, which go with the turn."""
    turn, sums = F.pmod(F.xxhash64("x"), F.lit(turns)), []
    for i in range(turns):
        part = pairs.filter(turn == i)
        ends = part.select(F.col("x").alias("rid")).unionByName(part.select(F.col("y").alias("rid")))
        sets = keep(among(texts, ends).mapInArrow(set_rows(k), SET_KINDS), "sets")
        sums.append(keep(counted(part, sets), "sums"))
        let_go(sets)
    return reduce(DataFrame.unionByName, sums)


def enough(shared: Column, n_a: Column, n_b: Column, percent: int) -> Column:
    return shared * 100 >= percent * (n_a + n_b - shared)


def similar(sums: DataFrame, percent: int) -> DataFrame:
    return sums.filter(enough(F.col("shared"), F.col("n_a"), F.col("n_b"), percent)).select("x", "y", "shared", "n_a", "n_b")


def lacking_rows(percent: int):
    """(gram, rid, c, n, comp, o): n-grams of a set that its hub lacks.

    A similar set has ``percent`` of the set's n-grams, ``o`` of them from the hub
    at most, so r others at least: of two sets' lacking n-grams in one order, all
    but the last r - 1 are enough to meet.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out, size = [np.zeros(0, U)], []
            for x, y, n, o in zip(part.column("grams"), part.column("hub_grams"), part.column("n").to_pylist(), part.column("o").to_pylist()):
                lack = np.setdiff1d(np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U), assume_unique=True)
                r = max(-(-percent * n // 100) - o, 1)
                out.append(lack[: len(lack) - r + 1])
                size.append(len(out[-1]))
            at = np.repeat(np.arange(part.num_rows), np.array(size, np.int64))
            rest = ["rid", "c", "n", "comp", "o"]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), *[part.column(v).take(pa.array(at)) for v in rest]], ["gram", *rest])

    return run


def within(held: DataFrame, info: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(x, y): pairs of members that may be similar.

    ``info`` has rid, n, comp and, where there is one, the hub c and the n-grams
    o shared with it. Members of a group meet by families, those of one hub: the
    families of a group in pairs, and within one only the members near its hub.
    """
    info = info.withColumn("fam", F.coalesce("c", -1 - F.col("rid")))
    a = info.select([F.col(v).alias(f"{v}_x") for v in info.columns])
    n_x, n_y, low = F.col("n_x"), F.col("n_y"), F.least("o_x", "o_y")
    like = F.least(n_x, n_y) * 100 >= F.greatest(n_x, n_y) * percent
    fit = like & (F.col("rid_x") < F.col("rid_y"))
    least = least_keys(held, "sig")
    least = least.select(F.col("rid").alias("rid_x"), *[F.col(v).alias(f"{v}_x") for v in LEAST_KEYS])
    left = keep(held.select("sig", F.col("rid").alias("rid_x")).join(a.join(least, "rid_x"), "rid_x"), "members")
    right = left.select("sig", *[F.col(f"{v}_x").alias(f"{v}_y") for v in (*info.columns, *LEAST_KEYS)])
    family = left.select("sig", "fam_x").distinct()
    couples = family.join(family.withColumnRenamed("fam_x", "fam_y"), "sig").filter("fam_x < fam_y")
    apart = couples.join(left, ["sig", "fam_x"]).join(right, ["sig", "fam_y"]).filter(like & meets_here("sig"))
    # Sharing less than the threshold with the hub, a member can't be similar to another by the hub's n-grams.
    near = [side.filter(F.col(f"o_{v}") * 100 >= F.col(f"n_{v}") * percent) for side, v in ((left, "x"), (right, "y"))]
    inner = near[0].join(near[1].withColumnRenamed("sig", "sig_y"), (F.col("sig") == F.col("sig_y")) & (F.col("c_x") == F.col("c_y")) & fit & enough(low, n_x, n_y, percent) & meets_here("sig"))

    whole = sets.filter("cuts = 1").select("rid", "grams")
    own = keep(info.filter("c IS NOT NULL").join(held.select("rid").distinct(), "rid", "left_semi").select("rid", "c", "n", "comp", "o"), "own")
    hubs = among(whole, own.select(F.col("c").alias("rid"))).select(F.col("rid").alias("c"), F.col("grams").alias("hub_grams"))
    own = own.join(among(whole, own.select("rid")), "rid").join(hubs, "c")
    lack = own.select("rid", "c", "n", "comp", "o", "grams", "hub_grams").mapInArrow(lacking_rows(percent), "gram long, rid long, c long, n long, comp long, o long")
    lack = keep(lack, "lacking")
    most = low + F.least(n_x - F.col("o_x"), n_y - F.col("o_y"))
    left, right = [lack.select(F.col("gram").alias(g), *[F.col(v).alias(f"{v}_{end}") for v in lack.columns[1:]]) for g, end in (("gram", "x"), ("gram_y", "y"))]
    other = left.join(right, (F.col("gram") == F.col("gram_y")) & (F.col("c_x") == F.col("c_y")) & fit & enough(most, n_x, n_y, percent))
    pick = [F.least("rid_x", "rid_y").alias("x"), F.greatest("rid_x", "rid_y").alias("y")]
    return apart.select(*pick).unionByName(inner.select(*pick)).unionByName(other.select(*pick)).distinct()


def followed(low: DataFrame, *hint: str) -> DataFrame:
    """(comp, low) with every ``low`` followed to the end of its chain; ``hint`` is for the join."""
    while True:
        up = low.select(F.col("comp").alias("low"), F.col("low").alias("lower"))
        up = up.hint(*hint) if hint else up
        step = keep(low.join(up, "low", "left").select("comp", F.coalesce("lower", "low").alias("low"), F.col("lower").isNotNull().alias("moved")), "hooks")
        low = step.select("comp", "low")
        if step.filter("moved").isEmpty():
            return low


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(rid, comp): comp is the smallest key reachable from rid; ``nodes`` has (rid, comp) so far.

    Links become links of components; each round every component takes the
    smallest neighbour's label and labels are then followed to their end.
    """
    label = nodes
    while True:
        at = label.select("rid", "comp")
        ends = links.select("x", "y").join(at.select(F.col("rid").alias("x"), F.col("comp").alias("p")), "x")
        ends = ends.join(at.select(F.col("rid").alias("y"), F.col("comp").alias("q")), "y").filter("p <> q")
        low = keep(
            ends.select(F.greatest("p", "q").alias("comp"), F.least("p", "q").alias("low")).groupBy("comp").agg(F.min("low").alias("low")), "hooks"
        )
        if low.isEmpty():
            return label
        label = keep(label.join(followed(low), "comp", "left").select("rid", F.coalesce("low", "comp").alias("comp")), "labels")


def heavier(near: DataFrame, hub: DataFrame, weight: DataFrame) -> DataFrame:
    """(comp, low): hubs that lead to a heavier one over ``near`` (c, rid), and where they end."""
    at = hub.select(F.col("rid").alias("m"), F.col("c").alias("h"))
    ends = near.join(at, F.col("c") == F.col("m"), "left").select("rid", F.coalesce("h", "c").alias("p"))
    ends = ends.join(at, F.col("rid") == F.col("m")).select("p", F.col("h").alias("q")).filter("p <> q").distinct()
    ends = ends.join(weight.select(F.col("rid").alias("p"), F.struct("weight", "rid").alias("w_p")), "p")
    ends = ends.join(weight.select(F.col("rid").alias("q"), F.struct("weight", "rid").alias("w_q")), "q")
    most = F.max(F.greatest("w_p", "w_q")).alias("m")
    return followed(keep(ends.groupBy(F.least("w_p", "w_q").alias("w")).agg(most).select(F.col("w.rid").alias("comp"), F.col("m.rid").alias("low")), "hooks"))


def jaccard_join(docs: DataFrame, k: int = 4, percent: int = 85, every: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (rid, doc_id, n, comp), all links (x, y, shared, n_a, n_b; row keys of
    set representatives), and membership (rid, rep) of rows whose set another row has too.

    Without ``every``, links between sets that others connect may be missing.
    """
    base = with_rid(docs.select("doc_id", "text"))
    rows = keep(base.mapInArrow(size_rows(k), "rid long, doc_id long, n long, a long, b long"), "sizes")
    reps = rows.filter("n > 0").groupBy("a", "b", "n").agg(F.min("rid").alias("rep"), F.count(F.lit(1)).alias("rows"))
    copies = keep(rows.join(reps.filter("rows > 1"), ["a", "b", "n"]).filter("rid <> rep").select("rid", "rep"), "copies")

    texts = base.select("rid", "text")
    turns, met = 1 if every else SIGNATURE_TURNS, []
    for i in range(turns):
        sigs = texts.mapInArrow(signature_rows(k, percent, i, turns), "sig long, rid long")
        # Most signatures stand alone. Counts are narrower than keys, and are stored so that their shuffle goes before the next comes.
        common = keep(sigs.groupBy("sig").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("sig"), "common")
        found = keep(sigs.join(common, "sig").join(copies, "rid", "left_anti").select("sig", "rid"), "groups")
        many = found.groupBy("sig").agg(F.min("rid").alias("low"), F.max("rid").alias("high")).filter("low < high")
        met.append(keep(found.join(many.select("sig"), "sig"), "groups"))
        let_go(common, found)
    groups = reduce(DataFrame.unionByName, met)
    taking = keep(groups.select("rid").distinct(), "taking")
    label = keep(taking.withColumn("comp", F.col("rid")), "labels")
    n = keep(rows.join(taking, "rid", "left_semi").select("rid", "n"), "sizes")

    # Each set against the centre of each of its groups.
    sizes = groups.groupBy("sig").agg(F.count(F.lit(1)).alias("size"))
    weight = keep(groups.join(sizes, "sig").groupBy("rid").agg(F.sum("size").alias("weight")), "weights")
    centre = groups.join(weight, "rid").groupBy("sig").agg(F.max(F.struct("weight", "rid")).alias("c"))
    stars = groups.join(centre.select("sig", F.col("c.rid").alias("c")), "sig").filter("c <> rid").select("c", "rid").distinct()
    stars = stars.join(n, "rid").join(n.select(F.col("rid").alias("c"), F.col("n").alias("n_c")), "c")
    stars = keep(stars.filter(F.least("n", "n_c") * 100 >= F.greatest("n", "n_c") * percent).select("c", "rid", "n"), "stars")
    pair = [F.least("c", "rid").alias("x"), F.greatest("c", "rid").alias("y")]
    tried = keep(stars.select(*pair).distinct(), "tried")
    if not every:
        links = keep(similar(counted_with_sets(tried, texts, k, PAIR_TURNS), percent), "links")
        label = components(label, links)
        held = keep(several(groups.withColumnRenamed("sig", "key").join(label, "rid")), "held")
        let_go(*met, stars)
        if not held.isEmpty():
            alone = shareable(held, texts, shingles, k)
            info = n.join(alone, "rid").join(fine_signatures(alone, texts, shingles, k), "rid").join(least_keys(held, "key"), "rid")
            pairs = across(held, info, percent, ["fine", *LEAST_KEYS], meets_here("key_x") & fine_like(percent))
            pairs = keep(pairs.distinct().join(tried, ["x", "y"], "left_anti"), "pairs")
            more = keep(similar(counted_with_sets(pairs, texts, k), percent), "links")
            links, label = links.unionByName(more), components(label, more)
        let_go(held)
        return classes(rows, label, copies), links, copies
    sets = keep(among(texts, taking).mapInArrow(set_rows(k), SET_KINDS), "sets")
    sums = counted_in_turns(tried, sets)
    # A centre weighs more than its members, so the way from centre to centre ends: at the hub.
    shared = stars.select("*", *pair).join(sums.select("x", "y", "n_a", "n_b", "shared"), ["x", "y"]).filter("shared * 2 >= greatest(n_a, n_b)")
    shared = shared.join(weight.select(F.col("rid").alias("c"), "weight"), "c")
    hub = followed(keep(shared.groupBy(F.col("rid").alias("comp")).agg(F.max(F.struct("weight", "c")).alias("m")).select("comp", F.col("m.c").alias("low")), "hooks"))
    hub = hub.select(F.col("comp").alias("rid"), F.col("low").alias("c"))
    # A hub whose members also lead to a heavier one: both are tried, the heavier goes first.
    wide = keep(heavier(shared.select("c", "rid"), hub, weight), "hooks")
    wide = keep(hub.join(wide, hub.c == wide.comp).select("rid", F.col("low").alias("c")).unionByName(wide.select(F.col("comp").alias("rid"), F.col("low").alias("c"))), "hubs")
    far = keep(hub.unionByName(wide).select(*pair).distinct().join(tried, ["x", "y"], "left_anti"), "far")
    sums = keep(sums.unionByName(counted(far, sets)), "sums")
    tried = sums.select("x", "y")
    links = keep(similar(sums, percent), "links")
    label = components(label, links)

    held = groups
    if not held.isEmpty():
        long = sets.filter("cuts > 1").select("rid").distinct()
        # The hub if half is shared with it, else the centre with most shared; a hub is its own.
        own = hub.select("c").unionByName(wide.select("c")).distinct().join(wide.select(F.col("rid").alias("c")), "c", "left_anti")
        own = own.withColumn("rid", F.col("c")).join(n, "rid").select("rid", "c", F.col("n").alias("shared"), F.lit(2).alias("kind"))
        best = wide.withColumn("kind", F.lit(2)).unionByName(hub.withColumn("kind", F.lit(1))).unionByName(stars.select("rid", "c", F.lit(0).alias("kind"))).select("rid", "c", "kind", *pair)
        best = best.join(sums, ["x", "y"]).filter("kind = 0 OR shared * 2 >= greatest(n_a, n_b)").select("rid", "c", "shared", "kind").unionByName(own)
        best = best.join(long, "rid", "left_anti").join(long.select(F.col("rid").alias("c")), "c", "left_anti")
        best = best.groupBy("rid").agg(F.max(F.struct("kind", F.col("shared").alias("o"), "c")).alias("m"))
        info = label.join(n, "rid").join(best, "rid", "left").select("rid", "n", "comp", F.col("m.c").alias("c"), F.col("m.o").alias("o"))
        pairs = keep(within(held, keep(info, "info"), sets, percent).join(tried, ["x", "y"], "left_anti"), "pairs")
        more = keep(similar(counted_in_turns(pairs, sets), percent), "links")
        links = links.select("x", "y", "shared", "n_a", "n_b").unionByName(more)
        label = components(label, more)
    let_go(sets, *met)
    return classes(rows, label, copies), links, copies


def classes(rows: DataFrame, label: DataFrame, copies: DataFrame) -> DataFrame:
    """(rid, doc_id, n, comp) of all rows, those with equal sets and those that met no other included."""
    comp = label.unionByName(copies.join(label, copies.rep == label.rid, "left").select(copies.rid, F.coalesce("comp", "rep").alias("comp")))
    out = rows.select("rid", "doc_id", "n").join(comp, "rid", "left").withColumn("comp", F.coalesce("comp", "rid"))
    return keep(out, "classes")


def degrees(links: DataFrame, copies: DataFrame) -> DataFrame:
    """(rid, n_links): how many other rows each row with a link is similar to, rows with its own set among them."""
    # Rows of a set beside its representative; most sets have none.
    others = keep(copies.groupBy("rep").agg(F.count(F.lit(1)).alias("others")), "others")
    ends = links.select(F.col("x").alias("rep"), F.col("y").alias("to")).unionByName(links.select(F.col("y").alias("rep"), F.col("x").alias("to")))
    # Only links to sets with other rows meet them: one row for each link, and what stands beside its end.
    beside = ends.join(others.withColumnRenamed("rep", "to"), "to").select("rep", F.col("others").alias("rows"))
    own = others.select("rep", F.col("others").alias("rows"))
    of = ends.select("rep", F.lit(1).cast("long").alias("rows")).unionByName(beside).unionByName(own)
    of = keep(of.groupBy("rep").agg(F.sum("rows").alias("n_links")), "degrees")
    more = copies.join(of, "rep").select("rid", "n_links")
    return of.select(F.col("rep").alias("rid"), "n_links").unionByName(more)


def near_duplicates(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links), n_links (to other rows), rid."""
    rows, links, copies = jaccard_join(docs, k, percent)
    ids = rows.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    n_links = F.coalesce("n_links", F.lit(0)).alias("n_links")
    out = rows.join(ids, "comp").join(degrees(links, copies), "rid", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", n_links, "rid")


def one_of_each(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """The documents' own columns; of every component the row with the smallest doc_id stays."""
    rows, _, _ = jaccard_join(docs, k, percent, every=False)
    # A component's rows meet in a partial aggregation, they are never gathered.
    stays = F.min(F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), "rid")).alias("stays")
    best = rows.groupBy("comp").agg(stays, F.count(F.lit(1)).alias("c")).filter("c > 1").select("comp", F.col("stays.rid").alias("stays"))
    going = keep(rows.join(best, "comp").filter("rid <> stays").select("rid"), "going")
    base = with_rid(docs.select(F.struct("*").alias("row")))
    return base.join(sized(going), "rid", "left_anti").select("row.*")
