"""Sharding by balanced label propagation.

Linked documents start in hashed shards. In each round every group of links
sums its members' shards, every member sums its groups and proposes the shard
most of its neighbours are in. A quota per pair of shards admits proposals by
gain: an even swap, and a share of what is free in the target, allotted by
largest remainder. What is refused proposes the best shard with room in the
next round. When nothing moves, groups that lie whole in a shard others want,
or in one that holds too much, move out whole to the shard with most room.
Documents without links fill what is left, so shard sizes differ by one row at
most.

Defined results: a null text has size 1 and no links; equal texts (the empty
one included) are linked; repeated rows are rows of their own; votes that tie
go by a hash of the group, so that its members agree; a group larger than a
shard fills one and goes on in others; an empty table gives no rows. Where a
carried column has the name of a result column, the result stands.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.common import keep, numbered_in, with_rid

#: Proposals of equal gain are admitted in so many hashed parts.
PARTS = 64


def equal_text_links(rows: DataFrame, text_key: str = "text_key") -> DataFrame:
    """(rid, link): rows that share a text; a group is one link, not its pairs."""
    many = rows.filter(F.col(text_key).isNotNull()).groupBy(text_key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return rows.select("rid", text_key).join(many.select(text_key), text_key).select("rid", F.col(text_key).alias("link"))


def whole_groups(links: DataFrame) -> DataFrame:
    """(link, n): groups whose members have no other link, so that moving one whole cuts nothing."""
    of = links.groupBy("rid").agg(F.count(F.lit(1)).alias("links"))
    return links.join(of, "rid").groupBy("link").agg(F.count(F.lit(1)).alias("n"), F.max("links").alias("links")).filter("links = 1").select("link", "n")


def propagate(links: DataFrame, room: list[int], patience: int = 6) -> DataFrame:
    """(rid, shard) of the linked rows.

    ``links`` holds a row for each document and link (a pair is a link of two);
    ``room`` is what each shard may hold. Rounds end when nothing can move, or
    when ``patience`` rounds have not brought more linked rows together.
    """
    k = len(room)
    first = F.pmod(F.xxhash64("rid"), F.lit(k)).cast("int")
    labels = best = keep(links.select("rid").distinct().withColumn("shard", first), "labels")
    movable, most, since, still, turn = keep(whole_groups(links), "movable"), -1, 0, 0, 0
    while still < 2 and since <= patience:
        load = {r["shard"]: r["n"] for r in labels.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
        free = [room[s] - load.get(s, 0) for s in range(k)]
        at = [F.sum(F.when(F.col("shard") == s, 1).otherwise(0)).alias(f"c{s}") for s in range(k)]
        groups = keep(links.join(labels, "rid").groupBy("link").agg(*at), "groups")
        # Pairs of linked rows in one shard, and rows within their shard's room.
        together = groups.agg(F.sum(sum(F.col(f"c{s}") * F.col(f"c{s}") for s in range(k)))).first()[0] or 0
        together, over = float(together), sum(min(0, f) for f in free)
        most, best, since = ((over, together), labels, 0) if most == -1 or (over, together) > most else (most, best, since + 1)
        # Every other round asks only for shards with room.
        asked = [turn % 2 == 0 or f > 0 for f in free]
        moves = keep(proposals(links, labels, groups, asked, turn), "moves")
        flow = {(r["shard"], r["to"]): r["n"] for r in moves.groupBy("shard", "to").agg(F.count(F.lit(1)).alias("n")).collect()}
        allowed = quotas(flow, free)
        moved = keep(admitted(moves, allowed), "moved") if any(allowed.values()) else None
        if not any(allowed.values()) and turn % 2 == 0:
            wanted = [sum(n for (_, t), n in flow.items() if t == s) + max(0, -free[s]) for s in range(k)]
            moved = move_out(labels, links, groups.join(movable, "link"), wanted, free)
        turn += 1
        if moved is None:
            still += 1
            continue
        still = 0
        labels = keep(labels.join(moved, "rid", "left").select("rid", F.coalesce("_to", "shard").alias("shard")), "labels")
    return labels if since == 0 else best


def proposals(links: DataFrame, labels: DataFrame, groups: DataFrame, asked: list[bool], turn: int) -> DataFrame:
    """(rid, shard, to, gain, part) of the rows whose neighbours are mostly in another shard that is asked for."""
    k = len(asked)
    votes = (
        links.join(groups, "link")
        .groupBy("rid")
        .agg(F.min(F.xxhash64("link")).alias("_tie"), *[F.sum(f"c{s}").alias(f"c{s}") for s in range(k)])
    )
    votes = votes.join(labels, "rid")
    # Equal votes go by a hash of the group, so that all of its members agree.
    open_ = lambda s: F.lit(asked[s]) | (F.col("shard") == s)
    ranked = F.array(
        *[F.struct(F.when(open_(s), F.col(f"c{s}")).otherwise(-1).alias("n"), F.pmod(F.col("_tie") + s, F.lit(k)).alias("t"), F.lit(s).alias("s")) for s in range(k)]
    )
    counts = F.array(*[F.col(f"c{s}") for s in range(k)])
    gain = F.floor(F.log2(F.col("_best.n") - F.element_at(counts, F.col("shard") + 1) + 1)).cast("int")
    part = F.pmod(F.xxhash64("rid", F.lit(turn)), F.lit(PARTS)).cast("int")
    out = votes.withColumn("_best", F.array_max(ranked)).filter("shard <> _best.s")
    return out.select("rid", "shard", F.col("_best.s").alias("to"), gain.alias("gain"), part.alias("part"))


def admitted(moves: DataFrame, allowed: dict[tuple[int, int], int]) -> DataFrame:
    """(rid, _to): of each flow as many rows as its quota says, by gain; the part that crosses the quota by hash of the row."""
    quota = reduce(lambda c, x: c.when((F.col("shard") == x[0][0]) & (F.col("to") == x[0][1]), x[1]), allowed.items(), F.when(F.lit(False), 0))
    order = Window.partitionBy("shard", "to").orderBy(F.desc("gain"), "part")
    # At most shards x shards x 64 gains x PARTS rows, whatever the input.
    parts = moves.groupBy("shard", "to", "gain", "part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.sum("_n").over(order) - F.col("_n"))
    parts = parts.withColumn("_take", F.least("_n", F.coalesce(quota, F.lit(0)) - F.col("_before"))).filter("_take > 0")
    some = moves.join(F.broadcast(keep(parts, "parts")), ["shard", "to", "gain", "part"])
    place = F.row_number().over(Window.partitionBy("shard", "to", "gain", "part").orderBy(F.xxhash64("rid"), "rid"))
    cut = some.filter("_take < _n").withColumn("_place", place).filter("_place <= _take")
    return some.filter("_take = _n").select("rid", F.col("to").alias("_to")).unionByName(cut.select("rid", F.col("to").alias("_to")))


def move_out(labels: DataFrame, links: DataFrame, groups: DataFrame, wanted: list[int], free: list[int]) -> DataFrame | None:
    """(rid, _to): whole groups that leave the shard most wanted beyond its room for the one with most room, small ones first."""
    k = len(free)
    full = [s for s in range(k) if wanted[s] > max(0, free[s])]
    if not full:
        return None
    source = max(full, key=lambda s: wanted[s] - max(0, free[s]))
    target = max((s for s in range(k) if s != source), key=lambda s: free[s])
    needed = wanted[source] - max(0, free[source])
    if free[target] <= 0:
        return None
    size = F.floor(F.log2("n")).cast("int")
    part = F.pmod(F.xxhash64("link"), F.lit(PARTS)).cast("int")
    units = keep(groups.filter(F.col(f"c{source}") == F.col("n")).select("link", "n", size.alias("size"), part.alias("part")), "units")
    order = Window.orderBy("size", "part")
    # At most 64 sizes x PARTS rows.
    parts = units.groupBy("size", "part").agg(F.sum("n").alias("_n")).withColumn("_before", F.sum("_n").over(order) - F.col("_n"))
    some = units.join(F.broadcast(parts.filter(F.col("_before") < min(needed, free[target]))), ["size", "part"])
    within = F.sum("n").over(Window.partitionBy("size", "part").orderBy("n", "link"))
    # Until enough places are free; the last group may free more of them.
    some = some.withColumn("_sum", F.col("_before") + within)
    going = some.filter((F.col("_sum") - F.col("n") < needed) & (F.col("_sum") <= free[target])).select("link")
    going = keep(links.join(going, "link").select("rid", F.lit(target).alias("_to")), "going")
    return None if going.isEmpty() else going


def quotas(flow: dict[tuple[int, int], int], free: list[int]) -> dict[tuple[int, int], int]:
    """What may move from shard to shard: even swaps, shares of what is free in the target, and rings.

    Free places are shared by largest remainder; rows that want to move in a ring
    of shards move together, which fills no shard further.
    """
    out = {(a, b): min(n, flow.get((b, a), 0)) for (a, b), n in flow.items()}
    for b in {b for _, b in flow}:
        rest = {a: n - out[a, b] for (a, t), n in flow.items() if t == b}
        wanted = sum(rest.values())
        share = min(max(0, free[b]), wanted)
        if not share:
            continue
        given = {a: share * n // wanted for a, n in rest.items()}
        by_remainder = sorted(rest, key=lambda a: (-(share * rest[a] % wanted), a))
        for a in by_remainder[: share - sum(given.values())]:
            given[a] += 1
        for a, n in given.items():
            out[a, b] += n
    while path := ring({ab: n - out[ab] for ab, n in flow.items() if n > out[ab]}):
        least = min(flow[ab] - out[ab] for ab in path)
        for ab in path:
            out[ab] += least
    return out


def ring(edges: dict[tuple[int, int], int]) -> list[tuple[int, int]]:
    """The edges of a ring, or none."""
    follows: dict[int, list[int]] = {}
    for a, b in sorted(edges):
        follows.setdefault(a, []).append(b)
    done: set[int] = set()
    for first in sorted(follows):
        path, todo = [first], [iter(follows[first])]
        while todo:
            after = next(todo[-1], None)
            if after is None:
                done.add(path.pop())
                todo.pop()
            elif after in path:
                round_ = [*path[path.index(after) :], after]
                return list(zip(round_, round_[1:]))
            elif after not in done:
                path.append(after)
                todo.append(iter(follows.get(after, [])))
    return []


def shard_rows(rows: DataFrame, links: DataFrame, n_shards: int = 8) -> DataFrame:
    """``rows`` (stored, with ``rid``) with shard and slot; shard sizes differ by one row at most."""
    total = rows.count()
    room = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    labels = propagate(links, room)
    placed = numbered_in(labels, "shard", "slot")
    within = reduce(lambda c, s: c.when((F.col("shard") == s) & (F.col("slot") < room[s]), True), range(n_shards), F.when(F.lit(False), True))
    placed = keep(placed.filter(within), "placed")
    held = {r["shard"]: r["n"] for r in placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    loose = rows.select("rid").join(placed.select("rid"), "rid", "left_anti").withColumn("_all", F.lit(0))
    loose = numbered_in(loose, "_all", "_at")
    shard, slot, start = F.when(F.lit(False), 0), F.when(F.lit(False), F.lit(0).cast("long")), 0
    for s in range(n_shards):
        end = start + room[s] - held.get(s, 0)
        inside = (F.col("_at") >= start) & (F.col("_at") < end)
        shard = shard.when(inside, s)
        slot = slot.when(inside, F.col("_at") - start + held.get(s, 0))
        start = end
    filled = loose.select("rid", shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))
    everyone = placed.select("rid", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot")).unionByName(filled)
    return rows.join(everyone, "rid")


def shard_documents(docs: DataFrame, n_shards: int = 8, carry: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; with ``carry`` the text and other columns too."""
    text = F.coalesce("text", F.lit(""))
    facts = [
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
        F.unhex(F.sha2("text", 256)).alias("text_key"),
    ]
    # Narrow rows are stored and assigned; the documents themselves are read again and join once.
    rows = keep(with_rid(docs.select("doc_id", *facts)), "rows")
    links = keep(equal_text_links(rows.select("rid", "text_key")), "links")
    out = shard_rows(rows.drop("text_key"), links, n_shards).withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int"))
    lead = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    if not carry:
        return out.select(*lead)
    more = [c for c in docs.columns if c not in lead]
    whole = with_rid(docs.select(F.struct(*[F.col(f"`{c}`") for c in more]).alias("_row")))
    return whole.join(out, "rid").select(*lead, *[F.col("_row").getField(c).alias(c) for c in more])
