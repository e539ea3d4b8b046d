"""Secret scans with built-in functions alone.

Three patterns give the base spans. The entropy pass adds to them: candidate
strings are cut into characters, and the Shannon entropy of a sliding window is
kept up to date by what enters and what leaves it. With f(c) = c log2 c the
window's sum of f over its character counts changes by f(b+1) - f(b) for a new
character that the window already holds b times, and by f(a) - f(a+1) for a
leaving one of which a stay; a and b are counts over a range of positions, and
running sums of these changes give every window's entropy. A window is classed
by its own characters, and each class has its own threshold. The allow-list
covers the spans it matches; a window that lies in them by half is left out.

Defined results: null texts are empty; repeated rows are reported each; texts
of any length are scanned whole, long strings in pieces that overlap by a
window; an empty table gives no rows; columns other than doc_id and text are not
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.common import keep, with_rid

# The patterns of the three base kinds and their least lengths.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "entropy")

#: A string that may hold a secret: unbroken, of WINDOW characters or more; possessive, so no character is tried twice.
WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}+"
#: Characters of a string that are scanned together.
PIECE = 4096
#: Class of a window by what it is made of alone, and the bits per character from which it counts.
CLASSES = (
    ("digits", "[0-9]", 2.6), ("hex", "[0-9a-f]", 3.0), ("HEX", "[0-9A-F]", 3.0), ("Hex", "[0-9A-Fa-f]", 3.3), ("letters", "[A-Za-z]", 3.8),
)
OTHERS = 3.6
_WORD = r"(?:(?:[A-Z]?+[a-z]{2,16}+)++|[A-Z]{1,16}+|[a-z])"
#: Spans that only look random: UUIDs, paths, dates, alphabets and placeholders, words.
ALLOW = (
    r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}(?![0-9A-Fa-f])",
    rf"(?<![A-Za-z0-9])(?:(?:{_WORD}[0-9]{{0,4}}+|[0-9]{{1,8}}+)(?:[-_](?:{_WORD}[0-9]{{0,4}}+|[0-9]{{1,8}}+))*+/){{2,}}+(?:{_WORD}[0-9]{{0,4}}+(?![A-Za-z0-9]))?",
    r"(?<![A-Za-z0-9])[A-Za-z]*+[-_=]*+(?<![0-9])\d{4}-\d\d-\d\d(?![0-9])",
    r"(?i:abcdefgh|0123456789|12345678|qwerty|example|placeholder|changeme|x{6}|0{8})",
    rf"(?<![A-Za-z0-9]){_WORD}(?:[-_=]{_WORD})++[-_=]?+\d{{0,4}}+(?![A-Za-z0-9])",
)


def matches(text: Column, pattern: str, kind: str, group: int = 0) -> Column:
    """array<kind, at, gap, size, inner, string>: matches with the gap since the one before."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    zipped = F.arrays_zip(whole.alias("m"), inner.alias("g"), F.split(text, pattern).alias("p"))
    rows = F.transform(
        F.filter(zipped, lambda x: x.m.isNotNull()),
        lambda x, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("at"), F.length(x.p).alias("gap"), F.length(x.m).alias("size"),
            F.length(x.g).alias("inner"), F.when(F.lit(kind == "entropy"), x.m).alias("string"),
        ),
    )
    kinds = "array<struct<kind:string,at:int,gap:int,size:int,inner:int,string:string>>"
    return F.when(F.regexp_like(text, F.lit(pattern)), rows.cast(kinds)).otherwise(F.array().cast(kinds))


def masked(string: Column | str) -> Column:
    """The string with a blank for every character of an allowed span."""
    allowed = "|".join(ALLOW)
    parts = F.arrays_zip(F.split(string, allowed).alias("p"), F.regexp_extract_all(string, F.lit(allowed), F.lit(0)).alias("m"))
    blank = F.transform(parts, lambda x: F.concat(x.p, F.repeat(F.lit(" "), F.coalesce(F.length(x.m), F.lit(0)))))
    return F.when(F.regexp_like(string, F.lit(allowed)), F.array_join(blank, "")).otherwise(F.col(string) if isinstance(string, str) else string)


def pieces(strings: DataFrame) -> DataFrame:
    """(id, start, at, string, open): strings cut into pieces that share WINDOW - 1 characters with the next one."""
    cut = lambda c: F.regexp_extract_all(c, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    held = strings.select("id", "start", cut("string").alias("a"), cut(masked("string")).alias("b"))
    longer = lambda c: F.transform(c, lambda x, i: F.concat(x, F.substring(F.coalesce(F.get(c, i + 1), F.lit("")), 1, WINDOW - 1)))
    both = F.arrays_zip(longer(F.col("a")).alias("string"), longer(F.col("b")).alias("open"))
    held = held.select("id", "start", F.posexplode(both).alias("at", "x")).select("id", "start", (F.col("at") * PIECE).alias("at"), "x.*")
    return held.filter(F.length("string") >= WINDOW)


def entropy_spans(strings: DataFrame) -> DataFrame:
    """(id, start, end) of the stretches of ``strings`` (id, string, start) whose windows reach their class threshold."""
    signs = F.arrays_zip(F.split("string", "").alias("ch"), F.split("open", "").alias("open"))
    chars = pieces(strings).select("id", "start", "at", F.posexplode(signs).alias("p", "sign")).select("id", "start", "at", "p", "sign.*").filter("ch <> ''")
    same = Window.partitionBy("id", "at", "ch").orderBy("p")
    chars = chars.withColumn("b", F.count(F.lit(1)).over(same.rangeBetween(-(WINDOW - 1), -1))).withColumn(
        "a", F.count(F.lit(1)).over(same.rangeBetween(1, WINDOW - 1))
    )
    f = lambda c: F.when(c > 0, c * F.log2(c)).otherwise(0.0)
    enters, leaves = f(F.col("b") + 1) - f(F.col("b")), f(F.col("a") + 1) - f(F.col("a"))
    order = Window.partitionBy("id", "at").orderBy("p")
    out = F.lag(leaves, WINDOW).over(order)
    chars = chars.withColumn("change", enters - F.coalesce(out, F.lit(0.0)))
    total = F.sum("change").over(order.rowsBetween(Window.unboundedPreceding, 0))
    # Entropy of the window that ends at p, rounded so that sums in any order agree.
    chars = chars.withColumn("h", F.round(F.log2(F.lit(float(WINDOW))) - total / WINDOW, 6))
    window = order.rowsBetween(-(WINDOW - 1), 0)
    bits = F.lit(OTHERS)
    for _, pattern, least in reversed(CLASSES):
        bits = F.when(F.min(F.regexp_like("ch", F.lit(f"^{pattern}$"))).over(window), F.lit(least)).otherwise(bits)
    spared = F.sum((F.col("open") == " ").cast("int")).over(window)
    chars = chars.withColumn("bits", bits).withColumn("spared", spared)
    hot = chars.filter((F.col("p") >= WINDOW - 1) & (F.col("h") >= F.col("bits")) & (F.col("spared") * 2 < WINDOW))
    fresh = F.col("p") - F.coalesce(F.lag("p").over(order), F.lit(-WINDOW - 1)) > WINDOW
    hot = hot.withColumn("stretch", F.sum(fresh.cast("int")).over(order))
    each = hot.groupBy("id", "at", "stretch").agg(
        (F.first("start") + F.col("at") + F.min("p") - WINDOW + 1).alias("start"), (F.first("start") + F.col("at") + F.max("p") + 1).alias("end")
    )
    # Stretches of neighbouring pieces are one if their windows are as near as those within a piece.
    line = Window.partitionBy("id").orderBy("start")
    gap = F.col("start") + WINDOW - F.lag("end").over(line) > WINDOW
    each = each.withColumn("whole", F.sum(F.coalesce(gap, F.lit(True)).cast("int")).over(line))
    return each.groupBy("id", "whole").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def secret_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (rid, doc_id), and spans (rid, kind, start, end) in code points, end exclusive."""
    text = F.coalesce("text", F.lit(""))
    found = F.concat(
        matches(text, ASSIGN, "assign", 1), matches(text, ACCESS, "access"), matches(text, HEX, "hex"), matches(text, CANDIDATE, "entropy")
    )
    rows = with_rid(docs.select("doc_id", "text")).select("rid", "doc_id", found.alias("found"))
    rows = keep(rows, "matches")
    each = rows.select("rid", F.explode("found").alias("x")).select("rid", "x.*")
    before = Window.partitionBy("rid", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("size")).over(before)
    placed = each.withColumn("end", end).withColumn("start", F.col("end") - F.col("size"))
    base = placed.filter((F.col("kind") == "hex") | (F.col("kind") == "access") | ((F.col("kind") == "assign") & (F.col("inner") >= ASSIGN_LEAST)))
    base = base.select("rid", "kind", "start", "end")
    strings = placed.filter(F.col("kind") == "entropy").select(F.struct("rid", "start").alias("id"), "string", "start")
    more = entropy_spans(strings).select(F.col("id.rid").alias("rid"), F.lit("entropy").alias("kind"), "start", "end")
    return rows.select("rid", "doc_id"), base.unionByName(more)


def scan(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy.

    An entropy span inside a base span is not repeated.
    """
    rows, spans = secret_spans(docs)
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    reach = F.max(F.when(F.col("kind") != "entropy", F.col("end"))).over(
        Window.partitionBy("rid").orderBy("start", rank, "end").rowsBetween(Window.unboundedPreceding, 0)
    )
    spans = spans.withColumn("rank", rank).withColumn("reach", reach).filter("kind <> 'entropy' OR reach IS NULL OR reach < end")
    told = F.concat_ws(":", "kind", "start", "end")
    listed = spans.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "rank", "end", "kind", told.alias("told")))).alias("s"))
    out = rows.join(listed, "rid", "left")
    s = F.coalesce("s", F.array().cast("array<struct<start:bigint,rank:bigint,end:bigint,kind:string,told:string>>"))
    n = lambda k: F.size(F.filter("s", lambda x: x.kind == k)).cast("long").alias(f"n_{k}")
    join = lambda a: F.array_join(F.transform(a, lambda x: x.told), ",")
    return out.withColumn("s", s).select(
        "doc_id", n("assign"), n("access"), n("hex"),
        F.sha2(join(F.filter("s", lambda x: x.kind != "entropy")), 256).alias("base_sha256"), join("s").alias("spans"), n("entropy"),
    )
