"""Spelling variant grouping by asymmetric q-chunks.

Words near each other differ by one inserted, deleted or replaced code point.
Of a pair the shorter word (of equal lengths the smaller) contributes two
disjoint chunks, its first and last q = length // 2 code points; the other word
contributes its positional q-grams. One edit leaves one of the chunks whole: the
first at its place, or the last, one place further if the other word is longer.
So of the other word's grams within a shift of one only two can meet a chunk for
each of the two lengths, and the others are not sent. Many words share a chunk,
so what it leaves of the two words, again one edit apart, meets in the same way:
a key is a chunk and a chunk of the rest. What meets is verified by edit
distance.

Joins are sort-merge joins by hint: Spark sizes a table by its compressed files,
and what an explode makes of it hardly higher, so at some sizes it would send
the exploded words through the driver.

Words are counted per task first, in dictionaries of bounded size; the count of
a word is a partial aggregation. A word's form is its near word of largest
count if that has twice the word's count; counts at least double along a chain
of forms, so following it ends.

Defined results: a null text has no words; a null doc_id stands as the empty
string in the hashed text; repeated rows count again; ties of counts go to the
smallest word by code points; an empty table gives no rows; columns other than
doc_id and text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import keep
from panelwright.llm.jaccard import followed

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Of so many (document, run) pairs one loses a code point.
ONE_IN = 97
#: Shortest word and least count of a word that takes part.
LENGTH, COUNT = 5, 3
#: Distinct words that a task holds before it hands its counts on.
HELD = 500_000
#: Bytes of one text from which its runs are counted one by one.
LONG = 1 << 20


def runs(text: str) -> Iterable[str]:
    """Runs of letters with A to Z alone lower-cased (bytes.lower leaves all but ASCII as it is)."""
    text = text.encode().lower().decode()
    return RUN.findall(text) if len(text) < LONG else (m.group() for m in RUN.finditer(text))


def words_of(doc_id: int | None, text: str) -> Iterator[tuple[str, int]]:
    """(word, count) of a document, some of its runs without a code point."""
    crc = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(runs(text)).items():
        h = zlib.crc32(run.encode(), crc)
        if h % ONE_IN == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= LENGTH:
            yield run, n


def count_rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
        total.clear()
        return batch

    for part in parts:
        for doc_id, text in zip(part.column("doc_id"), part.column("text")):
            if text.is_valid:
                for word, n in words_of(doc_id.as_py(), text.as_py()):
                    total[word] += n
            if len(total) >= HELD:
                yield out()
    yield out()


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of all words long and frequent enough."""
    parts = docs.select("doc_id", "text").mapInArrow(count_rows, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= COUNT)


def halves(word: Column, size: Column, length: Column) -> list[tuple[Column, Column, Column]]:
    """(chunk, rest, size of the rest) for both chunks of a word of ``length`` as a word of ``size`` has them.

    The last chunk is taken from the end: it starts one place further in a word longer by one.
    """
    q = F.floor(length / 2).cast("int")
    rest = size - q
    return [(F.substring(word, F.lit(1), q), F.substring(word, q + 1, rest), rest), (F.substring(word, rest + 1, q), F.substring(word, F.lit(1), rest), rest)]


def keys(length: Column) -> Column:
    """Keys of a word (``word``, ``size``) for partners whose chunks are those of ``length``."""
    q = F.floor(length / 2).cast("int")
    out = []
    for chunk, rest, left in halves(F.col("word"), F.col("size"), length):
        for again, _, _ in halves(rest, left, length - q):
            out.append(F.xxhash64(length, F.lit(len(out)), chunk, again))
    return F.array(*out)


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): all pairs of words one edit apart, each once."""
    words = words.select("word", "n", F.char_length("word").alias("size"))
    size = F.col("size")
    chunks = words.select("word", "n", "size", F.explode(keys(size)).alias("key"))
    shorter = F.when(size > LENGTH, keys(size - 1)).otherwise(F.array().cast("array<bigint>"))
    grams = words.select(F.col("word").alias("other"), F.col("n").alias("n_b"), F.col("size").alias("size_b"), F.explode(F.concat(keys(size), shorter)).alias("gram"))
    # A key holds the length of the word with the chunks, so the other is as long or one longer.
    apart = (size < F.col("size_b")) | (F.col("word") < F.col("other"))
    met = chunks.hint("merge").join(grams, (F.col("key") == F.col("gram")) & apart & F.col("size_b").between(size, size + 1))
    # With the threshold, distances over one come back as -1.
    return met.filter(F.levenshtein("word", "other", 1) == 1).select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("other").alias("b"), "n_b").distinct()


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    words = keep(vocabulary(docs), "spelling-words")
    pairs = keep(near_pairs(words), "spelling-pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("best"))
    near = words.join(best.hint("merge"), "word", "left").withColumn("form_n", -F.col("best.less"))
    enough = F.col("form_n") >= 2 * F.col("n")
    near = near.select("word", F.when(enough, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("form_n")).alias("form_n"))
    near = keep(near, "spelling-forms")
    roots = followed(near.filter("form IS NOT NULL").select(F.col("word").alias("comp"), F.col("form").alias("low")), "merge")
    near = near.join(roots.select(F.col("comp").alias("word"), F.col("low").alias("root")).hint("merge"), "word", "left")
    return near.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
