"""Toxicity: a weighted lexicon matched by Aho-Corasick.

Texts are folded first: lower case, letters of other scripts that look Latin,
digits and signs that stand for letters inside words, white space and
punctuation to single spaces. The lexicon holds whole words and word beginnings
with the log odds that labelled toxic texts have over others; one automaton
finds all of them in one pass. Exception phrases suppress the entries inside
them. A text's evidence, as it is and over the logarithm of its length, goes
through a logistic curve.

Lexicon and curve are learned from at most ``max_rows`` labelled rows (by hash
of doc_id); everything else covers all rows. Counts are summed per partition
before they are shuffled; what reaches the driver is bounded by that sample.

Defined results: null and empty texts get the score of a text without matches;
rows with a null label or doc_id teach nothing, several labels of a document
count as toxic if one is; without labels of both kinds every score is 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters that look like Latin ones.
_ALIKE = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "ғ": "f", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k",
    "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w",
    "х": "x", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u",
    "χ": "x", "ω": "w", "ı": "i", "ɡ": "g", "ⅼ": "l", "ⅰ": "i", "​": "", "‌": "", "‍": "", "­": "", "﻿": "",
}
_FOLD = {ord(k): v for k, v in _ALIKE.items()} | {0xFF01 + i: chr(0x21 + i) for i in range(94)}
_FOLD |= {0xFF21 + i: chr(0x61 + i) for i in range(26)}
_DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
_INSIDE = re.compile(r"(?<=[^\W\d_])[0134578@$!]+(?=[^\W\d_])|\b[0134578@$]+(?=[^\W\d_]{2})|(?<=[^\W\d_]{2})[0134578]+\b")
_GAPS = re.compile(r"[\W_]+")
PREFIXES = range(3, 9)
MAX_ROWS = 20_000


def fold(text: str | None) -> str:
    """The folded text, words between single spaces, a space at both ends."""
    text = (text or "").lower()
    if not text.isascii():
        text = text.translate(_FOLD)
    text = _INSIDE.sub(lambda m: "".join(_DIGITS[c] for c in m[0]), text)
    return f" {_GAPS.sub(' ', text).strip()} "


def entries(words: set[str]) -> set[str]:
    """The lexicon entries a document's words support: ' word ' and ' beginning'."""
    out = {f" {w} " for w in words}
    for n in PREFIXES:
        out |= {f" {w[:n]}" for w in words if len(w) > n}
    return out


@dataclass(frozen=True)
class Lexicon:
    weights: dict[str, float]
    exceptions: Sequence[str] = ()
    curve: tuple[float, ...] = field(default=(-40.0, 0.0, 0.0, 0.0))

    def automaton(self) -> ahocorasick.Automaton | None:
        a = ahocorasick.Automaton()
        for key, w in self.weights.items():
            a.add_word(key, (key, w))
        for phrase in self.exceptions:
            a.add_word(fold(phrase), (fold(phrase), None))
        if not len(a):
            return None
        a.make_automaton()
        return a

    def facts(self, text: str | None, automaton) -> tuple[float, float, float]:
        """Evidence, evidence over log length, log length."""
        text = fold(text)
        size = math.log2(2 + text.count(" "))
        if automaton is None:
            return 0.0, 0.0, size
        hits, spared = [], []
        for end, (key, w) in automaton.iter(text):
            (spared if w is None else hits).append((end - len(key) + 1, end, w, key))
        if spared:
            hits = [h for h in hits if not any(s[0] <= h[0] and h[1] <= s[1] for s in spared)]
        counts = Counter((h[3], h[2]) for h in hits)
        total = sum(w * (1 + math.log2(n)) for (_, w), n in counts.items())
        return total, total / size, size

    def score(self, facts: np.ndarray) -> np.ndarray:
        z = np.clip(self.curve[0] + facts @ np.array(self.curve[1:]), -40, 40)
        return np.round(1 / (1 + np.exp(-z)), 9)


def labelled(docs: DataFrame, labels: DataFrame, held_out: Column | None, max_rows: int) -> DataFrame:
    """(doc_id, text, toxic) of a bounded sample of the labelled rows that may teach."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if held_out is not None:
        known = known.filter(~held_out)
    known = known.withColumn("place", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)))
    n = known.count()
    if n > max_rows:
        known = known.filter(F.col("place") < int((1 << 30) * (max_rows / n)))
    # About max_rows ids and labels: small enough to send to every task.
    rows = docs.select("doc_id", "text").join(F.broadcast(known.select("doc_id", "toxic")), "doc_id")
    # An id may repeat on many rows: equal rows teach once, and different ones are sampled in turn.
    rows = rows.withColumn("digest", F.md5(F.coalesce("text", F.lit("")))).dropDuplicates(["doc_id", "digest"])
    n = rows.count()
    if n > 2 * max_rows:
        place = F.pmod(F.xxhash64("doc_id", "digest"), F.lit(1 << 30))
        rows = rows.filter(place < int((1 << 30) * (max_rows / n)))
    return rows.drop("digest")


def _counts(wanted: frozenset[str] | None):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        n = 0
        for part in parts:
            for text in part.column("text"):
                got = entries(set(fold(text.as_py()).split()))
                seen.update(got if wanted is None else got & wanted)
                n += 1
        seen[""] = n
        yield pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.string()), pa.array(list(seen.values()), pa.int64())], ["entry", "n"])

    return run


def _tally(texts: DataFrame, wanted: frozenset[str] | None, least: int) -> dict[str, int]:
    out = texts.select("text").mapInArrow(_counts(wanted), "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n"))
    return {r["entry"]: r["n"] for r in out.filter((F.col("n") >= least) | (F.col("entry") == "")).collect()}


def learn(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, max_rows: int = MAX_ROWS, exceptions: Sequence[str] = ()) -> Lexicon:
    """Lexicon, exception phrases and curve from labelled rows for which ``held_out`` is false."""
    sample = labelled(docs, labels, held_out, max_rows)
    toxic = _tally(sample.filter("toxic = 1"), None, 4)
    clean = _tally(sample.filter("toxic <> 1"), frozenset(toxic) - {""}, 1)
    p_all, n_all = toxic.pop("", 0), clean.pop("", 0)
    if not p_all or not n_all:
        return Lexicon({}, exceptions)
    rated = []
    for key, p in toxic.items():
        n = clean.get(key, 0)
        odds = math.log((p + 0.5) / (p_all + 1)) - math.log((n + 0.5) / (n_all + 1))
        expected = (p + n) * p_all / (p_all + n_all)
        # Twice the log likelihood ratio: how surely the entry goes with the label.
        sure = 2 * (p * math.log(p / expected) + (n * math.log(n / ((p + n) - expected)) if n else 0))
        if odds >= 1.5 and sure >= 24:
            rated.append((sure, odds, key))
    weights: dict[str, float] = {}
    for _, odds, key in sorted(rated, reverse=True):
        word = key.strip()
        if not any(word.startswith(k.strip()) and (not k.endswith(" ")) or k.startswith(key) for k in weights):
            weights[key] = round(odds, 6)
    # Words that a beginning would catch though clean texts use them.
    spared = [
        k.strip() for k, p in toxic.items()
        if k.endswith(" ") and clean.get(k, 0) >= 3 and clean[k] / n_all >= 0.5 * p / p_all and any(k.startswith(w) for w in weights if not w.endswith(" "))
    ]
    lexicon = Lexicon(weights, [*exceptions, *spared])
    facts = sample.select("toxic", facts_of(lexicon)("text").alias("f")).collect()
    x = np.array([list(r["f"]) for r in facts])
    return Lexicon(weights, lexicon.exceptions, _fit(x, np.array([float(r["toxic"] == 1) for r in facts])))


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    """Logistic regression by Newton steps."""
    a = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(a.shape[1])
    penalty = ridge * np.eye(len(b))
    penalty[0, 0] = 1e-9
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -40, 40)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ b)
        b += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in np.round(b, 9))


def facts_of(lexicon: Lexicon):
    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        a = lexicon.automaton()
        for texts in parts:
            yield pd.Series([lexicon.facts(t, a) for t in texts])

    return run


def score_of(lexicon: Lexicon):
    """A column function: the score of a text, from 0 to 1."""

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        a = lexicon.automaton()
        for texts in parts:
            facts = np.array([lexicon.facts(t, a) for t in texts], float).reshape(-1, 3)
            yield pd.Series(lexicon.score(facts))

    return run


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept from learning: crc32 of the id's text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def rate(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    lexicon = learn(docs, labels, held_out(), max_rows)
    out = docs.select("doc_id", held_out().alias("held_out"), score_of(lexicon)("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, least: float = 0.7) -> DataFrame:
    """The documents' own columns, those scoring ``least`` or more left out."""
    lexicon = learn(docs, labels, held_out(), max_rows)
    return docs.filter(score_of(lexicon)("text") < least)
