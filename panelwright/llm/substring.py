"""Substring dedup: seed and extend.

Seeds are winnowed anchors: of every run of ``least`` words the smallest hash
among its five-word grams, so any repeat of ``least`` words shares an anchor.
Anchors that occur in one text only are dropped by a partial aggregation. Around
the others each occurrence is extended to the left and right to all runs of
``least`` words that chose this anchor; runs meet by their own hash and their
anchor's (128 bits), and the smallest doc_id of a run decides. Neighbouring
repeated runs join to maximal repeats, which are removed from the later document.

Nothing is paired: a passage in a million documents costs a million rows. Exact
copies of a text are settled by their text's digest and add no runs.

Defined results: words are what stands between ASCII white space; null and empty
texts have none; repeats inside one document, and between rows of one doc_id, do
not count; a null doc_id comes after all others; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import keep, with_rid
from panelwright.llm.grams import U, batches, grams, inside, mix, row_of, words

ANCHOR = 5
LAST = 2**63 - 1


def _anchors(h: np.ndarray, counts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all runs of ``least`` words, where each one's anchor starts, and the anchors' hashes."""
    ok = np.flatnonzero(inside(counts, least, len(h)))
    g = grams(h, ANCHOR)
    if not len(ok):
        return ok, ok, g
    at = np.empty(len(ok), np.int64)
    span = np.lib.stride_tricks.sliding_window_view(g, least - ANCHOR + 1)
    for i in range(0, len(ok), 1 << 16):
        part = ok[i : i + (1 << 16)]
        at[i : i + (1 << 16)] = part + span[part].argmin(axis=1)
    return ok, at, g


def anchor_rows(least: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for start, texts in batches(part.column("text")):
                h, counts = words(texts)
                _, at, g = _anchors(h, counts, least)
                at = np.unique(at)
                row, anchor = row_of(counts)[at] + start, g[at].view(np.int64)
                order = np.lexsort((anchor, row))
                row, anchor = row[order], anchor[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1])
                row = row[new]
                rid = part.column("rid").to_numpy()[row]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[new]), pa.array(rid), pa.array(part.column("text_hash").to_numpy()[row])],
                    ["anchor", "rid", "text_hash"],
                )

    return run


def run_rows(least: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rids, docs = part.column("rid").to_numpy(), part.column("doc").to_numpy()
            lists = part.column("anchors")
            for start, texts in batches(part.column("text")):
                h, counts = words(texts)
                ok, at, g = _anchors(h, counts, least)
                mine = lists.slice(start, len(texts))
                live, size = mine.flatten().to_numpy().view(U), mine.value_lengths().to_numpy()
                tag = mix(np.arange(len(texts)).astype(U))
                row = row_of(counts)
                keep_ = np.isin(g[at] ^ tag[row[ok]], live ^ tag[np.repeat(np.arange(len(texts)), size)])
                ok, at = ok[keep_], at[keep_]
                row = row[ok]
                pos = ok - (np.cumsum(counts) - counts)[row]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(grams(h, least)[ok].view(np.int64)), pa.array(g[at].view(np.int64)),
                        pa.array(docs[row + start]), pa.array(rids[row + start]), pa.array(pos.astype(np.int32)),
                    ],
                    ["run", "anchor", "doc", "rid", "pos"],
                )

    return run


def cut_rows(least: int):
    """Words that no repeated run covers, and the maximal repeats."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = {"n_words": [], "n_removed": [], "kept": [], "repeats": []}
            hits = part.column("hits")
            sizes = hits.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat, at = hits.flatten().to_numpy(), 0
            copied = part.column("copied").to_numpy(zero_copy_only=False)
            for i, text in enumerate(part.column("text")):
                ws = (text.as_buffer() or b"") and bytes(text.as_buffer()).split() if text.is_valid else []
                n, starts = len(ws), np.sort(flat[at : at + sizes[i]])
                at += sizes[i]
                if copied[i] and n >= least:
                    starts = np.array([0, n - least]) if n < 2 * least else np.arange(0, n - least + 1)
                if not len(starts):
                    spans, kept = [], ws
                else:
                    first = np.flatnonzero(np.diff(starts, prepend=starts[0] - least - 1) > least)
                    lasts = np.append(first[1:], len(starts)) - 1
                    spans = [(int(starts[a]), int(starts[b]) + least) for a, b in zip(first, lasts)]
                    kept, to = [], 0
                    for a, b in spans:
                        kept += ws[to:a]
                        to = b
                    kept += ws[to:]
                out["n_words"].append(n)
                out["n_removed"].append(n - len(kept))
                out["kept"].append(b" ".join(kept).decode())
                out["repeats"].append([{"start": a, "end": b} for a, b in spans])
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *[pa.array(v, t) for v, t in zip(out.values(), kinds)]], ["doc_id", *out]
            )

    return run


def repeated_runs(base: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(rid, pos) of runs that a smaller doc_id holds too, and (rid) of rows whose whole text a smaller doc_id has."""
    facts = base.select("rid", F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.unhex(F.sha2("text", 256)).alias("digest"))
    facts = keep(facts.filter(F.col("digest").isNotNull()), "digests")
    firsts = facts.groupBy("digest").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last")
    copies = keep(facts.join(firsts, "digest").filter("doc > first").select("rid"), "copies")

    seeds = base.select("rid", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        anchor_rows(least), "anchor long, rid long, text_hash long"
    )
    shared = seeds.groupBy("anchor").agg(F.min("text_hash").alias("a"), F.max("text_hash").alias("b")).filter("a <> b")
    live = seeds.select("anchor", "rid").join(shared.select("anchor"), "anchor")
    live = live.groupBy("rid").agg(F.collect_list("anchor").alias("anchors")).join(copies, "rid", "left_anti")
    live = keep(live, "anchors")

    near = base.select("rid", F.coalesce("doc_id", F.lit(LAST)).alias("doc"), "text").join(live, "rid")
    kinds = "run long, anchor long, doc long, rid long, pos int"
    runs = near.select("rid", "doc", "text", "anchors").mapInArrow(run_rows(least), kinds)
    runs = keep(runs, "runs")
    first = runs.groupBy("run", "anchor").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last")
    again = runs.join(first.select("run", "anchor", "first"), ["run", "anchor"]).filter("doc > first").select("rid", "pos")
    return again, copies


def remove_repeats(docs: DataFrame, least: int = 13) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept (text left, words joined by a space), repeats (word spans)."""
    base = with_rid(docs.select("doc_id", "text"))
    again, copies = repeated_runs(base, least)
    hits = again.groupBy("rid").agg(F.collect_list("pos").alias("hits"))
    marks = keep(hits.withColumn("copied", F.lit(False)).unionByName(copies.selectExpr("rid", "array() AS hits", "true AS copied")), "marks")
    rows = base.join(marks, "rid", "left").select(
        "doc_id", "text", F.coalesce("hits", F.array().cast("array<int>")).alias("hits"), F.coalesce("copied", F.lit(False)).alias("copied")
    )
    kinds = "doc_id long, n_words long, n_removed long, kept string, repeats array<struct<start:long,end:long>>"
    return rows.mapInArrow(cut_rows(least), kinds)
