import hashlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa

from panelwright.llm import decontamination, grams, jaccard, substring
from panelwright.session import shared_folder
from tests.llm.conftest import UPPER, WORD


def test_word_hashes_do_not_depend_on_where_a_word_stands():
    texts = ["b a", None, "", " a\n\x0bb ", "a" * 700_000 + " a", "é a", "a\x00b"]
    h, counts = grams.words(pa.array(texts, pa.large_string()))
    assert counts.tolist() == [len(WORD.findall(t or "")) for t in texts]
    flat = [w for t in texts for w in WORD.findall(t or "")]
    seen = defaultdict(set)
    for w, x in zip(flat, h.tolist()):
        seen[w].add(x)
    assert all(len(x) == 1 for x in seen.values()) and len({min(x) for x in seen.values()}) == len(seen)
    sliced = pa.array(texts, pa.large_string()).slice(3, 2)
    assert grams.words(sliced)[0].tolist() == h[2:6].tolist()


def brute_repeats(rows, least=13):
    first = {}
    for d, t in sorted((LAST if r[0] is None else r[0], r[1]) for r in rows if r[1]):
        w = WORD.findall(t)
        for k in range(len(w) - least + 1):
            first.setdefault(tuple(w[k : k + least]), d)
    out = []
    for r in rows:
        w = WORD.findall(r[1] or "")
        gone = bytearray(len(w))
        for k in range(len(w) - least + 1):
            if first[tuple(w[k : k + least])] < (LAST if r[0] is None else r[0]):
                gone[k : k + least] = b"\1" * least
        out.append((r[0], len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=repr)


LAST = 2**63 - 1


def test_substring_dedup_is_what_brute_force_finds(docs, rows, nothing):
    got = substring.remove_repeats(docs).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=repr) == brute_repeats(rows)
    assert all(r.n_removed == sum(s.end - s.start for s in r.repeats) for r in got)
    assert substring.remove_repeats(nothing).count() == 0


def shingle_set(text, k):
    w = WORD.findall((text or "").translate(UPPER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(rows, k, percent):
    sets = [shingle_set(r[1], k) for r in rows]
    lead = list(range(len(rows)))

    def find(x):
        while lead[x] != x:
            x = lead[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both * 100 >= percent * (len(sets[i]) + len(sets[j]) - both):
                lead[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), LAST), r[0])
    return [(r[0], len(sets[i]), least.get(find(i))) for i, r in enumerate(rows)], len({find(i) for i in range(len(rows))})


def test_jaccard_join_finds_the_components_of_brute_force(docs, rows, nothing):
    for k, percent in ((4, 85), (5, 80)):
        want, groups = brute_components(rows, k, percent)
        got = jaccard.near_duplicates(docs, k, percent).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == sorted(want, key=repr)
    kept = jaccard.one_of_each(docs, 5, 80)
    assert kept.columns == docs.columns and kept.count() == groups
    assert jaccard.near_duplicates(nothing).count() == 0 and jaccard.one_of_each(nothing).count() == 0


def test_jaccard_join_counts_every_link(docs, rows):
    sets = [shingle_set(r[1], 4) for r in rows]
    want = []
    for i, a in enumerate(sets):
        n = sum(i != j and 100 * len(a & b) >= 85 * len(a | b) > 0 for j, b in enumerate(sets))
        want.append((rows[i][0], len(a), n))
    got = jaccard.near_duplicates(docs, 4, 85).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.n_links) for r in got), key=repr) == sorted(want, key=repr)


def test_signatures_meet_for_every_similar_pair():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 7, 12, 40, 90, 333, 1000):
        for percent in (80, 85, 90):
            for _ in range(12):
                most = 2 * n * (100 - percent) // (100 + percent)
                a = rng.integers(0, 2**63, n).astype(np.uint64)
                lost = int(rng.integers(0, most + 1))
                new = int(rng.integers(0, most - lost + 1))
                b = np.concatenate([a[: n - lost], rng.integers(0, 2**63, new).astype(np.uint64)])
                if not len(b) or len(set(a.tolist()) & set(b.tolist())) * 100 < percent * len(set(a.tolist()) | set(b.tolist())):
                    continue
                gram = np.concatenate([np.sort(a), np.sort(b)])
                row, sig = jaccard.signatures(np.repeat([0, 1], [len(a), len(b)]), gram, 2, percent)
                assert set(sig[row == 0].tolist()) & set(sig[row == 1].tolist()), (n, percent, lost, new)


def test_signatures_meet_across_several_size_classes():
    rng = np.random.default_rng(2)
    for percent, small, large in ((70, 7, 10), (60, 30, 50), (50, 100, 200), (40, 4, 10)):
        for _ in range(10):
            b = rng.integers(0, 2**63, large).astype(np.uint64)
            gram = np.concatenate([np.sort(b[:small]), np.sort(b)])
            row, sig = jaccard.signatures(np.repeat([0, 1], [small, large]), gram, 2, percent)
            assert set(sig[row == 0].tolist()) & set(sig[row == 1].tolist()), (percent, small, large)


def test_long_sets_are_counted_by_fragments(docs, rows):
    old, jaccard.PIECE = jaccard.PIECE, 16
    try:
        want, _ = brute_components(rows, 4, 85)
        got = jaccard.near_duplicates(docs).collect()
    finally:
        jaccard.PIECE = old
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == sorted(want, key=repr)


def brute_contamination(rows, bench, n=10):
    split = lambda t: decontamination_words(t)
    windows = defaultdict(set)
    for i, t in bench:
        w = split(t)
        size = min(n, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            windows[tuple(w[k : k + size])].add(i)
    out = []
    for r in rows:
        w, hit, items = split(r[1]), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit |= set(range(k, k + size))
                    items |= windows[tuple(w[k : k + size])]
        items = sorted(str(i) for i in items if i is not None)
        out.append((r[0], len(w), len(hit), len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def decontamination_words(text):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def test_decontamination_is_what_brute_force_finds(docs, rows, bench, nothing, monkeypatch):
    from tests.llm.conftest import BENCH

    want = brute_contamination(rows, BENCH)
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted((tuple(r) for r in decontamination.contamination(docs, bench).select(cols).collect()), key=repr) == want
    assert sum(w[5] for w in want) > 8
    # The way for a benchmark too large to broadcast.
    monkeypatch.setattr(decontamination, "SEED_ROWS", 3)
    assert sorted((tuple(r) for r in decontamination.contamination(docs, bench).select(cols).collect()), key=repr) == want
    clean = decontamination.decontaminate(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not w[5] for w in want)
    spans = decontamination.decontaminate(docs, bench, remove="spans")
    left = {r.doc_id: len(decontamination_words(r.text)) for r in spans.collect()}
    assert all(left[w[0]] == w[1] - w[2] for w in want)
    assert decontamination.contamination(nothing, bench).count() == 0
    assert decontamination.contamination(docs, bench.limit(0)).filter("contaminated OR n_hit > 0").count() == 0


def test_links_to_sets_without_copies_meet_nothing(spark, monkeypatch):
    links = spark.createDataFrame([(x, y) for x in range(8) for y in range(x + 1, 8)], "x long, y long")
    copies = spark.createDataFrame([(100, 0), (101, 0), (102, 50)], "rid long, rep long")
    plans, real = {}, jaccard.keep

    def keep(df, label):
        plans[label] = df._jdf.queryExecution().optimizedPlan().toString()
        return real(df, label)

    monkeypatch.setattr(jaccard, "keep", keep)
    got = {r.rid: r.n_links for r in jaccard.degrees(links, copies).collect()}
    assert got == {0: 9, 100: 9, 101: 9, 50: 1, 102: 1, **{i: 9 for i in range(1, 8)}}
    # A link whose end stands alone is not a row of a join.
    assert "LeftOuter" not in plans["degrees"]


def test_the_join_lets_go_of_its_sets(spark, tmp_path):
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in rng.integers(0, 500, 160)]
    texts = [" ".join(base[:i] + ["new"] + base[i + 1 :]) for i in range(0, 160, 8)] + [" ".join(f"v{i}" for i in rng.integers(0, 900, 60)) for _ in range(20)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    folder = Path(shared_folder(spark))
    before = set(folder.iterdir())
    assert jaccard.one_of_each(docs, 5, 80).count() == 21
    jaccard.near_duplicates(docs).collect()
    left = {p.name.rsplit("-", 5)[0] for p in set(folder.iterdir()) - before}
    assert left and not left & {"llm-sets", "llm-groups", "llm-common"}


def test_turns_deal_every_signature_once():
    rows = pa.RecordBatch.from_arrays([pa.array([3, 9]), pa.array([" ".join(f"w{i}" for i in range(n)) for n in (70, 300)])], ["rid", "text"])
    pairs = lambda *turn: [(s, r) for b in jaccard.signature_rows(4, 85, *turn)(iter([rows])) for s, r in zip(b["sig"].to_pylist(), b["rid"].to_pylist())]
    whole, parts = pairs(), [pairs(i, 3) for i in range(3)]
    assert sorted(whole) == sorted(sum(parts, [])) and all(parts)
