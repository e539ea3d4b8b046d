"""Spelling variants, MinHash near-dedup and the filter audit against brute force."""

import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelwright.llm import across, filter_audit, grams, jaccard, minhash, spelling
from tests.llm.conftest import SCHEMA, WORD, prose
from tests.llm.test_text_joins import shingle_set

CLASH = ["rid", "n", "sig", "key", "place", "comp", "word", "form", "root", "part", "digest", "first", "good", "A", "E", "span", "a.b"]


def stored(spark, rows, path, schema=SCHEMA):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(path))
    return spark.read.parquet(str(path))


def with_clashes(docs):
    """Extra columns named like the operators' own, and one with a dot."""
    return docs.select("*", *[F.lit("x").alias(c) for c in CLASH])


# --- spelling -------------------------------------------------------------------


def brute_words(rows):
    n = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows):
    n = brute_words(rows)
    near = {w: [o for o in n if o != w and abs(len(o) - len(w)) < 2 and one_apart(w, o)] for w in n}
    form = {w: min(near[w], key=lambda o: (-n[o], o)) if near[w] else None for w in n}
    form = {w: o if o and n[o] >= 2 * n[w] else None for w, o in form.items()}
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def spelt(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def misspelt(rng, count):
    """Texts whose words have neighbours at every place, of lengths 5 and up, odd and even."""
    base = ["abcde", "aaaaaa", "éàüöß", "abcdefghijk", "Straße", "aaaaa", "x" * 40, "banana", "ananas"]
    out = []
    for i in range(count):
        words = []
        for w in base * 2:
            at, kind = int(rng.integers(len(w) + 1)), int(rng.integers(6))
            new = "abé"[int(rng.integers(3))]
            words.append({0: w[:at] + new + w[at:], 1: w[:at] + w[at + 1 :], 2: w[:at] + new + w[at + 1 :]}.get(kind, w))
        out.append((i if i % 9 else None, " ".join(words).upper() if i % 5 == 0 else "-".join(words), "en", "a", 1))
    return out


def test_spelling_variants_are_those_of_brute_force(spark, tmp_path, monkeypatch):
    rows = misspelt(np.random.default_rng(3), 120) + [(500, None, None, None, 0), (501, "", None, None, 0), (502, "12 ×÷ z", None, None, 0)]
    rows += [(520, "qwert " * 16 + "qwerta " * 7 + "qwertab " * 3, None, None, 0)]  # a chain of forms
    rows += [rows[4]] * 4 + [(600 + i, "y" * 30_000 + "z" * (i % 2), None, None, 0) for i in range(8)]
    docs = stored(spark, rows, tmp_path / "d")
    want = brute_variants(rows)
    assert any(r[1] and r[2] != r[1] for r in want) and max(r[4] for r in want) > 3
    assert spelt(spelling.variants(docs)) == want
    monkeypatch.setattr(spelling, "HELD", 3)
    monkeypatch.setattr(spelling, "LONG", 10)
    assert spelt(spelling.variants(with_clashes(docs))) == want


def test_spelling_of_the_corpus_and_of_nothing(docs, rows, nothing):
    assert spelt(spelling.variants(docs)) == brute_variants(rows)
    assert spelling.variants(nothing).count() == 0


def test_every_edit_keeps_a_chunk(spark):
    """Each single edit of words of many lengths is met, at any place."""
    words = {"".join(chr(97 + (i * 7 + j * j) % 26) for j in range(i)) for i in range(5, 14)}
    pool = set(words)
    for w in words:
        pool |= {w[:i] + "é" + w[i:] for i in range(len(w) + 1)} | {w[:i] + "é" + w[i + 1 :] for i in range(len(w))}
        pool |= {w[:i] + w[i + 1 :] for i in range(len(w)) if len(w) > 5}
    df = spark.createDataFrame([(w, 3) for w in sorted(pool)], "word string, n long")
    got = {frozenset((r.a, r.b)) for r in spelling.near_pairs(df).collect()}
    assert got == {frozenset((a, b)) for a in pool for b in pool if a != b and abs(len(a) - len(b)) < 2 and one_apart(a, b)}


def test_spelling_sends_no_table_to_every_task(spark, tmp_path, monkeypatch):
    """Stored words look small to Spark, what is exploded from them too: no join may rest on that."""
    docs = stored(spark, misspelt(np.random.default_rng(3), 60), tmp_path / "d")
    plans = []
    planned = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    for module in (spelling, jaccard):
        monkeypatch.setattr(module, "keep", lambda df, label, f=module.keep: (planned(df), f(df, label))[1])
    planned(spelling.variants(docs))
    assert sum("SortMergeJoin" in p for p in plans) >= 4 and not [p for p in plans if "Broadcast" in p]


# --- MinHash --------------------------------------------------------------------


def classes(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


def test_minhash_classes_are_those_of_brute_force(docs, rows, nothing):
    got = minhash.near_duplicates(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert classes(got) == classes_with_lowest(rows)
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in got.collect())
    assert minhash.near_duplicates(nothing).count() == 0
    assert classes(minhash.near_duplicates(with_clashes(docs))) == classes_with_lowest(rows)


def components_of(rows, k, percent):
    """The component of every row, by direct comparison of all sets."""
    sets = [shingle_set(r[1], k) for r in rows]
    lead = list(range(len(rows)))

    def top(x):
        while lead[x] != x:
            x = lead[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) * 100 >= max(len(a), len(b)) * percent and 100 * len(a & b) >= percent * len(a | b):
                lead[top(i)] = top(j)
    return [top(i) for i in range(len(rows))], sets


def classes_with_lowest(rows, percent=80):
    comps, sets = components_of(rows, 4, percent)
    low = defaultdict(list)
    for c, r in zip(comps, rows):
        low[c].append(r[0])
    low = {k: min((d for d in v if d is not None), default=None) for k, v in low.items()}
    return sorted(((r[0], len(s), low[c]) for c, r, s in zip(comps, rows, sets)), key=repr)


def test_one_row_of_each_component_stays(docs, rows):
    """The pipeline's near-duplicate stage, which looks for components alone."""
    comps, _ = components_of(rows, 5, 80)
    best = {}
    for c, r in zip(comps, rows):
        key = (r[0] is None, r[0] or 0)
        if c not in best or key < best[c][0]:
            best[c] = (key, (r[0], r[1]))
    got = jaccard.one_of_each(docs, 5, 80).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(v for _, v in best.values())


def test_minhash_chains_and_unlinked_families(spark, tmp_path):
    """Chains whose ends differ, many copies of a text too far from each other, and one very long text."""
    import random

    rng = random.Random(8)
    out, base = [], prose(rng, 150).split()
    step = list(base)
    for _ in range(12):  # each a little further from the first
        step[rng.randrange(len(step))] = f"new{rng.random()}"
        step[rng.randrange(len(step))] = f"new{rng.random()}"
        out.append(" ".join(step))
    for _ in range(40):
        words = list(base)
        for _ in range(rng.choice([3, 8, 12])):
            words[rng.randrange(len(words))] = f"odd{rng.random()}"
        out.append(" ".join(words))
    long = prose(rng, 40_000)
    out += [long, long + " and more", "a b", "a b", "a b c", "A B C", "", None, "one"]
    rows = [(1000 - i, t, "en", "a", 0) for i, t in enumerate(out)]
    got = classes(minhash.near_duplicates(stored(spark, rows, tmp_path / "d")))
    assert got == classes_with_lowest(rows)


def test_signatures_within_the_distance_share_a_key(spark):
    rng = np.random.default_rng(1)
    n = minhash.CHUNKS * minhash.LANES
    rows = []
    for i in range(60):
        sig = rng.integers(0, 1 << 16, n)
        other = sig.copy()
        wrong = rng.choice(n, minhash.DISTANCE if i % 2 else int(rng.integers(n + 1)), replace=False)
        other[wrong] ^= 1 << rng.integers(0, 16, len(wrong))
        for half, s in enumerate((sig, other)):
            longs = [sum(int(v) << 16 * k for k, v in enumerate(s[c * 4 : c * 4 + 4])) for c in range(minhash.CHUNKS)]
            rows.append((2 * i + half, [x - (1 << 64) if x >> 63 else x for x in longs], len(wrong)))
    df = spark.createDataFrame(rows, "rid long, sig array<long>, wrong int").cache()
    pairs = df.filter("rid % 2 = 0").alias("a").join(df.filter("rid % 2 = 1").alias("b"), F.expr("a.rid + 1 = b.rid"))
    assert pairs.filter(minhash.distance("a.sig", "b.sig") != F.col("a.wrong")).count() == 0
    met = minhash.keyed(df).groupBy("key").agg(F.collect_set("rid").alias("r")).filter("size(r) > 1").collect()
    met = {tuple(sorted(r.r)) for r in met}
    assert all((r[0], r[0] + 1) in met for r in rows if r[0] % 2 == 0 and r[2] <= minhash.DISTANCE)


def test_shares_of_equal_minima_estimate_similarity():
    words = [f"w{i}" for i in range(3000)]
    a, b = " ".join(words), " ".join(words[:2700] + [f"v{i}" for i in range(300)])
    h, counts = grams.words(pa.array([a, b], pa.large_string()))
    sig = minhash.minima(h, np.cumsum(counts) - counts, minhash._SEEDS, 16)
    lanes = sig.view(np.uint16)
    same = (lanes[0] == lanes[1]).mean()
    assert abs(same - 2700 / 3300) < 0.2


# --- filter audit ---------------------------------------------------------------


def brute_audit(rows, labels):
    first = {}
    for r in rows:
        if r[0] is not None:
            first[r[1] or ""] = min(first.get(r[1] or "", r[0]), r[0])
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    docs = defaultdict(list)
    for r in rows:
        t = r[1] or ""
        w = WORD.findall(t)
        f = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": r[0] is not None and first[t] < r[0],
        }
        docs[r[2] or ""].append(({k for k, v in f.items() if v}, r[0] in good, r[0] in toxic))
    out = []
    for part, group in docs.items():
        share, lines = Counter(), []
        for order in permutations("ABCDE"):
            left = group
            for step, f in enumerate(order):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                earlier = sum(f in d[0] for d in group) - len(gone)
                share[f] += len(gone)
                alone = sum(d[0] == {f} for d in group)
                lines.append((part, "".join(order), step + 1, len(left), len(gone), earlier, alone, sum(d[1] for d in gone), sum(d[2] for d in gone), f))
        out += [(*line[:-1], share[line[-1]]) for line in lines]
    return sorted(out)


def audited(docs, labels):
    return sorted(tuple(r) for r in filter_audit.audit(docs, labels).collect())


def test_filter_audit_is_what_brute_force_counts(spark, docs, rows, labels, nothing, monkeypatch):
    marks = [tuple(r) for r in labels.collect()]
    want = brute_audit(rows, marks)
    assert len(want) == 600 * len({r[2] or "" for r in rows}) and any(r[4] for r in want) and any(r[7] for r in want)
    assert audited(docs, labels) == want
    monkeypatch.setattr(filter_audit, "SPAN", 8)
    assert audited(with_clashes(docs), with_clashes(labels)) == want
    assert audited(docs, labels.limit(0)) == brute_audit(rows, [])
    assert filter_audit.audit(nothing, labels).count() == 0


def test_filter_audit_of_hot_parts_and_long_texts(spark, tmp_path):
    rows = [(i % 50, "Same TEXT here" if i % 3 else f"word{i} " * (i % 130), ["en", "", None][i % 3], None, 0) for i in range(240)]
    rows += [(900, "x y z " * 200_000, "de", None, 0), (901, "A" * 300_000 + "$", "de", None, 0), (None, "Same TEXT here", "en", None, 0)]
    marks = [(i, i % 2, (i + 1) % 3) for i in range(0, 50, 3)] * 2
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    assert audited(stored(spark, rows, tmp_path / "d"), labels) == brute_audit(rows, marks)


@pytest.mark.parametrize("seed", range(6))
def test_galloping_merges_are_set_operations(seed):
    rng = np.random.default_rng(seed)
    lists = [np.unique(rng.integers(0, [50, 5_000, 200_000][seed % 3], n)) for n in (0, 1, 40, 3_000, 20_000)]
    want = sorted(set().union(*[x.tolist() for x in lists]))
    assert filter_audit.union(lists).tolist() == want and filter_audit.union([]).tolist() == []
    for a in lists:
        for b in lists:
            assert filter_audit.less(a, b).tolist() == sorted(set(a.tolist()) - set(b.tolist()))
    for x in lists[3][::97]:
        assert filter_audit.gallop(lists[4], 0, int(x)) == int(np.searchsorted(lists[4], x))


def test_pairs_meet_once_and_are_judged_without_functions_of_arrays(spark):
    """Under the first key that two signatures share, if they are near; no lambda, which would be interpreted for each pair."""
    rng = np.random.default_rng(21)
    a = rng.integers(0, 2**16, (60, minhash.CHUNKS, 4), dtype=np.uint64)
    wrong = rng.random(a.shape) < rng.choice([0.05, 0.3, 0.45, 0.6], (60, 1, 1))
    b = np.where(wrong, (a + rng.integers(1, 2**16, a.shape, dtype=np.uint64)) % np.uint64(2**16), a)
    longs = [(v << (np.arange(4, dtype=np.uint64) * np.uint64(16))).sum(-1, dtype=np.uint64).view(np.int64).tolist() for v in (a, b)]
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(zip(*longs))], "i long, sig_x array<long>, sig_y array<long>")
    keys = [minhash.keyed(df.select(F.col("i").alias("rid"), F.col(f"sig_{v}").alias("sig"))).withColumnRenamed("place", f"place_{v}") for v in "xy"]
    met = keys[0].join(keys[1], ["rid", "key"]).join(df.withColumnRenamed("i", "rid"), "rid").filter(minhash.may_link())
    got = sorted((r.rid, r.place_x) for r in met.select("rid", "place_x").collect())
    want = []
    for i, e in enumerate(wrong.sum(-1)):
        chunk = next((c for c, n in enumerate(e) if n <= 1), None)
        if e.sum() <= minhash.DISTANCE and chunk is not None:
            want.append((i, 4 * chunk + (int(wrong[i, chunk].argmax()) if e[chunk] else 0)))
    assert got == want and 10 < len(want) < 60
    assert "lambda" not in met._jdf.queryExecution().optimizedPlan().toString()


def test_the_longer_signatures_rule_out_most_pairs_below_the_threshold(spark):
    """Sets of 3,000 n-grams with a similarity of 0.7 are no candidates at 80, those with 0.8 are."""
    rng = np.random.default_rng(22)
    sets, rows = {0.7: 0, 0.8: 0}, 40
    for s in sets:
        same = round(3000 * 2 * s / (1 + s))
        for _ in range(rows):
            both = rng.integers(0, 2**63, 6000 - same, dtype=np.uint64)
            gram = np.concatenate([both[:3000], both[3000 - same :]])
            x, y = across.minima(gram, np.array([0, 3000]), across._FINE_SEEDS, 4)
            wrong = sum(int((int(u) ^ int(v)) >> 4 * i & 15 > 0) for u, v in zip(x, y) for i in range(16))
            sets[s] += wrong <= across.fine_limit(80)
    assert sets[0.8] == rows and sets[0.7] <= rows // 4


def test_pairs_of_many_groups_count_once(spark):
    """Members of many groups in common: every pair across components stays, and comes from one group, not from all."""
    rng = np.random.default_rng(5)
    keys = [int(k) for k in rng.integers(-(2**63), 2**63 - 1, 40)]
    held = {r: keys if r < 10 else sorted(rng.choice(keys, int(rng.integers(1, 12)), replace=False).tolist()) for r in range(40)}
    held_df = spark.createDataFrame([(k, r, r % 3) for r, ks in held.items() for k in ks], "key long, rid long, comp long")
    info = spark.createDataFrame([(r, 100, 0) for r in held], "rid long, n long, alone long")
    want = {(a, b) for a in held for b in held if a < b and a % 3 != b % 3 and set(held[a]) & set(held[b])}
    least = across.least_keys(held_df, "key")
    got = [tuple(p) for p in across.across(held_df, info.join(least, "rid"), 80, across.LEAST_KEYS, across.meets_here("key_x")).collect()]
    assert set(got) == want
    alike = [p for p in got if p[1] < 10]
    assert len(alike) == len(set(alike)) and len(got) < sum(len(set(held[a]) & set(held[b])) for a, b in want) / 2


def test_pairs_of_short_sets_are_not_joined_twice(spark, monkeypatch):
    """Pairs of sets that are whole are counted as they are; the look at larger sets starts from those."""
    monkeypatch.setattr(jaccard, "PIECE", 8)
    texts = [" ".join(f"w{i}" for i in range(a, b)) for a, b in ((0, 9), (0, 11), (0, 40), (2, 44), (0, 90), (30, 36))]
    rows = spark.createDataFrame(list(enumerate(texts)), "rid long, text string").selectExpr("rid", "text")
    sets = jaccard.set_rows(4)
    sets = rows.mapInArrow(sets, "rid long, n long, cuts int, piece int, grams binary").cache()
    pairs = [(a, b) for a in range(6) for b in range(a + 1, 6)]
    brute = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in (t.split() for t in texts)]
    kept, real = {}, jaccard.keep
    monkeypatch.setattr(jaccard, "keep", lambda df, label: kept.setdefault(label, []).append(df) or real(df, label))
    turns = jaccard.counted_in_turns(spark.createDataFrame(pairs, "x long, y long"), sets).collect()
    assert {(r.x, r.y): (r.n_a, r.n_b, r.shared) for r in turns if r.shared} == {(a, b): (len(brute[a]), len(brute[b]), c) for a, b in pairs if (c := len(brute[a] & brute[b]))}
    assert sum(d.count() for d in kept["big"]) == sum(max(len(brute[a]), len(brute[b])) > 8 for a, b in pairs)
    # No pair of whole sets among what is joined there: only larger sets are.
    assert len(kept["long"]) == jaccard.TURNS and all(r.cuts > 1 for d in kept["long"] for r in d.collect())
