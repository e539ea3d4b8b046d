import math
import time
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelwright.llm import kneser_ney, mixing, secret_scan, sharding, topk, toxicity, url_trust
from tests.llm.conftest import WORD


def test_mixing_reaches_its_targets(docs, rows, nothing):
    got = mixing.mixture(docs).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    assert len(got) == len(rows) and {r.source: r.source_size for r in got} == dict(sizes)
    target = {r.source: r.target for r in got}
    weight = dict(zip(sorted(sizes, key=lambda s: (s is None, s or "")), [5, 2, 1, 5]))
    free = [s for s in sizes if target[s] < 3 * sizes[s] - 1e-6]
    assert abs(sum(target.values()) - sum(sizes.values())) < 1e-6
    assert len({round(target[s] / weight[s], 6) for s in free}) == 1
    assert all(3 * sizes[s] <= target[free[0]] / weight[free[0]] * weight[s] + 1e-6 for s in sizes if s not in free)
    taken = defaultdict(int)
    for r in got:
        taken[r.source] += r.taken
        assert r.taken == r.size * r.copies and r.copies - math.floor(r.target / r.source_size) in (0, 1)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 0.1 * target[s] + max(r.size for r in got if r.source == s)
    again = mixing.mixture(docs).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    out = mixing.mix(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in got)
    assert mixing.mixture(nothing).count() == 0 and mixing.mix(nothing).count() == 0


def check_shards(rows, n, groups):
    counts = Counter(r.shard for r in rows)
    assert max(counts.values()) - min(counts[s] for s in range(n)) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    return sum(len({r.shard for r in g}) - 1 for g in groups)


def test_sharding_keeps_groups_and_sizes(spark, docs, rows, nothing):
    got = sharding.shard_documents(docs).collect()
    text = {r[0]: r[1] or "" for r in rows}
    groups = defaultdict(list)
    for r in got:
        if r.doc_id is not None:
            assert r.size == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
        groups[r.text_crc32].append(r)
    assert len(got) == len(rows) and {r.law for r in got} == {"rows"}
    assert check_shards(got, 8, [g for c, g in groups.items() if c]) == 0
    assert sharding.shard_documents(nothing).count() == 0


def test_a_group_larger_than_a_shard_fills_it(spark, tmp_path):
    many = [(i, "same" if i % 3 == 0 else f"pair {i // 2}") for i in range(300)]
    spark.createDataFrame(many, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "d"))
    got = sharding.shard_documents(spark.read.parquet(str(tmp_path / "d"))).collect()
    same = Counter(r.shard for r in got if r.text_crc32 == zlib.crc32(b"same"))
    check_shards(got, 8, [])
    assert max(same.values()) >= 37 and len(same) <= 8


def test_quotas_swap_evenly_and_fill_what_is_free():
    flow = {(0, 1): 10, (1, 0): 4, (2, 1): 6}
    q = sharding.quotas(flow, [0, 6, 0])
    assert q[1, 0] == 4 and q[0, 1] - 4 + q[2, 1] <= 6 and q[0, 1] >= 4


def test_quotas_let_rings_move():
    flow = {(0, 1): 2, (1, 2): 3, (2, 0): 2, (2, 3): 1, (0, 3): 4}
    assert sharding.quotas(flow, [0, 0, 0, 0]) == {(0, 1): 2, (1, 2): 2, (2, 0): 2, (2, 3): 0, (0, 3): 0}
    assert sharding.ring({(0, 1): 1, (1, 2): 1}) == [] and len(sharding.ring({(0, 1): 1, (1, 2): 1, (2, 1): 1})) == 2


def entropy(s):
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values())


def test_secret_scan(docs, rows, nothing):
    assign = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
    text, found = {r[0]: r[1] or "" for r in rows}, 0
    for r in secret_scan.scan(docs).collect():
        if r.doc_id is None:
            continue
        t = text[r.doc_id]
        base = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(t) if len(m[2]) >= 6]
        base += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        base += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        spans = [s for s in r.spans.split(",") if s]
        assert [s for s in spans if s[:7] != "entropy"] == [f"{k}:{a}:{e}" for a, _, e, k in sorted(base)]
        for kind, a, e in (s.split(":") for s in spans if s[:7] == "entropy"):
            got = t[int(a) : int(e)]
            assert entropy(got[:20]) >= 3.0 - 1e-6 and len(got) >= 20
            found += 1
    assert found >= 1 and secret_scan.scan(nothing).count() == 0


def test_entropy_windows_are_those_of_a_direct_count(spark):
    rng = np.random.default_rng(2)
    strings = ["".join(rng.choice(list("abcdefAB01"[: 3 + i % 7]), 20 + i)) + "9" for i in range(30)]
    df = spark.createDataFrame([(i, s, 100) for i, s in enumerate(strings)], "id int, string string, start int")
    got = {(r.id, r.start, r.end) for r in secret_scan.entropy_spans(df).collect()}
    want = set()
    for i, s in enumerate(strings):
        least = 3.0 if re.fullmatch("[0-9a-f]+|[0-9A-F]+", s) else 3.6
        hot = [p for p in range(len(s) - 19) if round(entropy(s[p : p + 20]), 6) >= least]
        for n, p in enumerate(hot):
            if n == 0 or p - hot[n - 1] > 20:
                start = p
            if n + 1 == len(hot) or hot[n + 1] - p > 20:
                want.add((i, 100 + start, 100 + p + 20))
    assert got == want


def test_entropy_finds_planted_secrets_of_each_kind(spark):
    rng = np.random.default_rng(11)
    pick = lambda signs, n: "".join(rng.choice(list(signs), n))
    upper, mixed, b64 = "0123456789ABCDEF", "0123456789abcdefABCDEF", "abcdefghijkmnpqrstuvwxyzACDEFGHJKLMNPQRSTUVWXYZ23456789"
    kinds = {
        "digits": lambda: (pick("0123456789", 23), 0), "k": lambda: ("k=" + pick(upper, 20), 2), "sig": lambda: ("sig=" + pick(upper, 32), 4),
        "mixed": lambda: (pick(mixed, 32), 0), "word": lambda: ("example-" + pick(b64, 24), 8), "inside": lambda: (pick(b64, 16) + "12345678" + pick(b64, 16), 0),
        "date": lambda: ("log-2024-01-15-" + pick(b64, 30), 15), "path": lambda: ("var/lib/" + pick(b64, 40), 8),
        "uuid": lambda: ("12ab34cd-12ab-34cd-56ef-0123ab5678cd-" + pick(b64, 30), 37),
    }
    rows = [(f"{k} {i}", *make()) for k, make in kinds.items() for i in range(20)]
    clean = ["id=9f8b1c2d-3e4f-4a5b-8c6d-7e8f9a0b1c2d", "usr/share/fonts/truetype/dejavu2/readme", "release-notes-and-known-issues-2024", "x" * 30 + "1"]
    df = spark.createDataFrame([(i, s, 0) for i, s, _ in rows] + [(s, s, 0) for s in clean], "id string, string string, start int")
    got = {r.id: r for r in secret_scan.entropy_spans(df).collect()}
    assert not set(clean) & set(got)
    missed = Counter(i.split()[0] for i, s, at in rows if i not in got or got[i].end < at + 18)
    assert sum(missed.values()) <= 2, missed


def test_toxicity_learns_words_beginnings_and_disguises(spark, nothing):
    rng = np.random.default_rng(4)
    plain = ["stone", "river", "grubel", "lights", "moving", "over", "under", "table", "green", "quiet"]
    rows, labels = [], []
    for i in range(400):
        words = list(rng.choice(plain, 30 + i % 50))
        bad = i % 4 == 0
        if bad:
            words.insert(5, ["vilewort", "grobnak" + "abcdefgh"[i // 8 % 8]][i // 4 % 2])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels + [(None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.rate(docs, marks).collect()
    assert all(r.predicted == int(r.doc_id % 4 == 0) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    lexicon = toxicity.learn(docs, marks, toxicity.held_out(), exceptions=["vilewort garden"])
    a = lexicon.automaton()
    score = lambda t: float(lexicon.score(np.array([lexicon.facts(t, a)]))[0])
    for text in ("a VILEWORT!", "v1lew0rt here", "ѵіlеwоrt", "the grobnakzz", "ｖｉｌｅｗｏｒｔ"):
        assert score(text) > 0.7, text
    for text in (None, "", "a quiet river", "a vilewort garden", "previleworts 2019"):
        assert score(text) < 0.3, text
    assert toxicity.rate(nothing, marks).count() == 0
    none = toxicity.rate(docs, marks.limit(0)).collect()
    assert all(r.predicted == 0 for r in none)


def test_toxicity_sample_is_bounded_in_rows(spark):
    rows = [(i, f"text {i}") for i in range(50)] + [(3, "copy")] * 300 + [(4, f"other {i}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(50)], "doc_id long, quality int, toxic int")
    every = toxicity.labelled(docs, labels, None, 1000)
    assert every.count() == 651 and every.filter("text = 'copy'").count() == 1
    assert 0 < toxicity.labelled(docs, labels, None, 100).count() < 200


def kneser_ney_brute(texts, order):
    counts = [Counter() for _ in range(order + 1)]
    for t in texts:
        s = "\0" * (order - 1) + t
        counts[order].update(s[i : i + order] for i in range(len(t)))
    for n in range(order - 1, 0, -1):
        counts[n].update(g[1:] for g in counts[n + 1])

    def p(gram):
        n = len(gram)
        c = counts[n]
        k = [sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]
        y = k[0] / (k[0] + 2 * k[1]) if k[0] + k[1] else 0.0
        d = [min(max(i - (i + 1) * y * (k[i] / k[i - 1] if k[i - 1] else 0.0), 0.1 * i), 0.95 * i) for i in (1, 2, 3)]
        lower = p(gram[1:]) if n > 1 else 1 / (len(counts[1]) + 1)
        seen = [v for g, v in c.items() if g[:-1] == gram[:-1]]
        if not seen:
            return lower
        cut = lambda v: d[min(v, 3) - 1]
        own = max(c[gram] - cut(c[gram]), 0) if c[gram] else 0
        return own / sum(seen) + sum(map(cut, seen)) / sum(seen) * lower

    return p


def test_kneser_ney_is_the_formula(spark, monkeypatch):
    texts = ["abracadabra", "bar é baz", "abab", "cad"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    model = kneser_ney.train(df)
    p = kneser_ney_brute(texts, kneser_ney.ORDER)
    probe = spark.createDataFrame([(0, "abra bar"), (1, "zz\U0001f600q"), (2, None), (3, "")], "rid long, text string")
    for rows in (10**6, 40):  # one shard, and many
        monkeypatch.setattr(kneser_ney, "SHARD_ROWS", rows)
        got = {r.rid: r for r in kneser_ney.perplexity(probe, model).collect()}
        for rid, t in ((0, "abra bar"), (1, "zz\U0001f600q")):
            s = "\0" * (kneser_ney.ORDER - 1) + t
            want = sum(math.log(p(s[i : i + kneser_ney.ORDER])) for i in range(len(t)))
            assert got[rid].n == len(t) and abs(got[rid].logp - want) < 1e-3
        assert got[2].n == got[3].n == 0


def test_kneser_ney_joins_words_that_no_task_holds(spark, monkeypatch, tmp_path):
    texts = ["the cat sat on the mat", "a cat sat on a hat", "the dog sat", "on the mat the cat sat"] * 2
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    letter = {w: chr(97 + i) for i, w in enumerate(sorted(set(" ".join(texts).split())))}
    as_chars = lambda t: "".join(letter.get(w, "?") for w in t.split())
    p = kneser_ney_brute([as_chars(t) for t in texts], kneser_ney.ORDER)
    model = kneser_ney.train(df, "word")
    probe = spark.createDataFrame([(0, "the cat sat on a mat"), (1, "unheard dog"), (2, None)], "rid long, text string")
    for held in (10**6, 20, 1):
        monkeypatch.setattr(kneser_ney, "SHARD_ROWS", held)
        sent = []
        monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, v, f=type(spark.sparkContext).broadcast: (sent.append(v), f(self, v))[1])
        got = {r.rid: r for r in kneser_ney.perplexity(probe, model, "word").collect()}
        monkeypatch.undo()
        assert len(sent) == 1 and len(sent[0][0]) <= held
        for rid, t in ((0, "the cat sat on a mat"), (1, "unheard dog")):
            s = "\0" * (kneser_ney.ORDER - 1) + as_chars(t)
            want = sum(math.log(p(s[i : i + kneser_ney.ORDER])) for i in range(len(t.split())))
            assert got[rid].n == len(t.split()) and abs(got[rid].logp - want) < 1e-3
        assert got[2].n == 0


def test_kneser_ney_stores_no_n_grams(spark, monkeypatch, tmp_path):
    """Steps that are kept have a row per text or word, or counts of counts, but none per n-gram; turns and parts change nothing."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 60, 80)) for _ in range(50)] + [None, "", "w1"] * 2
    path = str(tmp_path / "t")
    spark.createDataFrame([(i, t, i % 3 > 0) for i, t in enumerate(texts)], "rid long, text string, known boolean").repartition(3).write.parquet(path)
    base = spark.read.parquet(path)
    kept = []
    monkeypatch.setattr(kneser_ney, "keep", lambda df, label, *a, f=kneser_ney.keep: (kept.append(f(df, label, *a)), kept[-1])[1])
    want = None
    for columns in (["rid", "text", "known"], ["rid", "text"]):  # read once, and apart from the model's texts
        got = kneser_ney.perplexity(base.select(columns), kneser_ney.train(base.filter("known").select("text"), "word"), "word")
        got = sorted(map(tuple, got.collect()))
        assert want is None or got == want
        want = got
        for name, value in (("TURNS", 1), ("COUNTED", 1), ("GATHERED", 20), ("MERGED", 10), ("SHARD_ROWS", 7)):
            monkeypatch.setattr(kneser_ney, name, value)
    assert max(df.count() for df in kept) <= 60 + 5 * 4 + 60 * 8 < 50 * 80 * 2 / 3


def test_quality_classes(docs, rows, labels, nothing):
    got = kneser_ney.classify(docs, labels)
    out = got.collect()
    assert len(out) == len(rows) and all(r.keep for r in out if not r.perplexity)
    assert sum(not r.keep for r in out) < 0.15 * len(out)
    assert kneser_ney.classify(nothing, labels).count() == 0
    assert kneser_ney.classify(docs, labels.limit(0)).filter("NOT keep").count() == 0


def test_top_k_is_exact(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(5, 16))
    vectors = [(centre[i % 5] + 0.4 * rng.normal(size=16)).round(2).tolist() for i in range(700)]
    vectors[10] = vectors[20] = vectors[300]
    rows = [(i, v) for i, v in enumerate(vectors)]
    rows += [(800, None), (900, [1.0] * 15 + [None]), (1000, [float("nan")] * 16), (1100, []), (None, vectors[0]), (300, vectors[300]), (1200, [1.0, 2.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).write.parquet(str(tmp_path / "e"))
    df = spark.read.parquet(str(tmp_path / "e"))
    v = np.floor(1024 * np.array(vectors + [vectors[300]], np.float32).astype(float)).astype(np.int64)
    ids = np.array([*range(700), 300])
    want = []
    for at in np.flatnonzero(ids % 100 == 0):
        score = v @ v[at]
        order = [i for i in np.lexsort((ids, -score)) if i != at][:10]
        want += [(int(ids[at]), r + 1, int(ids[i]), int(score[i])) for r, i in enumerate(order)]
    for block, queries in ((16_384, 4_096), (97, 3)):
        monkeypatch.setattr(topk, "BLOCK", block)
        monkeypatch.setattr(topk, "QUERIES", queries)
        assert sorted(tuple(r) for r in topk.top_k(df).collect()) == sorted(want)
    assert topk.top_k(df.limit(0)).count() == 0


def test_url_rules_and_trust(spark, tmp_path):
    pages = [
        (1, "http://A.Example.org/es/x", '<a href="http://ok.net/">'), (2, "https://example.org/en/12?q", None), (3, "https://x.example.org/fr", ""),
        (4, "ftp://shop.com/fr/1#t", "<a href='https://ok.net/a'>"), (5, "https://shop.com/de/1", ""), (6, "https://bad.net/", '<A HREF="http://evil.com/de/">x</a>'),
        (7, "http://evil.com/de/", ""), (8, "http://ok.net", ""), (9, "nothing", None), (10, None, None), (11, "http://org", ""), (8, "http://ok.net", ""),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r for r in url_trust.judge(df).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert (got[2].rule, got[3].rule, got[4].rule, got[5].rule) == ("example.org/en/1", "org/", "com/fr/", "com/de/")
    assert got[6].rule is None and got[6].verdict == "block"
    assert got[8].verdict == "allow" and got[8].trust > 0
    assert all((got[i].host, got[i].path, got[i].rule, got[i].verdict) == ("", "", None, "allow") for i in (9, 10))
    assert got[11].rule is None
    assert url_trust.judge(df).count() == len(pages) and url_trust.judge(df.limit(0)).count() == 0


def test_pipeline_stages_chain(spark, tmp_path, rows, bench, labels):
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{folder}/documents.parquet")
    bench.write.parquet(f"{folder}/benchmark.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert set(columns) <= set(out.columns) and (name == "sharding" or out.columns == columns)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    last = docs.collect()
    check_shards(last, 8, [])
    assert Counter((r.doc_id, r.text) for r in corpus_pipeline.run(spark, folder).collect()) == Counter((r.doc_id, r.text) for r in last)


def fewest_cuts(sizes, room):
    """The fewest extra shards that groups of these sizes have to take, by trying all ways to keep groups whole."""
    best = [sum(sizes)]

    def place(i, free, cuts):
        if cuts >= best[0]:
            return
        if i == len(sizes):
            best[0] = cuts
            return
        for s in range(len(free)):
            if free[s] >= sizes[i] and free[s] not in free[:s]:
                place(i + 1, [*free[:s], free[s] - sizes[i], *free[s + 1 :]], cuts)
        # Cut it: fill the shards with most room.
        left, rest, used = sizes[i], list(free), 0
        for s in sorted(range(len(free)), key=lambda s: -free[s]):
            took = min(left, rest[s])
            rest[s] -= took
            left -= took
            used += took > 0
            if not left:
                break
        place(i + 1, rest, cuts + used - 1)

    place(0, room, 0)
    return best[0]


def test_few_links_are_cut_on_small_cases(spark):
    """Groups that fit are whole, also where they fill the shards; against all ways of placing them."""
    rng = np.random.default_rng(4)
    for case in ([12, 5, 4, 3, 2, 2, 2, 1, 1, 1, 1, 1, 1], [3] * 12, [9, 9, 9, 9], [20, 2, 2, 2, 2, 2, 2], rng.integers(1, 6, 14).tolist()):
        rows = [(i, f"group {g}") for g, n in enumerate(case) for i in range(n)]
        rng.shuffle(rows)
        rows = [(k, t) for k, (_, t) in enumerate(rows)]
        df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
        out = sharding.shard_documents(df, 4).collect()
        groups = defaultdict(list)
        for r in out:
            groups[r.text_crc32].append(r)
        room = [len(rows) // 4 + (s < len(rows) % 4) for s in range(4)]
        cuts = check_shards(out, 4, list(groups.values()))
        # Where linked rows leave no place at all, moves may get stuck a little earlier.
        spare = 3 if max(case) == min(case) == 3 else 1
        assert cuts <= fewest_cuts(sorted(map(int, case), reverse=True), room) + spare, case


def test_a_run_of_letters_is_scanned_in_time(spark):
    """One megabyte without a digit, secrets of letters alone, and stretches that cross the pieces."""
    rng = np.random.default_rng(1)
    letters = list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
    token = "".join(rng.choice(letters, 32))
    texts = ["xy" * 500_000, "ka lo mi " * 60_000, f"see {token} here", "".join(rng.choice(letters, 9000)), "internationalisation of characteristically", "key " + "".join(rng.choice(list("0123456789abcdef"), 12_000)) + " z"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("rid", F.lit("clash"))
    start = time.time()
    got = {r.doc_id: r for r in secret_scan.scan(df).collect()}
    assert time.time() - start < 60
    assert got[0].spans == got[1].spans == got[4].spans == "" and got[2].spans.startswith("entropy:")
    assert got[5].spans == "hex:4:12004"
    hot = [p for p in range(9000 - 19) if round(entropy(texts[3][p : p + 20]), 6) >= 3.8]
    cuts = [i for i, (a, b) in enumerate(zip(hot, hot[1:]), 1) if b - a > 20]
    want = [f"entropy:{hot[a]}:{hot[b - 1] + 20}" for a, b in zip([0, *cuts], [*cuts, len(hot)])]
    assert got[3].spans == ",".join(want)


def test_mixing_of_a_hot_id(spark, tmp_path):
    """A third of a source's rows with one id: each draws on its own."""
    rows = [(7 if i % 3 == 0 else None if i % 3 == 1 else i, " ".join(["w"] * (1 + i % 5)) + (f" {i}" if i % 2 else ""), "ab"[i % 7 == 0]) for i in range(3000)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("rate", F.lit(0)).repartition(3).write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    out = mixing.mixture(df).collect()
    taken, target = Counter(), {}
    for r in out:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] + 6 for s in target)
    hot = [r.copies for r in out if r.doc_id == 7 and r.source == "a"]
    assert len(set(hot)) == 2
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r.copies for r in out)


def test_trust_is_personalised_page_rank(spark):
    rng = np.random.default_rng(2)
    n = 12
    links = {(int(a), int(b)): int(c) for a, b, c in zip(rng.integers(0, n - 3, 25), rng.integers(0, n, 25), rng.integers(1, 4, 25)) if a != b}
    edges = spark.createDataFrame([(f"h{a}", f"h{b}", c) for (a, b), c in links.items()], "src string, dst string, n long")
    seeds = spark.createDataFrame([("h0", 1.0, 0.0), ("h3", 0.5, 0.5), ("h5", 0.0, 1.0)], "host string, trusted double, blocked double")
    got = {r.host: r for r in url_trust.propagate(seeds, edges, 0.7, 1e-10).collect()}
    w = np.zeros((n, n))
    for (a, b), c in links.items():
        w[a, b] = c
    for seed, m, name in (({0: 1.0, 3: 0.5}, w, "trust"), ({3: 0.5, 5: 1.0}, w.T, "distrust")):
        s = np.zeros(n)
        for k, v in seed.items():
            s[k] = v / sum(seed.values())
        rank = s.copy()
        for _ in range(300):
            out = m.sum(1)
            given = (rank / np.where(out > 0, out, 1)) @ m
            rank = 0.7 * (given + rank[out == 0].sum() * s) + 0.3 * s
        mine = np.array([getattr(got[f"h{i}"], name) if f"h{i}" in got else 0.0 for i in range(n)])
        assert np.allclose(mine, rank, atol=1e-8) and mine.sum() == pytest.approx(1.0)
    still = url_trust.propagate(seeds, edges.limit(0))
    assert still.count() == 3
