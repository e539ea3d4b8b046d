import random
import re

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


_rng = random.Random(5)
VOCABULARY = ["".join(_rng.choice(["ka", "lo", "mi", "ré", "tu", "Sha", "n"]) for _ in range(_rng.randint(1, 3))) for _ in range(400)]
BENCH = [(1, prose(_rng, 25)), (2, "short Item here"), (3, None), (4, ""), (5, prose(_rng, 12)), (None, prose(_rng, 11)), (6, "solo99")]


def corpus():
    rng = random.Random(3)
    passage = prose(rng, 40)
    base = prose(rng, 200)
    out = []
    for i in range(60):
        words = prose(rng, rng.randint(0, 120)).split()
        if i % 5 == 0:
            words[3:3] = passage.split()
        if i % 7 == 0 and words:
            words[1:1] = BENCH[0][1].split()[4:18]
        if i % 11 == 0:
            words += ["SHORT", "item,", "here"]
        out.append(" ".join(words))
    for i in range(25):  # near copies, some too far from the base
        words = base.split()
        for _ in range(i % 9):
            words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
        out.append(" ".join(words))
    out += [base] * 6 + [passage] * 3 + ["", " \n\t", "one", "Two words", "one", None, None, prose(rng, 13)]
    out.append(prose(rng, 6000))
    out.append(out[-1] + " " + prose(rng, 30))
    out.append(("ka " * 300).strip())
    out.append("solo99 " + "x" * 3000)
    out.append('password: "hunter22x" token=secret=abc token:token:abcdefgh AKIA' + "A1B2C3D4E5F6G7H8" + " api_key = é" + "0123456789abcdef" * 2)
    out.append("secret = kT9/x2LmQ4zR8vBn1YpW7sJd3HgF6cUa é key zQ8rT2yU6iO1pA5sD9fG3hJ7kL")
    rng.shuffle(out)
    rows = [(i, t, ["en", "de", None][i % 3], ["a", "b", "c", None, "b", "b"][i % 6], len(t or "")) for i, t in enumerate(out)]
    return rows + [rows[5], rows[5], (None, base, None, None, 1)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def bench(spark):
    return spark.createDataFrame(BENCH, "item_id long, text string").coalesce(1)


@pytest.fixture(scope="session")
def nothing(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus") / "empty.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def labels(spark, rows):
    return spark.createDataFrame(
        [(r[0], 1, int("hunter" in (r[1] or ""))) for r in rows] + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int"
    )
