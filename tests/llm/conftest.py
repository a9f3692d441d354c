import random

import pytest

SCHEMA = "doc_id long, text string, lang string, id long, key string, n long, digest string, unit int, rank long, doc string, line string, _key long, _own string, _gone int, root long"


def make(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, 7, "k", 3, "d", 1, 9, "e", "f", 5, "g", 6, 8) for i, t, lang in rows], SCHEMA)


def sample_rows(seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    shared = line(70)
    rows = []
    for i in range(40):
        text = "\n".join(line(rng.randint(3, 25)) for _ in range(rng.randint(1, 6)))
        if i % 5 == 0:
            text += "\n" + shared + " " + line(5)
        if i % 7 == 0 and rows:
            text = rows[-1][1]
        if i % 11 == 0 and rows:
            parts = rows[0][1].split(" ")
            parts[len(parts) // 2] = "zzz"
            text = " ".join(parts)
        rows.append((i * 3, text, "en" if i % 2 else "fr"))
    rows += [(500, None, None), (501, "", "en"), (502, "", None), (503, "x", "en"), (504, "ab " * 4000, "en"), (505, "q" * 30_000, None), (506, " \n\t\n ", "fr"), (507, "É é ÀB ab \U0001f600 漢字 don't", "fr")]
    return rows


@pytest.fixture(scope="session")
def rows():
    return sample_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return make(spark, rows).persist()


@pytest.fixture(scope="session")
def nothing(spark):
    return make(spark, [])
