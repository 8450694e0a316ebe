import random

import pytest

LONG = 30_000


@pytest.fixture(scope="session")
def words():
    rng = random.Random(3)
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(3000)]


@pytest.fixture(scope="session")
def documents(spark, words):
    """Null, empty, blank and very long texts, ties, repeated rows, a null id, clashing columns."""
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [text(120) for _ in range(12)]
    rows = [(i, base[i], "en", f"s{i % 3}") for i in range(12)]
    for i in range(12, 40):  # near copies of one text, more and more unlike it
        w = base[0].split()
        for _ in range(i - 12):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, " ".join(w), "en", None))
    rows += [(40, None, None, "s1"), (41, "", "en", "s1"), (42, " \n\t ", "en", "s1"), (43, "1234 $$$ !!", None, "s2")]
    rows += [(44, text(LONG), "en", "s2"), (45, base[1].upper(), "en", "s2"), (46, "one two", "en", "s2"), (47, "One  TWO", "en", "s2")]
    rows += [(48, base[2], "en", "s2")] * 3 + [(None, base[3], "en", "s2"), (None, text(50), "en", "s2")]
    rows += [(50 + i, base[5] + " " + text(60), "en", "s0") for i in range(8)]
    schema = "doc_id long, text string, lang string, source string"
    df = spark.createDataFrame(rows, schema)
    # names that operators use inside
    return df.selectExpr("*", "1 AS size", "2 AS node", "3 AS n_shingles", "4 AS `key`", "5 AS n", "6 AS spans", "7 AS score", "8 AS value", "9 AS `row`")


@pytest.fixture
def no_documents(documents):
    return documents.limit(0)
