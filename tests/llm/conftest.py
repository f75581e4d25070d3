import pytest
from pyspark.sql import types as T

ODD = [
    (1, None, "en", "a", 0, "x"), (2, "", "en", "a", 0, "x"), (3, "  \n\t ", None, None, None, None),
    (4, "Two words", "en", "a", 9, "y"), (4, "Two words", "en", "a", 9, "y"), (5, "12 345 ... !!", "fr", "b", 13, "z"),
    (6, "très long " * 30_000, "fr", "b", 300_000, "z"), (None, "no id but words here", "de", None, 1, None),
    (7, "漢字 テスト 🎉 <|endoftext|> end", "de", "c", 1, None)]
FIELDS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EXTRA = ", n_words string, found string, first int, gone int, key int, component string, `a.b` int"


@pytest.fixture(scope="session")
def make(spark):
    def build(rows, schema=FIELDS):
        return spark.createDataFrame(rows, T.StructType.fromDDL(schema))

    return build


@pytest.fixture(scope="session")
def odd(make):
    """NULLs in every column, empty and very long texts, repeated rows, and columns that clash with names of results."""
    return make([(*r[:5], r[5], r[5], 1, 2, 3, r[5], 4) for r in ODD], FIELDS + EXTRA)


@pytest.fixture(scope="session")
def none(make):
    return make([])


@pytest.fixture(scope="session")
def corpus(make):
    """A few hundred texts with copies, near copies, shared passages, junk and benchmark passages; all from a fixed seed."""
    import random

    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)] + ["The", "AND", "of"] * 20
    passage = [rng.choice(words) for _ in range(60)]
    rows = []
    for i in range(240):
        text = [rng.choice(words) for _ in range(rng.choice([3, 4, 5, 7, 12, 60, 150, 700]))]
        if i % 5 == 0:
            text[len(text) // 2:len(text) // 2] = passage
        if i % 7 == 0 and rows:
            text = rng.choice(rows)[1].split(" ")
            for _ in range(rng.choice([0, 1, 2, len(text) // 40])):
                text[rng.randrange(len(text))] = rng.choice(words)
        if i % 11 == 0:
            text = [t + rng.choice(["***", "%%%", "$$$"]) for t in text]
        for j in range(12, len(text), 13):
            text[j] += "\n"
        rows.append((i, " ".join(text), rng.choice(["en", "de"]), "s", 0))
    return rows
