import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, fp long, h string"


def _rows():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, lines = prose(70), "\n".join(prose(9) for _ in range(12))
    texts = [None, "", "   \n\t ", "one", "One two  three", prose(300), shared, prose(20) + " " + shared + " " + prose(60), shared + "\n" + lines, prose(5) + "\n" + lines + "\n" + prose(70)]
    texts += ["Der " * 400, "Der " * 90, "x" * 9000, prose(120) * 40, "Á ß İ ſecret K \x0b\x0c end", lines, lines, prose(5) + "\n" + lines]
    base = prose(400).split()
    for _ in range(6):
        near = list(base)
        near[rng.randrange(400)] = word()
        texts.append(" ".join(near))
    texts += [texts[5]] * 3
    rows = [(i, t, "en" if i % 3 else None, "src0" if i % 2 else None, None if t is None else len(t), "k", i, "h") for i, t in enumerate(texts)]
    return [*rows, (None, shared, "en", "src0", 1, None, None, None), (None, None, None, None, None, None, None, None), rows[7], rows[5]]


@pytest.fixture(scope="session")
def rows():
    """Documents with every odd case: nulls, blanks, long texts, copies, near copies, repeated rows and clashing columns."""
    return _rows()


@pytest.fixture(scope="session")
def odd(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def real(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
