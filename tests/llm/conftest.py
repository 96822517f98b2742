import random

import pytest

COLUMNS = "doc_id long, text string, lang string, score double, part int, key long, sid long, n long, spans string, held_out int"


def words(random_, count, letters="abcde"):
    return " ".join("".join(random_.choice(letters) for _ in range(random_.randint(1, 6))) for _ in range(count))


@pytest.fixture(scope="session")
def edge_rows():
    """Missing, empty and long texts, repeated rows, ties and odd characters."""
    draw = random.Random(5)
    long_text = words(draw, 30_000)
    texts = [None, "", " ", "\n\n", "one", "one two three", "a b c d e", "mail a@b.co +1 555 0100 200", "x\x00y \x1c z é　中文 ’s 's", long_text, long_text]
    rows = list(enumerate(texts))
    rows += [(3, "\n\n"), (5, "one two three"), (None, "no id here"), (None, None)]
    rows += [(100 + at, words(draw, 80) + "\n" + words(draw, 3)) for at in range(6)]
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    """The rows with further columns whose names operators use themselves."""
    return spark.createDataFrame([(*row, "en", 0.5, 1, 2, 3, 4, "s", 1) for row in edge_rows], COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)
