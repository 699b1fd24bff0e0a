import pathlib
import random
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).parent))

DOCS = "doc_id long, text string"


@pytest.fixture
def rng():
    return random.Random(20)


@pytest.fixture
def odd_documents(spark):
    """Rows every operator must take: nulls, blanks, no id, repeated rows, a very long
    text, other alphabets, and columns named like an operator's own."""
    rows = [
        (1, None),
        (2, ""),
        (3, " \n\t "),
        (4, "one"),
        (None, "a row without an id"),
        (5, "said twice"),
        (5, "said twice"),
        (6, "naïve café, 漢字 🙂 ok " * 20),
        (7, " ".join(f"long{i}" for i in range(60_000))),
        (8, "x" * 300_000),
    ]
    made = spark.createDataFrame(rows, DOCS)
    for name in ("ids", "kept", "node", "runs", "others", "part", "score", "n_words"):
        made = made.selectExpr("*", f"7 as {name}")
    return made
