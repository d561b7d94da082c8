import random
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp int, words string, __id int"


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def edge_rows():
    """Nulls in every column, empty and long texts, repeated rows, ties, odd white space, columns with clashing names."""
    draw = random.Random(5)
    vocabulary = ["the", "of", "and", "été", "漢字", "x1", "Trash", "#", "a" * 40, "token=abc123def", "y|z"]
    prose = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    texts = [
        None, "", " \n\t ", "one", "two words", " no break", prose(30), prose(3000), "same line\n" * 9 + "other",
        "z" * 5000, "The End\r\nthe end\x0bTHE END", prose(30) + "\n\n" + prose(8), "é" * 50 + " " + "ſK" * 20,
    ]
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), i, "w", 0) for i, t in enumerate(texts)]
    rows += [(6, texts[6], "en", "s0", 1, 6, "w", 0)] * 3  # repeated rows
    rows += [(3, "another text for a known id", None, None, None, None, None, None), (None, "no id here", None, None, None, None, None, None),
             (None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
