import os
import random

import pytest

FOLDER = "/root/testdata/sf0.001"
# Names that operators use inside; a table may have them too.
EXTRA = {"h": 1, "doc": 2, "fp": 3, "part": 4, "lang_pred": "x", "_kept": 5, "_text": "t", "sections": 6, "score": 0.5, "anchors": 7}


@pytest.fixture(scope="session", autouse=True)
def workers_find_the_package():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    before = os.environ.get("PYTHONPATH", "")
    os.environ["PYTHONPATH"] = f"{root}{os.pathsep}{before}" if before else root


@pytest.fixture(scope="session")
def tokenizers():
    import public_tokenizers
    return public_tokenizers.path


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text, lang): nulls, empty and very long texts, ties and repeated rows."""
    rnd = random.Random(5)
    words = ["alpha", "be", "Gamma,", "del.ta", "é", "漢字", "x" * 30, "12", "#", "the"]
    long = " ".join(rnd.choice(words) + str(rnd.randint(0, 400)) for _ in range(30_000))
    passage = " ".join(f"w{i}" for i in range(30))
    return [
        (1, "one two three", "en"), (1, "one two three", "en"), (2, None, "en"), (3, "", None), (4, " \t\n ", "de"),
        (None, "one two three", None), (None, None, None), (5, long, "en"), (6, long + " end", "de"), (7, passage, "en"),
        (8, f"start {passage} end", "de"), (8, f"other {passage}", "de"), (9, passage.replace(" ", "  "), "en"),
        (10, "a b c \x1c d", "de"), (11, "12 34 !!", "en"), (12, "ab " * 200, "en"), (13, "x" * 50_000, None)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    schema = "doc_id long, text string, lang string, " + ", ".join(
        f"{k} {'string' if isinstance(v, str) else 'double' if isinstance(v, float) else 'int'}" for k, v in EXTRA.items())
    return spark.createDataFrame([(*r, *EXTRA.values()) for r in odd_rows], schema)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")
