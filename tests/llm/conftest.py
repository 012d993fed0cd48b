import random

import pytest

ODD = "id long, text string, lang string, source string, n_chars long, score double, kept string, n_words int, shard string, length string, spans array<int>, candidates string, signature string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with nulls in every column, repeated rows, empty and very long texts, and columns that operators' own would clash with."""
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**9)}" for _ in range(30_000)]
    texts = [None, "", " \n\t", "one", "two words", "a b c", "Zürich ñandú 漢字 🙂 <|endoftext|> ok", " ".join(words), "x" * 50_000, "7" * 50_000, "same text here for all of us to read " * 40, "\u0000 \u0085   odd spaces   end"]
    rows = [(i, t, "en" if i % 2 else None, None, 5, 1.5, "k", 3, "s", "l", [1], "c", "g") for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], rows[10], (None, "no id at all", None, None, None, None, None, None, None, None, None, None, None), (None, None, "de", None, None, None, None, None, None, None, None, None, None), (77, rows[7][1] + " more", *rows[7][2:])]
    return spark.createDataFrame(rows, ODD.replace("id long", "doc_id long"))


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
