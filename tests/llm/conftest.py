import random

import pytest


@pytest.fixture(scope="session")
def awkward():
    """Texts that tokenizers read in unusual ways."""
    pick = random.Random(1)
    letters = "ab 'stmdrevel  \n\t.,!-09 é 　ΣİÀ漢字🙂́ñ12\x1c\x85½²_٣"
    made = ["".join(pick.choice(letters) for _ in range(pick.randint(0, 40))) for _ in range(400)]
    return [
        *made, "", "   ", "\n\n a", "I'll we've they're it's 's 'S '' 's's don''t  'll", "'", "'s", "'re", "'rest 'v",
        "a 's", "a\n's", "ΑΣ ΣΑΣ", "<|endoftext|>", "a<|startoftext|>b <|endoftext|><|endoftext|> x", "x" * 5000,
        "word " * 300_000,
    ]


@pytest.fixture()
def documents(spark):
    """A table of documents; ``extra`` columns clash with names that the operators use."""

    def make(rows, extra=False):
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        return df.selectExpr("*", "1 AS id", "2 AS ids", "'x' AS length", "3 AS key", "4 AS fp0") if extra else df

    return make


def document_rows(texts):
    return [(k, t, "en", "s", None if t is None else len(t)) for k, t in enumerate(texts)]
