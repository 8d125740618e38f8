import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, hash long, n int"


@pytest.fixture
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    rows = [
        (0, "A plain text with a few words, and some more of them."),
        (1, None),
        (2, ""),
        (3, "A plain text with a few words, and some more of them."),
        (3, "A plain text with a few words, and some more of them."),
        (None, "no id here"),
        (4, "  two  spaces \n and\tother  white space \x0b x\n\n\nend  "),
        (5, "word " * 20000),
        (6, "x" * 60000),
        (7, "Été naïve 中文 \U0001f600 ▁ \u0000 <|endoftext|> </s> it's 1,234.5"),
        (8, " "),
        (9, "\n"),
        (20, "mail a.b@c.example, 10.1.2.3 or +1 (555) 010-9999 or 4111 1111 1111 1111."),
    ]
    return spark.createDataFrame([(a, b, None if a == 4 else "en", None if a == 5 else "s", None, "x", 7, 1) for a, b in rows], SCHEMA)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


SF = "/root/testdata/sf0.001"
