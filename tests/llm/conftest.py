import pytest

#: Texts that every operator on documents has to take: nulls, empty ones, ties, a long one, marks and odd signs.
ODD = [
    (1, None, "en", "a"), (2, "", None, "a"), (3, "   \n\t ", "en", None), (4, "Of the thing that is there. And the mit license.", "en", "a"),
    (5, "Of the thing that is there. And the mit license.", "en", "a"), (None, "no id here", "en", "b"), (7, "le la des été où ça naïve 日本語 é  x", "fr", "b"),
    (8, "one", "en", "b"), (9, "a  b   c \n\n d ▁ e", "en", ""), (10, "word and word " * 30000, "en", "b"), (10, "same id twice", "de", "b"), (12, "<|endoftext|> <s> </s> <unk> ▁x", "de", "\U00010000"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, label string, n_tokens string, component_id string"


@pytest.fixture(scope="session")
def odd(spark):
    """Odd documents with extra columns whose names clash with those of results."""
    return spark.createDataFrame([(i, t, la, s, len(t or ""), "x", "x", "x", "x", "x") for i, t, la, s in ODD], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
