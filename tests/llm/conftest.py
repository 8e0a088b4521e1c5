import pytest

ROWS = [
    (1, "The cat sat on the mat and looked at the dog that lay there all day long in the warm sun of the garden\nagain\nagain"),
    (2, "The cat sat on the mat and looked at the dog that lay there all day long in the warm sun of the garden\nagain\nagain"),
    (3, None),
    (4, ""),
    (5, " \t\n"),
    (6, "one two"),
    (7, "word " * 30_000),
    (None, "no id here but some words in a row for a while"),
    (8, "Mail bob@example.com or +1 (555) 010-9999 now, from 10.0.0.1, card 4111 1111 1111 1111.\n" * 3),
    (8, "Mail bob@example.com or +1 (555) 010-9999 now, from 10.0.0.1, card 4111 1111 1111 1111.\n" * 3),
    (9, "ünï çødé ﬁ 中文 İ ẞ ▁x y 😀"),
]
#: Extra columns that clash with what the operators return.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words string, score string, h string, start string, key string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, clashing columns."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y", "z", "h", "s", "k") for i, t in ROWS], SCHEMA)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
