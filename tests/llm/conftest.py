import pytest

TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog. It's here, isn't it?  Two  spaces\n\n and\ttabs"),
    (2, "The quick brown fox jumps over the lazy dog. It's here, isn't it?  Two  spaces\n\n and\ttabs"),
    (3, "thequickbrownfox"),
    (4, "the quick\nbrown fox"),
    (5, None),
    (6, ""),
    (7, " \n\t "),
    (8, "Ünïcödé wörds 中文字符 and emoji 😀😀 ¼ ² ٣"),
    (9, "long " * 30_000),
    (10, "x" * 5_000),
    (None, "a row without an id"),
    (11, "one two three four"),
    (11, "one two three four"),
]


@pytest.fixture(scope="session")
def tricky(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns
    whose names operators use themselves."""
    rows = [(i, t, "en", "src", None if t is None else len(t), 7, "k", 1.0) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row int, key string, score double")


@pytest.fixture(scope="session")
def nothing(tricky):
    return tricky.limit(0)
