import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, ties and columns with clashing names."""
    long = " ".join(f"word{i % 977} other{i % 31}." for i in range(20_000))
    rows = [(1, None, "en", "a"), (2, "", None, "a"), (3, " \n\t", "en", None), (4, "short text", "en", "b"),
            (5, long, "en", "b"), (6, long, "fr", None), (6, long, "fr", None), (None, "no id here, but some words in it", "de", "c"),
            (7, "x<|endoftext|>y 日本 é́ \x1c", "ja", "c")]
    rows = [(*r, 5, "k", 1, 0.5, b"i") for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int, row string, "
                                       "rank int, score double, ids binary")
