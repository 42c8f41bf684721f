import pytest
from hypothesis import settings

settings.register_profile("any time", deadline=None)
settings.load_profile("any time")

LONG = "word " * 3000 + "andanothervery" * 2000


@pytest.fixture(scope="session")
def messy(spark):
    """Documents with nulls, empty and long texts, repeated rows, and columns named like the operators' own."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", "a"),
        (1, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", "a"),
        (2, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", None),
        (3, None, None, None),
        (4, "", "de", "b"),
        (5, "   \n\t ", "de", "b"),
        (6, LONG, "fr", "a"),
        (None, "no id here, only words", "en", "a"),
        (None, None, None, None),
        (7, "one two", "en", "b"),
        (8, "ÀÉ 123 !!! <|endoftext|>  double  space   \U0001f600", "fr", "a"),
        (9, "½ 42 ...", "en", "a"),
    ]
    names = ["score", "bits", "items", "rank", "Spans", "label", "n_words", "predicted", "lang_pred"]
    extra = ", ".join(f"{n} int" for n in names)
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {extra}"
    return spark.createDataFrame([(*r, len(r[1] or ""), *[7] * len(names)) for r in rows], schema)


@pytest.fixture(scope="session")
def nothing(messy):
    return messy.limit(0)
