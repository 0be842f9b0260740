import pytest

from tidewatch.session import ensure_checkpoint_dir

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, row string, key long, size string, target int, copies string, label int, text2 string, word string, "
    "gram string, places string, starts int, block int, taken int, grp string, shard int, ids string, media string, payload string, sections string, n string, left string, decoded string"
)
LONG = " ".join(f"word{i} of a very long text" for i in range(3000))
PASSAGE = " ".join(f"shared{i}" for i in range(50))


def extra():
    return ("row", 1, "big", 2, "x", 3, "y", "w", "g", "p", 1, 2, 3, "h", 4, "i", "m", "p", "s", "n", "l", "d")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows and clashing column names."""
    rows = [
        (1, None, "en", "a", None), (2, "", None, "a", 0), (3, "   \t\n", "en", None, 5), (4, LONG, "en", "b", len(LONG)), (5, "12345 -- !!", "de", "b", 11),
        (6, f"begin here {PASSAGE} end here", "en", "a", 1), (7, f"other start {PASSAGE} and other end", "fr", None, 2), (8, "one two three four five six seven", "en", "c", 3),
        (9, "one two three four five six seven", "en", "c", 3), (9, "one two three four five six seven", "en", "c", 3), (10, "Grüße, 中文 <|endoftext|> é́", "de", "c", 4), (None, "a text without an id", "en", "a", 5),
        (11, "ab " * 80, None, "d", 6), (12, "x" * 5000, "en", None, 7),
    ]
    return spark.createDataFrame([r + extra() for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("false")


@pytest.fixture(scope="session", autouse=True)
def folders(spark):
    ensure_checkpoint_dir(spark)
