import pytest
from llm_helpers import frame, prose


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls, empty and blank texts, ties, repeated rows, odd signs, a very long text."""
    long = prose(9, 60_000)
    texts = [
        (5, prose(1, 200)), (3, prose(1, 200)), (3, prose(1, 200)), (None, prose(1, 200)), (8, "  " + prose(1, 200).replace(" ", "\n ")),
        (10, None), (11, ""), (12, " \t\n"), (13, "one"), (14, "Two\x0bwords"), (15, "!!! ??? 123"), (16, "\x00\x1c \x85 naïve Ünïcödé ΣΑΣ İ 日本語 🙂"),
        (20, long), (21, long + " tail"), (22, prose(2, 300)), (None, None), (23, prose(3, 5000)), (24, "x" * 30_000), (25, "don't I'LL we've <|endoftext|> 3½"),
    ]
    return frame(spark, texts).repartition(3).persist()


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, [])
