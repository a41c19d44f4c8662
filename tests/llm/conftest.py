import pytest

WORDS = "the of river stone winter garden paper cloud silver morning table forest engine letter window market bridge summer".split()


@pytest.fixture(scope="session")
def prose():
    """prose(seed, n): n words that depend on the seed."""

    def make(seed: int, n: int) -> str:
        state, out = seed * 2654435761 % 2**32 or 1, []
        for _ in range(n):
            state = (state * 1103515245 + 12345) % 2**31
            out.append(WORDS[(state >> 12) % len(WORDS)] + str((state >> 7) % 97))
        return " ".join(out)

    return make


@pytest.fixture
def odd_docs(spark, prose):
    """Nulls, empty and very long texts, repeated rows, and columns named like inner ones."""
    long = "\n".join(prose(i, 400) for i in range(60))
    rows = [
        (1, prose(1, 80), "a"),
        (2, prose(1, 80), "b"),
        (2, prose(1, 80), "b"),
        (3, None, None),
        (4, "", "a"),
        (5, " \n\t ", None),
        (None, prose(1, 80), "a"),
        (None, None, None),
        (6, long, "b"),
        (7, "one two", "a"),
    ]
    rows = [(*r, 9, "x", 0.5, "row") for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, run int, sid string, h double, row string")
