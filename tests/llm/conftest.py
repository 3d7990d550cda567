import pytest

LONG = " ".join(f"w{i % 977}x{i}" for i in range(60_000))

#: id, text, lang; with nulls, empty and very long texts, ties and repeated rows
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en"),
    (2, None, "en"),
    (3, "", None),
    (4, "  \n\t \n", "en"),
    (5, LONG, "en"),
    (6, "idiot", "en"),
    (7, "Der schnelle braune Fuchs springt über den faulen Hund", "de"),
    (7, "Der schnelle braune Fuchs springt über den faulen Hund", "de"),
    (None, "a text without an id stays what it is", None),
    (9, "x\x00y \x1c\x85 漢字 😀 'tis 12 ½", None),
]


@pytest.fixture(scope="session")
def odd(spark):
    """The rows above, with further columns whose names operators use themselves."""
    rows = [(i, t, lang, "s", 1.0, [1], "y", 0) for i, t, lang in ROWS]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, id string, score double, ids array<int>, _keep string, _hits int")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("doc_id < 0")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (6, 0, 1), (6, 0, 1), (None, 1, 1), (5, None, None), (7, 1, 0), (9, 0, 0)], "doc_id bigint, quality int, toxic int")
