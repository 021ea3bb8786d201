import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, shard int, kept boolean, ids string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows and ids, extra columns with clashing names."""
    line = "the quick brown fox jumps over the lazy dog and the cat sat on the mat while it rained"
    body = "\n".join(f"{line} number {i} of the story told by nobody" for i in range(8))
    rows = [
        (1, body, "en", "a", 1, 0, True, "x"),
        (1, body, "en", "a", 1, 0, True, "x"),
        (2, body, "en", None, 1, 0, True, "x"),
        (3, None, None, "b", None, None, None, None),
        (4, "", "en", "b", 0, 1, False, ""),
        (None, "le chat est sur la table et il dort dans la maison\n\n" * 3, "fr", "b", 5, 1, False, ""),
        (5, "mot " * 30_000, "fr", "c", 5, 1, False, ""),
        (6, "le chat est sur la table\t et  il dort dans la maison <|endoftext|> \U0001f600", "fr", "c", 5, 1, False, ""),
        (7, "x" * 5000, None, "c", 5, 1, False, ""),
        (8, " \n\t ", "en", "c", 5, 1, False, ""),
        (9, body.replace("dog", "dig"), "en", "c", 5, 1, False, ""),
    ]
    return spark.createDataFrame(rows, DOC).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC)
