import pytest

from seriesloom.llm.common import ship

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, rk long, k1 string, salt int, kept string, passes int, block int, component_id string, n_words int, perturbed string, mix_pass string"
LONG = " ".join(f"w{i % 977}x{i // 31}" for i in range(60_000))


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


def edge_rows():
    more = ("en", "s", 3, 7, "k", 1, "old", 2, 3, "c", 4, "p", "m")
    texts = [(1, "a b c d"), (1, "a b c d"), (2, None), (3, ""), (4, " \t\n "), (5, "é日本 ß a b"), (6, LONG), (7, "a b c d"), (None, "a b c d e"), (8, "x" * 50_000), (9, "a\x00b c"), (10, "<|endoftext|> hi")]
    rows = [(d, t, *more) for d, t in texts]
    return rows + [(11, "only text", None, None, *[None] * 11)]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in any column, empty and very long texts, repeated rows, columns named as the operators' own."""
    return spark.createDataFrame(edge_rows(), COLUMNS).repartition(3).persist()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)
