import pytest

LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
SAME = "the quick brown fox jumps over the lazy dog and then goes home to sleep until the next morning comes around"


@pytest.fixture(scope="session")
def edge(spark):
    """Null, empty, blank, short, very long, tied and repeated texts, null ids, and columns whose names operators use inside."""
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, LONG), (6, SAME), (6, SAME), (7, SAME), (8, SAME + " again"), (None, SAME), (None, None), (9, "x" * 5000 + " é日本 \x1c\xa0 end"), (10, "a b\nc\rd\x0be\x0cf")]
    rows = [(i, t, None if k % 4 == 0 else "en", None if k % 5 == 0 else "s", 7, "b", 1, "w", 0.5, "p", True) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, block string, bucket int, words string, score double, path string, kept boolean")


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


@pytest.fixture(scope="session")
def plain(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
