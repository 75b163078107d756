import pytest

from pairset.session import local_session

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "pairset-llm-tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session


@pytest.fixture
def docs(spark):
    """Documents from (id, text) pairs, with a column whose name operators use inside."""

    def build(*rows, extra=True):
        table = [(i, t, "en", "src", len(t) if t is not None else None) for i, t in rows]
        df = spark.createDataFrame(table, DOCS)
        return df.selectExpr("*", "'x' AS score", "1 AS node", "2 AS n", "'y' AS line") if extra else df

    return build


def words(n, start=0, stem="w"):
    return " ".join(f"{stem}{chr(97 + (start + i) % 26)}{chr(97 + (start + i) // 26 % 26)}q" for i in range(n))
