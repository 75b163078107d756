import pytest

from pairset.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "pairset-tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture
def out(tmp_path):
    return str(tmp_path)


def rows(df, *columns):
    """Sorted tuples of a DataFrame, for order-free comparison."""
    return sorted(tuple(r[c] for c in (columns or df.columns)) for r in df.collect())
