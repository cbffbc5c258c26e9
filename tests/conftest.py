import math
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from stratalane.session import local_session

    session = local_session("4", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def duck():
    import duckdb

    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return db


def plain(value):
    """A value in a form that compares alike whichever engine gave it."""
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="session")
def same_as_sql(spark, duck):
    """Holds a query against its SQL on the smallest tables; the rows are given back."""

    def check(query, sql):
        found = query(spark, SF)
        got = found.collect()
        want = duck.execute(sql)
        columns = [d[0] for d in want.description]
        assert table_of(found.columns, got) == table_of(columns, want.fetchall())
        return got

    return check
