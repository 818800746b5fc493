import duckdb
import pytest

DATA = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def data():
    return DATA


def compare(df, sql, **views):
    """The rows of df are those of the SQL over the Parquet files."""
    con = duckdb.connect()
    for name, path in views.items():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    cols = sorted(df.columns)
    cur = con.execute(sql)
    at = [[x[0] for x in cur.description].index(c) for c in cols]
    normal = lambda rows: sorted(tuple(str(float(v)) if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert normal(df.select(cols).collect()) == normal([tuple(r[i] for i in at) for r in cur.fetchall()])
