import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('checkpoints')}").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small():
    if not Path(SMALL).exists():
        pytest.skip("no test data")
    return SMALL


@pytest.fixture(scope="session")
def duck(small):
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


def rows(names, values):
    """Rows by name, in an order that doesn't depend on the engine."""
    at = [names.index(n) for n in sorted(names)]
    key = lambda r: [(v is None, str(type(v)) if not isinstance(v, (int, float)) else "", v if v is not None else 0) for v in r]
    return sorted((tuple(r[i] for i in at) for r in values), key=key)


def same(df, relation, close=True):
    """Whether a DataFrame and a DuckDB result hold equal rows."""
    got, names = rows(df.columns, [tuple(r) for r in df.collect()]), [d[0] for d in relation.description]
    want = rows(names, relation.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == b if not close else all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) < 2e-5 * max(1, abs(x))) for x, y in zip(a, b, strict=True)), (a, b)
