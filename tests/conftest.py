import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    s = (
        SparkSession.builder.master("local[*]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.local.dir", f"{scratch}/local")
        .config("spark.checkpoint.dir", f"{scratch}/shared")
        .config("spark.sql.warehouse.dir", f"{scratch}/warehouse")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def small():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def duck(small):
    import duckdb

    c = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"create view {name} as select * from '{small}/{name}.parquet'")
    return c


def plain(frame):
    """Column names, and the rows as sorted texts; numbers with nine digits."""
    import math

    cols = sorted(frame.columns)
    rows = []
    for row in frame[cols].itertuples(index=False):
        out = []
        for v in row:
            v = v.tolist() if hasattr(v, "tolist") else v
            if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>"):
                out.append("~")
            elif isinstance(v, (int, float)) and not isinstance(v, bool):
                out.append(f"{v:.9g}")
            else:
                out.append(str(v))
        rows.append(tuple(out))
    return cols, sorted(rows)


@pytest.fixture(scope="session")
def same():
    def check(a, b):
        assert plain(a) == plain(b)

    return check
