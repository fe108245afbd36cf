import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    base = tmp_path_factory.mktemp("spark")
    os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(base / "warehouse"))
        .config("spark.checkpoint.dir", str(base / "shared"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small(tmp_path_factory):
    """Small tables of the shapes that the queries read, made here, and a DuckDB connection with views on them."""
    from types import SimpleNamespace

    import duckdb

    folder, con = tmp_path_factory.mktemp("tables"), duckdb.connect()
    made = {
        "region": "SELECT i::INTEGER AS r_regionkey, 'REGION' || i AS r_name FROM range(5) t(i)",
        "nation": "SELECT i::INTEGER AS n_nationkey, chr(65 + (i % 9)::INTEGER) || 'N' || i AS n_name, (i % 5)::INTEGER AS n_regionkey FROM range(25) t(i)",
        "customer": "SELECT i AS c_custkey, 'Cust' || i AS c_name, (i % 25)::INTEGER AS c_nationkey, i * 1.5 AS c_acctbal, 'SEG' || (i % 3) AS c_mktsegment FROM range(1, 61) t(i)",
        "part": "SELECT i AS p_partkey, ['small ring', 'red widget', 'Blue Bolt', 'hot gear', 'Redding'][i % 5 + 1] AS p_name, 'Brand#' || (11 + i % 25) AS p_brand, ['ECONOMY', 'PROMO', 'STANDARD'][i % 3 + 1] AS p_type, (i * 7 % 50 + 1)::INTEGER AS p_size, i * 1.0 AS p_retailprice FROM range(200) t(i)",
        "orders": "SELECT i AS o_orderkey, i % 60 + 1 AS o_custkey, 'O' AS o_orderstatus, 1000.25 + i * 37.5 AS o_totalprice, TIMESTAMP '1996-06-01' + INTERVAL (i * 3) DAY AS o_orderdate, (i % 5 + 1) || '-P' AS o_orderpriority FROM range(300) t(i)",
        "events": "SELECT i AS event_id, TIMESTAMP '2024-01-01' + INTERVAL (i) MINUTE AS ts, i % 9 AS user_id, 'T' || (i % 4) AS event_type, 1.25 * (i % 17) + 1 AS value, '{}' AS props FROM range(200) t(i)",
        "documents": "SELECT i AS doc_id, 'text ' || (i % 70) AS text, ['en', 'de'][i % 2 + 1] AS lang, 'src' || (i % 4) AS source, 300 + (i % 70) * 40 AS n_chars FROM range(100) t(i)",
        "pages": "SELECT i AS page_id, 'https://h' || (i % 7) || '.example.com/p' || i || '/f.html' AS url, '<p>' AS html FROM range(60) t(i)",
    }
    for name, sql in made.items():
        con.execute(f"COPY ({sql}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return SimpleNamespace(folder=str(folder), con=con)
