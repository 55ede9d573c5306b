"""Queries over tables that hold more than the given ones do."""

from datetime import datetime, timedelta

import duckdb
import pytest

from test_oracles import rows
from tidewright.plans import catalog


@pytest.mark.parametrize("name", ["platform_gaps", "calendar_occurrences"])
def test_all_event_types_count(spark, tmp_path, name):
    start = datetime(2024, 1, 1)
    # 250 types; only the first hundred are observed in the first hour, and all in the second
    data = [(k, start + timedelta(minutes=h * 60 + k % 50), 10 if h or k < 100 else 1, f"type{k:03d}", 1.0) for k in range(250) for h in (0, 1)]
    spark.createDataFrame(data, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    df = catalog.QUERIES[name](spark, str(tmp_path))
    cursor = con.execute(catalog.ORACLE_SQL[name])
    want = rows([d[0] for d in cursor.description], cursor.fetchall())
    assert want and rows(df.columns, [tuple(r) for r in df.collect()]) == want
