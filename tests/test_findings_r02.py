"""What the second round's review found: queries on small tables that tell them from their SQL."""

import datetime

import duckdb
import pytest

import __spark_entry__

LINES = [
    (1, "Here the thing\nis of all. He said the one\n\nor two of them went"),
    (2, "Das rein\nder tag\nund die. Il a la ontion\nthe et de it. It was the\nlot of it"),
    (3, "the\r\nlot of rein the \r\nlot of it"),
    (4, None),
]


def equal_to_sql(spark, folder, name: str, table: str, rows, schema: str):
    """The query's rows over one table, after they were held against its SQL."""
    path = str(folder / f"{table}.parquet")
    spark.createDataFrame(rows, schema).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/*.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = __spark_entry__.queries()[name](spark, str(folder)).select(*columns)
    rows = sorted((tuple(r) for r in got.collect()), key=repr)
    assert rows == sorted(want.fetchall(), key=repr)
    return rows


@pytest.mark.parametrize("name", ["claim_entities", "claim_extract_documents"])
def test_rules_reach_over_line_ends(spark, tmp_path, name):
    rows = equal_to_sql(spark, tmp_path, name, "documents", LINES, "doc_id long, text string")
    assert {r[:2] for r in rows} == {(1, 0), (1, 1), (2, 1), (3, 0)}


#: Contributions that as products lie on or next to half a millionth, and round to another ten-thousandth for it.
HALVES = [
    (1136148, "2024-01-11 19:40:41.227179", 17438, "error", 66.77, '{"k": 87}'),
    (921777, "2024-01-07 13:15:47.202366", 14233, "view", 1.41, '{"k": 15}'),
    (679941, "2024-01-24 23:19:12.645707", 10253, "error", 44.47, '{"k": 15}'),
    (3250377, "2024-01-16 01:32:47.794644", 48698, "view", 3.63, '{"k": 23}'),
    (5, "2024-01-16 01:32:47.794644", 8, "error", 0.0, '{"k": 1}'),
]


def test_contributions_round_as_sql_does(spark, tmp_path):
    events = [(i, datetime.datetime.fromisoformat(at), *rest) for i, at, *rest in HALVES]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    rows = equal_to_sql(spark, tmp_path, "signal_bucket_contributions", "events", events, schema)
    assert sum(r[2] for r in rows) == 5
