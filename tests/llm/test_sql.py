"""Training-data queries that have SQL give the same rows as DuckDB at the smallest scale."""

import os

import duckdb
import pytest

from glyphmill.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def plain(value):
    value = value.item() if hasattr(value, "item") else value
    return round(float(value), 6) if isinstance(value, (int, float)) and not isinstance(value, bool) else value


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    ours, theirs = QUERIES[name](spark, FOLDER).toPandas(), con.execute(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns) and len(ours)
    flat = lambda df: sorted(repr([plain(v) for v in row]) for row in df[sorted(df.columns)].astype(object).itertuples(index=False))
    assert flat(ours) == flat(theirs)


def test_short_items_match_sql(spark, tmp_path):
    docs = [(1, "one two three four five six seven"), (2, "three four"), (3, None), (4, "Two  THREE\tfour x y z"), (5, "")]
    items = [(1, "three four"), (2, "one two three"), (3, "Seven"), (4, None), (5, "two three four five six seven eight")]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    ours = {tuple(r) for r in QUERIES["op6_decontaminate"](spark, str(tmp_path)).select("doc_id", "item_id").collect()}
    assert ours == {(r[0], r[1]) for r in con.execute(SQL["op6_decontaminate"]).fetchall()} == {(1, 1), (1, 2), (1, 3), (2, 1), (4, 1)}
