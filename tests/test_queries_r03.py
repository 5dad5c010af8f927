"""Queries against their SQL where given tables hold little of something."""

import duckdb
import pytest

from tocsin.queries import ORACLE_SQL, QUERIES, landed


def by_sql(name, tables):
    con = duckdb.connect()
    for t, path in tables.items():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'")
    return sorted(con.sql(ORACLE_SQL[name]).fetchall())


@pytest.mark.parametrize("rows", [[(2, "a"), (4, "b"), (9, "a"), (11, "b")], [(1, "a"), (8, "a"), (15, "b")], [(1, "a"), (3, "a")], []])
def test_seeds_are_counted_where_none_is_new(spark, tmp_path, rows):
    spark.createDataFrame(rows, "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    got = QUERIES["seeded_exercises"](spark, str(tmp_path))
    assert got.dtypes == [("origin", "string"), ("n", "bigint")]
    assert sorted(map(tuple, got.collect())) == by_sql("seeded_exercises", {"part": f"{tmp_path}/part.parquet"})


def test_a_large_feed_is_no_single_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(landed, "PAGE", 40)
    rows = [(k, f"Report of shelling near Kyiv, number {k}. It was long enough to be a sentence.", f"S{k % 2}") for k in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    feeds = landed._feeds(spark, landed._payload(spark, str(tmp_path)))
    assert spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xml").load(feeds).count() == 20
    for name in ("trusted_items", "trusted_counts", "regional_feeds"):
        got = QUERIES[name](spark, str(tmp_path))
        assert sorted(map(tuple, got.collect())) == by_sql(name, {"documents": f"{tmp_path}/documents.parquet"})
