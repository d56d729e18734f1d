"""Every registered query against its SQL twin on the smallest data."""

import pytest
from oracle import compare, duck

import __spark_entry__ as entry
from tomewright.catalog import registry

con = None


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, data, name):
    global con
    con = con or duck(data)
    ok, note = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), data)
    assert ok is not False, note


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.SQL)


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", ["token_stats", "block_parse", "html_text", "chunk_documents", "date_extract", "sentence_explode", "clean_lines"])
def test_tables_of_many_files_are_read_where_they_lie(spark, data, tmp_path, name):
    """The plan of large inputs, which have a split for every core, gives the same rows."""
    for t in ("documents", "pages", "conversations", "orders"):
        spark.read.parquet(f"{data}/{t}.parquet").repartition(24).write.parquet(f"{tmp_path}/{t}.parquet")
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")
    try:
        got = registry.QUERIES[name](spark, str(tmp_path))
        assert "REPARTITION_BY_NUM" not in got._jdf.queryExecution().toString()
        same = registry.QUERIES[name](spark, data)
        assert got.exceptAll(same).isEmpty() and same.exceptAll(got).isEmpty()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
