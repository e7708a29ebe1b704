import __spark_entry__


def test_entry_and_every_query_has_a_name(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_byte_format_shows_every_unit(spark):
    rows = __spark_entry__.queries()["byte_format"](spark, "/root/testdata/sf0.001").collect()
    assert {r.shown.split(" ")[1] for r in rows} == {"B", "KB", "MB", "GB", "TB"}
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.001/part.parquet").count()
