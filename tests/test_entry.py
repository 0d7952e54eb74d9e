import __spark_entry__


def test_every_query_has_a_name_once_and_sql_only_for_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_flagship_query_runs(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["collection", "id", "commit_no", "op_index"] and df.limit(1).count() == 1
