"""Tables that are dealt out to all cores, and such that aren't."""

from quire.sources import scan


def test_rows_are_the_same_whether_dealt_out_or_not(spark, sf_small, monkeypatch):
    path = f"{sf_small}/documents.parquet"
    dealt = scan.spread(spark, path)
    assert dealt.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(scan, "SPREAD_BYTES", 0)
    plain = scan.spread(spark, path)
    assert "Exchange" not in plain._jdf.queryExecution().executedPlan().toString()
    assert dealt.columns == plain.columns and dealt.exceptAll(plain).isEmpty() and plain.exceptAll(dealt).isEmpty()


def test_a_table_of_several_files_and_an_empty_one(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).repartition(3).write.parquet(path)
    assert scan.spread(spark, path).count() == 100
    empty = str(tmp_path / "e")
    spark.range(0).write.parquet(empty)
    assert scan.spread(spark, empty).count() == 0
