"""Streams that stop and go on: keyed state, results of all modes."""

from pyspark.sql import functions as F

from quire.operators import lookup
from quire.sources import pdf
from quire.streaming import windows


def arrived(spark, folder, names):
    """Files ``document-revision.pdf`` whose content names both."""
    for doc, revision in names:
        text = spark.range(1).select(pdf.from_text(F.lit(f"{doc} r{revision}")).alias("c")).first().c
        (folder / f"{doc}-{revision}.pdf").write_bytes(bytes(text))


def test_newest_revision_of_arriving_documents(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    batches = [[("a", 2), ("b", 1), ("c", 1)], [("a", 1), ("b", 3), ("d", 1)], [("b", 2), ("a", 7), ("a", 5), ("e", 0)]]
    name = F.regexp_extract("path", r"([^/]+)-(\d+)\.pdf$", 1)
    seen = []
    for k, batch in enumerate(batches):
        arrived(spark, folder, batch)
        stream = windows.arriving_files(spark, f"file://{folder}", "*.pdf").select(name.alias("doc"), F.regexp_extract("path", r"([^/]+)-(\d+)\.pdf$", 2).cast("long").alias("revision"), "content")
        changes = windows.drain(windows.newer_only(stream, "doc", "revision"), f"file://{tmp_path}/state")  # a new query each time, with the old one's state
        seen += batch
        got = {(r.doc, r.revision) for r in lookup.latest(changes, ["doc"], ["revision"]).collect()}
        assert got == {(d, max(n for e, n in seen if e == d)) for d, _ in seen}, k
    log = sorted((r.doc, r.revision) for r in changes.collect())
    assert log == [("a", 2), ("a", 7), ("b", 1), ("b", 3), ("c", 1), ("d", 1), ("e", 0)]  # what came late gave nothing
    text = changes.where("doc = 'a' AND revision = 7").select(F.decode(F.col("content"), "ISO-8859-1").alias("t")).first().t
    assert "(a r7) Tj" in text


def test_null_orders_and_forgotten_keys(spark, tmp_path):
    schema, log = "k string, n long, t timestamp", []
    days = [[("a", None, 1), ("b", 1, 1), ("b", 1, 1), ("c", None, 1), ("d", 9, 1)], [("e", 1, 100)], [("b", 1, 101), ("d", 2, 102), ("e", 0, 102)]]
    for batch in days:
        made = spark.createDataFrame([(k, n, d) for k, n, d in batch], "k string, n long, d int").select("k", "n", F.timestamp_seconds(F.col("d") * 86_400).alias("t"))
        made.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = windows.arriving(spark, f"file://{tmp_path}/in", spark.createDataFrame([], schema).schema)
        log = windows.drain(windows.newer_only(stream, "k", "n", "t", "30 days"), f"file://{tmp_path}/state")
    assert sorted((r.k, r.n) for r in log.collect()) == [("b", 1), ("b", 1), ("d", 2), ("d", 9), ("e", 1)]  # b and d were forgotten after 30 days, e wasn't


def test_complete_mode_goes_on_after_a_restart(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"2024-01-0{1 + k % 3} 00:00:00", float(k)) for k in range(30)], "user long, t string, value double").withColumn("ts", F.col("t").cast("timestamp")).drop("t")
    rows.write.parquet(f"file://{tmp_path}/in")
    stream = windows.arriving(spark, f"file://{tmp_path}/in", rows.schema)
    counts = lambda: windows.drain(windows.windowed(stream, "ts", "1 day", []), f"file://{tmp_path}/s", "complete").agg(F.sum("n")).first()[0]
    assert counts() == 30
    assert counts() == 30  # nothing new
    rows.limit(5).write.mode("append").parquet(f"file://{tmp_path}/in")
    assert counts() == 35
