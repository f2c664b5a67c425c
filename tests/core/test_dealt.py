"""Rows that become documents are dealt out to all cores, and objects that many documents share are read once."""

import pytest

from made import build, documents
from quire import detail_queries, format_queries, object_queries, page_queries, queries  # noqa: F401
from quire.functions import charcodes
from quire.operators import images
from quire.sources import scan, syntax

DEALT = "metadata annotation_actions form_settings form_xobjects image_attributes image_rows code_spaces png_chunk_rows form_xobject_text".split()


@pytest.mark.parametrize("name", DEALT)
def test_rows_of_one_file_are_worked_on_by_all_cores(spark, sf_small, name):
    plan = queries.QUERIES[name](spark, sf_small)._jdf.queryExecution().analyzed().toString()
    assert f"Repartition {spark.sparkContext.defaultParallelism}, true" in plan


def test_tasks_get_a_bounded_share(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(20_000).coalesce(1).write.parquet(path)
    rows = scan.spread(spark, path, 10_000)
    assert rows.rdd.getNumPartitions() >= 8 and rows.count() == 20_000


TEXTS = [
    b"<< /A 1 >> endobj", b"<< /A (endobj) /B 2 >> endobj", b"<< /A 1 % endobj\n /B 2 >>\nendobj", b"7 endobj", b"7 0 R endobj", b"7 0 endobj", b"[1 2 R 3 0 R]endobj", b"(a(b)c) endobj 5", b"/Name#20x endobj",
    b"<< /A endobj", b"% only\n(x)endobj", b"<41 42> endobj", b"<< /K [1 << /L 2 >>] >>stream\nx endobj", b"(no end", b"true endobj", b"",
]


def test_remembered_objects_are_what_reading_gives():
    def of(f, text):
        try:
            return f(text, 1)
        except syntax.End:
            return "end"

    bodies = syntax.Bodies()
    for _ in range(2):
        for t in TEXTS:
            for after in (b"", b" 2 0 obj", b"x >> endobj"):
                assert of(bodies.read, b" " + t + after) == of(syntax.read, b" " + t + after), t
    bodies = syntax.Bodies()
    bodies.MOST = 60
    for t in TEXTS:
        of(bodies.read, b" " + t)
    assert bodies.held <= 60


def test_equal_texts_that_mean_other_arrays(spark):
    base = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", 3: b"<< /Type /Page /Parent 2 0 R /MediaBox 4 0 R >>"}
    contents = [build(base | {4: b"[0 0 10 %d]" % k}) for k in (20, 30, 20)] + [build(base | {4: b"(none)"})]
    got = sorted((r.doc_id, r.height) for r in documents(spark, *contents).pages.collect())
    assert got == [(0, 20.0), (1, 30.0), (2, 20.0), (3, 792.0)]


def test_patterns_of_codes_are_made_once_a_string(spark):
    spaces = charcodes.code_spaces(charcodes.F.col("s"))
    df = spark.createDataFrame([("begincodespacerange <40> <7F> <8130> <8439> endcodespacerange", bytearray(b"A\x81\x35\x81z\x00"))], "s string, t binary")
    found = df.select(charcodes.codes(charcodes.F.col("t"), charcodes.scheme_of(spaces), spaces=spaces).alias("c"))
    assert found.first().c == [65, 0x8135, 0, 0]
    assert "RLIKE" not in found._jdf.queryExecution().optimizedPlan().toString().upper()


def test_palettes_of_one_row_an_image(spark):
    samples = spark.createDataFrame([(1, 0, 0, 1), (1, 1, 0, 9), (1, 2, 0, -3), (2, 0, 0, 0), (3, 0, 0, 0), (4, 0, 0, None)], "img_id long, x int, y int, v int")
    colors = {1: bytes([1, 2, 3, 250, 251, 252]), 3: b"", 4: bytes([7, 8, 9])}
    one_row = spark.createDataFrame([(k, bytearray(v)) for k, v in colors.items()], "img_id long, lookup binary")
    rows = spark.createDataFrame([(k, n // 3, n % 3, b) for k, v in colors.items() for n, b in enumerate(v)], "img_id long, entry int, c int, level int")
    got = images.palette_indexed(samples, one_row, 3)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, images.palette_mapped(samples, rows).collect()))


def test_a_palette_isn_t_taken_apart_before_the_join(spark, sf_small):
    plan = format_queries.palette_samples(spark, sf_small)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan and plan.index("inline") < plan.index("Join")


def test_written_tables_are_not_broadcast(spark):
    from quire.sources import walk

    table = walk.written(spark.range(10).toDF("k"), walk.scratch(spark))
    both = walk.levels(table.where("k = 0"), lambda level: level.where("k > 0"))
    for some in (table, both):
        plan = spark.range(10).toDF("k").join(some.where("k >= 0").select("k"), "k")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_overlaps_in_flat_cells(spark):
    import random

    from quire.operators import lookup

    r, near = random.Random(5), [2.0, 2.0000000000000004, 1.9999999999999998, 4.0, 0.0, -2.0, 6.0]
    boxes = [(k, (x, y, x + r.choice([0.0, 2.0, 200.0, 5.0]), y + r.choice([0.0, 2.0, 1e-9]))) for k in range(80) for x, y in [(r.choice([*near, r.uniform(-400, 400)]), r.choice(near))]]
    kind = "struct<left:double,top:double,right:double,bottom:double>"
    a, b = (spark.createDataFrame(boxes, f"{i} long, {n} {kind}") for i, n in (("i", "l"), ("j", "r")))
    got = sorted((x.i, x.j) for x in lookup.overlap_join(a, b, 200.0, 2.0).collect())
    assert got == sorted((i, j) for i, p in boxes for j, q in boxes if p[0] < q[2] and q[0] < p[2] and p[1] < q[3] and q[1] < p[3])


def test_keys_of_equal_encryption_are_found_once():
    from quire.operators import crypto

    owner, ident = crypto.owner_value(b"boss", b"guest", 3, 16), b"\x03" * 16
    user = crypto.user_value(crypto.file_key(b"guest", owner, -44, ident, 3, 16), ident, 3)
    entries = {"Filter": "Standard", "V": 2, "R": 3, "Length": 128, "P": -44, "O": owner, "U": user}
    before = crypto._opened.cache_info().hits
    assert crypto.security(entries, ident, b"boss") == crypto.security(dict(entries), ident, b"boss") == ("rc4", crypto.file_key(b"guest", owner, -44, ident, 3, 16))
    assert crypto._opened.cache_info().hits == before + 1
    with pytest.raises(ValueError):
        crypto.security(entries, ident, b"bos")
    with pytest.raises(ValueError):
        crypto.security(entries, b"\x04" * 16, b"boss")
