"""Reading order and the text index: shuffled drawing order, columns, ranges across line ends."""

import random

from pyspark.sql import functions as F

from quire.operators import layout

SCHEMA = "doc_id long, page_index int, seq int, k int, ch string, x double, y double, width double, size double"


def glyphs(spark, lines, doc=1, shuffle=None):
    """lines: (x, y, text), characters 5 wide, size 10."""
    rows = [(doc, 0, x + 5.0 * k, float(y), c) for x, y, text in lines for k, c in enumerate(text)]
    if shuffle is not None:
        random.Random(shuffle).shuffle(rows)
    return spark.createDataFrame([(d, p, n, 0, c, x, y, 5.0, 10.0) for n, (d, p, x, y, c) in enumerate(rows)], SCHEMA)


def text(df):
    return {r.doc_id: r.text for r in layout.page_text(layout.text_index(layout.reading_order(df))).collect()}


COLUMNS = [(0, 700, "A title over both of the columns here"), (0, 680, "left one"), (100, 681, "right one"), (0, 660, "left two"), (100, 660, "right two"), (0, 640, "left end"), (100, 620, "right end"), (0, 600, "A foot line over both columns again")]
READ = "A title over both of the columns here\nleft one\nleft two\nleft end\nright one\nright two\nright end\nA foot line over both columns again"


def test_columns_in_any_drawing_order(spark):
    assert text(glyphs(spark, COLUMNS)) == {1: READ}
    assert text(glyphs(spark, COLUMNS, shuffle=1).unionByName(glyphs(spark, COLUMNS, 2, 2))) == {1: READ, 2: READ}


def test_a_slope_is_several_lines_and_jitter_is_one(spark):
    slope = [(20.0 * k, 700 - 4.0 * k, "x") for k in range(8)]
    df = layout.line_bands(glyphs(spark, slope, shuffle=3)).orderBy("x").collect()
    assert [r.line for r in df] == [0, 0, 1, 1, 2, 2, 3, 3]
    jitter = [(6.0 * k, 700 + (k % 3), "x") for k in range(9)]
    assert {r.line for r in layout.line_bands(glyphs(spark, jitter)).collect()} == {0}


def test_ranges_across_line_ends(spark):
    df = layout.text_index(layout.reading_order(glyphs(spark, [(0, 700, "hyphen-"), (0, 680, "ated  end"), (200, 300, "")], shuffle=4))).persist()
    whole = layout.page_text(df).first().text
    assert whole == "hyphen-\nated  end"
    rows = {r.ch: r for r in df.where("ch in ('y', 'd')").collect()}
    assert rows["y"].at == 1 and rows["d"].at == len(whole) - 1
    for r in df.collect():
        assert whole[r.at : r.after] == r.ch
    wanted = [(1, 0, 1, 2, 10), (1, 0, 2, 7, 8), (1, 0, 3, 5, 5), (1, 0, 4, 0, 99), (9, 0, 5, 0, 3)]
    ranges = spark.createDataFrame(wanted, "doc_id long, page_index int, id int, start int, stop int")
    got = sorted((r.id, r.line, r.chars, tuple(r.box)) for r in layout.range_boxes(ranges, df).collect())
    assert got == [
        (1, 0, "phen-", (10.0, 700.0, 35.0, 710.0)), (1, 1, "at", (0.0, 680.0, 10.0, 690.0)),
        (4, 0, "hyphen-", (0.0, 700.0, 35.0, 710.0)), (4, 1, "ated  end", (0.0, 680.0, 45.0, 690.0)),
    ]
    points = spark.createDataFrame([(1, 0, 6.0, 702.0), (1, 0, 500.0, 1.0), (3, 0, 0.0, 0.0)], "doc_id long, page_index int, px double, py double")
    assert sorted((r.px, r["at"]) for r in layout.char_at(points, df).collect()) == [(0.0, None), (6.0, 1), (500.0, None)]


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert layout.text_index(layout.reading_order(none)).count() == 0
    assert layout.page_text(layout.text_index(layout.reading_order(none))).count() == 0


def test_words_of_a_line_drawn_apart(spark):
    df = glyphs(spark, [(60, 700, "world"), (0, 680, "below"), (0, 700, "hello")])
    assert text(df) == {1: "hello world\nbelow"}  # one line's gap makes no columns
    near = glyphs(spark, [(30, 700, "world"), (0, 680, "below"), (0, 700, "hello")])
    assert text(near) == {1: "hello world\nbelow"}
    assert near.select(F.count(F.lit(1))).first()[0] == 15
