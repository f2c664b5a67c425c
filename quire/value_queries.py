"""Queries of value expressions, writers, pixel tables and streams on the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import codecs, fonts, writing
from .functions import color as C
from .functions import geometry as G
from .functions import text as T
from .operators import crypto, forms, lookup, objects, raster
from .operators import text as search
from .queries import _t, query
from .sources import pdf
from .sources.walk import scratch
from .streaming import windows


def _parts(spark, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("n"), "p_name", "p_brand", "p_type", F.col("p_retailprice").alias("price"))


def _rounded(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits) + F.lit(0.0)


# --- geometry


@query(
    """SELECT p_partkey AS k, round(sqrt((p_size - 3) ** 2 + (p_partkey % 7 - 4) ** 2), 6) AS distance, (p_size * 3 + (p_partkey % 7) * 4)::DOUBLE AS dot, (p_size * 4 - (p_partkey % 7) * 3)::DOUBLE AS "cross",
       round(p_size + (3 - p_size) * 0.25, 6)::DOUBLE AS lerp_x, round(p_size / sqrt(p_size ** 2 + (p_partkey % 7) ** 2), 6) AS unit_x,
       round(abs((p_size * 0 - (p_partkey % 7) * 10) / 10.0), 6) AS from_axis, round(abs(p_size * 4 - (p_partkey % 7) * 3) / 2.0, 6) AS area FROM part"""
)
def vector_algebra(spark, sf_dir):
    p, q = G.point(F.col("n"), F.col("k") % 7), G.point(3, 4)
    return _parts(spark, sf_dir).select(
        "k", _rounded(G.distance(p, q)).alias("distance"), G.dot(p, q).alias("dot"), G.cross(p, q).alias("cross"), _rounded(G.lerp(p, q, 0.25)["x"]).alias("lerp_x"), _rounded(G.unit(p)["x"]).alias("unit_x"),
        _rounded(F.abs(G.point_line_distance(0, 0, 10, 0, p["x"], p["y"]))).alias("from_axis"), _rounded(F.abs(G.triangle_area(0, 0, p["x"], p["y"], 3, 4))).alias("area"),
    )


@query(
    """SELECT p_partkey AS k, p_size::DOUBLE AS width, 7.0::DOUBLE AS height, 10 + p_size / 2.0 AS center_x, least(10, 10 - p_size + 1)::DOUBLE AS low, p_size >= 20 AS holds, 8.0::DOUBLE AS grown, 13.0::DOUBLE AS moved,
       floor(10.5)::BIGINT AS whole_left, ceil(10.5 + p_size)::BIGINT AS whole_right, (10 + p_size)::DOUBLE AS corner FROM part"""
)
def rect_algebra(spark, sf_dir):
    r = G.rect_from_size(10, 20, F.col("n"), 7)
    return _parts(spark, sf_dir).select(
        "k", G.width(r).alias("width"), G.height(r).alias("height"), G.center(r)["x"].alias("center_x"), G.normalized(G.rect(10, 0, 11 - F.col("n"), 1))["left"].alias("low"),
        G.contains_rect(r, G.rect_from_size(10, 20, 20, 5)).alias("holds"), G.inflated(r, 2, 0)["left"].alias("grown"), G.shifted(r, 3, 0)["left"].alias("moved"),
        G.outward(G.shifted(r, 0.5, 0))["left"].alias("whole_left"), G.outward(G.shifted(r, 0.5, 0))["right"].alias("whole_right"), G.quad(r)[1]["x"].alias("corner"),
    )


@query(
    """SELECT p_partkey AS k, round(2.0 * cos(radians(p_size)), 6) AS a, round(2.0 * p_size, 6)::DOUBLE AS vx, 2.0::DOUBLE AS x_unit, round(radians(p_size), 6) AS angle,
       round(p_size * tan(radians(45)), 6)::DOUBLE AS skewed, round(5.0 + p_size, 6)::DOUBLE AS box_right FROM part"""
)
def matrix_decomposition(spark, sf_dir):
    n = F.col("n")
    turned = G.multiply(G.scaling(2, 2), G.rotation(n))
    return _parts(spark, sf_dir).select(
        "k", _rounded(turned["a"]).alias("a"), _rounded(G.transform_vector(G.scaling(2, 3), n, 1)["x"]).alias("vx"), _rounded(G.decomposed(turned)["x_unit"]).alias("x_unit"),
        _rounded(G.decomposed(turned)["rotation"]).alias("angle"), _rounded(G.transform_vector(G.skewing(0, 45), n, 0)["y"]).alias("skewed"),
        _rounded(G.transform_rect(G.multiply(G.scaling(n, 4), G.translation(5, 6)), G.rect(0, 0, 1, 1))["right"]).alias("box_right"),
    )


# --- colour


@query(
    """SELECT p_partkey AS k, p_size % 256 AS red, round(-1 + p_size / 50.0 * 2, 6) AS decoded, CASE p_size % 3 WHEN 0 THEN 'DeviceGray' WHEN 1 THEN 'DeviceRGB' ELSE 'DeviceCMYK' END AS space,
       CASE p_size % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 4 END AS components, CASE p_size % 3 WHEN 0 THEN 'DeviceRGB' ELSE 'Lab' END AS alternate, 0 AS pattern, 255 - p_size AS inverse FROM part"""
)
def color_spaces(spark, sf_dir):
    n = F.col("n")
    name = F.when(n % 3 == 0, "G").when(n % 3 == 1, "DeviceRGB").otherwise("CMYK")
    found = C.space_of(name)
    return _parts(spark, sf_dir).select(
        "k", C.cal_rgb_to_rgb(n / 255, 0.0, 0.0)["r"].alias("red"), _rounded(C.decoded(n / 50, -1, 1)).alias("decoded"), found["space"].alias("space"), found["components"].alias("components"),
        C.icc_alternate(F.when(n % 3 != 0, "Lab"), F.lit(3)).alias("alternate"), C.pattern_to_rgb(F.lit(None).cast("struct<r:int,g:int,b:int>"))["r"].alias("pattern"),
        C.icc_to_rgb(F.array(F.lit(1.0) - n / 255), F.lit(1))["g"].alias("inverse"),
    )


@query(
    """WITH p AS (SELECT p_partkey AS k, p_size::BIGINT AS n, (100 + p_size)::BIGINT AS a FROM part)
       SELECT k, (a * 16777216 + (200 * a + 127) // 255 * 65536 + (n * a + 127) // 255 * 256)::BIGINT AS premultiplied, least(n * 255 // a, 255)::INT AS straight,
       floor(n + (200 - n) * 0.25 + 0.5)::INT AS mixed, round(n * 200 / 255.0)::INT AS product, (n * 255 // 1023)::INT AS wide, (n // 4)::INT AS narrow FROM p"""
)
def color_arithmetic(spark, sf_dir):
    n = F.col("n")
    a = n + 100
    back = C.demultiplied(C.argb(a, n, 0, 0))
    return _parts(spark, sf_dir).select(
        "k", C.premultiplied(C.argb(a, 200, n, 0)).alias("premultiplied"), C.channel(back, "r").alias("straight"), C.channel(C.gradient(C.argb(0, n, 0, 0), C.argb(0, 200, 0, 0), 0.25), "r").alias("mixed"),
        C.multiplied_bytes(n, F.lit(200)).alias("product"), F.floor(n * 255 / 1023).cast("int").alias("wide"), C.to_byte(n, 10).alias("narrow"),
    )


@query(
    """WITH p AS (SELECT p_partkey AS k, p_size AS n FROM part), c AS (SELECT k, n, 100 + 1.402 * (n - 128) AS r, 100 - 0.344 * (n - 128) - 0.714 * (n - 128) AS g FROM p)
       SELECT k, greatest(least(trunc(r), 255), 0)::INT AS red, greatest(least(trunc(g), 255), 0)::INT AS green, n AS gray FROM c"""
)
def wide_color_to_rgb(spark, sf_dir):
    n = F.col("n")
    made = C.sycc_to_rgb(F.lit(100), n, n)
    return _parts(spark, sf_dir).select("k", made["r"].alias("red"), made["g"].alias("green"), C.ycck_to_rgb(n, F.lit(128), F.lit(128), F.lit(255))["r"].alias("gray"))


@query("SELECT p_partkey AS k, CASE WHEN length(p_name) % 3 = 0 THEN hex(p_name) ELSE NULL END AS twice, upper(hex(substr(p_name, 3, 1) || substr(p_name, 2, 1) || substr(p_name, 1, 1))) AS first FROM part")
def swapped_bytes(spark, sf_dir):
    data = F.encode("p_name", "utf-8")
    once = codecs.swapped_rgb(data)
    return _parts(spark, sf_dir).select("k", F.when(F.length("p_name") % 3 == 0, F.hex(codecs.swapped_rgb(once))).alias("twice"), F.hex(F.substring(once, 1, 3)).alias("first"))


# --- formats


@query(
    """WITH p AS (SELECT p_partkey AS k, substr('IHDR' || 'tEXt' || 'gAMA' || 'prVt', 1 + 4 * (p_partkey % 4)::INT, 4) AS t, 192 + p_partkey % 64 AS m FROM part)
       SELECT k, ascii(substr(t, 1, 1)) & 32 = 0 AS critical, ascii(substr(t, 2, 1)) & 32 = 0 AS public, ascii(substr(t, 4, 1)) & 32 <> 0 AS safe_to_copy,
       CASE WHEN m BETWEEN 192 AND 207 AND m NOT IN (196, 200, 204) THEN 'SOF' WHEN m BETWEEN 208 AND 215 THEN 'RST' WHEN m BETWEEN 224 AND 239 THEN 'APP' END AS marker FROM p"""
)
def chunk_and_marker_bits(spark, sf_dir):
    kind = F.substring(F.lit("IHDRtEXtgAMAprVt"), (1 + 4 * (F.col("k") % 4)).cast("int"), F.lit(4))
    bits = codecs.chunk_bits(kind)
    return _parts(spark, sf_dir).select("k", bits["critical"].alias("critical"), bits["public"].alias("public"), bits["safe_to_copy"].alias("safe_to_copy"), codecs.marker_class((192 + F.col("k") % 64).cast("int")).alias("marker"))


@query(
    """SELECT p_partkey AS k, pass::INT AS pass, greatest(ceil((p_size - x) / dx::DOUBLE), 0)::BIGINT AS columns, greatest(ceil((p_size // 2 - y) / dy::DOUBLE), 0)::BIGINT AS "rows"
       FROM part, (VALUES (0, 0, 0, 8, 8), (1, 4, 0, 8, 8), (2, 0, 4, 4, 8), (3, 2, 0, 4, 4), (4, 0, 2, 2, 4), (5, 1, 0, 2, 2), (6, 0, 1, 1, 2)) AS v(pass, x, y, dx, dy)"""
)
def interlace_passes(spark, sf_dir):
    return _parts(spark, sf_dir).select("k", F.explode(codecs.adam7(F.col("n"), F.floor(F.col("n") / 2))).alias("p")).select("k", "p.*")


@query(
    """WITH p AS (SELECT p_partkey AS k, (p_partkey * 37 % 31744)::BIGINT AS b FROM part)
       SELECT k, round(CASE WHEN b >> 10 = 0 THEN (b & 1023) * 2.0 ** -24 ELSE (1 + (b & 1023) / 1024.0) * 2.0 ** ((b >> 10) - 15) END, 9) AS value, floor(sqrt(b))::BIGINT AS root,
       round(b - floor(b / 6.283185307179586) * 6.283185307179586, 6) AS angle FROM p"""
)
def half_floats_and_roots(spark, sf_dir):
    b = F.col("k") * 37 % 31744
    return _parts(spark, sf_dir).select("k", _rounded(codecs.half_float(b), 9).alias("value"), codecs.integer_root(b).alias("root"), _rounded(codecs.normalized_angle(b.cast("double"))).alias("angle"))


@query(
    """SELECT l_orderkey, l_linenumber, c::INT AS c, c BETWEEN 1 AND 14 AS vertex, c BETWEEN 2 AND 14 AS drawing, c IN (3, 4) AS curve, c & 15 = 15 AS ends, c & ~48 = 79 AS closes, c = 0 OR c = 1 OR c & 15 = 15 AS next,
       CASE WHEN c & 32 <> 0 THEN 'cw' WHEN c & 16 <> 0 THEN 'ccw' ELSE 'none' END AS orientation, (c & ~48)::INT AS bare, c & 8 <> 0 AS gray FROM (SELECT *, (l_partkey * 7 + l_linenumber) % 128 AS c FROM lineitem)"""
)
def path_commands(spark, sf_dir):
    c = F.col("c")
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ((F.col("l_partkey") * 7 + F.col("l_linenumber")) % 128).cast("int").alias("c"))
    return rows.select(
        "l_orderkey", "l_linenumber", "c", codecs.is_vertex(c).alias("vertex"), codecs.is_drawing(c).alias("drawing"), codecs.is_curve(c).alias("curve"), codecs.is_end_poly(c).alias("ends"), codecs.is_close(c).alias("closes"),
        codecs.is_next_poly(c).alias("next"), codecs.orientation(c).alias("orientation"), codecs.without_orientation(c).alias("bare"), codecs.has_flag(c, "grayscale").alias("gray"),
    )


@query(
    """WITH t AS (SELECT p_partkey AS k, p_partkey % 5 AS o, l, r, c, p FROM part, range(2) AS a(l), range(3) AS b(r), range(2) AS d(c), range(2) AS e(p))
       SELECT k, row_number() OVER (PARTITION BY k ORDER BY CASE o WHEN 0 THEN l WHEN 1 THEN r WHEN 2 THEN r WHEN 3 THEN p ELSE c END, CASE o WHEN 0 THEN r WHEN 1 THEN l WHEN 2 THEN p WHEN 3 THEN c ELSE p END,
       CASE o WHEN 0 THEN c WHEN 1 THEN c WHEN 2 THEN c WHEN 3 THEN r ELSE r END, CASE o WHEN 0 THEN p WHEN 1 THEN p ELSE l END)::INT - 1 AS seq, l::INT AS layer, r::INT AS resolution, c::INT AS component, p::INT AS precinct FROM t"""
)
def packet_order(spark, sf_dir):
    tiles = _parts(spark, sf_dir).select("k", (F.col("k") % 5).alias("progression"), F.lit(2).alias("layers"), F.lit(3).alias("resolutions"), F.lit(2).alias("components"), F.lit(2).alias("precincts"))
    return codecs.packets(tiles, ["k"])


@query(
    """WITH p AS (SELECT p_partkey AS k, p_size + 20 AS w, ceil((p_size + 20) / 16.0)::BIGINT AS nx FROM part), t AS (SELECT k, w, nx, tile FROM p, range(10) AS r(tile) WHERE tile < nx * 2)
       SELECT k, tile::INT AS tile, (tile % nx * 16)::BIGINT AS x0, (tile // nx * 16)::BIGINT AS y0, least((tile % nx + 1) * 16, w)::BIGINT AS x1, least((tile // nx + 1) * 16, 30)::BIGINT AS y1,
       (ceil(least((tile % nx + 1) * 16, w) / 4.0) - ceil(tile % nx * 16 / 4.0))::BIGINT AS smallest FROM t"""
)
def tile_layout(spark, sf_dir):
    tiles = codecs.tile_rects(_parts(spark, sf_dir).select("k", (F.col("n") + 20).alias("w")), F.col("w"), F.lit(30), F.lit(16), F.lit(16))
    return tiles.select("k", "tile", "x0", "y0", "x1", "y1", codecs.resolution_sizes(F.col("x0"), F.col("x1"), 2)[0].alias("smallest"))


@query("SELECT p_partkey AS k, y::INT AS y, substr(p_type, (y * 5 + 1)::INT, 5) AS line FROM part, range(20) AS r(y) WHERE y * 5 < length(p_type)")
def scanline_rows(spark, sf_dir):
    data = _parts(spark, sf_dir).select("k", F.encode("p_type", "utf-8").alias("data"))
    return codecs.scanlines(data, F.lit(5)).select("k", "y", F.decode("line", "utf-8").alias("line"))


@query("SELECT l_orderkey AS k, (2 * l_linenumber + j)::INT AS x, i::INT AS y, max(l_quantity)::INT AS v FROM lineitem, range(2) AS a(j), range(2) AS b(i) GROUP BY ALL")
def chroma_upsampling(spark, sf_dir):
    samples = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("x")).agg(F.max("l_quantity").cast("int").alias("v")).withColumn("y", F.lit(0))
    return codecs.upsampled(samples, ["k"], 2, 2)


# --- fonts


@query(
    """WITH p AS (SELECT p_partkey AS k, p_size AS n FROM part)
       SELECT k, round(n * 640 / 1000.0)::BIGINT AS scaled, round(n * 1000 / 640.0)::BIGINT AS unscaled, (n * 1000 // 2048)::BIGINT AS ascent, n + 20 + 5 AS height, (CASE WHEN (k % 256) < 128 THEN k % 256 ELSE k % 256 - 256 END) / 127.0 AS factor,
       CASE k % 5 WHEN 0 THEN 'MS Gothic' WHEN 1 THEN 'SimSun' WHEN 2 THEN 'Arial' WHEN 3 THEN 'Tahoma' ELSE 'Helvetica' END AS font, (k % 5)::INT AS ordering,
       n & 2 <> 0 AS bold, n & 4 <> 0 AS fixed FROM p"""
)
def font_metrics(spark, sf_dir):
    n, k = F.col("n"), F.col("k")
    charset = F.when(k % 5 == 0, 128).when(k % 5 == 1, 134).when(k % 5 == 2, 204).when(k % 5 == 3, 222).otherwise(0)
    ordering = F.get(F.array(*map(F.lit, ("none", "(GB1)", "CNS1", "Japan1", "Korea1"))), (k % 5).cast("int"))
    return _parts(spark, sf_dir).select(
        "k", fonts.scaled(n, F.lit(640), F.lit(1000)).alias("scaled"), fonts.unscaled(n, F.lit(640), F.lit(1000)).alias("unscaled"), fonts.per_mille(n, F.lit(2048)).alias("ascent"),
        fonts.extents(n, F.lit(-20), F.lit(5))["height"].alias("height"), fonts.cid_transform(k % 256).alias("factor"), fonts.default_font(charset).alias("font"), fonts.charset_of(ordering).alias("ordering"),
        fonts.has_flag(n, "bold", fonts.STYLE_FLAGS).alias("bold"), fonts.has_flag(n, "fixed_width").alias("fixed"),
    )


@query(
    """SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'Latn' WHEN 1 THEN 'Grek' WHEN 2 THEN 'Hebr' END AS script, CASE p_partkey % 4 WHEN 2 THEN 'rtl' ELSE 'ltr' END AS direction,
       CASE p_partkey % 4 WHEN 0 THEN 'kern' WHEN 1 THEN 'liga' WHEN 2 THEN 'ss01' END AS tag, CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN p_size END::INT AS value, (p_size + 0.5)::DOUBLE AS weight FROM part"""
)
def scripts_and_features(spark, sf_dir):
    k, n = F.col("k"), F.col("n").cast("string")
    text = F.when(k % 4 == 0, F.concat(F.lit("12 "), "p_name")).when(k % 4 == 1, "- αb").when(k % 4 == 2, "א a").otherwise("12 !")
    feature = fonts.feature(F.when(k % 4 == 0, "kern").when(k % 4 == 1, "-liga").when(k % 4 == 2, F.concat(F.lit("ss01="), n)).otherwise("no feature"))
    script = fonts.guessed_script(text)
    return _parts(spark, sf_dir).select(
        "k", script.alias("script"), fonts.direction(script).alias("direction"), feature["tag"].alias("tag"), feature["value"].alias("value"), fonts.variation(F.concat(F.lit("wght="), n, F.lit(".5")))["value"].alias("weight")
    )


def _glyphs(spark, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("place")).agg(F.max("l_partkey").cast("int").alias("glyph"), F.max("l_quantity").cast("int").alias("advance"))
    return rows.select("k", "place", "glyph", F.floor(F.col("place") / 2).cast("int").alias("cluster"), (F.col("place") % 3).alias("x"), F.lit(0).alias("y"), "advance")


@query("SELECT l_orderkey AS k, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber))::INT - 1 AS place, max(l_partkey)::INT AS glyph, l_linenumber // 2 AS cluster, l_linenumber % 3 AS x, max(l_quantity)::INT AS advance FROM lineitem GROUP BY l_orderkey, l_linenumber")
def buffer_roundtrip(spark, sf_dir):
    written = fonts.serialized(_glyphs(spark, sf_dir), ["k"], "place")
    return fonts.deserialized(written, ["k"]).select("k", "place", "glyph", "cluster", "x", "advance")


@query(
    """WITH g AS (SELECT l_orderkey AS k, l_linenumber AS place, l_linenumber // 2 AS cluster FROM lineitem GROUP BY ALL), m AS (SELECT *, dense_rank() OVER (PARTITION BY k ORDER BY cluster) - 1 AS run FROM g)
       SELECT k, place, run::BIGINT AS island, row_number() OVER (PARTITION BY k ORDER BY cluster, place)::INT - 1 AS stable FROM m"""
)
def glyph_clusters(spark, sf_dir):
    marked = fonts.by_cluster(fonts.clusters(_glyphs(spark, sf_dir), ["k"], "place").withColumnRenamed("place", "at"), ["k"], "at")
    return marked.select("k", F.col("at").alias("place"), "island", F.col("place").alias("stable"))


@query("SELECT p_partkey AS k, c::INT - 1 AS cluster, unicode(substr(p_name, c::INT, 1)) AS code FROM part, range(1, 60) AS r(c) WHERE c <= length(p_name)")
def text_code_points(spark, sf_dir):
    return fonts.code_points(_parts(spark, sf_dir), "p_name").select("k", "cluster", "code")


# --- writers


@query(
    """SELECT p_partkey AS k, p_type AS name, p_name AS string, p_size::BIGINT AS number, round(p_retailprice, 5) AS price, p_size % 2 = 0 AS flag, 4 AS ref, 1.5::DOUBLE AS corner, p_brand AS item, NULL::VARCHAR AS gone
       FROM part"""
)
def object_writers(spark, sf_dir):
    start = F.map_from_arrays(F.array(F.lit("Gone"), F.lit("Name")), F.array(F.lit("(x)"), F.lit("null")))
    d = start
    for key, kind, value in (
        ("Name", "name", F.col("p_type")), ("String", "string", F.col("p_name")), ("Number", "int", F.col("n")), ("Price", "number", F.col("price")), ("Flag", "bool", F.col("n") % 2 == 0),
        ("Ref", "reference", F.lit(4)), ("Rect", "numbers", F.array(F.lit(1.5), F.lit(2.0), F.lit(3.0), F.lit(4.0))),
    ):
        d = writing.set_typed(d, key, kind, value)
    items = writing.inserted(writing.removed_at(F.array(F.lit("1"), F.lit("2"), F.lit("3")), 0), 1, T.string_object(F.col("p_brand")))
    d = writing.without_entry(writing.with_entry(d, "List", writing.array_text(items)), "Gone")
    docs = _parts(spark, sf_dir).select(F.col("k").alias("doc_id"), pdf.assembled([F.lit("<< /Type /Catalog >>"), writing.dictionary_text(d)]).alias("content"))
    found = objects.attributes(
        pdf.nodes(docs).where("obj_num = 2"),
        {
            "name": ("name", "Name"), "string": ("text", "String"), "number": ("int", "Number"), "price": ("num", "Price"), "flag": ("bool", "Flag"), "ref": ("ref", "Ref"), "rect": ("nums", "Rect"),
            "items": ("texts", "List"), "gone": ("text", "Gone"),
        },
    )
    return found.select(F.col("doc_id").alias("k"), "name", "string", "number", F.round("price", 5).alias("price"), "flag", "ref", F.col("rect")[0].alias("corner"), F.col("items")[0].alias("item"), "gone")


@query("SELECT p_partkey AS doc_id, o::INT AS obj_num, (CASE WHEN o IN (0, 4) THEN 0 ELSE 1 END)::INT AS type, CASE o WHEN 3 THEN p_name END AS text FROM part, range(6) AS r(o)")
def revised_objects(spark, sf_dir):
    """Two objects replaced and one deleted by one incremental update."""
    first = pdf.from_text(F.lit("old"))
    docs = _parts(spark, sf_dir).select(F.col("k").alias("doc_id"), "p_name", first.alias("content"))
    changes = {3: F.concat(F.lit("<< /Note "), T.string_object(F.col("p_name")), F.lit(" >>")), 4: None, 5: F.lit("<< /Type /Font >>")}
    docs = docs.select("doc_id", pdf.updated(F.col("content"), pdf.start_of_xref(F.col("content")), changes).alias("content"))
    notes = objects.attributes(pdf.nodes(docs), {"text": ("text", "Note")})
    return pdf.latest(pdf.xref(docs)).select("doc_id", "obj_num", "type").join(notes, ["doc_id", "obj_num"], "left")


@query("SELECT p_partkey AS doc_id, p_name AS text, p_brand AS title FROM part")
def encrypted_roundtrip(spark, sf_dir):
    """Documents written with the standard security handler (RC4, revision 3, an empty user password) and read again."""
    stream = F.encode(F.concat(F.lit("BT /F1 12 Tf "), T.string_object(F.col("p_name")), F.lit(" Tj ET")), "ISO-8859-1")
    owner, ident, permissions = bytes(range(32)), b"\x01" * 16, -44
    key = crypto.file_key(b"", owner, permissions, ident, 3, 16)
    user = crypto.user_value(key, ident, 3)
    locked = lambda data, n: crypto.rc4(T.object_key(F.lit(key), F.lit(n), F.lit(0)), data)
    title = F.hex(locked(F.encode("p_brand", "ISO-8859-1"), 6))
    bodies = [
        F.lit("<< /Type /Catalog /Pages 2 0 R >>"), F.lit("<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 9 9] >>"), F.lit("<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>"),
        pdf.stream_body(locked(stream, 4)), F.lit(f"<< /Filter /Standard /V 2 /R 3 /Length 128 /P {permissions} /O <{owner.hex()}> /U <{user.hex()}> >>"), F.concat(F.lit("<< /Title <"), title, F.lit("> >>")),
    ]
    docs = _parts(spark, sf_dir).select(F.col("k").alias("doc_id"), pdf.assembled(bodies, f" /Info 6 0 R /Encrypt 5 0 R /ID [<{ident.hex()}> <{ident.hex()}>]").alias("content"))
    from .plans.extract import Documents

    d = Documents(docs)
    return d.text.select("doc_id", "text").join(pdf.metadata(d.nodes).select("doc_id", F.col("value").alias("title")), "doc_id")


@query("SELECT p_partkey AS k, p_size & 4 <> 0 AS print, p_size & 8 <> 0 AS modify, p_size & 16 <> 0 AS copy, p_size & 5 = 5 AS both FROM part")
def permission_bits(spark, sf_dir):
    n = F.col("n")
    marks = [forms.has_flag(n, x, forms.PERMISSIONS).alias(x) for x in ("print", "modify", "copy")]
    return _parts(spark, sf_dir).select("k", *marks, T.has_bits(n, 5).alias("both"))


# --- pixels and characters


def _pixels(spark, sf_dir: str, color) -> DataFrame:
    made = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("img_id"), F.lit(4).alias("w"), F.lit(4).alias("h"))
    return raster.blank(made, "w", "h").withColumn("argb", color)


@query(
    """SELECT n_nationkey::BIGINT AS img_id, x::INT AS x, y::INT AS y, CASE WHEN x BETWEEN 1 AND 2 AND y BETWEEN 2 AND 3 THEN 4278190080 + (x - 1 + 1) ELSE 4294967295 END::BIGINT AS copied,
       CASE WHEN x >= 2 THEN 4278190080 + (x - 2) ELSE 4294967295 END::BIGINT AS blitted, (4278190080 + x)::BIGINT AS layered FROM nation, range(4) AS a(x), range(4) AS b(y)"""
)
def pixel_copy_blit_composite(spark, sf_dir):
    white, marked = _pixels(spark, sf_dir, F.lit(0xFFFFFFFF)), _pixels(spark, sf_dir, F.lit(0xFF000000) + F.col("x"))
    copied = raster.copied(white, marked, 1, 2, (1, 0, 3, 2)).withColumnRenamed("argb", "copied")
    blitted = raster.blit(white, marked, 2, 0).withColumnRenamed("argb", "blitted")
    layers = white.withColumn("z", F.lit(0)).unionByName(marked.withColumn("z", F.lit(1)))
    layered = raster.composite(layers).withColumnRenamed("argb", "layered")
    return copied.join(blitted, ["img_id", "x", "y"]).join(layered, ["img_id", "x", "y"])


@query(
    """WITH c AS (SELECT l_suppkey AS img_id, (l_partkey % 8)::INT AS y, l_linenumber AS x, (l_quantity::BIGINT % 7) - 3 AS cover FROM lineitem), p AS (SELECT s_suppkey AS img_id, y::INT AS y, 4 AS x FROM supplier, range(8) AS r(y))
       SELECT img_id, y, x, coalesce((SELECT sum(cover) FROM c WHERE c.img_id = p.img_id AND c.y = p.y AND c.x <= p.x), 0) <> 0 AS hit FROM p"""
)
def raster_hits(spark, sf_dir):
    cells = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("img_id"), (F.col("l_partkey") % 8).cast("int").alias("y"), F.col("l_linenumber").alias("x"), (F.col("l_quantity").cast("long") % 7 - 3).alias("cover"))
    points = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("img_id"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("y"), F.lit(4).alias("x"))
    return raster.hit_test(cells, points)


@query("SELECT n_nationkey::BIGINT AS img_id, repeat('000000' || '000001' || '000002' || '000003', 4) AS digits FROM nation")
def rgb_export(spark, sf_dir):
    return raster.rgb_bytes(_pixels(spark, sf_dir, F.lit(0xFF000000) + F.col("x"))).select("img_id", F.hex("data").alias("digits"))


@query("SELECT l_orderkey, l_linenumber, l_quantity AS x, l_tax AS y FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_tax BETWEEN 0.01 AND 0.05")
def glyphs_in_region(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"), F.col("l_tax").alias("y"))
    return search.in_region(rows, 10, 0.01, 20, 0.05)


@query(
    """SELECT doc_id, 0 AS page_index, strpos(text, 'the') - 1 AS at, 3::BIGINT AS chars FROM documents WHERE strpos(text, 'the') > 0"""
)
def hit_regions(spark, sf_dir):
    """The first hit of each text, with the boxes of its characters counted."""
    found = search.hits(_t(spark, sf_dir, "documents").select("doc_id", "text", F.lit("the").alias("what")), "text", "what")
    first = found.groupBy("doc_id", "what").agg(F.min("at").alias("at")).withColumn("page_index", F.lit(0))
    chars = _t(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("page_index"), F.posexplode(F.split("text", "")).alias("idx", "ch")).withColumn("x", F.col("idx").cast("double")).withColumn("y", F.lit(0.0)).withColumn("width", F.lit(1.0)).withColumn("size", F.lit(1.0))
    boxed = search.hit_boxes(first, chars, ["doc_id", "page_index"], "what")
    return boxed.select("doc_id", "page_index", F.col("at").cast("long").alias("at"), F.expr("box.right - box.left").cast("long").alias("chars"))


# --- streams


@query(
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
       s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM e)
       SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, s.n HAVING max(ts) + INTERVAL 6 HOUR < (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"""
)
def stream_sessions(spark, sf_dir):
    """Sessions that the watermark has closed."""
    events = _t(spark, sf_dir, "events")
    stream = windows.arriving(spark, sf_dir, events.schema, pathGlobFilter="events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    done = windows.drain(windows.sessions(stream, "ts", "6 hours", ["user_id"]), scratch(spark))
    return done.select("user_id", F.col("session_start").cast(dict(events.dtypes)["ts"]).alias("session_start"), "n")


@query("SELECT event_type, count(*) AS n FROM (SELECT DISTINCT event_type, user_id FROM events) GROUP BY 1")
def stream_first_of_each(spark, sf_dir):
    events = _t(spark, sf_dir, "events")
    stream = windows.arriving(spark, sf_dir, events.schema, pathGlobFilter="events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("pair", F.concat("event_type", F.lit("/"), F.col("user_id").cast("string")))
    return windows.drain(windows.first_of_each(stream, "pair", "ts", "4000 days"), scratch(spark)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def stream_newest(spark, sf_dir):
    """The newest row of each key from a log of changes that keyed state makes."""
    events = _t(spark, sf_dir, "events")
    stream = windows.arriving(spark, sf_dir, events.schema, pathGlobFilter="events.parquet").select("user_id", "event_id", "event_type")
    changes = windows.drain(windows.newer_only(stream, "user_id", "event_id"), scratch(spark))
    return lookup.latest(changes, ["user_id"], ["event_id"])


@query(
    """SELECT p_partkey AS k, greatest(0, 255 - (p_size + 3))::INT AS cyan, floor(least(1.0, (p_size / 50.0 + 0.5) / 2) * 255 + 0.5)::INT AS mean,
       (SELECT floor(least(1.0, greatest(0.0, CASE WHEN v <= 0.0031308 THEN 12.92 * v ELSE 1.055 * pow(v, 1 / 2.4) - 0.055 END)) * 255 + 0.5) FROM (SELECT pow(p_size / 50.0, 2.2) * (-0.9689 * 0.9505 + 1.8758 + 0.0415 * 1.089) AS v))::INT AS gray FROM part"""
)
def calibrated_colors(spark, sf_dir):
    """Inks as bytes, the mean of several colorants, calibrated gray."""
    n = F.col("n")
    return _parts(spark, sf_dir).select(
        "k", C.cmyk8_to_rgb(n, F.lit(0), F.lit(0), F.lit(3))["r"].alias("cyan"), C.device_n_to_rgb(F.array(n / 50.0, F.lit(0.5)), 3)["g"].alias("mean"), C.cal_gray_to_rgb(n / 50.0, 2.2)["g"].alias("gray"),
    )


@query(
    """SELECT p_partkey AS k, 2.0::DOUBLE AS mirrored_x, p_size::DOUBLE AS mirrored_y, (p_size + 6)::DOUBLE AS sheared, (p_size + 4)::DOUBLE AS mapped_x, (p_size + 10)::DOUBLE AS mapped_y,
       (CASE WHEN p_size % 2 = 0 THEN p_size // 2 ELSE p_size // 2 + 1 END)::BIGINT AS up, (-(CASE WHEN p_size % 2 = 0 THEN p_size // 2 ELSE p_size // 2 + 1 END))::BIGINT AS down FROM part"""
)
def reflections_and_shears(spark, sf_dir):
    n = F.col("n").cast("double")
    mirrored = G.transform_point(G.reflection(45), n, 2.0)
    source = (G.point(0.0, 0.0), G.point(2.0, 0.0), G.point(2.0, 2.0))
    target = (G.point(n, 0.0), G.point(n + 4, 0.0), G.point(n + 4, 10.0))
    mapped = G.transform_point(G.between_parallelograms(source, target), 2.0, 2.0)
    return _parts(spark, sf_dir).select(
        "k", _rounded(mirrored["x"]).alias("mirrored_x"), _rounded(mirrored["y"]).alias("mirrored_y"), _rounded(G.transform_point(G.shearing(3.0, 0.0), n, 2.0)["x"]).alias("sheared"),
        _rounded(mapped["x"]).alias("mapped_x"), (_rounded(mapped["y"]) + n).alias("mapped_y"), G.rounded_away(n / 2).alias("up"), G.rounded_away(-n / 2).alias("down"),
    )


@query(
    """WITH p AS (SELECT p_partkey AS img_id, p_size AS n, 4 + p_size % 5 AS w, 3 + p_size % 4 AS h FROM part), x AS (SELECT *, unnest(range(w)) AS x FROM p), a AS (SELECT *, unnest(range(h)) AS y FROM x)
       SELECT img_id, count(*)::BIGINT AS pixels, sum(CASE WHEN x BETWEEN 1 AND 2 AND y BETWEEN 1 AND 4 THEN n + (x - 1) ELSE 255 END)::BIGINT AS blue,
              (count(*) * 4)::BIGINT AS bytes FROM a GROUP BY img_id"""
)
def stretched_images(spark, sf_dir):
    """An image a part, of its own size and colour: one of 2 x 2 pixels stretched to 2 x 4 over it, written as RGBA."""
    sizes = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("img_id"), "p_size", (4 + F.col("p_size") % 5).alias("w"), (3 + F.col("p_size") % 4).alias("h"))
    target = raster.blank(sizes, "w", "h")
    small = raster.blank(sizes.withColumns({"two": F.lit(2)}), "two", "two").join(sizes.select("img_id", "p_size"), "img_id")
    source = small.select("img_id", "x", "y", (F.lit(0xFF000000) + F.col("p_size") + F.col("x")).alias("argb"))
    stretch = sizes.select("img_id", F.lit(2).alias("width"), F.lit(2).alias("height"), F.lit(2).alias("new_width"), F.lit(4).alias("new_height"))
    made = raster.stretch_blit(target, source, stretch, 1, 1)
    data = raster.rgb_bytes(made, "rgba")
    sums = made.groupBy("img_id").agg(F.count(F.lit(1)).alias("pixels"), F.sum(C.channel(F.col("argb"), "b")).cast("long").alias("blue"))
    return sums.join(data.select("img_id", F.length("data").cast("long").alias("bytes")), "img_id")
