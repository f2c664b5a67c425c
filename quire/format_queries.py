"""Queries of font files, character codes, image boxes, wavelets and bounds on the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import charcodes, codecs
from .functions import color as C
from .functions import geometry as G
from .operators import fontfiles, forms, images
from .queries import _dealt, _t, query
from .sources import filters


def _parts(spark, sf_dir: str) -> DataFrame:
    return _dealt(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("n"), "p_name", "p_brand")


def _number(value: Column | int, size: int) -> Column:
    """Hexadecimal digits of a number of so many bytes, two's complement."""
    value = value if isinstance(value, Column) else F.lit(value)
    return F.right(F.lpad(F.hex(value.cast("long")), 16, "0"), F.lit(2 * size))


def _font(style: str) -> Column:
    """A font file with five tables: sizes from n, family from p_brand."""
    n, zeros = F.col("n"), lambda k: F.lit("00" * k)
    family, named = F.hex(F.encode("p_brand", "UTF-16BE")), style.encode().hex().upper()
    size = (F.length(family) / 2).cast("int")
    record = lambda *fields: F.concat(*[_number(x, 2) for x in fields])
    bodies = {
        "head": F.concat(zeros(18), _number(n + 1000, 2), zeros(16), *[_number(x, 2) for x in (-n, n * -2, n * 3, n * 4)], zeros(10)),
        "hhea": F.concat(zeros(4), _number(n + 700, 2), _number(-n, 2), zeros(28)),
        "maxp": F.concat(zeros(4), _number(n, 2)),
        "name": F.concat(record(0, 3, 42), record(3, 1, 0, 1, size, 0), record(1, 0, 0, 2, len(style), size), record(3, 1, 0, 1, 2, 0), F.lit(""), family, F.lit(named)),
        "kern": zeros(4),
    }
    at, entries = F.lit(12 + 16 * len(bodies)), []
    for tag, body in bodies.items():
        length = (F.length(body) / 2).cast("int")
        entries += [F.lit(tag.encode().hex().upper()), zeros(4), _number(at, 4), _number(length, 4)]
        at = at + length
    return F.unhex(F.concat(F.lit("00010000"), _number(len(bodies), 2), zeros(6), *entries, *bodies.values()))


@query(
    """SELECT p_partkey AS font_id, (1000 + p_size)::BIGINT AS units, (-p_size)::BIGINT AS box_left, (p_size * 4)::BIGINT AS box_top, (700 + p_size)::BIGINT AS ascent, (-p_size)::BIGINT AS descent, p_size::BIGINT AS glyphs, p_brand AS family,
       'Bold Oblique' AS style, CAST(NULL AS VARCHAR) AS postscript, true AS kerning, true AS bold, true AS italic FROM part"""
)
def font_files(spark, sf_dir):
    made = _parts(spark, sf_dir).select(F.col("k").alias("font_id"), _font("Bold Oblique").alias("data"))
    found = fontfiles.metrics(made)
    return found.select("font_id", "units", F.col("box.left").alias("box_left"), F.col("box.top").alias("box_top"), "ascent", "descent", "glyphs", "family", "style", "postscript", "kerning", "bold", "italic")


@query(
    """SELECT p_partkey AS font_id, kind, CASE kind WHEN 'family' THEN p_brand ELSE 'Light' END AS text, CASE WHEN p_size % 2 = 0 THEN 'F' || p_size END AS type1, CASE WHEN p_size % 2 = 0 THEN 1 END::INT AS place
       FROM part, (VALUES ('family'), ('style')) AS v(kind)"""
)
def font_names(spark, sf_dir):
    parts = _parts(spark, sf_dir)
    found = fontfiles.names(images.sfnt_tables(parts.select(F.col("k").alias("font_id"), _font("Light").alias("data"))))
    program = F.encode(F.concat(F.lit("%!PS-AdobeFont-1.0\n"), F.when(F.col("n") % 2 == 0, "/FontName /F").otherwise("/Other /F"), F.col("n").cast("string"), F.lit(" def")), "ISO-8859-1")
    maps = F.when(F.col("n") % 2 == 0, F.array(F.lit("symbol"), F.lit("unicode"), F.lit("unicode"))).otherwise(F.array(F.lit("symbol")))
    named = parts.select(F.col("k").alias("font_id"), fontfiles.type1_name(program).alias("type1"), fontfiles.charmap(maps, "unicode").cast("int").alias("place"))
    return found.join(named, "font_id")


# --- character codes

#: One byte, two with a leading byte of all mixed maps, two with one of some, and a leading byte at the end.
_STRING = "unhex(concat('61A1', right(hex(176 + n % 16), 2), '813082'))"


@query(
    """WITH m(name, charset, coding, scheme, vertical) AS (VALUES ('GB-EUC-H', 'GB1', 'gb', 'mixed_two', false), ('GBK-EUC-V', 'GB1', 'gb', 'mixed_two', true), ('UniJIS-UCS2-H', 'Japan1', 'ucs2', 'two', false),
       ('Identity-V', NULL, 'cid', 'two', true), ('Nothing-H', NULL, NULL, NULL, NULL)),
       c(name, place, f) AS (VALUES ('GB-EUC-H', 0, 97), ('GB-EUC-H', 1, -1), ('GB-EUC-H', 2, 129), ('GB-EUC-H', 3, 48), ('GB-EUC-H', 4, 130), ('GBK-EUC-V', 0, 97), ('GBK-EUC-V', 1, -1), ('GBK-EUC-V', 2, 33072), ('GBK-EUC-V', 3, 33280),
       ('UniJIS-UCS2-H', 0, 24993), ('UniJIS-UCS2-H', 1, -2), ('UniJIS-UCS2-H', 2, 12418), ('Identity-V', 0, 24993), ('Identity-V', 1, -2), ('Identity-V', 2, 12418))
       SELECT p_partkey AS k, name, charset, coding, scheme, vertical, place::INT AS place, CASE f WHEN -1 THEN 161 * 256 + 176 + p_size % 16 WHEN -2 THEN (176 + p_size % 16) * 256 + 129 ELSE f END::BIGINT AS code FROM part, m LEFT JOIN c USING (name)"""
)
def predefined_code_maps(spark, sf_dir):
    names = F.explode(F.array(*map(F.lit, ("GB-EUC-H", "GBK-EUC-V", "UniJIS-UCS2-H", "Identity-V", "Nothing-H")))).alias("name")
    found = _parts(spark, sf_dir).select("k", F.expr(_STRING).alias("s"), names).withColumn("m", charcodes.predefined(F.col("name")))
    cut = found.select("k", "name", "m.charset", "m.coding", "m.scheme", "m.vertical", F.posexplode_outer(charcodes.codes(F.col("s"), F.col("m.scheme"), F.col("m.leads"))).alias("place", "code"))
    return cut


@query(
    """WITH c(place, base, step, size) AS (VALUES (0, 65, 0, 1), (1, 33072, 10, 2), (2, 0, 0, 1), (3, 2174562, 0, 3), (4, 2711724449, 4, 4), (5, 0, 0, 1), (6, 0, 0, 1)),
       d AS (SELECT *, base + CASE WHEN step = 0 THEN 0 ELSE p_size % step END AS code FROM part, c)
       SELECT p_partkey AS k, 'mixed_four' AS scheme, 7 AS n_codes, place::INT AS place, code::BIGINT AS code, size::INT AS size, CASE WHEN code = 0 THEN '00' ELSE hex(code) END AS bytes, (16 + p_size)::BIGINT AS value, 0::BIGINT AS large, 'two' AS single FROM d"""
)
def code_spaces(spark, sf_dir):
    body = F.lit("4 begincodespacerange <40> <7F> <8130> <8439> endcodespacerange 1 begincodespacerange <212E00> <212EFF> <A1A1A1A1> <A4A4A4A4> endcodespacerange")
    spaces = charcodes.code_spaces(body)
    scheme, data = charcodes.scheme_of(spaces), F.unhex(F.concat(F.lit("4181"), F.hex(F.col("n") % 10 + 48), F.lit("85212E62A1A1A1"), F.hex(F.col("n") % 4 + 161), F.lit("A1A185A4")))
    cut = charcodes.codes(data, scheme, spaces=spaces)
    word = F.concat(F.lit("<"), F.hex(F.col("n") + 16), F.lit(">"))
    single = charcodes.scheme_of(charcodes.code_spaces(F.lit("begincodespacerange <0000> <FFFF> endcodespacerange")))
    rows = _parts(spark, sf_dir).select("k", scheme.alias("scheme"), F.size(cut).alias("n_codes"), charcodes.code_value(word).alias("value"), charcodes.code_value(F.lit("<1FFFFFFFF>")).alias("large"), single.alias("single"), F.posexplode(cut).alias("place", "code"))
    return rows.withColumn("size", charcodes.code_size(F.col("code"), F.col("scheme"))).withColumn("bytes", F.hex(charcodes.code_bytes(F.col("code"), F.col("scheme"))))


# --- images


@query(
    """SELECT p_partkey AS img_id, k::INT AS k, parent, type, CASE WHEN k = 5 THEN 62 + p_size ELSE place END::BIGINT AS "offset", header::INT AS header, CASE k WHEN 4 THEN 16 + p_size WHEN 5 THEN 8 + p_size ELSE size END::BIGINT AS length, true AS whole
       FROM part, (VALUES (0, NULL, 'jP  ', 0, 8, 12), (1, NULL, 'ftyp', 12, 8, 12), (2, NULL, 'jp2h', 24, 8, 22), (3, 'jp2h', 'ihdr', 32, 8, 14), (4, NULL, 'uuid', 46, 16, 0), (5, NULL, 'jp2c', 0, 8, 0)) AS v(k, parent, type, place, header, size)"""
)
def jp2_boxes(spark, sf_dir):
    n = F.col("n")
    body = lambda k: F.repeat(F.lit("AB"), k)
    box = lambda name, size: F.concat(_number(size, 4), F.lit(name.encode().hex()))
    data = F.concat(F.lit("0000000C6A5020200D0A870A"), box("ftyp", 12), body(F.lit(4)), box("jp2h", 22), box("ihdr", 14), body(F.lit(6)), box("uuid", 1), _number(n + 16, 8), body(n), box("jp2c", 0), body(n))
    return images.jp2_boxes(_parts(spark, sf_dir).select(F.col("k").alias("img_id"), F.unhex(data).alias("data")))


@query(
    """SELECT l_orderkey AS img_id, l_linenumber AS x, 0 AS y, c::INT AS c, (least(max(l_quantity)::INT, 31) * 8 + c)::INT AS v FROM lineitem, range(3) AS r(c) GROUP BY l_orderkey, l_linenumber, c"""
)
def palette_samples(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("img_id"), F.col("l_linenumber").alias("x"), "l_quantity").repartition("img_id")  # one shuffle for the sums and the join
    samples = lines.groupBy("img_id", "x").agg(F.max("l_quantity").cast("int").alias("v")).withColumn("y", F.lit(0))
    lookup = F.lit(bytes(entry * 8 + c for entry in range(32) for c in range(3)))
    return images.palette_indexed(samples, _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("img_id"), lookup.alias("lookup")), 3)


@query(
    """WITH r AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) - 1 AS i, l_quantity::DOUBLE AS v FROM lineitem),
       a AS (SELECT k, i, v, CASE WHEN i % 2 = 1 THEN v - 1.586134342059924 * (coalesce(lag(v) OVER w, lead(v) OVER w, 0) + coalesce(lead(v) OVER w, lag(v) OVER w, 0)) ELSE v END AS p, count(*) OVER (PARTITION BY k) AS n FROM r WINDOW w AS (PARTITION BY k ORDER BY i)),
       b AS (SELECT *, CASE WHEN i % 2 = 0 THEN p - 0.052980118572961 * (coalesce(lag(p) OVER w, lead(p) OVER w, 0) + coalesce(lead(p) OVER w, lag(p) OVER w, 0)) ELSE p END AS q FROM a WINDOW w AS (PARTITION BY k ORDER BY i)),
       c AS (SELECT *, CASE WHEN i % 2 = 1 THEN q + 0.882911075530934 * (coalesce(lag(q) OVER w, lead(q) OVER w, 0) + coalesce(lead(q) OVER w, lag(q) OVER w, 0)) ELSE q END AS s FROM b WINDOW w AS (PARTITION BY k ORDER BY i)),
       d AS (SELECT *, CASE WHEN i % 2 = 0 THEN s + 0.443506852043971 * (coalesce(lag(s) OVER w, lead(s) OVER w, 0) + coalesce(lead(s) OVER w, lag(s) OVER w, 0)) ELSE s END AS t FROM c WINDOW w AS (PARTITION BY k ORDER BY i))
       SELECT k, i::BIGINT AS i, round(CASE WHEN n = 1 THEN t WHEN i % 2 = 1 THEN t * 1.230174104914001 ELSE t / 1.230174104914001 END, 4) + 0.0 AS band, round(v, 4) AS back FROM d"""
)
def smooth_wavelet(spark, sf_dir):
    """Bands of the irreversible transform, and the samples that they give back."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity")
    rows = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), (F.row_number().over(w) - 1).cast("long").alias("i"), F.col("l_quantity").cast("double").alias("v"))
    bands = images.lifted_smooth(rows, ["k"], "i", "v").withColumn("band", F.round("v", 4) + F.lit(0.0))
    return images.lowered_smooth(bands, ["k"], "i", "v").select("k", "i", "band", F.round("v", 4).alias("back"))


@query(
    """WITH b AS (SELECT p_partkey AS k, unhex('0' || upper(to_hex(1 + p_size % 15)) || '00000200FF') AS raw, 1 + p_size % 15 AS a, p_size AS n FROM part)
       SELECT k, upper(lpad(to_hex(a), 2, '0')) || '00' || upper(lpad(to_hex(a), 2, '0')) || '02' || upper(lpad(to_hex(a), 2, '0')) || '02' AS wide, (n * 3 + 3) // 4 * 4 AS padded, (n * 3 * 4 + 7) // 8 AS bytes,
       upper(lpad(to_hex(CASE WHEN a & 1 = 1 THEN 1 ELSE 0 END), 2, '0')) AS parity FROM b"""
)
def row_predictors(spark, sf_dir):
    """TIFF predictors of 16 and 1 bits, undone, and the pitch of rows."""
    a = _number(1 + F.col("n") % 15, 1)
    deflated = lambda raw: filters.encoded(F.unhex(raw), F.array(F.lit("FlateDecode")))
    parms = lambda bits, columns: F.array(F.create_map(F.lit("Predictor"), F.lit(2), F.lit("BitsPerComponent"), F.lit(bits), F.lit("Columns"), F.lit(columns)))
    wide = filters.decoded(deflated(F.concat(a, F.lit("0000020000"))), F.array(F.lit("FlateDecode")), parms(16, 3))
    last = filters.decoded(deflated(F.concat(_number((1 + F.col("n") % 15).bitwiseAND(1), 1))), F.array(F.lit("FlateDecode")), parms(1, 8))
    return _parts(spark, sf_dir).select("k", F.hex(wide).alias("wide"), codecs.pitch(F.col("n"), 3, 8, 4).cast("int").alias("padded"), codecs.pitch(F.col("n"), 3, 4).cast("int").alias("bytes"), F.hex(last).alias("parity"))


# --- bounds, functions, fields


@query(
    """SELECT p_partkey AS k, 5.0::DOUBLE AS "left", 3.0::DOUBLE AS top, (5.0 + p_size)::DOUBLE AS "right", (3.0 + 2 * p_size)::DOUBLE AS bottom, (10.0)::DOUBLE AS image_left, (10.0 + 2 * p_size)::DOUBLE AS image_right FROM part"""
)
def vertex_and_image_bounds(spark, sf_dir):
    n = F.col("n")
    vertex = lambda cmd, x, y: F.struct(F.lit(cmd).alias("cmd"), F.lit(x).cast("double").alias("x") if not isinstance(x, Column) else x.cast("double").alias("x"), (y if isinstance(y, Column) else F.lit(y)).cast("double").alias("y"))
    path = F.array(vertex(1, 5, 3), vertex(4, n + 5, 3), vertex(4, n + 5, 2 * n + 3), vertex(4, 5, 2 * n + 3), vertex(15 | 0x40, -9, -9), vertex(0, 999, 999))
    bounds = codecs.vertex_bounds(_parts(spark, sf_dir).select("k", F.explode(path).alias("v")).select("k", "v.*"), ["k"])
    box = G.unit_box(G.multiply(G.scaling(n, 1), G.translation(5, 6)), G.scaling(2, 2))
    return bounds.join(_parts(spark, sf_dir).select("k", box["left"].alias("image_left"), box["right"].alias("image_right")), "k")


@query(
    """WITH p AS (SELECT p_partkey AS k, p_size / 10.0 AS x, 370 + p_size * 8.0 AS nm FROM part),
       b AS (SELECT k, sum((CASE m % 2 WHEN 0 THEN 1 ELSE -1 END) * pow(x / 2, 2 * m + 1) / (gamma(m + 1) * gamma(m + 2))) AS j1 FROM p, range(30) AS r(m) GROUP BY k),
       c AS (SELECT k, nm, CASE WHEN nm BETWEEN 380 AND 440 THEN (440 - nm) / 60 WHEN nm BETWEEN 510 AND 580 THEN (nm - 510) / 70 WHEN nm BETWEEN 580 AND 780 THEN 1 ELSE 0 END AS r, CASE WHEN nm BETWEEN 440 AND 490 THEN (nm - 440) / 50 WHEN nm BETWEEN 490 AND 580 THEN 1
         WHEN nm BETWEEN 580 AND 645 THEN (645 - nm) / 65 ELSE 0 END AS g, CASE WHEN nm BETWEEN 380 AND 490 THEN 1 WHEN nm BETWEEN 490 AND 510 THEN (510 - nm) / 20 ELSE 0 END AS b, CASE WHEN nm > 700 THEN 0.3 + 0.7 * (780 - nm) / 80 WHEN nm < 420 THEN 0.3 + 0.7 * (nm - 380) / 40 ELSE 1 END AS dim FROM p)
       SELECT k, round(j1, 6) + 0.0 AS bessel, round(greatest(r * dim, 0), 6)::DOUBLE AS red, round(greatest(g * dim, 0), 6)::DOUBLE AS green, round(greatest(b * dim, 0), 6)::DOUBLE AS blue FROM b JOIN c USING (k)"""
)
def series_and_spectrum(spark, sf_dir):
    shown = C.wavelength_to_rgb(370 + F.col("n") * 8.0)
    return _parts(spark, sf_dir).select("k", (F.round(codecs.bessel(1, F.col("n") / 10.0), 6) + F.lit(0.0)).alias("bessel"), *[(F.round(shown[n], 6) + F.lit(0.0)).alias(name) for n, name in (("r", "red"), ("g", "green"), ("b", "blue"))])


@query(
    """SELECT p_partkey AS k, CASE p_size % 3 WHEN 0 THEN '' ELSE p_brand END AS text, p_size % 3 = 1 AS checked, CASE p_size % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END::INT AS n_selected, CASE WHEN p_size % 3 < 2 THEN ['a', 'b'][p_size % 3 + 1] END AS option FROM part"""
)
def field_values(spark, sf_dir):
    n = F.col("n") % 3
    value = F.when(n != 0, F.col("p_brand"))
    selected = F.when(n == 2, F.array(F.lit("x"), F.lit("y"))).otherwise(F.array().cast("array<string>"))
    checked = forms.is_checked(F.when(n == 1, "Yes").when(n == 2, "OFF"))
    return _parts(spark, sf_dir).select(
        "k", forms.text_value(value).alias("text"), checked.alias("checked"), F.size(forms.selected_values(value, selected)).alias("n_selected"), forms.option_at(F.array(F.lit("a"), F.lit("b")), n).alias("option")
    )
