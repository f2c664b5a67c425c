"""Queries on the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import color as C
from .functions import geometry as G
from .functions import text as T
from .functions import sniff
from .operators import content, crypto, forms, images, lookup, raster
from .operators import text as search
from .plans.extract import Documents
from .sources import filters, pdf
from .sources.scan import ROW_BYTES, spread
from .sources.walk import scratch
from .streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return keep


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dealt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose every row is made into a document, image or font: dealt out to all cores, as its file is small and few tasks would read it."""
    return spread(spark, f"{sf_dir}/{name}.parquet", ROW_BYTES)


def _pdfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark, f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", pdf.from_text(F.col("text")).alias("content"))


# --- documents, pages, text


@query("SELECT doc_id, 0 AS page_index, 612.0::DOUBLE AS width, 792.0::DOUBLE AS height, text FROM documents")
def text_roundtrip(spark, sf_dir):
    return Documents(_pdfs(spark, sf_dir)).page_sizes_and_text()


@query("SELECT doc_id, 0 AS revision, o.obj_num::INT AS obj_num, (CASE WHEN o.obj_num = 0 THEN 0 ELSE 1 END)::INT AS type FROM documents, range(6) AS o(obj_num)")
def pdf_xref(spark, sf_dir):
    return Documents(_pdfs(spark, sf_dir)).xref.select("doc_id", "revision", "obj_num", "type")


@query(
    """SELECT doc_id, k AS op_seq, op FROM documents,
       (VALUES (0, 'BT'), (1, 'Tf'), (2, 'Td'), (3, 'Tj'), (4, 'ET')) AS v(k, op)"""
)
def pdf_operations(spark, sf_dir):
    return Documents(_pdfs(spark, sf_dir)).operations.select("doc_id", "op_seq", "op")


@query("SELECT doc_id, length(text)::BIGINT AS n_chars, round(100 + 6.0 * (length(text) - 1), 4)::DOUBLE AS last_x, 700.0::DOUBLE AS y FROM documents WHERE length(text) > 0")
def pdf_characters(spark, sf_dir):
    chars = content.characters(Documents(_pdfs(spark, sf_dir)).objects)
    return chars.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chars"), F.round(F.max("x"), 4).alias("last_x"), F.max("y").alias("y"))


@query("SELECT doc_id, '1.4' AS version, CAST(NULL AS VARCHAR) AS error FROM documents")
def pdf_header(spark, sf_dir):
    return pdf.files(_pdfs(spark, sf_dir)).select("doc_id", "version", "error")


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def codec_roundtrip(spark, sf_dir):
    docs = spread(spark, f"{sf_dir}/documents.parquet").select("doc_id", F.encode("text", "utf-8").alias("raw"))
    chain = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("ASCII85Decode"), F.lit("FlateDecode"))).when(F.col("doc_id") % 3 == 1, F.array(F.lit("ASCIIHexDecode"), F.lit("LZWDecode"))).otherwise(F.array(F.lit("RunLengthDecode")))
    coded = docs.withColumn("filters", chain).withColumn("coded", filters.encoded(F.col("raw"), F.col("filters")))
    return coded.select("doc_id", F.md5(filters.decoded(F.col("coded"), F.col("filters"), F.lit(None).cast("array<map<string,bigint>>"))).alias("digest"))


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def rc4_roundtrip(spark, sf_dir):
    docs = spread(spark, f"{sf_dir}/documents.parquet")
    key = T.object_key(F.lit(b"12345"), F.col("doc_id") % 1000, F.lit(0))
    return docs.select("doc_id", F.md5(crypto.rc4(key, crypto.rc4(key, F.encode("text", "utf-8")))).alias("digest"))


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def aes_roundtrip(spark, sf_dir):
    key = T.object_key(F.lit(b"0123456789abcdef"), F.col("doc_id") % 1000, F.lit(0), aes=True)
    coded = F.aes_encrypt(F.encode("text", "utf-8"), key, F.lit("CBC"), F.lit("PKCS"))
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(crypto.aes_decrypt(key, coded)).alias("digest"))


@query("SELECT doc_id, strpos(text, 'the')::BIGINT - 1 AS first_at FROM documents")
def text_find_first(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", T.find_first(F.col("text"), F.lit("the")).cast("long").alias("first_at"))


@query("SELECT doc_id, substr(text, 6, 20) AS part FROM documents")
def text_substring(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", T.part(F.col("text"), 5, 20).alias("part"))


@query("SELECT doc_id, w AS what, ((length(text) - length(replace(text, w, ''))) // length(w))::BIGINT AS hits FROM documents, (VALUES ('the'), ('der'), ('le'), ('de')) AS v(w)")
def search_hits_count(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").withColumn("what", F.explode(F.array(*map(F.lit, ("the", "der", "le", "de")))))
    return docs.select("doc_id", "what", T.count_hits(F.col("text"), F.col("what")).alias("hits"))


@query("SELECT doc_id, lower(hex(text)) AS digits FROM documents")
def hex_encode(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", T.hex_encode(F.encode("text", "utf-8")).alias("digits"))


@query("SELECT doc_id, text FROM documents")
def hex_string_roundtrip(spark, sf_dir):
    digits = T.hex_encode(T.encode_utf16(F.col("text")))
    return _t(spark, sf_dir, "documents").select("doc_id", T.decode_text(T.hex_decode(digits)).alias("text"))


@query("SELECT doc_id, md5(text) AS m, sha256(text) AS s FROM documents")
def md5_sha256(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", crypto.digest(F.col("text"), "md5").alias("m"), crypto.digest(F.col("text"), "sha256").alias("s"))


@query(
    """WITH p AS (SELECT unnest(string_split(text, ' ')) AS w, doc_id, generate_subscripts(string_split(text, ' '), 1) AS k FROM documents),
       q AS (SELECT right(w, 1) AS l, left(lead(w) OVER (PARTITION BY doc_id ORDER BY k), 1) AS r FROM p)
       SELECT l AS left_char, r AS right_char, count(*) AS n FROM q WHERE l <> '' AND r <> '' GROUP BY ALL"""
)
def kerning_pairs(spark, sf_dir):
    words = _t(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("w"))
    ends = F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w")), lambda a, b: F.struct(F.right(a, F.lit(1)).alias("left_char"), F.left(b, F.lit(1)).alias("right_char")))
    pairs = words.where(F.size("w") > 1).select(F.explode(ends).alias("p")).select("p.*")
    return pairs.where("left_char <> '' AND right_char <> ''").groupBy("left_char", "right_char").agg(F.count(F.lit(1)).alias("n"))


# --- order, windows


@query(
    """WITH g AS (SELECT event_id, user_id, ts, CASE WHEN date_diff('second', lag(ts) OVER w, ts) > 86400 THEN 1 ELSE 0 END AS new
       FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
       SELECT event_id, user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM g"""
)
def line_segment(spark, sf_dir):
    events = _t(spark, sf_dir, "events").withColumn("second", F.unix_timestamp("ts").cast("double")).withColumn("size", F.lit(2.0 * 86400))
    return content.lines(events, ["user_id"], ["ts", "event_id"], y="second").select("event_id", "user_id", F.col("line").cast("long").alias("segment"))


@query("SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity ROWS UNBOUNDED PRECEDING) - l_quantity AS x FROM lineitem")
def text_advance(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity")
    glyphs = _t(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", F.row_number().over(w).alias("n")).alias("place"), F.lit(0).alias("glyph"), F.col("l_quantity").alias("advance"))
    none = spark.createDataFrame([], "left int, right int, kern double")
    return search.kerned(glyphs, none, ["l_orderkey"], "place").select("l_orderkey", F.col("place.l_linenumber").alias("l_linenumber"), "x")


@query(
    """WITH c AS (SELECT l_suppkey AS img_id, (l_partkey % 8)::INT AS y, l_linenumber AS x, sum((l_quantity::BIGINT % 7) - 3)::BIGINT AS cover, sum((l_quantity::BIGINT % 100))::BIGINT AS area
       FROM lineitem GROUP BY ALL),
       s AS (SELECT *, (sum(cover) OVER (PARTITION BY img_id, y ORDER BY x ROWS UNBOUNDED PRECEDING))::BIGINT * 512 - area AS t FROM c)
       SELECT img_id, y, x, least(abs(CAST(floor(t / 512.0) AS BIGINT)), 255)::INT AS alpha FROM s"""
)
def scanline_coverage(spark, sf_dir):
    q = F.col("l_quantity").cast("long")
    cells = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("img_id"), (F.col("l_partkey") % 8).cast("int").alias("y"), F.col("l_linenumber").alias("x"), (q % 7 - 3).alias("cover"), (q % 100).alias("area"))
    return raster.coverage(cells)


@query(
    """WITH p AS (SELECT l_orderkey, l_quantity AS x, l_discount * 100 AS y, lead(l_quantity) OVER w AS nx, lead(l_discount * 100) OVER w AS ny,
         first_value(l_quantity) OVER w AS fx, first_value(l_discount * 100) OVER w AS fy FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_discount))
       SELECT l_orderkey, round(sum(x * coalesce(ny, fy) - y * coalesce(nx, fx)) / 2, 4) + 0.0 AS area FROM p GROUP BY 1"""
)
def polygon_area(spark, sf_dir):
    pts = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").alias("x"), F.col("l_discount").alias("d"), (F.col("l_discount") * 100).alias("y")))).alias("p"))
    return pts.select("l_orderkey", (F.round(G.polygon_area(F.col("p")), 4) + F.lit(0.0)).alias("area"))


# --- geometry


@query("SELECT l_orderkey, l_linenumber, l_quantity BETWEEN 10 AND 30 AND l_discount BETWEEN 0.02 AND 0.06 AS inside FROM lineitem")
def rect_contains(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", G.contains(G.rect(10, 0.02, 30, 0.06), F.col("l_quantity"), F.col("l_discount")).alias("inside"))


@query("SELECT l_orderkey, l_linenumber, l_quantity < 40 AND l_quantity + 5 > 10 AND l_discount < 0.07 AND l_discount + 0.01 > 0.03 AS overlap FROM lineitem")
def rect_intersects(spark, sf_dir):
    q, d = F.col("l_quantity"), F.col("l_discount")
    hit = G.intersects(G.rect(q, d, q + 5, d + 0.01), G.rect(10, 0.03, 40, 0.07))
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", hit.alias("overlap"))


@query("SELECT o_orderpriority, min(o_totalprice) AS lo, max(o_totalprice) AS hi, min(o_custkey)::DOUBLE AS first_key, max(o_custkey)::DOUBLE AS last_key FROM orders GROUP BY 1")
def rect_union(spark, sf_dir):
    r = G.rect(F.col("o_totalprice"), F.col("o_custkey"), F.col("o_totalprice"), F.col("o_custkey"))
    made = _t(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(G.union_agg(r).alias("r"))
    return made.select("o_orderpriority", F.col("r.left").alias("lo"), F.col("r.right").alias("hi"), F.col("r.top").alias("first_key"), F.col("r.bottom").alias("last_key"))


@query("SELECT n_name, min(c_acctbal) AS lo, max(c_acctbal) AS hi, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def bbox_by_group(spark, sf_dir):
    joined = _t(spark, sf_dir, "customer").join(_t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    b = G.bounds_agg(F.col("c_acctbal"), F.col("c_acctbal"))
    return joined.groupBy("n_name").agg(b.alias("b"), F.count(F.lit(1)).alias("n")).select("n_name", F.col("b.left").alias("lo"), F.col("b.right").alias("hi"), "n")


@query("SELECT p_partkey, round(2 * p_size + 0.5 * p_retailprice + 10, 4) AS x, round(-1 * p_size + 3 * p_retailprice + 20, 4) AS y FROM part")
def matrix_transform(spark, sf_dir):
    p = G.transform_point(G.matrix(2, -1, 0.5, 3, 10, 20), F.col("p_size"), F.col("p_retailprice"))
    return _t(spark, sf_dir, "part").select("p_partkey", F.round(p["x"], 4).alias("x"), F.round(p["y"], 4).alias("y"))


@query("SELECT p_partkey, p_size::DOUBLE AS x, round(p_retailprice, 2) AS y FROM part")
def matrix_inverse(spark, sf_dir):
    m = G.multiply(G.multiply(G.scaling(2, 4), G.matrix(1, 0.5, 0.25, 1, 0, 0)), G.translation(5, -7))
    there = G.transform_point(m, F.col("p_size"), F.col("p_retailprice"))
    back = G.transform_point(G.inverse(m), there["x"], there["y"])
    return _t(spark, sf_dir, "part").select("p_partkey", F.round(back["x"], 2).alias("x"), F.round(back["y"], 2).alias("y"))


@query(
    """WITH s AS (SELECT c_custkey, (c_acctbal - 5000) * 0 - c_nationkey * 5000.0 < 0 AS a, (c_acctbal - 5000) * 25.0 < 0 AS b, c_acctbal * -25.0 + c_nationkey * 5000.0 < 0 AS c FROM customer)
       SELECT c_custkey, a = b AND b = c AS inside FROM s"""
)
def triangle_contains(spark, sf_dir):
    inside = G.triangle_contains(0.0, 0.0, 5000.0, 0.0, 5000.0, 25.0, F.col("c_acctbal"), F.col("c_nationkey"))
    return _t(spark, sf_dir, "customer").select("c_custkey", inside.alias("inside"))


@query(
    """SELECT a.s_suppkey AS a_key, b.s_suppkey AS b_key FROM supplier a, supplier b WHERE a.s_suppkey < b.s_suppkey
       AND a.s_acctbal < b.s_acctbal + 200 AND b.s_acctbal < a.s_acctbal + 200 AND a.s_nationkey < b.s_nationkey + 2 AND b.s_nationkey < a.s_nationkey + 2"""
)
def rect_overlap_pairs(spark, sf_dir):
    boxes = _t(spark, sf_dir, "supplier").select("s_suppkey", G.rect(F.col("s_acctbal"), F.col("s_nationkey"), F.col("s_acctbal") + 200, F.col("s_nationkey") + 2).alias("box"))
    pairs = lookup.overlap_join(boxes.select(F.col("s_suppkey").alias("a_key"), F.col("box").alias("l")), boxes.select(F.col("s_suppkey").alias("b_key"), F.col("box").alias("r")), 200.0, 2.0)
    return pairs.where("a_key < b_key").select("a_key", "b_key")


@query("SELECT p_partkey, CAST(round(p_retailprice * 65536) AS BIGINT) AS fixed, (CASE WHEN p_size = 0 THEN 0 ELSE floor(p_size * 64 / 64 + 0.5) * 64 END)::BIGINT AS snapped FROM part")
def fixed_point(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", G.fixed_from_double(F.col("p_retailprice")).alias("fixed"), G.snapped(F.col("p_size") * 64).alias("snapped"))


# --- colour


@query(
    """SELECT l_orderkey, l_linenumber, floor((1 - l_discount) * (1 - l_tax) * 255 + 0.5)::INT AS r, floor((1 - l_tax) * (1 - l_tax) * 255 + 0.5)::INT AS g,
       floor(1.0 * (1 - l_tax) * 255 + 0.5)::INT AS b FROM lineitem"""
)
def cmyk_to_rgb(spark, sf_dir):
    c = C.cmyk_to_rgb(F.col("l_discount"), F.col("l_tax"), 0.0, F.col("l_tax"))
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", c["r"].alias("r"), c["g"].alias("g"), c["b"].alias("b"))


@query("SELECT event_id, (((event_id % 256) * 299 + (event_id * 7 % 256) * 587 + (event_id * 13 % 256) * 114) // 1000)::INT AS luma FROM events")
def luminance(spark, sf_dir):
    e = F.col("event_id")
    return _t(spark, sf_dir, "events").select("event_id", C.luminance(e % 256, e * 7 % 256, e * 13 % 256).alias("luma"))


@query("SELECT event_id, 255::INT AS a, (event_id % 256)::INT AS r, (event_id * 7 % 256)::INT AS g, (event_id * 13 % 256)::INT AS b FROM events")
def argb_pack(spark, sf_dir):
    e = F.col("event_id")
    packed = _t(spark, sf_dir, "events").select("event_id", C.argb(255, e % 256, e * 7 % 256, e * 13 % 256).alias("argb"))
    return packed.select("event_id", *[C.channel(F.col("argb"), n).alias(n) for n in "argb"])


@query("SELECT event_id, (event_id % 256)::INT AS r, (event_id * 7 % 256)::INT AS g, (event_id * 13 % 256)::INT AS b FROM events")
def reversible_color(spark, sf_dir):
    e = F.col("event_id")
    back = C.reversible_inverse(C.reversible_forward((e % 256).cast("int"), (e * 7 % 256).cast("int"), (e * 13 % 256).cast("int")))
    return _t(spark, sf_dir, "events").select("event_id", *[back[n].alias(n) for n in "rgb"])


@query(
    """SELECT event_id, greatest(0, least(255, floor((event_id % 256) + 1.402 * (event_id * 13 % 256 - 128) + 0.5)))::INT AS r,
       greatest(0, least(255, floor((event_id % 256) - 0.344136 * (event_id * 7 % 256 - 128) - 0.714136 * (event_id * 13 % 256 - 128) + 0.5)))::INT AS g,
       greatest(0, least(255, floor((event_id % 256) + 1.772 * (event_id * 7 % 256 - 128) + 0.5)))::INT AS b FROM events"""
)
def ycc_to_rgb(spark, sf_dir):
    e = F.col("event_id")
    c = C.ycc_to_rgb(e % 256, e * 7 % 256, e * 13 % 256)
    return _t(spark, sf_dir, "events").select("event_id", *[c[n].alias(n) for n in "rgb"])


@query("SELECT p_partkey, CASE WHEN p_size < 40 THEN p_size * 3 ELSE 0 END AS r, CASE WHEN p_size < 40 THEN p_size * 3 + 1 ELSE 0 END AS g, CASE WHEN p_size < 40 THEN p_size * 3 + 2 ELSE 0 END AS b FROM part")
def indexed_color(spark, sf_dir):
    c = C.indexed_to_rgb(F.col("p_size"), F.lit(bytes(range(120))))
    return _t(spark, sf_dir, "part").select("p_partkey", *[c[n].alias(n) for n in "rgb"])


@query(
    """SELECT user_id, list_reduce(list_prepend(255, list((event_id * 37 % 256) * 256 + (event_id * 11 % 256) ORDER BY ts, event_id)),
       lambda d, s: ((s // 256) * (s % 256) + d * (255 - s % 256)) // 255)::BIGINT AS gray FROM events GROUP BY 1"""
)
def alpha_blend(spark, sf_dir):
    e = F.col("event_id")
    v = (e * 37 % 256).cast("int")
    layers = _t(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("z"), C.argb(e * 11 % 256, v, v, v).alias("color"))
    stacked = layers.groupBy("user_id").agg(F.collect_list(F.struct("z", "color")).alias("layers"))
    return stacked.select("user_id", C.channel(C.composited(F.col("layers"), F.lit(0xFFFFFFFF)), "r").cast("long").alias("gray"))


# --- pixels


@query(
    """SELECT n_nationkey::BIGINT AS img_id, x::INT AS x, y::INT AS y, (CASE WHEN (x * 6 // 9) BETWEEN 1 AND 2 AND (y * 4 // 8) BETWEEN 1 AND 2 THEN 4278190080 ELSE 4294967295 END)::BIGINT AS argb
       FROM nation, range(9) AS a(x), range(8) AS b(y)"""
)
def pixel_scale(spark, sf_dir):
    sizes = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("img_id"), F.lit(6).alias("width"), F.lit(4).alias("height"), F.lit(9).alias("new_width"), F.lit(8).alias("new_height"))
    return raster.scaled(raster.fill_rect(raster.blank(sizes, "width", "height"), 1, 1, 3, 3, 0xFF000000), sizes)


@query(
    """SELECT n_nationkey::BIGINT AS img_id, (3 - y)::INT AS x, x::INT AS y, (CASE WHEN x < 2 AND y < 1 THEN 4278190080 ELSE 4294967295 END)::BIGINT AS argb
       FROM nation, range(6) AS a(x), range(4) AS b(y)"""
)
def pixel_rotate(spark, sf_dir):
    sizes = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("img_id"), F.lit(6).alias("width"), F.lit(4).alias("height"))
    return raster.rotated(raster.fill_rect(raster.blank(sizes, "width", "height"), 0, 0, 2, 1, 0xFF000000), sizes, 1)


@query(
    """SELECT n_nationkey::BIGINT AS img_id, k::INT AS x, floor(n_regionkey * k / 8.0 + 0.5)::INT AS y FROM nation, range(9) AS r(k)"""
)
def draw_line(spark, sf_dir):
    ends = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("img_id"), F.lit(0).alias("x1"), F.lit(0).alias("y1"), F.lit(8).alias("x2"), F.col("n_regionkey").alias("y2"))
    return raster.line_points(ends).select("img_id", "x", "y")


# --- joins, trees, flags


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def free_entries(spark, sf_dir):
    return lookup.unresolved(_t(spark, sf_dir, "customer").select("c_custkey"), _t(spark, sf_dir, "orders"), "c_custkey", "o_custkey")


@query("SELECT o_orderkey, band::INT AS band FROM orders JOIN (SELECT band, band * 25000.0 AS lo, band * 25000.0 + 24999.99 AS hi FROM range(24) AS r(band)) ON o_totalprice BETWEEN lo AND hi")
def cid_range_lookup(spark, sf_dir):
    bands = spark.range(24).select(F.col("id").cast("int").alias("band"), (F.col("id") * 25000.0).alias("lo"), (F.col("id") * 25000.0 + 24999.99).alias("hi"))
    return lookup.range_join(_t(spark, sf_dir, "orders"), "o_totalprice", bands, "lo", "hi", 25000.0).select("o_orderkey", "band")


@query("SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def latest_revision(spark, sf_dir):
    return lookup.latest(_t(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value"), ["user_id"], ["event_id"])


@query("SELECT event_id FROM events WHERE event_id & 4 <> 0 AND event_id & 2 = 0")
def flag_filter(spark, sf_dir):
    e = F.col("event_id")
    shown = ~forms.has_flag(e, "hidden", forms.ANNOTATION_FLAGS) & forms.has_flag(e, "print", forms.ANNOTATION_FLAGS)
    return _t(spark, sf_dir, "events").where(shown).select("event_id")


@query(
    """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN CASE WHEN p_size & 16 <> 0 THEN 'push_button' WHEN p_size & 8 <> 0 THEN 'radio_button' ELSE 'check_box' END
       WHEN 1 THEN 'text' WHEN 2 THEN CASE WHEN p_size & 32 <> 0 THEN 'combo_box' ELSE 'list_box' END ELSE 'signature' END AS type FROM part"""
)
def field_type(spark, sf_dir):
    kinds = F.array(*map(F.lit, ("Btn", "Tx", "Ch", "Sig")))
    return _t(spark, sf_dir, "part").select("p_partkey", forms.field_type(F.get(kinds, F.col("p_size") % 4), F.shiftleft(F.col("p_size").cast("long"), 12)).alias("type"))


@query("SELECT conv_id, role, arg_max(text, turn) AS value FROM conversations WHERE text IS NOT NULL GROUP BY ALL")
def form_data(spark, sf_dir):
    found = _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("obj_num"), F.col("role").alias("full_name"), F.col("text").alias("value"))
    return forms.form_data(found).select(F.col("doc_id").alias("conv_id"), F.explode("data").alias("role", "value"))


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation, supplier = (_t(spark, sf_dir, n) for n in ("region", "nation", "supplier"))
    one, none = F.col("r_regionkey").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("parent_obj")
    tops = region.select(one, F.col("r_regionkey").cast("long").alias("obj_num"), none, F.col("r_name").alias("name"))
    of_nation = nation.withColumnRenamed("n_regionkey", "r_regionkey")
    mid = of_nation.select(one, (F.col("n_nationkey") + 100).cast("long").alias("obj_num"), F.col("r_regionkey").cast("long").alias("parent_obj"), F.when(F.col("n_nationkey") % 5 != 0, F.col("n_name")).alias("name"))
    placed = supplier.join(of_nation, supplier["s_nationkey"] == of_nation["n_nationkey"])
    leaves = placed.select(one, (F.col("s_suppkey") + 1000).cast("long").alias("obj_num"), (F.col("s_nationkey") + 100).cast("long").alias("parent_obj"), F.col("s_name").alias("name"))
    return tops.unionByName(mid).unionByName(leaves)


@query(
    """SELECT (s_suppkey + 1000)::BIGINT AS obj_num, concat_ws('.', r_name, CASE WHEN n_nationkey % 5 <> 0 THEN n_name END, s_name) AS full_name
       FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
)
def full_name(spark, sf_dir):
    return forms.field_tree(_tree(spark, sf_dir)).where("obj_num >= 1000").select("obj_num", "full_name")


@query(
    """SELECT (s_suppkey + 1000)::BIGINT AS obj_num, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE r_name END AS value
       FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
)
def inherited_attr(spark, sf_dir):
    links = _tree(spark, sf_dir)
    values = links.where("obj_num < 100 OR (obj_num >= 1000 AND (obj_num - 1000) % 3 = 0)").select("doc_id", "obj_num", F.col("name").alias("value"))
    return forms.nearest(forms.field_tree(links), values, "value").where("obj_num >= 1000").select("obj_num", "value")


@query(
    """SELECT l_orderkey AS doc_id, l_linenumber, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber % 2 = 0, l_linenumber) - 1)::INT AS page_index
       FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)"""
)
def page_tree(spark, sf_dir):
    """An order is a document and its lines are pages: those of odd numbers below the root, the others below a node that comes after them."""
    lines = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("n")).distinct()

    def node(df, obj, path, kind, ref=None, s=None):
        cast = lambda c: (c if not isinstance(c, int) else F.lit(c)).cast("long")
        return df.select("doc_id", cast(obj).alias("obj_num"), F.array(*path).alias("path"), F.lit(kind).alias("kind"), F.lit(s).cast("binary").alias("s"), (F.lit(None) if ref is None else cast(ref)).cast("long").alias("ref_obj"))

    docs, even, number = lines.select("doc_id").distinct(), F.col("n") % 2 == 0, F.col("n") + 10
    parts = [
        node(docs, pdf.TRAILER, [F.lit("Root")], "ref", 1), node(docs, 1, [F.lit("Pages")], "ref", 2), node(docs, 2, [F.lit("Kids"), F.lit("100")], "ref", 3),
        node(lines, F.when(even, 3).otherwise(2), [F.lit("Kids"), F.col("n").cast("string")], "ref", number), node(lines, number, [F.lit("Type")], "name", None, b"Page"),
    ]
    table = reduce(DataFrame.unionByName, parts)
    return pdf.page_tree(table).select("doc_id", (F.col("obj_num") - 10).cast("int").alias("l_linenumber"), "page_index")


# --- numbers, dates


@query("SELECT o_orderkey, o_orderdate AS back FROM orders")
def pdf_date(spark, sf_dir):
    kind = dict(_t(spark, sf_dir, "orders").dtypes)["o_orderdate"]
    return _t(spark, sf_dir, "orders").select("o_orderkey", T.parse_date(T.format_date(F.col("o_orderdate").cast("timestamp"))).cast(kind).alias("back"))


@query("SELECT p_partkey, rtrim(rtrim(printf('%.5f', p_retailprice), '0'), '.') AS written FROM part")
def number_format(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", T.number_text(F.col("p_retailprice")).alias("written"))


@query("SELECT l_orderkey, l_linenumber, l_partkey::INT AS obj, l_linenumber AS gen FROM lineitem")
def parse_reference(spark, sf_dir):
    written = F.concat_ws(" ", F.col("l_partkey").cast("string"), F.col("l_linenumber").cast("string"), F.lit("R"))
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.number_or_reference(written)["obj"].alias("obj"), T.number_or_reference(written)["gen"].alias("gen"))


# --- revisions, search, fonts, images


@query("SELECT doc_id, 300.0::DOUBLE AS width, 200.0::DOUBLE AS height FROM documents")
def pdf_revision(spark, sf_dir):
    made = _pdfs(spark, sf_dir)
    body = F.lit("<< /Type /Page /Parent 2 0 R /Contents 4 0 R /MediaBox [0 0 300 200] >>")
    revised = made.select("doc_id", pdf.append_revision(F.col("content"), pdf.start_of_xref(F.col("content")), 3, body).alias("content"))
    return Documents(revised).pages.select("doc_id", "width", "height")


@query(
    """WITH p AS (SELECT doc_id, unnest(string_split(text, 'the')) AS part, generate_subscripts(string_split(text, 'the'), 1) AS k, len(string_split(text, 'the')) AS n FROM documents),
       q AS (SELECT doc_id, k, n, sum(length(part)) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) + 3 * (k - 1) AS pos FROM p)
       SELECT doc_id, count(*) AS hits, sum(pos)::BIGINT AS places FROM q WHERE k < n GROUP BY 1"""
)
def search_all_hits(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text", F.lit("the").alias("what"))
    return search.hits(docs, "text", "what").groupBy("doc_id").agg(F.count(F.lit(1)).alias("hits"), F.sum("at").cast("long").alias("places"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 1000 < 300 THEN o_custkey % 1000 + 5 WHEN o_custkey % 1000 BETWEEN 500 AND 900 THEN o_custkey % 1000 - 500 ELSE 0 END::BIGINT AS cid FROM orders")
def cmap_lookup(spark, sf_dir):
    cmap = "begincodespacerange <0000> <FFFF> endcodespacerange 2 begincidrange <0000> <012B> 5 <01F4> <0383> 0 endcidrange 1 begincidchar <0384> 400 endcidchar"
    fonts = spark.createDataFrame([(1, cmap)], "font_id int, body string")
    codes = _t(spark, sf_dir, "orders").select("o_orderkey", F.lit(1).alias("font_id"), (F.col("o_custkey") % 1000).alias("code"))
    return search.cids(codes, search.cmap_ranges(fonts)).select("o_orderkey", "cid")


@query(
    """WITH g AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_returnflag AS l, lead(l_returnflag) OVER w AS r, l_quantity AS a FROM lineitem
         WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity)),
       k AS (SELECT *, a + CASE WHEN l = 'A' AND r = 'N' THEN -2 WHEN l = 'N' AND r = 'A' THEN -3 ELSE 0 END AS adv FROM g)
       SELECT l_orderkey, sum(adv) AS total FROM k GROUP BY 1"""
)
def kerned_advance(spark, sf_dir):
    place = F.struct("l_linenumber", "l_partkey", "l_quantity").alias("place")
    glyphs = _t(spark, sf_dir, "lineitem").select("l_orderkey", place, F.col("l_returnflag").alias("glyph"), F.col("l_quantity").alias("advance"))
    pairs = spark.createDataFrame([("A", "N", -2.0), ("N", "A", -3.0)], "left string, right string, kern double")
    return search.kerned(glyphs, pairs, ["l_orderkey"], "place").groupBy("l_orderkey").agg(F.sum("advance").alias("total"))


@query("SELECT doc_id, x::INT AS x, (ascii(substr(t, (x // 4 + 1)::INT, 1)) >> (6 - 2 * (x % 4))::INT & 3)::INT AS v FROM (SELECT doc_id, source AS t FROM documents), range(12) AS r(x)")
def image_samples(spark, sf_dir):
    made = _t(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("img_id"), F.encode("source", "utf-8").alias("data"), F.lit(12).alias("width"), F.lit(1).alias("height"), F.lit(1).alias("components"), F.lit(2).alias("bits")
    )
    return images.samples(made).select(F.col("img_id").alias("doc_id"), "x", "v")


@query("SELECT l_orderkey, l_linenumber, l_quantity::BIGINT AS v, count(*) AS n FROM lineitem GROUP BY ALL")
def wavelet_roundtrip(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity")
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.row_number().over(w) - 1).alias("k"), F.col("l_quantity").cast("long").alias("v"))
    back = images.lowered(images.lifted(rows, ["l_orderkey"], "k", "v"), ["l_orderkey"], "k", "v")
    return back.groupBy("l_orderkey", "l_linenumber", "v").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' END AS kind FROM documents")
def image_kinds(spark, sf_dir):
    head = F.when(F.col("doc_id") % 3 == 0, F.unhex(F.lit("89504E470D0A1A0A"))).when(F.col("doc_id") % 3 == 1, F.unhex(F.lit("FFD8FFE0"))).otherwise(F.unhex(F.lit("00")))
    return _t(spark, sf_dir, "documents").select("doc_id", sniff.image_kind(F.concat(head, F.encode("text", "utf-8"))).alias("kind"))


# --- streams


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_window_counts(spark, sf_dir):
    events = _t(spark, sf_dir, "events")
    stream = windows.arriving(spark, sf_dir, events.schema, pathGlobFilter="events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    done = windows.drain(windows.windowed(stream, "ts", "1 day", ["event_type"]), scratch(spark), "complete")
    return done.select(F.col("window_start").cast(dict(events.dtypes)["ts"]).alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_roundtrip(spark, sf_dir)
