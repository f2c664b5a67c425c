"""What pages draw, with the form XObjects that they run.

A programme is the content of a page or of a form. Each is parsed once, wherever and however often it runs; what it doesn't set
is null in its rows. A run of a programme is a row: where it stands in the page, under which matrix, with which state and resources. The runs that
runs cause are found level by level, by joins of all documents at once, and the rows of the programmes are joined to their runs at last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..sources import pdf
from ..sources.walk import levels, scratch, written
from . import content, objects

#: What a programme takes over from the one that runs it, unless it sets it.
STATE = ("font", "font_owner", "size", "char_space", "word_space", "scale", "render_mode", "fill", "stroke")


def programmes(table: DataFrame, tree: DataFrame, streams: DataFrame, contents: DataFrame) -> DataFrame:
    """Rows of ``content.page_objects`` of every page and form, by (doc_id, obj_num), with nulls for what is inherited."""
    pages = contents.join(tree.select("doc_id", "page_index", "obj_num"), ["doc_id", "page_index"]).select("doc_id", F.col("obj_num").alias("page_index"), "data")
    both = pages.unionByName(objects.form_contents(table, streams).select("doc_id", "page_index", "data"))
    return content.page_objects(both, inherit=True).withColumnRenamed("page_index", "obj_num")


def runs(table: DataFrame, tree: DataFrame, calls: DataFrame) -> DataFrame:
    """doc_id, page_index, obj_num, place, ancestors, owner, ctm, state: the runs of all programmes.

    calls: XObject rows of ``programmes``. place: the sequence numbers of the calls that led here; owner: whose resources hold, the form's own or else those of
    the programme that runs it. A form that would run within itself isn't run again. Leading and rise begin at 0 in each programme.
    """
    named = written(objects.named_resources(table, "XObject"), scratch(table.sparkSession))
    own = table.where(F.get("path", F.lit(0)) == "Resources").select("doc_id", F.col("obj_num").alias("form"), F.lit(True).alias("has_own")).distinct()
    found = objects.form_xobjects(table).select("doc_id", F.col("obj_num").alias("form"), F.col("matrix").alias("m")).join(own, ["doc_id", "form"], "left")
    m = F.col("m")
    known = written(found.withColumn("m", F.struct(*[m[k].alias(c) for k, c in enumerate("abcdef")])), scratch(table.sparkSession))
    owners = pdf.inherited(tree, table, "Resources")
    calls = calls.select("doc_id", "obj_num", "seq", "font", "matrix", "state_font", *[c for c in STATE if c not in ("font", "font_owner")])
    first = {
        "font": F.lit(None).cast("string"), "font_owner": F.lit(None).cast("int"), "size": F.lit(0.0), "char_space": F.lit(0.0), "word_space": F.lit(0.0), "scale": F.lit(1.0), "render_mode": F.lit(0),
        "fill": F.array(F.lit(0.0)), "stroke": F.array(F.lit(0.0)),
    }
    top = tree.join(owners, ["doc_id", "obj_num"], "left").select(
        "doc_id", "page_index", "obj_num", F.array().cast("array<int>").alias("place"), F.array("obj_num").alias("ancestors"), "owner", G.matrix().alias("ctm"),
        F.struct(*[first[c].alias(c) for c in STATE]).alias("state"),
    )
    inner = calls.select("doc_id", "obj_num", "seq", F.col("font").alias("name"), "matrix", F.struct(*[F.col(c) for c in STATE if c not in ("font", "font_owner")]).alias("set"), F.col("state_font").alias("set_font"))

    def below(level: DataFrame) -> DataFrame:
        called = level.join(inner, ["doc_id", "obj_num"]).join(named.select("doc_id", "owner", "name", F.col("ref_obj").alias("form")), ["doc_id", "owner", "name"])
        entered = called.join(known, ["doc_id", "form"]).where(~F.array_contains("ancestors", F.col("form")))
        state = {c: F.coalesce(F.col("set")[c], F.col("state")[c]) for c in STATE if c not in ("font", "font_owner")}
        state["font"] = F.coalesce("set_font", F.col("state")["font"])
        state["font_owner"] = F.when(F.col("set_font").isNotNull(), F.col("owner")).otherwise(F.col("state")["font_owner"])
        return entered.select(
            "doc_id", "page_index", F.col("form").alias("obj_num"), F.array_append("place", F.col("seq")).alias("place"), F.array_append("ancestors", F.col("form")).alias("ancestors"),
            F.when(F.coalesce("has_own", F.lit(False)), F.col("form")).otherwise(F.col("owner")).alias("owner"), G.multiply(F.col("m"), G.multiply(F.col("matrix"), F.col("ctm"))).alias("ctm"),
            F.struct(*[state[c].alias(c) for c in STATE]).alias("state"),
        )

    return levels(top, below)


def drawn(table: DataFrame, tree: DataFrame, streams: DataFrame, contents: DataFrame) -> DataFrame:
    """Everything that pages draw, forms included: the columns of ``content.page_objects`` with matrices of the page, and

    place: sequence numbers from the page's own row to this one's, by which rows are in drawing order (``place_text`` joins them by dots);
    obj_num: the programme; font_owner: whose resources the font's name is of. ``line`` counts within the run.
    """
    made = written(programmes(table, tree, streams, contents), scratch(table.sparkSession))
    every = runs(table, tree, made.where("type = 'xobject'"))
    joined = every.join(made.withColumnRenamed("font", "own_font").withColumnsRenamed({c: f"own_{c}" for c in STATE if c not in ("font", "font_owner")}), ["doc_id", "obj_num"])
    s = F.col("state")
    out = {c: F.coalesce(f"own_{c}", s[c]) for c in STATE if c not in ("font", "font_owner")}
    is_call, set_here = F.col("type") == "xobject", F.col("own_font").isNotNull()
    out["font"] = F.when(is_call, F.col("own_font")).otherwise(F.coalesce("own_font", s["font"]))
    out["font_owner"] = F.when(is_call | set_here, F.col("owner")).otherwise(s["font_owner"])
    return joined.select(
        "doc_id", "page_index", "obj_num", F.col("place").alias("run"), F.array_append("place", F.col("seq")).alias("place"), F.concat_ws(".", F.array_append("place", F.col("seq")).cast("array<string>")).alias("place_text"),
        "seq", "type", G.multiply(F.col("matrix"), F.col("ctm")).alias("matrix"), F.when(F.col("base").isNotNull(), G.multiply(F.col("base"), F.col("ctm"))).alias("base"), "line", "lead", "text",
        *[out[c].alias(c) for c in STATE], "paint", "segments",
    )
