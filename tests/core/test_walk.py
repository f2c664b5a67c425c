"""Trees deeper than any limit of a recursive query."""

from quire.operators import forms
from quire.sources import pdf


def test_deep_trees(spark):
    spark.conf.set("spark.sql.cteRecursionRowLimit", 10)  # a recursive query would fail past these rows
    try:
        deep = 70
        nodes = [(1, 0, ["Root"], "ref", None, 1), (1, 1, ["Pages"], "ref", None, 2)]
        nodes += [(1, k, ["Kids", "0"], "ref", None, k + 1) for k in range(2, deep + 2)] + [(1, deep + 2, ["Type"], "name", bytearray(b"Page"), None)]
        table = spark.createDataFrame(nodes, "doc_id long, obj_num int, path array<string>, kind string, s binary, ref_obj int")
        page = pdf.page_tree(table).collect()
        assert [(r.obj_num, r.page_index, len(r.ancestors)) for r in page] == [(deep + 2, 0, deep + 1)]
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")


def test_cycles_of_fields_are_cut(spark):
    links = [(1, 1, None, "a"), (1, 2, 1, "b"), (1, 1, 2, "a")]
    out = forms.field_tree(spark.createDataFrame(links, "doc_id long, obj_num int, parent_obj int, name string")).collect()
    assert sorted((r.obj_num, r.full_name) for r in out) == [(1, "a"), (2, "a.b")]
