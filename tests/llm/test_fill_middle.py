"""Fill-in-the-middle: units, forms and restored texts against a plain version; SQL; odd rows."""

import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from quire.llm import fill_middle, queries


def plainly(key, text, seed="1"):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"{seed}:{'null' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if text == "" or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", text, p, m
    return (n, "spm", f"<S>{s}<P>{p}<M>{m}", p, m) if h[3] % 100 < 20 else (n, "psm", f"<P>{p}<S>{s}<M>{m}", p, m)


def rows():
    r = random.Random(5)
    alphabet = ["a", "B", "z", " ", "\n", "\r", "é", "ß", "中", "😀", "𝒳", "1", "<", ">", "P", "S", "M", "\x00", " ", "[", "`", "é"]
    texts = [None, "", "a", "😀", "😀😀", "a😀b", "<P>", "x<M>y", "<S", "<<S>", "<<", "\n", "ab\n", "\r\n", "word " * 40_000, "😀a" * 5_000]
    texts += ["".join(r.choice(alphabet) for _ in range(r.randrange(40))) for _ in range(400)]
    return [(k, t) for k, t in enumerate(texts)] + [(None, "null key"), (7, "twice a key"), (7, "twice a key")]


def test_against_plain_version(spark):
    data = rows()
    df = spark.createDataFrame([(k, t, "clash", 1) for k, t in data], "doc_id long, text string, fim string, Pieces int")
    made, name = fill_middle.transform(df, "doc_id", "text")
    assert name == "_fim" and made.columns == [*df.columns, name]
    m = F.col(name)
    got = made.select("doc_id", "text", m["n"], m["form"], m["output"], m["prefix"], m["middle"], fill_middle.restored(m["output"], m["form"])).collect()
    assert len(got) == len(data)
    for key, text, n, form, output, prefix, middle, back in got:
        assert (n, form, output, prefix, middle) == plainly(key, text), (key, text)
        assert back == (text or "")
    assert {r[3] for r in got} == {"plain", "psm", "spm"}


@pytest.mark.parametrize(
    ("grammar", "pattern"),
    [("characters", r"[\s\S]"), ("letters", r"[A-Za-z]+|[^A-Za-z]"), ("words", r"(?:[^\W\d_]|́)+|\d+|\s+|[^\w\s]|_"), ("lines", r"[^\n]+|\n")],
)
def test_units_of_each_grammar(spark, grammar, pattern):
    texts = [t for _, t in rows() if t is not None and len(t) < 100 and "𝒳" not in t and "\x00" not in t and " " not in t]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, u in df.select("t", fill_middle.units(F.col("t"), fill_middle.GRAMMARS[grammar])).collect():
        assert u == re.findall(pattern, t), t


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert fill_middle.transform(df, "doc_id", "text")[0].count() == 0


def test_query_gives_the_rows_of_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    result = con.execute(queries.oracle_sql()["op13_fill_middle"])
    names = [d[0] for d in result.description]
    out = queries.op13_fill_middle(spark, sf_dir)
    assert out.columns == names
    assert sorted(map(tuple, out.collect())) == sorted(result.fetchall())


def test_only_expressions(spark, sf_dir):
    plan = queries.op13_fill_middle(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
