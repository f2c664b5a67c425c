"""The operators of this subpackage applied to whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fill_middle, hard_negatives, html_text, language_id, lm_score, near_dedup, packing, quality, sharding, toxicity, url_filter, warc
from .common import materialize, scratch_path

URL_RULES = [
    url_filter.Rule("block", "net/"),
    url_filter.Rule("allow", "example.net/en/"),
    url_filter.Rule("block", "example.com/de/"),
    url_filter.Rule("allow", "org/fr/"),
]
#: Parts of host names that mark a URL as rejected when the model is fitted, besides the rules.
URL_SEEDS = ("spam", "pills", "casino", "porn", "xxx", "viagra", "warez", "torrent")
#: The same, but only as a whole word of the host's name: shorter ones, which other words hold too.
URL_SEED_WORDS = frozenset(
    "ad ads adult adserver bet bets betting bingo click clicks crack cracks dating escort escorts gambling jackpot keygen loan loans lottery malware nude payday phishing poker sex slots tracker tracking".split()
)
#: Words of the longest n-grams of the language model.
LM_ORDER = 3


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _seeded(host: Column) -> Column:
    found = F.arrays_overlap(F.split(host, "[^a-z0-9]+"), F.array(*[F.lit(w) for w in sorted(URL_SEED_WORDS)])) if URL_SEED_WORDS else F.lit(False)
    for s in URL_SEEDS:
        found = found | F.contains(host, F.lit(s))
    return found


def url_labels(pages: DataFrame, url: str, folds: int = 3) -> DataFrame:
    """Training rows of the URL model: a seed in the host rejects; else the rule, if there is one, decides.

    A URL that neither decides is a training row only if its host is found acceptable, by the mean over its URLs, by a model
    of the seeds and of hosts other than this one (``folds`` groups of hosts); it is then accepted, else left out. Where no
    host has a seed nothing speaks against any of them. All distinct URLs take part.
    """
    host, path = url_filter.host_of(F.col(url)), url_filter.path_of(F.col(url))
    _, ruled = url_filter.rule_of(host, path, URL_RULES)
    kind = F.when(_seeded(host), "seed").otherwise(F.coalesce(ruled, F.lit("open")))
    fold = F.pmod(F.xxhash64("host"), F.lit(folds)).cast("int")
    rows = pages.where(F.col(url).isNotNull()).select(F.concat(host, path).alias("s"), host.alias("host"), kind.alias("kind")).distinct()
    rows = materialize(rows.withColumn("fold", fold), "urls")
    asked = []
    for k in range(folds):
        known = rows.where((F.col("kind") == "seed") | (F.col("kind").isin("allow", "open") & (F.col("fold") != k)))
        model = url_filter.fit(known.select("s", (F.col("kind") != "seed").alias("a")), "s", "a")
        chance = F.lit(1.0) if model is None else url_filter.scored(pages.sparkSession, model, F.col("s"))["url_probability"]
        asked.append(rows.where((F.col("kind") == "open") & (F.col("fold") == k)).select("host", chance.alias("chance")))
    fine = reduce(DataFrame.unionByName, asked).groupBy("host").agg(F.avg("chance").alias("chance")).where("chance >= 0.5").select("host")
    decided = rows.where("kind <> 'open'").select("s", (F.col("kind") == "allow").alias("a"))
    return decided.unionByName(rows.where("kind = 'open'").join(materialize(fine, "hosts"), "host", "left_semi").select("s", F.lit(True).alias("a")))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    model = url_filter.fit(url_labels(pages, "url"), "s", "a")
    judged = url_filter.filter_urls(pages, "url", URL_RULES, model)
    return judged.select("page_id", "host", "path", "rule", "verdict", "url_score", "url_probability")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark")
    found, hits = decontaminate.find(docs, "text", items, "item_id", "text")
    h = F.col(hits)
    return found.select(
        "doc_id",
        h["n_words"].alias("n_words"),
        h["n_hit"].alias("n_hit"),
        F.size(h["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(h["items"]), ","), 256).alias("items_sha256"),
        decontaminate.over(h).alias("contaminated"),
    )


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(_table(spark, sf_dir, "documents"), "doc_id", "text")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), "doc_id", "text", tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), "page_id", "url", "html", path)
    back = warc.read(spark, path, with_payload=False)
    return back.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    body = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    slim = docs.select("doc_id", (F.length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.lit("key").alias("law"))
    weights = {s: 1.0 for s in range(16)}
    placed = sharding.assign(slim, "doc_id", weights, weights | {16: 1.0})
    return sharding.with_slots(placed, "shard", ["size", "text_crc32"], "doc_id").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", order=LM_ORDER)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    model = language_id.fit(docs.where(~F.coalesce(held_out, F.lit(False))), "text", "lang")
    told = language_id.identify(docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out")), "text", model)
    return told.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), F.col("lang_ambiguous").alias("ambiguous"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, made, probability = quality.judge(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    m = F.col(made)
    failed = quality.base_failed(m)
    return judged.select(
        "doc_id",
        *[m[x].alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        failed.alias("base_failed"),
        (~failed & (F.col(probability) >= 0.5)).alias("kept"),
        F.col(probability).alias("quality"),
    )


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_text.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), "html")
    return pages.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    model = toxicity.fit(toxicity.training_keys(labels.where(~held_out), "doc_id", "toxic"), docs, "doc_id", "text")
    scored, name = toxicity.find(docs, "text", model)
    t = F.col(name)
    return scored.select(
        "doc_id", held_out.alias("held_out"), t["probability"].alias("score"), (t["probability"] >= 0.5).cast("int").alias("predicted"),
        F.size(t["passages"]).cast("long").alias("n_passages"), t["evidence"].alias("evidence"),
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of ids divisible by 7 are moved first, as noise; ids divisible by 100 are the anchors."""
    table = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = table.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    rows = materialize(hard_negatives.vectors(moved, "vec_id", "embedding", "label"), "rows")
    return hard_negatives.mine(rows, rows.where("id % 100 = 0").select("id"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, name = fill_middle.transform(_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    m = F.col(name)
    cut = m["form"] != "plain"
    return made.select(
        "doc_id",
        m["n"].alias("n"),
        m["form"].alias("form"),
        F.when(cut, F.length(m["prefix"]).cast("long")).alias("prefix_chars"),
        F.when(cut, F.length(m["middle"]).cast("long")).alias("middle_chars"),
        F.sha2(m["output"].cast("binary"), 256).alias("output_sha256"),
        F.sha2(fill_middle.restored(m["output"], m["form"]).cast("binary"), 256).alias("restored_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = [op1_url_filter, op2_decontamination, op3_near_dedup, op4_packing, op5_warc, op6_sharding, op7_lm_score, op8_language_id, op9_quality_rules, op10_html_text, op11_toxicity, op12_hard_negatives, op13_fill_middle]
    return {f.__name__: f for f in made}


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = {
    "op2_decontamination": f"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce({_WORDS}, []) AS w FROM documents),
        b AS (SELECT item_id, coalesce({_WORDS}, []) AS w FROM benchmark),
        windows AS (
            SELECT item_id, 13 AS n, array_to_string(w[k : k + 12], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS k FROM b WHERE len(w) >= 13)
            UNION SELECT item_id, len(w), array_to_string(w, ' ') FROM b WHERE len(w) BETWEEN 1 AND 12
        ),
        runs AS (
            SELECT r, n, k, array_to_string(w[k : k + n - 1], ' ') AS s
            FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
        ),
        hits AS (SELECT r, item_id, k, runs.n FROM runs JOIN windows USING (n, s)),
        words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM hits) GROUP BY r),
        found AS (SELECT r, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS ids FROM hits GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN words USING (r) LEFT JOIN found USING (r)""",
    "op5_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
        q AS (SELECT *, n >= 1000 AND page_id < max(page_id) OVER (PARTITION BY digest) AS again, max(page_id) OVER (PARTITION BY digest) AS last FROM p)
        SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN again THEN last END AS refers_to FROM q""",
    "op12_hard_negatives": """
        WITH t AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding AS x FROM embeddings),
        r AS (SELECT id, label, [floor(256 * c::DOUBLE) FOR c IN x] AS v FROM t
              WHERE id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
        s AS (SELECT a.id AS anchor_id, b.id AS other, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM r a JOIN r b ON a.id <> b.id WHERE a.id % 100 = 0),
        p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
        n AS (SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS rank, other AS negative_id, positive_score, score AS negative_score
              FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
        SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
    "op13_fill_middle": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS s, sha256('1:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
        u AS (SELECT *, regexp_extract_all(s, '[A-Za-z]+|[^A-Za-z]') AS p, [('0x' || h[8 * k + 1 : 8 * k + 8])::BIGINT FOR k IN range(4)] AS r FROM t),
        c AS (SELECT *, len(p) AS n, least(r[1] % (len(p) + 1), r[2] % (len(p) + 1)) AS a, greatest(r[1] % (len(p) + 1), r[2] % (len(p) + 1)) AS b FROM u),
        f AS (SELECT *, CASE WHEN s = '' OR contains(s, '<P>') OR contains(s, '<S>') OR contains(s, '<M>') OR r[3] % 100 >= 90 THEN 'plain'
                             WHEN r[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
                     array_to_string(p[1 : a], '') AS x, array_to_string(p[a + 1 : b], '') AS y, array_to_string(p[b + 1 :], '') AS z FROM c)
        SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(x) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(y) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN s WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256,
               sha256(s) AS restored_sha256 FROM f""",
}


def oracle_sql() -> dict[str, str]:
    """The operators that SQL can express with the same digits; tests compare the others with brute force."""
    return dict(ORACLE)
