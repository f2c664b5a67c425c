"""URL filter, sharding, WARC, language, quality, HTML: contracts, brute force, odd rows."""

import gzip
import hashlib
import json
import math
import os
import random
import time
import urllib.parse
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import html_text, language_id, quality, queries, sharding, url_filter, warc
from quire.llm.common import scratch_path

# --- URLs


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    return "".join(c.lower() if c.isascii() else c for c in host), path


def test_host_path_and_rules(spark):
    urls = [
        None, "", "no scheme/x", "http://A.Example.NET/en/1?x#y", "http://example.net", "http://net/", "https://x.example.com/de/", "http://x.org/fr/a", "http://myexample.net/en/q",
        "http://a.b/c://d/e", "ftp://ÄB.net/x", "http://h?q=/en/", "http://user@h.net:80/p#f", "x\ny://z.net/\nq", "http://example.com/de", "http://h?q=http://x/y", "://", "http://" + "a" * 50_000 + "/" + "b/" * 50_000,
    ]
    df = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)], "page_id long, url string, host string")
    out = {r.page_id: r for r in url_filter.filter_urls(df, "url", queries.URL_RULES, None).collect()}
    for k, u in enumerate(urls):
        host, path = host_path(u)
        assert (out[k]["_host"], out[k].path) == (host, path), u
        fits = [r for r in queries.URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.pattern), default=None)
        assert out[k].rule == (best.pattern if best else None)
        assert out[k].verdict == (best.verdict if best else "allow")


def test_markov_model_is_a_distribution():
    counts = {}
    for text in ("abab", "abc", "bca"):
        s = url_filter.START + text + url_filter.END
        for n in (1, 2, 3):
            for k in range(len(s) - n + 1):
                if s[k : k + n] != url_filter.START:
                    counts[s[k : k + n]] = counts.get(s[k : k + n], 0) + 1
    m = url_filter.MarkovModel.fit(counts, 2, alphabet=5)
    for context in ("", "a", "ab", "zz"):
        total = 0.0
        for c in "abc" + url_filter.END + "q":
            p, x = 0.0, context[-2:]
            while x + c not in m.logp and x:
                p += m.backoff.get(x, 0.0)
                x = x[1:]
            total += np.exp(p + m.logp.get(c if not x else x + c, m.floor))
        assert total == pytest.approx(1.0, abs=1e-9)
    assert m.log_likelihood("abab") > m.log_likelihood("cccc")


def test_held_out_urls_are_told_apart(spark):
    rng = random.Random(1)
    good = [f"www.{rng.choice(['news', 'maps', 'books'])}{k}.example/{rng.choice(['a', 'b'])}/{k}" for k in range(300)]
    bad = [f"cheap-pills{k}.example/buy/{k}" for k in range(300)]
    rows = [(s, True) for s in good[:200]] + [(s, False) for s in bad[:200]] + [(None, True)]
    model = url_filter.fit(spark.createDataFrame(rows, "s string, a boolean"), "s", "a")
    right = sum(model.probability(model.score(s)) >= 0.5 for s in good[200:]) + sum(model.probability(model.score(s)) < 0.5 for s in bad[200:])
    assert right >= 195
    assert url_filter.fit(spark.createDataFrame([("a", True)], "s string, a boolean"), "s", "a") is None


# --- sharding


def test_shards_against_brute_force_and_growth(spark):
    rows = [(k, k % 7) for k in range(3000)] + [(None, 1), (5, 5), (5, 5)]
    df = spark.createDataFrame(rows, "doc_id long, size long")
    weights = {0: 1.0, 1: 2.0, 2: 1.0}
    out = sharding.with_slots(sharding.assign(df, "doc_id", weights, weights | {3: 1.0}), "shard", ["size"], "doc_id", cells=8).collect()

    def shard(key, weights):
        def score(s):
            bits = int(hashlib.md5(f"{key}/{s}".encode()).hexdigest()[:13], 16)
            return -weights[s] / np.log((bits + 0.5) / 2.0**52)

        return max(weights, key=lambda s: (score(s), s))

    for r in out:
        key = "null" if r.doc_id is None else f"k{r.doc_id}"
        assert r.shard == shard(key, weights) and r.grown_shard == shard(key, weights | {3: 1.0})
        assert r.grown_shard in (r.shard, 3)
    sizes = {}
    for r in out:
        sizes.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in sizes.values()) and len(out) == len(rows)
    assert len(sizes[1]) == pytest.approx(1500, rel=0.1)
    assert sum(r.grown_shard == 3 for r in out) == pytest.approx(600, rel=0.2)


def test_shards_of_an_empty_table_clashing_names_and_long_keys(spark):
    weights = {s: 1.0 for s in range(16)}
    empty = spark.createDataFrame([], "doc_id long, size long, shard string, slot int")
    placed = sharding.assign(empty, "doc_id", weights)
    assert placed.columns == ["doc_id", "size", "shard", "slot", "_shard"] and sharding.with_slots(placed, "_shard", ["size"], "doc_id").count() == 0
    rows = [("k" * 100_000 + str(k), k, "own", 7) for k in range(40)] + [(None, 1, None, None)] * 2
    df = spark.createDataFrame(rows, "key string, size long, shard string, slot int")
    out = sharding.with_slots(sharding.assign(df, "key", weights), "_shard", ["size"], "key").collect()
    assert len(out) == 42 and {r.shard for r in out} == {"own", None} and {r["_shard"] for r in out} <= set(range(16))
    for s in {r["_shard"] for r in out}:
        mine = sorted(r["_slot"] for r in out if r["_shard"] == s)
        assert mine == list(range(len(mine)))


def test_scratch_scopes_delete_what_they_made(spark):
    from quire.llm.common import batches, materialize, scratch_scope

    with scratch_scope(spark):
        inner = materialize(spark.range(3), "inner")
        files = inner.inputFiles()
        assert inner.count() == 3
    assert not any(os.path.exists(urllib.parse.urlparse(f).path) for f in files)
    assert list(batches([], 10)) == [] and list(batches([None, "abc", "d"], 3)) == [(0, 2), (2, 3)]


def test_url_model_counts_all_training_urls(spark):
    rows = spark.createDataFrame([(f"h/{chr(0x4E00 + k)}", k % 20 > 0) for k in range(22_000)], "s string, a boolean")
    model = url_filter.fit(rows, "s", "a")
    used = {(r.s[2], r.a) for r in rows.where("pmod(xxhash64(s, 1), 5) <> 0").collect()}
    for a, m in ((True, model.accepted), (False, model.rejected)):
        assert {g for g in m.logp if len(g) == 1 and ord(g) >= 0x4E00} == {c for c, b in used if b == a}
    pages = rows.select(F.concat(F.lit("http://"), "s").alias("url"))
    assert queries.url_labels(pages, "url").count() == 22_000


def test_op1_of_empty_and_repeated_urls(spark, tmp_path):
    rows = [(1, "http://a.example.com/x"), (1, "http://a.example.com/x"), (2, None), (3, "x" * 200_000)]
    for name, some in (("some", rows), ("none", [])):
        spark.createDataFrame(some, "page_id long, url string").write.parquet(f"file://{tmp_path}/{name}/pages.parquet")
    out = queries.op1_url_filter(spark, f"file://{tmp_path}/some").collect()
    assert sorted(r.page_id for r in out) == [1, 1, 2, 3] and all(r.verdict == "allow" for r in out)
    assert queries.op1_url_filter(spark, f"file://{tmp_path}/none").count() == 0


# --- WARC


def test_warc_round_trip(spark):
    big, other = "é" * 600, "z" * 1000
    rows = [(1, "http://a/", big), (2, "http://b/ü", big), (3, None, "small"), (4, "http://c/", "small"), (5, "u", None), (6, "u", other), (7, "u\r\nX: y", big), (7, "twin", big), (None, "n", other)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    paths = [scratch_path(spark, "warc") for _ in range(2)]
    for p in paths:
        warc.write(pages, "page_id", "url", "html", p, roll_bytes=600)
    back = warc.read(spark, paths[0]).collect()
    assert len(back) == len(rows) and all(r.block_ok for r in back)
    for r in back:
        body = next((h or "").encode() for k, _, h in rows if k == r.key)
        assert r.payload_bytes == len(body) and r.payload_digest == hashlib.sha1(body).hexdigest()
        assert (r.payload == body) == (r.record_type == "response")
    kinds = sorted(((r.key, r.record_type, r.refers_to) for r in back), key=str)
    assert kinds == sorted([(1, "revisit", 7), (2, "revisit", 7), (3, "response", None), (4, "response", None), (5, "response", None), (6, "response", None), (7, "response", None), (7, "revisit", 7), (None, "revisit", 6)], key=str)
    folders = [p.removeprefix("file://") for p in paths]
    names = [[f["name"] for f in json.load(open(f"{f}/_manifest.json"))["files"]] for f in folders]
    assert names[0] == names[1] and len(names[0]) > 1
    for n in names[0]:
        one, two = (open(f"{f}/{n}", "rb").read() for f in folders)
        assert one == two and gzip.decompress(one).startswith(b"WARC/1.1\r\n")
    assert all(urllib.parse.unquote(r.url) in {u or "" for _, u, _ in rows} for r in back)


def test_warc_bytes_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(warc, "LEAST_RANGE", 1 << 20)
    k = F.col("id")
    pages = spark.range(60_000).select(k.alias("page_id"), F.concat(F.lit("http://h/"), k % 7).alias("url"), F.repeat(F.md5((k % 20_000).cast("string")), (k % 40).cast("int")).alias("html"))
    kept = scratch_path(spark, "pages")
    pages.write.parquet(kept)
    found = []
    for n in (3, 11):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        path = scratch_path(spark, "warc")
        warc.write(spark.read.parquet(kept).repartition(n), "page_id", "url", "html", path, roll_bytes=1 << 19)
        folder = path.removeprefix("file://")
        listed = json.load(open(f"{folder}/_manifest.json"))["files"]
        found.append([(f, hashlib.sha1(open(f"{folder}/{f['name']}", "rb").read()).hexdigest()) for f in listed])
        assert sum(f["records"] for f in listed) == 60_000
        with pytest.raises(FileExistsError):
            warc.write(pages, "page_id", "url", "html", path)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1] and len({f["name"].split("-")[1] for f, _ in found[0]}) > 10
    sizes = {}
    for f, _ in found[0]:
        sizes[f["name"].split("-")[1]] = sizes.get(f["name"].split("-")[1], 0) + f["records"]
    assert max(sizes.values()) < 3 * 60_000 / len(sizes)
    back = [r.key for r in warc.read(spark, path, with_payload=False).select("key").collect()]
    assert sorted(back) == list(range(60_000))


def test_warc_bounds_sort_as_keys_do(spark):
    rows = [(k, bytes([d] * 20)) for k in (None, -(1 << 63), -5, -1, 0, 7, (1 << 63) - 1) for d in (0, 200)]
    df = spark.createDataFrame(rows, "key long, digest binary").select("*", warc._sortable(F.col("key"), F.col("digest")).alias("at"))
    assert [(r.key, bytes(r.digest)) for r in sorted(df.collect(), key=lambda r: bytes(r.at))] == rows
    assert warc.ranges(0) == 1 and warc.ranges(10**9) == 60 and warc.ranges(10**14) == 65536


def test_warc_of_nothing(spark):
    path = scratch_path(spark, "warc")
    warc.write(spark.createDataFrame([], "page_id long, url string, html string, key int"), "page_id", "url", "html", path)
    assert warc.read(spark, path).count() == 0


# --- language


def test_languages_held_out(spark, sf_dir):
    out = queries.op8_language_id(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id")
    got = out.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.min("score"), F.max("score")).first()
    assert got[0] > 0.98 and 0 <= got[1] <= got[2] <= 1
    sample = out.limit(300).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in sample)


def test_language_of_odd_rows(spark):
    rows = [(1, "the house is here and the dog", "en"), (2, "das Haus ist hier und der Hund", "de"), (3, None, "en"), (4, "123 !?", None), (5, "", "de"), (6, "the dog is here", None), (7, "É", None), (8, "der Hund und das Haus " * 3000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string")
    model = language_id.fit(docs.withColumnRenamed("lang_pred", "lang"), "text", "lang")
    out = {r.doc_id: r for r in language_id.identify(docs, "text", model).collect()}
    assert [out[k]["_lang_pred"] for k in (1, 2, 3, 4, 5, 6, 8)] == ["en", "de", "und", "und", "und", "en", "de"]
    assert out[3].lang_score == 0 and out[7]["_lang_pred"] in ("en", "de")
    none = language_id.fit(docs.select("text", F.lit(None).cast("string").alias("lang")), "text", "lang")
    assert {r["_lang_pred"] for r in language_id.identify(docs, "text", none).collect()} == {"und"}


def test_language_model_against_brute_force(spark):
    """Counts, bits, accuracies and decoding anew, with dictionaries and loops."""
    rng = random.Random(9)
    words = {"de": "der und das ist nicht ein", "en": "the and that is not a", "fr": "le et la est pas un", "es": "el y la es no un", "it": "il e la non un che", "pt": "o e a não um que"}
    rows = [(k, " ".join(rng.choice((words[x] if rng.random() < 0.6 else words["en"]).split()) for _ in range(rng.randrange(1, 9))), x) for k, x in enumerate(rng.choices(list(words), k=240))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = language_id.fit(docs, "text", "lang")
    languages, code = sorted(words), language_id.codewords(6)
    assert model.languages == languages

    def grams(text):
        b = language_id.prepared(text)
        return [((b[k] | b[k + 1] << 8 | b[k + 2] << 16) * 2654435761 % (1 << 32)) >> 17 for k in range(len(b) - 2)]

    counts = {x: {} for x in languages}
    for _, text, lang in rows:
        for g in grams(text):
            counts[lang][g] = counts[lang].get(g, 0) + 1
    # texts of one batch are counted as one stream, two zero bytes apart: no trigram of two texts counts as theirs
    share = {x: lambda g, x=x: (counts[x].get(g, 0) + 0.5) for x in languages}

    def margin(text, bit):
        found, total = grams(text), 0.0
        for g in found:
            p = [share[x](g) / norm[x] for x in languages]
            one, zero = ([q for q, c in zip(p, code[:, bit]) if c == v] for v in (1, 0))
            total += math.log(sum(one) / len(one)) - math.log(sum(zero) / len(zero))
        return total / max(1, len(found)) * min(30, len(found))

    norm = {x: sum(counts[x].values()) + 0.5 * language_id.FEATURES for x in languages}
    margins = {k: [margin(text, b) for b in range(code.shape[1])] for k, text, _ in rows}
    trust = []
    for b in range(code.shape[1]):
        shares = []
        for n, x in enumerate(languages):
            own = [margins[k][b] > 0 for k, _, lang in rows if lang == x]
            shares.append((sum(t == bool(code[n, b]) for t in own) + 1) / (len(own) + 2))
        p = min(0.999, max(0.51, sum(shares) / len(shares)))
        trust.append(math.log(p / (1 - p)))
    trust = [t * len(trust) / sum(trust) for t in trust]
    assert model.trust == pytest.approx(trust, rel=0.05) and max(trust) > min(trust)
    agree = 0
    for r in language_id.identify(docs.select("doc_id", "text"), "text", model).collect():
        loss = [sum(t * math.log1p(math.exp(-m * (2 * int(c) - 1))) for t, m, c in zip(model.trust, margins[r.doc_id], code[n])) for n in range(6)]
        agree += r.lang_pred == languages[min(range(6), key=lambda n: loss[n])]
        assert r.lang_score == pytest.approx(1 / sum(math.exp(min(loss) - x) for x in loss), abs=0.08)
    assert agree >= 0.98 * len(rows)


def test_language_of_an_empty_table_and_too_many_languages(spark, monkeypatch):
    empty = spark.createDataFrame([], "text string, lang string, lang_score int")
    assert language_id.identify(empty, "text", language_id.fit(empty, "text", "lang")).count() == 0
    monkeypatch.setattr(language_id, "MOST", 1)
    with pytest.raises(ValueError):
        language_id.fit(spark.createDataFrame([("a", "en"), ("b", "de")], "text string, lang string"), "text", "lang")


@pytest.mark.parametrize("n", [2, 3, 4, 5, 6, 12])
def test_codewords(n):
    code = language_id.codewords(n)
    assert len({tuple(c) for c in code}) == n and all(0 < code[:, b].sum() < n for b in range(code.shape[1]))
    if n > 2:
        assert min((a != b).sum() for i, a in enumerate(code) for b in code[:i]) >= 2


# --- quality


def slow_measures(text):
    text = text or ""
    w = quality._WORD.findall(text)
    windows = {}
    for k in range(len(w) - 2):
        windows.setdefault(tuple(w[k : k + 3]), []).append(k)
    again = {k + j for places in windows.values() if len(places) > 1 for k in places for j in range(3)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if quality._WORD.search(line):
            dups += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dups, len(again)


def test_measures_against_brute_force():
    rng = random.Random(4)
    texts = [None, "", " \n ", "a b c a b c", "a a a a", "x\u00a0y\x1cz\u2003q r", "one\none\n\none", "#*$%&|<>", "long word " * 2000]
    texts += ["".join(rng.choice("ab \n#\t\u00e9\u3000") for _ in range(rng.randrange(1, 80))) for _ in range(300)]
    for t in texts:
        assert quality.measure(t)[:5] == slow_measures(t), repr(t)


def test_expectation_maximisation_finds_accuracies():
    rng = np.random.default_rng(6)
    good = rng.random(20_000) < 0.8
    votes = np.array([np.where(rng.random(len(good)) < 0.3, 0, np.where((rng.random(len(good)) < a) == good, 1, -1)) for a in (0.95, 0.85, 0.75, 0.7)]).T
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    posterior, accuracy = quality.estimate(patterns, counts.astype(float))
    assert accuracy == pytest.approx([0.95, 0.85, 0.75, 0.7], abs=0.04)
    assert ((posterior[inverse.ravel()] >= 0.5) == good).mean() > 0.93


def test_quality_catches_junk_and_keeps_the_rest(spark, sf_dir):
    out = queries.op9_quality_rules(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet").withColumnRenamed("quality", "label"), "doc_id").collect()
    clean = [r for r in out if r.label == 1 and not r.base_failed]
    assert sum(r.kept for r in clean) >= 0.98 * len(clean)
    assert sum(r.kept for r in out if r.label == 0) <= 0.05 * sum(r.label == 0 for r in out)


def test_quality_of_empty_tables_and_nulls(spark):
    docs = spark.createDataFrame([(1, None, 3)], "doc_id long, text string, votes int")
    judged, made, p = quality.judge(docs, "text")
    assert judged.count() == 1 and quality.keep(docs, "text").columns == docs.columns
    assert quality.keep(docs.where(F.lit(False)), "text").count() == 0


def test_junk_hosts_that_no_seed_names(spark, monkeypatch):
    monkeypatch.setattr(queries, "URL_SEED_WORDS", frozenset())
    rng = np.random.default_rng(2)
    plain = [f"{a}.th{b}{c}.example.com" for a in ("www", "m", "blog") for b in ("the", "ere", "ing", "tion") for c in ("or", "an", "in", "re", "st")]
    seeded = ["m.casino-win.example.com", "spam-farm.example.com", "www.cheap-pills.example.com"]
    junk = ["free-bets.example.com", "m.ads-track.example.com"]
    rows = [(f"http://{h}/{rng.choice(['en', 'es'])}/{rng.integers(1000, 9999)}", h) for h in plain + seeded + junk for _ in range(12)]
    pages = spark.createDataFrame(rows, "url string, host string")
    labels = [(r.s.partition("/")[0], r.a) for r in queries.url_labels(pages, "url").collect()]
    assert not any(h in junk for h, _ in labels)
    assert {h for h, a in labels if a} >= set(plain[:1]) and len({h for h, a in labels if a}) >= 0.9 * len(plain)
    model = url_filter.fit(queries.url_labels(pages, "url"), "s", "a")
    verdicts = url_filter.filter_urls(pages.withColumnRenamed("host", "h"), "url", queries.URL_RULES, model).collect()
    assert all(r.verdict == "block" for r in verdicts if r.h in junk + seeded)
    assert sum(r.verdict == "allow" for r in verdicts if r.h in plain) >= 0.95 * 12 * len(plain)


def test_short_seeds_are_whole_words(spark):
    df = spark.createDataFrame([(h,) for h in ("free-bets.example.com", "alphabet.example.com", "m.ads.example.com", "heads.example.com", "mycasino.example.com")], "h string")
    assert [r.x for r in df.select(queries._seeded(F.col("h")).alias("x")).collect()] == [True, False, True, False, True]


# --- HTML


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<body><nav><a>Home</a></nav><article><h1>T  i\n t</h1><p>a<br>b<p>c&nbsp;d</article><footer>f</footer>", "T i t\n\na b\n\nc d"),
        ("<main><p>one</p><div class='ad'>buy</div><p>two</p><section id='comments'><p>me</p></section></main>", "one\n\ntwo"),
        ("<article><p>x</p><script>var t='</p>'</script><style>p{}</style><form>name<input></form><aside>s</aside>y</article>", "x\n\ny"),
        ("<article><p>cut <b>off", "cut off"),
        ("<article><ul><li>1<li>2</ul><table><tr><td>3<td>4</table></article>", "1\n\n2\n\n3\n\n4"),
        ("<article><!-- no --><p a='>'>q</p><!-- never closed", "q"),
        ("<div class=menu>" + "m " * 50 + "</div><div>" + "word " * 40 + "</div><div>x</div><footer>c</footer>", ("word " * 40).strip() + "\n\nx"),
        ("<article><header><h1>H</h1></header><p>b</p></article><script>never closed <p>z", "H\n\nb"),
        ("<article><p>1 &lt; 2 &#233; &copy;</p></article>", "1 < 2 é ©"),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


def test_an_article_does_not_hide_longer_text_outside():
    card, body = "<div><article><h2>Card</h2></article></div>", "long text " * 30
    for page in (card * 3 + f"<div><p>{body}</p><p>end</p></div>", f"<article><p>short</p></article><div><p>{body}</p><p>end</p></div>", f"<div><p>{body}</p><p>end</p></div><article>short</article>"):
        blocks = html_text.main_text(page).split("\n\n")
        assert body.strip() in blocks and "end" in blocks
        assert "Card" in blocks or "short" in blocks
    assert html_text.main_text(f"<div>Home</div><article><p>{body}</p><p>x</p></article><div>Terms</div>") == body.strip() + "\n\nx"


@pytest.mark.parametrize("left_out", ["<div class='ad'>buy now</div>", "<form>mail <input></form>", "<div class='notice'><p>we use</p></div>", "<aside>x</aside><nav>y</nav>"])
def test_what_is_left_out_does_not_split_a_container(left_out):
    body = ("long text " * 30).strip()
    for page in (
        f"<body><div id=story><div><p>{body}</p></div>{left_out}<div><p>short end</p></div></div></body>",
        f"<body><div><p>{body}</p>{left_out}<p>short end</p></div></body>",
        f"<body><p>{body}</p>{left_out}<p>short end</p></body>",
    ):
        assert html_text.main_text(page) == f"{body}\n\nshort end"
    assert html_text.main_text(f"<body><div><p>{body}</p></div>{left_out}<div>Terms</div></body>") == body


def test_no_stretch_is_dropped_for_a_greater_one():
    body, closing = ("long text " * 60).strip(), ("closing part " * 10).strip()
    assert html_text.main_text(f"<body><div>{body}</div><nav>n</nav><div>{closing}</div></body>") == f"{body}\n\n{closing}"


def test_surge_and_dive():
    lengths = np.array([5, 0, 0, 0, 80, 3, 0, 90, 0, 0, 0, 7])
    assert html_text.stretches(lengths, 60) == [(4, 8)]
    assert html_text.stretches(np.zeros(0, np.int64), 60) == []


@pytest.mark.parametrize("name", ["content has-sidebar", "article-body no-comments", "post with-share", "job-search-guide", "overflow-hidden main-col", "navigable", "header-open-nav", "col-12"])
def test_class_words_that_only_hold_a_mark_leave_the_article(name):
    body = ("long text " * 30).strip()
    assert html_text.main_text(f'<div>Home</div><div class="{name}"><p>{body}</p></div>').endswith(body)


@pytest.mark.parametrize("name", ["sidebar", "x cookie-notice", "ad_slot", "ad-slot-3", "siteNav", "post-comments", "hidden", "comment-list"])
def test_class_words_that_name_what_stands_beside_the_article(name):
    body = ("long text " * 30).strip()
    assert html_text.main_text(f"<div><p>{body}</p></div><div class='{name}'>{body}</div>") == body


def test_marks_alone_empty_no_page():
    assert html_text.main_text("<div class=sidebar><p>all there is</p></div>") == "all there is"
    assert html_text.main_text('<p title="a hidden b">seen</p><p hidden>not</p><p style="display: none">nor</p>') == "seen"


@pytest.mark.parametrize("part, n", [("<a ", 350_000), ("<a '>", 200_001), ("<div>a", 160_000), ("<b>", 300_000), ("<b><div>", 60_000), ("<a \"'>", 150_000), ("<p class=\"", 80_000), ("<!-", 300_000)])
def test_a_megabyte_of_broken_markup_takes_seconds(part, n):
    began = time.perf_counter()
    html_text.main_text(part * n + "</b></div>" * 60_000)
    assert time.perf_counter() - began < 20


def random_tree(rng, depth):
    if depth == 0 or rng.random() < 0.3:
        return "word " * rng.choice([1, 2, 5, 30])
    name = rng.choice(["div", "div", "div", "section", "p", "ul", "article", "main", "nav", "aside", "footer", "form", "div class=ad", "div class='sidebar x'"])
    inner = rng.choice([1, 2, 3]) if name != "p" else 1
    return name, [random_tree(rng, depth - 1 if name != "p" else 0) for _ in range(inner)]


def written(node):
    return node if isinstance(node, str) else f"<{node[0]}>" + "".join(map(written, node[1])) + f"</{node[0].split()[0]}>"


def slow_main_text(trees, surge=60):
    """Lines, gaps, surges and dives by their definitions, over whole lists of ancestors."""
    places, numbers = [], iter(range(1, 10**6))  # (text, ancestors) or (None, ancestors) of what is left out
    bare = {"p", "ul"}

    def cut():
        if places:
            places[-1] = (*places[-1][:2], False)

    def go(node, above):
        if isinstance(node, str):
            if places and places[-1][0] and places[-1][2]:
                places[-1] = (places[-1][0] + node, above, True)
            else:
                places.append((node, above, True))
            return
        name, _, mark = node[0].partition(" ")
        cut()
        if name in ("nav", "aside", "footer", "form") or mark:
            places.append((None, above, False))
            return
        own = (*above, (name, next(numbers)))
        for x in node[1]:
            go(x, own)
        cut()

    for tree in trees:
        go(tree, ())
    lines, sure, before, left_out = [], [], None, []
    for text, above, _ in places:
        if text is None:
            left_out.append(above[-1] if above else None)
            continue
        main = any(n in ("article", "main") for n, _ in above)
        box = next((x for x in reversed(above) if x[0] not in bare), None)
        if before:
            same = before[2] == box or all(x is not None and x in above and x in before[1] for x in left_out)
            if before[0] != main or left_out and not same:
                lines += [""] * 3
                sure += [main] * 3
        lines.append(" ".join(text.split()))
        sure.append(main)
        before, left_out = (main, above, box), []
    n = [len(x) for x in lines]
    dives = [not any(n[k : k + 3]) for k in range(len(n))]

    def kept(i, surges):
        return n[i] and any(surges(s) and n[s] and not any(dives[s : i + 1]) for s in range(i + 1))

    for surges in (lambda s: sure[s] or sum(n[s : s + 3]) >= surge, lambda s: sum(n[s : s + 3]) >= 1):
        if out := [lines[i] for i in range(len(n)) if kept(i, surges)]:
            return "\n\n".join(out)
    return ""


def test_main_text_against_brute_force():
    rng, seen = random.Random(12), set()
    for _ in range(1500):
        trees = [random_tree(rng, 4) for _ in range(rng.randrange(1, 4))]
        expected = slow_main_text(trees)
        if not expected:
            continue  # searched again without marks
        assert html_text.main_text("".join(map(written, trees))) == expected, "".join(map(written, trees))
        seen.add(expected)
    assert len(seen) > 300


def test_html_of_an_empty_table(spark):
    assert html_text.extract(spark.createDataFrame([], "html string, main_text int"), "html").count() == 0


def test_pages_keep_their_columns(spark):
    pages = spark.createDataFrame([(1, None, "own"), (2, "<p>a</p>" * 5000, None)], "page_id long, html string, main_text string")
    out = {r.page_id: r for r in html_text.extract(pages, "html").collect()}
    assert out[1]["_main_text"] == "" and out[1].main_text == "own" and out[2]["_main_text"].count("a") == 5000
