"""Mixing, sharding, HTML extraction and the pipeline."""

import hashlib
import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from reviewlens.llm import html_extract as hx, mixing, sharding
from reviewlens.llm.queries import MIX_WEIGHTS, ORACLE_SQL, QUERIES
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.001"


def brute_poisson(name, mean, seed=42):
    steps = max(1, math.ceil(mean / mixing.STEP))
    total = 0
    for j in range(1, steps + 1):
        digest = hashlib.md5(f"{seed}/{name}/{j}".encode()).hexdigest()
        u, m = int(digest[:13], 16) / 2**52, mean / steps
        p = c = math.exp(-m)
        k = 0
        while c <= u and k < int(m + 12 * math.sqrt(m) + 20):
            k += 1
            p *= m / k
            c += p
        total += k
    return total


def brute_mix(rows, weights, default, target=None):
    """Rows are (id, source) or, where an id may be missing, (id, source, text)."""
    n = Counter(s for _, s, *_ in rows)
    weight = {s: max(weights.get(s, default), 0.0) for s in n}
    target = len(rows) if target is None else target
    out = Counter()
    for i, s, *text in rows:
        name = i if i is not None else "text-" + hashlib.md5((text[0] or "").encode()).hexdigest()
        mean = target * weight[s] / sum(weight.values()) / n[s] if sum(weight.values()) else 0.0
        for r in range(brute_poisson(name, mean) if mean else 0):
            out[(i, s, r)] += 1
    return out


@pytest.mark.parametrize("weights,default,target", [({"a": 3.0, "b": 1.0}, 1.0, None), ({"a": 1.0}, 0.0, 500),
                                                    ({"a": -1.0}, 0.0, None), ({}, 1.0, 20_000)])
def test_mix_counts(spark, make, weights, default, target):
    rows = [(i, "a" if i % 10 else "b", f"t{i}") for i in range(120)] + [(None, "c", "tNone"), (7, "a", "t7")]
    docs = make([(i, t, s) for i, s, t in rows])
    mixed = mixing.mix(docs, weights, default, target_rows=target)
    assert mixed.columns == [*docs.columns, "replica", "mix_key"]
    assert Counter((r.doc_id, r.source, r.replica) for r in mixed.collect()) == brute_mix(rows, weights, default, target)
    assert mixing.mix(make([]), weights, default).count() == 0


def test_mix_keeps_null_sources_and_odd_texts(spark, make):
    docs = make(ODD).withColumn("source", F.when(F.col("doc_id") > 3, F.lit(None)).otherwise(F.col("source")))
    rows = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    got = Counter((r.doc_id, r.source, r.replica) for r in mixing.mix(docs, {}, target_rows=40).collect())
    assert got == brute_mix(rows, {}, 1.0, 40)


def test_mix_is_shuffled_and_native(spark):
    df = QUERIES["op5_poisson_mix"](spark, SF)
    ids = [r.doc_id for r in df.collect()]
    assert ids != sorted(ids)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    docs = [(r.doc_id, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert Counter((r.doc_id, r.source, r.replica) for r in df.collect()) == brute_mix(docs, MIX_WEIGHTS, 1.0)


def duck(sql):
    con = duckdb.connect()
    for t in ("documents", "labels", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con.execute(sql)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle_sql(spark, name):
    df = QUERIES[name](spark, SF)
    result = duck(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(r) for r in result.fetchall()), key=str)
    assert sorted((tuple(r[n] for n in names) for r in df.collect()), key=str) == want


# sharding

def check_shards(rows, docs, shards):
    assert Counter((r.doc_id, r.text) for r in rows) == Counter(docs)
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    sizes = [len(by.get(s, [])) for s in range(shards)]
    assert set(by) <= set(range(shards)) and max(sizes) - min(sizes) <= 1


@pytest.mark.parametrize("n,shards,bucket_bytes", [(0, 4, 1000), (1, 4, 1000), (3, 4, 1000), (1003, 40, 3000), (500, 7, 1 << 20)])
def test_shards(spark, make, n, shards, bucket_bytes):
    docs = [(i, f"text {i % 5}") for i in range(n)]
    check_shards(sharding.shuffle_into_shards(make(docs), shards, bucket_bytes=bucket_bytes).collect(), docs, shards)


def test_shards_of_odd_rows_repeat_exactly(spark, make):
    docs = ODD + [(1, "a")] * 40
    runs = [sorted(((r.shard, r.slot, r.doc_id, r.text) for r in
                    sharding.shuffle_into_shards(make(docs).repartition(k), 3).collect()), key=str) for k in (1, 5)]
    assert runs[0] == runs[1]
    check_shards(sharding.shuffle_into_shards(make(docs), 3).collect(), docs, 3)


def test_fisher_yates_is_a_fair_permutation():
    assert sorted(sharding.fisher_yates(1000, [1, 2]).tolist()) == list(range(1000))
    seen = Counter(tuple(sharding.fisher_yates(3, [s, 0]).tolist()) for s in range(6000))
    assert len(seen) == 6 and max(seen.values()) < 1150 and min(seen.values()) > 850
    assert sharding.fisher_yates(0, [1]).tolist() == [] and sharding.fisher_yates(1, [1]).tolist() == [0]


def test_op7_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op7_two_pass_shards"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        raw = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
    sizes = Counter(r.shard for r in rows)
    assert set(sizes) == set(range(40)) and max(sizes.values()) - min(sizes.values()) <= 1


# HTML

ARTICLE = "<h1>Head &amp; line</h1><p>First, longer paragraph, with commas, and <a href='#'>a link</a> in it.<p>Second\n  one &eacute; here"
PARTS = ["<nav><ul><li><a href='/'>Home</a></li></ul></nav>", "<div class='ad'>Buy this, now, really, cheap, today, and more.</div>",
         "<header>Site name</header>", "<aside>Side, bar, text, with, many, commas, in, it</aside>",
         "<div id='cookie-notice'>We use, cookies, here</div>", "<form><p>Your, name</p><input></form>",
         "<script>var x = '<p>no, text</p>';</script>", "<style>p{}</style>", "<!-- <p>gone</p> -->"]
TAIL = ["<div class='comments'><p>Nice, post, thanks, a lot, really, I liked it, very much</p></div>", "<footer>&copy; site</footer>"]
WANT = "Head & line\n\nFirst, longer paragraph, with commas, and a link in it.\n\nSecond one é here"


@pytest.mark.parametrize("box", ["<article>{}</article>", "<main>{}</main>", "<div class='post'>{}</div>",
                                 "<div><div id='content'>{}</div></div>", "<article><div>{}</div></article>"])
def test_article_without_its_surroundings(box):
    page = "<!DOCTYPE html><html><head><title>T</title></head><body>" + "".join(PARTS) + box.format(ARTICLE) + "".join(TAIL)
    assert hx.main_text(page) == WANT
    assert hx.main_text(page + "</body></html>") == WANT


def test_layout_classes_and_comment_articles():
    page = ("<body class='has-sidebar'><div class='masthead'>Site</div><div class='content no-sidebar'><article class='post'>"
            "<div class='post-header'><h1>Head</h1></div><p>Some text, long enough, with commas, to be the article of this page."
            "<div class='share-buttons'>Share this, now</div></article></div>"
            "<div class='thread'><article class='comment'><p>I, too, have, many, commas, and, words, to, say, here.</p></article></div>")
    assert hx.main_text(page) == "Head\n\nSome text, long enough, with commas, to be the article of this page."


PARAGRAPH = "<p>" + "some, words, in, a, paragraph, " + "of an article of the page " * 5 + "</p>"


def shown(*parts):
    import re
    return "\n\n".join(" ".join(x.split()) for part in parts for x in re.split(r"<[^>]*>", part) if x.strip())


@pytest.mark.parametrize("n", [1, 5, 8, 30])
@pytest.mark.parametrize("box", ["article", "main"])
def test_whole_article_at_any_length(n, box):
    head = "<h1>Head</h1><h2>Sub</h2><p>Short.</p>"
    tail = "<ul><li>one</li></ul><table><tr><td>cell</td></tr></table><pre>code</pre><figure><figcaption>fig</figcaption></figure>"
    few = "<section>" + PARAGRAPH * 3 + "</section>"
    page = (f"<body>{''.join(PARTS)}<{box}>{head}<div>{PARAGRAPH * n}</div>{few}{tail}"
            f"<div class='share'><p>Share, it</p></div></{box}>{''.join(TAIL)}")
    assert hx.main_text(page) == shown(head, PARAGRAPH * n, few, tail)


def test_unequal_sections_and_nested_containers():
    many, few = (f"<section>{PARAGRAPH * n}</section>" for n in (20, 3))
    for page in (f"<article>{many}{few}</article>", f"<div class='post'>{few}{many}</div>", f"<body>{many}{few}", f"{many}{few}",
                 f"<article><div><div>{many}</div></div><div>{few}</div></article>"):
        assert hx.main_text("<nav>Go, there</nav>" + page) == shown(*([few, many] if "post" in page else [many, few])), page


def test_siblings_of_a_plain_container():
    links = "<ul><li><a href='/'>One, link</a></li><li><a href='/'>and, more</a></li></ul><div><a href='/'>links, only</a></div>"
    page = (f"<div class='wrap'><h1>Head</h1>Loose <b>words</b><p>Short.</p>{links}<div>{PARAGRAPH * 8}</div>"
            "<ol><li>item</li></ol><pre>code</pre><div>last words</div></div><div>A notice without a name</div>")
    assert hx.main_text("<body>" + page) == "\n\n".join(
        ["Head", "Loose words", "Short.", shown(PARAGRAPH * 8), "item", "code", "last words"])


def test_odd_html():
    assert hx.main_text(None) == hx.main_text("") == hx.main_text("<p></p>") == hx.main_text("<script>x</script>") == ""
    assert hx.main_text("just text") == "just text"
    assert hx.main_text("<article><p>a &lt;b&gt; &#233; &amp") == "a <b> é &"
    assert hx.main_text("<article><ul><li>one<li>two</ul><p>x<br>y") == "one\n\ntwo\n\nx y"
    deep = "<div>" * 3000 + "deep text" + "</div>" * 3000
    assert hx.main_text(deep) == "deep text"
    assert hx.main_text("<article>" + "<p>w</p>" * 20_000) == "\n\n".join(["w"] * 20_000)


def test_extract_rows(spark):
    rows = [(1, "u", None, "x"), (1, "u", None, "x"), (None, None, "<p>hé", "y"), (3, "v", "", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in hx.extract(df).collect()), key=str)
    assert got == sorted([(1, "u", "", 0), (1, "u", "", 0), (None, None, "hé", 2), (3, "v", "", 0)], key=str)
    assert hx.extract(df.limit(0)).count() == 0


def test_op8_query(spark):
    import html
    import re
    for r in QUERIES["op8_tree_scoring"](spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1].replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(x for x in parts if x) and r.n_chars == len(r.text)


# pipeline

def test_pipeline_stages(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "non_toxic", "near_dedup", "source_mix", "tokenize"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.collect()}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, kept, SF)
        assert kept.columns == columns, name
        now = [r.doc_id for r in kept.collect()]
        assert len(now) == len(set(now)) and set(now) <= ids, name
        if name == "quality":
            clean = {i for i in ids if i in labels and labels[i].quality == 1}
            assert len(clean - set(now)) <= 0.05 * len(clean)
        ids = set(now)
    mixed = corpus_pipeline.STAGES[3][1](spark, kept, SF)
    assert mixed.columns == columns
    rows = [(r.doc_id, r.source) for r in kept.collect()]
    assert Counter((r.doc_id, r.source) for r in mixed.collect()) == Counter(
        (i, s) for (i, s, _), n in brute_mix(rows, MIX_WEIGHTS, 1.0).items() for _ in range(n))
    out = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r.doc_id for r in out) == Counter(r.doc_id for r in mixed.collect())
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in out:
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
        assert len(np.frombuffer(r.ids, "<u4")) == r.n_tokens


def test_pipeline_stages_on_odd_rows(spark, make):
    docs = make(ODD)
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, make([]), SF).collect()
    texts = Counter((r.doc_id, r.text) for r in docs.collect())
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        found = Counter((r.doc_id, r.text) for r in out.collect())
        if name == "non_toxic":
            assert found == texts
        elif name == "near_dedup":  # blank texts are one group, as are the equal ones
            assert sorted(((i, t) for i, t in found.elements()), key=str) == sorted(
                [x for x in texts if x[0] in (1, 2, 3, 9, 11, None)], key=str)
        else:
            assert set(found) <= set(texts)
        stage(spark, docs, SF).collect()
