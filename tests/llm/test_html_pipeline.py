import re
from html import unescape

import numpy as np
import pytest

import corpus_pipeline
from kerbline.llm import bpe, decontam, htmltext, langid, toxicity
from kerbline.llm.htmltext import Page, decode, extract

from .test_pairs import brute


@pytest.fixture(scope="module")
def trees():
    return htmltext.fit_pages()


def expected(html):
    body = re.sub(r"</?(?:p|h1|br)>", "\n", re.search(r"<article>(.*?)</article>", html, re.S)[1])
    blocks = (" ".join(unescape(b).split()) for b in re.sub(r"<[^>]+>", "", body).split("\n"))
    return " ".join(b for b in blocks if b)


def test_pages_of_the_table(spark, trees, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = htmltext.main_texts(pages, trees, keep=["page_id"]).collect()
    want = [expected(r.html) for r in pages.collect()]
    assert np.mean([g.text == w for g, w in zip(got, want, strict=True)]) >= 0.98
    assert all(g.n_chars == len(g.text) for g in got)


def test_held_out_sample_pages(trees):
    rng = np.random.default_rng(12345)
    exact = 0
    for _ in range(150):
        page, marked, clutter = htmltext._marked(htmltext.sample_page(rng))
        want = page.main(htmltext.truth(page, marked, clutter))
        exact += page.main(decode(page.parents, trees.chance(htmltext.features(page)))) == want
    assert exact >= 120


A = "The council met on Tuesday to discuss the new bridge over the river, which has been planned for ten years."
B = "Work is to begin in spring and to last until the end of next year, if the weather allows it."
C = "Cyclists will have a lane of their own on either side, two metres wide and apart from the cars."
NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/sport">Sport</a></li></ul></nav>'
FOOT = "<footer><p>&copy; 2024 The Daily Paper. All rights reserved.</p></footer>"


@pytest.mark.parametrize(
    "html, want",
    [
        (f"<html><body><h1>A new bridge</h1><p>{A}</p><p>{B}</p></body></html>", f"A new bridge {A} {B}"),
        (f"<h1>A new bridge</h1><p>{A}</p><p>{B}</p><p>{C}</p>", f"A new bridge {A} {B} {C}"),
        (f'<html><body>{NAV}<article class="post no-comments"><h1>A new bridge</h1><p>{A}</p><p>{B}</p></article>{FOOT}</body></html>', f"A new bridge {A} {B}"),
        (f'<html><body>{NAV}<article><h1>A new bridge</h1><p>{A}</p><p>{B}</p></article><div id="disqus_thread"><div class="post-message"><span class="author">Ann</span><p>I do not like it at all.</p></div><div class="post-message"><span class="author">Bob</span><p>Well, I do, it is about time.</p></div></div>{FOOT}</body></html>', f"A new bridge {A} {B}"),
        (f'<html><body><div class="menu"><a href="/a">One</a> | <a href="/b">Two</a></div><div id="content"><h2>A new bridge</h2><p>{A}</p><ul><li>{B}</li><li>{C}</li></ul></div><div class="sidebar"><h3>Related</h3><a href="/x">Old bridges</a></div></body></html>', f"A new bridge {A} {B} {C}"),
        (f'<html><body>{NAV}<main><article><h1>A new bridge</h1><p>{A}</p><div class="ad">Buy now, pay later!</div><p>{B}</p></article></main>{FOOT}</body></html>', f"A new bridge {A} {B}"),
    ],
)
def test_pages_written_by_hand(trees, html, want):
    assert extract([html], trees) == [want]


def test_reading():
    keep_all = lambda h: Page(h).main(np.ones(len(Page(h).tags), bool))
    assert keep_all("<p>a &amp; b<p>c<b>d</b>e<br>f") == "a & b cde f"
    assert keep_all("<script>x < y; '</p>'</script>one<!-- <p>no</p> --> two<style>p{}</style>") == "one two"
    assert keep_all("<div title='a > b'>x\n\n y</div></div></p>z") == "x y z"
    assert keep_all("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>") == "a b c d"
    assert keep_all("<title>t</title><p>5 < 6 <unclosed 'quote") == "5 < 6 <unclosed 'quote"
    assert keep_all("") == "" and keep_all("<") == "<"


def test_no_text_inside_clutter():
    parents = [-1, 0, 1, 2, 1]
    kept = decode(parents, np.array([0.1, 0.9, 0.01, 0.6, 0.9]))
    assert kept.tolist() == [False, True, False, False, True]


def test_odd_pages(spark, trees):
    pages = spark.createDataFrame([(1, None, None), (2, "u", ""), (2, "u", "<p>"), (3, "u", "<div>" * 3000 + "deep"), (4, "u", "<article>" + "<p>long words here.</p>" * 20000 + "</article>")], "page_id long, url string, html string").selectExpr("*", "'x' as text", "1 as n_chars")
    rows = htmltext.main_texts(pages, trees, keep=["page_id", "url"]).collect()
    assert [r.text for r in rows[:3]] == ["", "", ""] and rows[4].n_chars == len("long words here. ") * 20000 - 1
    assert htmltext.main_texts(pages.limit(0), trees, keep=["page_id"]).count() == 0


def test_boosting_learns():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 32, (2000, 6)).astype(np.uint8)
    y = ((x[:, 1] > 15) ^ (x[:, 3] > 7)).astype(float)
    model = htmltext.boost(x[:1500], y[:1500], trees=30, depth=3)
    assert ((model.chance(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95


def test_pipeline_stage_by_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    first = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        before = docs.collect()
        after = {r.doc_id for r in out.collect()}
        if i < 4:
            assert out.columns == first.columns
        if name == "language_id":
            model = langid.fit_languages(docs, ~langid.in_fold("doc_id", 1, 5))
            rejected = model.predict([r.text or "" for r in before])[2]
            want = {r.doc_id for r, x in zip(before, rejected, strict=True) if not x}
        elif name == "toxicity":
            scorer = toxicity.score_texts(docs, toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), "text", ["doc_id"])
            want = {r.doc_id for r in scorer.collect() if r.score < 0.3}
        elif name == "near_duplicates":
            want = {i for i, (c, _) in brute([(r.doc_id, r.text) for r in before], 5).items() if c == i}
        elif name == "decontamination":
            found = {r.doc_id for r in decontam.matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
            words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())
            sets = lambda w: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
            items = [sets(words(r.text)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            held = {r.doc_id for r in before if any(len(s & sets(words(r.text))) * 100 >= 80 * len(s) for s in items if s)}
            assert found == held
            want = {r.doc_id for r in before} - held
        else:
            want = {r.doc_id for r in before}
        assert after == want and after
        docs = spark.createDataFrame([r for r in before if r.doc_id in after], first.schema) if i < 4 else docs
    assert corpus_pipeline.run(spark, sf_dir).count() == len(after)
    assert bpe.vocabulary().endswith(".json") and extract([], None) == []
