import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbline.llm import langid, lmscore, quality, toxicity
from kerbline.llm.subword import Scorer, Shape, features, train

BIG = "/root/testdata/sf0.01"


def test_scores_are_the_averaged_vectors():
    for shape in (Shape(bits=12), Shape(bits=12, pairs=True, fold_case=False, shortest=1), Shape(bits=12, damp=True)):
        rows = [("good day here here", 0), ("bad stupid day", 1)] * 20
        model, scorer = train(rows, shape, 0.5), None
        scorer = Scorer(model)
        texts = ["good good day", "", "stupidd x", "a a a b", "Bad! " * 500]
        got = scorer(texts)
        for t, g in zip(texts, got, strict=True):
            at, w = features(t, shape)
            want = 1 / (1 + np.exp(-(model.gain * float(w @ model.table[at]) + model.bias)))
            assert abs(g - want) < 1e-5
        assert scorer(["stupid bad"])[0] > 0.5 > scorer(["good day"])[0]
        assert np.allclose(np.concatenate([scorer([t]) for t in texts]), got)


def test_misspellings_share_vectors():
    rows = [(f"the weather on day {i} is fine", 0) for i in range(60)] + [(f"you utter worthless fool {i}", 1) for i in range(60)]
    scorer = Scorer(train(rows, toxicity.SHAPE, 0.5))
    assert scorer(["a worthlesss one"])[0] > scorer(["a weatherr one"])[0]


def test_one_label_gives_the_prior():
    assert abs(Scorer(train([("a b", 1)], Shape(bits=8), 0.25))(["x"])[0] - 0.25) < 1e-6
    assert 0 <= Scorer(train([], Shape(bits=8), 0.5))([""])[0] <= 1


@pytest.mark.parametrize(("query", "column", "folds", "out", "least", "size"), [(quality.op5_quality, "quality", 5, 0, 0.97, "sf0.01"), (toxicity.op2_toxicity, "toxic", 4, 2, 0.93, "sf0.1")])
def test_held_out_accuracy(spark, query, column, folds, out, least, size):
    folder = BIG.replace("sf0.01", size)  # the smallest tables have under forty toxic documents to learn from
    labels = {r.doc_id: r[column] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = query(spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == out) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([p == y for p, y in held]) >= least


def test_scoring_odd_rows(spark, odd, empty):
    model = train([("a b", 1), ("c d", 0)] * 3, Shape(bits=8), 0.5)
    rows = toxicity.score_toxicity(odd, model, keep=["doc_id"]).collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 for r in rows) and rows[1].score == rows[2].score == rows[3].score
    assert toxicity.score_toxicity(empty, model).count() == 0
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert toxicity.fit_toxicity(odd, none).table.any() == False  # noqa: E712
    assert quality.fit_quality(empty, none).bias == 0


def test_languages(spark, odd, empty):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    rows = langid.op4_langid(spark, BIG).collect()
    assert len(rows) == len(lang)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) >= 0.98
    assert np.mean([r.rejected for r in rows]) <= 0.01
    model = langid.fit_languages(docs, F.lit(True), per_language=50)
    got = langid.predict_languages(odd, model, keep=["doc_id"]).collect()
    assert [r.lang_pred for r in got[1:4]] == ["und"] * 3 and all(r.rejected for r in got[1:4])
    assert got[0].lang_pred == got[4].lang_pred == got[5].lang_pred
    assert model.predict(["zzzz qqqq xxxx wwww kkkk jjjj vvvv " * 20])[2][0]
    assert model.predict(["123 !? 45"])[0] == ["und"]
    nothing = langid.fit_languages(empty, F.lit(True))
    assert nothing.predict(["some words"])[0] == ["und"]
    assert langid.predict_languages(empty, model).count() == 0


def test_grams_by_hand():
    flat, who, n = langid.grams(["Ab1c", "", "9", "ab"])
    assert n.tolist() == [3, 0, 0, 2]
    # "ab", a space, "c", a space: characters, pairs and triples; a text without a letter has none
    counts = np.bincount(who, minlength=4)
    assert counts[1] == counts[2] == 0 and counts[0] > counts[3] > 0
    one, _, _ = langid.grams(["ab"])
    two = flat[who == 3]
    assert sorted(one.tolist()) == sorted(two.tolist())


def plain_score(text, model, counts):
    """A text's score by a forward pass for each place, and words' shares from plain counts."""
    words = text.lower().encode().split()
    own = sorted(counts, key=lambda w: (-counts[w], w.decode()))[: lmscore.OWN]
    number = {w: i for i, w in enumerate(own)}
    kind = lambda w: number.get(w, lmscore.shared_class(w.decode()))
    size = Counter()
    for w, n in counts.items():
        size[kind(w)] += n + 1
    seq, net, want = [kind(w) for w in words], model.network, 0.0
    end = lmscore.CLASSES - 1
    for i, c in enumerate(seq):
        around = [*(seq[i - d] if i >= d else end for d in (1, 2)), *(seq[i + d] if i + d < len(seq) else end for d in (1, 2))]
        z = np.maximum(net.embed[around].reshape(-1) @ net.hidden + net.hidden_bias, 0) @ net.out + net.out_bias
        want += z[c] - z.max() - np.log(np.exp(z - z.max()).sum())
        if c >= lmscore.OWN:
            want += np.log((counts[words[i]] + 1) / (size[c] + 1))
    return len(seq), want


@pytest.mark.parametrize("frequent", [lmscore.FREQUENT, 3_000])  # the second joins most words with the table of counts
def test_lm_by_hand(spark, odd, empty, monkeypatch, frequent):
    monkeypatch.setattr(lmscore, "FREQUENT", frequent)
    corpus = spark.read.parquet(f"{BIG}/documents.parquet").limit(200)
    model = lmscore.fit_lm(corpus)
    counts = Counter(w for r in corpus.collect() for w in (r.text or "").lower().encode().split())
    assert len(model.vocabulary.frequent) == sum(n * frequent >= sum(counts.values()) for n in counts.values()) <= frequent
    assert model.counts.count() == len(counts) - len(model.vocabulary.frequent)
    known = [w.decode() for w in sorted(counts)][:500]
    long = " ".join(known[i * 7 % 500] + ("x" if i % 11 == 0 else "") for i in range(lmscore.BLOCK + 3_000))  # more than one block, with unknown words
    rows = spark.createDataFrame([(None, long), (7, None), (7, "The end of THE"), (7, "The end of THE")], "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    texts = [r.text or "" for r in rows.collect()]
    got = lmscore.score_documents(rows, model, keep=["doc_id"]).collect()
    want = [plain_score(t, model, counts) for t in texts]
    assert len(got) == len(want)
    for r, (n, s) in zip(sorted(got, key=lambda r: (r.n_tokens, r.score)), sorted(want), strict=True):
        assert r.n_tokens == n and abs(r.score - s) < 1e-2 + 1e-5 * n
        assert r.per_token == r.score / n if n else r.score == 0 and r.per_token is None
    assert lmscore.score_documents(empty, model).count() == 0
    nothing = lmscore.fit_lm(empty)
    assert nothing.network.embed.shape[0] == lmscore.CLASSES and lmscore.score_documents(rows, nothing, keep=[]).count() == len(texts)


def test_lm_tells_rare_words_by_their_counts(spark):
    docs = spark.createDataFrame([(i, f"filler{i % 250} common{i % 250} " + ("seldom" if i % 300 == 0 else "oftenm")) for i in range(3_000)], "doc_id long, text string")
    model = lmscore.fit_lm(docs)
    ask = spark.createDataFrame([(1, "filler7 seldom"), (2, "filler7 neverm")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in lmscore.score_documents(ask, model).collect()}
    assert got[1] > got[2]


def test_lm_prefers_the_corpus_order(spark):
    docs = spark.createDataFrame([(i, "the small dog ran to the old house and the small cat ran to the old barn") for i in range(200)], "doc_id long, text string")
    model = lmscore.fit_lm(docs)
    score = lambda t: float(model.network.log_chances(model.vocabulary.classes[model.vocabulary.coder()(t)[0]]).sum())
    assert score("the small dog ran to the old house") > score("house the to old dog small ran the")
