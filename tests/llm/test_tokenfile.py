import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from kerbline.llm import tokenfile as tf
from kerbline.llm.bpe import vocabulary

PATH = vocabulary("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def plain(library, rows):
    """doc_id, start, n_tokens, crc32 of (doc_id, text) rows in order."""
    out, start = [], 0
    for doc, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, tf.END]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_runs_cut_where_the_library_does(library):
    parts = ["a", "é", "×", "日本", " ", "  ", "\n", "\t", "\xa0", "　", "\x1c", "\x85", "'s", "'", "don't", "1", "12", "½", ".", ",", "word", "<|endoftext|>", "Σ", "�", "\x00", "’", "🙂", "à", "\xa0 ", "foo\n \nbar"]
    rnd = random.Random(3)
    texts = ["", " ", "  ", "a ", " a", *("".join(rnd.choice(parts) for _ in range(rnd.randint(1, 60))) for _ in range(3000))]
    got = tf.Encoder(PATH).encode(pa.array([*texts, None]))
    for text, ids in zip([*texts, ""], got, strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == [*library.encode(text, add_special_tokens=False).ids, tf.END], repr(text)


def test_forgetting_runs(library, monkeypatch):
    monkeypatch.setattr(tf, "KEPT_RUNS", 3)
    encoder = tf.Encoder(PATH)
    for text in ["one two three four", "four five six", "one two", "seven four " * 5, "x" * 100 + " one"] * 3:
        assert np.frombuffer(encoder.encode(pa.array([text]))[0], "<u2").tolist() == [*library.encode(text, add_special_tokens=False).ids, tf.END]
        assert len(encoder.known) <= 12


@pytest.mark.parametrize("base", [300, 50257, 65534, 70000])
def test_grammar_gives_back_its_ids(base, monkeypatch):
    monkeypatch.setattr(tf, "LEAST_PAIRS", 2)
    rng = np.random.default_rng(base)
    for sizes in ([0], [1], [5, 0, 0, 7], [2000], [1, 1, 1], rng.integers(0, 40, 200).tolist(), [3000, 0, 1]):
        for top in (1, 2, 3, 20, base):
            ids = rng.integers(base - top, base, sum(sizes))
            rules, symbols, counts = tf.grammar(ids, np.array(sizes), base)
            assert counts.sum() == len(symbols) and len(counts) == len(sizes)
            lengths, at, s = tf.rule_lengths(rules, base), 0, 0
            assert all(a < base + i and b < base + i for i, (a, b) in enumerate(rules.tolist()))
            for n, k in zip(sizes, counts.tolist(), strict=True):
                own, want = symbols[s : s + k], ids[at : at + n]
                assert tf.expand(own, rules, base).tolist() == want.tolist()
                for _ in range(3):
                    lo, hi = sorted(rng.integers(0, n + 1, 2).tolist())
                    assert tf.slice_ids(own, rules, lengths, base, lo, hi).tolist() == want[lo:hi].tolist()
                at, s = at + n, s + k
    ids = np.tile([base - 1, base - 2, base - 3], 1000)
    assert len(tf.grammar(ids, np.array([3000]), base)[1]) < (3000 if base == 65534 else 300)


def test_files_of_all_documents(spark, sf_dir, library):
    got = tf.op13_token_ids(spark, sf_dir).collect()
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == plain(library, docs)


def test_odd_rows(spark, odd, empty, library):
    folder = tf.new_folder(spark, "odd")
    tf.write_ids(odd.repartition(3), folder, PATH, shard=1000, parts=5)
    got = sorted(tf.read_documents(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 4, 5, 5, 6, 7, 8]
    texts = {r.doc_id: r.text for r in odd.collect()}
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == plain(library, [(r.doc_id, texts[r.doc_id]) for r in got])
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    assert got[2].ids == [tf.END] == got[3].ids
    whole = next(r.ids for r in got if r.doc_id == 8)
    assert [r.ids for r in tf.read_range(spark, folder, 8, 100, 160).collect()] == [whole[100:160]]
    assert len(tf.read_range(spark, folder, 5).collect()) == 2 and not tf.read_range(spark, folder, 99).collect()
    nothing = tf.new_folder(spark, "empty")
    tf.write_ids(empty, nothing, PATH)
    assert tf.read_documents(spark, nothing).count() == 0


def test_a_frequent_id_fills_several_parts(spark, library):
    rows = [(7, f"text number {i}") for i in range(300)] + [(i, "x y") for i in range(100)] + [(None, "none")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    parts = tf.encode_sorted(docs, PATH, 8).where("doc_id = 7").groupBy("part").count().collect()
    assert len(parts) > 2 and max(r["count"] for r in parts) < 200
    folder = tf.new_folder(spark, "hot")
    tf.write_ids(docs, folder, PATH, shard=100, parts=8)
    got = sorted(tf.read_documents(spark, folder).collect(), key=lambda r: r.start)
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids) and len(got) == len(rows)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:], strict=False)) and got[0].start == 0
