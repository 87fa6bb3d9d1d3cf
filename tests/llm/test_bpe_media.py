import hashlib
import io
import wave
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kerbline.llm import bpe, media


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.Spec(bpe.vocabulary()))


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(bpe.vocabulary())


def test_same_as_the_library(codec, library, spark, sf_dir):
    texts = [r[0] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    texts += ["", " ", "Hello  World's <|endoftext|> é", "a\x1cb \x1f", "Σας ΣΑΣ", "<|startoftext|>x<|endoftext|><|", "é İ", "a" * 3000, " x y", "don't we'LL"]
    want = library.encode_batch(texts, add_special_tokens=False)
    got = codec.encode(texts)
    assert got == [w.ids for w in want]
    assert [codec.decode(i) for i in got] == [library.decode(w.ids, skip_special_tokens=False) for w in want]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=("Cs",)), max_size=60))
def test_any_text_as_the_library(codec, library, text):
    assert codec.encode([text])[0] == library.encode(text, add_special_tokens=False).ids


def test_all_code_points_as_the_library(codec, library):
    """Every code point that Unicode has assigned, and some of the others, between letters, between digits and doubled, a hundred in a text."""
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and (c < 0x33480 or 0xE0000 <= c < 0xE0200 or not c % 97)]
    texts = ["".join(f"a{chr(c)}b 1{chr(c)}2 {chr(c)}{chr(c)} " for c in points[lo : lo + 100]) for lo in range(0, len(points), 100)]
    for lo in range(0, len(texts), 500):
        assert codec.encode(texts[lo : lo + 500]) == [w.ids for w in library.encode_batch(texts[lo : lo + 500], add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("漢字かなカナ한글ᄀ\u11a8🙂👩\u200d👩🏽\ufe0fé́ǅİıſK\U00010d50\u1c89ⅣⅨ٣a1 '"), max_size=40))
def test_scripts_and_emoji_as_the_library(codec, library, text):
    assert codec.encode([text])[0] == library.encode(text, add_special_tokens=False).ids


def test_scan_equals_heap(codec):
    words = ["thereandbackagain", "aaaaaaaaab", "supercalifragilistic", "zzxqj"]
    scanned = [codec.exact(w) for w in words]
    keep, bpe.SCANNED = bpe.SCANNED, 0
    try:
        assert [codec.exact(w) for w in words] == scanned
    finally:
        bpe.SCANNED = keep


def test_odd_rows(odd, empty, library):
    rows = bpe.digests(bpe.encode_decode(odd, bpe.vocabulary(), keep=["doc_id"]), "doc_id").collect()
    texts = [r.text or "" for r in odd.collect()]
    for r, t in zip(rows, texts, strict=True):
        ids = library.encode(t, add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_decode(empty, bpe.vocabulary(), keep=["doc_id"]).count() == 0


def test_media_round_trip(odd, empty):
    rows = media.media_columns(odd, keep=["doc_id"]).collect()
    for r, t in zip(rows, [x.text or "" for x in odd.collect()], strict=True):
        raw = t.encode()
        assert r.n_bytes == len(raw)
        assert bytes(r.payload).rstrip(b"\0") == raw.rstrip(b"\0") and len(r.payload) % 64 == 0 and len(r.payload) >= max(64, len(raw))
        with wave.open(io.BytesIO(bytes(r.media))) as w:
            assert w.readframes(w.getnframes()) == bytes(r.payload)
        assert r.fingerprint == media.fingerprint(bytes(r.payload)).tolist()
    assert media.media_columns(empty, keep=["doc_id"]).count() == 0


def test_media_query(spark, sf_dir):
    rows = {r.doc_id: r for r in media.op10_media(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for d in docs[:40]:
        n, payload = media.payload_of(d.text or "")
        r, stored = rows[d.doc_id], media.to_wav(payload)
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (n, len(payload), len(stored))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.media_sha256 == hashlib.sha256(stored).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-64:])


def test_fingerprint_tells_a_tone():
    import numpy as np

    tone = lambda k: (128 + 100 * np.sin(2 * np.pi * k * np.arange(2560) / 256)).astype(np.uint8).tobytes()
    assert set(media.peaks(tone(20)).tolist()) == {19} and set(media.peaks(tone(40)).tolist()) == {39}
    assert set(media.peaks(b"\0" * 512).tolist()) == {-1} and len(media.fingerprint(b"\0" * 512)) == 0
    codes = media.fingerprint(tone(20))
    assert (np.diff(codes >> 16) >= 0).all() and set(((codes >> 9) & 127).tolist()) == {19}


def test_short_texts_are_told_apart():
    texts = ["a cat", "a dog", "the cat sat on the mat", "the cat sat on the hat", "x" * 63 + "y", "one two three " * 18, "one two four " * 19, "x" * 191 + "y"]
    prints = [tuple(media.fingerprint(media.payload_of(t)[1]).tolist()) for t in texts]
    assert all(prints) and len(set(prints)) == len(texts)
    assert not len(media.fingerprint(b"x" * 128)) and not len(media.fingerprint(media.payload_of("")[1]))
    assert any(code & 3 == 0 for code in prints[2])


def test_frames_overlap():
    import numpy as np

    rng = np.random.default_rng(3)
    payload = rng.integers(0, 256, 1024, np.uint8).tobytes()
    blank = lambda lo, hi: payload[:lo] + b"\x80" * (hi - lo) + payload[hi:]
    whole = media.fingerprint(payload).tolist()
    assert all(media.fingerprint(blank(lo, lo + 32)).tolist() != whole for lo in range(0, 1024, 32))  # seams and edges count too
    assert len(media.frame_peaks(payload)) == 1024 // media.HOP + 1
    keep, media.FRAMES_AT_ONCE = media.FRAMES_AT_ONCE, 2
    try:
        assert media.fingerprint(payload).tolist() == whole
    finally:
        media.FRAMES_AT_ONCE = keep
