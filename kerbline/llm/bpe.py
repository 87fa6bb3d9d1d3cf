"""BPE encoding and decoding by speculation and verification.

A vocabulary file in the tokenizers JSON format is read on the driver and sent to the workers.
For each new word, greedy longest match proposes tokens. A proposal is the true encoding if every
token is one that BPE builds from its own characters and every adjacent pair is compatible: no
merge across their border would come before the merges that built the two sides. Both conditions
are checked for all words of a chunk at once with numpy, over tables of the tokens' inner edges.
Only the words that fail are merged exactly, with a heap, so long words cost n log n.

Null texts count as empty, and an empty text has no tokens and decodes to the empty text. Texts
are never cut. Supported: NFC, white space to one space, lower case; the split pattern of the file,
byte-level characters, a suffix at word ends, added tokens matched in the raw text, no decoder
(tokens joined by a space). Other files raise an error.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, table

#: Words and white-space-free runs kept in a worker's memory before it starts anew.
CACHE_ENTRIES = 600_000
#: Bytes of text encoded at once.
CHUNK = 1_000_000
#: Characters that Python's split takes for white space and the tokenizers don't.
SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Words of up to so many symbols are merged by scanning, longer ones with a heap.
SCANNED = 64
PAIR_MULTIPLY, PAIR_SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(44)
NEVER = np.int64(2**40)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in set(plain) else chr(next(others)) for b in range(256)]


# Code points that newer Unicode data call letters or numbers and the tokenizers library's split doesn't.
LATE_LETTERS = """
558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB
11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191
191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4
1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F
"""
# Capitals that the library lowers and Python's older data don't know, with the first one's lower case; of a range the others follow.
LATE_CAPITALS = "1C89:1C8A A7CB:264 A7CC:A7CD A7CE:A7CF A7D2:A7D3 A7D4:A7D5 A7DA:A7DB A7DC:19B 10D50-10D65:10D70 16EA0-16EB8:16EBB"


def _ranges(given: str) -> list[tuple[int, int]]:
    """First and last code points of a list of hexadecimal ranges."""
    ends = [r.split("-") for r in given.split()]
    return [(int(r[0], 16), int(r[-1], 16)) for r in ends]


def _lower_of() -> dict[int, str]:
    out = {}
    for pair in LATE_CAPITALS.split():
        given, low = pair.split(":")
        [(first, last)] = _ranges(given)
        out |= {c: chr(int(low, 16) + c - first) for c in range(first, last + 1)}
    return out


LATE_LOWER = _lower_of()
LATE_CLASS = "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in _ranges(LATE_LETTERS))
is_late_capital = regex.compile("[" + "".join(map(chr, LATE_LOWER)) + "]").search


class Spec:
    """What a vocabulary file says, in a small form to send to workers."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.raw = f.read()
        self.key = hashlib.sha256(self.raw.encode()).hexdigest()
        Codec(self)  # raises here for files that aren't supported


_CODECS: dict[str, "Codec"] = {}


def codec_of(spec: Spec) -> "Codec":
    """One codec for all tasks of a worker process."""
    if spec.key not in _CODECS:
        _CODECS[spec.key] = Codec(spec)
    return _CODECS[spec.key]


class Runs(dict):
    """Token ids of runs as bytes of 32-bit numbers; a run met for the first time gets a buffer that is filled at the end of the chunk."""

    def __init__(self, *known):
        super().__init__(*known)
        self.new: dict[str, bytearray] = {}

    def __missing__(self, run: str) -> bytearray:
        ids = self[run] = self.new[run] = bytearray()
        return ids


def packed(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


class Codec:
    def __init__(self, spec: Spec):
        j = json.loads(spec.raw)
        model, pre = j["model"], j["pre_tokenizer"]
        kinds = [n["type"] for n in j["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or j["decoder"] is not None or model["byte_fallback"] or model["ignore_merges"]:
            raise ValueError("unsupported tokenizer file")
        split, level = pre["pretokenizers"]
        if split["behavior"] != "Removed" or not split["invert"] or level["type"] != "ByteLevel" or level["use_regex"] or level["add_prefix_space"]:
            raise ValueError("unsupported pre-tokenizer")
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in j["added_tokens"]):
            raise ValueError("unsupported added token")
        self.suffix = model["end_of_word_suffix"]
        self.vocab = model["vocab"]
        self.added = {t["content"]: t["id"] for t in j["added_tokens"]}
        self.is_added = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")")
        pattern = split["pattern"]["Regex"]
        pattern = pattern.replace(r"[^\s\p{L}\p{N}]", f"[[^\\s\\p{{L}}\\p{{N}}]||[{LATE_CLASS}]]")
        pattern = pattern.replace(r"[\p{L}]", f"[\\p{{L}}--[{LATE_CLASS}]]").replace(r"[\p{N}]", f"[\\p{{N}}--[{LATE_CLASS}]]")
        self.pieces = regex.compile(pattern, regex.V1).findall
        self.spaces = regex.compile(r"\s+")
        self.letters = byte_alphabet()
        self.table = dict(enumerate(self.letters))
        self.names = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.added.items()}
        self._tables(model["merges"])
        self.words: dict[str, bytes] = {}
        self.spellings = pa.array([self.names.get(i, "") for i in range(max(self.names) + 1)])
        self.runs = Runs({a: packed([i]) for a, i in self.added.items()})
        # A table of pairs that were checked before; of those that share a place the last stays.
        self.pair_keys, self.pair_clash = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)
        self.exact_words = self.seen_words = 0

    def _tables(self, merges: list) -> None:
        n = max(self.vocab.values()) + 1
        self.n = n
        self.left, self.right = np.full(n, -1), np.full(n, -1)
        self.rank = np.full(n, -1, np.int64)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in merges):
            x, y, z = self.vocab[a], self.vocab[b], self.vocab[a + b]
            if (x, y) not in self.merge:
                self.merge[x, y] = (r, z)
            if self.rank[z] < 0:
                self.left[z], self.right[z], self.rank[z] = x, y, r
        keys = np.array([x * n + y for x, y in self.merge], np.int64)
        ranks = np.array([r for r, _ in self.merge.values()], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], ranks[order]
        # The tokens along a token's inner edge, the outermost first, and when each one is used up.
        self.right_edge, self.right_end = self._edge(self.right)
        self.left_edge, self.left_end = self._edge(self.left)
        merged = np.flatnonzero(self.rank >= 0)
        clash = np.zeros(n, bool)
        for part in np.array_split(merged, max(1, len(merged) // 4096)):
            clash[part] = self._clash(self.left[part], self.right[part], own=True)
        self.sound = ~clash
        for t in merged[np.argsort(self.rank[merged])]:
            self.sound[t] &= self.sound[self.left[t]] and self.sound[self.right[t]]
        # The longest token that begins with two given characters.
        self.longest: dict[str, int] = {}
        for name in self.vocab:
            bare = name.removesuffix(self.suffix)
            self.longest[bare[:2]] = max(len(bare), self.longest.get(bare[:2], 1))
        self.after: list[dict[int, int]] = [{} for _ in range(n)]  # left token -> right token -> rank
        self.made: dict[int, int] = {}
        for (x, y), (r, z) in self.merge.items():
            self.after[x][y], self.made[r] = r, z

    def _edge(self, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        edge, end = [np.arange(self.n)], [np.full(self.n, NEVER)]
        while True:
            now = edge[-1]
            step = np.where(now >= 0, inner[now], -1)
            if (step < 0).all():
                return np.stack(edge, 1), np.stack(end, 1)
            edge.append(step)
            end.append(np.where(step >= 0, self.rank[now], -1))

    def _clash(self, a: np.ndarray, b: np.ndarray, own: bool = False) -> np.ndarray:
        """Whether BPE would merge across the border of a and b. own: leaving out the merge of a and b themselves."""
        out = np.zeros(len(a), bool)
        for i in range(self.right_edge.shape[1]):
            x, x_end = self.right_edge[a, i], self.right_end[a, i]
            if (x < 0).all():
                break
            for k in range(self.left_edge.shape[1]):
                y, y_end = self.left_edge[b, k], self.left_end[b, k]
                if (y < 0).all():
                    break
                if own and not i and not k:
                    continue
                key = np.where((x >= 0) & (y >= 0), x * self.n + y, -1)
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                r = np.where(self.keys[at] == key, self.ranks[at], NEVER)
                # Equal ranks go to the leftmost place: a's own merge stands before the border, b's after it.
                out |= (r < NEVER) & (r < x_end) & (r <= y_end)
        return out

    def propose(self, symbols: str) -> list[int] | None:
        """Greedy longest match over a word in byte-level characters; None if a character has no token."""
        out, at, n, get, longest, whole = [], 0, len(symbols), self.vocab.get, self.longest.get, symbols + self.suffix
        while at < n:
            end = at + longest(symbols[at : at + 2], 1)
            if end >= n:
                t = get(whole[at:])
                end = n - 1
            else:
                t = None
            if t is not None:
                out.append(t)
                return out
            while end > at:
                t = get(symbols[at:end])
                if t is not None:
                    out.append(t)
                    break
                end -= 1
            else:
                return None
            at = end
        return out

    def exact(self, symbols: str) -> list[int]:
        """The merges one after another, the lowest rank and then the leftmost first."""
        ids = [self.vocab.get(c) for c in symbols[:-1]] + [self.vocab.get(symbols[-1] + self.suffix)]
        ids = [t for t in ids if t is not None]
        n = len(ids)
        if n <= SCANNED:
            return self.scan(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := self.merge.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, x, y, z = heapq.heappop(heap)
            k = after[i]
            if ids[i] != x or k < 0 or ids[k] != y:
                continue
            ids[i], ids[k] = z, -1
            after[i] = after[k]
            if after[i] >= 0:
                before[after[i]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q >= 0 and (m := self.merge.get((ids[p], ids[q]))):
                    heapq.heappush(heap, (m[0], p, ids[p], ids[q], m[1]))
        return [t for t in ids if t >= 0]

    def scan(self, ids: list[int]) -> list[int]:
        """The same merges for a short word, looking for the next one in the list of ranks."""
        after, made, none = self.after, self.made, len(self.merge) * 2
        ranks = [after[x].get(y, none) for x, y in zip(ids, ids[1:])]
        while ranks:
            r = min(ranks)
            if r == none:
                break
            i = ranks.index(r)
            z = ids[i] = made[r]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = after[ids[i - 1]].get(z, none)
            if i < len(ranks):
                ranks[i] = after[z].get(ids[i + 1], none)
        return ids

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """Encodes new words together: proposals, one check of all tokens and pairs, exact merges for the rest."""
        if len(self.words) + len(words) > CACHE_ENTRIES // 3:
            self.words.clear()
        self.seen_words += len(words)
        symbols = [w if w.isascii() and w.isalpha() else w.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.table) for w in words]
        made = [self.propose(s) for s in symbols]
        flat = np.array([t for m in made for t in m or (0,)], np.int64)
        sizes = np.array([len(m) if m else 1 for m in made])
        starts = np.cumsum(sizes) - sizes
        bad = ~self.sound[flat]
        pairs = flat[:-1] * self.n + flat[1:]
        inside = np.ones(len(pairs), bool)
        inside[starts[1:] - 1] = False
        slot = (pairs.view(np.uint64) * PAIR_MULTIPLY) >> PAIR_SHIFT
        new = np.unique(pairs[inside & (self.pair_keys[slot] != pairs)])
        clash = self._clash(new // self.n, new % self.n)
        at = (new.view(np.uint64) * PAIR_MULTIPLY) >> PAIR_SHIFT
        known = self.pair_keys[slot] == pairs
        bad[:-1] |= inside & known & self.pair_clash[slot]
        rest = np.flatnonzero(inside & ~known)
        bad[rest] |= clash[np.searchsorted(new, pairs[rest])]
        self.pair_keys[at], self.pair_clash[at] = new, clash
        out: dict[str, bytes] = {}
        failed = np.logical_or.reduceat(bad, starts)
        for word, s, m, f in zip(words, symbols, made, failed, strict=True):
            if m is None or f:
                self.exact_words += 1
                m = self.exact(s)
            out[word] = self.words[word] = packed(m)
        return out

    def split(self, text: str) -> list[str]:
        """The runs without white space."""
        return self.spaces.split(text) if any(c in text for c in SEPARATORS) else text.split()

    def cut(self, run: str) -> list[str]:
        """The words of a run, normalised: NFC, then lower case character by character, without a special rule for a final sigma."""
        if not run.isascii():
            run = unicodedata.normalize("NFC", run).replace("Σ", "σ")
            if is_late_capital(run):
                run = run.translate(LATE_LOWER)
        run = run.lower()
        return [run] if run.isalpha() else self.pieces(run)

    def encode_all(self, texts: list[str]) -> pa.ListArray:
        """The ids of all texts."""
        runs: list[list[str]] = []  # of all texts; an added token is a run of its own
        for t in texts:
            if "<|" in t:
                runs.append([r for p in self.is_added.split(t) for r in ([p] if p in self.added else self.split(p))])
            else:
                runs.append(self.split(t))
        if len(self.runs) > CACHE_ENTRIES:
            self.runs = Runs({a: packed([i]) for a, i in self.added.items()})
        known = self.runs
        found = [list(map(known.__getitem__, rs)) for rs in runs]
        new, known.new = known.new, {}
        cut = [self.cut(r) for r in new]
        words = set().union(*cut)
        have = {w: m for w in words if (m := self.words.get(w)) is not None}
        if len(have) < len(words):
            have |= self.learn([w for w in words if w not in have])
        for ids, ws in zip(new.values(), cut, strict=True):
            for w in ws:
                ids += have[w]
        each = [b"".join(ms) for ms in found]
        offsets = np.cumsum([0, *map(len, each)]) // 4
        flat = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(each))])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)

    def decode_all(self, ids: pa.ListArray) -> pa.Array:
        """The texts of lists of ids: the tokens' spellings joined by a space."""
        return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, self.spellings.take(ids.values)), " ")

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.encode_all(texts).to_pylist()

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(pa.array([ids], pa.list_(pa.int32())))[0].as_py()


ENCODED = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])


def encode_decode(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Token ids of each text and the text decoded from those ids.

    path: the vocabulary file, opened on the driver only. A map over rows, without a shuffle.
    """
    spec = df.sparkSession.sparkContext.broadcast(Spec(path))

    def make():
        codec = codec_of(spec.value)

        def work(texts):
            ids = codec.encode_all(texts)
            return ids, codec.decode_all(ids)

        return work

    return map_texts(df, text, ENCODED, make, keep if keep is not None else [c for c in df.columns if c != text], CHUNK)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def digests(encoded: DataFrame, *keep: str) -> DataFrame:
    return encoded.select(
        *keep,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    """Token counts and digests of all documents; null texts count as empty."""
    return digests(encode_decode(table(spark, sf_dir, "documents"), vocabulary(), keep=["doc_id"]), "doc_id")


QUERIES = {"op7_bpe": op7_bpe}
ORACLES: dict[str, str] = {}
