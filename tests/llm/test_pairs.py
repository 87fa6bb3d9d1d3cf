import re
from collections import defaultdict

import duckdb
import pytest

from kerbline.llm import components, decontam, licenses, neardup


def tables(sf_dir):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize(("name", "module"), [("op1_licenses", licenses), ("op6_decontamination", decontam)])
def test_as_sql(spark, sf_dir, name, module):
    got, duck = module.QUERIES[name](spark, sf_dir), tables(sf_dir)
    names = [r[0] for r in duck.execute(f"DESCRIBE {module.ORACLES[name]}").fetchall()]
    want = [dict(zip(names, r, strict=True)) for r in duck.execute(module.ORACLES[name]).fetchall()]
    assert sorted(got.columns) == sorted(names) and want
    assert sorted(tuple(plain(r[n]) for n in names) for r in got.collect()) == sorted(tuple(plain(r[n]) for n in names) for r in want)


def test_license_places(spark):
    docs = spark.createDataFrame([(1, "x MIT\nLicense, mit license. Mit License"), (2, None), (3, ""), (4, "cc by cc by"), (5, "all rights\nreserved"), (6, "ALL rights — reserved!"), (7, "amit license"), (8, "émit license mit licenses")], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.license_scan(docs.selectExpr("*", "1 as key", "2 as best", "'q' as labels")).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (7, 3, 1, 5, "mit")
    assert (got[2].n_words, got[2].n_base, got[2].first_word, got[2].labels, got[2].score) == (0, 0, None, "", 0.0)
    assert (got[4].n_base, got[4].first_word, got[4].last_word) == (2, 0, 2)
    assert got[5].labels == "" and got[6].labels == "all-rights-reserved" and got[6].score == 1.0
    assert got[7].n_base == got[8].n_base == 0
    assert licenses.license_scan(docs.limit(0)).count() == 0


def shingles_of(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute(docs, width):
    sets = [(i, shingles_of(t, width)) for i, t in docs if i is not None]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    inverted = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for g in s:
            inverted[g].append(k)
    for k, (_, s) in enumerate(sets):
        for j in {j for g in s for j in inverted[g] if j < k}:
            common = len(s & sets[j][1])
            if 100 * common >= 80 * (len(s) + len(sets[j][1]) - common):
                parent[find(k)] = find(j)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(i, least.get(find(k), i))
    return {i: (least[find(k)], len(s)) for k, (i, s) in enumerate(sets)}


@pytest.mark.parametrize("width", [2, 5])
def test_groups_as_brute_force(spark, sf_dir, width):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    want = brute([tuple(r) for r in docs.collect()], width)
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in neardup.near_duplicates(docs, width).collect()}
    assert got == want and len({c for c, _ in want.values()}) < len(want)


def test_groups_of_odd_rows(spark, odd, empty):
    got = neardup.near_duplicates(odd, 2).collect()
    assert len(got) == 10
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert by[1][0].component_id == 1 and [r.component_id for r in by[5]] == [1, 1] and not by[5][0].kept
    assert by[2][0].component_id == 2 and by[3][0].component_id == 3 and by[2][0].n_shingles == 0
    assert by[None][0].component_id is None and by[None][0].kept
    assert neardup.near_duplicates(empty, 2).count() == 0
    kept = neardup.keep_one(odd, 2)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 7, 8]


def test_a_large_group_of_near_copies(spark):
    import random

    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    docs = []
    for i in range(600):
        words = list(base)
        for _ in range(rng.randrange(0, 9)):
            words[rng.randrange(120)] = f"v{rng.randrange(10**6)}"
        docs.append((i, " ".join(words)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    want = {i: c for i, (c, _) in brute(docs, 2).items()}
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(frame, 2).collect()} == want


def _crowd(seed: int, n: int, edits: list[int], lengths: list[int], size: int = 100):
    import random

    rng = random.Random(seed)
    fresh = lambda: f"v{rng.randrange(10**9)}"
    base, docs = [fresh() for _ in range(size)], []
    for i in range(n):
        words = list(base)
        for at in rng.sample(range(size), rng.choice(edits)):
            words[at] = fresh()
        docs.append((i, " ".join(words[: rng.choice(lengths)])))
    return docs


def test_crowds_by_shingles(spark, monkeypatch):
    docs = _crowd(5, 160, [2, 4, 5, 6, 8, 20], [100, 96, 85])  # one template, edited to about the limit of similarity
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    rows = neardup.described(frame, 2, "text", ["doc_id"]).selectExpr("node", "doc_id AS rep", "n_shingles AS size", "doc_id % 5 AS root", "sig").cache()
    of = {r.rep: r.node for r in rows.collect()}
    sets = [(of[i], i % 5, shingles_of(t, 2)) for i, t in docs]
    want = {tuple(sorted((m, n))) for k, (m, r, s) in enumerate(sets) for n, q, t in sets[:k] if r != q and 100 * len(s & t) >= 80 * len(s | t)}
    for buckets in (neardup.BUCKETS, 16):  # crowded buckets spoil the order, but lose nothing
        monkeypatch.setattr(neardup, "BUCKETS", buckets)
        got = {tuple(r) for r in neardup.crowd_pairs(rows, frame, 2, 80, "text", "doc_id").collect()}
        assert want and want <= got and all(a < b for a, b in got)
    one = rows.selectExpr("node", "rep", "size", "0L AS root", "sig")
    assert neardup.crowd_pairs(one, frame, 2, 80, "text", "doc_id").count() == 0


@pytest.mark.parametrize("crowd, rows_at_once", [(4, 7), (4, 50_000), (32, 50_000)])
def test_crowds_as_brute_force(spark, monkeypatch, crowd, rows_at_once):
    """However small regions and parts are cut, every group is found."""
    docs = _crowd(6, 260, [1, 3, 4, 5, 6, 7, 9, 14], [100, 97, 90])
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(neardup, "CROWD", crowd)
    monkeypatch.setattr(neardup, "ROWS_AT_ONCE", rows_at_once)
    found = {r.doc_id: r.component_id for r in neardup.near_duplicates(frame, 2).collect()}
    assert found == {i: c for i, (c, _) in brute(docs, 2).items()}


@pytest.mark.parametrize("n", [300, 1200])
def test_boilerplate_makes_few_candidates(spark, n):
    """Documents of one template that aren't near-duplicates (similarity 0.7) meet in all trees; candidates stay a few for each."""
    docs = _crowd(7, n, [9], [100])
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    rows = neardup.described(frame, 2, "text", ["doc_id"]).selectExpr("node", "doc_id AS rep", "n_shingles AS size", "node AS root", "sig").cache()
    met = neardup.region_pairs(neardup.tree_rows(rows, range(neardup.TREES)), 80).cache()
    crowds = neardup.crowded(met)
    assert crowds.count() > 0.9 * n
    by_shingles = neardup.crowd_pairs(rows.join(crowds, "node"), frame, 2, 80, "text", "doc_id").count()
    assert met.where("tree IS NULL").select("a", "b").distinct().count() + by_shingles < 8 * n


def test_regions_as_a_stream(monkeypatch):
    import numpy as np
    import pyarrow as pa

    class Rows:
        def mapInArrow(self, run, schema):
            self.run = run
            return self

    for sizes, at_once in (([3, 40, 5, 1, 90, 2], 11), ([40], 7), ([1, 1, 33, 32], 1000), ([], 5)):
        monkeypatch.setattr(neardup, "ROWS_AT_ONCE", at_once)
        monkeypatch.setattr(neardup, "_sorted_rows", lambda rows, run, schema: run)
        hi = np.repeat(np.arange(len(sizes)), sizes).astype(np.int64)
        n = len(hi)
        cols = [np.zeros(n, np.int32), hi, np.arange(n), np.arange(n) + 10, np.full(n, 50, np.int32), np.arange(n) + 10, *(np.zeros(n, np.int64) for _ in range(4))]
        batch = pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=[f.split()[0] for f in neardup.ROW.split(", ")])
        out = [r for b in neardup.region_pairs(None, 80)([batch]) for r in b.to_pylist()]
        pairs = {(r["a"], r["b"]) for r in out if r["tree"] is None}
        assert pairs == {(i + 10, k + 10) for i in range(n) for k in range(i + 1, n) if hi[i] == hi[k] and sizes[hi[i]] <= neardup.CROWD}
        assert sorted(r["a"] for r in out if r["tree"] is not None) == [i + 10 for i in range(n) if sizes[hi[i]] > neardup.CROWD]
        linked = [(r["a"], r["b"]) for b in neardup.neighbours_run(80)([batch]) for r in b.to_pylist()] if n else []
        assert len(set(linked)) <= 3 * n
        parent = {i + 10: i + 10 for i in range(n)}

        def find(i, parent=parent):
            while parent[i] != i:
                i = parent[i]
            return i

        for a, b in linked:
            parent[find(a)] = find(b)
        assert len({find(i) for i in parent}) == len(sizes)  # each region hangs together


def test_one_id_with_two_texts(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    docs = spark.createDataFrame([(1, a), (5, a), (5, b), (6, b + " end"), (7, "x"), (7, "x")], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(docs, 2).collect())
    assert got == [(1, 1, True), (5, 1, False), (5, 5, True), (6, 5, False), (7, 7, True), (7, 7, True)]
    assert sorted(tuple(r) for r in neardup.keep_one(docs, 2).collect()) == [(1, a), (5, b), (7, "x"), (7, "x")]
    alike = spark.createDataFrame([(5, b), (5, b + " end"), (6, b)], "doc_id long, text string")
    assert neardup.keep_one(alike, 2).count() == 1


def test_signed_sketches():
    import numpy as np

    zero = np.zeros(2, np.int64)
    cols = {"s0": np.array([-1, 0]), "s1": np.array([-(2**63), 1]), "t0": np.array([1, 0]), "t1": zero}
    assert neardup.differing(cols, np.array([0]), np.array([1])).tolist() == [66]


@pytest.mark.parametrize("finish", [0, 10**6])
def test_components(spark, monkeypatch, finish):
    from kerbline.operators import components as core

    monkeypatch.setattr(core, "FINISH", finish)
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (50, None)] + [(200, 200 + i) for i in range(1, 300)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, **dict.fromkeys(range(200, 500), 200)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_containment_by_brute_force(spark, odd, empty):
    long = " ".join(f"w{i}" for i in range(5000))
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    edited = passage.replace("omicron", "pi")
    docs = spark.createDataFrame([(1, f"{long} {passage.upper()}! {long}"), (2, f"{long} {edited}"), (3, long), (4, None), (5, ""), (6, "to be"), (6, "to be"), (None, passage)], "doc_id long, text string").selectExpr("*", "1 as n_item", "2 as w", "'a' as shingles")
    items = spark.createDataFrame([(10, passage), (11, "To be."), (12, None), (13, ""), (14, passage), (10, passage), (None, "w1 w2")], "item_id long, text string").selectExpr("*", "9 as n")
    got = sorted((r.doc_id or 0, r.item_id, r.n_shared) for r in decontam.matches(docs, items).collect())
    assert got == [(0, 10, 11), (0, 14, 11), (1, 10, 11), (1, 14, 11), (2, 10, 10), (2, 14, 10), (6, 11, 1), (6, 11, 1)]
    left = decontam.without_items(docs, items)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [3, 4, 5]
    assert decontam.matches(docs, items.limit(0)).count() == 0 and decontam.matches(empty, items).count() == 0
    assert decontam.without_items(odd, items.limit(0)).count() == 10


def test_each_partition_has_its_bound(spark):
    """The lookup joins on partition and hash, and large items' partition is asked for a part of the hashes only."""
    item = lambda k, n: " ".join(f"i{k}x{j}" for j in range(n))
    items = spark.createDataFrame([(k, item(k, n)) for k, n in enumerate([5, 5, 8, 60, 60, 400])], "item_id long, text string")
    index = decontam.item_index(items).collect()
    most = {r.part: max(max(q.sig) for q in index if q.part == r.part) for r in index}
    assert len(most) == 4 and most[max(most)] < 0 < most[min(most)]
    docs = spark.createDataFrame([(k, f"{item(90, 50)} {item(k, n)} {item(91, 50)}") for k, n in enumerate([5, 5, 8, 60, 60, 400])], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontam.matches(docs, items).collect()) == [(k, k) for k in range(6)]
