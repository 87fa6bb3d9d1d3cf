import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from kerbline.llm import conversations as cv

SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def brute(rows):
    """The trie by sequences, walked node by node."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns[conv].append(((turn is not None, turn or 0), digest(role, text), (role, text)))
    own = {k: [x[2] for x in sorted(v)] for k, v in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for conv, mine in own.items():
        h, base = zlib.crc32(str(conv).encode()) % 9, conv - (conv % 5 if conv >= 0 else -(-conv % 5))
        whole = tuple(own.get(base, [])[:h] + mine[h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append(conv)
        ends[whole].append(conv)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out, sums = [], {}
    for node in sorted(members, key=len, reverse=True):
        below = [sums[k] for k in children[node]]
        own_bytes = len(node[-1][1].encode()) if node else 0
        sums[node] = (sum(x[0] for x in below) or 1, sum(x[1] for x in below) + (len(members[node]) - 1) * own_bytes)
        sha = hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(children[node]), *sums[node], sha))
    return out


def key(row):
    return tuple((x is not None, x) for x in row)


def trie(spark, rows, extra=()):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", *extra).repartition(3)
    return sorted((tuple(r[k] for k in NAMES) for r in cv.prefix_trie(df).collect()), key=key)


def by_sql(rows=None, path=None):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}'" if path else "CREATE TABLE conversations(conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    if rows:
        duck.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    sql = cv.ORACLES["op12_prefix_trie"]
    assert [x[0] for x in duck.execute(f"DESCRIBE {sql}").fetchall()] == NAMES
    return sorted(duck.execute(sql).fetchall(), key=key)


def test_table(spark, sf_dir):
    got = sorted((tuple(r[k] for k in NAMES) for r in cv.op12_prefix_trie(spark, sf_dir).collect()), key=key)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select(*NAMES[:1], "turn", "role", "text").collect()]
    assert got == sorted(brute(rows), key=key)
    assert got == by_sql(path=f"{sf_dir}/conversations.parquet")


ODD = [
    *((c, t, None if t == 2 else "user", None if t == 3 else f"é{t % 4}") for c in (0, 1, 2, 3, 4) for t in range(12)),
    (6, 0, "user", "alone without its base"), (6, None, "user", "null turn first"), (6, None, "user", "another"),
    (-3, 0, "a", "b"), (-3, 0, "a", "b"), (-3, 1, "a", ""), (-7, 1, "a", ""), (None, 0, "a", "b"), (None, None, None, None),
    (10, None, None, None), (13, 5, "", ""), (2**40 + 1, 0, "user", "x" * 100_000), (2**40 + 1, 1, "user", "y"),
]


@pytest.mark.parametrize("trie_nodes", [1, 100_000])
def test_odd_rows(spark, monkeypatch, trie_nodes):
    monkeypatch.setattr(cv, "TRIE_NODES", trie_nodes)
    want = sorted(brute(ODD), key=key)
    assert trie(spark, ODD, ["1 as node", "2 as base", "3 as depth", "'z' as parent", "4 as n_bytes"]) == want
    assert by_sql(ODD) == want
    # Rebuilt conversations may have no turn, and its node is the root.
    assert any(n == 0 and sha != cv.EMPTY_SHA for _, n, *_, sha in want)
    assert trie(spark, [r for r in ODD if r[0] is None]) == []


def test_copies_and_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(cv, "CHUNK", 20)
    monkeypatch.setattr(cv, "BATCH", 7)
    rnd = random.Random(5)
    rows = [(c, t, "user", "same" if t < 9 or c % 3 else f"{c}") for c in range(200) for t in range(rnd.randint(1, 14))]
    rows += [(500, t, "user", f"long {t % 7}") for t in range(400)] + [(503, t, "user", f"long {t % 7}") for t in range(300)]
    assert trie(spark, rows) == sorted(brute(rows), key=key)
