"""The trie against a plain one of dictionaries, over one block and over many small ones."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest

from blockwave.llm import trie
from blockwave.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, key string, block int, depth string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, "d") for r in rows], SCHEMA)


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}\n{role}\n{text}".encode()).digest()[:16]


def plain(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own.setdefault(conv, []).append((turn is not None, turn or 0, digest(role, text), role, text))
    turns = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(turns.get(c - int(np.fmod(c, 5)), [])[:h] + mine[h:])
    members = {}
    for c, t in rebuilt.items():
        for d in range(len(t) + 1):
            members.setdefault(t[:d], []).append(c)
    parents = {n[:-1] for n in members if n}
    out = []
    for n, m in members.items():
        inside = [x for x in members if x[: len(n)] == n]
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in inside if x)
        ends = ",".join(map(str, sorted(c for c in m if len(rebuilt[c]) == len(n))))
        children = sum(len(x) == len(n) + 1 for x in inside)
        out.append((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children, sum(x not in parents for x in inside), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def made(seed, n=90):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-20, 300), n):
        same = r.random() < 0.4
        for t in range(r.choice((0, 1, 2, 3, 8, 9, 12))):
            rows.append((c, t, ["user", "assistant"][t % 2], "hello" if same or r.random() < 0.3 else f"é{r.randint(0, 3)}"))
    rows += [(c, t, "user", "copy") for c in range(1000, 1060) for t in range(4)]
    rows += [(7, None, None, None), (7, 3, "user", "tie"), (7, 3, "user", "tie"), (7, 3, "assistant", None), (None, 1, "user", "no conversation")]
    rows += [(2000, t, "user", f"long {t}") for t in range(300)] + [(2002, t, "user", f"long {t}") for t in range(280)]
    return rows


@pytest.mark.parametrize("block", (4096, 16, 3))
def test_trie_equals_a_plain_one(spark, monkeypatch, block):
    monkeypatch.setattr(trie, "BLOCK", block)
    monkeypatch.setattr(trie, "NODES", 50)
    rows = made(block)
    assert sorted(map(tuple, trie.prefix_trie(frame(spark, rows)).collect()), key=str) == plain(rows)


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf}/conversations.parquet')")
    want = con.execute(ORACLE_SQL["op13_trie"]).fetchall()
    got = QUERIES["op13_trie"](spark, sf)
    assert got.columns == [d[0] for d in con.description]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_copies_that_fill_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 2)
    rows = [(c * 5, t, "user", f"t{t}") for c in range(40) for t in range(9)]
    got = sorted(map(tuple, trie.prefix_trie(frame(spark, rows)).collect()), key=str)
    assert got == plain(rows) and len(got) == 10


def test_turnless_and_empty(spark):
    assert trie.prefix_trie(frame(spark, [])).collect() == []
    c = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    rows = [(c, 0, "user", "gone")]
    assert sorted(map(tuple, trie.prefix_trie(frame(spark, rows)).collect())) == plain(rows)
    assert len(plain(rows)) == 1


def test_nearest_smaller_values():
    r = random.Random(1)
    for _ in range(50):
        v = [r.randint(0, 4) for _ in range(r.randint(1, 20))]
        left, right = trie.nearest_smaller(v)
        for i, x in enumerate(v):
            assert left[i] == max((j for j in range(i) if v[j] < x), default=-1)
            assert right[i] == min((j for j in range(i + 1, len(v)) if v[j] < x), default=len(v))
