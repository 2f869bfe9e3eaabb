import random
from collections import defaultdict

import numpy as np
import xxhash

from blockwave.llm import simhash

from . import cases


def plain_fingerprint(text):
    words = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def groups(rows, radius=3):
    """Smallest id by component of (id, unsigned fingerprint) rows, all pairs compared."""
    fps = sorted({f for _, f in rows})
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    low = defaultdict(list)
    for d, f in rows:
        low[find(f)].append(d)
    return {f: min((d for d in low[find(f)] if d is not None), default=None) for f in fps}


def unsigned(x):
    return x & (1 << 64) - 1


def test_fingerprint():
    for _, t in cases.odd_texts():
        assert unsigned(simhash.fingerprint(t.encode() if t is not None else None)) == plain_fingerprint(t)


def test_bit_counts_of_many():
    h = np.random.default_rng(1).integers(0, 1 << 63, 70_000, dtype=np.uint64)
    assert simhash._bit_counts(h).tolist() == [int((h >> np.uint64(b) & np.uint64(1)).sum()) for b in range(64)]


def test_odd_documents(spark):
    got = simhash.near_duplicates(cases.frame(spark)).collect()
    want = groups([(r["doc_id"], unsigned(r["fp"])) for r in got])
    assert len(got) == len(cases.odd_texts())
    assert all(r["component_id"] == want[unsigned(r["fp"])] for r in got)
    assert simhash.near_duplicates(cases.empty(spark)).count() == 0


def test_links_join_all_within_the_radius(spark):
    r = random.Random(3)
    centres = [r.getrandbits(64) for _ in range(40)]
    fps = {c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))) for c in centres for _ in range(25)}
    fps |= {centres[0] ^ m for m in (7, 7 << 15, 7 << 61, 1 | 1 << 20 | 1 << 40, 3 | 1 << 63)}
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    edges = simhash.links(df)
    assert all((unsigned(e["a"]) ^ unsigned(e["b"])).bit_count() <= 3 for e in edges.collect())
    roots = {unsigned(x["node"]): x["root"] for x in simhash.components(edges).collect()}
    want = groups([(unsigned(f), f) for f in fps])
    for f in fps:
        for g in fps:
            if f in roots and g in roots:
                assert (roots[f] == roots[g]) == (want[f] == want[g])
    alone = [f for f in fps if sum(want[f] == want[g] for g in fps) == 1]
    assert not set(alone) & set(roots) and len(alone) + len(roots) == len(fps)


def test_query_against_all_pairs(spark, sf_dir):
    from blockwave.llm.queries import op1_simhash

    got = op1_simhash(spark, sf_dir).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(got) == len(texts)
    assert all(r["fingerprint"] == f"{plain_fingerprint(texts[r['doc_id']]):016x}" for r in got)
    want = groups([(r["doc_id"], int(r["fingerprint"], 16)) for r in got])
    assert all(r["component_id"] == want[int(r["fingerprint"], 16)] for r in got)


def test_intermediate_tables_can_be_deleted(spark):
    from blockwave.llm import shared

    assert shared.keep(spark.range(3), "numbers").count() == 3
    assert shared.exists(spark, shared.shared_dir(spark))
    shared.clean(spark)
    assert not shared.exists(spark, shared.shared_dir(spark)) and shared.exists(spark, shared.shared_root(spark))
