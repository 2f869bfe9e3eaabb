import math
import random
from collections import Counter

import numpy as np
import pytest

from blockwave.llm import decontam, toxicity

from . import cases


@pytest.fixture(scope="module")
def chain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    return toxicity.train(docs.where("doc_id % 2 = 0"), labels)


def test_toxicity_on_held_out_labels(spark, chain):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 2 = 1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = toxicity.score(docs, chain).select("doc_id", "rejected").join(labels, "doc_id").collect()
    hit = sum(r["rejected"] and r["toxic"] == 1 for r in got)
    assert hit / sum(r["toxic"] == 1 for r in got) > 0.85
    assert hit / max(1, sum(r["rejected"] for r in got)) > 0.9


@pytest.mark.parametrize("n", (5_000, 20_000, 100_000, 1_000_000))
def test_clean_text_does_not_hide_a_toxic_one(spark, chain, n):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.where("doc_id % 2 = 1").join(labels, "doc_id").orderBy("doc_id").select("text", "toxic").collect()
    toxic = [r.text for r in rows if r.toxic == 1][:: max(1, n // 20_000)][:40]
    plain = [r.text for r in rows if r.toxic == 0 and not chain.rejects(r.text)]
    long = " ".join(plain)[:n]
    assert not chain.rejects(long)
    assert sum(chain.rejects(t + " " + long) for t in toxic) >= 0.85 * len(toxic)


def test_toxicity_of_odd_documents(spark, chain):
    docs = cases.frame(spark)
    got = {r["doc_id"]: r for r in toxicity.score(docs, chain).collect()}
    assert len(got) == len({d for d, _ in cases.odd_texts()}) and not got[1]["rejected"] and not got[2]["rejected"] and not got[3]["rejected"]
    kept = toxicity.clean(docs, chain)
    assert kept.columns == docs.columns
    assert kept.count() == toxicity.score(docs, chain).where("NOT rejected").count()
    assert toxicity.score(cases.empty(spark), chain).count() == 0


def test_chain_without_labels(spark):
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(cases.frame(spark), labels)
    assert toxicity.score(cases.frame(spark), chain).where("rejected").count() == 0


def labelled(n=400, seed=1):
    """Texts with toxic words, of which those of low quality are told apart by the label of quality alone."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeinrst") for _ in range(5))
    texts, labels = [], []
    for k in range(n):
        junk, hint = k % 2, r.random() < 0.3
        texts.append((k, " ".join([word() for _ in range(20)] + ["junky", "trash"] * junk + ["maybe", "perhaps"] * hint)))
        labels.append((k, 1 - junk, int(junk and hint)))
    return texts, labels


def plain_chain(texts, labels):
    """The chain by sets, counters and dense matrices: the probabilities of the last category and its threshold."""
    feats = [toxicity.features(set().union(*toxicity.windows(t))) for _, t in texts]
    fold = np.array([toxicity.fold_of(t) for _, t in texts])
    ys = [np.array([q == 0 for _, q, _ in labels], float), np.array([t for _, _, t in labels], float)]

    def select(use, y):
        a, b = Counter(), Counter()
        for f, u, k in zip(feats, use, y):
            if u:
                (a if k else b).update(f)
        pos, neg = y[use].sum(), (1 - y[use]).sum()
        z = {}
        for f, n in a.items():
            p, q = (n + 0.5) / (pos + 1), (b[f] + 0.5) / (neg + 1)
            score = math.log(p / q) / math.sqrt(1 / (n + 0.5) + 1 / (b[f] + 0.5))
            if n >= 3 and score > 2.5 and p > 4 * q:
                z[f] = score
        return sorted(z, key=lambda f: (-z[f], f))[:3000]

    def learn(x, y):
        w, m, v = np.zeros(x.shape[1]), 0, 0
        for step in range(1, 401):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = x.T @ (np.where(y, 0.5 / y.sum(), 0.5 / (1 - y).sum()) * (p - y))
            g[:-1] += 3e-4 * w[:-1]
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        return w

    oof_before, before = np.zeros((len(texts), 0)), np.zeros((len(texts), 0))
    for y in ys:
        oof = np.zeros(len(y))
        for f in (0, 1, 2, 3):
            names = select(fold != f, y)
            x = np.array([[n in fs for n in names] for fs in feats], float).reshape(len(feats), -1)
            one = np.ones((len(y), 1))
            w = learn(np.hstack([x, oof_before, one])[fold != f], y[fold != f])
            now = 1 / (1 + np.exp(-np.clip(np.hstack([x, oof_before if f < 3 else before, one]) @ w, -30, 30)))
            oof[fold == f] = now[fold == f]
        oof_before, before = np.column_stack([oof_before, oof]), np.column_stack([before, now])
    best = max(sorted(set(oof)), key=lambda c: (2 * y[oof >= c].sum() / ((oof >= c).sum() + y.sum()), c))
    low = max((p for p in oof if p < best), default=0.0)
    return before[:, -1], (best + low) / 2


def test_chain_against_a_plain_one(spark):
    texts, labels = labelled()
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    chain = toxicity.train(cases.frame(spark, texts), frame)
    p, limit = plain_chain(texts, labels)
    assert [link.name for link in chain.links] == ["low_quality", "toxic"]
    assert abs(chain.links[-1].threshold - limit) < 1e-6
    got = {r["doc_id"]: r for r in toxicity.score(cases.frame(spark, texts), chain).collect()}
    assert max(abs(got[k]["toxic"] - p[k]) for k in range(len(texts))) < 1e-6
    assert [got[k]["rejected"] for k in range(len(texts))] == (p >= limit).tolist()
    again = toxicity.train(cases.frame(spark, texts), frame)
    assert all((a.weights == b.weights).all() for a, b in zip(chain.links, again.links))


def test_earlier_probabilities_decide(spark):
    texts, labels = labelled()
    chain = toxicity.train(cases.frame(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sum(chain.rejects(t) == bool(y) for (_, t), (_, _, y) in zip(texts, labels)) > 0.97 * len(texts)
    before = [chain.rejects(t) for _, t in texts]
    last = chain.links[-1]
    last.weights[len(last.index)] = 0.0  # as if the first link had said nothing
    assert [chain.rejects(t) for _, t in texts] != before


def test_copies_share_a_fold_and_all_labelled_rows_train(spark):
    texts, labels = labelled(60)
    docs = cases.frame(spark, texts + texts[:5])
    assert toxicity.sample(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 60
    assert toxicity.fold_of("b a c zz") == toxicity.fold_of("c b a zz zz")


def bench_items(n=300, seed=7):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 4)))
    return [(i, " ".join(word() for _ in range(r.randint(9, 40))) + ". " + " ".join(word() for _ in range(5))) for i in range(n)]


def test_search_is_exact():
    items = bench_items()
    index = decontam.Index(items)
    r = random.Random(8)
    for _ in range(300):
        terms = set(r.sample(sorted(index.terms), 25)) | set(decontam._WORD.findall(r.choice(items)[1])[: r.randint(0, 40)])
        score = {}
        for t in terms & index.terms:
            for k, g in index.postings[t]:
                score[k] = score.get(k, 0) + g
        want = {k for k, s in score.items() if s >= index.threshold - 1e-9}
        got = index.search(terms)
        assert {k for k, _ in got} == want and len(got) == len(want)


def test_in_order():
    for a, b, want in (("a b c", "x a y b z c", 1.0), ("a b c", "c b a", 1 / 3), ("", "a", 1.0), ("a a b", "a b a", 2 / 3)):
        assert decontam.in_order(a.split(), b.split()) == want


def test_contaminated(spark):
    items = bench_items(50)
    r = random.Random(9)
    filler = lambda n: " ".join("".join(r.choice("klmnop") for _ in range(4)) for _ in range(n))
    whole = [(100 + i, filler(r.randint(0, 300)) + " " + t.upper().replace(" ", "  ") + " " + filler(r.randint(0, 300))) for i, t in items]
    clean = [(200 + i, filler(100) + " " + " ".join(t.split()[: len(t.split()) // 3])) for i, t in items]
    docs = cases.frame(spark, whole + clean + cases.odd_texts() + whole[:1])
    bench = spark.createDataFrame([*items, items[0], (60, None), (61, ""), (None, "x y z"), (62, "ab cd")], "item_id long, text string").selectExpr("*", "1 AS score")
    got = sorted((r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, bench).collect())
    assert got == sorted([(100 + i, i) for i in range(50)] + [(100, 0)])
    kept = decontam.decontaminate(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 51
    assert decontam.contaminated(cases.empty(spark), bench).count() == 0
    assert decontam.contaminated(docs, bench.where("false")).count() == 0
    assert decontam.decontaminate(docs, bench.where("false")).count() == docs.count()


def test_index_in_parts(spark, monkeypatch):
    items = bench_items(30)
    docs = cases.frame(spark, [(i, t) for i, t in items])
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, bench).collect())
    monkeypatch.setattr(decontam, "ITEMS", 7)
    assert sorted((r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, bench).collect()) == want == [(i, i) for i in range(30)]
    monkeypatch.setattr(decontam, "ITEM_BYTES", 10)  # each item is longer, and so a part of its own
    assert sorted((r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, bench.where("item_id < 8")).collect()) == want[:8]


def test_query_finds_every_whole_item(spark):
    from blockwave.llm.queries import op9_decontam

    d = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{d}/documents.parquet").collect(), spark.read.parquet(f"{d}/benchmark.parquet").collect()
    words = lambda t: " " + " ".join(decontam._WORD.findall(t.lower())) + " "
    want = sorted((x["doc_id"], i["item_id"]) for x in docs for i in items if words(i["text"]) in words(x["text"]))
    assert sorted((r["doc_id"], r["item_id"]) for r in op9_decontam(spark, d).collect()) == want and want
