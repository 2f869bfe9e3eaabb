import random

from blockwave.llm import decontam

from . import cases
from .test_filters import bench_items


def test_long_items_change_nothing_for_short_ones():
    r = random.Random(6)
    item = (1, "north river carries seven quiet boats past old stone mills. they reach home late today")
    word = lambda: "".join(r.choice("klmnop") for _ in range(4))
    scattered = " ".join(" ".join([w, *[word() for _ in range(20)]]) for w in item[1].split())
    long = (2, " ".join(word() for _ in range(500)) + ". the end of it")
    near = " ".join(w for w in item[1].split() if w != "quiet")
    for items in ([item], [item, long]):
        index = decontam.Benchmark(items)
        assert not index.matches(scattered)
        for pad in (0, 3, 499, 1000, 1501):
            text = " ".join(word() for _ in range(pad))
            found = index.matches(f"{text} {near} {text}")
            assert [m["item_id"] for m in found] == [1] and pad - 16 <= found[0]["at_word"] <= pad


def test_parts_score_as_the_whole(spark, monkeypatch):
    items = bench_items(30)
    docs = cases.frame(spark, [(i, " ".join(w for k, w in enumerate(t.split()) if k % 12 != 5)) for i, t in items])
    bench = spark.createDataFrame([*items, (90, "..."), (91, "one two three four " * 40)], "item_id long, text string")
    want = sorted(map(tuple, decontam.contaminated(docs, bench).collect()))
    assert len(want) >= 20 and any(m[2] < 0.99 for m in want)
    monkeypatch.setattr(decontam, "ITEMS", 7)
    assert sorted(map(tuple, decontam.contaminated(docs, bench).collect())) == want


def test_common_words_and_an_unrelated_long_item():
    r = random.Random(3)
    common = "the of and to in is it was for on are as with his they at be this from have or by one had not but what all were".split()
    short = (1, " ".join(common[:11]) + ". " + " ".join(common[11:16]))
    long = (2, " ".join(f"w{r.randrange(900)}" for _ in range(1500)) + ". the end")
    text = " ".join(r.choice(common) for _ in range(6000))
    assert not decontam.Benchmark([short]).matches(text)
    both = decontam.Benchmark([short, long])
    assert not both.matches(text) and len(both.indexes) == 2
    assert [m["item_id"] for m in both.matches(text + " " + short[1] + " " + long[1])] == [1, 2]


def plain_spans(items, text):
    """Every item against every span of twice its length, without an index."""
    words = decontam._WORD.findall((text or "").lower())
    known = [(i, *decontam.parts(t or "")) for i, t in items]
    known = [(i, q, a) for i, q, a in known if q or a]
    lengths = [len(q) + len(a) for _, q, a in known]
    mean, out = sum(lengths) / len(lengths), []
    df = decontam.Counter(t for _, q, a in known for t in {*q, *a})
    for (i, q, a), n in zip(known, lengths):
        f = decontam.Counter(q + a)
        gain = {t: decontam.math.log(1 + (len(known) - df[t] + 0.5) / (df[t] + 0.5)) * f[t] * 2.2 / (f[t] + 1.2 * (0.25 + 0.75 * n / mean)) for t in f}
        size, step = 2 * max(8, n), max(1, n // 8)
        for at in range(0, max(1, len(words)), step):
            span = words[at : at + size]
            score = sum(gain[t] for t in gain.keys() & set(span)) / sum(gain.values())
            if score >= 0.6 - 1e-9 and min(decontam.in_order(q, span), decontam.in_order(a, span)) >= 0.8:
                if n >= 8 or f" {' '.join(q + a)} " in f" {' '.join(span)} ":
                    out.append(i)
                    break
    return out


def test_query_against_all_pairs(spark, sf_dir):
    from blockwave.llm.queries import op9_decontam

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = sorted((r["doc_id"], i) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() for i in plain_spans(items, r["text"]))
    assert sorted((r["doc_id"], r["item_id"]) for r in op9_decontam(spark, sf_dir).collect()) == want and want


def test_windows_that_hold_no_item_are_not_searched(monkeypatch):
    """The block maxima of a window's words come from one table, with the results of the terms' lists."""
    r = random.Random(3)
    words = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(r.choice(words) for _ in range(12))) for k in range(40)]
    texts = [" ".join(r.choice(words) for _ in range(200)) for _ in range(20)] + [f"{'x ' * 90}{t}{' y' * 90}" for _, t in items]
    calls, search = [], decontam.Index.search
    monkeypatch.setattr(decontam.Index, "search", lambda self, terms: calls.append(1) or search(self, terms))
    with_table = decontam.Benchmark(items)
    found, some = [with_table.matches(t) for t in texts], len(calls)
    monkeypatch.setattr(decontam, "TABLE", 0)
    assert found == [decontam.Benchmark(items).matches(t) for t in texts] and all(found[20:])
    assert some < (len(calls) - some) // 2
