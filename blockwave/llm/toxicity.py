"""Toxicity by a classifier chain: linear models in a row, each fed the probabilities of those before it.

The chain goes over the categories that the labels have: low quality first, then toxic, whose model
sees the text's features and the probability of low quality; the last link decides. The models are
trained here on a bounded sample of labelled documents. Features are the words of a document, the first
letters of its words, and those of two and three different words; those that tell a category from the rest are kept. A
later model is trained on out-of-fold probabilities of the earlier ones, as it will meet
probabilities of texts that those were not trained on.

A text is scored by windows of WINDOW words that overlap by half and cover all of it, and counts as its worst
one, so that clean text around a toxic passage does not hide it. Thresholds are set on the same scores; a text of
many windows has to reach more than a short one, so that clean texts stay as they get longer.

Features are found, counted and selected by Spark jobs. The driver gets the selected features, at
most FEATURES of them for each model, and for each sampled document the places of those that it has.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import from_texts, keep, keep_rows, small_batches

SAMPLE = 2500  # labelled documents of each kind, toxic and not, that training takes at most
FEATURES = 3000  # kept for a model at most
PREFIXES = (4, 5, 6, 7, 8)
TIMES = 3  # different words with one beginning that are told apart
FOLDS = 3
WINDOW = 200  # words
WORDS = 200_000  # that a task remembers
CHANCE = 0.01  # that clean text is rejected, at most, where its many windows raise the threshold
RARE = 3  # documents of a category that a feature has to be in, at least
#: The categories in the chain's order, each with its label; the last one decides.
CHAIN = (("low_quality", "quality = 0"), ("toxic", "toxic = 1"))
_WORD = re.compile(r"[^\W\d_]+")


def windows(text: str | None) -> list[set[str]]:
    """The words of each window; one window where there are few."""
    return _cut(_WORD.findall((text or "").lower()))


def _cut(words: list[str]) -> list[set[str]]:
    return [set(words[i : i + WINDOW]) for i in range(0, max(1, len(words) - WINDOW // 2), WINDOW // 2)]


def features(words: set[str]) -> set[str]:
    """The words, ``^`` and the beginnings of words, ``^^`` and those that at least two words have, and so on."""
    out = set(words)
    for n in PREFIXES:
        for start, times in Counter(w[:n] for w in words if len(w) >= n).items():
            out.update("^" * k + start for k in range(1, min(times, TIMES) + 1))
    return out


def fold_of(text: str | None) -> int:
    """Near copies, whose two smallest word hashes agree, are in one fold, so none is judged by its like."""
    h = sorted(xxhash.xxh64_intdigest(w) for w in set(_WORD.findall((text or "").lower())))[:2]
    return xxhash.xxh64_intdigest(repr(h)) % FOLDS


def weigh(rows: list[np.ndarray], extra: np.ndarray, y: np.ndarray, n: int, l2: float = 3e-4) -> np.ndarray:
    """Logistic regression over present features, further numeric columns and a constant, by Adam. Both
    kinds weigh the same."""
    width = extra.shape[1]
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    ids = np.concatenate(rows) if at.size else np.empty(0, np.int64)
    x = np.hstack([extra, np.ones((len(rows), 1))])
    w, m, v = np.zeros(n + width + 1), 0.0, 0.0
    weight = np.where(y, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    for step in range(1, 401):
        z = np.bincount(at, w[ids], len(rows)) + x @ w[n:]
        d = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        g = np.r_[np.bincount(ids, d[at], n), x.T @ d]
        g[:-1] += l2 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return w


@dataclass
class Link:
    """One model of the chain."""

    name: str
    index: dict[str, int]
    weights: np.ndarray
    threshold: float = 2.0

    def __post_init__(self) -> None:
        self.words = {f for f in self.index if f[0] != "^"}
        self.starts: dict[int, dict[str, list[tuple[int, int]]]] = {}  # by length and beginning: how often, and its place
        for f, i in self.index.items():
            if start := f.lstrip("^") if f[0] == "^" else "":
                self.starts.setdefault(len(start), {}).setdefault(start, []).append((len(f) - len(start), i))

    def rows(self, words: set[str]) -> list[int]:
        out = [self.index[w] for w in words & self.words]
        for n, known in self.starts.items():
            for start, times in Counter(p for w in words if (p := w[:n]) in known).items():
                out += [i for k, i in known[start] if k <= times]
        return out

    def score(self, rows: list[int] | np.ndarray, before: list[float]) -> float:
        """The probability of a text with these features, after the earlier probabilities."""
        n = len(self.index)
        z = self.weights[rows].sum() + self.weights[n:-1] @ np.array(before) + self.weights[-1]
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


class Chain:
    """Links in order; a text is rejected by the last one, which judges each of its windows."""

    def __init__(self, links: list[Link], clean: np.ndarray = np.zeros(0)):
        self.links = links
        self.known: dict[str, bool] = {}  # words met, and whether a link has a feature of them
        self.clean = np.sort(clean)  # out-of-fold probabilities of windows of documents not marked by the last category

    def bar(self, n: int) -> float:
        """What one of ``n`` windows has to reach: the last link's threshold, or more where clean windows reach
        that too often for so many."""
        few = int(CHANCE * len(self.clean) / n)
        tail = float(self.clean[-few - 1]) if few < len(self.clean) else 0.0
        return max(self.links[-1].threshold, float(np.nextafter(tail, 2.0)))

    def _one(self, words: set[str]) -> list[float]:
        out: list[float] = []
        for link in self.links:
            out.append(link.score(link.rows(words), out))
        return out

    def judge(self, text: str | None) -> tuple[list[float], bool]:
        """The probabilities of the window that the last link gives the highest one, and whether it rejects the text."""
        words, known, half = _WORD.findall((text or "").lower()), self.known, WINDOW // 2
        if len(known) > WORDS:
            known.clear()
        known.update((w, self._has(w)) for w in set(words).difference(known))
        n = len(range(0, max(1, len(words) - half), half))
        # windows as ``windows`` cuts them, of the words that count
        parts: dict[int, set[str]] = {}
        for i, w in enumerate(words):
            if known[w]:
                for j in (i // half - 1, i // half):
                    if 0 <= j < n:
                        parts.setdefault(j, set()).add(w)
        tried = [*parts.values(), *([set()] if len(parts) < n else [])]
        worst = max(map(self._one, tried), key=lambda p: p[-1])
        return worst, worst[-1] >= self.bar(n)

    def _has(self, w: str) -> bool:
        return any(w in link.words or any(w[:n] in known for n, known in link.starts.items()) for link in self.links)

    def scores(self, text: str | None) -> list[float]:
        return self.judge(text)[0]

    def rejects(self, text: str | None) -> bool:
        return self.judge(text)[1]


def fit(names: list[str], chosen: list[list[list[str]]], vocabulary: dict[str, int], parts: list[list[np.ndarray]], y: np.ndarray, fold: np.ndarray) -> Chain:
    """A chain over documents whose windows are rows of places in ``vocabulary``. ``chosen[k]`` are the features
    selected for link k without each fold in turn and, last, with all. Weights are learned from whole documents,
    thresholds set on their windows."""
    rows = [np.unique(np.concatenate(p)) for p in parts]
    links, before = [], np.zeros((len(rows), 0))
    seen: list[list[list[float]]] = [[[] for _ in p] for p in parts]  # by window, the earlier links' probabilities
    for k, name in enumerate(names):
        made = []
        for f in range(FOLDS + 1):
            use = fold != f
            place = np.full(len(vocabulary), -1)
            place[[vocabulary[x] for x in chosen[k][f]]] = np.arange(len(chosen[k][f]))
            own = [p[p >= 0] for p in (place[r] for r in rows)]
            weights = weigh([r for r, u in zip(own, use) if u], before[use], y[use, k], len(chosen[k][f]))
            made.append((place, Link(name, {x: i for i, x in enumerate(chosen[k][f])}, weights)))
        oof = np.zeros(len(rows))
        for i, f in enumerate(fold):
            place, link = made[f]
            for w, earlier in zip(parts[i], seen[i]):
                at = place[w]
                earlier.append(link.score(at[at >= 0], earlier))
            oof[i] = max(p[k] for p in seen[i])
        link = made[FOLDS][1]
        # A text without any feature is never rejected, however few labels there are.
        link.threshold = max(threshold(oof, y[:, k]), float(np.nextafter(link.score([], _empty(links)), 2.0)))
        links.append(link)
        before = np.column_stack([before, oof])
    return Chain(links, np.array([w[-1] for p, marked in zip(seen, y[:, -1]) if not marked for w in p]))


def _empty(links: list[Link]) -> list[float]:
    """The probabilities of a text without features."""
    out: list[float] = []
    for link in links:
        out.append(link.score([], out))
    return out


def threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold of the best F1 on out-of-fold probabilities, in the middle of the gap below it; above 1,
    which rejects nothing, where the labels are all of one kind."""
    if not y.any() or y.all():
        return 2.0
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][p[order][1:] == p[order][:-1]] = -1
    k = int(np.argmax(f1))
    return float((p[order][k] + (p[order][k + 1] if k + 1 < len(y) else 0)) / 2)


def sample(docs: DataFrame, labels: DataFrame, chain: tuple[tuple[str, str], ...] = CHAIN) -> DataFrame:
    """(id, text, y0, y1, ...) of at most SAMPLE documents that the last category's label marks and SAMPLE
    others, those of the smallest id hashes. Labels that are null, and labels of no document, take no part;
    of contradicting labels of a document the one that marks it counts."""
    marks = [F.max(F.expr(label).cast("int")).alias(f"y{k}") for k, (_, label) in enumerate(chain)]
    known = labels.withColumn("id", F.col("doc_id").cast("long")).where("id IS NOT NULL").groupBy("id").agg(*marks)
    last = f"y{len(chain) - 1}"
    known = known.where(f"{last} IS NOT NULL").fillna(0, [f"y{k}" for k in range(len(chain))])
    parts = [known.where(F.col(last) == t).orderBy(F.xxhash64("id"), "id").limit(SAMPLE) for t in (0, 1)]
    # At most 2 * SAMPLE rows of a few numbers: safe to broadcast, whatever the tables' sizes.
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    joined = texts.join(F.broadcast(parts[0].unionAll(parts[1])), "id")
    return joined.groupBy("id").agg(F.min("text").alias("text"), *[F.max(f"y{k}").alias(f"y{k}") for k in range(len(chain))])


def _best(counts: DataFrame, totals: list[list[int]], k: int, without: int) -> DataFrame:
    """The features whose share among the documents of category k exceeds that among the others most."""
    folds = [f for f in range(FOLDS) if f != without]
    pos, all_ = sum(totals[f][k] for f in folds), sum(totals[f][-1] for f in folds)
    a = sum((F.col(f"y{k}_{f}") for f in folds), F.lit(0))
    b = sum((F.col(f"n_{f}") for f in folds), F.lit(0)) - a
    p, q = (a + 0.5) / (pos + 1), (b + 0.5) / (all_ - pos + 1)
    z = F.log(p / q) / F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    own = counts.where((a >= RARE) & (z > 2.5) & (p > 4 * q)) if pos and all_ > pos else counts.where("false")
    return own.orderBy(z.desc(), "f").limit(FEATURES).select(F.lit(k).alias("k"), F.lit(without).alias("without"), "f", z.alias("z"))


def train(docs: DataFrame, labels: DataFrame, chain: tuple[tuple[str, str], ...] = CHAIN) -> Chain:
    """A chain trained on ``sample``. ``chain`` names the categories and their labels, in order."""
    width = len(chain)
    y = [f"y{k}" for k in range(width)]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(i, 50) for whole in batches for i in range(0, whole.num_rows, 50)):
            texts = b.column(1).to_pylist()
            words = [_WORD.findall((t or "").lower()) for t in texts]
            found = pa.array([sorted(set().union(*map(features, _cut(w)))) for w in words], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fold_of(t) for t in texts], pa.int32()), found, pa.array(words, pa.list_(pa.string())), *b.columns[2:]], ["id", "fold", "fs", "words", *y])

    small_batches(docs.sparkSession)
    rows = keep(sample(docs, labels, chain).mapInArrow(find, "id long, fold int, fs array<string>, words array<string>, " + ", ".join(f"{c} int" for c in y)), "features")
    by_fold = {r["fold"]: r for r in rows.groupBy("fold").agg(*[F.sum(c).alias(c) for c in y], F.count("*").alias("n")).collect()}
    totals = [[*(by_fold[f][c] for c in y), by_fold[f]["n"]] if f in by_fold else [0] * (width + 1) for f in range(FOLDS)]

    def sums(name: str, value: Column) -> list[Column]:
        return [F.sum(F.when(F.col("fold") == f, value).otherwise(0)).alias(f"{name}_{f}") for f in range(FOLDS)]

    each = rows.select("fold", *y, F.explode("fs").alias("f"))
    counts = each.groupBy("f").agg(*sums("n", F.lit(1)), *[s for c in y for s in sums(c, F.col(c))])
    some = F.lit(False)
    for c in y:
        some |= sum((F.col(f"{c}_{f}") for f in range(FOLDS)), F.lit(0)) >= RARE
    counts = keep(counts.where(some), "counts")
    best = None
    for k in range(width):
        for f in range(FOLDS + 1):
            part = _best(counts, totals, k, f)
            best = part if best is None else best.unionAll(part)
    chosen: list[list[list[str]]] = [[[] for _ in range(FOLDS + 1)] for _ in chain]
    for r in sorted(best.collect(), key=lambda r: (-r["z"], r["f"])):
        chosen[r["k"]][r["without"]].append(r["f"])
    vocabulary = {f: i for i, f in enumerate(sorted({f for ks in chosen for fs in ks for f in fs}))}
    # At most FEATURES * (FOLDS + 1) short strings for each category.
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(i, 50) for whole in batches for i in range(0, whole.num_rows, 50)):
            at = [[sorted(i for f in features(w) if (i := sent.value.get(f)) is not None) for w in _cut(words)] for words in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at, pa.list_(pa.list_(pa.int32()))), *b.columns[3:]], ["id", "fold", "at", *y])

    table = rows.drop("fs").mapInArrow(places, "id long, fold int, at array<array<int>>, " + ", ".join(f"{c} int" for c in y)).toArrow().sort_by("id")
    marks = np.array([table[c].to_numpy() for c in y], float).T.reshape(-1, width)
    return fit([n for n, _ in chain], chosen, vocabulary, [[np.array(w, np.int64) for w in p] for p in table["at"].to_pylist()], marks, table["fold"].to_numpy())


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """(doc_id, one probability for each category, rejected) for each row of ``docs``.

    A null or empty text has no features: its probabilities are those of the constants alone and it
    is never rejected. Repeated rows get equal results; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(chain)
    names = [link.name for link in chain.links]

    def find(texts: list[str | None]) -> dict[str, list]:
        found = [sent.value.judge(t) for t in texts]
        return {n: [p[k] for p, _ in found] for k, n in enumerate(names)} | {"rejected": [int(r) for _, r in found]}

    out = from_texts(docs, find, ", ".join(f"{n} double" for n in names) + ", rejected long")
    return out.withColumn("rejected", F.col("rejected") == 1)


def clean(docs: DataFrame, chain: Chain) -> DataFrame:
    """``docs`` without the rows that ``score`` rejects; all columns stay as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(chain)
    return keep_rows(docs, lambda texts: [not sent.value.rejects(t) for t in texts])
