"""Benchmark decontamination: BM25 over an inverted index of test items, searched by block-max WAND.

Every window of every document is a query against the index of test items. A window's score for an
item is its BM25 score over distinct terms, divided by the score of the item's own words, so 1 means
that all of them occur. What scores at least the threshold is verified within spans twice as long as
the item itself, one at every eighth of its length: a span has to reach the threshold, and the words of
the question part and of the answer part have to occur in it in order. Items of like length share an
index, whose windows hold every such span whole, so the length of other items changes no result.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import keep, keep_rows, small_batches

K1, B = 1.2, 0.75
BLOCK = 4  # items in a block
THRESHOLD = 0.6  # of an item's own score
OVERLAP = 0.8  # of the words of each part, in order
SPAN, SPAN_STEP = 2, 8  # a span's length in item lengths, spans begun in an item length
SHORT = 8  # items under this many words have to occur word by word
CLASS = 4  # the longest item of an index is at most so many times as long as its shortest
TABLE = 1 << 20  # the largest table of block maxima by term (8 MB); above it a window's are added from the terms' lists
ITEMS, ITEM_BYTES = 20_000, 8 << 20  # the largest part of the benchmark that is sent to executors at once
_WORD = re.compile(r"\w+")
_STOP = re.compile(r"[.?!\n]+")

MATCH = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, at_word long"


def parts(text: str) -> tuple[list[str], list[str]]:
    """Question and answer words: all sentences but the last and the last one, or two thirds and the rest."""
    sentences = [w for s in _STOP.split(text.lower()) if (w := _WORD.findall(s))]
    if len(sentences) > 1:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    words = sentences[0] if sentences else []
    cut = len(words) - len(words) // 3
    return words[:cut], words[cut:]


def in_order(part: list[str], words: list[str]) -> float:
    """The share of ``part`` in its longest common subsequence with ``words``."""
    if not part:
        return 1.0
    places: dict[str, list[int]] = {}
    for i, w in enumerate(part):
        places.setdefault(w, []).insert(0, i)
    best: list[int] = []  # the smallest last place of a common subsequence of each length
    for w in words:
        for i in places.get(w, ()):
            k = bisect_left(best, i)
            best[k : k + 1] = [i]
    return len(best) / len(part)


class Index:
    """Postings (item, impact) by term in item order, and a term's largest impact in each block of items."""

    def __init__(self, items: list[tuple[int, str | None]], threshold: float = THRESHOLD, overlap: float = OVERLAP, whole: tuple[int, float, dict[str, int]] | None = None):
        """``whole``: number of items, mean length and items by term of the benchmark that ``items`` are a part of."""
        self.threshold, self.overlap = threshold, overlap
        known = [(i, *parts(t or "")) for i, t in items]
        self.items = [(i, q, a) for i, q, a in known if q or a]
        lengths = [len(q) + len(a) for _, q, a in self.items]
        self.step = max([SHORT, *lengths])
        self.least = min(lengths, default=0) * overlap  # no text of fewer words holds an item
        self.window = (SPAN + 1) * self.step
        counts = [Counter(q + a) for _, q, a in self.items]
        if whole is None:
            whole = len(self.items), sum(lengths) / max(1, len(lengths)), Counter(t for c in counts for t in c)
        n, mean, df = whole
        idf = {t: math.log(1 + (n - d + 0.5) / (d + 0.5)) for t, d in df.items()}
        self.postings: dict[str, list[tuple[int, float]]] = {}
        self.gains: list[dict[str, float]] = []
        for k, c in enumerate(counts):
            gain = {t: idf[t] * f * (K1 + 1) / (f + K1 * (1 - B + B * lengths[k] / mean)) for t, f in c.items()}
            own = sum(gain.values())
            self.gains.append({t: g / own for t, g in gain.items()})
            for t, g in self.gains[-1].items():
                self.postings.setdefault(t, []).append((k, g))
        self.top = {t: max(g for _, g in p) for t, p in self.postings.items()}
        self.terms = set(self.top)
        self.bounds: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for t, p in self.postings.items():
            most: dict[int, float] = {}
            for k, g in p:
                most[k // BLOCK] = max(g, most.get(k // BLOCK, 0.0))
            self.bounds[t] = np.array(list(most), np.int64), np.array(list(most.values()))
        self.places = {t: i for i, t in enumerate(sorted(self.terms))}
        blocks, self.table = -(-len(self.items) // BLOCK), None
        if (len(self.places) + 1) * blocks <= TABLE:
            self.table = np.zeros((len(self.places) + 1, blocks))  # the last row is that of all other words
            for t, (block, most_of) in self.bounds.items():
                self.table[self.places[t], block] = most_of

    def search(self, terms: set[str]) -> list[tuple[int, float]]:
        """All items whose score for these distinct terms reaches the threshold.

        Block maxima come first: a block of items whose maxima add up to less than the threshold has
        none. The others are searched by WAND.
        """
        held = sorted(terms & self.terms)
        if not held:
            return []
        pairs = [self.bounds[t] for t in held]
        sums = np.bincount(np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs]))
        out: list[tuple[int, float]] = []
        for block in np.flatnonzero(sums >= self.threshold - 1e-9).tolist():
            out += self._wand(held, block * BLOCK, (block + 1) * BLOCK)
        return out

    def _wand(self, terms: list[str], low: int, high: int) -> list[tuple[int, float]]:
        """Items of a range that reach the threshold; lists stand sorted by their next item."""
        lists = []
        for t in terms:
            p = self.postings[t]
            i, j = bisect_left(p, (low,)), bisect_left(p, (high,))
            if i < j:
                lists.append([p[i:j], 0, max(g for _, g in p[i:j])])
        out, least = [], self.threshold - 1e-9
        while True:
            lists = [x for x in lists if x[1] < len(x[0])]
            lists.sort(key=lambda x: x[0][x[1]][0])
            bound, pivot = 0.0, None
            for x in lists:
                bound += x[2]
                if bound >= least:
                    pivot = x[0][x[1]][0]
                    break
            if pivot is None:
                return out
            if lists[0][0][lists[0][1]][0] == pivot:
                here = [x for x in lists if x[0][x[1]][0] == pivot]
                score = sum(x[0][x[1]][1] for x in here)
                if score >= least:
                    out.append((pivot, score))
                for x in here:
                    x[1] += 1
            else:
                for x in lists:
                    x[1] = bisect_left(x[0], (pivot,), x[1])

    def hopeful(self, text: list[str]) -> Callable[[int], bool]:
        """Whether the window at a place has a block of items whose maxima add up to the threshold: what ``search``
        looks at first, of all windows of a text."""
        if self.table is None:
            return lambda at: True
        other, least = len(self.places), self.threshold - 2e-9
        term = np.fromiter(map(self.places.get, text, repeat(other)), np.int64, len(text))
        mark = np.zeros(other + 1, bool)

        def test(at: int) -> bool:
            mark[term[at : at + self.window]] = True
            own = mark.nonzero()[0]
            mark[own] = False
            return bool(self.table.take(own, axis=0).sum(axis=0).max(initial=0.0) >= least)

        return test

    def windows(self, words: list[str]) -> Iterator[tuple[int, list[str], bool]]:
        """Place, words, and whether it is the last; spans that begin in its first step lie whole in a window."""
        starts = range(0, max(1, len(words) - SPAN * self.step), self.step)
        for at in starts:
            yield at, words[at : at + self.window], at == starts[-1]

    def _spans(self, k: int, at: int, words: list[str], last: bool) -> Iterator[tuple[float, int, float, float]]:
        """(score, -place, question overlap, answer overlap) of the spans of a window that hold item k."""
        _, q, a = self.items[k]
        n, gain = len(q) + len(a), self.gains[k]
        size = SPAN * max(SHORT, n)
        step = max(1, n // SPAN_STEP)
        for i in range(-at % step, len(words) if last else min(self.step, len(words)), step):
            span = words[i : i + size]
            score = sum(gain[t] for t in sorted(gain.keys() & set(span)))
            if score < self.threshold - 1e-9:
                continue
            oq, oa = in_order(q, span), in_order(a, span)
            if min(oq, oa) < self.overlap:
                continue
            if n < SHORT and f" {' '.join(q + a)} " not in f" {' '.join(span)} ":
                continue
            yield score, -at - i, oq, oa

    def found(self, text: list[str]) -> dict[int, tuple]:
        """Each item that a text of these words holds, by its number, with its best span: of equal scores the first."""
        out: dict[int, tuple[float, int, float, float]] = {}
        if len(text) < self.least - 1e-9:
            return out
        hopeful = self.hopeful(text)
        for at, words, last in self.windows(text):
            if not hopeful(at):
                continue
            for k, _ in self.search(self.terms.intersection(words)):
                _, q, a = self.items[k]
                if in_order(a, words) < self.overlap or in_order(q, words) < self.overlap:
                    continue
                best = max(self._spans(k, at, words, last), default=None)
                if best and (k not in out or best > out[k]):
                    out[k] = best
        return out


class Benchmark:
    """Indexes over test items, one for each class of lengths; scores are those of one index over all."""

    def __init__(self, items: list[tuple[int, str | None]], whole: tuple[int, float, dict[str, int]] | None = None):
        counted = [(i, t, Counter(_WORD.findall((t or "").lower()))) for i, t in items]
        counted = [(i, t, c) for i, t, c in counted if c]
        if whole is None:
            total = sum(c.total() for _, _, c in counted)
            whole = len(counted), total / max(1, len(counted)), Counter(t for _, _, c in counted for t in c)
        classes: dict[int, list[tuple[int, str | None]]] = {}
        for i, t, c in counted:
            n, k = max(SHORT, c.total()), 0
            while n >= SHORT * CLASS ** (k + 1):
                k += 1
            classes.setdefault(k, []).append((i, t))
        self.indexes = [Index(classes[k], whole=whole) for k in sorted(classes)]

    def matches(self, text: str | None) -> list[dict]:
        """The test items that the text holds, by id, each with its best span."""
        words = _WORD.findall((text or "").lower())
        names = ("item_id", "score", "question_overlap", "answer_overlap", "at_word")
        out = [(x.items[k][0], s, oq, oa, -place) for x in self.indexes for k, (s, place, oq, oa) in x.found(words).items()]
        return [dict(zip(names, m)) for m in sorted(out)]


def _whole(rows: DataFrame) -> tuple[int, float, DataFrame]:
    """Number of items with words, their mean length, and (term, n) over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [_WORD.findall(t.lower()) for t in b.column(0).to_pylist()]
            terms = pa.array([sorted(set(w)) for w in words], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([terms, pa.array([len(w) for w in words], pa.int64())], ["terms", "length"])

    small_batches(rows.sparkSession)
    items = rows.select("text").mapInArrow(run, "terms array<string>, length long").where("length > 0")
    n, total = items.agg(F.count("*"), F.sum("length")).first()
    return n, (total or 0) / max(1, n), keep(items.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")), "terms")


def _part(items: list[tuple[int, str]], whole: tuple[int, float, DataFrame] | None) -> Benchmark:
    """The indexes of a part of a benchmark; only the counts of the part's own terms come to the driver."""
    if whole is None:
        return Benchmark(items)
    n, mean, counts = whole
    own = pa.table({"term": pa.array(sorted({w for _, t in items for w in _WORD.findall(t.lower())}), pa.string())})
    df = counts.join(counts.sparkSession.createDataFrame(own), "term").toArrow() if len(own) else None
    return Benchmark(items, (n, mean, dict(zip(df["term"].to_pylist(), df["n"].to_pylist())) if df else {}))


def indexes(benchmark: DataFrame) -> Iterator[Benchmark]:
    """Indexes over parts of the benchmark, in item order, none above ITEMS items and ITEM_BYTES of text; a
    longer item is a part of its own.

    Rows without an id or text are left out; a repeated row counts once. Term counts and the mean length
    are those of the whole benchmark, so the cut into parts changes no score.
    """
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).dropna().distinct()
    now: list[tuple[int, str]] = []
    size, whole = 0, None
    for item, text in rows.orderBy("item_id", "text").toLocalIterator():
        n = len(text.encode())
        if now and (len(now) == ITEMS or size + n > ITEM_BYTES):
            whole = whole or _whole(rows)
            yield _part(now, whole)
            now, size = [], 0
        now.append((item, text))
        size += n
    if now:
        yield _part(now, whole)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, at_word): a row for each document row
    and each test item that it holds.

    A null or empty text holds none; repeated rows give repeated results; with no test items the
    result is empty. A benchmark above the bound of one index takes one pass over ``docs`` for each part.
    """
    out = None
    for index in indexes(benchmark):
        hits = _hits(docs, index)
        out = hits if out is None else out.unionAll(hits)
    if out is None:
        out = docs.sparkSession.createDataFrame([], MATCH)
    return out


def _hits(docs: DataFrame, index: Benchmark) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(index)
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
    names = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "at_word"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(d, *m.values()) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for m in sent.value.matches(t)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 6, kinds)], names)

    small_batches(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, MATCH)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a test item; all columns stay as they are."""
    for index in indexes(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(index)
        docs = keep_rows(docs, lambda texts, sent=sent: [not sent.value.matches(t) for t in texts])
    return docs
