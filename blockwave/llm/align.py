"""Alignment of two tokenizers' tokens over the same bytes.

Both vocabularies cut a text's bytes, so the union of both arrays of token ends gives elementary
intervals: each lies in one token of either side (found by binary search) and is one overlap. An end that
both sides share closes a group; a group's links are the product of its tokens, of which the pair whose
ranges end together is the last.

Neither vocabulary joins a lone space to what stands before it, so every text is cut there, and a word that
was aligned once is remembered. How often a pair of ids is linked is counted over all documents: a
task sums by *part* (some MB of texts), Spark sums over the parts, and each part gets back the
counts of its own pairs, so that what is shuffled are pairs of parts and not of documents.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import keep, small_batches

PART_BYTES = 16 << 20
#: Beyond so many words a worker forgets, between two parts, those that it met only once.
WORDS = 400_000
#: Words are encoded together up to so many characters.
JOINED = 50_000
_LONE = re.compile(r"(?<=\S) (?=\S)")
_SPACE = "▁"
ROWS = "part long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, words array<int>, pairs array<long>, times array<long>, at array<int>, links array<int>"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of either side that own each elementary interval, and whether a group ends with it."""
    ends = np.union1d(ends_a, ends_b)
    a, b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    return a, b, (ends_a[a] == ends) & (ends_b[b] == ends)


def groups(ends_a: np.ndarray, ends_b: np.ndarray) -> list[tuple[range, range]]:
    """The tokens of each group; their product are the links of a group."""
    a, b, shared = overlaps(ends_a, ends_b)
    last_a, last_b = a[shared] + 1, b[shared] + 1
    return [(range(i, j), range(k, m)) for i, j, k, m in zip([0, *last_a], last_a, [0, *last_b], last_b)]


def byte_level() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable Latin ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Aligner:
    """Both tokenizers, and what is known of words: counts, the text of their groups, linked pairs."""

    def __init__(self, vocabulary: bytes, model: bytes, pattern: str):
        import sentencepiece
        import tiktoken

        spec, byte = json.loads(vocabulary), byte_level()
        added = {t["content"] for t in spec["added_tokens"] if t["special"]}
        known = {bytes(map(byte.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in added}
        order = [i for i in (known.get(bytes(byte[c] for c in (m.replace(" ", "", 1) if isinstance(m, str) else "".join(m)))) for m in spec["model"]["merges"])]
        if order != sorted(set(order)):
            raise ValueError("the vocabulary's ids don't follow its merges")
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=known, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.cuts = not any(_SPACE in p.lstrip(_SPACE) for p in pieces)
        self.size_a, self.size_b = np.zeros(max(known.values()) + 1, np.int64), np.array([len(x) for x in self.bytes_b])
        for token, i in known.items():
            self.size_a[i] = len(token)
        named = lambda n, sign: np.array([f"{i}{sign}" for i in range(n)], object)
        self.name_a, self.name_b = [[named(len(x), s) for s in signs] for x, signs in ((self.size_a, ",|"), (self.size_b, ",;"))]
        self.at: dict[str, int] = {}
        self.said: list[str] = []
        self.held: list[np.ndarray] = []  # n_a, n_b, n_groups, usable, white space at a border
        self.linked: list[np.ndarray] = []
        self.seen = np.zeros(0, np.int64)

    def forget(self) -> None:
        """Keep the words that were met more than once since the last call; all of them if too many are left."""
        stay = np.flatnonzero(self.seen > 1)
        stay = stay if len(stay) < WORDS // 2 else stay[:0]
        table, words = self.table(), list(self.at)
        self.linked = [self.links(stay)[0]]
        self.at = {words[k]: j for j, k in enumerate(stay.tolist())}
        self.said = [self.said[k] for k in stay.tolist()]
        self.held = [table[stay]]
        self.seen = np.zeros(len(stay), np.int64)

    def links(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that known words link, one word after the other, and where each word's begin."""
        if len(self.linked) > 1:
            self.linked = [np.concatenate(self.linked)]
        n = self.table()[:, 2]
        first, n = (np.cumsum(n) - n)[words], n[words]
        at = np.r_[0, np.cumsum(n)]
        flat = np.arange(at[-1]) + np.repeat(first - at[:-1], n)
        return (self.linked[0][flat] if self.linked else np.zeros(0, np.int64)), at

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, bool]:
        """The ids of both sides for a space and ``text``, and whether both give its bytes back."""
        a, b = self.a.encode_to_numpy(" " + text, disallowed_special=()).astype(np.int64), np.array(self.b.encode(text), np.int64)
        whole = (" " + text).encode()
        return a, b, b"".join(map(self.bytes_b.__getitem__, b.tolist())) == whole and self.size_a[a].sum() == len(whole)

    def learn(self, words: list[str]) -> None:
        """Align words that are not known yet: those without white space at their borders together."""
        some, n = [], 0
        for w in words:
            if not w or w[0].isspace() or w[-1].isspace():
                self._add([w], w, True)
                continue
            some.append(w)
            n += len(w) + 1
            if n > JOINED:
                self._add(some, " ".join(some), False)
                some, n = [], 0
        if some:
            self._add(some, " ".join(some), False)

    def _add(self, words: list[str], text: str, edge: bool) -> None:
        a, b, usable = self.encode(text)
        if not usable and len(words) > 1:
            for w in words:
                self._add([w], w, edge)
            return
        self.at |= {w: k for k, w in enumerate(words, len(self.said))}
        if not usable:
            self.said.append("")
            self.held.append(np.array([[0, 0, 0, 0, edge]]))
            return
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        own_a, own_b, shared = overlaps(ends_a, ends_b)
        last_a, last_b = own_a[shared], own_b[shared]
        ends = ends_a[last_a]
        # tokens in the order of the text of groups: those of A of a group, then those of B
        in_a, in_b = np.searchsorted(ends, ends_a), np.searchsorted(ends, ends_b)
        names = np.empty(len(a) + len(b), object)
        for ids, name, last, place in ((a, self.name_a, last_a, np.arange(len(a)) + np.r_[0, last_b + 1][in_a]), (b, self.name_b, last_b, np.arange(len(b)) + (last_a + 1)[in_b])):
            names[place] = name[0][ids]
            names[place[last]] = name[1][ids[last]]
        border = np.cumsum([len(w.encode()) + 1 for w in words])
        n_a, n_b, n_groups = (np.searchsorted(x, border, "right") for x in (ends_a, ends_b, ends))
        cut = [0, *(n_a + n_b).tolist()]
        self.said += ["".join(names[i:j]) for i, j in zip(cut, cut[1:])]
        ones = np.ones(len(words), np.int64)
        self.held.append(np.stack([np.diff(n_a, prepend=0), np.diff(n_b, prepend=0), np.diff(n_groups, prepend=0), ones, ones * edge], 1))
        self.linked.append(a[last_a] << 32 | b[last_b])

    def words(self, text: str) -> list[str]:
        """``text`` cut at its lone spaces."""
        return _LONE.split(text) if self.cuts else [text]

    def read(self, texts: list[str | None]) -> list[np.ndarray]:
        """The known words that each text consists of; none where it has no tokens."""
        cut = [t.split(" ") if t and self.cuts else [t] if t else [] for t in texts]
        self._know(w for c in cut for w in c)
        table = self.table()
        found = [np.array([self.at[w] for w in c], np.int64) for c in cut]
        for k, (t, f) in enumerate(zip(texts, found)):
            if self.cuts and table[f, 4].any():  # a space that isn't a lone one
                self._know(c := self.words(t))
                table = self.table()
                found[k] = f = np.array([self.at[w] for w in c], np.int64)
            if not table[f, 3].all():
                found[k] = f[:0]
        return found

    def _know(self, words: Iterator[str]) -> None:
        if new := [w for w in dict.fromkeys(words) if w not in self.at]:
            self.learn(new)

    def table(self) -> np.ndarray:
        if len(self.held) > 1:
            self.held = [np.concatenate(self.held)]
        return self.held[0] if self.held else np.zeros((0, 5), np.int64)

    def digest(self, words: np.ndarray) -> str:
        """SHA-256 of the text of all groups, hashed piece by piece."""
        if not len(words):
            return ""
        h = hashlib.sha256()
        for i in range(0, len(words), 100_000):
            piece = "".join([self.said[k] for k in words[i : i + 100_000].tolist()])
            h.update(piece[: None if i + 100_000 < len(words) else -1].encode())
        return h.hexdigest()

    def part(self, number: int, ids: list[int | None], found: list[np.ndarray]) -> pa.RecordBatch:
        """A row for each document, and one with the part's pairs: ``at`` and ``links`` say which each word links."""
        table, sizes = self.table(), [len(f) for f in found]
        flat = np.concatenate([*found, np.zeros(0, np.int64)])
        times = np.bincount(flat, minlength=len(table))
        used = np.flatnonzero(times)
        local = np.cumsum(times > 0) - 1
        self.seen = np.r_[self.seen, np.zeros(len(table) - len(self.seen), np.int64)] + times
        linked, at = self.links(used)
        pairs, links = np.unique(linked, return_inverse=True)
        sums = np.zeros(len(pairs), np.int64)
        np.add.at(sums, links, np.repeat(times[used], table[used, 2]))
        counts = np.array([table[f, :3].sum(0) for f in found] or np.zeros((0, 3)), np.int64).reshape(-1, 3)
        one = lambda x, kind: pa.array([None] * len(found) + [x], pa.list_(kind))
        words = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes, 0]), pa.int32()), pa.array(local[flat].astype(np.int32)))
        plain = lambda x: pa.array([*x, None], pa.int64())
        columns = [pa.array([number] * (len(found) + 1), pa.int64()), plain(ids), *(plain(c) for c in counts.T.tolist()), pa.array([*map(self.digest, found), None], pa.string()), words]
        columns += [one(pairs, pa.int64()), one(sums, pa.int64()), one(at.astype(np.int32), pa.int32()), one(links.astype(np.int32), pa.int32())]
        return pa.RecordBatch.from_arrays(columns, [c.split(" ")[0] for c in ROWS.split(", ")])


_made: dict[str, Aligner] = {}


def aligned(docs: DataFrame, vocabulary: str, model: str, pattern: str) -> DataFrame:
    """``ROWS``: for each document its words, for each part the pairs that its words link.

    Only doc_id and text are read. The two files (a few MB, checked) go to the executors as a broadcast.
    """
    with open(vocabulary, "rb") as f, open(model, "rb") as g:
        files = f.read(), g.read()
    if max(map(len, files)) > 32 << 20:
        raise ValueError("a vocabulary is too large to send to every executor")
    key = hashlib.sha256(b"".join(files) + pattern.encode()).hexdigest()
    sent = docs.sparkSession.sparkContext.broadcast((*files, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _made:
            _made.clear()
            _made[key] = Aligner(*sent.value)
        own, number = _made[key], TaskContext.get().partitionId() << 32
        ids, found, size = [], [], 0
        for b in batches:
            texts = b.column(1).to_pylist()
            ids += b.column(0).to_pylist()
            found += own.read(texts)
            size += sum(len(t) for t in texts if t)
            if size > PART_BYTES:
                yield own.part(number, ids, found)
                ids, found, size, number = [], [], 0, number + 1
                if len(own.said) > WORDS:
                    own.forget()
        if ids:
            yield own.part(number, ids, found)

    small_batches(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, ROWS)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, best): how often each pair is linked in all documents, and whether no pair of its B id is linked more often."""
    each = rows.where("pairs is not null").select(F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    n = each.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("n"))
    # a window holds the A ids of one B id: as many as the vocabulary has
    most = F.max("n").over(Window.partitionBy(F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))))
    return n.select("pair", "n", (F.col("n") == most).alias("best"))


def _scored(mine: pa.Table, counts: pa.Table) -> pa.Table:
    """The documents of a part with their sums over links."""
    whole = mine.column("pairs").is_valid()
    words = mine.filter(whole).combine_chunks()
    docs = mine.filter(pa.compute.invert(whole)).combine_chunks()
    at, links = (words.column(c).combine_chunks().flatten().to_numpy() for c in ("at", "links"))
    order = np.argsort(counts.column("place").to_numpy())
    n, best = counts.column("n").to_numpy()[order], counts.column("best").to_numpy()[order].astype(np.int64)
    sums = [np.r_[0, np.cumsum(x[links])] for x in (n, best)]
    by_word = [s[at[1:]] - s[at[:-1]] for s in sums]
    lists = docs.column("words").combine_chunks()
    flat, ends = lists.flatten().to_numpy(), np.cumsum(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)
    out = [np.diff(np.r_[0, np.cumsum(x[flat])][np.r_[0, ends]]) for x in by_word]
    same = [docs.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_groups")]
    return pa.table([*same, pa.array(out[1]), pa.array(out[0]), docs.column("groups_sha256")], names=[c.split(" ")[0] for c in RESULT.split(", ")])


def alignment(docs: DataFrame, vocabulary: str, model: str, pattern: str) -> DataFrame:
    """``RESULT``, a row for each row of ``docs``; links are pairs of tokens that end together.

    Null and empty texts, and those of which a tokenizer doesn't give the bytes back, have no tokens: zeros and
    an empty digest. Repeated rows, null ids and ids that occur more than once are rows of their own; an empty
    table gives none. A text has to fit a task.
    """
    rows = keep(aligned(docs, vocabulary, model, pattern), "aligned")
    places = rows.where("pairs is not null").select("part", F.posexplode("pairs").alias("place", "pair"))
    counts = keep(places.join(pair_counts(rows), "pair").select("part", "place", "n", "best"), "pair-counts")
    empty = rows.where("size(pairs) = 0").select("part", F.lit(-1).alias("place"), F.lit(0).cast("long").alias("n"), F.lit(False).alias("best"))
    slim = rows.select("part", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "words", "pairs", "at", "links")
    return slim.groupBy("part").cogroup(counts.union(empty).groupBy("part")).applyInArrow(_scored, RESULT)
