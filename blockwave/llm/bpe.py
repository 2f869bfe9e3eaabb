"""BPE encoding by a bounded-lookahead transducer, and incremental decoding.

A merge list fixes how far to the right a token can depend on its text: a merge of rank r can only
be prevented by a merge of lower rank that takes a part of its right edge, that one only by one of
still lower rank, and so on. ``MergeTable.lookahead`` is the longest such chain, in symbols. A
token is stable once that many symbols follow it; the transducer then emits it and forgets its
symbols, so a word of any length needs a buffer of fixed size. Every pre-token goes through it once;
what it gave is remembered in a table of bounded size. Texts are read a segment at a time, and the
ids of each segment go through the incremental decoder. Where the file splits at white space as ``WORDS``
does, a segment ends at any white space, and one without any is read in pieces of ``SEGMENT``
characters: pre-tokens that are complete are encoded, a long one goes on through the transducer. Other
files' texts are cut at lone white spaces only.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

SEGMENT = 1 << 16  # characters of a text that are in work at once
HELD = 4  # characters that stay back, as the expression may still make other matches of them
REMEMBER = 120_000  # pre-tokens in each generation of a worker's table
_ID, _MASK = 20, (1 << 20) - 1  # bits of an id
_UNKNOWN = -1  # a symbol that the vocabulary does not have; it merges with nothing and has no token


class MergeTable:
    def __init__(self, vocab: dict[str, int], merges: list, suffix: str = ""):
        self.vocab, self.suffix = vocab, suffix
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.lookahead = self._lookahead(pairs)
        # A pair of ids to rank and new id in one number, in order of rank.
        self.pairs = {vocab[a] << _ID | vocab[b]: r << _ID | vocab[a + b] for r, (a, b) in enumerate(pairs)}
        self.length = {i: self._length(t) for t, i in vocab.items()}
        self.symbols = {t: i for t, i in vocab.items() if len(t) == 1}
        self.ends = {t.removesuffix(suffix): i for t, i in vocab.items() if t.endswith(suffix) and len(t) == 1 + len(suffix)}

    def _length(self, token: str) -> int:
        return len(token.removesuffix(self.suffix)) if self.suffix else len(token)

    def _lookahead(self, pairs: list[tuple[str, str]]) -> int:
        """Symbols to the right on which the end of a token can depend."""
        made = {}  # token: the first merge that makes it
        ranks: dict[str, list[int]] = {}  # left part: ranks of its merges, ascending
        reach: dict[str, list[int]] = {}  # and the largest reach among those up to each rank
        longest = 0
        for r, (u, v) in enumerate(pairs):
            far, part, above = 0, v, r
            while True:  # down the right edge of the merged token
                if part in ranks and (k := bisect_left(ranks[part], above)):
                    far = max(far, reach[part][k - 1])
                if part not in made:
                    break
                above = made[part]
                part = pairs[above][1]
            made.setdefault(u + v, r)
            own = self._length(v) + far
            ranks.setdefault(u, []).append(r)
            reach.setdefault(u, []).append(max(own, reach[u][-1] if reach.get(u) else 0))
            longest = max(longest, own)
        return longest

    def merge(self, out: list[int]) -> list[int]:
        """All merges of a list of ids, in place: lowest rank first and leftmost of equal ranks."""
        get, none = self.pairs.get, 1 << 62
        ranks = [get(a << _ID | b, none) for a, b in zip(out, out[1:])]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            out[i : i + 2] = [best & _MASK]
            del ranks[i]
            if i:
                ranks[i - 1] = get(out[i - 1] << _ID | out[i], none)
            if i < len(ranks):
                ranks[i] = get(out[i] << _ID | out[i + 1], none)
        return out


class Transducer:
    """Ids of one pre-token whose symbols arrive in pieces; ``push`` returns those now stable."""

    def __init__(self, table: MergeTable):
        self.table, self.buffer = table, ""
        self.window = 2 * table.lookahead + 1

    def push(self, piece: str) -> list[int]:
        table, out = self.table, []
        self.buffer += piece
        most = self.window + table.lookahead
        at = 0
        # The last symbol stays: it may turn out to be the word's end, which is another symbol.
        while len(self.buffer) - at > most + 1:
            now = at
            for i in table.merge([table.symbols.get(c, _UNKNOWN) for c in self.buffer[at : at + most]]):
                size = table.length.get(i, 1)
                if now + size > at + self.window:
                    break
                out.append(i)
                now += size
            at = now
        self.buffer = self.buffer[at:]
        return out

    def finish(self) -> list[int]:
        if not self.buffer:
            return []
        get = self.table.symbols.get
        out = [get(c, _UNKNOWN) for c in self.buffer]
        out[-1] = self.table.ends.get(self.buffer[-1], _UNKNOWN)
        self.buffer = ""
        return self.table.merge(out)


class Decoder:
    """Ids to text, some at a time. Tokens that are bytes go through an incremental UTF-8 decoder, which keeps
    the bytes of an unfinished character; others are joined with a space between two."""

    def __init__(self, tokens: list[str] | list[bytes]):
        self.tokens, self.byte_level, self.first = tokens, isinstance(tokens[0], bytes), True
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def restart(self) -> Decoder:
        self.first = True
        self.utf8.reset()
        return self

    def push(self, ids: list[int]) -> str:
        """The text that these ids complete."""
        if self.byte_level:
            return self.utf8.decode(b"".join(map(self.tokens.__getitem__, ids)))
        if not ids:
            return ""
        gap, self.first = "" if self.first else " ", False
        return gap + " ".join(map(self.tokens.__getitem__, ids))

    def finish(self) -> str:
        return self.utf8.decode(b"", True) if self.byte_level else ""


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


#: The expression of word-level byte BPE files. Below U+0250 the three steps of their
#: normalizer come down to lower case, as no two of those characters compose.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
STEPS = ["NFC", "Replace", "Lowercase"]
#: White space as the tokenizer's expressions have it; str.split() also splits at the four separators.
_SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_HIGH = re.compile("[\u0250-\U0010ffff]")


def spec_pattern(j: dict) -> str:
    """The split expression of a file with that normalizer, else nothing."""
    steps = [x["type"] for x in (j.get("normalizer") or {}).get("normalizers", [])]
    parts = (j.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if steps != STEPS or [p["type"] for p in parts] != ["Split", "ByteLevel"]:
        return ""
    return parts[0]["pattern"].get("Regex", "")


def _latin_words() -> re.Pattern:
    """``WORDS`` over lower-cased characters below U+0250, and the marks that lower case makes of them."""
    def of(kind: str) -> str:
        return "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == kind)

    letters, numbers = of("L"), of("N")
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\t-\r \x85\xa0{letters}{numbers}]+")


def _apart(a: str, b: str) -> bool:
    """Whether a text can be cut between these two before it is normalized: ``b`` neither joins nor moves."""
    form = unicodedata.normalize
    return unicodedata.category(b)[0] != "M" and not "\u1160" <= b <= "\u11ff" and form("NFC", a + b) == form("NFC", a) + form("NFC", b)


class _Known(dict):
    """Ids by pre-token. What is asked for again moves from the older table to this one, and a full one ages."""

    def __init__(self, make):
        self.make, self.older = make, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if (found := self.older.get(piece)) is None:
            found = self.make(piece)
        if len(self) >= REMEMBER:
            self.older = dict(self)
            self.clear()
        if len(piece) <= SEGMENT >> 8:
            self[piece] = found
        return found


class Encoder:
    """Texts to ids and back, as a tokenizers file has it.

    Merges and decoding are this module's, and so is the splitting of Latin words where the file has the
    usual expression; the file's own normalizer and pre-tokenizer (library parts) run on other text.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        j = json.loads(spec)
        lib, model = Tokenizer.from_str(spec), j["model"]
        self.normalize = lib.normalizer.normalize_str if lib.normalizer else str
        self.split = lib.pre_tokenizer.pre_tokenize_str
        self.table = MergeTable(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")
        self.added = {a["content"]: a["id"] for a in j["added_tokens"]}
        ids = model["vocab"] | self.added
        byte_level = bool(j.get("decoder")) and j["decoder"]["type"] == "ByteLevel"
        own = {c: b for b, c in byte_alphabet().items()}
        self.tokens: list = [b"" if byte_level else ""] * (max(ids.values()) + 1)
        for t, i in ids.items():
            self.tokens[i] = t if not byte_level else t.encode() if t in self.added else bytes(own[c] for c in t)
        self.latin = _latin_words() if lib.normalizer is not None and spec_pattern(j) == WORDS else None
        self.shown = {b: c for b, c in byte_alphabet().items()}
        self.names = [str(i) for i in range(len(self.tokens))]
        self.transducer = Transducer(self.table)
        self.known = _Known(self.piece)
        self.words = _Known(self.word)
        self.control = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or "(?!)")

    def decoder(self) -> Decoder:
        return Decoder(self.tokens)

    def piece(self, piece: str) -> tuple[int, ...]:
        """The ids of one pre-token in the byte-level alphabet, by the transducer."""
        t, out = self.transducer, []
        for k in range(0, len(piece), SEGMENT):
            out += t.push(piece[k : k + SEGMENT])
        out += t.finish()
        return tuple(out) if min(out, default=0) >= 0 else tuple([i for i in out if i >= 0])

    def word(self, word: str) -> tuple[int, ...]:
        """The ids of a pre-token, whose bytes stand in the byte-level alphabet for the merge list."""
        return self.piece(word if word.isascii() and word.isprintable() else self.in_bytes(word))

    def in_bytes(self, text: str) -> str:
        return text.encode().decode("latin-1").translate(self.shown)

    def ids(self, part: str) -> list[int]:
        """The ids of a part of a text without special tokens, cut where no pre-token is."""
        if self.latin is None:
            found = [self.known[p] for p, _ in self.split(self.normalize(part))]
        elif not _HIGH.search(part):
            found = map(self.words.__getitem__, self.latin.findall(part.lower()))
        else:
            found = []
            for chunk in _SPACE.split(part):
                if _HIGH.search(chunk):
                    found += [self.known[p] for p, _ in self.split(self.normalize(chunk))]
                else:
                    found += map(self.words.__getitem__, self.latin.findall(chunk.lower()))
        return list(chain.from_iterable(found))

    def cut(self, text: str, at: int, end: int) -> int:
        """Where a segment that begins at ``at`` ends: at a white space, if there is any. One that the file's
        expression may join with its neighbours has to stand between two other characters."""
        if self.latin is not None and end - at > SEGMENT:
            if (w := text.rfind(" ", at + 1, at + SEGMENT)) > 0:
                return w
            found = [m.start() for m in _SPACE.finditer(text, at + 1, at + SEGMENT)] or [m.start() for m in [_SPACE.search(text, at + SEGMENT, end)] if m]
            return found[-1] if found else end
        while end - at > SEGMENT and (w := _SPACE.search(text, at + SEGMENT, end)):
            if w.end() == w.start() + 1 < end and not _SPACE.match(text, w.start() - 1):
                return w.start()
            if w.end() >= end:
                break
            at = w.end() - SEGMENT
        return end

    def run(self, text: str, at: int, end: int) -> Iterator[list[int]]:
        """The ids of a part without white space, ``SEGMENT`` characters at a time.

        Each piece is normalized by itself, as it begins with a character that joins no earlier one. Of the
        matches in the buffer those that end before its last ``HELD`` characters are complete. One that
        does not end is pushed but for as many of its characters, from which the expression finds the same end.
        """
        buffer, long = "", None
        while at < end:
            to = min(at + SEGMENT, end)
            while to < end and not _apart(text[to - 1], text[to]):
                to += 1
            buffer += self.normalize(text[at:to])
            at, out, done = to, [], len(buffer)
            for piece, (a, b) in self.split(buffer):
                if at < end and b > len(buffer) - HELD:
                    done = a
                    if b - a > SEGMENT // 2:
                        long, done = long or Transducer(self.table), b - HELD
                        out += long.push(self.in_bytes(buffer[a:done]))
                    break
                if long:
                    out += long.push(piece) + long.finish()
                    long = None
                else:
                    out += self.known[piece]
            buffer = buffer[done:]
            yield [i for i in out if i >= 0]

    def stream(self, text: str) -> Iterator[list[int]]:
        """The ids of a text, a segment at a time."""
        at = 0
        while at < len(text):
            m = self.control.search(text, at)
            end = m.start() if m else len(text)
            while at < end:
                if self.latin is not None and (w := _SPACE.match(text, at, end)):
                    at = w.end()
                    continue
                cut = self.cut(text, at, end)
                if self.latin is not None and cut - at > SEGMENT:
                    yield from self.run(text, at, cut)
                else:
                    yield self.ids(text[at:cut])
                at = cut
            if m:
                yield [self.added[m[0]]]
                at = m.end()

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.stream(text)))

    def digests(self, text: str, decoder: Decoder | None = None, keep: list[int] | None = None) -> tuple[int, str, str]:
        """n_tokens, and the SHA-256 of the ids and of what the decoder makes of them; ids are added to ``keep``."""
        n, ids_sha, text_sha, gap = 0, hashlib.sha256(), hashlib.sha256(), ""
        dec, name = (decoder or self.decoder()).restart(), self.names.__getitem__
        for ids in self.stream(text):
            if ids:
                n += len(ids)
                ids_sha.update((gap + " ".join(map(name, ids))).encode())
                text_sha.update(dec.push(ids).encode())
                gap = " "
                if keep is not None:
                    keep += ids
        text_sha.update(dec.finish().encode())
        return n, ids_sha.hexdigest(), text_sha.hexdigest()


_encoders: dict[str, Encoder] = {}


def encoder(spec: str) -> Encoder:
    """One for each worker process, as its table of words is worth keeping."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(spec)
    return _encoders[key]


def encode(docs: DataFrame, path: str, ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids array<int>]) for each row of ``docs``.

    ``path`` is a tokenizers file; its text goes to the executors once, as a broadcast of a few MB at
    most (checked). A null text counts as empty: no tokens and digests of nothing. Repeated rows give
    repeated rows; other columns are ignored; an empty table gives an empty result.
    """
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    if len(spec) > 32 << 20:
        raise ValueError(f"{path} is too large to send to every executor")
    sent = docs.sparkSession.sparkContext.broadcast(spec)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(sent.value)
        dec = enc.decoder()
        for b in batches:
            lists: list[list[int]] = [[] for _ in range(b.num_rows if ids else 0)]
            found = [enc.digests(t or "", dec, lists[k] if ids else None) for k, t in enumerate(b.column(1).to_pylist())]
            n, i, d = zip(*found) if found else ((), (), ())
            columns = [b.column(0), pa.array(n, pa.int64()), pa.array(i, pa.string()), pa.array(d, pa.string())]
            if ids:
                columns.append(pa.array(lists, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names)

    small_batches(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kinds = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return slim.mapInArrow(run, kinds + ", ids array<int>" * ids)
