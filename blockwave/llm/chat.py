"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole and encoded once; the lengths of the tokens' bytes give their
character offsets, and the sorted spans of the turns to learn from are intersected with the sorted
token spans by binary search. Control strings are added tokens, so a token never crosses the border of
a turn's text; control strings inside texts are escaped, reversibly.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Our own control strings, and those of other templates and of the vocabulary, which no text may show raw.
CONTROL = (TURN, TEXT, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_ESCAPE = re.compile(r"\\|" + "|".join(map(re.escape, CONTROL)))
_UNESCAPE = re.compile(r"\\(.)", re.S)
LEARN = "assistant"
SCHEMA = "conv_id long, formatted string, ids array<int>, starts array<int>, ends array<int>, mask array<boolean>"


def escape(text: str) -> str:
    """Backslashes doubled, and one put after the first character of each control string."""
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: "\\" if m[1] == "\\" else m[1], text)


def render(turns: list[tuple[str, str]], learn: str = LEARN) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the sorted spans of the texts to learn from."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        if role == learn and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def read(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns = []
    for part in formatted.split(TURN)[1:]:
        role, _, text = part.partition(TEXT)
        turns.append((unescape(role), unescape(text.removesuffix(END))))
    return turns


def mask_of(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens overlap one of the spans; both are sorted."""
    mask = np.zeros(len(starts), bool)
    if spans and len(starts):
        a, b = np.array(spans).T
        for i, j in zip(np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left")):
            mask[i:j] = True
    return mask


def learned(formatted: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> str:
    """All text under the mask, unescaped: the union of the masked tokens' spans, run by run."""
    edges = np.flatnonzero(np.diff(np.r_[False, mask, False]))
    return "".join([unescape(formatted[starts[i] : ends[j - 1]]) for i, j in edges.reshape(-1, 2).tolist()])


class Tokenizer:
    """A byte-level rank file with our control strings as added tokens, and the offsets of its tokens."""

    def __init__(self, ranks: bytes, pattern: str):
        import tiktoken

        known = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        first = max(known.values()) + 2  # one number is free for the vocabulary's own end of text
        added = {c: first + k for k, c in enumerate((TURN, TEXT, END))}
        self.encoding = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=known, special_tokens=added)
        self.size = np.zeros(first + len(added), np.int64)
        for token, i in [*known.items(), *((c.encode(), i) for c, i in added.items())]:
            self.size[i] = len(token)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, and where each token's characters start and end; tokens that share a character both have it."""
        ids = self.encoding.encode_to_numpy(text, allowed_special="all")
        ends = np.cumsum(self.size[ids])
        if text.isascii():
            return ids, ends - self.size[ids], ends
        lead = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
        before = np.r_[0, np.cumsum(lead)]
        starts = ends - self.size[ids]
        return ids, before[starts] - ~lead[starts], before[ends]


def format_chats(conversations: DataFrame, path: str, pattern: str, learn: str = LEARN) -> DataFrame:
    """(conv_id, formatted, ids, starts, ends, mask), one row for each conversation.

    Rows are taken by turn; of rows with one turn, by role and text. Null roles and texts count as
    empty, a null turn comes first, each row without conv_id is a conversation of its own, repeated rows
    are repeated turns. A task holds one conversation at a time. ``path`` is a byte-level rank file of a
    few MB at most (checked), which goes to the executors as a broadcast, ``pattern`` its expression.
    """
    with open(path, "rb") as f:
        ranks = f.read()
    if len(ranks) > 32 << 20:
        raise ValueError(f"{path} is too large to send to every executor")
    sent = conversations.sparkSession.sparkContext.broadcast((ranks, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Tokenizer(*sent.value)

        def done(conv: int | None, turns: list[tuple[str, str]]) -> tuple:
            formatted, spans = render(turns, learn)
            ids, starts, ends = t.encode(formatted)
            return conv, formatted, ids, starts, ends, mask_of(starts, ends, spans)

        def pack(rows: list[tuple]) -> pa.RecordBatch:
            conv, formatted, *arrays = zip(*rows) if rows else ((),) * 6
            offsets = pa.array(np.cumsum([0, *map(len, arrays[0])]), pa.int32())
            flat = [np.concatenate(a or ([],)).astype(kind) for a, kind in zip(arrays, (np.int32, np.int32, np.int32, bool))]
            lists = [pa.ListArray.from_arrays(offsets, pa.array(a)) for a in flat]
            return pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(formatted, pa.string()), *lists], ["conv_id", "formatted", "ids", "starts", "ends", "mask"])

        now, turns = None, []
        for b in batches:
            rows, size = [], 0
            for conv, role, text in zip(*(b.column(k).to_pylist() for k in range(3))):
                if turns and (conv is None or conv != now):
                    rows.append(done(now, turns))
                    size += len(rows[-1][1])
                    turns = []
                    if size > 1 << 20:
                        yield pack(rows)
                        rows, size = [], 0
                now = conv
                turns.append((role, text))
            yield pack(rows)
        if turns:
            yield pack([done(now, turns)])

    small_batches(conversations.sparkSession)
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), word("role"), word("text"), F.col("turn").cast("long").alias("turn"))
    rows = rows.withColumn("alone", F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()))
    dealt = rows.repartition("conv_id", "alone").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return dealt.mapInArrow(run, SCHEMA)


def digests(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            starts, ends, mask = (b.column(k).flatten().to_numpy(zero_copy_only=False) for k in (2, 3, 4))
            at = np.r_[0, np.cumsum(pa.compute.list_value_length(b.column(2)).to_numpy(zero_copy_only=False))].astype(int)
            for k, (conv, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                turns = read(text)
                own = "".join(f"{r}\n{t}\n" for r, t in turns)
                i, j = at[k], at[k + 1]
                loss = learned(text, starts[i:j], ends[i:j], mask[i:j])
                rows.append((conv, len(turns), hashlib.sha256(own.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 6, kinds)], names)

    kind = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select("conv_id", "formatted", "starts", "ends", "mask").mapInArrow(run, kind)
