"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A 64-bit fingerprint is cut into four 16-bit blocks. For a pair at distance 1 to 3 some block holds
at least one of the differing bits; with that block masked out at most two bits differ, so the balls
of radius 1 (half the radius, rounded down) around both masked fingerprints share a point. Every
distinct fingerprint therefore emits, for each masked block, itself and its 48 one-bit variants:
196 keys of 48 bits, whatever the data. Rows are shuffled by key, and the fingerprints that meet at
a key are verified on all 64 bits; each key emits only a spanning forest of its verified links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, groups_of, keep, small_batches

RADIUS = 3
BLOCK_BITS = 16
HOT = 1000  # a fingerprint of a thousandth of all rows is joined without a shuffle
_LANES = np.uint64(0x0101010101010101)
_SHIFTS = np.arange(8, dtype=np.uint64)
_CHUNK = 255 * 256


def _bit_counts(h: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set; sums run in byte lanes over at most 255 values."""
    lanes = (h[:, None] >> _SHIFTS) & _LANES
    sums = np.add.reduceat(lanes, np.arange(0, len(h), 255), axis=0)
    return sums.view(np.uint8).reshape(len(sums), 8, 8).sum(axis=0, dtype=np.int64).T.ravel()


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """SimHash of a UTF-8 text's word shingles as a signed 64-bit integer; 0 without words."""
    w = (text or b"").lower().split()
    if not w:
        return 0
    if len(w) < words:
        shingles = iter([b" ".join(w)])
    else:
        shingles = map(b" ".join, zip(*(w[i:] for i in range(words))))
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(42))
    counts, n = np.zeros(64, np.int64), 0
    while len(h := np.fromiter(islice(hashes, _CHUNK), np.uint64)):
        counts += _bit_counts(h)
        n += len(h)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): one row for each row of ``docs``; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t, words) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    small_batches(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, fp long")


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def variants(fps: DataFrame) -> DataFrame:
    """(key, fp): the masked balls of radius 1 around each fingerprint; a key carries its block's tag."""
    masks = []
    for block in range(64 // BLOCK_BITS):
        hole = ((1 << BLOCK_BITS) - 1) << (block * BLOCK_BITS)
        tag = (block + 1) << (block * BLOCK_BITS)
        flips = [0] + [1 << b for b in range(64) if not hole >> b & 1]
        masks += [F.struct(F.lit(_signed(~hole)).alias("keep"), F.lit(_signed(tag | f)).alias("flip")) for f in flips]
    m = fps.select("fp", F.explode(F.array(*masks)).alias("m"))
    return m.select(F.col("fp").bitwiseAND(F.col("m.keep")).bitwiseXOR(F.col("m.flip")).alias("key"), "fp")


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits. Unsigned, as NumPy counts the bits of a negative number's absolute value."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges that connect what is connected among these fingerprints by links of at most ``radius``."""
    out, left = [], fps
    while len(left) > 1:
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            x = stack.pop()
            near = _distance(left, np.full_like(left, x)) <= radius
            if near.any():
                found = left[near]
                out += [(x, y) for y in found]
                stack += list(found)
                left = left[~near]
    return out


def _links(key: np.ndarray, fp: np.ndarray, radius: int) -> set[tuple[int, int]]:
    """Verified links of whole groups; rows are sorted by key."""
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[at, len(key)])
    two = at[size == 2]
    a, b = fp[two], fp[two + 1]
    ok = _distance(a, b) <= radius
    found = set(zip(np.minimum(a, b)[ok].tolist(), np.maximum(a, b)[ok].tolist()))
    for i, n in zip(at[size > 2], size[size > 2]):
        found.update((int(min(x, y)), int(max(x, y))) for x, y in _forest(fp[i : i + n], radius))
    return found


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links among distinct fingerprints (column fp), enough of them to connect every component.

    Memory of a task: one Arrow batch and one key's fingerprints, which lie within one bit of the key
    outside its masked block.
    """
    if radius > RADIUS:
        raise ValueError(f"the masks are exact up to radius {RADIUS}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, fs in groups_of(batches):
            yield pack(_links(keys, fs, radius))

    def pack(found: set[tuple[int, int]]) -> pa.RecordBatch:
        a, b = zip(*found) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    dealt = variants(fps).repartition("key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs``.

    component_id is the smallest doc_id reachable over links of at most ``radius`` differing bits,
    the row's own included. Rows with equal fingerprints (repeated rows, exact copies, and all
    documents without words, null texts among them) are one node. A null doc_id takes part but is
    never the smallest unless a component has no other. An empty table gives an empty result.
    """
    all_fps = keep(fingerprints(docs, words), "simhash")
    nodes = keep(all_fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "nodes")
    roots = components(links(nodes.select("fp"), radius)).withColumnRenamed("node", "fp")
    joined = roots.join(nodes, "fp")
    lowest = joined.groupBy("root").agg(F.min("first").alias("lowest"))
    linked = joined.join(lowest, "root").select("fp", "lowest")
    final = nodes.join(linked, "fp", "left").select("fp", "n", F.coalesce("lowest", "first").alias("component_id"))
    final = keep(final, "final")
    # Fingerprints that a thousandth of all rows share are a thousand at most: their rows stay where they are.
    total = final.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(final.where(F.col("n") * HOT >= total).select("fp", "component_id"))
    rest = all_fps.join(hot.drop("component_id"), "fp", "left_anti").join(final.where(F.col("n") * HOT < total), "fp")
    return rest.select("doc_id", "fp", "component_id").unionAll(all_fps.join(hot, "fp").select("doc_id", "fp", "component_id"))
