"""The prefix trie of conversations, read off a sorted list.

A conversation is a key: for each turn 16 bytes of its digest and 8 of its text's size. Sorted keys give an
array of longest common prefixes (LCP, in turns), whose Cartesian tree has the branching nodes: the
interval of an LCP reaches to the nearest smaller value on either side, equal values are one node, and
the depths between a node and its parent have the same interval.

Keys are sorted by range into blocks. Each block finds its own nearest smaller values; nodes that go on
in a neighbour are pieces. Where a piece begins is the nearest block to the left whose minimum is below its
depth, so block minima (three numbers for each block) settle all of them, and pieces are summed by
(first block, depth). Sums over a subtree are differences of running sums over its interval.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import keep, small_batches

ENTRY = 24
#: Conversations in a block, on average. A block's keys and nodes are held by one task.
BLOCK = 4096
#: Nodes in an Arrow batch.
NODES = 50_000
NOTHING = hashlib.sha256(b"").hexdigest()
LOCAL = (
    "block long, first long, depth long, left boolean, right boolean, n_convs long, conv_id long, n_children long, n_leaves long, saved long, before long, ends string, chunk string, "
    "up_first long, up_left boolean, up_right boolean, up_conv_id long, rows long, low long, head binary, tail binary"
)


def keys(conversations: DataFrame, shared_turns: int = 9, family: int = 5) -> DataFrame:
    """(conv_id, key): each conversation begins with some turns of the first of its family.

    The first h turns, h = crc32(conv_id) % ``shared_turns``, are those of conversation c - c % ``family``. Texts
    stay where they are read; only entries of 24 bytes are shuffled, once.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.substring(F.sha2(F.concat_ws("\n", F.octet_length(role).cast("string"), role, text), 256), 1, 32))
    size = F.unhex(F.lpad(F.hex(F.octet_length(text).cast("long")), 16, "0"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.concat(digest, size).alias("entry"))
    rows = rows.withColumn("base", F.col("conv_id") - F.col("conv_id") % family).repartition("base")
    turns = F.sort_array(F.collect_list(F.struct("turn", "entry"))).getField("entry")
    # joined as hexadecimal digits: Spark joins arrays of strings only
    blob = F.unhex(F.array_join(F.transform(turns, F.hex), ""))
    whole = rows.groupBy("base", "conv_id").agg(blob.alias("blob"))
    near = whole.groupBy("base").agg(F.collect_list(F.struct("conv_id", "blob")).alias("all"), F.max(F.when(F.col("conv_id") == F.col("base"), F.col("blob"))).alias("head"))
    each = near.select("head", F.explode("all").alias("c")).select("c.conv_id", "c.blob", F.coalesce("head", F.unhex(F.lit(""))).alias("head"))
    cut = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared_turns * ENTRY).cast("int")
    return each.select("conv_id", F.concat(F.col("head").substr(F.lit(1), cut), F.col("blob").substr(cut + 1, F.octet_length("blob"))).alias("key"))


def common(a: bytes, b: bytes) -> int:
    """How many turns two keys share at their beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // ENTRY
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int(np.argmax(x != y)) // ENTRY


def nearest_smaller(values: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For each value the places of the nearest smaller ones on its left (-1: none) and right (len: none)."""
    n, stack = len(values), []
    left, right = [-1] * n, [n] * n
    for i, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            right[stack.pop()] = i
        if stack:
            left[i] = stack[-1] if values[stack[-1]] < v else left[stack[-1]]
        stack.append(i)
    return np.array(left), np.array(right)


def block_nodes(number: int, ids: list[int], found: list[bytes]) -> Iterator[pa.RecordBatch]:
    """All nodes of a block of sorted keys, as if there were no others, and a row about the block itself."""
    n = len(ids)
    conv = np.array(ids, np.int64)
    length = np.array([len(k) // ENTRY for k in found], np.int64)
    lcp = np.array([-1, *(common(a, b) for a, b in zip(found, found[1:])), -1], np.int64)
    sizes = [np.frombuffer(k, np.dtype([("digest", "S16"), ("size", ">u8")]))["size"].astype(np.int64) for k in found]
    start = np.r_[0, np.cumsum(length + 1)]
    upto = np.concatenate([np.r_[0, np.cumsum(s)] for s in sizes])  # bytes of the first d turns of key i: upto[start[i] + d]
    total = upto[start[1:] - 1]
    shared = np.maximum(lcp[:-1], 0)
    fresh = np.r_[0, np.cumsum(total - upto[start[:-1] + shared])]
    bytes_, leaves = np.r_[0, np.cumsum(total)], np.r_[0, np.cumsum(np.r_[lcp[1:-1] < length[:-1], False])]
    # branching nodes: the intervals of inner LCPs, equal ones once; chains: what a key has below both its neighbours
    left, right = nearest_smaller(lcp.tolist())
    inner = np.arange(1, n)
    spans = np.stack([left[inner], right[inner] - 1, lcp[inner]], 1) if n > 1 else np.zeros((0, 3), np.int64)
    spans, times = np.unique(spans, axis=0, return_counts=True) if n > 1 else (spans, np.zeros(0, np.int64))
    above = np.maximum(lcp[:-1], lcp[1:])
    own = np.flatnonzero(length > above)
    a, b = np.r_[spans[:, 0], own], np.r_[spans[:, 1], own]
    deep = np.r_[spans[:, 2], length[own]]
    top = np.r_[np.maximum(lcp[spans[:, 0]], lcp[spans[:, 1] + 1]), above[own]]  # the parent's depth
    same = _classes(lcp, length)
    run = np.searchsorted(same, same, "right")  # where the keys equal to each end
    at_end = np.where(length[spans[:, 0]] == spans[:, 2], run[spans[:, 0]] - spans[:, 0], 0)
    children = np.r_[times + 1 - at_end, np.zeros(len(own), np.int64)]  # of the LCPs inside, those before keys that end here part no children
    low = _minima(conv, a, b)
    # the parent: the branching node around the nearest smaller LCP that is the deeper of both
    edge = np.where(lcp[a] >= lcp[b + 1], a, b + 1)
    up_a, up_b = left[edge], right[edge] - 1
    rooted = top < 0
    up_a, up_b = np.where(rooted, 0, up_a), np.where(rooted, n - 1, up_b)
    up_low = _minima(conv, np.maximum(up_a, 0), np.maximum(up_b, 0))
    # every depth between a node and its parent
    each = np.repeat(np.arange(len(a)), deep - top)
    depth = np.arange(len(each)) - np.repeat(np.cumsum(deep - top) - deep, deep - top) + 1
    first, last, chain = a[each], b[each], depth > top[each] + 1
    before = upto[start[first] + np.maximum(depth - 1, 0)]
    ending = length[first] == depth
    ends, chunk = [NOTHING] * len(each), [None] * len(each)
    for k in np.flatnonzero(ending).tolist():
        i, j = int(first[k]), int(run[first[k]])
        said = ",".join(map(str, ids[i:j]))
        if i == 0 or j == n:
            ends[k], chunk[k] = None, said
        else:
            ends[k] = hashlib.sha256(said.encode()).hexdigest()
    n_convs = last + 1 - first
    saved = bytes_[last + 1] - bytes_[first] - n_convs * before - (fresh[last + 1] - fresh[first + 1]) - (total[first] - before)
    columns = {
        "block": np.full(len(each), number), "first": first, "depth": depth, "left": first == 0, "right": last == n - 1, "n_convs": n_convs, "conv_id": low[each], "n_children": np.where(depth < deep[each], 1, children[each]),
        "n_leaves": leaves[last + 1] - leaves[first], "saved": saved, "before": before, "ends": np.array(ends, object), "chunk": np.array(chunk, object),
        "up_first": np.where(chain, first, up_a[each]), "up_left": np.where(chain, first, up_a[each]) == 0, "up_right": np.where(chain, last, up_b[each]) == n - 1, "up_conv_id": np.where(chain, low[each], up_low[each]),
    }
    kinds = {"left": pa.bool_(), "right": pa.bool_(), "up_left": pa.bool_(), "up_right": pa.bool_(), "ends": pa.string(), "chunk": pa.string(), "head": pa.binary(), "tail": pa.binary()}
    names = [c.strip().split(" ")[0] for c in LOCAL.split(",")]
    for i in range(0, len(each), NODES):
        part = {c: pa.array(x[i : i + NODES], kinds.get(c, pa.int64()), from_pandas=False) for c, x in columns.items()}
        m = len(part["block"])
        yield pa.RecordBatch.from_arrays([part.get(c, pa.nulls(m, kinds.get(c, pa.int64()))) for c in names], names)
    about = {"block": number, "rows": n, "low": int(lcp[1:-1].min()) if n > 1 else 2**31, "head": found[0], "tail": found[-1]}
    yield pa.RecordBatch.from_arrays([pa.array([about.get(c)], kinds.get(c, pa.int64())) for c in names], names)


def _classes(lcp: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Numbers of equal keys: one that shares its whole length with an equally long one before it has the same."""
    same = (lcp[1:-1] == length[1:]) & (length[1:] == length[:-1])
    return np.r_[0, np.cumsum(~same)]


def _minima(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of values[a..b] of each pair, by a table of minima over powers of two."""
    levels = [values]
    while 2 ** len(levels) <= len(values):
        x, step = levels[-1], 2 ** (len(levels) - 1)
        levels.append(np.minimum(x[:-step], x[step:]))
    out, span = np.empty(len(a), np.int64), b - a + 1
    for k, level in enumerate(levels):
        own = (span >= 2**k) & (span < 2 ** (k + 1))
        out[own] = np.minimum(level[a[own]], level[b[own] + 1 - 2**k])
    return out


def local_trees(sorted_keys: DataFrame) -> DataFrame:
    """``LOCAL``: the nodes of each partition of sorted keys, and one row about each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, found = [], []
        for b in batches:
            ids += b.column(0).to_pylist()
            found += b.column(1).to_pylist()
        if ids:
            yield from block_nodes(TaskContext.get().partitionId(), ids, found)

    return sorted_keys.select("conv_id", "key").mapInArrow(run, LOCAL)


def _borders(nodes: DataFrame) -> dict[str, np.ndarray]:
    """Of each block, in order: its number, what its first key shares with the key before it (in turns, and their
    bytes), its least LCP, and what the next block shares with its last key. A few numbers for each task."""
    spark = nodes.sparkSession
    about = nodes.where("rows is not null").select("block", "low", "head", "tail")
    low = sorted(about.select("block", "low", (F.octet_length("tail") / ENTRY).cast("long")).collect())
    number = np.array([r[0] for r in low], np.int64)
    if not len(number):
        return {}
    next_ = spark.createDataFrame([(int(a), int(b)) for a, b in zip(number, number[1:])], "before long, block long")
    pairs = about.select(F.col("block").alias("before"), "tail").join(next_, "before").join(about.select("block", "head"), "block").select("block", "tail", "head")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [common(x, y) for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            size = [sum(int.from_bytes(k[i * ENTRY + 16 : (i + 1) * ENTRY], "big") for i in range(m)) for k, m in zip(b.column(2).to_pylist(), n)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(size, pa.int64())], ["block", "n", "size"])

    got = {r[0]: (r[1], r[2]) for r in pairs.mapInArrow(run, "block long, n long, size long").collect()}
    joint = np.array([got.get(int(k), (-1, 0)) for k in number], np.int64)
    return {"number": number, "shared": joint[:, 0], "bytes": joint[:, 1], "low": np.minimum(joint[:, 0], [r[1] for r in low]), "next": np.r_[joint[1:, 0], -1], "tail": np.array([r[2] for r in low])}


def _start(low: np.ndarray, block: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The nearest block left of each whose least LCP is below the depth: block minima, halved by powers of two."""
    levels = [low]
    while 2 ** len(levels) <= len(low):
        x, step = levels[-1], 2 ** (len(levels) - 1)
        levels.append(np.r_[x[:step], np.minimum(x[step:], x[:-step])])  # the least of the 2^k blocks that end here
    at = block - 1
    for k in reversed(range(len(levels))):
        can = at - 2**k >= 0
        skip = can & (levels[k][np.maximum(at, 0)] >= depth)
        at = np.where(skip, at - 2**k, at)
    return at


SETTLED = (
    "block long, first long, depth long, begin long, n_convs long, conv_id long, n_children long, n_leaves long, saved long, ends string, chunk string, "
    "up_first long, up_begin long, up_conv_id long"
)


def settled(nodes: DataFrame, borders: dict[str, np.ndarray]) -> DataFrame:
    """``SETTLED``: nodes with what the neighbours change. ``begin`` is the place of the block where a node begins that
    goes on in a neighbour, null for whole ones; ``up_begin`` the same for its parent."""
    sent = nodes.sparkSession.sparkContext.broadcast(borders)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = sent.value
        for b in batches:
            c = {n: b.column(n).to_numpy(zero_copy_only=False) for n in b.schema.names if n not in ("ends", "chunk")}
            at = np.searchsorted(x["number"], c["block"])
            left = c["left"] & (c["depth"] <= x["shared"][at])
            right = c["right"] & (c["depth"] <= x["next"][at])
            begin = np.where(left, _start(x["low"], at, c["depth"]), at)
            up = c["depth"] - 1
            up_left, up_right = c["up_left"] & (up <= x["shared"][at]), c["up_right"] & (up <= x["next"][at])
            up_begin = np.where(up_left, _start(x["low"], at, up), at)
            root = up < 0
            children = c["n_children"] - (left & (c["depth"] + 1 <= x["shared"][at]))
            leaves = c["n_leaves"] + (c["right"] & (x["next"][at] < x["tail"][at]))
            saved = c["saved"] + np.where(left, np.maximum(x["bytes"][at] - c["before"], 0), 0)
            chunk, ends = b.column("chunk"), b.column("ends")
            alone = ~(left | right)
            if alone.any() and chunk.null_count < len(chunk):
                own = [hashlib.sha256(s.encode()).hexdigest() if s is not None and a else e for s, a, e in zip(chunk.to_pylist(), alone.tolist(), ends.to_pylist())]
                ends, chunk = pa.array(own, pa.string()), pa.compute.if_else(pa.array(alone), pa.scalar(None, pa.string()), chunk)
            some = lambda v, no: pa.array(v, pa.int64(), mask=no)
            arrays = [pa.array(c["block"]), pa.array(c["first"]), pa.array(c["depth"]), some(begin, alone), pa.array(c["n_convs"]), pa.array(c["conv_id"]), pa.array(children), pa.array(leaves), pa.array(saved), ends, chunk]
            arrays += [pa.array(c["up_first"]), some(up_begin, ~(up_left | up_right) | root), some(c["up_conv_id"], root)]
            yield pa.RecordBatch.from_arrays(arrays, [s.strip().split(" ")[0] for s in SETTLED.split(",")])

    slim = nodes.where("rows is null").select(*[s.strip().split(" ")[0] for s in LOCAL.split(",")][:17])
    return slim.mapInArrow(run, SETTLED)


def _long_ends(pieces: DataFrame) -> DataFrame:
    """(begin, depth, long_ends): SHA-256 of the ids of a node's own conversations where they fill several blocks; each
    node's chunks pass through one task in order, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h = None, None
        done: list[tuple] = []
        for b in batches:
            for key, chunk in zip(zip(b.column(0).to_pylist(), b.column(1).to_pylist()), b.column(3).to_pylist()):
                if key == now:
                    h.update(b"," + chunk.encode())
                    continue
                if now:
                    done.append((*now, h.hexdigest()))
                now, h = key, hashlib.sha256(chunk.encode())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*done)) or [[]] * 3, (pa.int64(), pa.int64(), pa.string()))], ["begin", "depth", "long_ends"])
            done = []
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.int64()), pa.array([h.hexdigest()])], ["begin", "depth", "long_ends"])

    dealt = pieces.where("chunk is not null").select("begin", "depth", "block", "chunk").repartition("begin", "depth").sortWithinPartitions("begin", "depth", "block")
    return dealt.mapInArrow(run, "begin long, depth long, long_ends string")


def trie(rebuilt: DataFrame) -> DataFrame:
    """The nodes of the trie of ``rebuilt`` (conv_id, key): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256; all conversations lie under the textless root. No conversations give no nodes."""
    spark = rebuilt.sparkSession
    small_batches(spark)
    rows = keep(rebuilt, "conversation-keys")
    blocks = max(1, -(-rows.count() // BLOCK))
    ordered = rows.repartitionByRange(blocks, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    nodes = keep(local_trees(ordered), "local-tries")
    borders = _borders(nodes)
    names = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    if not borders:
        return spark.createDataFrame([], names)
    all_ = keep(settled(nodes, borders), "settled")
    pieces = all_.where("begin is not null")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")]
    # a piece has a chunk where its own conversations fill up to a border, their digest where they don't, or none of them
    found = F.max(F.when(F.col("ends") != NOTHING, F.col("ends"))).alias("ends")
    joint = pieces.groupBy("begin", "depth").agg(*sums, F.min("conv_id").alias("conv_id"), F.min("up_begin").alias("up_begin"), found)
    joint = joint.join(_long_ends(pieces), ["begin", "depth"], "left").withColumn("ends", F.coalesce("long_ends", "ends", F.lit(NOTHING))).drop("long_ends")
    joint = keep(joint, "joint-nodes")
    # each piece learns its node's smallest member, so that children ask the piece of their own block
    known = pieces.select("block", "first", "depth", "begin").join(joint.select("begin", "depth", F.col("conv_id").alias("joint_id")), ["begin", "depth"]).select("block", F.col("first").alias("up_first"), (F.col("depth") + 1).alias("depth"), "joint_id")
    whole = all_.where("begin is null").select("block", "up_first", "depth", "n_convs", "conv_id", "n_children", "n_leaves", "saved", "ends", "up_begin", "up_conv_id")
    inside = whole.where("up_begin is null").drop("block", "up_first", "up_begin")
    below = whole.where("up_begin is not null").join(known, ["block", "up_first", "depth"]).withColumn("up_conv_id", F.col("joint_id")).drop("block", "up_first", "up_begin", "joint_id")
    parent = joint.select(F.col("begin").alias("up_begin"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("up_conv_id"))
    across = joint.join(parent, ["up_begin", "depth"], "left").drop("begin", "up_begin")
    out = inside.unionByName(below).unionByName(across)
    return out.select("conv_id", "depth", F.col("up_conv_id").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of all rebuilt conversations.

    Turns are taken in order, null first; of rows with one turn, by digest. Null roles and texts count as empty, rows
    without conv_id take no part, repeated rows are repeated turns, other columns are not read. A conversation's
    entries, 24 bytes for each turn, have to fit a row (2 GB); its texts never meet.
    """
    return trie(keys(conversations))
