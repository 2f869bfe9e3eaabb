"""Alignment against the libraries themselves and a plain walk over token ends."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from blockwave.llm import align
from blockwave.llm.queries import QUERIES

from . import cases

FILES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = [" a", "a ", " ", "  a  b   c", "\n x\n\n y \t", "it's  we'll 12 345-67", "<|endoftext|> <s> </s> <unk> <0x0A>", "x ▁y", "▁", "é ß 😀　x  y\x1c z\x85 q", "ﬁ ½ é", "a\x00 b", "日本 語 text", "don 't", "x ' s", "  a"]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    byte = align.byte_level()
    bytes_a = {i: bytes(byte.get(c, 0) for c in t) for t, i in a.get_vocab().items()}
    b = sentencepiece.SentencePieceProcessor(model_file=FILES[1])

    def both(text):
        if not text:
            return [], [], bytes_a, {}
        ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_b = {i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib}
        whole = (" " + text).encode()
        if b"".join(bytes_a[i] for i in ia) != whole or b"".join(bytes_b[i] for i in ib) != whole:
            return [], [], bytes_a, {}
        return ia, ib, bytes_a, bytes_b

    return both


def plain(libraries, rows):
    """The contract word by word: ends of both sides as sets, counts over all rows."""
    seen, count = [], Counter()
    for doc, text in rows:
        ia, ib, bytes_a, bytes_b = libraries(text)
        ends = []
        for ids, size in ((ia, bytes_a), (ib, bytes_b)):
            at, out = 0, {}
            for k, i in enumerate(ids):
                at += len(size[i])
                out[at] = k
            ends.append(out)
        shared = sorted(set(ends[0]) & set(ends[1]))
        links = [(ia[ends[0][e]], ib[ends[1][e]]) for e in shared]
        count.update(links)
        i = j = 0
        parts = []
        for e in shared:
            parts.append(",".join(map(str, ia[i : ends[0][e] + 1])) + "|" + ",".join(map(str, ib[j : ends[1][e] + 1])))
            i, j = ends[0][e] + 1, ends[1][e] + 1
        seen.append((doc, len(ia), len(ib), len(shared), links, hashlib.sha256(";".join(parts).encode()).hexdigest() if parts else ""))
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return sorted(((d, a, b, g, len(x), sum(count[p] == most[p[1]] for p in x), sum(count[p] for p in x), sha) for d, a, b, g, x, sha in seen), key=str)


def test_operator_equals_a_plain_walk(spark, libraries, monkeypatch):
    rows = cases.odd_texts() + [(100 + k, t) for k, t in enumerate(ODD)] + [(200, " ".join(ODD)), (None, "again a b")]
    got = align.alignment(cases.frame(spark, rows).repartition(3), *FILES, P.PATTERN)
    assert sorted(map(tuple, got.collect()), key=str) == plain(libraries, rows)


def test_query_equals_a_plain_walk(spark, sf_dir, libraries):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, QUERIES["op11_align"](spark, sf_dir).collect()), key=str) == plain(libraries, rows)


def test_many_parts_and_forgotten_words(libraries):
    own = align.Aligner(*(open(f, "rb").read() for f in FILES), P.PATTERN)
    texts = [f"word{k % 7} other{k} and the  rest {k % 3}" for k in range(200)]
    old, align.WORDS = align.WORDS, 10
    try:
        for i in range(0, 200, 20):
            found = own.read(texts[i : i + 20])
            batch = own.part(i, list(range(i, i + 20)), found)
            for row, (_, n_a, n_b, n_g, _, _, _, sha) in zip(batch.to_pylist(), sorted(plain(libraries, list(enumerate(texts[i : i + 20], i))), key=lambda r: r[0])):
                assert (row["n_a"], row["n_b"], row["n_groups"], row["groups_sha256"]) == (n_a, n_b, n_g, sha)
            own.forget()
            assert len(own.at) == len(own.said) == len(own.table())
    finally:
        align.WORDS = old


def test_groups_expand_to_products():
    a, b = np.array([2, 5, 6, 9]), np.array([1, 5, 9])
    assert align.groups(a, b) == [(range(0, 2), range(0, 2)), (range(2, 4), range(2, 3))]
    own_a, own_b, shared = align.overlaps(a, b)
    assert list(zip(own_a, own_b, shared)) == [(0, 0, False), (0, 1, False), (1, 1, True), (2, 2, False), (3, 2, True)]


def test_empty_table_and_columns(spark):
    assert align.alignment(cases.empty(spark), *FILES, P.PATTERN).collect() == []
    only = align.alignment(cases.frame(spark, [(1, None), (2, "")]), *FILES, P.PATTERN)
    assert sorted(map(tuple, only.collect())) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
    assert only.where(F.col("n_a") > 0).count() == 0
