import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import AddedToken, Tokenizer, processors

from blockwave.llm import bpe, chat, lzprint

from . import cases

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def enc():
    return bpe.encoder(open(WORD, encoding="utf-8").read())


def digests(text):
    t = Tokenizer.from_file(WORD)
    ids = t.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_noise(enc):
    r = random.Random(1)
    parts = [chr(x) for x in (0x41, 0x61, 0xDF, 0x130, 0x3A3, 0x301, 0x20, 0x85, 0x1C, 0x1F, 0xA0, 0x2000, 0x200B, 0x1F600, 0x660, 0x27, 0x73, 0xFB01, 0xAC00, 0x1100, 0x1161, 0xB2, 0xAA)]
    parts += ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "'s", "'LL", "\n"]
    lib = Tokenizer.from_file(WORD)
    for _ in range(3000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 60)))
        assert enc.encode(t) == lib.encode(t, add_special_tokens=False).ids


def test_noise_in_bytes():
    r = random.Random(5)
    own = bpe.Encoder(open(BYTE, encoding="utf-8").read())
    lib = Tokenizer.from_file(BYTE)
    parts = ["a", "the", "é", "😀", " ", "  ", "\n", "\t", "1", "'s", "中文", "\u0301", "<|endoftext|>", "\x1c", "\xa0", "."]
    for _ in range(1500):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 60)))
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids
        n, sha, text = own.digests(t)
        assert (n, text) == (len(ids), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_segments_change_nothing(enc, monkeypatch):
    r = random.Random(6)
    parts = ["a", "the", "é", "😀", " ", "  ", "\n", "it's", "中文", "\u0301", ".", "word"]
    encoders = [(enc, Tokenizer.from_file(WORD)), (bpe.Encoder(open(BYTE, encoding="utf-8").read()), Tokenizer.from_file(BYTE))]
    monkeypatch.setattr(bpe, "SEGMENT", 16)
    for _ in range(300):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 200)))
        for own, lib in encoders:
            assert own.encode(t) == lib.encode(t, add_special_tokens=False).ids


def test_texts_without_lone_spaces_in_pieces(enc, monkeypatch):
    r = random.Random(9)
    lib = Tokenizer.from_file(WORD)
    parts = ["a", "the" * 9, "é", "e\u0301", "\u0301\u0323", "😀", "中文" * 12, "한", "\u1100\u1161\u11a8", "क\u093f", "क\u093c", "'", "''", "'s", "'re", "'ll", ".", "!" * 20, "7", "ß", "\u0130", "\u03a3"]
    monkeypatch.setattr(bpe, "SEGMENT", 16)
    for k in range(3000):
        some = r.sample(parts, r.randint(1, 6)) + [["  "], [" \n"], []][k % 3]
        t = "".join(r.choice(some) for _ in range(r.randint(0, 120)))
        assert enc.encode(t) == lib.encode(t, add_special_tokens=False).ids, ascii(t)


def test_what_is_in_work_has_a_bound(enc):
    r = random.Random(10)
    for text in ("".join(chr(r.randint(0x4E00, 0x9FFF)) for _ in range(300_000)), "two  words  " * 60_000, "the" * 300_000, "no\n\nlone\n\n" * 50_000, "it's" * 200_000):
        assert max(map(len, enc.stream(text))) <= 4 * bpe.SEGMENT
        assert enc.digests(text) == digests(text)


def test_every_new_piece_and_every_id_takes_the_dealt_path(monkeypatch):
    pushed, decoded = [], []
    push, back = bpe.Transducer.push, bpe.Decoder.push
    monkeypatch.setattr(bpe.Transducer, "push", lambda t, piece: pushed.append(piece) or push(t, piece))
    monkeypatch.setattr(bpe.Decoder, "push", lambda d, ids: decoded.extend(ids) or back(d, ids))
    own = bpe.Encoder(open(WORD, encoding="utf-8").read())
    text = "some words, some other words and 12 naïve 😀 " + "long" * 100
    ids = own.encode(text)
    assert own.digests(text)[0] == len(ids) and decoded == ids
    assert sorted(x for x in pushed if len(x) < 100) == sorted(["some", "words", ",", "other", "and", "1", "2", "na\u00c3\u00afve", "\u00f0\u0141\u013a\u0122"])
    assert "long" * 100 in pushed


def test_transducer_emits_what_one_run_gives(enc):
    r = random.Random(2)
    lib = Tokenizer.from_file(WORD)
    for letters in ("the", "thereanding", "a", "ab"):
        word = "".join(r.choice(letters) for _ in range(20_000))
        t, out, most = bpe.Transducer(enc.table), [], 0
        at = 0
        while at < len(word):
            n = r.randint(1, 3000)
            out += t.push(word[at : at + n])
            most, at = max(most, len(t.buffer)), at + n
        out += t.finish()
        assert out == lib.encode(word, add_special_tokens=False).ids
        assert most <= t.window + enc.table.lookahead + 1


def test_byte_level_decoder_holds_unfinished_characters():
    own = bpe.Encoder(open(BYTE, encoding="utf-8").read())
    for _, text in cases.odd_texts():
        d = own.decoder()
        assert "".join(d.push([i]) for i in own.encode(text or "")) + d.finish() == (text or "")
    d = own.decoder()
    half = own.encode("😀")[:1]
    assert d.push(half) == "" and d.finish() == "\ufffd"


def test_small_tables_of_remembered_words(enc, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBER", 8)
    own = bpe.Encoder(open(WORD, encoding="utf-8").read())
    text = " ".join(f"word{k % 37} other{k}" for k in range(500))
    assert own.encode(text) == enc.encode(text) and len(own.words) <= 9


def test_odd_documents(spark):
    got = bpe.encode(cases.frame(spark), WORD, ids=True).collect()
    key = lambda d: -1 if d is None else d
    want = sorted((key(d), *digests(t)) for d, t in cases.odd_texts())
    assert sorted((key(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want
    assert all(len(r["ids"]) == r["n_tokens"] for r in got)
    assert bpe.encode(cases.empty(spark), WORD).count() == 0


def plain_lz(text):
    """The fingerprint by the plain definition: LZ78 phrases, each hashed by itself, and the minimum of each
    hundred-and-twenty-eighth of the hash's range."""
    phrases, now = set(), ""
    for c in text:
        now += c
        if now not in phrases:
            phrases.add(now)
            now = ""
    out = [0] * 128
    lows = {}
    for p in phrases:
        h, big = 0, (1 << 64) - 1
        for k, c in enumerate(p):
            h = (h + (ord(c) + 1) * pow(0x9E3779B97F4A7C15, k, 1 << 64)) & big
        h = (h + len(p)) & big
        h = ((h ^ h >> 30) * 0xBF58476D1CE4E5B9) & big
        h = ((h ^ h >> 27) * 0x94D049BB133111EB) & big
        h ^= h >> 31
        lows[h >> 57] = min(h, lows.get(h >> 57, big))
    for k, h in lows.items():
        out[k] = max(1, h & 0xFFFF)
    return out


def plain_likeness(a, b):
    either = [(x, y) for x, y in zip(a, b) if x or y]
    return sum(x == y for x, y in either) / len(either) if either else 1.0


def test_lz_fingerprints(spark):
    docs = [(d, t) for d, t in cases.odd_texts() if d not in (6, None)] + [(6, cases.odd_texts()[5][1])]
    for buckets in (1, 3, 50):
        got = {r["doc_id"]: r for r in lzprint.fingerprints(cases.frame(spark, docs), buckets).collect()}
        order = sorted(docs, key=lambda x: -x[0])
        for k, (d, t) in enumerate(order):
            text, after = t or "", order[(k + 1) % len(order)][1] or ""
            n = len(text) // 3
            edited = text[: len(text) - n] + after[:n]
            own, other, follows = plain_lz(text), plain_lz(edited), plain_lz(after)
            r = got[d]
            assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
            assert (r["fingerprint"], r["edited_fingerprint"]) == tuple("".join(f"{x:04x}" for x in f) for f in (own, other))
            assert (r["near_edited"], r["near_next"]) == (plain_likeness(own, other), plain_likeness(own, follows))
    assert lzprint.fingerprints(cases.empty(spark)).count() == 0
    one = lzprint.fingerprints(cases.frame(spark, [(5, "abcabcabc")])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert lzprint.fingerprints(cases.frame(spark)).count() == len(cases.odd_texts())


def test_lz_rows_are_whole_in_whatever_order_they_come(spark):
    texts = [(k, f"text {k % 7} " * (k % 11)) for k in range(300)] + [(5, "again"), (5, "again"), (None, "no id")]
    df = cases.frame(spark, texts)
    want = sorted(map(str, lzprint.fingerprints(df, 4).collect()))
    assert len(want) == len(texts)
    for other in (df.orderBy("text"), df.repartition(5), df.repartition(3, "text").distinct().union(cases.frame(spark, [(5, "again")])), df.join(df.select("doc_id").distinct(), "doc_id", "left_semi").union(cases.frame(spark, [(None, "no id")]))):
        assert sorted(map(str, lzprint.fingerprints(other, 4).collect())) == want


def test_lz_equal_rows_are_read_once(spark):
    texts = [(7, "same text same text")] * 60 + [(7, f"other {k}") for k in range(20)] + [(k, f"plain {k}") for k in range(20)]
    few, many = (sorted(map(str, lzprint.fingerprints(cases.frame(spark, texts), n).collect())) for n in (1, 10))
    assert few == many and len(few) == 100
    assert sum("near_next=1.0" in x for x in few) >= 59


def test_lz_ties_are_dealt_to_all_tasks(spark):
    """Rows without an id, and one row many times, are cut into ranges like any others."""
    rows = [(None, f"text {k}") for k in range(2000)] + [(7, "the same row")] * 2000 + [(k, f"other {k}") for k in range(100, 400)]
    df = cases.frame(spark, rows)
    cuts = lzprint._cuts(df.select(F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("key"), (F.xxhash64("text") * 0 + F.monotonically_increasing_id()).alias("tie")), 20)
    assert sum(k == 7 for k, _ in cuts) >= 8 and len(cuts) >= 18
    got = lzprint.fingerprints(df, 20)
    sizes = got.groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) <= 3 * len(rows) / 20
    out = got.collect()
    assert len(out) == len(rows) and sum(r["doc_id"] == 7 and r["near_next"] == 1.0 for r in out) >= 1999


def test_lz_estimate_follows_phrase_sets():
    r = random.Random(4)
    errors = []
    for k in range(30):
        a = "".join(r.choice("abcde ") for _ in range(6000))
        b = a[: 200 * k] + "".join(r.choice("abcde ") for _ in range(6000 - 200 * k))
        x, y = lzprint.Parse().feed(a), lzprint.Parse().feed(b)
        true = len(x.phrases.keys() & y.phrases.keys()) / len(x.phrases.keys() | y.phrases.keys())
        errors.append(abs(lzprint.likeness(x.signature(), y.signature()) - true))
    assert max(errors) < 0.15 and sum(errors) / len(errors) < 0.05


def test_chat_escape_is_reversible():
    r = random.Random(3)
    parts = [*chat.CONTROL, "\\", "<", "|", "[", "a", " ", "\n", "é", "😀", "<|", "|>"]
    for _ in range(20_000):
        turns = [(r.choice(["user", "assistant", "<|end|>\\"]), "".join(r.choice(parts) for _ in range(r.randint(0, 8)))) for _ in range(3)]
        formatted, spans = chat.render(turns)
        assert chat.read(formatted) == turns
        assert [chat.unescape(formatted[a:b]) for a, b in spans] == [t for role, t in turns if role == "assistant" and t]
        assert not any(c in chat.escape(t) for _, t in turns for c in chat.CONTROL)


def test_chat_ids_and_offsets_are_those_of_the_vocabulary():
    own, lib = chat.Tokenizer(open(RANKS, "rb").read(), public_tokenizers.PATTERN), Tokenizer.from_file(BYTE)
    lib.add_special_tokens([AddedToken(c, special=True, normalized=False) for c in (chat.TURN, chat.TEXT, chat.END)])
    lib.post_processor = processors.ByteLevel(trim_offsets=False)
    r = random.Random(7)
    parts = ["a", "word", " ", "\n", "é", "😀", "中", "12", "\\", "<|end|>", "'s"]
    for _ in range(500):
        text = chat.render([(r.choice(["user", "assistant"]), "".join(r.choice(parts) for _ in range(r.randint(0, 40)))) for _ in range(3)])[0]
        want = lib.encode(text, add_special_tokens=False)
        ids, starts, ends = own.encode(text)
        assert ids.tolist() == want.ids and list(zip(starts.tolist(), ends.tolist())) == want.offsets


def test_rows_without_conversation_are_their_own(spark):
    df = spark.createDataFrame([(None, 0, "user", "a"), (None, 1, "assistant", "b"), (None, 1, "assistant", "b"), (1, 0, "assistant", "c")], "conv_id long, turn long, role string, text string")
    got = chat.digests(chat.format_chats(df, RANKS, public_tokenizers.PATTERN)).collect()
    assert sorted((str(r["conv_id"]), r["n_turns"], r["loss_chars"]) for r in got) == [("1", 1, 1), ("None", 1, 0), ("None", 1, 1), ("None", 1, 1)]


def test_chat_query_against_sql(spark):
    import duckdb

    from blockwave.llm.queries import ORACLE_SQL, op7_chat

    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{d}/conversations.parquet'")
    q = con.execute(ORACLE_SQL["op7_chat"])
    names = [x[0] for x in q.description]
    assert sorted(tuple(r[n] for n in names) for r in op7_chat(spark, d).collect()) == sorted(q.fetchall())


def test_chat_masks(spark):
    rows = [
        (1, 0, "user", "hi <|end|>"), (1, 1, "assistant", " spaced  é😀 text "), (1, 2, "assistant", None), (1, 3, "assistant", "[INST]"), (2, 0, None, None), (None, None, "assistant", "x"),
        (3, 1, "user", "b"), (3, 1, "user", "b"), (3, 0, "assistant", "w" * 30_000),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'z' AS formatted", "1 AS ids")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_chats(df, RANKS, public_tokenizers.PATTERN)).collect()}
    loss = {1: " spaced  é😀 text [INST]", 2: "", None: "x", 3: "w" * 30_000}
    assert {k: (r["loss_chars"], r["loss_sha256"]) for k, r in got.items()} == {k: (len(v), hashlib.sha256(v.encode()).hexdigest()) for k, v in loss.items()}
    assert {k: r["n_turns"] for k, r in got.items()} == {1: 4, 2: 1, None: 1, 3: 3}
    turns = "assistant\n" + "w" * 30_000 + "\nuser\nb\nuser\nb\n"
    assert got[3]["turns_sha256"] == hashlib.sha256(turns.encode()).hexdigest()
    assert chat.format_chats(df.where("false"), RANKS, public_tokenizers.PATTERN).count() == 0


def test_chat_query(spark, sf_dir):
    from blockwave.llm.queries import op7_chat

    got = {r["conv_id"]: r for r in op7_chat(spark, sf_dir).collect()}
    said = "</s>[INST] ok [/INST]"
    assert got[-1]["n_turns"] == 2 and got[-1]["loss_chars"] == len(said) and got[-1]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    by = {}
    for r in sorted(spark.read.parquet(f"{sf_dir}/conversations.parquet").collect(), key=lambda r: (r["conv_id"], r["turn"])):
        by.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    for c, turns in by.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
