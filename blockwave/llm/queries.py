"""The queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, ann, bpe, chat, decontam, licenses, lzprint, pii, secrets, sharding, shared, simhash, toxicity, trie

WORD_VOCABULARY = "word_bpe_49k.json"
BYTE_VOCABULARY = "byte_bpe_50k.tiktoken"
BYTE_SPEC, PIECE_MODEL = "byte_bpe_50k.json", "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return out.select("doc_id", digits.alias("fingerprint"), "component_id")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later run over the same table finds all its blobs in the ledger, and scans none."""
    name = hashlib.sha256(sf_dir.encode()).hexdigest()[:16]
    return secrets.secrets(_table(spark, sf_dir, "documents"), f"{shared.shared_root(spark)}/secrets-ledger-{name}")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_VOCABULARY))


def op6_lzprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lzprint.fingerprints(_table(spark, sf_dir, "documents"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one numbered -1 whose texts are full of control strings."""
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    table = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return chat.digests(chat.format_chats(table.unionByName(own), public_tokenizers.path(BYTE_VOCABULARY), public_tokenizers.PATTERN))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op9_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and each test item that it holds."""
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rejected documents, with the chain's probabilities."""
    docs = _table(spark, sf_dir, "documents")
    chain = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, chain).where("rejected")


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = public_tokenizers.path(BYTE_SPEC), public_tokenizers.path(PIECE_MODEL)
    return align.alignment(_table(spark, sf_dir, "documents"), *files, public_tokenizers.PATTERN)


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_simhash, op2_secrets, op3_sharding, op4_pii, op5_bpe, op6_lzprint, op7_chat, op8_licenses, op9_decontam, op10_toxicity, op11_align, op12_neighbours, op13_trie)
}
#: A match of an escaped string, a backslash or a control string, makes a text one character longer.
_ESCAPED = r"\\|<\|turn\|>|<\|text\|>|<\|end\|>|<\|endoftext\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>"
ORACLE_SQL: dict[str, str] = {
    "op7_chat": rf"""
WITH rows AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
),
said AS (
  SELECT conv_id, COUNT(*) AS n_turns,
    STRING_AGG(role || CHR(10) || text || CHR(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    COALESCE(STRING_AGG(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    SUM(LENGTH(REGEXP_REPLACE(role, '({_ESCAPED})', 'x\1', 'g')) + LENGTH(REGEXP_REPLACE(text, '({_ESCAPED})', 'x\1', 'g'))
      + LENGTH('<|turn|>') + LENGTH('<|text|>') + LENGTH('<|end|>')) AS formatted
  FROM rows GROUP BY conv_id
)
SELECT conv_id, n_turns, SHA256(turns) AS turns_sha256, LENGTH(loss) AS loss_chars, SHA256(loss) AS loss_sha256, CAST(formatted AS BIGINT) AS formatted_chars
FROM said
""",
    # the rebuilt turns; a node is the chain of their digests; what a node has counts for all nodes above it
    "op13_trie": """
WITH RECURSIVE turns AS (
  SELECT CAST(conv_id AS BIGINT) AS c, COALESCE(role, '') AS role, COALESCE(text, '') AS text,
    ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, SHA256(STRLEN(COALESCE(role, '')) || CHR(10) || COALESCE(role, '') || CHR(10) || COALESCE(text, ''))) AS t
  FROM conversations WHERE conv_id IS NOT NULL
),
crc AS (SELECT DISTINCT c, 0 AS k, CAST(4294967295 AS BIGINT) AS r FROM turns
  UNION ALL
  SELECT c, k + 1, LIST_REDUCE(LIST_PREPEND(XOR(r, ASCII(SUBSTR(CAST(c AS VARCHAR), k + 1, 1))), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
    LAMBDA x, y: CASE WHEN x % 2 = 1 THEN XOR(x // 2, 3988292384) ELSE x // 2 END)
  FROM crc WHERE k < LENGTH(CAST(c AS VARCHAR))
),
convs AS (SELECT c, XOR(r, 4294967295) % 9 AS h FROM crc WHERE k = LENGTH(CAST(c AS VARCHAR))),
rebuilt AS (
  SELECT c, ROW_NUMBER() OVER (PARTITION BY c ORDER BY own, t) AS d, role, text FROM (
    SELECT v.c, 0 AS own, t.t, t.role, t.text FROM convs v JOIN turns t ON t.c = v.c - v.c % 5 AND t.t <= v.h
    UNION ALL SELECT v.c, 1, t.t, t.role, t.text FROM convs v JOIN turns t ON t.c = v.c AND t.t > v.h
  )
),
paths AS (
  SELECT c, 0 AS d, '' AS path, '' AS up, 0 AS bytes FROM convs
  UNION ALL
  SELECT c, d, STRING_AGG(one, '') OVER w, COALESCE(STRING_AGG(one, '') OVER (PARTITION BY c ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''), bytes
  FROM (SELECT c, d, SHA256(STRLEN(role) || CHR(10) || role || CHR(10) || text) AS one, STRLEN(text) AS bytes FROM rebuilt)
  WINDOW w AS (PARTITION BY c ORDER BY d)
),
ends AS (SELECT c, MAX(d) AS last FROM paths GROUP BY c),
nodes AS (
  SELECT path, d, ANY_VALUE(up) AS up, MIN(c) AS conv_id, COUNT(*) AS n_convs, (COUNT(*) - 1) * ANY_VALUE(bytes) AS saved,
    SHA256(COALESCE(STRING_AGG(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE d = last), '')) AS ends_sha256
  FROM paths JOIN ends USING (c) GROUP BY path, d
),
children AS (SELECT up AS path, COUNT(*) AS n FROM nodes WHERE d > 0 GROUP BY up),
below AS (
  SELECT a.path AS path, SUM(b.saved) AS saved, COUNT(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM children x WHERE x.path = b.path)) AS leaves
  FROM nodes b, LATERAL (SELECT SUBSTR(b.path, 1, CAST(64 * u AS INTEGER)) AS path FROM UNNEST(RANGE(0, b.d + 1)) AS r(u)) a GROUP BY a.path
)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, COALESCE(x.n, 0) AS n_children, CAST(b.leaves AS BIGINT) AS n_leaves,
  CAST(b.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN nodes p ON n.d > 0 AND p.path = n.up LEFT JOIN children x ON x.path = n.path JOIN below b ON b.path = n.path
""",
}
