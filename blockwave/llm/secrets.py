"""Secret scans over an incremental ledger of blobs.

A blob is a text under its SHA-256. The ledger says which blob has been scanned under which version
of the rules and what was found; only pairs it lacks are scanned, each once however many paths and
versions hold the text, and the findings are joined back to all of them. The ledger is a folder that
later runs read and append to, so a run over what is known scans nothing.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import exists, keep, shared_dir, small_batches

#: The base kinds and their patterns.
BASE = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
#: What the method adds, by kind.
EXTRA = {
    "pem": re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    "jwt": re.compile(r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
    "hub": re.compile(r"gh[oprsu]_[A-Za-z0-9]{36,}"),
}
_HINTS = {"pem": "-----BEGIN ", "jwt": ".eyJ", "hub": "_"}
#: The first part of a jwt, by whole runs of its characters, so that each is read once.
_JWT_HEAD = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++\.(?=eyJ)")
LEAST = {"assign": 8, "access": 16}
#: The rules' version follows from all that decides a finding.
RULES = hashlib.sha256(repr([(p.pattern, p.flags) for p in (_ASSIGN, _ACCESS, _HEX, *EXTRA.values())] + sorted(LEAST.items())).encode()).hexdigest()[:16]
_KEYS = ("passw", "secret", "token", "api")
HOT = 1000  # a blob of a thousandth of all rows is joined back without a shuffle
SENT = 1 << 18  # blobs that are broadcast at most (25 MB)
LEDGER = "blob string, rules string, n_assign long, n_access long, n_hex long, base string, spans string"


def spans(text: str) -> list[tuple[int, int, str, int]]:
    """(start, place of the kind, kind, end) in order; code points, end exclusive."""
    out = []
    lower = text.lower()
    if any(k in lower for k in _KEYS):
        out += [(m.start(), 0, "assign", m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), 1, "access", m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    out += [(m.start(), 2, "hex", m.end()) for m in _HEX.finditer(text)]
    for k, (kind, pattern) in enumerate(EXTRA.items()):
        if _HINTS[kind] in text:
            out += [(a, 3 + k, kind, b) for a, b in (_tokens(text) if kind == "jwt" else (m.span() for m in pattern.finditer(text)))]
    return sorted(out)


def _tokens(text: str) -> Iterator[tuple[int, int]]:
    """What the jwt pattern finds, in time linear in the text: in a run before a dot the first place that can match
    decides, as all of the run's rest belongs to the match."""
    last = 0
    for run in _JWT_HEAD.finditer(text):
        if run.start() < last:
            continue
        start = text.find("eyJ", run.start(), run.end() - 9)
        if start >= 0 and (m := EXTRA["jwt"].match(text, start)):
            last = m.end()
            yield start, last


def blobs(versions: DataFrame) -> DataFrame:
    """(blob, text): each text of ``versions`` at least once, and once only from any one task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            names = b.column(0).to_pylist()
            new = []
            for i, h in enumerate(names):
                k = bytes.fromhex(h)
                if k not in seen:
                    if len(seen) >= 1 << 20:
                        seen.clear()  # some texts then go out twice, to be joined below
                    seen.add(k)
                    new.append(i)
            yield b.take(pa.array(new, pa.int64()))

    return versions.select("blob", "text").mapInArrow(run, "blob string, text string")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of findings for each blob; rows come sorted by blob."""
    last = None
    for b in batches:
        rows = []
        names = b.column(0).to_pylist()
        for i, h in enumerate(names):
            if h == last:
                continue
            last = h
            found = spans(b.column(1)[i].as_py())
            kinds = [k for _, _, k, _ in found]
            text = [",".join(f"{k}:{s}:{e}" for s, p, k, e in found if p < n) for n in (len(BASE), 99)]
            rows.append((h, RULES, *[kinds.count(k) for k in BASE], *text))
        columns = list(zip(*rows)) or [[]] * 7
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["blob", "rules", "n_assign", "n_access", "n_hex", "base", "spans"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def address(versions: DataFrame) -> DataFrame:
    """``versions`` with ``blob``, the SHA-256 of the text; a null text is the empty blob."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return versions.withColumn("text", text).withColumn("blob", F.sha2(text, 256))


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """What the ledger in this folder has under the present rules; nothing where there is none yet. Runs at
    one time may both have scanned a blob; their findings are equal."""
    if not exists(spark, path):
        return None
    return spark.read.schema(LEDGER).parquet(path).where(F.col("rules") == RULES).dropDuplicates(["blob"])


def scan(versions: DataFrame, path: str) -> int:
    """Scan the blobs of ``versions`` (with ``blob`` and ``text``) that the ledger lacks under the present rules,
    and append the findings to it; how many there were."""
    spark = versions.sparkSession
    new, ledger = versions.select("blob", "text"), read_ledger(spark, path)
    if ledger is not None:
        need = keep(versions.select("blob").distinct().join(ledger.select("blob"), "blob", "left_anti"), "need")
        n = need.count()
        if not n:
            return 0
        new = new.join(F.broadcast(need) if n <= SENT else need, "blob", "left_semi")
    found = blobs(new).repartition("blob").sortWithinPartitions("blob").mapInArrow(_scan, LEDGER)
    found = keep(found, "found")
    found.write.mode("append").partitionBy("rules").parquet(path)
    return found.count()


def findings(versions: DataFrame, path: str) -> DataFrame:
    """The rows of ``versions`` without ``text``, each with its ``blob`` and the ledger's findings for it.

    ``versions`` has a row for each version of each path: any columns that name these, and ``text``.
    Blobs that a thousandth of all rows hold are a thousand at most; their rows stay where they are.
    """
    spark = versions.sparkSession
    small_batches(spark)
    addressed = address(versions)
    scan(addressed, path)
    rows = keep(addressed.drop("text"), "versions")
    known = read_ledger(spark, path).drop("rules")
    counts = rows.groupBy("blob").agg(F.count("*").alias("_n"))
    total = rows.count()
    hot = F.broadcast(keep(counts.where(F.col("_n") * HOT >= total).select("blob"), "hot"))
    most = F.broadcast(keep(known.join(hot, "blob", "left_semi"), "hot"))
    rest = rows.join(hot, "blob", "left_anti").join(known, "blob")
    return rest.unionByName(rows.join(most, "blob"))


def secrets(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, blob) for each row of ``docs``.

    ``path`` is the ledger's folder; without one the ledger is of this run alone. Rows that share a
    doc_id are versions of one path. A null text counts as empty and has no findings; repeated rows give
    repeated rows; other columns are ignored; an empty table gives an empty result.
    """
    path = path or f"{shared_dir(docs.sparkSession)}/ledger-{uuid.uuid4().hex}"
    found = findings(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), path)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "blob")
