"""Secret scans with an incremental ledger of content-addressed blobs.

A blob is named by the SHA-256 of its text. The ledger, a Parquet table that outlives the run, holds (blob,
rule_version, spans) for every blob that was ever scanned under a version of the rules. A run finds the pairs
that the ledger lacks by names alone, moves and scans each of their texts once, appends them, and joins the
findings back to every path, and every version of a path, whose text is that blob.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyaccord.lineage import checkpointed, stored
from skyaccord.llm.common import SLICE_ROWS, fresh_names, join_counted

RULE_VERSION = "2"
#: Kinds in the order in which spans with one start are listed; the first three are the base rules.
KINDS = ("assign", "access", "hex", "private_key")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_PRIVATE = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----)?")
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_HEX_MAP = bytes(120 if 48 <= b <= 57 or 97 <= b <= 102 else 32 for b in range(256))
LEDGER = "blob string, rule_version string, spans array<struct<kind: string, start: long, end: long>>"
#: Rows of a counted table up to which it is broadcast; of bare numbers, more fit in the same room.
BROADCAST_ROWS = 20_000
BROADCAST_NUMBERS = 1_000_000


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points by start, then kind. A cheap search of the bytes skips rules that cannot match."""
    if not text:
        return []
    raw, found = text.encode(), []
    lower = raw.lower()
    if any(k in lower for k in _KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    if b"x" * 24 in raw.translate(_HEX_MAP):
        found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if b"PRIVATE KEY-----" in raw:
        found += [(m.start(), 3, m.end()) for m in _PRIVATE.finditer(text)]
    return [(KINDS[k], s, e) for s, k, e in sorted(found)]


def blob_of(text_col: str) -> Column:
    return F.sha2(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), 256)


def _short(blob: Column) -> Column:
    """The first 60 bits of a name as a number."""
    return F.conv(F.substring(blob, 1, 15), 16, 10).cast("long")


def scan_blobs(docs: DataFrame, ledger: DataFrame | None = None, text_col: str = "text", rule_version: str = RULE_VERSION) -> DataFrame:
    """Ledger rows for the blobs of docs that the ledger lacks under this version, each scanned once.

    Names meet the ledger before any text moves: a table of unseen names, broadcast as numbers if they are few, picks
    the texts. Copies are reduced to one text in their task and once more where they meet. Null text is the empty blob.
    """
    rows = docs.select(blob_of(text_col).alias("blob"), F.col(f"`{text_col}`").cast("string").alias("text"))
    if ledger is not None:
        seen = ledger.filter(F.col("rule_version") == rule_version).select("blob").distinct()
        unseen = stored(rows.select("blob").distinct().join(seen, "blob", "left_anti"))
        n = unseen.count()
        if n <= BROADCAST_NUMBERS:
            near = F.broadcast(unseen.select(_short(F.col("blob")).alias("__short")).distinct())
            rows = rows.join(near, _short(F.col("blob")) == F.col("__short"), "left_semi")
        rows = rows.join(F.broadcast(unseen) if n <= BROADCAST_ROWS else unseen, "blob", "left_semi")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                spans = [[{"kind": k, "start": s, "end": e} for k, s, e in find_spans(t)] for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([rule_version] * batch.num_rows, pa.string()), pa.array(spans, kind)], ["blob", "rule_version", "spans"])

    return rows.dropDuplicates(["blob"]).mapInArrow(run, LEDGER)


def update_ledger(docs: DataFrame, ledger: DataFrame | None = None, text_col: str = "text", rule_version: str = RULE_VERSION) -> DataFrame:
    """The ledger with all blobs of docs, checkpointed."""
    fresh = scan_blobs(docs, ledger, text_col, rule_version)
    return checkpointed(fresh if ledger is None else ledger.select("blob", "rule_version", "spans").unionByName(fresh))


def open_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger at a path of the shared file system; None where there is none yet."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    exists = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    return spark.read.schema(LEDGER).parquet(path) if exists else None


def extend_ledger(docs: DataFrame, path: str, text_col: str = "text", rule_version: str = RULE_VERSION) -> DataFrame:
    """The ledger at a path after a run over docs: what it lacks is scanned and appended, nothing else is written.

    A run that fails leaves the ledger as it was; the next one scans what is still unseen. A pair that two runs append at the same
    time stands there twice and counts once.
    """
    spark = docs.sparkSession
    fresh = stored(scan_blobs(docs, open_ledger(spark, path), text_col, rule_version))
    fresh.write.mode("append").parquet(path)
    return open_ledger(spark, path)


def findings(docs: DataFrame, ledger: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule_version: str = RULE_VERSION, version_col: str | None = None) -> DataFrame:
    """(id, blob, spans), and version where docs has a column of historical versions; a row for each row of docs: every path and version of a blob gets its findings.

    A blob that very many paths share is joined apart, so that no task gets all of them. Spans are null for a blob that the ledger lacks.
    """
    version = [F.col(f"`{version_col}`").alias("version")] if version_col else []
    paths = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), *version, blob_of(text_col).alias("blob"))
    known = ledger.filter(F.col("rule_version") == rule_version).select("blob", "spans").dropDuplicates(["blob"])
    counted = paths.groupBy("blob").agg(F.count("*").alias("n")).join(known, "blob", "left")
    return join_counted(paths, counted, "blob")


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans) from findings."""

    def of(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:3]))
    counts = [of(k).alias(f"n_{k}") for k in KINDS[:3]]
    return found.select("id", *counts, F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def redact(text: str, spans: list[dict], mark: str = "[SECRET]") -> str:
    """Overlapping spans are merged and replaced by the mark."""
    out, upto = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], s["end"])):
        if s["start"] >= upto:
            out += [text[upto : s["start"]], mark]
        upto = max(upto, s["end"])
    return "".join([*out, text[upto:]])


def redact_secrets(docs: DataFrame, ledger: DataFrame | None = None, text_col: str = "text", rule_version: str = RULE_VERSION) -> DataFrame:
    """docs with every finding replaced in its text, same columns; n_chars, where it is a column, follows the new text.

    Only blobs with findings are joined back; texts without any are left as they are.
    """
    ledger = update_ledger(docs, ledger, text_col, rule_version)
    blob, spans = fresh_names(docs, 2)
    dirty = stored(ledger.filter((F.col("rule_version") == rule_version) & (F.size("spans") > 0)).dropDuplicates(["blob"]).select(F.col("blob").alias(blob), F.col("spans").alias(spans)))
    if dirty.count() <= BROADCAST_ROWS:
        dirty = F.broadcast(dirty)
    joined = docs.join(dirty, blob_of(text_col) == F.col(blob), "left").drop(blob)
    at, spans_at, names = docs.columns.index(text_col), len(docs.columns), docs.columns
    chars_at = names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(k) for k in range(len(names))]
            rows = [i for i, hit in enumerate(batch.column(spans_at).is_valid().to_pylist()) if hit]
            if rows:
                texts = columns[at].to_pylist()
                chars = columns[chars_at].to_pylist() if chars_at is not None else None
                for i in rows:
                    texts[i] = redact(texts[i], batch.column(spans_at)[i].as_py())
                    if chars:
                        chars[i] = len(texts[i])
                columns[at] = pa.array(texts, columns[at].type)
                if chars:
                    columns[chars_at] = pa.array(chars, columns[chars_at].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(run, docs.schema)


def brute_sha256(spans: list[tuple[str, int, int]]) -> str:
    """The digest of base spans, for tests and tools."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans if k in KINDS[:3]).encode()).hexdigest()
