"""Quartile bucket digests of texts, and a bounded likeness of digests.

Every window of three bytes of the UTF-8 text adds to one of 256 buckets by a hash. The digest has
the length in characters on a logarithmic scale, and for each bucket the quartile of its count among
the buckets (two bits). The difference of two digests adds, over buckets, the distance of quartiles
(0 to 3, where 3 counts as 6) and the length's steps (12 at most); the likeness is 1 - difference /
bound, from 0 to 1. Equal texts have equal digests. A text of under three bytes has no window: its
digest holds its bytes' own hash, in the same form.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import sized

BUCKETS = 256
#: The greatest difference.
BOUND = 6.0 * BUCKETS / 4 + 12
_rng = np.random.default_rng(3)
_T = [_rng.integers(0, 1 << 16, 256).astype(np.uint16) for _ in range(3)]
_WEIGHT = np.array([0.0, 1.0, 2.0, 6.0])


def digest(text: bytes, chars: int) -> np.ndarray:
    """65 bytes: the length's step, then four buckets' quartiles to the byte."""
    step = min(255, int(round(8 * np.log2(chars + 1))))
    if len(text) < 3:
        return np.frombuffer(bytes([step]) + hashlib.blake2b(text, digest_size=64).digest(), np.uint8)
    b = np.frombuffer(text, np.uint8)
    h = _T[0][b[:-2]] + _T[1][b[1:-1]] + _T[2][b[2:]]
    counts = np.bincount(h >> 8, minlength=BUCKETS)
    q = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    level = np.searchsorted(q, counts, "left").astype(np.uint8)
    return np.concatenate([[np.uint8(step)], level[0::4] << 6 | level[1::4] << 4 | level[2::4] << 2 | level[3::4]])


def _levels(d: np.ndarray) -> np.ndarray:
    return np.stack([d[1:] >> 6, d[1:] >> 4 & 3, d[1:] >> 2 & 3, d[1:] & 3], 1).ravel()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """1 for equal digests, 0 at or over the bound."""
    apart = _WEIGHT[np.abs(_levels(a).astype(np.int8) - _levels(b).astype(np.int8))].sum()
    apart += min(12, abs(int(a[0]) - int(b[0])))
    return max(0.0, 1.0 - apart / BOUND)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars and fingerprint (hexadecimal) of each row; null counts as empty."""
    sized(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_py() or "" for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, texts)), pa.int64()), pa.array([digest(x.encode(), len(x)).tobytes().hex() for x in texts], pa.string())], ["doc_id", "n_chars", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def _cuts(docs: DataFrame, ranges: int) -> list[int]:
    """At most `ranges` - 1 ids that cut the rows into ranges of about equal size."""
    at = [k / ranges for k in range(1, ranges)]
    return sorted(set(docs.select(F.percentile_approx("doc_id", at, 10_000)).first()[0] or [])) if at else []


def edit_probes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """Each text beside an edited copy and beside the next document, by digest.

    The edited text has its last floor(n_chars / 3) code points replaced by as many (or all) first
    ones of the next document by falling id; the last document's next is the first. Rows with equal
    ids are ordered by text; null ids come last; a table of one row is its own neighbour, an empty
    table gives an empty result.

    Rows are dealt to ranges of ids; the first row of each range is also sent, as a guest, to the end
    of the range before, so that every neighbour is found without one order of all rows in one task.
    """
    spark = docs.sparkSession
    sized(spark)
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.col(id_col).isNull().alias("no_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    if ranges is None:
        ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    cuts = _cuts(docs, ranges)
    # range 0 holds the greatest ids
    number = _range_of(cuts)
    # the greatest id opens a range
    heads = docs.select("doc_id", number.alias("range")).groupBy("range").agg(F.max("doc_id").alias("doc_id")).collect()
    filled = sorted((r["range"], r["doc_id"]) for r in heads)
    opens = [(head, filled[k - 1][0]) for k, (_, head) in enumerate(filled)]
    rows = docs.select("doc_id", "no_id", "text", number.alias("range"), F.lit(False).alias("guest"))
    if not opens:
        return spark.createDataFrame([], _SCHEMA)
    # one row for each range: as many as there are partitions
    table = spark.createDataFrame(opens, "doc_id long, before int")
    guests = docs.join(F.broadcast(table), "doc_id").select("doc_id", "no_id", "text", F.col("before").alias("range"), F.lit(True).alias("guest"))
    dealt = rows.union(guests).repartition(len(filled), "range").sortWithinPartitions("range", "guest", F.col("doc_id").desc(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own is not None:
                    out.append(_compared(own, row))
                # each range ends with a guest, after which nothing more is compared
                own = None if row[4] else row
            if out:
                yield _batch(out)

    return dealt.select("doc_id", "no_id", "text", "range", "guest").mapInArrow(run, _SCHEMA)


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _range_of(cuts: list[int]):
    """The number of cuts above an id, found by halving."""

    def within(lo: int, hi: int):
        if lo == hi:
            return F.lit(len(cuts) - lo)
        mid = (lo + hi) // 2
        return F.when(F.col("doc_id") < cuts[mid], within(lo, mid)).otherwise(within(mid + 1, hi))

    return within(0, len(cuts))


def _compared(own, after):
    text, following = own[2], after[2]
    n = len(text)
    part = n // 3
    edited = text[: n - part] + following[:part]
    raw = edited.encode()
    a, b, c = digest(text.encode(), n), digest(raw, len(edited)), digest(following.encode(), len(following))
    return (None if own[1] else own[0], n, hashlib.sha256(raw).hexdigest(), a.tobytes().hex(), b.tobytes().hex(), likeness(a, b), likeness(a, c))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in _SCHEMA.split(", ")])
