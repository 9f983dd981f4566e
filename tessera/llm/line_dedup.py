"""Removal of lines that many documents share, by a sharded minimal perfect hash.

The distinct hashes of lines found in enough documents are dealt to shards by their high bits. Each
shard becomes one row: a minimal perfect hash (levels of bit arrays, each with a slot for every key
that no other key hits, as in BBHash), and beside it two compact arrays that it indexes, 64-bit
fingerprints and the documents that keep the lines. Documents probe these arrays with their lines'
hashes; lines are not joined with lines. Probes are dealt by shard and salt, so that a line found in
a third of all documents spreads over many tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tessera.llm.shared import sized, written
from tessera.llm.text import mix

STRIP = " \t\n\x0b\x0c\r"
#: Slots for each key of a level, and keys that a shard has on average.
GAMMA, SHARD_KEYS = 2, 50_000
#: Lines that probe a shard at a time, on average.
PROBES = 50_000
_STEP, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def line_keys(text: str, least: int) -> list[bytes | None]:
    """A 16-byte hash for each line, or None for lines with keys of fewer than `least` code points."""
    out = []
    for line in text.split("\n"):
        key = line.strip(STRIP)
        out.append(hashlib.blake2b(key.encode("utf-8", "surrogatepass").lower(), digest_size=16).digest() if len(key) >= least else None)
    return out


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        sums = [np.cumsum(x) for x in levels]
        before = np.r_[0, np.cumsum([s[-1] for s in sums])]
        self.rank = [s - 1 + n for s, n in zip(sums, before, strict=False)]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left):
            size = GAMMA * len(left) + 1
            slot = (mix(left + np.uint64(len(levels) * _STEP & _MASK)) % np.uint64(size)).astype(np.int64)
            single = np.bincount(slot, minlength=size) == 1
            levels.append(single)
            left = left[~single[slot]]
        return cls(levels)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key, or -1; a key that was not built in gets -1 or any index."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for k, (level, rank) in enumerate(zip(self.levels, self.rank, strict=True)):
            slot = (mix(keys[left] + np.uint64(k * _STEP & _MASK)) % np.uint64(len(level))).astype(np.int64)
            hit = level[slot]
            out[left[hit]] = rank[slot[hit]]
            left = left[~hit]
        return out

    def dump(self) -> bytes:
        return np.array([len(self.levels), *map(len, self.levels)], np.int64).tobytes() + b"".join(np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def load(cls, raw: bytes) -> PerfectHash:
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        sizes, at, levels = np.frombuffer(raw, np.int64, n, 8), 8 + 8 * n, []
        for size in sizes:
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, (size + 7) // 8, at), count=size).astype(bool))
            at += (size + 7) // 8
        return cls(levels)


def _shards(keys: DataFrame, shards: int) -> DataFrame:
    """A row for each shard: perfect hash, fingerprints and keepers, of the columns h, f and keeper."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        h = pdf["h"].to_numpy(np.int64).view(np.uint64)
        table = PerfectHash.build(h)
        at = table(h)
        prints, keepers = np.empty(len(h), np.int64), np.empty(len(h), np.int64)
        prints[at], keepers[at] = pdf["f"], pdf["keeper"]
        return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "hash": [table.dump()], "prints": [prints.tobytes()], "keepers": [keepers.tobytes()]})

    keys = keys.dropDuplicates(["h"]).withColumn("shard", _shard(shards))
    return keys.groupBy("shard").applyInPandas(build, "shard int, hash binary, prints binary, keepers binary")


def _shard(shards: int):
    return F.pmod(F.shiftright("h", 24), F.lit(shards)).cast("int")


def _probe(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Of the lines on the left, those that the arrays on the right tell to drop."""
    if not len(left) or not len(right):
        return pd.DataFrame({"doc_id": pd.Series([], dtype="Int64"), "f": np.empty(0, np.int64)})
    prints, keepers = np.frombuffer(right["prints"].iloc[0], np.int64), np.frombuffer(right["keepers"].iloc[0], np.int64)
    at = PerfectHash.load(right["hash"].iloc[0])(left["h"].to_numpy(np.int64).view(np.uint64))
    drop = (at >= 0) & (prints[at] == left["f"].to_numpy()) & ~(left["doc_id"] == keepers[at]).fillna(False).to_numpy(bool)
    return pd.DataFrame({"doc_id": left["doc_id"][drop].astype("Int64"), "f": left["f"][drop]})


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, salts: int = 16, carry: bool = False) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept (text) for each row of `docs`.

    With `carry` also row, a struct of all columns of `docs` but the text.

    A line's key is the line without white space at both ends, A-Z in lower case. Keys of at least
    `min_chars` code points found in at least `min_docs` documents lose all their lines except
    those of the largest id that holds it. Null and empty texts are one empty line. Each row counts
    as a document, also with a repeated id, and then all rows of the largest id keep the line. Lines
    of null ids go if the key goes; if only null ids hold a key, it stays. An empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    sized(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *([F.struct(*(c for c in docs.columns if c != text_col)).alias("row")] if carry else []))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, per = [], []
            for text in batch.column(1):
                keys = {k for k in line_keys(text.as_py() or "", min_chars) if k}
                raw.extend(keys)
                per.append(len(keys))
            both = np.frombuffer(b"".join(raw), np.int64).reshape(-1, 2)
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(per)), per)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["doc_id", "h", "f"])

    lines = written(docs.select("doc_id", "text").mapInArrow(emit, "doc_id long, h long, f long"), "lines")
    shared = lines.groupBy("h", "f").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).where((F.col("n") >= min_docs) & F.col("keeper").isNotNull())
    shared = written(shared.select("h", "f", "keeper"), "shared")
    shards = max(16, shared.count() // SHARD_KEYS)
    tables = written(_shards(shared, shards), "shards")
    # so many that a shard's lines with one salt stay few, however many lines share few keys
    salts = max(salts, lines.count() // (shards * PROBES) + 1)
    salted = tables.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    probes = lines.withColumn("shard", _shard(shards)).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    probes = probes.groupBy("shard", "salt").cogroup(salted.groupBy("shard", "salt"))
    drops = probes.applyInPandas(_probe, "doc_id long, f long").groupBy("doc_id").agg(F.collect_set("f").alias("drops"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, texts = [], [], []
            for text, drops in zip(batch.column(1), batch.column(2), strict=True):
                text, drops = text.as_py() or "", drops.as_py()
                n, dropped = text.count("\n") + 1, 0
                if drops:
                    drops = {np.int64(x).tobytes() for x in drops}
                    stay = [k is None or k[8:] not in drops for k in line_keys(text, min_chars)]
                    dropped = n - sum(stay)
                    text = "\n".join(line for line, s in zip(text.split("\n"), stay, strict=True) if s)
                total.append(n)
                gone.append(dropped)
                texts.append(text)
            carried = [batch.column(k) for k in range(3, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.string()), *carried], schema.names)

    drops = drops.withColumnRenamed("doc_id", "drop_id").hint("shuffle_hash")
    both = docs.join(drops, F.col("doc_id").eqNullSafe(F.col("drop_id")), "left").select("doc_id", "text", "drops", *(["row"] if carry else []))
    schema = StructType([StructField("doc_id", LongType()), StructField("n_lines", LongType()), StructField("n_dropped", LongType()), StructField("kept", StringType()), *(f for f in docs.schema if f.name == "row" and carry)])
    return both.mapInArrow(keep, schema)
