"""Diversity of texts: shares of distinct n-grams, and self-BLEU without comparing texts in pairs.

n-grams are keyed by a 64-bit hash of their words. For self-BLEU they travel as arrays, a row for all
that a group of texts sends to one range of keys, and never as rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import words
from tessera.storage import written

#: Words of a group of texts, and n-grams of a range of keys, about.
GROUP, RANGE = 1 << 20, 1 << 20
SIZES = range(1, 5)


def grams(texts: DataFrame, sizes: range, *keys: str) -> DataFrame:
    """keys, n and gram of every n-gram of the array column words."""

    def of_size(n: int):
        one = lambda i: F.struct(F.lit(n).alias("n"), F.xxhash64(*(F.get("words", i + k) for k in range(n))).alias("gram"))
        none = F.array().cast("array<struct<n:int,gram:bigint>>")
        return F.when(F.size("words") >= n, F.transform(F.sequence(F.lit(0), F.size("words") - n), one)).otherwise(none)

    parts = F.concat(*(of_size(n) for n in sizes))
    return texts.select(*keys, F.explode(parts).alias("g")).select(*keys, "g.n", "g.gram")


def ngram_diversity(texts: DataFrame, n: int = 2) -> DataFrame:
    """distinct_grams, total_grams and diversity (0 without any) of the column text."""
    counts = grams(texts.select(words(F.col("text")).alias("words")), range(n, n + 1)).groupBy("gram").agg(F.count("*").alias("c"))
    found = counts.agg(F.count("*").alias("distinct_grams"), F.coalesce(F.sum("c"), F.lit(0)).alias("total_grams"))
    return found.withColumn("diversity", F.when(F.col("total_grams") > 0, F.col("distinct_grams") / F.col("total_grams")).otherwise(0.0))


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all (the finish of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _bytes(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on, compressed: the lowest bytes of all first, as many as the greatest needs."""
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + len(x).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _numbers(packed: bytes) -> np.ndarray:
    width, n = packed[0], int.from_bytes(packed[1:9], "little")
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(pa.decompress(packed[9:], width * n, "zstd", asbytes=True), np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


def _sent(rows: list[tuple[str, int, np.ndarray]], ranges: int) -> Iterator[tuple]:
    """Of one group of texts (hash, copies, words' hashes): group, unit, and arrays; unit -1 has the texts, others each a size and a range of keys.

    The arrays: steps from key to key, texts that hold each key, those texts' places in the group, and counts.
    """
    name = int(rows[0][0][:15], 16)
    length = np.array([len(w) for _, _, w in rows], np.int64)
    yield name, -1, "".join(h for h, _, _ in rows).encode(), _bytes(np.array([c for _, c, _ in rows])), _bytes(length), b""
    word, text = np.concatenate([w for _, _, w in rows]).view(np.uint64), np.repeat(np.arange(len(rows)), length)
    last, key = np.cumsum(length)[text], np.zeros(len(word), np.uint64)
    edges = (np.arange(1, ranges, dtype=object) * 2**64 // ranges).astype(np.uint64)
    for n in SIZES:
        if len(word) < n:
            return
        key = _mixed(key[: len(word) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + word[n - 1 :] + np.uint64(n))
        whole = np.flatnonzero(np.arange(len(key)) + n <= last[: len(key)])
        if not len(whole):
            return
        # texts stay in order within a key
        order = np.argsort(key[whole], kind="stable")
        k, t = key[whole][order], text[whole][order]
        new_key = np.concatenate([[True], k[1:] != k[:-1]])
        first = np.flatnonzero(new_key | np.concatenate([[True], t[1:] != t[:-1]]))
        count, t, k, new_key = np.diff(np.append(first, len(k))), t[first], k[first], new_key[first]
        at = np.flatnonzero(new_key)
        holders, k = np.diff(np.append(at, len(t))), k[at]
        cut = np.concatenate([[0], np.searchsorted(k, edges), [len(k)]])
        run = np.append(at, len(t))[cut]
        for r in range(ranges):
            lo, hi, a, b = cut[r], cut[r + 1], run[r], run[r + 1]
            if hi > lo:
                yield name, (n - SIZES[0]) * ranges + r, _bytes(np.diff(k[lo:hi], prepend=np.uint64(0))), _bytes(holders[lo:hi] - 1), _bytes(t[a:b]), _bytes(count[a:b])


def _clipped(sent: list[tuple]) -> Iterator[tuple[int, np.ndarray]]:
    """For the groups that sent to one unit: group, and for each of its texts the sum of counts, none more than the greatest in another text."""
    key, text, count, base = [], [], [], [0]
    for _, _, steps, holders, own, c in sent:
        own = _numbers(own).astype(np.int64)
        key.append(np.repeat(np.cumsum(_numbers(steps)), _numbers(holders).astype(np.int64) + 1))
        text.append(own + base[-1])
        count.append(_numbers(c).astype(np.int64))
        base.append(base[-1] + int(own.max()) + 1)
    key, text, count = np.concatenate(key), np.concatenate(text), np.concatenate(count)
    order = np.argsort(key)
    key, text, count = key[order], text[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    width = np.diff(np.append(first, len(key)))
    most = np.repeat(np.maximum.reduceat(count, first), width)
    top = count == most
    # of a text that alone has the greatest count, the greatest in another one is the next
    less = np.repeat(np.maximum.reduceat(np.where(top, 0, count), first), width)
    alone = np.repeat(np.add.reduceat(top.astype(np.int64), first) == 1, width)
    found = np.bincount(text, np.minimum(count, np.where(top & alone, less, most)), base[-1]).astype(np.int64)
    for k, row in enumerate(sent):
        yield row[0], found[base[k] : base[k + 1]]


def _matches(own: DataFrame, characters: int) -> DataFrame:
    """text_hash, copies, size and m1 to m4 of distinct texts (text_hash, copies, text): n-grams of each size, counted as often as any other text has them at most."""
    ranges = max(1, -(-characters // (6 * RANGE)))
    units = ranges * len(SIZES)
    number = min(units, 2 * own.sparkSession.sparkContext.defaultParallelism)
    binary = pa.binary()

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(held: list) -> pa.RecordBatch:
            name, unit, *arrays = zip(*_sent(held, ranges), strict=True)
            return pa.RecordBatch.from_arrays([pa.array([u % number for u in unit], pa.int32()), pa.array(name, pa.int64()), pa.array(unit, pa.int32()), *(pa.array(a, binary) for a in arrays)], ["dest", "name", "unit", "a", "b", "c", "d"])

        held, size = [], 0
        for batch in batches:
            for h, copies, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                held.append((h, copies, np.asarray(w.values)))
                size += len(w.values)
                if size >= GROUP:
                    yield rows(held)
                    held, size = [], 0
        if held:
            yield rows(held)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for r in range(batch.num_rows):
                yield tuple(c[r].as_py() for c in batch.columns)

    def clip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of each text four numbers
        found: dict[tuple[int, int], np.ndarray] = {}
        batch = lambda name, n, *arrays: pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([n], pa.int32()), *(pa.array([a], binary) for a in arrays)], ["name", "n", "a", "b", "c"])
        for unit, rows in groupby(each(batches), lambda row: row[1]):
            if unit < 0:
                for name, _, hashes, copies, length, _ in rows:
                    yield batch(name, 0, hashes, copies, length)
                continue
            for name, more in _clipped(list(rows)):
                old = found.get((name, unit // ranges), more[:0])
                long, short = (more, old) if len(more) > len(old) else (old, more)
                long[: len(short)] += short
                found[name, unit // ranges] = long
        for (name, n), sums in found.items():
            yield batch(name, SIZES[n], _bytes(sums), b"", b"")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groupby(each(batches), lambda row: row[0]):
            texts, sums = None, {n: [] for n in SIZES}
            for _, n, a, b, c in rows:
                if n:
                    sums[n].append(_numbers(a))
                else:
                    texts = [a[i : i + 64].decode() for i in range(0, len(a), 64)], _numbers(b).astype(np.int64), _numbers(c).astype(np.int64)
            total = np.zeros((len(SIZES), len(texts[0])), np.int64)
            for n, parts in sums.items():
                for part in parts:
                    total[n - SIZES[0], : len(part)] += part.astype(np.int64)
            yield pa.RecordBatch.from_arrays([*map(pa.array, texts), *map(pa.array, total)], ["text_hash", "copies", "size", *(f"m{n}" for n in SIZES)])

    hashes = F.transform(words(F.col("text")), lambda w: F.xxhash64(w))
    # in one order, so that a task that is run again makes the same groups
    sent = own.select("text_hash", "copies", hashes.alias("words")).sortWithinPartitions("text_hash").mapInArrow(send, "dest int, name long, unit int, a binary, b binary, c binary, d binary")
    clipped = sent.repartitionById(number, "dest").drop("dest").sortWithinPartitions("unit").mapInArrow(clip, "name long, n int, a binary, b binary, c binary")
    return clipped.repartition("name").sortWithinPartitions("name").mapInArrow(gather, "text_hash string, copies long, size long, m1 long, m2 long, m3 long, m4 long")


def self_bleu(texts: DataFrame) -> DataFrame:
    """text_hash, copies and bleu of each distinct text, against all other distinct texts.

    The greatest count of an n-gram in another text is the greatest of all counts, or the second one
    for a text that alone has the greatest. Closest lengths come from the distinct lengths. Zero
    numerators count as 0.1; a text without a word of its own kind elsewhere scores 0.
    """
    own = texts.groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_hash")).agg(F.count("*").alias("copies"), F.first("text").alias("text"))
    characters = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    # a few numbers of each text, which are read twice
    found = written(_matches(own, characters), "matches")
    # distinct lengths: at most as many as the longest text has words
    lengths = found.groupBy("size").agg(F.count("*").alias("texts"))
    order = Window.orderBy("size")
    lo, hi = F.lag("size").over(order), F.lead("size").over(order)
    near = F.when(F.col("texts") > 1, F.col("size")).when(lo.isNull(), hi).when(hi.isNull(), lo).when(F.col("size") - lo <= hi - F.col("size"), lo).otherwise(hi)
    lengths = lengths.select("size", near.alias("closest"))
    scored = found.join(lengths, "size")
    logs = [F.log(F.when(F.col(f"m{n}") == 0, 0.1).otherwise(F.col(f"m{n}")) / F.greatest(F.lit(1), F.col("size") - (n - 1))) for n in range(1, 5)]
    brevity = F.when(F.col("size") > F.col("closest"), 1.0).otherwise(F.exp(1 - F.col("closest") / F.col("size")))
    score = F.when(F.col("m1") == 0, 0.0).otherwise(brevity * F.exp((logs[0] + logs[1] + logs[2] + logs[3]) / 4))
    return scored.select("text_hash", "copies", F.coalesce(score, F.lit(0.0)).alias("bleu"))
