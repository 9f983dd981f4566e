"""Probabilistic suffix tree over words, for scoring texts.

A string of words is counted if it occurs at least `min_count` times, at any size of the input. A
context (suffix state) of one or more words is retained if its next-word distribution diverges from
that of its parent, the context without its first word: N(s) * KL(s || parent) must exceed a
description length of `penalty` * ln(N) for each next word stored. In a retained state

    P(w | s) = lambda(s) * c(sw) / c(s) + (1 - lambda(s) * M(s)) * P(w | parent(s))

with lambda(s) = c(s) / (c(s) + smoothing), and M(s) the part of c(s) that is stored; this sums to
one over all words. The root is the add-one estimate (c + 1) / (N + V + 1), whose last part belongs
to all unknown words together. A text is scored by the longest retained suffix at each position.

Counts, states and stored strings are tables by key, fitted by lookups. As a product, P(w | s) is the
root's part, what each retained context leaves to its parent, and for a stored string its P over
what was left to it; so each string of a text adds its own logarithm, and a text is scored by one
lookup of its strings among those of the tree. Words that make up at least `word_share` of all tokens,
and longer strings of at least `min_share`, are looked up in broadcast tables of at most 1 / share
rows for each length, so that none of those looked up by key is hot. A Bloom filter of fixed size keeps
strings that the tree lacks from being sent; what it lets through is settled by the lookup.

Strings are exchanged as arrays: a row has the columns, as bytes, of all strings that a task sends to
one part of the keys, so that no Spark row is made for a string. Parts are as many as
`spark.sql.shuffle.partitions`, and more where those would hold over 4 million tokens each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import freed, sized, written
from tessera.llm.text import Counts, blocks, mix, signed, span_hashes, utf8, words

#: Keys of the end of a text, and of its start, which is a context only.
END, START = 0x1D0C, 0x57A7
#: Bits of the filter of strings, a fixed size of 16 MB; strings' keys are hashes, parts of which are places.
_FILTER_BITS, _SHIFTS = 1 << 27, (0, 32)
#: Ranges of the filter that are put together apart.
_RANGES = 64
#: Strings that a task holds before it sends partial counts or lookups.
_HELD = 3_000_000
#: Bytes of arrays in a batch that a task sends, and tokens of a part at most.
_SENT, _PART_TOKENS = 4 << 20, 1 << 22
_BLOBS = ["c0", "c1", "c2", "c3"]
_SCHEMA = "part int, kind int, src long, " + ", ".join(f"{c} binary" for c in _BLOBS)
_INFO = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])
_A, _B = np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F)


def _sequence(data: np.ndarray, offsets: np.ndarray):
    """Keys of `start words... end` for each document, the document of each and the places of starts."""
    start, end, doc = words(data, offsets)
    n = len(offsets) - 1
    size = np.bincount(doc, minlength=n) + 2
    first = np.r_[0, np.cumsum(size)]
    out = np.empty(first[-1], np.int64)
    out[first[:-1]], out[first[1:] - 1] = START, END
    out[np.arange(len(start)) + 2 * doc + 1] = signed(span_hashes(data, start, end))
    return out, np.repeat(np.arange(n), size), first


class Places:
    """Places of keys in a sorted table; keys are hashes, so that their first bits tell a place within a few."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.shift = np.uint64(64 - max(1, len(table).bit_length() + 1))
        self.starts = np.r_[0, np.cumsum(np.bincount(self._bits(table), minlength=1 << (64 - int(self.shift))))].astype(np.int32)

    def _bits(self, keys: np.ndarray) -> np.ndarray:
        # the order of signed keys
        return ((keys.view(np.uint64) ^ np.uint64(1 << 63)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        bits = self._bits(keys)
        at, stop = self.starts[bits], self.starts[bits + 1]
        out = np.full(len(keys), -1, np.int64)
        left = np.flatnonzero(at < stop)
        keys, at, stop = keys[left], at[left], stop[left]
        while len(left):
            hit = self.table[at] == keys
            out[left[hit]] = at[hit]
            at += 1
            more = ~hit & (at < stop)
            left, keys, at, stop = left[more], keys[more], at[more], stop[more]
        return out


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The place of each key in a sorted table, or -1."""
    return Places(table).find(keys)


def _longer(head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """The key of a string from those of all but its last word and of all but its first."""
    return signed(mix(head.view(np.uint64) * _A + tail.view(np.uint64) * _B))


def _keys(seq: np.ndarray, length: int) -> list[np.ndarray]:
    """For 1 to `length` words, the key of the words that end at each place; places that lack words have any key."""
    out = [seq]
    for _ in range(length - 1):
        out.append(np.r_[seq[:1], _longer(out[-1][:-1], out[-1][1:])])
    return out


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    # by the last bits of keys: `Places` goes by the first ones
    return ((keys.view(np.uint64) & np.uint64(0xFFFFFFFF)) * np.uint64(parts) >> np.uint64(32)).astype(np.uint16)


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of part, kind, src and arrays, in batches of a bounded size."""
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        blobs = [pa.array([r[3][k].tobytes() if k < len(r[3]) else None for r in held], pa.binary()) for k in range(len(_BLOBS))]
        plain = [pa.array([r[k] for r in held], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int64()))]
        return pa.RecordBatch.from_arrays(plain + blobs, ["part", "kind", "src", *_BLOBS])

    for row in rows:
        held.append(row)
        size += sum(a.nbytes for a in row[3])
        if size > _SENT:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _dealt(kind: int, columns: list[np.ndarray], by: np.ndarray, parts: int, near: np.ndarray | None = None, src: int = 0) -> Iterator[tuple]:
    """A row for each part of the keys `by`, with what `columns` have there, in the order of `near` if given."""
    part = _part(by, parts)
    if near is None:
        order = np.argsort(part, kind="stable")
    else:
        # equal keys side by side, which the shuffle's compression makes use of
        order = np.argsort(part.astype(np.uint64) << np.uint64(48) | near.view(np.uint64) >> np.uint64(16))
    ends = np.cumsum(np.bincount(part, minlength=parts))
    columns = [c[order] for c in columns]
    for k in np.flatnonzero(np.diff(np.r_[0, ends])):
        lo, hi = ends[k - 1] if k else 0, ends[k]
        yield int(k), kind, src, [c[lo:hi] for c in columns]


def _read(batches: Iterator[pa.RecordBatch], kinds: dict[int, tuple]) -> Iterator[tuple]:
    """part, kind, src and arrays of each row, whose types `kinds` tells; others are passed as bytes."""
    for batch in batches:
        for i in range(batch.num_rows):
            part, kind, src = (batch.column(k)[i].as_py() for k in range(3))
            types = kinds.get(kind, (np.uint8,))
            yield part, kind, src, [np.frombuffer(batch.column(3 + k)[i].as_buffer(), t) for k, t in enumerate(types)]


def _gathered(batches: Iterator[pa.RecordBatch], kinds: dict[int, tuple]) -> dict[int, list[np.ndarray]]:
    """The columns of each kind, of all rows."""
    held: dict[int, list] = {kind: [] for kind in kinds}
    for _, kind, _, arrays in _read(batches, kinds):
        held[kind].append(arrays)
    return {kind: [np.concatenate([np.empty(0, t), *(r[k] for r in held[kind])]).astype(t, copy=False) for k, t in enumerate(types)] for kind, types in kinds.items()}


def _exchanged(rows: DataFrame, parts: int) -> DataFrame:
    return rows.repartitionById(parts, F.col("part"))


def _filter(rows: DataFrame) -> np.ndarray:
    """A Bloom filter of fixed size of the keys in c0; its ranges are put together apart before they are sent."""
    span = _FILTER_BITS // _RANGES

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent() -> Iterator[tuple]:
            held, size = [], 0
            for batch in batches:
                for b in batch.column(0):
                    held.append(np.frombuffer(b.as_buffer(), np.int64).view(np.uint64))
                    size += len(held[-1])
                    if size > _HELD:
                        yield from dealt(np.concatenate(held))
                        held, size = [], 0
            if size:
                yield from dealt(np.concatenate(held))

        yield from _batches(sent())

    def dealt(key: np.ndarray) -> Iterator[tuple]:
        bit = np.sort(np.concatenate([(key >> np.uint64(k) & np.uint64(_FILTER_BITS - 1)).astype(np.int32) for k in _SHIFTS]))
        ends = np.searchsorted(bit, np.arange(_RANGES + 1) * span)
        for k in range(_RANGES):
            yield k, 0, 0, [bit[ends[k] : ends[k + 1]] - np.int32(k * span)]

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for part, _, _, (bit,) in _read(batches, {0: (np.int32,)}):
            held.setdefault(part, np.zeros(span, bool))[bit] = True
        yield from _batches((part, 0, 0, [np.packbits(on, bitorder="little")]) for part, on in held.items())

    found = _exchanged(rows.select("c0").mapInArrow(bits, _SCHEMA), _RANGES).mapInArrow(put, _SCHEMA).select("part", "c0").collect()
    table = np.zeros(_FILTER_BITS // 64, np.int64)
    for part, raw in found:
        table[part * span // 64 : (part + 1) * span // 64] = np.frombuffer(raw, np.int64)
    return table


def _may_hold(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    hit = np.ones(len(keys), bool)
    for k in _SHIFTS:
        at = (keys.view(np.uint64) >> np.uint64(k) & np.uint64(_FILTER_BITS - 1)).astype(np.int64)
        hit &= (table[at >> 6] >> (at & 63) & 1).astype(bool)
    return hit


def _counted(docs: DataFrame, keys_of) -> DataFrame:
    """key, n: what keys_of(sequence, document, starts) gives over all texts, added up in each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counts()
        as_rows = lambda k, n: pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], ["key", "n"])
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for lo, hi in blocks(offsets):
                base = offsets[lo]
                held.add(keys_of(*_sequence(data[base : offsets[hi]], offsets[lo : hi + 1] - base)))
                for k, n in held.ready():
                    yield as_rows(k, n)
        for k, n in held.ready(last=True):
            yield as_rows(k, n)

    return docs.select("text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _strings(docs: DataFrame, length: int, shared, least: int, parts: int) -> DataFrame:
    """Head, tail and n of the strings of `length` words that occur `least` times, dealt by their tails."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent() -> Iterator[tuple]:
            table, held, size = shared.value, [], 0
            for batch in batches:
                data, offsets = utf8(batch.column(0))
                for lo, hi in blocks(offsets):
                    base = offsets[lo]
                    seq, doc, first = _sequence(data[base : offsets[hi]], offsets[lo : hi + 1] - base)
                    # both the head and the tail of a string occur as often as the string
                    key = _keys(seq, length - 1)[-1]
                    may = _may_hold(table, key)
                    at = np.flatnonzero(may[1:] & may[:-1] & (np.arange(1, len(seq)) - first[doc[1:]] >= length - 1))
                    held.append((key[at], key[at + 1]))
                    size += len(at)
                    if size > _HELD:
                        yield from added(held)
                        held, size = [], 0
            if size:
                yield from added(held)

        yield from _batches(sent())

    def added(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple]:
        head, tail = (np.concatenate(c) for c in zip(*held))
        held.clear()
        key, head, tail, n = _summed(head, tail, None)
        yield from _dealt(0, [head, tail, n], key, parts, near=head)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _gathered(batches, {0: (np.int64, np.int64, np.int64)})[0]
        _, head, tail, n = _summed(*held)
        often = n >= least
        head, tail, n = head[often], tail[often], n[often]
        yield from _batches(_dealt(1, [head, tail, n], tail, parts, near=tail))

    # written before it is looked up, so that the partial counts are gone by then
    return written(_exchanged(docs.select("text").mapInArrow(count, _SCHEMA), parts).mapInArrow(add, _SCHEMA), "strings")


def _summed(head: np.ndarray, tail: np.ndarray, n: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """Key, head, tail and n of each different string; without n, each row is one occurrence."""
    key = _longer(head, tail)
    order = np.argsort(key)
    key = key[order]
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    n = np.diff(np.r_[new, len(key)]) if n is None else np.add.reduceat(n[order], new) if len(key) else n
    return key[new], head[order[new]], tail[order[new]], n


def _level(strings: DataFrame, shorter: DataFrame, parts: int, ln: float, smoothing: float, penalty: float, last: bool) -> DataFrame:
    """What is learnt of strings: rows of kind 1, key, n, ratio (nan: not stored) and p, and of kind 2, key, n and left of contexts.

    `shorter` has key, n, ratio and p of the strings with one word less, as rows of kind 1. A head's strings
    all go to one part: as many at most as there are different words after it.
    """

    def parent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _gathered(batches, {0: (np.int64, np.float64), 1: (np.int64, np.int64, np.int64)})
        (key, p), (head, tail, n) = both[0], both[1]
        order = np.argsort(key)
        at = _find(key[order], tail)
        own = at >= 0
        head, tail, n, p = head[own], tail[own], n[own], p[order[at[own]]]
        yield from _batches(_dealt(1, [head, tail, n, p], head, parts, near=head))

    def learnt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _gathered(batches, {0: (np.int64, np.int64), 1: (np.int64, np.int64, np.int64, np.float64)})
        (key, total), (head, tail, n, parent) = both[0], both[1]
        order = np.argsort(key)
        key, total = key[order], total[order]
        at = _find(key, head)
        own = at >= 0
        at, head, tail, n, parent = at[own], head[own], tail[own], n[own], parent[own]
        share = n / total[at]
        add = lambda values: np.bincount(at, values, len(key)).astype(float, copy=False)
        size = np.bincount(at, minlength=len(key))
        mass = np.minimum(add(share), 1.0)
        gain, other = add(n * np.log(share / parent)), 1 - mass
        rest = total * other * np.log(np.maximum(other, 1e-12) / np.maximum(1 - add(parent), 1e-12))
        gain += np.where(other > 1e-12, rest, 0.0)
        kept = (size > 0) & (gain > penalty * ln * size)
        weight = total / (total + smoothing)
        left = 1 - weight * mass
        before = left[at] * parent
        p = before + weight[at] * share
        stored = kept[at]
        ratio, p, string = np.where(stored, p / before, np.nan), np.where(stored, p, parent), _longer(head, tail)
        if last:
            string, n, ratio, p = string[stored], n[stored], ratio[stored], p[:0]
        columns = [string, n, ratio] + [p] * (not last)

        def sent() -> Iterator[tuple]:
            yield from _dealt(1, columns, string, parts)
            yield from _dealt(2, [key[kept], total[kept], left[kept]], key[kept], parts)

        yield from _batches(sent())

    def beside(rows: DataFrame, column: str) -> DataFrame:
        own = shorter.where("kind = 1").select("part", F.lit(0).alias("kind"), "src", "c0", F.col(column).alias("c1"), *(F.lit(None).cast("binary").alias(c) for c in _BLOBS[2:]))
        return _exchanged(rows.unionByName(own), parts)

    return written(beside(beside(strings, "c3").mapInArrow(parent, _SCHEMA), "c1").mapInArrow(learnt, _SCHEMA), "level")


_LEVEL = {1: (np.int64, np.int64, np.float64), 2: (np.int64, np.int64, np.float64)}


def _common(level: DataFrame, kind: int, least: int) -> DataFrame:
    """key and value of the rows of a kind that occur `least` times, and of the start."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, (key, n, value) in _read(batches, _LEVEL):
            own = ((n >= least) | (key == START)) & ~np.isnan(value)
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array(key[own]), pa.array(value[own])], ["key", "value"])

    return level.where(F.col("kind") == kind).mapInArrow(pick, "key long, value double")


def _rest(level: DataFrame, contexts: int, strings: int) -> DataFrame:
    """Rows of kind 1 with key and logarithm of what is rarer, in the same parts."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent() -> Iterator[tuple]:
            for part, kind, _, (key, n, value) in _read(batches, _LEVEL):
                own = (n < (strings if kind == 1 else contexts)) & (key != START) & ~np.isnan(value)
                if own.any():
                    yield part, 1, 0, [key[own], np.log10(value[own])]

        yield from _batches(sent())

    return level.mapInArrow(pick, _SCHEMA)


def _packed(rows: DataFrame, kind: int, columns, parts: int) -> DataFrame:
    """Rows of key and n as arrays: columns(key, n), dealt by key."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent() -> Iterator[tuple]:
            held, size = [], 0
            for batch in batches:
                held.append([np.asarray(c) for c in batch.columns])
                size += batch.num_rows
                if size > _HELD:
                    yield from dealt(held)
                    held, size = [], 0
            if size:
                yield from dealt(held)

        yield from _batches(sent())

    def dealt(held: list) -> Iterator[tuple]:
        key, n = (np.concatenate(c) for c in zip(*held))
        return _dealt(kind, columns(key, n), key, parts)

    return rows.select("key", "n").mapInArrow(pack, _SCHEMA)


def _sorted(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys and values of a table of two columns by key: few rows, by the choice of a share."""
    table = rows.toArrow()
    key, value = (np.asarray(table.column(i).combine_chunks()) for i in (0, 1))
    order = np.argsort(key)
    return key[order], value[order]


class Tree:
    """Root probabilities of frequent words, and the frequent strings of the retained contexts of each length.

    contexts[k]: sorted keys of contexts of k + 1 words, and what each leaves to its parent;
    strings[k]: sorted keys of context and next word, and P over what the context leaves to it.
    """

    def __init__(self, words_: np.ndarray, root: np.ndarray):
        self.words, self.root = words_, root
        self.contexts: list[tuple[np.ndarray, np.ndarray]] = []
        self.strings: list[tuple[np.ndarray, np.ndarray]] = []
        self._places: dict[tuple[str, int], Places] = {}

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_places": {}}

    def _at(self, name: str, level: int, keys: np.ndarray) -> np.ndarray:
        places = self._places.get((name, level))
        if places is None:
            places = self._places[name, level] = Places(self.words if name == "words" else getattr(self, name)[level][0])
        return places.find(keys)

    def find_words(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of frequent words, -1 for others."""
        return self._at("words", 0, keys)

    def probability(self, ids: np.ndarray, doc: np.ndarray, first: np.ndarray, keys: list[np.ndarray] | None = None) -> np.ndarray:
        """P of each position by what is frequent; that of a rare word (ids < 0) still lacks its root probability.

        keys has those of the words and strings that end at each place; without it, rare words count as unknown.
        """
        if keys is None:
            keys = _keys(np.where(ids >= 0, self.words[ids] if len(self.words) else 0, 0), len(self.contexts) + 1)
        p = np.ones(len(ids))
        p[ids >= 0] = self.root[ids[ids >= 0]] if len(self.root) else 1.0
        since = np.arange(len(ids)) - first[doc]
        for level, ((_, left), (_, ratio)) in enumerate(zip(self.contexts, self.strings), 1):
            at = np.flatnonzero(since >= level)
            state, stored = self._at("contexts", level - 1, keys[level - 1][at - 1]), self._at("strings", level - 1, keys[level][at])
            p[at[state >= 0]] *= left[state[state >= 0]]
            p[at[stored >= 0]] *= ratio[stored[stored >= 0]]
        return p


def fit(train: DataFrame, word_share: float, min_share: float, smoothing: float, penalty: float, depth: int, min_count: int = 2) -> tuple[Tree, DataFrame, int, int]:
    """What is frequent of the tree, a table of the rest, N and V, from the column text of `train`.

    The table has arrays of keys (c0) and logarithms (c1) by part: of words as kind 0, where an occurrence
    adds one to n_known and the logarithm to both of its text's, and of strings and contexts as kind 1,
    where it is added to the score only; the root's last part, 1 / (N + V + 1), is left out.
    """
    spark = train.sparkSession
    counts = written(_counted(train, lambda seq, doc, first: seq).where(F.col("key") != START), "words")
    total = counts.agg(F.sum("n"), F.count("*")).first()
    n, v = int(total[0] or 0), int(total[1])
    parts = _parts(spark, n)
    often, least = (max(2, int(np.ceil(share * n))) for share in (word_share, min_share))
    keys, c = _sorted(counts.where(F.col("n") >= often).select("key", "n"))
    starts = counts.where(F.col("key") == END).select("n").collect()
    texts = starts[0][0] if starts else 0
    keys, c = np.append(keys, START), np.append(c, texts)
    keys, c = keys[(order := np.argsort(keys))], c[order]
    tree = Tree(keys, (c + 1) / (n + v + 1))
    rest = [written(_packed(counts.where(F.col("n") < often), 0, lambda key, n: [key, np.log10(n + 1.0)], parts), "rest")]
    shorter = counts.unionByName(spark.createDataFrame([(START, texts)], "key long, n long")).where(F.col("n") >= min_count)
    level = written(_packed(shorter, 1, lambda key, c: [key, c, np.full(len(key), np.nan), (c + 1) / (n + v + 1)], parts), "level")
    freed(counts)
    for length in range(2, depth + 2):
        shared = spark.sparkContext.broadcast(_filter(level.where("kind = 1")))
        strings = _strings(train, length, shared, min_count, parts)
        shorter, level = level, _level(strings, level, parts, float(np.log(max(n, 2))), smoothing, penalty, length > depth)
        freed(strings, shorter)
        contexts = often if length == 2 else least
        tree.contexts.append(_sorted(_common(level, 2, contexts)))
        tree.strings.append(_sorted(_common(level, 1, least)))
        rest.append(written(_rest(level, contexts, least), "rest"))
    freed(level)
    return tree, reduce(DataFrame.unionByName, rest), n, v


def _parts(spark: SparkSession, tokens: int) -> int:
    return min(1 << 16, max(int(spark.conf.get("spark.sql.shuffle.partitions")), tokens // _PART_TOKENS + 1))


def suffix_tree_scores(
    docs: DataFrame,
    held_out: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    word_share: float = 1e-6,
    min_share: float = 1e-6,
    smoothing: float = 4.0,
    penalty: float = 0.5,
    depth: int = 2,
    min_count: int = 2,
) -> DataFrame:
    """Scores every text with a suffix tree learnt from the rows where `held_out` is not true.

    Returns a row for each row of `docs`, repeated ids included: the id as doc_id, held_out, n_tokens
    (words and one end), n_known (tokens seen in training), train_tokens, base_score (log10 by the
    root alone) and score. A null or empty text is one end token; a null `held_out` counts as
    training; without training rows every token has probability 1. Texts are read whole.
    """
    spark = docs.sparkSession
    sized(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    tree, rest, n, v = fit(rows.where(~F.col("held_out")), word_share, min_share, smoothing, penalty, depth, min_count)
    shared = spark.sparkContext.broadcast((tree, _filter(rest.where("kind = 1"))))
    parts, unit = _parts(spark, n), float(np.log10(n + v + 1))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of kind 2, keys that texts look up and the texts' numbers, and of kind 3, what is known of the texts."""
        tree, table = shared.value
        own = TaskContext.get().partitionId()

        def sent() -> Iterator[tuple]:
            src, held, info, size, docs = own << 24, [], [], 0, 0

            def ready() -> Iterator[tuple]:
                key, doc = (np.concatenate(c) for c in zip(*held))
                yield from _dealt(2, [key, doc], key, parts, src=src)
                told = pa.Table.from_batches(info).combine_chunks().to_batches()
                yield own % parts, 3, src, [np.frombuffer(told[0].serialize(), np.uint8)]

            for batch in batches:
                data, offsets = utf8(batch.column(2))
                for lo, hi in blocks(offsets):
                    base = offsets[lo]
                    seq, doc, first = _sequence(data[base : offsets[hi]], offsets[lo : hi + 1] - base)
                    m = hi - lo
                    keys = _keys(seq, depth + 1)
                    ids = tree.find_words(seq)
                    p = np.log10(tree.probability(ids, doc, first, keys))
                    p[first[:-1]] = 0
                    known = ids >= 0
                    known[first[:-1]] = False
                    root = np.log10(tree.root[ids[known]])
                    # rare words, and strings that may be among the tree's rest
                    rare = ids < 0
                    unseen = unit * np.bincount(doc[rare], minlength=m)
                    since, at = np.arange(len(seq)) - first[doc], [np.flatnonzero(rare)]
                    at += [np.flatnonzero(_may_hold(table, key) & (since >= k)) for k, key in enumerate(keys[1:], 1)]
                    key, at = np.concatenate([k[i] for k, i in zip(keys, at)]), np.concatenate(at)
                    order = np.argsort(doc[at], kind="stable")
                    held.append((key[order], (doc[at[order]] + docs).astype(np.int32)))
                    columns = (np.diff(first) - 1, np.bincount(doc[known], minlength=m), np.bincount(doc[known], root, m).astype(float) - unseen, np.bincount(doc, p, m) - unseen)
                    info.append(pa.RecordBatch.from_arrays([*(batch.column(k).slice(lo, m) for k in (0, 1)), *map(pa.array, columns)], schema=_INFO))
                    size += len(at)
                    docs += m
                    if size > _HELD:
                        yield from ready()
                        src, held, info, size, docs = src + 1, [], [], 0, 0
            if docs:
                yield from ready()

        yield from _batches(sent())

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of kind 2, texts that found something: their numbers, what it adds to score, known and base."""

        def sent() -> Iterator[tuple]:
            tree_rows, places = [], None
            for part, kind, src, arrays in _read(batches, {0: (np.int64, np.float64), 1: (np.int64, np.float64), 2: (np.int64, np.int32)}):
                if kind == 3:
                    yield part, kind, src, [arrays[0].copy()]
                    continue
                if kind < 2:
                    tree_rows.append((arrays[0], arrays[1], np.full(len(arrays[0]), kind == 0)))
                    continue
                if places is None:
                    key, value, word = (np.concatenate(c) for c in zip(*tree_rows)) if tree_rows else (np.empty(0, np.int64), np.empty(0), np.empty(0, bool))
                    tree_rows.clear()
                    order = np.argsort(key)
                    key, value, word = key[order], value[order], word[order]
                    # a word's key is also that of a context
                    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
                    added = lambda c: np.add.reduceat(c, new) if len(new) else c
                    places, score, base, known = Places(key[new]), added(value), added(np.where(word, value, 0.0)), added(word.astype(np.int64))
                at = places.find(arrays[0])
                hit = at >= 0
                at, doc = at[hit], arrays[1][hit]
                if len(at):
                    new = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
                    yield part, 2, src, [doc[new], *(np.add.reduceat(c[at], new) for c in (score, known, base))]

        yield from _batches(sent())

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info, more = {}, {}
        for _, kind, src, arrays in _read(batches, {2: (np.int32, np.float64, np.int64, np.float64)}):
            if kind == 3:
                info[src] = pa.ipc.read_record_batch(pa.py_buffer(arrays[0].tobytes()), _INFO)
            else:
                more.setdefault(src, []).append(arrays)
        for src, batch in info.items():
            plain, added = batch.columns, [np.asarray(c).copy() for c in (batch.column(5), batch.column(3), batch.column(4))]
            for doc, *columns in more.get(src, []):
                for total, c in zip(added, columns):
                    total[doc] += c
            score, known, base = map(pa.array, added)
            yield pa.RecordBatch.from_arrays([*plain[:3], known, pa.array(np.full(len(batch), n)), base, score], names)

    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    # the tree comes before what is looked up in it
    both = _exchanged(rest.unionByName(rows.mapInArrow(look, _SCHEMA)), parts).sortWithinPartitions("kind")
    sums = written(both.mapInArrow(found, _SCHEMA), "found")
    back = sums.withColumn("part", F.shiftright("src", 24).cast("int"))
    return _exchanged(back, parts).mapInArrow(told, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
