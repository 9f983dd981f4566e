"""Near-duplicate detection by b-bit MinHash.

1. Every text becomes its set of word shingles; texts with one set are one class, a node that is
   known by a hash of the set, so that rows which share an id but not a text keep their links apart.
2. Each class gets `bands * rows` minima; a band's minima hash to a bucket key, and the two lowest
   bits of each minimum are packed into a signature. With the defaults a pair of similarity 0.8
   shares no bucket with a probability of 1e-7.
3. Pairs from buckets are kept if the similarity estimated from equal bit pairs, corrected for the
   quarter that agrees by chance, is at most `slack` below the threshold (over five deviations);
   then the links are confirmed on the full sets.
4. Not every pair of a bucket is needed for the components: each member meets two of its bucket,
   those with the least and the greatest hash, which are the same ones in most buckets of a group.
5. Links across components that are then still missing are found exactly. A shingle is rare if at
   most `RARE` of the classes left hold it (a Bloom filter of fixed size tells common ones; what it
   takes for common by mistake counts as common everywhere). Two linked sets share a rare shingle,
   or else have all of their overlap in common shingles. The first are met by rare shingle, at most
   RARE to each, if both keep enough shingles without those that no other set holds. For the second,
   a set with few rare shingles that members of a bucket have met is a measure, and what each set
   lacks of it is kept. Sets linked with the measure are one component with it. Two sets overlap in
   no more than what neither lacks of it and the lesser of their common shingles outside it. A set
   outside the measure's component is compared with all others that the measure leaves room for (a
   set with nothing common outside the measure and no shorter has none), once for a measure and not
   in each bucket; a large group is dealt to many tasks by salts, and only pairs that the bound
   can't tell from links leave the join.
6. Components are found by alternating large-star and small-star steps, all in tables. Tables are
   deleted as soon as nothing reads them any more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import freed, sized, written
from tessera.llm.text import Counts, blocks, mix, signed, span_hashes, utf8, words

_A, _B = np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F)
#: Bits of the filter that says which sets to read again: a fixed size, 8 MB.
_FILTER_BITS = 1 << 26
#: Sets that may hold a shingle which counts as rare.
RARE = 16
#: Sets by one measure that one task compares others with.
SALTED = 256


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The distinct shingles of `size` words of each text as 64-bit hashes; the whole text if it has fewer words."""
    start, end, doc = words(data, offsets)
    h = span_hashes(data, start, end)
    n = len(offsets) - 1
    first = np.r_[0, np.cumsum(np.bincount(doc, minlength=n))]
    rolled = h.copy()
    for k in range(1, size):
        rolled[: len(h) - k] = mix(rolled[: len(h) - k] * _A + h[k:] * _B)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            whole = h[a : a + 1].copy()
            for k in range(a + 1, b):
                whole = mix(whole * _A + h[k : k + 1] * _B)
            out.append(whole)
        else:
            out.append(h[:0])
    return out


def _nodes(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of each set; 0 for an empty one."""
    out = np.zeros(len(sets), np.uint64)
    for i, s in enumerate(sets):
        if len(s):
            out[i] = mix(mix(s + _A).sum(keepdims=True) * _A + mix(s ^ _B).sum(keepdims=True) * _B + np.uint64(len(s)))[0]
    return out


def _multipliers(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(77)
    return rng.integers(1, 1 << 32, k, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, k, dtype=np.uint32)


def _minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(x), 1024):
        out = np.minimum(out, (a[:, None] * x[None, lo : lo + 1024] + b[:, None]).min(1))
    # spreads the low bits: the minimum itself is a small number
    out = (out ^ out >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
    return (out ^ out >> np.uint32(12)) * np.uint32(0x297A2D39)


def _signatures(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    a, b = _multipliers(bands * rows)
    planes = -(-bands * rows // 64)
    weights = np.random.default_rng(5).integers(1, 1 << 63, rows, dtype=np.uint64) | np.uint64(1)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for lo, hi in blocks(offsets):
                base, n = offsets[lo], hi - lo
                sets = shingle_sets(data[base : offsets[hi]], offsets[lo : hi + 1] - base, size)
                keys = np.zeros((n, bands), np.uint64)
                bits = np.zeros((n, 2, planes * 64), np.uint8)
                for i, s in enumerate(sets):
                    if len(s):
                        m = _minima(s, a, b)
                        keys[i] = (m.reshape(bands, rows).astype(np.uint64) * weights).sum(1)
                        bits[i, 0, : len(m)], bits[i, 1, : len(m)] = m >> 31, m >> 30 & 1
                keys = mix(keys + np.arange(bands, dtype=np.uint64) * _A)
                packed = np.packbits(bits.reshape(n, -1), axis=1).view(np.int64)
                lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, n), pa.array([len(s) for s in sets], pa.int64()), pa.array(signed(_nodes(sets))), lists(signed(keys)), lists(packed)],
                    ["doc_id", "n_shingles", "node", "bands", "bits"],
                )

    return docs.mapInArrow(sign, "doc_id long, n_shingles long, node long, bands array<long>, bits array<long>")


def _filter(ids: DataFrame, places: list[Column]) -> np.ndarray:
    """A Bloom filter of fixed size; its words are put together by key before they are sent."""
    bit = F.explode(F.array(*places)).alias("bit")
    word = F.shiftright("bit", 6)
    rows = ids.select(bit).groupBy(word.alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow()
    table = np.zeros(_FILTER_BITS // 64, np.int64)
    if rows.num_rows:
        table[np.asarray(rows.column(0).combine_chunks())] = np.asarray(rows.column(1).combine_chunks())
    return table


def _id_places(column: str) -> list[Column]:
    return [F.pmod(F.xxhash64(F.col(column), F.lit(k)), F.lit(_FILTER_BITS)) for k in range(5)]


#: Shingles are hashes already: parts of them are places.
_SHIFTS = (0, 19, 38)


def _sets(docs: DataFrame, needed: DataFrame, size: int) -> DataFrame:
    """node and set (sorted hashes) of the classes in `needed`, which has node and id, a document of the class."""
    shared = docs.sparkSession.sparkContext.broadcast(_filter(needed, _id_places("id")))
    hashes = F.array(*_id_places("doc_id")).alias("at")

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            at = np.asarray(batch.column(1).flatten()).reshape(-1, 5)
            hit = (table[at >> 6] >> (at & 63) & 1).all(1)
            if hit.any():
                batch = batch.filter(pa.array(hit))
                data, offsets = utf8(batch.column(0))
                for lo, hi in blocks(offsets):
                    base = offsets[lo]
                    sets = shingle_sets(data[base : offsets[hi]], offsets[lo : hi + 1] - base, size)
                    values = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32)), pa.array(signed(np.concatenate(sets))))
                    yield pa.RecordBatch.from_arrays([pa.array(signed(_nodes(sets))), values], ["node", "set"])

    found = docs.select("text", hashes).mapInArrow(collect, "node long, set array<long>")
    found = found.join(needed.select("node").hint("merge"), "node", "left_semi")
    return written(found.groupBy("node").agg(F.first("set").alias("set")), "sets")


def _split_sets(sets: DataFrame, rare: int) -> DataFrame:
    """node, n (shingles), common (how many of them more than `rare` sets hold) and rare (the others)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counts()
        for batch in batches:
            held.add(np.asarray(batch.column(0).flatten()))
            for key, n in held.ready():
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])
        for key, n in held.ready(last=True):
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])

    held = sets.select("set").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > rare)
    mask = _FILTER_BITS - 1
    places = [F.shiftrightunsigned("key", k).bitwiseAND(F.lit(mask)) for k in _SHIFTS]
    shared = sets.sparkSession.sparkContext.broadcast(_filter(held, places))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            size = np.diff(np.asarray(batch.column(1).offsets))
            h = np.asarray(batch.column(1).flatten())
            common = np.ones(len(h), bool)
            for k in _SHIFTS:
                at = (h.view(np.uint64) >> np.uint64(k) & np.uint64(mask)).astype(np.int64)
                common &= (table[at >> 6] >> (at & 63) & 1).astype(bool)
            ends = np.r_[0, np.cumsum(size)]
            number = np.diff(np.r_[0, np.cumsum(common)][ends])
            left = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size - number)].astype(np.int32)), pa.array(h[~common]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size.astype(np.int64)), pa.array(number.astype(np.int64)), left], ["node", "n", "common", "rare"])

    return sets.select("node", "set").mapInArrow(part, "node long, n long, common long, rare array<long>")


def _missing_pairs(rest: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of different components that could be linked, and those that are known to be.

    rest: key, node and component of the buckets left.
    """
    nodes = rest.select("node", "component").distinct()
    own = _split_sets(sets.join(nodes.select("node").hint("merge"), "node", "left_semi"), RARE)
    own = written(own.join(nodes, "node"), "split")
    # a shingle that no other of these sets holds is in no overlap
    alone = own.select("node", F.explode("rare").alias("e")).groupBy("e").agg(F.count("*").alias("c"), F.min("node").alias("node")).where("c = 1")
    alone = alone.groupBy("node").agg(F.count("*").alias("alone"))
    reach = (F.col("n") - F.coalesce("alone", F.lit(0))).alias("reach")
    held = own.join(alone, "node", "left").select("component", "node", "n", reach, F.explode("rare").alias("e")).select("e", F.struct("component", "node", "n", "reach").alias("x"))
    # at most RARE sets hold one of these shingles
    held = held.where(f"100 * x.reach >= {percent} * x.n").groupBy("e").agg(F.collect_list("x").alias("g")).where("array_min(g).component < array_max(g).component")
    enough = f"x.component < y.component and {100 + percent} * least(x.reach, y.reach) >= {percent} * (x.n + y.n)"
    met = held.select(F.explode(F.expr(f"flatten(transform(g, x -> transform(filter(g, y -> {enough}), y -> struct(least(x.node, y.node) as a, greatest(x.node, y.node) as b))))")).alias("p")).select("p.*")
    met = written(met.distinct(), "met")
    # linked without a rare shingle in common: both have that many common ones
    rich = rest.join(own.where(f"100 * common >= {percent} * n").select("node", "n", "common"), "node")
    rich = _could_link(written(rich, "rich"), F.col("common"), percent)
    # the set with the fewest rare shingles that any member of a bucket has met stands for what most share
    best = F.min(F.struct((F.col("n") - F.col("common")).alias("rare"), (-F.col("common")).alias("common"), F.col("node"), F.col("component"), F.col("n"))).alias("best")
    met_by = rich.join(rich.groupBy("key").agg(best), "key").groupBy("node").agg(F.min("best").alias("best"))
    hubs = _split(rich.select("key", "node", "component").join(met_by, "node"), F.min("best").alias("best")).select("key", F.col("best.node").alias("hub"), F.col("best.component").alias("main"), F.col("best.n").alias("hub_n"))
    # what meets by bucket meets by its measure too, there once and not in each bucket
    near = written(rich.join(hubs, "key").select("node", "hub", "component", "main", "n", "hub_n").distinct(), "near")
    freed(rich, shuffles=False)
    spans = near.join(own.select("node", "rare"), "node")
    spans = spans.join(sets.select("node", F.col("set").alias("x")).hint("merge"), "node").join(sets.select(F.col("node").alias("hub"), F.col("set").alias("h")), "hub")
    outside = F.size(F.array_except(F.array_except("x", "h"), "rare")).alias("outside")
    spans = written(spans.select(F.col("hub").alias("key"), "node", "component", "main", "n", "hub_n", F.array_except("h", "x").alias("gone"), outside), "spans")
    freed(near, own, shuffles=False)
    # links with the measure are known by now, and join components to its own
    inside = F.col("hub_n") - F.size("gone")
    spans = spans.withColumn("linked", (100 + percent) * inside >= percent * (F.col("n") + F.col("hub_n")))
    direct = spans.where("linked and component != main").select(F.least("node", "key").alias("a"), F.greatest("node", "key").alias("b"))
    apart = spans.where("component != main")
    joined = apart.where("linked").select("key", "component").distinct().withColumn("joined", F.lit(True))
    apart = apart.join(joined, ["key", "component"], "left").withColumn("component", F.expr("if(joined, main, component)")).drop("joined")
    sides = spans.where("component = main").unionByName(apart)
    last = _could_link(written(sides, "sides"), inside + F.col("outside"), percent)
    # a set that isn't linked with the measure is linked with another only if it lacks what that lacks of the
    # measure but for less than `spare`; nothing links so with a set whose spare is none
    spare = percent * (F.col("hub_n") - F.col("n")) + (100 + percent) * F.col("outside")
    minor = last.where("component != main")
    other = last.where(spare > 0)
    sizes = other.groupBy("key").agg(F.ceil(F.count("*") / SALTED).alias("salts"))
    minor = minor.join(sizes, "key").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    other = other.join(sizes, "key").withColumn("salt", F.pmod(F.xxhash64("node"), "salts"))
    other = other.select("key", "salt", *(F.col(c).alias(f"other_{c}") for c in ("node", "component", "n", "gone", "outside")))
    # of the measure both have all but what either lacks
    most = "hub_n - size(gone) - size(other_gone) + least(outside, other_outside)"
    fits = f"{100 + percent} * ({most} + {{0}}) >= {percent} * (n + other_n)"
    close = minor.join(other, ["key", "salt"]).where(f"component != other_component and {fits.format('least(size(gone), size(other_gone))')} and {fits.format('size(array_intersect(gone, other_gone))')}")
    close = close.select(F.least("node", "other_node").alias("a"), F.greatest("node", "other_node").alias("b"))
    return met.union(close).distinct(), direct


def _split(rows: DataFrame, *values: Column) -> DataFrame:
    """key and values of the buckets that hold several components."""
    return rows.groupBy("key").agg(*values, F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").drop("lo", "hi")


def _could_link(rows: DataFrame, most: Column, percent: int) -> DataFrame:
    """Rows of split buckets whose greatest possible overlap is enough for the bucket's smallest set; `rows` are deleted."""
    least = _split(rows, F.min("n").alias("least"))
    out = written(rows.join(least, "key").where((100 + percent) * most >= percent * (F.col("n") + F.col("least"))).drop("least"), "could")
    freed(rows, shuffles=False)
    return out


def components(edges: DataFrame) -> DataFrame:
    """node, component: for each node of the undirected edges (a, b) the smallest node that it reaches.

    Alternating large-star and small-star steps until the edges stay as they are, which are then a
    star around each smallest node. Self loops are allowed; an empty table gives an empty one.
    """
    pairs = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    before = None
    while True:
        both = pairs.union(pairs.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: larger neighbours go to the smallest one
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b")
        large = large.where("a < b").distinct()
        # small star: the smaller neighbours and the node itself go to the smallest one
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down, "b")
        small = small.select(F.col("m").alias("a"), F.col("a").alias("b")).union(down.select(F.col("m").alias("a"), "b")).where("a < b").distinct()
        done, pairs = pairs, written(small, "stars")
        freed(done, shuffles=False)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return pairs.select(F.col("b").alias("node"), F.col("a").alias("component")).union(pairs.select("a", "a").distinct())


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 5,
    percent: int = 80,
    bands: int = 40,
    rows: int = 5,
    slack: float = 0.18,
) -> DataFrame:
    """A row for each row of `docs`: doc_id, n_shingles, component_id and kept.

    Two texts are linked if 100 * |intersection| >= percent * |union| of their shingle sets, and
    component_id is the smallest id that links lead to. Null and empty texts and texts of white
    space have an empty set and link with nothing; a text shorter than a shingle is one shingle.
    Repeated rows stay repeated. Rows with one id and different texts each have their own links; a
    null id is no smallest id, so a component of such rows only has none. Texts are read whole,
    other columns of `docs` are not looked at, and an empty table gives an empty result.
    """
    sized(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    wide = written(_signatures(docs, shingle_words, bands, rows), "signed")
    # all of a class carry the same signature
    classes = wide.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("id"), *(F.first(c).alias(c) for c in ("n_shingles", "bands", "bits")))
    classes = written(classes, "classes")
    rows_of = written(wide.select("doc_id", "n_shingles", "node"), "rows")
    freed(wide)
    keyed = classes.select("node", F.explode("bands").alias("key"))
    # the least and the greatest of a bucket, of which those with one member only have none
    hubs = keyed.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi")
    members = written(keyed.join(hubs, "key"), "members")
    # with signatures of those only that met another
    narrow = classes.select("node", "id", "n_shingles", "bits").join(members.select("node").distinct(), "node", "left_semi")
    narrow = written(narrow, "signatures")
    ids = written(classes.select("node", "id"), "ids")
    freed(classes)
    sets = _sets(docs, narrow.select("node", "id"), shingle_words)

    def linked(pairs: DataFrame) -> DataFrame:
        """Of distinct pairs (a, b), those whose sets are similar enough."""
        k, cut = bands * rows, percent / 100 - slack
        planes = -(-k // 64)
        differ = " + ".join(f"bit_count((x[{i}] ^ y[{i}]) | (x[{i + planes}] ^ y[{i + planes}]))" for i in range(planes))
        pairs = pairs.join(narrow.select(F.col("node").alias("a"), F.col("bits").alias("x"), F.col("n_shingles").alias("na")), "a")
        pairs = pairs.join(narrow.select(F.col("node").alias("b"), F.col("bits").alias("y"), F.col("n_shingles").alias("nb")), "b")
        pairs = pairs.where(F.expr(f"(1 - ({differ}) / {k}D - 0.25) / 0.75 >= {cut}"))
        pairs = pairs.where(F.expr(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")).select("a", "b", "na", "nb")
        # sets grow with the input: they are dealt by key, at any size
        of = lambda end, name: sets.select(F.col("node").alias(end), F.col("set").alias(name)).hint("merge")
        pairs = pairs.join(of("a", "sa"), "a").join(of("b", "sb"), "b")
        return pairs.withColumn("both", F.size(F.array_intersect("sa", "sb"))).where(F.expr(f"100 * both >= {percent} * (na + nb - both)")).select("a", "b")

    pairs = members.select("node", F.explode(F.array("lo", "hi")).alias("hub")).where("node != hub")
    first = components(linked(pairs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()))
    found = written(members.select("node").distinct().join(first, "node", "left").select("node", F.coalesce("component", "node").alias("component")), "found")
    labelled = members.select("key", "node").join(found, "node")
    rest = written(labelled.join(_split(labelled), "key"), "rest")
    freed(first, members)
    maybe, known = _missing_pairs(rest, sets, percent)
    links = linked(maybe).union(known)
    ends = found.select(F.col("node").alias("a"), F.col("component").alias("ca")), found.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    united = components(links.join(ends[0], "a").join(ends[1], "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    freed(rest, sets, narrow)
    found = found.join(united.select(F.col("node").alias("component"), F.col("component").alias("next")), "component", "left")
    named = ids.join(found.select("node", F.coalesce("next", "component").alias("component")), "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("id").alias("component_id"))
    top = named.join(smallest, "component").select("node", "component_id")
    out = rows_of.join(top, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
