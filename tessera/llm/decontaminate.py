"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

A seed is a mask over consecutive tokens: at each place of a text the tokens that the mask selects
are hashed, those it passes over may differ. Hashes of the benchmark meet those of the documents in
an equi-join; around each hit the two texts are laid side by side and compared token by token, so
that substituted words cost a match but not the find. Of hits that follow one another with one mask
and one alignment only the first is compared.

A document is contaminated by an item if, side by side, at least `percent` of the item's tokens
agree, or at least `percent` of some `window` consecutive ones.

An item's masks depend on its length. Each set of masks in MASKS is lossless at 80 per cent: however
the permitted substitutions lie in an item of that length, one mask fits at some place between them
(and, from 12 tokens on, so it is in every 13 tokens with two substitutions); items of one to four
tokens must agree as a whole. Inserted or dropped words shift the alignment: what lies on either
side is compared apart, and is found if it fulfils the rule by itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least and greatest number of tokens of an item, and its masks.
MASKS = (
    (1, 1, ("1",)),
    (2, 2, ("11",)),
    (3, 3, ("111",)),
    (4, 4, ("1111",)),
    (5, 5, ("111", "11001")),
    (6, 11, ("1111", "110011")),
    (12, 1 << 31, ("11111", "1100111")),
)
#: Seed hashes of the benchmark up to which its table is broadcast; above, all sides are shuffled.
BROADCAST_SEEDS = 500_000
_GAP = r"[\x20\x09-\x0D]+"


def tokens(text: Column) -> Column:
    """Lower-case words of a text; none for null, empty texts and white space."""
    # white space at either end makes an empty part there
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _GAP), lambda w: w != "")


def _picked(mask: str) -> list[int]:
    return [k for k, bit in enumerate(mask) if bit == "1"]


def _placed(rows: DataFrame, array: str, place: str, masks: tuple[str, ...], keep: list[str]) -> DataFrame:
    """A row for each place of a text (from 0) and mask, with its number and the hash as `seed`."""
    shortest = min(map(len, masks))
    # outer forms infer no filters, which would make the array a second time
    places = F.explode_outer(F.expr(f"if(size({array}) >= {shortest}, sequence(0, size({array}) - {shortest}), null)"))
    spots = rows.select(*keep, array, places.alias(place))
    # null where the text ends before the mask
    hashes = [f"if({place} + {len(m)} <= size({array}), xxhash64('{m}', {', '.join(f'get({array}, {place} + {k})' for k in _picked(m))}), null)" for m in masks]
    return spots.select(*keep, array, place, F.posexplode_outer(F.expr(f"array({', '.join(hashes)})")).alias("number", "seed")).where("seed is not null")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", percent: int = 80, window: int = 13, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """A row for each document and benchmark item that it contains, clean documents have none.

    Columns: doc_id, item_id, item_tokens, n_matched (tokens that agree in the best alignment),
    n_window (in the best `window` tokens of any). Items of fewer than `window` tokens must agree as a
    whole. With `percent` of 80 or more and a `window` of 13 all is found that this rule asks for, for
    items of any length; with less, what no mask fits in is missed. Items without tokens are in no
    document. Null texts are empty; rows with equal doc_id, or equal item_id, are taken together; rows
    with a null id are taken together as well. Very long texts are read whole, other columns are not
    looked at. Without documents or items the result is empty.
    """
    hashes = lambda text: F.transform(tokens(text), lambda w: F.xxhash64(w))
    items = benchmark.select(F.col(item_col).alias("item_id"), hashes(F.col(item_text_col)).alias("item")).where(F.size("item") > 0).distinct()
    items = items.withColumn("item_key", F.xxhash64("item_id", F.size("item"), "item"))
    # seven rows at most
    lengths = [F.size("item").between(lo, hi) for lo, hi, _ in MASKS]
    chosen = items.select(F.coalesce(*(F.when(here, i) for i, here in enumerate(lengths))).alias("i")).distinct().collect()
    chosen = sorted(r["i"] for r in chosen) or [len(MASKS) - 1]
    named = lambda masks: F.element_at(F.array(*map(F.lit, masks)), F.col("number") + 1).alias("mask")
    seeds = reduce(DataFrame.unionByName, (_placed(items.where(lengths[i]), "item", "item_place", MASKS[i][2], ["item_id", "item_key"]).select("item_id", "item_key", "item_place", named(MASKS[i][2]), "seed") for i in chosen))
    masks = tuple(dict.fromkeys(m for i in chosen for m in MASKS[i][2]))
    texts = docs.select(F.col(id_col).alias("doc_id"), hashes(F.col(text_col)).alias("words"))
    placed = _placed(texts, "words", "place", masks, ["doc_id"])
    # the item's first token lies beside the document's token `shift`
    shift = (F.col("place") - F.col("item_place")).alias("shift")
    if seeds.limit(broadcast_seeds + 1).count() <= broadcast_seeds:
        # words stay a reference until a hit: nothing is dealt out but hits
        hits = placed.join(F.broadcast(seeds), "seed").select("doc_id", "item_id", "item_key", "words", "mask", "place", "item_place", shift)
        # each of these items' tokens begins a seed, but for its last few
        hits = hits.join(F.broadcast(items.select("item_key", "item")), "item_key")
        before = " ".join(f"when '{m}' then {' and '.join(f'get(words, place - 1 + {k}) = get(item, item_place - 1 + {k})' for k in _picked(m))}" for m in masks)
        hits = hits.where(f"not coalesce(place > 0 and item_place > 0 and case mask {before} end, false)")
    else:
        spots = placed.drop("words", "number").join(seeds, "seed").groupBy("doc_id", "item_id", "item_key", shift).count()
        spots = spots.select(F.col("doc_id").alias("d"), "item_id", "item_key", "shift")
        hits = spots.join(texts, F.col("d").eqNullSafe(F.col("doc_id"))).join(items.select("item_key", "item"), "item_key")
    beside = "transform(sequence(0, size(item) - 1), i -> if(shift + i >= 0 and get(words, shift + i) = item[i], 1, 0))"
    hits = hits.select("doc_id", "item_id", F.size("item").alias("item_tokens"), F.expr(beside).alias("same"))
    part = f"array_max(transform(sequence(0, greatest(size(same) - {window}, 0)), i -> aggregate(slice(same, i + 1, {window}), 0, (a, x) -> a + x)))"
    hits = hits.select("doc_id", "item_id", "item_tokens", F.expr("aggregate(same, 0, (a, x) -> a + x)").alias("n_matched"), F.expr(part).alias("n_window"))
    best = hits.groupBy("doc_id", "item_id").agg(F.max("item_tokens").alias("item_tokens"), F.max("n_matched").alias("n_matched"), F.max("n_window").alias("n_window"))
    whole = F.col("n_matched") * 100 >= F.col("item_tokens") * percent
    partly = (F.col("item_tokens") >= window) & (F.col("n_window") * 100 >= window * percent)
    return best.where(whole | partly)
