"""Generation: seeds with exact quotas, choice among candidates, variations, all behind a text model."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.masking import masked_words
from tessera.functions.text import hash_gaussian, hash_uniform, nonempty, target_words, tone_prefix
from tessera.models import generated
from tessera.operators.choice import chosen, second_attempt, sigma
from tessera.operators.sampling import stratified_sample

#: Texts whose words are masked at a time.
PART = 256


def length_budget(texts: DataFrame, key: str = "doc_id", spread: float = 2.5, least: int = 25, scale: float = 1.2, limit: int = 1200) -> DataFrame:
    """key, target (words with noise, at least `least`), max_tokens, and the band of accepted lengths."""
    n = F.size(F.split(F.coalesce("text", F.lit("")), " "))
    target = F.greatest(n + (hash_gaussian(42, F.col(key)) * spread).cast("int"), F.lit(least))
    rows = texts.select(key, target.cast("long").alias("target"))
    return rows.select(
        key,
        "target",
        F.least((F.col("target") * scale).cast("long"), F.lit(limit)).alias("max_tokens"),
        F.bround(F.col("target") * 0.85).cast("long").alias("min_words"),
        F.bround(F.col("target") * 1.15).cast("long").alias("max_words"),
    )


def candidates(texts: DataFrame, number: int = 5, attempt: int = 1, key: str = "doc_id") -> DataFrame:
    """Long form of candidates with scores from hashes: a stand-in for a summariser and its judges.

    Confidences are whole millionths, so that no rounding of halves decides them.
    """
    u = lambda what: F.round(hash_uniform(F.lit(f"{what}{attempt}"), F.col(key), F.col("cand")), 6)
    rows = texts.select(key, "target", F.explode(F.sequence(F.lit(1), F.lit(number))).alias("cand"))
    return rows.select(key, "target", "cand", u("similarity").alias("similarity"), F.when(u("label") < 0.5, "negative").otherwise("positive").alias("label"), ((500_000 + F.floor(hash_uniform(F.lit(f"confidence{attempt}"), F.col(key), F.col("cand")) * 500_000)) / 1e6).alias("confidence"))


def abstraction(texts: DataFrame, epsilon: float | None = None, rows: int = 2, number: int = 5, key: str = "doc_id") -> DataFrame:
    """For each text (with target) the chosen candidate of two attempts."""
    noise = sigma(rows, epsilon)
    return second_attempt(chosen(candidates(texts, number, 1, key), key, noise), chosen(candidates(texts, number, 2, key), key, noise), key)


def guarded(attempts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of each key's attempts that with the wanted label and most confidence, or else the most confident one."""
    rank = F.struct((F.col("label") == F.col("target")).cast("int").alias("hit"), "confidence", -F.col("cand"))
    return attempts.groupBy(key).agg(F.max_by(F.struct("cand", "label", "confidence", "target"), rank).alias("best")).select(key, "best.*")


def variations(texts: DataFrame, number: int = 2, share: float = 0.25, keep_original: bool = True, key: str = "doc_id", seed: int = 42) -> DataFrame:
    """key, var_idx and text: `number` masked variants of each text, and the original as 0.

    The masks are those of text.masked under key and variant.
    """

    def vary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, PART):
                part = batch.slice(lo, PART)
                names = [b"%d|%s" % (seed, n.encode()) for n in part.column(2).to_pylist()]
                # white space of bytes is that of words()
                texts = [(t or b"").split() for t in part.column(1).cast(pa.binary()).to_pylist()]
                if keep_original:
                    yield made(part, 0, [b" ".join(w) for w in texts])
                for v in range(1, number + 1):
                    yield made(part, v, masked_words(texts, [b"%s/%d" % (n, v) for n in names], share))

    def made(part: pa.RecordBatch, v: int, text: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column(0), pa.array([v] * len(text), pa.int32()), pa.array(text, pa.binary()).cast(pa.string())], [key, "var_idx", "text"])

    own = texts.select(key, "text", F.coalesce(F.col(key).cast("string"), F.lit("")).alias("name"))
    return own.mapInArrow(vary, f"`{key}` {own.schema[key].dataType.simpleString()}, var_idx int, text string")


def synthesis(samples: DataFrame, size: int, model: str = "echo", copies: int = 2, key: str = "doc_id") -> DataFrame:
    """key, var_idx, label1 and text: seeds by class, a prompt with tone and length, a generation per variation."""
    seeds = stratified_sample(samples, "label1", size, key=key)
    bit = F.when(F.col("label1") == "positive", 1).when(F.col("label1") == "negative", 0)
    varied = variations(seeds, copies, keep_original=False, key=key).join(seeds.select(key, "label1", F.col("text").alias("source")), key)
    prompts = varied.select(key, "var_idx", "label1", "source", F.concat(tone_prefix(bit), "text").alias("prompt"), target_words(F.col("source")).alias("max_tokens"))
    made = generated(prompts, model)
    return made.select(key, "var_idx", "label1", nonempty(F.col("generation"), F.col("source")).alias("text"))
