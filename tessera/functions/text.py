"""Column functions over texts: words, chunks, hashes, labels and clean-up of generated text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII white space, as a class for regular expressions.
SPACE = r"[\x20\x09-\x0D]+"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once per row, also where `use` has lambdas of its own."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text: what white space separates; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def token_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.size(words(text)).cast("long")


def normalised(text: Column) -> Column:
    """White space as single spaces, none at either end."""
    return F.array_join(words(text), " ")


def hash_uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the parts, the same in any partitioning."""
    key = F.concat_ws("|", *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def hash_order(seed: int, key: Column) -> Column:
    """A random order of keys as text: sort by it, then by the key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")))


def hash_gaussian(seed: int, key: Column) -> Column:
    """A standard normal number from a key, by the method of Box and Muller."""
    u = F.greatest(hash_uniform(F.lit(str(seed)), key, F.lit("u")), F.lit(1e-12))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * hash_uniform(F.lit(str(seed)), key, F.lit("v")))


def char_chunks(text: Column, size: int = 512, stride: int = 400) -> Column:
    """Overlapping chunks of characters; the first that reaches the end is the last. None for an empty text."""
    n = F.length(text)
    last = F.when(n <= size, 0).otherwise(F.ceil((n - size) / stride)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda k: F.substring(text, k * stride + 1, F.lit(size))))


def word_chunks(text: Column, size: int = 100, overlap: int = 20) -> Column:
    """Overlapping chunks of words, one from each multiple of size - overlap; none for an empty text."""
    chunks = lambda w: F.transform(F.sequence(F.lit(0), (F.size(w) - 1).cast("int"), F.lit(size - overlap)), lambda k: F.array_join(F.slice(w, k + 1, F.lit(size)), " "))
    return bound(words(text), lambda w: F.when(F.size(w) > 0, chunks(w)))


def fixed_chunks(tokens: Column, size: int = 512) -> Column:
    """Arrays of `size` tokens each, the last one shorter."""
    return bound(tokens, lambda w: F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(0), (F.size(w) - 1).cast("int"), F.lit(size)), lambda k: F.slice(w, k + 1, F.lit(size)))))


def masked(text: Column, key: Column, share: float, seed: int = 42) -> Column:
    """The text with each word replaced by _ with a probability of `share`."""
    return F.array_join(F.transform(words(text), lambda w, i: F.when(hash_uniform(F.lit(str(seed)), key, i) < share, F.lit("_")).otherwise(w)), " ")


def truncated(text: Column, size: int = 300) -> Column:
    """The first `size` words."""
    return F.array_join(F.slice(words(text), 1, size), " ")


def first_characters(text: Column, size: int = 1000) -> Column:
    """The first `size` characters; empty for null."""
    return F.substring(F.coalesce(text, F.lit("")), 1, size)


def encoded(tokens: Column, size: int, pad: int = 0, ignored: int = -100) -> tuple[Column, Column]:
    """Token ids cut or padded to `size`, and labels, in which padding is `ignored`."""
    kept = F.slice(tokens, 1, size)
    fill = lambda value: F.array_repeat(F.lit(value), F.greatest(F.lit(0), size - F.size(kept)))
    return F.concat(kept, fill(pad)), F.concat(kept, fill(ignored))


def label_field(label: Column) -> Column:
    """The second field of a composite label that tabs separate, or the whole one."""
    fields = F.split(label, "\t")
    return F.when(F.size(fields) > 1, F.get(fields, F.lit(1))).otherwise(label)


def composite_label(tag: Column, sentiment: Column, target_words: Column) -> Column:
    return F.concat_ws("\t", tag, sentiment, target_words.cast("string"))


def target_words(text: Column, share: float = 0.8) -> Column:
    """Words that a shorter version should have: half to even, one at least."""
    return F.greatest(F.lit(1), F.bround(token_count(text) * F.lit(share)).cast("long"))


# fixed values below: the accepted spellings of labels and the prefixes of tones


def sentiment_name(raw: Column) -> Column:
    """A classifier's label in capitals; LABEL_0 to LABEL_2 by name."""
    up = F.upper(F.trim(raw))
    return F.when(up == "LABEL_0", "NEGATIVE").when(up == "LABEL_1", "POSITIVE").when(up == "LABEL_2", "NEUTRAL").otherwise(up)


def binary_sentiment(raw: Column) -> Column:
    """negative or positive by what the name holds, negative first; else unknown."""
    up = sentiment_name(raw)
    return F.when(up.contains("NEG"), "negative").when(up.contains("POS"), "positive").otherwise("unknown")


def sentiment_bit(raw: Column) -> Column:
    """1 or 0 for the usual spellings of positive and negative; null for others."""
    low = F.lower(F.trim(raw))
    return F.when(low.isin("pos", "positive", "+", "1", "true"), 1).when(low.isin("neg", "negative", "-", "0", "false"), 0)


def tone_prefix(bit: Column) -> Column:
    return F.when(bit == 1, "Keep positive tone: ").when(bit == 0, "Keep negative tone: ").otherwise("")


def collapsed_marks(text: Column) -> Column:
    """Runs of sentence marks as their last one."""
    return F.regexp_replace(text, r"([.?!,]){2,}", "$1")


def without_thinking(text: Column) -> Column:
    """Generated text without its think block, its closing remark and quotation marks around it."""
    body = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    body = F.when(body.contains("This rewrite"), F.substring_index(body, "This rewrite", 1)).otherwise(body)
    return F.btrim(F.btrim(body, F.lit(" \t\n\r\x0b\x0c")), F.lit('"'))


def assistant_part(text: Column) -> Column:
    """What an answer says after the last role name `assistant` in any case, without headings of solutions and marks around it."""
    body = F.btrim(F.regexp_replace(F.trim(text), r'^[^{\[]*?[\[{]?"?text"?\s*:\s*"?', ""), F.lit('"{}[]'))
    body = F.regexp_replace(body, r"(?is)^.*assistant", "")
    body = F.regexp_replace(body, r"(?i)\*\*\s*solution\s*\d+\s*:?\s*\*\*:?", "")
    return F.trim(F.btrim(F.trim(F.regexp_replace(body, r"(?i)(system|user|assistant)", "")), F.lit('"')))


def first_answer(text: Column) -> Column:
    """Text after `assistant` up to the next `system`; the whole text without one."""
    found = F.regexp_extract(text, r"(?is)assistant\s*(.+?)(?=\bsystem\b|$)", 1)
    return F.when(found != "", F.trim(found)).otherwise(F.trim(text))


def nonempty(generated: Column, source: Column) -> Column:
    """The source where generation gave nothing."""
    return F.when(F.trim(F.coalesce(generated, F.lit(""))) == "", source).otherwise(generated)
