"""Redaction of personal information by patterns, in a fixed order, and of spans that a model finds."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import bound

# Patterns, replacements and their order are the behaviour.
PATTERNS = (
    (r"<[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}>|\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "[EMAIL]"),
    (r"\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}", "[PHONE]"),
    (r"\b\d{5}(?:-\d{4})?\b", "[ZIPCODE]"),
    (r"[^\n()]{2,100}\([a-zA-Z0-9_]{3,15}\)", "[NAME_AND_ID]"),
    (r"\b[A-Z][a-z]+[A-Z][a-z]+\b", "[NAME]"),
    (r"\b(?:Dr|Mr|Ms|Mrs|Prof)\.?\s+[A-Z][a-z]+\b", "[NAME]"),
    (r"\b[a-z]{3}\d{1,3}\b", "[USERID]"),
    (r"\b[a-z]{2,6}\d{2,4}_[a-z0-9]+\b", "[ACCOUNT]"),
    (r"\bdr\.?\s?[a-z]+(?:'[a-z]+)?\b", "[NAME]"),
    (r"https?://[^\s]*~[a-z]{2,20}|www\.[^\s]*~[a-z]{2,20}", "[URL_USER]"),
)
CURRENCY = (
    (r"\$([1-9][0-9]{2})", "$100-$999"),
    (r"\$([1-9][0-9]{3})", "$1K-$9K"),
    (r"\$([1-9][0-9]{4})", "$10K-$99K"),
    (r"\$([1-9][0-9]{5})", "$100K-$999K"),
    (r"\$([1-9][0-9]{6})", "$1M+"),
)
#: What a document is searched for when exposure is counted.
DETECTORS = (PATTERNS[0][0], PATTERNS[1][0], PATTERNS[3][0])


#: What a text must hold (a plain string, or a shorter pattern) for a pattern to match in it, where that is cheaper to see.
_NEEDS = {
    PATTERNS[0][0]: "@",
    PATTERNS[1][0]: re.compile(r"\d{3}[-.\s]?\d{4}"),
    PATTERNS[2][0]: re.compile(r"\d{5}"),
    PATTERNS[3][0]: re.compile(r"\([a-zA-Z0-9_]{3,15}\)"),
    PATTERNS[6][0]: re.compile(r"[a-z]\d"),
    PATTERNS[7][0]: re.compile(r"\d_"),
    PATTERNS[8][0]: "dr",
    PATTERNS[9][0]: "~",
    **{pattern: "$" for pattern, _ in CURRENCY},
}


def _may_match(text: Column, pattern: str) -> Column | None:
    needed = _NEEDS.get(pattern)
    if needed is None:
        return None
    return F.contains(text, F.lit(needed)) if isinstance(needed, str) else F.regexp_like(text, F.lit("(?U)" + needed.pattern))


def replaced(text: Column, rules) -> Column:
    """The rules applied one after another; classes and word bounds take all of Unicode, as re does."""

    def one(t: Column, rule) -> Column:
        make = lambda x: F.regexp_replace(x, "(?U)" + rule[0], rule[1].replace("$", "\\$"))
        return make(t) if rule[0] not in _NEEDS else bound(t, lambda x: F.when(_may_match(x, rule[0]), make(x)).otherwise(x))

    return reduce(one, rules, text)


def redacted(text: Column) -> Column:
    """All patterns, then amounts of money by range. Later rules see what earlier ones wrote."""
    return replaced(text, (*PATTERNS, *CURRENCY))


def has_personal_data(text: Column) -> Column:
    """Whether one of DETECTORS matches."""
    return reduce(lambda a, b: a | b, (F.regexp_like(text, F.lit("(?U)" + p)) for p in DETECTORS))


def may_have_personal_data(text: Column) -> Column:
    """Cheap and true of all texts of which any part, with its white space joined, has_personal_data."""
    return F.contains(text, F.lit("@")) | F.regexp_like(text, F.lit(r"(?U)\d{3}[-.\s]*\d{4}")) | F.regexp_like(text, F.lit(_NEEDS[PATTERNS[3][0]].pattern))


def fully_redacted(text: Column, spans: Column) -> Column:
    """Spans that a model found, then all patterns over what is left."""
    return redacted(spans_replaced(text, spans))


def spans_replaced(text: Column, spans: Column) -> Column:
    """Spans (array of struct start, end, label; from 0, end exclusive) as [LABEL], last one first."""
    ordered = F.reverse(F.array_sort(spans))

    def one(acc: Column, s: Column) -> Column:
        return F.concat(F.substring(acc, F.lit(1), s["start"]), F.lit("["), F.upper(s["label"]), F.lit("]"), F.substring(acc, s["end"] + 1, F.length(acc)))

    return F.aggregate(ordered, text, one)
