"""Column functions on literal cases."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import redact, text


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("$500", "$100-$999"),
        ("$1234", "$100-$1K-$9K"),
        ("$12345", "$[ZIPCODE]"),
        ("$123456", "$100-$1K-$9K56"),
        ("Dr. Smith called", "[NAME] called"),
        ("i drive home", "i [NAME] home"),
        ("<a.b@c.org>", "[EMAIL]"),
        ("call (555) 123-4567", "call [PHONE]"),
        ("12345-6789", "[ZIPCODE]"),
        ("ask Jane Roe (jroe1) ok", "[NAME_AND_ID] ok"),
        ("JohnSmith", "[NAME]"),
        ("abc12 and abcd12", "[USERID] and abcd12"),
        ("ab123_x9", "[ACCOUNT]"),
        ("dr. o'neil", "[NAME]"),
        ("http://u.edu/~bob", "[URL_USER]"),
        ("1234567890123", "[PHONE]123"),
        ("éabc12 ١٢٣٤٥", "éabc12 [ZIPCODE]"),
        (None, None),
        ("", ""),
    ],
)
def test_redaction(spark, given, want):
    assert one(spark, given, redact.redacted) == want


def test_redaction_equals_re(spark):
    given = "Prof. Xu paid $45 to x.y@z.net, 555-123-4567 or 99999; see www.a.b/~carl, dr who, abc1, ABC1 McDonald"
    want = given
    for pattern, new in (*redact.PATTERNS, *redact.CURRENCY):
        want = re.sub(pattern, new.replace("\\", ""), want)
    assert one(spark, given, redact.redacted) == want


def test_model_spans(spark):
    df = spark.createDataFrame([("Ann met Bob.", [(0, 3, "person"), (8, 11, "person")])], "x string, s array<struct<start:int,end:int,label:string>>")
    assert df.select(redact.spans_replaced(F.col("x"), F.col("s")).alias("y")).first()["y"] == "[PERSON] met [PERSON]."


@pytest.mark.parametrize(("size", "want"), [(0, 0), (1, 1), (512, 1), (513, 2), (912, 2), (913, 3)])
def test_char_chunks(spark, size, want):
    got = one(spark, "x" * size, text.char_chunks)
    assert len(got or []) == want
    if want:
        assert got[-1] == "x" * (size - 400 * (want - 1))


@pytest.mark.parametrize(("n", "want"), [(0, 0), (80, 1), (81, 2), (100, 2), (160, 2), (161, 3)])
def test_word_chunks(spark, n, want):
    got = one(spark, " ".join(f"w{i}" for i in range(n)), text.word_chunks)
    assert len(got or []) == want
    assert all(c.split()[0] == f"w{80 * i}" for i, c in enumerate(got or []))


@pytest.mark.parametrize(("n", "want"), [(0, 0), (512, 1), (513, 2)])
def test_fixed_chunks(spark, n, want):
    assert len(one(spark, "a " * n, lambda x: text.fixed_chunks(text.words(x))) or []) == want


@pytest.mark.parametrize(("given", "want"), [("sd\tpositive\t120", "positive"), ("pubmed", "pubmed"), (None, None)])
def test_label_field(spark, given, want):
    assert one(spark, given, text.label_field) == want


@pytest.mark.parametrize(("given", "want"), [(" label_1 ", "POSITIVE"), ("LABEL_0", "NEGATIVE"), ("neutral", "NEUTRAL"), ("LABEL_7", "LABEL_7")])
def test_sentiment_name(spark, given, want):
    assert one(spark, given, text.sentiment_name) == want


@pytest.mark.parametrize(("given", "want"), [("+", 1), ("False", 0), ("NEG", 0), ("maybe", None), (None, None)])
def test_sentiment_bit(spark, given, want):
    assert one(spark, given, text.sentiment_bit) == want


def test_generated_text_is_cleaned(spark):
    assert one(spark, '<think>a\nb</think> "Hello." This rewrite is short.', text.without_thinking) == "Hello."
    assert one(spark, "user hi assistant fine\nthanks system end", text.first_answer) == "fine\nthanks"
    assert one(spark, '{"text": "Good day"}', text.assistant_part) == "Good day"
    assert one(spark, "What?! No,,, yes..", text.collapsed_marks) == "What! No, yes."


def test_hash_uniform(spark):
    got = spark.range(1).select(text.hash_uniform(F.lit(42), F.lit(7)).alias("u")).first()["u"]
    assert got == pytest.approx(0.46435326454229653, abs=1e-15)


def test_words_of_odd_texts(spark):
    assert one(spark, None, text.words) == []
    assert one(spark, " \t\n\x0b\x0c\r", text.words) == []
    assert one(spark, "\ta  b\x0bc ", text.words) == ["a", "b", "c"]
    assert one(spark, "a b", text.words) == ["a b"]


def test_encoding_pads_and_cuts(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([],)], "t array<long>")
    rows = df.select(*(c.alias(n) for c, n in zip(text.encoded(F.col("t"), 2), "ab", strict=True))).collect()
    assert rows[0]["a"] == [1, 2] and rows[0]["b"] == [1, 2]
    assert rows[1]["a"] == [0, 0] and rows[1]["b"] == [-100, -100]


def test_answers_lose_roles_and_headings(spark):
    assert one(spark, "user: hi ASSISTANT **Solution 2:** Good day", text.assistant_part) == "Good day"
