"""Toxicity by a weighted lexicon, matched by Aho-Corasick in folded text.

Folding maps homoglyphs and digit substitutions to Latin letters, letters to lower case and other
marks to single spaces. Terms are words or beginnings of words with a weight, the log ratio of the
shares of toxic and other documents that hold them. At each place the longest term counts; terms
inside an exception phrase don't. The sum of weights, dampened for
repeats and normalised by length, and the number of
different terms become a probability by a logistic curve. Terms, exception phrases and the curve are
learnt from labelled documents; more of them can be given.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from zlib import crc32

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import crf
from tessera.llm.labelled import labelled_sample
from tessera.llm.shared import sized

_SAME = dict(
    zip(
        "0134578@$€£¡|" + "аеорсухкмтвнізѕјԁгьбАЕОРСУХКМТВНІЅЈ" + "αβεικνορτυχωΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" + "ıɑɡ",
        "oieastbaselil" + "aeopcyxkmtbhizsjdrbbaeopcyxkmtbhisj" + "abeiknoptuxwabezhikmnoptyx" + "iag",
        strict=True,
    )
)


class _Fold(dict):
    """Translation table that is filled as characters are met."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if c not in _SAME:
            wide = unicodedata.normalize("NFKC", c)
            c = wide if len(wide) == 1 else c
        c = _SAME.get(c, c).lower()
        c = c if c.isalpha() else "" if unicodedata.category(c[0]) in ("Mn", "Cf") else " "
        self[code] = c
        return c


_FOLD = _Fold()


def fold(text: str) -> str:
    """Words of folded letters with one space before, between and after them."""
    return f" {' '.join(text.translate(_FOLD).split())} "


class Lexicon:
    """Terms with weights and exception phrases, as one automaton, and a logistic curve."""

    def __init__(self, terms: dict[str, float], exceptions: Iterable[str] = ()):
        self.terms, self.exceptions, self.curve = dict(terms), sorted(set(exceptions)), np.zeros(4)
        self.automaton = ahocorasick.Automaton()
        for term, weight in self.terms.items():
            if term.strip():
                self.automaton.add_word(term, (len(term), weight, term))
        for phrase in self.exceptions:
            if phrase.strip():
                self.automaton.add_word(phrase, (len(phrase), None, phrase))
        if len(self.automaton):
            self.automaton.make_automaton()

    def features(self, text: str) -> tuple[float, float, float]:
        """Weight per square root of hundreds of words, different terms, greatest weight; of a whole text."""
        folded = fold(text)
        size = max(1.0, folded.count(" ") - 1)
        if not len(self.automaton):
            return 0.0, 0.0, 0.0
        longest: dict[int, tuple[int, float, str]] = {}
        spared: list[tuple[int, int]] = []
        for end, (n, weight, term) in self.automaton.iter(folded):
            start = end + 1 - n
            if weight is None:
                spared.append((start, end))
            elif start not in longest or longest[start][0] < n:
                longest[start] = (n, weight, term)
        if spared:
            longest = {s: x for s, x in longest.items() if not any(a <= s and s + x[0] - 1 <= b for a, b in spared)}
        if not longest:
            return 0.0, 0.0, 0.0
        # a term said over and over counts little more than once
        total = sum(self.terms[t] * (1 + np.log(k)) for t, k in Counter(x[2] for x in longest.values()).items())
        return min(20.0, total / (1 + size / 100) ** 0.5), np.log1p(len({x[2] for x in longest.values()})), max(x[1] for x in longest.values())

    def scores(self, texts: list[str]) -> np.ndarray:
        return crf.sigmoid(np.array([self.features(t) for t in texts]).reshape(-1, 3) @ self.curve[:3] + self.curve[3])


def _apart(texts: list[str]) -> list[int]:
    """Places of texts of which no earlier one is likely a near copy, by the least hash of their runs of three words."""
    seen, out = set(), []
    for i, text in enumerate(texts):
        words = text.split()
        key = min((crc32(" ".join(words[k : k + 3]).encode()) for k in range(max(1, len(words) - 2))), default=0)
        if key not in seen:
            seen.add(key)
            out.append(i)
    return out


def fit_lexicon(texts: list[str], labels: list[int], terms: dict[str, float] | None = None, exceptions: Iterable[str] = (), least: int = 4, share: float = 0.01, ratio: float = 3.0, shortest: int = 4, longest: int = 9) -> Lexicon:
    """Learns terms, exception phrases and the curve; without texts only what is given is matched.

    A term must be in `least` toxic documents, and in a `share` of them, and have a log ratio of `ratio`; a beginning of words
    goes if a shorter one is as good. An exception is a pair of words with a term that `least` other
    documents hold and no toxic one.
    """
    folded = [fold(t) for t in texts]
    # near copies would pass their own words off as signs
    chosen = _apart(folded)
    texts, labels, folded = [texts[i] for i in chosen], [labels[i] for i in chosen], [folded[i] for i in chosen]
    seen = [Counter(), Counter()]
    for text, y in zip(folded, labels, strict=True):
        own = set()
        for word in set(text.split()):
            own.add(f" {word} ")
            own.update(f" {word[:k]}" for k in range(shortest, min(longest, len(word)) + 1))
        seen[y].update(own)
    n = [max(1, sum(y == k for y in labels)) for k in (0, 1)]
    weigh = lambda t: float(np.log((seen[1][t] + 0.5) / (n[1] + 1)) - np.log((seen[0][t] + 0.5) / (n[0] + 1)))
    found = {t: w for t, c in seen[1].items() if c >= max(least, share * n[1]) and (w := weigh(t)) >= ratio}
    for term in sorted(found, key=len, reverse=True):
        stem = term.rstrip()
        if any(found.get(stem[:k], -1) >= found[term] - 0.3 for k in range(shortest + 1, len(term))):
            del found[term]
    found = dict(sorted(found.items()))
    found |= {fold(t) if t.endswith(" ") else fold(t).rstrip(): w for t, w in (terms or {}).items()}
    plain, pairs = Lexicon(found), [Counter(), Counter()]
    for text, y in zip(folded, labels, strict=True):
        if len(plain.automaton):
            words = text.split()
            bad = {w for w in set(words) if any(True for _ in plain.automaton.iter(f" {w} "))}
            pairs[y].update({f" {a} {b} " for a, b in zip(words, words[1:], strict=False) if a in bad or b in bad} if bad else ())
    spared = {p for p, c in pairs[0].items() if c >= least and not pairs[1][p]}
    lexicon = Lexicon(found, {*spared, *map(fold, exceptions)})
    if texts:
        x = np.array([lexicon.features(t) for t in texts]).reshape(-1, 3)
        lexicon.curve = crf.logistic(x, np.array(labels, float))
    else:
        lexicon.curve = np.array([0.5, 1.0, 0.5, -3.0])
    return lexicon


def toxicity(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", fit_rows: int = 8000, cut: float = 0.3, terms: dict[str, float] | None = None, exceptions: Iterable[str] = ()) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of `docs`, repeated rows included.

    score is the probability of label 1; null and empty texts hold no term and are scored as such.
    Fitted on at most `fit_rows` labelled rows outside the fold `held_out`, which may use the id
    only (null: in the training fold); without any, only given terms count. Texts are read whole.
    """
    sized(docs.sparkSession)
    lexicon = fit_lexicon(*labelled_sample(docs, labels, label, held_out, fit_rows, id_col, text_col), terms, tuple(exceptions))
    shared = docs.sparkSession.sparkContext.broadcast((lexicon.terms, lexicon.exceptions, lexicon.curve))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, exceptions, curve = shared.value
        own = Lexicon(terms, exceptions)
        own.curve = curve
        for batch in batches:
            score = own.scores([x.as_py() or "" for x in batch.column(2)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array((score >= cut).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
