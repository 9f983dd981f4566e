"""SentencePiece byte-pair encoding and decoding by vectorised merge rounds.

The model file is parsed here (pieces, scores, kinds); no tokenizer library runs on the main path.
A text is its UTF-8 bytes with U+2581 for spaces and one before the text. No piece of such a model
holds U+2581 after another character, so merges never cross the place before a run of U+2581, and a
text falls into words that can be encoded apart and, within a block of documents, once each.

Words are cut further where no piece holds the two characters on both sides, as no merge crosses
such a place either; so a long text without spaces falls into short parts. All words of a block lie
in one flat array of symbols. In a round, each word finds its pair of least rank (segmented minimum);
all occurrences of it are merged at once from the left, up to the first at which the merged piece
makes a pair of still lesser rank with a neighbour, as that merge must come first. Arrays are compacted until no pair is left. What is no piece then is
spelled in byte pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import sized
from tessera.llm.text import blocks, number_hashes, utf8

NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MARK = "▁"


def _fields(raw: bytes):
    """(number, value) of each field of a protocol buffer message."""

    def varint(at):
        value = shift = 0
        while True:
            b = raw[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    at = 0
    while at < len(raw):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = raw[at : at + size], at + size
        else:
            size, at = varint(at)
            value, at = raw[at : at + size], at + size
        yield tag >> 3, value


def _pair(a, b):
    return a << 21 | b


def _within(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys a sorted table holds."""
    if not len(table):
        return np.zeros(len(keys), bool)
    return table[np.minimum(np.searchsorted(table, keys), len(table) - 1)] == keys


class PieceModel:
    """A byte-pair model with byte fallback, identity normaliser and dummy prefix."""

    def __init__(self, raw: bytes):
        self.pieces, scores, kinds = [], [], []
        for number, value in _fields(raw):
            if number == 1:
                entry = dict(_fields(value))
                self.pieces.append(entry[1].decode())
                scores.append(np.frombuffer(entry.get(2, b"\0" * 4), "<f4")[0])
                kinds.append(entry.get(3, NORMAL))
            elif number == 3:
                spec = dict(_fields(value))
                if spec.get(1, b"identity") != b"identity" or spec.get(3, 1) != 1 or spec.get(4, 1) != 0 or spec.get(5, 1) != 1:
                    raise ValueError("only identity normalisation with a dummy prefix is supported")
        self.kinds = np.array(kinds)
        if (self.kinds == USER).any() or (self.kinds == UNUSED).any():
            raise ValueError("user-defined and unused pieces are not supported")
        normal = np.flatnonzero(self.kinds == NORMAL)
        if any(MARK in self.pieces[i].lstrip(MARK) for i in normal):
            raise ValueError("a piece crosses words")
        self.byte_ids = np.zeros(256, np.int64)
        for i in np.flatnonzero(self.kinds == BYTE):
            self.byte_ids[int(self.pieces[i][3:5], 16)] = i
        # rank: higher scores first, smaller ids first among equal ones
        rank = np.empty(len(normal), np.int64)
        rank[np.lexsort((normal, -np.array(scores)[normal]))] = np.arange(len(normal))
        rank_of = {self.pieces[i]: int(r) for i, r in zip(normal, rank, strict=True)}
        self.id_of_rank = np.empty(len(normal), np.int64)
        self.id_of_rank[rank] = normal
        # symbols: first all pieces by rank, then characters that are no piece (numbered by code point)
        single = {p: r for p, r in rank_of.items() if len(p) == 1}
        self.of_char = np.arange(0x110000, dtype=np.int64) + len(normal)
        for c, r in single.items():
            self.of_char[ord(c)] = r
        lefts, rights, made = [], [], []
        first = np.zeros(len(normal), bool)
        for piece, r in rank_of.items():
            for k in range(1, len(piece)):
                a, b = rank_of.get(piece[:k]), rank_of.get(piece[k:])
                # either part may also be a lone character that is no piece of its own
                a = a if a is not None else (int(self.of_char[ord(piece[0])]) if k == 1 else None)
                b = b if b is not None else (int(self.of_char[ord(piece[-1])]) if k == len(piece) - 1 else None)
                if a is not None and b is not None:
                    lefts.append(a)
                    rights.append(b)
                    made.append(r)
                    for x in (a, b):
                        if x < len(normal) and x > r:
                            first[x] = True
        self.may_yield = first
        # characters that stand side by side in some piece, the pairs that are pieces, and threes
        pieces = [[ord(c) for c in p] for p in rank_of]
        self.beside = np.unique(np.array([_pair(a, b) for p in pieces for a, b in zip(p, p[1:], strict=False)], np.int64))
        self.pairs = np.unique(np.array([_pair(*p) for p in pieces if len(p) == 2], np.int64))
        self.threes = np.unique(np.array([_pair(a, b) << 21 | c for p in pieces for a, b, c in zip(p, p[1:], p[2:], strict=False)], np.int64))
        # open-addressed table of pairs
        self.bits = int(np.ceil(np.log2(len(made) * 4)))
        keys = np.array(lefts, np.int64) << 32 | np.array(rights, np.int64)
        self.table, self.value = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, 1 << 30, np.int64)
        self.probes = 0
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.table[slot[left]] < 0
            at, k = np.unique(slot[left[free]], return_index=True)
            won = left[free][k]
            self.table[at], self.value[at] = keys[won], np.array(made)[won]
            left = np.setdiff1d(left, won)
            slot[left] = slot[left] + 1 & (1 << self.bits) - 1
            self.probes += 1
        encoded = [b"" if k in (CONTROL, UNKNOWN) else bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode() for p, k in zip(self.pieces, kinds, strict=True)]
        self.size = np.array([len(x) for x in encoded])
        self.at = np.r_[0, np.cumsum(self.size)]
        self.bytes = np.frombuffer(b"".join(encoded), np.uint8)
        self.begin, self.end = 1, 2

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        return (h * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the piece that each pair makes; 2^30 if none."""
        keys = left << 32 | right
        slot = self._slot(keys)
        got = self.table[slot]
        out = np.where(got == keys, self.value[slot], 1 << 30)
        open_ = np.flatnonzero((got != keys) & (got >= 0))
        while len(open_):
            slot[open_] = slot[open_] + 1 & (1 << self.bits) - 1
            got = self.table[slot[open_]]
            hit = got == keys[open_]
            out[open_[hit]] = self.value[slot[open_[hit]]]
            open_ = open_[~hit & (got >= 0)]
        return out

    def cuts(self, text: np.ndarray) -> np.ndarray:
        """True where no piece holds a character and the one before it, between the same neighbours."""
        before, after = text[:-1], text[1:]
        pair = _pair(before, after)
        cross = _within(self.beside, pair)
        at = np.flatnonzero(cross)
        # a piece across that place is the two characters or holds a third beside them
        three = np.r_[False, _within(self.threes, pair[:-1] << 21 | after[1:]), False] if len(pair) else np.zeros(1, bool)
        cross[at] = _within(self.pairs, pair[at]) | three[at] | three[at + 1]
        return np.r_[True, ~cross]

    def _before_lesser(self, symbols: np.ndarray, word: np.ndarray, rank: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which merges at `at` come before any that a merged piece starts with a neighbour."""
        take = np.ones(len(at), bool)
        doubt = np.flatnonzero(self.may_yield[rank[at]])
        if len(doubt):
            here = at[doubt]
            made, w = rank[here], word[here]
            # the symbol on the left may be a piece that was just merged
            left = symbols[np.maximum(here - 1, 0)]
            joined = np.r_[False, (here[1:] == here[:-1] + 2) & (w[1:] == w[:-1])]
            left = np.where(joined, made, left)
            has_left, has_right = (here > 0) & (word[np.maximum(here - 1, 0)] == w), here + 2 < len(symbols)
            right_at = np.minimum(here + 2, len(symbols) - 1)
            has_right &= word[right_at] == w
            lesser = (has_left & (self.ranks(left, made) < made)) | (has_right & (self.ranks(made, symbols[right_at]) < made))
            begin = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
            earlier = np.cumsum(lesser) - lesser
            take[doubt] = earlier == np.repeat(earlier[begin], np.diff(np.r_[begin, len(w)]))
        return take

    def merge(self, symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of words that begin at `first` (none is empty), merged until no pair is left; and their words."""
        word = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(symbols)]))
        done_s, done_w, done_p = [], [], []
        place = np.arange(len(symbols))
        none = 1 << 30
        rank = np.full(len(symbols), none)
        if len(symbols) > 1:
            rank[:-1] = np.where(word[1:] == word[:-1], self.ranks(symbols[:-1], symbols[1:]), none)
        while len(symbols):
            begin = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            size = np.diff(np.r_[begin, len(symbols)])
            least = np.minimum.reduceat(rank, begin)
            over = np.repeat(least == none, size)
            if over.any():
                done_s.append(symbols[over])
                done_w.append(word[over])
                done_p.append(place[over])
                stay = ~over
                symbols, word, place, rank = symbols[stay], word[stay], place[stay], rank[stay]
                least, size = least[least != none], size[least != none]
                if not len(symbols):
                    break
            hit = rank == np.repeat(least, size)
            at = np.flatnonzero(hit)
            w = word[at]
            new = np.r_[True, w[1:] != w[:-1]]
            run = np.r_[True, (at[1:] != at[:-1] + 1) | new[1:]]
            start = np.flatnonzero(run)
            odd = (np.arange(len(at)) - np.repeat(start, np.diff(np.r_[start, len(at)]))) & 1
            at = at[odd == 0]
            at = at[self._before_lesser(symbols, word, rank, at)]
            symbols[at] = rank[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            moved = np.zeros(len(symbols), bool)
            moved[at] = True
            symbols, word, place, rank, moved = symbols[keep], word[keep], place[keep], rank[keep], moved[keep]
            # pairs to the right and to the left of what was merged are new
            anew = moved.copy()
            anew[:-1] |= moved[1:]
            at = np.flatnonzero(anew)
            rank[at] = none
            at = at[at + 1 < len(symbols)]
            at = at[word[at] == word[at + 1]]
            rank[at] = self.ranks(symbols[at], symbols[at + 1])
        if not done_s:
            return symbols, word
        order = np.argsort(np.concatenate(done_p), kind="stable")
        return np.concatenate(done_s)[order], np.concatenate(done_w)[order]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (UTF-8 bytes with offsets) with begin and end, and their offsets."""
        n = len(offsets) - 1
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        chars = _code_points(data, lead)
        doc = np.searchsorted(offsets, lead, "right") - 1
        per = np.bincount(doc, minlength=n)
        full = per > 0
        # one dummy mark before each text that is not empty
        first = np.r_[0, np.cumsum(per + full)]
        text = np.empty(first[-1], np.int64)
        spread = np.arange(len(chars)) + np.cumsum(full)[doc] if len(chars) else np.empty(0, np.int64)
        text[first[:-1][full]] = 0x2581
        chars[chars == 32] = 0x2581
        text[spread] = chars
        mark = text == 0x2581
        begin = mark.copy()
        begin[1:] &= ~mark[:-1]
        begin[first[:-1][full]] = True
        begin |= self.cuts(text) & ~(mark & np.r_[False, mark[:-1]])
        start = np.flatnonzero(begin)
        if not len(start):
            out = np.tile([self.begin, self.end], n)
            return out, np.arange(0, 2 * n + 1, 2)
        end = np.r_[start[1:], len(text)]
        h = number_hashes(text, start, end)
        _, one, which = np.unique(h, return_index=True, return_inverse=True)
        size = (end - start)[one]
        at = np.repeat(start[one] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        symbols, word = self.merge(self.of_char[text[at]], np.r_[0, np.cumsum(size)[:-1]])
        ids, word = self._spell(symbols, word)
        count = np.bincount(word, minlength=len(one))
        where = np.r_[0, np.cumsum(count)]
        # each document: begin, the ids of its words, end
        words_of = np.searchsorted(first, start, "right") - 1
        lengths = count[which]
        total = np.bincount(words_of, lengths, n).astype(np.int64) + 2
        out_first = np.r_[0, np.cumsum(total)]
        out = np.empty(out_first[-1], np.int64)
        out[out_first[:-1]], out[out_first[1:] - 1] = self.begin, self.end
        steps = np.arange(lengths.sum()) - np.repeat(np.r_[0, np.cumsum(lengths)[:-1]], lengths)
        source = np.repeat(where[which], lengths) + steps
        inner = np.ones(len(out), bool)
        inner[out_first[:-1]], inner[out_first[1:] - 1] = False, False
        out[inner] = ids[source]
        return out, out_first

    def _spell(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of symbols; characters that are no piece become byte pieces."""
        m = len(self.id_of_rank)
        odd = np.flatnonzero(symbols >= m)
        if not len(odd):
            return self.id_of_rank[symbols], word
        spelled = [chr(c).encode("utf-8", "surrogatepass") for c in symbols[odd] - m]
        times = np.ones(len(symbols), np.int64)
        times[odd] = [len(x) for x in spelled]
        out = np.repeat(np.where(symbols < m, self.id_of_rank[np.minimum(symbols, m - 1)], 0), times)
        out[np.repeat(symbols >= m, times)] = self.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]
        return out, np.repeat(word, times)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the texts of ids, and their offsets: marks are spaces, the first one goes."""
        size = self.size[ids]
        ends = np.r_[0, np.cumsum(size)]
        out = self.bytes[np.repeat(self.at[ids] - ends[:-1], size) + np.arange(ends[-1])]
        bounds = ends[offsets]
        # the dummy prefix: the mark that begins the first piece that is not control
        head = bounds[:-1][(bounds[1:] > bounds[:-1])]
        first_piece = np.searchsorted(ends, head, "right") - 1
        lead = head[(out[head] == 32) & (self.kinds[ids[first_piece]] == NORMAL)]
        keep = np.ones(len(out), bool)
        keep[lead] = False
        kept = np.r_[0, np.cumsum(keep)]
        return out[keep], kept[bounds]


def _code_points(data: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """The characters of valid UTF-8 whose first bytes are at `lead`."""
    b = data[lead].astype(np.int64)
    out = b.copy()
    for size, low, mask in ((2, 0xC0, 0x1F), (3, 0xE0, 0x0F), (4, 0xF0, 0x07)):
        at = np.flatnonzero((b >= low) & (b < {2: 0xE0, 3: 0xF0, 4: 0xF8}[size]))
        if len(at):
            c = b[at] & mask
            for k in range(1, size):
                c = c << 6 | data[lead[at] + k] & 0x3F
            out[at] = c
    return out


def piece_codec(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """doc_id, ids (with begin and end) and decoded text of each row of `docs`.

    With `digests`, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers) and
    decoded_sha256 instead of the arrays and texts. Null and empty texts have the two ids begin and
    end and decode to an empty text. Repeated rows stay. The model file (under 1 MB) is sent to the
    executors with the job; `model_path` is read on the driver only.
    """
    spark = docs.sparkSession
    sized(spark)
    with open(model_path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _parsed(shared.value)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for lo, hi in blocks(offsets):
                base, n = offsets[lo], hi - lo
                ids, first = model.encode(data[base : offsets[hi]], offsets[lo : hi + 1] - base)
                text, bounds = model.decode(ids, first)
                own = batch.column(0).slice(lo, n)
                if digests:
                    raw, plain = ids.astype("<u4").tobytes(), text.tobytes()
                    sha = lambda x: hashlib.sha256(x).hexdigest()
                    yield pa.RecordBatch.from_arrays(
                        [own, pa.array(np.diff(first)), pa.array([sha(raw[4 * a : 4 * b]) for a, b in zip(first[:-1], first[1:], strict=True)], pa.string()), pa.array([sha(plain[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.string())],
                        ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                    )
                else:
                    texts = pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(text.tobytes())])
                    yield pa.RecordBatch.from_arrays([own, pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32))), texts], ["doc_id", "ids", "decoded"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, ids array<int>, decoded string"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


@lru_cache(2)
def _parsed(raw: bytes) -> PieceModel:
    return PieceModel(raw)
