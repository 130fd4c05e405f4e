"""Quality rules: base counts, and bands of perplexity under an interpolated modified Kneser-Ney trigram model.

The model is counted over every document; all words (A-Z lower-cased) belong to it. Counts are Kneser-Ney continuation counts at every order:
a trigram counts as often as different words stand before it, a bigram as often as different trigrams end in it, a word
as often as different bigrams do. So a text's copies count once, and near copies little more. When a
document is scored, what the model has from that document alone is taken out of every count, context and discount class first.

Documents are encoded in batches, a table in buckets by batch. For each order, batches send the sorted distinct hashes of their n-grams to
ranges of the hash space; a range merges them into sorted hash arrays (the model, stored if asked for), looks every batch's
hashes up there, and answers with the counts. The answer also says which batch is the first to have an n-gram: only that one adds it to
the sums of its context and its suffix, which are the question of the order below. Nothing but the counts of counts reaches the driver.
The ranges of an order are settled in ``PASSES`` parts, one after the other, so that only one part's questions are on disk at a time; the answers
are stored in buckets by batch, too, so that whoever reads them needs no exchange.
The words before a trigram are told apart by ``SKETCH`` bits of their hash, and their number is corrected for the collisions to expect;
numbers beyond some thousands level off.

Each language has a band of log perplexity around its median, in spreads (interquartile range / 1.349), over the
documents that pass the base rules. A document above the upper limit of the highest order is rejected, and so is one below the lower limits of all
orders: of words, pairs and triples that are all too likely. (One with copies is likely under the
higher orders only; that is for the dedup operators.) A language's median and spread are averaged with those of all documents, as if these were ``prior``
documents of the language, so that small languages have a band too.

Defined cases: a null or empty text has no words and fails the base rules; a null language is a language of its own;
rows with one id get a row each; an empty table gives no rows; other columns are not needed; a document of words that no other text has is scored
by the words' number alone.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _STEP, appended, bucketed, distinct, drop, first_places, fresh_worker, grouped, mixed, own_name, read, release, ship, stored, trimmed_worker, window_hashes
from .exchange import PART, batch_number, slices, squeezed, squeezed_sorted, unsqueezed, unsqueezed_sorted

NO_ID = -(2**63)
#: Bits of the hash of a word before a trigram.
SKETCH = 10
#: Stands before the first word of a document.
START = np.uint64(0x5851F42D4C957F2D)
BATCH_CHARS, RANGE_KEYS, BUCKETS = 10_000_000, 1_000_000, 64
#: In how many parts the ranges of an order are settled. Each part reads the batches again.
PASSES = 2
#: Bits of a word's hash.
WORD_BITS = 44
#: What n_symbols counts.
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
ORDER = 3
#: Log perplexity under the orders from 1 on.
LOSSES = ("loss_1", "loss_2", "loss")


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes. Most words of a large corpus are rare: to look each up in a bounded memory costs more than to hash it."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


_BLANK = np.isin(np.arange(256), np.frombuffer(BLANKS.encode(), np.uint8))
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, k: int) -> np.ndarray:
    return x << np.uint64(k) | x >> np.uint64(64 - k)


class Words:
    """The words of some texts (UTF-8), found and hashed by array operations; ``n`` of each text. Hashes are those of ``word_hashes``."""

    #: Words hashed at a time, and bytes from which a word is hashed alone.
    CHUNK, LONG = 100_000, 16

    def __init__(self, texts: list[bytes]):
        self.coded = b"".join((b"\n", b"\n".join(texts), b"\n" * 9))
        blank = _BLANK[np.frombuffer(self.coded, np.uint8)]
        edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        self.starts, self.sizes = edges[::2], edges[1::2] - edges[::2]
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.n = np.diff(np.searchsorted(self.starts, ends + 1), prepend=0)

    def lowered(self) -> np.ndarray:
        """Hashes of all words, A-Z in lower case."""
        coded, n = self.coded.lower(), len(self.starts)  # of bytes: A-Z only
        parts = [self._hashed(coded, self.starts[a : a + self.CHUNK], self.sizes[a : a + self.CHUNK]) for a in range(0, n, self.CHUNK)]
        return np.concatenate(parts) if parts else np.empty(0, np.uint64)

    def written(self, some: np.ndarray) -> np.ndarray:
        """Hashes of some words as they are written."""
        return self._hashed(self.coded, self.starts[some], self.sizes[some])

    def _hashed(self, coded: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """XXH64 of words of one length at a time."""
        data, short = np.frombuffer(coded, np.uint8), np.minimum(sizes, self.LONG).astype(np.uint8)
        four, eight = (np.ndarray(len(data) - 7, t, coded, strides=(1,)) for t in ("<u4", "<u8"))  # from any byte on
        order, ends = np.argsort(short, kind="stable"), np.cumsum(np.bincount(short, minlength=self.LONG + 1)).tolist()
        out = np.empty(len(starts), np.uint64)
        for size in range(1, self.LONG):
            some = order[ends[size - 1] : ends[size]]
            at, left = starts[some], size
            h = np.full(len(some), _P5 + np.uint64(size))
            if left >= 8:
                h ^= _turned(eight[at] * _P2, 31) * _P1
                h = _turned(h, 27) * _P1 + _P4
                at, left = at + 8, left - 8
            if left >= 4:
                h ^= four[at].astype(np.uint64) * _P1
                h = _turned(h, 23) * _P2 + _P3
                at, left = at + 4, left - 4
            for k in range(left):
                h ^= data[at + k].astype(np.uint64) * _P5
                h = _turned(h, 11) * _P1
            h ^= h >> np.uint64(33)
            h *= _P2
            h ^= h >> np.uint64(29)
            h *= _P3
            out[some] = h ^ h >> np.uint64(32)
        some = order[ends[self.LONG - 1] :]
        out[some] = word_hashes([coded[a : a + n] for a, n in zip(starts[some].tolist(), sizes[some].tolist(), strict=True)])
        return out


def text_counts(text: str) -> tuple[int, int, int]:
    """word_chars, n_symbols, n_dup_lines."""
    lines = Counter(text.split("\n"))
    again = sum(c - 1 for line, c in lines.items() if c > 1 and line.strip(BLANKS))
    return len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), again


def _twice(hashes: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Those of the words at these places whose windows of three occur twice or more in their document."""
    windows = mixed((hashes[at] * _STEP + hashes[at + 1]) * _STEP + hashes[at + 2]) ^ mixed(doc[at] + np.uint64(1))
    order = np.sort(windows)
    again = distinct(order[1:][order[1:] == order[:-1]])
    if not len(again):
        return at[:0]
    few = np.zeros(1 << 22, bool)  # by the upper bits: most windows are not among them
    few[again >> np.uint64(42)] = True
    maybe = np.flatnonzero(few[windows >> np.uint64(42)])
    return at[maybe[again[np.searchsorted(again, windows[maybe]).clip(max=len(again) - 1)] == windows[maybe]]]


def repeated_words(hashes: np.ndarray, n_words: np.ndarray, written: Callable[[np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """Of each document the words in windows of three that occur twice or more in it; hashes: of all words, one document after the other.

    With ``written``, which gives the hashes of some words as they are written, hashes may be those in lower case: what is repeated is so in lower case, too.
    """
    doc = np.repeat(np.arange(len(n_words), dtype=np.uint64), n_words)
    at = _twice(hashes, doc, np.flatnonzero(doc[2:] == doc[:-2]))
    if written is not None and len(at):
        some = np.flatnonzero(_covered(at, len(hashes)))
        hashes = hashes.copy()
        hashes[some] = written(some)
        at = _twice(hashes, doc, at)
    return np.bincount(doc[_covered(at, len(hashes))].astype(np.int64), minlength=len(n_words))


def _covered(at: np.ndarray, n: int) -> np.ndarray:
    """Which of n words lie in the windows of three that begin at these."""
    out = np.zeros(n, bool)
    for k in range(3):
        out[at + k] = True
    return out


def packed(*arrays: np.ndarray) -> bytes:
    parts = [squeezed(a) for a in arrays]
    return np.array([len(p) for p in parts], "<u4").tobytes() + b"".join(parts)


def unpacked(data: bytes, *dtypes) -> list[np.ndarray]:
    sizes = np.frombuffer(data[: 4 * len(dtypes)], "<u4").tolist()
    at, out = 4 * len(dtypes), []
    for n, dtype in zip(sizes, dtypes, strict=True):
        out.append(unsqueezed(data[at : at + n], dtype))
        at += n
    return out


def by_frequency(known: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same words (sorted) with the frequent ones first, by powers of two and then by hash, and their new numbers: small numbers compress better."""
    rarity = 64 - np.frexp(np.bincount(tokens, minlength=len(known)))[1]
    order = np.argsort(rarity.astype(np.uint8), kind="stable")
    number = np.empty(len(order), np.int32)
    number[order] = np.arange(len(order), dtype=np.int32)
    return known[order], number[tokens]


def _encoded(rows: DataFrame, batch_chars: int) -> DataFrame:
    """Batches: ids, languages and base counts of their documents, the hashes of their different words, and all words as numbers of those."""

    def run(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        ids, text_keys, langs, counts, texts, held, seq = [], [], [], [], [], 0, 0

        def row() -> pa.RecordBatch:
            words = Words(texts)
            low = words.lowered()
            table = np.column_stack([words.n, np.array(counts, np.int64).reshape(-1, 3), repeated_words(low, words.n, words.written)])
            known, _, tokens = grouped(low >> np.uint64(64 - WORD_BITS), WORD_BITS)
            known, tokens = by_frequency(known, tokens)
            blobs = (squeezed(np.array([ids, text_keys], np.int64).reshape(-1)), PART.join(langs), squeezed(table.reshape(-1)), squeezed_sorted(known), squeezed(tokens))
            return pa.RecordBatch.from_pydict({"batch": [batch_number(seq)]} | dict(zip(("ids", "langs", "counts", "words", "tokens"), ([b] for b in blobs), strict=True)))

        for record in records:
            for doc, lang, value, key in zip(record.column(0).to_pylist(), record.column(1).to_pylist(), record.column(2), record.column(3).to_pylist(), strict=True):
                text = value.as_py()
                text_keys.append(key)
                texts.append(text.encode("utf-8", "surrogatepass"))
                ids.append(doc)
                langs.append(lang.encode("utf-8", "surrogatepass"))
                counts.append(text_counts(text))
                held += len(text)
                if held >= batch_chars:
                    yield row()
                    ids, text_keys, langs, counts, texts, held, seq = [], [], [], [], [], 0, seq + 1
        if ids:
            yield row()

    return rows.mapInArrow(run, "batch long, ids binary, langs binary, counts binary, words binary, tokens binary")


class Grams:
    """The n-grams of a batch as hashes of ``bits`` bits: of each word the one of an order that it ends, and that one's context."""

    def __init__(self, row, bits: int):
        self.bits, self.shift = bits, np.uint64(64 - bits)
        self.n_words = unsqueezed(row["counts"], np.int64)[:: len(COUNTS)]
        self.first = (np.cumsum(self.n_words) - self.n_words)[self.n_words > 0]
        self.words = unsqueezed_sorted(row["words"])[unsqueezed(row["tokens"], np.int32)]
        self._of: dict[int, np.ndarray] = {}
        self._distinct: dict[int, tuple] = {}

    def before(self, x: np.ndarray, start) -> np.ndarray:
        out = np.empty_like(x)
        out[1:] = x[:-1]
        out[self.first] = start
        return out

    def start(self, order: int) -> np.ndarray:
        """The n-gram before a document's first word."""
        h = np.array([START])
        for _ in range(order - 1):
            h = h * _STEP + START
        return mixed(h) >> self.shift

    def of(self, order: int) -> np.ndarray:
        if order not in self._of:
            h, x, step = self.words.copy(), self.words, np.array([_STEP])
            for _ in range(order - 1):
                x = self.before(x, START)
                h += x * step
                step = step * _STEP
            self._of[order] = mixed(h) >> self.shift
        return self._of[order]

    def sketch(self) -> np.ndarray:
        """The word before each trigram of the highest order."""
        x = self.words
        for _ in range(ORDER):
            x = self.before(x, START)
        return mixed(x) >> np.uint64(64 - SKETCH)

    def context(self, order: int) -> np.ndarray:
        return self.before(self.of(order - 1), self.start(order - 1)[0])

    def distinct(self, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The sorted different n-grams and contexts of the order above, the first word that ends each, and the number of each word's n-gram."""
        if order not in self._distinct:
            extra = self.start(order) if order < ORDER else np.empty(0, np.uint64)
            keys, first, number = grouped(np.concatenate([self.of(order), extra]), self.bits)
            self._distinct[order] = keys, first.astype(np.int32), number.astype(np.int32)
        return self._distinct[order]

    def firsts(self, order: int) -> np.ndarray:
        """The second result of ``distinct`` alone."""
        return first_places(np.append(self.of(order), self.start(order)) if order < ORDER else self.of(order), self.bits)

    def forget(self, order: int) -> None:
        self._of.pop(order, None)
        self._distinct.pop(order, None)

    def contexts(self, order: int) -> np.ndarray:
        """The number of each word's context among the distinct ones of the order below."""
        _, _, number = self.distinct(order - 1)
        return self.before(number[: len(self.words)], number[-1])


def places_in(keys: np.ndarray, part: range, n_ranges: int, bits: int) -> np.ndarray:
    """Where keys lie in these ranges, which are those of ``slices``."""
    width = -(-(1 << bits) // n_ranges)
    return np.flatnonzero((keys >= np.uint64(part.start * width)) & (keys < np.uint64(part.stop * width)))


def _rows(batch: int, keys: np.ndarray, payload: Callable[[int, int], bytes], n_ranges: int, bits: int) -> list[tuple]:
    return [(batch, r, squeezed_sorted(keys[a:b]), payload(a, b)) for r, a, b in slices(keys, n_ranges, bits)]


#: Stands for sums that do not fit the byte.
LARGE = 255


def packed_sums(values: list[np.ndarray]) -> bytes:
    """The five sums of n-grams: small ones in one byte. The second one follows from the others unless there are counts of 3 and more."""
    s, t, n1, n2, n3 = values
    code = np.where((s < 16) & (n1 < 8) & (n2 < 2) & (n3 == 0), 16 * s + 2 * n1 + n2, LARGE).astype(np.uint8)
    large = code == LARGE
    return packed(code, s[large], n1[large], n2[large], n3[large], t[n3 > 0])


def unpacked_sums(data: bytes) -> list[np.ndarray]:
    code, *some, totals = unpacked(data, np.uint8, *[np.int64] * SUMS)
    large = code == LARGE
    out = [x.astype(np.int64) for x in (code >> 4, code >> 1 & 7, code & 1, np.zeros(len(code), np.int64))]
    for x, y in zip(out, some, strict=True):
        x[large] = y
    s, n1, n2, n3 = out
    t = n1 + 2 * n2
    t[n3 > 0] = totals
    return [s, t, n1, n2, n3]


ASKED = "batch long, range int, keys binary, payload binary"
ANSWERED = ASKED + ", stats array<long>"
#: Of an n-gram: its count; of it as a context: the sum of the counts that follow, and how many of them are 1, 2, and 3 or more.
SUMS = 5


def _ask_counts(held: DataFrame, n_ranges: int, bits: int, part: range) -> DataFrame:
    """Of each batch the n-grams of the highest order in these ranges, and the different words before each."""

    def run(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in records:
            for row in record.to_pylist():
                g = Grams(row, bits)
                inside = places_in(g.of(ORDER), part, n_ranges, bits)
                pairs = distinct(g.of(ORDER)[inside] << np.uint64(SKETCH) | g.sketch()[inside])
                every = pairs >> np.uint64(SKETCH)
                at = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.empty(0, np.int64)
                keys, ends = every[at], np.append(at, len(every))
                before = (pairs & np.uint64((1 << SKETCH) - 1)).astype(np.uint16)
                out = _rows(row["batch"], keys, lambda a, b, e=ends, x=before: packed(np.diff(e[a : b + 1]).astype(np.int32), x[e[a] : e[b]]), n_ranges, bits)
                cols = zip(*out, strict=True) if out else ([], [], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["batch", "range", "keys", "payload"])

    return held.select("batch", "counts", "words", "tokens").mapInArrow(run, ASKED)


def estimated(seen: np.ndarray) -> np.ndarray:
    """How many different things were hashed to so many different values of SKETCH bits."""
    size = float(1 << SKETCH)
    return np.maximum(seen, np.rint(-size * np.log1p(-np.minimum(seen, size - 0.5) / size))).astype(np.int64)


def _stats(counts: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3 and 4, their sum, and how many there are at all."""
    return [*(int((counts == k).sum()) for k in (1, 2, 3, 4)), int(counts.sum()), int((counts > 0).sum())]


def _merge(asked: DataFrame, n_values: int, with_model: bool) -> DataFrame:
    """Of each range the counts of counts and, if wanted, its part of the model (batch -1 - range; only counts over 1, the others are known by that), and
    each batch's answer, looked up in the sorted array: the sums, and whether the batch is the first to ask."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        trimmed_worker()
        group = group.sort_values("batch", ignore_index=True)
        keys = [unsqueezed_sorted(x) for x in group["keys"]]
        ends = np.cumsum([len(k) for k in keys]).tolist()
        asked_keys = np.concatenate(keys)
        low = asked_keys.min()
        every, firsts, at = grouped(asked_keys - low, int(asked_keys.max() - low).bit_length())
        if n_values == 1:
            many, before = (np.concatenate(x) for x in zip(*(unpacked(x, np.int32, np.uint16) for x in group["payload"]), strict=True))
            pairs = distinct(np.repeat(at, many).astype(np.uint64) << np.uint64(SKETCH) | before)
            values = [estimated(np.bincount((pairs >> np.uint64(SKETCH)).astype(np.int64), minlength=len(every)))]
        else:
            parts = [unpacked_sums(x) for x in group["payload"]]
            values = [_sum(at, np.concatenate([p[i] for p in parts]), len(every)) for i in range(n_values)]
        first = np.zeros(len(asked_keys), np.int8)
        first[firsts] = 1
        made = (lambda v: packed(*v)) if n_values == 1 else packed_sums
        answers = [np.array([len(x := made([v[at[a:b]] for v in values]))], "<u4").tobytes() + x + squeezed(first[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
        some, number = values[0] > 1, int(group["range"].iloc[0])
        part = (squeezed_sorted(every[some] + low), made([v[some] for v in values])) if with_model else (None, None)
        model = pd.DataFrame({"batch": [-1 - number], "range": [number], "keys": [part[0]], "payload": [part[1]], "stats": [_stats(values[0])]})
        return pd.concat([group[["batch", "range"]].assign(keys=None, payload=answers, stats=None), model])

    return asked.groupBy("range").applyInPandas(run, ANSWERED)


def _sum(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.rint(np.bincount(at, values, n)).astype(np.int64)


def _told(answers: pd.DataFrame, n_values: int) -> list[np.ndarray]:
    """A batch's answers in the order of its keys: the sums, and whether it is the first."""
    parts = []
    for x in answers.sort_values("range")["payload"]:
        n = 4 + int.from_bytes(x[:4], "little")
        parts.append([*([unpacked(x[4:n], np.int64)[0]] if n_values == 1 else unpacked_sums(x[4:n])), unsqueezed(x[n:], np.int8)])
    return [np.concatenate([p[i] for p in parts]) if parts else np.empty(0, np.int64) for i in range(n_values + 1)]


def _ask_sums(held: DataFrame, answers: DataFrame, order: int, n_ranges: int, bits: int, part: range) -> DataFrame:
    """What the n-grams of the order above add to their suffixes and contexts in these ranges, from the first batch that has them."""

    def run(rows: pd.DataFrame, answered: pd.DataFrame) -> pd.DataFrame:
        trimmed_worker()
        out: list[tuple] = []
        for row in rows.to_dict("records"):
            g = Grams(row, bits)
            word = g.firsts(order + 1)
            counts, *_, first = _told(answered, 1 if order == ORDER - 1 else SUMS)
            mine = (first == 1) & (counts > 0)
            word, counts = word[mine], counts[mine]
            every = np.append(g.of(order), g.start(order))
            inside = places_in(every, part, n_ranges, bits)
            keys, _, found = grouped(every[inside], bits)
            number = np.full(len(every), -1, np.int32)
            number[inside] = found
            suffix, context = number[word], g.before(number[:-1], number[-1])[word]
            counts, suffix, context = counts[context >= 0], suffix[suffix >= 0], context[context >= 0]
            kind = np.minimum(counts, 3)
            sums = [np.bincount(suffix, minlength=len(keys)), _sum(context, counts, len(keys)), *(np.bincount(context[kind == k], minlength=len(keys)) for k in (1, 2, 3))]
            out += _rows(row["batch"], keys, lambda a, b, s=sums: packed_sums([x[a:b].astype(np.int64) for x in s]), n_ranges, bits)
        return pd.DataFrame(out, columns=["batch", "range", "keys", "payload"])

    return held.select("batch", "counts", "words", "tokens").groupBy("batch").cogroup(answers.groupBy("batch")).applyInPandas(run, ASKED)


def discounts_of(counts: list[int]) -> np.ndarray:
    """Modified Kneser-Ney discounts from the numbers of entries that occur once, twice, three and four times."""
    n1, n2, n3, n4 = (max(1, x) for x in counts)
    y = n1 / (n1 + 2 * n2)
    found = [k - (k + 1) * y * b / a for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return np.array([0.0, *(min(max(d, 0.05), k - 0.05) for k, d in enumerate(found, 1))])


@dataclass
class Model:
    """The numbers that all documents share."""

    discounts: dict[int, np.ndarray]  # by order: of counts 0, 1, 2, 3 and more
    total: int  # sum of the words' counts
    rest: float  # what the discounts leave of it, for each different word


def _model(answers: DataFrame) -> Model:
    sums = answers.where("batch < 0").groupBy("order").agg(*(F.sum(F.get("stats", F.lit(i))).alias(f"s{i}") for i in range(6)))
    stats = {row[0]: [int(x or 0) for x in row[1:]] for row in sums.collect()}  # a row for each order
    stats = {order: stats.get(order, [0] * 6) for order in range(1, ORDER + 1)}
    d = {order: discounts_of(x[:4]) for order, x in stats.items()}
    n1, n2, _, _, total, distinct = stats[1]
    left = d[1][1] * n1 + d[1][2] * n2 + d[1][3] * max(0, distinct - n1 - n2)
    return Model(d, max(1, total), left / max(1, total) / max(1, distinct))


#: Words of the documents that are scored at a time.
CHUNK = 150_000


def losses(g: Grams, told: dict[int, np.ndarray], model: Model) -> list[np.ndarray]:
    """Mean negative log probability of each document's words under the orders from 1 on, without what the model has from the document alone; told: by order, a row of sums for each n-gram."""
    orders, n = range(ORDER, 0, -1), len(g.words)
    sketch = g.sketch().astype(np.uint16)
    contexts = {order: (g.contexts(order), len(g.distinct(order - 1)[0])) for order in orders if order > 1}
    numbers = {order: (g.distinct(order)[2][:n], len(g.distinct(order)[0])) for order in orders}
    for order in orders:
        g.forget(order)
    ends = np.cumsum(g.n_words)
    cuts = [0, *(np.flatnonzero(np.diff(ends // CHUNK)) + 1).tolist(), len(ends)]
    parts = []
    for i, j in zip(cuts, cuts[1:], strict=False):
        a, b = int(ends[i - 1]) if i else 0, int(ends[j - 1]) if j else 0
        parts.append(_losses(g.n_words[i:j], {o: (x[a:b], m) for o, (x, m) in numbers.items()}, {o: (x[a:b], m) for o, (x, m) in contexts.items()}, sketch[a:b], told, model))
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def _losses(n_words: np.ndarray, numbers: dict, contexts: dict, sketch: np.ndarray, told: dict[int, np.ndarray], model: Model) -> list[np.ndarray]:
    """losses of some documents; numbers and contexts: of each word by order, and how many there are."""
    doc = np.repeat(np.arange(len(n_words), dtype=np.uint64), n_words)

    def of_doc(number: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each document and thing the first word that has it, and the number of each word's."""
        _, word, pair = grouped(doc * np.uint64(most) + number.astype(np.uint64), (len(n_words) * most).bit_length())
        return word, pair

    alone: np.ndarray | None = None  # n-grams of the order above that only the document has, by the word that ends them
    seen, unseen, weights = {}, {}, {}
    for order in range(ORDER, 0, -1):
        number, most = numbers[order]
        word, pair = of_doc(number, most)
        if order == ORDER:
            own = np.bincount((distinct(pair.astype(np.uint64) << np.uint64(SKETCH) | sketch) >> np.uint64(SKETCH)).astype(np.int64), minlength=len(word))
        else:
            own = np.bincount(pair[alone], minlength=len(word))
        count = told[order][number[word], 0]
        rest = np.maximum(count - own, 0)
        alone = word[rest == 0]
        seen[order] = np.maximum(rest - model.discounts[order][np.minimum(rest, 3)], 0)[pair]
        if order == 1:
            break
        at, most = contexts[order]
        some, context = of_doc(at, most)
        of = context[word]
        _, total, *kinds = told[order - 1].take(at[some], axis=0).T
        total = total - np.bincount(of, count - rest, len(some))
        left = np.zeros(len(some))
        for k, many in zip((1, 2, 3), kinds, strict=True):
            left += model.discounts[order][k] * (many - np.bincount(of[np.minimum(count, 3) == k], minlength=len(some)) + np.bincount(of[np.minimum(rest, 3) == k], minlength=len(some)))
        with np.errstate(invalid="ignore", divide="ignore"):
            unseen[order] = np.where(total > 0, np.clip(left / np.maximum(total, 1), 0, 1), 1.0)[context]
            weights[order] = np.where(total > 0, 1 / np.maximum(total, 1), 0.0)[context]
    ends, out = np.cumsum(n_words), []
    p = seen[1] / model.total + model.rest
    for order in range(1, ORDER + 1):
        if order > 1:
            p = seen[order] * weights[order] + unseen[order] * p
        sums = np.append(0.0, np.cumsum(np.log(p)))
        with np.errstate(invalid="ignore", divide="ignore"):
            out.append(np.where(n_words > 0, -(sums[ends] - sums[ends - n_words]) / n_words, np.nan))
    return out


def _by_row(sums: list[np.ndarray]) -> np.ndarray:
    """A row for each n-gram, so that to look one up touches one place; in half the room if the sums fit."""
    return np.column_stack([x.astype(np.int32) for x in sums] if all(x.max(initial=0) < 1 << 31 for x in sums) else sums)


def _scored(held: DataFrame, answers: DataFrame, model: Model, bits: int) -> DataFrame:
    """A row for each document: base counts and mean negative log probability of its words (null without words)."""

    def run(rows: pd.DataFrame, answered: pd.DataFrame) -> pd.DataFrame:
        trimmed_worker()
        out = []
        for r in rows.to_dict("records"):
            g = Grams(r, bits)
            told = {order: _by_row(_told(answered[answered["order"] == order], 1 if order == ORDER else SUMS)[:-1]) for order in range(1, ORDER + 1)}
            counts = unsqueezed(r["counts"], np.int64).reshape(-1, len(COUNTS))
            langs = [x.decode("utf-8", "surrogatepass") for x in r["langs"].split(PART)]
            ids, text_keys = unsqueezed(r["ids"], np.int64).reshape(2, -1)
            out.append(pd.DataFrame({"id": ids, "text_key": text_keys, "lang": langs} | {c: counts[:, i] for i, c in enumerate(COUNTS)} | dict(zip(LOSSES, losses(g, told, model), strict=True))))
        return pd.concat(out) if out else pd.DataFrame(columns=["id", "text_key", "lang", *COUNTS, *LOSSES])

    every = answers.where("batch >= 0").select("batch", "order", "range", "payload")
    return held.groupBy("batch").cogroup(every.groupBy("batch")).applyInPandas(run, "id long, text_key long, lang string, " + ", ".join(f"{c} long" for c in COUNTS) + "".join(f", {x} double" for x in LOSSES))


def _answers(held: DataFrame, n_buckets: int, n_ranges: int, bits: int, with_model: bool) -> DataFrame:
    """(order, and as of ``_merge``) of all orders, in buckets by batch as held."""
    spark, out = held.sparkSession, None
    for order in range(ORDER, 0, -1):
        told = None if order == ORDER else out.where(f"batch >= 0 AND order = {order + 1}").select("batch", "range", "payload")
        parts = [range(k * n_ranges // PASSES, (k + 1) * n_ranges // PASSES) for k in range(PASSES)]
        for part in filter(len, parts):
            asked = _ask_counts(held, n_ranges, bits, part) if told is None else _ask_sums(held, told, order, n_ranges, bits, part)
            rows = _merge(asked, 1 if told is None else SUMS, with_model).repartition("batch").withColumn("order", F.lit(order))
            out = bucketed(rows, "answers", "batch", n_buckets) if out is None else appended(out, rows, "batch", n_buckets)
            del asked, rows
            release(spark)
    return out


def scores(docs: DataFrame, *, batch_chars: int = BATCH_CHARS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", with_model: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """Base counts and loss (log perplexity) of each document, and the model (order, range, sorted keys, their values) if wanted.

    A task holds batch_chars characters of documents at a time, in about 40 bytes each; fewer make the exchange's rows smaller and its files larger.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("\0")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("text_key", F.xxhash64("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(BUCKETS, math.ceil(total / batch_chars / 4))
    held = bucketed(_encoded(rows, batch_chars), "encoded", "batch", n_buckets)
    most = max(1, total // 6)  # distinct n-grams, about: a word and a blank are 6 bytes or more
    n_ranges, bits = math.ceil(most / RANGE_KEYS), min(60, max(34, math.ceil(math.log2(most)) + 7))
    answers = _answers(held, n_buckets, n_ranges, bits, with_model)
    found = stored(_scored(held, answers, _model(answers), bits), "losses")
    drop(held)
    model = stored(answers.where("batch < 0").select("order", "range", "keys", "payload"), "model") if with_model else None
    drop(answers)
    return found, model


def _judged(docs: DataFrame, *, below: float = 4.0, above: float = 4.0, least_words: int = 50, repeat_percent: int = 50, prior: int = 50, **options) -> DataFrame:
    found, _ = scores(docs, with_model=False, **options)
    found = found.withColumn("base_failed", (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words")))
    fair = found.where(~F.col("base_failed"))
    quarters = [F.percentile_approx(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 10_000) for x in LOSSES]
    of_all = fair.agg(*(q.alias(f"all_{x}") for q, x in zip(quarters, LOSSES, strict=True)))
    of_lang = fair.groupBy("lang").agg(*(q.alias(f"q_{x}") for q, x in zip(quarters, LOSSES, strict=True)), F.count(F.lit(1)).alias("n_fair")).crossJoin(F.broadcast(of_all))  # of_all is one row
    at = lambda x, i: (F.col("n_fair") * F.get(f"q_{x}", F.lit(i)) + prior * F.get(f"all_{x}", F.lit(i))) / (F.col("n_fair") + prior)
    limit = lambda x, k: at(x, 1) + k * (at(x, 2) - at(x, 0)) / 1.349
    bands = stored(of_lang.select("lang", limit("loss", above).alias("high"), *(limit(x, -below).alias(f"low_{x}") for x in LOSSES)), "bands")
    known = found.join(bands, "lang", "left")
    likely = F.greatest(*((F.col(x) - F.col(f"low_{x}")) for x in LOSSES)) < 0
    kept = ~F.col("base_failed") & F.coalesce((F.col("loss") <= F.col("high")) & ~likely, F.lit(False))
    null = lambda x: F.when(~F.isnan(x), F.col(x)).alias(x)
    return known.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "text_key", *COUNTS, "base_failed", kept.alias("kept"), F.when(F.col("lang") != "\0", F.col("lang")).alias("lang"), *map(null, LOSSES), "high", *(f"low_{x}" for x in LOSSES))


def judged(docs: DataFrame, **options) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, lang, the losses and the limits of their bands, for each row; options as of ``scores``, and of the bands."""
    return _judged(docs, **options).drop("text_key")


def passing(docs: DataFrame, **options) -> DataFrame:
    """docs without the rejected rows. Rows are told apart by id, language and text, which decide the verdict."""
    id_col, text_col, lang_col = (options.get(k, d) for k, d in (("id_col", "doc_id"), ("text_col", "text"), ("lang_col", "lang")))
    names = [own_name(docs, f"_{x}") for x in ("rejected", "key", "of")]
    gone = _judged(docs, **options).where(~F.col("kept")).select(F.col("doc_id").alias(names[0]), F.col("text_key").alias(names[1]), F.col("lang").alias(names[2])).distinct()
    same = (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col(names[1])) & F.col(id_col).cast("long").eqNullSafe(F.col(names[0])) & F.col(lang_col).cast("string").eqNullSafe(F.col(names[2]))
    return docs.join(gone, same, "left_anti")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(read(spark, sf_dir, "documents"))
