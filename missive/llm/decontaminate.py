"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over every document.

Benchmark items are cut into windows of ``window`` words (an item of fewer words is one window). Their words are numbered,
and the windows' hashes are broadcast, sorted by length, each with its place among the items' words. A document's words become
the same numbers, its windows' hashes are looked up, hits are verified word by word, and hit words are marked.

One broadcast holds the items of ``block_bytes`` bytes of text at most (about 12 times that in a worker: 16 bytes a window, the numbers, and
the items' vocabulary). A larger benchmark is dealt into such blocks; they are broadcast one after the other, and what a block
has hit is stored before the next one, so that no worker and not the driver ever holds two. Nothing is left out.

Defined cases: a null text has no words, so nothing is hit; an item without words has no window; repeated items count once
by id; repeated documents are treated row by row; an empty benchmark leaves everything clean; other columns pass through; a very
long document is a row like any other; a very long item is dealt in parts that overlap by a window less a word.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import distinct, drop, mixed, own_name, remembered, ship, stored, window_hashes

#: Lower-cases A-Z and turns every other ASCII character that is no letter or digit into a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: The same words with their places in the text.
_PLACES = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Text of benchmark items that one broadcast holds.
BLOCK_BYTES = 4_000_000


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class Windows:
    """The windows of some items: for each length the different ones, by their sorted hashes, each with one place among the items' word numbers, and the further items of those that several items have."""

    def __init__(self, items: list[tuple[object, str | None]], window: int):
        self.number: dict[bytes, int] = {}
        self.items = [str(i) for i, _ in items]
        coded = [np.array([self.number.setdefault(w, len(self.number)) for w in words_of(t)], np.int32) for _, t in items]
        self.flat = np.concatenate([*coded, np.empty(0, np.int32)])
        by: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.ends = np.cumsum([len(x) for x in coded], dtype=np.int64)
        for x, end in zip(coded, self.ends.tolist(), strict=True):
            if n := min(window, len(x)):
                h = window_hashes(_spread(x), n)
                by.setdefault(n, []).append((h, np.arange(end - len(x), end - len(x) + len(h), dtype=np.int64)))
        self.sorted: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for n, parts in sorted(by.items()):
            h, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            self.sorted[n] = self._distinct(n, h, at)

    def _of(self, places: np.ndarray) -> np.ndarray:
        """The items of places."""
        return np.searchsorted(self.ends, places, "right")

    def _distinct(self, n: int, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hash and place of each different window; the numbers of those that several items have, where each one's items begin, and these items."""
        order = np.argsort(h, kind="stable")
        h, at = h[order], at[order]
        group, left, groups = np.full(len(h), -1, np.int64), np.arange(len(h)), 0
        places: list[np.ndarray] = []
        while len(left):  # once, and again for windows that only share a hash
            new = np.r_[True, h[left][1:] != h[left][:-1]]
            first = left[new]
            number = np.cumsum(new) - 1
            same = self._equal(at[left], at[first][number], n)
            group[left[same]] = groups + number[same]
            places.append(first)
            groups += len(first)
            left = left[~same]
        first = np.concatenate(places)
        rank = np.argsort(h[first], kind="stable")
        place_of = np.empty(groups, np.int64)
        place_of[rank] = np.arange(groups)
        pairs = np.unique(place_of[group] * len(self.items) + self._of(at))
        of, counts = np.unique(pairs // len(self.items), return_counts=True)
        pairs = pairs[np.repeat(counts > 1, counts)]
        begins = np.r_[0, np.cumsum(counts[counts > 1])]
        return h[first][rank], at[first][rank].astype(np.int32), of[counts > 1].astype(np.int32), begins.astype(np.int32), (pairs % len(self.items)).astype(np.int32)

    def _equal(self, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
        out = np.ones(len(a), bool)
        for j in range(n):
            out &= self.flat[a + j] == self.flat[b + j]
        return out

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words are hit, and the ids of the items. A window's items are named once, however often the text has it."""
        hit, items = np.zeros(len(words), bool), np.zeros(len(self.items), bool)
        coded = np.fromiter(map(self.number.get, words, repeat(-1)), np.int32, len(words))
        spread = _spread(coded)
        for n, (hashes, places, shared, begins, named) in self.sorted.items():
            h = window_hashes(spread, n)
            if not len(h):
                continue
            k = np.searchsorted(hashes, h)
            p = np.flatnonzero(hashes[np.minimum(k, len(hashes) - 1)] == h)
            k = k[p]
            while len(p):  # once, and again where different windows share a hash
                equal = np.ones(len(p), bool)
                for j in range(n):
                    equal &= self.flat[places[k] + j] == coded[p + j]
                for j in range(n):
                    hit[p[equal] + j] = True
                met = distinct(k[equal])
                items[self._of(places[met])] = True
                for g in np.flatnonzero(np.isin(shared, met)).tolist() if len(shared) and len(met) else ():
                    items[named[begins[g] : begins[g + 1]]] = True
                k = k + 1
                more = (k < len(hashes)) & ~equal
                more[more] = hashes[k[more]] == h[p[more]]
                p, k = p[more], k[more]
        return hit, {self.items[i] for i in np.flatnonzero(items).tolist()}


def _spread(coded: np.ndarray) -> np.ndarray:
    return mixed(coded.astype(np.uint64) + np.uint64(1))


def spans_of(hit: np.ndarray) -> list[int]:
    """Begin and end of each run of hit words, one after the other."""
    return np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))).tolist()


def without_spans(text: str, spans: list[int]) -> str:
    """text without the words of spans (begins and ends) and what stands between them."""
    places = [m.span() for m in _PLACES.finditer(text)]
    kept, at = [], 0
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        kept.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return "".join([*kept, text[at:]])


def _scanned(docs: DataFrame, windows, at: int, names: list[str]) -> DataFrame:
    """docs with the columns names (number of words, spans, items), or those columns with the hits of more windows."""
    kinds = [T.LongType(), T.ArrayType(T.LongType()), T.ArrayType(T.StringType())]
    more = names[0] in docs.columns
    schema = docs.schema if more else T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in zip(names, kinds, strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered("windows", dict)
        w = windows.value
        for batch in batches:
            cols: list[list] = [[], [], []]
            before = zip(batch.column(names[1]).to_pylist(), batch.column(names[2]).to_pylist(), strict=True) if more else repeat(([], []))
            for value, (spans, items) in zip(batch.column(at), before, strict=False):
                words = words_of(value.as_py())
                hit, named = w.scan(words)
                for a, b in zip(spans[::2], spans[1::2], strict=True):
                    hit[a:b] = True
                for c, x in zip(cols, (len(words), spans_of(hit), sorted({*named, *items})), strict=True):
                    c.append(x)
            made = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string())), strict=True)]
            kept = batch.columns[: len(batch.columns) - 3] if more else batch.columns
            yield pa.RecordBatch.from_arrays([*kept, *made], names=schema.names)

    return docs.mapInArrow(run, schema)


def _parts(text: Column, window: int, part_words: int) -> Column:
    """A long text in parts of so many words that overlap by a window less a word, so that each window is whole in one of them; others as they are."""
    words = F.filter(F.split(text, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", -1), lambda w: w != "")
    cut = F.get(F.transform(F.array(words), lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - window, F.lit(0)), F.lit(part_words)), lambda i: F.array_join(F.slice(w, i + 1, F.lit(part_words + window - 1)), " "))), 0)
    return F.when(F.octet_length(text) > part_words, cut).otherwise(F.array(text))


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_bytes: int, part_words: int) -> Iterator:
    """Broadcasts of the items' windows, one after the other, each of a bounded part of the items.

    Different parts of items are dealt by a hash of id and text, so neither a long item nor an id of many rows makes a block large.
    """
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(id_col).alias("item"), F.explode(_parts(F.col(text_col), window, part_words)).alias("text")).where("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) if n > 1 else items
        yield spark.sparkContext.broadcast(Windows([(r.item, r.text) for r in part.collect()], window)), k == n - 1


def _hits(docs: DataFrame, benchmark: DataFrame, names: list[str], at: int, window: int, item_col: str, item_text_col: str, block_bytes: int, part_words: int) -> tuple[DataFrame, object]:
    """docs with the columns names, after all blocks; and the windows if there is one block only."""
    found, windows = docs, None
    for windows, last in _blocks(benchmark, item_col, item_text_col, window, block_bytes, part_words):
        before, found = found, _scanned(found, windows, at, names)
        if not last:
            found = stored(found, "scanned")
        if before is not docs and not last:
            drop(before)
        if not last:
            windows.unpersist()
    return found, windows if found is not docs and before is docs else None


def scan(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES, part_words: int = 20_000, clean: bool = False) -> DataFrame:
    """docs with n_words, n_hit, items (ids as sorted strings) and, if clean, cleaned: the text without hit spans, removed again until no window occurs."""
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)
    names = [own_name(docs, x) for x in ("n_words", "n_hit", "items")]
    spans = names[1]
    how = (window, item_col, item_text_col, block_bytes, part_words)
    found, windows = _hits(docs, benchmark, names, at, *how)
    n_hit = F.aggregate(F.transform(F.col(spans), lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, b: a + b)
    counts = [*(F.col(f"`{c}`") for c in docs.columns), F.col(names[0]), n_hit.alias(spans), F.col(names[2])]
    if not clean:
        return found.select(*counts)
    cleaned = own_name(docs, "cleaned")
    if windows is not None:
        return _cut(found, spans, at, cleaned, windows).select(*counts, cleaned)
    clean_text = _cut(found, spans, at, cleaned, None)  # many blocks: what was cut is scanned again by all of them
    done = stored(clean_text.select(*counts, cleaned), "cut")
    again = own_name(done, "_again")
    open_ = done.withColumn(again, F.col(spans) > 0)
    while not open_.where(F.col(again)).isEmpty():
        rest = [own_name(open_, f"_{x}") for x in ("words", "spans", "items")]
        left = stored(open_.where(F.col(again)), "again")
        hits, _ = _hits(left, benchmark, rest, left.columns.index(cleaned), *how)
        text = own_name(hits, "_text")
        cut = _cut(hits, rest[1], hits.columns.index(cleaned), text, None)
        cut = cut.select(*(F.col(text).alias(c) if c == cleaned else (F.size(rest[1]) > 0).alias(c) if c == again else F.col(f"`{c}`") for c in open_.columns))
        new = stored(open_.where(~F.col(again)).unionByName(cut), "cut")
        drop(left, open_)
        open_ = new
    return open_.drop(again)


def _cut(rows: DataFrame, spans: str, at: int, name: str, windows) -> DataFrame:
    """rows with the text without its spans; with windows, scanned and cut again until they occur no more."""
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = windows.value if windows is not None else None
        for batch in batches:
            out = []
            for value, found in zip(batch.column(at), batch.column(spans).to_pylist(), strict=True):
                text = value.as_py()
                while found:
                    text = without_spans(text, found)
                    found = spans_of(w.scan(words_of(text))[0]) if w is not None else None
                out.append(text)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, drop_share: float = 0.5, **options) -> DataFrame:
    """docs without hit spans, and without the documents of whose words at least drop_share are hit."""
    found = scan(docs, benchmark, window=window, clean=True, **options)
    n_words, n_hit, _, cleaned = found.columns[len(docs.columns) :]
    text_col = options.get("text_col", "text")
    kept = found.where((F.col(n_hit) == 0) | (F.col(n_hit) < drop_share * F.col(n_words)))
    return kept.select(*(F.col(cleaned).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))


def op3(spark, sf_dir: str) -> DataFrame:
    from .common import read

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, w[p : p + least(10, len(w)) - 1] AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
dp AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM d),
hits AS (
  SELECT dp.r, dp.p, iw.n, iw.item_id FROM dp JOIN (SELECT DISTINCT n FROM iw) k ON dp.p + k.n - 1 <= len(dp.w)
  JOIN iw ON iw.n = k.n AND iw.win = dp.w[dp.p : dp.p + k.n - 1]),
n_hit AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hits) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n_hit USING (r) LEFT JOIN its USING (r)
"""
