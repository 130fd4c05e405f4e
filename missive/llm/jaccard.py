"""N-gram Jaccard join: near-duplicate documents by their sets of word shingles, exactly.

1. Documents with the same set are one class; only its smallest id goes on.
2. The document frequency of every shingle comes from one exchange (``exchange``). It orders a set's shingles, rare
   first, and parts them into a rare class and a frequent one (``frequent`` documents and more).
3. A set of n shingles can lack e = n - ceil(t n) of them in a partner. Rare shingles are indexed singly, frequent ones
   as 2-combinations inside m small hash classes. With a rare ones and b_c of class c in the prefix, two similar sets
   share a signature once a + sum(max(b_c - 1, 0)) > e; the prefix is extended until that holds. m follows from
   the band of n; similar sets lie in the same band or in neighbouring ones, so each set signs for its band and the one below.
4. A set of which less than the similarity is in other classes has no partner. The others that signatures join make
   families; each is settled as a whole (``linking``), its sets compared with one hub after the other until the ones not
   yet compared lie in one component. Groups of thousands of copies cost a few tests a copy, and no link is lost.

Defined cases: a null or empty text has no shingles and is linked with nothing (its component is its own id); a text with
fewer words than a shingle is one shingle; rows with one id count as one document; a null id gets no component; an
empty table gives no rows; other columns are not needed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, distinct, drop, grouped, mixed, own_name, read, remembered, ship, stored, trimmed_worker, window_hashes
from .exchange import PART, answered, ask, batches, integer_ids, squeezed, tally, unsqueezed
from .linking import linked

#: Stands for a null id inside batches.
NO_ID = -(2**63)
#: Characters of a batch, and shingles of a range of the hash space, about.
BATCH_CHARS, RANGE_KEYS = 1_500_000, 750_000
#: A shingle of so many documents is of the frequent class.
FREQUENT = 24


def _hashes() -> WordHashes:
    """One to a worker, so that common words are hashed once."""
    return remembered("shingle words", WordHashes)


def needed(n: int, percent: int) -> int:
    """The least overlap of a set of n with any partner."""
    return -(-n * percent // 100)


def shingle_sets(texts: list[bytes], hashes: WordHashes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and where each begins (and the last ends)."""
    out, at = [], [0]
    for text in texts:
        h = hashes.of(text.split())
        if len(h) >= n:
            s = distinct(window_hashes(h, n))
        elif len(h):
            s = window_hashes(h, len(h)) ^ np.uint64(len(h))
        else:
            s = np.empty(0, np.uint64)
        out.append(s)
        at.append(at[-1] + len(s))
    return (np.concatenate(out) if out else np.empty(0, np.uint64)), np.array(at)


def _texts(row) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(row["blob"]).split(PART)


def _batches(docs: DataFrame, n: int) -> DataFrame:
    def encode(ids: list[int], texts: list[str]) -> dict[str, object]:
        low = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
        every, at = shingle_sets(low, _hashes(), n)
        classes = b"".join(xxhash.xxh3_128_digest(every[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True))
        blob = zstandard.ZstdCompressor(level=3).compress(PART.join(low))
        return {"blob": blob, "ids": np.array(ids, np.int64).tobytes(), "sizes": np.diff(at).astype(np.int64).tobytes(), "classes": classes}

    return batches(docs, encode, "batch long, blob binary, ids binary, sizes binary, classes binary", BATCH_CHARS)


def _members(held: DataFrame) -> DataFrame:
    """A row for each document: batch, place in it, id, set size, class of equal sets."""

    def run(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in records:
            for row in record.to_pylist():
                ids, sizes = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["sizes"], np.int64)
                classes = pa.array([row["classes"][i : i + 16] for i in range(0, len(row["classes"]), 16)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), row["batch"])), pa.array(np.arange(len(ids), dtype=np.int32)), pa.array(ids, mask=ids == NO_ID), pa.array(sizes), classes], names=["batch", "place", "id", "size", "class"])

    return held.select("batch", "ids", "sizes", "classes").mapInArrow(run, "batch long, place int, id long, size long, class binary")


def band(n: int, percent: int) -> int:
    """Sizes of similar sets lie in the same band or in neighbouring ones."""
    return int(math.log(n) / math.log(100 / percent) + 1e-9)


def n_classes(band_: int, percent: int) -> int:
    """Hash classes of the frequent shingles: about three to a class in a prefix of the band's smallest sets."""
    return max(1, int((100 / percent) ** band_ * (100 - percent) / 100 / 2))


def signatures(tokens: np.ndarray, df: np.ndarray, percent: int, frequent: int, copies: int = 1) -> np.ndarray:
    """Signature hashes of a set; tokens in rising hash order with their document frequencies. Only tokens of more documents than the set's copies sign."""
    n = len(tokens)
    lacks = n - needed(n, percent)
    order = np.lexsort((tokens, df))
    tokens, df = tokens[order], df[order]
    rare = int(np.searchsorted(df, frequent))
    single = tokens[: min(rare, lacks + 1)]
    out = [mixed(single[df[: len(single)] > copies] ^ np.uint64(0x51))]
    if rare <= lacks:
        often = tokens[rare:]
        for b in {band(n, percent), band(n, percent) - 1}:
            m = n_classes(b, percent)
            c = (mixed(often) % np.uint64(m)).astype(np.int64)
            seen_before = pd.Series(c).groupby(c).cumcount().to_numpy()
            reached = rare + np.cumsum(seen_before > 0)
            enough = int(np.searchsorted(reached, lacks + 1)) + 1 if len(reached) else 0
            elsewhere = df[rare : rare + enough] > copies
            part, group = often[:enough][elsewhere], c[:enough][elsewhere]
            by = np.lexsort((part, group))
            part, group = part[by], group[by]
            for gap in range(1, int(np.bincount(group).max(initial=0))):
                same = np.flatnonzero(group[gap:] == group[:-gap])
                out.append(mixed(mixed(part[same] + np.uint64(b + 2)) ^ part[same + gap]))
    return distinct(np.concatenate(out))


def _profiles(held: DataFrame, totals: DataFrame, reps: DataFrame, n: int, percent: int, frequent: int, bits: int) -> DataFrame:
    """(id, size, own, signatures, shingles) of the class representatives that have a signature; own: shingles that only the class has."""
    shift = np.uint64(64 - bits)

    def run(row: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        trimmed_worker()
        out: list[tuple] = []
        for r in row.to_dict("records"):
            copies = unsqueezed(b"".join(answers.loc[answers["range"] < 0, "totals"]), np.int64)  # by place, 0 for all but representatives
            every, at = shingle_sets(_texts(r), _hashes(), n)
            keys, _, where = grouped(every >> shift, bits)
            df = answered(answers[answers["range"] >= 0])[where] if len(keys) else np.empty(0, np.int64)
            ids = np.frombuffer(r["ids"], np.int64)
            for i in np.flatnonzero(copies).tolist():
                a, b = int(at[i]), int(at[i + 1])
                own = int((df[a:b] <= copies[i]).sum())
                if b - a > 1 and len(s := signatures(every[a:b], df[a:b], percent, frequent, int(copies[i]))):
                    out.append((ids[i], b - a, own, s.view(np.int64), squeezed(every[a:b])))
        return pd.DataFrame(out, columns=["id", "size", "own", "signatures", "shingles"])

    marks = reps.groupBy("batch").agg(F.collect_list("place").alias("places"), F.collect_list("copies").alias("copies"))

    def flags(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in records:
            flags_of = []
            for places, copies in zip(record.column(1).to_pylist(), record.column(2).to_pylist(), strict=True):
                flag = np.zeros(max(places) + 1, np.int64)
                flag[places] = copies
                flags_of.append(squeezed(flag))
            yield pa.RecordBatch.from_arrays([record.column(0), pa.array([-1] * len(flags_of), pa.int32()), pa.array(flags_of, pa.binary())], names=["batch", "range", "totals"])

    answers = totals.unionByName(marks.mapInArrow(flags, "batch long, range int, totals binary"))
    return held.select("batch", "blob", "ids").groupBy("batch").cogroup(answers.groupBy("batch")).applyInPandas(run, "id long, size long, own long, signatures array<long>, shingles binary")


def overlaps(owners_of: np.ndarray, sizes: np.ndarray):
    """f(x, ys): how many values the sets x and ys have in common; the sets' values stand end to end."""
    n, at = len(sizes), np.append(0, np.cumsum(sizes))
    keys, where = np.unique(owners_of, return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)[np.argsort(where, kind="stable")]
    times = np.bincount(where, minlength=len(keys))
    start = np.cumsum(times) - times

    def count(x: int, ys: np.ndarray) -> np.ndarray:
        values = where[at[x] : at[x + 1]]
        many = times[values]
        every = np.repeat(start[values] - np.cumsum(many) + many, many) + np.arange(many.sum())
        return np.bincount(owner[every], minlength=n)[ys]

    return count


def similar(percent: int):
    """The test of a block of sets (linking): which sets have the similarity or more."""

    def prepared(rows: dict[str, np.ndarray]):
        sets = [unsqueezed(x, np.uint64) for x in rows["shingles"]]
        sizes = np.array([len(x) for x in sets])
        common = overlaps(np.concatenate(sets), sizes)

        def test(x: int, ys: np.ndarray) -> np.ndarray:
            same = common(x, ys)
            return ys[100 * same >= percent * (sizes[x] + sizes[ys] - same)]

        return test

    return prepared


def near_duplicates(docs: DataFrame, *, n: int = 5, percent: int = 80, frequent: int = FREQUENT, most: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the least id that links reach) of each row."""
    ship(docs.sparkSession)
    rows = integer_ids(docs, id_col, text_col, NO_ID)
    held = stored(_batches(rows, n), "batches")
    members = stored(_members(held), "members")
    total = members.agg(F.sum("size")).first()[0] or 0
    n_ranges, bits = max(1, math.ceil(total / RANGE_KEYS)), min(64, max(32, math.ceil(math.log2(total + 1)) + 6))
    classes = members.where("size > 0 and id is not null").groupBy("class").agg(F.min(F.struct("id", "batch", "place")).alias("rep"), F.count(F.lit(1)).alias("copies")).select("class", "rep.*", "copies")
    classes = stored(classes, "classes")
    shift = np.uint64(64 - bits)

    def counted(row: dict) -> tuple[np.ndarray, np.ndarray]:
        keys, _, number = grouped(shingle_sets(_texts(row), _hashes(), n)[0] >> shift, bits)
        return keys, np.bincount(number, minlength=len(keys))

    totals = stored(tally(ask(held.select("batch", "blob"), counted, n_ranges, bits)), "totals")
    profiles = stored(_profiles(held, totals, classes.select("batch", "place", "copies"), n, percent, frequent, bits), "profiles")
    some = 100 * (F.col("size") - F.col("own")) >= percent * F.col("size")  # else not even a subset without own shingles is similar
    roots = linked(profiles.where(some).withColumn("bytes", F.octet_length("shingles")), ["shingles"], similar(percent), **({"most": most} if most else {}))
    drop(totals, held)
    known = classes.select("class", "id").join(roots, "id", "left").select("class", F.coalesce("root", "id").alias("root"))
    out = members.join(known, "class", "left")
    return out.select(F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), F.when(F.col("size") == 0, F.col("id")).otherwise(F.col("root")).alias("component_id"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs with the row of the smallest id of each group of near-duplicates."""
    id_col, gone = options.get("id_col", "doc_id"), own_name(docs, "_gone")
    found = near_duplicates(docs, **options).where(F.col("component_id") < F.col("doc_id")).select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(found, F.col(id_col) == F.col(gone), "left_anti")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, hash(w[p : p + least(5, len(w)) - 1]) AS t
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS p FROM d WHERE len(w) > 0)),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b USING (t) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM pairs JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.a, r.root FROM r JOIN e ON e.b = r.id)
SELECT d.doc_id, coalesce(c.n, 0) AS n_shingles, m.component_id
FROM d LEFT JOIN c USING (doc_id) JOIN (SELECT id AS doc_id, min(root) AS component_id FROM r GROUP BY id) m USING (doc_id)
"""
