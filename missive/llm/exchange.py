"""Corpus-wide counts of hashed features, brought back to the documents that hold them.

Documents are kept as ``batches``: a row holds some documents in compressed form. Each batch sends the sorted hashes of
its features once, with its own counts, to the ranges of the hash space (``ask``); a range adds up what all batches
sent and answers each with the totals in the order of its question (``tally``). A feature that every document has thus
travels once a batch, not once a document, and no range can be hot. Questions and answers are byte-plane
arrays under zstandard: about two bytes a feature and less than one a total.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import grouped, trimmed_worker

#: Parts documents inside a blob; UTF-8 has no such byte.
PART = b"\xff"
QUESTION = "batch long, range int, keys binary, counts binary"


def squeezed(a: np.ndarray, level: int = 1) -> bytes:
    """An array as compressed byte planes."""
    return zstandard.ZstdCompressor(level=level).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()) if len(a) else b""


def unsqueezed(data: bytes, dtype) -> np.ndarray:
    if not data:
        return np.empty(0, dtype)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(dtype)


def squeezed_sorted(a: np.ndarray) -> bytes:
    return squeezed(np.diff(a, prepend=a.dtype.type(0)))


def unsqueezed_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unsqueezed(data, np.uint64), dtype=np.uint64)


def batch_number(seq: int) -> int:
    """Unique among the batches of one job, the same when a task runs again."""
    return (TaskContext.get().partitionId() << 32) | seq


def batches(docs: DataFrame, encode: Callable[[list[int], list[str]], dict[str, object]], schema: str, size: int) -> DataFrame:
    """Rows of encode(ids, texts) for runs of documents with about size characters; docs: (id long, text), a null id is the least long."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trimmed_worker()
        ids, texts, held, seq = [], [], 0, 0

        def row() -> pa.RecordBatch:
            made = {"batch": batch_number(seq)} | encode(ids, texts)
            return pa.RecordBatch.from_pydict({n: pa.array([made[n]], pa.binary() if isinstance(made[n], bytes) else pa.int64()) for n in names})

        for record in records:
            for doc, value in zip(record.column(0).to_pylist(), record.column(1), strict=True):
                text = value.as_py()
                ids.append(doc)
                texts.append(text)
                held += len(text)
                if held >= size:
                    yield row()
                    ids, texts, held, seq = [], [], 0, seq + 1
        if ids:
            yield row()

    return docs.mapInArrow(run, schema)


def ask(stored: DataFrame, features: Callable[[dict], tuple[np.ndarray, np.ndarray | None]], n_ranges: int, bits: int) -> DataFrame:
    """(batch, range, keys, counts) of each batch; features: a batch row -> sorted distinct keys below 2**bits, and counts (None: 1 each)."""

    def run(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in records:
            trimmed_worker()
            for row in record.to_pylist():
                out = questions(row["batch"], *features(row), n_ranges, bits)
                cols = zip(*out, strict=True) if out else ([], [], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["batch", "range", "keys", "counts"])

    return stored.mapInArrow(run, QUESTION)


def questions(batch: int, keys: np.ndarray, counts: np.ndarray | None, n_ranges: int, bits: int) -> list[tuple]:
    """The rows of ``ask`` for one batch."""
    return [(batch, r, squeezed_sorted(keys[a:b]), b"" if counts is None else squeezed(counts[a:b].astype(np.int64))) for r, a, b in slices(keys, n_ranges, bits)]


def slices(keys: np.ndarray, n_ranges: int, bits: int) -> list[tuple[int, int, int]]:
    """(range, from, to) of the ranges that have keys."""
    width = -(-(1 << bits) // n_ranges)
    cut = np.searchsorted(keys, np.arange(1, n_ranges, dtype=np.uint64) * np.uint64(width))
    at = np.concatenate(([0], cut, [len(keys)]))
    return [(r, int(at[r]), int(at[r + 1])) for r in np.flatnonzero(np.diff(at)).tolist()]


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All distinct keys, their summed counts, and where each given key went."""
    flat = np.concatenate(keys)
    low = flat.min() if len(flat) else np.uint64(0)
    every, _, where = grouped(flat - low, int(flat.max() - low).bit_length() if len(flat) else 1)
    every += low
    return every, np.bincount(where, np.concatenate(counts), len(every)).astype(np.int64), where


def tally(asked: DataFrame) -> DataFrame:
    """(batch, range, totals): each batch's keys' counts over all batches, in their order (compressed)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        trimmed_worker()
        keys = [unsqueezed_sorted(x) for x in group["keys"]]
        counts = [unsqueezed(x, np.int64) if x else np.ones(len(k), np.int64) for x, k in zip(group["counts"], keys, strict=True)]
        _, totals, where = merged(keys, counts)
        answers = totals[where]
        cut = np.cumsum([len(k) for k in keys])[:-1]
        return group[["batch", "range"]].assign(totals=[squeezed(x) for x in np.split(answers, cut)])

    return asked.groupBy("range").applyInPandas(run, "batch long, range int, totals binary")


def answered(rows: pd.DataFrame) -> np.ndarray:
    """A batch's totals in the order of its keys."""
    parts = [unsqueezed(x, np.int64) for x in rows.sort_values("range")["totals"]]
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def integer_ids(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(least)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
