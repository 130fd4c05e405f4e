"""Best-fit packing of tokenised documents into sequences, with three capacities at once.

A document is its ids and the end id; only documents longer than a sequence are cut, into full pieces with the shorter
one first. Pieces are dealt by a hash of id, place and tokens into groups of about ``group_size`` (a long document's pieces to many); in each group, vector best-fit-decreasing
opens bins: a piece is the vector (tokens, 1 document, tokens squared for attention), a bin has a residual of each, and
among the bins with room in every respect the piece goes to that with the least weighted residual norm afterwards
(``rule="norm"``) or the greatest weighted dot product of piece and residual (``rule="dot"``). The groups bound memory
and time of a task; each leaves a few bins less full than one global run would.

Defined cases: a null text is empty, and an empty document is one piece of the end id; repeated rows are packed each;
an empty table gives no rows; pieces of equal length go by id and piece.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, ship
from .tokens import default_path, loaded

SEQUENCE = 2048


def pieces(docs: DataFrame, *, size: int = SEQUENCE, end_id: int = 0, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """A row for each piece: id, piece, start, length, ids_crc32 and, if asked for, ids (little-endian 32-bit)."""
    ship(docs.sparkSession)
    path = tokenizer or default_path()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    end = np.array([end_id], "<u4").tobytes()
    extra = [("ids", pa.binary())] * with_ids
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(n for n, _ in extra)]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *(t for _, t in extra)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = loaded(path)
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                coded = ids.of(text.as_py() or "") + end
                n = len(coded) // 4
                first = n % size or size
                a = 0
                for k, b in enumerate(range(first, n + 1, size)):
                    part = coded[4 * a : 4 * b]
                    for c, x in zip(cols, (doc, k, a, b - a, zlib.crc32(part), part), strict=False):
                        c.append(x)
                    a = b
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def best_fit(lengths: np.ndarray, size: int, max_docs: int, max_attention: float, weights: tuple[float, float, float], rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; lengths must not increase. Capacities count as 1 each in norm and dot product."""
    caps = np.array([size, max_docs, max_attention], float)
    w = np.array(weights, float)
    least = lengths[-1] if len(lengths) else 0
    bins, offsets = np.empty(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room = np.empty((3, 64))  # residuals of the open bins, by column
    names = np.empty(64, np.int64)
    n_open = n_bins = 0
    for i, length in enumerate(lengths.tolist()):
        need = np.array([length, 1.0, float(length) * length])
        if (need > caps).any():
            raise ValueError(f"a piece of {length} tokens does not fit an empty bin")
        best = -1
        if n_open:
            r = room[:, :n_open]
            fits = np.flatnonzero((r[0] >= length) & (r[1] >= 1) & (r[2] >= need[2]))
            if len(fits):
                left = r[:, fits]
                if rule == "dot":
                    best = int(fits[np.argmax((w * need / caps**2) @ left)])
                else:
                    best = int(fits[np.argmin(w @ ((left - need[:, None]) / caps[:, None]) ** 2)])
        if best < 0:
            if n_open == len(names):
                room, names = np.concatenate([room, np.empty_like(room)], axis=1), np.concatenate([names, np.empty_like(names)])
            best, n_open = n_open, n_open + 1
            room[:, best], names[best] = caps, n_bins
            n_bins += 1
        bins[i], offsets[i] = names[best], size - room[0, best]
        room[:, best] -= need
        if room[0, best] < least or room[1, best] < 1 or room[2, best] < float(least) * least:  # no later piece fits
            n_open -= 1
            room[:, best], names[best] = room[:, n_open], names[n_open]
    return bins, offsets


def packed(parts: DataFrame, n_groups: int, *, size: int = SEQUENCE, max_docs: int = SEQUENCE, max_attention: float | None = None, weights: tuple[float, float, float] = (1.0, 0.05, 0.05), rule: str = "norm") -> DataFrame:
    """The pieces with sequence_id and offset."""
    if rule not in ("norm", "dot"):
        raise ValueError("rule is norm or dot")
    most = float(size) * size if max_attention is None else max_attention
    fields = parts.schema.simpleString()[len("struct<") : -1].replace(":", " ")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
        bins, offsets = best_fit(group["length"].to_numpy(), size, max_docs, most, weights, rule)
        number = group["group"].to_numpy().astype("int64")
        return group.drop(columns="group").assign(sequence_id=(number << 32) + bins, offset=offsets)

    salted = parts.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n_groups)))
    return salted.groupBy("group").applyInPandas(run, f"{fields}, sequence_id long, offset long")


def pack(docs: DataFrame, *, size: int = SEQUENCE, group_size: int = 8192, end_id: int = 0, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, **limits) -> DataFrame:
    """pieces() of docs, packed(): a row for each piece with its place in a sequence."""
    n, n_bytes = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(text_col))).first()
    n_groups = max(1, math.ceil((n + (n_bytes or 0) / (4 * size)) / group_size))  # pieces, about: a token has four bytes or so
    return packed(pieces(docs, size=size, end_id=end_id, tokenizer=tokenizer, id_col=id_col, text_col=text_col, with_ids=with_ids), n_groups, size=size, **limits)


def op4(spark, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
