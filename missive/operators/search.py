"""Search for many values anywhere in many lines: a filter of the values, and rolling hashes of the lines' stretches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..llm.common import ship

#: Values of more bytes are searched by their first so many.
LONG = 32
#: Bytes of lines that are searched at a time.
AT_ONCE = 1 << 20
#: Bits of the filter of values: so many a value, in all from 2**20 to 2**27; and the tests of a value.
FILTER_BITS, LEAST_BITS, MOST_BITS = 32, 20, 27
TESTS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
#: Base of the hash of a stretch of bytes, and its inverse modulo 2**64.
BASE = 0xD1342543DE82EF95
INVERSE = pow(BASE, -1, 1 << 64)
#: The filter is made in parts of 2**17 bits.
PART_BITS = 17


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Stretches:
    """Hashes of all stretches of a length in some bytes: two operations a byte for each length."""

    def __init__(self, data: bytes):
        n = len(data)
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum((np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)) * _powers(BASE, n), dtype=np.uint64, out=sums[1:])
        self.sums, self.inverse = sums, _powers(INVERSE, n)

    def of(self, size: int, at: np.ndarray | None = None) -> np.ndarray:
        """At all places, or at those given."""
        if at is not None:
            return (self.sums[at + size] - self.sums[at]) * self.inverse[at]
        return (self.sums[size:] - self.sums[:-size]) * self.inverse[: max(0, len(self.sums) - size)]


def _places(hashes: np.ndarray, test: np.uint64, bits: int) -> np.ndarray:
    return (hashes * test) >> np.uint64(64 - bits)


def _passing(hashes: np.ndarray, marks: np.ndarray, bits: int) -> np.ndarray:
    """The numbers of the hashes that pass all tests; each test looks at what passed the one before."""
    left: np.ndarray | None = None
    for test in TESTS:
        at = _places(hashes if left is None else hashes[left], test, bits)
        passed = np.flatnonzero(marks[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1))
        left = passed if left is None else left[passed]
    return left


def _marked(values: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of the values (bytes), and of the first LONG bytes of longer ones; 16 MB at most, whatever the number of values."""
    part_bits = min(PART_BITS, bits)

    def places(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in records:
            given = record.column(0).to_pylist()
            given += [v[:LONG] for v in given if len(v) > LONG]
            sizes = np.fromiter(map(len, given), np.int64, len(given))
            data, starts = Stretches(b"".join(given)), np.cumsum(sizes) - sizes
            hashes = (data.sums[starts + sizes] - data.sums[starts]) * data.inverse[starts]
            at = np.sort(np.concatenate([_places(hashes, test, bits) for test in TESTS]))
            parts = at >> np.uint64(part_bits)
            cuts = np.flatnonzero(np.append(True, parts[1:] != parts[:-1])) if len(at) else np.empty(0, np.int64)
            inside = (at & np.uint64((1 << part_bits) - 1)).astype("<u4")
            yield pa.RecordBatch.from_arrays([pa.array(parts[cuts].astype(np.int32)), pa.array([x.tobytes() for x in np.split(inside, cuts[1:])] if len(cuts) else [], pa.binary())], names=["part", "places"])

    def merged(group: pd.DataFrame) -> pd.DataFrame:
        marks = np.zeros(1 << part_bits, np.uint8)
        for x in group["places"]:
            marks[np.frombuffer(x, "<u4")] = 1
        return pd.DataFrame({"part": group["part"].iloc[:1], "marks": [np.packbits(marks, bitorder="little").tobytes()]})

    out = np.zeros(1 << (bits - 3), np.uint8)
    width = 1 << (part_bits - 3)
    for r in values.mapInArrow(places, "part int, places binary").groupBy("part").applyInPandas(merged, "part int, marks binary").collect():
        out[r.part * width : (r.part + 1) * width] = np.frombuffer(r.marks, np.uint8)
    return out


def _cut(lines: list[bytes], longest: int) -> Iterator[list[bytes]]:
    """Lines in runs of about AT_ONCE bytes; a longer line in parts that share so many bytes that no value is cut by all."""
    run, held = [], 0
    for line in lines:
        for a in range(0, max(1, len(line)), AT_ONCE):
            part = line if len(line) <= AT_ONCE else line[a : a + AT_ONCE + longest - 1]
            run.append(part)
            held += len(part)
            if held >= AT_ONCE:
                yield run
                run, held = [], 0
    if run:
        yield run


def _found(lines: list[bytes], sizes: list[int], marks: np.ndarray, bits: int) -> Iterator[bytes]:
    """The different stretches of the lines that have a value's length and pass the filter."""
    data = b"".join(lines)
    many = np.fromiter(map(len, lines), np.int64, len(lines))
    left = np.repeat(np.cumsum(many), many) - np.arange(len(data))  # bytes to the end of the line
    stretches = Stretches(data)
    long = [k for k in sizes if k > LONG]
    for size in [k for k in sizes if k < LONG or k == LONG and not long] + [LONG] * bool(long):
        at = _passing(stretches.of(size), marks, bits)
        at = at[left[at] >= size]
        if size <= 8:  # a stretch is a number, and short ones are found again and again
            number = np.zeros(len(at), np.uint64)
            for k in range(size):
                number = number << np.uint64(8) | np.frombuffer(data, np.uint8)[at + k].astype(np.uint64)
            at = at[np.unique(number, return_index=True)[1]]
        if size < LONG or LONG in sizes:
            yield from {data[i : i + size] for i in at.tolist()}
        for k in long if size == LONG else ():
            whole = at[left[at] >= k]
            yield from {data[i : i + k] for i in whole[_passing(stretches.of(k, whole), marks, bits)].tolist()}


def stretches(values: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """What gives of lines (one column of bytes) the stretches that may be one of the values (one column of bytes, distinct, none empty): _found, with repeats."""
    spark, (name,) = values.sparkSession, values.columns
    ship(spark)
    of_size = {r["size"]: r["n"] for r in values.groupBy(F.octet_length(name).alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()}  # as many rows as lengths
    sizes, bits = sorted(of_size), min(MOST_BITS, max(LEAST_BITS, (FILTER_BITS * sum(of_size.values())).bit_length()))
    marks = spark.sparkContext.broadcast(_marked(values, bits))

    def search(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in records:
            lines = [x for x in record.column(0).to_pylist() if x]
            for run in _cut(lines, sizes[-1]) if sizes else ():
                yield pa.RecordBatch.from_arrays([pa.array(list(_found(run, sizes, marks.value, bits)), pa.binary())], names=["_found"])

    return lambda lines: lines.mapInArrow(search, "_found binary")
