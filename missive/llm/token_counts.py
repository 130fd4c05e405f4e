"""Token counts of sections, from one encoding of each whole document.

A document is encoded once; its tokens tile the text's bytes, so the running sum of their byte lengths gives every
token's span. The document's sections (spans of characters, as an array column) are interval-joined with the token spans
by binary search on those ends. A token that crosses a border is allocated by ``rule``: to the section with its first
byte (``first``), with its last byte (``last``), or to each by its share of the token's bytes (``share``).

Defined cases: a null or empty text has no tokens and the one empty section; null sections give no rows; sections may
overlap or leave gaps (a token then counts in each section that the rule names, or in none); spans are cut to the text;
repeated rows are counted each; a very long text is encoded whole, in one task; other columns are not needed; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read, ship, text_or_empty
from .tokens import default_path, loaded


def line_sections(text: Column) -> Column:
    """Spans of the lines of a text, each with the newline that ends it."""
    lengths = F.transform(F.split(text, "\n", -1), lambda x: F.char_length(x) + 1)
    ends = F.aggregate(lengths, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    return F.transform(lengths, lambda n, i: F.struct(F.get(ends, i).cast("long").alias("start"), (F.get(ends, i) + n).cast("long").alias("end")))


def even_sections(text: Column, width: int) -> Column:
    """Spans of so many characters, the last one shorter; their borders fall anywhere, inside tokens too."""
    starts = F.sequence(F.lit(0), F.greatest(F.char_length(text) - 1, F.lit(0)), F.lit(width))
    return F.transform(starts, lambda a: F.struct(a.cast("long").alias("start"), (a + width).cast("long").alias("end")))


def _line_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """What line_sections gives, cut to the text, in bytes."""
    b = np.frombuffer(text.encode(), np.uint8)
    ends = np.append(np.flatnonzero(b == 10) + 1, len(b))
    return np.append(0, ends[:-1]), ends


def count_tokens(docs: DataFrame, *, sections: str | None = None, rule: str = "first", tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, section, n_chars, n_tokens (double) and n_crossing; sections: a column of array<struct<start, end>>, else lines."""
    if rule not in ("first", "last", "share"):
        raise ValueError("rule is first, last or share")
    ship(docs.sparkSession)
    path = tokenizer or default_path()
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"), *([F.col(sections).cast("array<struct<start:long,end:long>>").alias("sections")] if sections else []))
    names = ["doc_id", "section", "n_chars", "n_tokens", "n_crossing"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = loaded(path)
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in names[1:]]
            counts = []
            for k, value in enumerate(batch.column(1)):
                text = value.as_py()
                b = np.frombuffer(text.encode(), np.uint8)
                chars = np.append(0, np.cumsum((b & 0xC0) != 0x80))  # characters begun before each byte border
                if sections is None:
                    a, e = _line_spans(text)
                else:
                    spans = batch.column(2)[k].as_py() or []
                    places = np.append(np.flatnonzero((b & 0xC0) != 0x80), len(b))
                    cut = np.clip(np.array([[s["start"] or 0, s["end"] or 0] for s in spans], np.int64).reshape(-1, 2), 0, len(places) - 1)
                    a, e = places[cut[:, 0]], places[np.maximum(cut[:, 0], cut[:, 1])]
                ends = np.cumsum(ids.byte_lengths[np.frombuffer(ids.of(text), "<u4")])
                begins = np.append(0, ends[:-1])[: len(ends)]
                if rule == "first":
                    n = np.searchsorted(begins, e) - np.searchsorted(begins, a)
                elif rule == "last":
                    n = np.searchsorted(ends, e, "right") - np.searchsorted(ends, a, "right")
                else:
                    borders = np.append(0, ends)
                    n = np.interp(e, borders, np.arange(len(borders))) - np.interp(a, borders, np.arange(len(borders)))
                inside = np.searchsorted(begins, e) - np.searchsorted(ends, a, "right")  # tokens that touch the section
                whole = np.maximum(0, np.searchsorted(ends, e, "right") - np.searchsorted(begins, a))
                n, inside = np.where(e > a, n, 0), np.where(e > a, inside, 0)
                for c, x in zip(out, (np.arange(len(a)), chars[e] - chars[a], n, np.maximum(0, inside - np.where(e > a, whole, 0))), strict=True):
                    c.append(x)
                counts.append(len(a))
            types = [pa.int64(), pa.int64(), pa.float64(), pa.int64()]
            docs_of = batch.column(0).take(pa.array(np.repeat(np.arange(len(counts)), counts), pa.int64()))
            cols = [pa.array(np.concatenate([*c, np.empty(0)]).astype(t.to_pandas_dtype()), t) for c, t in zip(out, types, strict=True)]
            yield pa.RecordBatch.from_arrays([docs_of, *cols], names=names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, section long, n_chars long, n_tokens double, n_crossing long")


#: Characters of the registered query's sections.
WIDTH = 400


def op9(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs.withColumn("sections", even_sections(text_or_empty(), WIDTH)), sections="sections")
