"""Delimited text with quoted newlines, read by many tasks however large one file is.

A newline ends a record unless it stands within quotes, which only what comes before it tells. Lines are read by Spark's own
splits. Each line is a function from "quotes are open before it" to "open after it": it leaves them as they are, turns them
over, or makes them open or closed whatever was before. Functions compose, so a split is such a function too; the splits of a
file are composed in order (a row for each split), and every line then knows its state by a window within its split. Lines of
records that go on over several lines are gathered by record; all others are records as they stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

QUOTE, COMMA = '"', ","


def _open_after(line: Column, before: bool) -> Column:
    """Whether quotes are open after a line. Doubled quotes do nothing; of the others one opens at a field's start only, and the next closes."""
    between = F.split(F.replace(line, F.lit(QUOTE * 2), F.lit("")), QUOTE, -1)
    start = F.struct(F.lit(before).alias("open"), F.lit(not before).alias("first"))

    def step(state: Column, text: Column) -> Column:
        opens = text.endswith(COMMA) | ((text == "") & state["first"])
        return F.struct((~state["open"] & opens).alias("open"), F.lit(False).alias("first"))

    return F.aggregate(F.slice(between, F.lit(1), F.size(between) - 1), start, step)["open"]


def _before(order: W, start: Column) -> Column:
    """Whether quotes are open before a row of (if_closed, if_open): the last row that decides alone, turned over as often as rows since turn over."""
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    alone, turns = F.col("if_closed") == F.col("if_open"), (F.col("if_closed") & ~F.col("if_open")).cast("long")
    decided = F.last(F.when(alone, F.struct("if_closed", "turned")), ignorenulls=True).over(earlier)
    turned = F.coalesce(F.sum(turns).over(earlier), F.lit(0)) - F.coalesce(decided["turned"], F.lit(0))
    return F.coalesce(decided["if_closed"], start) != (turned % 2 == 1)


def _with_turns(rows: DataFrame, order: W) -> DataFrame:
    turns = (F.col("if_closed") & ~F.col("if_open")).cast("long")
    return rows.withColumn("turned", F.sum(turns).over(order.rowsBetween(W.unboundedPreceding, 0)))


def records(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8") -> DataFrame:
    """(file, record, text) of all records, the header and blank lines included; record counts from 0 in each file and rises with the place.

    A file that ends within quotes gives one more row with a null text. Lines end with a newline or with carriage return and newline.
    """
    at = F.col("_metadata")
    lines = spark.read.option("lineSep", "\n").option("encoding", encoding).text(path).select(at["file_path"].alias("file"), at["file_block_start"].alias("split"), "value")
    lines = lines.withColumn("place", F.monotonically_increasing_id())  # rises within a split
    lines = lines.withColumn("value", F.when((F.col("split") == 0) & F.startswith("value", F.lit("﻿")), F.substr("value", F.lit(2))).otherwise(F.col("value")))
    lines = lines.withColumn("if_closed", _open_after(F.col("value"), False)).withColumn("if_open", _open_after(F.col("value"), True))
    inside, within = W.partitionBy("file", "split").orderBy("place"), W.partitionBy("file").orderBy("split")
    states = _with_turns(lines, inside)
    both = lambda start: _before(inside, F.lit(start))
    states = states.withColumns({"closed_before": both(False), "open_before": both(True)})  # the state before the line, for either state before its split
    after = lambda before: F.when(F.col(before), F.col("if_open")).otherwise(F.col("if_closed"))
    states = states.withColumns({"closed_after": after("closed_before"), "open_after": after("open_before")})
    ends = lambda a: F.count_if(~F.col(a))
    splits = states.groupBy("file", "split").agg(F.max_by("closed_after", "place").alias("if_closed"), F.max_by("open_after", "place").alias("if_open"), ends("closed_after").alias("n_closed"), ends("open_after").alias("n_open"))
    splits = _with_turns(splits, within).withColumn("opened", _before(within, F.lit(False)))
    splits = splits.withColumn("n", F.when(F.col("opened"), F.col("n_open")).otherwise(F.col("n_closed")))
    splits = splits.withColumn("earlier", F.coalesce(F.sum("n").over(within.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    whole = splits.select("file", "split", "opened", "earlier")
    known = states.join(whole, ["file", "split"])
    pick = lambda a, b: F.when(F.col("opened"), F.col(b)).otherwise(F.col(a))
    known = known.select("file", "split", "place", "value", "earlier", pick("closed_before", "open_before").alias("before"), pick("closed_after", "open_after").alias("after"))
    ended = F.coalesce(F.sum((~F.col("after")).cast("long")).over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    known = known.withColumn("record", F.col("earlier") + ended)
    plain = known.where(~F.col("before") & ~F.col("after")).select("file", "record", F.col("value").alias("text"))
    part = F.struct("split", "place", "value", "after")
    longer = known.where(F.col("before") | F.col("after")).groupBy("file", "record").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    closed = ~F.element_at("parts", -1)["after"]
    longer = longer.select("file", "record", F.when(closed, F.array_join(F.transform("parts", lambda x: x["value"]), "\n")).alias("text"))
    return plain.unionByName(longer).withColumn("text", F.regexp_replace("text", "\r$", ""))
