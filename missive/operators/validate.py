"""Checks of the input: every issue of a table of raw messages, reported together as rows."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import blank
from ..sources.messages import COLUMNS, parsed_timestamp

ISSUE = "code string, row_pos long, message_id string, detail string"


class InvalidDataset(Exception):
    """Carries all issues found, as text."""


def _issue(rows: DataFrame, code: str, detail) -> DataFrame:
    return rows.select(F.lit(code).alias("code"), F.col("row_pos").cast("long").alias("row_pos"), F.col("message_id"), (F.lit(detail) if isinstance(detail, str) else detail).alias("detail"))


def first_inversion(messages: DataFrame, buckets: int | None = None) -> DataFrame:
    """The first row (row_pos) whose ts is before the greatest ts of an earlier row.

    A row before its direct predecessor exists exactly if one is before the running maximum, and the first of both is
    the same. Rows are cut into ranges of row_pos of about equal numbers of rows (by its quantiles, since row numbers may have
    wide gaps); only the ranges' maxima (buckets rows at most) are put in one order.
    """
    buckets = buckets or max(1024, int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    inner = sorted(set(messages.approxQuantile("row_pos", [k / buckets for k in range(1, buckets)], 0.25 / buckets)))
    rows = messages.select("row_pos", "message_id", "ts", F.col("row_pos").cast("double").alias("_at"))
    cut = Bucketizer(splits=[float("-inf"), *inner, float("inf")], inputCol="_at", outputCol="b").transform(rows) if inner else rows.withColumn("b", F.lit(0.0))
    tops = cut.groupBy("b").agg(F.max("ts").alias("top"))
    before = tops.select("b", F.max("top").over(W.orderBy("b").rowsBetween(W.unboundedPreceding, -1)).alias("before"))
    inside = F.max("ts").over(W.partitionBy("b").orderBy("row_pos").rowsBetween(W.unboundedPreceding, -1))
    late = cut.withColumn("inside", inside).join(F.broadcast(before), "b").where(F.col("ts") < F.greatest("inside", "before"))
    return late.agg(F.min(F.struct("row_pos", "message_id")).alias("x")).where("x is not null").select("x.*")


def issues(raw: DataFrame, expected: int | None = None) -> DataFrame:
    """(code, row_pos, message_id, detail) of all issues; a missing column is reported alone, each repeated id once."""
    spark = raw.sparkSession
    missing = [c for c in COLUMNS if c not in raw.columns]
    if missing:
        return spark.createDataFrame([("missing_columns", None, None, ", ".join(missing))], ISSUE)
    rows = raw.withColumn("ts", parsed_timestamp(F.col("timestamp")))
    n_blank = rows.where(blank(F.col("message_id")))
    again = rows.groupBy("message_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = again.crossJoin(F.broadcast(n_blank.agg(F.count(F.lit(1)).alias("blanks")))).where("blanks = 0")
    bad = rows.where(F.col("ts").isNull())
    inverted = first_inversion(rows).crossJoin(F.broadcast(bad.agg(F.count(F.lit(1)).alias("bad")))).where("bad = 0")
    found = [
        _issue(n_blank, "empty_message_id", "row without message_id"),
        repeated.select(F.lit("duplicate_message_id").alias("code"), F.lit(None).cast("long").alias("row_pos"), "message_id", F.concat(F.col("n").cast("string"), F.lit(" rows")).alias("detail")),
        _issue(bad, "malformed_timestamp", F.concat(F.lit("not a timestamp: "), F.coalesce("timestamp", F.lit("")))),
        _issue(inverted, "not_chronological", "earlier than the row before"),
        _issue(rows.where(blank(F.col("message"))), "missing_message_content", "blank message"),
        _issue(rows.where(blank(F.col("sender"))), "missing_sender", "blank sender"),
    ]
    if expected is not None:
        size = rows.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != expected)
        found.append(size.select(F.lit("unexpected_dataset_size").alias("code"), F.lit(None).cast("long").alias("row_pos"), F.lit(None).cast("string").alias("message_id"), F.concat(F.col("n").cast("string"), F.lit(f" rows, not {expected}")).alias("detail")))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def require_valid(raw: DataFrame, expected: int | None = None, shown: int = 50) -> DataFrame:
    """raw, or InvalidDataset with the issues (the first of them, and how many)."""
    found = issues(raw, expected).cache()
    try:
        n = found.count()
        if n:
            rows = found.orderBy("code", "row_pos").limit(shown).collect()
            raise InvalidDataset(f"{n} issues: " + "; ".join(f"[{r.code}] {r.detail}" for r in rows))
    finally:
        found.unpersist()
    return raw


def statistics(messages: DataFrame) -> DataFrame:
    """One row of counts; the job that reads it ends with an error if there are no messages."""
    n = F.count(F.lit(1))
    return messages.agg(
        F.when(n > 0, n).otherwise(F.raise_error(F.lit("no messages")).cast("long")).alias("total_messages"), F.countDistinct("message_id").alias("unique_message_ids"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.count_if(blank(F.col("message"))).alias("empty_messages"), F.count_if(blank(F.col("sender"))).alias("empty_senders"),
    )
