"""The whole analysis as one lazy plan: spans, masked text, category, items. No shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.classify import with_classification
from ..operators.detect import with_safe_text, with_spans
from ..operators.extract import with_extraction
from ..operators.fallback import failed
from ..sources.artifacts import security


#: Rows that a task analyzes.
AT_ONCE = 50_000


def spread(messages: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """messages in equal partitions of so many rows, at least one for each core: rows are narrow before the analysis, and their analysis is long.

    The partitions of a scan would not do: they are cut by bytes, a row group is never cut, and 128 MB of orders are millions of messages. The rows
    are counted first, for Parquet from its footers.
    """
    if messages.isStreaming:
        return messages
    return messages.repartition(max(messages.sparkSession.sparkContext.defaultParallelism, -(-messages.count() // at_once)))


def analyzed(messages: DataFrame) -> DataFrame:
    """message_id, ts, sender, row_pos, safe_message, spans (private), security, classification, extraction."""
    safe = with_safe_text(with_spans(spread(messages)))
    out = with_extraction(with_classification(safe))
    return out.withColumn("security", security(F.col("spans")))


def published(messages: DataFrame) -> DataFrame:
    """analyzed, without raw texts, values and places."""
    return analyzed(messages).drop("message", "spans")


def summary(results: DataFrame) -> DataFrame:
    """Totals of a run, with the items of each type as a map with sorted keys."""
    totals = results.agg(
        F.count(F.lit(1)).alias("total_messages"), F.count_if("security.has_detection").alias("messages_with_sensitive"),
        F.count_if(F.size("extraction.items") > 0).alias("messages_with_items"), F.sum(F.size("extraction.items").cast("long")).alias("total_items"),
        F.count_if(F.col("classification.method").isin("rule_based", "llm_failed")).alias("rule_based"), F.count_if(F.col("classification.method") == "llm").alias("llm_based"),
        F.coalesce(F.sum(failed(results)), F.lit(0)).alias("llm_failures"),
    )
    by_type = items_by_type(results).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("items_by_type"))
    return totals.crossJoin(by_type)  # one row each


def items_by_type(results: DataFrame) -> DataFrame:
    return results.select(F.explode("extraction.items").alias("x")).groupBy("x.type").agg(F.count(F.lit(1)).alias("n"))
