"""Read views over results: filters, search, pages, one message, tasks, sensitive rows, mandatory rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as X
from .audit import ranged

LIMIT, MOST_MESSAGES, MOST_TASKS, LONGEST_SEARCH = 100, 900, 2000, 200


class NotFound(Exception):
    """No such message."""


#: Rows that one task may order for a page.
DIRECT = 10_000


def _page(rows: DataFrame, order: list[str], limit: int, offset: int, most: int) -> DataFrame:
    """Rows number offset to offset + limit in the order of columns, of which the first is a long.

    A deep page does not bring all rows before it to one task: rows are counted by ranges of the first column, and the page reads its own ranges only.
    """
    if not 1 <= limit <= most or offset < 0:
        raise ValueError(f"limit is 1 to {most}, offset 0 or more")
    if offset + limit <= DIRECT:
        return rows.orderBy(*order).offset(offset).limit(limit)
    at = order[0]
    ranges = sorted(ranged(rows, at).groupBy("_range").agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("low"), F.max(at).alias("high")).collect(), key=lambda r: r["_range"])
    before, low, high, skipped = 0, None, None, 0
    for r in ranges:  # as many as a shuffle has partitions
        if before + r.n > offset and before < offset + limit:
            low, high, skipped = (r.low if low is None else low), r.high, (before if low is None else skipped)
        before += r.n
    if low is None:
        return rows.limit(0)
    return rows.where(F.col(at).between(low, high)).orderBy(*order).offset(offset - skipped).limit(limit)


def _with_total(rows: DataFrame, page: DataFrame, limit: int, offset: int, order: list[str]) -> DataFrame:
    """One row: how many rows there are before paging, the page's offset and limit, and its items in order (limit bounds them)."""
    items = page.agg(F.array_sort(F.collect_list(F.struct(*order, *(c for c in page.columns if c not in order)))).alias("items"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return total.crossJoin(items).select("total", F.lit(offset).alias("page_offset"), F.lit(limit).alias("page_limit"), "items")  # one row each


def filtered_messages(results: DataFrame, *, search: str | None = None, category: str | None = None, sensitive: bool | None = None) -> DataFrame:
    if category is not None and category not in X.CATEGORIES:
        raise ValueError("no such category")
    if search is not None and len(search) > LONGEST_SEARCH:
        raise ValueError("search is too long")
    rows, needle = results, (search or "").strip().lower()
    if category is not None:
        rows = rows.where(F.col("classification.category") == category)
    if sensitive is not None:
        rows = rows.where(F.col("security.has_detection") == sensitive)
    if needle:  # over the borders of fields, masked text only
        rows = rows.where(F.contains(F.lower(F.concat_ws(" ", "message_id", "sender", "safe_message", "classification.category")), F.lit(needle)))
    return rows


def message_list(rows: DataFrame) -> DataFrame:
    """No text in lists."""
    return rows.select("message_id", "ts", "sender", "classification.category", "classification.confidence", "classification.method", F.col("security.has_detection").alias("has_sensitive"), "row_pos")


def messages(results: DataFrame, *, limit: int = LIMIT, offset: int = 0, **filters) -> DataFrame:
    return _page(message_list(filtered_messages(results, **filters)), ["row_pos"], limit, offset, MOST_MESSAGES)


def counted(results: DataFrame, *, limit: int = LIMIT, offset: int = 0, **filters) -> DataFrame:
    """One row: how many messages pass the filters, the page's offset and limit, and its items in order."""
    rows = filtered_messages(results, **filters)
    return _with_total(rows, _page(message_list(rows), ["row_pos"], limit, offset, MOST_MESSAGES), limit, offset, ["row_pos"])


def message(results: DataFrame, message_id: str) -> DataFrame:
    """One message in full; NotFound if there is none."""
    row = results.where(F.col("message_id") == message_id).orderBy("row_pos").limit(1)
    if row.isEmpty():
        raise NotFound(message_id)
    return row


def tasks(results: DataFrame) -> DataFrame:
    return results.select("row_pos", F.posexplode("extraction.items").alias("pos", "item")).select("row_pos", "pos", "item.*")


def filtered_tasks(results: DataFrame, *, type: str | None = None, priority: str | None = None, date_from: str | None = None, date_to: str | None = None) -> DataFrame:  # noqa: A002
    """Items; one without any date passes only if no bound is set."""
    if type is not None and type not in X.ITEM_TYPES or priority is not None and priority not in X.PRIORITIES:
        raise ValueError("no such type or priority")
    rows, day = tasks(results), F.coalesce("date", "deadline")
    if type is not None:
        rows = rows.where(F.col("type") == type)
    if priority is not None:
        rows = rows.where(F.col("priority") == priority)
    if date_from is not None:
        rows = rows.where(day >= F.lit(date_from).cast("date"))
    if date_to is not None:
        rows = rows.where(day <= F.lit(date_to).cast("date"))
    return rows


def task_list(results: DataFrame, *, limit: int = LIMIT, offset: int = 0, **filters) -> DataFrame:
    return _page(filtered_tasks(results, **filters), ["row_pos", "pos"], limit, offset, MOST_TASKS)


def counted_tasks(results: DataFrame, *, limit: int = LIMIT, offset: int = 0, **filters) -> DataFrame:
    """The same of items."""
    rows = filtered_tasks(results, **filters)
    return _with_total(rows, _page(rows, ["row_pos", "pos"], limit, offset, MOST_TASKS), limit, offset, ["row_pos", "pos"])


def _sensitive(results: DataFrame) -> DataFrame:
    return results.where("security.has_detection").select("message_id", "sender", "safe_message", "security.detections", "row_pos")


def sensitive(results: DataFrame, *, limit: int = LIMIT, offset: int = 0) -> DataFrame:
    return _page(_sensitive(results), ["row_pos"], limit, offset, MOST_MESSAGES)


def counted_sensitive(results: DataFrame, *, limit: int = LIMIT, offset: int = 0) -> DataFrame:
    """The same of messages with detections."""
    return _with_total(_sensitive(results), sensitive(results, limit=limit, offset=offset), limit, offset, ["row_pos"])


def mandatory(results: DataFrame, ids: DataFrame, *, strict: bool = False, shown: int = 20) -> DataFrame:
    """Results of the given ids, in order. NotFound, if strict, when an id has none: with the first of such ids."""
    if strict and (lost := [str(r.message_id) for r in mandatory_missing(results, ids).orderBy("message_id").limit(shown).collect()]):
        raise NotFound(", ".join(lost))
    return results.join(ids.select("message_id").distinct(), "message_id", "left_semi").orderBy("row_pos")


def mandatory_missing(results: DataFrame, ids: DataFrame) -> DataFrame:
    return ids.select("message_id").distinct().join(results, "message_id", "left_anti")


def item_line(results: DataFrame) -> DataFrame:
    """Each message's items in a line of text."""
    line = F.concat_ws(" · ", F.transform("extraction.items", lambda x: F.concat_ws(": ", x["type"], x["title"])))
    return results.select("message_id", F.when(line == "", "No extracted items").otherwise(line).alias("items"))
