"""Checks of the outputs: completeness, domains, repeated ids, leaks of raw values, and the quality report."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed as X
from .search import stretches


def missing_ids(expected: DataFrame, artifact: DataFrame) -> DataFrame:
    return expected.select("message_id").distinct().join(artifact, "message_id", "left_anti")


def unknown_ids(expected: DataFrame, artifact: DataFrame) -> DataFrame:
    return artifact.select("message_id").distinct().join(expected, "message_id", "left_anti")


def ranged(rows: DataFrame, at: str) -> DataFrame:
    """rows with _range, a number that rises with a long column and cuts the rows into about equal parts, as many as a shuffle has."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism * 4, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = sorted(set(rows.approxQuantile(at, [k / tasks for k in range(1, tasks)], 0.25 / tasks)))
    cut = rows.withColumn("_at", F.col(at).cast("double"))
    if not cuts:
        return cut.withColumn("_range", F.lit(0.0)).drop("_at")
    return Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="_at", outputCol="_range", handleInvalid="keep").transform(cut).drop("_at")


def numbered(rows: DataFrame, key: str, order: list[str], into: str = "occurrence") -> DataFrame:
    """rows with their number within their key, in the order of columns, of which the first is a long.

    A key may have most of the rows. So rows are numbered within (key, range), and what a key has in earlier ranges is added: a sum over at most
    as many rows for each key as there are ranges.
    """
    cut = ranged(rows, order[0])
    counts = cut.groupBy(key, "_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = counts.withColumn("_earlier", F.sum("_n").over(W.partitionBy(key).orderBy("_range")) - F.col("_n")).where("_earlier > 0").select(F.col(key).alias("_key"), F.col("_range").alias("_in"), "_earlier")
    inside = F.row_number().over(W.partitionBy(key, "_range").orderBy(*order))
    out = cut.withColumn("_inside", inside).join(earlier, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_in")), "left")
    return out.withColumn(into, F.col("_inside") + F.coalesce("_earlier", F.lit(0))).drop("_range", "_inside", "_key", "_in", "_earlier")


def repeated_rows(artifact: DataFrame, order: str = "row_pos") -> DataFrame:
    """Second and later rows of an id."""
    return numbered(artifact, "message_id", [order]).where("occurrence > 1")


def repeated_items(tasks: DataFrame) -> DataFrame:
    """Second and later items of an item id, over all messages."""
    return numbered(tasks, "item_id", ["row_pos", "pos"]).where("occurrence > 1")


def valid_confidence(c: Column | str) -> Column:
    """Anything that reads as a number from 0 to 1."""
    x = F.col(c) if isinstance(c, str) else c
    return F.coalesce(x.cast("string").try_cast("double").between(0, 1), F.lit(False))


def _row_codes() -> Column:
    """The codes of a row's domain and consistency errors."""
    items = F.col("extraction.items")
    tests = {
        "invalid_category": ~F.coalesce(F.col("classification.category").isin(*X.CATEGORIES), F.lit(False)),
        "invalid_confidence": ~valid_confidence("classification.confidence"),
        "missing_reason": F.coalesce(F.col("classification.reason"), F.lit("")) == "",
        "invalid_item_type": F.exists(items, lambda x: ~x["type"].isin(*X.ITEM_TYPES)),
        "invalid_priority": F.exists(items, lambda x: ~x["priority"].isin(*X.PRIORITIES)),
        "invalid_time": F.exists(items, lambda x: x["time"].isNotNull() & ~x["time"].rlike(r"^([01]\d|2[0-3]):[0-5]\d$")),
        "foreign_item": F.exists(items, lambda x: x["source_message_id"] != F.col("message_id")),
        "detection_mismatch": F.col("security.has_detection") != (F.size("security.detections") > 0),
        "sensitive_mismatch": F.col("security.has_detection") != (F.col("classification.category") == "sensitive_information"),
    }
    return F.filter(F.array(*(F.when(F.coalesce(t, F.lit(False)), F.lit(k)) for k, t in tests.items())), lambda x: x.isNotNull())


def row_issues(results: DataFrame) -> DataFrame:
    """(code, message_id) of domain and consistency errors within rows."""
    return results.select("message_id", F.explode(_row_codes()).alias("code"))


def artifact_issues(artifact: DataFrame, expected: DataFrame, name: str) -> DataFrame:
    """(code, artifact, message_id, detail): ids that are missing, unknown or repeated in an artifact, a row each."""
    row = lambda df, code, detail: df.select(F.lit(code).alias("code"), F.lit(name).alias("artifact"), "message_id", detail.alias("detail"))
    again = artifact.groupBy("message_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return (
        row(missing_ids(expected, artifact), "missing_message_id", F.lit(f"{name}: no row of the message"))
        .unionByName(row(unknown_ids(expected, artifact), "unknown_message_id", F.lit(f"{name}: not in the dataset")))
        .unionByName(row(again, "duplicate_message_id", F.concat(F.lit(f"{name}: "), F.col("n").cast("string"), F.lit(" rows"))))
    )


def issue_line(issues: DataFrame) -> DataFrame:
    """Issues as lines of text."""
    return issues.select(F.concat(F.lit("["), F.col("code"), F.lit("] "), F.coalesce("message_id", F.lit("")), F.lit(": "), F.coalesce("detail", F.lit(""))).alias("line"))


def output_issues(results: DataFrame, expected: DataFrame) -> DataFrame:
    """All issues of the rows and the ids of results (they have row_pos)."""
    rows = row_issues(results).select("code", F.lit("final_results").alias("artifact"), "message_id", F.lit("the row breaks the rule").alias("detail"))
    items = results.select("message_id", "row_pos", F.posexplode("extraction.items").alias("pos", "x")).select("message_id", "row_pos", "pos", "x.item_id")
    twice = repeated_items(items).select(F.lit("duplicate_item_id").alias("code"), F.lit("tasks_events").alias("artifact"), "message_id", F.concat(F.lit("item "), "item_id").alias("detail"))
    return rows.unionByName(twice).unionByName(artifact_issues(results, expected, "final_results"))


def artifact_counts(artifacts: dict[str, DataFrame]) -> DataFrame:
    """(artifact, n): rows of each artifact."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("artifact"), "n") for name, df in sorted(artifacts.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def leaks(detected: DataFrame, artifacts: dict[str, DataFrame], *, line: str = "line") -> DataFrame:
    """(message_id, type, start, artifact) of raw values that occur anywhere in an artifact's lines, once for each artifact.

    The different values are marked in a filter of bounded size, which all tasks get with the list of the values' lengths. Every stretch of a
    line that has one of these lengths is looked up there by a rolling hash, on the bytes of the text. What passes is joined with the values,
    so that one that passes by chance does no harm. No line meets a value in a join, so the work grows with the lines and the values, not
    with their product, however many lines a short value is in.
    """
    values = detected.select("message_id", F.explode("spans").alias("x")).select("message_id", "x.type", "x.value", "x.start").where("value <> ''")
    found = stretches(values.select(F.col("value").cast("binary")).distinct())
    hits = None
    for name, df in artifacts.items():
        part = found(df.select(F.col(line).cast("string").cast("binary").alias("_line"))).distinct().select("_found", F.lit(name).alias("artifact"))
        hits = part if hits is None else hits.unionByName(part)
    return values.join(hits, F.col("value").cast("binary") == F.col("_found")).select("message_id", "type", "start", "artifact")


def leak_texts(found: DataFrame) -> DataFrame:
    """Findings as maps of texts, without values and places."""
    return found.select(F.create_map(F.lit("message_id"), "message_id", F.lit("artifact"), "artifact", F.lit("sensitivity_type"), "type").alias("finding"))


def mandatory_check(ids: DataFrame, dataset: DataFrame, processed: DataFrame, classified: DataFrame) -> DataFrame:
    """One row: how many mandatory ids are given, differ, repeat, lack in the dataset, lack in the results, or have no category; and ok."""
    once = ids.groupBy("message_id").agg(F.count(F.lit(1)).alias("times"))
    marks = {"in_dataset": dataset, "is_processed": processed, "is_classified": classified}
    for name, df in marks.items():
        once = once.join(df.select("message_id").distinct().withColumn(name, F.lit(True)), "message_id", "left")
    no = lambda c: F.col(c).isNull()
    out = once.agg(
        F.coalesce(F.sum("times"), F.lit(0)).alias("provided"), F.count(F.lit(1)).alias("unique_ids"), F.count_if(F.col("times") > 1).alias("duplicates"), F.count_if(no("in_dataset")).alias("missing_from_dataset"),
        F.count_if(no("is_processed")).alias("not_processed"), F.count_if(~no("is_processed") & no("is_classified")).alias("not_classified"),
    )
    return out.withColumn("ok", F.expr("duplicates = 0 and missing_from_dataset = 0 and not_processed = 0 and not_classified = 0"))


def quality_report(results: DataFrame, expected: DataFrame, mandatory: DataFrame | None = None, found: DataFrame | None = None) -> DataFrame:
    """One row of counts over the results, the check of mandatory ids (none by default) and of leaks (``found``), and the status.

    PASS: nothing missing, repeated, out of its domain or leaked, no issue at all, and all mandatory ids have results.

    Results are read twice: once as rows of marks that meet the expected and the mandatory ids in one grouping by id, whose sums are the counts, and
    once for items that share an id. A null id is no id: it is missing where it is expected, and unknown and repeated where it has a result.
    """
    items, codes = F.size("extraction.items").cast("long"), F.col("_codes")
    marks = {
        "results": F.lit(1), "items": F.greatest(items, F.lit(0)), "sensitive": F.coalesce(F.col("security.has_detection").cast("long"), F.lit(0)), "expected": F.lit(0), "wanted": F.lit(0),
        "category": F.array_contains(codes, "invalid_category").cast("long"), "confidence": F.array_contains(codes, "invalid_confidence").cast("long"), "faults": F.size(codes),
    }
    of_ids = lambda df, name: df.select("message_id", *(F.lit(int(k == name)).cast("long").alias(k) for k in marks))
    rows = results.withColumn("_codes", _row_codes()).select("message_id", *(c.cast("long").alias(k) for k, c in marks.items())).unionByName(of_ids(expected, "expected"))
    if mandatory is not None:
        rows = rows.unionByName(of_ids(mandatory, "wanted"))
    ids = rows.groupBy("message_id").agg(*(F.sum(k).alias(k) for k in marks))
    has = lambda k: (F.col(k) > 0) & F.col("message_id").isNotNull()
    missing, unknown = (F.col("expected") > 0) & ~has("results"), (F.col("results") > 0) & ~has("expected")
    total = lambda k: F.coalesce(F.sum(k), F.lit(0))
    counts = ids.agg(
        total("expected").alias("total_input_messages"), total("results").alias("classified_messages"), (total("results") - F.count_if(has("results"))).alias("duplicate_message_ids"),
        total("items").alias("task_event_count"), total("sensitive").alias("sensitive_message_count"), F.count_if(missing).alias("missing_message_ids"),
        total("category").alias("invalid_categories"), total("confidence").alias("invalid_confidence_scores"),
        (total("faults") + F.count_if(missing) + F.count_if(unknown) + F.count_if(F.col("results") > 1)).alias("_issues"),
        F.count_if(has("wanted") & has("expected")).alias("mandatory_messages_found"), F.count_if(has("wanted") & has("results")).alias("mandatory_messages_processed"),
        F.count_if((F.col("wanted") > 0) & ~has("results")).alias("mandatory_messages_missing"),
    )
    shared = results.select(F.explode("extraction.items").alias("x")).groupBy("x.item_id").agg((F.count(F.lit(1)) - 1).alias("more")).agg(F.coalesce(F.sum("more"), F.lit(0)).alias("_shared"))
    leaked = (expected.select("message_id").where(F.lit(False)) if found is None else found).agg(F.count(F.lit(1)).alias("leaks"))
    out = counts.crossJoin(shared).crossJoin(leaked).withColumn("issues", F.col("_issues") + F.col("_shared"))  # one row each
    good = F.expr("missing_message_ids = 0 and duplicate_message_ids = 0 and invalid_categories = 0 and invalid_confidence_scores = 0 and issues = 0 and leaks = 0 and mandatory_messages_missing = 0")
    status = lambda ok: F.when(ok, "PASS").otherwise("FAIL")
    order = ("total_input_messages", "classified_messages", "duplicate_message_ids", "task_event_count", "sensitive_message_count", "missing_message_ids", "invalid_categories", "invalid_confidence_scores", "issues", "mandatory_messages_found", "mandatory_messages_processed", "mandatory_messages_missing")
    return out.select(*order, status(F.col("leaks") == 0).alias("sensitive_value_leak_check"), status(good).alias("validation_status"))
