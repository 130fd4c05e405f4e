"""Streams from files: equal to the batch result, across micro-batches and restarts."""

import datetime

import pytest
from missive.operators import audit, validate
from missive.plans.analysis import published
from missive.streaming import stream
from pyspark.sql import functions as F

SCHEMA = "message_id string, ts timestamp_ntz, sender string, message string, row_pos long"
TEXTS = ("Your OTP is 482913", "Please submit the report by 2026-09-04.", "The cafeteria closes at 8 PM.")


def rows_of(spark, rows):
    """(id, minute, row_pos) rows as messages."""
    made = [(i, datetime.datetime(2026, 9, 1, 8) + datetime.timedelta(minutes=m), "Meera", TEXTS[k % 3], k) for i, m, k in rows]
    return spark.createDataFrame(made, SCHEMA)


def put(spark, folder, rows):
    rows_of(spark, rows).coalesce(1).write.mode("append").parquet(folder)


def source(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def run(made, folder, name):
    made.writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-at").outputMode("append").trigger(availableNow=True).start().awaitTermination()


def test_artifacts_as_in_batch_and_after_a_restart(spark, folder):
    first, second = [("a", 0, 0), ("b", 1, 1), ("a", 2, 2)], [("c", 3, 3), ("b", 4, 4), ("d", 5, 5)]
    for part in (first, second):  # the second run goes on from the checkpoint
        put(spark, f"{folder}/in", part)
        stream.write_artifacts(stream.analyzed_stream(source(spark, f"{folder}/in")), f"{folder}/out", f"{folder}/at").awaitTermination()
    got = spark.read.parquet(f"{folder}/out/final_results").drop("batch").orderBy("row_pos").collect()
    once = rows_of(spark, [("a", 0, 0), ("b", 1, 1), ("c", 3, 3), ("d", 5, 5)])  # each id once within the delay
    want = {r.message_id: r for r in published(once).selectExpr("message_id", "safe_message", "classification").collect()}
    assert [r.message_id for r in got] == ["a", "b", "c", "d"]
    assert all((r.safe_message, r.classification) == (want[r.message_id].safe_message, want[r.message_id].classification) for r in got)
    assert spark.read.parquet(f"{folder}/out/classifications").count() == 4


def test_categories_by_window(spark, folder):
    rows = [(f"m{i}", 600 * (i // 3), i) for i in range(12)] + [("last", 60 * 24 * 9, 12)]
    put(spark, f"{folder}/in", rows[:6])
    put(spark, f"{folder}/in", rows[6:])
    run(stream.categories_by_window(stream.analyzed_stream(source(spark, f"{folder}/in"))), folder, "windows")
    got = {(r.start, r.category): r.n for r in spark.read.parquet(f"{folder}/windows").collect()}
    batch = published(rows_of(spark, rows[:12])).withColumn("event_time", F.col("ts").cast("timestamp"))
    want = {(r.start, r.category): r.n for r in stream.categories_by_window(batch).collect()}
    assert want and got == want  # the last row's window is still open


def test_repeated_ids_over_micro_batches(spark, folder):
    stream.stateful(spark)
    first = [("a", 0, 0), ("b", 1, 1), ("a", 2, 2), (None, 2, 3)]
    second = [("b", 3, 4), ("a", 4, 5), ("c", 5, 6), ("a", 5, 7), (None, 6, 8)]
    for part in (first, second):
        put(spark, f"{folder}/in", part)
        run(stream.repeated_ids(source(spark, f"{folder}/in")), folder, "again")
    got = sorted((r.message_id or "", r.row_pos, r.occurrence) for r in spark.read.parquet(f"{folder}/again").collect())
    want = sorted((r.message_id or "", r.row_pos, r.occurrence) for r in audit.repeated_rows(rows_of(spark, first + second)).collect())
    assert got == want and len(want) == 5
    put(spark, f"{folder}/in", [("far", 60 * 24 * 30, 9)])  # the watermark passes all timers
    put(spark, f"{folder}/in", [("far", 60 * 24 * 30, 10)])
    put(spark, f"{folder}/in", [("a", 60 * 24 * 31, 11)])
    run(stream.repeated_ids(source(spark, f"{folder}/in")), folder, "again")
    late = {(r.message_id, r.row_pos, r.occurrence) for r in spark.read.parquet(f"{folder}/again").collect()} - {(m or None, p, o) for m, p, o in got}
    assert late == {("far", 10, 2)}  # a's state had ended


def test_issues_over_micro_batches(spark, folder):
    parts = [[("a", 0, 0), ("b", 5, 1)], [("c", 3, 2), (" ", 9, 3)], [("d", 9, 4), ("e", 8, 5), ("f", 1, 6)], [("g", 10, 7)]]
    for part in parts:
        put(spark, f"{folder}/in", part)
        stream.write_issues(source(spark, f"{folder}/in"), f"{folder}/out", f"{folder}/at").awaitTermination()
    got = sorted((r.code, r.row_pos) for r in spark.read.parquet(f"{folder}/out/issues").collect())
    assert got == [("empty_message_id", 3), ("not_chronological", 2), ("not_chronological", 5)]
    every = rows_of(spark, [x for p in parts for x in p])
    assert validate.first_inversion(every).first().row_pos == min(p for c, p in got if c == "not_chronological")


def test_numbering_splits_an_id_that_has_half_of_all_rows(spark):
    rows = spark.range(20_000, numPartitions=4).selectExpr("CASE WHEN id % 2 = 0 THEN 'hot' WHEN id % 5 = 1 THEN NULL ELSE concat('m', id % 900) END AS message_id", "(id * 7919) % 20011 AS row_pos")
    got = sorted((r.message_id or "", r.row_pos, r.occurrence) for r in audit.repeated_rows(rows).collect())
    plain = rows.selectExpr("message_id", "row_pos", "row_number() OVER (PARTITION BY message_id ORDER BY row_pos) AS n").where("n > 1").collect()
    assert got == sorted((r.message_id or "", r.row_pos, r.n) for r in plain)
    parts = audit.ranged(rows, "row_pos").groupBy("message_id", "_range").count().agg(F.max("count")).first()[0]
    assert parts < 20_000 / 8  # rows of one window at most
