"""Sinks and their re-readers: one table an artifact, and wrapper documents where a single JSON text is wanted."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.detect import public


def classifications(results: DataFrame) -> DataFrame:
    return results.select("message_id", "classification.*")


def extractions(results: DataFrame) -> DataFrame:
    return results.select("message_id", "extraction.items", "extraction.method", "extraction.reason")


def securities(results: DataFrame) -> DataFrame:
    return results.select("message_id", "security.*")


def final_results(results: DataFrame) -> DataFrame:
    """The wide rows without raw texts, values and places."""
    return results.select("message_id", "ts", "sender", "safe_message", "classification", "security", F.col("extraction.items").alias("extracted_items"), "row_pos")


def security(spans: Column) -> Column:
    return F.struct((F.size(spans) > 0).alias("has_detection"), public(spans).alias("detections"))


def materialized(table: DataFrame, name: str = "table") -> DataFrame:
    """The table written to the shared folder and read again.

    Views filter and explode analyzed columns. Over the lazy plan the optimizer would copy those long expressions into
    every pushed filter; over a written table the filters reach the scan, and the analysis runs once.
    """
    spark = table.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.gettempdir()}/missive-{spark.sparkContext.applicationId}"
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    table.write.parquet(path)
    return spark.read.schema(table.schema).parquet(path)


ARTIFACTS = {"classifications": classifications, "tasks_events": extractions, "sensitive_detections": securities, "final_results": final_results}


def write(results: DataFrame, folder: str, kind: str = "parquet") -> None:
    """Each artifact as a table below folder; a table appears when its job commits."""
    for name, made in ARTIFACTS.items():
        out = made(results).write.mode("overwrite")
        (out.option("ignoreNullFields", False).json if kind == "json" else out.parquet)(f"{folder}/{name}")


class ArtifactError(Exception):
    """An artifact is missing or cannot be read."""


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place))


def has_outputs(spark: SparkSession, folder: str) -> bool:
    """Whether the main artifacts are there: the final results and the report."""
    return all(exists(spark, f"{folder}/{name}") for name in ("final_results", "validation_report"))


def load(spark: SparkSession, folder: str, name: str, schema=None) -> DataFrame:
    """An artifact again; with a schema (a DDL text or a type) from JSON lines, else from Parquet. Lines that are JSON but no objects are left out.

    ArtifactError: there is no such artifact. The job that reads the rows ends at a line that is no JSON, or an object that does not fit the schema.
    """
    path = f"{folder}/{name}"
    if not exists(spark, path):
        raise ArtifactError(f"no artifact {path}")
    if schema is None:
        return spark.read.parquet(path)
    kind = F.schema_of_variant(F.try_parse_json("value"))
    line = F.when(kind.isNull(), F.raise_error(F.lit(f"a line of {name} is no JSON"))).when(kind.startswith("OBJECT"), F.col("value"))
    objects = spark.read.text(path).where(F.trim("value") != "").select(line.alias("value")).where("value is not null")
    return objects.select(F.from_json("value", schema if isinstance(schema, str) else schema.simpleString(), {"mode": "FAILFAST"}).alias("x")).select("x.*")


def write_document(rows: DataFrame, path: str, generated_at: str) -> None:
    """Rows as one JSON text {generated_at, count, messages}: its rows come to one task, so it is for reports, not for large tables."""
    kept = rows.drop("row_pos")
    every = F.collect_list(F.struct("row_pos", F.struct(*kept.columns).alias("row"))) if "row_pos" in rows.columns else F.collect_list(F.struct(F.lit(0).alias("row_pos"), F.struct(*kept.columns).alias("row")))
    one = rows.agg(F.transform(F.array_sort(every), lambda x: x["row"]).alias("messages"))
    made = F.struct(F.lit(generated_at).alias("generated_at"), F.size("messages").alias("count"), "messages")
    one.select(F.to_json(made, {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_document(spark: SparkSession, path: str, row_schema: str) -> DataFrame:
    """The rows of a document again; ArtifactError if it is missing, no JSON object, or has no list of messages."""
    if not exists(spark, path):
        raise ArtifactError(f"no artifact {path}")
    parsed = spark.read.text(path, wholetext=True).select(F.from_json("value", f"messages array<struct<{row_schema}>>").alias("x"))
    if not parsed.where("x.messages is null").isEmpty() or parsed.isEmpty():
        raise ArtifactError(f"{path} is no document with a list of messages")
    return parsed.select(F.inline("x.messages"))


def write_report(report: DataFrame, path: str) -> None:
    """A one-row report as a JSON object."""
    report.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The row of a report again; ArtifactError if it is missing or no JSON object."""
    if not exists(spark, path):
        raise ArtifactError(f"no artifact {path}")
    parsed = spark.read.text(path, wholetext=True).where(F.trim("value").startswith("{")).select(F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("x")).where("x is not null")
    if parsed.isEmpty():
        raise ArtifactError(f"{path} is no JSON object")
    return parsed.select("x.*")


class Repository:
    """The artifacts below a folder; the last one read is kept in memory until another is read or ``clear``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._last = spark, folder, None

    def table(self, name: str) -> DataFrame:
        if self._last is None or self._last[0] != name:
            self.clear()
            self._last = (name, load(self.spark, self.folder, name).cache())
        return self._last[1]

    def clear(self) -> None:
        if self._last is not None:
            self._last[1].unpersist()
        self._last = None


def lines(table: DataFrame) -> DataFrame:
    """Rows as JSON text, with explicit nulls."""
    return table.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line"))
