"""A whole run: read, validate, analyze, write the artifacts, check them, report."""

from __future__ import annotations

import datetime
import os
import time
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit
from ..operators.detect import with_spans
from ..operators.fallback import Factory, Manners, http_provider, observed, with_model_category, with_model_items
from ..operators.validate import require_valid
from ..sources.artifacts import ARTIFACTS, exists, lines, load, materialized, write, write_report
from ..sources.messages import mandatory_ids, read_csv, typed
from ..sources.sealed import prepared
from .analysis import published, summary


@dataclass(frozen=True)
class Settings:
    messages: str = "messages.csv"
    mandatory: str = ""
    outputs: str = "outputs"
    expected: int = 900
    expected_mandatory: int = 15
    model_enabled: bool = False
    model_url: str = ""
    model_name: str = ""
    model_key: str = ""
    model_timeout: float = 30.0
    model_at_once: int = 8
    sealed: str = ""
    sealed_mandatory: str = ""
    key_file: str = ""


def settings(prefix: str = "MISSIVE_", environment: dict[str, str] | None = None) -> Settings:
    """Settings from variables such as MISSIVE_OUTPUTS; an empty one counts as not set. ValueError if a number is none."""
    env, out = os.environ if environment is None else environment, {}
    for f in fields(Settings):
        raw = env.get(prefix + f.name.upper(), "").strip()
        if not raw:
            continue
        if isinstance(f.default, bool):
            out[f.name] = raw.lower() in ("1", "true", "yes", "on")
        elif isinstance(f.default, (int, float)):
            try:
                out[f.name] = type(f.default)(raw)
            except ValueError as e:
                raise ValueError(f"{prefix}{f.name.upper()} is not a number: {raw!r}") from e
        else:
            out[f.name] = raw
    return Settings(**out)


def provider_of(s: Settings) -> Factory | None:
    """The model of the settings; none unless it is enabled and has a key, a name and a place."""
    return http_provider(s.model_url, s.model_key, s.model_name, s.model_timeout) if s.model_enabled and s.model_key and s.model_name and s.model_url else None


def now() -> str:
    return datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds")


def validation_report(report: DataFrame, totals: DataFrame, found: DataFrame, generated_at: str, shown: int = 1000) -> DataFrame:
    """One row: the summary, the quality report, the number of leaks and the first ``shown`` of them, the status."""
    n = found.agg(F.count(F.lit(1)).alias("n"))
    first = audit.leak_texts(found.orderBy("message_id", "type", "artifact", "start").limit(shown)).agg(F.collect_list("finding").alias("findings"))
    one = report.select(F.struct("*").alias("report")).crossJoin(totals.select(F.struct("*").alias("summary"))).crossJoin(n).crossJoin(first)  # one row each
    leak_scan = F.struct((F.col("n") == 0).alias("ok"), F.col("n").alias("count"), "findings")
    return one.select(F.lit(generated_at).alias("generated_at"), "summary", "report", leak_scan.alias("leak_scan"), F.col("report.validation_status").alias("validation_status"))


def summary_statistics(report: DataFrame, totals: DataFrame, check: DataFrame | None, generated_at: str, seconds: float | None) -> DataFrame:
    """One row of counts: no text and no value. mandatory_processed is the number of different mandatory ids."""
    one = totals.crossJoin(report.select("classified_messages", "validation_status", F.col("sensitive_value_leak_check").alias("leak_check")))
    one = one.crossJoin(check.select(F.col("unique_ids").alias("mandatory_processed"))) if check is not None else one.withColumn("mandatory_processed", F.lit(0).cast("long"))
    return one.select(
        F.lit(generated_at).alias("generated_at"), "total_messages", "classified_messages", F.col("messages_with_sensitive").alias("sensitive_messages"), F.col("total_items").alias("task_event_count"), "items_by_type",
        F.col("rule_based").alias("rule_based_classifications"), F.col("llm_based").alias("llm_fallback_classifications"), F.col("llm_failures").alias("failures"),
        F.lit(seconds).cast("double").alias("processing_duration_seconds"), "mandatory_processed", "validation_status", "leak_check",
    )


STATS = {"total_messages": "summary.total_messages", "classified_messages": "report.classified_messages", "sensitive_messages": "summary.messages_with_sensitive", "task_event_count": "summary.total_items",
         "rule_based_count": "summary.rule_based", "llm_fallback_count": "summary.llm_based", "validation_status": "report.validation_status"}


def stats(document: DataFrame) -> DataFrame:
    """The headline numbers of a validation report; an unknown status is UNKNOWN."""
    return document.select(*(F.col(v).alias(k) for k, v in STATS.items())).na.fill("UNKNOWN", ["validation_status"])


def run(spark: SparkSession, s: Settings) -> int:
    """The run of the settings: writes the artifacts, prints a report, and returns 0 if all is well, else 1."""
    for plain, blob in ((s.messages, s.sealed), (s.mandatory, s.sealed_mandatory)):
        if blob:
            prepared(spark, plain, blob, s.key_file or None)
    raw = materialized(read_csv(spark, s.messages, folder=bool(s.sealed)), "messages")  # checks read it again and again
    messages = typed(require_valid(raw, s.expected))
    began, results = time.perf_counter(), published(messages)
    if (provider := provider_of(s)) is not None:
        manners = Manners(at_once=s.model_at_once)
        results = with_model_items(with_model_category(results, provider, manners=manners), provider, manners)
    results, seen = observed(results)
    results.write.mode("overwrite").parquet(f"{s.outputs}/results")
    results = spark.read.schema(results.schema).parquet(f"{s.outputs}/results")
    write(results, s.outputs)
    seconds = round(time.perf_counter() - began, 4)
    wanted = mandatory_ids(spark, s.mandatory, expected=s.expected_mandatory, folder=bool(s.sealed_mandatory)) if s.mandatory and exists(spark, s.mandatory) else None
    check = audit.mandatory_check(wanted, messages, results, load(spark, s.outputs, "classifications")) if wanted is not None else None
    texts = {name: lines(load(spark, s.outputs, name)) for name in ARTIFACTS}
    audit.leaks(with_spans(messages), texts).write.mode("overwrite").parquet(f"{s.outputs}/leaks")
    found = spark.read.parquet(f"{s.outputs}/leaks")
    report, totals, at = audit.quality_report(results, messages, wanted, found).cache(), summary(results).cache(), now()
    write_report(validation_report(report, totals, found, at), f"{s.outputs}/validation_report")
    write_report(summary_statistics(report, totals, check, at, seconds), f"{s.outputs}/summary_statistics")
    for row in (report.first(), totals.first()):
        for name, value in row.asDict().items():
            print(f"{name}: {value}")
    for name, value in seen.get.items():
        print(f"written_{name}: {value}")
    print(f"seconds: {seconds}")
    for r in audit.issue_line(audit.output_issues(results, messages)).limit(50).collect():
        print(" ", r.line)
    return 0 if report.first().validation_status == "PASS" else 1


