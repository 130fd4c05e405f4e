"""An optional model for messages the rules leave open. It gets masked text only; its answers are read by column expressions.

The one Python stage posts prompts and returns whole rows with an answer, a status and the attempts taken, so rows are neither
lost nor doubled whatever their ids. What an answer means is a matter of VARIANT expressions in the plan.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.text import bound, squeeze, utrim
from .extract import ITEM, item_id, normalized_time

#: Answers a prompt with text; made once a partition by a factory, so that it need not be pickled. It may be called by several threads.
Provider = Callable[[str], str]
Factory = Callable[[], Provider]
THRESHOLD, REASON_CHARS, TITLE_CHARS = 0.75, 300, 120
ANSWER = "struct<text:string,status:string,attempts:int>"
_ANSWER = pa.struct([("text", pa.string()), ("status", pa.string()), ("attempts", pa.int32())])


class NotAccepted(Exception):
    """The service refuses the request for good; asking again is of no use."""


def http_provider(url: str, key: str, model: str, timeout: float = 30.0) -> Factory:
    """A factory of providers that post to a chat completion service, at temperature 0. Refusals (4xx but 408 and 429) are final."""

    def make() -> Provider:
        def ask(prompt: str) -> str:
            body = json.dumps({"model": model, "temperature": 0, "messages": [{"role": "user", "content": prompt}]}).encode()
            request = urllib.request.Request(url, body, {"Authorization": f"Bearer {key}", "Content-Type": "application/json"})
            try:
                with urllib.request.urlopen(request, timeout=timeout) as answer:
                    return json.load(answer)["choices"][0]["message"]["content"]
            except urllib.error.HTTPError as e:
                if 400 <= e.code < 500 and e.code not in (408, 429):
                    raise NotAccepted from e
                raise

        return ask

    return make


@dataclass(frozen=True)
class Manners:
    """How a partition asks: so many prompts at once, so many attempts at each, with a pause that doubles from attempt to attempt."""

    at_once: int = 8
    attempts: int = 3
    pause: float = 0.5


def _answered(ask: Provider, prompt: str, manners: Manners) -> dict:
    for n in range(1, manners.attempts + 1):
        try:
            text = ask(prompt)
            return {"text": text, "status": "answered" if text is not None else "empty", "attempts": n}
        except NotAccepted:
            return {"text": None, "status": "refused", "attempts": n}
        except Exception:  # noqa: BLE001  whatever a service does, the rules' answer stands
            if n < manners.attempts:
                time.sleep(manners.pause * 2 ** (n - 1))
    return {"text": None, "status": "failed", "attempts": manners.attempts}


def asked(rows: DataFrame, prompt: Column, factory: Factory, *, into: str = "answer", manners: Manners = Manners()) -> DataFrame:
    """rows with the answer to each one's prompt as struct<text, status, attempts>; a null prompt is not asked and has a null answer.

    The order of calls within a partition is free, at most ``at_once`` are under way, and a batch's rows go on when all its calls have ended.
    """
    here = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = None
        with ThreadPoolExecutor(manners.at_once) as pool:
            for batch in batches:
                prompts = batch.column(len(here)).to_pylist()
                if ask is None and any(p is not None for p in prompts):
                    ask = factory()
                answers = list(pool.map(lambda p: None if p is None else _answered(ask, p, manners), prompts))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(here)], pa.array(answers, _ANSWER)], names=[*here, into])

    schema = rows.select("*", F.lit(None).cast(ANSWER).alias(into)).schema
    return rows.select("*", prompt.alias("_prompt")).mapInArrow(run, schema)


# reading an answer


def _whole(text: Column) -> Column:
    """The text as VARIANT if all of it is one JSON value. The parser stops after a value; within a list and within an object nothing may follow it."""
    listed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    return F.when((F.size(listed) == 1) & F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit("}"))).isNotNull(), F.get(listed, 0))


def recovered(answer: Column, lists: bool = False) -> Column:
    """The JSON of an answer as VARIANT: what a fence holds, or all of it, else from the first opening sign to the last closing one. Null if that is none."""
    fence = r"(?sU)```(?:json)?\s*(.*?)\s*```"
    shape = r"(?s)\[.*\]|\{.*\}" if lists else r"(?s)\{.*\}"
    plain = F.when(answer.rlike(fence), F.regexp_extract(answer, fence, 1)).otherwise(utrim(answer))
    return bound(plain, lambda t: F.coalesce(_whole(t), _whole(F.regexp_extract(t, shape, 0))))


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _field(v: Column, name: str) -> Column:
    """A field of an object; a null one and one that is not there are both null."""
    found = F.try_variant_get(v, f"$.{name}", "variant")
    return F.when(_kind(found) != "VOID", found)


def _string(v: Column) -> Column:
    return F.when(_kind(v) == "STRING", v.try_cast("string"))


def _is_object(v: Column) -> Column:
    return F.coalesce(_kind(v).startswith("OBJECT"), F.lit(False))


def _of_message(v: Column, message_id: Column) -> Column:
    """Whether an object names no message or this one."""
    named = utrim(_field(v, "message_id").try_cast("string"))
    return F.coalesce(named == message_id, _field(v, "message_id").isNull())


NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def parsed_category(message_id: Column, answer: Column) -> Column:
    """struct<category, confidence, reason> of an answer; null if it is no good. The confidence is cut to 0 to 1, and 0 if it is no number."""

    def read(v: Column) -> Column:
        name = F.regexp_replace(F.translate(F.lower(utrim(_string(_field(v, "category")))), " -", "__"), "[^a-z0-9_]", "")
        raw = _field(v, "confidence")
        number = F.when(_kind(raw) == "BOOLEAN", raw.try_cast("boolean").cast("int").cast("double")).when(_kind(raw).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), raw.try_cast("double"))
        number = F.coalesce(number, F.when(_string(raw).rlike(NUMBER), _string(raw).try_cast("double")), F.lit(0.0))
        reason = F.coalesce(F.substring(utrim(_string(_field(v, "reason"))), 1, REASON_CHARS), F.lit(""))
        good = _is_object(v) & name.isin(*X.CATEGORIES) & _of_message(v, message_id)
        return F.when(good, F.struct(name.alias("category"), F.least(F.greatest(number, F.lit(0.0)), F.lit(1.0)).alias("confidence"), reason.alias("reason")))

    return bound(recovered(answer), read)


def _day(v: Column) -> tuple[Column, Column]:
    """The date of a field and whether it is wrong; an empty text is no date."""
    text = _string(v)
    day = F.coalesce(F.when(utrim(text).rlike(r"^\d{4}-\d{2}-\d{2}$"), utrim(text).try_cast("date")), F.when(utrim(text).rlike(r"^\d{8}$"), F.try_to_date(utrim(text), "yyyyMMdd")))
    return day, v.isNotNull() & F.coalesce(text != "", F.lit(True)) & day.isNull()


def parsed_items(message_id: Column, answer: Column) -> Column:
    """The items of an answer (an object with items, or a list), array<item>; null if it is no good, which one bad item makes it."""

    def item(x: Column, i: Column, kinds: Column) -> Column:
        kind = F.get(kinds, i)
        clean = lambda name: F.nullif(squeeze(_string(_field(x, name)), X.VALUE_MARKS), F.lit(""))
        n = F.size(F.filter(F.slice(kinds, F.lit(1), i + 1), lambda k: k == kind))
        level = F.lower(utrim(_string(_field(x, "priority"))))
        fields = {
            "item_id": item_id(message_id, kind, n), "type": kind, "title": F.substring(utrim(_string(_field(x, "title"))), 1, TITLE_CHARS), "description": clean("description"),
            "date": _day(_field(x, "date"))[0], "deadline": _day(_field(x, "deadline"))[0], "time": normalized_time(_string(_field(x, "time"))), "person": clean("person"),
            "priority": F.when(level.isin(*X.PRIORITIES), level).otherwise("unknown"), "source_message_id": message_id,
        }
        return F.struct(*(c.alias(k) for k, c in fields.items())).cast(ITEM)

    def bad(x: Column, kind: Column) -> Column:
        time_ = _field(x, "time")
        wrong_time = time_.isNotNull() & F.coalesce(_string(time_) != "", F.lit(True)) & normalized_time(_string(time_)).isNull()
        return ~_is_object(x) | ~F.coalesce(kind.isin(*X.ITEM_TYPES), F.lit(False)) | (F.coalesce(utrim(_string(_field(x, "title"))), F.lit("")) == "") | _day(_field(x, "date"))[1] | _day(_field(x, "deadline"))[1] | wrong_time

    def read(found: Column) -> Column:
        kinds = F.transform(found, lambda x: F.translate(F.lower(utrim(_string(_field(x, "type")))), " -", "__"))

        def made(kinds: Column) -> Column:
            faulty = F.exists(F.zip_with(found, kinds, bad), lambda b: b)
            return F.when(~faulty, F.transform(found, lambda x, i: item(x, i, kinds)))

        return bound(kinds, made)

    def listed(v: Column) -> Column:
        of_object = F.when(_is_object(v) & _of_message(v, message_id), F.try_variant_get(v, "$.items", "array<variant>"))
        return F.coalesce(of_object, F.when(~_is_object(v), F.try_variant_get(v, "$", "array<variant>")))

    return bound(bound(recovered(answer, lists=True), listed), read)


# prompts and stages


def category_prompt(message_id: Column, safe: Column) -> Column:
    head = f'Choose one category of {", ".join(X.CATEGORIES)} for the message. Answer with JSON: {{"message_id", "category", "confidence", "reason"}}.\nmessage_id: '
    return F.concat(F.lit(head), F.coalesce(message_id, F.lit("")), F.lit("\nmessage: "), F.coalesce(safe, F.lit("")))


def items_prompt(message_id: Column, safe: Column, day: Column) -> Column:
    head = 'List tasks, meetings, events and reminders that the message states, as JSON: {"message_id", "items": [{"type", "title", "description", "date", "deadline", "time", "person", "priority"}]}. Unknown fields are null. Today is '
    return F.concat(F.lit(head), F.coalesce(day.cast("string"), F.lit("unknown")), F.lit(".\nmessage_id: "), F.coalesce(message_id, F.lit("")), F.lit("\nmessage: "), F.coalesce(safe, F.lit("")))


def with_model_category(results: DataFrame, factory: Factory | None, threshold: float = THRESHOLD, manners: Manners = Manners()) -> DataFrame:
    """Classifications under the threshold are put to the model; a failed or bad answer keeps the rules' one (method llm_failed)."""
    if not 0 <= threshold <= 1:
        raise ValueError("the threshold is 0 to 1")
    if factory is None:
        return results
    c = F.col("classification")
    prompt = F.when(c["confidence"] < threshold, category_prompt(F.col("message_id"), F.col("safe_message")))
    rows = asked(results, prompt, factory, into="_answer", manners=manners).withColumn("_read", parsed_category(F.col("message_id"), F.col("_answer.text")))
    m = F.col("_read")
    method = F.when(F.col("_answer").isNull(), c["method"]).otherwise(F.when(m.isNull(), "llm_failed").otherwise("llm"))
    better = F.struct(F.coalesce(m["category"], c["category"]).alias("category"), F.coalesce(m["confidence"], c["confidence"]).alias("confidence"), F.coalesce(m["reason"], c["reason"]).alias("reason"), method.alias("method"))
    return rows.withColumn("classification", better).select(*results.columns)


def with_model_items(results: DataFrame, factory: Factory | None, manners: Manners = Manners()) -> DataFrame:
    """Messages without items are put to the model; method llm, or llm_failed where its answer is no good or has no items."""
    if factory is None:
        return results
    e = F.col("extraction")
    prompt = F.when(e["method"] == "none", items_prompt(F.col("message_id"), F.col("safe_message"), F.col("ts")))
    rows = asked(results, prompt, factory, into="_answer", manners=manners).withColumn("_read", parsed_items(F.col("message_id"), F.col("_answer.text")))
    n = F.coalesce(F.size("_read"), F.lit(0))
    reason = F.when(n > 0, F.concat(F.lit(X.MODEL_ITEMS_REASON[0]), n.cast("string"), F.lit(X.MODEL_ITEMS_REASON[1]))).otherwise(F.lit(X.NO_ITEMS_REASON))
    made = F.struct(F.coalesce(F.col("_read"), F.array().cast(f"array<{ITEM}>")).alias("items"), F.when(n > 0, "llm").otherwise("llm_failed").alias("method"), reason.alias("reason"), F.lit(False).alias("error"))
    return rows.withColumn("extraction", F.when(F.col("_answer").isNull(), e).otherwise(made)).select(*results.columns)


def failed(results: DataFrame) -> Column:
    """How many of a row's questions to the model failed: of its category and of its items."""
    return sum((F.coalesce((F.col(f"{c}.method") == "llm_failed").cast("long"), F.lit(0)) for c in ("classification", "extraction")), F.lit(0).cast("long"))


def observed(results: DataFrame, name: str = "run") -> tuple[DataFrame, Observation]:
    """results, and the counts that fill while they are written: rows, model answers of both kinds, and failures. No pass of their own is needed."""
    seen = Observation(name)
    counts = [F.count(F.lit(1)).alias("rows"), F.count_if(F.col("classification.method") == "llm").alias("categories_by_model"), F.count_if(F.col("extraction.method") == "llm").alias("items_by_model"), F.coalesce(F.sum(failed(results)), F.lit(0)).alias("failures")]
    return results.observe(seen, *counts), seen
