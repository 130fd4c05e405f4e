"""The registered queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import oracle as O
from .functions import fixed as X
from .functions.text import any_case, blank, utrim
from .operators import audit, conform, extract, validate, views
from .operators.classify import SCORES
from .operators.detect import DETECTORS, found_by, with_spans
from .operators.fallback import parsed_category, parsed_items, with_model_category, with_model_items
from .plans.analysis import analyzed, items_by_type, published, spread, summary
from .plans.run import stats, summary_statistics, validation_report
from .sources import sealed
from .sources.artifacts import final_results, lines, materialized, securities
from .sources.messages import template_messages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def messages(spark, d) -> DataFrame:
    """Template messages, spread over the cores, for queries that compute much on each."""
    return spread(template_messages(spark, d))


def results(spark, d, *columns: str) -> DataFrame:
    """The published columns named (all by default), written once: filters on computed columns then don't compute them again."""
    made = published(template_messages(spark, d))
    return materialized(made.select(*columns) if columns else made, "results")


def computed(spark, d, *columns: str) -> DataFrame:
    """The same as a lazy plan, for queries that take the columns as they are: nothing is written, what is not named is not computed."""
    return published(template_messages(spark, d)).select(*columns)


LISTED = ("message_id", "ts", "sender", "classification", "security", "row_pos")


# input: statistics and issues. Raw rows with defects by key, the same SQL in both engines.
RAW_SQL = """SELECT CASE WHEN o_orderkey % 97 = 0 THEN '  ' WHEN o_orderkey % 89 = 0 THEN 'MSG_twice' ELSE 'MSG_' || CAST(o_orderkey AS STRING) END AS message_id,
  CASE WHEN o_orderkey % 83 = 0 THEN 'yesterday' WHEN o_orderkey % 7 = 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) || ' 08:30:00' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) || ' 07:00:00' END AS timestamp,
  CASE WHEN o_orderkey % 71 = 0 THEN ' ' ELSE 'Customer' END AS sender, CASE WHEN o_orderkey % 61 = 0 THEN NULL WHEN o_orderkey % 67 = 0 THEN '  ' ELSE 'text' END AS message, o_orderkey AS row_pos FROM {orders}"""
R = f"r AS ({RAW_SQL.replace('{orders}', 'orders')})"


#: Raw rows without blank ids and bad timestamps, so that repeated ids and the order are reported.
ORDERED_SQL = """SELECT CASE WHEN o_orderkey % 89 = 0 THEN 'MSG_twice' ELSE 'MSG_' || CAST(o_orderkey AS STRING) END AS message_id, CAST(CAST(o_orderdate AS DATE) AS STRING) || ' 07:00:00' AS timestamp, 'Customer' AS sender, 'text' AS message, o_orderkey AS row_pos FROM {orders}"""


def raw_rows(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(RAW_SQL, orders=table(spark, d, "orders"))


@query("dataset_stats", f"WITH {O.M} SELECT count(*) AS total_messages, count(DISTINCT message_id) AS unique_message_ids, min(ts) AS first_ts, max(ts) AS last_ts, count(*) FILTER (trim(coalesce(message, '')) = '') AS empty_messages, count(*) FILTER (trim(sender) = '') AS empty_senders FROM m")
def _(spark, d):
    return validate.statistics(template_messages(spark, d))


@query("input_issues", f"""WITH {R}, t AS (SELECT *, TRY_CAST(timestamp AS TIMESTAMP) AS ts FROM r)
SELECT 'empty_message_id' AS code, row_pos, message_id FROM t WHERE trim(message_id) = ''
UNION ALL SELECT 'malformed_timestamp', row_pos, message_id FROM t WHERE ts IS NULL
UNION ALL SELECT 'missing_message_content', row_pos, message_id FROM t WHERE trim(coalesce(message, '')) = ''
UNION ALL SELECT 'missing_sender', row_pos, message_id FROM t WHERE trim(sender) = ''
UNION ALL SELECT 'unexpected_dataset_size', -1, NULL FROM (SELECT count(*) AS n FROM t) WHERE n <> 900""")
def _(spark, d):
    return validate.issues(raw_rows(spark, d), 900).select("code", F.coalesce("row_pos", F.lit(-1)).alias("row_pos"), "message_id")


@query("blank_fields", f"WITH {R} SELECT count(*) FILTER (trim(message_id) = '') AS ids, count(*) FILTER (trim(sender) = '') AS senders, count(*) FILTER (trim(coalesce(message, '')) = '') AS messages FROM r")
def _(spark, d):
    return raw_rows(spark, d).agg(*(F.count_if(blank(F.col(c))).alias(n) for c, n in (("message_id", "ids"), ("sender", "senders"), ("message", "messages"))))


@query("dup_ids", f"WITH {R} SELECT message_id, count(*) AS n FROM r GROUP BY message_id HAVING count(*) > 1")
def _(spark, d):
    return raw_rows(spark, d).groupBy("message_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("first_inversion", f"WITH {O.M}, l AS (SELECT row_pos, message_id, ts < lag(ts) OVER (ORDER BY row_pos) AS late FROM m) SELECT row_pos, message_id FROM l WHERE late ORDER BY row_pos LIMIT 1")
def _(spark, d):
    return validate.first_inversion(template_messages(spark, d))


@query("bad_timestamps", f"WITH {R} SELECT row_pos, timestamp FROM r WHERE TRY_CAST(timestamp AS TIMESTAMP) IS NULL")
def _(spark, d):
    from .sources.messages import parsed_timestamp

    return raw_rows(spark, d).where(parsed_timestamp(F.col("timestamp")).isNull()).select("row_pos", "timestamp")


# sensitive values
def _detect(rows: DataFrame, det, id_: str, text: str) -> DataFrame:
    return rows.where(F.col(text).rlike(det.pattern)).select(id_, F.explode(found_by(det, F.col(text))).alias("x")).select(id_, F.col("x.start").alias("start_pos"), F.col("x.end").alias("end_pos"), "x.value")


def planted(source: str, id_: str, text: str) -> str:
    """SQL of a table's whole texts; some get a token or a payment name at the end, since few have one."""
    return f"SELECT {id_}, {text} || CASE {id_} % 7 WHEN 0 THEN ' tok_demo_' || CAST({id_} AS STRING) || 'A8K29Q' WHEN 1 THEN ' pay shop' || CAST({id_} AS STRING) || '@okbank now' ELSE '' END AS {text} FROM {source}"


for _det in DETECTORS:
    query(f"detect_{_det.name}", O.detect_sql(_det))(lambda spark, d, det=_det: _detect(template_messages(spark, d), det, "message_id", "message"))
for _det in DETECTORS:
    if _det.name in ("token", "token_prefix", "card_bare", "upi_bare"):
        for _t, _id, _text in (("documents", "doc_id", "text"), ("pages", "page_id", "html")):
            query(f"{_t}_{_det.name}", O.detect_sql(_det, f"({planted('{' + _t + '}', _id, _text).replace('{' + _t + '}', _t)})", _id, _text))(
                lambda spark, d, det=_det, t=_t, id_=_id, text=_text: _detect(spark.sql(planted("{t}", id_, text), t=table(spark, d, t)), det, id_, text))


def spans(spark, d) -> DataFrame:
    return materialized(with_spans(messages(spark, d)).select("message_id", "spans")).select("message_id", F.explode("spans").alias("x"))


@query("spans_deduped", f"WITH {O.SPANS} SELECT id AS message_id, CAST(s AS INT) AS start_pos, CAST(e AS INT) AS end_pos, type, risk, mask FROM spans")
def _(spark, d):
    return spans(spark, d).select("message_id", F.col("x.start").alias("start_pos"), F.col("x.end").alias("end_pos"), "x.type", "x.risk", "x.mask")


@query("masked_text", f"WITH RECURSIVE {O.MASKED} SELECT id AS message_id, safe_message FROM safe")
def _(spark, d):
    return computed(spark, d, "message_id", "safe_message")


@query("risk_by_type", f"WITH {O.SPANS} SELECT type, risk, count(*) AS n FROM spans GROUP BY type, risk")
def _(spark, d):
    return spans(spark, d).groupBy("x.type", "x.risk").agg(F.count(F.lit(1)).alias("n"))


# categories
def lowered(rows: DataFrame, text: str) -> DataFrame:
    return rows.withColumn("low", F.lower(utrim(F.col(text))))


for _name in SCORES:
    query(f"score_{_name}", O.one_score_sql(_name))(lambda spark, d, name=_name: lowered(template_messages(spark, d), "message").select("message_id", SCORES[name](F.col("low")).alias("score")))


@query("documents_promo_score", f"SELECT doc_id, {O.score_sql('low')['promotional']} AS score FROM (SELECT doc_id, lower(trim(text)) AS low FROM documents)")
def _(spark, d):
    return lowered(table(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", SCORES["promotional"](F.col("low")).alias("score"))


@query("classify", f"WITH RECURSIVE {O.CLASSIFIED} SELECT * FROM classified")
def _(spark, d):
    return computed(spark, d, "message_id", "classification.*")


@query("category_counts", f"WITH RECURSIVE {O.CLASSIFIED} SELECT category, count(*) AS n, round(avg(confidence), 6) AS mean_confidence FROM classified GROUP BY category")
def _(spark, d):
    return computed(spark, d, "classification").groupBy("classification.category").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("classification.confidence"), 6).alias("mean_confidence"))


# items
ITEM_COLUMNS = "item_id, type, title, description, CAST(date AS STRING) AS date, CAST(deadline AS STRING) AS deadline, time, person, priority"


def items(spark, d) -> DataFrame:
    return views.tasks(results(spark, d, "row_pos", "extraction"))


@query("extract_items", f"WITH RECURSIVE {O.ITEMS} SELECT {ITEM_COLUMNS}, message_id AS source_message_id FROM items")
def _(spark, d):
    return items(spark, d).selectExpr(*ITEM_COLUMNS.split(", "), "source_message_id")


def _by_rule(rule: tuple):
    def run(spark, d):
        m = template_messages(spark, d)
        t = utrim(F.col("message"))
        hit = m.where(t.rlike(any_case(rule[1])))
        return hit.select(F.inline(F.array(extract.event_item(rule, t, F.col("message_id"), F.to_date("ts"))))).selectExpr("item_id", "type", "title", "description", "CAST(date AS STRING) AS date", "time", "priority")

    return run


for _rule in extract.RULES:
    _g = lambda k, p=_rule[1]: f"regexp_extract(t, {O.re2('(?iU)' + p)}, {k})"
    _title, _date, _time, _place = _rule[4]
    query(f"extract_{_rule[0]}", f"""WITH {O.M} SELECT upper('{_rule[2]}') || '_' || message_id AS item_id, '{_rule[2]}' AS type, {O.squeeze_sql(_g(_title))} AS title, nullif({O.squeeze_sql(_g(_place))}, '') AS description,
  CAST({O.date_sql(_g(_date), 'ref')} AS STRING) AS date, {O.time_sql(_g(_time)) if _time else 'CAST(NULL AS VARCHAR)'} AS time, {O.PRIORITY} AS priority
FROM (SELECT message_id, trim(message) AS t, CAST(ts AS DATE) AS ref FROM m) WHERE regexp_matches(t, {O.re2('(?iU)' + _rule[1])})""")(_by_rule(_rule))


@query("extract_deadlines", f"WITH {O.RAW_ITEMS} SELECT item_id, title, CAST(deadline AS STRING) AS deadline, priority FROM items WHERE message_id IN (SELECT message_id FROM ruled WHERE rule = 'deadline')")
def _(spark, d):
    m = messages(spark, d).withColumn("safe_message", F.col("message"))
    rows = materialized(extract.with_extraction(m))
    return views.tasks(rows.where(F.col("extraction.reason").rlike("deadline"))).selectExpr("item_id", "title", "CAST(deadline AS STRING) AS deadline", "priority")


@query("extract_multi_deadlines", f"WITH {O.RAW_ITEMS} SELECT item_id, title, CAST(deadline AS STRING) AS deadline, priority FROM (SELECT *, max(i) OVER (PARTITION BY message_id) AS most FROM items) WHERE most > 1")
def _(spark, d):
    m = messages(spark, d).withColumn("safe_message", F.col("message"))
    rows = materialized(extract.with_extraction(m))
    return views.tasks(rows.where(F.col("extraction.reason").rlike("distinct tasks"))).selectExpr("item_id", "title", "CAST(deadline AS STRING) AS deadline", "priority")


@query("extract_call", f"WITH {O.RAW_ITEMS} SELECT item_id, title, person, priority FROM items WHERE person IS NOT NULL")
def _(spark, d):
    m = messages(spark, d).withColumn("safe_message", F.col("message"))
    return views.tasks(materialized(extract.with_extraction(m))).where("person is not null").select("item_id", "title", "person", "priority")


DATE_WORDS = "CASE o_orderkey % 14 WHEN 0 THEN 'today' WHEN 1 THEN 'Tomorrow' WHEN 2 THEN 'yesterday' WHEN 3 THEN 'monday' WHEN 4 THEN 'next  Friday' WHEN 5 THEN 'this sunday' WHEN 6 THEN 'in a day' WHEN 7 THEN 'in three days' WHEN 8 THEN 'in 3 days' WHEN 9 THEN '2026-13-45' WHEN 10 THEN '2026-02-28' WHEN 11 THEN 'in one day' WHEN 12 THEN 'in ten days' ELSE 'wednesday' END"
TIME_WORDS = "CASE o_orderkey % 11 WHEN 0 THEN '9' WHEN 1 THEN '9 AM' WHEN 2 THEN '12 am' WHEN 3 THEN '12:30pm' WHEN 4 THEN '24' WHEN 5 THEN '25:00' WHEN 6 THEN '9:99' WHEN 7 THEN '13 pm' WHEN 8 THEN '14:30' WHEN 9 THEN '8pm ' ELSE '09:05' END"


@query("relative_dates", f"SELECT o_orderkey, raw, CAST({O.date_sql('raw', 'ref')} AS STRING) AS day FROM (SELECT o_orderkey, {DATE_WORDS} AS raw, CAST(o_orderdate AS DATE) AS ref FROM orders)")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.expr(DATE_WORDS).alias("raw"), extract.resolved_date(F.expr(DATE_WORDS), F.to_date("o_orderdate")).cast("string").alias("day"))


@query("normalized_times", f"SELECT o_orderkey, raw, {O.time_sql('raw')} AS time FROM (SELECT o_orderkey, {TIME_WORDS} AS raw FROM orders)")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.expr(TIME_WORDS).alias("raw"), extract.normalized_time(F.expr(TIME_WORDS)).alias("time"))


@query("priorities", f"WITH {O.M} SELECT message_id, {O.PRIORITY} AS priority FROM (SELECT message_id, message AS t FROM m)")
def _(spark, d):
    return template_messages(spark, d).select("message_id", extract.priority(F.col("message")).alias("priority"))


@query("items_by_type", f"WITH RECURSIVE {O.ITEMS} SELECT type, count(*) AS n FROM items GROUP BY type")
def _(spark, d):
    return items_by_type(results(spark, d, "extraction"))


@query("run_summary", f"""WITH RECURSIVE {O.ITEMS} SELECT (SELECT count(*) FROM m) AS total_messages, (SELECT count(DISTINCT id) FROM spans) AS messages_with_sensitive,
  count(DISTINCT message_id) AS messages_with_items, count(*) AS total_items, (SELECT count(*) FROM m) AS rule_based, CAST(0 AS BIGINT) AS llm_based, CAST(0 AS BIGINT) AS llm_failures,
  (SELECT string_agg(type || '=' || CAST(n AS VARCHAR), ',' ORDER BY type) FROM (SELECT type, count(*) AS n FROM items GROUP BY type)) AS items_by_type FROM items""")
def _(spark, d):
    by_type = F.array_join(F.transform(F.map_entries("items_by_type"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return summary(results(spark, d, "classification", "security", "extraction")).withColumn("items_by_type", by_type)


@query("item_lines", f"""WITH RECURSIVE {O.ITEMS} SELECT m.message_id, coalesce(string_agg(type || ': ' || title, ' · ' ORDER BY i), 'No extracted items') AS items
FROM m LEFT JOIN items USING (message_id) GROUP BY m.message_id""")
def _(spark, d):
    return views.item_line(computed(spark, d, "message_id", "extraction"))


# views
RESULT = O.CLASSIFIED + ",\nresult AS (SELECT m.message_id, m.ts, m.sender, safe_message, category, confidence, method, EXISTS (SELECT 1 FROM spans WHERE spans.id = m.message_id) AS has_sensitive, m.row_pos FROM m JOIN safe ON safe.id = m.message_id JOIN classified USING (message_id))"
LIST = "message_id, ts, sender, category, confidence, method, has_sensitive, row_pos"


@query("messages_filtered", f"WITH RECURSIVE {RESULT} SELECT {LIST} FROM result WHERE category = 'meeting_or_event' AND NOT has_sensitive")
def _(spark, d):
    return views.message_list(views.filtered_messages(results(spark, d, *LISTED), category="meeting_or_event", sensitive=False))


@query("messages_search", f"WITH RECURSIVE {RESULT} SELECT {LIST} FROM result WHERE contains(lower(message_id || ' ' || sender || ' ' || safe_message || ' ' || category), 'location: the main office. meeting')")
def _(spark, d):
    return views.message_list(views.filtered_messages(results(spark, d, *LISTED, "safe_message"), search="  Location: the main office. MEETING"))


@query("messages_page", f"WITH RECURSIVE {RESULT} SELECT {LIST} FROM result WHERE has_sensitive ORDER BY row_pos LIMIT 50 OFFSET 100")
def _(spark, d):
    return views.messages(results(spark, d, *LISTED), sensitive=True, limit=50, offset=100)


@query("message_by_id", f"WITH RECURSIVE {RESULT} SELECT message_id, sender, safe_message, category FROM result WHERE message_id = 'MSG_22'")
def _(spark, d):
    return views.message(published(template_messages(spark, d).where("message_id = 'MSG_22'")), "MSG_22").select("message_id", "sender", "safe_message", "classification.category")


@query("tasks_filtered", f"WITH RECURSIVE {O.ITEMS} SELECT item_id, type, title, priority, CAST(date AS STRING) AS date, CAST(deadline AS STRING) AS deadline FROM items WHERE type = 'task' AND coalesce(date, deadline) BETWEEN DATE '1995-01-01' AND DATE '1997-12-31'")
def _(spark, d):
    return views.filtered_tasks(results(spark, d, "row_pos", "extraction"), type="task", date_from="1995-01-01", date_to="1997-12-31").selectExpr("item_id", "type", "title", "priority", "CAST(date AS STRING) AS date", "CAST(deadline AS STRING) AS deadline")


@query("sensitive_list", f"WITH RECURSIVE {O.MASKED} SELECT m.message_id, m.sender, safe_message, m.row_pos FROM safe JOIN m ON m.message_id = safe.id WHERE id IN (SELECT id FROM spans) ORDER BY row_pos LIMIT 900")
def _(spark, d):
    return views.sensitive(results(spark, d, "message_id", "sender", "safe_message", "security", "row_pos"), limit=900).drop("detections")


MANDATORY = "SELECT CASE WHEN c_custkey % 3 = 0 THEN 'LOST_' ELSE 'MSG_' END || CAST(c_custkey AS STRING) AS message_id FROM {customer} WHERE c_custkey % 7 = 0"


def wanted(spark, d) -> DataFrame:
    return spark.sql(MANDATORY, customer=table(spark, d, "customer"))


W_ = f"w AS ({MANDATORY.replace('{customer}', 'customer')})"


@query("mandatory_semi", f"WITH RECURSIVE {RESULT}, {W_} SELECT message_id, category, row_pos FROM result WHERE message_id IN (SELECT message_id FROM w)")
def _(spark, d):
    return published(views.mandatory(template_messages(spark, d), wanted(spark, d))).select("message_id", "classification.category", "row_pos")


@query("mandatory_missing", f"WITH {O.M}, {W_} SELECT message_id FROM w WHERE message_id NOT IN (SELECT message_id FROM m)")
def _(spark, d):
    return views.mandatory_missing(template_messages(spark, d), wanted(spark, d))


# audit
@query("completeness_missing", f"WITH {O.M}, {W_} SELECT message_id FROM m WHERE message_id NOT IN (SELECT message_id FROM w)")
def _(spark, d):
    return audit.missing_ids(template_messages(spark, d), wanted(spark, d))


@query("completeness_unknown", f"WITH {O.M}, {W_} SELECT message_id FROM w WHERE message_id NOT IN (SELECT message_id FROM m)")
def _(spark, d):
    return audit.unknown_ids(template_messages(spark, d), wanted(spark, d))


@query("dup_rows", f"WITH {R} SELECT message_id, row_pos, n AS occurrence FROM (SELECT message_id, row_pos, row_number() OVER (PARTITION BY message_id ORDER BY row_pos) AS n FROM r) WHERE n > 1")
def _(spark, d):
    return audit.repeated_rows(raw_rows(spark, d)).select("message_id", "row_pos", F.col("occurrence").cast("long").alias("occurrence"))


@query("dup_item_ids", f"WITH RECURSIVE {O.ITEMS}, twice AS (SELECT item_id, row_pos, i - 1 AS pos FROM items UNION ALL SELECT item_id, row_pos + 1, i - 1 FROM items WHERE type = 'event') SELECT item_id, row_pos, CAST(pos AS INT) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY row_pos, pos) AS n FROM twice) WHERE n > 1")
def _(spark, d):
    t = items(spark, d).select("item_id", "row_pos", "pos", "type")
    twice = t.unionByName(t.where("type = 'event'").withColumn("row_pos", F.col("row_pos") + 1))
    return audit.repeated_items(twice).select("item_id", "row_pos", "pos")


#: A line of a message; some get the code of another message inside a longer token.
LEAKY = "safe_message || CASE WHEN row_pos % 53 = 0 THEN ' ref x' || CAST(100000 + (row_pos * 48 * 7919) % 900000 AS STRING) || 'y' ELSE '' END"


@query("leak_scan", f"""WITH RECURSIVE {O.MASKED}, lines AS MATERIALIZED (SELECT {LEAKY} AS line FROM safe JOIN m ON m.message_id = safe.id),
found AS MATERIALIZED (SELECT id, type, s, value FROM spans),
leaked AS MATERIALIZED (SELECT value FROM (SELECT DISTINCT value FROM found) v WHERE EXISTS (SELECT 1 FROM lines WHERE contains(lines.line, v.value)))
SELECT id AS message_id, type, CAST(s AS INT) AS start_pos, 'final' AS artifact FROM found WHERE value IN (SELECT value FROM leaked)""")
def _(spark, d):
    detected = materialized(analyzed(template_messages(spark, d)).select("message_id", "row_pos", "spans", "safe_message"))
    return audit.leaks(detected, {"final": detected.selectExpr(f"{LEAKY} AS line")}).select("message_id", "type", F.col("start").alias("start_pos"), "artifact")


@query("leak_scan_unmasked", f"WITH {O.SPANS} SELECT spans.id AS message_id, spans.type, CAST(spans.s AS INT) AS start_pos FROM spans")
def _(spark, d):
    m = messages(spark, d)
    found = materialized(with_spans(m).select("message_id", "spans"))
    return audit.leaks(found, {"messages": m.select(F.col("message").alias("line"))}).select("message_id", "type", F.col("start").alias("start_pos"))


@query("leak_texts", f"WITH {O.SPANS} SELECT id AS message_id, type AS sensitivity_type, 'messages' AS artifact FROM spans")
def _(spark, d):
    m = messages(spark, d)
    found = audit.leaks(materialized(with_spans(m).select("message_id", "spans")), {"messages": m.select(F.col("message").alias("line"))})
    return audit.leak_texts(found).select("finding.message_id", "finding.sensitivity_type", "finding.artifact")


def damaged(rows: DataFrame) -> DataFrame:
    """Results with planted faults by row_pos: lost, repeated and invented messages, wrong categories and confidences."""
    c = F.col("classification")
    at = lambda n: F.col("row_pos") % n == 0
    faulty = c.withField("category", F.when(at(301), "nonsense").otherwise(c["category"])).withField("confidence", F.when(at(307), 1.5).otherwise(c["confidence"]))
    lost = rows.where(~at(501)).withColumn("classification", faulty)
    again, invented = lost.where(at(401)), lost.where(at(601)).withColumn("message_id", F.concat(F.lit("NEW_"), "message_id"))
    return lost.unionByName(again).unionByName(invented)


DAMAGED = """k AS (SELECT message_id, row_pos FROM m), d1 AS (SELECT * FROM k WHERE row_pos % 501 <> 0),
dam AS (SELECT * FROM d1 UNION ALL SELECT * FROM d1 WHERE row_pos % 401 = 0 UNION ALL SELECT 'NEW_' || message_id, row_pos FROM d1 WHERE row_pos % 601 = 0)"""
GOOD = ("message_id", "row_pos", "classification", "security", "extraction")


@query("quality_report", f"""WITH RECURSIVE {O.ITEMS}, {DAMAGED}, {W_}, c AS (SELECT row_pos, count(*) AS n FROM dam GROUP BY row_pos),
it AS MATERIALIZED (SELECT row_pos, count(*) AS n FROM items GROUP BY row_pos), se AS MATERIALIZED (SELECT DISTINCT id FROM spans)
SELECT (SELECT count(*) FROM m) AS total_input_messages, (SELECT count(*) FROM dam) AS classified_messages, (SELECT count(*) FROM m WHERE row_pos % 501 = 0) AS missing_message_ids,
  (SELECT count(*) - count(DISTINCT message_id) FROM dam) AS duplicate_message_ids, (SELECT count(*) FROM dam WHERE row_pos % 301 = 0) AS invalid_categories, (SELECT count(*) FROM dam WHERE row_pos % 307 = 0) AS invalid_confidence_scores,
  (SELECT CAST(sum(c.n * it.n) AS BIGINT) FROM c JOIN it USING (row_pos)) AS task_event_count, (SELECT count(*) FROM dam JOIN m USING (row_pos) WHERE m.message_id IN (SELECT id FROM se)) AS sensitive_message_count,
  (SELECT count(*) FROM w WHERE message_id IN (SELECT message_id FROM m)) AS mandatory_messages_found, (SELECT count(*) FROM w WHERE message_id IN (SELECT message_id FROM dam)) AS mandatory_messages_processed,
  (SELECT count(*) FROM w WHERE message_id NOT IN (SELECT message_id FROM dam)) AS mandatory_messages_missing, 'FAIL' AS sensitive_value_leak_check, 'FAIL' AS validation_status""")
def _(spark, d):
    m = template_messages(spark, d)
    return audit.quality_report(damaged(results(spark, d, *GOOD)), m, wanted(spark, d), m.select("message_id")).drop("issues")


@query("quality_report_clean", f"WITH {O.M} SELECT count(*) AS total_input_messages, count(*) AS classified_messages, CAST(0 AS BIGINT) AS missing_message_ids, CAST(0 AS BIGINT) AS duplicate_message_ids, CAST(0 AS BIGINT) AS issues, 'PASS' AS sensitive_value_leak_check, 'PASS' AS validation_status FROM m")
def _(spark, d):
    found = audit.quality_report(results(spark, d, *GOOD), template_messages(spark, d))
    return found.select("total_input_messages", "classified_messages", "missing_message_ids", "duplicate_message_ids", "issues", "sensitive_value_leak_check", "validation_status")


@query("artifact_issues", f"""WITH {O.M}, {DAMAGED} SELECT 'missing_message_id' AS code, message_id FROM m WHERE row_pos % 501 = 0
UNION ALL SELECT 'unknown_message_id', message_id FROM dam WHERE message_id LIKE 'NEW%' UNION ALL SELECT 'duplicate_message_id', message_id FROM dam GROUP BY message_id HAVING count(*) > 1""")
def _(spark, d):
    m = template_messages(spark, d)
    keyed = m.withColumn("classification", F.struct(F.lit("a").alias("category"), F.lit(1.0).alias("confidence")))
    return audit.artifact_issues(damaged(keyed), m, "classifications").select("code", "message_id")


@query("artifact_counts", f"""WITH {O.M}, {DAMAGED} SELECT 'classifications' AS artifact, count(*) AS n FROM dam UNION ALL SELECT 'sensitive_detections', count(*) FROM m UNION ALL SELECT 'tasks_events', count(*) FROM m""")
def _(spark, d):
    m = template_messages(spark, d)
    keyed = m.withColumn("classification", F.struct(F.lit("a").alias("category"), F.lit(1.0).alias("confidence")))
    return audit.artifact_counts({"classifications": damaged(keyed), "sensitive_detections": m, "tasks_events": m})


@query("mandatory_check", f"""WITH {O.M}, {W_}, g AS (SELECT message_id FROM w UNION ALL SELECT message_id FROM w WHERE message_id LIKE '%4')
SELECT (SELECT count(*) FROM g) AS provided, (SELECT count(*) FROM w) AS unique_ids, (SELECT count(*) FROM w WHERE message_id LIKE '%4') AS duplicates, count(*) FILTER (m.message_id IS NULL) AS missing_from_dataset,
  count(*) FILTER (m.message_id IS NULL OR m.row_pos % 5 = 0) AS not_processed, count(*) FILTER (m.row_pos % 5 <> 0 AND m.row_pos % 11 = 0) AS not_classified, false AS ok
FROM w LEFT JOIN m USING (message_id)""")
def _(spark, d):
    w, m = wanted(spark, d), template_messages(spark, d)
    return audit.mandatory_check(w.unionByName(w.where("message_id LIKE '%4'")), m, m.where("row_pos % 5 <> 0"), m.where("row_pos % 11 <> 0"))


@query("mandatory_not_classified", f"WITH {O.M}, {W_} SELECT message_id FROM w WHERE message_id IN (SELECT message_id FROM m WHERE row_pos % 5 <> 0) AND message_id NOT IN (SELECT message_id FROM m WHERE row_pos % 11 <> 0)")
def _(spark, d):
    m = template_messages(spark, d)
    return views.mandatory_missing(m.where("row_pos % 11 <> 0"), wanted(spark, d).join(m.where("row_pos % 5 <> 0"), "message_id", "left_semi"))


@query("messages_total", f"WITH RECURSIVE {RESULT} SELECT count(*) AS total, 100 AS page_offset, 50 AS page_limit, least(greatest(count(*) - 100, 0), 50) AS n_items FROM result WHERE has_sensitive")
def _(spark, d):
    return views.counted(results(spark, d, *LISTED), sensitive=True, limit=50, offset=100).select("total", "page_offset", "page_limit", F.size("items").cast("long").alias("n_items"))


@query("summary_statistics", f"""WITH RECURSIVE {O.ITEMS} SELECT (SELECT count(*) FROM m) AS total_messages, (SELECT count(*) FROM m) AS classified_messages, (SELECT count(DISTINCT id) FROM spans) AS sensitive_messages,
  count(*) AS task_event_count, (SELECT count(*) FROM m) AS rule_based_classifications, CAST(0 AS BIGINT) AS failures, 'PASS' AS validation_status, 'PASS' AS leak_check FROM items""")
def _(spark, d):
    r = results(spark, d, *GOOD)
    made = summary_statistics(audit.quality_report(r, template_messages(spark, d)), summary(r), None, "", 0.0)
    return made.select("total_messages", "classified_messages", "sensitive_messages", "task_event_count", "rule_based_classifications", "failures", "validation_status", "leak_check")


@query("stats_view", f"""WITH RECURSIVE {O.ITEMS} SELECT (SELECT count(*) FROM m) AS total_messages, (SELECT count(*) FROM m) AS classified_messages, (SELECT count(DISTINCT id) FROM spans) AS sensitive_messages,
  count(*) AS task_event_count, (SELECT count(*) FROM m) AS rule_based_count, CAST(0 AS BIGINT) AS llm_fallback_count, 'PASS' AS validation_status FROM items""")
def _(spark, d):
    r, none = results(spark, d, *GOOD), spark.createDataFrame([], "message_id string, type string, artifact string, start int")
    return stats(validation_report(audit.quality_report(r, template_messages(spark, d)), summary(r), none, ""))


@query("artifact_lines")
def _(spark, d):
    return lines(final_results(results(spark, d)).drop("row_pos"))


def _stub():
    """A provider that answers by rule, to test the way there and back."""

    def ask(prompt: str) -> str:
        if prompt.startswith("List"):
            return '```json\n{"items": [{"type": "Task", "title": "look into it", "priority": "low", "time": null}]}\n```' if "material" in prompt else "no idea"
        return '{"category": "General Information", "confidence": "0.9", "reason": "stub"}' if "cafeteria" in prompt else "no idea"

    return ask


@query("llm_fallback_stub", f"""WITH RECURSIVE {O.CLASSIFIED}{O.ITEMS.removeprefix(O.MASKED)}
SELECT CASE WHEN confidence >= 0.75 THEN 'rule_based' WHEN contains(safe_message, 'cafeteria') THEN 'llm' ELSE 'llm_failed' END AS category_method,
  CASE WHEN rule <> 'none' THEN 'rule_based' WHEN contains(safe_message, 'material') THEN 'llm' ELSE 'llm_failed' END AS items_method,
  CASE WHEN confidence < 0.75 AND contains(safe_message, 'cafeteria') THEN 'general_information' ELSE category END AS category, count(*) AS n
FROM classified JOIN safe ON safe.id = classified.message_id JOIN ruled USING (message_id) GROUP BY 1, 2, 3""")
def _(spark, d):
    asked = with_model_items(with_model_category(results(spark, d), lambda: _stub()), lambda: _stub())
    return asked.groupBy(F.col("classification.method").alias("category_method"), F.col("extraction.method").alias("items_method"), F.col("classification.category").alias("category")).agg(F.count(F.lit(1)).alias("n"))


# answers of a model, by key; the same SQL in both engines
def _cases(answers: tuple[str, ...]) -> str:
    cases = " ".join(f"WHEN {i} THEN {a}" for i, a in enumerate(answers))
    return f"CASE o_orderkey % {len(answers)} {cases} END AS answer"


def answers(spark, d, cases: str) -> DataFrame:
    return table(spark, d, "orders").selectExpr("o_orderkey", "CAST(o_orderkey AS STRING) AS k").selectExpr("o_orderkey", "'MSG_' || k AS message_id", cases)


CATEGORY_ANSWERS = _cases((
    """'{"message_id": "MSG_' || k || '", "category": "Promotional", "confidence": 0.8, "reason": " because of ' || k || ' "}'""",
    """'Here: ```json {"category": "action-required", "confidence": "0.75", "reason": "asked"} ``` bye'""",
    """'Sure! {"category": " meeting or event ", "confidence": 2} ok'""",
    """'{"category": "promotional"'""",
    """'{"message_id": "MSG_x' || k || '", "category": "promotional", "confidence": 1}'""",
    """'[{"category": "promotional"}]'""",
    """'{"category": "nonsense ' || k || '", "confidence": 1}'""",
    """''""",
    """'{"category": "personal_information!", "confidence": "high"}'""",
    """'{"category": null, "confidence": 1}'""",
    """'{"category": "general_information", "confidence": true, "reason": 5}'""",
    """'{"category": "general_information", "confidence": -3, "message_id": null, "reason": "' || repeat('r', 400) || '"}'""",
    """'{"category": "promotional"} {"category": "promotional"}'""",
    """'{"category": "sensitive_information", "confidence": "' || k || 'e-6", "extra": {"category": [1, 2]}}'""",
))
ITEM_ANSWERS = _cases((
    """'{"items": [{"type": "Task", "title": " Pay bill ' || k || ' ", "deadline": "2026-02-03", "priority": "HIGH"}, {"type": "task", "title": "b", "priority": 3}, {"type": "event", "title": "c"}]}'""",
    """'```[{"type": "reminder", "title": "call", "time": "9 pm", "person": " (Maya  K). ", "date": ""}]```'""",
    """'So [{"type": "meeting", "title": "sync ' || k || '", "date": " 2026-12-31 ", "time": "", "description": "in (Room 2)"}] it is'""",
    """'{"items": [{"type": "task", "title": "good"}, {"type": "task", "title": "  "}]}'""",
    """'{"items": [{"type": "task", "title": "t", "date": "2026-02-30"}]}'""",
    """'{"items": [{"type": "task", "title": "t", "time": "25:00"}]}'""",
    """'{"message_id": "MSG_x", "items": [{"type": "task", "title": "t"}]}'""",
    """'{"items": null}'""",
    """'{"items": {"type": "task", "title": "t"}}'""",
    """'{"items": []}'""",
    """'{"items": [{"type": "task", "title": "t"}, "task"]}'""",
    """'{"items": [{"type": "party", "title": "t"}]}'""",
    """'nothing to do'""",
    """'{"message_id": "MSG_' || k || '", "items": [{"type": "task", "title": "' || repeat('t', 200) || '", "description": 7, "person": "", "priority": "unheard of"}]}'""",
    """'{"items": [{"type": "task", "title": "t", "deadline": 20260203}]}'""",
))
FENCE = "'(?s)```(?:json)?\\s*(.*?)\\s*```'"


def _recovered_sql(source: str, shape: str) -> str:
    return f"""a AS (SELECT o_orderkey, 'MSG_' || k AS message_id, {source} FROM (SELECT o_orderkey, CAST(o_orderkey AS STRING) AS k FROM orders)), t AS (SELECT *, CASE WHEN regexp_matches(answer, {FENCE}) THEN regexp_extract(answer, {FENCE}, 1) ELSE trim(answer) END AS t FROM a),
r AS (SELECT *, CASE WHEN json_valid(t) THEN t WHEN json_valid(regexp_extract(t, '{shape}')) THEN regexp_extract(t, '{shape}') END AS j FROM t)"""


def _text_sql(j: str, name: str) -> str:
    return f"CASE WHEN json_type({j}, '$.{name}') = 'VARCHAR' THEN json_extract_string({j}, '$.{name}') END"


_OWN = "(coalesce(json_type(j, '$.message_id'), 'NULL') = 'NULL' OR trim(json_extract_string(j, '$.message_id')) = message_id)"


@query("model_categories", f"""WITH {_recovered_sql(CATEGORY_ANSWERS, r'(?s)\{.*\}')},
c AS (SELECT *, regexp_replace(translate(lower(trim({_text_sql('j', 'category')})), ' -', '__'), '[^a-z0-9_]', '', 'g') AS category, CASE json_type(j, '$.confidence') WHEN 'BOOLEAN' THEN CAST(CAST(json_extract_string(j, '$.confidence') AS BOOLEAN) AS INT) ELSE TRY_CAST(json_extract_string(j, '$.confidence') AS DOUBLE) END AS n FROM r)
SELECT o_orderkey, g AS accepted, CASE WHEN g THEN category END AS category, CASE WHEN g THEN CAST(least(greatest(coalesce(n, 0), 0), 1) AS DOUBLE) END AS confidence, CASE WHEN g THEN substr(trim(coalesce({_text_sql('j', 'reason')}, '')), 1, 300) END AS reason
FROM (SELECT *, coalesce(json_type(j) = 'OBJECT' AND category IN ({', '.join(map(O.lit, X.CATEGORIES))}) AND {_OWN}, false) AS g FROM c)""")
def _(spark, d):
    return answers(spark, d, CATEGORY_ANSWERS).select("o_orderkey", parsed_category(F.col("message_id"), F.col("answer")).alias("x")).select("o_orderkey", F.col("x").isNotNull().alias("accepted"), "x.*")


_DAY = "CASE WHEN regexp_matches(trim({0}), '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN TRY_CAST(trim({0}) AS DATE) END"
_day_sql = lambda n: _DAY.format(f"({_text_sql('x', n)})")
_given = lambda n: f"coalesce(json_type(x, '$.{n}'), 'NULL') <> 'NULL' AND coalesce(({_text_sql('x', n)}) <> '', true)"
_clean_sql = lambda n: f"nullif({O.squeeze_sql('(' + _text_sql('x', n) + ')')}, '')"


@query("model_items", f"""WITH {_recovered_sql(ITEM_ANSWERS, r'(?s)\[.*\]|\{.*\}')},
l AS (SELECT o_orderkey, message_id, CASE WHEN json_type(j) = 'ARRAY' THEN json_extract(j, '$[*]') WHEN json_type(j) = 'OBJECT' AND {_OWN} AND json_type(j, '$.items') = 'ARRAY' THEN json_extract(j, '$.items[*]') END AS items FROM r),
i AS (SELECT o_orderkey, message_id, x, i, translate(lower(trim({_text_sql('x', 'type')})), ' -', '__') AS type FROM (SELECT *, unnest(items) AS x, unnest(range(1, len(items) + 1)) AS i FROM l)),
v AS (SELECT *, coalesce(json_type(x) = 'OBJECT' AND type IN ({', '.join(map(O.lit, X.ITEM_TYPES))}) AND trim({_text_sql('x', 'title')}) <> '', false) AND NOT ({_given('date')} AND ({_day_sql('date')}) IS NULL)
  AND NOT ({_given('deadline')} AND ({_day_sql('deadline')}) IS NULL) AND NOT ({_given('time')} AND ({O.time_sql('(' + _text_sql('x', 'time') + ')')}) IS NULL) AS good FROM i),
n AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey, type ORDER BY i) AS k, bool_and(good) OVER (PARTITION BY o_orderkey) AS fine FROM v),
lost AS (SELECT o_orderkey FROM l WHERE items IS NULL UNION ALL SELECT DISTINCT o_orderkey FROM n WHERE NOT fine)
SELECT o_orderkey, upper(type) || '_' || message_id || CASE WHEN k > 1 THEN '-' || CAST(k AS VARCHAR) ELSE '' END AS item_id, type, substr(trim({_text_sql('x', 'title')}), 1, 120) AS title, {_clean_sql('description')} AS description,
  CAST({_day_sql('date')} AS STRING) AS date, CAST({_day_sql('deadline')} AS STRING) AS deadline, {O.time_sql('(' + _text_sql('x', 'time') + ')')} AS time, {_clean_sql('person')} AS person,
  CASE WHEN lower(trim({_text_sql('x', 'priority')})) IN ({', '.join(map(O.lit, X.PRIORITIES))}) THEN lower(trim({_text_sql('x', 'priority')})) ELSE 'unknown' END AS priority FROM n WHERE fine
UNION ALL SELECT o_orderkey, 'rejected', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM lost""")
def _(spark, d):
    rows = answers(spark, d, ITEM_ANSWERS).select("o_orderkey", parsed_items(F.col("message_id"), F.col("answer")).alias("items"))
    one = rows.select("o_orderkey", F.explode(F.coalesce("items", F.array(F.lit(None).cast(extract.ITEM)))).alias("x"))
    return one.selectExpr("o_orderkey", "coalesce(x.item_id, 'rejected') AS item_id", "x.type", "x.title", "x.description", "CAST(x.date AS STRING) AS date", "CAST(x.deadline AS STRING) AS deadline", "x.time", "x.person", "x.priority")


@query("messages_deep_page", f"WITH RECURSIVE {RESULT}, n AS (SELECT *, row_number() OVER (ORDER BY row_pos) AS k, count(*) OVER () AS most FROM result) SELECT {LIST} FROM n WHERE k > most * 99 // 100 AND k <= most * 99 // 100 + 50")
def _(spark, d):
    r = results(spark, d, *LISTED)
    return views.messages(r, limit=50, offset=r.count() * 99 // 100)


@query("tasks_total", f"WITH RECURSIVE {O.ITEMS}, n AS (SELECT * FROM items WHERE priority = 'unknown' ORDER BY row_pos, i LIMIT 20 OFFSET 40) SELECT (SELECT count(*) FROM items WHERE priority = 'unknown') AS total, 40 AS page_offset, 20 AS page_limit, string_agg(item_id, ',' ORDER BY row_pos, i) AS ids FROM n")
def _(spark, d):
    made = views.counted_tasks(results(spark, d, "row_pos", "extraction"), priority="unknown", limit=20, offset=40)
    return made.select("total", "page_offset", "page_limit", F.array_join(F.transform("items", lambda x: x["item_id"]), ",").alias("ids"))


@query("sensitive_total", f"WITH RECURSIVE {O.MASKED}, s AS MATERIALIZED (SELECT DISTINCT id FROM spans), n AS (SELECT m.message_id, m.row_pos FROM m JOIN s ON s.id = m.message_id ORDER BY row_pos LIMIT 25 OFFSET 75) SELECT (SELECT count(*) FROM s) AS total, 75 AS page_offset, 25 AS page_limit, string_agg(message_id, ',' ORDER BY row_pos) AS ids FROM n")
def _(spark, d):
    made = views.counted_sensitive(results(spark, d, "message_id", "sender", "safe_message", "security", "row_pos"), limit=25, offset=75)
    return made.select("total", "page_offset", "page_limit", F.array_join(F.transform("items", lambda x: x["message_id"]), ",").alias("ids"))


@query("sensitive_detections", f"WITH {O.SPANS} SELECT id AS message_id, type AS sensitivity_type, risk, mask AS masked_text, CASE type {' '.join(f'WHEN {O.lit(k)} THEN {O.lit(v[2])}' for k, v in X.SENSITIVE_TYPES.items())} END AS recommended_action FROM spans")
def _(spark, d):
    rows = securities(results(spark, d, "message_id", "security"))
    return rows.select("message_id", F.explode("detections").alias("x")).select("message_id", "x.sensitivity_type", "x.risk", "x.masked_text", "x.recommended_action")


@query("extraction_reasons", f"""WITH RECURSIVE {O.ITEMS}, c AS (SELECT message_id, count(*) AS n, max(person) AS person FROM items GROUP BY message_id)
SELECT message_id, CASE rule {' '.join(f"WHEN '{r[0]}' THEN 'Matched a {r[3]} with an explicit date{' and time' if r[4][2] else ''}.'" for r in extract.RULES)}
  WHEN 'deadline' THEN CASE WHEN n > 1 THEN 'Matched ' || CAST(n AS VARCHAR) || ' distinct tasks with explicit deadlines.' ELSE 'Matched a task with an explicit deadline.' END
  WHEN 'call' THEN 'Matched a call request naming ' || person || '.' ELSE {O.lit(X.NO_ITEMS_REASON)} END AS reason FROM ruled LEFT JOIN c USING (message_id)""")
def _(spark, d):
    return computed(spark, d, "message_id", "extraction.reason")


@query("input_issues_ordered", f"""WITH r AS ({ORDERED_SQL.replace('{orders}', 'orders')}), l AS (SELECT *, CAST(timestamp AS TIMESTAMP) < lag(CAST(timestamp AS TIMESTAMP)) OVER (ORDER BY row_pos) AS late FROM r)
SELECT 'duplicate_message_id' AS code, -1 AS row_pos, message_id, CAST(count(*) AS VARCHAR) || ' rows' AS detail FROM r GROUP BY message_id HAVING count(*) > 1
UNION ALL SELECT * FROM (SELECT 'not_chronological', row_pos, message_id, 'earlier than the row before' FROM l WHERE late ORDER BY row_pos LIMIT 1)""")
def _(spark, d):
    found = validate.issues(spark.sql(ORDERED_SQL, orders=table(spark, d, "orders")))
    return found.select("code", F.coalesce("row_pos", F.lit(-1)).alias("row_pos"), "message_id", "detail")


#: Records of an artifact, some with faults by key; the same SQL in both engines.
RECORDS = _cases((
    """'{"message_id": "M' || k || '", "confidence": 0.5, "items": [{"title": "a", "day": "2026-01-02"}, {"title": "b", "day": null}]}'""",
    """'{"message_id": "M' || k || '", "confidence": 1, "items": [], "extra": {"a": 1}}'""",
    """'{"message_id": "M' || k || '", "items": []}'""",
    """'{"message_id": "M' || k || '", "confidence": "0.5", "items": []}'""",
    """'{"message_id": ' || k || ', "confidence": 0.5, "items": [{"title": "a", "day": "2026-13-02"}, {"day": null, "more": 1}, 7]}'""",
    """'[' || k || ']'""",
    """'{"message_id": "M' || k || '"'""",
    """'{"message_id": null, "confidence": null, "items": {"title": "a"}}'""",
))


@query("record_faults", f"""WITH f(m, path, code, found) AS (VALUES (1, 'extra', 'unexpected', NULL), (2, 'confidence', 'missing', NULL), (3, 'confidence', 'mistyped', 'STRING'), (4, 'message_id', 'mistyped', 'BIGINT'), (4, 'items[0].day', 'mistyped', 'STRING'),
  (4, 'items[1].title', 'missing', NULL), (4, 'items[1].more', 'unexpected', NULL), (4, 'items[2]', 'mistyped', 'BIGINT'), (5, '', 'mistyped', 'ARRAY'), (6, '', 'malformed', NULL), (7, 'message_id', 'null', 'VOID'), (7, 'items', 'mistyped', 'OBJECT'))
SELECT o_orderkey, path, code, found FROM orders JOIN f ON o_orderkey % 8 = m""")
def _(spark, d):
    lines_ = answers(spark, d, RECORDS).select("o_orderkey", F.col("answer").alias("line"))
    return conform.faults(lines_, "message_id string not null, confidence double, items array<struct<title: string, day: date>>")


@query("row_issues", f"""WITH RECURSIVE {O.ITEMS}, h AS (SELECT DISTINCT message_id, row_pos FROM items), t AS (SELECT DISTINCT message_id, row_pos FROM items WHERE row_pos % 11 = 0)
SELECT 'foreign_item' AS code, message_id FROM h WHERE row_pos % 7 = 0 UNION ALL SELECT 'invalid_time', message_id FROM t
UNION ALL SELECT 'missing_reason', message_id FROM m WHERE row_pos % 13 = 0 UNION ALL SELECT 'detection_mismatch', message_id FROM m WHERE row_pos % 17 = 0 UNION ALL SELECT 'sensitive_mismatch', message_id FROM m WHERE row_pos % 17 = 0""")
def _(spark, d):
    at = lambda n: F.col("row_pos") % n == 0
    changed = lambda x: x.withField("source_message_id", F.when(at(7), "other").otherwise(x["source_message_id"])).withField("time", F.when(at(11), "24:30").otherwise(x["time"]))
    c, e, sec = F.col("classification"), F.col("extraction"), F.col("security")
    rows = results(spark, d, *GOOD)
    rows = rows.withColumn("extraction", e.withField("items", F.transform(e["items"], changed))).withColumn("classification", c.withField("reason", F.when(at(13), "").otherwise(c["reason"])))
    rows = rows.withColumn("security", sec.withField("has_detection", F.when(at(17), ~sec["has_detection"]).otherwise(sec["has_detection"])))
    return audit.row_issues(rows).select("code", "message_id")


@query("sealed_round_trip", "SELECT c_custkey, c_name, true AS hidden FROM customer")
def _(spark, d):
    key = sealed.key_of(sealed.new_key())
    tokens = materialized(sealed.seal(table(spark, d, "customer").select("c_custkey", "c_name", F.col("c_name").alias("token")), "token", key), "sealed")
    back = sealed.opened(tokens.withColumn("hidden", ~F.contains("token", "c_name")).drop("c_name"), "token", key)
    return back.select("c_custkey", F.decode("token", "UTF-8").alias("c_name"), "hidden")


@query("events_daily_categories", "SELECT CAST(CAST(ts AS DATE) AS STRING) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    return table(spark, d, "events").groupBy(F.to_date("ts").cast("string").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("conversation_turns", "SELECT conv_id, turn, role, length(text) AS n_chars, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations")
def _(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.char_length("text").cast("long").alias("n_chars"), F.lag("role").over(W.partitionBy("conv_id").orderBy("turn")).alias("before"))
