"""Phrases with known outcomes, and a Python twin for spans, dedup and masks."""

import datetime
import http.server
import json
import re
import threading
import time

import pytest
from missive.functions import fixed as X
from missive.operators import audit, conform, extract, fallback, validate, views
from missive.operators.detect import DETECTORS, with_safe_text, with_spans
from missive.operators.fallback import with_model_category, with_model_items
from missive.plans import run as runs
from missive.plans.analysis import published, summary
from missive.sources import artifacts
from missive.sources.artifacts import materialized
from missive.sources.messages import read_csv, typed
from pyspark.sql import functions as F

TS = datetime.datetime(2026, 9, 1, 8)
SCHEMA = "message_id string, ts timestamp_ntz, sender string, message string, row_pos long"


def frame(spark, texts):
    return spark.createDataFrame([(f"T{i:03}", TS, "Meera", t, i) for i, t in enumerate(texts)], SCHEMA)


MASKS = {
    "Your OTP is 482913": "Your OTP is ******",
    "Password is BlueRiver#29": "Password is ************",
    "My card number is 4111 1111 1111 1111": "My card number is *******************",
    "My home address is 42 Lake View Road, Chennai-45.": "My home address is [REDACTED_ADDRESS].",
    "The access token is tok_demo_A8K29Q": "The access token is [REDACTED_TOKEN]",
    "My recent test result says vitamin D deficiency-97.": "My recent [REDACTED_HEALTH].",
    "Use code SAVE17 for a 10% discount.": None,
    "The password is on the portal.": None,
    "My address is on file.": None,
    "Your OTP is ******": None,
    "wifi password guest77!": "wifi password *******!",
}
CATEGORIES = {
    "Please submit the report by 2026-09-04.": "action_required",
    "Family dinner tomorrow at 10:00 at the library.": "meeting_or_event",
    "Exclusive offer: get 50% off this weekend.": "promotional",
    "I am vegetarian and my t-shirt size is M.": "personal_information",
    "The training material is on the portal.": "general_information",
    "Your OTP is 482913": "sensitive_information",
}
ITEMS = {
    "Calendar update: family dinner, 2026-09-19 at 10:00, the library.": [("event", "family dinner", "2026-09-19", None, "10:00", "the library")],
    "Reminder: mentor catch-up happens on 2026-09-16 at 11:00 in the city clinic.": [("reminder", "mentor catch-up", "2026-09-16", None, "11:00", "the city clinic")],
    "The client discussion is scheduled for 2026-09-07 at 14:00 in Zoom.": [("meeting", "client discussion", "2026-09-07", None, "14:00", "Zoom")],
    "Please join the internship orientation on 2026-09-18, 9:00 at Conference Room 2.": [("event", "internship orientation", "2026-09-18", None, "09:00", "Conference Room 2")],
    "Are you available for the design review at 14:00 on 2026-09-15? Location: the main office.": [("meeting", "design review", "2026-09-15", None, "14:00", "the main office")],
    "The product demo is scheduled for 2026-09-17 in Zoom.": [("meeting", "product demo", "2026-09-17", None, None, "Zoom")],
    "Please call Maya when you are free.": [("task", "call maya", None, None, None, None)],
    "Submit the report by 2026-09-04 and pay the bill by 2026-09-09.": [("task", "submit the report", None, "2026-09-04", None, None), ("task", "pay the bill", None, "2026-09-09", None, None)],
    "Please submit the report by tomorrow.": [("task", "submit the report", None, "2026-09-02", None, None)],
    "reply before in 3 days": [("task", "reply", None, None, None, None)],
    "The cafeteria closes at 8 PM.": [],
    "Calendar update: audit, 2026-13-45 at 45, hall": [("event", "audit", None, None, None, "hall")],
}


@pytest.fixture(scope="module")
def results(spark):
    return materialized(published(frame(spark, [*MASKS, *CATEGORIES, *ITEMS, None, "  "])))


def test_masks(results):
    got = [r.safe_message for r in results.orderBy("row_pos").collect()]
    assert got[: len(MASKS)] == [v if v else k for k, v in MASKS.items()]
    assert got[-2:] == [None, "  "]


def test_categories(results):
    got = [r.category for r in results.orderBy("row_pos").select("classification.category").collect()]
    assert got[len(MASKS) : len(MASKS) + len(CATEGORIES)] == list(CATEGORIES.values())


def test_items(results):
    rows = results.orderBy("row_pos").collect()[len(MASKS) + len(CATEGORIES) :]
    day = lambda d: d and str(d)
    for row, want in zip(rows, ITEMS.values(), strict=False):
        assert [(x.type, x.title, day(x.date), day(x.deadline), x.time, x.description) for x in row.extraction["items"]] == want
    assert [r.extraction.error for r in rows[: len(ITEMS)]] == [k.startswith("Calendar update: audit") or "3 days" in k for k in ITEMS]


def twin(text):
    """Spans by Python's own search."""
    plausible = lambda v: len(v) >= 4 and not re.match(X.STARS, v) and not re.match(X.REDACTED, v) and not re.match(X.PLAIN_WORD, v)
    upi = lambda v: "@" in v and all(v.rpartition("@")[::2]) and "." not in v.rpartition("@")[2] and v.rpartition("@")[2].lower() not in X.MAIL_DOMAINS

    def luhn(v):
        d = [int(c) for c in re.sub(r"\D", "", v)][::-1]
        return len(d) >= 13 and sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0

    tests = {"password": plausible, "token": plausible, "recovery": plausible, "other": plausible, "upi": upi, "upi_bare": upi, "card_bare": luhn,
             "phone": lambda v: 10 <= len(re.sub(r"\D", "", v)) <= 13, "email": lambda v: not upi(v), "health": lambda v: len(v) >= 3,
             "address": lambda v: not re.match(X.REDACTED, v) and len(v) >= 6 and bool(re.search(r"\d|,", v) or len(v) >= 12), "generic_id": lambda v: bool(re.search(r"\d", v))}
    found = []
    for prio, d in enumerate(DETECTORS):
        flags = re.I if d.pattern.startswith("(?i") else 0
        for m in re.finditer(d.pattern.split(")", 1)[1], text, flags):
            s, e = m.span(0 if d.clause else 1)
            if d.clause:
                e = next((i for i in range(s, len(text)) if text[i] in ".;!?\n"), len(text))
            v = text[s:e]
            if d.trim:
                s, v = s + len(v) - len(v.lstrip()), v.strip()
            if d.context and not re.search(X.EMAIL_CONTEXT, text[max(0, s - 80) : s], re.I):
                continue
            if tests.get(d.name, lambda _: True)(v):
                found.append((s, -len(v), prio, d.type))
    kept = []
    for s, n, _, t in sorted(found) if text.strip() else []:
        if not any(s >= a and s - n <= b for a, b, _ in kept):
            kept.append((s, s - n, t))
    return kept


def test_spans_as_python_finds_them(spark):
    import random

    random.seed(5)
    parts = [*MASKS, "contact me at +91 98765 43210 ", "é 😀 ", "mail me: a.b@c.org, ", "\n", "UPI id x1@okbank. ", "PAN ABCDE1234F ", "pin code 1234 pin 123456 ", "CVV is 123, seed phrase :abc99 ", " card no 1234567890123-12", "passport no K12345678 "]
    texts = ["".join(random.choices(parts, k=random.randint(1, 4))) for _ in range(150)]
    rows = with_spans(frame(spark, texts)).orderBy("row_pos").select("message", "spans").collect()
    for r in rows:
        assert [(x.start, x.end, x.type) for x in r.spans] == twin(r.message), r.message


def test_many_spans_in_one_text(spark):
    text = "otp is 123456, card number 4111 1111 1111 1111 é " * 400
    row = with_spans(frame(spark, [text])).first()
    assert [(x.start, x.end, x.type) for x in row.spans] == twin(text) and len(row.spans) == 800


def test_overlapping_masks_keep_their_places(spark):
    spans = "array(named_struct('start', 0, 'end', 5, 'mask', '*****'), named_struct('start', 3, 'end', 8, 'mask', '[R]'))"
    row = with_safe_text(spark.sql(f"SELECT 'abcdefghij' AS message, {spans} AS spans")).first()
    assert row.safe_message == "*****]ij"


def test_published_rows_hold_no_raw_values(results):
    assert "message" not in results.columns and "spans" not in results.columns
    assert not results.where(F.to_json(F.struct("*")).rlike("482913|BlueRiver|4111 1111|A8K29Q")).count()


def test_times_and_dates(spark):
    times = {"9 AM": "09:00", "12 am": "00:00", "12:30pm": "12:30", "24": "00:00", "25:00": None, "9:99": None, "13 pm": None}
    rows = spark.createDataFrame([(k,) for k in times], "t string").select("t", extract.normalized_time(F.col("t")).alias("x")).collect()
    assert {r.t: r.x for r in rows} == times
    days = {"today": 1, "friday": 4, "next friday": 4, "tuesday": 8, "this tuesday": 1, "in three days": 4, "in 3 days": None, "in a day": 2, "someday": None}
    rows = spark.createDataFrame([(k,) for k in days], "t string").select("t", extract.resolved_date(F.col("t"), F.lit(TS.date())).alias("x")).collect()
    assert {r.t: r.x and r.x.day for r in rows} == days


def test_views(results):
    assert views.messages(results, category="promotional").count() >= 1
    assert views.messages(results, search="%").count() == results.where(F.contains("safe_message", F.lit("%"))).count()
    assert views.filtered_tasks(results, date_from="2026-09-18", date_to="2026-09-19").count() == 2
    with pytest.raises(views.NotFound):
        views.message(results, "none")
    with pytest.raises(ValueError):
        views.messages(results, limit=0)


def test_report_and_summary(results):
    expected = results.select("message_id")
    assert audit.quality_report(results, expected).first().validation_status == "PASS"
    lost = audit.quality_report(results.where("row_pos > 0"), expected, mandatory=results.where("row_pos = 0")).first()
    assert (lost.validation_status, lost.missing_message_ids, lost.mandatory_messages_missing, lost.sensitive_value_leak_check) == ("FAIL", 1, 1, "PASS")
    assert audit.quality_report(results, expected, found=expected.limit(1)).first().sensitive_value_leak_check == "FAIL"
    twice = results.unionByName(results.where("row_pos = 1"))
    assert audit.quality_report(twice, expected).first().duplicate_message_ids == 1
    lines = [r.line for r in audit.issue_line(audit.output_issues(twice, expected)).collect()]
    assert "[duplicate_message_id] T001: final_results: 2 rows" in lines
    s = summary(results).select("total_messages", F.map_keys("items_by_type").alias("types")).first()
    assert s.total_messages == results.count() and s.types == sorted(s.types)


def test_input_issues(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text('﻿message_id,timestamp,sender,message\nM1,2026-09-01 08:00:00,A,"x, ""y""\nz"\nM1,2026-09-01 07:00:00,,hi\n', encoding="utf-8")
    raw = read_csv(spark, str(p))
    assert {r.code for r in validate.issues(raw, 900).collect()} == {"duplicate_message_id", "not_chronological", "missing_sender", "unexpected_dataset_size"}
    with pytest.raises(validate.InvalidDataset):
        validate.require_valid(raw)
    assert typed(raw).orderBy("row_pos").first().message == 'x, "y"\nz'
    assert [r.code for r in validate.issues(raw.drop("sender")).collect()] == ["missing_columns"]


def test_model_sees_masked_text_only(spark, results):
    seen = with_model_category(results, lambda: lambda prompt: '{"category": "promotional", "confidence": 2}' if "482913" not in prompt else "leak")
    rows = seen.where("classification.method = 'llm'").select("classification.*").collect()
    assert rows and {(r.category, r.confidence) for r in rows} == {("promotional", 1.0)}
    assert seen.columns == results.columns and seen.count() == results.count()


def answered(spark, kind, *answers):
    parse = {"category": fallback.parsed_category, "items": fallback.parsed_items}[kind]
    rows = spark.createDataFrame([(i, "a", x) for i, x in enumerate(answers)], "i int, message_id string, answer string")
    return [r.x for r in rows.select("i", parse(F.col("message_id"), F.col("answer")).alias("x")).orderBy("i").collect()]


def test_answers_of_a_model(spark):
    good = answered(spark, "category", '```json\n{"category": "Action-Required"}\n```', 'x {"category": "promotional", "confidence": "0.5"} y', '{"message_id": " a ", "category": "promotional", "reason": " r "}')
    assert [(r.category, r.confidence, r.reason) for r in good] == [("action_required", 0.0, ""), ("promotional", 0.5, ""), ("promotional", 0.0, "r")]
    assert answered(spark, "category", None, "", "{}", "[1]", '{"category": 3}', '{"category": "promotional"},', '{"category": "promotional", "message_id": "b"}', '{"category": "promotional"}}') == [None] * 5 + [good[1].__class__("promotional", 0.0, "")] + [None] * 2
    one, listed, none = answered(spark, "items", '{"items": [{"type": "TASK", "title": " t "}, {"type": "task", "title": "u", "time": "9"}]}', 'x [{"type": "task", "title": "t", "date": "20260203"}] y', "[]")
    assert [(x.item_id, x.title, x.time) for x in one] == [("TASK_a", "t", None), ("TASK_a-2", "u", "09:00")] and str(listed[0].date) == "2026-02-03" and none == []
    assert answered(spark, "items", '[{"type": "task", "title": "t"}, {"type": "task"}]', '{"items": 3}', '{"x": []}', '[{"type": "task", "title": "t", "deadline": "soon"}]', '{"message_id": 7, "items": []}') == [None] * 5


def test_a_service_that_fails_hangs_and_answers_late(spark, results):
    class Handler(http.server.BaseHTTPRequestHandler):
        calls: dict = {}

        def do_POST(self):  # noqa: N802
            prompt = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["messages"][0]["content"]
            name = re.search("message_id: (.*)", prompt)[1]
            n = Handler.calls[name] = Handler.calls.get(name, 0) + 1
            if name == "slow" or name == "hangs":
                time.sleep(0.4 if name == "slow" else 3)
            code = {"down": 503, "no": 401}.get(name, 500 if name == "twice" and n < 3 else 200)
            body = json.dumps({"choices": [{"message": {"content": '{"category": "promotional"}' if name != "odd" else "?"}}]}).encode()
            try:
                self.send_response(code)
                self.send_header("Content-Length", str(len(body)))
                self.end_headers()
                self.wfile.write(body)
            except OSError:
                pass

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        factory = fallback.http_provider(f"http://127.0.0.1:{server.server_port}", "k", "m", timeout=1.0)
        names = ["fine", "slow", "hangs", "down", "no", "twice", "odd", "fine", None]
        rows = spark.createDataFrame([(i, n, n and n != "asis") for i, n in enumerate(names)], "i int, message_id string, ask boolean").coalesce(1)
        manners = fallback.Manners(at_once=4, attempts=3, pause=0.01)
        out = fallback.asked(rows, F.when(F.col("ask"), fallback.category_prompt(F.col("message_id"), F.lit("text"))), factory, manners=manners).orderBy("i").collect()
        got = [(r.message_id, r.answer and (r.answer.status, r.answer.attempts)) for r in out]
        assert got == [("fine", ("answered", 1)), ("slow", ("answered", 1)), ("hangs", ("failed", 3)), ("down", ("failed", 3)), ("no", ("refused", 1)), ("twice", ("answered", 3)), ("odd", ("answered", 1)), ("fine", ("answered", 1)), (None, None)]
    finally:
        server.shutdown()


def test_model_stages_keep_rows_and_count_failures(spark, results):
    rows = results.limit(0)
    base = results.where("classification.method = 'rule_based' and classification.confidence < 0.75 and extraction.method = 'none'").limit(1)
    for i in ("x", "x", None):
        rows = rows.unionByName(base.withColumn("message_id", F.lit(i).cast("string")))
    made = with_model_items(with_model_category(rows, lambda: lambda prompt: "no"), lambda: lambda prompt: "no")
    assert sorted(str(r.message_id) for r in made.collect()) == ["None", "x", "x"]
    total = summary(made).first()
    assert (total.total_messages, total.llm_failures, total.rule_based, total.llm_based) == (3, 6, 3, 0)
    watched, seen = fallback.observed(made)
    watched.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 3, "categories_by_model": 0, "items_by_model": 0, "failures": 6}


def test_leaks_anywhere_in_any_line(spark):
    values = [("A", "482913"), ("B", "#*!#"), ("C", "77"), ("D", "secret word"), ("E", "absent9"), ("F", "482913"), ("G", ""), ("H", "abcdeX")]
    detected = spark.createDataFrame([(k, [(0, v, "password")]) for k, v in values], "message_id string, spans array<struct<start:int,value:string,type:string>>")
    texts = {"one": ["ref x482913y and #*!# here", "abcdef abcde", None, ""], "two": ["a secret wordy", "177", "abcdeX"] * 3}
    found = audit.leaks(detected, {k: spark.createDataFrame([(x,) for x in v], "line string") for k, v in texts.items()})
    want = {(m, a) for m, v in values for a, lines in texts.items() if v and any(v in (x or "") for x in lines)}
    rows = [(r.message_id, r.artifact) for r in found.collect()]
    assert sorted(rows) == sorted(want) and want == {("A", "one"), ("B", "one"), ("C", "two"), ("D", "two"), ("F", "one"), ("H", "two")}
    long = "".join(chr(97 + i * 7 % 26) + str(i % 977) for i in range(250_000)) + "482913" + "é😀 secret word"  # a line of about a megabyte
    far = audit.leaks(detected, {"one": spark.createDataFrame([(long,), (long,)], "line string")}).collect()
    assert sorted(r.message_id for r in far) == sorted(m for m, v in values if v and v in long)
    assert audit.leaks(detected.limit(0), {"one": spark.createDataFrame([("x",)], "line string")}).isEmpty()
    assert {"message_id": "A", "artifact": "one", "sensitivity_type": "password"} in [r.finding for r in audit.leak_texts(found).collect()]


def test_leak_search_gives_stretches_not_pairs_of_lines_and_values(spark):
    from missive.operators.search import AT_ONCE, stretches

    codes = [f"{i:04d}" for i in range(5000)]  # all in every line, as short values are in large tables
    long = "k" * 40 + "é😀"
    values = [*codes, long, long + "z", "k" * 32, "k" * 33, "absent" * 9]
    rows = spark.createDataFrame([(bytearray(v.encode()),) for v in values], "value binary")
    crossing = "-" * (AT_ONCE - 20) + long + "-" * AT_ONCE
    lines = spark.createDataFrame([(bytearray("".join(codes[:2500]).encode()),)] * 300 + [(bytearray(x.encode()),) for x in (crossing, "kk", "")], "line binary").coalesce(1)
    found = [bytes(r[0]).decode("utf-8", "replace") for r in stretches(rows)(lines).collect()]
    text = "".join(codes[:2500])
    assert set(found) & set(values) == {v for v in values if v in text or v in crossing} and len(found) < 30_000
    detected = rows.select(F.col("value").cast("string").alias("message_id"), F.array(F.struct(F.lit(0).alias("start"), F.col("value").cast("string").alias("value"), F.lit("x").alias("type"))).alias("spans"))
    leaked = audit.leaks(detected, {"one": lines.select(F.col("line").cast("string").alias("line"))})
    assert {r.message_id for r in leaked.collect()} == set(found) & set(values)


def test_first_inversion_in_rows_with_gaps(spark):
    rows = spark.range(4000, numPartitions=4).selectExpr("(id div 1000) * 8589934592 + id % 1000 AS row_pos", "CAST(id AS STRING) AS message_id", "timestamp_seconds(IF(id IN (1703, 3100), 5, id)) AS ts")
    assert validate.first_inversion(rows).first().message_id == "1703"
    assert validate.first_inversion(rows.where("row_pos < 500")).isEmpty() and validate.first_inversion(rows.limit(0)).isEmpty()


def test_documents_and_reports(spark, results, tmp_path):
    folder = str(tmp_path)
    kept = artifacts.classifications(results).withColumn("row_pos", F.substring("message_id", 2, 9).cast("long"))
    artifacts.write_document(kept, f"{folder}/doc", "2026-09-01T00:00:00+00:00")
    schema = "message_id string, category string, confidence double, reason string, method string"
    assert artifacts.read_document(spark, f"{folder}/doc", schema).collect() == kept.orderBy("row_pos").drop("row_pos").collect()
    for text in ("[1, 2]", "{\"count\": 1}", "no JSON"):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/bad")
        with pytest.raises(artifacts.ArtifactError):
            artifacts.read_document(spark, f"{folder}/bad", schema)
    for read in (lambda: artifacts.load(spark, folder, "none"), lambda: artifacts.read_report(spark, f"{folder}/none", "a int"), lambda: artifacts.read_document(spark, f"{folder}/none", schema)):
        with pytest.raises(artifacts.ArtifactError):
            read()
    assert not artifacts.has_outputs(spark, folder)


def test_a_run_from_file_to_report(spark, tmp_path, capsys):
    rows = "".join(f"M{i},2026-09-01 08:{i:02}:00,Meera,{t}\n" for i, t in enumerate(["Your OTP is 482913", "The training material is on the portal.", "Please submit the report by 2026-09-04."]))
    (tmp_path / "m.csv").write_text("message_id,timestamp,sender,message\n" + rows)
    (tmp_path / "ids.csv").write_text("message_id\nM1\nM2\n")
    env = {"X_MESSAGES": f"{tmp_path}/m.csv", "X_MANDATORY": f"{tmp_path}/ids.csv", "X_OUTPUTS": f"{tmp_path}/out", "X_EXPECTED": "3", "X_EXPECTED_MANDATORY": "2", "X_MODEL_ENABLED": "yes"}
    s = runs.settings("X_", env)
    assert runs.provider_of(s) is None and runs.run(spark, s) == 0
    assert "validation_status: PASS" in capsys.readouterr().out and artifacts.has_outputs(spark, f"{tmp_path}/out")
    report = artifacts.read_report(spark, f"{tmp_path}/out/validation_report", "summary struct<total_messages:long,messages_with_sensitive:long,total_items:long,rule_based:long,llm_based:long>, report struct<classified_messages:long,validation_status:string>, leak_scan struct<ok:boolean>")
    assert report.first().leak_scan.ok and runs.stats(report).first().asDict()["sensitive_messages"] == 1
    counts = artifacts.read_report(spark, f"{tmp_path}/out/summary_statistics", "mandatory_processed long, processing_duration_seconds double, validation_status string").first()
    assert counts.mandatory_processed == 2 and counts.processing_duration_seconds > 0 and counts.validation_status == "PASS"
    repository = artifacts.Repository(spark, f"{tmp_path}/out")
    assert repository.table("classifications").count() == 3 and repository.table("classifications") is repository.table("classifications")
    repository.clear()
    with pytest.raises(ValueError):
        runs.settings("X_", {"X_EXPECTED": "many"})
    assert runs.provider_of(runs.settings("", {"MODEL_ENABLED": "1", "MODEL_KEY": "k", "MODEL_NAME": "m", "MODEL_URL": "http://localhost"})) is not None


def test_mandatory_check(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "message_id string")
    row = audit.mandatory_check(ids("a", "b", "b", "c", "d"), ids("a", "b", "c"), ids("a", "b"), ids("a")).first().asDict()
    assert row == {"provided": 5, "unique_ids": 4, "duplicates": 1, "missing_from_dataset": 1, "not_processed": 2, "not_classified": 1, "ok": False}
    assert audit.mandatory_check(ids("a"), ids("a"), ids("a"), ids("a")).first().ok


def test_report_counts_as_the_list_of_issues(spark, results):
    expected = results.select("message_id").unionByName(spark.createDataFrame([("absent",), (None,)], "message_id string"))
    bad = results.unionByName(results.where("row_pos < 3")).unionByName(results.where("row_pos = 4").withColumn("message_id", F.lit(None).cast("string")))
    bad = bad.withColumn("classification", F.col("classification").withField("category", F.when(F.col("row_pos") % 5 == 0, "odd").otherwise(F.col("classification.category"))))
    wanted = spark.createDataFrame([("T001",), ("absent",), ("T001",), ("nowhere",)], "message_id string")
    row = audit.quality_report(bad, expected, wanted).first()
    assert row.issues == audit.output_issues(bad, expected).count()
    assert (row.total_input_messages, row.classified_messages) == (expected.count(), bad.count())
    assert row.missing_message_ids == audit.missing_ids(expected, bad).count() == 2
    assert (row.mandatory_messages_found, row.mandatory_messages_processed, row.mandatory_messages_missing) == (2, 1, 2)
    plan = audit.quality_report(bad, expected)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Aggregate") < 20


def test_records_against_a_schema(spark):
    schema = "a string not null, n double, when timestamp_ntz, tags array<string>, inner struct<x: boolean>"
    cases = {
        '{"a": "x", "n": 1e3, "when": "2026-01-02 03:04:05", "tags": ["t", null], "inner": {"x": true}}': set(),
        '{"a": "x", "n": null, "when": null, "tags": null, "inner": null}': set(),
        '{"a": null, "n": true, "when": "soon", "tags": ["t", 1, {}], "inner": {"x": "y", "z": 1}}': {("a", "null"), ("n", "mistyped"), ("when", "mistyped"), ("tags[1]", "mistyped"), ("tags[2]", "mistyped"), ("inner.x", "mistyped"), ("inner.z", "unexpected")},
        "{}": {(k, "missing") for k in ("a", "n", "when", "tags", "inner")},
        "7": {("", "mistyped")}, "null": {("", "null")}, "{": {("", "malformed")}, "": {("", "malformed")},
    }
    lines = spark.createDataFrame([(i, x) for i, x in enumerate([*cases, None])], "i int, line string")
    got = conform.faults(lines, schema).collect()
    for i, want in enumerate([*cases.values(), {("", "malformed")}]):
        assert {(r.path, r.code) for r in got if r.i == i} == want, i
    assert conform.faults(lines.limit(0), schema).isEmpty()
    with pytest.raises(ValueError):
        conform.faults(lines, "a binary")


def test_lines_of_an_artifact_that_are_no_objects(spark, tmp_path):
    put = lambda *x: spark.createDataFrame([(v,) for v in x], "value string").coalesce(1).write.mode("overwrite").text(f"{tmp_path}/art")
    put('{"a": 1}', "5", "[1]", "null", "", '"text"', '{"a": 2}')
    assert sorted(r.a for r in artifacts.load(spark, str(tmp_path), "art", "a int").collect()) == [1, 2]
    for bad in ('{"a": 1', '{"a": "x"}'):
        put('{"a": 1}', bad)
        with pytest.raises(Exception):  # noqa: B017
            artifacts.load(spark, str(tmp_path), "art", "a int").collect()


def test_deep_pages_totals_and_strict_ids(spark, results, monkeypatch):
    monkeypatch.setattr(views, "DIRECT", 5)
    every = [r.message_id for r in results.orderBy("row_pos").collect()]
    for offset in (0, 1, 7, len(every) - 3, len(every) - 1, len(every), len(every) + 50):
        assert [r.message_id for r in views.messages(results, limit=10, offset=offset).orderBy("row_pos").collect()] == every[offset : offset + 10]
    tasks = [(r.row_pos, r.pos) for r in views.tasks(results).orderBy("row_pos", "pos").collect()]
    got = views.counted_tasks(results, limit=3, offset=6).first()
    assert got.total == len(tasks) and [(x["row_pos"], x["pos"]) for x in got["items"]] == tasks[6:9]
    got = views.counted_sensitive(results, limit=2).first()
    assert got.total == results.where("security.has_detection").count() and len(got["items"]) == 2
    ids = spark.createDataFrame([("T001",), ("lost",)], "message_id string")
    assert views.mandatory(results, ids).count() == 1
    with pytest.raises(views.NotFound, match="lost"):
        views.mandatory(results, ids, strict=True)
    with pytest.raises(Exception, match="no messages"):
        validate.statistics(results.limit(0).withColumn("message", F.lit(""))).collect()


def test_analysis_is_cut_by_rows(spark):
    """One partition of a scan, however many rows it has, is not one task."""
    from missive.plans.analysis import spread

    rows = spark.range(0, 10_000, 1, 1).selectExpr("'m' || id AS message_id", "'text' AS message", "id AS row_pos")
    sizes = [r["count"] for r in spread(rows, at_once=250).groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) == 40 and sum(sizes) == 10_000 and max(sizes) < 400


def test_words_looked_for_first(spark):
    """Every character that a pattern takes for a letter of ASCII is folded to it, and what utrim removes is what the pattern for white space matches."""
    from missive.functions.text import FOLDED, WHITE

    chars = spark.range(1, 0xFFFF).where("id < 55296 OR id > 57343").selectExpr("id", "decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE') AS c")
    assert {(r.id) for r in chars.where("c RLIKE '(?iU)^[a-z]$' AND id > 127").select("id").collect()} == {ord(c) for c, _ in FOLDED}
    assert {r.id for r in chars.where(F.col("c").rlike(r"(?U)^\s$")).select("id").collect()} == {ord(c) for c in WHITE}
    texts = ["your ſecurity code is 482913", "TİME", "  the acceſs toKen iſ tok_demo_A8  ", "api key: zz99 and api key: zz88 \U0001f600 pwd Q1x#9"]
    found = with_spans(spark.createDataFrame([(t,) for t in texts], "message string")).select("message", F.explode("spans").alias("x")).select("message", "x.*").collect()
    assert [r.value for r in found] == ["482913", "tok_demo_A8", "zz99", "zz88", "Q1x#9"]
    assert all(r.message[r.start : r.end] == r.value for r in found)


def test_phrases_are_counted_in_a_text_computed_once(spark):
    """The trimmed, lowered text is not computed again for each phrase."""
    from missive.functions.text import count_phrases, utrim

    rows = spark.createDataFrame([(" Buy NOW, big sale ",), (None,)], "text string").withColumn("low", F.lower(utrim(F.col("text"))))
    counted = rows.select(count_phrases(F.col("low"), ("buy now", "sale", "coupon")).alias("n"))
    assert "array(lower(" in counted._jdf.queryExecution().optimizedPlan().toString()
    assert [r.n for r in counted.where("n > 0").collect()] == [2]
