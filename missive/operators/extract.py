"""Tasks, meetings, events and reminders: the first rule that matches a masked message makes its items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.text import any_case, bound, exact_case, folded, has_any, squeeze, utrim, with_before


def normalized_time(raw: Column) -> Column:
    """HH:MM of a time such as 9, 9:30 or 8 pm; null if there is no such time."""
    shape = r"(?iU)^\s*(\d{1,2})(?::(\d{2}))?\s*(am|pm)?\s*$"
    hour, minute = (F.regexp_extract(raw, shape, k).try_cast("int") for k in (1, 2))
    half = F.lower(F.regexp_extract(raw, shape, 3))
    h = F.when((half == "pm") & (hour != 12), hour + 12).when((half == "am") & (hour == 12), 0).when((half == "") & (hour == 24), 0).otherwise(hour)
    m = F.coalesce(minute, F.lit(0))
    return F.when(raw.rlike(shape) & (h <= 23) & (m <= 59), F.format_string("%02d:%02d", h, m))


def resolved_date(raw: Column, ref: Column) -> Column:
    """The date of an ISO or relative expression; null if it is none (three days in digits is none)."""

    def days(e: Column) -> Column:
        day = F.regexp_extract(e, r"^(?:(?:next|this) )?([a-z]+)$", 1)
        index = F.array_position(F.array(*map(F.lit, X.WEEKDAYS)), day).cast("int") - 1
        number = F.array_position(F.array(*map(F.lit, X.NUMBERS)), F.regexp_extract(e, r"^in ([a-z]+) days?$", 1)).cast("int")
        ahead = bound(F.pmod(index - F.weekday(ref), F.lit(7)), lambda n: F.when((n == 0) & ~e.startswith("this "), 7).otherwise(n))
        return F.when(e == "today", 0).when(e.isin("tomorrow", "in a day"), 1).when(e == "yesterday", -1).when(e.startswith("in "), F.nullif(number, F.lit(0))).when(index >= 0, ahead)

    n = bound(F.lower(squeeze(raw, " ")), days)
    return F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}$"), raw.try_cast("date")).otherwise(F.date_add(ref, n.cast("int")))


def cleaned_clause(clause: Column) -> Column:
    """A clause as a title: no prefixes, softeners and connectives, the first letter small."""
    c = F.btrim(F.substring_index(clause, ";", 1), F.lit(X.CLAUSE_MARKS))
    for pattern in (X.PREFIX, X.SOFTENER, X.CONNECTIVE):
        for _ in range(3):
            c = F.btrim(F.regexp_replace(c, any_case(pattern), ""), F.lit(X.CLAUSE_MARKS))
    return bound(c, lambda x: F.concat(F.lower(F.substring(x, 1, 1)), F.substr(x, F.lit(2))))


def priority(text: Column) -> Column:
    return F.when(text.rlike(any_case(X.HIGH_PRIORITY)), "high").when(text.rlike(any_case(X.LOW_PRIORITY)), "low").otherwise("unknown")


def item_id(id_: Column, type_: Column | str, n: Column | int = 1) -> Column:
    t = F.lit(type_) if isinstance(type_, str) else type_
    k = F.lit(n) if isinstance(n, int) else n
    return F.concat(F.upper(t), F.lit("_"), id_, F.when(k > 1, F.concat(F.lit("-"), k.cast("string"))).otherwise(F.lit("")))


#: (name, pattern, type, words of the reason, groups of title, date, time (0: none), location)
RULES = (
    ("calendar", X.CALENDAR, "event", "calendar-update", (1, 2, 3, 4)),
    ("reminder", X.REMINDER, "reminder", "scheduled reminder", (1, 2, 3, 4)),
    ("scheduled", X.SCHEDULED, "meeting", "scheduled meeting", (1, 2, 3, 4)),
    ("join", X.JOIN, "event", "join request", (1, 2, 3, 4)),
    ("available", X.AVAILABLE, "meeting", "availability request", (1, 3, 2, 4)),
    ("calendar_no_time", X.CALENDAR_NO_TIME, "event", "calendar-update", (1, 2, 0, 3)),
    ("reminder_no_time", X.REMINDER_NO_TIME, "reminder", "scheduled reminder", (1, 2, 0, 3)),
    ("scheduled_no_time", X.SCHEDULED_NO_TIME, "meeting", "scheduled meeting", (1, 2, 0, 3)),
)
#: Words, one of which is in the folded text wherever a rule matches.
NEEDS = {"calendar": ("calendar",), "reminder": ("reminder:",), "scheduled": ("scheduled",), "join": ("join",), "available": ("available",), "deadline": ("deadline", "due", "by", "before"), "call": ("call", "contact", "reach")}
ITEM = "struct<item_id:string,type:string,title:string,description:string,date:date,deadline:date,time:string,person:string,priority:string,source_message_id:string>"


def _item(id_: Column, type_: Column | str, title: Column, prio: Column, *, n: Column | int = 1, description=None, date=None, deadline=None, time=None, person=None) -> Column:
    null = lambda x: F.lit(None) if x is None else x
    fields = {"item_id": item_id(id_, type_, n), "type": F.lit(type_) if isinstance(type_, str) else type_, "title": title, "description": null(description), "date": null(date), "deadline": null(deadline), "time": null(time), "person": null(person), "priority": prio, "source_message_id": id_}
    return F.struct(*(v.alias(k) for k, v in fields.items())).cast(ITEM)


def _empty_to_null(x: Column) -> Column:
    return F.when(x != "", x)


def event_item(rule: tuple, text: Column, id_: Column, ref: Column) -> Column:
    _, pattern, type_, _, (title, date, time, place) = rule
    part = lambda k: F.regexp_extract(text, any_case(pattern), k)
    return _item(id_, type_, squeeze(part(title), X.VALUE_MARKS), priority(text), description=_empty_to_null(squeeze(part(place), X.VALUE_MARKS)), date=resolved_date(part(date), ref), time=normalized_time(part(time)) if time else None)


def deadline_items(text: Column, id_: Column, ref: Column) -> Column:
    """A task for each deadline, titled by the clause before it."""
    before, date = (F.regexp_extract_all(text, F.lit(with_before(any_case(X.DEADLINE))), F.lit(k)) for k in (1, 2))
    parts = F.struct(before.alias("between"), date.alias("date"), priority(text).alias("prio"))

    def titled(p: Column, i: Column) -> Column:
        return F.coalesce(_empty_to_null(cleaned_clause(F.get(p["between"], i))), F.lit("task"))

    return bound(parts, lambda p: F.transform(p["date"], lambda d, i: _item(id_, "task", titled(p, i), p["prio"], n=i + 1, deadline=resolved_date(d, ref))))


def call_item(text: Column, id_: Column) -> Column:
    person = F.regexp_extract(text, exact_case(X.CALL_NAME), 1)
    return _item(id_, "task", F.concat(F.lit("call "), F.lower(person)), priority(text), person=person)


def with_extraction(safe: DataFrame, text: str = "safe_message", id_col: str = "message_id", ts: str = "ts") -> DataFrame:
    """The struct extraction (items, method, reason, error): error where a rule matched an impossible date or time, which stays null.

    In steps: the rule that matches first, the raw parts it captures, then one item of these parts whatever the rule.
    """
    t, r, id_, ref = F.col("_t"), F.col("_rule"), F.col(id_col), F.to_date(F.col(ts))
    found = lambda name, pattern: F.when(has_any(F.col("_low"), NEEDS[name.removesuffix("_no_time")]) & t.rlike(pattern), F.lit(name))
    rule = F.coalesce(*(found(name, any_case(pattern)) for name, pattern, *_ in RULES), found("deadline", any_case(X.DEADLINE)), found("call", exact_case(X.CALL_NAME)), F.lit("none"))

    def part(which: int) -> Column:
        """What the matching rule captures as title, date, time or place."""
        out = F.lit("")
        for name, pattern, _, _, groups in RULES:
            if groups[which]:
                out = F.when(r == name, F.regexp_extract(t, any_case(pattern), groups[which])).otherwise(out)
        return out

    type_, reason = F.lit("task"), F.lit(X.NO_ITEMS_REASON)
    for name, _, kind, label, groups in RULES:
        type_ = F.when(r == name, F.lit(kind)).otherwise(type_)
        reason = F.when(r == name, F.lit(f"Matched a {label} with an explicit date{' and time' if groups[2] else ''}.")).otherwise(reason)
    n = F.size(F.col("_items"))
    person = F.get(F.col("_items"), F.lit(0))["person"]
    many = F.concat(F.lit("Matched "), n.cast("string"), F.lit(" distinct tasks with explicit deadlines."))
    reason = F.when(r == "deadline", F.when(n > 1, many).otherwise("Matched a task with an explicit deadline.")).when(r == "call", F.concat(F.lit("Matched a call request naming "), person, F.lit("."))).otherwise(reason)
    scheduled, timed = ~r.isin("deadline", "call", "none"), r.isin([x[0] for x in RULES if x[4][2]])
    wrong = lambda x: (scheduled & x["date"].isNull()) | ((r == "deadline") & x["deadline"].isNull()) | (timed & x["time"].isNull())
    steps = safe.withColumn("_t", utrim(F.coalesce(F.col(text), F.lit("")))).withColumn("_low", folded(t)).withColumn("_rule", rule).drop("_low")
    steps = steps.withColumns({"_type": type_, **{f"_{k}": part(i) for i, k in enumerate(("title", "date", "time", "place"))}})
    event = _item(id_, F.col("_type"), squeeze(F.col("_title"), X.VALUE_MARKS), priority(t), description=_empty_to_null(squeeze(F.col("_place"), X.VALUE_MARKS)), date=resolved_date(F.col("_date"), ref), time=normalized_time(F.col("_time")))
    items = F.when(scheduled, F.array(event)).when(r == "deadline", deadline_items(t, id_, ref)).when(r == "call", F.array(call_item(t, id_))).otherwise(F.array().cast(f"array<{ITEM}>"))
    out = F.struct(F.col("_items").alias("items"), F.when(r == "none", "none").otherwise("rule_based").alias("method"), reason.alias("reason"), F.exists("_items", wrong).alias("error"))
    return steps.withColumn("_items", items).withColumn("extraction", out).drop("_t", "_rule", "_items", "_type", "_title", "_date", "_time", "_place")
