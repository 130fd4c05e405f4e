"""SQL texts that another engine runs on the same tables, to hold the plans against."""

from __future__ import annotations

from .functions import fixed as X
from .operators.detect import DETECTORS, Detector
from .operators.extract import RULES
from .sources.messages import template_sql

M = f"m AS ({template_sql('orders')})"


def lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    """A Java pattern for RE2: no look-ahead (what it excludes is tested apart), ASCII classes."""
    out = pattern.replace("(?iU)", "(?i)").replace("(?U)", "").replace(r"(?=\b)", r"\b").replace(r"(?!\s*code\b)", "").replace(r"(?!\.\w)", "")
    return lit(out)


PLAUSIBLE = "length(value) >= 4 AND NOT regexp_matches(value, '^\\*{4,}$') AND NOT regexp_matches(value, '^\\[REDACTED') AND NOT regexp_matches(value, '^[a-z][a-z''-]*$')"
UPI = "contains(value, '@') AND split_part(value, '@', -1) <> '' AND length(value) > length(split_part(value, '@', -1)) + 1 AND NOT contains(split_part(value, '@', -1), '.') AND lower(split_part(value, '@', -1)) NOT IN (" + ", ".join(map(lit, X.MAIL_DOMAINS)) + ")"
DIGITS = "regexp_replace(value, '\\D', '', 'g')"
LUHN = f"length({DIGITS}) >= 13 AND list_sum(list_transform(string_split(reverse({DIGITS}), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN CAST(c AS INT) ELSE (CAST(c AS INT) * 2) // 10 + (CAST(c AS INT) * 2) % 10 END)) % 10 = 0"
TESTS = {
    "password": PLAUSIBLE, "token": PLAUSIBLE, "recovery": PLAUSIBLE, "other": PLAUSIBLE, "card_bare": LUHN, "upi": UPI,
    "upi_bare": UPI + " AND NOT regexp_matches(substr(text, CAST(e AS BIGINT) + 1, 2), '^\\.\\w')",
    "phone": f"length({DIGITS}) BETWEEN 10 AND 13",
    "email": f"NOT ({UPI}) AND regexp_matches(substr(text, CAST(greatest(s - 80, 0) AS BIGINT) + 1, CAST(least(s, 80) AS BIGINT)), {re2('(?iU)' + X.EMAIL_CONTEXT)})",
    "address": "NOT regexp_matches(value, '^\\[REDACTED') AND length(value) >= 6 AND (regexp_matches(value, '\\d') OR contains(value, ',') OR length(value) >= 12)",
    "generic_id": "regexp_matches(value, '\\d') AND NOT regexp_matches(value, '^[a-z][a-z''-]*$')", "health": "length(value) >= 3",
}


def found_sql(d: Detector, table: str, id_: str, text: str) -> str:
    """SELECT of (id, i, s, e, value) of one detector."""
    rx = re2(d.pattern)
    sizes = lambda c: f"coalesce(list_sum(list_transform({c}[1:i], lambda x: length(x))), 0)"
    base = f"""SELECT id, text, i, v[i] AS value, {sizes('b')} + {sizes('w')} AS e
      FROM (SELECT id, text, b, w, v, unnest(range(1, len(v) + 1)) AS i FROM (
        SELECT {id_} AS id, {text} AS text, regexp_split_to_array({text}, {rx}) AS b, regexp_extract_all({text}, {rx}, 0) AS w, regexp_extract_all({text}, {rx}, {0 if d.clause else 1}) AS v
        FROM {table} WHERE regexp_matches({text}, {rx})))"""
    base = f"SELECT id, text, i, value, e - length(value) AS s, e FROM ({base})"
    if d.clause:
        base = f"SELECT id, text, i, s, regexp_extract(substr(text, CAST(s AS BIGINT) + 1), '^[^.;!?\\n]*') AS value, s + length(regexp_extract(substr(text, CAST(s AS BIGINT) + 1), '^[^.;!?\\n]*')) AS e FROM ({base})"
    if d.trim:
        base = f"SELECT id, text, i, trim(value) AS value, s + length(value) - length(ltrim(value)) AS s, s + length(value) - length(ltrim(value)) + length(trim(value)) AS e FROM ({base})"
    return f"SELECT id, i, s, e, value FROM ({base}) WHERE {TESTS.get(d.name, 'true')}"


def detect_sql(d: Detector, table: str = "m", id_: str = "message_id", text: str = "message") -> str:
    head = f"WITH {M} " if table == "m" else ""
    return f"{head}SELECT id AS {id_}, CAST(s AS INT) AS start_pos, CAST(e AS INT) AS end_pos, value FROM ({found_sql(d, table, id_, text)})"


def _mask(d: Detector) -> str:
    mask = X.SENSITIVE_TYPES[d.type][0]
    return "repeat('*', length(value))" if mask is None else lit(mask)


ALL = ",\nall_spans AS (" + "\nUNION ALL\n".join(f"SELECT id, {p} AS prio, i, s, e, value, {lit(d.type)} AS type, {lit(X.SENSITIVE_TYPES[d.type][1])} AS risk, {_mask(d)} AS mask FROM ({found_sql(d, 'm', 'message_id', 'message')})" for p, d in enumerate(DETECTORS)) + ")"
SPANS = M + ALL + """,
ordered AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s, e DESC, prio, i) AS k FROM all_spans),
spans AS (SELECT a.* FROM ordered a WHERE NOT EXISTS (SELECT 1 FROM ordered b WHERE b.id = a.id AND b.k < a.k AND a.s >= b.s AND a.e <= b.e))"""
MASKED = SPANS + """,
steps AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k DESC) AS step, count(*) OVER (PARTITION BY id) AS n FROM spans),
done(id, text, step) AS (
  SELECT message_id, message, CAST(0 AS BIGINT) FROM m
  UNION ALL
  SELECT d.id, substr(d.text, 1, CAST(x.s AS BIGINT)) || x.mask || substr(d.text, CAST(x.e AS BIGINT) + 1), d.step + 1 FROM done d JOIN steps x ON x.id = d.id AND x.step = d.step + 1),
safe AS (SELECT d.id, arg_max(d.text, d.step) AS safe_message FROM done d GROUP BY d.id)"""


def phrases(low: str, words: tuple[str, ...]) -> str:
    return f"len(list_filter([{', '.join(map(lit, words))}], lambda p: contains({low}, p)))"


def score_sql(low: str) -> dict[str, str]:
    d = lambda x: f"CAST({x} AS DOUBLE)"
    return {
        "meeting_or_event": f"least({d(0.5)} + {d(0.13)} * {phrases(low, X.MEETING_NOUNS)} + {d(0.07)} * {phrases(low, X.WEAK_MEETING_NOUNS)} + {d(0.08)} * len(regexp_extract_all({low}, {re2(X.MEETING_CONTEXT)})), {d(0.97)})",
        "action_required": f"least({d(0.55)} + {d(0.14)} * {phrases(low, X.ACTION_PHRASES)} + {d(0.05)} * {phrases(low, X.WEAK_ACTION_PHRASES)} + {d(0.1)} * CAST(regexp_matches({low}, {re2(X.ACTION_DEADLINE)}) AS INT), {d(0.95)})",
        "promotional": f"least({d(0.6)} + {d(0.12)} * {phrases(low, X.PROMO_PHRASES)}, {d(0.95)})",
        "personal_information": f"least({d(0.6)} + {d(0.1)} * {phrases(low, X.PERSONAL_PHRASES)}, {d(0.9)})",
    }


def one_score_sql(name: str) -> str:
    return f"WITH {M} SELECT message_id, {score_sql('low')[name]} AS score FROM (SELECT message_id, lower(trim(message)) AS low FROM m)"


_S = score_sql("low")
CLASSIFIED = MASKED + f""",
scored AS (SELECT id, {', '.join(f'{v} AS {k}' for k, v in _S.items())} FROM (SELECT id, lower(trim(safe_message)) AS low FROM safe)),
by_message AS (SELECT id, count(*) AS n, bool_or(risk = 'high') AS high, string_agg(DISTINCT type, ', ' ORDER BY type) AS types FROM spans GROUP BY id),
best AS (SELECT scored.*, greatest({', '.join(_S)}) AS best, n, high, types FROM scored LEFT JOIN by_message USING (id)),
labelled AS (SELECT *, CASE WHEN n > 0 THEN 'sensitive_information' WHEN best < CAST(0.65 AS DOUBLE) THEN 'general_information' {' '.join(f"WHEN {k} = best THEN '{k}'" for k in _S)} END AS category FROM best),
classified AS (SELECT id AS message_id, category,
  CASE WHEN n > 0 THEN CASE WHEN high THEN CAST(0.97 AS DOUBLE) ELSE CAST(0.92 AS DOUBLE) END WHEN category = 'general_information' THEN CAST(0.5 AS DOUBLE) ELSE round(best, 2) END AS confidence,
  CASE WHEN n > 0 THEN {lit(X.SENSITIVE_REASON + ' Types: ')} || types || '.' {' '.join(f"WHEN category = '{k}' THEN {lit(v)}" for k, v in X.CATEGORY_REASONS.items())} END AS reason, 'rule_based' AS method
  FROM labelled)"""


def time_sql(raw: str) -> str:
    part = lambda k: f"regexp_extract({raw}, '(?i)^\\s*(\\d{{1,2}})(?::(\\d{{2}}))?\\s*(am|pm)?\\s*$', {k})"
    h, mi, half = f"TRY_CAST({part(1)} AS INT)", f"coalesce(TRY_CAST({part(2)} AS INT), 0)", f"lower({part(3)})"
    hour = f"CASE WHEN {half} = 'pm' AND {h} <> 12 THEN {h} + 12 WHEN {half} = 'am' AND {h} = 12 THEN 0 WHEN {half} = '' AND {h} = 24 THEN 0 ELSE {h} END"
    return f"CASE WHEN {hour} <= 23 AND {mi} <= 59 THEN lpad(CAST({hour} AS VARCHAR), 2, '0') || ':' || lpad(CAST({mi} AS VARCHAR), 2, '0') END"


def date_sql(raw: str, ref: str) -> str:
    e = f"lower(trim(regexp_replace({raw}, '\\s+', ' ', 'g')))"
    index = f"list_position([{', '.join(map(lit, X.WEEKDAYS))}], regexp_extract({e}, '^(?:(?:next|this) )?([a-z]+)$', 1))"
    ahead = f"({index} - isodow({ref}) + 7) % 7"
    number = f"list_position([{', '.join(map(lit, X.NUMBERS))}], regexp_extract({e}, '^in ([a-z]+) days?$', 1))"
    n = f"CASE WHEN {e} = 'today' THEN 0 WHEN {e} IN ('tomorrow', 'in a day') THEN 1 WHEN {e} = 'yesterday' THEN -1 WHEN {e} LIKE 'in %' THEN CASE WHEN {number} > 0 THEN {number} END WHEN {index} > 0 THEN CASE WHEN {ahead} = 0 AND NOT {e} LIKE 'this %' THEN 7 ELSE {ahead} END END"
    return f"CASE WHEN regexp_matches({raw}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN TRY_CAST({raw} AS DATE) ELSE CAST({ref} + CAST({n} AS INT) AS DATE) END"


def squeeze_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'), {lit(X.VALUE_MARKS)})"


def clause_sql(x: str) -> str:
    c = f"trim(split_part({x}, ';', 1), {lit(X.CLAUSE_MARKS)})"
    for p in (X.PREFIX, X.SOFTENER, X.CONNECTIVE):
        for _ in range(3):
            c = f"trim(regexp_replace({c}, {re2('(?iU)' + p)}, ''), {lit(X.CLAUSE_MARKS)})"
    return c


PRIORITY = f"CASE WHEN regexp_matches(t, {re2('(?iU)' + X.HIGH_PRIORITY)}) THEN 'high' WHEN regexp_matches(t, {re2('(?iU)' + X.LOW_PRIORITY)}) THEN 'low' ELSE 'unknown' END"
_DL = re2("(?iU)" + X.DEADLINE)


def rule_sql(source: str, columns: str = "") -> str:
    """Items of (message_id, t, ref) rows by the cascade of rules; source: a table of those."""
    case = " ".join(f"WHEN regexp_matches(t, {re2('(?iU)' + r[1])}) THEN '{r[0]}'" for r in RULES)
    call = re2(X.CALL_NAME)
    ruled = f"(SELECT *, CASE {case} WHEN regexp_matches(t, {_DL}) THEN 'deadline' WHEN regexp_matches(t, {call}) THEN 'call' ELSE 'none' END AS rule FROM {source})"
    parts = []
    for name, pattern, type_, _, (title, date, time, place) in RULES:
        g = lambda k, p=pattern: f"regexp_extract(t, {re2('(?iU)' + p)}, {k})"
        parts.append(f"SELECT message_id, row_pos, 1 AS i, '{type_}' AS type, {squeeze_sql(g(title))} AS title, nullif({squeeze_sql(g(place))}, '') AS description, {date_sql(g(date), 'ref')} AS date, CAST(NULL AS DATE) AS deadline, {time_sql(g(time)) if time else 'CAST(NULL AS VARCHAR)'} AS time, CAST(NULL AS VARCHAR) AS person, {PRIORITY} AS priority FROM ruled WHERE rule = '{name}'")
    clause = clause_sql(f"regexp_split_to_array(t, {_DL})[i]")
    parts.append(f"""SELECT message_id, row_pos, i, 'task', CASE WHEN c = '' THEN 'task' ELSE lower(substr(c, 1, 1)) || substr(c, 2) END, NULL, NULL, {date_sql('raw', 'ref')}, NULL, NULL, {PRIORITY}
      FROM (SELECT *, {clause} AS c, regexp_extract_all(t, {_DL}, 1)[i] AS raw FROM (SELECT *, unnest(range(1, len(regexp_extract_all(t, {_DL}, 1)) + 1)) AS i FROM ruled WHERE rule = 'deadline'))""")
    person = f"regexp_extract(t, {call}, 1)"
    parts.append(f"SELECT message_id, row_pos, 1, 'task', 'call ' || lower({person}), NULL, NULL, NULL, NULL, {person}, {PRIORITY} FROM ruled WHERE rule = 'call'")
    union = "\nUNION ALL\n".join(parts)
    return f"ruled AS {ruled},\nitems AS (SELECT *, upper(type) || '_' || message_id || CASE WHEN i > 1 THEN '-' || CAST(i AS VARCHAR) ELSE '' END AS item_id FROM ({union}))"


#: Items of the masked messages.
ITEMS = MASKED + ",\nplain AS (SELECT m.message_id, m.row_pos, trim(safe_message) AS t, CAST(m.ts AS DATE) AS ref FROM safe JOIN m ON m.message_id = safe.id),\n" + rule_sql("plain")
#: Items of the messages as they are, for single rules.
RAW_ITEMS = M + ",\nplain AS (SELECT message_id, row_pos, trim(message) AS t, CAST(ts AS DATE) AS ref FROM m),\n" + rule_sql("plain")
