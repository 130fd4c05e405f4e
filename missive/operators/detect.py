"""Sensitive values: a table of detectors that makes one column of spans, their dedup, and the masked text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.text import any_case, blank, bound, exact_case, folded, has_any, matches, trimmed


def plausible_secret(v: Column) -> Column:
    return (F.char_length(v) >= 4) & ~v.rlike(X.STARS) & ~v.rlike(X.REDACTED) & ~v.rlike(X.PLAIN_WORD)


def digits(v: Column) -> Column:
    return F.regexp_replace(v, r"(?U)\D", "")


def luhn(v: Column) -> Column:
    d = digits(v)
    return (F.char_length(d) >= X.LUHN_DIGITS) & F.call_function("luhn_check", d)


def upi_like(v: Column) -> Column:
    domain = F.substring_index(v, "@", -1)
    return F.contains(v, F.lit("@")) & (F.char_length(v) > F.char_length(domain) + 1) & (domain != "") & ~F.contains(domain, F.lit(".")) & ~F.lower(domain).isin(*X.MAIL_DOMAINS)


def phone_like(v: Column) -> Column:
    return F.char_length(digits(v)).between(*X.PHONE_DIGITS)


def address_like(v: Column) -> Column:
    return ~v.rlike(X.REDACTED) & (F.char_length(v) >= 6) & (v.rlike(r"(?U)\d") | F.contains(v, F.lit(",")) | (F.char_length(v) >= 12))


def id_like(v: Column) -> Column:
    return v.rlike(r"(?U)\d") & ~v.rlike(X.PLAIN_WORD)


@dataclass(frozen=True)
class Detector:
    name: str
    type: str
    pattern: str
    needs: tuple[str, ...] | str  # words, one of which is in the folded text of every match; or a plainer pattern that matches wherever this one does
    test: Callable[[Column], Column] | None = None
    trim: bool = False
    clause: bool = False  # the value runs from the match to the end of the clause
    context: str | None = None  # must occur in the characters before


#: In this order, which decides between equal spans.
DETECTORS = (
    Detector("otp", "one_time_password", any_case(X.OTP), ("otp", "time", "verification", "security", "auth")),
    Detector("password", "password", any_case(X.PASSWORD), ("passw", "passcode", "pwd"), plausible_secret),
    Detector("pin", "pin", any_case(X.PIN), ("pin",)),
    Detector("token", "authentication_token", any_case(X.TOKEN), ("token", "key"), plausible_secret),
    Detector("token_prefix", "authentication_token", exact_case(X.TOKEN_PREFIX), ("sk-", "pk-", "rk-", "ghp_", "gho_", "ghu_", "xox", "tok_")),
    Detector("jwt", "authentication_token", exact_case(X.JWT), ("eyj",)),
    Detector("recovery", "account_recovery_code", any_case(X.RECOVERY), ("recovery", "backup", "reset"), plausible_secret),
    Detector("card", "payment_card_number", any_case(X.CARD), ("card",)),
    Detector("card_bare", "payment_card_number", exact_case(X.CARD_BARE), r"(?U)\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}", luhn),
    Detector("bank", "bank_account_number", any_case(X.BANK), ("account", "/")),
    Detector("upi", "upi_payment_identifier", any_case(X.UPI), ("@",), upi_like),
    Detector("upi_bare", "upi_payment_identifier", exact_case(X.UPI_BARE), ("@",), upi_like),
    Detector("phone", "private_phone_number", any_case(X.PHONE), ("call", "contact", "reach", "phone", "mobile", "whatsapp", "cell"), phone_like, trim=True),
    Detector("email", "private_email", exact_case(X.EMAIL), ("@",), lambda v: ~upi_like(v), context=any_case(X.EMAIL_CONTEXT)),
    Detector("address", "private_address", any_case(X.ADDRESS), ("address", "residence", "residing", "live", "stay", "place"), address_like, trim=True),
    Detector("pan", "identification_number", exact_case(X.PAN), r"(?U)[A-Z]{5}\d{4}[A-Z]"),
    Detector("aadhaar", "identification_number", any_case(X.AADHAAR), ("aadha", "uid", "digit")),
    Detector("passport", "identification_number", any_case(X.PASSPORT), ("passport",)),
    Detector("generic_id", "identification_number", any_case(X.GENERIC_ID), ("id", "ssn", "social", "driv", "licen"), id_like, trim=True),
    Detector("health", "health_information", any_case(X.HEALTH), ("test", "blood", "diagnos", "prescription", "medical", "vitamin", "allerg", "diabet", "thyroid", "cholesterol", "moglobin", "sugar", "mental", "depression", "anxiety", "cancer", "pregnancy", "hiv", "std", "fever", "surgery", "heart"), lambda v: F.char_length(v) >= 3, trim=True, clause=True),
    Detector("cvv", "other_sensitive_credential", any_case(X.CVV), ("cvv", "cvc")),
    Detector("other", "other_sensitive_credential", any_case(X.OTHER), ("security", "banking", "login", "credential", "phrase", "key", "password"), plausible_secret),
)


def mask_of(type_: str, value: Column) -> Column:
    mask = X.SENSITIVE_TYPES[type_][0]
    return F.repeat(F.lit("*"), F.char_length(value)) if mask is None else F.lit(mask)


def found_by(detector: Detector, text: Column) -> Column:
    """One detector's values: array<struct<start, end, value>>."""
    spans = matches(text, detector.pattern, 0 if detector.clause else 1)
    if detector.clause:

        def to_clause_end(x: Column) -> Column:
            tail = F.substr(text, x["start"] + 1)
            value = bound(F.regexp_instr(tail, F.lit(X.CLAUSE_END)), lambda at: F.when(at > 0, F.substr(tail, F.lit(1), at - 1)).otherwise(tail))
            return F.struct(x["start"].alias("start"), (x["start"] + F.char_length(value)).alias("end"), value.alias("value"))

        spans = F.transform(spans, to_clause_end)
    if detector.trim:
        spans = trimmed(spans)
    if detector.context:
        before = lambda x: F.substr(text, F.greatest(x["start"] - X.EMAIL_WINDOW, F.lit(0)) + 1, F.least(x["start"], F.lit(X.EMAIL_WINDOW)))
        spans = F.filter(spans, lambda x: before(x).rlike(detector.context))
    if detector.test:
        spans = F.filter(spans, lambda x: detector.test(x["value"]))
    return spans


def _described(d: Detector, prio: int):
    _, risk, action = X.SENSITIVE_TYPES[d.type]

    def made(x: Column, i: Column) -> Column:
        fields = {"start": x["start"], "minus_length": x["start"] - x["end"], "prio": F.lit(prio), "seq": i, "end": x["end"], "type": F.lit(d.type), "value": x["value"], "mask": mask_of(d.type, x["value"]), "risk": F.lit(risk), "action": F.lit(action)}
        return F.struct(*(v.alias(k) for k, v in fields.items()))

    return made


def may_find(d: Detector, text: Column, low: Column) -> Column:
    """False where the detector finds nothing; ``low`` is the folded text. Words are looked for first: most texts have none, and that is much cheaper."""
    return (text.rlike(d.needs) if isinstance(d.needs, str) else has_any(low, d.needs)) & text.rlike(d.pattern)


def hits(text: Column, low: Column) -> Column:
    """Which detectors find something, in their order, as an array of booleans."""
    return F.array(*(may_find(d, text, low) for d in DETECTORS))


def all_spans(text: Column, hit: Column) -> Column:
    """The values of the detectors that hit, ordered by start, longer first, then detector."""
    none = F.array().cast(SPANS)
    kinds = [F.when(F.get(hit, F.lit(prio)), F.transform(found_by(d, text), _described(d, prio))).otherwise(none) for prio, d in enumerate(DETECTORS)]
    return F.when(F.array_contains(hit, True), F.sort_array(F.concat(*kinds))).otherwise(none)


def deduped(spans: Column) -> Column:
    """Spans that no accepted span contains, in order; partial overlaps stay. As starts do not fall, only the greatest accepted end matters."""
    none = F.struct(F.lit(-1).alias("top"), F.filter(spans, lambda _: F.lit(False)).alias("kept"))
    add = lambda seen, x: F.when(x["end"] <= seen["top"], seen).otherwise(F.struct(x["end"].alias("top"), F.concat(seen["kept"], F.array(x)).alias("kept")))
    return F.aggregate(spans, none, add, lambda seen: seen["kept"])


def masked(text: Column, spans: Column) -> Column:
    """The text with each span's mask, from right to left with the original places."""
    return F.aggregate(F.reverse(spans), text, lambda t, x: F.overlay(t, x["mask"], x["start"] + 1, x["end"] - x["start"]))


SPANS = "array<struct<start:int,minus_length:int,prio:int,seq:int,end:int,type:string,value:string,mask:string,risk:string,action:string>>"


def with_spans(messages: DataFrame, text: str = "message") -> DataFrame:
    """messages with spans (null or blank text: none)."""
    t = F.col(text)
    found = messages.withColumn("_low", folded(t)).withColumn("_hit", F.when(~blank(t), hits(t, F.col("_low"))).otherwise(F.array().cast("array<boolean>")))
    found = found.withColumn("_all", all_spans(t, F.col("_hit")))
    return found.withColumn("spans", F.when(F.size("_all") > 0, deduped(F.col("_all"))).otherwise(F.col("_all"))).drop("_low", "_hit", "_all")


def with_safe_text(detected: DataFrame, text: str = "message") -> DataFrame:
    return detected.withColumn("safe_message", F.when(F.size("spans") > 0, masked(F.col(text), F.col("spans"))).otherwise(F.col(text)))


def public(spans: Column) -> Column:
    """What may leave: no raw value and no place."""
    return F.transform(spans, lambda x: F.struct(F.lit(True).alias("detected"), x["type"].alias("sensitivity_type"), x["risk"].alias("risk"), x["mask"].alias("masked_text"), x["action"].alias("recommended_action")))
