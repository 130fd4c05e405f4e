"""One of six categories for each message, by phrase scores or by the sensitive values found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.text import any_case, count_phrases, factored, utrim


def _sum(base: float, *terms: tuple[float, Column]) -> Column:
    """Doubles, added from left to right: the last bit decides ties."""
    out = F.lit(base).cast("double")
    for weight, n in terms:
        out = out + F.lit(weight).cast("double") * n
    return out


def meeting_score(low: Column) -> Column:
    return F.least(_sum(0.5, (0.13, count_phrases(low, X.MEETING_NOUNS)), (0.07, count_phrases(low, X.WEAK_MEETING_NOUNS)), (0.08, F.regexp_count(low, F.lit(any_case(factored(X.MEETING_CONTEXT)))))), F.lit(0.97))


def action_score(low: Column) -> Column:
    return F.least(_sum(0.55, (0.14, count_phrases(low, X.ACTION_PHRASES)), (0.05, count_phrases(low, X.WEAK_ACTION_PHRASES)), (0.1, low.rlike(any_case(factored(X.ACTION_DEADLINE))).cast("int"))), F.lit(0.95))


def promo_score(low: Column) -> Column:
    """The term for promo codes can never add anything: its pattern is in capitals, the text is not."""
    return F.least(_sum(0.6, (0.12, count_phrases(low, X.PROMO_PHRASES))), F.lit(0.95))


def personal_score(low: Column) -> Column:
    return F.least(_sum(0.6, (0.1, count_phrases(low, X.PERSONAL_PHRASES))), F.lit(0.9))


SCORES = {"meeting_or_event": meeting_score, "action_required": action_score, "promotional": promo_score, "personal_information": personal_score}


def with_scores(safe: DataFrame, text: str = "safe_message", wanted: Column | None = None) -> DataFrame:
    """The scores of the lowered text, which is a column of its own: each score refers to it many times. Rows that are not wanted get nulls."""
    lowered = safe.withColumn("_low", F.lower(utrim(F.coalesce(F.col(text), F.lit("")))))
    made = {f"score_{k}": f(F.col("_low")) for k, f in SCORES.items()}
    return lowered.withColumns(made if wanted is None else {k: F.when(wanted, v) for k, v in made.items()}).drop("_low")


def with_classification(safe: DataFrame) -> DataFrame:
    """The struct classification: category, confidence, reason, method."""
    scored = with_scores(safe, wanted=F.size("spans") == 0)
    s = {k: F.col(f"score_{k}") for k in SCORES}
    best = F.greatest(*s.values())
    first = F.coalesce(*(F.when(v == best, F.lit(k)) for k, v in s.items()))  # the earliest of equals
    general = best < F.lit(X.CONFIDENCE_FLOOR)
    category = F.when(general, "general_information").otherwise(first)
    reasons = F.create_map(*(F.lit(x) for pair in X.CATEGORY_REASONS.items() for x in pair))
    sensitive = F.size("spans") > 0
    types = F.array_join(F.array_sort(F.array_distinct(F.transform("spans", lambda x: x["type"]))), ", ")
    made = F.when(sensitive, F.struct(
        F.lit("sensitive_information").alias("category"),
        F.when(F.exists("spans", lambda x: x["risk"] == "high"), F.lit(X.HIGH_RISK_CONFIDENCE)).otherwise(F.lit(X.OTHER_RISK_CONFIDENCE)).alias("confidence"),
        F.concat(F.lit(X.SENSITIVE_REASON + " Types: "), types, F.lit(".")).alias("reason"), F.lit("rule_based").alias("method"),
    )).otherwise(F.struct(
        category.alias("category"), F.when(general, F.lit(X.GENERAL_CONFIDENCE)).otherwise(F.round(best, 2)).alias("confidence"),
        F.element_at(reasons, category).alias("reason"), F.lit("rule_based").alias("method"),
    ))
    return scored.withColumn("classification", made).drop(*(f"score_{k}" for k in SCORES))
