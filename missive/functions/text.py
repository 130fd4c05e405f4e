"""Column helpers for text: Unicode-aware regular expressions, trimming, and spans of all matches."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_case(pattern: str) -> str:
    return "(?iU)" + pattern


def exact_case(pattern: str) -> str:
    return "(?U)" + pattern


#: What (?U)\s matches.
WHITE = "".join(map(chr, (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Characters outside ASCII that (?iU) takes for a letter of ASCII, and that letter.
FOLDED = (("\u0130", "i"), ("\u0131", "i"), ("\u017f", "s"), ("\u212a", "k"))


def factored(pattern: str) -> str:
    """A pattern whose alternatives all begin at a word's border, with the border taken out: it is then looked for once at each place."""
    first, *others = pattern.split(r"|\b")
    return r"\b(?:" + "|".join([first.removeprefix(r"\b"), *others]) + ")"


def utrim(text: Column) -> Column:
    """Without white space (Unicode) at both ends; only the ends are looked at."""
    return F.btrim(text, F.lit(WHITE))


def folded(text: Column) -> Column:
    """Lower case, so that an ASCII word that (?iU) finds in the text is a substring of this."""
    for c, letter in FOLDED:
        text = F.replace(text, F.lit(c), F.lit(letter))
    return F.lower(text)


def has_any(low: Column, words: tuple[str, ...]) -> Column:
    """Whether one of the words is a substring."""
    if len(words) > 4:  # a long chain makes methods that the JVM does not compile
        return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    return reduce(or_, (F.contains(low, F.lit(w)) for w in words))


def blank(text: Column) -> Column:
    return F.coalesce(utrim(text), F.lit("")) == ""


def squeeze(text: Column, marks: str) -> Column:
    """Runs of white space as one space, and none of the marks at the ends."""
    return F.btrim(F.regexp_replace(text, r"(?U)\s+", " "), F.lit(marks))


def bound(value: Column, use) -> Column:
    """use(value), with value computed once however often use refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def with_before(pattern: str) -> str:
    """A pattern that also takes the text since the match before, as group 1; the pattern's groups come after it.

    A split would compile the pattern again for each row.
    """
    return r"\G((?s:.*?))" + pattern


def matches(text: Column, pattern: str, group: int = 1) -> Column:
    """All matches as array<struct<start, end, value>> in code points; the group must end where the match ends."""
    taken = with_before(pattern if group else f"({pattern})")
    whole, value = (F.regexp_extract_all(text, F.lit(taken), F.lit(k)) for k in (0, group + 1 if group else 2))
    parts = F.struct(whole.alias("whole"), value.alias("value"))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("found"))

    def placed(p: Column) -> Column:
        steps = F.transform(p["value"], lambda value, i: F.struct(F.char_length(F.get(p["whole"], i)).alias("step"), value.alias("value")))

        def one(seen: Column, x: Column) -> Column:
            end = seen["at"] + x["step"]
            return F.struct(end.alias("at"), F.concat(seen["found"], F.array(F.struct((end - F.char_length(x["value"])).alias("start"), end.alias("end"), x["value"].alias("value")))).alias("found"))

        return F.aggregate(steps, none, one, lambda seen: seen["found"])

    return bound(parts, placed)


def trimmed(spans: Column) -> Column:
    """Spans without the white space at their ends."""

    def one(x: Column) -> Column:
        lead = F.char_length(x["value"]) - F.char_length(F.regexp_replace(x["value"], r"(?U)^\s+", ""))
        value = utrim(x["value"])
        return F.struct((x["start"] + lead).alias("start"), (x["start"] + lead + F.char_length(value)).alias("end"), value.alias("value"))

    return F.transform(spans, one)


def count_phrases(text: Column, phrases: tuple[str, ...]) -> Column:
    """How many of the phrases occur in the text, as substrings. The text may be an expression; inside the filter it would be computed for each phrase."""
    return bound(text, lambda t: F.size(F.filter(F.array(*map(F.lit, phrases)), lambda p: F.contains(t, p))))
