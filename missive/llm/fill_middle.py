"""Fill-in-the-middle transformation, with DataFrame functions only.

A unit grammar names where one unit ends and the next begins, by the classes of the two neighbouring characters. It is
translated to a regex of zero width, ``(?<=left)(?=right)`` for each pair of classes; splitting at it consumes nothing, so
the pieces put together are the text. A document's prefix, middle and suffix are then runs of whole pieces, borders drawn
from a hash of its id, and put in the order of the form that the hash chooses.

Defined cases: a null or empty text has no units and stays as it is (``plain``), since splitting would give one empty
piece; so does a text that holds a sentinel, as its output could not be read back; a null id is drawn for as an empty
string; repeated rows get the same draw; a very long text is a row like any other (its pieces are an array of one row);
an empty table gives no rows; other columns are not needed and kept by ``fill_in_middle``, which writes
``n_units, form, prefix, middle, suffix, output`` under names that the table does not have yet.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import own_name, read, text_or_empty

ANY = r"[\s\S]"
#: Unit grammars: pairs of classes of the characters before and after a border. A class is a regex of a fixed number of characters.
GRAMMARS: dict[str, list[tuple[str, str]]] = {
    "characters": [(ANY, ANY)],
    "lines": [(r"\n", ANY)],
    "words": [(r"\s", r"\S")],
    "sentences": [(r"[.!?]\s", r"\S"), (r"\n", r"\S")],
    "paragraphs": [(r"\n\n", r"[^\n]")],
    "classes": [(r"\p{L}", r"[^\p{L}]"), (r"\p{N}", r"[^\p{N}]"), (r"\s", r"\S"), (r"[^\s\p{L}\p{N}]", r"[\s\p{L}\p{N}]")],
}


def boundary(grammar: str | list[tuple[str, str]]) -> str:
    """The zero-width regex of a grammar's borders."""
    pairs = GRAMMARS[grammar] if isinstance(grammar, str) else grammar
    return "|".join(f"(?<={left})(?={right})" for left, right in pairs)


def units(text: Column, grammar: str | list[tuple[str, str]] = "lines") -> Column:
    """The units of a text, which put together are the text; none of an empty or null one."""
    return F.when(text != "", F.split(text, boundary(grammar), -1)).otherwise(F.array().cast("array<string>"))


@dataclass(frozen=True)
class Marks:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def all(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def drawn(id_col: Column, seed: int, k: int) -> Column:
    """The k-th number (from 1, 32 bits) of a row's draws."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(key, 256), 8 * k - 7, 8), 16, 10).cast("long")


def restored(output: Column, form: Column, marks: Marks = Marks()) -> Column:
    """The text of an output, by its form: what lies between the first place of each sentinel."""
    p, s, m = map(F.lit, marks.all())
    after = lambda x, mark: F.substr(x, F.position(mark, x) + F.char_length(mark))
    before = lambda x, mark: F.substr(x, F.lit(1), F.position(mark, x) - 1)
    psm = F.concat(before(after(output, p), s), after(output, m), before(after(output, s), m))
    spm = F.concat(before(after(output, p), m), after(output, m), before(after(output, s), p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame, *, grammar: str | list[tuple[str, str]] = "lines", seed: int = 7, rate: int = 100, spm_rate: int = 50, marks: Marks = Marks(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n_units, form (plain, psm or spm), prefix, middle, suffix (null if plain) and output; rates are percentages."""
    text, names, taken = text_or_empty(text_col), {}, docs
    for base in ("n_units", "form", "prefix", "middle", "suffix", "output", "pieces", "low", "high"):
        names[base] = own_name(taken, base)
        taken = taken.withColumn(names[base], F.lit(None))
    c = {k: F.col(v) for k, v in names.items()}
    h = [drawn(F.col(id_col), seed, k) for k in (1, 2, 3, 4)]
    plain = (text == "") | (h[2] % 100 >= rate)
    for mark in marks.all():
        plain = plain | F.contains(text, F.lit(mark))
    form = F.when(plain, "plain").when(h[3] % 100 < spm_rate, "spm").otherwise("psm")
    cut = docs.withColumn(names["pieces"], units(text, grammar)).withColumn(names["n_units"], F.size(c["pieces"]).cast("long"))
    a, b = h[0] % (c["n_units"] + 1), h[1] % (c["n_units"] + 1)
    cut = cut.withColumn(names["low"], F.least(a, b).cast("int")).withColumn(names["high"], F.greatest(a, b).cast("int")).withColumn(names["form"], form)
    part = lambda start, n: F.when(c["form"] != "plain", F.array_join(F.slice(c["pieces"], start + 1, n), ""))
    cut = (
        cut.withColumn(names["prefix"], part(F.lit(0), c["low"])).withColumn(names["middle"], part(c["low"], c["high"] - c["low"]))
        .withColumn(names["suffix"], part(c["high"], c["n_units"].cast("int") - c["high"]))
    )
    p, s, m = map(F.lit, marks.all())
    output = F.when(c["form"] == "psm", F.concat(p, c["prefix"], s, c["suffix"], m, c["middle"])).when(c["form"] == "spm", F.concat(s, c["suffix"], p, c["prefix"], m, c["middle"])).otherwise(text)
    return cut.withColumn(names["output"], output).drop(names["pieces"], names["low"], names["high"])


def op13(spark, sf_dir: str) -> DataFrame:
    out = fill_in_middle(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("n_units").alias("n"), "form", F.char_length("prefix").cast("long").alias("prefix_chars"), F.char_length("middle").cast("long").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


#: Lines are matched, not split; the parts are read back from the output by regex.
OP13_SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), drawn AS (
  SELECT *, len(u) AS n, [('0x' || h[8 * i - 7:8 * i])::BIGINT for i in [1, 2, 3, 4]] AS r FROM cut
), placed AS (
  SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS lo, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS hi,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM drawn
), parts AS (
  SELECT *, array_to_string(u[1:lo], '') AS p, array_to_string(u[lo + 1:hi], '') AS m, array_to_string(u[hi + 1:n], '') AS s FROM placed
), made AS (
  SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS o FROM parts
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars, sha256(o) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN o
    WHEN 'psm' THEN regexp_replace(o, '^<P>((?s:.*))<S>((?s:.*))<M>((?s:.*))$', '\1\3\2')
    ELSE regexp_replace(o, '^<S>((?s:.*))<P>((?s:.*))<M>((?s:.*))$', '\2\3\1') END) AS restored_sha256
FROM made
"""
