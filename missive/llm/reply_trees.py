"""Reply trees as conversations, with DataFrame functions only.

Messages point to the message they answer. Self-joins double the distance climbed each round (so a path of n messages takes about log2 n
rounds), and with it the score and length of every message's way up. The root-to-leaf paths of a conversation are ranked by mean
score, those chosen are listed as rows (leaf, message, distance) by the same jumps, and each becomes one formatted text. Paths that are not
chosen are never listed: a thread of n messages with a side answer at each would have n * n / 4 rows.

Template: ``<|role|>``, newline, text, ``<|end|>``, newline for each turn. Inside roles and texts ``~ < [ |`` are written
``~0 ~1 ~2 ~3``, so that no control string of this or another template can occur there, and nothing is lost.

Defined cases: a null text or role is empty, a null score 0; messages without an id are left out, repeated ids keep their
least row; an answer to a missing message is a root; branches that run into a cycle have no root and are left out; equal
scores go to the smaller leaf; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import read, stored

#: What stands for a control character inside texts.
ESCAPES = (("~", "~0"), ("<", "~1"), ("[", "~2"), ("|", "~3"))
END = "<|end|>\n"


def escaped(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _same(a: str, b: str, *pairs: tuple[str, str]) -> Column:
    out = F.col(f"{a}.conv").eqNullSafe(F.col(f"{b}.conv"))
    for x, y in pairs:
        out = out & (F.col(f"{a}.{x}") == F.col(f"{b}.{y}"))
    return out


def jumps(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Rooted nodes with the score and length of their way to the root, and a table of jumps for each power of two.

    nodes: conv, node, parent (null at roots), score, with unique nodes. Round k knows of each node the ancestor 2**k steps above (to; null beyond the root),
    and total and n of the way before it; the next round adds what that ancestor knows. So a round has a row for each node at most, however many leaves are below it.
    """
    done = nodes.where("parent is null").select("conv", "node", F.col("parent").alias("to"), F.col("score").alias("total"), F.lit(1).cast("long").alias("n"))
    jump = nodes.where("parent is not null").select("conv", "node", F.col("parent").alias("to"), F.col("score").alias("total"), F.lit(1).cast("long").alias("n"))
    longest, found = nodes.groupBy("conv").count().agg(F.max("count")).first()[0] or 0, []
    while 2 ** len(found) <= longest and not jump.isEmpty():  # what is open after that runs into a cycle
        found.append(jump)
        known = done.unionByName(jump)
        grown = jump.alias("a").join(known.alias("b"), _same("a", "b", ("to", "node"))).select("a.conv", "a.node", "b.to", (F.col("a.total") + F.col("b.total")).alias("total"), (F.col("a.n") + F.col("b.n")).alias("n"))
        grown = stored(grown, "jumps")
        done, jump = done.unionByName(grown.where("to is null")), grown.where("to is not null")
    return done.drop("to"), found


def leaves(nodes: DataFrame, rooted: DataFrame) -> DataFrame:
    """(conv, leaf, mean): the rooted nodes that nothing answers, with the mean score of their way."""
    answered = nodes.where("parent is not null").select("conv", F.col("parent").alias("node")).distinct()
    return rooted.alias("a").join(answered.alias("b"), _same("a", "b", ("node", "node")), "left_anti").select("conv", F.col("node").alias("leaf"), (F.col("total") / F.col("n")).alias("mean"))


def best_branches(ranked: DataFrame, branches: int) -> DataFrame:
    """(conv, leaf) of each conversation's best branches, by mean score and then the smaller leaf."""
    ranked, chosen = stored(ranked, "branches"), None
    for _ in range(branches):  # a maximum each time, not a sort of all of a conversation's branches
        best = ranked.groupBy("conv").agg(F.max(F.col("mean")).alias("mean"))
        top = ranked.alias("a").join(best.alias("b"), _same("a", "b", ("mean", "mean"))).groupBy("a.conv").agg(F.min("leaf").alias("leaf"))
        chosen = stored(top if chosen is None else chosen.unionByName(top), "chosen")
        if branches > 1:
            ranked = ranked.alias("a").join(chosen.alias("b"), _same("a", "b", ("leaf", "leaf")), "left_anti")
    return chosen


def paths(chosen: DataFrame, found: list[DataFrame]) -> DataFrame:
    """(conv, leaf, node, dist) of the ways from chosen leaves (conv, leaf) to their roots: each round every row climbs a jump, twice as far as the round before."""
    out = chosen.select("conv", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("dist"))
    for k, jump in enumerate(found):
        climbed = out.alias("a").join(jump.alias("b"), _same("a", "b", ("node", "node"))).select("a.conv", "leaf", F.col("to").alias("node"), (F.col("dist") + 2**k).alias("dist"))
        out = stored(out.unionByName(climbed), "paths")
    return out


def conversations(messages: DataFrame, *, conv: str = "conv_id", node: str = "node_id", parent: str = "parent_id", role: str = "role", text: str = "text", score: str | None = None, branches: int = 1, loss_role: str = "assistant") -> DataFrame:
    """conv, leaf, n_turns, formatted and loss_spans (array of start and length in code points of the loss role's texts)."""
    named = messages.select(F.col(conv).alias("conv"), F.col(node).alias("node"), F.col(parent).alias("parent"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(score).cast("double") if score else F.lit(0.0), F.lit(0.0)).alias("score")).where("node is not null")
    once = named.groupBy("conv", "node").agg(F.min(F.struct("parent", "role", "text", "score")).alias("x")).select("conv", "node", "x.*")
    ids = once.select("conv", "node")
    linked = once.alias("a").join(ids.alias("b"), _same("a", "b", ("parent", "node")), "left").select("a.conv", "a.node", F.col("b.node").alias("parent"), "role", "text", "score")
    nodes = stored(linked, "messages")
    rooted, found = jumps(nodes.select("conv", "node", "parent", "score"))
    kept = paths(best_branches(leaves(nodes, rooted), branches), found)
    turns = kept.alias("a").join(nodes.alias("b"), _same("a", "b", ("node", "node"))).select("a.conv", "leaf", "dist", "role", escaped(F.col("text")).alias("body"), F.concat(F.lit("<|"), escaped(F.col("role")), F.lit("|>\n")).alias("head"))
    turns = turns.withColumn("turn", F.concat("head", "body", F.lit(END)))
    upto = W.partitionBy("conv", "leaf").orderBy(F.desc("dist")).rowsBetween(W.unboundedPreceding, 0)
    placed = turns.withColumn("start", F.sum(F.char_length("turn").cast("long")).over(upto) - F.lit(len(END)) - F.char_length("body"))
    whole = placed.groupBy("conv", "leaf").agg(F.count(F.lit(1)).alias("n_turns"), F.sort_array(F.collect_list(F.struct("start", F.char_length("body").cast("long").alias("length"), "turn", (F.col("role") == loss_role).alias("loss")))).alias("t"))
    spans = F.transform(F.filter("t", lambda x: x["loss"]), lambda x: F.struct(x["start"], x["length"]))
    return whole.select("conv", "leaf", "n_turns", F.concat_ws("", F.transform("t", lambda x: x["turn"])).alias("formatted"), spans.alias("loss_spans"))


def turns_of(formatted: Column) -> Column:
    """The turns of a formatted conversation, as array<struct<role, text>>."""
    parts = F.filter(F.split(formatted, r"<[|]end[|]>\n", -1), lambda x: x != "")
    head = lambda x: F.substring_index(x, "|>\n", 1)
    return F.transform(parts, lambda x: F.struct(unescaped(F.substr(head(x), F.lit(3))).alias("role"), unescaped(F.substr(x, F.char_length(head(x)) + 4)).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    return F.concat_ws("", F.transform(spans, lambda s: unescaped(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))))


def op5(spark, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    chain = rows.withColumn("node_id", F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text"))).withColumn("parent_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1))
    made = conversations(chain).withColumn("turns", turns_of(F.col("formatted"))).withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans")))
    whole = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return made.select(F.col("conv").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


OP5_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(13 + length(regexp_replace(role || text, '([~<|\[])', '~\1', 'g'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
