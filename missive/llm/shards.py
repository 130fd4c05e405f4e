"""Sharding by minimax contiguous partition, with DataFrame functions only.

Atomic groups are rows of equal text. They are ordered by their text's SHA-256, and a running sum of their bytes is laid
over that order (within 4096 even blocks of the hash, plus the blocks' own running sum). The smallest capacity at which a
greedy left-to-right fill needs no more shards than asked for is found by search: each round tests ``WIDTH`` capacities
at once, and each greedy step is one aggregate over the table of running sums. Under that capacity every cut goes
to the border nearest above an equal share of what is left, as far as the rest stays feasible, so that one huge group
does not leave the other shards empty. A row's shard then follows from its hash and the (at most n - 1) cut hashes, without
a join.

Defined cases: a null text counts as empty, of size 1; equal texts go together, however many rows they have; if there
are fewer groups than shards some shards are empty; an empty table gives no rows; other columns are not needed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import read, stored, text_or_empty

#: Capacities tested in one round.
WIDTH = 48
#: Rows that are numbered together, about.
NUMBERED = 50_000


def _running(groups: DataFrame) -> DataFrame:
    """groups (key, size) with top, the sum of sizes up to and with the group in the order of keys."""
    blocks = groups.withColumn("block", F.conv(F.substring(F.hex("key"), 1, 3), 16, 10).cast("int"))
    sums = blocks.groupBy("block").agg(F.sum("size").alias("block_size"))
    before = sums.select("block", (F.sum("block_size").over(W.orderBy("block")) - F.col("block_size")).alias("before"))  # 4096 rows at most
    inside = W.partitionBy("block").orderBy("key").rowsBetween(W.unboundedPreceding, 0)
    return blocks.join(F.broadcast(before), "block").select("key", "size", (F.col("before") + F.sum("size").over(inside)).alias("top"))


def _reached(running: DataFrame, limits: list[int], floor: int) -> list[int]:
    """For each limit the greatest top that does not exceed it, or the floor; limits rise."""
    below = F.size(F.filter(F.array(*map(F.lit, limits)), lambda x: x < F.col("top")))  # the first limit that top does not exceed
    inside = running.where((F.col("top") > floor) & (F.col("top") <= limits[-1]))
    found = {r.i: r.most for r in inside.groupBy(below.alias("i")).agg(F.max("top").alias("most")).collect()}
    out, most = [], floor
    for i in range(len(limits)):
        most = max(most, found.get(i, floor))
        out.append(most)
    return out


def smallest_capacity(running: DataFrame, n: int, total: int, largest: int) -> int:
    """The least capacity with which a greedy fill of the groups in order needs at most n shards."""
    low, high = max(math.ceil(total / n), largest), math.ceil(total / n) + largest  # with high it always fits
    while low < high:
        step = max(1, math.ceil((high - low) / (WIDTH + 1)))
        tried = list(range(low, high, step))
        at = [0] * len(tried)
        for _ in range(n):
            new = _reached(running, [a + c for a, c in zip(at, tried, strict=True)], at[0])
            at = [max(a, b) for a, b in zip(at, new, strict=True)]
            if at[0] == total:
                break
        good = next((i for i, a in enumerate(at) if a == total), None)
        if good is None:
            low = tried[-1] + 1
        else:
            low, high = (tried[good - 1] + 1 if good else low), tried[good]
    return high


def cuts(running: DataFrame, n: int, total: int, capacity: int) -> list[int]:
    """The running sums after which shards end: near equal shares, none above the capacity."""
    latest = [total]  # from the right: the least border from which the rest still fits
    for _ in range(n - 1):
        need = latest[-1] - capacity
        latest.append(0 if need <= 0 else running.where(F.col("top") >= need).agg(F.min("top")).first()[0])
    latest.reverse()
    out = [0]
    for j in range(n - 1):
        share = out[-1] + math.ceil((total - out[-1]) / (n - j))
        row = running.where((F.col("top") > out[-1])).agg(F.min(F.when(F.col("top") >= max(share, latest[j]), F.col("top"))), F.max(F.when(F.col("top") <= out[-1] + capacity, F.col("top"))), F.max(F.when(F.col("top") < share, F.col("top")))).first()
        above, most, below = (out[-1] if x is None else x for x in row)
        near = below if below >= latest[j] and below > out[-1] and share - below < above - share else above
        out.append(min(near, most) if most > out[-1] else out[-1])
    return out[1:]


def shard(docs: DataFrame, n: int = 16, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each row."""
    text = text_or_empty(text_col)
    rows = stored(docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("key")), "shard-rows")
    running = stored(_running(rows.groupBy("key").agg(F.sum("size").alias("size"))), "shard-groups")
    total, largest = running.agg(F.sum("size"), F.max("size")).first()
    ends: list[bytearray] = []
    if total:
        borders = sorted({x for x in cuts(running, n, total, smallest_capacity(running, n, total, largest)) if 0 < x < total})
        ends = sorted(bytes(r.key) for r in running.where(F.col("top").isin(borders)).select("key").collect()) if borders else []
    dealt = rows.withColumn("shard", _number_of_ends_below(F.col("key"), ends))
    parts = max(1, math.ceil(rows.count() / (n * NUMBERED)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("doc_id", "key"), F.lit(parts)).cast("int")) if parts > 1 else dealt.withColumn("part", F.lit(0))
    counts = dealt.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("shard", "part", (F.sum("n").over(W.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    place = F.row_number().over(W.partitionBy("shard", "part").orderBy("doc_id", "key"))
    return dealt.withColumn("place", place).join(before, ["shard", "part"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("place") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _number_of_ends_below(key: Column, ends: list[bytes]) -> Column:
    out = F.lit(0)
    for x in ends:
        out = out + F.when(key > F.lit(x), 1).otherwise(0)
    return out


def op2(spark, sf_dir: str) -> DataFrame:
    return shard(read(spark, sf_dir, "documents"))
