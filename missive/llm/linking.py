"""Components of a similarity graph from lists of possible partners, without a row for each pair of a list.

Items that share a signature may be linked. Sharing one is itself a graph: its components (``families``) hold all links,
and each item is sent to its family's task once, however many lists it stands in. A family of at most ``most`` items and
``most_bytes`` bytes is settled in one task by union-find; pairs that are already joined are not compared.

A larger family is dealt into blocks of that size. Each block is settled with the family's pivot (the item with least of
its own), so that a group of copies grows together in rows in proportion to its size. Lists that then lie within one
component are done. What is left forms new families; the blocks of those that are still larger are compared with each
other, but only the items outside a family's largest component against all. No pair is left out, no list is capped.

Defined cases: items without a signature in common with others get no row; a null signature array signs nothing; an
empty table gives no rows; ids are distinct and not null, of any type that has an order.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, stored, trimmed_worker

#: Items and bytes of a block, and bytes of the blocks that one task takes together.
MOST, MOST_BYTES, BIN_BYTES = 2048, 24_000_000, 8_000_000


def components(links: DataFrame) -> DataFrame:
    """(id, root) of every linked id, root the least id of its component: alternating large and small star steps."""
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    while True:
        ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 and up > 0").isEmpty():
            return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))  # stars only
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        new = stored(small, "links")
        drop(edges)
        edges = new


class Union:
    """Components of the items 0 to n - 1; items of equal roots are joined from the beginning."""

    def __init__(self, roots: np.ndarray):
        self.of = pd.factorize(roots)[0]

    def join(self, x: int, others: np.ndarray) -> None:
        if len(others):
            self.of[np.isin(self.of, self.of[others])] = self.of[x]


#: test(x, ys): those of the items ys that are linked with x.
Test = Callable[[int, np.ndarray], np.ndarray]
#: Makes the test of a block from its columns.
Prepared = Callable[[dict[str, np.ndarray]], Test]


def settled(union: Union, test: Test) -> None:
    """Joins all linked items, the first one as the first hub.

    An item that was compared with all others is done. When all items that are not done lie in one component, each pair
    of different components has been compared: the largest component's items need never be compared with each other.
    """
    rest, x = np.ones(len(union.of), bool), 0
    while True:
        ys = np.flatnonzero((union.of != union.of[x]) & rest)
        if len(ys):
            union.join(x, test(x, ys))
        rest[x] = False
        left = np.flatnonzero(rest)
        outside = left[union.of[left] != np.bincount(union.of[left]).argmax()] if len(left) else left
        if not len(outside):
            return
        x = int(outside[0])


def settled_between(union: Union, left: np.ndarray, right: np.ndarray, test: Test) -> None:
    """Joins the items of left with all of right that they are linked with."""
    for x in left.tolist():
        ys = right[union.of[right] != union.of[x]]
        if len(ys):
            union.join(x, test(x, ys))


def _pairs(rows: DataFrame, prepared: Prepared, id_type: str) -> DataFrame:
    """(a, b): for each component that a unit joins with others an item a of it, and the least such item b.

    rows: unit, bin, side (0: compared with each other; 1: compared with those of side 2), id, root, own and the payload.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        trimmed_worker()
        group = group.sort_values(["unit", "own", "id"], ignore_index=True)
        columns = {c: group[c].to_numpy() for c in group.columns}
        ends = np.append(np.flatnonzero(np.diff(columns["unit"])) + 1, len(group))
        out: list[tuple] = []
        for a, b in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True):
            rows_ = {c: x[a:b] for c, x in columns.items()}
            union, side = Union(rows_["root"]), rows_["side"]
            before = union.of.copy()
            if side.any():
                settled_between(union, np.flatnonzero(side == 1), np.flatnonzero(side == 2), prepared(rows_))
            else:
                settled(union, prepared(rows_))
            _, heads = np.unique(before, return_index=True)
            least: dict[int, object] = {}
            now, ids = union.of[heads].tolist(), rows_["id"][heads].tolist()
            for k, x in zip(now, ids, strict=True):
                least[k] = min(least.get(k, x), x)
            out += [(x, least[k]) for k, x in zip(now, ids, strict=True) if x != least[k]]
        return pd.DataFrame(out, columns=["a", "b"])

    return rows.groupBy("bin").applyInPandas(run, f"a {id_type}, b {id_type}")


def _families(lists: DataFrame) -> DataFrame:
    """(id, family) of the ids in lists (signature, id) that others share."""
    firsts = lists.groupBy("signature").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("signature", "first")
    edges = lists.join(firsts, "signature").select(F.col("id").alias("a"), F.col("first").alias("b"))
    found = components(edges)
    return found.select("id", F.col("root").alias("family")).unionByName(found.select(F.col("root").alias("id"), F.col("root").alias("family")).distinct())


def linked(items: DataFrame, payload: list[str], prepared: Prepared, *, most: int = MOST, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(id, root) of all ids that links join.

    items: id, own (the least make the best pivots), bytes, signatures and the payload columns, which ``prepared`` reads.
    """
    id_type = items.schema["id"].dataType.simpleString()
    posted = items.select(F.explode("signatures").alias("signature"), "id")
    lists, roots = posted, None
    while True:
        final = roots is not None
        families = stored(_families(lists), "families")
        if families.isEmpty():
            return roots if final else items.select("id", F.col("id").alias("root")).where(F.lit(False))
        here = families.join(items.select("id", "own", "bytes"), "id")
        here = here.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")) if final else here.withColumn("root", F.col("id"))
        of = here.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.min(F.struct("own", "id")).alias("pivot"))
        of = stored(of.select("family", "bytes", F.col("pivot.id").alias("pivot"), F.ceil(F.greatest(F.col("n") / most, F.col("bytes") / most_bytes, F.lit(1.0))).cast("int").alias("blocks")), "blocks")
        total, large = of.agg(F.sum("bytes"), F.count_if(F.col("blocks") > 1)).first()
        n_bins = max(1, math.ceil(total / BIN_BYTES))
        at = here.select("id", "own", "root", "family").join(of.select("family", "blocks", "pivot"), "family").withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
        units = at.where("blocks = 1").select("id", "own", "root", "family", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"))
        if large and not final:
            wide = at.where("blocks > 1")
            pivots = wide.where("id = pivot").select("id", "own", "root", "family", F.explode(F.expr("sequence(0, blocks - 1)")).alias("i"), "block").where("i <> block")
            units = units.unionByName(wide.select("id", "own", "root", "family", F.col("block").alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side")))
            units = units.unionByName(pivots.select("id", "own", "root", "family", "i", F.lit(0).alias("j"), F.lit(0).alias("side")))
        elif large:
            wide = at.where("blocks > 1")
            main = wide.groupBy("family", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("family").agg(F.max_by("root", F.struct("n", "root")).alias("main"))
            rest = wide.join(main, "family").where("root <> main")
            n_rest = rest.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("rests"))
            left = rest.join(n_rest, "family").withColumn("i", F.pmod(F.xxhash64(F.lit(1), "id"), "rests")).withColumn("j", F.explode(F.expr("sequence(0, blocks - 1)")))
            right = wide.join(n_rest, "family").withColumn("j", F.col("block")).withColumn("i", F.explode(F.expr("sequence(0, rests - 1)")))
            units = units.unionByName(left.select("id", "own", "root", "family", "i", "j", F.lit(1).alias("side"))).unionByName(right.select("id", "own", "root", "family", "i", "j", F.lit(2).alias("side")))
        unit = F.xxhash64("family", "i", "j")
        rows = units.withColumn("unit", unit).withColumn("bin", F.pmod(unit, F.lit(n_bins))).join(items.select("id", *payload), "id")
        links = stored(_pairs(rows.select("unit", "bin", "side", "id", "root", "own", *payload), prepared, id_type), "verified")
        new = _joined(roots, links)
        if roots is not None:
            drop(roots)
        roots = new
        if final or not large:
            drop(families, of, links)
            return roots
        wide_ids = stored(at.where("blocks > 1").select("id"), "wide")
        drop(families, of, links)
        known = posted.join(wide_ids, "id", "left_semi").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
        open_ = known.groupBy("signature").agg(F.min("root").alias("least"), F.max("root").alias("greatest")).where("least < greatest").select("signature")
        lists = known.join(open_, "signature", "left_semi").select("signature", "id")


def _joined(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """roots after the links have joined some of their components."""
    if roots is None:
        found = components(links)
        return found.unionByName(found.select(F.col("root").alias("id"), "root").distinct())
    of_a, of_b = (roots.select(F.col("id").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
    over = links.join(of_a, "a", "left").join(of_b, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    merged = components(over).select(F.col("id").alias("root"), F.col("root").alias("to"))
    moved = roots.join(merged, "root", "left").select("id", F.coalesce("to", "root").alias("root"))
    alone = merged.select(F.col("root").alias("id"), F.col("to").alias("root"))
    alone = alone.unionByName(merged.select(F.col("to").alias("id"), F.col("to").alias("root")).distinct()).join(roots.select("id"), "id", "left_anti")
    return stored(moved.unionByName(alone), "roots")
