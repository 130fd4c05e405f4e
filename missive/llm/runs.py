"""Periodic runs of words, by branching tandem repeats in a suffix tree.

The words of a batch of texts become numbers, and a suffix tree of them (a separate one for each text) is laid out in arrays:
suffixes are sorted by doubling the compared length, neighbours' common lengths follow from the kept ranks of each
doubling, and an inner node is an interval of sorted suffixes with a depth. Of every node's children all leaves but the
largest child's are visited (each word at most log2 n times): for a leaf ``i`` of a node of depth ``d`` it is looked up
whether ``i + d`` or ``i - d`` is a leaf of another child of the node. Such a pair is a branching tandem repeat: the same
``d`` words twice, which go on differently. It is the last place of its repeat; rotating it to the left, word by word as
long as the words ``d`` apart are equal, gives all its places, and their union is a maximal run. Repeats with a period that is
not the smallest have the same run and are merged into it.

A run of exponent e has its period's words at e places, so suffixes of which fewer share a beginning are not sorted
further, and nodes with fewer leaves are not visited: this leaves out no run and bounds the work on ordinary texts.

Defined cases: a null or empty text, or one of white space, has no words and no runs; ties for the longest run go to the
smallest start, then period; repeated rows are each searched; a batch takes whole texts up to a number of words or one
longer text (memory grows with its words); null ids and other columns are kept as they are, and new columns get names that
the table does not have yet; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, distinct, own_name, read, ship, text_or_empty

RUN = "array<struct<start:long,length:long,period:long>>"
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class SuffixTree:
    """The part of the suffix trees of several texts whose nodes have ``least`` leaves or more.

    ``words``: numbers of all texts' words one after the other; ``ends``: where each word's text ends. ``order`` has the suffixes that share
    their first word with ``least`` others or more; ``place`` is each suffix's number there (-1: none). Suffixes not sorted further stand together in
    ``order``, and belong to the same nodes.
    """

    def __init__(self, words: np.ndarray, ends: np.ndarray, least: int):
        n = len(words)
        # by the first word, texts apart
        key = words.astype(np.int64) * (n + 1) + ends
        order = np.argsort(key, kind="stable")
        new = np.r_[True, key[order][1:] != key[order][:-1]][:n]
        first, sizes = self._groups(new)
        keep = np.repeat(sizes >= least, sizes)
        order, new = order[keep], new[keep]
        m = len(order)
        rank = np.full(n + 1, -1, np.int64)  # of a suffix by its first words, as far as they are compared: the first place of those equal to it
        if m:
            rank[order] = np.repeat(*self._groups(new))
        # everything else is -2 minus its word, so unequal words never look equal
        rank[:n] = np.where(rank[:n] < 0, -2 - words, rank[:n])
        self._levels = [rank.copy()]
        active = np.arange(m)
        border = new.copy()  # places where a suffix differs from the one before, as far as compared
        length = 1
        while len(active):
            at = order[active]
            second = np.where(at + length < ends[at], rank[np.minimum(at + length, n)], -1 - n - len(words))
            mine = rank[at]
            by = np.lexsort((second, mine))
            order[active], second, mine = at[by], second[by], mine[by]
            differs = np.r_[True, (mine[1:] != mine[:-1]) | (second[1:] != second[:-1])]
            border[active] |= differs
            first, sizes = self._groups(differs)
            rank[order[active]] = np.repeat(active[first], sizes)
            length *= 2
            self._levels.append(rank.copy())
            active = active[np.repeat(sizes >= least, sizes)]
        self.order, self._words, self._ends = order, words, ends
        self.place = np.full(n, -1, np.int64)
        self.place[order] = np.arange(m)
        self._nodes(border, least)

    @staticmethod
    def _groups(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = np.flatnonzero(new)
        return first, np.diff(np.r_[first, len(new)])

    def _common(self, borders: np.ndarray) -> np.ndarray:
        """The number of words that the suffixes at both sides of each border (places, the first one left out) have in common."""
        a, b = self.order[borders - 1], self.order[borders]
        out = np.zeros(len(borders), np.int64)
        for k in range(len(self._levels) - 1, -1, -1):
            rank, x, y = self._levels[k], a + out, b + out
            inside = (x < self._ends[a]) & (y < self._ends[b])
            x, y = x[inside], y[inside]
            out[inside] += np.where(rank[x] == rank[y], 1 << k, 0)
        return out

    def _nodes(self, border: np.ndarray, least: int) -> None:
        """Inner nodes: ``depth``, and their children's intervals of places as ``node``, ``left``, ``right`` (the end excluded)."""
        m = len(self.order)
        first = np.flatnonzero(border)
        common = self._common(first[1:])
        # children of a node lie between borders of its depth within its interval: borders at which less is common end it
        left, right = _nearest_smaller(common)
        inner = np.flatnonzero(common > 0)
        begins, stops = first[left[inner] + 1], np.r_[first, m][right[inner] + 1]
        inner, begins, stops = (x[stops - begins >= least] for x in (inner, begins, stops))
        by = np.lexsort((inner, begins, common[inner]))
        inner, begins, stops, depth = inner[by], begins[by], stops[by], common[inner[by]]
        new = np.r_[True, (begins[1:] != begins[:-1]) | (depth[1:] != depth[:-1])][: len(inner)]
        node = np.cumsum(new) - 1
        last = np.r_[new[1:], True][: len(inner)]
        cut = first[inner + 1]
        before = np.where(new, begins, np.r_[0, cut[:-1]][: len(inner)])
        self.depth, self.left_end, self.right_end = depth[new], begins[new], stops[new]
        self.node, self.left, self.right = np.r_[node, node[last]], np.r_[before, cut[last]], np.r_[cut, stops[last]]

    def branching_repeats(self, block: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
        """Start and period of all tandem repeats at a node whose two halves go on differently."""
        size = self.right - self.left
        largest = np.zeros(len(self.depth), np.int64)
        by = np.lexsort((size, self.node))
        last = np.r_[self.node[by][1:] != self.node[by][:-1], True][: len(by)]
        largest[self.node[by][last]] = by[last]
        small = np.ones(len(size), bool)
        small[largest] = False
        child = np.flatnonzero(small)
        found = []
        sums = np.cumsum(size[child])
        for a in range(0, int(sums[-1]) if len(sums) else 0, block):
            # leaves number a to a + block of the smaller children
            lo, hi = np.searchsorted(sums, a, "right"), np.searchsorted(sums, a + block - 1, "right") + 1
            part = child[lo:hi]
            begin, end = self.left[part].copy(), self.right[part].copy()
            start_of = sums[lo:hi] - size[part]
            begin += np.maximum(0, a - start_of)
            end -= np.maximum(0, sums[lo : lo + len(part)] - (a + block))
            n = end - begin
            leaf = np.repeat(begin - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            node = np.repeat(self.node[part], n)
            i, d = self.order[leaf], self.depth[node]
            lo_end, hi_end = self.left_end[node], self.right_end[node]
            total = len(self._words)
            for other, start in ((i + d, i), (i - d, i - d)):
                inside = (other >= 0) & (other < total)
                place = np.where(inside, self.place[np.clip(other, 0, total - 1)], -1)
                good = (place >= lo_end) & (place < hi_end)
                s, p = start[good], d[good]
                ends = self._ends[s]
                after = s + 2 * p  # the second half ends before it; at the text's end nothing follows, which differs from any word
                differs = (after >= ends) | (self._words[np.minimum(s + p, total - 1)] != self._words[np.minimum(after, total - 1)])
                found.append(s[differs] * (total + 1) + p[differs])
        pairs = distinct(np.concatenate([np.empty(0, np.int64), *found]))
        return pairs // (len(self._words) + 1), pairs % (len(self._words) + 1)


def _nearest_smaller(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry the place of the nearest smaller one before (-1: none) and after (len(a): none), by halving steps over minima of stretches."""
    n = len(a)
    minima = [a]  # minima[k][i] is the least of a[i : i + 2**k]
    while 2 << (len(minima) - 1) <= n:
        last, half = minima[-1], 1 << (len(minima) - 1)
        minima.append(np.minimum(last[: len(last) - half], last[half:]))
    right, left = np.arange(n), np.arange(1, n + 1)  # right: the first place not known to be at least a; left: one past it
    for k in range(len(minima) - 1, -1, -1):
        least, step = minima[k], 1 << k
        fits = right + step <= n
        ahead = np.where(fits, least[np.minimum(right, len(least) - 1)], -1)
        right = np.where(fits & (ahead >= a), right + step, right)
        fits = left - step >= 0
        behind = np.where(fits, least[np.clip(left - step, 0, len(least) - 1)], -1)
        left = np.where(fits & (behind >= a), left - step, left)
    return left - 1, right


def _equal_before(words: np.ndarray, start: int, period: int, floor: int) -> int:
    """How far the stretch of words equal to those a period later goes on to the left of start, at most to floor."""
    at, step = start, 64
    while at > floor:
        low = max(floor, at - step)
        differ = np.flatnonzero(words[low:at] != words[low + period : at + period])
        if len(differ):
            return low + int(differ[-1]) + 1
        at, step = low, step * 4
    return at


def runs_of(words: np.ndarray, starts: np.ndarray, *, least_exponent: int = 4, least_length: int = 6) -> list[list[tuple[int, int, int]]]:
    """For each text its maximal runs (start, length, smallest period), in order. words: numbers of the words; starts: where each text begins, and the end."""
    texts = len(starts) - 1
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(texts)]
    if not len(words):
        return out
    ends = np.repeat(starts[1:], np.diff(starts))
    at, period = SuffixTree(words, ends, least_exponent).branching_repeats()
    by = np.lexsort((period, at + 2 * period))
    text = np.searchsorted(starts, at[by], "right") - 1
    end, here = -1, []
    for i, p, t in zip(at[by].tolist(), period[by].tolist(), text.tolist(), strict=True):
        if i + 2 * p != end:
            end, here = i + 2 * p, []
        if any(p % q == 0 and i >= start for start, q in here):  # a multiple of a period, within that one's run
            continue
        start = _equal_before(words, i, p, int(starts[t]))
        here.append((start, p))
        if end - start >= max(least_length, least_exponent * p):
            out[t].append((start - int(starts[t]), end - start, p))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def _kept(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run contains after its first period, joined by spaces."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


def find_runs(docs: DataFrame, *, least_exponent: int = 4, least_length: int = 6, text_col: str = "text", batch_words: int = 200_000, collapse: bool = True) -> DataFrame:
    """docs with word_count, runs (array of start, length, period in words, by start and period) and, if asked for, collapsed: the text without its runs' repeated periods."""
    if least_exponent < 2:
        raise ValueError("a run has its period twice at least")
    ship(docs.sparkSession)
    names: list[str] = []
    for base in ("word_count", "runs", *["collapsed"] * collapse):
        names.append(own_name(docs, base))
    work, here = own_name(docs, "text_to_search"), docs.columns

    def search(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
        numbers: dict[bytes, int] = {}
        number = numbers.setdefault
        flat = np.fromiter((number(w, len(numbers)) for words in texts for w in words), np.int64)
        return runs_of(flat, np.cumsum([0, *map(len, texts)]), least_exponent=least_exponent, least_length=least_length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, n, a = batch.column(len(here)), batch.num_rows, 0
            while a < n:
                texts, total, b = [], 0, a
                while b < n and (b == a or total < batch_words):
                    texts.append((column[b].as_py() or b"").split())
                    total += len(texts[-1])
                    b += 1
                runs = search(texts)
                cols = [pa.array([len(t) for t in texts], pa.int64()), pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in rs] for rs in runs], _RUN)]
                if collapse:
                    cols.append(pa.array([_kept(t, r).decode() for t, r in zip(texts, runs, strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[: len(here)]), *cols], names=[*here, *names])
                a = b

    kinds = ["long", RUN, "string"]
    schema = docs.select("*", *(F.lit(None).cast(k).alias(c) for c, k in zip(names, kinds, strict=False))).schema
    return docs.select("*", F.col(text_col).cast("binary").alias(work)).mapInArrow(run, schema)


def planted(text: Column, key: Column) -> Column:
    """The text, or for a tenth of the keys (32-bit hashes) its words with a periodic end."""
    words = F.filter(F.split(text, WORD.replace("[^", "["), -1), lambda w: w != "")
    g = F.floor(key / 10).cast("long")

    def periodic(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        block = F.slice(w, (a + 1).cast("int"), p.cast("int"))
        times = F.ceil((n - a) / p).cast("int")
        tail = F.slice(F.flatten(F.array_repeat(block, times)), F.lit(1), (n - a).cast("int"))
        return F.array_join(F.concat(F.slice(w, F.lit(1), a.cast("int")), tail), " ")

    # a function over a one-element array computes the words once
    changed = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, periodic(w)).otherwise("")), 0)
    return F.when(key % 10 == 0, changed).otherwise(text)


def op12(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    text = planted(text_or_empty(), F.crc32(F.col("doc_id").cast("string")))
    out = find_runs(docs.select("doc_id", text.alias("text")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("m"), listed.alias("listed"), "collapsed").select(
        "doc_id", "n_runs", F.col("m.s").alias("start"), (-F.col("m.l")).alias("length"), F.col("m.p").alias("period"),
        F.floor(-F.col("m.l") * 1000 / F.col("m.p")).cast("long").alias("exponent_milli"), F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
