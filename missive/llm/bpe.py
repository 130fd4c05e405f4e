"""Byte-level BPE by a lazily determinised finite-state transducer, and decoding by an incremental UTF-8 state machine.

The merges are compiled into a non-deterministic transducer over bytes. Its states are pairs of the last finished token and the
bytes begun since; from a pair, a byte goes on to a longer beginning of some token, and, if these bytes are a token that
may follow the last one, also to the pair that has finished it, with the token as output. A token may follow another if
the merges turn the two tokens' bytes into just these two. Neighbours that may follow each other are a whole encoding, so
for every text one path alone finishes a token at its end: the encoding of that text.

The transducer is made deterministic while texts are read: a state of the result is the set of live pairs, each with the
output that is not yet written. What all of them agree on is written at once. A pair lives as long as its bytes begin a
token, so the lookahead is bounded by the vocabulary. States are built when first reached, in a memory of bounded size
that starts anew when full. Reading is linear in the text, pieces of a million letters included.

Decoding reads ids one by one; the state is the (at most three) bytes of a character that is not complete yet, so
characters whose bytes are spread over tokens come out whole, in pieces of bounded size.

Defined cases: a null or empty text has no ids, null or no ids decode to an empty text; bytes that are no UTF-8 decode to
U+FFFD each maximal part, an id that the vocabulary lacks and a null id to U+FFFD; repeated rows are coded each; very long
texts are read in parts that end before white space; an empty table gives no rows; other columns are kept, and new ones get
names that the table does not have yet.
"""

from __future__ import annotations

import base64
import contextlib
import gc
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import own_name, read, remembered, ship


class Ambiguous(ValueError):
    """The merges give some text no path or several: the vocabulary is not one that merges can make."""


def ranks_of(lines: bytes) -> dict[bytes, int]:
    """Token -> rank of a rank file: base64 and number in each line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines.splitlines() if line.strip())}


def merges(piece: bytes, ranks: dict[bytes, int]) -> Iterator[list[bytes]]:
    """The parts of a piece at first and after each merge, as merges are defined: of all neighbours that make a token those of least rank, the leftmost of equals."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        yield [*parts]
        found = [(rank, i) for i, pair in enumerate(zip(parts, parts[1:], strict=False)) if (rank := ranks.get(pair[0] + pair[1])) is not None]
        if not found:
            return
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The encoding of a piece by its definition."""
    *_, parts = merges(piece, ranks)
    return [ranks[x] for x in parts]


class _Follows(dict):
    """last << 32 | token -> whether the merges leave the border between the two."""

    __slots__ = ("of",)

    def __missing__(self, key: int) -> bool:
        if len(self) >= self.of.MOST_PAIRS:
            self.clear()
        found = self[key] = key < 0 or self.of.apart(key >> 32, key & 0xFFFFFFFF)
        return found


class Transducer:
    #: States, and pairs of tokens, that are remembered at most; bytes of a short piece.
    MOST_STATES, MOST_PAIRS, SHORT = 120_000, 400_000, 40

    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a byte-level vocabulary has all single bytes")
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        nodes, rank, longer = {b"": 0}, [-1], [True]  # a node is a beginning of tokens
        ways: dict[int, int] = {}
        for token, r in ranks.items():
            node = 0
            for i, byte in enumerate(token):
                longer[node] = True
                begun = token[: i + 1]
                if begun not in nodes:
                    nodes[begun] = len(rank)
                    ways[node << 8 | byte] = len(rank)
                    rank.append(-1)
                    longer.append(False)
                node = nodes[begun]
            rank[node] = r
        #: node << 8 | byte -> node, the token it is (-1: none), and whether longer tokens begin with it
        self._next = {way: (node, rank[node], longer[node]) for way, node in ways.items()}
        self._edges: dict[int, tuple[list, list]] = {}
        self._follows = _Follows()
        self._follows.of = self
        self._states: dict[tuple, int] = {}
        self._live: list[tuple] = []
        self._ways: dict[int, tuple[int, tuple[int, ...]]] = {}
        self._once: set[int] = set()
        self._anew()

    def _anew(self) -> None:
        for memory in (self._states, self._live, self._ways, self._once):
            memory.clear()
        self._state(((-1, 0, ()),))  # the start, number 0

    def _state(self, live: tuple) -> int:
        found = self._states.get(live)
        if found is None:
            found = self._states[live] = len(self._live)
            self._live.append(live)
        return found

    def edges(self, token: int) -> tuple[list, list]:
        """What stands at the left and at the right end of a token while the merges make it: (bytes, rank of the merge that takes it up), from the single byte on."""
        found = self._edges.get(token)
        if found is None:
            whole = self.tokens[token]
            if len(whole) == 1:
                left, right = [], []
            else:
                *_, pair, made = merges(whole, self.ranks)
                if made != [whole]:
                    raise Ambiguous(f"the merges do not make token {token}")
                a, b = pair
                left, right = self.edges(self.ranks[a])[0][:-1] + [(a, token)], self.edges(self.ranks[b])[1][:-1] + [(b, token)]
            found = self._edges[token] = ([*left, (whole, 1 << 40)], [*right, (whole, 1 << 40)])
        return found

    def apart(self, last: int, token: int) -> bool:
        """Whether no merge joins the two tokens: none of those that meet at the border comes before both its parts are taken up within their tokens."""
        (lefts, rights), ranks = (self.edges(last)[1], self.edges(token)[0]), self.ranks
        i = j = 0
        while True:
            (a, until_a), (b, until_b) = lefts[i], rights[j]
            rank = ranks.get(a + b)
            if rank is not None and rank < until_a and rank <= until_b:  # of equal ranks the leftmost merge is first
                return False
            if until_a <= until_b:
                i += 1
            else:
                j += 1
            if i == len(lefts) or j == len(rights):
                return True

    def _step(self, pairs: tuple | list, byte: int) -> list:
        """The live pairs after a byte, that with a finished token last."""
        follows, after = self._follows, self._next.get
        live, done = [], None
        for last, node, out in pairs:
            found = after(node << 8 | byte)
            if found is None:
                continue
            node, token, longer = found
            if token >= 0 and follows[last << 32 | token]:
                if done is not None:
                    raise Ambiguous("two encodings")
                done = (token, 0, (*out, token))
            if longer:
                live.append((last, node, out))
        if done is None:
            raise Ambiguous("no encoding")
        live.append(done)
        return live

    def way(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Where a byte leads from a state, and the output that all that live then agree on."""
        live = self._step(self._live[state], byte)
        first, n = live[0][2], 0
        if first and all(out and out[0] == first[0] for _, _, out in live):
            outs = [out for _, _, out in live]
            low, high = min(outs), max(outs)  # what these two agree on all do
            while n < len(low) and low[n] == high[n]:
                n += 1
        way = self._ways[state << 8 | byte] = self._state(tuple([(last, node, out[n:]) for last, node, out in live] if n else live)), first[:n]
        return way

    def encode(self, piece: bytes) -> array:
        """The ids of a piece. A way that a short piece takes for the first time is not remembered, but the rest of the piece read pair by pair: most such ways are taken once."""
        if len(self._live) >= self.MOST_STATES:
            self._anew()
        ids, state, ways, short = array("i"), 0, self._ways.get, len(piece) <= self.SHORT
        for i, byte in enumerate(piece):
            key = state << 8 | byte
            way = ways(key)
            if way is None:
                if short and key not in self._once:
                    if len(self._once) >= 2 * self.MOST_STATES:
                        self._once.clear()
                    self._once.add(key)
                    pairs = self._live[state]
                    for byte in piece[i:]:
                        pairs = self._step(pairs, byte)
                    ids.extend(pairs[-1][2])
                    return ids
                way = self.way(state, byte)
            state, out = way
            if out:
                ids.extend(out)
        ids.extend(self._live[state][-1][2])
        return ids


#: White space as the pattern has it, for Python's own regex.
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


class Encoder:
    """Whole texts. A match of the pattern is white space, or has none but for a space in front; so a text is cut there first, and what was
    encoded is remembered by these words (two generations of a bounded number). A new word's matches each go through the transducer."""

    MOST, LONGEST = 300_000, 32
    #: Characters that are split at a time; a part ends between a character and white space, where a match always ends.
    PART = 500_000
    _END = re.compile(f"(?<=[^{_WHITE}])(?=[{_WHITE}])")
    _WORD = re.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")

    def _words(self, text: str) -> list[str]:
        """What _WORD finds: without it if the white space is single spaces and newlines between other characters."""
        words: list[str] = []
        lines = text.split("\n")
        for line in lines:
            first, *rest = line.split(" ")
            words += ["\n", first] if words else [first]
            words += [" " + x for x in rest]
        even = len(words) - len(lines) + 1 == len(text.split()) and "" not in words and " " not in words
        return words if even else self._WORD.findall(text)

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.by, self._pattern = Transducer(ranks), regex.compile(pattern)
        self._new, self._old = {}, {}

    def _ids(self, word: str) -> bytes:
        found = self._old.get(word)
        if found is None:
            matches = () if word.lstrip(" ").isalpha() else self._pattern.findall(word)
            found = b"".join(map(self._known, matches)) if len(matches) > 1 else self._piece(word)
        return self._kept(word, found)

    def _kept(self, word: str, found: bytes) -> bytes:
        if len(word) <= self.LONGEST:
            if len(self._new) >= self.MOST:
                self._old = dict(self._new)
                self._new.clear()
            self._new[word] = found
        return found

    def _known(self, piece: str) -> bytes:
        return self._new.get(piece) or self._kept(piece, self._old.get(piece) or self._piece(piece))

    def _piece(self, piece: str) -> bytes:
        try:
            return self.by.encode(piece.encode()).tobytes()
        except Ambiguous:
            return array("i", merged(piece.encode(), self.by.ranks)).tobytes()

    def of(self, text: str) -> bytes:
        """The ids of a text as 32-bit numbers."""
        at, out, known = 0, [], self._new.get
        while at < len(text):
            end = self._END.search(text, at + self.PART) if len(text) - at > self.PART else None
            end = end.start() if end else len(text)
            out.append(b"".join([known(x) or self._ids(x) for x in self._words(text[at:end])]))
            at = end
        return b"".join(out)


def _wanted(begun: bytes) -> tuple[int, range] | None:
    """For the first bytes of a character: how many are still to come, and the range of the next; None if no character begins so."""
    first = begun[0]
    if 0xC2 <= first <= 0xDF:
        n, second = 2, range(0x80, 0xC0)
    elif 0xE0 <= first <= 0xEF:
        n, second = 3, range({0xE0: 0xA0}.get(first, 0x80), {0xED: 0xA0}.get(first, 0xC0))
    elif 0xF0 <= first <= 0xF4:
        n, second = 4, range({0xF0: 0x90}.get(first, 0x80), {0xF4: 0x90}.get(first, 0xC0))
    else:
        return None
    return n - len(begun), second if len(begun) == 1 else range(0x80, 0xC0)


class _Half(dict):
    """id -> (text that is complete with it, next state): a state of the decoder, the bytes of a character begun."""

    __slots__ = ("begun", "of")

    def __init__(self, of: Decoder, begun: bytes):
        self.of, self.begun = of, begun

    def __missing__(self, i: int | None) -> tuple[str, _Half]:
        way = self.of.way(self.begun, i)
        if self.of.room():
            self[i] = way
        return way


class Decoder:
    """ids -> text, in order; ``feed`` gives what is complete, ``end`` what is left."""

    #: Ways that are remembered at most, and ids that are looked up together.
    MOST, STRETCH, PART = 200_000, 500, 100_000

    def __init__(self, tokens: dict[int, bytes]):
        self._tokens, self._states, self._ways = tokens, {}, 0
        self._whole = {}  # the ways from the start back to it
        for i, token in tokens.items():
            with contextlib.suppress(UnicodeDecodeError):
                self._whole[i] = token.decode()
        self.start = self.state = self._state(b"")

    def _state(self, begun: bytes) -> _Half:
        found = self._states.get(begun)
        if found is None:
            found = self._states[begun] = _Half(self, begun)
        return found

    def room(self) -> bool:
        self._ways += 1
        return self._ways <= self.MOST

    def way(self, begun: bytes, i: int | None) -> tuple[str, _Half]:
        token, out = self._tokens.get(i), []
        if token is None:
            return "�" * (2 if begun else 1), self.start
        for b in token:
            if begun:
                n, next_byte = _wanted(begun)
                if b in next_byte:
                    begun += bytes([b])
                    if n == 1:
                        out.append(begun.decode())
                        begun = b""
                    continue
                out.append("�")
                begun = b""
            if b < 0x80:
                out.append(chr(b))
            elif _wanted(bytes([b])):
                begun = bytes([b])
            else:
                out.append("�")
        return "".join(out), self._state(begun)

    def feed(self, ids: Iterable[int | None]) -> str:
        out, state, start, n = [], self.state, self.start, self.STRETCH
        ids = ids if isinstance(ids, list) else list(ids)
        for a in range(0, len(ids), n):
            stretch = ids[a : a + n]
            if state is start:
                try:  # ways from the start back to it need no state between them
                    out.append("".join(map(self._whole.__getitem__, stretch)))
                    continue
                except KeyError:
                    pass
            for i in stretch:
                text, state = state[i]
                out.append(text)
        self.state = state
        return "".join(out)

    def whole(self, ids: np.ndarray | pa.Array) -> str:
        """The text of an array of ids, fed part by part."""
        listed = ids.tolist if isinstance(ids, np.ndarray) else ids.to_pylist
        if len(ids) > self.PART:
            return "".join([self.feed(x.tolist() if isinstance(x, np.ndarray) else x.to_pylist()) for x in (ids[a : a + self.PART] for a in range(0, len(ids), self.PART))]) + self.end()
        return self.feed(listed()) + self.end()

    def end(self) -> str:
        left = "�" if self.state.begun else ""
        self.state = self.start
        return left


@contextlib.contextmanager
def _no_cycles() -> Iterator[None]:
    """Without the collector of cycles: the memories of states are large and have none, and it would walk them again and again."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def parted(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows, so that less is held at once."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def _vocabulary(path: str | None, pattern: str | None) -> tuple[bytes, str]:
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read(), pattern or public_tokenizers.PATTERN


def encode(docs: DataFrame, *, ranks: str | None = None, pattern: str | None = None, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """docs with the ids of each whole text, array<int>, and, if a column is named for it, the text that these ids decode to (in the same stage, so that
    Python workers keep one kind of memory). ranks: a rank file on the driver's machine; its bytes, the size of the vocabulary, are broadcast."""
    spark = docs.sparkSession
    ship(spark)
    name, work, here = own_name(docs, ids_col), own_name(docs, "text_to_encode"), docs.columns
    back = own_name(docs.withColumn(name, F.lit(None)), decoded_col) if decoded_col else None
    sent = spark.sparkContext.broadcast(_vocabulary(ranks, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, splits = sent.value
        encoder = remembered(f"bpe encoder {zlib.crc32(lines)} {splits}", lambda: Encoder(ranks_of(lines), splits))
        decoder = Decoder(encoder.by.tokens) if back else None
        for batch in parted(batches):
            with _no_cycles():
                found = [np.frombuffer(encoder.of(x.as_py() or ""), np.int32) for x in batch.column(len(here))]
            ends = np.cumsum([0, *map(len, found)])
            flat = pa.array(np.concatenate([np.empty(0, np.int32), *found]))
            made = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)]
            if back:
                made.append(pa.array([decoder.whole(x) for x in found], pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(here)], *made], names=[*here, name, *[back] * bool(back)])

    schema = docs.select(*docs.columns, F.lit(None).cast("array<int>").alias(name), *([F.lit(None).cast("string").alias(back)] if back else [])).schema
    return docs.select("*", F.col(text_col).alias(work)).mapInArrow(run, schema)


def decode(df: DataFrame, *, ranks: str | None = None, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """df with the text of each row's ids."""
    spark = df.sparkSession
    ship(spark)
    name, work = own_name(df, decoded_col), own_name(df, "ids_to_decode")
    sent = spark.sparkContext.broadcast(_vocabulary(ranks, ""))
    here = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder({rank: token for token, rank in ranks_of(sent.value[0]).items()})
        for batch in parted(batches):
            texts = [decoder.whole(row.values) if row.values is not None else "" for row in batch.column(len(here))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(here)], pa.array(texts, pa.string())], names=[*here, name])

    schema = df.select(*df.columns, F.lit(None).cast("string").alias(name)).schema
    return df.select("*", F.col(ids_col).cast("array<int>").alias(work)).mapInArrow(run, schema)


def op11(spark, sf_dir: str) -> DataFrame:
    coded = encode(read(spark, sf_dir, "documents").select("doc_id", "text"), decoded_col="decoded")
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
