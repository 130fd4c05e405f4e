"""Byte-pair encoding, periodic runs and fill-in-the-middle against brute force, other libraries and defined cases."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
import tiktoken
from missive.llm import bpe, fill_middle
from missive.llm.common import read
from missive.llm.fill_middle import GRAMMARS, fill_in_middle, restored, units
from missive.llm.runs import find_runs, op12, runs_of
from public_tokenizers import PATTERN, path
from pyspark.sql import functions as F

DOC = "doc_id long, text string, ids string, form string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "own", "own") for i, t in rows], DOC)


@pytest.fixture(scope="module")
def ranks():
    with open(path("byte_bpe_50k.tiktoken"), "rb") as f:
        return bpe.ranks_of(f.read())


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(coded):
    return np.frombuffer(coded, np.int32).tolist()


def test_encoding_as_the_library(ranks, library):
    encoder, rng = bpe.Encoder(ranks, PATTERN), random.Random(1)
    encoder.MOST, encoder.PART, encoder.by.MOST_STATES, encoder.by.MOST_PAIRS = 300, 50, 500, 400  # memories start anew, parts end early
    tokens = list(ranks)
    for k in range(4000):
        if k % 3:
            text = "".join(rng.choices("abcdehinorst  \n\t'12é漢😀Ww-_=.,\x1c\x85 ", k=rng.randint(0, 200)))
        else:
            text = b"".join(rng.choices(tokens, k=8)).decode("utf-8", "replace")
        assert ids(encoder.of(text)) == library.encode_ordinary(text), text


def test_encoding_by_definition_of_any_vocabulary(library):
    rng = random.Random(2)
    for seed in range(20):
        rng.seed(seed)
        ranks = {bytes([b]): b for b in range(256)}
        known = [b"a", b"b", b"c"]
        while len(known) < 30:
            pair = rng.choice(known) + rng.choice(known)
            if pair not in ranks and len(pair) < 9 and len(bpe.merged(pair, ranks)) == 2:
                ranks[pair] = 256 + len(known)
                known.append(pair)
        encoder = bpe.Encoder(ranks, r"[\s\S]+")
        for _ in range(200):
            text = "".join(rng.choices("abc", k=rng.randint(1, 30)))
            assert ids(encoder.of(text)) == bpe.merged(text.encode(), ranks), (seed, text)


def test_encoding_is_linear_in_long_pieces(ranks):
    encoder = bpe.Encoder(ranks, PATTERN)
    for text in ("a" * 300_000, "ab" * 150_000, " " * 300_000 + "x", "\n" * 300_000):
        coded = ids(encoder.of(text))
        assert b"".join(encoder.by.tokens[i] for i in coded).decode() == text
    assert len(encoder.by._live) < 3000  # the outputs that wait stay short


def test_vocabularies_that_merges_cannot_make():
    with pytest.raises(ValueError):
        bpe.Transducer({b"a": 0})
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 300}  # no two parts make abc
    assert ids(bpe.Encoder(ranks, r"[\s\S]+").of("abcabc")) == [97, 98, 99] * 2


def test_decoding_as_codecs(ranks):
    rng, tokens = random.Random(3), {rank: token for token, rank in ranks.items()}
    single = [ranks[bytes([b])] for b in range(256)]
    decoder = bpe.Decoder(tokens)
    for k in range(3000):
        raw = "".join(rng.choices("aé漢😀", k=6)).encode() if k % 2 else bytes(rng.choices([0x61, 0x80, 0xA0, 0xBF, 0xC0, 0xC3, 0xE0, 0xED, 0xEF, 0xF0, 0x90, 0xF4, 0xF5], k=7))
        got = "".join(decoder.feed([i]) for i in (single[b] for b in raw)) + decoder.end()
        assert got == raw.decode("utf-8", "replace"), raw
    decoder = bpe.Decoder(tokens)
    parts = [decoder.feed([i]) for i in (single[b] for b in "😀a".encode())]
    assert parts == ["", "", "", "😀", "a"]  # a character comes when its last byte does
    assert decoder.feed([single[0xE6], -5, None, single[0x61]]) + decoder.end() == "���a"


def test_encode_and_decode_tables(spark, library):
    rows = [(1, "a  b'll\n"), (2, None), (3, ""), (None, "x"), (1, "a  b'll\n"), (4, "é漢😀 " * 3), (5, "wörd " * 400_000)]
    out = bpe.decode(bpe.encode(docs(spark, rows)), ids_col="ids_")
    assert out.columns == ["doc_id", "text", "ids", "form", "ids_", "decoded"]
    got = out.collect()
    assert sorted(map(str, (r.doc_id for r in got))) == sorted(str(i) for i, _ in rows)
    for r in got:
        assert r.ids == "own" and r.ids_ == library.encode_ordinary(r.text or "") and r.decoded == (r.text or "")
    both = bpe.encode(docs(spark, rows), decoded_col="form")
    assert both.columns == ["doc_id", "text", "ids", "form", "ids_", "form_"] and all(r.form_ == (r.text or "") for r in both.collect())
    assert bpe.decode(bpe.encode(docs(spark, [])), ids_col="ids_").count() == 0
    assert bpe.decode(spark.sql("SELECT CAST(NULL AS array<int>) AS ids")).first().decoded == ""


MATCHED = {
    "characters": r"[\s\S]",
    "lines": r"[^\n]*\n|[^\n]+",
    "words": r"\S+\s*|\s+",
    "paragraphs": r"(?:(?!\n\n[^\n])[\s\S])*(?:\n\n(?=[^\n])|$)",
    "classes": r"[^\W\d_]+|[0-9]+|\s+|[^\w\s]+",
}


def test_units_as_matched(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choices("ab1 \n.!é😀", k=rng.randint(0, 40))) for _ in range(300)] + ["\n", "\n\n", "a\n", "a", ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = df.select("text", *(units(F.col("text"), g).alias(g) for g in GRAMMARS)).collect()
    for r in rows:
        for g in GRAMMARS:
            assert "".join(r[g]) == r.text and "" not in r[g]
            if g in MATCHED:
                assert r[g] == [x for x in re.findall(MATCHED[g], r.text) if x], (g, r.text)


def by_hand(i, text):
    text = text or ""
    n = len(lines := re.findall(r"[^\n]*\n|[^\n]+", text))
    h = [int(x, 16) for x in re.findall(".{8}", hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest())]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    return (n, "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 50 else (n, "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle_by_hand(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choices("ab<>PSM\n😀", k=rng.randint(0, 30)))) for i in range(300)]
    rows += [(300, None), (301, ""), (302, "a<P>b"), (303, "\n"), (None, "x\ny\n"), (1, rows[1][1]), (304, "line\n" * 200_000), (305, "l" * 2_000_000)]
    df = docs(spark, rows)
    out = fill_in_middle(df)
    assert out.columns == ["doc_id", "text", "ids", "form", "n_units", "form_", "prefix", "middle", "suffix", "output"]
    out = out.withColumn("back", restored(F.col("output"), F.col("form_"))).collect()
    assert len(out) == len(rows) and {r.form_ for r in out} == {"plain", "psm", "spm"}
    for r in out:
        assert (r.n_units, r.form_, r.prefix, r.middle, r.suffix, r.output) == by_hand(r.doc_id, r.text)
        assert r.back == (r.text or "") and r.ids == r.form == "own"
    assert all(r.form_ == "plain" and r.output == (r.text or "") for r in fill_in_middle(df, rate=0).collect())
    assert fill_in_middle(docs(spark, [])).count() == 0
    marks = fill_middle.Marks("[p]", "[s]", "[m]")
    other = fill_in_middle(docs(spark, [(7, "a b c")]), grammar="words", marks=marks, spm_rate=0)
    r = other.withColumn("back", restored(F.col("output"), F.col("form_"), marks)).first()
    assert (r.n_units, r.form_, r.back) == (3, "psm", "a b c") and r.output.startswith("[p]")


def plain_runs(words, exponent=4, least=6):
    out, n = [], len(words)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            start, length = i, j - i + q
            piece = words[start : start + length]
            if length >= max(least, exponent * q) and not any(piece[p:] == piece[:-p] for p in range(1, q)):
                out.append((start, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_as_by_brute_force():
    rng = random.Random(6)
    for k in range(400):
        texts = []
        for _ in range(rng.randint(0, 5)):
            words = rng.choices("abc"[: rng.randint(1, 3)], k=rng.randint(0, 60))
            if rng.random() < 0.6:
                block = rng.choices("ab", k=rng.randint(1, 9))
                words[rng.randint(0, len(words)) :] = block * rng.randint(2, 7) + block[: rng.randint(0, 3)] + rng.choices("ab", k=rng.randint(0, 5))
            texts.append(words)
        flat = np.array([ord(w) - 97 for t in texts for w in t], np.int64)
        starts = np.cumsum([0, *map(len, texts)])
        for exponent, least in ((4, 6), (2, 0), (3, 4)):
            assert runs_of(flat, starts, least_exponent=exponent, least_length=least) == [plain_runs(t, exponent, least) for t in texts], (k, texts)


def test_runs_of_very_long_texts():
    rng = random.Random(7)
    part = [rng.randint(0, 500) for _ in range(30_000)]
    for words, expected in (([0] * 200_000, [(0, 200_000, 1)]), (part * 6, [(0, 180_000, 30_000)]), ([0, 1] * 100_000 + [2] + [0] * 7, [(0, 200_000, 2), (200_001, 7, 1)])):
        began = time.perf_counter()
        assert runs_of(np.array(words), np.array([0, len(words)])) == [expected]
        assert time.perf_counter() - began < 20


def plain_op12(i, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(i).encode()), len(words)
    g = h // 10
    if i is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (j - a) % p] for j in range(a, n)]
    runs = plain_runs(words)
    gone = {j for s, length, q in runs for j in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (i, len(runs), *(best[:1] + best[1:] + (1000 * best[1] // best[2],) if best else (None,) * 4), sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for j, w in enumerate(words) if j not in gone)))


def test_runs_query_by_brute_force(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    want = [plain_op12(r.doc_id, r.text) for r in read(spark, sf, "documents").collect() if len(r.text or "") < 12_000]
    got = {r.doc_id: tuple(r) for r in op12(spark, sf).collect()}
    assert len(want) > 150 and all(got[w[0]] == w for w in want) and sum(w[1] > 0 for w in want) > 10
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices("ab", k=rng.randint(0, 60)))) for i in range(150)] + [(150, None), (151, " \n\t"), (None, "a " * 9), (3, "x"), (3, "x"), (152, "b\x0bb\x0cb\rb b\tb\u00a0c")]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(repr, map(tuple, op12(spark, str(tmp_path)).collect()))) == sorted(repr(plain_op12(i, t)) for i, t in rows)


def test_find_runs_keeps_columns(spark):
    df = docs(spark, [(1, "x a b a b a b a b a b y"), (2, None), (None, "")]).withColumnRenamed("ids", "runs")
    out = find_runs(df, batch_words=1)
    assert out.columns == ["doc_id", "text", "runs", "form", "word_count", "runs_", "collapsed"]
    a, *others = sorted(out.collect(), key=lambda r: r.text or "", reverse=True)
    assert ([tuple(r) for r in a.runs_], a.collapsed, a.word_count, a.runs) == ([(1, 10, 2)], "x a b y", 12, "own")
    assert all((r.word_count, r.runs_, r.collapsed) == (0, [], "") for r in others)
    assert find_runs(docs(spark, [])).count() == 0
    assert "collapsed" not in find_runs(df, collapse=False).columns
