"""Perplexity, decontamination, licenses, token counts, packing and page text against brute force and defined cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from missive.llm import packing, tokens
from missive.llm.decontaminate import decontaminated, scan
from missive.llm import html_text
from missive.llm.html_text import blocks_of, extract, main_text, ratios_of
from missive.llm.licenses import differences, scan_licenses, words_of
from missive.llm.perplexity import discounts_of, judged, passing, scores
from missive.llm.token_counts import count_tokens
from pyspark.sql import functions as F

DOC = "doc_id long, text string, lang string, source string, n_chars long, n_words string"


def docs(spark, texts, langs=None):
    rows = [(None if i == "null" else i, t, (langs or {}).get(i, "en"), "s", 1, "own") for i, t in texts]
    return spark.createDataFrame(rows, DOC)


def words(rng, n, of="abcdefgh"):
    return " ".join("".join(rng.choices(of, k=rng.randint(1, 3))) for _ in range(n))


def test_decontamination_as_by_brute_force(spark):
    rng = random.Random(1)
    items = [(i, words(rng, rng.choice([0, 4, 10, 14]), "ab")) for i in range(12)] + [(99, None), (3, "One-Two  three")]
    split = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    texts = [(i, " ".join([words(rng, 8, "ab"), rng.choice(items)[1] or "", words(rng, 5, "abé"), "ONE two THREE" * (i % 5 == 0)])) for i in range(40)]
    texts += [(40, None), (41, ""), (7, texts[7][1]), ("null", texts[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block, part in ((4_000_000, 20_000), (60, 20_000), (60, 3)):
        got = scan(docs(spark, texts), bench, block_bytes=block, part_words=part).collect()
        assert len(got) == len(texts) and got[0].n_words == "own"
        for r in got:
            w, hit, ids = split(r.text), set(), set()
            for item, t in items:
                x = split(t)
                n = min(10, len(x))
                for p in range(len(x) - n + 1 if n else 0):
                    for q in range(len(w) - n + 1):
                        if w[q : q + n] == x[p : p + n]:
                            hit |= set(range(q, q + n))
                            ids.add(item)
            assert (r.n_words_, r.n_hit, set(r["items"])) == (len(w), len(hit), set(map(str, ids)))
    texts.append((50, "x1 x2 " + " ".join(["ONE two", "one two three", "three"] * 3) + " x3"))  # a removal brings a window together
    many = sorted(map(repr, decontaminated(docs(spark, texts), bench, block_bytes=60).collect()))
    assert many == sorted(map(repr, decontaminated(docs(spark, texts), bench).collect()))
    kept = decontaminated(docs(spark, texts), bench)
    assert kept.columns == docs(spark, texts).columns
    assert all(r.n_hit == 0 for r in scan(kept, bench).collect())
    assert decontaminated(docs(spark, []), bench).count() == 0
    assert decontaminated(docs(spark, texts), spark.createDataFrame([], bench.schema)).count() == len(texts)


def test_decontamination_of_a_very_long_text_and_memory_of_a_block():
    import pickle

    from missive.llm.decontaminate import Windows

    rng = random.Random(2)
    items = [(i, words(rng, 2000, "abcdefghijkl")) for i in range(50)]
    block = Windows(items, 10)
    assert len(pickle.dumps(block, 5)) < 8 * sum(len(t) for _, t in items)  # so a worker's part of a block stays bounded
    long = " ".join(["filler"] * 300_000 + items[7][1].split()[100:120] + ["filler"] * 5)
    hit, named = block.scan(long.encode().split())
    assert named == {"7"} and hit.sum() >= 20 and not hit[:299_990].any()


def test_ids_equal_the_tokenizers():
    ids, rng = tokens.loaded(tokens.default_path()), random.Random(2)
    parts = ["a", "b'll", " ", "  ", "\n", "\t", "\x1c", " ", "1", "é", "!", "<|endoftext|>", "漢", "😀", "word"]
    for _ in range(3000):
        t = "".join(rng.choices(parts, k=rng.randint(0, 12)))
        assert ids.of(t) == np.array(ids.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def test_pieces_and_packing(spark):
    rng = random.Random(3)
    texts = [(i, words(rng, rng.choice([0, 1, 20, 90, 400]))) for i in range(120)] + [(500, None), (3, "again"), ("null", "x")]
    got = packing.pack(docs(spark, texts), size=64, group_size=30, with_ids=True).collect()
    coder = tokens.loaded(tokens.default_path()).tokenizer
    want = Counter()
    for i, t in texts:
        x = [*coder.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(x) % 64 or 64
        cuts = [0, *range(first, len(x) + 1, 64)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[(None if i == "null" else i, k, a, b - a, zlib.crc32(np.array(x[a:b], "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in by.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 64
    assert len(by) <= sum(r.length for r in got) / 64 * 1.1 + 5
    assert packing.pack(docs(spark, [])).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_vector_best_fit_keeps_every_capacity(rule):
    rng = np.random.default_rng(4)
    lengths = np.minimum(np.sort(rng.integers(1, 100, 300))[::-1], 77)
    bins, offsets = packing.best_fit(lengths, 100, 5, 6000.0, (1.0, 0.3, 0.3), rule)
    for b in np.unique(bins):
        own = bins == b
        assert lengths[own].sum() <= 100 and own.sum() <= 5 and (lengths[own] ** 2).sum() <= 6000
        assert (np.sort(offsets[own]) == np.concatenate(([0], np.cumsum(lengths[own][np.argsort(offsets[own])])[:-1]))).all()


def test_token_counts_as_by_brute_force(spark):
    rng = random.Random(5)
    texts = [(i, "\n".join(words(rng, rng.randint(0, 6), "abé😀") for _ in range(rng.randint(1, 5)))) for i in range(25)] + [(90, None), (91, "")]
    spans = F.array(F.struct(F.lit(0).alias("start"), F.lit(7).alias("end")), F.struct(F.lit(5).alias("start"), F.lit(999).alias("end")))
    coder = tokens.loaded(tokens.default_path())
    for rule in ("first", "last", "share"):
        for sections in (None, "sec"):
            rows = docs(spark, texts).withColumn("sec", spans)
            got = {(r.doc_id, r.section): (r.n_chars, round(r.n_tokens, 6), r.n_crossing) for r in count_tokens(rows, sections=sections, rule=rule).collect()}
            for i, t in texts:
                t = t or ""
                data = t.encode()
                ends = np.cumsum([coder.byte_lengths[x] for x in np.frombuffer(coder.of(t), "<u4")]).tolist()
                toks = list(zip([0, *ends], ends, strict=False))
                at, parts = 0, []
                for line in t.split("\n"):
                    parts.append((at, min(len(t), at + len(line) + 1)))
                    at += len(line) + 1
                parts = parts if sections is None else [(0, min(7, len(t))), (min(5, len(t)), len(t))]
                for k, (a, e) in enumerate(parts):
                    a, e, n = len(t[:a].encode()), len(t[:e].encode()), e - a
                    share = lambda x, y: max(0, min(y, e) - max(x, a))  # noqa: E731, B023
                    count = sum({"first": a <= x < e, "last": a < y <= e, "share": share(x, y) / (y - x)}[rule] for x, y in toks)
                    cross = sum(0 < share(x, y) < y - x for x, y in toks)
                    assert got[(i, k)] == (n, round(float(count), 6), cross), (i, k, rule, data)


def plain_losses(texts):
    """Losses by sets of n-grams: what only the document has is taken out by counting without it."""
    padded = {i: ["<s>"] * 3 + (t or "").lower().split() for i, t in texts}
    grams = lambda s, n: {tuple(s[k - n + 1 : k + 1]) for k in range(3, len(s))}
    own = {i: Counter(g[1:] for g in grams(s, 4)) for i, s in padded.items()}
    count = {3: Counter(g[1:] for g in set().union(*(grams(s, 4) for s in padded.values())))}
    for n in (2, 1):
        count[n] = Counter(g[1:] for g in count[n + 1])
    d = {n: discounts_of([sum(c == k for c in count[n].values()) for k in (1, 2, 3, 4)]) for n in (1, 2, 3)}
    total = sum(count[1].values())
    rest = sum(d[1][min(c, 3)] for c in count[1].values()) / total / len(count[1])
    out = {}
    for i, s in padded.items():
        if len(s) == 3:
            continue
        there, less = {}, own[i]
        for n in (3, 2, 1):  # what is left of each order without the document's own
            there[n] = {g: c - less[g] for g, c in count[n].items()}
            less = Counter(g[1:] for g in grams(s, n) if there[n][g] <= 0)
        sums = [0.0, 0.0, 0.0]
        for k in range(3, len(s)):
            p = 0.0
            for n in (1, 2, 3):
                g = tuple(s[k - n + 1 : k + 1])
                c = max(0, there[n].get(g, 0))
                if n == 1:
                    p = max(c - d[1][min(c, 3)], 0) / total + rest
                else:
                    follow = [x for h, x in there[n].items() if h[:-1] == g[:-1] and x > 0]
                    if sum(follow):
                        p = max(c - d[n][min(c, 3)], 0) / sum(follow) + min(1, sum(d[n][min(x, 3)] for x in follow) / sum(follow)) * p
                sums[n - 1] -= math.log(p)
        out[i] = [x / (len(s) - 3) for x in sums]
    return out


def test_perplexity_against_a_plain_model(spark, monkeypatch):
    rng = random.Random(6)
    texts = [(i, words(rng, rng.randint(20, 50), "abc")) for i in range(40)] + [(70, None), (71, ""), (72, "One two. " * 9), (73, "unheard of")]
    texts += [(74, texts[3][1]), (75, texts[3][1].replace(" a ", " b ")), ("null", texts[5][1])]
    monkeypatch.setattr("missive.llm.perplexity.RANGE_KEYS", 300)
    monkeypatch.setattr("missive.llm.perplexity.CHUNK", 120)
    found, model = scores(docs(spark, texts), batch_chars=1500)
    got = {r.id: r for r in found.collect()}
    want = plain_losses(texts)
    for i, _ in texts:
        r = got[-(2**63) if i == "null" else i]
        if i in want:
            assert [r.loss_1, r.loss_2, r.loss] == pytest.approx(want[i], rel=1e-9), i
        else:
            assert r.loss is None or math.isnan(r.loss)
    assert {r.order for r in model.collect()} == {1, 2, 3}


def test_likely_texts_are_rejected_and_copies_kept(spark):
    rng = random.Random(8)
    rare = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(3000)]
    often = "the of and to in a is it that was for on are as with his they at be this".split()
    make = lambda n: " ".join(w for _ in range(n // 2) for w in (rng.choice(often), rng.choice(rare)))
    clean = [(i, make(rng.randint(80, 160))) for i in range(300)]
    copies = [(1000 + i, clean[0][1]) for i in range(60)] + [(1100 + i, " ".join(w if rng.random() > 0.03 else rng.choice(rare) for w in clean[1][1].split())) for i in range(12)]
    likely = [(2000 + i, " ".join(rng.choices(often, k=120))) for i in range(3)]
    odd = [(3000 + i, " ".join("".join(rng.choices("uvwxyz#%", k=6)) for _ in range(100))) for i in range(3)]
    got = {r.doc_id: r for r in judged(docs(spark, clean + copies + likely + odd)).collect()}
    kept = {i for i, r in got.items() if r.kept}
    lost = [got[i] for i, _ in clean + copies if i not in kept]
    assert not lost, [(r.doc_id, r.loss_1, r.low_loss_1, r.loss, r.low_loss, r.high) for r in lost]
    assert not kept & {i for i, _ in likely + odd} and not any(got[i].base_failed for i, _ in likely + odd)
    assert all(got[i].loss < got[i].low_loss for i, _ in likely) and all(got[i].loss > got[i].high for i, _ in odd)


def test_base_rules_and_bands(spark):
    rng = random.Random(7)
    clean = [(i, words(rng, 70, "abcdef")) for i in range(80)]
    junk = [(200 + i, " ".join("".join(rng.choices("uvwxyz#%", k=6)) for _ in range(70))) for i in range(4)]
    long = [(400, " ".join(words(rng, 70, "abcdef") for _ in range(400)))]
    assert judged(docs(spark, clean + long)).where("doc_id = 400").first().n_words == 28_000
    odd = [(300, None), (301, ""), (302, "a b\na b\n\n \n \na b"), (303, "x y z " * 30), ("null", clean[0][1])]
    got = {r.doc_id: r for r in judged(docs(spark, clean + junk + odd, {205: None})).collect()}
    assert len(got) == len(clean + junk + odd)
    assert all(got[i].kept for i, _ in clean) and not any(got[i].kept for i, _ in junk) and not got[300].kept and got[None].kept
    assert (got[302].n_dup_lines, got[302].n_repeat_words, got[302].word_chars, got[303].base_failed) == (2, 6, 6, True)
    kept = passing(docs(spark, clean + junk + odd))
    assert kept.columns == docs(spark, []).columns and kept.count() == len(clean) + 1
    assert judged(docs(spark, [])).count() == 0


def test_page_text(spark):
    page = '<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><ul><li><a href=x>Home</a></ul></nav><header><h2>Site</h2></header><article><h1>Head&amp;line &am</h1><p><b>One, two.<br><p>Three\n  four&nbsp;five. <i>Six</i></p><aside>Ad, read this.</aside><section class="comments"><p>I like it, really.</p></section></article><form>Name</form><footer>&copy; x.</footer>'
    want = "Head&line &am\nOne, two.\nThree four five. Six"
    assert main_text(page) == want
    soup = '<div id=menu><a href=1>A</a> <a href=2>B</a></div><div>First long paragraph, with commas, and more. Yes, it is.</div><div>Second, shorter one.</div>'
    assert main_text(soup) == "First long paragraph, with commas, and more. Yes, it is.\nSecond, shorter one."
    rows = spark.createDataFrame([(1, "u", page, 1), (1, "u", page, 1), (2, "u", None, 1), (3, "u", "", 1), (4, "u", "<!-- open", 1), (5, "u", "<p" * 50 + "<x", 1)], "page_id long, url string, html string, text int")
    got = extract(rows)
    assert got.columns[-1] == "text_" and [r.text_ for r in got.orderBy("page_id").collect()][:5] == [want, want, "", "", ""]


def test_licenses(spark):
    texts = [(1, "prose\nReleased under the MIT License.\nmore"), (2, "This work is licensed under the GNU General Public License, version 3."), (3, "This work is licensed under the GNU General Public License, version 9."), (4, "Licensed under CC BY 4.0."), (5, None), (6, ""), (7, "no such thing"), (1, "prose\nReleased under the MIT License.\nmore")]
    got = [(r.doc_id, r.license, r.start) for r in scan_licenses(docs(spark, texts)).orderBy("doc_id").collect()]
    assert got == [(1, "MIT", 6), (1, "MIT", 6), (2, "GPL-3.0", 0), (3, None, 0), (4, "CC-BY-4.0", 0)]
    assert differences(words_of("a b c d e"), words_of("x a b d e y")) == (["c"], [])
    assert scan_licenses(docs(spark, [])).count() == 0
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_licenses_wrapped_numbered_and_side_by_side(spark):
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0."
    start = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n"
    one = "1. Redistributions of source code must retain the above copyright notice,\n   this list of conditions and the following disclaimer.\n"
    two = "2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n"
    three = "3. Neither the name of the copyright holder nor the names of its contributors\n   may be used to endorse or promote products derived from this software\n   without specific prior written permission.\n"
    texts = [(1, f"code\n\n{gpl}\n\ncode"), (2, mpl), (3, start + one + two), (4, start + one + two + three), (5, "Released under the MIT License.\nLicensed under the Apache License, Version 2.0."), (6, "A book. All rights reserved."), (7, "Licensed under the Apache License, Version\n2. More"), (8, "Released under the MIT License.\nx\nReleased under the MIT License.")]
    got = {}
    for r in scan_licenses(docs(spark, texts)).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.license))
    got = {i: [x for _, x in sorted(rows)] for i, rows in got.items()}
    assert got == {1: ["GPL-3.0-header"], 2: ["MPL-2.0"], 3: ["BSD-2-Clause"], 4: ["BSD-3-Clause"], 5: ["MIT", "Apache-2.0"], 6: ["All-rights-reserved"], 7: [None], 8: ["MIT", "MIT"]}


def test_page_text_inside_of_hinted_elements():
    body = "<p>First long paragraph, with commas, and more. Yes, it is.</p>"
    want = "First long paragraph, with commas, and more. Yes, it is."
    side = '<div class="main-sidebar"><p>Side, text. More, of it.</p></div><div class="ad"><p>Buy, now.</p></div>'
    assert main_text(f'<div class="layout has-sidebar">{body}{side}</div>') == want
    assert main_text(f'<div id="page" class="with-ads"><article>{body}</article>{side}</div>') == want
    assert main_text(f'<div class="sidebar-layout"><main>{body}<div class="share">Share, it.</div></main>{side}</div>') == want
    assert main_text(f'<article>{body}<section class="comments"><article><p>I like it, really.</p></article></section></article>') == want
    assert main_text("<nav><article><p>No, text.</p></article></nav>") == ""


PARTS = ["The first paragraph of the article, which is long enough, says a number of things. It goes on, too.", "A second one follows; it has commas, stops, and words. Nothing else.", "Short."]


def test_page_text_comes_through_the_ratios(monkeypatch):
    ps = "".join(f"<p>{x}</p>" for x in PARTS)
    aside = '<div class="sidebar"><h3>Popular</h3><p>Read this other story, it is good. Really.</p></div><div class="cookie-notice">We use cookies, to make it better. Accept?</div>'
    menu = '<div class="menu"><a href=1>Home</a> <a href=2>News</a></div>'
    page = f'<body><div id="wrap">{menu}<article><h1>Title here</h1>{ps}<ul><li>one</li><li>two</li></ul></article>{aside}</div></body>'
    want = "\n".join(["Title here", *PARTS, "one", "two"])
    assert main_text(page) == main_text(page.replace("article>", "div>")) == want
    assert main_text(re.sub(r' class="[^"]*"', "", page)) == want  # the names are not needed beside an article
    assert main_text(f"<body>{menu}<h1>T</h1>{ps}<footer>x, y. z</footer></body>") == "\n".join(["T", *PARTS])
    assert main_text('<div class="search-engine-history related-work"><p>x <math><mi>y</mi></math> z, and so on.</p></div>') == "x y z, and so on."
    assert main_text(f'<article><h1>T</h1><p>Sh is.</p><section id="comments">{ps}</section></article>') == "T\nSh is."
    assert main_text(f'<main><h1>T</h1><p>Sh is.</p></main><div class="comments"><article>{ps}</article></div>') == "T\nSh is."
    monkeypatch.setattr(html_text, "scores_of", lambda blocks: html_text.np.ones(len(blocks)))
    assert main_text(page) != want


def test_path_ratios_as_by_another_parser():
    from collections import Counter
    from html.parser import HTMLParser

    rng = random.Random(3)
    text = lambda: "".join(rng.choices("ab, .c!", k=rng.randint(0, 20)))
    tree = lambda d: text() + "".join(f"<{t}>{tree(d - 1)}</{t}>" for t in rng.choices(["div", "section", "a", "ul", "blockquote"], k=rng.randint(0, 3))) if d else text()

    class Sums(HTMLParser):
        def __init__(self):
            super().__init__()
            self.stack, self.chars, self.marks, self.n = [], Counter(), Counter(), Counter()

        def handle_starttag(self, tag, attrs):
            self.stack.append(tag)

        def handle_endtag(self, tag):
            self.stack.pop()

        def handle_data(self, data):
            if data.strip():
                p = "/".join(self.stack)
                self.chars[p] += len(data.strip())
                self.marks[p] += sum(data.count(c) for c in ".,!")
                self.n[p] += 1

    for _ in range(60):
        page = f"<div>{tree(4)}</div>"
        twin = Sums()
        twin.feed(page)
        assert ratios_of(blocks_of(page)) == {p: (twin.chars[p] / n, twin.marks[p] / n) for p, n in twin.n.items()}


def test_page_text_of_a_very_long_page():
    long = "<p>Some words, and more. " * 20_000
    assert main_text(f"<nav>{'<a href=x>y</a>' * 5000}</nav><article>{long}</article>") == "\n".join(["Some words, and more."] * 20_000)


def test_licenses_whole_and_reworded_texts_are_found(spark):
    import textwrap

    from missive.llm.licenses import IDENTIFIERS, TEMPLATES, TELLING

    rng = random.Random(4)
    texts, want = [], {}
    for name, template in sorted(TEMPLATES.items()):
        for k, width in enumerate((58, 76, 10**6)):
            form = template.split()
            if len(form) > 40:  # reworded: one word in forty differs
                for i in range(7, len(form), 40):
                    form[i] = "whatever" if form[i].lower().strip(".,") not in TELLING else form[i]
            prose = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(30)]
            body = textwrap.fill(" ".join(form), width)
            texts.append((len(texts), f"{' '.join(prose[:15])}\n\n{body}\n\n{' '.join(prose[15:])}"))
            want[len(texts) - 1] = name
    texts += [(9000, "The licence of the driver was checked, and it is all right. You may have the copy that was made for you."), (9001, "plain words " * 60_000 + "\nReleased under the MIT License.\n" + "and more " * 30_000)]
    rows = docs(spark, texts).withColumn("license", F.lit("own")).withColumn("start", F.lit(1))
    got = {}
    for r in scan_licenses(rows).collect():
        got.setdefault(r.doc_id, []).append(r.license)
    assert sum(got.get(i) == [name] for i, name in want.items()) >= 0.97 * len(want)
    assert got.get(9000, [None]) == [None] and got[9001] == ["MIT"]
    assert len(IDENTIFIERS) == 18 and all(f"SPDX-{x}" in TEMPLATES for x in IDENTIFIERS)


def test_license_runs_are_linear_and_the_ranking_decides(monkeypatch):
    import time

    from missive.llm import licenses as L

    scanner = L.Scanner(dict(L.TEMPLATES), 3, 0.9)
    began = time.perf_counter()
    many = scanner.scan("\n".join(["Released under the MIT License."] * 20_000))
    assert len(many) == 20_000 and {x[2] for x in many} == {"MIT"} and time.perf_counter() - began < 30
    assert [x[0] for x in many[:3]] == [0, 32, 64] and L._whole("\n".join(["Released under the MIT License."] * 20_000), many, lambda _: True)
    nested = {n: L.TEMPLATES[n] for n in ("BSD-3-Clause", "Apache-2.0-header", "MPL-2.0-header", "MIT-full")}
    for name, text in nested.items():
        assert [x[2] for x in scanner.scan(text)] == [name]
    rng = random.Random(9)
    for _ in range(30):  # licenses one after the other, words between them
        names = rng.choices(sorted(nested), k=rng.randint(1, 4))
        block = "\n".join(x for n in names for x in (nested[n], " ".join(rng.choices(["plain", "words", "here"], k=rng.randint(1, 400)))))
        assert [x[2] for x in scanner.scan(block)] == names
    constant = L.Scanner(dict(L.TEMPLATES), 3, 0.9)
    monkeypatch.setattr(constant, "ranked", lambda part: [(name, 0.5) for name in sorted(L.TEMPLATES)])
    changed = {name: [x[2] for x in constant.scan(text)] for name, text in nested.items()}
    assert all(changed[name][0] == other for name, other in (("BSD-3-Clause", "BSD-2-Clause"), ("Apache-2.0-header", "Apache-2.0"), ("MPL-2.0-header", "MPL-2.0")))


def test_items_that_share_a_sentence_and_hashes_that_collide(monkeypatch):
    import time

    from missive.llm import decontaminate as D

    rng = random.Random(10)
    shared = words(rng, 2200, "abcdefghijklmnop")
    items = [(i, f"{shared} only{i} {words(rng, 5)}") for i in range(2000)]
    block = D.Windows(items[:300], 10)
    began = time.perf_counter()
    hit, named = block.scan(shared.encode().split())
    assert hit.all() and len(named) == 300 and time.perf_counter() - began < 3
    small = [(i, words(rng, rng.choice([3, 10, 12, 25]), "ab")) for i in range(40)]
    texts = [words(rng, 60, "ab").encode().split() for _ in range(20)]
    want = [D.Windows(small, 10).scan(t) for t in texts]
    monkeypatch.setattr(D, "window_hashes", lambda h, n, f=D.window_hashes: f(h, n) % np.uint64(7))  # most windows share a hash
    few = D.Windows(small, 10)
    for t, (hit, named) in zip(texts, want, strict=True):
        again, ids = few.scan(t)
        assert (again == hit).all() and ids == named


def test_token_counts_of_sections_that_cut_tokens(spark, tmp_path):
    from missive.llm.token_counts import WIDTH, op9

    rng = random.Random(11)
    texts = [(i, words(rng, rng.randint(0, 900), "abcdefé漢")) for i in range(12)] + [(12, None), (13, ""), (3, "x" * 1000), (14, "wörd " * 40_000)]
    texts += [texts[5], ("null", "a b")]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = op9(spark, str(tmp_path)).collect()
    ids = tokens.loaded(tokens.default_path())
    want = []
    for i, text in texts:
        text = text or ""
        ends = np.cumsum(ids.byte_lengths[np.frombuffer(ids.of(text), "<u4")]).tolist()
        spans = list(zip([0, *ends[:-1]], ends, strict=True)) if ends else []
        for k, a in enumerate(range(0, max(1, len(text)), WIDTH)):
            part = text[a : a + WIDTH]
            low = len(text[:a].encode())
            high = low + len(part.encode())
            want.append((None if i == "null" else i, k, len(part), float(sum(low <= x < high for x, _ in spans)), sum(x < high and y > low and not (low <= x and y <= high) for x, y in spans)))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and sum(w[4] for w in want) > 20
    docs(spark, []).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert op9(spark, f"{tmp_path}/none").count() == 0


def test_pages_of_unclosed_tags_take_linear_time():
    import time

    began = time.perf_counter()
    for unit in ("<div>text, some. ", "<div><p>text, some. ", "<ul><li>text, some. ", "<b>text, some. ", "</p></div>text, some. <div>"):
        assert main_text(unit * 20_000).count("text, some.") > 100
    assert time.perf_counter() - began < 60
    deep = "<div>" * 20_000 + "<article><p>The article has a long text, with marks. It goes on, and on.</p></article>" + "</div>" * 20_000 + "<nav>menu</nav>"
    assert main_text(deep) == "The article has a long text, with marks. It goes on, and on."


def test_token_workers_stay_small():
    """Workers of the pipeline have room for the pieces of 100,000 words twice over, and load the second library only for texts that need it."""
    ids = tokens.Ids(tokens.default_path())
    for k in range(250_000):
        ids._bare[f"w{k}"]
    ids.of("plain words\nand lines")
    assert len(ids._bare) + len(ids._bare._old) <= 200_000 and "tokenizer" not in vars(ids)
    odd = "a\x1cb <|endoftext|> c"
    assert ids.of(odd) == np.array(ids.tokenizer.encode(odd, add_special_tokens=False).ids, "<u4").tobytes() and ids._whole == ["<|endoftext|>"]


def test_perplexity_hashes_words_without_a_memory():
    """Words of which nearly all differ are hashed, not looked up; repeated windows are those of the words as they are written."""
    import xxhash

    from missive.llm import perplexity

    assert perplexity.word_hashes([b"Word", b"word"]).tolist() == [xxhash.xxh64_intdigest(b"Word"), xxhash.xxh64_intdigest(b"word")]
    assert perplexity.word_hashes([]).tolist() == [] and not hasattr(perplexity, "LowHashes")
    texts = [b"a b c x a b c a b c", b"A b c a b c", b"", b"q q q q", b"a b c", b"c x a"]
    want = []
    for t in texts:
        w = t.split()
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        twice = {x for x in windows if windows.count(x) > 1}
        want.append(len({i + k for i, x in enumerate(windows) if x in twice for k in range(3)}))
    words = [t.split() for t in texts]
    got = perplexity.repeated_words(perplexity.word_hashes([w for t in words for w in t]), np.array([len(t) for t in words]))
    assert got.tolist() == want


def test_encoding_forgets_what_other_stages_keep():
    """The pipeline's workers go from packing to the first stage of the next run: its tokens must not stay beside the batches."""
    from missive.llm import common, perplexity

    class Rows:
        def mapInArrow(self, run, schema):  # noqa: N802
            return list(run(iter(())))

    common.remembered("of another stage", lambda: bytearray(10))
    assert perplexity._encoded(Rows(), 10) == [] and not common._remembered


def test_perplexity_asks_in_parts_and_answers_in_buckets(spark, monkeypatch):
    """On disk are the questions of one part of the ranges at a time, and the answers lie by batch: scoring needs no exchange of them."""
    from missive.llm import perplexity

    rng = random.Random(16)
    texts = [(i, words(rng, rng.randint(20, 50), "abc")) for i in range(60)]
    monkeypatch.setattr(perplexity, "RANGE_KEYS", 100)
    found, asked, plans = {}, {}, []
    merge, scored = perplexity._merge, perplexity._scored
    monkeypatch.setattr(perplexity, "_merge", lambda df, *a: asked.setdefault(perplexity.PASSES, []).append({r.range for r in df.select("range").distinct().collect()}) or merge(df, *a))
    monkeypatch.setattr(perplexity, "_scored", lambda *a: plans.append((out := scored(*a))._jdf.queryExecution().toString()) or out)
    for perplexity_passes in (1, 3):
        monkeypatch.setattr(perplexity, "PASSES", perplexity_passes)
        rows, model = scores(docs(spark, texts), batch_chars=1000)
        found[perplexity_passes] = [sorted(map(str, x.collect())) for x in (rows, model.where("keys is not null"))]
    assert found[1] == found[3] and len(found[1][0]) == 60 and {x[:13] for x in found[1][1]} == {f"Row(order={n}, " for n in (1, 2, 3)}
    whole, parts = asked[1], asked[3]
    assert len(whole) == 3 and len(parts) == 9
    for k, of_order in enumerate(whole):
        three = parts[3 * k : 3 * k + 3]
        assert set().union(*three) == of_order and sum(map(len, three)) == len(of_order) and max(map(len, three)) <= len(of_order) / 3 + 1
    assert not any("Exchange" in p for p in plans)


def test_perplexity_numbers_frequent_words_first():
    from missive.llm import perplexity

    known, tokens = np.array([5, 7, 9, 11], np.uint64), np.array([0, 2, 2, 3, 2, 3, 1, 2, 3], np.int64)
    words, numbers = perplexity.by_frequency(known, tokens)
    assert words[numbers].tolist() == known[tokens].tolist() and words.tolist() == [9, 11, 5, 7]
    assert [len(x) for x in perplexity.by_frequency(known[:0], tokens[:0])] == [0, 0]


def test_perplexity_hashes_each_word_once(monkeypatch):
    """Words are found and hashed by array operations, alike to XXH64 of each; as written only those that a window repeated in lower case holds."""
    import pyarrow as pa
    import xxhash

    from missive.llm import perplexity

    class Rows:
        def mapInArrow(self, run, schema):  # noqa: N802
            return run

    rng = random.Random(17)
    word = lambda: "".join(rng.choices("aBcé漢#", k=rng.randint(1, 24)))
    texts = ["", " \t\n", "One two three one TWO three One two three", *("".join(w + rng.choice([" ", "\n\n", "\v\f\r", "\t"]) for w in (word() for _ in range(n))) for n in (1, 2, 3, 700)), "\x1cb\xa0c \x85", "end"]
    coded, alone = [t.encode() for t in texts], []
    monkeypatch.setattr(perplexity.Words, "CHUNK", 100)
    monkeypatch.setattr(perplexity, "word_hashes", lambda words: alone.extend(words) or np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64))
    words = perplexity.Words(coded)
    plain = [w for t in coded for w in t.split()]
    assert words.n.tolist() == [len(t.split()) for t in coded]
    assert words.lowered().tolist() == [xxhash.xxh64_intdigest(w.lower()) for w in plain]
    assert words.written(np.arange(len(plain))).tolist() == [xxhash.xxh64_intdigest(w) for w in plain]
    alone.clear()
    monkeypatch.setattr(perplexity, "batch_number", lambda seq: seq)
    record = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "lang": ["en"] * len(texts), "text": texts, "key": list(range(len(texts)))})
    (batch,) = [r for b in perplexity._encoded(Rows(), 10**9)(iter([record])) for r in b.to_pylist()]
    assert alone and all(len(w) >= perplexity.Words.LONG for w in alone)
    table = perplexity.unsqueezed(batch["counts"], np.int64).reshape(-1, len(perplexity.COUNTS))
    assert table[:, 0].tolist() == words.n.tolist() and table[2].tolist() == [9, 33, 0, 0, 6]
    again = perplexity.repeated_words(perplexity.word_hashes(plain), words.n)
    assert table[:, 4].tolist() == again.tolist()
    texts = [b"a b c d A B C", b"a B c d a B c", b"a b c A b c a b c"]
    low = perplexity.Words(texts)
    assert perplexity.repeated_words(low.lowered(), low.n, low.written).tolist() == [0, 6, 6]


def test_many_wide_keys_are_grouped_by_halves(monkeypatch):
    """Keys and places that do not fit 64 bits together: a batch of more than a million words of 44 bits."""
    from missive.llm import common

    rng = np.random.default_rng(19)
    cases = [(rng.integers(0, 1 << 62, 3000, np.uint64)[rng.integers(0, 3000, 5000)], 62), (np.full(300, (1 << 60) + 5, np.uint64), 61), (np.array([7], np.uint64), 64), (np.array([2**64 - 1, 0, 2**63, 0], np.uint64), 64)]
    want = [np.unique(k, return_index=True, return_inverse=True) for k, _ in cases]
    monkeypatch.setattr(np, "unique", lambda *a, **k: (_ for _ in ()).throw(AssertionError("by argsort")) if len(a[0]) else (a[0], np.empty(0, np.int64), np.empty(0, np.int64)))
    for (keys, bits), w in zip(cases, want, strict=True):
        assert [x.tolist() for x in common.grouped(keys, bits)] == [x.tolist() for x in w]
