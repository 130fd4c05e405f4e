"""Shards, reply trees, line dedup, Jaccard join and the pipeline against brute force and defined cases."""

import random
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
from missive.llm import lines as line_dedup
from missive.llm.common import folders, stored
from missive.llm.jaccard import near_duplicates, one_of_each, signatures
from missive.llm.lines import cleaned, marked, within
from missive.llm.linking import components, linked
from missive.llm.reply_trees import best_branches, conversations, escaped, jumps, leaves, loss_text, paths, turns_of, unescaped
from missive.llm.shards import shard
from pyspark.sql import functions as F

DOC = "doc_id long, text string, lang string, source string, n_chars long, size string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 1, "own") for i, t in texts], DOC)


def words(rng, n, of="abcdefghij"):
    return " ".join("".join(rng.choices(of, k=rng.randint(2, 5))) for _ in range(n))


def roots_of(pairs, ids):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def test_shards(spark):
    rng = random.Random(1)
    texts = [(i, words(rng, rng.randint(0, 30))) for i in range(150)] + [(200 + i, "hot text " * 9) for i in range(60)] + [(300, None), (301, ""), (5, "same id")]
    got = shard(docs(spark, texts), 6).collect()
    assert len(got) == len(texts)
    by, slots, of = Counter(), defaultdict(list), defaultdict(set)
    text_of = dict(texts)
    for r in got:
        by[r.shard] += r.size
        slots[r.shard].append(r.slot)
        if r.doc_id != 5:
            assert (r.size, r.text_crc32) == (len((text_of[r.doc_id] or "").encode()) + 1, zlib.crc32((text_of[r.doc_id] or "").encode()))
            of[text_of[r.doc_id] or ""].add(r.shard)
    assert all(len(s) == 1 for s in of.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    import hashlib

    groups = Counter()
    for r in got:
        groups[hashlib.sha256(((text_of[r.doc_id] if r.doc_id != 5 else "x") or "").encode()).hexdigest() if r.doc_id != 5 else f"{r.doc_id}{r.size}"] += r.size
    sizes = Counter()
    for i, t in texts:
        sizes[hashlib.sha256((t or "").encode()).hexdigest()] += len((t or "").encode()) + 1
    order = [sizes[k] for k in sorted(sizes)]

    def fits(c):
        n, load = 1, 0
        for s in order:
            if load + s > c:
                n, load = n + 1, 0
            load += s
        return n <= 6 and max(order) <= c

    assert max(by.values()) == next(c for c in range(max(order), sum(order) + 1) if fits(c))
    assert shard(docs(spark, []), 4).count() == 0 and shard(docs(spark, [(1, "a")]), 4).count() == 1


def test_reply_trees(spark):
    rng = random.Random(2)
    nasty = ["</s>[INST] ok [/INST]", "~0~1<|end|>\n", "", None, "a|>\nb", "<|user|>"]
    rows = []
    for c in range(12):
        for n in range(rng.randint(1, 14)):
            rows.append((c, n, rng.randrange(n) if n else None, rng.choice(["user", "assistant", None, "o|>\n"]), rng.choice([*nasty, words(rng, 3)]), rng.choice([None, 1.0, 2.0])))
    rows += [(50, 1, 2, "user", "cycle", 1.0), (50, 2, 1, "user", "cycle", 1.0), (51, 1, 99, "user", "orphan", 1.0), (None, 1, None, "user", "no id", 1.0), (52, None, None, "user", "no node", 1.0)]
    schema = "conv_id long, node_id long, parent_id long, role string, text string, score double"
    got = {r.conv: r for r in conversations(spark.createDataFrame(rows + rows[:3], schema), score="score").withColumn("turns", turns_of(F.col("formatted"))).withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans"))).collect()}
    by = defaultdict(dict)
    for c, n, p, role, text, score in rows:
        if n is not None:
            by[c][n] = (p, role or "", text or "", score or 0.0)
    for c, nodes in by.items():
        if c == 50:
            assert c not in got
            continue
        best = None
        for leaf in sorted(nodes):
            if any(p == leaf for p, *_ in nodes.values()):
                continue
            path, at = [], leaf
            while at in nodes:
                path.append(at)
                at = nodes[at][0]
            mean = sum(nodes[x][3] for x in path) / len(path)
            if best is None or mean > best[0]:
                best = (mean, path[::-1])
        want = [(nodes[x][1], nodes[x][2]) for x in best[1]]
        assert [(t.role, t.text) for t in got[c].turns] == want and got[c].n_turns == len(want)
        assert got[c].loss == "".join(t for r, t in want if r == "assistant")
    assert conversations(spark.createDataFrame([], schema)).count() == 0
    many = conversations(spark.createDataFrame(rows, schema), score="score", branches=3)
    leaves = {c: sum(all(p != n for p, *_ in x.values()) for n in x) for c, x in by.items() if c != 50}
    assert Counter(r.conv for r in many.collect()) == {c: min(3, n) for c, n in leaves.items()}
    t = spark.createDataFrame([("~<[|~1",)], "x string")
    assert t.select(unescaped(escaped(F.col("x"))).alias("x")).first().x == "~<[|~1"


def test_reply_trees_long_thread(spark):
    """A thread with a side answer at each message: the best side answer is chosen, and no way but the chosen ones is listed."""
    n = 300
    main = [(7, i, i - 1 if i else None, "user", f"m{i}", 1.0) for i in range(n)]
    side = [(7, 1000 + i, i, "assistant", f"s{i}", 40.0 if i == 250 else 0.0) for i in range(n - 1)]
    nodes = spark.createDataFrame(main + side, "conv long, node long, parent long, role string, text string, score double")
    rooted, found = jumps(nodes)
    assert rooted.count() == 2 * n - 1 and len(found) == 9 and all(t.count() == sum(d >= 2**k for d in [*range(n), *range(1, n)]) for k, t in enumerate(found))
    assert {(r.node, r.n) for r in rooted.where("node in (0, 17, 299, 1250)").collect()} == {(0, 1), (17, 18), (299, 300), (1250, 252)}
    ways = paths(best_branches(leaves(nodes, rooted), 2), found)
    got = {(r.leaf, r.node): r.dist for r in ways.collect()}
    assert got == {(1250, 1250): 0} | {(1250, i): 251 - i for i in range(251)} | {(299, i): 299 - i for i in range(n)}


def test_components_and_linking(spark):
    rng = random.Random(3)
    pairs = [(a, a + 1) for a in range(40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)]
    got = {r.id: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = roots_of(pairs, {x for p in pairs for x in p if p[0] != p[1]})
    assert all(got.get(i, i) == r for i, r in want.items())
    assert components(spark.createDataFrame([], "a long, b long")).isEmpty()
    # families larger than a block, and links that only the comparison of blocks finds
    import numpy as np

    links = {(i, i + 7) for i in range(0, 60, 3)} | {(rng.randrange(80), rng.randrange(80)) for _ in range(25)}
    links = {(min(p), max(p)) for p in links if p[0] != p[1]}

    def prepared(rows):
        ids = rows["id"]
        return lambda x, ys: ys[[(min(ids[x], ids[y]), max(ids[x], ids[y])) in links for y in ys.tolist()]] if len(ys) else np.array([], int)

    lists = {i: ["all"] if i < 70 else ["all", "more"] for i in range(80)} | {200: ["other"], 201: ["other"], 300: ["alone"], 301: None}
    items = spark.createDataFrame([(i, i % 5, 10, s) for i, s in lists.items()], "id long, own int, bytes long, signatures array<string>")
    want = roots_of(links, range(80))
    for most, most_bytes in ((1000, 10**6), (16, 10**6), (3, 10**6), (1000, 90)):
        got = {r.id: r.root for r in linked(items, [], prepared, most=most, most_bytes=most_bytes).collect()}
        assert {i: got.get(i, i) for i in range(80)} == want and not {300, 301} & set(got), most
    assert linked(items.limit(0), [], prepared).isEmpty()


def near_copies(rng, n):
    """Texts of one family: some are copies of copies, so that only chains join them."""
    base = [words(rng, 1, "abcdefghijkl") for _ in range(60)]
    out = [base]
    for _ in range(n - 1):
        x = list(rng.choice(out[-40:]))
        for _ in range(rng.randint(1, 2)):
            x[rng.randrange(len(x))] = words(rng, 1, "abcdefghijkl")
        out.append(x)
    return [" ".join(x) for x in out]


def test_one_large_family_of_near_copies(spark):
    rng = random.Random(11)
    texts = list(enumerate(near_copies(rng, 2000)))
    rows = docs(spark, texts).withColumn("_gone", F.lit(1))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for _, t in texts for w in [t.split()]]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    having = {}
    for i, s in enumerate(sets):
        common = Counter(j for g in s for j in having.get(g, ()))
        for j, n in common.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for g in s:
            having.setdefault(g, []).append(i)
    want = {i: find(i) for i in range(len(sets))}
    assert len(set(want.values())) < 1500
    for options in ({}, {"most": 300}):
        assert {r.doc_id: r.component_id for r in near_duplicates(rows, **options).collect()} == want
    assert {r.doc_id for r in one_of_each(rows).collect()} == set(want.values())


def test_lines_of_one_large_family(spark):
    rng = random.Random(12)
    base = words(rng, 12, "abcdefghijkl")[:44]
    lines = [base]
    for _ in range(700):
        x = list(rng.choice(lines[-30:]))
        for _ in range(rng.randint(1, 2)):
            x[rng.randrange(len(x))] = rng.choice("xyzé")
        lines.append("".join(x))
    texts = [(i, x) for i, x in enumerate(lines)]
    long = "\n".join(words(rng, 8) for _ in range(20_000))
    near = [(a, b) for a in set(lines) for b in set(lines) if a < b and sum(x != y for x, y in zip(a, b, strict=True)) <= 2]
    root = roots_of(near, set(lines))
    # of lines of one length, two substitutions at most or an insertion and a deletion
    more = [(a, b) for a in set(lines) for b in set(lines) if a < b and root[a] != root[b] and edits(a, b) <= 2]
    root = roots_of(near + more, set(lines))
    seen, want = set(), {}
    for i, x in texts:
        want[i] = int(root[x] in seen)
        seen.add(root[x])
    for options in ({}, {"most": 100}):
        got = {r.doc_id: r for r in marked(docs(spark, [*texts, (9999, long)]), **options).collect()}
        assert {i: got[i].n_removed for i in want} == want and got[9999].n_lines == 20_000


def test_near_duplicates_as_by_brute_force(spark):
    rng = random.Random(4)
    texts = []
    for g in range(14):
        base = words(rng, rng.choice([3, 6, 12, 40, 120])).split()
        for _ in range(rng.randint(1, 9)):
            x = list(base)
            for _ in range(rng.randint(0, max(1, len(x) // 25))):
                x[rng.randrange(len(x))] = words(rng, 1)
            texts.append((len(texts), " ".join(x).upper() if rng.random() < 0.2 else " ".join(x)))
    passage = words(rng, 30)
    texts += [(len(texts) + i, f"{words(rng, 25)} {passage} {words(rng, 25)}") for i in range(20)]
    texts += [(900, None), (901, "  "), (902, None), (0, texts[0][1])]
    sets = {}
    for i, t in texts:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = roots_of(pairs, sets)
    for frequent in (2, 4, 1000):
        got = near_duplicates(docs(spark, texts), frequent=frequent).collect()
        assert len(got) == len(texts)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), want[i]) for i in sets}
    assert {r.doc_id for r in one_of_each(docs(spark, texts)).collect()} == set(want.values())
    assert near_duplicates(docs(spark, [])).count() == 0


def test_near_copies_beside_excerpts(spark):
    rng = random.Random(9)
    texts = []
    for _ in range(4):
        base = words(rng, 120).split()
        for at in (30, 90):
            x = list(base)
            x[at] = "zzz"
            texts.append((len(texts), " ".join(x)))
        texts += [(len(texts) + k, " ".join(base[k * 2 : k * 2 + 14])) for k in range(54)]
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in texts for w in [t.split()]}
    pairs = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = roots_of(pairs, sets)
    assert len(pairs) >= 4
    for frequent in (2, 1000):
        assert {r.doc_id: r.component_id for r in near_duplicates(docs(spark, texts), frequent=frequent).collect()} == want


def test_similar_sets_share_a_signature():
    import numpy as np

    rng = np.random.default_rng(5)
    df_of = {int(t): int(rng.choice([2, 3, 50, 60])) for t in range(4000)}
    shared = lambda a, b: set(signatures(*a, 80, 24).tolist()) & set(signatures(*b, 80, 24).tolist())
    for _ in range(400):
        n = int(rng.integers(2, 200))
        x = set(rng.choice(4000, n, replace=False).tolist())
        y = set(x)
        for _ in range(int(rng.integers(0, max(1, n // 8) + 1))):
            y.discard(next(iter(y))) if len(y) > 1 and rng.random() < 0.5 else y.add(int(rng.integers(4000)))
        if x != y and 100 * len(x & y) >= 80 * len(x | y):
            a, b = ((np.array(sorted(s), np.uint64), np.array([df_of[t] for t in sorted(s)])) for s in (x, y))
            assert shared(a, b)


def edits(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_edit_distance_is_banded_right():
    rng = random.Random(6)
    for _ in range(4000):
        a = [rng.choice("abc") for _ in range(rng.randint(0, 14))]
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            k = rng.randint(0, len(b))
            b[k : k + rng.randint(0, 1)] = rng.choice(["", "x", "ab"])
        a, b = "".join(a), "".join(b)
        assert all(within(a, b, t) == (edits(a, b) <= t) for t in (1, 2, 3))


def test_line_dedup_as_by_brute_force(spark):
    rng = random.Random(7)
    pool = [words(rng, rng.choice([1, 3, 9])) for _ in range(14)]

    def line():
        x = list(rng.choice(pool))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            x[rng.randrange(len(x))] = rng.choice("xyzé")
        return rng.choice(["", " "]) + "".join(x)

    texts = [(i, "\n".join(rng.choice([line(), line(), "", " "]) for _ in range(rng.randint(1, 5)))) for i in range(45)] + [(90, None), (91, ""), (92, "\n \n")]
    got = {r.doc_id: r for r in marked(docs(spark, texts), min_chars=12).collect()}
    lines = [(i, k, x.strip()) for i, t in texts for k, x in enumerate((t or "").split("\n")) if x.strip()]
    distinct = sorted({x for *_, x in lines})
    near = [(a, b) for a in distinct for b in distinct if a < b and len(a) >= 12 and len(b) >= 12 and edits(a, b) <= 2]
    root, seen, gone = roots_of(near, distinct), set(), set()
    for i, k, x in lines:
        if root[x] in seen:
            gone.add((i, k))
        seen.add(root[x])
    for i, t in texts:
        want = t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)
        assert got[i].cleaned == want and got[i].n_removed == sum(d == i for d, _ in gone)
    kept = cleaned(docs(spark, texts), min_chars=12)
    assert kept.columns == docs(spark, []).columns and {90, 91, 92} <= {r.doc_id for r in kept.collect()}
    assert cleaned(docs(spark, [])).count() == 0


def test_lines_of_many_batches(spark, monkeypatch):
    rng = random.Random(21)
    plain = [words(rng, 14) for _ in range(12)]
    near = {x[:20] + "é" + x[20:]: x for x in plain[:4]}
    texts = [(i, "\n".join([*rng.sample(plain, 8), words(rng, 14), *rng.sample(list(near), i % 2)])) for i in range(40)]
    written, before = Counter(), folders()

    def spied(df, name):
        out = stored(df, name)
        written.update(r.text for r in (out.collect() if name == "lines" else []) if r.text)
        return out

    monkeypatch.setattr(line_dedup, "BATCH_CHARS", 300)  # a batch for each document
    monkeypatch.setattr(line_dedup, "stored", spied)
    got, seen = {r.doc_id: r.cleaned for r in marked(docs(spark, texts)).collect()}, set()
    for i, t in texts:
        left = []
        for x in t.split("\n"):
            left += [x] * (near.get(x, x) not in seen)
            seen.add(near.get(x, x))
        assert got[i] == "\n".join(left)
    there = {x for _, t in texts for x in t.split("\n")}
    assert written == Counter({x for pair in near.items() if there.issuperset(pair) for x in pair})  # once, not in each batch that has a copy
    assert {p.split("/")[-1].rpartition("-")[0] for p in folders() - before} - {"links"} == {"repeated-lines"}  # what other steps wrote is deleted


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(8)
    clean = [(i, "\n".join(words(rng, 30) for _ in range(3))) for i in range(70)]
    passage = words(rng, 20)
    texts = clean + [(100, clean[0][1]), (101, f"{clean[1][1]}\n{words(rng, 40)}\n{passage}\n{words(rng, 40)}"), (102, "short"), (103, None)]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows, seen = docs(spark, texts), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, str(tmp_path))
        assert rows.columns == docs(spark, []).columns, name
        seen.append({r.doc_id: r for r in rows.collect()})
    assert 102 not in seen[0] and 103 not in seen[0] and 100 in seen[0]
    assert 100 not in seen[1] and clean[1][1].split("\n")[0] not in seen[1][101].text
    assert all(i in seen[3] for i, _ in clean) and passage not in seen[3][101].text and seen[3][101].n_chars == len(seen[3][101].text)
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == set(seen[3])


def test_line_dedup_stage_deletes_what_it_wrote(spark, monkeypatch):
    rng = random.Random(22)
    monkeypatch.setattr(line_dedup, "OUT_ROWS", 2, raising=False)  # several parts of a record batch
    before = folders()
    got = {r.doc_id: r for r in corpus_pipeline.line_dedup(spark, docs(spark, [(i, f"{words(rng, 12)}\none line that all documents have") for i in range(9)]).coalesce(1), "").collect()}
    assert sorted(got) == list(range(9)) and all(("one line" in r.text) == (i == 0) and r.n_chars == len(r.text) for i, r in got.items())
    assert {p.split("/")[-1].rpartition("-")[0] for p in folders() - before} - {"links", "families"} == {"repeated-lines"}


def test_rows_without_ids_keep_their_own_lines(spark):
    rows = docs(spark, [(None, "one line of words\nshared by two"), (None, "other words here\nshared by two"), (3, "shared by two"), (3, "shared by two\nlast")])
    got = Counter(r.cleaned for r in marked(rows).collect())
    lines = [x for t in got.elements() for x in t.split("\n") if x]
    assert sorted(lines) == sorted(["one line of words", "other words here", "shared by two", "last"])


def test_very_long_texts(spark):
    from missive.llm.packing import pack

    rng = random.Random(13)
    long = words(rng, 60_000)
    near = long.split()
    near[30_000] += "z"
    rows = docs(spark, [(1, long), (2, " ".join(near)), (3, "x"), (4, "\n" * 50_000)])
    assert {r.doc_id: r.component_id for r in near_duplicates(rows).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert {r.doc_id: r.n_removed for r in marked(rows).collect()} == {1: 0, 2: 1, 3: 0, 4: 0}
    pieces = [r for r in pack(rows).collect() if r.doc_id == 1]
    assert len(pieces) > 20 and sorted(p.start for p in pieces)[1:] == [sum(q.length for q in sorted(pieces, key=lambda q: q.start)[: k + 1]) for k in range(len(pieces) - 1)]
    assert all(p.offset == 0 for p in pieces if p.length == 2048)
