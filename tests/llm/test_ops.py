"""The corpus operators against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from sightline.llm import decontaminate, jaccard, licenses, line_dedup, packing, quality, repeats, token_files, toxicity, tree_search
from sightline.llm.tokens import default_tokenizer, word_ids

LOW = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed):
    r = random.Random(seed)
    return [r.choice("the of and lorem ipsum dolor sit amet élan größe niño x1 77".split()) + (r.choice(["", "a", "is"]) if r.random() < 0.6 else str(r.randrange(500))) for _ in range(n)]


def corpus():
    base = " ".join(words(120, 1))
    near = base.split()
    near[60] = "changed"
    lines = [" ".join(words(9, 50 + i)) for i in range(8)]
    texts = [
        base, base, " ".join(near), None, "", "Short one.", "  \n\t ", "\n".join(lines), "\n".join([" ".join(words(9, 90)), *lines[2:6], "end"]),
        "\n".join(["  " + lines[0], "", lines[1], lines[2], lines[0], lines[1], lines[2]]), "a" * 450, " ".join(words(9000, 3)), base[:300] + " tail " + " ".join(words(40, 4)),
        "Don't we'LL — 12'345 <b>ÀÉ</b> é", base.upper(), "x" * 99, "y" * 100 + "y",
    ]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return [*rows, (100, base, "en", "s0", len(base)), (100, base, "en", "s0", len(base))]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


def test_decontaminate(spark, docs):
    base = corpus()[0][1].split()
    items = [("b1", " ".join(base[20:45]).upper()), ("b10", " ".join(base[40:52])), ("b2", "short one"), ("b3", None), ("b4", "!!"), ("b5", "amet"), ("b6", "SHORT, one!")]
    table = spark.createDataFrame(items, "item_id string, text string")
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for name, t in items:
        w = pattern.findall((t or "").translate(LOW))
        for k in range(len(w) - min(10, len(w)) + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(name)
    want = []
    for i, t, *_ in corpus():
        w = pattern.findall((t or "").translate(LOW))
        hit, found = [False] * len(w), set()
        for window, names in windows.items():
            for k in range(len(w) - len(window) + 1):
                if tuple(w[k : k + len(window)]) == window:
                    hit[k : k + len(window)] = [True] * len(window)
                    found |= names
        want.append((i, len(w), sum(hit), sorted(found)))
    one = decontaminate.find_spans(docs, table)
    got = [(r.doc_id, r.n_words, sum(s.last_word - s.first_word + 1 for s in r.spans), r["items"]) for r in one.collect()]
    assert sorted(got) == sorted(want)
    old, decontaminate.BLOCK_BYTES = decontaminate.BLOCK_BYTES, 60  # several blocks of items
    try:
        assert sorted((r.doc_id, r.n_words, sum(s.last_word - s.first_word + 1 for s in r.spans), r["items"]) for r in decontaminate.find_spans(docs, table).collect()) == sorted(want)
    finally:
        decontaminate.BLOCK_BYTES = old
    clean = decontaminate.decontaminate(docs, table, max_coverage=0.9)
    assert clean.columns == docs.columns
    kept = {r.doc_id: r for r in clean.collect()}
    assert 5 not in kept and kept[7].text == corpus()[7][1] and base[30] not in kept[0].text.split()[20:24]
    assert all(r.n_chars == len(r.text or "") for r in kept.values())
    assert decontaminate.find_spans(docs, table.limit(0)).filter("size(spans) > 0").count() == 0
    assert decontaminate.find_spans(docs.limit(0), table).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_automaton_on_random_words(seed):
    r = random.Random(seed)
    items = [(str(i), " ".join(r.choice("abc") for _ in range(r.randrange(1, 9)))) for i in range(4)]
    automaton = decontaminate.ItemAutomaton(items, 4)
    text = " ".join(r.choice("abcd") for _ in range(60))
    raw, at = decontaminate.buffers(__import__("pyarrow").array([text]))
    ws, found, hit = decontaminate.Words(raw, at, decontaminate.ALNUM), set(), set()
    for b, e in automaton.stretches(ws):
        for i, j, _ in automaton.spans(ws, b, e, found):
            hit.update(range(i, j + 1))
    t, want, names = text.split(), set(), set()
    for k, (_, item) in enumerate(items):
        w = item.split()
        n = min(4, len(w))
        for i in range(len(w) - n + 1):
            for j in range(len(t) - n + 1):
                if t[j : j + n] == w[i : i + n]:
                    want.update(range(j, j + n))
                    names.add(k)
    assert hit == want and found == names


def test_nearest(spark):
    r = np.random.default_rng(5)
    x = r.standard_normal((1500, 8)).astype(np.float32)
    x[200:700] = x[200]  # one vector that a third of all rows have
    rows = [(i, [float(v) for v in x[i]], 0) for i in range(1500)]
    bad = [(2000, None, 0), (2100, [0.0] * 8, 0), (2200, [float("nan")] * 8, 0), (2300, [1.0, None] * 4, 0), (2400, [1.0] * 7, 0), (2500, [float("inf")] * 8, 0)]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, rank int")
    got = {}
    for q in tree_search.nearest(table, tree_search.F.col("vec_id") % 100 == 0).collect():
        got.setdefault(q.query_id, []).append((q["rank"], q.vec_id, q.score))
    assert sorted(got) == list(range(0, 1500, 100))
    d, right = x.astype(np.float64), 0
    for q, found in got.items():
        away = np.sqrt(((d - d[q]) ** 2).sum(1))
        away[q] = np.inf
        best = np.lexsort((np.arange(1500), away))[:10]
        right += len(set(best.tolist()) & {v for _, v, _ in found})
        assert [k for k, _, _ in sorted(found)] == list(range(1, 11))
        assert all(s == pytest.approx(away[v], abs=1e-12) for _, v, s in found)
    assert right >= 0.9 * 150 and [v for _, v, _ in sorted(got[300])] == list(range(200, 210))
    few = tree_search.nearest(table.filter("vec_id in (0, 1, 2)"), tree_search.F.col("vec_id") == 0).collect()
    assert len(few) == 2 and tree_search.nearest(table.limit(0), tree_search.F.col("vec_id") == 0).count() == 0


def test_packing(spark, docs):
    rows = packing.pack(docs).collect()
    ids = word_ids(default_tokenizer())
    want = []
    for i, t, *_ in corpus():
        x = ids.encode(t) + np.array([1], "<u4").tobytes()
        want += [(i, p, a // 4, len(x[a : a + 16384]) // 4, zlib.crc32(x[a : a + 16384])) for p, a in enumerate(range(0, len(x), 16384))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(bins) == -(-sum(r.length for r in rows) // 4096)
    assert packing.pack(docs.limit(0)).count() == 0


def test_fullest():
    r = random.Random(1)
    for _ in range(40):
        counts = {r.randrange(1, 30): r.randrange(1, 4) for _ in range(6)}
        room = r.randrange(1, 60)
        sums = {0}
        for k, n in counts.items():
            sums = {a + k * j for a in sums for j in range(n + 1)}
        chosen = packing.fullest(counts, room)
        assert sum(k * n for k, n in chosen.items()) == max(a for a in sums if a <= room) and all(n <= counts[k] for k, n in chosen.items())


def test_token_files(spark, docs, tmp_path):
    files = token_files.write_tokens(docs, f"file://{tmp_path}/t")
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.read_digests(files).collect())
    ids, start, want = word_ids(default_tokenizer()), 0, []
    for i, t, *_ in sorted(corpus(), key=lambda x: x[0]):
        x = ids.encode(t) + np.array([2], "<u4").tobytes()
        want.append((start, i, len(x) // 4, zlib.crc32(x)))
        start += len(x) // 4
    assert got == want
    name = files.first().file
    index = token_files.read_index(name)
    back = [d for d, _ in token_files.read_records(name, index["at"][::-1])]
    assert back == index["doc_id"][::-1].tolist()
    path = name.removeprefix("file://") + ".rec"
    raw = bytearray(open(path, "rb").read())
    raw[len(raw) // 2] ^= 1
    open(path, "wb").write(raw)
    with pytest.raises(ValueError):
        list(token_files.read_records(name))


def test_whole_tokenizer_and_words_agree():
    ids, r = word_ids(default_tokenizer()), random.Random(3)
    letters = "aAbÉé'sS tT\n\t\r  ́ÅİΣσς12٣½$%&<|endoftext|>\x1c\x85　汉字ぁ😀'll're"
    for _ in range(1500):
        t = "".join(r.choice(letters) for _ in range(r.randrange(40)))
        assert np.frombuffer(ids.encode(t), "<u4").tolist() == ids.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_repeated_strings(spark, docs):
    found = {}
    for r in repeats.repeated_spans(docs).collect():
        found[r.doc_id] = repeats._merged(r.places, 100, 1 << 60)
    seen, want = {}, {}
    for i, t, *_ in sorted(set(corpus()), key=lambda x: x[0]):
        raw = (t or "").encode()
        gone = set()
        for k in range(len(raw) - 99):
            w = raw[k : k + 100]
            if w in seen and seen[w] != (i, k):
                gone.update(range(k, k + 100))
            seen.setdefault(w, (i, k))
        want[i] = gone
    assert {i: {b for a, z in s for b in range(a, z)} for i, s in found.items()} == {i: g for i, g in want.items() if g}


@pytest.mark.parametrize("held", [5000, 2])
def test_repeated_strings_on_edits(spark, held):
    r, rows = random.Random(7), []
    base = "".join(r.choice("abcdefgh ") for _ in range(700))
    for i in range(25):
        t = list(base)
        for _ in range(r.randrange(4)):
            t[r.randrange(len(t))] = r.choice("XYZ")
        rows.append((i, "".join(t)[r.randrange(40) :], "en", "s", 0))
    seen, want = set(), {}
    for i, t, *_ in rows:
        for k in range(len(t) - 99):
            if t[k : k + 100] in seen:
                want.setdefault(i, set()).update(range(k, k + 100))
            seen.add(t[k : k + 100])
    old, repeats.HELD_UNITS = repeats.HELD_UNITS, held
    try:
        found = {x.doc_id: {b for a, z in repeats._merged(x.places, 100, 1 << 60) for b in range(a, z)} for x in repeats.repeated_spans(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    finally:
        repeats.HELD_UNITS = old
    assert found == want


def brute_components(rows, size, percent):
    sets = {}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("inside", "sketched"), [(1024, 4096), (3, 3)])
def test_jaccard(spark, inside, sketched):
    r, rows = random.Random(11), list(corpus())
    for family in range(3):
        core = words(60, 1000 + family)
        for i in range(14):
            t = list(core)
            for _ in range(r.randrange(5)):
                t[r.randrange(len(t))] = f"w{r.randrange(10**6)}"
            rows.append((1000 + family * 50 + i, " ".join(t), "de", "s", 0))
    rows += [(3000 + i, " ".join(r.choice("ab") for _ in range(r.randrange(1, 9))), "en", "s", 0) for i in range(40)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    old = jaccard.JOINED_INSIDE, jaccard.SKETCHED_INSIDE
    jaccard.JOINED_INSIDE, jaccard.SKETCHED_INSIDE = inside, sketched
    try:
        for size, percent in ((3, 90), (5, 80)):
            want = brute_components(rows, size, percent)
            got = jaccard.jaccard_components(table, shingle=size, percent=percent).collect()
            assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == want and len(got) == len(rows)
    finally:
        jaccard.JOINED_INSIDE, jaccard.SKETCHED_INSIDE = old


def test_sketches_rule_no_link_out():
    r = np.random.default_rng(4)
    for n in (1, 3, 20, 90, 700):
        for percent in (80, 90):
            for _ in range(60):
                both = np.unique(r.integers(0, 2**64, 2 * n, dtype=np.uint64))
                one, two = (np.sort(both[np.sort(r.permutation(len(both))[: r.integers(1, len(both) + 1)])]) for _ in "ab")
                for x, y in ((one, two), (one, one[r.random(len(one)) < 0.95]), (one, np.sort(np.r_[one, both[: len(one) // 9]]))):
                    x, y = np.unique(x), np.unique(y)
                    if len(y) and jaccard._alike(x, y, percent):
                        assert jaccard.may_link(jaccard.sketch(x, percent), jaccard.sketch(y, percent), len(x), len(y), percent)


def test_one_of_each(spark, docs):
    left = jaccard.one_of_each(docs)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {i for i, (_, c) in brute_components(corpus(), 5, 80).items() if i == c}
    assert jaccard.jaccard_components(docs.limit(0)).count() == 0


def test_lines(spark, docs):
    got = {}
    for r in line_dedup.remove_repeated_lines(docs.withColumnRenamed("source", "runs"), count=True).collect():
        got.setdefault(r.doc_id, set()).add((r.n_removed, r.text))
    space, seen, want = " \t\n\v\f\r", {}, {}
    for i, t, *_ in sorted(set(corpus()), key=lambda x: x[0]):
        lines = (t or "").split("\n")
        inked = [k for k, line in enumerate(lines) if line.strip(space)]
        gone = set()
        for k in range(len(inked) - 2):
            run = tuple(lines[j].strip(space) for j in inked[k : k + 3])
            if seen.setdefault(run, (i, k)) != (i, k):
                gone.update(inked[k : k + 3])
        want[i] = {(len(gone), t if not gone else "\n".join(line for k, line in enumerate(lines) if k not in gone))}
    assert got == want and any(n for x in got.values() for n, _ in x)
    assert line_dedup.remove_repeated_lines(docs.limit(0)).count() == 0


def test_toxicity(spark):
    r, rows, labels = random.Random(2), [], []
    for i in range(300):
        bad = i % 4 == 0
        w = words(60, 5000 + i)
        if bad:
            w[r.randrange(60)] = r.choice(["scumbag", "vermin", "grothling", "grothlade"])
            w[r.randrange(60)] = r.choice(["scumbag", "vermin"])
        rows.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, 1, int(bad)))
    rows += [(900, "you are a scumbga vermim, a scumbagg and vermn", "en", "s", 0), (901, 'He said that they called it "a vermin, no more" in the paper and left', "en", "s", 0), (902, None, "en", "s", 0), (903, "", "en", "s", 0)]
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([*labels, (77777, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    train = quality.crc32_of_id() % 5 != 0
    judge = toxicity.fit(docs, marks, train=train)
    scores = {x.doc_id: x.score for x in toxicity.score_toxicity(docs, judge, keep=["doc_id"]).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(scores[i] >= 0.5) == (i % 4 == 0) for i in held]) >= 0.97
    assert scores[902] < 0.5 and scores[902] == scores[903] and all(0 <= s <= 1 for s in scores.values())
    assert judge.trie.find("vermn")[1] == 1 and judge.trie.find("scumbag")[1] == 0
    quoted = toxicity.in_quotation('He said "a vermin, no more" in the paper'.split(), 3)
    assert quoted and not toxicity.in_quotation("you vermin".split(), 1)
    kept = {x.doc_id for x in toxicity.reject_toxic(docs, judge).collect()}
    assert 902 in kept and 0 not in kept and toxicity.reject_toxic(docs, judge).columns == docs.columns
    none = toxicity.fit(docs, marks.limit(0), train=train)
    assert toxicity.score_toxicity(docs, none, keep=["doc_id"]).filter("score <> 0.5").count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, left = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, left[j] + 1, left[j - 1] + (x != y)))
    return row[-1]


def test_levenshtein_walk():
    r = random.Random(4)
    terms = [("abcde", False), ("bcdea", False), ("abab", False), ("eeeee", False)]
    trie = toxicity.Trie(terms)
    for _ in range(600):
        word = "".join(r.choice("abcde") for _ in range(r.randrange(3, 7)))
        near = [(distance(word, t), i) for i, (t, _) in enumerate(terms) if distance(word, t) <= (1 if len(t) >= 5 else 0)]
        got = trie.find(word)
        assert (got is None) == (not near) and (not near or got[1] == min(near)[0])


def test_quality(spark):
    r, rows = random.Random(6), []
    for i in range(240):
        w = words(50, 9000 + i)
        rows.append((i, " ".join(x.upper() + "!!" for x in w) if i % 3 == 0 else " ".join(w).capitalize() + ".", "en", "s", 0))
    rows += [(900, None, "en", "s", 0), (901, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(240)], "doc_id long, quality int, toxic int")
    voters = quality.fit(docs, labels, train=quality.crc32_of_id() % 3 != 1)
    scores = {x.doc_id: x.score for x in quality.score_quality(docs, voters).collect()}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(scores[i] >= 0.5) == (i % 3 != 0) for i in held]) >= 0.97
    assert scores[900] == scores[901] and all(0 <= s <= 1 for s in scores.values())
    none = quality.fit(docs, labels.limit(0), train=quality.crc32_of_id() % 3 != 1)
    assert quality.score_quality(docs, none).filter("score <> 0.5").count() == 0


def test_licenses(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/x.txt", "some words about nothing at all"), (3, "a/b/c/y.txt", "first\nLicensed under the Apache License, Version 2.0.\n" + " ".join(words(30, 1))),
        (4, "a/b/COPYING", "Licensed under CC BY-NC 4.0.\n" + " ".join(words(30, 2))), (5, "z/q.txt", None), (6, None, "All rights reserved."), (7, "a/b/c/d/w.txt", ""), (8, "top.txt", "a licensed fool"), (9, "a/r.txt", "x"), (9, "a/r.txt", "x"),
    ]
    got = sorted((r.doc_id, r.license, r.source, r.from_dir) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect())
    assert got == [
        (1, "MIT", "own", None), (2, "CC-BY-NC-4.0", "directory", "a/b"), (3, "Apache-2.0", "own", None), (4, "CC-BY-NC-4.0", "own", None), (5, None, "none", None),
        (6, "Proprietary", "own", None), (7, "CC-BY-NC-4.0", "directory", "a/b"), (8, None, "none", None), (9, "MIT", "directory", "a"), (9, "MIT", "directory", "a"),
    ]
    assert licenses.scan(spark.createDataFrame([], "doc_id long, path string, text string")).count() == 0


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert 0.8 * n < len(rows) <= n, name
        docs, n = spark.createDataFrame(rows, docs.schema), len(rows)
    want = brute_components([tuple(r) for r in docs.collect()], 5, 80)
    assert all(i == c for i, (_, c) in want.items())
    assert corpus_pipeline.run(spark, sf_dir).select("doc_id").distinct().count() > 0


def test_digests(spark, sf_dir):
    for q in (repeats.query, line_dedup.query):
        assert all(re.fullmatch("[0-9a-f]{64}", r.kept_sha256) for r in q(spark, sf_dir).collect())
    assert hashlib.sha256(b"").hexdigest() in {r.items_sha256 for r in decontaminate.query(spark, sf_dir).collect()}
