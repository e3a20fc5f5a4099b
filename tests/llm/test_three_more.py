"""Fill-in-middle, filter audit and repeated words against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sightline.llm import filter_audit, fim, oracles, word_repeats
from sightline.llm.textbytes import NOT_SPACE, Words, buffers

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def prose(n, seed, few=400):
    r = random.Random(seed)
    return " ".join(r.choice(["the", "of", "élan", "Größe", "niño", "𝄞", "x"]) + str(r.randrange(few)) for _ in range(n))


# ---- fill-in-middle


def transformed(text, doc_id, seed=42, rate=50, first=80, marks=("<P>", "<S>", "<M>")):
    units = UNITS.findall(text or "")
    n = len(units)
    if doc_id is None:
        return n, "plain", None, None, text or ""
    h = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    p, s, m = marks
    if not text or any(x in text for x in marks) or h3 % 100 >= rate:
        return n, "plain", None, None, text or ""
    if h4 % 100 < first:
        return n, "spm", len(prefix), len(middle), s + suffix + p + prefix + m + middle
    return n, "psm", len(prefix), len(middle), p + prefix + s + suffix + m + middle


def fim_texts():
    r = random.Random(5)
    letters = "ab <>PSM\n\t\x0b\xa0é߀𝄞"
    made = ["".join(r.choice(letters) for _ in range(r.randrange(0, 40))) for _ in range(300)]
    return [*made, None, "", " ", "\n\n", "a", " a ", "<P>", "a <M> b", "< P>", "a<", "<<S>", "€" * 700, prose(30_000, 1), prose(900, 2) + "  \n"]


def test_fill_in_middle(spark):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(fim_texts())] + [(None, "no id here", "en", "s", 0), (7, fim_texts()[7], "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("form", F.lit("mine"))
    out = fim.fill_in_middle(docs)
    assert out.columns == [*SCHEMA.replace(" long", "").replace(" string", "").split(", "), "output", "form", "n", "prefix_chars", "middle_chars"]
    out = out.withColumn("back", fim.restored(F.col("output"), F.col("form")))
    got = sorted(((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in out.collect()), key=repr)
    want = sorted(((i, t, *transformed(t, i), t or "") for i, t, *_ in rows), key=repr)
    assert got == want
    assert {r[3] for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


def test_fill_in_middle_with_other_settings(spark):
    marks = ("[PRE]", "[SUF]", "[MID]")
    texts = [*fim_texts(), "has [SUF] inside", "[PR", "[PRE", "[[MID]"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "key long, said string")
    out = fim.fill_in_middle(docs, seed=7, rate=100, suffix_first=30, sentinels=marks, text="said", doc_id="key")
    out = out.withColumn("back", fim.restored(F.col("output"), F.col("form"), marks))
    for r in out.collect():
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) == (*transformed(r.said, r.key, 7, 100, 30, marks), r.said or "")
    with pytest.raises(ValueError):
        fim.fill_in_middle(docs, sentinels=("a b", "c", "d"), text="said", doc_id="key")


def test_scan_does_not_depend_on_lanes():
    texts = [t or "" for t in fim_texts()]
    raw, offsets = buffers(pa.array(texts))
    symbols = np.insert(raw, offsets[1:], fim.END)
    to, emits = fim.automaton()
    state, want = 0, []
    for byte in symbols[:20_000].tolist():
        want.append(emits[state + byte])
        state = to[state + byte]
    assert fim.scan(symbols)[:20_000].tolist() == want


# ---- filter interactions


def audit(rows, labels):
    first = {}
    for i, t, _, _, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    masks = []
    for i, t, _, source, _ in rows:
        t = t or ""
        w = WORDS.findall(t)
        fails = "".join(
            c for c, hit in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > first[t]), strict=True) if hit
        )
        masks.append((source or "", fails, i in good, i in toxic))
    out, shares = {}, Counter()
    for part in {m[0] for m in masks}:
        own = [m for m in masks if m[0] == part]
        for order in map("".join, permutations("ABCDE")):
            for k, f in enumerate(order):
                early = set(order[:k])
                removed = [m for m in own if f in m[1] and not early & set(m[1])]
                shares[part, f] += len(removed)
                out[part, order, k + 1] = (
                    sum(not (early | {f}) & set(m[1]) for m in own), len(removed), sum(f in m[1] and bool(early & set(m[1])) for m in own), sum(m[1] == f for m in own), sum(m[2] for m in removed), sum(m[3] for m in removed),
                )
    return sorted((p, o, k, *v, shares[p, o[k - 1]]) for (p, o, k), v in out.items())


def audit_rows():
    r = random.Random(9)
    base = [prose(60, 1), prose(60, 1) + " ", prose(120, 2, 5), "SHOUT " * 60, "plain words & marks " * 30, "short", "", None, "a" * 64, "a" * 63 + "b", "x" * 700, "x" * 575 + "y" + "x" * 124, prose(3000, 3), "é" * 65, "é" * 64 + "e"]
    rows = [(i, r.choice(base), "en", r.choice(["web", "books", None, ""]), 0) for i in range(120)]
    return [*rows, (3, rows[3][1], "en", "web", 0), (None, base[0], "en", "web", 0), (None, base[0], "en", "web", 0), (500, base[0], "de", "solo", 1)]


@pytest.mark.parametrize("broadcast", [1_000_000, -1])
def test_filter_interactions(spark, monkeypatch, broadcast):
    monkeypatch.setattr(filter_audit, "BROADCAST_CLASSES", broadcast)
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 120, 3)] + [(3, 0, 1), (900, 1, 1), (6, None, None)]
    docs = spark.createDataFrame(audit_rows(), SCHEMA).repartition(3).withColumns({"mask": F.lit(1), "least": F.lit("x"), "last": F.lit(0)})
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted(tuple(r) for r in filter_audit.interactions(filter_audit.masks(docs, table)).collect())
    assert got == audit(audit_rows(), labels)
    assert filter_audit.interactions(filter_audit.masks(docs.limit(0), table)).count() == 0
    unlabelled = filter_audit.interactions(filter_audit.masks(docs, table.limit(0))).agg(F.sum("good_lost"), F.sum("toxic_lost")).first()
    assert tuple(unlabelled) == (0, 0)


def test_unlike_texts_of_equal_hashes(spark):
    docs = spark.createDataFrame(audit_rows(), SCHEMA)
    weak = lambda *c: F.xxhash64(F.lit(1))
    marked = lambda rows: sorted((r.doc_id is None, r.doc_id or 0, r.mask) for r in rows.collect())
    assert marked(filter_audit.masks(docs, hashed=weak)) == marked(filter_audit.masks(docs))


def test_refinement_drops_single_classes(spark):
    texts = ["a" * 64 + "b" * 600, "a" * 64 + "c" * 600, "a" * 700, "a" * 700, "z"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = docs.select("doc_id", F.length("text").alias("length"), filter_audit.block_hashes(F.col("text")).alias("blocks"))
    rows = rows.withColumn("last", filter_audit.class_of(F.col("length"), F.col("blocks")))
    assert [len(r.blocks) for r in rows.orderBy("doc_id").collect()] == [3, 3, 3, 3, 1]
    assert filter_audit.repeated_classes(rows).count() == 1


# ---- repeated words


def without(rows, length=35):
    places = {}
    texts = {i: WORDS.findall(t or "") for i, t, *_ in rows if i is not None}
    for i, w in texts.items():
        for k in range(len(w) - length + 1):
            places.setdefault(tuple(w[k : k + length]), set()).add((i, k))
    gone = {(i, j) for at in places.values() if len(at) > 1 for i, k in at for j in range(k, k + length)}
    out = []
    for i, t, *_ in rows:
        w = WORDS.findall(t or "")
        left = [x for j, x in enumerate(w) if (i, j) not in gone]
        out.append((i, len(w), len(w) - len(left), " ".join(left)))
    return sorted(out, key=repr)


def repeat_rows(seed):
    r = random.Random(seed)
    shared = [prose(n, 100 + n).split() for n in (34, 35, 36, 50, 90, 300)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(r.randrange(1, 6)):
            w += prose(r.randrange(0, 30), r.random()).split()
            part = r.choice(shared)
            a = r.randrange(0, 8)
            w += part[a : len(part) - r.randrange(0, 8)] if r.random() < 0.7 else part
            if r.random() < 0.3 and w:
                w[r.randrange(len(w))] = "edit"
        rows.append((i, r.choice([" ", "\n", " \t"]).join(w), "en", "s", 0))
    same, whole = "again and again " * 40, " ".join(shared[4])
    extra = [None, "", " \n", "one", "k " * 34, "k " * 35, "k " * 36, same, same, whole, whole, whole.upper(), prose(20_000, 8), " ".join(shared[0]), " ".join(shared[0])]
    rows += [(100 + i, t, "en", "s", 0) for i, t in enumerate(extra)]
    return [*rows, (109, whole, "de", "t", 1), (None, whole, "en", "s", 0)]


@pytest.mark.parametrize(("seed", "broadcast"), [(1, 2_000_000), (2, -1), (3, 2_000_000)])
def test_repeated_words(spark, monkeypatch, seed, broadcast):
    monkeypatch.setattr(word_repeats, "BROADCAST_SPANS", broadcast)
    rows = repeat_rows(seed)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({"repeats": F.lit("mine"), "start": F.lit(1), "n_words": F.lit("old")})
    out = word_repeats.without_repeats(docs)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in out.collect()), key=repr)
    assert got == without(rows)
    assert out.columns[:7] == [*docs.columns[:5], "repeats", "start"] and out.count() == len(rows)


def test_repeats_of_small_tables_and_other_lengths(spark):
    rows = repeat_rows(4)
    docs = spark.createDataFrame(rows, SCHEMA)
    assert word_repeats.without_repeats(docs.limit(0)).count() == 0
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in word_repeats.without_repeats(docs, length=50).collect()), key=repr)
    assert got == without(rows, 50)
    one = spark.createDataFrame([(1, " ".join(prose(40, 3).split() * 2))], "doc_id long, text string")
    assert [list(r.repeats) for r in word_repeats.maximal_repeats(one).collect()] == [[0, 80]]
    with pytest.raises(ValueError):
        word_repeats.maximal_repeats(docs, length=10)


def test_seeds_are_the_same_for_equal_windows():
    text = prose(300, 6)
    words = [Words(*buffers(pa.array([t])), NOT_SPACE, fold=False, wide=True) for t in (text, "own words before " + text + " and after")]
    sets = [dict(zip(zip(*(x.tolist() for x in word_repeats.seeds(w.hash, w.first)[:3]), strict=True), word_repeats.seeds(w.hash, w.first)[4].tolist(), strict=True)) for w in words]
    both = sets[0].keys() & sets[1].keys()
    assert len(both) >= len(sets[0]) - 2 and all(sets[1][k] == sets[0][k] + 3 for k in both)


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_filter_interactions", "op13_repeated_words"])
def test_same_rows_as_sql(spark, tmp_path, name):
    """The whole query and its SQL over a table of hard cases."""
    from sightline.llm import entries

    texts = [t for t in [*fim_texts()[-40:], *(t for _, t, *_ in audit_rows()[:40]), *(t for _, t, *_ in repeat_rows(5))] if t is None or len(t) < 50_000]
    spark.createDataFrame([(i, t, "en", f"s{i % 4}" if i % 9 else None, 0) for i, t in enumerate(texts)], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2, i % 3) for i in range(0, len(texts), 2)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.sql(oracles.ORACLES[name])
    got = entries.QUERIES[name](spark, str(tmp_path)).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)
