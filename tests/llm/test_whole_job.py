"""Cases that an earlier round left out: long passages of few lines, headers in large tables, wrapped licences."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sightline.llm import licenses, line_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def said(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice("abcdefgh") + str(r.randrange(900)) for _ in range(n))


@pytest.mark.parametrize("least", [3, 4])
def test_long_passages_of_few_lines(spark, least):
    import corpus_pipeline

    long, half, rest, short = said(60, 1), said(30, 2), said(25, 3), said(40, 4)
    own = [said(8, 100 + i) for i in range(9)]
    texts = [
        "\n".join([own[0], long, own[1], half, "", rest]), "\n".join([own[2], "  " + long + "\t", own[3], own[4]]), long, "\n".join([own[5], half, rest, own[6]]),
        "\n".join([short, own[7], short, own[8]]), short, None, "", long + "\n" + long, half + "\n" + own[0], "\n".join(own[:5]), "\n".join(own[1:5]), said(49, 9), said(49, 9), said(50, 10), said(50, 10),
    ]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    seen, want = {}, {}
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        inked = [k for k, line in enumerate(lines) if line.strip()]
        gone = set()
        for size in range(1, least + 1):
            for k in range(len(inked) - size + 1):
                run = tuple(lines[j].strip() for j in inked[k : k + size])
                if (size == least or len(" ".join(run).split()) >= 50) and seen.setdefault(run, (i, k)) != (i, k):
                    gone.update(inked[k : k + size])
        want[i] = t if not gone else "\n".join(line for k, line in enumerate(lines) if k not in gone)
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r.doc_id: r for r in line_dedup.remove_repeated_lines(table, least_lines=least, least_words=50, count=True).collect()}
    assert {i: r.text for i, r in got.items()} == want and all(r.n_chars == len(r.text or "") for r in got.values())
    assert want[2] == "" and want[3] == "\n".join([own[5], own[6]]) and want[5] == short
    kept = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, table, "").collect()}
    assert 2 not in kept and 8 not in kept and 15 not in kept and kept[13] == texts[13] and kept[1] == "\n".join(own[2:5])


HEADERS = {"Copyright 2021 Acme. Licensed under the Apache License, Version 2.0.": "Apache-2.0", "# Released under the MIT License. See LICENSE.": "MIT"}


@pytest.mark.parametrize("n", [200, 200_000])
def test_headers_have_the_same_licence_in_any_table(spark, n):
    """The words of the templates stand in the same share of the documents, holder and year in one."""
    filler = F.when(F.col("id") % 2 == 0, "the work is of this").when(F.col("id") % 25 == 1, "Licensed under the GNU license, version 3 or Apache 2.0").when(F.col("id") % 25 == 3, "released with mit").otherwise("lorem ipsum")
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("f/"), "id").alias("path"), filler.alias("text"))
    heads = spark.createDataFrame([(-1 - i, f"h{i}/x", h + "\n" + said(40, i)) for i, h in enumerate(HEADERS)], "doc_id long, path string, text string")
    got = licenses.scan(docs.unionByName(heads)).filter("doc_id < 0").orderBy(F.desc("doc_id")).collect()
    assert [(r.license, r.source) for r in got] == [(x, "own") for x in HEADERS.values()]


def test_wrapped_licences(spark):
    mit = "/*\n * Permission is hereby granted, free of charge, to any person\n * obtaining a copy of this software and its files.\n * Released under\n * the MIT License.\n */"
    rows = [
        (1, "a/1", mit), (2, "a/b/2", said(20, 1)), (3, "c/3", said(30, 2) + "\n# This work is licensed under the\n# GNU General Public\n# License, version 3.\n" + said(30, 3)),
        (4, "d/4", "// All rights\n// reserved."), (5, "d/e/5", None), (6, "c/6", "no word of it\n" + said(9, 4)), (7, "g/7", "to any person obtaining a copy\n" + said(9, 5)),
    ]
    got = sorted((r.doc_id, r.license, r.source, r.from_dir) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect())
    assert got == [
        (1, "MIT", "own", None), (2, "MIT", "directory", "a"), (3, "GPL-3.0", "own", None), (4, "Proprietary", "own", None), (5, "Proprietary", "directory", "d"), (6, None, "none", None), (7, None, "none", None),
    ]


def test_whole_tokens_are_read():
    hits = toxicity.Hits(toxicity.Trie([("idiot", False), ("abruti", False), ("moron", False), ("stupid", True)]))
    for token in ("l'idiot", "d’abruti", "you-idiot", "well,idiot", "x/idiot", "«idiot»", "12idiot"):
        assert hits[token] and hits[token][1] == 0, token
    for token in ("id1ot", "m0ron", "st*pid", "(id1ot)!", "l'idiott"):
        assert hits[token] and hits[token][1] == 1, token
    for token in ("", "12'345", "l'ide", "id10t5", "well-known", "m0r0n"):
        assert hits[token] is None, token


def judge_of_rows(spark, n=600):
    """A judge fitted on rows of which a fifth abuse, near copies of one such text among them."""
    r, rows, labels = random.Random(8), [], []
    copied = said(30, 77).split()
    for i in range(n):
        bad = i % 5 == 0
        w = said(40, 4000 + i).split()
        if bad:
            for term in ("scumbag", "vermin", "grothling"):
                w.insert(r.randrange(len(w)), term)
        elif i % 5 == 1:
            w.insert(r.randrange(len(w)), "vermine")  # a word of its own, one letter from a term
        if i % 15 == 0:
            w = [*w, *copied[: r.randrange(25, 30)]]
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), train=toxicity.F.lit(True)), rows, labels


def test_misspelled_and_quoted_hits_move_the_score(spark):
    judge, rows, labels = judge_of_rows(spark)
    assert {t for t, _ in judge.terms} == {"scumbag", "vermin", "grothling"}  # no word of the copied passage
    assert all(w > 0 for w in judge.weights[1:]) and judge.ordinary == {"vermine"}
    asked = ["plain words", "you scumbag", "you scumbga bag", "you scumbxg", 'He said "you scumbag" to it', "you vermine", "you vermin scumbag grothling", "you vermin scumbxg grothling", 'They wrote "vermin scumbag grothling" there', None, ""]
    docs = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string")
    got = {x.doc_id: x.score for x in toxicity.score_toxicity(docs, judge, keep=["doc_id"]).collect()}
    assert got[0] < got[4] < got[3] < got[1] < got[7] < got[6] and got[5] == got[0] == got[9] == got[10]
    assert got[6] >= 0.5 and got[8] < 0.5
    marked = {i: y for i, y in labels}
    scored = toxicity.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), judge, keep=["doc_id"]).collect()
    assert all((x.score >= 0.5) == marked[x.doc_id] for x in scored)


def test_scores_are_those_of_brute_force(spark):
    judge, _, _ = judge_of_rows(spark)
    r = random.Random(9)
    texts = [" ".join(r.choice(["scumbag", "scumbg", "vermin", "vermine", "vremin", "grothlinga", "word", "of", '"he', 'it"', "said"]) for _ in range(r.randrange(30))) for _ in range(80)]
    got = {x.doc_id: x.score for x in toxicity.score_toxicity(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), judge, keep=["doc_id"]).collect()}

    def errors(a, b):
        rows = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                rows[i][j] = min(rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        return rows[-1][-1]

    for i, text in enumerate(texts):
        words, counts = text.split(), {}
        for k, word in enumerate(words):
            near = [(errors(word.strip('"'), t), n) for n, (t, _) in enumerate(judge.terms) if errors(word.strip('"'), t) <= 1 and not (word in judge.ordinary)]
            if near:
                e, n = min(near)
                kind = 2 if toxicity.in_quotation(words, k) else e
                counts[kind, e, n] = counts.get((kind, e, n), 0) + 1
        z = judge.weights[0] + sum(judge.weights[1 + kind] * judge.term_weights[e, n] * math.log1p(c) for (kind, e, n), c in counts.items())
        assert got[i] == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-6)
