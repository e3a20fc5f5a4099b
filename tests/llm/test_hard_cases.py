"""Hashes, clashing names, repeated ids and other hard cases, each against what is defined for it."""

import random

import numpy as np
import pyarrow as pa
import pytest

from sightline.llm import decontaminate, jaccard, line_dedup, quality, repeats, token_files, toxicity, tree_search
from sightline.llm.textbytes import NOT_SPACE, Words, buffers, hashes, sliced
from sightline.llm.tokens import default_tokenizer, word_ids

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SWAP = str.maketrans("ab", "ba")


def alternating(n):
    """The word in which each half is the other with a and b swapped."""
    out = "a"
    while len(out) < n:
        out += out.translate(SWAP)
    return out


def test_hashes_tell_words_apart():
    words = [alternating(n) for n in (64, 256, 512, 1024, 2048)]
    texts = [*words, *(w.translate(SWAP) for w in words), "x" * 700, "x" * 701, "", "ab", "ab\x00"]
    raw, at = buffers(pa.array(texts))
    wide = hashes(raw, at[:-1], at[1:], wide=True)
    assert len({tuple(x) for x in wide.tolist()}) == len(set(texts)) == len(set(wide[:, 0].tolist()))
    found = Words(*buffers(pa.array(["one two one", "TWO"])), NOT_SPACE)
    assert found.hash[0] == found.hash[2] and found.hash[1] == found.hash[3] != found.hash[0]


def test_lines_and_sets_of_long_words(spark):
    one, two = alternating(1024), alternating(1024).translate(SWAP)
    rows = [(0, f"{one}\nsecond line\nthird line", "en", "s", 0), (1, f"{two}\nsecond line\nthird line", "en", "s", 0), (2, f"{two}\nsecond line\nthird line\nmore", "en", "s", 0), (3, one, "en", "s", 0), (4, two, "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    left = {r.doc_id: r.text for r in line_dedup.remove_repeated_lines(docs).collect()}
    assert left == {i: ("more" if i == 2 else t) for i, t, *_ in rows}
    found = [(r.doc_id, r.line, r.n_lines, r.from_doc, r.from_line) for r in line_dedup.matches(docs).collect()]
    assert found == [(2, 0, 3, 1, 0)]
    groups = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs.filter("doc_id > 2")).collect()}
    assert groups == {3: 3, 4: 4}


def test_matches_go_as_far_as_lines_agree(spark):
    lines = [f"line {i} of the text" for i in range(12)]
    rows = [(1, "\n".join(["a", *lines, "b"]), "en", "s", 0), (2, "\n".join(["c", *lines[2:9], "d", *lines[:3]]), "en", "s", 0)]
    got = sorted((r.doc_id, r.line, r.n_lines, r.from_doc, r.from_line) for r in line_dedup.matches(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(2, 1, 7, 1, 3), (2, 9, 3, 1, 1)]


def test_columns_named_as_outputs(spark):
    item = " ".join(f"w{i}" for i in range(14))
    rows = [(1, f"start {item} end", "mine", 7, [1], "x"), (2, "nothing here", None, None, None, None), (None, None, "y", 1, [], "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, items string, n_words int, spans array<int>, __spans string")
    table = spark.createDataFrame([("i", item)], "item_id string, text string")
    out = decontaminate.decontaminate(docs, table, max_coverage=0.95)
    assert out.columns == docs.columns
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].text == "start  end" and (got[1]["items"], got[1].n_words, got[1].spans, got[1]["__spans"]) == ("mine", 7, [1], "x") and got[None].text is None
    found = decontaminate.find_spans(docs, table).collect()
    assert {r.doc_id: r["items"] for r in found} == {1: ["i"], 2: [], None: []}
    lines = line_dedup.remove_repeated_lines(docs.withColumnRenamed("items", "__runs").withColumnRenamed("n_words", "__doc"))
    assert lines.count() == 3 and "__runs" in lines.columns and "__doc" in lines.columns
    judge = toxicity.Judge([("vermin", False)], 0.5).fit(np.array([[1.0, 0, 0], [0, 0, 0]]), np.array([1.0, 0]), 1.0)
    scored = toxicity.score_toxicity(docs.withColumnRenamed("items", "score").withColumnRenamed("n_words", "__text"), judge, keep=["doc_id", "score", "__text"])
    assert scored.columns == ["doc_id", "__text", "score"] and scored.count() == 3
    assert toxicity.score_toxicity(docs.limit(0), judge, keep=["doc_id"]).count() == 0


def test_an_id_with_several_texts_is_its_first(spark):
    rows = [(0, "k l m n", "", "", 0), (1, "p q r s", "", "", 0), (1, "k l m n", "", "", 0), (2, "p q r s", "", "", 0), (3, None, "", "", 0), (3, "p q r s", "", "", 0), (None, "p q r s", "", "", 0), (4, "z", "", "", 0), (4, "z", "", "", 0)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect())
    assert got == [(0, 2, 0), (1, 2, 0), (1, 2, 0), (2, 2, 2), (3, 2, 2), (3, 2, 2), (4, 1, 4), (4, 1, 4)]


def test_votes_are_those_of_brute_force():
    r = np.random.default_rng(3)
    texts = [" ".join(r.choice(["Aa", "bb!", "ccc", "D9", "e,", "ff."], 12)) for _ in range(60)]
    counts = np.concatenate([c for _, _, c in quality._rows(*buffers(pa.array(texts)))])
    labels, idf = (np.arange(60) % 3 == 0).astype(np.float32), np.ones(quality.FEATURES, np.float32)
    voters = quality.Voters(counts[:50], labels[:50], idf, 0.4)
    got = voters.score(counts[50:])
    for row, score in zip(counts[50:], got, strict=True):
        v = quality.weighted(row[None].copy(), idf)[0] @ voters.axes
        cosine = [float(np.dot(v, u) / np.linalg.norm(v)) for u in voters.vectors]
        near = sorted(range(50), key=lambda i: -cosine[i])[: quality.NEIGHBOURS]
        votes = [0.0, 0.0]
        for i in near:
            votes[int(labels[i])] += max(cosine[i], 0.0) ** quality.SHARPNESS
        votes = votes[0] * voters.for_zero, votes[1] * voters.for_one
        assert score == pytest.approx(votes[1] / sum(votes), abs=2e-3)


def test_empty_tables_and_null_ids(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    assert repeats.repeated_spans(none).count() == 0
    assert token_files.read_digests(token_files.write_tokens(none, f"file://{tmp_path}/none")).count() == 0
    with pytest.raises(Exception, match="required argument is not an integer"):
        token_files.write_tokens(spark.createDataFrame([(None, "a", "", "", 0)], SCHEMA), f"file://{tmp_path}/null").count()
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    voters = quality.fit(none, labels, train=quality.crc32_of_id() % 3 != 1)
    assert quality.score_quality(none, voters).count() == 0
    rows = [(100, [1.0, 0.0]), (100, [1.0, 0.0]), (1, [0.0, 1.0]), (None, [1.0, 1.0])]
    found = tree_search.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), tree_search.F.col("vec_id") == 100).collect()
    assert {r.vec_id for r in found} == {1}


def test_units_sorted_in_any_batches():
    r, rows = random.Random(5), set()
    for _ in range(300):
        rows.add((r.randrange(12), r.randrange(3), r.randrange(4), r.randrange(3) << 8))
    rows = sorted(rows)
    heads, names = {}, {}
    for m, n, d, p in rows:
        heads.setdefault((m, n), (d, p))
        names.setdefault(m, set()).add(n)
    want = sorted([(d, p, True) for m, n, d, p in rows if heads[m, n] != (d, p)] + [(*h, False) for (m, _), h in heads.items() if len(names[m]) > 1])
    for size in (1, 2, 7, 1000):
        batches = [pa.RecordBatch.from_pydict({"mark": [x[0] for x in b], "name": [x[1] for x in b], "doc_id": [x[2] for x in b], "place": [x[3] for x in b], "done": [False] * len(b)}) for b in (rows[i : i + size] for i in range(0, len(rows), size))]
        got = sorted((d, p, z) for out in repeats._settle(iter(batches)) for d, p, z in zip(*(out.column(c).to_pylist() for c in ("doc_id", "place", "repeated")), strict=True))
        assert got == want


def test_texts_in_parts():
    text = "one two  three\nfour\tfive six " * 50
    for size in (1, 5, 40, 10_000):
        parts = list(toxicity.word_parts(text, size))
        assert [w for words, a, b in parts for w in words[a:b]] == text.split()
    batch = pa.RecordBatch.from_pydict({"t": ["a" * 10, None, "b" * 30, "", "c"]})
    assert pa.concat_batches(list(sliced(batch, "t", size=11))) == batch and [x.num_rows for x in sliced(batch, "t", size=11)] == [2, 1, 2]


def test_other_tokenizers_encode_whole_texts():
    import public_tokenizers

    other, own = word_ids(public_tokenizers.path("byte_bpe_50k.json")), word_ids(default_tokenizer())
    assert own.by_words and not other.by_words
    for text in ("Two  Words\nand don't", " lead", "é" * 5, ""):
        assert np.frombuffer(other.encode(text), "<u4").tolist() == other.tokenizer.encode(text, add_special_tokens=False).ids
    long = "some words of text " * 120_000
    assert np.frombuffer(own.encode(long), "<u4").tolist() == own.tokenizer.encode(long, add_special_tokens=False).ids


def test_words_with_marks_have_the_librarys_ids():
    from tokenizers import Tokenizer

    from sightline.llm.tokens import default_tokenizer, word_ids

    said = ["don't STOP.", "x.y, z! ?", "l'été Étude.", "naïve…", "1,2 3.", "a\tb", "\x00q\x7f", "<|endoftext|> z", "ﬁn é", "İstanbul.", "ß.", "a!!", ".", "it's.", "ab's,", "²", "ª.", "ſ.", "日本。", "x​z.", " \n", ""]
    tokenizer, words = Tokenizer.from_file(default_tokenizer()), word_ids(default_tokenizer())
    for text in said:
        assert np.frombuffer(words.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_neighbours_without_a_query_row(spark, tmp_path):
    rows = spark.createDataFrame([(1, [0.5, 1.0], 0), (2, [1.0, 0.5], 0), (None, [1.0, 1.0], 0), (100, None, 0)], "vec_id long, embedding array<float>, label int")
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    out = tree_search.query(spark, str(tmp_path))
    assert out.count() == 0 and out.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]


def test_licences_are_those_of_their_sql(spark, tmp_path):
    """Wrapped headers, holders and years, several statements, licence files: the SQL states the operator's rule."""
    import duckdb

    from sightline.llm import licenses, oracles

    t = licenses.TEMPLATES
    own = ["plain words about nothing", "more of the same here", "and a third line"]
    wrapped = "\n".join(["# " + x for x in ("Licensed under the Apache", "License, Version", "2.0.")])
    texts = [
        wrapped, "Copyright 2021 Acme.\n" + t["Apache-2.0"], "\n".join([*own, "", "/* " + t["MIT"][:60], t["MIT"][60:] + " */", "", *own]), t["MIT"] + "\n\n" + t["BSD-3-Clause"], t["Proprietary"] + " 2020 Some Holder Ltd.",
        "\n".join([t["GPL-3.0"], "All rights reserved."]), None, "", "license", "a license of no kind that we know of", "\n".join([*own, t["CC-BY-4.0"], *own]), "\n\n".join([t["CC0-1.0"], *own * 9]),
        "\n".join(["Redistribution and use in source", "and binary forms, with or", "without modification, are", "permitted under the BSD", "license.", "", "x"]), "cc by\n\n\nlicensed under", t["LGPL-3.0"].upper(), "All\nrights\nreserved",
        "Released under the MIT License. See the LICENSE file. " + " ".join(own), "\n".join(["copyright notice", t["MPL-2.0"], "copyright 2019", t["MPL-2.0"]]),
    ]
    rows = [(i, x, "en", f"s{i % 5}", 0) for i, x in enumerate(texts * 2)] + [(100 + i, "nothing to see", "de" if i % 2 else "en", f"s{i % 6}", 0) for i in range(30)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(oracles.ORACLES["op7_license_scan"])
    got = sorted(map(tuple, licenses.query(spark, str(tmp_path)).select(*want.columns).collect()), key=repr)
    assert got == sorted(want.fetchall(), key=repr) and len({r[want.columns.index("license")] for r in got}) >= 8
