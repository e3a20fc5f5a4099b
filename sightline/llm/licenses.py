"""Operator 7: licence scan by TF-IDF cosine to templates, and inheritance along paths.

A block is a run of lines that have words: a paragraph, a header's comment. In blocks that
name a licensing term each line, each run of neighbouring lines of up to ``RUN_LENGTHS``
times the longest template's words and the whole block are compared with each template,
and so is the whole text: sparse TF-IDF vectors of words, cosine. So a statement wrapped
over lines is compared as a whole. Of those at or over ``LEAST_COSINE`` that overlap the
one with the highest cosine counts; the best gives the file its own licence. A file whose
lines that count hold most of its words, or whose name
says so (LICENSE, COPYING ...), is a licence file and speaks for its directory. Other
files take the licence of the nearest directory above them that has one: each directory
is joined with its ancestors by path, and the deepest with a licence wins.

Document frequencies of the templates' words are counted over all documents; a word of
no template (a year, a holder's name) weighs as much as the words of the template that it
is compared with do on average. So the cosine of a line doesn't fall as the table grows.

Scale: texts without a licensing term end in the scan; the others are scored where they
lie, nothing of them is shuffled but a row for each that has a licence. Only the
templates' words and their frequencies, a few hundred rows, are sent along. Ancestors are resolved once for each
directory, not for each file, so a directory that a third of all files are in is one row.

Defined cases: a null or empty text has no licence of its own and may inherit one; ties
between templates go to the higher cosine, then the first name; ties between licence
files of a directory to the first path; a null path inherits nothing; repeated rows are
scanned each; an empty table gives no rows; extra columns don't matter.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.llm.batches import lean
from sightline.llm.store import saved

# Usual short statements of public licences.
TEMPLATES = {
    "MIT": "Released under the MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software.",
    "MIT-short": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "Licensed under the GNU Lesser General Public License, version 3.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD license.",
    "MPL-2.0": "This file is subject to the terms of the Mozilla Public License, version 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0.",
    "Proprietary": "All rights reserved.",
}
#: A block without any of these holds no licence line.
TERMS = r"licen[sc]e|copyright|all rights reserved|public domain|\bcc0\b|\bcc by"
#: The same where a line break or a comment mark stands between the words.
WRAPPED_TERMS = TERMS.replace(" ", "[^a-z0-9]+")
LEAST_COSINE = 0.6
#: Runs of lines of more words than so many times the longest template can't reach the cosine without repeating it.
RUN_LENGTHS = 3
#: A file is a licence file if its licence lines hold this share of its words.
FILE_SHARE = 0.5
_WORD = r"[a-z0-9][a-z0-9.+-]*[a-z0-9]|[a-z0-9]"
_FILE_NAME = r"(?i)(^|/)(licen[sc]e|copying|notice)(\.[a-z]+)?$"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({_WORD})"))


class Statements:
    """Templates as vectors, and the weights of words."""

    def __init__(self, templates: dict[str, str], n: int, found: dict[str, int]):
        counts = {name: Counter(words_of(said)) for name, said in templates.items()}
        self.weights = {w: math.log((n + 1) / (found.get(w, 0) + 1)) + 1 for w in sorted(set().union(*counts.values()))}
        self.most_words = RUN_LENGTHS * max((c.total() for c in counts.values()), default=0)
        # of a word of no template, beside each template: the mean of the template's words
        self.other = {name: math.fsum(self.weights[w] for w in count) / len(count) for name, count in counts.items() if count}
        self.least_other = min(self.other.values(), default=1.0)
        self.vectors = {}
        for name in sorted(self.other):
            norm = math.sqrt(math.fsum((k * self.weights[w]) ** 2 for w, k in counts[name].items()))
            self.vectors[name] = {w: k * self.weights[w] / norm for w, k in counts[name].items()}

    def best(self, tf: dict[str, int], known: float, others: int) -> tuple[float, str] | None:
        """Cosine (negative) and name of the nearest template at or over the least cosine.

        ``known`` and ``others``: sum of squares of the words of templates, and of the counts of other words.
        """
        words = [(w, k * self.weights[w]) for w, k in tf.items() if w in self.weights]
        found = []
        for name, vector in self.vectors.items():
            norm = math.sqrt(known + others * self.other[name] ** 2)
            found.append((-round(math.fsum(x * vector[w] for w, x in words if w in vector) / norm, 9), name))
        return min((x for x in found if x[0] <= -LEAST_COSINE), default=None)

    def runs(self, lines: list[list[str]], begin: int, end: int, most: int | None) -> Iterator[tuple[float, str, int, int]]:
        """(-cosine, template, number of lines, first line) of runs that begin with line ``begin``; of the one that ends at ``end`` where ``most`` is None.

        A run that ends with a line without words of templates is less than the run without that line.
        """
        tf: dict[str, int] = {}
        total, known, others, least = 0, 0.0, 0, LEAST_COSINE * LEAST_COSINE * (1 - 1e-9)
        for k in range(begin, end):
            total += len(lines[k])
            if most is not None and k > begin and total > most:
                return
            grown = False
            for word in lines[k]:
                had, weight = tf.get(word, 0), self.weights.get(word)
                tf[word] = had + 1
                if weight is None:
                    others += 2 * had + 1
                else:
                    known += (2 * had + 1) * weight * weight
                    grown = True
            if (grown and most is not None or k == end - 1) and known >= least * (known + others * self.least_other**2) > 0 and (top := self.best(tf, known, others)):
                yield *top, k + 1 - begin, begin

    def licence(self, text: str) -> tuple[str, float, bool] | None:
        """Licence and cosine of a text, and whether lines of licences hold most of it."""
        said = text.split("\n")
        lines = [words_of(x) for x in said]
        found, begin, named = [], 0, False
        while begin < len(lines):
            end = begin + 1
            if lines[begin]:
                while end < len(lines) and lines[end]:
                    end += 1
                if _HAS_TERM.search("\n".join(said[begin:end]).lower()):
                    named = True
                    for k in range(begin, end):
                        if not self.weights.keys().isdisjoint(lines[k]):
                            found += self.runs(lines, k, end, self.most_words)
                    found += self.runs(lines, begin, end, None)
            begin = end
        if named:
            found += self.runs(lines, 0, len(lines), None)
        taken, kept = set(), []
        for less, name, n, first in sorted(found):
            if taken.isdisjoint(range(first, first + n)):
                taken.update(range(first, first + n))
                kept.append((less, name))
        if not kept:
            return None
        return kept[0][1], -kept[0][0], sum(len(lines[k]) for k in taken) >= FILE_SHARE * sum(map(len, lines))


_HAS_TERM = re.compile(WRAPPED_TERMS)
_WORDS = re.compile(_WORD)


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def _own(batches: Iterator[pa.RecordBatch], statements: Statements) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [statements.licence(t.as_py()) for t in batch.column("text")]
        some = [x for x in found if x]
        columns = zip(*some, strict=True) if some else ((), (), ())
        made = dict(zip(("name", "cosine", "is_file"), (pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.bool_()), strict=True)), strict=True))
        kept = batch.filter(pa.array([x is not None for x in found], pa.bool_()))
        yield pa.RecordBatch.from_pydict({"k": kept.column("k"), "path": kept.column("path")} | made)


def scan(files: DataFrame, *, templates: dict[str, str] | None = None, key: str = "doc_id", path: str = "path", text: str = "text") -> DataFrame:
    """``key``, ``path``, ``license`` and its ``source``: own, directory (inherited) or none, with ``cosine`` and ``from_dir``."""
    spark = files.sparkSession
    files = files.select(F.col(key).alias("k"), F.col(path).alias("path"), F.col(text).alias("text"))
    templates = templates or TEMPLATES
    vocabulary = sorted({w for said in templates.values() for w in words_of(said)})
    # rows (as the empty word) and document frequencies, over all documents
    counts = files.select(F.array_append(F.array_intersect(_words(F.coalesce("text", F.lit(""))), F.array(*map(F.lit, vocabulary))), "").alias("w"))
    found = {r["word"]: r["df"] for r in counts.select(F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("df")).collect()}  # at most a row per template word
    held = spark.sparkContext.broadcast(Statements(templates, found.pop("", 0), found))

    schema = T.StructType([files.schema["k"], files.schema["path"], *(T.StructField(name, t) for name, t in (("name", T.StringType()), ("cosine", T.DoubleType()), ("is_file", T.BooleanType())))])
    own = files.filter(F.lower("text").rlike(WRAPPED_TERMS)).mapInArrow(lean(lambda batches: _own(batches, held.value)), schema)
    own = saved(own, "licences").groupBy("k", "path").agg(F.min(F.struct((-F.col("cosine")).alias("less"), "name")).alias("top"), F.max("is_file").alias("is_file"))
    own = own.select("k", "path", F.regexp_replace("top.name", "-short$", "").alias("license"), (-F.col("top.less")).alias("cosine"), "is_file")

    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    speaking = own.filter(F.col("path").isNotNull() & (F.col("is_file") | F.col("path").rlike(_FILE_NAME)))
    speaking = speaking.withColumn("dir", folder).groupBy("dir").agg(F.min(F.struct("path", "license")).alias("first")).select("dir", F.col("first.license").alias("dir_license"))
    dirs = files.filter("path is not null").select(folder.alias("dir")).distinct()
    depth = F.size(F.split("dir", "/"))
    above = dirs.select("dir", F.explode(F.sequence(F.lit(0), depth)).alias("depth")).select("dir", "depth", F.when(F.col("depth") == 0, F.lit("")).otherwise(F.expr("substring_index(dir, '/', depth)")).alias("ancestor"))
    resolved = above.join(speaking.withColumnRenamed("dir", "ancestor"), "ancestor").groupBy("dir").agg(F.max(F.struct("depth", "ancestor", "dir_license")).alias("nearest"))
    resolved = resolved.select("dir", F.col("nearest.ancestor").alias("from_dir"), F.col("nearest.dir_license").alias("dir_license"))

    merged = files.select("k", "path", folder.alias("dir")).join(own.select(F.col("k").alias("k2"), F.col("path").alias("p"), "license", "cosine"), (F.col("k") == F.col("k2")) & F.col("path").eqNullSafe(F.col("p")), "left")
    merged = merged.join(resolved, "dir", "left")
    source = F.when(F.col("license").isNotNull(), "own").when(F.col("dir_license").isNotNull(), "directory").otherwise("none")
    return merged.select(
        F.col("k").alias(key), F.col("path").alias(path), F.coalesce("license", "dir_license").alias("license"), source.alias("source"),
        "cosine", F.when(source == "directory", F.col("from_dir")).alias("from_dir"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: the licence of every document; its path is made of source, language and id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs.withColumn("path", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))))
