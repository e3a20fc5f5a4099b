"""Operator 8: line deduplication by winnowing.

Lines are compared without white space around them; lines that are then empty match
nothing and are skipped over. Hashes of ``GRAM`` neighbouring lines are taken along a
document, and of each ``WINDOW`` neighbouring such hashes the least is kept (of equal
ones the rightmost): its fingerprints. Any run of ``GRAM + WINDOW - 1`` lines that two places share
gives both the same fingerprint there. (With three lines as the least run that counts, 2 and 2
are the only numbers that keep this promise and still leave a line out.)

Spark counts fingerprints and keeps the places of repeated ones. A place of a fingerprint is
seen with the lines around it, as the runs of ``least_lines`` that hold it, and joined to the earliest
place (smallest document, then line) with the same run. Each such pair of places is then
extended both ways: pairs of the same two documents at the same distance that overlap or
touch become one match, as far as the lines agree (``matches``). The later place of each match goes.

With ``least_words``, shorter runs count as well: one line, or up to ``least_lines - 1``
neighbouring ones, that together hold so many words. Each such run is a fingerprint of its
own, and its earliest place stays in the same way. What goes always stands at an earlier
place, so of each repeated line its first place is left. Without it (as in op8, whose SQL
says three lines) only runs of ``least_lines`` count. Document ids and line numbers decide, so the result doesn't depend on the order of rows.

Scale: fingerprints and runs are aggregated before each shuffle. Of a run within a
batch only the earliest place is sent on, so a run that a third of all documents hold is
a row per batch. Nothing is paired with anything but the earliest place of its run. A
fingerprint of 64 bits only proposes; runs are the same if 128 bits of hash are.

Defined cases: a null or empty text, or one with fewer lines than ``least_lines`` (and
fewer words than ``least_words``), stays as it is; rows without an id stay too; repeated rows with the same id and text count as one place and stay both; an
empty table stays empty; extra columns are passed through, whatever their names. A document whose lines all go
has an empty text; ``drop_emptied`` removes it. Texts are never split between tasks: one of n bytes takes
some 8 n bytes in a worker.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.llm.batches import lean
from sightline.llm.store import drop, saved
from sightline.llm.textbytes import buffers, byte_set, fresh_name, hashes, mixed, pieces, replaced, sliced

GRAM, WINDOW = 2, 2
LEAST_LINES = GRAM + WINDOW - 1
#: Words from which a run of fewer lines counts in the pipeline.
LEAST_WORDS = 50
#: Numbers up to which a table of line numbers is broadcast instead of joined by a shuffle: 16 MB.
BROADCAST_NUMBERS = 2_000_000
_BLANK = byte_set((0x20, 0x20), (0x09, 0x0D))
_A, _B = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


def line_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash (two of 64 bits), text and number of words of each line that isn't blank."""
    n = len(raw)
    breaks = raw == 10
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    begin = edge[:-1].copy()
    begin[1:] |= breaks[:-1]
    begin = np.flatnonzero(begin)
    end = np.r_[begin[1:], n] if len(begin) else begin
    ink = ~_BLANK[raw]
    inked = np.flatnonzero(ink)
    first, last = np.searchsorted(inked, begin), np.searchsorted(inked, end) - 1
    text = np.searchsorted(offsets, begin, side="right") - 1
    full = last >= first
    a, b = inked[first[full]], inked[last[full]] + 1
    # a line's first word begins at a, where the text before it may end without white space
    begun = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(ink[1:] & ~ink[:-1], out=begun[2:])
    return hashes(raw, a, b, wide=True), text[full], begun[b] - begun[a + 1] + 1


def _runs(lines: np.ndarray, size: int) -> np.ndarray:
    """Hash of each ``size`` neighbouring lines."""
    out = lines
    for k in range(1, size):
        out = mixed(out[:-1] * _A + mixed(lines[k:] ^ _B)) if len(out) > 1 else out[:0]
    return out


def fingerprints(lines: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Winnowed places (of a gram's first line) and their hashes."""
    grams = _runs(lines, GRAM)
    n = len(grams) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64), grams[:0]
    windows = np.lib.stride_tricks.sliding_window_view(grams, WINDOW)
    least = np.arange(n) + WINDOW - 1 - np.argmin(windows[:, ::-1], axis=1)
    whole = text[:n] == text[GRAM + WINDOW - 2 : GRAM + WINDOW - 2 + n]
    at = np.unique(least[whole])
    return at, grams[at]


def _lines_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for row, _, raw, offsets in pieces(*buffers(batch.column("text"))):
        lines, text, words = line_hashes(raw, offsets)
        yield lines, row + text, words


_FOUND = "print long, run long, run2 long, doc_id long, line long, place long, size int, done boolean, from_doc long, from_line long"


def _candidates(batches: Iterator[pa.RecordBatch], least: int, least_words: int | None) -> Iterator[pa.RecordBatch]:
    """For each fingerprint the runs of ``least`` lines that hold its lines, and shorter runs of ``least_words`` words.

    Of a run within the batch its earliest place goes on; later ones are done, and paired with that.
    """
    for batch in batches:
        ids, found = batch.column("doc_id").to_numpy(), []
        for lines, text, words in _lines_of(batch):
            runs, (at, prints) = _runs(lines, least), fingerprints(lines[:, 0], text)
            begin = np.searchsorted(text, text)
            for back in range(least - GRAM + 1):
                start = at - back
                whole = (start >= 0) & (start < len(runs))
                whole[whole] = (text[start[whole]] == text[at[whole]]) & (text[start[whole] + least - 1] == text[at[whole]])
                start, print_, place = start[whole], prints[whole], at[whole]
                found.append((print_, runs[start], ids[text[start]], start - begin[start], place - begin[place], np.full(len(start), least)))
            sums = np.r_[0, np.cumsum(words)]
            for size in range(1, least if least_words is not None else 1):
                runs = _runs(lines, size)
                start = np.arange(len(runs))
                start = start[(text[start] == text[start + size - 1]) & (sums[start + size] - sums[start] >= least_words)]
                line = start - begin[start]
                found.append((mixed(runs[start, 0] ^ _B), runs[start], ids[text[start]], line, line, np.full(len(start), size)))
        if not found:
            continue
        print_, run, doc, line, place, size = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((line, doc, run[:, 1], run[:, 0], print_))
        print_, run, doc, line, place, size = (x[order] for x in (print_, run, doc, line, place, size))
        first = np.ones(len(run), dtype=bool)
        first[1:] = (run[1:] != run[:-1]).any(axis=1) | (print_[1:] != print_[:-1])
        head = np.flatnonzero(first)[np.cumsum(first) - 1] if len(run) else order
        later = (doc != doc[head]) | (line != line[head])
        keep = first | later
        columns = {
            "print": print_.view(np.int64), "run": run[:, 0].copy().view(np.int64), "run2": run[:, 1].copy().view(np.int64), "doc_id": doc, "line": line.astype(np.int64), "place": place.astype(np.int64),
            "size": size.astype(np.int32), "done": later, "from_doc": doc[head], "from_line": line[head].astype(np.int64),
        }
        yield pa.RecordBatch.from_pydict({n: x[keep] for n, x in columns.items()})


def matches(docs: DataFrame, *, least_lines: int = LEAST_LINES, least_words: int | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Later places of repeated runs: ``doc_id``, first ``line`` (among lines that aren't blank), ``n_lines``, and the earlier place, ``from_doc`` and ``from_line``.

    A match goes as far both ways as the two places agree in runs that count.
    """
    return _matches(docs, least_lines, least_words, text, doc_id)[0]


def _matches(docs: DataFrame, least_lines: int, least_words: int | None, text: str, doc_id: str) -> tuple[DataFrame, list[DataFrame]]:
    """The matches, and the tables that they are read from."""
    if least_lines < LEAST_LINES:
        raise ValueError(f"winnowing guarantees runs of {LEAST_LINES} lines or more")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null and text is not null")
    found = saved(rows.mapInArrow(lean(lambda batches: _candidates(batches, least_lines, least_words)), _FOUND), "line-prints")
    at = F.struct("doc_id", "place")
    prints = found.groupBy("print").agg(F.min(at).alias("low"), F.max(at).alias("high")).filter("low <> high").select("print")
    matched = found.filter("not done").join(prints, "print").select("run", "run2", "doc_id", "line", "size")
    matched = saved(matched.distinct(), "line-runs")
    earliest = matched.groupBy("run", "run2").agg(F.min(F.struct("doc_id", "line")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("run", "run2", F.col("first.doc_id").alias("from_doc"), F.col("first.line").alias("from_line"))
    later = matched.join(earliest, ["run", "run2"]).filter("doc_id <> from_doc or line <> from_line")
    place = ("doc_id", "line", "size", "from_doc", "from_line")
    pairs = later.select(*place).unionByName(found.filter("done").select(*place))
    # extension both ways: overlapping or touching pairs of two documents at the same distance
    along = Window.partitionBy("doc_id", "from_doc", "distance").orderBy("line", "size")
    pairs = pairs.withColumn("distance", F.col("line") - F.col("from_line")).withColumn("before", F.max(F.col("line") + F.col("size")).over(along.rowsBetween(Window.unboundedPreceding, -1)))
    pairs = pairs.withColumn("match", F.sum(F.when(F.col("line") <= F.col("before"), 0).otherwise(1)).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    whole = pairs.groupBy("doc_id", "from_doc", "distance", "match").agg(F.min("line").alias("line"), F.max(F.col("line") + F.col("size")).alias("end"))
    whole = whole.select("doc_id", "line", (F.col("end") - F.col("line")).alias("n_lines"), "from_doc", (F.col("line") - F.col("distance")).alias("from_line"))
    return whole, [found, matched]


def _without(text: str, runs: list[dict]) -> tuple[str, int]:
    """A text without the given runs of its lines that aren't blank, and how many lines went."""
    lines = text.split("\n")
    inked = [k for k, line in enumerate(lines) if line.strip(" \t\n\v\f\r")]
    gone = {inked[j] for run in runs for j in range(run["line"], min(run["line"] + run["n_lines"], len(inked)))}
    return "\n".join(line for k, line in enumerate(lines) if k not in gone), len(gone)


def _cut(batches: Iterator[pa.RecordBatch], columns: list[str], text: str, chars: str | None, drop_emptied: bool, count: str | None, runs: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in sliced(batch, text):
            said, found = part.column(text), part.column(runs)
            changed = np.flatnonzero((found.is_valid().to_numpy(zero_copy_only=False)) & said.is_valid().to_numpy(zero_copy_only=False))
            cut = [_without(said[i].as_py(), found[i].as_py()) for i in changed.tolist()]
            made = {text: replaced(said, changed, [t for t, _ in cut])}
            if chars:
                made[chars] = replaced(part.column(chars), changed, [len(t) for t, _ in cut])
            if count:
                made[count] = replaced(pa.array(np.zeros(part.num_rows, np.int64)), changed, [n for _, n in cut])
            out = pa.RecordBatch.from_pydict({n: made[n] if n in made else part.column(n) for n in columns})
            keep = np.ones(part.num_rows, dtype=bool)
            if drop_emptied:
                keep[changed] = [bool(t.strip()) for t, _ in cut]
            yield out if keep.all() else out.filter(pa.array(keep))


def remove_repeated_lines(docs: DataFrame, *, least_lines: int = LEAST_LINES, least_words: int | None = None, text: str = "text", doc_id: str = "doc_id", chars: str | None = "n_chars", drop_emptied: bool = False, count: bool = False) -> DataFrame:
    """``docs`` without the later ones of repeated runs of lines; with ``count``, and ``n_removed`` lines (a column of that name is replaced)."""
    found, tables = _matches(docs, least_lines, least_words, text, doc_id)
    doc, runs = fresh_name("__doc", docs.columns), fresh_name("__runs", docs.columns)
    found = found.groupBy(F.col("doc_id").alias(doc)).agg(F.sort_array(F.collect_set(F.struct("line", "n_lines"))).alias(runs))
    found = saved(found, "line-cuts")
    for table in tables:
        drop(table)
    n = found.agg(F.coalesce(F.sum(F.size(runs) + 1), F.lit(0))).first()[0]
    joined = docs.join(F.broadcast(found) if n <= BROADCAST_NUMBERS else found, docs[doc_id].cast("long") == found[doc], "left").drop(doc)
    chars = chars if chars in docs.columns and docs.schema[chars].dataType == T.LongType() else None
    schema = [docs.schema[c] for c in docs.columns if not (count and c == "n_removed")] + ([T.StructField("n_removed", T.LongType())] if count else [])
    columns = [field.name for field in schema]
    return joined.mapInArrow(lean(lambda batches: _cut(batches, columns, text, chars, drop_emptied, "n_removed" if count else None, runs)), T.StructType(schema))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: lines of each document before and after, and the text that is left as a checksum."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    n_lines = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: ~x.rlike(r"^[ \t\n\x0B\f\r]*$"))).cast("long")
    cut = remove_repeated_lines(docs.withColumn("n_lines", n_lines), count=True)
    return cut.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
