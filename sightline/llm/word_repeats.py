"""Operator 13: removal of runs of words that stand in several places, by seed and extend.

Seeds: the hashes of ``SEED`` neighbouring words are taken along a document, and the least of those within each
window of ``LENGTH`` words is the window's anchor. Neighbouring windows with the same anchor
are one seed: its anchor, extended as far both ways as a window with that anchor can reach. Equal windows have equal
anchors in the same place, so only places with the same anchor can share a window.

1. Places are joined on anchors: seeds whose anchor stands nowhere else are dropped.
2. Anchors are extended both ways in one step: seeds equal in all words they reach are repeated as a whole.
3. Where an anchor has unlike seeds, one place of each is extended anew, by every number of words to the left and the
   rest of ``LENGTH`` to the right; windows that stand in two places are repeated.

Repeated windows that overlap or touch become one maximal repeat. All its places are found, the first too.

Scale: a word in about fifteen is a seed. Nothing is paired with the places of its group: groups are
aggregated to their least and greatest place, and places are joined to these rows, one a group, so Spark can split a
hot one. Of equal seeds in a batch only the first goes on to a shuffle; the others are known to be repeated, whatever
else there is. So a text that a third of all documents hold is a row a seed and batch. Identity is that of
two hashes of 64 bits each. Spans meet their texts by a join on the document.

Defined cases: a null text has no words; a text of fewer than ``LENGTH`` words loses nothing; rows that repeat an id with the same text are one
place and get the same result (an id with several texts isn't one document: give rows ids of their own); rows without an id
stay as they are and repeat nothing; an empty table gives no rows; extra columns are passed through, those named as an
output are replaced. A text is never split: one of n bytes takes some 20 n bytes in a worker.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.llm.batches import lean
from sightline.llm.store import drop, saved
from sightline.llm.textbytes import NOT_SPACE, Words, buffers, fresh_name, mixed, pieces, sliced

#: Words of a window, and of an anchor.
LENGTH, SEED = 35, 8
#: Numbers up to which a table of spans is broadcast instead of joined by a shuffle: 16 MB.
BROADCAST_SPANS = 2_000_000
OUTPUTS = [T.StructField("kept", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]

_A, _B = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x9E6C63D0876A9A47)
_SEEDS = "anchor long, one long, two long, doc_id long, start int, windows int, again boolean, done boolean"


def _runs(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each ``size`` neighbouring words: of two runs of the greatest power of two that fits, which may overlap."""
    out, reach = words, 1
    while reach * 2 <= size and len(out) > reach:
        out = mixed(out[:-reach] * _A + mixed(out[reach:] ^ _B))
        reach *= 2
    rest = size - reach
    if reach * 2 <= size or len(out) <= rest:
        return out[:0]
    return mixed(out[: len(out) - rest] * _B + out[rest:]) if rest else out


def seeds(words: np.ndarray, first: np.ndarray, length: int = LENGTH, size: int = SEED) -> tuple[np.ndarray, ...]:
    """Anchor, two hashes, text, first word in it, and windows of each seed of a run of texts; ``words`` has two hashes a word.

    Texts may be shorter than a window; no window goes from one into the next.
    """
    grams = length - size + 1  # in a window
    n = len(words) - length + 1
    whole = np.zeros(max(n, 0), dtype=bool)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        whole[a : max(a, b - length + 1)] = True
    if not whole.any():
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none.view(np.uint64), none.view(np.uint64), none, none, none
    anchors = _runs(words[:, 0], size)
    here = (np.uint64(1) << np.uint64(len(words).bit_length())) - np.uint64(1)
    least, reach = (anchors & ~here) | np.arange(len(anchors), dtype=np.uint64), 1
    while reach * 2 <= grams:  # minima over windows
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    least = np.minimum(least[: len(least) - (grams - reach)], least[grams - reach :])
    at = (least & here).astype(np.int64)[:n]
    fresh, last = whole.copy(), whole.copy()
    fresh[1:] &= ~whole[:-1] | (at[1:] != at[:-1])
    last[:-1] &= ~whole[1:] | (at[1:] != at[:-1])
    start, end = np.flatnonzero(fresh), np.flatnonzero(last)
    windows = end - start + 1
    ends = []
    for k in (0, 1):  # all words from the first window's first to the last one's last
        x = _runs(words[:, k], length)
        ends.append(mixed(mixed(x[start] * _A + x[end]) + windows.astype(np.uint64) * _B + (at[start] - start).astype(np.uint64)))
    text = np.searchsorted(first, start, side="right") - 1
    return anchors[at[start]], *ends, text, start - first[text], windows


def _rows_of(anchor: np.ndarray, one: np.ndarray, two: np.ndarray, doc: np.ndarray, start: np.ndarray, windows: np.ndarray) -> pa.RecordBatch:
    """Of equal seeds the first, with ``again`` if it has others; those are ``done``. A place that is there twice counts once."""
    order = np.lexsort((start, doc, two, one))
    one, two, doc, start = one[order], two[order], doc[order], start[order]
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    new = fresh.copy()  # places
    new[1:] |= (doc[1:] != doc[:-1]) | (start[1:] != start[:-1])
    again = np.add.reduceat(new, np.flatnonzero(fresh))[np.cumsum(fresh) - 1] > 1 if len(order) else fresh
    columns = {"anchor": anchor[order].view(np.int64), "one": one.view(np.int64), "two": two.view(np.int64), "doc_id": doc, "start": start.astype(np.int32), "windows": windows[order].astype(np.int32), "again": again, "done": ~fresh}
    return pa.RecordBatch.from_pydict({n: x[new] for n, x in columns.items()})


def _words(column: pa.Array) -> Iterator[tuple[int, Words]]:
    for row, _, raw, offsets in pieces(*buffers(column)):
        yield row, Words(raw, offsets, NOT_SPACE, fold=False, wide=True)


def _seeds(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, found = batch.column("doc_id").to_numpy(), []
        for row, words in _words(batch.column("text")):
            anchor, one, two, text, start, windows = seeds(words.hash, words.first, length)
            found.append((anchor, one, two, ids[row + text], start, windows))
        if found:
            yield _rows_of(*(np.concatenate(x) for x in zip(*found, strict=True)))


def _windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """A row for each window of the given seeds (``places``: first word and number of windows in turn) of a text."""
    for batch in batches:
        ids, places, found = batch.column("doc_id").to_numpy(), batch.column("places").to_pylist(), []
        for row, words in _words(batch.column("text")):
            one, two = (_runs(words.hash[:, k], length) for k in (0, 1))
            for i in range(len(words.first) - 1):
                flat = np.array(places[row + i], dtype=np.int64).reshape(-1, 2)
                start = np.unique(np.repeat(flat[:, 0] - np.r_[0, np.cumsum(flat[:-1, 1])], flat[:, 1]) + np.arange(flat[:, 1].sum()))
                start = start[start + length <= words.first[i + 1] - words.first[i]]
                at = words.first[i] + start
                found.append((one[at], one[at], two[at], np.full(len(at), ids[row + i]), start, np.ones(len(at), np.int64)))
        if found:
            yield _rows_of(*(np.concatenate(x) for x in zip(*found, strict=True)))


def _several(rows: DataFrame, *key: str) -> DataFrame:
    """The keys that stand in several places, with the least of these."""
    place = F.struct("doc_id", "start", "windows")
    groups = rows.groupBy(*key).agg(F.min(place).alias("low"), F.max(place).alias("high"), F.max("again").alias("again"))
    return groups.withColumn("several", F.col("again") | (F.col("low.doc_id") != F.col("high.doc_id")) | (F.col("low.start") != F.col("high.start")))


def _with_texts(docs: DataFrame, found: DataFrame, items: int, doc: str = "doc_id", how: str = "inner") -> DataFrame:
    """``found``, a row per document, joined to texts: broadcast where its size allows, else by a shuffle."""
    return docs.join(F.broadcast(found) if items <= BROADCAST_SPANS else found, doc, how)


_PLACE = ("doc_id", "start", "windows")


def _repeated_windows(docs: DataFrame, length: int) -> tuple[DataFrame, list[DataFrame]]:
    """``doc_id``, ``start`` and ``windows``: runs of windows from a word on, each of which stands somewhere else too; and the tables behind it."""
    found = saved(docs.mapInArrow(lean(lambda batches: _seeds(batches, length)), _SEEDS), "seeds")
    spans = [found.filter("done").select(*_PLACE)]
    # 1: places joined on anchors
    alone = found.filter("not done").drop("done")
    # keys are written before a join, so that it is one of two plain exchanges, of which Spark splits a hot part
    anchors = saved(_several(alone, "anchor").filter("several").select("anchor"), "anchors")
    joined = saved(alone.join(anchors, "anchor"), "anchored-seeds")
    # 2: extended both ways as a whole
    extended = saved(_several(joined, "anchor", "one", "two").select("anchor", "one", "two", "low", "several"), "extended-seeds")
    spans.append(joined.join(extended.filter("several").select("one", "two"), ["one", "two"]).select(*_PLACE))
    # 3: extended window by window where an anchor has unlike seeds
    unlike = saved(extended.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"), "unlike-anchors")
    places = extended.join(unlike, "anchor").select("low.doc_id", "low.start", "low.windows")
    by_doc = saved(places.groupBy("doc_id").agg(F.flatten(F.collect_list(F.array("start", "windows"))).alias("places")), "unlike-seeds")
    tables = [found, anchors, joined, extended, unlike, by_doc]
    items = _items(by_doc, "places")
    if items:
        windows = _with_texts(docs, by_doc, items).select("doc_id", "text", "places").mapInArrow(lean(lambda batches: _windows(batches, length)), _SEEDS)
        windows = saved(windows, "seed-windows")
        single = windows.filter("not done")
        repeated = saved(_several(single, "one", "two").filter("several").select("one", "two"), "repeated-windows")
        tables += [windows, repeated]
        spans += [windows.filter("done").select(*_PLACE), single.join(repeated, ["one", "two"]).select(*_PLACE)]
    return functools.reduce(DataFrame.unionByName, spans), tables


def _items(by_doc: DataFrame, column: str) -> int:
    return by_doc.agg(F.coalesce(F.sum(F.size(column) + 1), F.lit(0))).first()[0]


def _maximal(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """First word and word after the last of each maximal repeat of a document, in turn."""
    for batch in batches:
        out = []
        for places in batch.column("places").to_pylist():
            flat = np.array(places, dtype=np.int64).reshape(-1, 2)
            flat = flat[np.argsort(flat[:, 0], kind="stable")]
            start, end = flat[:, 0], np.maximum.accumulate(flat.sum(axis=1) + length - 1)
            begin = np.flatnonzero(np.r_[True, start[1:] > end[:-1]])
            out.append(np.c_[start[begin], end[np.r_[begin[1:], len(start)] - 1]].ravel().tolist())
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "repeats": pa.array(out, pa.list_(pa.int64()))})


def maximal_repeats(docs: DataFrame, *, length: int = LENGTH, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id`` and ``repeats``: first word and word after the last of each maximal run of repeated words, in turn."""
    if length < 2 * SEED:
        raise ValueError(f"windows have at least {2 * SEED} words")
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null and text is not null")
    places, tables = _repeated_windows(docs, length)
    by_doc = places.groupBy("doc_id").agg(F.flatten(F.collect_list(F.array("start", "windows"))).alias("places"))
    found = saved(by_doc.mapInArrow(lean(lambda batches: _maximal(batches, length)), "doc_id long, repeats array<long>"), "repeats")
    for table in tables:
        drop(table)
    return found


def _without(batches: Iterator[pa.RecordBatch], names: list[str], text: str, repeats: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in sliced(batch, text):
            spans, kept, total, removed = part.column(repeats).to_pylist(), [], [], []
            for row, said in enumerate(part.column(text)):
                words, at, left = (said.as_py() or "").encode().split(), 0, []  # bytes split at the same six characters
                cut = spans[row] or []
                for a, b in zip(cut[::2], cut[1::2], strict=True):
                    left += words[at:a]
                    at = b
                left += words[at:]
                kept.append(b" ".join(left).decode())
                total.append(len(words))
                removed.append(len(words) - len(left))
            made = {"kept": pa.array(kept, pa.string()), "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(removed, pa.int64())}
            yield pa.RecordBatch.from_pydict({n: made[n] if n in made else part.column(n) for n in names})


def without_repeats(docs: DataFrame, *, length: int = LENGTH, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with ``kept`` (the words that stay, joined by one space), ``n_words`` and ``n_removed``."""
    if {text, doc_id} & {f.name for f in OUTPUTS}:
        raise ValueError("text and id can't have the name of an output")
    found = maximal_repeats(docs, length=length, text=text, doc_id=doc_id)
    doc, repeats = fresh_name("__doc", docs.columns), fresh_name("__repeats", docs.columns)
    items = _items(found, "repeats")
    found = found.select(F.col("doc_id").alias(doc), F.col("repeats").alias(repeats))
    joined = _with_texts(docs.withColumn(doc, F.col(doc_id).cast("long")), found, items, doc, "left")
    schema = T.StructType([*(f for f in docs.schema if f.name not in {o.name for o in OUTPUTS}), *OUTPUTS])
    names = schema.names
    return joined.mapInArrow(lean(lambda batches: _without(batches, names, text, repeats)), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: words of each document, those removed, and what is left as a checksum."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return without_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
