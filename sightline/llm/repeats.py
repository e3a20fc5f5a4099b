"""Operator 10: removal of repeated byte strings by names that double in length.

Within each text, names of byte strings of length 1, 2, 4 ... 32 are made by prefix
doubling: the name at a position and that one length further give the name of twice the
length. Names are 64-bit fingerprints instead of dense ranks, so that no sort of all
positions is needed for each length. Of the names of length 32 in any window of
``LENGTH`` bytes the least marks the window; neighbouring windows with the same mark are
a unit. Equal windows have equal marks in the same place, so it is enough to compare
units of the same mark: Spark sorts the units by mark, drops unique ones, and reranks:

1. a unit with the same bytes as an earlier one is repeated as a whole;
2. of marks whose earliest units still differ, these units' bytes are sorted by mark
   again, and their windows are told apart by names of the full length. Windows of marks
   with very many different units are sorted by that name instead.

Scale: a position in about 35 takes part in a sort. Each batch first keeps only the
earliest of its equal units (the later ones are repeated, whatever else there is), so a
unit that a third of all documents have is a row per batch. Sorted groups are streamed,
never held as a whole. Spans go back to their texts by a join on the document.

Defined cases: a null or empty text is 0 bytes; texts under ``LENGTH`` bytes lose
nothing; rows that repeat an id with the same text count as one occurrence and get the
same spans; an empty table gives no rows; extra columns don't matter. Two different
strings would be taken as equal only if both their marks and their names, 64 bits each, are. A text is never split: one of n bytes takes some 40 n
bytes in a worker, in pieces of a quarter of a megabyte where texts are shorter than that.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.batches import lean
from sightline.llm.store import saved
from sightline.llm.textbytes import BYTE_VALUES, buffers, mixed, pieces

LENGTH, MARK = 100, 32
#: Numbers up to which a table of spans is broadcast instead of joined by a shuffle: 32 MB.
BROADCAST_SPANS = 4_000_000
#: Different units of one mark that are compared in one go.
HELD_UNITS = 5_000
_PIECE = 1 << 18
_A, _B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)

_ROWS = "mark long, name long, doc_id long, place long, done boolean"
_FOUND = "doc_id long, place long, repeated boolean"


def names(raw: np.ndarray) -> np.ndarray:
    """The name of the MARK bytes from each position on, by doubling."""
    x, size = BYTE_VALUES[raw], 1
    while size < MARK and len(x) > size:
        x = x[:-size] * _A + (x[size:] ^ (x[size:] >> np.uint64(29))) * _B
        size *= 2
    return x if size == MARK else x[:0]


def _mixed_names(x: np.ndarray, at: np.ndarray, steps: tuple[int, ...]) -> np.ndarray:
    out = np.zeros(len(at), dtype=np.uint64)
    for step in steps:
        out = mixed(out * _A + x[at + step])
    return out


def units(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Mark, name, text, start and length of each unit of a run of texts."""
    n, grams = len(raw), length - MARK + 1
    x = names(raw)
    if len(x) < grams:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    bits = np.uint64(int(n).bit_length())
    here = (np.uint64(1) << bits) - np.uint64(1)
    least = (mixed(x) & ~here) | np.arange(len(x), dtype=np.uint64)
    size = 1
    while size * 2 <= grams:  # minima over windows, by doubling too
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[: len(least) - (grams - size)], least[grams - size :])
    mark = (least & here).astype(np.int64)  # of the window that starts at each position
    valid = np.zeros(len(mark) + 2, dtype=bool)
    cover = np.zeros(n + 2, dtype=np.int32)
    long = np.diff(offsets) >= length
    np.add.at(cover, offsets[:-1][long], 1)
    np.add.at(cover, offsets[1:][long] - length + 1, -1)
    valid[1:-1] = np.cumsum(cover)[: len(mark)] > 0
    fresh = np.ones(len(mark) + 1, dtype=bool)
    fresh[1:-1] = mark[1:] != mark[:-1]
    start = np.flatnonzero(valid[1:-1] & (~valid[:-2] | fresh[:-1]))
    last = np.flatnonzero(valid[1:-1] & (~valid[2:] | fresh[1:]))
    end = last + length
    tail = length - MARK
    steps = (*range(0, tail, MARK), tail)
    name = _mixed_names(x, start, steps)
    name = mixed(name * _B + _mixed_names(x, end - tail, (*range(0, tail - MARK, MARK), tail - MARK)))
    name = mixed(name + (end - start).astype(np.uint64) * _A + (mark[start] - start).astype(np.uint64))
    text = np.searchsorted(offsets, start, side="right") - 1
    return mixed(x[mark[start]]), name, text, start - offsets[text], end - start


def _earliest(group: np.ndarray, name: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by group, name and place; which entries there begin a name; which come after the name's earliest."""
    order = np.lexsort((place, doc, name, group))
    g, k, d, p = group[order], name[order], doc[order], place[order]
    first = np.ones(len(order), dtype=bool)
    first[1:] = (g[1:] != g[:-1]) | (k[1:] != k[:-1])
    head = np.flatnonzero(first)[np.cumsum(first) - 1]
    return order, first, (d != d[head]) | (p >> 8 != p[head] >> 8)


def _rows_of(mark: np.ndarray, name: np.ndarray, doc: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """Rows for the sort; all but the earliest of each name are done: repeated."""
    order, first, later = _earliest(mark, name, doc, place)
    keep = first | later
    order, done = order[keep], later[keep]
    spread = np.where(done, mixed(doc[order].astype(np.uint64) ^ place[order].astype(np.uint64)), mark[order])
    return pa.RecordBatch.from_pydict({"mark": spread.view(np.int64), "name": name[order].view(np.int64), "doc_id": doc[order], "place": place[order], "done": done})


def _units(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, found = batch.column("doc_id").to_numpy(), []
        for row, _, raw, offsets in pieces(*buffers(batch.column("text")), _PIECE):
            mark, name, text, start, size = units(raw, offsets, length)
            found.append((mark, name, ids[row + text], start << 8 | size - length))
        if found:
            yield _rows_of(*(np.concatenate(x) for x in zip(*found, strict=True)))


def _windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows for each window of the given units of a text."""
    for batch in batches:
        name, doc, place = [], [], []
        for i, d in enumerate(batch.column("doc_id").to_pylist()):
            raw, _ = buffers(batch.column("text").slice(i, 1))
            x, at = names(raw), np.array(batch.column("places")[i].as_py(), dtype=np.int64)
            start = np.unique(np.concatenate([np.arange(p >> 8, (p >> 8) + (p & 255) + 1) for p in at]))
            start = start[start + length <= len(raw)]
            name.append(_mixed_names(x, start, (*range(0, length - MARK, MARK), length - MARK)))
            doc.append(np.full(len(start), d, dtype=np.int64))
            place.append(start << 8)
        if name:
            name = np.concatenate(name)
            yield _rows_of(name, name, np.concatenate(doc), np.concatenate(place))


def _contexts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Mark and bytes of each of the given units of a text."""
    for batch in batches:
        ids, places, rows = batch.column("doc_id").to_pylist(), batch.column("places").to_pylist(), []
        for i, d in enumerate(ids):
            raw, offsets = buffers(batch.column("text").slice(i, 1))
            mark, _, _, start, size = units(raw, offsets, length)
            wanted = np.isin(start << 8 | size - length, np.array(places[i], dtype=np.int64))
            for m, a, n in zip(mark[wanted].view(np.int64).tolist(), start[wanted].tolist(), size[wanted].tolist(), strict=True):
                rows.append((m, d, a << 8 | n - length, raw[a : a + n].tobytes()))
        if rows:
            yield pa.RecordBatch.from_pydict(dict(zip(("mark", "doc_id", "place", "bytes"), map(list, zip(*rows, strict=True)), strict=True)))


def _settle_windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Over units sorted by mark: runs of windows that come earlier in another unit; units of marks with too many come back as they are."""
    held: pa.RecordBatch | None = None
    large = None

    def settled(part: pa.RecordBatch, whole: np.ndarray) -> pa.RecordBatch:
        doc, place = part.column("doc_id").to_numpy(), part.column("place").to_numpy()
        back = np.flatnonzero(~whole)
        rows = np.flatnonzero(whole)
        held_bytes = part.column("bytes").cast(pa.large_binary())
        _, at, data = held_bytes.buffers()
        at = np.frombuffer(at, np.int64)[held_bytes.offset :]
        x = names(np.frombuffer(data, np.uint8)) if len(rows) else np.zeros(0, np.uint64)
        count = (place[rows] & 255) + 1
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        name = _mixed_names(x, np.repeat(at[rows], count) + nth, (*range(0, length - MARK, MARK), length - MARK))
        where, text = (np.repeat(place[rows] >> 8, count) + nth) << 8, np.repeat(doc[rows], count)
        order, _, later = _earliest(name, name, text, where)
        text, start = text[order[later]], where[order[later]] >> 8
        order = np.lexsort((start, text))
        text, start = text[order], start[order]
        fresh = np.ones(len(start), dtype=bool)
        fresh[1:] = (text[1:] != text[:-1]) | (start[1:] != start[:-1] + 1)
        begin = np.flatnonzero(fresh)
        size = np.diff(np.r_[begin, len(start)])
        # a run is of one unit or of neighbours; 256 windows at most go into one place
        parts = -(-size // 256)
        step = (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * 256
        first, left = np.repeat(start[begin], parts) + step, np.minimum(np.repeat(size, parts) - step, 256)
        doc_id = np.concatenate([np.repeat(text[begin], parts), doc[back]])
        return pa.RecordBatch.from_pydict({"doc_id": doc_id, "place": np.concatenate([first << 8 | left - 1, place[back]]), "repeated": np.arange(len(doc_id)) < len(first)})

    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.concat_batches([held, batch])
        mark = batch.column("mark").to_numpy()
        cut = int(np.searchsorted(mark, mark[-1]))
        end = len(mark) if len(mark) - cut >= HELD_UNITS else cut
        count = np.bincount(np.cumsum(np.r_[False, mark[1:] != mark[:-1]]))
        whole = np.repeat(count < HELD_UNITS, count) & ((mark != large) if large is not None else True)
        if end > cut:
            large = mark[-1]
        if end:
            yield settled(batch.slice(0, end), whole[:end])
        held = batch.slice(end) if end < len(mark) else None
    if held is not None:
        yield settled(held, np.full(held.num_rows, held.column("mark")[0].as_py() != large))


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by mark, name and place: units after the earliest of their name (repeated), and earliest ones whose mark has several names.

    From one batch to the next goes the last unit that is the earliest of its name, and whether its mark has had another name: never a whole group.
    """
    last: tuple[int, int, int, int] | None = None  # mark, name, document, place
    told = False  # the last one was given out already: its mark has several names
    for batch in batches:
        mark, name, doc, place, done = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("mark", "name", "doc_id", "place", "done"))
        ready, open_ = np.flatnonzero(done), np.flatnonzero(~done)
        mark, name, own, at = mark[open_], name[open_], doc[open_], place[open_]
        if last is not None:  # the last earliest unit stands before the batch
            mark, name, own, at = (np.r_[np.array([x], dtype=c.dtype), c] for x, c in zip(last, (mark, name, own, at), strict=True))
        if not len(mark):
            if len(ready):
                yield pa.RecordBatch.from_pydict({"doc_id": doc[ready], "place": place[ready], "repeated": np.ones(len(ready), dtype=bool)})
            continue
        first = np.ones(len(mark), dtype=bool)
        first[1:] = (mark[1:] != mark[:-1]) | (name[1:] != name[:-1])
        heads = np.flatnonzero(first)
        head = heads[np.cumsum(first) - 1]
        later = np.flatnonzero((own != own[head]) | (at >> 8 != at[head] >> 8))
        m = mark[heads]
        several = np.zeros(len(heads), dtype=bool)
        several[1:] = m[1:] == m[:-1]
        several[:-1] |= m[1:] == m[:-1]
        if last is not None and told:  # its mark's other units are contested too; it was given out itself
            several |= m == last[0]
        out = heads[several]
        if last is not None and told:
            out = out[out != 0]
        end = heads[-1]
        told = bool(several[-1])
        last = tuple(int(c[end]) for c in (mark, name, own, at))
        rows = np.concatenate([later, out])
        yield pa.RecordBatch.from_pydict({"doc_id": np.r_[doc[ready], own[rows]], "place": np.r_[place[ready], at[rows]], "repeated": np.arange(len(ready) + len(rows)) < len(ready) + len(later)})


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.repartition("mark").sortWithinPartitions("mark", "name", "doc_id", "place").mapInArrow(lean(_settle), _FOUND)


def _with_texts(docs: DataFrame, found: DataFrame, items: int, how: str) -> DataFrame:
    """``found`` (a row per document) joined to texts; broadcast where its size allows, else by a shuffle."""
    return docs.join(F.broadcast(found) if items <= BROADCAST_SPANS else found, "doc_id", how)


def repeated_spans(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """doc_id and ``places`` (start * 256 + bytes over ``length``): spans, overlapping ones too, each covered by repeated strings."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null")
    found = saved(_sorted(docs.filter(F.octet_length("text") >= length).mapInArrow(lean(lambda batches: _units(batches, length)), _ROWS)), "repeat-units")
    contested = found.filter(~F.col("repeated"))
    n = contested.count()
    spans = found.filter("repeated").select("doc_id", "place")
    if n:
        by_doc = contested.groupBy("doc_id").agg(F.collect_list("place").alias("places"))
        contexts = _with_texts(docs, by_doc, n, "inner").select("doc_id", "text", "places").mapInArrow(lean(lambda batches: _contexts(batches, length)), "mark long, doc_id long, place long, bytes binary")
        told = saved(contexts.repartition("mark").sortWithinPartitions("mark").mapInArrow(lean(lambda batches: _settle_windows(batches, length)), _FOUND), "repeat-windows")
        spans = spans.unionByName(told.filter("repeated").select("doc_id", "place"))
        left = told.filter(~F.col("repeated"))
        n = left.count()
        if n:
            by_doc = left.groupBy("doc_id").agg(F.collect_set("place").alias("places"))
            windows = _with_texts(docs, by_doc, n, "inner").select("doc_id", "text", "places").mapInArrow(lean(lambda batches: _windows(batches, length)), _ROWS)
            spans = spans.unionByName(_sorted(windows).filter("repeated").select("doc_id", "place"))
    return spans.groupBy("doc_id").agg(F.sort_array(F.collect_set("place")).alias("places"))


def _merged(places: list[int], length: int, size: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for p in places:
        start, end = p >> 8, min((p >> 8) + (p & 255) + length, size)
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        elif start < end:
            out.append((start, end))
    return out


def _shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins spans that touch, so that they take less room."""
    for batch in batches:
        made = [_merged(x, LENGTH, 1 << 62) for x in batch.column("places").to_pylist()]
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "spans": pa.array([[v for s in x for v in s] for x in made], pa.list_(pa.int64()))})


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, text, spans in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("spans").to_pylist(), strict=True):
            raw = (text.as_py() or "").encode()
            at, kept, cut = 0, hashlib.sha256(), [(a, min(b, len(raw))) for a, b in zip((spans or [])[::2], (spans or [])[1::2], strict=True) if a < len(raw)]
            for a, b in cut:
                kept.update(raw[at:a])
                at = b
            kept.update(raw[at:])
            rows.append((doc, len(raw), sum(b - a for a, b in cut), len(cut), kept.hexdigest()))
        if rows:
            yield pa.RecordBatch.from_pydict(dict(zip(("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), map(list, zip(*rows, strict=True)), strict=True)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: what is left of each document's bytes without repeated strings of 100 bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    spans = saved(repeated_spans(docs).mapInArrow(lean(_shorten), "doc_id long, spans array<long>"), "repeat-spans")
    items = spans.agg(F.coalesce(F.sum(F.size("spans") + 1), F.lit(0))).first()[0]
    return _with_texts(docs, spans, items, "left").select("doc_id", "text", "spans").mapInArrow(lean(_digest), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
