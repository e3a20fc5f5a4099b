"""Operator 4: best-fit packing by minimum bin slack.

Documents are encoded and only longer ones are cut, into pieces of ``capacity`` ids.
What matters for packing is how many pieces have each length: at most ``capacity``
numbers, whatever the corpus' size. Over these counts, bin after bin, the longest length
left is laid down and a bitset subset-sum over the lengths left finds the fullest
combination beside it. That combination is removed as often as the counts allow, as one
pattern. Spark then numbers the pieces of each length and hands each its place in a
pattern's copies.

Scale: no ids are shuffled. Numbering deals the pieces of a length into buckets of about
``BUCKET_ROWS``, so a length that a third of all pieces have is spread. The driver holds
the counts and patterns only, both bounded by ``capacity``.

Defined cases: a null or empty text is one piece with the end id alone; repeated rows
are packed each; an empty table gives no piece; columns other than id and text are unused.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.llm.batches import lean
from sightline.llm.store import saved
from sightline.llm.tokens import default_tokenizer, word_ids

CAPACITY = 4096
END_ID = 1
#: Pieces of one length that are numbered together.
BUCKET_ROWS = 1000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

#: times, {length: pieces of it in one sequence}
Pattern = tuple[int, dict[int, int]]


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of available lengths with the largest sum up to ``room``.

    Subset-sum over a bitset, longest lengths first; counts by doubling. Of equally full
    combinations that found first stays: few and long pieces.
    """
    reach, steps, full, mask = 1, [], 1 << room, (1 << room + 1) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, many = min(counts[length], room // length), 1
        while left and not reach & full:
            many = min(many, left)
            steps.append((length, many, reach))
            reach |= reach << length * many & mask
            left, many = left - many, many * 2
        if reach & full:
            break
    at, chosen = reach.bit_length() - 1, {}
    for length, many, before in reversed(steps):
        if not before >> at & 1:
            at -= length * many
            chosen[length] = chosen.get(length, 0) + many
    return chosen


def patterns(counts: dict[int, int], capacity: int = CAPACITY) -> Iterator[Pattern]:
    """Sequences of at most ``capacity`` that use up all pieces, equal ones together."""
    counts = {k: n for k, n in counts.items() if n}
    order = sorted(counts)
    while counts:
        while order[-1] not in counts:
            order.pop()
        longest = order[-1]
        counts[longest] -= 1
        held = {k: n for k, n in counts.items() if n}
        chosen = fullest(held, capacity - longest)
        counts[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(counts[k] // n for k, n in chosen.items())
        for k, n in chosen.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
        yield times, chosen


def places(found: Iterator[Pattern]) -> dict[str, np.ndarray]:
    """For each length, which numbers go to which sequences: rows sorted by ``key`` (length * 2**40 + first number)."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for times, chosen in found:
        offset = 0
        for length in sorted(chosen, reverse=True):
            n = chosen[length]
            first = used.get(length, 0)
            rows.append((length << 40 | first, first, n, sequence, offset))
            used[length] = first + n * times
            offset += n * length
        sequence += times
    made = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("key", "first", "each", "sequence", "offset"), made.T, strict=True))


def _encode(batches: Iterator[pa.RecordBatch], tokenizer: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    words, tail = word_ids(tokenizer), np.array([end_id], "<u4").tobytes()
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = words.encode(text.as_py()) + tail
            for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part)))
        if rows:
            columns = zip(("doc_id", "piece", "start", "length", "ids_crc32"), zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)
            yield pa.RecordBatch.from_pydict({n: pa.array(x, kind) for n, x, kind in columns})


def cut(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of all documents: place, length and checksum of their ids."""
    tokenizer = tokenizer or default_tokenizer()
    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(lean(lambda batches: _encode(batches, tokenizer, capacity, end_id), words=True), PIECES)


def _place(batches: Iterator[pa.RecordBatch], plan: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
        row = np.searchsorted(plan["key"], length << 40 | number, side="right") - 1
        copy, slot = np.divmod(number - plan["first"][row], plan["each"][row])
        made = {"sequence_id": plan["sequence"][row] + copy, "offset": plan["offset"][row] + slot * length}
        yield pa.RecordBatch.from_pydict({n: batch.column(n) for n in batch.schema.names if n != "number"} | made)


def pack(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces with the sequence that each goes to and its place there."""
    spark = docs.sparkSession
    made = saved(cut(docs, text=text, doc_id=doc_id, tokenizer=tokenizer, capacity=capacity, end_id=end_id), "pieces")
    counts = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}  # one row per length, at most capacity
    plan = spark.sparkContext.broadcast(places(patterns(counts, capacity)))
    buckets = spark.createDataFrame([(k, -(-n // BUCKET_ROWS)) for k, n in counts.items()], "length long, buckets long")
    dealt = made.join(F.broadcast(buckets), "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), "buckets")).drop("buckets")
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    numbered = dealt.withColumn("row", F.row_number().over(inside)).join(bases, ["length", "bucket"])
    numbered = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("row") - 1).alias("number"))
    return numbered.mapInArrow(lean(lambda batches: _place(batches, plan.value)), f"{PIECES}, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: all documents in sequences of at most 4096 ids."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
