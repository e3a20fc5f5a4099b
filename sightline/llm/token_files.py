"""Operator 6: token ids in length-delimited binary records with an offset index.

A record file starts with ``MAGIC`` and a byte that says how many bytes an id takes.
Each record is: payload length (8 bytes), masked checksum of those 8 bytes (4), payload,
masked checksum of the payload (4). The payload is the document's id (8 bytes, signed)
and its token ids. All numbers are little-endian. Beside each record file lies an index:
for each record its document id, place and number of ids, 24 bytes each, so that records
can be read in any order. The checksum is CRC-32, masked as in other record formats, so
that a checksum over data that hold checksums stays sound.

Scale: documents are dealt by ranges of ``doc_id``; each task encodes its range, a batch
at a time, and writes one file, under another name until it is whole, so a repeated or
lost task leaves no half file. Where each file's ids begin comes from one row per file.

Defined cases: a null or empty text is the end id alone; repeated document ids keep
their own records, in the order of their texts; an empty table makes no file; a null
document id isn't allowed in a record and raises.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.llm.batches import lean
from sightline.llm.store import new_path, saved
from sightline.llm.tokens import default_tokenizer, word_ids

MAGIC = b"SLTOKEN1"
END_ID = 2
_FRAME, _SUM, _INDEX = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<qQQ")
MANIFEST = "file string, first_doc long, n_docs long, n_tokens long"


def masked(data: bytes) -> int:
    """CRC-32, turned right by 15 bits, plus a constant."""
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = _FRAME.pack(len(payload))
    return b"".join((head, _SUM.pack(masked(head)), payload, _SUM.pack(masked(payload))))


def unframe(data: bytes, at: int) -> tuple[bytes, int]:
    """The payload of the record at ``at``, and where the next begins; raises if a checksum is wrong."""
    head = data[at : at + 8]
    if len(head) < 8 or _SUM.unpack_from(data, at + 8)[0] != masked(head):
        raise ValueError(f"damaged record length at byte {at}")
    end = at + 12 + _FRAME.unpack(head)[0]
    payload = data[at + 12 : end]
    if len(data) < end + 4 or _SUM.unpack_from(data, end)[0] != masked(payload):
        raise ValueError(f"damaged record at byte {at}")
    return payload, end + 4


def _write(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, end_id: int | None) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get()
    words = word_ids(tokenizer)
    width = 2 if words.tokenizer.get_vocab_size() <= 1 << 16 and (end_id or 0) < 1 << 16 else 4
    kind, tail = f"<u{width}", struct.pack("<I", end_id) if end_id is not None else b""
    system, root = fs.FileSystem.from_uri(folder)
    name = f"{root}/part-{task.partitionId():06d}"
    draft = f"{name}.{task.taskAttemptId()}.draft"
    out = index = None
    at, n_docs, n_tokens, first = 0, 0, 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        if out is None:
            system.create_dir(root, recursive=True)
            out, index = system.open_output_stream(f"{draft}.rec"), system.open_output_stream(f"{draft}.idx")
            out.write(MAGIC + bytes([width]))
            at = len(MAGIC) + 1
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = np.frombuffer(words.encode(text.as_py()) + tail, "<u4")
            record = frame(struct.pack("<q", doc) + ids.astype(kind).tobytes())
            out.write(record)
            index.write(_INDEX.pack(doc, at, len(ids)))
            first = doc if first is None else first
            at, n_docs, n_tokens = at + len(record), n_docs + 1, n_tokens + len(ids)
    if out is not None:
        out.close()
        index.close()
        for kind in ("rec", "idx"):
            system.move(f"{draft}.{kind}", f"{name}.{kind}")
        yield pa.RecordBatch.from_pydict({"file": [f"{folder}/part-{task.partitionId():06d}"], "first_doc": [first], "n_docs": [n_docs], "n_tokens": [n_tokens]})


def write_tokens(docs: DataFrame, folder: str, *, text: str = "text", doc_id: str = "doc_id", tokenizer: str | None = None, end_id: int | None = END_ID) -> DataFrame:
    """Writes record and index files into ``folder`` (a URI); returns a row per file, with ``start``: ids before it."""
    tokenizer = tokenizer or default_tokenizer()
    dealt = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    files = saved(dealt.mapInArrow(lean(lambda batches: _write(batches, folder, tokenizer, end_id), words=True), MANIFEST), "token-files")
    before = Window.orderBy("first_doc", "file").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")))


def read_index(file: str) -> np.ndarray:
    """Document id, place and number of ids of each record."""
    system, name = fs.FileSystem.from_uri(f"{file}.idx")
    with system.open_input_stream(name) as f:
        return np.frombuffer(f.read(), dtype=[("doc_id", "<i8"), ("at", "<u8"), ("n", "<u8")])


def read_records(file: str, places: Iterator[int] | np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """Document ids and token ids, in the file's order or at the given places (from the index) in theirs."""
    system, name = fs.FileSystem.from_uri(f"{file}.rec")
    with system.open_input_file(name) as f:
        head = f.read(len(MAGIC) + 1)
        if head[:-1] != MAGIC:
            raise ValueError(f"not a token file: {file}")
        kind = f"<u{head[-1]}"
        at, size = len(head), f.size()
        wanted = iter(places) if places is not None else None
        while True:
            if wanted is not None:
                at = next(wanted, size)
            if at >= size:
                return
            f.seek(int(at))
            head = f.read(12)
            payload, _ = unframe(head + f.read(_FRAME.unpack(head[:8])[0] + 4), 0)
            at = int(at) + len(payload) + 16
            yield struct.unpack_from("<q", payload)[0], np.frombuffer(payload, kind, offset=8).astype("<u4")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
            index = read_index(file)
            starts = start + np.cumsum(index["n"].astype(np.int64)) - index["n"].astype(np.int64)
            crcs = []
            for (doc, ids), entry in zip(read_records(file, index["at"]), index, strict=True):
                if doc != entry["doc_id"] or len(ids) != entry["n"]:
                    raise ValueError(f"index and records differ: {file}")
                crcs.append(zlib.crc32(ids.tobytes()))
            yield pa.RecordBatch.from_pydict({"doc_id": index["doc_id"], "start": starts, "n_tokens": index["n"].astype(np.int64), "ids_crc32": pa.array(crcs, pa.int64())})


def read_digests(files: DataFrame) -> DataFrame:
    """Per document, read back through the index: place among all ids, number of ids and their checksum."""
    n = files.sparkSession.sparkContext.defaultParallelism
    dealt = files.select("file", "start").repartition(n, "file")
    return dealt.mapInArrow(lean(_read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: every document's ids as written and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_digests(write_tokens(docs, new_path(spark, "token-records")))
