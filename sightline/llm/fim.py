"""Operator 11: fill-in-middle transformation by a byte automaton.

A text is a row of units, each some white space and the word after it, or the white space
at the end. Prefix, middle and suffix are whole units; two draws that depend on the seed
and the document's id alone say where they part. The output has the parts in another order, with
a sentinel before each; a text that holds a sentinel already stays plain, so every output can be
turned back (``restored``).

The texts of a batch go through one table-driven automaton over bytes. Its states know whether a unit has begun, how
many bytes of a UTF-8 character are to come, and how much of a sentinel has been read; each transition
emits what it counts: a code point, the begin of a unit, the end of a sentinel. This one scan
counts units and finds sentinels; a second pass turns the drawn numbers of units into bytes
and code points. To step through the table with numpy, the scan goes along many lanes of a
batch at once. A lane starts from a guessed state; lanes whose guess was not the state at the end of
the lane before are run again, until none is left, so the result is that of a scan from the left.

Scale: one pass over the texts, no shuffle; each row stands for itself.

Defined cases: a null text is empty, and an empty text is plain; so is a row without an id, for which nothing
can be drawn. Repeated rows get the same output. An empty table gives no rows. Extra columns are passed
through; those named as an output are replaced. A text is never split: one of n bytes takes some 30 n bytes in a worker.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.llm.batches import lean
from sightline.llm.textbytes import buffers, byte_set, pieces, sliced

SEED = 42
#: Of a hundred documents, how many are transformed, and of these how many with the suffix first.
RATE, SUFFIX_FIRST = 50, 80
#: Before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
OUTPUTS = [T.StructField("output", T.StringType()), T.StructField("form", T.StringType()), T.StructField("n", T.LongType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType())]

#: What a transition emits.
CHAR, UNIT, MARK = 1, 2, 4
#: A byte that UTF-8 never has, which ends a text.
END = 0xFF
_LANE = 256
_SPACE = byte_set((0x20, 0x20), (0x09, 0x0D))
_START, _BLANK, _WORD = 0, 1, 2


@cache
def automaton(sentinels: tuple[str, ...] = SENTINELS) -> tuple[np.ndarray, np.ndarray]:
    """For each state and byte (``state * 256 + byte``), 256 times the next state, and what is emitted.

    States: the start of a text, after white space, after a whole character of a word, one to
    three bytes of a character to come, and one for each beginning of a sentinel.
    """
    marks = [s.encode() for s in sentinels]
    if not all(m and max(m) < 0x80 and not _SPACE[list(m)].any() for m in marks):
        raise ValueError("sentinels are of ASCII characters, none of them white space")
    begun = sorted({m[:k] for m in marks for k in range(1, len(m))})
    state = {b"": _WORD} | {b: 6 + k for k, b in enumerate(begun)}
    to, emits = np.full((6 + len(begun), 256), _START, np.int64), np.zeros((6 + len(begun), 256), np.uint8)
    read = {s: b for b, s in state.items()}
    for s in range(len(to)):
        for byte in range(END):
            if _SPACE[byte]:
                to[s, byte], emits[s, byte] = _BLANK, CHAR | UNIT * (s != _BLANK)
                continue
            emits[s, byte] = UNIT * (s == _START)
            if 0x80 <= byte < 0xC0:  # a character goes on
                to[s, byte] = s - 1 if s in (4, 5) else _WORD
                continue
            emits[s, byte] |= CHAR
            if byte >= 0xC0:  # it has one, two or three more bytes
                to[s, byte] = 3 + (byte >= 0xE0) + (byte >= 0xF0)
                continue
            said = read.get(s, b"") + bytes([byte])
            if any(said.endswith(m) for m in marks):
                emits[s, byte] |= MARK
            to[s, byte] = next(state[said[k:]] for k in range(len(said) + 1) if said[k:] in state)
    return (to * 256).ravel(), emits.ravel()


def _along(symbols: np.ndarray, at: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """What each step of each lane emits, and the lanes' last states; a column of ``symbols`` is a lane."""
    to, emits = table
    out = np.empty(symbols.shape, np.uint8)
    for k in range(len(symbols)):
        here = at + symbols[k]
        out[k] = emits.take(here)
        at = to.take(here)
    return out, at


def scan(symbols: np.ndarray, sentinels: tuple[str, ...] = SENTINELS) -> np.ndarray:
    """What the automaton emits at each byte; texts stand one after the other, each ended by ``END``."""
    table = automaton(tuple(sentinels))
    lanes = -(-len(symbols) // _LANE)
    padded = np.full(lanes * _LANE, END, np.uint8)
    padded[: len(symbols)] = symbols
    steps = np.ascontiguousarray(padded.reshape(lanes, _LANE).T)
    begin = np.full(lanes, _WORD * 256, np.int64)
    begin[:1] = _START * 256
    emitted, end = _along(steps, begin, table)
    while True:
        wrong = np.flatnonzero(begin[1:] != end[:-1]) + 1
        if not len(wrong):
            return emitted.T.reshape(-1)[: len(symbols)]
        begin[wrong] = end[wrong - 1]
        emitted[:, wrong], end[wrong] = _along(np.ascontiguousarray(steps[:, wrong]), begin[wrong], table)


def draws(seed: int, doc_id: int) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers of a document."""
    said = hashlib.sha256(f"{seed}:{doc_id}".encode()).digest()
    return tuple(int.from_bytes(said[k : k + 4], "big") for k in (0, 4, 8, 12))


def _parts(raw: np.ndarray, offsets: np.ndarray, ids: list, seed: int, rate: int, suffix_first: int, sentinels: tuple[str, ...]) -> Iterator[tuple]:
    """The output columns of each text of a run."""
    n_texts = len(offsets) - 1
    emitted = scan(np.insert(raw, offsets[1:], END), sentinels)
    shift = np.arange(n_texts + 1)
    edge = offsets + shift  # where each text begins among the symbols
    begins, marks = np.flatnonzero(emitted & UNIT), np.flatnonzero(emitted & MARK)
    first, held = np.searchsorted(begins, edge), np.diff(np.searchsorted(marks, edge))
    chars = np.zeros(len(emitted) + 1, np.int64)
    np.cumsum(emitted & CHAR, out=chars[1:])
    p, s, m = (x.encode() for x in sentinels)
    for i in range(n_texts):
        text, n = raw[offsets[i] : offsets[i + 1]].tobytes(), int(first[i + 1] - first[i])
        h = draws(seed, ids[i]) if ids[i] is not None and n and not held[i] else None
        if h is None or h[2] % 100 >= rate:
            yield text.decode(), "plain", n, None, None
            continue
        # the second pass: units to places
        a, b = (int(begins[first[i] + k]) if k < n else int(edge[i + 1]) - 1 for k in sorted((h[0] % (n + 1), h[1] % (n + 1))))
        prefix, middle, suffix = text[: a - edge[i]], text[a - edge[i] : b - edge[i]], text[b - edge[i] :]
        form = "spm" if h[3] % 100 < suffix_first else "psm"
        output = s + suffix + p + prefix + m + middle if form == "spm" else p + prefix + s + suffix + m + middle
        yield output.decode(), form, n, int(chars[a] - chars[edge[i]]), int(chars[b] - chars[a])


def _transformed(batches: Iterator[pa.RecordBatch], names: list[str], text: str, doc_id: str, *how) -> Iterator[pa.RecordBatch]:
    kinds = dict(zip((f.name for f in OUTPUTS), (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True))
    for batch in batches:
        for part in sliced(batch, text):
            ids, rows = part.column(doc_id).to_pylist(), []
            for row, end, raw, offsets in pieces(*buffers(part.column(text))):
                rows += _parts(raw, offsets, ids[row:end], *how)
            made = {n: pa.array([r[k] for r in rows], kind) for k, (n, kind) in enumerate(kinds.items())}
            yield pa.RecordBatch.from_pydict({n: made[n] if n in made else part.column(n) for n in names})


def fill_in_middle(docs: DataFrame, *, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, sentinels: tuple[str, str, str] = SENTINELS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with ``output``, ``form`` (plain, psm or spm), ``n`` units, and code points of prefix and middle (null if plain)."""
    if {text, doc_id} & {f.name for f in OUTPUTS}:
        raise ValueError("text and id can't have the name of an output")
    automaton(tuple(sentinels))  # checks the sentinels
    kept = [f for f in docs.schema if f.name not in {o.name for o in OUTPUTS}]
    schema = T.StructType([*kept, *OUTPUTS])
    names = [f.name for f in schema]
    return docs.select(*(f"`{f.name}`" for f in kept)).mapInArrow(lean(lambda batches: _transformed(batches, names, text, doc_id, seed, rate, suffix_first, tuple(sentinels))), schema)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output was made of."""
    p, s, m = (rf"\Q{x}\E" for x in sentinels)
    psm = F.regexp_replace(output, F.lit(f"(?s)^{p}(.*){s}(.*){m}(.*)$"), F.lit("$1$3$2"))
    spm = F.regexp_replace(output, F.lit(f"(?s)^{s}(.*){p}(.*){m}(.*)$"), F.lit("$2$3$1"))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: form, units, sizes, and checksums of the output and of the text made of it again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = fill_in_middle(docs)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
