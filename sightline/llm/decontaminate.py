"""Operator 1: benchmark decontamination with a generalised suffix automaton.

The words of all test items go into one suffix automaton. Training texts stream
through it; at each word the automaton gives the length of the longest run that
ends there and occurs in some item. A run of ``window`` words or more is a hit, and
so is a whole item that is shorter than a window.

Only stretches in which each pair of neighbouring words is a pair of some item are
streamed; no match can lie outside them. The stretches are found with numpy on word
hashes, the automaton then works on the words themselves, so results are exact.

Scale: documents are never shuffled. The items are cut by a hash into blocks of about
``BLOCK_BYTES``, one of which is collected and built at a time; an automaton in sorted arrays takes
some 25 bytes for each byte of its items. One pass over the documents streams them through up to
``PASS_BLOCKS`` automata; larger sets of items take more passes, each written before the next.

Defined cases: a null or empty text has no words and no hits; an item without words or with a null id
matches nothing; items with the same text all count; an empty table of items gives no
hits, an empty one of documents no rows; repeated rows are scanned each. ``find_spans`` passes extra columns through and replaces those
named as its outputs; ``decontaminate`` keeps all columns, whatever their names. A text is never
split: one of n bytes takes some 8 n bytes in a worker.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.llm.batches import lean
from sightline.llm.store import saved
from sightline.llm.textbytes import ALNUM, Words, buffers, fresh_name, mixed, pieces, replaced, sliced

WINDOW = 10
#: Text of items that one automaton holds at most, about.
BLOCK_BYTES = 2 << 20
#: Automata that one pass over the documents uses.
PASS_BLOCKS = 4
_FILTER_BITS = 20
_ODD = np.uint64(0xD6E8FEB86659FD93)

SPANS = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType(), False) for n in ("first_word", "last_word", "start_byte", "end_byte", "longest")]))
_SPANS_ARROW = pa.list_(pa.struct([(n, pa.int32()) for n in ("first_word", "last_word", "start_byte", "end_byte", "longest")]))


class ItemAutomaton:
    """Generalised suffix automaton of the items' words."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.window, self.vocabulary = window, {}
        self.follow: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        names, pairs, singles, self.least, runs = [], set(), set(), window, []
        for name, text in items:
            raw, offsets = buffers(pa.array([text], pa.large_string()))
            words = Words(raw, offsets, ALNUM)
            n = len(words.start)
            if not n:
                continue
            names.append(str(name))
            runs.append([self.vocabulary.setdefault(words.word(i), len(self.vocabulary)) for i in range(n)])
            self.least = min(self.least, n)
            pairs.update(_pair(words.hash).tolist())
            if n == 1:
                singles.update(words.hash.tolist())
        self.names = names
        ends: list[list[int]] = []
        for run in runs:
            last, path = 0, []
            for word in run:
                last = self._extend(last, word)
                path.append(last)
            ends.append(path)
        size = len(self.length)
        self.short: list[list[tuple[int, int]]] = [[] for _ in range(size)]
        self.items: list[list[int]] = [[] for _ in range(size)]
        seen = [-1] * size
        for item, run in enumerate(runs):  # a clone may have taken over a prefix's state: walk again
            state = 0
            for word in run:
                state = self.follow[state][word]
                up = state
                while up and seen[up] != item:
                    seen[up] = item
                    self.items[up].append(item)
                    up = self.link[up]
            if len(run) < window:
                self.short[state].append((len(run), item))
        order = sorted(range(1, size), key=self.length.__getitem__)
        self.at_window = [0] * size
        for state in order:
            up = self.link[state]
            self.short[state] = self.short[state] + self.short[up]
            if self.length[state] >= window:
                self.at_window[state] = self.at_window[up] if self.length[up] >= window else state
        self.pair_filter, self.single_filter = _filter(pairs), _filter(singles) if singles else None
        self._settle()

    def _settle(self) -> None:
        """Transitions, links and what each state reports as sorted arrays, several times smaller than dicts and lists."""
        size = len(self.length)
        key = np.fromiter((state << 32 | word for state, below in enumerate(self.follow) for word in below), np.int64, sum(map(len, self.follow)))
        value = np.fromiter((to for below in self.follow for to in below.values()), np.int32, len(key))
        order = np.argsort(key)
        self.step_key, self.step_to = key[order], value[order]
        self.link, self.length, self.at_window = (np.array(x, dtype=np.int32) for x in (self.link, self.length, self.at_window))
        wanted = set(np.unique(self.at_window).tolist()) - {0}
        self.items = {s: np.array(self.items[s], dtype=np.int32) for s in wanted}
        self.short = {s: x for s, x in enumerate(self.short) if x}
        del self.follow
        assert size == len(self.length)

    def _next(self, state: int, word: int) -> int:
        """The state after a word, -1 if there is none."""
        key = state << 32 | word
        at = int(self.step_key.searchsorted(key))
        return int(self.step_to[at]) if at < len(self.step_key) and self.step_key[at] == key else -1

    def _extend(self, last: int, word: int) -> int:
        follow, link, length = self.follow, self.link, self.length
        known = follow[last].get(word)
        if known is not None:
            return known if length[known] == length[last] + 1 else self._clone(last, word, known)
        new = len(length)
        follow.append({})
        length.append(length[last] + 1)
        link.append(0)
        while last >= 0 and word not in follow[last]:
            follow[last][word] = new
            last = link[last]
        if last >= 0:
            known = follow[last][word]
            link[new] = known if length[known] == length[last] + 1 else self._clone(last, word, known)
        return new

    def _clone(self, last: int, word: int, known: int) -> int:
        follow, link, length = self.follow, self.link, self.length
        copy = len(length)
        follow.append(dict(follow[known]))
        length.append(length[last] + 1)
        link.append(link[known])
        link[known] = copy
        while last >= 0 and follow[last].get(word) == known:
            follow[last][word] = copy
            last = link[last]
        return copy

    def stretches(self, words: Words) -> Iterator[tuple[int, int]]:
        """Word ranges outside which nothing can match."""
        n = len(words.start)
        if not n or not self.names:
            return
        joined = np.zeros(n + 1, dtype=bool)  # joined[i]: words i - 1 and i may follow each other in an item
        joined[1:n] = self.pair_filter[_pair(words.hash) >> np.uint64(64 - _FILTER_BITS)]
        joined[words.first] = False
        begin = np.flatnonzero(~joined[:-1] & joined[1:])
        end = np.flatnonzero(joined[:-1] & ~joined[1:]) + 1
        if self.single_filter is None:
            long = end - begin >= self.least
            yield from zip(begin[long].tolist(), end[long].tolist(), strict=True)
            return
        alone = self.single_filter[words.hash >> np.uint64(64 - _FILTER_BITS)]
        for b, e in zip(begin.tolist(), end.tolist(), strict=True):
            alone[b:e] = False
            yield b, e
        yield from ((int(i), int(i) + 1) for i in np.flatnonzero(alone))

    def spans(self, words: Words, begin: int, end: int, found: set[int]) -> list[tuple[int, int, int]]:
        """Hit word ranges in a stretch, with the longest match in each; adds the items to ``found``."""
        link, length = self.link, self.length
        state = matched = 0
        spans: list[tuple[int, int, int]] = []
        for i in range(begin, end):
            word = self.vocabulary.get(words.word(i))
            if word is None:
                state = matched = 0
                continue
            after = self._next(state, word)
            while state and after < 0:
                state = int(link[state])
                matched = int(length[state])
                after = self._next(state, word)
            if after >= 0:
                state = after
                matched += 1
            reach = 0
            if matched >= self.window:
                reach = matched
                found.update(self.items[int(self.at_window[state])].tolist())
            for size, item in self.short.get(state, ()):
                if size <= matched:
                    found.add(item)
                    reach = max(reach, size)
            if reach:
                first, longest = i - reach + 1, reach
                while spans and spans[-1][1] >= first - 1:
                    a, _, b = spans.pop()
                    first, longest = min(first, a), max(longest, b)
                spans.append((first, i, longest))
        return spans


def _pair(hashes: np.ndarray) -> np.ndarray:
    return mixed(hashes[:-1] * _ODD + hashes[1:])


def _filter(hashes: set[int]) -> np.ndarray:
    flags = np.zeros(1 << _FILTER_BITS, dtype=bool)
    if hashes:
        flags[np.fromiter(hashes, np.uint64, len(hashes)) >> np.uint64(64 - _FILTER_BITS)] = True
    return flags


def _joined(spans: list[tuple]) -> list[tuple]:
    """Spans in order; those that touch or overlap become one."""
    out: list[tuple] = []
    for s in sorted(spans):
        if out and s[0] <= out[-1][1] + 1:
            a = out[-1]
            out[-1] = (a[0], max(a[1], s[1]), a[2], max(a[3], s[3]), max(a[4], s[4]))
        else:
            out.append(s)
    return out


_NAMES = ("first_word", "last_word", "start_byte", "end_byte", "longest")


def _hits(words: Words, at: np.ndarray, automata: list[ItemAutomaton]) -> dict[int, tuple[list, set]]:
    """Spans and item names of each text of a run that has any."""
    out: dict[int, tuple[list, set]] = {}
    for automaton in automata:
        hits: dict[int, tuple[list, set]] = {}
        for b, e in automaton.stretches(words):
            doc = int(np.searchsorted(words.first, b, side="right")) - 1
            mine, found = hits.setdefault(doc, ([], set()))
            mine += automaton.spans(words, b, e, found)
        for doc, (mine, found) in hits.items():
            zero, byte = int(words.first[doc]), int(at[doc])
            spans, names = out.setdefault(doc, ([], set()))
            spans += [(i - zero, j - zero, int(words.start[i]) - byte, int(words.end[j]) - byte, k) for i, j, k in mine]
            names.update(automaton.names[x] for x in found)
    return out


def _scan(batches: Iterator[pa.RecordBatch], held: list, more: bool, text: str, kept: list[str], made: tuple[str, str, str]) -> Iterator[pa.RecordBatch]:
    """Adds spans and items; ``more``: columns of earlier passes are there."""
    n_words, spans_name, items_name = made
    automata = [x.value for x in held]
    for batch in batches:
        for part in sliced(batch, text):
            counts: list[np.ndarray] = []
            spans: list[list[tuple]] = [[tuple(s.values()) for s in x] for x in part.column(spans_name).to_pylist()] if more else [[] for _ in range(part.num_rows)]
            items: list[list[str]] = part.column(items_name).to_pylist() if more else [[] for _ in range(part.num_rows)]
            for row, _, data, at in pieces(*buffers(part.column(text))):
                words = Words(data, at, ALNUM)
                counts.append(np.diff(words.first))
                for doc, (mine, names) in _hits(words, at, automata).items():
                    spans[row + doc] = _joined([*spans[row + doc], *mine])
                    items[row + doc] = sorted({*items[row + doc], *names})
            new = {
                n_words: pa.array(np.concatenate(counts), pa.int64()),
                spans_name: pa.array([[dict(zip(_NAMES, s, strict=True)) for s in x] for x in spans], _SPANS_ARROW),
                items_name: pa.array(items, pa.list_(pa.string())),
            }
            yield pa.RecordBatch.from_pydict({n: part.column(n) for n in kept} | new)


def find_spans(
    docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, keep: list[str] | None = None, names: tuple[str, str, str] = ("n_words", "spans", "items")
) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``n_words``, ``spans`` and ``items``, or what ``names`` calls them.

    Spans are word and byte ranges of the text, none overlapping or touching another;
    ``longest`` is the longest single match in one. ``items`` are the ids, as sorted strings.
    """
    spark = docs.sparkSession
    items = items.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("text")).filter("id is not null and text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // BLOCK_BYTES))
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]
    source = text
    if text in names:  # the text's own name is to be an output
        source = fresh_name("__text", docs.columns)
        docs = docs.withColumn(source, F.col(text))
    carried = list(dict.fromkeys([*keep, source]))
    df = docs.select(*carried)
    for low in range(0, blocks, PASS_BLOCKS):
        if low:
            df = saved(df, "benchmark-pass")
        held = []
        for k in range(low, min(low + PASS_BLOCKS, blocks)):
            block = items.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k).collect()
            held.append(spark.sparkContext.broadcast(ItemAutomaton([(r["id"], r["text"]) for r in block], window)))
        out = keep if low + PASS_BLOCKS >= blocks else carried
        schema = T.StructType([*(df.schema[c] for c in out), *(T.StructField(n, kind) for n, kind in zip(names, (T.LongType(), SPANS, T.ArrayType(T.StringType())), strict=True))])
        df = df.mapInArrow(lean(lambda batches, held=held, more=low > 0, out=out: _scan(batches, held, more, source, out, names)), schema)
    return df


def hit_words(spans: str = "spans") -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["last_word"] - s["first_word"] + 1)


def _without(text: str, spans: list[dict]) -> str:
    raw, at, parts = text.encode(), 0, []
    for s in spans:
        parts.append(raw[at : s["start_byte"]])
        at = s["end_byte"]
    return b"".join([*parts, raw[at:]]).decode()


def _cut(batches: Iterator[pa.RecordBatch], text: str, out: list[str], least: int, chars: str | None, spans: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in sliced(batch, text):
            hit = np.flatnonzero(pc.greater(pc.list_value_length(part.column(spans)), 0).to_numpy(zero_copy_only=False))
            found = {i: some for i in hit.tolist() if (some := [s for s in part.column(spans)[i].as_py() if s["longest"] >= least])}
            rows = np.array(list(found), dtype=np.int64)
            cut = [_without(part.column(text)[i].as_py(), some) for i, some in found.items()]
            made = {text: replaced(part.column(text), rows, cut)} | ({chars: replaced(part.column(chars), rows, [len(t) for t in cut])} if chars else {})
            yield pa.RecordBatch.from_pydict({n: made.get(n, part.column(n)) for n in out})


def decontaminate(docs: DataFrame, items: DataFrame, *, text: str = "text", window: int = WINDOW, max_match: int = WINDOW, max_coverage: float = 0.5, chars: str | None = "n_chars", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without what they share with the items.

    A span goes if its longest match has ``max_match`` words or more; items with fewer words than that are found but stay
    unless they make up most of a document, since they may be common phrases (``max_match`` can be lowered to their length). A document goes
    as a whole if such and shorter spans cover more than ``max_coverage`` of its words.
    ``chars`` names a column that holds the text's length and follows it.
    """
    out = docs.columns
    names = tuple(fresh_name(f"__{n}", out) for n in ("n_words", "spans", "items"))
    found = find_spans(docs, items, text=text, window=window, item_id=item_id, item_text=item_text, names=names)
    kept = found.filter(hit_words(names[1]) <= F.col(names[0]) * F.lit(float(max_coverage)))
    chars = chars if chars in out and docs.schema[chars].dataType == T.LongType() else None
    return kept.mapInArrow(lean(lambda batches: _cut(batches, text, out, max_match, chars, names[1])), docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op1: what each document shares with the benchmark."""
    found = find_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id"])
    hit = hit_words()
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )
