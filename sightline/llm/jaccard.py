"""Operator 9: exact Jaccard join of documents by their word shingles, in metric regions.

Documents with equal sets are one from the start. The others are joined in the metric of
set difference: if two sets of sizes a <= b have a Jaccard similarity of t or more, they
differ in at most a * (1 - t) / t shingles.

1. Distance from the empty set is a set's size. Size bands are the regions around this
   first pivot, and by the triangle inequality a set goes to the next band too if a
   partner may lie there.
2. Each band splits the shingles' hash range into more buckets than partners can differ
   in, so partners hold the very same shingles in at least one bucket. Sets that agree in
   a bucket form a region. (Distances to whole-document pivots alone don't cut text:
   documents that share nothing are at distance 1 from every pivot, so windows around
   Voronoi cells would copy every document to every cell.)
3. A region's pivot is its member that shares most regions with others. All members are
   compared with the pivot, exactly, but those that a sketch rules out: of each document
   a byte for each of some ranges of the hashes, and too many of these differ. Links join
   components.
4. A region whose members are then in different components is joined on. In those of up to
   ``SKETCHED_INSIDE`` members, only members that may be linked with another component, by
   their sketches, take part further. Up to ``JOINED_INSIDE`` members are compared in one
   task, pairs of different components only. Larger regions go on recursively: with a centre that holds what most members around
   the pivot hold, members are given by their differences to the centre. If x and y differ
   from it in disjoint shingles and are linked, each is linked to the member with the
   least (weighted) difference, so all are compared with that one. Others share a shingle
   of a prefix of their differences, and these make the regions of the next round. No
   shingle of a difference is held by more than half of the members, so regions halve at
   least; no link between components is lost.

Scale: a document gives about one row for every 6 to 8 shingles (similarity 0.9). Rows
are sorted by region and streamed; sketches, and texts of what they leave, are joined to
pairs of member and pivot, which grow with the members, not with their pairs. Components
are found in rounds that aggregate before they shuffle. The few candidates' texts are read again, not their sets
shuffled.

Defined cases: a null or empty text has no shingle and links with nothing; a text with
fewer words than a shingle is one shingle, its whole sequence; an id is one document, whose text is
the first in order of its rows' (nulls last), and each row is returned; rows without an id aren't; an
empty table gives no rows; extra columns don't matter. A text is never split: one of n bytes takes some 16 n bytes in a worker.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.batches import lean
from sightline.llm.graph import components
from sightline.llm.store import drop, saved
from sightline.llm.textbytes import NOT_SPACE, Words, buffers, mixed, pieces

#: Ids up to which a table of documents is broadcast instead of joined by a shuffle; 16 MB.
BROADCAST_IDS = 1_000_000
#: Tasks that the copies of one set are dealt to.
SALTS = 16
#: Rows of one region up to which regions with the same members are told to be the same.
HELD_ROWS = 20_000
#: Members of a region up to which their sets, and their sketches, are compared with one another in one task.
JOINED_INSIDE, SKETCHED_INSIDE = 1024, 4096
#: Shingles that a region joined in one task holds at most, unless it has no more than ``FEW`` members.
HELD_SHINGLES, FEW = 4_000_000, 64
BAND = 1.5
_PIECE = 1 << 18
_A, _B = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD1B54A32D192ED03)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and where each text's begin."""
    words = Words(raw, offsets, NOT_SPACE)
    n, first = len(words.start), words.first
    value = words.hash
    for k in range(1, size):
        value = mixed(value[:-1] * _A + words.hash[k:] * _B) if len(value) > 1 else value[:0]
    count = np.diff(first)
    text = np.repeat(np.arange(len(count)), count)
    full = np.zeros(n, dtype=bool)
    full[: len(value)] = text[: len(value)] == text[n - len(value) :]
    extra_text = np.flatnonzero((count > 0) & (count < size))
    extra = np.zeros(len(extra_text), dtype=np.uint64)
    for i, t in enumerate(extra_text):
        h = count[t : t + 1].astype(np.uint64)
        for at in range(first[t], first[t + 1]):
            h = mixed(h * _B + words.hash[at : at + 1])
        extra[i] = h[0]
    value = np.concatenate([value[full[: len(value)]], extra])
    text = np.concatenate([text[full], extra_text])
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    keep = np.ones(len(value), dtype=bool)
    keep[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    value, text = value[keep], text[keep]
    return value, np.searchsorted(text, np.arange(len(count) + 1))


def differing(n: int, percent: int) -> int:
    """Shingles in which a set of size n and a partner may differ at most."""
    return n * (100 - percent) // percent


class Bands:
    """Size bands and their buckets."""

    def __init__(self, percent: int):
        self.percent = percent
        self.ratio = max(BAND, 100 / percent + 0.01)
        self.low = [1]

    def edge(self, k: int) -> int:
        while len(self.low) <= k:
            self.low.append(max(self.low[-1] + 1, int(self.low[-1] * self.ratio)))
        return self.low[k]

    def of(self, n: int) -> list[int]:
        k = 0
        while self.edge(k + 1) <= n:
            k += 1
        return [k, k + 1] if n * 100 // self.percent >= self.edge(k + 1) else [k]

    def buckets(self, k: int) -> int:
        need = differing(self.edge(k + 1) - 1, self.percent) + 1
        return need + need // 16

    def keys(self, values: np.ndarray) -> np.ndarray:
        """The region keys of a set, given as sorted hashes."""
        out = []
        for k in self.of(len(values)):
            m = self.buckets(k)
            bucket = ((values >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
            begin = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            held = np.add.reduceat(mixed(values), begin)
            seed = np.array([k + 1], dtype=np.uint64) * _A
            out.append(mixed(held + mixed((bucket[begin].astype(np.uint64) + np.uint64(1)) * _B + seed)))
            # agreement could be in empty buckets alone only if these are many
            if m - len(begin) >= m - differing(len(values), self.percent):
                empty = np.setdiff1d(np.arange(m), bucket[begin])
                out.append(mixed(mixed((empty.astype(np.uint64) + np.uint64(1)) * _A + seed)))
        return np.concatenate(out)


def _sets_of(batch: pa.RecordBatch, size: int, text: str = "text") -> Iterator[tuple[int, np.ndarray]]:
    for row, end, raw, offsets in pieces(*buffers(batch.column(text)), _PIECE):
        values, at = shingle_sets(raw, offsets, size)
        for i in range(end - row):
            yield row + i, values[at[i] : at[i + 1]]


def _summaries(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, one, two = np.zeros((3, batch.num_rows), dtype=np.uint64)
        for row, values in _sets_of(batch, size):
            n[row], one[row], two[row] = len(values), mixed(values).sum(), np.bitwise_xor.reduce(mixed(values * _A)) if len(values) else 0
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n": n.view(np.int64), "one": one.view(np.int64), "two": two.view(np.int64)})


def _region_rows(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    bands = Bands(percent)
    for batch in batches:
        ids = batch.column("doc_id").to_numpy()
        keys, docs, held = [], [], 0
        for row, values in _sets_of(batch, size):
            if len(values):
                keys.append(bands.keys(values))
                docs.append(np.full(len(keys[-1]), ids[row]))
                held += len(keys[-1])
            if held > 200_000:
                yield pa.RecordBatch.from_pydict({"region": np.concatenate(keys).view(np.int64), "doc_id": np.concatenate(docs)})
                keys, docs, held = [], [], 0
        if keys:
            yield pa.RecordBatch.from_pydict({"region": np.concatenate(keys).view(np.int64), "doc_id": np.concatenate(docs)})


def _shared_regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by region: those of regions with several members, named after their members where these are not many."""

    def settled(region: np.ndarray, doc: np.ndarray, whole: np.ndarray) -> pa.RecordBatch:
        begin = np.flatnonzero(np.r_[True, region[1:] != region[:-1]])
        count = np.diff(np.r_[begin, len(region)])
        members = np.add.reduceat(mixed(doc.view(np.uint64)), begin) + mixed(np.add.reduceat(mixed(doc.view(np.uint64) * _A), begin))
        name = np.where(whole[begin], members, region[begin].view(np.uint64))
        keep = np.repeat((count > 1) | ~whole[begin], count)
        rows = np.unique(np.stack([np.repeat(name, count)[keep].view(np.int64), doc[keep], np.repeat(count, count)[keep]], axis=1), axis=0)
        return pa.RecordBatch.from_pydict({"region": rows[:, 0], "doc_id": rows[:, 1], "members": rows[:, 2]})

    held: tuple[np.ndarray, np.ndarray] | None = None
    large = None
    for batch in batches:
        if not batch.num_rows:
            continue
        region, doc = batch.column("region").to_numpy(), batch.column("doc_id").to_numpy()
        if held is not None:
            region, doc = np.concatenate([held[0], region]), np.concatenate([held[1], doc])
        cut = int(np.searchsorted(region, region[-1]))
        if len(region) - cut >= HELD_ROWS:  # goes out in parts, under the region's own name
            whole = np.ones(len(region), dtype=bool)
            whole[cut:] = False
            if large is not None:
                whole[region == large] = False
            large = region[-1]
            yield settled(region, doc, whole)
            held = None
            continue
        if cut:
            yield settled(region[:cut], doc[:cut], region[:cut] != large if large is not None else np.ones(cut, dtype=bool))
        held = region[cut:], doc[cut:]
    if held is not None and len(held[0]):
        yield settled(*held, held[0] != large if large is not None else np.ones(len(held[0]), dtype=bool))


def _both_sets(batch: pa.RecordBatch, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The sets of each row's document and pivot."""
    pivots = [v for _, v in _sets_of(batch, size, "pivot_text")]
    for at, values in _sets_of(batch, size):
        yield values, pivots[at]


def _shared(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Which entries of one are in two; both sorted."""
    place = np.searchsorted(two, one)
    place[place == len(two)] = 0
    return two[place] == one if len(two) else np.zeros(len(one), dtype=bool)


def _alike(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    small, large = (one, two) if len(one) <= len(two) else (two, one)
    if 100 * len(small) < percent * len(large):
        return False
    shared = int(_shared(small, large).sum())
    return 100 * shared >= percent * (len(one) + len(two) - shared)


def sketch(values: np.ndarray, percent: int) -> np.ndarray:
    """A checksum of one byte for each of a power of two of ranges of the sorted hashes; over twice as many as partners differ in."""
    k = (2 * differing(len(values), percent) + 15).bit_length()
    out = np.zeros(1 << k, dtype=np.uint8)
    if len(values):
        at = (values >> np.uint64(64 - k)).astype(np.int64)
        begin = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        out[at[begin]] = np.bitwise_xor.reduceat((mixed(values) & np.uint64(255)).astype(np.uint8), begin)
    return out


def _folded(one: np.ndarray, size: int) -> np.ndarray:
    """A sketch over fewer ranges."""
    return np.bitwise_xor.reduce(one.reshape(size, -1), axis=1)


def may_link(one: np.ndarray, two: np.ndarray, n: int, m: int, percent: int) -> bool:
    """Whether sets of sizes n and m can be linked: ranges with other checksums differ in a shingle at least."""
    if 100 * min(n, m) < percent * max(n, m):
        return False
    size = min(len(one), len(two))
    return int(np.count_nonzero(_folded(one, size) != _folded(two, size))) * (100 + percent) <= (n + m) * (100 - percent)


def _stacked(made: list[np.ndarray]) -> np.ndarray:
    """Sketches of one region over the same ranges."""
    size = min(map(len, made))
    return np.stack([_folded(x, size) for x in made])


def _partners(stacked: np.ndarray, sizes: np.ndarray, k: int, percent: int) -> np.ndarray:
    """Which later members, sorted by size, may be linked with member k."""
    end = int(np.searchsorted(sizes * percent, 100 * sizes[k], side="right"))
    differ = np.count_nonzero(stacked[k + 1 : end] != stacked[k], axis=1)
    return k + 1 + np.flatnonzero(differ * (100 + percent) <= (sizes[k + 1 : end] + sizes[k]) * (100 - percent))


def _sketches(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, made = [], []
        for _, values in _sets_of(batch, size):
            n.append(len(values))
            made.append(sketch(values, percent).tobytes())
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n": pa.array(n, pa.int64()), "sketch": pa.array(made, pa.binary())})


def _possible(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs of member and pivot that their sketches don't rule out."""
    for batch in batches:
        if batch.num_rows:
            n, m = batch.column("n").to_pylist(), batch.column("pivot_n").to_pylist()
            one, two = ([np.frombuffer(x, np.uint8) for x in batch.column(c).to_pylist()] for c in ("sketch", "pivot_sketch"))
            keep = [may_link(*x, percent) for x in zip(one, two, n, m, strict=True)]
            yield batch.select(["doc_id", "pivot"]).filter(pa.array(keep, pa.bool_()))


def _with_partner(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by region: members that sketches allow a link with a member of another component."""
    held: pa.RecordBatch | None = None

    def kept(part: pa.RecordBatch) -> pa.RecordBatch:
        region, component, n = (part.column(c).to_numpy() for c in ("region", "component", "n"))
        made = [np.frombuffer(x, np.uint8) for x in part.column("sketch").to_pylist()]
        keep = np.zeros(len(region), dtype=bool)
        begin = np.flatnonzero(np.r_[True, region[1:] != region[:-1]])
        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(region)], strict=True):
            order = a + np.argsort(n[a:b], kind="stable")
            stacked, sizes, own = _stacked([made[i] for i in order]), n[order], component[order]
            for k in range(b - a):
                partners = _partners(stacked, sizes, k, percent)
                partners = partners[own[partners] != own[k]]
                if len(partners):
                    keep[order[k]] = True
                    keep[order[partners]] = True
        return part.select(["region", "doc_id", "pivot", "component", "n"]).filter(pa.array(keep))

    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.concat_batches([held, batch])
        region = batch.column("region").to_numpy()
        cut = int(np.searchsorted(region, region[-1]))
        if cut:
            yield kept(batch.slice(0, cut))
        held = batch.slice(cut)
    if held is not None:
        yield kept(held)


def _linked(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs of member and pivot that are linked."""
    for batch in batches:
        if batch.num_rows:
            linked = pa.array([_alike(x, p, percent) for x, p in _both_sets(batch, size)], pa.bool_())
            yield pa.RecordBatch.from_pydict({"a": batch.column("doc_id"), "b": batch.column("pivot")}).filter(linked)


def _differences(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """What each member has that its pivot lacks, what it lacks, and how long a prefix of the two must be."""
    for batch in batches:
        own, missing, most = [], [], []
        for x, p in _both_sets(batch, size) if batch.num_rows else ():
            own.append(x[~_shared(x, p)].view(np.int64))
            missing.append(p[~_shared(p, x)].view(np.int64))
            most.append(differing(len(x), percent) + 1)
        kind = pa.list_(pa.int64())
        yield pa.RecordBatch.from_pydict({"pivot": batch.column("pivot"), "doc_id": batch.column("doc_id"), "own": pa.array(own, kind), "missing": pa.array(missing, kind), "most": pa.array(most, pa.int32())})


def _join_inside(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Links between components inside regions of few members; rows come sorted by region."""
    held: pa.RecordBatch | None = None

    def joined(part: pa.RecordBatch) -> pa.RecordBatch:
        region, ids = part.column("region").to_numpy(), part.column("doc_id").to_numpy()
        component = part.column("component").to_numpy()
        sets = [v for _, v in _sets_of(part, size)]
        links = []
        begin = np.flatnonzero(np.r_[True, region[1:] != region[:-1]])
        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(region)], strict=True):
            order = np.array(sorted(range(a, b), key=lambda i: len(sets[i])))
            sizes, now = np.array([len(sets[i]) for i in order]), component[order].copy()
            stacked = _stacked([sketch(sets[i], percent) for i in order])
            for k, i in enumerate(order):
                for j in _partners(stacked, sizes, k, percent):
                    if now[j] != now[k] and _alike(sets[i], sets[order[j]], percent):
                        links.append((ids[i], ids[order[j]]))
                        now[now == now[j]] = now[k]
        return pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.concat_batches([held, batch])
        region = batch.column("region").to_numpy()
        cut = int(np.searchsorted(region, region[-1]))
        if cut:
            yield joined(batch.slice(0, cut))
        held = batch.slice(cut)
    if held is not None:
        yield joined(held)


def _meeting(rows: DataFrame) -> DataFrame:
    """Members of regions that have several; regions with the same members are one."""
    dealt = rows.repartition("region").sortWithinPartitions("region")
    return dealt.mapInArrow(lean(_shared_regions), "region long, doc_id long, members long").distinct()


def _drop_all(tables: list[DataFrame]) -> None:
    """Deletes what no later plan reads; a table that was never written has no files."""
    for table in tables:
        drop(table)


def _semi(docs: DataFrame, ids: DataFrame, n: int, how: str) -> DataFrame:
    return docs.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, "doc_id", how)


def jaccard_components(docs: DataFrame, *, shingle: int = 3, percent: int = 90, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles and component_id (the least id reachable by links) of each document.

    Linked are documents whose shingle sets have ``100 * shared >= percent * union``.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null")
    summaries = "doc_id long, n long, one long, two long"
    all_docs = saved(docs.mapInArrow(lean(lambda batches: _summaries(batches, shingle)), summaries), "set-sums")
    ids_of_rows = all_docs.select("doc_id")
    whole_set = F.struct("n", "one", "two")
    several_rows = all_docs.groupBy("doc_id").agg(F.count("*").alias("rows"), F.min(whole_set).alias("low"), F.max(whole_set).alias("high")).filter("rows > 1")
    several_rows = saved(several_rows.select("doc_id", (F.col("low") != F.col("high")).alias("unlike")), "repeated-ids")
    unlike = several_rows.filter("unlike").select("doc_id")
    ids_repeat = several_rows.limit(1).count() > 0
    if n_unlike := unlike.count():  # ids with several texts: the first of these in order counts
        chosen = saved(_semi(docs, unlike, n_unlike, "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")), "chosen-texts")
        docs = _semi(docs, unlike, n_unlike, "left_anti").unionByName(chosen)
        again = chosen.mapInArrow(lean(lambda batches: _summaries(batches, shingle)), summaries)
        all_docs = saved(_semi(all_docs, unlike, n_unlike, "left_anti").unionByName(again), "set-sums")
    same = all_docs.filter("n > 0").groupBy("n", "one", "two").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).filter("rep < last")
    # a set that a third of all documents have is dealt to several tasks
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt")
    salted = same.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    copies = saved(all_docs.select("*", salt).join(salted, ["n", "one", "two", "salt"]).filter("doc_id <> rep").select("doc_id", "rep").distinct(), "set-copies")
    apart = all_docs.filter("n = 0").select("doc_id").unionByName(copies.select("doc_id"))
    singles = _semi(docs, apart, apart.count(), "left_anti")
    rows = singles.mapInArrow(lean(lambda batches: _region_rows(batches, shingle, percent)), "region long, doc_id long")
    regions = saved(_meeting(rows), "regions")

    ids = saved(regions.select("doc_id").distinct(), "candidates")
    texts = _semi(docs, ids, ids.count(), "left_semi")
    texts = saved(texts.dropDuplicates(["doc_id"]) if ids_repeat else texts, "candidate-texts")

    def with_texts(pairs: DataFrame) -> DataFrame:
        of_pivot = texts.select(F.col("doc_id").alias("pivot"), F.col("text").alias("pivot_text"))
        return pairs.join(texts, "doc_id").join(of_pivot, "pivot").select("pivot", "doc_id", "text", "pivot_text")

    sketches = saved(texts.mapInArrow(lean(lambda batches: _sketches(batches, shingle, percent)), "doc_id long, n long, sketch binary"), "sketches")

    def possible(pairs: DataFrame) -> DataFrame:
        of_pivot = sketches.select(F.col("doc_id").alias("pivot"), F.col("n").alias("pivot_n"), F.col("sketch").alias("pivot_sketch"))
        return pairs.join(sketches, "doc_id").join(of_pivot, "pivot").mapInArrow(lean(lambda batches: _possible(batches, percent)), "doc_id long, pivot long")

    def placed(members: DataFrame, *more: str) -> DataFrame:
        known = found.select(F.col("node").alias("doc_id"), "component")
        return members.join(known, "doc_id", "left").select("region", "doc_id", *more, F.coalesce("component", "doc_id").alias("component"))

    def joined(known: DataFrame | None, links: DataFrame) -> DataFrame:
        """Components with more links."""
        if known is None:
            return components(links)
        if not links.limit(1).count():
            return known
        stars = known.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        after = components(stars.unionByName(links))
        drop(known)
        return after

    asked = docs.sparkSession.createDataFrame([], "doc_id long, pivot long")
    found = None
    while True:
        # the pivot: the member that meets most others in its regions
        degree = regions.groupBy("doc_id").agg(F.sum("members").alias("degree"))
        pivots = regions.join(degree, "doc_id").groupBy("region").agg(F.max(F.struct("degree", (-F.col("doc_id")).alias("least"))).alias("top")).select("region", (-F.col("top.least")).alias("pivot"))
        members = saved(regions.join(pivots, "region").select("region", "doc_id", "pivot"), "members")
        pairs = members.select("doc_id", "pivot").unionByName(asked).filter("doc_id <> pivot").distinct()
        pairs = saved(possible(pairs), "possible-pairs")
        links = saved(with_texts(pairs).mapInArrow(lean(lambda batches: _linked(batches, shingle, percent)), "a long, b long"), "links")
        found = joined(found, links)
        # regions whose members are not all in one component
        now = saved(placed(members, "pivot"), "placed")
        several = now.groupBy("region").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).filter("low < high")
        several = saved(several.select("region", "n"), "open-regions")
        spent = [pairs, links, members, now, several]
        if not several.limit(1).count():
            _drop_all(spent)
            break
        open_ = now.join(several.filter(F.col("n") <= SKETCHED_INSIDE).select("region"), "region").join(sketches, "doc_id").select("region", "doc_id", "pivot", "component", "n", "sketch")
        open_ = open_.repartition("region").sortWithinPartitions("region").mapInArrow(lean(lambda batches: _with_partner(batches, percent)), "region long, doc_id long, pivot long, component long, n long")
        open_ = saved(open_, "open-members")
        fits = (F.count("*") <= JOINED_INSIDE) & ((F.sum("n") <= HELD_SHINGLES) | (F.count("*") <= FEW))
        sizes = open_.groupBy("region").agg(fits.alias("fits"))
        small = open_.join(sizes.filter("fits").select("region"), "region").select("region", "doc_id", "component")
        small_ids = saved(small.select("doc_id").distinct(), "open-ids")
        small = small.join(_semi(texts, small_ids, small_ids.count(), "left_semi"), "doc_id").select("region", "doc_id", "component", "text")
        inside = small.repartition("region").sortWithinPartitions("region").mapInArrow(lean(lambda batches: _join_inside(batches, shingle, percent)), "a long, b long")
        inside = saved(inside, "links")
        found = joined(found, inside)
        spent += [open_, inside, small_ids]
        if several.agg(F.max("n")).first()[0] <= SKETCHED_INSIDE and sizes.agg(F.min("fits")).first()[0] is not False:
            _drop_all(spent)
            break
        large = several.filter(F.col("n") > SKETCHED_INSIDE).select("region")
        large_left = sizes.filter("not fits").select("region")
        apart_rows = now.join(large, "region").select("pivot", "doc_id").unionByName(open_.join(large_left, "region").select("pivot", "doc_id"))
        # differences of the members of large regions to what most around their pivot hold
        apart_pairs = apart_rows.filter("doc_id <> pivot").distinct()
        differ = saved(with_texts(apart_pairs).mapInArrow(lean(lambda batches: _differences(batches, shingle, percent)), "pivot long, doc_id long, own array<long>, missing array<long>, most int"), "differences")
        around = differ.groupBy("pivot").agg(F.count("*").alias("n"))
        each = differ.select("pivot", F.explode("own").alias("e"), F.lit(True).alias("is_own")).unionByName(differ.select("pivot", F.explode("missing").alias("e"), F.lit(False).alias("is_own")))
        usual = each.groupBy("pivot", "e", "is_own").agg(F.count("*").alias("m")).join(around, "pivot").filter(2 * F.col("m") > F.col("n"))
        none = F.array().cast("array<long>")
        usual = usual.groupBy("pivot").agg(F.collect_list(F.when(F.col("is_own"), F.col("e"))).alias("more"), F.collect_list(F.when(~F.col("is_own"), F.col("e"))).alias("less"))
        centred = differ.join(usual, "pivot", "left").withColumns({"more": F.coalesce("more", none), "less": F.coalesce("less", none)})
        centred = centred.select(
            "pivot", "doc_id", "most", (100 * F.size("more") + percent * F.size("less")).alias("pivot_weight"),
            F.concat(F.array_except("own", "more"), F.array_except("less", "missing")).alias("own"),
            F.concat(F.array_except("missing", "less"), F.array_except("more", "own")).alias("missing"),
        )
        centred = saved(centred.withColumn("weight", 100 * F.size("missing") + percent * F.size("own")), "centred")
        nearest = centred.groupBy("pivot").agg(F.min(F.struct("weight", "doc_id")).alias("top"), F.max("pivot_weight").alias("pivot_weight"))
        nearest = nearest.filter(F.col("top.weight") < F.col("pivot_weight")).select("pivot", F.col("top.doc_id").alias("nearest"))
        asked = saved(centred.join(nearest, "pivot").select("doc_id", F.col("nearest").alias("pivot")).distinct(), "asked")
        prefix = F.slice(F.concat(F.sort_array("own"), F.sort_array("missing")), F.lit(1), F.col("most"))
        parts = centred.select("pivot", "doc_id", F.explode(prefix).alias("e")).select(F.xxhash64("pivot", "e").alias("region"), "doc_id")
        spent += [regions, differ, centred]
        regions = saved(_meeting(parts), "regions")
        _drop_all(spent)
    _drop_all([regions, ids, texts, sketches])

    direct = all_docs.join(copies, "doc_id", "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep"))
    if n_unlike:
        direct = ids_of_rows.join(direct.distinct(), "doc_id")
    return direct.join(found, direct.rep == found.node, "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))


def one_of_each(docs: DataFrame, *, shingle: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without all but the least id of each group of near copies."""
    groups = jaccard_components(docs, shingle=shingle, percent=percent, text=text, doc_id=doc_id)
    gone = saved(groups.filter("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct(), "near-copies")
    n = gone.count()
    return docs.join(F.broadcast(gone) if n <= BROADCAST_IDS else gone, docs[doc_id] == gone["__gone"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: components of all documents at 3-word shingles and similarity 0.9."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
