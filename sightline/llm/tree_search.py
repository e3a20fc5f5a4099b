"""Operator 2: nearest neighbours with a hierarchical k-means tree, best bin first.

The tree is fitted on a bounded sample; every vector goes to one leaf. A query walks the
tree with a priority queue of nodes by centre distance and notes the leaves in the order
that it reaches them. How many it visits is calibrated: a bounded, stated set of queries
is answered exactly against all rows, and visits widen until the mean recall of these
reaches ``TARGET_RECALL``. Visited leaves are searched exactly.

Scale: the tree goes to the executors, where every vector finds its leaf and every query its
leaves. Vectors and visits are dealt once by leaf and, where a leaf or its visitors are many, by blocks of both, so
a leaf that a third of all rows are in is spread. A window ranks what the blocks found for a query.
The driver holds the sample, the tree, a number per leaf and the calibrating queries only. There are
``SAMPLE // SAMPLE_PER_LEAF`` leaves at most; beyond two million rows a query's work grows with the rows of its leaves.
Distances are screened by matrix products with a margin for rounding, then computed on
the original components in double precision, so ties are exact and go to the smaller id.

Defined cases: vectors that are null, zero, or hold null or non-finite components take
no part, nor do those of another dimension than most; a query with fewer candidates than
``k`` gets them all; an empty table gives no rows; repeated ids are one row each, and a
query never meets rows of its own id; rows without an id take no part; other columns are unused.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.llm.batches import lean
from sightline.llm.store import saved

#: Rows that the tree is fitted on at most; with ``SAMPLE_PER_LEAF`` it sets the most leaves.
SAMPLE = 40_000
BRANCH = 12
#: Rows per leaf aimed at, as far as the sample can tell leaves apart.
LEAF_ROWS, SAMPLE_PER_LEAF = 400, 8
#: Rows of a leaf, and queries that visit it, that meet in one task; queries that are compared at a time.
BLOCK_ROWS, QUERY_BLOCK, QUERY_SLICE = 2_000, 4_000, 512
CALIBRATING, TARGET_RECALL = 64, 0.97


def usable(vector: str) -> Column:
    """Whether a vector takes part, but for its dimension."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


class Tree:
    """Centres of a k-means tree; ``children[node]`` are node numbers, none for a leaf."""

    def __init__(self, sample: np.ndarray, leaves: int, seed: int = 1):
        self.centre, self.children, self.leaf = [sample.mean(axis=0)], [[]], {}
        random = np.random.default_rng(seed)
        least = max(2, len(sample) // max(1, leaves))
        todo = [(0, np.arange(len(sample)))] if leaves > 1 else []
        while todo:
            node, rows = todo.pop()
            if len(rows) <= least:
                continue
            centres, nearest = _kmeans(sample[rows], min(BRANCH, -(-len(rows) // least)), random)
            if len(centres) < 2:
                continue
            for i, c in enumerate(centres):
                self.centre.append(c)
                self.children.append([])
                self.children[node].append(len(self.centre) - 1)
                todo.append((len(self.centre) - 1, rows[nearest == i]))
        for node, below in enumerate(self.children):
            if not below:
                self.leaf[node] = len(self.leaf)
        self.below = [np.array(self.centre)[x] if x else None for x in self.children]

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector: the nearest child, level by level."""
        out, todo = np.zeros(len(vectors), dtype=np.int32), [(0, np.arange(len(vectors)))]
        while todo:
            node, rows = todo.pop()
            if not self.children[node]:
                out[rows] = self.leaf[node]
                continue
            nearest = _squares(vectors[rows], self.below[node]).argmin(axis=1)
            todo += [(child, rows[nearest == i]) for i, child in enumerate(self.children[node]) if (nearest == i).any()]
        return out

    def order(self, query: np.ndarray, enough) -> list[int]:
        """Leaves best bin first, until ``enough(leaves so far)``."""
        queue, found = [(0.0, 0)], []
        while queue and not enough(found):
            _, node = heapq.heappop(queue)
            if not self.children[node]:
                found.append(self.leaf[node])
                continue
            away = ((self.below[node] - query) ** 2).sum(axis=1)
            for d, child in zip(away.tolist(), self.children[node], strict=True):
                heapq.heappush(queue, (d, child))
        return found


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T


def _kmeans(x: np.ndarray, k: int, random: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    centres = np.unique(x[random.choice(len(x), k, replace=False)], axis=0)
    for _ in range(rounds):
        nearest = _squares(x, centres).argmin(axis=1)
        there = np.unique(nearest)
        centres = np.stack([x[nearest == i].mean(axis=0) for i in there])
    nearest = _squares(x, centres).argmin(axis=1)
    there, nearest = np.unique(nearest, return_inverse=True)
    return centres[there], nearest


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(column), -1)


def _assign(batches: Iterator[pa.RecordBatch], tree: Tree) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            leaf = pa.array(tree.assign(_matrix(batch.column("vector"))), pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "vector", "asks")), leaf], names=["vec_id", "vector", "asks", "leaf"])


def _best(query: np.ndarray, away: np.ndarray, vec_id: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k nearest of each query, nearest first, ties to the smaller id."""
    order = np.lexsort((vec_id, away, query))
    first = np.flatnonzero(np.r_[True, np.diff(query[order]) != 0])
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
    return order[rank < k]


def _nearest_rows(ids: np.ndarray, queries: np.ndarray, vec_id: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest rows of each query: positions of queries and of rows, and distances.

    Matrix products screen with a margin for rounding; what passes is computed on the original components.
    """
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for low in range(0, len(ids), QUERY_SLICE):
        q, own = queries[low : low + QUERY_SLICE], ids[low : low + QUERY_SLICE, None]
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for first in range(0, len(rows), BLOCK_ROWS):
            x, there = rows[first : first + BLOCK_ROWS], vec_id[first : first + BLOCK_ROWS]
            near = _squares(q, x)
            near[own == there] = np.inf
            limit = np.partition(near, k - 1, axis=1)[:, k - 1] if len(x) > k else np.full(len(q), np.inf)
            i, j = np.nonzero((near <= (limit + 1e-9 * ((q * q).sum(axis=1) + (x * x).sum(axis=1).max()))[:, None]) & (own != there))
            parts = len(i) // 20_000 + 1
            away = np.concatenate([np.sqrt(((q[a] - x[b]) ** 2).sum(axis=1)) for a, b in zip(np.array_split(i, parts), np.array_split(j, parts), strict=True)])
            best = tuple(np.concatenate(z) for z in zip(best, (i, first + j, away), strict=True))
            keep = _best(best[0], best[2], vec_id[best[1]], k)
            best = tuple(z[keep] for z in best)
        found.append((low + best[0], best[1], best[2]))
    return tuple(np.concatenate(z) for z in zip(*found, strict=True))


def _everywhere(batches: Iterator[pa.RecordBatch], ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The k nearest rows of each batch for a bounded set of queries, with their leaves."""
    for batch in batches:
        if batch.num_rows:
            vec_id = batch.column("vec_id").to_numpy()
            i, j, away = _nearest_rows(ids, queries, vec_id, _matrix(batch.column("vector")), k)
            yield pa.RecordBatch.from_pydict({"query_id": ids[i], "score": away, "vec_id": vec_id[j], "leaf": batch.column("leaf").to_numpy()[j]})


def _visits(batches: Iterator[pa.RecordBatch], tree: Tree, count: dict[int, int], visits: int, k: int) -> Iterator[pa.RecordBatch]:
    """A row for each leaf that a query visits."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rows, leaves = [], []
        for row, q in enumerate(_matrix(batch.column("vector"))):
            mine = tree.order(q, lambda found: len(found) >= visits and sum(count.get(x, 0) for x in found) > k)
            rows += [row] * len(mine)
            leaves += mine
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(rows, pa.int64())) for c in ("vec_id", "vector")), pa.array(leaves, pa.int32())], names=["query_id", "vector", "leaf"])


def _search(rows: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    """The k nearest rows of a block of a leaf for the queries that visit it."""
    if not rows.num_rows or not asked.num_rows:
        return pa.table({"query_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64()), "vec_id": pa.array([], pa.int64())})
    ids, vec_id = asked.column("query_id").to_numpy(), rows.column("vec_id").to_numpy()
    i, j, away = _nearest_rows(ids, _matrix(asked.column("vector").combine_chunks()), vec_id, _matrix(rows.column("vector").combine_chunks()), k)
    return pa.table({"query_id": ids[i], "score": away, "vec_id": vec_id[j]})


def _ranked(found: DataFrame, k: int) -> DataFrame:
    window = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def _per_leaf(df: DataFrame) -> dict[int, int]:
    """Rows of each leaf; there are no more leaves than ``SAMPLE // SAMPLE_PER_LEAF``."""
    return {r["leaf"]: r["n"] for r in df.groupBy("leaf").agg(F.count("*").alias("n")).collect()}


def nearest(vectors: DataFrame, queries: Column, *, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", target_recall: float = TARGET_RECALL) -> DataFrame:
    """The k nearest rows of each row for which ``queries`` holds: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    rows = vectors.filter(usable(vector)).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks")).filter("vec_id is not null")
    sizes = {r["d"]: r["n"] for r in rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()}
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    (dimension, n), = sizes.items()
    rows = rows.filter(F.size("vector") == dimension)
    if rows.filter("asks").isEmpty():  # no row asks
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = rows.select("vector").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    sample = np.array([r["vector"] for r in sample], dtype=np.float64)
    tree = Tree(sample, min(n // LEAF_ROWS, len(sample) // SAMPLE_PER_LEAF))
    held = spark.sparkContext.broadcast(tree)
    kind = rows.schema["vector"].dataType.simpleString()
    assigned = saved(rows.mapInArrow(lean(lambda batches: _assign(batches, held.value)), f"vec_id long, vector {kind}, asks boolean, leaf int"), "tree-leaves")
    count, asks = _per_leaf(assigned), assigned.filter("asks").select("vec_id", "vector")

    # calibration: leaf ranks of true neighbours for a bounded set of queries
    chosen = asks.orderBy(F.xxhash64("vec_id"), "vec_id").limit(CALIBRATING).collect()
    ids, asked_vectors = np.array([r["vec_id"] for r in chosen], dtype=np.int64), np.array([r["vector"] for r in chosen], dtype=np.float64).reshape(len(chosen), -1)
    true: dict[int, list[int]] = {}
    everywhere = assigned.mapInArrow(lean(lambda batches: _everywhere(batches, ids, asked_vectors, k)), "query_id long, score double, vec_id long, leaf int")
    for r in _ranked(everywhere, k).collect() if chosen else []:
        true.setdefault(r["query_id"], []).append(r["leaf"])
    ranks = []
    for r in chosen:
        place = {leaf: i for i, leaf in enumerate(tree.order(np.array(r["vector"]), lambda found: False))}
        ranks += [place[leaf] for leaf in true.get(r["vec_id"], [])]
    visits = 1
    while visits < len(tree.leaf) and np.mean(np.array(ranks) < visits) < target_recall:
        visits += max(1, visits // 8)

    # every query walks the tree where it lies; leaves and their visitors meet in blocks of both
    asked = saved(asks.mapInArrow(lean(lambda batches: _visits(batches, held.value, count, visits, k)), f"query_id long, vector {kind}, leaf int"), "tree-visits")
    visitors = _per_leaf(asked)
    blocks = spark.createDataFrame([(leaf, -(-m // BLOCK_ROWS), max(1, -(-visitors.get(leaf, 0) // QUERY_BLOCK))) for leaf, m in count.items()], "leaf int, blocks long, parts int")
    dealt = assigned.join(F.broadcast(blocks), "leaf").withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    meeting = asked.join(F.broadcast(blocks), "leaf").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("part", F.pmod(F.xxhash64("query_id"), "parts").cast("int"))
    key = ("leaf", "block", "part")
    left = dealt.select(*key, "vec_id", "vector").groupBy(*key)
    found = left.cogroup(meeting.select(*key, "query_id", "vector").groupBy(*key)).applyInArrow(lambda x, q: _search(x, q, k), "query_id long, score double, vec_id long")
    return _ranked(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: the 10 nearest vectors of each row whose id is divisible by 100."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)
