"""Operator 12: audit of how filters interact, over all orders in which they can be applied.

Each document gets a bit for each filter it fails. What a filter removes at its step depends
only on which filters stood before it, so counts are kept by part and bits, turned into
counts by filter and set of earlier filters (80 for five), and only these small tables are spread over the
120 orders.

Duplicates are found by partition refinement. All documents are split by their length in code points, the
classes then by the hash of a block of text after another, each block eight times as long as the one before;
classes of one document are dropped after each split, so few rows see the later ones. What is left
is compared by its full text: texts of a class are aggregated as keys, which compares them byte
by byte, and of equal ones all but the least id fail. A class in which texts differ all the same (equal hashes)
is settled text by text.

Scale: one pass over the texts takes bits, length and block hashes; refinement works on
these alone. Only texts of classes that are left are shuffled, after equal ones of a task have become one
row. Counts by class, label and bits are aggregated before each shuffle; joins on a
class have one row a class on one side, and Spark splits a hot one. Everything is built-in expressions.

Defined cases: a null text is empty and has the words, letters and marks of an empty one; a null source is the part
of the empty string. A row without an id is no duplicate and makes none; it fails other filters
as usual. Rows that repeat an id count as often as they stand; with equal texts they aren't duplicates of
each other, having no smaller id. Several labels of an id count as good or toxic if one does. An empty table has no parts and gives no rows.
Very long texts are never cut; their words stand in one array while they are counted.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.llm.store import drop, saved

#: Letters of the filters, in the order of their bits; E is that of duplicates.
FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = 50, 65, 5, r"[#$%&*|]"
#: Code points of the first block, and how many times longer each next one is.
BLOCK, LONGER = 64, 8
#: Classes up to which the table of them is broadcast instead of joined by a shuffle: some 32 MB.
BROADCAST_CLASSES = 1_000_000

#: Begins of blocks; the last is beyond the longest string that there can be.
_BEGINS = [BLOCK * (LONGER**k - 1) // (LONGER - 1) for k in range(10)]


def failures(text: Column) -> Column:
    """Bits of filters A to D: few words, few distinct ones, many capitals, marks."""
    words = F.array_remove(F.split(text, r"[ \t\n\x0B\f\r]+"), "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    # the array is made once and seen by both counts
    counts = F.transform(F.array(words), lambda w: F.when(F.size(w) < LEAST_WORDS, 1).otherwise(0) + F.when(100 * F.size(F.array_distinct(w)) < LEAST_DISTINCT * F.size(w), 2).otherwise(0))
    return counts[0] + F.when(100 * capitals > MOST_CAPITALS * F.length(text), 4).otherwise(0) + F.when(text.rlike(MARKS), 8).otherwise(0)


def block_hashes(text: Column, hashed: Callable[..., Column] = F.xxhash64) -> Column:
    begins = F.filter(F.array(*map(F.lit, _BEGINS)), lambda s: s < F.length(text))
    return F.transform(begins, lambda s: hashed(F.substring(text, s + 1, s * (LONGER - 1) + BLOCK)))


def class_of(length: Column, blocks: Column, hashed: Callable[..., Column] = F.xxhash64) -> Column:
    """The class after all blocks: that of the length, split by one block's hash after the other."""
    return F.aggregate(blocks, hashed(length), lambda c, b: hashed(c, b))


def repeated_classes(rows: DataFrame, hashed: Callable[..., Column] = F.xxhash64) -> DataFrame:
    """``last``: the classes that hold several rows after every split. ``rows`` has length, blocks and last."""
    left = rows.groupBy("length", "last").agg(F.any_value("blocks").alias("blocks"), F.count("*").alias("n"))  # copies are one row from here on
    left = saved(left.select(hashed(F.col("length")).alias("class"), "blocks", "last", "n"), "refined")
    for k in range(left.agg(F.coalesce(F.max(F.size("blocks")), F.lit(0))).first()[0]):
        several = saved(left.groupBy("class").agg(F.sum("n").alias("rows")).filter("rows > 1").select("class"), "several")
        split = F.when(F.size("blocks") > k, hashed(F.col("class"), F.get("blocks", F.lit(k)))).otherwise(F.col("class"))
        finer = saved(left.join(several, "class").select(split.alias("class"), "blocks", "last", "n"), "refined")
        drop(several)
        drop(left)
        left = finer
    return left.groupBy("class").agg(F.sum("n").alias("rows")).filter("rows > 1").select(F.col("class").alias("last"))


def _with_classes(docs: DataFrame, classes: DataFrame, how: str = "inner") -> DataFrame:
    small = classes.count() <= BROADCAST_CLASSES
    return docs.join(F.broadcast(classes) if small else classes, "last", how)


def mark_duplicates(rows: DataFrame, texts: DataFrame, hashed: Callable[..., Column] = F.xxhash64) -> DataFrame:
    """``rows`` (doc_id, length, blocks, last and others) with ``duplicate``: the text is that of a smaller id too.

    ``texts`` has the same documents' doc_id, last and text.
    """
    classes = saved(repeated_classes(rows.filter("doc_id is not null"), hashed), "classes")
    held = _with_classes(texts.filter("doc_id is not null"), classes)
    least = held.groupBy("last", "text").agg(F.min("doc_id").alias("least")).groupBy("last").agg(F.min("least").alias("least"), F.count("*").alias("n_texts"))
    least = saved(least, "least-ids")
    drop(classes)
    mixed = least.filter("n_texts > 1").select("last")
    marked = _with_classes(rows, least.filter("n_texts = 1").select("last", "least"), "left")
    duplicate = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    if mixed.isEmpty():
        return marked.withColumn("duplicate", duplicate).drop("least")
    # equal hashes of unlike texts: these texts are compared one by one
    held = _with_classes(texts.filter("doc_id is not null"), mixed)
    firsts = held.groupBy("last", "text").agg(F.min("doc_id").alias("own_least"))
    later = held.join(firsts, ["last", "text"]).filter("doc_id > own_least").select("doc_id", "last").distinct().withColumn("later", F.lit(True))
    return marked.join(later, ["doc_id", "last"], "left").withColumn("duplicate", duplicate | F.coalesce("later", F.lit(False))).drop("least", "later")


def masks(docs: DataFrame, labels: DataFrame | None = None, *, hashed: Callable[..., Column] = F.xxhash64) -> DataFrame:
    """``doc_id``, ``part``, ``mask`` (a bit for each filter failed), ``good`` and ``toxic`` of each row of doc_id, text and source."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    cut = docs.select("doc_id", "part", "text", F.length("text").alias("length"), block_hashes(F.col("text"), hashed).alias("blocks"))
    cut = cut.withColumn("last", class_of(F.col("length"), F.col("blocks"), hashed))
    rows = saved(cut.select("doc_id", "part", "length", "blocks", "last", failures(F.col("text")).alias("fails")), "filter-rows")
    marked = mark_duplicates(rows, cut.select("doc_id", "last", "text"), hashed)
    out = marked.select("doc_id", "part", (F.col("fails") + F.when(F.col("duplicate"), 16).otherwise(0)).alias("mask"))
    if labels is None:
        return out.withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    said = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", F.col("toxic").alias("abuse"))
    said = said.groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("abuse") == 1, F.lit(False))).alias("toxic"))
    return out.join(said, "doc_id", "left").fillna(False, ["good", "toxic"])


def _steps(spark: SparkSession) -> DataFrame:
    """Each order's steps: the filter there, and the bits of those before it. 600 rows for five filters."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(order):
            rows.append((f, before, "".join(FILTERS[k] for k in order), step + 1))
            before |= 1 << f
    return spark.createDataFrame(rows, "filter int, before int, filter_order string, step int")


def interactions(masked: DataFrame) -> DataFrame:
    """For each part, order and step what the filter there keeps, removes and shares with others."""
    n = len(FILTERS)
    counts = masked.groupBy("part", "mask", "good", "toxic").agg(F.count("*").alias("n"))
    # every filter with every set of the others before it
    sets = counts.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n * (1 << n - 1) - 1)))).selectExpr(
        "*", f"k div {1 << n - 1} AS filter", f"k % {1 << n - 1} AS others"
    ).selectExpr(
        "part", "n", "good", "toxic", "mask", "int(filter) AS filter", "int((others & (shiftleft(1, int(filter)) - 1)) | shiftleft(shiftright(others, int(filter)), int(filter) + 1)) AS before", "shiftleft(1, int(filter)) AS bit"
    )
    fails, early = "(mask & bit) <> 0", "(mask & before) <> 0"
    total = lambda said, name: F.expr(f"sum(if({said}, n, 0L))").alias(name)
    found = sets.groupBy("part", "filter", "before").agg(
        total(f"(mask & bit) = 0 AND NOT {early}", "kept"), total(f"{fails} AND NOT {early}", "removed"), total(f"{fails} AND {early}", "redundant"), total("mask = bit", "unique_fails"),
        total(f"{fails} AND NOT {early} AND good", "good_lost"), total(f"{fails} AND NOT {early} AND toxic", "toxic_lost"),
    )
    orders = F.array(*(F.lit(math.factorial(k) * math.factorial(n - 1 - k)) for k in range(n)))  # in which so many filters stand before this one
    weighed = F.col("removed") * F.get(orders, F.bit_count("before"))
    found = found.withColumn("shapley", F.sum(weighed).over(Window.partitionBy("part", "filter")))
    counted = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return found.join(F.broadcast(_steps(masked.sparkSession)), ["filter", "before"]).select("part", "filter_order", "step", *(F.col(c).cast("long").alias(c) for c in counted))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: five filters in all 120 orders, for each source."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return interactions(masks(docs, labels))
