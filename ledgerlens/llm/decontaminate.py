"""Benchmark decontamination with SimHash windows and Hamming blocks (DataFrame functions only).

Method: an item of m words is looked for in windows of m words. A window's
SimHash - bit b is set if over half of its shingle hashes have it - is split
into ``RADIUS + 1`` blocks; two fingerprints that differ in at most ``RADIUS`` bits
agree in one block at least, so an equality join on the blocks (a multi-index)
finds every pair within the radius. Candidates are verified exactly: weighted
Jaccard similarity of the shingles, each weighted by how often it occurs in
window and item, of ``similarity`` or more.

Which windows: one that holds no shingle of the item has similarity 0, and a
window that does not begin with one does not get worse when it moves up to the
next. So the windows that begin with a shingle of some item of their size (at
the end of a text: the last one that fits) hold the best window of every pair,
and the others need no fingerprint. Where they are is all that the shingles
tell: a window is not paired with an item but by the index. (Fingerprints of
all windows of all sizes would take some forty 64-bit sums a word.) Windows
with the same content are fingerprinted and compared once, however many texts
hold the passage.

Words: maximal runs of letters and numbers, lower-cased; shingles: five words
(an item of fewer words is one shingle). The benchmark side of each join is
left to Spark to broadcast by its size, else both sides are shuffled by hash.

Defined results: null and empty texts and items match nothing, as do items
without words. Rows that repeat id and text count once. Null ids are reported as
null. Other columns are not read (``drop_contaminated`` passes them through).
An empty table on either side gives
an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import free_name, written

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 23  # bits; at similarity 0.8 about 10 of 64 differ


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")


def _shingles(words: Column, width: int) -> Column:
    """Hash of each run of ``width`` words."""
    at = F.sequence(F.lit(0), F.size(words) - width)
    each = F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))
    return F.when(F.size(words) >= width, each).otherwise(F.array().cast("array<bigint>"))


def _simhash(shingles: Column) -> Column:
    """Bit b is set if more than half of the hashes have it."""
    ones = lambda b: F.aggregate(shingles, F.lit(0), lambda n, h: n + F.getbit(h, b).cast("int"))
    bit = lambda acc, b: acc.bitwiseOR(F.when(2 * ones(b) > F.size(shingles), _one(b)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), bit)


def _one(b: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), b)


def _blocks(fingerprint: Column, radius: int) -> Column:
    """The fingerprint cut into radius + 1 blocks of nearly equal width: (number, bits)."""
    n, parts, first = radius + 1, [], 0
    for k in range(n):
        width = 64 // n + (k < 64 % n)
        bits = F.shiftrightunsigned(fingerprint, first).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        parts.append(F.struct(F.lit(k).alias("no"), bits.alias("bits")))
        first += width
    return F.array(*parts)


def _shared(a: Column, b: Column) -> Column:
    """Shingles in common, each as often as in the one that has it less."""
    times = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    return F.aggregate(F.array_distinct(b), F.lit(0), lambda n, x: n + F.least(times(a, x), times(b, x)))


def _content(docs: DataFrame) -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """key (content key of a document), doc_id, item_id, start_word (from 0), n_words, differing_bits,
    similarity: the best window of every document and item that are alike enough."""
    cut = benchmark.select("item_id", "text").distinct().select("item_id", F.xxhash64("item_id", "text").alias("item"), _words(F.col("text")).alias("w"))
    cut = cut.where(F.size("w") > 0).withColumn("m", F.size("w")).withColumn("width", F.least("m", F.lit(SHINGLE)))
    widths = sorted(r.width for r in cut.select("width").distinct().collect())  # five values at most
    by_width = [cut.where(F.col("width") == w).withColumn("h", _shingles(F.col("w"), w)).drop("w") for w in widths]
    keyed = docs.select(_content(docs).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    if not widths:
        return keyed.select(
            "key", "doc_id", F.lit(None).cast("long").alias("item_id"), *[F.lit(0).alias(c) for c in ("start_word", "n_words", "differing_bits")], F.lit(0.0).alias("similarity")
        ).where(F.lit(False))
    items = written(reduce(DataFrame.unionByName, by_width).withColumn("fp", _simhash(F.col("h"))))
    sizes = written(items.select("width", "m", F.explode("h").alias("h")).distinct())  # where a window of m words may begin
    starts = []
    for w in widths:
        words = keyed.select("key", _words(F.col("text")).alias("w"))
        each = words.select("key", F.size("w").alias("n"), F.posexplode(_shingles(F.col("w"), w)).alias("pos", "h"))
        hit = each.join(sizes.where(F.col("width") == w).drop("width"), "h").where(F.col("n") >= F.col("m"))
        last = F.col("n") - F.col("m")
        starts.append(hit.select("key", "m", F.lit(w).alias("width"), F.least("pos", last).alias("start"), (F.col("pos") >= last).alias("last")))
    starts = written(reduce(DataFrame.unionByName, starts).distinct())
    keys = written(starts.select("key").distinct())
    texts = keyed.join(keys, "key", "left_semi").dropDuplicates(["key"]).select("key", "doc_id", _words(F.col("text")).alias("w"))
    windows = []
    for w in widths:
        here = texts.select("key", "doc_id", _shingles(F.col("w"), w).alias("h")).join(starts.where(F.col("width") == w), "key")
        windows.append(here.withColumn("h", F.slice("h", F.col("start") + 1, F.col("m") - F.col("width") + 1)))
    windows = written(reduce(DataFrame.unionByName, windows).withColumn("window", F.xxhash64("m", "h")))
    single = windows.groupBy("window", "m").agg(F.first("h").alias("h"))
    prints = written(single.withColumn("fp", _simhash(F.col("h"))))
    left = prints.select("window", "m", "fp", F.explode(_blocks(F.col("fp"), radius)).alias("b")).select("window", "m", "fp", "b.*")
    right = items.select("item", "m", F.col("fp").alias("item_fp"), F.explode(_blocks(F.col("fp"), radius)).alias("b")).select("item", "m", "item_fp", "b.*")
    differing = F.bit_count(left.fp.bitwiseXOR(right.item_fp))
    near = left.join(right, (left.m == right.m) & (left.no == right.no) & (left.bits == right.bits) & (differing <= radius))
    near = near.select("window", "item", differing.cast("int").alias("differing_bits")).distinct()
    both = near.join(prints.select("window", F.col("h").alias("a")), "window").join(items.select("item", "item_id", F.col("h").alias("b")), "item")
    shared = both.withColumn("shared", _shared(F.col("a"), F.col("b"))).withColumn("all", F.size("a") + F.size("b") - F.col("shared"))
    begins = F.array_contains("b", F.get("a", F.lit(0))).alias("begins")
    alike = written(shared.select("window", "item_id", "differing_bits", begins, (F.col("shared") / F.col("all")).alias("similarity")).where(F.col("similarity") >= similarity))
    found = windows.select("key", "doc_id", "window", "start", "last", "m").join(alike, "window").where(F.col("begins") | F.col("last"))
    best = F.max(F.struct("similarity", (-F.col("start")).alias("s"), "m", "differing_bits")).alias("x")
    return found.groupBy("key", "doc_id", "item_id").agg(best).select(
        "key", "doc_id", "item_id", (-F.col("x.s")).alias("start_word"), F.col("x.m").alias("n_words"), "x.differing_bits", "x.similarity"
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that hold no benchmark item."""
    key = free_name(docs, "key")
    found = written(contaminated(docs, benchmark, similarity, radius).select(F.col("key").alias(key)).distinct())
    return docs.withColumn(key, _content(docs)).join(found, key, "left_anti").drop(key)
