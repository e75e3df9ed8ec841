"""Near-duplicate groups by bottom-k MinHash sketches.

Method: a text is the set of the 64-bit hashes of its shingles. Its sketch is
the ``sketch`` least of them, so one hash function does for all (bottom-k).
Inverted lists of the retained values bring texts with common values together;
the union sketch of two texts (the least values of both sketches) estimates
their similarity and filters the candidates; the exact Jaccard similarity of
the full sets verifies them. A set of at most ``sketch`` shingles is its own
sketch; for these estimate and exact value are the same.

Which lists a text enters: texts alike enough have ``least_common`` retained
values in common - exactly so for sets that both sketches hold whole, beyond
that with six standard deviations to spare (``DEVIATIONS``). So if all texts put
their values in the same order, two such texts share one among their first
``size - least_common + 1``, and as many in total as stand behind it. The order
is by how many texts retain a value, rarest first: values of a passage that
many texts share come last, so texts that otherwise differ do not meet there.

Links in proportion to a list, not to its square: copies are one class with one
sketch. In each list every class is first compared with a hub: the class with
the fewest values that are rarer (the centre of a group of edited copies) or, if that
is the class itself or can't be alike enough, one by chance. Classes so connected need not be compared again. Those that still
share a list with another component have their full sets put into lists in the
same way, where the numbers are exact at any size; there the members of a list
outside its largest component meet the others of the list. No pair of different
texts that may be alike enough is left unexamined unless its two sides are
already connected.

Words: A-Z lower-cased, maximal runs between ASCII white space. Shingles: ``width``
words; a text with fewer words is one shingle. Defined results: null text, or
one without words, has an empty set and is a component of its own. Rows with
a null id belong to components but never name one unless no member has an id
(then it is null, and ``kept`` says whether the row's id is null as well).
Repeated rows each give one row. An empty table gives an empty result. Only
``doc_id`` and ``text`` are read, whatever other columns there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .frames import among, key_list, sliced, written
from .kernels import Block, blocks, give_back, windows

WIDTH, PERCENT, SKETCH = 4, 80, 160
_WHOLE = 1 << 40  # sketch size that holds every set
DEVIATIONS = 6  # by which the common values of two sketches may fall short of the expected number


def shingle_sets(block: Block, width: int = WIDTH) -> list[np.ndarray]:
    """The distinct shingle hashes of each text as signed numbers, in ascending order."""
    starts, ends = block.words()
    words = block.hashes(starts, ends)
    bounds = block.per_row(starts).tolist()
    runs = windows(words, width).view(np.int64)
    out = []
    for a, b in zip(bounds, bounds[1:]):
        short = b - a < width
        out.append(np.unique(windows(words[a:b], b - a).view(np.int64) if short and b > a else runs[a : max(a, b - width + 1)]))
    return out


def _sets_of(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    for _, _, raws in blocks(texts.to_pylist()):
        yield from shingle_sets(Block([r.lower() for r in raws]), width)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate([np.zeros(0, np.int64), *arrays])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _names(sets: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
    """128 bits that name each set, as two numbers."""
    names = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
    hi, lo = [x >> 64 for x in names], [x & (1 << 64) - 1 for x in names]
    return tuple(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (hi, lo))


def least_common(n: Column, union: Column, sketch: int, percent: int) -> Column:
    """How many retained values a set of ``n`` has in common with any that is alike enough, if both
    together have at most ``union``: a draw of ``sketch`` from the union, without replacement."""
    share = percent / 100
    spread = F.sqrt(F.greatest(union - sketch, F.lit(0.0)) / F.greatest(union - 1, F.lit(1.0)) * (sketch * share * (1 - share)))
    drawn = F.greatest(F.floor(sketch * share - DEVIATIONS * spread), F.lit(1))
    exact = F.ceil(n * percent / 100)
    return F.when(union <= sketch, exact).otherwise(F.least(exact, drawn)).cast("int")


def sketches(docs: DataFrame, width: int = WIDTH, sketch: int = SKETCH) -> DataFrame:
    """doc_id, content (a hash of the text), n (size of the set), hi, lo (128 bits that name the set),
    least (the sketch: its least values in ascending order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = list(_sets_of(batch.column("text"), width))
            n = np.fromiter(map(len, sets), np.int64, len(sets))
            made = [pa.array(n), *_names(sets), _lists([s[:sketch] for s in sets])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("content")] + made, names=["doc_id", "content", "n", "hi", "lo", "least"])
        give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("content"), "text")
    return rows.mapInArrow(run, "doc_id long, content long, n long, hi long, lo long, least array<long>")


def _row_key(none: Column, doc_id: Column, content: Column) -> Column:
    return F.xxhash64(none, doc_id, content)


def full_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """hi, lo, items (the whole set) of the rows that ``wanted`` (none, doc_id, content) names.

    Up to ``KNOWN_KEYS`` rows are picked out where the documents are read, by a list of their keys; more
    than that are found by a join, for which all texts move once."""
    id_ = F.col("doc_id").cast("long")
    rows = docs.select(_row_key(id_.isNull(), F.coalesce(id_, F.lit(0)), F.xxhash64("text")).alias("row_key"), "text")
    keys = wanted.select(_row_key(F.col("none"), F.col("doc_id"), F.col("content")).alias("row_key"))
    known = key_list(keys)
    if known is None:
        rows = rows.join(keys, "row_key", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            if known is not None:
                batch = batch.filter(pa.array(among(batch.column("row_key").to_numpy(), known.value)))
            for few in sliced(iter([batch]), 100):
                sets = list(_sets_of(few.column("text"), width))
                hi, lo = _names(sets)
                yield pa.RecordBatch.from_arrays([hi, lo, _lists(sets)], names=["hi", "lo", "items"])
        give_back()

    return rows.mapInArrow(run, "hi long, lo long, items array<long>").dropDuplicates(["hi", "lo"])


def inverted_lists(classes: DataFrame, sketch: int = SKETCH, percent: int = PERCENT) -> DataFrame:
    """value, node, n, need (common values that the class needs), before and room (its values before
    this one in the order, and from it on): the lists that each class enters. ``classes``: node, n, least (written)."""
    retained = classes.select("node", F.explode("least").alias("value"))
    often = written(retained.groupBy("value").agg(F.count("*").alias("often")).where("often > 1"))
    met = retained.join(often, "value").groupBy("node").agg(F.collect_list(F.struct("often", "value")).alias("met"))  # at most ``sketch`` values
    need = least_common(F.col("n"), F.col("n") * (100 / percent), sketch, percent)
    kept = met.join(classes.select("node", "n"), "node").withColumn("need", need)
    kept = kept.withColumn("m", F.size("met")).where("m >= need")
    kept = kept.select("node", "n", "need", "m", F.posexplode(F.slice(F.sort_array("met"), 1, F.col("m") - F.col("need") + 1)).alias("at", "x"))
    alone = F.least("n", F.lit(sketch)) - F.col("m")  # values that no other class retains: first in the order, without a list
    return kept.select("x.value", "node", "n", "need", (alone + F.col("at")).alias("before"), (F.col("m") - F.col("at")).alias("room"))


def _may_link(sketch: int, percent: int) -> Column:
    """Whether two classes that meet in a list (columns of a and b) can be alike enough, if this is the
    first value they share: by their sizes, and by the values that are left for them to share."""
    n = F.col("n_a") + F.col("n_b")
    whole = F.greatest("n_a", "n_b") <= sketch
    need = F.when(whole, F.ceil(n * percent / (100 + percent))).otherwise(F.greatest("need_a", "need_b"))
    return (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (F.least("room_a", "room_b") >= need)


_MEMBER = ["node", "n", "need", "room"]


def _as(side: str, df: DataFrame, *more: str) -> DataFrame:
    named = [F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in _MEMBER[1:]]]
    return df.select("value", *named, *more)


def hub_pairs(entries: DataFrame, sketch: int, percent: int) -> DataFrame:
    """a, b: every class of a list with the list's first hub or, if that is the class itself or can't be alike
    enough, with the one by chance; once."""
    chance = F.xxhash64("node")
    keys = {"first": F.struct("before", chance), "second": F.struct(chance)}
    hub = [F.min(F.struct(key.alias("k"), *_MEMBER)).alias(name) for name, key in keys.items()]
    hubs = written(entries.groupBy("value").agg(*hub).select("value", *[F.struct(*[f"{name}.{c}" for c in _MEMBER]).alias(name) for name in keys]))
    met = _as("b", entries).join(hubs, "value")
    alike = (F.col("a") != F.col("b")) & _may_link(sketch, percent)

    def with_hub(met: DataFrame, hub: Column) -> DataFrame:
        return met.withColumns({"a": hub["node"], **{f"{c}_a": hub[c] for c in _MEMBER[1:]}})

    met = with_hub(met, F.col("first")).withColumn("by_first", alike)
    return _ordered(with_hub(met, F.when(F.col("by_first"), F.col("first")).otherwise(F.col("second"))).where(alike))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _mixed(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """``entries`` of the lists that hold more than one component, with root and main (the root of the
    list's largest component), written. ``roots``: node, root of the connected classes."""
    placed = written(entries.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    parts = placed.groupBy("value", "root").agg(F.count("*").alias("members"))
    largest = parts.groupBy("value").agg(F.count("*").alias("parts"), F.max(F.struct("members", "root")).alias("m"))
    mixed = written(largest.where("parts > 1").select("value", F.col("m.root").alias("main")))
    return written(placed.join(mixed, "value"))


def open_pairs(entries: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs that meet in a list of full sets and are not connected yet."""
    left = _mixed(entries, roots)
    minor = _as("a", left.where("root <> main"), F.col("root").alias("root_a"))
    all_ = _as("b", left, F.col("root").alias("root_b"), "main")
    # a class of the largest component only comes second; two others meet once
    once = (F.col("root_b") == F.col("main")) | (F.col("a") < F.col("b"))
    return _ordered(minor.join(all_, "value").where((F.col("root_a") != F.col("root_b")) & once & _may_link(_WHOLE, percent)))


def sets_of(nodes: DataFrame, classes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """node, items (the whole set) of the classes in ``nodes``, written."""
    named = written(classes.join(nodes, "node", "left_semi").select("node", "hi", "lo", "none", "doc_id", "content"))
    found = full_sets(docs, named.select("none", "doc_id", "content"), width)
    return written(found.join(named.select("node", "hi", "lo"), ["hi", "lo"]).select("node", "items"))


def estimated(pairs: DataFrame, classes: DataFrame, sketch: int, percent: int) -> DataFrame:
    """a, b, n_a, n_b, whole (both sketches hold their sets) of the pairs that their union sketch does not
    rule out, written; where ``whole``, they are alike enough."""
    of = classes.select("node", "n", "least")
    a = of.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("least").alias("least_a"))
    b = of.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("least").alias("least_b"))
    met = written(pairs).join(a, "a").join(b, "b").withColumn("shared", F.array_intersect("least_a", "least_b"))
    both = F.size(F.array_intersect("shared", F.slice(F.sort_array(F.array_union("least_a", "least_b")), 1, sketch)))
    whole = (F.col("n_a") <= sketch) & (F.col("n_b") <= sketch)
    n, all_ = F.col("n_a") + F.col("n_b"), F.size("shared")
    need = least_common(F.greatest("n_a", "n_b"), n * (100 / (100 + percent)), sketch, percent)
    near = F.when(whole, 100 * all_ >= percent * (n - all_)).otherwise(both >= need)
    return written(met.where(near).select("a", "b", "n_a", "n_b", whole.alias("whole")))


def verified(found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: those of ``found`` (from ``estimated``) whose full sets are alike enough, written."""
    left, right = (sets.select(F.col("node").alias(k), F.col("items").alias(f"items_{k}")) for k in "ab")
    common = F.size(F.array_intersect("items_a", "items_b"))
    full = found.where("not whole").join(left, "a").join(right, "b").withColumn("common", common)
    linked = full.where(100 * F.col("common") >= percent * (F.col("n_a") + F.col("n_b") - F.col("common")))
    return written(found.where("whole").select("a", "b").unionByName(linked.select("a", "b")))


def classes_of(marked: DataFrame) -> DataFrame:
    """node, hi, lo, n, least and a row (none, doc_id, content) of each different set; ``marked``: from ``sketches``."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "content")).alias("first")
    grouped = marked.where("n > 0").groupBy("hi", "lo").agg(first, F.max("n").alias("n"), F.max("least").alias("least"))
    return written(grouped.select(F.monotonically_increasing_id().alias("node"), "hi", "lo", "n", "least", "first.*"))


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, sketch: int = SKETCH) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``."""
    marked = written(sketches(docs, width, sketch))
    all_classes = classes_of(marked)
    entries = written(inverted_lists(all_classes, sketch, percent))
    classes = written(all_classes.join(entries.select("node").distinct(), "node", "left_semi"))  # those that meet another
    found = estimated(hub_pairs(entries, sketch, percent), classes, sketch, percent)
    nodes = found.where("not whole").select(F.explode(F.array("a", "b")).alias("node")).distinct()
    links = verified(found, sets_of(nodes, classes, docs, width), percent)
    roots = components(links)
    sets = sets_of(_mixed(entries, roots).select("node").distinct(), classes, docs, width)
    full = inverted_lists(sets.select("node", F.size("items").cast("long").alias("n"), F.col("items").alias("least")), _WHOLE, percent)
    rest = verified(estimated(open_pairs(written(full), roots, percent), classes, sketch, percent), sets, percent)
    roots = components(written(links.unionByName(rest)))
    id_ = F.when(~F.col("none"), F.col("doc_id"))
    rooted = written(all_classes.select("node", "hi", "lo", id_.alias("id")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    names = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    named = written(rooted.join(written(names), "root").select("hi", "lo", "component_id"))
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = marked.drop("least").join(named, ["hi", "lo"], "left").withColumn("component_id", component)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
