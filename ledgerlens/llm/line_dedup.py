"""Line deduplication by a suffix array over line-id sequences.

Method: every line with a word is a symbol (a 64-bit hash of the line), every
text a sequence of symbols; blank lines are passed over. Suffixes are sorted by
distributed prefix doubling: ranks by the first ``2 ** k`` lines give, paired with
the rank ``2 ** k`` lines further on, ranks by the first ``2 ** (k + 1)``. Only lines
that occur more than once in the corpus take part; any other ends all common
prefixes. Suffixes with a common prefix of n lines are an interval of the array
(a longest-common-prefix interval at depth n), and two ranks name it: those of
its first and last ``2 ** floor(log2(n))`` lines. A repeated run is deleted if it
has ``min_words`` words or more. It is the union of the shortest windows with as many
words that begin or end at its lines, so each position looks up two intervals:
a window is deleted wherever its interval holds an earlier place, and what a
maximal run leaves undeleted is its first copy. As each line has a word, no
window has more than ``min_words`` lines, which bounds the doublings
(``floor(log2(min_words))`` rounds).

The global sorts deal rows out by range with ties broken by place, so a line that
a third of all texts hold is spread over tasks; earliest places are minima,
pre-aggregated before the shuffle. Each round is written.

Order of places: doc_id (null last), content, line. A text's own repetitions
count like those of other texts. Defined results: null text stays null, with no
lines. Rows with the same id and text are one document and get the same result.
Lines are split at \\n only and compared byte by byte. Other columns pass through.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import free_name, sliced, written
from .kernels import Block, blocks, give_back

MIN_WORDS = 50
_PLACE = ["none", "id", "key", "pos"]  # an order of all lines: none (id is null), id, content, line


def _content(doc_id: str, text: str) -> Column:
    return F.xxhash64(F.col(doc_id).cast("long"), F.col(text))


def lines(docs: DataFrame) -> DataFrame:
    """none, id, key, pos (number among the text's lines with words), line (number among all), r (the
    line's hash), words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            for a, _, raws in blocks(batch.column("text").to_pylist()):
                block = Block(raws)
                starts, ends = block.lines()
                word_starts = block.words()[0]
                words = np.searchsorted(word_starts, ends) - np.searchsorted(word_starts, starts)
                row = block.rows(starts)
                line = np.arange(len(starts)) - np.searchsorted(starts, block.off)[row]
                full = words > 0
                at = row[full]
                before = np.concatenate(([0], np.cumsum(full)))
                pos = before[:-1][full] - before[np.searchsorted(starts, block.off)][at]
                take = pa.array(at + a)
                made = [pa.array(x) for x in (pos, line[full], block.hashes(starts, ends)[full].view(np.int64), words[full])]
                yield pa.RecordBatch.from_arrays([batch.column(c).take(take) for c in ("none", "id", "key")] + made, names=names)
        give_back()

    schema = "none boolean, id long, key long, pos long, line long, r long, words long"
    names = [c.split()[0] for c in schema.split(", ")]
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(0))
    rows = docs.select(F.col("doc_id").isNull().alias("none"), id_.alias("id"), _content("doc_id", "text").alias("key"), "text")
    return rows.mapInArrow(run, schema)


def _sorted_ranks(df: DataFrame, keys: list[str], rank: str) -> DataFrame:
    """``df`` with ``rank``: how many rows are less by ``keys`` (null least; equal rows: equal ranks).

    Rows are sorted over range partitions with ties broken by place; a partition
    numbers its rows, and a row per partition (its size, and whether its first
    value goes on from the one before) makes the numbers global."""
    value = F.struct(*[F.coalesce(F.col(k), F.lit(-(1 << 63))).alias(k) for k in keys])
    named = df.withColumns({"_v": value, "_n": F.lit(0).cast("long"), "_p": F.lit(0)})
    order = ["_v", *_PLACE]
    dealt = named.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, start, last = TaskContext.get().partitionId(), 0, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            got = [batch.column("_v").field(k).to_numpy(zero_copy_only=False) for k in range(len(keys))]
            new = np.zeros(batch.num_rows, bool)
            for x in got:
                new[1:] |= x[1:] != x[:-1]
            new[0] = tuple(x[0] for x in got) != last
            first = np.where(new, np.arange(seen, seen + batch.num_rows), 0)
            if not new[0]:
                first[0] = start
            first = np.maximum.accumulate(first)
            seen, start, last = seen + batch.num_rows, int(first[-1]), tuple(x[-1] for x in got)
            at = batch.schema.get_field_index
            batch = batch.set_column(at("_n"), "_n", pa.array(first)).set_column(at("_p"), "_p", pa.array(np.full(batch.num_rows, part, np.int32)))
            yield batch

    numbered = written(dealt.mapInArrow(run, dealt.schema))
    parts = numbered.groupBy("_p").agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.max("_n").alias("top")).collect()
    base, going_on, rows = 0, None, []
    for p in sorted(parts, key=lambda r: r["_p"]):
        carried = going_on is not None and going_on[0] == tuple(p.lo)
        rows.append((p["_p"], base, going_on[1] if carried else base))
        if not (carried and tuple(p.lo) == tuple(p.hi)):
            going_on = (tuple(p.hi), base + p.top)
        base += p.n
    offsets = df.sparkSession.createDataFrame(rows, "_p int, _base long, _first long")  # one row per partition
    ranked = numbered.join(F.broadcast(offsets), "_p")
    return ranked.withColumn(rank, F.when(F.col("_n") == 0, F.col("_first")).otherwise(F.col("_base") + F.col("_n"))).select(*df.columns, rank)


def suffix_ranks(repeated: DataFrame, levels: int) -> DataFrame:
    """``repeated`` (places and ``r``) with r0 .. r<levels>: ranks of each suffix by its first 1, 2, 4, ... lines."""
    out = _sorted_ranks(repeated, ["r"], "r0").drop("r")
    by_text = Window.partitionBy("none", "id", "key").orderBy("pos")
    for k in range(levels):
        further = F.first(f"r{k}").over(by_text.rangeBetween(1 << k, 1 << k))
        out = _sorted_ranks(out.withColumn("_next", further), [f"r{k}", "_next"], f"r{k + 1}").drop("_next")
    return out


def _windows(ranks: DataFrame, levels: int, min_words: int) -> DataFrame:
    """none, id, key, pos, size, a, b: shortest windows of ``min_words`` words that begin or end at each
    line, by the two ranks that name their interval."""
    text = ["none", "id", "key"]
    dealt = ranks.repartition(*text).sortWithinPartitions(*text, "pos")

    def of_texts(table: pa.Table) -> pa.RecordBatch:
        key, pos, words = (table.column(c).to_numpy() for c in ("key", "pos", "words"))
        rank = np.stack([table.column(f"r{k}").to_numpy() for k in range(levels + 1)])
        n = len(pos)
        apart = (np.diff(pos) != 1) | (np.diff(key) != 0)
        run_no = np.concatenate(([0], np.cumsum(apart)))  # lines next to each other in one text
        total = np.concatenate(([0], np.cumsum(words)))
        at = np.arange(n)
        end = np.searchsorted(total, total[:-1] + min_words)  # window [i, end)
        begin = np.searchsorted(total, total[1:] - min_words, "right") - 1  # window [begin, i]
        forward = (at * (n + 1) + end)[end <= n]
        backward = (begin * (n + 1) + at + 1)[begin >= 0]
        i, j = np.divmod(np.unique(np.concatenate([forward, backward])), n + 1)
        ok = run_no[i] == run_no[j - 1]
        i, j = i[ok], j[ok]
        size = j - i
        level = np.minimum(np.frexp(size.astype(np.float64))[1] - 1, levels)
        made = [pos[i], size, rank[level, i], rank[level, j - (1 << level)]]
        columns = [table.column(c).take(pa.array(i)).combine_chunks() for c in text] + [pa.array(x) for x in made]
        return pa.RecordBatch.from_arrays(columns, names=[*text, "pos", "size", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of a text that may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy()
            last = int(np.flatnonzero(np.diff(key, prepend=key[0] ^ 1))[-1])
            if held and (last or held[0].column("key")[0].as_py() != key[0]):
                if held[0].column("key")[0].as_py() == key[0]:
                    first = int(np.flatnonzero(np.append(np.diff(key) != 0, True))[0]) + 1
                else:
                    first = 0
                yield of_texts(pa.Table.from_batches([*held, batch.slice(0, first)]))
                if first < last:
                    yield of_texts(pa.Table.from_batches([batch.slice(first, last - first)]))
                held = [batch.slice(last)]
            elif held:
                held.append(batch)
            else:
                if last:
                    yield of_texts(pa.Table.from_batches([batch.slice(0, last)]))
                held = [batch.slice(last)]
        if held:
            yield of_texts(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, "none boolean, id long, key long, pos long, size long, a long, b long")


def deleted_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """key (content key of a document), gone (numbers of its deleted lines, from 0)."""
    if min_words < 1:
        raise ValueError("min_words must be at least 1")
    levels = int(min_words).bit_length() - 1
    every = written(lines(docs))
    often = written(every.groupBy("r").count().where("count > 1").select("r"))
    # rows with the same id and text are one document
    repeated = written(every.join(often, "r", "left_semi").dropDuplicates(["key", "pos"]))
    ranks = suffix_ranks(repeated.select(*_PLACE, "line", "words", "r"), levels)
    windows = written(_windows(ranks, levels, min_words))
    place = F.struct(*_PLACE)
    first = written(windows.groupBy("size", "a", "b").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    later = windows.join(first, ["size", "a", "b"]).where(place > F.col("first")).select("key", "pos", "size")
    covered = later.select("key", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("size") - 1)).alias("pos")).distinct()
    numbers = covered.join(repeated.select("key", "pos", "line"), ["key", "pos"])
    return numbers.groupBy("key").agg(F.sort_array(F.collect_list(F.col("line").cast("int"))).alias("gone"))


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Every row of ``docs`` with the text that is left, n_lines, n_deleted and deleted
    (numbers of the deleted lines, from 0): doc_id, text, n_lines, n_deleted, deleted."""
    gone = deleted_lines(docs, min_words)
    joined = docs.select("doc_id", "text", _content("doc_id", "text").alias("key")).join(gone, "key", "left")
    none = F.array().cast("array<int>")
    text = _left(F.col("text"), F.col("gone"))
    n_lines = F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0))
    deleted = F.coalesce("gone", none)
    return joined.select("doc_id", text.alias("text"), F.when(F.col("text").isNull(), 0).otherwise(n_lines).alias("n_lines"), F.size(deleted).alias("n_deleted"), deleted.alias("deleted"))


def _left(text: Column, gone: Column) -> Column:
    kept = F.filter(F.split(text, "\n", -1), lambda _, i: ~F.array_contains(gone, i))
    return F.when(gone.isNull(), text).otherwise(F.array_join(kept, "\n"))


def delete_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later copies deleted from ``text``, and ``n_chars`` (if there is one) as it is
    then; rows of whose words nothing is left are dropped."""
    key, gone = free_name(docs, "key"), free_name(docs, "gone")
    found = deleted_lines(docs, min_words).select(F.col("key").alias(key), F.col("gone").alias(gone))
    joined = docs.withColumn(key, _content("doc_id", "text")).join(found, key, "left")
    text = _left(F.col("text"), F.col(gone))
    cut = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        size = F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
        cut = cut.withColumn("n_chars", size)
    return cut.where(F.col(gone).isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)
