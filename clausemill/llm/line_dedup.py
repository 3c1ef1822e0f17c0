"""Removal of repeated line runs, by a suffix array over line-ID sequences.

A document is the sequence of the IDs of its lines with a word; no run crosses a document. An ID is a hash of 128 bits
(among 10^12 distinct lines the chance that any two share one is below 10^-14); those that occur again are numbered.
Distributed prefix doubling ranks the suffixes: the rank of a suffix by its first 2h lines is the order of the
pair (rank by the first h lines, the same h lines further on) among all distinct pairs, which are counted with
map-side combining, dealt by range and numbered in order. Suffixes whose pair occurs once have no longer
common prefix with any other and leave; so each round works on what still repeats.

A maximal repeated run with at least ``min_words`` words is the union of its least windows: from each line
the fewest following lines that hold so many words, and to each line the fewest that end there. A window of L
lines is named by two ranks by 2^k lines that cover it; all suffixes with that name are an interval of the
suffix array whose longest common prefix is at least L. In each interval the earliest copy (by document id,
null last, then row and line) stays and the later ones are deleted, which deletes exactly the later copies of
all maximal runs. Windows have ``min_words`` lines at most, so log2 of that bounds the rounds.

Defined results for odd input: a null or empty text, or one without words, is left as it is; a text of any
length is used whole; bytes that are not UTF-8 become U+FFFD, also in what is told; equal rows are copies of each other, of which one stays; blank lines inside a deleted
run go with it, others stay; where a later copy overlaps the earliest one in a document, as in a line that is said
four times over, the lines that they share go with the later copy, so of a run of copies its first lines stay; an empty table gives an empty table; rows with one id are ordered by their place in
the input; other columns pass through untouched, whatever their names, but for one named ``n_deleted`` in any case
of letters, which the added one replaces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausemill.llm.columns import Passing, utf8
from clausemill.llm.store import Store

_LINES = "row long, doc_id long, i int, id long, more long, ahead int, ahead_from int, ahead_to int, back int, back_from int, back_to int"


def windows_of(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each line the fewest lines from it, and up to it, that hold ``least`` words; 0 where none do."""
    total = np.concatenate([[0], np.cumsum(words)])
    n = np.arange(len(words))
    stop = np.searchsorted(total, total[:-1] + least)
    start = np.searchsorted(total, total[1:] - least, side="right") - 1
    return np.where(stop <= len(words), stop - n, 0), np.where(start >= 0, n + 1 - start, 0)


def _lines(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[list[np.ndarray]] = [[] for _ in range(10)]
            keys = []
            for row, doc, text in zip(*(c.to_pylist() for c in batch.columns[:2]), batch.column(2), strict=True):
                lines = [(k, x, n) for k, x in enumerate((text.as_py() or "").encode("utf-8", "surrogatepass").split(b"\n")) if (n := len(x.split()))]
                if not lines:
                    continue
                at = np.array([x[0] for x in lines], dtype=np.int32)
                ids = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x[1]) for x in lines), dtype=np.int64).reshape(-1, 2)
                ahead, back = windows_of(np.array([x[2] for x in lines]), least)
                i = np.arange(len(lines))
                own = (np.full(len(lines), row), i, ids[:, 0], ids[:, 1], ahead, at, at[np.where(ahead > 0, i + ahead - 1, 0)], back, at[np.where(back > 0, i - back + 1, 0)], at)
                for part, x in zip(parts, own, strict=True):
                    part.append(x)
                keys.append((doc, len(lines)))
            if not keys:
                continue
            row, i, ids, more, *rest = (np.concatenate(p) for p in parts)
            docs = pa.array([d for d, _ in keys], pa.int64()).take(pa.array(np.repeat(np.arange(len(keys)), [n for _, n in keys])))
            arrays = [pa.array(row, pa.int64()), docs, pa.array(i.astype(np.int32)), pa.array(ids), pa.array(more), *(pa.array(x.astype(np.int32)) for x in rest)]
            yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in _LINES.split(", ")])

    return run


def doubled(ranks: DataFrame, h: int, store: Store) -> DataFrame:
    """From the ranks (row, i, rank) by h lines those by 2h lines, of the suffixes whose 2h lines occur again.

    The ranges of names are as many as the session says, or fewer where adaptive execution joins neighbours: few names are few files.
    """
    further = ranks.select("row", (F.col("i") - h).alias("i"), F.col("rank").alias("second"))
    pairs = ranks.withColumnRenamed("rank", "first").join(further, ["row", "i"])
    names = pairs.groupBy("first", "second").count().where("count > 1").select("first", "second")
    ordered = names.repartitionByRange("first", "second").sortWithinPartitions("first", "second")
    ordered = store.save(ordered.withColumn("rank", F.monotonically_increasing_id()), f"names-{2 * h}")
    return store.save(pairs.join(ordered, ["first", "second"]).select("row", "i", "rank"), f"ranks-{2 * h}")


def repeated_runs(lines: DataFrame, store: Store, min_words: int) -> DataFrame:
    """The windows that are later copies: (row, doc_id, start, size, from_line, to_line, first, copies).

    ``first`` is the place of the earliest copy, ``copies`` the size of the suffix-array interval.
    """
    # written, so that the join deals both sides anew and the engine can split a line that very many documents hold
    often = lines.groupBy("id", "more").count().where("count > 1").select("id", "more")
    often = store.save(often.withColumn("line", F.monotonically_increasing_id()), "often")
    active = store.save(lines.join(often, ["id", "more"]).drop("id", "more"), "active")
    pick = lambda c, start: F.struct(start.cast("int").alias("start"), F.col(c).alias("size"), F.col(f"{c}_from").alias("from_line"), F.col(f"{c}_to").alias("to_line"))
    both = F.array_distinct(F.array(pick("ahead", F.col("i")), pick("back", F.col("i") - F.col("back") + 1)))
    windows = active.select("row", "doc_id", F.explode(both).alias("w")).where("w.size > 0").select("row", "doc_id", "w.*").distinct()
    windows = store.save(windows, "windows")
    longest = windows.agg(F.max("size")).first()[0] or 0

    ranks, h, found = active.select("row", "i", F.col("line").alias("rank")), 1, []
    while h <= longest:
        own = windows.where((F.col("size") >= h) & (F.col("size") < 2 * h))
        named = own.join(ranks.select("row", F.col("i").alias("start"), F.col("rank").alias("first")), ["row", "start"])
        last = ranks.select("row", (F.col("i") + h).alias("stop"), F.col("rank").alias("second"))
        named = named.withColumn("stop", F.col("start") + F.col("size")).join(last, ["row", "stop"])
        place = F.struct(F.isnull("doc_id").alias("none"), F.col("doc_id").alias("doc"), F.col("row").alias("row"), F.col("start").alias("start"), F.col("from_line").alias("from_line"))
        named = store.save(named.select("row", "doc_id", "start", "size", "from_line", "to_line", "first", "second", place.alias("place")), f"named-{h}")
        earliest = named.groupBy("size", "first", "second").agg(F.min("place").alias("earliest"), F.count("*").alias("n")).where("n > 1")
        earliest = store.save(earliest, f"earliest-{h}")
        later = named.join(earliest, ["size", "first", "second"]).where("place != earliest")
        found.append(later.select("row", "doc_id", "start", "size", "from_line", "to_line", F.col("earliest").alias("first"), F.col("n").alias("copies")))
        if 2 * h <= longest:
            ranks = doubled(ranks, h, store)
        h *= 2
    if not found:
        place = "struct<none:boolean,doc:bigint,row:bigint,start:int,from_line:int>"
        return windows.select("row", "doc_id", "start", "size", "from_line", "to_line", F.lit(None).cast(place).alias("first"), F.lit(0).cast("long").alias("copies")).where("false")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def without(text: str, runs: list[tuple[int, int]]) -> tuple[str, int]:
    """The text without the lines of the runs, and how many lines went."""
    lines, kept, at = text.split("\n"), [], 0
    for start, stop in sorted(runs):
        kept += lines[at:start]
        at = max(at, stop + 1)
    kept += lines[at:]
    return "\n".join(kept), len(lines) - len(kept)


def _held(docs: DataFrame, doc_id: str, text: str, min_words: int) -> tuple[Passing, Store, DataFrame, DataFrame]:
    """The documents with a row number, written, and the copies of their repeated windows."""
    spark = docs.sparkSession
    passing, store = Passing(docs, ["n_deleted"]), Store(spark, "lines")
    clean = [utf8(F.col(c)).alias(c) if c == passing.inside(text) else c for c in passing.kept]
    held = store.save(passing.inner.select(F.monotonically_increasing_id().alias("row"), *clean), "docs")
    lines = held.select("row", F.col(passing.inside(doc_id)).cast("long"), F.col(passing.inside(text))).mapInArrow(_lines(min_words), _LINES)
    return passing, store, held, repeated_runs(store.save(lines, "lines"), store, min_words)


def find_runs(docs: DataFrame, min_words: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The maximal repeated runs that are later copies, one row each: where, how many lines agree, and with what.

    (doc_id, from_line, to_line, n_lines, first_doc_id, first_line, copies): ``n_lines`` lines with a word, the
    longest common prefix of the two suffixes, agree with the earliest copy, which starts at ``first_line`` of
    ``first_doc_id``; ``copies`` is how many suffixes the interval of its least window holds, at the most. Lines are
    numbered from 0, blank ones included. A run parts where an earlier copy of its further windows begins.
    """
    _, _, _, runs = _held(docs, doc_id, text, min_words)
    own = runs.withColumn("diagonal", F.col("start") - F.col("first.start"))
    by = Window.partitionBy("row", "first.row", "diagonal").orderBy("start")
    reach = F.max(F.col("start") + F.col("size")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.col("start") > reach, F.lit(True)).cast("int")
    islands = own.withColumn("opens", opens).withColumn("island", F.sum("opens").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = islands.groupBy("row", F.col("first.row").alias("first_row"), "diagonal", "island").agg(
        F.first("doc_id").alias("doc_id"),
        F.min("from_line").alias("from_line"),
        F.max("to_line").alias("to_line"),
        (F.max(F.col("start") + F.col("size")) - F.min("start")).cast("long").alias("n_lines"),
        F.min_by("first", "start").alias("first"),
        F.max("copies").alias("copies"),
    )
    return grouped.select("doc_id", "from_line", "to_line", "n_lines", F.col("first.doc").alias("first_doc_id"), F.col("first.from_line").alias("first_line"), "copies")


def dedup_lines(docs: DataFrame, min_words: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with ``text`` less the later copies of repeated runs, and ``n_deleted`` lines."""
    passing, store, held, runs = _held(docs, doc_id, text, min_words)
    runs = store.save(runs.groupBy("row").agg(F.collect_set(F.struct("from_line", "to_line")).alias("runs")), "runs")
    store.keep("docs", "runs")
    # always a merge join: the texts are dealt once whatever the size of the runs, so the plan is one for all sizes
    told = held.join(runs.hint("merge"), "row", "left").select(*passing.kept, "runs")
    n, at = len(passing.kept), passing.kept.index(passing.inside(text))
    schema = T.StructType([T.StructField(f.name, T.StringType()) if i == at else f for i, f in enumerate(told.schema.fields[:n])] + [T.StructField("n_deleted", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, gone = [], []
            for value, own in zip(batch.column(at), batch.column(n), strict=True):
                pairs = [(x["from_line"], x["to_line"]) for x in own.as_py() or ()]
                new, lost = without(value.as_py(), pairs) if pairs else (value.as_py(), 0)
                texts.append(new)
                gone.append(lost)
            arrays = list(batch.columns[:n])
            arrays[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(gone, pa.int64())], names=schema.names)

    return passing.outer(told.mapInArrow(run, schema), "n_deleted")
