"""Benchmark decontamination with suffix arrays over shards of the training text.

A shard is a run of documents with about ``shard_words`` words (one longer document is a shard alone). Its
words become numbers of the benchmark's vocabulary, 0 for any other word and between documents. Its suffix
array holds the places from which a match could run, sorted by the words that follow: a place with another
word among the next few cannot start a match and is left out. Every suffix of every benchmark item is looked
up by binary search; the range found is the set of its occurrences, and neighbouring occurrences on one
diagonal join to the longest verbatim matches with their places.

Shards are built and searched where the documents are: nothing is shuffled, a shard's arrays are all that
a task holds, and a lost task repeats its own shards. The benchmark is the query set and is read in blocks
of at most ``block_words`` words and one item; a block is broadcast (that bounds its size) and passed over all
rows. One block needs no write. With more, the documents are written once, with numbers, and a block's pass writes
numbers and finds alone, the first one for every row and the others for rows with a hit; they are put together by number
at the end. So bytes written do not grow with the number of blocks, and a benchmark of any size is looked up whole in
bounded memory: a block is let go when its pass is written.

Words that are hit and the items are found in time and memory that grow with the places found; the matches
themselves, which are as many as pairs of places, are only told ``with_matches``.

Defined results for odd input: a null text has no words; bytes that are not UTF-8 become U+FFFD, also in what is
passed on; an item without words matches nothing; an item with
fewer words than the window must occur whole; equal rows give equal results, row by row; items that share an
id are texts of their own under one id; items with a null id are windows like all others, and their matches
have a null item_id (the query counts all of them as one item, which adds nothing to the digest of ids); empty
tables give no matches; other columns pass through untouched, whatever their names, but for those named as an
added one in any case of letters, which it replaces.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausemill.llm.columns import Passing, picked, utf8
from clausemill.llm.store import Store

#: Bytes of words stay, A-Z in lower case; all others separate. Bytes from 0x80 on are parts of letters.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int64())]))
_MATCH_FIELDS = ("item_id", "item_start", "doc_start", "n_words")
_MATCH = pa.list_(pa.struct([(n, pa.int64()) for n in _MATCH_FIELDS]))
_MATCH_SQL = "array<struct<item_id:long,item_start:long,doc_start:long,n_words:long>>"
#: Windows looked up at once, and (document, item) pairs held before repeated ones go.
_AT_ONCE, _PAIRS = 50_000, 2_000_000


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Block:
    """A block of the benchmark: its vocabulary and its windows, the windows grouped by length and content."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], window: int):
        self.ids = [item for item, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        for _, words in items:
            for w in words:
                self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        self.least = min([window, *(len(w) for _, w in items if w)], default=window)
        n = np.array([len(w) for _, w in items], dtype=np.int64)
        begins = np.cumsum(n) - n
        text = np.concatenate([np.empty(0, dtype=np.int64), *[self.numbers(w) for _, w in items]])
        sizes = np.minimum(n, window)
        counts = np.where(sizes > 0, n - sizes + 1, 0)
        item = np.repeat(np.arange(len(items)), counts)
        start = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        #: For each length: the distinct windows, and where each occurs as ranges of (number of the item, start).
        self.windows = []
        for size in sorted(set(sizes[sizes > 0].tolist())):
            own = np.flatnonzero(sizes[item] == size)
            rows = text[(begins[item[own]] + start[own])[:, None] + np.arange(size)].astype(np.int32)
            order = np.lexsort(packed_keys(rows.astype(np.int64), len(self.vocabulary).bit_length())[::-1])
            own, rows = own[order], rows[order]
            new = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)]))
            self.windows.append((size, rows[new], np.append(new, len(own)), np.stack([item[own], start[own]], axis=1)))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, words, repeat(0)), dtype=np.int64, count=len(words))


def packed_keys(words: np.ndarray, bits: int) -> list[np.ndarray]:
    """Rows of word numbers as few 62-bit keys, the first words in the first key."""
    per = max(1, 62 // bits)
    keys = []
    for at in range(0, words.shape[1], per):
        key = np.zeros(len(words), dtype=np.int64)
        for j in range(at, min(at + per, words.shape[1])):
            key = (key << bits) | words[:, j]
        keys.append(key << (bits * max(0, at + per - words.shape[1])))
    return keys


def suffix_array(text: np.ndarray, starts: np.ndarray, depth: int, bits: int) -> np.ndarray:
    """``starts`` sorted by the ``depth`` words from each on; text must be padded by ``depth`` zeros."""
    keys = packed_keys(text[starts[:, None] + np.arange(depth)], bits)
    return starts[np.lexsort(keys[::-1])]


def search(text: np.ndarray, order: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The range of the suffix array that starts with each window, by binary search for all windows at once."""
    size = windows.shape[1]

    def bound(after: bool) -> np.ndarray:
        low, high = np.zeros(len(windows), dtype=np.int64), np.full(len(windows), len(order), dtype=np.int64)
        while (open_ := low < high).any():
            mid = (low + high) // 2
            there = text[order[np.minimum(mid, len(order) - 1)][:, None] + np.arange(size)]
            differ = there != windows
            first = differ.argmax(axis=1)
            rows = np.arange(len(windows))
            less = there[rows, first] < windows[rows, first]
            right = np.where(differ.any(axis=1), less, after)
            low = np.where(open_ & right, mid + 1, low)
            high = np.where(open_ & ~right, mid, high)
        return low

    return (bound(False), bound(True)) if len(order) else (np.zeros(len(windows), dtype=np.int64),) * 2


def _longest(found: list[tuple[np.ndarray, ...]], block: Block, begins: np.ndarray, out: list[list]) -> None:
    """Joins neighbours on one diagonal to the longest matches: (item, start in the item, start in the document, words)."""
    item, start, place, size = map(np.concatenate, zip(*found, strict=True))
    doc = np.searchsorted(begins, place, side="right") - 1
    order = np.lexsort((start, place - start, item, doc))
    item, start, place, size, doc = (x[order] for x in (item, start, place, size, doc))
    new = np.ones(len(item), dtype=bool)
    new[1:] = (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]) | (np.diff(place - start) != 0) | (np.diff(start) != 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(item)) - 1
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        d = int(doc[a])
        out[d].append((block.ids[item[a]], int(start[a]), int(place[a] - begins[d]), int(start[b] - start[a] + size[b])))


def search_shard(block: Block, docs: list[np.ndarray], with_matches: bool) -> tuple[list[list], list[set], list[list]]:
    """For each document of a shard: the (start, size) of its hit words, the ids of the items found, and the longest matches."""
    spans: list[list] = [[] for _ in docs]
    ids: list[set] = [set() for _ in docs]
    matches: list[list] = [[] for _ in docs]
    depth = max((w[0] for w in block.windows), default=0)
    if not depth:
        return spans, ids, matches
    gap = np.zeros(depth, dtype=np.int64)
    text = np.concatenate([x for d in docs for x in (d, gap)] + [gap])
    begins = np.cumsum([0, *(len(d) + depth for d in docs)])
    known = np.concatenate([[0], np.cumsum(text > 0)])
    places = np.arange(len(text) - depth)
    starts = places[known[places + block.least] - known[places] == block.least]
    order = suffix_array(text, starts, depth, len(block.vocabulary).bit_length())
    cover = np.zeros(len(text) + 1, dtype=np.int32)
    pairs, held, found = [], 0, []
    for size, windows, bounds, where in block.windows:
        for at in range(0, len(windows) if len(order) else 0, _AT_ONCE):
            low, high = search(text, order, windows[at : at + _AT_ONCE])
            for w in np.flatnonzero(high > low):
                places, own = order[low[w] : high[w]], where[bounds[at + w] : bounds[at + w + 1]]
                cover[places] += 1
                cover[places + size] -= 1
                there = np.unique(np.searchsorted(begins, places, side="right") - 1)
                pairs.append((there[:, None] * len(block.ids) + np.unique(own[:, 0])).ravel())
                held += len(pairs[-1])
                if held >= _PAIRS:
                    pairs = [np.unique(np.concatenate(pairs))]
                    held = 0
                if with_matches:
                    found.append((np.tile(own[:, 0], len(places)), np.tile(own[:, 1], len(places)), np.repeat(places, len(own)), np.full(len(places) * len(own), size)))
    if not pairs:
        return spans, ids, matches
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(cover) > 0).astype(np.int8), [0]])))
    first, last = edges[::2], edges[1::2]
    doc = np.searchsorted(begins, first, side="right") - 1
    for d, a, n in zip(doc.tolist(), (first - begins[doc]).tolist(), (last - first).tolist(), strict=True):
        spans[d].append((a, n))
    for key in np.unique(np.concatenate(pairs)).tolist():
        ids[key // len(block.ids)].add(block.ids[key % len(block.ids)])
    if with_matches:
        _longest(found, block, begins, matches)
    return spans, ids, matches


def _blocks(benchmark: DataFrame, window: int, block_words: int) -> Iterator[tuple[Block, bool]]:
    """The blocks, one built at a time, and whether each is the last; an empty one where there are no items."""
    items: list[tuple[int | None, list[bytes]]] = []
    held = 0
    for row in benchmark.select(F.col("item_id").cast("long"), utf8(F.col("text"))).toLocalIterator():
        if held >= block_words:
            full, items, held = items, [], 0
            yield Block(full, window), False
        words = split_words(row[1])
        items.append((row[0], words))
        held += len(words)
    yield Block(items, window), True


def find_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    shard_words: int = 500_000,
    block_words: int = 2_000_000,
    with_matches: bool = False,
) -> DataFrame:
    """The documents with ``n_words``, ``n_hit`` (words inside a match), ``item_ids`` and on request ``matches``, the longest ones."""
    added = ["n_words", "n_hit", "item_ids", *(["matches"] if with_matches else [])]
    passing = Passing(docs, added)
    clean = [utf8(F.col(c)).alias(c) if c == passing.inside(text) else c for c in passing.kept]
    source = passing.inner.select(*clean)
    store, held, told = None, source, None
    for k, (block, last) in enumerate(_blocks(picked(benchmark, item_id=item_id, text=item_text), window, block_words)):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        if k == 0 and last:  # nothing is written: one pass, the documents where they are
            return passing.outer(_looked_up(source, passing.inside(text), shared, passing.kept, shard_words, with_matches), *added)
        if store is None:
            store = Store(docs.sparkSession, "decontaminate")
            held = store.save(source.withColumn("row", F.monotonically_increasing_id()), "docs")
        found = _looked_up(held.select("row", passing.inside(text)), passing.inside(text), shared, ["row"], shard_words, with_matches)
        found = found if k == 0 else found.where("n_hit > 0")  # the first pass tells the words of every row
        if not last:
            found = store.save(found, f"block-{k}")
            shared.destroy()
        told = found if told is None else told.unionByName(found)
    merged = told.groupBy("row").agg(
        F.max("n_words").alias("n_words"),
        _covered(F.sort_array(F.flatten(F.collect_list("spans")))).alias("n_hit"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
        F.flatten(F.collect_list("matches")).alias("matches"),
    )
    return passing.outer(held.join(merged, "row"), *added)


def _covered(spans):
    """How many words sorted spans (start, size) cover."""
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))

    def step(acc, x):
        end = x["start"] + x["size"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(end - F.greatest(acc["end"], x["start"]), F.lit(0))).alias("n"))

    return F.aggregate(spans, start, step, lambda acc: acc["n"])


def _looked_up(rows: DataFrame, text: str, shared, keep: list[str], shard_words: int, with_matches: bool) -> DataFrame:
    """The kept columns of the rows with n_words, n_hit, spans, item_ids and matches of one block."""
    at = rows.columns.index(text)
    places = [rows.columns.index(c) for c in keep]
    schema = rows.select(
        *keep, F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.lit(None).cast("array<struct<start:long,size:long>>").alias("spans"),
        F.lit(None).cast("array<long>").alias("item_ids"), F.lit(None).cast(_MATCH_SQL).alias("matches"),
    ).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            n_words, spans, ids, matches = [], [], [], []
            held, docs_ = 0, []
            for i, value in enumerate(batch.column(at)):
                words = split_words(value.as_py())
                n_words.append(len(words))
                docs_.append(own.numbers(words))
                held += len(words)
                if held >= shard_words or i + 1 == batch.num_rows:
                    for column, more in zip((spans, ids, matches), search_shard(own, docs_, with_matches), strict=True):
                        column += more
                    held, docs_ = 0, []
            told = [
                pa.array(n_words, pa.int64()),
                pa.array([sum(n for _, n in x) for x in spans], pa.int64()),
                pa.array([[{"start": a, "size": b} for a, b in x] for x in spans], _SPANS),
                pa.array([sorted(x, key=lambda v: (v is not None, v or 0)) for x in ids], pa.list_(pa.int64())),
                pa.array([[dict(zip(_MATCH_FIELDS, m, strict=True)) for m in x] for x in matches], _MATCH),
            ]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in places], *told], names=schema.names)

    return rows.mapInArrow(run, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents without a match, with their own columns."""
    passing = Passing(docs, [])
    found = find_matches(passing.inner, benchmark, text=passing.inside(text), **options)
    return passing.outer(found.where("n_hit = 0"))
