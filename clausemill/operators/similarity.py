"""Nearest-neighbour similarity by character n-grams, and greedy merging of near-equal texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausemill.functions import text as T
from clausemill.session import written


#: The least and the most characters of a gram.
LOW, HIGH = 3, 5


def padded_words(text: Column) -> Column:
    """The lower-case words of a text, each with a blank on both sides."""
    return F.transform(F.array_remove(F.split(F.lower(T.collapse(text)), " "), ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))


def char_grams(text: Column, low: int = LOW, high: int = HIGH) -> Column:
    """All character n-grams inside word boundaries; a padded word shorter than the least n counts once."""

    def of(w: Column) -> Column:
        sizes = F.sequence(F.lit(low), F.lit(high))

        def by_size(n: Column) -> Column:
            starts = F.when(F.length(w) >= n, F.sequence(F.lit(1), F.length(w) - n + 1)).when(n == low, F.array(F.lit(1)))
            return F.transform(F.coalesce(starts, F.expr("array()").cast("array<int>")), lambda i: F.substring(w, i, n))

        return F.flatten(F.transform(sizes, by_size))

    return F.flatten(F.transform(padded_words(text), of))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of the 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _gram_hashes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The grams of ``char_grams`` of words without their blanks, as 64-bit hashes, in order of words, and how many each has."""
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py()
    text = np.frombuffer(f" {joined} ".encode("utf-32-le"), dtype=np.uint32)
    n = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    begin = np.cumsum(n + 1) - (n + 1)  # of the blank before each word
    room = np.repeat(begin + n + 2, n + 1) - np.arange(n.sum() + len(n))  # characters from each place to the blank behind the word
    out = np.empty((len(room), HIGH - LOW + 1), dtype=np.uint64)
    h = np.zeros(len(room), dtype=np.uint64)
    padded = np.concatenate([text, np.zeros(HIGH, dtype=np.uint32)]).astype(np.uint64)
    for k in range(1, HIGH + 1):
        h = h * np.uint64(0x9E3779B97F4A7C15) + padded[k - 1 : k - 1 + len(h)] + np.uint64(k)
        if k >= LOW:
            out[:, k - LOW] = _mixed(h)
    return out[room[:, None] >= np.arange(LOW, HIGH + 1)], np.sum([np.maximum(0, n + 3 - k) for k in range(LOW, HIGH + 1)], axis=0)


#: Bytes of texts that are worked on together, so that a word's grams are cut once for many rows.
_SIZE = 4_000_000


def _merged(batches: Iterator[pa.RecordBatch], text: int, size: int) -> Iterator[pa.RecordBatch]:
    """The batches, small ones put together up to about so many bytes of a column of texts."""
    own, held = [], 0
    for batch in batches:
        own.append(batch)
        held += batch.column(text).nbytes
        if held >= size / 2:
            yield from pa.Table.from_batches(own).combine_chunks().to_batches()
            own, held = [], 0
    if own:
        yield from pa.Table.from_batches(own).combine_chunks().to_batches()


def _runs(values: np.ndarray) -> np.ndarray:
    """Where the runs of equal sorted values begin."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(values)), dtype=bool), values[1:] != values[:-1]]))


class _Grams:
    """Sorted gram hashes, found by their first bits."""

    def __init__(self, hashes: np.ndarray):
        self.hashes, bits = hashes, len(hashes).bit_length() + 1
        self.shift = np.uint64(64 - bits)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount((hashes >> self.shift).astype(np.int64), minlength=1 << bits))]).astype(np.int32)

    def __len__(self) -> int:
        return len(self.hashes)

    def found(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each asked gram, and whether it is there."""
        if not len(self.hashes):
            return np.zeros(len(asked), dtype=np.int32), np.zeros(len(asked), dtype=bool)
        part = (asked >> self.shift).astype(np.int32)
        at = np.minimum(self.starts[part], len(self.hashes) - 1)
        there = self.hashes[at] == asked
        live = np.flatnonzero(~there)
        end = self.starts[part[live] + 1]
        while len(live):
            more = at[live] + 1 < end
            live, end = live[more], end[more]
            at[live] += 1
            there[live] = self.hashes[at[live]] == asked[live]
            missed = ~there[live]
            live, end = live[missed], end[missed]
        at[~there] = 0
        return at, there


def _word_pairs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row, word, count) of some texts, by row, and the words that the numbers mean."""
    parts = pc.split_pattern(texts, " ")
    found = parts.flatten().dictionary_encode()
    words, code = found.dictionary, found.indices.to_numpy()
    bits = len(words).bit_length()
    key = np.repeat(np.arange(len(texts)) << bits, pc.list_value_length(parts).to_numpy()) | code
    if (blank := pc.index(words, "").as_py()) >= 0:
        key = key[code != blank]
    key.sort()
    first = _runs(key)
    key, count = key[first], np.diff(np.append(first, len(key)))
    return key >> bits, key & ((1 << bits) - 1), count, words


def _expanded(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of runs, one behind the other."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _cells(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, gram number, tf) of some texts' grams, by row, and the sorted gram hashes that the numbers mean."""
    local: dict[str, int] = {}
    rows, words = [], []
    for i, t in enumerate(texts):
        own = [local.setdefault(w, len(local)) for w in t.split(" ") if w]
        rows.append(len(own))
        words += own
    if not words:
        return (np.empty(0, dtype=np.int64),) * 3 + (np.empty(0, dtype=np.uint64),)
    grams, sizes = _gram_hashes(pa.array(local, pa.string()))
    begins = np.cumsum(sizes) - sizes
    hashes, numbers = np.unique(grams, return_inverse=True)
    word = np.array(words, dtype=np.int64)
    n = sizes[word]
    at = np.repeat(begins[word] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    key = np.repeat(np.repeat(np.arange(len(texts)), rows), n) * len(hashes) + numbers[at]
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first] // len(hashes), key[first] % len(hashes), np.diff(np.append(first, len(key))), hashes


def _chunks(texts: pa.Array, size: int, rows: int = 50_000) -> Iterator[tuple[int, pa.Array]]:
    """The texts in runs of about so many bytes, each with the place of its first."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(texts):
        stop = int(np.searchsorted(ends, (ends[first - 1] if first else 0) + size)) + 1
        stop = min(stop, first + rows, len(texts))
        yield first, texts.slice(first, stop - first)
        first = stop


def _counted(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(hashes)
    hashes = hashes[order]
    first = _runs(hashes)
    return hashes[first], np.add.reduceat(counts[order], first) if len(first) else counts


def _rows_by_gram(texts: pa.Array, most: int = 300_000) -> tuple[np.ndarray, np.ndarray]:
    """The sorted grams of some texts, and in how many of the texts each is.

    A gram of one word alone is where the word is; the others are counted by row, about ``most`` cells at a time.
    """
    row, word, _, words = _word_pairs(texts)
    if not len(row):
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    grams, sizes = _gram_hashes(words)
    owner = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    hashes = np.sort(grams)
    hashes = hashes[_runs(hashes)]
    number, _ = _Grams(hashes).found(grams)
    one = np.empty(len(hashes), dtype=np.int32)
    one[number] = owner  # some word that has the gram
    alone = np.ones(len(hashes), dtype=bool)
    alone[number[one[number] != owner]] = False
    df = np.where(alone, np.bincount(word, minlength=len(words))[one], 0)
    number = np.where(alone, -1, np.cumsum(~alone) - 1)[number]
    held = number >= 0
    number, size = number[held], np.bincount(owner[held], minlength=len(words))
    begin = np.cumsum(size) - size
    bits = max(1, int(np.count_nonzero(~alone)).bit_length())
    edges = np.searchsorted(row, np.arange(len(texts) + 1))
    ends = np.concatenate([[0], np.cumsum(size[word])])[edges]  # cells before each row
    told = np.zeros(int(np.count_nonzero(~alone)), dtype=np.int64)
    a, seen = 0, []
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + most, side="right")) - 1)
        b = min(b, a + (1 << (32 - bits)), len(texts)) if bits < 32 else a + 1
        own = slice(edges[a], edges[b])
        n = size[word[own]]
        key = number[_expanded(begin[word[own]], n)] | np.repeat((row[own] - a) << bits, n)
        key = key.astype(np.uint32) if bits < 32 else key
        key.sort()
        seen.append(key[_runs(key)] & ((1 << bits) - 1))
        a = b
    if len(told):
        told += np.bincount(np.concatenate(seen), minlength=len(told))
    df[~alone] = told
    return hashes, df


def _document_counts(batches: Iterator[pa.RecordBatch], most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """(gram, df) over a task's texts; a gram comes again only where the task has more than ``most``. The texts are the df of null."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    held, rows = 0, 0

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(parts[0][0].view(np.int64)), pa.array(parts[0][1])], names=["gram", "df"])

    for batch in _merged(batches, 0, _SIZE):
        rows += batch.num_rows
        for _, texts in _chunks(batch.column(0), _SIZE):
            parts.append(_rows_by_gram(texts))
            held += len(parts[-1][0])
            if held >= most:
                parts = [_counted(*map(np.concatenate, zip(*parts, strict=True)))]
                held = len(parts[0][0])
                if held >= most / 2:
                    yield told()
                    parts, held = [], 0
    if parts:
        parts = [_counted(*map(np.concatenate, zip(*parts, strict=True)))]
        yield told()
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([rows], pa.int64())], names=["gram", "df"])


#: The most grams, besides a block's own, whose weights all tasks know.
_FREQUENT = 1_000_000
#: How far below a bound a product may lie by rounding alone.
_SLACK = 2e-9


#: The grams whose counts are a row's dense part: those that most pairs of row and item share.
_DENSE = 2048


class _Asked:
    """A block of test texts as unit vectors, the weights of the known grams (all of the block's and the frequent ones)."""

    def __init__(self, items: list[int], texts: list[str], grams: np.ndarray, idf: np.ndarray):
        self.items, self.n = np.array(items, dtype=np.int64), len(items)
        self.grams, self.idf = _Grams(grams), idf
        item, gram, tf, hashes = _cells(texts)
        at, there = self.grams.found(hashes)
        keep = there[gram]
        item, gram, tf = item[keep], at[gram[keep]], tf[keep]
        w = tf * idf[gram]
        w = w / np.sqrt(np.bincount(item, weights=w * w, minlength=self.n))[item]
        self.item, self.gram, self.w = item, gram, w  # by item
        self.size = np.bincount(item, minlength=self.n)
        self.begin = np.cumsum(self.size) - self.size

    def whole(self, items: np.ndarray, vector: np.ndarray) -> np.ndarray:
        """The products of one row, dense over the grams, with some items."""
        n = self.size[items]
        place = np.repeat(self.begin[items] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.bincount(np.repeat(np.arange(len(items)), n), weights=vector[self.gram[place]] * self.w[place], minlength=len(items))


_CANDIDATE = "item long, best_id long, best_part long, text string, dot double, upper double, lower double"
#: Cells of words (or rows) and items held at a time, and candidates before those below the best are let go.
_CELLS, _HELD = 40_000_000, 20_000


class _Lists:
    """The block's weights for products by row: a matrix for the dense grams, lists of items for its other grams."""

    def __init__(self, asked: _Asked):
        pairs = np.exp(-asked.idf) * (1 + np.bincount(asked.gram, minlength=len(asked.grams)))  # as df times items
        own = np.argsort(-pairs, kind="stable")[:_DENSE]
        self.place = np.full(len(asked.grams), -1)
        self.place[own] = np.arange(len(own))
        self.square = (asked.idf[own] ** 2).astype(np.float32)
        self.told = np.zeros((len(own), asked.n), dtype=np.float32)
        at, x = self.place[asked.gram], asked.w * asked.idf[asked.gram]
        self.told[at[at >= 0], asked.item[at >= 0]] = x[at >= 0]
        left = np.flatnonzero(at < 0)
        left = left[np.argsort(asked.gram[left], kind="stable")]
        self.item, self.x = asked.item[left], x[left]
        self.size = np.bincount(asked.gram[left], minlength=len(asked.grams))
        self.begin = np.cumsum(self.size) - self.size
        #: By known gram, then for all that are not known: the square of a gram that is not dense; the items of its list and, in the lowest bit, whether it is dense.
        self.single = np.append(np.where(self.place < 0, asked.idf**2, 0.0), 0.0)
        self.kinds = np.append(self.size << 32 | (self.place >= 0), 0)
        #: More than single precision may take from sums of so many terms that are not negative.
        self.most = 1.0 + 2.0**-22 * (len(own) + 16)


class _Chunk:
    """Some texts against a block: bounds of all cosines, and a few rows' products gram by gram."""

    def __init__(self, asked: _Asked, lists: _Lists, first: int, texts: pa.Array, idf_most: float):
        self.asked, self.lists, self.first, self.texts, self.most = asked, lists, first, texts, idf_most
        self.row, self.word, self.count, words = _word_pairs(texts)
        grams, sizes = _gram_hashes(words)
        self.at, there = asked.grams.found(grams)
        self.at[~there] = len(asked.grams)
        self.sizes = sizes
        self.kinds = lists.kinds[self.at]
        self.cells = int((self.kinds >> 32).sum()) + len(self.at)
        self.dense = np.zeros(len(asked.grams))

    def bounds(self) -> Iterator[tuple[int, np.ndarray]]:
        """At least the cosines, by row and item, for some rows at a time, with the place of the first.

        Products are those of the dense grams and, by lists, of the others. The norm is told for the dense grams; for
        the others it is at least that of the words' own norms, as if no two words shared a gram, as weights are not
        negative.
        """
        asked, lists, row, word = self.asked, self.lists, self.row, self.word
        n, m = asked.n, len(lists.square)
        norms, kinds = np.zeros(len(self.sizes)), np.zeros(len(self.sizes), dtype=np.int64)
        if len(self.at):
            some = self.sizes > 0
            starts = (np.cumsum(self.sizes) - self.sizes)[some]
            norms[some] = np.add.reduceat(lists.single[self.at], starts)
            kinds[some] = np.add.reduceat(self.kinds, starts)
        size, others = kinds & 0xFFFFFFFF, kinds >> 32
        place = lists.place[self.at[self.kinds & 1 > 0]]
        listed = self.at[self.kinds >> 32 > 0]
        at = _expanded(lists.begin[listed], lists.size[listed])
        item, x = lists.item[at], lists.x[at]
        begin, behind = np.cumsum(size) - size, np.cumsum(others) - others
        square = np.bincount(row, weights=self.count**2 * norms[word], minlength=len(self.texts))
        edges = np.searchsorted(row, np.arange(len(self.texts) + 1))
        ends = np.concatenate([[0], np.cumsum((size + others)[word])])[edges]  # cells before each row
        a = 0
        while a < len(self.texts):
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + _CELLS // 20, side="right")) - 1)
            b = min(b, a + max(1, _CELLS // 20 // max(m, n)), len(self.texts))
            own, times, r = word[edges[a] : edges[b]], self.count[edges[a] : edges[b]].astype(float), row[edges[a] : edges[b]] - a
            k = size[own]
            cell = np.repeat(r * m, k) + place[_expanded(begin[own], k)]
            tf = np.bincount(cell, weights=np.repeat(times, k), minlength=(b - a) * m).reshape(b - a, m).astype(np.float32)
            total = (tf @ lists.told) * lists.most
            k = others[own]
            at = _expanded(behind[own], k)
            total += np.bincount(np.repeat(r * n, k) + item[at], weights=x[at] * np.repeat(times, k), minlength=(b - a) * n).reshape(b - a, n).astype(np.float32)
            tf *= tf
            low = np.sqrt(np.maximum(square[a:b] + (tf @ lists.square) / lists.most, 1e-6))
            total *= (lists.most / low).astype(np.float32)[:, None]
            yield a, total
            a = b

    def products(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The products of pairs of row and item, in order of rows, and the least and the greatest norm of each pair's row."""
        asked = self.asked
        own, inverse = np.unique(i, return_inverse=True)
        row, gram, tf, hashes = _cells(self.texts.take(pa.array(own)).to_pylist())
        at, there = asked.grams.found(hashes)
        known = there[gram]
        r, g = row[known], at[gram[known]]
        x = tf[known] * asked.idf[g]
        inner = np.bincount(r, weights=x * x, minlength=len(own))
        outer = inner + self.most**2 * np.bincount(row[~known], weights=tf[~known].astype(float) ** 2, minlength=len(own))
        dot = np.empty(len(i))
        ends, cells = np.searchsorted(inverse, np.arange(len(own) + 1)), np.searchsorted(r, np.arange(len(own) + 1))
        for k in range(len(own)):
            a, b = cells[k], cells[k + 1]
            self.dense[g[a:b]] = x[a:b]
            dot[ends[k] : ends[k + 1]] = asked.whole(j[ends[k] : ends[k + 1]], self.dense)
            self.dense[g[a:b]] = 0.0
        return dot, np.sqrt(np.maximum(inner, 1e-300))[inverse], np.sqrt(np.maximum(outer, 1e-300))[inverse]


def _candidates(shared, idf_most: float):
    """The rows that may be the most similar to an item: dot, and an upper and a lower bound of the cosine.

    All cosines are bounded first (see ``_Chunk.bounds``); exactly made are those of the highest row of each item among
    some rows, and then of the pairs whose bound still reaches the best lower bound so far. A row's norm is at least that
    of its known grams, and at most that with all its other grams as heavy as can be. Of rows with one text the least is
    told.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        best = np.zeros(asked.n)
        lists = _Lists(asked)
        found: dict[tuple, tuple] = {}

        def told() -> pa.RecordBatch:
            own = [(k[0], *f[1:3], k[1], *f[3:]) for k, f in found.items()]
            columns = list(zip(*own, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.float64())
            columns[0] = asked.items[list(columns[0])].tolist()
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in _CANDIDATE.split(", ")])

        def lessened() -> None:
            for k in [k for k, f in found.items() if f[4] < best[k[0]] - _SLACK]:
                del found[k]

        def pieces(first: int, texts: pa.Array) -> Iterator[tuple]:
            """Bounds of the texts, in parts of few enough cells; one text of too many may reach all items."""
            chunk = _Chunk(asked, lists, first, texts, idf_most)
            if chunk.cells <= _CELLS // 4:
                yield from ((chunk, *own) for own in chunk.bounds())
            elif len(texts) == 1:
                yield chunk, 0, np.full((1, asked.n), 2.0, dtype=np.float32)
            else:
                half = len(texts) // 2
                yield from pieces(first, texts.slice(0, half))
                yield from pieces(first + half, texts.slice(half))

        for batch in _merged(batches, 2, _SIZE):
            ids, parts = batch.column(0), batch.column(1)
            runs = _chunks(batch.column(2), _SIZE)
            for chunk, start, bound in (piece for run in runs for piece in pieces(*run)):
                most = bound.max(axis=0)
                j = np.flatnonzero((most >= best - _SLACK) & (most > 0))
                top = bound[:, j].argmax(axis=0)
                order = np.argsort(top, kind="stable")
                top, j = top[order], j[order]
                dot, _, high = chunk.products(start + top, j)
                best[j] = np.maximum(best[j], dot / high)
                j = j[most[j] >= best[j] - _SLACK]
                i, k = np.nonzero((bound[:, j] >= (best[j] - _SLACK).astype(np.float32) * np.float32(1 - 2.0**-20)) & (bound[:, j] > 0))
                j = j[k]
                dot, low, high = chunk.products(start + i, j)
                np.maximum.at(best, j, dot / high)
                keep = (dot / low >= best[j] - _SLACK) & (dot > 0)
                for a, b, d, u, v in zip((start + i[keep]).tolist(), j[keep].tolist(), dot[keep].tolist(), (dot / low)[keep].tolist(), (dot / high)[keep].tolist(), strict=True):
                    row, part = ids[chunk.first + a].as_py(), parts[chunk.first + a].as_py()
                    key, own = (b, chunk.texts[a].as_py()), ((row is None, row or 0, part is None, part or 0), row, part, d, u, v)
                    if key not in found or own[0] < found[key][0]:
                        found[key] = own
                if len(found) > _HELD:
                    lessened()
                    if len(found) > _HELD // 2:
                        yield told()
                        found = {}
        lessened()
        yield told()

    return run


def _own_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text_key, gram, tf) of (text_key, text)."""
    for batch in batches:
        for first, texts in _chunks(batch.column(1), _SIZE):
            row, gram, tf, hashes = _cells(texts.to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first + row)), pa.array(hashes[gram].view(np.int64)), pa.array(tf)], names=["text_key", "gram", "tf"])


def _test_blocks(asked: DataFrame, block_grams: int) -> Iterator[tuple[list[int], list[str]]]:
    """The test texts in runs of about so many characters, as each starts up to three grams, and one text at least."""
    items, texts, held = [], [], 0
    for r in asked.select("item", "text").toLocalIterator():
        items.append(r.item)
        texts.append(r.text)
        held += 3 * len(r.text)
        if held >= block_grams:
            yield items, texts
            items, texts, held = [], [], 0
    if items:
        yield items, texts


def nearest(train: DataFrame, test: DataFrame, row_id: str, text: str, least_df: int = 2, part: str | None = None, block_grams: int = 2_000_000) -> DataFrame:
    """For each test id the most similar train row by cosine: (id, best_id, similarity); 0 and null without a common gram.

    Weights are fitted on train alone. Every train row is held against every test text; ties go to the least
    train id. With ``part``, a train row is known by (row_id, part), ``best_part`` is told too, and ties go to
    the least pair. Train rows that share an id are texts of their own; test rows that share one are one text.

    The test side is the query set, broadcast in blocks of about ``block_grams`` grams with the weights of its own grams
    and of the most frequent ones, whose number is bounded; a block's candidates are written before the next one is sent.
    Train rows are cut and written once, and read for the counts and by each block. Tasks go over their own rows with
    bounds (see ``_candidates``), so no list of train rows is shuffled: counts of grams, summed per task before, stay a
    table, dealt by the gram, and only texts of candidates that the best lower bounds of all tasks leave meet it for
    their norms.
    """
    spark = train.sparkSession
    place = F.lit(0) if part is None else F.col(part)
    plain = F.lower(T.collapse(F.coalesce(F.col(text), F.lit(""))))
    rows = train.select(F.col(row_id).cast("long").alias("id"), place.cast("long").alias("part"), plain.alias("text"))
    asked = test.select(F.col(row_id).alias("id"), plain.alias("text")).groupBy("id").agg(F.concat_ws(" ", F.array_sort(F.collect_list("text"))).alias("text"))
    asked = written(asked.withColumn("item", F.monotonically_increasing_id()), "asked")
    rows = written(rows, "rows")
    df = rows.select("text").mapInArrow(_document_counts, "gram long, df long").groupBy("gram").agg(F.sum("df").alias("df"))
    df = written(df.where((F.col("df") >= least_df) | F.col("gram").isNull()), "df")
    n = max((r.df for r in df.where("gram IS NULL").collect()), default=0)
    weights = df.where("gram IS NOT NULL").withColumn("idf", F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0)
    most = float(np.log((1.0 + n) / (1.0 + least_df)) + 1.0)
    level = F.floor(F.log2("df") * 16)
    often, least_level = 0, None
    for r in sorted(weights.groupBy(level.alias("level")).count().collect(), reverse=True):
        often += r["count"]
        if often > _FREQUENT:
            break
        least_level = r.level
    frequent = weights.where(level >= least_level if least_level is not None else F.lit(False)).select("gram", "idf").toPandas()
    weights = weights.select("gram", "idf")

    tried = None
    for items, texts in _test_blocks(asked, block_grams):
        grams = np.unique(_cells(texts)[3])
        own = pd.concat([frequent, spark.createDataFrame(pa.table({"gram": grams.view(np.int64)})).join(weights, "gram").toPandas()])
        known, first = np.unique(own["gram"].to_numpy(np.int64).view(np.uint64), return_index=True)
        shared = spark.sparkContext.broadcast(_Asked(items, texts, known, own["idf"].to_numpy(float)[first]))
        found = written(rows.mapInArrow(_candidates(shared, max(most, 0.0)), _CANDIDATE), "candidates")
        shared.destroy()
        tried = found if tried is None else tried.unionByName(found)
    if tried is None:
        tried = spark.createDataFrame([], _CANDIDATE)
    tried = tried.withColumn("text_key", F.sha2("text", 256))

    def measured(candidates: DataFrame) -> DataFrame:
        """The candidates with their cosine; only their distinct texts are cut into grams."""
        cells = candidates.select("text_key", "text").dropDuplicates(["text_key"]).mapInArrow(_own_grams, "text_key string, gram long, tf long")
        norms = cells.join(weights, "gram").groupBy("text_key").agg(F.sqrt(F.sum((F.col("tf") * F.col("idf")) ** 2)).alias("norm"))
        return candidates.join(norms, "text_key").select("item", "best_id", "best_part", "text_key", (F.col("dot") / F.col("norm")).alias("similarity"))

    bound = tried.groupBy("item").agg(F.max("lower").alias("least"))
    scores = measured(tried.join(bound, "item").where(F.col("upper") >= F.col("least") - 1e-8))
    order = F.struct(F.round("similarity", 9), F.col("best_id").isNotNull(), -F.col("best_id"), -F.col("best_part"))
    top = scores.groupBy("item").agg(F.max_by(F.struct("best_id", "best_part", "similarity"), order).alias("t"))
    told = [F.col("t.best_id").alias("best_id")] + ([] if part is None else [F.col("t.best_part").alias("best_part")])
    return asked.join(top, "item", "left").select("id", *told, F.coalesce("t.similarity", F.lit(0.0)).alias("similarity"))


def threshold_flags(similarity: Column, thresholds: tuple[float, ...] = (0.80, 0.90, 0.95)) -> list[Column]:
    return [(similarity >= t).alias(f"at_least_{int(round(t * 100))}") for t in thresholds]


def contamination(similarities: DataFrame) -> DataFrame:
    """Rows and shares at or above each threshold."""
    flags = similarities.select(*threshold_flags(F.col("similarity")))
    return flags.agg(F.count("*").alias("rows"), *[F.avg(F.col(c).cast("double")).alias(f"share_{c}") for c in flags.columns])


#: The order of merged changes.
HARM_ORDER = {"harmful": 0, "neutral": 1, "fair": 2}
TYPE_ORDER = {"modified": 0, "added": 1, "removed": 2}


def _rank(c: Column, order: dict[str, int]) -> Column:
    found = F.lit(9)
    for name, place in order.items():
        found = F.when(c == name, F.lit(place)).otherwise(found)
    return found


def merged_changes(changes: DataFrame, document: str = "doc_id", pos: str = "pos", what: str = "what_changed", least: float = 0.82) -> DataFrame:
    """Changes of each document without repeats, in order of harm and type, with ids ``change_001`` and on.

    In order of ``pos`` a change is dropped if its text equals a kept one's, or their words' Jaccard reaches
    ``least``; one without text always stays. The fold runs over one document's changes, a bounded list.
    """
    words = T.change_words(F.col(what))
    entry = F.struct(F.col(pos).alias("pos"), T.change_text(F.col(what)).alias("t"), words.alias("w"), "harm_label", "change_type", F.col(what).alias("what"))
    lists = changes.groupBy(F.col(document).alias("document")).agg(F.array_sort(F.collect_list(entry)).alias("all"))

    def step(kept: Column, x: Column) -> Column:
        again = F.exists(kept, lambda k: (k["t"] != "") & ((k["t"] == x["t"]) | (T.jaccard(k["w"], x["w"]) >= least)))
        return F.when((x["t"] != "") & again, kept).otherwise(F.concat(kept, F.array(x)))

    kept = F.aggregate("all", F.slice("all", 1, 0), step)
    ranked = F.transform(kept, lambda x: F.struct(_rank(x["harm_label"], HARM_ORDER).alias("h"), _rank(x["change_type"], TYPE_ORDER).alias("c"), x["pos"].alias("pos"), x["what"].alias("what"), x["harm_label"].alias("harm_label"), x["change_type"].alias("change_type")))
    told = lists.select("document", F.posexplode(F.array_sort(ranked)).alias("i", "x"))
    return told.select("document", F.format_string("change_%03d", F.col("i") + 1).alias("id"), F.col("x.what").alias("what_changed"), F.col("x.harm_label").alias("harm_label"), F.col("x.change_type").alias("change_type"))
