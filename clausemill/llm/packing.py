"""Packing of token sequences into windows by multiway differencing.

Each document is cut into full windows, which stand alone, and a rest, which stays whole if it can. The rests of a
block are packed by Karmarkar-Karp differencing into k windows: every rest starts as a partial partition of k sums
of which one is not zero; the two partial partitions with the largest imbalance are merged, the largest sum of one
with the smallest of the other, until one is left. That leaves sums near each other, some above the capacity.
Only what lies above is cut off, from the window's largest rest, and goes into the room of other windows, whole where
it fits one; no piece is cut shorter than ``fine``. k starts at the fewest windows that could hold the block and
rises whenever the windows exceed their capacity even so.

Blocks are runs of consecutive rows within one input partition, so nothing is shuffled, memory is that of
one block, and a lost task gives the same pieces again when it is run again over the same partition. A
sequence id holds the partition, then a running number.

Defined results for odd input: a null text counts as empty, so its document is the end id alone; a null
document id is kept as null; bytes that are not UTF-8 become U+FFFD; equal rows are packed each on its own; a document of any length is cut as above;
an empty table gives an empty table; other columns are ignored, also ones whose names differ by case only.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausemill.llm.columns import picked, utf8
from clausemill.llm.tokenizer import coder, vocabulary

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp: the indexes of ``sizes`` in k groups with sums as near each other as differencing gets.

    A partial partition is a list of at most k (sum, tree) pairs in falling order, without the empty groups.
    A tree is an index or a pair of trees. The heap holds partial partitions by falling imbalance.
    """
    if not sizes:
        return [[] for _ in range(k)]
    heap = [(-size, i, [(size, i)]) for i, size in enumerate(sizes)]
    if k == 1:
        return [list(range(len(sizes)))]
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if len(a) < len(b):
            a, b = b, a
        over = len(a) + len(b) - k
        if over <= 0:  # none of b's sums meets one of a's
            merged = a + b
        else:  # b's largest go to a's empty groups, the others to a's smallest
            free = len(b) - over
            joined = [(a[-1 - j][0] + b[free + j][0], (a[-1 - j][1], b[free + j][1])) for j in range(over)]
            merged = a[: len(a) - over] + b[:free] + joined
        merged.sort(key=lambda x: -x[0])
        least = merged[-1][0] if len(merged) == k else 0
        heapq.heappush(heap, (least - merged[0][0], serial, merged))
        serial += 1
    groups = []
    for _, tree in heap[0][2]:
        found, stack = [], [tree]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack += x
            else:
                found.append(x)
        groups.append(sorted(found))
    return groups + [[] for _ in range(k - len(groups))]


#: (index of the rest, start in it, length)
Piece = tuple[int, int, int]


def level(windows: list[list[Piece]], capacity: int, fine: int) -> bool:
    """Moves what lies above the capacity into the room of other windows, in place; false where it finds none."""
    residue: list[Piece] = []
    rooms: list[tuple[int, int]] = []
    for w, pieces in enumerate(windows):
        held = sum(p[2] for p in pieces)
        while held > capacity:
            at = max(range(len(pieces)), key=lambda j: pieces[j][2])
            i, start, size = pieces[at]
            cut = max(held - capacity, fine)
            if size - cut < fine:
                cut = size
                del pieces[at]
            else:
                pieces[at] = (i, start, size - cut)
            residue.append((i, start + size - cut, cut))
            held -= cut
        if held < capacity:
            rooms.append((capacity - held, w))
    rooms.sort()
    for i, start, size in sorted(residue, key=lambda p: -p[2]):
        while size:
            at = bisect_left(rooms, (size, -1))
            if at == len(rooms):  # none holds it whole
                if not rooms or rooms[-1][0] < fine:
                    return False
                at = len(rooms) - 1
            room, w = rooms.pop(at)
            part = size if room >= size else min(room, max(fine, size - fine))
            windows[w].append((i, start, part))
            start, size = start + part, size - part
            if room > part:
                insort(rooms, (room - part, w))
    return True


def pack_block(sizes: list[int], capacity: int, fine: int = 8) -> list[list[Piece]]:
    """Windows of pieces of the rests, none above capacity: differencing over the fewest windows that hold them."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        windows = [[(i, 0, sizes[i]) for i in g] for g in difference(sizes, k)]
        if level(windows, capacity, fine):
            return [w for w in windows if w]
        k += 1


def pack_documents(
    docs: DataFrame,
    vocabulary_path: str | None = None,
    capacity: int = 1024,
    fine: int = 8,
    block: int = 1024,
    end_id: int = 0,
    doc_id: str = "doc_id",
    text: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """One row a piece: its document, start, length and checksum, and its sequence and offset there; its ids on request."""
    path = vocabulary_path or vocabulary()
    schema = SCHEMA + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, end = coder(path), end_id.to_bytes(4, "little")
        base, number = TaskContext.get().partitionId() << 40, 0
        pending: list[tuple] = []

        def rows(found: list[tuple]) -> pa.RecordBatch:
            import numpy as np

            frame = pd.DataFrame([r[:7] for r in found], columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            arrays = [pa.array(frame[c], pa.int64(), from_pandas=True) for c in frame.columns]
            names = list(frame.columns)
            if with_ids:
                arrays.append(pa.array([np.frombuffer(r[7], "<u4").astype("int32") for r in found], pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(arrays, names)

        def piece(key, own: bytes, start: int, n: int, sequence: int, offset: int) -> tuple:
            return (key, start, len(own) // 4, zlib.crc32(own), n, sequence, offset, own if with_ids else None)

        def packed() -> list[tuple]:
            nonlocal number
            found = []
            for window in pack_block([len(rest) // 4 for _, rest, _, _ in pending], capacity, fine):
                at = 0
                for i, begin, length in window:
                    key, rest, start, n = pending[i]
                    found.append(piece(key, rest[4 * begin : 4 * (begin + length)], start + begin, n, base + number, at))
                    at += length
                number += 1
            pending.clear()
            return found

        out: list[tuple] = []
        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = code.encode(value.as_py() or "") + end
                n = len(ids) // 4
                full = n - n % capacity
                for start in range(0, full, capacity):
                    out.append(piece(key, ids[4 * start : 4 * (start + capacity)], start, n, base + number, 0))
                    number += 1
                if full < n:
                    pending.append((key, ids[4 * full :], full, n))
                if len(pending) >= block:
                    out += packed()
                if len(out) >= 20_000:
                    yield rows(out)
                    out = []
        out += packed()
        if out:
            yield rows(out)

    return picked(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long"), utf8(F.col("text"))).mapInArrow(run, schema)
