"""Edit-distance join of names by descents of tries whose nodes carry rows of the distance table.

Distance is optimal string alignment: insertions, deletions, substitutions and exchanges of neighbours, no place edited
twice. Names are told once; the join is between distinct names.

Shards. A name of length L is in shards of that length. A pair within two edits has at most one of them in the first
half of the name, or at most one in its last half (an exchange across the middle counts in both, and then the other
edit is in one half only). Where a half has at most one, so have its first ``zone`` characters, and then both names
share a string that is left when one character is taken out of that beginning. Direction, length and such a string are
the shard; for the last half all is read backwards. A shard with more names or queries than a unit holds is dealt into
a grid of units by a hash of the names; their number has a bound that does not grow with the input.

Descent. The names of a unit, sorted, are a trie: a node of depth d is a run of rows that agree in d characters. All
queries go down together, level by level: a state is a node, a query and the row of the table for the node's prefix,
five cells about the diagonal, beside the row before it, which exchanges of neighbours need. A child's row comes from
its parent's, so rows are shared along prefixes. A cell that the rest of both lengths cannot bring within the distance
is closed; a state leaves when no cell is within it, and in the first half when none is within one edit. Levels that
grow beyond ``STATES`` are gone through in slices, so memory has a bound.

Defined results for odd input: null and empty names take no part on either side; repeated names are one name; a name of
any length is used whole (its unit holds its characters once); bytes that are not UTF-8 become U+FFFD; empty tables give
an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausemill.llm.columns import picked, utf8

#: Characters of a shard's beginning, names or queries of a unit, and the most shards that may be dealt into grids, halved.
ZONE, UNIT, HEAVY = 5, 50_000, 1024
#: States that one step of a descent expands, about, and rows that are gathered before a descent.
STATES, GATHERED = 400_000, 60_000
MOST = 2
_FAR = MOST + 1
_PAD = 2 * MOST


def plain_name(c: Column) -> Column:
    """A name in the form that is compared: A-Z in lower case, bytes that are not UTF-8 replaced."""
    return F.translate(utf8(c), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _codes(names: list[str], width: int) -> np.ndarray:
    """The code points of names plus one, zeros after the end."""
    n = np.fromiter(map(len, names), dtype=np.int64, count=len(names))
    flat = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), dtype=np.uint32) + np.uint32(1)
    out = np.zeros((len(names), width), dtype=np.uint32)
    row = np.repeat(np.arange(len(names)), n)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def descend(unit: np.ndarray, names: list[str], asked_unit: np.ndarray, asked: list[str], states: int = STATES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, name, distance) of the pairs of one unit within two edits, of which one at most is in the first half.

    All names have one length; they are sorted within units and distinct.
    """
    none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int8))
    if not names or not asked:
        return none
    length = len(names[0])
    c = _codes(names, length)
    n_asked = np.fromiter(map(len, asked), dtype=np.int64, count=len(asked))
    q = np.zeros((len(asked), length + MOST + 2 * _PAD + 2), dtype=np.uint32)
    q[:, _PAD : _PAD + length + MOST] = _codes(asked, length + MOST)
    fresh = np.ones((len(names), length + 1), dtype=bool)
    fresh[1:, 0] = unit[1:] != unit[:-1]
    fresh[1:, 1:] = np.logical_or.accumulate(c[1:] != c[:-1], axis=1) | fresh[1:, :1]
    starts = [np.flatnonzero(fresh[:, d]) for d in range(length + 1)]
    offset = np.arange(-MOST, MOST + 1)
    last = n_asked - length
    root = np.searchsorted(unit[starts[0]], asked_unit)
    there = (root < len(starts[0])) & (unit[starts[0]][np.minimum(root, len(starts[0]) - 1)] == asked_unit)
    query = np.flatnonzero(there)
    row = np.where(offset < 0, _FAR, offset).astype(np.int8)
    row = np.where(offset[None, :] > n_asked[query, None], _FAR, row[None, :]).astype(np.int8)
    todo = [(0, root[query], query, row, np.full_like(row, _FAR))]
    found = []
    while todo:
        depth, node, query, row, before = todo.pop()
        here, below = starts[depth], starts[depth + 1]
        low = np.searchsorted(below, here[node])
        high = np.searchsorted(below, np.append(here, len(names))[node + 1])
        n = high - low
        if len(node) > 1 and n.sum() > states:
            for part in np.array_split(np.arange(len(node)), min(len(node), int(n.sum() // states) + 1)):
                todo.append((depth, node[part], query[part], row[part], before[part]))
            continue
        at = np.repeat(np.arange(len(node)), n)
        child = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + low[at]
        query, row, before = query[at], row[at], before[at]
        letter = c[below[child], depth][:, None]
        window = q[:, depth + 1 : depth + 3 + 2 * MOST][query]
        mine, behind = window[:, 1:], window[:, :-1]
        new = row + (letter != mine)
        new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + 1)
        if depth:
            swap = (letter == behind) & (c[below[child], depth - 1][:, None] == mine)
            new = np.where(swap, np.minimum(new, before + 1), new)
        place = depth + 1 + offset
        outside = (place[None, :] < 0) | (place[None, :] > n_asked[query][:, None])
        new[outside] = _FAR
        for k in range(1, 2 * MOST + 1):
            new[:, k] = np.minimum(new[:, k], new[:, k - 1] + 1)
        new[outside] = _FAR
        rest = np.abs(last[query][:, None] - offset[None, :])
        new = np.where(new + rest > MOST, _FAR, new).astype(np.int8)
        live = new.min(axis=1) <= (1 if depth + 1 <= length // 2 else MOST)
        child, query, new, row = child[live], query[live], new[live], row[live]
        if depth + 1 < length:
            if len(child):
                todo.append((depth + 1, child, query, new, row))
            continue
        told = new[np.arange(len(child)), last[query] + MOST]
        ok = told <= MOST
        found.append((query[ok], below[child[ok]], told[ok]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else none


_SHARD = ("backward", "length", "part", "chunk")


def _changes(table: pa.Table, names: tuple[str, ...]) -> np.ndarray:
    """Where rows differ from the one before in any of the columns."""
    out = np.zeros(table.num_rows, dtype=bool)
    out[:1] = True
    for n in names:
        x = table.column(n).combine_chunks()
        x = x.dictionary_encode().indices.to_numpy() if pa.types.is_string(x.type) else x.to_numpy(zero_copy_only=False)
        out[1:] |= x[1:] != x[:-1]
    return out


def _found(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """The pairs of whole units, which are sorted by shard, side and name."""
    unit = np.cumsum(_changes(table, _SHARD))
    runs = np.append(np.flatnonzero(_changes(table, ("backward", "length"))), table.num_rows)
    side = table.column("side").to_numpy()
    for a, b in zip(runs[:-1].tolist(), runs[1:].tolist(), strict=True):
        names = table.column("name").slice(a, b - a).to_pylist()
        own, asks = np.flatnonzero(side[a:b] == 0), np.flatnonzero(side[a:b] == 1)
        left, right = [names[i] for i in own], [names[i] for i in asks]
        query, name, distance = descend(unit[a:b][own], left, unit[a:b][asks], right)
        if len(query):
            turn = -1 if table.column("backward")[a].as_py() else 1
            columns = [pa.array([right[i][::turn] for i in query.tolist()], pa.string()), pa.array([left[i][::turn] for i in name.tolist()], pa.string()), pa.array(distance.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["query", "name", "distance"])


def _descents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    rows, wanted = 0, GATHERED
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < wanted:
            continue
        table = pa.Table.from_batches(held)
        cut = int(np.flatnonzero(_changes(table, _SHARD))[-1])  # the last unit may go on in the next batch
        if cut:
            yield from _found(table.slice(0, cut))
        held = table.slice(cut).to_batches()
        rows = table.num_rows - cut
        wanted = max(GATHERED, 2 * rows)
    if rows:
        yield from _found(pa.Table.from_batches(held))


def _shards(names: DataFrame, zone: int, side: int) -> DataFrame:
    """(backward, length, part, side, name): a name's shards, at its own length; a query's at all lengths that its pairs may have."""
    n = F.length("name")
    lengths = F.array(n) if side == 0 else F.filter(F.transform(F.array(*[F.lit(k) for k in range(-MOST, MOST + 1)]), lambda k: n + k), lambda x: x > 0)
    each = names.select("name", F.explode(lengths).alias("length"))
    both = each.select("length", F.explode(F.array(*[F.struct(F.lit(b).alias("backward"), (F.reverse("name") if b else F.col("name")).alias("name")) for b in (False, True)])).alias("d")).select("length", "d.*")
    reach = F.least(F.lit(zone), F.floor(F.col("length") / 2).cast("int"))
    begin = F.substring(F.col("name"), F.lit(1), reach)
    parts = F.transform(F.sequence(F.lit(1), F.greatest(reach, F.lit(1))), lambda i: F.concat(F.substring(begin, F.lit(1), i - 1), F.substring(begin, i + 1, F.lit(zone))))
    return both.select("backward", "length", F.explode(F.array_distinct(parts)).alias("part"), F.lit(side).alias("side"), "name")


def near_names(names: DataFrame, queries: DataFrame, name: str = "name", query: str = "name", zone: int = ZONE, unit: int = UNIT) -> DataFrame:
    """(query, name, distance): every pair of a distinct query and a distinct name within two edits, taken as they stand."""
    one = lambda df, c: picked(df, name=c).select(utf8(F.col("name")).alias("name")).where("name != ''").distinct()
    rows = _shards(one(names, name), zone, 0).unionByName(_shards(one(queries, query), zone, 1))
    shard = ["backward", "length", "part"]
    sizes = rows.groupBy(*shard).agg(F.count_if(F.col("side") == 0).alias("names"), F.count_if(F.col("side") == 1).alias("queries"))
    total = sizes.agg(F.coalesce(F.sum("names"), F.lit(0)).alias("n"), F.coalesce(F.sum("queries"), F.lit(0)).alias("q")).first()
    most_n, most_q = max(unit, total.n // HEAVY), max(unit, total.q // HEAVY)
    # at most 2 * HEAVY rows, whatever the input
    heavy = sizes.where((F.col("names") > most_n) | (F.col("queries") > most_q))
    heavy = heavy.select(*shard, F.ceil(F.col("names") / most_n).cast("int").alias("down"), F.ceil(F.col("queries") / most_q).cast("int").alias("across")).collect()
    if heavy:
        grid = names.sparkSession.createDataFrame(heavy, "backward boolean, length int, part string, down int, across int")
        told = rows.join(F.broadcast(grid), shard, "left").withColumns({"down": F.coalesce("down", F.lit(1)), "across": F.coalesce("across", F.lit(1))})
        own = F.pmod(F.xxhash64("name"), F.when(F.col("side") == 0, F.col("down")).otherwise(F.col("across"))).cast("int")
        others = F.sequence(F.lit(0), F.when(F.col("side") == 0, F.col("across")).otherwise(F.col("down")) - 1)
        chunks = F.transform(others, lambda k: F.when(F.col("side") == 0, own * F.col("across") + k).otherwise(k * F.col("across") + own))
        rows = told.select(*shard, F.explode(chunks).alias("chunk"), "side", "name")
    else:
        rows = rows.withColumn("chunk", F.lit(0))
    dealt = rows.repartition(*_SHARD).sortWithinPartitions(*_SHARD, "side", "name")
    return dealt.mapInArrow(_descents, "query string, name string, distance int").distinct()
