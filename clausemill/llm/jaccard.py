"""Jaccard join on word shingles with prefix filters under several global token orders.

A document is the set of its distinct shingles, as 64-bit hashes. Documents with equal sets are one node. If
two sets reach the similarity, they share a token among the first ``n - ceil(t * n) + 1`` of each, under any
total order of the tokens. Three orders are used, all with rare tokens first: by exact document frequency;
and twice by its power of two with differently mixed hashes inside. A pair is a candidate only if it shares a
prefix token under each of them. The orders also give the places of the shared token, which with the
sizes bound the overlap; so does, within groups that stay open, a bitmap of token parities. Tokens of one document
only never make a pair, so only repeated ones are kept. A set has a digest of 128 bits. A node's name is the first
half; where sets that differ in the second half share the first (about three pairs among 10^10 sets), those sets
take the second half as their name. These few first halves are the only names that come to the driver.

1. One pass makes (document, set size, node) and the tokens that are frequent within a task (in 8 documents or
   more), counted in bounded memory whatever the size of batches. Tokens whose frequent parts sum to half of ``hot_share`` of all documents are hot; their number has
   a bound that does not grow with the input (twice the mean set size over that share), so they are broadcast.
   That changes where a token is counted and its place among the frequent ones, never a result.
2. A second pass sends every other token to a bucket, as packed arrays. A bucket finds the tokens of two or
   more nodes and sends them with their frequency to the nodes' buckets. Hot tokens go to the nodes directly,
   with their frequency, so no bucket gathers a hot token.
3. A node keeps its repeated tokens in the first order. Unless its prefix reaches one, it has no link.
4. Star rounds: in every token's group each node is tried against one pivot, then against a few of those that
   lie in other components, so the pairs are linear in the group; verified links give components. Then the pairs
   that lie in different components, and only those, are tried: links inside a component change no component, and no other link is left out. So the result is
   components; the links inside them, or their number per document, are not found.

Defined results for odd input: a null or empty text, or one without words, has no shingle and is linked with
nothing; bytes that are not UTF-8 become U+FFFD; a shorter text than a shingle is one shingle; equal rows are one node; documents with a null id are
counted but give no component id (null if there is no other in the component); empty tables give empty
tables; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausemill.llm.columns import Passing, let, picked, utf8
from clausemill.llm.components import components
from clausemill.llm.store import Store

#: Share of all documents from which on a token is hot, and the least number of documents for that.
HOT_SHARE, HOT_LEAST = 1 / 4096, 512
#: Tokens that one bucket holds, about.
BUCKET_TOKENS = 2_000_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh3_64_intdigest(word)
        if len(self) >= 100_000:
            self.clear()
        self[word] = found
        return found


_WORDS = _WordHashes()
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0x27D4EB2F165667C5, 0x94D049BB133111EB, 0xBF58476D1CE4E5B9], dtype=np.uint64)


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A fixed permutation of the 64-bit numbers."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text: A-Z in lower case, words between blanks."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(words) < size:
        whole = hashlib.blake2b(b" ".join(words), digest_size=8).digest()
        return np.frombuffer(whole, dtype=np.uint64).copy()
    h = np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))
    n = len(h) - size + 1
    total = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        total = mixed(total) + h[k : k + n] * _FACTORS[k % len(_FACTORS)]
    return np.unique(mixed(total))


def node_of(found: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """The two halves of a set's digest, the first cut to ``bits``."""
    digest = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
    first, second = (int.from_bytes(h, "little", signed=True) for h in (digest[:8], digest[8:]))
    return first >> (64 - bits), second


#: Tokens that a task counts at a time.
_COUNTED = 2_000_000


def _frequent(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The summed counts of tokens, at most half of ``_COUNTED``: where there are more, all counts fall by that of the first left out."""
    tokens, at = np.unique(np.concatenate([t for t, _ in parts]), return_inverse=True)
    counts = np.bincount(at, weights=np.concatenate([c for _, c in parts])).astype(np.int64)
    if len(tokens) > _COUNTED // 2:
        less = np.partition(counts, -(_COUNTED // 2) - 1)[-(_COUNTED // 2) - 1]
        keep = counts > less
        tokens, counts = tokens[keep], counts[keep] - less
    return tokens, counts


def _batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


_PROFILE = "doc_id long, n long, node long, other long, token long"


def _profile(size: int, hot_share: float, hot_least: int, bits: int = 64):
    """First pass: (doc_id, n, node, other, null) rows, and (null, count, null, null, token) rows of a task's frequent tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        held = rows = 0
        for batch in batches:
            sets = [shingles(t.as_py(), size) for t in batch.column(1)]
            nodes = [node_of(s, bits) for s in sets]
            n = [len(s) for s in sets]
            first, second = (pa.array([x[i] for x in nodes], pa.int64()) for i in range(2))
            yield _batch({"doc_id": batch.column(0), "n": pa.array(n, pa.int64()), "node": first, "other": second, "token": pa.nulls(len(n), pa.int64())})
            own = list({k: s for k, s in zip(nodes, sets, strict=True)}.values())
            rows += len(own)
            if own:
                parts.append(np.unique(np.concatenate(own), return_counts=True))
                held += len(parts[-1][0])
                if held >= _COUNTED:
                    parts = [_frequent(parts)]
                    held = len(parts[0][0])
        if parts:
            tokens, counts = _frequent(parts)
            many = counts >= max(8, hot_share * rows / 4)
            none = pa.nulls(int(many.sum()), pa.int64())
            yield _batch({"doc_id": none, "n": pa.array(counts[many], pa.int64()), "node": none, "other": none, "token": pa.array(tokens[many].view(np.int64), pa.int64())})

    return run


_MESSAGE = "bucket int, kind int, nodes binary, sizes binary, counts binary, tokens binary, dfs binary"


def _message(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _MESSAGE.split(", ")])


def _dealt(bucket: np.ndarray, nodes: np.ndarray, sizes: np.ndarray, tokens: np.ndarray, dfs: np.ndarray | None) -> Iterator[tuple]:
    """One row for each bucket: its nodes with their sizes and token counts, its tokens and frequencies. Rows of a node must be together."""
    order = np.argsort(bucket, kind="stable")
    bucket, nodes, sizes, tokens = bucket[order], nodes[order], sizes[order], tokens[order]
    dfs = dfs[order] if dfs is not None else None
    edges = np.flatnonzero(np.diff(bucket)) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(bucket)], strict=True):
        first = np.flatnonzero(np.concatenate([[True], nodes[a + 1 : b] != nodes[a : b - 1]])) + a
        counts = np.diff(np.append(first, b)).astype(np.uint32)
        yield (int(bucket[a]), nodes[first].tobytes(), sizes[first].astype(np.uint32).tobytes(), counts.tobytes(), tokens[a:b].tobytes(), dfs[a:b].astype(np.uint32).tobytes() if dfs is not None else b"")


def _send(size: int, buckets: int, hot, bits: int = 64, flush: int = 1_000_000):
    """Second pass: tokens to token buckets (kind 0); hot ones with their frequency to node buckets (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_tokens, hot_dfs, shared_names = hot.value

        def told(sets: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
            n = np.array([len(s) for s in sets.values()], dtype=np.int64)
            tokens = np.concatenate(list(sets.values()))
            nodes, sizes = np.repeat(np.array(list(sets), dtype=np.int64), n), np.repeat(n, n)
            rows = []
            if len(hot_tokens):
                at = np.minimum(np.searchsorted(hot_tokens, tokens), len(hot_tokens) - 1)
                is_hot = hot_tokens[at] == tokens
                if is_hot.any():
                    own = nodes[is_hot]
                    rows += [(r[0], 1, *r[1:]) for r in _dealt(_bucket(own.view(np.uint64), buckets), own, sizes[is_hot], tokens[is_hot], hot_dfs[at[is_hot]])]
                tokens, nodes, sizes = tokens[~is_hot], nodes[~is_hot], sizes[~is_hot]
            if len(tokens):
                rows += [(r[0], 0, *r[1:]) for r in _dealt(_bucket(tokens, buckets), nodes, sizes, tokens, None)]
            if rows:
                yield _message(rows)

        sets: dict[int, np.ndarray] = {}
        held = 0
        for batch in batches:
            for t in batch.column(0):
                s = shingles(t.as_py(), size)
                k, other = node_of(s, bits)
                k = other if k in shared_names else k
                if len(s) and k not in sets:
                    sets[k] = s
                    held += len(s)
                    if held >= flush:
                        yield from told(sets)
                        sets, held = {}, 0
        if sets:
            yield from told(sets)

    return run


def _bucket(x: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(x, 3) % np.uint64(buckets)).astype(np.uint16 if buckets < 2**16 else np.uint32)


def _unpacked(table: pa.Table) -> tuple[np.ndarray, ...]:
    """The nodes, sizes, tokens and frequencies of all messages, one entry a token."""
    read = lambda c, kind: np.frombuffer(b"".join(table.column(c).to_pylist()), dtype=kind)
    counts = read("counts", np.uint32)
    return np.repeat(read("nodes", np.int64), counts), np.repeat(read("sizes", np.uint32), counts), read("tokens", np.uint64), read("dfs", np.uint32)


def _repeated(buckets: int):
    """A token bucket: tokens of two or more nodes go to the nodes' buckets with their frequency."""

    def run(table: pa.Table) -> pa.Table:
        nodes, sizes, tokens, _ = _unpacked(table)
        order = np.argsort(tokens)
        tokens = tokens[order]
        same = tokens[1:] == tokens[:-1]
        keep = np.zeros(len(tokens), dtype=bool)
        keep[1:] |= same
        keep[:-1] |= same
        order, tokens = order[keep], tokens[keep]
        nodes, sizes = nodes[order], sizes[order]
        order = np.lexsort((nodes, tokens))
        nodes, sizes, tokens = nodes[order], sizes[order], tokens[order]
        new = np.ones(len(tokens), dtype=bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (nodes[1:] != nodes[:-1])
        nodes, sizes, tokens = nodes[new], sizes[new], tokens[new]
        _, at, dfs = np.unique(tokens, return_inverse=True, return_counts=True)
        dfs = dfs[at]
        keep = dfs > 1
        nodes, sizes, tokens, dfs = nodes[keep], sizes[keep], tokens[keep], dfs[keep]
        order = np.argsort(nodes, kind="stable")
        nodes, sizes, tokens, dfs = nodes[order], sizes[order], tokens[order], dfs[order]
        rows = [(r[0], 1, *r[1:]) for r in _dealt(_bucket(nodes.view(np.uint64), buckets), nodes, sizes, tokens, dfs)] if len(nodes) else []
        return pa.Table.from_batches([_message(rows)] if rows else [], schema=_message([(0, 0, b"", b"", b"", b"", b"")]).schema)

    return run


_NODE = "node long, n long, unique long, tokens array<long>, prefix array<long>, prefix2 array<long>, prefix3 array<long>, bits array<long>"
#: 64-bit words of a node's bitmap: the parity of its repeated tokens in each of their bits.
_BITS = 8


def _nodes(percent: int):
    """A node bucket: the nodes whose prefix reaches a repeated token."""

    def run(table: pa.Table) -> pa.Table:
        nodes, sizes, tokens, dfs = _unpacked(table)
        order = np.lexsort((tokens, dfs, nodes))
        nodes, sizes, tokens, dfs = nodes[order], sizes[order].astype(np.int64), tokens[order], dfs[order]
        fresh = np.ones(len(nodes), dtype=bool)  # copies of a node in several partitions send its hot tokens again
        fresh[1:] = (nodes[1:] != nodes[:-1]) | (tokens[1:] != tokens[:-1])
        nodes, sizes, tokens, dfs = nodes[fresh], sizes[fresh], tokens[fresh], dfs[fresh]
        first = np.flatnonzero(np.concatenate([[True], nodes[1:] != nodes[:-1]])) if len(nodes) else np.empty(0, dtype=np.int64)
        out: list[list] = [[] for _ in range(8)]
        bit = mixed(tokens, 31) % np.uint64(64 * _BITS)
        word, bit = (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63))
        level = np.floor(np.log2(np.maximum(dfs, 1))).astype(np.int64)
        mixes = [mixed(tokens, 11), mixed(tokens, 23)]
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(nodes)], strict=True):
            n = int(sizes[a])
            unique = n - (b - a)
            reach = n - -(-percent * n // 100) + 1 - unique
            if reach > 0:
                own = tokens[a:b].view(np.int64)
                others = [own[np.lexsort((m[a:b], level[a:b]))[:reach]] for m in mixes]
                bits = np.zeros(_BITS, dtype=np.uint64)
                np.bitwise_xor.at(bits, word[a:b], bit[a:b])
                for column, value in zip(out, (int(nodes[a]), n, unique, own, own[:reach], *others, bits.view(np.int64)), strict=True):
                    column.append(value)
        kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 5
        names = [x.split()[0] for x in _NODE.split(", ")]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    return run


def _reaches(percent: int, prefix: str) -> Column:
    """Whether the first token that a and b share under an order leaves room for enough overlap; false without one."""
    mine, theirs = F.col(f"{prefix}_a"), F.col(f"{prefix}_b")

    def bound(x: Column) -> Column:
        left = [F.col(f"n_{s}") - F.col(f"unique_{s}") - F.array_position(p, x) for s, p in (("a", mine), ("b", theirs))]
        return (100 + percent) * (1 + F.least(*left)) >= percent * (F.col("n_a") + F.col("n_b"))

    return F.coalesce(let(F.get(F.array_intersect(mine, theirs), F.lit(0)), bound), F.lit(False))


def _verified(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The candidates (a, b) that pass the prefix and place filters of the other orders too and reach the similarity."""
    side = lambda x, *own: nodes.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in own])
    filters = ("n", "unique", "prefix2", "prefix3")
    both = pairs.join(side("a", *filters), "a").join(side("b", *filters), "b")
    both = both.where(_reaches(percent, "prefix2") & _reaches(percent, "prefix3")).select("a", "b", "n_a", "n_b")
    measured = both.join(side("a", "tokens"), "a").join(side("b", "tokens"), "b")
    measured = measured.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("tokens_a", "tokens_b")).alias("shared"))
    return measured.where(100 * F.col("shared") >= percent * (F.col("n_a") + F.col("n_b") - F.col("shared"))).select("a", "b")


def _possible(percent: int) -> str:
    """Whether the overlap that sizes and places leave (x and y share a token, at place ``at``) is enough."""
    return f"(100 + {percent}) * (1 + least(x.n - 1 - x.at, y.n - 1 - y.at)) >= {percent} * (x.n + y.n) AND 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)"


def _room(percent: int) -> str:
    """Whether the bitmaps leave room for enough overlap: bits that differ are tokens of one side, and so are unique tokens."""
    differ = " + ".join(f"bit_count(x.bits[{i}] ^ y.bits[{i}])" for i in range(_BITS))
    return f"(100 + {percent}) * (x.n - x.unique + y.n - y.unique - ({differ})) >= 2 * {percent} * (x.n + y.n)"


def near_duplicates(
    docs: DataFrame,
    size: int = 5,
    percent: int = 75,
    doc_id: str = "doc_id",
    text: str = "text",
    pivots: tuple[int, ...] = (1, 8),
    hot_share: float = HOT_SHARE,
    hot_least: int = HOT_LEAST,
    bucket_tokens: int = BUCKET_TOKENS,
    name_bits: int = 64,
) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row: the least document id of its component.

    ``name_bits`` is the length of nodes' first names; fewer bits make more nodes take their second, and no other result.
    """
    spark, store = docs.sparkSession, Store(docs.sparkSession, "jaccard")
    docs = picked(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long"), utf8(F.col("text")).alias("text"))
    profile = store.save(docs.mapInArrow(_profile(size, hot_share, hot_least, name_bits), _PROFILE), "profile")
    members = profile.where("token IS NULL").select("doc_id", "n", "node", "other")
    several = members.groupBy("node").agg(F.min("other").alias("low"), F.max("other").alias("high")).where("low != high")
    shared_names = {r.node for r in several.select("node").collect()}
    if shared_names:
        members = members.withColumn("node", F.when(F.col("node").isin(shared_names), F.col("other")).otherwise(F.col("node")))
    members = members.drop("other")
    n_docs, n_tokens = members.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    hot_from = max(hot_least, hot_share * n_docs / 2)
    hot = profile.where("token IS NOT NULL").groupBy("token").agg(F.sum("n").alias("df")).where(F.col("df") >= hot_from).toPandas()
    hot_tokens = hot["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hot_tokens)
    shared = spark.sparkContext.broadcast((hot_tokens[order], hot["df"].to_numpy(np.int64)[order], shared_names))
    buckets = max(8, math.ceil(n_tokens / bucket_tokens))

    sent = docs.select("text").mapInArrow(_send(size, buckets, shared, name_bits), _MESSAGE)
    # one pass, two readers: the messages of both kinds go through the same exchange
    dealt = sent.groupBy("bucket", "kind")
    told = dealt.applyInArrow(_route(buckets), _MESSAGE)
    nodes = store.save(told.groupBy("bucket").applyInArrow(_nodes(percent), _NODE), "nodes")

    postings = store.save(
        nodes.select("node", "n", "unique", F.posexplode("prefix").alias("pos", "token")).select("token", "node", "n", (F.col("unique") + F.col("pos")).alias("at")),
        "postings",
    )
    roots = None
    for k in range(len(pivots) + 1):
        now = postings.withColumn("root", F.col("node")) if roots is None else _rooted(postings, roots)
        groups = now.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("token")
        open_ = now.join(groups, "token", "left_semi")
        first = F.lit(True)
        if k:  # few groups are left open: bitmaps leave out most other pairs, and each comes from its first shared token alone
            open_ = open_.join(nodes.select("node", "unique", "prefix", "bits"), "node").withColumn("before", F.slice("prefix", 1, (F.col("at") - F.col("unique")).cast("int")))
            first = F.expr(_room(percent)) & ~F.arrays_overlap("x.before", "y.before")
        x, y, apart = open_.alias("x"), open_.alias("y"), F.expr("x.root < y.root")
        if k < len(pivots):  # the same nodes come first in every group, so few different ones are drawn
            order = Window.partitionBy("token").orderBy(F.xxhash64("node", F.lit(k)), "node")
            y = open_.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= pivots[k]).alias("y")
            apart = F.expr("x.root != y.root")
        tried = x.join(y, (F.col("x.token") == F.col("y.token")) & apart & F.expr(_possible(percent)) & first)
        pairs = tried.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
        links = store.save(_verified(pairs, nodes, percent), f"links-{k}")
        roots = store.save(_contracted(links, roots, store, k), f"roots-{k}")
    least = members.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    rooted = store.save(least.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least"), "rooted")
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "component_id")
    store.keep("profile", "rooted")
    out = members.join(named, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _contracted(links: DataFrame, roots: DataFrame | None, store: Store, k: int) -> DataFrame:
    """(node, root) after new links: only the links between the components so far are followed."""
    if roots is None:
        return components(links, store, f"round-{k}")
    side = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
    between = links.join(side("a"), "a", "left").join(side("b"), "b", "left")
    between = between.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")).distinct()
    merged = components(between, store, f"round-{k}")
    moved = roots.join(merged.toDF("root", "next"), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return moved.union(merged.join(roots.select("node"), "node", "left_anti").select("node", "root"))


def _rooted(postings: DataFrame, roots: DataFrame) -> DataFrame:
    return postings.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _route(buckets: int):
    """Kind 0 is a token bucket; kind 1 holds hot tokens on the way to their node bucket and passes through."""
    repeated = _repeated(buckets)

    def run(table: pa.Table) -> pa.Table:
        return table if table.num_rows and table.column("kind")[0].as_py() == 1 else repeated(table)

    return run


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each group of near duplicates, the one with the least document id (null last); rows without words all stay."""
    passing = Passing(docs, [])
    held = Store(docs.sparkSession, "keep-one").save(passing.inner.select(F.monotonically_increasing_id().alias("row"), *passing.kept), "docs")
    found = near_duplicates(held, doc_id="row", text=passing.inside(text), **options).where("n_shingles > 0").toDF("row", "n", "group")
    own = passing.inside(doc_id)
    place = F.struct(F.isnull(own).alias("none"), F.col(own).alias("id"), F.col("row").alias("row"))
    grouped = held.select("row", place.alias("place")).join(found, "row")
    firsts = grouped.groupBy("group").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
    gone = grouped.select("row", "group").join(firsts, "group").where(F.col("row") != F.col("first.row")).select("row")
    return passing.outer(held.join(gone, "row", "left_anti"))
