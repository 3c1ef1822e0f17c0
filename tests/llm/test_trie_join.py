"""The name join against all pairs: descents, shards, units dealt into grids, odd names, the query."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from clausemill.llm.query_names import op12_edit_distance_names
from clausemill.llm.trie_join import descend, near_names


def osa(a, b):
    table = [list(range(len(b) + 1))]
    for i in range(1, len(a) + 1):
        row = [i]
        for j in range(1, len(b) + 1):
            best = min(table[i - 1][j] + 1, row[j - 1] + 1, table[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                best = min(best, table[i - 2][j - 2] + 1)
            row.append(best)
        table.append(row)
    return table[-1][-1]


def edited(dice, name, letters):
    for _ in range(dice.randrange(0, 4)):
        k = dice.randrange(0, len(name) + 1)
        kind = dice.randrange(4)
        if kind == 0:
            name = name[:k] + dice.choice(letters) + name[k:]
        elif kind == 1:
            name = name[:k] + name[k + 1 :]
        elif kind == 2:
            name = name[:k] + dice.choice(letters) + name[k + 1 :]
        else:
            name = name[:k] + name[k + 1 : k + 2] + name[k : k + 1] + name[k + 2 :]
    return name


def made(seed, n, letters, lengths):
    dice = random.Random(seed)
    names = ["".join(dice.choice(letters) for _ in range(dice.choice(lengths))) for _ in range(n)]
    return names, [edited(dice, dice.choice(names), letters) for _ in range(n)]


def near(spark, names, queries, **options):
    n = spark.createDataFrame([(x,) for x in names], "name string")
    q = spark.createDataFrame([(x,) for x in queries], "asked string")
    found = [(r.query, r.name, r.distance) for r in near_names(n, q, query="asked", **options).collect()]
    assert len(found) == len(set(found))
    return set(found)


def every(names, queries):
    return {(q, n, d) for q in set(queries) if q for n in set(names) if n and abs(len(q) - len(n)) <= 2 and (d := osa(q, n)) <= 2}


@pytest.mark.parametrize("letters, lengths", [("ab", range(1, 9)), ("abcdeö", range(3, 14)), ("xyz ", [8, 9, 10])])
def test_every_pair_within_two_edits(spark, letters, lengths):
    names, queries = made(7, 250, letters, list(lengths))
    names += [None, "", names[0]]
    queries += [None, "", queries[0], "ca", "abc"]
    assert near(spark, names, queries) == every([x for x in names if x], [x for x in queries if x])


def test_units_dealt_into_grids_and_short_shards_tell_the_same(spark):
    names, queries = made(9, 300, "ab", [6, 7, 8])
    want = every(names, queries)
    assert near(spark, names, queries, unit=7) == want
    assert near(spark, names, queries, zone=2) == want and near(spark, names, queries, zone=9, unit=20) == want


def test_slices_of_a_descent_tell_the_same():
    names, queries = made(4, 200, "abc", [7])
    names, queries = sorted(set(names)), sorted({x for x in queries if 5 <= len(x) <= 9})
    tell = lambda k: sorted(zip(*(x.tolist() for x in descend(np.zeros(len(names)), names, np.zeros(len(queries)), queries, k)), strict=True))
    assert tell(10) == tell(10**9) and len(tell(50)) > 20


def test_long_names_bad_bytes_and_clashing_columns(spark):
    long = "ab" * 5000
    assert near(spark, [long, long[:-1] + "x"], [long[1:], "short"]) == {(long[1:], long, 1), (long[1:], long[:-1] + "x", 2)}
    bad = spark.sql("SELECT CAST(X'6a6ff16e' AS STRING) AS name, 1 AS NAME, 2 AS length, 3 AS unit")
    fine = spark.createDataFrame([("jo�n", "x"), ("john", "y")], "name string, query string")
    assert {(r.query, r.name, r.distance) for r in near_names(fine, bad).collect()} == {("jo�n", "jo�n", 0), ("jo�n", "john", 1)}
    empty = fine.limit(0)
    assert near_names(empty, fine).collect() == [] and near_names(fine, empty).collect() == []


def plain(clients, vendors):
    """The contract's rows by all pairs of distinct names."""
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    by = defaultdict(list)
    for i, name in clients:
        if name:
            by[name.translate(table)].append(i)
    out, known = {}, {}
    for v, name in vendors:
        if not name:
            continue
        h = zlib.crc32(str(v).encode())
        if h % 2 == 0 and len(name) >= 2:
            k = h % (len(name) - 1)
            name = name[:k] + name[k + 1] + name[k] + name[k + 2 :]
        name = name.translate(table)
        if name not in known:
            known[name] = [(d, n) for n in by if abs(len(n) - len(name)) <= 2 and (d := osa(name, n)) <= 2]
        for d, n in known[name]:
            count, first, crc = out.get((v, d), (0, 10**18, 0))
            out[v, d] = (count + len(by[n]), min(first, *by[n], 10**18), crc + sum(zlib.crc32(str(i).encode()) for i in by[n]))
    return {(v, d, *x) for (v, d), x in out.items()}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_all_pairs(spark, sf):
    read = lambda t, c: [tuple(r.values()) for r in pq.read_table(f"/root/testdata/{sf}/{t}.parquet").select(c).to_pylist()]
    want = plain(read("clients", ["client_id", "name"]), read("vendors", ["vendor_id", "name"]))
    got = [tuple(r[c] for c in ("vendor_id", "distance", "n_clients", "first_client_id", "clients_crc")) for r in op12_edit_distance_names(spark, f"/root/testdata/{sf}").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_many_rows_of_one_name(spark, tmp_path):
    names = ["Jo Ma", "JO MA", "Jo  Ma", "Ma Jo", None, ""]
    clients = [(i, names[i % 2 if i % 3 else i % 6]) for i in range(3000)]
    vendors = [(i, names[i % 6] if i % 2 else "Jo Ma") for i in range(300)]
    spark.createDataFrame(clients, "client_id long, name string").select("*", F.lit("x").alias("query")).write.parquet(f"{tmp_path}/clients.parquet")
    spark.createDataFrame(vendors, "vendor_id long, name string").select("*", F.lit("x").alias("distance")).write.parquet(f"{tmp_path}/vendors.parquet")
    got = {tuple(r[c] for c in ("vendor_id", "distance", "n_clients", "first_client_id", "clients_crc")) for r in op12_edit_distance_names(spark, str(tmp_path)).collect()}
    assert got == plain(clients, vendors)
