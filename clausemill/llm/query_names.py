"""Clients and misspelt vendors joined by name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausemill.llm.columns import utf8
from clausemill.llm.trie_join import near_names, plain_name


def misspelt(name: Column, vendor_id: Column) -> Column:
    """The name with two neighbours exchanged, where the hash of the id is even and there are two characters."""
    h, n = F.crc32(vendor_id.cast("string")), F.length(name)
    at = F.pmod(h, F.greatest(n - 1, F.lit(1))).cast("int")
    swapped = F.concat(F.substring(name, F.lit(1), at), F.substring(name, at + 2, F.lit(1)), F.substring(name, at + 1, F.lit(1)), F.substring(name, at + 3, n))
    return F.when((h % 2 == 0) & (n >= 2), swapped).otherwise(name)


def op12_edit_distance_names(spark, sf_dir):
    clients = spark.read.parquet(f"{sf_dir}/clients.parquet").select("client_id", plain_name(F.col("name")).alias("name")).where("name != ''")
    vendors = spark.read.parquet(f"{sf_dir}/vendors.parquet")
    vendors = vendors.select("vendor_id", plain_name(misspelt(utf8(F.col("name")), F.col("vendor_id"))).alias("query")).where("query != ''")
    # the many rows of one name are summed before anything is dealt by name; merge joins only, so nothing is broadcast
    told = clients.groupBy("name").agg(
        F.count("*").alias("n"), F.min("client_id").alias("first"), F.coalesce(F.sum(F.crc32(F.col("client_id").cast("string"))), F.lit(0)).alias("crc")
    )
    pairs = near_names(clients, vendors, query="query")
    found = pairs.join(told.hint("merge"), "name").groupBy("query", "distance").agg(F.sum("n").alias("n_clients"), F.min("first").alias("first_client_id"), F.sum("crc").alias("clients_crc"))
    return vendors.join(found.hint("merge"), "query").select("vendor_id", "distance", "n_clients", "first_client_id", "clients_crc")


QUERIES = {"op12_edit_distance_names": op12_edit_distance_names}
